"""Landed files: event days, brand groups, dimensions and keyed stores; sinks, reports and resumable lots."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitrine.functions.text import primary_name, slugify
from vitrine.sources import EVENT, read_catalog, upsert

LEGACY_LIST = "LİSTEM"


def _read(reader: Callable[[], DataFrame]) -> DataFrame | None:
    """What the reader reads, None where nothing is there."""
    try:
        return reader()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


# -- event logs ------------------------------------------------------------------------------------------------


def append_events(events: DataFrame, folder: str, prefix: str) -> None:
    """Append events (at, ..) to the log of their UTC day, one folder a day; prefix: the kind of log."""
    days = events.withColumn("day", F.date_format(F.col("at"), "yyyy-MM-dd"))
    days.write.partitionBy("day").mode("append").json(f"{folder}/{prefix}")


def read_day(spark: SparkSession, folder: str, prefix: str, day: str) -> DataFrame | None:
    """One day's events; lines that don't parse are skipped.  None if the day was never written, which is not an empty day."""
    return _read(lambda: spark.read.schema(EVENT).option("mode", "DROPMALFORMED").json(f"{folder}/{prefix}/day={day}"))


def read_days(spark: SparkSession, folder: str, prefix: str, first: str, last: str) -> DataFrame:
    """Events of a span of days; only the days' folders are read."""
    whole = spark.read.schema(f"{EVENT}, day DATE").option("mode", "DROPMALFORMED").json(f"{folder}/{prefix}")
    return whole.filter(F.col("day").between(first, last))


# -- groups, dimensions and stores ------------------------------------------------------------------------------


def read_groups(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Groups from one file or from a folder of them, each a JSON array; files that don't parse are skipped.  With `file`."""
    whole = spark.read.schema(f"{ddl}, _broken STRING").option("multiLine", True).option("columnNameOfCorruptRecord", "_broken").json(path)
    return whole.withColumn("file", F.regexp_extract(F.input_file_name(), "([^/]+)$", 1)).filter(F.col("_broken").isNull()).drop("_broken")


def write_arrays(rows: DataFrame, path: str, lot: str, record: str, compression: str = "none") -> None:
    """Records as JSON arrays, one file a lot in a folder of its own, written a record a line; no lot is gathered anywhere.

    The brackets stand in the first and last record's line, so that a lot's lines are all of one shuffle.
    """
    text = F.to_json(F.col(record))
    lines = rows.select(lot, F.xxhash64(text).alias("_k"), text.alias("_t"))
    order = Window.partitionBy(lot).orderBy("_k", "_t")
    lines = lines.select(lot, "_t", F.row_number().over(order).alias("_n"), F.lead(F.lit(True)).over(order).isNull().alias("_last"))
    value = F.concat(F.when(F.col("_n") == 1, "[").otherwise(","), "_t", F.when(F.col("_last"), "]").otherwise(""))
    lines = lines.repartition(lot).sortWithinPartitions(lot, "_n").select(lot, value.alias("value"))
    lines.write.partitionBy(lot).option("compression", compression).text(path)


def read_dimension(spark: SparkSession, path: str, value: str, key_name: str = "slug", value_name: str = "value") -> DataFrame:
    """A JSON object of entries as rows (key, value of the type given); a missing file has none.

    Dimension files hold an entry for each brand, a few hundred; each is one row of text.
    """
    text = _read(lambda: spark.read.text(path, wholetext=True))
    if text is None:
        return spark.createDataFrame([], f"{key_name} STRING, {value_name} {value}")
    return text.select(F.explode(F.from_json("value", f"MAP<STRING, {value}>")).alias(key_name, value_name))


def read_store(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A keyed store as rows; one that was never written is empty."""
    found = _read(lambda: spark.read.schema(ddl).parquet(path))
    return spark.createDataFrame([], ddl) if found is None else found


def load_brands(roster: DataFrame, manifest: DataFrame, archived: DataFrame) -> DataFrame:
    """(name, slug, url, platform): the roster (name) with what the manifest's source text (value) says of each brand.

    Archived brands (slug) and those without an address are left out.
    """
    entry = r"\{\s*name:\s*\"((?:[^\"\\]|\\.)*)\",\s*slug:\s*\"([^\"]*)\",\s*url:\s*\"([^\"]*)\",\s*platform:\s*\"([^\"]*)\""
    parts = F.transform(F.regexp_extract_all("value", F.lit(f"({entry})"), 1), lambda e: F.struct(*(F.regexp_extract(e, entry, k).alias(n) for k, n in ((2, "slug"), (3, "url"), (4, "platform")))))
    known = manifest.select(F.explode(parts).alias("e")).select("e.*")
    named = roster.select("name", slugify(primary_name(F.col("name"))).alias("slug"))
    return named.join(known, "slug").filter(F.col("url") != "").join(archived.select("slug"), "slug", "left_anti").select("name", "slug", "url", "platform")


def migrate_lists(lists: DataFrame, legacy: DataFrame) -> DataFrame:
    """lists (device, id, name, ids) and, for devices without any, the one list (device, ids) of the older form."""
    old = legacy.join(lists.select("device").distinct(), "device", "left_anti")
    return lists.unionByName(old.select("device", F.concat(F.lit("l-"), "device").alias("id"), F.lit(LEGACY_LIST).alias("name"), "ids"))


class CatalogCache:
    """Catalogues by path, read once and kept; an empty one is an error and never kept."""

    def __init__(self, spark: SparkSession, read: Callable[[SparkSession, str], DataFrame] = read_catalog) -> None:
        self.spark, self.read, self.kept = spark, read, {}

    def get(self, path: str) -> DataFrame:
        if path not in self.kept:
            self.kept[path] = self.read(self.spark, path).persist()
        return self.kept[path]

    def clear(self) -> None:
        """Forget all of them together."""
        for df in self.kept.values():
            df.unpersist()
        self.kept = {}


# -- sinks -------------------------------------------------------------------------------------------------------


def write_split(routed: DataFrame, catalog: str, archive: str) -> None:
    """Products with archive_reason to two tables: those without a reason, and the rest."""
    routed.filter(F.col("archive_reason").isNull()).drop("archive_reason").write.mode("overwrite").parquet(catalog)
    routed.filter(F.col("archive_reason").isNotNull()).write.mode("overwrite").parquet(archive)


def write_report(report: DataFrame, path: str, key: str = "slug") -> None:
    """A report of one row a brand as JSON lines in the order of key."""
    report.repartitionByRange(1, key).sortWithinPartitions(key).write.mode("overwrite").json(path)


def upsert_manifest(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Brands found (slug, ..) over those of the manifest; what was not found anew stays."""
    return upsert(manifest, found, "slug")


def in_lots(todo: DataFrame, done_path: str, work: Callable[[DataFrame], DataFrame], key: str = "id", lot: int = 2000) -> DataFrame:
    """work() over the rows of todo that done_path does not have yet, a lot at a time; each lot is kept once written.

    A run that was cut short goes on where it stopped.  work keeps the key.
    """
    spark = todo.sparkSession
    done = _read(lambda: spark.read.parquet(done_path))
    left = todo if done is None else todo.join(done.select(key), key, "left_anti")
    lots = max(1, -(-left.count() // lot))
    dealt = f"{done_path.rstrip('/')}-lots-{uuid.uuid4().hex}"
    # dealt once; a lot then reads its own partition
    left.withColumn("_lot", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(lots))).repartition("_lot").write.partitionBy("_lot").parquet(dealt)
    try:
        for k in range(lots):
            mine = spark.read.schema(left.schema).parquet(f"{dealt}/_lot={k}") if _exists(spark, f"{dealt}/_lot={k}") else None
            if mine is not None:
                work(mine).write.mode("append").parquet(done_path)
    finally:
        remove(spark, dealt)
    return spark.read.parquet(done_path)


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    files, where = _file_system(spark, path)
    return files.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that is no longer read."""
    files, where = _file_system(spark, path)
    files.delete(where, True)


def newest(rows: DataFrame, key: str, at: Column) -> DataFrame:
    """The newest row of each key, for read-through tables whose entries are written again when they run out."""
    names = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), at).alias("_r")).select(key, "_r.*")


def cached(entries: DataFrame, wanted: DataFrame, load: Callable[[DataFrame], DataFrame], now: Column, seconds: int) -> DataFrame:
    """(key, value, at) for wanted (key): from entries that are young enough, the rest by load(); empty values count as found."""
    live = newest(entries, "key", F.col("at")).filter(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp")) <= seconds * 1_000_000)
    have = wanted.join(live, "key")
    return have.unionByName(load(wanted.join(live.select("key"), "key", "left_anti")).withColumn("at", now))
