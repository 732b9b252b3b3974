"""Sources and sinks: tables written in the files' form to the shared folder and read back, with SQL over the tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine import sources
from vitrine.operators import feed, resolve
from vitrine.plans.catalog import PRODUCT_SQL, products, table
from vitrine.sources import landed

Q: dict = {}
SQL: dict[str, str] = {}
P = f"WITH {PRODUCT_SQL}"


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def shared(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a temporary one on a single machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="vitrine-")
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    _SHARED.append((spark, path))
    return path


_SHARED: list[tuple[SparkSession, str]] = []


@atexit.register
def _remove_shared() -> None:
    """What queries wrote goes when the application ends; a session that has stopped leaves it to the cluster's clean-up."""
    for spark, path in _SHARED:
        try:
            landed.remove(spark, path)
        except Exception:  # noqa: BLE001
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """df from a table in the shared folder: worked out once, however often it is read."""
    path = shared(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def logged(spark, sf_dir) -> DataFrame:
    """Events in the logs' form."""
    return table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("session"), F.col("value").alias("price"))


@query("S04_read_day", "SELECT 'read' AS day, event_type AS kind, count(*) AS n FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-05' GROUP BY 2 UNION ALL SELECT 'missing', '-', 0")
def one_day(spark, sf_dir):
    """A day that was written, with a broken line put into it, and one that never was."""
    path = shared(spark, "events")
    landed.append_events(logged(spark, sf_dir), path, "views")
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(f"{path}/views/day=2024-01-05")
    found = landed.read_day(spark, path, "views", "2024-01-05").groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("read").alias("day"), "kind", "n")
    missing = landed.read_day(spark, path, "views", "1999-01-01")
    return found.unionByName(spark.createDataFrame([("missing" if missing is None else "empty", "-", 0)], "day string, kind string, n long"))


@query("K01_append_events", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, count(DISTINCT user_id) AS sessions FROM events WHERE ts < TIMESTAMP '2024-01-11' GROUP BY 1")
def appended(spark, sf_dir):
    """Two writers' appends end in one log by day; only the days asked for are read."""
    path, ev = shared(spark, "events"), logged(spark, sf_dir)
    for part in (ev.filter("price < 50"), ev.filter("price >= 50 or price is null")):
        landed.append_events(part, path, "views")
    return landed.read_days(spark, path, "views", "2000-01-01", "2024-01-10").groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("session").alias("sessions"))


@query("K02_two_logs", "SELECT CASE WHEN event_type = 'view' THEN 'views' ELSE 'outbound' END AS log, count(*) AS n FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1")
def two_logs(spark, sf_dir):
    path, ev = shared(spark, "events"), logged(spark, sf_dir)
    found = None
    for prefix, kinds in (("views", ["view"]), ("outbound", ["click", "purchase"])):
        landed.append_events(ev.filter(F.col("kind").isin(kinds)), path, prefix)
        n = landed.read_days(spark, path, prefix, "2000-01-01", "2100-01-01").agg(F.lit(prefix).alias("log"), F.count("*").alias("n"))
        found = n if found is None else found.unionByName(n)
    return found


GROUP_DDL = "id STRING, name STRING, price DOUBLE"


@query("S05_brand_groups", "SELECT lower(replace(p_brand, '#', '-')) AS brand_slug, count(*) AS n, sum(p_partkey) AS ids FROM part GROUP BY 1")
def brand_groups(spark, sf_dir):
    """One file of a JSON array for each brand, and a broken file, which is skipped."""
    path = shared(spark, "groups")
    rows = table(spark, sf_dir, "part").select(F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("b"), F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price")).alias("r"))
    landed.write_arrays(rows, path, "b", "r")
    spark.createDataFrame([("[{broken",)], "value string").write.mode("append").text(f"{path}/b=broken")
    found = landed.read_groups(spark, path, f"{GROUP_DDL}, b STRING")
    return found.groupBy(F.col("b").alias("brand_slug")).agg(F.count("*").alias("n"), F.sum(F.col("id").cast("long")).alias("ids"))


@query("S06_one_group_file", "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_brand = 'Brand#3'")
def one_group_file(spark, sf_dir):
    """The same reader on a single file."""
    path = shared(spark, "group")
    rows = table(spark, sf_dir, "part").filter("p_brand = 'Brand#3'").select(F.lit("3").alias("b"), F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name")).alias("r"))
    landed.write_arrays(rows, path, "b", "r")
    return landed.read_groups(spark, f"{path}/b=3", GROUP_DDL).select(F.col("id").cast("long").alias("id"), "name")


def as_objects(rows: DataFrame, key: str, value: F.Column, lot: F.Column) -> DataFrame:
    """A table as JSON objects, one for each lot of it."""
    return rows.groupBy(lot.alias("lot")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col(key), value)))).alias("value"))


@query("S07_color_tag_file", "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'siyah|mavi' ELSE '' END AS tags, '' AS without_file FROM part")
def color_tag_file(spark, sf_dir):
    """Tags from side files, one a brand; without a file nothing is tagged."""
    path = shared(spark, "tags")
    p = table(spark, sf_dir, "part").withColumn("id", F.col("p_partkey").cast("string"))
    as_objects(p.filter("p_partkey % 4 = 0"), "id", F.struct(F.array(F.lit("siyah"), F.lit("mavi")).alias("tags")), F.col("p_brand")).write.partitionBy("lot").text(path)
    kind = "STRUCT<tags: ARRAY<STRING>>"
    tags, none = (landed.read_dimension(spark, x, kind, "id") for x in (path, f"{path}-missing"))
    j = p.join(tags.select("id", F.col("value.tags").alias("t")), "id", "left").join(none.select("id", F.col("value.tags").alias("u")), "id", "left")
    return j.select(F.col("p_partkey").alias("id"), F.coalesce(F.array_join("t", "|"), F.lit("")).alias("tags"), F.coalesce(F.array_join("u", "|"), F.lit("")).alias("without_file"))


@query("S08_dimensions", "SELECT s_name AS slug, s_acctbal AS score FROM supplier")
def dimensions(spark, sf_dir):
    path = shared(spark, "scores")
    as_objects(table(spark, sf_dir, "supplier"), "s_name", F.col("s_acctbal"), F.col("s_nationkey")).write.partitionBy("lot").text(path)
    return landed.read_dimension(spark, path, "DOUBLE", "slug", "score")


@query("S09_roster_csv", "SELECT s_name AS name, CASE WHEN s_nationkey % 2 = 0 THEN 'basic|y2k' ELSE '' END AS styles, 'https://' || s_suppkey || '.com' AS url FROM supplier")
def roster_csv(spark, sf_dir):
    path = shared(spark, "brands")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.when(F.col("s_nationkey") % 2 == 0, "basic;y2k;").otherwise("").alias("style"), F.concat(F.lit("https://"), F.col("s_suppkey"), F.lit(".com")).alias("url"))
    rows.write.option("header", True).csv(path)
    return sources.read_brands(spark, path).select("name", F.coalesce(F.array_join("styles", "|"), F.lit("")).alias("styles"), "url")


@query("S10_load_brands", "SELECT s_name AS name, 'supplier-' || substr(s_name, 10) AS slug, 'https://' || s_suppkey || '.com' AS url, 'shopify' AS platform FROM supplier WHERE s_suppkey % 5 NOT IN (0, 1)")
def loaded_brands(spark, sf_dir):
    """Roster names joined to a manifest of source text, without archived brands and those that have no address."""
    path = shared(spark, "manifest")
    s = table(spark, sf_dir, "supplier").withColumn("slug", F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))))
    url = F.when(F.col("s_suppkey") % 5 == 0, "").otherwise(F.concat(F.lit("https://"), F.col("s_suppkey"), F.lit(".com")))
    line = F.concat(F.lit('  { name: "'), "s_name", F.lit('", slug: "'), "slug", F.lit('", url: "'), url, F.lit('", platform: "shopify" },'))
    s.select(line.alias("value")).write.text(path)
    return landed.load_brands(s.select(F.col("s_name").alias("name")), spark.read.text(path), s.filter("s_suppkey % 5 = 1").select("slug"))


@query("S25_keyed_stores", "SELECT 'written' AS store, count(*) AS n FROM customer UNION ALL SELECT 'never written', 0")
def keyed_stores(spark, sf_dir):
    path = shared(spark, "store")
    table(spark, sf_dir, "customer").select("c_custkey", "c_name").write.parquet(path)
    n = lambda p, name: landed.read_store(spark, p, "c_custkey BIGINT, c_name STRING").agg(F.lit(name).alias("store"), F.count("*").alias("n"))
    return n(path, "written").unionByName(n(f"{path}-missing", "never written"))


@query("S26_migrated_lists", "SELECT c_custkey AS device, CASE WHEN c_custkey % 3 = 0 THEN 'own' ELSE 'LİSTEM' END AS name, 2 AS items FROM customer")
def migrated_lists(spark, sf_dir):
    """Devices with lists keep them; the one list of the older form becomes the first list of the others."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("device"), F.array(F.lit("a"), F.lit("b")).alias("ids"))
    lists = c.filter("device % 3 = 0").select("device", F.lit("l1").alias("id"), F.lit("own").alias("name"), "ids")
    return landed.migrate_lists(lists, c).select("device", "name", F.size("ids").alias("items"))


#: Products in a file of the snapshot: an array is written and read by one task, so there are more files, not larger ones.
LOT = 10_000


@query("S27_gzip_snapshot", f"{P} SELECT id, name, price FROM product")
def gzip_snapshot(spark, sf_dir):
    """A catalogue written as gzip JSON and read through the catalogue's reader and cache; the second read is the kept one."""
    path = shared(spark, "snapshot")
    lots = max(8, -(-table(spark, sf_dir, "part").count() // LOT))
    rows = products(spark, sf_dir).select((F.col("pos") % lots).alias("lot"), F.struct("id", "name", "price").alias("r"))
    landed.write_arrays(rows, path, "lot", "r", compression="gzip")
    cache = landed.CatalogCache(spark)
    first = cache.get(path)
    found = cache.get(path).select("id", "name", "price")
    assert first is cache.kept[path]
    return found


@query("K03_catalog_and_archive", f"{P}, r AS (SELECT brand IN ('Brand#1', 'Brand#7') AS gone FROM product) SELECT CASE WHEN gone THEN 'archive' ELSE 'catalog' END AS kept_in, count(*) AS n FROM r GROUP BY 1")
def catalog_and_archive(spark, sf_dir):
    """Every product is in one of the two tables."""
    path = shared(spark, "split")
    p = products(spark, sf_dir).select("id", "brand", "category", F.lit(None).cast("string").alias("kids"))
    landed.write_split(resolve.route(p, ["Brand#1", "Brand#7"]), f"{path}/catalog", f"{path}/archive")
    n = lambda name: spark.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("kept_in"), F.count("*").alias("n"))
    return n("catalog").unionByName(n("archive"))


@query("K06_report", f"{P} SELECT brand_slug AS slug, count(*) AS records, row_number() OVER (ORDER BY brand_slug) AS line FROM product GROUP BY 1")
def report(spark, sf_dir):
    """One line a brand, in the order of slugs as they stand in the file."""
    path = shared(spark, "report")
    landed.write_report(products(spark, sf_dir).groupBy(F.col("brand_slug").alias("slug")).agg(F.count("*").alias("records")), path)
    lines = spark.read.schema("slug STRING, records BIGINT").json(path)
    return lines.select("slug", "records", (F.monotonically_increasing_id() + 1).alias("line"))


@query("K08_resumed_lots", "SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'before' ELSE 'now' END AS run FROM part")
def resumed_lots(spark, sf_dir):
    """A run of lots that begins with part of the work done."""
    path = shared(spark, "lots")
    todo = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    todo.filter("id % 7 = 0").select("id", F.lit("before").alias("run")).write.parquet(path)
    return landed.in_lots(todo, path, lambda lot: lot.select("id", F.lit("now").alias("run")), lot=max(1, todo.count() // 3))


@query("K11_manifest_upsert", "SELECT s_name AS slug, CASE WHEN s_suppkey % 3 = 2 THEN 'new' || s_suppkey WHEN s_suppkey % 3 = 0 THEN 'old' || s_suppkey WHEN s_suppkey % 2 = 0 THEN 'new' || s_suppkey ELSE 'old' || s_suppkey END AS url FROM supplier")
def manifest_upsert(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    named = lambda rows, what: rows.select(F.col("s_name").alias("slug"), F.concat(F.lit(what), F.col("s_suppkey")).alias("url"))
    found = named(s.filter("s_suppkey % 3 = 2 or (s_suppkey % 3 = 1 and s_suppkey % 2 = 0)"), "new")
    return landed.upsert_manifest(named(s.filter("s_suppkey % 3 < 2"), "old"), found)


@query("K12_sample_file", f"""{P}, t AS (SELECT *, row_number() OVER (PARTITION BY category, brand_slug ORDER BY pos) AS turn, min(pos) OVER (PARTITION BY category, brand_slug) AS first FROM product)
    SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY turn, first) AS place FROM t QUALIFY place <= 4""")
def sample_file(spark, sf_dir):
    """The stratified sample, written as JSON and read back."""
    path = shared(spark, "sample")
    feed.stratified(products(spark, sf_dir), 4).select("id", "category", "place").write.json(path)
    return spark.read.schema("id STRING, category STRING, place INT").json(path)


@query("T17_cached_values", "SELECT p_partkey AS key, CASE WHEN p_partkey % 4 = 0 THEN 'kept' WHEN p_partkey % 4 = 1 THEN NULL ELSE 'loaded' END AS value FROM part")
def cached_values(spark, sf_dir):
    """Young entries are used, empty ones too; old and missing ones are loaded."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"))
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    age = F.when(F.col("key") % 4 == 2, 7200).otherwise(60)
    entry = lambda value, back: p.filter("key % 4 < 3").select("key", value.alias("value"), (now - F.make_interval(secs=age + back)).alias("at"))
    entries = entry(F.when(F.col("key") % 4 == 0, "kept"), F.lit(0)).unionByName(entry(F.lit("older"), F.lit(9)))
    return landed.cached(entries, p, lambda todo: todo.select("key", F.lit("loaded").alias("value")), now, 3600).select("key", "value")
