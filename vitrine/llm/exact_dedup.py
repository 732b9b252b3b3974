"""Exact deduplication by a tree merge of digest runs (operator 9).  DataFrame functions only.

Each input partition is a run: its rows reduced to one entry per digest, the best identifier and the
number of rows.  In every round `fan_in` neighbouring runs merge into one; an entry meets at most
`fan_in` entries of its digest, however large the group of copies is, and the tasks of a round are dealt
by (run, digest), so a run of the last rounds is spread over the cluster too.  What stays at the root is
joined back down through the first level's runs, where a digest stands once per run; so neither the way
up nor the way down brings a whole group of copies to one task.

Digests are verified at every level: entries merge only where SHA-256, byte length and an independent
64-bit hash all agree.

Defined results: a null text counts as empty; empty texts are one group; of rows with the same
identifier and text one stays, the others are dropped; a null identifier ranks last; an empty table
gives an empty table; other columns of the input, whatever their names, are not touched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitrine.llm.common import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENTRY = ["_sha", "_bytes", "_check"]
FILE_BITS = 40  # of the row number: the place in the file


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  lower() does the same on pure ASCII and is much faster there."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def read_of_files(docs: DataFrame) -> DataFrame:
    """docs if it is a plain read of Parquet files (each named once), or else a staged copy that is."""
    if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation":
        try:
            docs.select(docs.metadataColumn("_metadata").getField("row_index"))
            return docs
        except AnalysisException:
            pass
    return stage(docs, "documents")


def with_row(docs: DataFrame, *cols: Column) -> DataFrame:
    """cols and _row, a number of the row: the place of its file among the files by name, and its place in the file.

    Both are facts of the files, so every read has the same numbers, however the files are split among tasks.
    docs is from read_of_files().  The files' numbers are a staged table, whose size Spark knows when it plans the join.
    """
    place = docs.metadataColumn("_metadata")
    files = docs.select(place.getField("file_path").alias("_file")).distinct()
    files = stage(files.select("_file", F.row_number().over(Window.orderBy("_file")).cast("long").alias("_number")), "files")
    rows = docs.select(*cols, place.getField("file_path").alias("_file"), place.getField("row_index").alias("_at"))
    number = F.coalesce(F.col("_number"), F.raise_error(F.lit("a file was added during the job")).cast("long"))
    row = F.shiftleft(number, FILE_BITS) + F.col("_at")
    return rows.join(files, "_file", "left").select(*rows.columns[:-2], row.alias("_row"))


def without_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows whose _row is in dropped.  Whatever docs' columns are called, they stay as they are."""
    whole = with_row(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"))
    return whole.join(dropped, "_row", "left_anti").select("_doc.*")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: bool = True) -> DataFrame:
    """One narrow row per input row: _row, _id, run, digest, length and second hash of the text."""
    norm = ascii_lower(F.col(text_col)) if fold else F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        "_row",
        F.col(id_col).alias("_id"),
        F.spark_partition_id().alias("_run"),
        F.unhex(F.sha2(norm, 256)).alias("_sha"),
        F.octet_length(norm).alias("_bytes"),
        F.xxhash64(norm).alias("_check"),
    )


def merge_runs(entries: DataFrame, fan_in: int, best: Callable[[str], Column]) -> DataFrame:
    """Rounds of multiway merges until one run is left; entries: _run, *ENTRY, _best, _n; best: F.min or F.max."""
    runs = entries.agg(F.coalesce(F.max("_run"), F.lit(0)).alias("m")).first()["m"] + 1
    while runs > 1:
        entries = (
            entries.withColumn("_run", F.floor(F.col("_run") / fan_in).cast("int"))
            .groupBy("_run", *ENTRY)
            .agg(best("_best").alias("_best"), F.sum("_n").alias("_n"))
        )
        runs = -(-runs // fan_in)
    return entries.select(*ENTRY, F.col("_best").alias("_root"), F.col("_n").alias("_size"))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan_in: int = 16, fold: bool = True
) -> DataFrame:
    """One row per input row: _row, id, keep_id, group_size, kept, text_sha256.

    fold: whether texts that differ in the case of A-Z alone are equal.

    keep: "smallest" or "largest" identifier (of any type that has an order) of each group stays.  _row as in with_row().
    """
    rows = with_row(read_of_files(docs), F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    rows = stage(digests(rows, "_id", "_text", fold), "digests")
    # the row number breaks ties between rows with one identifier; null identifiers come last either way
    best = F.max if keep == "largest" else F.min
    order = (F.col("_id").isNotNull(), -F.col("_row")) if keep == "largest" else (F.col("_id").isNull(), F.col("_row"))
    rows = rows.withColumn("_best", F.struct(order[0].alias("null"), F.col("_id").alias("id"), order[1].alias("row")))
    level0 = rows.groupBy("_run", *ENTRY).agg(best("_best").alias("_best"), F.count(F.lit(1)).alias("_n"))
    found = level0.select("_run", *ENTRY).join(merge_runs(level0, fan_in, best), ENTRY)
    return rows.join(found, ["_run", *ENTRY]).select(
        "_row",
        F.col("_id").alias(id_col),
        F.col("_root.id").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_root.row") == order[1]).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """docs without all but one row of each group of equal texts; the columns stay as they are."""
    docs = read_of_files(docs)
    dropped = exact_dedup(docs, id_col, text_col, keep).filter(~F.col("kept")).select("_row")
    return without_rows(docs, dropped)
