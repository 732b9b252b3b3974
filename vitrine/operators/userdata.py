"""Keyed user state: upserts, votes, list merges, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_ITEMS = 200


def latest(rows: DataFrame, keys: list[str], order: list[str], most: int | None = None, group: str | None = None, created: str | None = None) -> DataFrame:
    """The last row of each key; with `most`, the newest `most` of each group stay."""
    last = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    df = rows.withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k")
    if most:
        newest = Window.partitionBy(group).orderBy(F.desc(created), *keys)
        df = df.withColumn("_k", F.row_number().over(newest)).filter(F.col("_k") <= most).drop("_k")
    return df


def first_writers(writers: DataFrame, group: str, first: str, most: int = 500) -> DataFrame:
    """writers (group, .., first), one row a writer of a group: the `most` of each group that wrote first; the rest find it full."""
    return writers.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(first))).filter(F.col("_k") <= most).drop("_k")


def toggled_votes(rows: DataFrame) -> DataFrame:
    """(product_id, votes) from presses (product_id, voter): an even number of presses takes the vote back."""
    per = rows.groupBy("product_id", "voter").agg(F.count("*").alias("presses"))
    return per.groupBy("product_id").agg(F.count_if(F.col("presses") % 2 == 1).alias("votes"))


def union_items(first: Column, second: Column, most: int = MAX_ITEMS) -> Column:
    """Both lists' items in order, each once; beyond `most` the oldest, at the front, go."""
    both = F.array_distinct(F.concat(first, second))
    return F.when(F.size(both) > most, F.slice(both, F.size(both) - most + 1, F.lit(most))).otherwise(both)


def merge_lists(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Lists (pos, id, name, items, created, updated) of two sides merged.

    A local list meets the remote list with its id, else the one with its name; each remote list is met once,
    by the first local list that comes for it; what is not met stays as it is.
    """
    key = lambda c: F.lower(F.trim(F.translate(c, "İI", "iı")))
    r = remote.select(*(F.col(c).alias(f"r_{c}") for c in remote.columns)).withColumn("r_key", key(F.col("r_name")))
    by_name = r.groupBy("r_key").agg(F.max_by("r_id", "r_pos").alias("name_id"))
    met = local.join(r.select(F.col("r_id").alias("id_id")), F.col("id") == F.col("id_id"), "left").join(by_name, key(F.col("name")) == F.col("r_key"), "left")
    met = met.withColumn("to", F.coalesce("id_id", "name_id"))
    turn = F.row_number().over(Window.partitionBy("to").orderBy("pos"))
    met = met.withColumn("to", F.when(F.col("to").isNotNull() & (turn == 1), F.col("to"))).drop("id_id", "name_id", "r_key")
    both = met.join(r, F.col("to") == F.col("r_id"), "full")
    newer = F.coalesce(F.col("updated") > F.col("r_updated"), F.col("r_updated").isNull())
    return both.select(
        F.coalesce("r_id", "id").alias("id"),
        F.when(newer, F.col("name")).otherwise(F.col("r_name")).alias("name"),
        F.when(F.col("r_id").isNull(), F.col("items")).when(F.col("id").isNull(), F.col("r_items")).otherwise(union_items(F.col("r_items"), F.col("items"))).alias("items"),
        F.least("created", "r_created").alias("created"),
        F.greatest("updated", "r_updated").alias("updated"),
    )


def resolve_share(products: DataFrame, codes: DataFrame, short_id: Column) -> DataFrame:
    """(slot, code, id): for each code the first product in load order that has it."""
    first = products.groupBy(short_id.alias("code")).agg(F.min_by("id", "pos").alias("id"))
    return codes.join(first, "code", "left")


def accept_versions(stored: DataFrame, writes: DataFrame) -> DataFrame:
    """writes with accepted: only those whose base version is the one stored."""
    s = stored.select("key", F.col("version").alias("stored"))
    return writes.join(s, "key", "left").withColumn("accepted", F.col("stored").isNull() | (F.col("stored") <= F.col("base")))


def list_page(lists: DataFrame, order: str, page: int = 1, size: int = 20) -> DataFrame:
    """(id, views, total, place) of a page of lists (id, views, at): the newest first ("new"), or by views, then date ("views")."""
    keys = ([F.desc("views")] if order == "views" else []) + [F.desc("at"), F.asc("id")]
    shown = lists.orderBy(*keys).limit(page * size)  # only these are numbered
    placed = shown.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*keys))).filter(F.col("place") > (page - 1) * size)
    return placed.crossJoin(lists.agg(F.count("*").alias("total"))).select("id", "views", "total", "place")  # one number
