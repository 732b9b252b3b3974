"""The seeded diversity feed: scores, greedy weave, stride tail, round robin and stratified samples.

The weave is sequential by definition: each pick depends on those before it.  It sees a pruned set only,
the best rows of each brand up to the number of picks, which loses nothing as no more can be picked; the
tail, all other rows, is ordered by window functions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitrine.functions import score as S
from vitrine.functions.color import tone_class
from vitrine.functions.text import rand01


@dataclass(frozen=True)
class Rules:
    brand_gap: int
    category_run: int
    tone_run: int
    fatigue: float
    category_fatigue: float


#: Rules by mode, and how many rows are woven at most.
RULES = {"kesfet": Rules(4, 2, 3, 0.86, 0.82), "kategori": Rules(3, 0, 3, 0.92, 1.0), "markalar": Rules(8, 0, 0, 0.5, 0.94)}
WEAVE_LIMIT = 4000


def scored(products: DataFrame, brand01: Column, seed: str) -> DataFrame:
    """products with quality, beauty and base, the score without noise."""
    df = products.withColumn("brand01", brand01)
    df = df.withColumn("quality", S.product_quality(F.col("n_images"), F.col("n_variants"), F.col("price"), F.col("sizes"), F.col("in_stock"), F.col("name"), F.col("category")))
    df = df.withColumn("beauty", S.aesthetic(F.col("styles"), F.col("color_tags"), F.col("n_images"), F.col("n_variants")))
    df = df.withColumn("rank01", S.brand_rank(F.col("brand01"), F.col("brand_slug"), seed))
    total = (
        F.col("rank01") * 0.55
        + F.col("quality") * 0.28
        + F.col("beauty") * 0.22
        + S.fresh_bonus(F.col("day"))
        + S.size_bonus(F.col("sizes"))
        + S.spotlight_bonus(F.col("quality"), F.col("brand01"), seed, F.col("id"))
        + S.underdog_bonus(F.col("brand01"), F.col("beauty"), seed, F.col("id"))
        - S.scarcity_penalty(F.col("sizes"))
    )
    return df.withColumn("base", S.clamp(total))


def with_noise(df: DataFrame, mode: str, seed: str) -> DataFrame:
    w = S.NOISE[mode]
    return df.withColumn("s", F.col("base") * (1 - w) + rand01(seed, F.col("id")) * w)


def round_robin(df: DataFrame, seed: str) -> DataFrame:
    """df with round and place: round r holds the r-th best of every brand, brands in the order of their rank."""
    within = Window.partitionBy("brand_slug").orderBy(F.desc("s"), "pos")
    turn = F.col("rank01") * 0.7 + rand01(seed, F.concat(F.lit("tur:"), F.col("brand_slug"))) * 0.3
    df = df.withColumn("round", F.row_number().over(within)).withColumn("turn", turn)
    first = F.min("pos").over(Window.partitionBy("brand_slug"))
    return df.withColumn("place", F.row_number().over(Window.partitionBy("round").orderBy(F.desc("turn"), first)))


def weave_rows(rows: pd.DataFrame, rules: Rules, limit: int) -> list[int]:
    """Positions of the rows in the order of picks; rows: brand_slug, category, tone, s, pos, sorted by pos."""
    lanes: dict[str, list[int]] = {}
    brand, category, tone, s = (rows[c].tolist() for c in ("brand_slug", "category", "tone", "s"))
    for k in range(len(rows)):
        lanes.setdefault(brand[k], []).append(k)
    order = [sorted(lane, key=lambda k: -s[k]) for lane in lanes.values()]
    at, out, seen = [0] * len(order), [], {}

    def allowed(k: int) -> bool:
        if any(brand[j] == brand[k] for j in out[len(out) - min(rules.brand_gap, len(out)) :]):
            return False
        for run, key in ((rules.category_run, category), (rules.tone_run, tone)):
            if 0 < run <= len(out) and not (key is tone and tone[k] == 0) and all(key[j] == key[k] for j in out[-run:]):
                return False
        return True

    for _ in range(min(limit, len(rows))):
        ranked = []
        for lane, picks in enumerate(order):
            if at[lane] < len(picks):
                k = picks[at[lane]]
                tired = rules.category_fatigue ** seen.get(category[k], 0) if rules.category_fatigue < 1 else 1
                ranked.append((-(s[k] * rules.fatigue ** at[lane] * tired), lane, k))
        ranked.sort()
        _, lane, k = next((x for x in ranked if allowed(x[2])), ranked[0])
        out.append(k)
        at[lane] += 1
        seen[category[k]] = seen.get(category[k], 0) + 1
    return out


TAIL_LOT = 100_000  # keys of the tail are about as many as its rows


def weave(df: DataFrame, mode: str, seed: str, limit: int = 400, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """df with place (from 1): woven picks first, then the tail spread by stride.

    keep: stores what is read several times (the scored rows, the picks) and gives it back, so that each is worked out once.
    """
    rules, limit = RULES[mode], min(WEAVE_LIMIT, max(limit, 400))
    within = Window.partitionBy("brand_slug").orderBy(F.desc("s"), "pos")
    df = df.withColumn("_lane", F.row_number().over(within)).withColumn("tone", tone_class(F.col("hex")))
    df = keep(df.select("pos", "brand_slug", "category", "tone", "s", "_lane"), "scored")
    heads = df.filter(F.col("_lane") <= limit).select("brand_slug", "category", "tone", "s", "pos")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", kind="stable").reset_index(drop=True)
        picks = weave_rows(rows, rules, limit)
        return pd.DataFrame({"pos": rows["pos"].iloc[picks].to_numpy(), "pick": range(1, len(picks) + 1)})

    # one group: at most `limit` rows of each brand, and each pick depends on all before it
    picked = keep(heads.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(run, "pos long, pick long"), "picks")
    df = df.join(picked, "pos", "left")
    left = Window.partitionBy("brand_slug")
    tail = df.filter(F.col("pick").isNull()).withColumn("_i", F.row_number().over(left.orderBy("_lane")) - 1).withColumn("_n", F.count("*").over(left))
    whole = tail.agg(F.count("*").alias("_tail"))
    offset = rand01(seed, F.concat(F.lit("kuyruk:"), F.col("brand_slug")))
    tail = tail.crossJoin(F.broadcast(whole)).withColumn("key", (F.col("_i") + offset) * (F.col("_tail") / F.col("_n")))
    # the tail's places in two steps, counts of key ranges and then places within them, so that no task orders all of it
    lot = F.floor(F.col("key") / TAIL_LOT)
    sizes = tail.groupBy(lot.alias("_lot")).agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(F.lit(0)).orderBy("_lot").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_lot", F.coalesce(before, F.lit(0)).alias("_before"))
    tail = tail.withColumn("_lot", lot).withColumn("_in", F.row_number().over(Window.partitionBy("_lot").orderBy("key", "pos"))).join(sizes, "_lot")
    picks = picked.agg(F.count("*").alias("_picks"))
    tail = tail.crossJoin(F.broadcast(picks)).withColumn("place", F.col("_picks") + F.col("_before") + F.col("_in"))  # one row
    both = df.filter(F.col("pick").isNotNull()).select("pos", "brand_slug", "pick", F.lit(None).cast("double").alias("key"), F.col("pick").alias("place"))
    return both.unionByName(tail.select("pos", "brand_slug", "pick", "key", "place"))


def stratified(df: DataFrame, per_category: int) -> DataFrame:
    """At most per_category rows of each category, brands taking turns in the order of their first row."""
    turn = F.row_number().over(Window.partitionBy("category", "brand_slug").orderBy("pos"))
    first = F.min("pos").over(Window.partitionBy("category", "brand_slug"))
    df = df.withColumn("turn", turn).withColumn("_first", first)
    place = F.row_number().over(Window.partitionBy("category").orderBy("turn", "_first"))
    return df.withColumn("place", place).filter(F.col("place") <= per_category).drop("_first")
