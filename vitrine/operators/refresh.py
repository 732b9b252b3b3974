"""Refreshing stores in lots, oldest first, until the time is up; the next run goes on where this one stopped."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.sources.runs import KeyedTable

PLAN = "slug string, lane int, place long"
LOTS = f"{PLAN}, lot long"


def _kept(spark, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def queue(plan: DataFrame, path: str, lot: int = 20) -> int:
    """Write the plan (slug, lane, place) as numbered lots in the order in which they are due, after those queued before; returns their number."""
    have = _kept(plan.sparkSession, path, LOTS)
    start = 0 if have is None else (have.agg(F.max("lot")).first()[0] + 1)
    number, written = F.lit(None).cast("long"), 0
    for lane, n in plan.groupBy("lane").agg(F.max("place").alias("n")).orderBy("lane").collect():  # a row a lane
        number = F.when(F.col("lane") == lane, start + written + F.floor((F.col("place") - 1) / lot)).otherwise(number)
        written += -(-n // lot)
    lots = plan.select("slug", F.col("lane").cast("int").alias("lane"), F.col("place").cast("long").alias("place"), number.cast("long").alias("lot"))
    lots.repartitionByRange("lot").sortWithinPartitions("lot").write.mode("append").parquet(path)
    return written


def refresh(
    spark, lots: str, checkpoint: str, state: KeyedTable, work: Callable[[DataFrame], DataFrame], budget: float, clock: Callable[[], float] = time.monotonic, at_once: int = 1
) -> bool:
    """Work through the queued lots, and whether all are done.

    lots: what queue() wrote.  work: lots (slug, lane, place) to the state's rows of their stores.  Lots are done when
    the state has them; its last number less what `checkpoint` says it was before the first lot tells where to go on.
    Before a lot of the slow lane (1 or more) the clock is looked at: once `budget` is spent the run ends, the lot
    stays, and another run with the same checkpoint begins with it.

    at_once: so many lots may be worked on together: fast ones always; of slow ones, after a first, as many as the time
    that is left has room for at the pace of those before, one at least.
    """
    started = clock()
    queued = _kept(spark, lots, LOTS)
    if _kept(spark, checkpoint, "before long") is None:
        spark.createDataFrame([(state.manifest()["last"],)], "before long").coalesce(1).write.parquet(checkpoint)
    offset = _kept(spark, checkpoint, "before long").first()[0] + 1
    last = queued.agg(F.max("lot")).first()[0]
    following, slow_done, slow_time = state.manifest()["last"] + 1 - offset, 0, 0.0
    while last is not None and following <= last:
        ahead = queued.filter(F.col("lot").between(following, following + at_once - 1))
        slow, turn = ahead.agg(
            F.max(F.when(F.col("lot") == following, F.col("lane"))).alias("lane"), F.struct(F.min(F.when(F.col("lane") == 0, F.col("lot"))).alias("fast"), F.min(F.when(F.col("lane") > 0, F.col("lot"))).alias("slow"))
        ).first()
        left = budget - (clock() - started)
        if slow and left < 0:
            return False
        pace = slow_time / slow_done if slow_done else None
        many = at_once if not slow else 1 if pace is None else at_once if pace <= 0 else max(1, int(min(at_once, left / pace)))
        other = turn.fast if slow else turn.slow  # lots of the other kind wait
        until = min(following + many - 1, last, following + at_once - 1 if other is None or other < following else other - 1)
        mine = queued.filter(F.col("lot").between(following, until))
        since = clock()
        state.append(work(mine.select("slug", "lane", "place")), offset + until)
        if slow:
            slow_done, slow_time = slow_done + until - following + 1, slow_time + clock() - since
        following = until + 1
    return True
