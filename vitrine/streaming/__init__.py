"""Event streams: landed log files to day and hour counts, votes and upserts by micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vitrine.sources import EVENT
from vitrine.sources.runs import KeyedTable

LATE = 3600  # seconds that an event may come late; what is older than that is dropped


def read_event_stream(spark: SparkSession, path: str) -> DataFrame:
    """New lines of the event logs as they land; malformed ones are dropped."""
    return spark.readStream.schema(EVENT).option("mode", "DROPMALFORMED").json(path)


def day_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events by day window and kind; a day is final once the watermark has passed it."""
    return events.withWatermark("at", late).groupBy(F.window("at", "1 day"), "kind").agg(F.count("*").alias("n"))


def session_estimates(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Distinct sessions by day, approximately, as exact sets would grow with the stream."""
    return events.withWatermark("at", late).groupBy(F.window("at", "1 day")).agg(F.approx_count_distinct("session").alias("sessions"))


def one_vote_each(votes: DataFrame, late: str = "30 days") -> DataFrame:
    """Votes (product_id, voter, at), the first of each voter for a product."""
    return votes.withWatermark("at", late).dropDuplicatesWithinWatermark(["product_id", "voter"])


def limited(events: DataFrame, seconds: int = 60) -> DataFrame:
    """(key, accepted, refused) by micro-batch: an event within `seconds` of the last accepted one of its key is refused.

    State is one time stamp per key and leaves when events are an hour past it.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        accepted = refused = 0
        times = sorted(t for b in batches for t in b["at"].astype("int64") // 10**3)
        for t in times:
            if last is None or t - last >= seconds * 10**6:
                last, accepted = t, accepted + 1
            else:
                refused += 1
        state.update((int(last),))
        state.setTimeoutTimestamp(times[-1] // 1000 + (max(3600, seconds) + LATE) * 1000)
        yield pd.DataFrame({"key": [key[0]], "accepted": [accepted], "refused": [refused]})

    return events.withWatermark("at", f"{LATE} seconds").groupBy("key").applyInPandasWithState(
        run, "key string, accepted long, refused long", "last long", "update", GroupStateTimeout.EventTimeTimeout
    )


def restock_votes(presses: DataFrame, most_voters: int = 5000, days: int = 30) -> DataFrame:
    """(product_id, votes) by micro-batch from presses (product_id, voter, at): a press votes, the next takes the vote back.

    Of each product the last `most_voters` voters are known.  A voter who drops out of these keeps having voted: the
    count stays, and another press by that voter counts as a new vote.  State is bounded by most_voters a product and
    leaves when presses are `days` past it.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        votes, known = (state.get[0], dict.fromkeys(state.get[1])) if state.exists else (0, {})
        rows = pd.concat(list(batches)).sort_values(["at", "voter"], kind="stable")
        for voter in rows["voter"].tolist():
            if voter in known:
                del known[voter]
                votes -= 1
            else:
                known[voter] = None
                votes += 1
                if len(known) > most_voters:
                    del known[next(iter(known))]
        state.update((votes, list(known)))
        state.setTimeoutTimestamp(int(rows["at"].max().timestamp() * 1000) + days * 86_400_000)
        yield pd.DataFrame({"product_id": [key[0]], "votes": [votes]})

    return presses.withWatermark("at", f"{LATE} seconds").groupBy("product_id").applyInPandasWithState(
        run, "product_id string, votes long", "votes long, voters array<string>", "update", GroupStateTimeout.EventTimeTimeout
    )


def login_guard(attempts: DataFrame, tries: int = 5, within: int = 600, lock: int = 900) -> DataFrame:
    """(key, at, verdict) of attempts (key, at, ok): "locked", "ok" or "wrong".

    `tries` wrong attempts of a key within `within` seconds lock it for `lock` seconds; a right one forgets the wrong
    ones.  State is at most `tries` time stamps a key and leaves when attempts are past the longer span.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until, wrong = (state.get[0], list(state.get[1])) if state.exists else (0, [])
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        verdicts = []
        for at, ok in zip((rows["at"].astype("datetime64[ns]").astype("int64") // 10**9).tolist(), rows["ok"].tolist(), strict=True):
            if at < until:
                verdicts.append("locked")
            elif ok:
                wrong = []
                verdicts.append("ok")
            else:
                wrong = [t for t in wrong if at - t < within][1 - tries :] + [at] if tries > 1 else [at]
                verdicts.append("wrong")
                if len(wrong) >= tries:
                    until, wrong = at + lock, []
        state.update((until, wrong))
        state.setTimeoutTimestamp(int(rows["at"].max().timestamp() * 1000) + (max(within, lock) + LATE) * 1000)
        yield pd.DataFrame({"key": key[0], "at": rows["at"].to_numpy(), "verdict": verdicts})

    return attempts.withWatermark("at", f"{LATE} seconds").groupBy("key").applyInPandasWithState(
        run, "key string, at timestamp, verdict string", "until long, wrong array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


def log_sinks(events: DataFrame, folder: str, checkpoint: str, kinds: dict[str, list[str]]):
    """Writers, one for each log (log -> kinds of event), that append events to their UTC day's folder as they come."""
    days = events.withColumn("day", F.date_format("at", "yyyy-MM-dd"))
    return [
        days.filter(F.col("kind").isin(which)).writeStream.format("json").partitionBy("day").option("path", f"{folder}/{log}").option("checkpointLocation", f"{checkpoint}/{log}")
        for log, which in kinds.items()
    ]


def upsert_batches(stream: DataFrame, table: KeyedTable, checkpoint: str, deleted: str | None = None):
    """Keep the latest row of each key in a keyed table; returns the query's writer.

    deleted: a boolean column; a key whose latest row has it set leaves the table, and may come back.  A batch writes
    itself and nothing else, and one that comes again changes nothing.
    """
    return stream.writeStream.foreachBatch(lambda batch, number: table.append(batch, number, deleted) and None).option("checkpointLocation", checkpoint)


class DeadImages(StatefulProcessor):
    """Addresses marked dead for `ttl` seconds, the last `most` of a group of addresses (None: all); asks are answered by what is known.

    State of a group: address -> (since when, turn), turn -> address, and the span of turns.  A mark that comes again
    renews its time, not its turn.  With `most` known the address of the oldest turn leaves, and an event-time timer
    takes out addresses that were not marked again when their time is up; so state is bounded in time, and in size by most.
    A batch asks the state once for each of its addresses and writes each changed one once.  A group has one timer at a
    time, for the address that is first to run out; it takes out all that have.
    """

    def __init__(self, ttl: int = 12 * 3600, most: int | None = 20_000) -> None:
        self.ttl, self.most = ttl, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getMapState("known", "url string", "at long, turn long")
        self.turns = handle.getMapState("turns", "turn long", "url string")
        self.span = handle.getValueState("span", "first long, next long, size long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(rows)).sort_values(["at", "mark", "url"], kind="stable")
        first, following, size = self.span.get() if self.span.exists() else (0, 0, 0)
        known: dict = {}  # of this batch's addresses, None: not known; written back below
        turns: dict = {}
        before: dict = {}
        asked = []

        def state_of(url):
            if url not in known:
                known[url] = before[url] = tuple(self.known.getValue((url,))) if self.known.containsKey((url,)) else None
            return known[url]

        for url, at, mark in zip(whole["url"], whole["at"].astype("datetime64[us]").astype("int64"), whole["mark"], strict=True):
            have = state_of(url)
            if have is not None and at - have[0] > self.ttl * 1_000_000:  # its timer has not fired yet
                known[url], turns[have[1]] = None, None
                size, have = size - 1, None
            if not mark:
                asked.append(have is not None)
                continue
            if have is None:
                if self.most is not None and size >= self.most:
                    while True:
                        oldest = turns[first] if first in turns else self.turns.getValue((first,))[0] if self.turns.containsKey((first,)) else None
                        if oldest is not None:
                            break
                        first += 1
                    state_of(oldest)
                    known[oldest], turns[first] = None, None
                    first, size = first + 1, size - 1
                have, following, size = (at, following), following + 1, size + 1
                turns[have[1]] = url
            known[url] = (int(at), int(have[1]))
        for url, now in known.items():
            if now is not None and now != before[url]:
                self.known.updateValue((url,), now)
            elif now is None and before[url] is not None:
                self.known.removeKey((url,))
        if self.most is not None:  # without a bound nobody's turn comes
            gone = {have[1] for have in before.values() if have is not None}
            for turn, url in turns.items():
                if url is not None:
                    self.turns.updateValue((turn,), (url,))
                elif turn in gone:
                    self.turns.removeKey((turn,))
        self.span.update((first, following, size))
        live = [now[0] for now in known.values() if now is not None]
        if live and next(iter(self.handle.listTimers()), None) is None:
            self._set_timer(min(live))
        if asked:
            asks = whole[~whole["mark"].astype(bool)]
            yield pd.DataFrame({"url": asks["url"].to_numpy(), "at": asks["at"].to_numpy(), "dead": asked})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = (max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) - self.ttl * 1000) * 1000
        first, following, size = self.span.get() if self.span.exists() else (0, 0, 0)
        gone, soonest = [], None
        for (url,), (at, turn) in self.known.iterator():
            if at < before:
                gone.append((url, turn))
            else:
                soonest = at if soonest is None else min(soonest, at)
        for url, turn in gone:
            self.known.removeKey((url,))
            if self.most is not None:
                self.turns.removeKey((turn,))
        self.span.update((first, following, max(0, size - len(gone))))
        if soonest is not None:
            self._set_timer(soonest)
        return iter([])

    def _set_timer(self, at: int) -> None:
        self.handle.registerTimer(int(at // 1000 + self.ttl * 1000 + 1))

    def close(self) -> None:
        pass


def dead_images(rows: DataFrame, ttl: int = 12 * 3600, most: int | None = 20_000, groups: int = 64, late: str = "10 minutes") -> DataFrame:
    """(url, at, dead) for asks, from rows (url, at, mark: whether it is a mark or an ask) of a stream.

    Addresses are dealt to `groups` by their hash, each of which knows most / groups of them; most None: all that are
    marked within ttl.  The state store has to be RocksDB (spark.sql.streaming.stateStore.providerClass).
    """
    dealt = rows.withWatermark("at", late).withColumn("part", F.pmod(F.xxhash64("url"), F.lit(groups)).cast("int"))
    kept = None if most is None else max(1, most // groups)
    return dealt.groupBy("part").transformWithStateInPandas(DeadImages(ttl, kept), "url string, at timestamp, dead boolean", "Append", "EventTime")
