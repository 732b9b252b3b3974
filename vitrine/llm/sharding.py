"""Sharding by fixed virtual slots (operator 11).  DataFrame functions only.

A record's identifier is hashed into one of thousands of virtual slots, whose number never changes.  Bytes are
aggregated per slot, and a versioned table says which shard each slot belongs to.  A version holds the entries that it
edits and nothing else, so any older state can be read; records move when their slot's entry is edited, and only then.

    first      version 1: slots dealt evenly, whatever they hold
    rebalance  the next version: slots go from the heaviest shard to the lightest until no move narrows the gap
    grow       the next version: one more shard, which takes slots from the heaviest shards; no other slot moves

A slot that holds too much for even shards (one identifier, or a null one, may stand in a third of all rows) is cut
into parts by the rows' places in the files; each part is an entry of its own.  Entries are bounded by the number of
slots plus PARTS for each shard, so the map fits the driver at any size of the input.

A row's place in its shard is the sum of what the blocks of rows before it put there (a block: 2**16 neighbouring rows
of a file), plus its number within its block; no shard is ever sorted as a whole.

Defined results: a null text has no bytes (its size is the 8 of the record alone, its checksum that of nothing), as an
empty one; null identifiers share a slot, which is cut when it grows too heavy; repeated rows are placed one by one;
an empty table gives an empty table; other columns, whatever their names, are not touched.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitrine.llm.common import new_path, stage
from vitrine.llm.exact_dedup import FILE_BITS, read_of_files, with_row

SLOTS, SHARDS = 6144, 24
PARTS = 16  # a shard's fair share is at least so many entries
BLOCK_BITS = 16
RECORD_BYTES = 8

Entry = tuple[int, int]  # slot and part


def slot_of(id_col: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of an identifier: of nothing but its value and the fixed number of slots."""
    return F.pmod(F.xxhash64(id_col), F.lit(slots)).cast("int")


class SlotMap:
    """A stored slot-to-shard map: one folder of edits for each version."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.latest = spark, path, 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SlotMap:
        found = cls(spark, path)
        found.latest = found.edits().agg(F.max("version")).first()[0]
        return found

    def edits(self) -> DataFrame:
        return self.spark.read.schema("slot int, part int, shard int, version int").parquet(self.path)

    def at(self, version: int | None = None) -> DataFrame:
        """(slot, part, shard, since): the map as it stood at a version; since: the version that last edited the entry."""
        known = self.edits().filter(F.col("version") <= (version or self.latest))
        last = F.max(F.struct("version", "shard"))
        return known.groupBy("slot", "part").agg(last.alias("last")).select("slot", "part", "last.shard", F.col("last.version").alias("since"))

    def entries(self) -> dict[Entry, int]:
        return {(r.slot, r.part): r.shard for r in self.at().collect()}

    def edit(self, changed: dict[Entry, int]) -> SlotMap:
        """Store the changed entries as the next version."""
        self.latest += 1
        rows = [(slot, part, shard) for (slot, part), shard in sorted(changed.items())]
        df = self.spark.createDataFrame(rows, "slot int, part int, shard int").coalesce(1)
        df.write.mode("overwrite").parquet(f"{self.path}/version={self.latest}")
        return self

    def first(self, parts: dict[int, int], slots: int = SLOTS, shards: int = SHARDS) -> SlotMap:
        """Version 1: entries dealt evenly by slot; parts: the slots that are cut, and into how many."""
        return self.edit({(s, p): (s * shards // slots + p) % shards for s in range(slots) for p in range(parts.get(s, 1))})

    def rebalance(self, load: dict[Entry, int], shards: int = SHARDS) -> SlotMap:
        """The next version: the moves that bring the shards' loads together."""
        return self.edit(balancing_moves(self.entries(), load, shards))

    def grow(self, load: dict[Entry, int], shards: int) -> SlotMap:
        """The next version: shard number `shards` is added and takes its share of slots from the others."""
        return self.edit(growing_moves(self.entries(), load, shards))


def balancing_moves(owner: dict[Entry, int], load: dict[Entry, int], shards: int) -> dict[Entry, int]:
    """Entries to move, and where: from the heaviest to the lightest shard, the entry nearest to half of the gap.

    It ends when the heaviest shard has no entry smaller than the gap; each move lowers the sum of squares.
    """
    held: dict[int, list[tuple[int, Entry]]] = defaultdict(list)
    for entry, shard in sorted(owner.items()):
        if load.get(entry):
            held[shard].append((load[entry], entry))
    total = [sum(n for n, _ in held[s]) for s in range(shards)]
    moved: dict[Entry, int] = {}
    while True:
        low, high = min(range(shards), key=lambda s: (total[s], s)), max(range(shards), key=lambda s: (total[s], -s))
        gap = total[high] - total[low]
        fits = [x for x in held[high] if x[0] < gap]
        if not fits:
            return {e: s for e, s in moved.items() if owner[e] != s}
        size, entry = best = min(fits, key=lambda x: (abs(2 * x[0] - gap), x[1]))
        held[high].remove(best)
        held[low].append(best)
        total[high], total[low] = total[high] - size, total[low] + size
        moved[entry] = low


def growing_moves(owner: dict[Entry, int], load: dict[Entry, int], shards: int) -> dict[Entry, int]:
    """Entries that the new shard takes: each time the largest one that still fits, from the heaviest shard."""
    held: dict[int, list[tuple[int, Entry]]] = defaultdict(list)
    for entry, shard in sorted(owner.items()):
        held[shard].append((load.get(entry, 0), entry))
    total = {s: sum(n for n, _ in held[s]) for s in range(shards)}
    fair, taken, moved = sum(total.values()) // (shards + 1), 0, {}
    heaviest = [(-n, s) for s, n in total.items()]
    heapq.heapify(heaviest)
    while heaviest:
        _, shard = heapq.heappop(heaviest)
        fits = [x for x in held[shard] if 0 < x[0] <= fair - taken and total[shard] - x[0] >= fair // 2]
        if fits:
            size, entry = best = max(fits)
            held[shard].remove(best)
            taken, total[shard], moved[entry] = taken + size, total[shard] - size, shards
            heapq.heappush(heaviest, (-total[shard], shard))
    return moved


class Sharding:
    """A table's rows in shards, by a stored map.

    rows: (_row, _id, size, text_crc32, slot, part), staged; map: the SlotMap, rebalanced to the rows' bytes.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, shards: int = SHARDS, path: str | None = None) -> None:
        spark = docs.sparkSession
        text = F.coalesce(F.col("_text").cast("binary"), F.lit(b""))
        rows = with_row(read_of_files(docs), F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
        rows = rows.select(
            "_row", "_id", (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), slot_of(F.col("_id"), slots).alias("slot")
        )
        rows = stage(rows, "shard-rows")
        self.id_col, self.shards = id_col, shards
        loads = {r.slot: r.n for r in rows.groupBy("slot").agg(F.sum("size").alias("n")).collect()}  # at most `slots` rows
        most = max(1, sum(loads.values()) // (shards * PARTS))
        parts = {s: -(-n // most) for s, n in loads.items() if n > most}
        cut = spark.createDataFrame(sorted(parts.items()), "slot int, parts int")
        part = F.coalesce(F.pmod(F.xxhash64("_row"), F.col("parts")), F.lit(0)).cast("int")
        self.rows = rows.join(F.broadcast(cut), "slot", "left").withColumn("part", part).drop("parts")
        self.map = SlotMap(spark, path or new_path(spark, "slot-map")).first(parts, slots, shards).rebalance(self.load(), shards)

    def load(self) -> dict[Entry, int]:
        """Bytes of each entry of the map: at most its slots and parts."""
        return {(r.slot, r.part): r.n for r in self.rows.groupBy("slot", "part").agg(F.sum("size").alias("n")).collect()}

    def assigned(self, version: int | None = None) -> DataFrame:
        """rows with shard and since; every entry of the map is broadcast, of which there are at most slots + PARTS * shards."""
        return self.rows.join(F.broadcast(self.map.at(version)), ["slot", "part"])

    def placed(self, version: int | None = None) -> DataFrame:
        """(id, size, text_crc32, shard, slot: the place in the shard, virtual_slot, part, since, _row)."""
        block = F.shiftright("_row", BLOCK_BITS)  # rows of one file, since a file's number stands above FILE_BITS
        rows = self.assigned(version).withColumn("_block", block).withColumnRenamed("slot", "virtual_slot")
        before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        counts = rows.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
        starts = counts.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
        inside = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("_row")) - 1
        rows = rows.withColumn("_inside", inside).join(starts, ["shard", "_block"])
        place = (F.col("_start") + F.col("_inside")).alias("slot")
        return rows.select(F.col("_id").alias(self.id_col), "size", "text_crc32", "shard", place, "virtual_slot", "part", "since", "_row")


assert BLOCK_BITS < FILE_BITS


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, part, since (version of its entry).

    The law is `bytes`: shards hold near equal bytes, so grown_shard is null; Sharding.map.grow() adds a shard.
    """
    placed = Sharding(docs, id_col, text_col, slots, shards).placed().drop("_row")
    law = [F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")]
    return placed.select(id_col, "size", "text_crc32", law[0], "shard", "slot", law[1], "virtual_slot", "part", "since")
