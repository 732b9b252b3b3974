"""Best-fit packing by linear grouping (operator 6).

Documents become token pieces of at most `capacity` (mapInArrow around the tokenizer).  What
the packing decides on is the histogram of piece lengths: at most `capacity` numbers, whatever the size
of the corpus.  On it the driver

1. groups the large lengths into groups of equal cardinality and rounds each up to its group's largest,
2. finds configurations of the few rounded sizes, each used as often as the counts allow,
3. substitutes actual lengths, taken in descending order within each group,
4. puts the small lengths into the room that is left, best fit, and what remains into new sequences.

The outcome is a table of classes: so many sequences with the same list of lengths.  Its size depends on
the number of lengths and groups alone.  Pieces are numbered within their length on the cluster (counts
by length and bucket, then row numbers within these) and find class, sequence and offset by that number,
so a length that a third of all pieces have is spread over many tasks.  The classes reach the pieces by
range: a cell (length and bucket) gets those that its numbers meet, and is joined to its pieces by key.

Defined results: a null or empty text is one piece holding the end token alone; repeated rows are packed
one by one; rows with a null identifier are packed as any other; an empty table gives an empty table;
other columns are not touched.
"""

from __future__ import annotations

import base64
import bisect
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitrine.llm.common import map_texts, stage
from vitrine.llm.exact_dedup import read_of_files

Config = tuple[int, ...]
OUTSIDE = re.compile("[^\\x00-\u024f\u2000-\u206f]")


def default_tokenizer() -> tuple[str, str]:
    """The tokenizer's file and the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class TokenIds:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    Both libraries split and merge alike; the one that works on ranks is several times as fast.  Texts
    with a special token's string, or with characters outside the Latin blocks and general punctuation, whose
    classes could differ between the libraries' Unicode versions, go to the tokenizer itself.
    """

    def __init__(self, tokenizer: str, ranks: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            by_bytes = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=by_bytes, special_tokens={})

    def __call__(self, text: str | None) -> bytes:
        text = text or ""
        if not any(s in text for s in self.special) and (text.isascii() or not OUTSIDE.search(text)):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
            except ValueError:  # its pattern matcher has a stack, which a run of about a million spaces overflows
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_TOKENS: dict[tuple[str, str], TokenIds] = {}


def token_ids(paths: tuple[str, str]) -> TokenIds:
    if paths not in _TOKENS:
        _TOKENS[paths] = TokenIds(*paths)
    return _TOKENS[paths]


PIECE = pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def token_pieces(
    docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, piece, start, length, ids_crc32: the pieces of each document.

    A document of more than `capacity` tokens is cut into pieces of `capacity`; the first one takes the remainder.
    """
    paths = tokenizer or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()

    def make():
        tokens = token_ids(paths)

        def run(texts):
            out = []
            for text in texts:
                ids = tokens(text) + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                out.append([
                    {"piece": k, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[4 * a : 4 * b])}
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))
                ])
            return {"p": out}

        return run

    kind = "array<struct<piece:int,start:long,length:long,ids_crc32:long>>"
    return map_texts(docs, make, [("p", kind, pa.list_(PIECE))], id_col, text_col).select(id_col, F.inline("p"))


def _fill(sizes: list[int], left: dict[int, int], room: int) -> Config:
    """The multiset of sizes, at most left[s] of each, with the largest sum up to room (bounded knapsack over bits)."""
    reach, steps = 1, []
    limit = (1 << (room + 1)) - 1
    for s in sizes:
        if s > room:
            continue
        n = min(left[s], room // s)
        before = reach
        for _ in range(n):
            grown = (reach | reach << s) & limit
            if grown == reach:
                break
            reach = grown
        steps.append((s, n, before))
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for s, n, before in reversed(steps):
        k = next(k for k in range(n + 1) if total >= k * s and before >> (total - k * s) & 1)
        chosen += [s] * k
        total -= k * s
    return tuple(chosen)


def configurations(counts: dict[int, int], capacity: int) -> list[tuple[Config, int]]:
    """Configurations of the sizes and how often each is used: the largest size left, best completed, again and again."""
    left = dict(counts)
    out = []
    while left:
        top = max(left)
        left[top] -= 1
        config = (top, *_fill(sorted((s for s in left if left[s]), reverse=True), left, capacity - top))
        left[top] += 1
        need = Counter(config)
        times = min(left[s] // k for s, k in need.items())
        out.append((config, times))
        for s, k in need.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
    return out


def linear_grouping(counts: dict[int, int], capacity: int, groups: int, small: int) -> list[tuple[Config, int]]:
    """Classes (lengths, how many sequences) that hold every length of the histogram just as often as it counts."""
    large = sorted((s for s in counts if s > small), reverse=True)
    per_group = max(1, -(-sum(counts[s] for s in large) // groups))
    rounded: dict[int, int] = defaultdict(int)
    queue: dict[int, list[list[int]]] = defaultdict(list)
    size, room = 0, 0
    for s in large:
        n = counts[s]
        while n:
            if not room:
                size, room = s, per_group
            take = min(n, room)
            rounded[size] += take
            queue[size].append([s, take])
            n, room = n - take, room - take
    classes: Counter[Config] = Counter()
    for config, times in configurations(rounded, capacity):
        need = Counter(config)
        while times:
            # as many sequences as the heads of the queues hold alike, each slot of a size taking from the head
            run, actual = times, []
            for s, k in need.items():
                length, have = queue[s][0]
                if have >= k:
                    run = min(run, have // k)
                    actual += [(s, [(length, k)])]
                else:
                    run, got, parts = 1, 0, []
                    for length, have in queue[s]:
                        parts.append((length, min(have, k - got)))
                        got += parts[-1][1]
                        if got == k:
                            break
                    actual += [(s, parts)]
            for s, parts in actual:
                for length, k in parts:
                    queue[s][0][1] -= k * run
                    if not queue[s][0][1]:
                        queue[s].pop(0)
            classes[tuple(length for _, parts in actual for length, k in parts for _ in range(k))] += run
            times -= run
    # best fit of the small lengths, longest first, into the classes with the least room that is enough
    by_room: dict[int, Counter[Config]] = defaultdict(Counter)
    for config, n in classes.items():
        by_room[capacity - sum(config)][config] += n
    rooms = sorted(by_room)
    left = {s: n for s, n in sorted(counts.items(), reverse=True) if s <= small}
    for s in left:
        while left[s]:
            at = bisect.bisect_left(rooms, s)
            if at == len(rooms):
                break
            room = rooms[at]
            config, have = next(iter(by_room[room].items()))
            k = min(room // s, left[s])
            run = min(have, left[s] // k)
            by_room[room][config] -= run
            if not by_room[room][config]:
                del by_room[room][config]
                if not by_room[room]:
                    del by_room[room], rooms[at]
            left[s] -= k * run
            if room - k * s not in by_room:
                bisect.insort(rooms, room - k * s)
            by_room[room - k * s][config + (s,) * k] += run
    done: Counter[Config] = Counter()
    for found in by_room.values():
        done.update(found)
    for config, n in configurations({s: n for s, n in left.items() if n}, capacity):
        done[config] += n
    return sorted(done.items(), reverse=True)


def pack(
    pieces: DataFrame, capacity: int = 1024, groups: int = 4096, small: int = 256, buckets: int = 64, length_col: str = "length"
) -> DataFrame:
    """pieces with sequence_id and offset.  Read several times: give it a staged table.

    buckets: each length's pieces are numbered in at least so many tasks, more where there are more pieces.
    """
    spark, key = pieces.sparkSession, ["_len", "_bucket"]
    buckets = max(buckets, pieces.count() // 100_000)
    pieces = read_of_files(pieces)
    place = F.struct(pieces.metadataColumn("_metadata").getField("file_path"), pieces.metadataColumn("_metadata").getField("row_index"))
    bucket = F.pmod(F.xxhash64(place), F.lit(buckets)).cast("int").alias("_bucket")  # repeated rows are dealt over all buckets
    cells = pieces.select(F.col(length_col).cast("long").alias("_len"), bucket).groupBy("_len", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # at most capacity x buckets cells, so one window over each length's buckets is small
    before = F.sum("_n").over(Window.partitionBy("_len").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    cells = stage(cells.withColumn("_base", F.coalesce(before, F.lit(0))), "cells")
    # at most `capacity` rows
    counts = {r["_len"]: r["n"] for r in cells.groupBy("_len").agg(F.sum("_n").alias("n")).collect()}
    slots, first = [], 0
    taken: Counter[int] = Counter()
    for config, n in linear_grouping(counts, capacity, groups, small):
        offset = 0
        for length, k in sorted(Counter(config).items(), reverse=True):
            slots.append((length, taken[length], taken[length] + n * k, k, first, offset))
            taken[length] += n * k
            offset += length * k
        first += n
    # at most a few slots for each length and group, whatever the number of rows
    slots_df = spark.createDataFrame(slots, "_len long, _from long, _to long, _each long, _first long, _offset long")
    # the slots that a cell's range of numbers meets: few, as ranges of the cells of one length don't overlap
    met = cells.join(slots_df, "_len").filter((F.col("_from") < F.col("_base") + F.col("_n")) & (F.col("_to") > F.col("_base")))
    met = met.groupBy("_len", "_bucket", "_base").agg(F.sort_array(F.collect_list(F.struct("_from", "_each", "_first", "_offset"))).alias("_slots"))
    names = [F.col(f"`{c}`") for c in pieces.columns]
    numbered = pieces.select(F.struct(*names).alias("_piece"), F.col(length_col).cast("long").alias("_len"), bucket, place.alias("_place"))
    inside = F.row_number().over(Window.partitionBy(*key).orderBy("_place")) - 1
    # both sides are dealt by length and bucket, so the join moves no piece again
    placed = numbered.withColumn("_in", inside).join(met, key).withColumn("_rank", F.col("_base") + F.col("_in"))
    placed = placed.withColumn("_s", F.expr("element_at(filter(_slots, s -> s._from <= _rank), -1)"))
    inside = F.col("_rank") - F.col("_s._from")
    return placed.select(
        "_piece.*",
        (F.col("_s._first") + F.floor(inside / F.col("_s._each"))).cast("long").alias("sequence_id"),
        (F.col("_s._offset") + F.col("_len") * F.pmod(inside, F.col("_s._each"))).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(stage(token_pieces(docs, capacity, end_id, tokenizer, id_col, text_col), "pieces"), capacity)
