"""Ranked lexical search over document-sharded postings (operator 12).

Index: each task cuts its documents into shards (at most SHARD_DOCS documents, closed at SHARD_TERMS terms) and writes
a shard as a sparse matrix in rows: per term the places of its documents and their integer impacts, which hold
everything of a posting's contribution but the term's weight.  The row pointers are the lengths of these rows.  A
document's place is its rank by identifier, so equal scores are ranked by place.  The counts that impacts depend on
(documents with a term, terms in all) come from a pass before.

Search: the distinct terms of the items meet the postings by term; each shard then adds weight times impact, one term
at a time, into a dense accumulator per item, and selects its best k: argpartition finds the k-th score, everything
above it is taken, and of those equal to it the first by place.  The best k of all shards are merged by rank, cut in
each task before the shuffle.  Items are dealt to blocks, a block's terms and one shard's postings meet in a task.

Defined results: null and empty texts have no terms, are never found and, as items, find nothing; equal scores go by
ascending identifier, a null identifier last; repeated rows are documents of their own; items are told apart by
identifier and text, so a repeated item is ranked once; very long texts are counted whole, a shard of their own if
need be; an empty table gives an empty result; other columns, whatever their names, are not touched.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitrine.llm.common import ship, stage
from vitrine.llm.exact_dedup import LOWER, UPPER, ascii_lower

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K = 20
SHARD_DOCS, SHARD_TERMS = 32768, 2_000_000
BLOCK_ITEMS = 256
BROADCAST_TERMS = 131_072  # (item, term) pairs up to which the items' terms are broadcast
OUT_ROWS, OUT_BYTES = 4096, 4 << 20  # of an Arrow batch of postings
SCALE, LENGTH = 1_000_000_000, 12
SHORT = 25  # of 100: the part of a document's length that counts in its impacts


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(TERM), F.lit(0))


def totals(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """(documents with a term, terms in all)."""
    n = F.regexp_count(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(TERM))
    got = docs.select(n.cast("long").alias("n")).agg(F.sum((F.col("n") > 0).cast("long")).alias("docs"), F.sum("n").alias("terms")).first()
    return got.docs or 0, got.terms or 0


class _Shard:
    """Documents gathered for one shard."""

    def __init__(self) -> None:
        self.vocab: defaultdict[str, int] = defaultdict(count().__next__)  # numbers by first appearance
        self.ids: list = []
        self.keys: list[np.ndarray] = []  # of each document: its terms' numbers
        self.size = 0

    def add(self, doc_id, terms: list[str]) -> None:
        self.keys.append(np.fromiter(map(self.vocab.__getitem__, terms), np.int64, len(terms)))
        self.ids.append(doc_id)
        self.size += len(terms)

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.size >= SHARD_TERMS

    def close(self, shard: int, n_docs: int, n_terms: int, id_type: pa.DataType, names: list[str]) -> Iterator[pa.RecordBatch]:
        """The shard's rows: one with its identifiers, then one a term, in order of the terms."""
        order = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, self.ids[k]))
        lengths = np.array([len(self.keys[k]) for k in order], np.int64)
        mean = 100 - SHORT + (SHORT * lengths * n_docs) // n_terms
        words = sorted(self.vocab)
        rank = np.empty(len(words), np.int64)
        rank[[self.vocab[w] for w in words]] = np.arange(len(words))
        place = np.repeat(np.arange(len(order), dtype=np.int64), lengths)
        pairs, tf = np.unique(rank[np.concatenate([self.keys[k] for k in order])] << 32 | place, return_counts=True)
        docs = (pairs & 0xFFFFFFFF).astype(np.int32)
        impacts = ((SCALE * tf) // (1000 * tf + LENGTH * mean[docs])).astype(np.int32)
        starts = np.searchsorted(pairs >> 32, np.arange(len(words) + 1))
        yield self._batch(shard, [None], [0], None, None, [[self.ids[k] for k in order]], id_type, names)
        at = 0
        while at < len(words):
            end = min(at + OUT_ROWS, len(words), max(at + 1, int(np.searchsorted(starts, starts[at] + OUT_BYTES // 8, "right")) - 1))
            df, cut = np.diff(starts[at : end + 1]), slice(starts[at], starts[end])
            yield self._batch(shard, words[at:end], df, docs[cut], impacts[cut], [None] * (end - at), id_type, names)
            at = end

    @staticmethod
    def _batch(shard, terms, df, docs, impacts, ids, id_type, names) -> pa.RecordBatch:
        ends = pa.py_buffer(np.r_[0, np.cumsum(df) * 4].astype(np.int32))
        packed = [
            pa.nulls(len(terms), pa.binary()) if x is None else pa.Array.from_buffers(pa.binary(), len(terms), [None, ends, pa.py_buffer(x)])
            for x in (docs, impacts)
        ]
        cols = [pa.array([shard] * len(terms), pa.int64()), pa.array(terms, pa.string()), pa.array(df, pa.int64()), *packed]
        return pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.list_(id_type))], names=names)


class LexicalIndex:
    """A staged index: postings (shard, term, df, docs, impacts), one row a shard and term, and each shard's identifiers.

    docs and impacts are packed 32-bit integers, little-endian.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        self.id_col = id_col
        self.n_docs, self.n_terms = n_docs, n_terms = totals(docs, text_col)
        src = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
        self.id_kind = kind = dict(src.dtypes)["_id"]
        names = ["shard", "term", "df", "docs", "impacts", "ids"]
        upper = str.maketrans(UPPER, LOWER)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find, shard, made, id_type = re.compile(TERM).findall, _Shard(), TaskContext.get().partitionId() << 32, pa.null()
            for batch in batches:
                id_type = batch.column(0).type
                for k, text in enumerate(batch.column(1)):
                    text = text.as_py()
                    terms = find(text.lower() if text.isascii() else text.translate(upper)) if text else ()
                    if terms:
                        shard.add(batch.column(0)[k].as_py(), terms)
                        if shard.full():
                            yield from shard.close(made, n_docs, n_terms, id_type, names)
                            shard, made = _Shard(), made + 1
            if shard.ids:
                yield from shard.close(made, n_docs, n_terms, id_type, names)

        ship(docs.sparkSession)
        ddl = f"shard long, term string, df long, docs binary, impacts binary, ids array<{kind}>"
        self.rows = stage(src.mapInArrow(run, ddl), "postings")

    def weights(self, terms: DataFrame) -> DataFrame:
        """(term, weight) of those of the terms that the index holds; terms: (term), each once."""
        df = self.rows.filter("term is not null").select("term", "df").join(terms, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
        weight = F.floor(1000 * F.log(F.lit(2 * self.n_docs + 2).cast("double") / (2 * F.col("df") + 1)))
        return df.select("term", weight.cast("long").alias("weight"))

    def search(self, items: DataFrame, item_col: str = "item_id", text_col: str = "text", k: int = K) -> DataFrame:
        """(item_col, rank, id, score): each item's k best documents with a score above 0."""
        asked = items.select(F.col(f"`{item_col}`").alias("_item"), F.col(f"`{text_col}`").alias("_text")).distinct()
        asked = stage(asked.withColumn("_asked", F.monotonically_increasing_id()), "items")
        pairs = asked.select("_asked", F.explode(terms_of(F.col("_text"))).alias("term")).groupBy("_asked", "term").agg(F.count(F.lit(1)).alias("times"))
        pairs = stage(pairs, "item-terms")
        found = self.weights(pairs.select("term").distinct()).filter("weight > 0")
        n_pairs, blocks = pairs.count(), -(-max(1, asked.count()) // BLOCK_ITEMS)
        wanted = F.collect_list(F.struct("_asked", (F.col("times") * F.col("weight")).alias("w")))
        block = F.pmod(F.xxhash64("_asked"), F.lit(blocks)).alias("block")
        wanted = pairs.join(found, "term").groupBy("term", block).agg(wanted.alias("wanted"))
        wanted = stage(wanted.select("term", "block", F.col("wanted._asked").alias("asked"), F.col("wanted.w").alias("w")), "wanted")
        postings = self.rows.filter("term is not null").drop("df", "ids")
        met = postings.join(F.broadcast(wanted) if n_pairs <= BROADCAST_TERMS else wanted, "term")
        met = met.select("shard", "block", "docs", "impacts", "asked", "w", F.lit(None).cast(f"array<{self.id_kind}>").alias("ids"))
        none = [F.lit(None).cast(t).alias(n) for n, t in met.dtypes[2:6]]
        names = self.rows.filter("term is null").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), *none, "ids")
        best = (
            met.unionByName(names)
            .groupBy("shard", "block")
            .applyInArrow(lambda rows: best_of_shard(rows, k), f"_asked long, doc {self.id_kind}, score long")
        )
        order = Window.partitionBy("_asked").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
        ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return ranked.join(asked.drop("_text"), "_asked").select(F.col("_item").alias(item_col), "rank", F.col("doc").alias(self.id_col), "score")


def top_places(score: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest scores above 0, of equal ones the first places."""
    if len(score) > k:
        least = score[np.argpartition(score, len(score) - k)[len(score) - k]]
        above = np.flatnonzero(score > least)
        ties = np.flatnonzero(score == least)[: k - len(above)]
        places = np.concatenate([above, ties])
    else:
        places = np.arange(len(score))
    return places[score[places] > 0]


def best_of_shard(rows: pa.Table, k: int) -> pa.Table:
    """One shard and one block of items: each item's best documents of the shard."""
    ids, docs, impacts, asked, weights = None, [], [], [], []
    for batch in rows.select(["ids", "docs", "impacts", "asked", "w"]).to_batches():
        for at in range(batch.num_rows):
            if batch.column(0)[at].is_valid:
                ids = batch.column(0)[at].values
            else:
                docs.append(np.frombuffer(batch.column(1)[at].as_py(), "<i4"))
                impacts.append(np.frombuffer(batch.column(2)[at].as_py(), "<i4").astype(np.int64))
                asked.append(batch.column(3)[at].values.to_numpy())
                weights.append(batch.column(4)[at].values.to_numpy())
    schema = pa.schema([("_asked", pa.int64()), ("doc", ids.type), ("score", pa.int64())])
    if not docs:
        return schema.empty_table()
    term = np.repeat(np.arange(len(docs)), [len(x) for x in asked])
    item, weight = np.concatenate(asked), np.concatenate(weights)
    order = np.argsort(item, kind="stable")
    item, weight, term = item[order], weight[order], term[order]
    starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
    score = np.zeros(len(ids), np.int64)
    out_item, out_place, out_score = [], [], []
    for a, b in zip(starts, [*starts[1:], len(item)], strict=True):
        score[:] = 0
        for t, w in zip(term[a:b].tolist(), weight[a:b].tolist(), strict=True):
            score[docs[t]] += w * impacts[t]
        places = top_places(score, k)
        out_item.append(np.full(len(places), item[a]))
        out_place.append(places)
        out_score.append(score[places])
    places = np.concatenate(out_place)
    return pa.Table.from_arrays([pa.array(np.concatenate(out_item), pa.int64()), ids.take(pa.array(places)), pa.array(np.concatenate(out_score), pa.int64())], schema=schema)


def lexical_search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """Each item's k best documents: item_id, rank, doc_id, score."""
    return LexicalIndex(docs).search(items, k=k)
