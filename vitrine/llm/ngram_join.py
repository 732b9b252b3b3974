"""N-gram Jaccard self-join by chosen paths (operator 1).

A document is the set of its 5-word shingles (all its words as one shingle if there are fewer); two are
linked if their sets' Jaccard similarity is at least 0.8.

Documents with equal sets are one class from the start.  The sets go down random trees: at each node a
set moves on for every one of its shingles whose hash, drawn anew for the node, is below
1 / (0.8 x its size), so two linked sets share on average one child or more.  Nodes with few sets are
settled by brute force on small sketches; larger ones are split further; what is still large at the last
level stays together.  Enough trees are grown that a pair at the threshold meets with probability
`recall`.  What met is gathered into candidate clusters, and inside these every pair of sets is compared
whole, shingle by shingle, block by block, as products of membership matrices.  Blocks return links counted
per set and a spanning forest, never pairs.  Shingles are told apart by 64-bit hashes throughout: of the
million different ones that a block can hold, two are equal in about one block of 40 million.

Result: one row per document with its class, the number of links of its set to different sets, and the
number of documents with its set.

Defined results: null texts and texts without words have no shingles, no links and are classes of their
own; a null id keeps its row, and the class takes the smallest id that is not null; rows with the same id
are different documents; an empty table gives an empty table; other columns are not touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitrine.llm.common import packed, release, ship, stage, unpack
from vitrine.llm.components import components
from vitrine.llm.exact_dedup import read_of_files, with_row, without_rows
from vitrine.llm.grams import Words, mix, small_groups

SHINGLE, THRESHOLD, LEVELS = 5, 0.8, 2
BINS = 64
TILE, TILE_TOKENS = 2048, 1_000_000  # what is compared in memory at once


def trees_for(recall: float, levels: int = LEVELS) -> int:
    """How many trees let a pair at the threshold meet at the last level with probability `recall`."""
    alive = 1.0
    for _ in range(levels):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def shingle_sets(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct shingle hashes) of each text."""
    for at, group in small_groups(texts):
        words = Words(group)
        grams, valid = words.grams(SHINGLE)
        order = np.flatnonzero(valid)
        doc = words.doc[order]
        first = np.searchsorted(doc, np.arange(len(group) + 1))
        grams = grams[order]
        for k in range(len(group)):
            a, b = words.first[k], words.first[k + 1]
            if 0 < b - a < SHINGLE:
                whole = np.ones(1, np.uint64)
                for h in range(a, b):
                    whole = mix(whole * np.uint64(0xD6E8FEB86659FD93) + words.hash[h : h + 1])
                yield at + k, whole
            else:
                yield at + k, np.unique(grams[first[k] : first[k + 1]])


def chosen(tokens: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the seed, path) of the children that a set has below nodes with these seeds."""
    below = np.uint64(min(2**64 - 1, int(2**64 / (THRESHOLD * len(tokens)))))
    at, paths = [], []
    for k in range(0, len(seeds), 16):
        some = seeds[k : k + 16] | np.uint64(1)
        hit, token = np.nonzero(tokens[None, :] * some[:, None] <= below)
        at.append(hit + k)
        paths.append(mix(tokens[token] + mix(some[hit])))
    return np.concatenate(at), np.concatenate(paths)


SEEDS = mix(np.arange(1, 1025, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def first_level(docs: DataFrame, trees: int) -> DataFrame:
    """(_row, _id, size, k1, k2, paths): each set's size, its 128-bit key and its nodes below the roots."""

    def run(batches):
        seeds = SEEDS[:trees]
        for whole in batches:
            for lot in (whole.slice(at, 512) for at in range(0, whole.num_rows, 512)):
                size, k1, k2, paths = [], [], [], []
                for _, tokens in shingle_sets(lot.column(2).to_pylist()):
                    size.append(len(tokens))
                    k1.append(tokens.sum(dtype=np.uint64))
                    k2.append(mix(tokens + np.uint64(77)).sum(dtype=np.uint64))
                    paths.append(chosen(tokens, seeds)[1].view(np.int64) if len(tokens) else np.zeros(0, np.int64))
                ends = np.cumsum([0, *map(len, paths)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        lot.column(0), lot.column(1), pa.array(size, pa.int64()),
                        pa.array(np.array(k1, np.uint64).view(np.int64)), pa.array(np.array(k2, np.uint64).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *paths]))),
                    ],
                    names=["_row", "_id", "size", "k1", "k2", "paths"],
                )

    return docs.select("_row", "_id", "_text").mapInArrow(run, "_row long, _id long, size long, k1 long, k2 long, paths array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """(_row, size, tokens, sketch): sets as sorted 64-bit hashes, and the least hash in each of 64 bins as a byte (0: none)."""

    def run(batches):
        for whole in batches:
            for lot in (whole.slice(at, 512) for at in range(0, whole.num_rows, 512)):
                size, sets, sketches = [], [], []
                for _, tokens in shingle_sets(unpack(lot.column(1).to_pylist())):
                    bins = (tokens >> np.uint64(58)).astype(np.uint8)
                    lead = np.append(True, bins[1:] != bins[:-1])[: len(bins)]
                    sketch = np.zeros(BINS, np.uint8)
                    sketch[bins[lead]] = mix(tokens[lead]) % np.uint64(255) + np.uint64(1)
                    size.append(len(tokens))
                    sets.append(tokens.tobytes())
                    sketches.append(sketch.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [lot.column(0), pa.array(size, pa.int64()), pa.array(sets, pa.binary()), pa.array(sketches, pa.binary())],
                    names=["_row", "size", "tokens", "sketch"],
                )

    return docs.select("_row", "_text").mapInArrow(run, "_row long, size long, tokens binary, sketch binary")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, group bounds) such that no group is divided; the rows come sorted by the keys."""
    kept: list[pa.RecordBatch] = []

    def bounds(rows: pa.Table) -> np.ndarray:
        new = np.zeros(rows.num_rows, bool)
        new[:1] = True
        for k in keys:
            col = rows.column(k).to_numpy()
            new[1:] |= col[1:] != col[:-1]
        return np.append(np.flatnonzero(new), rows.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        rows = pa.Table.from_batches(kept)
        edge = bounds(rows)
        cut = int(edge[-2])
        if cut:
            yield rows.slice(0, cut), edge[:-1]
            kept = rows.slice(cut).combine_chunks().to_batches()
    if kept:
        rows = pa.Table.from_batches(kept)
        yield rows, bounds(rows)


def spread(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the edges (a, b)."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def pairs_within(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of positions in the same group."""
    size = np.diff(bounds)
    left = np.arange(bounds[-1])
    rest = np.repeat(bounds[1:], size) - left - 1
    a = np.repeat(left, rest)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(rest) - rest, rest)
    return a, b


def settle(batches):
    """Brute force on sketches in small nodes: edges (a, b) that join what may be linked."""
    for rows, edge in whole_groups(batches, ["path"]):
        row = rows.column("_row").to_numpy()
        size = rows.column("size").to_numpy()
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
        out_a, out_b = [], []
        # a few groups at a time, so that pairs stay few
        cost = np.cumsum(np.diff(edge) ** 2)
        at = 0
        while at < len(cost):
            stop = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + 200_000, "right")))
            base = edge[at]
            a, b = pairs_within(edge[at : stop + 1] - base)
            a, b = a + base, b + base
            ok = 5 * np.minimum(size[a], size[b]) >= 4 * np.maximum(size[a], size[b])
            a, b = a[ok], b[ok]
            equal = ((sketch[a] == sketch[b]) & (sketch[a] != 0)).sum(1)
            used = ((sketch[a] | sketch[b]) != 0).sum(1)
            ok = equal >= used * (THRESHOLD - 5 * np.sqrt(0.16 / np.maximum(used, 1)))
            label = spread(a[ok] - base, b[ok] - base, int(edge[stop] - base)) + base
            moved = np.flatnonzero(label[: edge[stop] - base] != np.arange(base, edge[stop])) + base
            out_a.append(row[moved])
            out_b.append(row[label[moved - base]])
            at = stop
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])


def children(batches):
    """The nodes of the next level for sets in nodes that are too large."""
    for lot in batches:
        row, path = [], []
        for r, nodes, data in zip(lot.column(0).to_pylist(), lot.column(1).to_pylist(), lot.column(2).to_pylist(), strict=True):
            tokens = mix(np.frombuffer(data, np.uint64) + np.uint64(1 << 40))
            found = chosen(tokens, np.array(nodes, np.int64).view(np.uint64))[1]
            row.append(np.full(len(found), r, np.int64))
            path.append(found.view(np.int64))
        if row:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(path)), pa.array(np.concatenate(row))], names=["path", "_row"])


def links_between(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Which sets of left are linked to which of right (None: to left itself), by products of membership matrices."""
    sets = left + (right or [])
    n, m = len(left), len(sets)
    owner = np.repeat(np.arange(m), [len(x) for x in sets])
    _, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = often >= 2
    number = np.cumsum(common) - 1
    keep = common[token]
    owner, token = owner[keep], number[token[keep]]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    both = np.zeros((n, m - n if right else n), np.float32)
    width = max(256, min(4096, 2_000_000 // m))
    for c in range(0, int(common.sum()), width):
        lo, hi = np.searchsorted(token, [c, c + width])
        has = np.zeros((m, width), np.float32)
        has[owner[lo:hi], token[lo:hi] - c] = 1
        both += has[:n] @ (has[n:] if right else has).T
    size = np.array([len(x) for x in sets], np.float32)
    linked = both * 9 >= 4 * (size[:n, None] + (size[n:] if right else size)[None, :])  # both / (sum - both) >= 0.8
    if not right:
        np.fill_diagonal(linked, False)
    return linked


def tiles(members: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """members in parts of at most TILE sets and TILE_TOKENS tokens (or one set)."""
    many = np.maximum(np.arange(len(members)) // TILE, (np.cumsum(size[members]) - 1) // TILE_TOKENS)
    return np.split(members, np.flatnonzero(np.diff(many)) + 1)


def compare(batches):
    """Exact links in a block or between two blocks, tile by tile: (_row, links, to), to: the smallest position it reaches there."""
    for rows, edge in whole_groups(batches, ["cluster", "i", "j"]):
        row, size = rows.column("_row").to_numpy(), rows.column("size").to_numpy()
        block, i, j = (rows.column(c).to_numpy() for c in ("block", "i", "j"))
        tokens = rows.column("tokens")
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            sets = [np.frombuffer(x, np.uint64) for x in tokens.slice(a, b - a).to_pylist()]
            parts = tiles(np.flatnonzero(block[a:b] == i[a]), size[a:b])
            others = None if i[a] == j[a] else tiles(np.flatnonzero(block[a:b] == j[a]), size[a:b])
            out = []
            for k, left in enumerate(parts):
                for right in [None, *parts[k + 1 :]] if others is None else others:
                    mine, theirs = [sets[x] for x in left], None if right is None else [sets[x] for x in right]
                    x, y = np.nonzero(links_between(mine, theirs))
                    x, y = left[x], (left if right is None else right)[y]
                    links = np.bincount(x, minlength=b - a) + (0 if right is None else np.bincount(y, minlength=b - a))
                    label = spread(x, y, b - a)
                    hit = np.flatnonzero(links)
                    out.append((row[a + hit], links[hit], row[a + label[hit]]))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["_row", "links", "to"])


def stars(large: DataFrame, slice_rows: int = 1024, levels: int = 3) -> DataFrame:
    """Edges (a, b) that join all sets of a node, for nodes of any size.  large: (path, _row, n).

    A node is dealt in slices of about slice_rows sets; each slice is a star around its smallest set, and the
    smallest sets of slices are joined in the same way, so no task has more than a slice of a node.  After
    `levels` levels what is left of a node is joined as one.
    """
    cut = F.ceil(F.col("n") / slice_rows)
    level = large.select("path", F.col("_row").alias("a"), F.pmod(F.xxhash64("_row"), cut).alias("part"))
    edges = None
    for k in range(levels):
        key = ["path", "part"] if k < levels - 1 else ["path"]
        low = F.min("a").over(Window.partitionBy(*key))
        met = level.withColumn("b", low).filter("a != b").select("a", "b")
        edges = met if edges is None else edges.unionByName(met)
        heads = level.groupBy("path", "part").agg(F.min("a").alias("a"))
        level = heads.select("path", "a", F.floor(F.col("part") / slice_rows).alias("part"))
    return edges


def candidate_edges(docs: DataFrame, sets: DataFrame, nodes: DataFrame, small: int, levels: int = LEVELS) -> DataFrame:
    """Edges between sets that met in the trees.  nodes: (path, _row, n) of the first level, n >= 2 sets each."""
    edges = None
    for level in range(1, levels + 1):
        few = nodes.filter(F.col("n") <= small).join(sets.select("_row", "size", "sketch"), "_row")
        met = few.repartition("path").sortWithinPartitions("path").select("path", "_row", "size", "sketch").mapInArrow(settle, "a long, b long")
        large = nodes.filter(F.col("n") > small)
        if level == levels:
            met = met.unionByName(stars(large))
        else:
            below = large.groupBy("_row").agg(F.collect_list("path").alias("nodes"))  # at most one per tree and token
            below = below.join(sets.select("_row", "tokens"), "_row").select("_row", "nodes", "tokens")
            nodes = shared_nodes(stage(below.mapInArrow(children, "path long, _row long"), "children"))
        edges = met if edges is None else edges.unionByName(met)
    return edges


def shared_nodes(members: DataFrame) -> DataFrame:
    """(path, _row, n) of the nodes that have more than one set."""
    counts = stage(members.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "counts")
    nodes = stage(members.join(counts, "path"), "nodes")  # both sides are read plainly, so that a node with many sets is split
    release(counts)
    return nodes


def exact_links(sets: DataFrame, clusters: DataFrame, most_blocks: int = 64, large: int = 8) -> DataFrame:
    """(_row, links, to) from exact comparison inside the clusters (node, root).

    A cluster is dealt in blocks of a tile, up to most_blocks of them, then in larger blocks, of up to `large`
    tiles; so a set is copied most_blocks times at most in clusters of up to most_blocks x large tiles.
    """
    members = clusters.select(F.col("node").alias("_row"), F.col("root").alias("cluster")).join(sets.select("_row", "size", "tokens"), "_row")
    sizes = clusters.select(F.col("node").alias("_row"), F.col("root").alias("cluster")).join(sets.select("_row", "size"), "_row")
    sizes = sizes.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("t"))
    parts = F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("t") / TILE_TOKENS))
    blocks = stage(sizes.select("cluster", F.least(parts, F.greatest(F.lit(most_blocks), F.ceil(parts / large))).cast("int").alias("blocks")), "blocks")
    dealt = members.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("_row"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.select("cluster", "_row", "size", "tokens", "block", other.alias("other"))
    dealt = dealt.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "_row", "size", "block", "tokens")
    keys = ["cluster", "i", "j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "_row long, links long, to long")


def ngram_join(docs: DataFrame, recall: float = 0.999, small: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: _row, id, class_id, class_row, n_links, n_copies.

    class_id: the smallest id of the class; class_row: the row of the document that stands for it.
    _row as in with_row().  Ids are integers.
    """
    ship(docs.sparkSession)
    rows = with_row(read_of_files(docs), F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    first = stage(first_level(rows, trees_for(recall)), "first_level")  # a set's nodes are different, as its shingles are
    key = ["k1", "k2", "size"]
    best = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    some = first.filter("size > 0")
    heads = stage(some.groupBy(*key).agg(F.min(best).alias("h"), F.count(F.lit(1)).alias("copies")), "heads")
    heads = heads.select(*key, F.col("h.row").alias("head"), F.col("h.id").alias("head_id"), "copies")
    members = first.join(heads.select(F.col("head").alias("_row")), "_row").select(F.explode("paths").alias("path"), "_row")
    nodes = shared_nodes(members)
    wanted = nodes.select("_row").distinct()
    sets = stage(full_sets(packed(rows).join(wanted, "_row")), "sets")
    clusters = stage(components(candidate_edges(rows, sets, nodes, small)), "clusters")
    found = stage(exact_links(sets, clusters), "links")
    release(sets, nodes, clusters)
    links = found.groupBy("_row").agg(F.sum("links").alias("n_links"))
    classes = components(found.select(F.col("_row").alias("a"), F.col("to").alias("b")))
    named = heads.join(classes.withColumnRenamed("node", "head"), "head", "left").withColumn("root", F.coalesce("root", "head"))
    named = stage(named.join(links.withColumnRenamed("_row", "head"), "head", "left"), "named")
    rank = F.struct(F.col("head_id").isNull().alias("none"), F.col("head_id").alias("id"), F.col("head").alias("row"))
    roots = named.groupBy("root").agg(F.min(rank).alias("r")).select("root", F.col("r.id").alias("class_id"), F.col("r.row").alias("class_row"))
    by_key = named.join(roots, "root").select(*key, "class_id", "class_row", F.coalesce("n_links", F.lit(0)).alias("n_links"), "copies")
    out = first.select("_row", "_id", *key).join(by_key, key, "left")
    return out.select(
        "_row",
        F.col("_id").alias(id_col),
        F.when(F.col("size") > 0, F.col("class_id")).otherwise(F.col("_id")).alias("class_id"),
        F.coalesce("class_row", "_row").alias("class_row"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each class; the columns stay as they are."""
    docs = read_of_files(docs)
    gone = ngram_join(docs, id_col=id_col, text_col=text_col).filter("class_row != _row").select("_row")
    return without_rows(docs, gone)
