"""Exact, substring and near-duplicate operators against brute force."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict
from urllib.parse import unquote, urlparse

import numpy as np
import pytest
from helpers import SCHEMA, documents, texts
from pyspark.sql import functions as F

from vitrine.llm import common
from vitrine.llm import exact_dedup as exact_module
from vitrine.llm import ngram_join as near_module
from vitrine.llm.common import packed
from vitrine.llm.components import components
from vitrine.llm.exact_dedup import drop_copies, exact_dedup
from vitrine.llm.ngram_join import full_sets, keep_one, links_between, ngram_join, shingle_sets, trees_for
from vitrine.llm.substring import LONG, FingerprintIndex, batch_bounds, remove_repeats

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    return documents(spark, tmp_path_factory.mktemp("dedup"))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return documents(spark, tmp_path_factory.mktemp("none"), [])[0]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact(docs, keep):
    df, rows = docs
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[(t or "").translate(FOLD)].append(i)
    got = exact_dedup(df, keep=keep).collect()
    assert len(got) == len(rows)
    by_hash = defaultdict(list)
    for r in got:
        by_hash[r.text_sha256].append(r)
    for text, ids in groups.items():
        found = by_hash[hashlib.sha256(text.encode()).hexdigest()]
        known = [i for i in ids if i is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        assert {r.keep_id for r in found} == {best} and {r.group_size for r in found} == {len(ids)}
        assert [r.doc_id for r in found if r.kept] == [best]


def test_drop_copies_keeps_columns(docs):
    df, rows = docs
    got = drop_copies(df)
    assert got.columns == SCHEMA.names
    assert Counter((r.text or "").translate(FOLD) for r in got.collect()) == dict.fromkeys({(t or "").translate(FOLD) for _, t, *_ in rows}, 1)


@pytest.fixture
def resplit(spark, monkeypatch):
    """After its first staged result a module's reads are split otherwise, as when executors come or go."""
    names = ["spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes"]

    def use(module, df):
        sizes = sorted(os.path.getsize(unquote(urlparse(f).path)) for f in df.inputFiles())
        two = str(sizes[-1] + sizes[-2])  # the two largest files in one task, the third in another

        def staged(df, name, plain=module.stage):
            out = plain(df, name)
            for key, value in zip(names, ["1", "0", two], strict=True):
                spark.conf.set(key, value)
            return out

        for key, value in zip(names, ["1", "0", str(sizes[-1])], strict=True):
            spark.conf.set(key, value)
        monkeypatch.setattr(module, "stage", staged)

    yield use
    for key in names:
        spark.conf.unset(key)


def test_rows_keep_their_number(docs, resplit):
    df, rows = docs
    resplit(exact_module, df)
    got = drop_copies(df)
    assert Counter((r.text or "").translate(FOLD) for r in got.collect()) == dict.fromkeys({(t or "").translate(FOLD) for _, t, *_ in rows}, 1)


def test_substring_rows_keep_their_number(docs, resplit):
    df, rows = docs
    resplit(exact_module, df)
    assert Counter(tuple(r) for r in remove_repeats(df).collect()) == Counter(removed(rows))


def test_near_rows_keep_their_number(docs, resplit):
    df, rows = docs
    resplit(near_module, df)
    got = Counter(tuple(r) for r in ngram_join(df).select("doc_id", "class_id", "n_links", "n_copies").collect())
    assert got == Counter(near_brute(rows))


def test_input_that_is_no_read_of_files(docs):
    df, rows = docs
    mixed = df.repartition(5)
    assert Counter(r.text for r in drop_copies(mixed).collect()).keys() == Counter(r.text for r in drop_copies(df).collect()).keys()


def test_empty_tables(empty):
    for df in (exact_dedup(empty), remove_repeats(empty), ngram_join(empty), keep_one(empty)):
        assert df.count() == 0


def removed(rows):
    """Brute force: for each row with an id, how many words go and what stays."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    first = {}
    for (i, *_), w in zip(rows, words, strict=True):
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    for (i, *_), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if i is not None and first.get(tuple(w[k : k + 13]), i) < i:
                gone[k : k + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        yield i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_substrings(docs, batches):
    df, rows = docs
    got = Counter(tuple(r) for r in remove_repeats(df, batches=batches).collect())
    assert got == Counter(removed(rows))


@pytest.mark.parametrize("arrow_rows", [300, 1000, 5000])
def test_substrings_across_batches(spark, tmp_path, arrow_rows, monkeypatch):
    """Passages that only the two rows at an edge of Arrow batches (1000 rows, amid a run of rows) share."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(15)), *[None] * 6) for i in range(2100)]
    edges = [300, 512, 600, 990, 1000, 1024, 1200, 2000]
    for edge in edges:
        for i in (edge - 1, edge + 4):
            rows[i] = (i, f"own{i} " + " ".join(f"p{edge}x{k}" for k in range(20)), *[None] * 6)
    spark.createDataFrame(rows, SCHEMA).coalesce(1).sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/docs")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, arrow_rows)
    try:
        got = remove_repeats(spark.read.schema(SCHEMA).parquet(f"{tmp_path}/docs")).collect()
    finally:
        spark.conf.set(name, before)
    assert Counter(tuple(r) for r in got) == Counter(removed(rows))
    assert {r.doc_id: r.n_removed for r in got if r.n_removed} == {e + 4: 20 for e in edges}


def test_long_texts_are_runs_of_their_own(spark, tmp_path):
    rng = random.Random(4)
    long = " ".join(f"l{rng.randrange(10**6)}" for _ in range(12_000))
    rows = [(0, "a b c", *[None] * 6), (1, long, *[None] * 6), (2, "x " + long[5000:70_000], *[None] * 6), (3, long + " end", *[None] * 6)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/docs")
    got = remove_repeats(spark.read.parquet(f"{tmp_path}/docs")).collect()
    assert Counter(tuple(r) for r in got) == Counter(removed(rows)) and len(long) > LONG


def test_kept_text(docs):
    df, _ = docs
    for r in remove_repeats(df, with_text=True).collect():
        assert (r.kept_text is None) == (r.n_removed == 0)
        assert r.kept_text is None or hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def batch_of(spark, rows):
    return spark.createDataFrame(rows, "_run long, h1 long, h2 int, lo long, hi long")


def test_index_runs_are_merged_and_compacted(spark):
    index = FingerprintIndex(spark, most_runs=2)
    assert index.merge(batch_of(spark, [(0, 1, 1, 5, 5), (0, 2, 1, 5, 7)])).collect() == [(0, 2, 1, 5)]
    got = index.merge(batch_of(spark, [(1, 1, 1, 9, 9), (1, 1, 2, 9, 9), (2, 3, 3, 10, 10)])).collect()
    assert [tuple(r) for r in got] == [(1, 1, 1, 5)]  # equal first hash alone is no match
    got = index.merge(batch_of(spark, [(3, 3, 3, 11, 11), (3, 2, 1, 11, 11)])).collect()
    assert sorted(tuple(r) for r in got) == [(3, 2, 1, 5), (3, 3, 3, 10)] and len(index.runs) == 1


def test_runs_are_joined_where_they_lie(spark):
    """A batch is dealt out once; the runs are neither dealt out nor sorted again before they are merged."""
    index = FingerprintIndex(spark, most_runs=4)
    for k in range(3):
        index.merge(batch_of(spark, [(k, h, 1, k, k) for h in range(100)]))
    plan = batch_of(spark, [(9, 1, 1, 9, 9)]).repartition(index.buckets, "h1", "h2")
    for run in index.runs:
        plan = plan.join(index.entries(run).withColumnRenamed("first", run).hint("merge"), ["h1", "h2"], "left")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("SortMergeJoin") == 3 and text.count("Exchange") == 1


def test_index_leaves_nothing_behind(spark, tmp_path):
    """No table in the catalogue, no file of a run; of a kept index the runs of its last version alone."""
    df, _ = documents(spark, tmp_path)
    before = {p for _, p in common._STAGED}
    remove_repeats(df, batches=6).collect()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("vitrine_run_")]
    assert [p.split("/")[-1].split("-")[0] for _, p in common._STAGED if p not in before and "/index-" in p] == []
    for _ in range(4):
        index = FingerprintIndex(spark, f"{tmp_path}/index", most_runs=2, buckets=2)
        remove_repeats(df, index=index).collect()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("vitrine_run_")]
    assert sorted(x for x in os.listdir(f"{tmp_path}/index") if x.startswith("vitrine_run_")) == sorted(index.runs) and len(index.runs) <= 2


def test_batches_are_cut_by_rows(spark):
    """An id far away from all others takes no batch for itself, and one that has a third of the rows leaves fewer batches."""
    ids = spark.createDataFrame([(k,) for k in [*range(600), 10**15]], "_id long")
    bounds = batch_bounds(ids, 6)
    assert len(bounds) == 5 and all(abs(b - 100 * (k + 1)) <= 2 for k, b in enumerate(bounds))
    hot = spark.createDataFrame([(k if k < 400 else 777,) for k in range(800)], "_id long")
    assert len(batch_bounds(hot, 6)) < 5 and batch_bounds(ids, 1) == [] and batch_bounds(ids.filter("false"), 6) == []


def test_index_is_kept_between_calls(spark, tmp_path):
    """Three batches of documents through an index on disk, opened anew each time, as if all came at once."""
    rows = [(i, t, *[None] * 6) for i, t in enumerate(texts())]
    whole, got = Counter(removed(rows)), Counter()
    for k in range(3):
        spark.createDataFrame(rows[60 * k : 60 * k + 60], SCHEMA).write.parquet(f"{tmp_path}/docs{k}")
        index = FingerprintIndex(spark, f"{tmp_path}/index", most_runs=2, buckets=3)
        got += Counter(tuple(r) for r in remove_repeats(spark.read.parquet(f"{tmp_path}/docs{k}"), index=index).collect())
    assert got == whole and len(index.runs) == 1 and index.buckets == 3


def near_brute(rows):
    sets = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    distinct = sorted({s for s in sets if s}, key=lambda s: sorted(s))
    links, root = Counter(), {s: s for s in distinct}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for a in range(len(distinct)):
        for b in range(a):
            x, y = distinct[a], distinct[b]
            if len(x & y) >= 0.8 * len(x | y):
                links[x] += 1
                links[y] += 1
                root[find(x)] = find(y)
    lowest = {}
    for (i, *_), s in zip(rows, sets, strict=True):
        if s and i is not None:
            lowest[find(s)] = min(lowest.get(find(s), i), i)
    copies = Counter(sets)
    for (i, *_), s in zip(rows, sets, strict=True):
        yield (i, lowest[find(s)], links[s], copies[s]) if s else (i, i, 0, 1)


def test_near(docs):
    df, rows = docs
    got = Counter(tuple(r) for r in ngram_join(df).select("doc_id", "class_id", "n_links", "n_copies").collect())
    assert got == Counter(near_brute(rows))


def test_shingles_are_told_apart_by_all_their_bits(spark):
    """Shingles whose hashes share their upper 32 bits are different ones: 9 of 11 in common is linked, 8 of 12 is not."""
    hashes = lambda *low: np.array([(7 << 32) + x for x in low], np.uint64)
    a, b, c = hashes(*range(10)), hashes(*range(1, 11)), hashes(*range(2, 12))
    assert links_between([a, b, c], None).tolist() == [[False, True, False], [True, False, True], [False, True, False]]
    text = " ".join(f"w{k}" for k in range(40))
    rows = spark.createDataFrame([(1, text)], "_row long, _text string")
    got = full_sets(packed(rows)).first()
    _, tokens = next(shingle_sets([text]))
    assert np.frombuffer(got.tokens, np.uint64).tolist() == tokens.tolist() and len(tokens) == got["size"] == 36


def test_near_large_nodes(docs):
    """With nodes of at most two sets everything goes down the trees to the last level."""
    df, rows = docs
    got = Counter(tuple(r) for r in ngram_join(df, small=2).select("doc_id", "class_id", "n_links", "n_copies").collect())
    assert got == Counter(near_brute(rows))


def test_keep_one(docs):
    df, rows = docs
    got = keep_one(df)
    assert got.columns == SCHEMA.names
    shingled = [(i, c) for i, c, *_ in near_brute(rows)]
    no_words = sum(not re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows)
    with_words = {c for (i, c), (_, t, *_) in zip(shingled, rows, strict=True) if re.findall(r"[^\x20\x09-\x0D]+", t or "")}
    assert got.count() == no_words + len(with_words)


def test_trees():
    assert trees_for(0.999, 1) == 7 and trees_for(0.999, 2) == 11 and trees_for(0.9, 2) == 4


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 90: 90, 95: 90, 100: 90, 200: 200}
    assert components(spark.createDataFrame([], "a long, b long")).filter(F.lit(True)).count() == 0
