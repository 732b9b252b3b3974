"""The pipeline's stages: what they keep and what their decisions change."""

import random

from helpers import SCHEMA, documents
from pyspark.sql import functions as F

import corpus_pipeline
from vitrine.llm import common
from vitrine.llm.common import stage
from vitrine.llm.langid import Model, training_text


def test_stages(spark, tmp_path):
    df, rows = documents(spark, tmp_path)
    counts = [len(rows)]
    docs = df
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, str(tmp_path)), name)
        assert docs.columns == SCHEMA.names
        counts.append(docs.count())
    model = Model(training_text(df, F.lit(True)))
    kept = [t for _, t, *_ in rows if model.predict(t)[2]]
    fold = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    assert counts[1] == len(kept) < counts[0] and counts[2] == len(set(map(fold, kept))) and counts[3] < counts[2] and counts[4] == counts[3]
    assert not [r for r in docs.collect() if "a@b.co" in r.text] and any("[EMAIL]" in r.text for r in docs.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}


def test_run(spark, tmp_path):
    documents(spark, tmp_path)
    (tmp_path / "docs.parquet").rename(tmp_path / "documents.parquet")
    before = len(common._STAGED)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    left = [path for _, path in common._STAGED[before:]]
    assert not [x for x in left if "/language_id-" in x or "/exact_dedup-" in x or "/ngram_join-" in x] and [x for x in left if "/pii-" in x]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "pii", "packing"]


def language_rows():
    """Two languages of their own sounds, one row without a language, and letters at random."""
    rng = random.Random(6)
    say = lambda sounds, n: " ".join("".join(rng.choice(sounds) for _ in range(rng.randint(1, 4))) for _ in range(n))
    sounds = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ung", "keit", "ver"]}
    rows = [(i, say(sounds[k], 80), k, "s", 1, None, None, None) for i in range(60) for k in [list(sounds)[i % 2]]]
    rows.append((100, say(sounds["bb"], 50), None, "s", 1, None, None, None))
    rows.append((101, "".join(rng.choice("abcdefghijlnopqwxyz") for _ in range(400)), None, "s", 1, None, None, None))
    return rows


def test_language_stage_follows_the_parse(spark, tmp_path, monkeypatch):
    """Letters at random go, a null language is filled in, and another prediction changes what comes out."""
    df, rows = documents(spark, tmp_path, language_rows())
    got = {r.doc_id: r for r in corpus_pipeline.language_id(spark, df, str(tmp_path)).collect()}
    assert set(got) == {i for i, *_ in rows} - {101} and got[100].lang == "bb" and all(got[i].lang == k for i, _, k, *_ in rows if k and i != 101)
    swapped = corpus_pipeline.training_text(df.replace({"aa": "bb", "bb": "aa"}, subset=["lang"]), F.lit(True))
    monkeypatch.setattr(corpus_pipeline, "training_text", lambda docs, usable: swapped)
    assert {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, df, str(tmp_path)).collect()}[100] == "aa"
    only = {"aa": swapped["bb"]}
    monkeypatch.setattr(corpus_pipeline, "training_text", lambda docs, usable: only)
    assert corpus_pipeline.language_id(spark, df, str(tmp_path)).count() < len(got)


def test_long_text_and_clashing_names(spark, tmp_path):
    """A text of 20,000 words, and columns called as the stages call theirs, come through as they were."""
    rng = random.Random(11)
    long = " ".join("".join(rng.choice(["ka", "to", "mi", "ru"]) for _ in range(rng.randint(1, 4))) for _ in range(20_000))
    names = ["_doc", "_text", "_id", "_run", "_t", "_sha", "_lang", "_media", "_piece"]
    rows = [(i, t, "aa", "s", len(t), *(f"{n}{i}" for n in names)) for i, t in enumerate([long, long + " tail", long[:4000], long[4000:9000] + " mail a@b.co", long[9000:9900]])]
    kinds = ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"{n} string" for n in names)])
    spark.createDataFrame(rows, kinds).repartition(2).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, str(tmp_path)), name)
    got = {r.doc_id: r for r in docs.collect()}
    assert set(got) == {0, 2, 3, 4} and got[0].text == long and got[3].text.endswith(" mail [EMAIL]") and got[3].n_chars == len(got[3].text)
    assert all(got[i][n] == f"{n}{i}" for i in got for n in names)


def test_empty_table(spark, tmp_path):
    documents(spark, tmp_path, [])
    (tmp_path / "docs.parquet").rename(tmp_path / "documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
