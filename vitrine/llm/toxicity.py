"""Toxicity scores (operator 8): gradient-boosted trees over dense features, with isotonic calibration.

What is learned comes from a bounded sample of labelled rows, `most_toxic` rows of label 1 and `most_clean`
of label 0 with the smallest hash of their id, in three parts: on the first a lexicon of word beginnings
is found whose density in toxic texts stands out; on the second the trees are fitted to the features,
weighted to the true share of the labels; on the third isotonic regression turns their output into a
probability.  Features of a word are packed in one integer that a bounded cache keeps, so that those of a
whole text are one sum over all its words.

Defined results: null and empty texts have all features 0 and the score that the trees give to that; if
the labelled rows don't hold both labels the score is their mean (0 without any); an id with both labels
counts as toxic; labels of unknown ids and null labels are not used; repeated rows give equal values; other columns are not touched.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import BoundedCache, map_texts, stage

FIELD = 40
MASK = (1 << FIELD) - 1
#: Words that address the reader, in the languages at hand.
SECOND_PERSON = frozenset("you your yours yourself u ur thou thee thy du dich dir dein deine ihr euch euer tu toi te ton ta tes vous votre vos tú ti usted ustedes vosotros tus".split())
#: Characters that stand for letters.
DISGUISE = str.maketrans("01345789@$!|€", "oieastbgasile")
NOT_LETTER = re.compile(r"[\W\d_]+")
FEATURES = ["strong", "weak", "weight", "best", "nearness", "capitals", "shouted", "punctuation", "exclaimed", "disguised", "second_person", "log_words"]


def stem_of(word: str) -> str:
    """The letters of a word in lower case, disguises undone if it mixes letters and what stands for them."""
    low = word.lower()
    plain = NOT_LETTER.sub("", low)
    inner = low.lstrip("!?.,;:*#%&|\"'([").rstrip("!?.,;:*#$%&|\"')]")
    return NOT_LETTER.sub("", inner.translate(DISGUISE)) if plain and inner != plain else plain


def beginnings(stem: str) -> list[str]:
    """What the lexicon may know of a word: its first 4 to 8 letters, or a shorter word whole."""
    return [stem[:k] for k in (4, 5, 6, 7, 8) if len(stem) >= k] if len(stem) >= 4 else [f"{stem}$"] * bool(stem)


class Words(BoundedCache):
    """Raw word -> packed counts: words, strong, weak, weight x 1000, capitals, shouted, marks, exclaimed, disguised, second person."""

    FIELDS = 10

    def __init__(self, lexicon: dict[str, float]) -> None:
        super().__init__()
        self.lexicon = lexicon

    def weight(self, stem: str) -> float:
        return max((self.lexicon.get(b, 0.0) for b in beginnings(stem)), default=0.0)

    def __missing__(self, word: str) -> int:
        self.room(1)
        stem = stem_of(word)
        w = self.weight(stem)
        letters = NOT_LETTER.sub("", word)
        upper = sum(c.isupper() for c in letters)
        fields = (
            1,
            w >= 3,
            0 < w < 3,
            round(1000 * w),
            upper,
            len(letters) > 2 and upper == len(letters),
            len(word) - len(letters),
            word.count("!"),
            w > 0 and stem != letters.lower(),
            stem in SECOND_PERSON,
        )
        found = self[word] = sum(int(v) << FIELD * k for k, v in enumerate(fields))
        return found


def nearness(words: list[str], cache: Words) -> float:
    """1 / (1 + distance) of the nearest pair of a lexicon word and a word that addresses the reader."""
    hit = you = None
    best = math.inf
    for at, word in enumerate(words):
        packed = cache[word]
        if packed >> FIELD * 3 & MASK:
            hit = at
        if packed >> FIELD * 9 & MASK:
            you = at
        if hit is not None and you is not None:
            best = min(best, abs(hit - you))
    return 1 / (1 + best)


def text_features(text: str | None, cache: Words) -> list[float]:
    words = (text or "").split()
    total = sum(map(cache.__getitem__, words))
    n, strong, weak, weight, upper, shouted, marks, exclaimed, disguised, second = (total >> FIELD * k & MASK for k in range(Words.FIELDS))
    one = max(1, n)
    near = nearness(words, cache) if weight and second else 0.0
    best = weight / 1000 / max(1, strong + weak)
    return [strong / one, weak / one, weight / 1000 / one, best, near, upper / one, shouted / one, marks / one, exclaimed / one, disguised / one, second / one, math.log1p(n)]


def find_lexicon(sample: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 400, least_docs: int = 5) -> dict[str, float]:
    """Word beginnings by the logarithm of how much denser they are in texts of label 1, the best `most` of them.

    Each task counts its own rows; the sums of all tasks are aggregated on the cluster.
    """

    def count(batches):
        sums: dict[str, list[float]] = {}
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = Counter((text or "").split())
                n = max(1, words.total())
                part: Counter[str] = Counter()
                for word, k in words.items():
                    for b in beginnings(stem_of(word)):
                        part[b] += k
                for b, k in part.items():
                    s = sums.setdefault(b, [0.0, 0.0, 0])
                    s[1 - label] += k / n
                    s[2] += label
        for at in range(0, len(sums), 50_000):
            keys = list(sums)[at : at + 50_000]
            cols = [pa.array(keys), *(pa.array([float(sums[b][k]) for b in keys]) for k in range(3))]
            yield pa.RecordBatch.from_arrays(cols, names=["b", "toxic", "clean", "docs"])

    both = sample.groupBy().agg(F.sum("_label").alias("t"), F.sum(1 - F.col("_label")).alias("c")).first()
    if not both["t"] or not both["c"]:
        return {}
    rate = F.log((F.sum("toxic") / both["t"] + 1e-6) / (F.sum("clean") / both["c"] + 1e-5))
    found = (
        sample.select(text_col, "_label").mapInArrow(count, "b string, toxic double, clean double, docs double")
        .groupBy("b")
        .agg(rate.alias("w"), F.sum("docs").alias("docs"))
        .filter((F.col("w") > 1.5) & (F.col("docs") >= least_docs))
        .orderBy(F.desc(F.col("w") * F.log(1 + F.col("docs"))), "b")
        .limit(most)
        .collect()
    )
    return {r["b"]: min(r["w"], 8.0) for r in found}


def feature_rows(docs: DataFrame, lexicon: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the columns of FEATURES."""

    def make():
        cache = Words(lexicon)

        def run(texts):
            rows = [text_features(t, cache) for t in texts]
            return dict(zip(FEATURES, map(list, zip(*rows, strict=True)), strict=True)) if rows else {n: [] for n in FEATURES}

        return run

    return map_texts(docs, make, [(n, "double", pa.float64()) for n in FEATURES], id_col, text_col)


class ToxicityModel:
    """Lexicon, trees and calibration; transform() adds score and predicted to texts."""

    def __init__(self, lexicon, trees, calibration, mean: float) -> None:
        self.lexicon, self.trees, self.calibration, self.mean = lexicon, trees, calibration, mean

    def raw(self, rows: DataFrame) -> DataFrame:
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(rows)
        return self.trees.transform(vectors).withColumn("_raw", vector_to_array("probability")[1])

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """id, score double, predicted int."""
        rows = feature_rows(docs, self.lexicon, id_col, text_col)
        if self.trees is None:
            score: Column = F.lit(self.mean)
        else:
            rows = self.calibration.transform(self.raw(rows))
            score = F.least(F.greatest(F.col("_score"), F.lit(0.0)), F.lit(1.0))
        return rows.select(id_col, score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, most_toxic: int = 4000, most_clean: int = 8000, trees: int = 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> ToxicityModel:
    """Learn from the labels given, at most most_toxic and most_clean rows of them."""
    labels = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"))
    # one label to an id: a row marked toxic outweighs one that is not
    labels = labels.groupBy("_id").agg(F.max("_label").alias("_label"))
    totals = {r["_label"]: r["n"] for r in labels.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    mean = totals.get(1, 0) / max(1, sum(totals.values()))
    seed = F.xxhash64("_id", F.lit("sample"))
    few = [labels.filter(F.col("_label") == k).orderBy(seed, "_id").limit(n) for k, n in ((1, most_toxic), (0, most_clean))]
    chosen = few[0].unionByName(few[1])  # at most most_toxic + most_clean narrow rows
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    sample = stage(sample.withColumn("_part", F.pmod(F.xxhash64("_id", F.lit("part")), F.lit(5))), "labelled").coalesce(4)
    lexicon = find_lexicon(sample.filter("_part < 2"), "_id", "_text")
    sizes = {r["_label"]: r["n"] for r in sample.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    fitted = sample.filter("_part >= 2")
    if len(sizes) < 2 or fitted.filter("_part < 4").select("_label").distinct().count() < 2 or fitted.filter("_part = 4").isEmpty():
        return ToxicityModel(lexicon, None, None, mean)
    share = F.when(F.col("_label") == 1, totals[1] / sizes[1]).otherwise(totals[0] / sizes[0])
    rows = feature_rows(fitted.withColumn("_key", F.struct("_id", "_label", "_part")), lexicon, "_key", "_text").select("_key.*", *FEATURES)
    rows = stage(rows.withColumn("_weight", share), "features").coalesce(2)
    grow = GBTClassifier(
        featuresCol="_features", labelCol="_label", weightCol="_weight", predictionCol="_class",
        maxIter=trees, maxDepth=3, stepSize=0.3, maxBins=32, seed=7,
    )
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(rows.filter("_part < 4"))
    model = ToxicityModel(lexicon, grow.fit(vectors), None, mean)
    held = model.raw(rows.filter("_part = 4")).select("_raw", "_label", "_weight")
    model.calibration = IsotonicRegression(featuresCol="_raw", labelCol="_label", weightCol="_weight", predictionCol="_score").fit(held)
    return model
