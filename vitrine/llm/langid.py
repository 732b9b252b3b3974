"""Language identification by cross-parsing (operator 5).

Training text of each language, a bounded sample of labelled rows, becomes a suffix automaton.  A whole
text, in lower case, its words reduced to their letters and joined by one space, is parsed greedily into
the longest phrases that occur in a language's training text; phrases run across words.  What a phrase
costs is the logarithm of the training text's length, so costs are comparable between languages; the
language with the lowest cost wins.

Cost is also what rejects a document: a parse that costs more than `ABOVE` times what spelling the text
letter by letter would, each letter of the language being as likely as any other, plus `SLACK` phrases for
very short texts, has recognised nothing.

Defined results: `und` with score 0 if a text is null or has no letter, or nothing could be learned; ties
go to the language that is first by name; rows with a null id are predicted like others and never learned
from; repeated rows give equal values; other columns are not touched.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import BoundedCache, map_texts

UNDETERMINED = "und"
#: Texts of a learned language cost about 0.55 times what spelling does, 99.9 % of them under 1.2; letters at random cost 2.2.
ABOVE, SLACK = 1.5, 2
CHUNK, FAR = 512, 80


def held_out(id_col: str, parts: int, part: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(parts)) == part, F.lit(False))


def training_text(
    docs: DataFrame, usable: Column, per_language: int = 24, enough_chars: int = 24_000, most_languages: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> dict[str, str]:
    """A sample of at most per_language rows of each language: the bound of what is learned from.  Texts are learned whole.

    Only the most_languages values of lang that most rows have are languages; a dirty column may hold any number of others.

    A text with letters goes by its hash to one of per_language buckets, and of each bucket the text with the
    smallest seed is picked, so copies of a text are one pick; a plain aggregation of narrow columns, so no
    language's rows meet in one task.  In the order of seeds, rows are taken until they have enough_chars
    characters together; the row that gets there is whole too, and no row is passed over for its length.
    """
    rows = docs.filter(usable).select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{lang_col}`").alias("_lang"), F.col(f"`{text_col}`").alias("_text"))
    rows = rows.filter(F.col("_lang").isNotNull() & F.col("_text").rlike(r"\p{L}") & F.col("_id").isNotNull()).withColumn("_hash", F.xxhash64("_text"))
    common = rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "_lang").limit(most_languages).select("_lang")
    rows = rows.join(F.broadcast(common), "_lang", "left_semi")  # most_languages rows
    seed = F.xxhash64("_hash", F.lit("train"))
    pick = F.struct(seed.alias("seed"), "_id", "_hash", F.length("_text").alias("n"))
    chosen = rows.groupBy("_lang", F.pmod(F.xxhash64("_hash", F.lit("bucket")), F.lit(per_language)).alias("_b")).agg(F.min(pick).alias("p"))
    left, wanted = {}, []
    for lang, seed, key, text_hash, n in sorted(tuple(r) for r in chosen.select("_lang", "p.seed", "p._id", "p._hash", "p.n").collect()):
        if left.setdefault(lang, enough_chars) > 0:
            left[lang] -= n
            wanted.append((lang, key, text_hash))
    if not wanted:
        return {}
    kinds = dict(rows.dtypes)
    some = docs.sparkSession.createDataFrame(wanted, f"_lang {kinds['_lang']}, _id {kinds['_id']}, _hash long")
    picked = rows.join(F.broadcast(some), ["_lang", "_id", "_hash"]).select("_lang", "_id", "_text").collect()
    found: dict[str, list[str]] = {}
    for lang, _, text in sorted({tuple(r) for r in picked}):
        found.setdefault(lang, []).append(" ".join(letters(text)))
    return {lang: " ".join(texts) for lang, texts in found.items()}


def letters(text: str) -> list[str]:
    """The words in lower case, without what is no letter."""
    return [w for x in text.lower().split() if (w := only_letters(x))]


def only_letters(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def suffix_automaton(text: str) -> dict:
    """The start state; a state is its transitions, and exactly the substrings of the text can be read from the start."""
    follow: list[dict] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    for state in follow:
        for c in state:
            state[c] = follow[state[c]]
    return follow[0]


def phrases(start: dict, text: str, most: float = math.inf) -> int:
    """How many longest matches cover the text; a character that never occurs is one of its own.

    Counting may stop once there are more than `most`.
    """
    n, state = 0, start
    for at in range(0, len(text), CHUNK):
        for c in text[at : at + CHUNK]:
            to = state.get(c)
            if to is None:
                n += state is not start
                to = start.get(c)
                if to is None:
                    n += 1
                    to = start
            state = to
        if n > most:
            return n
    return n + (state is not start)


class Model:
    """Automata by language, what a phrase costs in each, and how many letters each has."""

    def __init__(self, training: dict[str, str]) -> None:
        self.langs = sorted(training)
        self.automata = [suffix_automaton(f" {training[x]} ") for x in self.langs]
        self.bits = [math.log2(len(training[x]) + 2) for x in self.langs]
        self.spelling = [math.log2(max(2, len(set(training[x])))) for x in self.langs]

        class Words(BoundedCache):
            """Raw word in lower case -> its letters."""

            def __missing__(self, word: str) -> str:
                self.room(1)
                found = self[word] = only_letters(word)
                return found

        self.words = Words()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, whether the parse recognised the text)."""
        body = " ".join(filter(None, map(self.words.__getitem__, text.lower().split()))) if text and self.langs else ""
        if not body:
            return UNDETERMINED, 0.0, False
        body = f" {body} "
        costs = self.costs(body)
        least = min(costs)
        best = costs.index(least)
        known = least <= len(body) * self.spelling[best] * ABOVE + SLACK * self.bits[best]
        return self.langs[best], 1 / sum(2 ** max(least - c, -1000) for c in costs), known

    def costs(self, body: str) -> list[float]:
        """The cost of the whole parse by language.

        The language that is best on the first chunk is parsed first; the others stop when they cost more by
        FAR bits, as their share in the score is then below the last bit of a double.
        """
        order = range(len(self.langs))
        if len(body) > 2 * CHUNK:
            order = sorted(order, key=lambda k: phrases(self.automata[k], body[:CHUNK]) * self.bits[k])
        costs, least = [0.0] * len(self.langs), math.inf
        for k in order:
            costs[k] = phrases(self.automata[k], body, (least + FAR) / self.bits[k]) * self.bits[k]
            least = min(least, costs[k])
        return costs


_MODELS: dict[int, Model] = {}


def predict_language(docs: DataFrame, training: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, recognised: score is 0 to 1, the winner's share when each bit saved halves the others' weight."""

    def make():
        key = hash(tuple(sorted(training.items())))
        if key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = Model(training)
        model = _MODELS[key]

        def run(texts):
            got = [model.predict(t) for t in texts]
            return {n: [x[k] for x in got] for k, n in enumerate(("lang_pred", "score", "recognised"))}

        return run

    cols = [("lang_pred", "string", pa.string()), ("score", "double", pa.float64()), ("recognised", "boolean", pa.bool_())]
    return map_texts(docs, make, cols, id_col, text_col)


def keep_identified(docs: DataFrame, training: dict[str, str], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows that the parse of no language recognises; a null lang becomes the prediction, other columns stay.

    Where nothing could be learned, as when no row has a language, all rows with a letter stay as they are.
    """
    names = docs.columns
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_doc"), F.col(f"`{text_col}`").alias("_text"))
    if not training:
        return row.filter(F.col("_text").rlike(r"\p{L}")).select("_doc.*")
    found = predict_language(row, training, "_doc", "_text").filter("recognised")
    lang = F.coalesce(F.col(f"_doc.`{lang_col}`"), F.col("lang_pred")).alias(lang_col)
    return found.select(*(lang if c == lang_col else F.col(f"_doc.`{c}`") for c in names))
