"""A fixture of awkward documents, written as files, since some operators number rows by their place in files."""

from __future__ import annotations

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("_row", T.StringType()), T.StructField("score", T.StringType()), T.StructField("kept", T.StringType()),
])


def texts(seed: int = 5) -> list[str | None]:
    rng = random.Random(seed)
    words = ["".join(rng.choice(["an", "er", "th", "ou", "st", "re", "in"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, long = prose(60), prose(4000)
    out: list[str | None] = [None, "", "   ", "\n\t", "one", "four words are here", "😀 é ñ 日本", long, long + " tail", passage, prose(30) + " " + passage + " " + prose(30)]
    out += [prose(40) + " " + passage for _ in range(5)]
    base = prose(120).split()
    for k in range(30):  # near copies
        copy = list(base)
        for _ in range(k % 3):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        out.append(" ".join(copy))
    out += [out[-1]] * 40 + [out[-1].upper()] * 3  # a large group of copies
    out += ["mail a@b.co or +1 (499) 555-6503 at 10.1.2.3, card 4111 1111 1111 1111"] * 2
    out += [prose(rng.randint(1, 300)) for _ in range(60)]
    out.append(prose(80) + " mail a@b.co " + prose(20))
    return out


def documents(spark, folder, rows=None):
    """(DataFrame read from files, rows): unusual columns, a null id and a repeated row among them."""
    if rows is None:
        rows = [(i, t, ["en", "de", None][i % 3], f"s{i % 4}", None if t is None else len(t), "x", "y", "z") for i, t in enumerate(texts())]
        rows.append((None, rows[9][1], "en", None, 1, None, None, None))
        rows.append(rows[12])
    path = f"{folder}/docs.parquet"
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    df = spark.read.schema(SCHEMA).parquet(path)
    return df, [tuple(r) for r in df.collect()]
