"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.common import table
from vitrine.llm.conversations import damage, repair
from vitrine.llm.exact_dedup import exact_dedup
from vitrine.llm.langid import held_out, predict_language, training_text
from vitrine.llm.lexical import lexical_search
from vitrine.llm.media import media_digests
from vitrine.llm.ngram_join import ngram_join
from vitrine.llm.packing import pack_documents
from vitrine.llm.pii import BASE, find_pii
from vitrine.llm.pieces import count_tokens, encode_decode
from vitrine.llm.sharding import shard_documents
from vitrine.llm.substring import remove_repeats
from vitrine.llm.toxicity import fit_toxicity


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest").drop("_row")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_decode(table(spark, sf_dir, "documents"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared types are right, wrong or missing, by the text alone."""
    said = F.element_at(F.array(*map(F.lit, ["audio/wav", "text/plain", "image/png", None])), (F.crc32(F.coalesce("text", F.lit("")).cast("binary")) % 4 + 1).cast("int"))
    return media_digests(table(spark, sf_dir, "documents"), declared=said)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out("doc_id", 3, 1)
    return predict_language(docs, training_text(docs, ~out)).withColumn("held_out", out)  # with `recognised`


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = held_out("doc_id", 5, 0)
    return fit_toxicity(docs, labels.filter(~out)).score(docs).withColumn("held_out", out)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x.kind == kind)).cast("long")
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans")
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(table(spark, sf_dir, "conversations")), dropped=F.col("_dropped"))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_pii": op3_pii,
    "op8_toxicity": op8_toxicity,
    "op4_media_columns": op4_media_columns,
    "op5_language_id": op5_language_id,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op10_sentencepiece": op10_sentencepiece,
    "op7_token_counts": op7_token_counts,
    "op9_exact_dedup": op9_exact_dedup,
    "op11_sharding": op11_sharding,
    "op12_ranked_search": op12_ranked_search,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL = {
    "op9_exact_dedup": """
        WITH d AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM d WINDOW g AS (PARTITION BY t)""",
    "op12_ranked_search": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
            FROM documents),
        l AS (SELECT r, doc_id, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
        g AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM l),
        m AS (SELECT r, doc_id, 100 - 25 + ((25 * n * nn) // ll) AS m FROM l, g),
        p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY r, term),
        w AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY term),
        q AS (
            SELECT item_id, unnest(regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark),
        s AS (
            SELECT item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
            FROM (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL)
            JOIN w USING (term) JOIN p USING (term) JOIN m USING (r), range(times) GROUP BY item_id, doc_id, r),
        k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20""",
}
