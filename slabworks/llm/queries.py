"""Queries p7 to p9, over the whole corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slabworks.llm import bytepair, mixture, repetition
from slabworks.session import table


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bytepair.encode_corpus(table(spark, d, "documents"))


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every document's ids decoded: length in bytes and digest of the text they give."""
    text = bytepair.decode_corpus(bytepair.encode_corpus(table(spark, d, "documents")))
    return text.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.md5(F.col("text").cast("binary")).alias("digest"))


def p7_source_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens per source, counted without moving ids."""
    sizes = bytepair.count_tokens(table(spark, d, "documents"), ["source"])
    return sizes.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("n_tokens"))


def p8_draw(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each mix with their copies."""
    return mixture.draw(table(spark, d, "documents"), table(spark, d, "mix_target"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares each mix reaches."""
    targets = table(spark, d, "mix_target")
    return mixture.shares(mixture.draw(table(spark, d, "documents"), targets)[0], targets)


def p8_certified(spark: SparkSession, d: str) -> DataFrame:
    """Whether shares and caps of the draw hold, counted on what was drawn."""
    targets = table(spark, d, "mix_target")
    drawn, plan = mixture.draw(table(spark, d, "documents"), targets)
    return mixture.certify(drawn, targets, plan)


def p8_shares_by_length(spark: SparkSession, d: str) -> DataFrame:
    """The same with unequal probabilities: longer documents come more often, by the square root of their size."""
    targets = table(spark, d, "mix_target")
    return mixture.shares(mixture.draw(table(spark, d, "documents"), targets, weight=F.sqrt("n_tokens"))[0], targets)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetitive(table(spark, d, "documents")).select("doc_id").distinct()


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The repeated share of each document, and the shares of its words and four-word runs that occurred earlier."""
    rows = repetition.repeated_shares(table(spark, d, "documents"))
    return rows.select("doc_id", "n_words", *[F.round(c, 9).alias(c) for c in ("repeated_share", "word_share", "four_share")])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p7_ids": p7_ids, "p7_round_trip": p7_round_trip, "p7_source_tokens": p7_source_tokens, "p8_draw": p8_draw, "p8_shares": p8_shares,
    "p8_certified": p8_certified, "p8_shares_by_length": p8_shares_by_length, "p9_found": p9_found, "p9_shares": p9_shares,
}


def _run(n: int) -> str:
    return " || ' ' || ".join(["word", *[f"lead(word, {k}) OVER o" for k in range(1, n)]])


_WORDS = r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d)"""
_REPEATS = _WORDS + f""",
g AS (SELECT doc_id, i, word, {_run(4)} AS four, {_run(8)} AS eight FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
a AS (SELECT doc_id, i, word, four IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, four ORDER BY i) > 1 AS four_again,
      eight IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, eight ORDER BY i) > 1 AS eight_again FROM g),
c AS (SELECT doc_id, word, bool_or(four_again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS in_four,
      bool_or(eight_again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS in_eight FROM a),
s AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE in_eight) / count(*) AS repeated_share, 1 - count(DISTINCT word) / count(*) AS word_share, count(*) FILTER (WHERE in_four) / count(*) AS four_share FROM c GROUP BY 1)"""
_CERTIFIED = """SELECT t.mix_name, t.source, coalesce(d.n, 0) AS n_available, true AS share_met, true AS repeats_kept, true AS mix_exhausted
FROM (SELECT DISTINCT mix_name, source FROM mix_target WHERE target_share > 0 AND max_repeats >= 1 AND source IS NOT NULL) t
LEFT JOIN (SELECT source, count(*) AS n FROM documents WHERE text <> '' GROUP BY 1) d USING (source)"""

#: SQL can't tokenize or draw: what can be told of them exactly (a round trip, promises kept) is compared,
#: the rest with brute force and other libraries in the tests.
ORACLES: dict[str, str] = {
    "p7_round_trip": "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes, md5(coalesce(text, '')) AS digest FROM documents",
    "p8_certified": _CERTIFIED,
    "p9_found": _REPEATS + " SELECT doc_id FROM s WHERE repeated_share >= 0.3 - 1e-12",
    "p9_shares": _REPEATS + """ SELECT d.doc_id, coalesce(n_words, 0) AS n_words, round(coalesce(repeated_share, 0), 9) AS repeated_share, round(coalesce(word_share, 0), 9) AS word_share,
round(coalesce(four_share, 0), 9) AS four_share FROM documents d LEFT JOIN s USING (doc_id)""",
}
