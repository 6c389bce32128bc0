"""The contract queries over the standard tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, mixing, neighbours, packing, pii, quality, simhash, sketches, token_counts, toxicity
from .common import fold, table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary file is; the files stay outside this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary()).drop("ids")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.where(F.col("vec_id") % 20 == 0))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprint_edits(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal(table(spark, sf_dir, "documents"))


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, fold(labels["doc_id"], 4) == 2)
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, fold(labels["doc_id"], 3) == 1)
    scored = quality.score_documents(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_best_fit_packing, op2_nearest_neighbours, op3_document_fingerprints, op4_source_mixing, op5_simhash_near_dedup, op6_personal_data, op7_html_main_text, op8_toxicity, op9_quality, op10_token_counts)
}

#: Poisson probabilities up to 12 deviations and 20 beyond the rate, as in ``mixing.tables``; rates above its STEP do not occur here.
MIXING_SQL = f"""
WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
weighed AS (SELECT source, n, power(n::DOUBLE, {mixing.TEMPERATURE}) AS w FROM sizes),
rates AS (SELECT source, (SELECT sum(n) FROM weighed)::DOUBLE * w / (SELECT sum(w) FROM weighed) / n AS rate FROM weighed),
terms AS (
  SELECT source, k, sum(CASE WHEN k = 0 THEN exp(-rate) ELSE exp(-rate + k * ln(rate) - lgamma(k + 1)) END)
    OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM rates, LATERAL (SELECT unnest(range(0, (ceil(rate + 12 * sqrt(rate) + 20) + 1)::BIGINT)) AS k)),
hashed AS (
  SELECT *, (('0x' || substr(md5('{mixing.SEED}|' || coalesce(doc_id::VARCHAR, 'null') || '|1'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
counted AS (
  SELECT h.doc_id, h.text, h.lang, h.source, h.n_chars, h.u, list(t.cdf) AS cdfs
  FROM hashed h JOIN (SELECT source, list(cdf) AS cdf FROM terms GROUP BY source) t ON h.source IS NOT DISTINCT FROM t.source
  GROUP BY ALL),
copies AS (
  SELECT doc_id, text, lang, source, n_chars, unnest(range(1, len(list_filter(cdfs[1], lambda c: c <= u)) + 1)) AS copy FROM counted)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy,
  substr(md5('{mixing.SEED}:order|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy::VARCHAR), 1, 16) AS shuffle_key
FROM copies
"""

ORACLES: dict[str, str] = {"op4_source_mixing": MIXING_SQL}
