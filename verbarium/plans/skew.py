"""The queries of the skewed keys (problem 7), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbarium.operators.skew import heavy_keys, per_key, per_key_mode, per_key_percentiles, value_frequencies
from verbarium.sources.tables import table


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    return value_frequencies(table(spark, d, "documents"), F.col("source"), F.length("text").cast("long"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return value_frequencies(table(spark, d, "id_graph"), F.col("dst"), F.col("src"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys with at least a twentieth of all rows of their table."""
    sources = heavy_keys(per_key(_lengths(spark, d)), 0.05).select(F.lit("documents").alias("tbl"), F.col("key").alias("key_value"))
    targets = heavy_keys(per_key(_links(spark, d)), 0.05).select(F.lit("id_graph").alias("tbl"), F.col("key").cast("string").alias("key_value"))
    return sources.unionByName(targets)


def p7_sources(spark: SparkSession, d: str) -> DataFrame:
    """Documents, characters and distinct words of each source."""
    rows = per_key(_lengths(spark, d)).select("key", F.col("rows").alias("documents"), F.col("total").alias("characters"))
    docs = table(spark, d, "documents")
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))))
    each = docs.select("source", words.alias("word"))
    distinct = per_key(value_frequencies(each, F.col("source"), F.col("word"))).select(F.col("key").alias("k"), "n_distinct")
    return rows.join(distinct, F.col("key").eqNullSafe(F.col("k")), "left").select(
        F.col("key").alias("source"), "documents", "characters", F.coalesce("n_distinct", F.lit(0)).alias("distinct_words")
    )


def p7_targets(spark: SparkSession, d: str) -> DataFrame:
    """Links and distinct linking pages of each target."""
    return per_key(_links(spark, d)).select(F.col("key").alias("dst"), F.col("rows").alias("links"), F.col("n_distinct").alias("distinct_src"))


def p7_length_modes(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent text length of each source."""
    return per_key_mode(_lengths(spark, d)).select(F.col("key").alias("source"), "mode", "mode_rows")


def p7_length_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Quartiles and the 99th percentile of the text lengths of each source."""
    return per_key_percentiles(_lengths(spark, d), [0.25, 0.5, 0.75, 0.99]).select(F.col("key").alias("source"), "share", F.col("value").alias("n_chars"))


QUERIES = {f.__name__: f for f in (p7_found, p7_sources, p7_targets, p7_length_modes, p7_length_percentiles)}

ORACLE = {
    "p7_found": """
        SELECT 'documents' AS tbl, source AS key_value FROM documents WHERE source IS NOT NULL GROUP BY source HAVING count(*) >= 0.05 * (SELECT count(*) FROM documents)
        UNION ALL
        SELECT 'id_graph', dst::VARCHAR FROM id_graph WHERE dst IS NOT NULL GROUP BY dst HAVING count(*) >= 0.05 * (SELECT count(*) FROM id_graph)""",
    "p7_sources": """
        WITH words AS (SELECT source, count(DISTINCT word) AS n FROM (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents) GROUP BY source)
        SELECT d.source, count(*) AS documents, coalesce(sum(length(text)), 0)::BIGINT AS characters, coalesce(any_value(n), 0) AS distinct_words
        FROM documents d LEFT JOIN words w ON d.source IS NOT DISTINCT FROM w.source GROUP BY d.source""",
    "p7_targets": "SELECT dst, count(*) AS links, count(DISTINCT src) AS distinct_src FROM id_graph GROUP BY dst",
    "p7_length_modes": """
        SELECT source, n_chars AS mode, n AS mode_rows
        FROM (SELECT source, length(text) AS n_chars, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, n_chars) = 1""",
    "p7_length_percentiles": """
        WITH placed AS (
            SELECT source, length(text) AS n_chars, row_number() OVER (PARTITION BY source ORDER BY length(text)) AS place, count(*) OVER (PARTITION BY source) AS t
            FROM documents WHERE text IS NOT NULL)
        SELECT source, share, n_chars FROM placed, (SELECT unnest([0.25, 0.5, 0.75, 0.99])::DOUBLE AS share)
        WHERE place = greatest(1, ceil(share * t - 1e-9))""",
}
