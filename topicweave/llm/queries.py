"""The queries of this subpackage, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compression, exact_dedup, language_id, mixing, packing, pitman_yor, quality_ranking, secret_forest, simhash, stages, suffix_dedup
from .stages import tokenizer_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.compression_bands(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), added=True)


def op4_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality_ranking.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_ranking.ranked(docs, model)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.scored(documents(spark, sf_dir))


def op8_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_forest.findings(documents(spark, sf_dir), secret_forest.synthetic_findings(spark))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.with_copies(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_compression_bands": op1_compression_bands,
    "op2_language_id": op2_language_id,
    "op3_packing": op3_packing,
    "op4_quality_ranking": op4_quality_ranking,
    "op5_simhash": op5_simhash,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_pitman_yor": op7_pitman_yor,
    "op8_secret_forest": op8_secret_forest,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_mixing": op10_mixing,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op9_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) = 1 AS kept,
               text_sha256
        FROM d""",
    "op10_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
            FROM documents),
        s AS (SELECT source, CAST(sum(size) AS HUGEINT) AS source_size FROM d GROUP BY source),
        w AS (
            SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place,
                   [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight
            FROM s),
        r AS (
            SELECT *, source_size * 3 AS cap, sum(source_size) OVER () AS total,
                   coalesce(sum(source_size * 3) OVER o, 0) AS capped_before,
                   sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS weight_left
            FROM w
            WINDOW o AS (ORDER BY source_size / CAST(weight AS DOUBLE), place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        c AS (SELECT *, (total - capped_before) * weight >= cap * weight_left AS is_capped FROM r),
        l AS (
            SELECT *, total - coalesce(sum(CASE WHEN is_capped THEN cap END) OVER (), 0) AS rest,
                   coalesce(sum(CASE WHEN NOT is_capped THEN weight END) OVER (), 0) AS rest_weight
            FROM c),
        t AS (
            SELECT source, source_size,
                   CASE WHEN is_capped THEN CAST(cap AS DOUBLE) ELSE CAST(rest * weight AS DOUBLE) / CAST(rest_weight AS DOUBLE) END AS target
            FROM l),
        j AS (
            SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
                   CASE WHEN source_size > 0 THEN target / CAST(source_size AS DOUBLE) ELSE 1.0 END AS rate,
                   CAST(CAST('0x' || substr(md5('mix-1:' || doc_id), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS draw
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               CAST((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
        FROM j""",
}
