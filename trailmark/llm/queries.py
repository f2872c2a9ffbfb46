"""The registered query of each operator, over the whole table it is meant for, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import alignment, exact_dedup, filter_audit, language_id, licenses, lm, mixing, ngram_join, passages, quality, sentencepiece_scan, token_counts, token_files
from trailmark.llm.store import Scratch


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures = quality.FIGURES[:5]
    return quality.quality(documents(spark, sf_dir)).select("doc_id", *figures, "base_failed", "kept", F.round("quality", 6).alias("quality"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepiece_scan.encode(documents(spark, sf_dir), keep=["doc_id"], check=True)
    return encoded.withColumn("score", F.round("score", 3))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("row.doc_id", "row.source", "row.lang", "cell.topic", "n_tokens", F.round("probability", 9).alias("probability"), F.round("weight", 9).alias("weight"), "drawn")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir))
    return found.select("doc_id", "paragraph", "family", F.round("probability", 4).alias("probability"), F.round("likeness", 4).alias("likeness"), "confirmed", "notice")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(documents(spark, sf_dir))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.summary(documents(spark, sf_dir))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'token-files').path}/files"
    token_files.write(documents(spark, sf_dir), path)
    return token_files.read(spark, path).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_lm_scoring, op3_exact_dedup, op4_quality_rules, op5_language_id, op6_sentencepiece, op7_mixing, op8_license_scan, op9_substring_dedup, op10_ngram_jaccard_join, op11_alignment, op12_filter_audit, op13_token_files)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": r"""
            WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
            SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
            FROM n WINDOW w AS (PARTITION BY t)
        """,
        "op12_filter_audit": r"""
            WITH d AS (
                SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
            ), l AS (
                SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
            ), f AS (
                SELECT part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
                    [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
                     regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)] AS fails
                FROM d LEFT JOIN l ON d.doc_id = l.doc_id
            ), m AS (
                SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails
            ), i AS (SELECT unnest([1, 2, 3, 4, 5]) AS i), o AS (
                SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e
                WHERE b.i <> a.i AND c.i NOT IN (a.i, b.i) AND d.i NOT IN (a.i, b.i, c.i) AND e.i NOT IN (a.i, b.i, c.i, d.i)
            ), s AS (
                SELECT part, o, i.i AS step, n, good, toxic, fails[o[i.i]] AS failed, len(list_filter(fails, lambda x: x)) AS failures,
                    coalesce(list_position(list_transform(o, lambda x: fails[x]), true), 6) AS first
                FROM m, o, i
            ), r AS (
                SELECT part, o, step, sum(CASE WHEN first > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN first = step THEN n ELSE 0 END) AS removed,
                    sum(CASE WHEN failed AND first < step THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed AND failures = 1 THEN n ELSE 0 END) AS unique_fails,
                    sum(CASE WHEN first = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN first = step THEN toxic ELSE 0 END) AS toxic_lost
                FROM s GROUP BY part, o, step
            )
            SELECT part, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
                redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
                (sum(removed) OVER (PARTITION BY part, o[step]))::BIGINT AS shapley
            FROM r
        """,
    }
