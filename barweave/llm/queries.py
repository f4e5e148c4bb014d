"""The queries of this package: name to callable, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read_table


def op1_ivfpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import neighbours

    return neighbours(read_table(spark, sf_dir, "embeddings"))


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import deduplicate

    return deduplicate(read_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read_table(spark, sf_dir, "documents"))


def op2_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ogg import document_media

    return document_media(read_table(spark, sf_dir, "documents"))


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .katz import score_texts

    return score_texts(read_table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import token_digests

    return token_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import document_languages

    return document_languages(read_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rlz import deduplicate

    return deduplicate(read_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import document_quality

    return document_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_ivfpq": op1_ivfpq,
    "op2_ogg": op2_ogg,
    "op3_suffix": op3_suffix,
    "op4_packing": op4_packing,
    "op5_katz": op5_katz,
    "op6_bpe": op6_bpe,
    "op7_langid": op7_langid,
    "op8_simhash": op8_simhash,
    "op9_rlz": op9_rlz,
    "op10_quality": op10_quality,
}
#: The others train, approximate, need hashes that DuckDB lacks, or take quadratic time in SQL: tests/llm has brute force.
ORACLE_SQL: dict[str, str] = {
    "op9_rlz": r"""
        WITH u AS (SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM documents),
        d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, t) AS r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM u),
        starts AS (SELECT r, w, unnest(range(1, greatest(len(w) - 18, 1))) AS s FROM d),
        repeated AS (SELECT r, s FROM (SELECT r, s, row_number() OVER (PARTITION BY w[s : s + 19] ORDER BY r, s) AS n FROM starts) WHERE n > 1),
        gone AS (SELECT DISTINCT r, s + o AS p FROM repeated, (SELECT unnest(range(0, 20)) AS o)),
        words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
        kept AS (SELECT words.r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS k FROM words ANTI JOIN gone USING (r, p) GROUP BY 1)
        SELECT x.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
        FROM documents AS x JOIN d ON x.doc_id IS NOT DISTINCT FROM d.doc_id AND coalesce(x.text, '') = d.t LEFT JOIN kept USING (r)
    """,
}
