"""The corpus pipeline: language, quality, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the
columns of `documents`. `run` writes each stage's result and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barweave.llm import jaccard, langid, packing, quality, suffix
from barweave.llm.common import fold, read_table, stored
from barweave.llm.repeats import row_hashes

#: A document of which less than this share of n-grams belongs to its best language is in none of them.
LEAST_LANGUAGE_SHARE = 0.25
LEAST_QUALITY = 0.7


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without text in a known language: null, without a letter, or hardly a known n-gram.

    Without a labelled text to learn n-grams from, every document with a letter stays.
    """
    model = langid.fit(docs, fold(F.col("i"), 3) != 1)
    if model is None or not model.table.any():
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    judged = langid.predict(docs, model)
    return judged.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_share") >= LEAST_LANGUAGE_SHARE)).select(*docs.columns)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose probability of being good is below LEAST_QUALITY.

    Without labels of both kinds to learn from, every document stays.
    """
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), fold(F.col("i"), 4) != 2)
    if not isinstance(model, quality.QualityModel):
        return docs
    return quality.score(docs, model, out_col="__score").filter(F.col("__score") >= LEAST_QUALITY).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each near-duplicate group.

    Near are documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, verified exactly;
    jaccard.py says why candidates meet by shingles and not within a radius of SimHash bits. Rows of one id count as one document, of which the row with the smallest text hash stays; rows without an
    id can't be told apart and stay.
    """
    first = jaccard.kept_ids(docs, shingle=5)
    named = docs.join(first, "doc_id", "left_semi")
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    named = named.withColumn("__n", F.row_number().over(one)).filter("__n = 1").select(*docs.columns)
    return named.unionByName(docs.filter(F.col("doc_id").isNull()))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take every passage of 200 bytes or more that occurs elsewhere out of the texts; null texts stay null."""
    keys = ["__uid", "__u2"]
    left = suffix.deduplicate(docs, keep_text=True).select(F.col("uid").alias(keys[0]), F.col("u2").alias(keys[1]), F.col("kept").alias("__kept"))
    # rows equal in id and text have equal results, and keep their other columns
    rest = docs.withColumns(dict(zip(keys, row_hashes(F.col("doc_id"), F.col("text"))))).withColumn("__null", F.col("text").isNull()).drop("text")
    out = left.dropDuplicates(keys).join(rest, keys).withColumn("text", F.when(~F.col("__null"), F.col("__kept")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("__kept").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into bins of 2,048 words."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("quality", classify_quality),
    ("simhash", drop_near_duplicates),
    ("suffix", remove_repeats),
    ("packing", pack_documents),
]
#: A trained classifier and a packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
