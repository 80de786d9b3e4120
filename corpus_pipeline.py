"""A training corpus from raw documents: clean of toxic ones, near copies and repeated passages, mixed, and tokenized.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's input. All but the last return the columns of `documents`, with n_chars of the text as it then is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm import bytebpe, jaccard, mixing, suffix, toxicity
from eventloom.llm.common import read, ready, stage


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the threshold, by a model of the labelled rows that are still there and not held out.

    Columns of `docs` that are named like a result of the judgement keep their values.
    """
    own = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    back = [F.col(own[c]).alias(c) if c in own else F.col(c) for c in docs.columns]
    judged = toxicity.judged(docs.withColumnsRenamed(own), read(spark, sf_dir, "labels"))
    return judged.filter("predicted = 0").select(*back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id; texts without a word stay."""
    ready(spark)
    found = jaccard.grouped(docs).filter("first").select("doc_id", "text_hash", F.col("class").isNull().alias("alone")).distinct()
    key = lambda text_hash: F.xxhash64("doc_id", text_hash)
    kept = stage(found.select(key("text_hash").alias("__key"), "alone").groupBy("__key").agg(F.max("alone").alias("__alone")), "kept")
    joined = docs.withColumn("__key", key(F.xxhash64("text"))).join(kept, "__key")
    # of rows that are the same in id and text, one
    nth = F.row_number().over(Window.partitionBy("__key").orderBy("doc_id"))
    return joined.withColumn("__nth", nth).filter("__nth = 1 OR __alone").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur elsewhere; a document that was nothing else stays as an empty one."""
    ready(spark)
    return _counted(suffix.removed(docs), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row for each pass over a document."""
    return _counted(mixing.remixed(docs), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, ids, n_tokens."""
    ready(spark)
    found = bytebpe.encode(docs)
    return found.select("doc_id", "lang", "source", "n_chars", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeated_passages", cut_repeats),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Learnt scores and hashed orders are not SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
