"""The operators applied to whole tables, by query name, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import bytebpe, dialogue, fertility, jaccard, mixing, ngram, pages, spelling, suffix, topk, toxicity, urls, varbyte
from eventloom.llm.sql import REPAIR_SQL, SPELLING_SQL, URL_SQL
from eventloom.llm.common import crc_of_id, read
from eventloom.sources.tables import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_fertility(spark: SparkSession, directory: str) -> DataFrame:
    documents = read(spark, directory, "documents").select("doc_id", "text", "lang")
    return fertility.judged(documents).drop("lang")


def op2_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    documents = read(spark, directory, "documents").select("doc_id", "text")
    scored = toxicity.judged(documents, read(spark, directory, "labels"))
    return scored.select("doc_id", (crc_of_id("doc_id") % 3 == 1).alias("held_out"), "score", "predicted", "n_offending")


def op3_topk(spark: SparkSession, directory: str) -> DataFrame:
    return topk.nearest(read(spark, directory, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_mixing(spark: SparkSession, directory: str) -> DataFrame:
    return mixing.mixed(read(spark, directory, "documents"))


def op5_jaccard(spark: SparkSession, directory: str) -> DataFrame:
    found = jaccard.grouped(read(spark, directory, "documents"))
    return found.select("doc_id", "class_id", "n_links", "group_id")


def op6_varbyte(spark: SparkSession, directory: str) -> DataFrame:
    return varbyte.round_trip(read(spark, directory, "documents"), scratch_path(spark, "token-files"))


def op7_suffix(spark: SparkSession, directory: str) -> DataFrame:
    return suffix.digests(read(spark, directory, "documents"))


def op8_byte_bpe(spark: SparkSession, directory: str) -> DataFrame:
    documents = read(spark, directory, "documents").select("doc_id", "text")
    return bytebpe.digests(documents).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_pages(spark: SparkSession, directory: str) -> DataFrame:
    documents = read(spark, directory, "pages").select("page_id", "url", "html")
    return pages.extract(documents).select("page_id", "url", "text", "n_chars")


def op10_ngram(spark: SparkSession, directory: str) -> DataFrame:
    return ngram.score(read(spark, directory, "documents"))


def op11_spelling(spark: SparkSession, directory: str) -> DataFrame:
    return spelling.variants(spelling.words(read(spark, directory, "documents")), spelling.LEAST_LENGTH)


def op12_urls(spark: SparkSession, directory: str) -> DataFrame:
    return urls.judged(read(spark, directory, "pages").select("page_id", "url")).drop("url")


def op13_dialogue(spark: SparkSession, directory: str) -> DataFrame:
    turns = dialogue.damaged(read(spark, directory, "conversations"))
    return dialogue.audits(turns, turns["present"])


QUERIES: dict[str, Query] = {
    "op1_fertility": op1_fertility,
    "op2_toxicity": op2_toxicity,
    "op3_topk": op3_topk,
    "op4_mixing": op4_mixing,
    "op5_jaccard": op5_jaccard,
    "op6_varbyte": op6_varbyte,
    "op7_suffix": op7_suffix,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_pages": op9_pages,
    "op10_ngram": op10_ngram,
    "op11_spelling": op11_spelling,
    "op12_urls": op12_urls,
    "op13_dialogue": op13_dialogue,
}

TOP_SQL = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM (SELECT DISTINCT * FROM whole WHERE vec_id % 50 = 0) q
    JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored
QUALIFY rank <= 5
"""

ORACLES: dict[str, str] = {"op3_topk": TOP_SQL, "op11_spelling": SPELLING_SQL, "op12_urls": URL_SQL, "op13_dialogue": REPAIR_SQL}
