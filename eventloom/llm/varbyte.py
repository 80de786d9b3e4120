"""Token ids on disk: ids in order of frequency, in 1 to 4 whole bytes each, with the lengths kept apart.

The commonest id is written as 0, the next one as 1, and so on, so common ids take one byte. A control byte holds the
lengths of four ids, two bits each; data bytes follow in a stream of their own. A decoder looks a control byte up in a
table and gets four lengths at once; with numpy it does so for a whole block.

File format (Parquet, so that any store takes it): `ranks` has a row per id, `blocks` has rows of whole documents in
ascending order: `part` and `block` (their order), `doc_ids`, `counts` (ids per document), `control`, `data`.

Null and empty texts have the end id only. Null doc_ids come first. Repeated doc_ids are documents of their own, ordered
by length and content. A document is never cut: a very long one makes a long block.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.common import append_columns, stage
from eventloom.llm.vocab import WORDS, Memory, encode_texts, ended_ids, file_tokenizer, public_path

VOCABULARY = "word_bpe_49k.json"
END = 1
#: A block ends with the document that brings it to so many ids.
BLOCK_IDS = 1 << 16

#: Words whose ids a worker remembers, per generation.
REMEMBERED_WORDS = 1 << 19

#: The four lengths that each control byte stands for.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, dtype="<u4")
    lengths = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    padded[: len(values)] = lengths - 1
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    used = np.arange(4, dtype=np.uint8) < lengths[:, None]
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The `n` values of a block."""
    lengths = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    values = np.zeros((n, 4), dtype=np.uint8)
    values[np.arange(4, dtype=np.uint8) < lengths[:, None]] = np.frombuffer(data, dtype=np.uint8)
    return values.reshape(-1).view("<u4")


@lru_cache(maxsize=1)
def _memory(path: str) -> Memory:
    return Memory(ended_ids(path), REMEMBERED_WORDS)


def tokenize(df: DataFrame, text: str = "text", path: str | None = None, end: int = END) -> DataFrame:
    """`df` with `ids` (binary, two or four bytes an id as the vocabulary needs) and `n_tokens`, both with the end id."""
    path = path or public_path(VOCABULARY)
    width = "<u2" if max(file_tokenizer(path).get_vocab_size(), end + 1) <= 1 << 16 else "<u4"
    last = np.array([end], dtype="<u4").tobytes()

    def build():
        memory = _memory(path)

        def run(texts: list[str]) -> dict[str, list]:
            ids = [np.frombuffer(b + last, dtype="<u4") for b in encode_texts(memory, texts, WORDS)]
            return {"ids": [i.astype(width).tobytes() for i in ids], "n_tokens": [len(i) for i in ids]}

        return run

    return append_columns(df, text, "ids BINARY, n_tokens BIGINT", build)


def _ids(binary: bytes, n: int) -> np.ndarray:
    return np.frombuffer(binary, dtype="<u2" if len(binary) == 2 * n else "<u4")


def id_counts(tokens: DataFrame) -> DataFrame:
    """How often each id occurs in all documents."""

    def run(batches):
        total = np.zeros(1, dtype=np.int64)
        for batch in batches:
            texts = [_ids(binary, n) for binary, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            found = np.bincount(np.concatenate(texts)) if texts else total[:0]
            if len(found) > len(total):
                total = np.concatenate([total, np.zeros(len(found) - len(total), dtype=np.int64)])
            total[: len(found)] += found
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "count"])

    parts = tokens.select("ids", "n_tokens").mapInArrow(run, "id BIGINT, count BIGINT")
    return parts.groupBy("id").agg(F.sum("count").alias("count"))


def write(tokens: DataFrame, path: str) -> None:
    """Write tokenized documents (`doc_id`, `ids`, `n_tokens`) as files in this format."""
    spark = tokens.sparkSession
    counts = id_counts(tokens).toPandas()  # a row per id of the vocabulary at most
    ranked = counts.sort_values(["count", "id"], ascending=[False, True])["id"].to_numpy()
    spark.createDataFrame(pd.DataFrame({"rank": np.arange(len(ranked)), "id": ranked}), "rank BIGINT, id BIGINT").coalesce(
        1
    ).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(int(ranked.max(initial=0)) + 1, dtype="<u4")
    rank_of[ranked] = np.arange(len(ranked), dtype="<u4")

    def row(part: int, block: int, docs: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        control, data = pack(rank_of[np.concatenate(parts)])
        columns = [[part], [block], [docs], [[len(p) for p in parts]], [control], [data]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    names = ["part", "block", "doc_ids", "counts", "control", "data"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]

    def run(batches):
        part, block, docs, parts, held = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for doc, binary, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                docs.append(doc)
                parts.append(_ids(binary.as_py(), n))
                held += n
                if held >= BLOCK_IDS:
                    yield row(part, block, docs, parts)
                    block, docs, parts, held = block + 1, [], [], 0
        if docs:
            yield row(part, block, docs, parts)

    order = ["doc_id", "n_tokens", "content"]
    sorted_tokens = (
        tokens.select("doc_id", "ids", "n_tokens", F.xxhash64("ids").alias("content"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "ids", "n_tokens")
    )
    schema = "part BIGINT, block BIGINT, doc_ids ARRAY<BIGINT>, counts ARRAY<BIGINT>, control BINARY, data BINARY"
    sorted_tokens.mapInArrow(run, schema).write.parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of such files: `doc_id`, `start` (ids of all documents before), `n_tokens`, `ids` (32 bits each)."""
    return _decoded(spark, path, lambda ids: ids.tobytes(), "ids BINARY", pa.binary())


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """The same with the crc32 of the ids in place of the ids."""
    return _decoded(spark, path, lambda ids: zlib.crc32(ids.tobytes()), "ids_crc32 BIGINT", pa.int64())


def _decoded(spark: SparkSession, path: str, value, field: str, kind: pa.DataType) -> DataFrame:
    ranked = spark.read.parquet(f"{path}/ranks").toPandas()
    id_of = np.zeros(len(ranked) + 1, dtype="<u4")
    id_of[ranked["rank"].to_numpy()] = ranked["id"].to_numpy()
    name = field.split()[0]

    def run(batches):
        for batch in batches:
            for part, block, docs, counts, control, data in zip(*[c.to_pylist() for c in batch.columns]):
                ends = np.cumsum(counts)
                ids = id_of[unpack(control, data, int(ends[-1]))]
                values = [value(ids[e - n : e]) for e, n in zip(ends.tolist(), counts)]
                size = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * size, pa.int64()), pa.array([block] * size, pa.int64()), pa.array(docs, pa.int64()),
                        pa.array(ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(values, kind),
                    ],
                    ["part", "block", "doc_id", "inside", "n_tokens", name],
                )

    blocks = spark.read.parquet(f"{path}/blocks")
    schema = f"part BIGINT, block BIGINT, doc_id BIGINT, inside BIGINT, n_tokens BIGINT, {field}"
    documents = blocks.select("part", "block", "doc_ids", "counts", "control", "data").mapInArrow(run, schema)
    totals = blocks.select("part", "block", F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b).alias("n"))
    # a row per file part in the window over all, a row per block of one part in the other
    parts = totals.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    earlier = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("block_start")).join(parts, "part")
    return documents.join(starts, ["part", "block"]).select(
        "doc_id", (F.col("part_start") + F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", name
    )


def round_trip(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Tokenize `df` (`doc_id`, `text`), write it below `path`, read it back."""
    write(stage(tokenize(df.select("doc_id", text), text).select("doc_id", "ids", "n_tokens"), "token-ids"), path)
    return read_digests(df.sparkSession, path)
