"""Byte-level BPE: texts to token ids and back.

The tokenizers library encodes, over Arrow batches. Each byte of a text stands as a printable character in the
vocabulary; decoding takes these characters back to bytes, joins the bytes of all tokens, and only then reads characters,
so a character whose bytes lie in several tokens comes back whole.

Columns of the input that are named like a result give way to it. Nulls and empty texts have no tokens. Repeated rows are encoded each for itself. Very long texts are encoded whole.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import append_columns
from eventloom.llm.vocab import Memory, encode_texts, library_ids, public_path, public_pattern, rank_tokenizer, read_ranks, token_bytes, token_names

VOCABULARY = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> tuple[Memory, list[bytes]]:
    """The encoder, and the bytes of every id, read back from its vocabulary. A worker builds it once."""
    tokenizer = rank_tokenizer(read_ranks(path), pattern)
    return Memory(library_ids(tokenizer)), token_bytes(tokenizer.get_vocab())


def _offsets(ids: np.ndarray, tokens: list[bytes]) -> tuple[list[int], list[int]]:
    """Where each token starts, in bytes and in characters; inside a split character, the character's own place."""
    pieces = [tokens[i] for i in ids.tolist()]
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1] if len(pieces) else sizes
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    begun = np.cumsum((data & 0xC0) != 0x80)  # characters begun up to and with each byte
    return starts.tolist(), (begun[starts] - 1).tolist() if len(pieces) else []


def encode(df: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None, offsets: bool = False) -> DataFrame:
    """`df` with `ids`; with `offsets` also `byte_starts` and `char_starts` of the tokens."""
    path, pattern = path or public_path(VOCABULARY), pattern or public_pattern()

    def build():
        memory, tokens = _codec(path, pattern)

        def run(texts: list[str]) -> dict[str, list]:
            ids = [np.frombuffer(b, dtype="<u4") for b in encode_texts(memory, texts)]
            out = {"ids": [i.tolist() for i in ids]}
            if offsets:
                places = [_offsets(i, tokens) for i in ids]
                out |= {"byte_starts": [p[0] for p in places], "char_starts": [p[1] for p in places]}
            return out

        return run

    extra = ", byte_starts ARRAY<BIGINT>, char_starts ARRAY<BIGINT>" if offsets else ""
    return append_columns(df, text, "ids ARRAY<INT>" + extra, build)


def decode(df: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """`df` with `decoded`, the bytes of the tokens, and `decoded_text`; a byte that is no character becomes U+FFFD.

    A null list decodes to nothing.
    """
    import pyarrow as pa
    from pyspark.sql.types import BinaryType, StringType, StructField, StructType

    path = path or public_path(VOCABULARY)
    new = ("decoded", "decoded_text")
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in new])
    place = kept.columns.index(ids)
    schema = StructType([*kept.schema.fields, StructField("decoded", BinaryType()), StructField("decoded_text", StringType())])

    def run(batches):
        tokens = _tokens(path)
        for batch in batches:
            joined = [b"".join(map(tokens.__getitem__, row or [])) for row in batch.column(place).to_pylist()]
            arrays = [pa.array(joined, pa.binary()), pa.array([b.decode("utf-8", "replace") for b in joined], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *new])

    return kept.mapInArrow(run, schema)


@lru_cache(maxsize=2)
def _tokens(path: str) -> list[bytes]:
    """The bytes of every id: what its name in the vocabulary stands for."""
    return token_bytes(token_names(read_ranks(path)))


def digests(df: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """`df` with `n_tokens`, `ids_sha256` and `decoded_sha256`: each text encoded, its ids decoded, both hashed.

    The same steps as `encode` and `decode`, in one pass and without the ids leaving the worker.
    """
    path, pattern = path or public_path(VOCABULARY), pattern or public_pattern()

    def build():
        memory, tokens = _codec(path, pattern)

        def run(texts: list[str]) -> dict[str, list]:
            counts, ids_hash, bytes_hash = [], [], []
            for ids in encode_texts(memory, texts):
                back = b"".join(map(tokens.__getitem__, memoryview(ids).cast("I")))
                counts.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                bytes_hash.append(hashlib.sha256(back).hexdigest())
            return {"n_tokens": counts, "ids_sha256": ids_hash, "decoded_sha256": bytes_hash}

        return run

    return append_columns(df, text, "n_tokens BIGINT, ids_sha256 STRING, decoded_sha256 STRING", build)
