"""Helpers shared by the operators: texts in bounded slices, appended columns, staged tables, paths for workers."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eventloom.sources.tables import scratch_path

#: The white space between words, in the forms that `re`, Java and other engines share.
BLANK = r"\x20\x09-\x0D"
WORD = rf"[^{BLANK}]+"

#: A slice of texts that a worker holds decoded at a time, unless one text alone is longer.
SLICE_BYTES = 1 << 21


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where it lies, as `--py-files` would; harmless if it is shipped."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    environment["TOKENIZERS_PARALLELISM"] = "false"
    return spark


def read(spark: SparkSession, directory: str, table: str) -> DataFrame:
    return ready(spark).read.parquet(f"{directory}/{table}.parquet")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the folder that all executors share and go on from there: lineage ends here."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in slices of about `limit` bytes; null counts as empty."""
    if not len(texts):
        return
    sizes = texts.cast(pa.large_binary()).fill_null(b"")
    start, held = 0, 0
    for i, size in enumerate(pa.compute.binary_length(sizes).to_pylist()):
        if held and held + size > limit:
            yield start, texts.slice(start, i - start).fill_null("").to_pylist()
            start, held = i, 0
        held += size
    yield start, texts.slice(start).fill_null("").to_pylist()


def append_columns(
    df: DataFrame, text: str, fields: str, build: Callable[[], Callable[[list[str]], dict[str, list]]]
) -> DataFrame:
    """`df` with the columns that a Python function makes of each text, in Arrow batches.

    `build` runs once a task and returns the function of a slice of texts. Columns of `df` that bear one of the new names
    give way. The order of rows and their number stay.
    """
    added = StructType.fromDDL(fields)
    names = {n.lower() for n in added.names}
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names])
    schema = StructType([*kept.schema.fields, *added.fields])
    place = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = build()
        for batch in batches:
            for start, texts in text_slices(batch.column(place)):
                new = function(texts)
                old = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*old.columns, *[_array(new[f.name], f.dataType) for f in added.fields]], [*old.schema.names, *added.names]
                )

    return kept.mapInArrow(run, schema)


def _array(values, kind) -> pa.Array:
    from pyspark.sql.pandas.types import to_arrow_type

    return values if isinstance(values, pa.Array) else pa.array(values, to_arrow_type(kind))


def crc_of_id(column: str) -> Column:
    """crc32 of an id as text; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def n_words(column: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")
