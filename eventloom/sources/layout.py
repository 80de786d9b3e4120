"""Tables laid out by a key, so that a read of a range opens only the files that can hold it.

`write_clustered` deals rows out by ranges of the key and sorts them; the least and greatest key of every file go to a
small table beside the files (`_layout`, which readers of the whole table do not see). `read_range` asks that table for
the files that meet the bounds, and leaves the bounds on the scan, so row groups inside a file are skipped as well.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.sources.tables import exists

LAYOUT = "_layout"

#: The first and last value wanted of a column, both included; None is open.
Bounds = dict[str, tuple[object | None, object | None]]


def write_clustered(df: DataFrame, path: str, by: list[str], files: int | None = None) -> None:
    """Write `df` in ranges of `by`, as many as a shuffle has partitions unless `files` says otherwise."""
    ranges = df.repartitionByRange(files, *by) if files else df.repartitionByRange(*by)
    ranges.sortWithinPartitions(*by).write.mode("overwrite").parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    extents = [m.alias(f"{name}_{c}") for c in by for name, m in (("least", F.min(c)), ("most", F.max(c)), ("nulls", F.count_if(F.col(c).isNull())))]
    layout = stored.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"), *extents)
    layout.coalesce(1).write.parquet(f"{path}/{LAYOUT}")  # a row per file


def is_clustered(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/{LAYOUT}")


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{LAYOUT}")


def within(bounds: Bounds) -> Column:
    """The rows within the bounds; a null lies within none."""
    tests = [F.col(c) >= low for c, (low, _) in bounds.items() if low is not None]
    tests += [F.col(c) <= high for c, (_, high) in bounds.items() if high is not None]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _may_hold(bounds: Bounds) -> Column:
    tests = [F.col(f"most_{c}") >= low for c, (low, _) in bounds.items() if low is not None]
    tests += [F.col(f"least_{c}") <= high for c, (_, high) in bounds.items() if high is not None]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def read_range(spark: SparkSession, path: str, bounds: Bounds) -> DataFrame:
    """The rows within `bounds` of columns that a clustered table is laid out by."""
    schema = spark.read.parquet(path).schema
    met = read_layout(spark, path).filter(_may_hold(bounds))
    files = [f"{path}/{r.file}" for r in met.select("file").collect()]  # names of the files that the scan lists anyway
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*files).filter(within(bounds))
