"""Cleaned tables, feature tables and reports at rest."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DEFAULT_FORMAT = "parquet"


def read_table(spark: SparkSession, path: str, fmt: str = DEFAULT_FORMAT) -> DataFrame:
    return spark.read.format(fmt).load(path)


def write_table(
    df: DataFrame, path: str, fmt: str = DEFAULT_FORMAT, partition_by: list[str] | None = None, mode: str = "overwrite"
) -> None:
    writer = df.write.format(fmt).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Text copy with a header line in every part file."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv_export(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Read a text copy back by declared schema; a missing path is an error."""
    return spark.read.option("header", True).schema(schema).csv(path)


def write_counted(df: DataFrame, path: str, fmt: str = DEFAULT_FORMAT) -> int:
    """Write a table and return how many rows went in, counted while they are written."""
    seen = Observation()
    write_table(df.observe(seen, F.count(F.lit(1)).alias("rows")), path, fmt)
    return seen.get["rows"]


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def read_back(df: DataFrame, path: str, fmt: str = DEFAULT_FORMAT, rows: int | None = None) -> DataFrame:
    """Reload a table just written from `df` and fail when its schema is another, or its number of rows if `rows` is given."""
    stored = read_table(df.sparkSession, path, fmt)
    expected = [(f.name, f.dataType) for f in df.schema.fields]
    actual = [(f.name, f.dataType) for f in stored.schema.fields]
    if expected != actual:
        raise ValueError(f"schema of {path} is {stored.schema.simpleString()}, expected {df.schema.simpleString()}")
    if rows is not None and (found := stored.count()) != rows:
        raise ValueError(f"{path} holds {found} rows, expected {rows}")
    return stored


def read_back_report(spark: SparkSession, paths: dict[str, str], fmt: str = DEFAULT_FORMAT) -> list[dict]:
    """Row count and schema of every written table, by name."""
    tables = {name: read_table(spark, path, fmt) for name, path in paths.items()}
    return [{"name": n, "rows": t.count(), "schema": t.schema.simpleString()} for n, t in tables.items()]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder all executors share; a machine-local one only where the master is this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="eventloom-")
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def drop_partitions(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of a table that hold nothing any more."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that is no longer read."""
    drop_partitions(df.sparkSession, sorted({name.rpartition("/")[0] for name in df.inputFiles()}))


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and go on from the written rows."""
    path = scratch_path(df.sparkSession, label)
    write_table(df, path)
    return read_table(df.sparkSession, path)
