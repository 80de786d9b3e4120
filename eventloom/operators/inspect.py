"""A first look at a table, on its first rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators.quality import missing_values
from eventloom.sources.raw import FIRST_ROWS, first_rows

HEAD_ROWS = 10


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def sample_profile(df: DataFrame, name: str, n: int = FIRST_ROWS, head: int = HEAD_ROWS) -> DataFrame:
    """Type and nulls of each column among the first n rows, and how many of the first few rows differ."""
    sample = first_rows(df, n)
    differing = sample.limit(head).distinct().agg(F.count("*").alias("n"))
    types = F.create_map(*[F.lit(text) for pair in df.dtypes for text in pair])
    return missing_values(sample).select(
        F.lit(name).alias("table_name"),
        "column_name",
        types[F.col("column_name")].alias("data_type"),
        F.col("total_rows").alias("sampled_rows"),
        "missing_count",
        differing.scalar().alias("distinct_head_rows"),
    )


def check_frame(df: DataFrame, name: str, show: int = 5) -> dict:
    """Columns, types, row count and the first rows, for a person at a prompt."""
    return {
        "name": name,
        "columns": df.columns,
        "schema": df.schema.simpleString(),
        "rows": df.count(),
        "preview": [row.asDict() for row in df.take(show)],
    }
