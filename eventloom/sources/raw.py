"""Raw event logs: compressed comma-separated text without a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventloom.contracts import SCHEMAS

# Size of the first look, share and seed of the random one.
FIRST_ROWS = 100_000
SAMPLE_FRACTION = 0.2
SAMPLE_SEED = 123


def read_raw(
    spark: SparkSession,
    source: str,
    path: str | list[str],
    *,
    strip_on_read: bool = False,
    corrupt_column: str | None = None,
    spread: int | None = None,
) -> DataFrame:
    """Scan one log with its declared schema; unreadable fields and missing trailing ones are null.

    strip_on_read   ignore blanks around fields while parsing, so " 3" is the number 3
    corrupt_column  keep the text of lines that do not fit the schema in this column
    spread          number of partitions to deal the rows out to right after the scan. A gzip file is read
                    by one task, so few big files need it and many files do not.
    """
    schema = SCHEMAS[source]
    reader = spark.read.option("header", False).option("sep", ",")
    if strip_on_read:
        reader = reader.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    if corrupt_column:
        schema = type(schema)(list(schema.fields)).add(corrupt_column, "string")
        reader = reader.option("columnNameOfCorruptRecord", corrupt_column)
    df = reader.schema(schema).csv(path)
    return df.repartition(spread) if spread else df


def first_rows(df: DataFrame, n: int = FIRST_ROWS) -> DataFrame:
    return df.limit(n)


def random_rows(
    df: DataFrame, fraction: float = SAMPLE_FRACTION, seed: int = SAMPLE_SEED, enabled: bool = True
) -> DataFrame:
    """Sample without replacement, or everything when switched off."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed) if enabled else df
