"""Lines that do not fit their log: one parse, two sinks.

`parsed_or_refused` scans a log once and gives every line a verdict: `kept` rows have their fields, `refused` ones their
text and the reason. `write_split` writes both in one job, to a folder each, so the text is not parsed again for either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from eventloom.contracts import SCHEMAS
from eventloom.operators.clean import clean
from eventloom.sources.raw import read_raw

LINE, REASON, VERDICT = "line", "reason", "verdict"
#: A comma outside quotes.
_COMMA = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def reason(source: str, line: str = LINE) -> Column:
    """Why a line does not fit: its number of fields, or the first field that is no number; null for a null line."""
    fields = SCHEMAS[source].fields
    parts = F.split(F.col(line), _COMMA)
    found = F.lit("unreadable")
    for i, field in reversed(list(enumerate(fields))):
        if not isinstance(field.dataType, StringType):
            text = F.get(parts, F.lit(i))
            bad = (text != "") & text.try_cast(field.dataType).isNull()
            found = F.when(bad | text.rlike(r"^\s|\s$"), f"{field.name} is no number").otherwise(found)
    sizes = F.when(F.size(parts) < len(fields), "too few fields").when(F.size(parts) > len(fields), "too many fields")
    return F.when(F.col(line).isNotNull(), F.coalesce(sizes, found))


def parsed_or_refused(spark: SparkSession, source: str, path: str | list[str], **scan) -> DataFrame:
    """The cleaned columns of the log, `line` and `reason` (null for rows that fit), and `verdict`."""
    raw = read_raw(spark, source, path, corrupt_column=LINE, **scan)
    cleaned = clean(raw.drop(LINE), source).columns
    aside = F.struct(LINE, reason(source).alias(REASON)).alias("aside")  # a struct, so the text is not trimmed
    tidy = clean(raw.select(*raw.drop(LINE).columns, aside), source)
    verdict = F.when(F.col(f"aside.{LINE}").isNull(), "kept").otherwise("refused").alias(VERDICT)
    return tidy.select(*cleaned, f"aside.{LINE}", f"aside.{REASON}", verdict)


def write_split(rows: DataFrame, path: str) -> None:
    """Both sinks in one job: `path`/verdict=kept and `path`/verdict=refused."""
    rows.write.mode("overwrite").partitionBy(VERDICT).parquet(path)


def read_kept(spark: SparkSession, path: str, source: str) -> DataFrame:
    """The rows that fit, with the columns of the cleaned log."""
    fields = clean(spark.createDataFrame([], SCHEMAS[source]), source).schema.fields
    return _side(spark, path, "kept", fields)


def read_refused(spark: SparkSession, path: str) -> DataFrame:
    """line and reason of the others."""
    return _side(spark, path, "refused", [StructField(n, StringType()) for n in (LINE, REASON)])


def _side(spark: SparkSession, path: str, verdict: str, fields: list[StructField]) -> DataFrame:
    """The files of the other verdict are not opened; a side without rows has none."""
    schema = StructType([*fields, StructField(VERDICT, StringType())])
    return spark.read.schema(schema).parquet(path).filter(F.col(VERDICT) == verdict).drop(VERDICT)
