"""From raw logs to cleaned tables with a quality report each."""

from __future__ import annotations

from pyspark.sql import SparkSession

from eventloom.contracts import SOURCES
from eventloom.operators.clean import clean
from eventloom.operators.quality import log_report, write_measured
from eventloom.sources.raw import random_rows, read_raw
from eventloom.sources.refused import parsed_or_refused, read_kept, write_split
from eventloom.sources.tables import DEFAULT_FORMAT, read_back, write_report


def ingest_log(
    spark: SparkSession,
    source: str,
    raw: str,
    table: str,
    report: str | None = None,
    refused: str | None = None,
    *,
    fmt: str = DEFAULT_FORMAT,
    sample: bool = False,
    exact_quantiles: bool = False,
    **scan,
) -> None:
    """Clean one log and write it; the text is parsed once, and all but the copies is measured while it is written.

    With `refused`, lines that do not fit the log go there with the reason and do not come into the table; without it their
    unreadable fields are null.
    """
    if refused:
        write_split(parsed_or_refused(spark, source, raw, **scan), refused)
        cleaned = random_rows(read_kept(spark, refused, source), enabled=sample)
    else:
        cleaned = clean(random_rows(read_raw(spark, source, raw, **scan), enabled=sample), source)
    rows, measured = write_measured(cleaned, table, source, fmt)
    stored = read_back(cleaned, table, fmt, rows)
    if report:
        write_report(log_report(stored, source, exact_quantiles, measured), report)


def ingest(spark: SparkSession, raw: dict[str, str], tables: str, reports: str, refused: str | None = None, **options) -> None:
    """All logs; tables, reports and refused lines go to a folder per source."""
    for source in SOURCES:
        aside = f"{refused}/{source}" if refused else None
        ingest_log(spark, source, raw[source], f"{tables}/{source}", f"{reports}/{source}", aside, **options)
