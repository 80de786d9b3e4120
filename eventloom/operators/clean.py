"""Cleaning of the raw logs. Every cleaner is one projection and keeps every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from eventloom.contracts import SCHEMAS
from eventloom.functions.columns import success_flag


def trim_strings(df: DataFrame) -> DataFrame:
    return df.select(*[
        F.trim(f.name).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f.name) for f in df.schema.fields
    ])


def _tidy(df: DataFrame, source: str, **computed: Column) -> DataFrame:
    """Trim text and bring numbers to their declared type (bad text becomes null), then set `computed`."""
    columns = {}
    declared = {f.name: f.dataType for f in SCHEMAS[source].fields}
    for field in df.schema.fields:
        wanted = declared.get(field.name, field.dataType)
        text = isinstance(wanted, StringType)
        columns[field.name] = F.trim(field.name) if text else F.col(field.name).try_cast(wanted)
    columns.update(computed)
    return df.select(*[c.alias(name) for name, c in columns.items()])


def clean_auth(df: DataFrame) -> DataFrame:
    """Adds success_flag; an unknown outcome counts as no success."""
    return _tidy(df, "auth", success_flag=success_flag(F.trim("success")))


def clean_flows(df: DataFrame) -> DataFrame:
    """Ports stay text: they can be symbols."""
    return _tidy(df, "flows")


def clean_dns(df: DataFrame) -> DataFrame:
    return _tidy(df, "dns")


def clean_proc(df: DataFrame) -> DataFrame:
    return _tidy(df, "proc", event_type=F.upper(F.trim("event_type")))


def clean_redteam(df: DataFrame) -> DataFrame:
    return _tidy(df, "redteam", redteam_flag=F.lit(1))


CLEANERS = {
    "auth": clean_auth,
    "flows": clean_flows,
    "dns": clean_dns,
    "proc": clean_proc,
    "redteam": clean_redteam,
}


def clean(df: DataFrame, source: str) -> DataFrame:
    return df.transform(CLEANERS[source])


def ensure_success_flag(df: DataFrame) -> DataFrame:
    """For cleaned tables from elsewhere: add success_flag unless it is there already."""
    return df if "success_flag" in df.columns else df.withColumn("success_flag", success_flag("success"))
