"""Stored sketches per window: quantiles and distinct counts of any range of time without a scan of the log.

`window_sketches` reads a log once and keeps, for every band of windows, the rows, nulls, a quantile sketch of each
integer column and a distinct sketch of each chosen column. A range is answered by merging the sketches of its bands: a
few kilobytes per band and column, whatever the number of events. Runs of logs are stacked; sketches of one band from
several runs merge like those of several bands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.contracts import WINDOW_SECONDS
from eventloom.functions.columns import integer_columns, time_window
from eventloom.functions.ranks import union_all
from eventloom.operators.quality import QUANTILES
from eventloom.sources.layout import read_range, write_clustered

#: Values a quantile sketch keeps (rank error about 0.13 %) and log2 of the buckets of a distinct sketch (error about 1.6 %).
QUANTILE_SIZE, DISTINCT_BITS = 2048, 12
RANK_ERROR, DISTINCT_ERROR = 0.004, 0.05


def window_sketches(log: DataFrame, distinct: list[str], *, time: str = "time", seconds: int = WINDOW_SECONDS, band: int = 24) -> DataFrame:
    """(first_window, column_name, rows, nulls, quantile_sketch, distinct_sketch) per band of `band` windows and column.

    Events without a time have a row of their own, with first_window null. The grouping is by band, folded in the map
    tasks: a band with a third of all events moves one sketch per task.
    """
    numbers = integer_columns(log)
    names = list(dict.fromkeys([*numbers, *distinct]))
    first = (F.floor(time_window(time, seconds) / band) * band).cast("bigint").alias("first_window")
    measures = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(names):
        measures.append(F.count_if(F.col(c).isNull()).alias(f"nulls_{i}"))
        if c in numbers:
            measures.append(F.kll_sketch_agg_bigint(F.col(c).cast("bigint"), QUANTILE_SIZE).alias(f"quantile_{i}"))
        if c in distinct:
            measures.append(F.hll_sketch_agg(F.col(c).cast("string"), DISTINCT_BITS).alias(f"distinct_{i}"))
    none = F.lit(None).cast("binary")
    cells = [
        F.struct(
            F.lit(c).alias("column_name"), F.col(f"nulls_{i}").alias("nulls"),
            (F.col(f"quantile_{i}") if c in numbers else none).alias("quantile_sketch"),
            (F.col(f"distinct_{i}") if c in distinct else none).alias("distinct_sketch"),
        )
        for i, c in enumerate(names)
    ]
    return log.groupBy(first).agg(*measures).select("first_window", "rows", F.inline(F.array(*cells)))


def write_sketches(sketches: DataFrame, path: str) -> None:
    """Stored by time, so that a range opens only its files."""
    write_clustered(sketches, path, ["first_window"])


def profile_range(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows, nulls, quantiles and distinct counts per column over the bands that begin within first..last."""
    return merged(read_range(spark, path, {"first_window": (first, last)}) if (first, last) != (None, None) else spark.read.parquet(path))


def merged(sketches: DataFrame) -> DataFrame:
    """column_name, row_count, missing_count, the reported quantiles (null without values), distinct_count (null if not kept)."""
    folded = sketches.groupBy("column_name").agg(
        F.sum("rows").alias("row_count"), F.sum("nulls").alias("missing_count"),
        F.kll_merge_agg_bigint("quantile_sketch", QUANTILE_SIZE).alias("quantile_sketch"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.count("quantile_sketch").alias("kept"), F.count("distinct_sketch").alias("counted"),
    )
    some = F.when((F.col("kept") > 0) & (F.col("row_count") > F.col("missing_count")), F.col("quantile_sketch"))
    quantiles = [F.kll_sketch_get_quantile_bigint(some, F.lit(p)).alias(n) for n, p in QUANTILES.items()]
    distinct = F.when(F.col("counted") > 0, F.hll_sketch_estimate("distinct_sketch")).alias("distinct_count")
    return folded.select("column_name", "row_count", "missing_count", *quantiles, distinct)


def held_against(profile: DataFrame, log: DataFrame, distinct: list[str]) -> DataFrame:
    """column_name, row_count, missing_count, distinct_count (exact), and whether quantiles and distinct counts are within their errors."""
    found = {r.column_name: r for r in profile.collect()}  # a row per column
    cells = []
    for c, r in found.items():
        value, n = F.col(c), F.count(F.col(c))
        ranks = [F.lit(True)]
        for name, p in QUANTILES.items() if r["median"] is not None else ():
            below, upto = F.count_if(value < r[name]), F.count_if(value <= r[name])
            ranks.append((below <= (p + RANK_ERROR) * n) & (upto >= (p - RANK_ERROR) * n))
        exact = F.count_distinct(value) if c in distinct else F.lit(None).cast("bigint")
        near = F.abs(exact - F.lit(r["distinct_count"])) <= DISTINCT_ERROR * exact if c in distinct else F.lit(True)
        inside = ranks[0]
        for test in ranks[1:]:
            inside = inside & test
        cells.append(F.struct(
            F.lit(c).alias("column_name"), F.lit(r["row_count"]).cast("bigint").alias("row_count"), F.lit(r["missing_count"]).cast("bigint").alias("missing_count"),
            exact.alias("distinct_count"), (inside & near).alias("within_error"),
        ))
    if not cells:
        return log.sparkSession.createDataFrame([], "column_name STRING, row_count BIGINT, missing_count BIGINT, distinct_count BIGINT, within_error BOOLEAN")
    return union_all([log.agg(cell.alias("cell")).select("cell.*") for cell in cells])
