"""Order statistics and running totals that never sort a whole table in one task."""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

SKETCH_SIZE = 4096  # rank error of about 0.0007
SKETCH_SHARDS = 64
LARGEST_SKETCH = 65_535
FEW = 50_000  # rows of a range that one task ranks
SIDE_BY_SIDE = 8  # columns of one aggregate; the code of many more is too long to be compiled, and each row takes many times longer


def column_groups(columns: list[str]) -> list[list[str]]:
    """The columns in groups that one aggregate takes side by side; a scan of a group reads its columns only."""
    return [columns[i : i + SIDE_BY_SIDE] for i in range(0, len(columns), SIDE_BY_SIDE)]


def unpivot_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value) rows without nulls and NaN."""
    long = df.select(*_values(df, columns)).unpivot([], columns, "column_name", "value")
    return long.filter(F.col("value").isNotNull())


def _values(df: DataFrame, columns: list[str]) -> list[Column]:
    """The columns in one type: integers stay integers if all are, else all are doubles, NaN being null."""
    whole = all(isinstance(df.schema[c].dataType, IntegralType) for c in columns)
    if whole:
        return [F.col(c).cast("bigint").alias(c) for c in columns]
    doubles = {c: F.col(c).cast("double") for c in columns}
    return [F.when(~F.isnan(v), v).alias(c) for c, v in doubles.items()]


def _extent(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n, lo, hi) of the columns that have values, from an aggregate per group of columns side by side."""
    values, found = df.select(*_values(df, columns)), []
    for group in column_groups(columns):
        row = values.agg(*[
            m for i, c in enumerate(group)
            for m in (F.count(c).alias(f"n_{i}"), F.min(c).alias(f"lo_{i}"), F.max(c).alias(f"hi_{i}"))
        ])
        cells = [
            F.struct(F.lit(c).alias("column_name"), *[F.col(f"{m}_{i}").alias(m) for m in ("n", "lo", "hi")])
            for i, c in enumerate(group)
        ]
        found.append(row.select(F.inline(F.array(*cells))))
    return union_all(found).filter("n > 0")


def _scaled(value: Column) -> Column:
    """A number that never decreases as the value grows and that spreads all magnitudes evenly."""
    size = F.abs(value)
    magnitude = F.least(F.log2(size), F.lit(1025.0)) + 1100  # positive for the smallest number as well
    return F.when(size > 0, F.signum(value) * magnitude).otherwise(0.0)


def _with_scale(ranges: DataFrame) -> DataFrame:
    """The ranges with what `_bin` needs of their ends, so that it is not worked out again for every value."""
    ends = {f"scaled_{c}": _scaled(F.col(c).cast("double")) for c in ("lo", "hi")}
    return ranges.withColumns(ends).withColumn("near", F.abs(F.col("scaled_hi") - F.col("scaled_lo")) < 2)


def _bin(bins: int) -> Column:
    """Bin of `value` within [lo, hi]; never decreases as the value grows.

    Bins have equal width on the scale of magnitudes, or, where the range lies within two powers of two, on its own.
    """
    value, low, high = (F.col(c).cast("double") for c in ("value", "lo", "hi"))
    scaled_low, scaled_high = F.col("scaled_lo"), F.col("scaled_hi")
    place = F.when(F.col("near"), (value - low) / (high - low)).otherwise((_scaled(value) - scaled_low) / (scaled_high - scaled_low))
    last = F.lit(bins - 1).cast("bigint")
    return F.when(high > low, F.least(F.floor(place * bins), last)).otherwise(F.lit(0).cast("bigint"))


def _holds(rank: str) -> Column:
    """Whether the bin or value covers the rank (counted from 0)."""
    return (F.col(rank) >= F.col("start")) & (F.col(rank) < F.col("start") + F.col("size"))


_ARROW = {"STRING": pa.string(), "BIGINT": pa.int64(), "DOUBLE": pa.float64()}


def _few_rows(spark: SparkSession, rows: list[tuple], fields: str) -> DataFrame:
    """Rows of the driver as a part of the plan; `createDataFrame` of a list would start Python workers for them."""
    kinds = dict(field.split() for field in fields.split(", "))
    columns = {n: pa.array([r[i] for r in rows], _ARROW[k.upper()]) for i, (n, k) in enumerate(kinds.items())}
    return spark.createDataFrame(pa.table(columns))


def _doubles(numbers: list[float]) -> Column:
    return F.array(*[F.lit(float(n)) for n in numbers])


def exact_quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float], bins: int = 2048, few: int = FEW
) -> DataFrame:
    """Exact linearly interpolated quantiles: (column_name, probability, quantile).

    Instead of gathering all values of a column in one place, count them per bin, keep only the bins that hold a wanted
    rank, and cut those bins again until each holds at most `few` rows or one value. Each pass is a scan whose shuffle
    carries at most `bins` rows per column, range and task; the last step ranks the few values left. A pass reads only the
    columns with a range to cut, and what lies outside is dropped before it is unpivoted; a range of one value is counted
    already and needs no pass. Bins follow magnitudes first, so a column with a heavy tail is cut as fast as a flat one. A
    value that a third of the rows share costs nothing extra: it is one counted value everywhere. Only ranges that hold a
    wanted rank reach the driver and are broadcast: two per column and probability at most.
    """
    spark, values = df.sparkSession, df.select(*_values(df, columns))
    ranges = [(r.column_name, 0, r.n, r.lo, r.hi) for r in _extent(df, columns).collect()]  # a row per column
    kind = values.dtypes[0][1]
    wanted = []
    for column, _, n, _, _ in ranges:
        for p in probabilities:
            position = p * (n - 1)
            wanted.append((column, p, position - math.floor(position), math.floor(position), math.ceil(position)))
    schema = "wanted_column STRING, probability DOUBLE, share DOUBLE, low_rank BIGINT, high_rank BIGINT"
    asked = F.broadcast(_few_rows(spark, wanted, schema))
    same_column = F.col("column_name") == F.col("wanted_column")
    holds_low, holds_high = _holds("low_rank"), _holds("high_rank")
    fields = f"column_name STRING, start BIGINT, size BIGINT, lo {kind}, hi {kind}"
    settled: list[tuple] = []
    while large := [r for r in ranges if r not in settled and r[2] > few and r[3] < r[4]]:
        histogram = (
            _in_ranges(values, large, fields)
            .groupBy("column_name", "start", _bin(bins).alias("bin"))
            .agg(F.count("*").alias("size"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        )
        cut = _with_starts(histogram, "bin").join(asked, same_column & (holds_low | holds_high), "left_semi")
        found = [(r.column_name, r.start, r.size, r.lo, r.hi) for r in cut.collect()]
        settled += [r for r in found if r in large]  # neighbouring integers beyond what a double can tell apart
        ranges = [r for r in ranges if r not in large] + found
    single = [r for r in ranges if r[3] == r[4]]
    several = [r for r in ranges if r[3] < r[4]]
    counted = _few_rows(spark, single, fields).select("column_name", "start", F.col("lo").alias("value"), "size")
    if several:
        found = _in_ranges(values, several, fields).groupBy("column_name", "start", "value").agg(F.count("*").alias("size"))
        counted = counted.unionByName(found)
    neighbours = _with_starts(counted, "value").join(asked, same_column & (holds_low | holds_high))
    low, high = F.col("low"), F.col("high")
    return (
        neighbours.groupBy("column_name", "probability", "share")
        .agg(
            F.max(F.when(holds_low, F.col("value").cast("double"))).alias("low"),
            F.max(F.when(holds_high, F.col("value").cast("double"))).alias("high"),
        )
        .select("column_name", "probability", (low + (high - low) * F.col("share")).alias("quantile"))
    )


def _in_ranges(values: DataFrame, ranges: list[tuple], fields: str) -> DataFrame:
    """(column_name, value) of a table of values within the given ranges of its columns, which do not overlap in a column."""
    ends: dict[str, tuple] = {}
    for column, _, _, low, high in ranges:
        lowest, highest = ends.get(column, (low, high))
        ends[column] = min(low, lowest), max(high, highest)
    inside = values.select(*[F.when(F.col(c).between(F.lit(low), F.lit(high)), F.col(c)).alias(c) for c, (low, high) in ends.items()])
    long = inside.unpivot([], list(ends), "column_name", "value").filter(F.col("value").isNotNull())
    known = _with_scale(_few_rows(values.sparkSession, ranges, fields).drop("size"))
    return long.join(F.broadcast(known), "column_name").filter(F.col("value").between(F.col("lo"), F.col("hi")))


def _with_starts(counts: DataFrame, order: str) -> DataFrame:
    """Turn `start` (of the range) into the rank of the first row of each bin or value in it."""
    upto = F.sum("size").over(Window.partitionBy("column_name", "start").orderBy(order))
    return counts.withColumn("start", F.col("start") + upto - F.col("size"))


def sketch_quantiles(df: DataFrame, columns: list[str], probabilities: list[float], k: int = SKETCH_SIZE) -> DataFrame:
    """Approximate quantiles (an element of the column each): (column_name, probability, quantile).

    Sketches are merged in two steps, so the last task of a column sees a fixed number of them, however many
    tasks read the table.
    """
    values = unpivot_values(df, columns)
    kind = "bigint" if dict(values.dtypes)["value"] == "bigint" else "double"
    build, merge, read = (
        getattr(F, name.format(kind))
        for name in ("kll_sketch_agg_{}", "kll_merge_agg_{}", "kll_sketch_get_quantile_{}")
    )
    parts = df.rdd.getNumPartitions()
    shard = F.pmod(F.spark_partition_id(), F.lit(max(SKETCH_SHARDS, math.isqrt(parts))))
    merged = (
        values.withColumn("shard", shard)
        .groupBy("column_name", "shard")
        .agg(build("value", k).alias("sketch"))
        .groupBy("column_name")
        .agg(merge("sketch", k).alias("sketch"))
    )
    asked = _doubles(probabilities)
    answers = F.arrays_zip(asked.alias("probability"), read("sketch", asked).cast("array<double>").alias("quantile"))
    return merged.select("column_name", F.inline(answers).alias("probability", "quantile"))


def running_totals(
    df: DataFrame, order: str, measures: list[str], descending: bool = True, ranges: int | None = None
) -> DataFrame:
    """Add `<measure>_upto`: the sum over all rows up to and including each one. `order` must be unique.

    The rows are cut into ranges of about equal size, as many as a shuffle has partitions unless `ranges` says otherwise;
    the cut points come from a sketch. Each range is dealt to a partition of its own and summed there, in order, and the
    totals of the ranges before it are added. `df` is read three times, so pass a written table.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sketched = sketch_quantiles(df, [order], [i / n for i in range(1, n)], k=min(max(8 * n, 1024), LARGEST_SKETCH)) if n > 1 else None
    found = sorted({r.quantile for r in sketched.collect() if math.isfinite(r.quantile)}) if sketched else []  # a number per range
    if found:
        cutter = Bucketizer(splits=[-math.inf, *found, math.inf], inputCol=order, outputCol="bucket")
        parts = cutter.transform(df).withColumn("bucket", F.col("bucket").cast("int"))
    else:
        parts = df.withColumn("bucket", F.lit(0))
    if descending:
        parts = parts.withColumn("bucket", F.lit(len(found)) - F.col("bucket"))
    inside = Window.partitionBy("bucket").orderBy((F.desc if descending else F.asc)(order))
    offsets = _offsets(parts.groupBy("bucket").agg(*[F.sum(m).alias(m) for m in measures]), measures, math.isqrt(len(found)) + 1)
    dealt = parts.repartitionById(len(found) + 1, "bucket")  # a range is a partition, so the window moves nothing
    upto = [(F.sum(m).over(inside) + F.col(f"{m}_before")).alias(f"{m}_upto") for m in measures]
    return dealt.join(F.broadcast(offsets), "bucket").select(*df.columns, *upto)


def _offsets(totals: DataFrame, measures: list[str], block: int) -> DataFrame:
    """(bucket, <measure>_before): sums over all earlier buckets, block by block of buckets and then over the blocks."""
    blocks = totals.withColumn("block", F.floor(F.col("bucket") / block).cast("int"))
    earlier = Window.partitionBy("block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    over_blocks = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # the root of the number of ranges

    def before(window, name: str) -> list[Column]:
        return [F.coalesce(F.sum(m).over(window), F.lit(0)).alias(f"{m}_{name}") for m in measures]

    whole = blocks.groupBy("block").agg(*[F.sum(m).alias(m) for m in measures]).select("block", *before(over_blocks, "blocks"))
    parts = blocks.select("bucket", "block", *before(earlier, "inside")).join(F.broadcast(whole), "block")
    return parts.select("bucket", *[(F.col(f"{m}_inside") + F.col(f"{m}_blocks")).alias(f"{m}_before") for m in measures])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
