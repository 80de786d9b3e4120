"""Quality checks of a table. None of them changes it.

Counts, extents, nulls and moments of all columns come from one scan (`Measures`), or from none where they are taken
while the table is written. Copies of rows are counted by fingerprints of 128 bits; only rows whose fingerprint is met
again are compared in full.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from eventloom.contracts import CONTRACTS, LABEL, Contract
from eventloom.functions.columns import integer_columns, numeric_columns
from eventloom.functions.ranks import SKETCH_SIZE, column_groups, exact_quantiles, sketch_quantiles, union_all
from eventloom.sources.tables import DEFAULT_FORMAT, stage, write_table

# Reported quantiles, and the sizes of samples and top lists.
QUANTILES = {"q01": 0.01, "q25": 0.25, "median": 0.50, "q75": 0.75, "q99": 0.99}
DUPLICATE_SAMPLES = 10
TOP_VALUES = 20


def percentage(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100.0).otherwise(0.0)


def _rows_per_column(row: DataFrame, cells: dict[str, list[Column]], names: list[str]) -> DataFrame:
    """One row of aggregates to one row per column of the profiled table."""
    items = [F.struct(F.lit(c).alias("column_name"), *[v.alias(n) for v, n in zip(vs, names)]) for c, vs in cells.items()]
    return row.select(F.inline(F.array(*items)))


def overview(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.count("*").alias("row_count")).select(
        F.lit(label).alias("label"),
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
    )


def missing_values(df: DataFrame) -> DataFrame:
    """Nulls per column; blank text is not missing."""
    row = df.agg(
        F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{i}") for i, c in enumerate(df.columns)]
    )
    cells = {
        c: [F.col("rows"), F.col(f"null_{i}"), percentage(F.col(f"null_{i}"), F.col("rows"))]
        for i, c in enumerate(df.columns)
    }
    return _rows_per_column(row, cells, ["total_rows", "missing_count", "missing_pct"])


def _copies(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("copies"))


def fingerprint(columns: list[str]) -> list[Column]:
    """128 bits of a row (mark, mark2). A hash passes over nulls, so where they are goes in as well."""
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns])
    values = [F.col(c) for c in columns]
    return [F.xxhash64(nulls, *values).alias("mark"), F.xxhash64(F.lit(2), *values[::-1], nulls).alias("mark2")]


@dataclass(frozen=True)
class Copies:
    """Rows and different rows of a table, and the rows that occur twice or more with their `copies`."""

    rows: int
    singles: int
    repeated: DataFrame

    def totals(self) -> DataFrame:
        """One row: total, distinct, keys (different rows that occur twice or more)."""
        return self.repeated.agg(F.count("*").alias("met"), F.count_if(F.col("copies") > 1).alias("keys")).select(
            F.lit(self.rows).cast("bigint").alias("total"), (F.col("met") + F.lit(self.singles)).alias("distinct"), "keys"
        )


def copies(df: DataFrame, columns: list[str]) -> Copies:
    """Count copies by fingerprint first: what moves for all rows is a fingerprint, whatever the width of a row.

    The rows whose fingerprint is met again are then compared in full, so two rows that share one by chance still count
    as two. The repeated fingerprints are written first: where they are few they are broadcast by their known size.
    """
    seen = Observation()
    marked = df.select(*columns, *fingerprint(columns))
    counted = marked.groupBy("mark", "mark2").agg(F.count("*").alias("copies"))
    counted = counted.observe(seen, F.sum("copies").alias("rows"), F.count_if(F.col("copies") == 1).alias("singles"))
    again = stage(counted.filter("copies > 1").select("mark", "mark2"), "repeated-marks")
    suspects = marked.join(again, ["mark", "mark2"], "left_semi")
    found = seen.get
    return Copies(found["rows"] or 0, found["singles"] or 0, _copies(suspects, columns))


def row_duplicates(df: DataFrame, computed: tuple[str, ...] = ()) -> DataFrame:
    """Whole-row copies. `computed` columns follow from the others and need not be compared."""
    counts = copies(df, [c for c in df.columns if c not in computed]).totals()
    extra = F.col("total") - F.col("distinct")
    return counts.select(
        F.col("total").alias("total_rows"),
        F.col("distinct").alias("distinct_rows"),
        extra.alias("duplicate_rows"),
        percentage(extra, F.col("total")).alias("duplicate_pct"),
    )


def _repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return _copies(df, key).filter("copies > 1")


def key_duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """Number of keys (not rows) that occur more than once; null is a key value like any other."""
    return _repeated_keys(df, key).agg(F.count("*").alias("duplicate_keys")).select(
        F.lit(",".join(key)).alias("key_columns"), "duplicate_keys"
    )


def key_duplicate_samples(df: DataFrame, key: list[str], n: int = DUPLICATE_SAMPLES) -> DataFrame:
    """The n keys with the most copies."""
    return _repeated_keys(df, key).orderBy(F.desc("copies"), *key).limit(n)


def time_horizon(df: DataFrame, time_column: str = "time") -> DataFrame:
    return df.agg(F.min(time_column).alias("min_time"), F.max(time_column).alias("max_time")).select(
        F.lit(time_column).alias("time_column"),
        "min_time",
        "max_time",
        (F.col("max_time") - F.col("min_time")).alias("time_span_seconds"),
    )


def _moments(i: int, column: str) -> list[Column]:
    return [
        F.count(column).alias(f"count_{i}"),
        F.avg(column).alias(f"mean_{i}"),
        F.stddev_samp(column).alias(f"std_{i}"),
        F.min(column).cast("double").alias(f"min_{i}"),
        F.max(column).cast("double").alias(f"max_{i}"),
    ]


def _moment_cells(i: int) -> list[Column]:
    """A single value has no spread: 0.0. Without values all is null but the count."""
    std = F.when(F.col(f"count_{i}") > 0, F.coalesce(f"std_{i}", F.lit(0.0)))
    return [F.col(f"count_{i}"), F.col(f"mean_{i}"), std, F.col(f"min_{i}"), F.col(f"max_{i}")]


_MOMENT_NAMES = ["count", "mean", "std", "min", "max"]


def numeric_moments(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, min and max of each column in one pass."""
    columns = integer_columns(df) if columns is None else columns
    row = df.agg(*[m for i, c in enumerate(columns) for m in _moments(i, c)])
    return _rows_per_column(row, {c: _moment_cells(i) for i, c in enumerate(columns)}, _MOMENT_NAMES)


def quantiles(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Reported quantiles of each column; a column without values has a row of nulls.

    exact    interpolated between neighbours
    else     an element whose rank is within about 0.1 % of the rows
    """
    columns = integer_columns(df) if columns is None else columns
    find = exact_quantiles if exact else sketch_quantiles
    found = find(df, columns, list(QUANTILES.values()))
    wide = found.groupBy("column_name").agg(
        *[F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(n) for n, p in QUANTILES.items()]
    )
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("column_name"))
    return names.join(wide, "column_name", "left")


def skewness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Bias-adjusted skewness; null below three values, 0.0 for a constant column."""
    columns = numeric_columns(df) if columns is None else columns

    def adjusted(i: int) -> Column:
        n = F.col(f"n_{i}").cast("double")
        scaled = F.col(f"g_{i}") * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)
        return F.when(n > 2, F.when(F.col(f"s_{i}") == 0, 0.0).otherwise(scaled))

    found = []
    for group in column_groups(columns) or [columns]:
        row = df.agg(*[
            m for i, c in enumerate(group)
            for m in (F.count(c).alias(f"n_{i}"), F.skewness(c).alias(f"g_{i}"), F.stddev_pop(c).alias(f"s_{i}"))
        ])
        found.append(_rows_per_column(row, {c: [F.col(f"n_{i}"), adjusted(i)] for i, c in enumerate(group)}, ["count", "skew"]))
    return union_all(found)


def distribution_shape(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """Moments, quantiles and skewness of each column side by side."""
    shape = numeric_moments(df, columns).join(quantiles(df, columns, exact), "column_name")
    return shape.join(skewness(df, columns).drop("count"), "column_name")


def summarise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Summary statistics with exact quartiles."""
    quartiles = quantiles(df, columns).select("column_name", "q25", "median", "q75")
    return numeric_moments(df, columns).join(quartiles, "column_name")


# --- distributions -------------------------------------------------------------------------------------------------


def distribution(df: DataFrame, column: str = LABEL) -> DataFrame:
    """Rows per value, most frequent first; null is a value too."""
    return df.groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column)


def value_counts(df: DataFrame, column: str, n: int = TOP_VALUES) -> DataFrame:
    return distribution(df, column).limit(n)


def top_values(df: DataFrame, columns: list[str], n: int = TOP_VALUES) -> DataFrame:
    """column_name, value (as text), count: the most frequent values of each column, from one scan."""
    values = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column_name", "value")
    counts = values.groupBy("column_name", "value").agg(F.count("*").alias("count"))
    place = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("count"), "value"))
    return counts.withColumn("place", place).filter(F.col("place") <= n).drop("place")


def distinct_counts(tables: dict[str, DataFrame], columns: dict[str, list[str]], approx: bool = False) -> DataFrame:
    """Distinct non-null values per table and column, all in one grouping."""
    values = union_all([
        tables[t].select(*[F.col(c).cast("string") for c in cs])
        .unpivot([], cs, "column_name", "value")
        .select(F.lit(t).alias("table_name"), "column_name", "value")
        for t, cs in columns.items()
    ])
    count = F.approx_count_distinct if approx else F.countDistinct
    return values.groupBy("table_name", "column_name").agg(count("value").alias("distinct_count"))


def window_coverage(tables: dict[str, DataFrame], window: str = "time_window") -> DataFrame:
    """First, last and number of windows per table; tables that cover different times train badly together."""
    windows = union_all([t.select(F.lit(name).alias("source"), window) for name, t in tables.items()])
    return windows.groupBy("source").agg(
        F.min(window).alias("min_time_window"),
        F.max(window).alias("max_time_window"),
        F.countDistinct(window).alias("n_time_windows"),
    )


# --- whole reports -------------------------------------------------------------------------------------------------
#
# Long form (table_name, check, column_name, metric, value, text), so that reports of all tables stack into one.

REPORT_COLUMNS = ("table_name", "check", "column_name", "metric", "value", "text")


def _entry(check: str, column: str | None, metric: str, value: Column | None = None, text: str | Column | None = None) -> Column:
    number = F.lit(None) if value is None else value
    words = text if isinstance(text, Column) else F.lit(text)
    return F.struct(
        F.lit(check).alias("check"),
        F.lit(column).cast("string").alias("column_name"),
        F.lit(metric).alias("metric"),
        number.cast("double").alias("value"),
        words.cast("string").alias("text"),
    )


def _long(row: DataFrame, table: str, entries: list[Column]) -> DataFrame:
    return row.select(F.lit(table).alias("table_name"), F.inline(F.array(*entries)))


class Measures:
    """Contract, shape, extent of time, nulls, moments and quantile sketches of a table: aggregates, and their entries.

    The aggregates are one pass over the rows, either a scan or a write that is on its way anyway.
    """

    def __init__(self, df: DataFrame, contract: Contract, numeric: list[str], sketched: bool = False):
        self.contract, self.columns, self.numeric, self.sketched = contract, df.columns, numeric, sketched
        aggregates = [F.count(F.lit(1)).alias("rows")]
        aggregates += [F.count_if(F.col(c).isNull()).alias(f"null_{i}") for i, c in enumerate(df.columns)]
        if contract.time_column:
            aggregates += [F.min(contract.time_column).alias("t_min"), F.max(contract.time_column).alias("t_max")]
        for i, c in enumerate(numeric):
            aggregates += _moments(i, c)
            if sketched:
                aggregates.append(F.kll_sketch_agg_bigint(F.col(c).cast("bigint"), SKETCH_SIZE).alias(f"sketch_{i}"))
        self.aggregates = aggregates

    def entries(self) -> list[Column]:
        contract = self.contract
        entries = [
            _entry("contract", None, "grain", text=contract.grain),
            *[_entry("contract", None, "note", text=n) for n in contract.notes],
            _entry("overview", None, "row_count", F.col("rows")),
            _entry("overview", None, "column_count", F.lit(len(self.columns))),
            _entry("overview", None, "columns", text=",".join(self.columns)),
        ]
        if contract.time_column:
            t = contract.time_column
            entries += [
                _entry("time_horizon", t, "min_time", F.col("t_min")),
                _entry("time_horizon", t, "max_time", F.col("t_max")),
                _entry("time_horizon", t, "time_span_seconds", F.col("t_max") - F.col("t_min")),
            ]
        for i, c in enumerate(self.columns):
            entries.append(_entry("missing_values", c, "missing_count", F.col(f"null_{i}")))
            entries.append(_entry("missing_values", c, "missing_pct", percentage(F.col(f"null_{i}"), F.col("rows"))))
        for i, c in enumerate(self.numeric):
            entries += [_entry("numeric", c, n, v) for n, v in zip(_MOMENT_NAMES, _moment_cells(i))]
            if self.sketched:
                some = F.when(F.col(f"count_{i}") > 0, F.col(f"sketch_{i}"))
                entries += [_entry("numeric", c, n, F.kll_sketch_get_quantile_bigint(some, F.lit(p))) for n, p in QUANTILES.items()]
        return entries

    def report(self, row: DataFrame) -> DataFrame:
        return _long(row, self.contract.name, self.entries())


def _summary(df: DataFrame, contract: Contract, numeric: list[str]) -> DataFrame:
    """What a single scan tells."""
    measures = Measures(df, contract, numeric)
    return measures.report(df.agg(*measures.aggregates))


def write_measured(df: DataFrame, path: str, source: str, fmt: str = DEFAULT_FORMAT) -> tuple[int, DataFrame]:
    """Write a cleaned log; returns its rows and the scanned part of its report, both measured while it is written.

    Quantiles are from sketches. Only copies are left to look for in the written table.
    """
    measures = Measures(df, CONTRACTS[source], integer_columns(df), sketched=True)
    seen = Observation()
    write_table(df.observe(seen, *measures.aggregates), path, fmt)
    kinds = df.agg(*measures.aggregates).schema  # types only: nothing is read
    found = seen.get
    row = df.sparkSession.createDataFrame([tuple(found[f.name] for f in kinds.fields)], kinds)
    return found["rows"], measures.report(row)


def _duplicates(df: DataFrame, contract: Contract) -> DataFrame:
    """Row and key copies; where the key is the whole row but for computed columns, one grouping serves both."""
    compared = [c for c in df.columns if c not in contract.computed]
    rows = copies(df, compared)
    extra = F.col("total") - F.col("distinct")
    row_entries = [
        _entry("full_row_duplicates", None, "distinct_rows", F.col("distinct")),
        _entry("full_row_duplicates", None, "duplicate_rows", extra),
        _entry("full_row_duplicates", None, "duplicate_pct", percentage(extra, F.col("total"))),
    ]
    key_entry = _entry("key_duplicates", None, "duplicate_keys", F.col("keys"), ",".join(contract.key))
    same = set(compared) == set(contract.key)
    keys = rows if same else copies(df, list(contract.key))
    samples = keys.repeated.filter("copies > 1").orderBy(F.desc("copies"), *contract.key).limit(DUPLICATE_SAMPLES)
    sample_entry = _entry(
        "key_duplicates", None, "sample", F.col("copies"), F.to_json(F.struct(*contract.key), {"ignoreNullFields": "false"})
    )
    return union_all([
        _long(rows.totals(), contract.name, row_entries),
        _long(keys.totals(), contract.name, [key_entry]),
        _long(samples, contract.name, [sample_entry]),
    ])


def _quantile_entries(df: DataFrame, table: str, numeric: list[str], exact: bool) -> DataFrame:
    found = quantiles(df, numeric, exact).unpivot(["column_name"], list(QUANTILES), "metric", "value")
    return found.select(
        F.lit(table).alias("table_name"),
        F.lit("numeric").alias("check"),
        "column_name",
        "metric",
        "value",
        F.lit(None).cast("string").alias("text"),
    )


def log_report(df: DataFrame, source: str, exact_quantile: bool = False, measured: DataFrame | None = None) -> DataFrame:
    """Quality report of one cleaned log; `measured` is what `write_measured` has already found of it."""
    contract = CONTRACTS[source]
    numeric = integer_columns(df)
    if measured is not None and not exact_quantile:
        return union_all([measured, _duplicates(df, contract)])
    return union_all([
        _summary(df, contract, numeric),
        _duplicates(df, contract),
        _quantile_entries(df, source, numeric, exact_quantile),
    ])


def _counted_values(df: DataFrame, check: str, column: str, table: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("count")).select(
        F.lit(table).alias("table_name"),
        F.lit(check).alias("check"),
        F.lit(column).alias("column_name"),
        F.col(column).cast("string").alias("metric"),
        F.col("count").cast("double").alias("value"),
        F.lit(None).cast("string").alias("text"),
    )


def feature_report(df: DataFrame, flag: str = "redteam_current_flag") -> DataFrame:
    """Quality report of the feature table: shape, nulls, copies, labels, current flags, window horizon, skewness.

    `df` is read several times, so pass a written table.
    """
    contract = CONTRACTS["features"]
    name = contract.name
    horizon = window_coverage({name: df}).select(
        F.col("source").alias("table_name"),
        F.inline(F.array(*[
            _entry("time_horizon", "time_window", n, F.col(c))
            for n, c in (("min", "min_time_window"), ("max", "max_time_window"), ("distinct", "n_time_windows"))
        ])),
    )
    measured = [c for c in numeric_columns(df) if c not in (*contract.key, LABEL, flag)]
    skew = skewness(df, measured).select(
        F.lit(name).alias("table_name"), F.lit("numeric").alias("check"), "column_name", F.lit("skew").alias("metric"),
        F.col("skew").cast("double").alias("value"), F.lit(None).cast("string").alias("text"),
    )
    return union_all([
        _summary(df, contract, []),
        _duplicates(df, contract),
        _counted_values(df, "label_distribution", LABEL, name),
        _counted_values(df, "flag_distribution", flag, name),
        horizon,
        skew,
    ])


def coverage_report(tables: dict[str, DataFrame]) -> DataFrame:
    values = ["min_time_window", "max_time_window", "n_time_windows"]
    coverage = window_coverage(tables)
    return coverage.unpivot(["source"], values, "metric", "value").select(
        F.col("source").alias("table_name"),
        F.lit("window_coverage").alias("check"),
        F.lit("time_window").alias("column_name"),
        "metric",
        F.col("value").cast("double").alias("value"),
        F.lit(None).cast("string").alias("text"),
    )
