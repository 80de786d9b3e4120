import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.functions.ranks import exact_quantiles, running_totals, sketch_quantiles
from eventloom.sources.tables import stage

PROBABILITIES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def _columns():
    random = np.random.default_rng(7)
    n = 3000
    hot = random.integers(0, 50, n)
    hot[: n // 3] = 7  # a third of the rows share one value
    return {
        "uniform": random.integers(-(10**6), 10**6, n),
        "hot": hot,
        "tail": (random.pareto(0.5, n) * 10).astype("int64"),
        "constant": np.full(n, 5),
    }


@pytest.fixture(scope="module")
def table(spark):
    data = _columns()
    rows = [tuple(int(v) for v in r) for r in zip(*data.values())]
    return spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in data)).repartition(5), data


@pytest.mark.parametrize("bins,few", [(2048, 50_000), (64, 100), (8, 20)])
def test_exact_quantiles_equal_sorted_interpolation(table, bins, few):
    df, data = table
    got = {(r.column_name, r.probability): r.quantile for r in exact_quantiles(df, list(data), PROBABILITIES, bins, few).collect()}
    assert len(got) == len(data) * len(PROBABILITIES)
    for column, values in data.items():
        for p in PROBABILITIES:
            assert got[column, p] == pytest.approx(np.quantile(values, p), rel=1e-12), (column, p)


def test_exact_quantiles_of_doubles_with_gaps(spark):
    values = [0.5, None, -3.25, float("nan"), 1e9, 2.0]
    df = spark.createDataFrame([(v, None) for v in values], "a double, b bigint")
    got = {r.probability: r.quantile for r in exact_quantiles(df, ["a", "b"], [0.25, 0.5]).collect()}
    known = [0.5, -3.25, 1e9, 2.0]
    assert got == {p: pytest.approx(np.quantile(known, p)) for p in (0.25, 0.5)}


def test_a_heavy_tail_of_doubles_is_cut_until_few_rows_are_left(spark):
    tail = spark.range(1_000_000, numPartitions=8).select((F.pow(F.rand(3) + 1e-12, F.lit(-2.0))).alias("a")).persist()
    got = exact_quantiles(tail, ["a"], [0.5, 0.999], few=2000)
    values = np.array([r.a for r in tail.collect()])
    found = {r.probability: r.quantile for r in got.collect()}
    assert found == {p: pytest.approx(np.quantile(values, p), rel=1e-12) for p in (0.5, 0.999)}


def test_integers_that_no_double_tells_apart_end_the_cutting(spark):
    df = spark.range(1000).select((F.lit(2**62) + F.col("id") % 3).alias("a"))
    assert exact_quantiles(df, ["a"], [0.5], few=10).first().quantile == float(2**62 + 1)


def test_extreme_integers(spark):
    big = [-(2**63), 2**63 - 1, 0, 1, 2, 2**53 + 1]
    df = spark.createDataFrame([(v,) for v in big], "a bigint")
    assert exact_quantiles(df, ["a"], [0.4]).first().quantile == 1.0


def test_a_range_of_one_value_needs_no_pass(spark, monkeypatch):
    """Constant columns are counted by their extent; a pass reads only the columns that are left to cut."""
    from eventloom.functions import ranks

    passes, in_ranges = [], ranks._in_ranges
    monkeypatch.setattr(ranks, "_in_ranges", lambda values, ranges, fields: passes.append({r[0] for r in ranges}) or in_ranges(values, ranges, fields))
    df = spark.range(1000).select(F.lit(0).alias("zero"), F.when(F.col("id") < 10, 7).alias("seven"), F.col("id").cast("int").alias("id"))
    found = {(r.column_name, r.probability): r.quantile for r in exact_quantiles(df, df.columns, [0.25, 0.5], bins=8, few=50).collect()}
    assert found == {("zero", 0.25): 0.0, ("zero", 0.5): 0.0, ("seven", 0.25): 7.0, ("seven", 0.5): 7.0, ("id", 0.25): 249.75, ("id", 0.5): 499.5}
    assert passes and all(p == {"id"} for p in passes)


def test_sketch_quantiles_are_within_a_permille_of_rank(spark):
    df = spark.range(200_000, numPartitions=16).select((F.col("id") * 7919 % 200_003).alias("a"))
    for r in sketch_quantiles(df, ["a"], [0.01, 0.25, 0.5, 0.75, 0.99]).collect():
        assert abs(r.quantile / 200_003 - r.probability) < 0.002


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("buckets", [3, 64])
def test_running_totals_equal_cumulative_sums(spark, descending, buckets):
    keys = sorted({int(k) for k in np.random.default_rng(3).pareto(0.3, 500) * 100 if k < 10**12})
    df = spark.createDataFrame([(k, k % 11) for k in keys], "k bigint, m bigint").repartition(4)
    got = {r.k: r.m_upto for r in running_totals(df, "k", ["m"], descending, buckets).collect()}
    order = keys[::-1] if descending else keys
    assert got == dict(zip(order, np.cumsum([k % 11 for k in order]).tolist()))


def test_running_totals_of_one_and_no_row(spark):
    df = spark.createDataFrame([(1, 5)], "k bigint, m bigint")
    assert running_totals(df, "k", ["m"]).first().m_upto == 5
    assert running_totals(df.filter("k > 1"), "k", ["m"]).count() == 0


def test_ranges_are_even_and_the_sums_move_nothing(spark):
    """No range holds over twice the median, and the window adds no exchange to the dealing out."""
    df = spark.range(1_000_000, numPartitions=8).select((F.exp(F.rand(5) * 20) + F.col("id") * 1e-9).alias("score"), F.lit(1).alias("n"))
    df = stage(df, "scores")
    got = running_totals(df, "score", ["n"], ranges=37)
    sizes = sorted(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == 37 and sizes[-1] <= 2 * sizes[18]
    plan = got._jdf.queryExecution().executedPlan().toString()
    dealt = plan[plan.index("Window") :]
    assert "shufflepartitionidpassthrough" in dealt.split("Exchange")[1]
    top = got.orderBy(F.desc("score")).limit(3).collect()
    assert [r.n_upto for r in top] == [1, 2, 3] and got.agg(F.max("n_upto")).first()[0] == 1_000_000
