import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.contracts import CONTRACTS, Contract, SCHEMAS
from eventloom.functions.ranks import SIDE_BY_SIDE
from eventloom.operators import inspect, prepare, quality, sketches
from eventloom.operators.clean import clean
from eventloom.sources.retail import read_log


def _by_column(df):
    return {r.column_name: r for r in df.collect()}


@pytest.fixture(scope="module")
def empty(spark):
    return clean(spark.createDataFrame([], SCHEMAS["flows"]), "flows")


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), (None, 3), (None, 3), ("b", None)], "k string, v bigint")


def test_missing(pairs, empty):
    rows = _by_column(quality.missing_values(pairs))
    assert (rows["k"].total_rows, rows["k"].missing_count) == (6, 2)
    assert rows["v"].missing_pct == pytest.approx(100 / 6)
    assert {(r.missing_count, r.missing_pct) for r in quality.missing_values(empty).collect()} == {(0, 0.0)}


def test_blank_text_is_not_missing(spark):
    assert quality.missing_values(spark.createDataFrame([("",)], "a string")).first().missing_count == 0


def test_duplicates(pairs, empty):
    assert tuple(quality.row_duplicates(pairs).first()) == (6, 4, 2, pytest.approx(100 / 3))
    assert tuple(quality.row_duplicates(empty).first()) == (0, 0, 0, 0.0)
    assert quality.key_duplicates(pairs, ["k"]).first().duplicate_keys == 2  # the null key counts
    assert [tuple(r) for r in quality.key_duplicate_samples(pairs, ["k"]).collect()] == [("a", 3), (None, 2)]
    assert quality.key_duplicates(empty, ["time"]).first().duplicate_keys == 0


def test_computed_columns_do_not_change_row_copies(spark):
    rows = [(1, "U", "U", "C", "C", "?", "?", "LogOn", "Success")] * 3 + [(2, "U", "U", "C", "C", "?", "?", "LogOn", None)]
    df = clean(spark.createDataFrame(rows, SCHEMAS["auth"]), "auth")
    assert tuple(quality.row_duplicates(df, CONTRACTS["auth"].computed).first()) == tuple(quality.row_duplicates(df).first())


def test_horizon(pairs, empty):
    assert tuple(quality.time_horizon(pairs, "v").first()) == ("v", 1, 3, 2)
    assert tuple(quality.time_horizon(empty).first()) == ("time", None, None, None)


def test_moments(spark, pairs, empty):
    row = quality.numeric_moments(pairs).first()
    assert (row["count"], row["mean"], row["min"], row["max"]) == (5, 2.0, 1.0, 3.0)
    assert row["std"] == pytest.approx(1.0)
    single = quality.numeric_moments(spark.createDataFrame([(4,)], "v bigint")).first()
    assert single["std"] == 0.0
    assert all(tuple(r)[1:] == (0, None, None, None, None) for r in quality.numeric_moments(empty).collect())


def test_all_integer_columns_by_default(spark):
    df = spark.range(3).selectExpr(*[f"id AS c{i}" for i in range(12)], "cast(id AS double) AS d", "cast(id AS string) AS s")
    names = {f"c{i}" for i in range(12)}
    assert {r.column_name for r in quality.numeric_moments(df).collect()} == names
    assert {r.column_name for r in quality.quantiles(df).collect()} == names


def test_top_values_of_all_columns_equal_those_of_each(spark):
    df = spark.createDataFrame([("x", 1), ("x", None), ("y", 1), (None, 2)], "a string, b int")
    found = {(r.column_name, r.value): r["count"] for r in quality.top_values(df, ["a", "b"], 2).collect()}
    assert found == {("a", "x"): 2, ("a", None): 1, ("b", "1"): 2, ("b", None): 1}


def test_quantiles_of_an_empty_table_are_null(empty):
    rows = quality.quantiles(empty).collect()
    assert len(rows) == 5 and all(r["median"] is None for r in rows)


def test_skewness_is_bias_adjusted(spark):
    values = [1.0, 2.0, 2.0, 3.0, 10.0, None]
    df = spark.createDataFrame([(v, 7, 1 if v else None) for v in values], "a double, b int, c int").limit(6)
    x = np.array([v for v in values if v is not None])
    n, m = len(x), x - x.mean()
    expected = math.sqrt(n * (n - 1)) / (n - 2) * (m**3).mean() / (m**2).mean() ** 1.5
    rows = _by_column(quality.skewness(df))
    assert rows["a"].skew == pytest.approx(expected) and rows["b"].skew == 0.0
    two = quality.skewness(spark.createDataFrame([(1,), (2,)], "a int")).first()
    assert (two["count"], two["skew"]) == (2, None)


def test_many_columns_are_measured_in_groups_that_are_compiled(spark, tmp_path):
    """One aggregate over all columns has more code than is compiled, and its plan has no whole stage for it."""
    cells = [(F.col("id") * (i + 1) % (i + 5)).cast("double").alias(f"c{i}") for i in range(45)]
    spark.range(100).select(*cells).write.parquet(str(tmp_path / "wide"))
    df = spark.read.parquet(str(tmp_path / "wide"))
    found = quality.skewness(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert max(line.count("partial_skewness") for line in plan.splitlines()) <= SIDE_BY_SIDE
    rows = _by_column(found)
    assert len(rows) == 45 and rows["c44"].skew == pytest.approx(_by_column(quality.skewness(df, ["c44"]))["c44"].skew)
    means = prepare.scales(df, df.columns)
    assert list(means) == df.columns and means["c3"] == pytest.approx(prepare.scales(df, ["c3"])["c3"])


def test_shape_puts_all_measures_side_by_side(spark):
    row = quality.distribution_shape(spark.range(101).withColumnRenamed("id", "a"), ["a"]).first()
    assert (row["median"], row["q25"], row["max"]) == (50.0, 25.0, 100.0) and abs(row["skew"]) < 1e-9


def test_value_counts_include_null_and_stop_at_n(pairs):
    assert [tuple(r) for r in quality.value_counts(pairs, "k", 2).collect()] == [("a", 3), (None, 2)]


def test_distinct_counts_leave_out_null(pairs):
    got = quality.distinct_counts({"t": pairs}, {"t": ["k", "v"]}).collect()
    assert {(r.column_name, r.distinct_count) for r in got} == {("k", 2), ("v", 3)}


def test_log_report(spark):
    rows = [(5, "C1", "C2"), (5, "C1", "C2"), (9, None, "C3")]
    report = quality.log_report(clean(spark.createDataFrame(rows, SCHEMAS["dns"]), "dns"), "dns").collect()
    got = {(r.check, r.column_name, r.metric): (r.value, r.text) for r in report}
    assert all(r.table_name == "dns" for r in report)
    assert got["overview", None, "row_count"] == (3.0, None)
    assert got["time_horizon", "time", "time_span_seconds"][0] == 4.0
    assert got["missing_values", "src_computer", "missing_count"][0] == 1.0
    assert got["full_row_duplicates", None, "duplicate_rows"][0] == 1.0
    assert got["key_duplicates", None, "duplicate_keys"][0] == 1.0
    assert got["key_duplicates", None, "sample"] == (2.0, '{"time":5,"src_computer":"C1","resolved_computer":"C2"}')
    assert got["numeric", "time", "median"][0] == 5.0 and got["numeric", "time", "mean"][0] == pytest.approx(19 / 3)
    assert got["contract", None, "grain"][1] == CONTRACTS["dns"].grain


def test_log_report_of_an_empty_table(empty):
    got = {(r.check, r.column_name, r.metric): r.value for r in quality.log_report(empty, "flows").collect()}
    assert got["overview", None, "row_count"] == 0.0 and got["full_row_duplicates", None, "duplicate_pct"] == 0.0
    assert got["numeric", "byte_count", "median"] is None


def test_keys_that_are_not_the_whole_row_are_grouped_again(spark, pairs):
    contract = Contract("pairs", "a pair", ("k",), None)
    got = {r.metric: r.value for r in quality._duplicates(pairs, contract).filter("metric <> 'sample'").collect()}
    assert got == {"distinct_rows": 4.0, "duplicate_rows": 2.0, "duplicate_pct": pytest.approx(100 / 3), "duplicate_keys": 2.0}


def test_first_look(pairs):
    rows = _by_column(inspect.sample_profile(pairs, "pairs"))
    assert rows["v"].data_type == "bigint" and rows["v"].sampled_rows == 6 and rows["v"].distinct_head_rows == 4
    assert inspect.sample_profile(pairs, "pairs", n=2).first().sampled_rows == 2
    look = inspect.check_frame(pairs, "pairs", 2)
    assert look["rows"] == 6 and len(look["preview"]) == 2 and inspect.preview(pairs, 3).count() == 3


def test_fingerprints_tell_nulls_apart_and_only_they_move(spark):
    rows = [("a", None), (None, "a"), ("a", None), ("a", "b"), (None, None), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "x string, y string")
    found = quality.copies(df, ["x", "y"])
    assert (found.rows, found.singles) == (7, 2)
    assert {tuple(r) for r in found.repeated.collect()} == {("a", None, 2), (None, None, 3)}
    assert df.select(quality.fingerprint(["x", "y"])).distinct().count() == 4


def test_rows_that_share_a_fingerprint_are_compared(spark, monkeypatch, pairs):
    monkeypatch.setattr(quality, "fingerprint", lambda columns: [F.lit(1).cast("bigint").alias("mark"), F.lit(2).cast("bigint").alias("mark2")])
    assert tuple(quality.row_duplicates(pairs).first()) == (6, 4, 2, pytest.approx(100 / 3))


def test_whole_rows_are_not_shuffled(spark, tmp_path):
    wide = spark.range(2000).select("id", *[F.concat(F.lit("x" * 50), F.col("id") % 997).alias(f"c{i}") for i in range(12)])
    wide.write.parquet(str(tmp_path / "wide"))
    wide = spark.read.parquet(str(tmp_path / "wide"))
    marks = wide.select(*wide.columns, *quality.fingerprint(wide.columns)).groupBy("mark", "mark2").count()
    exchanged = marks._jdf.queryExecution().executedPlan().toString().split("Exchange")[0]
    assert "c11" not in exchanged and "keys=[mark" in exchanged
    joined = quality.copies(wide, wide.columns).repeated._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in joined  # the few repeated fingerprints go to the rows
    assert quality.row_duplicates(wide).first().duplicate_rows == 0


def test_measured_while_written_equals_the_scanned_report(spark, tmp_path):
    log = clean(read_log(spark, "/root/testdata/sf0.001", "flows"), "flows")
    rows, measured = quality.write_measured(log, str(tmp_path / "flows"), "flows")
    assert rows == log.count() == spark.read.parquet(str(tmp_path / "flows")).count()
    key = lambda r: (r.check, r.column_name or "", r.metric, r.text or "")
    scanned = {key(r): r.value for r in quality.log_report(log, "flows").collect() if "duplicates" not in r.check}
    found = {key(r): r.value for r in measured.collect()}
    assert set(found) == set(scanned)
    near = {"q01", "q25", "median", "q75", "q99"}
    assert all(v == pytest.approx(scanned[k]) for k, v in found.items() if k[2] not in near)
    assert "Scan parquet" not in measured._jdf.queryExecution().executedPlan().toString()
    empty = log.limit(0)
    rows, measured = quality.write_measured(empty, str(tmp_path / "none"), "flows")
    assert rows == 0 and measured.filter("metric = 'median' AND value IS NOT NULL").count() == 0


# --- stored sketches


def test_sketches_of_runs_merge_over_any_range(spark, tmp_path):
    log = clean(read_log(spark, "/root/testdata/sf0.001", "flows"), "flows")
    kept = ["src_computer", "dst_port"]
    halves = [sketches.window_sketches(log.filter(F.col("byte_count") % 2 == k), kept) for k in (0, 1)]
    path = str(tmp_path / "sketches")
    sketches.write_sketches(halves[0].unionByName(halves[1]), path)
    for first, last in ((None, None), (24, 40), (None, 24), (24, None)):
        window = F.floor(F.col("time") / 3600 / 24) * 24
        rows = log
        if first is not None:
            rows = rows.filter(window >= first)
        if last is not None:
            rows = rows.filter(window <= last)
        held = sketches.held_against(sketches.profile_range(spark, path, first, last), rows, kept).collect()
        assert {r.column_name for r in held} == {"time", "duration", "protocol", "packet_count", "byte_count", *kept}
        assert all(r.within_error for r in held) and {r.row_count for r in held} == {rows.count()}
    plan = sketches.profile_range(spark, path, 24, 40)._jdf.queryExecution().executedPlan().toString()
    assert "byte_count" not in plan  # the log is not read


def test_sketches_of_events_without_time_and_of_none(spark, empty):
    df = spark.createDataFrame([(None, 5, "a"), (3, None, None), (4, 7, "b")], "time bigint, n int, s string")
    found = {r.column_name: r for r in sketches.merged(sketches.window_sketches(df, ["s"])).collect()}
    assert (found["n"].row_count, found["n"].missing_count, found["s"].distinct_count) == (3, 1, 2)
    assert found["time"]["median"] == 3 and found["s"]["median"] is None and found["n"].distinct_count is None
    assert sketches.merged(sketches.window_sketches(empty, [])).count() == 0
    nothing = spark.createDataFrame([(5, None)], "time bigint, n int")
    assert sketches.merged(sketches.window_sketches(nothing, [])).filter("column_name = 'n'").first()["median"] is None
