"""Tables laid out by time, and feature tables that grow run by run."""

import pytest
from pyspark.sql import functions as F

from eventloom.contracts import LABEL, SOURCES
from eventloom.operators.clean import clean
from eventloom.operators.split import read_part, time_cuts
from eventloom.plans.features import ORDER, feature_table
from eventloom.plans.runs import FeatureRuns
from eventloom.sources.layout import read_layout, read_range, write_clustered
from eventloom.sources.retail import read_log
from eventloom.sources.tables import scratch_path
from tests.conftest import SMALL, plan_of


@pytest.fixture(scope="module")
def logs(spark):
    return {s: clean(read_log(spark, SMALL, s), s) for s in SOURCES}


@pytest.fixture(scope="module")
def whole(logs):
    return sorted(map(str, feature_table(logs).collect()))


def _rows(df):
    return sorted(map(str, df.collect()))


def test_a_part_opens_only_its_files(spark, logs):
    path = scratch_path(spark, "clustered")
    table = feature_table(logs)
    write_clustered(table, path, ORDER, files=10)
    stored = spark.read.parquet(path)
    cuts = time_cuts(stored)
    assert read_layout(spark, path).agg(F.sum("rows")).first()[0] == stored.count()
    opened = {}
    for name in ("train", "valid", "test"):
        part = read_part(spark, path, cuts, name)
        opened[name] = set(part.inputFiles())
        assert _rows(part.drop("split")) == _rows(cuts.part(stored, name).drop("split"))
        assert "PushedFilters: [IsNotNull(time_window)" in part._jdf.queryExecution().executedPlan().toString()
    assert len(set.union(*opened.values())) == 10 and len(stored.inputFiles()) == 10
    assert sum(map(len, opened.values())) <= 12  # only a file that holds a cut belongs to two parts


def test_files_are_in_order_and_ranges_may_be_empty(spark, logs):
    path = scratch_path(spark, "clustered")
    write_clustered(feature_table(logs).filter("computer IS NOT NULL"), path, ORDER)
    extents = read_layout(spark, path).orderBy("least_time_window").collect()
    assert all(a.most_time_window <= b.least_time_window for a, b in zip(extents, extents[1:]))
    assert read_range(spark, path, {"time_window": (10**9, None)}).count() == 0
    one = read_range(spark, path, {"time_window": (5, 5), "computer": ("C1", "C1")})
    assert one.count() == spark.read.parquet(path).filter("time_window = 5 AND computer = 'C1'").count() == 1


def test_two_mixed_halves_are_the_whole(spark, logs, whole):
    """Both halves touch every window, and one thing is often in both."""
    runs = FeatureRuns(spark, scratch_path(spark, "runs"))
    half = F.pmod(F.xxhash64("time"), F.lit(2))
    first = runs.add("a", {s: df.filter(half == 0) for s, df in logs.items()})
    assert _rows(runs.table()) != whole
    assert runs.add("b", {s: df.filter(half == 1) for s, df in logs.items()}) == first
    assert _rows(runs.table()) == whole


def test_later_runs_relabel_without_a_rewrite(spark, logs, whole):
    path = scratch_path(spark, "runs")
    runs = FeatureRuns(spark, path)
    cut = 15 * 24 * 3600
    runs.add("early", {s: df.filter(F.col("time") < cut) for s, df in logs.items()})
    before = {f.file: f.t for f in spark.read.parquet(f"{path}/features").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("t")).distinct().collect()}
    unlabelled = runs.table().filter(F.col(LABEL) == 1).count()
    late = {s: df.filter(F.col("time") >= cut) for s, df in logs.items()}
    touched = runs.add("late", late)
    assert min(touched) == 15
    after = {f.file for f in spark.read.parquet(f"{path}/features").select(F.col("_metadata.file_path").alias("file")).distinct().collect()}
    assert set(before) <= after  # not a file of the first run was written anew
    assert _rows(runs.table()) == whole
    earlier = runs.table().filter(F.col("time_window") < 15 * 24)
    assert earlier.filter(F.col(LABEL) == 1).count() > unlabelled
    assert _rows(runs.table("adjacent")) == _rows(feature_table(logs, label="adjacent"))
    runs.add("late", late)  # again: replaced, not added
    assert _rows(runs.table()) == whole


def test_only_bands_of_several_runs_are_folded_again(spark, logs):
    runs = FeatureRuns(spark, scratch_path(spark, "runs"))
    runs.add("a", {s: df.filter("time < 86400 * 2") for s, df in logs.items()})
    held = runs._held()["flows"]
    assert held == {0: 1, 1: 1}
    one = runs._added("flows", held)
    assert "Exchange" not in plan_of(one)
    key = ["computer", "time_window", "slot", "item"]
    assert one.filter("computer IS NOT NULL").groupBy(*key).count().filter("count > 1").count() == 0
    runs.add("b", {s: df.filter("time >= 86400 AND time < 86400 * 2") for s, df in logs.items()})
    held = runs._held()["flows"]
    assert held == {0: 1, 1: 2}
    both = runs._added("flows", held)
    assert "Exchange" in plan_of(both)
    assert both.groupBy(*key).count().filter("count > 1 AND computer IS NOT NULL").count() == 0


def test_a_run_that_shrinks_takes_its_bands_with_it(spark, logs):
    runs = FeatureRuns(spark, scratch_path(spark, "runs"))
    day = {s: df.filter("time < 86400 * 2") for s, df in logs.items()}
    runs.add("a", day)
    runs.add("b", {s: df.filter("time >= 86400 * 3 AND time < 86400 * 5") for s, df in logs.items()})
    assert runs.add("b", {s: df.limit(0) for s, df in logs.items()}) == [3, 4]
    assert _rows(runs.table()) == _rows(feature_table(day))
    with pytest.raises(ValueError):
        runs.table("other")
