"""The three jobs one after the other on files, then scoring."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from eventloom.contracts import LABEL, SOURCES
from eventloom.operators.model import FOREST, LOGISTIC, PROBABILITY
from eventloom.operators.split import TimeCuts
from eventloom.plans.features import build_features, feature_table
from eventloom.plans.ingest import ingest
from eventloom.plans.train import model_inputs, score_table, train_models
from eventloom.sources.raw import read_raw
from eventloom.sources.retail import read_log
from eventloom.sources.tables import (
    drop_staged,
    export_csv,
    read_back,
    read_back_report,
    read_csv_export,
    read_table,
    scratch_path,
    stage,
    write_table,
)
from tests.conftest import SMALL, plan_of


@pytest.fixture(scope="module")
def work(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("jobs"))
    raw = {}
    for source in SOURCES:
        raw[source] = f"{base}/raw/{source}"
        read_log(spark, SMALL, source).write.option("compression", "gzip").csv(raw[source])
    ingest(spark, raw, f"{base}/tables", f"{base}/reports", spread=2)
    build_features(spark, f"{base}/tables", f"{base}/features", f"{base}/reports")
    return base


def test_cleaned_tables_hold_every_row(spark, work):
    report = {r["name"]: r for r in read_back_report(spark, {s: f"{work}/tables/{s}" for s in SOURCES})}
    for source in SOURCES:
        assert report[source]["rows"] == read_log(spark, SMALL, source).count()
    assert report["auth"]["schema"].endswith("success_flag:int>")


def test_reports_are_written(spark, work):
    for name in [*SOURCES, "features", "window_coverage"]:
        assert spark.read.json(f"{work}/reports/{name}").count() > 2


def test_features_from_files_equal_features_from_the_source(spark, work):
    stored = read_table(spark, f"{work}/features")
    again = feature_table({s: read_table(spark, f"{work}/tables/{s}") for s in SOURCES}, merge="join")
    assert stored.count() == again.count() and stored.exceptAll(again).count() == 0


def test_training_and_scoring(spark, work):
    best = train_models(spark, f"{work}/features", f"{work}/models", trees=5, depth=3, run="r1").collect()
    assert len(best) == 1 and best[0].model in (LOGISTIC, FOREST)
    measured = read_table(spark, f"{work}/models/run=r1/metrics")
    assert measured.count() == 2 * 2 * 5
    top = measured.filter("split = 'valid' AND metric = 'f1'").agg({"value": "max"}).first()[0]
    assert best[0].value == top
    assert read_table(spark, f"{work}/models/run=r1/parameters").filter("name = 'feature_count'").first().value == "43"
    assert read_table(spark, f"{work}/models/run=r1/reports/{FOREST}").filter("class = 'accuracy'").count() == 2
    assert PipelineModel.load(best[0].model_path).stages
    rows = read_table(spark, f"{work}/features").drop(LABEL, "proc_event_count")
    scored = score_table(rows, f"{work}/models", keep=["computer", "time_window"])
    assert scored.count() == rows.count() and scored.filter(f"{PROBABILITY} BETWEEN 0 AND 1").count() == rows.count()


def test_an_empty_part_is_an_error(spark, work, tmp_path):
    few = read_table(spark, f"{work}/features").filter("time_window < 5")
    write_table(few, str(tmp_path / "few"))
    assert few.select("time_window").distinct().count() == 5
    with pytest.raises(ValueError, match="test part"):
        train_models(spark, str(tmp_path / "few"), str(tmp_path / "out"))


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (None, "b, c")], "n bigint, s string")
    path = str(tmp_path / "t")
    for fmt in ("parquet", "orc", "json"):
        write_table(df, path, fmt)
        assert read_table(spark, path, fmt).exceptAll(df.select(*read_table(spark, path, fmt).columns)).count() == 0
    write_table(df, path)
    assert read_back(df, path).count() == 2
    assert read_back(df, path, rows=2).count() == 2
    with pytest.raises(ValueError, match="2 rows, expected 3"):
        read_back(df, path, rows=3)
    with pytest.raises(ValueError, match="schema"):
        read_back(df.withColumnRenamed("n", "m"), path)
    export_csv(df, str(tmp_path / "c"))
    assert read_csv_export(spark, str(tmp_path / "c"), df.schema).exceptAll(df).count() == 0
    write_table(df, str(tmp_path / "p"), partition_by=["s"])
    assert read_table(spark, str(tmp_path / "p")).count() == 2


def test_scratch_is_in_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(shared)
    assert stage(spark.range(3), "x").inputFiles()[0].removeprefix("file://").startswith(shared)


def test_without_a_shared_folder_only_a_local_master_gets_a_folder(tmp_path):
    class Fake:
        def __init__(self, master):
            self.conf = {}
            self.sparkContext = self
            self.master = master

        def getCheckpointDir(self):
            return None

    assert scratch_path(Fake("local[4]"), "x").rpartition("/")[2].startswith("x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(Fake("yarn"), "x")


def test_staged_tables_can_be_dropped(spark):
    table = stage(spark.range(3), "gone")
    drop_staged(table)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(table.inputFiles()[0])


def test_text_columns_are_no_inputs_and_a_part_is_read_by_its_bound(spark, work):
    table = read_table(spark, f"{work}/features").withColumn("note", F.lit("x"))
    columns, left_out = model_inputs(table)
    assert left_out == ["note"] and len(columns) == 43
    plan = plan_of(TimeCuts(10, 5, 8).part(read_table(spark, f"{work}/features"), "valid"))
    assert "PushedFilters: [IsNotNull(time_window), GreaterThan(time_window,5), LessThanOrEqual(time_window,8)]" in plan


def test_ingest_deals_the_rows_of_one_gzip_file_out(spark, work):
    one = read_raw(spark, "auth", f"{work}/raw/auth", spread=3)
    assert one.rdd.getNumPartitions() == 3
