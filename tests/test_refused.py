"""Lines that do not fit their log."""

import pytest
from pyspark.sql import functions as F

from eventloom.contracts import SCHEMAS
from eventloom.operators.clean import clean
from eventloom.plans.ingest import ingest_log
from eventloom.sources import refused
from eventloom.sources.raw import read_raw

LINES = {
    "1,C1,C2": None, "2,,": None, " 3,C1,C2": "time is no number", "abc,C1,C2": "time is no number", "4,C1": "too few fields",
    "5,C1,C2,C3": "too many fields", '6,"C1,x",C2': None, '7,"C1,x",C2,C3': "too many fields", "99999999999999999999,C1,C2": "time is no number",
}


@pytest.fixture
def raw(spark, tmp_path):
    path = str(tmp_path / "dns.txt")
    spark.createDataFrame([(x,) for x in LINES], "value string").coalesce(1).write.text(path)
    return path


def test_one_write_has_both_sinks(spark, raw, tmp_path):
    out = str(tmp_path / "split")
    refused.write_split(refused.parsed_or_refused(spark, "dns", raw), out)
    assert {r.line: r.reason for r in refused.read_refused(spark, out).collect()} == {k: v for k, v in LINES.items() if v}
    kept = refused.read_kept(spark, out, "dns")
    whole = clean(read_raw(spark, "dns", raw), "dns")
    assert kept.columns == whole.columns and [t for _, t in kept.dtypes] == [t for _, t in whole.dtypes]
    assert sorted(r.time for r in kept.collect()) == [1, 2, 6]
    assert kept.filter("time = 6").first().src_computer == "C1,x"
    assert all("verdict=kept" in f for f in kept.select(F.input_file_name().alias("f")).distinct().toPandas()["f"])


def test_ingest_puts_them_aside(spark, raw, tmp_path):
    table, report, aside = (str(tmp_path / n) for n in ("table", "report", "aside"))
    ingest_log(spark, "dns", raw, table, report, aside)
    assert spark.read.parquet(table).count() == 3 and refused.read_refused(spark, aside).count() == 6
    assert spark.read.json(report).filter("metric = 'row_count'").first().value == 3.0
    ingest_log(spark, "dns", raw, table, report)
    assert spark.read.parquet(table).count() == len(LINES)  # without a place for them they stay, with nulls


def test_logs_without_a_bad_line_and_without_a_line(spark, tmp_path):
    for name, lines in (("good", ["1,C1,C2"]), ("none", [])):
        path, out = str(tmp_path / name), str(tmp_path / f"{name}-split")
        spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
        rows = refused.parsed_or_refused(spark, "dns", path)
        refused.write_split(rows, out)
        assert refused.read_kept(spark, out, "dns").count() == len(lines) and refused.read_refused(spark, out).count() == 0


def test_reasons_of_logs_with_several_numbers(spark):
    rows = [("1,2,C,N,C,80,6,3,100", None), ("1,2,C,N,C,80,tcp,3,x", "protocol is no number"), ("1,2,C,N,C,80,6,3,", None)]
    df = spark.createDataFrame(rows, "line string, want string").withColumn("got", refused.reason("flows"))
    assert len(SCHEMAS["flows"]) == 9
    assert {r.line: r.got for r in df.filter("want IS NOT NULL").collect()} == {rows[1][0]: rows[1][1]}
