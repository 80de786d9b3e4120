import pytest
from pyspark.sql import functions as F

from eventloom.contracts import SCHEMAS
from eventloom.functions.columns import coerce_numeric, ratio, time_window
from eventloom.operators.clean import clean, ensure_success_flag, trim_strings
from eventloom.operators.features import with_event_flags
from eventloom.sources.raw import first_rows, random_rows, read_raw

LINES = [
    "1,U1@D,U2@D,C1,C2,Kerberos,Network,LogOn,Success",
    "2, U1@D ,U2@D,C1,C2,?,?,LogOff,fail",
    " 3,U1@D,U2@D,C1,C2,?,?,LogOn,SUCCESS ",
    "abc,U1@D,U2@D,C1,C2,?,?,LogOn,Success",
    "5,U1@D,U2@D,C1",
    "6,U1@D,U2@D,C1,C2,?,?,LogOn,Success,EXTRA",
    "7,U1@D,U2@D,,C2,   ,?,LogOn,",
]


@pytest.fixture
def raw_path(spark, tmp_path):
    path = str(tmp_path / "auth")
    spark.createDataFrame([(line,) for line in LINES], "value string").coalesce(1).write.option("compression", "gzip").text(path)
    return path


def test_raw_lines_read_trimmed_and_flagged(spark, raw_path):
    rows = clean(read_raw(spark, "auth", raw_path), "auth").collect()
    assert len(rows) == len(LINES)
    assert [r.time for r in rows] == [1, 2, None, None, 5, 6, 7]
    assert [r.success_flag for r in rows] == [1, 0, 1, 1, 0, 1, 0]
    assert rows[1].src_user_domain == "U1@D" and rows[1].auth_type == "?"
    assert rows[4].dst_computer is None and rows[4].success is None
    assert rows[6].src_computer is None and rows[6].auth_type == "" and rows[6].success is None


def test_an_unknown_outcome_counts_as_failure(spark, raw_path):
    flagged = with_event_flags(clean(read_raw(spark, "auth", raw_path), "auth"), "auth")
    assert flagged.filter("time = 5").first().failure_flag == 1


def test_strip_on_read_reads_padded_numbers_and_drops_blank_text(spark, raw_path):
    rows = clean(read_raw(spark, "auth", raw_path, strip_on_read=True), "auth").collect()
    assert [r.time for r in rows] == [1, 2, 3, None, 5, 6, 7]
    assert rows[6].auth_type is None


def test_corrupt_lines_can_be_kept(spark, raw_path):
    df = read_raw(spark, "auth", raw_path, corrupt_column="bad_line")
    bad = {r.bad_line for r in df.collect() if r.bad_line}
    assert any(line.startswith("abc") for line in bad)
    assert "bad_line" in clean(df, "auth").columns


def test_spread_keeps_all_rows(spark, raw_path):
    df = read_raw(spark, "auth", raw_path, spread=3)
    assert df.rdd.getNumPartitions() == 3 and df.count() == len(LINES)


def test_missing_path_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_raw(spark, "dns", str(tmp_path / "nowhere"))


def test_cleaners_keep_columns_and_types(spark):
    for source, schema in SCHEMAS.items():
        cleaned = clean(spark.createDataFrame([], schema), source)
        added = {"auth": [("success_flag", "int")], "redteam": [("redteam_flag", "int")]}.get(source, [])
        assert cleaned.dtypes == [(f.name, f.dataType.simpleString()) for f in schema.fields] + added
        assert cleaned.count() == 0


def test_flow_numbers_given_as_text(spark):
    columns = SCHEMAS["flows"].fieldNames()
    row = clean(spark.createDataFrame([("1", "2", " C1", "N1", "C2", "80", "6", "x", "9")], columns), "flows").first()
    assert (row.time, row.duration, row.protocol, row.packet_count, row.byte_count) == (1, 2, 6, None, 9)
    assert row.src_computer == "C1" and row.dst_port == "80"


def test_process_events_are_upper_cased_and_counted_by_kind(spark):
    df = spark.createDataFrame([(0, "U", "C", "P", " Start "), (0, "U", "C", "P", "end"), (0, "U", "C", "P", None)], SCHEMAS["proc"])
    flags = with_event_flags(clean(df, "proc"), "proc").select("event_type", "proc_start_flag", "proc_end_flag").collect()
    assert [tuple(r) for r in flags] == [("START", 1, 0), ("END", 0, 1), (None, 0, 0)]


def test_trim_leaves_other_types(spark):
    assert tuple(trim_strings(spark.createDataFrame([(" a ", 1)], "a string, b int")).first()) == ("a", 1)


def test_success_flag_is_not_overwritten(spark):
    df = spark.createDataFrame([("Success", 0)], "success string, success_flag int")
    assert ensure_success_flag(df).first().success_flag == 0
    assert ensure_success_flag(df.drop("success_flag")).first().success_flag == 1


def test_windows(spark):
    df = spark.createDataFrame([(0,), (3599,), (3600,), (-1,), (None,)], "time bigint")
    assert [r[0] for r in df.select(time_window("time")).collect()] == [0, 0, 1, -1, None]
    assert [r[0] for r in df.select(time_window("time", 1800)).collect()] == [0, 1, 2, -1, None]


def test_ratios(spark):
    df = spark.createDataFrame([(1, 0), (1, 4), (None, 0), (None, 2)], "n bigint, d bigint")
    assert [r[0] for r in df.select(ratio("n", "d")).collect()] == [0.0, 0.25, 0.0, None]
    assert df.select(ratio("n", "d", 1e-9)).filter("d = 4").first()[0] == pytest.approx(0.25, rel=1e-8)


def test_bad_numbers_become_null(spark):
    texts = ["1", " 2.5 ", "1e3", "N10451", "", None, "1d", "2f", "nan", "-7"]
    got = coerce_numeric(spark.createDataFrame([(t,) for t in texts], "x string"), ["x"]).collect()
    assert [r.x for r in got] == [1.0, 2.5, 1000.0, None, None, None, None, None, None, -7.0]


def test_samples(spark):
    df = spark.range(1000)
    assert first_rows(df, 10).count() == 10
    assert random_rows(df, enabled=False).count() == 1000
    sample = random_rows(df)
    assert 120 < sample.count() < 280 and sample.distinct().count() == sample.count()
    assert sorted(r.id for r in sample.collect()) == sorted(r.id for r in random_rows(df).collect())
    assert df.select(F.max("id")).first()[0] == 999
