import numpy as np
import pytest

from eventloom.contracts import FEATURE_KEY, LABEL, REDTEAM_NOW, SCHEMAS, SOURCES, check_no_leakage, feature_columns
from eventloom.operators.clean import clean
from eventloom.operators.copartition import bucket_join, stored_frames
from eventloom.operators.features import keyspace, role_features
from eventloom.operators.label import add_label
from eventloom.operators.merge import role_frames, source_features, source_state, state_features
from eventloom.plans.features import MERGES, feature_table, merged_features
from eventloom.sources.retail import read_log
from tests.conftest import SMALL

EVENTS = {
    "auth": [
        (0, "U1", "U2", "C1", "C2", "?", "?", "LogOn", "Success"),
        (10, "U1", "U3", "C1", "C2", "?", "?", "LogOn", "Fail"),
        (20, "U1", None, "C1", None, "?", "?", "LogOn", None),
        (30, "U4", "U2", None, "C2", "?", "?", "LogOn", "Success"),
        (None, "U1", "U2", "C1", "C2", "?", "?", "LogOn", "Success"),
        (None, "U1", "U2", "C9", "C2", "?", "?", "LogOn", "Success"),
    ],
    "flows": [
        (3600, 5, "C1", "N1", "C2", "80", 6, 3, 100),
        (3700, 5, "C1", "N1", "C3", "80", 6, 4, None),
        (3700, None, "C4", "N1", "C1", "80", 6, None, None),
    ],
    "dns": [(0, "C1", "C2"), (1, "C1", "C2"), (2, "C1", None)],
    "proc": [(0, "U1", "C1", "P1", "Start"), (1, "U1", "C1", "P2", "End"), (2, "U2", "C1", "P1", "end")],
    "redteam": [(7200, "U1", "C7", "C8"), (7200, "U1", "C7", "C1"), (7201, "U1", "C7", "C1")],
}


@pytest.fixture(scope="module")
def logs(spark):
    return {s: clean(spark.createDataFrame(EVENTS[s], SCHEMAS[s]), s) for s in SOURCES}


@pytest.fixture(scope="module")
def table(logs):
    return {tuple(r[k] for k in FEATURE_KEY): r for r in feature_table(logs).collect()}


def test_counts(table):
    row = table["C1", 0]
    assert (row.auth_src_event_count, row.auth_src_success_count, row.auth_src_failure_count) == (3, 1, 2)
    assert (row.auth_src_unique_dst_computers, row.auth_src_unique_dst_users) == (1, 2)
    assert (row.dns_lookup_count, row.dns_unique_resolved_computers) == (3, 1)
    assert (row.proc_event_count, row.proc_start_count, row.proc_end_count, row.proc_start_end_imbalance) == (3, 1, 2, -1)
    assert (row.proc_unique_users, row.proc_unique_processes) == (2, 2)
    assert row.auth_failure_ratio == pytest.approx(2 / 3)
    assert row.flows_bytes_per_event == 0.0


def test_a_null_counterpart_is_counted_as_event_only(table):
    row = table["C2", 0]
    assert (row.auth_dst_event_count, row.auth_dst_unique_src_computers, row.auth_dst_unique_src_users) == (3, 1, 2)


def test_unknown_volumes(table):
    row = table["C1", 1]
    assert (row.flows_out_total_bytes, row.flows_out_mean_bytes, row.flows_out_mean_packets) == (100, 100.0, 3.5)
    assert (row.flows_in_total_bytes, row.flows_in_mean_bytes, row.flows_in_total_duration) == (0, None, 0)
    assert row.flows_in_count == 1 and row.flows_total_events == 3


def test_means_are_unknown_without_flows(table):
    assert table["C1", 0].flows_out_mean_bytes is None


def test_a_computer_known_from_one_log_only(table):
    row = table["C7", 2]
    assert row.redteam_src_event_count == 3 and row.redteam_current_flag == 1 and row.auth_total_events == 0


def test_null_computer_is_a_row_of_zeros(table):
    row = table[None, 0]
    assert row.auth_src_event_count == 0 and row.auth_dst_event_count == 0 and row.flows_out_mean_bytes is None


def test_events_without_time_are_left_out(table):
    assert ("C9", 0) not in table and ("C9", None) not in table
    assert all(key[1] is not None for key in table)


def test_fifty_columns_and_unique_keys(logs):
    df = feature_table(logs)
    assert len(df.columns) == 50 and df.columns[:2] == list(FEATURE_KEY) and df.columns[-1] == LABEL
    assert df.count() == df.select(*FEATURE_KEY).distinct().count()


def _same(a, b):
    return a.columns == b.columns and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("options", [{}, {"null_times": "zero"}, {"null_keys": "matched"}, {"seconds": 600},
                                     {"null_times": "zero", "null_keys": "matched"},
                                     {"null_times": "keep", "null_keys": "matched", "fill_means": True}])
def test_all_merges_agree(logs, options):
    first, *others = [merged_features(logs, merge=m, **options) for m in MERGES]
    for other in others:
        assert _same(first, other)
        assert [t for _, t in first.dtypes] == [t for _, t in other.dtypes]


def test_all_merges_agree_on_the_larger_tables(spark):
    logs = {s: clean(read_log(spark, SMALL, s), s) for s in SOURCES}
    first, *others = [merged_features(logs, merge=m) for m in MERGES]
    assert all(_same(first, other) for other in others)
    assert first.count() == keyspace(role_frames(logs)).count()


def test_a_hot_computer_is_counted_like_any_other(spark):
    random = np.random.default_rng(2)
    rows = []
    for i in range(4000):
        hot = i % 3 == 0  # a third of the flows go to one computer in one window
        ports = [f"N{p}" for p in random.integers(0, 900, 2)]
        rows.append((int(random.integers(0, 3600 if hot else 40_000)), 1, f"C{random.integers(0, 60)}", ports[0],
                     "HOT" if hot else f"C{random.integers(0, 60)}", ports[1], 6, int(random.integers(1, 9)),
                     None if i % 7 == 0 else int(random.integers(0, 10**6))))
    expected = {}
    for time, _, src, src_port, dst, dst_port, _, packets, size in rows:
        for side, computer, other, port in (("out", src, dst, dst_port), ("in", dst, src, src_port)):
            group = expected.setdefault((computer, time // 3600), {"out": [], "in": []})
            group[side].append((other, port, packets, size))
    got = source_features(spark.createDataFrame(rows, SCHEMAS["flows"]).repartition(6), "flows").collect()
    assert len(got) == len(expected)
    for row in got:
        for side, far in (("out", "dst"), ("in", "src")):
            events = expected[row.computer, row.time_window][side]
            sizes = [e[3] for e in events if e[3] is not None]
            assert (row[f"flows_{side}_count"] or 0) == len(events)
            assert row[f"flows_{side}_unique_{far}_computers"] == len({e[0] for e in events})
            assert row[f"flows_{side}_unique_{far}_ports"] == len({e[1] for e in events})
            assert (row[f"flows_{side}_total_packets"] or 0) == sum(e[2] for e in events)
            assert row[f"flows_{side}_mean_bytes"] == (pytest.approx(np.mean(sizes)) if sizes else None)


def test_null_times_as_window_zero(logs):
    rows = merged_features(logs, null_times="zero").filter("computer IN ('C1', 'C9') AND time_window = 0").collect()
    assert sorted((r.computer, r.auth_src_event_count) for r in rows) == [("C1", 0), ("C1", 3), ("C9", 0)]


def test_matched_null_keys_keep_their_features(logs):
    row = merged_features(logs, null_keys="matched").filter("computer IS NULL AND time_window = 0").first()
    assert (row.auth_src_event_count, row.auth_dst_event_count) == (1, 1)


def test_kept_null_times_are_a_window_of_their_own(logs):
    row = merged_features(logs, null_times="keep", null_keys="matched").filter("computer = 'C9'").first()
    assert (row.time_window, row.auth_src_event_count) == (None, 1)


def test_dropping_null_computers(logs):
    assert feature_table(logs, drop_null_keys=True).filter("computer IS NULL").count() == 0


def test_out_and_in_totals_agree(spark):
    row = merged_features({s: clean(read_log(spark, SMALL, s), s) for s in SOURCES}).selectExpr(
        "sum(flows_out_total_bytes) AS o", "sum(flows_in_total_bytes) AS i").first()
    assert row.o == row.i > 0


def test_approximate_distinct_counts_are_close(spark):
    log = clean(read_log(spark, SMALL, "flows"), "flows")
    exact = role_features(log, "flows_out", seconds=2_592_000)
    rough = role_features(log, "flows_out", seconds=2_592_000, distinct="approx").withColumnRenamed(
        "flows_out_unique_dst_computers", "rough")
    for r in exact.join(rough.select(*FEATURE_KEY, "rough"), list(FEATURE_KEY)).collect():
        assert r.rough == pytest.approx(r.flows_out_unique_dst_computers, rel=0.2)


def test_unknown_options_are_errors(logs):
    with pytest.raises(ValueError, match="merge"):
        merged_features(logs, merge="other")
    with pytest.raises(ValueError, match="null_keys"):
        merged_features(logs, null_keys="other")


def _flags(spark, rows):
    return spark.createDataFrame(rows, "computer string, time_window bigint, redteam_current_flag int")


def _labels(df):
    return [r[LABEL] for r in df.orderBy("computer", "time_window").collect()]


def test_label_over_a_gap(spark):
    df = _flags(spark, [("C1", 0, 0), ("C1", 9, 1), ("C1", 10, 0), ("C2", 1, 1)])
    assert _labels(add_label(df)) == [1, 0, 0, 0]
    assert _labels(add_label(df, "adjacent")) == [0, 0, 0, 0]
    assert _labels(add_label(df, drop_censored=True)) == [1, 0]
    assert _labels(add_label(_flags(spark, [("C1", 8, 0), ("C1", 9, 1)]), "adjacent")) == [1, 0]
    with pytest.raises(ValueError, match="label mode"):
        add_label(df, "other")


def test_leakage_guard(logs):
    columns = feature_columns(feature_table(logs).columns)
    assert len(columns) == 43 and not set(columns) & {*REDTEAM_NOW, LABEL, *FEATURE_KEY}
    with pytest.raises(ValueError, match="redteam_current_flag"):
        check_no_leakage(["dns_lookup_count", "redteam_current_flag"])
    with pytest.raises(ValueError, match="label"):
        feature_columns(["computer"])


def test_eight_joins_without_an_exchange(spark):
    """Between the stored tables and the joins nothing moves, with known keys and null-safe."""
    logs = {s: clean(read_log(spark, "/root/testdata/sf0.001", s), s) for s in SOURCES}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for null_keys in ("unmatched", "matched"):
            keys, frames = stored_frames(logs, 4, null_keys=null_keys)
            joined = bucket_join(keys, frames, null_keys)
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert plan.count("SortMergeJoin") == 8 and "Exchange" not in plan
            assert joined.count() == keys.count()
            assert len(keys.inputFiles()) <= 4  # a file a bucket
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    with pytest.raises(ValueError):
        bucket_join(keys, frames, "some")


def test_features_move_twice_on_the_way_to_their_buckets(spark):
    """Once per event and once per key; the grouping deals the rows to the buckets, nulls in the key included."""
    from eventloom.operators import copartition

    schema = "time long, src_computer string, resolved_computer string"
    rows = [(n * 60, None if n % 7 == 0 else f"C{n % 5}", f"C{n % 3}") for n in range(500)] + [(None, "C1", "C2"), (None, None, None)]
    logs = {s: clean(spark.createDataFrame(rows if s == "dns" else [], schema if s == "dns" else SCHEMAS[s]), s) for s in SOURCES}
    log = source_state(logs["dns"], "dns", null_times=True, null_keys="matched")
    plan = state_features(log, "dns", by=copartition.bucket_key())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    for buckets in (4, 3):
        keys, frames = stored_frames(logs, buckets, null_times=True, null_keys="matched")
        assert all(len(f.inputFiles()) <= buckets for f in (keys, *frames.values()))
        expected = source_features(logs["dns"], "dns", null_times=True, null_keys="matched")
        assert frames["dns"].select(*expected.columns).exceptAll(expected).count() == 0 and frames["dns"].count() == expected.count()
        assert keys.filter("time_window IS NULL AND computer IS NULL").count() == 1


def test_writing_buckets_adds_no_exchange(spark, monkeypatch):
    """Rows that are grouped into as many parts as there are buckets are written where they are."""
    from pyspark.sql import DataFrame

    dealt, repartition = [], DataFrame.repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda df, *a: dealt.append(a) or repartition(df, *a))
    logs = {s: clean(read_log(spark, SMALL, s), s) for s in SOURCES}
    stored_frames(logs)
    assert not dealt


def test_a_pair_of_computers_is_one_row_of_the_state(spark):
    schema = "time long, duration long, src_computer string, src_port string, dst_computer string, dst_port string, protocol int, packet_count long, byte_count long"
    rows = [(1, 2, "A", "N1", "B", "N2", 6, 3, 4), (2, 2, "A", "N1", "B", "N2", 6, None, 4), (3, 2, "A", "N1", None, "N2", 6, 3, 4),
            (4, 2, None, "N1", "B", "N2", 6, 3, 4), (5, 2, "A", "N3", "A", None, 6, 3, 4)]
    state = source_state(spark.createDataFrame(rows, schema), "flows")
    assert {r.slot for r in state.select("slot").distinct().collect()} == {0, 1, 3}
    found = {r.computer: r.asDict() for r in state_features(state, "flows").collect()}
    assert [found["A"][c] for c in ("flows_out_count", "flows_out_unique_dst_computers", "flows_out_unique_dst_ports", "flows_out_total_packets")] == [4, 2, 1, 9]
    assert [found["A"][c] for c in ("flows_in_count", "flows_in_unique_src_computers", "flows_in_unique_src_ports")] == [1, 1, 1]
    assert [found["B"][c] for c in ("flows_in_count", "flows_in_unique_src_computers", "flows_in_unique_src_ports", "flows_in_mean_packets")] == [3, 1, 1, 3.0]
