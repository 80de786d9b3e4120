"""Counts per computer and time window, one set for each role a computer plays in a log."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.contracts import FEATURE_KEY, WINDOW_SECONDS
from eventloom.functions.columns import equals_flag, ratio, time_window
from eventloom.functions.ranks import union_all


@dataclass(frozen=True)
class Role:
    """A side of a log: which column names the computer, and what is counted for it.

    The dicts go from output suffix to source column.
    """

    prefix: str
    source: str
    computer: str
    events: str
    totals: dict[str, str] = field(default_factory=dict)
    distinct: dict[str, str] = field(default_factory=dict)
    means: dict[str, str] = field(default_factory=dict)

    def name(self, suffix: str) -> str:
        return f"{self.prefix}_{suffix}"


_OUTCOMES = {"success_count": "success_flag", "failure_count": "failure_flag"}
_VOLUMES = {"total_duration": "duration", "total_packets": "packet_count", "total_bytes": "byte_count"}
_AVERAGES = {"mean_packets": "packet_count", "mean_bytes": "byte_count"}
_LIFECYCLE = {"start_count": "proc_start_flag", "end_count": "proc_end_flag"}

# The output names and what they count.
ROLES = {
    role.prefix: role
    for role in (
        Role("auth_src", "auth", "src_computer", "event_count", _OUTCOMES,
             {"unique_dst_computers": "dst_computer", "unique_dst_users": "dst_user_domain"}),
        Role("auth_dst", "auth", "dst_computer", "event_count", _OUTCOMES,
             {"unique_src_computers": "src_computer", "unique_src_users": "src_user_domain"}),
        Role("flows_out", "flows", "src_computer", "count", _VOLUMES,
             {"unique_dst_computers": "dst_computer", "unique_dst_ports": "dst_port"}, _AVERAGES),
        Role("flows_in", "flows", "dst_computer", "count", _VOLUMES,
             {"unique_src_computers": "src_computer", "unique_src_ports": "src_port"}, _AVERAGES),
        Role("dns", "dns", "src_computer", "lookup_count", {},
             {"unique_resolved_computers": "resolved_computer"}),
        Role("proc", "proc", "computer", "event_count", _LIFECYCLE,
             {"unique_users": "user_domain", "unique_processes": "process_name"}),
        Role("redteam_src", "redteam", "src_computer", "event_count"),
        Role("redteam_dst", "redteam", "dst_computer", "event_count"),
    )
}
IMBALANCE = "proc_start_end_imbalance"


def add_time_window(df: DataFrame, time_column: str = "time", seconds: int = WINDOW_SECONDS) -> DataFrame:
    return df.withColumn("time_window", time_window(time_column, seconds))


def with_event_flags(df: DataFrame, source: str) -> DataFrame:
    """Per-event 0/1 columns that the roles add up."""
    if source == "auth":
        return df.withColumns({"failure_flag": 1 - F.col("success_flag")})
    if source == "proc":
        return df.withColumns({
            "proc_start_flag": equals_flag(F.col("event_type"), "START"),
            "proc_end_flag": equals_flag(F.col("event_type"), "END"),
        })
    return df


def role_features(
    df: DataFrame, role: str | Role, *, seconds: int = WINDOW_SECONDS, distinct: str = "exact", null_times: bool = False
) -> DataFrame:
    """Features of one role from its cleaned log.

    distinct="approx" swaps the exact distinct counts for sketches: one shuffle, a fixed size per group, and an
    error of a few percent. Events without a time belong to no window and are left out unless `null_times`.
    """
    role = ROLES[role] if isinstance(role, str) else role
    count_distinct = {"exact": F.countDistinct, "approx": F.approx_count_distinct}[distinct]
    events = add_time_window(with_event_flags(df, role.source), seconds=seconds)
    if not null_times:
        events = events.filter(F.col("time_window").isNotNull())
    table = events.groupBy(F.col(role.computer).alias("computer"), "time_window").agg(
        F.count("*").alias(role.name(role.events)),
        *[F.sum(c).alias(role.name(n)) for n, c in role.totals.items()],
        *[count_distinct(c).alias(role.name(n)) for n, c in role.distinct.items()],
        *[F.avg(c).alias(role.name(n)) for n, c in role.means.items()],
    )
    if role.prefix == "proc":
        table = table.withColumn(IMBALANCE, F.col("proc_start_count") - F.col("proc_end_count"))
    return table


def keyspace(frames: list[DataFrame]) -> DataFrame:
    """Every (computer, time_window) any of the frames has."""
    return union_all([f.select(*FEATURE_KEY) for f in frames]).dropDuplicates(list(FEATURE_KEY))


# --- output columns ------------------------------------------------------------------------------------------------


def count_columns() -> list[str]:
    names = []
    for role in ROLES.values():
        names += [role.name(s) for s in (role.events, *role.totals, *role.distinct)]
    return names + [IMBALANCE]


def mean_columns() -> list[str]:
    return [role.name(s) for role in ROLES.values() for s in role.means]


def fill_counts(df: DataFrame, means: bool = False, null_window_as_zero: bool = False) -> DataFrame:
    """Absent counts are zero; absent means stay unknown unless `means`. Keys are never filled by default."""
    names = [c for c in count_columns() + (mean_columns() if means else []) if c in df.columns]
    if null_window_as_zero:
        names.append("time_window")
    return df.fillna(0, subset=names)


def add_derived(df: DataFrame, epsilon: float | None = None) -> DataFrame:
    """Totals over both sides of a log, the current red-team state, and ratios."""

    def both(log: str, one: str, other: str, suffix: str) -> Column:
        return F.col(f"{log}_{one}_{suffix}") + F.col(f"{log}_{other}_{suffix}")

    events = both("auth", "src", "dst", "event_count")
    failures = both("auth", "src", "dst", "failure_count")
    flows = both("flows", "out", "in", "count")
    size = both("flows", "out", "in", "total_bytes")
    packets = both("flows", "out", "in", "total_packets")
    redteam = both("redteam", "src", "dst", "event_count")
    return df.withColumns({
        "auth_total_events": events,
        "auth_total_failures": failures,
        "auth_total_successes": both("auth", "src", "dst", "success_count"),
        "flows_total_events": flows,
        "flows_total_bytes": size,
        "flows_total_packets": packets,
        "redteam_event_count": redteam,
        "redteam_current_flag": F.when(redteam > 0, 1).otherwise(0),
        "auth_failure_ratio": ratio(failures, events, epsilon),
        "flows_bytes_per_event": ratio(size, flows, epsilon),
        "flows_packets_per_event": ratio(packets, flows, epsilon),
    })
