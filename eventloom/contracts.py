"""What each table looks like: schemas, keys, grain, and which columns a model may see.

Times are whole seconds since an unknown origin, so nothing here uses calendar types.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

# Column names, order and types of the five event logs.
EVENT_COLUMNS = {
    "auth": "time BIGINT, src_user_domain STRING, dst_user_domain STRING, src_computer STRING, "
    "dst_computer STRING, auth_type STRING, logon_type STRING, auth_orientation STRING, success STRING",
    "flows": "time BIGINT, duration BIGINT, src_computer STRING, src_port STRING, dst_computer STRING, "
    "dst_port STRING, protocol INT, packet_count BIGINT, byte_count BIGINT",
    "dns": "time BIGINT, src_computer STRING, resolved_computer STRING",
    "proc": "time BIGINT, user_domain STRING, computer STRING, process_name STRING, event_type STRING",
    "redteam": "time BIGINT, user_domain STRING, src_computer STRING, dst_computer STRING",
}

# Names of the key, label and red-team columns of the feature table, and the window length.
FEATURE_KEY = ("computer", "time_window")
LABEL = "target_redteam_next_window"
REDTEAM_NOW = (
    "redteam_src_event_count",
    "redteam_dst_event_count",
    "redteam_event_count",
    "redteam_current_flag",
)
WINDOW_SECONDS = 3600

SOURCES = tuple(EVENT_COLUMNS)
_TYPES = {"BIGINT": LongType(), "INT": IntegerType(), "STRING": StringType()}


def _schema(columns: str) -> StructType:
    """Without a session, which StructType.fromDDL would need."""
    pairs = (column.split() for column in columns.split(","))
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


SCHEMAS = {name: _schema(columns) for name, columns in EVENT_COLUMNS.items()}


@dataclass(frozen=True)
class Contract:
    """How to read one table: what a row is, what identifies it, and where its time lives."""

    name: str
    grain: str
    key: tuple[str, ...]
    time_column: str | None = "time"
    computed: tuple[str, ...] = ()  # columns that follow from the key, so never tell two rows apart
    notes: tuple[str, ...] = ()


def _log(name: str, grain: str, computed: tuple[str, ...] = (), *notes: str) -> Contract:
    return Contract(name, grain, tuple(SCHEMAS[name].fieldNames()), "time", computed, notes)


CONTRACTS = {
    "auth": _log("auth", "one authentication event", ("success_flag",),
                 "the same event may happen many times; copies are kept"),
    "flows": _log("flows", "one network flow", (),
                  "flows repeat; copies are kept",
                  "ports are labels, not numbers"),
    "dns": _log("dns", "one name lookup", (), "repeated lookups carry meaning; copies are kept"),
    "proc": _log("proc", "one start or end of a process", (),
                 "a process with a start and an end has two rows"),
    "redteam": _log("redteam", "one known compromise event", ("redteam_flag",),
                    "ground truth; counts of the current window must stay out of the model"),
    "features": Contract("features", "one computer in one time window", FEATURE_KEY, None, (),
                         ("aggregated from the five logs",)),
}


def feature_columns(columns: list[str]) -> list[str]:
    """Model inputs: everything but the keys, the label and the current red-team columns."""
    if LABEL not in columns:
        raise ValueError(f"the feature table has no label column {LABEL!r}")
    hidden = {*FEATURE_KEY, LABEL, *REDTEAM_NOW}
    kept = [c for c in columns if c not in hidden]
    check_no_leakage(kept)
    return kept


def check_no_leakage(columns: list[str]) -> None:
    """Fail when a column that tells the current red-team state is about to become a model input."""
    leaks = sorted(set(columns) & set(REDTEAM_NOW))
    if leaks:
        raise ValueError(f"current red-team columns among the model inputs: {', '.join(leaks)}")
