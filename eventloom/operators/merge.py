"""From keyed feature tables to one row per computer and window.

Two merges: `join_features` is a key list plus a left join per table; `union_features` stacks the tables and folds
them with one aggregate. The tables come per role (`role_frames`) or per log (`source_frames`, the default of the
feature job, which reads every log once). All combinations give the same rows.

A null computer is a key of its own whose features are unknown, since a null key meets nothing in a join;
`null_keys="matched"` gives it its features.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.contracts import FEATURE_KEY, WINDOW_SECONDS
from eventloom.functions.ranks import union_all
from eventloom.operators.features import IMBALANCE, ROLES, Role, add_time_window, keyspace, role_features, with_event_flags

NULL_KEYS = ("unmatched", "matched")


def output_columns() -> list[str]:
    """Key and feature columns in table order."""
    names = list(FEATURE_KEY)
    for role in ROLES.values():
        names += [role.name(s) for s in (role.events, *role.totals, *role.distinct, *role.means)]
        if role.prefix == "proc":
            names.append(IMBALANCE)
    return names


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _check(null_keys: str) -> None:
    if null_keys not in NULL_KEYS:
        raise ValueError(f"null_keys is one of {NULL_KEYS}, not {null_keys!r}")


def role_frames(logs: dict[str, DataFrame], **options) -> list[DataFrame]:
    return [role_features(logs[role.source], role, **options) for role in ROLES.values()]


def join_features(frames: list[DataFrame], null_keys: str = "unmatched") -> DataFrame:
    _check(null_keys)
    merged = keyspace(frames)
    for frame in frames:
        if null_keys == "unmatched":
            merged = merged.join(frame, list(FEATURE_KEY), "left")
        else:
            other = frame.withColumnsRenamed({k: f"other_{k}" for k in FEATURE_KEY})
            same = _all([F.col(k).eqNullSafe(F.col(f"other_{k}")) for k in FEATURE_KEY])
            merged = merged.join(other, same, "left").drop(*[f"other_{k}" for k in FEATURE_KEY])
    return merged.select(*output_columns())


def union_features(frames: list[DataFrame], null_keys: str = "unmatched") -> DataFrame:
    """Each key occurs once per frame, so `max` picks the one value there is."""
    _check(null_keys)
    features = [c for c in output_columns() if c not in FEATURE_KEY]
    merged = union_all(frames).groupBy(*FEATURE_KEY).agg(*[F.max(c).alias(c) for c in features])
    if null_keys == "unmatched":
        known = _all([F.col(k).isNotNull() for k in FEATURE_KEY])
        merged = merged.select(*FEATURE_KEY, *[F.when(known, F.col(c)).alias(c) for c in features])
    return merged


# --- all roles of a log at once ---------------------------------------------------------------------------------
#
# An event becomes one row per thing that is counted distinctly for a computer it names: (computer, time_window,
# slot, item). A slot is one such count of one role; the first slot of a role also carries the role's sums. Where two
# slots count the two computers of an event for each other, one row serves both and is turned round after it is folded.
# Grouping by all four is the only step that moves event-sized data. Map tasks fold it first, and a busy computer is
# spread over its counterparts instead of being gathered in one task. Grouping by (computer, time_window) then
# counts the items, again folded before the shuffle.


def _slots(source: str) -> list[tuple[Role, str | None, bool]]:
    """(role, column counted distinctly, carries the sums) of every slot of a log."""
    slots = []
    for role in ROLES.values():
        if role.source == source:
            items = list(role.distinct.values()) or [None]
            slots += [(role, item, i == 0) for i, item in enumerate(items)]
    return slots


def _turned(slots: list[tuple[Role, str | None, bool]]) -> dict[int, int]:
    """Slots that say what an earlier one says with computer and item changed over, and that earlier one."""
    return {
        n: m for n, (role, item, carries) in enumerate(slots) for m, (other, thing, sums) in enumerate(slots[:n])
        if item == other.computer and thing == role.computer and carries == sums
    }


def _sums(role: Role) -> dict[str, Column]:
    """What a role adds up per event; `known_` counts the values behind a mean."""
    sums = {"events": F.lit(1)}
    sums.update({column: F.col(column) for column in role.totals.values()})
    sums.update({f"known_{column}": F.col(column).isNotNull() for column in role.means.values()})
    return {name: value.cast("bigint") for name, value in sums.items()}


def _pick(number: Column, choices: list[Column]) -> Column:
    """choices[number]"""
    picked = choices[-1]
    for n in reversed(range(len(choices) - 1)):
        picked = F.when(number == n, choices[n]).otherwise(picked)
    return picked


def source_state(
    log: DataFrame, source: str, *, seconds: int = WINDOW_SECONDS, null_times: bool = False, null_keys: str = "unmatched", folded: bool = False
) -> DataFrame:
    """(computer, time_window, slot, item, sums) of a cleaned log from a single scan.

    States of parts of a log can be stacked: what they say about one key is added up. A key of a log without distinct
    counts may have many rows unless `folded`.
    """
    _check(null_keys)
    events = add_time_window(with_event_flags(log, source), seconds=seconds)
    if not null_times:
        events = events.filter(F.col("time_window").isNotNull())

    slots = _slots(source)
    turned = _turned(slots)
    sums = _sums(slots[0][0])  # the roles of a log add up the same columns
    sum_names = list(sums)
    slot = F.col("slot")
    computer = _pick(slot, [F.col(role.computer) for role, _, _ in slots])
    item = _pick(slot, [F.col(thing) if thing else F.lit(None).cast("string") for _, thing, _ in slots])
    carries = slot.isin([n for n, (_, _, carries_sums) in enumerate(slots) if carries_sums])
    facets = events.withColumn("slot", F.explode(F.array(*[F.lit(n) for n in range(len(slots)) if n not in turned]))).select(
        computer.alias("computer"), "time_window", "slot", item.alias("item"),
        *[F.when(carries, v).alias(n) for n, v in sums.items()],
    )
    if null_keys == "unmatched":  # an unknown computer keeps its key only, so its events fold into few rows
        known = F.col("computer").isNotNull() | slot.isin(list(turned.values()))  # what the other computer needs stays
        facets = facets.select(*FEATURE_KEY, "slot", *[F.when(known, F.col(n)).alias(n) for n in ("item", *sum_names)])
    return folded_state(facets) if folded or any(item for _, item, _ in slots) else facets


def folded_state(state: DataFrame) -> DataFrame:
    """Stacked states added up."""
    key = [*FEATURE_KEY, "slot", "item"]
    return state.groupBy(*key).agg(*[F.sum(c).alias(c) for c in state.columns if c not in key])


def _both_sides(state: DataFrame, turned: dict[int, int]) -> DataFrame:
    """The state with a row of its own for every slot."""
    slot, side = F.col("slot"), F.col("side")
    sides = F.array(slot)
    for n, m in turned.items():
        sides = F.when(slot == m, F.array(F.lit(m), F.lit(n))).otherwise(sides)
    change = {"computer": F.when(side == slot, F.col("computer")).otherwise(F.col("item")), "slot": side,
              "item": F.when(side == slot, F.col("item")).otherwise(F.col("computer"))}
    return state.withColumn("side", F.explode(sides)).select(*[change.get(c, F.col(c)).alias(c) for c in state.columns])


def state_features(state: DataFrame, source: str, by: dict[str, Column] | None = None) -> DataFrame:
    """Features of all roles of a log, with exact distinct counts, from its state.

    by  the key under other names: columns that tell the same computers and windows apart
    """
    by = by or {k: F.col(k) for k in FEATURE_KEY}
    slots = _slots(source)
    if turned := _turned(slots):
        state = _both_sides(state, turned)

    def of_slot(number: int, column: str) -> Column:
        return F.when(F.col("slot") == number, F.col(column))

    measures, columns = [], []
    for number, (role, item, carries_sums) in enumerate(slots):
        if carries_sums:
            names = {"events": role.name(role.events), **{c: role.name(n) for n, c in role.totals.items()}}
            names.update({f"known_{c}": f"known_{role.name(n)}" for n, c in role.means.items()})
            measures += [F.sum(of_slot(number, c)).alias(n) for c, n in names.items()]
            columns += [F.col(n) for c, n in names.items() if not c.startswith("known_")]
            for name, column in role.means.items():
                known = F.col(f"known_{role.name(name)}")
                columns.append(F.when(known > 0, F.col(names[column]) / known).alias(role.name(name)))
        measures += [
            F.count(of_slot(number, "item")).alias(role.name(n)) for n, column in role.distinct.items() if column == item
        ]
        columns += [F.col(role.name(n)) for n, column in role.distinct.items() if column == item]
    if source == "proc":
        columns.append((F.col("proc_start_count") - F.col("proc_end_count")).alias(IMBALANCE))
    return state.groupBy(*[k.alias(n) for n, k in by.items()]).agg(*measures).select(*by, *columns)


def source_features(log: DataFrame, source: str, **options) -> DataFrame:
    """Features of all roles of a cleaned log from a single scan, with exact distinct counts."""
    return state_features(source_state(log, source, **options), source)


def source_frames(logs: dict[str, DataFrame], **options) -> list[DataFrame]:
    return [source_features(log, source, **options) for source, log in logs.items()]
