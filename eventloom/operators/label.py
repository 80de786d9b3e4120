"""The label: does this computer show red-team activity next?

A computer has one row per window, so its partition grows with the length of the history, not with the
number of its events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.contracts import LABEL

MODES = ("next_row", "adjacent")


def _next_flag(mode: str, flag: str) -> Column:
    order = Window.partitionBy("computer").orderBy("time_window")
    if mode == "next_row":
        return F.lead(flag, 1).over(order)
    if mode == "adjacent":
        return F.max(flag).over(order.rangeBetween(1, 1))
    raise ValueError(f"label mode is one of {MODES}, not {mode!r}")


def add_label(
    df: DataFrame, mode: str = "next_row", *, drop_censored: bool = False, flag: str = "redteam_current_flag"
) -> DataFrame:
    """Add the label; where nothing follows, it is 0.

    next_row       the flag of the computer's next row, however many windows later
    adjacent       the flag of the very next window
    drop_censored  leave out the last row of each computer instead of calling it negative
    """
    if drop_censored:
        last = F.lead("time_window", 1).over(Window.partitionBy("computer").orderBy("time_window")).isNull()
        df = df.withColumn("_last", last)
    labelled = df.withColumn(LABEL, F.coalesce(_next_flag(mode, flag), F.lit(0)))
    return labelled.filter("NOT _last").drop("_last") if drop_censored else labelled
