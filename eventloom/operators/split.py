"""Train, validation and test parts by time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.ranks import running_totals
from eventloom.sources.layout import Bounds, is_clustered, read_range
from eventloom.sources.tables import DEFAULT_FORMAT, read_table, stage

# Shares of the windows before the two cuts, and the fewest windows worth splitting.
TRAIN_SHARE = 0.60
VALID_SHARE = 0.80
FEWEST_WINDOWS = 5
SPLITS = ("train", "valid", "test")


@dataclass(frozen=True)
class TimeCuts:
    """Last window of the training part and of the validation part."""

    windows: int
    train: int
    valid: int

    def split(self, window: str = "time_window") -> Column:
        w = F.col(window)
        return F.when(w <= self.train, "train").when(w <= self.valid, "valid").when(w > self.valid, "test")

    def part(self, df: DataFrame, name: str, window: str = "time_window") -> DataFrame:
        """The rows of one part, by a bound on the window that a scan can take over."""
        w = F.col(window)
        bounds = {"train": w <= self.train, "valid": (w > self.train) & (w <= self.valid), "test": w > self.valid}
        return df.filter(bounds[name]).withColumn("split", F.lit(name))

    def bounds(self, name: str, window: str = "time_window") -> Bounds:
        """First and last window of a part, both included."""
        ends = {"train": (None, self.train), "valid": (self.train + 1, self.valid), "test": (self.valid + 1, None)}
        return {window: ends[name]}


def time_cuts(df: DataFrame, window: str = "time_window") -> TimeCuts:
    """Cut the ordered distinct windows at 60 and 80 percent, the window at each cut going to the earlier part."""
    windows = stage(df.select(window).filter(F.col(window).isNotNull()).distinct(), "windows")
    n = windows.count()
    if n < FEWEST_WINDOWS:
        raise ValueError(f"{n} time windows are too few to split by time; {FEWEST_WINDOWS} are needed")
    places = {"train": int(n * TRAIN_SHARE), "valid": int(n * VALID_SHARE)}
    ranked = running_totals(windows.withColumn("place", F.lit(1)), window, ["place"], descending=False)
    chosen = ranked.agg(*[F.max(F.when(F.col("place_upto") == i + 1, F.col(window))).alias(s) for s, i in places.items()])
    row = chosen.first()
    return TimeCuts(n, row["train"], row["valid"])


def read_part(spark: SparkSession, path: str, cuts: TimeCuts, name: str, fmt: str = DEFAULT_FORMAT) -> DataFrame:
    """One part of a stored table; of a table that is laid out by its window, only the files of the part are opened."""
    if fmt == DEFAULT_FORMAT and is_clustered(spark, path):
        return read_range(spark, path, cuts.bounds(name)).withColumn("split", F.lit(name))
    return cuts.part(read_table(spark, path, fmt), name)


def time_split(df: DataFrame, window: str = "time_window", cuts: TimeCuts | None = None) -> DataFrame:
    """Add `split`; rows without a window belong to no part."""
    cuts = cuts or time_cuts(df, window)
    return df.withColumn("split", cuts.split(window))
