"""Feature tables that grow: logs come run by run, and each run recomputes only the bands of windows that it touches.

What is stored below one folder, all by `band` (BAND windows of time):

    state/<log>/run=<id>/band=<n>   partial state of a run: sums and items per computer, window and counted thing
    features/band=<n>               features without the label, with the next window and flag inside the band
    edges/band=<n>                  first window and flag of every computer in the band

Partial states are added up, so a window may get events from any number of runs, late ones too, and distinct counts stay
exact. A run that is added again replaces what it had said, so a job that broke is simply run again. Features and edges
of the touched bands are replaced by dynamic partition overwrite; no other band is written. The label of a computer's
last row in a band is the first flag of its next band: it is looked up among the edges when the table is read, so logs
that come later relabel the rows before them without a rewrite.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from eventloom.contracts import LABEL, SCHEMAS, SOURCES, WINDOW_SECONDS
from eventloom.functions.ranks import union_all
from eventloom.operators.clean import clean
from eventloom.operators.features import add_derived, fill_counts
from eventloom.operators.label import MODES
from eventloom.operators.merge import folded_state, source_state, state_features, union_features
from eventloom.sources.tables import drop_partitions, exists

#: Windows in a band.
BAND = 24
_NEXT = ("next_window", "next_flag")


def _band(window: str = "time_window"):
    return F.floor(F.col(window) / BAND).cast("bigint")


class FeatureRuns:
    """The stored runs and features below `path`; windows are `seconds` long. Events without a time are left out."""

    def __init__(self, spark: SparkSession, path: str, seconds: int = WINDOW_SECONDS):
        self.spark, self.path, self.seconds = spark, path, seconds

    def _state_schema(self, source: str) -> StructType:
        log = clean(self.spark.createDataFrame([], SCHEMAS[source]), source)
        fields = source_state(log, source, seconds=self.seconds).schema.fields
        return StructType([*fields, StructField("run", StringType()), StructField("band", LongType())])

    def state(self, source: str, bands: list[int] | None = None, run: str | None = None) -> DataFrame:
        """Stored states of a log, of some bands or one run only; other folders are not read."""
        root = f"{self.path}/state/{source}"
        if not exists(self.spark, root):
            return self.spark.createDataFrame([], self._state_schema(source))
        found = self.spark.read.schema(self._state_schema(source)).parquet(root)
        if run is not None:
            found = found.filter(F.col("run") == run)
        return found if bands is None else found.filter(F.col("band").isin(bands))

    def _bands(self, run: str) -> set[int]:
        return {band for held in self._held(run=run).values() for band in held}

    def _held(self, bands: list[int] | None = None, run: str | None = None) -> dict[str, dict[int, int]]:
        """How many runs have a state in each band of each log; of a run, or of what a run touches, so few."""
        states = [self.state(s, bands, run).select(F.lit(s).alias("source"), "band", "run").distinct() for s in SOURCES]
        held: dict[str, dict[int, int]] = {s: {} for s in SOURCES}
        for r in union_all(states).groupBy("source", "band").agg(F.count("*").alias("runs")).collect():
            held[r.source][r.band] = r.runs
        return held

    def _added(self, source: str, runs: dict[int, int]) -> DataFrame:
        """The states of some bands added up; the state of a run is so already, so bands of one run move nothing."""
        alone, shared = ([b for b, n in runs.items() if (n > 1) == several] for several in (False, True))
        parts = [self.state(source, alone).drop("run", "band")] if alone or not shared else []
        return union_all([*parts, *([folded_state(self.state(source, shared).drop("run", "band"))] if shared else [])])

    def add(self, run: str, logs: dict[str, DataFrame]) -> list[int]:
        """Add the cleaned logs of a run, or replace them; returns the bands that were recomputed."""
        touched = self._bands(run)
        for source, log in logs.items():
            # a file per band and task of the fold: rows are as spread over bands in every task, so nothing has to move
            state = source_state(log, source, seconds=self.seconds, folded=True).withColumn("band", _band())
            state.write.mode("overwrite").partitionBy("band").parquet(f"{self.path}/state/{source}/run={run}")
        touched |= self._bands(run)
        self.refresh(sorted(touched))
        return sorted(touched)

    def refresh(self, bands: list[int]) -> None:
        """Recompute features and edges of some bands from the states of all runs; bands without a state go."""
        runs = self._held(bands)
        held = {band for of_log in runs.values() for band in of_log}
        for table in ("features", "edges"):
            drop_partitions(self.spark, [f"{self.path}/{table}/band={b}" for b in bands if b not in held])
        bands = sorted(held)
        if not bands:
            return
        frames = [state_features(self._added(s, runs[s]), s) for s in SOURCES]
        rows = add_derived(fill_counts(union_features(frames))).withColumn("band", _band())
        # all rows of a computer and band in one of a few cells of the band: one shuffle for the window and for the files
        cells = -(-4 * int(self.spark.conf.get("spark.sql.shuffle.partitions")) // len(bands))
        rows = rows.withColumn("cell", F.pmod(F.xxhash64("computer"), F.lit(cells))).repartition("band", "cell")
        order = Window.partitionBy("band", "cell", "computer").orderBy("time_window")
        rows = rows.withColumns({
            "next_window": F.lead("time_window").over(order), "next_flag": F.lead("redteam_current_flag").over(order),
            "leads": F.lag("time_window").over(order).isNull(),
        }).drop("cell")
        self._replace(rows, "features")
        written = self.spark.read.schema(rows.schema).parquet(f"{self.path}/features").filter(F.col("band").isin(bands))
        edges = written.filter("leads").select("computer", F.col("time_window").alias("first_window"), F.col("redteam_current_flag").alias("first_flag"), "band")
        self._replace(edges, "edges")

    def _replace(self, rows: DataFrame, table: str) -> None:
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("band").parquet(f"{self.path}/{table}")

    def edges(self) -> DataFrame:
        """(computer, band, after_window, after_flag): the first row of each computer after a band it has rows in."""
        stored = self.spark.read.parquet(f"{self.path}/edges").withColumn("band", F.col("band").cast("bigint"))
        order = Window.partitionBy("computer").orderBy("band")  # a row per band, not per event
        return stored.select(
            "computer", "band", F.lead("first_window").over(order).alias("after_window"), F.lead("first_flag").over(order).alias("after_flag")
        )

    def table(self, label: str = "next_row") -> DataFrame:
        """The feature table of all runs so far, labelled."""
        if label not in MODES:
            raise ValueError(f"label mode is one of {MODES}, not {label!r}")
        rows = self.spark.read.parquet(f"{self.path}/features").withColumn("band", F.col("band").cast("bigint"))
        columns = [c for c in rows.columns if c not in (*_NEXT, "leads", "band")]
        after = self.edges().withColumnsRenamed({"computer": "edge_computer", "band": "edge_band"})
        last = F.col("next_window").isNull()
        same = last & F.col("computer").eqNullSafe(F.col("edge_computer")) & (F.col("band") == F.col("edge_band"))
        joined = rows.join(after, same, "left")
        window, flag = F.coalesce("next_window", "after_window"), F.coalesce("next_flag", "after_flag")
        if label == "adjacent":
            flag = F.when(window == F.col("time_window") + 1, flag)
        return joined.select(*columns, F.coalesce(flag, F.lit(0)).alias(LABEL))
