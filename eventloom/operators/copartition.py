"""Eight left joins without a shuffle: feature tables written in buckets of their key, joined bucket by bucket.

Each log is read once and its features are written in buckets of the key; so is the list of all keys. A bucket is one
sorted file, written by the task that the grouping has put its keys in, so nothing moves between the two; the logs are
written at the same time, as the small ones do not keep all cores busy. The joins then read bucket by bucket: nothing
moves between a scan and a join, however many tables are joined, and later joins on the same key reuse the files.

The key is stored without nulls, as (value or blank, known) pairs, so that a null-safe join is one on equal columns too.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.contracts import FEATURE_KEY
from eventloom.functions.ranks import union_all
from eventloom.operators.features import IMBALANCE, ROLES, Role
from eventloom.operators.merge import NULL_KEYS, output_columns, source_state, state_features
from eventloom.sources.tables import scratch_path

BUCKET_KEY = ("computer_value", "computer_known", "window_value", "window_known")


def bucket_key() -> dict[str, Column]:
    computer, window = (F.col(k) for k in FEATURE_KEY)
    parts = [F.coalesce(computer, F.lit("")), computer.isNotNull(), F.coalesce(window, F.lit(0)), window.isNotNull()]
    return dict(zip(BUCKET_KEY, parts))


def _with_feature_key(df: DataFrame) -> DataFrame:
    """A table keyed for buckets, with the key as it was."""
    known = [F.when(F.col(f"{n}_known"), F.col(f"{n}_value")).alias(k) for n, k in zip(("computer", "window"), FEATURE_KEY)]
    return df.select(*BUCKET_KEY, *known, *[c for c in df.columns if c not in BUCKET_KEY])


def _grouped_into(spark: SparkSession) -> int:
    """How many partitions a grouping deals its keys to; tasks may take several of them, but none in part."""
    return int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or spark.conf.get("spark.sql.shuffle.partitions"))


def write_buckets(df: DataFrame, label: str, buckets: int, path: str | None = None) -> DataFrame:
    """`df`, grouped by the bucket key, in sorted buckets in the shared folder; the catalog knows it by a name of its own."""
    name = f"eventloom_{label}_{uuid.uuid4().hex}"
    grouped = _with_feature_key(df)
    dealt = grouped if buckets == _grouped_into(df.sparkSession) else grouped.repartition(buckets, *BUCKET_KEY)
    writer = dealt.write.format("parquet").option("path", path or scratch_path(df.sparkSession, label))
    writer.bucketBy(buckets, *BUCKET_KEY).sortBy(*BUCKET_KEY).saveAsTable(name)
    return df.sparkSession.table(name)


def _role_columns(role: Role) -> list[str]:
    names = [role.name(s) for s in (role.events, *role.totals, *role.distinct, *role.means)]
    return names + [IMBALANCE] * (role.prefix == "proc")


def stored_frames(logs: dict[str, DataFrame], buckets: int | None = None, **options) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(all keys, the features of each log), stored in as many buckets as a shuffle has partitions unless told otherwise."""
    spark = next(iter(logs.values())).sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    paths = {s: scratch_path(spark, s) for s in logs}

    def write(source: str) -> DataFrame:
        features = state_features(source_state(logs[source], source, **options), source, by=bucket_key())
        return write_buckets(features, source, buckets, paths[source])

    with ThreadPoolExecutor(len(logs)) as pool:
        running = {s: pool.submit(inheritable_thread_target(spark)(write), s) for s in logs}
        frames = {s: job.result() for s, job in running.items()}
    # as plain files: a union of bucketed scans is taken for bucketed itself, also where the scans give their buckets up
    plain = [spark.read.schema(f.schema).parquet(paths[s]) for s, f in frames.items()]
    keys = union_all([f.select(*BUCKET_KEY) for f in plain]).distinct()
    return write_buckets(keys, "keys", buckets), frames


def bucket_join(keys: DataFrame, frames: dict[str, DataFrame], null_keys: str = "unmatched") -> DataFrame:
    """The keys with the features of all roles, left-joined one after the other; unknown keys meet nothing if unmatched."""
    if null_keys not in NULL_KEYS:
        raise ValueError(f"null_keys is one of {NULL_KEYS}, not {null_keys!r}")
    merged = keys
    for role in ROLES.values():
        frame = frames[role.source].select(*BUCKET_KEY, *_role_columns(role))
        if null_keys == "unmatched":
            frame = frame.filter("computer_known AND window_known")
        merged = merged.join(frame, list(BUCKET_KEY), "left")
    return merged.select(*output_columns())
