"""The five event logs, read from a retail schema plus a click stream.

Gives real tables of any size to run the pipeline on where the security logs themselves are not at hand. Some rows repeat,
some text has blanks around it or another case, some outcomes and numbers are unknown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SECONDS = "timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)"

# source: (table, filter, column expressions)
_LOGS = {
    "auth": ("events", None, {
        "time": _SECONDS,
        "src_user_domain": "concat('U', user_id, '@D1')",
        "dst_user_domain": "concat('U', event_id * 7 % 50, '@D1')",
        "src_computer": "concat('C', user_id)",
        "dst_computer": "if(event_id % 97 = 0, NULL, concat('C', event_id * 31 % 150))",
        "auth_type": "CASE event_id % 3 WHEN 0 THEN 'Kerberos' WHEN 1 THEN 'NTLM' ELSE '?' END",
        "logon_type": "'Network'",
        "auth_orientation": "'LogOn'",
        "success": "CASE WHEN event_type = 'error' THEN 'Fail' WHEN event_id % 53 = 0 THEN NULL "
                   "WHEN event_id % 11 = 0 THEN '  SUCCESS ' WHEN event_id % 13 = 0 THEN 'success' ELSE 'Success' END",
    }),
    "flows": ("lineitem", None, {
        "time": "(l_orderkey * 97 + l_linenumber * 3607) % 2592000",
        "duration": "cast(floor(l_quantity) AS BIGINT)",
        "src_computer": "concat('C', l_suppkey % 150)",
        "src_port": "concat('N', l_partkey % 100)",
        "dst_computer": "concat('C', l_partkey % 150)",
        "dst_port": "cast(l_linenumber AS STRING)",
        "protocol": "CASE l_returnflag WHEN 'A' THEN 6 WHEN 'N' THEN 17 ELSE 1 END",
        "packet_count": "if(l_orderkey % 97 = 0, NULL, cast(floor(l_quantity) AS BIGINT))",
        "byte_count": "cast(floor(l_extendedprice) AS BIGINT)",
    }),
    "dns": ("orders", None, {
        "time": "o_orderkey * 173 % 2592000",
        "src_computer": "concat('C', o_custkey % 150)",
        "resolved_computer": "concat('C', o_orderkey * 13 % 150)",
    }),
    "proc": ("events", None, {
        "time": _SECONDS,
        "user_domain": "concat('U', user_id, '@D1')",
        "computer": "concat('C', user_id)",
        "process_name": "concat(if(event_id % 17 = 0, '  ', ''), 'P', event_id % 40, if(event_id % 19 = 0, ' ', ''))",
        "event_type": "if(event_id % 2 = 0, ' start', 'End')",
    }),
    "redteam": ("events", "event_type = 'error' AND value > 150", {
        "time": _SECONDS,
        "user_domain": "concat('U', user_id, '@D1')",
        "src_computer": "concat('C', user_id)",
        "dst_computer": "concat('C', event_id * 31 % 150)",
    }),
}

# Rows that happen twice.
_REPEATED = {"flows": "l_orderkey % 89 = 0", "proc": "event_id % 101 = 0"}


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def log_columns(source: str) -> dict[str, str]:
    """The columns of a log as expressions over its table."""
    return dict(_LOGS[source][2])


def read_log(spark: SparkSession, directory: str, source: str) -> DataFrame:
    name, condition, columns = _LOGS[source]
    rows = table(spark, directory, name)
    if condition:
        rows = rows.filter(condition)
    if source in _REPEATED:
        times = F.when(F.expr(_REPEATED[source]), 2).otherwise(1)  # one scan, not a union of two
        rows = rows.withColumn("nth", F.explode(F.array_repeat(F.lit(1), times))).drop("nth")
    return rows.select(*[F.expr(text).alias(column) for column, text in columns.items()])


def labelled_scores(spark: SparkSession, directory: str, label: str = "toxic") -> DataFrame:
    """(label, score, prediction) rows for the metric operators."""
    joined = table(spark, directory, "labels").join(table(spark, directory, "documents"), "doc_id")
    score = (F.col("n_chars") % 101).cast("double") / F.lit(101.0)
    return joined.select(
        F.col(label).alias("label"), score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("prediction")
    )
