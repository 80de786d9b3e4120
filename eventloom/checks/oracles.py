"""Every registered query as SQL for DuckDB over the same tables."""

from __future__ import annotations

# --- the five logs -------------------------------------------------------------------------------------------------

RAW = {
    "auth": """
        SELECT date_diff('second', TIMESTAMP '2024-01-01', ts) AS time,
               'U' || user_id || '@D1' AS src_user_domain,
               'U' || (event_id * 7 % 50) || '@D1' AS dst_user_domain,
               'C' || user_id AS src_computer,
               CASE WHEN event_id % 97 <> 0 THEN 'C' || (event_id * 31 % 150) END AS dst_computer,
               CASE event_id % 3 WHEN 0 THEN 'Kerberos' WHEN 1 THEN 'NTLM' ELSE '?' END AS auth_type,
               'Network' AS logon_type, 'LogOn' AS auth_orientation,
               CASE WHEN event_type = 'error' THEN 'Fail' WHEN event_id % 53 = 0 THEN NULL
                    WHEN event_id % 11 = 0 THEN '  SUCCESS ' WHEN event_id % 13 = 0 THEN 'success'
                    ELSE 'Success' END AS success
        FROM events""",
    "flows": """
        SELECT (l_orderkey * 97 + l_linenumber * 3607) % 2592000 AS time,
               CAST(floor(l_quantity) AS BIGINT) AS duration,
               'C' || (l_suppkey % 150) AS src_computer, 'N' || (l_partkey % 100) AS src_port,
               'C' || (l_partkey % 150) AS dst_computer, CAST(l_linenumber AS VARCHAR) AS dst_port,
               CASE l_returnflag WHEN 'A' THEN 6 WHEN 'N' THEN 17 ELSE 1 END AS protocol,
               CASE WHEN l_orderkey % 97 <> 0 THEN CAST(floor(l_quantity) AS BIGINT) END AS packet_count,
               CAST(floor(l_extendedprice) AS BIGINT) AS byte_count
        FROM (FROM lineitem UNION ALL FROM lineitem WHERE l_orderkey % 89 = 0)""",
    "dns": """
        SELECT o_orderkey * 173 % 2592000 AS time, 'C' || (o_custkey % 150) AS src_computer,
               'C' || (o_orderkey * 13 % 150) AS resolved_computer
        FROM orders""",
    "proc": """
        SELECT date_diff('second', TIMESTAMP '2024-01-01', ts) AS time, 'U' || user_id || '@D1' AS user_domain,
               'C' || user_id AS computer,
               CASE WHEN event_id % 17 = 0 THEN '  ' ELSE '' END || 'P' || (event_id % 40)
                 || CASE WHEN event_id % 19 = 0 THEN ' ' ELSE '' END AS process_name,
               CASE WHEN event_id % 2 = 0 THEN ' start' ELSE 'End' END AS event_type
        FROM (FROM events UNION ALL FROM events WHERE event_id % 101 = 0)""",
    "redteam": """
        SELECT date_diff('second', TIMESTAMP '2024-01-01', ts) AS time, 'U' || user_id || '@D1' AS user_domain,
               'C' || user_id AS src_computer, 'C' || (event_id * 31 % 150) AS dst_computer
        FROM events WHERE event_type = 'error' AND value > 150""",
}
CLEAN = {
    "auth": "SELECT * REPLACE (trim(success) AS success), CASE WHEN upper(trim(success)) = 'SUCCESS' THEN 1 ELSE 0 END AS success_flag FROM raw_auth",
    "flows": "SELECT * FROM raw_flows",
    "dns": "SELECT * FROM raw_dns",
    "proc": "SELECT * REPLACE (upper(trim(event_type)) AS event_type, trim(process_name) AS process_name) FROM raw_proc",
    "redteam": "SELECT *, 1 AS redteam_flag FROM raw_redteam",
}
WINDOW = "CAST(floor(time / 3600) AS BIGINT) AS time_window"
COLUMNS = {
    "auth": ["time", "src_user_domain", "dst_user_domain", "src_computer", "dst_computer", "auth_type", "logon_type",
             "auth_orientation", "success", "success_flag"],
    "flows": ["time", "duration", "src_computer", "src_port", "dst_computer", "dst_port", "protocol", "packet_count",
              "byte_count"],
    "dns": ["time", "src_computer", "resolved_computer"],
    "proc": ["time", "user_domain", "computer", "process_name", "event_type"],
    "redteam": ["time", "user_domain", "src_computer", "dst_computer", "redteam_flag"],
}
NUMBERS = {
    "auth": ["time", "success_flag"],
    "flows": ["time", "duration", "protocol", "packet_count", "byte_count"],
    "dns": ["time"],
    "proc": ["time"],
    "redteam": ["time", "redteam_flag"],
}


def logs(*names: str) -> list[str]:
    """Views of the cleaned logs, with their window as w_<name>."""
    parts = []
    for n in names or RAW:
        parts += [f"raw_{n} AS ({RAW[n]})", f"{n} AS ({CLEAN[n]})", f"w_{n} AS (SELECT *, {WINDOW} FROM {n})"]
    return parts


def query(views: list[str], body: str) -> str:
    return f"WITH {', '.join(views)} {body}"


# --- features ------------------------------------------------------------------------------------------------------


def total(expression: str, name: str) -> str:
    return f"CAST(sum({expression}) AS BIGINT) AS {name}"


def distinct(column: str, name: str) -> str:
    return f"count(DISTINCT {column}) AS {name}"


def auth_role(prefix: str, key: str, computers: str, users: str, far: str) -> str:
    return f"""SELECT {key} AS computer, time_window, count(*) AS {prefix}_event_count,
        {total('success_flag', prefix + '_success_count')}, {total('1 - success_flag', prefix + '_failure_count')},
        {distinct(computers, f'{prefix}_unique_{far}_computers')}, {distinct(users, f'{prefix}_unique_{far}_users')}
        FROM w_auth GROUP BY ALL"""


def flow_role(prefix: str, key: str, far: str) -> str:
    return f"""SELECT {key} AS computer, time_window, count(*) AS {prefix}_count,
        {distinct(far + '_computer', f'{prefix}_unique_{far}_computers')},
        {distinct(far + '_port', f'{prefix}_unique_{far}_ports')},
        {total('duration', prefix + '_total_duration')}, {total('packet_count', prefix + '_total_packets')},
        {total('byte_count', prefix + '_total_bytes')},
        round(avg(packet_count), 9) AS {prefix}_mean_packets, round(avg(byte_count), 9) AS {prefix}_mean_bytes
        FROM w_flows GROUP BY ALL"""


ROLE_SQL = {
    "auth_src_features": ("auth", auth_role("auth_src", "src_computer", "dst_computer", "dst_user_domain", "dst")),
    "auth_dst_features": ("auth", auth_role("auth_dst", "dst_computer", "src_computer", "src_user_domain", "src")),
    "flows_out_features": ("flows", flow_role("flows_out", "src_computer", "dst")),
    "flows_in_features": ("flows", flow_role("flows_in", "dst_computer", "src")),
    "dns_features": ("dns", f"""SELECT src_computer AS computer, time_window, count(*) AS dns_lookup_count,
        {distinct('resolved_computer', 'dns_unique_resolved_computers')} FROM w_dns GROUP BY ALL"""),
    "proc_features": ("proc", f"""SELECT computer, time_window, count(*) AS proc_event_count,
        count(*) FILTER (event_type = 'START') AS proc_start_count,
        count(*) FILTER (event_type = 'END') AS proc_end_count,
        {distinct('user_domain', 'proc_unique_users')}, {distinct('process_name', 'proc_unique_processes')},
        count(*) FILTER (event_type = 'START') - count(*) FILTER (event_type = 'END') AS proc_start_end_imbalance
        FROM w_proc GROUP BY ALL"""),
    "redteam_src": ("redteam", """SELECT src_computer AS computer, time_window, count(*) AS redteam_src_event_count
        FROM w_redteam GROUP BY ALL"""),
    "redteam_dst": ("redteam", """SELECT dst_computer AS computer, time_window, count(*) AS redteam_dst_event_count
        FROM w_redteam GROUP BY ALL"""),
}
COUNTS = (
    "auth_src_event_count auth_src_success_count auth_src_failure_count auth_src_unique_dst_computers "
    "auth_src_unique_dst_users auth_dst_event_count auth_dst_success_count auth_dst_failure_count "
    "auth_dst_unique_src_computers auth_dst_unique_src_users flows_out_count flows_out_unique_dst_computers "
    "flows_out_unique_dst_ports flows_out_total_duration flows_out_total_packets flows_out_total_bytes "
    "flows_in_count flows_in_unique_src_computers flows_in_unique_src_ports flows_in_total_duration "
    "flows_in_total_packets flows_in_total_bytes dns_lookup_count dns_unique_resolved_computers proc_event_count "
    "proc_start_count proc_end_count proc_unique_users proc_unique_processes proc_start_end_imbalance "
    "redteam_src_event_count redteam_dst_event_count"
).split()
MEANS = ["flows_out_mean_packets", "flows_out_mean_bytes", "flows_in_mean_packets", "flows_in_mean_bytes"]

role_views = [f"{n} AS ({sql})" for n, (_, sql) in ROLE_SQL.items()]
keys_view = "keys AS (" + " UNION ".join(f"SELECT computer, time_window FROM {n}" for n in ROLE_SQL) + ")"


def joined_view(condition: str) -> str:
    joins = " ".join(f"LEFT JOIN {n} ON {condition.format(n=n)}" for n in ROLE_SQL)
    filled = ", ".join(f"coalesce({c}, 0) AS {c}" for c in COUNTS)
    return f"merged AS (SELECT keys.computer, keys.time_window, {filled}, {', '.join(MEANS)} FROM keys {joins})"


MERGED = [*logs(), *role_views, keys_view,
          joined_view("{n}.computer = keys.computer AND {n}.time_window = keys.time_window")]
MERGED_NULL_SAFE = [*logs(), *role_views, keys_view,
                    joined_view("{n}.computer IS NOT DISTINCT FROM keys.computer "
                                "AND {n}.time_window IS NOT DISTINCT FROM keys.time_window")]


def ratio(top: str, bottom: str, name: str) -> str:
    return f"CASE WHEN {bottom} = 0 THEN 0.0::DOUBLE ELSE round(({top}) / ({bottom}), 9) END AS {name}"


def shifted(top: str, bottom: str, name: str) -> str:
    return f"({top}) / ({bottom} + CAST(1e-9 AS DOUBLE)) AS {name}"


EVENTS = "(auth_src_event_count + auth_dst_event_count)"
FAILURES = "(auth_src_failure_count + auth_dst_failure_count)"
FLOWS = "(flows_out_count + flows_in_count)"
BYTES = "(flows_out_total_bytes + flows_in_total_bytes)"
PACKETS = "(flows_out_total_packets + flows_in_total_packets)"
REDTEAM = "(redteam_src_event_count + redteam_dst_event_count)"
RATIOS = [(FAILURES, EVENTS, "auth_failure_ratio"), (BYTES, FLOWS, "flows_bytes_per_event"),
          (PACKETS, FLOWS, "flows_packets_per_event")]
TOTALS = f"""{EVENTS} AS auth_total_events, {FAILURES} AS auth_total_failures,
    auth_src_success_count + auth_dst_success_count AS auth_total_successes,
    {FLOWS} AS flows_total_events, {BYTES} AS flows_total_bytes, {PACKETS} AS flows_total_packets,
    {REDTEAM} AS redteam_event_count, CASE WHEN {REDTEAM} > 0 THEN 1 ELSE 0 END AS redteam_current_flag"""
DERIVED = [*MERGED, f"derived AS (SELECT *, {TOTALS}, {', '.join(ratio(*r) for r in RATIOS)} FROM merged)"]
LABEL = "target_redteam_next_window"
NEXT_ROW = "coalesce(lead(redteam_current_flag) OVER (PARTITION BY computer ORDER BY time_window), 0)"
ADJACENT = """coalesce(max(redteam_current_flag) OVER (PARTITION BY computer ORDER BY time_window
    RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING), 0)"""
LAST = "lead(time_window) OVER (PARTITION BY computer ORDER BY time_window) IS NULL"
TABLE = [*DERIVED, f"features AS (SELECT *, CAST({NEXT_ROW} AS INTEGER) AS {LABEL} FROM derived)"]
LABEL_COLUMNS = "computer, time_window, redteam_current_flag"
FEATURE_COLUMNS = [*COUNTS, *MEANS, "auth_total_events", "auth_total_failures", "auth_total_successes",
                   "flows_total_events", "flows_total_bytes", "flows_total_packets", "redteam_event_count",
                   "redteam_current_flag", "auth_failure_ratio", "flows_bytes_per_event", "flows_packets_per_event"]

# --- quality -------------------------------------------------------------------------------------------------------


def per_log(select: str) -> str:
    """The same select for every log, {t} being its name and {row} and {key} its column lists."""
    return " UNION ALL ".join(
        select.format(t=t, row=", ".join(COLUMNS[t]), key=", ".join(k for k in COLUMNS[t] if not k.endswith("_flag")),
                      n=len(COLUMNS[t]), names=",".join(COLUMNS[t]),
                      keys=",".join(k for k in COLUMNS[t] if not k.endswith("_flag")))
        for t in RAW
    )


def per_column(columns: dict[str, list[str]], select: str) -> str:
    return " UNION ALL ".join(select.format(t=t, c=c) for t, cs in columns.items() for c in cs)


NUMERIC = """SELECT '{t}' AS table_name, '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean,
    CASE WHEN count({c}) > 0 THEN round(coalesce(stddev_samp({c}), 0.0), 6) END AS std,
    CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM {t}"""


def at(p: float, c: str = "{c}") -> str:
    return f"round(quantile_cont(CAST({c} AS DOUBLE), {p}), 6)"


QUANTILES = f"""SELECT '{{t}}' AS table_name, '{{c}}' AS column_name, {at(0.01)} AS q01, {at(0.25)} AS q25,
    {at(0.5)} AS median, {at(0.75)} AS q75, {at(0.99)} AS q99 FROM {{t}}"""
SKEW = """SELECT '{t}' AS table_name, '{c}' AS column_name, count({c}) AS count,
    CASE WHEN count({c}) > 2 THEN CASE WHEN stddev_pop({c}) = 0 THEN 0.0 ELSE round(skewness({c}), 6) END END AS skew
    FROM {t}"""
SUMMARY = f"""SELECT '{{c}}' AS column_name, count({{c}}) AS count, round(avg({{c}}), 6) AS mean,
    round(stddev_samp({{c}}), 6) AS std, CAST(min({{c}}) AS DOUBLE) AS min, {at(0.25)} AS q25, {at(0.5)} AS median,
    {at(0.75)} AS q75, CAST(max({{c}}) AS DOUBLE) AS max FROM {{t}}"""
MISSING = """SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS total_rows,
    count(*) - count({c}) AS missing_count,
    CASE WHEN count(*) > 0 THEN round((count(*) - count({c})) / count(*) * 100.0, 9) ELSE 0.0 END AS missing_pct
    FROM {t}"""
ROW_DUPLICATES = """SELECT '{t}' AS table_name, total_rows, distinct_rows, total_rows - distinct_rows AS duplicate_rows,
    CASE WHEN total_rows > 0 THEN round((total_rows - distinct_rows) / total_rows * 100.0, 9) ELSE 0.0 END
      AS duplicate_pct
    FROM (SELECT (SELECT count(*) FROM {t}) AS total_rows,
                 (SELECT count(*) FROM (SELECT DISTINCT {row} FROM {t})) AS distinct_rows)"""
DISTINCT_COLUMNS = {
    "auth": ["src_computer", "dst_computer", "src_user_domain", "dst_user_domain"],
    "flows": ["src_computer", "dst_computer"],
    "dns": ["src_computer", "resolved_computer"],
    "proc": ["computer", "user_domain", "process_name"],
    "redteam": ["src_computer", "dst_computer"],
}
REPEATED = {"auth": ["src_computer", "dst_computer"], "flows": ["src_computer", "dst_computer", "dst_port"]}
VALUE_COUNTS = {"auth": ["success", "auth_type"], "flows": ["protocol", "src_computer"], "proc": ["event_type"]}

# The columns of the merged features in table order.
TABLE_ORDER = [
    "computer", "time_window", "auth_src_event_count", "auth_src_success_count", "auth_src_failure_count",
    "auth_src_unique_dst_computers", "auth_src_unique_dst_users", "auth_dst_event_count", "auth_dst_success_count",
    "auth_dst_failure_count", "auth_dst_unique_src_computers", "auth_dst_unique_src_users", "flows_out_count",
    "flows_out_total_duration", "flows_out_total_packets", "flows_out_total_bytes", "flows_out_unique_dst_computers",
    "flows_out_unique_dst_ports", "flows_out_mean_packets", "flows_out_mean_bytes", "flows_in_count",
    "flows_in_total_duration", "flows_in_total_packets", "flows_in_total_bytes", "flows_in_unique_src_computers",
    "flows_in_unique_src_ports", "flows_in_mean_packets", "flows_in_mean_bytes", "dns_lookup_count",
    "dns_unique_resolved_computers", "proc_event_count", "proc_start_count", "proc_end_count", "proc_unique_users",
    "proc_unique_processes", "proc_start_end_imbalance", "redteam_src_event_count", "redteam_dst_event_count",
]
# Whole reports, in long form. What a contract says of a log.
GRAINS = {
    "auth": "one authentication event", "flows": "one network flow", "dns": "one name lookup",
    "proc": "one start or end of a process", "redteam": "one known compromise event",
    "features": "one computer in one time window",
}
NOTES = {
    "auth": ["the same event may happen many times; copies are kept"],
    "flows": ["flows repeat; copies are kept", "ports are labels, not numbers"],
    "dns": ["repeated lookups carry meaning; copies are kept"],
    "proc": ["a process with a start and an end has two rows"],
    "redteam": ["ground truth; counts of the current window must stay out of the model"],
    "features": ["aggregated from the five logs"],
}


def entry(table: str, check: str, column: str | None, metric: str, value: str = "NULL", text: str | None = None, tail: str = "") -> str:
    words = text if text and text.startswith("to_json") else ("NULL" if text is None else "'" + text + "'")
    name = "NULL" if column is None else f"'{column}'"
    return f"""SELECT '{table}' AS table_name, '{check}' AS "check", CAST({name} AS VARCHAR) AS column_name, {metric} AS metric,
        round(CAST({value} AS DOUBLE), 6) AS value, CAST({words} AS VARCHAR) AS text {tail}"""


def measured(t: str, columns: list[str], numbers: list[str], time: bool = True) -> list[str]:
    """What one scan tells of a table."""
    parts = [entry(t, "contract", None, "'grain'", text=GRAINS[t])]
    parts += [entry(t, "contract", None, "'note'", text=note) for note in NOTES[t]]
    parts += [
        entry(t, "overview", None, "'row_count'", "count(*)", tail=f"FROM {t}"),
        entry(t, "overview", None, "'column_count'", "count(*)", tail=f"FROM (SELECT unnest(string_split('{','.join(columns)}', ',')))"),
        entry(t, "overview", None, "'columns'", text=",".join(columns)),
    ]
    if time:
        for metric, value in (("min_time", "min(time)"), ("max_time", "max(time)"), ("time_span_seconds", "max(time) - min(time)")):
            parts.append(entry(t, "time_horizon", "time", f"'{metric}'", value, tail=f"FROM {t}"))
    for c in columns:
        missing = f"count(*) - count({c})"
        parts.append(entry(t, "missing_values", c, "'missing_count'", missing, tail=f"FROM {t}"))
        parts.append(entry(t, "missing_values", c, "'missing_pct'", f"CASE WHEN count(*) > 0 THEN ({missing}) / count(*) * 100.0 ELSE 0.0 END", tail=f"FROM {t}"))
    for c in numbers:
        moments = {"count": f"count({c})", "mean": f"avg({c})", "min": f"min({c})", "max": f"max({c})",
                   "std": f"CASE WHEN count({c}) > 0 THEN coalesce(stddev_samp({c}), 0.0) END"}
        parts += [entry(t, "numeric", c, f"'{m}'", v, tail=f"FROM {t}") for m, v in moments.items()]
    return parts


def copied(t: str, columns: list[str], key: list[str]) -> list[str]:
    """Copies of rows and keys of a table, with the ten most frequent keys."""
    row, k = ", ".join(columns), ", ".join(key)
    counts = f"FROM (SELECT count(*) AS copies FROM {t} GROUP BY {row})"
    extra = "coalesce(sum(copies), 0) - count(*)"
    keys = f"(SELECT {k}, count(*) AS copies FROM {t} GROUP BY {k} HAVING count(*) > 1)"
    fields = ", ".join(f"{c} := {c}" for c in key)
    return [
        entry(t, "full_row_duplicates", None, "'distinct_rows'", "count(*)", tail=counts),
        entry(t, "full_row_duplicates", None, "'duplicate_rows'", extra, tail=counts),
        entry(t, "full_row_duplicates", None, "'duplicate_pct'", f"CASE WHEN sum(copies) > 0 THEN ({extra}) / sum(copies) * 100.0 ELSE 0.0 END", tail=counts),
        entry(t, "key_duplicates", None, "'duplicate_keys'", "count(*)", ",".join(key), tail=f"FROM {keys}"),
        entry(t, "key_duplicates", None, "'sample'", "copies", f"to_json(struct_pack({fields}))",
              tail=f"FROM (SELECT * FROM {keys} ORDER BY copies DESC, {', '.join(c + ' NULLS FIRST' for c in key)} LIMIT 10)"),
    ]


def exact(t: str, numbers: list[str]) -> list[str]:
    points = {"q01": 0.01, "q25": 0.25, "median": 0.5, "q75": 0.75, "q99": 0.99}
    return [entry(t, "numeric", c, f"'{n}'", f"quantile_cont(CAST({c} AS DOUBLE), {p})", tail=f"FROM {t}") for c in numbers for n, p in points.items()]


def log_report(t: str) -> list[str]:
    key = [c for c in COLUMNS[t] if not c.endswith("_flag")]
    return [*measured(t, COLUMNS[t], NUMBERS[t]), *copied(t, COLUMNS[t], key), *exact(t, NUMBERS[t])]


def stacked(parts: list[str]) -> str:
    return " UNION ALL ".join(f"({p})" for p in parts)


# --- model inputs and metrics --------------------------------------------------------------------------------------

SPLIT = [*TABLE, """ordered AS (SELECT time_window, row_number() OVER (ORDER BY time_window) - 1 AS place
      FROM (SELECT DISTINCT time_window FROM features WHERE time_window IS NOT NULL)),
    cuts AS (SELECT max(time_window) FILTER (place = t) AS train_cut, max(time_window) FILTER (place = v) AS valid_cut
      FROM ordered, (SELECT CAST(floor(count(*) * CAST(0.6 AS DOUBLE)) AS BIGINT) AS t,
                            CAST(floor(count(*) * CAST(0.8 AS DOUBLE)) AS BIGINT) AS v FROM ordered)),
    parts AS (SELECT features.*, CASE WHEN time_window <= train_cut THEN 'train'
                                      WHEN time_window <= valid_cut THEN 'valid' ELSE 'test' END AS split
      FROM features, cuts)"""]
SCORES = [f"""{label}_scores AS (SELECT {label} AS label, CAST(n_chars % 101 AS DOUBLE) / CAST(101.0 AS DOUBLE) AS score,
      CASE WHEN CAST(n_chars % 101 AS DOUBLE) / CAST(101.0 AS DOUBLE) >= 0.5 THEN 1 ELSE 0 END AS prediction
    FROM labels JOIN documents USING (doc_id))""" for label in ("toxic", "quality")]
LABELS = ("toxic", "quality")


def safe(top: str, bottom: str) -> str:
    return f"CASE WHEN {bottom} > 0 THEN round({top} / {bottom}, 9) ELSE 0.0 END"


HITS, GUESSES, ACTUAL = ("count(*) FILTER (label = 1 AND prediction = 1)", "count(*) FILTER (prediction = 1)",
                         "count(*) FILTER (label = 1)")
BINARY = " UNION ALL ".join(
    f"""SELECT '{n}' AS label_name, {safe(HITS, GUESSES)} AS precision, {safe(HITS, ACTUAL)} AS recall,
        {safe(f'2 * {HITS}', f'({GUESSES} + {ACTUAL})')} AS f1 FROM {n}_scores""" for n in LABELS)


def curve(n: str) -> str:
    return f"""(SELECT *, sum(pos) OVER (ORDER BY score DESC) AS pos_upto, sum(neg) OVER (ORDER BY score DESC) AS neg_upto
        FROM (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
              FROM {n}_scores GROUP BY score))"""


AUC = " UNION ALL ".join(
    f"""SELECT '{n}' AS label_name, round(sum(neg * (pos_upto - pos + pos / 2)) / (sum(pos) * sum(neg)), 9) AS roc_auc
        FROM {curve(n)}""" for n in LABELS)
AP = " UNION ALL ".join(
    f"""SELECT '{n}' AS label_name, round(sum(pos * (pos_upto / (pos_upto + neg_upto))) / sum(pos), 9)
        AS average_precision FROM {curve(n)}""" for n in LABELS)
REPORT = [
    *SCORES,
    """scored AS (SELECT 'toxic' AS label_name, label, prediction FROM toxic_scores UNION ALL
        SELECT 'quality', label, prediction FROM quality_scores)""",
    """classes AS (SELECT label_name, class,
        count(*) FILTER (label = class AND prediction = class) AS hits, count(*) FILTER (label = class) AS actual,
        count(*) FILTER (prediction = class) AS guesses FROM scored, (VALUES (0), (1)) AS c(class) GROUP BY ALL)""",
    """per_class AS (SELECT label_name, CAST(class AS VARCHAR) AS class,
        CASE WHEN guesses > 0 THEN hits / guesses ELSE 0.0 END AS precision,
        CASE WHEN actual > 0 THEN hits / actual ELSE 0.0 END AS recall,
        CASE WHEN guesses + actual > 0 THEN 2 * hits / (guesses + actual) ELSE 0.0 END AS f1,
        actual AS support, hits FROM classes WHERE guesses + actual > 0)""",
    """report AS (SELECT label_name, class, precision, recall, f1, support FROM per_class
        UNION ALL SELECT label_name, 'accuracy', NULL, NULL, sum(hits) / sum(support), CAST(sum(support) AS BIGINT)
          FROM per_class GROUP BY label_name
        UNION ALL SELECT label_name, 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT)
          FROM per_class GROUP BY label_name
        UNION ALL SELECT label_name, 'weighted avg', sum(precision * support) / sum(support),
          sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT)
          FROM per_class GROUP BY label_name)""",
]
SCALED = ["auth_total_events", "flows_total_bytes", "dns_lookup_count"]
IMPUTED = ["flows_out_mean_bytes", "flows_in_mean_bytes", "flows_out_mean_packets"]


def oracle_sql() -> dict[str, str]:
    sql = {f"clean_{n}": query(logs(n), f"SELECT * FROM {n}") for n in RAW}
    sql["raw_scan"] = sql["clean_auth"]
    sql["trim_strings"] = query(
        logs("proc"), "SELECT * REPLACE (trim(event_type) AS event_type, trim(process_name) AS process_name) FROM raw_proc")
    sql["success_flag_if_missing"] = query(logs("auth"), "SELECT *, 1 - success_flag AS failure_flag FROM auth")
    sql["coerce_numeric"] = query(logs("flows"), """SELECT time, TRY_CAST(src_port AS DOUBLE) AS src_port,
        TRY_CAST(dst_port AS DOUBLE) AS dst_port, CAST(byte_count AS DOUBLE) AS byte_count FROM flows""")
    sql["time_window"] = query(logs(), per_log(f"SELECT '{{t}}' AS source, time, {WINDOW} FROM {{t}}"))
    for name, (log, body) in ROLE_SQL.items():
        sql[name] = query(logs(log), body)
    sql["keyspace"] = query([*logs(), *role_views, keys_view], "SELECT * FROM keys")
    merged = f"SELECT computer, time_window, {', '.join(COUNTS + MEANS)} FROM merged"
    for name in ("feature_join", "feature_join_shuffled", "feature_union_merge", "feature_source_merge"):
        sql[name] = query(MERGED, merged)
    sql["feature_join_null_safe"] = sql["feature_join_null_safe_shuffled"] = query(
        MERGED_NULL_SAFE,
        f"SELECT computer, time_window, {', '.join(COUNTS)}, {', '.join(f'coalesce({m}, 0.0) AS {m}' for m in MEANS)} FROM merged",
    )
    derived = ["auth_total_events", "auth_total_failures", "auth_total_successes", "flows_total_events",
               "flows_total_bytes", "flows_total_packets", "redteam_event_count", "redteam_current_flag"]
    sql["derived_features"] = query(
        DERIVED, f"SELECT computer, time_window, {', '.join(derived + [r[2] for r in RATIOS])} FROM derived")
    sql["epsilon_ratios"] = query(MERGED, f"SELECT computer, time_window, {', '.join(shifted(*r) for r in RATIOS)} FROM merged")
    sql["label_next_row"] = query(TABLE, f"SELECT {LABEL_COLUMNS}, {LABEL} FROM features")
    sql["label_adjacent"] = query(DERIVED, f"SELECT {LABEL_COLUMNS}, CAST({ADJACENT} AS INTEGER) AS {LABEL} FROM derived")
    sql["label_uncensored"] = query(
        DERIVED, f"""SELECT {LABEL_COLUMNS}, {LABEL} FROM (SELECT *, CAST({NEXT_ROW} AS INTEGER) AS {LABEL},
            {LAST} AS is_last FROM derived) WHERE NOT is_last""")
    sql["feature_table"] = query(TABLE, f"SELECT computer, time_window, {', '.join(FEATURE_COLUMNS)}, {LABEL} FROM features")
    sql["feature_table_known_computers"] = sql["feature_table"] + " WHERE computer IS NOT NULL"
    sql["feature_table_draft"] = query(
        [*MERGED_NULL_SAFE, f"derived AS (SELECT *, {TOTALS}, {', '.join(shifted(*r) for r in RATIOS)} FROM merged)"],
        f"""SELECT computer, time_window, {', '.join(f'coalesce({m}, 0.0) AS {m}' for m in MEANS)}, {', '.join(derived)},
            {', '.join(r[2] for r in RATIOS)}, CAST({NEXT_ROW} AS INTEGER) AS {LABEL} FROM derived""")
    sql["feature_selection"] = query(TABLE, f"""SELECT {', '.join(c for c in FEATURE_COLUMNS if not c.startswith('redteam'))}
        FROM features""")
    sql["io_roundtrip"] = sql["feature_runs_mixed"] = sql["feature_table"]
    sql["label_runs_in_order"] = sql["label_next_row"]
    sql["clustered_parts"] = query(SPLIT, f"""SELECT split, count(*) AS count, {total('auth_total_events', 'auth_total_events')},
        {total('flows_total_bytes', 'flows_total_bytes')}, {total(LABEL, LABEL)}, TRUE AS files_skipped FROM parts GROUP BY ALL""")
    sql["csv_export"] = sql["clean_flows"]

    sql["dq_overview"] = query(logs(), per_log(
        "SELECT '{t}' AS label, count(*) AS row_count, {n} AS column_count, '{names}' AS columns FROM {t}"))
    sql["dq_missing"] = query(logs(), per_column(COLUMNS, MISSING))
    sql["dq_full_row_duplicates"] = query(logs(), per_log(ROW_DUPLICATES))
    sql["dq_key_duplicates"] = query(logs(), per_log("""SELECT '{t}' AS table_name, '{keys}' AS key_columns,
        (SELECT count(*) FROM (SELECT 1 FROM {t} GROUP BY {key} HAVING count(*) > 1)) AS duplicate_keys"""))
    sql["dq_repeated_pairs"] = query(logs(), " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, '{','.join(k)}' AS key_columns,
            (SELECT count(*) FROM (SELECT 1 FROM {t} GROUP BY {', '.join(k)} HAVING count(*) > 1)) AS duplicate_keys"""
        for t, k in REPEATED.items()))
    key = REPEATED["flows"]
    sql["dq_key_duplicate_samples"] = query(logs("flows"), f"""SELECT {', '.join(key)}, count(*) AS copies FROM flows
        GROUP BY {', '.join(key)} HAVING count(*) > 1 ORDER BY copies DESC, {', '.join(key)} LIMIT 10""")
    sql["dq_time_horizon"] = query(logs(), per_log("""SELECT '{t}' AS table_name, 'time' AS time_column,
        min(time) AS min_time, max(time) AS max_time, max(time) - min(time) AS time_span_seconds FROM {t}"""))
    sql["dq_numeric"] = query(logs(), per_column(NUMBERS, NUMERIC))
    sql["dq_quantiles_exact"] = query(logs(), per_column(NUMBERS, QUANTILES))
    sql["dq_skew"] = query(logs(), per_column(NUMBERS, SKEW))
    sql["dq_source_overlap"] = query(logs(), per_log("""SELECT '{t}' AS source, min(time_window) AS min_time_window,
        max(time_window) AS max_time_window, count(DISTINCT time_window) AS n_time_windows FROM w_{t}"""))
    sql["dq_feature_horizon"] = query(TABLE, """SELECT 'features' AS source, min(time_window) AS min_time_window,
        max(time_window) AS max_time_window, count(DISTINCT time_window) AS n_time_windows FROM features""")
    sql["dq_label_distribution"] = query(TABLE, f"SELECT {LABEL}, count(*) AS count FROM features GROUP BY ALL")
    sql["dq_flag_distribution"] = query(TABLE, "SELECT redteam_current_flag, count(*) AS count FROM features GROUP BY ALL")
    sql["dq_value_counts"] = query(logs(), " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{t}' AS table_name, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value,
            count(*) AS count FROM {t} GROUP BY ALL ORDER BY count DESC, value LIMIT 20)"""
        for t, cs in VALUE_COUNTS.items() for c in cs))
    sql["dq_event_types"] = query(logs("proc"), "SELECT event_type, count(*) AS count FROM proc GROUP BY ALL")
    sql["dq_distinct_counts"] = query(logs(), per_column(
        DISTINCT_COLUMNS, "SELECT '{t}' AS table_name, '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count FROM {t}"))
    sql["dq_distinct_counts_approx"] = query(logs(), per_column(
        DISTINCT_COLUMNS,
        "SELECT '{t}' AS table_name, '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count, TRUE AS within_error FROM {t}"))
    sql["dq_quantiles_approx"] = query(logs(), per_column(
        NUMBERS, """SELECT '{t}' AS table_name, '{c}' AS column_name, unnest(['q01', 'q25', 'median', 'q75', 'q99']) AS metric,
        TRUE AS within_error"""))
    sql["random_sample"] = query(logs(), per_log(
        "SELECT '{t}' AS table_name, count(*) AS total_rows, TRUE AS as_expected FROM {t}"))
    sql["sample_profile"] = query(logs(), per_column(COLUMNS, """SELECT '{t}' AS table_name, '{c}' AS column_name,
        CASE any_value(typeof({c})) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' ELSE 'string' END AS data_type,
        least(count(*), 100000) AS sampled_rows FROM {t}"""))
    sql["dq_summary"] = query(logs("flows"), per_column(
        {"flows": ["time", "duration", "packet_count", "byte_count"]}, SUMMARY))
    sql["dq_log_reports"] = query(logs(), stacked([p for t in RAW for p in log_report(t)]))
    sql["json_report"] = query(logs("flows"), stacked(log_report("flows")))
    sql["dq_measured_reports"] = query(logs(), " UNION ALL ".join(
        f"SELECT *, (SELECT count(*) FROM {t}) AS rows FROM ({stacked(measured(t, COLUMNS[t], NUMBERS[t]))})" for t in RAW))
    columns = [*TABLE_ORDER, *[c for c in FEATURE_COLUMNS if c not in TABLE_ORDER], LABEL]
    skewed = [c for c in FEATURE_COLUMNS if c != "redteam_current_flag"]
    skew = "CASE WHEN count({c}) > 2 THEN CASE WHEN stddev_pop({c}) = 0 THEN 0.0 ELSE skewness({c}) END END"
    sql["dq_feature_report"] = query(
        [*DERIVED, f"""features AS MATERIALIZED (SELECT computer, time_window, {', '.join(FEATURE_COLUMNS)},
            CAST({NEXT_ROW} AS INTEGER) AS {LABEL} FROM derived)"""],
        stacked([
            *measured("features", columns, [], time=False), *copied("features", columns, ["computer", "time_window"]),
            entry("features", "label_distribution", LABEL, f"CAST({LABEL} AS VARCHAR)", "count(*)", tail=f"FROM features GROUP BY {LABEL}"),
            entry("features", "flag_distribution", "redteam_current_flag", "CAST(redteam_current_flag AS VARCHAR)", "count(*)",
                  tail="FROM features GROUP BY redteam_current_flag"),
            *[entry("features", "time_horizon", "time_window", f"'{m}'", v, tail="FROM features") for m, v in
              (("min", "min(time_window)"), ("max", "max(time_window)"), ("distinct", "count(DISTINCT time_window)"))],
            *[entry("features", "numeric", c, "'skew'", skew.format(c=c), tail="FROM features") for c in skewed],
        ]))
    in_range = {"all": "", "ten_days": "WHERE time_window BETWEEN 240 AND 479"}
    sql["dq_sketch_ranges"] = query(logs(), " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, '{r}' AS range_name, '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS missing_count,
            {f"count(DISTINCT {c})" if c in DISTINCT_COLUMNS[t] else "CAST(NULL AS BIGINT)"} AS distinct_count, TRUE AS within_error
            FROM w_{t} {where} HAVING count(*) > 0"""
        for t in RAW for r, where in in_range.items() for c in dict.fromkeys([*NUMBERS[t], *DISTINCT_COLUMNS[t]])))

    sql["time_split"] = query(SPLIT, """SELECT split, count(*) AS count, min(time_window) AS first_window,
        max(time_window) AS last_window FROM parts GROUP BY ALL""")
    sql["split_label_distribution"] = query(SPLIT, f"SELECT split, {LABEL}, count(*) AS count FROM parts GROUP BY ALL")
    filled = ", ".join(
        f"""round(coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM features)), 6) AS {c}""" for c in IMPUTED)
    sql["impute_median"] = query(TABLE, f"SELECT computer, time_window, {filled} FROM features")
    scaled = ", ".join(
        f"""round(({c} - (SELECT avg({c}) FROM features)) / (SELECT stddev_pop({c}) FROM features), 6) AS {c}"""
        for c in SCALED)
    sql["standardise"] = query(TABLE, f"SELECT computer, time_window, {scaled} FROM features")
    sql["class_weights"] = query(TABLE, f"""SELECT {LABEL} AS label, count(*) AS count,
        round((SELECT count(*) FROM features) / ((SELECT count(DISTINCT {LABEL}) FROM features) * count(*)), 9) AS weight
        FROM features GROUP BY {LABEL}""")
    inputs = [c for c in [*TABLE_ORDER[2:], *FEATURE_COLUMNS] if not c.startswith("redteam")]
    names = ", ".join(f"'{c}'" for c in [*dict.fromkeys(inputs), "(intercept)"])
    sql["train_logistic"] = query(SPLIT, f"""SELECT unnest([{names}]) AS input, count(*) AS train_rows, TRUE AS at_optimum
        FROM parts WHERE split = 'train'""")
    sql["batch_score"] = query(SPLIT, """SELECT computer, time_window, 'logistic_regression_baseline' AS model_name, TRUE AS as_exported
        FROM parts WHERE split = 'test'""")
    sql["forest_splits"] = query(SPLIT, """SELECT CAST(8 AS BIGINT) AS trees, CAST(0 AS BIGINT) AS small_splits,
        count(*) AS scored_rows FROM parts WHERE split = 'test'""")
    sql["refused_lines"] = """
        WITH lines AS (SELECT CASE l_orderkey % 50 WHEN 0 THEN 'too many fields' WHEN 1 THEN 'too few fields' WHEN 2 THEN 'time is no number' END AS reason,
            CAST(floor(l_extendedprice) AS BIGINT) AS byte_count FROM lineitem)
        SELECT CASE WHEN reason IS NULL THEN 'kept' ELSE 'refused' END AS verdict, reason, count(*) AS lines,
            CASE WHEN reason IS NULL THEN CAST(sum(byte_count) AS BIGINT) END AS bytes FROM lines GROUP BY reason"""
    sql["binary_metrics"] = query(SCORES, BINARY)
    sql["roc_auc"] = query(SCORES, AUC)
    sql["average_precision"] = query(SCORES, AP)
    sql["classification_report"] = query(REPORT, """SELECT label_name, class, round(precision, 9) AS precision,
        round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM report""")
    return sql
