"""The newer operators in SQL of another engine: written from their contracts, by other methods than the operators' own."""

from __future__ import annotations

from eventloom.llm import urls

#: crc32 (polynomial 0xEDB88320) of a list of bytes: `entries` has what each byte does, `crc32(bytes)` folds them.
CRC_TABLE = """crc_entries AS MATERIALIZED (
    SELECT list_transform(range(256), lambda b: list_reduce(
        [b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS entries
)"""


def crc32(data: str) -> str:
    """crc32 of a list of byte values, with `entries` in scope."""
    step = "xor(c >> 8, entries[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: {step}), 4294967295)"


def ascii_bytes(text: str) -> str:
    return f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"


REPAIR_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           {crc32(ascii_bytes("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"))} % 20 AS fate
    FROM conversations, crc_entries
),
damaged AS (
    SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
           CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy
    FROM keyed WHERE fate <> 0
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged
),
judged AS (
    SELECT *, CASE
        WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault,
        left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS earlier
    FROM placed
),
counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM judged GROUP BY conv_id
),
moves(state, initial, letter, price, next, name) AS (
    -- what a row with such an initial (* is any) can become in each state: 0 nothing yet, 1 after s, 2 after u, 3 after a
    VALUES (0, 's', 'K', 0, 1, NULL), (0, 'u', 'K', 0, 2, NULL), (1, 'u', 'K', 0, 2, NULL), (3, 'u', 'K', 0, 2, NULL), (2, 'a', 'K', 0, 3, NULL),
           (0, '*', 'R', 1, 2, 'user'), (1, '*', 'R', 1, 2, 'user'), (3, '*', 'R', 1, 2, 'user'), (2, '*', 'R', 1, 3, 'assistant')
),
inserts(state, next, name) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
steps AS (
    SELECT state AS old, initial, '' AS put, letter, price, next, name FROM moves
    UNION ALL
    SELECT s.state, m.initial, s.name || ':' AS put, m.letter, m.price, m.next, m.name FROM inserts s JOIN moves m ON m.state = s.next
),
walk AS (
    SELECT conv_id, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines FROM counted
    UNION ALL
    SELECT * FROM (
        SELECT w.conv_id, r.i, coalesce(t.next, w.state) AS state,
               w.cost + CASE WHEN t.letter IS NULL THEN 2
                             ELSE t.price + CASE WHEN t.put <> '' THEN 5 ELSE 0 END + CASE WHEN r.fault = 'truncated' THEN 5 ELSE 0 END END AS cost,
               w.audit || CASE WHEN t.letter IS NULL THEN 'D' ELSE CASE WHEN t.put <> '' THEN 'I' ELSE '' END || t.letter END AS audit,
               w.lines || CASE WHEN t.letter IS NULL THEN []::VARCHAR[]
                               ELSE CASE WHEN t.put <> '' THEN [t.put] ELSE []::VARCHAR[] END || [coalesce(t.name, r.role) || ':' || r.text] END AS lines
        FROM walk w JOIN judged r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
        LEFT JOIN (SELECT * FROM steps UNION ALL SELECT DISTINCT old, NULL, NULL, NULL, NULL::INT, NULL::INT, NULL FROM steps) t
          ON t.old = w.state AND (t.letter IS NULL OR (coalesce(r.fault, '') NOT IN ('blank', 'duplicate')
             AND CASE WHEN t.letter = 'K' THEN t.initial = r.initial
                      ELSE NOT (r.initial = CASE t.next WHEN 2 THEN 'u' ELSE 'a' END) END))
    )
    QUALIFY row_number() OVER (PARTITION BY conv_id, i, state ORDER BY cost, audit) = 1
),
ended AS (
    SELECT w.conv_id, w.cost + CASE w.state WHEN 2 THEN 5 WHEN 1 THEN 10 ELSE 0 END AS cost,
           w.audit || CASE w.state WHEN 2 THEN 'I' WHEN 1 THEN 'II' ELSE '' END AS audit,
           w.lines || CASE w.state WHEN 2 THEN ['assistant:'] WHEN 1 THEN ['user:', 'assistant:'] ELSE []::VARCHAR[] END AS lines
    FROM walk w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i
),
best AS (SELECT * FROM ended QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1)
SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank,
       coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated,
       coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit,
       sha256(coalesce(array_to_string(b.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
"""


_POINTS = "list_transform(string_split(doc_id || ':' || run, ''), lambda x: unicode(x)::BIGINT)"
#: UTF-8 of code points below 0x800.
_UTF8 = f"flatten(list_transform({_POINTS}, lambda p: CASE WHEN p < 128 THEN [p] ELSE [192 | (p >> 6), 128 | (p & 63)] END))"

SPELLING_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS MATERIALIZED (
    SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, run, count(*) AS times FROM (
        SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00c0-\u00ff]{{7,}}')),
                                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
    GROUP BY ALL
),
coded AS (SELECT run, times, {crc32(_UTF8)} AS code FROM runs, crc_entries),
spoilt AS (
    SELECT times, CASE WHEN code % 31 = 0 THEN left(run, code % length(run)) || substr(run, code % length(run) + 2) ELSE run END AS word FROM coded
),
vocabulary AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM spoilt WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
shorter AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)),
near AS MATERIALIZED (
    SELECT DISTINCT * FROM (
        SELECT a.word, b.word AS near, b.n AS near_n FROM shorter a JOIN shorter b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
        UNION ALL SELECT a.word, v.word, v.n FROM shorter a JOIN vocabulary v ON v.word = a.rest
        UNION ALL SELECT v.word, a.word, a.n FROM shorter a JOIN vocabulary v ON v.word = a.rest)
),
best AS (SELECT word, near, near_n FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
forms AS MATERIALIZED (
    SELECT v.word, v.n, coalesce(k.n_near, 0)::BIGINT AS n_near, CASE WHEN b.near_n >= 10 * v.n THEN b.near END AS form,
           CASE WHEN b.near_n >= 10 * v.n THEN b.near_n END AS form_n
    FROM vocabulary v LEFT JOIN best b USING (word) LEFT JOIN (SELECT word, count(*) AS n_near FROM near GROUP BY word) k USING (word)
),
walk AS (
    SELECT word, word AS at FROM forms
    UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN walk w ON w.word = f.word JOIN forms e ON e.word = w.at AND e.form IS NULL
"""

_RULE_ROWS = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in urls.RULES)


def _level(k: int) -> str:
    """The branches below the nodes of level k - 1, and the shapes that go on there."""
    key = f"r.host = n{k}.host AND r.node = n{k}.node"
    return f"""
c{k} AS MATERIALIZED (
    SELECT host, node, parts[{k}] AS segment, sum(n) AS n, sum(blocked) AS blocked, sum(allowed) AS allowed
    FROM r{k - 1} WHERE len(parts) >= {k} GROUP BY ALL
),
n{k} AS MATERIALIZED (
    SELECT *, CASE WHEN n >= {urls.MIN_PAGES} AND {urls.SHARE} * n >= sum(n) OVER (PARTITION BY host, node) THEN segment ELSE '*' END AS name FROM c{k}
),
g{k} AS MATERIALIZED (
    SELECT *, CASE WHEN b + a >= {urls.MIN_LABELLED} THEN (b + a)::DOUBLE END AS labels, CASE WHEN b + a >= {urls.MIN_LABELLED} THEN b / (b + a)::DOUBLE END AS share
    FROM (SELECT host, node, name, sum(blocked)::BIGINT AS b, sum(allowed)::BIGINT AS a FROM n{k} GROUP BY ALL)
),
m{k} AS MATERIALIZED (
    SELECT *, sum(CASE WHEN alike THEN 0 ELSE 1 END) OVER (PARTITION BY host, node ORDER BY share NULLS LAST, name ROWS UNBOUNDED PRECEDING) AS part
    FROM (SELECT *, coalesce(share - lag(share) OVER w <= {urls.BOUND!r} * (1 / sqrt(labels) + 1 / sqrt(lag(labels) OVER w)), false) AS alike
          FROM g{k} WINDOW w AS (PARTITION BY host, node ORDER BY share NULLS LAST, name))
),
b{k} AS MATERIALIZED (
    SELECT host, node, part, array_to_string(list_sort(list(name)), '|') AS branch, sum(b)::BIGINT AS b, sum(a)::BIGINT AS a FROM m{k} GROUP BY ALL
),
r{k} AS MATERIALIZED (
    SELECT r.host, r.shape, r.parts, r.n, r.blocked, r.allowed, r.node || '/' || b.branch AS node,
           (b.b + {urls.SMOOTHING} * r.purity) / (b.b + b.a + {urls.SMOOTHING}) AS purity, b.b + b.a AS labels
    FROM r{k - 1} r JOIN n{k} ON {key} AND r.parts[{k}] = n{k}.segment AND len(r.parts) >= {k}
    JOIN m{k} ON m{k}.host = r.host AND m{k}.node = r.node AND m{k}.name = n{k}.name
    JOIN b{k} b ON b.host = r.host AND b.node = r.node AND b.part = m{k}.part
)"""


URL_SQL = rf"""
WITH rules(verdict, host, path) AS (VALUES {_RULE_ROWS}),
cut AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
),
parsed AS MATERIALIZED (
    SELECT row_number() OVER () AS nr, page_id,
           translate(regexp_extract(coalesce(rest, ''), '\A([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(rest, ''), '\A[^/?#]*([^?#]*)', 1) AS path
    FROM cut
),
fits AS (
    SELECT p.nr, arg_max(r.host || r.path, length(r.host || r.path) * 1000 + length(r.host)) AS rule,
           arg_max(r.verdict, length(r.host || r.path) * 1000 + length(r.host)) AS label
    FROM parsed p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.nr
),
pages_ AS MATERIALIZED (
    SELECT p.*, f.rule, f.label, CASE WHEN len(parts) > {urls.DEPTH} THEN parts[1:{urls.DEPTH}] || ['**'] ELSE parts END AS parts
    FROM (SELECT *, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: regexp_replace(s, '[0-9]+', '#', 'g')) AS parts FROM parsed) p
    LEFT JOIN fits f ON f.nr = p.nr
),
shapes AS (
    SELECT host, array_to_string(parts, '/') AS shape, any_value(parts) AS parts, count(*) AS n,
           count(*) FILTER (label = 'block') AS blocked, count(*) FILTER (label = 'allow') AS allowed
    FROM pages_ GROUP BY host, shape
),
overall AS (SELECT coalesce(sum(blocked) / nullif(sum(blocked) + sum(allowed), 0)::DOUBLE, 0) AS share FROM shapes),
hosts AS (
    SELECT host, (sum(blocked) + {urls.SMOOTHING} * any_value(share)) / (sum(blocked) + sum(allowed) + {urls.SMOOTHING}) AS purity,
           sum(blocked) + sum(allowed) AS labels
    FROM shapes, overall GROUP BY host
),
r0 AS MATERIALIZED (SELECT s.*, '' AS node, purity, labels FROM shapes s JOIN hosts USING (host)),
{",".join(_level(k) for k in range(1, urls.DEPTH + 2))},
ended AS ({" UNION ALL ".join(f"SELECT host, shape, node, purity, labels FROM r{k} WHERE len(parts) = {k}" for k in range(urls.DEPTH + 2))})
SELECT p.page_id, p.host, p.path, p.rule,
       coalesce(p.label, CASE WHEN e.purity >= {urls.REJECT} AND e.labels >= {urls.MIN_EVIDENCE} THEN 'block' ELSE 'allow' END) AS verdict,
       e.node AS template, round(e.purity, 6) AS purity
FROM pages_ p JOIN ended e ON e.host = p.host AND e.shape = array_to_string(p.parts, '/')
"""
