"""URL filters: a tree of path templates per host, with templates rejected by how pure their labelled pages are.

Labels come from rules (host, path, verdict): a rule fits its host and all subdomains where the page's path starts with
the rule's, and the longest wins. Pages without a rule are judged by the tree:

1. A path's segments are written with `#` for each run of digits; from DEPTH segments on, the rest is one `**`.
2. From the root down, a node's segments with at least MIN_PAGES pages and one page in SHARE become branches of their
   own; the others are variable and share the wildcard `*`.
3. Branches of a node with MIN_LABELLED labels or more, put in order of their share of blocked pages, merge with the one
   before where the shares differ by no more than Hoeffding's bound: one branch `a|b`, one subtree.
4. A template's purity is its share of blocked labels, smoothed by SMOOTHING labels at its parent's purity; hosts are
   smoothed by the share of all labels. It is rejected at REJECT or more, with MIN_EVIDENCE labels or more of its own.

On Spark. Pages fold into distinct shapes of paths first, so a host with a third of all pages moves as few rows. Each
level is one grouping by (host, node, segment) and one join of shapes, both of shapes only; windows hold the branches of
one node, SHARE + 1 at most. Everything is DataFrame functions.

A url that is null or has no `://` has an empty host and path; it is judged as such, by no rule. Repeated rows count
each time. Names that clash: host, path, rule, verdict, template, purity of the input give way to the results. Ties of
rules of one length: the longer host. A very long path is one of DEPTH segments and `**`. Empty tables give no rows.
"""

from __future__ import annotations

import math
import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import stage

DEPTH = 8
MIN_PAGES, SHARE = 5, 100
MIN_LABELLED, ALPHA = 20, 0.05
SMOOTHING, REJECT, MIN_EVIDENCE = 4.0, 0.9, 5
#: Hoeffding: shares of a and b labels differ by chance up to BOUND * (1 / sqrt(a) + 1 / sqrt(b)).
BOUND = math.sqrt(0.5 * math.log(2 / ALPHA))

RESULTS = ("host", "path", "rule", "verdict", "template", "purity")


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def address(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substr(url, start + 3))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(the rule, its verdict), null where none fits."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(str(r)), len(r.host))):  # the last that fits stays
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found, verdict = F.when(fits, str(rule)).otherwise(found), F.when(fits, rule.verdict).otherwise(verdict)
    return found, verdict


def shape(path: Column) -> Column:
    """The segments of a path, with `#` for digits, joined by `/`."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    parts = F.transform(parts, lambda s: F.regexp_replace(s, "[0-9]+", "#"))
    short = F.when(F.size(parts) > DEPTH, F.concat(F.slice(parts, 1, DEPTH), F.array(F.lit("**")))).otherwise(parts)
    return F.array_join(short, "/")


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("n", "blocked", "allowed")]


def _purity(parent: Column) -> Column:
    return (F.col("blocked") + SMOOTHING * parent) / (F.col("blocked") + F.col("allowed") + SMOOTHING)


def branches(children: DataFrame) -> DataFrame:
    """host, node, segment, branch, blocked, allowed: the branch that each segment (host, node, segment, n, ...) goes to."""
    totals = children.groupBy("host", "node").agg(F.sum("n").alias("total"))
    own = (F.col("n") >= MIN_PAGES) & (SHARE * F.col("n") >= F.col("total"))
    named = children.join(totals, ["host", "node"]).withColumn("name", F.when(own, F.col("segment")).otherwise("*"))
    names = named.groupBy("host", "node", "name").agg(*_sums())
    labels, share = F.col("blocked") + F.col("allowed"), F.col("blocked") / (F.col("blocked") + F.col("allowed"))
    known = names.withColumn("labels", F.when(labels >= MIN_LABELLED, labels)).withColumn("share", F.when(labels >= MIN_LABELLED, share))
    order = Window.partitionBy("host", "node").orderBy(F.col("share").asc_nulls_last(), "name")
    chance = BOUND * (1 / F.sqrt("labels") + 1 / F.sqrt(F.lag("labels").over(order)))
    similar = F.coalesce(F.col("share") - F.lag("share").over(order) <= chance, F.lit(False))
    marked = known.withColumn("new", F.when(similar, 0).otherwise(1))
    numbered = marked.withColumn("group", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    group = Window.partitionBy("host", "node", "group")
    merged = numbered.select(
        "host", "node", "name", F.array_join(F.sort_array(F.collect_list("name").over(group)), "|").alias("branch"),
        F.sum("blocked").over(group).alias("blocked"), F.sum("allowed").over(group).alias("allowed"),
    )
    return named.select("host", "node", "segment", "name").join(merged, ["host", "node", "name"]).drop("name")


def templates(shapes: DataFrame) -> DataFrame:
    """host, shape, template, labels, purity of every shape (host, shape, n, blocked, allowed)."""
    everything = shapes.agg(F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed")).first()
    labels = (everything.blocked or 0) + (everything.allowed or 0)
    share = everything.blocked / labels if labels else 0.0
    hosts = shapes.groupBy("host").agg(*_sums()).select("host", _purity(F.lit(share)).alias("purity"), (F.col("blocked") + F.col("allowed")).alias("labels"))
    rows = shapes.join(hosts, "host").withColumn("node", F.lit(""))
    done = None
    for depth in range(DEPTH + 2):
        rows = stage(rows, "templates")
        parts = F.filter(F.split("shape", "/"), lambda s: s != "")
        ended = rows.filter(F.size(parts) <= depth)
        done = ended if done is None else done.unionByName(ended)
        rows = rows.filter(F.size(parts) > depth).withColumn("segment", F.get(parts, depth))
        if rows.isEmpty():
            break
        children = rows.groupBy("host", "node", "segment").agg(*_sums())
        found = branches(stage(children, "children")).withColumnsRenamed({"blocked": "b", "allowed": "a"})
        joined = rows.join(found, ["host", "node", "segment"])
        purity = (F.col("b") + SMOOTHING * F.col("purity")) / (F.col("b") + F.col("a") + SMOOTHING)
        rows = joined.select(
            "host", "shape", "n", "blocked", "allowed", purity.alias("purity"), (F.col("b") + F.col("a")).alias("labels"),
            F.concat("node", F.lit("/"), "branch").alias("node"),
        )
    return done.select("host", "shape", F.col("node").alias("template"), "labels", "purity")


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url") -> DataFrame:
    """`pages` with host, path, rule, verdict, template, purity."""
    host, path = address(F.col(f"`{url}`"))
    kept = [c for c in pages.columns if c.lower() not in RESULTS]
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], F.struct(host.alias("host"), path.alias("path")).alias("__at"))
    rule, verdict = longest_rule(F.col("__at.host"), F.col("__at.path"), rules)
    rows = rows.select("*", rule.alias("__rule"), verdict.alias("__verdict"), shape(F.col("__at.path")).alias("__shape"))
    counted = rows.groupBy(F.col("__at.host").alias("host"), F.col("__shape").alias("shape")).agg(
        F.count("*").alias("n"), F.count_if(F.col("__verdict") == "block").alias("blocked"), F.count_if(F.col("__verdict") == "allow").alias("allowed")
    )
    found = templates(stage(counted, "shapes")).toDF(*[f"__t_{c}" for c in ("host", "shape", "template", "labels", "purity")])
    joined = rows.join(found, (F.col("__at.host") == F.col("__t_host")) & (F.col("__shape") == F.col("__t_shape")))
    reject = (F.col("__t_purity") >= REJECT) & (F.col("__t_labels") >= MIN_EVIDENCE)
    return joined.select(
        *[F.col(f"`{c}`") for c in kept], F.col("__at.host").alias("host"), F.col("__at.path").alias("path"), F.col("__rule").alias("rule"),
        F.coalesce("__verdict", F.when(reject, "block").otherwise("allow")).alias("verdict"),
        F.col("__t_template").alias("template"), F.round("__t_purity", 6).alias("purity"),
    )
