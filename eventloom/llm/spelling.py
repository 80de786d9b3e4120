"""Spelling variants: pairs of words one edit apart, from a vocabulary acceptor composed with an edit and with itself.

The machine. A vocabulary is a minimised acyclic acceptor: one state per set of possible endings. Composed with a
transducer that inserts, deletes or replaces exactly one code point, and with the acceptor again, it accepts the pairs
that are near. Before the edit both copies are in one state, so the composition walks the acceptor; at the edit it takes
two different arcs (replaced) or one arc on one side only (inserted, deleted); after it, it follows equal arcs on both
sides and accepts where both end. States with one ending only cannot reach a pair and are not entered.

Initial-state partitions. Two near words share their first half, or their last half, counted on the shorter one. So the
initial state has an arc for each half that words have, and what lies behind an arc is a small acceptor of the words'
middles: every word is behind four arcs (as the shorter or the longer one, by its first or its last half). Where more than
PART_WORDS words lie behind one arc, it is split by the halves of the middle, again and again, down to one code point,
so no task meets a whole common half. The place of the edit says which one part has to accept a pair: none is met twice.

On Spark. Words are counted by built-in functions, folded before they move. Parts are dealt by key and read in order; a
task builds acceptors for ACCEPTOR_WORDS words at a time, with shared states. Pairs are folded per word; roots are found
by pointer doubling (a form is ten times as common as its variant, so chains are short).

Null texts have no words; a null doc_id counts as the empty text. Repeated rows count each time. Ties of n go to the
smallest word in code-point order. Runs of any length are words. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import stage

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form is so many times as common as its variant.
FACTOR = 10
#: Of all words in a document, one in so many loses a code point (by hash).
SPOILT = 31
PART_WORDS = 1000
ACCEPTOR_WORDS = 20_000
_OPEN = 1 << 30


class Acceptor:
    """Minimised acyclic acceptors that share their states: equal sets of endings are one state."""

    def __init__(self):
        self.states: dict[tuple, int] = {}
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.endings: list[int] = []

    def _state(self, final: bool, arcs: list[tuple[str, int]]) -> int:
        key = (final, *arcs)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = len(self.arcs)
            self.arcs.append(dict(arcs))
            self.final.append(final)
            self.endings.append(final + sum(self.endings[t] for _, t in arcs))
        return found

    def add(self, words: list[str]) -> int:
        """The initial state of the acceptor of different words in code-point order."""
        path: list[list] = [[False, []]]  # of the last word: (final, arcs) of states that may still grow
        last = ""
        for word in words:
            shared = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                shared += 1
            self._close(path, last, shared)
            path.extend([False, []] for _ in range(len(word) - shared))
            path[-1][0] = True
            last = word
        self._close(path, last, 0)
        return self._state(path[0][0], path[0][1])

    def _close(self, path: list[list], word: str, depth: int):
        while len(path) > depth + 1:
            final, arcs = path.pop()
            path[-1][1].append((word[len(path) - 1], self._state(final, arcs)))

    def common(self, p: int, q: int, length: int, barred: str = "") -> Iterator[str]:
        """Endings of exactly `length` that both states have and that do not begin with `barred`."""
        if not length:
            if self.final[p] and self.final[q]:
                yield ""
            return
        stack = [(p, q, "")]
        while stack:
            p, q, done = stack.pop()
            few, many = self.arcs[p], self.arcs[q]
            if len(few) > len(many):
                few, many = many, few
                p, q = q, p
            for symbol, target in few.items():
                other = many.get(symbol)
                if other is None or (not done and symbol == barred):
                    continue
                if len(done) + 1 == length:
                    if self.final[target] and self.final[other]:
                        yield done + symbol
                else:
                    stack.append((target, other, done + symbol))

    def near(self, initial: int, length: int, before: int) -> Iterator[tuple[str, str]]:
        """Pairs of words one edit apart, the shorter one of `length`, first different before the place `before`."""
        stack = [(initial, "")]
        while stack:
            state, done = stack.pop()
            arcs = list(self.arcs[state].items())
            rest = length - len(done)
            for k, (a, to_a) in enumerate(arcs):
                for ending in self.common(state, to_a, rest, a):  # a is inserted
                    yield done + ending, done + a + ending
                if rest > 0:
                    for b, to_b in arcs[:k]:
                        for ending in self.common(to_a, to_b, rest - 1):
                            yield done + a + ending, done + b + ending
                if self.endings[to_a] > 1 and len(done) + 1 < before:
                    stack.append((to_a, done + a))


def _near_words(batches):
    """Rows (key, m, a, b, top, word, n), a part at a time, to (word, n, near, near_n), both ways."""
    held, size, rows, last = [], 0, [], None

    def flush():
        acceptor, found = Acceptor(), []
        for (m, a, b, top), words in held:
            middles = {w[a : len(w) - b]: (w, n) for w, n in words}
            initial = acceptor.add(sorted(middles))
            for x, y in acceptor.near(initial, m - a - b, top - a):
                found.append((*middles[x], *middles[y]))
                found.append((*middles[y], *middles[x]))
        return found

    def batch_of(found):
        columns = list(zip(*found)) or [[]] * 4
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["word", "n", "near", "near_n"])

    for batch in batches:
        for key, m, a, b, top, word, n in zip(*[c.to_pylist() for c in batch.columns]):
            if key != last:
                if len(rows) > 1:
                    held.append((place, rows))
                    size += len(rows)
                if size >= ACCEPTOR_WORDS:
                    yield batch_of(flush())
                    held, size = [], 0
                last, rows, place = key, [], (m, a, b, top)
            rows.append((word, n))
    if len(rows) > 1:
        held.append((place, rows))
    yield batch_of(flush())


def words(documents: DataFrame, text: str = "text") -> DataFrame:
    """word, n: lower-cased runs of letters in all texts, one in SPOILT without one code point, that are long and repeat."""
    run = F.explode(F.regexp_extract_all(F.col(text), F.lit(f"([{LETTERS}]{{{LEAST_LENGTH},}})"), F.lit(1)))
    identity = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = documents.select(identity.alias("id"), run.alias("run"))
    runs = runs.withColumn("run", F.translate("run", string.ascii_uppercase, string.ascii_lowercase))
    code = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    spoilt = F.expr("overlay(run PLACING '' FROM cast(code % length(run) AS INT) + 1 FOR 1)")
    word = F.when(F.col("code") % SPOILT == 0, spoilt).otherwise(F.col("run"))
    found = runs.withColumn("code", code).select(word.alias("word")).filter(F.length("word") >= LEAST_LENGTH)
    return found.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _part(m: Column, a: Column, b: Column, top: Column) -> Column:
    return F.struct(m.alias("m"), a.alias("a"), b.alias("b"), top.alias("top"))


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows (word, n, part) with the key of their part: its place, and what its words share."""
    flat = rows.select("word", "n", "part.*")
    fixed = [F.expr("substring(word, 1, a)"), F.expr("right(word, b)")]
    return flat.withColumn("key", F.concat_ws(" ", "m", "a", "b", "top", *fixed))


def _halves(word: Column, shortest: int) -> Column:
    """The parts of a word: as the shorter one of a pair and as the longer one, by its first and by its last half."""
    zero, found = F.lit(0), []
    for m in (F.length(word), F.length(word) - 1):
        half = F.floor(m / 2).cast("int")
        found.append(F.array(_part(m, half, zero, F.lit(_OPEN)), _part(m, zero, m - half, half)))
    return F.when(F.length(word) > shortest, F.concat(*found)).otherwise(found[0])


def _split() -> Column:
    """The two parts that a part with too many words falls into."""
    m, a, b, top = (F.col(c) for c in ("m", "a", "b", "top"))
    half = F.floor((m - a - b) / 2).cast("int")
    return F.array(_part(m, a + half, b, top), _part(m, a, m - a - half, a + half))


def near_pairs(vocabulary: DataFrame, shortest: int = 1) -> DataFrame:
    """word, n, near, near_n of all pairs one edit apart, both ways, of a vocabulary (word, n) of different words.

    No word is shorter than `shortest`.
    """
    rows = _keyed(vocabulary.select("word", "n", F.explode(_halves(F.col("word"), shortest)).alias("part")))
    schema, found = "word STRING, n BIGINT, near STRING, near_n BIGINT", None
    while True:
        rows = stage(rows, "parts")
        counts = rows.groupBy("key").agg(F.count("*").alias("words")).filter("words > 1")
        met = rows.join(counts, "key")
        large = (F.col("words") > PART_WORDS) & (F.col("m") - F.col("a") - F.col("b") > 1)
        met = stage(met.select("key", "m", "a", "b", "top", "word", "n", large.alias("large")), "shared")
        parts = met.filter("NOT large").drop("large").repartition("key").sortWithinPartitions("key")
        pairs = stage(parts.mapInArrow(_near_words, schema), "near")
        found = pairs if found is None else found.unionAll(pairs)
        rows = met.filter("large")
        if rows.isEmpty():
            return found
        rows = _keyed(rows.select("word", "n", F.explode(_split()).alias("part")))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of a table of links (word, form) without cycles."""
    links = stage(forms.select("word", F.col("form").alias("to")), "links")
    while True:
        ahead = links.select(F.col("word").alias("to"), F.col("to").alias("next"))
        joined = stage(links.join(ahead, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("more")), "links")
        links = joined.select("word", "to")
        if joined.filter("more").isEmpty():
            return links.withColumnRenamed("to", "root")


def variants(vocabulary: DataFrame, shortest: int = 1) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n)."""
    vocabulary = stage(vocabulary, "vocabulary")
    alone = vocabulary.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))).alias("best")
    folded = near_pairs(vocabulary, shortest).unionAll(alone).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best)
    often = -F.col("best.less") >= FACTOR * F.col("n")
    found = stage(folded.select("word", "n", "n_near", F.when(often, F.col("best.form")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(found.filter("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
