"""Repeated passages: every string of LENGTH bytes that also starts elsewhere, found and cut out of all documents.

Which strings can meet. Every string of LENGTH bytes has an anchor, the k-gram in it with the smallest hash (the first
such); equal strings have equal anchors at equal places. Neighbouring strings mostly share one, so a document becomes
runs of starts with one anchor. Runs whose anchor's hash occurs once hold no repeated string. Runs with equal hash and
equal bytes repeat in full. Only where runs of one hash differ, their bytes (a window of LENGTH + some) are compared.

How windows are compared. A task joins its windows into one text, sorts its suffixes to more than LENGTH symbols and takes
the Burrows-Wheeler transform. Common prefixes of neighbouring suffixes follow by increasing value, breadth first: a
boundary of length l, extended backwards by each symbol that stands before its interval, gives boundaries of length l + 1.
It stops at LENGTH: suffixes without a boundary share LENGTH symbols or more with their neighbour. Ends of windows are
symbols of their own, so no match crosses a document's end.

Very common anchors. A hash with more than HOT different windows is anchored anew with longer k-grams, which splits its
strings further, down to k = LENGTH, where a hash is one string. So no task gets a whole common passage's documents.

Nulls are empty texts; texts under LENGTH bytes lose nothing. Repeated rows are copies: all their bytes go, from LENGTH
bytes on. Texts are told apart by 128 bits of hash, k-grams and windows by 64 bits each (windows only within one k-gram).
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from eventloom.llm.common import append_columns, stage

LENGTH = 200
#: Sizes of the k-grams, by level.
GRAMS = (24, 140, 190, 200)
HOT = 400
#: Bytes of windows that a task compares, about.
TASK_BYTES = 1 << 20
#: Bytes that are anchored at a time: many short texts, or a piece of a long one, whose runs end with the piece.
PIECE = 1 << 20

_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_BYTES = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.uint64((1 << 23) - 1)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, dtype=np.uint64)]), dtype=np.uint64)


class _Hashes:
    """Hashes of any spans of a byte array."""

    def __init__(self, data: np.ndarray):
        n = max(len(data), PIECE + LENGTH)
        self.back = _powers(_INVERSE, n)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[data] * _powers(_FACTOR, n)[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self._mixed((self.sums[ends] - self.sums[starts]) * self.back[starts])

    def grams(self, size: int) -> np.ndarray:
        """The hash of the span of `size` bytes from each place on."""
        n = len(self.sums) - size
        return self._mixed((self.sums[size:] - self.sums[:n]) * self.back[:n])

    @staticmethod
    def _mixed(x: np.ndarray) -> np.ndarray:
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        return x


Runs = tuple[np.ndarray, ...]


def _anchored(texts: list[bytes], gram: int, length: int) -> Runs:
    """The runs of texts that fit in one piece."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 6
    begins = np.cumsum(sizes) - sizes
    hashes, width = _Hashes(data), length - gram + 1
    grams = hashes.grams(gram)
    least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    anchor = (least & _PLACE).astype(np.int64)  # of every start
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(anchor)]
    inside = np.arange(len(anchor)) + length <= (begins + sizes)[owner]
    new = inside & ((np.diff(anchor, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
    first = np.flatnonzero(new)
    stops = np.flatnonzero(new | ~inside)  # a run ends before the next one, or where its text has no more strings
    last = np.append(stops, len(anchor))[np.searchsorted(stops, first, side="right")] - 1
    window = hashes.of(first, last + length) ^ (anchor[first] - first).astype(np.uint64) * np.uint64(_FACTOR)
    begin = begins[owner[first]]
    found = grams[anchor[first]].view(np.int64), window.view(np.int64)
    return owner[first], *found, first - begin, last - begin, anchor[first] - begin


def anchored(texts: list[bytes], gram: int, length: int = LENGTH) -> Runs:
    """(text, hash of the anchor, hash of the bytes, first start, last start, place of the anchor) of every run of the texts.

    A text longer than a piece is anchored piece by piece from its own start, so equal texts have equal runs.
    """
    found, held, size, place = [], [], 0, 0

    def flush():
        nonlocal held, size, place
        if held:
            owner, *rest = _anchored(held, gram, length)
            found.append((owner + place, *rest))
        place, held, size = place + len(held), [], 0

    for text in texts:
        if len(text) > PIECE:
            flush()
            for offset in range(0, len(text) - length + 1, PIECE):
                owner, grams, window, *inside = _anchored([text[offset : offset + PIECE + length - 1]], gram, length)
                found.append((owner + place, grams, window, *[x + offset for x in inside]))
            place += 1
            continue
        if size + len(text) > PIECE:
            flush()
        held.append(text)
        size += len(text)
    flush()
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 6


def joined(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, sizes) of windows one after the other; the symbol 0 ends each window, and its bytes count from 1."""
    symbols = np.frombuffer(b"".join(w + b"\0" for w in windows), dtype=np.uint8).astype(np.int64) + 1
    sizes = np.array([len(w) + 1 for w in windows], dtype=np.int64)
    symbols[np.cumsum(sizes) - 1] = 0
    return symbols, sizes


def sorted_suffixes(symbols: np.ndarray, sizes: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The suffixes of joined windows in the order of more than `length` symbols."""
    n = len(symbols)
    left = np.repeat(np.cumsum(sizes) - 1, sizes) - np.arange(n)  # symbols before the end
    base = int(symbols.max(initial=0)) + 1
    key, depth = np.zeros(n, dtype=np.int64), max(1, int(62 / np.log2(max(base, 2))))
    for k in range(depth):
        shifted = np.zeros(n, dtype=np.int64)
        shifted[: max(n - k, 0)] = symbols[k:]
        key = key * base + np.where(left >= k, shifted, 0)
    rank = np.unique(key, return_inverse=True)[1]
    while depth < length + 1:
        after = np.zeros(n, dtype=np.int64)
        after[: max(n - depth, 0)] = rank[depth:] + 1
        rank = np.unique(rank * (n + 1) + np.where(left >= depth, after, 0), return_inverse=True)[1]
        depth *= 2
    return np.argsort(rank, kind="stable")


def short_prefixes(symbols: np.ndarray, suffixes: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether each suffix shares fewer than `length` symbols with the one before it, from the transform alone."""
    n = len(symbols)
    before = symbols[suffixes - 1]  # the transform
    before[suffixes == 0] = 0
    by_symbol = np.argsort(before, kind="stable")
    extended = np.empty(n, dtype=np.int64)  # the row of a suffix with its symbol before it
    extended[by_symbol] = np.arange(n)
    same = np.full(n, -1, dtype=np.int64)  # the row before with the same symbol
    same[by_symbol[1:]] = np.where(before[by_symbol[1:]] == before[by_symbol[:-1]], by_symbol[:-1], -1)
    first = symbols[suffixes]
    boundary = np.append((first == 0) | (np.diff(first, prepend=-1) != 0), True)
    new = np.flatnonzero(boundary[:-1])
    for _ in range(1, length):
        every = np.flatnonzero(boundary)
        ends = every[np.searchsorted(every, new, side="right")]
        sizes = ends - new
        rows = np.arange(sizes.sum()) + np.repeat(new - (np.cumsum(sizes) - sizes), sizes)
        rows = rows[(same[rows] < np.repeat(new, sizes)) & (before[rows] > 0)]
        new = np.unique(extended[rows])
        new = new[~boundary[new]]
        if not len(new):
            break
        boundary[new] = True
    return boundary[:-1]


def repeated_starts(symbols: np.ndarray, sizes: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether a string of `length` symbols starts at each symbol of joined windows that starts elsewhere as well."""
    suffixes = sorted_suffixes(symbols, sizes, length)
    long = ~short_prefixes(symbols, suffixes, length)
    repeated = np.zeros(len(symbols), dtype=bool)
    repeated[suffixes[long]] = True
    repeated[suffixes[np.flatnonzero(long) - 1]] = True
    return repeated


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2] - 1


def _runs(texts: DataFrame) -> DataFrame:
    """gram, window, key, first, size of the runs of every text (`key`, `text`); size counts a run's starts."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0)
            for start in range(0, len(keys), 256):
                owner, gram, window, first, last, _ = anchored(batch.column(1).slice(start, 256).to_pylist(), GRAMS[0])
                columns = [pa.array(c, pa.int64()) for c in (gram, window, first, last - first + 1)]
                yield pa.RecordBatch.from_arrays([*columns, keys.take(pa.array(start + owner))], ["gram", "window", "first", "size", "key"])

    return texts.select("key", F.col("text").cast("binary")).mapInArrow(run, "gram BIGINT, window BIGINT, first BIGINT, size BIGINT, key BINARY")


def packed(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with its text compressed, as bytes: texts move twice, and take two thirds of the room this way."""
    place = df.columns.index(text)
    schema = StructType([StructField(f.name, BinaryType()) if f.name == text else f for f in df.schema.fields])

    def run(batches):
        codec = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            columns = list(batch.columns)
            columns[place] = pa.array([None if t is None else codec.compress(t) for t in columns[place].cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return df.mapInArrow(run, schema)


def unpacked(data: bytes | None) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data) if data else b""


def _windows(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """gram, window, n, differing, bytes of the wanted windows (a list per packed text)."""

    def run(batches):
        names = ["gram", "window", "n", "differing", "bytes"]
        for batch in batches:
            for text, windows in zip(batch.column(0), batch.column(1).to_pylist()):
                data = unpacked(text.as_py())
                rows = [(w["gram"], w["window"], w["n"], w["differing"], data[w["first"] : w["first"] + w["size"] + LENGTH - 1]) for w in windows]
                kinds = [pa.int64()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    joined = texts.join(wanted, "key").select("text", "windows")
    return joined.mapInArrow(run, "gram BIGINT, window BIGINT, n BIGINT, differing BIGINT, bytes BINARY")


COVERED = "gram BIGINT, window BIGINT, first BIGINT, last BIGINT"


def compared(windows: list[bytes], length: int = LENGTH) -> np.ndarray:
    """Whether each symbol of the windows, joined with an end each, starts a string that starts elsewhere as well.

    Longer k-grams first narrow the windows down, step by step: a string whose anchor is met once is unique, and parts that
    are the same in all windows repeat. What is left, around the places where windows part, goes through the transform: each
    of its strings holds the anchor of its part, so that k-gram is written as one symbol, and strings are as much shorter.
    """
    begins = np.cumsum([0] + [len(w) + 1 for w in windows])
    marks = np.zeros(begins[-1] + 1, dtype=np.int64)

    def mark(starts: np.ndarray, sizes: np.ndarray | int):
        np.add.at(marks, starts, 1)
        np.add.at(marks, starts + sizes, -1)

    def different(parts: list[bytes], places: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Each part once; those that are met again repeat in full, and have no place any more."""
        number = {part: i for i, part in enumerate(dict.fromkeys(parts))}
        which = np.fromiter(map(number.__getitem__, parts), dtype=np.int64, count=len(parts))
        again = np.bincount(which, minlength=len(number)) > 1
        full = np.flatnonzero(again[which] & (places >= 0))
        if len(full):
            mark(places[full], np.array([len(parts[i]) - length + 1 for i in full]))
        found = np.full(len(number), -1, dtype=np.int64)
        found[which] = places
        found[again] = -1
        return list(number), found

    parts, places = different(windows, begins[:-1])
    for gram in GRAMS[1:-1]:
        size = gram * length // LENGTH
        owner, grams, content, first, last, anchor = anchored(parts, size, length)
        _, group, count = np.unique(grams, return_inverse=True, return_counts=True)
        order = np.lexsort((content, group))
        ordered, values = group[order], content[order]
        fresh = np.append(True, (ordered[1:] != ordered[:-1]) | (values[1:] != values[:-1]))[: len(order)]
        kinds = np.bincount(ordered[fresh], minlength=len(count))
        at = np.where(places[owner] >= 0, places[owner] + first, -1)
        alike = np.flatnonzero((count[group] > 1) & (kinds[group] == 1) & (at >= 0))
        mark(at[alike], (last - first + 1)[alike])
        rest = np.flatnonzero(kinds[group] > 1)
        slices = zip(owner[rest].tolist(), first[rest].tolist(), last[rest].tolist())
        parts, places = different([parts[o][a : b + length] for o, a, b in slices], at[rest])
    if parts:
        # the last anchors again, which differ in nothing but the order of parts
        owner, grams, _, first, last, anchor = anchored(parts, size, length)
        number = np.unique(grams, return_inverse=True)[1]
        symbols, sizes = joined([p[: a - f] + b"\0" + p[a - f + size :] for p, a, f in zip(parts, anchor.tolist(), first.tolist())])
        of = np.cumsum(sizes) - sizes
        symbols[of + anchor] = 257 + number
        repeated = np.flatnonzero(repeated_starts(symbols, sizes, length - size + 1))  # the end of a part starts nothing
        part = np.searchsorted(of, repeated, side="right") - 1
        placed = places[part] >= 0
        mark(places[part[placed]] + repeated[placed] - of[part[placed]], 1)
    return np.cumsum(marks)[:-1] > 0


def _compared(windows: DataFrame) -> DataFrame:
    """gram, window, first, last: ranges of starts in windows that occur once, repeated in another window."""
    tasks = 1 + int(windows.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0))).first()[0]) // TASK_BYTES

    def run(task: pd.DataFrame) -> pd.DataFrame:
        task = task.drop_duplicates(["gram", "window"]).sort_values(["gram", "window"])
        repeated = compared(task["bytes"].tolist())
        begins = np.cumsum([0] + [len(b) + 1 for b in task["bytes"]])
        starts, ends = _ranges(repeated)  # an end of a window starts nothing, so no range leaves its window
        row = np.searchsorted(begins, starts, side="right") - 1
        once = task["n"].to_numpy()[row] == 1
        starts, ends, row = starts[once], ends[once], row[once]
        return pd.DataFrame({
            "gram": task["gram"].to_numpy()[row], "window": task["window"].to_numpy()[row],
            "first": starts - begins[row], "last": ends - begins[row],
        })

    return windows.withColumn("task", F.pmod(F.xxhash64("gram"), F.lit(tasks))).groupBy("task").applyInPandas(run, COVERED)


def _differing(windows: DataFrame) -> DataFrame:
    """Each gram with the number of its different windows."""
    return windows.groupBy("gram").agg(F.count("*").alias("differing"))


def _resolved(windows: DataFrame, level: int = 0) -> DataFrame:
    """Ranges of repeated starts in windows (`gram`, `window`, `n`, `differing`, `bytes`), level by level."""
    covered = _compared(windows.filter(F.col("differing") <= HOT))
    hot = windows.filter(F.col("differing") > HOT)
    if hot.isEmpty():
        return covered
    gram = GRAMS[level + 1]

    def run(batches):
        names = ["up_gram", "up_window", "n", "first", "gram", "window", "bytes"]
        for batch in batches:
            data = batch.column(3).to_pylist()
            owner, grams, found, first, last, _ = anchored(data, gram)
            up = [c.to_numpy(zero_copy_only=False)[owner] for c in batch.columns[:3]]
            parts = [data[o][a : b + LENGTH] for o, a, b in zip(owner.tolist(), first.tolist(), last.tolist())]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in (*up, first, grams, found)], pa.array(parts, pa.binary())], names)

    schema = "up_gram BIGINT, up_window BIGINT, n BIGINT, first BIGINT, gram BIGINT, window BIGINT, bytes BINARY"
    distinct = hot.dropDuplicates(["gram", "window"]).select("gram", "window", "n", "bytes")
    parts = stage(distinct.mapInArrow(run, schema).withColumn("gram", F.xxhash64("up_gram", "gram")), "parts")
    known = stage(parts.groupBy("gram", "window").agg(F.sum("n").alias("n"), F.min("bytes").alias("bytes")), "part-windows")
    counts = stage(_differing(known), "part-grams")
    known = known.join(counts, "gram")
    # a window that occurs twice or more repeats in full; others are compared where a gram has several
    full = known.filter("n > 1").select("gram", "window", F.lit(0).cast("long").alias("from"), (F.length("bytes") - LENGTH).cast("long").alias("to"))
    rest = known.filter("differing > 1").select("gram", "window", "n", "differing", "bytes")
    if level + 2 < len(GRAMS):
        rest = stage(rest, "part-rest")
        full = full.union(_resolved(rest, level + 1))
    full = stage(full, "part-ranges")
    # a window that occurs twice or more repeats in full anyway, so ranges of it would only multiply with its occurrences
    once = parts.filter("n = 1").select("gram", "window", "up_gram", "up_window", F.col("first").alias("at"))
    up = once.join(full, ["gram", "window"])
    return covered.union(up.select("up_gram", "up_window", F.col("at") + F.col("from"), F.col("at") + F.col("to")))


def repeated_ranges(texts: DataFrame) -> DataFrame:
    """key, ranges (first and last covered byte, unordered) of every text (`key`, `text`) that has some."""
    every = stage(_runs(texts), "every-run")
    grams = every.groupBy("gram").agg(F.count("*").alias("n"), F.min("window").alias("least"), F.max("window").alias("most"))
    grams = stage(grams.filter("n > 1").select("gram", (F.col("least") == F.col("most")).alias("alike")), "grams")
    runs = stage(every.join(grams, "gram"), "runs")
    differ = runs.filter("NOT alike")
    source = F.min(F.struct("key", "first", "size")).alias("source")
    windows = stage(differ.groupBy("gram", "window").agg(F.count("*").alias("n"), source), "windows")
    counts = stage(_differing(windows), "window-grams")
    item = F.struct("gram", "window", "n", "differing", "source.first", "source.size")
    wanted = windows.join(counts, "gram").groupBy("source.key").agg(F.collect_list(item).alias("windows"))
    distinct = packed(texts).groupBy("key").agg(F.first("text").alias("text"))
    ranges = _resolved(stage(_windows(distinct, stage(wanted, "wanted")), "window-bytes"))
    once = stage(ranges.toDF("gram", "window", "from", "to"), "ranges")
    places = lambda start, end: F.struct(start.alias("first"), (end + LENGTH - 1).alias("last")).alias("range")
    full = F.col("first") + F.col("size") - 1
    found = runs.filter("alike").select("key", places(F.col("first"), full))
    often = stage(windows.filter("n > 1").select("gram", "window"), "repeated-windows")
    found = found.union(differ.join(often, ["gram", "window"]).select("key", places(F.col("first"), full)))
    found = found.union(differ.join(once, ["gram", "window"]).select("key", places(F.col("first") + F.col("from"), F.col("first") + F.col("to"))))
    return found.groupBy("key").agg(F.collect_set("range").alias("ranges"))


def _key(text: str) -> Column:
    """Equal texts have equal keys: 128 bits."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def covered(size: int, ranges: list[dict] | None) -> np.ndarray:
    """Whether each byte lies in a range."""
    depth = np.zeros(size + 1, dtype=np.int64)
    for r in ranges or ():
        depth[r["first"]] += 1
        depth[r["last"] + 1] -= 1
    return np.cumsum(depth)[:-1] > 0


def with_ranges(documents: DataFrame, text: str = "text") -> DataFrame:
    """`documents` with their text packed and with `__ranges`, null where nothing repeats."""
    texts = documents.select(_key(text).alias("key"), F.col(text).alias("text")).filter(F.octet_length("text") >= LENGTH)
    ranges = stage(repeated_ranges(texts), "repeated").toDF("__key", "__ranges")
    return packed(documents.withColumn("__key", _key(text)), text).join(ranges, "__key", "left").drop("__key")


def digests(documents: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    found = with_ranges(documents.select("doc_id", F.col(text).alias("text")))

    def run(batches):
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        for batch in batches:
            rows = []
            for doc, text, ranges in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                data = unpacked(text.as_py())
                if ranges:
                    out = covered(len(data), ranges)
                    spans, removed = len(_ranges(out)[0]), int(out.sum())
                    kept = np.frombuffer(data, dtype=np.uint8)[~out].tobytes()
                else:
                    spans, removed, kept = 0, 0, data
                rows.append((doc, len(data), removed, spans, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 4 + [pa.string()])], names)

    return found.select("doc_id", "text", "__ranges").mapInArrow(
        run, "doc_id BIGINT, n_bytes BIGINT, n_removed BIGINT, n_spans BIGINT, kept_sha256 STRING"
    )


def removed(documents: DataFrame, text: str = "text") -> DataFrame:
    """`documents` with repeated passages cut out of `text`; characters that a cut leaves in part go as well."""
    found = with_ranges(documents, text)
    columns = documents.columns
    place, at = columns.index(text), len(columns)

    def run(batches):
        for batch in batches:
            texts = []
            for text, ranges in zip(batch.column(place), batch.column(at).to_pylist()):
                data = unpacked(text.as_py())
                if ranges:
                    data = np.frombuffer(data, dtype=np.uint8)[~covered(len(data), ranges)].tobytes()
                texts.append(data.decode("utf-8", "ignore") if text.is_valid else None)
            arrays = list(batch.columns[:at])
            arrays[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names[:at])

    schema = documents.schema
    return found.select(*columns, "__ranges").mapInArrow(run, schema)
