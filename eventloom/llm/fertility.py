"""Quality rules from how public vocabularies cut a text.

Base counts of a text: words, code points in them, symbols, repeated lines, words in repeated windows of eight words.
Fertility: code points per token of a byte-level vocabulary and of a piece vocabulary with byte fallback, the share of
tokens that are such single bytes, and the entropy of a text's tokens (bits, over the largest that its length allows).
Words are cut one by one, their letters apart from their signs, so white space has no part in it.

Each language has a band per measure; a text outside one of them is not kept. Where no language is given, the script of
most letters takes its place. Bands come from all texts that pass the base rules: from the quartiles of the group (exact,
on a grid of 1/256), STRETCH interquartile ranges (at least SLACK) to either side. A group of n texts tells its quartiles
up to an error of about SLACK times FEW / sqrt(n), and a text of n tokens its measures likewise; both join the width as
variances add. Entropy falls with length even so, and has a band for each doubling of the tokens. No group is judged by the texts of another; one with a single text cannot reject it.

Null and empty texts have no words and fail the base rules. Repeated rows count each for itself. Very long texts are
measured whole, all their letters for the script. Columns of the input that are named like a measure or `kept` give way to
it; any other stays. Empty tables give none.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import WORD, append_columns, stage
from eventloom.llm.vocab import WORDS, Memory, as_bytes, file_tokenizer, library_ids, public_path

VOCABULARY, FALLBACK = "byte_bpe_50k.json", "piece_bpe_32k.model"
SYMBOLS = re.compile(r"[#*$%&|<>]")
WINDOW = 8
LEAST_WORDS = 20
REPEATED_PERCENT = 30
STRETCH = 4.0
FEW = 10.0
MEASURES = {"chars_per_token": 0.2, "chars_per_piece": 0.2, "byte_share": 0.02, "entropy": 0.05}  # with SLACK
GRID = 256

_WORD = re.compile(WORD)
_ASCII_LETTER = re.compile("[A-Za-z]")
BASE = "n_words BIGINT, word_chars BIGINT, n_symbols BIGINT, n_dup_lines BIGINT, n_repeat_words BIGINT, base_failed BOOLEAN"


@lru_cache(maxsize=1)
def _vocabularies(path: str, fallback: str) -> tuple[Memory, np.ndarray]:
    """For each part of a word its number of byte-level tokens and its pieces; and which pieces are single bytes."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=fallback)
    single = np.array([pieces.is_byte(i) for i in range(pieces.get_piece_size())])
    ids = library_ids(file_tokenizer(path))

    def encode(parts: list[str]) -> list[tuple[int, bytes]]:
        tokens = ids([f" {p}" for p in parts])
        return [(len(t) // 4, as_bytes(i)) for t, i in zip(tokens, pieces.encode(parts, num_threads=1))]

    return Memory(encode), single


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more, the first occurrence included."""
    if len(words) <= window:
        return 0
    numbers: dict[str, int] = {}
    level = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    # at first by a hash of each window: most texts repeat none
    mixed = np.zeros(len(words) - window + 1, dtype=np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + level[k : len(words) - window + 1 + k].astype(np.uint64)
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():
        return 0
    step = 1
    while step < window:  # numbers of all windows of 2, 4, 8 words
        pairs = level[:-step] * (int(level.max()) + 1) + level[step:]
        level = np.unique(pairs, return_inverse=True)[1]
        step *= 2
    again = np.bincount(level)[level] > 1
    if not again.any():
        return 0
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    return len(lines) - len(set(lines))


@lru_cache(maxsize=1 << 12)
def _script(code: int) -> str | None:
    """The script that a letter's name begins with; None for what is no letter."""
    letter = chr(code)
    return unicodedata.name(letter, "?").split()[0] if letter.isalpha() else None


def script_of(text: str) -> str:
    """The script of most letters of a text, all of them counted; the first by name where two are as frequent."""
    if text.isascii():
        return "LATIN" if _ASCII_LETTER.search(text) else "none"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if points.max() < 1 << 13:
        counts = np.bincount(points)
        codes = np.flatnonzero(counts)
        counts = counts[codes]
    else:
        codes, counts = np.unique(points, return_counts=True)
    names = Counter()
    for code, times in zip(codes.tolist(), counts.tolist()):
        if (name := _script(code)) is not None:
            names[name] += times
    return min(names, key=lambda n: (-names[n], n)) if names else "none"


def measured(documents: DataFrame, text: str = "text", path: str | None = None, fallback: str | None = None) -> DataFrame:
    """`documents` with the base counts, `base_failed`, the measures and `script`."""
    path, fallback = path or public_path(VOCABULARY), fallback or public_path(FALLBACK)

    def build():
        memory, single = _vocabularies(path, fallback)

        def run(texts: list[str]) -> dict[str, list]:
            parts = [WORDS.findall(t) for t in texts]
            values = memory.values([p for part in parts for p in part])
            rows, at = [], 0
            for text, part in zip(texts, parts):
                words = _WORD.findall(text)
                n, chars, repeats = len(words), sum(map(len, words)), repeated_words(words)
                own = values[at : at + len(part)]
                at += len(part)
                n_tokens = sum(v[0] for v in own)
                ids = np.frombuffer(b"".join(v[1] for v in own), dtype="<u4")
                often = np.unique(ids, return_counts=True)[1] / max(len(ids), 1)
                entropy = float(-(often * np.log2(often)).sum() / np.log2(len(ids))) if len(ids) > 1 else 0.0
                rows.append((
                    n, chars, len(SYMBOLS.findall(text)), repeated_lines(text), repeats,
                    n < LEAST_WORDS or 100 * repeats > REPEATED_PERCENT * n,
                    chars / max(n_tokens, 1), chars / max(len(ids), 1), float(single[ids].mean()) if len(ids) else 0.0, entropy, script_of(text),
                ))
            return dict(zip(names, map(list, zip(*rows))))

        return run

    fields = f"{BASE}, {', '.join(f'{m} DOUBLE' for m in MEASURES)}, script STRING"
    names = [f.split()[0] for f in fields.split(", ")]
    return append_columns(documents, text, fields, build)


def _tokens() -> Column:
    """Tokens of a text, one at least."""
    return F.greatest(F.try_divide("word_chars", "chars_per_token"), F.lit(1.0))


def _band(measure: str) -> Column:
    """The name of the band that judges a text's measure."""
    return F.concat(F.lit(f"{measure} "), F.floor(F.log2(_tokens())).cast("string")) if measure == "entropy" else F.lit(measure)


def bands(measures: DataFrame) -> DataFrame:
    """__group, band, q1, q3, width: for every group with a usable text, whatever their number."""
    usable = measures.filter(~F.col("base_failed"))
    cell = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), _band(m).alias("band"), F.floor(F.col(m) * GRID).alias("cell")) for m in MEASURES]))
    counted = usable.select("__group", cell.alias("x")).groupBy("__group", "x.measure", "x.band", "x.cell").count()
    of_group = Window.partitionBy("__group", "band")  # a row per cell of the grid
    running = F.sum("count").over(of_group.orderBy("cell"))
    ranked = counted.select("__group", "measure", "band", "cell", running.alias("upto"), F.sum("count").over(of_group).alias("texts"))
    quartile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("texts"), F.col("cell"))) / GRID
    found = ranked.groupBy("__group", "measure", "band").agg(quartile(0.25).alias("q1"), quartile(0.75).alias("q3"), F.first("texts").alias("texts"))
    slack = F.coalesce(*[F.when(F.col("measure") == m, F.lit(s)) for m, s in MEASURES.items()])
    width = F.hypot(F.greatest(STRETCH * (F.col("q3") - F.col("q1")), slack), slack * FEW / F.sqrt("texts"))
    return found.select("__group", "band", "q1", (F.col("q3") + 1 / GRID).alias("q3"), width.alias("width"))


def judged(documents: DataFrame, text: str = "text", language: str | None = "lang") -> DataFrame:
    """The columns of `documents` but the text, the measures, and `kept`."""
    group = F.coalesce(F.col(language), F.lit("none")) if language else F.lit("none")
    found = measured(documents, text).withColumn("__group", F.when(group == "none", F.concat(F.lit("script "), "script")).otherwise(group))
    found = stage(found.drop(text), "fertility")
    rows = bands(found).groupBy("__group").agg(F.map_from_entries(F.collect_list(F.struct("band", F.struct("q1", "q3", "width")))).alias("__bands"))
    rows = stage(rows, "bands")
    joined = found.join(rows, "__group", "left")

    def inside(measure: str) -> Column:
        band = F.col("__bands")[_band(measure)]
        width = F.hypot(band["width"], MEASURES[measure] * FEW / F.sqrt(_tokens()))
        return F.coalesce(F.col(measure).between(band["q1"] - width, band["q3"] + width), F.lit(True))

    fits = reduce(Column.__and__, map(inside, MEASURES))
    return joined.withColumn("kept", ~F.col("base_failed") & fits).drop("__bands", "__group")
