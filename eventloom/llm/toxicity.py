"""Toxic documents and the sentences that make them so, from labels of whole documents (multiple-instance learning).

A sentence with logit bias + sum of its words' weights has the score p, the part of its probability that goes beyond the
bare bias. A document is toxic if any of its sentences is: its score is the noisy-or 1 - prod(1 - p). The weights are trained on document labels alone by proximal gradient steps on
the log loss of that score; the penalty on absolute weights keeps the words that carry no label at zero, so long clean
texts do not add up to a toxic one. Sentences whose own score is high are the offending ones.

Training uses a sample of the labelled rows: per class the TRAIN_ROWS first ones by hash of doc_id, of at most
TRAIN_CHARS characters each. Everything else, the scores among them, covers all rows and whole texts.

Null and empty texts have no sentence and score 0. Labels other than 0 and 1, null labels and labels without a document
train nothing; with one class or none, nothing is learnt and all documents score 0. A document labelled twice trains twice.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import append_columns, crc_of_id

TRAIN_ROWS = 3000
TRAIN_CHARS = 200_000
#: Characters of all texts that a model is fitted on, per class; what the driver holds.
TRAIN_TOTAL = 16_000_000
DIMENSIONS = 1 << 22
STEPS = 150
PENALTY = 3e-4
#: The bias: a sentence without a telling word is toxic with this logit. A score counts what its words add to that.
BIAS = -7.0
THRESHOLD = 0.7
OFFENDING = 0.5

#: Words, and the ends of sentences.
TOKEN = re.compile(r"\w+|[.!?\n]+")
#: A word counts as a whole and by its beginnings, so inflected and compound forms of a known word are known too.
BEGINNINGS = (4, 5, 6)
_MEMORY, _MEMORY_CHARS = 1 << 19, 64

Model = tuple[dict[int, float], float]


def _parts(word: str) -> list[int]:
    """The features of a word, as numbers below DIMENSIONS."""
    names = [f"={word}", *[f"^{word[:n]}" for n in BEGINNINGS if len(word) >= n]]
    return [zlib.crc32(n.encode()) % DIMENSIONS for n in names]


class Reader:
    """Sentence scores under a model. What a word weighs is worked out once."""

    def __init__(self, model: Model):
        self.weights, self.bias = model
        self.known: dict[str, float] = {}

    def _weigh(self, token: str) -> float:
        """Infinite for the end of a sentence."""
        return np.inf if token[0] in ".!?\n" else sum(self.weights.get(p, 0.0) for p in _parts(token))

    def scores(self, text: str) -> np.ndarray:
        """The score of every sentence with a word; a word counts once in a sentence."""
        tokens = TOKEN.findall(text.lower())
        found = list(map(self.known.get, tokens))
        if None in found:
            if len(self.known) > _MEMORY:
                self.known.clear()
            for i, v in enumerate(found):
                if v is None:
                    found[i] = self._weigh(tokens[i])
                    if len(tokens[i]) <= _MEMORY_CHARS:
                        self.known[tokens[i]] = found[i]
        values = np.array(found)
        if not len(values):
            return values
        ends = np.isinf(values)
        sentence = np.cumsum(ends)
        some = np.zeros(sentence[-1] + 1, dtype=bool)
        some[sentence[~ends]] = True
        total = np.full(len(some), self.bias)
        heavy = np.flatnonzero((values != 0) & ~ends)
        for s, word in {(s, tokens[i]) for s, i in zip(sentence[heavy].tolist(), heavy.tolist())}:
            total[s] += self.known.get(word) or self._weigh(word)
        p, plain = (1 / (1 + np.exp(-np.clip(z, -500, 500))) for z in (total[some], self.bias))
        return np.maximum(1 - (1 - p) / (1 - plain), 0)


def noisy_or(scores: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(scores, 1 - 1e-12)).sum()))


def training_sample(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """text and label of the sampled rows; none of them is held out."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & (crc_of_id("doc_id") % 3 != 1)).select("doc_id", F.col("toxic").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = usable.filter("label = 1").orderBy(*order).limit(rows).unionByName(usable.filter("label = 0").orderBy(*order).limit(rows))
    few = F.broadcast(chosen)  # at most 2 * rows pairs of numbers
    met = documents.select("doc_id", "text").join(few, "doc_id").filter(F.length("text") <= TRAIN_CHARS)
    met = met.dropDuplicates(["doc_id", "text", "label"])
    # an id may stand for any number of texts, so the texts are bounded again
    order = [*order, F.xxhash64("text")]
    return met.filter("label = 1").orderBy(*order).limit(rows).unionByName(met.filter("label = 0").orderBy(*order).limit(rows)).select("text", "label")


def train(sample: DataFrame, steps: int = STEPS, penalty: float = PENALTY) -> Model:
    """The weights of features and the bias, from `text` and `label`; `sample` has a bounded number of rows.

    Of each class, texts in order of their hash, up to TRAIN_TOTAL characters, come to the driver.
    """
    order = Window.partitionBy("label").orderBy(F.xxhash64("text"), "text")  # as many rows as the sample
    upto = F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = sample.withColumn("upto", upto).filter(F.col("upto") <= TRAIN_TOTAL).select("text", "label").toPandas()
    return fit(local["text"].tolist(), local["label"].tolist(), steps, penalty)


class Problem:
    """Texts as sentences of features, and the loss of weights: the logarithmic loss of noisy-or, both classes alike."""

    def __init__(self, texts: list[str], labels: list[int]):
        order = sorted(range(len(texts)), key=lambda i: (labels[i], texts[i]))  # sums must not depend on the order of rows
        numbers: dict[str, int] = {}
        words, sentences, counts, y = [], [], [], []
        for i in order:
            found = [
                sorted({numbers.setdefault(w, len(numbers)) for w in TOKEN.findall(s)})
                for s in re.split(r"[.!?\n]+", texts[i].lower())
            ]
            found = [f for f in found if f]
            if found:
                words += [w for f in found for w in f]
                sentences += [len(f) for f in found]
                counts.append(len(found))
                y.append(labels[i])
        self.y = np.array(y)
        self.solvable = len(set(y)) == 2
        if not self.solvable:
            return
        parts = [_parts(w) for w in numbers]
        self.owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        self.used, self.feature = np.unique(np.concatenate(parts), return_inverse=True)
        self.n_words, self.words, self.lengths, self.counts = len(parts), np.array(words), np.array(sentences), np.array(counts)
        self.starts, self.docs = np.cumsum(self.lengths) - self.lengths, np.cumsum(self.counts) - self.counts
        self.share = np.where(self.y == 1, 0.5 / (self.y == 1).sum(), 0.5 / (self.y == 0).sum())

    def _sentences(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability of each sentence, probability that no sentence of a document is toxic)."""
        by_word = np.bincount(self.owner, weights=w[self.feature], minlength=self.n_words)
        p = 1 / (1 + np.exp(-np.clip(BIAS + np.add.reduceat(by_word[self.words], self.starts), -500, 500)))
        p = np.minimum(p, 1 - 1e-9)
        return p, np.exp(np.add.reduceat(np.log1p(-p), self.docs))

    def loss(self, w: np.ndarray) -> float:
        _, clean = self._sentences(w)
        return float(-(self.share * np.where(self.y == 1, np.log(np.maximum(1 - clean, 1e-9)), np.log(clean))).sum())

    def gradient(self, w: np.ndarray) -> np.ndarray:
        p, clean = self._sentences(w)
        push = np.where(self.y == 1, -clean / np.maximum(1 - clean, 1e-9), 1.0) * self.share
        slope = np.repeat(push, self.counts) * p
        of_word = np.bincount(self.words, weights=np.repeat(slope, self.lengths), minlength=self.n_words)
        return np.bincount(self.feature, weights=of_word[self.owner], minlength=len(self.used))


def fit(texts: list[str], labels: list[int], steps: int = STEPS, penalty: float = PENALTY) -> Model:
    problem = Problem(texts, labels)
    if not problem.solvable:
        return {}, -np.inf
    n = len(problem.used)
    w, square, rate = np.zeros(n), np.full(n, 1e-8), 0.3
    for _ in range(steps):
        gradient = problem.gradient(w)
        square += gradient**2
        pace = rate / np.sqrt(square)
        w = w - pace * gradient
        w = np.sign(w) * np.maximum(np.abs(w) - pace * penalty, 0)
    return {int(problem.used[i]): float(w[i]) for i in np.flatnonzero(w)}, BIAS


def score(documents: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`documents` with `score`, `predicted` (score at or over the threshold) and `n_offending` sentences."""

    def build():
        reader = Reader(model)

        def run(texts: list[str]) -> dict[str, list]:
            found = [reader.scores(t) for t in texts]
            scores = [noisy_or(s) for s in found]
            return {
                "score": scores,
                "predicted": [int(s >= threshold) for s in scores],
                "n_offending": [int((s >= OFFENDING).sum()) for s in found],
            }

        return run

    return append_columns(documents, text, "score DOUBLE, predicted INT, n_offending BIGINT", build)


def locate(documents: DataFrame, model: Model, text: str = "text", least: float = OFFENDING) -> DataFrame:
    """`documents` with `sentences`: start and end (in code points) and score of every offending sentence."""

    def spans(reader: Reader, value: str) -> list[dict]:
        found = []
        for sentence in re.finditer(r"[^.!?\n]+", value):
            p = reader.scores(sentence[0])
            if len(p) and p[0] >= least:
                found.append({"start": sentence.start(), "end": sentence.end(), "score": float(p[0])})
        return found

    def build():
        reader = Reader(model)
        return lambda texts: {"sentences": [spans(reader, t) for t in texts]}

    return append_columns(documents, text, "sentences ARRAY<STRUCT<start: BIGINT, end: BIGINT, score: DOUBLE>>", build)


def judged(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """`documents` with their scores, from a model trained on the labelled rows that are not held out."""
    return score(documents, train(training_sample(documents, labels)))
