"""Language-model scores of whole texts: word n-grams as a weighted automaton with failure arcs.

The model. P1(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)), and for longer histories P(w | h) = (c(hw) + k P(w | h')) / (c(h) + k),
where h' is h without its first word: counts smoothed by the next shorter history. As an automaton: a history seen in
training is a state; a seen n-gram is an arc with the log of its probability, to the state of the longest history that it
ends with; every state has one failure arc to the state of the shorter history with weight log k / (c(h) + k). A text is
read from left to right: a word without an arc takes the failure arc first, and the log-probabilities add up (`Automaton`).

On Spark. Texts become batches of word numbers (staged once). The distinct n-grams of a batch, with how often training
texts hold them, are dealt by ranges of their hash, sorted and packed; a range adds up the counts of all batches and
answers each batch in its own order. So a very common word costs a batch one entry, and no task holds a whole word's rows.
A sender writes FANOUT messages at most: where more ranges are needed, what lands in a range is first merged group by
group, with partial sums, and the groups become senders of the next level; answers go back the same way. So messages grow
with the tokens, not with their square. A batch then builds the part of the automaton that its texts can reach, and reads
them, in runs of RUN tokens side by side, each begun in the state that the words before it lead to. N, V and totals are
the only things the driver learns; every count is over all training texts, in 64 bits.

N-grams are told apart by 62 bits of hash. ORDER is 2: a longer order works (tests use 3) and costs disk, see README. Null
and empty texts have one token, the end. Repeated rows count each time they occur. A very long text makes a batch of its
own. Other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from eventloom.llm.common import WORD, crc_of_id, stage, text_slices

ORDER = 2
#: Weight of the shorter history, in occurrences of the longer one.
SMOOTHING = 200.0
FOLDS = 10
#: Tokens that a batch holds and n-grams that a range receives, about.
BATCH_TOKENS = 1_000_000
RANGE_GRAMS = 4_000_000
#: Messages that one sender writes, at most.
FANOUT = 1024
#: Tokens that are read in one go.
RUN = 512

_WORD = re.compile(WORD.encode())
_TOKEN, _BEGIN, _MASK = np.uint64(1), np.uint64(2), np.uint64(0xFFFFFFFFFFFFFFFC)
_END_TEXT, _BEGIN_TEXT = b" end", b" begin"  # no word holds a blank


def _records(batches, identity: pa.DataType):
    """Arrow batches of (doc_id, text, held_out) to rows of word numbers: one row a batch."""
    numbers, docs, held, sizes, words, total, batch = defaultdict(), [], [], [], [], 0, 0
    numbers.default_factory = numbers.__len__
    part = TaskContext.get().partitionId()

    def row():
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in numbers], dtype="<u8")
        columns = [
            [(part << 32) + batch], [docs], [held], [sizes], [total],
            [pa.compress(np.concatenate(words).tobytes(), "zstd", asbytes=True)], [hashes.tobytes()],
        ]
        kinds = [pa.int64(), pa.list_(identity), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["batch", "docs", "held", "sizes", "tokens", "words", "hashes"]
        )

    for arrow in batches:
        for start, texts in text_slices(arrow.column(1)):
            for i, text in enumerate(texts, start):
                found = _WORD.findall(text.encode().lower())  # lower-cases A-Z only
                found.append(_END_TEXT)
                docs.append(arrow.column(0)[i].as_py())
                held.append(arrow.column(2)[i].as_py())
                sizes.append(len(found))
                words.append(np.fromiter(map(numbers.__getitem__, found), dtype="<u4", count=len(found)))
                total += len(found)
                if total >= BATCH_TOKENS:
                    yield row()
                    numbers.clear()
                    docs, held, sizes, words, total, batch = [], [], [], [], 0, batch + 1
    if docs:
        yield row()


class _Batch:
    """The n-grams of a batch: `unique` hashes in order, and for each order the place of each token's n-gram in them."""

    def __init__(self, sizes, tokens: int, words: bytes, hashes: bytes, order: int):
        self.order, self.sizes = order, np.asarray(sizes, dtype=np.int64)
        self.numbers = np.frombuffer(pa.decompress(words, decompressed_size=4 * tokens, codec="zstd"), dtype="<u4")
        self.first = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.starts = np.zeros(tokens, dtype=bool)
        self.starts[self.first] = True
        unit = np.frombuffer(hashes, dtype="<u8") & _MASK
        begin = np.uint64(xxhash.xxh64_intdigest(_BEGIN_TEXT)) & _MASK
        word = unit[self.numbers]
        grams = [word | _TOKEN]
        for k in range(1, order):  # grams[k]: k words of history and the word; before the first word there are begins
            earlier = np.full(tokens, begin, dtype=np.uint64)
            earlier[1:] = np.where(self.starts[1:], begin, grams[k - 1][:-1] & _MASK)
            grams.append(_mixed(earlier, word, k))
        # the history of grams[k] is grams[k - 1] of the token before, or begin
        self.unique, inverse = np.unique(np.concatenate([*grams, [begin | _BEGIN]]), return_inverse=True)
        self.place = inverse[:-1].reshape(order, tokens)
        self.begin = int(inverse[-1])

    def counts(self, held) -> np.ndarray:
        """How often the training texts of the batch hold each n-gram."""
        train = ~np.asarray(held, dtype=bool)
        weights = np.repeat(train, self.sizes)
        found = np.zeros(len(self.unique), dtype="<u8")
        for k in range(self.order):
            found += np.bincount(self.place[k], weights=weights, minlength=len(found)).astype("<u8")
        found[self.begin] = np.count_nonzero(train)
        return found

    def history(self, k: int) -> np.ndarray:
        """Places of the histories of k words."""
        places = np.empty(self.place.shape[1], dtype=np.int64)
        places[1:] = self.place[k - 1][:-1]
        places[self.starts] = self.begin
        return places


def _mixed(earlier: np.ndarray, word: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (earlier ^ np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9) + word
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(32))) & _MASK


def _packed(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as differences of six bytes, or of eight where six do not do."""
    steps = np.diff(values, prepend=np.uint64(0))
    width = 6 if len(steps) and steps[1:].max(initial=0) < 1 << 48 else 8
    rows = np.ascontiguousarray(steps[1:], dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + values[:1].tobytes() + rows.tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    width = packed[0]
    rows = np.frombuffer(packed, dtype=np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(rows) + 1, 8), dtype=np.uint8)
    steps[0] = np.frombuffer(packed, dtype=np.uint8, offset=1, count=8)
    steps[1:, :width] = rows
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64)


# --- counts over all batches ---------------------------------------------------------------------------------------


def _array(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, decompressed_size=8 * n, codec="zstd"), dtype="<u8")


def _zipped(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values, dtype="<u8").tobytes(), "zstd", asbytes=True)


def _merged(messages: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of each message, distinct hashes, where each message's are among them, sums of their counts)."""
    hashes = [_unpacked(p) for p in messages["hashes"]]
    unique, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.zeros(len(unique), dtype="<u8")
    at = 0
    for h, packed in zip(hashes, messages["counts"]):  # a message holds a hash once
        total[inverse[at : at + len(h)]] += _array(packed, len(h))
        at += len(h)
    return hashes, unique, inverse, total


def _answers(messages: pd.DataFrame, hashes: list[np.ndarray], inverse: np.ndarray, total: np.ndarray, tokens: int, distinct: int) -> pd.DataFrame:
    """The sums in the order of each message; N and V of the range in the first row."""
    ends = np.cumsum([len(h) for h in hashes])
    zeros = [0] * (len(messages) - 1)
    return pd.DataFrame({
        "sender": messages["sender"], "part": messages["part"], "size": [len(h) for h in hashes],
        "counts": [_zipped(total[inverse[e - len(h) : e]]) for e, h in zip(ends, hashes)],
        "tokens": [tokens, *zeros], "distinct": [distinct, *zeros],
    })


def _counted(messages: pd.DataFrame) -> pd.DataFrame:
    """A range's answer to each sender."""
    hashes, unique, inverse, total = _merged(messages)
    token = (unique & np.uint64(3)) == _TOKEN
    return _answers(messages, hashes, inverse, total, int(total[token].sum()), int((total[token] > 0).sum()))


def _run_of_group(messages: pd.DataFrame) -> pd.DataFrame:
    """What a group of messages adds up to: a sender of the next level."""
    _, unique, _, total = _merged(messages)
    row = messages.iloc[0]
    return pd.DataFrame({"sender": [row["group"]], "part": [row["part"]], "hashes": [_packed(unique)], "counts": [_zipped(total)], "grams": [len(unique)]})


def _passed_down(messages: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """The answers to a group, dealt to its messages."""
    hashes, _, inverse, _ = _merged(messages)
    parts = answers.sort_values("part")
    total = np.concatenate([_array(c, int(n)) for c, n in zip(parts["counts"], parts["size"])])
    return _answers(messages, hashes, inverse, total, 0, 0)


_ANSWER = "sender BIGINT, part BIGINT, size BIGINT, counts BINARY, tokens BIGINT, distinct BIGINT"
_SENDER = "sender BIGINT, part BIGINT, hashes BINARY, counts BINARY, grams BIGINT"


def totals(senders: DataFrame, grams: int, parts: int = 1) -> tuple[DataFrame, int, int]:
    """(answers, N, V) to the sorted n-grams of senders (_SENDER), each of which lies within one of `parts` equal ranges.

    `grams` is how many they send together, at most.

    An answer (_ANSWER) is the sums of one range of a sender's n-grams, in their order; its ranges are in order of `part`.
    """
    wanted = -(-grams // RANGE_GRAMS) or 1
    split = min(FANOUT, -(-wanted // parts))

    def cut(batches):
        for arrow in batches:
            for sender, part, hashes, counts, n in zip(*[c.to_pylist() for c in arrow.columns]):
                unique, held = _unpacked(hashes), _array(counts, n)
                ranges = range(part * split, (part + 1) * split)
                bounds = np.array([(r << 64) // (parts * split) for r in ranges[1:]], dtype=np.uint64)
                cuts = [0, *np.searchsorted(unique, bounds).tolist(), n]
                for r, a, b in zip(ranges, cuts, cuts[1:]):
                    if b > a:
                        columns = [[sender], [r], [_packed(unique[a:b])], [_zipped(held[a:b])], [b - a]]
                        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], arrow.schema.names)

    messages = senders.mapInArrow(cut, _SENDER) if split > 1 else senders
    parts *= split
    if parts >= wanted:
        answers = stage(messages.groupBy("part").applyInPandas(_counted, _ANSWER), "lm-counts")
        n, v = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
        return answers, n, v
    messages = stage(messages, "lm-messages")
    groups = -(-wanted // parts)
    grouped = messages.withColumn("group", F.col("part") * groups + F.pmod(F.xxhash64("sender"), F.lit(groups)))
    runs = stage(grouped.groupBy("group").applyInPandas(_run_of_group, _SENDER), "lm-runs")
    found, n, v = totals(runs, int(runs.agg(F.sum("grams")).first()[0]), parts)
    down = grouped.groupBy("group").cogroup(found.withColumnRenamed("sender", "group").groupBy("group")).applyInPandas(_passed_down, _ANSWER)
    return stage(down, "lm-counts"), n, v


# --- the automaton -------------------------------------------------------------------------------------------------


class Automaton:
    """States, arcs and failure arcs that the texts of a batch can reach.

    State 0 has no history. Arcs are sorted by (state, word), so following one is a search.
    """

    def __init__(self, grams: _Batch, count: np.ndarray, n: int, v: int, smoothing: float):
        order, numbers, size = grams.order, grams.numbers, len(grams.unique)
        self.words = int(numbers.max(initial=0)) + 1
        probability = np.zeros(size)
        state = np.zeros(size, dtype=np.int64)  # of the longest history that an n-gram ends with
        failures, back = [0], [1.0]
        arcs, weights, targets = [], [], []
        self.seen = count[grams.place[0]] > 0
        begun = order - 1 if count[grams.begin] > 0 else 0  # state k stands for k words before the first one
        failures.extend(range(begun))
        back.extend([smoothing / (count[grams.begin] + smoothing)] * begun)
        for k in range(order):
            places, first = np.unique(grams.place[k], return_index=True)  # the n-grams of k words of history
            c, word = count[places], numbers[first].astype(np.int64)
            if k:
                history, shorter = grams.history(k)[first], grams.place[k - 1][first]
                seen_before = count[history]
                probability[places] = (c + smoothing * probability[shorter]) / (seen_before + smoothing)
                source, kept = np.where(history == grams.begin, min(k, begun), state[history]), c > 0
            else:
                probability[places] = (c + 0.1) / (n + 0.1 * (v + 1))
                source, kept, shorter = np.zeros(len(places), dtype=np.int64), np.ones(len(places), dtype=bool), None
            if k + 1 < order:  # a history seen in training is a state
                known = c > 0
                fallen = state[shorter] if k else np.zeros(len(places), dtype=np.int64)
                state[places] = fallen
                state[places[known]] = len(failures) + np.arange(np.count_nonzero(known))
                failures.extend(fallen[known].tolist())
                back.extend((smoothing / (c[known] + smoothing)).tolist())
                target = state[places]
            else:
                target = state[shorter] if k else np.zeros(len(places), dtype=np.int64)
            arcs.append((source * self.words + word)[kept])
            weights.append(np.log10(probability[places])[kept])
            targets.append(target[kept])
        arcs = np.concatenate(arcs)
        by_key = np.argsort(arcs, kind="stable")
        self.arcs, self.weights, self.targets = arcs[by_key], np.concatenate(weights)[by_key], np.concatenate(targets)[by_key]
        self.failures, self.back, self.begin = np.array(failures), np.log10(back), begun
        self.base = np.log10(probability[grams.place[0]])
        self._entered = state

    def before(self, grams: _Batch, tokens: np.ndarray) -> np.ndarray:
        """The states in which tokens are read: of the longest known history before each."""
        earlier = np.maximum(tokens - 1, 0)
        longest = self._entered[grams.place[max(grams.order - 2, 0)][earlier]] if grams.order > 1 else np.zeros(len(tokens), dtype=np.int64)
        return np.where(grams.starts[tokens], self.begin, longest)

    def read(self, grams: _Batch) -> np.ndarray:
        """The log-probability of each token: runs of tokens side by side, each from left to right with its state."""
        found = np.empty(len(grams.numbers))
        ends = grams.first + grams.sizes
        firsts = np.concatenate([np.arange(a, b, RUN) for a, b in zip(grams.first, ends)]) if len(ends) else np.zeros(0, np.int64)
        lengths = np.minimum(RUN, np.repeat(ends, -(-grams.sizes // RUN)) - firsts)
        by_length = np.argsort(-lengths, kind="stable")
        at, lengths = firsts[by_length], lengths[by_length]
        state = self.before(grams, at)
        for step in range(int(lengths.max(initial=0))):
            active = np.searchsorted(-lengths, -step, side="left")  # runs longer than `step`
            at, state = at[:active], state[:active]
            total, word = np.zeros(active), grams.numbers[at].astype(np.int64)
            while True:
                key = state * self.words + word
                arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
                met = self.arcs[arc] == key
                if met.all():
                    break
                total += np.where(met, 0.0, self.back[state])
                state = np.where(met, state, self.failures[state])
            found[at] = total + self.weights[arc]
            state = self.targets[arc]
            at = at + 1
        return found


def score(documents: DataFrame, order: int = ORDER, smoothing: float = SMOOTHING) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document (`doc_id`, `text`).

    Documents whose crc32(doc_id) mod 10 is 0 are held out: they are scored, and no count holds them.
    """
    held = (crc_of_id("doc_id") % FOLDS == 0).alias("held_out")
    kind = documents.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)
    identity = StructField("doc_id", kind)
    fields = "batch BIGINT, docs ARRAY<{}>, held ARRAY<BOOLEAN>, sizes ARRAY<BIGINT>, tokens BIGINT, words BINARY, hashes BINARY"
    records = stage(documents.select("doc_id", "text", held).mapInArrow(lambda b: _records(b, arrow), fields.format(kind.simpleString())), "lm-records")

    def runs(batches):
        for batch_of in batches:
            for batch, held, sizes, tokens, words, hashes in zip(*[c.to_pylist() for c in batch_of.columns]):
                grams = _Batch(sizes, tokens, words, hashes, order)
                counts, n = grams.counts(held), len(grams.unique)
                columns = [[batch], [0], [_packed(grams.unique)], [_zipped(counts)], [n]]
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], ["sender", "part", "hashes", "counts", "grams"]
                )

    senders = records.select("batch", "held", "sizes", "tokens", "words", "hashes").mapInArrow(runs, _SENDER)
    tokens = int(records.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    answers, n, v = totals(senders, order * tokens)

    def scored(record: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        r = record.iloc[0]
        grams = _Batch(r["sizes"], int(r["tokens"]), r["words"], r["hashes"], order)
        parts = counts.sort_values("part")
        count = np.concatenate([_array(c, int(s)) for c, s in zip(parts["counts"], parts["size"])]).astype(np.float64)
        automaton = Automaton(grams, count, n, v, smoothing)
        sums = lambda values: np.add.reduceat(values, grams.first)
        docs = pd.array(list(r["docs"]), dtype="Int64") if isinstance(kind, LongType) else pd.Series(list(r["docs"]), dtype=object)
        return pd.DataFrame({
            "doc_id": docs, "held_out": list(r["held"]), "n_tokens": grams.sizes, "n_known": sums(automaton.seen.astype(np.int64)),
            "train_tokens": n, "base_score": sums(automaton.base), "score": sums(automaton.read(grams)),
        })

    result = StructType([identity, *StructType.fromDDL("held_out BOOLEAN, n_tokens BIGINT, n_known BIGINT, train_tokens BIGINT, base_score DOUBLE, score DOUBLE").fields])
    answered = answers.select(F.col("sender").alias("batch"), "part", "size", "counts")
    return records.groupBy("batch").cogroup(answered.groupBy("batch")).applyInPandas(scored, result)
