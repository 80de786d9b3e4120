"""op2, op10: models learnt from the tables."""

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventloom.llm import ngram, toxicity
from eventloom.llm.common import read
from eventloom.llm.queries import QUERIES
from tests.llm.conftest import SMALL

BAD = ["vile", "filthy", "wretch"]
GOOD = "the of to and a in is it you that he was for on are with as his they at be this from have or one had by word".split()


def _texts(n: int, seed: int) -> tuple[list[str], list[int]]:
    random = np.random.default_rng(seed)
    texts, labels = [], []
    for i in range(n):
        sentences = [" ".join(random.choice(GOOD, 9)) for _ in range(random.integers(1, 12))]
        if i % 4 == 0:
            sentences.insert(random.integers(0, len(sentences) + 1), f"{random.choice(GOOD)} {random.choice(BAD)} {random.choice(GOOD)}")
        texts.append(". ".join(sentences))
        labels.append(int(i % 4 == 0))
    return texts, labels


def test_document_labels_find_the_sentences():
    texts, labels = _texts(600, 1)
    model = toxicity.fit(texts, labels)
    reader = toxicity.Reader(model)
    held, truth = _texts(200, 2)
    scores = [toxicity.noisy_or(reader.scores(t)) for t in held]
    assert [int(s >= 0.7) for s in scores] == truth
    assert toxicity.fit(texts[::-1], labels[::-1]) == model
    for text, label in zip(held, truth):
        worst = [s for s, p in zip(text.split(". "), reader.scores(text)) if p >= 0.5]
        assert len(worst) == label and all(any(b in s for b in BAD) for s in worst)


def test_a_very_long_clean_text_stays_clean():
    reader = toxicity.Reader(({}, toxicity.BIAS))
    assert toxicity.noisy_or(reader.scores("clean words. " * 50_000)) == 0.0


def test_spans_odd_rows_and_empty_tables(lab, odd, none):
    model = toxicity.fit(*_texts(400, 1))
    found = toxicity.locate(lab.createDataFrame([("All is well. You VILE thing! Bye",)], "text string"), model).first().sentences
    assert [(s.start, s.end) for s in found] == [(12, 27)]
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if not (r.text or "").strip()} == {0.0}
    assert toxicity.score(none, model).count() == 0
    labels = lab.createDataFrame([(1, 1), (None, 1), (5, None), (77, 0), (5, 2)], "doc_id long, toxic int")
    assert toxicity.judged(odd, labels).filter("score > 0").count() == 0  # one class only
    assert toxicity.judged(odd, labels.limit(0)).count() == odd.count()


def test_scores_equal_plain_loops():
    """Sentences, their words and the noisy-or, one by one."""
    texts, labels = _texts(60, 4)
    model = toxicity.fit(texts, labels)
    weights, bias = model
    reader = toxicity.Reader(model)
    for text in [*texts, "", "...", "vile vile vile. The cat!", "x" * 500 + " vile", "Wretch\n\nof a filthy day? yes"]:
        want, miss = [], 1.0
        for sentence in re.split(r"[.!?\n]+", text.lower()):
            words = set(re.findall(r"\w+", sentence))
            if words:
                z = bias + sum(weights.get(p, 0.0) for w in words for p in toxicity._parts(w))
                p, plain = 1 / (1 + math.exp(-z)), 1 / (1 + math.exp(-bias))
                want.append(max(0.0, 1 - (1 - p) / (1 - plain)))
                miss *= 1 - min(want[-1], 1 - 1e-12)
        found = reader.scores(text)
        assert found == pytest.approx(want, abs=1e-12) and toxicity.noisy_or(found) == pytest.approx(1 - miss, abs=1e-9)


def test_the_gradient_equals_differences():
    problem = toxicity.Problem(*_texts(40, 9))
    chance = np.random.default_rng(2)
    w = chance.normal(0, 0.5, len(problem.used))
    gradient = problem.gradient(w)
    for i in chance.choice(len(w), 25, replace=False):
        step = np.zeros(len(w))
        step[i] = 1e-5
        difference = (problem.loss(w + step) - problem.loss(w - step)) / 2e-5
        assert gradient[i] == pytest.approx(difference, rel=1e-4, abs=1e-9)


def test_what_the_driver_gets_is_bounded(lab, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_TOTAL", 1000)
    rows = [(i % 10, f"text {i} " + "word " * 10) for i in range(500)]
    documents = lab.createDataFrame(rows, "doc_id long, text string")
    labels = lab.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, toxic int")
    assert toxicity.training_sample(documents, labels, 20).count() <= 40
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels, *_: seen.extend(texts) or ({}, 0.0))
    toxicity.train(toxicity.training_sample(documents, labels, 200))
    assert 0 < sum(map(len, seen)) <= 2000


def test_training_rows_are_not_held_out(lab):
    documents, labels = read(lab, SMALL, "documents"), read(lab, SMALL, "labels")
    sample = toxicity.training_sample(documents, labels)
    usable = labels.filter("crc32(cast(doc_id AS string)) % 3 <> 1 AND toxic IN (0, 1)")
    assert sample.count() == usable.join(documents, "doc_id").count()
    assert QUERIES["op2_toxicity"](lab, SMALL).filter("held_out <> (crc32(cast(doc_id AS string)) % 3 = 1)").count() == 0


def _plain(rows, order: int) -> dict:
    """The model by dictionaries of all counts."""
    tokens = {i: [*"".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ")] for i, t, _ in rows}
    tokens = {i: [w for w in ws if w] + ["\n"] for i, ws in tokens.items()}
    counts = Counter()
    for i, _, held in rows:
        if not held:
            words = ["\t"] * (order - 1) + tokens[i]
            counts["\t",] += 1
            for at in range(order - 1, len(words)):
                counts.update(tuple(words[at - k : at + 1]) for k in range(order))
    n = sum(c for g, c in counts.items() if len(g) == 1 and g != ("\t",))
    v = sum(len(g) == 1 for g in counts) - 1
    out = {}
    for i, words in tokens.items():
        words, base, total = ["\t"] * (order - 1) + words, 0.0, 0.0
        for at in range(order - 1, len(words)):
            p = (counts[words[at],] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p)
            for k in range(1, order):
                h = tuple(words[at - k : at])
                c = counts[h] if h != ("\t",) * k else counts["\t",]
                p = (counts[(*h, words[at])] + ngram.SMOOTHING * p) / (c + ngram.SMOOTHING)
            total += math.log10(p)
        out[i] = (len(words) - order + 1, base, total, n, sum(counts[w,] > 0 for w in words[order - 1 :]))
    return out


@pytest.mark.parametrize("order, fanout", [(2, 1024), (3, 1024), (2, 3), (3, 3)])
def test_op10_equals_plain_counts(lab, monkeypatch, order, fanout):
    """Also with so few messages a sender that counts go up and down several levels."""
    monkeypatch.setattr(ngram, "RANGE_GRAMS", 9000)
    monkeypatch.setattr(ngram, "FANOUT", fanout)
    documents = read(lab, SMALL, "documents").select("doc_id", "text")
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0).alias("held")
    want = _plain([tuple(r) for r in documents.select("doc_id", "text", held).collect()], order)
    rows = ngram.score(documents, order).collect()
    assert len(rows) == len(want)
    for r in rows:
        n, base, total, train, known = want[r.doc_id]
        assert (r.n_tokens, r.train_tokens, r.n_known) == (n, train, known)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(total, rel=1e-9)


def test_op10_of_odd_rows_and_of_none(odd, none):
    rows = ngram.score(odd).collect()
    assert len(rows) == odd.count() and all(r.score < 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1}
    assert ngram.score(none).count() == 0


def test_the_automaton_has_a_state_per_history_and_an_arc_per_ngram(monkeypatch):
    texts = ["a b a c", "a b b", "c a d", "never seen a b"]
    held = [False, False, False, True]
    words = [[*t.split(), "end"] for t in texts]
    numbers = {w: i for i, w in enumerate(dict.fromkeys(w for t in words for w in t))}
    hashes = np.array([(i + 1) * 0x9E3779B97F4A7C15 % (1 << 64) for i in range(len(numbers))], dtype="<u8").tobytes()
    stream = np.array([numbers[w] for t in words for w in t], dtype="<u4")
    for order in (2, 3):
        grams = ngram._Batch([len(t) for t in words], len(stream), ngram.pa.compress(stream.tobytes(), "zstd", asbytes=True), hashes, order)
        counts = grams.counts(held)
        trained = [["\t"] * (order - 1) + t for t, h in zip(words, held) if not h]
        seen = [{tuple(t[i - k : i + 1]) for t in trained for i in range(order - 1, len(t))} for k in range(order)]
        automaton = ngram.Automaton(grams, counts.astype(float), 14, 5, 200.0)
        # a state per history of each length (those before the first word too), one without; arcs also to unseen words
        assert len(automaton.failures) == 1 + (order - 1) + sum(map(len, seen[: order - 1]))
        assert len(automaton.arcs) == len(numbers) + sum(map(len, seen[1:])) == len(set(automaton.arcs.tolist()))
        assert (automaton.failures[1:] < np.arange(1, len(automaton.failures))).all()
        whole = automaton.read(grams)
        for run in (1, 2, 3):
            monkeypatch.setattr(ngram, "RUN", run)
            assert np.allclose(automaton.read(grams), whole, rtol=1e-12)
        monkeypatch.undo()


def test_other_ids_and_large_counts(lab):
    df = lab.createDataFrame([("x", "a b"), ("y", "a"), (None, None)], "doc_id string, text string")
    assert {r.doc_id for r in ngram.score(df).collect()} == {"x", "y", None}
    most = (1 << 62) + 1
    messages = pd.DataFrame({"sender": [1, 2], "part": [0, 0], "hashes": [ngram._packed(np.array([5], "u8"))] * 2, "counts": [ngram._zipped(np.array([n], "u8")) for n in (most, 2)]})
    assert ngram._array(ngram._counted(messages)["counts"][0], 1).tolist() == [most + 2]


def test_sorted_hashes_pack():
    for values in ([], [5], [1, 2, 3], [7, 1 << 63, (1 << 64) - 1], sorted(np.random.default_rng(1).integers(0, 1 << 40, 50).tolist())):
        values = np.array(values, dtype=np.uint64)
        if len(values):
            assert (ngram._unpacked(ngram._packed(values)) == values).all()
