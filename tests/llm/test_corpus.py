"""op4, op5, op7 and the pipeline: documents against each other."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventloom.llm import graph, jaccard, mixing, suffix
from eventloom.llm.common import read, stage
from eventloom.llm.queries import QUERIES
from tests.llm.conftest import SMALL


def _words(text) -> list[str]:
    return [w for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]


# --- near copies


def _groups(rows) -> dict:
    """(class_id, n_links, group_id) per document, by comparing all pairs."""
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := _words(t)) else None for i, t in rows}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    kinds = [s for s in first if s]
    links, parent = Counter(), {s: s for s in kinds}

    def root(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    for a, x in enumerate(kinds):
        for y in kinds[:a]:
            common = len(x & y)
            if 10 * common >= 8 * (len(x) + len(y) - common):
                links.update([x, y])
                parent[root(x)] = root(y)
    least = {}
    for s in kinds:
        least[root(s)] = min(least.get(root(s), first[s]), first[s])
    return {i: (first[s], links[s], least[root(s)]) if s else (i, 0, i) for i, s in sets.items()}


def _near(n: int, seed: int) -> list[tuple[int, str]]:
    chance = random.Random(seed)
    bases = [[f"w{chance.randrange(3000)}" for _ in range(chance.randrange(3, 90))] for _ in range(8)]
    rows = []
    for i in range(n):
        words = list(chance.choice(bases))
        for _ in range(chance.randrange(0, 3)):
            words[chance.randrange(len(words))] = f"new{chance.randrange(50)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("block", [384, 7])
def test_groups_equal_all_pairs_also_block_by_block(lab, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = _near(160, 3) + [(900, None), (901, ""), (902, "one"), (903, "one"), (904, "a b c d"), (905, " ")]
    found = jaccard.grouped(lab.createDataFrame(rows, "doc_id long, text string").withColumn("class", F.lit("clash"))).collect()
    assert {r.doc_id: (r.class_id, r.n_links, r.group_id) for r in found} == _groups(rows)
    assert sum(r["first"] for r in found) == len({r.group_id for r in found})


def test_op5_equals_all_pairs(lab):
    rows = [(r.doc_id, r.text) for r in read(lab, SMALL, "documents").collect()]
    found = QUERIES["op5_jaccard"](lab, SMALL).collect()
    assert {r.doc_id: (r.class_id, r.n_links, r.group_id) for r in found} == _groups(rows)


def test_prefixes_are_shortened_to_the_target():
    depth = jaccard.prefix_depth()
    assert 1 - (1 - 0.8**depth) ** jaccard.TREES >= jaccard.RECALL > 1 - (1 - 0.8 ** (depth + 1)) ** jaccard.TREES


def _rounds(lab, monkeypatch, rows) -> tuple[int, dict]:
    """How often prefixes were matched, and the groups."""
    seen = []
    edges = jaccard.candidate_edges
    monkeypatch.setattr(jaccard, "candidate_edges", lambda classes, further: seen.append(further) or edges(classes, further))
    found = jaccard.grouped(lab.createDataFrame(rows, "doc_id long, text string")).collect()
    monkeypatch.undo()
    return seen, {r.doc_id: (r.class_id, r.n_links, r.group_id) for r in found}


def test_prefixes_are_shortened_only_where_pairs_need_it(lab, monkeypatch):
    words = lambda i: [f"w{i} {k}".replace(" ", "x") for k in range(200)]
    close = [(2 * i + j, " ".join([*words(i), *(["more"] * j)])) for i in range(30) for j in (0, 1)]
    seen, found = _rounds(lab, monkeypatch, close)
    assert seen == [2] and found == _groups(close)  # pairs this close meet in the deepest nodes
    far = [(2 * i + j, " ".join([*words(i)[:160], *(f"v{i}x{k}" for k in range(18 * j))])) for i in range(60) for j in (0, 1)]
    far = [(i, t) for i, t in far] + [(1000 + i, " ".join([*words(i)[:130], "end"])) for i in range(60)]
    seen, found = _rounds(lab, monkeypatch, far)
    assert seen[:2] == [2, 1] and found == _groups(far)


def test_deeper_nodes_are_parts_of_shorter_ones(lab):
    df = jaccard.sketched(lab.createDataFrame(_near(80, 3), "doc_id long, text string"))
    classes = df.filter("class IS NOT NULL").dropDuplicates(["class"]).select("class", "nodes", "tails").persist()
    pairs = [{tuple(r) for r in jaccard.candidate_edges(classes, d).collect()} for d in range(3)]
    joined = [graph.components(jaccard.candidate_edges(classes, d)) for d in range(3)]
    sizes = [c.count() for c in joined]
    assert pairs[0] and sizes[0] >= sizes[1] >= sizes[2] > 0
    assert jaccard.met_with(np.array([0.8, 1.0]), 6) == pytest.approx([1 - (1 - 0.8**6) ** 32, 1.0])


def test_groups_of_odd_rows_and_of_none(odd, none):
    found = jaccard.grouped(odd).collect()
    assert len(found) == odd.count()
    assert {r.class_id for r in found if r.doc_id in (1, 7)} == {1} and {r.class_id for r in found if r.doc_id in (5, 6)} == {5}
    assert jaccard.grouped(none).count() == 0


def test_components_of_a_long_path_and_a_star(lab):
    path = [(i, i + 1) for i in range(0, 60)]
    star = [(100, k) for k in range(101, 140)]
    found = graph.components(lab.createDataFrame(path + star, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {**{i: 0 for i in range(61)}, **{k: 100 for k in range(100, 140)}}


# --- repeated passages


def _cut(texts: list[bytes], length: int) -> list[tuple]:
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("length", [5, 20, 200])
def test_the_transform_finds_what_comparing_all_strings_finds(length):
    chance = random.Random(length)
    for _ in range(15):
        base = [bytes(chance.choice(b"ab") for _ in range(chance.randrange(400))) for _ in range(3)]
        windows = []
        for _ in range(chance.randrange(1, 12)):
            b = chance.choice(base)
            i = chance.randrange(len(b) + 1)
            windows.append(bytes(chance.choice(b"abc\xff\0") for _ in range(chance.randrange(30))) + b[i : chance.randrange(i, len(b) + 1)])
        count = Counter(w[i : i + length] for w in windows for i in range(len(w) - length + 1))
        want = [x for w in windows for x in [*[i + length <= len(w) and count[w[i : i + length]] > 1 for i in range(len(w))], False]]
        assert suffix.repeated_starts(*suffix.joined(windows), length).tolist() == want
        assert suffix.compared(windows, length).tolist() == want


def _passages(seed: int) -> list[str]:
    chance = random.Random(seed)
    word = lambda: "".join(chance.choice("abcdeé") for _ in range(chance.randrange(2, 9)))
    common = " ".join(word() for _ in range(70))
    texts = []
    for i in range(60):
        before, after = (" ".join(word() for _ in range(chance.randrange(0, 40))) for _ in range(2))
        texts.append(f"{before}{common if i % 3 else ''}{after}{common[100:] * (i % 5 == 0)}")
    return [*texts, "ab" * 300, "x" * 199, "y" * 200, "z" * 201]


@pytest.mark.parametrize("hot", [400, 3])
def test_passages_equal_brute_force_at_every_level(lab, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "TASK_BYTES", 4000)
    texts = _passages(5)
    df = lab.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ranges", F.lit("clash"))
    found = {r.doc_id: tuple(r)[1:] for r in suffix.digests(df).collect()}
    assert [found[i] for i in range(len(texts))] == _cut([t.encode() for t in texts], 200)


def test_op7_equals_brute_force(lab):
    rows = [(r.doc_id, (r.text or "").encode()) for r in read(lab, SMALL, "documents").collect()]
    want = dict(zip([i for i, _ in rows], _cut([t for _, t in rows], 200)))
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op7_suffix"](lab, SMALL).collect()} == want


def test_passages_of_odd_rows_and_of_none(odd, none):
    found = suffix.digests(odd).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in odd.collect()}
    assert len(found) == odd.count()
    assert all(r.n_bytes == len(texts[r.doc_id]) for r in found)
    assert {r.doc_id for r in found if r.n_removed == r.n_bytes > 0} == {5, 6}
    kept = suffix.removed(odd)
    assert kept.columns == odd.columns and {r.text for r in kept.filter("doc_id IN (5, 6)").collect()} == {""}
    assert suffix.digests(none).count() == 0 and suffix.removed(none).count() == 0


def test_pieces_anchor_alike(monkeypatch):
    chance = random.Random(1)
    texts = [bytes(chance.choice(b"abc") for _ in range(n)) for n in (5000, 0, 199, 200, 201, 650, 3000, 80, 690)]
    starts = lambda: {(o, g, s) for o, g, _, a, b, _ in zip(*suffix.anchored(texts, 24)) for s in range(a, b + 1)}
    whole = starts()
    assert len(whole) == sum(max(0, len(t) - 199) for t in texts)
    monkeypatch.setattr(suffix, "PIECE", 700)
    suffix._powers.cache_clear()
    assert starts() == whole


# --- mixing


def _targets(sizes: dict) -> dict:
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in full]
        left, weights = total - sum(full.values()), sum(weight[s] for s in rest)
        share = {s: left * weight[s] / weights for s in rest}
        above = [s for s in rest if share[s] > 3 * sizes[s]]
        if not above:
            return {**share, **{s: float(v) for s, v in full.items()}}
        full.update({s: 3 * sizes[s] for s in above})


@pytest.mark.parametrize("table", ["documents", "skewed"])
def test_targets_and_taken_words(lab, table):
    if table == "documents":
        docs = read(lab, SMALL, "documents")
    else:
        rows = [(i, "w " * (i % 90), ["a", None, "b", "c", "d"][0 if i % 3 else i % 5]) for i in range(900)] + [(5000, "one two", "tiny")]
        docs = lab.createDataFrame(rows, "doc_id long, text string, source string")
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    size = {r.doc_id: len(_words(r.text)) for r in docs.select("doc_id", "text").collect()}
    sizes, taken = Counter(), Counter()
    for i, n in size.items():
        sizes[source[i]] += n
    want = _targets(sizes)
    rows = mixing.mixed(docs).collect()
    assert len(rows) == len(size)
    for r in rows:
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[source[r.doc_id]] and r.taken <= 3 * r["size"]
        assert r.target == pytest.approx(want[source[r.doc_id]], rel=1e-9)
        taken[source[r.doc_id]] += r.taken
    for s, n in want.items():
        # half a block by rounding, one by the last block, and what the draw may stray
        assert abs(taken[s] - n) <= 2.5 * mixing.BLOCK + mixing.SLACK * n
    assert sorted(map(tuple, mixing.mixed(docs.repartition(7)).collect())) == sorted(map(tuple, rows))


def test_slots_are_permuted(lab):
    slots = lab.range(300).select(F.lit(2).alias("number"), F.lit(100).cast("long").alias("blocks"), F.col("id").alias("slot"))
    found = [r.block for r in mixing.permuted(slots).orderBy("slot").collect()]
    passes = [found[i : i + 100] for i in (0, 100, 200)]
    assert all(sorted(p) == list(range(100)) for p in passes) and passes[0] != passes[1] != passes[2]
    assert sum(abs(a - b) == 1 for a, b in zip(found, found[1:])) < 30


def _sources(lab, rows):
    return lab.createDataFrame(rows, "origin string, number int, source_size long, target double, blocks long, quota long")


def test_shards_draw_near_the_shares(lab, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD", 500)
    monkeypatch.setattr(mixing, "SLACK", 0.02)
    found = mixing.shard_counts(_sources(lab, [("=a", 0, 10000, 1.0, 2500, 6000), ("=b", 1, 10000, 1.0, 2500, 4000)])).collect()
    had = {o: sum(r.slots for r in found if r.origin == o) for o in ("=a", "=b")}
    assert sum(had.values()) == 10000 and had["=a"] != 6000 and abs(had["=a"] - 6000) < 120  # drawn, not settled
    drawn = [r.slots for r in found if r.origin == "=a" and r.shard < 19]
    assert abs(np.mean(drawn) - 300) < 15 and 4 < np.std(drawn) < 25
    for o in had:
        rows = sorted((r.first, r.slots) for r in found if r.origin == o)
        assert rows[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:]))


def test_another_draw_is_another_mix_near_the_target(lab, monkeypatch):
    rows = [(i, "one two three four five six " * (1 + i % 9), ["a", "b", "c"][i % 3]) for i in range(6000)]
    docs = lab.createDataFrame(rows, "doc_id long, text string, source string")

    def totals():
        found = mixing.mixed(docs).join(docs.select("doc_id", "source"), "doc_id")
        assert found.filter("taken > 3 * size").count() == 0
        return {r.source: (r.taken, r.target) for r in found.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()}

    first = totals()
    monkeypatch.setattr(mixing, "share_drawn", lambda slot: mixing.long_scrambled(slot, 77) / F.lit(float(mixing.PRIME)))
    second = totals()
    assert any(first[s][0] != second[s][0] for s in first)
    for found in (first, second):
        assert all(abs(taken - target) <= 0.012 * target + 100 for taken, target in found.values())


def test_ten_billion_slots(lab):
    far = lab.range(10**10, 10**10 + 40_000).select(mixing.share_drawn(F.col("id")).alias("u"))
    u = np.array([r.u for r in far.collect()])
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.01 and len(np.unique(u)) == len(u)
    near = np.array([r.u for r in lab.range(10**10 % mixing.PRIME, 10**10 % mixing.PRIME + 100).select(mixing.share_drawn(F.col("id")).alias("u")).collect()])
    assert not np.isin(near, u).any()  # no period
    blocks = 10**10
    slots = lab.range(blocks - 50, blocks + 50).select(F.lit(3).alias("number"), F.lit(blocks).cast("long").alias("blocks"), F.col("id").alias("slot"))
    found = [r.block for r in mixing.permuted(slots).orderBy("slot").collect()]
    assert len(set(found[:50])) == 50 and all(0 <= b < blocks for b in found) and max(found) > 2**32
    numbers = lab.range(10_000).select(F.lit("a").alias("g"), F.col("id").alias("k"), F.lit(1 << 49).alias("v"))
    sums = mixing.before(numbers, ["g"], "k", "v", "upto", 10_000).collect()
    assert all(r.upto == r.k << 49 for r in sums)


def test_rows_without_ids_spread_over_chunks(lab, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 50)
    rows = [(None, f"text {i}", "a") for i in range(1000)] + [(7, "the same", "a")] * 1000
    docs = lab.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    found = mixing.placed(docs).collect()
    starts = sorted(r.start for r in found)
    assert starts == list(range(0, 4000, 2))  # every row has a place of its own
    own = sorted(r.start for r in found if r.doc_id == 7)
    assert own != list(range(own[0], own[0] + 2000, 2)) and own[-1] - own[0] > 3500


def test_mixing_of_odd_rows_and_of_none(odd, none):
    rows = mixing.mixed(odd).collect()
    assert len(rows) == odd.count() and all(r.taken == 0 for r in rows if r.doc_id in (2, 3, 4))
    assert mixing.mixed(none).count() == 0 and mixing.remixed(none).count() == 0
    texts = {r.doc_id: r.text for r in odd.collect()}
    words = Counter(w for r in mixing.remixed(odd).collect() for w in _words(r.text))
    assert sum(words.values()) == sum(r.taken for r in rows)
    assert set(words) <= {w for t in texts.values() for w in _words(t)}


def test_op4_runs_no_python(lab):
    for df in (mixing.mixed(read(lab, SMALL, "documents")), mixing.remixed(read(lab, SMALL, "documents"))):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- the pipeline


def test_stages_work_on_what_the_one_before_kept(lab):
    docs = read(lab, SMALL, "documents")
    columns = docs.columns
    clean = stage(corpus_pipeline.drop_toxic(lab, docs, SMALL), "t")
    toxic = {r.doc_id for r in QUERIES["op2_toxicity"](lab, SMALL).filter("predicted = 1").collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - toxic and clean.columns == columns
    single = stage(corpus_pipeline.drop_near_copies(lab, clean, SMALL), "t")
    want = _groups([(r.doc_id, r.text) for r in clean.collect()])
    assert sorted(r.doc_id for r in single.collect()) == sorted({g for _, _, g in want.values()}) and single.columns == columns
    cut = stage(corpus_pipeline.cut_repeats(lab, single, SMALL), "t")
    before = [(r.doc_id, (r.text or "").encode()) for r in single.collect()]
    kept = dict(zip([i for i, _ in before], _cut([t for _, t in before], 200)))
    rows = cut.collect()
    assert len(rows) == len(before) and cut.columns == columns
    for r in rows:
        assert len(r.text.encode()) <= kept[r.doc_id][0] - kept[r.doc_id][1] <= len(r.text.encode()) + 6 * kept[r.doc_id][2]
        assert r.n_chars == len(r.text)
    mix = stage(corpus_pipeline.mix_sources(lab, cut, SMALL), "t")
    taken = {r.doc_id: r.taken for r in mixing.mixed(cut).collect() if r.taken}
    passes = [(r.doc_id, len(_words(r.text))) for r in mix.collect()]
    words = Counter()
    for i, n in passes:
        words[i] += n
    assert words == taken and mix.columns == columns and max(Counter(i for i, _ in passes).values()) <= 3
    texts = {r.doc_id: _words(r.text) for r in rows}
    assert all(r.text.split() == texts[r.doc_id] for r in mix.collect() if len(_words(r.text)) == len(texts[r.doc_id]))
    ids = corpus_pipeline.encode(lab, mix, SMALL)
    assert ids.count() == mix.count() and ids.filter("n_tokens <= 0").count() == 0


def test_toxicity_keeps_the_callers_columns(lab):
    docs = read(lab, SMALL, "documents").withColumns({c: F.concat(F.lit("own "), "doc_id") for c in ("score", "Predicted", "n_offending")})
    kept = corpus_pipeline.drop_toxic(lab, docs, SMALL)
    assert kept.columns == docs.columns and kept.filter("score <> concat('own ', doc_id) OR Predicted <> score").count() == 0
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, docs.join(kept.select("doc_id"), "doc_id", "left_semi").select(docs.columns).collect()))


def test_near_copies_of_odd_rows(lab, odd):
    kept = corpus_pipeline.drop_near_copies(lab, odd, SMALL)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == [(False, 0), *[(True, i) for i in (1, 2, 3, 4, 5, 8, 9)]]


def test_the_run_goes_through(lab):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "repeated_passages", "mixing", "byte_bpe"]
    assert corpus_pipeline.run(lab, SMALL).columns == ["doc_id", "lang", "source", "n_chars", "ids", "n_tokens"]
