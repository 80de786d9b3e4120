"""op11, op12, op13: spelling variants, url filters, conversation structure."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventloom.checks.compare import connect, differences
from eventloom.llm import dialogue, spelling, urls
from eventloom.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import SMALL


@pytest.mark.parametrize("name", ["op11_spelling", "op12_urls", "op13_dialogue"])
def test_same_as_sql(lab, name):
    with connect(SMALL) as database:
        assert differences(QUERIES[name](lab, SMALL), database.execute(ORACLES[name])) is None


# --- conversations


def _cheapest(codes: bytes) -> tuple[int, str]:
    """(cost, audit) by trying every edit in every state."""
    best = {dialogue.NOTHING: (0, "")}

    def inserted(states):
        for _ in range(2):
            for state, (cost, audit) in list(states.items()):
                after = dialogue.A if state == dialogue.U else dialogue.U
                option = (cost + 5, audit + "I")
                states[after] = min(states.get(after, option), option)
        return states

    for code in codes:
        new = {}
        for state, (cost, audit) in inserted(best).items():
            options = [(state, cost + 2, "D")]
            if not code & 8:
                wanted = dialogue.A if state == dialogue.U else dialogue.U
                more = 5 if code & 4 else 0
                options.append((wanted, cost + more + (code & 3 != wanted), "K" if code & 3 == wanted else "R"))
                if code & 3 == dialogue.S and state == dialogue.NOTHING:
                    options.append((dialogue.S, cost + more, "K"))
            for after, total, letter in options:
                new[after] = min(new.get(after, (1 << 60, "")), (total, audit + letter))
        best = new
    best = inserted(best)
    return min(best[s] for s in (dialogue.NOTHING, dialogue.A) if s in best)


def _joined(codes: bytes, size: int) -> tuple[int, str]:
    """The same from chunks, by trying every way through them."""
    aligner, states = dialogue.Aligner(), {dialogue.NOTHING: (0, "")}
    for k in range(0, len(codes), size):
        new = {}
        for (before, after), (cost, audit) in aligner.chunk(codes[k : k + size]).items():
            if before in states:
                option = (states[before][0] + cost, states[before][1] + audit)
                new[after] = min(new.get(after, option), option)
        states = new
    return min((c + 5 * len(dialogue.ENDING[s]), a + dialogue.ENDING[s]) for s, (c, a) in states.items())


def test_every_short_conversation_is_repaired_at_the_least_cost():
    kinds = [0, 1, 2, 3, 6, 7, 8]
    for n in range(5):
        for codes in map(bytes, itertools.product(kinds, repeat=n)):
            assert dialogue.Aligner().whole(codes) == _cheapest(codes) == _joined(codes, 2), codes


@pytest.mark.parametrize("seed", range(4))
def test_long_conversations_are_repaired_at_the_least_cost(seed):
    chance = random.Random(seed)
    for n in (30, 90, 200):
        codes = bytes(chance.choices([2, 3, 1, 0, 6, 7, 5, 8], [6, 6, 2, 1, 1, 1, 1, 2], k=n))
        assert dialogue.Aligner().whole(codes) == _cheapest(codes) == _joined(codes, 17)


def _plain(rows) -> dict:
    """The whole result per conversation of rows (conv_id, turn, role, text)."""
    groups, found = {}, {}
    for conv, *row in rows:
        groups.setdefault(conv, []).append(row)
    for conv, turns in groups.items():
        turns = [(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in turns]
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in turns:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        initials = [r[:1] for _, r, _ in turns]
        cost, audit = _cheapest(bytes(map(dialogue.row_code, initials, faults)))
        lines = "\n".join(f"{r}:{x}" for r, x in dialogue.repaired(audit, [r for _, r, _ in turns], [x for *_, x in turns])[0])
        known = [t for t, *_ in turns if t is not None]
        found[conv] = (
            max(known) - min(known) + 1 - len(set(known)) if known else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256(lines.encode()).hexdigest(),
        )
    return found


@pytest.mark.parametrize("chunk", [256, 5])
def test_odd_conversations(lab, chunk):
    long = [(7, k // 2, ["user", "assistant", "system", None][k * k % 7 % 4], ["Yes.", "No", "", None, f"{k}?"][k % 5]) for k in range(700)]
    rows = [
        *long, (None, 1, "user", "a."), (None, None, "assistant", "b"), (None, None, None, None), (1, None, "user", "x."), (1, None, "user", "x."),
        (2, 3, "User", "x" * 300_000 + "."), (2, 1, "", "y!"), (2, 9, "assistant", " \t\n"), (3, 5, "system", "only."),
        (4, 1, "user", "tie."), (4, 1, "assistant", "tie."), (4, 1, "assistant", "tie."), (4, 9, "ubuntu", "kept by its initial."),
    ]
    df = lab.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df = df.select("*", *[F.lit("clash").alias(c) for c in ("part", "seq", "audit", "mark", "known", "first_turn", "present", "rows")])
    found = dialogue.audits(df.repartition(5), chunk_rows=chunk).collect()
    assert {r.conv_id: tuple(r)[1:] for r in found} == _plain(rows)
    assert len(found) == len(_plain(rows))


def test_conversations_that_lose_all_rows_and_none(lab):
    df = lab.createDataFrame([(1, 1, "user", "a.", False), (2, 1, "user", "b.", None)], "conv_id bigint, turn bigint, role string, text string, p boolean")
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(dialogue.audits(df, F.col("p")).collect()) == [(1, 0, 0, 0, 0, 0, 0, "", empty), (2, 0, 0, 0, 0, 0, 0, "", empty)]
    assert dialogue.audits(df.limit(0)).count() == 0


# --- spelling


def _near(vocabulary: set[str]) -> set[tuple[str, str]]:
    """Pairs by looking every one-edit variant up."""
    letters, found = set("".join(vocabulary)), set()
    for w in vocabulary:
        options = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        options |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        found |= {(w, v) for v in options & vocabulary if v != w}
    return found


@pytest.mark.parametrize("part", [1000, 4])
def test_pairs_equal_brute_force(lab, monkeypatch, part):
    monkeypatch.setattr(spelling, "PART_WORDS", part)
    chance = random.Random(part)
    words = {"".join(chance.choices("abé", k=chance.randrange(7, 10))) for _ in range(400)}
    words |= {"commonhalf" + "".join(chance.choices("abc", k=4)) for _ in range(60)} | {"a" * 3000, "a" * 2999, "a" * 2998 + "b"}
    df = lab.createDataFrame([(w, len(w)) for w in words], "word string, n bigint")
    pairs = [(r.word, r.near) for r in spelling.near_pairs(df).collect()]
    assert Counter(pairs) == Counter(_near(words))


def test_forms_and_roots(lab):
    rows = [("because", 5000), ("becaus", 400), ("becauseq", 500), ("becauseqq", 50), ("becauseqqq", 5), ("becauze", 501), ("becausa", 5000)]
    found = {r.word: r for r in spelling.variants(lab.createDataFrame(rows, "word string, n bigint")).collect()}
    assert found["becauseqqq"][1:] == ("becauseqq", "because", 5, 1, 50)
    assert found["becauseq"][1:3] == ("because", "because")
    assert found["becauze"].form is None and found["becauze"].root == "becauze"  # not ten times as common
    assert found["becaus"].form == "becausa"  # a tie goes to the smaller one


def test_words_of_odd_rows_and_of_none(lab, odd, none):
    rows = [(None, "ABCDEFGH abcdefgh")] * 3 + [(2, None), (3, ""), (4, "÷×÷×÷×÷× Éabcdefg Éabcdefg short"), (5, "x" * 100_000 + " " + "x" * 100_000)]
    rows += [(i, "Variants variants of wordings") for i in range(100)]
    counts = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            code = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: code % len(run)] + run[code % len(run) + 1 :] if code % 31 == 0 else run] += 1
    found = spelling.words(lab.createDataFrame(rows, "doc_id bigint, text string"))
    assert {tuple(r) for r in found.collect()} == {(w, n) for w, n in counts.items() if len(w) >= 7 and n >= 2}
    assert spelling.variants(spelling.words(odd)).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling.variants(spelling.words(none)).count() == 0


# --- urls


def test_hosts_paths_and_rules(lab):
    rows = [
        ("https://A.Example.ORG/es/1?q=/x", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("http://example.org/en/12#top", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://example.org/en/21", "example.org", "/en/21", "org/", "allow"), ("x://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("a://b.com/fr/", "b.com", "/fr/", "com/fr/", "allow"), ("a://b.com/fr", "b.com", "/fr", None, "allow"), ("a://com?/de/", "com", "", None, "allow"),
        ("a://org", "org", "", None, "allow"), ("no scheme/de/", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
        ("://É.COM/de/\n#", "É.com", "/de/\n", "com/de/", "block"), ("a://x.net" + "/seg" * 5000, "x.net", "/seg" * 5000, None, "allow"),
    ]
    df = lab.createDataFrame([(i, r[0]) for i, r in enumerate(rows)] * 2, "page_id bigint, url string")
    df = df.select("*", *[F.lit("clash").alias(c) for c in ("host", "Path", "rule", "node", "purity", "n", "shape")])
    found = urls.judged(df).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in found) == sorted((i, *r[1:]) for i, r in enumerate(rows) for _ in "ab")
    assert urls.judged(df.limit(0)).count() == 0


def test_templates_reject_what_their_labels_say(lab):
    """Labels on a part of a host's pages decide about the others of the same template, and about no other."""
    pages = [f"http://s.net/{kind}/{who}/{n}" for kind in ("pills", "news") for who in (f"u{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)) for n in range(3)]
    pages += ["http://t.net/pills/ua/1"]
    rules = (urls.Rule("block", "s.net", "/pills/ua"), urls.Rule("block", "s.net", "/pills/ub"), urls.Rule("allow", "s.net", "/news/ua"))
    df = lab.createDataFrame(list(enumerate(pages)), "page_id bigint, url string")
    found = urls.judged(df, rules).collect()
    assert {r.template for r in found if r.host == "s.net"} == {"/pills/*/#", "/news/*/#"}
    wanted = lambda r: "block" if r.host == "s.net" and r.path.startswith("/pills") else "allow"
    assert all(r.verdict == wanted(r) for r in found)


def test_branches_with_like_shares_merge(lab):
    pages = [f"http://s.net/{kind}/{n}" for kind in ("a", "b", "c", "d") for n in range(200)]
    rules = tuple(urls.Rule("block" if kind in "ab" else "allow", "s.net", f"/{kind}/") for kind in "abc")
    found = urls.judged(lab.createDataFrame(list(enumerate(pages)), "page_id bigint, url string"), rules).collect()
    assert {r.template for r in found} == {"/a|b/#", "/c/#", "/d/#"}
