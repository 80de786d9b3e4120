"""op1, op6, op8: vocabularies."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventloom.llm import bytebpe, fertility, varbyte, vocab
from eventloom.llm.common import read
from eventloom.llm.queries import QUERIES
from eventloom.sources.tables import scratch_path
from tests.llm.conftest import SMALL

RANKS = vocab.read_ranks(vocab.public_path(bytebpe.VOCABULARY))
PLAIN = tiktoken.Encoding("own", pat_str=vocab.public_pattern(), mergeable_ranks=RANKS, special_tokens={})
MEMORY, TOKENS = bytebpe._codec(vocab.public_path(bytebpe.VOCABULARY), vocab.public_pattern())
WORDS = vocab.file_tokenizer(vocab.public_path(varbyte.VOCABULARY))
ENDED = vocab.Memory(vocab.ended_ids(vocab.public_path(varbyte.VOCABULARY)), limit=20)
ODD = ["", "  ", "a\n\n b  c\x1c d\x85e  x", "don't 'S  it's\t\t q", "漢字" * 30, "\U0001f600é" * 9, "x" * 999, "a \n", "<|endoftext|> x", "ab.(cd'S é***"]


def _ids(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


def _sha(ids) -> str:
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab.É'sS\n\t #1é \U0001f600漢")), max_size=6))
def test_pieces_give_what_whole_texts_give(texts):
    for text, ids in zip(texts, vocab.encode_texts(MEMORY, texts)):
        assert _ids(ids) == PLAIN.encode_ordinary(text)
    for text, ids in zip(texts, vocab.encode_texts(ENDED, texts, vocab.WORDS)):
        assert _ids(ids) == WORDS.encode(text, add_special_tokens=False).ids


def test_odd_texts_equal_the_libraries():
    assert [_ids(i) for i in vocab.encode_texts(MEMORY, ODD)] == [PLAIN.encode_ordinary(t) for t in ODD]
    assert [_ids(i) for i in vocab.encode_texts(ENDED, ODD, vocab.WORDS)] == [WORDS.encode(t, add_special_tokens=False).ids for t in ODD]


def test_op8_equals_brute_force_on_all_rows(lab):
    texts = {r.doc_id: r.text or "" for r in read(lab, SMALL, "documents").collect()}
    rows = QUERIES["op8_byte_bpe"](lab, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = PLAIN.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), _sha(ids))
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_encode_offsets_and_decode_with_split_characters(lab, odd, none):
    rows = bytebpe.decode(bytebpe.encode(odd, offsets=True)).collect()
    assert len(rows) == odd.count() and rows[0].score == "clash"
    for r in rows:
        text = r.text or ""
        assert r.decoded_text == text and bytes(r.decoded) == text.encode()
        starts = np.cumsum([0] + [len(TOKENS[i]) for i in r.ids])[:-1].tolist()
        assert r.byte_starts == starts
        assert r.char_starts == [len(text.encode()[: s + 1].decode("utf-8", "ignore")) - (0 if _whole(text, s) else -1) - 1 for s in starts]
    assert bytebpe.encode(none).count() == 0


def test_offsets_equal_the_librarys(lab):
    """Places of tokens in characters, also where a character lies in several tokens."""
    texts = ["plain words, here", "naïve façade 漢字 \U0001f600 end", "a\u0301 \U0001f469\u200d\U0001f4bb!", "", "  \n\ttabs"]
    tokenizer = vocab.rank_tokenizer(vocab.read_ranks(vocab.public_path(bytebpe.VOCABULARY)), vocab.public_pattern())
    df = lab.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bytebpe.encode(df, offsets=True).collect():
        want = tokenizer.encode(texts[r.doc_id], add_special_tokens=False)
        assert r.ids == want.ids and r.char_starts == [a for a, _ in want.offsets]


def test_the_reversed_byte_table_gives_every_token_back():
    ranks = vocab.read_ranks(vocab.public_path(bytebpe.VOCABULARY))
    tokens = vocab.token_bytes(vocab.token_names(ranks))
    assert {t: i for i, t in enumerate(tokens)} == ranks


def test_decoding_keeps_no_column_of_its_own_name(lab):
    df = lab.createDataFrame([([1, 2], "clash")], "ids array<int>, Decoded string")
    assert bytebpe.decode(df).columns == ["ids", "decoded", "decoded_text"]


def _whole(text: str, start: int) -> bool:
    """Whether cutting after the byte at `start` leaves whole characters."""
    try:
        text.encode()[: start + 1].decode()
    except UnicodeDecodeError:
        return False
    return True


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_packed_values_come_back(n):
    random = np.random.default_rng(n)
    values = (random.integers(0, 1 << 32, n) >> random.integers(0, 32, n)).astype("<u4")
    control, data = varbyte.pack(values)
    assert len(control) == -(-n // 4) and len(data) == sum(max(1, -(-int(v).bit_length() // 8)) for v in values)
    assert (varbyte.unpack(control, data, n) == values).all()


def test_op6_equals_brute_force_on_all_rows(lab, monkeypatch):
    monkeypatch.setattr(varbyte, "BLOCK_IDS", 300)
    texts = {r.doc_id: r.text or "" for r in read(lab, SMALL, "documents").collect()}
    rows = {r.doc_id: r for r in QUERIES["op6_varbyte"](lab, SMALL).collect()}
    start = 0
    for doc_id in sorted(texts):
        ids = [*WORDS.encode(texts[doc_id], add_special_tokens=False).ids, 1]
        r = rows[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_files_of_odd_rows_and_of_none(lab, odd, none):
    path = scratch_path(lab, "files")
    varbyte.round_trip(odd, path)
    rows = varbyte.read(lab, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    counts = Counter(i for r in rows for i in _ids(bytes(r.ids)))
    ranks = [r.id for r in lab.read.parquet(f"{path}/ranks").orderBy("rank").collect()]
    assert ranks == sorted(counts, key=lambda i: (-counts[i], i))
    assert varbyte.round_trip(none, scratch_path(lab, "files")).count() == 0


def _base(text: str) -> tuple:
    words = [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    seen, repeats = set(), 0
    for line in text.split("\n"):
        repeats += bool(line.strip(" \t")) and line in seen
        seen.add(line)
    failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), repeats, len(again), failed


def test_op1_base_counts_equal_brute_force(lab):
    texts = {r.doc_id: r.text or "" for r in read(lab, SMALL, "documents").collect()}
    rows = QUERIES["op1_fertility"](lab, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == _base(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_fertility_bands_reject_what_no_language_looks_like(lab):
    nouns = "people house water music river stone light paper green north table cloud reader word day number window garden letter".split()
    good = [(i, " ".join(random.Random(i).choices(nouns, k=80)), "en") for i in range(300)]
    odd = (999, " ".join(hashlib.sha256(str(k).encode()).hexdigest()[:12] for k in range(80)), "en")
    rows = fertility.judged(lab.createDataFrame([*good, odd], "doc_id long, text string, lang string")).collect()
    kept = {r.doc_id: r.kept for r in rows if not r.base_failed}
    assert not kept[999] and sum(kept.values()) >= 0.98 * (len(kept) - 1)


@pytest.mark.parametrize("n", [1, 30, 199, 200])
def test_a_rare_language_has_its_own_bands(lab, n):
    nouns = "people house water music river stone light paper green north table cloud reader word day number window garden letter".split()
    common = [(i, " ".join(random.Random(i).choices(nouns, k=80)), "en") for i in range(300)]
    han = ["".join(chr(0x4E00 + 37 * a + 11 * b) for b in range(2 + a % 2)) for a in range(60)]
    rare = [(1000 + i, " ".join(random.Random(i).choices(han, k=80)), lang) for i in range(n) for lang in ("zh", None)]
    odd = [(999, " ".join(hashlib.sha256(str(k).encode()).hexdigest()[:12] for k in range(80)), "zh")] if n > 1 else []
    rows = fertility.judged(lab.createDataFrame([*common, *rare, *odd], "doc_id long, text string, lang string")).collect()
    assert all(r.kept for r in rows if r.doc_id >= 1000 and not r.base_failed)
    assert not any(r.kept for r in rows if r.doc_id == 999)
    alone = fertility.judged(lab.createDataFrame([*rare, *odd], "doc_id long, text string, lang string")).collect()
    assert sorted((r.doc_id, r.kept) for r in alone) == sorted((r.doc_id, r.kept) for r in rows if r.doc_id >= 999)


@pytest.mark.parametrize("n_words", [20, 45, 49, 50])
def test_short_texts_are_judged_as_well(lab, n_words):
    nouns = "people house water music river stone light paper green north table cloud reader word day number window garden letter".split()
    signs = [chr(c) for c in range(0x430, 0x450)]
    good = [(i, " ".join(random.Random(i).choices(nouns, k=80))) for i in range(300)]
    short = [(1000 + i, " ".join(random.Random(i).choices(nouns, k=n_words))) for i in range(100)]
    hexes = (1, " ".join(hashlib.sha256(str(k).encode()).hexdigest()[:12] for k in range(n_words)))
    mojibake = (2, " ".join("".join(random.Random(k).choices(signs, k=6)).encode().decode("latin-1") for k in range(n_words)))
    odd = [(2000 + i, text) for i, text in (hexes, mojibake)]
    rows = fertility.judged(lab.createDataFrame([(i, t, "en") for i, t in [*good, *short, *odd]], "doc_id long, text string, lang string")).collect()
    kept = {r.doc_id: r.kept for r in rows if not r.base_failed}
    assert not kept[2001] and not kept[2002]
    clean = [k for i, k in kept.items() if 1000 <= i < 2000]
    assert len(clean) >= 90 and sum(clean) >= 0.97 * len(clean)


def test_all_letters_tell_the_script():
    """Also where letters of another script stand at regular places."""
    tricky = "".join("a" if i % 5 == 0 else "я" for i in range(1000))
    for text, name in [(tricky, "CYRILLIC"), ("漢字かな漢字 abc", "CJK"), ("abc яяя", "CYRILLIC"), ("abc 123", "LATIN"), ("123 !", "none"), ("", "none"), ("é", "LATIN")]:
        assert fertility.script_of(text) == name
    long = "я" * 300_000 + "z" * 299_999
    assert fertility.script_of(long) == "CYRILLIC"


def test_judged_keeps_columns_of_the_caller(lab):
    df = lab.createDataFrame([(1, "some words " * 15, "en", "mine", "too", "own")], "doc_id long, text string, lang string, band string, `group` string, measure string")
    row = fertility.judged(df).first()
    assert (row.band, row.group, row.measure) == ("mine", "too", "own")


def test_fertility_of_odd_rows_and_of_none(odd, none):
    rows = fertility.judged(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.kept is not None for r in rows) and all(r.base_failed for r in rows if r.doc_id in (2, 3, 4))
    assert fertility.judged(none).count() == 0
    assert fertility.judged(odd.drop("lang"), language=None).filter(F.col("kept").isNull()).count() == 0
