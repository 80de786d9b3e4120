"""Public vocabularies, and their use piece by piece: a distinct piece of text is given to the library once."""

from __future__ import annotations

import base64
import os
import re
import sys
from array import array
from collections.abc import Callable

import numpy as np

#: Unicode white space, as the tokenizers' regular expressions understand it (fixed values).
SPACE = "\t-\r \x85\xa0  -     　"
#: Letters and signs between which every vocabulary here cuts: a letter never merges with one of these signs.
LETTERS = "a-zA-ZÀ-ÖØ-öø-ÿ"
SIGNS = r"!-&(-/:-@\[-`{-~"
#: Cuts where every vocabulary here cuts as well: a word of letters or another word, with the blank before it, or space.
PIECES = re.compile(rf" ?[{LETTERS}]+(?![^{SPACE}{SIGNS}])| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: The same for vocabularies that drop white space.
WORDS = re.compile(rf"[{LETTERS}]+(?![^{SPACE}{SIGNS}])|[^{SPACE}]+")
PLAIN = re.compile(rf"[{LETTERS}]+")

#: Pieces a worker remembers per generation, and the longest one that is remembered; others are encoded each time.
REMEMBERED = 1 << 18
REMEMBERED_CHARS = 48
#: Words that are given to the library in one text.
MANY = 512


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Memory:
    """The value of each piece, found by `encode` for a list of new pieces at a time.

    Pieces are kept in two generations: when the younger one is full, it becomes the older one, and what is used again
    moves up, so common pieces stay.
    """

    def __init__(self, encode: Callable[[list[str]], list], limit: int = REMEMBERED):
        self.encode, self.limit, self.known, self.older = encode, limit, {}, {}

    def values(self, pieces: list[str]) -> list:
        found = list(map(self.known.get, pieces))
        if None in found:
            gaps = [i for i, v in enumerate(found) if v is None]
            wanted = dict.fromkeys(pieces[i] for i in gaps)
            new = {p: self.older[p] for p in wanted if p in self.older}
            fresh = [p for p in wanted if p not in new]
            new.update(zip(fresh, self.encode(fresh)))
            for i in gaps:
                found[i] = new[pieces[i]]
            if len(self.known) + len(new) > self.limit:
                self.older, self.known = self.known, {}
            self.known.update((p, v) for p, v in new.items() if len(p) <= REMEMBERED_CHARS)
        return found


def as_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it can be seen, else the next one from 256 on."""
    seen = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table = {b: chr(b) for b in seen}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(seen))
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def token_names(ranks: dict[bytes, int]) -> dict[str, int]:
    """The tokens as a byte-level vocabulary writes them: a printable character for each byte."""
    alphabet = byte_alphabet()
    return {"".join(alphabet[b] for b in token): rank for token, rank in ranks.items()}


def token_bytes(names: dict[str, int]) -> list[bytes]:
    """The bytes of every id, from the names of a byte-level vocabulary: the byte table reversed."""
    byte_of = {character: byte for byte, character in enumerate(byte_alphabet())}
    tokens = [b""] * (max(names.values(), default=-1) + 1)
    for name, i in names.items():
        tokens[i] = bytes(map(byte_of.__getitem__, name))
    return tokens


def rank_tokenizer(ranks: dict[bytes, int], pattern: str):
    """A byte-level tokenizer of the library that merges as the ranks say: the pair whose token has the lowest rank first.

    A token that is cut anywhere into two known tokens is a merge, so the library may reach it by any pair, and a piece
    that is a token itself stays whole.
    """
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    alphabet = byte_alphabet()
    name = {token: "".join(alphabet[b] for b in token) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        cuts = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        merges += [(name[a], name[b]) for a, b in sorted(cuts, key=lambda c: (ranks[c[0]], ranks[c[1]]))]
    tokenizer = Tokenizer(models.BPE(token_names(ranks), merges, ignore_merges=True, cache_capacity=0))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return tokenizer


def file_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def library_ids(tokenizer) -> Callable[[list[str]], list[bytes]]:
    """Ids of each piece from the tokenizers library, without added special tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return lambda pieces: [as_bytes(e.ids) for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]


def ended_ids(path: str) -> Callable[[list[str]], list[bytes]]:
    """Ids of each word from a vocabulary that ignores case and marks the last token of a word.

    Words of letters only are given to the library many at a time, in one text, and cut again at the marks.
    """
    tokenizer = file_tokenizer(path)
    many = library_ids(tokenizer)
    ends = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
    for token, i in tokenizer.get_vocab().items():
        ends[i] = token.endswith("</w>")

    def encode(pieces: list[str]) -> list[bytes]:
        names = [p.lower() if PLAIN.fullmatch(p) else p for p in pieces]
        found = dict.fromkeys(names)
        plain = [p for p in found if PLAIN.fullmatch(p)]
        for i in range(0, len(plain), MANY):
            words = plain[i : i + MANY]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = (4 * (np.flatnonzero(ends[ids]) + 1)).tolist()
            if len(cuts) != len(words):  # a word that the library cuts further
                found.update(zip(words, many(words)))
            else:
                data = ids.tobytes()
                found.update(zip(words, map(data.__getitem__, map(slice, [0, *cuts], cuts))))
        other = [p for p, value in found.items() if value is None]
        found.update(zip(other, many(other)))
        return [found[p] for p in names]

    return encode


def encode_texts(memory: Memory, texts: list[str], cut: re.Pattern = PIECES) -> list[bytes]:
    """The ids of whole texts, joined from the ids of their pieces."""
    parts = [cut.findall(t) for t in texts]
    values = memory.values([p for part in parts for p in part])
    joined, at = [], 0
    for part in parts:
        joined.append(b"".join(values[at : at + len(part)]))
        at += len(part)
    return joined
