"""Conversation structure repair: turns are aligned to the alternating grammar `(s?(ua)+)?` at the least cost.

What is repaired. A row is blank (no visible character), a duplicate (role and text seen earlier in the conversation) or
truncated (its last visible character ends no sentence); the first that holds counts. Blank and duplicate rows must go.
Edits have costs: Keep 0, Rerole to user or assistant 1, Delete 2, Insert an empty user or assistant turn 5; a truncated
row that stays costs 5 more. The audit is one letter an edit, in order; of the cheapest ones, the least in ASCII.

How. Wagner-Fischer: a matrix holds the least cost of aligning the last i rows to the last j letters of the alternating
string, so each feasible length is one cell of its last row. A greedy repair gives the incumbent cost C; deletions and
insertions on a path within C number at most C/2 and C/5, and only that band (Ukkonen) is filled. Each length that meets
the least cost is traced back, the least letter first, and the audits are compared.

On Spark. Rows are dealt by ranges of (conv_id, turn, role), so a conversation with a third of all rows lies on many
tasks. A task reads its rows in order and finishes every conversation that lies wholly in it and has CHUNK_ROWS rows at
most. Others leave chunks: for each state before a chunk (nothing yet, after s, u or a) and after it, the least cost and
audit. Costs, and the order of a chunk's audits, are folded per conversation in two streamed passes, backwards for what
the rest costs and forwards for the states; then chunks write their turns, and one streamed pass joins and hashes them.
No audit over the same rows is the beginning of another, so the least joined audit is made of the least parts.

Nulls: a null role or text is one blank; null turns come first; a null conv_id is a conversation of its own. Rows with
one turn go by role, then text. Repeated rows are duplicates. Empty tables give no rows. Very long texts and
conversations are held chunk by chunk (CHUNK_BYTES); only the audit itself, a letter a row, is one value. Columns other
than conv_id, turn, role, text are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from eventloom.llm.common import BLANK, stage

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: Rows of a conversation, and bytes of their texts, that are aligned at a time.
CHUNK_ROWS, CHUNK_BYTES = 256, 1 << 23
#: States between rows: nothing yet, after system, after user, after assistant.
NOTHING, S, U, A = range(4)
#: What it takes to end in each state: nothing, or turns inserted at the end.
ENDING = {NOTHING: "", S: "II", U: "I", A: ""}

_FAR = 1 << 40
_VISIBLE = re.compile(rf"[^{BLANK}]")
_LAST = re.compile(rf"([^{BLANK}])[{BLANK}]*\Z")
_INITIALS = {"s": S, "u": U, "a": A}
_LEGAL = {"su", "ua", "au"}
_CUT, _GONE = 4, 8  # flags of a row's code beside the state its role leads to

Found = dict[tuple[int, int], tuple[int, str]]


def row_code(initial: str, fault: str | None) -> int:
    if fault in ("blank", "duplicate"):
        return _GONE
    return _INITIALS.get(initial, 0) | (_CUT if fault == "truncated" else 0)


def greedy_cost(codes: bytes) -> int:
    """The cost of one repair from left to right: an upper bound."""
    state, cost = NOTHING, 0
    for code in codes:
        if code & (_GONE | _CUT):
            cost += DELETE
        elif code == S and state == NOTHING:
            state = S
        else:
            wanted = A if state == U else U
            cost += 0 if code == wanted else REROLE
            state = wanted
    return cost + INSERT * len(ENDING[state])


class _Matrix:
    """Least costs of aligning the last i rows to the last j letters of the string that ends with the letter `last`."""

    def __init__(self, codes: bytes, last: int, trailing: bool, bound: int):
        self.codes, self.last, n = codes[::-1], last, len(codes)
        self.width = n + bound // INSERT + 1
        at = np.arange(self.width)
        self.plain = np.full((n + 1, self.width), _FAR, dtype=np.int64)
        self.system = np.full((n + 1, self.width), _FAR, dtype=np.int64)  # with an s before the letters
        self.plain[0, 0] = 0
        if trailing:
            self.plain[0] = INSERT * at
        odd = (at[1:] % 2 == 1).astype(np.int64)
        for i, code in enumerate(self.codes, 1):
            low, high = max(0, i - bound // DELETE), min(self.width, i + bound // INSERT + 1)
            before, row = self.plain[i - 1], self.plain[i]
            row[low:high] = before[low:high] + DELETE
            if not code & _GONE:
                here = self._kept(code)
                first = max(low, 1)
                costs = np.where(odd[first - 1 : high - 1], here[0], here[1])
                np.minimum(row[first:high], before[first - 1 : high - 1] + costs, out=row[first:high])
                if code & 3 == S:
                    self.system[i] = before + (TRUNCATED if code & _CUT else 0)
            steps = INSERT * at[low:high]
            row[low:high] = np.minimum.accumulate(row[low:high] - steps) + steps
            np.minimum(self.system[i], self.system[i - 1] + DELETE, out=self.system[i])

    def _kept(self, code: int) -> tuple[int, int]:
        """Costs of a row that stays as an odd or an even letter from the end."""
        more = TRUNCATED if code & _CUT else 0
        other = U if self.last == A else A
        return tuple(more + (0 if code & 3 == letter else REROLE) for letter in (self.last, other))

    def lengths(self, parity: int, system: bool) -> list[tuple[int, int]]:
        """(cost, length) of every feasible length of at least one letter with this parity, after an s or not."""
        row = (self.system if system else self.plain)[-1]
        return [(int(row[j]), j) for j in range(2 - parity, self.width, 2) if row[j] < _FAR]

    def trace(self, j: int, system: bool) -> str:
        """The least audit of the alignment to j letters."""
        i, letters = len(self.codes), []
        while system:
            value = self.system[i, j]
            if i > 1 and self.system[i - 1, j] + DELETE == value:
                letters.append("D")
            else:
                letters.append("K")
                system = False
            i -= 1
        while i or j:
            value = self.plain[i, j]
            if i and self.plain[i - 1, j] + DELETE == value:
                letters.append("D")
                i -= 1
            elif j and self.plain[i, j - 1] + INSERT == value:
                letters.append("I")
                j -= 1
            else:
                code = self.codes[i - 1]
                letter = self.last if j % 2 else (U if self.last == A else A)
                letters.append("K" if code & 3 == letter else "R")
                i, j = i - 1, j - 1
        return "".join(letters)


def _least(matrix: _Matrix, parities: list[tuple[int, bool]], deleted: bool) -> tuple[int, str] | None:
    """(cost, audit) over all feasible lengths; `deleted`: no letter at all is feasible as well."""
    options = [(cost, j, system) for parity, system in parities for cost, j in matrix.lengths(parity, system)]
    if deleted:
        options.append((DELETE * len(matrix.codes), 0, False))
    if not options:
        return None
    cost = min(options)[0]
    return cost, min(matrix.trace(j, system) if j else "D" * len(matrix.codes) for c, j, system in options if c == cost)


class Aligner:
    """Alignments by the codes of rows, remembered."""

    def __init__(self, limit: int = 1 << 15):
        self.limit, self.wholes, self.chunks = limit, {}, {}

    def whole(self, codes: bytes) -> tuple[int, str]:
        """(cost, audit) of a whole conversation."""
        found = self.wholes.get(codes)
        if found is None:
            matrix = _Matrix(codes, A, True, greedy_cost(codes))
            found = _least(matrix, [(0, False), (0, True)], True)
            if len(self.wholes) < self.limit:
                self.wholes[codes] = found
        return found

    def chunk(self, codes: bytes) -> Found:
        """(cost, audit) by (state before, state after) of a piece of a conversation; an insertion precedes a row."""
        found = self.chunks.get(codes)
        if found is None:
            found = _chunk(codes)
            if len(self.chunks) < self.limit >> 6:
                self.chunks[codes] = found
        return found


def _chunk(codes: bytes) -> Found:
    n = len(codes)
    bound = DELETE * n + 2 * INSERT + TRUNCATED + REROLE  # one row stays, the others go: feasible where anything is
    to_u, to_a = _Matrix(codes, U, False, bound), _Matrix(codes, A, False, bound)
    gone = (DELETE * n, "D" * n)
    found: Found = {(s, s): gone for s in (NOTHING, S)}
    if (kept := int(to_u.system[-1, 0])) < _FAR:
        found[NOTHING, S] = (kept, to_u.trace(0, True))
    for before in range(4):
        plain = 0 if before == U else 1  # parity of the letters up to a u
        system = [(1, True)] if before == NOTHING else []
        found[before, U] = _least(to_u, [(plain, False), *system], before == U)
        system = [(0, True)] if before == NOTHING else []
        found[before, A] = _least(to_a, [(1 - plain, False), *system], before == A)
    return {k: v for k, v in found.items() if v is not None}


def repaired(audit: str, roles: list[str], texts: list[str], state: int = NOTHING) -> tuple[list[tuple[str, str]], int]:
    """The turns that an audit leaves of rows, and the state after them."""
    turns, i = [], 0
    for letter in audit:
        wanted = A if state == U else U
        name = "assistant" if wanted == A else "user"
        if letter == "I":
            turns.append((name, ""))
            state = wanted
            continue
        if letter == "K":
            turns.append((roles[i], texts[i]))
            state = _INITIALS[roles[i][:1]]
        elif letter == "R":
            turns.append((name, texts[i]))
            state = wanted
        i += 1
    return turns, state


def _lines(turns: list[tuple[str, str]]) -> str | None:
    return "\n".join(f"{role}:{text}" for role, text in turns) if turns else None


# --- the stream of rows -------------------------------------------------------------------------------------------

_COUNTS = "rows BIGINT, blank BIGINT, duplicate BIGINT, truncated BIGINT, illegal BIGINT, turns BIGINT, low BIGINT, high BIGINT"
_PIECE = (
    f"part INT, seq BIGINT, whole BOOLEAN, {_COUNTS}, first_turn BIGINT, last_turn BIGINT, first_initial STRING, "
    "last_initial STRING, cost BIGINT, audit STRING, lines STRING, pairs ARRAY<INT>, costs ARRAY<BIGINT>, "
    "audits ARRAY<STRING>, roles ARRAY<STRING>, texts ARRAY<STRING>"
)


class _Piece:
    """Rows of one conversation, in order, up to a chunk."""

    def __init__(self, conv, seq: int):
        self.conv, self.seq, self.size = conv, seq, 0
        self.roles, self.texts, self.faults, self.stamps = [], [], [], []

    def add(self, turn, role: str, text: str, repeated: bool):
        if not _VISIBLE.search(text):
            fault = "blank"
        elif repeated:
            fault = "duplicate"
        else:
            fault = None if _LAST.search(text).group(1) in ".!?" else "truncated"
        for held, value in ((self.roles, role), (self.texts, text), (self.faults, fault), (self.stamps, turn)):
            held.append(value)
        self.size += len(text)

    def full(self, rows: int) -> bool:
        return len(self.roles) >= rows or self.size >= CHUNK_BYTES

    def record(self, part: int, whole: bool, aligner: Aligner) -> dict:
        initials = [r[:1] for r in self.roles]
        codes = bytes(map(row_code, initials, self.faults))
        known = [t for t in self.stamps if t is not None]
        row = {
            "conv_id": self.conv, "part": part, "seq": self.seq, "whole": whole, "rows": len(codes),
            **{fault: self.faults.count(fault) for fault in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])),
            "turns": len(set(known)), "low": min(known, default=None), "high": max(known, default=None),
            "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None,
            "first_initial": initials[0] if initials else None, "last_initial": initials[-1] if initials else None,
        }
        if whole:
            cost, audit = aligner.whole(codes)
            turns, _ = repaired(audit, self.roles, self.texts)
            return row | {"cost": cost, "audit": audit, "lines": _lines(turns)}
        found = aligner.chunk(codes)
        return row | {
            "pairs": [4 * a + b for a, b in found], "costs": [c for c, _ in found.values()],
            "audits": [x for _, x in found.values()], "roles": self.roles, "texts": self.texts,
        }


def _pieces(kind: pa.Schema, chunk_rows: int) -> Callable:
    """Sorted rows (conv_id, turn, role, text, present, first_turn, known) to pieces of conversations."""

    def run(batches):
        part, aligner, nothing = TaskContext.get().partitionId(), Aligner(), object()
        piece, before, seen, edge = None, nothing, nothing, True
        for batch in batches:
            done = []
            for conv, turn, role, text, present, first, known in zip(*[c.to_pylist() for c in batch.columns]):
                if piece is None or conv != piece.conv:
                    if piece is not None:
                        done.append(piece.record(part, not edge and piece.seq == 0, aligner))
                        edge = False
                    piece, seen = _Piece(conv, 0), nothing
                elif piece.full(chunk_rows):
                    done.append(piece.record(part, False, aligner))
                    piece = _Piece(conv, piece.seq + 1)
                if not present:
                    continue
                later = known and turn is not None and (first is None or turn > first)
                piece.add(turn, role, text, later or (turn, role, text) == seen)
                seen = (turn, role, text)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=kind)
        if piece is not None:
            yield pa.RecordBatch.from_pylist([piece.record(part, False, aligner)], schema=kind)

    return run


def _streamed(df: DataFrame, order: list[Column], fields: StructType, fold: Callable[[object], Callable[[dict], Iterator[dict]]]) -> DataFrame:
    """Rows of each conv_id in order through a fold: `fold(conv)` gives a function of a row (None at the end) to rows."""
    kind = to_arrow_schema(fields)

    def run(batches):
        conv, step = None, None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if step is None or row["conv_id"] != conv:
                    if step is not None:
                        done.extend(step(None))
                    conv = row["conv_id"]
                    step = fold(conv)
                done.extend(step(row))
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=kind)
        if step is not None and (done := list(step(None))):
            yield pa.RecordBatch.from_pylist(done, schema=kind)

    return df.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, fields)


def _backwards(conv):
    """Adds what the rest of the conversation costs by the state after a chunk."""
    rest = [INSERT * len(ENDING[s]) for s in range(4)]

    def step(row):
        nonlocal rest
        if row is None:
            return
        yield row | {"rest": rest}
        new = [_FAR] * 4
        for pair, cost in zip(row["pairs"], row["costs"]):
            new[pair // 4] = min(new[pair // 4], cost + rest[pair % 4])
        rest = new

    return step


def _forwards(conv):
    """Chooses the states before and after each chunk: the least cost, then the least audit."""
    state = NOTHING

    def step(row):
        nonlocal state
        if row is None:
            return
        chosen = min(
            (cost + row["rest"][pair % 4], rank, k)
            for k, (pair, cost, rank) in enumerate(zip(row["pairs"], row["costs"], row["ranks"]))
            if pair // 4 == state
        )[2]
        before, state = state, row["pairs"][chosen] % 4
        yield {"conv_id": row["conv_id"], "part": row["part"], "seq": row["seq"], "chosen": chosen, "before": before, "after": state}

    return step


def _joined(conv):
    """The chunks of a conversation to its one result."""
    total = dict.fromkeys(("rows", "blank", "duplicate", "truncated", "illegal", "turns", "cost"), 0)
    audit, digest, low, high, stamp, initial, state, written = [], hashlib.sha256(), None, None, None, None, NOTHING, False

    def write(lines: str | None):
        nonlocal written
        if lines is not None:
            digest.update(("\n" + lines if written else lines).encode())
            written = True

    def step(row):
        nonlocal low, high, stamp, initial, state
        if row is not None:
            for name in total:
                total[name] += row[name]
            if row["rows"]:
                if initial is not None:
                    total["illegal"] += initial + row["first_initial"] not in _LEGAL
                initial = row["last_initial"]
            if row["low"] is not None:
                total["turns"] -= stamp is not None and stamp == row["first_turn"]
                low, high, stamp = (row["low"] if low is None else low), row["high"], row["last_turn"]
            audit.append(row["audit"])
            write(row["lines"])
            state = row["after"]
            return
        ending = ENDING[state]
        audit.append(ending)
        write(_lines(repaired(ending, [], [], state)[0]))
        yield {
            "conv_id": conv, **total, "cost": total["cost"] + INSERT * len(ending), "low": low, "high": high,
            "audit": "".join(audit), "repaired_sha256": digest.hexdigest(),
        }

    return step


def audits(turns: DataFrame, present: Column | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    `turns` has conv_id, turn, role, text; rows where `present` is false only say that their conversation exists.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    there = F.coalesce(present if present is not None else F.lit(True), F.lit(False))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"), there.alias("present"))
    rows = stage(rows, "turns")
    # where role and text repeat within a conversation: the turn that has them first, told apart by 128 bits
    marks = [F.xxhash64("role", "text").alias("mark"), F.xxhash64(F.lit(1), "text", "role").alias("mark2")]
    marked = rows.select("*", *marks)
    repeats = marked.filter("present").groupBy("conv_id", "mark", "mark2").agg(F.count("*").alias("n"), F.min(F.struct("turn")).alias("first"))
    repeats = repeats.filter("n > 1").select(
        F.col("conv_id").alias("c"), F.col("mark").alias("m"), F.col("mark2").alias("m2"), F.col("first.turn").alias("first_turn"), F.lit(True).alias("known")
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("mark") == F.col("m")) & (F.col("mark2") == F.col("m2"))
    found = marked.join(repeats, same, "left").select("conv_id", "turn", "role", "text", "present", "first_turn", F.coalesce("known", F.lit(False)).alias("known"))
    ordered = found.repartitionByRange("conv_id", "turn", "role").sortWithinPartitions("conv_id", "turn", "role", "text")

    conv = StructField("conv_id", turns.schema["conv_id"].dataType)
    fields = lambda ddl: StructType([conv, *StructType.fromDDL(ddl).fields])
    piece = fields(_PIECE)
    pieces = stage(ordered.mapInArrow(_pieces(to_arrow_schema(piece), chunk_rows), piece), "pieces")
    columns = ["conv_id", "rows", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "cost", "audit"]
    whole = pieces.filter("whole").select(*columns, F.sha2(F.coalesce("lines", F.lit("")), 256).alias("repaired_sha256"))

    # the order of a chunk's audits stands for them
    chunks = pieces.filter("NOT whole")
    ranks = F.transform("audits", lambda x: F.array_position(F.array_sort("audits"), x))
    numbers = chunks.select("conv_id", "part", "seq", "pairs", "costs", ranks.cast("array<int>").alias("ranks"))
    key = "part INT, seq BIGINT"
    numeric = fields(f"{key}, pairs ARRAY<INT>, costs ARRAY<BIGINT>, ranks ARRAY<INT>, rest ARRAY<BIGINT>")
    down = [F.col("conv_id"), F.desc("part"), F.desc("seq")]
    up = [F.col("conv_id"), F.col("part"), F.col("seq")]
    rest = _streamed(numbers, down, numeric, _backwards)
    chosen = _streamed(rest, up, fields(f"{key}, chosen INT, before INT, after INT"), _forwards)
    chosen = stage(chosen, "states").select(*[F.col(c).alias(f"{c}_") for c in ("conv_id", "part", "seq")], "chosen", "before", "after")
    same = F.col("conv_id").eqNullSafe(F.col("conv_id_")) & (F.col("part") == F.col("part_")) & (F.col("seq") == F.col("seq_"))
    met = chunks.join(chosen, same).select(
        *columns[:-2], "part", "seq", "first_turn", "last_turn", "first_initial", "last_initial", "before", "after", "roles", "texts",
        F.get("costs", "chosen").alias("cost"), F.get("audits", "chosen").alias("audit"),
    )
    written = fields(
        f"{key}, {_COUNTS}, first_turn BIGINT, last_turn BIGINT, first_initial STRING, last_initial STRING, after INT, "
        "cost BIGINT, audit STRING, lines STRING"
    )
    kind = to_arrow_schema(written)

    def write(batches):
        for batch in batches:
            done = [r | {"lines": _lines(repaired(r["audit"], r["roles"], r["texts"], r["before"])[0])} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist([{name: r[name] for name in kind.names} for r in done], schema=kind)

    result = fields(f"{_COUNTS}, cost BIGINT, audit STRING, repaired_sha256 STRING")
    parts = _streamed(met.mapInArrow(write, written), up, result, _joined).select(*columns, "repaired_sha256")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    return whole.unionByName(parts).select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present of conversations that are damaged by the crc32 of `conv_id:turn`, modulo 20.

    0: the row goes (not present), 1: empty text, 2: no sentence ends, 3: twice, 4: role user; nulls count as one blank.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") <= 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("fate") != 0).alias("present"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1))).alias("nth"),
    ).drop("nth")
