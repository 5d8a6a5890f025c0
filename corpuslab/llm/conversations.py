"""Conversation structure repair by Hirschberg's divide and conquer.

A repaired conversation's role initials are ``(s?(ua)+)?``: four states (start, after s, after u, after a).
Edits, in this order of letters: Delete 3, Insert 2 (an empty user or assistant turn), Keep 0, Rerole 2; a truncated
row that stays costs 1 more. Of the cheapest audits (one letter an edit) the least by ASCII is wanted.

A forward vector holds, for each state at a row boundary, the least cost of a path from the left and the rank of
that path's least audit among the four; paths end with a row's letter, so no audit is a prefix of another and ranks
are strict. A backward vector holds the least cost to the right end. Where they meet, the crossing of least sum and
then least rank is on the wanted path, and both halves are solved alike, in linear space.

Spark does the same over tasks: rows are sorted by ranges, so that a conversation of any length is spread, and
each block of at most ``BLOCK`` rows becomes a 4 x 4 matrix of costs and ranks; the crossings between a
conversation's blocks are chosen from the matrices, and each block is then solved alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StringType, StructField, StructType

from corpuslab.llm.common import partitions
from corpuslab.session import stage

BLOCK = 4096
SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)  # states; a row's class is its role's initial: 1 s, 2 u, 3 a, 0 another
OK, BLANK, DUPLICATE, TRUNCATED = 0, 4, 8, 12  # a code is class + fault
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
INF = 1 << 60
_NEXT = (USER, USER, ASSISTANT, USER)  # the state after an inserted or re-roled turn
_KEEP = {(START, SYSTEM): SYSTEM, (START, USER): USER, (SYSTEM, USER): USER, (USER, ASSISTANT): ASSISTANT, (ASSISTANT, USER): USER}
_LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
_END = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))  # inserts after the last row, by state
_NAMES = {USER: "user", ASSISTANT: "assistant"}


def _edits(code: int) -> dict[tuple[int, int], tuple[int, str]]:
    """By (state before, state after) a row: the cheapest edits that take it, inserts before it included."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    kind, fault = code % 4, code - code % 4
    for p in range(4):
        ways = [(p, DELETE, "D")]  # an insert before a Delete is the same as one after it, and later by ASCII
        state = p
        for inserts in range(3 if fault in (OK, TRUNCATED) else 0):
            cost = inserts * INSERT + (CUT if fault == TRUNCATED else 0)
            if (state, kind) in _KEEP:
                ways.append((_KEEP[state, kind], cost, "I" * inserts + "K"))
            ways.append((_NEXT[state], cost + REROLE, "I" * inserts + "R"))
            state = _NEXT[state]
        for q, cost, letters in ways:
            best[p, q] = min(best.get((p, q), (INF, "")), (cost, letters))
    return best


EDITS = [_edits(code) for code in range(16)]


def _ranks(keys: list) -> tuple[int, ...]:
    return tuple(sorted(keys).index(k) for k in keys)


@lru_cache(maxsize=1 << 14)
def _forward_step(vector: tuple, code: int) -> tuple[tuple, int]:
    """The vector (costs above their least, ranks) after a row, and by how much the least cost rises."""
    costs, ranks = vector
    new: list = [(INF, 9, "")] * 4
    for (p, q), (cost, letters) in EDITS[code].items():
        if costs[p] < INF:
            new[q] = min(new[q], (costs[p] + cost, ranks[p], letters))
    low = min(new)[0]
    return (tuple(min(x[0] - low, INF) if x[0] < INF else INF for x in new), _ranks([x[1:] for x in new])), low


@lru_cache(maxsize=1 << 14)
def _backward_step(costs: tuple, code: int) -> tuple[tuple, int]:
    new = [INF] * 4
    for (p, q), (cost, _) in EDITS[code].items():
        if costs[q] < INF:
            new[p] = min(new[p], costs[q] + cost)
    low = min(new)
    return tuple(x - low if x < INF else INF for x in new), low


def _unit(p: int) -> tuple[int, ...]:
    return tuple(0 if i == p else INF for i in range(4))


def forward(codes: bytes, p: int) -> tuple[list[int], tuple[int, ...]]:
    vector, total = (_unit(p), (0, 0, 0, 0)), 0
    for code in codes:
        vector, rise = _forward_step(vector, code)
        total += rise
    return [c + total if c < INF else INF for c in vector[0]], vector[1]


def backward(codes: bytes, q: int) -> list[int]:
    """Costs to reach state q at the end, by state before ``codes``, above a common base."""
    costs = _unit(q)
    for code in reversed(codes):
        costs, _ = _backward_step(costs, code)
    return list(costs)


def _crossing(costs: list[int], ranks: tuple[int, ...], rest: list[int]) -> int:
    return min((costs[s] + rest[s], ranks[s], s) for s in range(4) if costs[s] < INF and rest[s] < INF)[2]


def solve(codes: bytes, p: int, q: int) -> str:
    """The least of the cheapest audits of ``codes`` from state p to state q."""
    return _solve_short(codes, p, q) if len(codes) <= 32 else _solve(codes, p, q)


def _solve(codes: bytes, p: int, q: int) -> str:
    if not codes:
        return ""
    if len(codes) == 1:
        return EDITS[codes[0]][p, q][1]
    mid = len(codes) // 2
    s = _crossing(*forward(codes[:mid], p), backward(codes[mid:], q))
    return solve(codes[:mid], p, s) + solve(codes[mid:], s, q)


@lru_cache(maxsize=1 << 15)
def _solve_short(codes: bytes, p: int, q: int) -> str:
    return _solve(codes, p, q)


@lru_cache(maxsize=1 << 12)
def matrix(codes: bytes) -> tuple[list[int], list[int]]:
    """16 costs and 16 ranks, by state before and state after."""
    rows = [forward(codes, p) for p in range(4)]
    return [c for r in rows for c in r[0]], [k for r in rows for k in r[1]]


def cross_blocks(blocks: list[tuple[list[int], list[int]]]) -> tuple[list[int], int]:
    """States before, between and after a conversation's blocks on the wanted path, and its cost."""

    def ahead(lo: int, hi: int, p: int) -> tuple[list[int], tuple[int, ...]]:
        costs, ranks = list(_unit(p)), (0, 0, 0, 0)
        for c, r in blocks[lo:hi]:
            new = [min((costs[p] + c[4 * p + q], ranks[p], r[4 * p + q]) for p in range(4)) for q in range(4)]
            costs, ranks = [min(x[0], INF) for x in new], _ranks([x[1:] for x in new])
        return costs, ranks

    def behind(lo: int, hi: int, q: int) -> list[int]:
        costs = list(_unit(q))
        for c, _ in reversed(blocks[lo:hi]):
            costs = [min(INF, *(c[4 * p + q] + costs[q] for q in range(4))) for p in range(4)]
        return costs

    costs, ranks = ahead(0, len(blocks), START)
    ends = [e[0] for e in _END]
    last = _crossing(costs, ranks, ends)
    states = [START] * len(blocks) + [last]
    todo = [(0, len(blocks))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo > 1:
            mid = (lo + hi) // 2
            states[mid] = _crossing(*ahead(lo, mid, states[lo]), behind(mid, hi, states[hi]))
            todo += [(lo, mid), (mid, hi)]
    return states, costs[last] + ends[last]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """Rows come sorted by conversation; one list a batch and conversation, the first column as the key."""
    for b in batches:
        rows = list(zip(*(c.to_pylist() for c in b.columns)))
        i = 0
        while i < len(rows):
            k = i
            while k < len(rows) and rows[k][0] == rows[i][0]:
                k += 1
            yield rows[i][0], rows[i:k]
            i = k


def _blocks(batches: Iterator[pa.RecordBatch], block: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(conv, code, n) to blocks of codes. Of n equal rows the others are duplicates, or blank."""
    part, seq, out, held, owner = TaskContext.get().partitionId(), 0, [], bytearray(), None

    def close() -> None:
        nonlocal seq
        if held:
            codes = bytes(held)
            kinds = [c % 4 for c in codes]
            faults = [sum(c - c % 4 == f for c in codes) for f in (BLANK, DUPLICATE, TRUNCATED)]
            illegal = sum(x not in _LEGAL for x in zip(kinds, kinds[1:]))
            out.append((owner, part, seq, codes, *matrix(codes), kinds[0], kinds[-1], illegal, *faults))
            seq += 1
            held.clear()

    def ready() -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 12, types)], names=_BLOCK_NAMES)
        out.clear()
        return batch

    types = [kind, pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.int64()] * 6]
    for conv, rows in _segments(batches):
        if conv != owner:
            close()
            owner = conv
        for _, code, n in rows:
            more = code if code & 12 == BLANK else code % 4 + DUPLICATE
            held.append(code)
            n -= 1
            while n or len(held) >= block:
                if len(held) >= block:
                    close()
                    if len(out) >= 512:
                        yield ready()
                take = min(n, block - len(held))
                held.extend(bytes([more]) * take)
                n -= take
        if len(out) >= 512:
            yield ready()
    close()
    yield ready()


_BLOCK_NAMES = ["conv", "part", "seq", "codes", "costs", "ranks", "first", "last", "illegal", "blank", "duplicate", "truncated"]


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, part, seq, costs, ranks, first, last) to (part, seq, p, q, tail, cost, between)."""
    owner, held = None, []

    def paths() -> list[tuple]:
        states, cost = cross_blocks([(r[3], r[4]) for r in held])
        out = []
        for i, r in enumerate(held):
            odd = i > 0 and (held[i - 1][6], r[5]) not in _LEGAL
            out.append((r[1], r[2], states[i], states[i + 1], _END[states[-1]][1] if i + 1 == len(held) else "", cost if i == 0 else 0, int(odd)))
        return out

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, types)],
                               names=["part", "seq", "p", "q", "tail", "cost", "between"])

    done: list[tuple] = []
    for conv, rows in _segments(batches):
        if held and conv != owner:
            done += paths()
            held = []
            if len(done) >= 4096:
                yield batch(done)
                done = []
        owner = conv
        held += rows
    yield batch(done + (paths() if held else []))


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        codes, p, q, tail = (b.column(i).to_pylist() for i in range(4))
        pieces = [solve(c, x, y) + t for c, x, y, t in zip(codes, p, q, tail)]
        yield pa.record_batch([pa.array(pieces, pa.string()), *b.columns[4:]], names=["piece", *b.schema.names[4:]])


def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str | None, str, str]]:
    """(conv, first, role, text) turns that a conversation keeps or gets, in order, from a stream
    (conv, is_row, role, text) in which a conversation's audit, as a text, precedes its rows. A turn of None
    as its edit opens a conversation."""
    state, audit, at = START, "", 0

    def inserts(conv: object) -> Iterator[tuple]:
        nonlocal state, at
        while at < len(audit) and audit[at] == "I":
            state, at = _NEXT[state], at + 1
            yield conv, "I", _NAMES[state], ""

    opened, owner = False, None
    for conv, rows in _segments(batches):
        for _, is_row, role, text in rows:
            if not is_row:
                if opened:
                    yield from inserts(owner)
                opened, owner, state, audit, at = True, conv, START, text, 0
                yield conv, None, "", ""
                continue
            yield from inserts(conv)
            edit, at = audit[at], at + 1
            if edit == "K":
                state = _KEEP[state, _class_of(role)]
                yield conv, "K", role, text
            elif edit == "R":
                state = _NEXT[state]
                yield conv, "R", _NAMES[state], text
    if opened:
        yield from inserts(owner)


def _class_of(role: str) -> int:
    return {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(role[:1], 0)


def _arrow_kind(kind: DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


class Repair:
    """The repair of the conversations of ``df`` (conv_id, turn, role, text under the given names).

    Rows count by turn (a long, null first), then role, then SHA-256 of the text; a null role or text counts as one
    space; a null conv_id is a conversation like any other. Equal rows are repeats, of which the first stays.
    Blank, duplicate (role and text came before) and truncated (last character no ``[.!?]``) are told in this
    order. Other columns are ignored, and an empty table gives empty results. Nothing but an audit, which is
    one value of one row, grows with a conversation in a task: rows, blocks and texts stream.
    """

    def __init__(self, df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", block: int = BLOCK):
        self.kind, self.block = df.schema[conv_col].dataType, block
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
        self.rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).try_cast("long").alias("turn"),
                              F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"), text.alias("text"))
        self.digest = F.unhex(F.sha2("text", 256)).alias("digest")
        self.audits = stage(self._audits(), "audits")

    def _coded(self) -> DataFrame:
        """(conv, turn, role, digest, code, n) of the different rows, without their texts."""
        bare = F.rtrim("text", F.lit(SPACE))
        fault = F.when(bare == "", BLANK).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(OK)
        initial = F.substring("role", 1, 1)
        kind = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(0)
        light = self.rows.select("conv", "turn", "role", self.digest, fault.alias("fault"), kind.alias("kind"))
        self.light = stage(light.groupBy("conv", "turn", "role", "digest", "fault", "kind").agg(F.count(F.lit(1)).alias("n")), "turns")
        place = F.struct(F.col("turn").isNotNull().alias("told"), F.col("turn").alias("turn"))
        firsts = self.light.groupBy(F.col("conv").alias("conv_"), F.col("role").alias("role_"), F.col("digest").alias("digest_")).agg(F.min(place).alias("begun"))
        met = F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("role") == F.col("role_")) & (F.col("digest") == F.col("digest_"))
        code = F.when((F.col("fault") != BLANK) & (place > F.col("begun")), F.lit(DUPLICATE)).otherwise(F.col("fault")) + F.col("kind")
        return self.light.join(firsts, met).select("conv", "turn", "role", "digest", code.cast("int").alias("code"), "n")

    def _audits(self) -> DataFrame:
        order, block, kind = ["conv", "turn", "role", "digest"], self.block, _arrow_kind(self.kind)
        coded = self._coded()
        ranged = coded.repartitionByRange(partitions(coded), *order).sortWithinPartitions(*order).select("conv", "code", "n")
        schema = StructType([StructField("conv", self.kind), *StructType.fromDDL(
            "part int, seq long, codes binary, costs array<long>, ranks array<int>, first long, last long, illegal long, blank long, duplicate long, truncated long").fields])
        blocks = stage(ranged.mapInArrow(lambda b: _blocks(b, block, kind), schema), "blocks")
        sorted_blocks = blocks.select("conv", "part", "seq", "costs", "ranks", "first", "last").repartition("conv").sortWithinPartitions("conv", "part", "seq")
        crossed = sorted_blocks.mapInArrow(_cross, "part int, seq long, p int, q int, tail string, cost long, between long")
        sums = ["cost", "illegal", "blank", "duplicate", "truncated"]
        both = blocks.join(crossed, ["part", "seq"]).select(
            "codes", "p", "q", "tail", "conv", "part", "seq", "cost", (F.col("illegal") + F.col("between")).alias("illegal"), *sums[2:])
        pieces = both.mapInArrow(_letters, StructType([StructField("piece", StringType()), StructField("conv", self.kind), *both.schema.fields[5:]]))
        audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "seq", "piece"))), lambda x: x["piece"]), "")
        return pieces.groupBy("conv").agg(audit.alias("audit"), *(F.sum(c).alias(c) for c in sums))

    def _stream(self) -> DataFrame:
        """A conversation's audit, then its rows, in order, in one task a conversation."""
        rows = self.rows.select("conv", F.lit(True).alias("is_row"), "turn", "role", self.digest, "text")
        audits = self.audits.select("conv", F.lit(False).alias("is_row"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                                    F.lit(b"").alias("digest"), F.col("audit").alias("text"))
        dealt = rows.unionByName(audits).repartition(partitions(rows), "conv")
        return dealt.sortWithinPartitions("conv", "is_row", "turn", "role", "digest").select("conv", "is_row", "role", "text")

    def turns(self) -> DataFrame:
        """(conv_id, place, edit, role, text) of the repaired conversations; place counts from 0, edit is K, R or I."""
        kind = _arrow_kind(self.kind)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            types = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
            names, out, place = ["conv_id", "place", "edit", "role", "text"], [], 0
            for conv, edit, role, text in replay(batches):
                if edit is None:
                    place = 0
                    continue
                out.append((conv, place, edit, role, text))
                place += 1
                if len(out) >= 512:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out = []
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        return self._stream().mapInArrow(run, StructType([StructField("conv_id", self.kind), StructField("place", LongType()), *(
            StructField(c, StringType()) for c in ("edit", "role", "text"))]))

    def digests(self) -> DataFrame:
        """(conv, repaired_sha256) of the repaired turns as ``role:text``, newline-joined."""
        kind = _arrow_kind(self.kind)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            hashed, owner, n = None, None, 0

            def batch() -> pa.RecordBatch:
                made = pa.record_batch([pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out], pa.string())], names=["conv", "repaired_sha256"])
                out.clear()
                return made

            for conv, edit, role, text in replay(batches):
                if edit is None:
                    if hashed:
                        out.append((owner, hashed.hexdigest()))
                        if len(out) >= 4096:
                            yield batch()
                    hashed, owner, n = hashlib.sha256(), conv, 0
                    continue
                hashed.update(f"{chr(10) if n else ''}{role}:{text}".encode())
                n += 1
            if hashed:
                out.append((owner, hashed.hexdigest()))
            yield batch()

        return self._stream().mapInArrow(run, StructType([StructField("conv", self.kind), StructField("repaired_sha256", StringType())]))

    def report(self, conversations: DataFrame | None = None) -> DataFrame:
        """One row a conversation: conv_id, gaps (turns missing between the least and the greatest), blank, duplicate,
        truncated, illegal, cost, audit, repaired_sha256. ``conversations`` (conv_id) may name more, which get
        zeros, an empty audit and the hash of nothing."""
        turns = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
        parts = [self.light.groupBy("conv").agg(F.coalesce(turns, F.lit(0)).alias("gaps")), self.audits, self.digests()]
        if conversations is not None:
            parts.append(conversations.select(F.col(conversations.columns[0]).alias("conv")).distinct())
        joined = parts[0]
        for p in parts[1:]:
            joined = joined.unionByName(p, allowMissingColumns=True)
        numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
        nothing = hashlib.sha256().hexdigest()
        return joined.groupBy(F.col("conv").alias("conv_id")).agg(
            *(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers),
            F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
            F.coalesce(F.max("repaired_sha256"), F.lit(nothing)).alias("repaired_sha256"))
