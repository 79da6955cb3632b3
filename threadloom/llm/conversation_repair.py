"""Cheapest repair of conversation structure, by run-length dynamic programming.

The rows of a conversation, by turn (nulls first, ties by role, then text), are
edited so that the initials of their roles read ``(s?(ua)+)?``: Keep costs 0,
Rerole to user or assistant 1, Delete 2 (required for blank and duplicate rows),
Insert an empty-text user or assistant anywhere 5; a truncated row that stays
adds 5. Of the cheapest edits the ASCII-least initials (D, I, K, R) are taken.

A row is one of nine symbols (must go; or one of four roles, whole or
truncated), and the wanted roles have four states. A symbol's step is a 4 x 4
matrix over (min, +) with the inserts before the row in it. Equal consecutive
symbols are one run; a run of n rows takes the cached powers of two of its
matrix that make up n. Costs to go are known at the ends of runs; inside a run
the choices are unrolled by halving, so nothing is held per row but its letter.

On Spark: equal rows become one row with a count, repeats at later turns are
found by an aggregate over text hashes, and rows are dealt by range of
(conversation, turn, ...), so that a conversation of any length is cut over
tasks. Each task sends runs and counts, not texts; the pieces of a conversation
are put together and solved, and a last sorted pass streams texts past the
audit. That pass alone sees a conversation whole, row by row, as the digest of its
text is one chain; it holds the audit, one letter per row, which is a result
column.

Null roles and texts are one blank; null turns count for order, not for gaps; a null
conv_id is one conversation. An empty role, and any but s, u and a, can only be
reroled or deleted. Repeated rows are duplicates. Listed conversations without rows
have zeros, an empty audit and the digest of an empty text. Empty tables give
empty results, and columns of other names are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.session import Scratch, parallelism

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
_BLANKS = " \t\n\x0b\x0c\r"
_NEVER = 1 << 60
#: States: nothing yet, after s, after u, after a; where an inserted or reroled row leads.
_NEXT = (2, 2, 3, 2)
_ACCEPTED = (True, False, False, True)
#: Roles s, u, a, other: where a kept row leads from each state.
_KEPT = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
_LEGAL = {(0, 1), (1, 2), (2, 1)}
MUST_GO = 0
_UNROLLED = 64


# --- one conversation as runs --------------------------------------------------


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None]).min(axis=1), _NEVER)


def _inserts() -> np.ndarray:
    """Cost to get from state to state by inserts alone."""
    one = np.full((4, 4), _NEVER)
    np.fill_diagonal(one, 0)
    for s, t in enumerate(_NEXT):
        one[s, t] = INSERT
    return _times(_times(one, one), one)


_INSERTS = _inserts()
#: Cost to go after the last row.
END = np.array([min(_INSERTS[s, t] for t in range(4) if _ACCEPTED[t]) for s in range(4)])


def options(symbol: int) -> list[dict[str, tuple[int, int]]]:
    """For each state, letter -> (cost, next state) of the edits that use up a row."""
    out = []
    role, extra = divmod(symbol - 1, 2)
    for s in range(4):
        found = {"D": (DELETE, s)}
        if symbol != MUST_GO:
            if s in _KEPT[role]:
                found["K"] = (KEEP + TRUNCATED * extra, _KEPT[role][s])
            found["R"] = (REROLE + TRUNCATED * extra, _NEXT[s])
        out.append(found)
    return out


_OPTIONS = [options(symbol) for symbol in range(9)]


def _step(symbol: int) -> np.ndarray:
    row = np.full((4, 4), _NEVER)
    for s, found in enumerate(_OPTIONS[symbol]):
        for cost, t in found.values():
            row[s, t] = min(row[s, t], cost)
    return _times(_INSERTS, row)


_POWERS: list[list[np.ndarray]] = [[_step(symbol)] for symbol in range(9)]


def _power(symbol: int, k: int) -> np.ndarray:
    """The step matrix of 2**k rows of a symbol."""
    known = _POWERS[symbol]
    while len(known) <= k:
        known.append(_times(known[-1], known[-1]))
    return known[k]


def before(symbol: int, n: int, after: np.ndarray) -> np.ndarray:
    """Costs to go ahead of ``n`` rows of a symbol, given those behind them."""
    k = 0
    while n:
        if n & 1:
            after = (_power(symbol, k) + after).min(axis=1)
        n, k = n >> 1, k + 1
    return after


def _unrolled(symbol: int, n: int, state: int, after: np.ndarray, letters: list[str]) -> int:
    """Append the least letters of ``n`` rows of a symbol; the state behind them."""
    while n > _UNROLLED:
        half = 1 << (n - 1).bit_length() - 1
        state = _unrolled(symbol, n - half, state, before(symbol, half, after), letters)
        n = half
    togo = [after.tolist()]
    for _ in range(n):
        togo.append(before(symbol, 1, np.array(togo[-1])).tolist())
    found = _OPTIONS[symbol]
    for left in range(n, 0, -1):
        while True:
            want, then = togo[left][state], togo[left - 1]
            if DELETE + then[state] == want:
                letters.append("D")
                break
            if INSERT + togo[left][_NEXT[state]] == want:
                letters.append("I")
                state = _NEXT[state]
                continue
            letter = next(x for x in "KR" if x in found[state] and found[state][x][0] + then[found[state][x][1]] == want)
            letters.append(letter)
            state = found[state][letter][1]
            break
    return state


def solve(symbols: list[int], counts: list[int]) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of runs of symbols."""
    behind = [END]
    for symbol, n in zip(reversed(symbols), reversed(counts), strict=True):
        behind.append(before(symbol, n, behind[-1]))
    cost, state, letters = int(behind.pop()[0]), 0, []
    for symbol, n in zip(symbols, counts, strict=True):
        state = _unrolled(symbol, n, state, behind.pop(), letters)
    while not _ACCEPTED[state]:
        letters.append("I")
        state = _NEXT[state]
    return cost, "".join(letters)


def collapse(symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal consecutive symbols, empty ones left out."""
    symbols, counts = symbols[counts > 0], counts[counts > 0]
    if not len(symbols):
        return symbols, counts
    starts = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
    return symbols[starts], np.add.reduceat(counts, starts)


# --- streams of sorted rows ------------------------------------------------------


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, int | None, pa.RecordBatch]]:
    """Runs of rows of one conversation, and whether each begins a conversation."""
    last: tuple = ()
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(0)
        known = np.asarray(column.is_valid())
        ids = np.asarray(column.fill_null(0))
        cuts = np.flatnonzero((ids[1:] != ids[:-1]) | (known[1:] != known[:-1])) + 1
        for begin, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            conv = int(ids[begin]) if known[begin] else None
            yield (conv,) != last, conv, batch.slice(begin, end - begin)
            last = (conv,)


def _batched(rows: Iterator[dict], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


class _Piece:
    """What a task knows of one conversation: runs, counts and both ends."""

    def __init__(self, conv: int | None, number: int) -> None:
        self.row = {"conv_id": conv, "piece": number, "rows": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0}
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, batch: pa.RecordBatch) -> None:
        """Rows (conv_id, mark, turn, role, fault, copies); mark 0 only lists the conversation."""
        real = np.asarray(batch.column(1)) == 1
        if not real.any():
            return
        turn, role, fault, copies = (batch.column(k).filter(pa.array(real)) for k in range(2, 6))
        role, fault, copies = (np.asarray(c).astype(np.int64) for c in (role, fault, copies))
        row = self.row
        again = copies - 1
        row["blank"] += int(copies[fault == 1].sum())
        row["duplicate"] += int(copies[fault == 2].sum() + again[(fault == 0) | (fault == 3)].sum())
        row["truncated"] += int((fault == 3).sum())
        first = np.where((fault == 1) | (fault == 2), MUST_GO, 1 + 2 * role + (fault == 3))
        self.runs.append(collapse(np.stack([first, np.full(len(first), MUST_GO)], 1).ravel(), np.stack([np.ones(len(first), np.int64), again], 1).ravel()))
        if not row["rows"]:
            row["first_role"] = int(role[0])
        ends = np.concatenate([[row["last_role"]] if row["rows"] else [], role]).astype(int)
        pairs = ends[:-1] * 4 + ends[1:]
        row["illegal"] += int(again.sum() + (~np.isin(pairs, [a * 4 + b for a, b in _LEGAL])).sum())
        row["rows"] += int(copies.sum())
        row["last_role"] = int(role[-1])
        turn = np.asarray(turn.drop_null())
        if len(turn):
            row["turns"] += int(1 + (turn[1:] != turn[:-1]).sum() - (row.get("last_turn") == turn[0]))
            row["first_turn"] = row.get("first_turn", int(turn[0]))
            row["last_turn"] = int(turn[-1])

    def made(self) -> dict:
        if self.runs:
            symbols, counts = collapse(np.concatenate([s for s, _ in self.runs]), np.concatenate([n for _, n in self.runs]))
            self.row |= {"symbols": symbols.astype(np.int8).tobytes(), "counts": counts.astype(np.int64).tobytes()}
        return self.row


_PIECE = pa.schema(
    [(c, pa.int64()) for c in ("conv_id", "piece", "rows", "blank", "duplicate", "truncated", "illegal", "turns", "first_role", "last_role", "first_turn", "last_turn")]
    + [("symbols", pa.binary()), ("counts", pa.binary())]
)
_PIECE_SQL = ", ".join(f"{f.name} {'binary' if pa.types.is_binary(f.type) else 'long'}" for f in _PIECE)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId()

    def rows() -> Iterator[dict]:
        piece = None
        for new, conv, batch in _slices(batches):
            if new:
                if piece:
                    yield piece.made()
                piece = _Piece(conv, number)
            piece.add(batch)
        if piece:
            yield piece.made()

    yield from _batched(rows(), _PIECE)


_SOLVED = pa.schema([(c, pa.int64()) for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string())])
_SOLVED_SQL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _put_together(conv: int | None, pieces: list[dict]) -> dict:
    """The result row of a conversation from its pieces in order, stitched at their ends."""
    pieces = [p for p in pieces if p["rows"]]
    out = {"conv_id": conv} | {c: sum(p[c] for p in pieces) for c in ("blank", "duplicate", "truncated", "illegal")}
    out["illegal"] += sum((a["last_role"], b["first_role"]) not in _LEGAL for a, b in zip(pieces, pieces[1:]))
    timed = [p for p in pieces if p["turns"]]
    turns = sum(p["turns"] for p in timed) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(timed, timed[1:]))
    out["gaps"] = timed[-1]["last_turn"] - timed[0]["first_turn"] + 1 - turns if timed else 0
    symbols, counts = collapse(
        np.concatenate([np.zeros(0, np.int8), *[np.frombuffer(p["symbols"], np.int8) for p in pieces]]),
        np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(p["counts"], np.int64) for p in pieces]]),
    )
    out["cost"], out["audit"] = solve(symbols.tolist(), counts.tolist())
    return out


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        held: list[dict] = []
        for new, _, batch in _slices(batches):
            if new and held:
                yield _put_together(held[0]["conv_id"], held)
                held = []
            held += batch.to_pylist()
        if held:
            yield _put_together(held[0]["conv_id"], held)

    yield from _batched(rows(), _SOLVED)


class _Repaired:
    """Applies an audit to rows as they pass."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, 0

    def _role(self) -> str:
        self.state = _NEXT[self.state]
        return "user" if self.state == 2 else "assistant"

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._role(), ""

    def row(self, role: str, text: str, copies: int) -> Iterator[tuple[str, str]]:
        while copies:
            yield from self.inserted()
            letter = self.audit[self.at]
            if letter == "D":
                # copies go in one step
                some = min(copies, len(self.audit) - self.at)
                gone = some - len(self.audit[self.at : self.at + some].lstrip("D"))
                self.at, copies = self.at + gone, copies - gone
                continue
            self.at, copies = self.at + 1, copies - 1
            if letter == "K":
                self.state = _KEPT["sua".index(role[0])][self.state]
                yield role, text
            else:
                yield self._role(), text


_DIGEST = pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, mark, audit, role, text, copies); the one of mark 0 comes first and has the audit."""

    def rows() -> Iterator[dict]:
        open_: tuple | None = None

        def put(turns: Iterator[tuple[str, str]], sha, begun: bool) -> bool:
            for role, text in turns:
                sha.update((("\n" if begun else "") + f"{role}:{text}").encode())
                begun = True
            return begun

        def closed(open_: tuple) -> dict:
            conv, repair, sha, begun = open_
            put(repair.inserted(), sha, begun)
            return {"conv_id": conv, "audit": repair.audit, "repaired_sha256": sha.hexdigest()}

        for new, conv, batch in _slices(batches):
            if new and open_:
                yield closed(open_)
                open_ = None
            for mark, audit, role, text, copies in zip(*[batch.column(k).to_pylist() for k in range(1, 6)], strict=True):
                if mark == 0:
                    open_ = (conv, _Repaired(audit), hashlib.sha256(), False)
                else:
                    conv, repair, sha, begun = open_
                    open_ = (conv, repair, sha, put(repair.row(role, text, copies), sha, begun))
        if open_:
            yield closed(open_)

    yield from _batched(rows(), _DIGEST, 64)


# --- on Spark -----------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` as conv_id, turn, role, text, damaged by crc32(``conv_id:turn``) modulo 20."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    name = F.concat(conv, F.lit(":"), turn)
    rows = rows.withColumn("code", F.crc32(name) % 20).where("code != 0")
    code = F.col("code")
    return rows.select(
        "conv_id",
        "turn",
        F.when(code == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(code == 1, F.lit("")).when(code == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _role_class(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


def _faulted(turns: DataFrame) -> DataFrame:
    """Distinct rows with their copies and first fault: 0 none, 1 blank, 2 duplicate, 3 truncated."""
    plain = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    rows = plain.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    rows = rows.select("*", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "role", "text").alias("h2"))
    at = F.struct(F.col("turn").isNotNull().alias("timed"), "turn")
    seen = rows.groupBy("conv_id", "h1", "h2").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    again = seen.where("first != last").select("conv_id", "h1", "h2", "first").alias("s")
    left = rows.withColumn("at", at).alias("r")
    same = F.col("r.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("r.h1") == F.col("s.h1")) & (F.col("r.h2") == F.col("s.h2"))
    bare = F.btrim("r.text", F.lit(_BLANKS))
    fault = (
        F.when(bare == "", 1)
        .when(F.col("r.at") > F.col("s.first"), 2)
        .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), 3)
        .otherwise(0)
    )
    return left.join(again, same, "left").select("r.conv_id", F.lit(1).alias("mark"), "r.turn", "r.role", "r.text", "r.copies", fault.alias("fault"))


def _listed(frame: DataFrame) -> DataFrame:
    """A row of mark 0 for every conversation."""
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"))]
    ids = frame.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    return ids.select("conv_id", F.lit(0).alias("mark"), *nothing, F.lit(0).cast("long").alias("copies"), F.lit(0).alias("fault"))


ORDER = ["conv_id", "mark", "turn", "role", "text"]


def _solve_all(turns: DataFrame, listed: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The written rows, and counts, cost and audit of every conversation."""
    tables, tasks = Scratch(turns.sparkSession, "conversations"), parallelism(turns.sparkSession)
    rows = tables.table(_faulted(turns).unionByName(_listed(turns if listed is None else listed)), "rows")
    # the driver samples range keys, so of a text only a prefix is one; ties beyond it stay in one task
    ranges = rows.repartitionByRange(tasks, *ORDER[:-1], F.substring("text", 1, 16))
    sent = ranges.sortWithinPartitions(*ORDER).select(
        "conv_id", "mark", "turn", _role_class(F.col("role")).alias("role"), "fault", "copies"
    )
    pieces = tables.table(sent.mapInArrow(_pieces, _PIECE_SQL), "pieces")
    solved = pieces.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(_solved, _SOLVED_SQL)
    return rows, tables.table(solved, "solved")


def repairs(turns: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of every conversation.

    ``listed`` names conversations that have a row whether or not they have turns.
    """
    return _solve_all(turns, listed)[1]


def _with_audits(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """Rows in order, each conversation's audit ahead of them."""
    audits = solved.select(
        "conv_id", F.lit(0).alias("mark"), "audit", F.lit(None).cast("long").alias("turn"),
        *[F.lit(None).cast("string").alias(c) for c in ("role", "text")], F.lit(0).cast("long").alias("copies"),
    )
    real = rows.where("mark = 1").select("conv_id", "mark", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "copies")
    dealt = audits.unionByName(real).repartition(parallelism(rows.sparkSession), "conv_id").sortWithinPartitions(*ORDER)
    return dealt.select("conv_id", "mark", "audit", "role", "text", "copies")


def _repaired_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        repair, place = None, 0
        conv = None
        for new, now, batch in _slices(batches):
            if new:
                for role, text in repair.inserted() if repair else ():
                    yield {"conv_id": conv, "turn": place, "role": role, "text": text}
                    place += 1
                conv, place = now, 0
            for mark, audit, role, text, copies in zip(*[batch.column(k).to_pylist() for k in range(1, 6)], strict=True):
                if mark == 0:
                    repair = _Repaired(audit)
                    continue
                for role, text in repair.row(role, text, copies):
                    yield {"conv_id": conv, "turn": place, "role": role, "text": text}
                    place += 1
        for role, text in repair.inserted() if repair else ():
            yield {"conv_id": conv, "turn": place, "role": role, "text": text}
            place += 1

    yield from _batched(rows(), pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]), 64)


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id, turn (counted from 0), role and text of the repaired conversations."""
    rows, solved = _solve_all(turns, None)
    return _with_audits(rows, solved).mapInArrow(_repaired_turns, "conv_id long, turn long, role string, text string")


def report(conversations: DataFrame) -> DataFrame:
    """Damage ``conversations``, repair them, and give counts, cost, audit and digest of every conversation."""
    rows, solved = _solve_all(damaged(conversations), conversations)
    digests = _with_audits(rows, solved).mapInArrow(_digested, "conv_id long, audit string, repaired_sha256 string")
    left, right = solved.alias("l"), digests.select("conv_id", "repaired_sha256").alias("r")
    joined = left.join(right, F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")))
    return joined.select("l.conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
