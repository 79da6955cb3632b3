"""Alignment of two tokenizers over a corpus, by merge-path partitioning.

Each text, after one blank, is encoded by tokenizer A (byte-level pairs) and
tokenizer B (pieces, which adds the blank itself). Byte offsets where tokens of
both end cut the tokens into groups; all pairs of an A and a B token of a group
are links. An id pair's count is the number of documents that hold it linked.

Merge path: the ends of A and of B are two sorted lists. Binary searches on the
diagonals of their merge grid find where every ``PIECE``-th merged end falls, so
the merge is cut into independent pieces of equal work, however long a document is
and however unevenly its tokens lie. A piece emits the common ends it
sees; equal ends parted by a cut (A's is last in one piece, B's first in the next)
are found at the cut, and groups that pieces leave open are stitched.

Counts over the corpus: documents are worked on a shelf of about 4 MB at a time. A
shelf lists its distinct id pairs with how many of its documents hold each, and
keeps, packed, which documents link which pairs how often. Pairs are counted by an
aggregate and joined back to the shelves that listed them; a pair in a third of all
documents is one row per shelf.

Texts are cut into segments where a blank follows a visible character; no token of
either kind spans that place (checked on the vocabularies, else texts stay whole),
and each distinct segment is encoded once while it stays in a bounded cache.

Null and empty texts, and texts whose tokens do not spell blank + text (a literal
U+2581 does that), have no tokens: zeros and an empty digest column. Special tokens inside texts
are plain text. Each row is a document, also where ids repeat or are null. An empty table
gives an empty result; columns of other names are not read. The tokens of one
document are held by its task, nothing else grows with it; of groups without
common ends only distinct ids are paired.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.spans import arrow_rows
from threadloom.session import Scratch

A_PATH = "/opt/tokenizers/byte_bpe_50k.json"
B_PATH = "/opt/tokenizers/piece_bpe_32k.model"
PIECE = 1 << 16
SHELF_BYTES = 4 << 20
CACHED_SEGMENTS = 400_000
CACHED_BYTES = 64 << 20
#: Links of a group above which ids are paired by distinct value.
WIDE = 1 << 14
_BLANK = "▁"


# --- tokens of segments ------------------------------------------------------------


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: visible ones stand for themselves."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Tokens:
    """Token ids and token ends of segments, one after another in growing arrays."""

    def __init__(self) -> None:
        self.ids, self.ends = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.first, self.n = [0], 0

    def add(self, lists: list[list[int]], size: np.ndarray) -> None:
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        total = int(counts.sum())
        while self.n + total > len(self.ids):
            self.ids, self.ends = (np.concatenate([x, np.zeros_like(x)]) for x in (self.ids, self.ends))
        ids = np.fromiter(itertools.chain.from_iterable(lists), np.int32, total)
        ends = np.cumsum(size[ids])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        before = np.concatenate([[0], ends])[bounds[:-1]]
        self.ids[self.n : self.n + total] = ids
        self.ends[self.n : self.n + total] = ends - np.repeat(before, counts)
        self.first += (self.n + bounds[1:]).tolist()
        self.n += total

    def of(self, segments: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and absolute ends of the tokens of ``segments`` that begin at ``starts``."""
        first = np.array(self.first)
        counts = (first[1:] - first[:-1])[segments]
        total = int(counts.sum())
        at = np.arange(total) + np.repeat(first[segments] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        return self.ids[at], self.ends[at] + np.repeat(starts, counts)


class Encoder:
    """Both tokenizers, and what is known of segments. One per Python worker."""

    def __init__(self, a_model: bytes, b_model: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(a_model)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters = _byte_letters()
        entries = sorted((i, t) for t, i in self.a.get_vocab(with_added_tokens=True).items())
        self.a_bytes = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for i, t in entries}
        self.b_bytes = {}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        for i, piece in enumerate(pieces):
            self.b_bytes[i] = bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace(_BLANK, " ").encode()
        self.a_size, self.b_size = (
            np.array([len(known.get(i, b"")) for i in range(max(known) + 1)]) for known in (self.a_bytes, self.b_bytes)
        )
        shape = json.loads(a_model).get("pre_tokenizer") or {}
        probe = "ﬁ  Á \t x"
        self.cut = (
            shape.get("type") == "ByteLevel"
            and shape.get("use_regex", True)
            and json.loads(a_model).get("normalizer") is None
            and not any(_BLANK in p.lstrip(_BLANK) for p in pieces)
            and b"".join(self.b_bytes[i] for i in self.b.encode(probe)) == (" " + probe).encode()
        )
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.pending: list[str] = []
        self.tokens = (_Tokens(), _Tokens())
        self.sizes: list[int] = []
        self.whole: list[bool] = []
        self.cached = 0

    def _number(self, part: str) -> int:
        found = self.known.get(part)
        if found is None:
            found = self.known[part] = len(self.known)
            self.pending.append(part)
        return found

    def segments(self, text: str) -> list[int]:
        """Numbers of the segments of blank + text, each begun by a blank that is left out."""
        if not self.cut:
            return [self._number(text)]
        parts = text.split(" ")
        if all(parts) and all(map(str.isprintable, [p[-1] for p in parts])):
            return list(map(self._number, parts))
        out = [parts[0]]
        for part in parts[1:]:
            # a cut needs a visible character before the blank and something after it
            if part and out[-1] and out[-1][-1].isprintable() and out[-1][-1] != " ":
                out.append(part)
            else:
                out[-1] += " " + part
        return list(map(self._number, out))

    def learn(self) -> None:
        """Encode the segments that are new."""
        if not self.pending:
            return
        encode = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        spelled = [(" " + p).encode() for p in self.pending]
        a = [e.ids for e in encode([" " + p for p in self.pending], add_special_tokens=False)]
        b = self.b.encode(self.pending, num_threads=1)
        for tokens, lists, size in ((self.tokens[0], a, self.a_size), (self.tokens[1], b, self.b_size)):
            tokens.add(lists, size)
        self.sizes += map(len, spelled)
        self.whole += [
            s == b"".join(map(self.a_bytes.__getitem__, x)) == b"".join(map(self.b_bytes.__getitem__, y))
            for s, x, y in zip(spelled, a, b, strict=True)
        ]
        self.cached += sum(map(len, spelled))
        self.pending = []

    def full(self) -> bool:
        return len(self.known) > CACHED_SEGMENTS or self.cached > CACHED_BYTES


# --- merge path --------------------------------------------------------------------------


def diagonal_cuts(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of ``a`` and of ``b`` are among the first 0, piece, 2 * piece, ... of their merge, equal ones of ``a`` first."""
    total = len(a) + len(b)
    d = np.append(np.arange(0, total, piece), total)
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (low < high).any():
        middle = (low + high) >> 1
        open_ = low < high
        right = np.zeros(len(d), bool)
        right[open_] = a[middle[open_]] <= b[d[open_] - 1 - middle[open_]]
        low = np.where(open_ & right, middle + 1, low)
        high = np.where(open_ & ~right, middle, high)
    return low, d - low


def common_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each piece of the merge, how many of ``a`` and of ``b`` are at or before each common end it sees."""
    i, j = diagonal_cuts(a, b, piece)
    for i0, i1, j0, j1 in zip(i[:-1], i[1:], j[:-1], j[1:], strict=True):
        # an equal end that the cut has parted: its b stands first here, its a last in the piece before
        begin = i0 - 1 if i0 and j0 < j1 and a[i0 - 1] == b[j0] else i0
        own, other = a[begin:i1], b[j0:j1]
        at = np.searchsorted(other, own)
        hit = at < len(other)
        hit[hit] = other[at[hit]] == own[hit]
        yield begin + np.flatnonzero(hit) + 1, j0 + at[hit] + 1


# --- a shelf of documents -----------------------------------------------------------------


class _Digits:
    """Decimal digits of ids as bytes."""

    def __init__(self, n: int) -> None:
        text = [str(i).encode() for i in range(n)]
        self.width = len(text[-1])
        self.table = np.frombuffer(b"".join(t.ljust(self.width) for t in text), np.uint8).reshape(n, self.width)
        self.size = np.array([len(t) for t in text], np.int8)

    def written(self, ids: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ids, each followed by its byte of ``behind`` unless that is 0; the byte count of each."""
        grid = np.concatenate([self.table[ids], behind[:, None]], axis=1)
        used = np.arange(self.width + 1) < self.size[ids][:, None]
        used[:, -1] = behind > 0
        return grid[used], self.size[ids] + (behind > 0)


def _spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


class _Links:
    """Distinct (document, id pair) of a shelf and how often each is linked."""

    def __init__(self, b_ids: int) -> None:
        self.b_ids, self.keys, self.times, self.held = b_ids, [], [], 0

    def add(self, doc: np.ndarray, a: np.ndarray, b: np.ndarray, times: np.ndarray | None = None) -> None:
        key = (doc.astype(np.int64) << 33) | (a.astype(np.int64) * self.b_ids + b)
        if times is None:
            key, times = np.unique(key, return_counts=True)
        self.keys.append(key)
        self.times.append(times)
        self.held += len(key)
        if self.held > 1 << 22:
            self._settle()

    def _settle(self) -> None:
        key = np.concatenate([np.zeros(0, np.int64), *self.keys])
        times = np.concatenate([np.zeros(0, np.int64), *self.times])
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.keys, self.times = [key[starts]], [np.add.reduceat(times, starts) if len(key) else times]
        self.held = len(starts)

    def made(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, pair and times, by document and pair."""
        self._settle()
        return self.keys[0] >> 33, self.keys[0] & ((1 << 33) - 1), self.times[0]


def _paired(links: _Links, doc: np.ndarray, a: np.ndarray, b: np.ndarray, a0: np.ndarray, b0: np.ndarray, na: np.ndarray, nb: np.ndarray) -> None:
    """Add the links of groups: ``na`` ids of ``a`` from ``a0`` with ``nb`` ids of ``b`` from ``b0``."""
    size = na * nb
    slim = size <= WIDE
    n, rows = size[slim], nb[slim]
    within = _spread(n)
    up = np.repeat(rows, n)
    links.add(np.repeat(doc[slim], n), a[np.repeat(a0[slim], n) + within // up], b[np.repeat(b0[slim], n) + within % up])
    for g in np.flatnonzero(~slim):
        left, left_n = np.unique(a[a0[g] : a0[g] + na[g]], return_counts=True)
        right, right_n = np.unique(b[b0[g] : b0[g] + nb[g]], return_counts=True)
        step = max(1, (1 << 20) // len(right))
        for begin in range(0, len(left), step):
            some, some_n = left[begin : begin + step], left_n[begin : begin + step]
            links.add(
                np.full(len(some) * len(right), doc[g]),
                np.repeat(some, len(right)),
                np.tile(right, len(some)),
                np.repeat(some_n, len(right)) * np.tile(right_n, len(some)),
            )


def _hashed(shas: list, digits: _Digits, doc: np.ndarray, last: np.ndarray, a: np.ndarray, b: np.ndarray, a0: np.ndarray, b0: np.ndarray, na: np.ndarray, nb: np.ndarray) -> None:
    """Send groups, written out, to the digests of their documents; ``last`` marks a document's last group."""
    step = np.searchsorted(np.cumsum(na + nb), np.arange(0, int((na + nb).sum()), 1 << 18), side="left")
    for begin, end in itertools.pairwise([*np.unique(step), len(na)]):
        pa_, pb_ = na[begin:end], nb[begin:end]
        total = pa_ + pb_
        within, ids = _spread(total), np.empty(int(total.sum()), np.int32)
        first = within < np.repeat(pa_, total)
        ids[first] = a[a0[begin] : a0[begin] + pa_.sum()]
        ids[~first] = b[b0[begin] : b0[begin] + pb_.sum()]
        behind = np.full(len(ids), ord(","), np.uint8)
        ends = np.cumsum(total)
        behind[ends - pb_ - 1] = ord("|")
        behind[ends - 1] = np.where(last[begin:end], 0, ord(";"))
        data, size = digits.written(ids, behind)
        offset = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[np.concatenate([[0], ends])]
        owner = doc[begin:end]
        cuts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        for x, y in itertools.pairwise([*cuts, end - begin]):
            shas[owner[x]].update(data[offset[x] : offset[y]])


def shelf_of(encoder: Encoder, digits: _Digits, texts: list[str | None], piece: int = PIECE) -> dict:
    """Numbers and digests of each document, and the links of the shelf."""
    if encoder.full():
        encoder.clear()
    numbers = [encoder.segments(t) if t else [] for t in texts]
    encoder.learn()
    whole, sizes = np.array(encoder.whole, bool), np.array(encoder.sizes, np.int64)
    numbers = [np.array(x, np.int64) for x in numbers]
    numbers = [x if len(x) and whole[x].all() else x[:0] for x in numbers]
    flat = np.concatenate([np.zeros(0, np.int64), *numbers])
    size = sizes[flat]
    starts = np.concatenate([[0], np.cumsum(size)])
    per_doc = np.cumsum([len(x) for x in numbers])
    ends_of = starts[per_doc]
    (a, a_end), (b, b_end) = (t.of(flat, starts[:-1]) for t in encoder.tokens)
    n = len(texts)
    counts = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
    links, shas = _Links(len(encoder.b_size)), [hashlib.sha256() for _ in range(n)]
    done_a = done_b = 0
    for i, j in common_ends(a_end, b_end, piece):
        if not len(i):
            continue
        # the group that pieces before left open is stitched to this piece's first end
        a0, b0 = np.append(done_a, i[:-1]), np.append(done_b, j[:-1])
        done_a, done_b = int(i[-1]), int(j[-1])
        na, nb = i - a0, j - b0
        doc = np.searchsorted(ends_of, a_end[i - 1], side="left")
        last = a_end[i - 1] == ends_of[doc]
        for c, v in (("n_a", na), ("n_b", nb), ("n_groups", np.ones(len(i), np.int64)), ("n_links", na * nb)):
            np.add.at(counts[c], doc, v)
        _paired(links, doc, a, b, a0, b0, na, nb)
        _hashed(shas, digits, doc, last, a, b, a0, b0, na, nb)
    doc, pair, times = links.made()
    distinct, at = np.unique(pair, return_inverse=True)
    held = np.bincount(at, minlength=len(distinct))
    return counts | {
        "sha": [s.hexdigest() if k else "" for s, k in zip(shas, counts["n_a"], strict=True)],
        "pairs": distinct,
        "held": held,
        "links": (np.bincount(doc, minlength=n), at, times),
    }


_DOC = [("doc_id", pa.int64())] + [(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")] + [("groups_sha256", pa.string())]
_DOC_SQL = "doc_id: bigint, n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, groups_sha256: string"
_SHELF = pa.schema(
    [("shelf", pa.int64()), ("docs", pa.list_(pa.struct(_DOC))), ("pairs", pa.list_(pa.int64())), ("held", pa.list_(pa.int32())), ("links", pa.binary())]
)
_SHELF_SQL = f"shelf long, docs array<struct<{_DOC_SQL}>>, pairs array<long>, held array<int>, links binary"

#: Of this Python worker: the models' digest, and what was made of them.
_ENCODERS: dict[bytes, tuple[Encoder, _Digits]] = {}


def _encoder(models: tuple[bytes, bytes]) -> tuple[Encoder, _Digits]:
    name = hashlib.sha256(models[0] + models[1]).digest()
    if name not in _ENCODERS:
        made = Encoder(*models)
        _ENCODERS[name] = (made, _Digits(max(len(made.a_size), len(made.b_size))))
    return _ENCODERS[name]


def _packed(per_doc: np.ndarray, at: np.ndarray, times: np.ndarray) -> bytes:
    """Which documents link which pairs how often; pairs ascend in a document, so steps are small."""
    step = np.diff(at, prepend=0).astype(np.int32)
    raw = np.concatenate([[len(per_doc)], per_doc]).astype(np.int32).tobytes() + step.tobytes() + times.astype(np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unpacked(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    n = int(np.frombuffer(raw, np.int32, 1)[0])
    per_doc = np.frombuffer(raw, np.int32, n, 4)
    total, begin = int(per_doc.sum()), 4 + 4 * n
    at = np.cumsum(np.frombuffer(raw, np.int32, total, begin))
    return per_doc, at, np.frombuffer(raw[begin + 4 * total :], np.int64, total)


def _file(spark, path: str) -> bytes:
    """A vocabulary file by any path that Spark reads."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def _shelves(docs: DataFrame, a_path: str, b_path: str, tables: Scratch) -> tuple[DataFrame, int]:
    spark = docs.sparkSession
    models = (_file(spark, a_path), _file(spark, b_path))
    b_ids = len(Encoder(*models).b_size)
    shared = spark.sparkContext.broadcast(models)

    def shelved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder, digits = _encoder(shared.value)
        ids: list = []
        texts: list[str | None] = []
        size = turn = 0

        def made() -> pa.RecordBatch:
            found = shelf_of(encoder, digits, texts)
            rows = pa.StructArray.from_arrays(
                [pa.array(ids, pa.int64()), *[pa.array(found[c]) for c in ("n_a", "n_b", "n_groups", "n_links")], pa.array(found["sha"], pa.string())],
                fields=list(pa.schema(_DOC)),
            )
            one = [
                pa.array([(part << 32) | turn]),
                pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
                pa.ListArray.from_arrays(pa.array([0, len(found["pairs"])], pa.int32()), pa.array(found["pairs"], pa.int64())),
                pa.ListArray.from_arrays(pa.array([0, len(found["held"])], pa.int32()), pa.array(found["held"], pa.int32())),
                pa.array([_packed(*found["links"])], pa.binary()),
            ]
            return pa.record_batch([x.cast(f.type) for x, f in zip(one, _SHELF, strict=True)], schema=_SHELF)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and size + 4 * len(text or "") > SHELF_BYTES * 2:
                    yield made()
                    ids, texts, size, turn = [], [], 0, turn + 1
                ids.append(doc)
                texts.append(text)
                size += 2 * len(text or "") + 16
        if ids:
            yield made()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with arrow_rows(spark, 1_000):
        return tables.table(plain.mapInArrow(shelved, _SHELF_SQL), "shelves"), b_ids


def _counted(shelves: DataFrame, b_ids: int) -> DataFrame:
    """(pair, count, best) of every id pair that some document links."""
    listed = shelves.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).select("x.pairs", "x.held")
    counts = listed.groupBy(F.col("pairs").alias("pair")).agg(F.sum("held").alias("count"))
    counts = counts.withColumn("a_id", F.expr(f"pair div {b_ids}"))
    return counts


def _judged(counts: DataFrame) -> DataFrame:
    # one row per id of A: bounded by its vocabulary
    most = counts.groupBy("a_id").agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(most), "a_id").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def pair_counts(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """a_id, b_id and the number of documents that hold them linked."""
    tables = Scratch(docs.sparkSession, "token-alignment")
    shelves, b_ids = _shelves(docs, a_path, b_path, tables)
    counts = _counted(shelves, b_ids)
    return counts.select("a_id", F.expr(f"pair % {b_ids}").alias("b_id"), "count")


def align(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs``."""
    tables = Scratch(docs.sparkSession, "token-alignment")
    shelves, b_ids = _shelves(docs, a_path, b_path, tables)
    judged = _judged(tables.table(_counted(shelves, b_ids), "pair-counts"))
    asked = shelves.select(F.col("shelf").alias("asker"), F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(judged, "pair").select("asker", "at", "count", "best")

    def opened(shelf: pa.Table, got: pa.Table) -> pa.Table:
        per_doc, at, times = _unpacked(shelf.column("links")[0].as_py())
        place = got.column("at").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], best[place] = got.column("count").to_numpy(), got.column("best").to_numpy()
        bounds = np.concatenate([[0], np.cumsum(per_doc)])
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (best[at] * times, count[at] * times)]
        rows = shelf.column("docs").combine_chunks().flatten()
        out = {f.name: rows.field(f.name) for f in pa.schema(_DOC)}
        out |= {c: s[bounds[1:]] - s[bounds[:-1]] for c, s in zip(("n_best", "count_sum"), sums, strict=True)}
        return pa.table({c: out[c] for c in COLUMNS})

    left = shelves.select("shelf", "docs", "links").groupBy("shelf")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return left.cogroup(answers.groupBy("asker")).applyInArrow(opened, schema)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
