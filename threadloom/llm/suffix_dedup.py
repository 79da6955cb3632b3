"""Suffix-array dedup by prefix-free parsing: strings of 50 bytes that an earlier document has.

Every byte covered by a ``LENGTH``-byte string that also starts in a document with a
smaller doc_id is removed; matches stay within documents and are judged on the input.

Parsing. The trigger of a string is the window of ``WINDOW`` bytes in it with the
smallest rolling hash. Neighbouring strings with the same trigger make up one
phrase, and neighbouring phrases overlap by ``LENGTH`` - 1 bytes, so phrases are
prefix-free in the sense that matters: a string of ``LENGTH`` bytes lies in exactly
one phrase, and equal strings have equal triggers at equal places in them. The
order of suffixes to a depth of ``LENGTH`` bytes therefore splits by trigger: the
suffixes of all distinct phrases of a trigger (the dictionary) are sorted
together, and runs of equal ones get the smallest doc_id of the documents
(the parse) that hold their phrases.

Distribution. Documents are packed into shelves (see ``shelves``). First each
shelf sends its distinct triggers, and learns which of them other documents
have too; a trigger of a third of all documents is one entry per shelf. Then it
sends its distinct phrases of these triggers, each with its smallest doc_id, to
the trigger's bucket, which sorts their suffixes and returns to each shelf, run by
run, the smallest doc_id that has the string. Where very many shelves hold a trigger
(``HOT_SHELVES``), phrases that only begin or end in a common passage would all
meet in one bucket; their strings are sent one by one instead, to buckets by
their own hash, with the same result. Triggers are told apart by 64-bit hashes at
first, which may only send more; strings of 50 bytes by 64-bit hashes.

Null and empty texts have no bytes. A null id counts as larger than any other.
Rows with the same id are one document for the comparison: neither makes the
other's bytes go.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm import shelves
from threadloom.llm.spans import _TABLE, Chunk, arrow_rows, mix
from threadloom.session import Scratch

LENGTH = 50
WINDOW = 16
HOT_SHELVES = 256
_RUN = LENGTH - WINDOW + 1
_LAST = np.iinfo(np.int64).max
_PIECE = 1 << 19
_BASE = 0x9E3779B97F4A7C15


def _rolling(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes from each position, by doubling."""
    power, have, out = _TABLE[data], 1, None
    done = 0
    while length:
        if length & 1:
            if out is None:
                out, done = power, have
            else:
                n = len(power) - done
                out = out[:n] * np.uint64(pow(_BASE, have, 1 << 64)) + power[done:]
                done += have
        length >>= 1
        if length:
            power = power[: len(power) - have] * np.uint64(pow(_BASE, have, 1 << 64)) + power[have:]
            have *= 2
    return out


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each run of ``width`` values."""
    low, have = values, 1
    while 2 * have <= width:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    rest = width - have
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def _parse(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of one text: first string, last string (positions) and trigger hash of each."""
    if len(data) < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    hashes = mix(_rolling(data, WINDOW))
    # equal hashes are told apart by place: the first of the smallest is a string's trigger
    low = _smallest(hashes, _RUN)
    edge = np.flatnonzero(low[1:] != low[:-1]) + 1
    first = np.append(0, edge)
    # smallest hashes crowd near 0, buckets of triggers need them spread
    return first, np.append(edge, len(low)) - 1, mix(low[first] + np.uint64(_BASE))


class _Phrases:
    """Phrases of all texts of a shelf, in order."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, chunk: Chunk) -> None:
        self.ids = np.where(known, ids, _LAST)
        parts = []
        for row in range(chunk.n):
            base = int(chunk.offsets[row])
            text = chunk.data[base : int(chunk.offsets[row + 1])]
            for begin in range(0, max(1, len(text)), _PIECE):
                # a piece goes on as far as its last string, so that no string is lost between pieces
                first, last, trigger = _parse(text[begin : begin + _PIECE + LENGTH - 1])
                parts.append((first + base + begin, last + base + begin, trigger, np.full(len(first), row, np.int64)))
        self.first, self.last, self.trigger, self.row = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 4
        self.data = chunk.data

    def pick(self, repeated: np.ndarray) -> np.ndarray:
        """Positions of the phrases with these triggers."""
        if not len(repeated):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(repeated, self.trigger), len(repeated) - 1)
        return np.flatnonzero(repeated[at] == self.trigger)

    def distinct(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that stand for equal ones, the one each stands in, and smallest ids."""
        size = self.last[at] - self.first[at] + LENGTH
        total = np.concatenate([[0], np.cumsum(size)])
        key = np.empty(len(at), np.uint64)
        for begin in range(0, len(at), 8192):
            stop = min(len(at), begin + 8192)
            place = np.repeat(self.first[at[begin:stop]] - total[begin:stop], size[begin:stop]) + np.arange(total[begin], total[stop])
            inner = np.arange(total[begin], total[stop]) - np.repeat(total[begin:stop], size[begin:stop])
            weight = mix(inner.astype(np.uint64) * np.uint64(_BASE) + _TABLE[self.data[place]])
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weight)])
            cut = total[begin : stop + 1] - total[begin]
            key[begin:stop] = mix(sums[cut[1:]] - sums[cut[:-1]])
        order = np.argsort(key, kind="stable")
        new = np.append(True, key[order][1:] != key[order][:-1]) if len(order) else np.zeros(0, bool)
        of = np.empty(len(at), np.int64)
        of[order] = np.cumsum(new) - 1
        ids = self.ids[self.row[at]]
        least = np.minimum.reduceat(ids[order], np.flatnonzero(new)) if len(order) else ids
        return at[order[new]], of, least


def _strings(phrases: _Phrases, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the strings of some phrases, and how many each phrase has."""
    parts = [
        mix(_rolling(phrases.data[phrases.first[i] : phrases.last[i] + LENGTH], LENGTH)) for i in at
    ]
    return np.concatenate([np.zeros(0, np.uint64), *parts]), phrases.last[at] - phrases.first[at] + 1


def _repeats(bodies: list[bytes]) -> list[bytes]:
    """For each letter of (trigger, smallest id, largest id) its triggers that several documents have, hot ones apart."""
    got = [np.frombuffer(b, np.int64).reshape(3, -1) for b in bodies]
    trigger = np.concatenate([g[0] for g in got]).view(np.uint64)
    order = np.argsort(trigger, kind="stable")
    new = np.flatnonzero(np.append(True, trigger[order][1:] != trigger[order][:-1]))
    low = np.minimum.reduceat(np.concatenate([g[1] for g in got])[order], new)
    high = np.maximum.reduceat(np.concatenate([g[2] for g in got])[order], new)
    often = np.diff(np.append(new, len(trigger)))
    shared, often = trigger[order][new][low < high], often[low < high]
    out = []
    for g in got:
        own = g[0].view(np.uint64)
        at = np.minimum(np.searchsorted(shared, own), max(0, len(shared) - 1))
        good = shared[at] == own if len(shared) else np.zeros(len(own), bool)
        hot = often[at[good]] >= HOT_SHELVES
        out.append(np.int64((~hot).sum()).tobytes() + own[good][~hot].tobytes() + own[good][hot].tobytes())
    return out


def _learned(found: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All repeated triggers that a shelf was told of, and the hot ones among them, sorted."""
    parts: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]]
    for body in found.values():
        n = int(np.frombuffer(body, np.int64, 1)[0])
        parts[0].append(np.frombuffer(body, np.uint64, n, 8))
        parts[1].append(np.frombuffer(body, np.uint64, offset=8 + 8 * n))
    hot = np.sort(np.concatenate(parts[1]))
    return np.sort(np.concatenate([*parts[0], hot])), hot


def _merged_strings(bodies: list[bytes]) -> list[bytes]:
    """For each letter of (string hash, smallest id): the smallest id over all letters."""
    got = [np.frombuffer(b, np.int64, offset=1).reshape(2, -1) for b in bodies]
    key = np.concatenate([g[0] for g in got])
    order = np.argsort(key, kind="stable")
    new = np.append(True, key[order][1:] != key[order][:-1])
    group = np.empty(len(key), np.int64)
    group[order] = np.cumsum(new) - 1
    least = np.minimum.reduceat(np.concatenate([g[1] for g in got])[order], np.flatnonzero(new))[group]
    cuts = np.cumsum([g.shape[1] for g in got])[:-1]
    return [x.tobytes() for x in np.split(least, cuts)]


def _resolved(bodies: list[bytes]) -> list[bytes]:
    """Letters of a bucket are all phrases or all strings."""
    return _merged_strings(bodies) if bodies[0][:1] == b"s" else _sorted_suffixes(bodies)


def _sorted_suffixes(bodies: list[bytes]) -> list[bytes]:
    """For each letter of phrases: the runs of their strings, with the smallest id that has them."""
    letters = []
    for body in bodies:
        raw = zstandard.ZstdDecompressor().decompress(body[1:])
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        ids = np.frombuffer(raw, np.int64, n, 8)
        size = np.frombuffer(raw, np.int32, n, 8 + 8 * n).astype(np.int64)
        letters.append((ids, size, np.frombuffer(raw, np.uint8, offset=8 + 12 * n)))
    ids = np.concatenate([x[0] for x in letters])
    size = np.concatenate([x[1] for x in letters])
    data = np.concatenate([x[2] for x in letters])
    strings = size - LENGTH + 1
    begin = np.cumsum(size) - size
    # suffixes of phrases that are at least LENGTH long, by document of the phrase
    place = np.repeat(begin - (np.cumsum(strings) - strings), strings) + np.arange(strings.sum())
    hashes = np.empty(len(data) - LENGTH + 1, np.uint64)
    for at in range(0, len(hashes), _PIECE):
        hashes[at : at + _PIECE] = mix(_rolling(data[at : at + _PIECE + LENGTH - 1], LENGTH))
    key = hashes[place]
    del hashes
    order = np.argsort(key, kind="stable")
    new = np.append(True, key[order][1:] != key[order][:-1])
    group = np.empty(len(key), np.int64)
    group[order] = np.cumsum(new) - 1
    owner = np.repeat(ids, strings)
    least = np.minimum.reduceat(owner[order], np.flatnonzero(new))[group]
    # runs of strings of one phrase with the same smallest id
    head = np.zeros(len(key), bool)
    head[np.cumsum(strings) - strings] = True
    head[1:] |= least[1:] != least[:-1]
    at = np.flatnonzero(head)
    phrase = np.repeat(np.arange(len(size)), strings)[at]
    length = np.diff(np.append(at, len(key)))
    bounds = np.cumsum([0, *[len(x[0]) for x in letters]])
    cuts = np.searchsorted(phrase, bounds)
    out = []
    pack = zstandard.ZstdCompressor(level=3)
    for i in range(len(letters)):
        s = slice(cuts[i], cuts[i + 1])
        counts = np.bincount(phrase[s] - bounds[i], minlength=len(letters[i][0])).astype(np.int32)
        out.append(pack.compress(counts.tobytes() + length[s].astype(np.int32).tobytes() + least[at[s]].astype(np.int64).tobytes()))
    return out


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return _removed(docs, False)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and kept (the remaining bytes) of every document; kept bytes may end within a character."""
    return _removed(docs, True)


def _removed(docs: DataFrame, texts: bool) -> DataFrame:
    spark = docs.sparkSession
    tables = Scratch(spark, "suffix-dedup")
    made = shelves.shelve(docs, tables)
    buckets = shelves.buckets_for(made.agg(F.sum("n_bytes")).first()[0] or 0)

    def triggers(ids: np.ndarray, known: np.ndarray, chunk: Chunk) -> list[tuple[int, bytes]]:
        phrases = _Phrases(ids, known, chunk)
        order = np.argsort(phrases.trigger, kind="stable")
        trigger, owner = phrases.trigger[order], phrases.ids[phrases.row][order] if len(order) else phrases.ids[:0]
        new = np.flatnonzero(np.append(True, trigger[1:] != trigger[:-1])) if len(trigger) else np.zeros(0, np.int64)
        if not len(new):
            return []
        low, high = np.minimum.reduceat(owner, new), np.maximum.reduceat(owner, new)
        trigger = trigger[new]
        return [
            (b, np.stack([trigger[at].view(np.int64), low[at], high[at]]).tobytes())
            for b, at in enumerate(shelves.by_bucket(trigger, buckets))
            if len(at)
        ]

    with arrow_rows(spark, 1):
        answers = tables.table(shelves.answer(shelves.send(made, triggers), _repeats), "repeated")

    def phrases_of(ids, known, chunk, found) -> tuple:
        """Phrases of the shelf; those of repeated triggers with what stands for them; which stand for hot ones."""
        repeated, hot = _learned(found)
        phrases = _Phrases(ids, known, chunk)
        at = phrases.pick(repeated)
        stand, of, least = phrases.distinct(at)
        return phrases, at, stand, of, least, np.isin(phrases.trigger[stand], hot)

    def dictionary(ids: np.ndarray, known: np.ndarray, chunk: Chunk, found: dict[int, bytes]) -> pa.Table:
        phrases, _, stand, _, least, hot = phrases_of(ids, known, chunk, found)
        size = (phrases.last[stand] - phrases.first[stand] + LENGTH).astype(np.int32)
        pack = zstandard.ZstdCompressor(level=3)
        rows, bodies = [], []
        plain = np.flatnonzero(~hot)
        for b, own in enumerate(shelves.by_bucket(phrases.trigger[stand[plain]], buckets)):
            if len(own):
                own = plain[own]
                text = b"".join(phrases.data[f : f + n].tobytes() for f, n in zip(phrases.first[stand[own]], size[own], strict=True))
                rows.append(b)
                bodies.append(b"p" + pack.compress(np.int64(len(own)).tobytes() + least[own].tobytes() + size[own].tobytes() + text))
        key, n = _strings(phrases, stand[hot])
        order = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(key) else np.zeros(0, np.int64)
        if len(new):
            low = np.minimum.reduceat(np.repeat(least[hot], n)[order], new)
            key = key[order][new]
            for b, own in enumerate(shelves.by_bucket(key, buckets)):
                if len(own):
                    rows.append(buckets + b)
                    bodies.append(b"s" + np.stack([key[own].view(np.int64), low[own]]).tobytes())
        return pa.table({"bucket": pa.array(rows, pa.int32()), "body": pa.array(bodies, pa.binary())})

    sent = shelves.open_answers(made, answers, dictionary, "bucket int, body binary", named=True)
    runs = tables.table(shelves.answer(sent, _resolved), "runs")

    def result(ids: np.ndarray, known: np.ndarray, chunk: Chunk, both: dict[int, bytes]) -> pa.Table:
        found = {b: x for b, x in both.items() if b >= 0}
        phrases, at, stand, of, _, hot = phrases_of(ids, known, chunk, found)
        lengths, least = [np.zeros(0, np.int32)] * len(stand), [np.zeros(0, np.int64)] * len(stand)
        plain = np.flatnonzero(~hot)
        for b, own in enumerate(shelves.by_bucket(phrases.trigger[stand[plain]], buckets)):
            if len(own):
                own = plain[own]
                raw = zstandard.ZstdDecompressor().decompress(both[-1 - b])
                per = np.frombuffer(raw, np.int32, len(own))
                n = int(per.sum())
                cut = np.cumsum(per)[:-1]
                for s, x, y in zip(
                    own, np.split(np.frombuffer(raw, np.int32, n, 4 * len(own)), cut), np.split(np.frombuffer(raw, np.int64, n, 4 * (len(own) + n)), cut), strict=True
                ):
                    lengths[s], least[s] = x, y
        key, n = _strings(phrases, stand[hot])
        distinct, back = np.unique(key, return_inverse=True)
        low = np.zeros(len(distinct), np.int64)
        for b, own in enumerate(shelves.by_bucket(distinct, buckets)):
            if len(own):
                low[own] = np.frombuffer(both[-1 - buckets - b], np.int64, len(own))
        for s, x in zip(np.flatnonzero(hot), np.split(low[back], np.cumsum(n)[:-1]), strict=False):
            lengths[s], least[s] = np.ones(len(x), np.int32), x
        # marks: +1 where a repeated run of strings begins, -1 after its last byte
        edge = np.zeros(len(chunk.data) + 1, np.int32)
        if len(at):
            per = np.array([len(lengths[s]) for s in of])
            run = np.concatenate([lengths[s] for s in of]).astype(np.int64)
            low = np.concatenate([least[s] for s in of])
            inner = np.cumsum(run) - run
            inner -= np.repeat(inner[np.cumsum(per) - per], per)
            start = np.repeat(phrases.first[at], per) + inner
            gone = low < np.repeat(phrases.ids[phrases.row[at]], per)
            np.add.at(edge, start[gone], 1)
            np.add.at(edge, start[gone] + run[gone] + LENGTH - 1, -1)
        removed = np.cumsum(edge[:-1]) > 0
        n_removed, n_spans, digests, kept = [], [], [], []
        for row in range(chunk.n):
            own = slice(int(chunk.offsets[row]), int(chunk.offsets[row + 1]))
            gone = removed[own]
            n_removed.append(int(gone.sum()))
            n_spans.append(int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0])))
            rest = chunk.data[own][~gone].tobytes() if n_removed[-1] else chunk.data[own].tobytes()
            if texts:
                kept.append(rest)
            else:
                digests.append(hashlib.sha256(rest).hexdigest())
        named = pa.array(ids, pa.int64(), mask=~known)
        if texts:
            return pa.table({"doc_id": named, "kept": pa.array(kept, pa.binary())})
        return pa.table(
            {
                "doc_id": named,
                "n_bytes": np.diff(chunk.offsets),
                "n_removed": pa.array(n_removed, pa.int64()),
                "n_spans": pa.array(n_spans, pa.int64()),
                "kept_sha256": pa.array(digests, pa.string()),
            }
        )

    # both kinds of answers: triggers under their bucket, runs under -1 - bucket
    all_answers = answers.unionByName(runs.withColumn("bucket", -1 - F.col("bucket")))
    schema = "doc_id long, kept binary" if texts else "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return shelves.open_answers(made, all_answers, result, schema)
