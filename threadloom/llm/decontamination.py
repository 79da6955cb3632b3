"""Benchmark decontamination: q-gram lemma filtering with banded verification.

A document leaks an item if some stretch of it is within the edit budget of the
whole item: ``RATE`` of the item's bytes, ASCII case ignored. By the q-gram lemma
such a stretch shares at least ``m + 1 - q - k * q`` q-grams with an item of m
bytes and budget k, and they lie on neighbouring diagonals (place in the text
minus place in the item). A task therefore looks every q-gram of its texts up in
the items' q-grams, counts hits per item and cell of k + 1 diagonals, joins
neighbouring cells to overlapping bands, keeps the bands that reach the bound,
and verifies each by an edit-distance alignment within the band.

The items are sent to every task in blocks of at most ``BLOCK_BYTES``, one scan
of the documents per block; the documents are never shuffled.

For short items the budget is cut until the bound is at least ``LEAST`` shared
q-grams. An item under ``q`` bytes has none and stands in texts by chance, so it
matches only a text that is the item, blanks at the ends and ASCII case aside.
Hits are unfolded a bounded number at a time; where a q-gram is so frequent in a
text and an item that its pairs outnumber both by far, pairs per diagonal are
counted by a convolution. Alignments hold a bounded number of window bytes (or one
item), and leave a window as soon as it is above the budget. Clashing names of
other columns do no harm; an empty table leaks nothing. Null or empty items and texts match nothing. Repeated
documents, and repeated items, each give their own rows. Texts are whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.spans import Chunk, chunks, lower_ascii, text_bytes

Q = 8
RATE = 0.1
LEAST = 4
BLOCK_BYTES = 8 << 20
_FILTER_BITS = 22
_GROUP = 256
_GROUP_BYTES = 4 << 20
_UNFOLDED = 1 << 20
_BLANKS = b" \t\n\x0b\x0c\r"


def budget(size: int) -> int:
    """Edits allowed to an item of ``size`` bytes."""
    return max(0, min(int(RATE * size), (size + 1 - Q - LEAST) // Q))


@dataclass
class Items:
    """Items of one block: bytes, ids, budgets, bounds, and where each q-gram occurs."""

    ids: list
    texts: list[np.ndarray]
    budgets: np.ndarray
    bounds: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    known: np.ndarray
    short: dict[bytes, list]


def _bare(text: bytes) -> bytes:
    return text.strip(_BLANKS).lower()


def _codes(data: np.ndarray) -> np.ndarray:
    """The q bytes from each position as one number."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    two = data[:-1].astype(np.uint16) << np.uint16(8) | data[1:]
    four = two[:-2].astype(np.uint32) << np.uint32(16) | two[2:]
    return four[:-4].astype(np.uint64) << np.uint64(32) | four[4:]


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _FILTER_BITS)


def index(rows: list[tuple]) -> Items:
    """Index of (id, text) rows; texts under q bytes are kept by themselves."""
    short: dict[bytes, list] = {}
    for i, text in rows:
        if len(text.encode()) < Q and _bare(text.encode()):
            short.setdefault(_bare(text.encode()), []).append(i)
    rows = [r for r in rows if len(r[1].encode()) >= Q]
    texts = [lower_ascii(np.frombuffer(text.encode(), np.uint8)) for _, text in rows]
    sizes = np.array([len(t) for t in texts], np.int64)
    budgets = np.array([budget(n) for n in sizes], np.int64)
    codes = [_codes(t) for t in texts]
    code = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
    item = np.repeat(np.arange(len(texts)), [len(c) for c in codes])
    place = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.zeros(0, np.int64)
    order = np.argsort(code, kind="stable")
    grams, first = np.unique(code[order], return_index=True)
    known = np.zeros(1 << _FILTER_BITS, bool)
    known[_slot(grams)] = True
    bounds = np.maximum(1, sizes + 1 - Q - budgets * Q)
    return Items(
        [i for i, _ in rows], texts, budgets, bounds, grams, np.append(first, len(code)), item[order], place[order], known, short
    )


def _candidates(chunk: Chunk, data: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, cell) of every band that reaches its item's bound; a band is a cell and the next."""
    none = np.zeros(0, np.int64)
    codes = _codes(data)
    at = np.flatnonzero(items.known[_slot(codes)])
    if not len(at) or not len(items.grams):
        return none, none, none
    found = np.minimum(np.searchsorted(items.grams, codes[at]), len(items.grams) - 1)
    at, found = at[items.grams[found] == codes[at]], found[items.grams[found] == codes[at]]
    doc = chunk.owner(at)
    inside = at + Q <= chunk.offsets[doc + 1]
    at, found, doc = at[inside], found[inside], doc[inside]
    if not len(at):
        return none, none, none
    longest = max(len(t) for t in items.texts)
    top = int(np.diff(chunk.offsets).max()) + longest + 3
    key, count = _counted_cells(chunk, items, at - chunk.offsets[doc], found, doc, longest, top)
    # the band from each cell on, and the band before a cell that follows none
    beside = np.append(key[1:] == key[:-1] + 1, False)
    total = count + np.where(beside, np.append(count[1:], 0), 0)
    alone = np.append(True, ~beside[:-1])
    key, total = np.append(key, key[alone] - 1), np.append(total, count[alone])
    owner, cell = key // top, key % top - 1
    item, doc = owner // chunk.n, owner % chunk.n
    good = total >= items.bounds[item]
    return doc[good], item[good], cell[good]


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ascending keys and their summed counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[starts], np.add.reduceat(count, starts) if len(key) else count


def _counted_cells(
    chunk: Chunk, items: Items, place: np.ndarray, gram: np.ndarray, doc: np.ndarray, longest: int, top: int
) -> tuple[np.ndarray, np.ndarray]:
    """Keys (item, document, cell + 1) and how many q-gram pairs fall into each cell.

    Diagonals start from the document's own beginning, moved up by ``longest`` so
    that none is negative.
    """
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    often = items.first[gram + 1] - items.first[gram]
    # how often this q-gram stands in this document
    order = np.lexsort((doc, gram))
    new = np.flatnonzero(np.append(True, (gram[order][1:] != gram[order][:-1]) | (doc[order][1:] != doc[order][:-1])))
    runs = np.diff(np.append(new, len(order)))
    heavy = runs * often[order][new] > _UNFOLDED
    for begin, n in zip(new[heavy], runs[heavy], strict=True):
        hits = order[begin : begin + n]
        g, d = int(gram[hits[0]]), int(doc[hits[0]])
        span = slice(int(items.first[g]), int(items.first[g + 1]))
        for i in np.unique(items.item[span]):
            own = items.place[span][items.item[span] == i]
            diagonal, pairs = _pairs_per_diagonal(place[hits], own)
            cell = (diagonal + longest) // (items.budgets[i] + 1)
            key, count = _added([(i * chunk.n + d) * top + cell + 1], [pairs])
            keys.append(key)
            counts.append(count)
    light = np.ones(len(gram), bool)
    light[order] = np.repeat(~heavy, runs)
    gram, place, doc, often = gram[light], place[light], doc[light], often[light]
    ends = np.cumsum(often)
    begin = 0
    while begin < len(gram):
        # at least one hit, and pairs up to the bound
        before = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, before + _UNFOLDED, side="right")))
        some = often[begin:stop]
        which = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some) + np.repeat(items.first[gram[begin:stop]], some)
        item = items.item[which]
        diagonal = np.repeat(place[begin:stop], some) - items.place[which] + longest
        cell = diagonal // (items.budgets[item] + 1)
        key = (item * chunk.n + np.repeat(doc[begin:stop], some)) * top + cell + 1
        key, count = np.unique(key, return_counts=True)
        keys.append(key)
        counts.append(count)
        if sum(map(len, keys)) > 4 * _UNFOLDED:
            key, count = _added(keys, counts)
            keys, counts = [key], [count]
        begin = stop
    return _added(keys, counts)


def _pairs_per_diagonal(text: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differences of text places and item places, and how many pairs have each, by convolution."""
    low, high = int(text.min()), int(item.max())
    n, m = int(text.max()) - low + 1, high - int(item.min()) + 1
    size = 1 << (n + m - 1).bit_length()
    left, right = np.zeros(size), np.zeros(size)
    left[text - low] = 1
    right[high - item] = 1
    pairs = np.rint(np.fft.irfft(np.fft.rfft(left) * np.fft.rfft(right), size)).astype(np.int64)
    at = np.flatnonzero(pairs[: n + m - 1])
    return at + low - high, pairs[at]


def _align(items: list[np.ndarray], windows: list[np.ndarray], most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each item to a stretch of its window, and the window place where it ends.

    What is above ``most`` edits is given up, as ``most`` + 1. Row i, column b of the table stands for i item bytes against a stretch that
    ends at window place i + b; a window is as long as its item and band together.
    """
    n = len(items)
    size = np.array([len(t) for t in items])
    rows, width = int(size.max()), max(len(w) - len(t) for w, t in zip(windows, items, strict=True)) + 1
    item = np.full((n, rows), 256, np.int16)
    window = np.full((n, rows + width), 257, np.int16)
    for i, (t, w) in enumerate(zip(items, windows, strict=True)):
        item[i, : len(t)] = t
        window[i, : len(w)] = w
    slope = np.arange(width, dtype=np.int32)
    cost = np.zeros((n, width), np.int32)
    best, end = most.astype(np.int64) + 1, np.zeros(n, np.int64)
    live = np.arange(n)
    for i in range(1, rows + 1):
        change = cost + (window[:, i - 1 : i - 1 + width] != item[:, i - 1 : i])
        change[:, :-1] = np.minimum(change[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(change - slope, axis=1) + slope
        done = np.flatnonzero(size[live] == i)
        if len(done):
            least = cost[done].argmin(1)
            best[live[done]], end[live[done]] = cost[done, least], i + least
        if i % 64 == 0:
            stays = (cost.min(1) <= most[live]) & (size[live] > i)
            if not stays.all():
                live, cost, window, item = live[stays], cost[stays], window[stays], item[stays]
            if not len(live):
                break
    return best, end


def _groups(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of ascending sizes whose tables stay within ``_GROUP_BYTES``, or one."""
    low = 0
    while low < len(sizes):
        stop = low + 1
        while stop < len(sizes) and stop - low < _GROUP and (stop + 1 - low) * sizes[stop] <= _GROUP_BYTES:
            stop += 1
        yield slice(low, stop)
        low = stop


def _verified(chunk: Chunk, data: np.ndarray, items: Items, found: tuple) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, item, start, end, edits) in bytes of each band that holds a match; one per item and stretch."""
    doc, item, cell = found
    order = np.argsort([len(items.texts[i]) for i in item], kind="stable")
    longest = max((len(t) for t in items.texts), default=0)
    got: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for run in _groups(np.array([len(items.texts[item[c]]) for c in order])):
        pick = order[run]
        texts, windows, begins = [], [], []
        for c in pick:
            text, k = items.texts[item[c]], int(items.budgets[item[c]])
            size = int(chunk.offsets[doc[c] + 1] - chunk.offsets[doc[c]])
            begin = int(cell[c]) * (k + 1) - longest - k
            # what the window has outside the document is filled with bytes that match nothing
            window = np.zeros(len(text) + 2 * (k + 1) + 2 * k, np.uint8)
            low_, high = max(0, begin), min(size, begin + len(window))
            window[low_ - begin : max(low_, high) - begin] = data[chunk.offsets[doc[c]] + low_ : chunk.offsets[doc[c]] + max(low_, high)]
            texts.append(text)
            windows.append(window)
            begins.append((begin, size))
        most = items.budgets[item[pick]]
        edits, ends = _align(texts, windows, most)
        good = np.flatnonzero(edits <= most)
        if not len(good):
            continue
        reverse = [_backward(windows[g], int(ends[g]), texts[g]) for g in good]
        # a window that ends the text may be short of its item, so nothing is given up here
        _, lengths = _align([texts[g][::-1] for g in good], reverse, np.array([len(texts[g]) for g in good]))
        for g, size in zip(good, lengths, strict=True):
            begin, whole = begins[g]
            stop = min(whole, begin + int(ends[g]))
            start = max(0, begin + int(ends[g]) - int(size))
            got.setdefault((int(doc[pick[g]]), int(item[pick[g]])), []).append((start, stop, int(edits[g])))
    for (d, i), spans in sorted(got.items()):
        kept: list[tuple[int, int, int]] = []
        for span in sorted(spans, key=lambda s: (s[2], s[0])):
            if all(span[0] >= b or span[1] <= a for a, b, _ in kept):
                kept.append(span)
        for start, stop, edits in sorted(kept):
            yield d, i, start, stop, edits


def _backward(window: np.ndarray, end: int, text: np.ndarray) -> np.ndarray:
    """The window up to ``end``, reversed, filled up to the item's length."""
    part = window[: min(end, len(window))][::-1]
    return np.concatenate([part, np.zeros(max(0, len(text) - len(part)), np.uint8)])


def _equals(chunk: Chunk, items: Items) -> Iterator[tuple[int, int]]:
    """(document, item id) of texts that are a short item."""
    if items.short:
        for d in np.flatnonzero(np.diff(chunk.offsets) < 1 << 16):
            found = items.short.get(_bare(chunk.data[chunk.offsets[d] : chunk.offsets[d + 1]].tobytes()))
            for i in found or ():
                yield int(d), i


def _points(data: np.ndarray, upto: int) -> int:
    """Code points in the first bytes."""
    return int(np.count_nonzero((data[:upto] & 0xC0) != 0x80))


def _matcher(shared):
    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            rows: list[tuple] = []
            for chunk in chunks(data, offsets):
                low = lower_ascii(chunk.data)
                for d, i, start, stop, edits in _verified(chunk, low, items, _candidates(chunk, low, items)):
                    text = chunk.data[chunk.offsets[d] : chunk.offsets[d + 1]]
                    rows.append((chunk.first + d, items.ids[i], _points(text, start), _points(text, stop), edits))
                for d, i in _equals(chunk, items):
                    text = chunk.data[chunk.offsets[d] : chunk.offsets[d + 1]]
                    rows.append((chunk.first + d, i, 0, _points(text, len(text)), 0))
            if rows:
                at, ids, starts, stops, edits = zip(*rows, strict=True)
                yield pa.record_batch(
                    [
                        batch.column(0).take(pa.array(at)),
                        pa.array(ids, pa.int64()),
                        *[pa.array(x, pa.int32()) for x in (starts, stops, edits)],
                    ],
                    ["doc_id", "item_id", "start", "end", "edits"],
                )

    return matched


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """The items, a bounded number of bytes at a time."""
    usable = benchmark.where(F.octet_length("text") > 0).select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = usable.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = -(-size // (BLOCK_BYTES // 2)) or 1
    for block in range(n):
        part = usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block) if n > 1 else usable
        yield sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end (code points), edits of every leaked item; several rows per document."""
    context = docs.sparkSession.sparkContext
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, start int, end int, edits int"
    made = None
    for rows in _blocks(benchmark):
        part = plain.mapInArrow(_matcher(context.broadcast(index(rows))), schema)
        made = part if made is None else made.unionByName(part)
    return made


def _is_clean(shared):
    def clean(texts: pa.Array) -> pa.Array:
        data, offsets = text_bytes(texts)
        out = np.ones(len(texts), bool)
        for chunk in chunks(data, offsets):
            low = lower_ascii(chunk.data)
            for d, *_ in _verified(chunk, low, shared.value, _candidates(chunk, low, shared.value)):
                out[chunk.first + d] = False
            for d, _ in _equals(chunk, shared.value):
                out[chunk.first + d] = False
        return pa.array(out)

    return F.arrow_udf(clean, "boolean")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, with their own columns only."""
    context = docs.sparkSession.sparkContext
    kept = docs
    for rows in _blocks(benchmark):
        kept = kept.where(_is_clean(context.broadcast(index(rows)))(kept["text"]))
    return kept
