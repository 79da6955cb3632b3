"""Documents packed into batches, and the exchange of keys between batches.

Statistics over all documents that every document needs back (counts of words,
repeats of strings) are exchanged by batch: a shelf is a row that holds some
whole documents, compressed. A shelf sends its distinct keys, with local counts,
to buckets of the key space; a bucket merges what all shelves sent and answers
each shelf. So a key of a third of all documents costs one entry per shelf, no
text is shuffled to meet its keys, and buckets are as many as the data needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.spans import Chunk, text_bytes
from threadloom.session import Scratch

SHELF_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
SHELF_SCHEMA = "shelf long, n_docs int, n_bytes long, body binary"


def _pack(ids: pa.Array, texts: list[np.ndarray]) -> bytes:
    sizes = np.array([len(t) for t in texts], np.int64)
    known = np.array([i is not None for i in ids], np.uint8)
    numbers = np.array([0 if i is None else i for i in ids], np.int64)
    raw = b"".join([numbers.tobytes(), known.tobytes(), sizes.tobytes(), *[t.tobytes() for t in texts]])
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _shelved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    ids: list = []
    texts: list[np.ndarray] = []
    size = turn = 0

    def made() -> pa.RecordBatch:
        return pa.record_batch(
            [
                pa.array([(part << 32) | turn], pa.int64()),
                pa.array([len(ids)], pa.int32()),
                pa.array([size], pa.int64()),
                pa.array([_pack(ids, texts)], pa.binary()),
            ],
            ["shelf", "n_docs", "n_bytes", "body"],
        )

    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for row, doc in enumerate(batch.column(0).to_pylist()):
            text = data[offsets[row] : offsets[row + 1]]
            if ids and size + len(text) > SHELF_BYTES:
                yield made()
                ids, texts, size, turn = [], [], 0, turn + 1
            ids.append(doc)
            texts.append(text.copy())
            size += len(text)
    if ids:
        yield made()


def shelve(docs: DataFrame, tables: Scratch) -> DataFrame:
    """A written table of shelves with the ids and whole texts of ``docs``; no shuffle."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return tables.table(plain.mapInArrow(_shelved, SHELF_SCHEMA), "shelves")


def unpack(n_docs: int, body: bytes) -> tuple[np.ndarray, np.ndarray, Chunk]:
    """Ids, which of them are known, and the texts as one chunk."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    ids = raw[: 8 * n_docs].view(np.int64)
    known = raw[8 * n_docs : 9 * n_docs].astype(bool)
    # sizes may start at any byte
    sizes = np.frombuffer(raw[9 * n_docs : 17 * n_docs].tobytes(), np.int64)
    return ids, known, Chunk(0, raw[17 * n_docs :], np.concatenate([[0], np.cumsum(sizes)]))


def buckets_for(n_bytes: int) -> int:
    """Buckets so that one holds what about ``BUCKET_BYTES`` of text sends; at least 64."""
    return max(64, -(-n_bytes // BUCKET_BYTES))


def by_bucket(key: np.ndarray, buckets: int) -> list[np.ndarray]:
    """Positions of the keys of each bucket, by the upper half of the hash."""
    bucket = ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    order = np.argsort(bucket, kind="stable")
    return np.split(order, np.searchsorted(bucket[order], np.arange(1, buckets, dtype=np.uint64)))


def send(shelves: DataFrame, letters: Callable) -> DataFrame:
    """Rows (bucket, shelf, body) that ``letters(ids, known, chunk)`` gives for each shelf."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shelf, n, body in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                made = letters(*unpack(n.as_py(), body.as_py()))
                yield pa.record_batch(
                    [
                        pa.array([b for b, _ in made], pa.int32()),
                        pa.array([shelf.as_py()] * len(made), pa.int64()),
                        pa.array([x for _, x in made], pa.binary()),
                    ],
                    ["bucket", "shelf", "body"],
                )

    return shelves.select("shelf", "n_docs", "body").mapInArrow(sent, "bucket int, shelf long, body binary")


def answer(letters: DataFrame, merge: Callable) -> DataFrame:
    """Rows (bucket, shelf, body) that ``merge(list of bodies)`` gives back, one per letter of a bucket."""

    def merged(table: pa.Table) -> pa.Table:
        out = merge([b.as_py() for b in table.column("body")])
        return pa.table({"bucket": table.column("bucket"), "shelf": table.column("shelf"), "body": pa.array(out, pa.binary())})

    return letters.groupBy("bucket").applyInArrow(merged, "bucket int, shelf long, body binary")


def open_answers(shelves: DataFrame, answers: DataFrame, result: Callable, schema: str, named: bool = False) -> DataFrame:
    """What ``result(ids, known, chunk, {bucket: body})`` gives for each shelf and the answers to it.

    ``named`` puts the shelf beside each row. A shelf to which nothing was
    answered has no bodies.
    """
    schema = f"shelf long, {schema}" if named else schema

    def opened(shelf: pa.Table, got: pa.Table) -> pa.Table:
        n, body = shelf.column("n_docs")[0].as_py(), shelf.column("body")[0].as_py()
        found = {b.as_py(): x.as_py() for b, x in zip(got.column("bucket"), got.column("body"), strict=True)}
        made = result(*unpack(n, body), found)
        return made.add_column(0, "shelf", pa.array([shelf.column("shelf")[0].as_py()] * made.num_rows, pa.int64())) if named else made

    left = shelves.select("shelf", "n_docs", "body").groupBy("shelf")
    return left.cogroup(answers.select("shelf", "bucket", "body").groupBy("shelf")).applyInArrow(opened, schema)
