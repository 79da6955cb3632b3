"""MinHash near-duplicates: DartMinHash signatures, banded joining, exact verification.

Signatures. Every element (a word shingle) owns a region, its weight wide, in
which darts of ever larger rank have fallen by a Poisson process that depends on
the element alone; each dart also names one of ``COORDINATES`` at random. A
document throws only the darts of small rank that it needs, about
``COORDINATES * (ln COORDINATES + 4)`` in all however long it is at most one
unit of rank per element, and keeps the earliest dart of each coordinate. Two
documents keep the same dart with the probability of their weighted Jaccard
similarity. Weights are 1 (sets, the default) or counts.

Joining. ``BANDS`` bands of ``ROWS`` coordinates are bucket keys. Exact copies
are one node from the start. A bucket never gives all its pairs: its members are
compared with one center (the member that meets most others over all bands),
linked members become components, and only members outside a bucket's largest
component are compared with the rest of it, where the sizes of both sets, the
shingles that each has alone, and counts by parts leave them any chance (bounds
that never lose a pair, tested inside the join). Pairs are thinned by an estimate
from 16-bit sketches that is five standard errors below the threshold, then
verified on their whole shingle sets.

A text of one to four words is one shingle; texts without words (empty, blank,
null) have none and are copies of each other. A node is a text, told by its 128-bit
digest, whatever ids it stands under: several texts of one id are several nodes,
and so are texts of null ids. A class is named by its smallest doc_id in the end; a
null id never names one, unless all ids of the class are null. So classes of
different texts of one id may share a name; ``keep_first`` tells them apart and
keeps one row of each, the smallest by (id, digest), nulls last. Repeated rows are
copies. Other columns may have any names; an empty table has no classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.graph import components
from threadloom.llm.spans import Chunk, chunks, mix, span_hash, text_bytes
from threadloom.session import Scratch

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 32, 5
COORDINATES = BANDS * ROWS
SKETCH_FLOOR = 0.64
BROADCAST_IDS = 2_000_000
PART_BITS = 6
PARTS = 1 << PART_BITS

_MAX_RANK = 4096
_FRACTION = 33
_NONE = np.uint64((1 << 45) - 1)
_BLOCK = 200
_K1, _K2, _K3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_POISSON = np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1, k + 1))) for k in range(18)])


def shingle_sets(chunk: Chunk, weighted: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending, and the bounds between documents.

    With ``weighted`` the i-th repeat of a shingle is an element of its own, so
    that sets stand for counted shingles.
    """
    starts, ends, owner = chunk.words()
    first = np.searchsorted(owner, np.arange(chunk.n + 1))
    size = first[1:] - first[:-1]
    n = np.where(size >= SHINGLE, size - SHINGLE + 1, np.minimum(size, 1))
    at = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    doc = np.repeat(np.arange(chunk.n), n)
    word = span_hash(chunk.prefix(), starts, ends)
    length = np.minimum(size, SHINGLE)[doc]
    h = np.zeros(len(at), np.uint64)
    for i in range(SHINGLE):
        use = i < length
        h[use] = (h[use] * _K1) + word[at[use] + i]
    h = mix(h)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    if weighted:
        run = np.flatnonzero(~same)
        repeat = np.arange(len(h)) - np.repeat(run, np.diff(np.append(run, len(h))))
        h = np.where(repeat > 0, mix(h + repeat.astype(np.uint64) * _K2), h)
    else:
        h, doc = h[~same], doc[~same]
    return h, np.searchsorted(doc, np.arange(chunk.n + 1))


def signatures(elements: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(documents, COORDINATES) earliest darts; every element weighs one unit."""
    n = len(bounds) - 1
    out = np.full((n, COORDINATES), _NONE, np.uint64)
    need = COORDINATES * (np.log(COORDINATES) + 4)
    sizes = np.diff(bounds)
    ranks = np.minimum(np.ceil(need / np.maximum(sizes, 1)), _MAX_RANK).astype(np.int64)
    for low in range(0, n, _BLOCK):
        todo = np.arange(low, min(low + _BLOCK, n))
        todo = todo[sizes[todo] > 0]
        while len(todo):
            out[todo] = _throw(elements, bounds, todo, ranks[todo])
            todo = todo[(out[todo] == _NONE).any(1) & (ranks[todo] < _MAX_RANK)]
            ranks[todo] = np.minimum(2 * ranks[todo], _MAX_RANK)
    return out


def _throw(elements: np.ndarray, bounds: np.ndarray, docs: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Darts of rank below ``ranks`` of some documents; a cell is an element's unit of rank."""
    sizes = bounds[docs + 1] - bounds[docs]
    cells = sizes * ranks
    doc = np.repeat(np.arange(len(docs)), cells)
    at = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
    rank = at // sizes[doc]
    cell = mix(elements[bounds[docs][doc] + at % sizes[doc]] + (rank.astype(np.uint64) + np.uint64(1)) * _K2)
    darts = np.searchsorted(_POISSON, (cell >> np.uint64(11)) * 2.0**-53)
    total = int(darts.sum())
    turn = np.arange(total) - np.repeat(np.cumsum(darts) - darts, darts)
    dart = mix(np.repeat(cell, darts) + (turn.astype(np.uint64) + np.uint64(1)) * _K3)
    coordinate = ((dart >> np.uint64(40)) % np.uint64(COORDINATES)).astype(np.uint64)
    place = np.repeat(doc.astype(np.uint64), darts) * np.uint64(COORDINATES) + coordinate
    value = (np.repeat(rank.astype(np.uint64), darts) << np.uint64(_FRACTION)) | (dart & np.uint64((1 << _FRACTION) - 1))
    key = np.sort((place << np.uint64(45)) | value)
    place = key >> np.uint64(45)
    first = np.ones(len(key), bool)
    first[1:] = place[1:] != place[:-1]
    out = np.full(len(docs) * COORDINATES, _NONE, np.uint64)
    out[place[first].astype(np.int64)] = key[first] & _NONE
    return out.reshape(len(docs), COORDINATES)


def _band_keys(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _K3, parts.shape[:2])
    for i in range(ROWS):
        key = mix(key * _K1 + parts[:, :, i])
    return key.view(np.int64)


def _signed(weighted: bool):
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for chunk in chunks(data, offsets):
                elements, bounds = shingle_sets(chunk, weighted)
                signature = signatures(elements, bounds)
                full = np.diff(bounds) > 0
                keys = _band_keys(signature)
                sketch = mix(signature).astype(np.uint16)
                size = np.where(full, BANDS, 0)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(chunk.first, chunk.n),
                        batch.column(2).slice(chunk.first, chunk.n),
                        pa.ListArray.from_arrays(
                            pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(keys[full].ravel())
                        ),
                        pa.array([s.tobytes() for s in sketch], pa.binary()),
                    ],
                    ["doc_id", "digest", "bands", "sketch"],
                )

    return signed


def _alike(left: pa.Array, right: pa.Array) -> pa.Array:
    """Share of equal 16-bit coordinates."""
    a, b = (np.frombuffer(b"".join(x.to_pylist()), np.uint16).reshape(len(x), COORDINATES) for x in (left, right))
    return pa.array((a == b).mean(1))


def _part_counts(elements: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Shingles of each document in each of PARTS parts of the hash space."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    part = (elements >> np.uint64(64 - PART_BITS)).astype(np.int64)
    return np.bincount(doc * PARTS + part, minlength=(len(bounds) - 1) * PARTS).astype(np.int32)


def _shingled(weighted: bool):
    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for chunk in chunks(data, offsets):
                elements, bounds = shingle_sets(chunk, weighted)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(chunk.first, chunk.n),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(elements.view(np.int64))),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(chunk.n + 1, dtype=np.int32) * PARTS), pa.array(_part_counts(elements, bounds))
                        ),
                    ],
                    ["node", "shingles", "parts"],
                )

    return shingled


class _Texts:
    """Texts by node: rows (doc_id, text, digest), and of each node one id and digest that lead to its text."""

    def __init__(self, plain: DataFrame, heads: DataFrame, repeated: bool) -> None:
        self.plain, self.heads, self.repeated = plain, heads, repeated

    def of(self, nodes: DataFrame) -> DataFrame:
        """(node, text) of the nodes: found by a broadcast up to BROADCAST_IDS of them (64 MB), shuffled beyond."""
        few = nodes.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        wanted = nodes.join(self.heads, "node").select("node", F.col("head").alias("head_id"), F.col("digest").alias("head_digest"))
        wanted = F.broadcast(wanted) if few else wanted
        match = self.plain["doc_id"].eqNullSafe(F.col("head_id")) & (self.plain["digest"] == F.col("head_digest"))
        found = self.plain.join(wanted, match).select("node", "text")
        return found.dropDuplicates(["node"]) if self.repeated else found


def _verified(pairs: DataFrame, nodes: DataFrame, docs: _Texts, tables: Scratch, similar: float, weighted: bool) -> DataFrame:
    """Those of the (a, b) pairs whose shingle sets are at least ``similar``."""
    left = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("left"))
    right = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("right"))
    close = pairs.join(left, "a").join(right, "b")
    close = close.where(F.arrow_udf(_alike, "double")("left", "right") >= SKETCH_FLOOR + similar - SIMILAR).select("a", "b")
    close = tables.table(close, "close")
    wanted = tables.table(close.select(F.col("a").alias("node")).union(close.select("b")).distinct(), "wanted")
    sets = docs.of(wanted).mapInArrow(_shingled(weighted), "node long, shingles array<long>, parts array<int>")
    sets = tables.table(sets.drop("parts"), "sets")
    both = (
        close.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
        .withColumn("shared", F.size(F.array_intersect("left", "right")))
    )
    return both.where(F.col("shared") >= similar * (F.size("left") + F.size("right") - F.col("shared"))).select("a", "b")


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _length(size: Column) -> Column:
    """Steps of a tenth in size."""
    return F.floor(F.log(size.cast("double")) * 10).cast("int")


def _chances(wanted: DataFrame, docs: _Texts, tables: Scratch, similar: float, weighted: bool) -> DataFrame:
    """(node, size, least, most, parts): what a node could share; nodes that cannot be similar to any are left out.

    Shingles that no other of the nodes has cannot be shared. With m shared at
    most, a set of size y is at least ``similar`` only up to y = m (1 + s) / s - size.
    ``parts`` counts the shingles that can be shared by parts of the hash space:
    two nodes share at most the sum of the smaller counts.
    """
    wanted = tables.table(wanted, "wanted")
    sets = docs.of(wanted).mapInArrow(_shingled(weighted), "node long, shingles array<long>, parts array<int>")
    sets = tables.table(sets.where(F.size("shingles") > 0), "sets")
    part = F.expr(f"cast(shiftrightunsigned(shingle, {64 - PART_BITS}) as int)")
    own = (
        sets.select("node", F.explode("shingles").alias("shingle"))
        .groupBy("shingle")
        .agg(F.count("*").alias("n"), F.min("node").alias("node"))
        .where("n = 1")
        .groupBy("node", part.alias("part"))
        .agg(F.count("*").cast("int").alias("n"))
        .groupBy("node")  # at most PARTS entries
        .agg(F.sum("n").alias("own"), F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("own_parts"))
    )
    shared = F.col("size") - F.coalesce("own", F.lit(0))
    left = F.transform("parts", lambda n, i: n - F.coalesce(F.try_element_at("own_parts", i), F.lit(0)))
    return (
        sets.select("node", F.size("shingles").alias("size"), "parts")
        .join(own, "node", "left")
        .select(
            "node",
            "size",
            F.greatest(F.ceil(similar * F.col("size") - 1e-9), F.lit(1)).cast("long").alias("least"),
            F.least(
                F.floor(shared * (1 + similar) / similar - F.col("size") + 1e-9), F.floor(F.col("size") / similar + 1e-9)
            ).cast("long").alias("most"),
            left.alias("parts"),
        )
        .where("most >= least")
    )


def _digest_of(text: Column) -> Column:
    whole = F.coalesce(text, F.lit(""))
    worded = F.when(F.btrim(whole, F.lit(" \t\n\x0b\x0c\r")) != "", whole).otherwise(F.lit(""))
    return F.unhex(F.md5(worded))


def _plain(docs: DataFrame) -> DataFrame:
    """doc_id, text and the digest of the text; texts without words share one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _digest_of(F.col("text")).alias("digest"))


def _classes(docs: DataFrame, tables: Scratch, similar: float, weighted: bool) -> tuple[DataFrame, bool]:
    """(doc_id, digest, n, comp) of every id and text, its rows counted; and whether any has several rows."""
    plain = _plain(docs)
    signed = tables.table(
        plain.select("doc_id", "text", "digest").mapInArrow(
            _signed(weighted), "doc_id long, digest binary, bands array<long>, sketch binary"
        ),
        "signed",
    )
    rows = tables.table(signed.groupBy("digest", "doc_id").agg(F.count("*").alias("n")), "rows")
    copies = rows.groupBy("digest").agg(F.min("doc_id").alias("head"))
    # a text that alone has its smallest id as head goes by that id; any other by a number below all ids
    claims = copies.groupBy("head").agg(F.min("digest").alias("first"))
    own = copies.alias("c").join(claims.alias("k"), (F.col("c.head") == F.col("k.head")) & (F.col("c.digest") == F.col("k.first")), "left")
    lowest = rows.agg(F.min("doc_id")).first()[0] or 0
    spare = F.lit(min(lowest, 0)) - 1 - F.monotonically_increasing_id()
    node = F.when(F.col("k.head").isNotNull(), F.col("c.head")).otherwise(spare)
    heads = tables.table(own.select("c.digest", "c.head", node.alias("node")), "heads")
    repeated = rows.where("n > 1").limit(1).count() > 0
    signs = signed.alias("s").join(
        heads.alias("h"), (F.col("s.digest") == F.col("h.digest")) & F.col("s.doc_id").eqNullSafe(F.col("h.head"))
    ).select("h.node", "s.bands", "s.sketch")
    nodes = tables.table(signs.dropDuplicates(["node"]) if repeated else signs, "nodes")
    texts = _Texts(plain, heads, repeated)
    keys = nodes.select("node", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = tables.table(keys.join(buckets, "key"), "shared")
    # a bucket's center is the member that meets most others over all bands: what near copies were copied from
    meets = shared.groupBy("node").agg(F.sum("n").alias("meets"))
    ranked = tables.table(shared.join(meets, "node").select("key", "node", "meets"), "ranked")
    centers = ranked.groupBy("key").agg(F.max(F.struct("meets", "node"))["node"].alias("center"))
    members = tables.table(ranked.join(centers, "key").select("key", "node", "center"), "members")

    pairs = members.where("node <> center").select(*_ordered(F.col("node"), F.col("center"))).distinct()
    pairs = tables.table(pairs, "pairs")
    links = tables.table(_verified(pairs, nodes, texts, tables, similar, weighted), "links")
    seen = pairs
    labels = components(links, tables)

    # the other pairs of buckets that still hold several components, where sizes and own shingles leave them a chance
    placed = members.join(labels, "node", "left").select("key", "node", "center", F.coalesce("comp", "node").alias("comp"))
    shares = placed.groupBy("key", "comp").agg(F.count("*").alias("n"))
    split = (
        shares.groupBy("key")
        .agg(F.count("*").alias("comps"), F.max(F.struct("n", "comp"))["comp"].alias("main"))
        .where("comps > 1")
        .select("key", "main")
    )
    open_ = tables.table(placed.join(split, "key"), "open")
    chances = tables.table(_chances(open_.select("node").distinct(), texts, tables, similar, weighted), "chances")
    open_ = tables.table(open_.join(chances, "node"), "open")
    others = open_.select("key", "node", "comp", "size", "least", "most", "parts", _length(F.col("size")).alias("length"))
    centers = open_.where("comp <> main and node <> center").select(
        "key",
        F.col("node").alias("x"),
        F.col("comp").alias("x_comp"),
        F.col("size").alias("x_size"),
        F.col("least").alias("x_least"),
        F.col("most").alias("x_most"),
        F.col("parts").alias("x_parts"),
        F.explode(F.sequence(_length(F.col("least")), _length(F.col("most")))).alias("length"),
    )
    at_most = F.aggregate(F.zip_with("parts", "x_parts", lambda m, n: F.least(m, n)), F.lit(0), lambda m, n: m + n)
    fitting = (
        (F.col("comp") != F.col("x_comp"))
        & F.col("size").between(F.col("x_least"), F.col("x_most"))
        & F.col("x_size").between(F.col("least"), F.col("most"))
        & (at_most * (1 + similar) / similar >= F.col("size") + F.col("x_size") - 1e-9)
    )
    pairs_left = centers.join(others, ["key", "length"]).where(fitting).select(*_ordered(F.col("node"), F.col("x"))).distinct()
    pairs_left = tables.table(pairs_left.join(pairs, ["a", "b"], "left_anti"), "pairs")
    more = tables.table(_verified(pairs_left, nodes, texts, tables, similar, weighted), "links")
    labels = components(links.union(more), tables)
    labelled = heads.join(labels, "node", "left").select("digest", F.coalesce("comp", "node").alias("comp"))
    return tables.table(rows.join(labelled, "digest").select("doc_id", "digest", "n", "comp"), "classes"), repeated


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, weighted: bool = False) -> DataFrame:
    """doc_id and class_id of every row: the class holds exact copies and everything linked to them."""
    classes, _ = _classes(docs, Scratch(docs.sparkSession, "near-duplicates"), similar, weighted)
    names = classes.groupBy("comp").agg(F.min("doc_id").alias("class_id"))
    named = classes.join(names, "comp")
    return named.select("doc_id", "class_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).drop("copy")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each class, the smallest by id and digest, null ids last; of its repeated rows one."""
    classes, repeated = _classes(docs, Scratch(docs.sparkSession, "near-duplicates"), SIMILAR, False)
    rank = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest")
    firsts = classes.groupBy("comp").agg(F.min(rank).alias("first"))
    lost = classes.join(firsts, "comp").where(rank != F.col("first")).select(F.col("doc_id").alias("lost_id"), F.col("digest").alias("lost_digest"))
    few = lost.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    lost = F.broadcast(lost) if few else lost
    names = docs.columns
    told = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), _digest_of(F.col("text")).alias("own_digest"))
    kept = told.join(lost, F.col("own_id").eqNullSafe(F.col("lost_id")) & (F.col("own_digest") == F.col("lost_digest")), "left_anti")
    if repeated:
        kept = kept.dropDuplicates(["own_id", "own_digest"])
    return kept.select(*[F.col("row").getField(c).alias(c) for c in names])
