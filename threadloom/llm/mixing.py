"""Mixing sources to target weights by min-cost flow over membership patterns.

A document belongs to one or more sources. Documents with the same set of
sources form one pattern, so the flow has one node per pattern, however many
documents there are: tokens run from patterns to source quotas, and taking a
pattern once, twice or thrice costs more each time (convex repetition costs),
so text is repeated only where quotas cannot be met otherwise. A pattern's flow
then becomes whole passes over its documents and one partial pass, for which
documents are taken in the order of a seeded hash of their ids; the last one may
be taken in part. The hash at which that pass ends is found by radix descent over
counted buckets, so no group is ever sorted or gathered.

Patterns are few by the data model (sources are few); more than ``MAX_PATTERNS``
are refused with an error, before anything is sent to the driver.

Null texts have size 0; a null source is a source of its own, last in order. A
repeated id hashes alike, so its rows are taken together. Empty tables, and
tables without any word, take nothing.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.session import Scratch

WEIGHTS = (1, 2, 3)
MOST = 3
COSTS = (0, 1, 3)
MAX_PATTERNS = 10_000
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"
_LEVELS = (12, 12, 12, 12, 15)


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> dict[str | None, float]:
    """Share the total size by weight; nothing above ``most`` times its source, the excess reshared."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    made: dict[str | None, float] = {}
    left, open_ = float(sum(sizes.values())), names
    while open_:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not above:
            return made | {s: left * weight[s] / total for s in open_}
        for s in above:
            made[s] = float(most * sizes[s])
        left -= sum(made[s] for s in above)
        open_ = [s for s in open_ if s not in made]
    return made


def route(capacity: list[int], member_of: list[list[int]], quota: list[int], costs: tuple[int, ...] = COSTS) -> list[int]:
    """Tokens to take from each pattern: a min-cost maximum flow by cheapest augmenting paths.

    Pattern ``p`` gives at most ``capacity[p]`` tokens at each of ``costs`` and
    may send them to the sources ``member_of[p]``, source ``s`` takes at most
    ``quota[s]``.
    """
    patterns, sources = len(capacity), len(quota)
    begin, end = patterns + sources, patterns + sources + 1
    edges: list[list[int]] = []  # to, left, cost
    out: list[list[int]] = [[] for _ in range(end + 1)]

    def arc(a: int, b: int, room: int, cost: int) -> None:
        out[a].append(len(edges))
        edges.append([b, room, cost])
        out[b].append(len(edges))
        edges.append([a, 0, -cost])

    for p in range(patterns):
        for cost in costs:
            arc(begin, p, capacity[p], cost)
        for s in member_of[p]:
            arc(p, patterns + s, len(costs) * capacity[p], 0)
    for s in range(sources):
        arc(patterns + s, end, quota[s], 0)
    while True:
        far: list[float] = [float("inf")] * (end + 1)
        via, queued, queue = [-1] * (end + 1), [False] * (end + 1), deque([begin])
        far[begin] = 0
        while queue:
            a = queue.popleft()
            queued[a] = False
            for e in out[a]:
                b, room, cost = edges[e]
                if room > 0 and far[a] + cost < far[b]:
                    far[b], via[b] = far[a] + cost, e
                    if not queued[b]:
                        queued[b] = True
                        queue.append(b)
        if via[end] < 0:
            break
        path, at = [], end
        while at != begin:
            path.append(via[at])
            at = edges[via[at] ^ 1][0]
        room = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= room
            edges[e ^ 1][1] += room
    first = 2 * len(costs)
    taken, at = [], 0
    for p in range(patterns):
        taken.append(sum(edges[at + 2 * i + 1][1] for i in range(len(costs))))
        at += first + 2 * len(member_of[p])
    return taken


def _ends(sized: DataFrame, rest: dict[str, int]) -> dict[str, tuple[int, float]]:
    """For each pattern the hash where its partial pass ends, and the share of that hash still in.

    ``rest`` has the tokens wanted. Each level counts 4,096 buckets per pattern
    and goes into the one where the wanted sum is crossed.
    """
    spark = sized.sparkSession
    open_ = {p: (0, r) for p, r in rest.items() if r > 0}  # prefix of the hash so far, tokens still wanted
    made = {p: (-1, 0.0) for p in rest}
    left_bits = 63
    for bits in _LEVELS:
        left_bits -= bits
        if not open_:
            break
        cuts = spark.createDataFrame(
            [(p, prefix, r) for p, (prefix, r) in open_.items()], "pattern string, prefix long, wanted long"
        )
        inside = sized.join(F.broadcast(cuts), "pattern").where(
            F.shiftright("hash", left_bits + bits) == F.col("prefix")
        )
        buckets = (
            inside.groupBy("pattern", "wanted", F.shiftright("hash", left_bits).alias("bucket"))
            .agg(F.sum("size").alias("size"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        )
        # at most 4,096 rows (32,768 in the last level) of counts per pattern
        before = F.sum("size").over(
            Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        )
        crossed = (
            buckets.withColumn("upto", before)
            .where((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("size") < F.col("wanted")))
            .collect()
        )
        open_ = {}
        for r in crossed:
            short = r["wanted"] - (r["upto"] - r["size"])
            if r["low"] == r["high"] or left_bits == 0:
                made[r["pattern"]] = (r["high"], short / r["size"])
            else:
                open_[r["pattern"]] = (r["bucket"], short)
    return made


def mix(docs: DataFrame, sources: Column, size: Column, seed: int = SEED) -> DataFrame:
    """A row per document: doc (its columns), size, sources (name, size and target of each), copies, part.

    ``sources`` is an array of source names, of which null may be one; ``size``
    counts tokens. Copies are whole documents, 0 to ``MOST``, and ``part`` is the
    size of one more copy that is not whole; a document without any source is not
    taken.
    """
    spark = docs.sparkSession
    tables = Scratch(spark, "mixing")
    made = docs.select(
        F.struct("*").alias("doc"),
        F.coalesce(size, F.lit(0)).cast("long").alias("size"),
        F.array_sort(F.array_distinct(sources)).alias("names"),
        F.expr(f"shiftrightunsigned(xxhash64(doc_id, {seed}L), 1)").alias("hash"),
    ).withColumn("pattern", F.to_json("names"))
    small = made.where(F.size("names") > 0).select("pattern", "names", "size", "hash")
    sized = tables.table(small, "sizes")
    grouped = sized.groupBy("pattern").agg(F.first("names").alias("names"), F.sum("size").alias("size"))
    patterns = grouped.limit(MAX_PATTERNS + 1).collect()
    if len(patterns) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sets of sources; mix them by coarser sources")
    patterns.sort(key=lambda r: r["pattern"])
    sizes: dict[str | None, int] = {}
    for r in patterns:
        for s in r["names"]:
            sizes[s] = sizes.get(s, 0) + r["size"]
    whole = sum(r["size"] for r in patterns)
    goal = targets(sizes)
    names = list(goal)
    taken = route(
        [r["size"] for r in patterns],
        [[names.index(s) for s in r["names"]] for r in patterns],
        [round(goal[s]) for s in names],
    )
    passes = {r["pattern"]: divmod(t, r["size"]) if r["size"] else (0, 0) for r, t in zip(patterns, taken, strict=True)}
    assert sum(taken) <= MOST * whole
    ends = _ends(sized.select("pattern", "size", "hash"), {p: rest for p, (_, rest) in passes.items()})
    plan = spark.createDataFrame(
        [
            (r["pattern"], int(passes[r["pattern"]][0]), int(ends[r["pattern"]][0]), float(ends[r["pattern"]][1]),
             [(s, sizes[s], float(goal[s])) for s in r["names"]])
            for r in patterns
        ],
        T.StructType(
            [
                T.StructField("pattern", T.StringType()),
                T.StructField("passes", T.IntegerType()),
                T.StructField("end", T.LongType()),
                T.StructField("inside", T.DoubleType()),
                T.StructField(
                    "sources",
                    T.ArrayType(
                        T.StructType(
                            [T.StructField("name", T.StringType()), T.StructField("size", T.LongType()), T.StructField("target", T.DoubleType())]
                        )
                    ),
                ),
            ]
        ),
    )
    extra = (F.col("hash") < F.col("end")).cast("int")
    part = F.when(F.col("hash") == F.col("end"), F.floor(F.col("size") * F.col("inside") + 0.5))
    return made.join(F.broadcast(plan), "pattern", "left").select(  # at most MAX_PATTERNS rows
        "doc",
        "size",
        "sources",
        F.coalesce(F.col("passes") + extra, F.lit(0)).alias("copies"),
        F.coalesce(part, F.lit(0)).alias("part"),
    )


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document, each in its one source."""
    made = mix(docs.select("doc_id", "source", "text"), F.array("source"), n_words(F.col("text")))
    home = F.element_at("sources", 1)
    return made.select(
        "doc.doc_id",
        "size",
        home["size"].alias("source_size"),
        home["target"].alias("target"),
        (F.col("size") * F.col("copies") + F.col("part")).alias("taken"),
    )


def mixture(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, with the number of times as ``copies`` (in place of a column of that name).

    A part of a copy counts as one if it is at least half.
    """
    made = mix(docs, F.array("source"), n_words(F.col("text")))
    more = ((F.col("part") > 0) & (2 * F.col("part") >= F.col("size"))).cast("int")
    made = made.withColumn("copies", F.col("copies") + more).where(F.col("copies") > 0)
    return made.select(*[F.col("doc")[c].alias(c) for c in docs.columns if c != "copies"], "copies")
