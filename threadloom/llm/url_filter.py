"""URL filters: link-graph propagation of trust and distrust between hosts.

Rules allow or block a host, its subdomains and a beginning of the path; the
longest that fits a page decides. Other pages get their host's verdict. Hosts
are nodes; an edge says how many pages of one host link to another. Trust runs
along the edges from hosts whose pages rules allow, distrust runs against them
from hosts whose pages rules block (who links to bad hosts is suspect), both as
personalised PageRank. A seed weighs the share of its pages that rules decide,
and scores are scaled so that an unlinked host has its own seed's weight. A host
is blocked if its distrust exceeds its trust by more than ``THRESHOLD``.

Edges are summed before they are shuffled, and both propagations share one
vector table, written between rounds until a round moves all scores of a kind
together by less than ``TOLERANCE``. The damping bounds the rounds that this needs.

A url that is null or has no ``://`` has an empty host and path, fits no rule and
is allowed. Relative links stay on their host and make no edge. Null html has no
links. Repeated pages count as often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.session import Scratch

DAMPING = 0.85
THRESHOLD = 0.3
TOLERANCE = 1e-6
#: Of the whole mass; sums of doubles settle no further.
LEAST_MOVE = 1e-12

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?is)<a\s[^>]*?\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a host followed by a beginning of the path, such as ``net/es/``."""

    verdict: str
    pattern: str

    def fits(self, host: Column, path: Column) -> Column:
        name, _, rest = self.pattern.partition("/")
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")


RULES = (
    Rule("allow", "com/"),
    Rule("block", "example.com/en/"),
    Rule("allow", "www.example.com/en/"),
    Rule("block", "net/es/"),
    Rule("block", "net/fr/"),
)


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(rules: tuple[Rule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """Pattern and verdict of the longest rule that fits, both null where none does."""
    ordered = sorted(rules, key=lambda r: (-len(r.pattern), r.pattern))
    pattern = verdict = F.lit(None).cast("string")
    for rule in reversed(ordered):
        fits = rule.fits(host, path)
        pattern = F.when(fits, rule.pattern).otherwise(pattern)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return pattern, verdict


def link_hosts(html: Column) -> Column:
    """Distinct hosts of the absolute links of a page."""
    found = F.regexp_extract_all(html, F.lit(_LINK), F.lit(1))
    return F.array_distinct(F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda h: F.translate(h, _UPPER, _LOWER)))


def propagate(edges: DataFrame, seeds: DataFrame, tables: Scratch) -> DataFrame:
    """(kind, host, mass) from ``edges`` (kind, src, dst, n) and ``seeds`` (kind, host, weight).

    Mass that meets a host without edges goes back to the seeds of its kind.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    shares = tables.table(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("share")), "shares")
    total = {r["kind"]: r["total"] for r in seeds.groupBy("kind").agg(F.sum("weight").alias("total")).collect()}
    scale = F.lit(1.0)
    for kind, value in total.items():
        scale = F.when(F.col("kind") == kind, F.lit(float(value) or 1.0)).otherwise(scale)
    seeds = tables.table(seeds.where("weight > 0").select("kind", "host", (F.col("weight") / scale).alias("seed")), "seeds")
    ranks = tables.table(seeds.select("kind", "host", F.col("seed").alias("mass")), "ranks")
    enough = {kind: max(TOLERANCE / (float(value) or 1.0), LEAST_MOVE) for kind, value in total.items()}
    # the first move is below 2, and each is at most DAMPING of the one before
    rounds = 2 + ceil(log(min(enough.values(), default=1.0) / 2) / log(DAMPING))
    for _ in range(rounds):
        moved = (
            shares.join(ranks, (shares["kind"] == ranks["kind"]) & (shares["src"] == ranks["host"]))
            .select(shares["kind"], F.col("dst").alias("host"), (F.col("mass") * F.col("share")).alias("got"))
            .groupBy("kind", "host")
            .agg(F.sum("got").alias("got"))
        )
        moved = tables.table(moved, "moved")
        arrived = {r["kind"]: r["got"] for r in moved.groupBy("kind").agg(F.sum("got").alias("got")).collect()}
        back = F.lit(1.0)
        for kind, value in arrived.items():
            back = F.when(F.col("kind") == kind, F.lit(max(0.0, 1.0 - value))).otherwise(back)
        seed, got = F.coalesce("seed", F.lit(0.0)), F.coalesce("got", F.lit(0.0))
        new = seeds.join(moved, ["kind", "host"], "full").select(
            "kind", "host", ((1 - DAMPING) * seed + DAMPING * (got + back * seed)).alias("mass")
        )
        new = tables.table(new, "ranks")
        change = {
            r["kind"]: r["change"]
            for r in new.join(ranks.withColumnRenamed("mass", "was"), ["kind", "host"], "full")
            .groupBy("kind")
            .agg(F.sum(F.abs(F.coalesce("mass", F.lit(0.0)) - F.coalesce("was", F.lit(0.0)))).alias("change"))
            .collect()
        }
        tables.drop(ranks)
        tables.drop(moved)
        ranks = new
        if all(value < enough[kind] for kind, value in change.items()):
            break
    else:
        raise RuntimeError(f"trust and distrust still move after {rounds} rounds: {change}")
    return ranks.select("kind", "host", (F.col("mass") * scale).alias("mass"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page."""
    tables = Scratch(pages.sparkSession, "url-filter")
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    rule, verdict = fitting(rules, F.col("host"), F.col("path"))
    plain = pages.select("page_id", "url", "html")
    placed = plain.select("page_id", host.alias("host"), path.alias("path"), link_hosts(F.col("html")).alias("links"))
    placed = tables.table(placed.withColumns({"rule": rule, "ruled": verdict}), "pages")

    hosts = placed.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("ruled") == "allow", 1)).alias("allowed"),
        F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked"),
    )
    seeds = hosts.select(
        "host", F.explode(F.create_map(F.lit("trust"), F.col("allowed") / F.col("n"), F.lit("distrust"), F.col("blocked") / F.col("n"))).alias("kind", "weight")
    )
    seeds = tables.table(seeds.select("kind", "host", "weight"), "weights")
    links = (
        placed.where("host <> ''")
        .select(F.col("host").alias("src"), F.explode("links").alias("dst"))
        .where("src <> dst")
        .groupBy("src", "dst")
        .agg(F.count("*").alias("n"))
    )
    links = tables.table(links, "links")
    edges = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").union(
        links.select(F.lit("distrust"), F.col("dst"), F.col("src"), "n")
    )
    mass = propagate(edges, seeds, tables)
    scores = mass.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("mass"))).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("mass"))).alias("distrust"),
    )
    scores = tables.table(
        scores.select("host", *[F.round(F.coalesce(c, F.lit(0.0)), 9).alias(c) for c in ("trust", "distrust")]), "scores"
    )
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_graph = F.when(distrust - trust > threshold, "block").otherwise("allow")
    return placed.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", by_graph).alias("verdict"), trust.alias("trust"), distrust.alias("distrust")
    )
