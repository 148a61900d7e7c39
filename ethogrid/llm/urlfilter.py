"""URL filters: rules by host and path, and trust spread over the link graph for urls that no rule fits.

Hosts are nodes. A page gives edges from its host to the hosts of its absolute links, and, as sites
of one registered name share their fate, between a host and its parent name in both directions
(`www.a.example.net` and `a.example.net`, at least two labels), each counted by its pages. Trust is a
personalised PageRank from hosts whose pages the rules allow, distrust one over reversed edges from
hosts whose pages they block: what links to blocked hosts is distrusted. Both start from the share
of such pages and run `rounds` rounds. A host is blocked if its distrust exceeds `ratio` times its
trust; a host that neither reaches is allowed.

Scores are whole numbers, so the order of sums doesn't matter and reruns agree. Edges and scores are tables
that are joined and summed, with partial sums before each shuffle, so in those a host with a third of all pages is
one row a task. Pages get their host's verdict from a copy in each task while the scores of all hosts take `small`
bytes at most, which is checked; beyond, by a join in which Spark splits partitions that a host swells.

Null urls and those without '://' have an empty host and path, which no rule fits and which are
allowed; such pages give no edges. Null html has no links. Repeated rows give equal results. An empty table gives
no rows. Very long urls and pages are read whole. Only page_id, url and html are read, so other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ethogrid.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules (fixed values): verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


@dataclass(frozen=True)
class Params:
    rounds: int = 12
    #: Of 100 parts of a score, so many are passed on in each round.
    passed: int = 85
    ratio: int = 1
    #: The seeds' scores sum to about this.
    unit: int = 1 << 50
    #: Bytes of all hosts' scores up to which they are sent to every task that reads pages; beyond, pages are dealt by host.
    small: int = 8 << 20


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1)


def _ruled(host: Column, path: Column) -> Column:
    """The longest rule that fits, as a struct of rule and verdict, or null."""
    fits = None
    for verdict, name, start in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1])):
        here = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        what = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(here, what) if fits is None else fits.when(here, what)
    return fits


def edges(pages: DataFrame) -> DataFrame:
    """source, target and n of the host graph; pages has host and html."""
    linked = pages.where("host <> ''").select(
        F.col("host").alias("source"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r"""(?i)(?:href|src)\s*=\s*["']?(https?://[^\s"'<>]+)""")))).alias("link")
    )
    linked = linked.select("source", host_of(F.col("link")).alias("target")).where("target <> ''").groupBy("source", "target").agg(F.count("*").alias("n"))
    parent = F.regexp_extract("host", r"^[^.]+\.([^.]+\..+)$", 1)
    kin = pages.where("host <> ''").groupBy("host").agg(F.count("*").alias("n")).select("host", "n", parent.alias("parent")).where("parent <> ''")
    up, down = kin.select(F.col("host").alias("source"), F.col("parent").alias("target"), "n"), kin.select(F.col("parent").alias("source"), F.col("host").alias("target"), "n")
    return linked.unionByName(up).unionByName(down).where("source <> target").groupBy("source", "target").agg(F.sum("n").alias("n"))


def spread(graph: DataFrame, seeds: DataFrame, p: Params = Params()) -> DataFrame:
    """host, trust and distrust; seeds has host, allowed and blocked (pages). Both scores spread in one pass a round."""
    total = seeds.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()
    share = lambda c, n: F.expr(f"{c} * {p.unit // max(n or 0, 1)}") if n else F.lit(0).cast("long")
    start = seeds.select("host", share("allowed", total.a).alias("trust"), share("blocked", total.b).alias("distrust"))
    both = graph.select(F.lit(True).alias("trusting"), "source", "target", "n").union(graph.select(F.lit(False), "target", "source", "n"))
    out = both.groupBy("trusting", "source").agg(F.sum("n").alias("all"))
    both = cut(both.join(out, ["trusting", "source"]))
    start = cut(start.where("trust > 0 or distrust > 0"))
    score = start
    kept = 100 - p.passed
    base = start.select("host", F.expr(f"trust div 100 * {kept}").alias("trust"), F.expr(f"distrust div 100 * {kept}").alias("distrust"))
    # a node's score is passed on by edge counts; what a node without edges holds stays where the seeds are
    part = f"if(trusting, trust, distrust) div 100 * {p.passed}"
    for turn in range(p.rounds):
        moved = score.join(both.hint("merge"), F.col("host") == F.col("source")).select("target", "trusting", F.expr(f"cast(({part}) * (n / all) as long)").alias("part"))
        moved = moved.groupBy(F.col("target").alias("host")).agg(
            F.sum(F.when(F.col("trusting"), F.col("part")).otherwise(0)).alias("trust"), F.sum(F.when(F.col("trusting"), 0).otherwise(F.col("part"))).alias("distrust")
        )
        score = base.unionByName(moved).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        if turn % 4 == 3:
            score = cut(score)
    return score


def url_filter(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every row."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = rows.withColumn("ruled", _ruled(F.col("host"), F.col("path")))
    count = lambda v: F.sum(F.when(F.col("ruled.verdict") == v, 1).otherwise(0))
    seeds = ruled.where("host <> ''").groupBy("host").agg(count("allow").alias("allowed"), count("block").alias("blocked"))
    scores = spread(edges(rows), seeds, p)
    trust, distrust = F.coalesce("trust", F.lit(0)), F.coalesce("distrust", F.lit(0))
    by_host = F.when(distrust > p.ratio * trust, "block").otherwise("allow")
    size = scores.agg(F.sum(F.octet_length("host") + 64).alias("n")).first().n or 0
    side = F.broadcast(scores) if size <= p.small else scores.hint("merge")
    return ruled.drop("html").join(side, "host", "left").select(
        "page_id", "host", "path", F.col("ruled.rule").alias("rule"), F.coalesce("ruled.verdict", by_host).alias("verdict"), trust.alias("trust"), distrust.alias("distrust")
    )
