"""URL filter by propagation over the link graph of hosts, in DataFrame functions alone.

Rules judge the pages they fit. For all others, trust starts at hosts with allowed pages
and follows links (personalised PageRank); distrust starts at hosts with blocked pages and
follows links backwards, to those who point there. Each host is then held against a
threshold: it is blocked where distrust makes up at least ``BLOCK_SHARE`` of what
reached it. A host that nothing reached is allowed.

Pages are aggregated to host edges before anything is joined, and both propagations run as
one: a round is one join and one aggregation over (kind, host), written to shared
storage every few rounds, until the ranks stand still. Seeds weigh as their pages do and make up 1 in all; what hosts without
links would pass on goes back to the seeds. In the graph hosts stand without user names and ports.

A null url, and one without ``://``, has an empty host and path, fits no rule and is
allowed; null html has no links. Very long pages are read whole. Repeated rows are judged each on its own. Columns other than
``page_id``, ``url`` and ``html`` are not read. An empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import _common

#: Rules of the registered query: (verdict, rule); a rule is a host, then a path.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
DAMPING = 0.85
#: Rounds between writes. The propagation ends where the last round moved no more than ``TOLERANCE`` of the mass of 1 of either kind;
#: each round moves at most DAMPING of what the one before moved, so it always does.
WRITE_EVERY = 5
TOLERANCE = 1e-4
BLOCK_SHARE = 0.6

_LINK = r"(?i)(?:href|src)\s*+=\s*+[\"']?\s*+(?:https?:)?//([^/?#\"'>\s]+)"


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def parsed(df: DataFrame) -> DataFrame:
    """``df`` with ``host`` and ``path`` of its column ``url``."""
    rest = F.when(F.col("url").contains("://"), F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    host = _lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    return df.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit("")))


def ruled(df: DataFrame, rules=RULES) -> DataFrame:
    """``df`` with ``rule`` and ``by_rule``: the longest rule that fits host and path, and its verdict; else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is tried first: it wraps the others
        name, slash, rest = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("by_rule", verdict)


def site(host: Column) -> Column:
    """A host without user name and port."""
    return F.regexp_extract(host, r"^(?:.*@)?+([^:@]*)", 1)


def host_edges(pages: DataFrame) -> DataFrame:
    """(source, target, n): number of links between different hosts, from absolute links of all pages."""
    links = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(_LINK), F.lit(1))
    rows = pages.select(site(F.col("host")).alias("source"), F.explode(links).alias("link"))
    rows = rows.select("source", site(_lower(F.col("link"))).alias("target"))
    return rows.where("source != '' AND target != '' AND source != target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, rank) from ``seeds`` (kind, host, seed): personalised PageRank; ``trust`` follows edges, ``distrust`` goes against them.

    Mass that ends at hosts without links is left out of the rounds, and the ranks of a kind are scaled to 1 at the end: that is the
    same as sending it back to the seeds in each round.
    """
    both = edges.select(F.lit("trust").alias("kind"), F.col("source").alias("host"), F.col("target").alias("to"), "n").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("target").alias("host"), F.col("source").alias("to"), "n")
    )
    total = both.groupBy("kind", "host").agg(F.sum("n").alias("all"))
    share = _common.materialise(both.join(total, ["kind", "host"]).select("kind", "host", "to", (F.col("n") / F.col("all")).alias("share")))
    sums = seeds.groupBy("kind").agg(F.sum("seed").alias("sum"))
    start = _common.materialise(seeds.join(sums, "kind").select("kind", "host", ((1 - damping) * F.col("seed") / F.col("sum")).alias("rank")))
    rank, moved = start, 1.0
    while moved > tolerance:
        for _ in range(WRITE_EVERY):
            before = rank
            passed = share.join(rank, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("share") * F.col("rank") * damping).alias("rank"))
            rank = passed.unionByName(start).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        last = before.withColumnRenamed("rank", "was")
        rank = _common.materialise(rank.join(last, ["kind", "host"], "left").select("kind", "host", "rank", F.abs(F.col("rank") - F.coalesce("was", F.lit(0.0))).alias("moved")))
        moved = max([0.0, *(r["moved"] for r in rank.groupBy("kind").agg(F.sum("moved").alias("moved")).collect())])
        rank = rank.drop("moved")
    sums = rank.groupBy("kind").agg(F.sum("rank").alias("sum"))
    return rank.join(sums, "kind").select("kind", "host", (F.col("rank") / F.col("sum")).alias("rank"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every page."""
    rows = ruled(parsed(pages.select("page_id", "url", "html")), rules)
    rows = rows.withColumn("site", site(F.col("host")))
    by_host = rows.where("site != ''").groupBy(F.col("site").alias("host")).agg(F.count_if(F.col("by_rule") == "allow").alias("trust"), F.count_if(F.col("by_rule") == "block").alias("distrust"))
    seeds = by_host.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "n"))
    seeds = seeds.where("n > 0").select("kind", "host", F.col("n").cast("double").alias("seed"))
    rank = propagate(_common.materialise(host_edges(rows)), seeds)
    total = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0)).alias(kind)
    hosts = rank.groupBy("host").agg(total("trust"), total("distrust"))
    judged = rows.select("page_id", "host", "path", "rule", "by_rule", "site").join(hosts.withColumnRenamed("host", "site"), "site", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    blocked = (distrust > 0) & (distrust >= BLOCK_SHARE * (trust + distrust))
    verdict = F.coalesce("by_rule", F.when(blocked, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_common.table(spark, sf_dir, "pages"))
