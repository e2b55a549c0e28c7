"""Communities by modularity: nodes move in parallel, communities become nodes, and so on (Blondel et al., 2008), all snapshots at once.

The gain of every move is one join of links and states. Two moves that share no community add up exactly, so of all
moves those that are the best of both communities they touch make a set that never lowers modularity. A larger set,
every mover of one half of the nodes, is tried beside it and taken by a snapshot only where its modularity, which is computed, is higher. Ties
go to the smaller community and the smaller node. A round is a fixed number of joins and aggregates over links and nodes, whatever
their number; every round is written to the shared folder, and only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.operators.network import mirrored
from riskweave.sources.scratch import forget, materialise

#: Gains are told apart to so many digits, so that the order of sums decides nothing.
DIGITS = 11
#: Rounds of one level and levels, after which an error is raised.
ROUNDS = 500
LEVELS = 50


def _quality(links: DataFrame, nodes: DataFrame, by: list[str], label: str) -> DataFrame:
    """(by, quality): modularity of the labels that column ``label`` of ``nodes`` (by, node, k, loop, two_m) gives."""
    at = lambda end, name: nodes.select(*by, F.col("node").alias(end), F.col(label).alias(name))
    inside = links.join(at("s", "_a"), [*by, "s"]).join(at("t", "_b"), [*by, "t"]).where("_a = _b").groupBy(*by).agg(F.sum("w").alias("_in"))
    squares = nodes.groupBy(*by, label).agg(F.sum("k").alias("_k"), F.sum("loop").alias("_loop"), F.first("two_m").alias("_m"))
    squares = squares.groupBy(*by).agg(F.sum(F.col("_k") * F.col("_k")).alias("_squares"), F.sum("_loop").alias("_loops"), F.first("_m").alias("_m"))
    out = squares.join(inside, by, "left")
    return out.select(*by, ((F.coalesce("_in", F.lit(0.0)) + F.col("_loops")) / F.col("_m") - F.col("_squares") / (F.col("_m") * F.col("_m"))).alias("quality"))


def modularity(edges: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    """(by, quality) of ``labels`` (by, node, community) over undirected ``edges`` (by, s, t, c)."""
    links, nodes = map(materialise, _network(edges, by))
    return _quality(links, nodes.join(labels, [*by, "node"]), by, "community")


def _network(edges: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Links (by, s, t, w) in both directions and nodes (by, node, k, loop, two_m); weights of a pair add up, those not positive are left out."""
    rows = edges.select(*by, "s", "t", F.col("c").cast("double").alias("w")).where("w > 0")
    links = mirrored(rows.where("s != t")).groupBy(*by, "s", "t").agg(F.sum("w").alias("w"))
    loops = rows.where("s = t").select(*by, F.col("s").alias("node"), F.lit(0.0).alias("w"), (2 * F.col("w")).alias("loop"))
    ends = links.select(*by, F.col("s").alias("node"), "w", F.lit(0.0).alias("loop")).unionByName(loops)
    nodes = ends.groupBy(*by, "node").agg((F.sum("w") + F.sum("loop")).alias("k"), F.sum("loop").alias("loop"))
    return links, nodes.join(nodes.groupBy(*by).agg(F.sum("k").alias("two_m")), by)


def _moves(links: DataFrame, nodes: DataFrame, by: list[str], half: Column) -> DataFrame:
    """(by, node, to, gain, safe, half): the best move of each node that gains, and whether it is the best of both its communities."""
    state = nodes.select(*by, "node", "k", "c", "two_m")
    there = links.join(nodes.select(*by, F.col("node").alias("t"), F.col("c").alias("to")), [*by, "t"]).groupBy(*by, F.col("s").alias("node"), "to").agg(F.sum("w").alias("w"))
    rows = there.join(state, [*by, "node"])
    own = rows.where(F.col("to") == F.col("c")).select(*by, "node", F.col("w").alias("_own"))
    total = nodes.groupBy(*by, "c").agg(F.sum("k").alias("_total"))
    rows = rows.where(F.col("to") != F.col("c")).join(own, [*by, "node"], "left")
    rows = rows.join(total.withColumnsRenamed({"c": "to", "_total": "_into"}), [*by, "to"]).join(total.withColumnRenamed("_total", "_from"), [*by, "c"])
    gain = 2 * (F.col("w") - F.coalesce("_own", F.lit(0.0))) / F.col("two_m") - 2 * F.col("k") * (F.col("_into") - F.col("_from") + F.col("k")) / (F.col("two_m") * F.col("two_m"))
    rows = rows.withColumn("gain", F.round(gain, DIGITS)).where("gain > 0")
    best = rows.groupBy(*by, "node").agg(F.min(F.struct((-F.col("gain")).alias("less"), "to", "c")).alias("m")).select(*by, "node", "m.to", "m.c", (-F.col("m.less")).alias("gain"))
    best = materialise(best)
    hubs = best.select(*by, "node", "gain", F.explode(F.array("to", "c")).alias("hub")).groupBy(*by, "hub").agg(F.min(F.struct((-F.col("gain")).alias("less"), "node")).alias("m"))
    safe = hubs.groupBy(*by, F.col("m.node").alias("node")).agg((F.count(F.lit(1)) == 2).alias("safe"))
    return materialise(best.join(safe, [*by, "node"], "left").select(*by, "node", "to", "gain", F.coalesce("safe", F.lit(False)).alias("safe"), half.alias("half")))


def _settled(links: DataFrame, nodes: DataFrame, by: list[str]) -> tuple[DataFrame, bool]:
    """``nodes`` (by, node, k, loop, two_m) with ``c``, their community when no move gains, and whether any node has moved."""
    now = materialise(nodes.withColumn("c", F.col("node")))
    for turn in range(ROUNDS):
        moves = _moves(links, now, by, F.pmod(F.xxhash64(F.col("node"), F.lit(turn)), F.lit(2)) == 0)
        if moves.isEmpty():
            return now, turn > 0
        rows = now.join(moves, [*by, "node"], "left")
        rows = rows.withColumn("_few", F.when(F.col("safe"), F.col("to")).otherwise(F.col("c"))).withColumn("_many", F.when(F.col("half"), F.col("to")).otherwise(F.col("c")))
        rows = materialise(rows.drop("to", "gain", "safe", "half"))
        few, many = (_quality(links, rows, by, label).withColumnRenamed("quality", label) for label in ("_few", "_many"))
        better = few.withColumnRenamed("_few", "_q").join(many.withColumnRenamed("_many", "_r"), by).select(*by, (F.round("_r", DIGITS) > F.round("_q", DIGITS)).alias("_bulk"))
        before, now = now, materialise(rows.join(better, by).withColumn("c", F.when(F.col("_bulk"), F.col("_many")).otherwise(F.col("_few"))).select(*now.columns))
        forget(before, rows, moves)
    raise RuntimeError(f"communities did not settle in {ROUNDS} rounds")


def louvain(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, community, level, quality) of undirected edges (by, s, t, c): one row a node and level, communities named by their least node.

    Level 0 has each node alone; of the levels that follow each has a higher modularity than the one before in some snapshot and a lower one in none.
    Pairs that repeat, in either direction, add up; weights that aren't positive are left out, and so are nodes without any other.
    """
    links, nodes = _network(edges, by)
    links, nodes = materialise(links), materialise(nodes)
    home = materialise(nodes.select(*by, "node", F.col("node").alias("community")))
    out = home.withColumn("level", F.lit(0)).join(_quality(links, nodes.withColumn("community", F.col("node")), by, "community"), by)
    for level in range(1, LEVELS):
        settled, moved = _settled(links, nodes, by)
        if not moved:
            return out
        least = settled.groupBy(*by, "c").agg(F.min("node").alias("_least"))
        name = materialise(settled.join(least, [*by, "c"]).select(*by, "node", F.col("_least").alias("to"), "k", "loop", "two_m"))
        quality = _quality(links, name, by, "to")
        home = materialise(home.withColumnRenamed("community", "_at").join(name.select(*by, F.col("node").alias("_at"), F.col("to").alias("community")), [*by, "_at"]).select(*by, "node", "community"))
        out = out.unionByName(home.withColumn("level", F.lit(level)).join(materialise(quality), by))
        ends = lambda end: name.select(*by, F.col("node").alias(end), F.col("to").alias(f"_{end}"))
        both = links.join(ends("s"), [*by, "s"]).join(ends("t"), [*by, "t"]).groupBy(*by, "_s", "_t").agg(F.sum("w").alias("w"))
        both = materialise(both.select(*by, F.col("_s").alias("s"), F.col("_t").alias("t"), "w"))
        within = both.where("s = t").select(*by, F.col("s").alias("node"), F.col("w").alias("_w"))
        merged = name.groupBy(*by, F.col("to").alias("node")).agg(F.sum("k").alias("k"), F.sum("loop").alias("loop"), F.first("two_m").alias("two_m"))
        nodes = materialise(merged.join(within, [*by, "node"], "left").withColumn("loop", F.col("loop") + F.coalesce("_w", F.lit(0.0))).drop("_w"))
        links = both.where("s != t")
    raise RuntimeError(f"communities did not settle in {LEVELS} levels")


def communities(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, community, quality): the last level of ``louvain``."""
    rows = louvain(edges, by)
    last = rows.groupBy(*by).agg(F.max("level").alias("level"))
    return rows.join(last, [*by, "level"]).select(*by, "node", "community", "quality")
