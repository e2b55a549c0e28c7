"""Networks as edge lists (source, target, weight), directed unless said otherwise."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.columns import correlation
from riskweave.sources.scratch import forget, materialise


def mirrored(edges: DataFrame, s: str = "s", t: str = "t") -> DataFrame:
    """An undirected edge list in both directions."""
    rest = [c for c in edges.columns if c not in (s, t)]
    return edges.select(s, t, *rest).unionByName(edges.select(F.col(t).alias(s), F.col(s).alias(t), *rest))


def degree_normalised(edges: DataFrame, by: list[str]) -> DataFrame:
    """weight / sqrt(out-strength * in-strength) within each group; a strength of zero counts as one."""
    one = lambda c: F.when(c == 0, 1.0).otherwise(c)
    out = one(F.sum("weight").over(Window.partitionBy(*by, "source")))
    into = one(F.sum("weight").over(Window.partitionBy(*by, "target")))
    return edges.withColumn("weight", F.col("weight") / (F.sqrt(out) * F.sqrt(into)))


def densified(edges: DataFrame, by: list[str]) -> DataFrame:
    """Every ordered pair of a group's sources and targets, 0 where there is no edge: the shape of a matrix, by name."""
    s = edges.select(*by, "source").distinct()
    t = edges.select(*by, "target").distinct()
    return s.join(t, by).join(edges, [*by, "source", "target"], "left").na.fill(0.0, ["weight"])


def standardised(edges: DataFrame, by: list[str]) -> DataFrame:
    """(weight - mean) / population deviation within each group; deviation zero counts as one."""
    w = Window.partitionBy(*by)
    sd = F.stddev_pop("weight").over(w)
    return edges.withColumn("weight", (F.col("weight") - F.avg("weight").over(w)) / F.when(sd == 0, 1.0).otherwise(sd))


def over(edges: DataFrame, threshold: float) -> DataFrame:
    """Edges whose weight is above the threshold, strictly and with its sign."""
    return edges.where(F.col("weight") > threshold)


def cut(edges: DataFrame, threshold: float) -> DataFrame:
    """Weights nearer to zero than the threshold become zero."""
    return edges.withColumn("weight", F.when(F.abs("weight") < threshold, 0.0).otherwise(F.col("weight")))


def degrees(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, k, strength) of an edge list in both directions (s, t, c)."""
    return edges.groupBy(*by, F.col("s").alias("node")).agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("strength"))


def density(edges: DataFrame, by: list[str], nodes: int) -> DataFrame:
    """Undirected edges of all possible ones, from edges in one direction."""
    possible = nodes * (nodes - 1) / 2
    return edges.groupBy(*by).agg(F.count(F.lit(1)).alias("edges"), (F.count(F.lit(1)) / possible).alias("density"), F.avg("c").alias("mean_c"))


def laplacian(edges: DataFrame, by: list[str], normalised: bool = True) -> DataFrame:
    """(by, i, j, v) of I - D^-1/2 A D^-1/2, or of D - A, from edges in both directions (s, t, c)."""
    deg = edges.groupBy(*by, F.col("s").alias("i")).agg(F.sum("c").alias("deg"))
    off = edges.select(*by, F.col("s").alias("i"), F.col("t").alias("j"), "c")
    if not normalised:
        return off.select(*by, "i", "j", (-F.col("c")).alias("v")).unionByName(deg.select(*by, "i", F.col("i").alias("j"), F.col("deg").alias("v")))
    dj = deg.withColumnsRenamed({"i": "j", "deg": "dj"})
    off = off.join(deg, [*by, "i"]).join(dj, [*by, "j"]).select(*by, "i", "j", (-F.col("c") / F.sqrt(F.col("deg") * F.col("dj"))).alias("v"))
    return off.unionByName(deg.select(*by, "i", F.col("i").alias("j"), F.lit(1.0).alias("v")))


def clustering(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, cc): closed pairs of neighbours of all pairs, 0 under two neighbours; edges in both directions."""
    deg = edges.groupBy(*by, F.col("s").alias("node")).agg(F.count(F.lit(1)).alias("k"))
    up = edges.where("s < t").select(*by, "s", "t")
    # each triangle once, as a < b < c
    tri = (
        up.select(*by, F.col("s").alias("a"), F.col("t").alias("b"))
        .join(up.select(*by, F.col("s").alias("b"), F.col("t").alias("c")), [*by, "b"])
        .join(up.select(*by, F.col("s").alias("a"), F.col("t").alias("c")), [*by, "a", "c"])
    )
    seen = tri.select(*by, F.explode(F.array("a", "b", "c")).alias("node")).groupBy(*by, "node").agg(F.count(F.lit(1)).alias("tri"))
    rate = 2 * F.coalesce("tri", F.lit(0)) / (F.col("k") * (F.col("k") - 1))
    return deg.join(seen, [*by, "node"], "left").select(*by, "node", F.when(F.col("k") < 2, 0.0).otherwise(rate).alias("cc"))


def assortativity(edges: DataFrame, by: list[str]) -> DataFrame:
    """Correlation of the degrees at the two ends of each directed edge; 0 under four edges or without spread."""
    deg = edges.groupBy(*by, F.col("s").alias("node")).agg(F.count(F.lit(1)).cast("double").alias("k"))
    rows = edges.select(*by, "s", "t").join(deg.withColumnsRenamed({"node": "s", "k": "ks"}), [*by, "s"]).join(deg.withColumnsRenamed({"node": "t", "k": "kt"}), [*by, "t"])
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("ks").alias("sd"), correlation("ks", "kt").alias("c"))
    return out.select(*by, F.when((F.col("n") < 4) | (F.col("sd") < 1e-12), 0.0).otherwise(F.coalesce("c", F.lit(0.0))).alias("assortativity"))


def pagerank(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-9, rounds: int = 8, most: int = 400) -> DataFrame:
    """(node, rank) of weighted edges (source, target, weight); a node without edges out spreads to all.

    What such nodes spread and what jumps anywhere both go to all nodes alike, so the rank is, up to its sum, the solution of y = 1 + damping * (shares of y): a round is one
    join and one sum. Every ``rounds`` of them are written, until no two ranks have grown by factors over these that differ by more than ``tolerance``; ``most`` rounds without that are an error.
    """
    edges = materialise(edges.select("source", "target", "weight"))
    nodes = materialise(edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("target").alias("node"))).distinct())
    out = edges.groupBy("source").agg(F.sum("weight").alias("_all"))
    share = materialise(edges.groupBy("source", "target").agg(F.sum("weight").alias("_w")).join(out, "source").select("source", "target", (damping * F.col("_w") / F.col("_all")).alias("share")))
    one = nodes.withColumn("y", F.lit(1.0))
    rank = one.withColumnRenamed("y", "rank")
    for _ in range(0, most, rounds):
        y = rank.withColumnRenamed("rank", "y")
        for _ in range(rounds):
            passed = share.join(y.withColumnRenamed("node", "source"), "source").select(F.col("target").alias("node"), (F.col("share") * F.col("y")).alias("y"))
            y = one.unionByName(passed).groupBy("node").agg(F.sum("y").alias("y"))
        before, rank = rank, materialise(y.withColumnRenamed("y", "rank"))
        grown = F.col("rank") / F.col("_old")
        seen = rank.join(before.withColumnRenamed("rank", "_old"), "node").agg(F.sum("rank").alias("total"), F.min(grown).alias("low"), F.max(grown).alias("high")).first()
        if seen["total"] is None or seen["high"] / seen["low"] - 1 <= tolerance:
            return rank.withColumn("rank", F.col("rank") / F.lit(seen["total"]))
    raise RuntimeError(f"ranks did not settle in {most} rounds")


def distances(correlations: DataFrame) -> DataFrame:
    """``dist`` = sqrt(2 (1 - c))."""
    return correlations.withColumn("dist", F.sqrt(2 * (1 - F.least(F.col("c"), F.lit(1.0)))))


def spanning_tree(edges: DataFrame, by: str, value: str = "dist") -> DataFrame:
    """Kruskal's tree of each group's undirected edges (s, t, value), one group a task; ties go to smaller ends."""
    import pandas as pd

    def tree(group: pd.DataFrame) -> pd.DataFrame:
        parent: dict = {}

        def top(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        kept = []
        for row in group.sort_values([value, "s", "t"]).itertuples(index=False):
            a, b = top(row.s), top(row.t)
            if a != b:
                parent[a] = b
                kept.append(row)
        return pd.DataFrame(kept, columns=group.columns)

    rows = edges.select(by, "s", "t", value)
    return rows.groupBy(by).applyInPandas(tree, rows.schema)


def spanning_forest(edges: DataFrame, by: str, value: str = "dist") -> DataFrame:
    """(by, s, t, value): the edges of least value that join what can be joined in each group, by Borůvka's rounds; ties go to smaller ends.

    A round takes the least edge of every part at once and merges what these join, so parts at least halve; no group is held by a task. Edges that repeat, in either direction, count once, by their least value.
    """
    ends = [F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")]
    rows = edges.where(f"s != t AND {value} IS NOT NULL").select(by, *ends, F.col(value).alias("v")).groupBy(by, "a", "b").agg(F.min("v").alias("v"))
    rows, tree = materialise(rows.select(by, "a", "b", F.struct("v", F.col("a").alias("s"), F.col("b").alias("t")).alias("e"))), None
    while not rows.isEmpty():
        both = rows.select(by, "a", "b", "e").unionByName(rows.select(by, F.col("b").alias("a"), F.col("a").alias("b"), "e"))
        best = materialise(both.groupBy(by, "a").agg(F.min(F.struct("e", "b")).alias("m")).select(by, F.col("a").alias("part"), "m.e", F.col("m.b").alias("up")))
        taken = best.select(by, "e.s", "e.t", F.col("e.v").alias(value)).distinct()
        tree = taken if tree is None else tree.unionByName(taken)
        # two parts that chose each other: the smaller one is where the merged part hangs
        back = best.select(by, F.col("part").alias("up"), F.col("up").alias("_back"))
        up = materialise(best.join(back, [by, "up"]).select(by, "part", F.when((F.col("_back") == F.col("part")) & (F.col("part") < F.col("up")), F.col("part")).otherwise(F.col("up")).alias("up")))
        while True:
            further = up.join(up.select(by, F.col("part").alias("up"), F.col("up").alias("_next")), [by, "up"])
            if further.where("_next != up").isEmpty():
                break
            up = materialise(further.select(by, "part", F.col("_next").alias("up")))
        at = lambda end: up.select(by, F.col("part").alias(end), F.col("up").alias(f"_{end}"))  # noqa: E731, B023
        merged = rows.join(at("a"), [by, "a"]).join(at("b"), [by, "b"]).where("_a != _b")
        before, rows = rows, materialise(merged.groupBy(by, F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg(F.min("e").alias("e")))
        forget(before)
    if tree is None:
        return edges.where("false").select(by, "s", "t", value)
    return tree


def stability(edges: DataFrame, time: str = "d") -> DataFrame:
    """(d, kept, before, stability): edges of the period before that are still there."""
    steps = edges.select(time).distinct().withColumn("_prev", F.lag(time).over(Window.orderBy(time)))
    now = edges.select(time, "s", "t").join(steps, time)
    old = edges.select(F.col(time).alias("_prev"), "s", "t", F.lit(1).alias("_was"))
    kept = now.join(old, ["_prev", "s", "t"]).groupBy(time).agg(F.count(F.lit(1)).alias("kept"))
    before = edges.groupBy(F.col(time).alias("_prev")).agg(F.count(F.lit(1)).alias("before"))
    out = steps.where("_prev IS NOT NULL").join(before, "_prev").join(kept, time, "left")
    return out.select(time, F.coalesce("kept", F.lit(0)).alias("kept"), "before", (F.coalesce("kept", F.lit(0)) / F.col("before")).alias("stability"))


def weight_changes(edges: DataFrame, time: str = "d") -> DataFrame:
    """(d, s, t, delta): weight less that of the period before, missing edges as 0."""
    steps = edges.select(time).distinct().withColumn("_next", F.lead(time).over(Window.orderBy(time)))
    old = edges.join(steps, time).where("_next IS NOT NULL").select(F.col("_next").alias(time), "s", "t", F.col("c").alias("_old"))
    first = steps.agg(F.min(time).alias("_first"))
    both = edges.select(time, "s", "t", "c").join(old, [time, "s", "t"], "full").join(F.broadcast(first)).where(F.col(time) > F.col("_first"))
    return both.select(time, "s", "t", (F.coalesce("c", F.lit(0.0)) - F.coalesce("_old", F.lit(0.0))).alias("delta"))


def quotient(edges: DataFrame, cluster: DataFrame) -> DataFrame:
    """(cs, ct, weight): edge weights summed between different clusters (node, cluster)."""
    a = cluster.select(F.col("node").alias("source"), F.col("cluster").alias("cs"))
    b = cluster.select(F.col("node").alias("target"), F.col("cluster").alias("ct"))
    return edges.join(a, "source").join(b, "target").where("cs != ct").groupBy("cs", "ct").agg(F.sum("weight").alias("weight")).where("weight > 0")


def threshold_grid(correlations: DataFrame, grid: DataFrame, nodes: int, by: list[str]) -> DataFrame:
    """Edges, density and description length of each threshold of ``grid`` (thr), from pairs i < j (c).

    The length is edges * ln(nodes) plus the squares below the threshold, in both directions.
    """
    kept = F.abs("c") >= F.col("thr")
    out = correlations.join(F.broadcast(grid)).groupBy(*by, "thr").agg(F.count_if(kept).alias("edges"), F.sum(F.when(kept, 0.0).otherwise(2 * F.col("c") * F.col("c"))).alias("below"))
    return out.select(*by, "thr", "edges", (F.col("edges") / (nodes * (nodes - 1) / 2)).alias("density"), (F.col("edges") * F.log(F.lit(float(nodes))) + F.col("below")).alias("mdl"))


def _unit_sums(rows: DataFrame, own: list[str], vector: str) -> DataFrame:
    """(own, at, x, square): sums of unit vectors by place, and in place 0 of their squared lengths; a task sums each batch before anything is shuffled."""
    kind = dict(rows.dtypes)

    def run(frames):
        for frame in frames:
            for key, part in frame.groupby(own):
                m = np.stack(part[vector].to_numpy()).astype(float)
                with np.errstate(divide="ignore", invalid="ignore"):
                    u = m / np.sqrt((m * m).sum(1))[:, None]
                yield pd.DataFrame({**dict(zip(own, ([k] for k in key), strict=True)), "sums": [u.sum(0)], "square": [float((u * u).sum())]})

    parts = rows.select(*own, vector).mapInPandas(run, ", ".join(f"{c} {kind[c]}" for c in own) + ", sums array<double>, square double")
    nan = lambda c: F.coalesce(c, F.lit(float("nan"))).alias(c)  # noqa: E731 (pandas hands NaN over as null)
    each = parts.select(*own, F.posexplode("sums").alias("at", "x"), "square").select(*own, "at", nan("x"), nan("square"))
    return each.groupBy(*own, "at").agg(F.sum("x").alias("x"), F.sum(F.when(F.col("at") == 0, F.col("square")).otherwise(0.0)).alias("square"))


def mean_cosine(rows: DataFrame, by: str, key: str, vector: str) -> DataFrame:
    """(by, links, mean): number and mean cosine of all pairs of rows of a group with different keys, without forming a pair.

    Cosines of all pairs add up to half of what the squared sum of unit vectors exceeds the squared sums of each key's own. Vectors that are null, empty or hold a null count as links but have no cosine, nor have two of
    different lengths; a vector of zeros makes the mean NaN.
    """
    whole = (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull())
    held = rows.where(F.col(by).isNotNull() & F.col(key).isNotNull()).select(by, key, vector, F.when(whole, F.size(vector)).alias("_size"))
    counts = held.groupBy(by, key, "_size").agg(F.count(F.lit(1)).alias("_n"))
    square = lambda c: F.sum(F.col(c) * F.col(c))
    links = counts.groupBy(by, key).agg(F.sum("_n").alias("_n")).groupBy(by).agg(F.sum("_n").alias("_all"), square("_n").alias("_own"))
    links = links.select(by, F.expr("(_all * _all - _own) div 2").alias("links")).where("links > 0")
    pairs = counts.where("_size IS NOT NULL").groupBy(by, "_size").agg(F.sum("_n").alias("_all"), square("_n").alias("_own"))
    pairs = pairs.groupBy(by).agg(F.sum(F.expr("(_all * _all - _own) div 2")).alias("_pairs"))
    # a key that stands once has a unit vector for its sum; for the others their squared sums take the place of their squares
    again = materialise(counts.where("_size IS NOT NULL AND _n > 1").select(by, key, "_size"))
    held = held.where("_size IS NOT NULL")
    all_ = _unit_sums(held, [by, "_size"], vector).select(by, (F.col("x") * F.col("x") - F.col("square")).alias("_v"))
    own = _unit_sums(held.join(again, [by, key, "_size"]), [by, key, "_size"], vector).select(by, (F.col("square") - F.col("x") * F.col("x")).alias("_v"))
    total = all_.unionByName(own).groupBy(by).agg(F.sum("_v").alias("_v"))
    return links.join(pairs, by, "left").join(total, by, "left").select(by, "links", F.when(F.col("_pairs") > 0, F.col("_v") / 2 / F.col("_pairs")).alias("mean"))
