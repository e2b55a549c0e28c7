"""Clusters of spectral embeddings and renormalisation by repeated coarse-graining, all snapshots advanced together.

k-means runs as grouped aggregates: every snapshot and every start is a key, and one round assigns all points and averages all
centres at once. Starts come from hashes of start and node. Renormalisation iterates clustering and contraction; a snapshot ends at its own depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.operators import network as net, spectral
from riskweave.sources.scratch import forget, materialise

#: Squared distances are told apart to so many digits, so that the order of sums decides nothing.
DIGITS = 10


def _apart(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v)


def k_means(points: DataFrame, by: str, starts: int = 10, rounds: int = 100) -> DataFrame:
    """(by, node, cluster, inertia): the best of ``starts`` runs of Lloyd's rounds for each snapshot of ``points`` (by, node, x, k).

    ``x`` is an array of one length within a snapshot and ``k`` the number of clusters there, cut to that of its nodes. A run starts from the nodes of least hash; a centre that loses all its points stays where it is. Clusters are numbered from 0 in the order of
    their least node; ties go to the lower centre and the earlier start.
    """
    run = [by, "start"]
    dealt = points.select(by, "node", "x", "k", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))).alias("start"))
    seeded = dealt.groupBy(*run).agg(F.first("k").alias("k"), F.sort_array(F.collect_list(F.struct(F.xxhash64(F.col("node").cast("string"), "start").alias("h"), "node", "x"))).alias("all"))
    centres = materialise(seeded.select(*run, F.slice(F.col("all.x"), F.lit(1), F.col("k").cast("int")).alias("centres")))
    points = materialise(points.select(by, "node", "x"))
    mark = None
    for _ in range(rounds):
        near = F.array_min(F.transform("centres", lambda c, j: F.struct(F.round(_apart(F.col("x"), c), DIGITS).alias("away"), j.alias("cluster"))))
        held = points.join(centres, by).select(*run, "node", "x", near.alias("m")).select(*run, "node", "x", "m.cluster", "m.away")
        held = materialise(held)
        new = held.agg(F.bit_xor(F.xxhash64(by, "start", "node", "cluster"))).first()[0]
        if new == mark:
            break
        mark = new
        means = held.select(*run, "cluster", F.posexplode("x").alias("dim", "v")).groupBy(*run, "cluster", "dim").agg(F.avg("v").alias("v"))
        means = means.groupBy(*run, "cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "v"))), lambda s: s["v"]).alias("c"))
        means = means.groupBy(*run).agg(F.map_from_entries(F.collect_list(F.struct("cluster", "c"))).alias("means"))
        before, centres = centres, materialise(centres.join(means, run).select(*run, F.transform("centres", lambda c, j: F.coalesce(F.try_element_at("means", j), c)).alias("centres")))
        forget(before, held)
    inertia = held.groupBy(*run).agg(F.round(F.sum("away"), DIGITS - 2).alias("inertia"))
    best = inertia.groupBy(by).agg(F.min(F.struct("inertia", "start")).alias("m")).select(by, "m.inertia", "m.start")
    rows = held.join(best, run).select(by, "node", "cluster", "inertia")
    least = rows.groupBy(by, "cluster").agg(F.min("node").alias("_least"))
    order = least.groupBy(by).agg(F.sort_array(F.collect_list("_least")).alias("_order"))
    named = least.join(order, by).select(by, "cluster", (F.array_position("_order", F.col("_least")) - 1).cast("long").alias("_name"))
    return rows.join(named, [by, "cluster"]).select(by, "node", F.col("_name").alias("cluster"), "inertia")


def embedded(mode_rows: DataFrame, by: str, sizes: DataFrame) -> DataFrame:
    """(by, node, x, k): components of modes 1 to k of each node, scaled to length one; ``sizes`` (by, k)."""
    rows = mode_rows.join(sizes, by).where((F.col("mode") >= 1) & (F.col("mode") <= F.col("k")))
    x = F.transform(F.sort_array(F.collect_list(F.struct("mode", "v"))), lambda s: s["v"])
    rows = rows.groupBy(by, "node").agg(x.alias("x"), F.first("k").alias("k"))
    size = F.sqrt(F.aggregate("x", F.lit(0.0), lambda t, v: t + v * v))
    return rows.withColumn("_size", size).select(by, "node", F.transform("x", lambda v: v / F.greatest(F.col("_size"), F.lit(1e-12))).alias("x"), "k")


def spectral_clusters(mode_rows: DataFrame, by: str, sizes: DataFrame, starts: int = 10) -> DataFrame:
    """(by, node, cluster) for the number of clusters ``k`` that ``sizes`` (by, k) gives a snapshot: signs of the second mode for two, k-means of embeddings for more, one cluster else."""
    two = spectral.fiedler_sides(mode_rows.join(sizes.where("k = 2"), by, "left_semi"), by).withColumnRenamed("side", "cluster")
    one = mode_rows.join(sizes.where("k < 2"), by, "left_semi").where("mode = 0").select(by, "node", F.lit(0).cast("long").alias("cluster"))
    more = k_means(embedded(mode_rows, by, sizes.where("k > 2")), by, starts).select(by, "node", "cluster")
    return two.unionByName(one).unionByName(more)


def renormalised(edges: DataFrame, by: str, steps: int = 5, starts: int = 10) -> tuple[DataFrame, DataFrame]:
    """What repeated halving does to each snapshot of undirected edges (by, s, t, c).

    (by, step, nodes, edges, lambda_2, radius, density), and (by, step, node, cluster): which node of a step goes to which of the next. A snapshot ends when
    two nodes are left. Clusters, half as many as nodes and two at least, are those of the slow modes of the Laplacian, and become nodes joined by the sum of what joined their members. Where a
    node has no weight, 0.01 is put between every two nodes first.
    """
    now = materialise(edges.select(by, F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t"), F.col("c").cast("double").alias("c")).where("s != t").groupBy(by, "s", "t").agg(F.sum("c").alias("c")))
    nodes = materialise(now.select(by, F.explode(F.array("s", "t")).alias("node")).distinct())
    told, went = None, None
    for step in range(steps):
        size = nodes.groupBy(by).agg(F.count(F.lit(1)).alias("n")).where("n > 2")
        if size.isEmpty():
            break
        weight = net.degrees(net.mirrored(now.select(by, "s", "t", "c")), [by])
        weak = nodes.join(weight, [by, "node"], "left").where("coalesce(strength, 0) < 1e-10").select(by).distinct()
        a, b = (nodes.join(weak, by, "left_semi").select(by, F.col("node").alias(x)) for x in "st")
        filled = a.join(b, by).where("s < t").select(by, "s", "t", F.lit(0.01).alias("c"))
        now = materialise(now.unionByName(filled).groupBy(by, "s", "t").agg(F.sum("c").alias("c")).where("c != 0").join(size.select(by), by, "left_semi"))
        mode_rows = materialise(spectral.modes(now, by, normalised=False))
        ends = mode_rows.groupBy(by).agg(F.max(F.when(F.col("mode") == 1, F.col("lambda"))).alias("lambda_2"), F.max("lambda").alias("radius"))
        count = now.groupBy(by).agg(F.count(F.lit(1)).alias("edges"))
        row = size.join(count, by).join(ends, by).select(by, F.lit(step).alias("step"), F.col("n").alias("nodes"), "edges", "lambda_2", "radius", (F.col("edges") / (F.col("n") * (F.col("n") - 1) / 2)).alias("density"))
        row = materialise(row)
        told = row if told is None else told.unionByName(row)
        half = size.select(by, F.greatest(F.floor(F.col("n") / 2), F.lit(2)).cast("long").alias("k"))
        found = materialise(k_means(embedded(mode_rows, by, half), by, starts))
        moved = found.select(by, F.lit(step).alias("step"), "node", "cluster")
        went = moved if went is None else went.unionByName(moved)
        end = lambda e: found.select(by, F.col("node").alias(e), F.col("cluster").alias(f"_{e}"))  # noqa: E731, B023
        merged = now.join(end("s"), [by, "s"]).join(end("t"), [by, "t"]).where("_s != _t")
        now = materialise(merged.select(by, F.least("_s", "_t").alias("s"), F.greatest("_s", "_t").alias("t"), "c").groupBy(by, "s", "t").agg(F.sum("c").alias("c")))
        nodes = materialise(found.select(by, F.col("cluster").alias("node")).distinct())
        forget(mode_rows)
    if told is None:
        kind = edges.schema[by].dataType
        empty = edges.sparkSession.createDataFrame([], "step int, nodes long, edges long, lambda_2 double, radius double, density double").withColumn(by, F.lit(None).cast(kind))
        return empty.select(by, *empty.columns[:-1]), empty.select(by, "step", F.col("nodes").alias("node"), F.col("edges").alias("cluster"))
    return told, went
