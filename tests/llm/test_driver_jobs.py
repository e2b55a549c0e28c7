"""What the driver plans and keeps for each job is memory, so turns and rounds that change nothing must not run."""

import random
import uuid

from riskweave.llm import simhash
from riskweave.operators.components import connected_components


def jobs(spark, run):
    """The result of ``run`` and the number of Spark jobs that it took."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_components_of_stars_take_no_round(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 60, 2)] + [(100, 101), (100, 102)], "source long, target long")
    found, n = jobs(spark, lambda: {r["node"]: r["component"] for r in connected_components(edges).collect()})
    assert found == {k: k // 2 * 2 for k in range(60)} | {k: 100 for k in (100, 101, 102)}
    assert n <= 10  # 15 when a round had to show that none is needed


def test_turns_of_near_duplicates_without_pairs_end_at_once(spark):
    g = random.Random(8)
    base = [" ".join(f"n{g.randrange(10**6)}" for _ in range(40)) for _ in range(6)]
    rows = [(k, t) for k, t in enumerate([*base, *base])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    kept, n = jobs(spark, lambda: sorted(tuple(r) for r in simhash.keep_one(spark, docs, "").collect()))
    assert kept == rows[:6]
    assert n <= 90  # 118 when every turn sought the components of all links again
