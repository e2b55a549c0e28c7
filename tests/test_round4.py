"""How often queries read the large tables, and pairs counted without being formed."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import calibration as cal, network as net
from riskweave.plans import catalog
from riskweave.sources import views

DATA = "/root/testdata/sf0.001"


def counted(frame, n):
    """``frame``, whose rows are added to the accumulator ``n`` each time they are read."""

    def run(frames):
        for f in frames:
            n.add(len(f))
            yield f

    return frame.mapInPandas(run, frame.schema)


@pytest.fixture
def passes(spark, monkeypatch):
    """How often a query's tasks read a whole table."""

    def of(query, name):
        n, table = spark.sparkContext.accumulator(0), views.table
        monkeypatch.setattr(views, "table", lambda s, d, t: counted(table(s, d, t), n) if t == name else table(s, d, t))
        catalog.queries()[query](spark, DATA).collect()
        return n.value / table(spark, DATA, name).count()

    return of


def cosines(rows):
    out = {}
    for (i, a, v), (j, b, w) in itertools.combinations(rows, 2):
        if a is not None and a == b and i is not None and j is not None and i != j:
            n, c = out.setdefault(a, [0, []])
            out[a][0] = n + 1
            if v and w and None not in v and None not in w and len(v) == len(w):
                v_, w_ = np.array(v), np.array(w)
                c.append(float(v_ @ w_ / math.sqrt(v_ @ v_) / math.sqrt(w_ @ w_)) if (v_ @ v_) * (w_ @ w_) else math.nan)
    return {k: (n, float(np.mean(c)) if c else None) for k, (n, c) in out.items()}


def test_mean_cosine_is_that_of_all_pairs(spark):
    r = np.random.default_rng(7)
    rows = [(int(i), int(i % 3), r.standard_normal(4).tolist()) for i in range(60)]
    rows += [(3, 0, [1.0, 2.0, 0.0, 1.0]), (3, 0, [5.0, 2.0, 0.0, 1.0]), (6, 0, rows[6][2]), (99, 0, None), (100, 1, []), (101, 1, [1.0, None, 0.0, 0.0]), (102, 2, [1.0, 2.0]), (103, 2, [1.0, -3.0])]
    rows += [(1, None, [1.0] * 4), (None, 1, [1.0] * 4), (200, 3, [1.0] * 4), (200, 3, [2.0] * 4), (300, 4, [1.0] * 4), (301, 4, None), (400, 5, [0.0] * 4), (401, 5, [1.0] * 4)]
    got = {x["label"]: (x["links"], x["mean"]) for x in net.mean_cosine(spark.createDataFrame(rows, "i long, label long, v array<double>").repartition(3), "label", "i", "v").collect()}
    want = cosines(rows)
    assert got.keys() == want.keys() == {0, 1, 2, 4, 5} and all(got[k][0] == want[k][0] for k in want)
    assert all(got[k][1] == pytest.approx(want[k][1]) for k in (0, 1, 2)) and got[4] == (1, None) and math.isnan(got[5][1])


def test_no_pair_of_embeddings_is_formed(spark):
    """A hundred thousand rows of one label have five billion pairs."""
    rows = spark.range(100_000).select("id", F.lit(1).alias("label"), F.array(F.cos("id"), F.sin("id"), F.lit(1.0)).alias("v"))
    got = net.mean_cosine(rows, "label", "id", "v").first()
    assert got["links"] == 4_999_950_000 and got["mean"] == pytest.approx(0.5, abs=1e-4)


def test_one_at_a_time_reads_lines_once(passes):
    """Once for the last day, once for the exposures of all shocks."""
    assert passes("one_at_a_time", "lineitem") <= 2


def test_cascades_read_their_loans_once(spark):
    n = spark.sparkContext.accumulator(0)
    state = spark.createDataFrame([(0, b, 0.5 * b - 0.1, 10.0, 5.0, 0.9) for b in range(4)], "id long, bank long, cet1 double, total_assets double, interbank_assets double, lgd double")
    loans = counted(spark.createDataFrame([(b + 1, b, 2.0) for b in range(3)], "source long, target long, weight double"), n)
    got = {r["bank"]: r["defaulted"] for r in cal.cascades(state, loans, ["id"], "lgd").collect()}
    assert got == dict.fromkeys(range(4), True) and n.value == 3


def test_calibration_reads_lines_once(passes):
    """Once for the last day, once for the loans."""
    assert passes("calibrated_cascade", "lineitem") <= 2


def test_latest_exposure_is_that_of_the_quarter(spark):
    whole, last = views.exposure(spark, DATA), views.table(spark, DATA, "lineitem").agg(F.add_months(F.date_trunc("quarter", F.max("l_shipdate")).cast("date"), -3)).first()[0]
    want = {(r["source"], r["target"]): r["weight"] / 1e6 for r in whole.where(F.col("d") == last).collect()}
    got = {(r["source"], r["target"]): r["weight"] for r in views.latest_exposure(spark, DATA).collect()}
    assert got == pytest.approx(want) and got


def test_quadrature_reads_lines_once(passes):
    assert passes("spectral_quadrature", "lineitem") <= 1


def test_quantile_regression_reads_orders_once(passes):
    assert passes("quantile_regression", "orders") <= 1
