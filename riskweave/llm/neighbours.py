"""Approximate nearest neighbours by collision-counting hashing.

Every vector, scaled to length one, is projected on ``PROJECTIONS`` random directions. A block
of vectors keeps one sorted array per direction, without buckets: a query opens on
each of them a window centred on its own projection, and a vector inside it collides.
Windows widen by virtual rehashing, the half-width growing by ``GROWTH`` each time; only
the newly covered rings are counted. When at least the ``VERIFY`` share of the block (and
``LEAST`` vectors) has collided on the ``COLLIDE`` share of directions, widening ends and those
vectors are verified by their exact cosine in double precision.

The queries are set against all rows in blocks: a task builds the sorted arrays of its block once,
and the queries stream past them batch by batch, so that neither side is ever held whole; each query keeps its
best ``k`` of each block before the blocks meet.

Vectors that are null, empty, zero, of another size than most, or hold null or non-finite
components take no part, as queries neither. Ties go to the smaller vec_id. Fewer than
``k`` candidates all appear. Rows are told apart by a number of their own, so rows that repeat an id, or id and vector, are
separate queries and candidates of each other. Columns other than ``vec_id`` and ``embedding`` are not read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.llm import _common

K = 5
PROJECTIONS = 176
SEED = 7
#: Half-width of the first window, and its growth with each virtual rehashing.
WIDTH = 0.6
GROWTH = 1.2
#: Share of the directions that a vector must collide on; share of a block, and number of vectors, that end the widening.
COLLIDE = 0.6
VERIFY = 0.04
LEAST = 32
#: Most rows of a block, and blocks at least, for as many tasks.
VECTOR_BLOCK = 1 << 16
BLOCKS = 8


class SortedProjections:
    """The sorted arrays of one block of vectors."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, projections: int = PROJECTIONS):
        self.rows, self.ids = rows, ids
        self.vectors, self.norms = scaled(vectors)
        self.axes = np.random.default_rng(SEED).standard_normal((vectors.shape[1], projections))
        p = (self.vectors / self.norms[:, None]) @ self.axes
        self.order = np.argsort(p, axis=0, kind="stable").T.astype(np.int32).copy()
        self.sorted = np.sort(p, axis=0).T.copy()

    def search(self, rows: np.ndarray, queries: np.ndarray, k: int = K) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, but for the vector of its own row, the places and cosines of the best ``k`` vectors verified, nearest first."""
        n, m = len(self.ids), len(self.sorted)
        queries, norms = scaled(queries)
        own = ((queries / norms[:, None]) @ self.axes).T
        need, enough = int(np.ceil(COLLIDE * m)), min(n, max(LEAST, k + 1, int(np.ceil(VERIFY * n))))
        out: list = [None] * len(rows)
        count = np.zeros((len(rows), n), dtype=np.int16)
        low = high = None
        width, open_ = WIDTH, np.arange(len(rows))
        while len(open_):
            left = np.stack([s.searchsorted(x[open_] - width) for s, x in zip(self.sorted, own, strict=True)])
            right = np.stack([s.searchsorted(x[open_] + width, side="right") for s, x in zip(self.sorted, own, strict=True)])
            still = []
            for i, q in enumerate(open_.tolist()):
                a, b = left[:, i].tolist(), right[:, i].tolist()
                if low is None:
                    rings = [o[x:y] for o, x, y in zip(self.order, a, b, strict=True)]
                else:
                    rings = [o[x:y] for o, x, y in zip(self.order, a, low[:, q].tolist(), strict=True)] + [o[x:y] for o, x, y in zip(self.order, high[:, q].tolist(), b, strict=True)]
                count[q] += np.bincount(np.concatenate(rings), minlength=n).astype(np.int16)
                found = np.flatnonzero(count[q] >= need)
                if len(found) < enough and (right[:, i] - left[:, i]).min() < n:
                    still.append(i)
                    continue
                found = found[self.rows[found] != rows[q]]
                cosine = (self.vectors[found] @ queries[q]) / (self.norms[found] * norms[q])
                if len(found) > 4 * k:
                    best = np.argpartition(-cosine, k)[: k + 1]
                    found, cosine = found[cosine >= cosine[best].min()], cosine[cosine >= cosine[best].min()]
                cosine = (self.vectors[found] * queries[q]).sum(1) / (self.norms[found] * norms[q])
                best = np.lexsort((self.rows[found], self.ids[found], -cosine))[:k]
                out[q] = found[best], cosine[best]
            if low is None:
                low, high = left, right
            low[:, open_], high[:, open_] = left, right
            open_ = open_[still]
            width *= GROWTH
        return out


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors in double precision, each times a power of two that keeps its length in range, and their lengths."""
    vectors = vectors.astype(np.float64)
    vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])
    return vectors, np.sqrt((vectors**2).sum(1))


def usable(df: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part; all of the size that most rows have."""
    v = F.col("embedding").cast("array<double>")
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull()
        & F.col("v").isNotNull()
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    return rows


def search(df: DataFrame, every: int = 50, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest of every row whose id is divisible by ``every``."""
    spark = df.sparkSession
    _common.ship(spark)
    rows = usable(df)
    size = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
    n = size["n"] if size else 0
    rows = _common.materialise(rows.where(F.size("v") == (size["size"] if size else 0)).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"))
    blocks = max(BLOCKS, -(-n // VECTOR_BLOCK))
    held = rows.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "row", "vec_id", "v")
    asked = rows.where(F.col("vec_id") % every == 0).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "row", "vec_id", "v")
    both = held.unionByName(asked).repartitionByRange(blocks, "block").sortWithinPartitions("block", "kind", "row")
    names = ["query", "query_id", "vec_id", "row", "score"]

    def run(batches):
        now, mine, index = None, [], None
        for whole in batches:
            block = whole.column("block").to_numpy()
            kind = whole.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(block)]
            for at, end in zip(cuts, cuts[1:], strict=False):
                batch = whole.slice(at, end - at)
                number, ids = batch.column("row").to_numpy(), batch.column("vec_id").to_numpy()
                v = batch.column("v").flatten().to_numpy().reshape(len(ids), -1) if len(ids) else None
                if not len(ids):
                    continue
                if block[at] != now:
                    now, mine, index = block[at], [], None
                if not kind[at]:
                    mine.append((number, ids, v))
                    continue
                if index is None and mine:
                    index = SortedProjections(*(np.concatenate(x) for x in zip(*mine, strict=True)))
                    mine = []
                if index is not None:
                    found = index.search(number, v, k)
                    times = [len(x) for x, _ in found]
                    places = np.concatenate([x for x, _ in found])
                    cols = np.repeat(number, times), np.repeat(ids, times), index.ids[places], index.rows[places], np.concatenate([x for _, x in found])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    near = both.mapInArrow(run, "query long, query_id long, vec_id long, row long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(table: pd.DataFrame, every: int = 50, k: int = K) -> pd.DataFrame:
    """The exact answer on a small table, for tests and for measuring recall."""
    x = np.stack(table["embedding"].map(lambda v: np.asarray(v, dtype=np.float64)))
    ids, norms, out = table["vec_id"].to_numpy(), np.sqrt((x**2).sum(1)), []
    for i in np.flatnonzero(ids % every == 0):
        cosine = (x * x[i]).sum(1) / (norms * norms[i])
        order = [j for j in np.lexsort((ids, -cosine)) if ids[j] != ids[i]][:k]
        out += [(ids[i], r + 1, ids[j], cosine[j]) for r, j in enumerate(order)]
    return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_common.table(spark, sf_dir, "embeddings"))
