"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the words of a text is trained with numpy from confirmed
toxic examples and from unlabelled text, most of which is clean. With class prior
``prior`` the risk of the unlabelled part, less ``prior`` times the risk that positives
would have as negatives, estimates the risk on clean text; where that estimate turns
negative it is clipped, and the step is taken against it (Kiryo et al., 2017).

The prior itself is estimated without negative examples: a set of texts that holds a share a of the
positives and a share b of the unlabelled can't be rarer than the positives in it, so b / a bounds
the prior from above; the least bound over growing sets of words is taken.

Words are runs of characters other than ASCII punctuation, digits and white space,
A-Z lower-cased. Words and their beginnings, which stand for inflected forms, are features where their shares among the positives and among the
unlabelled differ by ``CLEAR`` standard errors; how many do so is up to the texts. Null and empty texts have no feature and score as
the bias alone says. Very long texts are read whole. Repeated rows each get a score; repeated texts count once in training.
Columns other than ``doc_id``, ``text`` and ``toxic`` are not read. Where no positive example exists every score is 0, and an
empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from riskweave.llm import _common

#: Bounds of the sample that the classifier is fitted on: texts known to be toxic, and texts of any kind whose label isn't looked at.
MAX_POSITIVE = 3000
MAX_UNLABELLED = 9000
#: Features stand in this many sampled texts at least, and their shares differ by so many standard errors (of their logarithm).
MIN_TEXTS = 8
CLEAR = 6.0
#: Lengths of beginnings, in bytes.
STEMS = (4, 5, 6, 7, 8)
#: Share of the positives that a set of texts must hold to bound the prior.
HOLDS = 0.3
#: Texts whose features a task holds at once; it changes no result.
FEW = 16
EPOCHS = 300
STEP = 0.05
DECAY = 1e-3
THRESHOLD = 0.3

#: Byte table: A-Z lower-cased; other ASCII that isn't a letter becomes a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str) -> set[bytes]:
    return set(text.encode().translate(_FOLD).split())


def features(text: str) -> set[bytes]:
    """Words, and their beginnings with a star."""
    out = words(text)
    return out.union(w[:n] + b"*" for w in out for n in STEMS if n < len(w))


def nn_pu(rows: list[np.ndarray], positive: np.ndarray, n_words: int, prior: float, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk with the logistic loss, by Adam over all rows."""
    idx = np.concatenate([*rows, np.zeros(0, dtype=np.int64)])
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    # sums over runs of a row, and of a word
    by_word = np.argsort(idx, kind="stable")
    of_word = row[by_word]
    in_row, row_start = np.unique(row, return_index=True)
    in_word, word_start = np.unique(idx[by_word], return_index=True)
    n_p, n_u = int(positive.sum()), int((~positive).sum())
    w, bias = np.zeros(n_words), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(n_words + 1), np.zeros(n_words + 1)
    for step in range(1, epochs + 1):
        z = np.full(len(rows), bias)
        if len(idx):
            z[in_row] += np.add.reduceat(w[idx], row_start)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss_neg = np.logaddexp(0, z)
        clean = loss_neg[~positive].mean() - prior * loss_neg[positive].mean()
        grad_clean = np.where(positive, -prior * p / n_p, p / n_u)
        # below zero the estimate has over-fitted: climb back on it alone
        g = grad_clean + np.where(positive, prior * (p - 1) / n_p, 0) if clean >= 0 else -grad_clean
        grad = np.append(DECAY * w, g.sum())
        if len(idx):
            grad[in_word] += np.add.reduceat(g[of_word], word_start)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = STEP * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, bias


def class_prior(rows: list[np.ndarray], positive: np.ndarray, lift: np.ndarray) -> float:
    """Share of positives among the unlabelled rows: the least upper bound that sets of texts with any of the words of most ``lift`` give, each with a standard error."""
    n_p, n_u = int(positive.sum()), int((~positive).sum())
    rank = np.empty(len(lift), dtype=np.int64)
    rank[np.argsort(-lift, kind="stable")] = np.arange(len(lift))
    best = np.array([rank[r].min() if len(r) else len(lift) for r in rows], dtype=np.int64)  # a text is in all sets from its best word on
    held_p, held_u = (np.cumsum(np.bincount(best[x], minlength=len(lift) + 1))[:-1] for x in (positive, ~positive))
    enough = held_p >= HOLDS * n_p
    if not n_u or not enough.any():
        return min(0.2, n_p / (n_p + n_u))
    bound = (held_u + np.sqrt(held_u + 1)) / n_u / (held_p / n_p)
    return float(np.clip(bound[enough].min(), 1 / (n_u + 1), 0.5))


def _among(texts: int, most: int):
    """Whether the hash ``_s`` of a text is among the share that leaves about ``most`` of so many."""
    return F.col("_s") < (int(most / texts * (1 << 30)) if texts > most else 1 << 30)


def _hashed(df: DataFrame) -> DataFrame:
    """``df`` with hashes of its texts: ``_h`` tells them apart, ``_s`` draws the sample."""
    return df.withColumns({"_h": F.xxhash64("text"), "_s": F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30))})


def _sample(df: DataFrame, most: int) -> DataFrame:
    """About ``most`` of the distinct texts of ``df``, chosen by a hash, so that a text counts once however often it stands there."""
    rows = _hashed(df.select("text"))
    texts = rows.agg(F.count_distinct("_h")).first()[0]
    return rows.where(_among(texts, most)).select("text").distinct()


def _sample_of(df: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """``_sample`` of the rows (doc_id, text) whose id is in ``known`` (doc_id, distinct).

    Ids meet as ids and hashes, one for each text; only the texts of the sample are then fetched, so that none is shuffled for the join.
    """
    rows = _hashed(df.select("doc_id", "text"))
    found = _common.materialise(rows.select("doc_id", "_h", "_s").join(known, "doc_id").groupBy("_h", "_s").agg(F.min("doc_id").alias("doc_id")))
    chosen = found.where(_among(found.count(), most)).select("doc_id", "_h")
    return rows.join(F.broadcast(chosen), ["doc_id", "_h"], "left_semi").select("text").distinct()  # about ``most`` rows


def train(documents: DataFrame, labels: DataFrame) -> tuple[dict[bytes, float], float]:
    """Word weights and bias. Only positive labels of rows that aren't held out are read.

    Unlabelled text is drawn from all rows that aren't held out, whether or not someone has labelled them.
    """
    known = labels.where((F.col("toxic") == 1) & ~_common.held_out(F.col("doc_id"))).select("doc_id").distinct()
    open_ = documents.where(~_common.held_out(F.col("doc_id")))
    open_ = open_.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    positive = _sample_of(open_, known, MAX_POSITIVE).select(F.lit(True).alias("pos"), "text")
    unlabelled = _sample(open_, MAX_UNLABELLED).select(F.lit(False).alias("pos"), "text")

    def bag(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, FEW):
                few = batch.slice(at, FEW)
                held = [sorted(features(t)) for t in few.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([few.column("pos"), pa.array(held, pa.list_(pa.binary()))], names=["pos", "words"])

    bags = _common.materialise(positive.unionByName(unlabelled).mapInArrow(bag, "pos boolean, words array<binary>"))
    size = {r["pos"]: r["n"] for r in bags.groupBy("pos").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_p, n_u = size.get(True, 0), size.get(False, 0)
    if not n_p:
        return {}, -30.0
    # counts of words are gathered by Spark; only the features come to the driver
    seen = bags.select("pos", F.explode("words").alias("word")).groupBy("word").agg(F.count_if("pos").alias("p"), F.count_if(~F.col("pos")).alias("u"))
    share = lambda c, n: F.log((F.col(c) + 1) / F.lit(n + 2.0))
    apart = F.abs(share("p", n_p) - share("u", n_u)) * F.sqrt(F.col("p") + F.col("u"))
    kept = seen.where((F.col("p") > 0) & (F.col("p") + F.col("u") >= MIN_TEXTS) & (F.round(apart, 9) >= CLEAR))
    found = sorted((bytes(r["word"]), r["p"], r["u"]) for r in kept.collect())
    vocabulary = {w: k for k, (w, _, _) in enumerate(found)}
    # two standard errors to the safe side, so that rare words don't come first by chance
    lift = np.array([max(0.0, p - 2 * p**0.5) / max(1, n_p) / ((u + 2 * u**0.5 + 1) / max(1, n_u)) for _, p, u in found])
    shared = bags.sparkSession.sparkContext.broadcast(vocabulary)

    def index(batches):
        get = shared.value.get
        for batch in batches:
            for at in range(0, batch.num_rows, FEW):
                few = batch.slice(at, FEW)
                held = [[k for k in map(get, b) if k is not None] for b in few.column("words").to_pylist()]
                yield pa.RecordBatch.from_arrays([few.column("pos"), pa.array(held, pa.list_(pa.int32()))], names=["pos", "at"])

    table = bags.mapInArrow(index, "pos boolean, at array<int>").groupBy("pos", "at").agg(F.count(F.lit(1)).alias("n")).orderBy("pos", "at").collect()
    _common.forget(bags)
    pos = np.repeat([r["pos"] for r in table], [r["n"] for r in table]).astype(bool)
    rows = [np.array(r["at"], dtype=np.int64) for r in table for _ in range(r["n"])]
    w, bias = nn_pu(rows, pos, len(vocabulary), class_prior(rows, pos, lift))
    return {word: float(w[k]) for word, k in vocabulary.items()}, bias


def score(documents: DataFrame, weights: dict[bytes, float], bias: float, keep: bool = False) -> DataFrame:
    """doc_id and score of every row; with ``keep``, all its columns and the score."""
    spark = documents.sparkSession
    _common.ship(spark)
    shared = spark.sparkContext.broadcast((weights, bias))
    rows = documents if keep else documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = StructType([*rows.schema.fields, StructField("score", DoubleType())])

    def run(batches):
        weight, b = shared.value
        heads = {k[: STEMS[0]] for k in weight if k.endswith(b"*")}  # most words begin otherwise, and have no stem to look up
        for batch in batches:
            z = []
            for t in batch.column("text").to_pylist():
                held = words(t or "")
                stems = {w[:n] + b"*" for w in held if w[: STEMS[0]] in heads for n in STEMS if n < len(w)}
                z.append(math.fsum([b, *(weight[x] for x in held | stems if x in weight)]))
            p = 1 / (1 + np.exp(-np.clip(np.array(z, dtype=np.float64), -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=schema.names)

    return rows.mapInArrow(run, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    _common.ship(spark)
    documents = _common.table(spark, sf_dir, "documents")
    scored = score(documents, *train(documents, _common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", _common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows whose score reaches the threshold go; null texts score as empty ones."""
    weights, bias = train(docs, _common.table(spark, sf_dir, "labels"))
    scored = score(_common.hidden(docs), weights, bias, keep=True)
    return _common.shown(scored.where(F.col("score") < THRESHOLD), docs)
