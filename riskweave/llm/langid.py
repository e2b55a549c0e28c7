"""Language identification by prediction by partial matching (PPM).

For each language a context tree counts the byte that follows every context of up to
``ORDER`` bytes in a bounded sample of its training text. The tree is pruned to the nodes
seen most, so that its order varies from place to place, and then frozen. A byte seen in the
longest context of the tree is coded there, else an escape is paid (method C: as often as the
context has distinct bytes) and the next shorter context codes it, with the bytes already
ruled out excluded, down to a uniform order. A text gets the language whose tree
codes it in the fewest bits.

Each text is counted and coded alone, from an empty context, and code lengths are added as whole
numbers of 2^-24 bits, so that nothing depends on how rows are dealt to tasks and batches.
A-Z are lower-cased; otherwise bytes stand for themselves.

Null texts and texts with no letter are ``und`` with score 0. Ties go to the smaller language
name. Very long texts are coded whole, in blocks. Repeated rows are predicted each on its own;
repeated texts count once in training. Columns other than ``text``, ``lang`` and ``doc_id`` are not
read. With nothing to learn from, everything is ``und``; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from riskweave.llm import _common

#: Longest context, in bytes.
ORDER = 4
#: Bounds of training: texts of a language, chosen by a hash, and nodes of the longest order of all languages together.
TEXTS = 3000
NODES = 1 << 19
#: Bytes handled at a time.
BLOCK = 1 << 20
#: Places of the memo of code lengths.
MEMO = 1 << 21
UNIT = 1 << 24

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_EMPTY = bytes(ORDER)
_LETTER = regex.compile(r"\p{L}")


def grams(data: np.ndarray) -> np.ndarray:
    """Each byte from place ORDER on, with the ORDER bytes before it, as one number; the byte itself lowest."""
    n = len(data) - ORDER
    out = np.zeros(n, dtype=np.int64)
    for k in range(ORDER + 1):
        out = out << 8 | data[k : k + n]
    return out


def _bytes(text: str) -> bytes:
    return _EMPTY + text.encode().translate(_LOWER)


def counts(df: DataFrame) -> DataFrame:
    """lang, gram, n: how often each byte stands after the bytes before it in all text of each language."""

    def run(batches):
        for batch in batches:
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                texts.setdefault(lang, []).append(_bytes(text))
            for lang, held in texts.items():
                for data in held:
                    data = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
                    for at in range(0, len(data) - ORDER, BLOCK):
                        gram, n = np.unique(grams(data[at : at + BLOCK + ORDER]), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    return df.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Tree:
    """The frozen context tree of one language, from its grams of ORDER + 1 bytes and their numbers, and those of each shorter order."""

    def __init__(self, orders: list[tuple[np.ndarray, np.ndarray]]):
        self.orders, below = [], None
        for gram, n in orders:  # from order 0 up; grams sorted
            context, start = np.unique(gram >> 8, return_index=True)
            total, distinct = (np.add.reduceat(x, start) if len(gram) else n for x in (n, np.ones_like(n)))
            shadow = np.zeros_like(total)  # of what the next shorter context counts, the part that this one has seen
            if below is not None and len(gram):
                shadow = np.add.reduceat(below[1][np.searchsorted(below[0], gram & ((1 << 8 * len(self.orders)) - 1))], start)
            self.orders.append((gram, n, context, total, distinct, shadow))
            below = gram, n

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Exact code length of each gram's last byte after the others."""
        out, open_ = np.zeros(len(gram)), np.ones(len(gram), dtype=bool)
        shadow, hidden = np.zeros(len(gram)), np.zeros(len(gram))  # what the longer context has ruled out: counts here, and symbols
        for k in range(ORDER, -1, -1):
            own, n, context, total, distinct, over = self.orders[k]
            if not len(own):
                continue
            mask = (1 << 8 * k) - 1
            c = gram >> 8 & mask
            at = np.minimum(np.searchsorted(context, c), len(context) - 1)
            here = open_ & (context[at] == c)
            s = gram & (mask << 8 | 255)
            i = np.minimum(np.searchsorted(own, s), len(own) - 1)
            found = here & (own[i] == s)
            rest, escape = total[at] - shadow, distinct[at] - hidden
            if k == 0 and distinct[0] == 256:
                escape = np.zeros(len(gram))
            with np.errstate(divide="ignore", invalid="ignore"):
                out += np.where(found, -np.log2(n[i] / (rest + escape)), 0) + np.where(here & ~found & (rest > 0), -np.log2(escape / (rest + escape)), 0)
            open_ &= ~found
            shadow, hidden = np.where(here, over[at], shadow), np.where(here, distinct[at], hidden)
        unseen = 256 - (self.orders[0][4][0] if len(self.orders[0][0]) else 0)
        return out + np.where(open_, np.log2(max(1, unseen)), 0)


class Model:
    """The trees of all languages, and a memo of the code lengths of common grams."""

    def __init__(self, rows: dict[str, list[tuple[np.ndarray, np.ndarray]]]):
        self.langs = sorted(rows)
        self.trees = [Tree(rows[lang]) for lang in self.langs]
        self.keys = self.units = None

    def __getstate__(self):
        return self.__dict__ | {"keys": None, "units": None}

    def _lengths(self, gram: np.ndarray) -> np.ndarray:
        """Code length of each gram in each language, in units."""
        if self.keys is None:
            self.keys = np.full(max(1 << 10, 4 * MEMO // max(4, len(self.langs))), -1, dtype=np.int64)
            self.units = np.zeros((len(self.keys), len(self.langs)), dtype=np.int32)
        place = ((gram * 0x9E3779B97F4A7C1 & 0x7FFFFFFFFFFFFFFF) >> 20) % len(self.keys)
        out = self.units[place]
        missed = np.flatnonzero(self.keys[place] != gram)
        if len(missed):
            new, which = np.unique(gram[missed], return_inverse=True)
            units = np.stack([np.rint(t.bits(new) * UNIT) for t in self.trees], axis=1).astype(np.int32)
            out[missed] = units[which]
            first = place[missed[np.unique(which, return_index=True)[1]]]
            self.keys[first], self.units[first] = new, units
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and share of the probability of each text."""
        asked = [k for k, t in enumerate(texts) if t and self.langs and _LETTER.search(t)]
        out = [("und", 0.0)] * len(texts)
        held = [_bytes(texts[k]) for k in asked]
        total = np.zeros((len(asked), len(self.langs)), dtype=np.int64)
        data = np.frombuffer(b"".join(held), dtype=np.uint8)
        sizes = np.array([len(x) for x in held], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        for at in range(0, len(data) - ORDER, BLOCK):
            block = grams(data[at : at + BLOCK + ORDER].astype(np.int64))
            place = np.arange(at + ORDER, at + ORDER + len(block))
            row = np.searchsorted(starts, place, side="right") - 1
            own = place - starts[row] >= ORDER  # others are the empty context of the next text
            row, units = row[own], self._lengths(block[own])
            for j in range(len(self.langs)):
                total[:, j] += np.bincount(row, weights=units[:, j], minlength=len(asked)).astype(np.int64)
        for k, bits in zip(asked, total, strict=True):
            best = int(bits.argmin())
            out[k] = self.langs[best], float(1 / np.exp2(np.maximum((bits[best] - bits) / UNIT, -1000)).sum())
        return out


def train(df: DataFrame) -> Model:
    """From at most about TEXTS texts of each language, of rows that aren't held out and have text and a language.

    Grams rarer than a threshold are cut off, so that no more than NODES are left; what comes to the driver is bounded by that.
    """
    _common.ship(df.sparkSession)
    known = df.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~_common.held_out(F.col("doc_id"))).select("lang", "text")
    # by distinct texts, so that a text counts once however often it stands there
    texts = known.groupBy("lang").agg(F.count_distinct(F.xxhash64("text")).alias("_texts"))
    share = texts.select("lang", (F.least(F.lit(1.0), F.lit(float(TEXTS)) / F.col("_texts")) * (1 << 30)).cast("long").alias("_most"))
    # one row a language, each of which has a tree in the model; texts stay where they are
    sample = known.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.col("_most")).select("lang", "text").dropDuplicates()
    found = _common.materialise(counts(sample))
    sizes = found.groupBy("lang", F.least("n", F.lit(1 << 10)).alias("n")).agg(F.count(F.lit(1)).alias("grams"))
    room = F.floor(F.lit(NODES) / F.greatest(F.lit(1), F.size(F.collect_set("lang").over(Window.partitionBy()))))
    down = Window.partitionBy("lang").orderBy(F.desc("n"))
    sizes = sizes.select("lang", "n", room.alias("_room"), F.sum("grams").over(down).alias("_so_far"), F.max("n").over(Window.partitionBy("lang")).alias("_top"))
    least = sizes.where((F.col("_so_far") <= F.col("_room")) | (F.col("n") == F.col("_top"))).groupBy("lang").agg(F.min("n").alias("_least"))
    orders = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col("gram").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("gram")) for k in range(ORDER + 1)))).alias("o")
    nodes = found.select("lang", "n", orders).groupBy("lang", F.col("o.k").alias("k"), F.col("o.gram").alias("gram")).agg(F.sum("n").alias("n"))
    kept = nodes.join(F.broadcast(least), "lang").where(F.col("n") >= F.col("_least")).select("lang", "k", "gram", "n").toArrow().sort_by([("lang", "ascending"), ("k", "ascending"), ("gram", "ascending")])
    _common.forget(found)
    langs, ks, keys, n = (kept.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "k", "gram", "n"))
    rows: dict[str, list] = {}
    for lang in sorted(set(langs.tolist())):
        own = langs == lang
        rows[lang] = [(keys[own & (ks == k)], n[own & (ks == k)].astype(np.float64)) for k in range(ORDER + 1)]
    return Model(rows)


def predict(df: DataFrame, model: Model) -> DataFrame:
    """All columns of ``df`` with ``lang_pred`` and ``score``."""
    spark = df.sparkSession
    _common.ship(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = StructType([*df.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches):
        m = shared.value
        for batch in batches:
            done = m.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.float64())], names=schema.names
            )

    return df.mapInArrow(run, schema)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _common.table(spark, sf_dir, "documents")
    found = predict(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(documents))
    return found.select("doc_id", _common.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_known(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows of no language (null text or no letter) go; the rest stay as they are."""
    found = predict(_common.hidden(docs), train(docs))
    return _common.shown(found.where(F.col("lang_pred") != "und"), docs)
