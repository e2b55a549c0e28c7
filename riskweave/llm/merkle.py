"""Document fingerprints: a Merkle tree over sections and paragraphs, in DataFrame functions alone.

Sections are parted by blank lines, paragraphs by line breaks, and the leaves are runs of words of a
paragraph that end where a word does in one of ``CUT``, so that texts of one line have branches too and a word put
in or taken out changes the leaves around it only. Every node is a SHA-256: a leaf that of its
run of words, any other that of its children's. Equal roots mean equal texts; where roots differ, only branches that
differ need to be looked at, down to the paragraphs that were edited. The likeness of two
trees is the Jaccard index of their leaves.

Null text is the empty text; two empty texts are alike (1). Very long texts are hashed whole, within their row. Rows are put in the
order of doc_id (null first), repeated and null ids by a hash of their text, and each meets the row after it,
the last the first. A row alone meets itself. Columns other than ``doc_id`` and ``text`` are not read. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.llm import _common

#: A leaf ends at a word that ends so, or after so many words.
CUT = "ensty.!?;:"
WORDS = 12
#: Rows of a range of ids, at least; and ranges, at most.
RANGE_ROWS = 256
RANGES = 1 << 16
#: Quantiles of the ids that the ranges are cut by.
CELLS = 1024

_WORD = r"\S++\s++"
_BLOCK = rf"\s*+(?:(?:(?!\S++(?<=[{CUT}])){_WORD}){{1,{WORDS - 1}}}+(?:\S++\s*+)?+|\S++\s*+)|\s++"


def tree(text: Column) -> Column:
    """The runs of words that are leaves, by section and paragraph: array<array<array<string>>>."""
    runs = lambda p: F.regexp_extract_all(p, F.lit(_BLOCK), F.lit(0))
    return F.transform(F.split(text, "\n\n"), lambda s: F.transform(F.split(s, "\n"), runs))


def _node(children: Column) -> Column:
    return F.sha2(F.array_join(children, ",").cast("binary"), 256)


def nodes(t: Column) -> Column:
    """Paragraph hashes by section."""
    return F.transform(t, lambda s: F.transform(s, lambda p: _node(F.transform(p, lambda b: F.sha2(b.cast("binary"), 256)))))


def root(t: Column) -> Column:
    return _node(F.transform(nodes(t), _node))


def leaves(t: Column) -> Column:
    """The set of leaves, each as a number."""
    return F.array_distinct(F.transform(F.flatten(F.flatten(t)), lambda b: F.xxhash64(b)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two sets of leaves."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def differences(df: DataFrame, a: str, b: str) -> DataFrame:
    """``df`` with ``changed``: (section, paragraph) of text ``a``, from 0, whose branch text ``b`` doesn't have at that place."""
    placed = lambda t: F.flatten(
        F.transform(nodes(tree(F.coalesce(F.col(t), F.lit("")))), lambda s, i: F.transform(s, lambda p, j: F.struct(i.alias("section"), j.alias("paragraph"), p.alias("hash"))))
    )
    return df.withColumn("changed", F.transform(F.array_except(placed(a), placed(b)), lambda x: F.struct(x["section"], x["paragraph"])))


def _share(tie: str) -> Column:
    """A hash as a number from 0 up to 1."""
    return F.col(tie) / F.lit(2.0**64) + F.lit(0.5)


def _ranges(ids: DataFrame) -> Column:
    """A number for each (key, tie) of ``ids`` that never falls as they grow, so that about as many rows have each.

    Cells are cut at quantiles of the ids, wherever those lie; an id that fills several has one to itself, which is parted by ``tie``. Rows of a cell are counted, and dealt evenly over it.
    """
    # an accuracy of ten times the cells keeps each within a tenth of its share
    cuts = ids.agg(F.percentile_approx("key", [k / CELLS for k in range(CELLS)], 10 * CELLS)).first()[0]
    if not cuts:
        return F.lit(0)
    least = ids.agg(F.min("key")).first()[0]
    crowded = {a for a, b in zip(cuts, cuts[1:], strict=False) if a == b}
    edges = sorted({least, *cuts, *(c + 1 for c in crowded if c + 1 < 1 << 63)})
    long = lambda values: F.expr(f"array({','.join(f'cast({v} as bigint)' for v in values)})")
    step = max(1, math.isqrt(len(edges)))
    at = lambda values: F.size(F.filter(values, lambda c: c <= F.col("key")))
    block = at(long(edges[::step])) - 1
    cell = block * step + at(F.slice(long(edges), block * step + 1, step)) - 1
    count = [0] * len(edges)
    for r in ids.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect():
        count[r["cell"]] = r["n"]
    before = [0, *itertools.accumulate(count)]
    rows = max(RANGE_ROWS, -(-before[-1] // RANGES))
    width = [b - a for a, b in zip(edges, [*edges[1:], edges[-1] + 2], strict=True)]
    pick = lambda values: F.element_at(long(values), cell + 1)
    found = F.when(pick(width) == 1, _share("tie")).otherwise(F.least(F.greatest((F.col("key").cast("double") - pick(edges).cast("double")) / pick(width).cast("double"), F.lit(0.0)), F.lit(1.0)))
    return F.floor((pick(before[:-1]) + found * pick(count)) / F.lit(float(rows))).cast("long")


def with_next(df: DataFrame) -> DataFrame:
    """(doc_id, text, next): each row with the text of the row after it.

    Rows go once through a shuffle by ranges of ids. The first row of each range is also
    sent, as a guest, to the range before it, so that no range needs to know another.
    """
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    tie = F.xxhash64("text").alias("tie")
    ids = rows.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("key"), tie)
    # null ids have ranges of their own, numbered below zero, of the hashes of their texts
    nulls = rows.where("doc_id IS NULL").select(F.xxhash64("text").alias("key"), tie)
    parts = min(RANGES, -(-nulls.count() // RANGE_ROWS))
    number = _ranges(ids)
    by_hash = F.floor(_share("key") * F.lit(float(parts))).cast("long") - parts
    # At most twice RANGES rows: the first row of each range and the range before it.
    first = lambda keys, by, null: keys.groupBy(by.alias("range")).agg(F.min(F.struct("key", "tie")).alias("m")).select("range", "m.*", F.lit(null).alias("null"))
    firsts = sorted(tuple(r) for r in first(ids, number, False).unionByName(first(nulls, by_hash, True)).collect())
    guests = [(key, tie, null, firsts[i - 1][0]) for i, (_, key, tie, null) in enumerate(firsts)]
    host = F.broadcast(df.sparkSession.createDataFrame(guests, "key long, tie long, null boolean, host long"))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("null", F.col("doc_id").isNull()).withColumn("key", F.coalesce("doc_id", "tie"))
    placed = rows.withColumn("range", F.when(F.col("null"), by_hash).otherwise(number)).join(host, ["key", "tie", "null"], "left").withColumn(
        "place", F.explode(F.when(F.col("host").isNull(), F.array(F.struct(F.col("range"), F.lit(0).alias("guest")))).otherwise(
            F.array(F.struct(F.col("range"), F.lit(0).alias("guest")), F.struct(F.col("host").alias("range"), F.lit(1).alias("guest")))
        ))
    )
    order = Window.partitionBy("range").orderBy("guest", "key", "tie")
    placed = placed.select("doc_id", "text", "key", "tie", F.col("place.range").alias("range"), F.col("place.guest").alias("guest"))
    return placed.withColumn("next", F.lead("text").over(order)).where("guest = 0").select("doc_id", "text", "next")


def op8_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(_common.table(spark, sf_dir, "documents"))
    cut = F.floor(F.length("text") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring("next", F.lit(1), cut)))
    rows = rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        tree(F.col("text")).alias("own"), tree(F.col("edited")).alias("edit"), tree(F.col("next")).alias("after"),
    )
    rows = rows.select(
        "doc_id", "n_chars", "edited_sha256", root(F.col("own")).alias("fingerprint"), root(F.col("edit")).alias("edited_fingerprint"),
        leaves(F.col("own")).alias("a"), leaves(F.col("edit")).alias("b"), leaves(F.col("after")).alias("c"),
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"),
    )
