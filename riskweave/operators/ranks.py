"""Places of rows in a total order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.sources.scratch import materialise

#: Bits of ``monotonically_increasing_id`` that number the rows of a partition.
_BITS = 33
#: Copies of a row that are numbered at once.
_BLOCK = 1 << 12


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``rank``, from 1, in ``order``.

    Ranges of the order are sorted apart from each other and written out, each row with its place in its
    range; what a range starts at is the number of rows in the ranges before it. Rows alike in all of ``order`` follow
    each other in any order, so ``order`` should end in a key. An empty table gives no rows.
    """
    parted = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", _BITS), F.col("_at").bitwiseAND((1 << _BITS) - 1)
    sizes = parted.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # one row a range, and there are as many ranges as shuffle partitions
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return parted.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + place + 1).drop("_part", "_before", "_at")


def repeated(rows: DataFrame, times: str, place: str) -> DataFrame:
    """Each row as often as its column ``times`` says, numbered from 0 in ``place``. Numbers are dealt by blocks, so no row holds a long array."""
    blocks = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({times} - 1) div {_BLOCK}"))))
    return blocks.withColumn(place, F.explode(F.sequence(F.col("_block") * _BLOCK, F.least(F.col(times), (F.col("_block") + 1) * _BLOCK) - 1))).drop("_block")
