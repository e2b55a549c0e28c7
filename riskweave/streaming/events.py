"""Event streams: windowed aggregates with watermarks, and a stateful alert per series.

A stream is read from a folder of parquet files; ``drained`` runs a query until what is
there has been read and returns its result as a table in shared storage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskweave.sources.scratch import shared_dir

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
LATE = "2 days"


def events(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """The stream of events; ``ts`` is a timestamp with a time zone, as watermarks need it."""
    stored = spark.read.parquet(f"{folder}/{pattern}").schema
    rows = spark.readStream.schema(stored).option("pathGlobFilter", pattern).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def tumbling(stream: DataFrame, width: str = "1 day", slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total) of fixed windows, overlapping where ``slide`` is shorter than ``width``."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = stream.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "12 hours") -> DataFrame:
    """(user_id, start, n): runs of a user's events with no pause of ``gap``."""
    out = stream.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")


def smoothed(stream: DataFrame, rate: float = 0.1) -> DataFrame:
    """(event_type, n, ema): exponential mean of each type's values in the order of time and id, kept as state between batches.

    A batch's values of a type, 24 bytes each, are put in order together; what a batch holds is bounded by the source.
    """
    import numpy as np
    import pandas as pd

    def step(key, frames, state: GroupState):
        n, ema = state.get if state.exists else (0, 0.0)
        held = [(f["ts"].to_numpy(), f["event_id"].to_numpy(), f["value"].to_numpy(dtype=float)) for f in frames]
        ts, ids, values = (np.concatenate(x) for x in zip(*held, strict=True))
        for x in values[np.lexsort((ids, ts))].tolist():
            ema = x if n == 0 else (1 - rate) * ema + rate * x
            n += 1
        state.update((n, ema))
        yield pd.DataFrame({"event_type": [key[0]], "n": [n], "ema": [ema]})

    return stream.groupBy("event_type").applyInPandasWithState(step, "event_type string, n long, ema double", "n long, ema double", "update", GroupStateTimeout.NoTimeout)


def drained(query: DataFrame, mode: str = "complete", key: tuple[str, ...] = ()) -> DataFrame:
    """The result after all that can be read has been; in ``update`` mode the last row of each ``key`` over all batches."""
    spark = query.sparkSession
    top = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    schema = query.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{top}/result/{number if key else 0}")

    run = query.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{top}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.schema(schema.add("_batch", "long")).option("recursiveFileLookup", "true").parquet(f"{top}/result")
    if key:
        last = Window.partitionBy(*key).orderBy(F.desc("_batch"))
        rows = rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return rows.drop("_batch")
