"""Query for BPE encoding and decoding (``op6``)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import _common, bpe


def encode_decode(df: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row's whole text, null as empty.

    One pass, no shuffle; rows are kept as they are, repeated ones too.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    _common.ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            done = [bpe.digest(path, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.string()), pa.array([x[2] for x in done], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(_common.table(spark, sf_dir, "documents"))
