"""Helpers shared by the operators: tables, code shipping and the held-out fold."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.sources.scratch import forget, materialise, shared_dir

__all__ = ["forget", "held_out", "hidden", "materialise", "shared_dir", "ship", "shown", "table", "whole_text"]

_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context, and keep Arrow batches small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="code-"), "riskweave_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("riskweave", os.path.relpath(full, top)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def whole_text(df: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, null text as the empty text."""
    return df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def held_out(doc_id):
    """True where crc32 of the id, as text, leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def hidden(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """``docs`` with all columns but those of ``keep`` under numbered names, so that none clashes with a stage's own."""
    return docs.select(*(F.col(f"`{c}`").alias(c if c in keep else f"__{k}") for k, c in enumerate(docs.columns)))


def shown(df: DataFrame, docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "text"), **changed) -> DataFrame:
    """The columns of ``docs`` again, under their own names; ``changed`` gives new values for some."""
    return df.select(*(changed.get(c, F.col(c if c in keep else f"__{k}")).alias(c) for k, c in enumerate(docs.columns)))
