"""Scratch storage that the driver and all executors see, for cutting lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset and all runs on one machine, one of our own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found and not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="riskweave-shared-")
        sc.setCheckpointDir(found)
    return found


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def own_path(spark: SparkSession, name: str = "") -> str:
    """A path in the shared folder that no other run uses; what is written there goes when the interpreter ends."""
    path = f"{shared_dir(spark)}/riskweave/{uuid.uuid4().hex}"

    def gone() -> None:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may already be down at exit
            pass

    atexit.register(gone)
    return f"{path}/{name}" if name else path


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    Every executor and the driver see these files, so a lost executor costs nothing
    that was computed before. They go with ``forget``, or else when the interpreter ends.
    """
    spark = df.sparkSession
    path = own_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def held(df: DataFrame) -> DataFrame:
    """``df`` if it was read back by ``materialise``, and else what that gives; for what a loop reads again and again."""
    return df if hasattr(df, "_scratch") else materialise(df)


def forget(*frames: DataFrame) -> None:
    """Delete the files of frames that ``materialise`` returned and that nothing reads any more."""
    for df in frames:
        _delete(df.sparkSession, df._scratch)
