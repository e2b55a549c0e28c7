"""A corpus pipeline of five stages; each takes all rows that the stage before it kept.

toxicity        rows scored as toxic go
language        rows of no language (null text, or no letter) go
near_duplicates of each class of near copies the row with the smallest doc_id stays
personal_data   personal data in the text is replaced by the name of its kind
packing         token pieces of the documents are packed into sequences
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from riskweave.llm import _common, langid, packing, pii, simhash, toxicity


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all documents and their places in sequences; a null text is empty, other columns are not read."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity.keep_clean),
    ("language", langid.keep_known),
    ("near_duplicates", simhash.keep_one),
    ("personal_data", pii.redact),
    ("packing", _pack),
]

#: Learned classifiers, iterated components and a packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again as the next one's documents."""
    docs = _common.table(spark, sf_dir, "documents")
    top = f"{_common.shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        path = f"{top}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        docs._scratch = path
        if before is not None:  # nothing reads what the stage before wrote any more
            _common.forget(before)
        before = docs
    return docs
