"""The sample of toxic texts shuffles no text that isn't drawn."""

from pyspark.sql import functions as F

from riskweave.llm import toxicity


def test_sample_of_known_rows(spark):
    docs = [(k, f"text {k // 2}") for k in range(400)] + [(7, "other"), (None, "none")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    known = spark.createDataFrame([(k,) for k in (*range(0, 100), 999)], "doc_id long")
    want = {t for k, t in docs if k is not None and k < 100}
    assert len(want) == 51
    assert sorted(r["text"] for r in toxicity._sample_of(frame, known, 100).collect()) == sorted(want)
    few = [r["text"] for r in toxicity._sample_of(frame, known, 10).collect()]
    old = frame.join(known, "doc_id").where(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30)) < int(10 / 51 * (1 << 30))).select("text").distinct()
    assert sorted(few) == sorted(r["text"] for r in old.collect()) and 0 < len(few) < 51


def test_texts_are_not_shuffled_for_the_join(spark):
    """Where labels are too many to broadcast, ids alone are joined by a shuffle."""
    frame = spark.createDataFrame([(k, f"text {k}") for k in range(100)], "doc_id long, text string")
    known = frame.select("doc_id").where("doc_id < 50")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = toxicity._sample_of(frame, known, 1000)
        assert got.count() == 50 and "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
