"""Importance resampling towards a target distribution, in DataFrame functions alone.

Texts become runs of words, each run a bucket by its crc32. What a bucket gains is the logarithm of its
share in the target over its share in the documents, both smoothed by one count a bucket, in thousandths and
floored; a document's weight is the sum of gains over its runs, repeats counted. A draw without replacement by these
weights takes the highest sums of weight and Gumbel noise, which comes from a hash of the doc_id, so a draw is
the same whatever the layout of the files. The table of gains has at most as many rows as there are buckets, which is a
parameter, and only that is broadcast; sums of a document are formed before rows are shuffled, and ranks are those of a sort by ranges.

A null text has no words; documents without words have weight 0 and those under ``least_words`` are scored but never drawn. Very long texts
are used whole. A null doc_id draws its noise as the text ``null`` does and comes after others in ties; rows that repeat a doc_id and text are scored
and drawn each. An empty target or empty documents are smoothed like any other. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import _common
from riskweave.operators.ranks import ranked, repeated

_BREAKS = "".join(c for c in map(chr, range(128)) if c not in string.ascii_letters + string.digits)


def words(text: Column) -> Column:
    """Runs of digits, ASCII letters (lower-cased) and characters past ASCII."""
    plain = F.translate(text, _BREAKS + string.ascii_uppercase, " " * len(_BREAKS) + string.ascii_lowercase)
    return F.filter(F.split(plain, " "), lambda w: w != "")


def runs(found: Column, shortest: int = 1, longest: int = 1) -> Column:
    """All runs of ``shortest`` to ``longest`` consecutive words, joined by a space."""
    each = lambda n: F.transform(F.sequence(F.lit(1), F.size(found) - (n - 1)), lambda i: F.array_join(F.slice(found, i, n), " "))
    none = F.array().cast("array<string>")
    return F.concat(*(found if n == 1 else F.when(F.size(found) >= n, each(n)).otherwise(none) for n in range(shortest, longest + 1)))


def _bucket(run: Column, buckets: int) -> Column:
    return (F.crc32(run.cast("binary")) % buckets).cast("int")


def _texts(df: DataFrame, shortest: int, longest: int) -> DataFrame:
    found = _common.whole_text(df).select("doc_id", F.xxhash64("text").alias("_text"), words(F.col("text")).alias("_words"))
    return found.select("doc_id", "_text", F.size("_words").alias("_long"), runs(F.col("_words"), shortest, longest).alias("_runs"))


def _counts(texts: DataFrame, buckets: int) -> DataFrame:
    each = texts.select(F.explode("_runs").alias("run")).select(_bucket(F.col("run"), buckets).alias("bucket"))
    return each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(documents: DataFrame, target: DataFrame, buckets: int = 10_000, shortest: int = 1, longest: int = 1) -> DataFrame:
    """(bucket, gain) for the buckets of ``documents`` (doc_id, text); ``target`` has the same columns."""
    mine = _common.materialise(_counts(_texts(documents, shortest, longest), buckets))
    theirs = _common.materialise(_counts(_texts(target, shortest, longest), buckets).withColumnRenamed("n", "t"))
    total = lambda df, c: F.broadcast(df.agg((F.coalesce(F.sum(c), F.lit(0)) + buckets).cast("double").alias(f"all_{c}")))
    both = mine.join(F.broadcast(theirs), "bucket", "left").join(total(mine, "n")).join(total(theirs, "t"))
    odds = (F.coalesce("t", F.lit(0)) + 1).cast("double") * F.col("all_n") / ((F.col("n") + 1).cast("double") * F.col("all_t"))
    return both.select("bucket", F.floor(1000 * F.log(odds)).cast("long").alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, floored, from the first 32 bits of a hash of seed and id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("long") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(share))).cast("long")


def resample(
    documents: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = 10_000, shortest: int = 1, longest: int = 1, seed: int = 2024
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``documents``; rank is null where the row isn't drawn.

    Drawn are ``percent`` of a hundred, rounded down, of the rows with ``least_words`` or more.
    """
    table = F.broadcast(gains(documents, target, buckets, shortest, longest))  # at most one row a bucket
    key = ["doc_id", "_text", "_long", "n_features"]
    each = _texts(documents, shortest, longest).select("doc_id", "_text", "_long", F.size("_runs").alias("n_features"), F.explode_outer("_runs").alias("run"))
    each = each.select(*key, _bucket(F.col("run"), buckets).alias("bucket")).join(table, "bucket", "left")
    # a document's rows are as many as its runs, or one if it has none: what is over are repeated rows
    sums = each.groupBy(*key).agg(F.coalesce(F.sum("gain"), F.lit(0)).alias("_sum"), (F.count(F.lit(1)) / F.greatest("n_features", F.lit(1))).cast("long").alias("_rows"))
    scored = repeated(sums, "_rows", "_row").select("doc_id", "_text", "n_features", (F.col("_long") >= least_words).alias("_fit"), (F.col("_sum") / F.col("_rows")).cast("long").alias("weight"), "_row")
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    found = ranked(scored, F.desc("_fit"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_text"), F.asc("_row"))
    drawn = F.broadcast(found.agg(F.floor(F.count_if("_fit") * percent / 100).alias("_drawn")))
    return found.join(drawn).select("doc_id", F.col("n_features").cast("long").alias("n_features"), "weight", "score", F.when(F.col("rank") <= F.col("_drawn"), F.col("rank")).alias("rank"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = _common.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return resample(_common.table(spark, sf_dir, "documents"), target)


#: crc32 of a string ``w``, by the table of its 256 remainders.
CRC_TABLE = "crc as (select list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)), lambda a, b: case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end)) t)"
CRC = "xor(list_reduce(list_concat([4294967295], list_transform(range(length(hex(w)) // 2), lambda k: ('0x' || substr(hex(w), 2 * k + 1, 2))::bigint)), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295)"

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""with {CRC_TABLE},
mine as (select row_number() over () r, doc_id, {_WORDS} ws from documents),
ours as (select r, unnest(ws) w from mine), theirs as (select unnest({_WORDS}) w from benchmark),
bucket as (select w, {CRC} % 10000 b from (select w from ours union select w from theirs), crc),
s as (select b, count(*) n from ours join bucket using (w) group by 1), t as (select b, count(*) n from theirs join bucket using (w) group by 1),
gain as (select s.b, cast(floor(1000 * ln((coalesce(t.n, 0) + 1)::double * (select sum(n) + 10000 from s)::double / ((s.n + 1)::double * (select coalesce(sum(n), 0) + 10000 from t)::double))) as bigint) g from s left join t using (b)),
summed as (select r, sum(g) weight from ours join bucket using (w) join gain using (b) group by 1),
scored as (select doc_id, len(ws) n_features, coalesce(weight, 0) weight, coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint + 0.5) / 4294967296.0))) as bigint) score from mine left join summed using (r)),
drawn as (select *, case when n_features >= 20 then row_number() over (partition by n_features >= 20 order by score desc, doc_id) end k from scored)
select doc_id, n_features::bigint n_features, weight::bigint weight, score::bigint score, (case when k <= (select 10 * count(*) // 100 from scored where n_features >= 20) then k end)::bigint rank from drawn"""
