"""Merkle manifest of a dataset: a trie over the rows of each source, and one over the sources.

A row is a leaf, hashed with its fields' lengths, so no two rows run together. Leaves stand in the order of doc_id within their source, and every
``FANOUT`` consecutive ones share a parent, which is the hash of theirs; so on up to a subroot a source, and from the subroots, by source, to the root.

Places come without a global sort: ids are read as digits, histograms of their leading digits are summed up level by level, and a row's place is the number of
rows under smaller prefixes. A window spans the digits that follow one prefix, so its rows are bounded whatever the ids are. Where
rows share an id, the digits of their hashes go on in the same way; rows alike in all fields are counted and take places in a row. A
place, written in base ``FANOUT``, is the key of a leaf in the trie. Nodes are reduced from the longest prefixes up, ``LEVELS`` levels at a time, in tasks
of at most ``FANOUT ** LEVELS`` nodes each; siblings come down the same way. Every level is written to the shared folder, so a lost executor costs
one level at most.

Null fields are hashed as ``-``. Null ids come before others, a null source before all others and apart from the empty one. Very long texts are hashed in
their row. Columns other than the five are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.llm import _common
from riskweave.llm.importance import CRC, CRC_TABLE
from riskweave.operators.ranks import ranked, repeated

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 3
#: Levels of the trie that one task reduces at once; it holds FANOUT ** LEVELS nodes then.
LEVELS = 6
#: Bits under each digit of an id that histograms are kept of, from the highest; windows of the last digits, where ids are dense, are short.
SHIFTS = (48, 32, 20, 10, 0)
#: Bits of a digit of a hash.
BITS = 16


def leaf(**changed: Column) -> Column:
    """The hash of a row's fields; ``changed`` gives other values for some."""
    said = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*(said(changed.get(f, F.col(f)).cast("string")) for f in FIELDS)).cast("binary"), 256)


def rank(rows: DataFrame, group: list[str], digits: list[Column], last: str) -> DataFrame:
    """``rows`` with ``before``, the sum of ``n`` over smaller rows of the group, and ``total``, that over all its rows.

    Rows compare by ``digits``, each of at most some 2 ** 16 values, and where all but the last of these are the same by ``last``, which tells them apart.
    """
    names = [f"_d{k}" for k in range(len(digits))]
    rows = rows.withColumns(dict(zip(names, digits, strict=True)))
    base = None
    for k in range(1, len(digits) + 1):
        prefix = [*group, *names[: k - 1]]
        here = rows if k == len(digits) else rows.groupBy(*group, *names[:k]).agg(F.sum("n").alias("n"))
        order = Window.partitionBy(*prefix).orderBy(last if k == len(digits) else names[k - 1])
        here = here.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        if base is None:
            here = here.withColumn("total", F.sum("n").over(Window.partitionBy(*prefix)))
        else:
            here = here.join(base, prefix).withColumn("before", F.col("before") + F.col("_base")).drop("_base")
        base = here.select(*group, *names[:k], F.col("before").alias("_base"), "total") if k < len(digits) else None
    return here.drop(*names)


def _id_digits() -> list[Column]:
    """Digits of ``id`` from the highest, null before negative ids and these before others."""
    high = F.when(F.col("none"), 0).otherwise(F.shiftright("id", SHIFTS[0]) + (1 << (63 - SHIFTS[0])) + 1).cast("int")
    return [high, *(F.shiftright("id", low).bitwiseAND((1 << (top - low)) - 1).cast("int") for top, low in zip(SHIFTS, SHIFTS[1:], strict=False))]


def _hash_digits() -> list[Column]:
    return [F.conv(F.substring("digest", 1 + k * BITS // 4, BITS // 4), 16, 10).cast("int") for k in range(64 // BITS)]


def placed(leaves: DataFrame) -> DataFrame:
    """Each row of ``leaves`` (g, none, id, digest, seen) with its place ``i``, from 0, in its group, and ``n``, the group's rows.

    ``none`` tells a null id; places ascend by id, and by digest where rows share one.
    """
    key = ["g", "none", "id"]
    alike = _common.materialise(leaves.groupBy(*key, "digest").agg(F.first("seen").alias("seen"), F.count(F.lit(1)).alias("n")))
    ids = rank(alike.groupBy(*key).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("leaves")), ["g"], _id_digits(), "id")
    ids = ids.select(*key, "leaves", F.col("before").alias("first"), F.col("total").alias("rows"))
    both = _common.materialise(alike.join(ids, key))
    one = both.where("leaves = 1").withColumn("i", F.col("first"))
    more = rank(both.where("leaves > 1"), key, _hash_digits(), "digest").withColumn("i", F.col("first") + F.col("before"))
    found = repeated(one.unionByName(more.drop("before", "total")), "n", "copy")
    out = _common.materialise(found.select(*key, "digest", "seen", (F.col("i") + F.col("copy")).alias("i"), F.col("rows").alias("n")))
    _common.forget(alike, both)
    return out


def _hash(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def _levels(digests: list[str], n: int, deep: int) -> list[list[str]]:
    """Level by level, the nodes over ``digests``: all of a group if its ``n`` nodes fit a task, else ``deep`` levels over a part of it."""
    out, whole = [digests], n <= FANOUT**deep
    while len(out[-1]) > 1 if whole else len(out) <= deep:
        out.append([_hash(out[-1][k : k + FANOUT]) for k in range(0, len(out[-1]), FANOUT)])
    return out


def _siblings(levels: list[list[str]], k: int) -> list[str]:
    """Of the node at ``k``: what stands left and right of it, then of its parent, and so on."""
    out = []
    for level in levels[:-1]:
        run = k - k % FANOUT
        out += ["".join(level[run:k]), "".join(level[k + 1 : run + FANOUT])]
        k //= FANOUT
    return out


def _chunks(nodes: DataFrame, width: int) -> DataFrame:
    """(g, i, n, kids): runs of ``width`` neighbouring nodes (g, i, n, digest and others)."""
    kid = F.struct("i", *(c for c in nodes.columns if c not in ("g", "i", "n")))
    return nodes.groupBy("g", F.expr(f"i div {width}").alias("_run")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(kid)).alias("kids")).withColumnRenamed("_run", "i")


def _reduced(chunks: DataFrame, deep: int) -> DataFrame:
    """(g, i, n, digest): the node over each chunk, and how many of these its group has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_pylist()
            tops = [_levels(kids, k, deep)[-1][0] for kids, k in zip(batch.column("digests").to_pylist(), n, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("i"), pa.array([-(-k // FANOUT**deep) for k in n], pa.int64()), pa.array(tops, pa.string())], names=["g", "i", "n", "digest"])

    return chunks.select("g", "i", "n", F.col("kids.digest").alias("digests")).mapInArrow(run, "g string, i long, n long, digest string")


def reduce(nodes: DataFrame, deep: int) -> tuple[list[DataFrame], DataFrame]:
    """The chunks of every round, from the leaves ``nodes`` (g, i, n, digest and others) up, and (g, digest, round): the top of each group and the round that made it."""
    rounds, tops = [], None
    while True:
        rounds.append(_common.materialise(_chunks(nodes, FANOUT**deep)))
        nodes = _common.materialise(_reduced(rounds[-1], deep))
        done = nodes.where("n = 1").select("g", "digest", F.lit(len(rounds) - 1).alias("round"))
        tops = done if tops is None else tops.unionByName(done)
        nodes = nodes.where("n > 1")
        if nodes.isEmpty():
            return rounds, tops


def _steps(chunks: DataFrame, deep: int) -> DataFrame:
    """(g, i, steps, top, root) of every node in ``chunks``, which hold these of the node over them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                levels = _levels(row["digests"], row["n"], deep)
                size = len(row["digests"])
                steps = [_siblings(levels, k) + row["steps"] for k in range(size)]
                yield pa.RecordBatch.from_arrays([pa.array([row["g"]] * size, pa.string()), pa.array(row["places"], pa.int64()), pa.array(steps, pa.list_(pa.string())), pa.array([row["top"]] * size, pa.string()), pa.array([row["root"]] * size, pa.string())], names=["g", "i", "steps", "top", "root"])

    rows = chunks.select("g", "n", F.col("kids.i").alias("places"), F.col("kids.digest").alias("digests"), "steps", "top", "root")
    return rows.mapInArrow(run, "g string, i long, steps array<string>, top string, root string")


def descend(rounds: list[DataFrame], tops: DataFrame, deep: int) -> DataFrame:
    """The chunks of leaves, each with ``steps`` (what stands left and right of it and of each node over it), ``top`` and ``root``, from (g, round, steps, top, root) of the groups' tops."""
    above = None
    for k in range(len(rounds) - 1, -1, -1):
        here = tops.where(F.col("round") == k).select("g", F.lit(0).cast("long").alias("i"), "steps", "top", "root")
        above = here if above is None else here.unionByName(above)
        found = rounds[k].join(above, ["g", "i"])
        above = _common.materialise(_steps(found, deep)) if k else None
    return found


def _proven(chunks: DataFrame, deep: int) -> DataFrame:
    """Of every leaf: its hash, those over it, the hash of its proof, and what its ``seen`` hash folds up to."""
    schema = "none boolean, id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                levels = _levels([x["digest"] for x in row["kids"]], row["n"], deep)
                out = []
                for k, kid in enumerate(row["kids"]):
                    steps = _siblings(levels, k) + row["steps"]
                    folded = kid["seen"]
                    for left, right in zip(steps[::2], steps[1::2], strict=True):
                        folded = _hash([left, folded, right])
                    out.append((kid["none"], kid["id"], kid["digest"], row["top"], row["root"], _hash(steps), folded, folded == row["root"]))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["none", "id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return chunks.select("n", "kids", "steps", "top", "root").mapInArrow(run, schema)


def manifest(docs: DataFrame, seen: Column | None = None, deep: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of ``docs``.

    ``seen`` is the leaf that a reader computes of what it was given (default: the same); folded up by the
    proof, it must give the root.
    """
    _common.ship(docs.sparkSession)
    group = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # null first, then bytewise
    each = docs.select(group.alias("g"), F.col("doc_id").cast("long").alias("_id"), leaf().alias("digest"), *([] if seen is None else [seen.alias("seen")]))
    each = each.select("g", F.col("_id").isNull().alias("none"), F.coalesce("_id", F.lit(0)).cast("long").alias("id"), "digest", F.col("digest" if seen is None else "seen").alias("seen"))
    rounds, subroots = reduce(placed(each), deep)

    sources = ranked(subroots.select(F.col("g").alias("source"), "digest", "round"), F.asc("source")).withColumn("i", F.col("rank") - 1)
    size = F.broadcast(sources.agg(F.count(F.lit(1)).alias("n")))  # one row
    over, root = reduce(sources.join(size).select(F.lit("").alias("g"), "i", "n", "digest"), deep)
    none = F.array().cast("array<string>")
    paths = _steps(descend(over, root.select("g", "round", none.alias("steps"), F.col("digest").alias("top"), F.col("digest").alias("root")), deep), deep)
    tops = _common.materialise(sources.join(paths.drop("g", "top"), "i").select(F.col("source").alias("g"), "round", "steps", F.col("digest").alias("top"), "root"))
    out = _proven(descend(rounds, tops, deep), deep)
    return out.select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), *out.columns[2:])


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _common.table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return manifest(docs, F.when(tampered, leaf(text=F.replace(F.col("text"), F.lit("\n"), F.lit("")))).otherwise(leaf()))


def _sql_trie(name: str, deep: int) -> str:
    """SQL of the levels over ``name``0 (g, i, n, h) and of the folds of ``name``p0 (g, i, proof, fold, and others)."""
    out = []
    for k in range(deep):
        out.append(f"{name}r{k} as (select g, i // 3 j, first(n) n, list(h order by i) hs from {name}{k} group by 1, 2)")
        out.append(f"{name}{k + 1} as (select g, j i, (n + 2) // 3 n, case when n = 1 then hs[1] else sha256(array_to_string(hs, '')) end h from {name}r{k})")
        left, right = "array_to_string(hs[1:i % 3], '')", "array_to_string(hs[i % 3 + 2:], '')"
        out.append(f"{name}p{k + 1} as (select p.* exclude (i, proof, fold), i // 3 i, proof || {left} || {right} proof, case when n = 1 then fold else sha256({left} || fold || {right}) end fold from {name}p{k} p join {name}r{k} r on p.g = r.g and p.i // 3 = r.j)")
    return ",\n".join(out)


#: Levels that the SQL form reduces: enough for 3 ** 14 rows a source.
_DEEP = 14


def _sql_leaf(text: str) -> str:
    said = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}, '-')"
    return f"sha256({' || '.join(said(text if f == 'text' else f) for f in FIELDS)})"


SQL = f"""with {CRC_TABLE},
each as (select doc_id, coalesce('=' || source, '') g, {_sql_leaf("text")} leaf, {_sql_leaf("replace(text, chr(10), '')")} bad, doc_id::varchar w from documents),
seen as (select doc_id, g, leaf, case when {CRC} % 2 = 0 then bad else leaf end seen from each, crc),
d as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 i, count(*) over (partition by g) n from seen),
l0 as (select g, i, n, leaf h from d), lp0 as (select doc_id, leaf, g, i, '' proof, seen fold from d),
{_sql_trie("l", _DEEP)},
q0 as (select '' g, row_number() over (order by g) - 1 i, count(*) over () n, h, g source from l{_DEEP}),
qp0 as (select doc_id, leaf, q0.h subroot, '' g, q0.i, proof, fold from lp{_DEEP} p join q0 on p.g = q0.source),
{_sql_trie("q", _DEEP)}
select doc_id, leaf, subroot, q.h root, sha256(proof) proof_sha256, fold folded_root, fold = q.h verified from qp{_DEEP} p, q{_DEEP} q"""
