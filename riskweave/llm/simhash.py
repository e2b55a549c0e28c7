"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each padded to the 23
bits of the binary Golay code, whose codewords' balls of radius 3 fill the space, so that
every segment decodes to one codeword of 12 free bits. A segment's *near* indices are
those of itself and of all words one bit away: one index where it lies within 2 bits of
a codeword, six otherwise. Where two segments differ in at most one bit, the index of
one is among the near indices of the other.

Three differing bits fall into three segments so that at least two segments hold at most
one each. So for each of the three pairs of segments one side of the join gives all
combinations of near indices and the other its own indices; every pair within 3 bits
meets, and each meeting is verified by its exact distance. The join runs between
distinct fingerprints, so exact copies are never paired, and classes are connected
components of the links.

``keep_one`` also links texts whose five-word shingles are alike (Jaccard 0.8 or more). Those
lie further apart than 3 bits, so there the keys are shingles: with all shingles in one order,
sets of n and m of that similarity share one of the first n - ceil(0.8 n) + 1 and m - ceil(0.8 m)
+ 1. Only those keys are dealt out, with the hash of the set; groups of one go at once. Sizes and odd
sketches (Mitzenmacher, Pagh and Pham, 2014) rule out pairs that can't be alike, and all others are verified by
the shingles themselves, but those that other links join already.

Null text is the empty text; texts without words have the fingerprint zero and link like
any other. Texts are hashed whole, in blocks, however long. Repeated rows share a class. Rows with
a null id get the class of their fingerprint. Columns other than ``doc_id`` and ``text`` are not
read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from riskweave.llm import _common
from riskweave.operators.components import connected_components

SEED = 42
DISTANCE = 3
#: Of the pipeline stage: words of a shingle and least Jaccard similarity.
SHINGLE = 5
SIMILARITY = 0.8
#: Texts that show which shingles are common, at least, and one in so many of all; the most such shingles held. None changes which pairs are found.
SAMPLE = 8000
SHARE = 6
COMMON = 1 << 18
#: Of the pairs of members not joined yet, the share (one in so many) that is verified in each turn; the last turn takes all.
SHARES = (16, 1)
#: Members of a key's group that are held against each other before it is parted by size, then by further shingles, and how often it is.
CROWD = 64
LARGE_CROWD = 4096
LEVELS = 3
#: Bits, at most, of the bitmap that holds texts back, and sets that a task remembers; neither changes the result.
BITMAP = 1 << 25
SEEN = 1 << 20
#: Bits of each segment, from the lowest.
SEGMENTS = (22, 21, 21)
#: Generator polynomial of the [23, 12] Golay code.
_GENERATOR = 0xC75
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str, words: int = 3) -> int:
    """Majority of each bit of the hashes of all word shingles, as a signed 64-bit integer."""
    w = text.encode().translate(_LOWER).split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    ones = np.zeros(64, dtype=np.int64)
    h = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        hashes = np.fromiter((h(b" ".join(w[k : k + words]), SEED) for k in range(at, min(n, at + BLOCK))), dtype=np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def _remainder(word: np.ndarray) -> np.ndarray:
    word = word.copy()
    for bit in range(22, 10, -1):
        word ^= np.where(word >> bit & 1, _GENERATOR << (bit - 11), 0).astype(word.dtype)
    return word


@functools.cache
def _errors() -> np.ndarray:
    """The error pattern of at most 3 bits for each of the 2048 remainders."""
    patterns = [0]
    for weight in (1, 2, 3):
        patterns += [sum(1 << b for b in bits) for bits in combinations(range(23), weight)]
    patterns = np.array(patterns, dtype=np.int64)
    out = np.zeros(2048, dtype=np.int64)
    out[_remainder(patterns)] = patterns
    return out


def index(word: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit word."""
    return (word ^ _errors()[_remainder(word)]) >> 11


def near(word: np.ndarray, bits: int) -> np.ndarray:
    """Distinct indices of each word and of the words one of its ``bits`` away, six columns, -1 where fewer."""
    flips = np.array([0, *(1 << b for b in range(bits))], dtype=np.int64)
    found = np.sort(index(word[:, None] ^ flips), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return -np.sort(-found, axis=1)[:, :6]


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    out, at, u = [], 0, fp.view(np.uint64)
    for bits in SEGMENTS:
        out.append((u >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64))
        at += bits
    return out


def keys(fp: np.ndarray, spread: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys; with ``spread`` those of the near indices."""
    own = [near(s, b) if spread else index(s)[:, None] for s, b in zip(_segments(fp), SEGMENTS, strict=True)]
    rows, out = [], []
    for pair, (i, j) in enumerate(combinations(range(3), 2)):
        a, b = own[i][:, :, None], own[j][:, None, :]
        valid = (a >= 0) & (b >= 0)
        out.append(((pair << 24) | (a << 12) | b)[valid])
        rows.append(np.nonzero(valid)[0])
    return np.concatenate(rows), np.concatenate(out)


def fingerprints(df: DataFrame, words: int = 3) -> DataFrame:
    """All columns of ``df`` and ``fp``, of its column ``text``."""
    _common.ship(df.sparkSession)
    schema = StructType([*df.schema.fields, StructField("fp", LongType())])

    def run(batches):
        for batch in batches:
            fp = pa.array([fingerprint(t or "", words) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, fp], names=schema.names)

    return df.mapInArrow(run, schema)


def _keyed(fps: DataFrame, spread: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            row, key = keys(fp, spread)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """(source, target) of all distinct fingerprints that differ in 1 to 3 bits."""
    left = _keyed(fps, spread=True).withColumnRenamed("fp", "source")
    right = _keyed(fps, spread=False).withColumnRenamed("fp", "target")
    close = (F.col("source") < F.col("target")) & (F.bit_count(F.col("source").bitwiseXOR(F.col("target"))) <= DISTANCE)
    return left.join(right, "key").where(close).select("source", "target").distinct()


def classes(rows: DataFrame) -> DataFrame:
    """(fp, component_id) of all fingerprints in ``rows`` (doc_id, fp): the smallest doc_id reachable."""
    least = _common.materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = connected_components(_common.materialise(links(least)))
    return (
        least.join(found, least["fp"] == found["node"], "left")
        .select("fp", "least", F.coalesce("component", "fp").alias("root"))
        .transform(lambda d: d.join(d.groupBy("root").agg(F.min("least").alias("component_id")), "root"))
        .select("fp", "component_id")
    )


def _hashes(text: str, words: int) -> np.ndarray:
    w = text.encode().translate(_LOWER).split()
    n = max(1, len(w) - words + 1) if w else 0
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(b" ".join(w[k : k + words]), SEED) for k in range(n)), dtype=np.uint64, count=n)


def shingles(text: str, words: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of all word shingles, as signed 64-bit integers."""
    return np.unique(_hashes(text, words)).view(np.int64)


def prefix(sh: np.ndarray, common: np.ndarray, rank: np.ndarray, more: int = 0) -> np.ndarray:
    """The first shingles of ``sh`` (sorted), of which sets of Jaccard SIMILARITY share one, or 1 + ``more``: those in ``common`` (sorted) come last, by ``rank``."""
    if len(common) and len(sh):
        at = np.minimum(np.searchsorted(common, sh), len(common) - 1)
        late = common[at] == sh
        sh = np.concatenate([sh[~late], sh[late][np.argsort(rank[at[late]])]])
    return sh[: len(sh) - math.ceil(SIMILARITY * len(sh) - 1e-6) + 1 + more]


def odd_sketch(sh: np.ndarray) -> bytes:
    """Parity of the shingles that fall on each of n to 2n bits, a power of two and 64 at least.

    Two sets differ in at least as many shingles as their sketches differ in bits, so a sketch can only rule pairs out that truly are unlike.
    """
    bits = max(64, 1 << int(len(sh) - 1).bit_length())
    return np.packbits(np.bincount(sh & (bits - 1), minlength=bits) & 1, bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """Number of differing bits of two odd sketches, the longer one folded to the size of the other."""
    x, y = (np.frombuffer(s, dtype=np.uint64) for s in ((a, b) if len(a) >= len(b) else (b, a)))
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0) ^ y).sum())


def _common_shingles(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample hold, sorted, and their ranks by frequency. They only order ``prefix``: any list gives the same pairs."""
    part = min(SHARE, max(1, rows.count() // SAMPLE))

    def run(batches):
        for batch in batches:
            sh = [shingles(t or "", words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sh))], names=["k"])

    texts = rows.where(F.pmod("th", F.lit(part)) == 0).select("th", "text").dropDuplicates(["th"]).select("text")
    counts = texts.mapInArrow(run, "k long").groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    k = counts.orderBy(F.desc("n"), "k").limit(COMMON).select("k").toArrow().column("k").to_numpy()
    order = np.argsort(k)
    return k[order], -order


def _sketches(rows: DataFrame, words: int) -> DataFrame:
    """(key, th, fp, sid, n, pre, odd): fingerprint of word shingles, hash of their set, its size, first shingles and odd sketch.

    ``pre`` and ``odd`` are null where the task had the set already, and for sets of fewer than 4, which are alike only when equal.
    """
    _common.ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(_common_shingles(rows, words))

    def run(batches):
        common, rank = shared.value
        seen: set[int] = set()
        for batch in batches:
            out = []
            for t in batch.column("text").to_pylist():
                h = _hashes(t or "", words)
                ones = np.zeros(64, dtype=np.int64)
                for at in range(0, len(h), BLOCK):
                    ones += np.unpackbits(h[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                fp = int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])
                sh = np.unique(h).view(np.int64)
                sh.sort()
                sid = xxhash.xxh64_intdigest(sh.tobytes(), SEED) - (1 << 63)
                known = sid in seen or len(sh) < 4
                out.append((fp, sid, len(sh), None if known else prefix(sh, common, rank, LEVELS - 1), None if known else odd_sketch(sh)))
                if len(seen) < SEEN:
                    seen.add(sid)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary())
            cols = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("th"), *cols], names=["key", "th", "fp", "sid", "n", "pre", "odd"])

    return rows.select("key", "th", "text").mapInArrow(run, "key long, th long, fp long, sid long, n int, pre array<long>, odd binary")


def _alike(pairs: DataFrame, sets: DataFrame, rows: DataFrame, words: int) -> DataFrame | None:
    """The ``pairs`` (a, b) of shingle sets that are alike, None if there are none; ``sets`` (sid, th, n, odd) names a text of each, ``rows`` (th, text) holds it.

    Sizes and odd sketches rule most pairs out; the shingles themselves decide on the rest.
    """

    def possible(batches):
        for batch in batches:
            n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
            most = (1 - SIMILARITY) / (1 + SIMILARITY) * (n + m) + 1e-6  # that sets so large and alike may differ in
            fits = np.abs(n - m) <= most
            odd = zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), fits, most, strict=True)
            yield batch.filter(pa.array([bool(f) and least_difference(x, y) <= d for x, y, f, d in odd], pa.bool_())).select(["a", "b", "s", "t"])

    small = sets.select("sid", "th", "n", "odd")
    both = pairs.distinct().join(small.toDF("a", "s", "n", "x"), "a").join(small.toDF("b", "t", "m", "y"), "b")
    pairs = _common.materialise(both.select("a", "b", "s", "t", "n", "m", "x", "y").mapInArrow(possible, "a long, b long, s long, t long"))
    wanted = _common.materialise(pairs.select(F.explode(F.array("s", "t")).alias("th")).distinct())
    number = wanted.count()
    if not number:
        _common.forget(pairs, wanted)
        return None
    # a bitmap of the wanted hashes, of bounded size, holds most other texts back from the shuffle
    bits = min(BITMAP, 1 << max(10, (8 * number).bit_length()))
    at = F.pmod("th", F.lit(bits))
    found = wanted.groupBy((at / 64).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(th, {bits}) % 64 as int))")).alias("v")).toArrow()
    bitmap = np.zeros(bits // 64, dtype=np.int64)
    bitmap[found.column("w").to_numpy()] = found.column("v").to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)

    def held(batches):
        for batch in batches:
            place = batch.column("th").to_numpy() % bits
            yield batch.filter(pa.array((shared.value[place // 64] >> (place % 64) & 1).astype(bool)))

    def hashed(batches):
        for batch in batches:
            held_sets = pa.array([shingles(t or "", words) for t in batch.column("text").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("th"), held_sets], names=["th", "sh"])

    texts = rows.select("th", "text").mapInArrow(held, "th long, text string").join(wanted, "th", "left_semi").dropDuplicates(["th"])
    whole = _common.materialise(texts.mapInArrow(hashed, "th long, sh array<long>"))
    both = pairs.join(whole.toDF("s", "u"), "s").join(whole.toDF("t", "v"), "t")
    common = F.size(F.array_intersect("u", "v"))
    alike = _common.materialise(both.where(common >= SIMILARITY * (F.size("u") + F.size("v") - common) - 1e-6).select("a", "b"))
    _common.forget(pairs, wanted, whole)
    if alike.isEmpty():
        _common.forget(alike)
        return None
    return alike


def _placed(place: str, of: str = "") -> list:
    end = f"_{of}" if of else ""
    return [F.shiftright(place, 32).cast("int").alias(f"n{end}"), F.col(place).bitwiseAND(0xFFFFFFFF).cast("int").alias(f"at{end}")]


def _fits(before: int):
    """May sets of n_a and n_b, whose first common shingles are ``before`` others and those at places at_a and at_b, be alike? They share at most what follows."""
    share = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) + before
    return share >= SIMILARITY / (1 + SIMILARITY) * (F.col("n_a") + F.col("n_b")) - 1e-6


def _apart(members: DataFrame, sketched: DataFrame, share: int) -> DataFrame:
    """(a, b) of all sets in ``members`` (k, sid, c, n, at) that share a key, aren't of one component c, and may be alike by sizes and places; one in ``share`` of them, by a hash.

    A group of more than CROWD members is parted by size (each stands with its own size and once more, ``twice``, with the next), one of more than LARGE_CROWD by the next shingle that its members hold:
    sets that share one of their first share a second one among those and one more, and so on. Only what is crowded still at LEVELS
    is held against each other as it is.
    """
    drawn = F.pmod(F.xxhash64(F.least("sid_a", "sid_b"), F.greatest("sid_a", "sid_b")), F.lit(share)) == 0
    group = Window.partitionBy("k")
    size = F.floor(F.log("n") / math.log(1 / SIMILARITY) + 1e-9).cast("int")
    members, rest = members.withColumn("twice", F.lit(False)), None
    for level in range(LEVELS + 1):
        most = CROWD if not level else LARGE_CROWD
        members = members.withColumns({"lo": F.min("c").over(group), "hi": F.max("c").over(group), "crowd": F.count(F.lit(1)).over(group)}).where("lo < hi").drop("lo", "hi")
        members = _common.materialise(members)
        few = members if level == LEVELS else members.where(F.col("crowd") <= most)
        a, b = (few.select("k", *(F.col(c).alias(f"{c}_{x}") for c in ("sid", "n", "c", "at", "twice"))) for x in "ab")
        met = a.join(b, "k").where((F.col("c_a") < F.col("c_b")) & ~(F.col("twice_a") & F.col("twice_b")) & _fits(max(0, level - 1)) & drawn).select(F.least("sid_a", "sid_b").alias("a"), F.greatest("sid_a", "sid_b").alias("b")).distinct()
        rest = met if rest is None else rest.unionByName(met)
        many = members.where(F.col("crowd") > most).drop("crowd")
        if level == LEVELS or many.isEmpty():
            break
        if level == 0:  # alike sets are of the same or of neighbouring sizes, on a scale of steps of 1 / SIMILARITY
            sized = many.drop("twice").withColumn("slot", F.explode(F.array(F.struct(size.alias("size"), F.lit(False).alias("twice")), F.struct((size + 1).alias("size"), F.lit(True).alias("twice")))))
            members = sized.select(F.xxhash64("k", "slot.size").alias("k"), "sid", "n", "c", "at", "slot.twice")
        else:
            held = many.join(sketched.where("pre IS NOT NULL").select("sid", "pre").dropDuplicates(["sid"]), "sid")
            after = held.select("k", "sid", "n", "c", "at", "twice", F.posexplode(F.slice("pre", F.lit(1), F.size("pre") - (LEVELS - 1 - level))).alias("pos", "next"))
            members = after.where("pos > at").select(F.xxhash64("k", "next").alias("k"), "sid", "n", "c", F.col("pos").alias("at"), "twice")
    return rest


def similar(sketched: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """(fp, c) of all fingerprints in ``sketched``: c is the same for those whose texts, in ``rows`` (th, text), are joined by links or by likeness.

    First each member of a key's group is held against one of the group. The members that are not joined by then are held
    against each other: first a share of their pairs, which joins most large groups, and then all that are not joined by then.
    Each turn's pairs only join classes of the turn before, so their components are sought among those classes, and a turn without such pairs ends there.
    """
    sets = sketched.where("odd IS NOT NULL").groupBy("sid").agg(F.min("th").alias("th"), F.min("n").alias("n"), F.min("odd").alias("odd"), F.min("fp").alias("fp"))
    sets = _common.materialise(sets)
    group = Window.partitionBy("k")
    first = F.slice("pre", F.lit(1), F.size("pre") - (LEVELS - 1))
    posts = sketched.where("pre IS NOT NULL").select("n", F.posexplode(first).alias("at", "k"), "sid")
    posts = posts.select("k", "sid", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("at")).alias("place"))  # one number takes less room than two
    posts = posts.withColumns({"lo": F.min("sid").over(group), "hi": F.max("sid").over(group)}).where("lo < hi").drop("lo", "hi")
    posts = _common.materialise(posts)

    # texts of one set are alike, whatever their fingerprints
    same = sketched.select("sid", "fp").distinct().join(sketched.groupBy("sid").agg(F.min("fp").alias("least")), "sid").where("fp != least")
    same = same.select(F.col("least").alias("source"), F.col("fp").alias("target"))
    fps = _common.materialise(sketched.select("fp").distinct())
    linked = _common.materialise(same.unionByName(links(fps)))
    found = connected_components(linked).toDF("fp", "c")
    at = _common.materialise(fps.join(found, "fp", "left").select("fp", F.coalesce("c", "fp").alias("c")))
    of = _common.materialise(sets.select("sid", "fp").join(at, "fp").select("sid", "c"))
    _common.forget(linked, fps)
    for turn in ("leader", *SHARES):
        if turn == "leader":
            held = posts.join(of, "sid").withColumns({"lo": F.min("c").over(group), "hi": F.max("c").over(group), "lead": F.min_by(F.struct("sid", "place", "c"), "sid").over(group)})
            held = held.where("lo < hi AND c != lead.c").select(F.col("lead.sid").alias("a"), F.col("sid").alias("b"), F.col("lead.place").alias("there"), "place")
            pairs = held.select("a", "b", *_placed("there", "a"), *_placed("place", "b")).where(_fits(0)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        else:
            pairs = _apart(posts.join(of, "sid").select("k", "sid", "c", *_placed("place")), sketched, turn)
        near = _alike(pairs, sets, rows, words)
        if near is None:
            continue
        joined = connected_components(near.join(of.toDF("a", "c"), "a").join(of.toDF("b", "d"), "b").select("c", "d"), "c", "d").toDF("c", "to")
        before = near, at, of
        at, of = (_common.materialise(x.join(joined, "c", "left").select(key, F.coalesce("to", "c").alias("c"))) for x, key in ((at, "fp"), (of, "sid")))
        _common.forget(*before)
    _common.forget(posts, sets, of)
    return at


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = _common.materialise(fingerprints(documents).select("doc_id", "fp"))
    return rows.join(classes(rows), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str, words: int = SHINGLE) -> DataFrame:
    """Pipeline stage: of each class only the row with the smallest doc_id stays, one where ids repeat.

    A row is known by its id and the hash of its text, so different texts of one id, or of none, stay apart. Only ids, fingerprints, first
    shingles and sketches are stored; texts pass once, through the join with the ids kept, and those to be compared once more. A null
    id stands before all others. Columns of any other name pass unread. An empty table gives no rows.
    """
    rows = _common.hidden(docs).withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    rows = rows.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    sketched = _common.materialise(_sketches(rows, words))
    of = similar(sketched, rows, words)
    members = sketched.join(of, "fp").groupBy("c", "key", "th").agg(F.count(F.lit(1)).alias("times"))
    kept = _common.materialise(members.groupBy("c").agg(F.min(F.struct("key", "th", "times")).alias("least")).select("least.*"))
    _common.forget(sketched, of)
    out = rows.join(kept.select("key", "th"), ["key", "th"], "left_semi")
    again = kept.where("times > 1").select("key", "th")
    if not again.isEmpty():  # only rows that repeat id and text need to be told apart
        both = ["key", "th"]
        out = out.join(again, both, "left_anti").unionByName(out.join(again, both, "left_semi").dropDuplicates(both))
    return _common.shown(out, docs)
