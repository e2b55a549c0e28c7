"""Best-fit packing of token sequences by a configuration linear program.

A configuration says how many pieces of each length one sequence holds. The program
asks for the fewest configurations, fractions allowed, that hold the length histogram. It is solved over
the histogram alone, at most ``capacity`` numbers whatever the corpus: multiplicative
weights price the lengths, dynamic programming over the knapsack finds the
configurations worth most at those prices, each is used for a share of what is open, and
lengths lose weight as they are held. The prices also bound the optimum from below. The solution is
then rounded to whole sequences, and what rounding leaves, some thousandths of a large corpus, is
packed by best fit, largest first, on the histogram too.

Pieces then find their place by rank: the k-th piece of a length takes the k-th slot
of that length. Ranks come from counters kept by each task and offsets per (task,
length), so that a very common length is never sorted or held in one task.

Null text is the empty text, which is one piece holding only the end id. Repeated rows
are packed each on its own, very long texts are cut into many pieces. Columns other than ``doc_id`` and ``text`` are not read.
An empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.llm import _common, bpe

CAPACITY = 2048
END_ID = 0
#: Rounds of pricing, at most, and columns that one pricing gives: they bound the slot table, and what they leave goes to best fit.
ROUNDS = 400
COLUMNS = 96
#: A column that one of its lengths needs may be worth so much less than the best one.
SLACK = 0.0005
#: How much more a large piece is worth for its length at first: small ones fit later too.
LARGE = 0.02
#: Share of a length that one column may hold, at most.
STEP = 0.5
#: How fast a length loses weight as more of it is held.
SPREAD = 8.0
#: Entries of the memo of each task.
MEMO = 400_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


class FastIds:
    """Ids of a text as little-endian unsigned 32-bit bytes, with a memo for what stands between spaces."""

    def __init__(self, path: str, ranks_path: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        merges = bpe.MergeTable.load(path)
        self.coder = tiktoken.Encoding("ids", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens=merges.specials)
        self.stream = bpe.StreamingEncoder(merges)
        self.memo: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        if len(text) > 20_000:
            ids = [t for part in bpe.encode_stream(text, self.stream) for t in part]
        else:
            ids = self.coder.encode(text, allowed_special="all")
        return np.array(ids, dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        first, *pieces = text.split(" ")
        found = list(map(self.memo.get, pieces))
        if None in found:
            missed = [k for k, ids in enumerate(found) if ids is None]
            if any(not pieces[k] or pieces[k][0].isspace() for k in missed):
                return self._ids(text)
            for k in missed:
                found[k] = ids = self._ids(" " + pieces[k])
                if len(pieces[k]) <= 64:
                    if len(self.memo) >= MEMO:
                        self.memo.clear()
                    self.memo[pieces[k]] = ids
        return self._ids(first) + b"".join(found)


@functools.lru_cache(maxsize=1)
def _coder(path: str, ranks_path: str) -> FastIds:
    return FastIds(path, ranks_path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids; only the first may be short."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def pieces(df: DataFrame, capacity: int = CAPACITY, paths: tuple[str, str] | None = None) -> DataFrame:
    """The pieces of every row, each with its task and its place among that task's pieces of its length."""
    if paths is None:
        import public_tokenizers

        paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    _common.ship(df.sparkSession)

    def run(batches):
        coder, part, seen = _coder(*paths), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = coder(text) + END_ID.to_bytes(4, "little")
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, seen[length]))
                    seen[length] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = [x.split()[0] for x in PIECES.split(", ")]
            cols = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, PIECES)


def knapsack(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every room up to ``capacity`` the most that copies of ``lengths`` (ascending) in it are worth, and the place of one of them, -1 for none."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1, dtype=np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        k = fits[room]
        if k:
            gain = best[room - lengths[:k]] + worth[:k]
            i = int(gain.argmax())
            if gain[i] > best[room - 1]:
                best[room], last[room] = gain[i], i
                continue
        best[room], last[room] = best[room - 1], -2  # as with one less
    return best, last


class Program:
    """The configuration program of a histogram, solved by multiplicative weights.

    Its columns are configurations, its rows say that all pieces of each length are held. ``columns`` has
    (places of lengths with their numbers, use); together they hold every piece exactly. ``bound`` is the
    best dual value seen: no packing, not even a fractional one, takes fewer sequences.
    """

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS):
        self.lengths = np.array(sorted(n for n, c in counts.items() if c > 0), dtype=np.int64)
        self.number = np.array([counts[n] for n in self.lengths.tolist()], dtype=np.float64)
        self.columns: dict[tuple[tuple[int, int], ...], float] = {}
        self.bound = float((self.lengths * self.number).sum() / capacity)
        first = self.lengths * (1 + LARGE * self.lengths / capacity)
        done = np.zeros(len(self.lengths))  # share of each length that is held
        for k in range(rounds):
            open_ = np.flatnonzero(done < 1 - 1e-9)
            if not len(open_):
                break
            # weights start from the size of a length and fall with what is held of it
            worth = first * np.exp(-(done - done[open_].min()) / SPREAD)
            best, last = knapsack(self.lengths[open_], worth[open_], capacity)
            if not k or len(open_) == len(done):
                self.bound = max(self.bound, float((worth * self.number).sum() / best[capacity]))
            value = worth[open_] + best[capacity - self.lengths[open_]]
            near = np.flatnonzero(value >= (1 - SLACK) * best[capacity])
            near = near[np.argsort(done[open_[near]], kind="stable")][:COLUMNS]
            for i in near.tolist():
                held, room = {int(open_[i]): 1}, capacity - int(self.lengths[open_[i]])
                at = room
                while last[at] != -1:
                    if last[at] == -2:
                        at -= 1
                        continue
                    j = int(open_[last[at]])
                    held[j] = held.get(j, 0) + 1
                    room, at = room - int(self.lengths[j]), at - int(self.lengths[j])
                use = min(min(STEP, 1 - done[j]) * self.number[j] / a for j, a in held.items())
                if use <= 1e-9:
                    continue
                for j, a in held.items():
                    done[j] += a * use / self.number[j]
                column = tuple(sorted(held.items()))
                self.columns[column] = self.columns.get(column, 0.0) + use
        self.done = done

    def value(self) -> float:
        return sum(self.columns.values())


def rounded(program: Program, counts: dict[int, int]) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Whole sequences from a program's columns, and the pieces that they leave.

    The running sum of uses is rounded, so that all columns together make as many sequences as the
    program says, less those whose pieces have run out.
    """
    left, out, total, made = dict(counts), [], 0.0, 0
    for column, use in program.columns.items():
        total += use
        times = int(total + 1e-6) - made
        made += times
        held = {int(program.lengths[j]): a for j, a in column}
        times = min(times, *(left[n] // a for n, a in held.items()))
        if times > 0:
            out.append((held, times))
            for n, a in held.items():
                left[n] -= a * times
    return out, {n: c for n, c in left.items() if c}


def configurations(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """[(pieces of each length in one sequence, number of such sequences)] that use up ``counts`` exactly.

    The program is solved and rounded; best fit puts what rounding leaves into the room left, and opens new sequences for what doesn't fit.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    full = left.pop(capacity, 0)
    found, rest = rounded(Program(left, capacity, rounds), left)
    return [({capacity: 1}, full)] * bool(full) + _best_fit(rest, capacity, found)


def _best_fit(left: dict[int, int], capacity: int, begun: list[tuple[dict[int, int], int]] = ()) -> list[tuple[dict[int, int], int]]:
    """Best fit, largest first, over counts, into sequences ``begun`` and new ones: groups of equal sequences are filled together."""
    groups: dict[int, list[tuple[dict[int, int], int]]] = {}  # by room left
    for held, times in begun:
        groups.setdefault(capacity - sum(n * a for n, a in held.items()), []).append((held, times))
    for n in sorted(left, reverse=True):
        c = left[n]
        while c:
            room = min((r for r in groups if r >= n), default=None)
            filled, times = groups[room].pop() if room is not None else ({}, c)
            if room is not None and not groups[room]:
                del groups[room]
            room = capacity if room is None else room
            fit = room // n
            if c < fit:
                fit = c
            use = min(times, c // fit)
            if use < times:
                groups.setdefault(room, []).append((filled, times - use))
            groups.setdefault(room - fit * n, []).append((filled | {n: filled.get(n, 0) + fit}, use))
            c -= use * fit
    return [g for same in groups.values() for g in same if g[0]]


def slots(found: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each length and configuration: first rank, pieces in a sequence, first sequence, first offset."""
    rows, ranks, sequence = [], {}, 0
    for chosen, times in found:
        offset = 0
        for n in sorted(chosen, reverse=True):
            rows.append((n, ranks.get(n, 0), chosen[n], sequence, offset))
            ranks[n] = ranks.get(n, 0) + chosen[n] * times
            offset += n * chosen[n]
        sequence += times
    rows.sort()
    cols = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "each", "sequence", "offset"), cols, strict=True))


def pack(df: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS, paths: tuple[str, str] | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = df.sparkSession
    cut_up = _common.materialise(pieces(df, capacity, paths))
    by_task = cut_up.groupBy("part", "length").agg((F.max("place") + 1).alias("n"))
    by_task = _common.materialise(
        by_task.select("part", "length", "n", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    )
    # At most ``capacity`` rows come to the driver, and the slots are bounded by rounds, columns and capacity.
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(slots(configurations(counts, capacity, rounds)))

    def place(batches):
        t = table.value
        key = t["length"] << 48 | t["rank"]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("place").to_numpy(zero_copy_only=False) + batch.column("before").to_numpy(zero_copy_only=False)
            k = np.searchsorted(key, length << 48 | rank, side="right") - 1
            copy, at = np.divmod(rank - t["rank"][k], t["each"][k])
            own = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(t["sequence"][k] + copy), pa.array(t["offset"][k] + at * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    # the table of tasks and lengths grows with the corpus, so it must not be broadcast
    return cut_up.join(by_task.drop("n").hint("merge"), ["part", "length"]).mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_common.table(spark, sf_dir, "documents"))
