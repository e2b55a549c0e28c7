"""Chat formatting, the manifest and importance resampling against brute force, on small tables with nulls, ties, repeated rows and long texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from riskweave.llm import chat, importance, langid, licences, manifest, merkle, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, g string, digest string, leaf string, n long, i long"
rnd = random.Random(5)
WORDS = ["alpha", "Beta", "é", "日本", "🙂", "x1", "don't", "İ", "\n", "a\nb", "-", "Zürich"]
_more = (0.5, "g", "d", "l", 7, 8)


def text(n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


ROWS = [(k * 7 - 90, text(rnd.randint(0, 60)), rnd.choice(["en", None]), rnd.choice(["a", "b", "", None, "é", "🙂", "￿"]), rnd.choice([1, None]), *_more) for k in range(260)]
ROWS += [(k, text(8), None, "far", 3, *_more) for k in (-(2**63), 2**63 - 1, 0, 65535, 65536, 2**48, -1)]
ROWS += [(None, text(30), "en", "a", 1, *_more) for _ in range(40)] + [(12, text(25), "en", "b", 1, *_more) for _ in range(20)]
ROWS += [(13, "same\ntext here " * 9, "en", "b", 1, *_more)] * 9 + [(None, None, None, None, None, *_more)] * 4
ROWS += [(9000, None, "en", "s", 0, *_more), (9001, "", "en", "alone", 0, *_more), (9002, "long " + "a" * 40_000 + "\n" + text(4000), "en", "s", 1, *_more)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(5).cache()


# importance resampling


def brute_words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute_resample(rows, target, percent, least, buckets, shortest, longest, seed=2024):
    runs = lambda ws: [" ".join(ws[k : k + n]) for n in range(shortest, longest + 1) for k in range(len(ws) - n + 1)]
    bucket = lambda r: zlib.crc32(r.encode()) % buckets
    mine = [(r[0], brute_words(r[1])) for r in rows]
    s, t = Counter(), Counter()
    for _, ws in mine:
        s.update(map(bucket, runs(ws)))
    for x in target:
        t.update(map(bucket, runs(brute_words(x))))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    out = []
    for doc_id, ws in mine:
        fs = runs(ws)
        weight = sum(gain[bucket(f)] for f in fs)
        h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(ws)))
    fit = sorted((-r[3], r[0] is None, r[0] or 0) for r in out if r[4] >= least)
    return Counter(r[:4] for r in out), [(-a, None if none else c) for a, none, c in fit[: percent * len(fit) // 100]]


@pytest.mark.parametrize(("buckets", "shortest", "longest", "percent", "least"), [(10_000, 1, 1, 10, 20), (50, 1, 3, 100, 1), (997, 2, 2, 33, 5)])
def test_resample_is_the_brute_force_draw(spark, docs, buckets, shortest, longest, percent, least):
    target = ["alpha beta 日本", None, "Zürich x1 x1 alpha", ""]
    goal = spark.createDataFrame([(k, t, 1) for k, t in enumerate(target)], "doc_id long, text string, score long")
    got = importance.resample(docs, goal, percent, least, buckets, shortest, longest).collect()
    rows, drawn = brute_resample(ROWS, target, percent, least, buckets, shortest, longest)
    assert Counter(tuple(r)[:4] for r in got) == rows
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r["score"], r["doc_id"]) for r in ranked] == drawn


def test_resample_of_empty_tables(spark, docs):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, docs).count() == 0
    got = importance.resample(docs, none).collect()
    assert Counter(tuple(r)[:4] for r in got) == brute_resample(ROWS, [], 10, 20, 10_000, 1, 1)[0]


def test_a_draw_leans_to_the_target(spark):
    rows = [(k, " ".join(rnd.choice(["red", "blue"] if k % 2 else ["cat", "dog"]) for _ in range(30))) for k in range(1000)]
    goal = spark.createDataFrame([(1, "cat dog cat")], "doc_id long, text string")
    got = importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), goal).where("rank IS NOT NULL").collect()
    assert len(got) == 100 and all(r["doc_id"] % 2 == 0 for r in got)


# manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(doc_id, source, lang, n_chars, t):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, t)))


def fold_up(level):
    """The top of a run of digests and, for each, the pairs of what stands left and right of it on the way up."""
    at, steps = list(range(len(level))), [[] for _ in level]
    while len(level) > 1:
        for k, a in enumerate(at):
            run = a - a % 3
            steps[k].append(("".join(level[run:a]), "".join(level[a + 1 : run + 3])))
            at[k] = a // 3
        level = [sha(*level[k : k + 3]) for k in range(0, len(level), 3)]
    return level[0], steps


def brute_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        doc_id, t, lang, source, n_chars = r[:5]
        leaf = brute_leaf(doc_id, source, lang, n_chars, t)
        bad = leaf if doc_id is None or zlib.crc32(str(doc_id).encode()) % 2 or t is None else brute_leaf(doc_id, source, lang, n_chars, t.replace("\n", ""))
        groups[source].append((doc_id is not None, doc_id or 0, leaf, bad, doc_id))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops = {s: fold_up([x[2] for x in sorted(groups[s])]) for s in names}
    root, over = fold_up([tops[s][0] for s in names])
    out = Counter()
    for k, s in enumerate(names):
        for x, steps in zip(sorted(groups[s]), tops[s][1], strict=True):
            way, folded = steps + over[k], x[3]
            for left, right in way:
                folded = sha(left, folded, right)
            out[x[4], x[2], tops[s][0], root, sha(*(p for pair in way for p in pair)), folded, folded == root] += 1
    return out


def query(docs, deep=manifest.LEVELS):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return manifest.manifest(docs, F.when(tampered, manifest.leaf(text=F.replace(F.col("text"), F.lit("\n"), F.lit("")))).otherwise(manifest.leaf()), deep)


def test_manifest_is_the_brute_force_trie(docs):
    got = Counter(map(tuple, query(docs).collect()))
    assert got == brute_manifest(ROWS)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("sizes", [(1, 2, 3, 4, 9, 10, 27), (28, 81, 82, 244)])
def test_manifest_of_many_rounds(spark, sizes):
    """With two levels a task, so that small groups take several rounds."""
    rows = [(k * k, f"t\n{k}", "en", f"g{n}", k, *_more) for n in sizes for k in range(n)]
    rows += [(k, "x", None, f"s{k}", 1, *_more) for k in range(sizes[-1] // 4)]
    got = Counter(map(tuple, query(spark.createDataFrame(rows, DOCS), 2).collect()))
    assert got == brute_manifest(rows)


def test_manifest_of_no_rows_and_of_sound_rows(spark, docs):
    assert query(docs.limit(0)).count() == 0
    assert manifest.manifest(docs).where("verified").count() == len(ROWS)


# chat


def brute_paths(rows, top):
    """rows: (tree, node, parent, role, text, score) with ids told apart."""
    trees = defaultdict(dict)
    for r in rows:
        trees[r[0]][r[1]] = r
    out = {}
    for tree, nodes in trees.items():
        parents, found = {r[2] for r in nodes.values()}, []
        for leaf in nodes:
            way, at = [], leaf
            while at in nodes and len(way) <= len(nodes):
                way.append(nodes[at])
                at = nodes[at][2]
            if leaf not in parents and len(way) <= len(nodes):
                found.append((-sum(r[5] or 0.0 for r in way) / len(way), leaf, [(r[3] or "", r[4] or "") for r in reversed(way)]))
        for k, (_, leaf, way) in enumerate(sorted(found)[:top]):
            out[tree, leaf] = (k + 1, way)
    return out


SAYINGS = ["hello", "", None, "</s>[INST] ok [/INST]", "\\", "<\\s>", "\\<s>", "<<SYS>>x<</SYS>>", "[INST", "a\nb🙂", "<<ROLE>>q<</ROLE>>z<</TEXT>>", "[\\INST]\\\\", "<</s>", "x" * 30_000]
MESSAGES = "tree string, node long, parent long, role string, text string, score double, piece string, path long, rank int, at int"


def forest():
    rows = []
    for tree, n in (("a", 1), ("b", 40), (None, 25), ("", 12), ("=", 7), ("long", 300)):
        for k in range(n):
            parent = None if k == 0 else k - 1 if tree == "long" else rnd.choice([rnd.randrange(k), rnd.randrange(k), 999, None])
            rows.append((tree, k, parent, rnd.choice(["user", "assistant", "system", "tool [INST]", None, "role", "text"]), rnd.choice(SAYINGS[:-1] if k else SAYINGS), rnd.choice([0.0, 1.0, 2.5, None]), "p", 1, 1, 1))
    return rows + [("ring", 1, 2, "user", "x", 1.0, "p", 1, 1, 1), ("ring", 2, 1, "user", "y", 1.0, "p", 1, 1, 1), ("ring", 3, 2, "user", "z", 1.0, "p", 1, 1, 1)]


@pytest.mark.parametrize("top", [1, 3])
def test_best_paths_of_reply_trees(spark, top):
    rows = forest()
    got = chat.formatted(spark.createDataFrame(rows, MESSAGES).repartition(3), top).collect()
    want = brute_paths(rows, top)
    assert {(r["tree"], r["path"]): r["rank"] for r in got} == {k: v[0] for k, v in want.items()}
    for r in got:
        way = want[r["tree"], r["path"]][1]
        assert list(chat.parse(r["formatted"])) == way
        assert [chat.unescape(r["formatted"][a:b]) for a, b in r["loss"]] == [t for role, t in way if role == "assistant"]


def test_no_text_poses_as_a_turn(spark):
    rows = [(k, s) for k, s in enumerate(SAYINGS) if s is not None]
    for k, escaped in spark.createDataFrame(rows, "k long, s string").select("k", chat.escape(F.col("s"))).collect():
        assert not any(m in escaped for m in chat._ALL) and chat.unescape(escaped) == SAYINGS[k]
    with pytest.raises(ValueError):
        list(chat.parse("[INST]a[/INST] b <s>c</s>"))


def test_threads_keep_every_row_in_order(spark):
    rows = [(1, 2, "user", "b"), (1, 0, "system", None), (1, 1, "user", "a"), (1, 1, "user", "a"), (None, 0, "user", "n"), (None, None, "assistant", "first"), (2, 0, "assistant", "<s>"), (3, 5, None, "x")]
    got = {r["tree"]: r for r in chat.digests(chat.format_paths(*chat.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()}
    turns = {"1": [("system", ""), ("user", "a"), ("user", "a"), ("user", "b")], None: [("assistant", "first"), ("user", "n")], "2": [("assistant", "<s>")], "3": [("", "x")]}
    assert set(got) == set(turns)
    for tree, way in turns.items():
        said = "".join(t for role, t in way if role == "assistant")
        assert got[tree]["n_turns"] == len(way) and got[tree]["turns_sha256"] == sha(*(f"{role}\n{t}\n" for role, t in way))
        assert (got[tree]["loss_chars"], got[tree]["loss_sha256"]) == (len(said), sha(said))


def test_chat_of_no_rows(spark):
    assert chat.formatted(spark.createDataFrame([], MESSAGES)).count() == 0


# texts that repeat, and lines of many tags


def test_toxicity_learns_from_a_text_that_repeats(spark):
    """One toxic text fills most of the table; it counts once and is learnt all the same."""
    clean = [" ".join(rnd.choice(["sun", "rain", "wind", "cloud", "tree", "road", "house", "river"]) for _ in range(12)) for _ in range(400)]
    toxic = [f"you vile slugger number {k % 12}" for k in range(12)]
    rows = [(k, t) for k, t in enumerate([*clean, *toxic])] + [(10_000 + k, "vile slugger vile again") for k in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    labels = spark.createDataFrame([(k, int("vile" in t)) for k, t in rows], "doc_id long, toxic int")
    got = toxicity.score(docs, *toxicity.train(docs, labels)).groupBy((F.col("doc_id") >= 400).alias("toxic")).agg(F.min("score").alias("low"), F.max("score").alias("high")).collect()
    ends = {r["toxic"]: (r["low"], r["high"]) for r in got}
    assert ends[True][0] >= 0.3 > ends[False][1] and ends[False][0] > 0


def test_toxicity_of_one_class_only(spark):
    docs = spark.createDataFrame([(k, f"word{k % 3} other") for k in range(40)], "doc_id long, text string")
    for value in (0, 1):
        labels = docs.select("doc_id", F.lit(value).alias("toxic"))
        scores = [r["score"] for r in toxicity.score(docs, *toxicity.train(docs, labels)).collect()]
        assert len(scores) == 40 and all(0 <= s <= 1 for s in scores)


def test_language_of_one_text_that_repeats(spark):
    """A language of 40,000 copies of one text is learnt, and takes no text of others."""
    rows = [(k, rnd.choice(["the sun and the rain", "over the hills", "what the day brings"]) + f" {k}", "en") for k in range(300)]
    rows += [(1000 + k, rnd.choice(["die sonne und der regen", "über die hügel", "was der tag bringt"]) + f" {k}", "de") for k in range(300)]
    rows += [(10_000 + k, "xyzzy plugh qwrk zzt", "yy") for k in range(40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    model = langid.train(docs)
    assert model.langs == ["de", "en", "yy"]
    asked = [(1, "the rain over the hills"), (2, "der regen über die hügel"), (3, "qwrk zzt xyzzy"), (4, "жжж щщщ")]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert (got[1], got[2], got[3]) == ("en", "de", "yy")


def test_many_tags_on_a_line_take_time_in_proportion():
    import time

    def took(n):
        began = time.perf_counter()
        found = licences.scan("SPDX-License-Identifier: MIT OR Apache-2.0 " * n + "SPDX-License-Identifier: (MIT OR " * n)
        assert "mit" in found[7] and "apache" in found[7]
        return time.perf_counter() - began

    took(100)
    assert took(8000) < 30 * max(took(800), 0.02)


def test_an_expression_ends_where_the_next_tag_begins():
    assert licences._expression_at(" MIT OR Apache-2.0 ") == "MIT OR Apache-2.0"
    apart = licences.scan("SPDX-License-Identifier: MIT SPDX-License-Identifier: Apache-2.0\n")
    lines = licences.scan("SPDX-License-Identifier: MIT\nSPDX-License-Identifier: Apache-2.0\n")
    assert apart[5] == lines[5] and apart[7] == lines[7]


# ranges of ids in op8


@pytest.mark.parametrize("ids", ["two far clusters", "one id repeats", "spread", "null"])
def test_ranges_of_rows_stay_short(spark, ids):
    """Ranges hold about RANGE_ROWS rows wherever ids lie and however often one repeats, and every row meets its next."""
    n = 12_000
    of = {"two far clusters": lambda k: k if k % 2 else 10**15 + 7 * k, "one id repeats": lambda k: 77 if k % 2 else k, "spread": lambda k: (k * 2**50) % 2**62 - 2**61, "null": lambda k: None if k % 3 else k}[ids]
    rows = [(of(k), f"text {k}") for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    if ids != "null":
        keyed = docs.select(F.col("doc_id").alias("key"), F.xxhash64("text").alias("tie"))
        ranges = keyed.groupBy(merkle._ranges(keyed).alias("range")).agg(F.count("*").alias("n"), F.min(F.struct("key", "tie")).alias("low"), F.max(F.struct("key", "tie")).alias("high")).orderBy("range").collect()
        assert max(r["n"] for r in ranges) <= 4 * merkle.RANGE_ROWS and len(ranges) >= n // merkle.RANGE_ROWS // 2
        assert all(a["high"] <= b["low"] for a, b in zip(ranges, ranges[1:], strict=False))
    hashes = dict(docs.select("text", F.xxhash64("text")).collect())
    order = [t for _, _, _, t in sorted((d is not None, d or 0, hashes[t], t) for d, t in rows)]
    got = {r["text"]: r["next"] for r in merkle.with_next(docs).collect()}
    assert got == dict(zip(order, [*order[1:], order[0]], strict=True))


# registered queries against their SQL forms


@pytest.mark.parametrize("name", ["op11_chat", "op12_manifest", "op13_resample"])
def test_registered_queries_equal_their_sql(spark, name):
    import duckdb

    from riskweave.llm import registry

    data, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    got, want = registry.queries()[name](spark, data), con.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())
