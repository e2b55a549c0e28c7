"""Personal data by weak-supervision aggregation, in DataFrame functions alone.

Candidate spans come from patterns. Five labelers vote on each (1 for, -1 against, 0
abstains): its form, its checksum or range, gazetteers of prefixes and endings, the words
before it, and its edges. Expectation-maximisation over the table of vote patterns
estimates each labeler's reliability for each kind and the probability that a candidate is
real; a logistic span classifier is then trained on those probabilities and decides.
Vote patterns are counted over all candidates of all texts; their table is bounded by the
numbers of kinds, labelers and buckets, and only it reaches the driver.

Base spans (patterns whose match passes its check) always stay. The method adds spans of
kinds ``secret``, ``email_spelled`` and ``phone_local`` where they overlap no base span.

Null text is the empty text and has no span. Positions are code points, ends exclusive.
Everything is computed within a row, so repeated rows and null ids are no special case; work grows in
proportion to a text's length, however many matches it has. Columns other than ``doc_id`` and ``text`` (and ``n_chars``, in the
pipeline) are not read. Added spans never overlap a base span; where two of them overlap each other both are reported. An empty table gives no rows; with no candidates nothing is trained and nothing added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import _common

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "email_spelled", "phone_local")

_LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns as given, kept from scanning a run of characters again from each of its places:
#: a match starts where such a run starts, or where the last match ended.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?<=(?:password|passwd|secret|token|api_key|apikey)[\"']?\s{0,2}[:=]\s{0,2}[\"']?)[A-Za-z0-9+/_-]{8,}+",
    "email_spelled": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,64}+ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{2,64}+ ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z]{2,10}+",
    "phone_local": r"(?<![0-9+() -])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: Cheap tests that a text must pass before its pattern is tried.
_DIGIT = lambda t: t.rlike("[0-9]")
_TRIES = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": _DIGIT,
    "phone": lambda t: t.contains("+"),
    "secret": lambda t: t.rlike(r"AKIA|(?:password|passwd|secret|token|api_key|apikey)[\"']?\s{0,2}[:=]"),
    "email_spelled": lambda t: t.rlike(r"[\[(]at[\])]"),
    "phone_local": lambda t: t.rlike(r"[0-9]{3}[ .-][0-9]{4}"),
}
#: Gazetteers: endings of domains, first digits of cards, country codes, prefixes of keys.
DOMAINS = "com|org|net|edu|gov|info|io|eu|de|fr|es|uk|it|nl"
ISSUERS = "3[47]|4|5[1-5]|2[2-7]|6011|65|35"
COUNTRIES = "1|33|34|39|41|43|44|49|31|32|351|7|81|86|91"
#: Words before a span that speak for its kind, and words that speak against any.
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|host|server|address|addr",
    "card": "card|visa|credit|pay|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon",
    "secret": "password|passwd|secret|token|key|akia",
    "email_spelled": "mail|contact|write",
    "phone_local": "phone|tel|call|mobile|fax",
}
AGAINST = "version|isbn|page|figure|section|chapter|issn|doi"
LABELERS = ("form", "checked", "listed", "context", "edges")
BEFORE = 24
THRESHOLD = 0.5
EM_ROUNDS = 25
#: Matches of a part of a text.
PART = 256

_SPAN = "struct<kind:int,start:int,end:int,s:string,before:string,after:string>"


def _places(kind: str) -> tuple[str, str]:
    """SQL: the matches of a kind in parts of at most PART, each with its length in text and the places of its matches in it; and the place of each part.

    An array that grows by one is copied whole, so places are gathered part by part.
    """
    g, h = f"_g_{kind}", f"_h_{kind}"
    part = (
        f"aggregate(sequence(b * {PART}, least(size({h}), (b + 1) * {PART}) - 1), struct(0 AS pos, cast(array() AS array<int>) AS at), "
        f"(a, i) -> struct(a.pos + length({g}[i]) + length({h}[i]) AS pos, concat(a.at, array(a.pos + length({g}[i]))) AS at))"
    )
    parts = f"CASE WHEN size({h}) > 0 THEN transform(sequence(0, (size({h}) - 1) div {PART}), b -> {part}) END"
    base = (
        f"aggregate(_p_{kind}, struct(0 AS pos, cast(array() AS array<int>) AS at), "
        "(a, q) -> struct(a.pos + q.pos AS pos, concat(a.at, array(a.pos)) AS at), a -> a.at)"
    )
    return parts, base


def _found(kind: str) -> str:
    """SQL: the matches of a kind as spans, from columns of what stands between matches, of matches and of places."""
    g, h = f"_g_{kind}", f"_h_{kind}"
    starts = f"flatten(zip_with(_p_{kind}, _b_{kind}, (q, b) -> transform(q.at, x -> x + b)))"
    span = (
        f"transform({starts}, (p, i) -> cast(named_struct('kind', {KINDS.index(kind)}, 'start', p, 'end', p + length({h}[i]), 's', {h}[i], "
        f"'before', right({g}[i], {BEFORE}), 'after', left({g}[i + 1], 1)) AS {_SPAN}))"
    )
    return f"CASE WHEN size({h}) > 0 THEN {span} ELSE cast(array() AS array<{_SPAN}>) END"


def _luhn(d: str) -> str:
    digit = f"cast(substr({d}, i, 1) AS int)"
    total = f"aggregate(sequence(1, length({d})), 0, (t, i) -> t + CASE WHEN (length({d}) - i) % 2 = 0 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END)"
    return f"(CASE WHEN length({d}) BETWEEN 14 AND 19 THEN {total} % 10 = 0 ELSE false END)"


def _checked() -> str:
    """SQL, by kind: does a span ``c`` pass the check of its kind?"""
    digits = "regexp_replace(c.s, '[^0-9]', '')"
    part = "forall(split(c.s, '[.]'), x -> length(ltrim('0', x)) <= 3 AND cast(right(x, 3) AS int) <= 255)"
    tests = {
        "email": "true",
        "ip": part,
        "card": _luhn(digits),
        "phone": f"length({digits}) BETWEEN 10 AND 15",
        "secret": "c.s RLIKE '[0-9]' AND c.s RLIKE '[A-Za-z]'",
        "email_spelled": "length(c.s) <= 140",
        "phone_local": f"length({digits}) = 10",
    }
    return "CASE c.kind " + " ".join(f"WHEN {KINDS.index(k)} THEN {t}" for k, t in tests.items()) + " END"


def _by_kind(what: dict[str, str], otherwise: str = "0") -> str:
    return "CASE c.kind " + " ".join(f"WHEN {KINDS.index(k)} THEN {t}" for k, t in what.items()) + f" ELSE {otherwise} END"


def _votes() -> dict[str, str]:
    yes_no = lambda test: f"CASE WHEN {test} THEN 1 ELSE -1 END"
    digits = "regexp_replace(c.s, '[^0-9]', '')"
    return {
        "form": _by_kind(
            {
                "email": yes_no("c.s RLIKE '^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[^@]*[.][A-Za-z]{2,10}$'"),
                "ip": yes_no("length(c.s) <= 15"),
                "card": yes_no("c.s RLIKE '^(?:[0-9]{14,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$'"),
                "phone": yes_no("c.s RLIKE '^[+][0-9]{1,3}[ .-]?[(]?[0-9]'"),
                "secret": yes_no("length(c.s) >= 16"),
                "email_spelled": "1",
                "phone_local": yes_no("c.s LIKE '(%'"),
            }
        ),
        "checked": yes_no("c.passed"),
        "listed": _by_kind(
            {
                "email": yes_no(f"lower(c.s) RLIKE '[.](?:{DOMAINS})$'"),
                "ip": yes_no("NOT c.s RLIKE '^(?:0|255)[.]'"),
                "card": yes_no(f"{digits} RLIKE '^(?:{ISSUERS})'"),
                "phone": yes_no(f"c.s RLIKE '^[+](?:{COUNTRIES})'"),
                "secret": "CASE WHEN c.s LIKE 'AKIA%' THEN 1 ELSE 0 END",
                "email_spelled": yes_no(f"lower(c.s) RLIKE '(?:{DOMAINS})$'"),
                "phone_local": "0",
            }
        ),
        "context": f"CASE WHEN lower(c.before) RLIKE '(?:{AGAINST})' THEN -1 WHEN "
        + _by_kind({k: f"lower(c.before) RLIKE '(?:{w})'" for k, w in CONTEXT.items()}, "false")
        + " THEN 1 ELSE 0 END",
        "edges": yes_no("NOT (c.before RLIKE '[A-Za-z0-9_]$') AND NOT (c.after RLIKE '[A-Za-z0-9_]')"),
    }


def candidates(df: DataFrame) -> DataFrame:
    """``df`` with ``found``: every candidate's kind, start, end, check, votes and buckets."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = df
    for kind in KINDS:
        tried, none = _TRIES[kind](text), F.array().cast("array<string>")
        out = out.withColumn(f"_g_{kind}", F.when(tried, F.split(text, PATTERNS[kind], -1)).otherwise(none))
        out = out.withColumn(f"_h_{kind}", F.when(tried, F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))).otherwise(none))
    places = {k: _places(k) for k in KINDS}
    out = out.withColumns({f"_p_{k}": F.expr(parts) for k, (parts, _) in places.items()})
    out = out.withColumns({f"_b_{k}": F.expr(base) for k, (_, base) in places.items()})
    out = out.withColumn("found", F.expr("concat(" + ", ".join(_found(k) for k in KINDS) + ")"))
    out = out.drop(*(f"_{x}_{k}" for x in "ghpb" for k in KINDS))
    out = out.withColumn("found", F.expr(f"transform(found, c -> struct(c.kind AS kind, c.start AS start, c.end AS end, c.s AS s, c.before AS before, c.after AS after, {_checked()} AS passed))"))
    votes = ", ".join(f"{sql} AS {name}" for name, sql in _votes().items())
    buckets = "least(4, cast(length(c.s) / 8 AS int)) AS size, cast(floor(3 * length(regexp_replace(c.s, '[^0-9]', '')) / greatest(length(c.s), 1)) AS int) AS digits"
    return out.withColumn("found", F.expr(f"transform(found, c -> struct(c.kind AS kind, c.start AS start, c.end AS end, c.passed AS passed, {votes}, {buckets}))"))


def expectation_maximisation(table: list[tuple[int, tuple[int, ...], float]]) -> list[float]:
    """Probability that the candidates of each (kind, votes, number) are real.

    Truth is hidden and labelers err independently of each other; those that abstain say nothing.
    Starts from the share of votes for; add-one smoothing keeps all rates inside (0, 1).
    """
    truth = [(1 + sum(v > 0 for v in votes)) / (2 + sum(v != 0 for v in votes)) for _, votes, _ in table]
    for _ in range(EM_ROUNDS):
        rate: dict[tuple, list[float]] = {}
        prior: dict[int, list[float]] = {}
        for (kind, votes, n), t in zip(table, truth, strict=True):
            p = prior.setdefault(kind, [1.0, 2.0])
            p[0] += n * t
            p[1] += n
            for j, v in enumerate(votes):
                if v:
                    for real, share in ((1, t), (0, 1 - t)):
                        # a labeler is taken to be better than chance before anything is seen
                        r = rate.setdefault((kind, j, real), [2.0 if real else 1.0, 3.0])
                        r[0] += n * share * (v > 0)
                        r[1] += n * share
        for k, (kind, votes, _) in enumerate(table):
            odds = math.log(prior[kind][0] / (prior[kind][1] - prior[kind][0]))
            for j, v in enumerate(votes):
                if v:
                    a, b = (rate[kind, j, real][0] / rate[kind, j, real][1] for real in (1, 0))
                    odds += math.log(a / b) if v > 0 else math.log((1 - a) / (1 - b))
            truth[k] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return truth


def _features(kind: int, votes: tuple[int, ...], size: int, digits: int) -> dict[str, float]:
    out = {f"kind{kind}": 1.0, f"size{size}": 1.0, f"digits{digits}": 1.0}
    return out | {f"{name}": float(v) for name, v in zip(LABELERS, votes, strict=True)}


def train(found: DataFrame) -> dict[str, float]:
    """Weights of the span classifier, from ``found`` of all rows; empty where there are no candidates."""
    c = F.col("c")
    names = ["kind", *LABELERS, "size", "digits"]
    rows = found.select(F.explode("found").alias("c")).groupBy(*(c[n].alias(n) for n in names)).agg(F.count(F.lit(1)).alias("n")).collect()
    rows = sorted(tuple(r) for r in rows)
    by_votes: dict[tuple, float] = {}
    for r in rows:
        by_votes[r[0], r[1:6]] = by_votes.get((r[0], r[1:6]), 0.0) + r[-1]
    table = [(kind, votes, n) for (kind, votes), n in by_votes.items()]
    real = {(kind, votes): t for (kind, votes, _), t in zip(table, expectation_maximisation(table), strict=True)}
    total = sum(r[-1] for r in rows)
    data = [(_features(r[0], r[1:6], r[6], r[7]), real[r[0], r[1:6]], r[-1] / total) for r in rows]
    weights: dict[str, float] = {f: 0.0 for x, _, _ in data for f in x}
    for _ in range(300):
        gradient = {f: 1e-4 * w for f, w in weights.items()}
        for x, t, share in data:
            z = sum(weights[f] * v for f, v in x.items())
            error = share * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - t)
            for f, v in x.items():
                gradient[f] += error * v
        for f, g in gradient.items():
            weights[f] -= 1.5 * g
    return weights


def _accepts(weights: dict[str, float]) -> str:
    """SQL: does the classifier accept span ``c``?"""
    if not weights:
        return "false"
    w = lambda f: f"({weights.get(f, 0.0)!r}D)"
    z = [f"{w(name)} * c.{name}" for name in LABELERS]
    z.append("CASE c.kind " + " ".join(f"WHEN {k} THEN {w(f'kind{k}')}" for k in range(len(KINDS))) + " END")
    z.append("CASE c.size " + " ".join(f"WHEN {k} THEN {w(f'size{k}')}" for k in range(5)) + " END")
    z.append("CASE c.digits " + " ".join(f"WHEN {k} THEN {w(f'digits{k}')}" for k in range(4)) + " END")
    return f"({' + '.join(z)}) >= {math.log(THRESHOLD / (1 - THRESHOLD))}D"


def decide(found: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Adds ``base`` and ``spans``: arrays of (start, kind, end), by start and then kind."""
    n = len(BASE_KINDS)
    out = found.withColumn("base", F.expr(f"array_sort(transform(filter(found, c -> c.kind < {n} AND c.passed), c -> struct(c.start AS start, c.kind AS kind, c.end AS end)))"))
    more = f"filter(found, c -> c.kind >= {n} AND {_accepts(weights)} AND NOT exists(base, b -> b.start < c.end AND c.start < b.end))"
    return out.withColumn("spans", F.expr(f"array_sort(concat(base, transform({more}, c -> struct(c.start AS start, c.kind AS kind, c.end AS end))))"))


def _joined(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, b -> concat_ws(':', {names}[b.kind], b.start, b.end)), ',')")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = _common.materialise(candidates(documents).select("doc_id", "found"))
    out = decide(found, train(found))
    number = [F.expr(f"cast(size(filter(base, b -> b.kind = {k})) AS bigint)").alias(f"n_{kind}") for k, kind in enumerate(BASE_KINDS)]
    return out.select("doc_id", *number, F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every span found is replaced by its kind in brackets; all rows stay, null texts as they are."""
    found = candidates(_common.hidden(docs, ("text", "n_chars")))
    out = decide(found, train(found.select("found")))
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    step = (
        "aggregate(spans, struct(0 AS pos, '' AS out), (a, b) -> CASE WHEN b.end <= a.pos THEN a WHEN b.start < a.pos THEN struct(b.end AS pos, a.out AS out) "
        f"ELSE struct(b.end AS pos, concat(a.out, substring(text, a.pos + 1, b.start - a.pos), {names}[b.kind]) AS out) END, "
        "a -> concat(a.out, substring(text, a.pos + 1)))"
    )
    out = out.withColumn("text", F.expr(f"CASE WHEN size(spans) > 0 THEN {step} ELSE text END"))
    n_chars = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return _common.shown(out, docs, ("text", "n_chars"), n_chars=n_chars)
