"""Licence scan: an Aho-Corasick automaton over words, and licence expressions.

One pass of the automaton over a text's words finds identifier tags and notice phrases.
What follows a tag is read as a licence expression: a shunting-yard parser turns
``and``, ``or``, ``with`` and parentheses into postfix order, and its evaluation gives
the licences that bind: both sides of ``and``; of ``or`` the side that is permissive throughout, or
both where neither is or both are; with an exception its own label. These enter ``labels``; all that
was named stands in ``named``, and ``permissive`` says whether nothing that binds is restrictive.

Words are runs of characters other than ASCII punctuation and white space, A-Z
lower-cased. Null text is the empty text: no words, no labels, score 0, ``permissive`` null as wherever no
licence is found. Repeated rows are scanned each on its own, very long texts whole, in one pass. Columns other than
``doc_id`` and ``text`` are not read. A malformed expression gives no label of its own. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import _common

#: Fixed base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notice phrases, with their labels.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc0": "cc0",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "isc license": "isc",
    "all rights reserved": "proprietary",
    "public domain": "public-domain",
}
#: An expression stands after this tag, to the end of the line.
TAG = "spdx license identifier"
#: Labels of identifiers in expressions, by prefix, longest first.
IDENTIFIERS = {
    "agpl": "agpl", "apache": "apache", "bsd": "bsd", "bsl": "bsl", "cc-by": "cc-by", "cc-by-nc": "cc-by-nc", "cc-by-nc-nd": "cc-by-nc-nd", "cc-by-nc-sa": "cc-by-nc-sa",
    "cc-by-nd": "cc-by-nd", "cc-by-sa": "cc-by-sa", "cc0": "cc0", "epl": "epl", "gpl": "gpl", "isc": "isc", "lgpl": "lgpl", "mit": "mit", "mpl": "mpl", "unlicense": "public-domain",
}
PERMISSIVE = {"apache", "bsd", "bsl", "cc-by", "cc0", "isc", "mit", "public-domain"}
#: Confidence of each kind of evidence; they combine as independent.
WEIGHT = {"expression": 0.99, "choice": 0.97, "base": 0.9, "notice": 0.8, "weak": 0.3}
#: Ends the label of a licence that an exception goes with.
EXCEPTION = "-exception"
WEAK = {"proprietary", "public-domain", "cc0"}

#: ASCII that parts words becomes a space; A-Z are lower-cased.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+-]+")
_BINDS = {"or": 1, "and": 2, "with": 3}


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: operators after their operands; ValueError where the expression is malformed."""
    out: list[str] = []
    ops: list[str] = []
    operand = False  # did an operand end just before?
    for t in tokens:
        low = t.lower()
        if low in _BINDS:
            if not operand:
                raise ValueError(f"{t} without a left side")
            while ops and ops[-1] != "(" and _BINDS[ops[-1]] >= _BINDS[low]:
                out.append(ops.pop())
            ops.append(low)
            operand = False
        elif t == "(":
            if operand:
                raise ValueError("( after an operand")
            ops.append(t)
        elif t == ")":
            if not operand:
                raise ValueError(") without an operand")
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                raise ValueError(") without (")
            ops.pop()
        else:
            if operand:
                raise ValueError("two operands in a row")
            out.append(t)
            operand = True
    if not operand or "(" in ops:
        raise ValueError("unfinished expression")
    return out + ops[::-1]


def label_of(identifier: str) -> str | None:
    """The label of an identifier: of a known name alone, or followed by a version or a variant."""
    low = identifier.lower()
    for name in sorted(IDENTIFIERS, key=len, reverse=True):
        if low.startswith(name) and not low[len(name) :][:1].isalpha():
            return IDENTIFIERS[name]
    return None


def evaluate(expression: str) -> tuple[set[str], bool, set[str]]:
    """Labels that bind, whether some choice of the alternatives is permissive throughout, and all labels named."""
    stack: list[tuple[set[str], bool, set[str]]] = []
    for t in postfix(_TOKEN.findall(expression)):
        if t.lower() not in _BINDS:
            label = label_of(t)
            own = {label} if label else set()
            stack.append((own, label in PERMISSIVE, own))
            continue
        (right, right_free, right_named), (left, left_free, left_named) = stack.pop(), stack.pop()
        if t == "with":  # an exception changes the terms of what is left of it, and names no licence
            stack.append(({x if x.endswith(EXCEPTION) else x + EXCEPTION for x in left}, left_free, left_named))
        elif t == "and" or left_free == right_free:
            stack.append((left | right, left_free and right_free if t == "and" else left_free, left_named | right_named))
        else:
            stack.append((left if left_free else right, True, left_named | right_named))
    return stack[0]


@functools.cache
def _automaton():
    found = ahocorasick.Automaton()
    for phrases, kind in ((NOTICES, "notice"), (BASE, "base")):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (kind, label, len(phrase.split())))
    found.add_word(f" {TAG} ", ("tag", "", len(TAG.split())))
    found.make_automaton()
    return found


_LINE = re.compile(r"spdx[^a-z0-9\n]*license[^a-z0-9\n]*identifier[^a-z0-9(\n]*", re.IGNORECASE)


def _expression_at(line: str) -> str:
    """The longest leading part of a line that is an expression."""
    tokens = []
    for m in re.finditer(r"[\s:]*(\(|\)|[A-Za-z0-9.+-]+)|[^\s]", line):
        if m.group(1) is None:
            break
        tokens.append(m.group(1))
    end, depth, operand = 0, 0, False  # the state of ``postfix``: where it was last complete
    for k, t in enumerate(tokens, 1):
        if t.lower() in _BINDS or t == ")":
            if not operand or (t == ")" and not depth):
                break
            depth -= t == ")"
            operand = t == ")"
        else:
            if operand:
                break
            depth += t == "("
            operand = t != "("
        if operand and not depth:
            end = k
    return " ".join(tokens[:end])


def scan(text: str) -> tuple[int, int, int | None, int | None, str, str, float, str, bool | None]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, named and permissive of one text."""
    words = text.encode().translate(_FOLD).split()
    joined = " " + b" ".join(words).decode() + " "
    base: set[str] = set()
    labels: set[str] = set()
    named: set[str] = set()
    spoken: set[str] = set()  # what expressions say
    free: list[bool] = []
    n_base, first, last, miss, tagged = 0, None, None, 1.0, False
    at, count = 0, 0  # word number of the last place looked at: matches come in order of their ends
    for end, (kind, label, length) in _automaton().iter(joined):
        if kind == "tag":
            tagged = True
        elif kind == "notice":
            labels.add(label)
            miss *= 1 - WEIGHT["weak" if label in WEAK else "notice"]
        else:
            count += joined.count(" ", at, end)
            at = end
            start = count - length
            n_base += 1
            first = start if first is None else min(first, start)
            last = start if last is None else max(last, start)
            base.add(label)
            miss *= 1 - WEIGHT["base"]
    if tagged:
        tags = [m.span() for m in _LINE.finditer(text)]
        for (_, start), (limit, _) in zip(tags, [*tags[1:], (len(text), 0)], strict=True):
            stop = text.find("\n", start, limit)  # an expression ends with its line, or where the next tag begins
            expression = _expression_at(text[start : stop if stop >= 0 else limit])
            binding, permissive, all_named = evaluate(expression) if expression else (set(), False, set())
            if all_named:
                named |= all_named
                spoken |= binding
                free.append(permissive)
                # what leaves a choice is weaker evidence of any one licence
                miss *= 1 - WEIGHT["expression" if {x.removesuffix(EXCEPTION) for x in binding} == all_named else "choice"]
    free += [x in PERMISSIVE for x in base | labels]
    found = base | labels | spoken
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(found)), 1 - miss, ",".join(sorted(base | labels | named)), all(free) if found else None


def scan_documents(df: DataFrame) -> DataFrame:
    """One row per row of ``df``: doc_id and what ``scan`` finds in its whole text."""
    _common.ship(df.sparkSession)
    kinds = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("named", pa.string()), ("permissive", pa.bool_())]

    def run(batches):
        for batch in batches:
            done = [scan(t) for t in batch.column("text").to_pylist()]
            cols = [pa.array([x[k] for x in done], kind) for k, (_, kind) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", *(n for n, _ in kinds)])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, named string, permissive boolean")


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(_common.table(spark, sf_dir, "documents"))
