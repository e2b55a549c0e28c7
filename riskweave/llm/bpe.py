"""Byte-level BPE as a bounded-lookahead streaming transducer, and its inverse.

A merge can be undone by what stands to its right only if a rule of higher priority
takes a symbol of its right edge. Following such rules to ever higher priorities
bounds how many bytes to the right can matter: the merge list's *sufficient
lookahead*. A token is stable, and is emitted, once that many bytes follow it, so a
run of any length is encoded in a window of constant size.

Null text is treated as the empty text and gives no tokens. The special token's
string in a text becomes its id, as the tokenizers library does it.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import itertools
import json

import regex

#: Fixed pre-tokenization pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A text is fed to the transducer in slices of this many characters.
SLICE = 1 << 16
#: Entries of each memo; when one is full it is emptied.
MEMO = 300_000


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class MergeTable:
    """Vocabulary, ranked merges and the sufficient lookahead, in bytes, of a merge list."""

    def __init__(self, token_bytes: dict[int, bytes], merges: list[tuple[int, int, int]], specials: dict[str, int]):
        self.bytes = token_bytes
        self.specials = specials
        self.byte_id = {b[0]: i for i, b in token_bytes.items() if len(b) == 1}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for k, (a, b, c) in enumerate(merges):
            self.rank.setdefault((a, b), (k, c))
        self.order = {a << 32 | b: k for (a, b), (k, _) in self.rank.items()}
        self.made = [c for _, _, c in merges]
        self.lookahead = self._sufficient_lookahead(merges)

    @classmethod
    def load(cls, path: str) -> MergeTable:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, vocab = _byte_alphabet(), spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = {i: bytes(map(alphabet.__getitem__, t)) for t, i in vocab.items() if t not in specials}
        raw |= {i: t.encode() for t, i in specials.items()}
        return cls(raw, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], specials)

    def _sufficient_lookahead(self, merges: list[tuple[int, int, int]]) -> int:
        size = {i: len(b) for i, b in self.bytes.items()}
        right: dict[int, list[int]] = {}  # right children, for the symbols at a token's right edge
        reach: dict[int, int] = {}  # bytes beyond a token that its forming can depend on
        takes: dict[int, int] = {}  # bytes to the right that a rule starting with this token can depend on
        for a, b, made in merges:
            edge, todo = set(), [b]
            while todo:
                t = todo.pop()
                if t not in edge:
                    edge.add(t)
                    todo += right.get(t, ())
            blocked = max(takes.get(t, 0) for t in edge)
            beyond = max(blocked, reach.get(b, 0))
            reach[made] = max(reach.get(made, 0), beyond, reach.get(a, 0) - size[b])
            takes[a] = max(takes.get(a, 0), size[b] + beyond)
            right.setdefault(made, []).append(b)
        return max(takes.values(), default=0)

    def merge(self, data: bytes) -> list[int]:
        """Apply the merges to ``data``, lowest rank first, leftmost first."""
        ids = [self.byte_id[b] for b in data]
        if len(ids) > 64:
            return self._merge_heap(ids)
        get, none = self.order.get, len(self.made)
        ranks = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i] = made = self.made[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | made, none)
            if i < len(ranks):
                ranks[i] = get(made << 32 | ids[i + 1], none)
        return ids

    def _merge_heap(self, ids: list[int]) -> list[int]:
        rank, n = self.rank, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, made, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = made, False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n and (r := rank.get((ids[left], ids[after[left]]))):
                    heapq.heappush(heap, (*r, left, ids[left], ids[after[left]]))
        return [t for t, live in zip(ids, alive, strict=True) if live]


class ByteRun:
    """Encodes one pre-token that comes in pieces, keeping a window of constant size."""

    def __init__(self, merges: MergeTable):
        self.merges, self.held = merges, b""
        self.window = 2 * merges.lookahead + 1024

    def feed(self, data: bytes, last: bool = False) -> list[int]:
        out: list[int] = []
        self.held += data
        at = 0
        while len(self.held) - at > self.window:
            end = at + self.window
            stable = end - self.merges.lookahead
            for t in self.merges.merge(self.held[at:end]):
                if at + len(self.merges.bytes[t]) > stable:
                    break
                out.append(t)
                at += len(self.merges.bytes[t])
        self.held = self.held[at:]
        if last:
            out += self.merges.merge(self.held)
            self.held = b""
        return out


class StreamingEncoder:
    """``feed`` text in pieces of any size, then ``finish``; each returns the ids that became stable.

    What it holds is bounded: at most ``limit`` characters and one byte window.
    """

    CLASSES = (regex.compile(r"\p{L}+"), regex.compile(r"\p{N}+"), regex.compile(r"\s+"), regex.compile(r"[^\s\p{L}\p{N}]+"))
    BOUNDARY = regex.compile(r"(?r)(?<=\S) (?=\S)")

    def __init__(self, merges: MergeTable, limit: int = SLICE, memo: dict | None = None):
        self.merges, self.limit = merges, limit
        self.tail, self.run, self.kind = "", None, None
        self.memo = {} if memo is None else memo
        self.words: dict[str, tuple[int, ...]] = {}
        self.pattern = regex.compile(PATTERN)
        self.hold = max([2, *map(len, merges.specials)])
        self.special = regex.compile("(" + "|".join(map(regex.escape, merges.specials)) + ")") if merges.specials else None

    def _pretoken(self, word: str) -> tuple[int, ...]:
        found = self.words.get(word)
        if found is None:
            data = word.encode()
            if len(data) > 64:
                return tuple(ByteRun(self.merges).feed(data, last=True))
            found = tuple(self.merges.merge(data))
            if len(self.words) >= MEMO:
                self.words.clear()
            self.words[word] = found
        return found

    def _plain(self, text: str) -> tuple[int, ...]:
        return tuple(t for w in self.pattern.findall(text) for t in self._pretoken(w))

    def _piece(self, text: str) -> tuple[int, ...]:
        if not any(t in text for t in self.merges.specials):
            return self._plain(text)
        out: tuple[int, ...] = ()
        for part in self.special.split(text):
            out += (self.merges.specials[part],) if part in self.merges.specials else self._plain(part)
        return out

    def _safe(self, text: str) -> list[int]:
        """Encode text that ends at a pre-token's end.

        A space starts a pre-token unless more white space surrounds it: where a piece
        between spaces is empty or starts with white space, it is joined to what is before it.
        The memo holds the ids of a piece and the space before it.
        """
        first, *pieces = text.split(" ")
        found = list(map(self.memo.get, pieces))
        if None in found:
            missed = [k for k, ids in enumerate(found) if ids is None]
            if any(not pieces[k] or pieces[k][0].isspace() for k in missed):
                return self._joined(first, pieces)
            for k in missed:
                found[k] = self._spaced(pieces[k])
        return [*self._piece(first), *itertools.chain.from_iterable(found)]

    def _spaced(self, piece: str) -> tuple[int, ...]:
        found = self.memo.get(piece)
        if found is None:
            found = self._piece(" " + piece)
            if len(piece) <= 64:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[piece] = found
        return found

    def _joined(self, first: str, pieces: list[str]) -> list[int]:
        out: list[int] = []
        part = [first]
        for p in pieces:
            if p and not p[0].isspace() and part[-1]:
                out += self._piece(" ".join(part))
                part = ["", p]
            else:
                part.append(p)
        return [*out, *self._piece(" ".join(part))]

    def feed(self, chunk: str) -> list[int]:
        out: list[int] = []
        self.tail += chunk
        if self.run is not None:
            out += self._continue_run(last=False)
        while self.run is None:
            before = len(self.tail)
            m = self.BOUNDARY.search(self.tail)
            if m:
                out += self._safe(self.tail[: m.start()])
                self.tail = self.tail[m.start() :]
            elif before > self.limit:
                out += self._drain()
            if len(self.tail) == before:
                break
        return out

    def finish(self) -> list[int]:
        out: list[int] = []
        while self.run is not None:
            out += self._continue_run(last=True)
        out += self._safe(self.tail) if self.tail else []
        self.tail = ""
        return out

    def _drain(self) -> list[int]:
        """No lone space in a long stretch: emit pre-tokens that can no longer change, or enter a run."""
        out: list[int] = []
        if self.special is not None:
            end = max((s.end() for s in self.special.finditer(self.tail)), default=0)
            if end:
                out += self._piece(self.tail[:end])
                self.tail = self.tail[end:]
                return out
        until = len(self.tail) - self.hold
        at, cut = 0, None
        for m in self.pattern.finditer(self.tail):
            if m.end() >= until:
                cut = m
                break
            out += self._pretoken(m.group())
            at = m.end()
        self.tail = self.tail[at:]
        if cut is not None and len(cut.group()) > self.limit // 2:
            head = 1 if self.tail[0] == " " and not self.tail[1:2].isspace() else 0
            self.kind = next(k for k in self.CLASSES if k.match(self.tail, head))
            self.run = ByteRun(self.merges)
            out += self.run.feed(self.tail[:head].encode())
            self.tail = self.tail[head:]
            out += self._continue_run(last=False)
        return out

    def _continue_run(self, last: bool) -> list[int]:
        stop = len(self.tail)
        if self.special is not None and (s := self.special.search(self.tail)):
            stop = s.start()
        m = self.kind.match(self.tail, 0, stop)
        end = m.end() if m else 0
        ended = last or end < len(self.tail) - self.hold or stop < len(self.tail)
        if not ended:
            end = min(end, max(0, len(self.tail) - self.hold))
        elif end == len(self.tail) and last:
            pass
        if self.kind is self.CLASSES[2] and ended and end < len(self.tail) and end < stop and end > 0:
            end -= 1  # the last white space before other text belongs to what follows
        out = self.run.feed(self.tail[:end].encode(), last=ended)
        self.tail = self.tail[end:]
        if ended:
            self.run = self.kind = None
        return out


class StreamingDecoder:
    """Turns ids into text as they come: bytes enter a UTF-8 state machine that keeps an unfinished character."""

    def __init__(self, merges: MergeTable):
        self.bytes = merges.bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int], last: bool = False) -> str:
        return self.state.decode(b"".join(map(self.bytes.__getitem__, ids)), last)


@functools.lru_cache(maxsize=2)
def _loaded(path: str) -> tuple[MergeTable, dict, list[str]]:
    merges = MergeTable.load(path)
    names = [str(i) for i in range(max(merges.bytes) + 1)]
    return merges, StreamingEncoder(merges), names


def encode_stream(text: str, encoder: StreamingEncoder):
    """Yields lists of ids, slice by slice."""
    for at in range(0, len(text), SLICE):
        yield encoder.feed(text[at : at + SLICE])
    yield encoder.finish()


def digest(path: str, text: str) -> tuple[int, str, str]:
    """Count and digest of a text's ids, and digest of the text decoded from them."""
    merges, encoder, names = _loaded(path)
    decoder, n = StreamingDecoder(merges), 0
    ids_sha, text_sha = hashlib.sha256(), hashlib.sha256()
    for ids in encode_stream(text, encoder):
        if ids:
            ids_sha.update(("," * bool(n) + ",".join(map(names.__getitem__, ids))).encode())
            text_sha.update(decoder.feed(ids).encode())
            n += len(ids)
    text_sha.update(decoder.feed([], last=True).encode())
    return n, ids_sha.hexdigest(), text_sha.hexdigest()
