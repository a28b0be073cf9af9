"""Byte-level BPE by dynamic programming over prefixes.

For each byte prefix of a piece (a match of the split pattern) there is exactly one token that can end its encoding: the
encoding of a prefix is that of a shorter prefix and one more token, and a sequence of tokens is an encoding if and only
if every two neighbours are what merging their joint bytes gives. ``Prefixes`` keeps that last token for each prefix. So
bytes can be appended exactly, at the cost of the new bytes, and an edit is re-encoded from its place until the tokens
agree with the old ones for the length of the longest token. ``Encoding`` does the same for whole texts, piece by piece.

Encoding a table is one pass without a shuffle. The ranks are broadcast (a vocabulary, 50 thousand entries); each worker
remembers the encodings of the pieces it met, in two generations of bounded size.

Nulls and edges: a null text is empty and has no tokens; repeated rows, null ids and further columns pass through; an
empty table gives no rows; a piece of any length takes time in proportion to it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Pieces, and pairs of tokens, that one generation of a task's memory holds.
REMEMBERED = 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Remembered(dict):
    """A dict that starts anew when full; the generation before is still looked up once."""

    def __init__(self, make, size: int = REMEMBERED):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        #: Every token's id, and -1 for what is only a token's beginning.
        self.trie = {k[:n]: -1 for k in ranks for n in range(1, len(k))} | ranks
        self.fits = Remembered(self._fits)

    def merge(self, data: bytes) -> list[int]:
        """The merges themselves, lowest rank first, leftmost in a tie; only for the few bytes of two tokens."""
        get, none = self.ranks.get, 1 << 62
        cuts = list(range(len(data) + 1))
        ranks = [get(data[k : k + 2], none) for k in range(len(data) - 1)]  # of the part from each cut to the next but one
        while ranks:
            best = min(ranks)
            if best == none:
                break
            k = ranks.index(best)
            del cuts[k + 1], ranks[k]
            if k < len(ranks):
                ranks[k] = get(data[cuts[k] : cuts[k + 2]], none)
            if k:
                ranks[k - 1] = get(data[cuts[k - 1] : cuts[k + 1]], none)
        return [get(data[a:b]) for a, b in zip(cuts, cuts[1:])]

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether the two tokens are what their joint bytes encode to."""
        return self.merge(self.bytes[pair[0]] + self.bytes[pair[1]]) == [*pair]

    def last_tokens(self, data: bytes) -> list[int]:
        """The table of ``Prefixes`` for a whole piece: from each prefix on, the tokens that may follow it."""
        n, follow, fits = len(data), self.trie.get, self.fits
        last = [-1] * (n + 1)
        for j in range(n):
            p = last[j]
            for e in range(j + 1, n + 1):
                t = follow(data[j:e])
                if t is None:
                    break
                if t >= 0 and last[e] < 0 and (not j or fits[p, t]):
                    last[e] = t
        return last

    def encode(self, data: bytes) -> list[int]:
        """A piece's tokens. A piece that is a token is that token."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.walk(data, self.last_tokens(data))

    def walk(self, data: bytes, last: list[int]) -> list[int]:
        out, i, size = [], len(data), self.bytes
        while i:
            out.append(last[i])
            i -= len(size[last[i]])
        return out[::-1]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class Prefixes:
    """A piece's bytes, and for each non-empty prefix the last token of its encoding."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, data, vocabulary.last_tokens(data)

    def _at(self, i: int) -> int:
        ranks, fits, data, last = self.v.ranks, self.v.fits, self.data, self.last
        for j in range(max(0, i - self.v.longest), i):
            t = ranks.get(data[j:i])
            if t is not None and (j == 0 or fits[last[j], t]):
                return t
        raise ValueError("no token ends this prefix")

    def append(self, data: bytes) -> None:
        done = len(self.data)
        self.data += data
        for i in range(done + 1, len(self.data) + 1):
            self.last.append(self._at(i))

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replaces the bytes start..end. Returns how many prefixes were worked out anew."""
        old, size, shift = self.last, len(self.data), len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[: start + 1]
        same = 0
        for i in range(start + 1, len(self.data) + 1):
            t = self._at(i)
            self.last.append(t)
            was = i - shift
            same = same + 1 if was > end and was <= size and old[was] == t else 0
            if same >= self.v.longest:  # every later prefix sees the same tokens before it
                self.last += old[was + 1 :]
                return i - start
        return len(self.data) - start

    def tokens(self) -> list[int]:
        whole = self.v.ranks.get(self.data)
        return [whole] if whole is not None else self.v.walk(self.data, self.last)


class Encoding:
    """A text's pieces and their tokens, with exact appends and edits that re-encode only what is near."""

    #: A piece's end is decided by at most so many characters after it.
    AHEAD = 4

    def __init__(self, vocabulary: Vocabulary, pattern: str, text: str = ""):
        self.v, self.split = vocabulary, regex.compile(pattern)
        self.text = text
        self.pieces = self.split.findall(text)
        self.ids = [self._piece(p) for p in self.pieces]

    def _piece(self, piece: str) -> list[int]:
        return self.v.encode(piece.encode())

    def append(self, text: str) -> None:
        self.edit(len(self.text), len(self.text), text)

    def edit(self, start: int, end: int, new: str) -> int:
        """Replaces the characters start..end. Returns how many pieces were encoded anew."""
        shift = len(new) - (end - start)
        text = self.text[:start] + new + self.text[end:]
        keep, at = 0, 0
        while keep < len(self.pieces) and at + len(self.pieces[keep]) + self.AHEAD <= start:
            at += len(self.pieces[keep])
            keep += 1
        bounds, k = {}, at
        for n, p in enumerate(self.pieces[keep:], keep):
            if k >= end:
                bounds[k + shift] = n
            k += len(p)
        fresh, tail = [], len(self.pieces)
        for m in self.split.finditer(text, at):
            if m.start() in bounds and m.start() >= start + len(new):  # from a common boundary on the split is the same
                tail = bounds[m.start()]
                break
            fresh.append(m.group())
        self.text = text
        self.ids[keep:tail] = [self._piece(p) for p in fresh]
        self.pieces[keep:tail] = fresh
        return len(fresh)

    def tokens(self) -> list[int]:
        return list(chain.from_iterable(self.ids))


class _Worker:
    """What a Python worker keeps from task to task: the vocabulary, and the pieces it has met."""

    key, vocabulary, known = None, None, None

    @classmethod
    def of(cls, key: str, ranks) -> tuple[Vocabulary, Remembered]:
        if cls.key != key:
            v = Vocabulary(ranks())
            cls.key, cls.vocabulary, cls.known = key, v, Remembered(lambda p: tuple(v.encode(p.encode())))
        return cls.vocabulary, cls.known


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, ids_too: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` and, of its text, n_tokens, ids_sha256, decoded_sha256 and with ``ids_too`` the ids."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    key = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    names = [f"_k{n}" for n in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, known = _Worker.of(key, lambda: shared.value)
        split = regex.compile(pattern).findall
        texts = {k: str(k) for k in v.bytes}
        for b in batches:
            n, sha, back, every = [], [], [], []
            for text in b.column("_text"):
                ids = list(chain.from_iterable(map(known.__getitem__, split(text.as_py() or ""))))
                n.append(len(ids))
                sha.append(hashlib.sha256(",".join(map(texts.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(v.decode(ids)).hexdigest())
                if ids_too:
                    every.append(ids)
            columns = [*(b.column(c) for c in names), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            labels = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids_too:
                columns.append(pa.array(every, pa.list_(pa.int32())))
                labels.append("ids")
            yield pa.RecordBatch.from_arrays(columns, labels)

    source = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(keep, names, strict=True)), F.col("text").cast("string").alias("_text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema.fields) + SCHEMA + ", ids array<int>" * ids_too
    return source.mapInArrow(run, schema)
