"""Suffix-array dedup of byte strings that occur in several documents.

A byte is removed if a ``length``-byte string that covers it also starts in a document with a smaller id. The strings
are compared in suffix arrays built by the difference-cover algorithm: suffixes at positions 1 and 2 modulo 3 are
sorted by their triples, the triples' names are sorted by recursion, the remaining suffixes are merged in, and adjacent
prefixes of ``length`` bytes are compared. The recursion ends when a name stands for ``length`` bytes or more: nothing
beyond them is ever compared.

How it is distributed. Equal strings have equal fingerprints: of the hashes of all ``gram``-byte windows in a string the
smallest one, leftmost in a tie. (1) Each batch of texts sends the set of its strings' fingerprints to shards, which tell
the batch those that other documents have too, and those that very many batches have. Strings with any other fingerprint
occur in one document only and are done. (2) The others, as segments of neighbouring strings with one fingerprint, equal
segments of a batch only once with their smallest document, go to shards by fingerprint; strings of a fingerprint with
very many different segments go to shards by their own hash, so that the edges of one passage in a third of all
documents fill no task. Each shard
sorts its distinct segments in blocks of bounded size and returns, for each string, the smallest document that has it.
(3) Each batch removes what a smaller document has. Exact copies of a text are treated by step 2 like any other.

Disk. Neighbouring segments overlap, and cut up for many shards they hardly compress, so all segments together are several
times the texts. What is written between the steps is where a batch's segments lie; their bytes are cut from the batches
when they are sent, to the shards of one round after the other, and go as soon as a round's answers are written.

Nulls and edges: a null text is empty; a document with a null id removes nothing from others and loses nothing; rows
with equal ids are not smaller than each other; texts under ``length`` bytes lose nothing; an empty table gives no
rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches as B
from .common import BYTE64, U, among, chunks, distinct, mix, partitions, powers, settle

NO_DOC = np.int64(2**63 - 1)


@dataclass(frozen=True)
class Settings:
    length: int = 50
    #: Bytes whose hash is a fingerprint.
    gram: int = 16
    #: Requests in which a fingerprint is frequent, and segments of the requests, distinct within each, that make it a
    #: very frequent one. What many documents have alike are few distinct segments, and needs no splitting.
    often: int = 256
    heavy: int = 1 << 14
    #: Input bytes for each shard, about.
    shard: int = 12 << 20
    #: Segments are sent in this many rounds, or fewer where a round would have less than ``together`` shards.
    rounds: int = 8
    together: int = 16


# ---------------------------------------------------------------- suffix arrays


def names(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and the dense rank of each, from 1."""
    order = np.argsort(keys)
    s = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(np.concatenate([[1], (s[1:] != s[:-1]).astype(np.int64)])) if len(s) else s
    return order, rank


def triples(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Dense ranks of the three symbols at each position of ``at``; ``s`` ends in three zeros."""
    top = int(s.max()) + 1
    if top**3 < 1 << 62:
        return names((s[at] * top + s[at + 1]) * top + s[at + 2])[1]
    _, pair = names(s[at] * top + s[at + 1])
    return names(pair * top + s[at + 2])[1]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` (small positive integers) in order of the ``depth`` or more symbols that follow them."""
    n = len(text)
    s = np.concatenate([text.astype(np.int64), np.zeros(3, np.int64)])
    if n < 3 or depth <= 3:
        return np.argsort(triples(s, np.arange(n))) if n else np.zeros(0, np.int64)
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # for n = 3k+1 the empty suffix at n ends the first part
    sample = np.concatenate([one, two])
    name = triples(s, sample)
    if int(name.max()) < len(name):  # names are not unique: sort the suffixes of the sequence of names
        order = suffix_array(name, -(-depth // 3))
        name = ranks(name, order, -(-depth // 3))
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = name
    by_rank = sample[np.argsort(name)]
    by_rank = by_rank[by_rank < n]
    zero = np.arange(0, n, 3)
    top, wide = int(rank.max()) + 1, int(s.max()) + 1
    # where each of the remaining suffixes goes among the sampled ones: against positions 1 mod 3 by one symbol and the
    # rank that follows, against positions 2 mod 3 by two symbols and the rank that follows
    a, b = by_rank[by_rank % 3 == 1], by_rank[by_rank % 3 == 2]
    both = np.concatenate([b, zero])
    head = s[both] * wide + s[both + 1]
    if wide * wide * top >= 1 << 62:
        head = names(head)[1]
    head = head * top + rank[both + 2]
    zero = zero[np.argsort(head[len(b) :])]
    # equal ranks agree in depth symbols but not beyond, so the keys are sorted once more
    before = np.searchsorted(np.sort(s[a] * top + rank[a + 1]), s[zero] * top + rank[zero + 1])
    before += np.searchsorted(np.sort(head[: len(b)]), np.sort(head[len(b) :]))
    out = np.empty(n, np.int64)
    mine = before + np.arange(len(zero))
    out[mine] = zero
    rest = np.ones(n, bool)
    rest[mine] = False
    out[rest] = by_rank
    return out


def ranks(s: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Dense ranks of the suffixes in ``order``; those that agree in ``depth`` symbols share one."""
    padded = np.concatenate([s, np.zeros(depth, np.int64)])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in range(depth):
        v = padded[order + k]
        new[1:] |= v[1:] != v[:-1]
    out = np.empty(len(s), np.int64)
    out[order] = np.cumsum(new)
    return out


def smallest_documents(segments: list[bytes], docs: np.ndarray, length: int) -> list[np.ndarray]:
    """For each string of ``length`` bytes of each segment the smallest document of all segments that have the string."""
    text = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.array([len(x) for x in segments])
    start = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(segments)), sizes)
    at = np.arange(len(text))
    whole = at + length <= start[owner + 1]
    order = suffix_array(text.astype(np.int64) + 1, length)
    order = order[whole[order]]
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    word = np.zeros(len(text), U)
    for k in range(8):
        word |= padded[k : k + len(text)].astype(U) << U(8 * k)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in (*range(0, length - 8, 8), length - 8):  # adjacent prefixes, eight bytes at a time
        w = word[order + k]
        new[1:] |= w[1:] != w[:-1]
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(docs[owner[order]], first) if len(first) else np.zeros(0, np.int64)
    best = np.full(len(text), NO_DOC)
    best[order] = np.repeat(least, np.diff([*first, len(order)]))
    return [best[a : b - length + 1] for a, b in zip(start[:-1], start[1:], strict=True)]


# ---------------------------------------------------------------- fingerprints

#: Fingerprints have 48 bits. A collision costs a needless comparison, no more.
MASK = U((1 << 48) - 1)


def fingerprints(buf: np.ndarray, offsets: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring strings with one fingerprint: text, start of the first string, number of strings, fingerprint,
    and a hash of the run's bytes."""
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, U)], [np.zeros(0, U)]]
    width = s.length - s.gram + 1
    for i, j in chunks(offsets, 1 << 18):
        lo, hi = int(offsets[i]), int(offsets[j])
        n = hi - lo
        if n < s.length:
            continue
        up, down = powers(n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, U)
            np.cumsum(BYTE64[buf[lo:hi]] * up[:n], out=sums[1:])
            least = mix((sums[s.gram :] - sums[: -s.gram]) * down[: n - s.gram + 1]) & MASK
        span = 1
        while span < width:  # the minimum over 1, 2, 4 ... neighbours
            step = min(span, width - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        at = offsets[i : j + 1] - lo
        whole = np.ones(n, bool)
        for a, b in zip(at[:-1], at[1:], strict=True):
            whole[max(a, b - s.length + 1) : b] = False
        whole = whole[: len(least)]
        new = whole.copy()
        new[1:] &= ~whole[:-1] | (least[1:] != least[:-1])
        new[at[at < len(new)]] |= whole[at[at < len(new)]]
        start = np.flatnonzero(new)
        valid = np.concatenate([[0], np.cumsum(whole)])
        count = np.diff(valid[np.append(start, len(whole))])
        with np.errstate(over="ignore"):
            bytes_ = mix((sums[start + count + s.length - 1] - sums[start]) * down[start])
        for column, value in zip(out, (i + np.searchsorted(at, start, "right") - 1, start + lo, count, least[start], bytes_), strict=True):
            column.append(value)
    return tuple(np.concatenate(x) for x in out)


def cut(runs: tuple[np.ndarray, ...], most: int) -> tuple[np.ndarray, ...]:
    """Runs of at most ``most`` strings; periodic texts would give endless ones."""
    text, start, count, print_ = runs
    pieces = -(-count // most)
    k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    left = np.repeat(count, pieces) - k * most
    return np.repeat(text, pieces), np.repeat(start, pieces) + k * most, np.minimum(left, most), np.repeat(print_, pieces)


# ---------------------------------------------------------------- the three steps

#: Of each fingerprint of a batch, in how many distinct segments the batch has it.
REQUEST = "shard long, batch long, prints binary, weights binary"
#: Of a batch's fingerprints in a shard, in the order of the request, a bit each: whether other batches have it, and very many.
ANSWER = "batch long, shard long, common binary, often binary"
#: In rows of round -1 the runs of a batch, in the others where the segments of a round lie, in order of shard and fingerprint.
FOUND = "batch long, round long, shards binary, starts binary, counts binary, prints binary, runs binary"
SEGMENTS = "batch long, shard long, sizes binary, docs binary, prints binary, bytes binary"
LEAST = "batch long, shard long, least binary"


def columns(cells: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows of a schema of longs and binaries."""
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([c[k] for c in cells], pa.int64() if f[1] == "long" else pa.binary()) for k, f in enumerate(fields)], [f[0] for f in fields])


def requests(prints: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """A batch's distinct fingerprints for each shard that has any, in ascending order."""
    prints = distinct(prints)
    shard = (prints % U(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    edge = np.flatnonzero(np.diff(shard[order], prepend=-1))
    yield from zip(shard[order][edge].tolist(), np.split(prints[order], edge[1:]), strict=False)


def request(shards: int, s: Settings):
    """For each batch and shard the fingerprints of the batch."""

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.each(arrived):
            _, buf, offsets = B.opened(row)
            *_, prints, content = fingerprints(buf, offsets, s)
            every, order = distinct(prints), np.argsort(content)
            n = np.bincount(np.searchsorted(every, prints[order[np.append(True, content[order[1:]] != content[order[:-1]])[: len(order)]]]), minlength=len(every))
            parts = requests(every, shards)
            yield columns([(k, row["batch"], p.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), B.pack(n[np.searchsorted(every, p)].astype(np.uint32))) for k, p in parts], REQUEST)

    return run


def wide(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def answer(s: Settings):
    """Which of a shard's fingerprints several batches have, to each of these batches."""

    def run(t: pa.Table) -> pa.Table:
        batch, shard = t.column("batch").to_numpy(), t.column("shard").to_numpy()
        parts = [wide(x.as_py()) for x in t.column("prints")]
        _, inverse, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        weights = np.concatenate([B.unpack(x.as_py(), np.uint32) for x in t.column("weights")]) if "weights" in t.column_names else np.ones(len(inverse))
        often = (n >= s.often) & (np.bincount(inverse, weights) >= s.heavy)
        n, often, at, out = n[inverse], often[inverse], 0, []
        for k, p in enumerate(parts):
            own = slice(at, at + len(p))
            at += len(p)
            if (n[own] > 1).any():
                out.append((int(batch[k]), int(shard[k]), np.packbits(n[own] > 1).tobytes(), np.packbits(often[own]).tobytes()))
        return pa.Table.from_batches([columns(out, ANSWER)])

    return run


def rounds(shards: int, s: Settings) -> int:
    return max(1, min(s.rounds, shards // s.together))


def segments(shards: int, s: Settings):
    """For each batch and round where the distinct segments are whose strings other documents may have, and where the batch has them."""

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.each(arrived):
            ids, buf, offsets = B.opened(row)
            doc = np.array([NO_DOC if x is None else x for x in ids], np.int64)
            runs = fingerprints(buf, offsets, s)[:4]
            asked = dict(requests(runs[3], shards))
            runs = tuple(x[doc[runs[0]] != NO_DOC] for x in runs)
            text, start, count, prints = runs
            first = np.unique(prints, return_index=True, return_inverse=True)
            several = np.zeros(len(first[0]), bool)  # in two documents of this batch
            several[first[2][doc[text] != doc[text][first[1]][first[2]]]] = True
            common, often = (
                np.sort(np.concatenate([np.zeros(0, U), *(asked[x["shard"]][np.unpackbits(np.frombuffer(x[c], np.uint8), count=len(asked[x["shard"]])).astype(bool)] for x in row["answers"] or [])]))
                for c in ("common", "often")
            )
            wanted = several | among(first[0], common)
            hot = among(first[0], often)[first[2]]
            wanted = wanted[first[2]]
            parts = [cut(tuple(x[wanted & ~hot] for x in runs), 64), cut(tuple(x[wanted & hot] for x in runs), 1)]
            whole = buf.tobytes()
            known: dict[bytes, int] = {}
            least, key, begin, place = [], [], [], []
            for p, single in zip(parts, (False, True), strict=True):
                for d, a, n, f in zip(doc[p[0]].tolist(), p[1].tolist(), p[2].tolist(), p[3].tolist(), strict=True):
                    b = whole[a : a + n - 1 + s.length]
                    k = known.get(b)
                    if k is None:
                        k = known[b] = len(known)
                        least.append(d)
                        key.append(hash_bytes(b) if single else f)
                        begin.append(a)
                    elif d < least[k]:
                        least[k], begin[k] = d, a
                    place.append(k)
            if not known:
                continue
            key, begin = np.array(key, U), np.array(begin, np.int32)
            strings = (np.array([len(b) for b in known]) - s.length + 1).astype(np.uint16)
            del known
            shard = (key % U(shards)).astype(np.int64)
            order = np.lexsort((key, shard))
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            start, count = (np.concatenate([a, b]) for a, b in zip(parts[0][1:3], parts[1][1:3], strict=True))
            out = [(row["batch"], -1, None, None, None, None, B.pack(np.stack([np.diff(start, prepend=0), count, back[np.array(place)]]).astype(np.int32)))]
            turn = shard[order] * rounds(shards, s) // shards
            edge = np.flatnonzero(np.diff(turn, prepend=-1))
            for a, b in zip(edge, [*edge[1:], len(order)], strict=True):
                k = order[a:b]
                prints = (key[k] // U(shards)).astype(np.uint32)  # ascending in a shard, so the steps are small
                out.append((row["batch"], int(turn[a]), B.pack(shard[k].astype(np.int32)), B.pack(begin[k]), B.pack(strings[k]), B.pack(np.diff(prints, prepend=np.uint32(0))), None))
            yield columns(out, FOUND)

    return run


def send(s: Settings):
    """For each batch and shard of a round the segments themselves."""

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.each(arrived):
            ids, buf, offsets = B.opened(row)
            shard, start, count, prints = (B.unpack(row[c], d) for c, d in (("shards", np.int32), ("starts", np.int32), ("counts", np.uint16), ("prints", np.uint32)))
            prints = np.cumsum(prints, dtype=np.uint32)
            docs = np.array([NO_DOC if x is None else x for x in ids], np.int64)[np.searchsorted(offsets, start, "right") - 1]
            size = count.astype(np.uint32) + np.uint32(s.length - 1)
            whole, out = buf.tobytes(), []
            edge = np.flatnonzero(np.diff(shard, prepend=-1))
            for a, b in zip(edge, [*edge[1:], len(shard)], strict=True):
                data = b"".join([whole[x : x + n] for x, n in zip(start[a:b].tolist(), size[a:b].tolist(), strict=True)])
                out.append((row["batch"], int(shard[a]), B.pack(size[a:b]), B.pack(docs[a:b]), B.pack(prints[a:b]), zstd(data)))
            yield columns(out, SEGMENTS)

    return run


def repeats(x: np.ndarray) -> bytes:
    """Run lengths and values: neighbouring strings mostly have the same smallest document."""
    edge = np.append(np.flatnonzero(np.append(True, x[1:] != x[:-1])), len(x))
    return B.pack(np.concatenate([np.diff(edge), x[edge[:-1]]]))


def repeated(b: bytes) -> np.ndarray:
    n, x = B.unpack(b, np.int64).reshape(2, -1)
    return np.repeat(x, n)


def hash_bytes(b: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b, digest_size=6).digest(), "little")


def zstd(b: bytes) -> bytes:
    return B.pack(np.frombuffer(b, np.uint8))


def alike(segments: list[bytes], length: int) -> np.ndarray:
    """Which segments have a string whose hash another string has too. The strings of the rest are in one place only."""
    text = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.array([len(x) for x in segments])
    n, end = len(text), np.cumsum(sizes)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE64[text] * up[:n], out=sums[1:])
        key = mix((sums[length:] - sums[:-length]) * down[: n - length + 1])
    owner = np.repeat(np.arange(len(segments)), sizes)[: len(key)]
    whole = np.flatnonzero(np.arange(len(key)) + length <= end[owner])
    key, owner = key[whole], owner[whole]
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    out = np.zeros(len(segments), bool)
    out[owner[order[1:][same]]] = out[owner[order[:-1][same]]] = True
    return out


def blocks(order: np.ndarray, group: np.ndarray, sizes: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """``order`` in pieces of about ``most`` bytes; the neighbours of one group stay together."""
    size = np.cumsum(np.append(0, sizes[order]))
    edge = np.append(np.flatnonzero(np.diff(group[order], prepend=-1)), len(order))
    a = 0
    while a < len(order):
        later = edge[np.searchsorted(edge, a, "right") :]
        b = int(later[min(np.searchsorted(size[later], size[a] + most), len(later) - 1)])
        yield order[a:b]
        a = b


def compare(s: Settings, block: int = 1 << 19):
    """In a shard, the smallest document of each string of each batch's segments."""

    def run(t: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        least, prints, rows = [], [], []
        for k in range(t.num_rows):
            sizes, docs, keys = (B.unpack(t.column(c)[k].as_py(), d) for c, d in (("sizes", np.uint32), ("docs", np.int64), ("prints", np.uint32)))
            data = B.unpack(t.column("bytes")[k].as_py(), np.uint8).tobytes()
            own, at = np.empty(len(sizes), np.int64), 0
            for j, (n, d, f) in enumerate(zip(sizes.tolist(), docs.tolist(), keys.tolist(), strict=True)):
                b = data[at : at + n]
                at += n
                i = known.get(b)
                if i is None:
                    i = known[b] = len(known)
                    least.append(d)
                    prints.append(f)
                elif d < least[i]:
                    least[i] = d
                own[j] = i
            rows.append(own)
        every, least, prints = list(known), np.array(least, np.int64), np.array(prints)
        del known
        _, inverse, n = np.unique(prints, return_inverse=True, return_counts=True)
        rivals = n[inverse] > 1  # else no other segment can have one of the segment's strings
        extent = np.array([len(b) for b in every])
        strings = extent - s.length + 1
        begin = np.cumsum(strings) - strings
        found = np.repeat(least, strings)
        order = np.flatnonzero(rivals)
        order = order[np.argsort(prints[order])]
        order = np.concatenate([order[:0], *(k[alike([every[i] for i in k.tolist()], s.length)] for k in blocks(order, inverse, extent, block))])
        for k in blocks(order, inverse, extent, block):
            for i, x in zip(k.tolist(), smallest_documents([every[i] for i in k.tolist()], least[k], s.length), strict=True):
                found[begin[i] : begin[i] + len(x)] = x
        out = []
        for own in rows:
            n = strings[own]
            out.append(repeats(found[np.repeat(begin[own] - np.cumsum(n) + n, n) + np.arange(n.sum())]))
        return pa.table([t.column("batch"), t.column("shard"), pa.array(out, pa.binary())], ["batch", "shard", "least"])

    return run


def remove(s: Settings, texts_too: bool, rest: pa.Schema | None):
    """What stays of each text of each batch."""

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.each(arrived):
            ids, buf, offsets = B.opened(row)
            mark = np.zeros(len(buf) + 1, np.int32)
            if row["runs"] is not None:
                start, count, segment = B.unpack(row["runs"], np.int32).astype(np.int64).reshape(3, -1)
                start = np.cumsum(start)
                text = np.searchsorted(offsets, start, "right") - 1
                size = np.zeros(segment.max() + 1, np.int64)
                size[segment] = count
                least = np.concatenate([repeated(x["least"]) for x in row["parts"]])
                begin = (np.cumsum(size) - size)[segment]
                k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                own = np.array([-(2**63) if x is None else x for x in ids], np.int64)
                gone = least[np.repeat(begin, count) + k] < np.repeat(own[text], count)
                at = (np.repeat(start, count) + k)[gone]
                np.add.at(mark, at, 1)
                np.add.at(mark, at + s.length, -1)
            removed = np.cumsum(mark[:-1]) > 0
            edges = removed.copy()
            edges[1:] &= ~removed[:-1]
            at = offsets[:-1][offsets[:-1] < len(buf)]
            edges[at] = removed[at]
            gone, spans = (np.diff(np.concatenate([[0], np.cumsum(x)])[offsets]) for x in (removed, edges))
            stays, sha = [], []
            for i in range(len(ids)):
                part = buf[offsets[i] : offsets[i + 1]]
                b = part.tobytes() if not gone[i] else part[~removed[offsets[i] : offsets[i + 1]]].tobytes()
                if texts_too:
                    stays.append(b.decode("utf-8", "ignore"))  # halves of a character whose other half went go too
                sha.append(hashlib.sha256(b).hexdigest())
            columns = [pa.array(ids, pa.int64()), pa.array(np.diff(offsets)), pa.array(gone.astype(np.int64)), pa.array(spans.astype(np.int64)), pa.array(sha)]
            labels = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if texts_too:
                columns.append(pa.array(stays, pa.string()))
                labels.append("kept_text")
            if rest is not None:
                other = B.rest(row)
                columns += other.columns
                labels += other.schema.names
            yield pa.RecordBatch.from_arrays(columns, labels)

    return run


def _candidates(corpus: DataFrame, shards: int, parts: int, s: Settings) -> DataFrame:
    """Where each batch has segments whose strings other documents may have, for each round."""
    asked = corpus.mapInArrow(request(shards, s), REQUEST).repartition(parts, "shard")
    answers = asked.groupBy("shard").applyInArrow(answer(s), ANSWER).groupBy("batch").agg(F.collect_list(F.struct("shard", "common", "often")).alias("answers"))
    return corpus.select("batch", "ids", "lengths", "texts").join(answers.hint("merge"), "batch", "left").mapInArrow(segments(shards, s), FOUND)


def dedup(docs: DataFrame, s: Settings = Settings(), texts_too: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Of each row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, with ``texts_too`` the
    kept_text, and the columns ``keep``, which must have other names than these."""
    corpus = B.batched(docs, keep)
    shards = B.shards(corpus, 2 * s.shard)
    parts = partitions(docs)
    tasks = max(parts, 4 * shards // rounds(shards, s))  # few of a round's shards then share a task
    found = settle(_candidates(corpus, shards, parts, s))
    answers = []
    for k in range(rounds(shards, s)):
        own = found.where(F.col("round") == k).drop("round", "runs")
        sent = corpus.select("batch", "ids", "lengths", "texts").join(own.hint("merge"), "batch").mapInArrow(send(s), SEGMENTS)
        answers.append(settle(sent.repartition(tasks, "shard").groupBy("shard").applyInArrow(compare(s), LEAST)))
    least = reduce(DataFrame.union, answers).groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("shard", "least"))).alias("parts"))
    per_batch = found.where(F.col("round") == -1).select("batch", "runs").join(least.hint("merge"), "batch")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * texts_too
    rest = None
    if keep:
        rest = True
        schema += "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return corpus.join(per_batch.hint("merge"), "batch", "left").mapInArrow(remove(s, texts_too, rest), schema)
