"""Quality classifier: supervised subword embeddings.

Every text is the mean of learned vectors, one for each hashed word, pair of neighbouring words and character n-gram
(over UTF-8 bytes, inside a word and its two borders); a softmax layer over that mean gives the score. Both are trained
by stochastic gradient descent in numpy, on the driver, on at most ``Settings.sample`` labelled rows (those with the
smallest hashes of their ids), so that the cost of training does not depend on the corpus; executors turn these rows into features,
and the driver gets at most ``2**bits`` numbers a row, however long its text. Scoring is one pass without
a shuffle: as everything after the lookup is linear, the vectors times the output layer are broadcast as one number per
bucket (``2**bits`` doubles, 2 MB), and a text's score is the mean of its numbers.

Nulls and edges: a null or empty text has no features and gets the score of the bias alone; a null id is of no fold and
is scored as held out of nothing; labels that are null, not 0 or 1, or of ids without a document are not learned; of
repeated labels one is kept. Repeated rows are scored each. Without any label every score is 0.5, and ``learned`` is false,
as it is with labels of one kind only. Columns of documents other than doc_id and text are never read; a kept column named
quality_score gives way to the score.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import pack, unpack
from .common import ODD, SPACE, Words, chunks, mix, texts, tidy


@dataclass(frozen=True)
class Settings:
    #: Labelled rows learned from at most; a fixed bound, whatever the corpus.
    sample: int = 4000
    bits: int = 18
    dim: int = 8
    grams: tuple[int, ...] = (3, 4)
    rate: float = 1.0
    #: Single-row gradient steps in all, at least one pass.
    steps: int = 36_000
    threshold: float = 0.7
    seed: int = 11


def features(buf: np.ndarray, offsets: np.ndarray, i: int, j: int, s: Settings) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Bucket numbers of each kind of feature of the texts i..j in text order, and per kind the j-i+1 offsets by text."""
    lo = offsets[i]
    raw, at = buf[lo : offsets[j]], offsets[i : j + 1] - lo
    shift = np.uint32(32 - s.bits)
    out, first = [], []
    space = SPACE[raw]
    b = np.where(space, np.uint8(32), raw).astype(np.uint32)
    for n in s.grams:
        size = max(0, len(b) - n + 1)
        code, inner = np.full(size, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32), np.ones(size, bool)
        for k in range(n):
            code = (code ^ b[k : k + size]) * np.uint32(0x01000193 + 2 * k * 0x5BD1E995 & 0xFFFFFFFF)
            if 0 < k < n - 1:
                inner &= ~space[k : k + size]
        for cut in at[1:-1]:  # no gram crosses from one text to the next
            inner[max(0, cut - n + 1) : cut] = False
        where = np.flatnonzero(inner)
        code = code[where]
        code ^= code >> np.uint32(15)
        out.append((code * np.uint32(0x85EBCA6B)) >> shift)
        first.append(np.searchsorted(where, at))
    words = Words(buf, offsets, i, j)
    words.bytes = raw
    h = words.hashes()
    out.append((h >> np.uint64(64 - s.bits)).astype(np.uint32))
    first.append(words.first)
    same = words.doc[1:] == words.doc[:-1]
    pair = np.where(h[1:] == h[:-1], np.uint64(12345), h[1:] * ODD[1] + h[:-1] * ODD[2])[same]  # a repeat is one feature for all words
    out.append((mix(pair) >> np.uint64(64 - s.bits)).astype(np.uint32))
    first.append(np.searchsorted(np.flatnonzero(same), words.first[:-1]).tolist() + [len(pair)])
    return out, [np.asarray(f) for f in first]


@dataclass
class Model:
    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray
    settings: Settings
    #: Whether it learned from labels of both kinds.
    learned: bool = False

    def projected(self) -> np.ndarray:
        """For each bucket the difference of the two classes' logits."""
        return (self.vectors.astype(np.float64) @ self.output.astype(np.float64)) @ np.array([-1.0, 1.0])


def counted(column: pa.Array, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct buckets, ascending, and how often each is there."""
    buf, offsets = texts(column)
    for i in range(len(column)):
        f, _ = features(buf, offsets, i, i + 1, s)
        yield np.unique(np.concatenate(f), return_counts=True)


def shares(ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ids.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)


def bags(values: list[str], s: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct buckets and their shares of the text's features."""
    return [shares(*x) for x in counted(pa.array(values, pa.large_string()), s)]


class Packed:
    """Texts' features, compressed until they are looked at: the driver holds them for all passes."""

    def __init__(self, cells: list[tuple[bytes, bytes]]):
        self.cells = cells

    def __len__(self) -> int:
        return len(self.cells)

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        steps, n = self.cells[k]
        return shares(np.cumsum(unpack(steps, np.uint32)), unpack(n, np.uint32))


def train(docs: Sequence[tuple[np.ndarray, np.ndarray]], labels: list[int], s: Settings = Settings()) -> Model:
    """docs: the features of each text, as made by ``bags``."""
    rng = np.random.default_rng(s.seed)
    model = Model(rng.uniform(-1, 1, (1 << s.bits, s.dim)).astype(np.float32) / s.dim, np.zeros((s.dim, 2), np.float32), np.zeros(2, np.float32), s, len(set(labels)) == 2)
    n = len(docs)
    if not n:
        return model
    passes = max(1, min(40, round(s.steps / n)))
    total, step = passes * n, 0
    for _ in range(passes):
        for k in rng.permutation(n):
            rate, step = s.rate * (1 - step / total), step + 1
            ids, share = docs[k]
            rows = model.vectors[ids]
            hidden = share @ rows
            z = hidden @ model.output + model.bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = model.output @ p
            model.output -= rate * np.outer(hidden, p)
            model.bias -= 0.05 * rate * p
            if len(ids):
                model.vectors[ids] = rows - (rate * len(ids) ** 0.5 * share)[:, None] * back
    return model


def scorer(projected: np.ndarray, bias: float, s: Settings):
    def score(column: pa.Array) -> np.ndarray:
        buf, offsets = texts(column)
        out = np.empty(len(column))
        for i, j in chunks(offsets):
            kinds, firsts = features(buf, offsets, i, j, s)
            total, n = np.zeros(j - i), np.zeros(j - i)
            for f, first in zip(kinds, firsts, strict=True):
                sums = np.concatenate([[0.0], np.cumsum(projected[f])])
                total += sums[first[1:]] - sums[first[:-1]]
                n += np.diff(first)
            out[i:j] = 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + bias, -700, 700)))
        return out

    return score


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, s: Settings = Settings()) -> Model:
    """Learns ``labels`` (doc_id, quality) of ``docs`` (doc_id, text). learn: which ids may be learned from, a condition on doc_id."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    if learn is not None:
        known = known.where(learn)
    order = F.xxhash64("doc_id")
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(order, "doc_id").limit(s.sample)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    rows = rows.orderBy(order, "doc_id", "text").limit(s.sample)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [(pack(np.diff(ids, prepend=0).astype(np.uint32)), pack(n.astype(np.uint32))) for ids, n in counted(b.column("text"), s)]
            cells = [pa.array([x[k] for x in own], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), b.column("text_hash"), *cells], ["doc_id", "quality", "text_hash", "steps", "n"])

    own = rows.withColumn("text_hash", F.xxhash64("text")).mapInArrow(featured, rows.select("doc_id", "quality").withColumn("text_hash", F.lit(0).cast("long")).schema.add("steps", "binary").add("n", "binary"))
    tidy(docs.sparkSession)
    own = sorted(own.collect(), key=lambda r: (r.doc_id, r.text_hash))
    cells, known = Packed([(r.steps, r.n) for r in own]), [r.quality for r in own]
    del own
    tidy(docs.sparkSession)  # the rows' copies in the JVM
    return train(cells, known, s)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` as doc_id, score and the columns of ``keep``, row by row in one pass."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((model.projected(), float(model.bias[1] - model.bias[0]), model.settings))
    kept = [c for c in dict.fromkeys(("doc_id", *keep)) if c != "quality_score"]
    schema = docs.select(*kept).withColumn("quality_score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(*shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(of(b.column("text")))], [*kept, "quality_score"])

    return docs.select(*dict.fromkeys((*kept, "text"))).mapInArrow(run, schema)
