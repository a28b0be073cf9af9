"""Language-model scoring by a hidden Markov model over words.

Hidden states emit symbols: each of the ``frequent`` most frequent training words is a symbol, as is the end of a text;
any other word is first a class, by a hash of its last three bytes, and then a word of that class, with probability
(c + 0.5) / (sum of (c' + 0.5) over the class's training words + 0.5), the rest being left for words never seen. So the
probabilities of all words, one unseen word for each class, sum to 1. Baum-Welch trains start, transition and emission
probabilities: each partition computes the expected counts of its texts, the partitions' counts are added up, and new
probabilities follow. Every pass goes over all tokens of all training texts, each text as one sequence; the first model
has the corpus's own frequencies, shaken at random for each state. A text longer than ``block`` tokens is worked on block
by block: the forward vectors at the blocks' edges are kept, and the backward vector is carried over from the block after.
A text's score is exact: the scaled forward recursion over the whole of it.

How it is distributed. Words are 64-bit hashes; batches hold their texts as numbers of their own word lists. A batch asks
each shard for the corpus counts of its words once, so a frequent word is one entry a batch; where there are more than
``fan`` batches, the requests of ``fan`` batches are added up before a shard adds up these sums, so that no task holds a
row for each batch. Only the frequent words and the model (``states`` times the symbols) are sent to the driver and
broadcast, of fixed size whatever the corpus.

Nulls and edges: a null or empty text is its end token only; a null id counts as training; repeated rows are counted and
scored each; with no training text base_score is 0 for each token; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import batches as B
from .common import BYTE64, U, Words, chunks, fixed_plan, mix, partitions, settle, texts

END = U(0)


@dataclass(frozen=True)
class Settings:
    states: int = 8
    frequent: int = 4096
    classes: int = 1024
    #: Passes of Baum-Welch over the corpus.
    passes: int = 6
    #: Tokens of a text whose vectors are held at a time, and steps between two scalings.
    block: int = 1 << 17
    every: int = 12
    seed: int = 3
    #: Requests that one task adds up, at most about.
    fan: int = 4096
    #: Bytes of text in a batch and for each shard of the counts, about.
    batch: int = 8 << 20
    shard: int = 24 << 20

    @property
    def symbols(self) -> int:
        return self.frequent + self.classes + 1


TOKENS = "batch long, ids array<long>, held binary, sizes binary, words binary, counts binary, classes binary, tokens binary"


def tokenised(s: Settings):
    """Batches of texts as numbers of the batch's own sorted word list; the last token of each text is its end."""

    def part(buf: np.ndarray, offsets: np.ndarray, i: int, j: int):
        every, sizes, kinds = [], [], []
        for a, b in chunks(offsets[i : j + 1]):
            w = Words(buf, offsets, i + a, i + b)
            h = w.hashes()
            h[h == END] += U(1)
            kind = np.zeros(len(h), U)
            for k in (1, 2, 3):
                kind = kind * U(1_000_003) + np.where(w.end - k >= w.start, BYTE64[w.bytes[w.end - k]], U(0))
            n = np.diff(w.first)
            at = w.first[1:]
            every.append(np.insert(h, at, END))
            kinds.append(np.insert((mix(kind) % U(s.classes)).astype(np.uint16), at, 0))
            sizes.append(n + 1)
        return np.concatenate(every), np.concatenate(kinds), np.concatenate(sizes)

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in arrived:
            buf, offsets = texts(b.column("_text"))
            ids, all_held = b.column("_id"), b.column("_held").to_numpy(zero_copy_only=False).astype(bool)
            for i, j in chunks(offsets, s.batch):
                h, kinds, sizes = part(buf, offsets, i, j)
                order = np.argsort(h)
                new = np.append(True, np.diff(h[order]) != 0)
                local = np.empty(len(h), np.uint32)
                local[order] = np.cumsum(new) - 1
                first = order[new]
                held = all_held[i:j]
                counts = np.bincount(local[np.repeat(~held, sizes)], minlength=len(first))
                cells = (held, sizes.astype(np.int64), h[first], counts.astype(np.int64), kinds[first], local)
                lists = pa.ListArray.from_arrays(np.array([0, j - i], np.int32), ids[i:j])
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), lists, *(pa.array([B.pack(c)], pa.binary()) for c in cells)], TOKENS.replace(",", "").split()[::2])
                number += 1

    return run


def words_of(row: dict) -> np.ndarray:
    return B.unpack(row["words"], U)


def by_shard(words: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of words by shard, and where each shard that has any begins and ends."""
    shard = words % U(shards)
    order = np.argsort(shard, kind="stable")
    edge = np.flatnonzero(np.append(True, np.diff(shard[order]) != 0))
    return order, edge, np.append(edge[1:], len(order))


REQUEST = "shard long, batch long, words binary, counts binary, classes binary"


def ask(shards: int):
    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.each(arrived):
            words, counts, kinds = words_of(row), B.unpack(row["counts"], np.int64), B.unpack(row["classes"], np.uint16)
            order, begin, end = by_shard(words, shards)
            out: list[list] = [[], [], [], [], []]
            for a, b in zip(begin, end, strict=True):
                k = order[a:b]
                for column, value in zip(out, (int(words[k[0]] % U(shards)), row["batch"], words[k].tobytes(), B.pack(counts[k]), B.pack(kinds[k])), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:2]), *(pa.array(c, pa.binary()) for c in out[2:])], ["shard", "batch", "words", "counts", "classes"])

    return run


COUNTED = "batch long, shard long, counts binary, tokens long, distinct long, top array<struct<word:long,n:long,kind:int>>, masses binary"
COUNTED_NAMES = ["batch", "shard", "counts", "tokens", "distinct", "top", "masses"]


def summed(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Distinct words of some requests, their counts and classes, the place of each requested word among them, and where
    each request begins."""
    words = [np.frombuffer(x.as_py(), U) for x in t.column("words")]
    n = np.concatenate([B.unpack(x.as_py(), np.int64) for x in t.column("counts")])
    kinds = np.concatenate([B.unpack(x.as_py(), np.uint16) for x in t.column("classes")])
    every, first, inverse = np.unique(np.concatenate(words), return_index=True, return_inverse=True)
    total = np.zeros(len(every), np.int64)
    np.add.at(total, inverse, n)
    return every, total, kinds[first], inverse, np.cumsum([0, *map(len, words)]).tolist()


def pooled(t: pa.Table) -> pa.Table:
    """The requests of a pool of batches as one, which takes the pool's number for that of a batch."""
    every, total, kinds, _, _ = summed(t)
    cells = [pa.array([v], pa.binary()) for v in (every.tobytes(), B.pack(total), B.pack(kinds))]
    return pa.table([t.column("shard")[:1], t.column("pool")[:1], *cells], ["shard", "batch", "words", "counts", "classes"])


def passed_on(key: tuple, requests: pa.Table, answers: pa.Table) -> pa.Table:
    """What a pool was told, to each of its batches."""
    *_, inverse, at = summed(requests)
    total = B.unpack(answers.column("counts")[0].as_py(), np.int64)
    own = [B.pack(total[inverse[a:b]]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return pa.table([requests.column("batch"), requests.column("shard"), pa.array(own, pa.binary())], ["batch", "shard", "counts"])


def count(s: Settings):
    """A shard's counts over the corpus, to each batch that asked; and once the shard's totals, most frequent words, and
    the number and counts of the words of each class."""

    def run(t: pa.Table) -> pa.Table:
        every, total, kinds, inverse, at = summed(t)
        top = np.lexsort((every, -total, every != END))[: s.frequent + 1]
        top = top[total[top] > 0]
        known = total > 0
        words_known = known & (every != END)
        mass = np.bincount(kinds[words_known], total[words_known] + 0.5, s.classes)
        rows = t.num_rows
        own = [B.pack(total[inverse[a:b]]) for a, b in zip(at[:-1], at[1:], strict=True)]
        once = lambda x, kind: pa.array([x] + [None] * (rows - 1), kind)
        return pa.table(
            [
                t.column("batch"),
                t.column("shard"),
                pa.array(own, pa.binary()),
                once(int(total.sum()), pa.int64()),
                once(int(known.sum()), pa.int64()),
                once([{"word": int(w), "n": int(n), "kind": int(k)} for w, n, k in zip(every[top].astype(np.int64), total[top], kinds[top], strict=True)], pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64()), ("kind", pa.int32())]))),
                once(mass.tobytes(), pa.binary()),
            ],
            COUNTED_NAMES,
        )

    return run


def counts_of(corpus: DataFrame, batches: int, shards: int, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(batch, shard, counts), the answers to all requests; and the shards' totals, as made by ``count``."""
    requests = corpus.select("batch", "words", "counts", "classes").mapInArrow(ask(shards), REQUEST)
    pools = -(-batches // s.fan)
    if pools <= 1:
        told = settle(requests.groupBy("shard").applyInArrow(count(s), COUNTED))
        return told.select("batch", "shard", "counts"), told
    requests = settle(requests.withColumn("pool", F.pmod(F.xxhash64("batch"), F.lit(pools))))
    told = settle(requests.groupBy("shard", "pool").applyInArrow(pooled, REQUEST).groupBy("shard").applyInArrow(count(s), COUNTED))
    pool = told.select("shard", F.col("batch").alias("pool"), "counts")
    answers = requests.groupBy("shard", "pool").cogroup(pool.groupBy("shard", "pool")).applyInArrow(passed_on, "batch long, shard long, counts binary")
    return settle(answers), told


# ---------------------------------------------------------------- the model


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states

    @staticmethod
    def random(s: Settings, counts: np.ndarray) -> Model:
        rng = np.random.default_rng(s.seed)
        emit = (counts[:, None] + 0.1) * rng.uniform(0.5, 1.5, (s.symbols, s.states))
        move = np.full((s.states, s.states), 0.1 / max(1, s.states - 1)) if s.states > 1 else np.ones((1, 1))
        np.fill_diagonal(move, 0.9 if s.states > 1 else 1.0)
        return Model(np.full(s.states, 1 / s.states), move, emit / emit.sum(0))

    @staticmethod
    def of(stats: np.ndarray, s: Settings) -> Model:
        """From expected counts: a row for each symbol, then for each state moved from, then the starts."""
        emit, move, start = stats[: s.symbols] + 0.02, stats[s.symbols : s.symbols + s.states] + 0.5, stats[-1] + 0.5
        return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def lanes(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sequences from longest to shortest: their order, how many have a token at each step, and the tokens by step."""
    size = np.array([len(x) for x in sequences])
    order = np.argsort(-size, kind="stable")
    active = len(size) - np.searchsorted(np.sort(size), np.arange(size.max() if len(size) else 0), "right")
    begin = np.concatenate([[0], np.cumsum(active)])
    out = np.empty(int(size.sum()), np.int64)
    for lane, k in enumerate(order):
        out[begin[: size[k]] + lane] = sequences[k]
    return order, begin, out


def ahead(m: Model, begin: np.ndarray, e: np.ndarray, s: Settings, first: np.ndarray | None = None, keep: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """The forward recursion over sequences in the order of ``lanes``; e: the emission probabilities of each token. Returns
    for each sequence the natural logarithm of its likelihood and its last vector, scaled to 1; with ``keep`` also the
    vectors at all tokens, each in some scale. first: the vectors before the first tokens, if a sequence goes on."""
    n = int(begin[1]) if len(begin) > 1 else 0
    log, last = np.zeros(n), np.zeros((n, len(m.start)))
    alphas = np.empty_like(e) if keep else None
    a, steps = first, len(begin) - 1
    for t in range(steps):
        lo, hi = begin[t], begin[t + 1]
        a = m.start * e[lo:hi] if a is None else (a[: hi - lo] @ m.move) * e[lo:hi]
        if t % s.every == 0:  # probabilities of a few steps are far from the smallest double
            c = a.sum(1)
            a /= c[:, None]
            log[: hi - lo] += np.log(c)
        if keep:
            alphas[lo:hi] = a
        going = begin[t + 2] - hi if t + 2 <= steps else 0
        if going < hi - lo:  # some sequences end here
            c = a[going:].sum(1)
            log[going : hi - lo] += np.log(c)
            last[going : hi - lo] = a[going:] / c[:, None]
    return log, last, alphas


def back(m: Model, begin: np.ndarray, e: np.ndarray, s: Settings, end: np.ndarray | None = None) -> np.ndarray:
    """The backward vectors at all tokens, each in some scale. end: those at the last tokens, if the sequence goes on."""
    betas = np.ones_like(e)
    turned, after = np.ascontiguousarray(m.move.T), None
    for t in range(len(begin) - 2, -1, -1):
        lo, hi = begin[t], begin[t + 1]
        b = betas[lo:hi]
        if after is None and end is not None:
            b[:] = end
        elif after is not None:
            b[: len(after)] = after @ turned
            if t % s.every == 0:
                b /= b.sum(1)[:, None]
        after = e[lo:hi] * b
    return betas


def tally(m: Model, begin: np.ndarray, tokens: np.ndarray, e: np.ndarray, alphas: np.ndarray, betas: np.ndarray, stats: np.ndarray, s: Settings, first: np.ndarray | None = None) -> None:
    """Adds the expected counts, given both vectors at each token."""
    states = alphas * betas
    states /= states.sum(1)[:, None]
    for k in range(s.states):
        stats[: s.symbols, k] += np.bincount(tokens, states[:, k], s.symbols)
    n = int(begin[1])
    follows = np.arange(n, len(tokens)) - np.repeat(begin[1:-1] - begin[:-2], np.diff(begin)[1:])  # the token before each one
    before, ahead_ = alphas[follows], e[n:] * betas[n:]
    if first is None:
        stats[-1] += states[:n].sum(0)
    else:
        before, ahead_ = np.concatenate([first, before]), np.concatenate([e[:n] * betas[:n], ahead_])
    both = ((before @ m.move) * ahead_).sum(1)
    stats[s.symbols : s.symbols + s.states] += m.move * (before.T @ (ahead_ / both[:, None]))


def expect(m: Model, sequences: list[np.ndarray], stats: np.ndarray, s: Settings) -> None:
    """Adds the expected counts of the sequences to ``stats``."""
    for x in sequences:
        if len(x) > s.block:
            _expect_long(m, x, stats, s)
    _, begin, tokens = lanes([x for x in sequences if len(x) <= s.block])
    if len(tokens):
        e = m.emit[tokens]
        tally(m, begin, tokens, e, ahead(m, begin, e, s, keep=True)[2], back(m, begin, e, s), stats, s)


def _expect_long(m: Model, x: np.ndarray, stats: np.ndarray, s: Settings) -> None:
    """One long sequence, block by block: forwards for the vectors at the edges, then backwards with both."""
    at = [*range(0, len(x), s.block), len(x)]
    edges: list[np.ndarray | None] = [None]
    for a, b in zip(at[:-2], at[1:-1], strict=True):
        edges.append(ahead(m, np.arange(b - a + 1), m.emit[x[a:b]], s, edges[-1])[1])
    end = None
    for first, a, b in zip(edges[::-1], at[-2::-1], at[:0:-1], strict=True):
        begin, e = np.arange(b - a + 1), m.emit[x[a:b]]
        alphas, betas = ahead(m, begin, e, s, first, keep=True)[2], back(m, begin, e, s, end)
        tally(m, begin, x[a:b], e, alphas, betas, stats, s, first)
        end = (e[0] * betas[0]) @ m.move.T
        end /= end.sum()


def likelihood(m: Model, sequences: list[np.ndarray], s: Settings) -> np.ndarray:
    """The natural logarithm of each sequence's probability."""
    out = np.empty(len(sequences))
    size = np.array([len(x) for x in sequences])
    for k in np.flatnonzero(size > s.block):
        x, edge, out[k] = sequences[k], None, 0
        for a in range(0, len(x), s.block):
            part = x[a : a + s.block]
            log, edge, _ = ahead(m, np.arange(len(part) + 1), m.emit[part], s, edge)
            out[k] += log[0]
    short = np.flatnonzero(size <= s.block)
    of, begin, tokens = lanes([sequences[k] for k in short])
    if len(short):
        out[short[of]] = ahead(m, begin, m.emit[tokens], s)[0]
    return out


def grouped(sequences: list[np.ndarray], most: int = 1 << 18) -> Iterator[list[int]]:
    """Numbers of sequences of like length, of about ``most`` tokens together or one that is longer."""
    size = np.array([len(x) for x in sequences])
    order = np.argsort(size, kind="stable").tolist()
    own, total = [], 0
    for k in order:
        if own and total + size[k] > most:
            yield own
            own, total = [], 0
        own.append(k)
        total += size[k]
    if own:
        yield own


def symbols(words: np.ndarray, kinds: np.ndarray, top: np.ndarray, s: Settings) -> np.ndarray:
    """The symbols of words; top: the frequent words, sorted."""
    at = np.minimum(np.searchsorted(top, words), max(0, len(top) - 1))
    out = s.frequent + kinds.astype(np.int64)
    if len(top):
        frequent = top[at] == words
        out[frequent] = at[frequent]
    out[words == END] = s.frequent + s.classes
    return out


def training(row: dict, top: np.ndarray, s: Settings) -> list[np.ndarray]:
    """The training texts of a batch as sequences of symbols."""
    symbol = symbols(words_of(row), B.unpack(row["classes"], np.uint16), top, s)[B.unpack(row["tokens"], np.uint32)]
    sizes, held = B.unpack(row["sizes"], np.int64), B.unpack(row["held"], bool)
    at = np.concatenate([[0], np.cumsum(sizes)])
    return [symbol[a:b] for a, b, h in zip(at[:-1], at[1:], held, strict=True) if not h]


def expectations(m: Model, top: np.ndarray, s: Settings):
    """A partition's expected counts, in slices."""

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, some = np.zeros((s.symbols + s.states + 1, s.states)), False
        for row in B.each(arrived):
            sequences = training(row, top, s)
            for own in grouped(sequences):
                expect(m, [sequences[k] for k in own], stats, s)
                some = True
        if some:
            part = TaskContext.get().partitionId()
            slices = np.array_split(stats, 16)
            yield pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), pa.array([part % 64] * 16, pa.int32()), pa.array([x.tobytes() for x in slices], pa.binary())], ["slice", "part", "stats"])

    return run


def add(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py()) for x in t.column("stats"))
    return pa.table([t.column("slice")[:1], t.column("part")[:1], pa.array([total.tobytes()], pa.binary())], ["slice", "part", "stats"])


def baum_welch(corpus: DataFrame, m: Model, top: np.ndarray, s: Settings) -> Model:
    """One pass over the corpus. The counts are added in two steps, so no task adds up all partitions' counts."""
    schema = "slice int, part int, stats binary"
    told = corpus.select("held", "sizes", "words", "classes", "tokens").mapInArrow(expectations(m, top, s), schema)
    told = told.groupBy("slice", "part").applyInArrow(add, schema).groupBy("slice").applyInArrow(add, schema)
    rows = sorted(told.collect(), key=lambda r: r.slice)
    return Model.of(np.concatenate([np.frombuffer(r.stats) for r in rows]).reshape(-1, s.states), s) if rows else m


def scored(m: Model, top: np.ndarray, mass: np.ndarray, tokens: int, distinct: int, shards: int, s: Settings):
    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.each(arrived):
            words, kinds, local = words_of(row), B.unpack(row["classes"], np.uint16), B.unpack(row["tokens"], np.uint32)
            sizes, held = B.unpack(row["sizes"], np.int64), B.unpack(row["held"], bool)
            order, _, _ = by_shard(words, shards)
            c = np.empty(len(words), np.int64)
            c[order] = np.concatenate([B.unpack(x["counts"], np.int64) for x in row["parts"]])
            symbol = symbols(words, kinds, top, s)
            within = np.where(symbol >= s.frequent, np.log10((c + 0.5) / (mass[kinds] + 0.5)), 0.0)
            within[words == END] = 0
            base = np.log10((c + 0.5) / (tokens + 0.5 * (distinct + 1)))
            at = np.concatenate([[0], np.cumsum(sizes)])
            total = lambda x: np.add.reduceat(x[local], at[:-1])
            score = total(within)
            k = symbol[local]
            sequences = [k[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            for own in grouped(sequences):
                score[own] += likelihood(m, [sequences[j] for j in own], s) / np.log(10)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"], pa.int64()), pa.array(held), pa.array(sizes), pa.array(total((c > 0).astype(np.int64))), pa.array(np.full(len(sizes), tokens)), pa.array(total(base)), pa.array(score)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


@dataclass
class Fitted:
    model: Model
    #: The frequent words, sorted; the mass of each class; tokens and distinct tokens.
    top: np.ndarray
    mass: np.ndarray
    tokens: int
    distinct: int
    corpus: DataFrame
    #: (batch, shard, counts)
    counts: DataFrame
    shards: int


def fit(docs: DataFrame, held_out: Column, s: Settings = Settings()) -> Fitted:
    """The model of the rows of ``docs`` (doc_id, text) that are not ``held_out``, and all rows as batches."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"), F.coalesce(held_out, F.lit(False)).alias("_held"))
    with fixed_plan(spark):
        corpus = settle(source.mapInArrow(tokenised(s), TOKENS).repartition(partitions(docs), "batch"))
    size = corpus.agg(F.sum(F.octet_length("tokens") + F.octet_length("words")).alias("bytes"), F.count("*").alias("batches")).first()
    shards = max(1, -(-2 * (size.bytes or 0) // s.shard))
    counts, told = counts_of(corpus, size.batches, shards, s)
    totals = told.agg(F.sum("tokens").alias("tokens"), F.sum("distinct").alias("distinct")).first()
    # settled first: the shards' candidates meet in a task, and only the chosen ones are sent to the driver
    best = settle(told.where("top is not null").select(F.explode("top").alias("t")).select("t.*").orderBy(F.col("word") != 0, F.desc("n"), "word").limit(s.frequent + 1)).collect()
    top = [r for r in best if r.word != 0][: s.frequent]
    ends = sum(r.n for r in best if r.word == 0)
    order = np.argsort(np.array([r.word for r in top], np.int64).astype(U))
    words = np.array([r.word for r in top], np.int64).astype(U)[order]
    n = np.array([r.n for r in top], np.float64)[order]
    mass = told.where("masses is not null").select("shard", "masses").groupBy(F.pmod("shard", F.lit(64)).alias("part")).applyInArrow(add_masses, "part int, masses binary").collect()
    mass = np.sum([np.frombuffer(r.masses) for r in mass], axis=0) if mass else np.zeros(s.classes)
    # a frequent word is a symbol of its own and no word of its class
    mass = np.maximum(mass - np.bincount([r.kind for r in top], [r.n + 0.5 for r in top], s.classes), 0)
    model = Model.random(s, np.concatenate([n, np.zeros(s.frequent - len(n)), mass, [ends]]))
    for _ in range(s.passes if totals.tokens else 0):
        model = baum_welch(corpus, model, words, s)
    return Fitted(model, words, mass, totals.tokens or 0, totals.distinct or 0, corpus, counts, shards)


def score(docs: DataFrame, held_out: Column, s: Settings = Settings()) -> DataFrame:
    """Of each row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. The
    model learns from the rows that are not ``held_out``."""
    f = fit(docs, held_out, s)
    parts = f.counts.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("shard", "counts"))).alias("parts"))
    run = scored(f.model, f.top, f.mass, f.tokens, f.distinct, f.shards, s)
    return f.corpus.drop("counts").join(parts.hint("merge"), "batch").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def add_masses(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py()) for x in t.column("masses"))
    return pa.table([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "masses"])
