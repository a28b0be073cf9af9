"""MinHash near-dedup with tensored banding.

A document is the set of its distinct ``size``-word shingles (fewer words: the whole sequence as one). Documents are
linked if their sets' Jaccard similarity is at least ``percent``/100, confirmed on the full sets.

Tensored banding: two small collections of ``groups`` band keys (each of ``rows`` minhashes) are computed; the
``groups ** 2`` tables are keyed by the pairs of a key of the first and a key of the second collection, so the tables
cost about the square root of the minhashes that as many independent ones would. With 12 groups of 2 rows, 48 minhashes
make 144 tables of 4 rows each, and a pair at exactly 0.75 shares no table with probability 1e-4 (0.8: 1e-5).

How it is distributed. Documents with equal sets are one class, whatever their number. Keys that only one class has are
dropped before pairs are formed. Each table bucket gives one edge from each class to the smallest one, not all pairs;
the connected parts of these edges are clusters. Sets of a cluster meet in blocks of at most about ``block`` classes,
where all of them are compared exactly. A cluster of several blocks shares a few classes (pivots) among its blocks, which
ties the blocks' components together; the classes that are still not in the cluster's largest component are then
compared with all its blocks, chunk by chunk. So no link between different components of a cluster is lost, and no task
grows with a cluster.

Nulls and edges: documents without words are linked with nothing and stay; a null id takes part in links but never names
a component (a component of null ids only has a null id, kept true); repeated rows are of one class, and rows with the
kept id are all kept; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches as B
from .common import ADD, ODD, U, Words, chunks, distinct, mix, settle, shingles
from .graph import components


@dataclass(frozen=True)
class Settings:
    size: int = 5
    percent: int = 75
    groups: int = 12
    rows: int = 2
    block: int = 256
    pivots: int = 8


SIGNATURE = "batch long, idx int, doc_id long, n_shingles long, cls long, a array<long>, b array<long>"


def sets(buf: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for i, j in chunks(offsets):
        h, first = shingles(Words(buf, offsets, i, j), size)
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield distinct(h[a:b])


def minhashes(h: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """n minhashes of each of the (non-empty) sets h[first[k]:first[k+1]]."""
    out = np.empty((len(first) - 1, n), U)
    with np.errstate(over="ignore"):
        for k in range(n):
            out[:, k] = np.minimum.reduceat(h * ODD[100 + k] + ADD[100 + k], first[:-1])
    return out


def signatures(s: Settings):
    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = s.groups * s.rows
        for row in B.each(arrived):
            ids, buf, offsets = B.opened(row)
            own = list(sets(buf, offsets, s.size))
            some = [k for k, x in enumerate(own) if len(x)]
            cls = np.zeros(len(own), np.int64)
            keys = np.zeros((len(some), 2 * s.groups), np.int64)
            for k in some:
                cls[k] = int.from_bytes(hashlib.blake2b(own[k].tobytes(), digest_size=8).digest(), "little", signed=True)
            at = 0
            while at < len(some):  # sets of a few MB at a time
                part, total = [], 0
                while at + len(part) < len(some) and (not part or total < 1 << 17):
                    part.append(own[some[at + len(part)]])
                    total += len(part[-1])
                first = np.concatenate([[0], np.cumsum([len(x) for x in part])])
                m = minhashes(np.concatenate(part), first, 2 * n).reshape(len(part), 2 * s.groups, s.rows)
                with np.errstate(over="ignore"):
                    key = np.zeros(m.shape[:2], U)
                    for r in range(s.rows):
                        key = mix(key + m[:, :, r] * ODD[1000 + r])
                    keys[at : at + len(part)] = mix(key + ADD[2000 : 2000 + 2 * s.groups]).astype(np.int64)
                at += len(part)
            null = np.ones(len(own), bool)
            null[some] = False
            edge = np.concatenate([[0], np.cumsum(~null)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(edge * s.groups), pa.array(half.ravel())) for half in (keys[:, : s.groups], keys[:, s.groups :])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["batch"]] * len(ids), pa.int64()), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids, pa.int64()), pa.array([len(x) for x in own], pa.int64()), pa.array(cls, mask=null), *lists],
                ["batch", "idx", "doc_id", "n_shingles", "cls", "a", "b"],
            )

    return run


def fetch(s: Settings):
    """The sets of the wanted classes of a batch."""

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.each(arrived):
            _, buf, offsets = B.opened(row)
            out: list[list] = [[], [], [], [], []]
            for w in row["wanted"]:
                k = w["idx"]
                own = next(sets(buf[offsets[k] : offsets[k + 1]], offsets[k : k + 2] - offsets[k], s.size))
                for column, value in zip(out, (w["cls"], w["cluster"], w["blocks"], w["block"], own.tobytes()), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["cls", "cluster", "blocks", "block", "hashes"])

    return run


def links(own: list[np.ndarray], s: Settings, slab: int = 8192) -> np.ndarray:
    """Which of the sets are linked, as a matrix, by exact intersection sizes."""
    n = len(own)
    size = np.array([len(x) for x in own], np.int64)
    h, owner = np.concatenate(own), np.repeat(np.arange(n), size)
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    again = h[1:] == h[:-1]
    shared = np.append(again, False) | np.append(False, again)  # what one set alone has is in no intersection
    h, owner = h[shared], owner[shared]
    column = np.cumsum(np.append(False, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    both = np.zeros((n, n), np.float64)
    for lo in range(0, int(column[-1]) + 1 if len(h) else 0, slab):
        a, b = np.searchsorted(column, [lo, lo + slab])
        m = np.zeros((n, min(slab, int(column[b - 1]) - lo + 1)), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        both += m @ m.T
    inter = both.astype(np.int64)
    return (100 * inter >= s.percent * (size[:, None] + size[None, :] - inter)) & (size > 0)[:, None]


def stars(linked: np.ndarray, cls: np.ndarray) -> tuple[list[int], list[int]]:
    """An edge from each member of each component to its smallest member."""
    u, v, seen = [], [], np.zeros(len(cls), bool)
    for k in np.argsort(cls):
        if seen[k]:
            continue
        seen[k] = True
        front = linked[k] & ~seen
        while front.any():
            seen |= front
            u += cls[front].tolist()
            v += [int(cls[k])] * int(front.sum())
            front = linked[front].any(axis=0) & ~seen
    return u, v


def compare(s: Settings):
    """Edges among the sets of a block and its guests."""

    def run(t: pa.Table) -> pa.Table:
        cls = t.column("cls").to_numpy()
        cls, first = np.unique(cls, return_index=True)
        data = t.column("hashes")
        u, v = stars(links([np.frombuffer(data[int(k)].as_py(), U) for k in first], s), cls)
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def clusters(reps: DataFrame) -> DataFrame:
    """``reps`` (cls, a, b) as (cls, cluster): what table buckets connect."""
    keyed = reps.select("cls", F.explode("a").alias("k"), F.lit(0).alias("side")).union(reps.select("cls", F.explode("b").alias("k"), F.lit(1).alias("side")))
    shared = keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    keyed = settle(keyed.join(shared, "k"))
    a, b = (keyed.where(F.col("side") == x).select("cls", F.col("k").alias(f"k{x}")) for x in (0, 1))
    tables = a.join(b, "cls").select("cls", F.xxhash64("k0", "k1").alias("key"))
    least = tables.groupBy("key").agg(F.min("cls").alias("v"), F.count("*").alias("n")).where("n > 1").select("key", "v")
    edges = tables.join(least, "key").where("cls != v").select(F.col("cls").alias("u"), "v").distinct()
    return components(edges).select(F.col("node").alias("cls"), F.col("component").alias("cluster"))


def confirmed(corpus: DataFrame, reps: DataFrame, found: DataFrame, s: Settings) -> DataFrame:
    """The components by confirmed links of the classes in ``found`` (cls, cluster), as (node, component)."""
    # blocks of a cluster, and the classes that all of them share; a cluster's first classes by a hash are as good as any
    sizes = found.groupBy("cluster").agg(F.ceil(F.count("*") / s.block).cast("int").alias("blocks"))
    placed = found.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("cls", F.lit(7)), F.col("blocks")).cast("int"))
    wanted = reps.join(placed, "cls").groupBy("at.batch").agg(F.collect_list(F.struct(F.col("at.idx").alias("idx"), "cls", "cluster", "blocks", "block")).alias("wanted"))
    members = settle(corpus.select("batch", "ids", "lengths", "texts").join(wanted.hint("merge"), "batch").mapInArrow(fetch(s), "cls long, cluster long, blocks int, block int, hashes binary"))
    large = members.where("blocks > 1")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    share = (F.lit(4 * s.pivots) / (F.col("blocks") * s.block)) * F.lit(2.0**31)
    pivots = large.where(F.pmod(F.xxhash64("cls", F.lit(8)), F.lit(2**31)) < share).withColumn("block", every("blocks"))
    columns = ("cls", "cluster", "block", "hashes")
    meet = members.select(*columns).union(pivots.select(*columns))
    edges = settle(meet.groupBy("cluster", "block").applyInArrow(compare(s), "u long, v long"))
    part = components(edges)
    if not large.limit(1).count():
        return part
    # what is known of a cluster is joined by cluster and block, so that no task gets all of a large one
    part = settle(part)
    sized = large.join(part.hint("merge"), large.cls == part.node, "left").select("cls", "cluster", "blocks", "block", "hashes", F.coalesce("component", "cls").alias("part"))
    main = sized.groupBy("cluster", "part").agg(F.count("*").alias("n"), F.max("blocks").alias("blocks")).groupBy("cluster").agg(F.max(F.struct("n", "part")).alias("top"), F.max("blocks").alias("blocks"))
    main = main.select("cluster", F.col("top.part").alias("main"), every("blocks").alias("block"))
    strays = sized.join(main.hint("merge"), ["cluster", "block"]).where("part != main")
    count = strays.groupBy("cluster").agg(F.ceil(F.count("*") / s.block).cast("int").alias("chunks"), F.max("blocks").alias("n")).select("cluster", "chunks", every("n").alias("block"))
    guests = strays.join(count.hint("merge"), ["cluster", "block"]).withColumn("chunk", F.pmod(F.xxhash64("cls", F.lit(9)), F.col("chunks")).cast("int")).withColumn("block", every("blocks"))
    hosts = sized.join(count.hint("merge"), ["cluster", "block"]).withColumn("chunk", every("chunks"))
    columns = ("cls", "cluster", "block", "chunk", "hashes")
    more = guests.select(*columns).union(hosts.select(*columns)).groupBy("cluster", "block", "chunk").applyInArrow(compare(s), "u long, v long")
    return components(edges.union(settle(more)))


@dataclass
class Result:
    #: batch, idx, doc_id, n_shingles, component_id, kept, first (whether the row is the one that stays of its component)
    rows: DataFrame
    corpus: DataFrame


def dedup(docs: DataFrame, s: Settings = Settings(), keep: tuple[str, ...] = ()) -> Result:
    corpus = B.batched(docs, keep)
    signed = settle(corpus.select("batch", "ids", "lengths", "texts").mapInArrow(signatures(s), SIGNATURE))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "batch", "idx")
    reps = settle(
        signed.where(F.col("cls").isNotNull())
        .groupBy("cls")
        .agg(F.min("doc_id").alias("least"), F.min(F.struct("batch", "idx")).alias("at"), F.min(row).alias("row"), F.first("a").alias("a"), F.first("b").alias("b"))
    )
    part = confirmed(corpus, reps.select("cls", "at"), clusters(reps.select("cls", "a", "b")), s)
    labelled = reps.select("cls", "least", "row").join(part, F.col("cls") == F.col("node"), "left").select("cls", "least", "row", F.coalesce("component", "cls").alias("part"))
    labelled = settle(labelled)
    least = labelled.groupBy("part").agg(F.min("least").alias("component"), F.min("row").alias("first"))
    of = labelled.select("cls", "part").join(least, "part").select(F.col("cls").alias("key"), "component", "first")
    key = F.coalesce("cls", F.xxhash64("batch", "idx"))  # textless rows would else meet in one task
    rows = (
        signed.select("batch", "idx", "doc_id", "n_shingles", "cls", key.alias("key"))
        .join(of, "key", "left")
        .select(
            "batch",
            "idx",
            "doc_id",
            "n_shingles",
            F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
            (F.col("cls").isNull() | (F.col("first.batch") == F.col("batch")) & (F.col("first.idx") == F.col("idx"))).alias("first"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
    return Result(rows, corpus)


def survivors(result: Result, schema: str, columns: list[str]) -> DataFrame:
    """One row of each component, with all columns that the corpus kept and its text, as ``columns`` of ``schema``."""
    keep = result.rows.where("first").groupBy("batch").agg(F.collect_list("idx").alias("idx"))

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.each(arrived):
            _, buf, offsets = B.opened(row)
            at = pa.array(sorted(row["idx"]), pa.int64())
            rest = B.rest(row).take(at)
            text = pa.array([buf[offsets[k] : offsets[k + 1]].tobytes().decode() for k in at.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([text if c == "text" else rest.column(c) for c in columns], columns)

    return result.corpus.join(keep.hint("merge"), "batch").mapInArrow(run, schema)
