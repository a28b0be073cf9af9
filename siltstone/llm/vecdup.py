"""Embedding near-dedup by iterative quantisation.

Vectors are linked if their labels are equal and the cosine of the originals, in double precision, is at least
``threshold``. Candidates come from binary codes: the vectors of a sample are centred, rotated to their principal axes
and then by a learned rotation that brings them closest to the corners of a cube (iterative quantisation), which makes
the bits balanced; a code is the signs. Codes are cut into substrings, and each substring of each of several such codes
keys a Hamming table. At an angle of a two signs differ with probability a/pi, so that substrings of b bits agree with
(1 - a/pi) ** b; with b near log2 of the number of vectors, as many tables are made as keep the chance that a linked pair
shares none under ``miss``. The angle is that after centring: linked unit vectors are at most d = sqrt(2 - 2 t) apart, so
a pair of which one is at least r > d from the mean is within asin(d / r). r is chosen by cost from the sample's
distances; all vectors nearer to the mean than r share one more bucket for each label, where each pair is compared.
Every pair of a bucket is reranked with the original vectors, which are scaled by a power of two first, so that neither
very large nor very small components leave the range of doubles.

How it is distributed. Equal vectors of a label are one class with a weight. Keys that one class alone has are dropped,
and so are buckets with the same classes as a bucket of an earlier table, as of a tight group. A bucket is dealt in blocks
of at most about ``block`` classes, pairs of which meet in tasks of fixed size, as matrix products; a pair that several
tables find counts in the first of them only, and blocks whose classes all share an earlier table are not multiplied.
What leaves a task is a count for each class and one edge for each class to its part of the block, never pairs. Only the
rotations are broadcast.

Nulls and edges: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label,
link with nothing and stay (component: their own id); vectors of different lengths are not linked; rows with a null id
count as vectors but name no component unless no other row of it has an id; repeated rows link with each other; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches as B
from .common import U, mix, partitions, settle
from .graph import components
from .neardup import stars


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.98
    miss: float = 1e-4
    #: Vectors from which rotations are learned, at most.
    sample: int = 4096
    rounds: int = 30
    block: int = 256
    seed: int = 17


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. They are first scaled exactly, by a power of two, to a largest component near 1."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rotations(x: np.ndarray, bits: int, n: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The mean, and n learned maps to ``bits`` signed coordinates side by side."""
    mean = x.mean(0)
    centred = x - mean
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    axes = axes[:bits].T
    v = centred @ axes
    out = []
    for k in range(n):
        r, _ = np.linalg.qr(np.random.default_rng(s.seed + k).normal(size=(v.shape[1], v.shape[1])))
        for _ in range(s.rounds):
            corners = np.where(v @ r >= 0, 1.0, -1.0)
            a, _, b = np.linalg.svd(corners.T @ v)
            r = (a @ b).T
        out.append(axes @ r)
    return mean, np.concatenate(out, axis=1)


def plan(rows: int, dim: int, s: Settings, angle: float | None = None) -> tuple[int, int, int]:
    """Bits of a substring, substrings of a code, and codes, for so many vectors. angle: of linked pairs, at most; default
    that of the threshold."""
    width = min(dim, max(8, math.ceil(math.log2(max(2, rows)))))
    agree = (1 - (math.acos(s.threshold) if angle is None else angle) / math.pi) ** width
    tables = math.ceil(math.log(s.miss) / math.log(1 - agree))
    per_code = max(1, dim // width)
    return width, per_code, -(-tables // per_code)


def near_mean(x: np.ndarray, rows: int, s: Settings) -> tuple[float, float]:
    """From the unit vectors of a sample: r, the distance from their mean below which all pairs are compared, and the angle
    after centring that no other linked pair exceeds."""
    far = np.sort(np.linalg.norm(x - x.mean(0), axis=1))
    d, dim = math.sqrt(2 - 2 * s.threshold), x.shape[1]
    best = (math.inf, math.inf, math.acos(s.threshold))  # all pairs
    for share in (0.0, 0.001, 0.01, 0.03, 0.1, 0.3, 0.5, 1.0):
        r = math.inf if share == 1 else far[int(share * len(far))] * (1 - 1e-9)
        angle = math.acos(s.threshold) if share == 1 else math.asin(min(1.0, d / r)) if r > 0 else math.pi
        if share < 1 and r <= d:
            continue
        _, per_code, codes = plan(rows, dim, s, angle)
        tables = per_code * codes
        # rows that a vector is sent in, times what each carries
        cost = (tables + share**2 * rows / s.block) * (tables + dim)
        best = min(best, (cost, r, angle))
    return best[1:]


def signed(maps: dict[int, tuple], s: Settings):
    """Keys of the tables for each class."""

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrived:
            dims = np.array([len(x) for x in b.column("v")])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                part = b.take(pa.array(at))
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                x = units(x)
                mean, maps_, width, per_code, r_ = maps[int(dim)]
                bits = (x - mean) @ maps_ >= 0
                size = maps_.shape[1] // (per_code * width) if maps_.shape[1] else 0
                keys = []
                label = part.column("label").to_numpy(zero_copy_only=False).astype(np.int64).astype(U)
                code = maps_.shape[1] // max(1, size)
                with np.errstate(over="ignore"):
                    salt = mix(label * U(0x9E3779B97F4A7C15) + U(dim))
                    own = mix(part.column("cls").to_numpy(zero_copy_only=False).astype(np.int64).astype(U) ^ U(0xA0761D6478BD642F))
                    keys.append(np.where(np.linalg.norm(x - mean, axis=1) < r_, mix(salt ^ U(0xE7037ED1A0B428DB)), own))
                    for r in range(size):
                        for k in range(per_code):
                            word = bits[:, r * code + k * width : r * code + (k + 1) * width]
                            h = np.zeros(len(x), U)
                            for j in range(width):
                                h = h * U(2) + word[:, j].astype(U) if j % 60 else mix(h) + word[:, j].astype(U)
                            keys.append(mix(mix(h + U(1 + r * per_code + k) * U(0xD6E8FEB86659FD93)) ^ salt))
                flat = np.stack(keys, axis=1).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
                raw = pa.array([row.tobytes() for row in x], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("cls"), part.column("weight"), lists, raw], ["cls", "weight", "keys", "unit"])

    return run


LINKS = "u long, v long, n long"


def compare(s: Settings):
    """Rows sorted by (key, i, j): a bucket's blocks i and j. Counts (u, null, n) and edges (u, v, null)."""

    def meet(rows: list[dict]) -> tuple[list, list, list]:
        key, i, j = rows[0]["key"], rows[0]["i"], rows[0]["j"]
        cls = np.array([r["cls"] for r in rows])
        block = np.array([r["block"] for r in rows])
        weight = np.array([r["weight"] for r in rows])
        x = np.stack([np.frombuffer(r["unit"]) for r in rows])
        keys = np.array([r["keys"] for r in rows])
        table = int((keys[0] == key).argmax())
        if (keys[:, :table] == keys[0, :table]).all(0).any():  # all pairs meet in an earlier table
            return [], [], []
        linked = x @ x.T >= s.threshold
        np.fill_diagonal(linked, False)
        if i != j:
            linked &= block[:, None] != block[None, :]
        a, b = np.nonzero(linked)
        for lo in range(0, len(a), 1 << 16):
            p, q = a[lo : lo + (1 << 16)], b[lo : lo + (1 << 16)]
            first = (keys[p] == keys[q]).argmax(1)
            other = keys[p, first] != key
            linked[p[other], q[other]] = False
        n = linked.astype(np.int64) @ weight
        some = np.flatnonzero(n)
        u, v = stars(linked, cls)
        return [*cls[some].tolist(), *u], [*[None] * len(some), *v], [*n[some].tolist(), *[None] * len(u)]

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: tuple[list, list, list] = ([], [], [])
        for row in B.each(arrived):
            if held and (row["key"], row["i"], row["j"]) != (held[0]["key"], held[0]["i"], held[0]["j"]):
                for column, more in zip(out, meet(held), strict=True):
                    column += more
                held = []
                if len(out[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["u", "v", "n"])
                    out = ([], [], [])
            held.append(row)
        if held:
            for column, more in zip(out, meet(held), strict=True):
                column += more
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["u", "v", "n"])

    return run


def dedup(vectors: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Of each row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", number) & F.exists("embedding", lambda x: x != 0)
    v = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.when(F.coalesce(usable, F.lit(False)), v).alias("v"))
    rows = settle(rows.withColumn("cls", F.when(F.col("v").isNotNull(), F.xxhash64("label", F.size("v"), "v"))))
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = settle(classes)
    sizes = {r.dim: r.n for r in classes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}  # one for each length of vectors
    maps = {}
    for dim, n in sizes.items():
        sample = classes.where(F.size("v") == dim).orderBy(F.xxhash64("cls", F.lit(3))).limit(s.sample).select("v").collect()
        x = units(np.array([r.v for r in sample]))
        if len(x) < dim:  # too few vectors to learn from: any rotation
            x = np.concatenate([x, np.random.default_rng(s.seed).normal(size=(2 * dim, dim)) / math.sqrt(dim)])
        r, angle = near_mean(x, n, s)
        width, per_code, codes = plan(n, dim, s, angle)
        maps[dim] = (*rotations(x, dim, codes, s), width, per_code, r)
    keyed = settle(classes.select("cls", "weight", "label", "v").mapInArrow(signed(maps, s), "cls long, weight long, keys array<long>, unit binary"))
    each = keyed.select("cls", F.posexplode("keys").alias("table", "key"))
    name = F.xxhash64("cls", F.lit(13))
    buckets = each.groupBy("key").agg(F.min("table").alias("table"), F.count("*").alias("n"), F.bit_xor("cls").alias("x"), F.bit_xor(name).alias("y")).where("n > 1")
    # of buckets with the same classes the first table's one is kept: in the others no pair would be found first
    buckets = buckets.groupBy("n", "x", "y").agg(F.min(F.struct("table", "key")).alias("b")).select("b.key", F.ceil(F.col("n") / s.block).cast("int").alias("blocks"))
    members = each.select("cls", "key").join(buckets, "key").withColumn("block", F.pmod(F.xxhash64("cls", "key"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = members.select("key", "cls", "block", other).select("key", "cls", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    meeting = pairs.join(keyed.hint("merge"), "cls").repartition(partitions(vectors), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = settle(meeting.mapInArrow(compare(s), LINKS))
    counts = found.where("n is not null").groupBy(F.col("u").alias("cls")).agg(F.sum("n").alias("others"))
    part = components(found.where("v is not null").select("u", "v"))
    labelled = settle(classes.select("cls", "least", "weight").join(counts, "cls", "left").join(part.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "least", F.coalesce("component", "cls").alias("part"), (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    least = labelled.groupBy("part").agg(F.min("least").alias("component_id"))
    of = labelled.join(least, "part").select("cls", "n_links", "component_id")
    linked = rows.where("cls is not null").select("vec_id", "cls").join(of, "cls").select("vec_id", "n_links", "component_id")
    alone = rows.where("cls is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
