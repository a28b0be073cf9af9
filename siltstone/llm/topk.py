"""Exact top-k by inner product: ball trees, branch and bound.

Vectors are taken as floor(64 * x), x as double, and compared by integer inner product. The vectors are dealt to shards of
about ``shard`` vectors, and each shard is a ball tree (halves along the widest dimension, down to ``leaf`` vectors). For
a query q a node with centre c and radius r holds no score above q.c + |q| r. Nodes are taken in order of that bound, and
the search ends at the first one below the current k-th score. Every block of queries first searches one shard, of the cell whose centre
scores highest for it;
the k-th scores found there are shared with the searches of all other shards, which prune by them from the start, and go
on to share theirs with the shards that the same task searches next.

How it is distributed. The same halving on a sample of at most ``sample`` vectors cuts the space into at most ``cells``
cells; every vector goes to its cell by the cuts, and a cell of many vectors, as of one hot vector, is dealt to shards by
a hash. Queries are dealt alike, so that a block's queries are neighbours. The cells' balls, a bounded number, are
broadcast: after the first search a block only meets the shards of cells whose bound reaches one of its k-th scores, and
no other tree travels to it. Blocks and trees meet in tasks of fixed size and return at most ``k`` rows a query.

Nulls and edges: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows with a null
id; vectors of different lengths are not compared; a query's own row is every row with its id; ties go to the smaller id,
and repeated rows are returned each; a repeated query is one query, and queries of one id with different vectors are
answered each; with fewer than k others all are returned; further columns are ignored. Components may be of any size:
beyond what 64-bit integers hold, products are Python's exact integers, the order is that of the exact scores,
``score`` is the nearest 64-bit integer and ``score_text`` has all digits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from . import batches as B
from .common import settle

RESULT = "query_id long, same long, vec_id long, score long, wide string"
#: The number below every score; no score is there yet.
NONE = -(1 << 63)
MOST = (1 << 63) - 1


@dataclass(frozen=True)
class Settings:
    k: int = 20
    shard: int = 4096
    block: int = 512
    leaf: int = 128
    #: Cells of the space, at most, and vectors from which the cuts between them are learned, at most.
    cells: int = 8192
    sample: int = 65_536


# ---------------------------------------------------------------- numbers


def whole(x: np.ndarray) -> np.ndarray:
    """floor(64 x) / 64, a double for every double."""
    with np.errstate(over="ignore"):
        y = np.floor(64 * x) / 64
    return np.where(np.abs(x) < 2.0**52, y, x)


def exact(x: np.ndarray) -> np.ndarray:
    """64 x as Python's integers."""
    return np.array([int(v) * 64 if abs(v) >= 2.0**52 else int(64 * v) for v in x.ravel()], object).reshape(x.shape)


def is_wide(q: np.ndarray, x: np.ndarray) -> bool:
    """Whether a score, or a part of it, could leave 64 bits."""
    most = np.longdouble(np.abs(q).max(initial=0)) * np.longdouble(np.abs(x).max(initial=0))
    return bool(most * q.shape[1] * 4096 >= 2.0**62)


def dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of 64 q and 64 x: in floating point where that is exact, else in integers."""
    if is_wide(q, x):
        return exact(q).dot(exact(x).T)
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] * 4096
    for limit, kind in ((1 << 24, np.float32), (1 << 53, np.float64)):
        if most < limit:
            return ((64 * q).astype(kind) @ (64 * x).astype(kind).T).astype(np.int64)
    return (64 * q).astype(np.int64) @ (64 * x).astype(np.int64).T


def wide_text(n: int) -> str | None:
    """All digits of a number beyond 64 bits, behind a key that is in the numbers' order; None for others."""
    if NONE < n <= MOST:
        return None
    digits = str(abs(n))
    key = f"p{len(digits):05d}{digits}" if n > 0 else f"n{99999 - len(digits):05d}" + "".join(str(9 - int(d)) for d in digits)
    return f"{key}:{n}"


def upper(q: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Above every score of each query with the points of each ball, rounding errors included."""
    if max(np.abs(a).max(initial=0) for a in (q, centre, radius)) > 1e140:  # whose products leave the range of doubles
        q, centre, radius = (a.astype(np.longdouble) for a in (q, centre, radius))
    size = np.sqrt((q * q).sum(1))[:, None]
    far = np.sqrt((centre * centre).sum(1)) + radius
    return 4096 * (q @ centre.T + size * radius + 1e-12 * size * far) + 1e-3


def reaches(bound: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether a bound reaches a k-th score, of whatever kind of integer."""
    some = least.astype(np.longdouble)
    return (bound >= some - 1e-15 * np.abs(some)) | (least <= NONE)


# ---------------------------------------------------------------- trees


def ball(x: np.ndarray) -> tuple[np.ndarray, float]:
    scale = max(1.0, float(np.abs(x).max(initial=0)))
    own = x / scale
    centre = own.mean(0)
    return centre * scale, float(np.sqrt(((own - centre) ** 2).sum(1)).max()) * scale * (1 + 1e-12)


class BallTree:
    """Nodes as arrays: centre, radius, parent, and for a leaf the range of its vectors."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.order = np.arange(len(x))
        self.centre, self.radius, self.parent, self.range = [], [], [], []
        todo = [(0, len(x), -1)]
        while todo:
            a, b, parent = todo.pop()
            own = x[self.order[a:b]]
            node = len(self.centre)
            centre, radius = ball(own)
            self.centre.append(centre)
            self.radius.append(radius)
            self.parent.append(parent)
            self.range.append((a, b) if b - a <= leaf else None)
            if b - a > leaf:
                widest = int((own.max(0) / 2 - own.min(0) / 2).argmax())
                mid = (a + b) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, widest], mid - a)]
                todo += [(a, mid, node), (mid, b, node)]

    def arrays(self) -> dict[str, bytes]:
        leaf = np.array([r or (-1, -1) for r in self.range], np.int64)
        return {"centre": B.pack(np.array(self.centre)), "node": B.pack(np.column_stack([np.array(self.parent, np.int64), leaf])), "radius": B.pack(np.array(self.radius))}


class Cuts:
    """The cells of the space: halves of a sample along the widest dimension, as a binary tree of (dimension, value)."""

    def __init__(self, x: np.ndarray, cells: int):
        depth = max(0, int(np.log2(max(1, min(cells, len(x) // 8)))))
        self.depth = depth
        self.dim, self.value = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
        parts = [x]
        for level in range(depth):
            after = []
            for k, own in enumerate(parts):
                node = (1 << level) - 1 + k
                if len(own):
                    d = int((own.max(0) / 2 - own.min(0) / 2).argmax())
                    v = float(np.partition(own[:, d], (len(own) - 1) // 2)[(len(own) - 1) // 2])
                    self.dim[node], self.value[node] = d, v
                    right = own[:, d] > v
                    after += [own[~right], own[right]]
                else:
                    after += [own, own]
            parts = after

    def cell(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.dim[node]] > self.value[node])
        return node - ((1 << self.depth) - 1)


def search(q: np.ndarray, ids: np.ndarray, least: np.ndarray, row: dict, s: Settings) -> tuple[np.ndarray, np.ndarray, list, int]:
    """The best k of a shard for each query that reach ``least``, which rises to the k-th score found. Also the number of
    vectors compared."""
    x, own = B.unpack(row["x"], np.float64).reshape(-1, q.shape[1]), B.unpack(row["ids"], np.int64)
    centre, node, radius = B.unpack(row["centre"], np.float64).reshape(-1, q.shape[1]), B.unpack(row["node"], np.int64).reshape(-1, 3), B.unpack(row["radius"], np.float64)
    wide = is_wide(q, x)
    bound = upper(q, centre, radius)
    for n, parent in enumerate(node[:, 0]):
        if parent >= 0:  # parents come before their children
            np.minimum(bound[:, n], bound[:, parent], out=bound[:, n])
    leaves = np.flatnonzero(node[:, 1] >= 0)
    bound = bound[:, leaves]
    order = np.argsort(-bound, axis=1)
    none = -(1 << 4000) if wide else -(1 << 62)  # below all scores that these numbers can make
    kind = object if wide else np.int64
    top = np.full((len(q), s.k), none, kind)
    floor = np.array([none if v == NONE else max(v, none) for v in least.tolist()], kind)
    found: list[tuple[np.ndarray, ...]] = []
    alive, compared = np.arange(len(q)), 0
    for step in range(len(leaves)):
        at = order[alive, step]
        going = reaches(bound[alive, at], floor[alive]) | (floor[alive] == none).astype(bool)
        alive, at = alive[going], at[going]  # bounds only fall from here on
        if not len(alive):
            break
        for leaf in np.unique(at):
            who = alive[at == leaf]
            a, b = node[leaves[leaf], 1:]
            score = dots(q[who], x[a:b]).astype(kind)
            compared += score.size
            score[ids[who][:, None] == own[a:b][None, :]] = none
            i, j = np.nonzero((score >= floor[who][:, None]) & (score > none))
            found.append((who[i], own[a:b][j], score[i, j]))
            best = np.concatenate([top[who], score], axis=1)
            top[who] = np.sort(best, axis=1)[:, -s.k :] if wide else (-np.partition(-best, s.k - 1, axis=1)[:, : s.k] if best.shape[1] > s.k else best)
            floor[who] = np.maximum(floor[who], top[who].min(1))
    # shared as 64-bit numbers; one below them is no bound at all, one above them a weaker bound
    least[:] = [old if v == none else max(old, NONE if v < -MOST else min(v, MOST)) for v, old in zip(floor.tolist(), least.tolist(), strict=True)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), [], compared
    who, vec, score = (np.concatenate(c) for c in zip(*found, strict=True))
    keep = (score >= floor[who]).astype(bool)
    who, vec, score = who[keep], vec[keep], score[keep]
    rank = np.unique(-score, return_inverse=True)[1] if len(score) else score
    order = np.lexsort((vec, rank, who))
    who, vec, score = who[order], vec[order], score[order]
    first = np.searchsorted(who, who)
    keep = np.arange(len(who)) - first < s.k
    return who[keep], vec[keep], score[keep].tolist(), compared


# ---------------------------------------------------------------- over the table


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, dim, v): the vectors that take part, as doubles."""
    fine = F.forall(F.col(column), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    return vectors.where(F.col("vec_id").isNotNull() & F.col(column).isNotNull() & (F.size(column) > 0)).where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.size(column).alias("dim"), v.alias("v"))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def learned(rows: DataFrame, s: Settings) -> dict[int, Cuts]:
    """The cuts for each length of vectors."""
    out = {}
    for dim, n in [(r.dim, r.n) for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()]:  # one for each length
        cells = min(s.cells, -(-n // s.shard))
        sample = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id").limit(min(s.sample, 64 * cells)).select("v").collect() if cells > 1 else []
        out[dim] = Cuts(whole(np.array([r.v for r in sample]).reshape(-1, dim)), cells)
    return out


def placed(rows: DataFrame, cuts: dict[int, Cuts]) -> DataFrame:
    """The rows with their vector as floor(64 x) / 64 and its cell."""
    shared = rows.sparkSession.sparkContext.broadcast(cuts)

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrived:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = b.take(pa.array(np.flatnonzero(dims == dim)))
                x = whole(matrix(own.column("v"), int(dim))) + 0.0
                cell = shared.value[int(dim)].cell(x)
                yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("dim"), pa.array(cell), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "dim", "cell", "x"])

    return rows.mapInArrow(run, "vec_id long, dim int, cell long, x binary")


PACKED = "dim int, cell long, part long, ids binary, x binary, centre binary, node binary, radius binary"


def packed(rows: DataFrame, size: int, leaf: int | None) -> DataFrame:
    """The rows of each cell in parts of about ``size``, as trees if ``leaf`` is given."""
    parts = rows.groupBy("dim", "cell").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))

    def run(t: pa.Table) -> pa.Table:
        dim = t.column("dim")[0].as_py()
        x = np.frombuffer(b"".join(t.column("x").to_pylist())).reshape(-1, dim)
        ids = t.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        cells = dict.fromkeys(("centre", "node", "radius"), b"")
        if leaf:
            tree = BallTree(x, leaf)
            ids, x, cells = ids[tree.order], x[tree.order], tree.arrays()
        row = [t.column(c)[:1] for c in ("dim", "cell", "part")] + [pa.array([v], pa.binary()) for v in (B.pack(ids), B.pack(x), *cells.values())]
        return pa.table(row, ["dim", "cell", "part", "ids", "x", "centre", "node", "radius"])

    # a row for each cell of each length of vectors: at most ``cells`` for a length
    part = (F.col("cell") * F.lit(1 << 32) + F.pmod(F.xxhash64("vec_id", F.lit(5)), F.col("parts"))).alias("part")
    return settle(rows.join(F.broadcast(parts), ["dim", "cell"]).select("dim", "cell", part, "vec_id", "x").groupBy("dim", "cell", "part").applyInArrow(run, PACKED))


def _searching(s: Settings, back: bool):
    """Rows of (block, tree); with ``back``, the k-th scores of the block are returned with the results."""

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared: dict[tuple[int, int], np.ndarray] = {}
        for row in B.each(arrived):
            ids = B.unpack(row["q_ids"], np.int64)
            q = B.unpack(row["q_x"], np.float64).reshape(-1, row["dim"])
            same = np.array([int.from_bytes(hashlib.blake2b(r.tobytes(), digest_size=8).digest(), "little", signed=True) for r in q], np.int64)
            key = (row["dim"], row["block"])
            least = np.frombuffer(row["least"], np.int64).copy() if row.get("least") else np.full(len(ids), NONE)
            if key in shared:
                least = np.maximum(least, shared[key])
            who, vec, score, _ = search(q, ids, least, row, s)
            shared[key] = least
            wide = [wide_text(v) for v in score]
            score = np.array([min(max(v, NONE), MOST) for v in score], np.int64)
            if back:
                some = "\n".join(w or "" for w in wide)
                columns = [pa.array([c], pa.binary()) for c in (ids[who].tobytes(), same[who].tobytes(), vec.tobytes(), score.tobytes(), some.encode(), least.tobytes())]
                columns = [pa.array([row["dim"]], pa.int32()), pa.array([row["block"]], pa.int64()), *columns]
                labels = ["dim", "block", "query_id", "same", "vec_id", "score", "wide", "least"]
            else:
                columns = [pa.array(ids[who]), pa.array(same[who]), pa.array(vec), pa.array(score), pa.array(wide, pa.string())]
                labels = ["query_id", "same", "vec_id", "score", "wide"]
            yield pa.RecordBatch.from_arrays(columns, labels)

    return run


def _unpacked(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in B.each(arrived):
        own = [pa.array(np.frombuffer(row[c], np.int64)) for c in ("query_id", "same", "vec_id", "score")]
        wide = row["wide"].decode().split("\n") if len(own[0]) else []
        yield pa.RecordBatch.from_arrays([*own, pa.array([w or None for w in wide], pa.string())], ["query_id", "same", "vec_id", "score", "wide"])


def _balls(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each tree's root."""
    for row in B.each(arrived):
        centre, radius = B.unpack(row["centre"], np.float64)[: row["dim"]], float(B.unpack(row["radius"], np.float64)[0])
        yield pa.RecordBatch.from_arrays([pa.array([row["dim"]], pa.int32()), pa.array([row["cell"]]), pa.array([row["part"]]), pa.array([centre.tobytes()], pa.binary()), pa.array([radius])], ["dim", "cell", "part", "centre", "radius"])


def _around(t: pa.Table) -> pa.Table:
    """A ball around some balls of a cell: about their first centre."""
    c = np.stack([np.frombuffer(x.as_py()) for x in t.column("centre")]).astype(np.longdouble)
    r = (np.sqrt(((c - c[0]) ** 2).sum(1)) + t.column("radius").to_numpy()).max()
    return pa.table([t.column("dim")[:1], t.column("cell")[:1], t.column("part")[:1], t.column("centre")[:1], pa.array([float(r) * (1 + 1e-12)])], ["dim", "cell", "part", "centre", "radius"])


def cells_of(roots: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of vectors the cells and their balls; at most ``cells`` of each."""
    some = roots.withColumn("part", F.pmod("part", F.lit(256))).groupBy("dim", "cell", "part").applyInArrow(_around, BALL)
    cells = some.groupBy("dim", "cell").applyInArrow(_around, BALL).collect()
    out = {}
    for d in {r.dim for r in cells}:
        own = [r for r in cells if r.dim == d]
        out[d] = (np.array([r.cell for r in own]), np.stack([np.frombuffer(r.centre) for r in own]), np.array([r.radius for r in own]))
    return out


BALL = "dim int, cell long, part long, centre binary, radius double"
CHOSEN = "dim int, block long, cell long"


def _choosing(shared, nearest: bool):
    """The cells for each block: the one whose centre scores highest on average, or all that reach a k-th score."""

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.each(arrived):
            q = B.unpack(row["q_x"], np.float64).reshape(-1, row["dim"])
            cell, centre, radius = shared.value[row["dim"]]
            if nearest:
                scale = max(1.0, float(np.abs(q).max()), float(np.abs(centre).max()))
                chosen = cell[[int(((q / scale).mean(0) @ (centre / scale).T).argmax())]]
            else:
                least, open_ = np.frombuffer(row["least"], np.int64), np.zeros(len(cell), bool)
                for a in range(0, len(q), 64):
                    open_ |= reaches(upper(q[a : a + 64], centre, radius), least[a : a + 64, None]).any(0)
                chosen = cell[open_]
            n = len(chosen)
            yield pa.RecordBatch.from_arrays([pa.array([row["dim"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int64()), pa.array(chosen)], ["dim", "block", "cell"])

    return run


def planned(vectors: DataFrame, queries: Column, s: Settings) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Trees, blocks of queries, the results of each block's first search, and the pairs of block and shard left to search."""
    rows = settle(usable(vectors))
    cuts = learned(rows, s)
    at = settle(placed(rows, cuts))
    trees = packed(at, s.shard, s.leaf)
    blocks = packed(at.where(queries).distinct(), s.block, None).select("dim", F.col("part").alias("block"), F.col("ids").alias("q_ids"), F.col("x").alias("q_x"))
    roots = settle(trees.select("dim", "cell", "part", "centre", "radius").mapInArrow(_balls, BALL))
    shared = trees.sparkSession.sparkContext.broadcast(cells_of(roots))
    shards = roots.select("dim", "cell", "part").withColumn("n", F.row_number().over(_window("dim", "cell", "part")) - 1).withColumn("shards", F.count("*").over(_window("dim", "cell")))
    home = blocks.select("dim", "block", "q_x").mapInArrow(_choosing(shared, True), CHOSEN).join(shards, ["dim", "cell"]).where(F.col("n") == F.pmod(F.xxhash64("block"), F.col("shards"))).select("dim", "block", "part")
    home = settle(home)
    tree = trees.select("dim", "part", "ids", "x", "centre", "node", "radius")
    schema = "dim int, block long, query_id binary, same binary, vec_id binary, score binary, wide binary, least binary"
    first = settle(blocks.join(home.hint("merge"), ["dim", "block"]).join(tree.hint("merge"), ["dim", "part"]).mapInArrow(_searching(s, True), schema))
    open_ = blocks.join(first.select("dim", "block", "least").hint("merge"), ["dim", "block"]).mapInArrow(_choosing(shared, False), CHOSEN)
    left = settle(open_.join(roots.select("dim", "cell", "part"), ["dim", "cell"]).select("dim", "block", "part").join(home, ["dim", "block", "part"], "left_anti"))
    return tree, blocks, first, left


def _window(dim: str, cell: str, *order: str) -> WindowSpec:
    w = Window.partitionBy(dim, cell)
    return w.orderBy(*order) if order else w


def top_k(vectors: DataFrame, queries: Column, s: Settings = Settings()) -> DataFrame:
    """For each row of ``vectors`` (vec_id, embedding) that meets the condition ``queries`` on its id, its k highest scores
    among all other rows: query_id, rank, vec_id, score, score_text."""
    tree, blocks, first, left = planned(vectors, queries, s)
    second = blocks.join(first.select("dim", "block", "least").hint("merge"), ["dim", "block"]).join(left.hint("merge"), ["dim", "block"]).join(tree.hint("merge"), ["dim", "part"]).mapInArrow(_searching(s, False), RESULT)
    found = first.select("query_id", "same", "vec_id", "score", "wide").mapInArrow(_unpacked, RESULT).union(second)
    return ranked(found, s.k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id", "same").orderBy(F.desc("score"), F.desc_nulls_last(F.substring_index("wide", ":", 1)), "vec_id")
    text = F.coalesce(F.substring_index("wide", ":", -1), F.col("score").cast("string"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", text.alias("score_text"))
