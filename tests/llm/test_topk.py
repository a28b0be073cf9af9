import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import topk as T

SCHEMA = "vec_id long, embedding array<float>, rank string"


def integer(x):
    """floor(64 x), exactly."""
    return math.floor(64 * Fraction(x))


def brute(rows, k):
    ok = [(d, [integer(float(np.float32(x))) for x in e]) for d, e in rows if d is not None and e and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for d, q in sorted({(d, tuple(q)) for d, q in ok if d % 20 == 0}):
        own = sorted(((-sum(a * b for a, b in zip(q, x)), v) for v, x in ok if v != d and len(x) == len(q)))[:k]
        out += [(d, n + 1, v, max(min(-score, 2**63 - 1), -(2**63)), str(-score)) for n, (score, v) in enumerate(own)]
    return sorted(out)


def rows():
    rng = np.random.default_rng(8)
    out = [(k, rng.normal(size=8).tolist()) for k in range(400)]
    same = rng.normal(size=8)
    out += [(400 + k, (same + rng.normal(scale=0.01, size=8)).tolist()) for k in range(150)]
    out += [(600 + k, same.tolist()) for k in range(60)]
    out += [(700, None), (720, []), (740, [1.0, None] + [0.0] * 6), (760, [float("nan")] * 8), (780, [float("inf")] * 8), (800, [0.0] * 8), (820, [1.0, 2.0]), (821, [2.0, 2.0]), (None, [9.0] * 8), (840, [1e6] * 8), (841, [-0.001] * 8), (842, rng.normal(size=8).tolist()), (842, rng.normal(size=8).tolist())]
    # large components: some scores leave 64 bits
    out += [(860, [4e7, 1.0]), (861, [4e7, -4e7]), (862, [3e38, 1.0]), (880, [-3e38, 3e38]), (881, [3e38, 3e38]), (900, [1.0, 1.0]), (901, [-3.3e38, 2e38])]
    out += [(920, out[20][1]), (920, out[20][1]), (940, out[0][1]), (940, out[1][1])]  # a query twice, and two of one id
    return out


@pytest.mark.parametrize("s", [T.Settings(), T.Settings(k=5, shard=64, block=7, leaf=8), T.Settings(k=3, shard=1000, block=100, leaf=4)])
def test_matches_brute_force(spark, s):
    df = spark.createDataFrame([(*r, "x") for r in rows()], SCHEMA).repartition(5)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score, r.score_text) for r in T.top_k(df, F.col("vec_id") % 20 == 0, s).collect())
    assert got == brute(rows(), s.k)


def test_bounds_prune():
    rng = np.random.default_rng(1)
    centres = rng.integers(-600, 600, (16, 8))
    x = (np.repeat(centres, 64, axis=0) + rng.integers(-5, 5, (1024, 8))) / 64
    tree = T.BallTree(x, 64)
    row = {"x": T.B.pack(x[tree.order]), "ids": T.B.pack(tree.order), **tree.arrays()}
    *_, compared = T.search(x[:50], np.arange(50), np.full(50, T.NONE), row, T.Settings(k=5))
    assert compared < 50 * 1024 / 3


def test_blocks_meet_few_shards(spark):
    """On clustered vectors most pairs of block and shard are dropped before a tree travels."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(32, 8)) * 10
    df = spark.createDataFrame([(k, (centres[k % 32] + rng.normal(scale=0.1, size=8)).tolist(), "x") for k in range(6400)], SCHEMA)
    tree, blocks, first, left = T.planned(df, F.col("vec_id") % 20 == 0, T.Settings(k=5, shard=200, block=10, leaf=50))
    assert first.count() == blocks.count() and left.count() < blocks.count() * tree.count() / 2


def test_a_hot_vector_is_dealt_to_several_shards(spark):
    df = spark.createDataFrame([(k, [1.0, 2.0] if k % 3 else [float(k), -1.0], "x") for k in range(900)], SCHEMA)
    s = T.Settings(k=4, shard=50, block=20, leaf=8)
    tree, *_ = T.planned(df, F.col("vec_id") % 20 == 0, s)
    assert max(len(T.B.unpack(r.ids, np.int64)) for r in tree.collect()) < 150
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score, r.score_text) for r in T.top_k(df, F.col("vec_id") % 20 == 0, s).collect())
    assert got == brute([(r.vec_id, r.embedding) for r in df.collect()], 4)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(20, [1.0], "x"), (21, [2.0], "x")], SCHEMA)
    assert [tuple(r) for r in T.top_k(df, F.col("vec_id") % 20 == 0).collect()] == [(20, 1, 21, 64 * 128, str(64 * 128))]
    assert T.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
