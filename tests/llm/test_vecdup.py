import math

import numpy as np
import pytest

from siltstone.llm import vecdup as V

SCHEMA = "vec_id long, embedding array<float>, label int, cls string"


def rows(dim=32):
    rng = np.random.default_rng(5)
    out = []
    unit = lambda x: (x / np.linalg.norm(x)).tolist()
    for k in range(600):
        out.append((unit(rng.normal(size=dim)), k % 3))
    for _ in range(120):
        base = rng.normal(size=dim)
        for _ in range(int(rng.integers(1, 4))):
            out.append((unit(base + rng.normal(scale=0.13, size=dim)), 1))
    hot = rng.normal(size=dim)
    out += [(unit(hot + rng.normal(scale=0.08, size=dim)), 2) for _ in range(150)]
    out += [(unit(hot), 2)] * 20 + [(unit(hot), None), (None, 2), ([0.0] * dim, 2), ([float("nan")] * dim, 2), ([None] + [1.0] * (dim - 1), 2), ([], 2), ([float("inf")] * dim, 2), ([1.0, 2.0], 2), ([2.0, 4.0], 2), (unit(hot), 1)]
    ids = rng.permutation(len(out)).tolist()
    return [(i, *r) for i, r in zip(ids, out, strict=True)]


def brute(data, threshold):
    good = [k for k, (_, e, b) in enumerate(data) if b is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    x = {k: (v := np.array(data[k][1], np.float32).astype(float)) / np.linalg.norm(v) for k in good}
    part, n = list(range(len(data))), [0] * len(data)

    def root(k):
        while part[k] != k:
            k = part[k]
        return k

    for a in good:
        for b in good:
            if a < b and data[a][2] == data[b][2] and len(x[a]) == len(x[b]) and x[a] @ x[b] >= threshold:
                n[a] += 1
                n[b] += 1
                part[root(a)] = root(b)
    least = {}
    for k, r in enumerate(data):
        least[root(k)] = min(least.get(root(k), r[0]), r[0])
    return {r[0]: (n[k], least[root(k)], least[root(k)] == r[0]) for k, r in enumerate(data)}


@pytest.mark.parametrize("block", [512, 20])
def test_matches_brute_force(spark, block):
    data = rows()
    df = spark.createDataFrame([(*r, "x") for r in data], SCHEMA).repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in V.dedup(df, V.Settings(block=block)).collect()}
    want = brute(data, 0.98)
    assert got.keys() == want.keys() and sum(w[0] for w in want.values()) > 5000
    found, all_ = sum(g[0] for g in got.values()), sum(w[0] for w in want.values())
    assert found >= 0.999 * all_ and all(got[k][0] <= want[k][0] for k in got)
    assert sum(got[k] == want[k] for k in got) >= 0.995 * len(got)


def test_vectors_with_a_common_mean(spark):
    """Pairs near the threshold around a mean cosine of 0.9."""
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x)
    mean, data = unit(rng.normal(size=64)), []
    for _ in range(1500):
        x = unit(0.9**0.5 * mean + 0.1**0.5 * unit(rng.normal(size=64)))
        y = unit(rng.normal(size=64))
        data += [x, unit(x + 0.19 * unit(y - (y @ x) * x))]
    x = np.array(data, np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = int((x @ x.T >= 0.98).sum()) - len(x)
    assert want >= 3000
    df = spark.createDataFrame([(k, v.tolist(), 1, "x") for k, v in enumerate(data)], SCHEMA)
    found = sum(r.n_links for r in V.dedup(df, V.Settings()).collect())
    assert 0.999 * want <= found <= want, (found, want)


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(4, [1.0, 0.0], 1, "x"), (4, [1.0, 0.0], 1, "x"), (3, [2.0, 0.0], 1, "x"), (None, [3.0, 0.0], 1, "x"), (9, [1.0, 1.0], 1, "x")], SCHEMA)
    got = sorted((tuple(r) for r in V.dedup(df).collect()), key=str)
    assert got == [(3, 3, 3, True), (4, 3, 3, False), (4, 3, 3, False), (9, 0, 9, True), (None, 3, 3, False)]
    assert V.dedup(df.limit(0)).count() == 0


def test_tables_follow_the_number_of_vectors():
    for n in (10, 10**4, 10**6, 10**9):
        width, per_code, codes = V.plan(n, 64, V.Settings())
        agree = (1 - math.acos(0.98) / math.pi) ** width
        assert (1 - agree) ** (per_code * codes) <= 1e-4 and width >= min(64, math.log2(n))


def test_angles_after_centring_decide_the_tables():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(4096, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r, angle = V.near_mean(x, 10**6, V.Settings())
    assert (np.linalg.norm(x - x.mean(0), axis=1) < r).mean() <= 0.1 and math.acos(0.98) <= angle < 0.21
    x = 0.5**0.5 * x[0] + 0.5**0.5 * x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r, angle = V.near_mean(x, 10**9, V.Settings())
    assert r < math.inf and angle >= math.asin(0.2 / r) - 1e-9 > math.acos(0.98)
    assert V.near_mean(np.tile(x[:1], (100, 1)), 10**6, V.Settings())[0] == math.inf


def test_very_small_and_very_large_components(spark):
    rng = np.random.default_rng(9)
    plain = rng.normal(size=(40, 4))
    close = plain + rng.normal(scale=0.01, size=plain.shape)
    data = [v.tolist() for v in plain] + [(v * 1e-200).tolist() for v in close[:20]] + [(v * 1e200).tolist() for v in close[20:]]
    data += [[5e-324, 0.0, 0.0, 0.0], [1.7e308, 1e300, -1.7e308, 0.0], [1.7e308, 1e300, -1.7e308, 0.0], [1.0, 0.0, 0.0, 0.0]]
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in enumerate(data)], SCHEMA.replace("float", "double"))
    got = {r.vec_id: r.component_id for r in V.dedup(df).collect()}
    x = V.units(np.array(data))
    want = list(range(len(data)))
    linked = x @ x.T >= 0.98
    for _ in range(len(data)):
        want = [min(want[j] for j in np.flatnonzero(linked[k])) for k in range(len(data))]
    assert got == dict(enumerate(want)) and all(want[40 + k] <= k for k in range(40)) and want[80] == want[83] and want[81] == want[82]


def test_a_tight_group_is_compared_once(spark):
    """Of the tables in which the group shares a bucket only one is dealt to tasks; all links are still found."""
    rng = np.random.default_rng(10)
    centre = rng.normal(size=16)
    data = [(k, (centre + rng.normal(scale=1e-4, size=16)).tolist(), 1, "x") for k in range(300)]
    data += [(1000 + k, rng.normal(size=16).tolist(), 1, "x") for k in range(300)]
    got = {r.vec_id: r.n_links for r in V.dedup(spark.createDataFrame(data, SCHEMA), V.Settings(block=64)).collect()}
    assert all(got[k] == 299 for k in range(300))
