import numpy as np
import pytest

from siltstone.llm.graph import components


def brute(edges):
    part = {}

    def root(k):
        part.setdefault(k, k)
        while part[k] != k:
            k = part[k]
        return k

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = root(u), root(v)
            part[max(a, b)] = min(a, b)
    return {k: root(k) for k in part}


@pytest.mark.parametrize("kind", ["path", "star", "random", "empty"])
def test_components(spark, kind):
    rng = np.random.default_rng(3)
    names = rng.permutation(5000).tolist()
    edges = {
        "path": [(names[k], names[k + 1]) for k in range(200)],
        "star": [(names[0], names[k]) for k in range(1, 400)] + [(names[1000], names[1001]), (7, 7), (None, 3)],
        "random": [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))],
        "empty": [],
    }[kind]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == brute(edges)
