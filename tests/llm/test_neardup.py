import re

import numpy as np
import pytest

from siltstone.llm import neardup as N

SCHEMA = "doc_id long, text string, batch string, idx int"


def shingle_set(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1)))


def brute(rows, percent=75):
    own = [shingle_set(t) for _, t in rows]
    part = list(range(len(rows)))

    def root(k):
        while part[k] != k:
            k = part[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if own[i] and own[j]:
                n = len(own[i] & own[j])
                if 100 * n >= percent * (len(own[i]) + len(own[j]) - n):
                    part[root(i)] = root(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[root(k)] = min(least.get(root(k), d), d)
    return sorted(((d, len(own[k]), least.get(root(k)), d == least.get(root(k))) for k, (d, _) in enumerate(rows)), key=str)


def corpus(seed=3, copies=120):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    prose = lambda n: list(rng.choice(vocabulary, n))
    rows, base = [], prose(160)
    for _ in range(copies):  # a large group of near copies, some of them too far from all others
        w = list(base)
        for k in rng.choice(160, rng.integers(0, 12), replace=False):
            w[k] = "x%d" % rng.integers(1e6)
        rows.append(" ".join(w))
    chain = prose(100)
    for k in range(6):  # a chain: each is linked to the next only
        rows.append(" ".join(chain[6 * k :] + prose(6 * k)))
    rows += [" ".join(base)] * 30 + [" ".join(base).upper()] + [" ".join(prose(int(n))) for n in rng.integers(1, 200, 60)]
    rows += [None, "", " \t\n", "one", "ONE", "one two", "two one", "a b c d", "a b c d", "a b c d e", "a b c d e f", "Ä b", "ä b", " ".join(prose(20000))]
    ids = rng.permutation(len(rows)).tolist()
    out = list(zip(ids, rows)) + [(ids[3], rows[3]), (ids[3], rows[3]), (None, rows[0]), (None, "alone with no id")]
    return [out[k] for k in rng.permutation(len(out))]


@pytest.mark.parametrize("block,pivots", [(256, 8), (16, 1), (16, 0)])
def test_matches_brute_force(spark, block, pivots):
    rows = corpus()
    df = spark.createDataFrame([(*r, None, 1) for r in rows], SCHEMA).repartition(6)
    got = N.dedup(df, N.Settings(block=block, pivots=pivots)).rows.select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == [(*r[:3], r[3] or r[0] is None and r[2] is None) for r in brute(rows)]


def test_survivors_keep_columns(spark):
    df = spark.createDataFrame([(5, "a b c d e f", "x", 1), (4, "a B c d e f", None, 2), (9, None, "z", None), (4, "a B c d e f", None, 2)], SCHEMA)
    r = N.dedup(df, keep=("doc_id", "batch", "idx"))
    got = N.survivors(r, SCHEMA, ["doc_id", "text", "batch", "idx"]).collect()
    assert sorted(map(tuple, got)) == [(4, "a B c d e f", None, 2), (9, "", "z", None)]


def test_empty_table(spark):
    assert N.dedup(spark.createDataFrame([], SCHEMA)).rows.count() == 0


def test_words_of_one_letter_pattern_have_names_of_their_own(spark):
    """Thue-Morse words and their complements agree in every polynomial hash modulo a power of two."""
    word = lambda n: "".join("ab"[bin(k).count("1") % 2] for k in range(n))
    texts = [t for n in (64, 512, 1024, 2048, 4096) for t in (word(n), word(n).translate(str.maketrans("ab", "ba")))]
    rows = [(k, t) for k, t in enumerate(texts)] + [(100, texts[6].upper())]
    got = {r.doc_id: r.component_id for r in N.dedup(spark.createDataFrame(rows, "doc_id long, text string")).rows.collect()}
    assert got == {**{k: k for k in range(len(texts))}, 100: 6}
