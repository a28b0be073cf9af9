import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from siltstone.llm import hmm as H
from siltstone.llm.common import fold

SMALL = H.Settings(states=3, frequent=6, classes=5, passes=3, block=4, every=2, batch=2000, shard=2000, fan=4)


def paths(m, seq):
    """Every path's joint probability with the sequence."""
    for path in itertools.product(range(len(m.start)), repeat=len(seq)):
        p = m.start[path[0]] * m.emit[seq[0], path[0]]
        for t in range(1, len(seq)):
            p *= m.move[path[t - 1], path[t]] * m.emit[seq[t], path[t]]
        yield path, p


def sequences():
    rng = np.random.default_rng(1)
    return [rng.integers(0, SMALL.symbols, n) for n in (1, 5, 3, 5, 2, 6)]


def test_forward_and_expected_counts_match_all_paths():
    """Some sequences are longer than a block."""
    m = H.Model.random(SMALL, np.arange(SMALL.symbols, dtype=float))
    got = H.likelihood(m, sequences(), SMALL)
    stats = np.zeros((SMALL.symbols + SMALL.states + 1, SMALL.states))
    want = np.zeros_like(stats)
    for k, seq in enumerate(sequences()):
        total = sum(p for _, p in paths(m, seq))
        assert got[k] == pytest.approx(math.log(total))
        for path, p in paths(m, seq):
            want[-1, path[0]] += p / total
            for t, z in enumerate(path):
                want[seq[t], z] += p / total
                if t:
                    want[SMALL.symbols + path[t - 1], z] += p / total
    H.expect(m, sequences(), stats, SMALL)
    assert np.allclose(stats, want)


def test_blocks_and_scalings_change_nothing():
    rng = np.random.default_rng(5)
    s = H.Settings(states=4, frequent=30, classes=9)
    m = H.Model.random(s, rng.integers(0, 1000, s.symbols).astype(float))
    data = [rng.integers(0, s.symbols, n) for n in (1, 300, 17, 300, 50, 299)]
    plain = np.zeros((s.symbols + s.states + 1, s.states))
    H.expect(m, data, plain, s)
    for block, every in ((16, 1), (50, 7), (299, 12)):
        other, t = np.zeros_like(plain), H.Settings(states=4, frequent=30, classes=9, block=block, every=every)
        H.expect(m, data, other, t)
        assert np.allclose(plain, other) and np.allclose(H.likelihood(m, data, s), H.likelihood(m, data, t))


def test_passes_raise_the_likelihood():
    rng = np.random.default_rng(0)
    data = [np.where(rng.random(40) < 0.9, 3 * (k % 2) + rng.integers(0, 3, 40), rng.integers(0, 12, 40)) for k in range(60)]
    m = H.Model.random(SMALL, np.ones(SMALL.symbols))
    last = -np.inf
    for _ in range(6):
        stats = np.zeros((SMALL.symbols + SMALL.states + 1, SMALL.states))
        now = H.likelihood(m, data, SMALL).sum()
        assert now > last - 1
        last = now
        H.expect(m, data, stats, SMALL)
        m = H.Model.of(stats, SMALL)


def rows():
    rng = np.random.default_rng(3)
    out = []
    for k in range(300):
        own = [f"{'abc'[k % 3]}{n}{'xyz'[k % 3]}" for n in range(40)]
        out.append((k, " ".join(rng.choice(own, int(rng.integers(1, 60))))))
    return out + [(300, None), (301, ""), (302, " \n\t"), (303, "A1X a1x Ä ä unheard"), (None, "a1x b2y"), (303, "A1X a1x Ä ä unheard"), (304, "b2y " * 3000)]


@pytest.mark.parametrize("s", [SMALL, H.Settings(batch=3000)])
def test_scores(spark, s):
    df = spark.createDataFrame([(d, t, 5, "x") for d, t in rows()], "doc_id long, text string, words int, held string").repartition(5)
    got = H.score(df, fold("doc_id", 5) == 1, s).collect()
    c = Counter(w for d, t in rows() if not held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), held(d), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 4)) for d, t in rows())
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    own = [r for r in got if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)
    assert all(r.score < 0 for r in got)


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 5 == 1


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def word_hash(word):
    """The operator's own name of a word; all else here is worked out anew."""
    return int(max(H.Words(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())]), 0, 1).hashes()[0], 1))


def word_class(word, classes):
    """A hash of the last three bytes."""
    out = 0
    for b in [*word.encode()[::-1][:3], None, None][:3]:
        out = (out * 1_000_003 + (0 if b is None else int(H.BYTE64[b]))) % 2**64
    return int(H.mix(np.array([out], np.uint64))[0] % np.uint64(classes))


def brute_scores(data, s):
    """The whole operator in plain steps: counts, symbols, passes and forward probabilities, one text at a time."""
    train = [tokens(t) for d, t in data if not held(d)]
    c = Counter(w for ws in train for w in ws)
    signed = lambda w: (word_hash(w) + 2**63) % 2**64 - 2**63
    top = sorted((w for w in c if w is not None), key=lambda w: (-c[w], signed(w)))[: s.frequent]
    names = {w: k for k, w in enumerate(sorted(top, key=word_hash))}
    mass = np.zeros(s.classes)
    for w, n in c.items():
        if w is not None and w not in names:
            mass[word_class(w, s.classes)] += n + 0.5
    symbol = lambda w: s.symbols - 1 if w is None else names.get(w, s.frequent + word_class(w, s.classes))
    counts = np.zeros(s.symbols)
    counts[: len(names)] = [c[w] for w in sorted(top, key=word_hash)]
    counts[s.frequent : s.frequent + s.classes] = mass
    counts[-1] = c[None]
    m = H.Model.random(s, counts)
    for _ in range(s.passes):
        stats = np.zeros((s.symbols + s.states + 1, s.states))
        for ws in train:
            o = [symbol(w) for w in ws]
            a, b = [m.start * m.emit[o[0]]], [np.ones(s.states)]
            a[0] /= a[0].sum()
            for k in o[1:]:
                v = (a[-1] @ m.move) * m.emit[k]
                a.append(v / v.sum())
            for k in o[:0:-1]:
                v = m.move @ (m.emit[k] * b[-1])
                b.append(v / v.sum())
            b.reverse()
            for t, k in enumerate(o):
                g = a[t] * b[t]
                stats[k] += g / g.sum()
                if t == 0:
                    stats[-1] += g / g.sum()
                else:
                    x = a[t - 1][:, None] * m.move * (m.emit[k] * b[t])[None, :]
                    stats[s.symbols : s.symbols + s.states] += x / x.sum()
        m = H.Model.of(stats, s)
    out = []
    for d, t in data:
        log, a = 0.0, None
        for w in tokens(t):
            a = (m.start if a is None else a @ m.move) * m.emit[symbol(w)]
            log += math.log10(a.sum())
            a = a / a.sum()
            if w is not None and w not in names:
                log += math.log10((c[w] + 0.5) / (mass[word_class(w, s.classes)] + 0.5))
        out.append((str(d), round(log, 5)))
    return sorted(out)


@pytest.mark.parametrize("s", [SMALL, H.Settings(states=4, frequent=20, classes=7, passes=2, batch=3000, shard=1500)])
def test_scores_equal_a_plain_computation(spark, s):
    data = [(d, t if d != 304 else "b2y " * 200) for d, t in rows()[200:]]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = sorted((str(r.doc_id), round(r.score, 5)) for r in H.score(df, fold("doc_id", 5) == 1, s).collect())
    assert [d for d, _ in got] == [d for d, _ in brute_scores(data, s)]
    assert np.allclose([x for _, x in got], [x for _, x in brute_scores(data, s)], atol=2e-5)


def test_probabilities_of_first_words_sum_to_one(spark):
    """A text's first token: every known word, one unseen word of each class, and the end. What follows is summed out, so
    the probabilities of the words alone are those of the texts divided by that of the end after them."""
    s = H.Settings(states=2, frequent=2, classes=4, passes=2)
    train = ["aa bb cc aa", "bb aa dd", "ee"]
    f = H.fit(spark.createDataFrame(list(enumerate(train)), "doc_id long, text string"), fold("doc_id", 5) == 7, s)
    c = Counter(w for t in train for w in t.split())
    first = lambda k: float(f.model.start @ f.model.emit[k])
    total = first(s.symbols - 1) + sum(first(k) for k in range(len(f.top)))
    frequent = {int(w) for w in f.top}
    for k in range(s.classes):
        within = [(c[w] + 0.5) / (f.mass[k] + 0.5) for w in c if word_hash(w) not in frequent and word_class(w, s.classes) == k]
        assert sum(within) + 0.5 / (f.mass[k] + 0.5) == pytest.approx(1)
        total += first(s.frequent + k) * (sum(within) + 0.5 / (f.mass[k] + 0.5))
    assert total == pytest.approx(1)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert H.score(df, fold("doc_id", 5) == 1).count() == 0
