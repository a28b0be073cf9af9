import hashlib
import os

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from siltstone.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = np.random.default_rng(2)
    out = ["", " ", "a", "Hello there, it's we'll 2024!!  \n\n x", "a" * 5000, " " * 3000 + "x", "ñandú übergröße 日本語テキスト 😀😀 ​", "<|endoftext|> x", "0" * 700, "\t\n\r\x0b" * 50, "!?" * 400, "antidisestablishmentarianism" * 30]
    alphabet = list("abcdeth io'sn\n 12.,!éß日😀")
    out += ["".join(rng.choice(alphabet, n)) for n in rng.integers(1, 200, 300)]
    return out


def test_tokens_are_the_librarys(ranks, library):
    v = bpe.Vocabulary(ranks)
    for t in texts():
        assert bpe.Encoding(v, P.PATTERN, t).tokens() == library.encode_ordinary(t), t[:80]
        assert v.decode(bpe.Encoding(v, P.PATTERN, t).tokens()) == t.encode()


def test_every_token_encodes_to_itself(ranks):
    v = bpe.Vocabulary(ranks)
    for k in np.random.default_rng(1).choice(len(ranks), 1500, replace=False):
        assert v.merge(v.bytes[int(k)]) == [int(k)] and bpe.Prefixes(v, v.bytes[int(k)]).last[-1] == k


def test_appends_and_edits(ranks, library):
    rng = np.random.default_rng(6)
    v = bpe.Vocabulary(ranks)
    parts = [t for t in texts() if t]
    e = bpe.Encoding(v, P.PATTERN)
    for t in parts[:20]:
        e.append(t)
        assert e.tokens() == library.encode_ordinary(e.text)
    for _ in range(150):
        a = int(rng.integers(0, len(e.text) + 1))
        b = min(len(e.text), a + int(rng.integers(0, 12)))
        e.edit(a, b, parts[int(rng.integers(len(parts)))][: int(rng.integers(0, 9))])
        assert e.tokens() == library.encode_ordinary(e.text)
    words = bpe.Encoding(v, P.PATTERN, "the quick brown fox " * 500)
    assert words.edit(5000, 5001, "zz") < 12
    for data in (b"internationalisation" * 40, b"a" * 900):
        p = bpe.Prefixes(v, data)
        p.edit(300, 305, b"xyzzy")
        assert p.last == bpe.Prefixes(v, data[:300] + b"xyzzy" + data[305:]).last
        grown = bpe.Prefixes(v, data[:7])
        grown.append(data[7:])
        assert grown.last == bpe.Prefixes(v, data).last
        p.append(b"tail")
        assert p.last == bpe.Prefixes(v, data[:300] + b"xyzzy" + data[305:] + b"tail").last


def test_table(spark, ranks, library):
    rows = [(k, t, "x") for k, t in enumerate(texts())] + [(None, None, None), (0, "", "y"), (0, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, bpe.encode(df, ranks, P.PATTERN).collect()), key=str)
    want = []
    for d, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.encode(df.limit(0), ranks, P.PATTERN).count() == 0
    assert os.path.exists(PATH)
