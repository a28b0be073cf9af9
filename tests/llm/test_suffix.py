import numpy as np
import pytest

from siltstone.llm import suffix as S


def brute_order(text, depth):
    return [bytes(text[k : k + depth]) for k in range(len(text))]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 6, 7, 8, 30, 31, 32, 200, 1001])
@pytest.mark.parametrize("symbols", [1, 2, 4])
@pytest.mark.parametrize("depth", [2, 9, 50])
def test_suffix_array_orders_prefixes(n, symbols, depth):
    text = np.random.default_rng(n * 7 + symbols).integers(1, symbols + 1, n)
    order = S.suffix_array(text, depth)
    assert sorted(order.tolist()) == list(range(n))
    keys = brute_order(text.astype(np.uint8), depth)
    assert [keys[k] for k in order] == sorted(keys)


def brute(rows, length):
    """rows: (doc_id, text). (n_bytes, n_removed, n_spans, kept) of each."""
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            if d is not None:
                least[b[k : k + length]] = min(least.get(b[k : k + length], d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if d is not None and least[b[k : k + length]] < d:
                gone[k : k + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, kept))
    return out


def corpus():
    rng = np.random.default_rng(5)
    words = ["the", "of", "and", "thön", "tion", "er", "ñandú", "in", "re", "ti"]
    prose = lambda n: " ".join(rng.choice(words, n))
    passage, page = prose(40), prose(300)
    rows = [(k, f"{prose(20)} {passage} {prose(15)}") for k in range(40)]
    rows += [(k, page) for k in range(40, 60)]
    rows += [(k, page[: 400 + k] + prose(3) + page[380:]) for k in range(60, 75)]
    rows += [(75, None), (76, ""), (77, "short"), (78, "a" * 500), (79, "a" * 300), (80, "ab" * 400), (None, page), (81, prose(5000)), (81, page), (81, page), (82, prose(90) + passage[:50]), (83, passage[:49])]
    order = rng.permutation(len(rows))
    return [rows[k] for k in order]


@pytest.mark.parametrize("often", [2, 256])
def test_dedup_matches_brute_force(spark, often):
    import hashlib

    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = S.dedup(df, S.Settings(often=often), texts_too=True).collect()
    want = brute(rows, 50)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=key) == sorted(((*w[:4], hashlib.sha256(w[4]).hexdigest()) for w in want), key=key)
    assert sum(r.n_removed for r in got) > 0


def test_dedup_of_nothing_and_further_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, batch string, shard int")
    assert S.dedup(empty).count() == 0
    df = spark.createDataFrame([(1, "x" * 60, "u", 1), (2, "x" * 60, None, 2)], "doc_id long, text string, batch string, shard int")
    got = {r.doc_id: r for r in S.dedup(df, texts_too=True, keep=("batch", "shard")).collect()}
    assert got[1].kept_text == "x" * 60 and got[2].kept_text == "" and got[1].batch == "u" and got[2].shard == 2


def test_found_segments_are_not_written_as_bytes(spark):
    import string

    from pyspark.sql import functions as F

    from siltstone.llm import batches as B

    rng = np.random.default_rng(3)
    page = "".join(rng.choice(list(string.ascii_letters), 60000))
    corpus = B.batched(spark.createDataFrame([(1, page), (2, page[100:])], "doc_id long, text string").coalesce(1), size=1)
    found = S._candidates(corpus, 64, 4, S.Settings())
    written = found.select(sum(F.coalesce(F.octet_length(f.name), F.lit(0)) for f in found.schema.fields if f.dataType.simpleString() == "binary").alias("n")).agg(F.sum("n")).first()[0]
    texts = corpus.agg(F.sum(F.octet_length("texts"))).first()[0]
    assert 0 < written < texts, (written, texts)


def test_rounds_send_each_segment_once_and_match_brute_force(spark):
    import hashlib

    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    s = S.Settings(shard=256, rounds=3, together=2)
    assert S.rounds(1, s) == 1 and S.rounds(5, s) == 2 and S.rounds(100, s) == 3
    got = S.dedup(df, s).collect()
    want = brute(rows, 50)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in got), key=key) == sorted(((*w[:4], hashlib.sha256(w[4]).hexdigest()) for w in want), key=key)


def test_answers_take_bits_not_fingerprints():
    import pyarrow as pa

    prints = np.arange(0, 64 * 4000, 64, dtype=np.uint64)
    parts = dict(S.requests(prints, 64))
    assert list(parts) == [0] and parts[0].tolist() == prints.tolist()
    low = prints.view(np.uint8).reshape(-1, 8)[:, :6]
    t = pa.table({"shard": [0] * 3, "batch": [7, 8, 9], "prints": [low.tobytes(), low[::2].tobytes(), low[1:2].tobytes()]})
    got = S.answer(S.Settings(often=3))(t).to_pylist()
    assert [(r["batch"], r["shard"]) for r in got] == [(7, 0), (8, 0), (9, 0)]
    assert sum(len(r["common"]) + len(r["often"]) for r in got) <= 2 * 4000
    bits = lambda b, n: np.unpackbits(np.frombuffer(b, np.uint8), count=n).tolist()
    assert bits(got[0]["common"], 4000) == [1, 1] + [1, 0] * 1999 and bits(got[1]["common"], 2000) == [1] * 2000
    assert not any(bits(got[0]["often"], 4000)) and bits(got[2]["common"], 1) == [1]


def test_what_many_documents_have_alike_is_not_split_into_strings(spark):
    import string

    from siltstone.llm import batches as B

    rng = np.random.default_rng(4)
    letters = list(string.ascii_letters)
    page = "".join(rng.choice(letters, 3000))
    rows = [(k, "".join(rng.choice(letters, 200)) + page) for k in range(12)]
    corpus = B.batched(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), size=1)
    sent = lambda s: sum(len(B.unpack(r.counts, np.uint16)) for r in S._candidates(corpus, 4, 4, s).where("round >= 0").select("counts").collect())
    assert sent(S.Settings(often=2)) < 12 * 3000 / 5
    assert sent(S.Settings(often=2, heavy=2)) > 12 * 2900  # string by string


def test_requests_weigh_fingerprints_by_distinct_segments():
    import pyarrow as pa

    from siltstone.llm import batches as B

    rng = np.random.default_rng(6)
    passage = rng.integers(97, 123, 16).astype(np.uint8).tobytes()
    docs = [rng.integers(65, 91, 80).astype(np.uint8).tobytes() + passage * 6 + bytes(rng.integers(65, 91, 60).astype(np.uint8)) for _ in range(9)]
    docs += docs[:3]
    row = {"batch": 1, "ids": list(range(12)), "lengths": B.pack(np.array([len(x) for x in docs])), "texts": B.pack(np.frombuffer(b"".join(docs), np.uint8))}
    got = [r for b in S.request(3, S.Settings())(iter([pa.RecordBatch.from_pylist([row])])) for r in b.to_pylist()]
    weight = {p: n for r in got for p, n in zip(S.wide(r["prints"]).tolist(), B.unpack(r["weights"], np.uint32).tolist(), strict=True)}
    buf, offsets = np.frombuffer(b"".join(docs), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in docs])])
    want = {}
    for _, start, count, p, _ in zip(*S.fingerprints(buf, offsets, S.Settings()), strict=True):
        want.setdefault(int(p), set()).add(buf[start : start + count + 49].tobytes())
    assert weight == {p: len(x) for p, x in want.items()} and max(weight.values()) > 1


@pytest.mark.parametrize("heavy", [2, 1 << 14])
def test_dedup_by_strings_or_segments_matches_brute_force(spark, heavy):
    import hashlib

    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = S.dedup(df, S.Settings(often=2, heavy=heavy)).collect()
    want = brute(rows, 50)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in got), key=key) == sorted(((*w[:4], hashlib.sha256(w[4]).hexdigest()) for w in want), key=key)


def test_only_segments_with_recurring_strings_are_sorted(monkeypatch):
    import pyarrow as pa

    from siltstone.llm import batches as B

    rng = np.random.default_rng(8)
    prose = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes()
    gram, page = prose(16), prose(90)
    segments = [prose(34) + gram + prose(34) for _ in range(20)] + [page[:70], page[10:], prose(50) * 2]
    assert S.alike(segments, 50).tolist() == [False] * 20 + [True] * 3
    seen = []
    sort = S.smallest_documents
    monkeypatch.setattr(S, "smallest_documents", lambda x, *a: seen.extend(x) or sort(x, *a))
    docs = rng.permutation(len(segments))
    cells = (B.pack(np.array([len(x) for x in segments], np.uint32)), B.pack(docs.astype(np.int64)), B.pack(np.ones(len(segments), np.uint32)), S.zstd(b"".join(segments)))
    t = pa.Table.from_batches([S.columns([(1, 2, *cells)], S.SEGMENTS)])
    got = S.repeated(S.compare(S.Settings(), block=300)(t).column("least")[0].as_py())
    assert sorted(seen) == sorted(segments[20:])
    assert got.tolist() == np.concatenate(sort(segments, docs, 50)).tolist()
