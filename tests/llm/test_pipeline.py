import numpy as np
import pytest

import corpus_pipeline as P
from siltstone.llm import packing, quality

from . import test_neardup, test_pii, test_suffix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", f"s{(d or 0) % 3}", None if t is None else len(t)) for d, t in rows], SCHEMA).repartition(3)


def prose(rng, n):
    return " ".join(rng.choice([f"word{k}" for k in range(500)], n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(9)
    good = [(k, prose(rng, 80)) for k in range(80)]
    bad = [(100 + k, " ".join(f"{w.upper()}!!" for w in prose(rng, 60).split())) for k in range(40)]
    extra = [(200, good[3][1] + " word1"), (201, good[4][1]), (202, prose(rng, 30) + " " + good[5][1][:200] + " " + prose(rng, 30)), (203, prose(rng, 40) + " mail a.b@c.example.com " + prose(rng, 40)), (204, None), (205, "")]
    path = str(tmp_path_factory.mktemp("sf"))
    frame(spark, good + bad + extra).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, int(d < 100), 0) for d, _ in (good + bad)[::2]], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_are_in_order_and_run_gives_the_last(spark, folder):
    assert [n for n, _ in P.STAGES] == ["quality", "neardup", "passages", "pii", "packing"]
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == P.COLUMNS
        kept.append({r.doc_id: r for r in docs.collect()})
    assert all(d not in kept[0] for d in range(100, 140)) and all(d in kept[0] for d in range(80)) and 200 in kept[0]
    assert {200, 201} & kept[1].keys() == set() and {3, 4, 202} <= kept[1].keys()
    assert len(kept[2][202].text) < len(kept[1][202].text) - 150 and kept[2][202].n_chars == len(kept[2][202].text)
    assert "a.b@c" in kept[2][203].text and "<email>" in kept[3][203].text and kept[3].keys() == kept[2].keys()
    out = P.run(spark, folder).collect()
    assert {r.doc_id for r in out} == kept[3].keys()


def test_quality_stage_without_labels_of_a_kind(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert P.quality_stage(spark, docs.limit(0), folder).count() == 0


def test_neardup_stage_keeps_one_of_each_group(spark):
    rows = [r for r in test_neardup.corpus(copies=40) if r[0] is not None]
    rows = list({d: (d, t) for d, t in rows}.values())
    want = {d for d, _, _, kept in test_neardup.brute(rows) if kept or not test_neardup.shingle_set(dict(rows)[d])}
    assert {r.doc_id for r in P.neardup_stage(spark, frame(spark, rows), "").collect()} == want


def test_passages_stage_keeps_what_brute_force_keeps(spark):
    rows = [r for r in test_suffix.corpus() if r[0] is not None]
    rows = list({d: (d, t) for d, t in rows}.values())
    want = {d: kept.decode("utf-8", "ignore") for d, _, removed, _, kept in test_suffix.brute(rows, 50) if not (removed and not kept.decode("utf-8", "ignore").strip(" "))}
    assert {r.doc_id: r.text for r in P.passages_stage(spark, frame(spark, rows), "").collect()} == want


def test_pii_stage_leaves_no_base_span(spark):
    rows = [(k, t) for k, t in enumerate(test_pii.texts()) if t is None or len(t) < 400]
    got = {r.doc_id: r.text for r in P.pii_stage(spark, frame(spark, rows), "").collect()}
    assert got.keys() == {k for k, _ in rows}
    for k, t in rows:
        if not test_pii.brute(t):
            assert got[k] == t
        else:
            assert all(t[a:b] not in got[k] or t.count(t[a:b]) > 1 for kind, a, b in test_pii.brute(t) if kind == "email")


def bins(rows):
    out = {}
    for r in rows:
        out.setdefault(r["bin"], []).append(r)
    return out


@pytest.mark.parametrize("group_rows", [20_000, 100])
def test_packing(spark, group_rows):
    rng = np.random.default_rng(3)
    s = packing.Settings(capacity=1000, per_source=2, group_rows=group_rows)
    same = "x" * 300
    rows = [(k, "y" * int(n)) for k, n in enumerate(rng.integers(0, 700, 300))] + [(1000 + k, same) for k in range(60)] + [(2000, "z" * 3500), (2001, None), (None, "n" * 10), (5, "y" * 20)]
    got = packing.pack(frame(spark, rows), s).collect()
    assert sum(r.piece_length for r in got) == sum(len(t or "") for _, t in rows)
    for name, own in bins(got).items():
        if name is None:
            assert all(r.piece_length == 0 for r in own)
            continue
        own.sort(key=lambda r: r.bin_offset)
        assert [r.bin_offset for r in own] == list(np.cumsum([0] + [r.piece_length for r in own[:-1]])) and sum(r.piece_length for r in own) <= 1000
        assert sum((r.doc_id or 0) in range(1000, 1060) for r in own) <= 1
        assert all(n <= 2 for n in np.unique([r.source for r in own], return_counts=True)[1])
    assert sorted((r.piece, r.piece_length) for r in got if r.doc_id == 2000) == [(0, 1000), (1, 1000), (2, 1000), (3, 500)]
    assert packing.pack(frame(spark, rows).limit(0), s).count() == 0


@pytest.mark.parametrize("sources", [3, 1, 40])
def test_packing_takes_the_tightest_compatible_bin(sources):
    """Every item's bin and offset, against a search through all bins."""
    rng = np.random.default_rng(4)
    s = packing.Settings(capacity=100, per_source=2)
    rows = [(k, f"s{rng.integers(sources)}" if k % 5 else None, int(rng.integers(1, 250)) if k % 3 else 30, int(rng.integers(40)) if k % 7 else None) for k in range(500)]
    rows += [(600 + k, f"s{k % 2}", 30, 7) for k in range(60)] + [(700, None, 0, 3), (None, "s0", 30, None)]
    left, used, want, full = [], [], [], 0
    for d, source, n, cluster in sorted(rows, key=packing.order(s)):
        if not n:
            want.append((d, source, 0, 0, None, None))
            continue
        for p in range(n // 100):
            want.append((d, source, p, 100, f"g-f{full}", 0))
            full += 1
        rest = n % 100
        if not rest:
            continue
        fit = [(left[b], b) for b in range(len(left)) if left[b] >= rest and (cluster is None or cluster not in used[b][0]) and (source is None or used[b][1].count(source) < 2)]
        if not fit:
            left.append(100)
            used.append((set(), []))
            fit = [(100, len(left) - 1)]
        b = min(fit)[1]
        want.append((d, source, n // 100, rest, f"g-{b}", 100 - left[b]))
        left[b] -= rest
        used[b][0].add(cluster)
        used[b][1].append(source)
    assert packing.pack_group(rows, s, "g") == want


def test_packing_of_one_hot_source_and_cluster_is_not_quadratic():
    import time

    rows = [(k, "hot", 40, k % 3 and 5) for k in range(20_000)]
    began = time.perf_counter()
    packing.pack_group(rows, packing.Settings(capacity=1000, per_source=2), "g")
    assert time.perf_counter() - began < 30


def test_packing_stage_equals_the_operator_over_all_groups(spark):
    """The stage's rows, against a plain packing of each hash group; clashing names and nulls in all columns."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(12)
    rows = [(k, "t" * int(rng.integers(0, 9000)), "en", f"s{k % 4}", 1, k, "x", "y") for k in range(300)] + [(None,) * 8] * 3
    df = spark.createDataFrame(rows, SCHEMA + ", grp int, length string, cluster string").repartition(3)
    got = sorted(map(str, P.packing_stage(spark, df, "").collect()))
    kind = F.xxhash64(F.regexp_replace(F.lower("text"), r"\s+", " "))
    items = [tuple(r) for r in df.select("doc_id", "source", F.coalesce(F.octet_length("text"), F.lit(0)), F.when(F.col("text").isNotNull(), kind)).collect()]
    plain = packing.pack_group(items, packing.Settings(), "g0")
    assert got == sorted(str(r) for r in spark.createDataFrame(plain, packing.SCHEMA).collect())


def brute_quality(text, model):
    """The score of one text from the model, feature by feature."""
    s = model.settings
    ((ids, share),) = quality.bags([text or ""], s)
    assert not len(ids) or abs(share.sum() - 1) < 1e-5
    hidden = np.zeros(s.dim)
    for i, x in zip(ids, share, strict=True):
        hidden += float(x) * model.vectors[i].astype(float)
    z = hidden @ model.output.astype(float) + model.bias
    return float(np.exp(z[1]) / np.exp(z).sum())


def test_quality_scores_equal_the_model_text_by_text(spark, folder):
    """Null ids, repeated rows, a very long text, ties and clashing names."""
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.fit(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None, "a b c"), (3, "a b c"), (3, "a b c"), (7, "lang " * 60_000), (8, "é" * 5000), (9, " "), (10, None)]
    df = spark.createDataFrame([(*r, 0.5, "x", "y") for r in rows], "doc_id long, text string, quality_score double, quality string, score string").repartition(3)
    got = sorted((str(r.doc_id), round(r.quality_score, 6)) for r in quality.score(df.drop("quality_score"), model).collect())
    assert got == sorted((str(d), round(brute_quality(t, model), 6)) for d, t in rows)
    assert quality.score(df, model).count() == len(rows)


def test_quality_features_match_a_plain_reading():
    s = quality.Settings()
    buf, offsets = quality.texts(__import__("pyarrow").array(["ab cab", "ab", ""]))
    grams, firsts = quality.features(buf, offsets, 0, 3, s)
    sizes = [np.diff(f).tolist() for f in firsts]
    # of three and four bytes with a space at an end only; words; pairs of words
    inner = lambda t, n: sum(" " not in t[k + 1 : k + n - 1] for k in range(len(t) - n + 1))
    assert sizes[:2] == [[inner(t, n) for t in ("ab cab", "ab", "")] for n in s.grams]
    assert sizes[2:] == [[2, 1, 0], [1, 0, 0]]


def test_quality_stage_keeps_all_without_both_labels(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, rows in enumerate(([], [(1, 1, 0)], [(1, 0, 0), (2, 0, 0)], [(10**9, 1, 0), (10**9 + 1, 0, 0)])):
        spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{k}/labels.parquet")
        assert P.quality_stage(spark, docs, f"{tmp_path}/{k}").count() == docs.count()


def test_quality_stage_drops_what_the_model_rejects(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.fit(docs, labels)
    want = {r.doc_id for r in docs.collect() if brute_quality(r.text, model) >= 0.7}
    assert {r.doc_id for r in P.quality_stage(spark, docs, folder).collect()} == want


def test_quality_on_held_out_rows(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    from pyspark.sql import functions as F

    model = quality.fit(docs, labels.union(labels), F.col("doc_id") % 4 != 0)
    got = {r.doc_id: r.quality_score for r in quality.score(docs, model).collect()}
    assert all(got[d] >= 0.7 for d in range(80)) and all(got[d] < 0.7 for d in range(100, 140))
    assert all(0 <= x <= 1 for x in got.values()) and got[204] == got[205]
    none = quality.fit(docs, labels.limit(0))
    assert all(r.quality_score == 0.5 for r in quality.score(docs, none).collect())
    assert quality.score(docs.limit(0), model).count() == 0
