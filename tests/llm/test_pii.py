import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np

from siltstone.llm import pii

CONTRACT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum((v := int(c) * (1 + k % 2)) - 9 * (v > 9) for k, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, value):
    d = re.sub("[^0-9]", "", value)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in value.split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()


def brute(text):
    return [(k, m.start(), m.end()) for k, p in CONTRACT.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


def texts():
    rng = np.random.default_rng(4)
    out = [None, "", "mail a.b@c.example.com, ip 1.2.3.4 card 4041894974608795 tel +1 (456) 555-2186", "foo@bar a@b.c_d@e.f.g+h@i.j", "4041 8949 7460 8795-1 x4041-8949-7460-8795", "1.2.3.4.5.6.7.8.9 256.1.1.1 0001.2.3.255", "ü😀 +49 30 1234567é 😀a@b.cc", "+1+234567890", "7" * 5000, "a" * 30000, "a." * 20000, "1." * 20000, "a@b" + ".c" * 20000]
    alphabet = list("ab1234567890@.+-_ ()é😀\n")
    out += ["".join(rng.choice(alphabet, n)) for n in rng.integers(1, 300, 400)]
    digits = list("0123456789 -.")
    out += ["".join(rng.choice(digits, n)) for n in rng.integers(1, 200, 300)]
    out.append(" ".join(f"u{k}@h{k}.org" for k in range(3000)))
    return out


def test_base_spans_match_the_contract(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(*r, None, 1) for r in rows], "doc_id long, text string, spans string, _row int")
    got = {r.doc_id: r for r in pii.report(df).collect()}
    assert len(got) == len(rows)
    for k, text in rows:
        want = brute(text)
        base = ",".join(f"{a}:{s}:{e}" for a, s, e in want)
        assert [got[k][f"n_{a}"] for a in CONTRACT] == [sum(w[0] == a for w in want) for a in CONTRACT], (text or "")[:200]
        assert got[k].base_sha256 == hashlib.sha256(base.encode()).hexdigest(), (text or "")[:200]
        assert [x for x in got[k].spans.split(",") if x and x.split(":")[0] in CONTRACT] == [x for x in base.split(",") if x]


def test_disclosing_terms_are_found_and_common_ones_are_not(spark):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(200)]
    prose = lambda n: " ".join(rng.choice(words, n))
    rows = [(k, prose(60)) for k in range(200)]
    rows += [(1000 + k, f"{prose(30)} Zorblatt wrote from z@corp.example to {prose(30)}") for k in range(5)]
    rows += [(2000 + k, f"{prose(30)} from other{k}@corp.example to {prose(30)}") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(df).collect()}
    for k, text in rows:
        terms = {text[int(s) : int(e)] for kind, s, e in (x.split(":") for x in got[k].spans.split(",") if x) if kind in ("term", "quasi")}
        assert ("Zorblatt" in terms) == (1000 <= k < 2000)
        assert not any(t.startswith("w") and t[1:].isdigit() for t in terms), terms
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert all("@" not in t and "Zorblatt" not in t for t in clean.values())
    assert all(clean[k] == t for k, t in rows if k < 1000) and "<email>" in clean[1000]


def named(spark, rows):
    """Of each row the disclosing terms."""
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    return {k: {(kind, text[int(s) : int(e)]) for kind, s, e in (x.split(":") for x in got[k].split(",") if x) if kind in ("term", "quasi")} for k, text in rows}


def test_copies_change_no_score(spark):
    rng = np.random.default_rng(2)
    prose = lambda n: " ".join(rng.choice([f"w{k}" for k in range(200)], n))
    rows = [(k, prose(60)) for k in range(200)]
    rows += [(1000 + k, f"{prose(30)} Zorblatt at z@corp.example, {prose(30)}") for k in range(3)]
    once = named(spark, rows)
    assert all(("term", "Zorblatt") in once[1000 + k] for k in range(3))
    for copied in (200, 0):  # a text that holds the term, and one that does not
        copies = [(5000 + k, rows[copied][1]) for k in range(1000)]
        many = named(spark, rows + copies)
        assert {k: many[k] for k in once} == once and all(many[k] == once[rows[copied][0]] for k, _ in copies)


def test_the_whole_text_is_the_context(spark):
    rng = np.random.default_rng(3)
    prose = lambda n: " ".join(rng.choice([f"w{k}" for k in range(200)], n))
    rows = [(k, prose(60)) for k in range(200)]
    rows += [(1000 + k, f"Zorblatt\n{prose(100)} z@corp.example {prose(100)} zorblatt") for k in range(3)]
    rows += [(2000, " ".join(f"Yoldan {prose(50)} y@corp.example" for _ in range(3))), (2001, f"Xandro {prose(50)} x@corp.example")]
    got = named(spark, rows)
    assert all({("term", "Zorblatt"), ("term", "zorblatt")} == got[1000 + k] for k in range(3))
    assert got[2000] == {("term", "Yoldan")} and not any(got[k] for k in got if k not in (1000, 1001, 1002, 2000))
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("orblatt" not in clean[1000 + k] and "Yoldan" not in clean[2000] for k in range(3))


def test_sanitise_keeps_columns_and_merges_overlaps(spark):
    df = spark.createDataFrame([(1, "x +4222222222222 y", "p", 2), (None, None, None, None)], "doc_id long, text string, _text string, terms int")
    assert sorted(map(tuple, pii.sanitise(df).collect()), key=str) == [(1, "x <phone> y", "p", 2), (None, None, None, None)]
    assert pii.report(df.limit(0)).count() == 0


def brute_terms(rows, s):
    """Of each row its disclosing spans, from the definition."""
    distinct = {t for _, t in rows if t is not None}
    words = {t: [w.lower() for w in re.findall(r"[^\W_]+", t)] for t in distinct}
    c_t = Counter(w for t in distinct for w in set(words[t]))
    held = defaultdict(dict)  # entity -> text -> how often
    for t in distinct:
        for e, n in Counter(f"{k}:{t[a:b].lower()}" for k, a, b in brute(t)).items():
            held[e][t] = n
    kinds = {t: {} for t in distinct}
    total = len(distinct)
    for texts_ in held.values():
        if sum(texts_.values()) < s.support or len(texts_) == total:
            continue
        for w in {w for t in texts_ for w in words[t]}:
            both = [t for t in texts_ if w in words[t]]
            if sum(min(words[t].count(w), texts_[t]) for t in both) < s.support:
                continue
            told = math.log2(len(both) * total / (len(texts_) * c_t[w])) / math.log2(total / len(texts_))
            if told >= s.generalise:
                for t in both:
                    kinds[t][w] = "term" if told >= s.remove or kinds[t].get(w) == "term" else "quasi"
    out = {}
    for d, t in rows:
        spans = [(kinds[t][m.group().lower()], m.start(), m.end()) for m in re.finditer(r"[^\W_]+", t or "") if t is not None and m.group().lower() in kinds[t]]
        inside = lambda a, b, t=t: any(x < b and a < y for _, x, y in brute(t))
        out[d] = sorted((k, a, b) for k, a, b in spans if not inside(a, b))
    return out


def test_disclosure_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    common, rare = [f"w{k}" for k in range(60)], [f"Rare{k}" for k in range(25)]
    rows = [(k, " ".join(rng.choice(common, 25))) for k in range(60)]
    for k in range(120):
        who = int(rng.integers(8))
        words = [*rng.choice(common, 20), *rng.choice(rare[3 * who : 3 * who + 4], 2), rare[int(rng.integers(25))]]
        mails = [f"p{who}@corp.example"] * int(rng.integers(1, 4)) + ([f"q{who}@corp.example"] if who % 2 else [])
        rows.append((100 + k, " ".join(map(str, rng.permutation([*words, *mails])))))
    rows += [(300 + k, rows[70][1]) for k in range(20)] + [(400, None), (401, ""), (402, "10.1.2.3 Rare1 10.1.2.3 rare1 10.1.2.3 RARE1")]
    want = brute_terms(rows, pii.Settings())
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    spans = {d: sorted((k, int(a), int(b)) for k, a, b in (x.split(":") for x in t.split(",") if x) if k in ("term", "quasi")) for d, t in got.items()}
    assert spans == want
    assert {k for own in want.values() for k, _, _ in own} == {"term", "quasi"}


def test_the_driver_table_has_disclosing_terms(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {d: len(own) for d, own in brute_terms(rows, pii.Settings()).items() if own}
    got = {r.doc_id: len([x for x in r.spans.split(",") if x.split(":")[0] in ("term", "quasi")]) for r in pii.report(docs).collect()}
    assert {d: n for d, n in got.items() if n} == want
