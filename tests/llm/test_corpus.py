"""Source divergence, whitening and sanitising against brute force, and their defined results."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import regex

from auditloom.llm import divergence, pii, whitening

from .test_operators import VOCAB, prose

R = random.Random(11)


# 12 divergence


def brute_divergence(rows, min_docs, top):
    rows = [((t or "").translate({c: c + 32 for c in range(65, 91)}), lang or "", source or "") for t, lang, source in rows]
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t) for t, _, _ in rows]
    out = set()
    for lang in {x[1] for x in rows}:
        own = [(w, x[2]) for w, x in zip(words, rows) if x[1] == lang]
        held = Counter(t for w, _ in own for t in set(w))
        kept = sorted(t for t, n in held.items() if n >= min_docs)
        counts = {s: Counter() for s in {s for _, s in own}}
        for w, s in own:
            counts[s].update(t for t in w if t in set(kept))
        every = sum(counts.values(), Counter())

        def shares(c):
            n = sum(c.values())
            return [1 + 1_000_000_000 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept]

        f = lambda p, q: (p - q) ** 2 // (p + q)
        q = shares(every)
        p = {s: shares(c) for s, c in counts.items()}
        for s in p:
            pair = [(-sum(map(f, p[s], p[o])), o.encode(), o) for o in p if o != s]
            term = [(-f(a, b), t.encode(), t) for t, a, b in zip(kept, p[s], q) if counts[s][t] and a > b]
            for part, got in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out |= {(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(got, 1)}
    return out


ROWS = [(prose(R.randint(0, 60), R), R.choice(["en", "en", "de", "", None]), R.choice(["a", "a", "a", "b", "c", "", None, "ö"])) for _ in range(160)]
ROWS += [(None, "xx", "only"), ("", "yy", "a"), ("12 34 !", "yy", "b"), (None, None, None), (prose(20_000, R), "en", "b"), ("Ünï 日本 \U0001f600 ÀB", "en", "a")] + [("Same Words AGAIN same", "de", "a")] * 30


def divergence_frame(spark, rows):
    return spark.createDataFrame([(i, *x, 1, 2, 3) for i, x in enumerate(rows)], "doc_id long, text string, lang string, source string, term int, p int, `a.b` int").repartition(3)


@pytest.mark.parametrize("min_docs", [1, 10, 1000])
def test_divergence_matches_brute_force(spark, min_docs):
    got = divergence.divergence(divergence_frame(spark, ROWS), min_docs, 10).select("lang", "source", "part", "item", "value", "rank").collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute_divergence(ROWS, min_docs, 10)


def test_divergence_of_nothing(spark):
    assert divergence.divergence(divergence_frame(spark, ROWS).limit(0)).collect() == []
    one = divergence.divergence(divergence_frame(spark, [(None, "en", "a"), ("word", "en", "b")]))
    assert sorted(tuple(r) for r in one.collect()) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_shares_do_not_overflow(spark):
    from pyspark.sql import functions as F

    big = 9_000_000_000_000_000_000
    df = spark.createDataFrame([(big, big, 12), (0, big, 1), (3, 7, 2)], "c long, n long, v long")
    got = [r[0] for r in df.select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).collect()]
    assert got == [1 + 1_000_000_000 * (c + 2) // (n + 2 * v) for c, n, v in ((big, big, 12), (0, big, 1), (3, 7, 2))]


# 13 whitening


def fitted(vectors):
    """(n, sums, eigenvalues, eigenvectors by column) of the distinct vectors, the covariance from exact fractions."""
    x = sorted({tuple(math.floor(64 * c) + 1_000_000 for c in v) for v in vectors})
    n, d = len(x), len(x[0])
    sums = [sum(v[k] for v in x) for k in range(d)]
    centred = np.array([[float(Fraction(n * v[k] - sums[k], n)) for k in range(d)] for v in x])
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    return n, sums, value[::-1], vector[:, ::-1], centred


@pytest.mark.parametrize(("d", "scale", "parts"), [(24, 1.0, 7), (5, 1e6, 13), (20, 1e-2, 1)])
def test_whitening_matches_brute_force(spark, d, scale, parts):
    rng = np.random.default_rng(3)
    m = (rng.normal(size=(400, d)) * np.linspace(3, 0.5, d) + 5) * scale
    vectors = [r.astype(np.float32).tolist() for r in m] + [m[0].astype(np.float32).tolist()] * 150
    rows = [(i, v, 0, 0) for i, v in enumerate(vectors)]
    rows += [(9001, None, 0, 0), (9002, [*vectors[1][1:], None], 0, 0), (9003, [float("nan")] * d, 0, 0), (9004, [*vectors[1][1:], float("inf")], 0, 0), (9005, [], 0, 0), (None, vectors[2], 0, 0), (7, vectors[7], 0, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, x int").repartition(parts)
    got = whitening.whitened(df).toPandas()
    n, sums, value, vector, centred = fitted(vectors)
    k = min(16, d)
    assert len(got) == k * (len(vectors) + 2) and set(got["n"]) == {n} and got["vec_id"].isna().sum() == k
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    for c in range(1, k + 1):
        part = got[(got["component"] == c) & got["vec_id"].notna()].drop_duplicates("vec_id").sort_values("vec_id")
        assert np.allclose(part["explained"], value[c - 1] / value.sum(), rtol=1e-9)
        x = np.array([[math.floor(64 * e) + 1_000_000 for e in v] for v in vectors])
        want = np.array([[float(Fraction(n * int(e) - s, n)) for e, s in zip(v, sums)] for v in x]) @ vector[:, c - 1] / np.sqrt(value[c - 1])
        assert np.allclose(part["whitened"], want, atol=1e-6) or np.allclose(part["whitened"], -want, atol=1e-6)
        exact = [sum((n * int(e) - s) ** 2 for e, s in zip(v, sums)) for v in x]
        assert [None if v >= 2**63 else v for v in exact] == [None if v != v else int(v) for v in part["deviation"].astype(object)]


def test_whitening_without_variance_and_of_mixed_lengths(spark):
    schema = "vec_id long, embedding array<double>"
    same = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in sorted(same)] == [(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    line = whitening.whitened(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)] + [(100, [1.0]), (101, [3.0])], schema)).collect()
    assert {r["whitened"] for r in line if r["component"] > 1} == {None} and all(abs(r["explained"] - 1) < 1e-12 for r in line if r["component"] == 1)
    assert {r["n"] for r in line} == {9, 2} and sorted(abs(r["whitened"]) for r in line if r["vec_id"] >= 100) == [1.0, 1.0]
    assert whitening.whitened(spark.createDataFrame([], schema)).collect() == []
    huge = whitening.whitened(spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [-1e300, 5.0])], schema)).collect()
    assert len(huge) == 6 and {r["deviation"] for r in huge} >= {None}


def test_merging_parts_loses_nothing():
    rng = np.random.default_rng(8)
    x = rng.integers(-40, 40, (300, 12)) + 1_000_000
    whole = whitening.Part.of(x)
    cut = None
    for a in range(0, 300, 7):
        part = whitening.Part.of(x[a : a + 7])
        cut = part if cut is None else cut.merge(part)
    assert cut.n == 300 and (cut.sums == whole.sums).all()
    assert np.allclose(cut.rows.T @ cut.rows, whole.rows.T @ whole.rows, rtol=1e-12, atol=1e-8)
    assert np.allclose(np.linalg.svd(cut.rows)[1], np.linalg.svd(whole.rows)[1], rtol=1e-12)


# 11 personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": all(int(x) <= 255 for x in value.split(".")) if kind == "ip" else 0, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def brute_base(text):
    return [(kind, m.start(), m.end(), m.group()) for kind, p in PLAIN.items() for m in re.finditer(p, text or "") if holds(kind, m.group())]


def brute_terms(texts, context, min_texts, threshold):
    """Spans of terms of each text by the formulas, for texts whose base spans do not overlap."""
    word = regex.compile(r"\p{L}[\p{L}\p{M}]*")
    near, of_entity, of_pair, of_term, by_text = [], Counter(), Counter(), Counter(), defaultdict(set)
    for text in texts:
        text = text or ""
        spans = sorted((a, b, (k, v.lower() if k == "email" else v if k == "ip" else re.sub("[^0-9]", "", v))) for k, a, b, v in brute_base(text))
        emails = [(a, b) for a, b, e in spans if e[0] == "email"]
        words = [(m.start(), m.group().lower()) for m in word.finditer(text) if not any(a < m.end() and m.start() < b for a, b in emails)]
        of_term.update({m.group().lower() for m in word.finditer(text)})
        line = sorted([(a, e, True) for a, _, e in spans] + [(a, w, False) for a, w in words])
        got = set()
        for k, (_, e, entity) in enumerate(line):
            if entity:
                got |= {(e, w) for _, w, other in line[max(0, k - context) : k + context + 1] if not other} | {(e, None)}
        near.append(got)
        of_entity.update(e for e, t in got if t is None)
        of_pair.update(got)
        for p in got:
            by_text[p].add(text)
    d, out = len(texts), []
    for text, got in zip(texts, near):
        terms = set()
        for e, t in got:
            if t is not None and len(by_text[e, t]) >= min_texts and of_entity[e] < d:
                pmi, ic = math.log2(of_pair[e, t] * d / (of_entity[e] * of_term[t])), math.log2(d / of_entity[e])
                if round(pmi / ic, 9) >= threshold:
                    terms.add(t)
        emails = [(a, b) for k, a, b, _ in brute_base(text) if k == "email"]
        out.append([("term", m.start(), m.end(), m.group()) for m in word.finditer(text or "") if m.group().lower() in terms and not any(a < m.end() and m.start() < b for a, b in emails)])
    return out


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)


ODD = [
    None, "", "a@b", "a@b.c_d@e.f x.y@z.co.uk..q@w.e-", "%+@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.1.1 1.2.3", "ü 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111",
    "+1 (386) 555-3733. +49 30 123 +(1) +1--2 +123456789012345678 +1.2.3.4.5.6.7.8.9)", "call\n+1 (386)\n555-3733\t10.0.0.1\n", "x" * 5000 + "@" + "y" * 5000, "a." * 4000 + "@b.c" + ".d" * 4000, "1 " * 4000, "日本@例.jp é.e@ä.com a@ü.de \U0001f600 q@r.st",
    "@@@.@a.b@c.d", "Σ ΟΔΟΣ İ 5555555555554444", "4111111111111111@x.org +4111111111111111",
]


def random_text(r):
    alphabet = "ab1.@+- ()5%_\n9é"
    return "".join(r.choice(alphabet) for _ in range(r.randint(0, 120)))


def planted():
    r = random.Random(2)
    texts = [*ODD, *(random_text(r) for _ in range(400))]
    for i in range(12):  # a name beside an email in different texts, and words that are everywhere
        texts.append(f"{prose(30, r)} Contact Brunhild Ängström-Vex of the cat at b.vex@mail.example.com or 10.1.2.{i} {prose(30, r)}")
    texts += [f"{prose(20, r)} Brunhild {prose(5, r)}" for _ in range(2)]
    texts += ["copied secret Zanzibarian text with z@y.com"] * 40
    return texts + [prose(30, r) for _ in range(200)]


def pii_frame(spark, texts):
    return spark.createDataFrame([(i if i % 50 else None, t, i, "r", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, rid long, row string, `a.b` double").repartition(5)


@pytest.mark.parametrize(("context", "min_texts", "threshold"), [(50, 3, 0.75), (4, 2, 0.3)])
def test_personal_data_matches_brute_force(spark, context, min_texts, threshold):
    texts = planted()
    got = {r["rid"]: r for r in pii.report(pii_frame(spark, texts), context, min_texts, threshold).collect()}
    assert len(got) == len(texts)
    want = brute_terms(texts, context, min_texts, threshold)
    mixed = {i for i, t in enumerate(texts) if any(a < d and c < b for (_, a, b, _), (_, c, d, _) in itertools.combinations(brute_base(t), 2))}
    for i, text in enumerate(texts):
        base = brute_base(text)
        assert [got[i][f"n_{k}"] for k in PLAIN] == [sum(s[0] == k for s in base) for k in PLAIN], text
        assert got[i]["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest(), text
        assert got[i]["spans"].startswith(joined(base))
        if i not in mixed:
            assert got[i]["spans"] == joined(base + want[i]), (text, got[i]["spans"])
    if min_texts == 3:
        name = next(i for i, t in enumerate(texts) if t and "Contact" in t)
        assert got[name]["n_terms"] >= 2 and all(got[i]["n_terms"] == 0 for i, t in enumerate(texts) if t and "Zanzibarian" in t)


def test_sanitised_texts(spark):
    texts = planted()
    df = pii_frame(spark, texts)
    out = pii.sanitise(df)
    assert out.columns == df.columns
    got = {r["rid"]: r["text"] for r in out.collect()}
    for i, text in enumerate(texts):
        if not brute_base(text):
            assert got[i] == text
    name = next(i for i, t in enumerate(texts) if t and "Contact" in t)
    assert "[EMAIL]" in got[name] and "Vex" not in got[name] and "Ängström" not in got[name] and "the cat" in got[name] and "[IP]" in got[name]
    assert got[6] == "ü [CARD] and 4111-1111-1111-1112, 4111  1111"


def test_personal_data_of_nothing_and_of_one_long_text(spark):
    df = pii_frame(spark, ["x"])
    assert pii.report(df.limit(0)).collect() == [] and pii.sanitise(df.limit(0)).collect() == []
    text = " ".join(f"w{k} {k}@mail.org" for k in range(20_000))
    (row,) = pii.report(pii_frame(spark, [text])).collect()
    assert row["n_email"] == 20_000 and row["spans"] == joined(brute_base(text))
