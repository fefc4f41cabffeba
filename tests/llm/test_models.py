"""The two learned operators against brute-force versions, row by row."""

import random

import numpy as np
import pytest

from auditloom.llm import quality, toxicity

from .test_operators import prose


def brute_features(text):
    """Distinct (length, n-gram) of a text with A-Z lower-cased."""
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return {(n, low[i : i + n]) for n in toxicity.ORDERS for i in range(len(low) - n + 1)}


def number(gram):
    """The feature number of one n-gram, by the definition of the hash, a character at a time."""
    n, text = gram
    acc = ord(text[0])
    for c in text[1:]:
        acc = (acc * int(toxicity._STEP) + ord(c)) % 2**64
    x = (acc + n) % 2**64
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * factor) % 2**64
    return (x ^ (x >> 31)) >> (64 - toxicity.BITS)


TEXTS = ["You UTTER fool", "naïve größe über", "", "ab", "abcabcabc", prose(80, random.Random(3)), "x" * 5000, "a kind word", "a kind fool"]


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in raw])])


def test_features_are_the_distinct_ngrams():
    grams, at = toxicity.hashed_ngrams(*packed(TEXTS))
    distinct = toxicity._Distinct()
    for text, a, b in zip(TEXTS, at[:-1].tolist(), at[1:].tolist()):
        assert sorted(distinct(grams, a, b).tolist()) == sorted({number(g) for g in brute_features(text)})


def test_ratios_and_scores_match_brute_force():
    toxic = np.array([True, False, False, False, True, False, True, False, True])
    rows = [np.array(sorted({number(g) for g in brute_features(t)}), np.int32) for t in TEXTS]
    flat, length = np.concatenate(rows), [len(r) for r in rows]
    got = toxicity.log_count_ratios(flat, np.repeat(toxic, length))
    size = 1 << toxicity.BITS
    count = {side: {} for side in (True, False)}
    for row, side in zip(rows, toxic):
        for f in row.tolist():
            count[bool(side)][f] = count[bool(side)].get(f, 0) + 1
    total = {side: size + sum(c.values()) for side, c in count.items()}
    for f in {f for c in count.values() for f in c} | {0, size - 1}:
        p, q = ((count[side].get(f, 0) + 1) / total[side] for side in (True, False))
        assert got[f] == pytest.approx(np.log(p / q))
    model = toxicity.train(rows, toxic)
    score = model.scores(*packed(TEXTS))
    for r, s in zip(rows, score):
        z = sum(float(model.weights[f]) for f in r.tolist()) + model.bias
        assert s == pytest.approx(1 / (1 + np.exp(-max(-30, min(30, z)))), abs=1e-4)
    assert ((score >= 0.5) == toxic)[[0, 1, 4, 5, 6, 7, 8]].all()


def test_chunks_train_alike(monkeypatch):
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 500, rng.integers(0, 60)).astype(np.int32)) for _ in range(120)]
    toxic = np.array([bool(len(r) and r[0] < 5) for r in rows])
    whole = toxicity.train(rows, toxic)
    monkeypatch.setattr(toxicity, "CHUNK", 37)
    parts = toxicity.train(rows, toxic)
    assert np.allclose(whole.weights, parts.weights, atol=1e-3) and whole.bias == pytest.approx(parts.bias, abs=1e-3)


def test_repeated_rows_and_long_texts_score_alone(spark):
    rows = [(i, prose(30) + (" you blockhead" if i % 3 == 0 else "")) for i in range(90)]
    long = prose(30_000)
    rows += [(5, rows[0][1]), (5, rows[0][1]), (200, long + " you blockhead"), (201, long)]
    df = spark.createDataFrame([(*x, 1, 2.0) for x in rows], "doc_id long, text string, score int, weights double")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int")
    got = toxicity.score(df, toxicity.fit(df, labels)).collect()
    assert len(got) == len(rows)
    by = {}
    for x in got:
        by.setdefault(x["doc_id"], set()).add(round(x["score"], 9))
    assert len(by[5]) == 2 and by[0] < by[5] and by[200] != by[201]


def test_verdict_is_the_first_rule_that_covers(spark):
    rng = np.random.default_rng(4)
    texts = [(i, (prose(int(rng.integers(20, 60))) + "".join(f" $v{rng.integers(9999)}" for _ in range(int(rng.integers(0, 40)))) + "\nSame line" * int(rng.integers(0, 4))).replace("w1", "W1" if i % 2 else "w1")) for i in range(200)]
    texts += [(900, None), (901, ""), (902, prose(30_000)), (7, texts[7][1])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(t.count("$") < 20), 0) for i, t in texts[:200]], "doc_id long, quality int, toxic int")
    stats = quality.text_stats(df)
    rules = quality.fit(stats, labels)
    made = [quality.Rule([("n_words", ">=", 30.0), ("symbols_per_word", "<=", 0.1)]), quality.Rule([("upper_share", ">=", 0.01)])]
    assert rules
    for chain in (rules, made, []):
        of = quality.features()
        got = stats.select(quality.verdict(chain, of).alias("_rule"), *(c.alias(k) for k, c in of.items())).toPandas()
        x = {k: got[k].to_numpy(float) for k in of}
        want = np.full(len(got), -1)
        for k in range(len(chain) - 1, -1, -1):
            want[chain[k].covers(x)] = k
        assert got["_rule"].tolist() == want.tolist()
    judged = quality.judge(df, labels).toPandas()
    assert (judged["kept"] == (~judged["base_failed"] & (judged["rule"] < 0))).all() and (judged.loc[judged["base_failed"], "rule"] == -1).all()
