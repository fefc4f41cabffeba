"""Each operator against a brute-force version, and its defined results for nulls, empty and long texts, ties, repeated rows,
empty tables and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import chat, decontam, neardup, packing, quality, shards, suffix, tokencounts, toxicity, urls
from auditloom.llm import kernels as K
from auditloom.llm.common import shared_dir

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
R = random.Random(5)
VOCAB = ["the", "of", "Zebra", "naïve", "lorem", "ipsum", "dolor", "x1", "größe", "a", "b", "über", "cat", "dog", "runs"] + [f"w{i}" for i in range(400)]


def prose(n, r=R):
    return " ".join(r.choice(VOCAB) for _ in range(n))


BASE = prose(120)
TEXTS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, BASE), (6, BASE), (7, BASE.upper()), (8, BASE.replace("w1", "q1", 1) + " tail"), (9, prose(60)), (9, prose(61)), (10, BASE), (10, BASE),
    (None, BASE), (None, None), (11, "spam ham eggs tea " * 30), (12, "Line A\nLine B\nLine A\n\nLine A"), (13, "no#sym$bols*here " * 5), (14, "ab" * 3000), (15, prose(4000)), (16, " wide space \x1f ok"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t) if t else None, 1, "x", 2, 3) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, bucket int, key int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def words_of(text):
    return WORD.findall((text or "").encode())


# 8 quality


def test_statistics(spark, docs, none):
    got = [tuple(r) for r in quality.text_stats(docs).select("doc_id", *quality.STATS[:5]).collect()]
    want = []
    for i, t in TEXTS:
        b, w, seen = (t or "").encode(), words_of(t), {}
        for k in range(len(w) - 7):
            seen.setdefault(tuple(w[k : k + 8]), []).append(k)
        cover = {j for v in seen.values() if len(v) > 1 for k in v for j in range(k, k + 8)}
        lines = [x for x in b.split(b"\n") if WORD.search(x)]
        want.append((i, len(w), sum(len(x.decode()) for x in w), len(re.findall(rb"[#*$%&|<>]", b)), len(lines) - len(set(lines)), len(cover)))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert quality.text_stats(none).count() == 0


def test_rules_learned(spark, none):
    rng = np.random.default_rng(1)
    x = {"a": rng.random(900), "b": rng.random(900), "c": rng.random(900)}
    bad = ((x["a"] > 0.8) & (x["b"] > 0.5)) | (x["c"] < 0.1)
    rules = quality.learn_rules(x, bad, np.arange(900) % 3)
    hit = np.zeros(900, bool)
    for r in rules:
        hit |= r.covers(x)
    assert (hit == bad).mean() > 0.97 and (~bad & hit).sum() <= 9
    assert quality.learn_rules(x, np.zeros(900, bool), np.arange(900) % 3) == []
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judge(none, labels).count() == 0
    good = spark.createDataFrame([(1, prose(50)), (2, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in quality.judge(good, labels).collect()} == {1: True, 2: False}


def test_quality_drops_marked_text(spark):
    rows = [(i, prose(60) if i % 5 else " ".join(w + "$$$" for w in prose(60).split())) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(250)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert all(got[i] == (i % 5 > 0) for i in range(300))


# 3 near-duplicates


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = [bytes(x) for x in words_of(t.translate({c: c + 32 for c in range(65, 91)}) if t else "")]
        s = set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set()
        sets.setdefault(i, []).append(s)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations([i for i in sets if i is not None], 2):
        if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates(spark, docs, none, block):
    r = random.Random(9)
    rows = [(i, t) for i, t in TEXTS]
    for g in range(4):
        seed = prose(80, r).split()
        for k in range(12):
            w = list(seed)
            for _ in range(k % 6):
                w[r.randrange(len(w))] = f"new{r.randrange(9999)}"
            rows.append((1000 - g * 40 - k, " ".join(w)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()
    want = brute_components(rows)
    assert len(got) == len(rows)
    for x in got:
        assert x["component_id"] == want[x["doc_id"]] and x["kept"] == (x["doc_id"] == x["component_id"])
    assert neardup.near_duplicates(none).count() == 0


def test_sequential_bounds():
    steps = neardup.prune_below(miss=1e-6)
    assert all(a < b for a, b in zip(steps, steps[1:]))
    rng = np.random.default_rng(3)
    n = neardup.BANDS * neardup.ROWS + neardup.EXTRA
    kept = {}
    for p in (0.75, 0.5):
        same = rng.random((2000, n)) < p
        a, b = np.zeros((2000, n), np.uint8), (~same).astype(np.uint8)
        cut = neardup.BANDS * neardup.ROWS
        sig = lambda m: neardup.Signatures(m[:, :cut].astype(np.uint16), m[:, cut:])
        kept[p] = len(neardup.similar_enough(sig(a), sig(b), steps)[0])
    assert kept[0.75] == 2000 and kept[0.5] == 0


# 10 suffix array


def brute_removed(rows, size):
    count = Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[p : p + size] for p in range(len(b) - size + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if count[b[p : p + size]] > 1:
                gone[p : p + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size,block", [(200, 32768), (200, 4), (61, 5)])
def test_repeated_bytes(spark, docs, none, size, block):
    r = random.Random(2)
    shared = "".join(r.choice("abcdé ") for _ in range(700))
    rows = [(i, t) for i, t in TEXTS if i != 15] + [(50 + i, prose(9, r) + shared[r.randint(0, 250) : r.randint(300, 700)] + prose(9, r)) for i in range(40)]
    got = suffix.dedup_report(spark.createDataFrame(rows, "doc_id long, text string"), size, block)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_removed(rows, size)
    assert suffix.dedup_report(none).count() == 0


def test_repeats_cut_whole_characters(spark):
    a = "é" * 150
    rows = [(1, "x" + a + "tail é"), (2, "yy" + a[:120] + "end"), (3, "clean")]
    df = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, extra string")
    got = {r["doc_id"]: (r["text"], r["extra"]) for r in suffix.dedup_texts(df).collect()}
    assert got[3] == ("clean", "k") and got[2][0] == "yyend" and got[1][0].startswith("x") and got[1][0].endswith("tail é")


def test_long_texts_in_stretches(monkeypatch):
    data = np.frombuffer(("".join(random.Random(1).choice("abcd ") for _ in range(9000)) + "z" * 900).encode(), np.uint8)
    plan, at = suffix.Plan(200), np.array([0, len(data)])
    whole = suffix._cells(data, at, plan)
    monkeypatch.setattr(suffix, "POS_BITS", 11)
    parts = suffix._cells(data, at, plan)
    windows = lambda c: {(int(k), int(a - r)) for k, a, lo, hi in zip(c["key"], c["anchor"], c["r_lo"], c["r_hi"]) for r in range(lo, hi + 1)}
    assert len(windows(parts)) == len(windows(whole)) == len(data) - 199


# 7 decontamination


def test_alignment_matches_textbook():
    r = np.random.default_rng(4)
    for _ in range(60):
        a, b = r.integers(1, 6, r.integers(1, 9)).astype(np.uint64), r.integers(1, 6, r.integers(1, 14)).astype(np.uint64)
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        score, end = decontam.align(*decontam._padded([a]), *decontam._padded([b]))
        assert score[0] == h.max() and (not h.max() or h[:, end[0] + 1].max() == h.max())


def test_leaks(spark, docs, none):
    r = random.Random(8)
    items = [(k, " ".join(f"{r.choice(VOCAB)}{r.randrange(50)}" for _ in range(30))) for k in range(6)] + [(90, None), (91, ""), (92, "uniqueword")]
    edited = items[1][1].split()
    for k in range(4, 30, 6):
        edited[k] = "changed"
    rows = [(1, prose(50, r) + " " + items[0][1].upper().replace(" ", ", ") + " " + prose(50, r)), (2, " ".join(edited)), (3, prose(200, r)), (4, " ".join(items[2][1].split()[:8]) + " " + prose(40, r)), (5, None), (None, items[3][1]), (6, "so uniqueword it is")]
    frame = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, score int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x for x in decontam.find_leaks(frame, bench).collect()}
    assert set(got) == {(1, 0), (2, 1), (None, 3), (6, 92)}
    assert got[1, 0]["score"] == 1.0 and got[1, 0]["first_word"] == 50 and got[1, 0]["end_word"] == 80
    assert sorted(x["doc_id"] for x in decontam.without_leaks(frame, bench).collect()) == [3, 4, 5]
    assert decontam.find_leaks(none, bench).count() == 0
    assert decontam.find_leaks(frame, bench.limit(0)).count() == 0 and decontam.without_leaks(frame, bench.limit(0)).count() == 7


def test_leaks_in_repeats_long_texts_and_other_ids(spark):
    r = random.Random(14)
    items = [(f"i{k}", " ".join(f"{r.choice(VOCAB)}{r.randrange(50)}" for _ in range(25))) for k in range(4)] + [(None, prose(6, r) + " mark1 mark2 mark3"), ("i0", "other words entirely here now")]
    long = prose(60_000, r) + " " + items[0][1] + " " + prose(60_000, r)
    rows = [("a", long), ("b", items[1][1]), ("b", items[1][1]), ("c", " ".join([items[2][1]] * 40)), ("d", prose(60_000, r)), (None, items[4][1]), ("e", None)]
    frame = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id string, text string, item_id int, score int")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = Counter((x["doc_id"], x["item_id"]) for x in decontam.find_leaks(frame, bench).collect())
    assert got == Counter({("a", "i0"): 1, ("b", "i1"): 2, ("c", "i2"): 1, (None, None): 1})
    assert sorted(x["doc_id"] for x in decontam.without_leaks(frame, bench).collect()) == ["d", "e"]


def test_regions_hold_every_stretch():
    rng = np.random.default_rng(6)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        doc, item = rng.integers(0, 2, n), rng.integers(0, 2, n)
        width = np.where(item == 0, 5, 11)
        lo = rng.integers(0, 90, n)
        hi = lo + np.minimum(width, rng.integers(1, 12, n))
        got = decontam._regions(doc, item, lo, hi, width)
        assert all(any((d, t) == (x, y) and a <= p and q <= b for x, y, a, b in got) for d, t, p, q in zip(doc, item, lo, hi))
        assert all(b - a <= 4 * (5 if t == 0 else 11) for _, t, a, b in got)


@pytest.mark.parametrize("beside", [False, True])
def test_leaks_of_edited_copies_match_all_pairs(spark, beside):
    r = random.Random(9)
    items = [(k, " ".join(f"{r.choice(VOCAB)}{r.randrange(50)}" for _ in range(38))) for k in range(12)]
    rows = []
    for k, text in items:
        fourth, some = text.split(), text.split()
        for i in range(3, 38, 4):
            fourth[i] = f"changed{i}"
        for i in r.sample(range(38), 11):
            some[i] = f"other{i}"
        rows += [(100 + k, " ".join(fourth)), (200 + k, f"{prose(30, r)} {' '.join(some)} {prose(30, r)}"), (300 + k, prose(80, r))]
        rows += [(400 + 20 * j + k, text) for j in range(5)] if beside else []
    words_in = lambda t: decontam._words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]
    want = {}
    for (d, text), (k, item) in itertools.product(rows, items):
        a, b = decontam._padded([words_in(item)]), decontam._padded([words_in(text)])
        score = decontam.align(*a, *b)[0][0] / (decontam.MATCH * 38)
        if score >= decontam.THRESHOLD:
            want[d, k] = score
    assert {(100 + k, k) for k, _ in items} | {(200 + k, k) for k, _ in items} <= set(want)
    frame, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(x["doc_id"], x["item_id"]): x["score"] for x in decontam.find_leaks(frame, bench).collect()} == pytest.approx(want)
    assert sorted(x["doc_id"] for x in decontam.without_leaks(frame, bench).collect()) == sorted(d for d, _ in rows if d not in {d for d, _ in want})


def words_of_text(text):
    data = np.frombuffer((text or "").encode(), np.uint8)
    return decontam._words(data, np.array([0, len(data)]))[0]


def all_pairs(docs, items):
    """(doc, item) -> score of all that reach the threshold, each document aligned whole with each item."""
    out = {}
    read = {d: words_of_text(t) for d, t in docs}
    for i, text in items:
        item = words_of_text(text)
        score = decontam.align(*decontam._padded([item] * len(docs)), *decontam._padded(list(read.values())))[0] / (decontam.MATCH * len(item))
        out |= {(d, i): float(s) for d, s in zip(read, score) if s >= decontam.THRESHOLD}
    return out


def edited(text, rate, r):
    out = []
    for w in text.split():
        k = r.random()
        out += [r.choice(VOCAB)] if k < rate / 2 else [] if k < 0.75 * rate else [w, r.choice(VOCAB)] if k < rate else [w]
    return " ".join(out)


def test_items_that_share_phrases(spark, monkeypatch):
    monkeypatch.setattr(decontam, "COMMON_ITEMS", 8)
    monkeypatch.setattr(decontam, "COMMON_DOCS", 8)
    r = random.Random(9)
    stem, form = "which of these words comes next in the row", "the answer to the first question of the second part is"
    items = [(k, f"{stem} {prose(r.randint(14, 25), r)}") for k in range(60)]  # a stem that costs nothing
    items += [(100 + k, f"{form} v{k} u{k}") for k in range(30)]  # little of their own
    items += [(200, prose(20, r)), (201, "one two three"), (202, prose(20, r))]
    docs = [(k, f"{prose(30, r)} {edited(items[k][1], 0.05 * (k % 6), r)} {prose(30, r)}") for k in range(60)]
    docs += [(100 + k, f"{prose(20, r)} {stem} {prose(20, r)}") for k in range(20)]
    docs += [(200 + k, f"{prose(20, r)} {form} v{k} u{k} {prose(20, r)}") for k in range(5)]
    docs += [(300 + k, f"{prose(5, r)} {items[90][1]} {prose(5, r)}") for k in range(40)]  # an item that every tenth document holds
    docs += [(400, "no one two three but me"), (401, ""), (402, None)] + [(500 + k, prose(60, r)) for k in range(100)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in decontam.find_leaks(frame, bench).collect()}
    want = all_pairs([d for d in docs if d[1]], items)
    assert all(got[p] == pytest.approx(want[p]) for p in got) and len(got) >= 0.9 * len(want)
    assert {p for p in want if p[1] >= 100} <= {*got} and not any(100 <= d < 200 for d, _ in got)
    built = decontam.block_items(bench)
    kept = decontam.driving(built, *decontam._seed_counts(frame, built), decontam.THRESHOLD)
    assert len(kept.seeds) < len(built.seeds) and np.bincount(kept.item[kept.alone], minlength=60)[:60].max() > 0 and np.diff(kept.posting).max() <= 60



# 1 packing


def test_best_boundaries():
    rng = np.random.default_rng(0)
    for _ in range(150):
        lengths = np.sort(rng.choice(np.arange(1, 30), rng.integers(1, 9), replace=False))
        counts, k = rng.integers(1, 20, len(lengths)), int(rng.integers(1, 5))
        cost = lambda ends: sum(int(n) * (min(e for e in ends if e >= x) - int(x)) for x, n in zip(lengths, counts))
        inner = [int(v) for v in lengths[:-1]]
        least = min(cost([*c, int(lengths[-1])]) for m in range(min(k, len(lengths))) for c in itertools.combinations(inner, m))
        ends = packing.best_boundaries(lengths, counts, k)
        assert cost(ends) == least and len(ends) <= k
    assert packing.best_boundaries(np.zeros(0, int), np.zeros(0, int), 3) == []


def test_packing(spark, docs, none):
    sizes = packing.token_counts(docs)
    want = Counter((i, len(packing.encode(t, packing.VOCABULARY)) + 1 if t else 1) for i, t in TEXTS)
    assert Counter(map(tuple, sizes.collect())) == want
    got = packing.pack(sizes, max_len=100, n_buckets=3, budget=250, shards=3).toPandas()
    assert got["n_tokens"].sum() == sum(n * k for (_, n), k in want.items()) and got["n_tokens"].max() <= 100
    assert len(got) == sum(-(-n // 100) * k for (_, n), k in want.items())
    for (b, end), part in got.groupby(["bucket", "bucket_len"]):
        room = max(1, 250 // end)
        assert sorted(zip(part["batch"], part["slot"])) == [(k // room, k % room) for k in range(len(part))]
        assert (part["padding"] == end - part["n_tokens"]).all() and (part["padding"] >= 0).all()
    assert packing.pack(packing.token_counts(none)).count() == 0


@pytest.mark.parametrize("text", ["probability3" * 20_834, "ab1-" * 62_500, "x" * 250_000, "中文字" * 50_000, "don't" * 50_000, " " * 210_000 + "end"])
def test_texts_without_spaces_tokenize_alike(text):
    assert packing.encode(text, packing.VOCABULARY) == packing.encoder(packing.VOCABULARY).encode_ordinary(text)


def test_cuts_are_the_patterns(monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 3)
    r, whole = random.Random(0), packing.encoder(packing.VOCABULARY).encode_ordinary
    for _ in range(800):
        text = "".join(r.choice(["'", "s", "'ll", " ", "  ", "\n", "é", "1", "-", "a", "中", "\t", "re", "!", "'t", "\x1f", "\u00a0", "٣"]) for _ in range(40))
        assert packing.encode(text, packing.VOCABULARY) == whole(text)


def test_rows_without_an_id_are_packed(spark):
    df = spark.createDataFrame([(None, prose(k % 40), 1) for k in range(400)] + [(5, "same text", 2)] * 6, "doc_id long, text string, salt int")
    got = packing.pack_documents(spark, df, "").toPandas()
    assert len(got) == 406
    for _, part in got.groupby("bucket"):
        assert part[["batch", "slot"]].drop_duplicates().shape[0] == len(part)
    assert packing.pack_documents(spark, df.limit(0), "").count() == 0


def test_long_texts_tokenize_alike():
    text = prose(40_000) + " " + "x" * 250_000
    pieces = packing.encoder(packing.VOCABULARY)
    assert pieces.decode(packing.encode(text, packing.VOCABULARY)) == text
    short = text[:150_000]
    assert packing.encode(short, packing.VOCABULARY) == pieces.encode_ordinary(short)


# 5 token counts


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_separator_scan(spark, tmp_path, block):
    folder = f"file://{tmp_path}"
    streams = {"a.bin": [3, 9, 9, 4, 5, 6, 9], "b.bin": [9], "c.bin": [1, 2, 3], "d.bin": [7] * 40 + [9] + [8] * 30, "e.bin": []}
    for name, ids in streams.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    want = []
    for name, ids in streams.items():
        start, k = 0, 0
        for i, x in enumerate(ids):
            if x == 9:
                want.append((name, k, start, i - start, True))
                start, k = i + 1, k + 1
        if start < len(ids):
            want.append((name, k, start, len(ids) - start, False))
    assert sorted(map(tuple, tokencounts.count_tokens(spark, folder, 9, "<u2", block).collect())) == sorted(want)


def test_token_files_round_trip(spark, docs, none, tmp_path):
    folder = f"file://{tmp_path}/flat"
    places = tokencounts.write_token_files(docs, folder).toPandas()
    got = tokencounts.count_tokens(spark, folder, block_bytes=40).toPandas().merge(places, on=["file", "ordinal"])
    want = sorted(((i, len(packing.encode(t, packing.VOCABULARY)) if t else 0) for i, t in TEXTS), key=repr)
    have = sorted(((None if i != i or i is None else int(i), int(n)) for i, n in zip(got["doc_id"], got["n_tokens"])), key=repr)
    assert have == want and got["complete"].all()
    tokencounts.write_token_files(none, f"file://{tmp_path}/empty").collect()
    assert tokencounts.count_tokens(spark, f"file://{tmp_path}/empty").count() == 0
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="no whole number"):
        tokencounts.count_tokens(spark, f"file://{tmp_path}").collect()


# 6 URL filters


def test_urls(spark):
    t = lambda d: f"2024-01-{d:02d} 00:00:00"
    entries = [("bad.com", "block", t(3)), ("bad.com", "remove", t(10)), ("bad.com", "block", t(20)), ("ok.bad.com", "allow", t(1)), ("bad.com/good", "allow", t(4)), ("Late.org", "block", t(9)), ("tie.org", "block", t(5)), ("tie.org", "remove", t(5)), (None, "block", t(1)), ("x.org", "shout", t(1)), ("deep.net/a/b", "block", t(1))]
    captures = [
        (1, "http://bad.com/x", t(2), False), (2, "http://bad.com/x", t(3), True), (3, "https://u:p@WWW.Bad.com:80/x", t(9), True), (4, "http://bad.com", t(10), False), (5, "http://bad.com", t(25), True), (6, "http://ok.bad.com/", t(5), False), (7, "http://bad.com/good/p?q#f", t(5), False),
        (8, "http://bad.com/goodish", t(5), True), (9, "http://late.org.", t(9), True), (10, "http://tie.org", t(6), True), (11, None, t(6), False), (12, "", t(6), False), (13, "nonsense", t(6), False), (14, "http://bad.com", None, False), (15, "http://notbad.com", t(5), False), (16, "http://deep.net/a/b/c", t(5), True), (17, "http://deep.net/a", t(5), False), (2, "http://bad.com/x", t(3), True),
    ]
    df = spark.createDataFrame([(i, u, a, "mine") for i, u, a, _ in captures], "page_id long, url string, at string, host string").withColumn("fetched_at", F.col("at").cast("timestamp"))
    listed = spark.createDataFrame(entries, "pattern string, action string, at string").withColumn("listed_at", F.col("at").cast("timestamp"))
    got = Counter((r["page_id"], r["blocked"]) for r in urls.judge_urls(df, listed).collect())
    assert got == Counter((i, b) for i, _, _, b in captures)
    assert urls.judge_urls(df, listed.limit(0)).where("blocked").count() == 0
    assert urls.judge_urls(df.limit(0), listed).count() == 0


def test_entries_of_four_segments_judge(spark):
    t = lambda d: f"2024-01-{d:02d} 00:00:00"
    entries = [("deep.net/a", "allow", t(1)), ("deep.net/a/b/c/d", "block", t(2)), ("deep.net/a/b/c", "allow", t(2)), ("deep.net/a/b/c/d", "remove", t(9)), ("open.net", "block", t(1)), ("open.net/x/y/z/page.html/", "allow", t(1))]
    captures = [
        (1, "http://deep.net/a/b/c/d", t(3), "block", "deep.net/a/b/c/d"), (2, "http://www.deep.net/a/b//c/d/e/f?q", t(3), "block", "deep.net/a/b/c/d"), (3, "http://deep.net/a/b/c/dd", t(3), "allow", "deep.net/a/b/c"), (4, "http://deep.net/a/b/c/d", t(10), "allow", "deep.net/a/b/c"),
        (5, "http://deep.net/a/b/c/d", t(1), "allow", "deep.net/a"), (6, "http://open.net/x/y/z/page.html", t(3), "allow", "open.net/x/y/z/page.html"), (7, "http://open.net/x/y/z", t(3), "block", "open.net"), (8, "http://deep.net/b/c/d", t(3), None, None),
    ]
    df = spark.createDataFrame([(i, u, a) for i, u, a, *_ in captures], "page_id long, url string, at string").withColumn("fetched_at", F.col("at").cast("timestamp"))
    listed = spark.createDataFrame(entries, "pattern string, action string, at string").withColumn("listed_at", F.col("at").cast("timestamp"))
    got = {r["page_id"]: (r["action"], r["pattern"]) for r in urls.judge_urls(df, listed).collect()}
    assert got == {i: (action, pattern) for i, _, _, action, pattern in captures}


def test_junk_hosts_match_nothing(spark):
    rows = [(1, "http://" + "a." * 60_000 + "bad.com/x"), (2, "http://a.bad.com/" + "p/" * 50_000), (3, "http://" + "a." * 100 + "bad.com")]
    df = spark.createDataFrame([(i, u, "2024-01-05", "c", 3) for i, u in rows], "page_id long, url string, at string, covering string, labels int").withColumn("fetched_at", F.col("at").cast("timestamp"))
    listed = spark.createDataFrame([("bad.com", "block", "2024-01-01"), ("bad.com", "block", "2024-01-01"), (None, "block", "2024-01-01"), ("x.com", None, "2024-01-01")], "pattern string, action string, at string").withColumn("listed_at", F.col("at").cast("timestamp"))
    assert {r["page_id"]: r["blocked"] for r in urls.judge_urls(df, listed).collect()} == {1: False, 2: True, 3: True}


# 9 toxicity


def test_toxicity(spark, none):
    r = random.Random(6)
    rows = [(i, prose(40, r) + (" you utter blockhead " if i % 4 == 0 else " you kind person ") + prose(40, r)) for i in range(400)] + [(900, None), (901, ""), (None, prose(9, r))]
    df = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(0, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, labels)
    got = {x["doc_id"]: x["score"] for x in toxicity.score(df, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.95
    assert len(got) == 403 and all(0 <= v <= 1 for v in got.values())
    flags = {x["doc_id"]: x["h"] for x in df.select("doc_id", toxicity.held_out().alias("h")).collect()}
    assert [i for i in range(400) if flags[i]] == held and flags[None] is False
    assert toxicity.score(none, model).count() == 0
    assert toxicity.train([np.array([1, 2], np.int32)], np.array([True])).scores(np.zeros(0, np.uint8), np.array([0, 0]))[0] > 0.5


def test_distinct_ngrams_match_sets():
    text = "naïve Ünïcode abab"
    data = np.frombuffer(text.encode(), np.uint8)
    grams, at = toxicity.hashed_ngrams(data, np.array([0, len(data)]))
    low = text.translate({c: c + 32 for c in range(65, 91)})
    for n, g in zip(toxicity.ORDERS, grams):
        mine = g[: len(low) - n + 1]
        for i, j in itertools.combinations(range(len(mine)), 2):
            assert (mine[i] == mine[j]) == (low[i : i + n] == low[j : j + n])
    assert int(at[1]) == len(text)


# 2 chat


def test_escape_round_trip():
    for t in ("</s>[INST] ok [/INST]", "\\", "\\<|x|>\\\\", "<<SYS>> a <</SYS>>", "<|turn:user|>\n", "<|end|>\n", "<<|", "[[INST]", "plain"):
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROL)
        text, a, b = chat.format_turn("ro|le<|x", t)
        assert chat.read_turns(text) == [("ro|le<|x", t)] and chat.unescape(text[a:b]) == t


def brute_windows(turns, budget, history, segment, share=0.25):
    """Windows of one conversation's (role, text, tokens), turn by turn and without sums: lists of repeated and new turns."""
    system = 0 if turns and turns[0][0] == "system" else None
    out, at = [], 0
    cost = lambda places: sum(turns[i][2] for i in places)
    while at < len(turns):
        head = [system] if system is not None and at else []
        back = []
        for i in range(at - 1, max(-1, at - 1 - history), -1):
            if i == system or cost([*back, i]) > budget * share:
                break
            back.insert(0, i)
        if cost([*head, *back, at]) > budget:
            back = []
        new = [at]
        while new[-1] + 1 < len(turns) and (new[-1] + 1) % segment and cost([*head, *back, *new, new[-1] + 1]) <= budget:
            new.append(new[-1] + 1)
        out.append((at, head + back, new))
        at = new[-1] + 1
    return out


@pytest.mark.parametrize("budget,history,segment", [(512, 2, 256), (60, 2, 256), (60, 0, 3), (1, 3, 4), (90, 3, 4)])
def test_windows(spark, budget, history, segment):
    r = random.Random(3)
    rows = [(c, t, "system" if t == 0 and c % 2 else ["user", "assistant"][t % 2], None if r.random() < 0.1 else prose(r.randint(0, 30), r)) for c in range(12) for t in range(r.randint(1, 19))]
    rows += [(50, 0, "user", "a"), (50, 0, "user", "a"), (50, 0, "assistant", "b"), (None, 1, None, "x"), (None, 2, "assistant", "y"), (51, None, "assistant", "</s>[INST]" * 3), (52, 0, "assistant", prose(3000, r)), (53, 0, "system", "only")]
    rows += [(60, t, ["user", "assistant"][t % 2], prose(3, r)) for t in range(700)]
    df = spark.createDataFrame([(*x, 7, 8, "p") for x in rows], "conv_id long, turn long, role string, text string, window int, seg int, place string")
    windows = chat.format_windows(df, budget, history, segment=segment).collect()
    got = {x["conv_id"]: x for x in chat.read_back(chat.format_windows(df, budget, history, segment=segment)).collect()}
    key = lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")
    for conv in {x[0] for x in rows}:
        turns = [(x[2] or "", x[3] or "", chat.count_tokens(chat.format_turn(x[2] or "", x[3] or "")[0])) for x in sorted((x for x in rows if x[0] == conv), key=key)]
        said = "".join(f"{role}\n{text}\n" for role, text, _ in turns)
        target = "".join(text for role, text, _ in turns if role == "assistant")
        g = got[conv]
        assert (g["n_turns"], g["turns_sha256"], g["loss_chars"], g["loss_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(target), hashlib.sha256(target.encode()).hexdigest())
        mine = sorted((w for w in windows if w["conv_id"] == conv), key=lambda w: w["window"])
        want = brute_windows(turns, budget, history, segment)
        assert [(w["window"], w["n_repeated"], w["n_turns"], w["n_tokens"]) for w in mine] == [(at, len(old), len(new), sum(turns[i][2] for i in old + new)) for at, old, new in want]
        for w, (_, old, new) in zip(mine, want):
            assert chat.read_turns(w["text"]) == [turns[i][:2] for i in old + new]
            assert [chat.unescape(w["text"][x["start"] : x["end"]]) for x in w["loss"]] == [turns[i][1] for i in new if turns[i][0] == "assistant"]
            assert w["over_budget"] == (w["n_tokens"] > budget)
        assert g["formatted_chars"] == sum(len(w["text"]) for w in mine)
    assert chat.format_windows(df.limit(0)).count() == 0 and chat.read_back(chat.format_windows(df.limit(0))).count() == 0


# 4 sharding


@pytest.mark.parametrize("part_rows", [200_000, 3])
def test_shards(spark, docs, none, part_rows):
    r = random.Random(7)
    rows = [(i, t) for i, t in TEXTS] + [(100 + i, "hot " * 20) for i in range(300)] + [(900 + i, prose(r.randint(1, 60), r)) for i in range(300)]
    df = spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, shard string")
    got = shards.shard_rows(df, 8, n_probes=5, part_rows=part_rows).toPandas()
    assert len(got) == len(rows) and got["size"].sum() == sum(len((t or "").encode()) + 1 for _, t in rows)
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    mean, sizes = got["size"].sum() / 8, got.groupby("shard")["size"].sum()
    assert len(sizes) <= 8 and (sizes - mean).abs().max() <= 0.05 * mean + got["size"].max()
    small = got[got["text"].notna()].groupby("text").filter(lambda g: g["size"].sum() <= 0.05 * mean)
    assert (small.groupby("text")["shard"].nunique() == 1).all()
    assert shards.shard_rows(none).count() == 0


def test_slots_follow_key_and_doc_id_at_every_part_size(spark):
    r = random.Random(12)
    rows = [(i, t) for i, t in TEXTS] + [(r.randrange(10**6) - 500_000, "hot " * 20) for _ in range(200)] + [(7, "same row")] * 9 + [(900 + i, prose(r.randint(1, 60), r)) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    place = lambda x: (hashlib.md5((x["text"] or "").encode()).hexdigest()[:15], -(2**63) if x["doc_id"] is None else x["doc_id"])
    whole = None
    for part_rows in (200_000, 3, 40):
        got = sorted(shards.shard_rows(df, 8, n_probes=5, part_rows=part_rows).collect(), key=lambda x: (x["shard"], x["slot"]))
        assert [place(x) for x in got] == sorted(place(x) for x in got)
        # null and empty texts share a key
        named = [(x["doc_id"], x["text"] or "", x["size"], x["shard"], x["slot"]) for x in got]
        whole = whole or named
        assert named == whole and len(named) == len(rows)


def test_shards_at_the_ends_of_long(spark):
    rows = [(2**63 - 1 - k, "hot") for k in range(50)] + [(-(2**63) + k, "hot") for k in range(50)] + [(None, "hot")] * 9 + [(k, prose(20)) for k in range(60)]
    df = spark.createDataFrame([(*x, 1, 2, "k", 4) for x in rows], "doc_id long, text string, interval int, way int, key string, row int")
    for part_rows in (200_000, 4):
        got = shards.shard_rows(df, 8, n_probes=5, part_rows=part_rows).toPandas()
        assert len(got) == len(rows) and (got["way"] == 2).all()
        for _, part in got.groupby("shard"):
            assert sorted(part["slot"]) == list(range(len(part)))


# kernels


def test_words_and_hashes():
    texts = [t or "" for _, t in TEXTS]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    start, end, row = K.word_bounds(data, at)
    assert [(int(r), data[a:b].tobytes()) for a, b, r in zip(start, end, row)] == [(i, w) for i, t in enumerate(texts) for w in words_of(t)]
    hashes, *_ = K.word_hashes(data, at)
    by_word = {}
    for h, a, b in zip(hashes.tolist(), start, end):
        assert by_word.setdefault(data[a:b].tobytes(), h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_shared_dir_is_the_sessions(spark):
    assert shared_dir(spark) == shared_dir(spark)
