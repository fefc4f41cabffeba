"""Near-duplicates and suffix dedup beyond the common cases: repeated and null ids, ties, clashing columns, crowded buckets, long texts."""

import random
from collections import Counter

import numpy as np
import pytest

from auditloom.llm import neardup, quality, suffix

from .test_operators import R, brute_components, brute_removed, prose


@pytest.mark.parametrize("seed", range(12))
def test_block_sort_matches_counts(seed):
    r = random.Random(seed)
    size, alphabet = r.choice([61, 77, 100, 200]), "ab" if seed % 3 == 0 else "abcd "
    base = "".join(r.choice(alphabet) for _ in range(900))
    text = "".join(base[(a := r.randrange(500)) : a + r.randrange(1, 400)] + "".join(r.choice(alphabet) for _ in range(r.randrange(9))) for _ in range(40)) + "z" * 700 * (seed % 4 == 0)
    data = np.frombuffer(text.encode(), np.uint8)
    start = np.array(r.sample(range(len(data) - size + 1), 3000))
    count = Counter(text[s : s + size] for s in start.tolist())
    got = suffix.BlockSort(data, start, suffix.Plan(size)).repeated(r.choice([1, 50, 10**6]))
    assert got.tolist() == [count[text[s : s + size]] > 1 for s in start.tolist()]


def test_cells_hold_every_window_once():
    r = random.Random(8)
    for size in (61, 200):
        plan = suffix.Plan(size)
        raw = [("".join(r.choice("abcd ") for _ in range(r.choice([0, 5, size - 1, size, size + 1, 700])))).encode() for _ in range(60)] + [b"z" * 500]
        data, at = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in raw])])
        got = suffix._cells(data, at, plan)
        windows = Counter((int(i), int(a - x)) for i, a, lo, hi in zip(got["row"], got["anchor"], got["r_lo"], got["r_hi"]) for x in range(lo, hi + 1))
        assert windows == Counter((i, p) for i, b in enumerate(raw) for p in range(len(b) - size + 1))
        assert all((lo >= plan.half) == (hi >= plan.half) for lo, hi in zip(got["r_lo"], got["r_hi"]))
        assert (suffix._cells(data, at, plan, False)["key"] == got["key"]).all()


def test_cover_and_steps():
    assert {(a - b) % suffix.PERIOD for a in suffix.COVER for b in suffix.COVER} == set(range(suffix.PERIOD))
    data = np.frombuffer(b"banana bandana banana band " * 30, np.uint8)
    at = np.array([p for p in range(len(data) - 61) if p % suffix.PERIOD in suffix.COVER])
    sort = suffix.BlockSort(data, at, suffix.Plan(61))
    rank, raw = sort.rank_at(at), data.tobytes()
    ordered = sorted(zip(at.tolist(), rank.tolist()), key=lambda x: raw[x[0] : x[0] + 49])
    assert all(a[1] <= b[1] and (a[1] == b[1]) == (raw[a[0] : a[0] + 49] == raw[b[0] : b[0] + 49]) for a, b in zip(ordered, ordered[1:]))


def test_repeated_and_null_ids_keep_texts_apart(spark):
    r = random.Random(21)
    a, c = prose(60, r), prose(60, r)
    rows = [(None, a), (1, a), (None, c), (None, None), (None, ""), (-(2**63), c[:40]), (2, prose(80, r)), (2, prose(80, r)), (2, prose(80, r) + a[:250])]
    rows += [(7, prose(40, r) + str(k)) for k in range(30)] + [(7, prose(40, r))] * 2
    got = suffix.dedup_report(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_removed(rows, 200)


def test_dedup_hands_clashing_columns_on(spark):
    a = prose(80)
    rows = [(1, f"{a} x", 5, b"t", "r", 1, "w", 1.5), (2, a, 6, None, "r", 2, "w", None), (3, None, 7, b"u", "s", 3, "v", 2.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int, tid binary, row string, _runs int, cells string, first double")
    got = {x["doc_id"]: x for x in suffix.dedup_texts(df).collect()}
    assert suffix.dedup_texts(df).columns == df.columns
    assert all(tuple(got[x[0]])[2:] == tuple(bytearray(v) if isinstance(v, bytes) else v for v in x[2:]) for x in rows)
    assert got[2]["text"] == "" and got[3]["text"] is None and got[1]["text"] == " x"


def test_near_duplicates_of_repeated_ids(spark):
    r = random.Random(31)
    rows = []
    for k in range(30):
        first, second = prose(60, r).split(), prose(70, r)
        copy = list(first)
        copy[r.randrange(60)] = "changed"
        rows += [(500 + k, " ".join(first)), (500 + k, second), (100 + k, " ".join(copy)), (900 + k, second + " end"), (900 + k, None)]
    rows += [(None, rows[0][1]), (None, rows[0][1]), (2**63 - 1, rows[0][1])]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_components(rows)
    assert want[500] == 100 and want[900] == 100
    assert len(got) == len(rows) and all(x["component_id"] == want[x["doc_id"]] and x["kept"] == (x["doc_id"] == x["component_id"] or x["doc_id"] is None) for x in got)


@pytest.mark.parametrize("crowd", [0, 40])
def test_crowded_buckets_lose_no_link(spark, crowd, monkeypatch):
    """Texts that share a template crowd the bands; groups of near copies among them are found all the same."""
    monkeypatch.setattr(neardup, "ROUNDS", 0)
    r = random.Random(17)
    template = prose(70, r).split()
    rows = []
    for k in range(60):
        own = template + [f"own{k}x{j}" for j in range(r.randint(5, 40))]
        rows.append((k, " ".join(own)))
        if k % 5 == 0:
            rows += [(1000 + 10 * k + j, " ".join([*own, f"more{j}"])) for j in range(3)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=7, crowd=crowd).collect()
    want = brute_components(rows)
    assert {x["doc_id"]: x["component_id"] for x in got} == want


def test_prefix_filter_deals_less_than_all_pairs(spark):
    """A bucket of unlinked texts with a common template: the prefixes hold no shingle of the template."""
    from auditloom.llm.common import WorkDir, named_texts

    r = random.Random(5)
    template = prose(60, r)
    df = spark.createDataFrame([(k, f"{template} " + " ".join(f"own{k}x{j}" for j in range(40))) for k in range(300)], "doc_id long, text string")
    work = WorkDir(spark, "test")
    sets = work.cut(neardup.doc_sets(df), "sets")
    classes = work.cut(sets.selectExpr("doc_id as id", "tid", "sig"), "classes")
    dealt = neardup._prefixes(named_texts(df), classes, classes.selectExpr("id"), 75, work)
    assert dealt.count() == 0


@pytest.mark.parametrize("stage", [quality.keep_good, neardup.keep_one, suffix.cut_repeats])
def test_stages_on_odd_tables(spark, stage, tmp_path):
    """Columns named like the stages' own, nulls, repeated rows, and empty tables."""
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    a, b = prose(90, R), prose(90, R)
    rows = [(1, a, 3, "r"), (1, a, 4, None), (2, b, 5, "r"), (None, b, 6, "s"), (None, None, 7, "t"), (3, "", None, "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, source string").selectExpr("*", "1 as _stat_n_words", "2 as _runs", "3 as _doc", "4 as _gone", "5 as row", "6 as tid", "7 as gone", "'k' as size", "8 as n_words", "9 as rule")
    for table in (df, df.limit(0)):
        out = stage(spark, table, str(tmp_path))
        assert out.columns == df.columns and out.dtypes == df.dtypes
        got = out.collect()
        assert all((x["_runs"], x["_gone"], x["size"], x["source"]) == (2, 4, "k", x["source"]) for x in got)
    if stage is suffix.cut_repeats:
        got = stage(spark, df, str(tmp_path)).collect()
        assert sorted(((x["doc_id"], x["text"]) for x in got), key=repr) == sorted([(1, ""), (1, ""), (2, ""), (None, ""), (None, None), (3, "")], key=repr)
    if stage is neardup.keep_one:
        assert sorted((x["doc_id"] for x in stage(spark, df, str(tmp_path)).collect()), key=repr) == sorted([1, 1, 2, None, None, 3], key=repr)
    if stage is quality.keep_good:
        assert sorted((x["doc_id"] for x in stage(spark, df, str(tmp_path)).collect()), key=repr) == sorted([1, 1, 2, None], key=repr)
