"""Further columns, whatever their names, through every operator that hands them on and every stage; settings that must not matter."""

import datetime
import random

import pytest

from auditloom.llm import decontam, neardup, packing, quality, shards, suffix, urls
from auditloom.llm.common import WorkDir

from .test_operators import prose

R = random.Random(3)
SF = "/root/testdata/sf0.001"
ODD = {"a.b": 1, "_url": "u", "_at": 2, "best": 3, "SIZE": 4, "Shard": 5, "row": "r", "key": 6, "tid": "t", "rid": 7, "text_": "x", "_row": 8, "slot ": 9, "`q`": 10}
BASE = prose(150, R)


@pytest.fixture(scope="module")
def docs(spark):
    texts = [BASE, BASE, BASE.upper(), prose(80, R), "", None, prose(300, R) + BASE]
    rows = [(i if i != 5 else None, t, "en", "s", len(t) if t else None, *ODD.values()) for i, t in enumerate(texts)]
    kinds = ", ".join(f"`{k.replace('`', '``')}` {'string' if isinstance(v, str) else 'int'}" for k, v in ODD.items())
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {kinds}")


def values(df, names):
    return sorted(map(repr, (tuple(r[df.columns.index(c)] for c in names) for r in df.collect())))


@pytest.mark.parametrize("stage", [quality.keep_good, neardup.keep_one, suffix.cut_repeats, decontam.drop_leaks])
def test_stages_keep_odd_columns(spark, docs, stage):
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    assert {tuple(r[5:]) for r in out.collect()} <= {tuple(ODD.values())}


def test_last_stage_ignores_them(spark, docs):
    assert packing.pack_documents(spark, docs, SF).count() == 7


def test_shards_of_odd_columns(spark, docs):
    out = shards.shard_rows(docs)
    assert out.columns == [c for c in docs.columns if c not in ("SIZE", "Shard")] + ["size", "shard", "slot"]
    assert len(out.select("size", "shard", "slot").collect()) == 7


def test_urls_of_odd_columns_and_empty_segments(spark):
    at = datetime.datetime(2024, 5, 1)
    names = [c for c in ODD if c not in ("row",)]
    kinds = ", ".join(f"`{k.replace('`', '``')}` {'string' if isinstance(ODD[k], str) else 'int'}" for k in names)
    rows = [(u, at, *(ODD[k] for k in names)) for u in ("http://a.org/x/y", "http://a.org//x///y/z", "http://a.org/x", "http://b.org/", None)]
    captures = spark.createDataFrame(rows, f"url string, fetched_at timestamp, {kinds}")
    entries = spark.createDataFrame([("A.org//x/y", "block", datetime.datetime(2024, 1, 1)), ("b.org//", "block", datetime.datetime(2024, 1, 1))], "pattern string, action string, listed_at timestamp")
    out = urls.judge_urls(captures, entries)
    assert out.columns == captures.columns + list(urls.OUT)
    assert {r["url"]: r["blocked"] for r in out.collect()} == {"http://a.org/x/y": True, "http://a.org//x///y/z": True, "http://a.org/x": False, "http://b.org/": True, None: False}


def test_packing_is_the_same_under_any_setting(spark):
    sizes = spark.createDataFrame([(k % 700 if k % 50 else None, R.randint(1, 5000), k) for k in range(900)], "doc_id long, n_tokens long, salt long")
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("4", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(sorted(map(repr, packing.pack(sizes).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]


def test_work_folders_are_seen_by_their_own_caller(spark):
    outside = WorkDir(spark, "outside")
    with WorkDir.opened() as one:
        inner = WorkDir(spark, "inner")
        with WorkDir.opened() as two:
            deep = WorkDir(spark, "deep")
    after = WorkDir(spark, "after")
    assert one == [inner] and two == [deep] and outside not in one and after not in one
