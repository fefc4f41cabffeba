"""The pipeline against its own operators put together by hand, stage by stage, and the guard of the entry file."""

import itertools
import os
import random
import subprocess
import sys

import pytest

import corpus_pipeline as C
from auditloom.llm import decontam, neardup, packing, quality, suffix
from auditloom.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in C.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
        seen[name] = (before, docs)
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    first, kept = seen["quality_rules"]
    assert ids(kept) == {r["doc_id"] for r in quality.judge(first, table(spark, SF, "labels")).where("kept").collect()}
    before, kept = seen["minhash_neardup"]
    assert ids(kept) == {r["doc_id"] for r in neardup.near_duplicates(before).where("kept").collect()}
    before, cut = seen["suffix_dedup"]
    report = {r["doc_id"]: r for r in suffix.dedup_report(before).collect()}
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in cut.collect():
        gone = report[r["doc_id"]]["n_removed"]
        assert r["n_chars"] == len(r["text"]) and (gone > 0) == (r["text"] != texts[r["doc_id"]])
        assert len(r["text"].encode()) <= report[r["doc_id"]]["n_bytes"] - gone
    before, kept = seen["decontamination"]
    leaked = {r["doc_id"] for r in decontam.find_leaks(before, table(spark, SF, "benchmark")).collect()}
    assert ids(kept) == ids(before) - leaked
    before, packed = seen["packing"]
    want = sum(len(packing.encode(r["text"], packing.VOCABULARY)) + 1 if r["text"] else 1 for r in before.collect())
    assert packed.agg({"n_tokens": "sum"}).first()[0] == want
    assert ids(packed) == ids(before)


def brute_pipeline(docs, labels, bench):
    """All five stages in plain Python over (doc_id, text): sets, counters and full alignments, no hashes, bands or buckets."""
    import numpy as np

    from .test_operators import brute_components, words_of

    # 1: statistics by hand; the list is learned from them by the learner itself and applied rule by rule
    def stats(text):
        b, w, seen = (text or "").encode(), words_of(text), {}
        for k in range(len(w) - 7):
            seen.setdefault(tuple(w[k : k + 8]), []).append(k)
        repeated = len({j for v in seen.values() if len(v) > 1 for k in v for j in range(k, k + 8)})
        lines = [x for x in b.split(b"\n") if words_of(x.decode())]
        chars = sum(len(x.decode()) for x in w)
        n, c, m = max(1, len(w)), max(1, chars), max(1, len(lines))
        count = lambda marks: sum(x in marks for x in b)
        return {"n_words": len(w), "word_len": chars / n, "symbols_per_word": count(b"#*$%&|<>") / n, "dup_line_share": (len(lines) - len(set(lines))) / m, "repeat_share": repeated / n, "upper_share": sum(65 <= x <= 90 for x in b) / c,
                "marks_per_word": count(b"!?.,;:") / n, "digit_share": sum(48 <= x <= 57 for x in b) / c, "words_per_line": len(w) / m}, len(w) < 20 or 100 * repeated > 30 * len(w)

    judged = [(i, t, *stats(t)) for i, t in docs]
    learn = [(i, x, labels[i]) for i, _, x, failed in judged if i in labels and not failed]
    fold = quality.K.mix(np.array([i for i, *_ in learn], np.uint64)) % np.uint64(3)
    names = list(learn[0][1])
    rules = quality.learn_rules({k: np.array([x[k] for _, x, _ in learn], float) for k in names}, np.array([q == 0 for *_, q in learn]), fold.astype(int))
    covered = lambda x: any(all(x[n] >= t if op == ">=" else x[n] <= t for n, op, t in r.conditions) for r in rules)
    docs = [(i, t) for i, t, x, failed in judged if not failed and not covered(x)]
    # 2
    root = brute_components(docs)
    docs = [(i, t) for i, t in docs if root[i] == i]
    # 3
    starts = {}
    for _, t in docs:
        for p in range(len(t.encode()) - 199):
            w = t.encode()[p : p + 200]
            starts[w] = starts.get(w, 0) + 1
    cut = []
    for i, t in docs:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if starts[b[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        at, kept = 0, []
        for ch in t:
            size = len(ch.encode())
            if not any(gone[at : at + size]):
                kept.append(ch)
            at += size
        cut.append((i, "".join(kept)))
    # 4
    as_words = lambda t: decontam._words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]
    leaked = set()
    for (i, t), (_, item) in itertools.product(cut, bench):
        x, y = as_words(item), as_words(t)
        shared = {tuple(x[k : k + 3]) for k in range(len(x) - 2)} & {tuple(y[k : k + 3]) for k in range(len(y) - 2)}
        if shared and decontam.align(*decontam._padded([x]), *decontam._padded([y]))[0][0] >= decontam.THRESHOLD * decontam.MATCH * len(x):
            leaked.add(i)
    # 5: pieces of at most 2,048 tokens
    pieces = {}
    for i, t in cut:
        if i not in leaked:
            n = len(packing.encoder(packing.VOCABULARY).encode_ordinary(t)) + 1
            pieces |= {(i, k): min(2048, n - k * 2048) for k in range(-(-n // 2048))}
    return pieces


def test_pipeline_matches_brute_force(spark, tmp_path):
    r = random.Random(77)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu", "ra", "si", "to") for b in ("n", "r", "st", "l", "m", "nd", "x", "ber", "ing", "ou")]
    prose = lambda n: " ".join(r.choice(words) + str(r.randrange(9)) for _ in range(n))
    bench = [(k, prose(30)) for k in range(5)]
    passage = prose(60)
    docs = [(k, prose(r.randint(25, 120))) for k in range(60)]
    docs += [(100 + k, " ".join("$#%" if r.random() < 0.4 else w for w in prose(60).split())) for k in range(40)]  # noise
    docs += [(200 + k, docs[k][1].replace(" ", " changed ", 1) if k % 2 else docs[k][1]) for k in range(15)]  # near and exact copies
    docs += [(300 + k, f"{prose(40)} {passage} {prose(30)}") for k in range(6)]  # a passage that repeats
    docs += [(400 + k, f"{prose(30)} {bench[k][1]} {prose(30)}") for k in range(4)]  # a test item
    docs += [(500, None), (501, ""), (502, prose(5)), (503, "same thing over " * 30), (504, prose(3000)), (505, "über größe naïve " + prose(40))]
    labels = {i: int(not 100 <= i < 140) for i, _ in docs if i % 3}
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = C.run(spark, str(tmp_path)).collect()
    want = brute_pipeline(docs, labels, bench)
    assert {(x["doc_id"], x["piece"]): x["n_tokens"] for x in got} == want and len(got) == len(want)
    assert 0 < len({i for i, _ in want}) < 90 and not {i for i, _ in want} & ({*range(400, 404)} | {500, 501, 502, 503})


def test_rest_stands_alone(tmp_path):
    """Without this folder and its pipeline, the entry file still imports."""
    import shutil

    root = os.path.dirname(os.path.abspath(C.__file__))
    shutil.copytree(f"{root}/auditloom", tmp_path / "auditloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op1') for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True, timeout=120)
