"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct hashed n-grams of its characters (A-Z lower-cased), for each length in ORDERS. With p
and q the smoothed counts of toxic and other training documents that hold a feature, its value is the log-count ratio
r = log((p / |p|) / (q / |q|)), and a logistic regression with L2 penalty is fitted to those values. Features whose ratio is
under `least` standard errors, sqrt(1/p + 1/q), are left out: long texts hold thousands of such, which would drown the few that
tell. `least`, the penalty and the bias that makes 0.5 the best threshold are chosen by cross-validation inside the training
rows. As the model is linear, ratio and weight fold into one number a feature, so scoring is one lookup and sum.

Training reads at most `max_docs` labelled documents (those with the smallest hash of doc_id) and only the whole texts of
these; every document is scored on its whole text. labels, lang, source and doc_id are no inputs of a score.

Defined results: null or empty texts score by the bias alone; without labels of both classes every score is the smoothed
share of toxic labels; where a doc_id has several labels the largest counts; rows that repeat a doc_id are scored each on its
own text, and each is a training document where the doc_id is labelled; a null doc_id is scored and not held out; a very long
text is scored whole, on its own; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import column, slices, table, text_bytes

ORDERS = (4, 5, 6)
BITS = 20
FOLDS = 5
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def hashed_ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order, the feature number of the n-gram that starts at each character; and character offsets of the rows.
    The last n - 1 characters of a row start no n-gram of it."""
    text = data.tobytes().decode("utf-8")
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    capital = (chars >= 65) & (chars <= 90)
    chars[capital] += np.uint64(32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    out, acc = [], chars.copy()
    for n in range(1, max(ORDERS) + 1):
        if n > 1:
            acc = acc[:-1] * _STEP + chars[n - 1 :] if len(acc) > 1 else acc[:0]
        if n in ORDERS:
            out.append((K.mix(acc + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int32))
    return out, lead[offsets]


class _Distinct:
    """Distinct feature numbers of one row after another, without sorting."""

    def __init__(self):
        self.last, self.ordinal = np.zeros(1 << BITS, np.int32), np.arange(1, dtype=np.int32)

    def __call__(self, grams: list[np.ndarray], a: int, b: int) -> np.ndarray:
        idx = np.concatenate([g[a : max(a, b - n + 1)] for n, g in zip(ORDERS, grams)])
        if len(self.ordinal) < len(idx):
            self.ordinal = np.arange(2 * len(idx), dtype=np.int32)
        own = self.ordinal[: len(idx)]
        self.last[idx] = own
        return idx[self.last[idx] == own]


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        grams, at = hashed_ngrams(data, offsets)
        distinct = _Distinct()
        z = np.array([self.weights[distinct(grams, a, b)].sum(dtype=np.float64) for a, b in zip(at[:-1].tolist(), at[1:].tolist())])
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -30, 30)))


def _ratios(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.log((p / p.sum()) / (q / q.sum()))


def log_count_ratios(flat: np.ndarray, owner_toxic: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) of each feature; owner_toxic: whether the document is toxic of which each entry of flat is a feature."""
    return _ratios(alpha + np.bincount(flat[owner_toxic], minlength=1 << BITS), alpha + np.bincount(flat[~owner_toxic], minlength=1 << BITS))


#: Features that training works on at a time.
CHUNK = 2_000_000
#: What cross-validation chooses from.
LEASTS, PENALTIES, CV_FOLDS = (2.0, 3.0, 4.0), (5.0, 50.0), 3


def _chunks(rows: list[np.ndarray]) -> list[tuple[int, int]]:
    """Runs of whole documents of about CHUNK features."""
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    cuts = [0]
    while cuts[-1] < len(rows):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(at, at[cuts[-1]] + CHUNK, side="right")) - 1))
    return list(zip(cuts, cuts[1:]))


def feature_counts(rows: list[np.ndarray]) -> np.ndarray:
    """How many documents hold each feature."""
    out = np.zeros(1 << BITS, np.int64)
    for i, j in _chunks(rows):
        out += np.bincount(np.concatenate(rows[i:j]), minlength=1 << BITS)
    return out


def _constant(toxic: np.ndarray) -> Model:
    share = (toxic.sum() + 1) / (len(toxic) + 2)
    return Model(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))


def train(rows: list[np.ndarray], toxic: np.ndarray, l2: float = 5.0, rounds: int = 60, alpha: float = 1.0, least: float = 0.0, counts=None) -> Model:
    """rows: distinct feature numbers of each document; counts: of toxic and other documents, where they are known. Memory: 4 bytes
    a feature of each, and a chunk's numbers."""
    if not toxic.any() or toxic.all():
        return _constant(toxic)
    of = lambda which: [r for r, t in zip(rows, toxic) if t == which]
    p, q = (alpha + c for c in (counts or (feature_counts(of(True)), feature_counts(of(False)))))
    ratio = _ratios(p, q)
    keep = np.abs(ratio) >= least * np.sqrt(1 / p + 1 / q)
    number = np.cumsum(keep) - 1
    rows = [number[r[keep[r]]].astype(np.int32) for r in rows]
    size, kept = max(1, int(keep.sum())), ratio[keep]
    if not len(kept):
        return _constant(toxic)
    length = np.array([len(r) for r in rows])
    squares = np.array([(kept[r] ** 2).sum() for r in rows])
    scale = max(np.sqrt(squares.sum() / len(rows)), 1e-9)
    value = (kept / scale).astype(np.float32)
    # each class weighs as much as the other, so that a rare class is not drowned
    weight = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())
    w, bias, y = np.zeros(size, np.float32), 0.0, toxic.astype(float)
    v, vb, m, mb = np.zeros(size), 0.0, np.zeros(size), 0.0
    cuts = _chunks(rows)
    for t in range(1, rounds + 1):  # Adam over all rows
        product, g, gb = value * w, np.zeros(size), 0.0
        for i, j in cuts:
            part, own = np.concatenate(rows[i:j]), length[i:j]
            z = np.full(j - i, bias)
            if len(part):
                z[own > 0] += np.add.reduceat(product[part], (np.cumsum(own) - own)[own > 0])
            err = weight[i:j] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i:j])
            g += np.bincount(part, weights=np.repeat(err, own), minlength=size)
            gb += err.sum()
        g = g * value + l2 * w / len(rows) / 100
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= (0.3 * (m / c1) / (np.sqrt(v / c2) + 1e-8)).astype(np.float32)
        bias -= 0.3 * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    weights = np.zeros(1 << BITS, np.float32)
    weights[keep] = w * value
    return Model(weights, float(bias))


def best_threshold(z: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """(F1, threshold) where the harmonic mean of precision and recall is largest: midway between two scores."""
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + toxic.sum())
    f1[:-1][np.diff(z[order]) == 0] = 0  # no cut between equal scores
    k = int(f1.argmax())
    low = z[order[k + 1]] if k + 1 < len(z) else z[order[k]] - 1
    return float(f1[k]), float((z[order[k]] + low) / 2)


def cross_validated(rows: list[np.ndarray], toxic: np.ndarray) -> Model:
    """The model of all rows, with the settings that predict left-out folds best, its bias moved to their best threshold."""
    fold = np.arange(len(rows)) % CV_FOLDS
    whole = (feature_counts([r for r, t in zip(rows, toxic) if t]), feature_counts([r for r, t in zip(rows, toxic) if not t]))
    if min(np.bincount(fold[toxic], minlength=CV_FOLDS).min(), np.bincount(fold[~toxic], minlength=CV_FOLDS).min()) < 2:
        return train(rows, toxic, counts=whole)
    left_out = {(least, l2): np.zeros(len(rows)) for least in LEASTS for l2 in PENALTIES}
    for k in range(CV_FOLDS):
        rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        counts = tuple(c - feature_counts([rows[i] for i in own if toxic[i] == side]) for c, side in zip(whole, (True, False)))
        for (least, l2), z in left_out.items():
            model = train([rows[i] for i in rest], toxic[rest], l2, least=least, counts=counts)
            z[own] = [model.weights[rows[i]].sum(dtype=np.float64) + model.bias for i in own]
    judged = {s: best_threshold(z, toxic) for s, z in left_out.items()}
    least, l2 = max(judged, key=lambda s: judged[s][0])
    out = train(rows, toxic, l2, least=least, counts=whole)
    return Model(out.weights, out.bias - judged[least, l2][1])


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 4000) -> Model:
    """Learn from at most `max_docs` labelled documents that are not held out."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).join(F.broadcast(sample), "doc_id")  # bounded by max_docs

    def run(batches):
        distinct = _Distinct()
        for batch in batches:
            data, offsets = text_bytes(column(batch, "text"))
            for i, j, part, at in slices(data, offsets):
                grams, where = hashed_ngrams(part, at)
                sets = [np.sort(distinct(grams, a, b)).tobytes() for a, b in zip(where[:-1].tolist(), where[1:].tolist())]
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id").slice(i, j - i), column(batch, "toxic").slice(i, j - i), pa.array(sets, pa.binary())], ["doc_id", "toxic", "features"])

    got = rows.mapInArrow(run, "doc_id long, toxic int, features binary").toArrow().sort_by("doc_id")
    return cross_validated([np.frombuffer(x.as_buffer(), np.int32) for c in got["features"].chunks for x in c], got["toxic"].to_numpy() == 1)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights, whatever the input

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(column(batch, "text"))
            for i, j, part, at in slices(data, offsets):
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id").slice(i, j - i), pa.array(shared.value.scores(part, at))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
