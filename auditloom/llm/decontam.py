"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, lower-cased (A-Z and Latin-1); the n-grams of a test item are its seeds. A first pass over the
documents counts how many hold each seed. Seeds that none holds go. A seed is common if more than COMMON_ITEMS items share it, or
more than COMMON_DOCS documents and one in COMMON_SHARE of all; the rest are rare. A second pass joins documents to items:
a rare seed alone makes a pair of document and item. A common seed makes none, and so a phrase that all items share costs nothing,
except for an item of which common seeds cover `threshold` of the words or more: nothing rare need be left of its copy, so all its
seeds join, each beside a second one of the item near the same diagonal. For each pair, the item's words
are aligned with the document's words around the seeds: match 2, other word -1, gap -1. The score is the best
local alignment over that of the item with itself; at `threshold` or more the document holds a copy, edited or not. A copy
without n consecutive words of its item is not seen, nor one whose only such words are common, of an item that is not covered by them.

Items are broadcast in blocks of at most BLOCK_BYTES of text, whatever the size of the benchmark; documents are only ever
read, never shuffled. Counts are summed by seed and bounded by the block.

Defined results: null or empty documents hold nothing; null or empty items are found nowhere; items under n words are
seeded by all their words; repeated rows are judged each on its own; rows with a null doc_id or item_id are judged too, and ids may have any type; very
long texts are searched whole; empty tables give no rows; further columns, whatever their names, pass through `without_leaks`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import kernels as K
from .common import column, row_struct, slices, table, text_bytes

N = 3
THRESHOLD = 0.45
BLOCK_BYTES = 8_000_000
COMMON_ITEMS, COMMON_DOCS, COMMON_SHARE = 64, 64, 1000
MATCH, OTHER, GAP = 2, 1, 1

_WORD = K.LOWER.copy()
_WORD[[c for c in range(128) if not chr(c).isalnum()]] = 32


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    plain = _WORD[data]
    latin = np.flatnonzero(data[:-1] == 0xC3) + 1  # capital letters of Latin-1
    latin = latin[(data[latin] >= 0x80) & (data[latin] <= 0x9E) & (data[latin] != 0x97)]
    plain[latin] += 0x20
    words, _, _, row = K.word_hashes(plain, offsets)
    return words, row


@dataclass
class Items:
    """A block of test items: their words end to end, and the seeds that point into them."""

    ids: list
    words: np.ndarray
    first: np.ndarray  # n + 1 offsets into words
    sizes: list[int]  # lengths of seeds
    seeds: np.ndarray  # sorted distinct hashes
    posting: np.ndarray  # offsets into the three below, one more than seeds
    item: np.ndarray
    at: np.ndarray
    table: np.ndarray  # of 2**k flags, true where some seed's low bits fall
    alone: np.ndarray  # beside item and at: whether one hit makes a pair

    def lookup(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of grams that are seeds, and which."""
        maybe = np.flatnonzero(self.table[grams & np.uint64(len(self.table) - 1)])
        if not len(maybe) or not len(self.seeds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.seeds, grams[maybe]), len(self.seeds) - 1)
        same = self.seeds[at] == grams[maybe]
        return maybe[same], at[same]


def _indexed(ids, words, first, sizes, seed, item, at, alone=None) -> Items:
    order = np.lexsort((at, item, seed))
    seed, item, at, alone = seed[order], item[order], at[order], np.ones(len(seed), bool) if alone is None else alone[order]
    seeds, start = np.unique(seed, return_index=True)
    flags = np.zeros(1 << max(12, (32 * max(1, len(seeds))).bit_length()), bool)
    flags[seeds & np.uint64(len(flags) - 1)] = True
    return Items(ids, words, first, sizes, seeds, np.append(start, len(seed)), item, at, flags, alone)


def build_items(rows: list[tuple], n: int = N) -> Items:
    """rows: (item_id, text)."""
    data, offsets = text_bytes(pa.array([t for _, t in rows], pa.string()))
    words, row = _words(data, offsets)
    count = np.bincount(row, minlength=len(rows))
    seed, item, at = [], [], []
    sizes = sorted({min(n, int(c)) for c in count if c})
    for size in sizes:
        grams, where = K.ngram_hashes(words, row, size)
        use = np.minimum(count[row[where]], n) == size
        seed.append(grams[use] + np.uint64(size))
        item.append(row[where][use])
        at.append(where[use])
    first = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    item = joined(item, np.int64)
    return _indexed([i for i, _ in rows], words, first, sizes, joined(seed, np.uint64), item, joined(at, np.int64) - first[item])


def driving(items: Items, held: np.ndarray, n_docs: int, threshold: float) -> Items:
    """The seeds that join. held: the number of documents that hold each seed."""
    size = np.diff(items.posting)
    seed = np.repeat(np.arange(len(size)), size)
    pair = np.unique(seed * (len(items.ids) + 1) + items.item)
    n_items = np.bincount(pair // (len(items.ids) + 1), minlength=len(size))
    common = ((n_items > COMMON_ITEMS) | (held > max(COMMON_DOCS, n_docs / COMMON_SHARE)))[seed]
    length = np.diff(items.first)
    width = np.minimum(length, max(items.sizes, default=0))[items.item]
    cover = np.zeros(len(items.words) + 1, np.int64)  # how many common seeds lie over each word
    begin = items.first[items.item] + items.at
    np.add.at(cover, begin[common], 1)
    np.add.at(cover, (begin + width)[common], -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    full = (covered[items.first[1:]] - covered[items.first[:-1]]) >= threshold * length
    use = (held[seed] > 0) & (~common | full[items.item])
    return _indexed(items.ids, items.words, items.first, items.sizes, items.seeds[seed][use], items.item[use], items.at[use], ~common[use])


def _hits(items: Items, words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, seed) of each seed in the documents' words."""
    out = []
    for size in items.sizes:
        grams, at = K.ngram_hashes(words, row, size)
        found, seed = items.lookup(grams + np.uint64(size))
        out.append((at[found], seed))
    return (np.concatenate([a for a, _ in out]), np.concatenate([s for _, s in out])) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def align(items: np.ndarray, item_len: np.ndarray, docs: np.ndarray, doc_len: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each row of two padded word matrices, and where it ends in the document.

    The items' words are taken in turn; a row of the score matrix is computed for all pairs and all document words at
    once, gaps along the row by a running maximum."""
    pairs, wide = docs.shape
    slope = GAP * np.arange(1, wide + 1, dtype=np.int32)
    h = np.zeros((pairs, wide + 1), np.int32)
    best, end = np.zeros(pairs, np.int32), np.zeros(pairs, np.int64)
    inside = np.arange(wide) < doc_len[:, None]
    for i in range(items.shape[1]):
        step = np.where(docs == items[:, i : i + 1], MATCH, -OTHER).astype(np.int32)
        x = np.maximum(np.maximum(h[:, :-1] + step, h[:, 1:] - GAP), 0)
        x[~inside] = 0
        new = np.maximum(np.maximum.accumulate(x + slope, axis=1) - slope, 0)
        live = i < item_len
        h[live, 1:] = new[live]
        top = new.argmax(axis=1)
        score = new[np.arange(pairs), top]
        better = live & (score > best)
        best[better], end[better] = score[better], top[better]
    return best, end


def _padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(p) for p in parts])
    out = np.zeros((len(parts), max(1, size.max())), np.uint64)
    for i, p in enumerate(parts):
        out[i, : len(p)] = p
    return out, size


def _regions(doc: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: np.ndarray) -> list[list[int]]:
    """(doc, item, first word, end word) of stretches that hold all of [lo, hi), which are at most `width` long. Those that overlap
    are one stretch; one of over four widths is cut into such that overlap by a width, so each [lo, hi) lies in one whole."""
    order = np.lexsort((lo, item, doc))
    doc, item, lo, hi, width = doc[order], item[order], lo[order], hi[order], width[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    far = (int(hi.max()) + 1) * (np.cumsum(new) - 1)  # moves the pairs of document and item apart
    reach = np.maximum.accumulate(hi + far)
    new[1:] |= (lo + far)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    begin, end, width = lo[first], np.maximum.reduceat(hi, first), width[first]
    pieces = np.maximum(1, -(-(end - begin - width) // (3 * width)))
    of = np.repeat(np.arange(len(first)), pieces)
    at = begin[of] + 3 * width[of] * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    stop = np.minimum(at + 4 * width[of], end[of])
    return [list(x) for x in zip(doc[first][of].tolist(), item[first][of].tolist(), at.tolist(), stop.tolist())]


def _leaks(items: Items, words: np.ndarray, row: np.ndarray, threshold: float) -> list[tuple[int, int, float, int, int]]:
    """(row, item, score, first word, end word) of the best copy of each item in each row."""
    at, seed = _hits(items, words, row)
    if not len(at):
        return []
    n = items.posting[seed + 1] - items.posting[seed]
    post = np.repeat(items.posting[seed] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    word = np.repeat(at, n)
    item, diag, doc = items.item[post], word - items.at[post], row[word]
    length = (items.first[1:] - items.first[:-1])[item]
    slack = np.maximum(8, length // 4)
    begin, end = np.searchsorted(row, doc, "left"), np.searchsorted(row, doc, "right")
    lo, hi = np.maximum(begin, diag - slack), np.minimum(end, diag + length + slack)
    use = items.alone[post] | (length <= max(items.sizes))  # an item of one seed has no second
    if not use.all():
        order = np.lexsort((diag, item, doc))
        near = (np.diff(doc[order]) == 0) & (np.diff(item[order]) == 0) & (np.diff(diag[order]) <= slack[order[1:]])
        use[order[1:][near]] = use[order[:-1][near]] = True
        if not use.any():
            return []
        doc, item, lo, hi, length, slack = (x[use] for x in (doc, item, lo, hi, length, slack))
    regions = _regions(doc, item, lo, hi, length + 2 * slack)
    regions.sort(key=lambda x: (x[3] - x[2], items.first[x[1] + 1] - items.first[x[1]]))
    best: dict[tuple[int, int], tuple[float, int, int]] = {}  # share, region, last word in it
    sides = lambda part: ([items.words[items.first[t] : items.first[t + 1]] for _, t, _, _ in part], [words[a:b] for _, _, a, b in part])
    for k, j in _runs([b - a for _, _, a, b in regions]):
        texts, spans = sides(regions[k:j])
        score, last = align(*_padded(texts), *_padded(spans))
        share = score / (MATCH * np.array([len(t) for t in texts]))
        for i in np.flatnonzero(share >= threshold).tolist():
            pair = (regions[k + i][0], regions[k + i][1])
            if pair not in best or share[i] > best[pair][0]:
                best[pair] = (float(share[i]), k + i, int(last[i]))
    # the same alignments backwards end where these start
    found, out = list(best.items()), []
    for k, j in _runs([last + 1 for _, (_, _, last) in found]):
        texts, spans = sides([regions[r] for _, (_, r, _) in found[k:j]])
        back = align(*_padded([t[::-1] for t in texts]), *_padded([x[: last + 1][::-1] for x, (_, (_, _, last)) in zip(spans, found[k:j])]))[1]
        for ((d, t), (share, r, last)), b in zip(found[k:j], back.tolist()):
            at = regions[r][2] - begin_of(row, d) + last
            out.append((d, t, share, at - b, at + 1))
    return out


def _runs(widths: list[int]) -> list[tuple[int, int]]:
    """Runs of alignments that take a matrix of about 200,000 words, or one each."""
    out, k = [], 0
    while k < len(widths):
        j = k + 1
        widest = widths[k]
        while j < len(widths) and (j + 1 - k) * max(widest, widths[j]) <= 200_000:
            widest = max(widest, widths[j])
            j += 1
        out.append((k, j))
        k = j
    return out


def begin_of(row: np.ndarray, d: int) -> int:
    return int(np.searchsorted(row, d, "left"))


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark in parts of about BLOCK_BYTES of text."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    rows = benchmark.select("item_id", "text").where(F.length("text") > 0)
    return [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def block_items(block: DataFrame, n: int = N) -> Items:
    """A block of items with all their seeds."""
    return build_items(sorted(map(tuple, block.collect()), key=str), n)


def _seed_counts(docs: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """How many documents hold each seed, and how many there are. What comes back is a number a seed, summed by Spark."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        items, n = shared.value, 0
        held = np.zeros(len(items.seeds), np.int64)
        for batch in batches:
            n += batch.num_rows
            data, offsets = text_bytes(column(batch, "text"))
            for _, _, part, at in slices(data, offsets):
                words, row = _words(part, at)
                where, seed = _hits(items, words, row)
                held += np.bincount(np.unique(row[where] * np.int64(len(held) + 1) + seed) % (len(held) + 1), minlength=len(held))[: len(held)]
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int64()), pa.array(np.append(held[some], n), pa.int64())], ["seed", "n"])

    got = docs.select("text").mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
    seed, n = got["seed"].to_numpy(), got["n"].to_numpy()
    held = np.zeros(len(items.seeds), np.int64)
    held[seed[seed >= 0]] = n[seed >= 0]
    return held, int(n[seed < 0].sum())


def _joining(docs: DataFrame, benchmark: DataFrame, n: int, threshold: float):
    """A broadcast of the items and driving seeds of each block."""
    for block in _blocks(benchmark):
        items = block_items(block, n)
        yield docs.sparkSession.sparkContext.broadcast(driving(items, *_seed_counts(docs, items), threshold))


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, and the words first_word..end_word of the document that align best."""
    spark = docs.sparkSession
    out = None
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, score double, first_word long, end_word long"
    kind = to_arrow_type(benchmark.schema["item_id"].dataType)
    for shared in _joining(docs, benchmark, n, threshold):

        def run(batches, shared=shared):
            items = shared.value
            for batch in batches:
                data, offsets = text_bytes(column(batch, "text"))
                for i, _, part, at in slices(data, offsets):
                    got = _leaks(items, *_words(part, at), threshold)
                    rows = pa.array([i + r for r, *_ in got], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [column(batch, "doc_id").take(rows), pa.array([items.ids[t] for _, t, *_ in got], kind), *(pa.array([g[k] for g in got], t) for k, t in ((2, pa.float64()), (3, pa.int64()), (4, pa.int64())))],
                        ["doc_id", "item_id", "score", "first_word", "end_word"],
                    )

        found = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text holds no copy of a test item, untouched."""
    out = docs.select(F.col("text").alias("text"), row_struct(docs).alias("row"))
    for shared in _joining(docs, benchmark, n, threshold):

        def run(batches, shared=shared):
            for batch in batches:
                data, offsets = text_bytes(column(batch, "text"))
                clean = np.ones(batch.num_rows, bool)
                for i, _, part, at in slices(data, offsets):
                    clean[[i + r for r, *_ in _leaks(shared.value, *_words(part, at), threshold)]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, out.schema)
    return out.select("row.*")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return find_leaks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows whose text holds a copy of a test item go; null and empty texts stay, repeated rows are judged each, an
    empty table or benchmark changes nothing, and columns are untouched."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("item_id"), "text"))
