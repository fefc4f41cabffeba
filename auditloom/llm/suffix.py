"""Suffix-array dedup: bytes covered by a `size`-byte string that also starts anywhere else are removed.

The suffix array is built blockwise with a difference cover, over those suffixes that may tie over `size` bytes:

1. Candidates. Each window of `size` bytes has an anchor: its leftmost least hash of GRAM bytes. Anchor and the window's
   offset to it depend on the window's bytes alone, so equal windows meet at one anchor, aligned. Windows around an anchor
   that follow one another form a cell; a cell lies in one half of the offsets, and its key hashes the bytes that all
   windows of that half share. Keys are counted (with partial sums); a cell whose key occurs once holds no repeat. That drops
   no repeat, and keeps what is sorted in proportion to what repeats instead of to the corpus.
2. Pre-aggregation. Cells of one key with the same bytes collapse into one kind with a count. A task lets a text's cells go
   on twice at most, however many copies it reads.
3. Blocks. The bytes of each kind (at most `size` + half a span) are fetched once. Kinds with one key lie in one block; a block
   of about `block` kinds is sorted at a time (`BlockSort`):
   - Positions with a remainder in COVER modulo PERIOD are the sample: a difference cover, so for any two positions there is a
     step under PERIOD that takes both into it. Sample suffixes are ranked first, by prefix doubling up to `depth` bytes.
   - The block's suffixes are dealt into buckets by their two leading bytes, sized by a histogram, and one bucket at a time is
     sorted: by the 8 leading bytes and the 16 last of the `size`, and suffixes that tie there by the precomputed ranks of
     their sample positions. So a tie of any length costs a comparison of ranks, never a scan of the text.
   A key with more than `block` kinds is split first: its cells are cut in halves by offset and keyed by the longer
   stretch that those windows share, again and again, down to single windows. Memory is bounded by the block, not by a group.
4. The repeated windows go back to all cells by a join on (key, bytes), then to rows by the text's digest.

Matches never cross documents. Texts are named by 128 bits of their SHA-256, so rows that repeat a doc_id, or have none, never
mix; cells count as equal where three hashes of 64 bits agree (key, and two of the bytes).

Defined results: a null text counts as empty (0 bytes, nothing removed, digest of the empty string); texts under `size`
bytes stay whole; rows with the same text are two documents (each repeats the other) and get the same spans, whether they
share a doc_id or not; a null doc_id is kept; a very long text is taken in stretches of 2**POS_BITS bytes that overlap; an empty
table gives no rows; further columns, whatever their names, pass through `dedup_texts`.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import Seen, WorkDir, column, first_copies, named_texts, quoted, row_struct, slices, table, text_bytes, text_id

SIZE = 200
GRAM = 16
#: A difference cover: every remainder modulo PERIOD is the difference of two of its members.
PERIOD, COVER = 7, (0, 1, 3)
#: Kinds of one key from which it is split; also the kinds that a task sorts at a time.
BLOCK = 8_192
#: Suffixes from which a bucket of a block ends, at the next pair of leading bytes.
BUCKET = 131_072


class Plan:
    """Fixed numbers of a window size."""

    def __init__(self, size: int):
        if size < 2 * GRAM + PERIOD:
            raise ValueError(f"size must be at least {2 * GRAM + PERIOD}")
        if size > 2**R_BITS:
            raise ValueError(f"size must be at most {2**R_BITS}")
        self.size, self.span = size, size - GRAM + 1
        self.depth = (size - PERIOD + 1) // PERIOD * PERIOD  # bytes by which the sample is ranked
        self.half = (self.span + 1) // 2

    def halves(self) -> list[tuple[int, int]]:
        """Offsets (anchor minus window start) of each half, ends included."""
        return [(0, self.half - 1), (self.half, self.span - 1)]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each `width` values in a row, by doubling."""
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - have :]) if have < width else out


#: Bits of a position within a stretch; longer texts are taken in stretches that overlap.
POS_BITS = 22


def _cells(data: np.ndarray, offsets: np.ndarray, plan: Plan, prints: bool = True) -> dict[str, np.ndarray]:
    """Cells of the texts: row, anchor and first and last offset (r_lo..r_hi), key, and with `prints` two fingerprints."""
    out = {k: [] for k in ("row", "anchor", "r_lo", "r_hi", "key", *(("fp", "fp2") if prints else ()))}
    step = (1 << POS_BITS) - plan.size
    long = np.flatnonzero(np.diff(offsets) >= plan.size)
    if not len(long):
        return {k: np.zeros(0, np.int64) for k in out}
    if offsets[-1] < step:
        parts = [(0, len(offsets) - 1, 0, int(offsets[-1]))]
    else:  # one long text
        parts = [(i, i + 1, int(a), int(min(a + step + plan.size - 1, offsets[i + 1]))) for i in long for a in range(int(offsets[i]), int(offsets[i + 1]) - plan.size + 1, step)]
    for i, j, a, b in parts:
        part = data[a:b]
        edges = np.clip(offsets[i : j + 1], a, b) - a
        got = _cells_of(part, edges, plan, prints)
        if got:
            got["row"] = got["row"] + i
            got["anchor"] = got["anchor"] + a - offsets[got["row"]]
            for k in out:
                out[k].append(got[k])
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


def _cells_of(data: np.ndarray, edges: np.ndarray, plan: Plan, prints: bool) -> dict[str, np.ndarray] | None:
    if len(data) < plan.size:
        return None
    prefix = K.prefix_hash(data)
    least = K.mix(K.rolling_hash(prefix, GRAM))
    least &= np.uint64(2**64 - 2**POS_BITS)
    least |= np.arange(len(least), dtype=np.uint64)
    least = _sliding_min(least, plan.span)
    least &= np.uint64(2**POS_BITS - 1)
    anchors = least.astype(np.int32)  # of the window from each position on
    change = np.concatenate([[0], np.flatnonzero(anchors[1:] != anchors[:-1]) + 1])
    # cells end where the anchor changes, where the offset to it comes below half, and where a row's windows begin or end
    turn = anchors[change] - plan.half + 1
    turn = turn[(turn > change) & (turn < np.append(change[1:], len(anchors)))]
    rows = np.flatnonzero(np.diff(edges) >= plan.size)
    first = np.unique(np.concatenate([change, turn, edges[rows], edges[rows + 1] - plan.size + 1]))
    first = first[first < len(anchors)]
    last = np.append(first[1:], len(anchors)) - 1
    row = np.searchsorted(edges, first, side="right") - 1
    valid = first + plan.size <= edges[np.minimum(row + 1, len(edges) - 1)]
    first, last, row = first[valid], last[valid], row[valid]
    if not len(first):
        return None
    anchor = anchors[first].astype(np.int64)
    r_hi, r_lo = anchor - first, anchor - last
    side = r_hi >= plan.half
    lo, hi = np.where(side, plan.half, 0), np.where(side, plan.span - 1, plan.half - 1)
    key = K.span_hash(prefix, anchor - lo, anchor - hi + plan.size) + side.astype(np.uint64)
    out = {"row": row, "anchor": anchor, "r_lo": r_lo, "r_hi": r_hi, "key": key.view(np.int64)}
    if prints:
        place = (r_lo * 65536 + r_hi).astype(np.uint64)
        fp = K.mix(K.span_hash(prefix, first, last + plan.size) + place)
        fp2 = K.mix(K.span_hash(K.prefix_hash(K.OTHER[data]), first, last + plan.size) ^ place)
        out |= {"fp": fp.view(np.int64), "fp2": fp2.view(np.int64)}
    return out


def _fresh_texts(batches, times: int):
    """(tids, bytes, offsets) of slices of those rows that a task lets through."""
    seen = Seen(times)
    for batch in batches:
        batch = batch.filter(seen(column(batch, "tid")))
        data, offsets = text_bytes(column(batch, "text"))
        for i, j, part, at in slices(data, offsets, 1_000_000):
            yield column(batch, "tid").slice(i, j - i), part, at


def _keys(docs: DataFrame, plan: Plan) -> DataFrame:
    def run(batches):
        for _, part, at in _fresh_texts(batches, 2):
            yield pa.RecordBatch.from_arrays([pa.array(_cells(part, at, plan, False)["key"])], ["key"])

    return named_texts(docs).mapInArrow(run, "key long")


CELL = "key long, fp long, fp2 long, tid binary, place long"
#: Bits of an offset within `place`, which holds a cell's anchor, r_lo and r_hi.
R_BITS = 12


def _place(anchor: np.ndarray, r_lo: np.ndarray, r_hi: np.ndarray) -> np.ndarray:
    return (anchor << 2 * R_BITS | r_lo << R_BITS | r_hi).astype(np.int64)


def _all_cells(docs: DataFrame, plan: Plan) -> DataFrame:
    def run(batches):
        for tids, part, at in _fresh_texts(batches, 2):
            got = _cells(part, at, plan)
            columns = [got["key"], got["fp"], got["fp2"], None, _place(got["anchor"], got["r_lo"], got["r_hi"])] if len(got["key"]) else [np.zeros(0, np.int64)] * 3 + [None, np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([tids.take(pa.array(got["row"].astype(np.int64))) if x is None else pa.array(x) for x in columns], [x.split()[0] for x in CELL.split(", ")])

    return named_texts(docs).mapInArrow(run, CELL)


NAMES = ("key", "fp", "fp2")
CONTEXT = "key long, fp long, fp2 long, n long, lo short, hi short, r_lo short, r_hi short, bytes binary"


def _numbers(array: pa.Array) -> np.ndarray:
    return array.to_numpy(zero_copy_only=False)


def _contexts(docs: DataFrame, wanted: DataFrame, plan: Plan) -> DataFrame:
    """The bytes of one occurrence of each wanted cell. wanted: tid, cells (array of NAMES, n, place)."""
    schema = pa.schema([(k, pa.int64()) for k in (*NAMES, "n")] + [(k, pa.int16()) for k in ("lo", "hi", "r_lo", "r_hi")] + [("bytes", pa.binary())])

    def run(batches):
        seen = Seen()
        for batch in batches:
            batch = batch.filter(seen(column(batch, "tid")))
            if not batch.num_rows:
                continue
            data, offsets = text_bytes(column(batch, "text"))
            wants = column(batch, "cells")
            size = np.diff(_numbers(wants.offsets).astype(np.int64))
            cells = wants.flatten()
            field = {k: _numbers(cells.field(k)) for k in (*NAMES, "n", "place")}
            base = np.repeat(offsets[:-1], size) + (field["place"] >> 2 * R_BITS)
            field |= {"r_lo": (field["place"] >> R_BITS & 2**R_BITS - 1).astype(np.int16), "r_hi": (field["place"] & 2**R_BITS - 1).astype(np.int16)}
            begin, end = (base - field["r_hi"]).tolist(), (base - field["r_lo"] + plan.size).tolist()
            side, raw = field["r_hi"] >= plan.half, data.tobytes()
            lo, hi = np.where(side, plan.half, 0).astype(np.int16), np.where(side, plan.span - 1, plan.half - 1).astype(np.int16)
            for a in range(0, len(begin), 20_000):
                b = a + 20_000
                arrays = [pa.array(field[k][a:b]) for k in (*NAMES, "n")] + [pa.array(x[a:b]) for x in (lo, hi, field["r_lo"], field["r_hi"])]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([raw[i:j] for i, j in zip(begin[a:b], end[a:b])], pa.binary())], schema=schema)

    # copies go no further than the task that reads them, and not beyond the task that joins them
    joined = first_copies(named_texts(docs)).join(wanted.hint("merge"), "tid")
    return joined.select("tid", "text", "cells").mapInArrow(run, CONTEXT)


def _split(contexts: DataFrame, plan: Plan) -> DataFrame:
    """Each cell cut in two by offset, keyed anew by what the windows of its half share."""

    def run(batches):
        for batch in batches:
            rows = {k: [] for k in batch.schema.names}
            for x in batch.to_pylist():
                mid = (x["lo"] + x["hi"]) // 2
                for lo, hi in ((x["lo"], mid), (mid + 1, x["hi"])):
                    a, b = max(lo, x["r_lo"]), min(hi, x["r_hi"])
                    if a > b:
                        continue
                    at = x["r_hi"]  # the anchor's place in the bytes
                    own = x["bytes"][at - b : at - a + plan.size]
                    shared = x["bytes"][at - lo : at - hi + plan.size]
                    name = f"{x['key']} {lo} {hi} ".encode()
                    digest = hashlib.blake2b(b"%d %d " % (a, b) + own, digest_size=16).digest()
                    new = x | {"key": int.from_bytes(hashlib.blake2b(name + shared, digest_size=8).digest(), "little", signed=True), "lo": lo, "hi": hi, "r_lo": a, "r_hi": b, "bytes": own}
                    new |= {"fp": int.from_bytes(digest[:8], "little", signed=True), "fp2": int.from_bytes(digest[8:], "little", signed=True)}
                    for k, v in new.items():
                        rows[k].append(v)
            yield pa.RecordBatch.from_pydict(rows, batch.schema)

    return contexts.mapInArrow(run, contexts.schema)


#: STEPS[a][b]: the least step that takes positions of remainders a and b into the cover at once.
STEPS = [[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)]


def _ties(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's class (rows with equal keys), in sorted order of the keys, and which rows are not alone in theirs."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
    new = np.ones(len(order), bool)
    for k, key in enumerate(keys):
        ordered = key[order]
        new[1:] = (ordered[1:] != ordered[:-1]) | (new[1:] if k else False)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, (np.bincount(number, minlength=1) > 1)[number]


class BlockSort:
    """Sorts the suffixes of one block of text that start at `start`, bucket by bucket, by their first `plan.size` bytes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, plan: Plan):
        self.plan, self.start, n = plan, start, -(-len(data) // PERIOD) + plan.depth // PERIOD + 1
        padded = np.zeros(n * PERIOD + PERIOD + 8, np.uint8)
        padded[: len(data)] = data
        #: the 8 bytes from each position on, as one number
        self.words = np.ndarray((len(padded) - 7,), ">u8", padded, 0, (1,))
        self.ranks = self._sample(n)

    def _sample(self, n: int) -> np.ndarray:
        """Ranks of the sample suffixes by `depth` bytes, a row for each member of the cover, by prefix doubling. A round ranks
        those that the rounds after it ask for: in the last, the ones within PERIOD of a suffix to be sorted."""
        lengths = [PERIOD]
        while lengths[-1] < self.plan.depth:  # the last step overlaps what is ranked already
            lengths.append(min(2 * lengths[-1], self.plan.depth))
        near = np.zeros((n + 1) * PERIOD, bool)
        for step in range(PERIOD):
            near[self.start + step] = True
        wanted = [np.stack([near[c : n * PERIOD : PERIOD] for c in COVER])]
        for was, now in zip(lengths[-2::-1], lengths[:0:-1]):
            step, more = (now - was) // PERIOD, wanted[-1].copy()
            more[:, step:] |= wanted[-1][:, :-step]
            wanted.append(more)
        at = np.arange(n) * PERIOD
        first = np.stack([self.words[at + c].astype(np.uint64) >> np.uint64(64 - 8 * PERIOD) for c in COVER])
        rank = self._named(first, wanted.pop())
        for was, now in zip(lengths, lengths[1:]):
            step = (now - was) // PERIOD
            then = np.zeros_like(rank)
            then[:, :-step] = rank[:, step:] + 1
            rank = self._named(rank * (n * len(COVER) + 1) + then, wanted.pop())
        return rank

    @staticmethod
    def _named(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The place of each wanted value among them, equal ones sharing theirs."""
        out = np.zeros(values.shape, np.int64)
        out[wanted] = np.unique(values[wanted], return_inverse=True)[1]
        return out

    def rank_at(self, position: np.ndarray) -> np.ndarray:
        row = np.full(PERIOD, -1)
        row[list(COVER)] = np.arange(len(COVER))
        return self.ranks[row[position % PERIOD], position // PERIOD]

    def repeated(self, bucket: int = BUCKET) -> np.ndarray:
        """Which of the suffixes share their first `size` bytes with another of them."""
        start = self.start
        lead = self.words[start].astype(np.uint64)
        top = (lead >> np.uint64(48)).astype(np.uint16)
        ends = np.cumsum(np.bincount(top, minlength=65_536))
        order = np.argsort(top, kind="stable")
        out, a = np.zeros(len(start), bool), 0
        while a < len(start):
            b = int(ends[min(np.searchsorted(ends, a + bucket), 65_535)])
            here = order[a:b]
            out[here] = self._bucket(start[here], lead[here])
            a = b
        return out

    def _bucket(self, start: np.ndarray, lead: np.ndarray) -> np.ndarray:
        out = np.zeros(len(start), bool)
        left = np.flatnonzero(_ties(lead)[1])
        size = self.plan.size
        tail = [self.words[start[left] + size - k].astype(np.uint64) for k in (16, 8)]
        number, tied = _ties(lead[left], *tail) if len(left) else (left, np.zeros(0, bool))
        left, number = left[tied], number[tied]
        rest = start[left] % PERIOD
        by_rest = [np.flatnonzero(rest == r) for r in range(PERIOD)]
        for a, b in combinations(range(PERIOD), 2):  # equal remainders are compared along the way
            two = np.concatenate([by_rest[a], by_rest[b]])
            if len(two) > 1:
                rank = self.rank_at(start[left[two]] + STEPS[a][b])
                out[left[two]] |= _ties(number[two] * np.int64(self.ranks.size + 1) + rank)[1]
        return out


FOUND = "key long, fp long, fp2 long, lo short, hi short"


def _sort_buckets(contexts: DataFrame, plan: Plan, block: int) -> DataFrame:
    """Runs of repeated offsets of each kind. Keys lie together in sorted partitions; a block of them is sorted at a time."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        get = lambda k: _numbers(rows[k].combine_chunks()).astype(np.int64)
        texts = rows["bytes"].combine_chunks()
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        hi, count = get("r_hi"), get("r_hi") - get("r_lo") + 1
        cell = np.repeat(np.arange(len(hi)), count)
        place = np.arange(len(cell)) - np.repeat(np.cumsum(count) - count, count)  # the window's number in its cell
        flags = BlockSort(data, offsets[cell] - offsets[0] + place, plan).repeated() | (get("n") >= 2)[cell]
        edge = np.ones(len(cell), bool)
        edge[1:] = cell[1:] != cell[:-1]
        begins = flags & (edge | ~np.concatenate([[False], flags[:-1]]))
        ends = flags & (np.concatenate([edge[1:], [True]]) | ~np.concatenate([flags[1:], [False]]))
        first, last, of = place[begins], place[ends], cell[begins]
        arrays = [pa.array(get(f"parent_{k}")[of]) for k in NAMES] + [pa.array((hi[of] - x).astype(np.int16)) for x in (last, first)]
        return pa.RecordBatch.from_arrays(arrays, [*NAMES, "lo", "hi"])

    def run(batches):
        held, count = [], 0
        for batch in batches:
            held, count = [*held, batch], count + batch.num_rows
            if count >= block:
                rows = pa.Table.from_batches(held)
                keys = _numbers(rows["key"].combine_chunks())
                whole = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
                if whole:
                    yield solve(rows.slice(0, whole))
                held, count = rows.slice(whole).to_batches(), count - whole
        if count:
            yield solve(pa.Table.from_batches(held))

    return contexts.repartition("key").sortWithinPartitions("key").mapInArrow(run, FOUND)


def repeated_starts(docs: DataFrame, work: WorkDir, size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """tid and runs (first, last) of window starts whose `size` bytes also start elsewhere."""
    plan = Plan(size)
    twice = work.cut(_keys(docs, plan).groupBy("key").count().where("count > 1").select("key"), "twice")
    cells = work.cut(_all_cells(docs, plan).join(twice.hint("merge"), "key"), "cells")  # both sides are plain exchanges, so a hot key is split
    one = F.min(F.struct("tid", "place"))  # any one occurrence
    kinds = work.cut(cells.groupBy(*NAMES).agg(F.count("*").alias("n"), one.alias("one")).select(*NAMES, "n", "one.*"), "kinds")
    wanted = kinds.groupBy("tid").agg(F.collect_list(F.struct(*NAMES, "n", "place")).alias("cells"))  # bounded by the text's length
    parents = {f"parent_{k}": F.col(k) for k in NAMES}
    contexts = work.cut(_contexts(docs, work.cut(wanted, "wanted"), plan).withColumns(parents), "contexts")

    results = []
    while True:  # at most log2(size) rounds: offsets are halved in each
        hot = contexts.groupBy("key", "lo", "hi").count().where((F.col("count") > block) & (F.col("lo") < F.col("hi"))).select("key")
        hot = work.cut(hot, "hot")
        if not hot.take(1):
            break
        results.append(_sort_buckets(contexts.join(hot, "key", "left_anti"), plan, block))
        parts = work.cut(_split(contexts.join(hot, "key"), plan), "parts")
        alike = (F.min("fp") == F.max("fp")) & (F.min("fp2") == F.max("fp2"))
        sums = work.cut(parts.groupBy("key").agg(F.sum("n").alias("seen"), alike.alias("equal")).where("seen > 1"), "sums")
        # cells of a key that are all equal need no sorting; single windows always are
        results.append(parts.join(sums.where("equal").select("key"), "key").select(*(F.col(f"parent_{k}").alias(k) for k in NAMES), F.col("r_lo").alias("lo"), F.col("r_hi").alias("hi")))
        contexts = work.cut(parts.join(sums.where(~F.col("equal")).select("key"), "key").select(*contexts.columns), "contexts")
    results.append(_sort_buckets(contexts, plan, block))
    found = reduce(DataFrame.unionByName, results)
    found = work.cut(found, "found")
    return cells.select(*NAMES, "tid", F.shiftright("place", 2 * R_BITS).cast("int").alias("anchor")).join(found.hint("merge"), [*NAMES]).select("tid", (F.col("anchor") - F.col("hi")).alias("first"), (F.col("anchor") - F.col("lo")).alias("last"))


def removed_spans(docs: DataFrame, size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """row (the input's columns), text and runs: runs of repeated window starts (null where there are none)."""
    work = WorkDir(docs.sparkSession, "suffix")
    runs = repeated_starts(docs, work, size, block)
    runs = work.cut(runs.groupBy("tid").agg(F.collect_set(F.struct("first", "last")).alias("runs")), "runs")  # bounded by the text's length
    rows = docs.select(row_struct(docs, "text").alias("row"), F.col("text").alias("text"))
    return rows.withColumn("tid", text_id()).join(runs.hint("merge"), "tid", "left").select("row", "text", "runs")


def _spans(runs, size: int) -> list[tuple[int, int]]:
    """Maximal removed byte runs of a text."""
    out: list[list[int]] = []
    for first, last in sorted((r["first"], r["last"]) for r in runs or ()):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + size)
        else:
            out.append([first, last + size])
    return [(a, b) for a, b in out]


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return b"".join(kept)


def _whole_chars(raw: bytes, a: int, b: int) -> tuple[int, int]:
    while a and raw[a : a + 1] and raw[a] & 0xC0 == 0x80:
        a -= 1
    while b < len(raw) and raw[b] & 0xC0 == 0x80:
        b += 1
    return a, b


def _text_spans(batch: pa.RecordBatch, size: int):
    """(row, bytes, removed spans) of each text of a batch."""
    data, offsets = text_bytes(column(batch, "text"))
    runs = column(batch, "runs")
    for i in range(batch.num_rows):
        yield i, data[offsets[i] : offsets[i + 1]].tobytes(), _spans(runs[i].as_py(), size)


def dedup_report(docs: DataFrame, size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes kept."""

    def run(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for _, raw, spans in _text_spans(batch, size):
                for c, v in zip(cols, (len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_cut(raw, spans)).hexdigest())):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = removed_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), size, block)
    return rows.select("row.doc_id", "text", "runs").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup_texts(docs: DataFrame, size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """The input with repeated bytes cut out of `text`; a character of which a byte is removed goes whole."""
    rows = removed_spans(docs, size, block)

    def run(batches):
        for batch in batches:
            texts = column(batch, "text").to_pylist()
            for i, raw, spans in _text_spans(batch, size):
                if spans:
                    texts[i] = _cut(raw, [_whole_chars(raw, a, b) for a, b in spans]).decode()
            yield pa.RecordBatch.from_arrays([column(batch, "row"), pa.array(texts, pa.string())], ["row", "text"])

    out = rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("text", T.StringType())]))
    return out.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(table(spark, sf_dir, "documents"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated passages leave the texts; n_chars follows. Documents stay, even those left empty; null texts
    stay null, rows that repeat lose the same bytes, an empty table stays empty, and all columns keep their names."""
    return dedup_texts(docs).withColumn("n_chars", F.length("text").cast("long")).select(*(F.col(quoted(c)) for c in docs.columns))


OP10_SQL = """
WITH base AS (
  SELECT doc_id, row_number() OVER () AS rid, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), windows AS (
  SELECT rid, p, md5(substr(h, 2 * p + 1, 400)) AS w FROM (SELECT rid, h, unnest(range(0, greatest(n - 199, 0))) AS p FROM base)
), twice AS (
  SELECT rid, p FROM windows QUALIFY count(*) OVER (PARTITION BY w) > 1
), numbered AS (
  SELECT rid, p, sum(CASE WHEN p - before <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY p) AS g
  FROM (SELECT rid, p, lag(p) OVER (PARTITION BY rid ORDER BY p) AS before FROM twice)
), spans AS (
  SELECT rid, min(p) AS a, max(p) + 200 AS b FROM numbered GROUP BY rid, g
), pieces AS (
  SELECT rid, a, b, lag(b, 1, 0) OVER (PARTITION BY rid ORDER BY a) AS since FROM spans
), kept AS (
  SELECT rid, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS k
  FROM pieces JOIN base USING (rid) GROUP BY rid
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM base LEFT JOIN kept USING (rid)
"""
