"""Sharding by histogram sort.

Rows are ordered by (key, doc_id), key being 60 bits of the text's MD5. Splitters are found by counting: each pass counts
the exact bytes in the gaps between probe keys, over all partitions at once, and moves the probes into the gap in which
each splitter's target lies, until that gap holds one key. Then rows are exchanged once.

Law `bytes`: with equal texts as groups, a group of at most GROUP_SHARE of a shard stays together and goes where its first
byte falls; the rows of larger groups are cut by doc_id. So shard sizes differ from the mean by at most that share and one
row. A task never holds a hot key: rows are dealt by key interval, and intervals that hold too many rows are cut into ranges
of (key, doc_id), so that slots follow (key, doc_id) at every size.

Defined results: null text has size 1 and crc32 0; null doc_id sorts first; rows equal in key and doc_id stay together; an
empty table gives no rows; other columns pass through untouched, but for those named like an output column in any case, which go.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import WorkDir, column, row_struct, table

KEY_BITS = 60
LOWEST = -(2**63)
#: Groups of equal texts up to this share of a shard are never cut.
GROUP_SHARE = 0.05
#: Key intervals for the exchange, and the rows from which an interval is cut into ranges of (key, doc_id). The driver holds
#: a row for each interval and for each PART_ROWS rows.
INTERVALS = 1024
PART_ROWS = 200_000


@dataclass
class Splitter:
    """Rows beyond it have a greater key, or that key and a greater doc_id (doc None: none of that key)."""

    key: int
    doc: int | None


def text_key() -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(F.col("text"), F.lit(""))), 1, KEY_BITS // 4), 16, 10).cast("long")


def text_size() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1


def _histogram(rows: DataFrame, by: str, probes: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(gap, bytes, least value, greatest value): gap g holds values v with probes[g - 1] <= v < probes[g]."""

    def run(batches):
        total = np.zeros(len(probes) + 1, np.int64)
        least, most = np.full(len(total), 2**63 - 1, np.int64), np.full(len(total), LOWEST, np.int64)
        for batch in batches:
            v, size = column(batch, "v").to_numpy(zero_copy_only=False), column(batch, "size").to_numpy(zero_copy_only=False)
            gap = np.searchsorted(probes, v, side="right")
            np.add.at(total, gap, size)
            np.minimum.at(least, gap, v)
            np.maximum.at(most, gap, v)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, total[at], least[at], most[at])], ["gap", "bytes", "least", "most"])

    got = rows.select(F.col(by).alias("v"), "size").mapInArrow(run, "gap long, bytes long, least long, most long")
    got = got.groupBy("gap").agg(F.sum("bytes"), F.min("least"), F.max("most"))
    return sorted(map(tuple, got.collect()))  # at most len(probes) + 1 rows


def _crossings(rows: DataFrame, by: str, targets: list[tuple[int, int]], n_probes: int) -> dict[int, tuple[int, int, int]]:
    """For each (name, target): the value whose bytes take the running total from below the target to it or beyond,
    with the bytes below the value and at it."""
    open_, done = {name: (None, None) for name, _ in targets}, {}
    goal = dict(targets)
    while open_:
        probes = set()
        for lo, hi in open_.values():
            lo, hi = (-(2**62), 2**62) if lo is None else (lo, hi)
            probes |= {lo, min(hi + 1, 2**63 - 1)} | {lo + (hi - lo + 1) * k // n_probes for k in range(1, n_probes)}
        edges = np.array(sorted(probes), np.int64)
        below, gaps = 0, []
        for gap, size, least, most in _histogram(rows, by, edges):
            gaps.append((below, size, least, most))
            below += size
        ends = [g[0] + g[1] for g in gaps]
        for name in list(open_):
            before, size, least, most = gaps[bisect_left(ends, goal[name])]
            if least == most:
                done[name] = (least, before, size)
                del open_[name]
            else:
                open_[name] = (least, most)
    return done


def find_splitters(rows: DataFrame, n_shards: int, n_probes: int = 64, group_share: float = GROUP_SHARE) -> list[Splitter]:
    """rows: key, doc_id (not null), size. One splitter between each two shards."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total:
        return [Splitter(2**62, None)] * (n_shards - 1)
    goals = [(i, -(-i * total // n_shards)) for i in range(1, n_shards)]
    found = _crossings(rows, "key", goals, n_probes)
    out = {i: Splitter(key, None) for i, (key, _, _) in found.items()}
    large: dict[int, list[tuple[int, int]]] = {}
    for i, (key, before, size) in found.items():
        if size * n_shards > group_share * total:
            large.setdefault(key, []).append((i, dict(goals)[i] - before))
    for key, wanted in large.items():  # at most n_shards - 1 keys
        for i, (doc, before, size) in _crossings(rows.where(F.col("key") == key), "doc_id", wanted, n_probes).items():
            out[i] = Splitter(key, doc)
    return [out[i] for i in range(1, n_shards)]


def shard_of(splitters: list[Splitter]) -> Column:
    out = F.lit(0)
    for s in splitters:
        beyond = F.col("key") > s.key
        if s.doc is not None:
            beyond = beyond | ((F.col("key") == s.key) & (F.col("doc_id") > s.doc))
        out = out + beyond.cast("int")
    return out


def find_cuts(rows: DataFrame, counts: dict[tuple[int, int], int], part_rows: int, n_probes: int = 64) -> dict[tuple[int, int], list[Splitter]]:
    """For each (shard, interval), of which counts has the rows: where to cut it, in order, so that no part has more than
    twice part_rows rows, but for rows equal in key and doc_id. Both names grow with (key, doc_id), so ranks are those of the whole table."""
    goals, before = {}, 0
    for cell, n in sorted(counts.items()):
        goals |= {(*cell, k): before + k * part_rows for k in range(1, -(-n // part_rows))}
        before += n
    if not goals:
        return {}
    ones = rows.withColumn("size", F.lit(1).cast("long"))
    found = _crossings(ones, "key", list(goals.items()), n_probes)
    out = {name: Splitter(key, None) for name, (key, _, _) in found.items()}
    large: dict[int, list[tuple[tuple, int]]] = {}
    for name, (key, below, n) in found.items():
        if n > part_rows:
            large.setdefault(key, []).append((name, goals[name] - below))
    for key, wanted in large.items():  # at most one key for each part_rows rows
        for name, (doc, _, _) in _crossings(ones.where(F.col("key") == key), "doc_id", wanted, n_probes).items():
            out[name] = Splitter(key, doc)
    cuts: dict[tuple[int, int], list[Splitter]] = {}
    for name in goals:
        cuts.setdefault(name[:2], []).append(out[name])
    return cuts


def shard_rows(docs: DataFrame, n_shards: int = 8, n_probes: int = 64, group_share: float = GROUP_SHARE, part_rows: int = PART_ROWS) -> DataFrame:
    """The input's columns with size, shard and slot (gapless from 0 in each shard)."""
    spark = docs.sparkSession
    work = WorkDir(spark, "shards")
    names = [c for c in docs.columns if c.lower() not in ("size", "shard", "slot")]
    named = docs.select(row_struct(docs, *(c for c in docs.columns if c not in names)).alias("row"), text_key().alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("doc_id"), text_size().alias("size"))
    rows = work.cut(named.select("key", "doc_id", "size"), "keys")
    splitters = find_splitters(rows, n_shards, n_probes, group_share)

    where = shard_of(splitters).alias("shard")
    interval = F.shiftright(F.col("key"), KEY_BITS - INTERVALS.bit_length() + 1).cast("int").alias("interval")
    counts = rows.groupBy(where, interval).count().collect()  # at most n_shards * INTERVALS, and in sum one more than INTERVALS for each splitter
    counts = {(r["shard"], r["interval"]): r["count"] for r in counts}
    cuts = find_cuts(rows, counts, part_rows, n_probes)
    split = spark.createDataFrame([(*k, [(c.key, c.doc) for c in cuts.get(k, [])]) for k in counts], "shard int, interval int, cuts array<struct<cut: long, doc: long>>")
    beyond = lambda c: (F.col("key") > c["cut"]) | ((F.col("key") == c["cut"]) & (F.col("doc_id") > c["doc"]))
    dealt = lambda df: df.join(F.broadcast(split), ["shard", "interval"]).withColumn("way", F.size(F.filter("cuts", beyond)))  # noqa: E731  (bounded: one row for each interval, one cut for each part_rows rows)
    parts = sorted(map(tuple, dealt(rows.select(where, interval, "key", "doc_id")).groupBy("shard", "interval", "way").count().collect()))
    offsets, before = [], {}
    for part, (shard, k, way, n) in enumerate(parts):
        offsets.append((shard, k, way, part, before.get(shard, 0)))
        before[shard] = before.get(shard, 0) + n
    at = spark.createDataFrame(offsets, "shard int, interval int, way int, _part int, _offset long")

    out = dealt(named.withColumns({"shard": where, "interval": interval})).join(F.broadcast(at), ["shard", "interval", "way"])
    rank = F.row_number().over(W.partitionBy("_part").orderBy("key", "doc_id"))
    return out.select(*(F.col("row")[c].alias(c) for c in names), "size", "shard", (F.col("_offset") + rank - 1).cast("long").alias("slot"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = shard_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "size", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard"))


#: The law of `bytes` as running sums; the CRC-32 is computed byte by byte from its polynomial.
OP4_SQL = """
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
), base AS (
  SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size,
         ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS key, hex(encode(coalesce(text, ''))) AS h
  FROM documents
), crc AS (
  SELECT b.*, CASE WHEN size = 1 THEN 0 ELSE xor(list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(size - 1), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT)),
           lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) END AS text_crc32
  FROM base b, crc_table
), placed AS (
  SELECT *, sum(size) OVER () AS total, sum(size) OVER (PARTITION BY key) AS group_size,
         sum(size) OVER (ORDER BY key) - sum(size) OVER (PARTITION BY key) AS before_group,
         sum(size) OVER (ORDER BY key, doc_id) - sum(size) OVER (PARTITION BY key, doc_id) AS before_row
  FROM crc
), sharded AS (
  SELECT *, least(7, (8 * (CASE WHEN group_size * 8 > 0.05 * total THEN before_row ELSE before_group END)) // total)::INTEGER AS shard FROM placed
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY key, doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM sharded
"""
