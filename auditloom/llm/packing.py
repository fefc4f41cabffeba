"""Packing into optimal length buckets.

Documents are counted in tokens (one end-of-document token each) and taken in pieces of at most `max_len`. The global
histogram of piece lengths (at most `max_len` rows) goes through a dynamic programme that chooses `n_buckets` boundaries
with the least padding possible. Inside a bucket, pieces in hash order fill batches of `budget` tokens at the bucket's
length, without gaps: ranks are counted within (bucket, shard) and offset by the counts of the shards before, so no task
holds a bucket, and texts are read once and never shuffled.

Defined results: a null or empty text is one piece of one token (its end); a document longer than `max_len` gives several
pieces, none is dropped; equal rows get a slot each; rows with a null doc_id are packed like any other, and dealt over shards by
their row; a very long text is tokenized in stretches, with the tokens of the whole; an empty table gives no rows; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WorkDir, column, table

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed values of the vocabulary: how texts are cut before merging, and the free id that ends a document.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_DOCUMENT = 50256
#: Places where the pattern ends a piece whatever stands around: before white space, and between ASCII letters, digits and marks
#: (but for an apostrophe, which may begin an ending such as 's).
_CUT = re.compile(r"(?<=[!-~])(?=[ \t\n\r])|(?<=[A-Za-z])(?=[0-9!-/:-@\[-`{-~])|(?<=[0-9])(?=[A-Za-z!-/:-@\[-`{-~])|(?<=[!-&(-/:-@\[-`{-~])(?=[A-Za-z0-9])")
STRETCH = 100_000


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """The tokenizer of a rank file, loaded once a worker."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, vocabulary: str) -> list[int]:
    """Token ids of a text; long texts go in stretches that end where the pattern cuts anyway, however far that is."""
    own = encoder(vocabulary)
    if len(text) <= STRETCH:
        return own.encode_ordinary(text)
    out, at = [], 0
    while at < len(text):
        cut = _CUT.search(text, at + STRETCH)
        end = cut.start() if cut else len(text)
        out += own.encode_ordinary(text[at:end])
        at = end
    return out


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and tokens of each whole text, its end included."""

    def run(batches):
        for batch in batches:
            n = [len(encode(t, vocabulary)) + 1 if t else 1 for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")


def salted(sizes: DataFrame) -> DataFrame:
    """A number for each row, to be kept by writing the table."""
    return sizes.withColumn("salt", F.monotonically_increasing_id())


#: Parts in which the pieces of a bucket are ranked; fixed, so that batches and slots do not depend on the session.
SHARDS = 512


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """Upper ends of at most n_buckets buckets over sorted distinct lengths, with the least padding: the sum over all
    pieces of (end of its bucket - its length)."""
    m = len(lengths)
    if not m:
        return []
    c = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    s = np.concatenate([[0], np.cumsum(counts * lengths)]).astype(np.float64)
    best = np.concatenate([[0.0], np.full(m, np.inf)])  # least padding of the first j lengths
    back = []
    for _ in range(min(n_buckets, m)):
        new, prev = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        for j in range(1, m + 1):
            cost = best[:j] + lengths[j - 1] * (c[j] - c[:j]) - (s[j] - s[:j])
            prev[j] = int(np.argmin(cost))
            new[j] = cost[prev[j]]
        back.append(prev)
        best = new
        best[0] = np.inf
    out, j = [], m
    for prev in reversed(back):
        out.append(int(lengths[j - 1]))
        j = int(prev[j])
    return out[::-1]


def pack(sizes: DataFrame, max_len: int = 2048, n_buckets: int = 8, budget: int = 32_768, shards: int = SHARDS) -> DataFrame:
    """sizes: doc_id, n_tokens, and as a rule salt, a number of the row, which deals out rows without a doc_id. A row a piece: its
    bucket, batch and slot, and the padding it needs there. sizes is read several times: it should be a table."""
    piece = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_tokens") / max_len), F.lit(1)).cast("int") - 1)).alias("piece")
    salt = F.col("salt") if "salt" in sizes.columns else F.lit(0)
    pieces = sizes.select("doc_id", "n_tokens", salt.alias("salt"), piece).select(
        "doc_id", "salt", "piece", (F.col("piece").cast("long") * max_len).alias("start"), F.least(F.col("n_tokens") - F.col("piece").cast("long") * max_len, F.lit(max_len)).cast("int").alias("n_tokens")
    )
    histogram = sorted(map(tuple, pieces.groupBy("n_tokens").count().collect()))  # at most max_len rows
    ends = best_boundaries(np.array([n for n, _ in histogram], np.int64), np.array([k for _, k in histogram], np.int64), n_buckets)
    bucket, end = F.lit(0), F.lit(ends[-1] if ends else 0)
    for k, e in enumerate(ends[:-1]):
        bucket = bucket + (F.col("n_tokens") > e).cast("int")
    for e in reversed(ends[:-1]):
        end = F.when(F.col("n_tokens") <= e, F.lit(e)).otherwise(end)
    order = F.xxhash64("doc_id", "piece")
    shard = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("salt", "piece")).otherwise(order), F.lit(shards)).cast("int")
    placed = pieces.withColumns({"bucket": bucket, "bucket_len": end, "_hash": order, "_shard": shard})
    counts = placed.groupBy("bucket", "_shard").count()  # at most n_buckets * shards rows
    before = counts.select("bucket", "_shard", (F.sum("count").over(W.partitionBy("bucket").orderBy("_shard")) - F.col("count")).alias("_before"))
    rank = F.row_number().over(W.partitionBy("bucket", "_shard").orderBy("_hash", "doc_id", "piece", "n_tokens")) - 1
    ranked = placed.withColumn("_rank", rank).join(F.broadcast(before), ["bucket", "_shard"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    room = F.greatest(F.floor(F.lit(budget) / F.col("bucket_len")), F.lit(1)).cast("long")
    return ranked.select(
        "doc_id", "piece", "start", "n_tokens", "bucket", "bucket_len", F.floor(F.col("_rank") / room).cast("long").alias("batch"), (F.col("_rank") % room).cast("int").alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding")
    )


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = WorkDir(spark, "packing")
    return pack(work.cut(salted(token_counts(table(spark, sf_dir, "documents"))), "sizes"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the pipeline: the pieces of all that is left. Null and empty texts are a piece of one token, repeated rows
    are packed each, an empty table gives no rows, and columns besides doc_id and text are ignored."""
    work = WorkDir(spark, "packing-stage")
    return pack(work.cut(salted(token_counts(docs)), "sizes"))
