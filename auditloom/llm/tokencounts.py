"""Token counts by separator scan over flat token files.

A token file is a run of fixed-width ids (little-endian), documents end to end, each ended by one end-of-document id, and
nothing else: no index, no lengths. Files are read in blocks of BLOCK_BYTES wherever these fall. Each block is searched for
the id in one vectorised pass and gives its token count, its separators' places and nothing of the tokens. A prefix scan
over the blocks' summaries (tokens, separators, last place: a short row a block) stitches the boundaries: running sums give each
block's first token and first document, a running maximum of separator places gives where the document that enters a block
began. The carries go back to the blocks by a join, and each block turns its own places into documents.

`write_token_files` makes such files from documents, a file for each partition of the input; a file appears under its name
only when it is whole, and a task that runs again writes the same bytes again.

Defined results: a null or empty text is a document of 0 tokens; tokens behind a file's last separator form a document
that is not `complete`; an empty file has no documents; a file whose size is no multiple of the id's width raises; repeated
rows and null doc_ids are documents like any other; a very long text is tokenized in stretches, with the tokens of the whole, and
may run over many blocks; an empty table gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WorkDir, column, table
from .packing import END_OF_DOCUMENT, VOCABULARY, encode

DTYPE = "<u2"
BLOCK_BYTES = 8_000_000


def write_token_files(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Tokenize whole texts into flat files in `folder` (a URI that all executors reach); a row a document: its file and
    its place there. To be run once, by writing the result."""

    def run(batches):
        files, path = pafs.FileSystem.from_uri(folder)
        name = f"part-{TaskContext.get().partitionId():06d}.bin"
        own = f"{path}/.{name}-{uuid.uuid4().hex}"
        files.create_dir(path, recursive=True)
        n = 0
        with files.open_output_stream(own) as out:
            for batch in batches:
                for text in column(batch, "text").to_pylist():
                    out.write(np.array([*(encode(text, vocabulary) if text else ()), END_OF_DOCUMENT], DTYPE).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([name] * batch.num_rows), pa.array(np.arange(n, n + batch.num_rows)), column(batch, "doc_id")], ["file", "ordinal", "doc_id"])
                n += batch.num_rows
        if n:
            files.move(own, f"{path}/{name}")
        else:
            files.delete_file(own)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "file string, ordinal long, doc_id long")


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, n_bytes) of the .bin files in a folder."""
    files, path = pafs.FileSystem.from_uri(folder)
    found = [] if files.get_file_info(path).type == pafs.FileType.NotFound else files.get_file_info(pafs.FileSelector(path))
    return spark.createDataFrame([(x.base_name, x.size) for x in found if x.base_name.endswith(".bin") and not x.base_name.startswith(".")], "file string, n_bytes long")


def scan_blocks(files: DataFrame, folder: str, separator: int, dtype: str = DTYPE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, n_tokens, places of separators) of each block."""
    width = np.dtype(dtype).itemsize
    step = max(width, block_bytes // width * width)

    def run(batches):
        source, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            n_tokens, places = [], []
            for name, block, size in zip(*(column(batch, c).to_pylist() for c in ("file", "block", "n_bytes"))):
                if size % width:
                    raise ValueError(f"{name}: {size} bytes are no whole number of {width}-byte ids")
                with source.open_input_file(f"{path}/{name}") as f:
                    ids = np.frombuffer(f.read_at(min(step, size - block * step), block * step), dtype)
                n_tokens.append(len(ids))
                places.append(np.flatnonzero(ids == separator))
            yield pa.RecordBatch.from_arrays([column(batch, "file"), column(batch, "block"), pa.array(n_tokens, pa.int64()), pa.array(places, pa.list_(pa.int64()))], ["file", "block", "n_tokens", "places"])

    blocks = files.where("n_bytes > 0").select("file", "n_bytes", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_bytes") / step).cast("int") - 1)).alias("block"))
    return blocks.repartition("file", "block").mapInArrow(run, "file string, block int, n_tokens long, places array<long>")


def carries(blocks: DataFrame) -> DataFrame:
    """What enters each block of a file: tokens and documents before it, where the open document began, and whether it is the last."""
    summary = blocks.select("file", "block", "n_tokens", F.size("places").cast("long").alias("n"), F.array_max("places").alias("last"))
    file = W.partitionBy("file").orderBy("block")
    before = file.rowsBetween(W.unboundedPreceding, -1)
    summary = summary.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    opened = F.coalesce(F.max(F.col("first") + F.col("last")).over(before) + 1, F.lit(0))
    return summary.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), opened.alias("opened"), F.lead("block").over(file).isNull().alias("is_last"))


def stitch(blocks: DataFrame) -> DataFrame:
    """(file, ordinal, start, n_tokens, complete) of each document, from the blocks of each file."""
    held = blocks.join(carries(blocks).hint("merge"), ["file", "block"])
    ends = F.transform("places", lambda p: p + F.col("first"))
    # what follows the last separator of the file, if anything does
    stop = F.col("first") + F.col("n_tokens")
    rest = F.col("is_last") & (stop > F.coalesce(F.col("first") + F.array_max("places") + 1, F.col("opened")))
    ends = F.when(rest, F.concat(ends, F.array(stop))).otherwise(ends)
    rows = held.withColumn("ends", ends).select("file", "base", "opened", "ends", F.size("places").alias("n"), F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("opened")).otherwise(F.element_at("ends", F.greatest(F.col("i"), F.lit(1))) + 1)
    return rows.select("file", (F.col("base") + F.col("i")).alias("ordinal"), start.alias("start"), "end", (F.col("i") < F.col("n")).alias("complete")).select(
        "file", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"), "complete"
    )


def count_tokens(spark: SparkSession, folder: str, separator: int = END_OF_DOCUMENT, dtype: str = DTYPE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents of all token files in a folder, which are read once."""
    work = WorkDir(spark, "blocks")
    return stitch(work.cut(scan_blocks(token_files(spark, folder), folder, separator, dtype, block_bytes), "blocks"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are written as flat token files, counted from these alone, and named by their place in them."""
    work = WorkDir(spark, "tokens")
    folder = f"{work.path}/flat"
    places = work.cut(write_token_files(table(spark, sf_dir, "documents"), folder), "places")
    return places.hint("merge").join(count_tokens(spark, folder), ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens", "complete")
