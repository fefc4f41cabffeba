"""Ignore files of many projects, applied as joins.

Each project's ignore files become rows of patterns. A pattern hangs in a trie of path segments at the node that its leading
literal segments name, or, if it has no slash, at its name or its extension. Every folder and file of a project looks up the nodes
on its way from the root, its own name and its extension, all by equality; only what meets there is tested by regular
expression. The last pattern that fits decides, and a folder that is ignored stays so with all that it holds, whatever a later
pattern says of its contents.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..sources.trees import ALWAYS_IGNORED

IGNORE_FILES = (".gitignore", ".auditignore")
_WILD = set("*?[\\")


def trie_place(pattern: str) -> tuple[str, str]:
    """(kind, key) of the node at which a pattern hangs: 'path' and leading literal segments, 'name' or 'ext'; key '' is the root."""
    body = pattern.rstrip("/")
    anchored, body = "/" in body, body.lstrip("/")
    literal = lambda s: not _WILD & set(s)
    if anchored:
        lead = []
        for segment in body.split("/"):
            if not literal(segment):
                break
            lead.append(segment)
        return "path", "/".join(lead)
    if literal(body):
        return "name", body
    stem, dot, tail = body.rpartition(".")
    return ("ext", dot + tail) if dot and tail and literal(tail) else ("path", "")


def pattern_rows(files: DataFrame, names=IGNORE_FILES, always=ALWAYS_IGNORED) -> DataFrame:
    """project_id, seq, kind, key, regex, folders_only, keep of every pattern of each project: the ignore files at its root in the
    order given, with what is always ignored behind the first."""
    mine = files.where(F.col("path").isin(*names) & F.col("content").isNotNull())
    place = F.array_position(F.array(*map(F.lit, names)), F.col("path"))
    given = mine.select("project_id", (2 * place).alias("file"), F.posexplode(F.split("content", "\r?\n")).alias("line", "text"))
    fixed = files.select("project_id").distinct().select("project_id", F.lit(3).cast("long").alias("file"), F.posexplode(F.array(*map(F.lit, always)).cast("array<string>")).alias("line", "text"))
    rows = given.unionByName(fixed).withColumn("text", F.trim("text")).where((F.col("text") != "") & ~F.startswith("text", F.lit("#")))

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                keep, body = text.startswith("!"), text.removeprefix("!")
                if body.strip("/"):
                    out.append((text, *trie_place(body), P.glob_regex(body, below=False), body.endswith("/"), keep))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.string()] * 4 + [pa.bool_()] * 2)] if out else [pa.array([], t) for t in [pa.string()] * 4 + [pa.bool_()] * 2], ["text", "kind", "key", "regex", "folders_only", "keep"])

    read = rows.select("text").distinct().mapInArrow(run, "text string, kind string, key string, regex string, folders_only boolean, keep boolean")
    return rows.join(read, "text").select("project_id", F.struct("file", "line").alias("seq"), "kind", "key", "regex", "folders_only", "keep")


def _prefixes(path: Column) -> Column:
    """The folders on a path from the root, and the path itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def ignored_entries(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """project_id, entry: the folders and files that their last fitting pattern ignores. paths: project_id, path of files."""
    entries = paths.select("project_id", F.explode(_prefixes(F.col("path"))).alias("entry"), "path").select("project_id", "entry", (F.col("entry") != F.col("path")).alias("is_dir"))
    entries = entries.groupBy("project_id", "entry").agg(F.bool_or("is_dir").alias("is_dir"))
    name = P.basename(F.col("entry"))
    node = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    nodes = F.concat(
        F.array(node("path", F.lit("")), node("name", name), node("ext", F.concat(F.lit("."), F.substring_index(name, ".", -1)))),
        F.transform(_prefixes(F.col("entry")), lambda p: node("path", p)),
    )
    met = entries.select("project_id", "entry", "is_dir", F.explode(nodes).alias("n")).select("project_id", "entry", "is_dir", "n.*").join(patterns, ["project_id", "kind", "key"])
    fits = met.where((F.col("is_dir") | ~F.col("folders_only")) & F.rlike("entry", F.col("regex")))
    last = fits.groupBy("project_id", "entry").agg(F.max_by("keep", "seq").alias("keep"))
    return last.where("not keep").select("project_id", "entry")


def ignored_paths(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """project_id, path of ignored files: any folder on the way is, or the file itself."""
    paths = files.select("project_id", "path")
    on_way = paths.select("project_id", "path", F.explode(_prefixes(F.col("path"))).alias("entry"))
    return on_way.join(ignored_entries(paths, patterns), ["project_id", "entry"]).select("project_id", "path").distinct()


def without_ignored(files: DataFrame, names=IGNORE_FILES) -> DataFrame:
    """files without what their project's own ignore files name."""
    return files.join(ignored_paths(files, pattern_rows(files, names)), ["project_id", "path"], "left_anti").select(*files.columns)
