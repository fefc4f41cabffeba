"""Project trees, archives and repositories as tables of files."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import subprocess
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.ignores import IGNORE_FILES, without_ignored
from ..schema import FILES
from ..work import Rounds
from .trees import ALWAYS_IGNORED, read_trees

def _lines(path: str) -> list[str]:
    if not os.path.isfile(path):
        return []
    with open(path, encoding="utf-8", errors="replace") as f:
        return f.read().splitlines()


def scan_project(spark: SparkSession, root: str, project_id: str | None = None, names=IGNORE_FILES) -> DataFrame:
    """Files of one tree or archive: relative path, size and content (null where it is too large or cannot be read), without what its
    ignore files name. Read once, in tasks, and written as a table that the rules read columns of."""
    found = read_trees(spark, root, single="true", **({"project": project_id} if project_id else {}))
    rows, _ = Rounds(spark, "tree").write(found)
    unsafe = rows.where("path is null").first()
    if unsafe:
        raise ValueError(f"{root}: {unsafe['skipped']}")
    return without_ignored(rows, names).select(*(c.split()[0] for c in FILES.split(", ")))


def scan_corpus(spark: SparkSession, root: str, names=IGNORE_FILES, **options) -> tuple[DataFrame, DataFrame]:
    """Files of all projects and archives below root, and project_id, path, skipped of what could not be read."""
    rows, _ = Rounds(spark, "corpus").write(read_trees(spark, root, **options))
    files = without_ignored(rows.where("path is not null"), names).select(*(c.split()[0] for c in FILES.split(", ")))
    return files, rows.where("skipped is not null").select("project_id", "path", "skipped")


def scan_folders(root: str, spark: SparkSession, project_id: str | None = None) -> DataFrame:
    """project_id, path, parent, is_dir of folders and files; links are not followed."""
    rows, root = [], os.path.abspath(root)
    for top, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in ALWAYS_IGNORED and not os.path.islink(f"{top}/{d}"))
        for n, is_dir in [*((d, True) for d in dirs), *((f, False) for f in names)]:
            path = os.path.relpath(f"{top}/{n}", root)
            rows.append((project_id or os.path.basename(root), path, os.path.dirname(path), is_dir))
    return spark.createDataFrame(rows, "project_id string, path string, parent string, is_dir boolean")


def tree(folders: DataFrame) -> DataFrame:
    """folders with `place` in their parent: folders first, then by name in the root collation of Unicode."""
    name = F.substring_index("path", "/", -1)
    order = [F.desc("is_dir"), F.collate(name, "UNICODE"), name]
    return folders.withColumn("place", F.row_number().over(W.partitionBy("project_id", "parent").orderBy(*order)))


def _staging(prefix: str) -> str:
    """A folder for what a command fetches, gone when it ends."""
    to = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, to, ignore_errors=True)
    return to


def extract_zip(archive: str, to: str | None = None) -> str:
    """Unpack; an entry that would leave the folder raises."""
    to = os.path.realpath(to or _staging("auditloom-zip-"))
    with zipfile.ZipFile(archive) as z:
        for name in z.namelist():
            there = os.path.realpath(os.path.join(to, name))
            if there != to and not there.startswith(to + os.sep):
                raise ValueError(f"entry leaves the archive's folder: {name}")
        z.extractall(to)
    return to


def is_git_url(target: str) -> bool:
    return bool(re.match(r"(https?|git|ssh)://", target)) and (target.endswith(".git") or "://" in target) or target.startswith("git@")


def assert_safe_git_url(url: str) -> None:
    """Options and helper transports are refused."""
    if url.startswith("-") or re.match(r"[A-Za-z0-9+.-]+::", url):
        raise ValueError(f"unsafe repository address: {url}")


def repo_name(url: str) -> str:
    return re.sub(r"\.git$", "", url.rstrip("/").rsplit("/", 1)[-1].rsplit(":", 1)[-1]) or "repository"


def clone(url: str, timeout_s: int = 120) -> str:
    assert_safe_git_url(url)
    to = os.path.join(_staging("auditloom-git-"), repo_name(url))
    subprocess.run(["git", "clone", "--depth", "1", "--", url, to], check=True, timeout=timeout_s, capture_output=True)
    return to


def resolve_target(target: str) -> str:
    """Folder of a repository address, an archive or a folder."""
    if is_git_url(target):
        return clone(target)
    if target.endswith(".zip") and os.path.isfile(target):
        return extract_zip(target)
    if not os.path.isdir(target):
        raise FileNotFoundError(target)
    return target


def local_branches(root: str) -> list[str]:
    """Names under refs/heads and in packed-refs, without a git program; empty: unknown."""
    heads, found = os.path.join(root, ".git", "refs", "heads"), set()
    for top, _, names in os.walk(heads):
        found |= {os.path.relpath(os.path.join(top, n), heads) for n in names}
    for line in _lines(os.path.join(root, ".git", "packed-refs")):
        if m := re.fullmatch(r"[0-9a-f]{40} refs/heads/(.+)", line):
            found.add(m[1])
    return sorted(found)


def baseline_files(spark: SparkSession, root: str, ref: str, project_id: str | None = None) -> DataFrame:
    """The same tree at a commit, from a worktree of its own, which is gone again when the files are read."""
    if ref.startswith("-"):
        raise ValueError(f"unsafe reference: {ref}")
    parent = tempfile.mkdtemp(prefix="auditloom-base-")
    to = os.path.join(parent, "tree")
    git = lambda *args: subprocess.run(["git", "-C", root, *args], check=True, timeout=60, capture_output=True, text=True).stdout.strip()
    try:
        inner = os.path.relpath(os.path.realpath(root), os.path.realpath(git("rev-parse", "--show-toplevel")))
        git("worktree", "add", "--detach", to, ref)
    except (subprocess.SubprocessError, OSError):
        shutil.rmtree(parent, ignore_errors=True)
        raise ValueError(f"{ref} is neither a saved report nor a commit of {root}") from None
    try:
        return scan_project(spark, os.path.normpath(os.path.join(to, inner)), project_id or os.path.basename(os.path.abspath(root)))
    finally:
        with contextlib.suppress(subprocess.SubprocessError, OSError):
            git("worktree", "remove", "--force", to)
        shutil.rmtree(parent, ignore_errors=True)
