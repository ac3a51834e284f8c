"""A git repository as tables.

Small facts (a revision, a branch) are asked for on the driver.  The log and the tree are data sources
(`git_source`), read in ranges of the history and folders of the tree; contents are read on the executors, one `git cat-file
--batch` for each partition, and only for the files that a query still needs.
"""

from __future__ import annotations

import json
import subprocess
import threading
import warnings
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .git_source import GitError, register
from .git_source import answer as _git


def resolve_rev(root: str, rev: str = "HEAD") -> str:
    return _git(root, "rev-parse", "--verify", f"{rev}^{{commit}}").strip()


def branch_at(root: str, rev: str = "HEAD") -> str | None:
    """The local branch that rev names, else None."""
    name = _git(root, "rev-parse", "--symbolic-full-name", rev).strip()
    return name.removeprefix("refs/heads/") if name.startswith("refs/heads/") else None


def toplevel(folder: str) -> str | None:
    """The real path of the repository that holds a folder, or None."""
    try:
        return str(Path(_git(folder, "rev-parse", "--show-toplevel").strip()).resolve())
    except (GitError, OSError):
        return None


def _read(spark: SparkSession, source: str, root: str, **options: object) -> DataFrame:
    register(spark)
    given = {k: json.dumps(v) if isinstance(v, list) else str(v) for k, v in options.items()}
    return spark.read.format(source).options(root=str(Path(root).resolve()), **given).load()


def ls_tree(spark: SparkSession, root: str, rev: str = "HEAD") -> DataFrame:
    """(mode, blob, path) of the files at a revision; names that git quotes stay quoted."""
    return _read(spark, "git_tree", root, rev=resolve_tree(root, rev), quoted="true")


def resolve_tree(root: str, rev: str = "HEAD") -> str:
    return _git(root, "rev-parse", "--verify", f"{rev}^{{tree}}").strip()


def tracked(spark: SparkSession, root: str, rev: str = "HEAD") -> DataFrame:
    """(blob, path) of the tracked files, unquoted; none, with a warning, where git can't list them."""
    try:
        tree = resolve_tree(root, rev)
    except GitError as e:
        warnings.warn(f"no tracked files: {e}", stacklevel=2)
        return spark.createDataFrame([], "blob string, path string")
    return _read(spark, "git_tree", root, rev=tree).select("blob", "path")


def show(root: str, rev: str, path: str) -> str | None:
    """The content of one path at a revision; None if it isn't there."""
    try:
        return _git(root, "show", f"{rev}:{path}")
    except GitError:
        return None


def log(spark: SparkSession, root: str, rev: str = "HEAD", newest: int = 0, paths: tuple[str, ...] = ()) -> DataFrame:
    """(sha, author, author_email, date, ts, message) of the history, the newest commits only if asked; 0 is all."""
    rows = _read(spark, "git_log", root, rev=resolve_rev(root, rev), newest=newest, paths=list(paths))
    clean = lambda c: F.regexp_replace(c, r"\A\s+|\s+\z", "")
    return rows.select(clean("sha").alias("sha"), "author", "author_email", "date", F.try_to_timestamp("date").alias("ts"), clean("message").alias("message"))


def touches(spark: SparkSession, root: str, rev: str = "HEAD", newest: int = 0) -> DataFrame:
    """(sha, path) of the changed paths; a commit that lists nothing has no row."""
    return _read(spark, "git_touches", root, rev=resolve_rev(root, rev), newest=newest)


def touches_stream(spark: SparkSession, root: str, rev: str = "HEAD") -> DataFrame:
    """(sha, path) as a stream: first the whole history of a revision (a branch, say), then what comes to it."""
    register(spark)
    return spark.readStream.format("git_touches").options(root=str(Path(root).resolve()), rev=rev).load()


def contents(files: DataFrame, root: str, content: str = "content") -> DataFrame:
    """files with `content`, read by blob; root must be the same path on every executor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with subprocess.Popen(["git", "-C", root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as git:
            for batch in batches:
                # a batch is asked for at once, while its answers are read
                ask = threading.Thread(target=lambda wanted: (git.stdin.write(wanted), git.stdin.flush()), args=("".join(f"{b}\n" for b in batch["blob"]).encode(),))
                ask.start()
                out = []
                for _ in range(len(batch)):
                    head = git.stdout.readline().split()
                    if len(head) < 3:
                        out.append(None)
                        continue
                    out.append(git.stdout.read(int(head[2])).decode(errors="replace"))
                    git.stdout.read(1)
                ask.join()
                yield batch.assign(**{content: out})
            git.stdin.close()

    return files.mapInPandas(run, T.StructType([*files.schema.fields, T.StructField(content, T.StringType())]))
