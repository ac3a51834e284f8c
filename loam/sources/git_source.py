"""A git repository as Python data sources: `git_log`, `git_touches` (batch and stream) and `git_tree`.

Every partition asks git for its own range of the history or its own folders, on the executor that reads
it, where the repository must be at the same path.  No listing passes through the driver or a shared
file: the driver asks for one number, and for the names of a few folders.

Options: root; rev (HEAD); newest (commits, 0 for all); paths (JSON list, commits that touch them only); range (commits in a partition, 5000);
folders (partitions of a tree, 32); quoted (names in a tree as git quotes them).
"""

from __future__ import annotations

import json
import subprocess
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

RECORD = "\x1e"
TOUCHES = "sha string, path string"
LOG = "sha string, author string, author_email string, date string, message string"
TREE = "mode string, blob string, path string"


class GitError(RuntimeError):
    pass


def answer(root: str, *args: str) -> str:
    """What git says, for small facts."""
    done = subprocess.run(["git", "-C", root, *args], capture_output=True)
    if done.returncode:
        raise GitError(done.stderr.decode(errors="replace").strip())
    return done.stdout.decode(errors="replace")


def records(root: str, *args: str, end: str) -> Iterator[str]:
    """git's output cut at `end`, as it comes."""
    with subprocess.Popen(["git", "-C", root, *args], stdout=subprocess.PIPE, stderr=subprocess.PIPE) as git:
        rest, mark = b"", end.encode()
        while piece := git.stdout.read(1 << 20):
            *whole, rest = (rest + piece).split(mark)
            for w in whole:
                yield w.decode(errors="replace")
        if rest:
            yield rest.decode(errors="replace")
        why = git.stderr.read().decode(errors="replace").strip()
    if git.returncode:
        raise GitError(why)


class Range(InputPartition):
    """So many commits of a revision (or of `a..b`), after the first `skip`."""

    def __init__(self, revs: str, skip: int, count: int):
        self.revs, self.skip, self.count = revs, skip, count


class Folders(InputPartition):
    """A part of a tree: folders with all below them, or without what is in their own folders."""

    def __init__(self, rev: str, paths: list[str], deep: bool):
        self.rev, self.paths, self.deep = rev, paths, deep


class _History:
    def __init__(self, options: dict[str, str]):
        self.root, self.rev = options["root"], options.get("rev", "HEAD")
        self.newest, self.size = int(options.get("newest", 0)), max(1, int(options.get("range", 5000)))
        self.among = ["--", *json.loads(options.get("paths", "[]"))]

    def ranges(self, revs: str) -> list[InputPartition]:
        n = int(answer(self.root, "rev-list", "--count", *([f"--max-count={self.newest}"] if self.newest else []), revs, *self.among))
        return [Range(revs, at, min(self.size, n - at)) for at in range(0, n, self.size)]

    def lines(self, part: Range) -> Iterator[tuple]:
        raise NotImplementedError

    def listed(self, part: Range, *form: str, end: str) -> Iterator[str]:
        return records(self.root, "-c", "core.quotePath=false", "log", f"--skip={part.skip}", f"--max-count={part.count}", *form, part.revs, *self.among, end=end)


class _Log(_History):
    def lines(self, part: Range) -> Iterator[tuple]:
        for r in self.listed(part, f"--pretty=format:%H{RECORD}%an{RECORD}%ae{RECORD}%aI{RECORD}%B{RECORD}{RECORD}", end=RECORD + RECORD):
            fields = r.split(RECORD)
            if len(fields) >= 5:
                yield tuple(fields[:5])


class _Touches(_History):
    def lines(self, part: Range) -> Iterator[tuple]:
        for r in self.listed(part, "--name-only", f"--pretty=format:{RECORD}%H", end=RECORD):
            sha, *paths = r.split("\n")
            for path in paths:
                if path:
                    yield sha, path


class _Reader(DataSourceReader):
    def __init__(self, history: _History):
        self.history = history

    def partitions(self) -> list[InputPartition]:
        return self.history.ranges(self.history.rev)

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        return iter(()) if partition is None else self.history.lines(partition)  # none: there are no partitions


class _Stream(DataSourceStreamReader):
    """Commits that the revision has and had not at the batch before, whatever happened to it meanwhile."""

    def __init__(self, history: _History):
        self.history = history

    def initialOffset(self) -> dict:  # noqa: N802
        return {"rev": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"rev": answer(self.history.root, "rev-parse", "--verify", f"{self.history.rev}^{{commit}}").strip()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if start["rev"] == end["rev"]:
            return []
        return self.history.ranges(f"{start['rev']}..{end['rev']}" if start["rev"] else end["rev"])

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        return iter(()) if partition is None else self.history.lines(partition)  # none: there are no partitions

    def commit(self, end: dict) -> None:
        pass


class _Tree(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.rev = options["root"], options.get("rev", "HEAD")
        self.wanted, self.quoted = int(options.get("folders", 32)), options.get("quoted", "false") == "true"

    def below(self, path: str) -> list[str]:
        """The folders right below one."""
        found = records(self.root, "ls-tree", "-d", "-z", "--name-only", self.rev, *([f"{path}/"] if path else []), end="\0")
        return [f for f in found if f]

    def partitions(self) -> list[InputPartition]:
        flat, deep, level = [""], self.below(""), 0
        while deep and len(deep) < self.wanted and level < 4:  # a few large folders are opened
            flat, deep, level = flat + deep, [d for f in deep for d in self.below(f)], level + 1
        share = -(-len(deep) // self.wanted) or 1
        return [Folders(self.rev, [f], False) for f in flat] + [Folders(self.rev, deep[k : k + share], True) for k in range(0, len(deep), share)]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:
            return
        form = ["-r"] if partition.deep else []
        form += [] if self.quoted else ["-z"]
        for path in partition.paths:
            for r in records(self.root, "ls-tree", *form, partition.rev, *([f"{path}/"] if path else []), end="\n" if self.quoted else "\0"):
                head, _, name = r.partition("\t")
                if name:
                    mode, kind, blob = head.split()
                    if kind == "blob":
                        yield mode, blob, name


class GitLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return LOG

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_Log(dict(self.options)))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(_Log(dict(self.options)))


class GitTouches(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_touches"

    def schema(self) -> str:
        return TOUCHES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_Touches(dict(self.options)))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(_Touches(dict(self.options)))


class GitTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_tree"

    def schema(self) -> str:
        return TREE

    def reader(self, schema) -> DataSourceReader:
        return _Tree(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session.  The classes travel with the query, so that executors need no package of ours for them."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    for source in (GitLog, GitTouches, GitTree):
        spark.dataSource.register(source)
