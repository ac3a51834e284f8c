"""Change counts and change coupling that follow a stream of commits: only new commits are counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history as H
from ..session import discard, remove, written

_KEYS = {"churn": ["path"], "changes": ["path"], "shared": ["file_a", "file_b"]}
_COUNT = {"churn": "changes", "changes": "changes", "shared": "shared_changes"}


class HistoryTables:
    """Counts of a history in a folder, added to by batches of touches (sha, path).

    Each batch writes what it adds under its own number, so that a batch that is run again after a fault overwrites
    itself and nothing is counted twice.  A commit's touches must come in one batch, and each commit once, as
    the stream of `git_touches` gives them.  Every `fold_every` batches what they added is folded into a base, which counts once it is
    complete; only then are the parts of it dropped."""

    def __init__(self, spark: SparkSession, folder: str, limits: H.CouplingLimits = H.CouplingLimits(), fold_every: int = 50):
        self.spark, self.folder, self.limits, self.fold_every = spark, folder.rstrip("/"), limits, fold_every

    def update(self, touches: DataFrame, batch: int) -> None:
        """Adds a batch; the function for foreachBatch."""
        if batch <= self._base():
            return  # a batch from before the last fold is in the base
        seen = written(touches.select("sha", "path"), "touches")
        small = written(H.small_commits(seen, self.limits.max_files), "small")
        added = {"churn": H.churn(seen), "changes": H.changes(small), "shared": H.shared(small)}
        for name, df in added.items():
            df.write.mode("overwrite").parquet(f"{self.folder}/batch={batch}/{name}")
        discard(seen, small)
        if (batch + 1) % self.fold_every == 0:
            self.fold(batch)

    def _parts(self, kind: str) -> list[int]:
        """Numbers of the batches or bases whose last table was written."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}=*/shared/_SUCCESS")) or []
        return sorted(int(f.getPath().getParent().getParent().getName().partition("=")[2]) for f in found)

    def _base(self) -> int:
        return max(self._parts("base"), default=-1)

    def table(self, name: str) -> DataFrame | None:
        """churn or changes (path, changes), or shared (file_a, file_b, shared_changes), over all batches so far; None before the first."""
        base = self._base()
        parts = ([f"{self.folder}/base={base}/{name}"] if base >= 0 else []) + [f"{self.folder}/batch={b}/{name}" for b in self._parts("batch") if b > base]
        return self.spark.read.parquet(*parts).groupBy(*_KEYS[name]).agg(F.sum(_COUNT[name]).alias(_COUNT[name])) if parts else None

    def fold(self, last: int) -> None:
        """Makes one base of everything up to a batch."""
        before = self._base()
        for name in ("churn", "changes", "shared"):  # shared is the last one: with it the base is complete
            self.table(name).write.mode("overwrite").parquet(f"{self.folder}/base={last}/{name}")
        for kind in ("base", "batch"):
            for n in self._parts(kind):
                if n < last or (kind == "batch" and n == last):
                    remove(self.spark, f"{self.folder}/{kind}={n}")
        if before >= 0 and before != last:
            remove(self.spark, f"{self.folder}/base={before}")

    def coupling(self, files: DataFrame | None = None) -> DataFrame | None:
        """As `history.coupling` over all touches so far."""
        pairs = self.table("shared")
        return None if pairs is None else H.coupled(pairs, self.table("changes"), self.limits, files)
