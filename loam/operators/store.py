"""Results kept from run to run: by content for what depends on one blob, and by run for what depends on a whole repository."""

from __future__ import annotations

import hashlib
import json
import warnings
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, remove, written


@dataclass
class Counters:
    """What stores did in one run: hits and misses by content and by run, and rows or runs written."""

    hits: int = 0
    misses: int = 0
    run_hits: int = 0
    run_misses: int = 0
    writes: int = 0


class ResultStore:
    """A folder of Parquet rows (producer, version, key, used_at, and the result's columns).

    Rows are appended, so that jobs can write side by side; of several for one key the last used counts.
    compact() folds them into one for each key, which `through` does by itself once there are twice as many."""

    def __init__(self, spark: SparkSession, path: str, producer: str, version: str, counters: Counters | None = None):
        self.spark, self.path, self.producer, self.version = spark, path, producer, version
        self.counters = counters or Counters()

    def _stored(self) -> DataFrame | None:
        try:
            stored = self.spark.read.parquet(self.path)
        except PySparkException:  # nothing was ever stored
            return None
        return stored.where((F.col("producer") == self.producer) & (F.col("version") == self.version)).drop("producer", "version")

    def _last_used(self, stored: DataFrame) -> DataFrame:
        """(key, used_at, copies, and others): for each key, the row that was used last."""
        values = [c for c in stored.columns if c not in ("key", "used_at")]
        last = stored.groupBy("key").agg(F.max_by(F.struct(*values), "used_at").alias("_v"), F.max("used_at").alias("used_at"), F.count("*").alias("copies"))
        return last.select("key", "used_at", "copies", "_v.*")

    def rows(self) -> DataFrame | None:
        """(key and others) of this producer and version: for each key, the row that was used last."""
        stored = self._stored()
        return None if stored is None else self._last_used(stored).drop("used_at", "copies")

    def _write(self, results: DataFrame, overwrite: bool = False) -> None:
        stamped = results.withColumns({"producer": F.lit(self.producer), "version": F.lit(self.version)})
        if "used_at" not in results.columns:
            stamped = stamped.withColumn("used_at", F.current_timestamp())
        stamped.write.mode("overwrite" if overwrite else "append").option("partitionOverwriteMode", "dynamic").partitionBy("producer", "version").parquet(self.path)

    def through(self, inputs: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], renew_days: int = 1) -> DataFrame:
        """Results (key and others) of the inputs: stored ones, and those of the rest, which are stored.

        compute gets the inputs whose key isn't stored, one for each key, and must keep `key`.  A stored
        result that wasn't used for renew_days is stamped anew, so that prune() keeps what is in use.  Hits and misses are observed on the
        one join there is; of inputs that share a missing key all but one are hits."""
        others = [c for c in inputs.columns if c != key]
        keys = inputs.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("_n"), *(F.first(c).alias(f"_in_{c}") for c in others))
        stored = self._stored()
        seen, copies = Observation(), F.lit(0)
        if stored is not None:
            last = self._last_used(stored)
            values = [c for c in last.columns if c not in ("key", "used_at", "copies")]
            last = last.select("key", "used_at", "copies", F.struct(*values).alias("_value"))
            keys, copies = keys.join(last, "key", "left"), F.coalesce("copies", F.lit(0))
            missed = F.col("used_at").isNull()
        else:
            values, missed = [], F.lit(True)
        counted = keys.observe(seen, F.sum(F.when(missed, F.col("_n") - 1).otherwise(F.col("_n"))).alias("hits"), F.count_if(missed).alias("misses"), F.count_if(~missed).alias("kept"), F.sum(copies).alias("copies"))
        known = written(counted.withColumn("_missed", missed), "known")
        found = {k: v or 0 for k, v in seen.get.items()}
        self.counters.hits += found["hits"]
        self.counters.misses += found["misses"]
        made = None
        if found["misses"]:
            made = written(compute(known.where("_missed").select("key", *(F.col(f"_in_{c}").alias(c) for c in others))), "made")
            self._write(made)
            self.counters.writes += found["misses"]
        if stored is None:
            return made if made is not None else compute(inputs.limit(0).withColumnRenamed(key, "key"))
        hit = known.where("not _missed").select("key", "_value.*")
        late = known.where(~F.col("_missed") & (F.col("used_at") < F.current_timestamp() - F.expr(f"interval {renew_days} days"))).select("key", "_value.*")
        if not late.isEmpty():
            self._write(late)
        if found["copies"] > 2 * found["kept"]:
            self.compact()
        return hit if made is None else hit.unionByName(made)

    def compact(self, days: float | None = None) -> None:
        """Rewrites this producer's rows as one for each key; with days only those used within so many.

        The fold is written aside first, then replaces the partition.  Rows that another job appends meanwhile can be
        lost, which costs their computation anew and nothing else."""
        stored = self._stored()
        if stored is None:
            return
        folded = self._last_used(stored).drop("copies")
        if days is not None:
            folded = folded.where(F.col("used_at") > F.current_timestamp() - F.expr(f"interval {int(days * 86400)} seconds"))
        folded = written(folded, "folded")
        if folded.isEmpty():
            remove(self.spark, f"{self.path}/producer={_escaped(self.spark, self.producer)}/version={_escaped(self.spark, self.version)}")
        else:
            self._write(folded, overwrite=True)
        discard(folded)


def _escaped(spark: SparkSession, value: str) -> str:
    """A partition's value as it stands in a path."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(value))


def prune(spark: SparkSession, path: str, days: float) -> None:
    """Drops the results of all producers in a folder of a ResultStore that weren't used within so many days; 0 empties it."""
    try:
        found = spark.read.parquet(path).select("producer", "version").distinct().collect()  # a handful
    except PySparkException:
        return
    for r in found:  # partition values that look like numbers are read as numbers
        ResultStore(spark, path, str(r["producer"]), str(r["version"])).compact(days)


_INDEX = "used_at timestamp, tables string"


class RunStore:
    """Whole results of a producer, a set of tables for each key of a run, in a folder.

    Each table of a run is a partition of its own, and is overwritten as one; the run's entry in the index is written
    last and names the tables with their schemas, so that half a run is never found.  A store that can't be read
    or written costs the computation, with a warning."""

    def __init__(self, spark: SparkSession, path: str, counters: Counters | None = None):
        self.spark, self.path, self.counters = spark, path, counters or Counters()

    def _folder(self, producer: str, version: str) -> str:
        return f"{self.path}/{quote(producer, safe='')}/{quote(version, safe='')}"

    def _entry(self, folder: str, key: str) -> tuple[datetime, dict[str, str]] | None:
        try:
            rows = self.spark.read.schema(_INDEX).parquet(f"{folder}/index/run_key={key}").collect()
        except PySparkException:  # no such run
            return None
        return (rows[0]["used_at"], json.loads(rows[0]["tables"])) if rows else None

    def _note(self, folder: str, key: str, tables: dict[str, str]) -> None:
        row = self.spark.createDataFrame([(json.dumps(tables), key)], "tables string, run_key string").withColumn("used_at", F.current_timestamp())
        row.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_key").parquet(f"{folder}/index")

    def get(self, producer: str, version: str, key: str, renew_days: int = 1) -> dict[str, DataFrame] | None:
        """The tables of a run, which no job was needed for; None if there is no such run."""
        folder = self._folder(producer, version)
        entry = self._entry(folder, key)
        if entry is None:
            self.counters.run_misses += 1
            return None
        self.counters.run_hits += 1
        if entry[0] < datetime.now() - timedelta(days=renew_days):
            self._note(folder, key, entry[1])
        return {name: self._table(folder, name, key, json.loads(schema)) for name, schema in entry[1].items()}

    def _table(self, folder: str, name: str, key: str, schema: dict) -> DataFrame:
        kind = T.StructType.fromJson(schema)
        try:
            return self.spark.read.schema(kind).parquet(f"{folder}/table={quote(name, safe='')}/run_key={key}")
        except PySparkException:  # a table without rows has no partition
            return self.spark.createDataFrame([], kind)

    def put(self, producer: str, version: str, key: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Stores a run's tables and gives them back as stored; as they came, if they can't be stored."""
        folder = self._folder(producer, version)
        try:
            for name, df in tables.items():
                target = f"{folder}/table={quote(name, safe='')}"
                remove(self.spark, f"{target}/run_key={key}")  # what a broken run left, which a table without rows would not overwrite
                df.withColumn("run_key", F.lit(key)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_key").parquet(target)
            self._note(folder, key, {name: df.schema.json() for name, df in tables.items()})
        except (PySparkException, Py4JJavaError, OSError) as e:
            warnings.warn(f"{self.path}: {str(e).splitlines()[0]}; going on without the store", stacklevel=2)
            return tables
        self.counters.writes += 1
        return {name: self._table(folder, name, key, json.loads(df.schema.json())) for name, df in tables.items()}

    def through(self, producer: str, version: str, key: str, compute: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
        """The tables of a run, computed and stored if there is no such run yet."""
        found = self.get(producer, version, key)
        return self.put(producer, version, key, compute()) if found is None else found

    def prune(self, producer: str, version: str, days: float) -> None:
        """Drops the runs of a producer that weren't used within so many days; 0 empties it."""
        folder = self._folder(producer, version)
        try:
            entries = self.spark.read.schema(f"{_INDEX}, run_key string").parquet(f"{folder}/index").collect()
        except PySparkException:
            return
        for r in entries:
            if r["used_at"] <= datetime.now() - timedelta(days=days):
                # the entry goes first, so that a half dropped run isn't found
                for place in ("index", *(f"table={quote(name, safe='')}" for name in json.loads(r["tables"]))):
                    remove(self.spark, f"{folder}/{place}/run_key={r['run_key']}")


def run_key(*parts: object) -> str:
    """A digest of what a run's result depends on."""
    return hashlib.sha256("\0".join(map(repr, parts)).encode()).hexdigest()
