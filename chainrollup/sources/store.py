"""Merges into stored tables, and tables kept as versions behind a pointer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import DECIMALS, Decimals
from ..operators.windows import latest_row

ROLLUP_KEY = ["series", "dimension"]


def merge_additive(base: DataFrame, delta: DataFrame, key: list[str], value: str = "value", amounts: Decimals = DECIMALS) -> DataFrame:
    """base + delta by key. Not idempotent: see streaming.stream for replays."""
    return base.unionByName(delta).groupBy(*key).agg(amounts.sum(F.col(value)).alias(value))


def merge_set(base: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """Rows of delta whose key base lacks are added, once."""
    return base.unionByName(delta.dropDuplicates(key).join(base.select(*key), key, "left_anti"))


def merge_latest(base: DataFrame, delta: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key by order (height, then the sequence within the block)."""
    return latest_row(base.unionByName(delta), key, order)


def merge_by_key(base: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """delta overwrites base by key."""
    return base.join(delta.select(*key).distinct(), key, "left_anti").unionByName(delta)


def fold_flows(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row a flow from sightings (flow_type, denom, amount, day, height, state, progress, seq), which can be merged with others: the
    first known type, denomination and amount with their place, the least day and height, the state by (height, progress, seq)."""
    first = lambda c, cond: F.min(F.when(cond, F.struct("height", "seq", F.col(c).alias("value")))).alias(c)
    return rows.groupBy(*key).agg(
        first("flow_type", F.col("flow_type").isNotNull() & (F.col("flow_type") != "unknown")), first("denom", F.col("denom").isNotNull()), first("amount", F.col("amount").isNotNull()),
        F.min("day").alias("day"), F.min("height").alias("first_height"), F.max(F.struct("height", "progress", "seq", F.col("state").alias("value"))).alias("last"))


def merge_folded_flows(base: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    least = [F.min(c).alias(c) for c in ("flow_type", "denom", "amount", "day", "first_height")]
    return base.unionByName(delta).groupBy(*key).agg(*least, F.max("last").alias("last"))


def flows_of(folded: DataFrame, key: list[str]) -> DataFrame:
    """Key, flow_type, denom, amount, day, first_height, last_state, last_height of folded flows."""
    return folded.select(*key, F.coalesce("flow_type.value", F.lit("unknown")).alias("flow_type"), F.col("denom.value").alias("denom"), F.col("amount.value").alias("amount"), "day", "first_height", F.col("last.value").alias("last_state"), F.col("last.height").alias("last_height"))


def merge_flow(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row per flow from sightings: see fold_flows."""
    return flows_of(fold_flows(rows, key), key)


def merge_least(base: DataFrame, delta: DataFrame, key: list[str], value: str) -> DataFrame:
    """The least value of each key."""
    return base.unionByName(delta).groupBy(*key).agg(F.min(value).alias(value))


def rebuild_series(base: DataFrame, fresh: DataFrame, series: str) -> DataFrame:
    """base with one series replaced by its recomputed rows. Stored tables are partitioned by series: see `overwrite_series`."""
    return base.where(F.col("series") != series).unionByName(fresh.where(F.col("series") == series))


def overwrite_series(fresh: DataFrame, path: str) -> None:
    """Swaps the partitions of the series in `fresh`; the other series' files are not touched."""
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("series").parquet(path)


def resume_guard(rows: DataFrame, control: DataFrame, job: str) -> DataFrame:
    """Rows above the job's committed height only (all, if it has none)."""
    last = control.where(F.col("job") == job).agg(F.coalesce(F.max("last_height"), F.lit(-1)).alias("__last"))
    return rows.crossJoin(F.broadcast(last)).where(F.col("height") > F.col("__last")).drop("__last")


class VersionedTable:
    """A Parquet table of which every write is a new numbered folder. A folder counts once the writer's _SUCCESS file stands in it, and is not changed after
    that; the table is the greatest that counts, so a reader never sees a half-written, vanished or empty version between two.
    One writer at a time. Old versions stay until `forget`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        """The numbers of the complete versions, in order."""
        return [v for v, complete in self._folders() if complete]

    def _folders(self) -> list[tuple[int, bool]]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("v=")]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted((int(p.getName()[2:]), fs.exists(done(p, "_SUCCESS"))) for p in found)

    def version(self) -> int:
        """The current version's number, -1 if there is none."""
        return max(self.versions(), default=-1)

    def read(self, schema: str, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        return self.spark.read.schema(schema).parquet(f"{self.path}/v={v}") if v >= 0 else self.spark.createDataFrame([], schema)

    def next_version(self) -> int:
        """Beyond what a failed writer may have left."""
        return max((v for v, _ in self._folders()), default=-1) + 1

    def write(self, df: DataFrame, *partitions: str) -> int:
        v = self.next_version()
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(*partitions) if partitions else writer).parquet(f"{self.path}/v={v}")
        return v

    def forget(self, keep: int = 2) -> None:
        """Deletes all but the newest `keep` complete versions, and incomplete ones before them."""
        kept = self.versions()[-keep:]
        for v, _ in self._folders():
            if kept and v < kept[0]:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={v}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
