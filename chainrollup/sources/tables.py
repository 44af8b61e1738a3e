"""Several stored tables that change together.

Each table is dealt into buckets (a day, a part of a hash), and the rows of a bucket stand in one folder of Parquet files that
is written once. What counts is the last commit: a small table that names the folder of each bucket of each table. A
change writes new folders for the buckets that it touches, and then the commit; readers see all of it or nothing, and
the folders of other buckets stay as they are. One writer at a time; any number of readers."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.numbers import DECIMALS, Decimals
from .files import children, delete
from .store import VersionedTable

COMMIT = "name string, bucket string, folder string"
BUCKET = "__bucket"


class Table(NamedTuple):
    """bucket: SQL of a row's bucket, a text without characters that file names escape. merge(stored rows, new rows) of the same buckets
    gives the rows that they have then; it must give the new rows themselves where nothing is stored."""

    schema: str
    bucket: str
    merge: Callable[[DataFrame, DataFrame], DataFrame]


class TableSet:
    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Table], amounts: Decimals = DECIMALS):
        self.spark, self.path, self.tables, self.amounts = spark, path.rstrip("/"), tables, amounts
        self.commits = VersionedTable(spark, f"{self.path}/commits")

    def folders(self, version: int | None = None) -> dict[tuple[str, str], str]:
        """(table, bucket) -> folder as of a commit, the last one by default."""
        return {(r["name"], r["bucket"]): r["folder"] for r in self.commits.read(COMMIT, version).collect()}

    def read(self, name: str, buckets: Iterable[str] | None = None, version: int | None = None) -> DataFrame:
        """A table, or some of its buckets: only their folders are listed."""
        wanted = None if buckets is None else set(buckets)
        return self._load(name, [f for (n, b), f in self.folders(version).items() if n == name and (wanted is None or b in wanted)])

    def _load(self, name: str, folders: list[str]) -> DataFrame:
        schema = self.tables[name].schema
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema).where("false")  # the optimizer sees that it is empty

    def next_version(self) -> int:
        """The number of the next commit; that of one that failed before its record was begun is used again."""
        return self.commits.next_version()

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        """What several tables of a change are made of, written once until the next `forget`."""
        path = f"{self.path}/staged/{self.next_version()}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _write(self, name: str, folder: str, rows: DataFrame) -> dict[str, str]:
        """Writes rows by bucket; returns the folders of the buckets that have any. Large buckets go to several tasks."""
        table = self.tables[name]
        cast = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(table.schema)])
        cast.withColumn(BUCKET, F.expr(table.bucket)).hint("rebalance", BUCKET).write.mode("overwrite").option("compression", "zstd").partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        return {c.partition("=")[2]: f"{folder}/{c}" for c in children(self.spark, f"{self.path}/{folder}") if c.startswith(f"{BUCKET}=")}

    def commit(self, changes: dict[str, DataFrame], replace: Iterable[str] = (), clear: dict[str, Iterable[str]] | None = None) -> int:
        """Merges rows into tables, all in one commit; returns its number. For tables in `replace` the rows take the place of what
        the touched buckets had; buckets in `clear` lose their rows first."""
        n, live = self.next_version(), self.folders()
        for name, buckets in (clear or {}).items():
            for b in buckets:
                live.pop((name, b), None)
        for name, rows in changes.items():
            new = self._write(name, f"{name}/{n}-new", rows)
            met = [b for b in new if (name, b) in live] if name not in replace else []
            if met:
                merged = self.tables[name].merge(self._load(name, [live[name, b] for b in met]), self._load(name, [new[b] for b in met]))
                new |= self._write(name, f"{name}/{n}", merged)
            live |= {(name, b): f for b, f in new.items()}
        record = [(name, b, f) for (name, b), f in sorted(live.items())]
        return self.commits.write(self.spark.createDataFrame(record, COMMIT).coalesce(1))

    def forget(self, keep: int = 2) -> None:
        """Deletes the folders that none of the last `keep` commits names, and what was staged. Readers of those commits are not disturbed."""
        used = {f for v in self.commits.versions()[-keep:] for f in self.folders(v).values()}
        for name in self.tables:
            for folder in children(self.spark, f"{self.path}/{name}"):
                inner = [f"{name}/{folder}/{c}" for c in children(self.spark, f"{self.path}/{name}/{folder}") if c.startswith(f"{BUCKET}=")]
                gone = [f for f in inner if f not in used]
                for f in [f"{name}/{folder}"] if len(gone) == len(inner) else gone:
                    delete(self.spark, f"{self.path}/{f}")
        delete(self.spark, f"{self.path}/staged")
        self.commits.forget(keep)
