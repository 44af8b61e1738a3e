"""What the operators of this subpackage share: scratch tables, id handling, small text helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, in every operator here: a maximal run of anything but these six ASCII white-space characters.
#: Python's bytes.split() splits at exactly these.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Only a local session
    that has none gets a temporary one; elsewhere the warehouse folder serves."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.split("[")[0] == "local"
        base = tempfile.mkdtemp(prefix="spark-") if local else spark.conf.get("spark.sql.warehouse.dir")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


_open_scratch: list[list[str]] = []  # the paths made within each open scratch(), the innermost last


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """The tables stored within are deleted at its end, but for those stored with keep=True, which live until the end of the
    one around it, or for good. Nothing lazy that reads a deleted table may leave it."""
    made: list[str] = []
    _open_scratch.append(made)
    try:
        yield
    finally:
        _open_scratch.remove(made)
        conf = spark._jsc.hadoopConfiguration()
        for name in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def scratch_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    path = f"{shared_dir(spark)}/chainrollup-{name}-{uuid.uuid4().hex}"
    if len(_open_scratch) > keep:
        _open_scratch[-1 - keep].append(path)
    return path


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, name, keep)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that the operators read, with fixed names; a null text counts as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def lower_ascii(data: bytes) -> bytes:
    """Lower-cases A-Z only (bytes.lower() does just that)."""
    return data.lower()


def crc_mod(id_col: str, n: int):
    """crc32 of the id as text, mod n: the folds that the contracts name. A null id counts as ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column whose value is worked out once, however often what follows uses it (a projection may be merged into
    the next one, with a copy of its expression for each use; a generator is not)."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def rows_with(docs: DataFrame, id_col: str, text_col: str, key: str, of_text: Callable[[Column], Column]) -> DataFrame:
    """The rows whole in the column `row`, so that no name clashes, with `id` and `key`, made of the text (null: empty), beside."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("id"), of_text(text).alias(key))


def drop_rows(rows: DataFrame, key: str, gone: DataFrame, twins: DataFrame) -> DataFrame:
    """rows: row, id, `key`. Without those in `gone` (id, `key`), and with one row for each in `twins` (id, `key`): which of
    them, if other columns differ, is not defined. Rows with a null id stay."""
    on = ["id", key]
    out = rows.join(gone, on, "left_anti")
    if not twins.isEmpty():
        out = out.join(twins, on, "left_anti").unionByName(out.join(twins, on, "left_semi").dropDuplicates(on))
    return out.select("row.*")
