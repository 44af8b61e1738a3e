"""Exact deduplication with a log-structured merge index of digests (DataFrame operations only).

1. Every text is normalised and digested (SHA-256); only (doc_id, digest) is kept for the index.
2. The digests are dealt to memtables of about `memtable_rows` rows. A flush has up to `memtables` of them, each a run with one
   entry per digest, sorted by it; there are as many flushes as the rows need, and one job writes them all.
3. Whenever `fan_in` levels of runs wait, compaction merges them, keeping the smallest identifier and adding up the copies; at the
   end one run is left. Its filter is a bitmap of the digests with more than one copy.
4. The texts that pass the filter, and no others, are moved and compared byte by byte with the text of the row that stays.
   A digest of very many copies is split over tasks, with a copy of the text that stays in each.
5. A text whose digest agrees and whose bytes don't (a collision) is grouped again by its bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, drop_rows, id_text, once, rows_with, scratch, scratch_path, stored
from .filters import ROW_BITS

HOT_LIST = 100_000  # digests at most that are split over tasks; their list is broadcast


def _normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


class DigestIndex:
    """Runs of (digest, keep_id, copies) under one folder of the shared store."""

    def __init__(self, spark: SparkSession, path: str | None = None, memtable_rows: int = 1 << 18, memtables: int = 256, fan_in: int = 8):
        self.spark, self.fan_in = spark, fan_in
        self.memtable_rows, self.memtables = memtable_rows, memtables
        self.path = path or scratch_path(spark, "digests")
        self.flushes = self.compactions = 0
        self.levels: list[tuple[int, str]] = []  # (level, folder) of what waits to be merged

    def fill(self, keys: DataFrame) -> None:
        """keys: doc_id, digest. They are read once to count them and once to write all runs, dealt to a flush for every memtable_rows * memtables rows."""
        rows = keys.count()
        runs = max(1, -(-rows // self.memtable_rows))
        flushes = -(-runs // self.memtables)
        run = F.pmod(F.xxhash64(F.lit(17), "digest", "doc_id"), F.lit(runs)).cast("int")
        entries = keys.select("digest", "doc_id", run.alias("run")).groupBy("run", "digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))
        folder = f"{self.path}/flushed"
        self._write_sorted(entries.withColumn("flush", F.col("run") % flushes), folder, "flush", "run")
        held = self.spark.read.schema("digest binary, flush int, run int").parquet(folder).select("flush").distinct()
        for name in sorted(f"{folder}/flush={r['flush']}" for r in held.collect()) or [folder]:  # no rows: nothing but the folder
            self.levels.append((0, name))
            self.flushes += 1
            self._compact_full_levels()

    def _write_sorted(self, entries: DataFrame, folder: str, *parts: str) -> None:
        """Tasks take ranges of (parts, digest), so a run stands in few files however many runs there are."""
        entries.repartitionByRange(*parts, "digest").sortWithinPartitions(*parts, "digest").write.partitionBy(*parts).option("compression", "zstd").parquet(folder)

    def _write(self, level: int, entries: DataFrame) -> None:
        folder = f"{self.path}/{level}-{self.flushes}-{self.compactions}"
        self._write_sorted(entries, folder, "run")
        self.levels.append((level, folder))

    def _read(self, folder: str) -> DataFrame:
        return self.spark.read.schema("digest binary, keep_id long, copies long, run int").parquet(folder)

    def _merge(self, level: int, folders: list[str]) -> None:
        """A merged level is one run, sorted over all its files."""
        self.compactions += 1
        entries = self._read(folders[0])
        for folder in folders[1:]:
            entries = entries.unionByName(self._read(folder))
        self.levels = [x for x in self.levels if x[1] not in folders]
        self._write(level, entries.groupBy(F.lit(0).alias("run"), "digest").agg(F.min("keep_id").alias("keep_id"), F.sum("copies").alias("copies")))

    def _compact_full_levels(self) -> None:
        level = 0
        while len(folders := [f for n, f in self.levels if n == level]) >= self.fan_in:
            level += 1
            self._merge(level, folders)

    def compact(self) -> DataFrame:
        """Merges what is left into one run; returns its entries."""
        if len(self.levels) > 1 or self.levels[0][0] == 0:
            self._merge(max(n for n, _ in self.levels) + 1, [f for _, f in self.levels])
        return self._read(self.levels[0][1]).drop("run")


def _slot(bits: int) -> tuple[Column, Column]:
    slot = F.pmod(F.xxhash64("digest"), F.lit(bits))
    return F.floor(slot / ROW_BITS).cast("long"), (slot % ROW_BITS).cast("long")


def _passing(rows: DataFrame, dups: DataFrame, n_dups: int, max_bits: int) -> DataFrame:
    """The rows whose digest may be among `dups`, by a bitmap of at most max_bits bits (the bound of what
    is broadcast, whatever the size of the data). A full bitmap lets more through; nothing is lost."""
    bits = ROW_BITS
    while bits < min(16 * n_dups, max_bits):
        bits *= 2
    bucket, pos = _slot(bits)
    filt = dups.select(bucket.alias("__bucket"), pos.alias("__pos")).groupBy("__bucket").agg(F.expr("bitmap_construct_agg(__pos)").alias("__bits"))
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__pos div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.expr("shiftright(__byte, cast(__pos % 8 as int)) & 1") == 1
    return rows.withColumns({"__bucket": bucket, "__pos": pos}).join(F.broadcast(filt), "__bucket").withColumn("__byte", byte).where(hit).drop("__bucket", "__pos", "__bits", "__byte")


def _meet(rows: DataFrame, entries: DataFrame, hot: DataFrame, how: str = "inner") -> DataFrame:
    """rows: doc_id, digest, ..., joined to entries: digest, ... on the digest; both are dealt in the parts that `hot`
    (digest, parts; at most HOT_LIST rows) has for a digest."""
    of = lambda df: df.join(F.broadcast(hot), "digest", "left")
    left = of(rows).withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    right = of(entries).withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))).drop("parts")
    return left.join(right, ["digest", "part"], how).drop("part")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_chars: int = 64, memtable_rows: int = 1 << 18, memtables: int = 256, fan_in: int = 8, hot_rows: int = 50_000, filter_bits: int = 1 << 30) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space becomes one space; a null text is empty,
    and empty texts are equal to each other. The smallest doc_id of equal texts stays. Rows that repeat a
    doc_id each get a row, and all rows with the smallest id count as kept; a null doc_id is larger than
    any other (if all of a group are null, keep_id is null and they are kept). Other columns are not read; no documents give no rows.
    `digest_chars` shortens the digest (for tests of collisions), `hot_rows` is the number of copies from which a digest is split
    over tasks; results do not depend on any of the options."""
    spark = docs.sparkSession
    texts = once(id_text(docs, id_col, text_col).select("doc_id", _normalised(F.col("text")).alias("text")), "norm", F.col("text")).drop("text")
    digested = once(once(texts, "sha_bytes", F.unhex(F.sha2("norm", 256))), "digest", F.unhex(F.substring(F.hex("sha_bytes"), 1, digest_chars)) if digest_chars < 64 else F.col("sha_bytes"))
    keys = stored(digested.drop("norm"), "keys")

    index = DigestIndex(spark, memtable_rows=memtable_rows, memtables=memtables, fan_in=fan_in)
    index.fill(keys)
    dups = index.compact().where("copies > 1").select("digest", "keep_id", F.col("copies").alias("group_size"))
    size = dups.agg(F.count(F.lit(1)).alias("n"), F.sum("group_size").alias("rows")).first()
    if not size["n"]:
        return keys.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha_bytes")).alias("text_sha256"))
    # so many copies at least that no more than HOT_LIST digests have them
    over = max(hot_rows, size["rows"] // HOT_LIST)
    hot = stored(dups.where(F.col("group_size") > over).select("digest", F.ceil(F.col("group_size") / over).cast("int").alias("parts")), "hot")

    again = None
    members = stored(_meet(_passing(digested.drop("sha_bytes"), dups, size["n"], filter_bits), dups, hot), "members")
    stays = members.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("norm").alias("kept_norm"))
    odd = stored(_meet(members, stays, hot).where("norm <> kept_norm").select("digest").distinct(), "collisions")
    if not odd.isEmpty():
        mixed = members.join(odd, "digest", "left_semi")
        regrouped = mixed.groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_of_norm"), F.count(F.lit(1)).alias("size_of_norm"))
        again = mixed.join(regrouped, ["digest", "norm"]).select("doc_id", F.col("keep_of_norm").alias("keep_id"), F.col("size_of_norm").alias("group_size"), F.unhex(F.sha2("norm", 256)).alias("sha_bytes"))
    # a text without a copy is its own group; the others are joined, hot digests in parts
    alone = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    groups = _meet(keys, dups, hot, "left").select("doc_id", alone.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), "sha_bytes", "digest")
    if again is not None:
        groups = groups.join(odd, "digest", "left_anti").drop("digest").unionByName(again)
    return groups.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha_bytes")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without the later copies, all their columns as they were, clashing names included.

    Of equal texts (see exact_groups; null and empty ones are equal) one row stays, of the smallest doc_id. Rows are told apart by
    doc_id and text, so another text under the same doc_id stays; of rows that repeat both, one stays. Rows with a null doc_id stay."""
    with scratch(docs.sparkSession):
        groups = exact_groups(docs, id_col, text_col, **options).where("group_size > 1 AND doc_id IS NOT NULL")
        groups = stored(groups.select(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("sha"), "kept"), "copies", keep=True)
    twins = stored(groups.where("kept").groupBy("id", "sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "sha"), "twins")
    rows = rows_with(docs, id_col, text_col, "sha", lambda t: F.unhex(F.sha2(_normalised(t), 256)))
    return drop_rows(rows, "sha", groups.where("NOT kept").select("id", "sha"), twins)
