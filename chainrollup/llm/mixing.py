"""Mixing sources to target weights by temperature.

Source token shares are raised to a power and normalised. The power is found by bisection between 1 (the shares as they are)
and 0 (equal weights): the largest one whose weights have the target entropy, or, if that reads a source more often than the
repetition limit allows, the smallest one that keeps the limit. The weights are then realised within a token budget: each source's
documents lie in hashed blocks; each epoch takes the blocks in an order of its own, whole blocks until the source's
quota is met, and of the last block a prefix of its permutation.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, scratch, stored


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def temperature_weights(tokens: dict[str, int], budget: int, **targets) -> tuple[float, dict[str, float]]:
    """(power, weights) of named sources; see size_weights."""
    power, weight = size_weights(Counter(n for n in tokens.values() if n > 0), budget, **targets)
    return power, {k: weight[tokens[k]] for k in sorted(tokens) if tokens[k] > 0}


def size_weights(sources: dict[int, int], budget: int, target_entropy: float | None = None, flatten: float | None = None, max_epochs: float | None = None, digits: int = 9) -> tuple[float, dict[int, float]]:
    """(power, weight of a source by its tokens), from the number of sources by tokens: sources of one size have one weight.

    The target is `target_entropy` (in nats), or the entropy that lies `flatten` (0 to 1) of the way from that of the shares to that of
    equal weights. The power is the largest one that reaches it, 0 if none does, 1 without a target. No source may be read
    more than `max_epochs` times; where the power would, the smallest one that doesn't takes its place, or 1 if none. Powers are
    rounded to `digits`, upwards for the limit's sake."""
    sizes = sorted(n for n in sources if n > 0)
    total = sum(n * sources[n] for n in sizes)
    if not total:
        return 1.0, {}

    def at(power: float) -> list[float]:
        raw = [(n / total) ** power for n in sizes]
        whole = math.fsum(x * sources[n] for x, n in zip(raw, sizes, strict=True))
        return [x / whole for x in raw]

    def spread(power: float) -> float:
        return -math.fsum(w * math.log(w) * sources[n] for w, n in zip(at(power), sizes, strict=True) if w > 0)

    def bisect(enough) -> float:
        """Where `enough`, which differs at 0 and 1, changes."""
        lo, hi, last = 0.0, 1.0, enough(1.0)
        while hi - lo > 10.0 ** -(digits + 3):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if enough(mid) == last else (mid, hi)
        return (lo + hi) / 2

    if flatten is not None:
        target_entropy = spread(1.0) + flatten * (spread(0.0) - spread(1.0))
    power = 1.0
    if target_entropy is not None and spread(1.0) < target_entropy:
        flat = lambda p: spread(p) < target_entropy
        power = 0.0 if flat(0.0) else round(bisect(flat), digits)
    if max_epochs is not None:
        kept = lambda p: max(w * budget / n for w, n in zip(at(p), sizes, strict=True)) <= max_epochs
        if not kept(power):
            power = min(1.0, math.ceil(bisect(kept) * 10**digits) / 10**digits) if kept(1.0) else 1.0
    return power, dict(zip(sizes, at(power), strict=True))


def _hash(*parts: Column | int | str) -> Column:
    """A hexadecimal digest of the parts: to order by, the same in any engine."""
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]).cast("binary"))


def _number(digest: Column) -> Column:
    """The first 60 bits of a digest."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def mixing_plan(docs: DataFrame, budget: int | None = None, budget_share: float = 1.0, target_entropy: float | None = None, flatten: float | None = None, max_epochs: float | None = 2.0, block_rows: int = 2048, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document and epoch in which it is read: doc_id, source, n_tokens, epoch, weight (the source's),
    power, position (a permutation of all reads: to be read in this order).

    Tokens are words plus one per document, so a null or empty text still counts one. A null source is the source
    "". The budget is `budget`, or `budget_share` of all tokens; for the targets see size_weights. In a source's last epoch, documents come in
    order of their block's hash and then of their own until the quota is met; the one that crosses it is left out. So a
    source gets its quota less at most one document. Ties of hashes are broken by doc_id and then by length;
    rows that repeat a doc_id count each. Other columns are not read; no documents give no rows."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.size(F.array_remove(F.split(text, SPACE), ""))
    name = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    base = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), name.alias("source"), (words + 1).cast("long").alias("n_tokens")), "mix-docs")
    spark = docs.sparkSession
    sizes = stored(base.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "sources")
    # only the number of sources by tokens is collected: at most sqrt(2 * tokens) rows, however many sources there are
    sources = {r["tokens"]: r["n"] for r in sizes.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    budget = budget if budget is not None else int(sum(t * n for t, n in sources.items()) * budget_share)
    power, weights = size_weights(sources, budget, target_entropy, flatten, max_epochs)
    quotas = [(t, w, int(w * budget) // t, int(w * budget) % t) for t, w in weights.items()]
    quota = sizes.join(F.broadcast(spark.createDataFrame(quotas, "tokens long, weight double, whole long, rest long")), "tokens")
    quota = quota.select("source", "weight", "whole", "rest", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("rows") / block_rows)).alias("blocks"))
    quota = F.broadcast(quota) if sum(sources.values()) <= FEW_SOURCES else quota.hint("merge")
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    placed = base.join(quota, "source").withColumn("block", F.pmod(_number(_hash(seed, doc)), F.col("blocks")))
    # the last epoch: whole blocks while they fit, then a prefix of the block in which the quota is met
    per_block = stored(placed.groupBy("source", "block", "rest", "whole").agg(F.sum("n_tokens").alias("in_block")), "blocks")
    order = Window.partitionBy("source").orderBy(_hash(seed, "block", F.col("whole"), F.col("block")), "block").rowsBetween(Window.unboundedPreceding, -1)
    begins = per_block.withColumn("begin", F.coalesce(F.sum("in_block").over(order), F.lit(0))).where("begin < rest")
    last = placed.join(begins.select("source", "block", "begin", "in_block"), ["source", "block"])
    inside = last.where("begin + in_block <= rest")
    edge = Window.partitionBy("source", "block").orderBy(_hash(seed, "doc", F.col("whole"), doc), F.col("doc_id").asc_nulls_last(), "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    partial = last.where("begin + in_block > rest").withColumn("upto", F.col("begin") + F.sum("n_tokens").over(edge)).where("upto <= rest")
    cols = ["doc_id", "source", "n_tokens", "epoch", "weight"]
    ends = inside.withColumn("epoch", F.col("whole")).select(cols).unionByName(partial.withColumn("epoch", F.col("whole")).select(cols))
    wholes = placed.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1))).select(cols)
    out = wholes.unionByName(ends)
    return out.select("doc_id", "source", "n_tokens", "epoch", F.round("weight", 9).alias("weight"), F.lit(power).alias("power"), _number(_hash(seed, "read", F.col("epoch"), doc)).alias("position"))


FEW_SOURCES = 100_000  # as many are broadcast; more are joined by a shuffle


def mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that the plan reads, once for each epoch, all their columns as they were, clashing names included. The rows
    lie in the plan's permutation: dealt to partitions by the leading bits of their positions and sorted within. Rows that
    share a doc_id are each read as often as the most favoured of them."""
    with scratch(docs.sparkSession):
        plan = mixing_plan(docs, id_col=id_col, **options)
        reads = stored(plan.groupBy("doc_id", "epoch").agg(F.min("position").alias("position")).select(F.col("doc_id").alias("id"), "position"), "reads", keep=True)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("read_id"))
    joined = rows.join(reads, F.col("read_id").eqNullSafe(F.col("id"))).select("row", "position")
    return joined.repartition(F.shiftright("position", 48)).sortWithinPartitions("position").select("row.*")
