"""Best-fit packing by large-item matching.

Documents are tokenised once and cut into pieces of at most one sequence. What the packing needs to know
of the pieces is how many there are of each length, a table of at most `capacity` rows however many
documents there are. On it, large pieces (over a third of a sequence) are matched greedily in pairs, the
longest with the longest that still fits, and the smaller ones go, longest first, to the tightest gap.
The result is a list of bin patterns with multiplicities. Each piece then finds its place by its length
and its number among the pieces of that length; those numbers come from per-task counts and their
running sums, so no length is ever gathered in one task.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, stored

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_paths() -> tuple[str, str]:
    """The tokenizer file and the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER), public_tokenizers.path(TOKENIZER.replace(".json", ".tiktoken"))


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes, equal to those of the tokenizer file. The faster
    library of the same vocabulary encodes; a text that spells a special token goes to the file's own."""

    def __init__(self, json_path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            ids = np.array(self.whole.encode(text, add_special_tokens=False).ids)
        else:
            ids = self.fast.encode_to_numpy(text, disallowed_special=())
        return ids.astype("<u4").tobytes()


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole sequences but for the first, which takes the rest."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 0, paths: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids (unsigned 32-bit little-endian), task, nth (the piece's number among
    those of its length in its task), as a table in the shared store. The ids of a null or empty text are the
    end id alone."""
    paths = paths or tokenizer_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = Encoder(*paths), TaskContext.get().partitionId()
        nth = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids", "task", "nth")}
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids = encoder.encode(text) + end
                    for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        for k, v in zip(out, (doc, piece, start, length, ids[4 * start : 4 * (start + length)], task, int(nth[length])), strict=True):
                            out[k].append(v)
                        nth[length] += 1
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("task", pa.int32()), ("nth", pa.int64())]))

    pieces = id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary, task int, nth long")
    return stored(pieces, "pieces")


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """[(pattern, how many bins)]; a pattern lists (length, copies). Works on counts by length: the number of
    steps depends on the number of lengths, not of pieces.

    >>> plan_bins({6: 2, 4: 1, 3: 2}, 10)
    [([(6, 1), (4, 1)], 1), ([(6, 1), (3, 1)], 1), ([(3, 1)], 1)]
    """
    left = {s: n for s, n in counts.items() if n > 0}
    large = sorted(s for s in left if 3 * s > capacity)
    bins: dict[int, list[list]] = {}  # gap -> [pattern, bins]
    gaps: list[int] = []

    def put(gap: int, pattern: list, n: int) -> None:
        if gap not in bins:
            bins[gap] = []
            bisect.insort(gaps, gap)
        bins[gap].append([pattern, n])

    while large:
        s = large[-1]
        n, at = left[s], bisect.bisect_right(large, capacity - s) - 1
        if at < 0:
            put(capacity - s, [(s, 1)], n)
            left[s] = 0
        elif large[at] == s:
            if n >= 2:
                put(capacity - 2 * s, [(s, 2)], n // 2)
            left[s] = n % 2
            if left[s] and at == 0:
                put(capacity - s, [(s, 1)], 1)
                left[s] = 0
            elif left[s]:
                t = large[at - 1]
                put(capacity - s - t, [(s, 1), (t, 1)], 1)
                left[s] = 0
                left[t] -= 1
        else:
            t = large[at]
            k = min(n, left[t])
            put(capacity - s - t, [(s, 1), (t, 1)], k)
            left[s] -= k
            left[t] -= k
        large = [x for x in large if left[x]]
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            at = bisect.bisect_left(gaps, s)
            if at == len(gaps):
                gap, pattern, have = capacity, [], n
            else:
                gap = gaps[at]
                pattern, have = bins[gap].pop()
                if not bins[gap]:
                    del bins[gap], gaps[at]
            each = gap // s  # a bin that is the tightest stays so until it is full
            full = min(have, n // each)
            if full:
                put(gap - each * s, pattern + [(s, each)], full)
                n -= full * each
            if n and full < have and n < each:
                put(gap - n * s, pattern + [(s, n)], 1)
                n, full = 0, full + 1
            if pattern and full < have:
                put(gap, pattern, have - full)
    return [(pattern, n) for gap in sorted(bins) for pattern, n in bins[gap]]


def _intervals(patterns: list[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from, to, copies, first bin, offset): the pieces numbered from..to-1 of a length go, `copies` to
    a bin, to the bins from the first on, at the offset."""
    used: dict[int, int] = {}
    out, first = [], 0
    for pattern, n in patterns:
        offset = 0
        for length, copies in pattern:
            start = used.get(length, 0)
            used[length] = start + n * copies
            out.append((length, start, used[length], copies, first, offset))
            offset += length * copies
        first += n
    return out


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 0, paths: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ("ids",)) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, `carry` (SQL expressions over the piece; the token ids
    unless others are named), sequence_id, offset.

    Every document is packed, repeated rows each on their own; a null or empty text is one end token; other
    columns are not read. No documents give no rows. Sequences are gapless from offset 0."""
    spark = docs.sparkSession
    pieces = token_pieces(docs, capacity, end_id, paths, id_col, text_col)
    counts = stored(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = _intervals(plan_bins(totals, capacity))
    plan = spark.createDataFrame(rows or [(0, 0, 0, 1, 0, 0)], "size long, lo long, hi long, copies long, bin long, off long")
    # the tasks' counts become the number at which each task's pieces of a length begin
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select(F.col("length").alias("__length"), F.col("task").alias("__task"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    rest = pieces.selectExpr("doc_id", "piece", "start", "length", *carry, "task", "nth")
    names = rest.columns[4:-2]
    numbered = rest.join(begins, (F.col("length") == F.col("__length")) & (F.col("task") == F.col("__task"))).withColumn("k", F.col("begin") + F.col("nth"))
    # the plan's size is bounded by the capacity alone (a pattern for each step of plan_bins), so it is broadcast
    placed = numbered.join(F.broadcast(plan), (F.col("length") == F.col("size")) & (F.col("k") >= F.col("lo")) & (F.col("k") < F.col("hi")))
    return placed.select("doc_id", "piece", "start", "length", *names, F.expr("bin + (k - lo) div copies").alias("sequence_id"), F.expr("off + (k - lo) % copies * length").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (the pieces' ids joined by offset), doc_ids. A sequence has
    at most `capacity` tokens, so no group is large."""
    return packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p")).select("sequence_id", F.expr("aggregate(p.ids, cast('' as binary), (a, x) -> concat(a, x))").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
