"""Quality by Bradley-Terry pairwise ranking.

From all labelled documents outside the held-out fold come preference pairs: a document of label 1 is preferred to one of label 0, and
every one of either label is in some. The difference of their feature vectors goes into a logistic loss without intercept; the weights it learns give each document a score. The scores' quantile at
the share of label 0 among the training rows is the threshold, and a logistic curve through it makes a score between 0 and 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, id_text, stored
from .quality_rules import LOWER, UPPER, TextView
from .toxicity import training_labels

FEATURES = ["length", "short", "word_length", "symbols", "capitals", "exclaims", "pipes", "digits", "stops", "repeats", "same_lines", "variety", "line_length", "links"]


def features(text: str) -> list[float]:
    """Rates are squashed, so that a little of a fault weighs more than a lot of it weighs less."""
    v = TextView(text)
    n, chars, lines = max(v.n_words, 1), max(len(v.data), 1), max(len(v.lines), 1)
    squash = lambda x: math.log1p(20 * x)
    return [
        math.log1p(v.n_words), float(v.n_words < 10), math.log1p(v.word_chars / n), squash(v.n_symbols / n), squash(v.count_of(UPPER) / max(v.count_of(UPPER + LOWER), 1)),
        squash(v.data.count(b"!") / n), squash(v.data.count(b"|") / n), squash(v.count_of(b"0123456789") / chars), squash(v.count_of(b".,;:?") / n),
        squash(v.n_repeat_words / n), squash(v.n_dup_lines / lines), len(set(v.words)) / n ** 0.9, math.log1p(n / lines), squash((v.data.count(b"http") + v.data.count(b"www.")) / n),
    ]


def feature_table(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows = np.array([features(t) for t in batch.column("text").to_pylist()], np.float64).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {f: rows[:, k] for k, f in enumerate(FEATURES)})

    return texts.mapInArrow(run, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


def numbered(rows: DataFrame) -> DataFrame:
    """With `number`, from 0 on: those of label 0 first, each label in the order of a hash. Rows are sorted by ranges, and each range counts on
    from where the one before ends."""
    order = ["label", F.xxhash64(F.lit(2), "doc_id"), "doc_id", F.array(*FEATURES)]
    placed = stored(rows.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("place", 33)
    ends, starts = 0, []
    for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # a row for each range
        starts.append((r["part"], ends))
        ends += r["n"]
    begun = rows.sparkSession.createDataFrame(starts, "part long, begin long")
    return placed.withColumn("part", part).join(F.broadcast(begun), "part").withColumn("number", F.col("begin") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "begin", "place")


def preference_pairs(rows: DataFrame, n_other: int, n: int, per_row: int = 4) -> DataFrame:
    """rows: doc_id, label, features; n rows, n_other of them with label 0. Differences (preferred less other, label 1, and the reverse, label 0).
    Each row meets `per_row` of the other label, drawn by a hash from their numbers, so that all rows are in pairs."""
    rows = stored(numbered(rows).select("doc_id", "label", "number", F.array(*FEATURES).alias("f")), "rows")
    liked, other = rows.where("label = 1"), rows.where("label = 0")
    draws = lambda seed, least, many: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(per_row - 1)), lambda k: least + F.pmod(F.xxhash64(F.lit(seed), "doc_id", k), F.lit(many)))))
    first = liked.select(F.col("f").alias("a"), draws(3, F.lit(0), n_other).alias("number")).join(other.select("number", F.col("f").alias("b")), "number")
    second = other.select(F.col("f").alias("b"), draws(4, F.lit(n_other), n - n_other).alias("number")).join(liked.select("number", F.col("f").alias("a")), "number")
    diff = first.select("a", "b").unionByName(second.select("a", "b")).select(F.zip_with("a", "b", lambda x, y: x - y).alias("d"))
    both = diff.select(F.explode(F.array(F.struct(F.col("d"), F.lit(1.0).alias("label")), F.struct(F.transform("d", lambda x: -x).alias("d"), F.lit(0.0).alias("label")))).alias("p"))
    return both.select(*[F.col("p.d")[k].alias(name) for k, name in enumerate(FEATURES)], F.col("p.label").alias("label"))


def at_rank(values: DataFrame, rank: int) -> float:
    """values: raw. The value of that rank (from 1) in ascending order, exactly: histograms of ever narrower ranges."""
    bounds = values.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).first()
    lo, hi, below = bounds["lo"], bounds["hi"], 0  # values below lo
    while lo < hi:
        cell = F.least(F.lit(1023), F.floor((F.col("raw") - lo) / (hi - lo) * 1024))
        cells = values.where(F.col("raw").between(lo, hi)).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("raw").alias("lo"), F.max("raw").alias("hi")).collect()
        for r in sorted(cells, key=lambda r: r["cell"]):  # 1024 at most
            if below + r["n"] >= rank:
                lo, hi = r["lo"], r["hi"]
                break
            below += r["n"]
    return lo


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", fold: tuple[int, int] = (4, 2), threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted.

    All labelled rows outside the held-out fold are used to fit, and the threshold is an exact quantile of theirs; every document is scored. A null or empty
    text is scored by its (empty) features; a null doc_id counts as the id '' in the fold; repeated rows are scored alike, and ties of
    scores are left as they are. Other columns are not read; no documents give no rows.
    Without training rows of both labels every score is the share of label 1 among them, 0 if there are none."""
    texts = id_text(docs, id_col, text_col)
    table = stored(feature_table(texts), "features").withColumn("held_out", crc_mod("doc_id", fold[0]) == fold[1])
    rows = stored(table.join(training_labels(labels, label, fold), "doc_id"), "train")
    balance = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones")).first()
    n, ones = balance["n"], balance["ones"] or 0.0
    if not n or ones in (0, n):
        score = F.lit(float(ones) / max(n, 1))
    else:
        pairs = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(preference_pairs(rows, int(n - ones), n))
        pairs = stored(pairs.select("x", "label"), "preferences")
        model = LogisticRegression(featuresCol="x", labelCol="label", fitIntercept=False, regParam=1e-3, maxIter=60).fit(pairs)
        raw = sum((F.col(name) * float(w) for name, w in zip(FEATURES, model.coefficients, strict=True)), F.lit(0.0))
        got = stored(rows.select(raw.alias("raw")), "raw")
        low, at, high = (at_rank(got, max(1, math.ceil(k))) for k in (n / 4, n - ones, 3 * n / 4))
        score = 1 / (1 + F.exp(-((raw - at) / max(high - low, 1e-6) + math.log(threshold / (1 - threshold)))))
    return table.withColumn("score", score).select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
