"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

The lexicon is learned: words (letters only, after undoing common character swaps) that stand in toxic training
documents far more often than in others. Features are densities of the lexicon, its nearness to second-person words,
capitals, punctuation, and obfuscated spellings. Labels are read of the training rows only, of which at most about `fit_rows`,
picked by a hash, are used for fitting; every document is scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, id_text, stored

SECOND_PERSON = frozenset("you your yours yourself u ur du dein deine dich dir ihr euch euer tu toi te ton tes vous votre vos tú ti tus usted ustedes vosotros".split())
SWAPS = str.maketrans("013457@$!", "oieastasi")
OBFUSCATED = re.compile(r"\b[A-Za-z]+[0-9@$*]+[A-Za-z]+\b")
SPACED = re.compile(r"\b(?:[A-Za-z][ .\-_*]){3,}[A-Za-z]\b")
NEAR = 6  # words
EDGES = ".,;:?\"'()[]{}<>|#%&*_-!¡¿"
FEATURES = [
    "log_words", "lex_count", "lex_density", "lex_weight", "lex_best", "lex_kinds", "near_second", "second_density", "undone_count",
    "obfuscated", "spaced", "capitals", "caps_words", "exclaims", "questions", "punctuation", "digits", "word_length",
]


def plain(word: str) -> str:
    """A lower-cased word without outer punctuation."""
    return word.strip(EDGES)


def undone(word: str) -> str:
    """A word with character swaps undone and everything but letters dropped."""
    return "".join(c for c in word.translate(SWAPS) if c.isalpha())


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    words = text.lower().split()
    n = max(len(words), 1)
    core = [w.strip(EDGES) for w in words]
    hits = [k for k, w in enumerate(core) if w in lexicon]
    odd = [k for k, w in enumerate(core) if w not in lexicon and not w.isalpha() and w and undone(w) in lexicon]
    weights = [lexicon[core[k]] for k in hits] + [lexicon[undone(core[k])] for k in odd]
    second = [k for k, w in enumerate(core) if w in SECOND_PERSON]
    near = 0
    if second and weights:
        at, found = np.array(second), np.array(hits + odd)
        after = np.searchsorted(at, found)
        gap = np.minimum(np.abs(at[np.minimum(after, len(at) - 1)] - found), np.abs(found - at[np.maximum(after - 1, 0)]))
        near = int((gap <= NEAR).sum())
    chars = max(len(text), 1)
    data = text.encode("utf-8", "surrogatepass")
    count = lambda s: len(data) - len(data.translate(None, s))
    upper = count(bytes(range(65, 91)))
    return [
        math.log1p(len(words)), math.log1p(len(weights)), len(weights) / n, sum(weights) / n, max(weights, default=0.0),
        float(len({core[k] for k in hits})), near / n, len(second) / n, math.log1p(len(odd)), len(OBFUSCATED.findall(text)) / n, len(SPACED.findall(text)) / n,
        upper / chars, sum(w.isupper() and len(w) > 1 for w in text.split()) / n, data.count(b"!") / n, data.count(b"?") / n,
        count(b".,;:!?'\"()") / chars, count(b"0123456789") / chars, chars / n,
    ]


def training_labels(labels: DataFrame, label: str, fold: tuple[int, int]) -> DataFrame:
    """(doc_id, label) of all rows outside the held-out fold. Labels over 0 count as 1. Of rows that repeat a doc_id the larger label
    counts; null ids or labels are left out."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (crc_mod("doc_id", fold[0]) != fold[1]))
    return usable.groupBy("doc_id").agg(F.max(F.col(label).cast("double") > 0).cast("double").alias("label"))


def training_sample(labels: DataFrame, label: str, fit_rows: int, fold: tuple[int, int], seed: int = 5) -> DataFrame:
    """About fit_rows of the training labels, by a hash of the id: the bound of what is broadcast."""
    usable = training_labels(labels, label, fold)
    share = min(1.0, fit_rows / max(usable.count(), 1))
    return stored(usable.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1), "sample")


def learn_lexicon(texts: DataFrame, size: int = 200, least_docs: int = 5, prior: float = 0.5) -> dict[str, float]:
    """texts: text, label. The `size` words with the highest log odds of standing in a document of label 1, among
    those in at least `least_docs` documents and likelier there than elsewhere. Ties by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[float, Counter] = {0.0: Counter(), 1.0: Counter()}

        def flush() -> pa.RecordBatch:
            words = list(count[0.0].keys() | count[1.0].keys())
            out = pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "n": pa.array([count[0.0][w] + count[1.0][w] for w in words], pa.int64()), "toxic": pa.array([count[1.0][w] for w in words], pa.int64())})
            count[0.0].clear()
            count[1.0].clear()
            return out

        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                seen = {plain(w) for w in text.lower().split()}
                seen |= {undone(w) for w in seen if w and not w.isalpha()}
                count[label].update(w for w in seen if w)
                if len(count[0.0]) + len(count[1.0]) > 200_000:
                    yield flush()
        yield flush()

    words = texts.select("text", "label").mapInArrow(run, "word string, n long, toxic long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where(F.col("n") >= least_docs)
    total = texts.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic")).first()
    n, toxic = total["n"] or 0, total["toxic"] or 0.0
    odds = F.log((F.col("toxic") + prior) / (F.lit(toxic) - F.col("toxic") + prior)) - F.log((F.col("n") - F.col("toxic") + prior) / (F.lit(n - toxic) - F.col("n") + F.col("toxic") + prior))
    got = words.withColumn("odds", odds).where("odds > 1.5").withColumn("rank", F.col("odds") * F.sqrt("toxic")).orderBy(F.desc("rank"), "word").limit(size).collect()
    return {r["word"]: float(r["odds"]) for r in got}


def feature_table(texts: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows = np.array([features(t, lexicon) for t in batch.column("text").to_pylist()], np.float64).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {f: rows[:, k] for k, f in enumerate(FEATURES)})

    return texts.mapInArrow(run, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", fit_rows: int = 20_000, fold: tuple[int, int] = (4, 2), threshold: float = 0.3, trees: int = 20, depth: int = 4) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted.

    A null or empty text is scored by its (empty) features; a null doc_id counts as the id '' in the fold; repeated rows are scored
    alike. Without training rows of both labels every score is the share of label 1 among them, 0 if there are none. With too few to set
    some apart for calibration, the trees' probabilities are the scores. Labels, and columns other than the text, are no inputs of a
    score; no documents give no rows."""
    texts = id_text(docs, id_col, text_col)
    sample = training_sample(labels, label, fit_rows, fold)
    chosen = texts.join(F.broadcast(sample), "doc_id")  # fit_rows rows at most
    lexicon = learn_lexicon(chosen)
    table = stored(feature_table(texts, lexicon), "features").withColumn("held_out", crc_mod("doc_id", fold[0]) == fold[1])
    train = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(table.join(F.broadcast(sample), "doc_id").select("doc_id", "label", *FEATURES))
    train = stored(train.select("x", "label", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(3)).alias("part")), "train").coalesce(4)
    balance = train.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones")).first()
    out = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(table)
    if not balance["n"] or balance["ones"] in (0, balance["n"]):
        score = F.lit(float(balance["ones"] or 0) / max(balance["n"], 1))
    else:
        parts = {(r["held"], r["label"]) for r in train.select((F.col("part") == 0).alias("held"), "label").distinct().collect()}
        apart = len(parts) == 4  # a third of the rows calibrates, if both it and the rest have both labels
        raw = vector_to_array("probability")[1]
        model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7, cacheNodeIds=False).fit(train.where("part > 0") if apart else train)
        out, score = model.transform(out).withColumn("raw", raw), F.col("raw")
        if apart:
            held = model.transform(train.where("part = 0")).select(raw.alias("raw"), "label")
            out = IsotonicRegression(featuresCol="raw", labelCol="label").fit(held).setPredictionCol("calibrated").transform(out)
            score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.999 * F.col("calibrated") + 0.001 * F.col("raw")))  # the raw score orders calibrated ties
    return out.withColumn("score", score).select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
