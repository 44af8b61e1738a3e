"""Language identification by multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, and what is no letter counts as one space. Every run of one to `longest` characters is hashed to a bucket.
Each task counts the buckets of its documents by language and Spark adds the counts up; their smoothed logarithms are a
matrix, a row a language, which every task gets. A batch of texts is scored together: the rows of the matrix are gathered at
the buckets that the batch has, and added up within each text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod
from .vectors import slices

NO_LETTERS, LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")
UNKNOWN = "und"
CHARS = 1 << 18  # characters hashed together
CELLS = 1 << 23  # of the matrix at most: 64 MB, whatever the number of languages


def squeezed(text: str | None) -> str:
    """Lower case, and one space around and between the runs of letters; '' without a letter."""
    return NO_LETTERS.sub(" ", f" {text.lower()} ") if text and LETTER.search(text) else ""


def buckets_of(chars: np.ndarray, longest: int, bits: int, skip: int = 0) -> np.ndarray:
    """The buckets of all runs of up to `longest` code points that end at or after place `skip`."""
    h, out = np.zeros(len(chars), np.uint64), []
    for n in range(1, longest + 1):
        if n > len(chars):
            break
        h = h[: len(chars) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + chars[n - 1 :]
        h ^= h >> np.uint64(29)
        mixed = (h + np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((mixed >> np.uint64(64 - bits))[max(0, skip - n + 1) :])
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def grams(texts: list[str], longest: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text's number, bucket) of all runs in squeezed texts, a bounded number at a time."""
    numbers, found, held = [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, len(text), CHARS):
            before = min(at, longest - 1)
            chars = np.frombuffer(text[at - before : at + CHARS].encode("utf-32-le"), np.uint32).astype(np.uint64)
            found.append(buckets_of(chars, longest, bits, before))
            numbers.append(np.full(len(found[-1]), k, np.int64))
            held += len(chars)
            if held >= CHARS:
                yield np.concatenate(numbers), np.concatenate(found)
                numbers, found, held = [], [], 0
    if found:
        yield np.concatenate(numbers), np.concatenate(found)


def gram_counts(texts: DataFrame, longest: int, bits: int) -> DataFrame:
    """texts: text, lang (not null) -> lang, bucket, n; n at bucket -1 is the number of texts. A task adds up its own rows first."""
    size = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, count in held.items():
                used = np.flatnonzero(count)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(used), pa.string()), "bucket": (used - 1).astype(np.int32), "n": count[used]})
            held.clear()

        for batch in slices(batches, 256):
            texts, langs = [squeezed(t) for t in batch.column("text").to_pylist()], batch.column("lang").to_pylist()
            for lang in langs:
                if lang not in held and len(held) >= 64:
                    yield from flushed()
                held.setdefault(lang, np.zeros(size + 1, np.int64))[0] += 1
                # a flush may part a language's texts from its grams: both are sums
            for number, bucket in grams(texts, longest, bits):
                edges = np.flatnonzero(np.diff(number, prepend=-1, append=len(texts)))
                for low, high in zip(edges[:-1], edges[1:], strict=True):
                    lang = langs[number[low]]
                    if lang not in held and len(held) >= 64:
                        yield from flushed()
                    count = held.setdefault(lang, np.zeros(size + 1, np.int64))
                    if high - low > size // 8:
                        count[1:] += np.bincount(bucket[low:high], minlength=size)
                    else:
                        np.add.at(count, bucket[low:high] + 1, 1)
        yield from flushed()

    parts = texts.select("text", "lang").mapInArrow(run, "lang string, bucket int, n long")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Log-probabilities by language and bucket. Without languages every text is unknown."""

    def __init__(self, langs: list[str], texts: np.ndarray, counts: np.ndarray, longest: int, smoothing: float):
        self.langs, self.longest, self.bits = langs, longest, (counts.shape[1] - 1).bit_length()
        self.prior = np.log(texts / max(texts.sum(), 1))
        smooth = counts + smoothing
        self.matrix = np.ascontiguousarray(np.log(smooth / smooth.sum(1, keepdims=True)).T)  # a row a bucket

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language (ties: the first by name) and its posterior probability, for each text."""
        plain = [squeezed(t) for t in texts]
        if not self.langs or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total = np.tile(self.prior, (len(texts), 1))
        for number, bucket in grams(plain, self.longest, self.bits):
            start = np.flatnonzero(np.diff(number, prepend=-1))
            total[number[start]] += np.add.reduceat(self.matrix[bucket], start, axis=0)
        best = total.argmax(1)
        share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        known = np.array([bool(p) for p in plain])
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, share, 0.0)


def learn(texts: DataFrame, longest: int = 4, bits: int = 16, smoothing: float = 0.5) -> Model:
    """texts: text, lang. From all rows with a lang; with over CELLS >> bits languages the buckets are fewer."""
    rows = texts.where("lang IS NOT NULL")
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().limit(CELLS).collect())
    while bits > 1 and len(langs) << bits > CELLS:
        bits -= 1
    counted = gram_counts(rows, longest, bits).toArrow() if langs else None  # at most CELLS rows and one a language
    counts, texts_of = np.zeros((len(langs), 1 << bits), np.int64), np.zeros(len(langs), np.int64)
    if langs:
        row = np.searchsorted(np.array(langs, object), counted.column("lang").to_numpy(zero_copy_only=False))
        bucket, n = counted.column("bucket").to_numpy(), counted.column("n").to_numpy()
        counts[row[bucket >= 0], bucket[bucket >= 0]] = n[bucket >= 0]
        texts_of[row[bucket < 0]] = n[bucket < 0]
    return Model(langs, texts_of, counts, longest, smoothing)


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: tuple[int, int] = (4, 2), longest: int = 4, bits: int = 16, smoothing: float = 0.5) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (posterior probability of lang_pred).

    Learns from all documents outside the held-out fold whose lang is not null, an empty lang being one like others. A text that is null
    or has no letter is `und` with score 0; so is every text if nothing is learned from. A null doc_id counts as the id '' in the
    fold; repeated rows are alike. Other columns are not read; no documents give no rows. The matrix has at most CELLS numbers."""
    spark = docs.sparkSession
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    held_out = crc_mod("doc_id", fold[0]) == fold[1]
    model = spark.sparkContext.broadcast(learn(texts.where(~held_out).select("text", "lang"), longest, bits, smoothing))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            lang, score = model.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pa.array(lang, pa.string()), "score": score})

    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
