"""Language identification against naive Bayes in plain Python, held-out accuracy, odd input."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainrollup.llm import language_id

DOC = "doc_id long, text string, lang string, score string"
SMALL = "/root/testdata/sf0.01/documents.parquet"


def codes(text, longest, bits):
    """The buckets of a squeezed text, run by run."""
    at = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return [int(b) for n in range(1, longest + 1) for k in range(len(at) - n + 1) for b in language_id.buckets_of(at[k : k + n], n, bits)[-1:]]


def test_buckets_follow_the_run_alone(monkeypatch):
    text = language_id.squeezed("Äb, c\U0001d400 dé ÿ. ab!")
    assert text == " äb c\U0001d400 dé ÿ ab "
    whole = Counter(int(b) for _, bucket in language_id.grams([text], 4, 12) for b in bucket)
    assert whole == Counter(codes(text, 4, 12)) and sum(whole.values()) == sum(len(text) - n + 1 for n in range(1, 5))
    monkeypatch.setattr(language_id, "CHARS", 5)  # long texts go in pieces
    pieces = [(int(k), int(b)) for number, bucket in language_id.grams(["", text, "x", text * 3], 4, 12) for k, b in zip(number, bucket)]
    assert Counter(pieces) == Counter((k, b) for k, t in enumerate(["", text, "x", text * 3]) for b in codes(t, 4, 12))


@pytest.mark.parametrize("chars", [1 << 18, 7])
def test_against_plain_naive_bayes(spark, monkeypatch, chars):
    monkeypatch.setattr(language_id, "CHARS", chars)
    words = {"a": "the and of in that", "b": "der und das ist nicht", "": "los que una por"}
    rows = [(i, " ".join(w.split()[(i * 7 + k) % 3] for k in range(i % 9)), lang, "s") for i in range(120) for lang, w in words.items()]
    rows += [(7, "the das", None, "s"), (None, "und", "b", "s"), (5, None, "b", "s"), (6, "12 ½ !?", "a", "s"), (6, "12 ½ !?", "a", "s")]
    got = language_id.languages(spark.createDataFrame(rows, DOC).repartition(4), bits=10)
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 4 == 2
    grams, texts = defaultdict(Counter), Counter()
    for i, t, lang, _ in rows:
        if lang is not None and not held(i):
            texts[lang] += 1
            grams[lang].update(codes(language_id.squeezed(t), 4, 10))
    want = []
    for i, t, _, _ in rows:
        p = language_id.squeezed(t)
        logs = {lang: math.log(n / sum(texts.values())) + sum(math.log((grams[lang][b] + 0.5) / (sum(grams[lang].values()) + 512)) for b in codes(p, 4, 10)) for lang, n in texts.items()}
        best = min(logs, key=lambda k: (-logs[k], k))
        want.append((i, held(i), best if p else "und", round(1 / sum(math.exp(v - logs[best]) for v in logs.values()), 6) if p else 0.0))
    assert sorted(((r.doc_id, r.held_out, r.lang_pred, round(r.score, 6)) for r in got.collect()), key=str) == sorted(want, key=str)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(SMALL)
    got = language_id.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.count(F.lit(1)).alias("n")).first()
    assert got["n"] > 200 and got["right"] >= 0.98


def test_odd_input(spark):
    long = "der die das und " * 300_000
    rows = [(1, long, "de", "x"), (2, "", "de", "x"), (3, None, None, "x"), (4, "the", "en", "x"), (8, "...", "zz", "x")]
    table = spark.createDataFrame(rows, DOC)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.languages(table).collect()}
    assert got[1][0] == "de" and got[2] == got[3] == got[8] == ("und", 0.0) and len(got) == 5
    assert language_id.languages(table.limit(0)).collect() == []
    unlabelled = language_id.languages(table.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)}


def test_buckets_shrink_for_very_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "CELLS", 1 << 12)
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}" * 3, f"l{i:03d}", "x") for i in range(100)]
    model = language_id.learn(spark.createDataFrame(rows, DOC).select("text", "lang"))
    assert len(model.langs) == 100 and model.matrix.size <= 1 << 12
