"""Exact deduplication, rules, packing, mixing, language model and classifiers: brute force, round trips, odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chainrollup.llm import class_lm, exact_dedup, mixing, packing, quality_classifier, quality_rules, toxicity
from chainrollup.llm.quality_rules import TextView, repeated_words

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOC).repartition(3)


# --- exact deduplication


@pytest.mark.parametrize("chars", [64, 1])
def test_exact_groups(spark, chars):
    rng = random.Random(chars)
    texts = ["a  b", "a b", "a\tb", "A b", "", None, " ", "\n", "x", "é x", "é x"] + [f"t {rng.randrange(12)}" for _ in range(40)]
    rows = list(zip(rng.sample(range(1000), len(texts)), texts)) + [(2000, "x"), (2000, "x"), (None, "a b"), (None, "lonely")]
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    want = []
    for (i, _), n in zip(rows, norm):
        group = [j for (j, _), m in zip(rows, norm) if m == n]
        keep = min((j for j in group if j is not None), default=None)
        want.append((i, keep, len(group), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    got = exact_dedup.exact_groups(docs(spark, [(i, t, "s") for i, t in rows]), digest_chars=chars, memtable_rows=7, memtables=2, fan_in=2, hot_rows=3)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_exact_dedup_keeps_columns_and_takes_empty_tables(spark):
    rows = spark.createDataFrame([(1, "x y", 5, "q"), (2, "x  y", 6, None), (3, None, 7, "r")], "doc_id long, text string, digest int, kept string")
    assert sorted(map(tuple, exact_dedup.exact_dedup(rows).collect())) == [(1, "x y", 5, "q"), (3, None, 7, "r")]
    assert exact_dedup.exact_groups(rows.limit(0)).collect() == exact_dedup.exact_dedup(rows.limit(0)).collect() == []
    assert len(exact_dedup.exact_groups(rows.limit(1)).collect()) == 1


def test_exact_dedup_tells_rows_apart_by_id_and_text(spark):
    long = "word " * 200_000
    rows = [(3, "a", 1), (5, "a", 2), (5, "b", 3), (3, "a", 4), (None, "a", 5), (6, "", 6), (7, None, 7), (8, long, 8), (9, long + " ", 9)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string, sha long").repartition(3)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(3, "a"), (5, "b"), (None, "a"), (6, ""), (8, long)], key=str)


def test_index_flushes_and_compacts_in_levels(spark):
    keys = spark.range(1000).selectExpr("id AS doc_id", "unhex(sha2(cast(id % 700 as string), 256)) AS digest")
    index = exact_dedup.DigestIndex(spark, memtable_rows=20, memtables=5, fan_in=3)
    index.fill(keys)
    assert index.flushes == 10 and index.compactions >= 3 and max(n for n, _ in index.levels) == 2
    got = index.compact()
    assert got.count() == 700 and got.agg(F.sum("copies"), F.max("keep_id")).first() == (1000, 699)


# --- quality rules


def brute_repeats(words):
    seen = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    return len({k + j for k in range(len(words) - 4) if seen[tuple(words[k : k + 5])] > 1 for j in range(5)})


def test_repeated_words():
    rng = random.Random(1)
    for n in (0, 1, 4, 5, 6, 30, 200):
        w = [bytes([rng.choice(b"ab")]) for _ in range(n)]
        assert repeated_words(w) == brute_repeats(w)
    w = [b"%d" % (k % 9001) for k in range(20000)]  # more words than five of them fit one number
    assert repeated_words(w) == brute_repeats(w)


def test_verdicts(spark):
    clean = "The quick brown fox jumps over the lazy dog near the old river bank today."
    rows = [(1, clean, "s"), (2, None, "s"), (3, "", "s"), (4, "too few words", "s"), (5, "same words here again now " * 9, "s"), (6, " ".join(w + "###" for w in clean.split()), "s"), (7, clean.upper(), "s"), (None, clean, "s"), (1, clean, "s")]
    d = docs(spark, rows)
    got = {r.doc_id: r for r in quality_rules.quality_verdicts(d, stats=True).collect()}
    assert {k for k, r in got.items() if r.kept} == {1, None} and got[5].base_failed and not got[6].base_failed
    assert (got[1].n_words, got[1].word_chars, got[6].n_symbols, got[2].n_words) == (15, 60, 45, 0)
    kept = quality_rules.quality_filter(d.withColumn("rule", F.lit(1)))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "None"] and kept.columns[-1] == "rule"
    assert quality_rules.quality_verdicts(d.limit(0), stats=True).collect() == []
    assert quality_rules.order_rules([("dear", 1.0, 0.9), ("cheap", 0.01, 0.1), ("idle", 0.001, 0.0)]) == ["cheap", "dear", "idle"]
    assert TextView("a\n\nb\na").n_dup_lines == 1


# --- packing


def test_packing_round_trip(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "beta,", "gamma\n", "délta  ", "<|endoftext|>"]) for _ in range(rng.choice((0, 1, 5, 30, 200)))) for _ in range(60)]
    rows = list(zip(range(60), texts, ["s"] * 60)) + [(100, None, "s"), (None, "null id", "s"), (5, texts[5], "s")]
    packed = packing.pack(docs(spark, rows), capacity=64)
    got = packed.collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_paths()[0])
    ids = {i: np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes() for i, t, _ in rows}
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, set()).add((r.piece, r.start, r.length, bytes(r.ids)))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, whole in ids.items():
        pieces = sorted(by_doc[i])
        assert b"".join(p[3] for p in pieces) == whole and [p[:3] for p in pieces] == [(k, s, n) for k, (s, n) in enumerate(packing.cut(len(whole) // 4, 64))]
    for parts in by_seq.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 64
    assert len(by_seq) <= math.ceil(sum(r.length for r in got) / 64) + 2
    assert sum(len(r.ids) for r in packing.sequences(packed).collect()) == sum(len(bytes(r.ids)) for r in got)
    assert packing.pack(docs(spark, []), capacity=64).collect() == []


def test_plan_holds_every_length_once():
    rng = random.Random(5)
    for _ in range(40):
        counts = {rng.randint(1, 50): rng.randint(1, 30) for _ in range(rng.randint(1, 30))}
        plan, held = packing.plan_bins(counts, 50), Counter()
        for pattern, n in plan:
            assert n > 0 and sum(s * k for s, k in pattern) <= 50 and sum(k for s, k in pattern if 3 * s > 50) <= 2
            for s, k in pattern:
                held[s] += n * k
        assert held == counts


# --- mixing


def test_temperature_meets_its_targets():
    tokens = {"a": 900, "b": 90, "c": 10}
    power, w = mixing.temperature_weights(tokens, 1000, flatten=1.0, max_epochs=2.0)
    assert 0 < power < 1 and abs(max(w[k] * 1000 / tokens[k] for k in tokens) - 2) < 1e-6
    power, w = mixing.temperature_weights(tokens, 100, target_entropy=0.8)
    assert abs(mixing.entropy(list(w.values())) - 0.8) < 1e-6
    assert mixing.temperature_weights(tokens, 10_000, max_epochs=1.0)[0] == 1.0
    power, w = mixing.temperature_weights(tokens, 100, flatten=0.5)
    shares = mixing.entropy([0.9, 0.09, 0.01])
    assert 0 < power < 1 and abs(mixing.entropy(list(w.values())) - (shares + 0.5 * (math.log(3) - shares))) < 1e-6
    assert mixing.temperature_weights(tokens, 100)[0] == mixing.temperature_weights({"a": 5, "b": 5}, 10, flatten=0.5)[0] == 1.0
    assert mixing.temperature_weights({}, 5) == (1.0, {})


def test_mixing_realises_the_weights(spark):
    rng = random.Random(2)
    rows = [(k, "w " * rng.randint(0, 9), "big" if k % 10 else ("small" if k % 20 else None)) for k in range(400)] + [(None, None, "big"), (7, "x", "big")]
    d = docs(spark, rows)
    plan = mixing.mixing_plan(d, block_rows=16, flatten=0.5).collect()
    size = Counter()
    for _, t, s in rows:
        size[s or ""] += len((t or "").split()) + 1
    budget, got = sum(size.values()), Counter()
    for r in plan:
        got[r.source] += r.n_tokens
    weights = {r.source: r.weight for r in plan}
    assert abs(sum(weights.values()) - 1) < 1e-9
    for s, w in weights.items():
        assert 0 <= int(w * budget) - got[s] < 10 and w * budget / size[s] <= 2 + 1e-6
    assert {(r.doc_id, r.epoch) for r in mixing.mixing_plan(d, block_rows=16, flatten=0.5).collect()} == {(r.doc_id, r.epoch) for r in plan}
    mixed = mixing.mix(d.withColumn("weight", F.lit(1)), block_rows=16, flatten=0.5)
    assert mixed.columns[-1] == "weight" and Counter(r.doc_id for r in mixed.collect() if r.doc_id not in (7, None)) == Counter(r.doc_id for r in plan if r.doc_id not in (7, None))
    assert mixing.mixing_plan(d.limit(0)).collect() == []


# --- language model


def test_base_scores_and_normalised_model(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(["un", "deux", "trois"] if k % 2 else ["one", "two", "three"]) for _ in range(rng.randint(0, 12))) + (" rare%d" % k if k % 9 == 0 else ""), "s") for k in range(120)] + [(500, None, "s"), (None, "one", "s")]
    got = {r.doc_id: r for r in class_lm.lm_scores(docs(spark, rows)).collect()}
    count = Counter()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    for i, t, _ in rows:
        if not held(i):
            count.update((t or "").split() + [""])
    n, v = sum(count.values()), len(count)
    for i, t, _ in rows:
        toks = (t or "").split() + [""]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(toks), sum(count[x] > 0 for x in toks), n)
        assert abs(r.base_score - sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in toks)) < 1e-6
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    tri = np.random.default_rng(1).integers(0, 3, (7,) * 3).astype(float)
    assert np.allclose(class_lm.transitions(tri).sum(2), 1)
    assert class_lm.lm_scores(docs(spark, [])).collect() == []


def test_class_scores_match_a_plain_model(spark):
    """The scores from the classes found, by dictionaries; and the model sums to one."""
    rng = random.Random(14)
    size = class_lm.Sizes(head=30, clustered=12, classes=4)
    word = lambda: f"w{min(int(rng.expovariate(0.08)), 90)}"
    rows = [(k, " ".join(word() for _ in range(rng.randint(0, 40))), "s") for k in range(90)] + [(500, None, "s"), (501, "never seen words", "s"), (1, "w1 w2", "s")]
    d = docs(spark, rows).withColumns({"ids": F.lit(1), "word": F.lit("x"), "n": F.lit(2), "train": F.lit(None)})
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    texts = d.selectExpr("doc_id", "coalesce(text, '') AS text", "crc32(cast(doc_id as string)) % 10 <> 0 AS train")
    count = Counter(x for i, t, _ in rows if not held(i) for x in [*(t or "").split(), ""])
    model, encoded = class_lm.fit(texts, size)
    numbered = sorted((w for w in count if w), key=lambda w: (-count[w], w))[: len(model.cls) - 1]
    cls = {"": size.end} | dict(zip(numbered, model.cls[1:].tolist()))
    assert len(numbered) > 12 and all(c < 4 for w, c in cls.items() if w)
    words = class_lm.place_tail(class_lm.encode(texts, pa.array(numbered)), model.cls, np.ones((size.all,) * 2), size).collect()
    assert {r.word: r.n for r in words} == {w: n for w, n in count.items() if w and w not in numbered}
    assert all((r.c == size.rare) == (r.n == 1) for r in words)

    def classes(r):
        ids, t = class_lm.unpacked(r.ids).tolist(), iter(r.tail_c or [])
        return [int(model.cls[k]) if k >= 0 else next(t) for k in ids]

    tri = Counter()
    for r in encoded.where("train").collect():
        c = [size.end, size.end, *classes(r)]
        tri.update(zip(c, c[1:], c[2:]))
    bi, uni = Counter(), Counter()
    for (_, b, c), n in tri.items():
        bi[b, c] += n
        uni[c] += n

    def p(a, b, c):
        p1 = (uni[c] + 0.5) / (sum(uni.values()) + 0.5 * size.all)
        seen = {z: n for (y, z), n in bi.items() if y == b}
        kinds = max(len(seen), 1)
        p2 = (seen.get(c, 0) + kinds * p1) / (sum(seen.values()) + kinds)
        seen = {z: n for (x, y, z), n in tri.items() if (x, y) == (a, b)}
        kinds = max(len(seen), 1)
        return (seen.get(c, 0) + kinds * p2) / (sum(seen.values()) + kinds)

    of = {}
    for r in encoded.collect():
        texts_of = [(t or "").split() for i, t, _ in rows if i == r.doc_id]
        t = next(x for x in texts_of if len(x) + 1 == len(r.ids) // 3)
        for w, c in zip(t, classes(r)):
            of.setdefault(w, c)
            assert of[w] == c  # a word has one class
    members = {}
    for w in count:
        members.setdefault(of.get(w, size.end if not w else None), []).append(w)
    total = {c: sum(count[w] for w in ws) for c, ws in members.items()}
    n, v = sum(count.values()), len(count)

    def emit(w, c):
        return (count[w] + 0.1) / (total.get(c, 0) + 0.1 * (len(members.get(c, [])) + (c == size.rare)))

    got = {(r.doc_id, r.n_tokens): r for r in class_lm.lm_scores(d, size=size).collect()}
    for i, t, _ in rows:
        words, c, want = [*(t or "").split(), ""], [size.end, size.end], 0.0
        for w in words:
            c.append(size.end if not w else of[w])
            want += math.log10(0.95 * p(*c[-3:]) * emit(w, c[-1]) + 0.05 * (count[w] + 0.1) / (n + 0.1 * (v + 1)))
        assert abs(got[i, len(words)].score - want) < 1e-6
    whole = sum(0.95 * p(0, 1, of.get(w, size.end)) * emit(w, of.get(w, size.end)) + 0.05 * (count[w] + 0.1) / (n + 0.1 * (v + 1)) for w in [*count, "unseen"] if w != "unseen")
    whole += 0.95 * p(0, 1, size.rare) * emit("unseen", size.rare) + 0.05 * 0.1 / (n + 0.1 * (v + 1))
    assert abs(whole - 1) < 1e-9


def test_packed_word_numbers_come_back():
    ids = np.array([-1, 0, 1, 255, 256, 65536, (1 << 23) - 1, -1])
    assert class_lm.unpacked(class_lm.packed(ids)).tolist() == ids.tolist() and len(class_lm.packed(ids)) == 24
    assert class_lm.unpacked(b"").tolist() == []


def test_packed_counts_come_back_and_are_small():
    rng = np.random.default_rng(4)
    total = rng.integers(0, 3, 10_000).astype(np.int32) * rng.integers(0, 2, 10_000).astype(np.int32)
    total[[0, 77, 9_999]] = (1, 1 << 30, 70_000)
    got = np.zeros((5, 2048), np.int64)
    packs = list(class_lm.pack_counts(total, 2048))
    for part, data in packs * 2:
        class_lm.add_counts(got[part], data)
    assert got.ravel()[:10_000].tolist() == (2 * total.astype(np.int64)).tolist() and not got.ravel()[10_000:].any()
    assert sum(len(d) for _, d in packs) == 6 * np.count_nonzero(total)  # 24 bytes and more in rows of two longs
    assert list(class_lm.pack_counts(np.zeros(9, np.int32), 4)) == []


def test_exchange_ends_where_no_move_helps():
    rng = np.random.default_rng(3)
    size = class_lm.Sizes(classes=3)
    bigrams = rng.poisson(np.kron(rng.integers(1, 9, (3, 3)), np.ones((5, 5)))).astype(np.float32)
    cls = np.arange(15) % 3

    def counts(cls):
        member = np.zeros((15, size.all))
        member[np.arange(15), cls] = 1
        return member.T @ (bigrams @ member)

    def likelihood(cls):
        pair = counts(cls)
        return class_lm._phi(pair).sum() - class_lm._phi(pair.sum(0)).sum() - class_lm._phi(pair.sum(1)).sum()

    pair, before = counts(cls), likelihood(cls)
    while class_lm.exchange_sweep(cls, bigrams, pair, np.arange(15), size):
        assert np.allclose(pair, counts(cls))
        assert likelihood(cls) > before
        before = likelihood(cls)
    for w in range(15):
        for c in range(3):
            other = cls.copy()
            other[w] = c
            assert likelihood(other) <= before + 1e-6


# --- classifiers


def labelled(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for k in range(400):
        w = [word() for _ in range(rng.randint(12, 60))]
        toxic, good = k % 5 == 0, k % 4 != 0
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["meanword", "badword"])
        rows.append((k, " ".join(w if good else [x + "##" for x in w]), "s"))
        labels.append((k, int(good), int(toxic)))
    return docs(spark, [*rows, (900, None, "s"), (901, "", "s"), (None, "text", "s")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("score", "label"), [(toxicity.toxicity_scores, "toxic"), (quality_classifier.quality_scores, "quality")])
def test_held_out_accuracy(spark, score, label):
    d, labels = labelled(spark)
    got = score(d, labels)
    rows = got.collect()
    assert len(rows) == 403 and all(0 <= r.score <= 1 for r in rows)
    want = {r.doc_id: r[label] for r in labels.collect()}
    out = [r for r in rows if r.held_out and r.doc_id in want]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows if r.doc_id is not None)
    assert sum(r.predicted == want[r.doc_id] for r in out) / len(out) > 0.95
    none = score(d, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0}


@pytest.mark.parametrize(("score", "label"), [(toxicity.toxicity_scores, "toxic"), (quality_classifier.quality_scores, "quality")])
def test_few_labels_ties_and_odd_rows(spark, score, label):
    train = [k for k in range(100) if zlib.crc32(str(k).encode()) % 4 != 2][:12]
    rows = [(k, f"plain text of {k} words you see" + " badword!" * (k in train[:3]), "s") for k in range(40)]
    rows += [(0, rows[0][1], "s"), (700, "same text", "s"), (701, "same text", "s"), (None, None, None), (800, "word badword you " * 100_000, "s")]
    d = docs(spark, rows).withColumns({"score": F.lit(1), "label": F.lit("x"), "raw": F.lit(2)})
    for n in (0, 1, 2, 3):  # so many of label 1, then of label 0
        for labels in ([int(i < n) for i in range(12)], [int(i >= n) for i in range(12)]):
            got = score(d, spark.createDataFrame(list(zip(train, labels)) + [(1, None), (None, 1)], f"doc_id long, {label} int")).collect()
            assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
            by = {r.doc_id: r.score for r in got}
            assert by[700] == by[701] and len({r.score for r in got if r.doc_id == 0}) == 1
            if sum(labels) in (0, 12):
                assert set(by.values()) == {sum(labels) / 12}
    assert score(d.limit(0), spark.createDataFrame([(1, 1)], f"doc_id long, {label} int")).collect() == []


def test_quality_learns_from_every_label(spark):
    """One row of label 1 among 30,000 is learned from, whatever its id's hash, and the threshold parts it from the rest."""
    ids = spark.range(40_000).where("crc32(cast(id as string)) % 4 <> 2").withColumn("k", F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1 << 30))).orderBy(F.desc("k"))
    best = ids.first().id
    d = spark.range(40_000, numPartitions=4).selectExpr("id AS doc_id", f"IF(id = {best}, 'one fine text of many quite different words that goes on', 'b| b| b|') AS text")
    got = quality_classifier.quality_scores(d, d.selectExpr("doc_id", f"cast(doc_id = {best} as int) AS quality"))
    by = {(r.doc_id == best): r.score for r in got.groupBy("doc_id").agg(F.max("score").alias("score")).where(f"doc_id IN ({best}, {(best + 1) % 40_000})").collect()}
    assert by[True] > by[False]


def test_every_labelled_row_is_in_a_pair(spark):
    rng = random.Random(5)
    rows = [(k, float(k < 5), *[float(k == 7 * j) + rng.random() for j in range(len(quality_classifier.FEATURES))]) for k in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, label double, " + ", ".join(f"{f} double" for f in quality_classifier.FEATURES)).repartition(5)
    assert {(r.label, r.number) for r in quality_classifier.numbered(table).collect()} == {(float(k >= 55), k) for k in range(60)}
    got = {round(r.length, 9) for r in quality_classifier.preference_pairs(table, 55, 60).where("label = 1").collect()}
    of = {k: {round(a[2] - b[2], 9) for a in rows for b in rows if a[1] > b[1] and k in (a[0], b[0])} for k in range(60)}
    assert all(got & diffs for diffs in of.values())


def test_value_of_a_rank_is_exact(spark):
    rng = random.Random(8)
    values = [rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e6), 2.5, -1e-9]) for _ in range(500)]
    d = spark.createDataFrame([(v,) for v in values], "raw double")
    assert [quality_classifier.at_rank(d, k) for k in (1, 125, 300, 500)] == [sorted(values)[k - 1] for k in (1, 125, 300, 500)]


def test_nearness_is_that_of_a_plain_search():
    rng = random.Random(3)
    for _ in range(50):
        words = [rng.choice(["you", "bad", "x"]) for _ in range(rng.randint(1, 60))]
        hits, second = ([k for k, w in enumerate(words) if w == v] for v in ("bad", "you"))
        want = sum(any(abs(k - j) <= toxicity.NEAR for j in second) for k in hits) / len(words)
        assert toxicity.features(" ".join(words), {"bad": 1.0})[toxicity.FEATURES.index("near_second")] == want


LONG = " ".join(f"word{k % 5000}" for k in range(120_000))


def test_long_texts_and_clashing_columns_in_packing_rules_and_language_model(spark):
    rows = [(1, LONG, "s"), (2, "", "s"), (3, None, None), (None, "a b c", "s"), (4, "ten words are needed here so that this text passes", "s")]
    clash = {c: F.lit(7) for c in ("ids", "piece", "length", "task", "nth", "kept", "n_words", "train", "score", "rid", "tail")}
    d = docs(spark, rows).withColumns(clash)
    packed = packing.pack(d).collect()
    ids = {i: b"".join(bytes(r.ids) for r in sorted((r for r in packed if r.doc_id == i), key=lambda r: r.piece)) for i in (1, 2, 3, 4)}
    encode = packing.Encoder(*packing.tokenizer_paths()).encode
    assert ids == {i: encode(t or "") + bytes(4) for i, t, _ in rows if i}
    verdicts = {r.doc_id: (r.n_words, r.kept) for r in quality_rules.quality_verdicts(d, stats=True).collect()}
    assert verdicts == {1: (120_000, False), 2: (0, False), 3: (0, False), None: (3, False), 4: (10, True)}
    passed = quality_rules.quality_filter(d)
    assert passed.columns == d.columns and [r.doc_id for r in passed.collect()] == [4]
    got = {r.doc_id: r for r in class_lm.lm_scores(d, size=class_lm.Sizes(head=100, clustered=50, classes=4)).collect()}
    assert got[1].n_tokens == 120_001 and all(r.score <= 0 for r in got.values()) and len(got) == 5


def test_pipeline_on_an_empty_table_and_with_more_columns(spark, tmp_path):
    import corpus_pipeline

    d = docs(spark, [(k, " ".join(f"w{k}x{j}" for j in range(30)), "s") for k in range(6)] + [(5, "other words " * 20, None)])
    d.limit(0).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").collect() == []
    clash = d.withColumns({c: F.lit(1) for c in ("id", "row", "sha", "th", "digest", "position", "kept", "grp", "length", "__text", "__id")})
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, clash, "")
        assert out.columns == clash.columns and out.count() > 0
    assert corpus_pipeline.STAGES[4][1](spark, clash, "").count() == 7


def test_pipeline_runs_and_each_stage_acts(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    good = [" ".join(word() for _ in range(40)) for _ in range(30)]
    near = good[0].split()
    near[20] = "changed"
    rows = [(k, t, f"s{k % 3}") for k, t in enumerate(good)] + [(100, good[1], "s0"), (101, " ".join(near), "s1"), (102, "few words", "s2"), (103, None, "s2")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    d, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:3]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left.append({r.doc_id for r in d.collect()})
    clean = set(range(30))
    assert left == [clean | {100, 101}, clean | {101}, clean]
    d = d.cache()
    plan = Counter(r.doc_id for r in mixing.mixing_plan(d, flatten=0.5, max_epochs=2.0).collect())
    mixed = corpus_pipeline.STAGES[3][1](spark, d, str(tmp_path))
    assert mixed.columns == d.columns and Counter(r.doc_id for r in mixed.collect()) == plan
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    encode, text = packing.Encoder(*packing.tokenizer_paths()).encode, {r.doc_id: r.text for r in d.collect()}
    want = Counter((i, encode(text[i]) + bytes(4)) for i, n in plan.items() for _ in range(n))
    assert Counter((r.doc_id, bytes(r.ids)) for r in packed) == want  # short texts: one piece each
    at = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0) and r.offset + r.length <= 2048
        at[r.sequence_id] = r.offset + r.length
