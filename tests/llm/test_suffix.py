import hashlib
import random

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chainrollup.llm import suffix_dedup
from chainrollup.llm.suffix_dedup import bwt, gram_hashes, leftmost_minima, merge_bwts, merged_ranges, remove_repeats, repeats, seeds


def brute(rows, length):
    seen, gone = {}, {}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    for k in order:
        data = (rows[k][1] or "").encode()
        mark = bytearray(len(data))
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                mark[p : p + length] = b"\1" * length
            else:
                seen[w] = 1
        gone[rows[k][0]] = (len(data), sum(mark), sum(m and not (p and mark[p - 1]) for p, m in enumerate(mark)), hashlib.sha256(bytes(b for b, m in zip(data, mark) if not m)).hexdigest())
    return gone


def corpus():
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    passages = [noise(n) for n in (19, 20, 21, 40, 90, 200)]
    rows = [(k, noise(rng.randint(0, 80)) + rng.choice(passages) + noise(rng.randint(0, 60)) + rng.choice(passages) + noise(rng.randint(0, 9))) for k in rng.sample(range(1000), 70)]
    rows += [(2000 + k, rows[k][1]) for k in range(5)] + [(3000, "x" * 300), (3001, "x" * 25), (3002, None), (3003, ""), (None, rows[0][1]), (3004, "\0\1" * 40), (3005, "\0\1" * 30)]
    return rows


def answers(df):
    got = df.select("doc_id", F.length("kept").alias("n"), F.sha2("kept", 256).alias("sha"), "spans").collect()
    return {r.doc_id: (r.n + sum(s.length for s in r.spans), sum(s.length for s in r.spans), len(r.spans), r.sha) for r in got}


def test_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows, 20)
    assert answers(remove_repeats(docs, length=20)) == want
    assert answers(remove_repeats(docs, length=20, hot=3, chunk_bytes=300, held=7)) == want
    assert answers(remove_repeats(docs, length=20, hot=9, held=50, bits=8)) == want  # no bitmap is small enough: seeds are joined
    assert answers(remove_repeats(docs, length=21)) == brute(rows, 21)


def test_empty_table_repeats_and_extra_columns(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(1, "a" * 30, 5), (1, "a" * 30, 6)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, th int"), length=20).collect()
    assert [(r.doc_id, [tuple(s) for s in r.spans]) for r in got] == [(1, [(1, 29)])] * 2


def test_merged_order_is_the_sorted_order():
    rng = random.Random(1)
    strings = [[rng.choice((1, 2)) for _ in range(rng.randint(1, 30))] for _ in range(40)]
    shards = [strings[k::3] for k in range(3)]
    parts = [bwt(np.array([x for s in shard for x in [*s, 0]], np.uint16), np.array([len(s) + 1 for s in shard]), 12) for shard in shards]
    shard, interval = merge_bwts([p[0] for p in parts], 12)
    rot = [iter([(([*mine[s], 0]) * 14)[o : o + 12] for s, o in zip(p[1], p[2])]) for mine, p in zip(shards, parts)]
    merged = [next(rot[k]) for k in shard]
    assert merged == sorted(merged)
    assert list(interval) == list(np.cumsum([0] + [a != b for a, b in zip(merged, merged[1:])]))


def test_repeats_and_hash_helpers():
    assert repeats([b"xabcdy", b"zabcdw"], [(0, 2), (0, 2)], [(1, 0), (2, 10)], 4) == [(1, 1, 1)]
    data = np.frombuffer(b"abcabcabc", np.uint8)
    h = gram_hashes(data, 5)
    assert h[0] == h[3] and len(set(h.tolist())) == 3 and len(h) == 5
    pos, first, last = leftmost_minima(np.array([3, 1, 2, 1, 5], np.uint64), 3)
    assert (pos.tolist(), first.tolist(), last.tolist()) == ([1, 3], [0, 2], [1, 2])


@given(st.lists(st.integers(0, 4), min_size=1, max_size=60), st.integers(1, 9))
def test_leftmost_minima_cover_every_run(values, width):
    if len(values) >= width:
        pos, first, last = leftmost_minima(np.array(values, np.uint64), width)
        got = {k: p for p, a, b in zip(pos.tolist(), first.tolist(), last.tolist()) for k in range(a, b + 1)}
        assert got == {k: min(range(k, k + width), key=lambda p: (values[p], p)) for k in range(len(values) - width + 1)}


@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30), st.integers(0, 9)), max_size=25))
def test_merged_ranges_cover_the_same(rows):
    doc, first, n = np.array(rows, np.int64).reshape(-1, 3).T
    spread = lambda d, a, b: {(x, p) for x, y, z in zip(d.tolist(), a.tolist(), b.tolist()) for p in range(y, z + 1)}
    d, _, a, b = merged_ranges(doc, doc * 0, first, first + n)
    assert spread(d, a, b) == spread(doc, first, first + n)


def test_long_texts_are_hashed_in_pieces(spark, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab") for _ in range(3000)), "a" * 2500, ""]
    data, bounds = "".join(texts).encode(), np.cumsum([0] + [len(t) for t in texts])
    whole = seeds(np.frombuffer(data, np.uint8), bounds, 20, 10)
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    for a, b in zip(whole, seeds(np.frombuffer(data, np.uint8), bounds, 20, 10), strict=True):
        assert a.tolist() == b.tolist()


def test_a_text_of_a_million_words_and_its_copy(spark):
    long = " ".join(f"w{k}" for k in range(1_000_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short")], "doc_id long, text string")
    got = {r.doc_id: (r.kept, [tuple(s) for s in r.spans]) for r in remove_repeats(docs).collect()}
    assert got[1][1] == [] and got[3] == (b"short", []) and got[2] == (b" end", [(0, len(long))])
