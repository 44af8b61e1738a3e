import itertools
import os
import random
from collections import Counter

import numpy as np
import pytest

from chainrollup.llm import near_dedup as near_dedup_module
from chainrollup.llm.graph import components
from chainrollup.llm.near_dedup import Postings, candidate_pairs, crowded_pairs, estimate, link_sets, near_dedup, near_groups, registers, shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, percent=75):
    rows = [(i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set()) for i, t in rows]
    part = {i: i for i, _ in rows}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for (i, a), (j, b) in itertools.combinations(rows, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = find(i), find(j)
            part[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in rows}


def corpus(seed=3, families=12, copies=14):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(families):
        base = [word() for _ in range(rng.randint(20, 150))]
        for _ in range(rng.randint(1, copies)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 25))):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t))
    texts += [texts[0], texts[0].upper(), "", None, "one two", "one two", "ONE  two", "one two three", " ".join(word() for _ in range(3000))]
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize(("block", "rows_each"), [(2_000_000, 10_000), (300, 10_000), (200_000, 3)])
def test_groups_match_brute_force(spark, block, rows_each, monkeypatch):
    monkeypatch.setattr(near_dedup_module, "BLOCK_ROWS", rows_each)
    rows = corpus()
    got = near_groups(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA), block_shingles=block).collect()
    want = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_nulls_repeats_and_empty_table(spark):
    rows = [(None, "a b c d e f", "en", "s", 1), (5, "a b c d e f", None, None, None), (5, "a b c d e f", None, None, None), (9, "A b c d e f", None, None, None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_groups(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == [(5, 5, True), (5, 5, True), (9, 5, False), (None, None, True)]
    assert near_groups(spark.createDataFrame([], SCHEMA)).collect() == []
    clash = spark.createDataFrame([(1, "x y", 3, 4), (2, "x y", 5, 6)], "doc_id long, text string, kept long, component_id long")
    assert [tuple(r) for r in near_dedup(clash).collect()] == [(1, "x y", 3, 4)]


def test_link_sets_and_components(spark):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(60)]
    part = link_sets(sets, 60)
    rows = {i: i for i in range(60)}

    def find(x):
        while rows[x] != x:
            x = rows[x]
        return x

    for i, j in itertools.combinations(range(60), 2):
        n = len(np.intersect1d(sets[i], sets[j]))
        if 100 * n >= 60 * (len(sets[i]) + len(sets[j]) - n):
            a, b = find(i), find(j)
            rows[max(a, b)] = min(a, b)
    assert part.tolist() == [find(i) for i in range(60)]
    assert Postings(sets).linked(np.array([999], np.uint64), 60).tolist() == []
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(5)
    for share in (0.3, 0.75, 0.9):
        err = []
        for _ in range(20):
            pool = rng.integers(0, 1 << 63, 800, np.uint64)
            n = int(800 * share)
            rest = (800 - n) // 2
            a, b = np.unique(pool[: n + rest]), np.unique(np.concatenate([pool[:n], pool[n + rest :]]))
            err.append(estimate(registers(a)[None], registers(b)[None], np.array([len(a)]), np.array([len(b)]))[0] - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(err)) < 0.03 and np.std(err) < 0.06


def test_merging_sketches():
    a, b = shingles("a b c d e f g h"), shingles("e f g h i j k l m")
    assert (np.maximum(registers(a), registers(b)) == registers(np.union1d(a, b))).all()


def test_a_template_family_loses_no_link(spark):
    """Texts that share half of their shingles with each other and, in pairs, three quarters: bands put hundreds into one bucket."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    template, rows = [word() for _ in range(70)], []
    for k in range(150):
        own = [*template, *(word() for _ in range(40))]
        other = list(own)
        other[rng.randrange(75, 100)] = word()
        other[rng.randrange(75, 100)] = word()
        rows += [(k, " ".join(own)), (1000 + k, " ".join(other))]
    got = near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert sum(c != i for i, (_, c) in want.items()) > 140
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_rows_of_the_same_id_with_other_texts_stay(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(30)) for x in "ab")
    rows = [(3, a, 1), (5, a, 2), (5, b, 3), (5, b, 4), (6, b.upper(), 5), (7, "", 6), (7, "", 7), (None, a, 8), (8, b + " more words", 9), (8, "other words", 10)]
    d = spark.createDataFrame(rows, "doc_id long, text string, th long").repartition(3)
    got = near_dedup(d)
    assert got.columns == ["doc_id", "text", "th"]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(3, a), (5, b), (7, ""), (7, ""), (None, a), (8, "other words")], key=str)


def test_a_long_text_and_its_copy(spark):
    long = " ".join(f"w{k}" for k in range(300_000))
    got = near_groups(spark.createDataFrame([(1, long), (2, long + " end"), (3, long[:1000])], "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_links_of_a_whole_table_are_all_found(spark):
    """Recall, measured: exact links by an inverted index of shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: set(shingles(r.text or "").tolist()) for r in docs.select("doc_id", "text").collect()}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    shared = Counter(p for h in holders.values() for p in itertools.combinations(sorted(h), 2))
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    part = {i: i for i in sets}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        part[max(x, y)] = min(x, y)
    got = near_groups(docs).collect()
    assert len(links) > 50 and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), find(i)) for i, s in sets.items()}


def test_crowded_texts_lose_no_link(spark):
    """Pairs just at the threshold in a family whose members all share half: no bucket's draws are relied on."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    template, rows = [word() for _ in range(64)], []
    for k in range(400):
        own = [*template, *(word() for _ in range(36))]
        other = list(own)
        for at in (70, 78, 97):
            other[at] = word()
        rows += [(k, " ".join(own)), (1000 + k, " ".join(other))]
    sets = {i: set(shingles(t).tolist()) for i, t in rows}
    met = crowded_pairs(spark.createDataFrame(rows, "rep long, text string"), 75).collect()
    part, direct = {i: i for i, _ in rows}, {(r.a, r.b) for r in met}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in ((r.a, r.b) for r in met if r.sure):
        x, y = find(a), find(b)
        part[max(x, y)] = min(x, y)
    linked = [(k, 1000 + k) for k in range(400) if 100 * len(sets[k] & sets[1000 + k]) >= 75 * len(sets[k] | sets[1000 + k])]
    assert len(linked) > 150 and all((a, b) in direct or find(a) == find(b) for a, b in linked)
    got = near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_members_of_large_buckets_are_crowded(spark):
    few = [(k, [7, 100 + k]) for k in range(5)]
    many = [(k, [8, 200 + k]) for k in range(10, 30)]
    got = {(r.a, r.b) for r in candidate_pairs(spark.createDataFrame(few + many, "rep long, bands array<long>")).collect()}
    assert {a for a, b in got if b is None} == set(range(10, 30))
    assert all(a < b < 5 for a, b in got if b is not None) and {x for p in got if p[1] is not None for x in p} == set(range(5))
