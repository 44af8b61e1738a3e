"""Near-duplicates by SetSketch registers.

1. A document is the set of its distinct 5-word shingles (64-bit hashes). Its sketch has `REGISTERS` registers; each
   keeps the minimum of exponential variates of the elements on an exponentially spaced, truncated scale. The
   sketch of a union is the registerwise maximum, and equal registers are the likelier the more two sets share.
2. Documents with equal sets are one class from here on, however many they are.
3. Four registers make a band. In every bucket of a band of at most `FEW` members, they are paired with four of them drawn by hash (never all
   with all). The members of larger buckets are crowded; among these every pair at the threshold is met by a shingle of its
   rarest ones, exactly: see `crowded_pairs`.
4. The similarity of a pair is estimated by the joint likelihood of its registers and set sizes; pairs well below the threshold go, and
   the rest is joined to neighbourhoods.
5. Within a neighbourhood the full sets are compared until its links are settled: everything that can still join
   two parts is compared exactly. Large ones are dealt in blocks; see `_settle`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import filters
from .common import drop_rows, id_text, rows_with, scratch, stored
from .graph import components

WIDTH = 5
REGISTERS, BAND = 128, 4
FEW, DRAWN = 6, 4  # members of a bucket that isn't crowded, and how many of them the others meet
SLOTS = 1 << 20  # of the table of shingle counts by hash, one byte each, that orders shingles by rarity
BASE, RATE, TOP = 1.02, 20.0, 65535  # of the registers' scale: base, rate of the exponentials, truncation
BLOCK_ROWS = 96  # of a block of a neighbourhood, besides its shingles
PRIME = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.Generator(np.random.PCG64(20240229))
_A = _rng.integers(0, 1 << 63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, REGISTERS, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; a shorter text is one shingle, no words none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    size = min(width, len(words))
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = _mixed(out * PRIME + h[k : k + n])
    return np.unique(out)


def registers(elements: np.ndarray) -> np.ndarray:
    """The SetSketch of a set of 64-bit hashes: unsigned 16-bit registers."""
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(elements), 1024):
        part = elements[at : at + 1024, None] * _A + _B
        part ^= part >> np.uint64(32)
        low = np.minimum(low, part.min(axis=0))
    exp = -np.log1p(-(low.astype(np.float64) + 1) / 2.0**64 * (1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(exp) / np.log(BASE)), 0, TOP).astype(np.uint16)


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, steps: int = 101) -> np.ndarray:
    """Jaccard similarity of pairs of sketches (rows) by maximum likelihood, given the set sizes. The counts of registers
    that are larger, smaller and equal have probabilities p(u - vJ), p(v - uJ) and the rest, with p(x) = -log_b(1 - x(b-1)/b)."""
    more, less = (ra > rb).sum(1)[:, None], (ra < rb).sum(1)[:, None]
    u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
    j = np.linspace(0, 1, steps)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    like = more * np.log(up) + less * np.log(down) + (ra.shape[1] - more - less) * np.log(np.maximum(1 - up - down, 1e-12))
    return j[np.arange(len(j)), like.argmax(1)]


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (a hash of the text), n_shingles, set_digest (128 bits of the set), bands (the registers, four to a long); the
    last two are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                n, digest, bands = [], [], []
                for text in batch.column("text").to_pylist():
                    s = shingles(text)
                    n.append(len(s))
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    bands.append(registers(s).view(np.int64) if len(s) else None)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "th": batch.column("th"), "n_shingles": pa.array(n, pa.int64()), "set_digest": pa.array(digest, pa.binary()), "bands": pa.array(bands, pa.list_(pa.int64()))})

    return id_text(docs, id_col, text_col).withColumn("th", F.xxhash64("text")).mapInArrow(run, "doc_id long, th long, n_shingles long, set_digest binary, bands array<long>")


def candidate_pairs(reps: DataFrame, few: int = FEW, centers: int = DRAWN) -> DataFrame:
    """Distinct (a, b), a < b: every member of a bucket of at most `few` with `centers` members of it, drawn by a hash of the band; and
    (a, null) for every member of a larger bucket."""
    rows = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    draw = [F.min_by("rep", F.xxhash64(F.lit(k), "band", "rep")).alias(f"c{k}") for k in range(centers)]
    met = rows.join(rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), *draw).where("n > 1"), ["band", "key"])
    ends = F.when(F.col("n") > few, F.array(F.lit(None).cast("long"))).otherwise(F.array_distinct(F.array(*[f"c{k}" for k in range(centers)])))
    met = met.select("rep", F.explode(ends).alias("c")).where("c IS NULL OR rep <> c")
    return met.select(F.least("rep", "c").alias("a"), F.when(F.col("c").isNotNull(), F.greatest("rep", "c")).alias("b")).distinct()


def crowded_pairs(texts: DataFrame, percent: int) -> DataFrame:
    """texts: rep, text. (a, b, sure): distinct, a < b; in these edges every two linked sets are joined, by one edge that isn't sure or by sure ones.

    Shingles are put in one order, by the count of what falls into their slot, rare ones first. Of two linked sets each has the first
    shingle that they share among its own first size - ceil(percent * size / 100) + 1. Members that have such a shingle in common are joined to
    the smallest and, if they are three at most, to the largest of them: then all are paired, and an estimate can drop a pair. If
    they are more, the edge to the smallest is sure (it is not a pair to be estimated, it makes one neighbourhood of them)."""
    spark = texts.sparkSession
    low = np.uint64(SLOTS - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                s = np.concatenate([shingles(t) for t in whole.column("text").slice(at, 512).to_pylist()])
                total += np.bincount((s & low).astype(np.int64), minlength=SLOTS)
        slot = np.flatnonzero(total)
        for at in range(0, len(slot), 1 << 16):
            yield pa.RecordBatch.from_pydict({"slot": slot[at : at + (1 << 16)].astype(np.int32), "n": total[slot[at : at + (1 << 16)]]})

    counted = texts.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    got = counted.select("slot", F.log2("n").cast("byte").alias("level")).toArrow()  # SLOTS rows at most
    level = np.zeros(SLOTS, np.uint8)
    level[got.column("slot").to_numpy()] = got.column("level").to_numpy()
    levels = spark.sparkContext.broadcast(level)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                reps, tokens = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
                for rep, text in zip(*(whole.column(c).slice(at, 256).to_pylist() for c in ("rep", "text")), strict=True):
                    s = shingles(text)
                    order = np.argsort(levels.value[(s & low).astype(np.int64)], kind="stable")  # s is sorted, so ties are in one order too
                    tokens.append(s[order[: len(s) + (-percent * len(s)) // 100 + 1]])
                    reps.append(np.full(len(tokens[-1]), rep, np.int64))
                yield pa.RecordBatch.from_pydict({"rep": np.concatenate(reps), "token": np.concatenate(tokens).view(np.int64)})

    held = stored(texts.select("rep", "text").mapInArrow(first, "rep long, token long"), "first-shingles")
    shared = held.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("c"), F.max("rep").alias("d")).where("n > 1")
    ends = F.when(F.col("n") > 3, F.array("c")).otherwise(F.array("c", "d"))
    met = held.join(shared, "token").select("rep", F.explode(ends).alias("c"), (F.col("n") > 3).alias("sure")).where("rep <> c")
    return met.groupBy(F.least("rep", "c").alias("a"), F.greatest("rep", "c").alias("b")).agg(F.max("sure").alias("sure"))


def likely_pairs(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("bands").alias(f"bands_{x}"), F.col("n_shingles").alias(f"n_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                ra, rb = (b.column(c).flatten().to_numpy(zero_copy_only=False).view(np.uint16).reshape(-1, REGISTERS) for c in ("bands_a", "bands_b"))
                na, nb = (b.column(c).to_numpy().astype(np.float64) for c in ("n_a", "n_b"))
                keep = pa.array(estimate(ra, rb, na, nb) >= least)
                yield pa.RecordBatch.from_pydict({c: b.column(c).filter(keep) for c in ("a", "b")})

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


class Postings:
    """Which of some sets hold an element, to count the elements that another set shares with each of them."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        values = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        order = np.argsort(values, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.values, self.begin = np.unique(values[order], return_index=True)
        self.end = np.append(self.begin[1:], len(values))

    def linked(self, s: np.ndarray, percent: int) -> np.ndarray:
        """Positions of the sets with 100 * intersection >= percent * union."""
        at = np.searchsorted(self.values, s)
        inside = at < len(self.values)
        at, s_in = at[inside], s[inside]
        at = at[self.values[at] == s_in]
        begin, length = self.begin[at], self.end[at] - self.begin[at]
        skip = np.repeat(begin - np.concatenate(([0], np.cumsum(length)[:-1])), length) if len(at) else np.empty(0, np.int64)
        both = np.bincount(self.owner[skip + np.arange(len(skip))], minlength=len(self.sizes))
        return np.flatnonzero((both > 0) & (100 * both >= percent * (self.sizes + len(s) - both)))


def link_sets(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The part (smallest position) of each set under exact links. A set is compared with those not yet reached only,
    so a dense group costs little more than one comparison each."""
    part = np.full(len(sets), -1, np.int64)
    rest = np.arange(len(sets))
    post = Postings(sets)
    indexed = rest
    for k in range(len(sets)):
        if part[k] >= 0:
            continue
        part[k], stack = k, [k]
        while stack:
            hits = indexed[post.linked(sets[stack.pop()], percent)]
            hits = hits[part[hits] < 0]
            part[hits] = k
            stack += hits.tolist()
            if len(hits):
                rest = rest[part[rest] < 0]
                if len(rest) * 2 < len(indexed):
                    indexed, post = rest, Postings([sets[x] for x in rest])
    return part


def _to_meet(outside: DataFrame, large: DataFrame, percent: int) -> DataFrame:
    """(comp, rep, block): the other blocks in which a set may be linked with one of `outside` (comp, rep, block).

    Of a set, any size - ceil(percent * size / 100) + 1 shingles include one of every set that it is linked with. Those are taken that
    the fewest members of the neighbourhood's first block hold (it is a sample of bounded size; which are taken matters to the speed only),
    and a block is to be met if it has one of them."""
    spark = large.sparkSession
    near = large.join(outside.select("comp").distinct(), "comp", "left_semi")

    def prefixes(left: pa.Table, right: pa.Table) -> pa.Table:
        held, times = np.unique(np.concatenate([shingles(t) for t in right.column("held").to_pylist()] or [np.empty(0, np.uint64)]), return_counts=True)
        reps, tokens = [], []
        for rep, text in zip(left.column("rep").to_pylist(), left.column("text").to_pylist(), strict=True):
            s = shingles(text)
            at = np.minimum(np.searchsorted(held, s), max(len(held) - 1, 0))
            often = np.where(held[at] == s, times[at], 0) if len(held) else np.zeros(len(s))
            tokens.append(s[np.argsort(often, kind="stable")[: len(s) + (-percent * len(s)) // 100 + 1]])
            reps.append(np.full(len(tokens[-1]), rep))
        n = sum(map(len, tokens))
        first = lambda c: left.column(c)[0].as_py() if left.num_rows else 0
        return pa.table({"comp": pa.array(np.full(n, first("comp"))), "own": pa.array(np.full(n, first("block"), np.int32)), "rep": pa.array(np.concatenate(reps) if n else [], pa.int64()), "token": pa.array(np.concatenate(tokens).view(np.int64) if n else [], pa.int64())})

    asked = outside.join(large.select("rep", "text"), "rep").select("comp", "block", "rep", "text")
    sample = near.where("block = 0").join(outside.select("comp", F.col("block").alias("of")).distinct(), "comp").select("comp", F.col("of").alias("block"), F.col("text").alias("held"))
    found = stored(asked.groupBy("comp", "block").cogroup(sample.groupBy("comp", "block")).applyInArrow(prefixes, "comp long, own int, rep long, token long"), "prefixes")
    wanted = spark.sparkContext.broadcast(filters.bitmap(found, found.count(), column="token"))

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                rows: dict[tuple[int, int], list[np.ndarray]] = {}
                for comp, block, text in zip(*(whole.column(c).slice(at, 512).to_pylist() for c in ("comp", "block", "text")), strict=True):
                    s = shingles(text)
                    rows.setdefault((comp, block), []).append(s[filters.holds(wanted.value, s)])
                sets = {k: np.unique(np.concatenate(v)) for k, v in rows.items()}
                n = [len(v) for v in sets.values()]
                yield pa.RecordBatch.from_pydict({"comp": pa.array(np.repeat([c for c, _ in sets], n), pa.int64()), "block": pa.array(np.repeat([b for _, b in sets], n), pa.int32()), "token": pa.array(np.concatenate([*sets.values(), np.empty(0, np.uint64)]).view(np.int64))})

    blocks = near.select("comp", "block", "text").mapInArrow(holders, "comp long, block int, token long").groupBy("comp", "token").agg(F.collect_set("block").alias("blocks"))
    met = found.join(blocks, ["comp", "token"]).groupBy("comp", "rep", "own").agg(F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("blocks"))
    return met.select("comp", "rep", "own", F.explode("blocks").alias("block")).where("own <> block").select("comp", "rep", "block")


def _settle(members: DataFrame, percent: int, block_shingles: int) -> DataFrame:
    """Edges (a, b) that join what exact links join. members: comp, rep, text, block, blocks.

    Blocks of a neighbourhood are settled alone first. Then, of neighbourhoods with several blocks, four members of each part
    meet the first block, which joins the blocks' large parts. With the parts that this leaves, every member outside the
    largest part of its neighbourhood meets the other blocks in which it may be linked (_to_meet): a link that is still missing has
    an end outside the largest part, so none is missed."""
    spark = members.sparkSession

    def inside(table: pa.Table) -> pa.Table:
        ids = table.column("rep").to_numpy()
        table = table.take(pa.array(np.argsort(ids, kind="stable")))
        ids = table.column("rep").to_numpy()
        part = link_sets([shingles(t) for t in table.column("text").to_pylist()], percent)
        return pa.table({"comp": table.column("comp"), "block": table.column("block"), "a": pa.array(ids), "b": pa.array(ids[part])})

    local = stored(members.groupBy("comp", "block").applyInArrow(inside, "comp long, block int, a long, b long"), "parts")
    edges = local.select("a", "b")
    large = members.where("blocks > 1")
    if large.isEmpty():
        return edges

    def across(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = right.column("part").to_pylist()
        post = Postings([shingles(t) for t in right.column("text").to_pylist()])
        out = {(q, parts[k]) for q, t in zip(left.column("q").to_pylist(), left.column("text").to_pylist(), strict=True) for k in post.linked(shingles(t), percent)}
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    def meet(queries: DataFrame, parts: DataFrame) -> DataFrame:
        """queries: comp, rep, block (to be met); parts: rep, part. The queries of a block are dealt in chunks of bounded size, and the
        block is there once for each chunk."""
        asked = queries.join(large.select("rep", "text"), "rep").select("comp", "block", F.col("rep").alias("q"), "text", F.length("text").alias("size"))
        asked = stored(asked, "asked")
        chunks = asked.groupBy("comp", "block").agg(F.ceil(F.greatest(F.sum("size") / (6 * block_shingles), F.count(F.lit(1)) / (4 * BLOCK_ROWS))).cast("int").alias("chunks"))
        chunks = stored(chunks, "chunks")
        asked = asked.join(chunks, ["comp", "block"]).withColumn("chunk", F.pmod(F.xxhash64("q"), "chunks").cast("int"))
        held = large.join(chunks, ["comp", "block"]).join(parts, "rep").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        key = ["comp", "block", "chunk"]
        return asked.select(*key, "q", "text").groupBy(*key).cogroup(held.select(*key, "text", "part").groupBy(*key)).applyInArrow(across, "a long, b long")

    parts = local.join(large.select("rep"), local["a"] == large["rep"], "left_semi").select(F.col("a").alias("rep"), F.col("b").alias("part"), "comp", "block")
    drawn = parts.where("block > 0").groupBy("comp", "part").agg(*[F.min_by("rep", F.xxhash64(F.lit(k), "rep")).alias(f"d{k}") for k in range(4)])
    drawn = drawn.select("comp", F.explode(F.array_distinct(F.array("d0", "d1", "d2", "d3"))).alias("rep"), F.lit(0).alias("block"))
    edges = stored(edges.unionByName(meet(drawn, parts.select("rep", "part"))), "links")
    joined = components(edges)
    now = stored(large.select("comp", "rep", "block").join(joined, F.col("rep") == F.col("node"), "left").select("comp", "rep", "block", F.coalesce("component", "rep").alias("part")), "parts-now")
    sizes = now.groupBy("comp", "part").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("comp").agg(F.max_by("part", F.struct("n", "part")).alias("largest"))
    outside = stored(now.join(largest, "comp").where("part <> largest").select("comp", "rep", "block"), "outside")
    if outside.isEmpty():
        return edges
    return edges.unionByName(meet(_to_meet(outside, large, percent), now.select("rep", "part")))


def _nodes(classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """classes: set_digest, rep (smallest doc_id of a class of equal sets). Adds the class's node: rep itself, or, for all but one of the classes with the
    same rep (a doc_id that several texts have), a number beyond the ids made from the digest; and a table (node, rep) of these."""
    several = stored(classes.groupBy("rep").agg(F.count(F.lit(1)).alias("n"), F.min("set_digest").alias("lead")).where("n > 1").select("rep", "lead"), "same-ids")
    if several.isEmpty():
        return classes.withColumn("node", F.col("rep")), None
    made = F.xxhash64("set_digest").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    classes = classes.join(several, "rep", "left").select("set_digest", "rep", F.when(F.col("lead").isNull() | (F.col("lead") == F.col("set_digest")), F.col("rep")).otherwise(made).alias("node"))
    return classes, classes.where("node <> rep").select("node", "rep")


def _groups(docs: DataFrame, id_col: str, text_col: str, percent: int, margin: float, block_shingles: int) -> DataFrame:
    """doc_id, th, n_shingles, grp (the node that names its component; null for an empty set or a null id), component_id."""
    if percent < 60:
        raise ValueError("percent: the bands are made for 60 and more")
    spark = docs.sparkSession
    with scratch(spark):
        sk = stored(sketches(docs, id_col, text_col), "sketches", keep=True)
        named = sk.where("n_shingles > 0 AND doc_id IS NOT NULL")
        classes, made = _nodes(stored(named.groupBy("set_digest").agg(F.min("doc_id").alias("rep")), "classes"))
        classes = stored(classes, "nodes", keep=True)
        made = made if made is None else stored(made, "made", keep=True)
        picked = classes.select(F.col("rep").alias("__rep"), F.col("set_digest").alias("__d"), "node")
        reps = named.join(picked, (F.col("doc_id") == F.col("__rep")) & (F.col("set_digest") == F.col("__d"))).dropDuplicates(["doc_id", "set_digest"])
        reps = stored(reps.select(F.col("node").alias("rep"), "doc_id", "th", "n_shingles", "bands"), "reps")
        text = id_text(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
        pairs = stored(candidate_pairs(reps.select("rep", "bands")), "pairs")
        crowded = reps.join(pairs.where("b IS NULL").select(F.col("a").alias("rep")), "rep").select("rep", "doc_id", "th")
        crowded = stored(crowded.join(text, ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).select("rep", "text"), "crowded")
        met = stored(crowded_pairs(crowded, percent), "met")
        pairs = pairs.where("b IS NOT NULL").unionByName(met.where("NOT sure").select("a", "b")).distinct()
        pairs = likely_pairs(pairs, reps, percent / 100 - margin).unionByName(met.where("sure").select("a", "b"))
        hoods = stored(components(pairs), "neighbourhoods")
        weights = hoods.join(reps.select("rep", "n_shingles"), F.col("node") == F.col("rep")).groupBy("component").agg(F.ceil(F.greatest(F.sum("n_shingles") / block_shingles, F.count(F.lit(1)) / BLOCK_ROWS)).cast("int").alias("blocks"))
        nodes = hoods.join(weights, "component").join(reps.select("rep", "doc_id", "th"), F.col("node") == F.col("rep"))
        nodes = nodes.select(F.col("component").alias("comp"), "rep", "doc_id", "th", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), "blocks")
        members = stored(nodes.join(text, ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).select("comp", "block", "blocks", "rep", "text"), "members")
        linked = stored(components(_settle(members, percent, block_shingles)), "linked", keep=True)
    name = F.coalesce("component", "node")
    labelled = classes.join(linked.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left").select("set_digest", name.alias("grp"))
    if made is not None:  # a made number is never the smallest unless all in the component are made
        labelled = labelled.join(made.select(F.col("node").alias("grp"), F.col("rep").alias("real")), "grp", "left")
    else:
        labelled = labelled.withColumn("real", F.lit(None).cast("long"))
    labelled = labelled.select("set_digest", "grp", F.coalesce("real", "grp").alias("label"))
    # a class of equal sets may be a large group; it meets one row here, and a skewed join is split
    out = sk.join(labelled, (sk["set_digest"] == labelled["set_digest"]) & sk["doc_id"].isNotNull(), "left")
    return out.select("doc_id", "th", "n_shingles", "grp", F.coalesce("label", "doc_id").alias("component_id"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, margin: float = 0.15, block_shingles: int = 200_000) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets; component_id is the smallest doc_id
    reachable. A null or empty text has no shingles and is linked with nothing. Texts that share a doc_id are linked by what they
    share, as others are, and get a row each; a row with a null doc_id is linked with nothing, its component_id is null and it is kept. Other
    columns are not read; no documents give no rows. `percent` may not be below 60, what the bands are made for; pairs are compared if their
    estimate is within `margin` below."""
    out = _groups(docs, id_col, text_col, percent, margin, block_shingles)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, margin: float = 0.15, block_shingles: int = 200_000) -> DataFrame:
    """The documents with one row of each group (see near_groups), all their columns as they were, clashing names included.

    The row of the smallest doc_id stays, of several texts with that id one picked by a hash of the text, of rows that repeat both, one.
    Rows with a null doc_id and null or empty texts are in no group and stay."""
    with scratch(docs.sparkSession):
        rows = stored(_groups(docs, id_col, text_col, percent, margin, block_shingles).where("grp IS NOT NULL").select(F.col("doc_id").alias("id"), "th", "grp", (F.col("doc_id") == F.col("component_id")).alias("kept")), "near-groups", keep=True)
    several = rows.where("kept").groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("th").alias("lead")).where("n > 1")
    several = stored(rows.where("kept").join(several, "grp").select("id", "th", "lead"), "same-ids")
    gone = rows.where("NOT kept").select("id", "th").unionByName(several.where("th <> lead").select("id", "th"))
    twins = several.where("th = lead").groupBy("id", "th").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "th")
    return drop_rows(rows_with(docs, id_col, text_col, "th", lambda t: F.xxhash64(t)), "th", gone, twins)
