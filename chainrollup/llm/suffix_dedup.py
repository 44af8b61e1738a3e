"""Removal of long repeated byte strings, found in merged Burrows-Wheeler transforms.

A byte goes if a `LENGTH`-byte string that covers it starts earlier too (in a smaller doc_id, or earlier in the same
document). Repeated strings are found where they can be, exactly:

1. Every string of LENGTH bytes has a seed, the SEED-byte string in it with the smallest hash (leftmost of ties). Equal strings have
   equal seeds, so only strings around seeds that occur twice can repeat; seeds are counted over all documents.
2. Of the surroundings of such seeds (all the bytes that strings with this seed cover) a 64-bit digest is dealt by seed. Of identical
   surroundings all but the earliest go. A seed that very many documents hold is dealt string by string instead. Differing surroundings
   of a seed are left only where they share more than the seed, on its left or on its right.
3. The bytes of these are sorted in the tasks: shards of them get their Burrows-Wheeler transform, and the transforms are merged by
   refining their interleave, one symbol of depth a round, without comparing suffixes again. A boundary that first shows in
   round h has a common prefix of h - 1 symbols; intervals without one at LENGTH bytes are repeats, and all but the earliest of each go.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import filters
from .common import id_text, stored

LENGTH, SEED = 100, 50
LAST = (1 << 63) - 1  # a null doc_id comes last
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 64, 256, np.uint64)  # a random number for each byte
_BASE = 0x5851F42D4C957F2D
MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
PIECE = 1 << 20  # bytes that are hashed at a time


@lru_cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2 ** 64."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all strings of `width` bytes: differences of a prefix polynomial, mixed."""
    n = len(data) - width + 1
    up, down = _powers(max(1 << 16, 1 << len(data).bit_length()))
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=prefix[1:])
    x = (prefix[width:] - prefix[:n]) * down[:n]
    x ^= x >> np.uint64(32)
    x *= MIX1
    return x ^ (x >> np.uint64(29))


def sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best (np.minimum or np.maximum) of every run of `width` values."""
    size = 1
    while size < width:
        step = min(size, width - size)
        values = best(values[:-step], values[step:])
        size += step
    return values


def leftmost_minima(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, first, last): positions that are the leftmost minimum of the runs of `width` values starting at first..last.

    A value is a minimum somewhere if it equals the largest of the minima of the runs around it; runs with one minimum have one
    value or, where values tie, several, which share them from left to right."""
    low = sliding(h, width, np.minimum)
    new = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    end = np.append(new[1:], len(low)) - 1
    pad = np.zeros(width - 1, h.dtype)
    pos = np.flatnonzero(h == sliding(np.concatenate((pad, low, pad)), width, np.maximum))
    value = h[pos]
    turn = np.concatenate(([True], value[1:] != value[:-1]))
    run = np.cumsum(turn) - 1
    first = np.where(turn, new[run], np.concatenate(([0], pos[:-1] + 1)))
    return pos, first, np.minimum(end[run], pos)


def seeds(data: np.ndarray, bounds: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """data: texts end to end; bounds: where each begins, and the end. (hash, position, first, last, text) of every seed:
    the strings that start at first..last have it."""
    parts = []
    for at in range(0, max(len(data) - length + 1, 0), PIECE):
        h = gram_hashes(data[at : at + PIECE + length - 1], seed)
        pos, first, last = leftmost_minima(h, length - seed + 1)
        parts.append((h[pos], pos + at, first + at, last + at))
    if not parts:
        empty = np.empty(0, np.int64)
        return np.empty(0, np.uint64), empty, empty, empty, empty
    h, pos, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
    own = np.searchsorted(bounds, pos, "right") - 1
    first, last = np.maximum(first, bounds[own]), np.minimum(last, bounds[own + 1] - length)
    real = first <= last
    h, pos, first, last, own = h[real], pos[real], first[real], last[real], own[real]
    begin = np.flatnonzero(np.concatenate(([True], pos[1:] != pos[:-1]))) if len(pos) else np.empty(0, np.int64)  # one seed, though pieces part it
    return h[begin], pos[begin], first[begin], last[np.append(begin[1:], len(pos)) - 1] if len(pos) else last, own[begin]


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 64, size: int = 1 << 20):
    """Slices of at most `rows` texts, which end where `size` bytes are reached."""
    for whole in batches:
        texts = whole.column("text").cast(pa.binary())
        lengths = np.asarray(pa.compute.binary_length(texts))
        at = 0
        while at < whole.num_rows:
            n = int(np.searchsorted(np.cumsum(lengths[at : at + rows]), size)) + 1
            n = min(n, rows, whole.num_rows - at)
            yield whole.slice(at, n), b"".join(texts.slice(at, n).to_pylist()), np.concatenate(([0], np.cumsum(lengths[at : at + n])))
            at += n


def symbols(strings: list[bytes], step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strings as symbols of `step` bytes in each of their `step` phases: (symbols end to end, each phase ended by a 0; sizes with the
    end; numbers of the strings). Phase f of a string has the symbols that begin at f, f + step, ...; symbols keep the order of bytes."""
    parts, sizes, owner, phase = [], [], [], []
    for k, s in enumerate(strings):
        for f in range(step):
            n = max(0, (len(s) - f) // step)
            parts.append(s[f : f + n * step])
            sizes.append(n + 1)
            owner.append(k)
            phase.append(f)
    raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, step).astype(np.int64)
    code = raw[:, 0]
    for c in range(1, step):
        code = code * 256 + raw[:, c]
    return code, np.array(sizes), np.array(owner) * step + np.array(phase)


def bwt(sym: np.ndarray, sizes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols before each rotation, string, offset) in the order of the rotations' first `depth` symbols or more. sym: strings of positive
    symbols end to end, each with a 0 behind it, of the given sizes; each is read in a circle."""
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    offset = np.arange(len(sym)) - begin[owner]
    rank, span = sym.astype(np.int64), 1
    while span < depth:
        after = begin[owner] + (offset + span) % sizes[owner]
        key = rank * (int(rank.max()) + 1) + rank[after]
        rank = np.unique(key, return_inverse=True)[1]
        span *= 2
    order = np.argsort(rank, kind="stable")
    before = begin[owner] + (offset - 1) % sizes[owner]
    return sym[before[order]], owner[order], offset[order]


def merge_bwts(bwts: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, interval) of the merged order: interleave refinement. After round h the interleave is sorted by h symbols, and positions
    with the same interval share them. A round reads the transforms in the interleave's order and deals positions to
    their symbols, keeping their order; an interval breaks where the symbol or the interval read changes."""
    shard = np.repeat(np.arange(len(bwts), dtype=np.int8), [len(b) for b in bwts])
    interval = np.zeros(len(shard), np.int32)
    sym = np.empty(len(shard), bwts[0].dtype)
    for _ in range(depth):
        for k, b in enumerate(bwts):
            sym[shard == k] = b
        order = np.argsort(sym, kind="stable")
        s, i = sym[order], interval[order]
        fresh = np.empty(len(s), bool)
        fresh[:1] = False
        fresh[1:] = (s[1:] != s[:-1]) | (i[1:] != i[:-1])
        shard, interval = shard[order], np.cumsum(fresh, dtype=np.int32)
    return shard, interval


def repeats(strings: list[bytes], spans: list[tuple[int, int]], place: list[tuple[int, int]], length: int, shards: int = 4) -> list[tuple[int, int, int]]:
    """(string, first, last): the offsets within each string, among spans, where a string of `length` bytes starts that starts
    earlier as well. place: (doc, position of the string's first byte). The transforms run over symbols of four bytes where
    that divides the length, so that a fourth of the rounds reaches it."""
    step = 4 if length % 4 == 0 else 1
    code, sizes, name = symbols(strings, step)
    dense = np.unique(code, return_inverse=True)[1] + 1
    kind = np.uint16 if dense.max(initial=0) < 65535 else np.int32  # 16 bits are sorted by radix
    sym = np.zeros(sizes.sum(), kind)
    ends = np.cumsum(sizes) - 1
    body = np.ones(len(sym), bool)
    body[ends] = False
    sym[body] = dense
    cuts = np.linspace(0, len(sizes), shards + 1).astype(int)
    ranges = [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]
    start = np.concatenate(([0], ends + 1))
    parts = [bwt(sym[start[a] : start[b]], sizes[a:b], length // step) for a, b in ranges]
    shard, interval = merge_bwts([p[0] for p in parts], length // step)
    owner, offset = np.empty(len(shard), np.int64), np.empty(len(shard), np.int64)
    for k, ((a, _), p) in enumerate(zip(ranges, parts, strict=True)):
        mine = shard == k
        owner[mine], offset[mine] = name[a + p[1]] // step, p[2] * step + name[a + p[1]] % step
    lo, hi = np.array(spans).T
    real = (offset >= lo[owner]) & (offset <= hi[owner])
    owner, offset, interval = owner[real], offset[real], interval[real]
    doc, at = np.array(place, np.int64).T
    order = np.lexsort((at[owner] + offset, doc[owner], interval))
    first = np.concatenate(([True], interval[order][1:] != interval[order][:-1]))
    owner, offset = owner[order][~first], offset[order][~first]
    order = np.lexsort((offset, owner))
    owner, offset = owner[order], offset[order]
    if not len(owner):
        return []
    cut = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1))))
    end = np.append(cut[1:], len(owner)) - 1
    return list(zip(owner[cut].tolist(), offset[cut].tolist(), offset[end].tolist(), strict=True))


def _columns(names: str) -> pa.Schema:
    return pa.schema([(c, pa.int64()) for c in names.split()])


DIGESTS = _columns("kind h c l r doc th first last")
GONE, AROUND = 0, 1  # kinds: strings that go for certain; a seed's surroundings
STRINGS = _columns("h c doc th first last").append(pa.field("bytes", pa.binary()))
RANGES = _columns("doc th first last")


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'long'}" for f in schema)


def _record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if isinstance(c, np.ndarray) and c.dtype == np.uint64 else c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def earliest(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with the same h and c, the indices of those that start first, sorted by h and c; and of the others that start later."""
    order = np.lexsort((rows["first"], rows["doc"], rows["c"], rows["h"]))
    h, c, doc, at = (rows[k][order] for k in ("h", "c", "doc", "first"))
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))[: len(order)]
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    return order[new], order[(doc != doc[head]) | (at != at[head])]


def merged_ranges(doc: np.ndarray, th: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same ranges, with those that adjoin joined."""
    order = np.lexsort((first, th, doc))
    doc, th, first, last = doc[order], th[order], first[order], last[order]
    turn = np.concatenate(([True], (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])))[: len(doc)]
    shift = np.cumsum(turn) * (int(last.max(initial=0)) + 2)  # sets the texts apart
    reached = np.maximum.accumulate(last + shift)
    new = np.concatenate(([True], (first + shift)[1:] > reached[:-1] + 1))[: len(doc)]
    begin = np.flatnonzero(new)
    return doc[begin], th[begin], first[begin], np.maximum.reduceat(last, begin) if len(begin) else last


class Pile:
    """Arrays gathered until there are enough of them."""

    def __init__(self, names: list[str]):
        self.names, self.parts, self.size = names, {n: [] for n in names}, 0

    def add(self, *columns) -> None:
        for n, c in zip(self.names, columns, strict=True):
            self.parts[n].append(c)
        self.size += len(columns[0])

    def take(self) -> dict[str, np.ndarray]:
        out = {n: np.concatenate(p) if p else np.empty(0, np.int64) for n, p in self.parts.items()}
        self.__init__(self.names)
        return out


def _by_hash(batches: Iterator[pa.RecordBatch], enough) -> Iterator[pa.Table]:
    """Rows sorted by h, in tables that end between two values of h, once enough(table) is true."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        table = pa.Table.from_batches(waiting)
        h = table.column("h").to_numpy()
        cut = int(np.searchsorted(h, h[-1])) if len(h) else 0
        if cut and enough(table):
            yield table.slice(0, cut)
            waiting = table.slice(cut).to_batches()
    if waiting:
        yield pa.Table.from_batches(waiting)


def repeated_ranges(texts: DataFrame, length: int = LENGTH, seed: int = SEED, hot: int = 5000, chunk_bytes: int = 1_500_000, held: int = 400_000, bits: int = filters.BITS) -> DataFrame:
    """(doc, th, first, last): strings of `length` bytes that start at first..last in the document also start earlier.
    texts: doc, th (a hash of the text, to tell rows of the same id apart), text. `bits` bounds the bitmaps."""
    spark, pad = texts.sparkSession, length - seed
    half = pad // 2
    digest = xxhash.xxh3_64_intdigest

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pile = Pile(["h"])

        def counted() -> pa.RecordBatch:
            return _record(_columns("h n"), *np.unique(pile.take()["h"], return_counts=True))

        for _, data, bounds in _batches(batches):
            pile.add(seeds(np.frombuffer(data, np.uint8), bounds, length, seed)[0])
            if pile.size > held:
                yield counted()
        yield counted()

    counts = texts.select("text").mapInArrow(hashes, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    counts = stored(counts, "repeated-seeds")
    twice = filters.bitmap(counts, counts.count(), bits)
    wide = twice is None  # more seeds than a bitmap takes: rows meet the seeds in a join
    sets = spark.sparkContext.broadcast((twice, filters.frequent(counts, hot)))

    def occurrences(batch: pa.RecordBatch, data: bytes, bounds: np.ndarray) -> dict[str, np.ndarray]:
        """Repeated seeds: h, c (digest of the surroundings), doc, th, first, last and pos in the text, begin (where the text begins in data),
        often (whether the seed is frequent)."""
        h, pos, first, last, own = seeds(np.frombuffer(data, np.uint8), bounds, length, seed)
        on = filters.holds(sets.value[0], h)
        h, pos, first, last, own = h[on], pos[on], first[on], last[on], own[on]
        doc, th = (batch.column(c).to_numpy()[own] for c in ("doc", "th"))
        begin = bounds[own]
        lo, hi = np.maximum(begin, pos - pad), np.minimum(bounds[own + 1], pos + length)
        c = np.array([digest(data[a:b]) for a, b in zip(lo.tolist(), hi.tolist())], np.uint64)
        c = (c ^ (first - lo).astype(np.uint64) * MIX2) * MIX1 + (last - lo).astype(np.uint64) * MIX2
        return {"h": h, "c": c ^ (c >> np.uint64(32)), "doc": doc, "th": th, "first": first - begin, "last": last - begin, "begin": begin, "pos": pos - begin, "often": filters.among(sets.value[1], h)}

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pile = Pile(["h", "c", "l", "r", "doc", "th", "first", "last"])

        def flush() -> Iterator[pa.RecordBatch]:
            rows = pile.take()
            best, gone = earliest(rows)
            yield _record(DIGESTS, np.full(len(best), AROUND), *(rows[k][best] for k in pile.names))
            ranges = merged_ranges(*(rows[k][gone] for k in ("doc", "th", "first", "last")))
            none = np.zeros(len(ranges[0]), np.int64)
            spread = ranges[0].astype(np.uint64) * MIX1 + ranges[2].astype(np.uint64) * MIX2  # done with: dealt evenly
            yield _record(DIGESTS, none + GONE, spread, none, none, none, *ranges)

        for batch, data, bounds in _batches(batches):
            o = occurrences(batch, data, bounds)
            rare = ~o["often"]
            cold = {k: v[rare] for k, v in o.items()}
            # of strings from pos - half on back, all hold the seed and `half` bytes before it; all later ones hold as many behind it
            sides, at = [], cold["begin"] + cold["pos"]
            for has, a, b in ((cold["first"] <= cold["pos"] - half, at - half, at + seed), (cold["last"] > cold["pos"] - half, at, at + length - half)):
                sides.append(np.array([digest(data[x:y]) or 1 if w else 0 for w, x, y in zip(has.tolist(), a.tolist(), b.tolist())], np.uint64))
            pile.add(cold["h"], cold["c"], *sides, cold["doc"], cold["th"], cold["first"], cold["last"])
            if o["often"].any():  # a seed that very many texts hold: string by string
                many = {k: v[o["often"]] for k, v in o.items()}
                n = many["last"] - many["first"] + 1
                at = np.repeat(many["first"] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                doc, th, begin = (np.repeat(many[k], n) for k in ("doc", "th", "begin"))
                strings = [data[x : x + length] for x in (begin + at).tolist()]
                none = np.zeros(len(at), np.uint64)
                pile.add(np.array([digest(s, 1) for s in strings], np.uint64), np.array([digest(s) for s in strings], np.uint64), none, none, doc, th, at, at)
            if pile.size > held:
                yield from flush()
        yield from flush()

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of equal surroundings all but the earliest go; of seeds with several left, those that share more than the seed are kept for the transforms."""
        for table in _by_hash(batches, lambda t: t.num_rows > held):
            rows = {n: table.column(n).to_numpy() for n in DIGESTS.names}
            sure = np.flatnonzero(rows["kind"] == GONE)
            at = np.flatnonzero(rows["kind"] == AROUND)
            best, gone = earliest({k: v[at] for k, v in rows.items()})
            best, gone = at[best], np.concatenate((sure, at[gone]))
            shared = np.zeros(len(best), bool)
            for side in ("l", "r"):
                key = (rows["h"][best].astype(np.uint64) * MIX1) ^ rows[side][best].astype(np.uint64)
                times = np.unique(key, return_inverse=True, return_counts=True)
                shared |= (times[2][times[1]] > 1) & (rows[side][best] != 0)
            best = best[shared]
            ranges = merged_ranges(*(rows[k][gone] for k in ("doc", "th", "first", "last")))
            none = np.zeros(len(ranges[0]), np.int64)
            yield _record(DIGESTS, none + GONE, none, none, none, none, *ranges)
            yield _record(DIGESTS, *(rows[k][best] for k in DIGESTS.names))

    found = texts.select("doc", "th", "text").mapInArrow(around, _ddl(DIGESTS))
    if wide:
        found = stored(found, "surroundings")
        of_seeds = "l <> 0 OR r <> 0"  # the rest: strings that go, and strings dealt on their own
        found = found.where(f"NOT ({of_seeds})").unionByName(found.where(of_seeds).join(counts.hint("merge"), "h", "left_semi"))
    sifted = stored(found.repartition("h").sortWithinPartitions("h").mapInArrow(sift, _ddl(DIGESTS)), "sifted")
    gone = sifted.where(f"kind = {GONE}").select(*RANGES.names)
    open_ = sifted.where(f"kind = {AROUND}").select("h", "c")
    n_open = open_.count()
    if not n_open:
        return gone
    wanted = spark.sparkContext.broadcast(filters.bitmap(open_, n_open, bits, "c"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in _batches(batches):
            o = occurrences(batch, data, bounds)
            o = {k: v[~o["often"] & filters.holds(wanted.value, o["c"])] for k, v in o.items()}
            best, _ = earliest(o)
            o = {k: v[best] for k, v in o.items()}
            yield _record(STRINGS, *(o[k] for k in STRINGS.names[:-1]), [data[a : b + length] for a, b in zip((o["begin"] + o["first"]).tolist(), (o["begin"] + o["last"]).tolist())])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_hash(batches, lambda t: t.column("bytes").nbytes > chunk_bytes):
            rows = {n: table.column(n).to_numpy() for n in STRINGS.names[:-1]}
            best, _ = earliest(rows)
            h = rows["h"][best]
            alone = np.concatenate(([True], h[1:] != h[:-1])) & np.concatenate((h[1:] != h[:-1], [True]))
            best = best[~alone[: len(best)]]
            if not len(best):
                continue
            first, last, doc, th = (rows[k][best] for k in ("first", "last", "doc", "th"))
            got = repeats(table.column("bytes").take(pa.array(best)).to_pylist(), [(0, n) for n in (last - first).tolist()], list(zip(doc.tolist(), first.tolist())), length)
            if got:
                k, a, b = np.array(got, np.int64).T
                yield _record(RANGES, doc[k], th[k], first[k] + a, first[k] + b)

    strings = texts.select("doc", "th", "text").mapInArrow(fetch, _ddl(STRINGS))
    if wanted.value is None:
        strings = strings.join(open_.distinct().hint("merge"), ["h", "c"], "left_semi")
    return gone.unionByName(strings.repartition("h").sortWithinPartitions("h").mapInArrow(settle, _ddl(RANGES)))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int | None = None, **options) -> DataFrame:
    """One row per document: doc_id, spans (array of struct start, length in bytes: the maximal removed runs), kept (the remaining
    bytes).

    A null or empty text has no bytes. Of rows that repeat a doc_id with the same text, none comes earlier than the other; with different
    texts, they share an id and are compared by position. A null doc_id comes after all others. Other columns are not read."""
    seed = seed or length // 2
    texts = id_text(docs, id_col, text_col).select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("th"), "text")
    ranges = repeated_ranges(texts.select("doc", "th", "text"), length, seed, **options)
    per_doc = ranges.groupBy("doc", "th").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))  # no more than a document has strings

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                spans, kept = [], []
                for text, found in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                    data, runs = text.encode("utf-8", "surrogatepass"), []
                    for a, b in sorted((r["first"], r["last"] + length) for r in found or ()):
                        if runs and a <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], b)
                        else:
                            runs.append([a, b])
                    edges = [0, *(x for run in runs for x in run), len(data)]
                    kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                    spans.append([{"start": a, "length": b - a} for a, b in runs])
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), "kept": pa.array(kept, pa.binary())})

    return texts.join(per_doc, ["doc", "th"], "left").select("doc_id", "text", "ranges").mapInArrow(cut, "doc_id long, spans array<struct<start: long, length: long>>, kept binary")
