"""Language-model scores by a Brown class-based trigram model.

1. Words are counted over all training documents. The `head` most frequent get numbers, which every task can hold; the
   rest is the tail, whose counts and classes stay in a table and are joined.
2. Exchange clustering puts the `clustered` most frequent words into `classes` classes: their bigrams are counted over the corpus, and sweep
   after sweep each word moves to the class that raises the likelihood of the class bigrams most, with all counts kept up to date. Every
   other word seen twice or more then moves once or, if numbered, twice, in parallel, to the class that fits its neighbours' classes on both
   sides best. Words seen once are a class of their own, which unknown words share; so is the end of a text.
3. Class trigrams are counted over the corpus and smoothed by Witten-Bell; words are emitted by their class in proportion to
   their counts. Class model and unigram model are mixed; each sums to one over the known words and one unknown.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, id_text, scratch, stored

ALPHA, MIX = 0.1, 0.95


@dataclass(frozen=True)
class Sizes:
    """Bounds of what a task or the driver holds. head: numbered words; clustered: words in the exchange, whose bigrams (clustered ** 2 at
    most) the driver holds; classes. A larger vocabulary has more words in the table, and no word is left out."""

    head: int = 1 << 17
    clustered: int = 4096
    classes: int = 64

    def __post_init__(self) -> None:
        if self.head > 1 << 23:
            raise ValueError("head: word numbers have three bytes")

    @property
    def rare(self) -> int:
        return self.classes

    @property
    def end(self) -> int:
        return self.classes + 1

    @property
    def all(self) -> int:
        return self.classes + 2


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over `texts`; the end of a text is the word ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary()).cast(pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(tokens(text))
                seen[b""] += 1
                if len(seen) > 400_000:
                    yield flush()
        yield flush()

    return texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_words(vocab: DataFrame, most: int) -> pa.Table:
    """(word, n) of the most frequent words, at most `most` - 1 and down to a count that a histogram of logarithmic counts gives, so
    that no more than these are sent to the driver. The most frequent first, ties by word."""
    level = F.floor(F.log(F.col("n").cast("double")) * 64).cast("int")
    words = vocab.where("word <> ''").withColumn("level", level)
    least, total = None, 0
    for r in sorted(words.groupBy("level").agg(F.count(F.lit(1)).alias("k")).collect(), key=lambda r: -r["level"]):  # a few thousand levels at most
        total += r["k"]
        if total > most - 1:
            break
        least = r["level"]
    got = (words.where(F.col("level") >= least) if least is not None else words.limit(0)).select("word", "n").toArrow()
    return got.sort_by([("n", "descending"), ("word", "ascending")])


def packed(ids: np.ndarray) -> bytes:
    """Word numbers of 32 bits, which lie from -1 to 2 ** 23 - 1, in three bytes each."""
    return ids.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    three = np.frombuffer(data, np.uint8).reshape(-1, 3)
    out = np.empty((len(three), 4), np.uint8)
    out[:, 1:] = three
    return out.reshape(-1).view("<i4") >> 8  # the shift brings the sign down


def encode(texts: DataFrame, head: pa.Array) -> DataFrame:
    """doc_id, train, ids (packed word numbers, -1 for the tail, the end's 0 last), tail (its words in order). head: the numbered
    words from 1 on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = {w: k for k, w in enumerate(head.cast(pa.binary()).to_pylist(), 1)}.get
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids, tails = [], []
                for text in batch.column("text").to_pylist():
                    words = tokens(text)
                    got = [get(w, -1) for w in words]
                    tails.append([w.decode("utf-8", "surrogatepass") for w, k in zip(words, got, strict=True) if k < 0])
                    ids.append(packed(np.array(got + [0], "<i4")))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "train": batch.column("train"), "ids": pa.array(ids, pa.binary()), "tail": pa.array(tails, pa.list_(pa.string()))})

    return texts.mapInArrow(run, "doc_id long, train boolean, ids binary, tail array<string>")


def pack_counts(total: np.ndarray, width: int) -> Iterator[tuple[int, bytes]]:
    """(part, codes and counts) of the parts of `width` codes that have counts: two bytes a code, four planes of bytes for the counts."""
    at = np.flatnonzero(total)
    part = at // width
    for k in np.split(np.arange(len(at)), np.flatnonzero(np.diff(part)) + 1) if len(at) else ():
        yield int(part[k[0]]), (at[k] - width * part[k]).astype("<u2").tobytes() + total[at[k]].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def add_counts(total: np.ndarray, data: bytes) -> None:
    n = len(data) // 6
    total[np.frombuffer(data, "<u2", n)] += np.ascontiguousarray(np.frombuffer(data, np.uint8, offset=2 * n).reshape(4, n).T).view("<u4").ravel()


def tally(encoded: DataFrame, codes, size: int, cls: np.ndarray | None = None, counts: np.ndarray | None = None, width: int = 2048, finish: Callable | None = None, schema: str = "code long, n long") -> DataFrame:
    """(code, n) over the training documents, or `schema` by finish(first code, counts of `width` codes). codes(word numbers), or with cls
    codes(classes of all tokens), gives numbers below `size`, which bounds a task's memory and its output. Counts are shuffled packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, n = np.zeros(size, np.int32), [], 0

        def add() -> None:
            got, times = np.unique(np.concatenate(waiting), return_counts=True)
            total[got] += times.astype(np.int32)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                waiting.append(codes(unpacked(row[0]) if cls is None else _tokens_of(*row, cls, counts)[0]))
                n += len(waiting[-1])
                if n > 2_000_000:
                    add()
                    waiting, n = [], 0
        if waiting:
            add()
        rows = pack_counts(total, width)
        while some := list(itertools.islice(rows, 1000)):
            yield pa.RecordBatch.from_pydict({"part": pa.array([p for p, _ in some], pa.int32()), "data": pa.array([d for _, d in some], pa.binary())})

    def listed(first: int, total: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_pydict({"code": at + first, "n": total[at]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((p, d) for b in batches for p, d in zip(*(c.to_pylist() for c in b.columns), strict=True))  # sorted by part
        for part, group in itertools.groupby(rows, lambda r: r[0]):
            total = np.zeros(width, np.int64)
            for _, data in group:
                add_counts(total, data)
            yield (finish or listed)(part * width, total)

    columns = ["ids"] if cls is None else ["ids", "tail_c", "tail_n"]
    packs = encoded.where("train").select(*columns).mapInArrow(run, "part int, data binary")
    return packs.repartition("part").sortWithinPartitions("part").mapInArrow(merge, schema)


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange_sweep(cls: np.ndarray, bigrams: np.ndarray, pair: np.ndarray, movable: np.ndarray, size: Sizes) -> int:
    """Moves words to their best classes, one after the other; returns how many moved. bigrams[v, w]: how often w follows v; pair: the
    same by class. Both cls and pair are changed in place, so each word meets the counts that the moves before it have left."""
    k, moved = size.classes, 0
    for w in movable:
        left = np.bincount(cls, bigrams[:, w], size.all)
        right = np.bincount(cls, bigrams[w], size.all)
        if not left.any() and not right.any():
            continue
        a, own = cls[w], float(bigrams[w, w])
        left[a] -= own  # without the bigrams of w with itself
        right[a] -= own
        pair[a] -= right
        pair[:, a] -= left
        pair[a, a] -= own
        np.maximum(pair, 0, out=pair)
        out, into = pair.sum(1), pair.sum(0)
        gain = (_phi(pair[:k] + right) - _phi(pair[:k])).sum(1) + (_phi(pair[:, :k] + left[:, None]) - _phi(pair[:, :k])).sum(0)
        mid = np.diagonal(pair)[:k]  # the corner that both sums touch
        gain += _phi(mid + right[:k] + left[:k] + own) - _phi(mid + right[:k]) - _phi(mid + left[:k]) + _phi(mid)
        n_out, n_in = right.sum() + own, left.sum() + own
        gain -= _phi(out[:k] + n_out) - _phi(out[:k]) + _phi(into[:k] + n_in) - _phi(into[:k])
        b = int(gain.argmax())
        if gain[b] <= gain[a] + 1e-9:
            b = a
        moved += b != a
        cls[w] = b
        pair[b] += right
        pair[:, b] += left
        pair[b, b] += own
    return moved


def cluster(encoded: DataFrame, n_words: int, size: Sizes, sweeps: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the first min(n_words, clustered) numbers (0 is the end) and the class bigram counts, words beyond them as rare."""
    n = min(n_words, size.clustered)
    other = n  # a symbol for every other word
    width = n + 1

    def codes(ids: np.ndarray) -> np.ndarray:
        s = np.where((ids < 0) | (ids >= n), other, ids).astype(np.int64)
        return np.concatenate(([0], s[:-1])) * width + s

    got = tally(encoded, codes, width * width).toArrow()  # at most (clustered + 1) ** 2 rows
    bigrams = np.zeros(width * width)  # counts up to 2 ** 53 are exact
    bigrams[got["code"].to_numpy()] = got["n"].to_numpy()
    bigrams = bigrams.reshape(width, width)
    cls = (np.arange(width) - 1) % size.classes
    cls[0], cls[other] = size.end, size.rare
    member = np.zeros((width, size.all))
    member[np.arange(width), cls] = 1
    pair = member.T @ (bigrams @ member)
    for _ in range(sweeps):
        if exchange_sweep(cls, bigrams, pair, np.arange(1, n), size) * 200 <= n:
            break
    return cls[:n], pair


def _fit_of(pair: np.ndarray, size: Sizes) -> np.ndarray:
    """(neighbour slot, class): how well a class fits a neighbour, of slots for the classes before and then those behind."""
    p = pair + 0.1
    return np.concatenate((np.log(p) - np.log(p.sum(0)), (np.log(p) - np.log(p.sum(1))[:, None]).T))[:, : size.classes]


def _neighbours(cls: np.ndarray, ids: np.ndarray, size: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """The slots of the classes before and behind each token."""
    c = np.where(ids < 0, size.rare, cls[ids])
    return np.concatenate(([size.end], c[:-1])), size.all + np.concatenate((c[1:], [size.end]))


def place_numbered(encoded: DataFrame, cls: np.ndarray, pair: np.ndarray, n_words: int, size: Sizes, rounds: int = 2) -> np.ndarray:
    """Classes of all numbered words: those beyond the clustered ones take the class that fits their neighbours best; in the first
    round only clustered words have classes, later all numbered ones."""
    n = len(cls)
    full = np.full(n_words, size.rare, np.int64)
    full[:n] = cls
    slots, fits = 2 * size.all, _fit_of(pair, size)
    for _ in range(rounds if n_words > n else 0):
        known = full.copy()

        def codes(ids: np.ndarray, known: np.ndarray = known) -> np.ndarray:
            at = ids >= n
            w = (ids[at].astype(np.int64) - n) * slots
            return np.concatenate([w + side[at] for side in _neighbours(known, ids, size)])

        def choose(first: int, total: np.ndarray) -> pa.RecordBatch:
            m = total.reshape(-1, slots)
            row = np.flatnonzero(m.any(1))
            return pa.RecordBatch.from_pydict({"w": (row + first // slots).astype(np.int32), "best": (m[row] @ fits).argmax(1).astype(np.int32)})

        got = tally(encoded, codes, (n_words - n) * slots, width=slots * max(1, 2048 // slots), finish=choose, schema="w int, best int").toArrow()  # at most `head` rows
        full[got["w"].to_numpy() + n] = got["best"].to_numpy()
    return full


def place_tail(encoded: DataFrame, cls: np.ndarray, pair: np.ndarray, size: Sizes) -> DataFrame:
    """(word, n, c) of every word of the training documents that has no number: its count, and the class that fits its neighbours best, the rare
    one if it was seen once."""
    slots, fits = 2 * size.all, _fit_of(pair, size)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in count], pa.string()), "slot": pa.array([s for _, s in count], pa.int32()), "n": pa.array(list(count.values()), pa.int64())})
            count.clear()
            return out

        for batch in batches:
            for raw, tail in zip(batch.column("ids").to_pylist(), batch.column("tail").to_pylist(), strict=True):
                ids = unpacked(raw)
                at = np.flatnonzero(ids < 0)
                for side in _neighbours(cls, ids, size):
                    count.update(zip(tail, side[at].tolist()))
                if len(count) > 300_000:
                    yield flush()
        yield flush()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list = []

        def placed(rows: list) -> pa.RecordBatch:
            words = [w for k, (w, *_) in enumerate(rows) if not k or rows[k - 1][0] != w]
            row = np.cumsum([k > 0 and rows[k - 1][0] != r[0] for k, r in enumerate(rows)])
            m = np.zeros((len(words), slots))
            np.add.at(m, (row, [r[1] for r in rows]), [r[2] for r in rows])
            n = m[:, : size.all].sum(1).astype(np.int64)
            c = np.where(n > 1, (m @ fits).argmax(1), size.rare)
            return pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "n": n, "c": c.astype(np.int32)})

        for batch in batches:  # sorted by word
            rest += zip(*(batch.column(x).to_pylist() for x in ("word", "slot", "n")), strict=True)
            if len(rest) > 20_000 and rest[0][0] != rest[-1][0]:
                cut = len(rest)
                while rest[cut - 1][0] == rest[-1][0]:
                    cut -= 1
                yield placed(rest[:cut])
                rest = rest[cut:]
        if rest:
            yield placed(rest)

    rows = encoded.where("train AND size(tail) > 0").select("ids", "tail").mapInArrow(seen, "word string, slot int, n long")
    rows = rows.repartition("word").groupBy("word", "slot").agg(F.sum("n").alias("n"))  # one shuffle for both: what a task has seen is summed up
    return rows.sortWithinPartitions("word").mapInArrow(choose, "word string, n long, c int")


@dataclass
class ClassModel:
    """What scoring needs, of a size that Sizes bounds."""

    size: Sizes
    cls: np.ndarray  # class of each numbered word
    counts: np.ndarray  # of each numbered word, the end first
    trans: np.ndarray  # P(c3 | c1, c2)
    total: np.ndarray  # tokens of each class
    types: np.ndarray  # words of each class
    n_tokens: int
    n_types: int

    def base(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.1) / (self.n_tokens + 0.1 * (self.n_types + 1))

    def emit(self, c: np.ndarray, count: np.ndarray) -> np.ndarray:
        """P(word | class), by the word's count; an unknown word is one of the rare class."""
        types = self.types + (np.arange(self.size.all) == self.size.rare)
        return (count + ALPHA) / (self.total + ALPHA * types)[c]

    def follow(self, c: np.ndarray) -> np.ndarray:
        """P(class | the two before) along a text."""
        before = np.concatenate(([self.size.end], c[:-1]))
        return self.trans[np.concatenate(([self.size.end], before[:-1])), before, c]


def transitions(tri: np.ndarray) -> np.ndarray:
    """P(c3 | c1, c2) by Witten-Bell, backing off to P(c3 | c2) and to smoothed class frequencies; every row sums to one."""
    bi = tri.sum(0)
    uni = bi.sum(0)
    p1 = (uni + 0.5) / (uni.sum() + 0.5 * len(uni))
    kinds = np.maximum((bi > 0).sum(1, keepdims=True), 1)
    p2 = (bi + kinds * p1) / (bi.sum(1, keepdims=True) + kinds)
    kinds = np.maximum((tri > 0).sum(2, keepdims=True), 1)
    return (tri + kinds * p2[None]) / (tri.sum(2, keepdims=True) + kinds)


def _tokens_of(row_ids: bytes, tail_c: list | None, tail_n: list | None, cls: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes and counts of a text's tokens."""
    ids = unpacked(row_ids)
    c, n = cls[ids], counts[ids]
    if tail_c:
        at = ids < 0
        c[at], n[at] = tail_c, tail_n
    return c, n


def fit(texts: DataFrame, size: Sizes) -> tuple[ClassModel, DataFrame]:
    """texts: doc_id, text, train. Returns the model and the texts as word numbers with the classes and counts of their tail words."""
    with scratch(texts.sparkSession):
        vocab = stored(count_words(texts.where("train")), "vocabulary")
        totals = vocab.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
        top = head_words(vocab, size.head)
        ends = vocab.where("word = ''").first()
        counts = np.concatenate(([ends["n"] if ends else 0], top.column("n").to_numpy())).astype(np.float64)
        encoded = stored(encode(texts, top.column("word").combine_chunks()).withColumn("rid", F.monotonically_increasing_id()), "encoded")
        cls, pair = cluster(encoded, len(counts), size)
        cls = place_numbered(encoded, cls, pair, len(counts), size)
        tail = stored(place_tail(encoded, cls, pair, size), "tail-words")
        # tail words meet their classes by a join on the word; a word that many documents hold is numbered or unknown, and a skewed join is split
        met = encoded.where("size(tail) > 0").select("rid", F.posexplode("tail").alias("k", "word")).join(tail, "word", "left")
        met = met.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("k", F.coalesce("c", F.lit(size.rare)).alias("c"), F.coalesce("n", F.lit(0)).alias("n")))).alias("t"))
        met = met.select("rid", F.col("t.c").alias("tail_c"), F.col("t.n").alias("tail_n"))
        encoded = stored(encoded.drop("tail").join(met, "rid", "left").drop("rid"), "classed", keep=True)

        def triples(c: np.ndarray) -> np.ndarray:
            before = np.concatenate(([size.end], c[:-1]))
            return (np.concatenate(([size.end], before[:-1])) * size.all + before) * size.all + c

        tri = np.zeros(size.all**3)
        got = tally(encoded, triples, size.all**3, cls, counts).toArrow()  # at most ALL ** 3 rows
        tri[got["code"].to_numpy()] = got["n"].to_numpy()
        total, types = np.bincount(cls, counts, size.all), np.bincount(cls, minlength=size.all).astype(np.float64)
        for r in tail.groupBy("c").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect():  # a row for each class
            total[r["c"]] += r["n"]
            types[r["c"]] += r["words"]
    return ClassModel(size, cls, counts, transitions(tri.reshape((size.all,) * 3)), total, types, totals["n"] or 0, totals["v"]), encoded


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: tuple[int, int] = (10, 0), size: Sizes = Sizes()) -> DataFrame:  # noqa: B008
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Scores are sums of log10 probabilities over the words and the end. Rows whose crc32(doc_id as text) mod fold[0] is fold[1] are not
    learned from. A null text is empty (one token, the end); a null doc_id counts as the id ''; repeated rows are learned from
    and scored each; words of one count are numbered in their order; other columns are not read; no documents give no rows. Without
    training documents every base score is 0."""
    texts = id_text(docs, id_col, text_col).withColumn("train", crc_mod("doc_id", fold[0]) != fold[1])
    model, encoded = fit(texts, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                out = {k: [] for k in ("n_tokens", "n_known", "base_score", "score")}
                for row in zip(*(batch.column(x).to_pylist() for x in ("ids", "tail_c", "tail_n")), strict=True):
                    c, n = _tokens_of(*row, model.cls, model.counts)
                    base = model.base(n)
                    out["n_tokens"].append(len(n))
                    out["n_known"].append(int((n > 0).sum()))
                    out["base_score"].append(float(np.log10(base).sum()))
                    out["score"].append(float(np.log10(MIX * model.follow(c) * model.emit(c, n) + (1 - MIX) * base).sum()))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "held_out": pa.array([not x for x in batch.column("train").to_pylist()]), "n_tokens": pa.array(out["n_tokens"], pa.int64()), "n_known": pa.array(out["n_known"], pa.int64()), "base_score": pa.array(out["base_score"], pa.float64()), "score": pa.array(out["score"], pa.float64())})

    got = encoded.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return got.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(model.n_tokens)).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
