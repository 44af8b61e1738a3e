"""Quality rules as a short-circuit cascade.

Each rule's cost (seconds a document) and selectivity (share of documents it rejects) are estimated on a
sample, on the executors. The rules then run in the order of rejections per second of cost, and a document
that one rejects is not shown to the rest. The verdict does not depend on the order, only the work does.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text

SYMBOLS = b"#*$%&|<>"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))


class TextView:
    """A text and what the rules ask of it, each worked out once, when first asked for."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def data(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\v\f\r"))

    def count_of(self, chars: bytes) -> int:
        return len(self.data) - len(self.data.translate(None, chars))

    @cached_property
    def n_symbols(self) -> int:
        return self.count_of(SYMBOLS)

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.data.split(b"\n") if x and not x.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of `width` words found twice or more, the first occurrence included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    code, base = seq[:n], len(ids)
    span = base  # codes lie below span; renumbered before they could overflow, so equal codes are equal windows
    for k in range(1, width):
        if span > (1 << 62) // base:
            code = np.unique(code, return_inverse=True)[1]
            span = int(code.max()) + 1
        code, span = code * base + seq[k : k + n], span * base
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


@dataclass(frozen=True)
class Rule:
    """rejects(view) is true for a document that goes."""

    name: str
    rejects: Callable[[TextView], bool]


BASE_RULES = (
    Rule("few_words", lambda v: v.n_words < 10),
    Rule("repetition", lambda v: 100 * v.n_repeat_words > 20 * v.n_words),
)
#: Beside the base rules. All are far from what running prose in a Latin script shows.
MORE_RULES = (
    Rule("symbols", lambda v: 10 * v.n_symbols > v.n_words),
    Rule("same_lines", lambda v: v.n_dup_lines >= 3 and 100 * v.n_dup_lines > 30 * len(v.lines)),
    Rule("capitals", lambda v: v.count_of(UPPER) > v.count_of(LOWER) + 20),
    Rule("exclamations", lambda v: 10 * v.data.count(b"!") > 3 * v.n_words),
    Rule("long_words", lambda v: v.word_chars > 40 * v.n_words),
)
RULES = BASE_RULES + MORE_RULES


def measure_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, seed: int = 11) -> list[tuple[str, float, float]]:
    """(name, seconds a document, share rejected) of each rule, on about `sample_rows` documents picked by a
    hash of the id. The texts stay on the executors; the driver gets three numbers a rule and task."""
    rows = docs.count()
    if not rows:
        return [(r.name, 0.0, 0.0) for r in rules]
    share = min(1.0, sample_rows / rows)
    sample = docs.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        took, hits, n = [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                n += 1
                for k, rule in enumerate(rules):
                    view, began = TextView(text), time.perf_counter()
                    hits[k] += bool(rule.rejects(view))
                    took[k] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"rule": [r.name for r in rules], "took": took, "hits": hits, "n": [n] * len(rules)})

    got = sample.select("text").mapInArrow(run, "rule string, took double, hits long, n long").groupBy("rule").agg(F.sum("took").alias("took"), F.sum("hits").alias("hits"), F.sum("n").alias("n")).collect()
    by = {r["rule"]: (r["took"] / max(r["n"], 1), r["hits"] / max(r["n"], 1)) for r in got}
    return [(r.name, *by.get(r.name, (0.0, 0.0))) for r in rules]


def order_rules(measured: list[tuple[str, float, float]]) -> list[str]:
    """By rejections per second, most first; ties by name."""
    return [name for name, *_ in sorted(measured, key=lambda m: (-m[2] / max(m[1], 1e-9), m[0]))]


STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, stats: bool = False) -> DataFrame:
    """One row per document: doc_id, kept; with `stats` also n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words and base_failed, which are then worked out for every document.

    A null or empty text has no words and is rejected (fewer than ten words). Repeated rows are judged one
    by one; other columns are not read."""
    rows = id_text(docs, id_col, text_col)
    by_name = {r.name: r for r in rules}
    cascade = [by_name[name] for name in order_rules(measure_rules(rows, rules, sample_rows))]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                views = [TextView(t) for t in batch.column("text").to_pylist()]
                alive = range(len(views))
                for rule in cascade:
                    alive = [k for k in alive if not rule.rejects(views[k])]
                kept = np.zeros(len(views), bool)
                kept[list(alive)] = True
                cols = {"doc_id": batch.column("doc_id")}
                if stats:
                    for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
                        cols[name] = pa.array([getattr(v, name) for v in views], pa.int64())
                    cols["base_failed"] = pa.array([any(r.rejects(v) for r in BASE_RULES) for v in views], pa.bool_())
                cols["kept"] = pa.array(kept)
                yield pa.RecordBatch.from_pydict(cols)

    return rows.mapInArrow(judge, "doc_id long, " + STATS * stats + "kept boolean")


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """The documents that pass, all their columns as they were, clashing names included. Whole rows pass through the tasks and
    the rejected ones are left out there: no join, no shuffle. Null and empty texts have no words and are rejected; rows that repeat are
    judged one by one, whatever their doc_id, null ones too; no documents give no rows."""
    by_name = {r.name: r for r in rules}
    cascade = [by_name[name] for name in order_rules(measure_rules(id_text(docs, id_col, text_col), rules, sample_rows))]
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                views = [TextView(t or "") for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array([not any(r.rejects(v) for r in cascade) for v in views], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
