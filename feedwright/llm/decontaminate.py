"""Benchmark decontamination by Wu-Manber multi-pattern search.

Patterns are the windows of ``width`` consecutive words of the benchmark items (a shorter item is one window). They
are searched in the words of each document: the last block of words at the current position is looked up in a shift
table; unless a pattern may end there, the position jumps on. Where it is zero, the patterns that end in that block
stand in a bucket, sorted by their first word, and are compared word by word.

Patterns of unequal length need tables of their own, since the shortest pattern bounds every jump; so there is one
pair of tables per length. All tables of a pass are sent to every task; a pass takes at most ``patterns_per_pass``
windows, and larger benchmarks are searched in as many passes as they need.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from feedwright.llm.text import per_document, words

WIDTH = 10
BLOCK = 2

_SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))


class Searcher:
    """Shift and bucket tables over patterns of one length."""

    def __init__(self, length: int) -> None:
        self.length = length
        self.block = min(BLOCK, length)
        self.default = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[bytes, list[tuple[tuple[bytes, ...], frozenset]]]] = {}

    def add(self, pattern: tuple[bytes, ...], items: frozenset) -> None:
        m, b = self.length, self.block
        for end in range(b, m + 1):
            key = pattern[end - b : end]
            self.shift[key] = min(m - end, self.shift.get(key, self.default))
        self.buckets.setdefault(pattern[m - b :], {}).setdefault(pattern[0], []).append((pattern, items))

    def find(self, text: list[bytes]) -> Iterable[tuple[int, frozenset]]:
        """Start and items of every occurrence."""
        m, b, default, shift = self.length, self.block, self.default, self.shift.get
        at, n = m, len(text)  # a window ends before ``at``
        while at <= n:
            key = (text[at - 2], text[at - 1]) if b == 2 else tuple(text[at - b : at])
            jump = shift(key, default)
            if jump:
                at += jump
                continue
            same_start = self.buckets[key].get(text[at - m])
            if same_start:
                window = tuple(text[at - m : at])
                for pattern, items in same_start:
                    if pattern == window:
                        yield at - m, items
            at += 1


def searchers(patterns: Iterable[tuple[str, list[str]]]) -> list[Searcher]:
    """Tables for (window with blanks between its words, its items)."""
    by_length: dict[int, Searcher] = {}
    for text, items in patterns:
        pattern = tuple(text.encode().split(b" "))
        by_length.setdefault(len(pattern), Searcher(len(pattern))).add(pattern, frozenset(items))
    return [by_length[k] for k in sorted(by_length)]


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def windows(items: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, item) of every benchmark item, once each; the item is its id as text, null stays null."""

    def setup():
        def cut(text: bytes) -> tuple[list[str]]:
            w = words(text)
            if not w:
                return ([],)
            return (list({b" ".join(w[i : i + width]).decode() for i in range(max(1, len(w) - width + 1))}),)

        return cut

    cut = per_document(items, [StructField("_windows", ArrayType(StringType()))], setup, id_col, text_col)
    return cut.select(F.col(id_col).cast("string").alias("item"), F.explode("_windows").alias("window")).distinct()


def contamination(
    docs: DataFrame,
    items: DataFrame,
    width: int = WIDTH,
    patterns_per_pass: int = 500_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    also: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, spans (array of hit word runs, end exclusive) and items (sorted ids).

    Null and empty texts have no words and no hits; items without words have no window; items without an id mark
    words, but are not listed. Rows that repeat an id are judged each on its own. An empty benchmark hits nothing.
    """
    rows = windows(items, width, item_col, item_text_col)
    passes = max(1, math.ceil(rows.count() / patterns_per_pass))
    fields = [StructField("n_words", LongType()), StructField("spans", _SPANS), StructField("items", ArrayType(StringType()))]
    # The text goes through all passes but the last, once even where it is among the further columns.
    with_text = tuple(dict.fromkeys((*also, text_col)))
    found = None
    for k in range(passes):
        # Bounded by patterns_per_pass: the windows of one pass.
        part = rows.where(F.pmod(F.xxhash64("window", "item"), F.lit(passes)) == k) if passes > 1 else rows
        patterns = part.groupBy("window").agg(F.collect_list("item").alias("items")).collect()
        tables = docs.sparkSession.sparkContext.broadcast([(r["window"], r["items"]) for r in patterns])

        def setup(tables=tables):
            found_by = searchers(tables.value)

            def judge(text: bytes) -> tuple:
                w = words(text)
                spans, hit = [], set()
                for s in found_by:
                    for start, items in s.find(w):
                        spans.append((start, start + s.length))
                        hit |= items
                return len(w), merged(spans), sorted(hit)

            return judge

        if found is None:
            found = per_document(docs, fields, setup, id_col, text_col, with_text if passes > 1 else also)
        else:
            found = _join_pass(found, fields, setup, id_col, text_col, also if k == passes - 1 else with_text)
    return found.select(id_col, *also, "n_words", "spans", "items")


def _join_pass(found: DataFrame, fields, setup, id_col, text_col, also) -> DataFrame:
    """A further pass over the same rows, its hits joined with those so far."""
    before = found.withColumnsRenamed({f.name: f"_{f.name}" for f in fields})
    keep = list(dict.fromkeys([*also, *(f"_{f.name}" for f in fields)]))
    both = per_document(before, fields, setup, id_col, text_col, keep)
    spans = F.concat("_spans", "spans")
    runs = F.aggregate(
        F.array_sort(spans),
        F.array().cast(_SPANS),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["start"] <= F.element_at(acc, -1)["end"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(
                    F.struct(
                        F.element_at(acc, -1)["start"].alias("start"),
                        F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return both.select(
        id_col, *also, "n_words", runs.alias("spans"), F.array_sort(F.array_union("_items", "items")).alias("items")
    )
