"""How far the sources of one language use its terms differently.

Terms are runs of letters (A-Z lower-cased; every non-ASCII character counts as a letter). A language keeps the terms found
in enough of its documents. Each source gives each kept term a smoothed share in billionths, also terms it never uses, and
two sources are compared by the sum of (p - q)^2 / q, rounded down term by term, over all kept terms.

Almost every (term, source) count is zero, so the sum over all terms is never formed term by term. With f(p, q) the
rounded value, p0 the share of a term that a source lacks and V the number of kept terms,

    sum f(p, q) = V f(p0, q0)                                       all terms, as if both lacked them
                + sum over terms of the first source of f(p, q0) - f(p0, q0)
                + sum over terms of the second one of  f(p0, q) - f(p0, q0)
                + sum over terms of both of  f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0).

The first three lines need counts of counts only. For the last one, term rows - the nonzero counts of a term, ordered by
source - are inserted into frequent-pattern trees: rows that begin alike share nodes, a node's multiplicity is the number
of rows through it, and the correction of a pair of counts is computed once per node and ancestor and multiplied. A tree
is built per block of term rows, so memory is bounded; what its paths add up to is one number per pair of sources.

All arithmetic is exact: shares and quotients are integers, and sums whose parts are taken modulo 2^64 are right whenever
the value fits into a long, as it is asked to.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedwright.llm.components import saved, with_summary

#: Distinct (source, term) entries that a task holds before it passes them on.
HELD = 300_000
#: Counts in a block of term rows that one tree is built from, and pairs of sources whose sums a task holds.
BLOCK = 400_000
PAIRS = 1_000_000
SCALE = 1_000_000_000

_SEPARATORS = bytes([*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_UPPER = bytes(range(0x41, 0x5B))
_FOLD = bytes.maketrans(_SEPARATORS + _UPPER, b" " * len(_SEPARATORS) + _UPPER.lower())


def terms(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text."""
    return text.translate(_FOLD).split()


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial (lang, source, term, n, docs): occurrences and documents. An empty term stands for the group itself."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def passed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * (len(n) + 1), pa.string()),
                    pa.array([source] * (len(n) + 1), pa.string()),
                    pa.array([b"", *n], pa.binary()).cast(pa.string()),
                    pa.array([0, *n.values()], pa.int64()),
                    pa.array([0, *(docs[t] for t in n)], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )
        held.clear()

    entries = 0
    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        texts = batch.column(2).cast(pa.binary())
        for i in range(batch.num_rows):
            n, docs = held.setdefault((langs[i], sources[i]), (Counter(), Counter()))
            before, found = len(n), terms(texts[i].as_py())
            n.update(found)
            docs.update(set(found))
            entries += len(n) - before
            if entries > HELD:
                yield from passed_on()
                entries = 0
    yield from passed_on()


def term_rows(docs: DataFrame, least_docs: int, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """(lang, term, counts): one row per kept term with its nonzero counts by source, and one per language for the empty
    term with a zero for each of its sources."""
    texts = docs.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    )
    partial = texts.mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long")
    # One exchange serves both groupings; the parts were already added up per task.
    by_source = partial.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = F.sort_array(F.collect_list(F.struct("source", "n"))).alias("counts")
    rows = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), counts)
    return rows.where((F.col("docs") >= least_docs) | (F.col("term") == "")).select("lang", "term", "counts")


def _share(count: str, size: str) -> str:
    """1 + floor(10^9 (count + 1) / size) in wide arithmetic."""
    return f"1 + (cast({count} + 1 as decimal(20,0)) * {SCALE}) div cast({size} as decimal(20,0))"


def _f(p: str, q: str) -> str:
    """Two shares compared; at most 10^18, so 64 bits hold every step."""
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def _f_np(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _long_sum(value: Column) -> Column:
    """Sum of partial sums that are right modulo 2^64."""
    half, whole = (F.lit(str(x)).cast("decimal(38,0)") for x in (2**63, 2**64))
    return (F.pmod(F.sum(value.cast("decimal(38,0)")) + half, whole) - half).cast("long")


class Sums:
    """Sums by (language, pair of sources), kept as sorted arrays of pair codes."""

    def __init__(self) -> None:
        self.names: dict[str, int] = {}
        self._held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def codes(self, column: pa.Array) -> np.ndarray:
        """A number for each source name."""
        column = column.dictionary_encode()
        own = [self.names.setdefault(s, len(self.names)) for s in column.dictionary.to_pylist()]
        return np.array(own, np.int64)[column.indices.to_numpy(zero_copy_only=False)] if len(column) else np.empty(0, np.int64)

    def add(self, lang: str, pairs: np.ndarray, values: np.ndarray) -> None:
        if lang in self._held:
            pairs, values = (np.concatenate(x) for x in zip(self._held[lang], (pairs, values)))
        known, place = np.unique(pairs, return_inverse=True)
        total = np.zeros(len(known), np.int64)
        np.add.at(total, place, values)
        self._held[lang] = known, total

    def __len__(self) -> int:
        return sum(len(k) for k, _ in self._held.values())

    def passed_on(self) -> Iterator[pa.RecordBatch]:
        names = pa.array(list(self.names), pa.string())
        for lang, (pairs, total) in self._held.items():
            sides = [names.take(pa.array(side)) for side in (pairs >> 32, pairs & 0xFFFFFFFF)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(pairs), pa.string()), *sides, pa.array(total)], names=["lang", "source", "item", "value"])
        self._held, self.names = {}, {}


def tree_corrections(starts: np.ndarray, source: np.ndarray, n: np.ndarray, p: np.ndarray, p0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pair codes and corrections of one tree over term rows, given as starts into flat arrays of ordered entries.

    The tree is grown level by level: rows at the same node that go on with the same (source, count) move to the same
    child. Then every node meets its ancestors once, whatever the number of rows that pass through both.
    """
    _, first, item = np.unique(np.stack([source, n]), axis=1, return_index=True, return_inverse=True)
    item = item.reshape(-1)
    lengths = np.diff(starts)
    at_row, state = np.arange(len(lengths)), np.zeros(len(lengths), np.int64)
    levels: list[tuple[np.ndarray, np.ndarray]] = []  # item and parent of the nodes of a level
    pairs, values = [], []
    for depth in range(int(lengths.max(initial=0))):
        going = lengths[at_row] > depth
        at_row, state = at_row[going], state[going]
        step = state * len(first) + item[starts[at_row] + depth]
        node, state, rows = np.unique(step, return_inverse=True, return_counts=True)
        parent, own = np.divmod(node, len(first))
        here = first[own]
        above = parent
        for items, parents in reversed(levels):
            there = first[items[above]]
            px, p0x, py, p0y = p[here], p0[here], p[there], p0[there]
            low, high = source[there], source[here]
            pairs += [high << 32 | low, low << 32 | high]
            values += [
                rows * (_f_np(px, py) - _f_np(px, p0y) - _f_np(p0x, py) + _f_np(p0x, p0y)),
                rows * (_f_np(py, px) - _f_np(py, p0x) - _f_np(p0y, px) + _f_np(p0y, p0x)),
            ]
            above = parents[above]
        levels.append((own, parent))
        if sum(map(len, pairs)) > BLOCK:
            pairs, values = ([x] for x in _added_up(pairs, values))
    return _added_up(pairs, values)


def _added_up(pairs: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not pairs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    known, place = np.unique(np.concatenate(pairs), return_inverse=True)
    total = np.zeros(len(known), np.int64)
    np.add.at(total, place, np.concatenate(values))
    return known, total


def _correct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, item, value): corrections of term rows, added up per task."""
    sums = Sums()

    def grow(rows: pa.Table) -> None:
        langs = rows.column("lang").combine_chunks().dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            counts = rows.filter(pc.equal(langs.indices, k)).column("counts").combine_chunks()
            starts = counts.offsets.to_numpy().astype(np.int64)
            entries = counts.flatten()
            n, p, p0 = (entries.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "p", "p0"))
            sums.add(lang, *tree_corrections(starts - starts[0], sums.codes(entries.field("source")), n, p, p0))

    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            held.append(batch.slice(at, 1024))
            size += len(held[-1].column(1).flatten())
            if size > BLOCK:
                grow(pa.Table.from_batches(held))
                held, size = [], 0
                if len(sums) > PAIRS:
                    yield from sums.passed_on()
    if held:
        grow(pa.Table.from_batches(held))
    yield from sums.passed_on()


def audit(
    docs: DataFrame,
    least_docs: int = 3,
    top: int = 200,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair``: every other source of the language as item, with the divergence of ``source`` from it, all ranks (0
    where the language keeps no term). Part ``term``: the ``top`` terms that the source uses and gives a larger share than
    its language does, by the same measure. Ranks start at 1 in each source and part; ties go by the item's bytes.

    Null text, language and source count as empty strings, repeated rows count each, further columns are ignored, an empty
    table gives no rows, and a source without terms takes part in all pairs. The result has a row per pair of sources of a
    language by its definition; beyond it no step forms pairs of rows, and nothing is brought to the driver.
    """
    rows = saved(term_rows(docs, least_docs, lang_col, source_col, text_col))
    kept = rows.where(F.col("term") != "")
    found = rows.where(F.col("term") == "").select("lang", F.inline("counts")).select("lang", "source")
    used = kept.select("lang", F.inline("counts"))
    vocabulary = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    # One row per language: its own size, and the size of each source by name (as many as the language has sources).
    by_source = (
        found.join(used.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
        .join(vocabulary, "lang", "left")
        .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"))
    )
    sizes = saved(by_source.withColumn("size", F.col("total") + F.col("v")).withColumn("p0", F.expr(f"if(v > 0, {_share('0', 'size')}, 1)")))
    of_lang = sizes.groupBy("lang").agg(
        (F.sum("total") + F.max("v")).alias("lang_size"),
        F.map_from_entries(F.collect_list(F.struct("source", F.struct("size", "p0")))).alias("sizes"),
    )
    entry = f"named_struct('source', e.source, 'n', e.n, 'p', {_share('e.n', 'sizes[e.source].size')}, 'p0', sizes[e.source].p0)"
    shared = with_summary(kept, of_lang.withColumnRenamed("lang", "_lang"), "lang", "_lang")
    marked = shared.select(
        "lang", "term", F.expr(f"transform(counts, e -> {entry})").alias("counts"),
        F.expr(_share("aggregate(counts, 0L, (total, e) -> total + e.n)", "lang_size")).alias("q"),
    )

    corrections = marked.where(F.size("counts") > 1).select("lang", "counts").mapInArrow(
        _correct, "lang string, source string, item string, value long"
    )
    # Counts of counts: how many terms of a source occur n times in it.
    alike = used.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m")).join(sizes, ["lang", "source"])
    alike = alike.withColumn("p", F.expr(_share("n", "size")))
    other = sizes.select(F.col("lang").alias("_lang"), F.col("source").alias("item"), F.col("p0").alias("q0"))
    opposite = (F.col("lang") == F.col("_lang")) & (F.xxhash64("lang") == F.xxhash64("_lang")) & (F.col("source") != F.col("item"))
    singles = alike.join(other, opposite).groupBy("lang", "source", "item").agg(
        _long_sum(F.expr(f"m * ({_f('p', 'q0')} - {_f('p0', 'q0')})")).alias("there"),
        _long_sum(F.expr(f"m * ({_f('q0', 'p')} - {_f('q0', 'p0')})")).alias("back"),
    )
    base = sizes.join(other, opposite).select("lang", "source", "item", F.expr(f"if(v > 0, v * {_f('p0', 'q0')}, 0L)").alias("value"))
    pairs = (
        base.unionByName(corrections)
        .unionByName(singles.select("lang", "source", "item", F.col("there").alias("value")))
        .unionByName(singles.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))
        .groupBy("lang", "source", "item")
        .agg(_long_sum(F.col("value")).alias("value"))
    )
    raised = marked.select("lang", F.col("term").alias("item"), "q", F.inline("counts")).where((F.col("n") > 0) & (F.col("p") > F.col("q")))
    raised = raised.select("lang", "source", "item", F.expr(_f("p", "q")).alias("value"))

    def ranked(part: str, found: DataFrame) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return found.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit(part))

    # Spark cuts each task's rows of a source to the top ones before they are exchanged.
    both = ranked("pair", pairs).unionByName(ranked("term", raised).where(F.col("rank") <= top))
    return both.select("lang", "source", "part", "item", "value", "rank")
