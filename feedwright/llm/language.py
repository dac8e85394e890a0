"""Language identification with word-first backoff.

A word known from training is scored by its log frequency in each language. An unseen word falls back to its longest
character n-grams of which any is known, from ``ORDERS[0]`` characters down to one. A text's languages are compared by
the mean over its words.

The model is fitted on a bounded sample of labelled documents (about ``per_lang`` of each language). It keeps at most
``top_words`` words of each language, and of the n-grams of these words at most ``top_grams`` of each length, so what is
sent to the tasks has a fixed bound. Counting runs in Spark.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from feedwright.llm.text import drawn, per_document

UNKNOWN = "und"
ORDERS = (5, 4, 3, 2, 1)
#: Words that a task keeps with their scores beside the model's own; beyond it the store starts anew.
CACHE = 200_000
#: Words whose evidence adds up; the certainty of a longer text is that of so many words like its own.
FULL = 30
_WORD = re.compile(r"[^\W\d_]+")


def text_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its two ends marked; a short word is one gram."""
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(max(1, len(marked) - n + 1))]


def fit(
    docs: DataFrame,
    per_lang: int = 1000,
    top_words: int = 20_000,
    top_grams: int = 5_000,
    text_col: str = "text",
    lang_col: str = "lang",
    train: Column | None = None,
    seed_col: str = "doc_id",
) -> list[tuple[str, int, str, int]]:
    """Rows (language, order, gram, count) of the model; order 0 are whole words. Rows without text or language, and
    those outside ``train``, are not learned from. The sample is ``per_lang`` documents of each language, those with the
    least hashes of ``seed_col`` and text."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = (rows if train is None else rows.where(train)).select(
        F.col(seed_col).alias("_seed"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    )
    sample = drawn(rows, per_lang, (F.col("_seed").cast("string"), F.col("text")), "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.setdefault(lang, Counter()).update(text_words(text))
            yield from _counted({(lang, 0, w): n for lang, c in seen.items() for w, n in c.items()})

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for order in ORDERS:
                    for gram in grams(word, order):
                        seen[lang, order, gram] += n
            yield from _counted(seen)

    def top(counts: DataFrame, most: int) -> DataFrame:
        # The sample is bounded, and so is each of these groups.
        place = F.row_number().over(Window.partitionBy("lang", "order").orderBy(F.desc("n"), "gram"))
        return counts.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")

    def summed(counts: DataFrame) -> DataFrame:
        return counts.groupBy("lang", "order", "gram").agg(F.sum("n").alias("n"))

    kept = top(summed(sample.select("lang", "text").mapInArrow(count, _COUNTS)), top_words)
    spelt = top(summed(kept.select("lang", "gram", "n").mapInArrow(divide, _COUNTS)), top_grams)
    return [(r["lang"], r["order"], r["gram"], r["n"]) for r in kept.unionByName(spelt).collect()]


_COUNTS = "lang string, order int, gram string, n long"


def _counted(seen: dict[tuple[str, int, str], int]) -> Iterator[pa.RecordBatch]:
    if seen:
        columns = [*zip(*seen), tuple(seen.values())]
        types = (pa.string(), pa.int32(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["lang", "order", "gram", "n"])


class Model:
    """Scores of words and n-grams by language, from the rows of ``fit``."""

    def __init__(self, rows: list[tuple[str, int, str, int]]) -> None:
        self.langs = sorted({r[0] for r in rows})
        self._levels = {order: self._level([r for r in rows if r[1] == order]) for order in (0, *ORDERS)}
        known, scores = self._levels[0]
        self._known = len(known)
        self._scores = np.zeros((self._known + CACHE, max(1, len(self.langs))))
        self._scores[: self._known] = scores
        self._row = dict(known)
        self._words = known

    def _level(self, rows) -> tuple[dict[str, int], np.ndarray]:
        place = {lang: i for i, lang in enumerate(self.langs)}
        known = {g: i for i, g in enumerate(sorted({r[2] for r in rows}))}
        counts = np.zeros((len(known), max(1, len(self.langs))))
        for lang, _, gram, n in rows:
            counts[known[gram], place[lang]] = n
        return known, np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * max(1, len(known))))

    def _unseen(self, word: str) -> np.ndarray:
        for order in ORDERS:
            known, scores = self._levels[order]
            rows = [known[g] for g in grams(word, order) if g in known]
            if rows:
                return scores[rows].mean(axis=0)
        return np.zeros(max(1, len(self.langs)))

    def judge(self, text: str) -> tuple[str, float]:
        """The likeliest language and how likely it is among the learned ones; of equals the first by name. Texts without
        a letter are ``UNKNOWN`` with score 0, as all are if nothing was learned."""
        found = text_words(text)
        if not self.langs or not any(map(str.isalpha, found)) and not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        if len(self._row) + len(found) > len(self._scores):
            self._row = dict(self._words)
            if len(self._row) + len(found) > len(self._scores):  # one text with more words than the store takes
                return self._best(np.mean([self._unseen(w) if w not in self._words else self._scores[self._words[w]] for w in found], axis=0), len(found))
        get = self._row.get
        rows = [get(w, -1) for w in found]
        for i, r in enumerate(rows):
            if r < 0:
                w = found[i]
                r = get(w, -1)
                if r < 0:
                    r = self._row[w] = len(self._row)
                    self._scores[r] = self._unseen(w)
                rows[i] = r
        return self._best(self._scores[rows].mean(axis=0) if rows else np.zeros(len(self.langs)), len(found))

    def _best(self, mean: np.ndarray, n: int) -> tuple[str, float]:
        weight = np.exp((mean - mean.max()) * min(max(n, 1), FULL))
        best = int(np.argmax(mean))
        return self.langs[best], float(min(1.0, weight[best] / math.fsum(weight)))


def identify(
    docs: DataFrame, rows: list[tuple[str, int, str, int]], id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()
) -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score. Null, empty and letterless texts get ``und`` with score 0;
    repeated rows are judged each."""
    shared = docs.sparkSession.sparkContext.broadcast({"rows": rows})

    def setup():
        # A Python worker keeps the value of a broadcast from task to task: the rows until the first one, then the model.
        known = shared.value
        if "model" not in known:
            known["model"] = Model(known.pop("rows"))
        model = known["model"]
        return lambda text: model.judge(text.decode("utf-8", "replace"))

    fields = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    return per_document(docs, fields, setup, id_col, text_col, also)
