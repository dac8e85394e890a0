"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Words are tagged toxic or not. A word's evidence is the sum of the weights of its features (the word, its first letters);
neighbouring tags depend on each other. Forward and backward sums give the probability of each tag, exactly and for whole
texts: the words stand in blocks, all blocks are advanced together, and a short loop links the blocks of each text.

Labels exist for documents only. The words of toxic training documents that are labelled toxic are those with a feature
found far more often in toxic than in other training documents. A logistic fit turns what the tagger finds in a document
into its score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from feedwright.llm.components import saved
from feedwright.llm.text import drawn, per_document, words

PREFIXES = (4, 5, 6)
BLOCK = 64
#: Words that a task keeps with their evidence; beyond it the store starts anew.
CACHE = 400_000


def features(word: bytes) -> list[bytes]:
    return [b"=" + word, *(b"%d" % n + word[:n] for n in PREFIXES if len(word) >= n)]


def chain(evidence: np.ndarray, lengths: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """Probability that each word is toxic, for texts of ``lengths`` words one after the other.

    ``evidence`` is the log odds of each word by itself, ``moves`` the log weights of tag after tag. With ``pairs`` also
    the expected number of each move.
    """
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    if total == 0:
        return (np.zeros(0), np.zeros((2, 2))) if pairs else np.zeros(0)
    blocks = -(-lengths // BLOCK)
    first_block, first_word = np.cumsum(blocks) - blocks, np.cumsum(lengths) - lengths
    # Place of every word in a table of BLOCK rows and one column per block.
    text = np.repeat(np.arange(len(lengths)), lengths)
    inside = np.arange(total) - first_word[text]
    column, row = first_block[text] + inside // BLOCK, inside % BLOCK
    n = int(blocks.sum())
    here = np.zeros((BLOCK, n), dtype=bool)
    here[row, column] = True
    odds = np.ones((BLOCK, n))
    odds[row, column] = np.exp(np.clip(evidence, -30, 30))
    t = np.exp(moves)
    # Step matrices; beyond the end of a text they change nothing.
    a = [[np.where(here, t[i, j] * (odds if j else 1.0), float(i == j)) for j in (0, 1)] for i in (0, 1)]

    block = [[np.full(n, float(i == j)) for j in (0, 1)] for i in (0, 1)]
    for k in range(BLOCK):
        block = [[block[i][0] * a[0][j][k] + block[i][1] * a[1][j][k] for j in (0, 1)] for i in (0, 1)]
        size = block[0][0] + block[0][1] + block[1][0] + block[1][1]
        block = [[b / size for b in r] for r in block]
    p00, p01, p10, p11 = (block[i][j].tolist() for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)))
    fore, back = np.empty((2, n)), np.empty((2, n))
    for start, count in zip(first_block.tolist(), blocks.tolist()):
        x, y = 1.0, 0.0  # before a text nothing is toxic
        for b in range(start, start + count):
            fore[0, b], fore[1, b] = x, y
            x, y = x * p00[b] + y * p10[b], x * p01[b] + y * p11[b]
            x, y = x / (x + y), y / (x + y)
        x = y = 0.5
        for b in range(start + count - 1, start - 1, -1):
            back[0, b], back[1, b] = x, y
            x, y = p00[b] * x + p01[b] * y, p10[b] * x + p11[b] * y
            x, y = x / (x + y), y / (x + y)
    # Inside the blocks, all of them at once.
    behind = np.empty((BLOCK, 2, n))
    x, y = back
    for k in range(BLOCK - 1, -1, -1):
        behind[k] = x, y
        x, y = a[0][0][k] * x + a[0][1][k] * y, a[1][0][k] * x + a[1][1][k] * y
        x, y = x / (x + y), y / (x + y)
    toxic, moved = np.empty((BLOCK, n)), np.zeros((2, 2))
    x, y = fore
    for k in range(BLOCK):
        if pairs:
            both = [[(x, y)[i] * a[i][j][k] * behind[k, j] for j in (0, 1)] for i in (0, 1)]
            size = sum(map(sum, both))
            for i in (0, 1):
                for j in (0, 1):
                    moved[i, j] += float(np.sum((both[i][j] / size)[here[k]]))
        x, y = x * a[0][0][k] + y * a[1][0][k], x * a[0][1][k] + y * a[1][1][k]
        x, y = x / (x + y), y / (x + y)
        on, off = y * behind[k, 1], x * behind[k, 0]
        toxic[k] = on / (on + off)
    out = toxic[row, column]
    return (out, moved) if pairs else out


def doc_features(toxic: np.ndarray, lengths: Sequence[int]) -> np.ndarray:
    """What a document's score is made of: the sum of its marginals, their rate, and the largest."""
    ends = np.cumsum(lengths)
    out = np.zeros((len(lengths), 3))
    for i, (n, end) in enumerate(zip(lengths, ends)):
        if n:
            part = toxic[end - n : end]
            s = float(part.sum())
            out[i] = np.log1p(s), np.log1p(200 * s / n), float(part.max())
    return out


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 300) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (the last is the constant), and centre and scale of the columns."""
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - centre) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        w += 2.0 * (z.T @ (y - 1 / (1 + np.exp(-z @ w))) / len(y) - 0.001 * w)
    return w, centre, scale


@dataclass
class Model:
    weights: dict[bytes, float]
    bias: float
    moves: np.ndarray
    document: tuple[np.ndarray, np.ndarray, np.ndarray] | None

    def evidence(self, word: bytes) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features(word))

    def scores(self, toxic: np.ndarray, lengths: Sequence[int]) -> np.ndarray:
        if self.document is None:
            return np.zeros(len(lengths))
        w, centre, scale = self.document
        z = (doc_features(toxic, lengths) - centre) / scale
        return 1 / (1 + np.exp(-np.clip(z @ w[:-1] + w[-1], -30, 30)))


def train(texts: Sequence[list[bytes]], labels: Sequence[int], steps: int = 40) -> Model:
    """Fit on tokenised documents and their labels. Without documents of both kinds nothing is toxic."""
    y = np.asarray(labels, dtype=float)
    kinds = Counter(labels)
    if not kinds[0] or not kinds[1]:
        return Model({}, -10.0, np.zeros((2, 2)), None)
    seen = {0: Counter(), 1: Counter()}
    made = {w: features(w) for t in texts for w in t}
    for text, label in zip(texts, labels):
        seen[label].update({f for w in set(text) for f in made[w]})
    least = max(3, 0.02 * kinds[1])
    marked = {
        f for f, n in seen[1].items()
        if n >= least and (n + 0.5) / (kinds[1] + 1) >= 20 * (seen[0][f] + 0.5) / (kinds[0] + 1)
    }
    # Labelled words, and the features that may carry weight: all that occur in toxic documents often enough.
    used = sorted(f for f, n in seen[1].items() if n >= least)
    place = {f: i for i, f in enumerate(used)}
    vocabulary = {w: i for i, w in enumerate(sorted(made))}
    rows = [(i, place[f]) for w, i in vocabulary.items() for f in made[w] if f in place]
    at_word, at_feature = (np.array(c, dtype=np.int64) for c in (zip(*rows) if rows else ((), ())))
    bad = np.array([any(f in marked for f in made[w]) for w in vocabulary], dtype=bool)
    ids = np.array([vocabulary[w] for t in texts for w in t], dtype=np.int64)
    lengths = np.array([len(t) for t in texts])
    target = (bad[ids] & (np.repeat(y, lengths) > 0)).astype(float)
    starts = np.zeros(len(ids), dtype=bool)
    starts[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    before = np.concatenate([[0.0], target[:-1]]) if len(ids) else target
    before[starts] = 0
    wanted = np.array([[np.sum((before == i) & (target == j)) for j in (0, 1)] for i in (0, 1)], dtype=float)

    w, bias, moves = np.zeros(len(used)), -4.0, np.zeros((2, 2))
    squares, bias_square, move_squares = np.full(len(used), 1e-8), 1e-8, np.full((2, 2), 1e-8)
    scale = 1.0 / max(1, len(ids))
    for _ in range(steps):
        by_word = np.bincount(at_word, weights=w[at_feature], minlength=len(vocabulary)) + bias
        toxic, moved = chain(by_word[ids], lengths, moves, pairs=True)
        off = np.bincount(ids, weights=target - toxic, minlength=len(vocabulary))
        g = np.bincount(at_feature, weights=off[at_word], minlength=len(used)) * scale - 1e-7 * w
        gb, gm = off.sum() * scale, (wanted - moved) * scale
        squares += g * g
        bias_square += gb * gb
        move_squares += gm * gm
        w += 0.7 * g / np.sqrt(squares)
        bias += 0.3 * gb / np.sqrt(bias_square)
        moves += 0.1 * gm / np.sqrt(move_squares)
    model = Model({f: float(v) for f, v in zip(used, w) if abs(v) > 1e-6}, float(bias), moves, None)
    by_word = np.bincount(at_word, weights=w[at_feature], minlength=len(vocabulary)) + bias
    model.document = _logistic(doc_features(chain(by_word[ids], lengths, moves), lengths), y)
    return model


def fit(
    docs: DataFrame,
    labels: DataFrame,
    train_on: Column | None = None,
    toxic_docs: int = 800,
    other_docs: int = 1600,
    longest: int = 100_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """Fit on a bounded sample: ``toxic_docs`` and ``other_docs`` labelled ids, those of the least hashes, and at most as
    many documents of theirs, none of more than ``longest`` characters. A document labelled more than once is toxic if any label says so; rows
    without id or label are left out."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = (known if train_on is None else known.where(train_on)).groupBy(F.col(id_col).alias("_id")).agg(
        F.max(F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("_toxic")
    )
    most = {1: toxic_docs, 0: other_docs}
    picked = [drawn(known.where(F.col("_toxic") == k), n, (F.col("_id").cast("string"),)) for k, n in most.items()]
    # Bounded by toxic_docs + other_docs ids.
    found = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
        .where(F.length("_text") <= longest)
        .join(F.broadcast(picked[0].unionByName(picked[1])), "_id")
        .select("_text", "_toxic")
    )
    # An id may have any number of rows.
    rows = saved(found)
    kept = [drawn(rows.where(F.col("_toxic") == k), n, (F.col("_text"),)) for k, n in most.items()]
    rows = kept[0].unionByName(kept[1]).toPandas()
    rows = rows.sort_values(["_toxic", "_text"], kind="stable")
    return train([words(t.encode()) for t in rows["_text"]], [int(v) for v in rows["_toxic"]])


def score(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()
) -> DataFrame:
    """One row per row of ``docs``: id, score (0 to 1), spans of words more likely toxic than not (start and end in words,
    end exclusive). Null and empty texts get the score of a text in which nothing is found; repeated rows are scored
    each."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.moves, model.document))

    def setup():
        model = Model(*shared.value)
        known: dict[bytes, float] = {}

        def judge(texts: list[bytes]) -> list[tuple]:
            nonlocal known
            split = [words(t) for t in texts]
            if len(known) > CACHE:
                known = {}
            for w in set().union(*split).difference(known):
                known[w] = model.evidence(w)
            out: list[tuple] = []
            # Some hundred thousand words at a time; a text is never divided.
            at = 0
            while at < len(split):
                end, size = at, 0
                while end < len(split) and (end == at or size + len(split[end]) <= 200_000):
                    size += len(split[end])
                    end += 1
                part = split[at:end]
                lengths = [len(t) for t in part]
                evidence = np.fromiter((known[w] for t in part for w in t), dtype=float, count=size)
                toxic = chain(evidence, np.array(lengths), model.moves)
                on = np.diff(np.concatenate([[0], (toxic > 0.5).astype(np.int8), [0]]))
                ups, downs = np.flatnonzero(on == 1), np.flatnonzero(on == -1)
                ends = np.cumsum(lengths)
                for s, n, stop in zip(model.scores(toxic, lengths).tolist(), lengths, ends.tolist()):
                    start = stop - n
                    lo, hi = np.searchsorted(downs, start, "right"), np.searchsorted(ups, stop, "left")
                    found = [(max(int(u), start) - start, min(int(d), stop) - start) for u, d in zip(ups[lo:hi], downs[lo:hi])]
                    out.append((s, found))
                at = end
            return out

        return judge

    span = StructType([StructField("start", LongType()), StructField("end", LongType())])
    fields = [StructField("score", DoubleType()), StructField("spans", ArrayType(span))]
    return per_document(docs, fields, setup, id_col, text_col, also, together=True)
