"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of each text: it adds a fixed value per byte and shifts, so it depends on the last
``REACH`` bytes only. Where its upper bits are zero a chunk may end, so chunk borders move with the text and an
insertion changes the chunks around it only. Chunks are compared by digest; the first holder (smallest id, then
smallest place) keeps a chunk, and a run of repeated chunks of at least ``min_run`` bytes counts as a repeated passage.

Chunks at both ends of a passage are cut by what stands around it, so short passages may hold too few whole ones. With
``sure``, windows of ``min_run`` bytes are compared too: of every ``AMONG`` neighbouring ones that with the least hash is
taken (winnowing), so a passage of ``min_run + AMONG - 1`` bytes has at least one that every copy of it takes as well.
Where ``WORDS`` words are shorter than that, every stretch of so many words is compared. Whole texts are compared at any
length.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType, BinaryType, IntegerType, LongType

#: Bytes that the gear hash looks back on.
REACH = 16
SHORTEST = 24
LONGEST = 512
#: A place is a border with a chance of 1 in this.
ONE_IN = 32
MIN_RUN = 128
#: Neighbouring windows of which one is taken.
AMONG = 128
#: Windows that are hashed together, so that what a very long text needs stays bounded; places in them have 20 bits.
AT_ONCE = 1 << 18
#: A passage of so many words is to be found however short they are.
WORDS = 51
#: Kinds of pieces.
CHUNK, WINDOW, PHRASE, WHOLE = 0, 1, 2, 3


def gear_values() -> np.ndarray:
    """A fixed pseudo-random 16-bit value for every byte."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(40)).astype(np.uint16)


def borders(text: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a text given as bytes."""
    n = len(text)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    # The hash of 16 bytes from two of 8, of four of 4 ...: each step doubles the reach.
    h, reach = gear[text], 1
    while reach < REACH:
        h[reach:] += h[:-reach] << np.uint16(reach)
        reach *= 2
    places = np.flatnonzero(h < 65536 // ONE_IN) + 1
    ends, at, i = [], 0, 0
    places = places.tolist()
    while n - at > SHORTEST:
        while i < len(places) and places[i] < at + SHORTEST:
            i += 1
        at = min(n, at + LONGEST, places[i] if i < len(places) else n)
        ends.append(at)
    if not ends or ends[-1] < n:
        ends.append(n)
    return np.array(ends, dtype=np.int64)


@functools.cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, those of its inverse, and a fixed pseudo-random value for every byte."""
    base = 0x9E3779B97F4A7C15
    up, down = np.full((2, n), 1, dtype=np.uint64)
    up[1:], down[1:] = base, pow(base, -1, 1 << 64)
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
    return np.cumprod(up), np.cumprod(down), x ^ x >> np.uint64(29)


def least_windows(text: np.ndarray, length: int, among: int) -> list[int]:
    """Starts of windows of ``length`` bytes: of every ``among`` neighbouring ones (of all, if there are fewer) one that
    has the least hash. Where several have, the one taken before stays."""
    n, taken = len(text) - length + 1, set()
    up, down, value = powers(AT_ONCE + among + length)
    for begin in range(0, max(1, n - among + 1) if n > 0 else 0, AT_ONCE):
        part = text[begin : begin + AT_ONCE + among + length - 2]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(value[part] * up[: len(part)], out=sums[1:])
        h = (sums[length:] - sums[:-length]) * down[: len(part) - length + 1]
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        # The place in the lower bits: of equal hashes the last is the least.
        key = (h >> np.uint64(20) << np.uint64(20)) | (np.uint64(0xFFFFF) - np.arange(len(h), dtype=np.uint64))
        width, reach = min(among, len(h)), 1
        while reach * 2 <= width:
            key = np.minimum(key[:-reach], key[reach:])
            reach *= 2
        if reach < width:
            key = np.minimum(key[: reach - width], key[width - reach :])
        place = (np.uint64(0xFFFFF) - (key & np.uint64(0xFFFFF))).astype(np.int64)
        change = np.flatnonzero(place[1:] != place[:-1])
        first = np.concatenate([[0], change + 1])
        last, hashes, now = [*change.tolist(), len(place) - 1], (key[first] >> np.uint64(20)).tolist(), None
        for p, until, hashed in zip(place[first].tolist(), last, hashes):
            if now is None or hashed != now[1] or until > now[0]:
                now = (p, hashed)
                taken.add(begin + p)
    return sorted(taken)


def short_phrases(text: np.ndarray, below: int) -> tuple[list[int], list[int]]:
    """Starts and ends of all stretches of ``WORDS`` words between ASCII blanks that have less than ``below`` bytes."""
    edge = np.diff((text > 32).astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    starts, ends = starts[: max(0, len(starts) - WORDS + 1)], ends[WORDS - 1 :]
    short = ends - starts < below
    return starts[short].tolist(), ends[short].tolist()


def chunk(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 0) -> DataFrame:
    """_id, digest (16 bytes), at (place of the chunk in its text), size and kind; empty and null texts have no chunk.
    With ``window``, windows of so many bytes, phrases too short for them and the whole text as well."""
    schema = StructType([
        StructField("_id", docs.schema[id_col].dataType), StructField("digest", BinaryType()),
        StructField("at", LongType()), StructField("size", IntegerType()), StructField("kind", IntegerType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear = gear_values()
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                texts = part.column(1).cast(pa.binary()).to_pylist()
                owner, digests, starts, sizes, kinds = [], [], [], [], []

                def add(k: int, kind: int, begins: list[int], ends: list[int]) -> None:
                    # The kind goes into the digest: a whole text is compared with whole texts only.
                    person = bytes([kind])
                    owner.extend([k] * len(ends))
                    starts.extend(begins)
                    sizes.extend(e - b for b, e in zip(begins, ends))
                    kinds.extend([kind] * len(ends))
                    digests.extend(hashlib.blake2b(texts[k][b:e], digest_size=16, person=person).digest() for b, e in zip(begins, ends))

                for k, text in enumerate(texts):
                    if not text:
                        continue
                    data = np.frombuffer(text, np.uint8)
                    ends = borders(data, gear).tolist()
                    add(k, CHUNK, [0, *ends[:-1]], ends)
                    if window:
                        begins = least_windows(data, window, AMONG)
                        add(k, WINDOW, begins, [b + window for b in begins])
                        add(k, PHRASE, *short_phrases(data, window + AMONG - 1))
                        add(k, WHOLE, [0], [len(text)])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(owner, pa.int64())), pa.array(digests, pa.binary()), pa.array(starts, pa.int64()),
                        pa.array(sizes, pa.int32()), pa.array(kinds, pa.int32()),
                    ],
                    names=schema.names,
                )

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def passages(pieces: list[dict], min_run: int) -> list[tuple[int, int]]:
    """Repeated passages of a text from its repeated pieces: runs of chunks, windows, phrases and whole texts, joined
    where they overlap or meet. Of the chunks, runs of ``min_run`` bytes count."""
    runs: list[tuple[int, int]] = []
    for x in sorted((x["start"], x["end"]) for x in pieces if x["kind"] == CHUNK):
        if runs and runs[-1][1] == x[0]:
            runs[-1] = (runs[-1][0], x[1])
        else:
            runs.append(x)
    out: list[tuple[int, int]] = []
    for start, end in sorted([*(x for x in runs if x[1] - x[0] >= min_run), *((x["start"], x["end"]) for x in pieces if x["kind"] != CHUNK)]):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def repeats(docs: DataFrame, min_run: int = MIN_RUN, id_col: str = "doc_id", text_col: str = "text", sure: bool = False) -> DataFrame:
    """Repeated passages: id, start, end (bytes, end exclusive). Chunks of rows that share an id count as one text's;
    rows without an id are left alone."""
    pieces = chunk(docs.where(F.col(id_col).isNotNull()), id_col, text_col, min_run if sure else 0)
    first = pieces.groupBy("digest").agg(
        F.min(F.struct("_id", "at")).alias("_first"), F.count(F.lit(1)).alias("_n")
    ).where(F.col("_n") > 1)
    first = first.select(F.col("digest").alias("_digest"), F.col("_first._id").alias("_keeper"), F.col("_first.at").alias("_place"))
    # The second equality keeps the join from reusing the grouping's layout, so that AQE can split a hot chunk.
    same = (F.col("digest") == F.col("_digest")) & (F.xxhash64("digest") == F.xxhash64("_digest"))
    extra = pieces.join(first, same).where((F.col("_id") != F.col("_keeper")) | (F.col("at") != F.col("_place")))
    found = extra.groupBy("_id").agg(
        F.collect_set(F.struct(F.col("at").alias("start"), (F.col("at") + F.col("size")).alias("end"), "kind")).alias("_c")
    )
    schema = StructType([
        StructField(id_col, docs.schema[id_col].dataType),
        StructField("spans", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))),
    ])
    spans = to_arrow_schema(schema).field(1).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                joined = [[{"start": a, "end": b} for a, b in passages(c, min_run)] for c in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(joined, spans)], names=schema.names)

    return found.mapInArrow(run, schema).where(F.size("spans") > 0)


def dedup(docs: DataFrame, min_run: int = MIN_RUN, id_col: str = "doc_id", text_col: str = "text", sure: bool = False) -> DataFrame:
    """One row per id: n_bytes, n_removed, n_spans, repeated (whether anything is removed) and the removed spans. Rows
    that share an id are added up; a null id is an id of its own, from which nothing is removed. No text is shuffled."""
    spans = repeats(docs, min_run, id_col, text_col, sure)
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")
    both = docs.select(F.col(id_col).alias("_id"), size.alias("_size"), F.lit(None).cast(spans.schema["spans"].dataType).alias("_spans"))
    both = both.unionByName(spans.select(F.col(id_col).alias("_id"), F.lit(0).cast("long").alias("_size"), F.col("spans").alias("_spans")))
    found = both.groupBy("_id").agg(F.sum("_size").alias("n_bytes"), F.first("_spans", ignorenulls=True).alias("_spans"))
    spans = F.coalesce("_spans", F.array().cast(spans.schema["spans"].dataType))
    removed = F.aggregate(spans, F.lit(0).cast("long"), lambda acc, r: acc + r["end"] - r["start"])
    return found.select(
        F.col("_id").alias(id_col), "n_bytes", removed.alias("n_removed"), F.size(spans).cast("long").alias("n_spans"),
        (F.size(spans) > 0).alias("repeated"), spans.alias("spans"),
    )
