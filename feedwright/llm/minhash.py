"""Near-duplicate documents by MinHash.

Texts become sets of word-shingle hashes; texts with the same set are one class. For each class a signature holds the
minima of ``HASHES`` universal hash functions; ``BANDS`` bands of it are bucket keys. Candidates are verified by their
signatures and then on the full sets; links are joined to components by alternating large-star and small-star.

A bucket may hold a third of all classes, so its pairs are never written out. First every member is compared with the
smallest of its bucket. Buckets whose members then are of different components are divided into bounded blocks, and each
pair of blocks is one group, which holds the signatures and the full sets of its members: it tries every pair of different
components and returns only the links that join two of them. So no link is lost that would change a component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedwright.llm.components import components, saved, with_summary
from feedwright.llm.shingles import WordHasher

WIDTH = 5
THRESHOLD = 80
HASHES = 128
BANDS = 32
#: Classes of a bucket that make a block, and shingles that they have together at most (unless one has more).
TILE = 1000
TILE_SHINGLES = 1_500_000
#: Ids of candidates that may be sent to every task (eight bytes each); beyond it they are joined by shuffle.
SEND = 1_000_000
#: A signature agrees with similarity s in about s of its places; candidates this far below the threshold (more than
#: six standard deviations at 0.8, where a link is lost with a chance of 3e-11) are dropped.
SLACK = 0.25


def hash_functions() -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of the universal hash functions x -> upper half of (a x + b)."""
    drawn = np.random.default_rng(20240607).integers(0, 1 << 63, size=(2, HASHES), dtype=np.uint64)
    return (drawn[0] << np.uint64(1)) | np.uint64(1), drawn[1]


def signature(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for at in range(0, len(values), 2048):
        part = values[at : at + 2048]
        np.minimum(least, (a[:, None] * part[None, :] + b[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row of signatures."""
    rows = HASHES // BANDS
    parts = sig.reshape(len(sig), BANDS, rows).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + np.zeros((len(sig), 1), np.uint64)
    for k in range(rows):
        key = (key ^ parts[:, :, k]) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _sets(docs: DataFrame, width: int, make, schema: str) -> DataFrame:
    """``make(ids, sets)`` as a batch, for the documents (_id, _text) in small slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(width)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [(t or b"").lower() for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield make(part.column(0), hasher.sets(texts))

    return docs.mapInArrow(run, schema)


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """_id, n, digest of the set, sig and bands, of documents (_id, _text)."""

    def make(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        a, b = hash_functions()
        sig = np.array([signature(s, a, b) for s in sets])
        keys = band_keys(sig)
        return pa.RecordBatch.from_arrays(
            [
                ids, pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.array([s.tobytes() for s in sig], pa.binary()),
                pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), keys.ravel()),
            ],
            names=["_id", "n", "digest", "sig", "bands"],
        )

    return _sets(docs, width, make, "_id long, n long, digest binary, sig binary, bands array<long>")


def _sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(_id, s): the full sets of the documents whose id is in ``ids`` (_c)."""
    few = ids.count() <= SEND
    wanted = docs.join(F.broadcast(ids) if few else ids, F.col("_id") == F.col("_c"), "left_semi")

    def make(own: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        values = np.concatenate(sets).view(np.int64)
        return pa.RecordBatch.from_arrays([own, pa.ListArray.from_arrays(ends, values)], names=["_id", "s"])

    return _sets(wanted, width, make, "_id long, s array<long>")


def _linked(docs: DataFrame, pairs: DataFrame, width: int, threshold: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    ids = saved(pairs.select(F.explode(F.array("a", "b")).alias("_c")).distinct())
    sets = saved(_sets_of(docs, ids, width))
    left, right = sets.toDF("_a", "sa"), sets.toDF("_b", "sb")
    both = with_summary(with_summary(pairs, left, "a", "_a"), right, "b", "_b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common * 100 >= (F.size("sa") + F.size("sb") - common) * threshold).select("a", "b").distinct()


def _agreeing(pairs: DataFrame, sigs: DataFrame, least: int) -> DataFrame:
    """Those of the pairs (a, b) whose signatures agree in at least ``least`` places."""
    left, right = sigs.toDF("_a", "ga"), sigs.toDF("_b", "gb")
    both = with_summary(with_summary(pairs, left, "a", "_a"), right, "b", "_b").select("a", "b", "ga", "gb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ga, gb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, HASHES) for i in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((ga == gb).sum(axis=1) >= least))

    return both.mapInArrow(run, "a long, b long")


def _tiles(members: DataFrame, least: int, threshold: int) -> DataFrame:
    """Links (a, b) that join different components within a bucket. ``members`` has band, parts (blocks of the bucket),
    _id, comp, sig and the full set s."""
    rows = members.withColumn("own", F.pmod(F.xxhash64("_id"), F.col("parts")).cast("int"))
    # A block meets itself and every other block of its bucket once.
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "_id", "comp", "sig", "s")

    def compare(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        own, ids, comp = (table.column(c).to_numpy() for c in ("own", "_id", "comp"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
        sets = table.column("s").combine_chunks()
        ends = np.asarray(sets.offsets)
        begins, size = ends[:-1] - ends[0], np.diff(ends)
        # Numbers instead of hashes, so that a set can be marked in a table.
        _, number = np.unique(sets.values.to_numpy()[ends[0] : ends[-1]], return_inverse=True)
        mark = np.zeros(int(number.max()) + 1, dtype=np.int32)
        _, group = np.unique(comp, return_inverse=True)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        found: list[tuple[int, int]] = []
        for x in left.tolist():
            y = right if i != j else right[right > x]
            y = y[group[y] != group[x]]
            y = y[(sig[y] == sig[x]).sum(axis=1) >= least] if len(y) else y
            mark[number[begins[x] : begins[x] + size[x]]] = 1
            for at in range(0, len(y), 200):
                part = y[at : at + 200]
                n = size[part]
                first = np.cumsum(n) - n
                places = np.repeat(begins[part] - first, n) + np.arange(n.sum())
                common = np.add.reduceat(mark[number[places]], first)
                for k in part[100 * common >= threshold * (size[x] + n - common)].tolist():
                    if group[k] != group[x]:
                        found.append((min(int(ids[x]), int(ids[k])), max(int(ids[x]), int(ids[k]))))
                        group[group == group[k]] = group[x]
            mark[number[begins[x] : begins[x] + size[x]]] = 0
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*found) if found else ((), ()))], names=["a", "b"])

    return rows.groupBy("band", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id reachable by links), kept (whether it is
    this id). Words stand between ASCII blanks, A-Z in lower case; sets are linked from ``threshold`` hundredths of
    Jaccard similarity on.

    Null, empty and blank texts have no shingles and are linked with nothing. Rows that share an id are one node; rows
    without an id are linked with nothing and kept, without a component.
    """
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    known = saved(sketches(own, width))
    full = known.where((F.col("n") > 0) & F.col("_id").isNotNull())
    classes = saved(full.groupBy("digest").agg(F.min("_id").alias("rep")))
    reps = full.join(classes.select("rep", F.col("digest").alias("_d")), (F.col("digest") == F.col("_d")) & (F.col("_id") == F.col("rep")))
    reps = saved(reps.select("_id", "n", "sig", "bands").dropDuplicates(["_id"]))
    placed = reps.select("_id", F.explode("bands").alias("band"))
    shared = placed.groupBy("band").agg(F.min("_id").alias("center"), F.max("_id").alias("last")).where(F.col("center") < F.col("last"))
    members = saved(with_summary(placed, shared.withColumnRenamed("band", "_band"), "band", "_band").select("band", "_id", "center"))

    sigs = reps.select("_id", "sig")
    least = int(HASHES * (threshold / 100 - SLACK))
    stars = members.where(F.col("_id") != F.col("center")).select(F.col("center").alias("a"), F.col("_id").alias("b")).distinct()
    links = saved(_linked(own, saved(_agreeing(stars, sigs, least)), width, threshold))
    joined = components(links)

    comp = F.coalesce("component", "_id").alias("comp")
    placed = members.select("band", "_id").join(reps.select(F.col("_id").alias("_r"), "n"), F.col("_id") == F.col("_r"))
    placed = saved(placed.join(joined, F.col("_id") == F.col("node"), "left").select("band", "_id", "n", comp))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int")
    open_ = placed.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size"), blocks.alias("parts"))
    # Of a bucket of two, the pair has been tried.
    open_ = open_.where((F.col("lo") != F.col("hi")) & (F.col("size") > 2)).select(F.col("band").alias("_band"), "parts")
    rows = saved(with_summary(placed, open_, "band", "_band").select("band", "parts", "_id", "comp"))
    sets = _sets_of(own, saved(rows.select(F.col("_id").alias("_c")).distinct()), width)
    full_sets = sigs.join(sets.withColumnRenamed("_id", "_s"), F.col("_id") == F.col("_s")).drop("_id")
    more = saved(_tiles(with_summary(rows, full_sets, "_id", "_s"), least, threshold))
    joined = components(links.unionByName(more))

    found = classes.join(joined, F.col("rep") == F.col("node"), "left").select(F.col("digest").alias("_d"), F.coalesce("component", "rep").alias("comp"))
    linked = with_summary(full.select("_id", "n", "digest"), found, "digest", "_d").select("_id", "n", "comp")
    alone = known.where((F.col("n") == 0) | F.col("_id").isNull()).select("_id", "n", F.col("_id").alias("comp"))
    rows = linked.unionByName(alone)
    # The classes of one node may differ where an id has several texts: they are one component by that node.
    return rows.select(
        F.col("_id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"),
        F.col("comp").alias("component_id"), F.coalesce(F.col("_id") == F.col("comp"), F.lit(True)).alias("kept"),
    )
