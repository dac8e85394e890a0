"""Exact deduplication of byte strings of a least length across documents, by threshold-bounded interval expansion.

Two suffixes share their first L bytes if their place in the suffix order is not divided before length L. From a
Burrows-Wheeler transform these divisions are found breadth-first: the intervals of all strings of length l + 1 follow
from those of length l by one backward extension, so common prefixes appear by increasing value, and the expansion stops
at the least length. What is still undivided then starts with the same L bytes.

A transform has to fit into a task, so the corpus is divided such that equal strings meet. Every window of L bytes has an
anchor: the piece of ``ANCHOR`` bytes in it that has the smallest hash. Consecutive windows with one anchor form a stretch;
equal windows lie in stretches with equal anchors. The steps, all by bounded groups:

1. Documents are dealt to chunks; a chunk sends the distinct anchors it has to their buckets.
2. A bucket answers which anchors occur in more than one chunk. All others need no further look.
3. A chunk sends the distinct stretches of repeated anchors, each with its smallest document, to the buckets.
4. A bucket expands the intervals over its stretches and answers which windows also start in a smaller document. Equal
   stretches are one; one whose anchor has no other stretch has nothing to share and is left out of the transforms, which
   take whole anchors.
5. A chunk marks these windows and gives the removed runs of its documents.

Every chunk sends to every bucket, so a bucket is as large as a task can hold, and what has to fit into the cache is a
transform, not a bucket.

An anchor that occurs in a third of all documents adds one entry for each chunk and one stretch for each distinct
surrounding in it. If these are many, its stretches are cut into single windows that are dealt by their own bytes, so that
the bucket of a frequent anchor does not grow with the corpus. An anchor that is in every chunk, but always with the same
surrounding, is not cut: its windows would be many times its stretches.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedwright.llm import segments

LENGTH = 50
#: Long enough that few anchors recur by chance however large the corpus; a multiple of 8.
ANCHOR = 32
#: Bytes of text in a chunk and for each bucket.
CHUNK = 8_000_000
BUCKET = 16_000_000
#: Symbols of a transform, which should fit into the processor's cache; an anchor's stretches are not divided.
TRANSFORM = 64_000
#: From so many stretches on, each counted in every chunk that has it, an anchor's windows are dealt one by one.
FREQUENT = 16_384
#: Places that are worked on at once (the place is kept in 20 bits).
_STEP = 1 << 15
_PLACE = np.uint64((1 << 20) - 1)
_NONE = np.iinfo(np.int64).max
_ODD = np.uint64(0x9E3779B97F4A7C15)


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``ANCHOR`` bytes from each place on."""
    out = np.ndarray(len(data) - 7, np.uint64, np.ascontiguousarray(data), strides=(1,)).copy()
    width = 8
    while width < ANCHOR:  # of twice as many bytes from those of two neighbours
        pair = out[:-width] * _ODD
        pair += out[width:]
        out = pair ^ pair >> np.uint64(32)
        width *= 2
    out *= _ODD
    return out


def _hashes_at(data: bytes, places: np.ndarray) -> np.ndarray:
    """Hash of the ``ANCHOR`` bytes from each of the places on."""
    out = np.zeros(len(places), dtype=np.uint64)
    if len(places):
        parts = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), ANCHOR)[places].view(np.uint64)
        for k in range(parts.shape[1]):
            out = (out ^ parts[:, k]) * _ODD
            out ^= out >> np.uint64(32)
    return out


@dataclass
class Stretches:
    """Runs of windows with one anchor: key of the anchor, first window, number of windows, document of the chunk."""

    key: np.ndarray
    start: np.ndarray
    count: np.ndarray
    doc: np.ndarray


def stretches(data: np.ndarray, ends: np.ndarray, usable: np.ndarray, length: int) -> Stretches:
    """Of texts that stand one after the other in ``data`` and end at ``ends``; only those of ``usable`` texts."""
    found: list[tuple[np.ndarray, ...]] = []
    width = length - ANCHOR + 1
    sizes = np.diff(ends, prepend=0)
    # Windows that lie in no text or in one that is not usable: the last of each text, which would reach into the next.
    n = np.where(usable, np.minimum(sizes, length - 1), sizes)
    outside = np.zeros(len(data), dtype=bool)
    outside[np.repeat(ends - n, n) + _ramp(n)] = True
    for at in range(0, len(data) - length + 1, _STEP):
        stop = min(at + _STEP, len(data) - length + 1)  # windows at <= start < stop
        hashes = anchor_hashes(data[at : stop + length - 1])
        least = hashes & ~_PLACE
        least |= np.arange(len(hashes), dtype=np.uint64)
        done = 1
        while 2 * done <= width:
            least = np.minimum(least[:-done], least[done:])
            done *= 2
        if done < width:
            least = np.minimum(least[: len(least) - (width - done)], least[width - done :])
        out = outside[at:stop]
        new = np.empty(len(least), dtype=bool)
        new[0] = True
        np.not_equal(least[1:], least[:-1], out=new[1:])
        new[1:] |= out[1:] != out[:-1]
        first = np.flatnonzero(new)
        count = np.diff(first, append=len(least))
        inside = ~out[first]
        first = first[inside]
        found.append((hashes[(least[first] & _PLACE).astype(np.int64)], first + at, count[inside]))
    if not found:
        return Stretches(np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    key, start, count = (np.concatenate(c) for c in zip(*found))
    return Stretches(key, start, count, np.repeat(np.arange(len(ends)), np.diff(np.searchsorted(start, ends), prepend=0)))


def undivided(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For the texts one after the other, each followed by a separator: the suffix order by the first ``length`` symbols
    at least, and where in it a new class of suffixes with equal first ``length`` symbols begins."""
    symbols = np.zeros(sum(map(len, texts)) + len(texts), dtype=np.uint16)
    ends = np.cumsum([len(t) + 1 for t in texts])
    is_text = np.ones(len(symbols), dtype=bool)
    is_text[ends - 1] = False
    symbols[is_text] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + 1
    order = _suffix_order(symbols, length)
    # The transform, and for each place in the order that of the suffix one symbol shorter.
    transform = symbols[order - 1]
    onward = np.argsort(transform, kind="stable")
    first = transform[onward]
    divided = np.concatenate([[True], first[1:] != first[:-1]])
    # A pair of neighbours is divided once there is a new division between its places one symbol on: at the second of them,
    # or, where they are no neighbours there, anywhere after the first.
    inverse = np.empty(len(order), dtype=np.int64)
    inverse[onward] = np.arange(len(order))
    new = np.flatnonzero(divided)
    far = np.flatnonzero(~divided & (np.diff(onward, prepend=0) != 1))
    for _ in range(length - 1):
        if not len(new):
            break
        near = inverse[new]
        near = near[~divided[near]]
        interval = np.cumsum(divided, dtype=np.int32)
        hit = far[interval[onward[far]] != interval[onward[far - 1]]]
        divided[near] = True
        hit = hit[~divided[hit]]
        divided[hit] = True
        new = np.concatenate([near, hit])
        far = far[~divided[far]]
    return order, divided


def _suffix_order(symbols: np.ndarray, length: int) -> np.ndarray:
    """Suffixes sorted by at least their first ``length`` symbols, by doubling from packed groups of seven."""
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(7, np.uint16)]).astype(np.uint64)
    key = padded[:n].copy()
    for k in range(1, 7):
        key = key << np.uint64(9) | padded[k : n + k]
    done = 7
    while True:
        order = np.argsort(key)
        sorted_ = key[order]
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = np.cumsum(np.concatenate([[1], sorted_[1:] != sorted_[:-1]])).astype(np.uint64)
        if done >= length or int(rank[order[-1]]) == n:
            return order
        later = np.concatenate([rank[done:], np.zeros(min(done, n), np.uint64)])
        key = rank << np.uint64(32) | later
        done *= 2


@dataclass
class Pieces:
    """Distinct pieces, ordered by bucket: bytes, bucket, smallest document of the chunk, 32 bits of the anchor (of a
    single window of a frequent one, of itself), number of bytes; and their occurrences: first window, document, piece."""

    texts: list[bytes]
    bucket: np.ndarray
    least: np.ndarray
    mark: np.ndarray
    size: np.ndarray
    start: np.ndarray
    doc: np.ndarray
    piece: np.ndarray

    def by_bucket(self) -> list[tuple[int, int, int]]:
        """Bucket, its first piece and the first of the next."""
        present, first = np.unique(self.bucket, return_index=True)
        return list(zip(present.tolist(), first.tolist(), [*first[1:].tolist(), len(self.bucket)]))


class Chunk:
    """The texts of a chunk in a fixed order, with their stretches."""

    def __init__(self, table: pa.Table, length: int) -> None:
        rows = sorted(zip(table.column("_id").to_pylist(), table.column("_text").cast(pa.binary()).to_pylist()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or b""))
        self.length = length
        self.ids = [r[0] for r in rows]
        self.texts = [r[1] or b"" for r in rows]
        self.data = b"".join(self.texts)
        self.ends = np.cumsum([len(t) for t in self.texts], dtype=np.int64)
        usable = np.array([i is not None for i in self.ids], dtype=bool)
        self.numbers = np.array([_NONE if i is None else i for i in self.ids], dtype=np.int64)
        self.found = stretches(np.frombuffer(self.data, np.uint8), self.ends, usable, length)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors in order, which of them is each stretch's, and whether more than one document has it."""
        keys, which = np.unique(self.found.key, return_inverse=True)
        number = self.numbers[self.found.doc]
        low, high = np.full(len(keys), _NONE), np.full(len(keys), -_NONE)
        np.minimum.at(low, which, number)
        np.maximum.at(high, which, number)
        return keys, which, low < high

    def different(self, which: np.ndarray, n: int) -> np.ndarray:
        """How many different stretches each of the ``n`` anchors has, told apart by hashes of both ends; two count as two."""
        counts = np.bincount(which, minlength=n)
        often = np.flatnonzero(counts[which] > 2)
        start, count = self.found.start[often], self.found.count[often]
        ends = [_hashes_at(self.data, start), _hashes_at(self.data, start + count + self.length - 1 - ANCHOR)]
        alike = (ends[0] * _ODD ^ ends[1]) * _ODD ^ which[often].astype(np.uint64) << np.uint64(8) ^ count.astype(np.uint64)
        _, first = np.unique(alike, return_index=True)
        return np.where(counts > 2, np.bincount(which[often[first]], minlength=n), counts)

    def pieces(self, answers: dict[int, tuple[bytes, bytes]], buckets: int) -> Pieces:
        """The distinct pieces of repeated anchors, by bucket, and their occurrences."""
        keys, which, repeated = self.anchors()
        bucket = (keys % np.uint64(buckets)).astype(np.int64)
        frequent = np.zeros(len(keys), dtype=bool)
        # The places of each bucket's keys, in their order.
        order = np.argsort(bucket, kind="stable")
        present, first = np.unique(bucket[order], return_index=True)
        places = dict(zip(present.tolist(), np.split(order, first[1:])))
        for b, (again, often) in answers.items():
            own = places[b]
            repeated[own] |= _bits(again, len(own))
            frequent[own] = _bits(often, len(own))
        chosen = np.flatnonzero(repeated[which])
        often = frequent[which[chosen]]
        windows = self.found.count[chosen]
        # Stretches of frequent anchors are cut into their windows.
        cuts = np.where(often, windows, 1)
        stretch = np.repeat(chosen, cuts)
        start = self.found.start[stretch] + _ramp(cuts)
        end = start + np.repeat(np.where(often, 1, windows), cuts) + self.length - 1
        data = self.data
        # Equal pieces have one anchor, so they are of one bucket and number, whatever stretch they come from.
        texts, number = _numbered([data[s:e] for s, e in zip(start.tolist(), end.tolist())])
        # Numbers are given in the order of the first occurrences.
        first = np.flatnonzero(np.diff(np.maximum.accumulate(number), prepend=-1))
        own = which[stretch[first]]
        target = bucket[own]
        mark = (keys[own] >> np.uint64(32)).astype(np.uint32)
        # A single window shares nothing with another one.
        for k in np.flatnonzero(frequent[own]).tolist():
            mark[k] = own_hash = zlib.crc32(texts[k])
            target[k] = own_hash % buckets
        order = np.argsort(target, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        piece, doc = rank[number], self.found.doc[stretch]
        least = np.full(len(order), _NONE)
        np.minimum.at(least, piece, self.numbers[doc])
        return Pieces([texts[k] for k in order.tolist()], target[order], least, mark[order], (end - start)[first[order]], start, doc, piece)

    def removed(self, own: Pieces, smaller: dict[int, tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Where the removed runs of bytes begin and end, in order. ``smaller`` has by bucket, for each window of its
        pieces, whether it also starts in a smaller document of another chunk or piece."""
        windows = own.size - self.length + 1
        ends = np.cumsum(windows)
        begins = ends - windows
        parts = own.by_bucket()
        flags = np.concatenate([np.zeros(0, bool), *(_bits(smaller[b][0], int(ends[hi - 1] - begins[lo])) for b, lo, hi in parts)])
        # Runs of windows that are cut at the ends of the pieces.
        up, down = flags.copy(), flags.copy()
        up[1:] &= ~flags[:-1]
        up[begins] = flags[begins]
        down[:-1] &= ~flags[1:]
        down[ends - 1] = flags[ends - 1]
        ups, downs = np.flatnonzero(up), np.flatnonzero(down)
        low = np.searchsorted(ups, begins)
        runs = np.searchsorted(ups, ends) - low
        # An occurrence goes whole if its piece lies in a smaller document of the chunk, else by the runs of the piece.
        whole = self.numbers[own.doc] > own.least[own.piece]
        start, piece = own.start[~whole], own.piece[~whole]
        n = runs[piece]
        run = np.repeat(low[piece], n) + _ramp(n)
        shift = np.repeat(start - begins[piece], n)
        # Neighbouring windows cover one run of bytes.
        begin = np.concatenate([own.start[whole], shift + ups[run]])
        order = np.argsort(begin)
        begin = begin[order]
        end = np.concatenate([own.start[whole] + own.size[own.piece[whole]], shift + downs[run] + self.length])
        end = np.maximum.accumulate(end[order])
        cut = np.flatnonzero(begin[1:] > end[:-1])
        return begin[np.concatenate([[0], cut + 1])[: len(begin)]], end[np.concatenate([cut, [len(end) - 1]])[: len(end)]]


def _numbered(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The different texts in the order of their first occurrence, and which of them each text is."""
    known = {t: k for k, t in enumerate(dict.fromkeys(texts))}
    return list(known), np.fromiter(map(known.__getitem__, texts), np.int64, len(texts))


def _ramp(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n, one after the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _slabs(sizes: np.ndarray, group: np.ndarray, most: int) -> list[slice]:
    """Runs of whole groups, which stand one after the other; the last group of a run begins below ``most``."""
    if not len(sizes):
        return []
    begins = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    run = (np.cumsum(sizes) - sizes)[begins] // most
    cuts = begins[np.flatnonzero(np.diff(run, prepend=-1))].tolist()
    return [slice(lo, hi) for lo, hi in zip(cuts, [*cuts[1:], len(sizes)])]


def _bits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)


def _packed(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _batch(columns: list, schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_ANCHORS = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("several", pa.binary())])
_REPEATED = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("kind", pa.int32()), ("x", pa.binary()), ("y", pa.binary())])
_PIECES = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("text", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary()), ("marks", pa.binary())])
_REMOVED = pa.schema(
    [("_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_sha256", pa.string())]
)


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {kinds.get(f.type, 'array<struct<start:long,end:long>>')}" for f in schema)


def dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, spans (maximal removed byte runs), kept_sha256 (of the other bytes).

    A byte is removed if a string of ``length`` bytes covers it that also starts in a document with a smaller id. Null
    texts are empty; rows that share an id are one document to the others and none to each other; a row without an id
    keeps all its bytes and takes none. Needs ``length`` of at least ``ANCHOR``.
    """
    if length < ANCHOR:
        raise ValueError(f"length is below {ANCHOR}")
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    total = own.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    chunks, buckets = max(1, -(-total // CHUNK)), max(1, -(-total // BUCKET))
    frequent, transform = FREQUENT, TRANSFORM
    dealt = own.withColumn("chunk", F.pmod(F.xxhash64("_id", "_text"), F.lit(chunks)).cast("long"))

    def anchors(table: pa.Table) -> pa.Table:
        chunk = Chunk(table, length)
        keys, which, _ = chunk.anchors()
        bucket = keys % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        present, first = np.unique(bucket[order], return_index=True)
        # Beside the bucket, 32 bits tell anchors apart: should two of them agree, their stretches are looked at in vain.
        short = (keys[order] >> np.uint64(32)).astype(np.uint32)
        parts = [p.tobytes() for p in np.split(short, first[1:])] if len(keys) else []
        # Anchors with several stretches in the chunk: place in the message, number of stretches.
        n = chunk.different(which, len(keys))[order]
        place = np.flatnonzero(n > 1)
        cuts = np.searchsorted(place, first)
        pairs = np.stack([place - np.repeat(first, np.diff(cuts, append=len(place))), n[place]], axis=1).astype(np.uint32)
        several = [p.tobytes() for p in np.split(pairs, cuts[1:])] if len(keys) else []
        return _batch([present.astype(np.int64), [table.column("chunk")[0].as_py()] * len(parts), parts, several], _ANCHORS)

    def repeated(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(k, np.uint32) for k in table.column("keys").to_pylist()]
        ends = np.cumsum([len(p) for p in parts])
        _, which, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        more = [np.frombuffer(x, np.uint32).reshape(-1, 2).astype(np.int64) for x in table.column("several").to_pylist()]
        place = np.concatenate([x[:, 0] + end - len(p) for x, end, p in zip(more, ends.tolist(), parts)])
        total = n.copy()
        np.add.at(total, which[place], np.concatenate([x[:, 1] for x in more]) - 1)
        again, often = ([_packed(p) for p in np.split(flags[which], ends[:-1])] for flags in (n > 1, total >= frequent))
        return _batch([table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), [0] * len(parts), again, often], _REPEATED)

    def answers(table: pa.Table, kind: int) -> dict[int, tuple[bytes, bytes]]:
        columns = (table.column(c).to_pylist() for c in ("kind", "bucket", "x", "y"))
        return {b: (x, y) for k, b, x, y in zip(*columns) if k == kind}

    def pieces(texts: pa.Table, told: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _batch([[]] * len(_PIECES), _PIECES)
        number = texts.column("chunk")[0].as_py()
        own = Chunk(texts, length).pieces(answers(told, 0), buckets)
        rows = [
            (
                b, number, b"".join(own.texts[lo:hi]), own.size[lo:hi].astype(np.int32).tobytes(),
                own.least[lo:hi].tobytes(), own.mark[lo:hi].tobytes(),
            )
            for b, lo, hi in own.by_bucket()
        ]
        return _batch([list(c) for c in zip(*rows)] if rows else [[]] * len(_PIECES), _PIECES)

    def expand(table: pa.Table) -> pa.Table:
        every: list[bytes] = []
        ids_of, marks_of = ([np.frombuffer(x, kind) for x in table.column(c).to_pylist()] for c, kind in (("ids", np.int64), ("marks", np.uint32)))
        for text, sizes in zip(table.column("text").to_pylist(), table.column("sizes").to_pylist()):
            ends = np.cumsum(np.frombuffer(sizes, np.int32)).tolist()
            every += [text[begin:end] for begin, end in zip([0, *ends[:-1]], ends)]
        texts, number = _numbered(every)
        sizes, least_of, anchor = np.array([len(t) for t in texts]), np.full(len(texts), _NONE), np.zeros(len(texts), np.uint32)
        np.minimum.at(least_of, number, np.concatenate(ids_of))
        anchor[number] = np.concatenate(marks_of)
        first = np.cumsum(sizes - length + 1) - (sizes - length + 1)
        # The smallest document of every window. A piece that is the only one of its anchor, copies aside, shares no
        # window with another; the others are expanded, those of an anchor together.
        smallest = np.repeat(least_of, sizes - length + 1)
        _, group, members = np.unique(anchor, return_inverse=True, return_counts=True)
        several = np.flatnonzero(members[group] > 1)
        several = several[np.argsort(group[several], kind="stable")]
        for part in _slabs(sizes[several] + 1, group[several], transform):
            some = several[part]
            order, begins = undivided([texts[k] for k in some.tolist()], length)
            n = sizes[some]
            piece = np.repeat(np.arange(len(some)), n + 1)
            place = _ramp(n + 1)
            window = place <= n[piece] - length
            owner = np.where(window, least_of[some][piece], _NONE)[order]
            by_class = np.minimum.reduceat(owner, np.flatnonzero(begins))
            by_place = np.empty(len(order), dtype=np.int64)
            by_place[order] = by_class[np.cumsum(begins) - 1]
            smallest[(first[some][piece] + place)[window]] = by_place[window]
        told = []
        for which, ids in zip(np.split(number, np.cumsum([len(ids) for ids in ids_of])[:-1]), ids_of):
            n = sizes[which] - length + 1
            at = np.repeat(first[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            told.append(_packed(smallest[at] < np.repeat(ids, n)))
        return _batch(
            [table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), [1] * len(told), told, [b""] * len(told)], _REPEATED
        )

    def remove(texts: pa.Table, told: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _batch([[]] * len(_REMOVED), _REMOVED)
        chunk = Chunk(texts, length)
        ups, downs = chunk.removed(chunk.pieces(answers(told, 0), buckets), answers(told, 1))
        # Runs of neighbouring texts may touch: they are cut at the ends of the texts.
        rows = []
        for i, text, end in zip(chunk.ids, chunk.texts, chunk.ends.tolist()):
            begin = end - len(text)
            lo, hi = np.searchsorted(downs, begin, "right"), np.searchsorted(ups, end, "left")
            runs = [(max(int(u), begin) - begin, min(int(d), end) - begin) for u, d in zip(ups[lo:hi], downs[lo:hi])]
            spans = [{"start": u, "end": d} for u, d in runs]
            rows.append((i, len(text), spans, segments.digest(segments.kept(text, runs))))
        return _batch([list(c) for c in zip(*rows)], _REMOVED)

    sent = dealt.groupBy("chunk").applyInArrow(anchors, _ddl(_ANCHORS))
    again = sent.groupBy("bucket").applyInArrow(repeated, _ddl(_REPEATED))
    found = dealt.groupBy("chunk").cogroup(again.groupBy("chunk")).applyInArrow(pieces, _ddl(_PIECES))
    smaller = found.groupBy("bucket").applyInArrow(expand, _ddl(_REPEATED))
    out = dealt.groupBy("chunk").cogroup(again.unionByName(smaller).groupBy("chunk")).applyInArrow(remove, _ddl(_REMOVED))
    return out.select(F.col("_id").cast(docs.schema[id_col].dataType).alias(id_col), "n_bytes", "spans", "kept_sha256")
