"""Prefix trie of conversations: how far they share their turns, and what sharing saves.

A node is a distinct sequence of first turns. Turns become fixed records (128 bits of a digest of role and text, and the
number of characters), a node is known by a digest of its records, and texts are read once and never shuffled.

* Turns are numbered by a sort over ranges of (conversation, turn); a conversation may cross any number of partitions.
* Long sequences are cut into slabs of ``SLAB`` turns. A slab starts at a node of the slab before it, so slabs of all
  depths are handled alike and at once, and no task holds a whole long conversation.
* Equal slabs are folded to one with a count. The rest is dealt out in order of prefixes, hot prefixes further by a digest.
  A shard numbers its turns densely, packs its sequences into a double array (BASE and CHECK), walks all of them down level
  by level, and gives one row per node with the sums over what passed through it.
* Nodes near the root occur in many shards; grouping the rows by node adds them up.

Sums over subtrees need no walk up the tree. Every node belongs to its smallest member; that conversation then owns all
nodes on its way from some depth to its end. A node's subtree consists of the owned ends of its members' paths, so if
every conversation carries the sum over the nodes it owns, a second pass of the same tries gives, per node, the sum over
its members - too much only by the nodes its own conversation owns above it, which are subtracted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedwright.llm.components import saved

#: Turns of a slab, and turns that one shard's trie is built from.
SLAB = 128
SHARD = 50_000
#: Places tried for the children of a node before new room is added at the end of the double array.
TRIES = 64
#: Conversations of one hundred begin with up to five turns of its first one.
GROUP, MOST_SHARED = 100, 6

_RECORD = 20  # bytes of a turn: 16 of the digest, 4 for the number of characters
_ROOT = bytes(16)


def key_of(root: bytes, records: bytes) -> bytes:
    """The node reached from node ``root`` by some turns (the same in Spark: ``_key``)."""
    return hashlib.sha256(root + records).digest()[:16] if records else root


def _digest(value: Column) -> Column:
    return F.unhex(F.substring(F.sha2(value, 256), 1, 32))


def _key(root: str, records: str) -> Column:
    return F.when(F.length(records) == 0, F.col(root)).otherwise(_digest(F.concat(root, records)))


def _look_up(rows: DataFrame, summary: DataFrame, key: str, summary_key: str) -> DataFrame:
    """Left join of many rows to one row per key; the second equality lets AQE split the partition of a hot key."""
    return rows.join(summary, (rows[key] == summary[summary_key]) & (F.xxhash64(rows[key]) == F.xxhash64(summary[summary_key])), "left")


# --- turns in order -------------------------------------------------------------------------------------------------


def _runs(values: np.ndarray) -> np.ndarray:
    """Where a run of equal values starts, and the end."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])) if len(values) else np.zeros(1, np.int64)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per partition: its number, its first and last conversation and their rows."""
    first = last = part = None
    rows_first = rows_last = 0
    for batch in batches:
        ids = batch.column(1).to_numpy()
        bounds = _runs(ids)
        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if first is None:
                first, part = int(ids[start]), batch.column(0)[0].as_py()
            if ids[start] != last:
                last, rows_last = int(ids[start]), 0
            rows_last += end - start
            if last == first:
                rows_first += end - start
    if first is not None:
        yield pa.RecordBatch.from_pylist([{"part": part, "first": first, "rows_first": rows_first, "last": last, "rows_last": rows_last}])


def offsets(edges: list[tuple[int, int, int, int, int]]) -> dict[int, int]:
    """Rows of a partition's first conversation that lie in the partitions before it, by partition."""
    found, conv, rows = {}, None, 0
    for part, first, rows_first, last, rows_last in sorted(edges):
        found[part] = rows if first == conv else 0
        conv, rows = last, rows_last + (found[part] if last == first else 0)
    return found


def _blocks(before: dict[int, int], slab: int):
    """Sorted turns to blocks (conv_id, start, records) of a conversation, cut at multiples of ``slab``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            ids, records = batch.column(1).to_numpy(), batch.column(2).to_pylist()
            if last is None and len(ids):
                last, seen = ids[0], before[batch.column(0)[0].as_py()]
            out = []
            bounds = _runs(ids)
            for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if ids[start] != last:
                    last, seen = ids[start], 0
                while start < end:
                    to = min(end, start + slab - seen % slab)
                    out.append((int(last), seen, b"".join(records[start:to])))
                    start, seen = to, seen + to - start
            columns = list(zip(*out)) or [(), (), ()]
            types = pa.int64(), pa.int64(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["conv_id", "start", "records"])

    return cut


def ordered_blocks(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, start, records): every conversation's turns in order, in blocks of at most ``SLAB``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    content = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    chars = F.unhex(F.lpad(F.hex(F.length(text)), 8, "0"))
    turns = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.concat(_digest(content), chars).alias("record")
    )
    order = ("conv_id", "turn", "record")
    placed = saved(turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "record"))
    placed = placed.select(F.spark_partition_id().cast("long").alias("part"), "conv_id", "record")
    # One row per partition reaches the driver.
    edges = placed.mapInArrow(_edges, "part long, first long, rows_first long, last long, rows_last long").collect()
    return placed.mapInArrow(_blocks(offsets(list(map(tuple, edges))), SLAB), "conv_id long, start long, records binary")


# --- rebuilt conversations ------------------------------------------------------------------------------------------


def rebuilt(blocks: DataFrame) -> DataFrame:
    """(conv_id, turns, start, records): blocks of the rebuilt conversations, and their length in turns. Each begins with
    the first turns of the conversation that opens its group, as many as a digest of its own number says."""
    n = F.length("records") / _RECORD
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED
    whole = blocks.groupBy("conv_id").agg(F.max(F.col("start") + n).cast("long").alias("own")).withColumn("h", shared)
    opening = blocks.where((F.col("conv_id") % GROUP == 0) & (F.col("start") < MOST_SHARED))
    # Only blocks that hold one of the first turns: six at most.
    opening = opening.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("start", "records"))).alias("parts"))
    opening = opening.select(
        F.col("conv_id").alias("opener"), F.expr("aggregate(parts, X'', (all, p) -> concat(all, p.records))").alias("opening")
    )
    whole = whole.withColumn("_opener", F.col("conv_id") - F.col("conv_id") % GROUP).join(opening, F.col("_opener") == F.col("opener"), "left")
    head = F.expr(f"substring(coalesce(opening, X''), 1, cast(h as int) * {_RECORD})")
    whole = whole.select("conv_id", "own", "h", head.alias("head")).withColumn("lead", (F.length("head") / _RECORD).cast("long"))
    whole = saved(whole.withColumn("turns", F.col("lead") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    heads = whole.select("conv_id", "turns", F.lit(0).cast("long").alias("start"), F.col("head").alias("records"))
    shift = whole.select(F.col("conv_id").alias("_conv"), "turns", "h", "lead")
    rest = _look_up(blocks, shift, "conv_id", "_conv").withColumn("skip", F.greatest(F.col("h") - F.col("start"), F.lit(0)))
    rest = rest.withColumn("records", F.expr(f"substring(records, cast(skip as int) * {_RECORD} + 1)")).where(F.length("records") > 0)
    start = F.col("start") + F.col("skip") - F.col("h") + F.col("lead")
    return heads.unionByName(rest.select("conv_id", "turns", start.alias("start"), "records"))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slabs in order of (conversation, slab): the node each one starts at, from those before it."""
    conv, root = None, _ROOT
    for batch in batches:
        roots = []
        for at, seq in zip(batch.column("conv_id").to_pylist(), batch.column("seq").to_pylist()):
            if at != conv:
                conv, root = at, _ROOT
            roots.append(root)
            root = key_of(root, seq)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.binary())], names=[*batch.schema.names, "root"])


def slabs(blocks: DataFrame) -> DataFrame:
    """(conv_id, root, depth, seq, ends): every rebuilt conversation as slabs of turns, each with the node and depth it
    starts at and whether the conversation ends with it. A conversation without turns has one empty slab."""
    last = F.greatest(F.col("start"), F.col("start") + (F.length("records") / _RECORD).cast("long") - 1)
    pieces = blocks.select("*", F.explode(F.sequence(F.floor(F.col("start") / SLAB), F.floor(last / SLAB))).alias("slab"))
    skip = F.greatest(F.col("slab") * SLAB - F.col("start"), F.lit(0))
    pieces = pieces.withColumn("at", F.col("start") + skip).withColumn("skip", skip)
    room = F.expr(f"cast((slab + 1) * {SLAB} - at as int) * {_RECORD}")
    pieces = pieces.withColumn("room", room).withColumn("records", F.expr(f"substring(records, cast(skip as int) * {_RECORD} + 1, room)"))
    # A slab has as many pieces as turns at most.
    found = pieces.groupBy("conv_id", "turns", "slab").agg(F.sort_array(F.collect_list(F.struct("at", "records"))).alias("parts"))
    found = found.select("conv_id", "turns", "slab", F.expr("aggregate(parts, X'', (all, p) -> concat(all, p.records))").alias("seq"))
    whole = found.where(F.col("turns") <= SLAB).withColumn("root", F.lit(_ROOT))
    long = found.where(F.col("turns") > SLAB).repartition("conv_id").sortWithinPartitions("conv_id", "slab")
    long = long.mapInArrow(_chain, "conv_id long, turns long, slab long, seq binary, root binary")
    return whole.unionByName(long).select(
        "conv_id", "root", (F.col("slab") * SLAB).alias("depth"), "seq", ((F.col("slab") + 1) * SLAB >= F.col("turns")).alias("ends")
    )


# --- double-array tries ---------------------------------------------------------------------------------------------


class DoubleArray:
    """Sequences of dense codes. From state s the code c leads to t = base[s] + c if check[t] is s; state 0 is the top."""

    def __init__(self, starts: np.ndarray, codes: np.ndarray) -> None:
        self.base, self.check = np.zeros(256, np.int64), np.full(256, -1, np.int64)
        self.check[0], self._low = 0, 1
        lengths = np.diff(starts)
        row, state = np.arange(len(lengths)), np.zeros(len(lengths), np.int64)
        for depth in range(int(lengths.max(initial=0))):
            going = lengths[row] > depth
            row, state = row[going], state[going]
            step = codes[starts[row] + depth]
            children = np.unique(np.stack([state, step]), axis=1)
            self._pack(children[0], children[1])
            state = self.base[state] + step

    def _grow(self, size: int) -> None:
        if size > len(self.base):
            more = size + size // 4 - len(self.base)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _free(self, wanted: int) -> np.ndarray:
        """The lowest free places; beyond the end all are free."""
        found, count, at = [], 0, self._low
        while count < wanted:
            if at >= len(self.check):
                self._grow(len(self.check) + wanted)
            to = at + max(1024, wanted)
            found.append(np.flatnonzero(self.check[at:to] < 0) + at)
            count, at = count + len(found[-1]), to
        free = np.concatenate(found)
        self._low = int(free[0])
        return free[:wanted]

    def _pack(self, parent: np.ndarray, code: np.ndarray) -> None:
        """Places the children of a level, given in order of parent and code."""
        bounds = _runs(parent)
        several = np.diff(bounds) > 1
        for start, end in zip(bounds[:-1][several].tolist(), bounds[1:][several].tolist()):
            wanted = code[start:end]
            for base in self._free(TRIES) - wanted[0]:
                taken = base + wanted
                if (self.check[taken[: np.searchsorted(taken, len(self.check))]] < 0).all():
                    break
            else:
                taken = len(self.check) + wanted - wanted[0]
                base = taken[0] - wanted[0]
            self._grow(int(taken[-1]) + 1)
            self.base[parent[start]] = base
            self.check[taken] = parent[start]
        # An only child fits anywhere.
        alone = bounds[:-1][~several]
        if len(alone):
            place = self._free(len(alone))
            self.base[parent[alone]] = place - code[alone]
            self.check[place] = parent[alone]

    def follow(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The states reached; -1 where a state has no such child."""
        to = self.base[state] + code
        there = (to > 0) & (to < len(self.check))
        return np.where(there & (self.check[np.where(there, to, 0)] == state), to, -1)


_NODE = pa.schema([
    ("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("chars", pa.int64()),
    ("a", pa.int64()), ("b", pa.int64()), ("rep", pa.int64()),
])


def shard_nodes(rows: list[tuple[bytes, int, bytes, int, int, int]]) -> pa.RecordBatch:
    """Nodes of one shard of (root, depth, seq, a, b, rep): a and b are added up over what passes through a node, rep is
    the smallest. The node a slab starts at is left to the slab before it, but for the top of the whole trie."""
    roots, depths, seqs, *sums = zip(*rows)
    a, b, rep = (np.array(x, np.int64) for x in sums)
    # Dense codes: the starting nodes first, then the turns.
    known, start_code = np.unique(np.frombuffer(b"".join(roots), np.dtype((np.void, 16))), return_inverse=True)
    flat = np.frombuffer(b"".join(seqs), np.dtype((np.void, _RECORD)))
    turn_code = np.unique(flat, return_inverse=True)[1].reshape(-1) + len(known)
    lengths = np.array([len(s) // _RECORD for s in seqs], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    codes = np.empty(starts[-1], np.int64)
    codes[starts[:-1]] = start_code.reshape(-1)
    rest = np.ones(starts[-1], bool)
    rest[starts[:-1]] = False
    codes[rest] = turn_code

    trie = DoubleArray(starts, codes)
    size = len(trie.check)
    total_a, total_b, least = np.zeros(size, np.int64), np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max)
    keys: dict[int, tuple[bytes, object]] = {}
    out = []
    row, state = np.arange(len(rows)), np.zeros(len(rows), np.int64)
    for level in range(int(lengths.max()) + 1):
        going = lengths[row] >= level
        row, state = row[going], state[going]
        state = trie.follow(state, codes[starts[row] + level])
        np.add.at(total_a, state, a[row])
        np.add.at(total_b, state, b[row])
        np.minimum.at(least, state, rep[row])
        nodes, first = np.unique(state, return_index=True)
        above, keys = keys, {}
        for node, i in zip(nodes.tolist(), row[first].tolist()):
            if level == 0:
                keys[node] = roots[i], hashlib.sha256(roots[i])
                parent, chars = None, 0
            else:
                parent, base = above[int(trie.check[node])]
                record = seqs[i][(level - 1) * _RECORD : level * _RECORD]
                whole = base.copy()
                whole.update(record)
                keys[node] = whole.digest()[:16], whole
                chars = int.from_bytes(record[16:], "big")
            if level or not depths[i]:
                out.append((keys[node][0], parent, depths[i] + level, chars, int(total_a[node]), int(total_b[node]), int(least[node])))
    columns = zip(*out) if out else [()] * len(_NODE)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NODE)], schema=_NODE)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("root", "depth", "seq", "a", "b", "rep"))):
            held.append(row)
            size += len(row[2]) // _RECORD + 1
            if size >= SHARD:
                yield shard_nodes(held)
                held, size = [], 0
    if held:
        yield shard_nodes(held)


def trie_nodes(rows: DataFrame) -> DataFrame:
    """(key, parent, depth, chars, a, b, rep): the nodes of all slabs (root, depth, seq, a, b, rep), with a and b summed
    over the rows that pass through a node and the smallest rep."""
    once = rows.groupBy("root", "depth", "seq").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.min("rep").alias("rep"))
    # A prefix that very many sequences share is dealt out further by a digest.
    dealt = once.repartitionByRange(F.col("root"), F.expr(f"substring(seq, 1, {3 * _RECORD})"), F.xxhash64("seq"))
    found = dealt.sortWithinPartitions("root", "seq").mapInArrow(
        _shards, "key binary, parent binary, depth long, chars long, a long, b long, rep long"
    )
    return found.groupBy("key", "parent", "depth", "chars").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.min("rep").alias("rep"))


# --- lists of ends --------------------------------------------------------------------------------------------------


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out, at = [], 0
        for key, run in groupby(keys):
            to = at + sum(1 for _ in run)
            out.append({"key": key, "first": ids[at], "text": ",".join(map(str, ids[at:to]))})
            at = to
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.binary()), ("first", pa.int64()), ("text", pa.string())]))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, held, out = None, None, []
    schema = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])
    for batch in batches:
        for at, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            if at == key:
                held.update(b"," + text.encode())
                continue
            if key is not None:
                out.append((key, held.hexdigest()))
            key, held = at, hashlib.sha256(text.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([held.hexdigest()])], schema=schema)


def end_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): digest of the ascending ids of the conversations (key, conv_id) that end at a node.

    The ids of a hot node are sorted and written out by many tasks; only the finished stretches of text run through one,
    one after the other, as a digest of one text must."""
    order = ("key", "conv_id")
    listed = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_listed, "key binary, first long, text string")
    return listed.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "key binary, ends_sha256 string")


# --- the operator ---------------------------------------------------------------------------------------------------


def prefix_trie(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256, and the digest ``node``.

    A conversation c is rebuilt from the first h turns of conversation c - c % 100 (the sign of a remainder is that of c;
    none if there is no such conversation) and its own turns after its first h, h being crc32 of its decimal number modulo
    6. Turns are ordered by ``turn``, null first; turns that tie are ordered by a digest of role and text, so the order is
    the same in every run. Null role or text is empty, rows without conv_id are left out, repeated rows are turns of their
    own, further columns are ignored, and an empty table has no node, not even the root.
    """
    parts = saved(slabs(rebuilt(ordered_blocks(conversations, conv_col, turn_col, role_col, text_col))))
    one = F.lit(1).cast("long")
    counted = parts.select("root", "depth", "seq", one.alias("a"), F.lit(0).cast("long").alias("b"), F.col("conv_id").alias("rep"))
    nodes = saved(trie_nodes(counted).drop("b").withColumnRenamed("a", "n"))
    children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("_key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, F.col("key") == F.col("_key"), "left").drop("_key").fillna(0, ["n_children"])

    saving = (F.col("n") - 1) * F.col("chars")
    owners = nodes.groupBy(F.col("rep").alias("_rep")).agg(
        F.sum(saving).alias("a"), F.sum((F.col("n_children") == 0).cast("long")).alias("b")
    )
    owners = owners.where((F.col("a") > 0) | (F.col("b") > 0))
    carried = _look_up(parts, owners, "conv_id", "_rep").where(F.col("_rep").isNotNull())
    below = trie_nodes(carried.select("root", "depth", "seq", "a", "b", F.col("conv_id").alias("rep")))
    below = below.select(F.col("key").alias("_key"), F.col("a").alias("all_saved"), F.col("b").alias("all_leaves"))

    # Below a node of one conversation nothing is saved, and there is one leaf. Of the others, those that a conversation
    # owns lie on its own way down.
    owned = Window.partitionBy("rep").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    shared = nodes.where(F.col("n") > 1).withColumn("above", F.coalesce(F.sum(saving).over(owned), F.lit(0)))
    shared = shared.join(below, F.col("key") == F.col("_key"), "left").select(
        *nodes.columns, (F.coalesce("all_saved", F.lit(0)) - F.col("above")).alias("saved_tokens"), F.col("all_leaves").alias("n_leaves")
    )
    lone = nodes.where(F.col("n") == 1).select("*", F.lit(0).cast("long").alias("saved_tokens"), one.alias("n_leaves"))
    parents = nodes.select(F.col("key").alias("_key"), F.col("rep").alias("parent_conv_id"))
    found = _look_up(shared.unionByName(lone), parents, "parent", "_key").drop("_key")
    ends = parts.where("ends").select(_key("root", "seq").alias("key"), "conv_id")
    found = found.join(end_digests(ends).withColumnRenamed("key", "_key"), F.col("key") == F.col("_key"), "left")
    return found.select(
        F.col("rep").alias("conv_id"),
        "depth",
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        F.lower(F.hex("key")).alias("node"),
    )
