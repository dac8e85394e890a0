"""Conversation trie against dictionaries of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from feedwright.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [t for _, t in sorted(turns, key=lambda x: x[0])] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
            if d:
                children[whole[c][: d - 1]].add(whole[c][:d])
        ends[whole[c]].append(c)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        own_chars = len(node[-1][1]) if node else 0
        saved[node] = (len(members[node]) - 1) * own_chars + sum(saved[x] for x in children[node])
    return sorted(
        (
            members[node][0], len(node), members[node[:-1]][0] if node else None, len(members[node]), len(children[node]), leaves[node],
            saved[node], hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest(),
        )
        for node in members
    )


def order(rows):
    return sorted(rows, key=lambda r: (r[0], r[1]))


def trie(spark, rows, parts=3):
    got = tries.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(parts))
    assert sorted(got.columns) == sorted((*COLUMNS, "node"))
    return order(tuple(r) for r in got.select(*COLUMNS).collect())


def some_conversations(seed, n, longest, texts=3, ids=1000):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(ids), n):
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), "x" * rng.randint(0, texts)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, n, longest, texts, ids", [(1, 60, 8, 2, 300), (2, 40, 12, 1, 60), (3, 8, 400, 1, 9)])
def test_against_prefixes(spark, seed, n, longest, texts, ids):
    rows = some_conversations(seed, n, longest, texts, ids)
    assert trie(spark, rows) == order(plain(rows))


def test_conversations_longer_than_slabs(spark):
    """Copies and near copies of long conversations, which part in the first, second and third slab and at borders."""
    long = [(t, "user", "ab"[t % 2]) for t in range(400)]
    rows = []
    for c, cut in [(107, 400), (117, 400), (120, 5), (131, 127), (143, 128), (150, 129), (151, 256), (160, 257), (7, 300), (201, 384)]:
        rows += [(c, t, r, x if t != cut - 2 or c % 2 else x + str(c)) for t, r, x in long[:cut]]
    rows += [(100, t, r, x) for t, r, x in long[:3]]
    assert trie(spark, rows, 5) == order(plain(rows))


def test_odd_rows(spark):
    rows = [
        (1, None, "user", "first"), (1, -5, "user", "second"), (1, 3, None, None), (1, 3, None, None),  # repeated rows are turns
        (None, 1, "user", "no conversation"), (2, 0, "", ""), (5, 0, "user", "y" * 300_000), (300, 0, "user", "é日🙂"),
        (305, 0, "user", "é日🙂"), (-7, 0, "user", "a"), (-7, 1, "user", "b"), (10**15 + 7, 0, "user", "a"),
    ]
    # Truncating remainders, as in SQL: negative conversations belong to group 0.
    assert [r for r in trie(spark, rows) if r[0] >= 0] == [r for r in order(plain(rows)) if r[0] >= 0]
    (root,) = [r for r in trie(spark, rows) if r[1] == 0]
    assert root[:4] == (-7, 0, None, 7)
    assert trie(spark, []) == []
    lone = [(6, 0, "user", "a")]
    assert trie(spark, lone) == order(plain(lone))


def test_ties_are_ordered_the_same_way(spark):
    rows = [(c, 0, "user", x) for c in (4, 44) for x in "abcdefgh"]
    assert trie(spark, rows, 1) == trie(spark, rows[::-1], 4)


def test_extra_columns_and_other_names(spark):
    rows = some_conversations(4, 20, 6)
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "depth long, node long, key string, parent string, rep int, root string, n int")
    got = tries.prefix_trie(frame, "depth", "node", "key", "parent")
    assert order(tuple(r) for r in got.select(*COLUMNS).collect()) == order(plain(rows))


def in_partitions(rows, bounds):
    """Sorted (conv, record) rows as partitions of batches."""
    parts = []
    for p, (start, end) in enumerate(zip([0, *bounds], [*bounds, len(rows)])):
        batches = [
            pa.RecordBatch.from_arrays([pa.array([p] * len(x)), pa.array([r[0] for r in x], pa.int64()), pa.array([r[1] for r in x], pa.binary())], names=["part", "conv_id", "record"])
            for i in range(start, end, 3) for x in [rows[i : min(i + 3, end)]]
        ]
        parts.append(batches)
    return parts


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=6), st.lists(st.integers(0, 60), max_size=5), st.integers(1, 5))
def test_numbers_of_turns_across_partitions(lengths, bounds, slab):
    rows = [(c * 7, bytes([c, t]) * 10) for c, n in enumerate(lengths) for t in range(n)]
    parts = in_partitions(rows, sorted(min(b, len(rows)) for b in bounds))
    edges = [tuple(r.values()) for p in parts for b in tries._edges(iter(p)) for r in b.to_pylist()]
    before = tries.offsets(edges)
    got = [r for p in parts if p for b in tries._blocks(before, slab)(iter(p)) for r in b.to_pylist()]
    again = [(r["conv_id"], r["records"][i : i + 20]) for r in got for i in range(0, len(r["records"]), 20)]
    assert again == rows
    seen = defaultdict(int)
    for r in got:
        assert r["start"] == seen[r["conv_id"]] and r["start"] // slab == (r["start"] + len(r["records"]) // 20 - 1) // slab
        seen[r["conv_id"]] += len(r["records"]) // 20


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=7), min_size=1, max_size=40))
def test_double_array(sequences):
    starts = np.cumsum([0, *map(len, sequences)])
    array = tries.DoubleArray(starts, np.array([x for s in sequences for x in s], np.int64))
    prefixes = {tuple(s[:d]) for s in sequences for d in range(len(s) + 1)}

    def walk(sequence):
        state = np.zeros(1, np.int64)
        for x in sequence:
            state = array.follow(state, np.array([x]))
            if state[0] < 0:
                return None
        return int(state[0])

    found = {p: walk(p) for p in prefixes}
    assert None not in found.values() and len(set(found.values())) == len(prefixes)
    for p in prefixes:
        assert all(walk((*p, x)) is None for x in range(45) if (*p, x) not in prefixes)


def test_small_shards_add_up(monkeypatch):
    rng = random.Random(5)
    rows = [(bytes(16), 0, b"".join(rng.choice([b"a", b"b", b"c"]) * 20 for _ in range(rng.randint(0, 6))), rng.randint(1, 3), 1, i) for i in range(200)]
    rows += [(b"r" * 16, 128, b"a" * 20 * rng.randint(1, 4), 1, 1, i) for i in range(50)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("root", "depth", "seq", "a", "b", "rep"), r)) for r in rows])
    results = []
    for shard in (10**6, 1, 7):
        monkeypatch.setattr(tries, "SHARD", shard)
        total = defaultdict(lambda: [0, 0, 10**9])
        for b in tries._shards(iter([batch])):
            for r in b.to_pylist():
                held = total[r["key"], r["parent"], r["depth"], r["chars"]]
                held[0], held[1], held[2] = held[0] + r["a"], held[1] + r["b"], min(held[2], r["rep"])
        results.append(dict(total))
    assert results[0] == results[1] == results[2]
    assert results[0][bytes(16), None, 0, 0] == [sum(r[3] for r in rows[:200]), 200, 0]
