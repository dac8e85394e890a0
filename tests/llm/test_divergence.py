"""Source divergence against sums over all kept terms."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from feedwright.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def plain(docs, least_docs=3, top=200):
    """The definition, over every term and every pair."""
    counts, found_in, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        text, lang, source = text or "", lang or "", source or ""
        groups.add((lang, source))
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        counts[lang, source].update(found)
        found_in[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((t for t, n in found_in[lang].items() if n >= least_docs), key=str.encode)
        sources = sorted(s for g, s in groups if g == lang)

        def shares(n):
            size = sum(n[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (n[t] + 1) // size for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            raised = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, cut in (("pair", pairs, None), ("term", raised, top)):
                ordered = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:cut]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ordered)]
    return sorted(out)


def audit(spark, docs, **options):
    frame = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], SCHEMA)
    return sorted(tuple(r) for r in divergence.audit(frame, **options).collect())


def some_docs(n, sources, seed=0):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{'abcdefgh'[i % 8]}{'xyz'[i // 8 % 3]}" for i in range(24)] + ["é", "Ünd", "語"]
    return [
        (" ".join(rng.choice(vocabulary, rng.integers(0, 40))) + "!", ["en", "de"][rng.integers(2)], f"s{rng.zipf(1.5) % sources}")
        for _ in range(n)
    ]


def test_against_the_definition(spark):
    docs = some_docs(150, 9)
    assert audit(spark, docs) == plain(docs)
    assert audit(spark, docs, least_docs=1, top=3) == plain(docs, 1, 3)


def added(batches, keys):
    """Parts of a task added up, modulo 2^64."""
    total = Counter()
    for batch in batches:
        for row in batch.to_pylist():
            for value in set(row) - set(keys):
                total[(value, *(row[k] for k in keys))] += row[value]
    return {k: v % 2**64 for k, v in total.items()}


def test_small_blocks_change_nothing(monkeypatch):
    docs = some_docs(80, 12, 1)
    texts = [pa.RecordBatch.from_pylist([{"lang": g, "source": s, "text": t} for t, g, s in docs[i : i + 30]]) for i in range(0, 80, 30)]
    rows = [
        {"lang": g, "counts": [{"source": f"s{s}", "n": int(n), "p": int(n) * 7 + 5, "p0": 5 + s} for s, n in enumerate(row) if n]}
        for g in ("de", "en") for row in np.random.default_rng(3).integers(0, 3, (50, 6))
    ]
    rows = [pa.RecordBatch.from_pylist(rows[i : i + 40]) for i in range(0, 100, 40)]
    results = []
    for change in ({}, {"HELD": 20, "BLOCK": 5, "PAIRS": 3}):
        for name, value in change.items():
            monkeypatch.setattr(divergence, name, value)
        parts = list(divergence._count_terms(iter(texts))), list(divergence._correct(iter(rows)))
        results.append((added(parts[0], ("lang", "source", "term")), added(parts[1], ("lang", "source", "item")), [sum(map(len, p)) for p in parts]))
    assert results[0][:2] == results[1][:2]
    assert all(few < many for few, many in zip(results[0][2], results[1][2]))


def test_odd_rows(spark):
    docs = [
        (None, "en", "a"), ("", "en", "b"), ("one one two", "en", "a"), ("ONE, two", "en", "c"), ("one", "en", "c"), ("two", "en", "c"),
        ("one", None, "a"), ("one", None, None), ("one", "", ""), ("one", "lone", "x"), ("one", "lone", "x"), ("one", "lone", "x"),
        ("12 34 --", "no terms", "a"), (None, "no terms", "b"), ("x" * 200_000 + " one " * 1000, "en", "long"),
        ("same same", "tie", "a"), ("same same", "tie", "b"), ("same same", "tie", "b"), ("other other", "tie", "c"),
    ]
    assert audit(spark, docs) == plain(docs)
    # Languages without kept terms have pairs of value 0.
    assert [r for r in audit(spark, docs) if r[0] == "no terms"] == [("no terms", "a", "pair", "b", 0, 1), ("no terms", "b", "pair", "a", 0, 1)]
    assert audit(spark, []) == []


def test_extra_columns_and_other_names(spark):
    docs = some_docs(40, 4, 2)
    frame = spark.createDataFrame(
        [(i, *d, 1.0, "x", 7) for i, d in enumerate(docs)], "term long, body string, counts string, item string, value double, part string, rank int"
    )
    got = divergence.audit(frame, lang_col="counts", source_col="item", text_col="body")
    assert sorted(tuple(r) for r in got.collect()) == plain(docs)


def f(p, q):
    return (p - q) ** 2 // q


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=5, max_size=5), max_size=12), st.lists(st.integers(1, 10**9), min_size=5, max_size=5))
def test_tree_corrections(rows, p0):
    """Every pair of entries of every row, one by one."""
    share = lambda s, n: min(p0[s] * (n + 1), 10**9)
    entries = [[(s, n) for s, n in enumerate(row) if n] for row in rows]
    expected = Counter()
    for row in entries:
        for s, a in row:
            for o, b in row:
                if s != o:
                    p, q = share(s, a), share(o, b)
                    expected[s << 32 | o] += f(p, q) - f(p, p0[o]) - f(p0[s], q) + f(p0[s], p0[o])
    flat = [e for row in entries for e in row]
    column = lambda values: np.array(list(values), np.int64)
    starts = np.cumsum([0, *map(len, entries)])
    args = starts, column(s for s, _ in flat), column(n for _, n in flat), column(share(*e) for e in flat), column(p0[s] for s, _ in flat)
    if not flat:
        return
    got = dict(zip(*(x.tolist() for x in divergence.tree_corrections(*args))))
    assert {k: v for k, v in got.items()} == {k: (v + 2**63) % 2**64 - 2**63 for k, v in expected.items()}


def test_sums_beyond_64_bits_on_the_way(spark):
    values = [2**62, 2**62, 2**62, 5 - 3 * 2**62]
    wrapped = [(v + 2**63) % 2**64 - 2**63 for v in values]
    frame = spark.createDataFrame([(v,) for v in wrapped], "v long")
    assert frame.agg(divergence._long_sum(frame["v"])).first()[0] == 5


@pytest.mark.parametrize("text, expected", [("A-b É9é", [b"a", b"b", "É".encode(), "é".encode()]), ("", []), ("__", [])])
def test_terms(text, expected):
    assert divergence.terms(text.encode()) == expected
