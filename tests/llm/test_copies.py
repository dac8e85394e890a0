"""Near and exact copies against comparisons of everything with everything."""

import hashlib
import random
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import GroupedData
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from feedwright.llm import chunks, embeddings, minhash, suffixes
from feedwright.llm.components import components


def reached(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("links", [
    [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)] + [(100, 101), (101, 99)], [(5, 5)], [],
    [(random.Random(k).randrange(80), random.Random(-k - 1).randrange(80)) for k in range(50)],
])
def test_components(spark, links):
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    links = [x for x in links if x[0] != x[1]]
    assert got == reached({n for x in links for n in x}, links)


def shingles(text, width):
    w = bytes(text or "", "utf-8").lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def near(docs, width, threshold):
    sets = [(i, shingles(t, width)) for i, t in docs]
    links = [(a, b) for a, x in sets for b, y in sets if a is not None and b is not None and a < b and x and 100 * len(x & y) >= threshold * len(x | y)]
    comp = reached({i for i, _ in docs if i is not None}, links)
    return sorted(((i, len(s), comp.get(i), i is None or comp[i] == i) for i, s in sets), key=str)


def altered(r, text, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 5)  # buckets of several blocks
    r = random.Random(8)
    bases = [" ".join(f"w{r.randrange(300)}" for _ in range(80)) for _ in range(4)]
    docs = [(i, altered(r, bases[i % 4], r.choice([0, 0, 1, 2, 3, 5, 8]))) for i in range(60)]
    # Neighbours of this row are linked, its ends are not: links of links count.
    chain = bases[0] + " end"
    for i in range(60, 72):
        chain = altered(r, chain, 1)
        docs.append((i, chain))
    docs += [(80, None), (81, ""), (82, " \n\t "), (83, "One two"), (84, "one  TWO\n"), (85, "two one"), (None, bases[0]), (90, "x " * 20_000), (91, "x " * 30_000)]
    frame = spark.createDataFrame([(*d, True, 0) for d in docs], "doc_id long, text string, kept boolean, component_id int")
    got = sorted((tuple(x) for x in minhash.near_duplicates(frame, width=4).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
    assert got == near(docs, 4, 80)


def test_near_duplicates_of_repeated_rows_and_empty_tables(spark, frame):
    docs = frame("doc_id int, text string", (2, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f"))
    assert sorted(tuple(r) for r in minhash.near_duplicates(docs).collect()) == [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False)]
    assert minhash.near_duplicates(docs.where("false")).count() == 0


def test_links_whose_signatures_agree_in_few_places(spark):
    # Pairs of similarity 0.8, of some 600,000 tried those whose signatures agree in 79 to 82 places.
    docs = []
    for k in (34068, 51598, 156028, 241264):
        w = [f"w{k}x{j}" for j in range(10)]
        docs += [(2 * k, " ".join(w[:9])), (2 * k + 1, " ".join(w[:8] + w[9:]))]
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=1).collect()
    assert sorted((tuple(x) for x in got), key=str) == near(docs, 1, 80)


def repeated(docs, length):
    """(id, bytes, removed runs, digest) by looking every string up in all smaller documents."""
    first = {}
    for i, t in docs:
        if i is not None:
            for k in range(len(t) - length + 1):
                first[t[k : k + length]] = min(i, first.get(t[k : k + length], i))
    out = []
    for i, t in docs:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if i is not None and first[t[k : k + length]] < i:
                gone[k : k + length] = [True] * length
        runs = [k for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1])]
        out.append((i, len(t), sum(gone), len(runs), hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def removed(found):
    return sorted(
        ((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), r["kept_sha256"]) for r in found.collect()), key=str
    )


@pytest.mark.parametrize(("chunk", "frequent"), [(8_000_000, 256), (900, 2)])
def test_repeats(spark, monkeypatch, chunk, frequent):
    for name, value in (("CHUNK", chunk), ("BUCKET", chunk // 2), ("FREQUENT", frequent)):
        monkeypatch.setattr(suffixes, name, value)
    r = random.Random(6)
    word = lambda: r.choice(["é", "ab", "the ", "of", "", "\n", "日本"]) + r.choice("abcdefghij") * r.randint(0, 3)
    text = lambda n: "".join(word() for _ in range(n))
    passages = [text(40) for _ in range(4)] + ["ab" * 60, "-" * 130]
    docs = [(i, text(r.randint(0, 30)) + r.choice(passages) + text(20) + r.choice(["", *passages])) for i in range(50)]
    docs += [(60, docs[3][1]), (61, docs[3][1]), (2, docs[4][1]), (70, None), (71, ""), (72, "short"), (None, passages[0]), (73, "a" * 3000), (74, passages[0][:49])]
    docs.sort(key=lambda d: r.random())
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, chunk int, n_bytes string")
    assert removed(suffixes.dedup(frame, 50)) == repeated([(i, (t or "").encode()) for i, t in docs], 50)


def test_repeats_of_an_empty_table(frame):
    assert suffixes.dedup(frame("doc_id long, text string", (1, "a")).where("false")).count() == 0
    assert removed(suffixes.dedup(frame("doc_id long, text string", (1, None)))) == [(1, 0, 0, 0, hashlib.sha256(b"").hexdigest())]


def steps_of(frame, monkeypatch, text="a"):
    """The grouped steps of the operator, planned for a text of the given size."""
    steps = {}
    for kind in (GroupedData, PandasCogroupedOps):
        plain = kind.applyInArrow
        monkeypatch.setattr(kind, "applyInArrow", lambda self, f, schema, plain=plain: steps.update({f.__name__: f}) or plain(self, f, schema))
    suffixes.dedup(frame("doc_id long, text string", (1, text)), 50)
    return steps


def of_chunk(number, *docs):
    return pa.table({"_id": [i for i, _ in docs], "_text": [t for _, t in docs], "chunk": [number] * len(docs)})


def test_a_chunk_sends_no_more_messages_than_there_are_chunks(frame, monkeypatch):
    for name in ("CHUNK", "BUCKET"):
        monkeypatch.setattr(suffixes, name, getattr(suffixes, name) // 2_000)
    r = random.Random(5)
    text = "".join(r.choices("abcdefgh ", k=10 * suffixes.CHUNK))
    assert 0 < steps_of(frame, monkeypatch, text)["anchors"](of_chunk(0, (1, text))).num_rows <= 10


def test_anchors_of_one_surrounding_are_not_cut(frame, monkeypatch):
    steps = steps_of(frame, monkeypatch)
    r = random.Random(6)
    word = lambda n: "".join(r.choices("abcdefgh ", k=n))
    passage = word(200)
    # In 300 chunks, three times in each.
    sent = pa.concat_tables([steps["anchors"](of_chunk(k, *((3 * k + j, passage) for j in range(3)))) for k in range(300)])
    told = steps["repeated"](sent)
    assert told.num_rows == 300
    assert all(any(x) and not any(y) for x, y in zip(told.column("x").to_pylist(), told.column("y").to_pylist()))
    # A phrase with ever other text around it: three different stretches in each of 60 chunks.
    monkeypatch.setattr(suffixes, "FREQUENT", 61)  # more than there are chunks
    steps = steps_of(frame, monkeypatch)
    tables = [of_chunk(k, *((3 * k + j, word(60) + passage[:52] + word(60)) for j in range(3))) for k in range(60)]
    told = steps["repeated"](pa.concat_tables([steps["anchors"](t) for t in tables]))
    assert any(map(any, told.column("y").to_pylist()))


def test_repeats_over_small_transforms(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "TRANSFORM", 150)
    r = random.Random(9)
    word = lambda n: "".join(r.choices("ab ", k=n))
    phrases = [word(45) for _ in range(6)]
    docs = [(i, "".join(word(r.randint(0, 12)) + r.choice(phrases) for _ in range(6))) for i in range(40)]
    found = suffixes.dedup(spark.createDataFrame(docs, "doc_id long, text string"), 50)
    assert removed(found) == repeated([(i, t.encode()) for i, t in docs], 50)


def test_slabs_hold_whole_groups():
    from feedwright.llm.suffixes import _slabs

    sizes, group = [5, 5, 30, 5, 5, 5], [2, 2, 4, 4, 7, 8]
    assert _slabs(np.array(sizes), np.array(group), 12) == [slice(0, 4), slice(4, 5), slice(5, 6)]
    assert _slabs(np.array(sizes), np.array(group), 99) == [slice(0, 6)]
    assert _slabs(np.array(sizes), np.array(group), 10) == [slice(0, 2), slice(2, 4), slice(4, 5), slice(5, 6)]
    assert _slabs(np.array([], int), np.array([], int), 10) == []


def test_marking_repeats_calls_little_for_each_piece(frame, monkeypatch):
    steps = []
    plain = PandasCogroupedOps.applyInArrow
    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", lambda self, f, schema: steps.append(f) or plain(self, f, schema))
    suffixes.dedup(frame("doc_id long, text string", (1, "a")), 50)
    r = random.Random(3)
    texts = pa.table({"_id": range(4), "_text": ["".join(r.choices("abcdefghij ", k=20_000)) for _ in range(4)], "chunk": [0] * 4})
    # All anchors lie in another chunk too, and some of the windows in a smaller document there.
    told = pa.table({"chunk": [0, 0], "bucket": [0, 0], "kind": [0, 1], "x": [b"\xff" * 20_000, r.randbytes(20_000)], "y": [bytes(20_000), b""]})
    pieces, remove = steps
    sent = pieces(texts, told.slice(0, 1))
    n = sum(len(x) // 4 for x in sent.column("sizes").to_pylist())
    assert n > 5_000
    calls = [0]

    def count(frame, event, arg):
        calls[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        found = remove(texts, told)
    finally:
        sys.setprofile(None)
    assert found.num_rows == 4 and sum(map(len, found.column("spans").to_pylist())) > 0
    assert calls[0] < 5 * n


def test_interval_expansion_divides_where_strings_differ():
    texts = [b"banana bandana", b"ananas", b"banana", b"aaaaaaaaaa"]
    order, divided = suffixes.undivided(texts, 3)
    whole = b"".join(t + b"\x00" for t in texts)
    prefixes = [whole[i : i + 3] for i in order]
    inside = [k for k in range(1, len(order)) if b"\x00" not in prefixes[k] and b"\x00" not in prefixes[k - 1]]
    assert prefixes[1:] >= prefixes[:1] and all(divided[k] == (prefixes[k] != prefixes[k - 1]) for k in inside)


def chunked(docs):
    gear, seen, out = chunks.gear_values(), set(), []
    for i, t in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        ends = chunks.borders(np.frombuffer(t, np.uint8), gear).tolist()
        runs = []
        for s, e in zip([0, *ends[:-1]], ends):
            if t[s:e] in seen:
                runs[-1:] = [(runs[-1][0], e)] if runs and runs[-1][1] == s else [*runs[-1:], (s, e)]
            seen.add(t[s:e])
        out.append((i, len(t), [x for x in runs if x[1] - x[0] >= chunks.MIN_RUN]))
    return out


def test_chunks(spark):
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdefghijklmnop  ") for _ in range(n))
    passages = [text(600) for _ in range(3)]
    docs = [(i, text(r.randint(0, 400)) + r.choice(passages) + text(50)) for i in range(30)] + [(40, ""), (41, None), (42, "a" * 5000), (43, passages[0])]
    frame = spark.createDataFrame([*docs, (None, passages[0])], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], [tuple(s) for s in r["spans"]]) for r in chunks.dedup(frame).collect()}
    for i, n, runs in chunked([(i, (t or "").encode()) for i, t in docs]):
        assert got[i] == (n, runs)
    assert got[None] == (600, []) and sum(bool(v[1]) for v in got.values()) > 20
    assert chunks.dedup(frame.where("false")).count() == 0


def test_chunk_borders_come_back_after_an_insertion():
    text = np.random.default_rng(0).integers(97, 120, 20_000).astype(np.uint8)
    gear = chunks.gear_values()
    a = set(chunks.borders(text, gear).tolist())
    b = {e - 3 for e in chunks.borders(np.concatenate([text[:5000], text[:3], text[5000:]]), gear).tolist() if e > 5600}
    assert len(b & a) > 0.95 * len(b)


def test_every_passage_of_51_words_and_short_copies(spark):
    r = random.Random(51)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(r.randint(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    docs, places = [], {}
    for k in range(300):
        passage = text(51)
        for i in (2 * k, 2 * k + 1):
            before = text(r.randint(0, 60))
            docs.append((i, f"{before} {passage} {text(r.randint(0, 60))}"))
            places[i] = (len(before.encode()) + 1, len(passage.encode()))
    docs += [(1000, "short one"), (1001, "short one"), (1002, "another short one"), (1003, "é" * 64), (1004, "é" * 64), (1005, ""), (1006, "")]
    docs += [(1007, "x " * 30_000), (1008, "y" + "x " * 300)]
    found = chunks.dedup(spark.createDataFrame(docs, "doc_id long, text string"), sure=True).collect()
    spans = {x["doc_id"]: [tuple(s) for s in x["spans"]] for x in found}
    texts = {i: t.encode() for i, t in docs}
    for i, (start, size) in places.items():
        if i % 2:
            assert any(s < start + size and e > start for s, e in spans[i]), i
            # What goes is held by the text before, byte by byte.
            assert all(texts[i][s:e] in texts[i - 1] and e - s >= min(size, chunks.MIN_RUN) for s, e in spans[i])
        else:
            assert spans[i] == []
    assert spans[1001] == [(0, 9)] and spans[1004] == [(0, 128)]
    assert spans[1000] == spans[1002] == spans[1003] == spans[1005] == spans[1006] == []
    assert spans[1008] and spans[1008][-1][1] - spans[1008][0][0] > 300


@pytest.mark.parametrize("at_once", [1 << 18, 50])
def test_one_of_every_so_many_windows_is_taken(monkeypatch, at_once):
    monkeypatch.setattr(chunks, "AT_ONCE", at_once)
    chunks.powers.cache_clear()
    for text in (np.random.default_rng(2).integers(97, 120, 900).astype(np.uint8), np.full(900, 97, np.uint8)):
        for length, among in ((32, 40), (7, 1), (880, 40), (900, 3), (901, 3)):
            taken = chunks.least_windows(text, length, among)
            n = len(text) - length + 1
            assert all(any(k <= p < k + among for p in taken) for k in range(max(0, n - among + 1))) and len(taken) >= min(1, n)
            assert at_once == 50 or among == 1 or len(taken) <= 4 * len(text) / among
    chunks.powers.cache_clear()


def alike(vectors, threshold):
    good = {}
    for k, (i, v) in enumerate(vectors):
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[k] = np.array(v, dtype=np.float64)
    n, links = [0] * len(vectors), []
    for a, x in good.items():
        for b, y in good.items():
            if a < b and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                n[a] += 1
                n[b] += 1
                links.append((vectors[a][0], vectors[b][0]))
    comp = reached({i for i, _ in vectors if i is not None}, links)
    return sorted(((i, n[k], comp.get(i), i is None or comp[i] == i) for k, (i, _) in enumerate(vectors)), key=str)


@pytest.mark.parametrize("tile", [8192, 7])
def test_vectors(spark, tile):
    r = np.random.default_rng(1)
    centres = r.normal(size=(5, 16))
    vectors = [(int(i), (centres[i % 5] + r.normal(size=16) * r.choice([0.0, 0.05, 0.3, 0.5])).tolist()) for i in r.permutation(90)]
    vectors += [(100, (centres[0] * 3).tolist()), (101, (-centres[0]).tolist()), (102, None), (103, []), (104, [0.0] * 16), (105, [float("nan")] + [1.0] * 15)]
    vectors += [(106, [float("inf")] * 16), (107, [None] + [1.0] * 15), (108, [1.0, 2.0]), (109, [2.0, 4.1]), (110, [5.0]), (111, [7.0]), (None, centres[0].tolist())]
    for kind in ("float", "double"):
        rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) if kind == "float" else x for x in v]) for i, v in vectors]
        frame = spark.createDataFrame([(*v, 5) for v in rows], f"vec_id long, embedding array<{kind}>, n_links int")
        got = sorted((tuple(x) for x in embeddings.near_duplicates(frame, 0.9, tile=tile).collect()), key=str)
        assert got == alike(rows, 0.9)
    assert embeddings.near_duplicates(frame.where("false"), 0.9).count() == 0


def test_near_pairs_are_met_once(monkeypatch):
    import numpy as np

    monkeypatch.setattr(embeddings, "_ROWS", 7)
    monkeypatch.setattr(embeddings, "_COLUMNS", 3)
    own = np.random.default_rng(1).standard_normal((40, 3)).astype(np.float32)
    gap = np.square(own[:, None] - own[None]).sum(axis=2)
    h, p = np.arange(0, 25), np.arange(20, 40)
    for rows, columns in ((h, None), (h, p), (h[:0], p), (h[:0], None)):
        got = sorted((int(a), int(b)) for i, j in embeddings._near(own, rows, columns, 1.5) for a, b in zip(i, j))
        expected = [(a, b) for a in rows for b in (rows if columns is None else columns) if gap[a, b] <= 1.5 and (columns is not None or b < a)]
        assert got == sorted(expected)
