"""License scan and benchmark decontamination against plain searches."""

import functools
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from feedwright.llm import decontaminate, licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def hits(docs, items, width):
    out = []
    for doc_id, text in docs:
        w, marked, found = words(text), set(), set()
        for item_id, item in items:
            p = words(item)
            n = min(width, len(p))
            for window in {tuple(p[i : i + n]) for i in range(len(p) - n + 1)} if n else ():
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) == window:
                        marked |= set(range(k, k + n))
                        found |= {str(item_id)} if item_id is not None else set()
        out.append((doc_id, len(w), len(marked), sorted(found)))
    return sorted(out, key=str)


def result(found):
    return sorted(
        ((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), list(r["items"])) for r in found.collect()), key=str
    )


@pytest.mark.parametrize("passes", [10_000, 7])
def test_hits_are_those_of_a_plain_search(spark, passes):
    r = random.Random(4)
    text = lambda n: " ".join(r.choice("ab cd ef gh Ij Été".split()) for _ in range(n))
    docs = [(i, text(r.choice([0, 1, 3, 40, 200]))) for i in range(30)] + [(None, text(50)), (3, text(30)), (3, text(30)), (99, None), (98, " .,; ")]
    items = [(i, text(r.choice([1, 2, 3, 5, 9]))) for i in range(12)] + [(1, text(4)), (None, text(3)), (50, None), (51, "..")]
    d = spark.createDataFrame([(*x, 1, "s", "i") for x in docs], "doc_id long, text string, n_words int, spans string, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert result(decontaminate.contamination(d, b, width=4, patterns_per_pass=passes)) == hits(docs, items, 4)


@pytest.mark.parametrize("passes", [1, 3, 500_000])
def test_further_columns_go_through_all_passes(spark, passes):
    docs = [(1, "a b c d e", "en"), (2, "x y z", "de"), (3, None, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    items = spark.createDataFrame([(1, "a b c"), (2, "c d e"), (3, "q r s t")], "item_id long, text string")
    found = decontaminate.contamination(frame, items, width=2, patterns_per_pass=passes, also=("text", "lang"))
    assert found.columns == ["doc_id", "text", "lang", "n_words", "spans", "items"]
    got = {r["doc_id"]: (r["doc_id"], r["text"], r["lang"], [tuple(s) for s in r["spans"]], r["items"]) for r in found.collect()}
    assert got == {1: (*docs[0], [(0, 5)], ["1", "2"]), 2: (*docs[1], [], []), 3: (*docs[2], [], [])}


def test_pipeline_stage_with_several_passes(spark, monkeypatch):
    items = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(14))), (2, "x y z")], "item_id long, text string")
    docs = [(1, " ".join(f"W{k}" for k in range(2, 13)), "en", "s", 30), (2, "x y", "de", "t", 3), (3, "a x, y z", "de", "t", 8), (4, None, "de", "t", None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(corpus_pipeline, "read", lambda *_: items)
    monkeypatch.setattr(decontaminate, "contamination", functools.partial(decontaminate.contamination, patterns_per_pass=2))
    kept = corpus_pipeline.not_in_benchmark(spark, frame, "")
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    assert sorted(tuple(r) for r in kept.collect()) == [docs[1], docs[3]]


def test_jumps_find_what_stands_at_the_ends():
    s = decontaminate.searchers([("a b c d", ["1"]), ("c d e f", ["2"]), ("x", ["3"])])
    found = [(k, sorted(i)) for t in s for k, i in t.find("a b c d e f x".encode().split())]
    assert found == [(6, ["3"]), (0, ["1"]), (2, ["2"])]


def test_nothing_to_search_or_search_in(spark, frame):
    docs, items = frame("doc_id long, text string", (1, "a b c")), frame("item_id long, text string", (1, "b"))
    assert result(decontaminate.contamination(docs, items.where("false"))) == [(1, 3, 0, [])]
    assert result(decontaminate.contamination(docs.where("false"), items)) == []


def licensed(docs):
    phrases = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
    out = {}
    for doc_id, text in docs:
        w = words(text)
        places = [(k, label) for label, p in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        out.setdefault(doc_id, [0, []])
        out[doc_id][0] += len(w)
        out[doc_id][1] += places
    return sorted(
        ((i, n, len(p), min(p)[0] if p else None, max(p)[0] if p else None, ",".join(sorted({x for _, x in p}))) for i, (n, p) in out.items()), key=str
    )


def test_phrases_are_counted_as_in_a_plain_search(spark):
    r = random.Random(5)
    pool = "mit license apache general public License gnu MIT, été".split()
    docs = [(i, " ".join(r.choice(pool) for _ in range(r.choice([0, 1, 2, 30, 300])))) for i in range(40)]
    docs += [(None, "mit license"), (7, "general public"), (7, "x public license"), (8, "mit license"), (8, "mit license"), (91, None), (92, "--")]
    d = spark.createDataFrame([(*x, 0.5, "l") for x in docs], "doc_id long, text string, score double, label string")
    found = licenses.scan(d)
    base = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert sorted((tuple(x) for x in found.select(*base).collect()), key=str) == licensed(docs)
    assert found.where(F.col("score").isNull() | (F.col("score") < 0) | (F.col("score") > 1)).isEmpty()


def test_altered_notices_are_found_by_neighbouring_diagonals(spark, frame):
    notice = next(t.text for t in licenses.NOTICES if t.label == "mit-notice")
    w = notice.split()
    inserted = "some words " + " ".join(w[:9] + ["really"] + w[9:]) + " and so on"
    cut = " ".join(w[: len(w) // 3])
    found = licenses.scan(frame("doc_id long, text string", (1, inserted), (2, cut), (3, notice.upper()), (4, "nothing here")))
    got = {r["doc_id"]: (r["labels"], round(r["score"], 2)) for r in found.collect()}
    assert got[1][0] == got[3][0] == "mit-notice" and got[3][1] == 1.0 and got[1][1] > 0.8
    assert got[2] == got[4] == ("", 0.0)


def test_scan_of_an_empty_table(frame):
    assert licenses.scan(frame("doc_id long, text string", (1, "a")).where("false")).count() == 0
