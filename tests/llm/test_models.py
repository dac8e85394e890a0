"""Language identification, toxicity and personal data: models against enumeration, held-out accuracy and plain rules."""

import itertools
import random
import re

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from feedwright.llm import language, pii, queries, toxicity


def test_languages_of_held_out_documents(spark):
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = queries.QUERIES["op9_language_id"](spark, SF).join(lang, "doc_id").where("held_out").select("lang", "lang_pred").collect()
    assert sum(r[0] == r[1] for r in found) >= 0.95 * len(found) > 20


def test_words_come_before_their_letters():
    rows = [("aa", 0, "tree", 5), ("bb", 0, "baum", 5), *(("aa", n, g, 1) for n in language.ORDERS for g in language.grams("zzz", n))]
    rows += [("bb", n, g, 9) for n in language.ORDERS for g in language.grams("tre", n)]
    model = language.Model(rows)
    assert model.judge("Tree")[0] == "aa" and model.judge("baum")[0] == "bb"
    assert model.judge("zz")[0] == "aa" and model.judge("tr")[0] == "bb"  # unseen words, by their n-grams


def test_odd_texts_and_languages(spark):
    rows = [(i, t, lang, 0.0) for i, (t, lang) in enumerate([("uno dos tres", "es"), ("one two three", "en"), (None, "en"), ("uno", None), ("12 3.4 \x00", "en"), ("", "es")])]
    docs = spark.createDataFrame([*rows, (None, "one " * 50_000, "en", 0.0), *rows[:2]], "doc_id long, text string, lang string, score double")
    got = [(r["lang_pred"], r["score"]) for r in language.identify(docs, language.fit(docs.limit(6))).collect()]
    assert [g[0] for g in got] == ["es", "en", "und", "es", "und", "und", "en", "es", "en"]
    assert all(0 <= g[1] <= 1 for g in got) and got[2][1] == 0
    assert [r["lang_pred"] for r in language.identify(docs.limit(2), language.fit(docs.where("false"))).collect()] == ["und"] * 2
    assert language.identify(docs.where("false"), language.fit(docs)).count() == 0


def test_a_text_larger_than_the_store(monkeypatch):
    rows = [("a", 0, "x", 1), ("b", 1, "q", 1)]
    text = " ".join("q" * k for k in range(1, 30))
    whole = language.Model(rows).judge(text)
    monkeypatch.setattr(language, "CACHE", 10)
    assert language.Model(rows).judge(text) == pytest.approx(whole)


def test_chain_against_all_taggings():
    r = np.random.default_rng(2)
    moves = r.normal(size=(2, 2))
    lengths = [0, 1, 4, 7, 0, 3]
    evidence = r.normal(size=sum(lengths)) * 2
    expected, moved, at = [], np.zeros((2, 2)), 0
    for n in lengths:
        e, at = evidence[at : at + n], at + n
        total, on, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for tags in itertools.product((0, 1), repeat=n):
            steps = list(zip((0, *tags), tags))
            w = np.exp(sum(moves[s] for s in steps) + sum(x for x, t in zip(e, tags) if t))
            total += w
            on += w * np.array(tags)
            for s in steps:
                pairs[s] += w
        expected += list(on / total) if n else []
        moved += pairs / total if n else 0
    got, got_moved = toxicity.chain(evidence, np.array(lengths), moves, pairs=True)
    assert got == pytest.approx(np.array(expected)) and got_moved == pytest.approx(moved)


def test_long_texts_are_linked_over_their_blocks(monkeypatch):
    r = np.random.default_rng(3)
    evidence, lengths, moves = r.normal(size=3000), np.array([2500, 500]), np.array([[1.0, -1.0], [-1.0, 1.5]])
    one = toxicity.chain(evidence, lengths, moves)
    monkeypatch.setattr(toxicity, "BLOCK", 4096)
    assert toxicity.chain(evidence, lengths, moves) == pytest.approx(one)


def test_toxic_documents_and_places(spark):
    r = random.Random(1)
    plain = lambda n: [r.choice("the of and tion with from this that".split()) for _ in range(n)]
    docs, labels = [], []
    for i in range(160):
        w = plain(60)
        if i % 4 == 0:
            for k in (10, 30, 50):
                w[k] = r.choice(["nasty", "vilexa", "vilexo", "vilexu"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(d, y, F.col("doc_id") < 120)
    odd = [(500, "of the vilexzz and then nasty words vilexa"), (501, None), (502, ""), (None, "the of and")]
    new = spark.createDataFrame([*docs[120:], *odd], "doc_id long, text string").withColumn("score", F.lit("x"))
    got = toxicity.score(new, model).collect()
    assert all((g["score"] >= 0.5) == (i % 4 == 0) for g, i in zip(got, range(120, 160)))
    assert got[0]["spans"] == [(10, 11), (30, 31), (50, 51)]
    assert [g["score"] >= 0.5 for g in got[40:]] == [True, False, False, False]
    nothing = toxicity.fit(d.where("false"), y)
    assert {g["score"] for g in toxicity.score(new, nothing).collect()} == {0.0}


_BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_rules(text):
    out = []
    for kind, rule in _BASE.items():
        for m in rule.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0,
                "phone": 9 <= len(d) <= 15,
            }[kind]
            out += [(kind, *m.span())] if ok else []
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_rules_find_what_the_patterns_find():
    r = random.Random(9)
    pool = ["@", ".", "-", " ", "+", "(", ")", "a", "B", "é", "0", "1", "9", "4111111111111111", "255.", "1.2.3.4", "x@y.zz", "٣"]
    for _ in range(4000):
        text = "".join(r.choice(pool) for _ in range(r.randint(0, 25)))
        assert pii.base_spans(text) == plain_rules(text), text


def test_a_long_run_is_searched_once():
    text = "1" * 200_000 + "a" * 200_000 + "@" * 50_000
    assert pii.base_spans(text) == []


def test_slopes_of_the_tagger():
    t = pii.Tagger()
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    r = np.random.default_rng(0)
    x, y = r.integers(0, pii.CLASSES, (2, 24)), r.integers(0, t.TAGS, (2, 24))
    _, slopes = t.slopes(x, y)
    for name, values in t.p.items():
        at = np.unravel_index(np.abs(slopes[name]).argmax(), values.shape)
        losses = []
        for step in (1e-4, -2e-4):
            values[at] += step
            losses.append(t.slopes(x, y)[0])
        values[at] += 1e-4
        assert (losses[0] - losses[1]) / 2e-4 == pytest.approx(slopes[name][at], rel=1e-2)


def test_tagger_adds_other_spellings(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tagger = pii.fit(docs)
    texts = [f"please write to {t} or come by some day" for t in ("anna.berg @ mail7.example.com", "(415) 555-2671", "10 . 20 . 30 . 40")]
    added = [pii.all_spans(pii.base_spans(t), s) for t, s in zip(texts, tagger.spans(texts))]
    assert sum(bool(a) for a in added) >= 2
    rows = [(1, "mail a.b@c.de, call +1 (415) 555-2671"), (2, None), (3, ""), (None, "4111 1111 1111 1111"), (1, "x" * 300_000 + " 1.2.3.4")]
    new = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, n_email string")
    got = pii.detect(new, tagger, pii.FIGURES, pii.figures).collect()
    for (_, text), g in zip(rows, got):
        base = plain_rules(text or "")
        assert [g[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        assert {pii.listed([b]) for b in base} <= set(g["spans"].split(","))
    assert pii.mask(new, tagger).collect()[0]["masked"] == "mail <email>, call <phone>"
    assert pii.detect(new.where("false"), tagger, pii.FIGURES, pii.figures).count() == 0
    assert isinstance(pii.fit(docs.where("false")), pii.Tagger)


def test_windows_are_read_as_one_text():
    tags = np.zeros((3, pii.HALF), dtype=int)
    tags[0, -6:], tags[1, :8] = 2, 2
    text = "." * (pii.HALF - 6) + "10.20.30.40.99"[:14] + " " * 200
    text = text[: pii.HALF - 6] + "10.220.130.140" + text[pii.HALF + 8 :]
    places = np.array([0, 1, 3]) * pii.HALF
    assert pii.read_tags(text, places, tags) == [("ip", pii.HALF - 6, pii.HALF + 8)]


def test_samples_have_an_exact_size(spark):
    """A share of far less than a millionth would be needed for a table as large as the ratio here; size is by rank."""
    from feedwright.llm.text import drawn

    rows = spark.range(50_000).select("id", (F.col("id") % 3).cast("string").alias("kind"), F.concat(F.lit("text "), "id").alias("text"))
    sample = drawn(rows, 1, (F.col("id"),), "kind")
    assert sample.groupBy("kind").count().where("count = 1").count() == 3
    assert drawn(rows, 10, (F.col("id"),)).count() == 10
    # The same rows, however the table is laid out.
    assert sorted(drawn(rows.repartition(7), 10, (F.col("id"),)).collect()) == sorted(drawn(rows, 10, (F.col("id"),)).collect())
    assert drawn(rows.where("false"), 10, (F.col("id"),), "kind").count() == 0
    assert drawn(rows.limit(4), 10, (F.col("id"),)).count() == 4
    copies = rows.select(F.lit(None).cast("long").alias("id"), "kind", F.lit("same").alias("text"))
    assert drawn(copies, 10, (F.col("id"), F.col("text")), "kind").count() == 3


def test_fits_with_null_and_repeated_ids(spark):
    n = 10_000
    docs = spark.range(n).select(
        F.when(F.col("id") % 2 == 0, None).otherwise(7).alias("doc_id"), F.concat_ws(" ", F.lit("some words"), F.col("id") % 40).alias("text"), F.lit("en").alias("lang")
    )
    counts = {(lang, order): 0 for lang, order in [("en", 0)]}
    for lang, order, _, count in language.fit(docs, per_lang=20):
        if order == 0:
            counts[lang, order] += count
    # 20 documents of two words, and of the number that is no word.
    assert counts == {("en", 0): 40}
    labels = spark.createDataFrame([(7, 1), (7, 0), (8, 0)], "doc_id long, toxic int")
    assert toxicity.fit(docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(8))), labels, toxic_docs=5, other_docs=5) is not None
    assert pii.fit(docs, sample=3) is not None


def test_words_and_letters_against_a_plain_scorer():
    """Every word by its own log frequency, an unseen one by the mean of its longest known n-grams."""
    rng = random.Random(9)
    rows = [(lang, 0, "".join(rng.choice("abc") for _ in range(rng.randint(1, 4))), rng.randint(1, 9)) for lang in ("x", "y", "z") for _ in range(12)]
    rows = list({r[:3]: r for r in rows}.values())
    spelt = {}
    for lang, _, word, n in rows:
        for order in language.ORDERS:
            for gram in language.grams(word, order):
                spelt[lang, order, gram] = spelt.get((lang, order, gram), 0) + n
    rows += [(*k, n) for k, n in spelt.items() if k[2] != "^a"]

    def level(order, lang, gram):
        known = {r[2] for r in rows if r[1] == order}
        counts = {r[2]: r[3] for r in rows if r[1] == order and r[0] == lang}
        return np.log((counts.get(gram, 0) + 0.5) / (sum(counts.values()) + 0.5 * len(known))) if gram in known else None

    def word_score(lang, word):
        own = level(0, lang, word)
        if own is not None:
            return own
        for order in language.ORDERS:
            found = [s for s in (level(order, lang, g) for g in language.grams(word, order)) if s is not None]
            if found:
                return float(np.mean(found))
        return 0.0

    model = language.Model(rows)
    for _ in range(60):
        words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 5))]
        scores = {lang: np.mean([word_score(lang, w) for w in words]) for lang in ("x", "y", "z")}
        lang, certainty = model.judge(" ".join(words))
        best = max(scores.values())
        assert scores[lang] == pytest.approx(best)
        weights = {k: np.exp((s - best) * min(len(words), 30)) for k, s in scores.items()}
        assert certainty == pytest.approx(weights[lang] / sum(weights.values()))


def test_best_tags_against_all_taggings():
    tagger = pii.Tagger()
    rng = np.random.default_rng(4)
    tagger.p["moves"] = rng.normal(size=tagger.p["moves"].shape).astype(np.float32)
    x = rng.integers(0, 5, (6, 4))
    e, best = tagger.emissions(x), tagger.best(x)

    def total(row, tags):
        return sum(e[t, row, k] for t, k in enumerate(tags)) + sum(tagger.p["moves"][a, b] for a, b in zip(tags, tags[1:]))

    for row in range(len(x)):
        highest = max(total(row, tags) for tags in itertools.product(range(tagger.TAGS), repeat=x.shape[1]))
        assert total(row, best[row].tolist()) == pytest.approx(highest, abs=1e-4)


def test_score_of_a_document_from_its_marginals():
    """Sum, rate and largest of the marginals, weighed as the fit says, computed word by word."""
    model = toxicity.Model({}, 0.0, np.zeros((2, 2)), (np.array([0.5, -0.25, 2.0, 0.1]), np.array([0.2, 1.0, 0.3]), np.array([1.0, 2.0, 0.5])))
    marginals, lengths = np.array([0.1, 0.9, 0.4, 0.2]), [2, 0, 2]
    at, expected = 0, []
    for n in lengths:
        own, at = marginals[at : at + n].tolist(), at + n
        figures = [np.log(1 + sum(own)), np.log(1 + 200 * sum(own) / n), max(own)] if n else [0.0, 0.0, 0.0]
        z = sum(w * (f - c) / s for w, f, c, s in zip([0.5, -0.25, 2.0], figures, [0.2, 1.0, 0.3], [1.0, 2.0, 0.5])) + 0.1
        expected.append(1 / (1 + np.exp(-z)))
    assert model.scores(marginals, lengths).tolist() == pytest.approx(expected)
