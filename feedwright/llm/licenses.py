"""License scan by diagonal voting.

Each text is a sequence of words; every run of ``GRAM`` words is hashed and joined to the places where the templates
have the same run. A match at text position p and template position t votes for the diagonal p - t. Votes of one
diagonal and of its neighbours (words inserted or left out) are merged into spans, and a span counts when enough of
the template's words are really there.

Hashes only find candidates: the joined runs are compared word by word before they vote.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a run: two, since the shortest phrase has two words.
GRAM = 2
#: Diagonals of a template that are this close, and follow each other within this many words, belong together.
DRIFT = 4
#: Shares of a template's words that a span must hold.
AGREE = 0.7

#: What the end of a text is joined by.
END = 0
_TEMPLATE = ["template", "label", "phrase", "length"]

_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Template:
    """A wording to look for. A phrase must stand word for word; other templates may be met in part."""

    label: str
    text: str
    phrase: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()


# Phrases that name a license.
PHRASES = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
)
# Usual opening words of license notices.
NOTICES = (
    Template("apache-notice", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    Template("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-notice", "this work is licensed under a creative commons attribution international license"),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("isc-notice", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("mpl-notice", "this source code form is subject to the terms of the mozilla public license"),
    Template("unlicense-notice", "this is free and unencumbered software released into the public domain"),
)


def text_words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; a null text has none."""
    folded = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _UPPER.lower())
    return F.array_remove(F.split(folded, _WORD, -1), "")


def template_runs(spark: SparkSession, templates) -> DataFrame:
    """Hash, words and place of every run of the templates, as many rows as the templates have words, and the row that
    the end of each text is joined to (template -1)."""
    rows: list[tuple] = [(-1, None, True, 0, 0, [])]
    for k, t in enumerate(templates):
        w = t.words
        if len(w) < GRAM:
            raise ValueError(f"template {t.label} has fewer than {GRAM} words")
        rows += [(k, t.label, t.phrase, len(w), at, w[at : at + GRAM]) for at in range(len(w) - GRAM + 1)]
    runs = spark.createDataFrame(rows, "template int, label string, phrase boolean, length int, at int, run array<string>")
    return runs.withColumn("hash", F.when(F.col("template") < 0, F.lit(END).cast("long")).otherwise(_run_hash(lambda k: F.get("run", F.lit(k)))))


def _run_hash(word) -> Column:
    return F.xxhash64(*[word(k) for k in range(GRAM)])


def votes(docs: DataFrame, templates=PHRASES + NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every verified match of a run: _id, _copy (tells apart different texts of one id), the template's columns, the
    place in the template and the diagonal. Each text also has one row of template -1 whose diagonal is its length.

    The templates are a parameter of a few hundred words (checked), hence the broadcast.
    """
    if sum(len(t.words) for t in templates) > 100_000:
        raise ValueError("too many template words to send to every task")
    runs = F.broadcast(template_runs(docs.sparkSession, templates))
    text = F.col(text_col).cast("string")
    tokens = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_copy"), text_words(text).alias("_words"))
    hashes = F.transform("_words", lambda w, i: _run_hash(lambda k: F.get("_words", i + k) if k else w))
    # The hashes are a column of their own: generating rows from a plain column stays in generated code, which carries
    # the words along by reference instead of copying them into every row.
    hashed = tokens.select("_id", "_copy", "_words", F.concat(hashes, F.array(F.lit(END).cast("long"))).alias("_hashes"))
    # There always is a row, so the outer form gives the same and spares a filter on the size of the hashes.
    rolled = hashed.select("_id", "_copy", "_words", F.posexplode_outer("_hashes").alias("_pos", "hash"))
    found = F.slice("_words", F.col("_pos") + 1, GRAM)
    # Two comparisons instead of an equality, which would become a join key and be computed for every run of the corpus.
    return rolled.join(runs, (rolled.hash == runs.hash) & (found <= runs.run) & (found >= runs.run)).select(
        "_id", "_copy", *_TEMPLATE, "at", (F.col("_pos") - F.col("at")).alias("diagonal")
    )


def spans(docs: DataFrame, templates=PHRASES + NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Merged and verified spans: _id, _copy, the template's columns, start, end (words, end exclusive), share of the
    template met and rows (how many equal texts of the id hold it); template -1 as in ``votes``."""
    key = ["_id", "_copy", *_TEMPLATE]
    exact = F.col("phrase")
    # The votes of a diagonal are places in the template, at most as many as it has words.
    diagonals = votes(docs, templates, id_col, text_col).groupBy(*key, "diagonal").agg(
        F.collect_set("at").alias("hits"), F.count(F.lit(1)).alias("n")
    )
    # A phrase keeps to its diagonal. Others fall into two overlapping layers of bands, so that diagonals that differ
    # by up to DRIFT meet in one of them.
    wide = 2.0 * DRIFT
    bands = F.array(F.floor(F.col("diagonal") / wide) + F.lit(0.0), F.floor((F.col("diagonal") + DRIFT) / wide) + F.lit(0.5))
    merged = (
        diagonals.withColumn("band", F.explode(F.when(exact, F.array(F.col("diagonal").cast("double"))).otherwise(bands)))
        .groupBy(*key, "band")
        .agg(
            F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
            F.min(F.col("diagonal") + F.array_min("hits")).cast("long").alias("start"),
            F.max(F.col("diagonal") + F.array_max("hits") + F.when(F.col("template") < 0, 0).otherwise(GRAM)).cast("long").alias("end"),
            (F.max("n") / F.max(F.size("hits"))).cast("long").alias("rows"),
        )
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h, h + GRAM - 1)))))
    share = F.when(F.col("template") < 0, 0.0).otherwise(covered / F.col("length"))
    good = merged.withColumn("share", share).where(F.when(F.col("template") < 0, True).when(exact, F.col("share") == 1).otherwise(F.col("share") >= AGREE))
    # The two layers see most spans twice.
    return good.groupBy(*key, "start").agg(F.max("end").alias("end"), F.max("share").alias("share"), F.max("rows").alias("rows"))


def scan(docs: DataFrame, templates=PHRASES + NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per id: n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base figures count the phrases, labels names the notices too; score is 1 where a phrase stands, else the best
    share of a notice's words met. Rows that repeat an id are added up, each text judged on its own; a null id is an id
    of its own; null and empty texts have no words. The corpus is read once and no text is shuffled.
    """
    base = F.col("phrase") & (F.col("template") >= 0)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (
        spans(docs, templates, id_col, text_col)
        .groupBy("_id")
        .agg(
            F.sum(F.when(F.col("template") < 0, F.col("start") * F.col("rows")).otherwise(F.lit(0))).alias("n_words"),
            F.sum(F.when(base, F.col("rows")).otherwise(F.lit(0))).alias("n_base"),
            F.min(F.when(base, F.col("start"))).alias("first_word"),
            F.max(F.when(base, F.col("start"))).alias("last_word"),
            joined(F.when(base, F.col("label"))).alias("base_labels"),
            joined("label").alias("labels"),
            F.max("share").alias("score"),
        )
        .withColumnRenamed("_id", id_col)
    )
