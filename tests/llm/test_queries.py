"""Registered queries and the pipeline."""

import base64
import hashlib
import re

import duckdb
import public_tokenizers
import pytest
import tiktoken
from conftest import SF
from test_copies import near
from test_words import hits

import corpus_pipeline
from feedwright.llm import pii
from feedwright.llm.queries import ORACLES, QUERIES, RANKS


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = QUERIES[name](spark, SF)
    got = sorted(tuple(r) for r in found.collect())
    assert got == sorted(con.execute(f"select {', '.join(found.columns)} from ({ORACLES[name]})").fetchall())


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["start"] = docs.toPandas()
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, SF).toPandas().sort_values("doc_id")
        out[name] = rows
        docs = spark.createDataFrame(rows) if name != "token_ids" else None
    return out


def test_stages_keep_their_columns_and_clean_documents(stages):
    for name, rows in stages.items():
        assert name == "token_ids" or sorted(rows.columns) == sorted(corpus_pipeline.COLUMNS)
        assert rows["doc_id"].is_unique
    assert len(stages["language"]) == len(stages["start"])
    assert len(stages["token_ids"]) == len(stages["personal_data"]) == len(stages["decontamination"])


def test_near_duplicates_stage(stages):
    docs = list(stages["language"][["doc_id", "text"]].itertuples(index=False, name=None))
    assert sorted(i for i, *_, kept in near(docs, 5, 80) if kept) == sorted(stages["near_duplicates"]["doc_id"])


def test_decontamination_stage(stages):
    docs = list(stages["near_duplicates"][["doc_id", "text"]].itertuples(index=False, name=None))
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    assert sorted(i for i, _, n, _ in hits(docs, items, 10) if not n) == sorted(stages["decontamination"]["doc_id"])


def test_personal_data_stage(stages):
    before, after = (stages[k].set_index("doc_id") for k in ("decontamination", "personal_data"))
    for i, text in before["text"].items():
        new = after.loc[i, "text"]
        base = pii.base_spans(text)
        assert after.loc[i, "n_chars"] == len(new) and (base or "<" not in new or text == new or pii.base_spans(new) == [])
        assert all(text[s:e] not in new for _, s, e in base)
        if not re.search("[0-9@]", text):
            assert new == text


def test_token_stage(stages):
    with open(public_tokenizers.path(RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    expected = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = stages["token_ids"].set_index("doc_id")
    for i, text in stages["personal_data"].set_index("doc_id")["text"].items():
        assert list(rows.loc[i, "ids"]) == expected.encode_ordinary(text)
        assert rows.loc[i, "decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_odd_rows_pass_the_pipeline(spark, tmp_path):
    text = "these are some plain words that stand here for a while and then end"
    rows = [(1, text, "en", "s", 5, 1), (2, text, None, None, None, 1), (None, text + " again and again", "en", "s", 1, 1), (3, None, "en", "s", 1, 1), (4, "", "en", "s", 1, 1), (1, text, "en", "s", 5, 1)]
    rows += [(9, text + " but this one goes on. " * 20_000, "en", "s", 1, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == [1, 9, None]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0


def test_stages_hand_on_parquet_and_one_rule_rejects(spark, tmp_path):
    plain = {"en": "these are some plain words that stand here for a while", "de": "das sind einige Worte und hier stehen noch mehr davon"}
    rows = [(n, plain[lang], lang, "s", 1) for n, lang in enumerate(["en", "de"] * 10)]
    rows += [(50, "1234 5678", None, "s", 1), (51, "these are plain words", None, "s", 1), (52, "das sind Worte", None, "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.rewritten(corpus_pipeline.known_language(spark, docs, str(tmp_path)))
    assert all(f.endswith(".parquet") for f in kept.inputFiles())
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {50}


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace as Of

    from feedwright.llm.components import checkpoint_folder

    none = Of(isDefined=lambda: False)
    context = Of(_jsc=Of(sc=lambda: Of(getCheckpointDir=lambda: none)), master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_folder(Of(sparkContext=context, conf=Of(get=lambda *_: None)))
