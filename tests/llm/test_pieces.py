"""SentencePiece through the table of distinct chunks, against the library on whole texts."""

import hashlib

import public_tokenizers
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from sentencepiece import sentencepiece_model_pb2 as pb

from feedwright.llm import pieces
from feedwright.llm.queries import PIECES, QUERIES

PATH = public_tokenizers.path(PIECES)
with open(PATH, "rb") as file:
    MODEL = file.read()
LIBRARY = SentencePieceProcessor(model_proto=MODEL)
TABLE = pieces.ChunkTable(MODEL)
ODD = [
    "", " ", "  ", "a", " a", "a ", "  a   b  ", " " * 100, "\n\n\t x", "▁", "a▁b ▁ c", "<s>", "</s> <unk>", "<0x41>",
    "日本語 🙂🙂 한국어", "\x00 \x01", "\xa0　x", "a" * 20_000, "zq " * 3000, "é é", "⁇",
]


def test_odd_texts():
    ids = TABLE.encode(ODD)
    assert [i.tolist() for i in ids] == LIBRARY.encode(ODD)
    assert [TABLE.decode(i) for i in ids] == [LIBRARY.decode(i) for i in LIBRARY.encode(ODD)]
    assert [TABLE.listed(i) for i in ids] == [",".join(map(str, i)) for i in LIBRARY.encode(ODD)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" ▁abt\n"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=4))
def test_any_texts(texts):
    assert [i.tolist() for i in TABLE.encode(texts)] == [LIBRARY.encode(t) for t in texts]


def test_small_tables_change_nothing(monkeypatch):
    texts = [f"words  and more words {i} that follow" for i in range(40)]
    for name, value in (("CHUNKS", 3), ("CHARS", 10), ("TOGETHER", 50)):
        monkeypatch.setattr(pieces, name, value)
        table = pieces.ChunkTable(MODEL)
        assert [i.tolist() for _ in range(2) for i in table.encode(texts)] == LIBRARY.encode(texts) * 2


def test_models_that_cannot_be_cut_are_refused():
    def changed(change):
        proto = pb.ModelProto()
        proto.ParseFromString(MODEL)
        change(proto)
        return proto.SerializeToString()

    for change in (
        lambda p: setattr(p.pieces[500], "piece", "of▁the"),
        lambda p: setattr(p.pieces[500], "type", pb.ModelProto.SentencePiece.USER_DEFINED),
        lambda p: setattr(p.normalizer_spec, "remove_extra_whitespaces", True),
        lambda p: setattr(p.trainer_spec, "model_type", pb.TrainerSpec.UNIGRAM),
        lambda p: setattr(p.trainer_spec, "treat_whitespace_as_suffix", True),
    ):
        with pytest.raises(ValueError):
            pieces.check_model(changed(change))
    plain = changed(lambda p: setattr(p.normalizer_spec, "add_dummy_prefix", False))
    assert [i.tolist() for i in pieces.ChunkTable(plain).encode(ODD)] == SentencePieceProcessor(model_proto=plain).encode(ODD)


def test_rows(spark):
    rows = [(1, "a b", "x"), (None, None, "x"), (1, "a b", "y"), (2, "", "z"), (3, "long " * 50_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = pieces.round_trip(docs, PATH).collect()
    assert [(r["doc_id"], list(r["ids"]), r["decoded"]) for r in got] == [
        (i, LIBRARY.encode(t or ""), LIBRARY.decode(LIBRARY.encode(t or ""))) for i, t, _ in rows
    ]
    assert pieces.encode(docs.where("false"), PATH).count() == 0
    kept = pieces.encode(docs.withColumnRenamed("ids", "source"), PATH, also=("source",))
    assert kept.columns == ["doc_id", "source", "ids"] and kept.count() == len(rows)


def test_query(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op12_sentencepiece"](spark, SF).collect()}

    def expected(text):
        ids = LIBRARY.encode(text or "")
        return len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), LIBRARY.decode(ids)))

    assert got == {i: expected(t) for i, t in texts.items()}
