"""Byte-level BPE against the library that reads the same ranks."""

import base64

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from feedwright.llm import bpe
from feedwright.llm.queries import RANKS

PATH = public_tokenizers.path(RANKS)
TOKENS = bpe.read_ranks(PATH)
CODEC = bpe.Codec(TOKENS, bpe.model_proto(TOKENS), public_tokenizers.PATTERN)
with open(PATH, "rb") as lines:
    _RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
EXPECTED = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_RANKS, special_tokens={})
ODD = ["", " ", "\n\n  a", "\x00\x01\x1c\x1f", "日本語 한국어 🙂🙂", "a" * 5000, "zq" * 3000, "don't 'LL 123456 ½ Ⅷ ² _x_ \xa0\x85 c", "<|endoftext|>"]


def test_odd_texts():
    ids = CODEC.encode([t.encode() for t in ODD])
    assert ids == [EXPECTED.encode_ordinary(t) for t in ODD]
    assert [CODEC.decode(i).decode() for i in ids] == ODD


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    (ids,) = CODEC.encode([text.encode()])
    assert CODEC.decode(ids) == text.encode()
    assert CODEC.listed(ids) == ",".join(map(str, ids))
    # The two libraries know different Unicode versions; text of assigned characters is cut alike.
    if all(ord(c) < 0x3000 for c in text):
        assert ids == EXPECTED.encode_ordinary(text)


def test_a_small_store_of_pretokens_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    texts = ["some words that follow", "words that follow some", "other words"] * 3
    assert [CODEC.encode([t.encode()])[0] for t in texts] == [EXPECTED.encode_ordinary(t) for t in texts]


def test_rows(spark):
    rows = [(1, "a b", "x"), (None, None, "x"), (1, "a b", "y"), (2, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode(docs, PATH, public_tokenizers.PATTERN).collect()
    assert [(r["doc_id"], list(r["ids"])) for r in got] == [(i, EXPECTED.encode_ordinary(t or "")) for i, t, _ in rows]
    assert bpe.encode(docs.where("false"), PATH, public_tokenizers.PATTERN).count() == 0
