"""Byte-level BPE with a sentencepiece model written directly from a rank file.

Every byte becomes one printable character (the usual byte alphabet of byte-level vocabularies), every rank a piece
scored by the negative rank, so that sentencepiece's best-scoring merge is the lowest-ranked merge; normalisation is
the identity. Texts are cut into pre-tokens, each pre-token is encoded on its own, ids are decoded by the inverse map.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructField

from feedwright.llm.text import per_document

#: Pre-tokens that a task keeps with their ids; beyond it the store starts anew.
CACHE = 150_000


def byte_alphabet() -> list[str]:
    """The character of each byte: printable Latin-1 characters stand for themselves, the rest follow from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank of a rank file (base64 token and rank in each line)."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in lines if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks are not 0 to n-1")
    return [ranks[i] for i in range(len(ranks))]


def model_proto(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose piece ids are the ranks."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    alphabet = byte_alphabet()
    model = pb.ModelProto()
    for rank, token in enumerate(tokens):
        piece = model.pieces.add()
        piece.piece, piece.score = "".join(alphabet[b] for b in token), -float(rank)
    unknown = model.pieces.add()
    unknown.piece, unknown.score, unknown.type = "<unk>", 0.0, pb.ModelProto.SentencePiece.UNKNOWN
    spec = model.trainer_spec
    spec.model_type, spec.vocab_size, spec.unk_id = pb.TrainerSpec.BPE, len(tokens) + 1, len(tokens)
    spec.bos_id = spec.eos_id = spec.pad_id = -1
    norm = model.normalizer_spec
    norm.name, norm.precompiled_charsmap = "identity", b""
    norm.add_dummy_prefix = norm.remove_extra_whitespaces = norm.escape_whitespaces = False
    return model.SerializeToString()


class Codec:
    """Encodes and decodes texts as UTF-8 bytes."""

    def __init__(self, tokens: list[bytes], proto: bytes, pattern: str) -> None:
        import regex
        from sentencepiece import SentencePieceProcessor

        self._split_any = regex.compile(pattern).findall
        # Over plain Latin text the classes of the standard library agree, and it is twice as fast.
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
        self._split_plain = None if r"\p" in plain else re.compile(plain).findall
        self._odd = re.compile(r"[^\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]").search
        self._pieces = SentencePieceProcessor(model_proto=proto)
        # Bytes read as Latin-1 and then translated are the characters of the model.
        self._map = dict(enumerate(byte_alphabet()))
        self._tokens = tokens
        self._decimal = list(map(str, range(len(tokens))))
        self._whole = {t: [i] for i, t in enumerate(tokens)}
        self._cache: dict[str, list[int]] = {}

    def _learn(self, fresh: list[str]) -> None:
        """Ids of pre-tokens not met so far. One that is a token itself is that token; the others are merged."""
        cache, merge = self._cache, []
        for t in fresh:
            raw = t.encode()
            ids = self._whole.get(raw)
            if ids is None:
                merge.append((t, raw.decode("latin-1").translate(self._map)))
            else:
                cache[t] = ids
        for (t, _), ids in zip(merge, self._pieces.encode([m for _, m in merge], num_threads=1)):
            cache[t] = ids

    def split(self, text: str) -> list[str]:
        if self._split_plain is None or self._odd(text):
            return self._split_any(text)
        return self._split_plain(text)

    def encode(self, texts: list[bytes]) -> list[list[int]]:
        """Ids of each text. The texts are encoded together, so that each distinct pre-token is merged once."""
        split = [self.split(t.decode("utf-8", "replace")) for t in texts]
        if len(self._cache) > CACHE:
            self._cache = {}
        self._learn([t for t in set().union(*split) if t not in self._cache])
        known = self._cache.__getitem__
        return [list(chain.from_iterable(map(known, parts))) for parts in split]

    def listed(self, ids: list[int]) -> str:
        """The ids in decimal, joined by commas."""
        return ",".join(map(self._decimal.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self._tokens.__getitem__, ids))


def apply_codec(
    docs: DataFrame,
    path: str,
    pattern: str,
    fields: list[StructField],
    result: Callable[[Codec, list[int]], tuple],
    id_col: str = "doc_id",
    text_col: str = "text",
    also: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs`` with what ``result(codec, ids)`` gives. The vocabulary (one rank file, read on the
    driver) and the model made from it are all that is sent to the tasks. Null texts are empty, repeated rows are
    encoded each."""
    tokens = read_ranks(path)
    shared = docs.sparkSession.sparkContext.broadcast((tokens, model_proto(tokens), pattern))

    def setup():
        codec = Codec(*shared.value)
        return lambda texts: [result(codec, ids) for ids in codec.encode(texts)]

    return per_document(docs, fields, setup, id_col, text_col, also, together=True)


def encode(docs: DataFrame, path: str, pattern: str, **columns) -> DataFrame:
    """Token ids of each text as an array column ``ids``."""
    return apply_codec(docs, path, pattern, [StructField("ids", ArrayType(IntegerType()))], lambda _, ids: (ids,), **columns)
