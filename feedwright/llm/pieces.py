"""SentencePiece encoding and decoding over a table of distinct chunks.

A sentencepiece model turns blanks into markers (U+2581). Where no piece of the vocabulary has a marker after another
character, no merge ever crosses the border in front of a run of markers: a text may be cut there and the chunks be
segmented one by one, each distinct chunk once. A task keeps a table of the distinct chunks it has met - the ids of all of
them in one flat array - and joins the ids back to the texts by position: every text is the list of its chunks' places
in the table, and one gather over the flat array gives the ids of many texts at once.

The cut is checked against the vocabulary when the model is read, and so are the settings it rests on (merges by score,
no normalisation, blanks kept and escaped); a model of another kind is refused.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField

from feedwright.llm.text import per_document

MARK = "▁"
#: Distinct chunks, and characters in them, that a task keeps in its table; beyond either it starts a new one.
CHUNKS = 200_000
CHARS = 4_000_000
#: Characters of texts that are encoded together.
TOGETHER = 2_000_000

_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall


def check_model(model: bytes) -> bool:
    """Whether the model writes a marker in front of a text. Raises ValueError where its texts cannot be cut at markers."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(model)
    norm, spec = proto.normalizer_spec, proto.trainer_spec
    if spec.model_type != pb.TrainerSpec.BPE or spec.treat_whitespace_as_suffix:
        raise ValueError("only BPE models with leading whitespace markers can be cut at markers")
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
        raise ValueError("only models that keep texts as they are, with blanks escaped, can be cut at markers")
    if any(p.type == pb.ModelProto.SentencePiece.USER_DEFINED for p in proto.pieces):
        raise ValueError("user-defined pieces may cross markers")
    crossing = next((p.piece for p in proto.pieces if re.search(f"[^{MARK}]{MARK}", p.piece)), None)
    if crossing is not None:
        raise ValueError(f"piece {crossing!r} crosses a whitespace marker")
    return norm.add_dummy_prefix


def bare_model(model: bytes) -> bytes:
    """The same vocabulary without a marker of its own in front of what it segments."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(model)
    proto.normalizer_spec.add_dummy_prefix = False
    return proto.SerializeToString()


class ChunkTable:
    """Encodes texts through a table of distinct chunks, and decodes ids with the library."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        self._prefix = MARK if check_model(model) else ""
        self._segment = SentencePieceProcessor(model_proto=bare_model(model))
        self._whole = SentencePieceProcessor(model_proto=model)
        self._decimal = list(map(str, range(self._whole.get_piece_size())))
        self._clear()

    def _clear(self) -> None:
        self._place: dict[str, int] = {}
        self._chars = 0
        self._ids = np.empty(1024, np.int32)
        self._ends = np.zeros(1, np.int64)

    def cut(self, text: str) -> list[str]:
        """Marked chunks of a text; together they are the text with its blanks escaped."""
        if not text:
            return []
        return _CHUNK(self._prefix + text.replace(" ", MARK))

    def _learn(self, fresh: list[str]) -> None:
        """Segments chunks that the table lacks and puts them at its end."""
        found = self._segment.encode(fresh, num_threads=1)
        ends = self._ends[-1] + np.cumsum([len(ids) for ids in found])
        if ends[-1] > len(self._ids):
            self._ids = np.resize(self._ids, max(2 * len(self._ids), int(ends[-1])))
        self._ids[self._ends[-1] : ends[-1]] = np.fromiter((i for ids in found for i in ids), np.int32, int(ends[-1] - self._ends[-1]))
        self._place.update(zip(fresh, range(len(self._place), len(self._place) + len(fresh))))
        self._ends = np.concatenate([self._ends, ends])
        self._chars += sum(map(len, fresh))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out, at = [], 0
        while at < len(texts):
            size, to = len(texts[at]), at + 1
            while to < len(texts) and size + len(texts[to]) <= TOGETHER:
                size, to = size + len(texts[to]), to + 1
            out += self._encode_some(texts[at:to])
            at = to
        return out

    def _encode_some(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.cut(t) for t in texts]
        if len(self._place) > CHUNKS or self._chars > CHARS:
            self._clear()
        fresh = [c for c in set().union(*cut) if c not in self._place]
        if fresh:
            self._learn(fresh)
        # The join by position: places of all chunks of all texts, then the ids of each place one after the other.
        place = np.fromiter((p for chunks in cut for p in map(self._place.__getitem__, chunks)), np.int64, sum(map(len, cut)))
        first = self._ends[place]
        length = self._ends[place + 1] - first
        after = np.cumsum(length)
        total = int(after[-1]) if len(after) else 0
        ids = self._ids[np.arange(total) + np.repeat(first - after + length, length)]
        text_ends = np.concatenate([[0], after])[np.cumsum([len(chunks) for chunks in cut])]
        return np.split(ids, text_ends[:-1])

    def decode(self, ids: np.ndarray) -> str:
        return self._whole.decode(ids.tolist())

    def listed(self, ids: np.ndarray) -> str:
        """The ids in decimal, joined by commas."""
        return ",".join(map(self._decimal.__getitem__, ids.tolist()))


def apply_table(
    docs: DataFrame,
    path: str,
    fields: list[StructField],
    result: Callable[[ChunkTable, np.ndarray], tuple],
    id_col: str = "doc_id",
    text_col: str = "text",
    also: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs`` with what ``result(table, ids)`` gives.

    The model file, read on the driver, is all that is sent to the tasks. Null texts count as empty and have no ids, blanks
    alone are encoded as the library does, repeated ids and rows are encoded each, further columns are passed on only if
    named in ``also``, an empty table gives an empty result. Nothing is shuffled: a lost executor costs its own tasks.
    """
    with open(path, "rb") as file:
        model = file.read()
    check_model(model)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def setup():
        table = ChunkTable(shared.value)
        return lambda texts: [result(table, ids) for ids in table.encode([t.decode("utf-8", "replace") for t in texts])]

    return per_document(docs, fields, setup, id_col, text_col, also, together=True)


def encode(docs: DataFrame, path: str, **columns) -> DataFrame:
    """Token ids of each text as an array column ``ids``, as the library gives them without begin and end ids."""
    return apply_table(docs, path, [StructField("ids", ArrayType(IntegerType()))], lambda _, ids: (ids.tolist(),), **columns)


def round_trip(docs: DataFrame, path: str, **columns) -> DataFrame:
    """Token ids and the text that the library decodes them to, as columns ``ids`` and ``decoded``."""
    fields = [StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())]
    return apply_table(docs, path, fields, lambda table, ids: (ids.tolist(), table.decode(ids)), **columns)
