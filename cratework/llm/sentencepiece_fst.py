"""SentencePiece encoding as the shortest path through a weighted transducer, and decoding."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from cratework.llm.per_row import append_columns
from cratework.llm.pieces import BPE, BYTE, NORMAL, SPACE, PairRule, Pieces

_MOST_SEGMENTS = 300_000

#: Compiled transducers of this process, by model.
_compiled: dict[str, Transducer] = {}


class Transducer:
    """Normaliser, pieces and byte fallback, compiled once and composed with each input.

    The normaliser is a deterministic rewriting, so it is applied to the input first. The piece
    transducer reads the spelling of a piece and writes its number: its arcs weigh the negated
    score (unigram), or 0 under the pair rule (byte pairs). Byte fallback reads a character that
    is no piece and writes its bytes. Composing an input with it gives a lattice whose states
    are the places in the input (with the piece before them, under the pair rule). Its arcs are
    made as they are needed, by end and then longest first, which is a topological order: one
    pass finds the path of least weight. Places that every path passes cut the input into
    segments, which are solved apart and remembered up to a bound.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.cut = pieces.cutter()
        self.automaton = pieces.automaton()
        self.rule = PairRule(pieces) if pieces.kind == BPE else None
        self.known: dict[str, bytes] = {}
        self.spelled = [
            bytes([pieces.bytes_at.index(i)])
            if kind == BYTE
            else name.replace(SPACE, " ").encode() if kind == NORMAL else b""
            for i, (name, kind) in enumerate(zip(pieces.names, pieces.types, strict=True))
        ]

    def shortest_path(self, segment: str) -> list[int]:
        """Piece numbers of the path of least weight through one segment's lattice."""
        if len(segment) == 1:
            number = self.pieces.numbers.get(segment)
            return self.pieces.byte_pieces(segment) if number is None else [number]
        last, back = self._by_pairs(segment) if self.rule else self._by_weight(segment)
        place, path = len(segment), []
        while place:
            path.append(last[place])
            place -= back[place]
        return path[::-1]

    def _by_weight(self, segment: str):
        """Least sum of negated scores; of equal sums the arc from the earlier place."""
        scores, size = self.pieces.scores, len(segment) + 1
        weight, last, back = [0.0] + [None] * (size - 1), [-1] * size, [0] * size
        for end, (number, length) in self.automaton.iter(segment):
            total = weight[end + 1 - length] - scores[number]
            if weight[end + 1] is None or total < weight[end + 1]:
                weight[end + 1], last[end + 1], back[end + 1] = total, number, length
        return last, back

    def _by_pairs(self, segment: str):
        """The path of weight 0: to each place at most one piece leads under the pair rule."""
        allows, known, names = self.rule.allows, self.rule.known, len(self.pieces.names)
        size = len(segment) + 1
        last, back = [-1] + [None] * (size - 1), [0] * size
        for end, (number, length) in self.automaton.iter(segment):
            if last[end + 1] is None:
                before = last[end + 1 - length]
                if before is not None:
                    allowed = known.get(before * names + number)
                    if allows(before, number) if allowed is None else allowed:
                        last[end + 1], back[end + 1] = number, length
        return last, back

    def encode(self, text: str | None) -> np.ndarray:
        known = self.known
        if len(known) >= _MOST_SEGMENTS:
            known.clear()
        segments = self.cut.findall(self.pieces.normalised(text))
        for segment in segments:
            if segment not in known:
                known[segment] = np.array(self.shortest_path(segment), np.int32).tobytes()
        return np.frombuffer(b"".join(map(known.__getitem__, segments)), np.int32)

    def decode(self, ids) -> str:
        """The text that the pieces spell; unknown numbers and control pieces spell nothing."""
        size = len(self.spelled)
        data = b"".join([self.spelled[i] for i in ids if i is not None and 0 <= i < size])
        text = data.decode("utf-8", "replace")
        return text[1:] if self.pieces.dummy_prefix and text.startswith(" ") else text


def shared_model(spark: SparkSession, path: str):
    """The model file, read by the driver and broadcast; its size is fixed (0.5 MB here)."""
    with open(path, "rb") as file:
        data = file.read()
    Pieces.parse(data)
    return spark.sparkContext.broadcast((uuid.uuid5(uuid.NAMESPACE_URL, data.hex()).hex, data))


def _transducer(model) -> Transducer:
    token, data = model.value
    if token not in _compiled:
        _compiled[token] = Transducer(Pieces.parse(data))
    return _compiled[token]


def encode_texts(docs: DataFrame, model_path: str, text_column: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and ``n_tokens`` of each whole text, replacing such columns.

    The ids are those of the model's own algorithm. NULL and empty texts have no tokens. No
    shuffle: documents are encoded where they are read, in batches bounded by bytes.
    """
    model = shared_model(docs.sparkSession, model_path)

    def prepare():
        encode = _transducer(model).encode

        def run(texts):
            found = [encode(t) for t in texts]
            return [(ids, len(ids)) for ids in found]

        return run

    return append_columns(docs, [text_column], "ids array<int>, n_tokens bigint", prepare)


def decode_ids(docs: DataFrame, model_path: str, ids_column: str = "ids") -> DataFrame:
    """``docs`` with ``decoded``: the text that each row's ids spell; NULL ids spell nothing.

    Decoding an encoding gives the text back, with a space for each U+2581 in it.
    """
    model = shared_model(docs.sparkSession, model_path)

    def prepare():
        decode = _transducer(model).decode
        return lambda rows: [(decode(ids or []),) for ids in rows]

    return append_columns(docs, [ids_column], "decoded string", prepare)


def round_trip(docs: DataFrame, model_path: str, text_column: str = "text") -> DataFrame:
    """``docs`` encoded, with ``round_trip``: whether decoding gives the text back.

    Both directions run in one pass, so the pieces are not sent to another process between.
    """
    model = shared_model(docs.sparkSession, model_path)

    def prepare():
        transducer = _transducer(model)

        def run(texts):
            rows = []
            for text in texts:
                ids = transducer.encode(text)
                same = transducer.decode(ids.tolist()) == (text or "").replace(SPACE, " ")
                rows.append((ids, len(ids), same))
            return rows

        return run

    fields = "ids array<int>, n_tokens bigint, round_trip boolean"
    return append_columns(docs, [text_column], fields, prepare)
