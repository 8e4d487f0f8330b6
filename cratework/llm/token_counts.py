"""Token counts without tokens: a Viterbi pass that carries best score and piece count."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cratework.llm.per_row import append_columns
from cratework.llm.pieces import BPE, PairRule, Pieces
from cratework.llm.sentencepiece_fst import shared_model

_MOST_SEGMENTS = 400_000
_HIGH = 40  # both counts of a segment are kept in one number, the second above this bit

_compiled: dict[str, Counter] = {}


class Counter:
    """Counts pieces of a text from the vocabulary's matches alone.

    An Aho-Corasick automaton gives all pieces in a segment, by end and then longest first. For
    each place the pass carries the best score to it and the number of pieces that make it. As
    in the tokenizer, a score must be higher to replace another, so the longest last piece wins
    a tie; a character of no piece counts as its bytes. Scores are added in double precision
    within segments that no piece crosses, so long texts lose no precision.

    A byte-pair model doesn't choose by score. For one, the same pass also follows the only
    places and pieces that its pair rule allows, and carries their count.
    """

    def __init__(self, pieces: Pieces):
        self.pieces, self.cut, self.automaton = pieces, pieces.cutter(), pieces.automaton()
        self.rule = PairRule(pieces) if pieces.kind == BPE else None
        self.known: dict[str, int] = {}

    def count_segment(self, segment: str) -> tuple[int, int]:
        """(by the model's own algorithm, by score)."""
        if len(segment) == 1:
            one = 1 if segment in self.pieces.numbers else len(self.pieces.byte_pieces(segment))
            return one, one
        size = len(segment) + 1
        scores, names = self.pieces.scores, len(self.pieces.names)
        best, count = [0.0] + [None] * (size - 1), [0] * size
        rule = self.rule
        last, pairs = [-1] + [None] * (size - 1), [0] * size
        for end, (number, length) in self.automaton.iter(segment):
            end += 1
            start = end - length
            score = best[start] + scores[number]
            if best[end] is None or score > best[end]:
                best[end], count[end] = score, count[start] + 1
            if rule and last[end] is None and last[start] is not None:
                allowed = rule.known.get(last[start] * names + number)
                if rule.allows(last[start], number) if allowed is None else allowed:
                    last[end], pairs[end] = number, pairs[start] + 1
        return (pairs[-1] if rule else count[-1]), count[-1]

    def count(self, text: str | None) -> tuple[int, int]:
        known = self.known
        if len(known) >= _MOST_SEGMENTS:
            known.clear()
        segments = self.cut.findall(self.pieces.normalised(text))
        for segment in segments:
            if segment not in known:
                own, scored = self.count_segment(segment)
                known[segment] = own + (scored << _HIGH)
        total = sum(map(known.__getitem__, segments))
        return total & ((1 << _HIGH) - 1), total >> _HIGH


def count_tokens(docs: DataFrame, model_path: str, text_column: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` and ``n_unigram`` of each whole text, replacing such columns.

    ``n_tokens`` is the number of pieces that the model's own algorithm makes, ``n_unigram``
    that of the best-scored segmentation over its vocabulary; for a unigram model they are the
    same. NULL and empty texts have none. Documents are counted where they are read.
    """
    model = shared_model(docs.sparkSession, model_path)

    def prepare():
        token, data = model.value
        if token not in _compiled:
            _compiled[token] = Counter(Pieces.parse(data))
        count = _compiled[token].count
        return lambda texts: [count(t) for t in texts]

    return append_columns(docs, [text_column], "n_tokens bigint, n_unigram bigint", prepare)
