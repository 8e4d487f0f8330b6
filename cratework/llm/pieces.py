"""SentencePiece models: reading, normalising, and cutting texts where no piece can cross."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import ahocorasick

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def _fields(data: bytes):
    """(number, value) of the fields of a serialised message: int, 4 or 8 bytes, or bytes."""

    def varint(at):
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = varint(at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


@dataclass
class Pieces:
    """What the operators need of a model file."""

    kind: int
    names: list[str]
    scores: list[float]
    types: list[int]
    dummy_prefix: bool = True
    squeeze_spaces: bool = True
    numbers: dict[str, int] = field(default_factory=dict)
    bytes_at: list[int] = field(default_factory=list)

    @classmethod
    def parse(cls, data: bytes) -> Pieces:
        names, scores, types, settings = [], [], [], {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                names.append(piece[1].decode("utf-8"))
                scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
                types.append(piece.get(3, NORMAL))
            elif number in (2, 3):
                settings[number] = dict(_fields(value))
        trainer, normaliser = settings.get(2, {}), settings.get(3, {})
        kind = trainer.get(3, UNIGRAM)
        plain = not normaliser.get(2) and normaliser.get(5, 1) and not trainer.get(24, 0)
        known = {NORMAL, UNKNOWN, CONTROL, BYTE}
        if kind not in (UNIGRAM, BPE) or not plain or set(types) - known or types.count(BYTE) != 256:
            raise ValueError(
                "the model must be unigram or BPE with byte fallback, the identity normaliser, "
                "escaped white space and no user-defined or unused pieces"
            )
        numbers = {n: i for i, n in enumerate(names) if types[i] == NORMAL}
        if any(c not in numbers for n in numbers for c in n):
            raise ValueError("every character of a piece must be a piece")
        by_name = {n: i for i, n in enumerate(names) if types[i] == BYTE}
        return cls(
            kind,
            names,
            scores,
            types,
            bool(normaliser.get(3, 1)),
            bool(normaliser.get(4, 1)),
            numbers,
            [by_name[f"<0x{b:02X}>"] for b in range(256)],
        )

    def normalised(self, text: str | None) -> str:
        """The text as pieces spell it; empty text stays empty."""
        text = text or ""
        if self.squeeze_spaces:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)

    def cutter(self) -> re.Pattern:
        """Cuts normalised text into segments that no piece of several characters crosses.

        Characters of no longer piece stand alone, so all characters of a longer segment are
        pieces. If no piece has a space mark after another character, a segment starts at each
        run of them; and a run of letters ends where a character follows that follows a letter
        in no piece, as most punctuation does.
        """
        long_pieces = [n for n in self.numbers if len(n) > 1]
        joined = {c for n in long_pieces for c in n}
        if any(SPACE in n.lstrip(SPACE) for n in long_pieces):
            return re.compile(f"[{_class(joined)}]+|.", re.DOTALL)
        letters = {c for c in joined if c.isalpha()}
        after = {y for n in long_pieces for x, y in zip(n, n[1:], strict=False) if x in letters}
        word = f"{SPACE}*[{_class(letters)}]+(?=[{_class(joined - letters - after)}])"
        return re.compile(
            f"{word}|{SPACE}*[{_class(joined - {SPACE})}]+|{SPACE}+|.", re.DOTALL
        )

    def automaton(self):
        """All pieces of the vocabulary; a match gives the piece's number and length."""
        found = ahocorasick.Automaton()
        for name, number in self.numbers.items():
            found.add_word(name, (number, len(name)))
        found.make_automaton()
        return found

    def byte_pieces(self, text: str) -> list[int]:
        return [self.bytes_at[b] for b in text.encode("utf-8", "surrogatepass")]


def _class(characters: set[str]) -> str:
    return "".join(re.escape(c) for c in sorted(characters)) or "\x00"


class PairRule:
    """Which pieces may follow each other in the output of a byte-pair model.

    A sequence of pieces is what the model's merges make of a text exactly if each two adjacent
    pieces are what they make of those two pieces' text. So the rule is an acceptor whose arcs
    weigh nothing where that holds and infinitely much elsewhere. Pairs are decided when first
    met, by applying the merges to the pair's text.
    """

    def __init__(self, pieces: Pieces, most: int = 1_000_000):
        self.pieces, self.most, self.known = pieces, most, {}

    def merges(self, text: str) -> list[str]:
        """Characters joined by best score first, the leftmost of equals."""
        numbers, scores = self.pieces.numbers, self.pieces.scores
        parts = list(text)
        while len(parts) > 1:
            best = None
            for i in range(len(parts) - 1):
                number = numbers.get(parts[i] + parts[i + 1])
                if number is not None and (best is None or scores[number] > best[0]):
                    best = (scores[number], i)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def allows(self, last: int, following: int) -> bool:
        """``last`` is -1 at the start of a segment."""
        key = last * len(self.pieces.names) + following
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= self.most:
                self.known.clear()
            name = self.pieces.names[following]
            before = [self.pieces.names[last]] if last >= 0 else []
            found = self.merges("".join(before) + name) == [*before, name]
            self.known[key] = found
        return found
