"""Benchmark decontamination: one scan of each text with an Aho-Corasick automaton."""

from __future__ import annotations

import re
import uuid
from collections import defaultdict

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratework.llm.common import text_or_empty
from cratework.llm.per_row import append_columns

WINDOW = 13
#: Item words that one automaton holds at most (about 60 bytes of memory for each of their bytes).
AUTOMATON_BYTES = 2_000_000

_WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
_TO_SPACE = bytes(
    c if chr(c).isascii() and (chr(c).isdigit() or chr(c).islower()) or c >= 0x80 else 0x20
    for c in range(256)
)
_ADDED = (
    "n_words bigint, n_hit bigint, items array<string>, "
    "spans array<struct<item:string,start:int,end:int>>"
)
#: The automata of the benchmark that this process scanned with last.
_automata: dict[str, list[tuple]] = {}


def normalised(text: str | None) -> bytes:
    """UTF-8 of the text with A to Z in lower case and a space for every other separator.

    Every byte keeps its place. Bytes above 0x7F belong to characters that are part of words.
    """
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_TO_SPACE)


def words_of(text: str | None) -> list[bytes]:
    return normalised(text).split()


def _spaced(words: list[bytes]) -> str:
    """The words as text of one character per byte, a space around each."""
    return " " + " ".join(w.decode("latin-1") for w in words) + " "


def build_automaton(items: list[tuple[str, list[bytes]]], window: int):
    """Automaton over blocks of the items' words; a match gives the items and offsets.

    Blocks of ``window // 2 + 1`` words start at every multiple of that length, so every window
    holds a whole block; the match is then extended. That makes the automaton as large as the
    items' text, not ``window`` times as large. An item shorter than a window is one block.
    """
    block = window // 2 + 1
    places = defaultdict(list)
    for number, (_, words) in enumerate(items):
        if not words:
            continue
        if len(words) < window:
            places[_spaced(words)].append((number, 0))
            continue
        for start in range(0, len(words) - block + 1, block):
            places[_spaced(words[start : start + block])].append((number, start))
    automaton = ahocorasick.Automaton()
    for pattern, found in places.items():
        automaton.add_word(pattern, (pattern.count(" ") - 1, found))
    if places:
        automaton.make_automaton()
    return automaton


def find_hits(text: str | None, items, automaton, window: int) -> tuple[int, list[tuple]]:
    """Word count of the text, and each longest run of words that windows of an item cover."""
    data = normalised(text)
    words = data.split()
    if not words or not len(automaton):
        return len(words), []
    spaced = " " + b" ".join(words).decode("latin-1") + " "
    ends: dict[tuple[int, int], int] = {}
    runs = []
    seen_at = seen_words = 0
    for end, (length, found) in automaton.iter(spaced):
        seen_words += spaced.count(" ", seen_at, end)
        seen_at = end
        first = seen_words - length
        for number, offset in found:
            item = items[number][1]
            line = (number, first - offset)
            if ends.get(line, -1) > first:
                continue
            a, b = first, first + length
            while a > 0 and a - line[1] > 0 and words[a - 1] == item[a - line[1] - 1]:
                a -= 1
            while b < len(words) and b - line[1] < len(item) and words[b] == item[b - line[1]]:
                b += 1
            ends[line] = b
            if b - a >= min(window, len(item)):
                runs.append((number, a, b - 1))
    if not runs:
        return len(words), []
    spans = [m.span() for m in _WORD_BYTES.finditer(data)]
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(words), [
        (items[n][0], a, b, _characters(raw, spans[a][0]), _characters(raw, spans[b][1]))
        for n, a, b in runs
    ]


def _characters(raw: bytes, place: int) -> int:
    return len(raw[:place].decode("utf-8", "surrogatepass"))


def _shards(benchmark: DataFrame, id_column: str, text_column: str, limit: int):
    """The items in parts of about ``limit`` bytes, each fetched only when it is asked for."""
    rows = benchmark.select(
        F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"),
        text_or_empty(text_column).alias("text"),
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = total // limit + 1
    for part in range(parts):
        mine = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part)
        yield [(r.id, words_of(r.text)) for r in mine.collect()]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
    window: int = WINDOW,
    automaton_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """``docs`` with the words that windows of benchmark items cover.

    Words are runs of digits, letters and non-ASCII characters after lower-casing A to Z. A
    window is ``window`` consecutive words of an item, or all words of a shorter one. Added
    columns, which replace others of these names: ``n_words``, ``n_hit`` (words inside any
    occurrence of a window), ``items`` (ids as text, sorted, of items with such windows),
    ``spans`` (item, start and end of each run in code points of the original text), and
    ``contaminated`` (some word is hit, and at least a twentieth of all).

    The benchmark's size is measured first. Up to ``automaton_bytes`` it makes one automaton,
    which is broadcast; a larger one makes several, and each text is scanned by all of them when
    it is read. Documents are read once and never shuffled. NULL and empty texts have no words; an empty benchmark hits
    nothing; items that share an id count as one; items with a NULL id share the empty id.
    """
    sparks = docs.sparkSession.sparkContext
    parts = _shards(benchmark, item_id_column, item_text_column, automaton_bytes)
    shared = [sparks.broadcast(items) for items in parts]
    token = uuid.uuid4().hex

    def prepare():
        if token not in _automata:
            _automata.clear()
            values = [part.value for part in shared]
            _automata[token] = [(items, build_automaton(items, window)) for items in values]
        automata = _automata[token]
        return lambda texts: [_scanned(text, automata, window) for text in texts]

    result = append_columns(docs, [text_column], _ADDED, prepare)
    share = F.col("n_hit") * 20 >= F.col("n_words")
    return result.withColumn("contaminated", (F.col("n_hit") > 0) & share)


def _scanned(text: str | None, automata: list[tuple], window: int) -> tuple:
    """A text scanned by every automaton: words, words in some run, items and runs of them."""
    n_words, runs = 0, []
    for items, automaton in automata:
        n_words, found = find_hits(text, items, automaton, window)
        runs += found
    n_hit, reach = 0, -1
    for _, first, last, _, _ in sorted(runs, key=lambda run: run[1:3]):
        n_hit += max(0, last - max(first, reach + 1) + 1)
        reach = max(reach, last)
    names = sorted({run[0] for run in runs}, key=lambda name: name.encode())
    spans = [{"item": item, "start": start, "end": end} for item, _, _, start, end in runs]
    return n_words, n_hit, names, spans
