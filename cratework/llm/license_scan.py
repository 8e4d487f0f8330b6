"""License scan: patience alignment of texts with license templates."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame

from cratework.llm.license_templates import TEMPLATES
from cratework.llm.per_row import append_columns

#: Share of a template's words that must be aligned.
COVERAGE = 0.85

_WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*\+?")
_BRACES = re.compile(r"\{([^}]*)\}")
#: What takes a notice back, within the same sentence and shortly before it.
_DENIAL = re.compile(
    r"\b(?:not|never|no longer|cannot|neither|nor|rather than|instead of|(?:is|was|are|were|do|does|did|has|have)n.t)\b"
    r"(?:[^\w.;:!?]+\w+){0,4}[^\w.;:!?]*$"
)


def template_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def naming_words(text: str) -> list[range]:
    """The places, among the words of a template, of those in each pair of braces."""
    found = []
    for braces in _BRACES.finditer(text):
        start = len(template_words(text[: braces.start()]))
        found.append(range(start, start + len(template_words(braces[1]))))
    return found


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, in order in both.

    Words that are found once in each list are anchors; of these the longest increasing
    subsequence is kept, and the gaps between are aligned in the same way. A gap without anchors
    is aligned by its longest common subsequence. Equal ends are matched first.
    """
    pairs, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        i, i_end, j, j_end = gaps.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            pairs.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        once_a, once_b = _once(a, i, i_end), _once(b, j, j_end)
        anchors = _increasing([(p, once_b[w]) for w, p in once_a.items() if w in once_b])
        if not anchors:
            pairs += _common(a, b, i, i_end, j, j_end)
            continue
        for p, q in anchors:
            pairs.append((p, q))
            gaps.append((i, p, j, q))
            i, j = p + 1, q + 1
        gaps.append((i, i_end, j, j_end))
    return sorted(pairs)


def _once(words: list[str], start: int, end: int) -> dict[str, int]:
    counts = Counter(words[start:end])
    return {words[p]: p for p in range(start, end) if counts[words[p]] == 1}


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, in order of the first place, whose second places increase."""
    tops, heads, before = [], [], {}
    for pair in sorted(pairs):
        pile = bisect_left(tops, pair[1])
        before[pair] = heads[pile - 1] if pile else None
        tops[pile : pile + 1] = [pair[1]]
        heads[pile : pile + 1] = [pair]
    run, pair = [], heads[-1] if heads else None
    while pair:
        run.append(pair)
        pair = before[pair]
    return run[::-1]


def _common(a, b, i, i_end, j, j_end) -> list[tuple[int, int]]:
    """Longest common subsequence of two gaps; a gap is no longer than a window."""
    width = j_end - j + 1
    table = [[0] * width]
    for p in range(i_end - 1, i - 1, -1):
        below, row = table[-1], [0] * width
        for q in range(width - 2, -1, -1):
            if a[p] == b[j + q]:
                row[q] = below[q + 1] + 1
            else:
                row[q] = max(below[q], row[q + 1])
        table.append(row)
    table.reverse()
    found, p, q = [], 0, 0
    while p < i_end - i and q < width - 1:
        if a[i + p] == b[j + q]:
            found.append((i + p, j + q))
            p, q = p + 1, q + 1
        elif table[p + 1][q] >= table[p][q + 1]:
            p += 1
        else:
            q += 1
    return found


@dataclass(frozen=True)
class Hit:
    license: str
    coverage: float
    start: int
    end: int
    words: int


@dataclass(frozen=True)
class Template:
    license: str
    words: list[str]
    counts: Counter
    naming: list[range]
    names: frozenset[str]


class Scanner:
    """Finds licenses in texts.

    A hit aligns ``coverage`` of a template's words, and all words that name the license, those
    in one pair of braces in a row. Of hits that overlap that of the most aligned words stays, so
    a whole text or a notice with a variant is taken for itself and not for what it begins with.
    A notice that is denied right before ("not licensed under ...") is no hit.
    """

    def __init__(self, templates=TEMPLATES, coverage: float = COVERAGE):
        self.coverage = coverage
        self.templates = []
        self.by_word: dict[str, list[Template]] = {}  # by one of the words that a text must have
        for name, text in templates:
            words, naming = template_words(text), naming_words(text)
            if words:
                names = frozenset(words[p] for places in naming for p in places)
                self.templates.append(Template(name, words, Counter(words), naming, names))
                rarest = max(names or words, key=lambda w: (len(w), w))
                self.by_word.setdefault(rarest if names else "", []).append(self.templates[-1])

    def scan(self, text: str | None) -> list[Hit]:
        """Best templates in the text, in order, in places that don't overlap."""
        lowered = (text or "").lower()
        if len(lowered) != len(text or ""):  # places must be those of the original
            lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        present = set(_WORD.findall(lowered))
        near = [t for w in self.by_word.keys() & (present | {""}) for t in self.by_word[w]]
        wanted = [t for t in near if t.names <= present and self._possible(present, t)]
        if not wanted:
            return []
        spans = [m.span() for m in _WORD.finditer(lowered)]
        words = [lowered[s:e] for s, e in spans]
        found = [h for t in wanted for h in self._places(words, spans, t)]
        found = [h for h in found if not _DENIAL.search(lowered[max(0, h.start - 80) : h.start])]
        found.sort(key=lambda h: (-h.coverage * h.words, -h.coverage, h.start, h.license))
        kept: list[Hit] = []
        for hit in found:
            if all(hit.end <= k.start or hit.start >= k.end for k in kept):
                kept.append(hit)
        return sorted(kept, key=lambda h: h.start)

    def _possible(self, present: set[str], template: Template) -> bool:
        reach = sum(n for w, n in template.counts.items() if w in present)
        return reach >= self.coverage * len(template.words)

    def aligned(self, words: list[str], template: Template) -> list[tuple[int, int]]:
        """The alignment of some words with a template, if it is a hit; else none."""
        pairs = patience(words, template.words)
        if len(pairs) < self.coverage * len(template.words):
            return []
        place = {q: p for p, q in pairs}
        for naming in template.naming:
            at = [place.get(q) for q in naming]
            if None in at or at[-1] - at[0] != len(at) - 1:
                return []
        return pairs

    def _places(self, words, spans, template: Template):
        """Windows that hold enough of the template's words, each aligned once."""
        need = self.coverage * len(template.words)
        size = len(template.words) + len(template.words) // 4 + 2
        places = [p for p, w in enumerate(words) if w in template.counts]
        first = 0
        while first < len(places):
            last = bisect_left(places, places[first] + size)
            if last - first >= need:
                at = places[first]
                pairs = self.aligned(words[at : at + size], template)
                if pairs:
                    # A window that began too early may have cut the end off.
                    at += pairs[0][0]
                    pairs = self.aligned(words[at : at + size], template)
                if pairs:
                    start, end = at + pairs[0][0], at + pairs[-1][0]
                    share = len(pairs) / len(template.words)
                    yield Hit(template.license, share, spans[start][0], spans[end][1], len(template.words))
                    first = bisect_left(places, end + 1)
                    continue
            first += 1


def scan_licenses(
    docs: DataFrame,
    text_column: str = "text",
    templates=TEMPLATES,
    coverage: float = COVERAGE,
) -> DataFrame:
    """``docs`` with ``licenses`` found in each whole text, and the best ``license``.

    ``licenses`` has license, coverage (share of the template's words that the text aligns
    with) and place in code points of each hit, in text order; ``license`` and ``coverage`` are
    those of the best hit: most aligned words, then most coverage, the earlier place, the name.
    What is a hit, ``Scanner`` says. Without hits, as for NULL and empty texts, the list is empty and the two are NULL.
    Columns of these names are replaced. The templates are few and fixed; nothing is shuffled.
    """

    def prepare():
        scanner = Scanner(templates, coverage)

        def run(texts):
            rows = []
            for text in texts:
                hits = scanner.scan(text)
                best = min(
                    hits,
                    key=lambda h: (-h.coverage * h.words, -h.coverage, h.start, h.license),
                    default=None,
                )
                listed = [
                    {"license": h.license, "coverage": h.coverage, "start": h.start, "end": h.end}
                    for h in hits
                ]
                rows.append((listed, best and best.license, best and best.coverage))
            return rows

        return run

    fields = (
        "licenses array<struct<license:string,coverage:double,start:int,end:int>>, "
        "license string, coverage double"
    )
    return append_columns(docs, [text_column], fields, prepare)
