import itertools
import random
import time
import zlib
from collections import Counter

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from cratework.llm.decontamination import contamination, words_of
from cratework.llm.html_text import extract_main_text, main_text
from cratework.llm.license_scan import Scanner, patience, scan_licenses
from cratework.llm.license_templates import TEMPLATES
from cratework.llm.pieces import Pieces, _fields
from cratework.llm.queries import MODEL
from cratework.llm.sentencepiece_fst import Transducer, decode_ids, encode_texts, round_trip
from cratework.llm.token_counts import Counter as TokenCounter
from cratework.llm.token_counts import count_tokens
from cratework.llm import toxicity
from cratework.llm.toxicity import Settings, fit, held_out, score_toxicity, train, Scorer
from tests.llm.conftest import LONG, ODD, documents

FOLDER = "/root/testdata/sf0.01"


# --- contamination


def expected_hits(text, items, window):
    words = words_of(text)
    hit, names = set(), set()
    for name, item in items:
        parts = words_of(item)
        size = min(window, len(parts))
        for s in range(len(parts) - size + 1) if parts else ():
            for p in range(len(words) - size + 1):
                if words[p : p + size] == parts[s : s + size]:
                    hit.update(range(p, p + size))
                    names.add(name)
    return len(words), len(hit), sorted(names)


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("automaton_bytes", [2_000_000, 60])
def test_contamination_matches_brute_force(spark, small_jobs, automaton_bytes):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice("a b c dé".split()) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 6, 9, 20]))) for i in range(12)]
    items += [(3, "another text of item three"), (20, None), (21, ""), (22, "?!")]
    rows = [*ODD, *[(100 + i, text(rng.randrange(60))) for i in range(40)]]
    rows += [(200, "x " + items[4][1].upper().replace(" ", ", ") + "! y")]
    got = contamination(
        documents(spark, rows),
        benchmark(spark, items),
        window=5,
        automaton_bytes=automaton_bytes,
    )
    named = [(str(i), t) for i, t in items]
    want = Counter()
    for i, t in rows:
        n, hit, names = expected_hits(t, named, 5)
        want[(i, n, hit, tuple(names), hit > 0 and 20 * hit >= n)] += 1
    found = got.select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()
    assert Counter((r[0], r[1], r[2], tuple(r[3]), r[4]) for r in found) == want


def test_a_large_benchmark_takes_one_pass(spark, small_jobs):
    rng = random.Random(3)
    items = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(15))) for i in range(300)]
    rows = [(i, f"{items[i][1]} and more " * 3) for i in range(0, 300, 7)]
    got = contamination(documents(spark, rows), benchmark(spark, items), automaton_bytes=1000)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    for r in got.collect():
        assert (r.n_words, r.n_hit, r["items"]) == (51, 45, [str(r.doc_id)]) and len(r.spans) == 3


def test_spans_are_places_of_the_original(spark, small_jobs):
    rows = [(1, "Àé — Is THIS: a 漢字 test?! no")]
    got = contamination(documents(spark, rows), benchmark(spark, [(9, "this a 漢字 TEST")]))
    span = got.first().spans[0]
    assert (span.item, rows[0][1][span.start : span.end]) == ("9", "THIS: a 漢字 test")


def test_empty_benchmark_hits_nothing(spark, small_jobs, odd):
    got = contamination(odd, benchmark(spark, [])).collect()
    assert len(got) == len(ODD) and not any(r.contaminated or r.n_hit or r.items for r in got)


# --- pieces


def model_bytes():
    with open(MODEL, "rb") as file:
        return file.read()


def unigram_bytes():
    """The model with its vocabulary read as a unigram model."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    parts = b""
    for number, value in _fields(model_bytes()):
        if number == 2:
            value = value.replace(b"\x18\x02", b"\x18\x01", 1)
        parts += varint(number << 3 | 2) + varint(len(value)) + value
    return parts


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=model_bytes())


@pytest.fixture(scope="module")
def transducer():
    return Transducer(Pieces.parse(model_bytes()))


@pytest.fixture(scope="module")
def counter():
    return TokenCounter(Pieces.parse(model_bytes()))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab the ingER.,!?'s()\n\t0<x41>éß漢🙂▁\u0000", max_size=40))
def test_ids_and_counts_are_the_librarys(library, transducer, counter, text):
    want = library.encode(text)
    assert transducer.encode(text).tolist() == want
    assert transducer.decode(want) == text.replace("▁", " ")
    assert counter.count(text)[0] == len(want)


@pytest.mark.parametrize("spaces", range(0, 70, 3))
def test_runs_of_spaces(library, transducer, spaces):
    for text in (" " * spaces, " " * spaces + "the x", "a" + " " * spaces + "b"):
        assert transducer.encode(text).tolist() == library.encode(text)


def test_whole_documents_are_the_librarys(spark, library, transducer, counter):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect()
    for (text,) in rows:
        want = library.encode(text or "")
        assert transducer.encode(text).tolist() == want
        assert counter.count(text)[0] == len(want)


def test_best_score_matches_brute_force():
    """All segmentations of short words, with the tie rule: a longer last piece wins."""
    pieces = Pieces.parse(unigram_bytes())
    unigram, transducer = TokenCounter(pieces), Transducer(pieces)
    for word in ["the", "theanthe", "inerat", "onre", "stheren", "aab"]:
        text = "▁" + word
        best = None
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(text)]
            parts = [text[s:e] for s, e in zip([0, *ends], ends)]
            if all(p in pieces.numbers for p in parts):
                score = sum(pieces.scores[pieces.numbers[p]] for p in parts)
                key = (score, [len(p) for p in reversed(parts)])
                best = max(best or key, key)
        assert unigram.count_segment(text) == (len(best[1]), len(best[1]))
        lengths = [len(pieces.names[i]) for i in transducer.shortest_path(text)]
        assert lengths[::-1] == best[1]


def test_models_that_are_not_supported_are_refused():
    with pytest.raises(ValueError):
        Pieces.parse(b"")


def test_encoding_odd_rows(odd, library):
    rows = round_trip(odd, MODEL).collect()
    assert all(r.round_trip for r in rows)
    got = Counter((r.doc_id, tuple(r.ids), r.n_tokens) for r in rows)
    ids = [(i, tuple(library.encode(t or ""))) for i, t in ODD]
    assert got == Counter((i, t, len(t)) for i, t in ids)
    counts = count_tokens(odd, MODEL).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in counts) == Counter((i, len(t)) for i, t in ids)


def test_encoding_nothing(nothing):
    assert decode_ids(encode_texts(nothing, MODEL), MODEL).collect() == []
    assert count_tokens(nothing, MODEL).collect() == []


# --- toxicity


def test_learns_unseen_misspellings():
    rng = random.Random(2)
    words = ["".join(rng.choice("abdefglmnoprstu") for _ in range(6)) for _ in range(300)]
    bad = ["horridword", "nastyterm"]

    def text(toxic, length):
        parts = [rng.choice(words) for _ in range(length)]
        if toxic:
            parts[rng.randrange(length)] = rng.choice(bad)
        return " ".join(parts)

    labels = [i % 2 for i in range(400)]
    model = train([text(y, rng.randrange(5, 80)) for y in labels], labels, Settings())
    scorer = Scorer(model)
    clean = scorer.score([text(0, 60) for _ in range(50)])
    toxic = scorer.score([text(0, 60) + " horrridword " + text(0, 200) for _ in range(50)])
    assert (toxic[:, None] > clean[None, :]).mean() > 0.95


def test_held_out_rows_are_never_learned_from(spark, small_jobs):
    docs = documents(spark, [(i, f"text {i}") for i in range(50)])
    got = docs.select("doc_id", held_out().alias("out")).collect()
    assert {r.doc_id for r in got if r.out} == {
        i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 0
    }
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    out = [r.doc_id for r in got if r.out]
    only = fit(docs, labels.where(labels.doc_id.isin(out)))
    assert not only.weights.any() and only.bias == 0


def test_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = fit(docs, labels)
    scored = score_toxicity(docs.join(labels, "doc_id").where(held_out()), model)
    rows = scored.select("toxic", "score", "predicted").collect()
    positive = [r.score for r in rows if r.toxic == 1]
    negative = [r.score for r in rows if r.toxic == 0]
    above = sum((p > n) + 0.5 * (p == n) for p in positive for n in negative)
    assert above / (len(positive) * len(negative)) > 0.93
    assert sum(r.predicted for r in rows if r.toxic == 0) < 0.04 * len(negative)
    assert sum(r.predicted for r in rows if r.toxic == 1) > 0.75 * len(positive)


def test_toxicity_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (4, 0), (6, 1), (2, None), (None, 1)], "doc_id long, toxic int"
    )
    model = fit(odd, labels, Settings(epochs=1))
    rows = score_toxicity(odd, model).collect()
    assert len(rows) == len(ODD)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    empty = fit(nothing, labels)
    assert [r.score for r in score_toxicity(odd, empty).collect()] == [0.5] * len(ODD)
    assert score_toxicity(nothing, empty).collect() == []


# --- pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header class="top"><a href="/">Home</a></header><div id="side-bar"><p>Popular, stories.</p></div>
<div class="cookie-notice">We use cookies, accept them.</div>
<div class="post-content"><h2>Title &amp; more</h2><p>First   paragraph, with <b>text</b> that is
long enough to count, indeed it is.<p>Second &eacute; paragraph <a href=x>link</a><br>here, it goes
on, for a while.<ul><li>one, item<li>two</ul><div class="ad">Buy!</div>
<table><tr><td>cell<td>c2</table></div>
<div id="comments"><p>Nice post, thank you very much, I liked it a lot!</p></div>
<form><p>Sign up, please</p></form><script>var p = "<p>no</p>";</script><footer>(c)</footer>"""


def test_main_text():
    assert main_text(PAGE).split("\n") == [
        "Title & more",
        "First paragraph, with text that is long enough to count, indeed it is.",
        "Second é paragraph link here, it goes on, for a while.",
        "one, item",
        "two",
        "cell",
        "c2",
    ]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("plain text", "plain text"),
        ("a &lt; b &am", "a < b &am"),
        ("<article><p>one<!-- no --> &#x41;&nbsp;two</article", "one A two"),
        ("<div><p>" * 3000 + "deep", "deep"),
        ('<p title="a>b">x</p><p class="open>y</p>', "x\ny"),
        ("<nav><a href=x>only a menu</a></nav>", ""),
    ],
)
def test_odd_pages(page, text):
    assert main_text(page) == text


STORY = "<p>A long first paragraph, with commas, that tells the story of the page, to its end.</p>" * 3


@pytest.mark.parametrize(
    "around",
    [
        "<div class='content-with-sidebar'>{}</div>",
        "<div class='no-sidebar'>{}</div>",
        "<div class='elementor-widget-theme-post-content elementor-widget'>{}</div>",
        "<form action='x'>{}</form>",
        "<div class='widget'><form>{}</form></div>",
    ],
)
def test_articles_in_elements_with_odd_names(around):
    page = f"<body><div class='menu'><a href=x>Home</a></div>{around.format(STORY)}</body>"
    assert main_text(page).count("A long first paragraph") == 3


COMMENT = "<p>I don't agree with this at all, and here, at length, is why I never did.</p>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # Short articles, beside something longer that is none.
        ("<div><p>A short news item.</p></div><div class='comments'>" + COMMENT * 2 + "</div>", "A short news item."),
        ("<h1>Title</h1><p>Short body.</p><div class='cookie-notice'>" + COMMENT + "</div>", "Title\nShort body."),
        ("<nav><a href=x>Home</a></nav><div class='ad'>" + COMMENT + "</div><article><h1>T</h1><p>Short.</article>", "T\nShort."),
        ("<p>Short.</p><form>" + COMMENT + "<input name=q></form>", "Short."),
        ("<form>" + COMMENT + "<textarea>x</textarea></form>", ""),
        ("<div class='header'><nav>Menu</nav><h2>Site</h2></div><p>Short.</p>", "Short."),
        ("<form><nav>Menu</nav><p>Short.</p><input type='hidden'><footer>f</footer></form>", "Short."),
        ("<div class='widget'><article><p>Short.</p></article></div><div class='related'>R</div>", "Short."),
        ("<article class='comment-body'>" + COMMENT + "</article><article><p>Short.</p></article>", "Short."),
        # Text of elements that are no block.
        ("<p>It is <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation>x</annotation></math> here.</p>", "It is E=m here."),
        ("<p>An <object>object</object>, <canvas>canvas</canvas>, <svg><text>text</text></svg>.</p>", "An object, canvas, text."),
    ],
)
def test_what_is_no_article_is_never_returned(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    "name",
    ["comments-content", "post-comments", "notice-body", "ad main", "content-ad", "commentsBody",
     "comment_text", "main-menu", "cookie-content", "article-sidebar", "entry share", "sign-up"],
)
def test_a_mark_is_stronger_than_a_word_for_content(name):
    inside = f"<article>{STORY}<div class='{name}'>{COMMENT * 3}</div><p>The end.</p></article>"
    beside = f"<div class='content'>{STORY}<p>The end.</p></div><div id='{name.split()[0]}'>{COMMENT * 9}</div>"
    for page in (inside, beside if name != "entry share" else inside):
        assert main_text(page).split("\n")[3:] == ["The end."]


@pytest.mark.parametrize(
    "name", ["no-comments", "with-ads", "has-sidebar", "comments-open", "menu-closed", "article-header", "platform"]
)
def test_names_of_layouts_and_states_are_no_marks(name):
    assert main_text(f"<div class='{name}'>{STORY}</div>").count("A long first paragraph") == 3


@pytest.mark.parametrize(
    "page",
    [
        "".join(f"<div>t{i} and some text " for i in range(40_000)),
        "<i><div>" + "<b>" * 30_000 + "</i>" * 30_000,
        "<span>" * 30_000 + "<p>x" * 30_000,
        "<table>" + "<tr><td><p>a<td>b" * 20_000,
        "<ul><li>" * 20_000 + "</div>" * 20_000 + "</ul>" * 20_000,
        "<p class='" * 20_000,
    ],
)
def test_time_grows_with_the_length(page):
    start = time.process_time()
    main_text(page)
    assert time.process_time() - start < 10


def test_links_inside_the_article_stay():
    links = "<p><a href=x>See the second part</a></p><ul><li><a href=y>The source</a></li></ul>"
    text = main_text(f"<article>{STORY}{links}</article>")
    assert text.split("\n")[3:] == ["See the second part", "The source"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/pdivb =\"'!-&;a\n", max_size=60))
def test_any_page_is_read(page):
    assert "\n\n" not in main_text(page)


def test_pages_of_the_table(spark, small_jobs):
    pages = spark.createDataFrame(
        [(1, "u", PAGE, "x"), (None, None, None, None), (1, "u", PAGE, "y")],
        "page_id long, url string, html string, text string",
    )
    got = extract_main_text(pages)
    assert got.columns == ["page_id", "url", "html", "text", "n_chars"]
    assert Counter((r.text, r.n_chars) for r in got.collect()) == Counter(
        {(main_text(PAGE), len(main_text(PAGE))): 2, ("", 0): 1}
    )
    assert extract_main_text(pages.limit(0)).collect() == []


# --- licenses


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=12), st.lists(st.integers(0, 6), max_size=12))
def test_patience_gives_increasing_pairs_of_equal_words(a, b):
    a, b = [str(x) for x in a], [str(x) for x in b]
    pairs = patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(pairs))
    if a == b:
        assert len(pairs) == len(a)


def test_patience_anchors_first():
    text = "x the license y the of this work".split()
    assert (2, 1) in patience(text, "the license of work".split())


def test_licenses_in_texts():
    scanner = Scanner()
    noise = "of the work and this under license version for public general " * 30
    text = f"{noise}\nThis work is licenced under the GNU General Public License, version 3. {noise}"
    assert [(h.license, round(h.coverage, 2)) for h in scanner.scan(text)] == [("GPL-3.0", 0.92)]
    two = "İ Released under the MIT License.\n" * 2
    assert [two[h.start : h.end] for h in scanner.scan(two)] == ["Released under the MIT License"] * 2
    assert [h.license for h in scanner.scan("Licensed under CC BY-NC 4.0.")] == ["CC-BY-NC-4.0"]
    assert scanner.scan("the MIT of this, under a license") == scanner.scan(None) == []
    assert scanner.scan(LONG) == []


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["CC-BY-NC-4.0"]),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", ["CC-BY-4.0"]),
        ("This work is licensed under a Creative Commons Attribution NonCommercial ShareAlike 3.0 Unported License.", ["CC-BY-NC-SA-3.0"]),
        ("This work is licensed under a Creative Commons Something 4.0 International License.", []),
        ("Licensed under CC BY-NC-SA 4.0", ["CC-BY-NC-SA-4.0"]),
        ("Licensed under the Apache License, Version 1.1.", ["Apache-1.1"]),
        ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
        ("Licensed under the Apache License, Version 3.0.", []),
        ("Released under the GNU Lesser General Public License, version 2.1", ["LGPL-2.1"]),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
        ("This work is licensed under the GNU General Public License, version 1.", ["GPL-1.0"]),
        ("Distributed under the GNU General Public License, version 2 or later.", ["GPL-2.0-or-later"]),
        ("This work is licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0"]),
        ("Licensed under the GNU Free Documentation License, version 3", []),
        ("Released under the GPLv2+.", ["GPL-2.0-or-later"]),
        ("SPDX-License-Identifier: GPL-2.0-only\nint x;", ["GPL-2.0"]),
        ("// SPDX-License-Identifier: BSD-3-Clause", ["BSD-3-Clause"]),
        ("Not licensed under the MIT License.", []),
        ("It isn't released under the MIT License, but free.", []),
        ("It was not. Released under the MIT License.", ["MIT"]),
        ("Neither is it fast. This is licensed under the MIT License", ["MIT"]),
    ],
)
def test_neighbour_licenses_are_told_apart(text, names):
    noise = "It holds words of the version and of a license, in general.\n\n"
    for around in (text, noise + text, noise + text + "\n" + noise):
        assert [h.license for h in Scanner().scan(around)] == names


def test_every_text_is_its_own_license():
    scanner = Scanner()
    for name, text in TEMPLATES:
        if "{" in text and len(text) > 120:
            plain = text.replace("{", "").replace("}", "")
            assert [h.license for h in scanner.scan(f"Copyright X.\n{plain}\nThe end.")] == [name], text
    terms = (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation; either version 2 of the License, "
        "or (at your option) any later version."
    )
    assert [h.license for h in scanner.scan(terms)] == ["GPL-2.0-or-later"]
    assert [h.license for h in scanner.scan(terms.replace("GNU General", "GNU Lesser General").replace("2", "2.1"))] == [
        "LGPL-2.1-or-later"
    ]


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_a_scan_finds_what_aligning_every_window_finds(data):
    """The scan skips windows without enough of a template's words; no hit is lost by that."""
    templates = [("A", "{a} b c d e f"), ("B", "{a b} c g"), ("C", "d {c} b a d c b a")]
    scanner = Scanner(templates, 0.75)
    text = " ".join(data.draw(st.lists(st.sampled_from("abcdefgxy"), max_size=40)))
    words = text.split()
    for template in scanner.templates:
        size = len(template.words) + len(template.words) // 4 + 2
        hits = [p for p in range(len(words)) if words[p] in template.words and scanner.aligned(words[p : p + size], template)]
        spans = [(2 * i, 2 * i + 1) for i in range(len(words))]
        found = list(scanner._places(words, spans, template))
        # Each window that is a hit lies in, or overlaps, one that was found, and each found is one.
        assert all(any(h.start <= 2 * (p + size) and 2 * p <= h.end for h in found) for p in hits)
        assert bool(found) == bool(hits)


def test_license_odd_rows(odd, nothing):
    rows = scan_licenses(odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in ODD)
    assert all(r.licenses == [] and r.license is None and r.coverage is None for r in rows)
    assert scan_licenses(nothing).collect() == []


def test_training_takes_the_subwords_of_few_words_at_once(monkeypatch):
    words, sizes, subwords = [f"word{k}" for k in range(4500)], [], toxicity.subwords
    ids, owner = subwords(words, Settings())

    def watched(part, settings):
        sizes.append(len(part))
        return subwords(part, settings)

    monkeypatch.setattr(toxicity, "subwords", watched)
    train([" ".join(words), "word1"], [1, 0], Settings(epochs=1))
    assert sum(sizes) == len(words) and max(sizes) <= 2000
    for number, bag in enumerate(toxicity._bags(words, Settings())):
        assert bag.tolist() == ids[owner == number].tolist()
    assert toxicity._bags([], Settings()) == []
