import hashlib
import itertools
import random
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cratework.llm.alignment import edit_distance, similarity
from cratework.llm.common import folded
from cratework.llm.compact_windows import (
    compact_windows,
    repeated_passages,
    shared_passages,
    side_bits,
    side_cases,
    side_keys,
    side_labels,
    side_reach,
)
from cratework.llm.components import components
from cratework.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from cratework.llm.line_dedup import drop_repeated_lines
from cratework.llm import order_minhash as near
from cratework.llm.order_minhash import (
    PAIR_SLOTS,
    RETAINED,
    SHINGLE,
    SKETCHES,
    SLOTS,
    WordHashes,
    drop_near_duplicates,
    mixed,
    near_duplicates,
    order_minhash,
    rarest_pairs,
    rarest_words,
    shingle_hashes,
    text_bits,
)
from tests.llm.conftest import CLASHING, LONG, ODD, documents

FOLDER = "/root/testdata/sf0.01"


def ascii_lower(text):
    return (text or "").encode().lower().decode()


def test_folded_changes_only_a_to_z(spark, small_jobs):
    texts = ["ABC xyz", "ÀÉ ABC ß İ", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(folded(F.col("t")))
    assert [r[0] for r in df.collect()] == [ascii_lower(t) for t in texts]


def expected_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[ascii_lower(t)].append(i)
    out = Counter()
    for i, t in rows:
        group = groups[ascii_lower(t)]
        keep = max((g for g in group if g is not None), default=None)
        sha = hashlib.sha256(ascii_lower(t).encode()).hexdigest()
        out[(i, keep, len(group), i == keep, sha)] += 1
    return out


def test_exact_duplicates_odd_rows(odd):
    got = Counter(tuple(r) for r in exact_duplicates(odd).collect())
    assert got == expected_groups(ODD)
    kept = drop_exact_duplicates(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 4, 5, 6, None])


def test_exact_duplicates_compare_texts_when_digests_collide(spark, small_jobs):
    rows = [(i, f"text {i % 7}") for i in range(50)]
    df = exact_duplicates(documents(spark, rows), digest=lambda text: F.lit("same"))
    assert Counter(tuple(r) for r in df.collect()) == expected_groups(rows)


def test_nothing_gives_nothing(nothing):
    assert exact_duplicates(nothing).collect() == []
    assert drop_repeated_lines(nothing).collect() == []
    assert near_duplicates(nothing).collect() == []
    assert repeated_passages(nothing).collect() == []


def expected_lines(rows, min_docs):
    docs = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            docs[ascii_lower(line.strip(" \t\n\x0b\x0c\r"))].add(i)
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        keys = [ascii_lower(x.strip(" \t\n\x0b\x0c\r")) for x in lines]
        kept = [x for x, k in zip(lines, keys) if not k or len(docs[k]) < min_docs]
        out[(i, "\n".join(kept), len(lines), len(lines) - len(kept))] += 1
    return out


def test_repeated_lines(spark, small_jobs):
    rng = random.Random(3)
    pool = ["Common Line", "common line ", "rare", "", " ", "é", "É", "x" * 300, "last"]
    rows = [
        (i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(200)))) for i in range(30)
    ]
    rows += [*ODD, (77, None), (77, "Common line\nother"), (77, "rare")]
    docs = documents(spark, rows).withColumn("__x", F.lit(1))
    for min_docs in (2, 10):
        got = drop_repeated_lines(docs, min_docs=min_docs)
        assert set(got.columns) == {*docs.columns, "n_lines", "n_dropped"}
        found = got.select("doc_id", "text", "n_lines", "n_dropped").collect()
        assert Counter(map(tuple, found)) == expected_lines(rows, min_docs)


def test_min_chars_keeps_short_lines(spark, small_jobs):
    docs = documents(spark, [(1, "ab\nlonger"), (2, "ab\nlonger")])
    got = drop_repeated_lines(docs, min_docs=2, min_chars=3).select("text").collect()
    assert [r.text for r in got] == ["ab", "ab"]


words = st.lists(st.integers(0, 4), max_size=14)


@settings(max_examples=300, deadline=None)
@given(words, words, st.integers(0, 14))
def test_edit_distance(a, b, most):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    got = edit_distance(np.array(a, np.uint64), np.array(b, np.uint64), most)
    assert got == (row[-1] if row[-1] <= most else None)


def test_components(spark, small_jobs):
    rng = random.Random(5)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    links += [(100 + i, 101 + i) for i in range(30)] + [(7, 7)]
    parent = {n: n for link in links for n in link}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(
        [(bytes([a]), bytes([b])) for a, b in links], "a binary, b binary"
    )
    got = {r.node[0]: r.label[0] for r in components(df).collect()}
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: find(n) for n in linked}


def near_truth(rows, least):
    hashes = WordHashes()
    sequences = [hashes.of_text(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    order = sorted(range(len(rows)), key=lambda i: len(sequences[i]))
    for place, i in enumerate(order):
        for j in order[place + 1 :]:
            if len(sequences[i]) < least * len(sequences[j]):
                break
            if similarity(sequences[i], sequences[j], least) is not None:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(rows))]


def test_near_duplicates_match_brute_force(spark):
    rows = [
        (r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    ]
    truth = near_truth(rows, 0.8)
    got = {r.doc_id: r for r in near_duplicates(documents(spark, rows)).collect()}
    want = defaultdict(list)
    for (i, _), label in zip(rows, truth):
        want[label].append(i)
    for members in want.values():
        assert {got[i].group_id for i in members} == {min(members)}
        assert {got[i].group_size for i in members} == {len(members)}


def test_near_duplicates_odd_rows(odd):
    got = Counter((r.doc_id, r.group_id, r.group_size) for r in near_duplicates(odd).collect())
    # Empty texts are equal; so are those of white space alone.
    want = [(1, 1, 2), (1, 1, 2), (2, 2, 4), (3, 2, 4), (None, 2, 4), (5, 2, 4)]
    want += [(None, None, 1), (4, 4, 1), (6, 6, 1)]
    assert got == Counter(want)
    kept = drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, None, 4, 6])


def test_chain_of_near_copies_is_one_group(spark):
    base = LONG.split()[:300]
    rows = []
    for i in range(12):
        base = base.copy()
        for k in range(12):
            base[(i * 25 + k * 7) % 300] = f"new{i}y{k}"
        rows.append((i, " ".join(base)))
    got = near_duplicates(documents(spark, rows)).collect()
    assert {(r.group_id, r.group_size) for r in got} == {(0, 12)}


def test_texts_at_the_threshold_share_a_sketch():
    rng = np.random.default_rng(5)
    missed = 0
    for _ in range(200):
        text = rng.integers(0, 2**63, 300).astype(np.uint64)
        edited = text.copy()
        edited[rng.permutation(300)[:60]] = rng.integers(0, 2**63, 60).astype(np.uint64)
        found = [order_minhash(w, SHINGLE, SKETCHES, RETAINED) for w in (text, edited)]
        missed += not (found[0] == found[1]).any()
    assert missed <= 4


def test_every_pair_of_a_hot_bucket_is_compared(spark, small_jobs):
    """Texts with one template: only the two of a pair are alike, and most share one bucket."""
    rows = []
    for t in range(0, 60, 2):
        own = [f"t{t}w{k}" for k in range(30)]
        rows.append((t, " ".join([f"all{k}" for k in range(70)] + own)))
        rows.append((t + 1, " ".join([f"all{k}" for k in range(70)] + own[:20] + [f"u{t}w{k}" for k in range(10)])))
    words = WordHashes()
    buckets = {i: int(order_minhash(words.of_text(t), 1, 1, 1)[0]) for i, t in rows}
    together = [t for t in range(0, 60, 2) if buckets[t] == buckets[t + 1]]
    assert max(Counter(buckets.values()).values()) > 20
    got = near_duplicates(documents(spark, rows), size=1, sketches=1, retained=1).collect()
    groups = {r.doc_id: r.group_id for r in got}
    assert [t for t in together if groups[t] != groups[t + 1]] == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=25), st.integers(1, 6))
def test_compact_windows_cover_each_subsequence_once(values, length):
    found = compact_windows(np.array(values, np.uint64), length)
    assert sorted(found) == sorted(compact_windows(np.array(values, np.uint64), length, False))
    for i in range(len(values)):
        for j in range(i + length - 1, len(values)):
            least = min(values[i : j + 1])
            mine = [w for w in found if w[0] <= i <= w[1] <= j <= w[2]]
            assert len(mine) == 1 and values[mine[0][1]] == least


def test_repeated_passages_match_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: (r.text or "").lower().split() for r in docs.collect()}
    spans = defaultdict(list)
    for r in repeated_passages(docs).collect():
        assert r.end_word - r.start_word >= 50 and r.n_docs > 1
        spans[r.doc_id].append((r.start_word, r.end_word, r.passage_class))
    places = defaultdict(list)
    for i, words in texts.items():
        for p in range(len(words) - 49):
            places[" ".join(words[p : p + 50])].append((i, p))
    for found in places.values():
        if len({i for i, _ in found}) > 1:
            classes = {
                frozenset(c for a, b, c in spans[i] if a <= p and p + 50 <= b) for i, p in found
            }
            assert len(classes) == 1 and classes.pop()


def test_repeated_passages_odd_rows(spark, small_jobs):
    passage = LONG.split()[100:160]
    edited = passage.copy()
    edited[30] = "changed"
    rows = [
        *ODD,
        (10, " ".join(["a1", "b1", *passage, "c1"])),
        (11, " ".join([*edited, "d1", "e1"])),
        (12, " ".join(passage[:45])),
    ]
    got = repeated_passages(documents(spark, rows)).collect()
    found = {(r.doc_id, r.start_word, r.end_word, r.first_doc_id, r.n_docs) for r in got}
    # Document 4 holds the passage too; 12 is too short to hold 50 words of it.
    assert found == {(4, 100, 160, 4, 3), (10, 2, 62, 4, 3), (11, 0, 60, 4, 3)}
    assert len(CLASHING) == 9


def test_edits_on_both_sides_of_every_anchor_are_found(spark, small_jobs):
    """60 words with an edit in every ten: no two anchors have ten equal words on a side."""
    rows = []
    for t in range(0, 80, 2):
        passage = [f"t{t}w{k}" for k in range(60)]
        edited = [f"t{t}e{k}" if k % 9 == 8 else w for k, w in enumerate(passage)]
        for i, words in ((t, passage), (t + 1, edited)):
            around = [f"i{i}w{k}" for k in range(120)]
            rows.append((i, " ".join(around[:60] + words + around[60:])))
    got = {r.doc_id for r in repeated_passages(documents(spark, rows)).collect()}
    assert sum(t in got and t + 1 in got for t in range(0, 80, 2)) >= 32


@pytest.mark.parametrize("pairs, compared", [(5, 2048), (40, 2048), (40, 20)])
def test_every_pair_of_windows_of_a_bucket_is_compared(spark, small_jobs, monkeypatch, pairs, compared):
    """Pairs alike but for edits beside the five words that all have, in small and large buckets."""
    monkeypatch.setattr("cratework.llm.compact_windows.COMPARED", compared)
    rng, rows, known = random.Random(4), [], WordHashes()
    seed = mixed(np.arange(101, 102, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0] | np.uint64(1)
    commons = [[f"all{m}x{k}" for k in range(5)] for m in range(3000)]
    common = min(commons, key=lambda c: (shingle_hashes(known.of_text(" ".join(c)), 5) * seed)[0])
    for t in range(0, 2 * pairs, 2):
        passage = [f"t{t}w{k}" for k in range(75)]
        passage[35:40] = common
        edited = [f"t{t}e{k}" if k in (20, 30, 44, 54) else w for k, w in enumerate(passage)]
        for i, words in ((t, passage), (t + 1, edited)):
            around = [f"i{i}w{k}" for k in range(rng.randrange(2, 9))]
            rows.append((i, " ".join([*around, *words, *around])))
    windows = defaultdict(list)
    sequences = {i: known.of_text(t) for i, t in rows}
    for i, sequence in sequences.items():
        values = shingle_hashes(sequence, 5) * seed
        for _, at, _ in compact_windows(values, 46):
            windows[int(values[at])].append((i, at))
    want = set()
    for bucket in windows.values():
        for (i, p), (j, q) in itertools.combinations(bucket, 2):
            if i != j and shared_passages(sequences[i], sequences[j], [(p, q)], 50, 0.8):
                want.add((i, j))
    assert max(map(len, windows.values())) > pairs and len(want) >= pairs // 2
    got = repeated_passages(documents(spark, rows), hashes=1).collect()
    classes = {r.doc_id: r.passage_class for r in got}
    assert [(i, j) for i, j in sorted(want) if i not in classes or classes[i] != classes.get(j)] == []


def test_windows_with_a_passage_share_a_word_beside_their_anchor():
    rng = np.random.default_rng(3)
    counts, sides, found = np.full(SLOTS, 2), side_reach(50, 0.8), 0
    cases = side_cases(50, 0.8)
    counts[rng.permutation(SLOTS)[: SLOTS // 2]] = 1000
    for _ in range(3000):
        length = int(rng.integers(50, 90))
        base = rng.integers(1, 40, length).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        at = int(rng.integers(0, length - 5))
        texts = []
        for _ in range(2):
            text, place = base.tolist(), at
            for _ in range(int(rng.integers(0, 9))):
                kind, k = int(rng.integers(0, 3)), int(rng.integers(0, len(text)))
                if place <= k < place + 5:
                    continue
                text[k : k + int(kind > 0)] = [int(rng.integers(1, 2**63))] * int(kind < 2)
                place += (kind == 0 and k < place) - (kind == 2 and k < place)
            texts.append((np.array(text, np.uint64), place))
        (a, i), (b, j) = texts
        if not shared_passages(a, b, [(i, j)], 50, 0.8):
            continue
        found += 1
        labels = [side_labels(w, p, sides) for w, p in texts]
        keys = [set(side_keys(side, counts, sides).tolist()) for side in labels]
        assert keys[0] & keys[1]
        bits = [side_bits(w, p, cases).reshape(len(cases) + 1, 2, -1).view(np.uint64) for w, p in texts]
        for x, y in (bits, bits[::-1]):
            missing = [int(np.bitwise_count(near & ~y[-1]).sum()) for near in x[:-1]]
            assert any(n <= edits for n, (*_, edits) in zip(missing, cases))
    assert found > 500


@pytest.mark.parametrize("copies", [2, 40])
def test_whole_copies_are_passages(spark, small_jobs, copies):
    text = " ".join(LONG.split()[:80])
    got = repeated_passages(documents(spark, [(i, text) for i in range(copies)])).collect()
    assert {(r.doc_id, r.start_word, r.end_word, r.n_docs) for r in got} == {
        (i, 0, 80, copies) for i in range(copies)
    }


def test_pairs_whose_words_many_others_have_are_compared(spark, small_jobs):
    """Alike only in what is found in over a hundred texts of their bucket; no centre links them."""
    rng = random.Random(11)
    frequent = [f"f{k}" for k in range(60)]
    rows = []
    for t in range(0, 240, 2):
        own = rng.sample(frequent, 30)
        rows.append((t, " ".join([f"all{k}" for k in range(70)] + own)))
        swapped = [own[k + 1 - 2 * (k % 2)] if k < 8 else w for k, w in enumerate(own)]
        rows.append((t + 1, " ".join([f"all{k}" for k in range(70)] + swapped)))
    words = WordHashes()
    buckets = Counter(int(order_minhash(words.of_text(t), 1, 1, 1)[0]) for _, t in rows)
    assert max(buckets.values()) > 32
    got = near_duplicates(documents(spark, rows), least=0.9, size=1, sketches=1, retained=1).collect()
    groups = {r.doc_id: r.group_id for r in got}
    bucket = {i: int(order_minhash(words.of_text(t), 1, 1, 1)[0]) for i, t in rows}
    missed = [t for t in range(0, 240, 2) if bucket[t] == bucket[t + 1] and groups[t] != groups[t + 1]]
    assert missed == []


def test_rarest_words_and_bits_keep_all_similar_texts():
    rng = np.random.default_rng(8)
    counts = np.full(SLOTS, 2)
    counts[rng.permutation(SLOTS)[: SLOTS // 2]] = 1000
    for size in (1, 4, 5, 40, 300):
        text = rng.integers(0, 60, size).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for _ in range(50):
            edited = text.tolist()
            for _ in range(int(0.2 * size + 1e-9)):
                kind, at = rng.integers(0, 3), rng.integers(0, len(edited))
                edited[at : at + int(kind > 0)] = [int(rng.integers(0, 2**63))] * int(kind < 2)
            edited = np.array(edited, np.uint64)
            if similarity(text, edited, 0.8) is None:
                continue
            first = [set(rarest_words(w, counts, 0.8).tolist()) for w in (text, edited)]
            assert first[0] & first[1]
            differ = np.bitwise_count((text_bits(text) ^ text_bits(edited)).view(np.uint64))
            most = int(0.2 * max(len(text), len(edited)) + 1e-9)
            assert differ.sum() <= 4 * most


def test_rarest_pairs_keep_all_similar_texts():
    rng = np.random.default_rng(9)
    counts = rng.integers(2, 200, PAIR_SLOTS).astype(np.uint8)
    for size, least in ((0, 0.8), (1, 0.8), (2, 0.5), (5, 0.6), (9, 0.7), (40, 0.8), (300, 0.8)):
        text = rng.integers(0, 60, size).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for _ in range(40):
            edited = text.tolist()
            for _ in range(int((1 - least) * size + 1e-9)):
                kind, at = rng.integers(0, 3), rng.integers(0, len(edited) + 1)
                edited[at : at + int(kind > 0)] = [int(rng.integers(0, 2**63))] * int(kind < 2)
            edited = np.array(edited, np.uint64)
            if similarity(text, edited, least) is None:
                continue
            first = [rarest_pairs(w, counts, least) for w in (text, edited)]
            assert any(f is None for f in first) or set(first[0].tolist()) & set(first[1].tolist())
            bands = [near._length_band(len(w), least) for w in (text, edited)]
            assert abs(bands[0] - bands[1]) <= 1


def test_only_members_with_a_partner_are_compared_by_words(spark, small_jobs, monkeypatch):
    """Forty texts of the same words in other orders, and an edited copy of one of them."""
    rng, words = random.Random(5), [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.sample(words, 60)) for _ in range(40)]
    texts.append(" ".join([*texts[7].split()[:55], "a", "b", "c", "d", "e"]))
    rows = [(1, bytes([i]) * 16, 60, bytes([i]) * 16, len(texts)) for i in range(len(texts))]
    mixed_rows = spark.createDataFrame(rows, "key long, node binary, words long, label binary, n long")
    table = [(bytes([i]) * 16, t) for i, t in enumerate(texts)]
    whole = spark.createDataFrame(table, "node binary, text string")
    seen, rare_words = [], near._rare_words

    def watched(nodes, *rest):
        seen.extend(bytes(r.node)[0] for r in nodes.collect())
        return rare_words(nodes, *rest)

    monkeypatch.setattr(near, "_rare_words", watched)
    pairs = near._unresolved(mixed_rows, whole, 0.8).collect()
    assert {7, 40} <= set(seen) and len(seen) < 20
    assert (40, 7) in [(r.a[0], r.b[0]) for r in pairs]


def test_marks_of_similar_texts_differ_in_few_places():
    rng = np.random.default_rng(10)
    for size in (1, 4, 33, 63, 300, 520):
        text = rng.integers(0, 60, size).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for kinds in ((0, 3), (0, 1), (1, 2), (2, 3)):
            for _ in range(20):
                edited = text.tolist()
                for _ in range(int(0.2 * size + 1e-9)):
                    kind, at = rng.integers(*kinds), rng.integers(0, len(edited) + 1)
                    edited[at : at + int(kind > 0)] = [int(rng.integers(0, 2**63))] * int(kind < 2)
                edited = np.array(edited, np.uint64)
                if similarity(text, edited, 0.8) is None:
                    continue
                marks = [near.text_marks(w) for w in (text, edited)]
                most = near.words_alone(len(text), len(edited), 0.8)
                assert near.differing(*marks) == near.differing(*marks[::-1]) <= most
    assert near.text_marks(np.zeros(0, np.uint64)) == bytes(8)


def test_texts_move_only_for_pairs_that_may_be_similar(spark, small_jobs, monkeypatch):
    """Sixty texts with a template of half their words; only two are similar."""
    texts = [" ".join([f"all{k}" for k in range(40)] + [f"t{t}w{k}" for k in range(40)]) for t in range(60)]
    texts.append(" ".join([*texts[7].split()[:75], "a", "b", "c", "d", "e"]))
    moved, aligned = [], near._aligned

    def watched(pairs, *rest):
        moved.extend(pairs.collect())
        return aligned(pairs, *rest)

    monkeypatch.setattr(near, "_aligned", watched)
    docs = documents(spark, list(enumerate(texts)))
    got = near_duplicates(docs, size=1, sketches=4, retained=1).collect()
    assert {(r.doc_id, r.group_id) for r in got if r.group_size > 1} == {(7, 7), (60, 7)}
    assert 1 <= len(moved) < 10


def test_sketches_are_deleted_when_they_were_read(spark, small_jobs):
    made = sys.modules["cratework.session"]._made
    before = set(made)
    near_duplicates(documents(spark, [(i, LONG) for i in range(3)] + ODD)).collect()
    left = [spark.read.parquet(path).columns for path in made if path not in before]
    assert left and not any({"_buckets", "buckets", "text"} & set(columns) for columns in left)


def test_word_counts_move_packed(spark, small_jobs, monkeypatch):
    """A row per share and task, however many words there are."""
    summed, rows = near._summed, []

    def watched(pieces, *rest):
        rows.append(pieces.count())
        return summed(pieces, *rest)

    monkeypatch.setattr(near, "_summed", watched)
    texts = [" ".join(f"t{t}w{k} all{k} all{k}" for k in range(300)) for t in range(20)]
    counts = near.word_counts(documents(spark, list(enumerate(texts))).coalesce(1))
    assert rows[0] <= near.SHARES and counts.sum() == 20 * 900
    hashes = WordHashes()
    of_all = near.slots(near.labelled(hashes.of_text(" ".join(f"all{k}" for k in range(300)))))
    assert (counts[of_all] >= 20).all()


def test_kept_documents_move_once(spark, small_jobs, monkeypatch):
    """Joined with the groups and told apart by one key, texts pass a single exchange."""
    rows = [(1, "a b"), (1, "a b"), (1, "c d"), (2, "a b"), (None, "e f"), (None, "e f"), (3, None)]
    docs = documents(spark, rows).withColumn("more", F.lit(1))
    node = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    first = F.when(F.col("doc_id") == 2, 1).otherwise(F.col("doc_id"))
    groups = docs.select("doc_id", first.alias("group_id"), node.alias("node"))
    monkeypatch.setattr(near, "near_duplicates", lambda *a, **b: groups)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = drop_near_duplicates(docs)
        assert kept.columns == docs.columns
        found = Counter((r.doc_id, r.text, r.more) for r in kept.collect())
        assert found == Counter(
            [(1, "a b", 1), (1, "c d", 1), (None, "e f", 1), (3, None, 1)]
        )
        plan = kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("Exchange hashpartitioning") == 2
