"""op11 to op13 against brute force, on small tables and odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)
from tokenizers import Tokenizer

from cratework.llm.packing import (
    ByteEncoder,
    Packer,
    default_tokenizer,
    pack_documents,
    token_windows,
)
from cratework.llm.spelling import group_spellings
from cratework.llm.vector_codes import Orchard, compress_vectors
from tests.llm.conftest import LONG, documents

ENCODER = Tokenizer.from_file(default_tokenizer())


# ---- op11


def words_by_hand(rows, min_chars=7):
    counts = Counter()
    for doc, text in rows:
        runs, run = [], ""
        for c in (text or "") + "\n":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c < "\x80" else c
            elif run:
                runs.append(run)
                run = ""
        for run in runs:
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_chars and n >= 2}


def is_near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def spellings_by_hand(rows, min_chars=7):
    words = words_by_hand(rows, min_chars)
    out, form = {}, {}
    for word, n in words.items():
        near = [w for w in words if w != word and abs(len(w) - len(word)) < 2 and is_near(w, word)]
        best = min(near, key=lambda w: (-words[w], w), default=None)
        form[word] = best if best and words[best] >= 10 * n else None
        out[word] = [form[word], n, len(near), words[best] if form[word] else None]
    for word, row in out.items():
        root = word
        while form[root]:
            root = form[root]
        row.insert(1, root)
    return {w: tuple(r) for w, r in out.items()}


def spellings(df):
    rows = df.collect()
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(found) == len(rows)
    return found


def misspelt(seed, n_docs=60):
    """Documents of few base words, of which rarer and rarer misspellings are made."""
    pick = random.Random(seed)
    base = ["collection", "ÀÉÿcollectiön", "mississippi", "aaaaaaaaaa", "Abcdefg", "x" * 70, "y" * 63]
    chains = []
    for word in base:
        chain = [word]
        for _ in range(3):
            w, p = chain[-1], pick.randrange(len(chain[-1]))
            letter = pick.choice("abcdefgÿé")
            chain.append(pick.choice([w[:p] + w[p + 1 :], w[:p] + letter + w[p:], w[:p] + letter + w[p + 1 :]]))
        chains.append(chain)
    rows = []
    for i in range(n_docs):
        text = []
        for chain in chains:
            for k, word in enumerate(chain):
                times = (200, 12, 0, 0)[k] if i < 10 else int(pick.random() < 0.08)
                text += [word] * times
        pick.shuffle(text)
        rows.append((i, pick.choice([" ", ", ", "-", "1"]).join(text)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_spellings_are_those_of_brute_force(spark, small_jobs, seed):
    rows = misspelt(seed) + [(None, "Collection collection"), (7, None), (8, "")]
    want = spellings_by_hand(rows)
    assert any(r[1] != w and r[0] != r[1] for w, r in want.items()), "no chain of forms"
    assert spellings(group_spellings(documents(spark, rows))) == want


def test_filters_in_many_rounds_find_the_same(spark, small_jobs):
    pick = random.Random(5)
    made = ["".join(pick.choice("ab") for _ in range(9)) for _ in range(300)]
    rows = [(i, " ".join(made[i::3] * 2)) for i in range(3)]
    docs = documents(spark, rows)
    want = spellings_by_hand(rows)
    assert spellings(group_spellings(docs)) == want
    many = [(0, " ".join(f"{a}{b}{c}zzzz" for a in "abcdefghijklmnop" for b in "abcdefghijklmnop" for c in "abcdefghijklmnopqrst"))] * 2
    one = spellings(group_spellings(documents(spark, many)))
    assert spellings(group_spellings(documents(spark, many), broadcast_bytes=1)) == one
    assert len(one) > 4096 and max(r[3] for r in one.values()) >= 49  # of a word that lost no letter


def test_spellings_of_odd_rows(spark, odd, nothing):
    from tests.llm.conftest import ODD

    assert spellings(group_spellings(odd, min_chars=3)) == spellings_by_hand(ODD, 3)
    assert spellings(group_spellings(nothing)) == {}
    giant = [(1, "q" * 5000 + " " + "q" * 4999 + "r"), (2, "q" * 5000 + " " + "q" * 4999 + "r")]
    assert spellings(group_spellings(documents(spark, giant))) == spellings_by_hand(giant)


# ---- op12


def packed(df):
    return [r.asDict() for r in df.collect()]


def check_pieces(pieces, docs, window):
    """Every id of every document lies in one piece, and every sequence is gapless."""
    want = sorted(tuple(ENCODER.encode(t or "", add_special_tokens=False).ids + [1]) for t in docs)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        assert p["length"] == len(p["ids"]) // 4 > 0
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    got = []
    for own in by_doc.values():
        own.sort(key=lambda p: p["start"])
        ids = b"".join(p["ids"] for p in own)
        assert [p["start"] for p in own] == np.cumsum([0] + [p["length"] for p in own])[:-1].tolist()
        assert {p["doc_tokens"] for p in own} == {len(ids) // 4}
        got.append(tuple(np.frombuffer(ids, "<u4").tolist()))
    assert sorted(got) == want
    padding = 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        total = sum(p["length"] for p in own)
        assert [p["offset"] for p in own] == np.cumsum([0] + [p["length"] for p in own])[:-1].tolist()
        assert total <= window
        padding += 0 if total & (total - 1) == 0 else window - total
    return padding


def test_pieces_hold_every_document(spark, small_jobs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    texts = [r["text"] for r in docs.select("text").collect()]
    pieces = packed(pack_documents(docs, default_tokenizer()))
    assert check_pieces(pieces, texts, 2048) == 0
    # Documents are cut where they must be, and else only to close windows.
    cuts = Counter(p["doc_id"] for p in pieces)
    needed = {p["doc_id"]: -(-p["doc_tokens"] // 2048) for p in pieces}
    assert sum(cuts[d] > needed[d] for d in cuts) < 0.2 * len(cuts)


def test_windows_are_the_sequences(spark, small_jobs):
    rows = [(i, "alpha beta gamma " * (i % 11)) for i in range(50)]
    pieces = pack_documents(documents(spark, rows).coalesce(1), default_tokenizer(), window=64)
    wholes = {r["sequence_id"]: r for r in token_windows(pieces).collect()}
    for p in packed(pieces):
        whole = bytes(wholes[p["sequence_id"]]["ids"])
        assert whole[4 * p["offset"] :][: 4 * p["length"]] == bytes(p["ids"])
    assert all(r["length"] * 4 == len(r["ids"]) <= 256 for r in wholes.values())


def test_packing_of_odd_rows(spark, odd, nothing):
    from tests.llm.conftest import ODD

    numbered = odd.withColumn("doc_id", F.monotonically_increasing_id())
    assert check_pieces(packed(pack_documents(numbered, default_tokenizer())), [t for _, t in ODD], 2048) == 0
    assert packed(pack_documents(nothing, default_tokenizer())) == []
    empty = documents(spark, [(i, None) for i in range(5)]).coalesce(1)
    assert {(p["doc_id"], p["doc_tokens"], bytes(p["ids"])) for p in packed(pack_documents(empty, default_tokenizer()))} == {
        (i, 1, b"\x01\0\0\0") for i in range(5)
    }
    with pytest.raises(ValueError):
        pack_documents(empty, default_tokenizer(), window=100)


def test_ids_are_those_of_the_library():
    with open(default_tokenizer(), encoding="utf-8") as file:
        encode = ByteEncoder(file.read())
    assert encode.fast is not None
    pick = random.Random(1)
    odd = ["a", " ", "\n", "\t", "  ", "'s", "'S", "é", "漢", "🙂", " ", " ", "1", "½", "\x00", "<|endoftext|>", "!?", "́", "ß", "don't"]
    texts = ["".join(pick.choices(odd, k=pick.randrange(30))) for _ in range(3000)]
    texts += [LONG, "a" * 20_000, " " * 20_000, "\n" * 5000 + "x", "", "ab " * 5000]
    for text in texts:
        assert encode(text).tolist() == ENCODER.encode(text, add_special_tokens=False).ids


def test_a_level_is_chosen_by_the_sum_of_squares():
    pick, size = random.Random(2), 64
    packer, placed = Packer(size, 0, most_open=10**9), Counter()
    for doc in range(3000):
        length = pick.randrange(1, size)
        counts = packer.counts.copy()

        def squares(level):
            after = counts.copy()
            if level:
                after[level] -= 1
            if level + length < size:
                after[level + length] += 1
            return int((after[1:size] ** 2).sum())

        choices = [h for h in range(size - length + 1) if not h or counts[h]]
        want = min(choices, key=lambda h: (squares(h), -h))
        assert packer.level_for(length) == want
        placed[want > 0] += 1
        list(packer.add(doc, np.zeros(length, "<u4")))
    assert placed[True] > 1000
    assert packer.counts.tolist() == [len(x) for x in packer.open] + [0]


@pytest.mark.parametrize("lengths", [[40] * 1000, [1] * 1000, [63, 2] * 500, list(range(1, 400)), [64], []])
def test_open_windows_are_bounded_and_nothing_is_padded(lengths):
    packer, rows = Packer(64, 5, most_open=7), []
    for doc, length in enumerate(lengths):
        rows += packer.add(doc, np.arange(length, dtype="<u4"))
        assert packer.n_open <= 7
    rows += packer.finish()
    found, sequences = {}, {}
    for doc, start, length, ids, total, number, offset in rows:
        assert length == len(ids) and ids.tolist() == list(range(start, start + length))
        assert total == lengths[doc]
        found[doc] = found.get(doc, 0) + length
        assert offset == sequences.get(number, 0)
        sequences[number] = offset + length
    assert found == dict(enumerate(lengths))
    sizes = list(sequences.values())
    assert all(n & (n - 1) == 0 for n in sizes)
    assert sum(n < 64 for n in sizes) <= 6 and sorted(sequences) == list(range(5, 5 + len(sizes)))


# ---- op13

VECTORS = StructType(
    [
        StructField("vec_id", LongType()),
        StructField("embedding", ArrayType(FloatType())),
        StructField("label", IntegerType()),
        StructField("code", StringType()),
        StructField("error", StringType()),
        StructField("numbers", StringType()),
    ]
)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, None, "x", None) for r in rows], VECTORS)


def codes_by_hand(rows, parts=16, entries=64, rounds=2):
    kept = [
        (i, [math.floor(256 * x) for x in v], label)
        for i, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    if not kept:
        return []
    size = len(kept[0][1]) // parts
    cut = [[tuple(v[p * size : (p + 1) * size]) for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0], kept[k][1]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]

    def nearest(book, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = [[] for _ in books[p]]
            for row in cut:
                members[nearest(books[p], row[p])[1]].append(row[p])
            books[p] = [
                tuple(sum(c) // len(m) for c in zip(*m)) if m else e for m, e in zip(members, books[p])
            ]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded, totals = [], Counter()
    for (i, _, label), row in zip(kept, cut):
        found = [nearest(books[p], row[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        totals[label] += error
        coded.append((i, "".join(f"{e:02x}" for _, e in found), error, label))
    return sorted(((i, c, e, totals[label], digest) for i, c, e, label in coded), key=repr)


def codes(df):
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert df.columns == names
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("spread", [1.0, 0.01])
def test_codes_are_those_of_brute_force(spark, small_jobs, spread):
    pick = random.Random(int(100 * spread))
    rows = [
        (i, [float(np.float32(pick.gauss(0, spread))) for _ in range(32)], pick.choice([None, 1, 1, 1, 2, 3]))
        for i in pick.sample(range(1000), 300)
    ]
    assert codes(compress_vectors(vectors(spark, rows))) == codes_by_hand(rows)


def test_codes_of_odd_rows(spark, small_jobs):
    nan, inf = float("nan"), float("inf")
    good = [0.5, -0.5] * 8
    rows = [
        (3, good, 1), (3, good, 1), (3, [0.25] * 16, None), (None, [0.125] * 16, None), (4, None, 1),
        (5, [None] + good[1:], 1), (0, [nan] + good[1:], 1), (1, [inf] + good[1:], 1), (2, [-inf] + good[1:], 2),
    ]
    assert codes(compress_vectors(vectors(spark, rows))) == codes_by_hand(rows)
    assert len(codes_by_hand(rows)) == 4
    assert codes(compress_vectors(vectors(spark, []))) == []
    assert codes(compress_vectors(vectors(spark, rows[4:]))) == []
    assert [r[1:4] for r in codes(compress_vectors(vectors(spark, [(1, [], 1)])))] == [("00" * 16, 0, 0)]
    for wrong in ([1.0] * 17, [1.0] * 32, [1e9] + good[1:]):
        with pytest.raises(Exception):
            compress_vectors(vectors(spark, [(1, good, 1), (2, wrong, 1)])).collect()


def test_many_labels_and_few_are_summed_alike(spark, small_jobs):
    pick = random.Random(9)
    rows = [(i, [pick.random() for _ in range(16)], i if i > 900 else i % 2) for i in range(3000)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    got = codes(compress_vectors(vectors(spark, rows), rounds=0))
    totals = Counter()
    labels = {i: label for i, _, label in rows}
    for i, _, error, _, _ in got:
        totals[labels[i]] += error
    assert len(got) == 3000 and all(r[3] == totals[labels[r[0]]] for r in got)


def test_orchards_search_finds_the_lowest_of_the_nearest():
    pick = np.random.default_rng(4)
    for spread in (2, 5, 100):
        entries = pick.integers(-spread, spread, (64, 4))
        rows = pick.integers(-spread, spread, (5000, 4))
        apart = ((rows[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        best, least = Orchard(entries).nearest(rows)
        assert (best == apart.argmin(axis=1)).all() and (least == apart.min(axis=1)).all()
    best, least = Orchard(entries[:1]).nearest(rows)
    assert not best.any() and (least == apart[:, 0]).all()
