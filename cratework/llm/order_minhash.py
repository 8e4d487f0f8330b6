"""Near-duplicate documents: Order MinHash candidates, verified by banded alignment."""

from __future__ import annotations

import functools
import operator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cratework.llm.alignment import similarity
from cratework.llm.common import text_or_empty
from cratework.llm.components import components
from cratework.llm.per_row import append_columns, ship_package
from cratework.session import dropped, written

SHINGLE = 3
SIMILARITY = 0.8
SKETCHES = 48
RETAINED = 2

#: Centres that the members of a mixed bucket are compared with, after its least node.
FURTHER = 3

#: Members of a bucket of which all pairs are compared.
SMALL = 16

#: Counters of how many texts have a word; 64-bit parts of a text's bits.
SLOTS, PARTS = 1 << 21, 16

#: Counters of how many texts have a pair of adjacent words; shares that the pairs are dealt into.
PAIR_SLOTS, SHARES = 1 << 24, 64

#: Rows with texts that a Python worker takes at once.
_BATCH = 1000

#: Numbers that a text's length is told by beside a pair of words.
_BANDS = 64

#: Packed values of a share.
_SHARE = "share bigint, found binary"

_ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words; those of the first ``most`` words, so frequent ones, are kept."""

    def __init__(self, most: int = 50_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < self.most:
            self[word] = value
        return value

    def of_text(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    values = (values ^ (values >> np.uint64(31))) * _ODD
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words; shorter sequences are one run."""
    size = min(size, len(words))
    if size == 0:
        return np.zeros(1, np.uint64)
    count = len(words) - size + 1
    total = words[:count].copy()
    for i in range(1, size):
        total *= _ODD
        total += words[i : i + count]
    return mixed(total)


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Hashes of (shingle, how many equal ones stand before it)."""
    order = np.argsort(shingles, kind="stable")
    ordered = shingles[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    lengths = np.diff(np.append(starts, len(ordered)))
    nth = np.arange(len(ordered)) - np.repeat(starts, lengths)
    labels = np.empty_like(shingles)
    labels[order] = mixed(ordered + nth.astype(np.uint64) * _ODD)
    return labels


@functools.cache
def _multipliers(sketches: int) -> np.ndarray:
    """An odd number per sketch; a product with it orders the (scrambled) labels anew."""
    seeds = mixed(np.arange(1, sketches + 1, dtype=np.uint64) * _ODD)
    return seeds | np.uint64(1)


def order_minhash(words: np.ndarray, size: int, sketches: int, retained: int) -> np.ndarray:
    """For each seed, a hash of the ``retained`` least labelled shingles in text order."""
    shingles = shingle_hashes(words, size)
    labels = labelled(shingles)
    kept = min(retained, len(labels))
    seeds = _multipliers(sketches)
    places = np.empty((sketches, kept), np.int64)
    rows = max(1, 200_000 // len(labels))  # bounds the memory that a long text takes
    for at in range(0, sketches, rows):
        keys = labels[None, :] * seeds[at : at + rows, None]
        each = np.arange(len(keys))
        for nth in range(kept):
            least = keys.argmin(axis=1)
            places[at : at + rows, nth] = least
            keys[each, least] = np.uint64(0xFFFFFFFFFFFFFFFF)
    places.sort(axis=1)
    total = seeds
    for nth in range(kept):
        total = mixed(total + shingles[places[:, nth]])
    return total


def _sketches(docs: DataFrame, size: int, sketches: int, retained: int) -> DataFrame:
    def prepare():
        hashes = WordHashes()

        def run(texts):
            rows = []
            for text in texts:
                words = hashes.of_text(text)
                found = order_minhash(words, size, sketches, retained)
                rows.append((len(words), found.view(np.int64).tolist()))
            return rows

        return run

    added = append_columns(docs, ["_text"], "_words bigint, _buckets array<bigint>", prepare)
    return added.drop("_text")


def text_marks(words: np.ndarray) -> bytes:
    """Bits, each telling if an odd number of words falls on it; two to four for each word.

    Repetitions count, the second of a word as another word than the first.
    """
    size = max(64, 1 << (2 * len(words) - 1).bit_length())
    return _parities(words, size).tobytes()


def _parities(words: np.ndarray, size: int) -> np.ndarray:
    places = (labelled(words) >> np.uint64(32)) % np.uint64(size)
    odd = np.bincount(places.astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def differing(x: bytes, y: bytes) -> int:
    """Places in which two texts' marks differ: no more than they have words that the other hasn't.

    The marks of the longer text are laid on themselves until both have one size.
    """
    a, b = (int.from_bytes(marks, "little") for marks in (x, y))
    size = 8 * min(len(x), len(y))
    for longer, marks in ((8 * len(x), a), (8 * len(y), b)):
        while longer > size:
            longer //= 2
            marks = marks >> longer ^ marks & (1 << longer) - 1
        a, b = b, marks
    return (a ^ b).bit_count()


def words_alone(words_a: int, words_b: int, least: float) -> int:
    """The most words that two texts with the similarity have alone, of both together.

    An edit is a word of each, or one of the longer text.
    """
    shorter, longer = sorted((words_a, words_b))
    return 2 * int((1 - least) * longer + 1e-9) - (longer - shorter)


def _marked(texts: DataFrame) -> DataFrame:
    """node, words and ``text_marks`` of each text."""
    ship_package(texts.sparkSession)

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            sequences = [hashes.of_text(text.as_py()) for text in batch.column(1)]
            lengths = pa.array(map(len, sequences), pa.int64())
            marks = pa.array(map(text_marks, sequences), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lengths, marks], names=["node", "words", "marks"]
            )

    return texts.select("node", "text").mapInArrow(run, "node binary, words bigint, marks binary")


def _alike(pairs: DataFrame, marks: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes without those whose marks tell that they aren't similar.

    Marks are a small part of a text, so that texts move only for pairs that may be similar.
    """
    ship_package(pairs.sparkSession)
    right, left = (marks.toDF(name, f"words_{name}", f"marks_{name}") for name in ("b", "a"))
    joined = pairs.select("a", "b").join(right, "b").join(left, "a")
    joined = joined.select("a", "b", "words_a", "words_b", "marks_a", "marks_b")

    def run(batches):
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(2, 6)]
            keep = [
                differing(x, y) <= words_alone(n, m, least)
                for n, m, x, y in zip(*columns, strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, "a binary, b binary")


def _verified(
    pairs: DataFrame, texts: DataFrame, marks: DataFrame, least: float
) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) of nodes whose texts have the similarity, with it.

    And a table that they are read from, to be dropped.
    """
    alike = written(_alike(pairs, marks, least))
    return _aligned(alike, texts, least), alike


def _aligned(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    ship_package(pairs.sparkSession)
    # The texts of b, the centres, are added first; a spreads the rows before texts are aligned.
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            found = [
                similarity(hashes.of_text(x.as_py()), hashes.of_text(y.as_py()), least)
                for x, y in zip(batch.column(2), batch.column(3), strict=True)
            ]
            keep = pa.array([f is not None for f in found])
            values = pa.array(found, pa.float64())
            columns = [batch.column(0), batch.column(1), values]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "similarity"]).filter(keep)

    return joined.mapInArrow(run, "a binary, b binary, similarity double")


def _candidates(buckets: DataFrame, centre, least: float) -> DataFrame:
    """Each node of a bucket with the bucket's centre, where the lengths allow the similarity."""
    member = F.struct("node", "words")
    centres = buckets.groupBy("bucket").agg(
        centre(member).alias("centre"), F.min("node").alias("first"), F.max("node").alias("last")
    )
    # A key of its own gives both sides plain exchanges, so that Spark can split a hot bucket.
    centres = centres.where(F.col("first") != F.col("last"))
    centres = centres.select(F.bitwise_not("bucket").alias("key"), "centre")
    rows = buckets.select(F.bitwise_not("bucket").alias("key"), "node", "words")
    shorter, longer = F.least("words", "centre.words"), F.greatest("words", "centre.words")
    return (
        rows.join(centres, "key")
        .where((F.col("node") != F.col("centre.node")) & (shorter >= longer * F.lit(least)))
        .select(
            F.greatest("node", "centre.node").alias("a"), F.least("node", "centre.node").alias("b")
        )
        .distinct()
    )


def _joined(labels: DataFrame, links: DataFrame, *read: DataFrame) -> DataFrame:
    """The components after some more links, which are ``read`` from tables that go with them."""
    merged = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
    found = written(links.select("a", "b"), _BATCH)
    dropped(*read)
    joined = written(components(merged.union(found)))
    dropped(found, labels)
    return joined


def _mixed_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``key``, node, words, label and ``n``: members of groups that span two components.

    ``rows`` has key, node and words; groups of one component need nothing more. ``n`` is the size
    of the member's group.
    """
    named = labels.select(F.hex("node").alias("hex"), "label")
    labelled = rows.withColumn("hex", F.hex("node")).join(named, "hex", "left")
    labelled = written(labelled.select("key", "node", "words", F.coalesce("label", "node").alias("label")))
    mixed_rows = written(labelled.join(_mixed_groups(labelled), "key"))
    dropped(labelled)
    return mixed_rows


def _further_candidates(rows: DataFrame, turns: int, least: float) -> DataFrame:
    """Members of mixed groups with some further centres, another choice in each group."""
    pairs = None
    for turn in range(turns):
        member = F.struct("node", "words", "label")
        centre = F.min_by(member, F.xxhash64("key", "node", F.lit(turn))).alias("centre")
        centres = rows.groupBy("key").agg(centre)
        shorter, longer = F.least("words", "centre.words"), F.greatest("words", "centre.words")
        found = (
            rows.join(centres.select(F.bitwise_not("key").alias("turned"), "centre"),
                      F.bitwise_not("key") == F.col("turned"))
            .where(F.col("label") != F.col("centre.label"))
            .where(shorter >= longer * F.lit(least))
            .select(
                F.greatest("node", "centre.node").alias("a"),
                F.least("node", "centre.node").alias("b"),
            )
        )
        pairs = found if pairs is None else pairs.union(found)
    return pairs.distinct()


def slots(labels: np.ndarray) -> np.ndarray:
    return (labels % np.uint64(SLOTS)).astype(np.int64)


def _in_shares(share: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """``values`` (one row each) as the bytes of those of each share, column by column."""
    order = np.argsort(share, kind="stable")
    names, starts = np.unique(share[order], return_index=True)
    parts = np.split(values[order], starts[1:]) if len(names) else []
    columns = [pa.array(names, pa.int64()), pa.array([p.tobytes("F") for p in parts], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["share", "found"])


def _summed(pieces: DataFrame, size: int, most: int, kind: type) -> np.ndarray:
    """The sums of counters, ``most`` at most, from (counter, number) in ``SHARES`` of ``size``."""

    def run(batches):
        totals = {}
        for batch in batches:
            for share, found in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                places, numbers = np.frombuffer(found.as_buffer(), np.uint32).reshape(2, -1)
                np.add.at(totals.setdefault(share, np.zeros(size, np.int64)), places, numbers)
        sums = [np.minimum(t, most).astype(kind).tobytes() for t in totals.values()]
        columns = [pa.array(list(totals), pa.int64()), pa.array(sums, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["share", "found"])

    # Written, as the files of an exchange would stay until the driver collects its garbage.
    table = written(pieces.repartition("share").mapInArrow(run, _SHARE))
    counted = table.toArrow()
    dropped(table)
    counts = np.zeros(size * SHARES, kind)
    for share, found in zip(counted["share"].to_pylist(), counted["found"], strict=True):
        counts[share * size : (share + 1) * size] = np.frombuffer(found.as_buffer(), kind)
    return counts


def _numbered(places: np.ndarray, size: int) -> pa.RecordBatch:
    """How often each counter is among ``places``, in shares."""
    used, numbers = np.unique(places, return_counts=True)
    return _in_shares(used // size, np.column_stack([used % size, numbers]).astype(np.uint32))


def word_counts(members: DataFrame) -> np.ndarray:
    """In how many texts the words of each slot are found, their repetitions apart.

    Of a bounded size, whatever the number of texts and words.
    """
    size = SLOTS // SHARES

    def run(batches):
        hashes, total = WordHashes(), np.zeros(SLOTS, np.uint32)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(total, slots(labelled(hashes.of_text(text.as_py()))), 1)
        used = np.flatnonzero(total)
        numbers = np.column_stack([used % size, total[used]]).astype(np.uint32)
        yield _in_shares(used // size, numbers)

    return _summed(members.select("text").mapInArrow(run, _SHARE), size, 2**31 - 1, np.int32)


def rarest_words(words: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """Labelled words of which similar texts share one; those that no other text has are left out.

    Two texts with the similarity share all words, repetitions counted, but for a share of
    1 - ``least`` of the longer. So in any order of all words, the same for both, each has a common
    one among that many and one more of its first; the order is from rare to frequent.
    """
    labels = labelled(words)
    found = counts[slots(labels)]
    most = int((1 - least) * len(labels) + 1e-9)
    first = np.lexsort((labels, found))[: most + 1]
    return labels[first[found[first] > 1]]


def pair_counts(members: DataFrame) -> np.ndarray:
    """In how many texts the pairs of adjacent words of each slot are found, 255 at most.

    Of a bounded size, as ``word_counts``.
    """
    size = PAIR_SLOTS // SHARES

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            pairs = [labelled(shingle_hashes(hashes.of_text(t.as_py()), 2)) for t in batch.column(0)]
            places = np.concatenate([np.zeros(0, np.uint64), *pairs]) % np.uint64(PAIR_SLOTS)
            yield _numbered(places.astype(np.int64), size)

    return _summed(members.select("text").mapInArrow(run, _SHARE), size, 255, np.uint8)


def rarest_pairs(words: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray | None:
    """Labelled pairs of adjacent words of which similar texts share one, as ``rarest_words``.

    An edit changes two pairs, and one that makes a text longer only one of the shorter text's.
    None where so few pairs are left that similar texts need not share any.
    """
    pairs = labelled(shingle_hashes(words, 2))
    most = int(2 * (1 - least) * len(words) + 1e-6)
    if least < 0.5 or len(pairs) <= most:
        return None
    found = counts[(pairs % np.uint64(PAIR_SLOTS)).astype(np.int64)]
    first = np.lexsort((pairs, found))[: most + 1]
    return pairs[first[found[first] > 1]]


def _length_band(words: int, least: float) -> int:
    """Lengths that two similar texts may have are of one band or of two that follow each other."""
    return int(np.log(words + 1) / (0.01 - np.log(least))) if least > 0 else 0


def _with_partners(members: DataFrame, least: float) -> DataFrame:
    """The members that share one of their ``rarest_pairs`` with a text of another component.

    All that are similar to one do, and their lengths are alike. What is left out has no such
    partner, so that the members of a bucket that differ in all but a phrase go no further. Pairs
    move packed, in ``SHARES`` shares, and come back as members; no member is left out unseen.
    """
    ship_package(members.sparkSession)
    rows = members.select(
        F.xxhash64("node").alias("name"), F.xxhash64("label").alias("class"), "text"
    )
    counts = pair_counts(rows)

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            parts = [np.zeros((0, 3), np.int64)]
            names, classes = (batch.column(i).to_pylist() for i in (0, 1))
            for name, label, text in zip(names, classes, batch.column(2), strict=True):
                words = hashes.of_text(text.as_py())
                pairs = rarest_pairs(words, counts, least)
                if pairs is None:  # goes on, as one with a partner
                    parts.append(np.array([[name, label, name], [name, ~label, name]], np.int64))
                    continue
                part = np.empty((len(pairs), 3), np.int64)
                band = np.uint64(min(_length_band(len(words), least), _BANDS - 2))
                part[:, 0] = (pairs - pairs % np.uint64(_BANDS) + band).view(np.int64)
                part[:, 1:] = label, name
                parts.append(part)
            found = np.concatenate(parts)
            yield _in_shares((found[:, 0] >> 32) % SHARES, found)

    def partners(pieces):
        found = [np.frombuffer(piece, np.int64).reshape(3, -1) for piece in pieces]
        found = np.concatenate(found, axis=1).T
        # A text meets those of its own band and of the next.
        found = np.concatenate([found, found + np.array([1, 0, 0])])
        found = found[np.lexsort((found[:, 1], found[:, 0]))]
        starts = np.flatnonzero(np.append(True, found[1:, 0] != found[:-1, 0]))
        ends = np.append(starts[1:], len(found))
        several = found[starts, 1] != found[ends - 1, 1]
        names = np.unique(found[np.repeat(several, ends - starts), 2])
        return pa.RecordBatch.from_arrays([pa.array(names)], names=["name"])

    def shared(batches):
        share, pieces = None, []
        for batch in batches:
            for now, found in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if now != share and pieces:
                    yield partners(pieces)
                    pieces = []
                share = now
                pieces.append(found.as_py())
        if pieces:
            yield partners(pieces)

    dealt = rows.mapInArrow(run, _SHARE).repartition("share")
    found = dealt.sortWithinPartitions("share").mapInArrow(shared, "name bigint").distinct()
    named = members.withColumn("name", F.xxhash64("node"))
    return named.join(found, "name", "left_semi").drop("name")


def text_bits(words: np.ndarray) -> np.ndarray:
    """``text_marks`` of 64 * ``PARTS`` bits, whatever the length of the text."""
    return _parities(words, 64 * PARTS).view(np.int64)


def _rare_words(nodes: DataFrame, least: float) -> DataFrame:
    """``key``, node, words, label: the ``rarest_words`` of each node's ``text``.

    A row with no key holds the text's ``bits``.
    """
    ship_package(nodes.sparkSession)
    members = nodes.select("node", "words", "label", "text")
    counts = word_counts(members)
    fields = [nodes.schema[c] for c in ("node", "words", "label")]
    bits = [StructField(f"bits{i}", LongType()) for i in range(PARTS)]
    schema = StructType([StructField("key", LongType()), *fields, *bits])

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            sequences = [hashes.of_text(text.as_py()) for text in batch.column(3)]
            found = [rarest_words(words, counts, least).view(np.int64) for words in sequences]
            owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
            owner = pa.array(np.concatenate([np.arange(len(found)), owner]))
            keys = pa.concat_arrays([
                pa.nulls(len(found), pa.int64()), pa.array(np.concatenate([np.zeros(0, np.int64), *found]))
            ])
            own = np.array([text_bits(words) for words in sequences]).reshape(-1, PARTS)
            missing = pa.nulls(len(keys) - len(found), pa.int64())
            columns = [batch.column(i).take(owner) for i in range(3)]
            columns += [pa.concat_arrays([pa.array(own[:, i]), missing]) for i in range(PARTS)]
            yield pa.RecordBatch.from_arrays([keys, *columns], names=schema.names)

    return members.mapInArrow(run, schema)


def _pairs_within(rows: DataFrame, groups: DataFrame, least: float, bits: DataFrame | None = None):
    """All pairs of a group of ``rows`` that are in two components, with lengths that may do.

    And a table that they are read from, to be dropped.

    With ``bits`` of the nodes, also by the words that each may have alone. Both
    sides of the join have exchanges of their own; pairs that won't do never leave it.
    """
    rows = rows.select("key", "node", "words", "label").join(groups.select("key"), "key")
    columns = ["node", "words", "label"]
    if bits is not None:
        parts = [f"bits{i}" for i in range(PARTS)]
        own = bits.select(F.hex("node").alias("hex"), *parts)
        rows = rows.withColumn("hex", F.hex("node")).join(own, "hex").drop("hex")
        columns += parts
    rows = written(rows)
    left = rows.select("key", *[F.col(c).alias(f"{c}_a") for c in columns])
    right = rows.select("key", *[F.col(c).alias(f"{c}_b") for c in columns])
    shorter, longer = F.least("words_a", "words_b"), F.greatest("words_a", "words_b")
    alike = (F.col("node_a") > F.col("node_b")) & (F.col("label_a") != F.col("label_b"))
    alike &= shorter >= longer * F.lit(least)
    if bits is not None:
        most = 2 * F.floor(longer * F.lit(1 - least) + F.lit(1e-9)) - (longer - shorter)
        differ = [F.bit_count(F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b"))) for p in parts]
        alike &= functools.reduce(operator.add, differ) <= most
    pairs = left.join(right, "key").where(alike)
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")), rows


def _mixed_groups(rows: DataFrame) -> DataFrame:
    """``key`` and size ``n`` of the groups with members in two components."""
    grouped = rows.groupBy("key").agg(
        F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("n")
    )
    return grouped.where("x <> y").select("key", "n")


def _unresolved(mixed_rows: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs that share a bucket and that centres have left in two components.

    In a small bucket all pairs are compared. Of the members of larger ones, where they have
    partners by their ``rarest_pairs``, all pairs that share one of their ``rarest_words``, as all
    that are similar do, and agree in ``text_bits`` as far as similar texts do. No group of them is
    left out, however large.
    """
    small = mixed_rows.where(F.col("n") <= SMALL)
    few, rows = _pairs_within(small, small.select("key").distinct(), least)
    members = mixed_rows.where(F.col("n") > SMALL).select("node", "words", "label").distinct()
    members = written(members.join(texts, "node").select("node", "words", "label", "text"))
    if members.isEmpty():
        found = written(few.distinct())
        dropped(rows, members)
        return found
    partners = written(_with_partners(members, least), _BATCH)
    dropped(members)
    rare = written(_rare_words(partners, least), _BATCH)
    dropped(partners)
    keyed, bits = rare.where("key IS NOT NULL"), rare.where("key IS NULL")
    others, more_rows = _pairs_within(keyed, _mixed_groups(keyed), least, bits)
    found = written(few.union(others).distinct())
    dropped(rare, rows, more_rows)
    return found


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    size: int = SHINGLE,
    least: float = SIMILARITY,
    sketches: int = SKETCHES,
    retained: int = RETAINED,
) -> DataFrame:
    """One row per document: ``doc_id``, ``group_id``, ``group_size`` and ``node``.

    Texts are sequences of lower-case words between white space. Two are linked when their edit
    similarity, 1 - distance / longer length in words, is at least ``least``; groups are the
    connected components of the links, named by their smallest id.

    * Equal texts are one node from the start, whatever their number.
    * A sketch hashes ``retained`` least occurrence-labelled shingles of ``size`` words, in text
      order; documents that share one of ``sketches`` sketches share a bucket.
    * Buckets don't make all pairs: members are aligned with the bucket's least node first. What
      is then not yet in one component meets three further centres, another choice in each
      bucket. Of what these leave apart, the members of small buckets are compared pair by pair,
      and those of large ones where they share one of their rarest words, as all similar texts do:
      every pair of a bucket that is similar ends in one group. A member linked to a centre needs
      no other link.
    * Sketches are probabilistic: of pairs with a share s of their shingles in common, about
      (1 - s**retained) ** sketches share no bucket.

    NULL and empty texts are equal; texts of fewer words than ``size`` have one shingle. Rows
    that share an id get the same group if their texts do. Groups of NULL ids alone have a NULL
    id. An empty table gives an empty result.
    """
    text = text_or_empty(text_column)
    rows = docs.select(
        F.col(id_column).alias("doc_id"), F.unhex(F.md5(text)).alias("node"), text.alias("_text")
    )
    sketched = written(_sketches(rows, size, sketches, retained), _BATCH)
    nodes = sketched.groupBy("node").agg(
        F.min("doc_id").alias("first_id"),
        F.count(F.lit(1)).alias("copies"),
        F.min("_words").alias("words"),
        F.min("_buckets").alias("buckets"),
    )
    nodes = written(nodes)
    # The sketches, most of these tables, go as soon as they were read.
    ids = written(sketched.select("doc_id", "node"))
    dropped(sketched)
    key = F.bitwise_not("bucket").alias("key")
    exploded = nodes.select("node", "words", F.explode("buckets").alias("bucket"))
    shared = exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = exploded.select(key, "node", "words").join(shared.select(key), "key")
    buckets = written(joined.select("node", "words", F.bitwise_not("key").alias("bucket")))
    names = written(nodes.select("node", "first_id", "copies"))
    dropped(nodes)
    wanted = buckets.select("node").distinct()
    # Grouped and joined by the node alone, texts move once.
    whole = rows.groupBy("node").agg(F.first("_text").alias("text"))
    texts = written(whole.join(wanted, "node", "left_semi"))
    marks = written(_marked(texts), _BATCH)

    verified, alike = _verified(_candidates(buckets, F.min, least), texts, marks, least)
    links = written(verified, _BATCH)
    dropped(alike)
    labels = written(components(links))
    dropped(links)

    keyed = buckets.select(key, "node", "words")
    apart = _mixed_rows(keyed, labels)
    dropped(buckets)
    further = written(_further_candidates(apart, FURTHER, least))
    labels = _joined(labels, *_verified(further, texts, marks, least))

    still = _mixed_rows(apart.select("key", "node", "words"), labels)
    dropped(apart)
    left = _unresolved(still, texts, least)
    rest = left.join(further, ["a", "b"], "left_anti")
    verified, alike = _verified(rest, texts, marks, least)
    dropped(still, further, left, marks)
    labels = _joined(labels, verified, alike)
    dropped(texts)

    named = names.join(labels, "node", "left")
    named = named.withColumn("label", F.coalesce("label", "node"))
    groups = named.groupBy("label").agg(
        F.min("first_id").alias("group_id"), F.sum("copies").alias("group_size")
    )
    per_node = (
        named.withColumn("key", F.hex("label"))
        .join(groups.withColumn("key", F.hex("label")).drop("label"), "key")
        .select(F.hex("node").alias("key"), "group_id", "group_size")
    )
    return (
        ids.withColumn("key", F.hex("node"))
        .join(per_node, "key")
        .select("doc_id", "group_id", "group_size", "node")
    )


def drop_near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **settings
) -> DataFrame:
    """One document of each group, that with the smallest id, with all its columns."""
    groups = near_duplicates(docs, id_column, text_column, **settings)
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("group_id")))
    kept = kept.select(F.struct(F.col("doc_id").alias("id"), "node").alias("__llm_key"))
    node = F.unhex(F.md5(text_or_empty(text_column)))
    key = F.struct(F.col(id_column).alias("id"), node.alias("node"))
    # Joined and told apart by one key (in a struct NULL ids are equal), texts move once.
    marked = docs.withColumn("__llm_key", key)
    stays = marked.join(kept, marked["__llm_key"] == kept["__llm_key"], "left_semi")
    return stays.dropDuplicates(["__llm_key"]).drop("__llm_key")
