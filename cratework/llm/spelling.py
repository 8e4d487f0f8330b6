"""Spelling variants: edits probed against Bloom filters, and joined exactly with the vocabulary."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratework.llm.common import folded, text_or_empty
from cratework.llm.per_row import ship_package
from cratework.session import written

#: The letters of a word.
LETTERS = "A-Za-zÀ-ÿ"

MIN_CHARS, MIN_COUNT, FACTOR = 7, 2, 10

#: One word in so many loses a letter, by its checksum.
DAMAGED = 31

#: Words of this length or more share a filter; shorter ones have one per length.
LONGEST = 64

#: Filter bits per word. A block is one 64-bit word, in which each key sets four bits.
BITS_PER_WORD = 16

#: Bytes of filters that are broadcast at once. More filters are probed in further rounds.
BROADCAST_BYTES = 32 << 20

#: Blocks of a filter that are built together and sent as one piece, 8 KB for 4,096 words.
PIECE = 1024

#: Probes that a task holds at once.
_PROBES = 1 << 21

_BASE = np.uint64(0x9E3779B97F4A7C15)


def damaged_runs(docs: DataFrame, id_column: str, text_column: str, min_chars: int) -> DataFrame:
    """``word``: the runs of letters, A to Z in lower case, of which some lose a letter.

    A run with less than ``min_chars`` letters can't give a word and is not made.
    """
    pattern = f"[{LETTERS}]{{{max(1, min_chars)},}}"
    runs = docs.select(
        F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("doc"),
        F.explode(
            F.regexp_extract_all(folded(text_or_empty(text_column)), F.lit(pattern), F.lit(0))
        ).alias("run"),
    ).withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")))
    place = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.char_length("run")))
    return runs.select(F.when(F.col("h") % DAMAGED == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_chars: int = MIN_CHARS,
    min_count: int = MIN_COUNT,
) -> DataFrame:
    """``word`` and ``n``: words of ``min_chars`` letters that occur ``min_count`` times.

    Map tasks count before the shuffle, so a word found everywhere sends one row per task.
    """
    words = damaged_runs(docs, id_column, text_column, min_chars)
    counted = words.where(F.char_length("word") >= min_chars).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counted.where(F.col("n") >= min_count)


def _shard(length):
    return np.minimum(length, LONGEST)


def _letters(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix of code points."""
    joined = "".join(words).encode("utf-32-le")
    return np.frombuffer(joined, "<u4").reshape(len(words), -1).astype(np.uint64)


def _prefixes(letters: np.ndarray) -> np.ndarray:
    """The polynomial hash of each prefix, the empty one first, modulo 2^64."""
    out = np.zeros((letters.shape[0], letters.shape[1] + 1), np.uint64)
    for i in range(letters.shape[1]):
        out[:, i + 1] = out[:, i] * _BASE + letters[:, i]
    return out


def _powers(length: int) -> np.ndarray:
    """What the letter at each place is multiplied by."""
    out = np.full(length, _BASE)
    out[-1] = 1
    return np.multiply.accumulate(out[::-1])[::-1]


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """The hashes with all their bits mixed, so that any of them can choose blocks and bits."""
    z = hashes ^ (hashes >> np.uint64(30))
    z = z * np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z = z * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _blocks(mixed: np.ndarray, n_blocks: int) -> np.ndarray:
    """The block of each key, by the upper half of its hash."""
    return ((mixed >> np.uint64(32)) * np.uint64(n_blocks)) >> np.uint64(32)


def _masks(mixed: np.ndarray) -> np.ndarray:
    """The four bits of each key in its block, by the lower half of its hash."""
    out = np.zeros(mixed.shape, np.uint64)
    for k in range(4):
        out |= np.uint64(1) << ((mixed >> np.uint64(6 * k)) & np.uint64(63))
    return out


def _by_length(words: list[str]) -> dict[int, list[int]]:
    """Places of the words of each length."""
    out: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        out.setdefault(len(word), []).append(i)
    return out


class Filters:
    """The part of the filters that is probed in one round.

    ``blocks`` is the number of blocks of each shard's whole filter, ``pieces`` the blocks at
    hand, by (shard, piece number). Keys of other pieces are told apart, not answered.
    """

    def __init__(self, blocks: dict[int, int], pieces: dict[tuple[int, int], bytes]):
        self.blocks = blocks
        self.ranges: dict[int, tuple[int, np.ndarray]] = {}
        for shard in {s for s, _ in pieces}:
            numbers = sorted(n for s, n in pieces if s == shard)
            data = b"".join(pieces[shard, n] for n in numbers)
            self.ranges[shard] = numbers[0] * PIECE, np.frombuffer(data, "<u8")

    def found(self, length: int, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes whose key may be a word of ``length`` letters."""
        shard = min(length, LONGEST)
        if shard not in self.ranges or not len(hashes):
            return np.zeros(0, np.int64)
        first, data = self.ranges[shard]
        mixed = _mixed(hashes)
        block = _blocks(mixed, self.blocks[shard]).astype(np.int64) - first
        at = np.flatnonzero((block >= 0) & (block < len(data)))
        word, mixed = data[block[at]], mixed[at]
        # One bit first: most probes end here.
        some = (word >> (mixed & np.uint64(63))) & np.uint64(1) == 1
        at, word, mixed = at[some], word[some], mixed[some]
        mask = _masks(mixed)
        return at[(word & mask) == mask]


def edits(words: list[str], filters: Filters, alphabet: np.ndarray) -> Iterator[tuple[int, str]]:
    """(place of a word, edit of it that may be a word), each edit of a word once.

    All deletions are probed, and all replacements by a later letter. An insertion is the
    deletion seen from the longer word, a replacement by an earlier letter is that seen from the
    other word, so every pair of near words is probed from just one side.
    """
    for length, places in _by_length(words).items():
        alive = [s for s in (length - 1, length) if min(s, LONGEST) in filters.ranges]
        if not alive or not length:
            continue
        step = max(1, _PROBES // (length * (len(alphabet) + 1)))
        for at in range(0, len(places), step):
            chunk = places[at : at + step]
            letters, powers = _letters([words[i] for i in chunk]), _powers(length)
            prefix = _prefixes(letters)
            whole = prefix[:, -1]
            width = max(1, _PROBES // (len(chunk) * (len(alphabet) + 1)))
            for lo in range(0, length, width):
                here = slice(lo, min(lo + width, length))
                own = letters[:, here]
                without = whole[:, None] + (prefix[:, here] - prefix[:, lo + 1 : here.stop + 1]) * powers[here]
                # Of equal letters in a row, deleting any one gives the same word.
                fresh = np.ones(own.shape, bool)
                if lo:
                    fresh[:, 0] = own[:, 0] != letters[:, lo - 1]
                fresh[:, 1:] = own[:, 1:] != own[:, :-1]
                row, column = np.nonzero(fresh)
                for k in filters.found(length - 1, without[row, column]):
                    i, p = chunk[row[k]], lo + column[k]
                    yield i, words[i][:p] + words[i][p + 1 :]
                row, column, letter = np.nonzero(alphabet[None, None, :] > own[:, :, None])
                moved = (alphabet[letter] - own[row, column]) * powers[here][column]
                for k in filters.found(length, whole[row] + moved):
                    i, p = chunk[row[k]], lo + column[k]
                    yield i, words[i][:p] + chr(int(alphabet[letter[k]])) + words[i][p + 1 :]


def _filter_pieces(words: DataFrame, blocks: dict[int, int], wanted: list[tuple[int, int]]) -> DataFrame:
    """``shard``, ``piece``, ``bits``: the wanted pieces of the filters, each built in one task."""
    asked = set(wanted)

    def hashed(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for length, places in _by_length(texts).items():
                shard = min(length, LONGEST)
                mixed = _mixed(_prefixes(_letters([texts[i] for i in places]))[:, -1])
                block = _blocks(mixed, blocks[shard]).astype(np.int64)
                keep = np.isin(block // PIECE, [p for s, p in asked if s == shard])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(int(keep.sum()), shard, np.int64)),
                        pa.array(block[keep] // PIECE),
                        pa.array(block[keep] % PIECE),
                        pa.array(_masks(mixed[keep]).view(np.int64)),
                    ],
                    names=["shard", "piece", "block", "mask"],
                )

    def built(batches):
        found: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            shard, piece, block, mask = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for s, p in set(zip(shard.tolist(), piece.tolist(), strict=True)):
                here = (shard == s) & (piece == p)
                bits = found.setdefault((s, p), np.zeros(min(PIECE, blocks[s] - p * PIECE), np.uint64))
                np.bitwise_or.at(bits, block[here], mask[here].view(np.uint64))
        if found:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([s for s, _ in found], pa.int64()),
                    pa.array([p for _, p in found], pa.int64()),
                    pa.array([b.astype("<u8").tobytes() for b in found.values()], pa.binary()),
                ],
                names=["shard", "piece", "bits"],
            )

    keys = words.select("word").mapInArrow(
        hashed, "shard bigint, piece bigint, block bigint, mask bigint"
    )
    return keys.repartition("shard", "piece").mapInArrow(
        built, "shard bigint, piece bigint, bits binary"
    )


def _rounds(blocks: dict[int, int], most_bytes: int) -> Iterator[list[tuple[int, int]]]:
    """Pieces of the filters, in order, in groups of at most ``most_bytes``."""
    room = max(1, most_bytes // (8 * PIECE))
    pieces = [(s, p) for s, n in sorted(blocks.items()) for p in range(-(-n // PIECE))]
    for at in range(0, len(pieces), room):
        yield pieces[at : at + room]


def _positives(words: DataFrame, filters, alphabet: np.ndarray) -> DataFrame:
    """``candidate``, ``word``, ``n``: the edits of each word that its filter lets through."""

    def probe(batches):
        held = filters.value
        ready = Filters(*held)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                texts = part.column(0).to_pylist()
                places, found = [], []
                for place, edit in edits(texts, ready, alphabet):
                    places.append(place)
                    found.append(edit)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.string()), *[part.column(i).take(pa.array(places, pa.int64())) for i in (0, 1)]],
                    names=["candidate", "word", "n"],
                )

    return words.select("word", "n").mapInArrow(probe, "candidate string, word string, n bigint")


def near_words(words: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``word``, ``near``, ``near_n``: both directions of every pair of near words, once each.

    ``words`` is a written vocabulary. Its filters, two bytes a word, are broadcast in rounds of
    at most ``broadcast_bytes``; each round probes the words that its filters concern. Only
    edits that a filter lets through are shuffled, to a join with the vocabulary that drops the
    false positives.
    """
    spark = words.sparkSession
    ship_package(spark)
    length = F.least(F.char_length("word"), F.lit(LONGEST))
    sizes = words.groupBy(length.alias("shard")).agg(F.count(F.lit(1)).alias("n")).collect()
    blocks = {r["shard"]: -(-r["n"] * BITS_PER_WORD // 64) for r in sizes}  # at most LONGEST shards
    letters = words.select(F.explode(F.split("word", "")).alias("c")).distinct().collect()
    alphabet = np.array(sorted(ord(r["c"]) for r in letters if r["c"]), np.uint64)  # LETTERS at most
    rounds = []
    for wanted in _rounds(blocks, broadcast_bytes):
        built = _filter_pieces(words, blocks, wanted).collect()  # at most broadcast_bytes
        pieces = {(r["shard"], r["piece"]): bytes(r["bits"]) for r in built}
        for shard, piece in wanted:  # pieces that no word falls into
            size = min(PIECE, blocks[shard] - piece * PIECE)
            pieces.setdefault((shard, piece), bytes(8 * size))
        filters = spark.sparkContext.broadcast((blocks, pieces))
        shards = {s for s, _ in wanted}
        concerned = length.isin(sorted(shards | {min(s + 1, LONGEST) for s in shards}))
        rounds.append(written(_positives(words.where(concerned), filters, alphabet)))
        filters.destroy()
    if not rounds:
        return words.select("word", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    candidates = rounds[0]
    for more in rounds[1:]:
        candidates = candidates.unionByName(more)
    known = words.select(F.col("word").alias("candidate"), F.col("n").alias("candidate_n"))
    pairs = candidates.join(known, "candidate")
    return pairs.select(
        F.explode(
            F.array(
                _pair(F.col("word"), F.col("candidate"), F.col("candidate_n")),
                _pair(F.col("candidate"), F.col("word"), F.col("n")),
            )
        ).alias("p")
    ).select("p.*")


def _pair(word: Column, near: Column, near_n: Column) -> Column:
    return F.struct(word.alias("word"), near.alias("near"), near_n.alias("near_n"))


def _with_forms(words: DataFrame, near: DataFrame, factor: int) -> DataFrame:
    """``word``, ``n``, ``n_near`` and its form with its count: one grouping over words and pairs."""
    none = F.lit(None)
    own = words.select(
        "word", "n", none.cast("string").alias("near"), none.cast("bigint").alias("near_n")
    )
    others = near.select("word", none.cast("bigint").alias("n"), "near", "near_n")
    largest = F.min(
        F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near"))
    )
    grouped = own.unionByName(others).groupBy("word").agg(
        F.max("n").alias("n"), F.count("near").alias("n_near"), largest.alias("largest")
    )
    is_form = -F.col("largest.less") >= factor * F.col("n")
    return grouped.select(
        "word",
        F.when(is_form, F.col("largest.near")).alias("form"),
        "n",
        "n_near",
        F.when(is_form, -F.col("largest.less")).alias("form_n"),
    )


def _roots(forms: DataFrame, factor: int) -> DataFrame:
    """``word``, ``root`` of the words that have a form.

    A form occurs ``factor`` times as often as its word, so a chain is as long as a logarithm of
    the largest count at most. Each round doubles the steps that a row has gone.
    """
    links = written(
        forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"), "n", "form_n")
    )
    span = links.agg(F.max("form_n").alias("most"), F.min("n").alias("least")).first()
    steps = math.log(span["most"] / span["least"], factor) + 1e-9 if span["most"] else 0
    links = links.select("word", "root")
    for _ in range(math.ceil(math.log2(max(1, math.floor(steps))))):
        further = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = written(
            links.join(further, "root", "left").select(
                "word", F.coalesce("further", "root").alias("root")
            )
        )
    return links


def group_spellings(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_chars: int = MIN_CHARS,
    min_count: int = MIN_COUNT,
    factor: int = FACTOR,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The usual form of each word of the documents.

    Words are runs of letters (A to Z, a to z, U+00C0 to U+00FF), A to Z in lower case, of
    ``min_chars`` letters that occur ``min_count`` times. One run in 31, by the CRC-32 of
    ``<id>:<run>``, loses one letter first. Two words are near if one inserted, deleted or
    replaced letter tells them apart.

    One row per word: ``word``; ``form``, its near word of the largest count (ties: the smallest
    in code-point order) if that count is at least ``factor`` times the word's, else NULL;
    ``root``, found by following forms to the last, or the word itself; ``n``; ``n_near``, the
    number of near words; ``form_n``. A NULL id is the empty string, NULL and empty texts have no
    words, repeated rows count again. An empty table has no words; other columns are not read.
    """
    if min_chars < 2 or factor < 2:
        raise ValueError("min_chars and factor must be 2 or more")
    words = written(vocabulary(docs, id_column, text_column, min_chars, min_count))
    forms = written(_with_forms(words, near_words(words, broadcast_bytes), factor))
    return forms.join(_roots(forms, factor), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
