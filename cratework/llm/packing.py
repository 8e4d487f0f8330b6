"""Packing of documents into token windows by the sum of squares of the fill levels."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from cratework.llm.common import text_or_empty
from cratework.llm.per_row import ship_package

WINDOW = 2048
END_ID = 1

#: Open windows and pieces in them that a task holds at once; beyond, the open windows are closed.
MOST_OPEN = 1024
MOST_HELD = 200_000

#: Pieces that go out in one Arrow batch, and their ids.
_ROWS, _IDS = 4096, 2_000_000

#: A task numbers its sequences from its partition's number, shifted by so many bits.
_SEQUENCE_BITS = 36

# Fixed value: the splitting of byte-level BPE before merging, as published with its vocabulary.
_WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)

#: The last encoder of this process: one tokenizer of fixed size.
_encoder: dict[str, ByteEncoder] = {}


def _bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for.

    Visible Latin-1 characters stand for themselves, the other bytes for those from U+0100 on.
    """
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in visible]
    letters = {chr(b): b for b in visible}
    return letters | {chr(0x100 + i): b for i, b in enumerate(others)}


class ByteEncoder:
    """Ids of a text by a byte-level BPE file of the ``tokenizers`` library.

    Where the file is plain byte-level BPE whose merges are numbered in their order, the same
    vocabulary runs in ``tiktoken``, which gives the same ids about six times faster (a test
    holds both against each other). Any other file, and a text that holds an added token's
    name, is encoded by ``tokenizers`` itself.
    """

    def __init__(self, data: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_str(data)
        spec = json.loads(data)
        added = [t["content"] for t in spec.get("added_tokens") or []]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        ranks = self._ranks(spec)
        self.fast = None
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding(
                "ranks", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={}
            )

    @staticmethod
    def _ranks(spec: dict) -> dict[bytes, int] | None:
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (
            model.get("type") == "BPE"
            and before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space")
            and before.get("use_regex", True)
            and not any(spec.get(k) for k in ("normalizer", "truncation"))
            and not any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback"))
            and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix"))
        )
        if not plain:
            return None
        letters, added = _bytes_of_letters(), {t["content"] for t in spec["added_tokens"]}
        vocab = {w: i for w, i in model["vocab"].items() if w not in added}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocab.get("".join(m)) for m in merges]
        if made != list(range(256, 256 + len(merges))) or len(vocab) != 256 + len(merges):
            return None
        return {bytes(letters[c] for c in word): number for word, number in vocab.items()}

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or (self.added and self.added.search(text)):
            found = self.own.encode(text, add_special_tokens=False).ids
        else:
            found = self.fast.encode_to_numpy(text, disallowed_special=())
        return np.asarray(found, "<u4")


class Packer:
    """Places documents into windows of ``size`` ids as they come.

    All but a document's last ``len % size`` ids fill windows of their own. The rest goes, whole,
    to the fill level at which the sum of the squared numbers of open windows per level grows
    least, a new window included; of equal levels the fullest is taken. ``counts`` is the level
    array: the number of open windows of each level, full ones left out.

    Where too many windows are open, and at the end, open windows are closed: the fullest are
    filled up with ids of the emptiest, so that documents are cut only here. What is left over in
    the end is one stretch shorter than a window, which goes into sequences of powers of two.
    """

    def __init__(self, size: int, first_sequence: int, most_open: int = MOST_OPEN):
        self.size, self.most_open = size, most_open
        self.counts = np.zeros(size + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(size)]
        self.n_open = self.n_held = 0
        self.next = first_sequence

    def _sequence(self, pieces: list) -> Iterator[tuple]:
        """One finished window, as rows."""
        number, offset, self.next = self.next, 0, self.next + 1
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids), ids, total, number, offset
            offset += len(ids)

    def level_for(self, length: int) -> int:
        """The level that a piece of ``length`` ids, under a window, goes to; 0 opens a window."""
        size, counts = self.size, self.counts
        before = counts[1 : size - length + 1]
        growth = 2 * (counts[1 + length :] - before) + 2
        growth[-1] -= 1  # a full window is no longer counted
        growth = np.where(before > 0, growth, np.iinfo(np.int64).max)
        fullest = len(growth) - 1 - int(growth[::-1].argmin())
        return fullest + 1 if growth[fullest] <= 2 * counts[length] + 1 else 0

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        size, total = self.size, len(ids)
        whole = total - total % size
        for start in range(0, whole, size):
            yield from self._sequence([(doc, start, ids[start : start + size], total)])
        length = total - whole
        if not length:
            return
        level = self.level_for(length)
        window = []
        if level:
            window = self.open[level].pop()
            self.counts[level] -= 1
            self.n_open -= 1
            self.n_held -= len(window)
        # A copy: a slice would keep all of a long document.
        window.append((doc, whole, ids[whole:].copy(), total))
        yield from self._put(window, level + length)
        if self.n_open > self.most_open or self.n_held > MOST_HELD:
            yield from self.close()

    def _put(self, window: list, level: int) -> Iterator[tuple]:
        if level == self.size:
            yield from self._sequence(window)
        elif level:
            self.open[level].append(window)
            self.counts[level] += 1
            self.n_open += 1
            self.n_held += len(window)

    def close(self) -> Iterator[tuple]:
        """Fills open windows up, the fullest first, until at most one is left."""
        windows = [(level, w) for level, ws in enumerate(self.open) for w in ws]
        self.open = [[] for _ in range(self.size)]
        self.counts[:] = 0
        self.n_open = self.n_held = 0
        fullest, spare = len(windows) - 1, []
        emptiest, left = 0, 0
        while fullest >= emptiest:
            level, window = windows[fullest]
            fullest -= 1
            while level < self.size:
                if not spare:
                    if emptiest > fullest:
                        break
                    left, spare = windows[emptiest][0], windows[emptiest][1][::-1]
                    emptiest += 1
                room = self.size - level
                doc, start, ids, total = spare.pop()
                taken = ids[:room]
                window.append((doc, start, taken, total))
                if len(ids) > room:
                    spare.append((doc, start + room, ids[room:], total))
                level, left = level + len(taken), left - len(taken)
            yield from self._put(window, level)
        if spare:
            yield from self._put(spare[::-1], left)

    def finish(self) -> Iterator[tuple]:
        yield from self.close()
        rest = [p for level in self.open for w in level for p in w]
        left = sum(len(p[2]) for p in rest)
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            window = []
            while room:
                doc, start, ids, total = rest.pop(0)
                window.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    rest.insert(0, (doc, start + room, ids[room:], total))
                room -= len(window[-1][2])
            yield from self._sequence(window)


def _encoder_of(data: str) -> ByteEncoder:
    if data not in _encoder:
        _encoder.clear()
        _encoder[data] = ByteEncoder(data)
    return _encoder[data]


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
) -> DataFrame:
    """The documents' ids as pieces of sequences of at most ``window`` ids, a power of two.

    A document is its text's ids, without special tokens, and ``end_id``; a NULL or empty text
    is ``end_id`` alone. One row per piece: the id column as ``doc_id``, ``start`` (ids of the
    document before the piece), ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``
    (ids of the document), ``sequence_id``, ``offset`` (ids of the sequence before the piece).
    Rows that share an id, or have none, are documents of their own. An empty table has no
    pieces; other columns are not read.

    Each task packs the documents that it reads, in their order, so there is no shuffle, and a
    lost task gives the same pieces again as long as its input partition does. Sequences are
    numbered within their partition. All are ``window`` long but for at most log2(window) per
    task, whose lengths are powers of two, so nothing is padded. A task holds at most ``MOST_OPEN``
    open windows.
    """
    if window < 2 or window & (window - 1):
        raise ValueError("window must be a power of two")
    ship_package(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())  # fixed size, 2 MB here
    rows = docs.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text"))
    schema = StructType(
        [rows.schema["doc_id"]]
        + [StructField(n, LongType()) for n in ("start", "length")]
        + [StructField("ids", BinaryType())]
        + [StructField(n, LongType()) for n in ("doc_tokens", "sequence_id", "offset")]
    )
    types = [to_arrow_type(f.dataType) for f in schema]

    def batch_of(pieces):
        columns = [list(c) for c in zip(*pieces, strict=True)]
        columns[3] = [ids.tobytes() for ids in columns[3]]
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    def run(batches):
        encode = _encoder_of(model.value)
        packer = Packer(window, TaskContext.get().partitionId() << _SEQUENCE_BITS)
        held, n_ids = [], 0

        def pieces():
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = np.append(encode(text.as_py()), np.uint32(end_id)).astype("<u4")
                    yield from packer.add(doc, ids)
            yield from packer.finish()

        for piece in pieces():
            held.append(piece)
            n_ids += piece[2]
            if len(held) >= _ROWS or n_ids >= _IDS:
                yield batch_of(held)
                held, n_ids = [], 0
        if held:
            yield batch_of(held)

    return rows.mapInArrow(run, schema)


def token_windows(pieces: DataFrame) -> DataFrame:
    """The sequences themselves: ``sequence_id``, ``length`` and ``ids`` in order, as binary.

    A sequence has at most ``window`` pieces, so no group is large.
    """
    gathered = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("pieces"),
    )
    joined = F.aggregate("pieces.ids", F.lit(b""), lambda before, ids: F.concat(before, ids))
    return gathered.select("sequence_id", "length", joined.alias("ids"))


def default_tokenizer() -> str:
    """The public byte-level BPE file of 50,257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")

