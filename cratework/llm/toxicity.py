"""Toxicity: subword-bag embeddings averaged into a linear softmax."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratework.llm.common import text_or_empty
from cratework.llm.per_row import append_columns

_WORDS = re.compile(r"\w+")


@dataclass(frozen=True)
class Settings:
    """What training may use. The rows are the bound of the sample that the driver gathers."""

    max_rows: int = 6000
    max_chars: int = 6000  # longer texts are scored, not trained on
    buckets: int = 1 << 16
    dims: int = 8
    shortest: int = 3
    longest: int = 5
    passage: int = 6  # words
    focus: float = 2.0
    epochs: int = 12
    batch: int = 128
    rate: float = 0.02
    seed: int = 7


def subwords(words: list[str], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of their character n-grams, end to end, and each one's word.

    A word has a mark at both ends; an n-gram that it holds twice counts twice.
    """
    marked = "".join(f"<{w}>" for w in words)
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(codes)) - starts[owner]
    whole = np.add.reduceat(_mixed(codes + (place.astype(np.uint64) << np.uint64(32))), starts)
    found, owners = [_mixed(whole)], [np.arange(len(words))]
    for n in range(settings.shortest, settings.longest + 1):
        count = len(codes) - n + 1
        if count < 1:
            break
        total = np.full(count, n, np.uint64)
        for i in range(n):
            total = _mixed(total + codes[i : i + count])
        inside = owner[:count] == owner[n - 1 :]
        found.append(total[inside])
        owners.append(owner[:count][inside])
    buckets = np.concatenate(found) % np.uint64(settings.buckets)
    return buckets.astype(np.int32), np.concatenate(owners)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


@dataclass
class Model:
    """``weights[bucket]``: what a subword adds to the log odds of label 1; and the bias.

    The softmax is linear in the average of the bag's embeddings, so each embedding's product
    with the softmax weights can be taken once, before the average.
    """

    weights: np.ndarray
    bias: float
    settings: Settings


def train(texts: list[str], labels: list[int], settings: Settings) -> Model:
    """Embeddings and softmax weights together, by Adam over shuffled batches.

    A text is a set of passages, each an average of its subwords' embeddings under the same
    softmax. The passages of a text share its loss in proportion to exp(focus * log odds); the
    focus grows from 0 (all alike) so that in the end the passage most like label 1 decides,
    as it does in scoring.
    """
    rng = np.random.default_rng(settings.seed)
    numbers: dict[str, int] = {}
    docs = [_passages(t, numbers, settings.passage) for t in texts]
    buckets = _bags(list(numbers), settings)
    y = np.asarray(labels, np.int64)
    embedding = rng.normal(0, 0.1, (settings.buckets, settings.dims)).astype(np.float32)
    output = rng.normal(0, 0.1, (settings.dims, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    parameters = [embedding, output, bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    step = 0
    for epoch in range(settings.epochs):
        order = rng.permutation(len(docs))
        focus = settings.focus * epoch / max(1, settings.epochs - 1)
        for at in range(0, len(order), settings.batch):
            chosen = order[at : at + settings.batch]
            passages = [p for i in chosen for p in docs[i]]
            doc = np.repeat(np.arange(len(chosen)), [len(docs[i]) for i in chosen])
            words, token = np.unique(np.concatenate(passages), return_inverse=True)
            row = np.repeat(np.arange(len(passages)), [len(p) for p in passages])
            bags = [buckets[w] for w in words] or [np.zeros(0, np.int32)]
            ids = np.concatenate(bags)
            sizes = np.array([len(b) for b in bags])
            owner = np.repeat(np.arange(len(bags)), sizes)

            by_word = _sums(owner, embedding[ids], len(bags))
            total = np.bincount(row, sizes[token], len(passages)) if len(token) else np.zeros(1)
            total = np.maximum(total, 1).astype(np.float32)[:, None]
            hidden = _sums(row, by_word[token], len(passages)) / total
            logits = hidden @ output + bias
            pull = focus * (logits[:, 1] - logits[:, 0])
            top = np.full(len(chosen), -np.inf)
            np.maximum.at(top, doc, pull)
            part = np.exp(pull - top[doc])
            part /= np.bincount(doc, part, len(chosen))[doc]
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = odds / odds.sum(axis=1, keepdims=True)
            error[np.arange(len(passages)), y[chosen][doc]] -= 1
            error *= (part / len(chosen))[:, None]

            back = _sums(token, (error @ output.T / total)[row], len(bags))
            gradients = [
                _sums(ids, back[owner], settings.buckets),
                hidden.T @ error,
                error.sum(axis=0),
            ]
            step += 1
            for p, g, (first, second) in zip(parameters, gradients, moments, strict=True):
                first += 0.1 * (g - first)
                second += 0.001 * (g * g - second)
                scale = np.sqrt(second / (1 - 0.999**step)) + 1e-8
                p -= settings.rate * (first / (1 - 0.9**step)) / scale
    difference = (output[:, 1] - output[:, 0]).astype(np.float64)
    return Model(embedding @ difference, float(bias[1] - bias[0]), settings)


def _bags(words: list[str], settings: Settings) -> list[np.ndarray]:
    """The buckets of each word; of few words at once, as all their codes would fill the driver."""
    bags = []
    for at in range(0, len(words), 2000):
        part = words[at : at + 2000]
        ids, owner = subwords(part, settings)
        ends = np.cumsum(np.bincount(owner, minlength=len(part)))
        bags += np.split(ids[np.argsort(owner, kind="stable")], ends[:-1])
    return bags


def _passages(text: str, numbers: dict[str, int], size: int) -> list[np.ndarray]:
    words = [numbers.setdefault(w, len(numbers)) for w in _WORDS.findall(text.lower())]
    parts = [np.array(words[i : i + size], np.int32) for i in range(0, len(words), size)]
    return parts or [np.zeros(0, np.int32)]


def _sums(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    columns = [np.bincount(index, values[:, d], size) for d in range(values.shape[1])]
    return np.stack(columns, axis=1).astype(np.float32)


class Scorer:
    """Scores texts; remembers what the subwords of words add, up to a bound."""

    def __init__(self, model: Model, most: int = 500_000):
        self.model, self.most = model, most
        self._forget()

    def _forget(self):
        self.places: dict[str, int] = {}
        self.sums, self.counts = np.zeros(0), np.zeros(0, np.int64)

    def _learn(self, words: list[str]):
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            ids, owner = subwords(part, self.model.settings)
            added = np.bincount(owner, self.model.weights[ids], len(part))
            self.sums = np.append(self.sums, added)
            self.counts = np.append(self.counts, np.bincount(owner, minlength=len(part)))
            self.places.update(zip(part, range(len(self.places), len(self.places) + len(part))))

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1 of each text's passage most like it; without words, the bias's."""
        odds = np.full(len(texts), self.model.bias)
        for at in range(0, len(texts), 200):
            lists = [_WORDS.findall((t or "").lower()) for t in texts[at : at + 200]]
            if len(self.places) > self.most:
                self._forget()
            self._learn(list({w for words in lists for w in words if w not in self.places}))
            for i, words in enumerate(lists, at):
                if words:
                    place = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
                    first = np.arange(0, len(words), self.model.settings.passage)
                    sums = np.add.reduceat(self.sums[place], first)
                    counts = np.add.reduceat(self.counts[place], first)
                    odds[i] += (sums / counts).max()
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def held_out(id_column: str = "doc_id"):
    """Rows whose labels are never learned from; a row without an id is not held out."""
    remainder = F.crc32(F.col(id_column).cast("string").cast("binary")) % 5
    return F.coalesce(remainder == 0, F.lit(False))


def training_rows(
    docs: DataFrame,
    labels: DataFrame,
    settings: Settings,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
) -> list:
    """At most ``settings.max_rows`` labelled rows that are not held out, by a hash of the id."""
    marked = labels.select(F.col(id_column).alias("_id"), F.col(label_column).alias("_label"))
    usable = marked.where(F.col("_label").isin(0, 1) & ~held_out("_id"))
    text = text_or_empty(text_column)
    rows = docs.where(F.char_length(text) <= settings.max_chars).select(
        F.col(id_column).alias("_id"), text.alias("_text")
    )
    # Ids first, so that only texts of the bounded sample leave their partitions.
    first = [F.xxhash64("_id", F.lit(settings.seed)), F.col("_id")]
    chosen = usable.join(rows.select("_id"), "_id").select("_id").distinct()
    chosen = chosen.orderBy(*first).limit(settings.max_rows)
    chosen = usable.join(chosen, "_id").orderBy(*first).limit(settings.max_rows)
    sample = rows.join(F.broadcast(chosen), "_id")
    ordered = sample.orderBy(*first, "_text", "_label").limit(settings.max_rows)
    return ordered.select("_text", "_label").collect()


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), **columns) -> Model:
    """The model of a bounded sample of labelled rows; without rows, of one that knows nothing."""
    rows = training_rows(docs, labels, settings, **columns)
    if not rows:
        return Model(np.zeros(settings.buckets), 0.0, settings)
    return train([r._text for r in rows], [r._label for r in rows], settings)


def score_toxicity(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) of each whole text.

    The text alone is scored: NULL and empty texts get the model's bias, a table without rows
    gives none, columns of these two names are replaced. The model has a fixed size (a number
    per bucket) and goes to the executors with the function; documents are not shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def prepare():
        scorer = Scorer(shared.value)

        def run(texts):
            return [(float(s), int(s >= 0.5)) for s in scorer.score(texts)]

        return run

    return append_columns(docs, [text_column], "score double, predicted int", prepare)
