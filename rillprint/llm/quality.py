"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Features of a text are n-grams (one and two) of its words, and of its words' shapes: letters to ``a``,
digits to ``0``, repeats of a sign to one, and whether a word repeats the one before.  Each is
hashed to a bucket; its value is the square root of its share among the text's n-grams of that kind, so every kind
has unit length however long the text is.  The model is fitted on a bounded sample of labelled rows
(MAX_LABELLED), whose features alone reach the driver; its non-zero weights score all texts as sparse dot products.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import fresh, small_batches

#: Labelled rows that a model is fitted on, at most: those with the smallest hash of their doc_id.
MAX_LABELLED = 6_000
BITS = 20
EPOCHS = 3
WORDS_KEPT = 200_000

_LETTERS, _DIGITS, _AGAIN = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"(.)\1+")


def shape(word: str) -> str:
    if word.isalpha():
        return "a"
    if word[:-1].isalpha():
        return "a" + _DIGITS.sub("0", word[-1])
    return _AGAIN.sub(r"\1", _DIGITS.sub("0", _LETTERS.sub("a", word)))


class Words(dict):
    """Word to its number; hashes of words and shapes stand in arrays by number."""

    def __init__(self):
        super().__init__()
        self.hashes, self.new = np.zeros((0, 2), np.uint64), []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append((zlib.crc32(word.lower().encode("utf-8", "surrogatepass")), zlib.crc32(shape(word).encode("utf-8", "surrogatepass"))))
        return n

    def of(self, words: list[str]) -> np.ndarray:
        """Two rows of hashes for each word: of itself and of its shape."""
        if len(self) > WORDS_KEPT:
            self.clear()
            self.hashes, self.new = self.hashes[:0], []
        n = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            self.hashes, self.new = np.concatenate([self.hashes, np.array(self.new, np.uint64)]), []
        return self.hashes[n]


def features(text: str | None, words: Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text; none where it has no words."""
    split = (text or "").split()
    if not split:
        return np.zeros(0, np.int64), np.zeros(0)
    both = words.of(split)
    word, form = both[:, 0], both[:, 1]
    kinds = [word * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1), form * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(2)]
    if len(split) > 1:
        same = (word[1:] == word[:-1]).astype(np.uint64)
        kinds.append((word[:-1] * np.uint64(0x165667B19E3779F9) + word[1:]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(3))
        kinds.append((form[:-1] * np.uint64(0x165667B19E3779F9) + form[1:] * np.uint64(2) + same) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(4))
    at, values = [], []
    for k in kinds:
        bucket, n = np.unique((k ^ (k >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits), return_counts=True)
        at.append(bucket.astype(np.int64))
        values.append(np.sqrt(n / len(k)))
    return np.concatenate(at), np.concatenate(values)


class Ftrl:
    """Per-coordinate FTRL-proximal logistic regression; weights are made from (z, n) when asked for."""

    def __init__(self, bits: int = BITS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.3, l2: float = 0.1):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)  # the last one is the bias
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        at, values = np.append(at, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ values, -35, 35)))
        g = (p - label) * values
        np.add.at(self.z, at, g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w)
        np.add.at(self.n, at, g * g)

    def model(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of the non-zero weights."""
        w = self.weights(np.arange(len(self.z)))
        at = np.flatnonzero(w)
        return at, w[at]


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights from (buckets, values, label) rows, in an order shuffled by a fixed seed."""
    ftrl, order = Ftrl(bits), np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            ftrl.learn(*rows[i])
    return ftrl.model()


class Featurize:
    def __init__(self, bits: int):
        self.bits = bits

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            pairs = [features(t, words, self.bits) for t in batch["text"].to_pylist()]
            at = pa.array([a.astype("<i4").tobytes() for a, _ in pairs], pa.binary())
            values = pa.array([v.astype("<f8").tobytes() for _, v in pairs], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["quality"], at, values], ["doc_id", "quality", "at", "values"])


class Score:
    def __init__(self, at: np.ndarray, weights: np.ndarray, bits: int, to: str = "__score"):
        self.at, self.weights, self.bits, self.to = at, weights, bits, to

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, words = np.zeros((1 << self.bits) + 1), Words()
        dense[self.at] = self.weights
        for batch in batches:
            margins = np.full(batch.num_rows, dense[-1])
            for i, text in enumerate(batch["text"].to_pylist()):
                at, values = features(text, words, self.bits)
                margins[i] += dense[at] @ values
            score = 1 / (1 + np.exp(-np.clip(margins, -35, 35)))
            columns = [*batch.columns, pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, self.to])


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, bits: int = BITS, max_labelled: int = MAX_LABELLED) -> Score:
    """A scorer fitted on at most ``max_labelled`` labelled rows that are not held out."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.select("doc_id", "quality").orderBy(F.xxhash64(F.col("doc_id").cast("long")), "doc_id", "quality").limit(max_labelled)
    texts = small_batches(docs).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # max_labelled rows at most
    rows = texts.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), F.col("text").cast("string"))
    found = rows.mapInArrow(Featurize(bits), "doc_id long, quality int, at binary, values binary").collect()
    found.sort(key=lambda r: (r["doc_id"], r["quality"], bytes(r["at"])))
    examples = [(np.frombuffer(r["at"], "<i4").astype(np.int64), np.frombuffer(r["values"], "<f8"), r["quality"]) for r in found]
    return Score(*fit(examples, bits), bits)


def score_documents(docs: DataFrame, scorer: Score) -> DataFrame:
    """All columns of docs (with a text) and one named by scorer.to, 0 to 1.

    Texts without words, null ones included, get the score of the bias alone; with no labels at all every
    score is 0.5.  Equal texts get equal scores; an empty table gives no rows.
    """
    schema = StructType([*docs.schema.fields]).add(scorer.to, DoubleType())
    return docs.mapInArrow(scorer, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1: good quality) of every row."""
    scored = score_documents(docs.select("doc_id", F.col("text").cast("string").alias("text")), fit_quality(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, whose text the classifier does not reject."""
    scorer = fit_quality(docs, labels)
    scorer.to = fresh("__score", docs)
    return score_documents(docs, scorer).where(F.col(scorer.to) >= 0.5).drop(scorer.to)
