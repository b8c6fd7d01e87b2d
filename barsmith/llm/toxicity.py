"""Operator 13: toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, pairs of neighbours and pairs with one word
between them (case of A-Z ignored, words are runs of letters, digits and bytes above
127), hashed to ``2 ** bits`` coordinates. FTRL-proximal keeps two numbers a
coordinate, the sum of gradients ``z`` and of squared ones ``n``: a coordinate's rate
falls with its own ``n``, and the L1 term holds its weight at exactly 0 until ``z``
passes ``l1``, so the model is a short list of weights, which is broadcast.

* ``fit_toxicity`` learns from a bounded sample of the labelled rows (``max_rows`` rows
  and ``max_bytes`` bytes of text, taken in the order of a hash of the id). The
  learner is one pass in the order of that hash after the other, so it runs in one
  task, which the two bounds keep small.
* ``toxicity`` scores every row in one pass without a shuffle: whole texts, all features.

The score is the sigmoid of the sum of the weights of the features present and a bias,
so it rises with evidence wherever it stands and however long the text is.

Odd input: a null or empty text has no feature and gets the bias alone; the score of a
model that saw no label is 0. Repeated ids are rows of their own; an id labelled twice
counts as toxic if any label says so, null labels are passed over, a null id is never
learned from and counts as held out (its text is the empty string, whose crc32 is 0).
Very long texts are handled in slices of a megabyte. Empty tables give empty results;
extra columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barsmith.llm import words as W
from barsmith.llm.frames import pick, stage

#: Bytes that part words here: ASCII without letters and digits.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[:128] = True
for _c in b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
    SEPARATORS[_c] = False

#: Bounds of the sample that the model is fitted on.
MAX_ROWS = 20_000
MAX_BYTES = 96 << 20

_PAIR = (np.uint64(0x9DDFEA08EB382D69), np.uint64(0xC6A4A7935BD1E995))
_SKIP = (np.uint64(0xB492B66FBE98F273), np.uint64(0x9AE16A3B2F90404F))


@dataclass(frozen=True)
class Settings:
    """Learner: ``alpha`` and ``beta`` set the per-coordinate rate, ``l1`` and ``l2`` the penalties."""

    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 1.0
    epochs: int = 5


@dataclass
class Ftrl:
    """The state of one learner: ``z`` and ``n`` per coordinate, the last one being the bias."""

    settings: Settings
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)
    l1: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.z = np.zeros((1 << self.settings.bits) + 1)
        self.n = np.zeros_like(self.z)
        self.l1 = np.full_like(self.z, self.settings.l1)
        self.l1[-1] = 0.0

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        """Weights of the coordinates ``at``; the bias has no L1 penalty."""
        s, z = self.settings, self.z[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1[at], 0.0)
        return -shrunk / ((s.beta + np.sqrt(self.n[at])) / s.alpha + s.l2)

    def learn(self, features: np.ndarray, label: int) -> float:
        """One step on a row (its distinct coordinates); returns the score before the step."""
        at = np.append(features, len(self.z) - 1)
        w = self.weights(at)
        score = float(sigmoid(w.sum()))
        g = score - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.settings.alpha * w
        self.n[at] = n + g * g
        return score


def sigmoid(x: np.ndarray | float) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def coordinates(words: W.Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinate and row of every word, neighbour pair and skip pair (repeats included)."""
    h, row = words.hash, words.row_of()
    values, rows = [h], [row]
    for gap, (a, b) in ((1, _PAIR), (2, _SKIP)):
        if len(h) > gap:
            same = row[:-gap] == row[gap:]
            values.append(W.mix(h[:-gap] * a + h[gap:] * b)[same])
            rows.append(row[:-gap][same])
    return (np.concatenate(values) >> np.uint64(64 - bits)).astype(np.int32), np.concatenate(rows)


def _feature_rows(column: pa.Array | pa.ChunkedArray, bits: int, weight: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of rows: first, end, and the distinct (row, coordinate) pairs, sorted.

    With ``weight`` only coordinates of a weight other than 0 are kept.
    """
    data, offsets = W.buffers(column)
    for i, j in W.slices(offsets):
        at, row = coordinates(W.find(data, offsets[i:j + 1], lower=True, sep=SEPARATORS), bits)
        if weight is not None:
            used = np.flatnonzero(weight[at])
            at, row = at[used], row[used]
        pairs = np.unique((row.astype(np.int64) << bits) | at)
        yield i, j, pairs >> bits, (pairs & ((1 << bits) - 1)).astype(np.int32)


def _crc_mod5(c: Column) -> Column:
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5


def is_held_out(doc_id: Column) -> Column:
    return _crc_mod5(doc_id) == 0


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Sample ``(place, text, label)`` of the labelled rows that are not held out, in the order of a hash of the id.

    ``docs`` has (id, text) and ``labels`` (id, label). The sample ends at ``max_rows``
    rows or ``max_bytes`` bytes, whichever comes first. Its ids are found from ids and
    text lengths alone; at most ``max_rows`` of them are sorted, summed and broadcast.
    """
    marked = (labels.where(F.col("label").isNotNull() & F.col("id").isNotNull() & ~is_held_out(F.col("id")))
              .groupBy("id").agg(F.max("label").alias("label")))
    lengths = docs.groupBy("id").agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes"))
    first = (marked.join(lengths, "id").withColumn("place", F.xxhash64("id", F.lit(13)))
             .orderBy("place", "id").limit(max_rows))
    # At most max_rows rows stand under this window.
    upto = Window.orderBy("place", "id").rowsBetween(Window.unboundedPreceding, 0)
    chosen = first.withColumn("total", F.sum("bytes").over(upto)).where(F.col("total") <= max_bytes)
    return docs.join(F.broadcast(chosen.select("id", "label", "place")), "id").select("place", "id", "label", "text")


def _fit(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[pa.RecordBatch]:
    rows: list[np.ndarray] = []
    labels: list[int] = []
    for batch in batches:
        labels += [int(v) for v in batch.column("label").to_pylist()]
        for i, j, row, at in _feature_rows(batch.column("text"), settings.bits):
            rows += np.split(at, np.searchsorted(row, np.arange(1, j - i)))
    model = Ftrl(settings)
    for _ in range(settings.epochs):
        for features, label in zip(rows, labels):
            model.learn(features, label)
    weight = model.weights(slice(None)).astype(np.float64)
    used = np.flatnonzero(weight)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(weight[used])], ["at", "weight"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "toxic",
                 settings: Settings = Settings(), max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Non-zero weights ``(at, weight)``; ``at == 2 ** bits`` is the bias. At most ``2 ** bits + 1`` rows."""
    sample = training_rows(pick(docs, id=id, text=text), pick(labels, id=id, label=label), max_rows, max_bytes)
    ordered = sample.repartition(1).sortWithinPartitions("place", "id", "text").select("label", "text")
    return stage(ordered.mapInArrow(lambda batches: _fit(batches, settings), "at int, weight double"), "toxicity-weights")


def toxicity(docs: DataFrame, weights: DataFrame, *, id: str = "doc_id", text: str = "text", bits: int = Settings.bits) -> DataFrame:
    """``(<id>, held_out, score, predicted)`` of every row by the broadcast weights."""
    spark = docs.sparkSession
    dense = np.zeros((1 << bits) + 1)
    found = weights.toPandas()  # 2 ** bits + 1 rows at most
    dense[found["at"].to_numpy(np.int64)] = found["weight"].to_numpy()
    shared = spark.sparkContext.broadcast((dense[:-1].astype(np.float32), float(dense[-1]), bool(len(found))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias, learned = shared.value
        for batch in batches:
            total = np.full(batch.num_rows, bias)
            for i, j, row, at in _feature_rows(batch.column("text"), bits, weight):
                total[i:j] += np.bincount(row, weights=weight[at], minlength=j - i)
            value = sigmoid(total) if learned else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(value)], ["id", "score"])

    rows = pick(docs, id=id, text=text)
    scored = rows.select("id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(score, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return scored.select(F.col("id").alias(id), is_held_out(F.col("id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
