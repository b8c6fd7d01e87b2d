"""Group functions of the class model: memory of a task, and results against plain versions."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from barsmith.llm import class_lm
from barsmith.llm import words as W

N_OPEN = 48
N_CLASSES = 2 + N_OPEN + class_lm.N_SHAPES


def block_of(texts):
    docs = pa.table({"block": pa.array([3] * len(texts), pa.int32()), "id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string()),
                     "held_out": pa.array([i % 5 == 1 for i in range(len(texts))])})
    rows = class_lm._number(docs)
    coded = rows.filter(pc.is_valid(rows.column("codes")))
    known = rows.filter(pc.is_valid(rows.column("word")))
    word, n, shape, at = (known.column(c).to_numpy() for c in ("word", "n", "shape", "at"))
    fixed = (at < 20) | (word == int(class_lm.END))
    cls = np.where(word == int(class_lm.END), 1, 2 + word % N_OPEN).astype(np.int32)
    info = (n * class_lm.N_SHAPES + shape) * 2 + np.where(fixed | (n == 0), 0, 1)
    train = coded.filter(pc.invert(coded.column("held_out"))).select(["block", "codes"])
    return known, train, pa.table({"block": known.column("block"), "word": known.column("word"), "at": known.column("at"), "cls": pa.array(cls), "info": pa.array(info)})


def peak(run):
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_task_holds_little_beside_its_block():
    rng = np.random.default_rng(5)
    words = np.array([f"w{i:06d}" for i in range(200_000)])
    texts = [" ".join(words[(rng.random(1500) ** 2 * len(words)).astype(int)]) for _ in range(1200)]
    _, train, sent = block_of(texts)
    contexts, most = peak(lambda: class_lm._contexts(N_CLASSES)(train, sent))
    assert contexts.num_rows > 150_000
    assert most < 130  # MB over 1.4 million words; 204 when the block's contexts were summed as one
    totals = rng.integers(1, 1000, (N_CLASSES, N_CLASSES)).astype(float)
    batches = contexts.sort_by("word").to_batches(10_000)
    moved, most = peak(lambda: sum(b.num_rows for b in class_lm._move(totals, N_OPEN)(iter(batches))))
    assert moved == contexts.num_rows
    assert most < 100  # MB, whatever the number of words


@pytest.mark.parametrize("limit", [1, 7, 500_000])
def test_contexts_in_parts_are_those_of_plain_counting(monkeypatch, limit):
    monkeypatch.setattr(class_lm, "PENDING", limit)
    monkeypatch.setattr(class_lm, "OCCURRENCES", limit)
    monkeypatch.setattr(W, "SLICE", 200)
    rng = random.Random(4)
    texts = [" ".join(f"w{int(rng.random() ** 3 * 60)}" for _ in range(rng.randrange(40))) for _ in range(30)] + ["", None]
    known, train, sent = block_of(texts)
    hash_of = lambda w: int(W.find(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]), lower=True).hash[:1].view(np.int64)[0])
    cls = dict(zip(sent.column("word").to_pylist(), sent.column("cls").to_pylist(), strict=True))
    free = {w for w, i in zip(sent.column("word").to_pylist(), sent.column("info").to_pylist(), strict=True) if i % 2}
    want, count = {w: Counter() for w in free}, Counter()
    for i, text in enumerate(texts):
        if i % 5 == 1:
            continue
        row = [hash_of(w) for w in (text or "").split()] + [int(class_lm.END)]
        count.update(row)
        for k, w in enumerate(row):
            if w in free:
                want[w][cls[row[k - 1]] if k else 0] += 1
                want[w][N_CLASSES + cls[row[k + 1]]] += 1
    assert {w: n for w, n in zip(known.column("word").to_pylist(), known.column("n").to_pylist(), strict=True) if n} == dict(count)
    got = class_lm._contexts(N_CLASSES)(train, sent)
    assert len(want) == got.num_rows > 10
    for r in got.to_pylist():
        packed = W.unpack(np.frombuffer(r["context"], np.uint8))[0].tolist()
        assert {p % (2 * N_CLASSES): p // (2 * N_CLASSES) for p in packed} == want[r["word"]]


def test_a_block_of_held_out_texts_has_words_without_contexts():
    known, train, sent = block_of([f"a b c{i}" for i in range(30)])
    got = class_lm._contexts(N_CLASSES)(train.slice(0, 0), sent)
    assert got.num_rows > 0 and set(got.column("context").to_pylist()) == {b""}
    totals = np.ones((N_CLASSES, N_CLASSES))
    assert sum(b.num_rows for b in class_lm._move(totals, N_OPEN)(iter(got.sort_by("word").to_batches()))) == got.num_rows
    nothing = sent.set_column(sent.column_names.index("info"), "info", pa.array(np.zeros(sent.num_rows, np.int64)))
    assert class_lm._contexts(N_CLASSES)(train, nothing).num_rows == 0


def test_best_class_is_the_one_of_most_gain():
    rng = np.random.default_rng(3)
    n_open, n_classes, n_words = 4, 9, 60
    totals = rng.integers(2000, 9000, (n_classes, n_classes)).astype(float)
    word = np.sort(rng.integers(0, n_words, 400))
    word, code = np.divmod(np.unique(word * 2 * n_classes + rng.integers(0, 2 * n_classes, 400)), 2 * n_classes)
    n = rng.integers(1, 40, len(word))
    cls = rng.integers(2, n_classes, n_words)
    xlogx = lambda x: x * math.log(x) if x > 0 else 0.0
    for w, best in enumerate(class_lm.best_classes(word, code, n, cls, totals, n_open)):
        gain = []
        for d in range(2, 2 + n_open):
            g, sides = 0.0, [0, 0]
            for k, m in zip(code[word == w].tolist(), n[word == w].tolist(), strict=True):
                side, c = divmod(k, n_classes)
                have = (totals[c, d] if side == 0 else totals[d, c]) - (m if cls[w] == d else 0)
                g += xlogx(have + m) - xlogx(have)
                sides[side] += m
            for side, m in enumerate(sides):
                have = totals.sum(side)[d] - (m if cls[w] == d else 0)
                g -= xlogx(have + m) - xlogx(have)
            gain.append(g)
        assert gain[best - 2] == pytest.approx(max(gain), abs=1e-6)
