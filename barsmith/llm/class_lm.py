"""Class-based bigram language model with exchange clustering, trained and applied at scale.

The model is that of Brown and others: each word belongs to one class, and

    P(w | v) = P(class(w) | class(v)) * P(w | class(w)).

Classes. Every training word is clustered by its neighbours, in two parts. The
``CLUSTERED`` most frequent words are the seed: the exchange algorithm starts from a
split by frequency, and every word in turn moves to the class in which the class
bigrams are likeliest, until a sweep moves few words or ``SWEEPS`` are done. Its input
is their table of bigram counts over all training texts, at most (CLUSTERED + shapes)^2
numbers, so it runs on the driver; the other words stand in it as shapes (length,
first and last character). Then come ``ROUNDS`` sweeps over all other training words,
down to those seen once: a word's left and right class counts over the corpus are
gathered by word, and it moves to the class where the same likelihood gains most. A
sweep's words move in batches on the executors against the class totals of the sweep
before, which are all that is broadcast; the seed keeps its classes, and a word beside
itself counts as beside its old class. A word never seen in training takes the class
that holds the most training words of its shape, so a class exists for any word of any
corpus. Begin and end of a text are classes of their own.

Smoothing. Class transitions are interpolated with the class unigram by the
Witten-Bell weight of the left class; a word in its class has (c + 0.5) over
(the class's count + 0.5 * (its training words + 1)): each class keeps the share of one
more word for all words never seen, so both factors sum to one.

Spark's part. Words are 64-bit hashes. Documents are dealt to blocks by a hash of
the id, once: a staged table holds each text as numbers of its block's words, one or two
bytes a word, and that is what sweeps and scoring deal again. Each block counts its words
once, so a frequent word is one row a block, not one an occurrence; counts are summed over
blocks by word and go back to the blocks that have the word, with its class. Sweeps and
scoring join each block with its own words, so no table of all words is ever held by one
task or by the driver; vocabulary size and totals are aggregates. What is broadcast is fixed in size by CLUSTERED and CLASSES.

Results for odd input: a null or empty text has the end token alone; a null id takes
part as the text '' in the held-out rule; every row is scored by itself. If nothing
is in training, all counts are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.llm import words as W
from barsmith.llm.frames import block_count, complete_runs, discard, pick, release, run_starts, stage

#: Words of the seed, classes, the most sweeps over the seed, and the sweeps over all other words.
CLUSTERED, CLASSES, SWEEPS, ROUNDS = 1000, 48, 5, 2
#: Bytes of text in a block; a block repeats its vocabulary in every sweep, so larger ones shuffle less.
TEXT_BYTES = 32 << 20
#: New entries that a task holds before it sums them, and word occurrences whose contexts it sorts at a time.
PENDING, OCCURRENCES = 500_000, 500_000
#: Held out: crc32 of the id as text leaves this remainder by FOLDS.
FOLDS, HELD_OUT = 5, 1
#: The end of a text as a word (no word hashes to it but by chance), and shapes of words.
END = np.uint64(0x5E0D0F7E47)
_LENGTHS = np.array([1, 2, 3, 4, 5, 6, 8, 10, 13, 17])  # length bands by their first length
N_SHAPES = len(_LENGTHS) * 4 * 3
#: Kinds of bytes: 0 letter, 1 digit, 2 other ASCII, 3 from 0x80 on.
_KIND = np.full(256, 2, np.int64)
_KIND[48:58] = 1
_KIND[97:123] = _KIND[65:91] = 0
_KIND[128:] = 3


def tokens(column: pa.Array) -> Iterator[tuple[int, W.Words, np.ndarray]]:
    """(first row, lower-cased words, their shapes) for slices of a text column."""
    data, offsets = W.buffers(column)
    for i, j in W.slices(offsets):
        words = W.find(data, offsets[i:j + 1], lower=True)
        if len(words.hash):
            band = np.searchsorted(_LENGTHS, words.end - words.start, "right") - 1
            last = _KIND[data[words.end - 1]]
            shape = (band * 4 + _KIND[data[words.start]]) * 3 + np.where(last == 3, 0, last)
        else:
            shape = np.zeros(0, np.int64)
        yield i, words, shape


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct keys, sums of the values per key, and the first index of each."""
    order = np.argsort(key, kind="stable")
    begin = run_starts(key[order])
    return key[order][begin], [np.add.reduceat(v[order], begin) if len(begin) else v[:0] for v in values], order[begin]


def _merged(pieces: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Words of several pieces as one: word, shape, training count and count."""
    word, shape, n, total = (np.concatenate(x) for x in zip(*pieces, strict=True))
    word, (n, total), first = _summed(word, n, total)
    return word, shape[first], n, total


def _number(docs: pa.Table) -> pa.Table:
    """A block's texts as numbers of its words, and its words.

    Rows with ``codes`` are texts (their words and end, packed); the others are words with their number, shape and
    training count. The block's commonest words have the smallest numbers, so most take one byte.
    """
    out = docs.column("held_out").to_numpy(zero_copy_only=False)
    pieces, slices, size = [], [], 0
    for i, words, shape in tokens(docs.column("text")):
        hashes, shapes, rows = _with_ends(words, shape)
        train = np.repeat(~out[i:i + len(rows) - 1], np.diff(rows))
        word, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        n, total = (np.bincount(x, minlength=len(word)).astype(np.int32) for x in (of[train], of))
        pieces.append((word, shapes[first].astype(np.int16), n, total))
        slices.append((word, of.astype(np.int32), rows))
        size += len(word)
        if size > PENDING:
            pieces, size = [_merged(pieces)], 0
    word, shape, n, total = _merged(pieces)
    del pieces
    at = np.empty(len(word), np.int64)
    at[np.argsort(-total, kind="stable")] = np.arange(len(word))
    data, ends = [], [np.zeros(1, np.int64)]
    for k, (mine, of, rows) in enumerate(slices):
        codes, end = W.pack(at[np.searchsorted(word, mine)][of])
        ends.append(end[rows[1:] - 1] + ends[-1][-1])
        data.append(codes)
        slices[k] = None
    n_texts, n_words, id_type = docs.num_rows, len(word), docs.schema.field("id").type
    offsets = pa.array(np.concatenate(ends), pa.int32())
    codes = pa.BinaryArray.from_buffers(pa.binary(), n_texts, [None, offsets.buffers()[1], pa.py_buffer(np.concatenate(data).tobytes())])
    block = docs.column("block")[0].as_py()
    names = ["block", "id", "held_out", "codes", "word", "at", "shape", "n"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    texts = [pa.array(np.full(n_texts, block, np.int32)), docs.column("id"), docs.column("held_out"), codes, *(pa.nulls(n_texts, t) for t in kinds)]
    vocabulary = [pa.array(np.full(n_words, block, np.int32)), pa.nulls(n_words, id_type), pa.nulls(n_words, pa.bool_()), pa.nulls(n_words, pa.binary()),
                  *(pa.array(x, t) for x, t in zip((word.view(np.int64), at, shape, n), kinds, strict=True))]
    return pa.concat_tables([pa.Table.from_arrays(texts, names), pa.Table.from_arrays(vocabulary, names)])


def _sum_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by word: each with the word's count over all blocks; ``one`` marks one row a word."""
    for table in complete_runs(batches, "word"):
        word, n = table.column("word").to_numpy(), table.column("n").to_numpy()
        begin = run_starts(word)
        total = np.repeat(np.add.reduceat(n, begin), np.diff(np.append(begin, len(n))))
        one = np.zeros(len(word), bool)
        one[begin] = True
        yield pa.RecordBatch.from_arrays([table.column("block").combine_chunks(), pa.array(word), table.column("at").combine_chunks(),
                                          table.column("shape").combine_chunks(), pa.array(total), pa.array(one)], ["block", "word", "at", "shape", "count", "one"])


@dataclass
class Model:
    """What scoring needs; every array is of a size fixed by the parameters."""

    n_open: int  # classes of words: 2 to n_open + 1, after begin and end
    shape_class: np.ndarray  # class of a word never seen, by the class before it and its shape
    log_next: np.ndarray  # log10 P(class | class before)
    log_all: np.ndarray  # log10 of (class count + 0.5 * (its words + 1))
    total: int
    distinct: int


def symbols(words: np.ndarray, shape: np.ndarray, top: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    out = shape + 2
    if len(top):
        at = np.minimum(np.searchsorted(top, words), len(top) - 1)
        out = np.where(top[at] == words, symbol[at], out)
    return np.where(words == END, 1, out)


def _with_ends(words: W.Words, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and shapes with an end after each row, and the row ranges."""
    counts = words.counts
    rows = np.concatenate([[0], np.cumsum(counts + 1)])
    hashes, shapes = np.full(rows[-1], END, np.uint64), np.zeros(rows[-1], np.int64)
    at = np.arange(len(words.hash)) + words.row_of()
    hashes[at], shapes[at] = words.hash, shape
    return hashes, shapes, rows


def _count_pairs(top: np.ndarray, symbol: np.ndarray, n_symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_symbols * n_symbols, np.int64)
        for batch in batches:
            for _, words, shape in tokens(batch.column(0)):
                word, shape, rows = _with_ends(words, shape)
                right = symbols(word, shape, top, symbol)
                left = np.concatenate([[0], right[:-1]])
                left[rows[:-1]] = 0
                key, n = np.unique(left * n_symbols + right, return_counts=True)
                total[key] += n
        key = np.flatnonzero(total)
        if len(key):
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(total[key], pa.int64())], ["pair", "n"])
    return run


def nlogn(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def exchange(pairs: np.ndarray, n: np.ndarray, n_symbols: int, first: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each symbol. Symbols below ``first`` keep a class of their own; the others are moved.

    Maximises the sum of N(c, d) log N(c, d) minus the sums of the class counts'
    n log n, the likelihood of the class bigrams. Counts of a word with each class
    are dense rows, so a move is tried against all classes at once.
    """
    m = max(0, n_symbols - first)
    n_classes = first + min(classes, m) if m else first
    class_of = np.arange(n_symbols)
    if not m:
        return class_of
    table = np.zeros((n_symbols, n_symbols))
    table[pairs // n_symbols, pairs % n_symbols] = n
    weight = table.sum(1) + table.sum(0)
    ranked = first + np.argsort(-weight[first:], kind="stable")
    class_of[ranked] = first + np.arange(m) % (n_classes - first)
    member = np.zeros((n_symbols, n_classes))
    member[np.arange(n_symbols), class_of] = 1
    right, left = table @ member, table.T @ member  # counts of a word before, and after, each class
    cc = member.T @ right
    own = np.diag(table).copy()
    open_ = np.arange(first, n_classes)
    for _ in range(sweeps):
        moved = 0
        for w in ranked:
            a = class_of[w]
            r, l, s = right[w].copy(), left[w].copy(), own[w]
            # Take the word out of its class.
            r[a] -= s
            l[a] -= s
            cc[a] -= r
            cc[:, a] -= l
            cc[a, a] -= s
            row, col = cc.sum(1) + l, cc.sum(0) + r  # the word's neighbours count wherever it goes
            total_r, total_l = r.sum() + s, l.sum() + s
            # Gain of putting it into each open class d: rows and columns that change.
            block, colblock = cc[open_], cc[:, open_].T
            gain = (nlogn(block + r) - nlogn(block)).sum(1) + (nlogn(colblock + l) - nlogn(colblock)).sum(1)
            diag = cc[open_, open_]
            gain -= nlogn(diag + r[open_]) - nlogn(diag) + nlogn(diag + l[open_]) - nlogn(diag)
            gain += nlogn(diag + r[open_] + l[open_] + s) - nlogn(diag)
            gain -= nlogn(row[open_] + total_r) - nlogn(row[open_]) + nlogn(col[open_] + total_l) - nlogn(col[open_])
            b = int(open_[np.argmax(gain)])
            if gain[b - first] <= gain[a - first] + 1e-9:
                b = a
            cc[b] += r
            cc[:, b] += l
            cc[b, b] += s
            if b != a:
                moved += 1
                class_of[w] = b
                right[:, a] -= table[:, w]
                right[:, b] += table[:, w]
                left[:, a] -= table[w]
                left[:, b] += table[w]
        if moved * 100 <= m:
            break
    return class_of


_KNOWN = "block int, word long, at int, shape int, count long, one boolean"
_CLASSED = f"{_KNOWN}, cls int, fixed boolean"
#: What a sweep sends of a word: its count, shape and whether it may move are one number, as most of a row's cost is its fields.
_SENT = "block int, word long, at int, cls int, info long"
_INFO = f"(count * {N_SHAPES} + shape) * 2 + if(fixed or count = 0, 0, 1) as info"


def _with_seed(top: np.ndarray, cls: np.ndarray, n_open: int):
    """Rows of the vocabulary with ``cls``: that of the seed, or the word's shape above the open classes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, shape = batch.column("word").to_numpy().view(np.uint64), batch.column("shape").to_numpy()
            out, fixed = 2 + n_open + shape, word == END
            if len(top):
                at = np.minimum(np.searchsorted(top, word), len(top) - 1)
                fixed = fixed | (top[at] == word)
                out = np.where(fixed, cls[at], out)
            out = np.where(word == END, 1, out)
            names = ["block", "word", "at", "shape", "count", "one"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out.astype(np.int32)), pa.array(fixed)], [*names, "cls", "fixed"])
    return run


def _numbered(docs: pa.Table, classed: pa.Table) -> tuple[pa.Table, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """The block's words by number, and for slices of its texts the numbers of their words (ends included) with the row ranges."""
    classed = classed.take(pa.array(np.argsort(classed.column("at").to_numpy()))).combine_chunks()

    def texts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        data, offsets = W.buffers(docs.column("codes"))
        for i, j in W.slices(offsets, 1 << 18):
            codes, ends = W.unpack(data[offsets[i]:offsets[j]])
            yield codes, np.searchsorted(ends, offsets[i:j + 1] - offsets[i], "right")
    return classed, texts()


def _before(cls: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.concatenate([[0], cls[:-1]])
    out[rows[:-1]] = 0
    return out


def _contexts(n_classes: int):
    """Per word of a block that may move the counts of the classes before it (code c) and after it (code n_classes + c), packed."""
    codes = 2 * n_classes

    def run(docs: pa.Table, classed: pa.Table) -> pa.Table:
        classed, texts = _numbered(docs, classed)
        cls, free = classed.column("cls").to_numpy().astype(np.int16), classed.column("info").to_numpy() % 2 == 1
        moving = np.flatnonzero(free)
        classed = classed.take(pa.array(moving))
        kept = [(np.zeros(0, np.int32), np.zeros(0, np.int16), np.zeros(0, np.int16))]
        for at, rows in texts:  # occurrences of words that may move, with the classes beside each
            c, mine = cls[at], free[at]
            kept.append((at[mine].astype(np.int32), _before(c, rows)[mine].astype(np.int16), np.append(c[1:], 0)[mine].astype(np.int16)))
        at, before, after = (np.concatenate(x) for x in zip(*kept, strict=True))
        del kept
        # Contexts of some words at a time: a word's are sorted and packed with all its occurrences in the block.
        seen = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(free))[moving])])
        cuts = np.unique(np.concatenate([[0], np.searchsorted(seen, np.arange(0, seen[-1], OCCURRENCES)), [len(moving)]]))
        parts, ends = [], [np.zeros(1, np.int32)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            mine = np.flatnonzero((at >= moving[i]) & (at <= moving[j - 1]))
            key = at[mine].astype(np.int64) * codes
            key, n = np.unique(np.concatenate([key + before[mine], key + n_classes + after[mine]]), return_counts=True)
            data, end = W.pack(n * codes + key % codes)
            until = np.searchsorted(key, (moving[i:j] + 1) * codes)  # contexts are of moving words alone, in their order
            parts.append(data.tobytes())
            ends.append((np.append(0, end)[until] + int(ends[-1][-1])).astype(np.int32))
        offsets = pa.array(np.concatenate(ends), pa.int32())
        context = pa.BinaryArray.from_buffers(pa.binary(), len(moving), [None, offsets.buffers()[1], pa.py_buffer(b"".join(parts))])
        return classed.append_column("context", context)
    return run


def _added(table: np.ndarray, small: int = 16):
    """Function of rows of ``table``, what is added and present classes: the gain of n log n in each open class.

    A word's own counts are first taken out of its present class.
    """
    plain, n_open = nlogn(table), table.shape[1]
    steps = np.stack([nlogn(table + m) - plain for m in range(small)])  # most words add little, which is looked up

    def gain(row: np.ndarray, m: np.ndarray, cls: np.ndarray) -> np.ndarray:
        out = steps[np.minimum(m, small - 1), row]
        large = np.flatnonzero(m >= small)
        out[large] = nlogn(table[row[large]] + m[large, None]) - plain[row[large]]
        mine = np.flatnonzero((cls >= 2) & (cls < 2 + n_open))
        have = table[row[mine], cls[mine] - 2]
        out[mine, cls[mine] - 2] = nlogn(have) - nlogn(have - m[mine])
        return out
    return gain


def best_classes(word: np.ndarray, code: np.ndarray, n: np.ndarray, cls: np.ndarray, totals: np.ndarray, n_open: int) -> np.ndarray:
    """For each word the open class in which the class bigrams gain most.

    ``word`` (ascending), ``code`` and ``n`` are the words' contexts, ``cls`` their present classes, ``totals`` the
    class bigrams; a word's own counts are taken out of its present class first.
    """
    n_classes, open_ = len(totals), np.arange(2, 2 + n_open)
    # Row c: counts of each open class after class c; row n_classes + c: before it.
    added = _added(np.concatenate([totals[:, open_], totals[open_].T]))
    gain = np.zeros((len(cls), n_open))
    for at in range(0, len(word), 20_000):
        w, k, m = (x[at:at + 20_000] for x in (word, code, n))
        begin = run_starts(w)
        gain[w[begin]] += np.add.reduceat(added(k, m, cls[w]), begin)
    margin = _added(np.stack([totals.sum(0)[open_], totals.sum(1)[open_]]))
    own = np.bincount(word * 2 + code // n_classes, n, len(cls) * 2).astype(np.int64).reshape(-1, 2)
    for side in (0, 1):
        gain -= margin(np.full(len(cls), side), own[:, side], cls)
    return 2 + gain.argmax(1)


def _move(totals: np.ndarray, n_open: int):
    """Rows sorted by word to rows of the vocabulary with the word's new class."""
    codes = 2 * len(totals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in complete_runs(batches, "word", 40_000, 8 << 20):
            table = table.combine_chunks()
            words, cls, info = (table.column(c).to_numpy() for c in ("word", "cls", "info"))
            begin = run_starts(words)
            one = np.zeros(len(words), bool)
            one[begin] = True
            of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(words))))
            data, off = W.buffers(table.column("context"))
            packed, ends = W.unpack(data[off[0]:off[-1]])
            n_of = np.diff(np.searchsorted(ends, off - off[0], "right"))
            key, (n,), _ = _summed(np.repeat(of, n_of) * codes + packed % codes, packed // codes)
            new = best_classes(key // codes, key % codes, n, cls[begin], totals, n_open)
            columns = [table.column("block"), table.column("word"), table.column("at"), pa.array((info // 2 % N_SHAPES).astype(np.int32)), pa.array(info // 2 // N_SHAPES),
                       pa.array(one), pa.array(new[of].astype(np.int32)), pa.array(np.zeros(len(words), bool))]
            yield from pa.Table.from_arrays(columns, [x.split()[0] for x in _CLASSED.split(", ")]).to_batches()
    return run


def _class_pairs(n_classes: int):
    def run(docs: pa.Table, classed: pa.Table) -> pa.Table:
        classed, texts = _numbered(docs, classed)
        cls = classed.column("cls").to_numpy().astype(np.int64)
        total = np.zeros(n_classes * n_classes, np.int64)
        for at, rows in texts:
            key, n = np.unique(_before(cls[at], rows) * n_classes + cls[at], return_counts=True)
            total[key] += n
        key = np.flatnonzero(total)
        return pa.Table.from_arrays([pa.array(key), pa.array(total[key])], ["pair", "n"])
    return run


def _totals(pairs: DataFrame, n_classes: int) -> np.ndarray:
    """Class bigram counts, at most ``n_classes`` squared rows."""
    rows = pairs.groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(n_classes * n_classes)
    out[rows["pair"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out.reshape(n_classes, n_classes)


def cluster(docs: DataFrame, texts: DataFrame, known: DataFrame, clustered: int = CLUSTERED, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, int]:
    """The words of ``known`` with the class of each, the class bigram counts, and the number of open classes.

    Class 0 is begin, 1 end, 2 to n_open + 1 hold the training words, those above are shapes of words not in training.
    """
    train = texts.where("not held_out").select("block", "codes")
    best = known.where(f"one and count > 0 and word != {int(END)}").orderBy(F.desc("count"), "word").limit(clustered).select("word").toPandas()["word"].to_numpy(np.int64)
    first = 2 + N_SHAPES
    top = best.view(np.uint64)
    symbol = first + np.arange(len(top))
    order = np.argsort(top)
    top, symbol = top[order], symbol[order]
    n_symbols = first + len(top)
    pairs = (docs.where("not held_out").select("text").mapInArrow(_count_pairs(top, symbol, n_symbols), "pair long, n long")
             .groupBy("pair").agg(F.sum("n").alias("n")).toPandas())  # at most n_symbols squared rows
    pair, n = pairs["pair"].to_numpy(np.int64), pairs["n"].to_numpy(np.int64)
    class_of = exchange(pair, n, n_symbols, first, classes)
    n_open = int(class_of.max()) + 1 - first
    n_classes = 2 + n_open + N_SHAPES
    class_of = np.where(class_of < 2, class_of, np.where(class_of < first, class_of + n_open, class_of - N_SHAPES))
    totals = np.zeros((n_classes, n_classes))
    np.add.at(totals, (class_of[pair // n_symbols], class_of[pair % n_symbols]), n)
    classed = known.mapInArrow(_with_seed(top, class_of[symbol], n_open), _CLASSED)
    if not n_open:
        return classed, totals, 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    before = known
    for _ in range(rounds):
        sent = classed.selectExpr("block", "word", "at", "cls", _INFO)
        contexts = train.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(_contexts(n_classes), f"{_SENT}, context binary")
        moved = contexts.repartition(parts, "word").sortWithinPartitions("word").mapInArrow(_move(totals, n_open), _CLASSED)
        classed = stage(moved.unionByName(classed.where("fixed or count = 0")), "classes")
        # Each sweep deals the coded texts; what the one before left behind goes before the next one deals them again.
        discard(before)
        before = classed
        del contexts, moved, sent
        release(docs.sparkSession)
        found = train.groupBy("block").cogroup(classed.select("block", "at", "cls").groupBy("block")).applyInArrow(_class_pairs(n_classes), "pair long, n long")
        totals = _totals(found, n_classes)
        del found
        release(docs.sparkSession)
    return classed, totals, n_open


def fit(classed: DataFrame, table: np.ndarray, n_open: int) -> Model:
    """The model of the class bigram counts ``table`` and the classed words."""
    if n_open:  # all training words are in open classes
        table = table[:2 + n_open, :2 + n_open]
    n_classes = len(table)
    left, count = table.sum(1), table.sum(0)
    total = float(count.sum())
    base = (count + 0.5) / (total + 0.5 * n_classes)
    followers = (table > 0).sum(1)
    weight = np.where(left > 0, left / np.maximum(left + followers, 1), 0.0)
    nxt = weight[:, None] * table / np.maximum(left, 1)[:, None] + (1 - weight)[:, None] * base
    # Training words by shape and class: one row a word.
    once = classed.where("one and count > 0")
    kinds = once.groupBy("shape", "cls").agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("total")).toPandas()
    shape, cls, n = (kinds[c].to_numpy(np.int64) for c in ("shape", "cls", "n"))
    types = np.zeros(n_classes)
    np.add.at(types, cls, n)
    by_shape = np.zeros((N_SHAPES, n_classes))
    np.add.at(by_shape, (shape, cls), n)
    by_shape[:, :2] = 0
    by_shape = np.where(by_shape.any(1)[:, None], by_shape, by_shape.sum(0))
    shape_class = (nxt[:, None] * by_shape).argmax(2) if n_open else np.tile(2 + np.arange(N_SHAPES), (n_classes, 1))
    return Model(n_open, shape_class, np.log10(nxt), np.log10(count + 0.5 * (types + 1)), int(kinds["total"].sum()), int(n.sum()))


def _score(sent, id_type: pa.DataType):
    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        model: Model = sent.value
        docs = docs.combine_chunks()
        known, texts = _numbered(docs, known)
        count, cls_of = known.column("count").to_numpy(), known.column("cls").to_numpy().astype(np.int64)
        shapes_from, by_shape = 2 + model.n_open, model.shape_class.tolist()
        base_all = np.log10(model.total + 0.5 * (model.distinct + 1))
        n_tokens, n_known, base, score = [], [], [], []
        for at, rows in texts:
            c, cls = count[at], cls_of[at]
            start = np.zeros(len(cls), bool)
            start[rows[:-1]] = True
            for i in np.flatnonzero(cls >= shapes_from).tolist():  # in order, as the class before may be one of these
                cls[i] = by_shape[0 if start[i] else cls[i - 1]][cls[i] - shapes_from]
            log_c = np.log10(c + 0.5)
            model_log = model.log_next[_before(cls, rows), cls] + log_c - model.log_all[cls]
            begin = rows[:-1]
            n_tokens.append(np.diff(rows))
            n_known.append(np.add.reduceat((c > 0).astype(np.int64), begin))
            base.append(np.add.reduceat(log_c - base_all, begin))
            score.append(np.add.reduceat(model_log, begin))
        join = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
        return pa.Table.from_arrays([docs.column("id").cast(id_type), docs.column("held_out"), join(n_tokens, pa.int64()), join(n_known, pa.int64()),
                                     pa.array(np.full(docs.num_rows, model.total), pa.int64()), join(base, pa.float64()), join(score, pa.float64())],
                                    ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def class_lm(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", clustered: int = CLUSTERED, classes: int = CLASSES,
             blocks: int | None = None) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score (unigram) and score (class bigrams)."""
    narrow = pick(docs, id=id_col, text=text_col)
    name = F.coalesce(F.col("id").cast("string"), F.lit(""))
    blocks = blocks or block_count(narrow, nbytes=TEXT_BYTES)
    dealt = narrow.select("id", F.col("text").cast("string").alias("text"), (F.crc32(name.cast("binary")) % FOLDS == HELD_OUT).alias("held_out"),
                          F.pmod(F.xxhash64(name, F.col("text")), F.lit(blocks)).cast("int").alias("block"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(narrow.dtypes)["id"]
    numbered = stage(dealt.groupBy("block").applyInArrow(_number, f"block int, id {kind}, held_out boolean, codes binary, word long, at int, shape int, n long"), "numbered")
    release(docs.sparkSession)
    texts = numbered.where("codes is not null").select("block", "id", "held_out", "codes")
    counted = numbered.where("word is not null").select("block", "word", "at", "shape", "n")
    known = stage(counted.repartition(parts, "word").sortWithinPartitions("word").mapInArrow(_sum_words, _KNOWN), "vocabulary")
    release(docs.sparkSession)
    classed, totals, n_open = cluster(dealt, texts, known, clustered, classes)
    model = fit(classed, totals, n_open)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    from pyspark.sql.pandas.types import to_arrow_type

    out = texts.groupBy("block").cogroup(classed.select("block", "at", "count", "cls").groupBy("block")).applyInArrow(
        _score(sent, to_arrow_type(narrow.schema["id"].dataType)),
        f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
