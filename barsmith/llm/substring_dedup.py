"""Substring dedup with repeated-phrase automata, one for each block of documents.

A word goes if it lies in a window of ``WINDOW`` words whose words also start
earlier: in a document with a smaller id, or before in the same document.

1. Confirm what recurs. Of the phrases of ``PHRASE`` words in a window, the one with
   the smallest hash is the window's phrase; equal windows have equal phrases, and
   neighbouring windows mostly share theirs, so about one position in seven is a
   phrase. Phrases are counted per block of documents and then over all blocks;
   each block learns which of its phrases occur twice or more anywhere.
2. Compile and stream. One set of automata for all documents would have every
   document read by every shard, which grows with the square of the corpus. Here
   the shard is a block of documents: its automaton (pyahocorasick) holds the
   recurring phrases that the block has, and the block's documents stream through
   it once. It yields every place of a recurring phrase, and so the windows to judge.
3. Judge. Of equal windows in a block only the first is sent on; the others are
   repeats already, which is also the pre-aggregation: a window that a third of all
   documents hold is sent once a block. Windows meet by phrase, a phrase's windows
   packed in one row; those of a phrase that more than ``BUSY`` places hold are sent
   one by one under a key of their own, so that no key gathers the many contexts of
   a common line. The first of equal windows by (id, place) stays.
4. Cut. Verdicts go back to the block of their document.

Windows that share a phrase are compared by 64 bits of their own words.

Ids must be integers. Results for odd input: a null text has no words; a null id
comes before all others; rows that share an id are taken as successive parts of one
document in the order of their texts, so of repeated rows the later ones go whole.
Texts of under ``WINDOW`` words have no window and are kept. Extra columns pass
through ``dedup_documents`` untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barsmith.llm import words as W
from barsmith.llm.frames import block_count, complete_runs, pick, run_starts, stage, with_block

WINDOW, PHRASE = 20, 8
#: Places of a phrase from which on its windows travel one by one.
BUSY = 5000
#: Bytes of text in a block, which one task judges.
TEXT_BYTES = 4 << 20
_SPAN = WINDOW - PHRASE + 1  # phrases in a window, and most windows of one place of a phrase
_NO_ID = -(1 << 63)
_PART = 40  # bits of a word's number; above them the number of the row among those of its id


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of every ``width`` consecutive values, the leftmost of equals."""
    at, have = np.arange(len(v)), 1
    v = v.copy()
    while have < width:
        step = min(have, width - have)
        if len(v) <= step:
            return np.zeros(0, np.int64)
        right = v[step:] < v[:-step]
        at = np.where(right, at[step:], at[:-step])
        v = np.where(right, v[step:], v[:-step])
        have += step
    return at


class _Windows:
    """Windows of the rows in a slice: row, first word, place and value of the phrase, hash of the window."""

    def __init__(self, words: W.Words):
        self.words = words
        every = W.rolling(words.hash, WINDOW)
        if not len(every):
            none = np.zeros(0, np.int64)
            self.at, self.place, self.row = none, none, none
            self.phrase, self.hash = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            return
        phrases = W.rolling(words.hash, PHRASE)
        place = _least(phrases, _SPAN)
        row = words.row_of()[:len(every)]
        ok = np.arange(len(every)) + WINDOW <= words.rows[1:][row]
        self.at = np.flatnonzero(ok)
        self.row, self.place, self.hash = row[ok], place[ok], every[ok]
        self.phrase = phrases[self.place]


def _count_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(phrase, block, n): how many places of each block's rows have the phrase."""
    values, blocks = [], []
    for batch in batches:
        data, offsets = W.buffers(batch.column(0))
        block = batch.column(1).to_numpy()
        for i, j in W.slices(offsets):
            found = _Windows(W.find(data, offsets[i:j + 1]))
            new = np.ones(len(found.place), bool)
            new[1:] = found.place[1:] != found.place[:-1]
            values.append(found.phrase[new])
            blocks.append(block[i:j][found.row[new]])
    if not values:
        return
    value, block = np.concatenate(values), np.concatenate(blocks)
    order = np.lexsort((value, block))
    value, block = value[order], block[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (block[1:] != block[:-1])
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(value)))
    for at in range(0, len(begin), 100_000):
        part = begin[at:at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(value[part].view(np.int64)), pa.array(block[part]), pa.array(n[at:at + 100_000])], ["phrase", "block", "n"])


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by phrase: those of phrases with two places or more, marked if they have over BUSY."""
    for table in complete_runs(batches, "phrase"):
        phrase, n = table.column("phrase").to_numpy(), table.column("n").to_numpy()
        begin = run_starts(phrase)
        total = np.repeat(np.add.reduceat(n, begin), np.diff(np.append(begin, len(n))))
        keep = total > 1
        yield pa.RecordBatch.from_arrays([pa.array(table.column("block").to_numpy()[keep]), pa.array(phrase[keep]), pa.array(total[keep] > BUSY)],
                                         ["block", "phrase", "busy"])


def _ordered(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A block's rows by (id, text), their ids, and each row's number among those of its id."""
    table = table.set_column(table.schema.get_field_index("_id"), "_id", pc.fill_null(table.column("_id"), _NO_ID))
    table = table.take(pc.sort_indices(table, [("_id", "ascending"), ("_text", "ascending")])).combine_chunks()
    ids = table.column("_id").to_numpy()
    begin = run_starts(ids)
    part = np.arange(len(ids)) - np.repeat(begin, np.diff(np.append(begin, len(ids))))
    return table, ids, part


def _automaton(phrases: list[bytes]):
    import ahocorasick

    found = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for p in phrases:
        found.add_word(p.decode("latin-1"))
    found.make_automaton()
    return found


def _places(automaton, raw: bytes, n_words: int) -> np.ndarray:
    """Numbers of the words at which a phrase of the automaton begins."""
    plain = b" " + b" ".join(raw.split()) + b" "
    hits = np.fromiter((e - size + 1 for e, size in automaton.iter(plain.decode("latin-1"))), np.int64)
    if not len(hits):
        return hits
    number = np.cumsum(np.frombuffer(plain, np.uint8) == 32) - 1
    return number[hits]


def _judge_block(docs: pa.Table, known: pa.Table) -> pa.Table:
    """Windows of a block for the judgement: (block, key, id, start, mask, windows); rows without windows are repeats."""
    schema = pa.schema([("block", pa.int32()), ("key", pa.int64()), ("id", pa.int64()), ("start", pa.int64()), ("mask", pa.int32()), ("windows", pa.binary())])
    if not docs.num_rows or not known.num_rows:
        return schema.empty_table()
    block = docs.column("block")[0].as_py()
    docs, ids, part = _ordered(docs)
    recurring = known.column("phrase").to_numpy().view(np.uint64)
    order = np.argsort(recurring)
    recurring, busy = recurring[order], known.column("busy").to_numpy(zero_copy_only=False)[order]
    data, offsets = W.buffers(docs.column("_text"))
    parts = list(W.slices(offsets))
    # The block's recurring phrases as text.
    phrases: dict[int, bytes] = {}
    for i, j in parts:
        words = W.find(data, offsets[i:j + 1])
        found = _Windows(words)
        place, first = np.unique(found.place, return_index=True)
        value = found.phrase[first]
        hit = recurring[np.minimum(np.searchsorted(recurring, value), len(recurring) - 1)] == value
        value, first = np.unique(value[hit], return_index=True)
        for v, at in zip(value.tolist(), place[hit][first].tolist(), strict=True):
            if v not in phrases:
                phrases[v] = b" " + b" ".join(data[words.start[at]:words.end[at + PHRASE - 1]].tobytes().split()) + b" "
    automaton = _automaton(list(phrases.values()))
    del phrases
    rows, starts, places, values, hashes = [], [], [], [], []
    for i, j in parts:
        words = W.find(data, offsets[i:j + 1])
        found = _Windows(words)
        located = np.zeros(len(words.hash) + 1, bool)
        counts = words.counts
        for r in range(i, j):
            n = int(counts[r - i])
            if n >= WINDOW:
                located[words.rows[r - i] + _places(automaton, data[offsets[r]:offsets[r + 1]].tobytes(), n)] = True
        ok = located[found.place]
        row = found.row[ok]
        rows.append(row + i)
        starts.append(found.at[ok] - words.rows[row])
        places.append(found.place[ok] - words.rows[row])
        values.append(found.phrase[ok])
        hashes.append(found.hash[ok])
    del automaton
    row, start, place, value, hash_ = (np.concatenate(x) for x in (rows, starts, places, values, hashes))
    # Rows are in order, so the stable sort leaves the earliest of equal windows first.
    order = np.lexsort((hash_, value))
    new = np.ones(len(order), bool)
    new[1:] = (value[order][1:] != value[order][:-1]) | (hash_[order][1:] != hash_[order][:-1])
    first = np.zeros(len(order), bool)
    first[order[new]] = True
    at = np.minimum(np.searchsorted(recurring, value), len(recurring) - 1)
    single = first & busy[at]

    def packed(mine: np.ndarray, key: np.ndarray | None, alone: bool) -> pa.Table:
        r, s, p = row[mine], start[mine], place[mine]
        begin = np.ones(len(r), bool)
        if not alone:
            begin[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1])
        begin = np.flatnonzero(begin)
        if not len(begin):
            return schema.empty_table()
        group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(r))))
        mask = np.add.reduceat(np.int64(1) << (s - s[begin][group]), begin)
        r0 = r[begin]
        begins = (part[r0].astype(np.int64) << _PART) + s[begin]
        if key is None:  # known repeats: any spread will do
            key = W.mix(ids[r0].view(np.uint64) + begins.view(np.uint64))
            sent = pa.array([b""] * len(begin), pa.binary())
        else:
            key = key[mine][begin]
            ends = pa.array((np.append(begin, len(r)) * 8).astype(np.int32))
            sent = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, ends.buffers()[1], pa.py_buffer(hash_[mine].tobytes())])
        return pa.Table.from_arrays([pa.array(np.full(len(begin), block, np.int32)), pa.array(key.view(np.int64)), pa.array(ids[r0]), pa.array(begins),
                                     pa.array(mask.astype(np.int32)), sent], schema=schema)

    return pa.concat_tables([packed(first & ~single, value, False), packed(single, W.mix(value ^ W.mix(hash_)), True), packed(~first, None, False)])


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key to the windows that repeat an earlier one: (block, id, start, mask)."""
    for table in complete_runs(batches, "key"):
        table = table.combine_chunks()
        block, key, ids, start, mask = (table.column(c).to_numpy() for c in ("block", "key", "id", "start", "mask"))
        data, off = W.buffers(table.column("windows"))
        row, bit = np.nonzero((mask[:, None] >> np.arange(_SPAN)) & 1)
        sent = np.diff(off) > 0
        out = np.where(sent, 0, mask).astype(np.int64)
        live = sent[row]
        row, bit = row[live], bit[live]
        windows = np.frombuffer(data[off[0]:off[-1]].tobytes(), np.uint64)
        order = np.lexsort((start[row] + bit, ids[row], windows, key[row]))
        k, w = key[row][order], windows[order]
        again = np.zeros(len(order), bool)
        again[1:] = (k[1:] == k[:-1]) & (w[1:] == w[:-1])
        gone = order[again]
        np.add.at(out, row[gone], np.int64(1) << bit[gone])
        keep = out > 0
        yield pa.RecordBatch.from_arrays([pa.array(block[keep]), pa.array(ids[keep]), pa.array(start[keep]), pa.array(out[keep].astype(np.int32))],
                                         ["block", "id", "start", "mask"])


def _removed(docs: pa.Table, gone: pa.Table) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, text, starts and ends of its words, mask of the removed words) of an ordered block's rows."""
    docs, ids, part = docs
    row = np.searchsorted(ids, gone.column("id").to_numpy()) + (gone.column("start").to_numpy() >> _PART)
    start, mask = gone.column("start").to_numpy() & ((1 << _PART) - 1), gone.column("mask").to_numpy()
    at, bit = np.nonzero((mask[:, None] >> np.arange(_SPAN)) & 1)
    row, start = row[at], start[at] + bit
    order = np.argsort(row, kind="stable")
    row, start = row[order], start[order]
    data, offsets = W.buffers(docs.column("_text"))
    for i, j in W.slices(offsets):
        words = W.find(data, offsets[i:j + 1])
        edge = np.zeros(len(words.hash) + 1, np.int64)
        a, b = np.searchsorted(row, [i, j])
        begin = words.rows[row[a:b] - i] + start[a:b]
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + WINDOW, -1)
        covered = np.cumsum(edge)[:-1] > 0
        for r in range(i, j):
            s, e = words.rows[r - i], words.rows[r - i + 1]
            yield r, data[offsets[r]:offsets[r + 1]].tobytes(), words.start[s:e] - offsets[r], words.end[s:e] - offsets[r], covered[s:e]


def _dealt(docs: DataFrame, id_col: str, text_col: str, blocks: int | None, whole: bool) -> DataFrame:
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key, text = (plain[f"c{names.index(c)}"] for c in (id_col, text_col))
    narrow = plain.select(key.cast("long").alias("_id"), text.cast("string").alias("_text"), *(plain.columns if whole else ()))
    return with_block(narrow, "_id", blocks or block_count(narrow, "_text", TEXT_BYTES))


def _repeats(dealt: DataFrame) -> DataFrame:
    """Windows to remove: (block, id, start, mask), start being the row's number among its id's and the window's first word."""
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = dealt.select("_id", "_text", "block")
    phrases = texts.repartition("block").select("_text", "block").mapInArrow(_count_phrases, "phrase long, block int, n long")
    known = stage(phrases.repartition(parts, "phrase").sortWithinPartitions("phrase").mapInArrow(_recurring, "block int, phrase long, busy boolean"), "phrases")
    windows = texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        _judge_block, "block int, key long, id long, start long, mask int, windows binary")
    return (windows.repartition(parts, "key").sortWithinPartitions("key")
            .mapInArrow(_judge, "block int, id long, start long, mask int"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256 (of the kept words joined by spaces) and ``kept``, those words."""
    dealt = _dealt(docs, id_col, text_col, blocks, whole=False)

    def cut(docs: pa.Table, gone: pa.Table) -> pa.Table:
        block = _ordered(docs)
        rows = []
        for _, raw, start, _, covered in _removed(block, gone):
            kept = b" ".join([w for w, c in zip(raw.split(), covered.tolist(), strict=True) if not c]) if covered.any() else b" ".join(raw.split())
            rows.append((len(start), int(covered.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
        n, removed, sha, kept = zip(*rows, strict=True) if rows else ((), (), (), ())
        ids = block[1]
        return pa.Table.from_arrays([pa.array(ids, mask=ids == _NO_ID), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()),
                                     pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept_sha256", "kept"])

    out = dealt.groupBy("block").cogroup(_repeats(dealt).groupBy("block")).applyInArrow(
        cut, "id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_words", "n_removed", "kept_sha256", "kept")


def dedup_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars",
                    blocks: int | None = None) -> DataFrame:
    """The rows of ``docs`` with repeated windows cut out of the text.

    What stays keeps its own white space. A row that had words and keeps none goes. ``length_col``, where ``docs`` has
    it, becomes the text's new length in code points for the rows that were cut.
    """
    names = docs.columns
    dealt = _dealt(docs, id_col, text_col, blocks, whole=True)
    fields = [T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(docs.schema)]
    text_at, length_at = names.index(text_col), names.index(length_col) if length_col in names else None

    def cut(docs: pa.Table, gone: pa.Table) -> pa.Table:
        block = _ordered(docs)
        table = block[0].drop_columns(["_id", "_text", "block"])
        if not gone.num_rows:
            return table
        texts, lengths, keep = [], [], np.ones(table.num_rows, bool)
        changed = np.zeros(table.num_rows, bool)
        for r, raw, start, end, covered in _removed(block, gone):
            if covered.any():
                changed[r], keep[r] = True, not covered.all()
                edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
                out, at = [], 0
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):  # from the first removed word to the next kept one
                    out.append(raw[at:int(start[a])])
                    at = int(start[b]) if b < len(start) else len(raw)
                raw = b"".join([*out, raw[at:]])
            texts.append(raw.decode())
            lengths.append(len(texts[-1]))
        change = pa.array(changed)
        old = table.column(text_at)
        table = table.set_column(text_at, table.schema.field(text_at), pc.if_else(change, pa.array(texts, old.type), old))
        if length_at is not None:
            old = table.column(length_at)
            table = table.set_column(length_at, table.schema.field(length_at), pc.if_else(change, pa.array(lengths).cast(old.type), old))
        return table.filter(pa.array(keep))

    out = dealt.groupBy("block").cogroup(_repeats(dealt).groupBy("block")).applyInArrow(cut, T.StructType(fields))
    return out.toDF(*names)
