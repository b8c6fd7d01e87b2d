"""Byte-level BPE encoding and decoding, its merges folded by Spark's higher-order functions.

A text is parted into pieces by the vocabulary's pattern. A piece starts as the ids
of its bytes; higher-order functions fold merges over it: each step takes the
adjacent pair whose joined bytes have the lowest rank, the leftmost of equals, until
no pair has a rank. The ranks of all pairs are one literal, an array of small maps
indexed by a hash of the pair, so that a look-up reads one or two entries. Beside
each id the fold carries the rank of its pair with the next id; a merge changes two
of them. The literal reaches the tasks as a scalar subquery with one row, used
through one reference only (``let``), so that the optimiser merges it into the
projection and never writes it into a row.

Words repeat, so distinct words are folded: pieces are counted over all texts, and
the ``WORDS`` most frequent (of at most ``WORD_BYTES`` bytes, which bounds the table)
are folded once and broadcast. The pass over the texts then looks pieces up. It is
Python over Arrow batches: as one native expression, look-ups and folds of the rare
pieces in place took several times the processor time (README). Rare pieces, a few in
a hundred, are merged there by the same rule with a heap, so a piece of any length
takes n log n steps. Decoding joins the bytes of each id.

Results for odd input: null and empty texts have no ids; every row stands for
itself, whatever its id; extra columns are not touched.
"""

from __future__ import annotations

import array
import base64
import functools
import hashlib
import heapq
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.llm.frames import most_frequent, pick, stage

#: Frequent words whose ids are looked up, and the most bytes of such a word.
WORDS, WORD_BYTES = 1 << 17, 64
#: Entries of a task's memos of chunks and of pieces (about 200 bytes each); a full memo is emptied.
CHUNKS, PIECES = 400_000, 200_000
#: Bytes of a piece up to which plain lists beat a heap.
SHORT = 48
_PAIRS, _SINGLES = 131071, 1021
_SHIFT = 1 << 20
_NONE = 2**31 - 1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _maps(bucket: np.ndarray, keys: pa.Array, values: pa.Array, size: int) -> pa.Array:
    """An array of maps: entry i maps the keys of bucket i."""
    order = np.argsort(bucket, kind="stable")
    offsets = np.searchsorted(bucket[order], np.arange(size + 1)).astype(np.int32)
    maps = pa.MapArray.from_arrays(pa.array(offsets), keys.take(pa.array(order)), values.take(pa.array(order)))
    return pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), maps)


def _hashes(spark: SparkSession, values: list[bytes], size: int) -> np.ndarray:
    """Spark's own hash of some values, for tables that its expressions look up."""
    table = pa.table({"i": pa.array(range(len(values)), pa.int32()), "v": pa.array(values, pa.binary())})
    got = spark.createDataFrame(table).select("i", F.pmod(F.xxhash64("v"), F.lit(size)).cast("int").alias("h")).toPandas()
    out = np.empty(len(values), np.int64)
    out[got["i"].to_numpy()] = got["h"].to_numpy()
    return out


class Vocabulary:
    """The literal tables of a rank file, ids of bytes and ranks of pairs, for Spark's expressions."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        ranks = read_ranks(path)
        self.spark, self.pattern = spark, "(?U)" + pattern
        a, b, rank = [], [], []
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    a.append(left)
                    b.append(right)
                    rank.append(i)
        key = np.array(a, np.int64) * _SHIFT + np.array(b, np.int64)
        single = [bytes([x]) for x in range(256)]
        self.columns = {
            "singles": _maps(_hashes(spark, single, _SINGLES), pa.array(single, pa.binary()), pa.array([ranks[s] for s in single], pa.int32()), _SINGLES),
            "pairs": _maps(key % _PAIRS, pa.array(key), pa.array(rank, pa.int32()), _PAIRS),
        }

    def over(self, df: DataFrame, keep: list[str], body: Callable[[Column], Column], name: str) -> DataFrame:
        """Columns ``keep`` of ``df`` and ``name``: ``body`` of a struct that holds the tables.

        What ``body`` reads and ``keep`` names must be plain columns: a computed column
        used in both places would keep the optimiser from merging the two projections.
        """
        table = pa.table(self.columns)
        packed = self.spark.createDataFrame(table).select(F.struct(*table.column_names).alias("tables"))
        return df.withColumn("_tables", packed.scalar()).select(*keep, let(F.col("_tables"), body).alias(name))

    def pieces(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(self.pattern), F.lit(0))

    def fold(self, word: Column, tables: Column) -> Column:
        """Ids of one piece (binary) by folding merges over its bytes."""
        def rank(a: Column, b: Column) -> Column:
            key = a.cast("long") * F.lit(_SHIFT) + b
            return let(key, lambda k: F.coalesce(F.get(tables["pairs"], F.pmod(k, F.lit(_PAIRS)).cast("int"))[k], F.lit(_NONE)))

        def byte(i: Column) -> Column:
            return let(F.substring(word, i, 1), lambda x: F.get(tables["singles"], F.pmod(F.xxhash64(x), F.lit(_SINGLES)).cast("int"))[x])

        def merge(ids: Column, ranks: Column, low: Column, at: Column) -> Column:
            """The pair at ``at`` (from 1) of rank ``low`` becomes one id; its neighbours' ranks are new."""
            n = F.size(ids)
            left = F.when(at > 1, F.concat(F.slice(ranks, F.lit(1), at - 2), F.array(rank(F.get(ids, at - 2), low)))).otherwise(F.array().cast("array<int>"))
            right = F.when(at + 1 < n, F.concat(F.array(rank(low, F.get(ids, at + 1))), F.slice(ranks, at + 2, n))).otherwise(F.array().cast("array<int>"))
            return F.struct(F.concat(F.slice(ids, F.lit(1), at - 1), F.array(low), F.slice(ids, at + 2, n)).alias("ids"), F.concat(left, right).alias("ranks"))

        def step(state: Column, _: Column) -> Column:
            return let(F.array_min(state["ranks"]), lambda low: F.when(low == _NONE, state).otherwise(
                merge(state["ids"], state["ranks"], low, F.array_position(state["ranks"], low).cast("int"))))

        def start(ids: Column) -> Column:
            near = F.transform(F.sequence(F.lit(1), F.size(ids) - 1), lambda i: rank(F.get(ids, i - 1), F.get(ids, i)))
            return F.struct(ids.alias("ids"), near.alias("ranks"))

        first = F.transform(F.sequence(F.lit(1), F.length(word)), byte)
        return let(first, lambda ids: F.when(F.size(ids) < 2, ids).otherwise(
            F.aggregate(F.sequence(F.lit(2), F.size(ids)), start(ids), step, lambda s: s["ids"])))


def frequent_words(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", words: int = WORDS) -> DataFrame:
    """The most frequent pieces of all texts with their ids: (word string, ids array<int>)."""
    pieces = docs.select(F.explode(vocabulary.pieces(F.col(text))).alias("word"))
    counted = stage(pieces.groupBy("word").count().where(F.octet_length("word") <= WORD_BYTES), "words")
    top = most_frequent(counted, "count", words).select("word")
    spread = top.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")
    return vocabulary.over(spread, ["word"], lambda t: vocabulary.fold(F.col("word").cast("binary"), t), "ids")


class Coder:
    """A task's encoder: the broadcast words, and merges of the pieces that are not among them."""

    def __init__(self, path: str, pattern: str, words: dict[str, bytes]):
        self.ranks = read_ranks(path)
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.bytes_of[i] = token
        self.split = regex.compile(pattern).findall
        self.words = words
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes | None] = {}

    def merge(self, raw: bytes) -> bytes:
        """Ids of a piece: the pair of lowest rank is joined, the leftmost of equals, while any has a rank."""
        ranks, n = self.ranks, len(raw)
        if n <= SHORT:
            few = [raw[i:i + 1] for i in range(n)]
            pairs = [ranks.get(raw[i:i + 2], _NONE) for i in range(n - 1)]
            while pairs and (low := min(pairs)) != _NONE:
                i = pairs.index(low)
                few[i] += few.pop(i + 1)
                del pairs[i]
                if i < len(pairs):
                    pairs[i] = ranks.get(few[i] + few[i + 1], _NONE)
                if i:
                    pairs[i - 1] = ranks.get(few[i - 1] + few[i], _NONE)
            return array.array("I", [ranks[p] for p in few]).tobytes()
        parts: list[bytes | None] = [raw[i:i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(raw[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= n or ranks.get(parts[i] + parts[j]) != rank:
                continue  # one of the two has been merged meanwhile
            parts[i] += parts[j]
            parts[j] = None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                r = ranks.get(parts[i] + parts[after[j]])
                if r is not None:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0:
                r = ranks.get(parts[h] + parts[i])
                if r is not None:
                    heapq.heappush(heap, (r, h))
        return np.array([ranks[p] for p in parts if p is not None], "<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        ids = self.words.get(piece)
        if ids is None:
            ids = self.pieces.get(piece)
            if ids is None:
                if len(self.pieces) > PIECES:
                    self.pieces.clear()
                ids = self.pieces[piece] = self.merge(piece.encode())
        return ids

    def whole(self, text: str) -> bytes:
        return b"".join(map(self.piece, self.split(text)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, put together from chunks at single spaces between other characters, where pieces always part."""
        rows = [t.split(" ") for t in texts]
        if len(self.chunks) > CHUNKS:
            self.chunks.clear()
        memo = self.chunks
        for c in set(itertools.chain.from_iterable(r[1:] for r in rows)).difference(memo):
            memo[c] = self.whole(" " + c) if c and not c[0].isspace() and not c[-1].isspace() else None
        out = []
        for text, row in zip(texts, rows, strict=True):
            if row[0] and not row[0][-1].isspace():
                try:
                    out.append(self.whole(row[0]) + b"".join([memo[c] for c in row[1:]]))
                    continue
                except TypeError:  # white space beside a space
                    pass
            out.append(self.whole(text))
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=1)
def _coder(path: str, pattern: str, key: str, words: Broadcast) -> Coder:
    return Coder(path, pattern, words.value)


def _passed(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, words: int, schema: str, row: Callable[[bytes, bytes], tuple],
            kinds: list[pa.DataType]) -> DataFrame:
    """One row per document: id and ``row(ids, decoded)``."""
    narrow = pick(docs, id=id_col, text=text_col)
    narrow = narrow.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    spark = docs.sparkSession
    # At most ``words`` words of WORD_BYTES bytes, and an id a byte.
    known = frequent_words(narrow, Vocabulary(spark, path, pattern), words=words).toArrow()
    ids = [np.array(x, "<u4").tobytes() for x in known.column("ids").to_pylist()]
    sent = spark.sparkContext.broadcast(dict(zip(known.column("word").to_pylist(), ids, strict=True)))
    key = f"{spark.sparkContext.applicationId}-{sent._jbroadcast.id() if sent._jbroadcast else id(sent)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern, key, sent)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [row(x, coder.decode(x)) for x in coder.encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))],
                                                 ["id", *(f.split()[0] for f in schema.split(", "))])
        coder.chunks.clear()  # the worker lives on in stages that need the memory
        coder.pieces.clear()

    return narrow.mapInArrow(run, f"id {dict(narrow.dtypes)['id']}, {schema}").withColumnRenamed("id", id_col)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Every text encoded and decoded: id, ``n_tokens``, ``ids`` (little-endian 32-bit integers) and ``decoded``, the bytes the ids give back."""
    return _passed(docs, path, pattern, id_col, text_col, words, "n_tokens long, ids binary, decoded binary",
                   lambda ids, decoded: (len(ids) // 4, ids, decoded), [pa.int64(), pa.binary(), pa.binary()])


def byte_bpe(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers) and decoded_sha256."""
    return _passed(docs, path, pattern, id_col, text_col, words, "n_tokens long, ids_sha256 string, decoded_sha256 string",
                   lambda ids, decoded: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()),
                   [pa.int64(), pa.string(), pa.string()])
