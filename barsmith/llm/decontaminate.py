"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Normalising lower-cases A-Z and keeps words of letters, digits and all bytes from
0x80 on, joined by single spaces. Every window of ten consecutive item words is a
pattern (an item of fewer words is one pattern); the automaton holds the distinct
patterns of all items with the items each belongs to. Each document is normalised
and scanned once; matches are turned into word numbers and, for the documents that
have any, into places in the original text.

The automaton is built in every Python worker from the broadcast patterns. Their
size is measured first: up to ``PATTERN_BYTES`` there is one automaton and one scan.
A larger benchmark is dealt by a hash of the pattern to several automata of at most
about that size; the documents are scanned by one after the other, with the hits
so far carried along in a staged table, so no task ever holds two.

Results for odd input: null and empty texts have no words and no hits; an item
without words is never found; a null item id counts as the empty string; items
that repeat an id count once. Every document row is scanned by itself.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.llm import words as W
from barsmith.llm.frames import pick, stage

WINDOW = 10
#: Most bytes of pattern text in one automaton (and in one broadcast).
PATTERN_BYTES = 32 << 20
#: Bytes that part words: ASCII but for letters and digits.
BREAK = np.zeros(256, bool)
BREAK[:0x80] = True
BREAK[0x30:0x3A] = BREAK[0x41:0x5B] = BREAK[0x61:0x7B] = False
_NORMAL = bytes(32 if BREAK[b] else b + 32 if 65 <= b < 91 else b for b in range(256))
_SCANNED = "id {kind}, text string, n_words long, begins array<int>, ends array<int>, items array<string>"


def normal_words(text: str) -> list[bytes]:
    return text.encode().translate(_NORMAL).split()


def item_patterns(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct patterns: (pattern binary, n_words, items array<string>)."""
    narrow = pick(benchmark, item=item_col, text=text_col)
    narrow = narrow.select(F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ws = normal_words(text or "")
                k = min(window, len(ws))
                rows += [(b" ".join(ws[i:i + k]), k, item) for i in range(len(ws) - k + 1)] if k else []
            for at in range(0, len(rows), 10_000):
                p, k, item = zip(*rows[at:at + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.binary()), pa.array(k, pa.int32()), pa.array(item)], ["pattern", "n_words", "item"])

    return (narrow.mapInArrow(cut, "pattern binary, n_words int, item string")
            .groupBy("pattern", "n_words").agg(F.collect_set("item").alias("items")))


@functools.lru_cache(maxsize=1)
def _automaton(key: str, patterns: Broadcast):
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, (pattern, n, _) in enumerate(patterns.value):
        found.add_word(f" {pattern.decode('latin-1')} ", (i, n, len(pattern) + 2))
    found.make_automaton()
    return found


def _scan(patterns: Broadcast, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _automaton(key, patterns) if patterns.value else None
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                part = whole.slice(at, 1024)
                counts, begins, ends, items = [], [], [], []
                had = zip(*(part.column(i).to_pylist() for i in (1, 3, 4, 5)), strict=True)
                for text, begin, end, item in had:
                    ws = normal_words(text or "")
                    plain = b" " + b" ".join(ws) + b" "
                    hits = list(found.iter(plain.decode("latin-1"))) if found and ws else ()
                    counts.append(len(ws))
                    if hits:
                        spaces = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
                        first = np.searchsorted(spaces, [e - size + 1 for e, (_, _, size) in hits])
                        begin = [*begin, *first.tolist()]
                        end = [*end, *(int(f) + n for f, (_, (_, n, _)) in zip(first, hits, strict=True))]
                        item = sorted({*item, *(x for _, (i, _, _) in hits for x in patterns.value[i][2])})
                    begins.append(begin)
                    ends.append(end)
                    items.append(item)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array(begins, pa.list_(pa.int32())),
                                                  pa.array(ends, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                                                 ["id", "text", "n_words", "begins", "ends", "items"])
    return run


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """Per document: id, text, n_words and the word ranges (begins, ends) and items of all matches."""
    spark = docs.sparkSession
    patterns = stage(item_patterns(benchmark, window=window), "patterns")
    size = patterns.agg(F.sum(F.length("pattern") + 2)).first()[0] or 0
    parts = max(1, -(-size // pattern_bytes))
    narrow = pick(docs, id=id_col, text=text_col)
    schema = _SCANNED.format(kind=dict(narrow.dtypes)["id"])
    out = narrow.select("id", F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"),
                        *(F.array().cast("array<int>").alias(c) for c in ("begins", "ends")), F.array().cast("array<string>").alias("items"))
    for part in range(parts):
        mine = patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == part)
        rows = [(bytes(r.pattern), r.n_words, r["items"]) for r in mine.collect()]  # at most about pattern_bytes
        sent = spark.sparkContext.broadcast(rows)
        out = out.mapInArrow(_scan(sent, f"{spark.sparkContext.applicationId}-{sent._jbroadcast.id() if sent._jbroadcast else id(sent)}"), schema)
        if part + 1 < parts:
            out = stage(out, "scanned")
    return out


def _covered(begins: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """The ranges joined where they overlap or touch."""
    out: list[list[int]] = []
    for b, e in sorted(zip(begins, ends, strict=True)):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [(b, e) for b, e in out]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items (sorted), items_sha256, contaminated and ``spans``.

    ``spans`` are the places of the hit words in the original text, in code points.
    """
    found = scan(docs, benchmark, id_col, text_col, **options)
    schema = (f"id {dict(found.dtypes)['id']}, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, "
              "contaminated boolean, spans array<struct<begin:int,end:int>>")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            hit, shas, spans = [], [], []
            items = batch.column(5).to_pylist()
            for text, begins, ends, item in zip(*(batch.column(i).to_pylist() for i in (1, 3, 4)), items, strict=True):
                ranges = _covered(begins, ends)
                hit.append(sum(e - b for b, e in ranges))
                shas.append(hashlib.sha256(",".join(sorted(item)).encode()).hexdigest())
                if ranges:
                    raw = text.encode()
                    at = W.find(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), sep=BREAK)
                    chars = lambda n: len(raw[:n].decode())  # noqa: B023, E731
                    spans.append([{"begin": chars(int(at.start[b])), "end": chars(int(at.end[e - 1]))} for b, e in ranges])
                else:
                    spans.append([])
            n_items = [len(x) for x in items]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(hit, pa.int64()), pa.array(n_items, pa.int64()),
                                              batch.column(5), pa.array(shas), pa.array([h > 0 for h in hit]), pa.array(spans, spans_type)],
                                             ["id", "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated", "spans"])

    return found.mapInArrow(digest, schema).withColumnRenamed("id", id_col)


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options: int) -> DataFrame:
    """The rows of ``docs`` without any hit, with all their columns, without a shuffle."""
    names = docs.columns
    whole = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = f"c{names.index(text_col)}"
    packed = whole.select(F.struct(*whole.columns).alias("row"), whole[at].alias("text"))
    found = scan(packed, benchmark, "row", "text", **options)
    return found.where(F.size("begins") == 0).select(*[F.col(f"id.c{i}").alias(n) for i, n in enumerate(names)])
