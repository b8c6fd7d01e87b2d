"""Compression bands: documents whose zstandard ratio leaves the range of prose are rejected.

The ratio is bytes over compressed bytes. Repetitive text compresses too well,
random or encoded text hardly at all. How well prose compresses depends on its
length, so the limits are given at sizes half an octave apart and interpolated
between them (``Bands``). Two ratios are held against them: that of the text, and
its bytes over the compressed bytes of what is left without its letters. Symbols
strewn among words and digits of hexadecimal blocks move the second one where the
first, on short texts above all, is still that of prose. A document is judged as a
whole and by fixed chunks of ``CHUNK`` bytes, each by the limits of its own size, so
a junk passage shows inside a long clean document; it fails by chunks if more than
``CHUNK_SHARE`` of them leave their limits, one at least.

``CLEAN`` was fitted by ``fit_bands`` on the texts of sf0.1 that are labelled quality 1
and pass the base rules (3,330 rows, a bounded sample: a class of sizes takes at most
four pieces a text); ``op2_compression_bands``, ``measure`` and ``keep_documents`` use it.
``GENERAL`` has the wide limits for texts of unknown kind that ``quality_rules`` takes
if it is given no others. Below the first size only its
upper limits hold.

Before the bands come the base rules: a document of under ``MIN_WORDS`` words, or
in which over 20 % of the words stand in five-word windows that occur again, fails.

Results for odd input: a null text has no words, so it fails the base rules, like
an empty one; every row is judged by itself, so ties and repeated rows change nothing.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.llm import words as W
from barsmith.llm.frames import pick

LEVEL, CHUNK, CHUNK_SHARE = 3, 2048, 0.05
#: Bytes at which fitted bands have their limits.
SIZES = tuple(round(2 ** (k / 2)) for k in range(12, 31))


class Bands(NamedTuple):
    """Limits by size: of the ratio of the text, and of its bytes to the compressed bytes of its marks (all but letters)."""

    sizes: tuple[int, ...]
    least: tuple[float, ...]
    most: tuple[float, ...]
    marks_least: tuple[float, ...]
    marks_most: tuple[float, ...]


GENERAL = Bands((128, 256, 1024, 4096, 16384), (0.0, 1.1, 1.25, 1.35, 1.4), (2.6, 3.0, 3.5, 4.0, 4.5), (0.0,) * 5, (float("inf"),) * 5)
CLEAN = Bands(
    SIZES,
    (0.81, 0.82, 0.96, 1.06, 1.16, 1.22, 1.31, 1.42, 1.54, 1.67, 1.74, 1.83, 1.9, 1.96, 2.02, 2.08, 2.11, 2.11, 2.11),
    (1.21, 1.35, 1.49, 1.58, 1.68, 1.75, 1.79, 1.92, 2.02, 2.1, 2.17, 2.25, 2.31, 2.36, 2.39, 2.45, 2.49, 2.53, 2.56),
    (1.41, 1.6, 1.85, 2.32, 2.9, 3.8, 4.81, 5.97, 7.42, 9.12, 10.97, 13.35, 15.76, 17.29, 20.42, 23.64, 24.31, 24.31, 24.31),
    (4.32, 5.73, 8.0, 11.25, 15.81, 18.14, 20.01, 21.98, 24.48, 23.21, 23.67, 24.89, 28.26, 31.49, 35.49, 36.62, 37.59, 38.56, 39.52),
)
#: What fitted limits lie outside the quantiles, in shares of the median.
LOW_MARGIN, HIGH_MARGIN, MARKS_MARGIN = 0.08, 0.025, 0.1
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20
SYMBOLS = b"#*$%&|<>"
_LETTERS = bytes(i for i in range(256) if i >= 128 or chr(i).isalpha())

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, chunks_out double, kept boolean"


def ratios(raw: bytes, press) -> tuple[float, float]:
    """Bytes of ``raw`` over its compressed bytes, and over those of its marks."""
    return (len(raw) / len(press.compress(raw)), len(raw) / len(press.compress(raw.translate(None, _LETTERS)))) if raw else (0.0, 0.0)


def chunks(raw: bytes) -> list[bytes]:
    """Pieces of CHUNK bytes; a rest of under half a piece stays with the last one."""
    edges = [*range(0, max(1, len(raw) - CHUNK // 2 + 1), CHUNK), len(raw)]
    return [raw[a:b] for a, b in zip(edges, edges[1:])]


def in_band(size: int, found: tuple[float, float], bands: Bands) -> bool:
    """Whether both ratios of a text of ``size`` bytes lie inside their limits."""
    at = bisect.bisect_right(bands.sizes, size)
    if 0 < at < len(bands.sizes):
        share = math.log(size / bands.sizes[at - 1]) / math.log(bands.sizes[at] / bands.sizes[at - 1])
        least, most, marks_least, marks_most = (v[at - 1] + share * (v[at] - v[at - 1]) if v[at] != v[at - 1] else v[at] for v in bands[1:])
    else:
        least, most, marks_least, marks_most = (v[min(at, len(v) - 1)] for v in bands[1:])
    if not at:  # the frame's fixed cost decides how little a text below the first size compresses
        least = marks_least = 0.0
    return least <= found[0] <= most and marks_least <= found[1] <= marks_most


def fit_bands(texts: Iterable[bytes], pieces: int = 4, least_pieces: int = 15) -> Bands:
    """Bands of clean texts: the 0.1 % and 99.9 % quantiles of pieces of each size, with a margin.

    ``texts`` is a bounded sample held in memory. Sizes of under ``least_pieces`` pieces carry the last
    limits on: the lower ones stay, the upper ones go on rising as between the last two sizes.
    """
    import zstandard

    press, texts = zstandard.ZstdCompressor(level=LEVEL), list(texts)
    rows: list[tuple[float, ...]] = []
    for size in SIZES:
        found = np.array([ratios(t[at:at + size], press) for t in texts for at in range(0, min(len(t) - size + 1, pieces * size), size)])
        if len(found) < least_pieces:
            break
        (low, marks_low), (mid, marks_mid), (high, marks_high) = np.quantile(found, [0.001, 0.5, 0.999], axis=0)
        rows.append((low - LOW_MARGIN * mid, high + HIGH_MARGIN * mid, marks_low - MARKS_MARGIN * marks_mid, marks_high + MARKS_MARGIN * marks_mid))
    while len(rows) < len(SIZES):
        (a, b, c, d), (_, b0, _, d0) = rows[-1], rows[-2]
        rows.append((a, b + max(0.0, b - b0), c, d + max(0.0, d - d0)))
    return Bands(SIZES, *(tuple(round(float(x), 2) for x in v) for v in zip(*rows, strict=True)))


def repeated_words(words: W.Words, width: int = WINDOW) -> np.ndarray:
    """Per row the words inside ``width``-word windows that occur twice or more in the row."""
    n_rows = len(words.rows) - 1
    every = W.rolling(words.hash, width)
    out = np.zeros(n_rows, np.int64)
    if not len(every):
        return out
    row_of = words.row_of()
    at = np.arange(len(every))
    ok = at + width <= words.rows[1:][row_of[:len(every)]]
    at, value = at[ok], every[ok]
    row = row_of[at]
    order = np.lexsort((value, row))
    v, r = value[order], row[order]
    same = (v[1:] == v[:-1]) & (r[1:] == r[:-1])
    twice = np.zeros(len(v), bool)
    twice[1:] |= same
    twice[:-1] |= same
    begin = at[order][twice]
    edge = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + width, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(row_of[covered], minlength=n_rows)


def measure(column: pa.Array, bands: Bands = CLEAN) -> dict[str, np.ndarray]:
    """The columns of MEASURES for one batch of texts."""
    import zstandard

    press = zstandard.ZstdCompressor(level=LEVEL)
    data, offsets = W.buffers(column)
    n = len(offsets) - 1
    out = {k.split()[0]: [] for k in MEASURES.split(", ")}
    for i, j in W.slices(offsets):
        off = offsets[i:j + 1]
        words = W.find(data, off)
        repeat, counts = repeated_words(words), words.counts
        for k in range(j - i):
            raw = data[off[k]:off[k + 1]].tobytes()
            lines = [x for x in raw.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
            chars = len(raw.translate(None, b"\t\n\x0b\x0c\r \x80\x81\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8d\x8e\x8f" + bytes(range(0x90, 0xC0))))
            n_words, n_repeat = int(counts[k]), int(repeat[k])
            failed = n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words
            whole = ratios(raw, press)
            parts = chunks(raw) if len(raw) > CHUNK else []
            outside = sum(not in_band(len(p), ratios(p, press), bands) for p in parts) / max(1, len(parts))
            for name, value in (("n_words", n_words), ("word_chars", chars), ("n_symbols", len(raw) - len(raw.translate(None, SYMBOLS))),
                                ("n_dup_lines", len(lines) - len(set(lines))), ("n_repeat_words", n_repeat), ("base_failed", failed),
                                ("ratio", whole[0]), ("chunks_out", outside),
                                ("kept", not failed and in_band(len(raw), whole, bands) and outside <= CHUNK_SHARE)):
                out[name].append(value)
    assert all(len(v) == n for v in out.values())
    return out


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = GENERAL) -> DataFrame:
    """One row per document: id, the base measures, ``ratio``, ``chunks_out`` (share of chunks outside their band) and ``kept``."""
    narrow = pick(docs, id=id_col, text=text_col)
    narrow = narrow.withColumn("text", F.col("text").cast("string"))
    kinds = [x.split() for x in MEASURES.split(", ")]
    arrow = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                got = measure(part.column(1), bands)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(got[k], arrow[t]) for k, t in kinds)], ["id", *(k for k, _ in kinds)])

    return narrow.mapInArrow(run, f"id {dict(narrow.dtypes)['id']}, {MEASURES}").withColumnRenamed("id", id_col)


def keep_documents(docs: DataFrame, text_col: str = "text", bands: Bands = CLEAN) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, in one pass without a shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                yield part.filter(pa.array(measure(part.column(at), bands)["kept"], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
