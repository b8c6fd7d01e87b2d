"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

Byte-pair encoding has one property that makes counts additive: the encoding of a
prefix ends with exactly one token ``t``, and what stands before ``t`` is the
encoding of the shorter prefix. So the count of a prefix is the count of the prefix
without its last token, plus one. The last token of each prefix is the only
vocabulary entry that ends there and *fits* the last token before it; two tokens
fit if encoding their joined bytes gives the two back, which follows from the order
of the merges. One pass over a text thus stores the count of every prefix, and
questions on budgets ("how much of this text fits in 1,024 tokens?", "how many
tokens has the first half?") are look-ups that encode nothing.

The vocabulary file also fixes a pattern that parts a text into pieces; merges
never cross pieces. The table therefore runs piece by piece, and handles the two
places where a cut changes the pieces themselves: white space at the end of the
prefix (one piece there, whatever follows it in the text) and a contraction cut
short. Special strings inside a text count as the library counts them by default.

Pieces repeat, so a task keeps the count steps of recent chunks (a word with its
leading space) in a bounded memo; its size changes only the speed.

Results for odd input: a null text counts as empty; an empty text has the counts
[0]; null or repeated ids are passed through, one result per row.
"""

from __future__ import annotations

import functools
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barsmith.llm.frames import pick

#: Entries of each memo of a task (about 200 bytes each); a full memo is emptied.
MEMO = 1_000_000
#: White space as the pattern's \\s has it (the Unicode property White_Space).
SPACES = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | {chr(c) for c in range(0x2000, 0x200B)}
#: Strings of bytes as the vocabulary file spells them: printable bytes stand for
#: themselves, the others for code points from 256 on (the published byte alphabet).
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_alphabet() -> dict[str, int]:
    rest = [b for b in range(256) if b not in set(_PRINTABLE)]
    return {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts of a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        ids = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        spell = lambda token: bytes(alphabet[c] for c in token)
        self.token = {spell(t): i for t, i in ids.items() if t not in self.special}
        #: per beginning of a token the tokens that end it, the longest first, with their lengths (Aho-Corasick's outputs)
        self.ends: dict[bytes, tuple[tuple[int, int], ...]] = {b"": ()}
        for s in sorted({t[:i] for t in self.token for i in range(1, len(t) + 1)}, key=len):
            i = 1
            while (shorter := self.ends.get(s[i:])) is None:
                i += 1
            own = self.token.get(s)
            self.ends[s] = shorter if own is None else ((len(s), own), *shorter)
        #: rank and parts of each merge; a token made by no merge is a single byte
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = ids[left], ids[right], ids[left + right]
            self.rank[a, b] = rank
            self.parts.setdefault(whole, (a, b))
        self.made = {whole: self.rank[parts] for whole, parts in self.parts.items()}
        self.pieces = regex.compile(pattern)
        self.contraction = regex.compile(r"'(?:re|ve|ll)")
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._fits: dict[tuple[int, int], bool] = {}
        self._before: tuple[bytes, list[int], list[int], list[int]] = (b"", [0], [-1], [0])
        self._steps: dict[str, bytes] = {}
        self._chunk: dict[str, bytes | None] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether the encoding of the joined bytes of ``a`` and ``b`` is ``[a, b]``.

        The merges that built ``a`` and ``b`` are undone from the latest back. At each
        step the two tokens that touch at the seam must have no merge of their own that
        would have come before the one just undone.
        """
        known = self._fits.get((a, b))
        if known is None:
            left, right, before = a, b, len(self.rank) + 1
            known = True
            while True:
                # A merge across the seam wins if it is earlier than the next merge undone on either side.
                if self.rank.get((left, right), before) < before:
                    known = False
                    break
                lrank, rrank = self.made.get(left, -1), self.made.get(right, -1)
                if lrank < 0 and rrank < 0:
                    break
                # Undo the later merge; at the seam, merges go from the left, so a tie undoes the right one.
                if lrank > rrank:
                    before, left = lrank, self.parts[left][1]
                else:
                    before, right = rrank + 1, self.parts[right][0]
            if len(self._fits) > 2 * MEMO:
                self._fits.clear()
            self._fits[a, b] = known
        return known

    def piece_counts(self, piece: str) -> list[int]:
        """Token count of each prefix of one piece, by code points; entry 0 is 0.

        Prefixes shared with the piece before are taken over, so sorted pieces cost least.
        """
        raw = piece.encode()
        ends, fits, fit = self.ends, self.fits, self._fits
        had, count, last, froms = self._before  # froms: where the longest beginning of a token starts that ends here
        shared = 0
        for a, b in zip(had, raw):
            if a != b:
                break
            shared += 1
        del count[shared + 1:], last[shared + 1:], froms[shared + 1:]
        self._before = raw, count, last, froms
        at = froms[shared]
        for end in range(shared + 1, len(raw) + 1):
            while (found := ends.get(raw[at:end])) is None:
                at += 1
            for length, t in found:
                start = end - length
                if start:
                    before = last[start]
                    known = fit.get((before, t))
                    if not (fits(before, t) if known is None else known):
                        continue
                count.append(count[start] + 1)
                last.append(t)
                froms.append(at)
                break
            else:
                self._before = b"", [0], [-1], [0]
                raise ValueError(f"no token ends at byte {end} of {piece!r}")
        if len(raw) == len(piece):
            return count[:]
        ends = [i for i in range(1, len(raw)) if raw[i] & 0xC0 != 0x80]
        return [0, *(count[i] for i in ends), count[-1]]

    def plain_counts(self, text: str) -> list[int]:
        """Counts of every prefix of a text without special strings."""
        out = [0]
        base = 0  # tokens before this piece
        run_at = run_base = -1  # an open run of white space, and the tokens before it
        for m in self.pieces.finditer(text):
            piece, at = m.group(), m.start()
            counts = self.piece_counts(piece)
            if piece[-1] in SPACES:
                if run_at < 0:
                    run_at, run_base = at, base
                run = self.piece_counts(text[run_at:m.end()]) if run_at < at else counts
                out += [run_base + c for c in run[at - run_at + 1:]]
            else:
                tail = [base + c for c in counts[1:]]
                if piece[0] == " " and run_at >= 0:  # a cut after this space ends in one run
                    tail[0] = run_base + self.piece_counts(text[run_at:at + 1])[-1]
                elif len(piece) == 3 and self.contraction.fullmatch(piece):
                    tail[1] = base + 2  # cut short, it is a quote and a letter
                out += tail
                run_at = -1
            base += counts[-1]
        return out

    def counts(self, text: str) -> np.ndarray:
        """Token count of every prefix of ``text``: entry k is that of its first k code points."""
        if self.special_cut is None or not self.special_cut.search(text):
            return np.asarray(self.plain_counts(text), np.int32)
        out, base = [0], 0
        parts = self.special_cut.split(text)
        for plain, special in zip(parts[::2], [*parts[1::2], ""], strict=True):
            whole = self.plain_counts(plain + special[:-1])  # inside the string it is ordinary text
            out += [base + c for c in whole[1:]]
            base += self.plain_counts(plain)[-1] if special else 0
            if special:
                base += 1
                out.append(base)
        return np.asarray(out, np.int32)

    def _piece_steps(self, piece: str) -> bytes | None:
        counts = self.piece_counts(piece)
        if len(piece) == 3 and self.contraction.fullmatch(piece):
            counts[2] = 2  # cut short, it is a quote and a letter
        steps = [b - a for a, b in itertools.pairwise(counts)]
        return bytes([x & 255 for x in steps]) if min(steps) > -128 else None

    def _chunk_steps(self, text: str, pieces: list[str]) -> bytes | None:
        out, before = [], False
        for piece in pieces:
            space = piece[-1] in SPACES
            if space and before:
                break  # cuts in a run of white space depend on the whole run
            before = space
            step = self._steps.get(piece) or self._piece_steps(piece)
            if step is None:
                return None
            out.append(step)
        else:
            return b"".join(out)
        steps = np.diff(self.plain_counts(text))
        return steps.astype(np.int8).tobytes() if abs(steps).max() < 128 else None

    def learn(self, chunks: set[str]) -> None:
        """Fill the memo: steps of the count at each code point of a space and the chunk, None if it does not stand alone."""
        memo, steps = self._chunk, self._steps
        if len(memo) > MEMO:
            memo.clear()
        if len(steps) > MEMO:
            steps.clear()
        split: list[tuple[str, str, list[str]]] = []
        new: set[str] = set()
        for chunk in chunks.difference(memo):
            if not chunk or chunk[0] in SPACES or chunk[-1] in SPACES:
                memo[chunk] = None
                continue
            text = " " + chunk
            pieces = self.pieces.findall(text)
            split.append((chunk, text, pieces))
            new.update(pieces)
        for piece in sorted(new.difference(steps)):
            step = self._piece_steps(piece)
            if step is not None:
                steps[piece] = step
        for chunk, text, pieces in split:
            memo[chunk] = self._chunk_steps(text, pieces)

    def prefix_tables(self, texts: list[str]) -> list[np.ndarray]:
        """``counts`` of each text, put together from chunks at single spaces, where pieces always part."""
        rows = [None if any(s in t for s in self.special) else t.split(" ") for t in texts]
        self.learn(set(itertools.chain.from_iterable(r[1:] for r in rows if r)))
        memo, out = self._chunk, []
        for text, row in zip(texts, rows, strict=True):
            if row is None or not row[0] or row[0][-1] in SPACES:
                out.append(self.counts(text))
                continue
            try:
                packed = b"".join([memo[c] for c in row[1:]])
            except TypeError:  # white space beside a space, or steps too large to pack
                out.append(self.counts(text))
                continue
            first = self.plain_counts(row[0])
            table = np.empty(len(text) + 1, np.int32)
            table[:len(first)] = first
            np.cumsum(np.frombuffer(packed, np.int8), dtype=np.int32, out=table[len(first):])
            table[len(first):] += first[-1]
            out.append(table)
        return out

@functools.lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> PrefixCounter:
    return PrefixCounter(path, pattern)


def fits_in(table: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix with at most ``budget`` tokens."""
    ok = np.flatnonzero(table <= budget)
    return int(ok[-1]) if len(ok) else 0


def _map(docs: DataFrame, path: str, pattern: str, row, fields: list[T.StructField], id_col: str, text_col: str) -> DataFrame:
    narrow = pick(docs, id=id_col, text=text_col)
    narrow = narrow.withColumn("text", narrow["text"].cast("string"))
    schema = T.StructType([T.StructField(id_col, narrow.schema["id"].dataType), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows = [row(t, table) for t, table in zip(texts, counter(path, pattern).prefix_tables(texts), strict=True)]
                columns = [part.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(out)[1:], strict=True))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return narrow.mapInArrow(run, schema)


def prefix_counts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the count at every prefix: (id, prefix_tokens array<int>), entry k for the first k code points."""
    return _map(docs, path, pattern, lambda _, table: (table,),
                [T.StructField("prefix_tokens", T.ArrayType(T.IntegerType()))], id_col, text_col)


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 1024,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Answers read from each document's prefix table.

    ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``limit`` tokens) and
    ``chars_in_limit``, the code points of the longest prefix within ``limit``.
    """
    def row(text: str, table: np.ndarray) -> tuple:
        n = int(table[-1])
        return len(text.encode()), n, n > limit, fits_in(table, limit)

    return _map(docs, path, pattern, row, [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
                            T.StructField("over_limit", T.BooleanType()), T.StructField("chars_in_limit", T.LongType())],
                id_col, text_col)
