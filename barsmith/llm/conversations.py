"""Operator 12: repair of conversation structure by a persistent audit DP.

A conversation's rows are read in order and each is kept (K), given another role (R) or
deleted (D); empty turns may be inserted (I) anywhere. The letters in order are the
*audit*. The cheapest audit is sought whose result reads ``(s?(ua)+)?`` in role initials,
the ASCII-least one of equal cost.

* **Persistent prefixes.** The DP walks the rows with four states (nothing yet, after a
  system turn, after a user turn, after an assistant turn) and keeps one audit prefix a
  state. A prefix is a linked node that shares its beginning with the others: it holds its last
  letter, its ancestors 1, 2, 4, ... letters back and a rolling hash of the whole prefix.
  Equal costs are decided by a search for the longest common prefix down the ancestors'
  hashes; equal hashes are verified (the same node, or a walk letter by letter).
  Comparing prefixes is enough: two of the same rows, state and cost are never the
  beginning of one another, since the rest would be inserts, which cost.
* **Pieces.** Rows are sorted by range over all conversations. A task finishes the
  conversations that lie inside its part; the first and the last one of a part and every
  one beyond ``PIECE_ROWS`` rows or ``PIECE_BYTES`` bytes is *open*: its rows go on in bounded
  pieces. Each piece gives its cheapest audits from every state to every state, and the
  pieces of a conversation are joined state by state. What was said earlier in another
  piece is found by an aggregation by digest, which combines before it shuffles.
  Only the digest of a repaired conversation has to pass its lines one after the other;
  they stream through a task in order.

Odd input: null roles and texts count as one space (so such texts are blank and such roles
are never kept); null turns come first and null ids form one conversation. Rows of one turn
are ordered by role, then by a hash of the text, then by the text, so repeated rows stand together.
A conversation without rows has zeros, an empty audit and the digest of nothing; an empty
table gives an empty result; extra columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.llm.frames import pick, stage

SPACES = " \t\n\x0b\x0c\r"
ENDS = ".!?"
LEGAL = {"su", "ua", "au"}
#: States: nothing yet, after a system, a user, an assistant turn; a result may end in the first or last.
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
STEPS = ((START, "s", SYSTEM), (START, "u", USER), (SYSTEM, "u", USER), (USER, "a", ASSISTANT), (ASSISTANT, "u", USER))
NAMES = {"u": "user", "a": "assistant"}
OK, UNFIT, TRUNCATED = range(3)

#: Rows and bytes of text that a task holds of one conversation.
PIECE_ROWS = 1 << 14
PIECE_BYTES = 16 << 20


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


# -- audit prefixes -----------------------------------------------------------------

MODULUS = (1 << 61) - 1
BASE = 0x1F3A5C7E9B2D4


@dataclass
class Prefixes:
    """Audit prefixes as nodes of shared chains; node 0 is the empty prefix."""

    letter: list[str] = field(default_factory=lambda: [""])
    depth: list[int] = field(default_factory=lambda: [0])
    hash: list[int] = field(default_factory=lambda: [0])
    up: list[list[int]] = field(default_factory=lambda: [[]])
    modulus: int = MODULUS

    def add(self, node: int, letter: str) -> int:
        """The prefix ``node`` with one letter more."""
        above, k = [node], 0
        while k < len(self.up[above[k]]):
            above.append(self.up[above[k]][k])
            k += 1
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * BASE + ord(letter)) % self.modulus)
        self.up.append(above)
        return len(self.letter) - 1

    def lift(self, node: int, steps: int) -> int:
        k = 0
        while steps:
            if steps & 1:
                node = self.up[node][k]
            steps, k = steps >> 1, k + 1
        return node

    def less(self, a: int, b: int) -> bool:
        """Whether the string of ``a`` comes before that of ``b``."""
        shorter = self.depth[a] < self.depth[b]
        x = self.lift(a, max(0, self.depth[a] - self.depth[b]))
        y = self.lift(b, max(0, self.depth[b] - self.depth[a]))
        if self.hash[x] == self.hash[y] and self._same(x, y):
            return shorter
        p, q = x, y
        for k in range(self.depth[x].bit_length() - 1, -1, -1):
            if k < len(self.up[p]) and self.hash[self.up[p][k]] != self.hash[self.up[q][k]]:
                p, q = self.up[p][k], self.up[q][k]
        # p and q differ by hash and their parents do not: the first letter that differs,
        # if the parents' prefixes are equal letter by letter.
        if self.letter[p] != self.letter[q] and self._same(self.up[p][0], self.up[q][0]):
            return self.letter[p] < self.letter[q]
        return self.text(x) < self.text(y)

    def _same(self, x: int, y: int) -> bool:
        """Equality letter by letter of two prefixes of one length; shared beginnings end the walk."""
        while x != y:
            if self.letter[x] != self.letter[y]:
                return False
            x, y = self.up[x][0], self.up[y][0]
        return True

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))


def audits(rows: Iterable[tuple[str, int]], start: int, opening: bool, costs: Costs = Costs()) -> list[tuple[int, str] | None]:
    """Cheapest ``(cost, audit)`` from ``start`` to every state over ``rows`` of (role initial, fault).

    Inserts follow each row; with ``opening`` they may also stand before the first.
    """
    tree = Prefixes()
    best: list[tuple[int, int] | None] = [None] * 4  # (cost, node)
    best[start] = (0, 0)

    def offer(into: list, state: int, cost: int, node: int, letter: str) -> None:
        have = into[state]
        if have is not None and have[0] < cost:
            return
        made = tree.add(node, letter)
        if have is None or cost < have[0] or tree.less(made, have[1]):
            into[state] = (cost, made)

    def insert(into: list) -> None:
        for a, _, b in STEPS[1:3] + STEPS[4:] + STEPS[3:4]:  # to a user turn first, then from there
            if into[a] is not None:
                offer(into, b, into[a][0] + costs.insert, into[a][1], "I")

    if opening:
        insert(best)
    for initial, fault in rows:
        after: list[tuple[int, int] | None] = [None] * 4
        extra = costs.truncated if fault == TRUNCATED else 0
        if fault != UNFIT:
            for a, role, b in STEPS:
                if best[a] is None:
                    continue
                if role == initial:
                    offer(after, b, best[a][0] + extra, best[a][1], "K")
                elif role in NAMES:
                    offer(after, b, best[a][0] + costs.rerole + extra, best[a][1], "R")
        for a in range(4):
            if best[a] is not None:
                offer(after, a, best[a][0] + costs.delete, best[a][1], "D")
        insert(after)
        best = after
    return [None if b is None else (b[0], tree.text(b[1])) for b in best]


def repaired(rows: Iterable[tuple[str, str]], audit: str, state: int = START) -> Iterator[tuple[str, str]]:
    """The (role, text) turns that ``audit`` makes of ``rows``, from ``state`` on."""
    rest = iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rest)
        if letter == "D":
            continue
        if letter == "K":
            state = next(b for a, r, b in STEPS if a == state and r == role[:1])
        else:
            state = USER if state != USER else ASSISTANT
            role = NAMES["u" if state == USER else "a"]
        yield role, text


# -- whole conversations --------------------------------------------------------------

def fault_of(text: str) -> tuple[bool, bool]:
    """Whether a text is blank, and whether it ends without one of ENDS."""
    end = text.rstrip(SPACES)[-1:]
    return not end, bool(end) and end not in ENDS


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def whole(rows: list[tuple[int | None, str, str]], costs: Costs = Costs()) -> dict:
    """Counts, audit and digest of a conversation's (turn, role, text) rows in order."""
    seen: set[tuple[str, str]] = set()
    kinds, blank, duplicate, truncated = [], 0, 0, 0
    for _, role, text in rows:
        is_blank, is_cut = fault_of(text)
        repeat = (role, text) in seen
        seen.add((role, text))
        kinds.append((role[:1], UNFIT if is_blank or repeat else TRUNCATED if is_cut else OK))
        blank += is_blank
        duplicate += not is_blank and repeat
        truncated += not is_blank and not repeat and is_cut
    turns = [t for t, _, _ in rows if t is not None]
    ends = audits(kinds, START, True, costs)
    cost, audit = min(ends[s] for s in FINAL if ends[s] is not None)
    lines = "\n".join(f"{r}:{t}" for r, t in repaired([(r, t) for _, r, t in rows], audit))
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": blank, "duplicate": duplicate, "truncated": truncated,
            "illegal": illegal_pairs([k for k, _ in kinds]), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(lines.encode()).hexdigest()}


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
FIRST = f"conv string, open boolean, {RESULT}, piece long, at long, turn long, role string, text string, fault int, live boolean"
_FIRST = pa.schema([("conv", pa.string()), ("open", pa.bool_()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string()),
                    ("piece", pa.int64()), ("at", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()),
                    ("fault", pa.int32()), ("live", pa.bool_())])


def _table(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


@dataclass
class _Part:
    """Reads the sorted rows of a part: closes conversations inside it, hands on the rows of open ones."""

    number: int
    piece_rows: int
    piece_bytes: int
    costs: Costs
    conv: str | None = None
    open: bool = True  # the first conversation may have begun in an earlier part
    held: list[tuple] = field(default_factory=list)
    held_bytes: int = 0
    in_piece: int = 0
    piece: int = -1
    out: list[dict] = field(default_factory=list)

    def hand_on(self) -> None:
        for at, turn, role, text, live in self.held:
            if self.piece < 0 or self.in_piece >= self.piece_rows or self.held_bytes >= self.piece_bytes:
                self.piece, self.in_piece, self.held_bytes = at, 0, 0
            self.in_piece += 1
            self.held_bytes += len(text)
            blank, cut = fault_of(text)
            self.out.append({"conv": self.conv, "open": True, "piece": self.piece, "at": at, "turn": turn, "role": role, "text": text,
                             "fault": UNFIT if blank else TRUNCATED if cut else OK, "live": live})
        self.held = []

    def close(self) -> None:
        if self.open:
            self.hand_on()
        else:
            rows = [(turn, role, text) for _, turn, role, text, live in self.held if live]
            self.out.append({"conv": self.conv, "open": False, **whole(rows, self.costs)})
        self.held, self.held_bytes, self.in_piece, self.piece = [], 0, 0, -1

    def row(self, at: int, conv: str, turn: int | None, role: str, text: str, live: bool) -> None:
        if conv != self.conv:
            if self.conv is not None:
                self.close()
                self.open = False
            self.conv = conv
        self.held.append((at, turn, role, text, live))
        if self.open:
            self.hand_on()
            return
        self.held_bytes += len(text)
        if len(self.held) >= self.piece_rows or self.held_bytes >= self.piece_bytes:
            self.open, self.held_bytes = True, 0
            self.hand_on()

    def take(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for conv, turn, role, text, live in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "live"))):
                self.row((self.number << 33) + n, conv, turn, role, text, live)
                n += 1
            if self.out:
                yield _table(self.out, _FIRST)
                self.out = []
        if self.conv is not None:
            self.open = True  # it may go on in a later part
            self.hand_on()
        if self.out:
            yield _table(self.out, _FIRST)


# -- open conversations -----------------------------------------------------------------

PIECE = ("conv string, piece long, blank long, duplicate long, truncated long, illegal long, first string, last string, lo long, hi long, turns long, "
         "paths array<struct<start:int,end:int,cost:long,audit:string>>")
_PATHS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_PIECE = pa.schema([("conv", pa.string()), ("piece", pa.int64()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")],
                    ("first", pa.string()), ("last", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()), ("turns", pa.int64()), ("paths", _PATHS)])


def _piece(rows: pa.Table, firsts: pa.Table, costs: Costs) -> pa.Table:
    """One piece: its counts and its cheapest audits from every state to every state."""
    rows = rows.sort_by("at")
    new = set(firsts.column("at").to_pylist())
    kinds, turns, n = [], set(), {"blank": 0, "duplicate": 0, "truncated": 0}
    for at, turn, role, fault, live in zip(*(rows.column(c).to_pylist() for c in ("at", "turn", "role", "fault", "live"))):
        if not live:
            continue
        repeat = at not in new
        n["blank"] += fault == UNFIT
        n["duplicate"] += fault != UNFIT and repeat
        n["truncated"] += fault == TRUNCATED and not repeat
        kinds.append((role[:1], UNFIT if repeat else fault))
        if turn is not None:
            turns.add(turn)
    paths = [{"start": a, "end": b, "cost": end[0], "audit": end[1]}
             for a in range(4) for b, end in enumerate(audits(kinds, a, False, costs)) if end is not None]
    initials = [k for k, _ in kinds]
    row = {"conv": rows.column("conv")[0].as_py(), "piece": rows.column("piece")[0].as_py(), **n, "illegal": illegal_pairs(initials),
           "first": initials[0] if initials else None, "last": initials[-1] if initials else None,
           "lo": min(turns, default=None), "hi": max(turns, default=None), "turns": len(turns), "paths": paths}
    return pa.Table.from_batches([_table([row], _PIECE)])


def _relation(a: str, b: str) -> tuple[int, int]:
    """(-1 or 1, 0) if two strings differ inside both, else (0, letters that ``b`` has more)."""
    common = min(len(a), len(b))
    x, y = a[:common], b[:common]
    return (0, len(b) - len(a)) if x == y else (-1 if x < y else 1, 0)


def _before(relation: tuple[int, int]) -> bool:
    sign, more = relation
    return sign < 0 or (sign == 0 and more > 0)


class _Joined:
    """Cheapest audits of the pieces read so far, one a state, as linked parts.

    Of two states' audits only their order is kept: which one is less, or, where one begins
    the other, how many inserts the other has more (both cover the same rows, so the rest
    can only be inserts).
    """

    def __init__(self, costs: Costs):
        i = costs.insert
        # (cost, (link, piece, start, audit)); inserts before the first row belong to no piece.
        self.best: dict[int, tuple[int, tuple]] = {START: (0, (None, None, START, "")), USER: (i, (None, None, START, "I")), ASSISTANT: (2 * i, (None, None, START, "II"))}
        texts = {START: "", USER: "I", ASSISTANT: "II"}
        self.order = {(a, b): _relation(texts[a], texts[b]) for a in texts for b in texts}

    def _compare(self, a: tuple, b: tuple) -> tuple[int, int]:
        (sa, ta), (sb, tb) = a, b
        sign, more = self.order[sa, sb]
        return (sign, 0) if sign else _relation("I" * max(0, -more) + ta, "I" * max(0, more) + tb)

    def add(self, piece: int, paths: list[dict]) -> None:
        chosen: dict[int, tuple] = {}  # end: (cost, (start, audit))
        for p in paths:
            if p["start"] not in self.best:
                continue
            made = (self.best[p["start"]][0] + p["cost"], (p["start"], p["audit"]))
            have = chosen.get(p["end"])
            if have is None or made[0] < have[0] or (made[0] == have[0] and _before(self._compare(made[1], have[1]))):
                chosen[p["end"]] = made
        order = {(a, b): self._compare(chosen[a][1], chosen[b][1]) for a in chosen for b in chosen}
        self.best = {end: (cost, (self.best[start][1], piece, start, audit)) for end, (cost, (start, audit)) in chosen.items()}
        self.order = order

    def result(self) -> tuple[int, list[tuple[int | None, int, str]]]:
        """Cost and the (piece, start state, audit) parts in order."""
        ends = [s for s in FINAL if s in self.best]
        end = min(ends, key=lambda s: self.best[s][0])
        for s in ends:
            if s != end and self.best[s][0] == self.best[end][0] and _before(self.order[s, end]):
                end = s
        cost, link = self.best[end]
        parts = []
        while link is not None:
            parts.append(link[1:])
            link = link[0]
        return cost, parts[::-1]


JOINED = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, parts array<struct<piece:long,start:int,audit:string>>"
_PARTS = pa.list_(pa.struct([("piece", pa.int64()), ("start", pa.int32()), ("audit", pa.string())]))
_JOINED = pa.schema([("conv", pa.string()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("parts", _PARTS)])


def _join(pieces: pa.Table, costs: Costs) -> pa.Table:
    """One open conversation from its pieces."""
    pieces = pieces.sort_by("piece")
    joined, n, last, turns, lo, hi = _Joined(costs), dict.fromkeys(COUNTS, 0), None, 0, None, None
    for i in range(pieces.num_rows):
        p = pieces.slice(i, 1).to_pylist()[0]
        joined.add(p["piece"], p["paths"])
        for c in ("blank", "duplicate", "truncated", "illegal"):
            n[c] += p[c]
        if p["first"] is not None:
            n["illegal"] += last is not None and last + p["first"] not in LEGAL
            last = p["last"]
        if p["turns"]:
            turns += p["turns"] - (p["lo"] == hi)  # a turn that goes on from the piece before
            lo, hi = p["lo"] if lo is None else lo, p["hi"]
    n["gaps"] = hi - lo + 1 - turns if turns else 0
    n["cost"], parts = joined.result()
    opening = parts[0][2]  # inserts before the first row: they go to the first piece
    given = [{"piece": piece, "start": START if i == 0 else start, "audit": (opening if i == 0 else "") + audit} for i, (piece, start, audit) in enumerate(parts[1:])]
    row = {"conv": pieces.column("conv")[0].as_py(), **n, "audit": "".join(p["audit"] for p in given), "parts": given}
    return pa.Table.from_batches([_table([row], _JOINED)])


_LINES = pa.schema([("conv", pa.string()), ("piece", pa.int64()), ("n", pa.int32()), ("line", pa.string())])
LINES = "conv string, piece long, n int, line string"


def _render(rows: pa.Table, parts: pa.Table) -> pa.Table:
    """The repaired lines of one piece."""
    rows = rows.sort_by("at")
    live = [(role, text) for role, text, ok in zip(*(rows.column(c).to_pylist() for c in ("role", "text", "live"))) if ok]
    lines = [f"{r}:{t}" for p in parts.to_pylist() for r, t in repaired(live, p["audit"], p["start"])]
    conv, piece = rows.column("conv")[0].as_py(), rows.column("piece")[0].as_py()
    return pa.Table.from_batches([_table([{"conv": conv, "piece": piece, "n": i, "line": line} for i, line in enumerate(lines)], _LINES)])


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each conversation's lines, which come sorted; nothing but the digest's state is held."""
    conv, sha = None, None
    for batch in batches:
        done: list[tuple[str, str]] = []
        for c, line in zip(batch.column("conv").to_pylist(), batch.column("line").to_pylist()):
            if c != conv:
                if sha is not None:
                    done.append((conv, sha.hexdigest()))
                conv, sha = c, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(line.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string())], ["conv", "sha"])
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.string()), pa.array([sha.hexdigest()], pa.string())], ["conv", "sha"])


# -- the operator ---------------------------------------------------------------------

def damage(rows: DataFrame) -> DataFrame:
    """The contract's damage to ``(conv, turn, role, text)`` rows; dropped rows stay with ``live`` false."""
    def shown(c: str) -> F.Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(F.col("_k").isin(0, 1), F.lit("")).when(F.col("_k") == 2, F.translate(shown("text"), ENDS, "")).otherwise(shown("text"))
    copies = F.sequence(F.lit(1), F.when(F.col("_k") == 3, F.lit(2)).otherwise(F.lit(1)))
    return (rows.withColumn("_k", kind)
            .select("conv", "turn", F.when(F.col("_k") == 4, F.lit("user")).otherwise(shown("role")).alias("role"), text.alias("text"),
                    (F.col("_k") != 0).alias("live"), F.explode(copies).alias("_copy")).drop("_copy"))


def repair(rows: DataFrame, *, costs: Costs = Costs(), piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Counts, audit and digest of every conversation of ``(conv, turn, role, text, live)`` rows.

    Rows that are not ``live`` only make their conversation appear in the result.
    """
    kind = rows.schema["conv"].dataType
    blank = F.lit(" ")
    # A key without nulls; the key's rows come in the order of turn, role and text.
    keyed = rows.select(F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("")).alias("conv"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), "live").withColumn("_h", F.xxhash64("text"))
    order = ["conv", "turn", "role", "_h"]
    # Copies of one row may fill more than one part, hence the row's own number at the end.
    spread = keyed.withColumn("_i", F.monotonically_increasing_id()).repartitionByRange(*order, "_i").sortWithinPartitions(*order, "text", "_i")

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _Part(TaskContext.get().partitionId(), piece_rows, piece_bytes, costs).take(batches)

    passed = stage(spread.drop("_h", "_i").mapInArrow(first_pass, FIRST), "conversations")
    still_open = passed.where("open")
    key = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    firsts = (still_open.where("live").select("conv", key.alias("key"), F.struct("at", "piece").alias("place"))
              .groupBy("conv", "key").agg(F.min("place").alias("place")).select("place.at", "place.piece"))
    pieces = (still_open.select("conv", "piece", "at", "turn", "role", "fault", "live").groupBy("piece")
              .cogroup(firsts.groupBy("piece")).applyInArrow(lambda a, b: _piece(a, b, costs), PIECE))
    joined = stage(pieces.groupBy("conv").applyInArrow(lambda t: _join(t, costs), JOINED), "conversations-joined")
    parts = joined.select(F.explode("parts").alias("p")).select("p.piece", "p.start", "p.audit")
    lines = (still_open.select("conv", "piece", "at", "role", "text", "live").groupBy("piece")
             .cogroup(parts.groupBy("piece")).applyInArrow(_render, LINES))
    digests = lines.repartition("conv").sortWithinPartitions("conv", "piece", "n").drop("piece", "n").mapInArrow(_digests, "conv string, sha string")
    nothing = hashlib.sha256(b"").hexdigest()
    columns = ["conv", *COUNTS, "audit", "repaired_sha256"]
    late = joined.join(digests, "conv", "left").withColumn("repaired_sha256", F.coalesce("sha", F.lit(nothing))).select(*columns)
    every = passed.where(~F.col("open")).select(*columns).unionByName(late)
    return every.withColumn("conv", F.when(F.col("conv") != "", F.substring("conv", 2, 2**31 - 1)).cast(kind))


def conversation_repair(conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                        damaged: bool = False, costs: Costs = Costs()) -> DataFrame:
    """One row per conversation: ``<conv>``, counts of faults, ``cost``, ``audit`` and the digest of the repaired turns.

    With ``damaged`` the rows are first harmed by :func:`damage`, to measure the repair.
    """
    rows = pick(conversations, conv=conv, turn=turn, role=role, text=text)
    rows = damage(rows) if damaged else rows.withColumn("live", F.lit(True))
    return repair(rows, costs=costs).withColumnRenamed("conv", conv)
