"""Operator 11: Merkle manifest of a dataset by cogrouped subtree exchange.

Every row is a leaf, the digest of its fields. The leaves of one source form a tree of
16 children a node whose top is the source's *subroot*; the subroots, in source order,
form a tree of the same shape whose top is the *root*. A leaf's *proof* is the list of
its siblings on the way up.

1. Leaves are digested by native expressions and placed: a range sort by (tree, id,
   digest) is written once, and the row numbers inside its parts plus prefix sums of
   the parts' counts give each leaf its position, so a tree of any size is ordered
   without standing in one task.
2. **Up**: 16 ** 3 = 4,096 consecutive nodes of a tree are a *superblock*. Each is
   reduced to one node, three levels higher, which takes part in the next exchange,
   until every tree is one node; the subroots then climb their own tree the same way.
   A tree of n leaves takes about log(n) / log(4096) exchanges, each 4,096 times smaller.
3. **Down**: the outer nodes that a superblock needs, which are the runs on the way from
   its top to the root, come down the same steps: at each, the nodes and the outer nodes
   are cogrouped by superblock in ``applyInPandas``, which reduces the superblock again,
   joins its own runs to the outer ones and hands them on. At the leaves the same
   cogroup yields proofs and folds tampered leaves up to a root.

Superblocks are dealt to blocks by a hash, about one a block, so thousands of small
sources share a task and a hot source spreads over as many as it needs. A task holds a
few superblocks; nothing goes through the driver but row counts.

Odd input: a null field is ``-`` in the digest, null sources form one tree, placed first, null
ids come first in theirs; rows of equal id are ordered by their digest, and whole copies
have equal leaves, so their order does not show. An empty table gives an empty result. A
tree of one leaf is its own subroot, one source's subroot is the root, and a proof without
siblings is the digest of nothing. Extra columns of any name are ignored; very long texts
are digested in the JVM and travel no further.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barsmith.llm.frames import pick, stage

#: Children of a node, fixed by the manifest's format.
FAN_OUT = 16
#: Levels that one exchange climbs: a superblock has FAN_OUT ** LEVELS nodes.
LEVELS = 3

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# -- leaves -----------------------------------------------------------------------

def leaf_column(fields: list[Column]) -> Column:
    """Digest of the fields, each ``-`` if null, else its UTF-8 length, a colon and its value."""
    def part(c: Column) -> Column:
        value = c.cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))
    return F.sha2(F.concat(*[part(c) for c in fields]), 256)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


@dataclass
class Placed:
    """Nodes ``(tree, pos, size, node, ...)`` with their number and the size of the largest tree."""

    nodes: DataFrame
    total: int
    largest: int


def placed(rows: DataFrame, order: list[str]) -> Placed:
    """``rows`` with ``pos`` (0-based place in their ``tree`` by ``order``) and ``size`` (rows of the tree).

    The range sort is written once. The table joined back to it has a row for each tree in
    each part, and a key of it never meets more rows than one part holds.
    """
    ordered = rows.withColumn("_copy", F.monotonically_increasing_id()).repartitionByRange("tree", *order, "_copy")
    written = stage(ordered.sortWithinPartitions("tree", *order, "_copy").drop("_copy")
                    .withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "merkle-sorted")
    counts = written.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    series = Window.partitionBy("tree")
    before = series.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stage(counts.select("tree", "_part", "_n", F.sum("_n").over(series).alias("size"),
                                (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")), "merkle-parts")
    known = parts.agg(F.sum("_n"), F.max("size")).first()
    nodes = written.join(parts.drop("_n"), ["tree", "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")
    return Placed(nodes, known[0] or 0, known[1] or 0)


# -- superblocks ------------------------------------------------------------------

def climb(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and, above them, up to ``levels`` levels of digests of runs, ending at a single node."""
    out = [nodes]
    while len(out) <= levels:
        below = out[-1]
        out.append([digest(below[i:i + FAN_OUT]) for i in range(0, len(below), FAN_OUT)])
    return out


def levels_left(size: int, levels: int) -> int:
    """Levels that a superblock of a tree with ``size`` nodes still has to climb, at most ``levels``."""
    n = 0
    while size > 1 and n < levels:
        size, n = -(-size // FAN_OUT), n + 1
    return n


def block_of(place: str, blocks: int) -> Column:
    """The block to which the superblock at ``place`` of its tree is dealt."""
    return F.pmod(F.xxhash64("tree", place), F.lit(blocks)).cast("int")


@dataclass
class Step:
    """Nodes of one exchange, dealt to ``blocks`` blocks by superblock."""

    nodes: DataFrame
    blocks: int


def _step(nodes: DataFrame, total: int, levels: int) -> Step:
    wide = FAN_OUT ** levels
    blocks = max(1, -(-total // wide))
    place = nodes.withColumn("super", ((F.col("pos") - F.pmod("pos", F.lit(wide))) / wide).cast("long"))
    return Step(place.withColumn("block", block_of("super", blocks)), blocks)


def _superblocks(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The superblocks of a block, each whole and in order of place."""
    pdf = pdf.sort_values(["tree", "pos"], kind="stable")
    tree, place = pdf["tree"].to_numpy(), pdf["super"].to_numpy()
    if len(pdf):
        cuts = np.flatnonzero((tree[1:] != tree[:-1]) | (place[1:] != place[:-1])) + 1
        bounds = [0, *cuts.tolist(), len(pdf)]
        for a, b in zip(bounds, bounds[1:]):
            yield pdf.iloc[a:b]


NODE = "tree string, pos long, size long, node string"


def _reduce(pdf: pd.DataFrame, levels: int) -> pd.DataFrame:
    out = []
    for block in _superblocks(pdf):
        size = int(block["size"].iloc[0])
        up = levels_left(size, levels)
        out.append((block["tree"].iloc[0], int(block["super"].iloc[0]), -(-size // FAN_OUT ** up), climb(block["node"].tolist(), up)[-1][0]))
    return pd.DataFrame(out, columns=["tree", "pos", "size", "node"])


def go_up(leaves: Placed, levels: int) -> tuple[list[Step], DataFrame]:
    """The steps of the exchange (the leaves first) and the tops, one node a tree."""
    steps, nodes, total, largest = [], leaves.nodes, leaves.total, leaves.largest
    while True:
        steps.append(_step(nodes, total, levels))
        reduced = steps[-1].nodes.select("tree", "pos", "size", "node", "super", "block").groupBy("block").applyInPandas(
            lambda pdf: _reduce(pdf, levels), NODE)
        # Trees that are one node already come along, so the count only falls to their number at best.
        nodes, largest = stage(reduced, "merkle-nodes"), -(-largest // FAN_OUT ** levels)
        if largest <= 1:
            return steps, nodes
        total = nodes.count()


#: The way up from the node at ``pos``: its run at each level (itself included), its index in each, the tops.
PATH = "tree string, pos long, places array<int>, runs array<array<string>>, subroot string, root string"


def _paths(nodes: pd.DataFrame, outer: pd.DataFrame, levels: int) -> pd.DataFrame:
    """Way up of every node of a block: the runs in its superblock, then the outer ones."""
    known = {(r.tree, r.pos): r for r in outer.itertuples(index=False)}
    out = []
    for block in _superblocks(nodes):
        first = block.iloc[0]
        path = known[first["tree"], first["super"]]
        up = climb(block["node"].tolist(), levels_left(int(first["size"]), levels))
        above = [list(r) for r in path.runs]
        for at, pos in enumerate(block["pos"]):
            places, runs = [], []
            for level in up[:-1]:
                places.append(at % FAN_OUT)
                runs.append(level[at - at % FAN_OUT:][:FAN_OUT])
                at //= FAN_OUT
            out.append((first["tree"], pos, places + list(path.places), runs + above, path.subroot, path.root))
    return pd.DataFrame(out, columns=["tree", "pos", "places", "runs", "subroot", "root"])


def _with_levels(work: Callable[..., pd.DataFrame], levels: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    return lambda nodes, outer: work(nodes, outer, levels)


def come_down(steps: list[Step], tops: DataFrame, last: Callable[..., pd.DataFrame], schema: str, levels: int) -> DataFrame:
    """Hand the ways up of the trees' tops down the steps; ``last`` finishes the first step's nodes."""
    outer = tops
    for step in reversed(steps):
        bottom = step is steps[0]
        given = outer.withColumn("block", block_of("pos", step.blocks))
        out = step.nodes.groupBy("block").cogroup(given.groupBy("block")).applyInPandas(
            _with_levels(last if bottom else _paths, levels), schema if bottom else PATH)
        outer = out if bottom else stage(out, "merkle-paths")
    return outer


def fold(node: str, places: list[int], runs: list[list[str]]) -> str:
    """The top that ``node`` gives in its place among its siblings of every level."""
    for place, run in zip(places, runs):
        node = digest([*run[:place], node, *run[place + 1:]])
    return node


def _finish(nodes: pd.DataFrame, outer: pd.DataFrame, levels: int) -> pd.DataFrame:
    """Proof and folded root of every leaf of a block."""
    known = {(r.tree, r.pos): r for r in outer.itertuples(index=False)}
    out = []
    for block in _superblocks(nodes):
        first = block.iloc[0]
        path = known[first["tree"], first["super"]]
        up = climb(block["node"].tolist(), levels_left(int(first["size"]), levels))
        above = [list(r) for r in path.runs]
        beyond = "".join(d for place, run in zip(path.places, above) for i, d in enumerate(run) if i != place)
        fold_above = functools.lru_cache(maxsize=None)(lambda top: fold(top, path.places, above))
        for at, (id_, leaf, changed) in enumerate(zip(block["id"], block["node"], block["changed"])):
            proof, places, runs = [], [], []
            for level in up[:-1]:
                place, run = at % FAN_OUT, level[at - at % FAN_OUT:][:FAN_OUT]
                places.append(place)
                runs.append(run)
                proof += run[:place] + run[place + 1:]
                at //= FAN_OUT
            top = fold(leaf if changed is None else changed, places, runs)
            out.append((id_, leaf, path.subroot, path.root, digest([*proof, beyond]), fold_above(top)))
    return pd.DataFrame(out, columns=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])


# -- the manifest -------------------------------------------------------------------

def ways_up(leaves: DataFrame, order: list[str], last: Callable[..., pd.DataFrame], schema: str, levels: int = LEVELS) -> DataFrame:
    """Both trees over ``leaves`` (``source``, ``node`` and other columns), up and down again."""
    # A key without nulls, in the order of the sources, the null one first.
    keyed = leaves.withColumn("tree", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    steps, subroots = go_up(placed(keyed, order), levels)
    sources = placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "node"), ["of"])
    source_steps, root = go_up(sources, levels)
    none = root.select("tree", "pos", F.expr("array()").cast("array<int>").alias("places"), F.expr("array()").cast("array<array<string>>").alias("runs"),
                       F.col("node").alias("subroot"), F.col("node").alias("root"))
    down = come_down(source_steps, none, _paths, PATH, levels).select("pos", "places", "runs", "root")
    tops = sources.nodes.select(F.col("of").alias("tree"), F.col("pos").alias("at"), F.col("node").alias("subroot"))
    tops = tops.join(down.withColumnRenamed("pos", "at"), "at").select("tree", F.lit(0).cast("long").alias("pos"), "places", "runs", "subroot", "root")
    return come_down(steps, stage(tops, "merkle-tops"), last, schema, levels)


def merkle_manifest(docs: DataFrame, *, fields: tuple[str, ...] = FIELDS, id: str = "doc_id", source: str = "source",
                    changed: dict[str, Column] | None = None, where: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """``(<id>, leaf, subroot, root, proof_sha256, folded_root, verified)`` of every row.

    ``changed`` maps fields to what they are now on the rows of ``where`` (columns are named
    by ``fields``): the folded root starts from the digest of the changed row and the stored
    siblings, so ``verified`` tells whether the row is still what the manifest holds.
    """
    rows = pick(docs, _id=id, _source=source, **{f: f for f in fields})
    now = leaf_column([(changed or {}).get(f, F.col(f)) for f in fields])
    leaves = rows.select(F.col("_id").alias("id"), F.col("_source").alias("source"), leaf_column([F.col(f) for f in fields]).alias("node"),
                         (F.when(where, now) if changed else F.lit(None).cast("string")).alias("changed"))
    kind = leaves.schema["id"].dataType.simpleString()
    out = ways_up(leaves, ["id", "node"], _finish, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string", levels)
    return out.select(F.col("id").alias(id), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _proofs(nodes: pd.DataFrame, outer: pd.DataFrame, levels: int) -> pd.DataFrame:
    paths = _paths(nodes, outer, levels)
    ids = nodes.set_index(["tree", "pos"])[["id", "node"]]
    return paths.join(ids, on=["tree", "pos"]).rename(columns={"node": "leaf"})[["id", "leaf", "places", "runs", "subroot", "root"]]


def merkle_proofs(docs: DataFrame, *, fields: tuple[str, ...] = FIELDS, id: str = "doc_id", source: str = "source", levels: int = LEVELS) -> DataFrame:
    """The proofs themselves: per row its leaf, the runs on its way up (itself included), its index in each and the tops."""
    rows = pick(docs, _id=id, _source=source, **{f: f for f in fields})
    leaves = rows.select(F.col("_id").alias("id"), F.col("_source").alias("source"), leaf_column([F.col(f) for f in fields]).alias("node"))
    kind = leaves.schema["id"].dataType.simpleString()
    out = ways_up(leaves, ["id", "node"], _proofs, f"id {kind}, leaf string, places array<int>, runs array<array<string>>, subroot string, root string", levels)
    return out.withColumnRenamed("id", id)
