"""N-gram Jaccard join as a blocked sparse matrix product of document by n-gram incidence.

Rows of the matrix are *classes*: documents with the same shingle set are one class,
so exact copies cost one row however many there are. Columns are shingles. Two sets
of Jaccard similarity t or more must share at least m columns among the first
``n - ceil(t * n) + m`` columns of each, in any one order of the columns; with the
most frequent shingles last, those prefixes are made of rare columns. m is a tenth of
the size (the smaller of two sizes counts), which tells copies from documents that
merely share a passage. Steps:

1. ``profile``: each document's set size and class key; shingles that are frequent
   in a batch are counted, and the ``HEAVY`` most frequent (a fixed number, so a
   bounded broadcast) fix the column order. Any order gives the same links.
2. ``columns``: the prefix columns of every class, dealt by column. A column of one
   class is dropped, and then a class that shares fewer columns with all others
   together than it must share with a single partner of any size (twice, since columns
   go with their classes). Two classes that share enough columns may link; whatever hangs
   together by such pairs is a *cluster*, and all links lie inside clusters. Pairs are
   found in two steps. First every class of a column is counted against one class of it, its
   pivot (the least by hash, so a group of near copies has one pivot nearly everywhere);
   the counts summed by pair cost one row for each class and column. Columns whose classes
   are all in one cluster by then are done: in a group of near copies that is every one.
   In the columns left, classes compare the names of all such columns they have.
3. Blocks: a cluster of up to ``BLOCK_ROWS`` classes is a block, and its classes
   fetch their sets once. A larger cluster falls into one block for each of its
   distinct columns. Within a block the product of the incidence matrix with its
   transpose is taken one row against all rows not yet reached: overlaps are
   accumulated over the row's shingles, rows whose size or largest possible overlap
   is below the bound are skipped, and a linked row is reached. As linked rows join
   the row's component at once, only a spanning forest leaves the block, never all pairs.
4. ``components``: links of all blocks joined by large-star and small-star rounds.

A column that holds more than ``BLOCK_ROWS`` classes is dealt to the cells of a
grid: its classes fall by hash into g groups, and each pair of groups meets in one
cell, so every pair of classes still meets while no cell holds more than about
2 * ``BLOCK_ROWS`` rows. How many classes a frequent column has is estimated from
the counts of step 1, before anything is shuffled.

Class keys and shingles are 64-bit hashes; two different sets are taken for one
with a probability near 2^-64 a pair.

Results for odd input: a null or empty text, or one without words, has the empty set
and is linked with nothing; a text of fewer than k words has one shingle, all its
words. Null ids are ignored when a component's smallest id is looked for (a
component of null ids only has a null id). Repeated rows are copies like others,
one result row each. Extra columns are never touched.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.llm import words as W
from barsmith.llm.frames import complete_runs, most_frequent, pick, run_starts, stage

#: Frequent shingles that order the columns (12 bytes each in the broadcast).
HEAVY = 200_000
#: Rows of a batch in which a shingle must occur to be counted as frequent.
SEEN = 2
#: Classes of one column that a block takes; larger columns are dealt to a grid.
BLOCK_ROWS = 8192


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, shingles sorted within rows, row ranges) for slices of a text column."""
    data, offsets = W.buffers(column)
    for i, j in W.slices(offsets):
        shingles, rows = W.grams(W.find(data, offsets[i:j + 1], lower=True), k)
        yield i, *W.sorted_sets(shingles, rows)


def _class_keys(shingles: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A key of each row's set: order-free sum of mixed shingles, mixed with the size; 0 for the empty set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(shingles), dtype=np.uint64)])
    n = np.diff(rows)
    keys = W.mix(total[rows[1:]] - total[rows[:-1]] + n.astype(np.uint64))
    return np.where(n > 0, keys, np.uint64(0)).view(np.int64)


def profile(docs: DataFrame, k: int) -> DataFrame:
    """Rows (kind 0: id, key = class, n = set size) and (kind 1: key = shingle, n = rows of a batch that hold it)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, often, counts = [], [], [], []
            for _, shingles, rows in _sets(batch.column(1), k):
                keys.append(_class_keys(shingles, rows))
                sizes.append(np.diff(rows))
                # one count per class: copies are one row of the matrix
                _, at = np.unique(keys[-1], return_index=True)
                pick_rows = np.zeros(len(rows) - 1, bool)
                pick_rows[at] = True
                value, count = np.unique(shingles[np.repeat(pick_rows, np.diff(rows))], return_counts=True)
                often.append(value[count >= SEEN].view(np.int64))
                counts.append(count[count >= SEEN])
            key, n, value, count = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, sizes, often, counts))
            ids = pa.concat_arrays([batch.column(0), pa.nulls(len(value), batch.column(0).type)])
            kind = np.repeat([0, 1], [len(key), len(value)])
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), ids, pa.array(np.concatenate([key, value])), pa.array(np.concatenate([n, count]), pa.int64())],
                                             ["kind", "id", "key", "n"])

    return docs.mapInArrow(run, f"kind int, id {dict(docs.dtypes)['id']}, key long, n long")


def _bound(n: np.ndarray, share: Fraction) -> np.ndarray:
    """ceil(share * n) for whole numbers."""
    return -(-n * share.numerator // share.denominator)


def _shared_at_least(n: np.ndarray) -> np.ndarray:
    """Columns that two sets of at least ``n`` shingles must share in their prefixes."""
    return np.maximum(1, n // 10)


def columns(docs: DataFrame, k: int, share: Fraction, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Prefix columns of every class: (col, class), large columns spread over the cells of their grid."""
    sent = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, count = sent.value
        seen: set[int] = set()
        for batch in batches:
            for _, shingles, rows in _sets(batch.column(1), k):
                key, n = _class_keys(shingles, rows), np.diff(rows)
                fresh = n > 0
                for i, x in enumerate(key.tolist()):  # copies met before add nothing
                    if x in seen:
                        fresh[i] = False
                    else:
                        seen.add(x)
                if len(seen) > 1_000_000:
                    seen.clear()
                row = np.repeat(np.arange(len(n)), n)
                keep = fresh[row]
                shingle, row = shingles[keep], row[keep]
                if not len(row):
                    continue
                weight = np.zeros(len(shingle), np.int64)
                if len(value):
                    at = np.minimum(np.searchsorted(value, shingle), len(value) - 1)
                    weight = np.where(value[at] == shingle, count[at], 0)
                order = np.lexsort((shingle, weight, row))
                shingle, row, weight = shingle[order], row[order], weight[order]
                begin = np.concatenate([[0], np.cumsum(np.where(fresh, n, 0))[:-1]])
                place = np.arange(len(row)) - begin[row]
                first = place < (n - _bound(n, share) + _shared_at_least(n))[row]
                col, cls, weight = shingle[first], key[row[first]], weight[first]
                grid = -(-weight // BLOCK_ROWS)
                one = grid <= 1
                yield _pairs(col[one].view(np.int64), cls[one], "col", "class")
                for g in np.unique(grid[~one]):
                    mine = grid == g
                    group = W.mix(cls[mine].view(np.uint64)) % np.uint64(g)
                    for other in range(int(g)):
                        cell = np.minimum(group, np.uint64(other)) * np.uint64(g) + np.maximum(group, np.uint64(other)) + np.uint64(1)
                        yield _pairs(W.mix(col[mine] ^ W.mix(cell)).view(np.int64), cls[mine], "col", "class")

    return docs.mapInArrow(run, "col long, class long")


def _pairs(a: np.ndarray, b: np.ndarray, *names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], list(names))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns (sorted by col, class) that at least two classes share, named by their set of classes; ``n`` columns have that set."""
    for table in complete_runs(batches, "col"):
        col, cls = table.column("col").to_numpy(), table.column("class").to_numpy()
        keep = np.ones(len(col), bool)
        keep[1:] = (col[1:] != col[:-1]) | (cls[1:] != cls[:-1])
        col, cls = col[keep], cls[keep]
        begin = run_starts(col)
        size = np.diff(np.append(begin, len(col)))
        name = W.mix(np.add.reduceat(W.mix(cls.view(np.uint64)), begin) + size.astype(np.uint64))
        # Columns with the same classes are one: only the set counts.
        _, first, alike = np.unique(name, return_index=True, return_counts=True)
        use = np.zeros(len(begin), np.int64)
        use[first] = alike
        use[size < 2] = 0
        many = np.repeat(use, size)
        at = many > 0
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, size)[at].view(np.int64)), pa.array(cls[at]), pa.array(many[at])], ["block", "class", "n"])


def _pruned(members: DataFrame, share: Fraction) -> DataFrame:
    """``members`` without the classes that share too few columns to have a partner, and without columns left with one class."""
    least = f"greatest(1, ((n_shingles * {share.numerator} + {share.denominator - 1}) div {share.denominator}) div 10)"
    held = members.groupBy("class").agg(F.sum("n").alias("held"), F.max("n_shingles").alias("n_shingles"))
    left = members.join(held.where(f"held >= {least}").select("class"), "class", "left_semi")
    return left.join(left.groupBy("block").count().where("count > 1").select("block"), "block", "left_semi")


def _fetch(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(block, class, shingles binary) for every class and block of ``wanted`` (id, class, blocks)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want, blocks = batch.column(2).to_numpy(), batch.column(3)
            for i, shingles, rows in _sets(batch.column(1), k):
                key = _class_keys(shingles, rows)
                out: list[tuple[int, int, bytes]] = []
                size = 0
                for r in np.flatnonzero(key == want[i:i + len(key)]):  # an id may stand for other texts, too
                    packed = shingles[rows[r]:rows[r + 1]].tobytes()
                    for b in blocks[i + int(r)].as_py():
                        out.append((b, int(key[r]), packed))
                        size += len(packed)
                        if size > W.SLICE:
                            yield _sets_batch(out)
                            out, size = [], 0
                if out:
                    yield _sets_batch(out)

    return docs.join(wanted, "id").select("id", "text", "class", "blocks").mapInArrow(run, "block long, class long, shingles binary")


def _sets_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, c, s = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.binary())], ["block", "class", "shingles"])


def _forest(sets: list[np.ndarray], sizes: np.ndarray, share: Fraction, linked, weight: dict[int, int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among some sets: row by row of the product of their incidence matrix.

    The matrix is held by columns; a row's overlaps with all others are the (weighted)
    counts of its columns' rows. Only rows that are not yet reached and whose size is
    within the bound are looked at; ``linked(x, overlaps)`` says which of them link.
    """
    n = len(sets)
    own = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    row = np.repeat(np.arange(n), own)
    order = np.argsort(every, kind="stable")
    every, row = every[order], row[order]
    begin = run_starts(every)
    width = np.diff(np.append(begin, len(every)))
    row = row.astype(np.int32)
    number = np.empty(len(every), np.int32)  # column of each entry, by rows
    number[order] = np.repeat(np.arange(len(begin), dtype=np.int32), width)
    heavy = np.array([weight[x] for x in every[begin].tolist()]) if weight else None
    at = np.concatenate([[0], np.cumsum(own)])
    unreached = np.ones(n, bool)
    links: list[tuple[int, int]] = []
    for seed in np.argsort(sizes, kind="stable"):
        if not unreached[seed]:
            continue
        unreached[seed] = False
        frontier = [int(seed)]
        while frontier:
            x = frontier.pop()
            if not unreached.any():
                return links
            cols = number[at[x]:at[x + 1]]
            cols = cols[width[cols] > 1]
            # Size bound first: a partner's size lies between share * n and n / share.
            ok = unreached & (sizes * share.denominator >= sizes[x] * share.numerator) & (sizes * share.numerator <= sizes[x] * share.denominator)
            if not len(cols) or not ok.any():
                continue
            span = width[cols]
            where = np.repeat(begin[cols] - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())
            both = np.bincount(row[where], None if heavy is None else np.repeat(heavy[cols], span), minlength=n)
            hit = np.flatnonzero(ok & linked(x, both))
            unreached[hit] = False
            links += [(x, int(y)) for y in hit]
            frontier += hit.tolist()
    return links


def block_links(sets: list[np.ndarray], share: Fraction) -> list[tuple[int, int]]:
    """A spanning forest of the sets of similarity ``share`` or more."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:  # the common case, without a matrix
        small, large = int(sizes.min()), int(sizes.max())
        if share.denominator * small < share.numerator * large:
            return []
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if share.denominator * both >= share.numerator * (small + large - both) else []
    return _forest(sets, sizes, share, lambda x, both: both * share.denominator >= share.numerator * (sizes + sizes[x] - both))


def _pivot_pairs(members: DataFrame, share: Fraction) -> DataFrame:
    """(a, b, h): classes and the pivot of some of their columns, where the two share enough columns and have fitting sizes; ``h`` orders pivots."""
    pivot = F.min(F.struct(F.xxhash64("class").alias("h"), F.col("class").alias("pivot"), F.col("n_shingles").alias("pivot_size")))
    pivots = members.groupBy("block").agg(pivot.alias("p")).select("block", "p.*")
    met = members.join(pivots, "block").where("class != pivot")
    both = met.groupBy("class", "pivot").agg(F.sum("n").alias("both"), F.max("n_shingles").alias("size"), F.max("pivot_size").alias("pivot_size"), F.max("h").alias("h"))
    num, den = share.numerator, share.denominator
    fits = f"size * {den} >= pivot_size * {num} and pivot_size * {den} >= size * {num} and both >= greatest(1, least(size, pivot_size) div 10)"
    return both.where(fits).select(F.col("class").alias("a"), F.col("pivot").alias("b"), "h")


def _open_columns(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``members`` of the columns whose classes do not all hang on one pivot.

    A class hangs on the least of the pivots it is paired with, the pivot of a column being its
    least class: the least class of a group of near copies is the one for the whole group.
    """
    hangs = pairs.groupBy("a").agg(F.min(F.struct("h", "b"))["b"].alias("root"))
    named = members.join(hangs, members["class"] == hangs["a"], "left").select("block", F.coalesce("root", "class").alias("cluster"))
    mixed = named.groupBy("block").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi")).where("lo != hi").select("block")
    return members.join(mixed, "block", "left_semi")


def _near(share: Fraction):
    """Rows (block, class, n_shingles, names, counts) sorted by block to links of classes that share enough columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in complete_runs(batches, "block", rows=20_000):
            table = table.combine_chunks()
            block, cls, size = (table.column(c).to_numpy() for c in ("block", "class", "n_shingles"))
            names, counts = (table.column(c).combine_chunks() for c in ("names", "counts"))
            off = names.offsets.to_numpy()
            name, count = names.values.to_numpy(), counts.values.to_numpy()
            a, b = [], []
            for i, j in itertools.pairwise([*run_starts(block), len(block)]):
                if j - i < 2:
                    continue
                least, sizes = _shared_at_least(size[i:j]), size[i:j]
                part = slice(off[i], off[j])
                found = _forest([name[off[r]:off[r + 1]] for r in range(i, j)], sizes, share,
                                lambda x, both: both >= np.minimum(least, least[x]), dict(zip(name[part].tolist(), count[part].tolist(), strict=True)))  # noqa: B023
                a += [int(cls[i + y]) for _, y in found]
                b += [int(cls[i + x]) for x, _ in found]
            yield _pairs(np.array(a, np.int64), np.array(b, np.int64), "a", "b")
    return run


def _links(share: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in complete_runs(batches, "block", rows=4096):
            block, cls = table.column("block").to_numpy(), table.column("class").to_numpy()
            data, off = W.buffers(table.column("shingles"))
            data = data[off[0]:off[-1]]
            if data.ctypes.data % 8:  # a view of 64-bit numbers needs their alignment
                data = data.copy()
            values = data.view(np.uint64)
            off = (off - off[0]) // 8
            a, b = [], []
            for i, j in itertools.pairwise([*run_starts(block), len(block)]):
                mine, first = np.unique(cls[i:j], return_index=True)  # repeated rows of one id
                if len(mine) < 2:
                    continue
                sets = [values[off[i + r]:off[i + r + 1]] for r in first]
                root = list(range(len(mine)))  # a forest's edges lead away from its seed, so one look back suffices
                seen = []
                for x, y in block_links(sets, share):
                    root[y] = root[x]
                    seen.append(y)
                a += [int(mine[y]) for y in seen]
                b += [int(mine[root[y]]) for y in seen]
            yield _pairs(np.array(a, np.int64), np.array(b, np.int64), "a", "b")
    return run


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b): the smallest node of its component.

    Large-star joins each node's larger neighbours to its smallest, small-star the
    smaller ones; both keep the components, and the rounds end when every node hangs
    on its root. A hub's neighbours are aggregated map-side and joined back, never
    collected into a list.
    """
    edges = stage(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    mark = None
    for _ in range(rounds):
        both = edges.union(edges.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        # every edge now points from the larger node down; small-star on it
        down = large.union(least.where("a != m").select("a", F.col("m").alias("b"))).distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage(small.union(low.select("a", F.col("m").alias("b"))).where("a != b").distinct(), "star")
        now = edges.agg(F.count(F.lit(1)), F.count_distinct("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def jaccard_join(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    Two documents link when 100 * intersection >= ``percent`` * union of their sets of ``k``-word shingles.
    """
    share = Fraction(percent, 100)
    narrow = pick(docs, id=id_col, text=text_col)
    narrow = narrow.withColumn("text", F.col("text").cast("string"))
    rows = stage(profile(narrow, k), "profile")
    sets = rows.where("kind = 0").select("id", F.col("key").alias("class"), F.col("n").alias("n_shingles"))
    counted = stage(rows.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")), "frequent")
    frequent = most_frequent(counted, "n", HEAVY).toPandas()  # at most HEAVY rows
    value = frequent["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(value)
    heavy = value[order], frequent["n"].to_numpy(np.int64)[order]

    classes = stage(sets.where("n_shingles > 0").groupBy("class").agg(F.min("id").alias("id"), F.max("n_shingles").alias("n_shingles")), "classes")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = (columns(narrow, k, share, heavy).repartition(parts, "col").sortWithinPartitions("col", "class")
              .mapInArrow(_shared, "block long, class long, n long"))
    members = stage(shared.groupBy("block", "class").agg(F.sum("n").alias("n")), "columns")
    sized = members.join(classes.select("class", "n_shingles"), "class")
    members = stage(_pruned(_pruned(sized, share), share), "pruned")
    pivots = stage(_pivot_pairs(members, share), "pivots")
    # What is left of a class's columns travels to each of them, under names of 31 bits: two
    # columns of one name would only make a candidate, which the sets themselves then decide.
    open_members = stage(_open_columns(members, pivots), "open")
    name = F.col("block").bitwiseAND(0x7FFFFFFF).cast("int")
    lists = open_members.groupBy("class").agg(F.collect_list(F.struct(name.alias("name"), F.col("n").cast("int").alias("n"))).alias("own")).select(
        "class", F.col("own.name").alias("names"), F.col("own.n").alias("counts"))
    compared = open_members.join(lists, "class").select("block", "class", "n_shingles", "names", "counts")
    pairs = compared.repartition(parts, "block").sortWithinPartitions("block", "class").mapInArrow(_near(share), "a long, b long")
    near = components(pairs.union(pivots.select("a", "b")))
    clusters = stage(near.union(near.select("root", "root").distinct()).toDF("class", "cluster"), "clusters")
    large = stage(clusters.groupBy("cluster").count().where(F.col("count") > BLOCK_ROWS).select("cluster"), "large")
    some_large = not large.isEmpty()
    blocks = clusters.select("class", F.array("cluster").alias("blocks"))
    if some_large:  # by columns, each a block of its own
        wide = clusters.join(large, "cluster", "left_semi").select("class")
        blocks = (clusters.join(large, "cluster", "left_anti").select("class", F.array("cluster").alias("blocks"))
                  .union(members.join(wide, "class", "left_semi").groupBy("class").agg(F.collect_list("block").alias("blocks"))))
    # A class fetches its set through one document that has it; the smallest id, if there is one.
    wanted = blocks.join(classes.where("id is not null"), "class").select("id", "class", "blocks")
    fetched = _fetch(narrow, wanted, k)
    links = fetched.repartition(parts, "block").sortWithinPartitions("block", "class").mapInArrow(_links(share), "a long, b long")
    if some_large:
        roots = components(links)
    else:  # a block has whole components, and their forests are stars
        roots = links.toDF("node", "root")
    named = (classes.join(roots, classes["class"] == roots["node"], "left")
             .select("class", "id", F.coalesce("root", "class").alias("root")))
    smallest = named.groupBy("root").agg(F.min("id").alias("component_id"))
    of_class = stage(named.join(smallest, "root").select("class", "component_id"), "components")
    filled = sets.where("n_shingles > 0").join(of_class, "class", "left").select("id", "n_shingles", "component_id")
    empty = sets.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    return filled.unionByName(empty).select(F.col("id").alias(id_col), "n_shingles", "component_id")


def distinct_documents(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of each component; of rows with equal ids one stays.

    Rows with a null id are in no component that could name them; all of them stay.
    """
    found = jaccard_join(docs, k, percent, id_col, text_col)
    keep = found.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("id")).distinct()
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key = f"c{names.index(id_col)}"
    one = plain.join(keep, plain[key] == keep["id"], "left_semi").dropDuplicates([key])
    return one.unionByName(plain.where(plain[key].isNull())).toDF(*names)
