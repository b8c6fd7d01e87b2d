"""Merkle manifest, conversation repair and toxicity against brute-force versions."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from barsmith.llm import conversations as C
from barsmith.llm import merkle, queries, toxicity

SMALL = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


# -- Merkle manifest ----------------------------------------------------------------

def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def way(levels, at):
    for level in levels[:-1]:
        yield at % 16, level[at - at % 16:][:16]
        at //= 16


def manifest_brute(rows):
    """rows of (doc_id, source, lang, n_chars, text) -> sorted result rows."""
    by = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, sha("".join(map(field, r))))):
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([sha("".join(map(field, r))) for r in by[s]]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for i, s in enumerate(order):
        for j, r in enumerate(by[s]):
            path = [*way(trees[s], j), *way(top, i)]
            hit = zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 5 == 0 and r[4] is not None
            node = sha("".join(map(field, (*r[:4], r[4].translate(UPPER)) if hit else r)))
            for place, run in path:
                node = sha("".join([*run[:place], node, *run[place + 1:]]))
            proof = sha("".join(d for place, run in path for k, d in enumerate(run) if k != place))
            out.append((r[0], trees[s][0][j], trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=repr)


def manifest(docs, levels=merkle.LEVELS):
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    out = merkle.merkle_manifest(docs, changed={"text": merkle.lower_ascii(F.col("text"))}, where=crc % 5 == 0, levels=levels)
    return sorted((tuple(r) for r in out.collect()), key=repr)


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def test_manifest_matches_brute_force(spark):
    rows = duckdb.sql(f"SELECT doc_id, source, lang, n_chars, text FROM '{SMALL}/documents.parquet'").fetchall()
    got = sorted((tuple(r) for r in queries.op11_merkle_manifest(spark, SMALL).collect()), key=repr)
    assert got == manifest_brute(rows)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_of_a_hot_source_over_many_exchanges(spark, levels):
    rng = random.Random(levels)
    rows = [(i, "hot" if i % 3 else rng.choice([None, "", "é", "b", f"s{i}"]), None, i % 7 or None, f"Text {i} Ö") for i in range(1400)]
    rng.shuffle(rows)
    assert manifest(spark.createDataFrame(rows, DOCS).repartition(5), levels) == manifest_brute(rows)


def test_manifest_odd_rows(spark, nothing):
    rows = [(1, "a", "en", 1, "X"), (1, "a", "en", 1, "X"), (1, "a", "en", 2, "Y"), (None, "a", None, None, None), (None, None, None, None, "Q" * 200_000),
            (2, None, "", 0, ""), (3, "A", "en", 5, "a:b-")]
    plain = spark.createDataFrame(rows, DOCS)
    clash = plain.select("*", F.lit(1).alias("tree"), F.lit("x").alias("node"), F.lit(2).alias("pos"), F.lit("y").alias("TEXT"), F.lit(0).alias("block"))
    assert manifest(clash) == manifest(plain) == manifest_brute(rows)
    assert manifest(nothing) == []
    one = [(7, "s", "en", 1, "Z")]
    assert manifest(spark.createDataFrame(one, DOCS)) == manifest_brute(one)


def test_proofs_lead_to_the_root(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = merkle.merkle_proofs(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert all(run[place] for place, run in zip(r["places"], r["runs"]))
        assert merkle.fold(r["leaf"], r["places"], r["runs"]) == r["root"]
        assert not r["runs"] or r["runs"][0][r["places"][0]] == r["leaf"]


# -- conversation repair ----------------------------------------------------------------

GOAL = re.compile(r"(s?(ua)+)?")


def cheapest(kinds):
    """Cheapest audit by a search from the end over whole strings: independent of the operator's order."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @functools.cache
    def best(i, state, inserted):
        options = [(0, "")] if i == len(kinds) and state in (0, 3) else []

        def then(cost, letter, *to):
            rest = best(*to)
            if rest is not None:
                options.append((cost + rest[0], letter + rest[1]))
        if i < len(kinds):
            initial, fault = kinds[i]
            then(2, "D", i + 1, state, 0)
            if fault != C.UNFIT:
                for (a, r), b in step.items():
                    if a == state and (r == initial or r in "ua"):
                        then((r != initial) + 5 * (fault == C.TRUNCATED), "K" if r == initial else "R", i + 1, b, 0)
        if inserted < 4:
            for (a, r), b in step.items():
                if a == state and r in "ua":
                    then(5, "I", i, b, inserted + 1)
        return min(options, default=None)
    return best(0, 0, 0)


def test_audits_match_a_search_of_whole_strings():
    rng = random.Random(12)
    for size in range(8):
        for _ in range(150):
            kinds = [(rng.choice("suaux"), rng.choice([0, 0, 0, 1, 2])) for _ in range(size)]
            ends = C.audits(kinds, C.START, True)
            assert min(ends[s] for s in C.FINAL if ends[s]) == cheapest(kinds), kinds


def test_audits_match_all_strings():
    """Every string of letters over a few rows, tried one by one."""
    rng = random.Random(3)
    for _ in range(40):
        kinds = [(rng.choice("sua"), rng.choice([0, 0, 1, 2])) for _ in range(rng.randrange(4))]
        found = []
        for n in range(len(kinds) + 4):
            for letters in itertools.product("DIKR", repeat=n):
                if sum(x != "I" for x in letters) != len(kinds):
                    continue
                # Each R and I may be a user or an assistant turn.
                cost, parts, rest, ok = 0, [], iter(kinds), True
                for x in letters:
                    if x == "I":
                        cost, parts = cost + 5, [*parts, "ua"]
                        continue
                    initial, fault = next(rest)
                    if x == "D":
                        cost += 2
                        continue
                    ok = ok and fault != C.UNFIT
                    cost += (x == "R") + 5 * (fault == C.TRUNCATED)
                    parts.append("ua" if x == "R" else initial)
                if ok and any(GOAL.fullmatch("".join(p)) for p in itertools.product(*parts)):
                    found.append((cost, "".join(letters)))
        ends = C.audits(kinds, C.START, True)
        assert min(ends[s] for s in C.FINAL if ends[s]) == min(found)


def test_prefix_order_survives_hash_collisions():
    rng = random.Random(4)
    for modulus in (C.MODULUS, 3):
        tree_ = C.Prefixes(modulus=modulus)
        nodes = [0]
        for _ in range(400):
            nodes.append(tree_.add(rng.choice(nodes[-30:]), rng.choice("DIKR")))
        for _ in range(3000):
            a, b = rng.choice(nodes), rng.choice(nodes)
            assert tree_.less(a, b) == (tree_.text(a) < tree_.text(b))


def repair_brute(rows, damaged=True):
    """rows of (conv_id, turn, role, text) -> {conv: result} by plain code."""
    by = {}
    for conv, turn, role, text in rows:
        have = by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 9
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        have += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))  # no two texts of a turn and role differ here
        kinds, n = [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for i, (_, role, text) in enumerate(turns):
            words = re.sub(r"[\x20\x09-\x0D]", "", text)
            name = "blank" if not words else "duplicate" if (role, text) in [t[1:] for t in turns[:i]] else "truncated" if words[-1] not in ".!?" else None
            if name:
                n[name] += 1
            kinds.append((role[:1], {None: C.OK, "truncated": C.TRUNCATED}.get(name, C.UNFIT)))
        cost, audit = cheapest(tuple(kinds))
        rest, lines, state = iter(turns), [], "a"
        for x in audit:
            _, role, text = (0, "", "") if x == "I" else next(rest)
            if x == "D":
                continue
            if x != "K":
                role = "assistant" if state == "u" else "user"
            state = role[:1]
            lines.append(f"{role}:{text}")
        seen = {t for t, _, _ in turns if t is not None}
        out[conv] = (max(seen) - min(seen) + 1 - len(seen) if seen else 0, *n.values(),
                     sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:])), cost, audit, sha("\n".join(lines)))
    return out


def as_dict(df):
    rows = df.collect()
    out = {r[0]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


TURNS = "conv_id long, turn long, role string, text string"


def test_repair_matches_brute_force(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SMALL}/conversations.parquet'").fetchall()
    assert as_dict(queries.op12_audit_repair(spark, SMALL)) == repair_brute(rows)


def made_turns(rng, conversations, longest):
    rows = []
    for c in range(conversations):
        for t in range(rng.randrange(1, longest)):
            if rng.random() < 0.9:
                rows.append((c, t, rng.choice(["user", "assistant", "system", "tool", "user", "assistant"]),
                             rng.choice(["Yes.", "No", "", " \t", "Why?", f"Text {t}.", f"Text {c} {t}"])))
    return rows


@pytest.mark.parametrize("piece", [2, 7, 1 << 14])
def test_long_conversations_in_pieces(spark, piece):
    """Conversations over many parts and pieces, and pieces by bytes, give what whole ones give."""
    rows = made_turns(random.Random(piece), 25, 120)
    frame = spark.createDataFrame(rows, TURNS).repartition(6)
    for size in (1 << 24, 40):
        picked = C.damage(frame.toDF("conv", "turn", "role", "text"))
        assert as_dict(C.repair(picked, piece_rows=piece, piece_bytes=size)) == repair_brute(rows)


def test_repair_odd_rows(spark):
    rows = [(None, 1, "user", "Hello."), (None, None, None, None), (None, 2, "assistant", None), (4, None, "user", "a."), (4, None, "user", "a."),
            (5, 3, "user", "Q" * 200_000), (5, 9, "assistant", "ok."), (6, 1, "", ""), (7, 5, "system", "s."), (7, 5, "User", "no."), (8, 1, None, "x.")]
    frame = spark.createDataFrame(rows, TURNS)
    clash = frame.select("*", F.lit(1).alias("conv"), F.lit(True).alias("live"), F.lit("p").alias("piece"), F.lit("a").alias("audit"), F.lit("b").alias("TEXT"))
    for damaged in (False, True):
        want = repair_brute(rows, damaged)
        assert as_dict(C.conversation_repair(clash, damaged=damaged)) == want
    assert C.conversation_repair(frame.limit(0)).collect() == []
    # All rows dropped: zeros, an empty audit and the digest of nothing.
    gone = spark.createDataFrame([(9, 0, "user", "x.", False), (9, 1, "user", "y.", False)], "conv long, turn long, role string, text string, live boolean")
    assert as_dict(C.repair(gone)) == {9: (0, 0, 0, 0, 0, 0, "", sha(""))}


# -- toxicity ---------------------------------------------------------------------------

def features_brute(text):
    """Distinct words, neighbour pairs and skip pairs of a text."""
    ws = re.findall(rb"[0-9a-z\x80-\xff]+", text.translate(UPPER).encode())
    return {(0, w) for w in ws} | {(1, a, b) for a, b in zip(ws, ws[1:])} | {(2, a, b) for a, b in zip(ws, ws[2:])}


def test_features_are_words_pairs_and_skip_pairs():
    import pyarrow as pa
    texts = ["", "one", "One two", "a b c a b c, A-b", "naïve ünï. x1 y2 naïve", "z " * 3000]
    rows = {}
    for i, j, row, at in toxicity._feature_rows(pa.array([*texts, None]), 24):
        for r, a in zip(row.tolist(), at.tolist()):
            rows.setdefault(i + r, set()).add(a)
    for i, text in enumerate(texts):
        assert len(rows.get(i, set())) == len(features_brute(text))
    alone = {a for _, _, _, at in toxicity._feature_rows(pa.array(["one"]), 24) for a in at.tolist()}
    assert alone <= {a for _, _, _, at in toxicity._feature_rows(pa.array(["two ONE three"]), 24) for a in at.tolist()}


def test_learner_follows_the_published_update():
    """One coordinate by hand: z += g - sigma w, n += g^2, w = -(z - sign(z) l1) / ((beta + sqrt n) / alpha + l2)."""
    import math

    import numpy as np
    s = toxicity.Settings(bits=4, alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    model = toxicity.Ftrl(s)
    z = {3: 0.0, 16: 0.0}
    n = {3: 0.0, 16: 0.0}

    def weight(i):
        l1 = 0.0 if i == 16 else s.l1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)
    for label in (1, 1, 0, 1, 0, 0, 1):
        w = {i: weight(i) for i in z}
        p = 1 / (1 + math.exp(-sum(w.values())))
        assert model.learn(np.array([3], np.int32), label) == pytest.approx(p)
        g = p - label
        for i in z:
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / s.alpha * w[i]
            n[i] += g * g
    assert model.weights(np.array([3, 16])) == pytest.approx([weight(3), weight(16)])


def test_held_out_accuracy(spark):
    """On rows that were not learned from: labelled clean ones stay, most labelled toxic ones are caught."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = queries.op13_ftrl_toxicity(spark, sf).join(labels, "doc_id").where("held_out").groupBy("toxic").agg(F.avg("predicted"), F.count("*")).collect()
    share = {r[0]: r[1] for r in out}
    assert share[0] <= 0.005 and share[1] >= 0.75


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(toxicity.is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit_toxicity(docs, labels), toxicity.fit_toxicity(docs, flipped)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) != []


def test_toxicity_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, None), (None, 1), (8, 0), (99, 1)], "doc_id long, toxic int")
    weights = toxicity.fit_toxicity(odd, labels)
    out = toxicity.toxicity(odd, weights).collect()
    assert len(out) == odd.count()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], set()).add((r["score"], r["predicted"]))
        assert 0.0 <= r["score"] <= 1.0 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0)
    assert len(by[1]) == 1 and by[2] == by[3] == by[4] and by[5] == by[6]
    assert toxicity.toxicity(nothing, weights).collect() == []
    assert toxicity.toxicity(odd, toxicity.fit_toxicity(nothing, labels)).agg(F.max("score")).first()[0] == 0.0
    few = toxicity.training_rows(odd.select(F.col("doc_id").alias("id"), "text"), labels.toDF("id", "label"), max_rows=1)
    assert few.select("id").distinct().count() == 1
