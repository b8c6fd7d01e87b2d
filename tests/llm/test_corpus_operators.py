"""Operators over the whole corpus: decontamination, dedup, joins, language model, BPE, pages, pipeline."""

import base64
import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import brute
import corpus_pipeline
from barsmith.llm import byte_bpe, class_lm, decontaminate, html_text, jaccard_join, quality_rules, substring_dedup
from barsmith.llm import words as W
from barsmith.llm.frames import pick

SMALL = "/root/testdata/sf0.001"
TIKTOKEN = public_tokenizers.path("byte_bpe_50k.tiktoken")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def made(spark):
    """Near copies, shared passages, loops and odd texts with distinct ids."""
    rng = random.Random(5)
    base = [[rng.choice("abcdefghij") for _ in range(60)] for _ in range(8)]
    rows = []
    for i in range(300):
        ws = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            ws[rng.randrange(len(ws))] = rng.choice("abcdefghijxyz")
        ws = ws[rng.choice([0, 0, 0, 10, 30]):]
        if rng.random() < 0.2:
            ws += rng.choice(base)[:rng.randrange(40)]
        if rng.random() < 0.05:
            ws = ["z"] * rng.randrange(50)
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(ws)))
    rows += [(1000, None), (1001, ""), (1002, "  "), (1003, "A b"), (1004, "a B"), (1005, "x " * 3000), (1006, "x " * 3000)]
    return rows


@pytest.fixture(scope="module")
def made_docs(spark, made):
    return spark.createDataFrame(made, "doc_id long, text string").repartition(7)


def contamination(text, items):
    ws = ITEM_WORD.findall((text or "").translate(brute.LOWER))
    hit, found = set(), set()
    for item, t in items:
        iw = ITEM_WORD.findall((t or "").translate(brute.LOWER))
        k = min(10, len(iw))
        for i in range(len(iw) - k + 1) if k else ():
            for j in range(len(ws) - k + 1):
                if ws[j:j + k] == iw[i:i + k]:
                    hit.update(range(j, j + k))
                    found.add(item)
    return len(ws), len(hit), sorted(found)


def test_decontamination_against_plain_search(spark, odd):
    rng = random.Random(2)
    pool = "alpha beta Gamma delta épsilon zeta eta 42 theta-iota kappa".split()
    items = [(n, " ".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 3, 10, 14])))) for n in range(30)] + [(77, None), (5, "alpha, beta. ALPHA")]
    docs = [(i, " ".join(rng.choice([*pool, "other", "!!"]) for _ in range(rng.randrange(120)))) for i in range(25)]
    docs += [(100 + i, f"Before; {t or ''}, after") for i, (_, t) in enumerate(items)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i: contamination(t, items) for i, t in docs}
    for size in (32 << 20, 300):  # one automaton, and several
        for r in decontaminate.decontaminate(table, bench, pattern_bytes=size).collect():
            n, hit, found = want[r.doc_id]
            names = sorted(map(str, found))
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(names), hit > 0)
            assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
            text = dict(docs)[r.doc_id]
            assert sum(len(ITEM_WORD.findall(text[s.begin:s.end].translate(brute.LOWER))) for s in r.spans) == hit
    clean = decontaminate.clean_documents(odd, bench)
    assert clean.columns == odd.columns and clean.count() == odd.count()


def test_decontamination_of_empty_tables(spark, odd, nothing):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(odd, bench).where("contaminated").count() == 0
    assert decontaminate.decontaminate(nothing, bench).collect() == []


def test_substring_dedup_against_all_windows(made_docs, made, monkeypatch):
    want = brute.substring_dedup(made)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(made_docs).collect()} == want
    monkeypatch.setattr(substring_dedup, "BUSY", 3)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(made_docs, blocks=3).collect()} == want


def test_windows_that_share_32_bits_stay_apart():
    import pyarrow as pa

    def judge(*hashes):
        n = len(hashes)
        batch = pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array([5] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([0] * n, pa.int64()),
                                            pa.array([1] * n, pa.int32()), pa.array([np.uint64(h).tobytes() for h in hashes], pa.binary())],
                                           ["block", "key", "id", "start", "mask", "windows"])
        return [i for part in substring_dedup._judge([batch]) for i in part.column(1).to_pylist()]

    assert judge(7, 7 + (1 << 40), 7 + (1 << 63)) == []
    assert judge(7, 7 + (1 << 40), 7) == [2]


def test_substring_dedup_of_odd_rows(odd, nothing):
    rows = substring_dedup.substring_dedup(odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd.collect())
    by = {r.doc_id: r for r in rows}
    assert by[5].n_removed == 0 and by[6].n_removed == by[6].n_words == 20_000
    assert by[8].n_removed == 399  # the first window stays but for what the second covers
    cut = substring_dedup.dedup_documents(odd, length_col=None)
    assert cut.columns == odd.columns
    assert {r.doc_id for r in cut.collect()} == {r.doc_id for r in rows} - {6}
    assert substring_dedup.substring_dedup(nothing).collect() == []
    assert substring_dedup.dedup_documents(nothing).collect() == []


def test_cut_text_keeps_its_white_space(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"start\n{passage}\nend", 0), (2, f"one  two\n{passage}\tthree  four", 0)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in substring_dedup.dedup_documents(docs).collect()}
    assert got == {1: (f"start\n{passage}\nend", 0), 2: ("one  two\nthree  four", 20)}


@pytest.mark.parametrize("percent", [85, 60])
@pytest.mark.parametrize("rows", [8192, 3])
def test_jaccard_components_against_all_pairs(made_docs, made, percent, rows, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(made_docs, 4, percent).collect()}
    assert got == brute.jaccard_components(made, 4, percent)


def test_block_forest_spans_the_links():
    rng = random.Random(1)
    sets = [{rng.randrange(30) for _ in range(rng.randrange(1, 20))} for _ in range(60)]
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    from fractions import Fraction

    links = jaccard_join.block_links(arrays, Fraction(1, 2))
    root = list(range(60))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        assert 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])
        assert find(a) != find(b)
        root[find(a)] = find(b)
    for a in range(60):
        for b in range(a):
            assert 2 * len(sets[a] & sets[b]) < len(sets[a] | sets[b]) or find(a) == find(b)


def test_jaccard_join_of_odd_rows(odd, nothing):
    rows = jaccard_join.jaccard_join(odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd.collect())
    by = {r.doc_id: r for r in rows if r.doc_id}
    assert by[6].component_id == 5 and by[3].n_shingles == 0 and by[3].component_id == 3
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    kept = jaccard_join.distinct_documents(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 7, 8, 9, 10]
    assert jaccard_join.jaccard_join(nothing).collect() == []


def plain_lm(rows):
    count, toks = Counter(), {}
    for i, t in rows:
        toks[i] = [*brute.WORD.findall((t or "").translate(brute.LOWER)), None]
        if zlib.crc32(str(i).encode()) % 5 != 1:
            count.update(toks[i])
    n, v = sum(count.values()), len(count)
    return {i: (zlib.crc32(str(i).encode()) % 5 == 1, len(ts), sum(count[w] > 0 for w in ts), n,
                sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ts)) for i, ts in toks.items()}


def test_language_model_counts_and_gain(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_lm(rows)
    got = class_lm.class_lm(docs, blocks=3).collect()
    assert len(got) == len(rows)
    for r in got:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_exchange_finds_the_planted_classes():
    rng = random.Random(8)
    n, first = 30, 2
    words = list(range(first, n))
    left, right = words[:14], words[14:]
    pairs = Counter()
    for _ in range(20_000):
        pairs[rng.choice(left) * n + rng.choice(right)] += 1
        pairs[rng.choice(right) * n + rng.choice(left)] += 1
    class_of = class_lm.exchange(np.array(list(pairs)), np.array(list(pairs.values())), n, first, classes=2)
    assert len({class_of[w] for w in left}) == len({class_of[w] for w in right}) == 1
    assert class_of[left[0]] != class_of[right[0]]


def test_words_outside_the_seed_get_the_class_of_their_neighbours(spark):
    rng = random.Random(9)
    first, second = ([f"{a}word{i:02d}" for i in range(40)] for a in "xy")  # one shape, each word rare
    rows = [(i, " ".join(f"p {rng.choice(['often', rng.choice(first)])} q r {rng.choice(['usual', rng.choice(second)])} s" for _ in range(6))) for i in range(60)]
    seen = {}
    original = class_lm.cluster

    def cluster(*a, **b):
        seen["out"] = original(*a, **b)
        return seen["out"]

    class_lm.cluster = cluster
    try:
        class_lm.class_lm(spark.createDataFrame(rows, "doc_id long, text string"), clustered=6, classes=6, blocks=3).collect()
    finally:
        class_lm.cluster = original
    classed, totals, n_open = seen["out"]
    class_of = {r.word: r.cls for r in classed.where("one and count > 0").collect()}
    word = {w: int(W.find(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]), lower=True).hash[:1].view(np.int64)[0]) for w in first + second}
    a, b = ({class_of[word[w]] for w in ws if word[w] in class_of} for ws in (first, second))
    assert len(a) == len(b) == 1 and a != b and 2 <= min(a | b) and max(a | b) < 2 + n_open
    assert totals[2 + n_open:].sum() == 0  # no training word is left in a class by shape


def test_transitions_and_emissions_sum_to_one(spark):
    docs = spark.createDataFrame([(i, f"a b c a d{i % 3}") for i in range(30)], "doc_id long, text string")
    seen = {}
    original = class_lm.fit

    def fit(*a, **b):
        seen["m"] = original(*a, **b)
        return seen["m"]

    class_lm.fit = fit
    try:
        class_lm.class_lm(docs, clustered=4, classes=2, blocks=2).collect()
    finally:
        class_lm.fit = original
    assert np.allclose((10 ** seen["m"].log_next).sum(1), 1)


def test_language_model_of_odd_rows(odd, nothing):
    rows = class_lm.class_lm(odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd.collect())
    assert all(math.isfinite(r.score) for r in rows)
    assert class_lm.class_lm(nothing).collect() == []


@pytest.fixture(scope="module")
def coder():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(TIKTOKEN), special_tokens={})


def bpe_digests(coder, text):
    ids = coder.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("words", [1 << 18, 40])
def test_bpe_equals_tiktoken(spark, odd, coder, words):
    from test_text_measures import texts

    rows = [(i, t) for i, t in enumerate(texts(3, 200, 25))] + [(r.doc_id, r.text) for r in odd.where("doc_id is null or doc_id not in (5, 10)").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = byte_bpe.byte_bpe(docs, TIKTOKEN, public_tokenizers.PATTERN, words=words).collect()
    assert Counter(map(tuple, got)) == Counter((i, *bpe_digests(coder, t)) for i, t in rows)


def test_folds_and_heap_merges_agree_with_tiktoken(spark, coder):
    """Spark's fold and the merges of rare pieces, over odd words; the literal is never written into a row."""
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abcdeing thors=é日-") for _ in range(rng.randrange(1, 14))) for _ in range(300)} | {"a" * 500, "\U0001f600"})
    docs = spark.createDataFrame([(w,) for w in words], "word string").repartition(2)
    vocabulary = byte_bpe.Vocabulary(spark, TIKTOKEN, public_tokenizers.PATTERN)
    from pyspark.sql import functions as F

    folded = vocabulary.over(docs, ["word"], lambda t: vocabulary.fold(F.col("word").cast("binary"), t), "ids")
    assert "AS _tables" not in folded._jdf.queryExecution().optimizedPlan().toString()
    plain = byte_bpe.Coder(TIKTOKEN, public_tokenizers.PATTERN, {})
    for r in folded.collect():
        want = coder._encode_single_piece(r.word)
        assert r.ids == want
        assert np.frombuffer(plain.merge(r.word.encode()), "<u4").tolist() == want


def test_encoded_ids_and_bytes(spark, made_docs, coder, nothing):
    encoded = byte_bpe.encode(made_docs, TIKTOKEN, public_tokenizers.PATTERN).join(pick(made_docs, doc_id="doc_id", text="text"), "doc_id")
    for r in encoded.collect():
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert ids == coder.encode_ordinary(r.text or "") and r.n_tokens == len(ids)
        assert bytes(r.decoded) == (r.text or "").encode()
    assert byte_bpe.byte_bpe(nothing, TIKTOKEN, public_tokenizers.PATTERN).collect() == []


@pytest.mark.parametrize(("page", "want"), [
    ("<body><nav><ul><li>Home<li>News</ul></nav><article><h1>T &amp; U</h1><p>A\n b<br>c<p>D</article><aside>x</aside><footer>f</footer>", "T & U\nA b c\nD"),
    ("<article><p>One.</p><div class='ad box'>Buy</div><p>Two.</p><script>var a='<p>';</script></article>", "One.\nTwo."),
    ("<div id='menu'>a</div><div><p>" + "long text " * 12 + "</p><p>short</p></div><div class=comments><p>me too</p></div>", ("long text " * 12).strip() + "\nshort"),
    ("<div class='cookie-notice'>We</div>Just a few words", "Just a few words"), ("<article><p>cut <b", "cut"), ("", ""), (None, ""), ("<nav>only a menu</nav>", ""),
])
def test_main_text_of_pages(spark, page, want):
    assert html_text.main_text(page or "") == want


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r.page_id: r for r in html_text.html_text(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        assert "<" not in got[r.page_id].text.replace("<", "", 0) or "&lt;" in r.html
        assert got[r.page_id].n_chars == len(got[r.page_id].text) > 0


def pipeline_brute(rows, items, coder):
    import pyarrow as pa

    kept = quality_rules.measure(pa.array([t for _, t in rows], pa.string()))["kept"]
    rows = [r for r, k in zip(rows, kept, strict=True) if k]
    of = brute.jaccard_components(rows, 5, 80)
    rows = sorted(r for r in rows if of[r[0]][1] == r[0])
    seen, cut = set(), []
    for i, t in rows:
        spans = [m.span() for m in brute.WORD.finditer(t)]
        ws, gone = [t[a:b] for a, b in spans], set()
        for at in range(len(ws) - 19):
            w = tuple(ws[at:at + 20])
            if w in seen:
                gone.update(range(at, at + 20))
            seen.add(w)
        if len(gone) == len(ws):
            continue
        out, n = [], 0
        for at, (a, _) in enumerate(spans):  # a removed run takes the white space behind it
            if at in gone and at - 1 not in gone:
                out.append(t[n:a])
            if at not in gone and at - 1 in gone:
                n = a
        cut.append((i, "".join(out) + ("" if len(ws) - 1 in gone else t[n:])))
    return Counter((i, *bpe_digests(coder, t)) for i, t in cut if not contamination(t, items)[1])


def test_pipeline_against_plain_stages(spark, coder):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = corpus_pipeline.run(spark, SMALL)
    assert Counter(map(tuple, got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == pipeline_brute(docs, items, coder)


def test_pipeline_stages_keep_the_columns_and_pass_empty_tables(spark, nothing):
    docs = nothing
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == nothing.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect() == []


def test_columns_of_near_copies_do_not_travel_with_each_other(spark):
    """400 near copies of 1,000 words: what classes compare stays a small multiple of the text, and all are one component."""
    from fractions import Fraction

    rng = random.Random(9)
    base = [f"w{i}" for i in range(1000)]
    rows = []
    for i in range(400):
        ws = list(base)
        for _ in range(10):
            ws[rng.randrange(1000)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(ws)))
    docs = spark.createDataFrame(rows, "id long, text string").repartition(4)
    share = Fraction(4, 5)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    shared = jaccard_join.columns(docs, 5, share, none).repartition(4, "col").sortWithinPartitions("col", "class").mapInArrow(
        jaccard_join._shared, "block long, class long, n long")
    classes = jaccard_join.profile(docs, 5).where("kind = 0").selectExpr("key as class", "n as n_shingles")
    members = shared.groupBy("block", "class").sum("n").toDF("block", "class", "n").join(classes, "class").cache()
    pivots = jaccard_join._pivot_pairs(members, share).cache()
    assert jaccard_join.components(pivots).groupBy("root").count().collect()[0]["count"] == 399  # the root has no row
    left = jaccard_join._open_columns(members, pivots)
    entries = left.groupBy("class").count().selectExpr("sum(count * count)").first()[0] or 0
    assert entries * 8 < 4 * sum(len(t) for _, t in rows)
    members.unpersist()
    pivots.unpersist()
    assert {r.component_id for r in jaccard_join.jaccard_join(docs, 5, 80, "id").collect()} == {0}


def test_packed_numbers_round_trip():
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.integers(0, 1 << b, 500) for b in (1, 7, 8, 14, 15, 21, 35, 62)] + [np.array([0, 127, 128, 16383, 16384])])
    data, ends = W.pack(values)
    back, stops = W.unpack(data)
    assert (back == values).all() and (stops == ends).all() and (W.pack(values[values < 128])[1] == np.arange(1, (values < 128).sum() + 1)).all()
    assert len(W.pack(values[:0])[0]) == len(W.unpack(data[:0])[0]) == 0
