"""Words, token counts, quality rules, licence scan and token files."""

import base64
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import brute
from barsmith.llm import arrow_tokens, license_scan, quality_rules, token_counts, words

JSON = public_tokenizers.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"
BITS = ["a", "b", "the", " ", "  ", "\n", "'", "'re", "'l", "'ll", "1", "23", "!", "--", "é", "日本", "<|endoftext|>", "<|", "\t", "\xa0", "\x1c", "\u3000",
        "ing", "==", "aaaa", " .", "\u0130", "\u0301", "\U0001f600"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def texts(seed, n, size):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randrange(size))) for _ in range(n)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \t\n\x0bé日", max_size=60)), max_size=8), st.integers(1, 4))
def test_words_and_shingles_of_any_texts(rows, k):
    data, offsets = words.buffers(pa.array(rows, pa.string()))
    found = words.find(data, offsets, lower=True)
    want = [[w.lower().encode() if w.isascii() else w.translate(brute.LOWER).encode() for w in brute.WORD.findall(t or "")] for t in rows]
    assert found.counts.tolist() == [len(w) for w in want]
    assert len(set(found.hash.tolist())) == len({w for ws in want for w in ws})
    shingles, ranges = words.sorted_sets(*words.grams(found, k))
    assert np.diff(ranges).tolist() == [len(brute.shingles(t, k)) for t in rows]


def test_long_texts_are_cut_between_words(monkeypatch):
    column = pa.array(["one two  three", "x" * 500 + " y", None, "one"])
    whole = words.find(*words.buffers(column))
    monkeypatch.setattr(words, "SLICE", 16)
    parts = words.find(*words.buffers(column))
    assert whole.hash.tolist() == parts.hash.tolist() and whole.start.tolist() == parts.start.tolist()


def test_every_prefix_count_is_the_library_s(library):
    counter = token_counts.PrefixCounter(JSON, public_tokenizers.PATTERN)
    for text in texts(1, 150, 15):
        want = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert counter.counts(text).tolist() == want
        assert counter.prefix_tables([text])[0].tolist() == want


def test_token_counts_of_odd_rows(spark, odd, nothing, library):
    got = Counter(map(tuple, token_counts.token_counts(odd, JSON, public_tokenizers.PATTERN, limit=20).collect()))
    want = Counter()
    for r in odd.collect():
        text = r.text or ""
        counts = [len(x.ids) for x in library.encode_batch([text[:k] for k in range(min(len(text), 200) + 1)], add_special_tokens=False)]
        n = len(library.encode(text, add_special_tokens=False).ids)
        fits = max(k for k, c in enumerate(counts) if c <= 20) if len(text) <= 200 else None
        want[r.doc_id, len(text.encode()), n, n > 20, fits] += 1
    assert Counter((*k[:4],) for k in got.elements()) == Counter((*k[:4],) for k in want.elements())
    for k in want:
        assert k[4] is None or k in got
    assert token_counts.token_counts(nothing, JSON, public_tokenizers.PATTERN).collect() == []
    table = token_counts.prefix_counts(odd.where("doc_id = 9"), JSON, public_tokenizers.PATTERN).first()
    assert table.prefix_tokens[0] == 0 and len(table.prefix_tokens) == len(odd.where("doc_id = 9").first().text) + 1


def test_quality_measures_match_plain_counts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    for r in docs.collect():
        ws = brute.WORD.findall(r.text or "")
        grams = [tuple(ws[i:i + 5]) for i in range(len(ws) - 4)]
        count, covered = Counter(grams), set()
        for i, g in enumerate(grams):
            covered.update(range(i, i + 5) if count[g] > 1 else ())
        lines = [x for x in (r.text or "").split("\n") if brute.WORD.search(x)]
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (
            len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in r.text or ""), len(lines) - len(set(lines)), len(covered))
        assert g.base_failed == (len(ws) < 10 or 100 * len(covered) > 20 * len(ws))
        assert not (g.base_failed and g.kept)


def test_compression_bands_by_length(spark, odd, nothing):
    rng = random.Random(4)
    prose = " ".join(rng.choice(["river", "stone", "walking", "under", "a", "light", "morning", "theory", "of", "garden", "small", "paper"]) + rng.choice("abcdefghij") for _ in range(900))
    noise = " ".join("".join(rng.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/") for _ in range(60)) for _ in range(100))
    same = " ".join(f"row {i // 400} of the table" for i in range(2000))
    rows = [(1, prose), (2, noise), (3, same)]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: False}
    assert quality_rules.quality_rules(odd).count() == odd.count()
    assert quality_rules.quality_rules(nothing).collect() == []
    kept = quality_rules.keep_documents(odd)
    assert kept.columns == odd.columns and all(r.text for r in kept.collect())


def test_fitted_bands_reject_junk_and_keep_clean_rows(spark):
    rng = random.Random(8)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    rows = [(r.quality, r.text) for r in docs.collect()]
    measured = quality_rules.measure(pa.array([t for _, t in rows], pa.string()))
    clean = [(t, k) for (q, t), k, f in zip(rows, measured["kept"], measured["base_failed"], strict=True) if q == 1 and not f]
    junk = [k for (q, t), k, f in zip(rows, measured["kept"], measured["base_failed"], strict=True) if q == 0 and not f and len(t) >= 1024]
    assert sum(k for _, k in clean) >= 0.99 * len(clean) > 100
    assert sum(junk) <= 0.1 * len(junk) and len(junk) > 5

    def cut(raw, size):
        return b" ".join(raw[i:i + 8] for i in range(0, size, 8))[:size].decode()

    planted = [cut(base64.b64encode(rng.randbytes(n)), n) for n in (256, 419, 839, 2000, 9000)]
    planted += [cut(rng.randbytes(n).hex().encode(), n) for n in (256, 512, 839, 2000, 9000)]
    long = [t for t, k in clean if k and 6000 <= len(t.encode()) <= 12_000]
    planted += [t[:3000] + " " + cut(base64.b64encode(rng.randbytes(2000)), 2000) + " " + t[3000:] for t in long]
    planted += [" ".join(w + rng.choice(["%%%", "&&&", "***", "$$$", "###"]) for w in t.split()[:300]) for t in long]
    assert len(long) > 2 and not any(quality_rules.measure(pa.array(planted, pa.string()))["kept"])


@pytest.mark.parametrize(("text", "want"), [
    ("Released under the MIT License.", ["MIT"]),
    ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3-only"]),
    ("under the GNU General Public License as published; either version 2 of the License, or (at your option) any later version.", ["GPL-2-or-later"]),
    ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
    ("SPDX-License-Identifier: MPL-2.0", ["MPL-2.0"]),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
     "1. Redistributions of source code must retain the above copyright notice.\n2. Redistributions in binary form must reproduce the above copyright notice.",
     ["BSD-2-Clause"]),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software.\n"
     "The above copyright notice and this permission notice shall be included in all copies.\n"
     "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND.", ["MIT"]),
    ("The permit office is closed.", []), ("", []),
])
def test_licences_of_sentences(text, want):
    got = license_scan.licences_of(text)[1]
    assert [g for g in got if g != "unknown"] == want


def test_sequences_use_up_their_sentences():
    ids = ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "mit-name"]
    assert license_scan.match(ids) == ["BSD-3-Clause", "MIT"]
    assert license_scan.match(["mit-grant", "gpl-2", "mit-notice", "mit-warranty"]) == ["MIT", "GPL-2-only"]


KNOWN = [
    *(f"GNU {kind} Public License version 3 or any later version" for kind in ("Lesser General", "Affero General", "General")),
    *(f"GNU {kind} Public License version 2" for kind in ("Lesser General", "Affero General", "General")),
    *(f"GNU {kind} Public License" for kind in ("Lesser General", "Affero General", "General")),
    "version 2 of the License or at your option any later version", "any later version", "Apache License Version 2.0", "Apache License 2.0", "Mozilla Public License v 2.0",
    "Eclipse Public License version 2.0", "Permission is hereby granted free of charge to any person obtaining a copy of this software",
    "The above copyright notice and this permission notice shall be included in all copies", "The software is provided as is without warranty of any kind",
    "under the terms of the MIT License", "Permission to use copy modify and or distribute this software for any purpose",
    "Redistribution and use in source and binary forms with or without modification are permitted", "Redistributions of source code must retain the above copyright notice",
    "Redistributions in binary form must reproduce the above copyright notice", "Neither the name of it may be used to endorse or promote products",
    "This software is provided by us as is", "Simplified BSD", "Modified BSD", "two clause BSD",
    *(f"Creative Commons Attribution {kind}4.0" for kind in ("NonCommercial ShareAlike ", "NonCommercial NoDerivatives ", "NonCommercial ", "ShareAlike ", "NoDerivatives ", "")),
    "CC BY 4.0", "CC BY SA 4.0", "Creative Commons Zero", "released into the public domain", "All rights reserved",
]


@pytest.mark.parametrize("gap", ["\n", "  ", "\n    ", "\t", " \r\n"])
def test_known_sentences_broken_across_lines(gap):
    names = set()
    for phrase in KNOWN:
        want = license_scan.licences_of(phrase)
        assert want[0] and license_scan.licences_of(phrase.replace(" ", gap)) == want, phrase
        for at in range(phrase.count(" ")):
            words = phrase.split(" ")
            assert license_scan.licences_of(" ".join(words[:at + 1]) + gap + " ".join(words[at + 1:])) == want, (phrase, at)
        names.update(license_scan.identify(phrase) and [next(n for p, n in license_scan.SENTENCES if p.search(license_scan.normalised(phrase)))])
    assert names | {"cc0"} == {n for _, n in license_scan.SENTENCES}
    assert license_scan.licences_of("CC_BY_4.0")[0] == ["cc-by-4.0"] and license_scan.licences_of("CC0")[0] == ["cc0"]


def test_license_scan_rows(odd, nothing):
    assert license_scan.license_scan(odd).count() == odd.count()
    assert license_scan.license_scan(nothing).collect() == []


def test_token_files_hold_the_library_s_ids(spark, odd, library, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(
        odd.where("doc_id > 1 or doc_id is null").selectExpr("doc_id - 100 doc_id", "text"))
    got = [tuple(r) for r in arrow_tokens.arrow_tokens(docs, JSON, folder=str(tmp_path / "t"), length=64, batch=4, shards=5).collect()]
    start, want = 0, []
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert Counter((a, n, c) for a, _, n, c in got) == Counter(want)
    ordered = sorted(got, key=lambda g: g[1])
    assert [g[1] for g in ordered] == [0, *np.cumsum([g[2] for g in ordered])[:-1].tolist()]
    ids = [-1000 if g[0] is None else g[0] for g in ordered]
    assert ids == sorted(ids)


def test_sequences_are_read_without_a_copy(spark, library, tmp_path):
    docs = spark.createDataFrame([(i, f"some words of number {i} " * 9) for i in range(20)], "doc_id long, text string")
    arrow_tokens.write_tokens(docs, JSON, str(tmp_path / "t"), length=32, batch=3, shards=1).collect()
    file = arrow_tokens.SequenceFile(arrow_tokens.shard_uri(str(tmp_path / "t"), 0))
    ids = [x for r in docs.collect() for x in [*library.encode(r.text, add_special_tokens=False).ids, 0]]
    assert len(file) == -(-len(ids) // 32)
    for i in range(len(file)):
        seq, mask = file[i]
        real = sum(mask.to_pylist())
        assert seq[:real].tolist() == ids[32 * i:32 * i + 32] and real == len(ids[32 * i:32 * i + 32])
        assert not seq.flags.owndata


def test_token_files_of_an_empty_table(nothing, tmp_path):
    assert arrow_tokens.arrow_tokens(nothing, JSON, folder=str(tmp_path / "t")).collect() == []


def test_blocks_follow_the_text_alone(spark, tmp_path, monkeypatch):
    """Sixty more columns and texts that compress to nothing leave the number of blocks alone."""
    from pyspark.sql import functions as F

    from barsmith.llm import frames
    monkeypatch.setattr(frames, "BLOCK_BYTES", 1 << 16)
    narrow = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), 1000).alias("text"))
    narrow.write.parquet(str(tmp_path / "narrow"))
    narrow.select("*", *[F.lit("x").alias(f"c{i}") for i in range(60)]).write.parquet(str(tmp_path / "wide"))
    want = -(-400 * 3000 // (1 << 16))
    for name in ("narrow", "wide"):
        assert frames.block_count(frames.pick(spark.read.parquet(str(tmp_path / name)), id="doc_id", text="text")) == want
    assert frames.block_count(narrow.limit(0)) == 1


def test_new_chunks_are_encoded_many_to_a_text():
    """The library gets few texts for many new words, and the ids are those of each text on its own."""
    coder = arrow_tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    plain = coder.tokenizer
    given = []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return plain.encode_batch_fast(texts, **options)
    coder.tokenizer = Counted()
    words = [f"w{i}" for i in range(2500)] + ["Ġx", "a\nb", "it's", "été", "中文", "\U0001f600", "...", "1,000", "\x00", "x y", "'ll", "<|endoftext", "|>"]
    texts = [" ".join(words), "a  b \n c", "", " lead", "x " + "Ġ" * 3 + " y​ z", "one <|endoftext|> two"]
    got = coder.encode(texts)
    assert [np.frombuffer(x, coder.dtype).tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(given) < 20


def test_line_breaks_and_contractions_in_words_need_no_pass_of_their_own(monkeypatch):
    counter = token_counts.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    words = ["a\nb", "they're", "we'll\nbe", "I've", "'re're", "x y", "é\n中", "q\tq\tq", "dogs'\nll"]
    want = [counter.counts(f"x {w} y") for w in words]
    monkeypatch.setattr(counter, "plain_counts", lambda text: (_ for _ in ()).throw(AssertionError(text)))
    counter.learn(set(words))
    got = [np.cumsum(np.frombuffer(counter._chunk[w], np.int8)) for w in words]
    monkeypatch.undo()
    assert [(1 + g).tolist() for g in got] == [w[2:len(g) + 2].tolist() for g, w in zip(got, want)]
    runs = ["a\n\nb", "a\r\n\tb"]  # these do: a cut in the run depends on all of it
    for text, table in zip([f"x {r} y" for r in runs], counter.prefix_tables([f"x {r} y" for r in runs])):
        assert table.tolist() == counter.counts(text).tolist()


def test_tokens_that_end_a_beginning():
    counter = token_counts.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    some = sorted(counter.ends)[::97]
    for s in some:
        assert counter.ends[s] == tuple((len(s) - i, counter.token[s[i:]]) for i in range(len(s)) if s[i:] in counter.token)
