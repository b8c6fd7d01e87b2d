"""One query per operator, over its whole table; the contract's columns only."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.llm import arrow_tokens, byte_bpe, class_lm, conversations, decontaminate, html_text, jaccard_join, license_scan, merkle, quality_rules, substring_dedup, token_counts, toxicity

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts read from each document's prefix table."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN, limit=1024)


def op2_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and the verdict of the compression bands."""
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), bands=quality_rules.CLEAN)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in each document."""
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of each document."""
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op6_arrow_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files written and read back."""
    return arrow_tokens.arrow_tokens(table(spark, sf_dir, "documents"), VOCABULARY, end_id=0)


def op7_repeated_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words inside windows of 20 words that start earlier, and what is left."""
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by the similarity of their 4-word shingles."""
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"), k=4, percent=85)


def op5_line_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.html_text(table(spark, sf_dir, "pages"))


def op9_brown_class_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and class-bigram scores of every document."""
    return class_lm.class_lm(table(spark, sf_dir, "documents"))


def op10_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by the ranks of the vocabulary, and the bytes they decode to."""
    return byte_bpe.byte_bpe(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, tops and proofs of every document; a fifth of the texts is lower-cased before it is checked."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return merkle.merkle_manifest(table(spark, sf_dir, "documents"), changed={"text": merkle.lower_ascii(F.col("text"))}, where=crc % 5 == 0)


def op12_audit_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations and their cheapest repair."""
    return conversations.conversation_repair(table(spark, sf_dir, "conversations"), damaged=True)


def op13_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a model fitted on labelled ones that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_prefix_token_counts, op2_compression_bands, op3_benchmark_decontamination, op4_license_sentences, op5_line_block_text,
                                    op6_arrow_token_files, op7_repeated_phrase_automata, op8_ngram_jaccard_join, op9_brown_class_ngrams,
                                    op10_byte_level_bpe, op11_merkle_manifest, op12_audit_repair, op13_ftrl_toxicity)
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_ITEM_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _field(x: str) -> str:
    return f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


SQL: dict[str, str] = {
    "op3_benchmark_decontamination": rf"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_ITEM_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g
      FROM (SELECT item, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
      FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM p))),
h AS (SELECT DISTINCT doc_id, i, k, item FROM s JOIN p USING (k, g)),
n AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(t.l, '')) AS items_sha256,
       coalesce(n.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN t ON d.doc_id = t.doc_id""",
    "op7_repeated_phrase_automata": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM s) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM r),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
k AS (SELECT x.doc_id, count(c.pos) AS n_removed, string_agg(word, ' ' ORDER BY x.pos) FILTER (c.pos IS NULL) AS kept
      FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.pos = c.pos GROUP BY x.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op8_ngram_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.other) AS component_id
FROM d JOIN r ON d.doc_id = r.doc_id LEFT JOIN n ON d.doc_id = n.doc_id GROUP BY d.doc_id""",
    # crc32 by its table, both trees level by level, then every leaf folded step by step.
    "op11_merkle_manifest": f"""
WITH RECURSIVE
steps(n, c) AS (SELECT n, n FROM range(256) r(n)),
crc8(k, n, c) AS (SELECT 0, n, c FROM steps UNION ALL
  SELECT k + 1, n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc8 WHERE k < 8),
tab AS (SELECT list(c ORDER BY n) AS t FROM crc8 WHERE k = 8),
d AS (SELECT *, coalesce(doc_id::VARCHAR, '') AS name, {_leaf('text')} AS leaf, {_leaf(f'translate(text, {_AZ})')} AS lowered FROM documents),
hit AS (SELECT d.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda s: ascii(s)::BIGINT)),
          lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 5 = 0 AND text IS NOT NULL AS changed FROM d, tab),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS size FROM hit),
up(source, lvl, pos, size, node) AS (
  SELECT source, 0, pos, size, leaf FROM placed
  UNION ALL
  SELECT source, lvl + 1, pos // 16, (size + 15) // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM up WHERE size > 1 GROUP BY source, lvl, pos // 16, size),
tops AS (SELECT source, lvl AS top, node AS subroot FROM up WHERE size = 1),
srcs AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM tops),
high(lvl, pos, size, node) AS (
  SELECT 0, idx, n, subroot FROM srcs
  UNION ALL
  SELECT lvl + 1, pos // 16, (size + 15) // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM high WHERE size > 1 GROUP BY lvl, pos // 16, size),
runs AS (SELECT source, lvl, pos // 16 AS run, list(node ORDER BY pos) AS nodes FROM up WHERE size > 1 GROUP BY ALL),
highs AS (SELECT lvl, pos // 16 AS run, list(node ORDER BY pos) AS nodes FROM high WHERE size > 1 GROUP BY ALL),
way AS (
  SELECT p.name, p.pos AS leaf_pos, p.source, l.lvl AS step, (p.pos // (16 ** l.lvl)::BIGINT) % 16 + 1 AS i, nodes
  FROM placed p JOIN tops t ON p.source IS NOT DISTINCT FROM t.source JOIN range(20) l(lvl) ON l.lvl < t.top
  JOIN runs r ON r.source IS NOT DISTINCT FROM p.source AND r.lvl = l.lvl AND r.run = p.pos // (16 ** (l.lvl + 1))::BIGINT
  UNION ALL
  SELECT p.name, p.pos, p.source, 20 + l.lvl, (s.idx // (16 ** l.lvl)::BIGINT) % 16 + 1, nodes
  FROM placed p JOIN srcs s ON p.source IS NOT DISTINCT FROM s.source JOIN range(20) l(lvl) ON true
  JOIN highs h ON h.lvl = l.lvl AND h.run = s.idx // (16 ** (l.lvl + 1))::BIGINT),
ways AS (SELECT source, leaf_pos, list(struct_pack(a := array_to_string(nodes[1:i - 1], ''), b := array_to_string(nodes[i + 1:], '')) ORDER BY step) AS w FROM way GROUP BY source, leaf_pos),
folded(source, pos, k, node) AS (
  SELECT source, pos, 0, CASE WHEN changed THEN lowered ELSE leaf END FROM placed
  UNION ALL
  SELECT f.source, f.pos, k + 1, sha256(w[k + 1].a || node || w[k + 1].b) FROM folded f JOIN ways ON f.source IS NOT DISTINCT FROM ways.source AND f.pos = leaf_pos WHERE k < len(w)),
ends AS (SELECT source, pos, arg_max(node, k) AS folded_root FROM folded GROUP BY source, pos)
SELECT p.doc_id, p.leaf, t.subroot, root, sha256(coalesce(array_to_string(list_transform(w, lambda s: s.a || s.b), ''), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM placed p JOIN tops t ON p.source IS NOT DISTINCT FROM t.source JOIN ends e ON p.source IS NOT DISTINCT FROM e.source AND p.pos = e.pos
LEFT JOIN ways ON p.source IS NOT DISTINCT FROM ways.source AND p.pos = leaf_pos, (SELECT node AS root FROM high WHERE size = 1)""",
}
