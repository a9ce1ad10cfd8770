"""The training-data queries: one per operator over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.llm import (
    bpe_words,
    embed_lsh,
    fill_middle,
    jaccard_join,
    lm_backoff,
    merkle_tree,
    pack_bestfit,
    pii_weak,
    quality_fertility,
    shard_lpt,
    substring_lines,
    toxic_mil,
    url_rules,
)

#: Vocabulary files.
BYTE_BPE_JSON = public_tokenizers.path("byte_bpe_50k.json")
BYTE_BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")

#: Listed url rules: host/path prefix -> verdict.
URL_RULES = {
    "com/": "allow",
    "example.com/en/": "block",
    "www.example.com/en/": "allow",
    "net/es/": "block",
    "net/fr/": "block",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_backoff.score(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_matched", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_pages(table(spark, sf_dir, "pages"), URL_RULES)


def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_lpt.shard_documents(table(spark, sf_dir, "documents"), shards=40)


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fertility.judge(table(spark, sf_dir, "documents"), BYTE_BPE_RANKS, PIECE_BPE)


def embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_lsh.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.95)


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_bestfit.pack_documents(table(spark, sf_dir, "documents"), BYTE_BPE_JSON, capacity=2048, end_id=0)


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_words.digests(table(spark, sf_dir, "documents"), BYTE_BPE_RANKS, public_tokenizers.PATTERN)


def ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_classes(table(spark, sf_dir, "documents"), size=3, least=90)


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_lines.removals(table(spark, sf_dir, "documents"))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_weak.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_secret", F.sha2("base", 256).alias("base_sha256"), "spans")


def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.restore(fill_middle.transform(table(spark, sf_dir, "documents"), seed=42, rate=50, spm=80))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256")
    )


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = merkle_tree.manifest(table(spark, sf_dir, "documents"), tampered)

    def text(c: str) -> Column:
        return F.lower(F.hex(c))

    return out.select(
        "doc_id",
        text("leaf").alias("leaf"),
        text("subroot").alias("subroot"),
        text("root").alias("root"),
        F.sha2(text("siblings").cast("binary"), 256).alias("proof_sha256"),
        text("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxic_mil.fit(docs, labels.where(~toxic_mil.held_out(F.col("doc_id"))))
    scored = toxic_mil.score(docs, model)
    return scored.select(
        "doc_id",
        toxic_mil.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        F.size("offending").alias("n_offending"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": lm_scoring,
    "op2_url_filters": url_filters,
    "op3_sharding": sharding,
    "op4_quality_rules": quality_rules,
    "op5_embedding_dedup": embedding_dedup,
    "op6_packing": packing,
    "op7_byte_bpe": byte_bpe,
    "op8_ngram_join": ngram_join,
    "op9_substring_dedup": substring_dedup,
    "op10_personal_data": personal_data,
    "op11_fill_in_middle": fill_in_middle,
    "op12_merkle_manifest": merkle_manifest,
    "op13_toxicity": toxicity,
}


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    move = "CASE WHEN b >= 0 THEN xor(c, b) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    return f"xor(list_reduce({steps}, lambda c, b: {move}, 4294967295::BIGINT), 4294967295)"


def merkle_sql(depth: int = 5, upper: int = 3) -> str:
    """The manifest for sources of at most 16 ** depth rows and at most 16 ** upper sources."""
    fields = ["doc_id", "source", "lang", "n_chars"]

    def leaf(text: str) -> str:
        parts = [f"{c}::VARCHAR" for c in fields] + [text]
        return "sha256(" + " || ".join(f"coalesce(strlen({p}) || ':' || {p}, '-')" for p in parts) + ")"

    def level(k: int, of: str) -> str:
        return f"""
s{k} AS (
  SELECT a.tree, a.idx, any_value(a.n) > 1 AS many, coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
    coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM {of} a JOIN {of} b ON a.tree = b.tree AND a.idx // 16 = b.idx // 16 GROUP BY a.tree, a.idx),
t{k + 1} AS (
  SELECT tree, idx // 16 AS idx, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY idx)) ELSE any_value(d) END AS d,
    CASE WHEN any_value(n) > 1 THEN (any_value(n) + 15) // 16 ELSE 1 END AS n FROM {of} GROUP BY tree, idx // 16)"""

    def step(k: int, tree: str, idx: str) -> str:
        return f"""
f{k + 1} AS (
  SELECT f.* EXCLUDE (f, proof), f.proof || s.l || s.r AS proof, CASE WHEN many THEN sha256(s.l || f.f || s.r) ELSE f.f END AS f
  FROM f{k} f JOIN s{k} s ON s.tree = {tree} AND s.idx = {idx})"""

    rows = f"""
WITH ranked AS (
  SELECT doc_id, source, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n, {leaf("text")} AS d,
    CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 5 = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS bad
  FROM documents),
t0 AS (SELECT tree, idx, n, d FROM ranked)"""
    ctes = [rows, *[level(k, f"t{k}") for k in range(depth)]]
    ctes.append(f"""
u{depth} AS (SELECT 0 AS tree, tree AS idx, count(*) OVER () AS n, d FROM t{depth})""")
    ctes += [level(k, f"u{depth}" if k == depth else f"t{k}") for k in range(depth, depth + upper)]
    ctes.append("""
f0 AS (SELECT doc_id, tree, idx, d AS leaf, coalesce(bad, d) AS f, '' AS proof FROM ranked)""")
    ctes += [step(k, "f.tree", f"f.idx // {16**k}") for k in range(depth)]
    ctes += [step(depth + k, "0", f"f.tree // {16**k}") for k in range(upper)]
    return ",".join(ctes) + f"""
SELECT doc_id, leaf, u.d AS subroot, t.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = t.d AS verified
FROM f{depth + upper} f JOIN u{depth} u ON u.idx = f.tree JOIN t{depth + upper} t ON true"""


#: DuckDB twins.
ORACLE: dict[str, str] = {
    "op5_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON least.a = e.vec_id LEFT JOIN degree ON degree.a = e.vec_id""",
    "op1_lm_scoring": r"""
WITH words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)),
pairs AS (SELECT *, lag(word) OVER (PARTITION BY doc_id ORDER BY pos) AS prior FROM words),
total AS (SELECT count(*) AS n FROM words),
size AS (SELECT doc_id, count(*) AS n_words FROM words GROUP BY doc_id),
uni AS (SELECT word, count(*) AS n FROM words GROUP BY word),
uni_own AS (SELECT doc_id, word, count(*) AS n FROM words GROUP BY ALL),
bi AS (SELECT prior, word, count(*) AS n FROM pairs WHERE prior IS NOT NULL GROUP BY ALL),
bi_own AS (SELECT doc_id, prior, word, count(*) AS n FROM pairs WHERE prior IS NOT NULL GROUP BY ALL),
counted AS (
  SELECT p.doc_id, u.n - uo.n AS c1, h.n - ho.n AS c0, coalesce(b.n - bo.n, 0) AS c2, total.n - size.n_words AS others
  FROM pairs p JOIN uni u ON u.word = p.word JOIN uni_own uo ON uo.doc_id = p.doc_id AND uo.word = p.word
  LEFT JOIN uni h ON h.word = p.prior LEFT JOIN uni_own ho ON ho.doc_id = p.doc_id AND ho.word = p.prior
  LEFT JOIN bi b ON b.prior = p.prior AND b.word = p.word
  LEFT JOIN bi_own bo ON bo.doc_id = p.doc_id AND bo.prior = p.prior AND bo.word = p.word
  JOIN size ON size.doc_id = p.doc_id CROSS JOIN total),
scored AS (
  SELECT doc_id, c0, c2, CASE WHEN c1 > 0 THEN c1 / others ELSE 1.0 / (others + 1) END AS s1 FROM counted),
summed AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (c2 > 0) AS n_matched,
    sum(log10(CASE WHEN c2 > 0 THEN c2 / c0 WHEN c0 IS NULL THEN s1 ELSE 0.4 * s1 END)) AS s
  FROM scored GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_matched, 0) AS n_matched, round(coalesce(s, 0), 4) AS log_score,
  round(coalesce(s / n_words, 0), 6) AS mean_log_score
FROM documents d LEFT JOIN summed USING (doc_id)""",
    "op11_fill_in_middle": r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tok
  FROM documents),
drawn AS (
  SELECT *, len(tok) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
    ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM cut),
placed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
segments AS (
  SELECT *, array_to_string(tok[1:a], '') AS p, array_to_string(tok[a + 1:b], '') AS m, array_to_string(tok[b + 1:], '') AS s
  FROM placed)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM segments""",
    "op12_merkle_manifest": merkle_sql(),
}
