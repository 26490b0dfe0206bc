"""The registered queries of these operators, and DuckDB SQL for those that SQL can express.

Each query runs its operator with production parameters over its whole table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm import bpe, embedding, mixing, pii, pitman_yor, quality, sharding, simhash, substring, topk
from tidebook.llm.cluster import cut

#: For these queries only; a real key comes from the caller's own secrets.
PII_KEY = b"registered query"
SHARDS = [f"shard-{k:02d}" for k in range(64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), decoded="decoded")
    return bpe.digests(both, "doc_id")


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(quality.with_statistics(table(spark, sf_dir, "documents"), "text", "doc_id"))
    model = quality.learn(rows, table(spark, sf_dir, "labels"), statistics_of=rows)
    out = quality.scored_statistics(rows, model)
    return out.select("doc_id", quality.apart(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pitman_yor.scores(table(spark, sf_dir, "documents"), ~quality.apart(F.col("doc_id"), 7, 2))
    return out.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_pii": op2_pii,
    "op3_bpe": op3_bpe,
    "op4_substring": op4_substring,
    "op5_quality": op5_quality,
    "op6_topk": op6_topk,
    "op7_sharding": op7_sharding,
    "op8_mixing": op8_mixing,
    "op9_embedding": op9_embedding,
    "op10_lm": op10_lm,
}

MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all({text}, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {docs}
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level FROM w
), t AS (
  SELECT source, source_size, least(max(level) OVER () * weight, (3 * source_size)::DOUBLE) AS target,
    ('0x' || substr(md5(concat('mix:', coalesce('=' || source, 'null'))), 1, 10))::BIGINT::HUGEINT AS off FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(round(target / source_size * 1099511627776.0::DOUBLE), 3 * 1099511627776)::BIGINT ELSE 0 END::HUGEINT AS step FROM t
), r AS (
  SELECT d.doc_id, d.source, d.size, e.source_size, e.target, e.step, e.off, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS LAST)::HUGEINT AS i
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)"""

ORACLES = {
    "op4_substring": r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), p AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 19)) AS i, w FROM d WHERE len(w) >= 20
), k AS (
  SELECT doc_id, i, sha256(list_aggregate(w[i:i + 19], 'string_agg', ' ')) AS h FROM p
), r AS (
  SELECT doc_id, i FROM k QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1
), g AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS i FROM r
), gone AS (
  SELECT doc_id, list(i) AS lost FROM g GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(lost), 0)::BIGINT AS n_removed,
  sha256(coalesce(list_aggregate(CASE WHEN lost IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(lost, i)) END, 'string_agg', ' '), '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)""",
    "op6_topk": """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5""",
    "op9_embedding": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a
)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c""",
    "op7_sharding": f"""
WITH t AS (SELECT generate_subscripts(a, 1) - 1 AS slot, unnest(a) AS k FROM (SELECT {sharding.lookup_table(SHARDS)} AS a)),
d AS (SELECT doc_id, (('0x' || substr(md5(coalesce('=' || doc_id::VARCHAR, 'null')), 1, 15))::BIGINT % 10007)::INT AS slot FROM documents)
SELECT doc_id, d.slot, 'shard-' || lpad(k::VARCHAR, 2, '0') AS shard FROM d JOIN t USING (slot)""",
    "op8_mixing": MIXING_SQL.format(text="text", docs="documents")
    + """
SELECT doc_id, size, source_size, target, ((i * step + off) // 1099511627776 - ((i - 1) * step + off) // 1099511627776)::BIGINT * size AS taken FROM r""",
}
