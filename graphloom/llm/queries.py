"""The registered queries of the corpus operators: each applies its operator, with the
parameters in use, to the whole of its table. SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, licenses, line_dedup, mixing, near_dups, packing, pii, quality, topk, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edits(table(spark, sf_dir, "documents"))


def op2_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.components(table(spark, sf_dir, "documents"), width=2)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~toxicity.held_out())
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.digest(pii.find(docs, pii.fit(docs)))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.scaled(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    return topk.search(rows.filter("id % 20 = 0"), rows, k=20).select(F.col("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.dedup(docs, line_dedup.LineIndex.of(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.classify(docs, quality.trusted(docs, table(spark, sf_dir, "labels")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    took = mixing.allot(table(spark, sf_dir, "documents"))
    return took.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {f.__name__: f for f in (op1_imatch, op2_near_dups, op3_toxicity, op4_licenses, op5_pii, op6_packing, op7_topk, op8_line_dedup, op9_quality, op10_mixing)}


_LINES = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT r, doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
n AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
x AS (SELECT k.*, n.key IS NOT NULL AND doc_id < keeper AS gone FROM k LEFT JOIN n USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM x GROUP BY r, doc_id"""

_MIX = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
a AS (SELECT *, (2 * source_size) / w::DOUBLE AS level FROM s),
f AS (SELECT *, sum(source_size) OVER () * 3 / 2.0 AS total,
      sum(2 * source_size) OVER (ORDER BY level, source NULLS LAST) AS caps, sum(w) OVER (ORDER BY level, source NULLS LAST) AS ws, sum(w) OVER () AS w_all FROM a),
g AS (SELECT arg_min((total - (caps - 2 * source_size)) / (w_all - (ws - w)), (level, source)) AS level FROM f WHERE caps + level * (w_all - ws) >= total),
t AS (SELECT source, source_size, least((2 * source_size)::DOUBLE, (SELECT level FROM g) * w) AS target FROM s),
q AS (SELECT d.*, t.source_size, t.target, (sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto, row_number() OVER () AS r
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, coalesce((k * source_size + upto) / nullif(target, 0.0), 0.0) AS finish FROM q, (VALUES (0), (1)) AS x(k)),
m AS (SELECT *, sum(size) OVER (ORDER BY finish, o, size, k ROWS UNBOUNDED PRECEDING) <= (SELECT 3 * sum(size) // 2 FROM d) AS taken FROM e)
SELECT any_value(doc_id) AS doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target, (any_value(size) * sum(taken::INT))::BIGINT AS taken FROM m GROUP BY r"""

_TOPK = """
WITH e AS (SELECT vec_id, embedding, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, r.vec_id, list_sum([a[1] * a[2] FOR a IN list_zip(q.v, r.v)])::BIGINT AS score
      FROM e q JOIN e r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20"""

_NEAR = r"""
WITH RECURSIVE w AS (SELECT doc_id, string_split_regex(trim(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w WHERE w <> ['']),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, near) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.near),
c AS (SELECT id, min(near) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

ORACLES = {"op2_near_dups": _NEAR, "op4_licenses": licenses.oracle(), "op7_topk": _TOPK, "op8_line_dedup": _LINES, "op10_mixing": _MIX}
