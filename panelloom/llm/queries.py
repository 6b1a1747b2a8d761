"""Registered queries of the operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, extract, language, mixing, neardup, pieces, quality, topk, toxicity, turntrie, vectordup, warc
from .common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op2_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    out = language.predict_language(docs.drop("lang"), language.fit_languages(docs, modulus=4, held=2))
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op5_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op6_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf, "labels"), modulus=3, held=1))
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf, "labels"), modulus=5, held=0))
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op4_neardup(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"))


@query
def op9_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 100 = 0"), k=10)


SQL["op9_topk"] = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
 WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
 FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10"""


@query
def op10_ann(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 20 = 0"), k=20)


@query
def op1_html(spark: SparkSession, sf: str) -> DataFrame:
    return extract.extract(table(spark, sf, "pages"))


@query
def op3_warc(spark: SparkSession, sf: str) -> DataFrame:
    rows = warc.read_archives(spark, warc.write_archives(table(spark, sf, "pages"))).where("kind = 'record'")
    return rows.select(warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to").alias("refers_to"))


@query
def op7_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of every text, and what decoding them gives back, as a digest and a length."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    encoded = pieces.encode(docs)
    return pieces.with_decoded(encoded).select("doc_id", F.size("ids").alias("n_tokens"), "ids", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query
def op12_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.link_counts(table(spark, sf, "documents"))


@query
def op13_vectordup(spark: SparkSession, sf: str) -> DataFrame:
    return vectordup.vector_duplicates(table(spark, sf, "embeddings"))


SQL["op13_vectordup"] = """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.c AS component_id, coalesce(e.vec_id = c.c, true) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id"""


@query
def op11_turntrie(spark: SparkSession, sf: str) -> DataFrame:
    return turntrie.prefix_trie(table(spark, sf, "conversations"))


SQL["op11_turntrie"] = """WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, coalesce(role, '') AS r, coalesce(text, '') AS x
 FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, count(*) AS n, c - c % 5 AS s, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda z: CAST(ascii(z) AS BIGINT))),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, w: xor(v >> 1, 3988292384 * (v & 1))))) % 9 AS h FROM t GROUP BY c),
m AS (SELECT k.c, k.n, k.s, k.h, least(k.h, coalesce(b.n, 0)) AS m, least(k.h, coalesce(b.n, 0)) + greatest(k.n - k.h, 0) AS len FROM k LEFT JOIN k b ON b.c = k.s),
u AS (SELECT m.c, t.p, t.r, t.x FROM m JOIN t ON t.c = m.s AND t.p <= m.m UNION ALL SELECT m.c, t.p - m.h + m.m, t.r, t.x FROM m JOIN t ON t.c = m.c AND t.p > m.h),
a AS (SELECT c, p AS d, list({'r': r, 'x': x}) OVER (PARTITION BY c ORDER BY p) AS key, strlen(x) AS b FROM u UNION ALL SELECT c, 0, list_filter([{'r': '', 'x': ''}], lambda z: false), 0 FROM m),
g AS (SELECT a.key, a.d, min(a.c) AS conv, count(*) AS n, max(a.b) AS b, string_agg(CAST(a.c AS VARCHAR), ',' ORDER BY a.c) FILTER (WHERE m.len = a.d) AS ends FROM a JOIN m USING (c) GROUP BY 1, 2),
ch AS (SELECT list_slice(key, 1, d - 1) AS key, d - 1 AS d, count(*) AS n FROM g WHERE d > 0 GROUP BY 1, 2),
h AS (SELECT g.*, coalesce(ch.n, 0) AS children FROM g LEFT JOIN ch ON ch.d = g.d AND ch.key = g.key),
f AS (SELECT x.key, x.d, count(*) FILTER (WHERE y.children = 0) AS leaves, sum((y.n - 1) * y.b) AS saved FROM h x JOIN h y ON y.d >= x.d AND list_slice(y.key, 1, x.d) = x.key GROUP BY 1, 2)
SELECT h.conv AS conv_id, CAST(h.d AS BIGINT) AS depth, q.conv AS parent_conv_id, CAST(h.n AS BIGINT) AS n_convs, CAST(h.children AS BIGINT) AS n_children, CAST(f.leaves AS BIGINT) AS n_leaves,
 CAST(f.saved AS BIGINT) AS saved_tokens, sha256(coalesce(h.ends, '')) AS ends_sha256
FROM h JOIN f ON f.d = h.d AND f.key = h.key LEFT JOIN g q ON q.d = h.d - 1 AND q.key = list_slice(h.key, 1, h.d - 1)"""
