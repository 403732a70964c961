"""Queries over inverted lists: filtered search, quantised codes with refinement, recall by probes, token search."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import evaluation, lists, vector
from siltstone.plans.registry import query
from siltstone.plans.retrieval import _KNN, _vectors
from siltstone.sources.tables import table


def _allowed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return docs.where(F.col("lang").isin("en", "de") & (F.col("source") != "src0"))


@query(
    """WITH ok AS (SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'de') AND source <> 'src0'),
n AS (SELECT count(*) AS n_read FROM embeddings JOIN ok ON vec_id = doc_id),
s AS (SELECT a.vec_id AS query_id, doc_id, lang, source, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id JOIN ok ON b.vec_id = doc_id)
SELECT query_id, doc_id, score, rank, lang, source, n_read FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s), n WHERE rank <= 10"""
)
def filtered_knn(spark, sf_dir):
    """Vector search within a filter on documents, all lists read, and the found rows with their columns."""
    v, q = _vectors(spark, sf_dir)
    allowed = _allowed(spark, sf_dir)
    ivf = lists.Ivf.fit(v)
    found = lists.filtered_search(ivf, ivf.index(v), q, allowed, 10, probes=len(ivf.centroids))
    return found.join(allowed, "doc_id").select("query_id", "doc_id", "score", "rank", "lang", "source", "n_read")


@query()
def filtered_knn_probed(spark, sf_dir):
    """The same from the nearest lists only, widened until they hold twice the hits asked for, with the fan-out."""
    v, q = _vectors(spark, sf_dir)
    ivf = lists.Ivf.fit(v)
    return lists.filtered_search(ivf, ivf.index(v), q, _allowed(spark, sf_dir), 10)


@query()
def pq_knn(spark, sf_dir):
    """Candidates by 16-byte codes, ranked anew by the stored vectors."""
    v, q = _vectors(spark, sf_dir)
    ivf = lists.Ivf.fit(v)
    pq = lists.Pq.fit(ivf, v)
    return pq.refined(pq.encode(ivf.index(v)), v, q, 20)


_CURVE = f"""{_KNN}, e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(v[i]) AS m FROM e, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1),
o AS (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY d, label) AS place FROM (SELECT vec_id AS query_id, c.label, list_inner_product(c, c) - 2 * list_inner_product(v, c) AS d FROM e, c WHERE vec_id % 20 = 0)),
t AS (SELECT query_id, doc_id FROM nn WHERE rank <= 20),
g AS (SELECT place, sum(n) AS read FROM o JOIN (SELECT label, count(*) AS n FROM e GROUP BY 1) USING (label) GROUP BY 1),
h AS (SELECT place, count(*) AS hits FROM t JOIN e ON vec_id = doc_id JOIN o USING (query_id, label) GROUP BY 1),
curve AS (SELECT place AS probes, (sum(coalesce(hits, 0)) OVER (ORDER BY place))::BIGINT AS n_found, round((sum(coalesce(hits, 0)) OVER (ORDER BY place)) / (SELECT count(*) FROM t)::DOUBLE, 9) AS recall, round((sum(read) OVER (ORDER BY place)) / (SELECT count(DISTINCT query_id) FROM o)::DOUBLE, 6) AS mean_read FROM g LEFT JOIN h USING (place))"""


def _curve(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    ivf, index = lists.Ivf.given(v.withColumnRenamed("label", "list"))
    curve = lists.recall_curve(lists.placed(ivf, index, q), index, vector.exact_neighbours(v, q, 20))
    return curve.select("probes", "n_found", F.round("recall", 9).alias("recall"), F.round("mean_read", 6).alias("mean_read"))


@query(f"WITH {_CURVE} SELECT * FROM curve")
def recall_curve(spark, sf_dir):
    """Recall and vectors read at every number of probes, over lists that a column gives."""
    return _curve(spark, sf_dir)


@query(f"WITH {_CURVE}, b AS (SELECT * FROM curve WHERE recall >= (SELECT max(recall) FROM curve) - 0.005) SELECT arg_min(probes, mean_read) AS probes, min(mean_read) AS mean_read FROM b")
def probe_choice(spark, sf_dir):
    """The number of probes that reads least within 0.005 of the best recall."""
    sweep = _curve(spark, sf_dir).select(F.col("probes").alias("name"), "recall", F.col("mean_read").alias("latency"))
    return evaluation.select_candidate(sweep).select(F.col("name").alias("probes"), F.col("latency").alias("mean_read"))


def _tokens(spark, sf_dir):
    """Five vectors a document, as its tokens; every twentieth document asks with its own."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("token"), F.expr("vec_id div 5").alias("doc_id"), F.col("embedding").alias("v"))
    return e, e.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "token", F.col("v").alias("q"))


@query(
    f"""WITH {_KNN}, c AS (SELECT DISTINCT query_id // 5 AS query_id, doc_id // 5 AS doc_id FROM nn WHERE rank <= 10 AND (query_id // 5) % 20 = 0 AND query_id // 5 <> doc_id // 5),
m AS (SELECT c.query_id, c.doc_id, a.vec_id, max(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS best FROM c JOIN embeddings a ON a.vec_id // 5 = c.query_id JOIN embeddings b ON b.vec_id // 5 = c.doc_id GROUP BY 1, 2, 3),
s AS (SELECT query_id, doc_id, round(sum(best), 5) AS score, round(max(best), 6) AS top FROM m GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10"""
)
def token_rescore(spark, sf_dir):
    """Narrow mode: given candidates by the token matrices of those alone, with the best match of each."""
    v, q = _vectors(spark, sf_dir)
    tokens, asked = _tokens(spark, sf_dir)
    given = vector.exact_neighbours(v, q, 10).select(F.expr("query_id div 5").alias("query_id"), F.expr("doc_id div 5").alias("doc_id")).where("query_id % 20 = 0 and query_id <> doc_id")
    out = lists.token_rescored(given, asked, tokens, 10, explain=1)
    return out.select("query_id", "doc_id", "score", F.get("matches", F.lit(0))["similarity"].alias("top"), "rank")


@query()
def token_search(spark, sf_dir):
    """Wide, then narrow: candidates from lists of tokens, MaxSim over their matrices."""
    tokens, asked = _tokens(spark, sf_dir)
    ids = tokens.select(F.col("token").alias("doc_id"), "v")
    ivf = lists.Ivf.fit(ids)
    near = lists.token_candidates(ivf, ivf.index(ids), tokens, asked, 100)
    return lists.token_rescored(near, asked, tokens, 10)
