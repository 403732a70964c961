"""Queries of the retrieval operators: documents searched by benchmark items, embeddings by themselves, events as hits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from siltstone.functions.text import tokens
from siltstone.operators import evaluation, fusion, gating, lexical, lists, vector
from siltstone.plans.registry import query
from siltstone.sources.tables import spread, table

_TOK = """doc_tok AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '{p}'))) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM doc_tok GROUP BY 1, 2),
len AS (SELECT doc_id, len(regexp_extract_all(text, '{p}'))::DOUBLE AS dl FROM documents),
st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM len),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY 1),
q AS (SELECT item_id AS query_id, term, count(*)::DOUBLE AS qn FROM (SELECT item_id, lower(unnest(regexp_extract_all(text, '{p}'))) AS term FROM benchmark) GROUP BY 1, 2)"""
_W = "[A-Za-z0-9]+"
_BM25 = "ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * dl / avgdl))"
_TOP = """, s AS (SELECT query_id, doc_id, round(sum({w} * qn), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term) JOIN len USING (doc_id), st GROUP BY 1, 2)
SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {k}"""


def _ranked(weight: str, k: int = 50, pattern: str = _W) -> str:
    return "WITH " + _TOK.format(p=pattern) + _TOP.format(w=weight, k=k)


def _tables(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")), table(spark, sf_dir, "benchmark")


@query(_ranked(_BM25))
def bm25_topk(spark, sf_dir):
    return lexical.bm25(*_tables(spark, sf_dir))


@query(
    """WITH t AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS term, 1.0::DOUBLE AS w FROM documents
UNION ALL SELECT doc_id, lower(unnest(regexp_extract_all(source, '[A-Za-z0-9]+'))), 2.0 FROM documents
UNION ALL SELECT doc_id, lower(unnest(regexp_extract_all(lang, '[A-Za-z0-9]+'))), 1.2 FROM documents),
tf AS (SELECT doc_id, term, sum(w) AS tf FROM t GROUP BY 1, 2), len AS (SELECT doc_id, sum(w) AS dl FROM t GROUP BY 1),
st AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT sum(w) FROM t) / (SELECT count(*) FROM documents) AS avgdl),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY 1),
q AS (SELECT item_id AS query_id, term, count(*)::DOUBLE AS qn FROM (SELECT item_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS term FROM benchmark) GROUP BY 1, 2)"""
    + _TOP.format(w=_BM25, k=50)
)
def bm25_weighted_fields(spark, sf_dir):
    return lexical.bm25(*_tables(spark, sf_dir), fields={"text": 1.0, "source": 2.0, "lang": 1.2})


_FIELDS = ("text", "source", "lang")
_CLAUSES = "text || ' source:( src' || (item_id % 20) || ' src3 )^2.0 lang:(en)'"


def _field_sql(f: str) -> str:
    asked = {"text": "text", "source": "'src' || (item_id % 20) || ' src3'", "lang": "'en'"}[f]
    boost = {"text": 1.0, "source": 2.0, "lang": 1.0}[f]
    words = lambda x: f"regexp_extract_all({x}, '{_W}')"
    return f"""SELECT query_id, doc_id, {_BM25} * qn AS s FROM (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, lower(unnest({words(f)})) AS term FROM documents) GROUP BY 1, 2) JOIN (SELECT term, count(DISTINCT doc_id)::DOUBLE AS df FROM (SELECT doc_id, lower(unnest({words(f)})) AS term FROM documents) GROUP BY 1) USING (term)
JOIN (SELECT item_id AS query_id, term, {boost} * count(*) AS qn FROM (SELECT item_id, lower(unnest({words(asked)})) AS term FROM benchmark) GROUP BY 1, 2) USING (term)
JOIN (SELECT doc_id, len({words(f)})::DOUBLE AS dl FROM documents) USING (doc_id), (SELECT count(*)::DOUBLE AS n, avg(len({words(f)})) AS avgdl FROM documents)"""


@query(f"WITH s AS (SELECT query_id, doc_id, round(sum(s), 6) AS score FROM ({' UNION ALL '.join(map(_field_sql, _FIELDS))}) GROUP BY 1, 2) SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50")
def boosted_fields(spark, sf_dir):
    """Queries with boosted clauses on fields, each field with its own lengths and frequencies."""
    docs, items = _tables(spark, sf_dir)
    return lexical.bm25_fields(docs, items.select("item_id", F.expr(_CLAUSES).alias("text")), list(_FIELDS))


@query(_ranked("ln((n + 1) / (df + 0.5) + 1) * tf"))
def tfidf_topk(spark, sf_dir):
    return lexical.tfidf(*_tables(spark, sf_dir))


@query(_ranked("(n + 1) / (df + 0.5) * tf"))
def splade_idf_topk(spark, sf_dir):
    return lexical.ratio_idf(*_tables(spark, sf_dir))


@query(_ranked("ln(1 + tf) * ln((n - df + 0.5) / (df + 0.5) + 1)", pattern="[A-Za-z0-9_]+"))
def impact_topk(spark, sf_dir):
    return lexical.impact(*_tables(spark, sf_dir))


@query(
    "WITH " + _TOK.format(p=_W) + """, p AS (SELECT * FROM (VALUES (0.9::DOUBLE, 0.4::DOUBLE), (1.2, 0.75), (0.6, 0.2)) v(k1, b)),
s AS (SELECT k1, b, query_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)) * qn), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term) JOIN len USING (doc_id), st, p GROUP BY 1, 2, 3, 4)
SELECT k1, b, query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY k1, b, query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""
)
def bm25_grid(spark, sf_dir):
    return lexical.grid(*_tables(spark, sf_dir), [(0.9, 0.4), (1.2, 0.75), (0.6, 0.2)])


@query(
    "WITH " + _TOK.format(p=_W) + f""", s1 AS (SELECT query_id, doc_id, round(sum({_BM25} * qn), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term) JOIN len USING (doc_id), st GROUP BY 1, 2),
f AS (SELECT query_id, doc_id, score / sum(score) OVER (PARTITION BY query_id) AS p FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s1 WHERE score > 0) WHERE rank <= 10),
m AS (SELECT query_id, term, sum(p * tf / dl) AS w FROM f JOIN tf USING (doc_id) JOIN len USING (doc_id) GROUP BY 1, 2),
t AS (SELECT query_id, term, w FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(w, 12) DESC, term) AS r FROM m) WHERE r <= 10),
b AS (SELECT query_id, term, sum(qn) AS qn FROM (SELECT query_id, term, 0.5 * w / sum(w) OVER (PARTITION BY query_id) AS qn FROM t UNION ALL SELECT query_id, term, 0.5 * qn / sum(qn) OVER (PARTITION BY query_id) FROM q) GROUP BY 1, 2),
s AS (SELECT query_id, doc_id, round(sum({_BM25} * qn), 6) AS score FROM tf JOIN df USING (term) JOIN b USING (term) JOIN len USING (doc_id), st GROUP BY 1, 2)
SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50"""
)
def rm3_expand(spark, sf_dir):
    return lexical.rm3(*_tables(spark, sf_dir))


@query(
    "WITH " + _TOK.format(p=_W) + """, d AS (SELECT doc_id, term, floor(ln(1 + tf) * 100 + 0.5)::BIGINT AS wd FROM tf),
qq AS (SELECT query_id, term, least(round_even(ln(1 + qn) * 100, 0), 256)::BIGINT AS wq FROM q),
s AS (SELECT query_id, doc_id, sum(wd * wq)::DOUBLE AS score FROM d JOIN qq USING (term) GROUP BY 1, 2)
SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20"""
)
def sparse_impact_topk(spark, sf_dir):
    return lexical.quantised_impact(*_tables(spark, sf_dir), 20)


@query(
    """WITH q AS (SELECT item_id AS query_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS term FROM benchmark),
w AS (SELECT query_id, term, ln(1 + count(*)) AS weight FROM q GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(weight, 9) DESC, term) AS r, count(*) OVER (PARTITION BY query_id) AS n FROM w)
SELECT query_id, term, round(weight, 9) AS weight FROM r WHERE r <= 16 AND r <= greatest(1, ceil(n * 0.75))"""
)
def sparse_query_pruning(spark, sf_dir):
    q = lexical.query_terms(table(spark, sf_dir, "benchmark")).select("query_id", "term", F.round(F.log1p("qn"), 9).alias("weight"))
    return lexical.pruned_query(q, static=0.25, most=16)


@query("WITH " + _TOK.format(p=_W) + " SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY 1")
def token_df_stats(spark, sf_dir):
    docs, _ = _tables(spark, sf_dir)
    tf = docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("SELECT lang, count(*) AS n, sum(len(regexp_extract_all(text, '[A-Za-z0-9]+')))::BIGINT AS tokens, round(avg(len(regexp_extract_all(text, '[A-Za-z0-9]+'))), 6) AS avgdl, max(len(regexp_extract_all(text, '[A-Za-z0-9]+')))::BIGINT AS longest FROM documents GROUP BY 1")
def doc_length_stats(spark, sf_dir):
    docs, _ = _tables(spark, sf_dir)
    n = F.size(tokens(F.col("text"))).cast("long")
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.sum(n).alias("tokens"), F.round(F.avg(n), 6).alias("avgdl"), F.max(n).alias("longest"))


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"), "label"), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("q_label"))


_KNN = """nn AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM
(SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id))"""


@query(f"WITH {_KNN} SELECT * FROM nn WHERE rank <= 20")
def knn_exact_topk(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return vector.exact_neighbours(v, q, 20)


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings")
def knn_l2norm(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(vector.norm(F.col("embedding")), 6).alias("norm"), F.round(vector.normalised(F.col("embedding"))[0], 6).alias("first"))


@query(
    f"""WITH {_KNN}, c AS (SELECT query_id, doc_id FROM nn WHERE rank <= 50),
s AS (SELECT query_id, doc_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / ((sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) + 1e-9) * (sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) + 1e-9)), 6) AS score FROM c JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = doc_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10"""
)
def rerank_cosine_topk(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return vector.reranked(vector.exact_neighbours(v, q, 50), v, q, 10)


@query(
    f"""WITH {_KNN} SELECT * FROM nn WHERE rank <= 20"""
)
def dual_index_merge_topk(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    first = F.col("doc_id") % 5 != 0
    return vector.merged(vector.exact_neighbours(v.where(first), q, 20), vector.exact_neighbours(v.where(~first), q, 20), 20)


@query()
def ivf_knn(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    ivf = lists.Ivf.fit(v)
    return ivf.search(ivf.index(v), q, 20)


@query()
def ann_recall_vs_exact(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    ivf = lists.Ivf.fit(v)
    return evaluation.overlap(ivf.search(ivf.index(v), q, 20), vector.exact_neighbours(v, q, 20))


_ALL_ASK = _KNN.replace("a.vec_id % 20 = 0 AND ", "")
_RELEVANT = "rel AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.label = b.label)"


@query(
    f"""WITH {_ALL_ASK}, {_RELEVANT}, f AS (SELECT query_id, count(*) AS found, max(1.0 / rank) AS rr FROM nn JOIN rel USING (query_id, doc_id) WHERE rank <= 10 GROUP BY 1), n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1)
SELECT count(*) AS n_queries, round(avg(coalesce(found, 0) / n::DOUBLE), 6) AS recall, round(avg((coalesce(found, 0) > 0)::INT), 6) AS hit_rate, round(avg(coalesce(rr, 0)), 6) AS mrr FROM n LEFT JOIN f USING (query_id)"""
)
def recall_mrr_at_k(spark, sf_dir):
    """Every vector asks, of all others."""
    v, _ = _vectors(spark, sf_dir)
    q = v.select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"), "label")
    hits = vector.exact_neighbours(v, q, 10)
    m = evaluation.means(evaluation.per_query_by_label(hits, q.select("query_id", "label"), v.select("doc_id", "label"), 10))
    return m.select("n_queries", *[F.round(c, 6).alias(c) for c in ("recall", "hit_rate", "mrr")])


@query(
    """WITH t AS (SELECT vec_id // 5 AS id, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
m AS (SELECT a.id AS query_id, b.id AS doc_id, a.vec_id, max(list_inner_product(a.v, b.v)) AS best FROM t a JOIN t b ON a.id % 20 = 0 AND a.id <> b.id GROUP BY 1, 2, 3),
s AS (SELECT query_id, doc_id, round(sum(best), 5) AS score FROM m GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10"""
)
def maxsim_late_interaction(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 5").alias("id"), "vec_id", "embedding")
    return vector.max_sim(e.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vec_id").alias("qt"), F.col("embedding").alias("q")), e.select(F.col("id").alias("doc_id"), F.col("vec_id").alias("dt"), F.col("embedding").alias("v")), 10)


_HITS = "hits AS (SELECT user_id AS query_id, event_type AS channel, event_id % 97 AS doc_id, max(round(value, 4)) AS score FROM events GROUP BY 1, 2, 3), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY score DESC, doc_id) AS rank FROM hits)"


def _hits(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("query_id"), F.col("event_type").alias("channel"), (F.col("event_id") % 97).alias("doc_id")).agg(F.max(F.round("value", 4)).alias("score"))


@query(f"WITH {_HITS} SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, array_to_string(list_sort(list(DISTINCT channel)), ',') AS channels FROM rk GROUP BY 1, 2")
def rrf_fuse(spark, sf_dir):
    return fusion.rrf(fusion.with_ranks(_hits(spark, sf_dir))).select("query_id", "doc_id", F.round("score", 9).alias("score"), F.concat_ws(",", "channels").alias("channels"))


_WEIGHTS = {"click": 2.0, "view": 1.0, "purchase": 0.5, "error": 0.0}
_CASE = "CASE channel WHEN 'click' THEN 2.0 WHEN 'view' THEN 1.0 WHEN 'purchase' THEN 0.5 WHEN 'error' THEN 0.0"


@query(f"WITH {_HITS} SELECT query_id, doc_id, round(sum({_CASE} ELSE 1.0 END / (60 + rank)), 9) AS score, count(*) AS n FROM rk WHERE channel <> 'error' GROUP BY 1, 2")
def weighted_rrf(spark, sf_dir):
    out = fusion.weighted_rrf(fusion.with_ranks(_hits(spark, sf_dir)), _WEIGHTS)
    return out.select("query_id", "doc_id", F.round("score", 9).alias("score"), F.size("contributions").cast("long").alias("n"))


_MINMAX = "CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE {c} END"


@query(f"WITH {_HITS}, n AS (SELECT *, {_MINMAX.format(c='1.0')} AS n FROM hits WINDOW w AS (PARTITION BY query_id, channel)) SELECT query_id, doc_id, round(sum(n * {_CASE} ELSE 0.0 END / 3.5), 9) AS score FROM n GROUP BY 1, 2")
def pool_minmax(spark, sf_dir):
    return fusion.pooled(_hits(spark, sf_dir), _WEIGHTS).withColumn("score", F.round("score", 9))


@query(f"WITH {_HITS}, x AS (SELECT *, exp(score - max(score) OVER (PARTITION BY query_id, channel)) AS e FROM hits), n AS (SELECT *, e / sum(e) OVER (PARTITION BY query_id, channel) AS n FROM x) SELECT query_id, doc_id, round(sum(n * {_CASE} ELSE 0.0 END / 3.5), 9) AS score FROM n GROUP BY 1, 2")
def pool_softmax(spark, sf_dir):
    return fusion.pooled(_hits(spark, sf_dir), _WEIGHTS, "softmax").withColumn("score", F.round("score", 9))


@query(f"WITH {_HITS} SELECT query_id, channel, doc_id, round({_MINMAX.format(c='0.0')}, 8) AS minmax, round(CASE WHEN stddev_pop(score) OVER w > 0 THEN (score - avg(score) OVER w) / stddev_pop(score) OVER w ELSE 0 END, 6) AS z FROM hits WINDOW w AS (PARTITION BY query_id, channel)")
def zscore_by_channel(spark, sf_dir):
    by = ["query_id", "channel"]
    return _hits(spark, sf_dir).select("query_id", "channel", "doc_id", F.round(fusion.min_max(F.col("score"), by), 8).alias("minmax"), F.round(fusion.z_score(F.col("score"), by), 6).alias("z"))


@query(f"WITH {_HITS} SELECT query_id, doc_id, max(score) AS score, max_by(channel, (score, channel)) AS channel FROM hits GROUP BY 1, 2")
def best_score_merge(spark, sf_dir):
    return fusion.best_raw(_hits(spark, sf_dir))


@query(f"WITH {_HITS}, a AS (SELECT event_id % 97 AS doc_id, (epoch(TIMESTAMP '2024-02-01') - epoch(max(ts))) / 86400.0 AS age FROM events GROUP BY 1) SELECT query_id, channel, doc_id, round(score * (1 + 0.15 * pow(0.5, greatest(age, 0) / 30.0)), 6) AS score FROM hits JOIN a USING (doc_id)")
def recency_boost(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ages = e.groupBy((F.col("event_id") % 97).alias("doc_id")).agg(((F.unix_micros(F.lit("2024-02-01").cast("timestamp")) - F.unix_micros(F.max(F.col("ts").cast("timestamp")))) / 86400e6).alias("age_days"))
    return fusion.recency(_hits(spark, sf_dir), ages).select("query_id", "channel", "doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_HITS}, r AS (SELECT query_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM hits) SELECT query_id, round(max(score) FILTER (r = 1) - max(score) FILTER (r = 2), 6) AS margin FROM r WHERE r <= 2 GROUP BY 1")
def score_margin(spark, sf_dir):
    return fusion.margin(_hits(spark, sf_dir)).withColumn("margin", F.round("margin", 6))


@query(f"WITH {_HITS} SELECT query_id, channel, count(*) AS n FROM (SELECT *, max(score) OVER (PARTITION BY query_id, channel) AS b FROM hits) WHERE channel <> 'view' OR b >= 20 GROUP BY 1, 2")
def semantic_gate(spark, sf_dir):
    return fusion.gated(_hits(spark, sf_dir), "view", 20.0).groupBy("query_id", "channel").agg(F.count("*").alias("n"))


@query(f"WITH {_HITS} SELECT query_id, channel, doc_id, score, rank FROM rk WHERE rank <= CASE channel WHEN 'click' THEN 3 WHEN 'view' THEN 2 ELSE 0 END")
def channel_depths(spark, sf_dir):
    return fusion.with_ranks(_hits(spark, sf_dir), {"click": 3, "view": 2})


@query(
    f"""WITH {_HITS}, o AS (SELECT query_id, doc_id, rank FROM rk WHERE channel = 'view'), n AS (SELECT query_id, doc_id, rank FROM rk WHERE channel = 'click' AND rank <= 3),
j AS (SELECT coalesce(o.query_id, n.query_id) AS query_id, coalesce(o.doc_id, n.doc_id) AS doc_id, o.rank AS old, n.rank AS new FROM o FULL JOIN n USING (query_id, doc_id))
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY new NULLS LAST, old NULLS LAST, doc_id) AS position FROM j"""
)
def rerank_merge(spark, sf_dir):
    r = fusion.with_ranks(_hits(spark, sf_dir))
    return fusion.reordered(r.where("channel = 'view'"), r.where("channel = 'click' and rank <= 3"))


@query(
    """SELECT doc_id, lang, source, CASE WHEN list_has_any([lang, source], ['fr', 'src3']) THEN 0.08 WHEN list_has_any([CASE lang WHEN 'de' THEN 'fr' WHEN 'es' THEN 'src3' ELSE '' END], ['fr', 'src3']) THEN 0.04 ELSE 0 END::DOUBLE AS score FROM documents"""
)
def kg_concept_boost(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.lit(0.0).alias("score"))
    near = F.array(F.when(F.col("lang") == "de", "fr").when(F.col("lang") == "es", "src3").otherwise(""))
    return fusion.concept_boost(d, F.array("lang", "source"), near, F.array(F.lit("fr"), F.lit("src3")))


_WORDS = "list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')"
_CODE = "'([A-Za-z_][A-Za-z0-9_]*|[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+|[a-z0-9_]+(?:\\.[a-z0-9_]+)+|[A-Za-z0-9_\\-/\\.]+)'"
_PROFILE = f"""w AS (SELECT item_id AS query_id, text, {_WORDS} AS w FROM benchmark),
a AS (SELECT query_id, len(w)::BIGINT AS length, len(list_distinct(w)) / len(w)::DOUBLE AS unique_ratio, len(list_filter(w, lambda x: regexp_full_match(x, {_CODE}))) / len(w)::DOUBLE AS code_token_ratio, len(list_filter(w, lambda x: regexp_matches(x, '[0-9]'))) / len(w)::DOUBLE AS digit_ratio, length(regexp_replace(text, '[A-Za-z0-9_\\s]', '', 'g')) / greatest(length(text), 1)::DOUBLE AS symbol_ratio FROM w),
b AS (SELECT *, 1.0 - code_token_ratio AS oov_ratio, code_token_ratio > 0.5 OR digit_ratio > 0.2 OR symbol_ratio > 0.03 AS looks_literal FROM a),
p AS (SELECT *, NOT looks_literal AND length <= 5 AND code_token_ratio < 0.3 AS looks_vague, greatest(0, least(1, CASE WHEN length <= 3 AND code_token_ratio < 0.3 THEN 0.6 ELSE 0 END + CASE WHEN oov_ratio > 0.6 THEN 0.3 ELSE 0 END - CASE WHEN looks_literal THEN 0.4 ELSE 0 END))::DOUBLE AS ambiguity FROM b)"""


@query(f"WITH {_PROFILE} SELECT query_id, length, looks_literal, looks_vague, round(unique_ratio, 6) AS unique_ratio, round(code_token_ratio, 6) AS code_token_ratio, round(digit_ratio, 6) AS digit_ratio, round(symbol_ratio, 6) AS symbol_ratio, round(oov_ratio, 6) AS oov_ratio, round(ambiguity, 6) AS ambiguity FROM p")
def query_profile(spark, sf_dir):
    p = gating.profile(table(spark, sf_dir, "benchmark"))
    return p.select("query_id", "length", "looks_literal", "looks_vague", *[F.round(c, 6).alias(c) for c in ("unique_ratio", "code_token_ratio", "digit_ratio", "symbol_ratio", "oov_ratio", "ambiguity")])


@query(
    f"""WITH {_PROFILE}, k AS (SELECT *, CASE WHEN looks_literal THEN 'literal' WHEN looks_vague OR ambiguity >= 0.5 THEN 'vague' ELSE 'default' END AS kind FROM p)
SELECT query_id, kind, CASE kind WHEN 'literal' THEN 80 WHEN 'vague' THEN 150 ELSE 100 END::BIGINT AS semantic_depth, CASE kind WHEN 'literal' THEN 80 WHEN 'vague' THEN 60 ELSE 50 END::BIGINT AS bm25_depth, CASE kind WHEN 'literal' THEN 30 WHEN 'vague' THEN 80 ELSE 50 END::BIGINT AS splade_depth, CASE kind WHEN 'literal' THEN 40 WHEN 'vague' THEN 90 ELSE 60 END::BIGINT AS rrf_k, length BETWEEN 2 AND 12 AS rm3 FROM k"""
)
def budget_decision(spark, sf_dir):
    return gating.budgets(gating.profile(table(spark, sf_dir, "benchmark")))


@query(
    f"""WITH {_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM hits),
s AS (SELECT query_id, count(*) AS candidate_count, max(score) FILTER (r = 1) AS best, max(score) FILTER (r = 2) AS second, (query_id % 30) * 10.0 AS elapsed_ms FROM r GROUP BY 1)
SELECT query_id, CASE WHEN candidate_count <= 0 THEN 'no_candidates' WHEN candidate_count < 8 THEN 'insufficient_candidates' WHEN elapsed_ms > 150 THEN 'upstream_budget_exceeded' WHEN best - second >= 0.1 THEN 'high_margin' ELSE 'within_budget' END AS reason FROM s"""
)
def stage_gate(spark, sf_dir):
    h = _hits(spark, sf_dir)
    h = h.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
    s = h.groupBy("query_id").agg(F.count("*").alias("candidate_count"), F.max(F.when(F.col("r") == 1, F.col("score"))).alias("best"), F.max(F.when(F.col("r") == 2, F.col("score"))).alias("second")).withColumn("elapsed_ms", (F.col("query_id") % 30) * 10.0)
    return gating.stage_gate(s, min_candidates=8).select("query_id", "reason")


@query(
    "WITH w AS (SELECT conv_id, turn, text, list_filter(string_split_regex(lower(text), '[^A-Za-z0-9_]+'), lambda x: x <> '') AS w FROM conversations) SELECT conv_id, turn, CASE WHEN text = '' THEN false WHEN len(w) <= 3 THEN true WHEN regexp_matches(text, '(?:\\w+::\\w+)|(?:\\w+\\.\\w+)|(?:[/\\\\])|(?:[A-Za-z]+[A-Z][a-z]+)|(?:[A-Za-z_]+\\d+)') THEN false ELSE list_has_any(w, ["
    + ", ".join(f"'{w}'" for w in gating.HEAD_TERMS)
    + "]) END AS feedback FROM w"
)
def rm3_gate(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", gating.wants_feedback(F.col("text")).alias("feedback"))


def _hybrid_sql() -> str:
    return (
        "WITH " + _TOK.format(p=_W) + f""", s AS (SELECT query_id, doc_id, round(sum({_BM25} * qn), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term) JOIN len USING (doc_id), st GROUP BY 1, 2),
lex AS (SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50),
den AS (SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT i.item_id AS query_id, b.vec_id AS doc_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM benchmark i JOIN embeddings a ON a.vec_id = i.item_id JOIN embeddings b ON b.vec_id <> i.item_id)) WHERE rank <= 50),
f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM lex UNION ALL SELECT * FROM den) GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 10"""
    )


@query(_hybrid_sql())
def hybrid_search(spark, sf_dir):
    """Items ranked by BM25 and by vector, fused by reciprocal ranks."""
    docs, items = _tables(spark, sf_dir)
    v, _ = _vectors(spark, sf_dir)
    asked = items.join(v, items.item_id == v.doc_id).select(F.col("item_id").alias("query_id"), F.col("v").alias("q"))
    lex = lexical.bm25(docs, items, 50).select("query_id", F.lit("bm25").alias("channel"), "doc_id", "rank")
    dense = vector.exact_neighbours(v, asked, 50).select("query_id", F.lit("dense").alias("channel"), "doc_id", "rank")
    fused = fusion.rrf(lex.unionByName(dense)).select("query_id", "doc_id", F.round("score", 9).alias("score"))
    return vector.ranked(fused, 10)
