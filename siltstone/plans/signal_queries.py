"""Queries of the small row operators, and of summaries over results."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.operators import evaluation, fusion, graph, repo, signals, vector
from siltstone.plans.graph_queries import _EDGES, _edges
from siltstone.plans.registry import query
from siltstone.plans.retrieval import _HITS, _KNN, _hits, _vectors
from siltstone.sources.tables import table


@query("SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(lower(text), '@') THEN 'contact' END, CASE WHEN contains(lower(text), 'licen') OR contains(lower(text), 'version') THEN 'legal' END], lambda x: x IS NOT NULL), ',') AS concepts FROM documents")
def query_concepts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat_ws(",", signals.concepts_of(F.col("text"), {"legal": ["Licen", "version"], "contact": ["@"]})).alias("concepts"))


@query("SELECT p_name AS name FROM (SELECT DISTINCT p_name FROM part) WHERE contains(lower(p_name), 'gizmo') ORDER BY 1 LIMIT 25")
def concept_lookup(spark, sf_dir):
    return signals.find_concepts(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct(), "GIZMO", 25)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'")
def tag_slices(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.array("o_orderstatus", "o_orderpriority").alias("tags"))
    return signals.slices(o, ["F", "1-URGENT"]).select("o_orderkey")


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN event_type END, 'any') AS kind, coalesce(CASE WHEN event_id % 2 = 0 THEN user_id END, -1) AS user_id FROM events")
def scope_defaults(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("kind"), F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("user_id"))
    return signals.scoped(e, {"kind": "any", "user_id": -1})


@query("SELECT p_partkey, p_size >= 45 OR p_partkey % 9 = 0 OR (p_retailprice < 1000 AND p_size >= 2) AS overlay FROM part")
def overlay_candidates(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") >= 45).alias("is_hub"), F.when(F.col("p_partkey") % 9 == 0, 1).otherwise(0).alias("type_errors"), F.when(F.col("p_retailprice") < 1000, 0.0).otherwise(1.0).alias("param_ratio"), F.col("p_size").alias("fan_in"))
    return p.select("p_partkey", signals.needs_overlay(p).alias("overlay"))


@query("SELECT user_id, round(count(*) FILTER (event_type = 'error') / count(*), 9) AS error_rate, round(count(*) FILTER (event_type = 'click') / greatest(count(*) FILTER (event_type = 'view'), 1), 9) AS click_rate FROM events GROUP BY 1")
def stage_ratios(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("event_type") == k).alias(k) for k in ("error", "click", "view")])
    return e.select("user_id", F.round(signals.ratio(F.col("error"), F.col("n")), 9).alias("error_rate"), F.round(signals.ratio(F.col("click"), F.greatest("view", F.lit(1))), 9).alias("click_rate"))


@query("WITH r AS (SELECT doc_id IN (SELECT doc_id FROM labels) AS chunked, doc_id IN (SELECT vec_id FROM embeddings) AS indexed, doc_id IN (SELECT vec_id FROM embeddings WHERE label = 1) AS retrieved FROM documents) SELECT count(*) AS n, round(avg(chunked::INT), 9) AS chunked_ratio, round(avg(indexed::INT), 9) AS indexed_ratio, round(avg(retrieved::INT), 9) AS retrieved_ratio FROM r")
def coverage_trio(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    mark = lambda df, c, name: df.select(F.col(c).alias("doc_id")).distinct().withColumn(name, F.lit(True))
    e = table(spark, sf_dir, "embeddings")
    rows = d.join(mark(table(spark, sf_dir, "labels"), "doc_id", "chunked"), "doc_id", "left").join(mark(e, "vec_id", "indexed"), "doc_id", "left").join(mark(e.where("label = 1"), "vec_id", "retrieved"), "doc_id", "left").na.fill(False)
    out = signals.coverage_trio(rows)
    return out.select("n", *[F.round(c, 9).alias(c) for c in ("chunked_ratio", "indexed_ratio", "retrieved_ratio")])


@query(f"WITH {_KNN}, a AS (SELECT query_id, doc_id FROM nn WHERE rank <= 20), b AS (SELECT query_id, doc_id FROM nn WHERE rank BETWEEN 6 AND 25), x AS (SELECT query_id, count(*) AS n FROM a JOIN b USING (query_id, doc_id) GROUP BY 1) SELECT round(avg(n), 9) AS avg_overlap, round(avg(20 - n), 9) AS avg_replaced FROM x")
def refine_delta(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    nn = vector.exact_neighbours(v, q, 25)
    out = evaluation.refine_delta(nn.where("rank <= 20"), nn.where("rank >= 6"))
    return out.select(F.round("avg_overlap", 9).alias("avg_overlap"), F.round("avg_replaced", 9).alias("avg_replaced"))


@query(f"WITH {_EDGES}, i AS (SELECT dst AS node, count(*) AS n FROM edges GROUP BY 1), o AS (SELECT src AS node, count(*) AS n FROM edges GROUP BY 1) SELECT count(*) AS n_nodes, sum(coalesce(i.n, 0))::BIGINT AS n_edges, max(coalesce(i.n, 0)) AS most_in, max(coalesce(o.n, 0)) AS most_out, count(*) FILTER (i.n IS NULL AND o.n IS NULL) AS isolated FROM nodes LEFT JOIN i USING (node) LEFT JOIN o USING (node)")
def graph_summary(spark, sf_dir):
    d = graph.degrees(*_edges(spark, sf_dir))
    return d.agg(F.count("*").alias("n_nodes"), F.sum("fan_in").alias("n_edges"), F.max("fan_in").alias("most_in"), F.max("fan_out").alias("most_out"), F.count_if((F.col("fan_in") == 0) & (F.col("fan_out") == 0)).alias("isolated"))


@query("SELECT s_suppkey, s_suppkey % 2 = 0 AS filesystem, s_suppkey % 3 = 0 AS network, false AS subprocess, false AS \"database\" FROM supplier")
def side_effect_flags(spark, sf_dir):
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.array_compact(F.array(F.lit("json"), F.when(k % 2 == 0, "os.path"), F.when(k % 3 == 0, "requests"))).alias("imports"))
    flags = repo.side_effects(F.col("imports"))
    return s.select("s_suppkey", *[flags[c].alias(c) for c in ("filesystem", "network", "subprocess", "database")])


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' ELSE (event_id % 5) || ',' || (event_id % 7) || ',9' END AS ids FROM (SELECT * FROM events WHERE event_id % 5 <> event_id % 7 OR event_id % 4 = 0) UNION ALL SELECT event_id, (event_id % 5) || ',9' FROM events WHERE event_id % 5 = event_id % 7 AND event_id % 4 <> 0")
def parse_ranking(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    answer = F.when(F.col("event_id") % 4 == 0, "none").otherwise(F.format_string("order: [%d, %d, 9] done", F.col("event_id") % 5, F.col("event_id") % 7))
    return e.select("event_id", F.concat_ws(",", text.ranking_ids(answer).cast("array<string>")).alias("ids"))


@query(f"WITH {_HITS} SELECT query_id, string_agg(printf('q%d→d%d=%.2f', rank, doc_id, score), ', ' ORDER BY rank, doc_id) AS why FROM rk WHERE channel = 'click' AND rank <= 3 GROUP BY 1")
def explain_alignments(spark, sf_dir):
    r = fusion.with_ranks(_hits(spark, sf_dir), 3).where("channel = 'click'")
    a = r.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("q"), F.col("doc_id").alias("d"), F.col("score").alias("s")))).alias("a"))
    return a.select("query_id", signals.explained(F.col("a")).alias("why"))


@query(f"WITH {_HITS}, f AS (SELECT query_id, doc_id, list_sort(list(DISTINCT channel)) AS c FROM hits GROUP BY 1, 2) SELECT query_id, doc_id, array_to_string(list_concat(list_transform(c, lambda x: 'channel:' || x), ['symbol:s' || doc_id], CASE WHEN doc_id % 2 = 0 THEN ['ast:f'] ELSE [] END), ',') AS reasons FROM f")
def hit_reasons(spark, sf_dir):
    f = _hits(spark, sf_dir).groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_set("channel")).alias("c"))
    r = signals.reasons(F.col("c"), F.array(F.concat(F.lit("s"), F.col("doc_id"))), F.when(F.col("doc_id") % 2 == 0, "f"))
    return f.select("query_id", "doc_id", F.concat_ws(",", r).alias("reasons"))


@query("SELECT n_nationkey, 1.0::DOUBLE AS bm25, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey ELSE 0.5 END::DOUBLE AS dense FROM nation")
def channel_weight_override(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    override = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("dense"), F.col("n_regionkey").cast("double"))).otherwise(F.create_map().cast("map<string,double>"))
    w = signals.merged_weights(F.create_map(F.lit("bm25"), F.lit(1.0), F.lit("dense"), F.lit(0.5)), override)
    return n.select("n_nationkey", w["bm25"].alias("bm25"), w["dense"].alias("dense"))


@query("SELECT lang, count(*) AS n_modules, sum((length(text) > 500)::INT)::BIGINT AS n_long, md5(string_agg(source || ':' || doc_id, ',' ORDER BY doc_id)) AS digest FROM documents GROUP BY 1")
def repo_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    each = F.array_sort(F.collect_list(F.struct("doc_id", F.concat_ws(":", "source", "doc_id").alias("s")))).getField("s")
    return d.groupBy("lang").agg(F.count("*").alias("n_modules"), F.count_if(F.length("text") > 500).alias("n_long"), F.md5(F.concat_ws(",", each)).alias("digest"))
