"""Queries of reports, frames and filtered search."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from siltstone.operators import lexical
from siltstone.plans.registry import query
from siltstone.plans.retrieval import _BM25, _TOK, _W, _tables
from siltstone.sources.tables import table


@query("SELECT lang, source, GROUPING(lang, source)::INT AS level, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def rollup_lang_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.rollup("lang", "source").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.sum("n_chars").cast("long").alias("chars"))


@query("SELECT o_orderstatus, o_orderpriority, GROUPING(o_orderstatus, o_orderpriority)::INT AS level, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_status_priority(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT event_type, user_id % 10 AS bucket, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 10), ())")
def event_grouping_sets(spark, sf_dir):
    table(spark, sf_dir, "events").selectExpr("event_type", "user_id % 10 AS bucket").createOrReplaceTempView("siltstone_event_buckets")
    return spark.sql("SELECT event_type, bucket, count(*) AS n FROM siltstone_event_buckets GROUP BY GROUPING SETS ((event_type), (bucket), ())")


@query(
    """SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice, 2) OVER w AS after, ntile(4) OVER w AS quarter,
first_value(o_orderkey) OVER w AS first_key, round(sum(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS last_three,
dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS urgency FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"""
)
def order_frames(spark, sf_dir):
    own = Window.partitionBy("o_custkey")
    w = own.orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.lag("o_totalprice").over(w).alias("before"),
        F.lead("o_totalprice", 2).over(w).alias("after"),
        F.ntile(4).over(w).cast("long").alias("quarter"),
        F.first("o_orderkey").over(w).alias("first_key"),
        F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 4).alias("last_three"),
        F.dense_rank().over(own.orderBy("o_orderpriority")).cast("long").alias("urgency"),
    )


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS near_before FROM events")
def event_range_frame(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id").rangeBetween(-500, Window.currentRow)
    return table(spark, sf_dir, "events").select("event_id", F.count("*").over(w).alias("near_before"))


@query("SELECT event_type AS kind, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def kind_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT doc_id, lang IN ('en', 'de') AND lower(text) LIKE '%version%' AS wanted FROM documents")
def lang_text_filter(spark, sf_dir):
    """A language predicate by column and a case-insensitive text predicate, as one mask."""
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("lang").isin("en", "de") & F.lower("text").contains("version")).alias("wanted"))


_KEPT = "(SELECT * FROM documents WHERE lang IN ('en', 'de') AND source <> 'src0')"


@query(
    "WITH " + _TOK.format(p=_W).replace("FROM documents", f"FROM {_KEPT}") + f""", s AS (SELECT query_id, doc_id, round(sum({_BM25} * qn), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term) JOIN len USING (doc_id), st GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT query_id, rank, r.doc_id, score, lang, source, n_chars FROM r JOIN documents d USING (doc_id) WHERE rank <= 10"""
)
def filtered_search(spark, sf_dir):
    """Search within a language and source filter, that reaches the scan, and the found rows with their columns."""
    docs, items = _tables(spark, sf_dir)
    kept = docs.where(F.col("lang").isin("en", "de") & (F.col("source") != "src0"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return lexical.bm25(kept, items, 10).join(rows, "doc_id").select("query_id", "rank", "doc_id", "score", "lang", "source", "n_chars")


@query(
    "WITH " + _TOK.format(p=_W) + f""", s AS (SELECT query_id, doc_id, round(sum({_BM25} * qn), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term) JOIN len USING (doc_id), st GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0),
b AS (SELECT query_id, doc_id, round(score * CASE WHEN lang = 'en' THEN 1.2 ELSE 1.0 END, 6) AS score, list_filter([CASE WHEN rank <= 5 THEN 'lexical' END, CASE WHEN lang = 'en' THEN 'language' END], lambda x: x IS NOT NULL) AS signals FROM r JOIN documents USING (doc_id) WHERE rank <= 50)
SELECT query_id, doc_id, score, array_to_string(signals, ',') AS signals, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM b) WHERE rank <= 10"""
)
def boosted_search(spark, sf_dir):
    """Search, then a boost by language and the signals that speak for a hit, ranked again."""
    docs, items = _tables(spark, sf_dir)
    rows = lexical.bm25(docs, items, 50).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    signals = F.concat_ws(",", F.when(F.col("rank") <= 5, "lexical"), F.when(F.col("lang") == "en", "language"))
    score = F.round(F.col("score") * F.when(F.col("lang") == "en", 1.2).otherwise(1.0), 6)
    boosted = rows.select("query_id", "doc_id", score.alias("score"), signals.alias("signals"))
    return lexical.top_k(boosted, 10).select("query_id", "doc_id", "score", "signals", "rank")
