"""Queries of readers, writers, versions, filters and scalar functions, most of them as round trips through files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.operators import catalog, chunking, fusion, gating, repo, vector
from siltstone.plans.channels import Registry as Channels
from siltstone.plans.registry import query
from siltstone.plans.retrieval import _KNN, _vectors
from siltstone.sources import scripts, tables, writers
from siltstone.sources.registry import Registry
from siltstone.sources.tables import table
from siltstone.streaming import incremental


def _folder(spark) -> str:
    """A new name in the shared folder of checkpoints."""
    return f"{tables.checkpoint_root(spark)}/round-trip-{uuid.uuid4().hex}"


@query("SELECT doc_id, lang, NULL::VARCHAR AS note FROM documents")
def typed_fallback_union(spark, sf_dir):
    """A table that isn't there reads as a typed empty one, and unites by name with another."""
    missing = tables.scan_parquet(spark, f"{sf_dir}/no_such_table.parquet", schema="doc_id long, note string")
    return tables.union_by_name([table(spark, sf_dir, "documents").select("doc_id", "lang"), missing])


@query("SELECT quality, count(*) AS n, FALSE AS other FROM labels GROUP BY 1")
def optional_views(spark, sf_dir):
    """A view over a table that is there, and none over one that isn't."""
    tables.optional_view(spark, "siltstone_labels", f"{sf_dir}/labels.parquet")
    other = tables.optional_view(spark, "siltstone_nothing", f"{sf_dir}/no_such_table.parquet")
    return spark.sql("SELECT quality, count(*) AS n FROM siltstone_labels GROUP BY quality").withColumn("other", F.lit(other))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey IN (1, 3)")
def roots_of_runs(spark, sf_dir):
    """One scan over the roots that a metadata table names."""
    root = _folder(spark)
    nation = table(spark, sf_dir, "nation")
    for r in (1, 2, 3):
        nation.where(F.col("n_regionkey") == r).write.parquet(f"{root}/run{r}/parquet")
    runs = spark.createDataFrame([(f"{root}/run1",), (f"{root}/run3",)], "parquet_root string")
    return tables.read_roots(spark, runs, suffix="/parquet")


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1, 2")
def partitioned_rewrite(spark, sf_dir):
    """Written by partition, one partition written again; the others stay."""
    path = _folder(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    writers.write_partitioned(docs, path, ["lang"])
    writers.write_partitioned(docs.where("lang = 'en'"), path, ["lang"])
    found = spark.read.schema(docs.schema).parquet(path)
    return found.groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT doc_id, quality, toxic FROM labels")
def jsonl_round_trip(spark, sf_dir):
    """JSON lines, compressed and in files of a fixed number of lines, read back with a schema."""
    path = _folder(spark)
    writers.write_jsonl(table(spark, sf_dir, "labels"), path, files_of=100, gzip=True)
    return tables.read_jsonl(spark, path, "doc_id long, quality int, toxic int", skip_bad=True)


@query("SELECT item_id, text FROM benchmark")
def pretty_json_objects(spark, sf_dir):
    """Objects over several lines, one after another in a file."""
    path = _folder(spark)
    body = F.to_json(F.struct("item_id", "text"), {"pretty": "true"})
    table(spark, sf_dir, "benchmark").select(body.alias("value")).write.text(path)
    return tables.json_objects(spark, path, "item_id long, text string")


@query("SELECT r_regionkey, r_name, TRUE AS refused FROM region")
def schema_guard(spark, sf_dir):
    """A table that has the schema passes, another is refused."""
    region = writers.validated(table(spark, sf_dir, "region"), "r_regionkey int, r_name string")
    try:
        writers.validated(region, "r_regionkey long, r_name string")
        refused = False
    except ValueError:
        refused = True
    return region.withColumn("refused", F.lit(refused))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS c_name FROM customer UNION ALL SELECT -1, 'new'")
def versioned_upsert(spark, sf_dir):
    path = _folder(spark)
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    old.write.parquet(path)
    new = old.where("c_custkey % 3 = 0").select("c_custkey", F.lit("new").alias("c_name"))
    new = new.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("c_custkey"), F.lit("new").alias("c_name")))
    return spark.read.parquet(writers.upsert(spark, path, new, ["c_custkey"]))


@query("SELECT count(*) AS n, TRUE AS first, FALSE AS again, TRUE AS changed FROM nation WHERE n_nationkey < 20")
def refresh_on_change(spark, sf_dir):
    """Written at first and when the checksum changes, not when it's the same."""
    path = _folder(spark)
    nation = table(spark, sf_dir, "nation")
    some = nation.where("n_nationkey < 20")
    sums = [writers.content_checksum(d, "n_nationkey", "n_name").first().checksum for d in (nation, some)]
    first, again, changed = (writers.refresh_if_changed(spark, d, path, c) for d, c in ((nation, sums[0]), (nation, sums[0]), (some, sums[1])))
    return writers.refreshed(spark, path).agg(F.count("*").alias("n")).select("n", F.lit(first).alias("first"), F.lit(again).alias("again"), F.lit(changed).alias("changed"))


@query("SELECT n_nationkey, 'one' AS version FROM nation WHERE n_regionkey = 1")
def version_rollback(spark, sf_dir):
    versions = writers.Versions(spark, _folder(spark))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    for name, region in (("one", 1), ("two", 2)):
        versions.publish(nation.where(F.col("n_regionkey") == region), name, region=region)
    name = versions.rollback()
    return versions.read().select("n_nationkey", F.lit(name).alias("version"))


@query("SELECT lang AS key, CASE WHEN count(*) > 0.2 * (SELECT count(*) FROM documents) THEN 'committed' ELSE 'rolled_back' END AS state, 'lang=' || lang AS root, 2 AS seq, count(*)::VARCHAR AS detail FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def run_registry(spark, sf_dir):
    """Partitions of a table, each begun, written, and committed if it holds a fifth of the rows, else rolled back."""
    path = _folder(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    log = Registry(spark, f"{path}/registry")
    counts = {r.lang: r["count"] for r in docs.where("lang is not null").groupBy("lang").count().collect()}
    for lang in counts:
        log.record("dataset", lang, "begun", f"lang={lang}")
    writers.write_partitioned(docs.where("lang is not null"), f"{path}/rows", ["lang"])
    total = docs.count()
    for lang, n in counts.items():
        log.record("dataset", lang, "committed" if n > 0.2 * total else "rolled_back", detail=str(n))
    return log.state().select("key", "state", "root", F.col("seq").cast("int").alias("seq"), "detail")


@query("SELECT 'src' || p_size AS path, count(*) AS n_lines, count(*) FILTER (p_partkey % 3 > 0) AS n_hit, (count(*) FILTER (p_partkey % 3 > 0)) / count(*) AS covered FROM part GROUP BY 1")
def coverage_report(spark, sf_dir):
    """Covered lines by file of XML coverage reports, one report a file."""
    path = _folder(spark)
    part = table(spark, sf_dir, "part").withColumn("file", F.concat(F.lit("src"), "p_size"))
    files = part.select("file").distinct()
    head = files.select("file", F.lit(-1).cast("long").alias("at"), F.format_string('<coverage><class filename="%s"><lines>', "file").alias("value"))
    body = part.select("file", F.col("p_partkey").alias("at"), F.format_string('<line number="%d" hits="%d"/>', "p_partkey", F.col("p_partkey") % 3).alias("value"))
    foot = files.select("file", F.lit((1 << 63) - 1).alias("at"), F.lit("</lines></class></coverage>").alias("value"))
    rows = head.unionAll(body).unionAll(foot).repartition("file").sortWithinPartitions("file", "at")
    rows.select("file", "value").write.partitionBy("file").text(path)
    return tables.read_cobertura(spark, f"{path}/*").select("path", "n_lines", "n_hit", "covered")


@query("SELECT 'src' || (user_id % 10) AS path, count(*) AS type_errors FROM events WHERE event_type = 'click' GROUP BY 1")
def type_error_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    found = e.select(F.concat(F.lit("src"), F.col("user_id") % 10).alias("file"), F.when(F.col("event_type") == "click", "Error").otherwise("warning").alias("severity"))
    return tables.type_errors(found)


@query("SELECT n_nationkey::VARCHAR AS qid, n_name AS doc, n_regionkey AS rel FROM (SELECT n_nationkey, replace(n_name, ' ', '_') AS n_name, n_regionkey FROM nation)")
def judgement_file(spark, sf_dir):
    path = _folder(spark)
    table(spark, sf_dir, "nation").select(F.format_string("%d 0  %s\t%d", "n_nationkey", F.replace("n_name", F.lit(" "), F.lit("_")), "n_regionkey").alias("value")).write.text(path)
    return tables.read_qrels(spark, path)


@query("SELECT lang, count(DISTINCT source) AS files FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1")
def listed_files(spark, sf_dir):
    """Files below folders, by name only: one a source."""
    path = _folder(spark)
    docs = table(spark, sf_dir, "documents").where("lang IS NOT NULL AND source IS NOT NULL").select("lang", "source").distinct()
    docs.withColumn("value", F.lit("x")).write.partitionBy("lang", "source").text(path)
    return tables.list_files(spark, path).where("path LIKE '%.txt'").select(F.regexp_extract("path", "lang=([^/]+)/", 1).alias("lang"), F.regexp_extract("path", "source=([^/]+)/", 1).alias("source")).groupBy("lang").agg(F.count_distinct("source").alias("files"))


@query(
    """SELECT doc_id FROM (SELECT doc_id, source || '/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.md' END AS uri, [lang, 'all'] AS symbols FROM documents)
WHERE doc_id IN (SELECT DISTINCT doc_id FROM labels WHERE doc_id < 60) AND uri LIKE 'src%' AND NOT uri LIKE 'src1/%' AND uri LIKE '%.py' AND list_has_any(symbols, ['en', 'de'])"""
)
def dynamic_filter(spark, sf_dir):
    """Ids, globs, languages by extension and symbols, all at once."""
    end = F.when(F.col("doc_id") % 2 == 0, ".py").otherwise(".md")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), "doc_id", end).alias("uri"), F.array("lang", F.lit("all")).alias("symbols"))
    few = [r.doc_id for r in table(spark, sf_dir, "labels").where("doc_id < 60").select("doc_id").distinct().collect()]
    return catalog.filtered(rows, ids=few, include=["src*"], exclude=["src1/*"], languages=["python"], symbols=["en", "de"], id_col="doc_id").select("doc_id")


@query("SELECT n_nationkey AS path, (n_regionkey = 2) OR (n_nationkey >= 10) AS hub FROM nation")
def reexport_hubs(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("path"), repo.reexport_hub(F.col("n_regionkey") == 2, F.col("n_nationkey")).alias("hub"))


@query(
    """SELECT l_orderkey, l_linenumber, x.exported FROM lineitem JOIN (SELECT o_orderkey, 'k' || (o_custkey % 9) AS exported FROM orders) x ON l_orderkey = x.o_orderkey
WHERE 'k' || (l_partkey % 9) = x.exported OR starts_with('k' || (l_partkey % 9) || '.' || l_suppkey, x.exported) OR starts_with('k' || (l_suppkey % 9) || '.' || l_suppkey, x.exported)"""
)
def exported_nodes(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    nodes = line.select(F.col("l_orderkey").alias("path"), "l_orderkey", "l_linenumber", F.concat(F.lit("k"), F.col("l_partkey") % 9).alias("name"), F.concat(F.lit("k"), F.col("l_suppkey") % 9, F.lit("."), "l_suppkey").alias("qualname"))
    exports = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.concat(F.lit("k"), F.col("o_custkey") % 9).alias("exported"))
    return catalog.exported(nodes, exports).select("l_orderkey", "l_linenumber", "exported")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def keep_first_hits(spark, sf_dir):
    return fusion.keep_first(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query(
    """WITH c AS (SELECT l_orderkey AS chunk_id, p_brand AS name, min(l_linenumber) AS pos FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
d AS (SELECT p_brand AS name, min(p_name) AS signature FROM part GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY pos, name) AS r FROM c JOIN d USING (name))
SELECT chunk_id, string_agg(signature, chr(10) ORDER BY r) AS context FROM r WHERE r <= 3 GROUP BY 1"""
)
def related_definitions(spark, sf_dir):
    """The first definitions that a chunk calls, as text."""
    part = table(spark, sf_dir, "part")
    calls = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("chunk_id"), F.col("p_brand").alias("name"), F.col("l_linenumber").alias("pos"))
    defs = part.groupBy(F.col("p_brand").alias("name")).agg(F.min("p_name").alias("signature"))
    return chunking.related(calls, defs, 3)


@query(
    """WITH a AS (SELECT o_custkey AS query_id, o_orderkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
b AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS position, rank FROM a)
SELECT query_id, count(*) FILTER (rank <> position) AS n_moved FROM b GROUP BY 1"""
)
def rank_changes(spark, sf_dir):
    """How many hits a second ranking moves."""
    hits = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.lit("price").alias("channel"), F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("score"))
    price = fusion.with_ranks(hits).select("query_id", "doc_id", "rank")
    age = fusion.with_ranks(hits.withColumn("score", -F.col("doc_id"))).select("query_id", "doc_id", "rank")
    return fusion.moved(fusion.reordered(price, age))


@query("SELECT o_orderkey, 'C' || o_custkey AS name FROM orders")
def symbol_names(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    symbol = F.concat(F.lit("scip python pkg 0.1 `a.b`/C"), "o_custkey", F.when(F.col("o_orderkey") % 2 == 0, "#").otherwise("()."))
    return o.select("o_orderkey", text.symbol_name(symbol).alias("name"))


@query("SELECT event_id, coalesce(try_cast(v AS BIGINT), 0) AS n FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN NULL ELSE event_id::VARCHAR END AS v FROM events)")
def lossy_numbers(spark, sf_dir):
    k = F.col("event_id") % 4
    v = F.when(k == 0, F.col("event_type")).when(k == 1, None).otherwise(F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", text.as_int(v).alias("n"))


@query("SELECT conv_id, list_sort(list_distinct(list(role))) AS roles FROM conversations GROUP BY 1")
def distinct_tags(spark, sf_dir):
    """Each list once, sorted; a missing one is empty."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey % 2 = 0 THEN 'Where is ' || n_name || ' defined?' ELSE 'What uses ' || n_name || '?' END AS question FROM nation")
def synthetic_questions(spark, sf_dir):
    q = F.when(F.col("n_regionkey") % 2 == 0, F.concat(F.lit("Where is "), "n_name", F.lit(" defined?"))).otherwise(F.concat(F.lit("What uses "), "n_name", F.lit("?")))
    return table(spark, sf_dir, "nation").select("n_nationkey", q.alias("question"))


@query("SELECT item_id, (ceil(greatest(1, least(length(text), 200)) * CASE WHEN item_id % 2 = 0 THEN 2.0 ELSE 1.0 END) + 5)::BIGINT AS asked FROM benchmark")
def fan_out_limits(spark, sf_dir):
    """How many candidates each question asks for, if it wants as many hits as it has characters and every other is filtered."""
    return table(spark, sf_dir, "benchmark").select("item_id", gating.fan_out(F.length("text"), F.col("item_id") % 2 == 0, bonus=5).alias("asked"))


@query(
    """WITH n AS (SELECT count(*) AS n FROM embeddings)
SELECT n, CASE WHEN n < 5000 THEN 'flat' WHEN n < 50000 THEN 'ivf_flat' ELSE 'ivf_pq' END AS family, n * (4 * 64 + 8) + CASE WHEN n < 5000 THEN 0 WHEN n < 50000 THEN greatest(floor(sqrt(n)), 100) ELSE greatest(floor(sqrt(n)), 1024) END::BIGINT * 64 * 4 AS bytes FROM n"""
)
def index_plan(spark, sf_dir):
    """The family and the size of an index over all vectors."""
    n = table(spark, sf_dir, "embeddings").count()
    family, lists = vector.index_family(n)
    return spark.createDataFrame([(n, family, vector.memory_estimate(n, 64, lists))], "n long, family string, bytes long")


@query(
    f"""WITH {_KNN}, c AS (SELECT query_id, doc_id FROM nn WHERE rank <= 30),
s AS (SELECT query_id, doc_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM c JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = doc_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5"""
)
def narrow_rescore(spark, sf_dir):
    """Given candidates scored again by their own vectors, no other rows read."""
    v, q = _vectors(spark, sf_dir)
    return vector.reranked(vector.exact_neighbours(v, q, 30), v, q, 5, "ip")


@query("SELECT doc_id, vec_id IS NOT NULL AS found, embedding[1] AS first FROM labels LEFT JOIN embeddings ON doc_id = vec_id")
def vectors_by_id(spark, sf_dir):
    """Stored vectors of given ids; a missing one is null."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding"))
    return table(spark, sf_dir, "labels").select("doc_id").join(e.withColumn("found", F.lit(True)), "doc_id", "left").select("doc_id", F.coalesce("found", F.lit(False)).alias("found"), F.get("embedding", F.lit(0)).alias("first"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 50")
def first_by_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").orderBy("doc_id").limit(50).select("doc_id", "n_chars")


@query(
    """WITH p AS (SELECT DISTINCT user_id FROM events WHERE user_id % 3 = 0), b AS (SELECT user_id, min(event_id) AS event_id FROM events WHERE user_id % 3 > 0 GROUP BY 1)
SELECT user_id, event_id, (SELECT count(*) FROM b) / greatest((SELECT count(*) FROM p), 1) > 0.05 AS due FROM b"""
)
def incremental_additions(spark, sf_dir):
    """New keys of a batch beside a primary table, and whether both are to be made one."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    primary = e.where("user_id % 3 = 0").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    out = incremental.add(primary, e.where("false"), e, "user_id")
    due = incremental.compact_due(primary.count(), out.count())
    return out.withColumn("due", F.lit(due))


@query("SELECT n_regionkey, count(*) AS n FROM nation WHERE n_regionkey > 1 GROUP BY 1")
def script_statements(spark, sf_dir):
    """A script of several statements with a parameter; a semicolon in quotes ends none."""
    table(spark, sf_dir, "nation").createOrReplaceTempView("siltstone_nation")
    script = "SELECT 'a;b' AS s; -- one; comment\nSELECT n_regionkey, count(*) AS n FROM siltstone_nation WHERE n_regionkey > :least GROUP BY n_regionkey;"
    return scripts.run_script(spark, script, least=1)[-1]


@query(
    """SELECT query_id, channel, doc_id, rank FROM (SELECT o_custkey AS query_id, 'price' AS channel, o_orderkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 2
UNION ALL SELECT * FROM (SELECT o_custkey, 'recent', o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rank FROM orders) WHERE rank <= 3"""
)
def channel_registry(spark, sf_dir):
    """Hits of the channels whose sources are there, each as deep as it may go."""
    channels = Channels()
    for name, score, needs in (("price", F.col("o_totalprice"), ("orders",)), ("recent", F.col("o_orderkey"), ("orders",)), ("other", F.lit(0), ("nothing",))):
        channels.add(name, lambda _, s, score=score: s["orders"].select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), score.alias("score")), needs)
    orders = table(spark, sf_dir, "orders")
    hits, _ = channels.gather(orders.select("o_custkey"), {"orders": orders}, {"price": 2, "recent": 3, "other": 1})
    return hits.select("query_id", "channel", "doc_id", "rank")


@query("SELECT s_suppkey, s_nationkey FROM supplier UNION ALL SELECT s_suppkey + 1000000, s_nationkey FROM supplier WHERE s_nationkey < 5")
def bulk_append(spark, sf_dir):
    """Rows appended to a table that is there."""
    path = _folder(spark)
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows.write.parquet(path)
    rows.where("s_nationkey < 5").withColumn("s_suppkey", F.col("s_suppkey") + 1000000).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings")
def id_map_export(spark, sf_dir):
    """The place of each vector in an index, as a file."""
    path = _folder(spark)
    writers.with_sequence(table(spark, sf_dir, "embeddings").select("vec_id"), ["vec_id"], 0, "place").write.parquet(path)
    return spark.read.parquet(path)


@query("SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem")
def edge_export(spark, sf_dir):
    """The edges of a graph, each once, written and read."""
    path = _folder(spark)
    table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct().write.parquet(path)
    return spark.read.parquet(path)


@query(r"""SELECT n_nationkey AS path, '# ' || n_nationkey || chr(10) || '- tags: r' || n_regionkey || chr(10) || '- hotspot: ' || n_regionkey || chr(10) || chr(10) || n_name AS markdown FROM nation""")
def module_reports(spark, sf_dir):
    m = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("path"), F.array(F.concat(F.lit("r"), "n_regionkey")).alias("tags"), F.col("n_regionkey").alias("hotspot"), F.col("n_name").alias("docstring"))
    return writers.module_report(m)
