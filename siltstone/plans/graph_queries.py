"""Queries of graph, repository, evaluation and incremental operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siltstone.functions import globs, text
from siltstone.operators import evaluation, graph, history, repo, vector
from siltstone.plans.registry import query
from siltstone.sources import tables, writers
from siltstone.sources.tables import checkpoint_root, table
from siltstone.streaming import incremental

_DEFS = "defs AS (SELECT p_name AS symbol, arg_min('f' || p_size, (p_partkey, 'f' || p_size)) AS def_path FROM part GROUP BY 1), refs AS (SELECT p_name AS symbol, 'f' || (l_suppkey % 50 + 1) AS path FROM lineitem JOIN part ON l_partkey = p_partkey), uses AS (SELECT def_path, path AS use_path, symbol, count(*) AS uses FROM refs JOIN defs USING (symbol) WHERE path <> def_path GROUP BY 1, 2, 3)"


def _uses(spark, sf_dir):
    p, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    file = lambda c: F.concat(F.lit("f"), c.cast("string"))
    defs = p.select(F.col("p_name").alias("symbol"), file(F.col("p_size")).alias("path"), F.col("p_partkey").alias("doc_order"))
    refs = li.join(p, li.l_partkey == p.p_partkey).select(F.col("p_name").alias("symbol"), file(F.col("l_suppkey") % 50 + 1).alias("path"))
    return graph.use_edges(defs, refs)


@query(f"WITH {_DEFS} SELECT * FROM uses")
def def_use_edges(spark, sf_dir):
    return _uses(spark, sf_dir)


@query(f"WITH {_DEFS} SELECT def_path, count(DISTINCT use_path) AS used_by_files, sum(uses)::BIGINT AS used_by_symbols FROM uses GROUP BY 1")
def usage_counts(spark, sf_dir):
    return graph.usage(_uses(spark, sf_dir))


_EDGES = "edges AS (SELECT DISTINCT o_custkey AS src, (o_orderkey * 7) % 997 + 1 AS dst FROM orders), nodes AS (SELECT c_custkey AS node FROM customer UNION SELECT src FROM edges UNION SELECT dst FROM edges)"


def _edges(spark, sf_dir):
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("src"), (F.col("o_orderkey") * 7 % 997 + 1).cast("long").alias("dst")).distinct()
    n = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("node")).unionAll(e.select("src")).unionAll(e.select("dst")).distinct()
    return e, n


@query(f"WITH {_EDGES} SELECT node, coalesce(i.n, 0)::BIGINT AS fan_in, coalesce(o.n, 0)::BIGINT AS fan_out FROM nodes LEFT JOIN (SELECT dst AS node, count(*) AS n FROM edges GROUP BY 1) i USING (node) LEFT JOIN (SELECT src AS node, count(*) AS n FROM edges GROUP BY 1) o USING (node)")
def fan_in_out(spark, sf_dir):
    return graph.degrees(*_edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {_EDGES}, n AS (SELECT count(*)::DOUBLE AS n FROM nodes), sh AS (SELECT src, dst, 1.0 / count(*) OVER (PARTITION BY src) AS share FROM edges),
pr AS (SELECT 0 AS i, node, 1.0 / n AS rank FROM nodes, n
UNION ALL SELECT i + 1, x.node, any_value(0.15 / n) + 0.85 * sum(x.got) FROM (SELECT pr.i, sh.dst AS node, pr.rank * sh.share AS got FROM pr JOIN sh ON pr.node = sh.src WHERE pr.i < 25 UNION ALL SELECT pr.i, pr.node, 0 FROM pr WHERE pr.i < 25) x, n GROUP BY x.i, x.node)
SELECT node, round(rank, 9) AS rank FROM pr WHERE i = 25""")
def pagerank_25(spark, sf_dir):
    return graph.pagerank(*_edges(spark, sf_dir)).withColumn("rank", F.round("rank", 9))


_SMALL = "edges AS (SELECT DISTINCT n_nationkey::BIGINT AS src, ((n_nationkey * 3 + n_regionkey) % 25)::BIGINT AS dst FROM nation UNION SELECT n_nationkey, (n_nationkey + 5) % 25 FROM nation WHERE n_nationkey % 4 = 0)"


def _small(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("long")
    e = n.select(k.alias("src"), ((k * 3 + F.col("n_regionkey")) % 25).alias("dst")).unionAll(n.where("n_nationkey % 4 = 0").select(k.alias("src"), ((k + 5) % 25).alias("dst"))).distinct()
    return e, n.select(k.alias("node"))


@query(f"""WITH RECURSIVE {_SMALL}, nodes AS (SELECT n_nationkey::BIGINT AS node FROM nation), r AS (SELECT node AS a, node AS b FROM nodes UNION SELECT r.a, e.dst FROM r JOIN edges e ON r.b = e.src)
SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1""")
def scc_components(spark, sf_dir):
    return graph.strong_components(*_small(spark, sf_dir))


@query(f"""WITH RECURSIVE {_SMALL}, nodes AS (SELECT n_nationkey::BIGINT AS node FROM nation), r AS (SELECT node AS a, node AS b FROM nodes UNION SELECT r.a, e.dst FROM r JOIN edges e ON r.b = e.src),
c AS (SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1)
SELECT component, count(*) AS size FROM c GROUP BY 1 HAVING count(*) > 1 OR component IN (SELECT src FROM edges WHERE src = dst)""")
def import_cycles(spark, sf_dir):
    e, n = _small(spark, sf_dir)
    return graph.cycles(graph.strong_components(e, n), e)


@query("WITH t AS (SELECT o_orderkey AS path, unnest([o_orderstatus, o_orderpriority]) AS tag FROM orders) SELECT tag, path, count(*) OVER (PARTITION BY tag) AS n FROM t")
def tag_inverted_index(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.array("o_orderstatus", "o_orderpriority").alias("tags"))
    return repo.tag_index(o)


_MODULES = "m AS (SELECT s_suppkey, 'pkg.m' || (s_suppkey % 10) || CASE WHEN s_suppkey % 3 = 0 THEN '.sub' || s_suppkey ELSE '' END AS module, 'p' || s_suppkey AS path FROM supplier), i AS (SELECT DISTINCT 'p' || l_suppkey AS path, 'pkg.m' || (l_partkey % 10) || '.sub' || (l_partkey % 120) || '.name' AS target FROM lineitem)"


def _modules(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    m = s.select(F.concat(F.lit("pkg.m"), k % 10, F.when(k % 3 == 0, F.concat(F.lit(".sub"), k)).otherwise("")).alias("module"), F.concat(F.lit("p"), k).alias("path"))
    p = F.col("l_partkey")
    i = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_suppkey")).alias("path"), F.concat(F.lit("pkg.m"), p % 10, F.lit(".sub"), p % 120, F.lit(".name")).alias("target")).distinct()
    return m, i


@query(f"WITH {_MODULES} SELECT DISTINCT src_path, dst_path FROM (SELECT i.path AS src_path, target, max_by(m.path, (length(m.module), m.path)) AS dst_path FROM i JOIN m ON (i.target = m.module OR starts_with(i.target, m.module || '.')) AND i.path <> m.path GROUP BY 1, 2)")
def import_resolution(spark, sf_dir):
    m, i = _modules(spark, sf_dir)
    return graph.resolve_imports(i, m)


@query(f"WITH {_MODULES} SELECT DISTINCT i.path, m.module FROM i JOIN m ON i.target = m.module OR starts_with(i.target, m.module || '.') OR starts_with(m.module, i.target || '.')")
def related_test_modules(spark, sf_dir):
    m, i = _modules(spark, sf_dir)
    return graph.related_tests(i, m)


@query("WITH s AS (SELECT n_name AS module, r_name AS origin, n_nationkey AS pos FROM nation JOIN region ON (n_nationkey + r_regionkey) % 3 = 0), p AS (SELECT r_name AS origin, 'sym' || unnest(range(r_regionkey, r_regionkey + 4)) AS name FROM region), l AS (SELECT n_name AS module, 'sym' || n_regionkey AS name FROM nation) SELECT module, name, min(origin) AS origin FROM s JOIN p USING (origin) WHERE (module, name) NOT IN (SELECT (module, name) FROM l) GROUP BY 1, 2")
def star_reexports(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    stars = n.join(r, (F.col("n_nationkey") + F.col("r_regionkey")) % 3 == 0).select(F.col("n_name").alias("module"), F.col("r_name").alias("origin"), F.col("n_nationkey").alias("pos"))
    public = r.select(F.col("r_name").alias("module"), F.explode(F.sequence("r_regionkey", F.col("r_regionkey") + 3)).alias("k")).select("module", F.concat(F.lit("sym"), "k").alias("name"))
    return graph.star_exports(stars, public, n.select(F.col("n_name").alias("module"), F.concat(F.lit("sym"), "n_regionkey").alias("name")))


@query("WITH f AS (SELECT DISTINCT regexp_extract(url, '://[^/]*/([^?#]*)', 1) AS path FROM pages), c AS (SELECT DISTINCT r_name || '.yaml' AS path, '' AS folder FROM region UNION ALL SELECT unnest(['en/conf.toml', 'fr/conf.toml']), unnest(['en', 'fr'])), m AS (SELECT path, list_filter(string_split(regexp_replace(path, '/?[^/]*$', ''), '/'), lambda x: x <> '') AS parts FROM f) SELECT m.path, c.path AS config, (len(parts) - CASE WHEN folder = '' THEN 0 ELSE 1 END)::INT AS distance FROM m JOIN c ON folder = '' OR (len(parts) >= 1 AND parts[1] = folder)")
def config_references(spark, sf_dir):
    f = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://[^/]*/([^?#]*)", 1).alias("path")).distinct()
    more = spark.createDataFrame([("en/conf.toml",), ("fr/conf.toml",)], "path string")
    c = table(spark, sf_dir, "region").select(F.concat("r_name", F.lit(".yaml")).alias("path")).unionAll(more)
    return graph.config_refs(f, c)


_RISK = "x AS (SELECT l_partkey AS id, count(DISTINCT l_suppkey) AS fi, count(DISTINCT l_orderkey) AS fo, max(l_linenumber) AS cyc, count(*) FILTER (l_returnflag = 'R') AS untyped, count(*) FILTER (l_linestatus = 'O') AS errors, count(*) FILTER (l_tax > 0.04) AS churn, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE avg(l_discount) * 10 END AS coverage FROM lineitem GROUP BY 1), h AS (SELECT *, round(least(0.4 * ln(1 + fi + fo) + 0.3 * ln(1 + cyc + untyped) + 0.2 * ln(2 + errors) + 0.3 * ln(2 + churn) + 0.2 * (1 - coalesce(coverage, 0)), 10), 3) AS hotspot FROM x)"


def _risk(spark, sf_dir):
    """A part's risks. Discounts are added as decimals: a sum of doubles depends on the order of its rows, and so would what
    lies at a tag's threshold. A part with a discount that is no such decimal (more places, too large, not finite) has its
    doubles added."""
    li = table(spark, sf_dir, "lineitem")
    exact = F.col("l_discount").try_cast("decimal(18,12)")
    mean = F.when(F.bool_and(exact.cast("double").eqNullSafe(F.col("l_discount"))), F.sum(exact).cast("double") / F.count("l_discount")).otherwise(F.avg("l_discount"))
    x = li.groupBy(F.col("l_partkey").alias("id")).agg(F.count_distinct("l_suppkey").alias("fi"), F.count_distinct("l_orderkey").alias("fo"), F.max("l_linenumber").alias("cyc"), F.count_if(F.col("l_returnflag") == "R").alias("untyped"), F.count_if(F.col("l_linestatus") == "O").alias("errors"), F.count_if(F.col("l_tax") > 0.04).alias("churn"), mean.alias("d"))
    x = x.withColumn("coverage", F.when(F.col("id") % 5 != 0, F.col("d") * 10))
    return x.withColumn("hotspot", repo.hotspot(*[F.col(c) for c in ("fi", "fo", "cyc", "untyped", "errors", "churn", "coverage")]))


@query(f"WITH {_RISK} SELECT id, hotspot FROM h")
def hotspot_score(spark, sf_dir):
    return _risk(spark, sf_dir).select("id", "hotspot")


@query(f"WITH {_RISK} SELECT id, concat_ws(',', CASE WHEN id % 7 = 0 THEN 'cli' END, CASE WHEN id % 4 <> 0 THEN 'docs-missing' END, CASE WHEN hotspot >= 6 THEN 'hotspot' END, CASE WHEN coverage < 0.65 THEN 'low-coverage' END, CASE WHEN errors > 0 THEN 'needs-types' END, CASE WHEN id % 6 = 0 THEN 'public-api' END, CASE WHEN id % 10 = 0 THEN 'reexport-hub' END, CASE WHEN id % 3 = 0 THEN 'tests' END) AS tags FROM h")
def tag_rules(spark, sf_dir):
    m = _risk(spark, sf_dir).select("id", "hotspot", "coverage", F.col("errors").alias("type_errors"), F.when(F.col("id") % 7 == 0, F.array(F.lit("click"))).otherwise(F.array(F.lit("os"))).alias("imports"), F.concat(F.when(F.col("id") % 3 == 0, "tests/").otherwise("src/"), F.col("id")).alias("path"), (F.col("id") % 4 == 0).alias("has_summary"), (F.col("id") % 6 == 0).alias("has_all"), repo.reexport_hub(F.lit(False), F.when(F.col("id") % 10 == 0, 10).otherwise(1)).alias("is_reexport_hub"))
    return m.select("id", F.concat_ws(",", repo.tags()).alias("tags"))


_COMMITS = "c AS (SELECT o_custkey AS path, o_orderpriority AS author, o_orderdate AS ts, o_orderkey AS seq FROM orders)"


def _commits(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderpriority").alias("author"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"))


@query(f"WITH {_COMMITS}, b AS (SELECT path, author, count(*) AS n, count(*) FILTER (ts >= TIMESTAMP '1998-08-01' - INTERVAL 30 DAY) AS c30, count(*) FILTER (ts >= TIMESTAMP '1998-08-01' - INTERVAL 365 DAY) AS c365 FROM c GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, author) AS r FROM b) SELECT path, sum(n)::BIGINT AS n_commits, count(*) AS n_authors, string_agg(author, ',' ORDER BY r) FILTER (r <= 3) AS primary_authors, round(max(n) / sum(n), 9) AS bus_factor, sum(c30)::BIGINT AS churn_30, sum(c365)::BIGINT AS churn_365 FROM r GROUP BY 1")
def ownership_bus_factor(spark, sf_dir):
    out = repo.ownership(_commits(spark, sf_dir), F.lit("1998-08-01").cast("timestamp"), windows=(30, 365))
    return out.withColumn("primary_authors", F.concat_ws(",", "primary_authors")).withColumn("bus_factor", F.round("bus_factor", 9))


@query(f"WITH {_COMMITS}, r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, seq DESC) AS r FROM c), b AS (SELECT path, author, count(*) AS n FROM r WHERE r <= 5 GROUP BY 1, 2) SELECT path, sum(n)::BIGINT AS n_commits, round(max(n) / sum(n), 9) AS bus_factor FROM b GROUP BY 1")
def recent_owners(spark, sf_dir):
    out = repo.ownership(_commits(spark, sf_dir), F.lit("1998-08-01").cast("timestamp"), recent=5)
    return out.select("path", "n_commits", F.round("bus_factor", 9).alias("bus_factor"))


@query(f"WITH {_COMMITS} SELECT path, count(*) AS n_commits, max_by(author, (ts, author)) AS last_author, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM c GROUP BY 1")
def last_touch(spark, sf_dir):
    out = tables.last_touch(_commits(spark, sf_dir), "path", "author", "ts")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return out.select("path", "n_commits", "last_author", us("first_ts").alias("first_us"), us("last_ts").alias("last_us"))


@query("SELECT page_id, CASE WHEN p LIKE '/en/%' THEN '@english' WHEN p LIKE '%.html' THEN '@html' WHEN p LIKE '%' THEN '@rest' END AS owner FROM (SELECT page_id, regexp_extract(url, '://[^/]*([^?#]*)', 1) AS p FROM pages)")
def codeowners(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://[^/]*/([^?#]*)", 1).alias("p"))
    return p.select("page_id", globs.owner_of(F.col("p"), [("en/*", "@english"), ("*.html", "@html"), ("*", "@rest")]).alias("owner"))


_OCC = "o AS (SELECT 's' || (l_partkey % 500) AS symbol, 'u' || l_suppkey AS uri, CASE WHEN l_linenumber = 1 THEN 1 WHEN l_linenumber = 2 THEN 9 ELSE 8 END AS roles FROM lineitem)"


def _occurrences(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("s"), F.col("l_partkey") % 500).alias("symbol"), F.concat(F.lit("u"), F.col("l_suppkey")).alias("uri"), F.when(F.col("l_linenumber") == 1, 1).when(F.col("l_linenumber") == 2, 9).otherwise(8).alias("roles"))


@query(f"WITH {_OCC} SELECT symbol, CASE WHEN roles & 1 = 1 THEN 'def' ELSE 'ref' END AS role, uri, count(*) AS n FROM o GROUP BY 1, 2, 3")
def symbol_cross_reference(spark, sf_dir):
    return repo.cross_reference(_occurrences(spark, sf_dir))


@query(f"WITH {_OCC} SELECT symbol, count(*) AS n FROM o WHERE roles & 1 = 1 GROUP BY 1")
def role_bit_filter(spark, sf_dir):
    return repo.definitions(_occurrences(spark, sf_dir)).groupBy("symbol").agg(F.count("*").alias("n"))


_STITCH = "n AS (SELECT o_orderkey AS node_id, o_custkey % 200 AS path, (o_orderkey % 400)::INT AS line, 'n' || o_orderkey % 90 AS name, 'q' || o_orderkey % 1000 AS qname FROM orders), c AS (SELECT l_orderkey * 10 + l_linenumber AS symbol, l_partkey % 200 AS path, (l_orderkey % 400)::INT AS cl, 'n' || l_suppkey % 90 AS cn, 'q' || l_partkey % 1000 AS cq FROM lineitem)"


@query(f"WITH {_STITCH}, s AS (SELECT node_id, symbol, CASE WHEN qname = cq THEN 1.0 WHEN abs(line - cl) <= 1 AND name = cn THEN 0.8 WHEN name = cn THEN 0.6 ELSE 0.5 END::DOUBLE AS confidence FROM n JOIN c ON n.path = c.path AND (abs(line - cl) <= 1 OR name = cn)) SELECT node_id, symbol, confidence FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY confidence DESC, symbol) AS r FROM s) WHERE r = 1")
def stitch_symbols(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    tag = lambda p, c, m: F.concat(F.lit(p), F.col(c) % m)
    n = o.select(F.col("o_orderkey").alias("node_id"), (F.col("o_custkey") % 200).alias("path"), (F.col("o_orderkey") % 400).cast("int").alias("line"), tag("n", "o_orderkey", 90).alias("name"), tag("q", "o_orderkey", 1000).alias("qname"))
    c = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("symbol"), (F.col("l_partkey") % 200).alias("path"), (F.col("l_orderkey") % 400).cast("int").alias("line"), tag("n", "l_suppkey", 90).alias("name"), tag("q", "l_partkey", 1000).alias("qname"))
    return repo.stitch(n, c)


@query(f"WITH {_STITCH}, s AS (SELECT DISTINCT node_id FROM n JOIN c ON n.path = c.path AND (abs(line - cl) <= 1 OR name = cn)) SELECT node_id, path, (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM s) AS stitched FROM (SELECT node_id, path, row_number() OVER (ORDER BY md5(node_id::VARCHAR), node_id) AS r FROM n JOIN s USING (node_id)) WHERE r <= 20")
def module_artifacts(spark, sf_dir):
    """Nodes written as a file a module, read back; the sample of stitched ones and the index's counts."""
    path = f"{checkpoint_root(spark)}/modules-{uuid.uuid4().hex}"
    nodes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node_id"), (F.col("o_custkey") % 200).alias("path"))
    found = nodes.join(stitch_symbols(spark, sf_dir).select("node_id", "symbol"), "node_id", "left")
    index = writers.write_modules(found, path)
    sample = spark.read.schema("node_id long, path long").json(f"{path}/sample")
    return sample.select("node_id", "path", F.lit(index["nodes"]).cast("long").alias("nodes"), F.lit(index["stitched"]).cast("long").alias("stitched"))


@query()
def line_blame(spark, sf_dir):
    """Turns of a conversation as revisions of one text, word by line; which turn last changed each line of the last."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace("text", r"\s+", "\n").alias("text"))
    return history.blame(turns, path_col="conv_id", rev_col="turn")


@query("SELECT url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '^(?:\\./)?(?:src/)?', ''), '\\.pyi?$', ''), '/__init__$', ''), '/', '.', 'g') AS module FROM (SELECT DISTINCT url, replace(regexp_extract(url, '://([^?#]*)', 1), '.html', '.py') AS p FROM pages)")
def module_names(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("url", F.replace(F.regexp_extract("url", "://([^?#]*)", 1), F.lit(".html"), F.lit(".py")).alias("p")).distinct()
    return p.select("url", text.module_name(F.col("p")).alias("module"))


@query()
def python_module_rows(spark, sf_dir):
    """Module rows of generated sources, one a supplier."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    code = F.concat(F.lit("\"\"\"Module of "), "s_name", F.lit(".\"\"\"\nimport os\nfrom pkg.m"), k % 7, F.lit(" import f\n\n__all__ = ['run']\n\ndef run(x: int, y) -> int:\n    \"\"\"Run.\"\"\"\n    for i in range(x):\n        if i > y:\n            raise ValueError(i)\n    return f(x)\n"), F.when(k % 9 == 0, "def broken(:\n").otherwise(""))
    return repo.modules(s.select(F.concat(F.lit("src/m"), k, F.lit(".py")).alias("path"), code.alias("code")))


@query("SELECT event_type, count(value) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    out = evaluation.latency(table(spark, sf_dir, "events"), "value", "event_type")
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("low", "high", "mean", "p50", "p95", "p99")])


@query("WITH s AS (SELECT user_id AS name, count(*) FILTER (event_type <> 'error') / count(*)::DOUBLE AS recall, avg(value) AS latency FROM events GROUP BY 1), b AS (SELECT * FROM s WHERE recall >= (SELECT max(recall) FROM s) - 0.005) SELECT arg_min(name, (latency, name)) AS name, round(min(latency), 6) AS latency FROM b")
def autotune_select(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("name")).agg((F.count_if(F.col("event_type") != "error") / F.count("*")).alias("recall"), F.avg("value").alias("latency"))
    return evaluation.select_candidate(s).withColumn("latency", F.round("latency", 6))


@query("WITH d AS (SELECT 1 - list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / ((sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) + 1e-9) * (sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) + 1e-9)) AS d FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id + 1) SELECT count(*) AS n, round(max(d), 6) AS max_drift, round(avg(d), 6) AS mean_drift, count(*) FILTER (d > 0.5) AS n_failed FROM d")
def embedding_drift(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    out = evaluation.drift(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")), e.select((F.col("vec_id") + 1).alias("doc_id"), F.col("embedding").alias("v")), vector.cosine, eps=0.5)
    return out.select("n", F.round("max_drift", 6).alias("max_drift"), F.round("mean_drift", 6).alias("mean_drift"), "n_failed")


@query("WITH b AS (SELECT user_id, event_type, event_id FROM events WHERE event_id % 3 <> 0), k AS (SELECT user_id FROM events WHERE event_id % 3 = 0 AND event_type = 'error') SELECT user_id, min((event_type, event_id))[1] AS event_type FROM b WHERE user_id NOT IN (SELECT user_id FROM k) GROUP BY 1")
def incremental_dedup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    known = e.where("event_id % 3 = 0 and event_type = 'error'")
    return incremental.fresh(e.where("event_id % 3 <> 0"), known, key="user_id").select("user_id", "event_type")


@query("WITH p AS (SELECT DISTINCT o_custkey AS k, 'p' AS src FROM orders), s AS (SELECT c_custkey AS k, 's' AS src FROM customer) SELECT * FROM p UNION ALL SELECT * FROM s WHERE k NOT IN (SELECT k FROM p)")
def compacted_index(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct().withColumn("src", F.lit("p"))
    return incremental.compacted(p, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit("s").alias("src")), "k")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_event_counts(spark, sf_dir):
    out = incremental.windowed_counts(table(spark, sf_dir, "events"))
    return out.select(F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, s")
def user_sessions(spark, sf_dir):
    return incremental.sessions(table(spark, sf_dir, "events")).select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "n")


_DIGESTS = "SELECT doc_id, ('0x' || substr(sha256(doc_id || ':' || sha256(text)), 1, 15))::BIGINT::HUGEINT AS h FROM documents WHERE text IS NOT NULL"


@query(f"SELECT count(*) AS n, list_reduce(list(h ORDER BY doc_id, h), lambda acc, x: (acc * {writers.BASE}::HUGEINT + x) % {writers.MODULUS}::HUGEINT)::VARCHAR AS checksum FROM ({_DIGESTS})")
def content_checksum(spark, sf_dir):
    return writers.content_checksum(table(spark, sf_dir, "documents").where("text is not null"), "doc_id", F.sha2("text", 256))


@query("SELECT fault, id FROM (SELECT 'duplicate_id' AS fault, source AS id FROM documents GROUP BY source HAVING count(*) > 1 UNION ALL SELECT 'empty_contents', source FROM documents WHERE trim(coalesce(text, '')) = '')")
def corpus_validation(spark, sf_dir):
    return tables.corpus_faults(table(spark, sf_dir, "documents").select(F.col("source").alias("id"), F.col("text").alias("contents")))


@query("SELECT count(*) FILTER (trim(coalesce(label::VARCHAR, '')) = '') AS blank_keys, count(vec_id) - count(DISTINCT vec_id) AS repeated_keys, count(DISTINCT len(embedding)) AS dimensions, 0::BIGINT AS bad_values FROM embeddings")
def vector_batch_validation(spark, sf_dir):
    return tables.vector_batch_faults(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("key"), F.col("embedding").alias("vector")))


@query("WITH e AS (SELECT DISTINCT n_nationkey AS a, (n_nationkey + 7) % 25 AS b FROM nation), b AS (SELECT a, b FROM e UNION SELECT b, a FROM e) SELECT DISTINCT c_custkey AS doc_id, b AS concept FROM customer JOIN b ON c_nationkey = a")
def linked_concepts(spark, sf_dir):
    e = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") + 7) % 25).alias("b"))
    return graph.linked(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").alias("concept")), e)


@query("SELECT DISTINCT root FROM (SELECT split_part(lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))), '.', 1) AS root FROM benchmark) WHERE root NOT IN (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) FROM documents)")
def external_dependencies(spark, sf_dir):
    roots = lambda name: table(spark, sf_dir, name).select(F.explode(text.tokens(F.col("text"), "[A-Za-z]+")).alias("root"))
    return roots("benchmark").distinct().join(roots("documents").distinct(), "root", "left_anti")
