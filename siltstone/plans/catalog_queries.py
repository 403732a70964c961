"""Queries of catalogue, symbol and text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import globs, text
from siltstone.operators import catalog, chunking, repo
from siltstone.plans.registry import query
from siltstone.sources import tables, writers
from siltstone.sources.tables import table


@query("SELECT o_orderkey AS position, c_custkey AS key, c_name, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
def hydrate_ordered(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("position"))
    return catalog.hydrate(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_name", "c_nationkey"), wanted, "key").select("position", "key", "c_name", "c_nationkey")


@query("SELECT event_id, event_type, e.chunk_id, lang, m.module FROM (SELECT event_id, event_type, event_id % 1300 AS chunk_id FROM events) e LEFT JOIN (SELECT doc_id AS chunk_id, lang, source AS uri FROM documents) d USING (chunk_id) LEFT JOIN (SELECT n_name AS module, 'src' || n_nationkey AS uri FROM nation WHERE n_nationkey < 12) m USING (uri)")
def hydrate_left_coverage(spark, sf_dir):
    pool = table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("event_id") % 1300).alias("chunk_id"))
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "lang", F.col("source").alias("uri"))
    modules = table(spark, sf_dir, "nation").where("n_nationkey < 12").select(F.col("n_name").alias("module"), F.concat(F.lit("src"), F.col("n_nationkey")).alias("uri"))
    return catalog.coverage(pool, chunks, modules).select("event_id", "event_type", "chunk_id", "lang", "module")


@query("SELECT vec_id, label, (text IS NOT NULL) AS has_text FROM embeddings LEFT JOIN documents ON vec_id = doc_id")
def idmap_left_join(spark, sf_dir):
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents").select("doc_id", "text")
    return e.join(d, e.vec_id == d.doc_id, "left").select("vec_id", "label", F.col("text").isNotNull().alias("has_text"))


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join_ids(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(good, "doc_id", "left_semi")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def ids_not_indexed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


_PATH = "regexp_extract(url, '://[^/]*([^?#]*)', 1)"


@query(f"SELECT page_id, {_PATH} AS path FROM pages WHERE ({_PATH} LIKE '/en/%' OR {_PATH} LIKE '%.html') AND NOT ({_PATH} LIKE '/fr/%' OR regexp_matches({_PATH}, '^/[de]*/.*[02468]\\.html$'))")
def glob_include_exclude(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://[^/]*([^?#]*)", 1).alias("path"))
    return p.where(globs.selected(F.col("path"), ["/en/*", "**/*.html"], ["/fr/*", "/[de][de]/*[02468].html"]))


@query(f"SELECT page_id, {_PATH} AS path, lower({_PATH}) LIKE '%.html' OR lower({_PATH}) LIKE '%.htm' AS html, false AS unknown FROM pages")
def lang_extension_filter(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://[^/]*([^?#]*)", 1).alias("path"))
    return p.select("page_id", "path", globs.of_language(F.col("path"), ["html"]).alias("html"), globs.of_language(F.col("path"), ["klingon"]).alias("unknown"))


@query("SELECT p_partkey, p_name, p_type FROM (SELECT *, row_number() OVER (ORDER BY length(p_name), p_type, p_name, p_partkey) AS r FROM part WHERE starts_with(lower(p_name), 'sm')) WHERE r <= 200")
def symbol_prefix_search(spark, sf_dir):
    return repo.prefix_search(table(spark, sf_dir, "part"), "SM", name="p_name", kind="p_type", tie="p_partkey").select("p_partkey", "p_name", "p_type")


_CHUNKS = "chunks AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS uri, ((l_orderkey * 7) % 1000)::INT AS start_line, ((l_orderkey * 7) % 1000 + 20 + l_linenumber * 3)::INT AS end_line FROM lineitem)"
_NODES = "nodes AS (SELECT o_orderkey AS node, o_custkey AS uri, ((o_orderkey * 13) % 1000)::INT AS ns, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE ((o_orderkey * 13) % 1000 + o_orderkey % 60)::INT END AS ne, o_orderstatus AS kind FROM orders)"


def _spans(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    start = (F.col("l_orderkey") * 7 % 1000).cast("int")
    chunks = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("uri"), start.alias("start_line"), (start + 20 + F.col("l_linenumber") * 3).cast("int").alias("end_line"))
    ns = F.col("o_orderkey") * 13 % 1000
    nodes = o.select(F.col("o_orderkey").alias("node"), F.col("o_custkey").alias("uri"), ns.cast("int").alias("ns"), F.when(F.col("o_orderkey") % 11 != 0, (ns + F.col("o_orderkey") % 60).cast("int")).alias("ne"), F.col("o_orderstatus").alias("kind"))
    return chunks, nodes


@query(f"WITH {_CHUNKS}, {_NODES} SELECT id, node FROM chunks c JOIN nodes n ON c.uri = n.uri AND start_line <= coalesce(ne, ns) AND end_line >= ns")
def interval_overlap_join(spark, sf_dir):
    chunks, nodes = _spans(spark, sf_dir)
    return catalog.overlapping(chunks, nodes, "uri", ("start_line", "end_line"), ("ns", "ne"), bucket=64).select("id", "node")


@query(f"WITH {_CHUNKS}, {_NODES} SELECT c.id, array_to_string(coalesce(list_sort(list(DISTINCT kind) FILTER (kind IS NOT NULL)), []), ',') AS kinds, min(kind) AS first_kind FROM chunks c LEFT JOIN nodes n ON c.uri = n.uri AND start_line <= coalesce(ne, ns) AND end_line >= ns GROUP BY 1")
def structure_annotations(spark, sf_dir):
    chunks, nodes = _spans(spark, sf_dir)
    out = catalog.annotations(chunks, nodes.select("uri", "kind", F.col("ns").alias("start_line"), F.col("ne").alias("end_line")))
    return out.select("id", F.concat_ws(",", "kinds").alias("kinds"), "first_kind")


@query(f"WITH {_CHUNKS}, {_NODES} SELECT node, coalesce(min(id), -1) AS id FROM nodes n LEFT JOIN chunks c ON c.uri = n.uri AND ns BETWEEN start_line AND end_line GROUP BY 1")
def point_in_interval_first(spark, sf_dir):
    chunks, nodes = _spans(spark, sf_dir)
    return catalog.containing(nodes.select("node", "uri", "ns"), chunks, "uri", "ns", ("start_line", "end_line"), "node", "id", bucket=64).select("node", "id")


@query(f"WITH {_CHUNKS}, {_NODES} SELECT node, id FROM (SELECT node, id, row_number() OVER (PARTITION BY node ORDER BY end_line - start_line, start_line DESC, id) AS r FROM nodes n JOIN chunks c ON c.uri = n.uri AND ns BETWEEN start_line AND end_line) WHERE r = 1")
def innermost_span(spark, sf_dir):
    chunks, nodes = _spans(spark, sf_dir)
    return catalog.innermost(nodes.select("node", "uri", "ns"), chunks, "uri", "ns", ("start_line", "end_line"), "node", "id", bucket=64).select("node", "id")


@query(f"WITH {_NODES}, d AS (SELECT node, uri, ns AS s, coalesce(ne, ns) AS e FROM nodes) SELECT a.node FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.uri = a.uri AND b.node <> a.node AND b.s <= a.s AND b.e >= a.e AND (b.s < a.s OR b.e > a.e OR b.node < a.node))")
def top_level_definitions(spark, sf_dir):
    _, nodes = _spans(spark, sf_dir)
    return catalog.top_level(nodes.select("node", "uri", F.col("ns").alias("s"), F.coalesce("ne", "ns").alias("e")), "uri", "node", ("s", "e")).select("node")


@query("SELECT doc_id, line_no::BIGINT AS line_no, instr(line, 'the')::BIGINT AS \"column\", substr(line, 1, 200) AS preview FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) WHERE contains(line, 'the')")
def text_search_lines(spark, sf_dir):
    return catalog.search_lines(table(spark, sf_dir, "documents"), "the", id_col="doc_id")


@query("SELECT doc_id, line_no::BIGINT AS line_no, instr(line, regexp_extract(line, '(?i)licen[cs]e|version [0-9]'))::BIGINT AS \"column\", substr(line, 1, 200) AS preview FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) WHERE regexp_matches(line, '(?i)licen[cs]e|version [0-9]')")
def text_search_regex(spark, sf_dir):
    return catalog.search_lines(table(spark, sf_dir, "documents"), "licen[cs]e|version [0-9]", id_col="doc_id", regex=True, case=False)


@query("SELECT doc_id, line_no::BIGINT AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) WHERE line_no BETWEEN 2 AND 4")
def line_range_slice(spark, sf_dir):
    out = tables.file_lines(table(spark, sf_dir, "documents"), 2, 4, "doc_id", "text")
    return out.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query("SELECT chunk_id, CASE WHEN trim(title) = '' THEN lang ELSE title END AS title, trim(title) = '' AS repaired FROM (SELECT event_id % 1300 AS chunk_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS title FROM events) JOIN (SELECT doc_id AS chunk_id, lang FROM documents) USING (chunk_id)")
def repair_results(spark, sf_dir):
    r = table(spark, sf_dir, "events").select((F.col("event_id") % 1300).alias("chunk_id"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")).alias("title"))
    return catalog.repaired(r, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("title")), ["title"])


@query("SELECT doc_id, substr(text, 1, 200) AS content FROM documents")
def fetch_summary(spark, sf_dir):
    return catalog.resolved(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")), "summary")


@query("SELECT o_custkey, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS status, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def upsert_last_wins(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderstatus").alias("status"), "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("seq"))
    return catalog.last_wins(o, ["o_custkey"], "seq").select("o_custkey", "status", "o_orderkey")


@query("SELECT c_custkey AS key, c_name AS name, c_acctbal AS value, NULL::VARCHAR AS note FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT o_custkey, 'updated', round(sum(o_totalprice), 2), 'new' FROM orders GROUP BY 1")
def merge_upsert(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("value"))
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.lit("updated").alias("name"), F.round(F.sum("o_totalprice"), 2).alias("value"), F.lit("new").alias("note"))
    return catalog.latest_rows(old, new, ["key"])


@query("SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS root, max((o_orderdate, o_orderkey)).o_orderkey AS check FROM (SELECT * FROM orders) GROUP BY 1".replace(", max((o_orderdate, o_orderkey)).o_orderkey AS check", ""))
def latest_dataset(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("root"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return tables.latest(o, "root", "at", ["o_custkey"]).select("o_custkey", "root")


@query("SELECT l_partkey, array_to_string(list_sort(list(DISTINCT l_shipmode)), ',') AS modes FROM (SELECT l_partkey, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1")
def array_agg_distinct_sorted(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_partkey", F.concat("l_returnflag", "l_linestatus").alias("mode"))
    return li.groupBy("l_partkey").agg(F.concat_ws(",", F.sort_array(F.collect_set("mode"))).alias("modes"))


@query("SELECT lang, count(DISTINCT term) AS n_terms, count(*) AS n FROM (SELECT lang, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS term FROM documents) GROUP BY 1")
def unnest_count_distinct(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", F.explode(text.tokens(F.col("text"))).alias("term"))
    return d.groupBy("lang").agg(F.count_distinct("term").alias("n_terms"), F.count("*").alias("n"))


@query("SELECT user_id, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def pool_heatmap(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def channel_contribution(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query()
def channel_contribution_approx(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id", 0.02).alias("users"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_props_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT event_id AS id, unnest(json_keys(props)) AS key FROM events")
def json_flatten_keys(spark, sf_dir):
    return tables.json_keys(table(spark, sf_dir, "events"), "event_id", "props")


_DEEP = """'{{"o":{{"a":{{"b":[{{"v":' {c} n_chars {c} '}}],"c":[[["' {c} lang {c} '",{{"d":"' {c} source {c} '"}}]]]}},"e":' {c} {list} {c} '}},"l":[{{"x":' {c} doc_id {c} '}},[]]}}'"""


@query(f"SELECT d.id, substr(fullkey, 3) AS key FROM (SELECT doc_id AS id, {_DEEP.format(c='||', list='to_json(range(n_chars % 4 + 1))::VARCHAR')} AS j FROM documents) d, json_tree(d.j) WHERE fullkey <> '$'")
def json_deep_keys(spark, sf_dir):
    """Keys and elements of objects and arrays that are nested seven deep, as many as the row says."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_DEEP.format(c="||", list="to_json(sequence(0, n_chars % 4))")).alias("j"))
    return tables.json_keys(docs, "doc_id", "j")


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '\\r\\n?', chr(10), 'g'), '[•◦–]', '-', 'g'), '[\\x00-\\x1F]', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM documents")
def canonicalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.canonical(text.composed(F.col("text"))).alias("text"))


@query()
def stable_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    t = F.col("text")
    urn = text.doc_urn(t)
    return d.select("doc_id", urn.alias("urn"), text.chunk_id(F.col("source"), F.lit(0), F.length(t)).alias("chunk_id"), text.content_hash(t).alias("content_hash"), text.path_id(F.col("source")).alias("path_id"), text.node_id(F.col("source"), F.lit(1), F.lit(0), F.col("lang"), F.col("source")).alias("node_id")).withColumn("chunk_urn", text.chunk_urn(F.col("urn"), F.lit(0), F.lit(10)))


@query("SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 + 100 AS id FROM documents")
def sequence_ids(spark, sf_dir):
    return writers.with_sequence(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source", "doc_id"], 100).select("doc_id", "id")


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS preview, substr(trim(text), 1, 400) AS snippet, trim(regexp_extract(text, '^\\s*([^\\n]*)', 1)) AS head FROM documents")
def text_previews(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.preview(t, 80).alias("preview"), text.snippet(t).alias("snippet"), text.doc_summary(t, 1 << 20).alias("head"))


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS n_bytes, length(text)::BIGINT AS n_chars, (len(text) - len(replace(text, chr(10), '')) + 1)::BIGINT AS n_lines FROM documents")
def text_offsets(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length(t).cast("long").alias("n_bytes"), F.length(t).cast("long").alias("n_chars"), F.size(F.split(t, "\n")).cast("long").alias("n_lines"))


@query("SELECT p_partkey, floor(p_retailprice * 100 + 0.5)::BIGINT AS d, least(round_even(p_retailprice / 100, 0), 12)::BIGINT AS q FROM part")
def sparse_quantise(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", text.quantised_document(F.col("p_retailprice")).alias("d"), text.quantised_query(F.col("p_retailprice") / 100, 1, 12).alias("q"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY 1")
def ordered_turns(spark, sf_dir):
    return chunking.turns_text(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query(
    """WITH RECURSIVE r AS (SELECT conv_id, turn, coalesce(length(text), 0)::BIGINT AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(length(text), 0)) AS k FROM conversations),
g AS (SELECT conv_id, turn, k, n AS used, 0::BIGINT AS chunk FROM r WHERE k = 1
UNION ALL SELECT r.conv_id, r.turn, r.k, CASE WHEN used = 0 OR used + n <= 600 THEN used + n ELSE n END, CASE WHEN used = 0 OR used + n <= 600 THEN chunk ELSE chunk + 1 END FROM g JOIN r ON r.conv_id = g.conv_id AND r.k = g.k + 1)
SELECT conv_id, turn, chunk FROM g"""
)
def greedy_turn_groups(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), F.length("text").cast("long").alias("n"))
    return chunking.greedy_groups(c, ["conv_id"], "turn", "n", 600)


@query()
def chunk_packing(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "doc_id").alias("uri"), "text")
    return chunking.pack(d, 2200, by_line=True)


@query("SELECT 'rows' AS name, count(*) AS n FROM documents")
def row_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.lit("rows").alias("name"), F.count("*").alias("n"))


@query("SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS r FROM documents WHERE lang = 'en') WHERE r <= 64")
def sample_by_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("lang = 'en'").orderBy("doc_id").limit(64).select("doc_id", "text")
