"""URL filter: host and path rules, carried to aliases over redirect and canonical-link edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import components

#: (verdict, host, path) of the rules in production.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HREF = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_BASE = r"(?is)<base\b[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\bcontent\s*=\s*[\"']?[^\"'>]*?\burl\s*=\s*([^\"'\s>]+)"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def node(url: Column) -> Column:
    """The url without fragment, its scheme and host in lower case: the name under which aliases meet."""
    return F.concat(F.translate(F.regexp_extract(url, "^(.*?://[^/?#]*)([^#]*)", 1), _UPPER, _LOWER), F.regexp_extract(url, "^(.*?://[^/?#]*)([^#]*)", 2))


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null where none does."""
    fits = F.lit(None)
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def _bound(x: Column, f) -> Column:
    """``f`` of ``x``, which stands in the plan once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def decoded(x: str) -> str:
    """SQL: an attribute's character references of ASCII signs decoded; '&' last, so that nothing is decoded twice."""
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''")):
        x = f"replace({x}, '&{name};', '{sign}')"
    code = "cast(if(lower(substr(r, 3, 1)) = 'x', conv(substr(r, 4, length(r) - 4), 16, 10), substr(r, 3, length(r) - 3)) as int)"
    y, x = x, "y"
    x = f"aggregate(array_distinct(regexp_extract_all({x}, '(?i)&#(?:x0*[0-9a-f]{{2}}|0*[0-9]{{2,3}});', 0)), {x}, (a, r) -> if({code} between 33 and 126 and {code} <> 38, replace(a, r, chr({code})), a))"
    return f"get(transform(array({y}), y -> regexp_replace({x}, '(?i)&(?:amp|#0*38|#x0*26);', '&')), 0)"


def resolved(base: Column, ref: Column) -> Column:
    """The url that a reference names on a page: RFC 3986, inside the row. Empty without a base or for other schemes (mailto:)."""
    return _bound(F.struct(base.alias("base"), ref.alias("ref")), lambda v: _resolved(v["base"], v["ref"]))


def _resolved(base: Column, ref: Column) -> Column:
    root, own = F.regexp_extract(base, "^(.*?://[^/?#]*)", 1), F.regexp_extract(base, "^.*?://[^/?#]*([^?#]*)", 1)
    said, rest = F.regexp_extract(ref, "^([^?#]*)", 1), F.regexp_extract(ref, "^[^?#]*(.*)$", 1)
    whole = F.when(said.startswith("/"), said).otherwise(F.concat(F.when(own == "", "/").otherwise(F.regexp_replace(own, "[^/]*$", "")), said))
    up = lambda parts: F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(F.concat(a, F.array(x))))
    ends = lambda parts: F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
    path = F.when(said == "", own).otherwise(_bound(F.split(whole, "/"), lambda parts: F.concat(F.array_join(up(parts), "/"), ends(parts))))
    out = F.when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), ref).when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | (root == ""), "")
    out = out.when((ref == "") | ref.startswith("#"), base)
    return F.coalesce(out.when(ref.startswith("//"), F.concat(F.regexp_extract(base, "^(.*?:)//", 1), ref)).otherwise(F.concat(root, path, rest)), F.lit(""))


def page_edges(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges (a, b) from each page to the targets of all its canonical links and meta refreshes.

    Character references are decoded; a relative target is resolved against the page's base element, or else its url.
    """
    html = F.col(html_col)
    low = F.lower(html)
    none = F.array().cast("array<string>")
    all_ = lambda word, tag: F.when(low.contains(word), F.regexp_extract_all(html, F.lit(tag), F.lit(1))).otherwise(none)
    found = pages.where(low.contains("canonical") | low.contains("refresh"))
    found = found.select(F.col(url_col).alias("url"), F.when(low.contains("<base"), F.regexp_extract(html, _BASE, 1)).alias("base"), F.explode(F.concat(all_("canonical", _HREF), all_("refresh", _REFRESH))).alias("to"))
    found = found.select("url", F.expr(decoded("base")).alias("base"), F.expr(decoded("to")).alias("to"))
    found = found.select("url", F.coalesce(_bound(resolved(F.col("url"), F.col("base")), lambda b: F.nullif(b, F.lit(""))), F.col("url")).alias("base"), "to")
    return found.select(node(F.col("url")).alias("a"), _bound(resolved(F.col("base"), F.col("to")), node).alias("b")).where("a <> '' and b <> '' and a <> b")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, edges: DataFrame | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page row: page_id, host, path, rule, verdict.

    A url's own rule decides. Without one, its aliases do: those in its connected component over redirect edges
    (``edges(a, b)`` of urls, if given) and the pages' canonical and refresh links. An explicitly allowed alias makes
    it allowed, else a blocked one blocks it; without either it is allowed. A null url, or one without ``://``,
    has an empty host and path and is allowed. Only urls with an edge are joined; repeated rows each give a row, null
    html has no edges, other columns are ignored. Rules are a list of some hundreds at most, literals of the plan.
    """
    rules = RULES if rules is None else rules
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    links = page_edges(base, url_col="url", html_col="html")
    if edges is not None:
        links = links.unionByName(edges.select(node(F.col("a")).alias("a"), node(F.col("b")).alias("b")).where("a <> '' and b <> '' and a <> b"))
    alias = components(links)
    own = alias.withColumn("own", ruled(host(F.col("node")), path(F.col("node")), rules))
    said = own.groupBy("component").agg(F.max(F.col("own.verdict") == "allow").alias("allowed"), F.max(F.col("own.verdict") == "block").alias("blocked"))
    said = alias.join(said, "component").select("node", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("alias_verdict"))
    judged = base.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), node(F.col("url")).alias("node"))
    judged = judged.withColumn("own", ruled(F.col("host"), F.col("path"), rules))
    # a page with a rule needs no alias: its key is null, which keeps it out of the join's matches; spread by its id
    open_ = judged.where("own is null").join(said, "node", "left")
    closed = judged.where("own is not null").withColumn("alias_verdict", F.lit(None).cast("string")).select(*open_.columns)
    both = open_.unionByName(closed)
    return both.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "alias_verdict", F.lit("allow")).alias("verdict"))
