"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from siltstone.llm import fim, licenses, mixing, urls

#: Rounds of raking in SQL, where there is no test of convergence; the tables need 8 to 13 to reach the operator's tolerance.
UNROLLED = 24
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _licenses() -> str:
    t = licenses.THRESHOLD
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
    rows = ", ".join(f"('{n}', [{quoted(licenses.bigrams(x))}], [{quoted(licenses.versions(x))}]::VARCHAR[])" for n, x in sorted(licenses.TEMPLATES.items()))
    return f"""WITH t(name, b, v) AS (VALUES {rows}),
l AS (SELECT doc_id, string_split(text, chr(10)) AS lines, text FROM documents),
u AS (SELECT doc_id, unnest(CASE WHEN len(lines) > 1 THEN list_append(lines, text) ELSE lines END) AS unit FROM l),
w AS (SELECT doc_id, row_number() OVER () AS unit_no, list_filter(string_split(regexp_replace(translate(unit, {_AZ}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM u),
g AS (SELECT doc_id, unit_no, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w WHERE len(w) > 0),
b AS (SELECT doc_id, unit_no, w, list(g || ' ' || n) AS b FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, unit_no, g) AS n FROM g) JOIN w USING (doc_id, unit_no) GROUP BY 1, 2, 3),
d AS (SELECT doc_id, unit_no, name, 2.0 * len(list_intersect(b.b, t.b)) / (len(b.b) + len(t.b)) AS s FROM b, t WHERE list_has_all(w, v)),
m AS (SELECT doc_id, unit_no, max(s) AS s, arg_min(name, (-s, name)) AS name FROM d WHERE s >= {t} GROUP BY 1, 2),
best AS (SELECT doc_id, arg_min(name, (-s, name)) AS license, max(s) AS score, count(*) AS n FROM m GROUP BY 1)
SELECT doc_id, license, round(coalesce(score, 0), 9)::DOUBLE AS score, coalesce(n, 0) AS n_matches FROM documents LEFT JOIN best USING (doc_id)"""


def _mixing() -> str:
    word = "[^ \\t\\n\\x0B\\f\\r]+"
    out = [
        f"""d AS (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, coalesce(CASE WHEN contains(text, 'icensed under') OR contains(text, 'Released under') THEN 'legal' WHEN contains(text, '@') THEN 'contact' WHEN length(text) >= 6000 THEN 'long' ELSE 'general' END, 'unknown') AS topic, coalesce(len(regexp_extract_all(text, '{word}')), 0) AS tokens FROM documents)""",
        "c AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS c FROM d GROUP BY 1, 2, 3 HAVING sum(tokens) > 0)",
        "m AS (SELECT *, sum(c) OVER () AS total, " + ", ".join(f"sum(c) OVER (PARTITION BY {x}) AS m_{x}" for x in mixing.DIMENSIONS) + " FROM c)",
        "w0 AS (SELECT *, c AS w, " + ", ".join(f"pow(m_{x}, {mixing.TEMPER[x]}) / sum(pow(m_{x}, {mixing.TEMPER[x]}) * c / m_{x}) OVER () AS t_{x}" for x in mixing.DIMENSIONS) + " FROM m)",
    ]
    n = 0
    for _ in range(UNROLLED):
        for x in mixing.DIMENSIONS:
            out.append(f"w{n + 1} AS (SELECT * REPLACE (w * t_{x} * total / sum(w) OVER (PARTITION BY {x}) AS w) FROM w{n})")
            n += 1
    before = "OVER (ORDER BY r DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    out += [
        f"r AS (SELECT *, w / c AS r FROM w{n})",
        f"s AS (SELECT *, ({mixing.BUDGET} * total - coalesce(sum(c) {before}, 0)) / nullif(sum(w) OVER () - coalesce(sum(w) {before}, 0), 0) AS s, row_number() OVER (ORDER BY r DESC, source, lang, topic) AS n FROM r)",
        "k AS (SELECT arg_min(s, n) AS scale FROM s WHERE s * r <= 1)",
        "p AS (SELECT source, lang, topic, r AS weight, least(1.0, coalesce(scale * r, 1.0)) AS p FROM s, k)",
    ]
    return "WITH " + ", ".join(out) + " SELECT doc_id, source, lang, topic, tokens::BIGINT AS tokens, round(coalesce(weight, 0), 8) AS weight, round(coalesce(p, 1), 8) AS p, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < coalesce(p, 1) AS kept FROM d LEFT JOIN p USING (source, lang, topic)"


def _urls() -> str:
    def ruled(host: str, path: str, what: str) -> str:
        out = []
        for verdict, h, p in sorted(urls.RULES, key=lambda r: -len(r[1] + r[2])):
            said = h + p if what == "rule" else verdict
            out.append(f"WHEN ({host} = '{h}' OR {host} LIKE '%.{h}') AND starts_with({path}, '{p}') THEN '{said}'")
        return "CASE " + " ".join(out) + " END"

    node = lambda u: f"translate(regexp_extract({u}, '^(.*?://[^/?#]*)([^#]*)', 1), {_AZ}) || regexp_extract({u}, '^(.*?://[^/?#]*)([^#]*)', 2)"
    host = lambda u: f"coalesce(translate(regexp_extract({u}, '://([^/?#]*)', 1), {_AZ}), '')"
    path = lambda u: f"coalesce(regexp_extract({u}, '://[^/?#]*([^?#]*)', 1), '')"
    tag = "coalesce(nullif(regexp_extract(tag, '(?i)^<link[^>]*rel\\s*=\\s*[\"'']?canonical', 0), ''), '') <> '' OR regexp_matches(tag, '(?i)^<meta[^>]*http-equiv\\s*=\\s*[\"'']?refresh')"
    to = "CASE WHEN regexp_matches(tag, '(?i)^<link') THEN regexp_extract(tag, '(?i)\\shref\\s*=\\s*[\"'']?([^\"''\\s>]+)', 1) ELSE regexp_extract(tag, '(?i)url\\s*=\\s*([^\"''\\s>]+)', 1) END"
    return f"""WITH RECURSIVE t AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)[^>]*>')) AS tag FROM pages),
e0 AS (SELECT {node('url')} AS a, {node('dest')} AS b FROM (SELECT url, {to} AS dest FROM t WHERE {tag})),
e AS (SELECT a, b FROM e0 WHERE a <> '' AND b <> '' AND a <> b UNION SELECT b, a FROM e0 WHERE a <> '' AND b <> '' AND a <> b),
reach AS (SELECT a AS x, a AS y FROM e UNION SELECT r.x, e.b FROM reach r JOIN e ON r.y = e.a),
said AS (SELECT x, bool_or({ruled(host('y'), path('y'), 'verdict')} = 'allow') AS allowed, bool_or({ruled(host('y'), path('y'), 'verdict')} = 'block') AS blocked FROM reach GROUP BY 1),
p AS (SELECT page_id, {host('url')} AS host, {path('url')} AS path, {node('url')} AS node FROM pages)
SELECT page_id, host, path, {ruled('host', 'path', 'rule')} AS rule, coalesce({ruled('host', 'path', 'verdict')}, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' END, 'allow') AS verdict FROM p LEFT JOIN said ON node = x"""


def _middle() -> str:
    first, last, middle = fim.SENTINELS
    held = " OR ".join(f"contains(t, '{s}')" for s in fim.SENTINELS)
    draws = ", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('{fim.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (SELECT *, {draws} FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN n = 0 OR {held} OR h3 % 100 >= {fim.RATE} THEN 'plain' WHEN h4 % 100 < {fim.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM d),
o AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{first}' || p || '{last}' || s || '{middle}' || m ELSE '{last}' || s || '{first}' || p || '{middle}' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM o"""


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

SQL: dict[str, str] = {
    "op2_license_scan": _licenses(),
    "op5_mix_sources": _mixing(),
    "op8_url_filter": _urls(),
    "op9_decontaminate": f"""WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark), ik AS (SELECT *, least(10, len(w)) AS k FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[j:j + k - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS j FROM ik)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, j, k, array_to_string(w[j:j + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM d, (SELECT DISTINCT k FROM ik))),
h AS (SELECT doc_id, item_id, j, k FROM g JOIN win USING (k, win)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + k)) AS p FROM h) GROUP BY 1),
s AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS items FROM h GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)""",
    "op12_fill_in_middle": _middle(),
}
