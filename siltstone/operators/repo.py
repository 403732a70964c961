"""Repository metrics: module rows, tags, hotspots, ownership, symbols and their stitching to syntax nodes."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: The default tag rules and the import prefixes and calls that mark side effects.
TAG_RULES = {
    "cli": {"any_import": ["typer", "click"]},
    "fastapi": {"any_import": ["fastapi"]},
    "pydantic": {"any_import": ["pydantic", "pydantic_settings"]},
    "prefect": {"any_import": ["prefect"]},
    "tests": {"path_regex": "(^|/)tests(/|$)"},
    "reexport-hub": {"flag": "is_reexport_hub"},
    "public-api": {"flag": "has_all"},
    "needs-types": {"above": ("type_errors", 0)},
    "hotspot": {"least": ("hotspot", 6)},
    "low-coverage": {"below": ("coverage", 0.65)},
    "docs-missing": {"without": "has_summary"},
}
SIDE_EFFECTS = {"filesystem": ["os", "pathlib", "shutil"], "network": ["requests", "httpx", "urllib", "socket"], "subprocess": ["subprocess"], "database": ["sqlite3", "duckdb", "psycopg"]}


def tags(rules: dict | None = None, imports: str = "imports", path: str = "path") -> Column:
    """The sorted tags of a module row; a rule holds if any of its conditions does, and not where its column is null."""
    found = []
    for tag, rule in sorted((rules or TAG_RULES).items()):
        c = F.lit(False)
        if "any_import" in rule:
            c = c | F.arrays_overlap(F.col(imports), F.array(*[F.lit(m) for m in rule["any_import"]]))
        if "path_regex" in rule:
            c = c | F.col(path).rlike(rule["path_regex"])
        if "flag" in rule:
            c = c | F.col(rule["flag"])
        if "above" in rule:
            c = c | (F.col(rule["above"][0]) > rule["above"][1])
        if "least" in rule:
            c = c | (F.col(rule["least"][0]) >= rule["least"][1])
        if "below" in rule:
            c = c | (F.col(rule["below"][0]) < rule["below"][1])
        if "without" in rule:
            c = c | ~F.col(rule["without"])
        found.append(F.when(F.coalesce(c, F.lit(False)), tag))
    return F.array_compact(F.array(*found))


def reexport_hub(star: Column, exports: Column) -> Column:
    return star | (exports >= 10)


def hotspot(fan_in: Column, fan_out: Column, cyclomatic: Column, untyped: Column, errors: Column, churn: Column, coverage: Column) -> Column:
    """Weighted logarithms of a module's risks, at most 10, to 3 places; unknown coverage counts as none."""
    total = 0.4 * F.log1p(fan_in + fan_out) + 0.3 * F.log1p(cyclomatic + untyped) + 0.2 * F.log1p(errors + 1) + 0.3 * F.log1p(churn + 1) + 0.2 * (1 - F.coalesce(coverage, F.lit(0.0)))
    return F.round(F.least(total, F.lit(10.0)), 3)


def side_effects(imports: Column) -> Column:
    """Flags by the roots of the imports."""
    roots = F.transform(imports, lambda m: F.split(m, r"\.")[0])
    return F.create_map(*[x for k, names in SIDE_EFFECTS.items() for x in (F.lit(k), F.arrays_overlap(roots, F.array(*[F.lit(n) for n in names])))])


def tag_index(modules: DataFrame) -> DataFrame:
    """(tag, path, n) of modules(path, tags): a row a posting, with the number of its tag's; a hot tag is many rows, not one array."""
    rows = modules.select("path", F.explode("tags").alias("tag"))
    return rows.join(rows.groupBy("tag").agg(F.count("*").alias("n")), "tag").select("tag", "path", "n")


def ownership(commits: DataFrame, now: Column, *, recent: int | None = None, windows: tuple[int, ...] = (30, 90), top: int = 3) -> DataFrame:
    """Per path of commits(path, author, ts, seq): top authors, bus factor, commits in trailing windows of days.

    Authors are counted before anything is gathered, so a busy path is one row an author.
    """
    c = commits
    if recent:
        c = c.withColumn("__n", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("ts"), F.desc("seq")))).where(F.col("__n") <= recent)
    churn = [F.sum(F.when(F.col("ts") >= now - F.make_dt_interval(F.lit(d)), 1).otherwise(0)).alias(f"churn_{d}") for d in windows]
    by = c.groupBy("path", "author").agg(F.count("*").alias("n"), *churn)
    best = by.withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("n"), "author")))
    return best.groupBy("path").agg(F.sum("n").alias("n_commits"), F.count("*").alias("n_authors"), F.array_sort(F.collect_list(F.when(F.col("r") <= top, F.struct("r", "author")))).getField("author").alias("primary_authors"), (F.max("n") / F.sum("n")).alias("bus_factor"), *[F.sum(f"churn_{d}").alias(f"churn_{d}") for d in windows])


def cross_reference(occurrences: DataFrame) -> DataFrame:
    """(symbol, role, uri, n): the files that define a symbol (role bit 1) and those that use it, with how often; a row a
    file, so a symbol that very many files use is many rows."""
    role = F.when(F.col("roles").bitwiseAND(1) == 1, "def").otherwise("ref")
    return occurrences.groupBy("symbol", role.alias("role"), "uri").agg(F.count("*").alias("n"))


def definitions(occurrences: DataFrame) -> DataFrame:
    return occurrences.where(F.col("roles").bitwiseAND(1) == 1)


def prefix_search(symbols: DataFrame, prefix: str, *, name: str, kind: str, tie: str, kinds: list[str] | None = None, limit: int = 200) -> DataFrame:
    """Names that start so in any case, shortest first."""
    out = symbols.where(F.lower(name).startswith(prefix.lower()))
    if kinds:
        out = out.where(F.col(kind).isin(kinds))
    return out.orderBy(F.length(name), kind, name, tie).limit(limit)


def stitch(nodes: DataFrame, candidates: DataFrame) -> DataFrame:
    """The best symbol of each syntax node: (node_id, symbol, confidence).

    nodes(node_id, path, line, name, qname), candidates(symbol, path, line, name, qname). Equal qualified names score 1,
    a name within a line 0.8, a name 0.6, a place alone 0.5; ties go to the smaller symbol. Null symbols take no part.

    Each score asks for the smallest symbol of some equal columns, so candidates are brought to one row a key first and a
    node meets at most one row of each, however many candidates share its file and name. Lines meet by equality: a
    candidate stands at line - 1, line and line + 1.
    """
    c = candidates.select("path", "symbol", "line", "name", "qname")

    def least(label: str, *keys: str) -> DataFrame:
        return c.groupBy("path", *keys).agg(F.min("symbol").alias(label))

    def near(label: str, *keys: str) -> DataFrame:
        around = F.explode(F.array(F.col("line") - 1, F.col("line"), F.col("line") + 1)).alias("line")
        return least(label, "line", *keys).select("path", around, *keys, label).groupBy("path", "line", *keys).agg(F.min(label).alias(label))

    found = nodes.select("node_id", "path", "line", "name", "qname")
    for label, keys, at in [("q_near", ["qname"], True), ("q_named", ["name", "qname"], False), ("n_near", ["name"], True), ("named", ["name"], False), ("close", [], True)]:
        keys_at = ["path", "line", *keys] if at else ["path", *keys]
        found = found.join((near if at else least)(label, *keys), keys_at, "left")
    ranks = [(1.0, F.least("q_near", "q_named")), (0.8, F.col("n_near")), (0.6, F.col("named")), (0.5, F.col("close"))]
    confidence = F.coalesce(*[F.when(s.isNotNull(), v) for v, s in ranks])
    found = found.select("node_id", confidence.alias("confidence"), F.coalesce(*[s for _, s in ranks]).alias("symbol")).where("symbol is not null")
    best = found.groupBy("node_id").agg(F.max("confidence").alias("m"), *[F.min(F.when(F.col("confidence") == v, F.col("symbol"))).alias(f"s{i}") for i, (v, _) in enumerate(ranks)])
    return best.select("node_id", F.coalesce(*[f"s{i}" for i in range(len(ranks))]).alias("symbol"), F.col("m").alias("confidence"))


def _measured(code: str) -> dict:
    """Counts and names of one Python source."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError) as e:
        return {"error": type(e).__name__}
    nodes = list(ast.walk(tree))
    funcs = [n for n in nodes if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    classes = [n for n in nodes if isinstance(n, ast.ClassDef)]
    branch = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.BoolOp, ast.IfExp, ast.comprehension)

    def depth(node, d=0):
        d += isinstance(node, branch[:6])
        return max([d, *(depth(c, d) for c in ast.iter_child_nodes(node))])

    imports = [{"module": a.name, "name": "", "level": 0} for n in nodes if isinstance(n, ast.Import) for a in n.names]
    imports += [{"module": n.module or "", "name": a.name, "level": n.level} for n in nodes if isinstance(n, ast.ImportFrom) for a in n.names]
    args = [a for f in funcs for a in [*f.args.posonlyargs, *f.args.args, *f.args.kwonlyargs] if a.arg not in ("self", "cls")]
    exports = next((ast.literal_eval(n.value) for n in tree.body if isinstance(n, ast.Assign) and any(getattr(t, "id", "") == "__all__" for t in n.targets) and isinstance(n.value, (ast.List, ast.Tuple)) and all(isinstance(e, ast.Constant) for e in n.value.elts)), [])
    branches = sum(isinstance(n, branch) for n in nodes)
    public = [n for n in [*funcs, *classes] if not n.name.startswith("_")]
    return {
        "error": None,
        "imports": imports,
        "defs": [{"kind": type(n).__name__, "name": n.name, "line": n.lineno, "end_line": n.end_lineno} for n in sorted([*funcs, *classes], key=lambda n: n.lineno)],
        "exports": [str(e) for e in exports],
        "docstring": ast.get_docstring(tree),
        "cyclomatic": 1 + branches,
        "cognitive": 1 + branches + depth(tree),
        "n_functions": len(funcs),
        "n_classes": len(classes),
        "param_ratio": sum(a.annotation is not None for a in args) / len(args) if args else 1.0,
        "return_ratio": sum(f.returns is not None for f in funcs) / len(funcs) if funcs else 1.0,
        "doc_ratio": sum(ast.get_docstring(n) is not None for n in public) / len(public) if public else 1.0,
        "raises": sorted({n.exc.func.id if isinstance(n.exc, ast.Call) else n.exc.id for n in nodes if isinstance(n, ast.Raise) and isinstance(getattr(n.exc, "func", n.exc), ast.Name)}),
    }


MODULE = "error string, imports array<struct<module:string,name:string,level:int>>, defs array<struct<kind:string,name:string,line:int,end_line:int>>, exports array<string>, docstring string, cyclomatic int, cognitive int, n_functions int, n_classes int, param_ratio double, return_ratio double, doc_ratio double, raises array<string>"


def modules(files: DataFrame) -> DataFrame:
    """A row of counts and names for each Python source of files(path, code); one that doesn't parse has its error."""
    names = ["error", "imports", "defs", "exports", "docstring", "cyclomatic", "cognitive", "n_functions", "n_classes", "param_ratio", "return_ratio", "doc_ratio", "raises"]

    def run(batches):
        for pdf in batches:
            rows = [_measured(c or "") for c in pdf["code"]]
            yield pd.DataFrame({"path": pdf["path"].array, **{n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names}})

    return files.select("path", "code").mapInPandas(run, f"path string, {MODULE}")


NODES = "path string, kind string, name string, qualname string, parent string, line int, end_line int, col int, decorators array<string>, bases array<string>, docstring string, is_public boolean"


def _nodes(code: str) -> list[tuple]:
    """Classes and functions of a source, with their places and parents."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError):
        return []
    out = []

    def walk(node, parent):
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                qualname = f"{parent}.{n.name}" if parent else n.name
                bases = [ast.unparse(b) for b in getattr(n, "bases", [])]
                out.append((type(n).__name__, n.name, qualname, parent or None, n.lineno, n.end_lineno, n.col_offset, [ast.unparse(d) for d in n.decorator_list], bases, ast.get_docstring(n), not n.name.startswith("_")))
                walk(n, qualname)
            else:
                walk(n, parent)

    walk(tree, "")
    return out


def syntax_nodes(files: DataFrame) -> DataFrame:
    """A row for each class and function of files(path, code)."""
    names = [part.strip().split(" ")[0] for part in NODES.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = [(p, *n) for p, c in zip(pdf["path"], pdf["code"], strict=True) for n in _nodes(c or "")]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "code").mapInPandas(run, NODES)
