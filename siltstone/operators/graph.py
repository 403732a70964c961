"""Import and use graphs: target resolution, degrees, PageRank and strongly connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from siltstone.sources.tables import checkpoint_root, written


def use_edges(defs: DataFrame, refs: DataFrame) -> DataFrame:
    """(def_path, use_path, symbol, uses): the first definition of a symbol by doc_order, used from other files."""
    first = defs.groupBy("symbol").agg(F.min_by("path", F.struct("doc_order", "path")).alias("def_path"))
    used = refs.join(first, "symbol").where("path <> def_path")
    return used.groupBy("def_path", F.col("path").alias("use_path"), "symbol").agg(F.count("*").alias("uses"))


def usage(edges: DataFrame) -> DataFrame:
    """Per defining file: how many files use it, and how many uses there are."""
    return edges.groupBy("def_path").agg(F.count_distinct("use_path").alias("used_by_files"), F.sum("uses").alias("used_by_symbols"))


def prefixes(module: F.Column) -> F.Column:
    """a.b.c: a, a.b and a.b.c."""
    parts = F.split(module, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, F.lit(1), i)))


def _best_two(rows: DataFrame, by: str, value: str, order: list[str]) -> DataFrame:
    """(by, first, second) of rows that repeat no (by, value): its two last values in an order, the second null if there is one."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*[F.desc(c) for c in order]))
    two = rows.withColumn("r", place).where("r <= 2")
    return two.groupBy(by).agg(F.max(F.when(F.col("r") == 1, F.col(value))).alias("first"), F.max(F.when(F.col("r") == 2, F.col(value))).alias("second"))


def resolve_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Import edges (src_path, dst_path): the longest known module that equals or is a prefix of imports(path, target).

    An import looks for another file than its own, so the best two files of a target are enough for all that import it:
    these are found once for each target, from the best two of each module, and a module that very many files are named
    like is two rows. Null paths take no part.
    """
    files = modules.select("module", F.col("path").alias("dst_path")).where("dst_path is not null").distinct()
    files = _best_two(files, "module", "dst_path", ["dst_path"]).select("module", F.explode(F.array("first", "second")).alias("dst_path")).where("dst_path is not null")
    names = imports.select("target").distinct().select("target", F.explode(prefixes(F.col("target"))).alias("module"))
    found = names.join(files, "module").groupBy("target", "dst_path").agg(F.max(F.length("module")).alias("n"))
    best = _best_two(found, "target", "dst_path", ["n", "dst_path"])
    edges = imports.select("path", "target").join(best, "target")
    other = F.when(F.col("path") != F.col("first"), F.col("first")).when(F.col("path") != F.col("second"), F.col("second"))
    return edges.select(F.col("path").alias("src_path"), other.alias("dst_path")).where("dst_path is not null").distinct()


def related_tests(tests: DataFrame, modules: DataFrame) -> DataFrame:
    """(path, module): tests(path, target) whose import equals a module, is a prefix of it or extends it.

    The modules of each target are found once, names that repeat counted once, before the tests that import it.
    """
    names, targets = modules.select("module").distinct(), tests.select("target").distinct()
    up = targets.select("target", F.explode(prefixes(F.col("target"))).alias("module")).join(names, "module")
    down = names.select("module", F.explode(prefixes(F.col("module"))).alias("target")).join(targets, "target")
    related = up.select("target", "module").unionByName(down.select("target", "module")).distinct()
    return tests.select("path", "target").distinct().join(related, "target").select("path", "module").distinct()


def star_exports(imports: DataFrame, public: DataFrame, local: DataFrame) -> DataFrame:
    """(module, name, origin): names that star imports(module, origin, pos) bring, unless defined locally; first wins."""
    named = imports.join(public.select(F.col("module").alias("origin"), "name"), "origin")
    named = named.join(local.select("module", "name"), ["module", "name"], "left_anti")
    return named.groupBy("module", "name").agg(F.min_by("origin", F.struct("pos", "origin")).alias("origin"))


def config_refs(modules: DataFrame, configs: DataFrame) -> DataFrame:
    """(path, config, distance): configuration files in a module's folder or those above it, nearest first."""
    folder = lambda c: F.regexp_replace(c, "/?[^/]*$", "")
    parts = F.filter(F.split(folder(F.col("path")), "/"), lambda x: x != "")
    depth = F.size(parts)
    above = F.explode(F.transform(F.sequence(F.lit(0), depth), lambda i: F.struct(F.concat_ws("/", F.slice(parts, F.lit(1), i)).alias("folder"), (depth - i).alias("distance"))))
    up = modules.select("path", above.alias("a")).select("path", "a.folder", "a.distance")
    return up.join(configs.select(F.col("path").alias("config"), folder(F.col("path")).alias("folder")), "folder").select("path", "config", "distance")


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Fan-in and fan-out by distinct neighbours, 0 where there are none."""
    e = edges.select("src", "dst").distinct()
    fan_in = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fan_in"))
    fan_out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("fan_out"))
    return nodes.select("node").join(fan_in, "node", "left").join(fan_out, "node", "left").na.fill(0, ["fan_in", "fan_out"])


def pagerank(edges: DataFrame, nodes: DataFrame, *, damping: float = 0.85, rounds: int = 25, cut: int = 5) -> DataFrame:
    """(node, rank) after a fixed number of rounds; the mass of nodes without out-edges is lost.

    The edges with their shares are checkpointed once; lineage is cut every few rounds.
    """
    checkpoint_root(edges.sparkSession)
    e = edges.select("src", "dst").distinct()
    out = e.groupBy("src").agg(F.count("*").alias("n"))
    shares = e.join(out, "src").select("src", "dst", (1.0 / F.col("n")).alias("share")).checkpoint()
    n = nodes.select("node").distinct().count()
    base = nodes.select("node").distinct().checkpoint()
    rank = base.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for i in range(rounds):
        sent = shares.join(rank.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        rank = base.join(sent, "node", "left").select("node", (F.lit((1 - damping) / max(n, 1)) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if (i + 1) % cut == 0:
            rank = rank.checkpoint()
    return rank


def _spread(edges: DataFrame, label: DataFrame) -> DataFrame:
    """Smallest label that reaches each node along the edges."""
    total = None
    while True:
        sent = edges.join(label.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "label")
        label = written(label.unionByName(sent).groupBy("node").agg(F.min("label").alias("label")))
        now = label.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return label
        total = now


def _contracted(edges: DataFrame, max_rounds: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges without the inner nodes of chains, these nodes as (node, head, tail), and the nodes of rings (node, component).

    An inner node has one edge in and one out. Pointers both ways are doubled until they lead out of the chain, which
    takes the logarithm of its length; those that never do lie on a ring of such nodes, whose smallest they meet.
    """
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("head"), F.count("*").alias("n_in"))
    out = edges.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("tail"), F.count("*").alias("n_out"))
    at = written(into.join(out, "node").where("n_in = 1 and n_out = 1").select("node", "head", "tail", F.col("node").alias("low")))
    inner = at.select("node")
    longest = inner.count()
    rest = edges.join(inner.withColumnRenamed("node", "src"), "src", "left_anti").join(inner.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
    if not longest:
        return rest, at.select("node", "head", "tail"), at.select("node", F.col("low").alias("component"))
    # Who is out of the chain points to itself; the smallest node passed goes along towards the tail.
    for k in range(max_rounds):
        back = at.select(F.col("node").alias("head"), F.col("head").alias("far_head"))
        on = at.select(F.col("node").alias("tail"), F.col("tail").alias("far_tail"), F.col("low").alias("far_low"))
        step = at.join(back, "head", "left").join(on, "tail", "left")
        moved = F.col("far_head").isNotNull() | F.col("far_tail").isNotNull()
        at = written(step.select("node", F.coalesce("far_head", "head").alias("head"), F.coalesce("far_tail", "tail").alias("tail"), F.least("low", F.coalesce("far_low", "low")).alias("low"), moved.alias("moved")))
        if 1 << k > longest or at.where("moved").isEmpty():
            break
    left = at.join(inner.withColumnRenamed("node", "tail").withColumn("ring", F.lit(True)), "tail", "left")
    chains = written(left.where("ring is null").select("node", "head", "tail"))
    rings = written(left.where("ring").select("node", F.col("low").alias("component")))
    joined = chains.select(F.col("head").alias("src"), F.col("tail").alias("dst"))
    return written(rest.unionByName(joined).where("src <> dst").distinct()), chains, rings


def strong_components(edges: DataFrame, nodes: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, component): the smallest node of each strongly connected component. Nodes are whole numbers.

    Chains are contracted first, so that a long path or ring takes rounds by the logarithm of its length: a node with one
    edge in and one out is on a cycle only if the ends of its chain are one component, and then it is of that one.
    """
    checkpoint_root(edges.sparkSession)
    every = nodes.select("node").distinct()
    e = edges.select("src", "dst").where("src <> dst").distinct()
    e = written(e.join(every.withColumnRenamed("node", "src"), "src", "left_semi").join(every.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))
    rest, chains, rings = _contracted(e)
    plain = written(every.join(chains, "node", "left_anti").join(rings, "node", "left_anti"))
    core = written(_coloured(rest, plain, max_rounds))
    name = lambda c: core.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    inner = chains.join(name("head"), "head").join(name("tail"), "tail")
    inner = inner.select("node", F.when(F.col("c_head") == F.col("c_tail"), F.col("c_head")).alias("component"))
    found = core.unionByName(inner.where("component is not null")).groupBy("component").agg(F.min("node").alias("least"))
    named = core.unionByName(inner.where("component is not null")).join(found, "component").select("node", F.col("least").alias("component"))
    alone = inner.where("component is null").select("node", F.col("node").alias("component"))
    return named.unionByName(alone).unionByName(rings)


def _coloured(edges: DataFrame, nodes: DataFrame, max_rounds: int) -> DataFrame:
    """(node, component) by colouring.

    Each round the smallest label spreads forwards; going backwards from each label's own node within its colour gives
    whole components, which are set aside. Nodes that ``max_rounds`` leave over are an error, never lost.
    """
    checkpoint_root(edges.sparkSession)
    left = written(nodes.select("node").distinct())
    e = written(edges.select("src", "dst").where("src <> dst").distinct())
    done = None
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        # a node without edges both ways is a component by itself
        both = written(e.select(F.col("src").alias("node")).distinct().join(e.select(F.col("dst").alias("node")).distinct(), "node", "left_semi"))
        single = left.join(both, "node", "left_anti").select("node", F.col("node").alias("component"))
        colour = _spread(e, written(left.join(both, "node", "left_semi").select("node", F.col("node").alias("label")))) if not both.isEmpty() else None
        found = single
        if colour is not None:
            colour = colour.join(both, "node", "left_semi")
            c1, c2 = colour.select(F.col("node").alias("src"), F.col("label").alias("l1")), colour.select(F.col("node").alias("dst"), F.col("label").alias("l2"))
            back = written(e.join(c1, "src").join(c2, "dst").where("l1 = l2").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("l1").alias("colour")))
            roots = written(colour.where("node = label").select("node", "label"))
            reach = _spread(back.select("src", "dst"), roots)
            own = reach.join(colour.withColumnRenamed("label", "colour"), "node").where("label = colour").select("node", F.col("colour").alias("component"))
            found = found.unionByName(own)
        found = written(found.distinct())
        done = found if done is None else done.unionByName(found)
        left = written(left.join(found, "node", "left_anti"))
        e = written(e.join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(left.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))
    else:
        if not left.isEmpty():
            raise RuntimeError(f"strong components did not settle in {max_rounds} rounds")
    return done if done is not None else left.select("node", F.col("node").alias("component"))


def cycles(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, size) of components that are cycles: several nodes, or one with an edge to itself."""
    size = components.groupBy("component").agg(F.count("*").alias("size"))
    self_ = edges.where("src = dst").select(F.col("src").alias("component")).distinct().withColumn("own", F.lit(True))
    return size.join(self_, "component", "left").where("size > 1 or own").select("component", "size")


def summary(edges: DataFrame, nodes: DataFrame, ranks: DataFrame, components: DataFrame) -> DataFrame:
    """Per node: degrees, rank to 6 places, whether it lies on a cycle."""
    on = components.join(cycles(components, edges), "component", "left_semi").select("node", F.lit(True).alias("in_cycle"))
    out = degrees(edges, nodes).join(ranks, "node").join(on, "node", "left")
    return out.select("node", "fan_in", "fan_out", F.round("rank", 6).alias("rank"), F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"))


def linked(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, concept): the neighbours of a document's concepts, edges taken both ways."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return concepts.join(both.withColumnRenamed("a", "concept"), "concept").select("doc_id", F.col("b").alias("concept")).distinct()
