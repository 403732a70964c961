"""Catalogue joins: ordered hydration, interval overlap, structure annotations, coverage and repair."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import globs

#: Lines (or bytes) of a bucket by which intervals meet.
BUCKET = 256


def hydrate(rows: DataFrame, wanted: DataFrame, key: str, position: str = "position") -> DataFrame:
    """Rows of the wanted ids, one for each position; repeated ids repeat, missing ones go."""
    return wanted.select(key, position).join(rows, key)


def hydrate_list(rows: DataFrame, ids: list, key: str) -> DataFrame:
    """``hydrate`` for a list of the caller, in order."""
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    wanted = spark.createDataFrame([(i, v) for i, v in enumerate(ids)], f"position long, `{key}` {kind}")
    return hydrate(rows, F.broadcast(wanted), key).orderBy("position")


def filtered(rows: DataFrame, *, ids: list | None = None, include: list[str] | None = None, exclude: list[str] | None = None, languages: list[str] | None = None, symbols: list[str] | None = None, id_col: str = "id", path: str = "uri", symbols_col: str = "symbols") -> DataFrame:
    """Rows by any of: ids, path globs, languages by extension, symbols; what isn't given doesn't filter."""
    if ids is not None:
        rows = rows.where(F.col(id_col).isin(ids))
    if include or exclude:
        rows = rows.where(globs.selected(F.col(path), include, exclude))
    if languages:
        rows = rows.where(globs.of_language(F.col(path), languages))
    if symbols:
        rows = rows.where(F.arrays_overlap(symbols_col, F.array(*[F.lit(s) for s in symbols])))
    return rows


def exported(nodes: DataFrame, exports: DataFrame) -> DataFrame:
    """nodes(path, name, qualname) that exports(path, exported) name, or whose qualified name starts with one."""
    return nodes.join(exports, "path").where((F.col("name") == F.col("exported")) | F.col("qualname").startswith(F.col("exported")))


def _cells(start: Column, end: Column, level: Column, bucket: int) -> Column:
    size = F.lit(bucket).cast("long") * F.pow(F.lit(4), level).cast("long")
    return F.sequence(F.floor(start / size), F.floor(F.greatest(start, end) / size))


def overlapping(left: DataFrame, right: DataFrame, key: str, lspan: tuple[str, str], rspan: tuple[str, str], *, bucket: int = BUCKET) -> DataFrame:
    """Pairs of one key whose inclusive intervals overlap, each once.

    A null end counts as the other one. An interval lies in cells that suit its length, ``bucket`` lines or 4, 16 ...
    times as many, so it is in two or three of them however long it is, and one long file is many join keys. Of a pair
    the longer one stays in its cells and the other is looked for there, for each size of cell that occurs; a pair that
    shares several cells is kept in the first of them.
    """
    a0, a1 = (F.coalesce(F.col(lspan[i]), F.col(lspan[1 - i])) for i in (0, 1))
    b0, b1 = (F.coalesce(F.col(rspan[i]), F.col(rspan[1 - i])) for i in (0, 1))
    level = lambda s, e: F.greatest(F.lit(0), F.ceil(F.log(4.0, F.greatest(e - s + 1, F.lit(1)) / bucket))).cast("int")
    a = left.select("*", a0.alias("__a0"), a1.alias("__a1")).select("*", level(F.col("__a0"), F.col("__a1")).alias("__la"))
    b = right.select("*", b0.alias("__b0"), b1.alias("__b1")).select("*", level(F.col("__b0"), F.col("__b1")).alias("__lb"))
    la, lb = (sorted(r[0] for r in x.where(f"{c} is not null").select(c).distinct().collect()) for x, c in ((a, "__la"), (b, "__lb")))  # some thirty at most
    ends = {"__a": ("__a0", "__a1"), "__b": ("__b0", "__b1")}

    def dealt(df: DataFrame, side: str, at: Column) -> DataFrame:
        """A row for each level of ``at`` and cell there."""
        s, e = (F.col(c) for c in ends[side])
        out = df.withColumn("__v", F.explode(at))
        return out.withColumn("__k", F.explode(_cells(s, e, F.col("__v"), bucket)))

    def met(own: DataFrame, other: DataFrame, side: str, levels: list[int], least: Column) -> DataFrame:
        at = F.filter(F.array(*[F.lit(v) for v in levels]), lambda v: v >= least)
        resident, visitor = dealt(own, side, F.array(f"__l{side[2]}")), dealt(other, "__b" if side == "__a" else "__a", at)
        return resident.join(visitor, [key, "__v", "__k"])

    parts = []
    if la:
        parts.append(met(a, b, "__a", la, F.col("__lb")))
    if lb and la and lb[-1] > la[0]:
        parts.append(met(b, a, "__b", lb, F.col("__la") + 1))
    columns = [key, *[c for c in left.columns if c != key], *[c for c in right.columns if c != key]]
    if not parts:
        return left.join(right, key).select(*columns).limit(0)
    first = F.floor(F.greatest("__a0", "__b0") / (F.lit(bucket).cast("long") * F.pow(F.lit(4), F.col("__v")).cast("long")))
    out = [p.where("__a0 <= __b1 and __a1 >= __b0").where(F.col("__k") == first).select(*columns) for p in parts]
    return functools.reduce(DataFrame.unionByName, out)


def containing(points: DataFrame, spans: DataFrame, key: str, at: str, span: tuple[str, str], point_id: str, span_id: str, *, bucket: int = BUCKET) -> DataFrame:
    """For each point the smallest id of a span that holds it, or -1."""
    p = points.select(point_id, key, at).withColumn("__s", F.col(at)).withColumn("__e", F.col(at))
    found = overlapping(p, spans.select(key, span_id, *span), key, ("__s", "__e"), span, bucket=bucket)
    first = found.groupBy(point_id).agg(F.min(span_id).alias(span_id))
    return points.join(first, point_id, "left").withColumn(span_id, F.coalesce(span_id, F.lit(-1)))


def innermost(points: DataFrame, spans: DataFrame, key: str, at: str, span: tuple[str, str], point_id: str, span_id: str, *, bucket: int = BUCKET) -> DataFrame:
    """For each point the shortest span that holds it; ties to the later start, then the smaller id."""
    p = points.select(point_id, key, at).withColumn("__s", F.col(at)).withColumn("__e", F.col(at))
    found = overlapping(p, spans.select(key, span_id, *span), key, ("__s", "__e"), span, bucket=bucket)
    return found.groupBy(point_id).agg(F.min_by(span_id, F.struct((F.col(span[1]) - F.col(span[0])).alias("n"), (-F.col(span[0])).alias("s"), F.col(span_id))).alias(span_id))


def top_level(defs: DataFrame, key: str, id_col: str, span: tuple[str, str]) -> DataFrame:
    """Definitions that no other one of the file holds; of equal spans the smaller id stays."""
    other = defs.select(key, F.col(id_col).alias("__i"), F.col(span[0]).alias("__s"), F.col(span[1]).alias("__e"))
    pairs = overlapping(defs.select(key, id_col, *span), other, key, span, ("__s", "__e"))
    inner = pairs.where((F.col("__s") <= F.col(span[0])) & (F.col("__e") >= F.col(span[1])) & (F.col("__i") != F.col(id_col)))
    inner = inner.where((F.col("__s") < F.col(span[0])) | (F.col("__e") > F.col(span[1])) | (F.col("__i") < F.col(id_col)))
    return defs.join(inner.select(id_col).distinct(), id_col, "left_anti")


def annotations(chunks: DataFrame, nodes: DataFrame, *, key: str = "uri", chunk_id: str = "id", kind: str = "kind") -> DataFrame:
    """Per chunk: the sorted kinds of the syntax nodes that overlap its lines, and the first of them."""
    found = overlapping(chunks.select(key, chunk_id, "start_line", "end_line"), nodes.select(key, kind, F.col("start_line").alias("ns"), F.col("end_line").alias("ne")), key, ("start_line", "end_line"), ("ns", "ne"))
    kinds = found.groupBy(chunk_id).agg(F.sort_array(F.collect_set(kind)).alias("kinds"))
    out = chunks.select(chunk_id).distinct().join(kinds, chunk_id, "left").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))
    return out.withColumn("first_kind", F.get("kinds", F.lit(0)))


def coverage(pool: DataFrame, chunks: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """The pool with each hit's chunk and module, where there are any."""
    out = pool.join(chunks, "chunk_id", "left")
    return out.join(modules, "uri", "left") if modules is not None else out.withColumn("module", F.lit(None).cast("string"))


def repaired(results: DataFrame, rows: DataFrame, fields: list[str], key: str = "chunk_id") -> DataFrame:
    """Results with blank fields filled from the rows; those without a row are dropped. Adds whether it was repaired."""
    r = rows.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    blank = lambda f: F.trim(F.coalesce(F.col(f), F.lit(""))) == ""
    out = results.join(r, key)
    fixed = F.lit(False)
    for f in fields:
        fixed = fixed | blank(f)
    out = out.withColumn("repaired", fixed)
    for f in fields:
        out = out.withColumn(f, F.when(blank(f), F.col(f"__{f}")).otherwise(F.col(f)))
    return out.drop(*[f"__{f}" for f in fields])


def resolved(rows: DataFrame, mode: str, text: str = "content") -> DataFrame:
    """A fetched row in full, with 200 characters of its text, or without it."""
    if mode not in ("full", "summary", "metadata_only"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "full":
        return rows
    return rows.withColumn(text, F.substring(text, 1, 200)) if mode == "summary" else rows.drop(text)


def latest_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """An upsert: new rows replace old ones of their key; columns that one side lacks are null."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each key by its last row; a struct maximum needs no sort of the group."""
    rest = [c for c in rows.columns if c not in keys]
    out = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r"))
    return out.select(*keys, "__r.*")


def search_lines(texts: DataFrame, pattern: str, *, id_col: str, text_col: str = "text", regex: bool = False, case: bool = True, width: int = 200) -> DataFrame:
    """(id, line_no from 1, column from 1, preview) of the lines that hold a text or expression.

    Texts without it are passed over before any is split into lines.
    """
    flag = "" if case else "(?i)"
    body = F.col(text_col)
    quoted = pattern if regex else "\\Q" + pattern + "\\E"
    held = body.rlike(flag + quoted) if regex or not case else body.contains(pattern)
    lines = texts.where(held).select(F.col(id_col), F.posexplode(F.split(body, "\n")).alias("line_no", "line"))
    line = F.col("line")
    hit = line.rlike(flag + quoted) if regex or not case else line.contains(pattern)
    at = F.instr(line, F.regexp_substr(line, F.lit(flag + quoted))) if regex or not case else F.instr(line, F.lit(pattern))
    return lines.where(hit).select(id_col, (F.col("line_no") + 1).cast("long").alias("line_no"), at.cast("long").alias("column"), F.substring("line", 1, width).alias("preview"))
