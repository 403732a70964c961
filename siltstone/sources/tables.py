"""Readers: Parquet, JSON, text and XML scans with typed fallbacks for what is missing."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from siltstone.sources.frames import json_frames

CHUNKS = "id long, uri string, start_line int, end_line int, start_byte long, end_byte long, preview string, content string, lang string, content_hash long, symbols array<string>, embedding array<float>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The folder of checkpoints: the one that ``spark.checkpoint.dir`` names; only where that is unset and Spark runs on
    this machine alone (tests), one of our own."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        root = sc.getConf().get("spark.checkpoint.dir")
        if not root and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the folder of checkpoints and read again: lineage is cut, and unlike with ``checkpoint()`` the
    optimiser carries no constraints over, which grow from round to round of a loop. It goes when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer parts than there are cores (a small or unsplittable file) dealt out evenly, for costly expressions
    on it; any other one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scan_parquet(spark: SparkSession, path: str, *, recursive: bool = False, merge: bool = False, schema: T.StructType | str | None = None) -> DataFrame:
    """A Parquet scan; with ``schema``, a typed empty relation where nothing is there to read."""
    reader = spark.read.option("recursiveFileLookup", recursive).option("mergeSchema", merge)
    if schema is None:
        return reader.parquet(path)
    try:
        return reader.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return spark.createDataFrame([], schema)
        raise


def optional_view(spark: SparkSession, view: str, path: str, fmt: str = "parquet") -> bool:
    """Registers a view over ``path``; False where that is missing."""
    try:
        spark.read.format(fmt).load(path).createOrReplaceTempView(view)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def latest(df: DataFrame, value: str, by: str, keys: list[str]) -> DataFrame:
    """The newest value of each key: a dataset resolved to its last committed root."""
    return df.groupBy(*keys).agg(F.max_by(value, by).alias(value), F.max(by).alias(by))


def read_roots(spark: SparkSession, runs: DataFrame, root: str = "parquet_root", suffix: str = "") -> DataFrame:
    """One scan over the roots that a small metadata table names."""
    roots = [f"{r[0]}{suffix}" for r in runs.select(root).distinct().orderBy(root).collect()]
    return spark.read.parquet(*roots)


def sample_vectors(chunks: DataFrame, limit: int = 64, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The first vectors by id."""
    return chunks.where(F.col(vector_col).isNotNull()).orderBy(id_col).limit(limit).select(id_col, vector_col)


def read_jsonl(spark: SparkSession, path: str, schema: str, *, skip_bad: bool = False) -> DataFrame:
    """JSON lines; bad lines are dropped, or kept in _corrupt."""
    reader = spark.read.schema(schema if skip_bad else f"{schema}, _corrupt string")
    if skip_bad:
        return reader.option("mode", "DROPMALFORMED").json(path)
    return reader.option("columnNameOfCorruptRecord", "_corrupt").json(path)


def json_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects that follow one another in files, each over as many lines as it likes; a file that breaks off keeps its
    whole ones. Files are read in splits (``frames.json_frames``)."""
    return json_frames(spark, path).select(F.from_json("text", schema).alias("r")).where("r is not null").select("r.*")


def corpus_faults(corpus: DataFrame) -> DataFrame:
    """(fault, id) of a corpus(id, contents): missing ids, repeated ids, empty contents."""
    id_ = F.trim(F.coalesce("id", F.lit("")))
    missing = corpus.where(id_ == "").select(F.lit("missing_id").alias("fault"), F.lit("").alias("id"))
    twice = corpus.where(id_ != "").groupBy("id").count().where("count > 1").select(F.lit("duplicate_id").alias("fault"), "id")
    empty = corpus.where(F.trim(F.coalesce("contents", F.lit(""))) == "").select(F.lit("empty_contents").alias("fault"), F.coalesce("id", F.lit("")).alias("id"))
    return missing.unionAll(twice).unionAll(empty)


def vector_batch_faults(batch: DataFrame) -> DataFrame:
    """One row of counts over a vector batch(key, vector): blank keys, repeated keys, dimensions other than one."""
    return batch.agg(F.count_if(F.trim(F.coalesce("key", F.lit(""))) == "").alias("blank_keys"), (F.count("key") - F.count_distinct("key")).alias("repeated_keys"), F.count_distinct(F.size("vector")).alias("dimensions"), F.count_if(F.exists("vector", lambda x: x.isNull() | F.isnan(x))).alias("bad_values"))


def read_scip(spark: SparkSession, path: str) -> DataFrame:
    """Occurrences of a SCIP JSON index: path, symbol, start and end, roles as a bit mask; doc_order rises in the file's
    order. The index is one object over many lines, of which the elements of ``documents`` are read in splits."""
    occurrence = "struct<symbol:string,range:array<int>,roles:int,symbolRoles:int>"
    docs = json_frames(spark, path, 2).select(F.col("at").alias("doc_order"), F.from_json("text", f"struct<relativePath:string,language:string,occurrences:array<{occurrence}>>").alias("d"))
    rows = docs.where("d.relativePath is not null").select("doc_order", "d.relativePath", "d.language", F.posexplode("d.occurrences").alias("occ_order", "o"))
    r = F.col("o.range")
    return rows.where(F.size(r).isin(3, 4)).select("doc_order", "occ_order", F.col("relativePath").alias("uri"), "language", F.col("o.symbol").alias("symbol"), r[0].alias("start_line"), r[1].alias("start_col"), F.when(F.size(r) == 3, r[0]).otherwise(r[2]).alias("end_line"), F.element_at(r, -1).alias("end_col"), F.coalesce("o.symbolRoles", "o.roles", F.lit(0)).alias("roles"))


def read_cobertura(spark: SparkSession, path: str) -> DataFrame:
    """Per file of a Cobertura report: lines, hits, covered ratio."""
    rows = spark.read.format("xml").option("rowTag", "class").schema("_filename string, lines struct<line:array<struct<_hits:long,_number:long>>>").load(path)
    lines = rows.select(F.col("_filename").alias("path"), F.explode_outer("lines.line").alias("l"))
    out = lines.groupBy("path").agg(F.count("l").alias("n_lines"), F.count_if(F.col("l._hits") > 0).alias("n_hit"))
    return out.withColumn("covered", F.when(F.col("n_lines") > 0, F.col("n_hit") / F.col("n_lines")).otherwise(0.0))


def type_errors(reports: DataFrame, path_col: str = "file", severity_col: str = "severity") -> DataFrame:
    """Errors by file of a type checker's diagnostics."""
    return reports.where(F.lower(severity_col) == "error").groupBy(F.col(path_col).alias("path")).agg(F.count("*").alias("type_errors"))


def config_keys(files: DataFrame) -> DataFrame:
    """(path, key): top-level keys of YAML, sections of TOML, headings of Markdown in files(path, value)."""
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    pattern = {"yaml": r"(?m)^([A-Za-z0-9_.-]+):", "yml": r"(?m)^([A-Za-z0-9_.-]+):", "toml": r"(?m)^\[+([^\]\n]+)\]+", "md": r"(?m)^#+[ \t]+([^\n]+?)[ \t]*$"}
    keys = F.lit(None)
    for ext, p in pattern.items():
        keys = F.when(kind == ext, F.regexp_extract_all("value", F.lit(p), F.lit(1))).otherwise(keys)
    return files.select("path", F.explode(F.array_distinct(keys)).alias("key"))


def json_keys(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, key): the path of every key and array element, at any depth: ``a.b``, ``l[0].x``, ``[1]``.

    Values are VARIANT; each round explodes what the last one found, until nothing is nested any more: a round, and a
    checkpoint, a level. Text that is no JSON, null, or repeats a key in an object has no keys. An ``id`` that is
    repeated keeps its rows apart.
    """
    spark = rows.sparkSession
    checkpoint_root(spark)
    level = rows.select(F.col(id_col).alias("id"), F.lit("").alias("prefix"), F.try_parse_json(json_col).alias("v")).where("v is not null")
    levels = []
    while True:
        flat = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        dotted = F.when(F.col("prefix") == "", F.col("key")).otherwise(F.concat_ws(".", "prefix", "key"))
        level = flat.select("id", F.when(F.col("key").isNull(), F.concat("prefix", F.lit("["), "pos", F.lit("]"))).otherwise(dotted).alias("prefix"), F.col("value").alias("v")).checkpoint()
        if level.isEmpty():
            break
        levels.append(level.select("id", F.col("prefix").alias("key")))
    return functools.reduce(DataFrame.unionByName, levels, level.select("id", F.col("prefix").alias("key")))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and time of every file below a folder, without reading contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")


def file_lines(files: DataFrame, start: int | None = None, end: int | None = None, id_col: str = "path", text_col: str = "value") -> DataFrame:
    """(id, line_no from 1, line) of texts, between two lines inclusive."""
    out = files.select(F.col(id_col), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)
    return out.where(F.col("line_no") >= (start or 1)).where(F.lit(True) if end is None else F.col("line_no") <= end)


def last_touch(commits: DataFrame, path_col: str, author_col: str, ts_col: str) -> DataFrame:
    """Per path: commits, first and last time, last author."""
    return commits.groupBy(path_col).agg(F.count("*").alias("n_commits"), F.min(ts_col).alias("first_ts"), F.max(ts_col).alias("last_ts"), F.max_by(author_col, F.struct(ts_col, author_col)).alias("last_author"))


def resolve_pdf(works: DataFrame) -> DataFrame:
    """The first PDF url of a work(id, best struct<pdf_url>, locations array<struct<pdf_url>>, unpaywall, host)."""
    listed = F.get(F.filter(F.transform("locations", lambda x: x["pdf_url"]), lambda u: u.isNotNull()), F.lit(0))
    return works.select("id", F.coalesce("best.pdf_url", listed, "unpaywall", "host").alias("pdf_url"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """TREC judgements ``qid 0 doc rel``."""
    part = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(part) >= 4).select(part[0].alias("qid"), part[2].alias("doc"), part[3].cast("int").alias("rel"))


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
