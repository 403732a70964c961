"""Writers: partitioned Parquet, JSON lines, upserts, checksums, versions."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from siltstone.operators.catalog import latest_rows
from siltstone.sources.log import Log
from siltstone.sources.tables import written

#: The checksum's polynomial: products of two residues stay below 2 ** 122.
MODULUS, BASE = (1 << 61) - 1, 1_152_921_504_606_846_883


def write_partitioned(df: DataFrame, path: str, by: list[str], *, codec: str = "zstd") -> None:
    """Overwrites only the partitions that ``df`` has; rows of one partition are brought together first."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", codec).partitionBy(*by).parquet(path)


def write_jsonl(df: DataFrame, path: str, *, files_of: int = 0, gzip: bool = False) -> None:
    """JSON lines with sorted keys; optionally so many lines a file."""
    writer = df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite")
    if files_of:
        writer = writer.option("maxRecordsPerFile", files_of)
    writer.option("compression", "gzip" if gzip else "none").text(path)


def validated(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """``df`` if its names and types are those of the schema."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    want, have = {f.name: f.dataType for f in schema}, {f.name: f.dataType for f in df.schema}
    if want != have:
        raise ValueError(f"schema differs: {sorted(set(want.items()) ^ set(have.items()), key=str)}")
    return df


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str]) -> str:
    """Old rows but those that new ones replace, written as a new version beside the old; returns its path.

    Readers of the old version aren't disturbed and a failed write leaves it whole.
    """
    out = f"{path.rstrip('/')}-{uuid.uuid4().hex[:12]}"
    latest_rows(spark.read.parquet(path), new, keys).write.parquet(out)
    return out


def with_sequence(df: DataFrame, order: list[str], start: int = 0, name: str = "id") -> DataFrame:
    """Numbers from ``start`` in an order, by the sizes of range partitions rather than in one task."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__c"))
    before = sizes.withColumn("__b", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__b")
    n = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return ranged.withColumn("__n", n).join(before, "__p").withColumn(name, F.col("__b") + F.col("__n") - 1 + start).drop("__p", "__n", "__b")


def content_checksum(rows: DataFrame, id_col: str, hash_col: str | Column, order: list[str] | None = None) -> DataFrame:
    """One row: the count and a checksum of ``id:hash`` lines in their order, by id or by the columns given.

    The checksum is the polynomial of the lines' 60-bit digests at BASE, modulo MODULUS. Range partitions have their own,
    with their lengths, and these compose: a task holds one number, the last step one row a partition. Rows that are
    equal by the order stand in the order of their digests.
    """
    h = F.col(hash_col) if isinstance(hash_col, str) else hash_col
    digest = F.conv(F.substring(F.sha2(F.concat_ws(":", F.col(id_col).cast("string"), h.cast("string")), 256), 1, 15), 16, 10).cast("long")
    keys = [f"k{i}" for i, _ in enumerate(order or [id_col])]
    lines = rows.select(*[F.col(c).alias(k) for c, k in zip(order or [id_col], keys, strict=True)], digest.alias("digest"))
    lines = lines.repartitionByRange(*keys).sortWithinPartitions(*keys, "digest")

    def fold(batches):
        n, value = 0, 0
        for pdf in batches:
            n += len(pdf)
            for d in pdf["digest"].tolist():
                value = (value * BASE + d) % MODULUS
        if n:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "n": [n], "value": [value]})

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        n, value = 0, 0
        for r in pdf.sort_values("part").itertuples():
            n, value = n + r.n, (value * pow(BASE, int(r.n), MODULUS) + r.value) % MODULUS
        return pd.DataFrame({"n": [n], "checksum": [str(value)]})

    parts = lines.select("digest").mapInPandas(fold, "part long, n long, value long")
    found = parts.groupBy().applyInPandas(compose, "n long, checksum string")
    return found.groupBy().agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.coalesce(F.max("checksum"), F.lit("0")).alias("checksum"))


def refresh_if_changed(spark: SparkSession, rows: DataFrame, path: str, checksum: str) -> bool:
    """Writes ``rows`` as a new folder unless the checksum that was last logged is the same; ``refreshed`` reads the last one.

    The rows are whole before the log names them; readers of the old ones aren't disturbed, and of two writers both are
    logged in some order.
    """
    log = Log(spark, f"{path.rstrip('/')}/log")
    known = log.entries()
    if known and known[-1]["checksum"] == checksum:
        return False
    name = uuid.uuid4().hex
    rows.write.parquet(f"{path.rstrip('/')}/{name}")
    log.append(lambda _: {"checksum": checksum, "folder": name})
    return True


def refreshed(spark: SparkSession, path: str) -> DataFrame:
    folder = Log(spark, f"{path.rstrip('/')}/log").entries()[-1]["folder"]
    return spark.read.parquet(f"{path.rstrip('/')}/{folder}")


class Versions:
    """Versions of an index as folders, with a log of which one is current."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = Log(spark, f"{self.root}/log")

    def publish(self, df: DataFrame, version: str, **attrs) -> str:
        """Writes a version whole before the log names it; of writers at the same time, the last in the log is current."""
        path = f"{self.root}/{version}"
        df.write.parquet(path)
        self.log.append(lambda _: {"version": version, "attrs": attrs})
        return path

    def current(self) -> str | None:
        log = self.log.entries()
        return log[-1]["version"] if log else None

    def rollback(self) -> str:
        """Back to the version before the current one."""

        def before(known: list[dict]) -> dict:
            if len(known) < 2:
                raise ValueError("there is no earlier version")
            return {"version": known[-2]["version"], "attrs": {"rollback": True}}

        number = self.log.append(before)
        return self.log.entries()[number]["version"]

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.current()}")


def sampled(rows: DataFrame, key_col: str, k: int) -> DataFrame:
    """The k rows whose keys have the least MD5: the same rows for the same keys, however they are partitioned. Each task
    keeps k, and these are merged."""
    return rows.orderBy(F.md5(F.col(key_col).cast("string")), key_col).limit(k)


def write_modules(nodes: DataFrame, root: str, *, path_col: str = "path", key_col: str = "node_id", symbol_col: str = "symbol", sample: int = 20) -> dict:
    """Nodes as one file of JSON lines a module, a sample of the stitched ones, and an index; returns the index.

    ``modules/module=<path>/`` holds a module's file, rows in the order of their keys; ``sample/`` the nodes with a symbol
    that ``sampled`` takes; ``index.json`` is put there last and at once, so where it is, the rest is whole. A root that has
    an index is refused. A null path is Hive's default partition. ``nodes`` is computed once: it is written as a table that the
    files, the sample and the counts are read from.
    """
    spark, root = nodes.sparkSession, root.rstrip("/")
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/index.json")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise ValueError(f"{root} has an index")
    nodes = written(nodes)
    line = F.to_json(F.struct(*sorted(nodes.columns)), {"ignoreNullFields": "false"}).alias("value")
    rows = nodes.select(F.col(path_col).alias("module"), F.col(key_col).alias("key"), line)
    rows.repartition("module").sortWithinPartitions("module", "key").drop("key").write.mode("overwrite").partitionBy("module").text(f"{root}/modules")
    stitched = nodes.where(F.col(symbol_col).isNotNull())
    sampled(stitched, key_col, sample).select(line).coalesce(1).write.mode("overwrite").text(f"{root}/sample")
    counts = nodes.agg(F.count("*").alias("nodes"), F.count_distinct(path_col).alias("modules"), F.count(symbol_col).alias("stitched")).first().asDict()
    index = {"schema": 1, **counts, "sampled": min(sample, counts["stitched"])}
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/.index-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(index, sort_keys=True).encode()))
    out.close()
    fs.rename(draft, target)
    return index


def module_report(modules: DataFrame) -> DataFrame:
    """(path, markdown) of modules(path, tags, hotspot, docstring)."""
    return modules.select("path", F.concat_ws("\n", F.concat(F.lit("# "), "path"), F.concat(F.lit("- tags: "), F.array_join("tags", ", ")), F.concat(F.lit("- hotspot: "), F.col("hotspot").cast("string")), F.lit(""), F.coalesce("docstring", F.lit(""))).alias("markdown"))
