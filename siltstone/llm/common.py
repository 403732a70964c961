"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; only where that is unset and Spark runs on this machine alone
    (tests), one of our own."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def written(df: DataFrame, label: str, under: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage is cut and every reader sees the same rows.

    The folder is the session's and goes when its JVM ends, as results may be read from it until then. What is only read
    meanwhile is put ``under`` a name, and goes with ``discard``.
    """
    spark = df.sparkSession
    path = _place(spark, *filter(None, [under]), f"{label}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    place, files = _files(spark, path)
    files.deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, under: str) -> None:
    """Deletes the tables that were written ``under`` this name, which nothing may read any more."""
    place, files = _files(spark, _place(spark, under))
    files.delete(place, True)


def _place(spark: SparkSession, *parts: str) -> str:
    return "/".join([checkpoint_root(spark).rstrip("/"), *parts])


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def apart(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` under names d0, d1 and so on, which no helper column takes, and the new name of each column."""
    names = {c: f"d{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def together(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of ``apart`` under their own names, and no others."""
    return df.select(*[F.col(d).alias(c) for c, d in names.items()])


def integral(df: DataFrame, col: str) -> bool:
    return df.schema[col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")


def numbered(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with a long ``_n`` in the order of its ids, null where they are, and the table (_id, _n) of these; for ids
    that are no numbers. ``df`` must not have these names."""
    ids = df.select(F.col(col).alias("_id")).where("_id is not null").distinct().repartitionByRange("_id").sortWithinPartitions("_id")
    ids = written(ids.withColumn("_n", F.monotonically_increasing_id()), "ids")
    return df.join(ids, F.col(col) == F.col("_id"), "left").drop("_id"), ids


def fold(id_col: str | F.Column, n: int) -> F.Column:
    """crc32 of the id's text, modulo n."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string")) % n


def components(edges: DataFrame, max_rounds: int = 60, under: str | None = None) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row (node, component) for each node with an edge to another one.

    Alternates the large-star and small-star steps, which need a number of rounds that grows with the logarithm of
    the graph. Minima are pre-aggregated and joined back, so a node with very many edges never sits in one group;
    each round's edges are written to the shared folder, which cuts their lineage, and go when the next ones are.
    Nulls and self-edges are ignored; an empty table gives an empty result. The result is written, ``under`` a name if one is given.
    """
    spark = edges.sparkSession
    e = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    e = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    folder, digest = None, None
    for _ in range(max_rounds + 1):
        last, folder = folder, f"round-{uuid.uuid4().hex}"
        seen = Observation(folder)
        e = written(e.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hash")), "edges", folder)
        now = seen.get
        if last:
            discard(spark, last)
        if now == digest or not now["n"]:
            break
        digest = now
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u")
        e = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        e = e.where("u <> v").distinct()
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = written(stars.unionByName(roots), "components", under)
    discard(spark, folder)
    return out
