"""Helpers that several corpus operators share: shared storage, splits by id, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the six characters that separate words (`[^\x20\x09-\x0D]+` is a word).
SPACES = " \t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary one is made, but only if the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not found.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = found.get() if found.isDefined() else tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_remainder(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % parts).cast("int")


def hash_share(c: Column, seed: int = 0) -> Column:
    """A number in [0, 1) drawn from the value by hashing."""
    return F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def bounded_sample(df: DataFrame, by: Column, group: str, size: int, seed: int = 0) -> DataFrame:
    """About `size` rows of each group, those with the smallest hash of `by`; never more than twice as many in all.

    The groups' counts, a written table, fix a hash limit for each; the optimizer sees its size and chooses the join.
    No task ever sees a whole group. The rows drawn meet in one task: give it rows of bounded width.
    """
    counts = written(df.groupBy(F.col(group).alias("_group")).agg((1.25 * size / F.count("*")).alias("_limit")), "limits")
    drawn = df.withColumn("_share", hash_share(by, seed)).join(counts, F.col(group).eqNullSafe(F.col("_group"))).filter("_share < _limit")
    return drawn.orderBy("_share").limit(2 * size * max(1, counts.count())).drop("_share", "_group", "_limit")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): component is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, shortens the resulting trees and contracts the edges, so the
    edges shrink geometrically; stars take one round. Everything stays distributed, hubs included: neighbours are
    reduced by partial minimums before the shuffle.
    """
    e = edges.select("a", "b").filter("a <> b").distinct().checkpoint()
    label = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p")).checkpoint()
        while True:
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            jumped = parent.join(up, "p").select("a", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")).checkpoint()
            parent = jumped.select("a", "p")
            if jumped.filter("moved").isEmpty():
                break
        if label is None:
            label = parent.select(F.col("a").alias("node"), F.col("p").alias("component"))
        else:
            label = label.join(parent.withColumnRenamed("a", "component"), "component", "left").select("node", F.coalesce("p", "component").alias("component")).checkpoint()
        e = (
            e.join(parent.withColumnRenamed("p", "pa"), "a")
            .join(parent.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b")
            .select(F.col("pa").alias("a"), F.col("pb").alias("b"))
            .filter("a <> b")
            .distinct()
            .checkpoint()
        )
    if label is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return label
