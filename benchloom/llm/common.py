"""Helpers shared by the operators: stored tables, input size, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from benchloom.session import new_path, ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str = "llm") -> DataFrame:
    """``df`` written once to the shared folder and read back; a lost executor re-reads it.

    The shuffle files behind it are not needed any more, so Spark is told to delete them with the write.
    """
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str = "llm") -> tuple[DataFrame, str]:
    """As ``stored``, with the folder, for a table that ``discard`` removes once nothing reads it any more."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a stored table of this module that the next one replaces."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def scaled_parts(total: int, per_part: int, least: int = 1) -> int:
    """So many parts that none holds much more than ``per_part``."""
    return max(least, -(-int(total) // per_part))


def salted(key: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")


SALTS = 16


def _toward_minimum(edges: DataFrame) -> DataFrame:
    """The smallest neighbour (or the node itself) of each node, copied over the salts so that a hub's
    edges meet it in many tasks."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return least.select("u", "m", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (``u``, ``v``, both long) as ``node``, ``component``
    (the smallest node reachable).

    Large-star and small-star rounds over stored edges until nothing changes.  Every node of an edge comes
    out once; self loops are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    now = stored(edges.where("u <> v").select("u", "v").distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.where("v > u")
            .withColumn("salt", salted(F.col("v"), SALTS))
            .join(_toward_minimum(both), ["u", "salt"])
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        least = _toward_minimum(large)
        small = (
            large.withColumn("salt", salted(F.col("v"), SALTS))
            .join(least, ["u", "salt"])
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        now = stored(small, "edges")
        # Two numbers tell whether the edges are the same as before.
        seen = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
