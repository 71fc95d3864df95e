"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.sources.shared import shared_dir

#: White space of every word rule: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's setting that removes a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Kept:
    """Written intermediate tables of one run. Each is Parquet in the shared folder, so a lost executor costs no recomputation.

    ``tidy`` runs let Spark remove a table's shuffle files once it is written, not when the driver happens to collect its garbage.
    """

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False):
        self.spark, self.root = spark, f"{shared_dir(spark)}/ferrule-{name}-{uuid.uuid4().hex}"
        self.count, self.tidy = 0, tidy

    def put(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true" if self.tidy else before)
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        got = self.spark.read.schema(df.schema).parquet(path)
        got._kept_path = path
        return got

    def remove(self, path: str) -> None:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    def drop(self, df: DataFrame) -> None:
        """Remove a table that no later plan reads."""
        self.remove(df._kept_path)

    def only(self, df: DataFrame) -> DataFrame:
        """Remove all tables of the run but one: no later plan reads another."""
        for k in range(1, self.count + 1):
            if (path := f"{self.root}/{k}") != df._kept_path:
                self.remove(path)
        return df


def words(text: Column) -> Column:
    """Words of a text, in order; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != F.lit(""))


#: Keys that a join salts, and the rows that a key has at least then.
HOT_KEYS, HOT_ROWS = 20_000, 500


def hot_bound(rows: int) -> int:
    """Rows over which a key counts as hot; at most ``HOT_KEYS`` keys have more, however many rows there are."""
    return max(HOT_ROWS, -(-rows // HOT_KEYS))


def join_unique(rows: DataFrame, unique: DataFrame, key: str, weight: str | None = None, bound: int | None = None) -> DataFrame:
    """Inner join of rows with a table of one row per key, without a hot key in one task.

    ``weight`` names a column of ``unique`` that says how many rows a key has at most (else rows are counted). Keys over the bound are
    broadcast, ``HOT_KEYS`` at most, and their rows spread over as many parts as the bound asks; the rest are joined by key alone.
    """
    counts = unique.select(key, F.col(weight).alias("_w")) if weight else rows.groupBy(key).agg(F.count("*").alias("_w"))
    if bound is None:
        total, most = counts.agg(F.sum("_w"), F.max("_w")).first()
        bound = hot_bound(total or 0)
        if (most or 0) <= bound:
            return rows.join(unique, key)
    hot = counts.where(F.col("_w") > bound).select(F.col(key).alias("_hot"), F.ceil(F.col("_w") / bound).cast("int").alias("_parts"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    salt = F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*rows.columns), F.col("_parts")).cast("int"))
    if weight:
        parts = F.greatest(F.lit(1), F.ceil(F.col(weight) / bound)).cast("int")
        spread = unique.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    else:
        spread = unique.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_hot", "_parts")
    return marked.withColumn("_salt", salt).drop("_hot", "_parts").join(spread, [key, "_salt"]).drop("_salt")


def components(kept: Kept, edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) long edges with a != b: one row (node, component) per node, component the smallest node.

    Alternates large-star and small-star steps until no edge changes. Each step regroups edges by a node and gives a row
    per neighbour, so rows stay within the number of edges, and the number of steps is logarithmic in practice. Nodes of many edges are salted.
    """
    def star(e: DataFrame, large: bool, bound: int) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).withColumn("m", F.least("u", "m"))
        joined = join_unique(both, least, "u", "c", bound)
        if large:
            out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
                least.where("u != m").select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a != b") if large else out.where("a != b").distinct()

    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    current = kept.put(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    before = mark(current)
    while True:
        bound = hot_bound(2 * before[0])
        after = kept.put(star(star(current, True, bound), False, bound))
        now = mark(after)
        kept.drop(current)
        if now == before:
            break
        current, before = after, now
    return after.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").unionByName(
        after.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
