"""Operator 2: mixing sources to target weights by weighted fair queueing.

Every source queues its documents in a shuffled order, as often as its target asks (at most ``most`` times). A document's
virtual finish time is the source's cumulative words through that document, divided by the source's target. One global order of
all finish times is the training order; it is cut where its running total of words reaches the budget, and the document a source
is serving then is taken in part. So each source ends within one word of its target.

Skew: prefix sums never need a whole source in one task. A source is split into ranges of its shuffle key, the global order into
equal ranges of virtual time (virtual time passes evenly, so these hold about equal words), and only range totals are
accumulated, in blocks of a thousand ranges and then over the blocks: what meets in one task is one row per source, a thousand ranges, or
one row per block. Slices that the mix leaves out take no part in the global order (null finish and place).

Defined results: null texts have size 0 and are never taken; null doc_ids queue like others; a null source is a source, ranked last; ties in the shuffle key break by
doc_id and size; repeated rows queue one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, Kept, table

WEIGHTS = (5, 2, 1)
BUDGET, MOST = 1.5, 2
ROWS_PER_RANGE, BLOCK = 5_000, 1_000


def running(totals: DataFrame, keys: list[str], order: str, n: str) -> DataFrame:
    """Adds base, the sum of ``n`` over the rows before in ``order`` (a whole number, one row each) of the same keys: inside blocks, then over blocks."""
    blocks = totals.withColumn("_block", F.floor(F.col(order) / BLOCK))
    inside = W.partitionBy(*keys, "_block").orderBy(order)
    per = blocks.groupBy(*keys, "_block").agg(F.sum(n).alias("_n"))
    before = per.select(*keys, "_block", (F.sum("_n").over(W.partitionBy(*keys).orderBy("_block")) - F.col("_n")).alias("_before"))
    return blocks.withColumn("base", F.sum(n).over(inside) - F.col(n)).join(before, [*keys, "_block"]).withColumn("base", F.col("base") + F.col("_before")).drop("_block", "_before")


def word_count(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE))).cast("long")


def shuffle_key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", "text", "source")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """From (source, size): sid by code point order, source_size, n_docs and target of each source, and the whole budget.

    Sources are filled together in proportion to weight; one leaves when it reaches ``most`` times its size. In order of that level,
    the closed form of each source's fill level needs running sums only. One row per source meets in one task.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    everything = W.partitionBy()
    ranked = (
        total.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("double"))
        .withColumn("cap", (F.col("source_size") * most).cast("double"))
        .withColumn("level", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(budget))
    )
    upto = W.orderBy("level", "sid").rowsBetween(W.unboundedPreceding, -1)
    filled = (
        ranked.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
        .withColumn("fill", F.max(F.col("left") / F.col("open")).over(everything))  # it rises to the true level, then falls
    )
    return filled.select("source", "sid", "source_size", "n_docs", "budget",
                         F.least(F.col("cap"), F.col("fill") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, kept: Kept, seed: int = 1, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """One row per slice of a document in the mix (epoch 0 always, later epochs if the target reaches them), with ``words`` taken and
    ``at``, its place in the global order counted in words. Columns doc_id, source, key, row, epoch, size, source_size, target."""
    sizes = kept.put(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), shuffle_key(seed).alias("key")))
    targets = source_targets(sizes, weights, budget, most)
    rows = sizes.withColumnRenamed("source", "s").join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    ranges = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / ROWS_PER_RANGE))
    rows = rows.withColumn("range", F.pmod(F.shiftrightunsigned("key", 32), F.lit(1 << 32)).cast("double") / float(1 << 32))
    rows = rows.withColumn("range", F.floor(F.col("range") * ranges))
    starts = running(rows.groupBy("sid", "range").agg(F.sum("size").alias("n")), ["sid"], "range", "n").drop("n")
    inside = W.partitionBy("sid", "range").orderBy("key", "doc_id", "size")
    queued = (
        rows.join(starts, ["sid", "range"])
        .withColumn("row", F.row_number().over(inside))
        .withColumn("start", F.col("base") + F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("quota", F.floor("target"))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.least(
            F.lit(most - 1), F.floor((F.col("quota") - F.col("start") - 1) / F.greatest(F.col("source_size"), F.lit(1))))).cast("int"))))
        .withColumn("start", F.col("start") + F.col("epoch") * F.col("source_size"))
        .withColumn("finish", F.least(F.lit(1.0), (F.col("start") + F.col("size")) / F.greatest(F.col("target"), F.lit(1.0))))
        .withColumn("words", F.greatest(F.lit(0), F.least("size", F.col("quota") - F.col("start"))).cast("long"))
    )
    slices = kept.put(queued.select("doc_id", "source", "sid", "range", "row", "key", "epoch", "size", "source_size", "target", "budget", "finish", "words"))
    served = slices.where("words > 0")
    n = max(1, -(-served.count() // ROWS_PER_RANGE))
    served = served.withColumn("time", F.floor(F.col("finish") * n))
    bases = running(served.groupBy("time").agg(F.sum("words").alias("n")).withColumn("all", F.lit(0)), ["all"], "time", "n").drop("n", "all")
    order = W.partitionBy("time").orderBy("finish", "sid", "key", "doc_id", "row", "epoch").rowsBetween(W.unboundedPreceding, 0)
    placed = (
        served.join(bases, "time")
        .withColumn("at", F.col("base") + F.sum("words").over(order) - F.col("words"))
        .withColumn("words", F.greatest(F.lit(0), F.least("words", F.floor("budget") - F.col("at"))))
        .drop("time", "base")
    )
    rest = slices.where("words <= 0").withColumn("finish", F.lit(None).cast("double")).withColumn("at", F.lit(None).cast("long"))
    return placed.withColumn("at", F.col("at").cast("long")).unionByName(rest).drop("budget")


def op2_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = Kept(spark, "mix")
    slices = mix(table(spark, sf_dir, "documents"), kept)
    return slices.groupBy("doc_id", "sid", "range", "row", "source", "size", "source_size", "target").agg(
        F.sum("words").alias("taken"), F.min("at").alias("first_at"), F.round(F.min("finish"), 9).alias("finish"),
    ).select("doc_id", "size", "source_size", "target", "taken", "source", "first_at", "finish")


def first_words(text: Column, n: Column) -> Column:
    """The text through its n-th word."""
    return F.regexp_replace(F.array_join(F.slice(F.split(F.ltrim(text), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"), F.lit(1), n.cast("int")), ""), r"[\x20\x09-\x0D]+$", "")


def mix_documents(spark: SparkSession, docs: DataFrame, seed: int = 1) -> DataFrame:
    """The mixed corpus: each document as often as it was taken, in the columns of ``docs``; one taken in part is cut at that word."""
    takes = mix(docs, Kept(spark, "mix"), seed).where("words > 0")
    plan = takes.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("range", "row", "epoch", "words", "size"))).alias("takes"))
    plan = plan.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("takes").alias("_takes"))
    keyed = docs.withColumn("_k", shuffle_key(seed))
    joined = keyed.join(plan, (F.col("_k") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    # Rows alike in doc_id and key share their takes: the n-th of them serves the n-th row's.
    each = joined.withColumn("_n", F.row_number().over(W.partitionBy("_k", "doc_id").orderBy(F.lit(0))))
    rows = F.array_distinct(F.transform("_takes", lambda t: F.struct(t["range"], t["row"])))
    mine = F.filter("_takes", lambda t: F.struct(t["range"], t["row"]) == F.try_element_at(rows, F.col("_n")))
    cut = F.when(F.col("_t.words") < F.col("_t.size"), first_words(F.col("text"), F.col("_t.words"))).otherwise(F.col("text"))
    out = each.withColumn("_t", F.explode(mine)).withColumn("text", cut)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_t.words") < F.col("_t.size"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
