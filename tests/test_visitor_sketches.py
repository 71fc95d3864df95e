"""Sketches of visitors beside exact counts."""

from pyspark.sql import functions as F

from ferrule.operators import analytics


def test_estimates_are_within_three_percent(spark):
    day = F.pmod(F.xxhash64("id"), F.lit(10)).cast("int")
    visits = spark.range(200_000).select(F.concat(F.lit("v"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(60_000)).cast("string")).alias("visitor_id"), F.expr("timestamp'2024-03-01 20:00:00'").alias("ts"), day.alias("d"))
    visits = visits.withColumn("ts", F.col("ts") + F.make_interval(days=F.col("d"))).cache()
    exact = {str(r.date): r.n for r in visits.groupBy(F.to_date("ts").alias("date")).agg(F.count_distinct("visitor_id").alias("n")).collect()}
    exact["7d"] = visits.where("d >= 3").agg(F.count_distinct("visitor_id")).first()[0]
    sketches = analytics.visitor_sketches(visits)
    for got in (analytics.visitor_estimates(sketches), analytics.visitor_summary_approx(visits)):
        rows = {r.period: r.visitors for r in got.collect()}
        assert set(rows) == {"7d", *(f"2024-03-{k:02}" for k in range(4, 11))}
        assert all(abs(n - exact[k]) <= 0.03 * exact[k] for k, n in rows.items())
    assert analytics.visitor_summary_approx(visits.limit(0)).count() == 0
