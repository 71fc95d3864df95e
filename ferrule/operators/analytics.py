"""Aggregations over jobs, usage, visits, traffic, subscriptions and articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ferrule.operators.text import cost
from ferrule.plans.registry import operator

DAY_SECONDS = 86_400


def latest(df: DataFrame, column: str):
    """The largest timestamp of a column: the default ``as_of``. One row reaches the driver."""
    return df.agg(F.max(column)).first()[0]


def since(column: str, as_of, days: float) -> Column:
    """Inside the last days before as_of, the lower edge included; 0 days mean all time."""
    return F.col(column) >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(secs=F.lit(days * DAY_SECONDS)) if days else F.lit(True)


def n_if(condition: Column) -> Column:
    return F.count_if(condition)


@operator("cost_summary", ["jobs"], """SELECT type, count(*) AS jobs, CAST(coalesce(sum(page_count), 0) AS BIGINT) AS pages, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens, CAST(sum(coalesce(output_tokens, 0)) AS BIGINT) AS output_tokens,
    round(sum(coalesce(input_tokens, 0)) / 1000000.0 * 3 + sum(coalesce(output_tokens, 0)) / 1000000.0 * 15, 4) AS cost_usd,
    CASE WHEN coalesce(sum(page_count), 0) > 0 THEN round((sum(coalesce(input_tokens, 0)) / 1000000.0 * 3 + sum(coalesce(output_tokens, 0)) / 1000000.0 * 15) / sum(page_count), 5) END AS cost_per_page
    FROM jobs WHERE status = 'completed' AND (input_tokens IS NOT NULL OR output_tokens IS NOT NULL) GROUP BY GROUPING SETS ((), (type))""")
def cost_summary(jobs: DataFrame, since_days: float = 0, as_of=None) -> DataFrame:
    """Totals and by type over completed jobs that have a token count. One pass over grouping sets; null type is the total."""
    done = jobs.where((F.col("status") == "completed") & F.coalesce("input_tokens", "output_tokens").isNotNull())
    if since_days:
        done = done.where(since("created_at", as_of or latest(jobs, "created_at"), since_days))
    tokens_in, tokens_out = F.sum(F.coalesce("input_tokens", F.lit(0))), F.sum(F.coalesce("output_tokens", F.lit(0)))
    out = done.groupingSets([[], ["type"]], "type").agg(F.count("*").alias("jobs"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("pages"), tokens_in.alias("input_tokens"), tokens_out.alias("output_tokens"))
    usd = cost(F.col("input_tokens"), F.col("output_tokens"))
    return out.withColumn("cost_usd", F.round(usd, 4)).withColumn("cost_per_page", F.when(F.col("pages") > 0, F.round(usd / F.col("pages"), 5)))


@operator("job_health", ["jobs"], """SELECT w.name AS "window", count(*) FILTER (WHERE ok) AS total, count(*) FILTER (WHERE ok AND status = 'failed') AS failed, count(*) FILTER (WHERE ok AND status = 'completed') AS completed,
    CASE WHEN count(*) FILTER (WHERE ok) > 0 THEN round(count(*) FILTER (WHERE ok AND status = 'failed') * 1.0 / count(*) FILTER (WHERE ok), 4) ELSE 0.0 END AS fail_rate
    FROM (SELECT status, created_at, d, name, created_at >= (SELECT max(created_at) FROM jobs) - INTERVAL 1 DAY * d AS ok FROM jobs CROSS JOIN (SELECT 1 AS d, '24h' AS name UNION ALL SELECT 7, '7d') k) w GROUP BY w.name""")
def job_health(jobs: DataFrame, as_of=None) -> DataFrame:
    as_of = as_of or latest(jobs, "created_at")
    marks = {"24h": since("created_at", as_of, 1), "7d": since("created_at", as_of, 7)}
    counts = jobs.agg(*[n_if(ok & state).alias(f"{w}{k}") for w, ok in marks.items() for k, state in enumerate((F.lit(True), F.col("status") == "failed", F.col("status") == "completed"))])
    rows = F.array(*[F.struct(F.lit(w).alias("window"), *[F.col(f"{w}{k}").alias(n) for k, n in enumerate(("total", "failed", "completed"))]) for w in marks])
    return counts.select(F.inline(rows)).withColumn("fail_rate", F.when(F.col("total") > 0, F.round(F.col("failed") / F.col("total"), 4)).otherwise(0.0))


@operator("daily_jobs", ["jobs"], """SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS date, count(*) AS jobs, CAST(sum(coalesce(page_count, 0)) AS BIGINT) AS pages, count(*) FILTER (WHERE status = 'failed') AS failed
    FROM jobs WHERE created_at >= (SELECT max(created_at) FROM jobs) - INTERVAL 30 DAY GROUP BY ALL""")
def daily_jobs(jobs: DataFrame, days: int = 30, as_of=None) -> DataFrame:
    recent = jobs.where(since("created_at", as_of or latest(jobs, "created_at"), days))
    return recent.groupBy(F.to_date("created_at").cast("string").alias("date")).agg(
        F.count("*").alias("jobs"), F.sum(F.coalesce("page_count", F.lit(0))).alias("pages"), n_if(F.col("status") == "failed").alias("failed")).orderBy("date")


@operator("checker_summary", ["checker_usage"], """SELECT count(*) FILTER (WHERE d <= 90) AS last90, count(*) FILTER (WHERE d <= 30) AS last30, count(*) FILTER (WHERE d <= 90 AND status = 'completed') AS completed, count(*) FILTER (WHERE d <= 90 AND status = 'failed') AS failed
    FROM (SELECT status, date_diff('second', created_at, (SELECT max(created_at) FROM checker_usage)) / 86400.0 AS d FROM checker_usage)""")
def checker_summary(usage: DataFrame, as_of=None) -> DataFrame:
    as_of = as_of or latest(usage, "created_at")
    in90 = since("created_at", as_of, 90)
    return usage.agg(n_if(in90).alias("last90"), n_if(since("created_at", as_of, 30)).alias("last30"),
                     n_if(in90 & (F.col("status") == "completed")).alias("completed"), n_if(in90 & (F.col("status") == "failed")).alias("failed"))


@operator("visitor_summary", ["visits_raw"], """WITH v AS (SELECT visitor_id AS h, ts, CAST(timezone('America/Los_Angeles', timezone('UTC', ts)) AS DATE) AS d, (SELECT max(ts) FROM visits_raw) AS now FROM visits_raw)
    SELECT 'today' AS period, count(DISTINCT h) FILTER (WHERE d = CAST(timezone('America/Los_Angeles', timezone('UTC', now)) AS DATE)) AS visitors FROM v
    UNION ALL SELECT 'last_hour', count(DISTINCT h) FILTER (WHERE ts >= now - INTERVAL 1 HOUR) FROM v UNION ALL SELECT '7d', count(DISTINCT h) FILTER (WHERE ts >= now - INTERVAL 7 DAY) FROM v
    UNION ALL SELECT CAST(d AS VARCHAR), count(DISTINCT h) FROM v WHERE ts >= now - INTERVAL 7 DAY GROUP BY d""")
def visitor_summary(visits: DataFrame, as_of=None) -> DataFrame:
    """Distinct visitors today (Los Angeles), in the last hour, in 7 days, and per day of those."""
    as_of = as_of or latest(visits, "ts")
    v = visits.select(F.col("visitor_id").alias("h"), "ts", F.to_date(F.from_utc_timestamp("ts", "America/Los_Angeles")).alias("d"))
    today = F.to_date(F.from_utc_timestamp(F.lit(as_of).cast("timestamp"), "America/Los_Angeles"))
    periods = F.array_compact(F.array(F.when(F.col("d") == today, "today"), F.when(since("ts", as_of, 1 / 24), "last_hour"), F.when(since("ts", as_of, 7), "7d"), F.when(since("ts", as_of, 7), F.col("d").cast("string"))))
    counted = v.select("h", F.explode(periods).alias("period")).groupBy("period").agg(F.count_distinct("h").alias("visitors"))
    base = visits.sparkSession.createDataFrame([("today",), ("last_hour",), ("7d",)], "period string")
    return counted.join(F.broadcast(base), "period", "full").select("period", F.coalesce("visitors", F.lit(0)).alias("visitors"))


def visitor_sketches(visits: DataFrame, lg_k: int = 14) -> DataFrame:
    """date (Los Angeles) and a mergeable sketch of its visitors, 2^lg_k registers at most: kept a day, it need not be counted again."""
    day = F.to_date(F.from_utc_timestamp("ts", "America/Los_Angeles"))
    return visits.groupBy(day.alias("date")).agg(F.hll_sketch_agg("visitor_id", lg_k).alias("sketch"))


@operator("visitor_summary_approx", ["visits_raw"])
def visitor_summary_approx(visits: DataFrame, days: int = 7, as_of=None) -> DataFrame:
    """About how many distinct visitors each of the last days and all of them together had, from one sketch a day."""
    return visitor_estimates(visitor_sketches(visits), days, as_of)


def visitor_estimates(sketches: DataFrame, days: int = 7, as_of=None) -> DataFrame:
    """period (a date, or the number of days to ``as_of``, by default the newest) and visitors, by merging the days' sketches."""
    newest = F.lit(as_of).cast("date") if as_of else F.lit(sketches.agg(F.max("date")).first()[0]).cast("date")
    recent = sketches.where((F.col("date") <= newest) & (F.col("date") > F.date_sub(newest, days)))
    each = recent.select(F.explode(F.array(F.col("date").cast("string"), F.lit(f"{days}d"))).alias("period"), "sketch")
    return each.groupBy("period").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("visitors"))


@operator("subscriber_summary", ["users"], """SELECT count(*) FILTER (WHERE subscribed AND plan = 'individual') AS individual, count(*) FILTER (WHERE plan = 'team' AND org_id IS NOT NULL AND NOT (subscribed AND plan = 'individual')) AS team_seats,
    count(DISTINCT CASE WHEN plan = 'team' THEN org_id END) AS team_orgs, count(*) AS users, count(*) FILTER (WHERE created_at >= (SELECT max(created_at) FROM users) - INTERVAL 7 DAY) AS signups_7d,
    count(*) FILTER (WHERE created_at >= (SELECT max(created_at) FROM users) - INTERVAL 30 DAY) AS signups_30d,
    round(count(*) FILTER (WHERE subscribed AND plan = 'individual') * 19.0 + count(*) FILTER (WHERE plan = 'team' AND org_id IS NOT NULL) * 20.75, 2) AS est_mrr FROM users""")
def subscriber_summary(users: DataFrame, as_of=None, individual_price: float = 19.0, seat_price: float = 20.75) -> DataFrame:
    as_of = as_of or latest(users, "created_at")
    single = F.col("subscribed") & (F.col("plan") == "individual")
    seat = (F.col("plan") == "team") & F.col("org_id").isNotNull()
    return users.agg(n_if(single).alias("individual"), n_if(seat).alias("team_seats"), F.count_distinct(F.when(F.col("plan") == "team", F.col("org_id"))).alias("team_orgs"), F.count("*").alias("users"),
                     n_if(since("created_at", as_of, 7)).alias("signups_7d"), n_if(since("created_at", as_of, 30)).alias("signups_30d")).withColumn(
        "est_mrr", F.round(F.col("individual") * individual_price + F.col("team_seats") * seat_price, 2))


def monthly_cents() -> Column:
    """A recurring price per month: a year has 12 months, a month 4.345 weeks or 30.44 days."""
    per = F.col("unit_amount").cast("double")
    return F.when(F.col("recur") == "month", per).when(F.col("recur") == "year", per / 12).when(F.col("recur") == "week", per * 4.345).when(F.col("recur") == "day", per * 30.44).otherwise(0.0) / F.col("interval_count") * F.coalesce("quantity", F.lit(1))


@operator("mrr", ["subscriptions"], """SELECT CASE WHEN count(*) > 0 THEN round(sum(CASE recur WHEN 'month' THEN unit_amount * 1.0 WHEN 'year' THEN unit_amount / 12.0 WHEN 'week' THEN unit_amount * 4.345 ELSE unit_amount * 30.44 END / interval_count * quantity) / 100, 2) ELSE 0 END AS mrr,
    CASE WHEN count(*) > 0 THEN 'subscriptions' ELSE 'estimate' END AS source, count(*) AS active_subscriptions FROM subscriptions WHERE status IN ('active', 'past_due')""")
def mrr(subscriptions: DataFrame, estimate: float = 0.0) -> DataFrame:
    live = subscriptions.where(F.col("status").isin("active", "past_due"))
    out = live.agg(F.sum(monthly_cents()).alias("cents"), F.count("*").alias("active_subscriptions"))
    return out.select(F.coalesce(F.round(F.col("cents") / 100, 2), F.lit(estimate)).alias("mrr"), F.when(F.col("cents").isNull(), "estimate").otherwise("subscriptions").alias("source"), "active_subscriptions")


@operator("traffic_daily", ["pageviews"], """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(DISTINCT user_id) AS visitors, count(*) AS views FROM pageviews WHERE ts >= (SELECT max(ts) FROM pageviews) - INTERVAL 7 DAY GROUP BY ALL
    UNION ALL SELECT 'total', count(DISTINCT user_id), count(*) FROM pageviews WHERE ts >= (SELECT max(ts) FROM pageviews) - INTERVAL 7 DAY""")
def traffic_daily(pageviews: DataFrame, as_of=None) -> DataFrame:
    recent = pageviews.where(since("ts", as_of or latest(pageviews, "ts"), 7)).withColumn("day", F.to_date("ts").cast("string"))
    return recent.groupingSets([[], ["day"]], "day").agg(F.coalesce("day", F.lit("total")).alias("date"), F.count_distinct("user_id").alias("visitors"), F.count("*").alias("views")).select("date", "visitors", "views")


@operator("traffic_quality", ["pageviews"], """SELECT views_per_user, not_set_share, views_per_user >= 8 OR not_set_share >= 0.5 AS contaminated, CASE WHEN views_per_user >= 8 OR not_set_share >= 0.5 THEN 'testing-contaminated' END AS note
    FROM (SELECT round(count(*) * 1.0 / count(DISTINCT user_id), 4) AS views_per_user, round(count(*) FILTER (WHERE source_medium = '(not set)') * 1.0 / count(*), 4) AS not_set_share FROM pageviews WHERE CAST(ts AS DATE) = (SELECT CAST(max(ts) AS DATE) FROM pageviews))""")
def traffic_quality(pageviews: DataFrame, as_of=None) -> DataFrame:
    """Whether the day's traffic looks like testing: 8 views a user or half of the views without a source."""
    day = F.to_date(F.lit(as_of or latest(pageviews, "ts")).cast("timestamp"))
    out = pageviews.where(F.to_date("ts") == day).agg(F.count("*").alias("views"), F.count_distinct("user_id").alias("users"), n_if(F.col("source_medium") == "(not set)").alias("unset"))
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4)).otherwise(0.0)
    out = out.select(share("views", "users").alias("views_per_user"), share("unset", "views").alias("not_set_share"))
    return out.withColumn("contaminated", (F.col("views_per_user") >= 8) | (F.col("not_set_share") >= 0.5)).withColumn("note", F.when(F.col("contaminated"), "testing-contaminated"))


@operator("traffic_topk", ["pageviews"], """WITH a AS (SELECT max(ts) AS now FROM pageviews), p AS (SELECT 'today' AS period, v.* FROM pageviews v, a WHERE CAST(ts AS DATE) = CAST(now AS DATE) UNION ALL SELECT '7d', v.* FROM pageviews v, a WHERE CAST(ts AS DATE) BETWEEN CAST(now AS DATE) - 6 AND CAST(now AS DATE)),
    d AS (SELECT period, 'path' AS dim, path AS value, 6 AS k FROM p UNION ALL SELECT period, 'country', country, 6 FROM p UNION ALL SELECT period, 'source', source_medium, 8 FROM p)
    SELECT period, dim, value, n AS count FROM (SELECT period, dim, value, k, count(*) AS n, row_number() OVER (PARTITION BY period, dim ORDER BY count(*) DESC, value) AS r FROM d GROUP BY period, dim, value, k) WHERE r <= k""")
def traffic_topk(pageviews: DataFrame, as_of=None, tops=(("path", "path", 6), ("country", "country", 6), ("source", "source_medium", 8))) -> DataFrame:
    """The commonest values of each dimension today and in seven days, today included; equal counts by value. Views are counted once for all dimensions."""
    day = F.to_date(F.lit(as_of or latest(pageviews, "ts")).cast("timestamp"))
    recent = pageviews.where(F.to_date("ts").between(F.date_sub(day, 6), day))
    periods = F.when(F.to_date("ts") == day, F.array(F.lit("today"), F.lit("7d"))).otherwise(F.array(F.lit("7d")))
    each = recent.select(periods.alias("p"), F.explode(F.array(*[F.struct(F.lit(dim).alias("dim"), F.col(c).alias("value"), F.lit(k).alias("k")) for dim, c, k in tops])).alias("d"))
    counted = each.select(F.explode("p").alias("period"), "d.*").groupBy("period", "dim", "value", "k").count()
    rank = F.row_number().over(W.partitionBy("period", "dim").orderBy(F.desc("count"), "value"))
    return counted.withColumn("r", rank).where("r <= k").select("period", "dim", "value", "count")


@operator("checker_recent", ["checker_usage"], "SELECT id, file_name, file_type, status, score, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created FROM checker_usage ORDER BY created_at DESC, id DESC LIMIT 20")
def checker_recent(usage: DataFrame, n: int = 20) -> DataFrame:
    """The feature is the newest n checks; equal times by id."""
    newest = usage.orderBy(F.desc("created_at"), F.desc("id")).limit(n)
    return newest.select("id", "file_name", "file_type", "status", "score", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


@operator("recent_jobs", ["jobs"], "SELECT id, type, status, user_id, page_count, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created FROM jobs ORDER BY created_at DESC, id DESC LIMIT 50")
def recent_jobs(jobs: DataFrame, n: int = 50, user_id: str | None = None, failed_only: bool = False) -> DataFrame:
    """The feature is the newest n; equal times by id."""
    picked = jobs if user_id is None else jobs.where(F.col("user_id") == user_id)
    picked = picked.where("status = 'failed'") if failed_only else picked
    return picked.orderBy(F.desc("created_at"), F.desc("id")).limit(n).select("id", "type", "status", "user_id", "page_count", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


@operator("retention_purge", ["checker_usage"], "SELECT id, status, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created FROM checker_usage WHERE created_at >= (SELECT max(created_at) FROM checker_usage) - INTERVAL 90 DAY")
def retention_purge(events: DataFrame, days: int = 90, as_of=None) -> DataFrame:
    return events.where(since("created_at", as_of or latest(events, "created_at"), days)).select("id", "status", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


@operator("duplicate_titles", ["slides"], "SELECT doc_id, lower(title) AS title, count(*) AS n FROM slides WHERE title <> '' GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_titles(slides: DataFrame) -> DataFrame:
    return slides.where("title != ''").groupBy("doc_id", F.lower("title").alias("title")).agg(F.count("*").alias("n")).where("n > 1")


@operator("kb_sections", ["kb_articles"], "SELECT section, section_name, string_agg(id, ',' ORDER BY order_num, id) AS articles FROM kb_articles GROUP BY 1, 2")
def kb_sections(articles: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("order_num", "id")))
    return articles.groupBy("section", "section_name").agg(F.array_join(F.transform(ordered, lambda a: a["id"]), ",").alias("articles"))


@operator("low_text_pages", ["page_texts"], "SELECT doc_id, page, text_len, text_len < 50 AS needs_ocr, round(avg(CASE WHEN text_len < 50 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY doc_id), 4) AS doc_share FROM page_texts")
def low_text_pages(page_texts: DataFrame) -> DataFrame:
    from pyspark.sql import Window as W

    low = F.col("text_len") < 50
    return page_texts.select("doc_id", "page", "text_len", low.alias("needs_ocr"), F.round(F.avg(low.cast("double")).over(W.partitionBy("doc_id")), 4).alias("doc_share"))


@operator("ocr_gate", ["page_texts"], """SELECT doc_id, pages, ocr_ratio, CASE WHEN pages > 50 THEN 'page_cap' WHEN ocr_ratio >= 0.5 AND chars < 200 * pages THEN 'wrong_tool' ELSE 'ok' END AS verdict
    FROM (SELECT doc_id, count(*) AS pages, round(avg(CASE WHEN text_len < 50 THEN 1.0 ELSE 0.0 END), 4) AS ocr_ratio, sum(text_len) AS chars FROM page_texts GROUP BY doc_id)""")
def ocr_gate(page_texts: DataFrame, cap: int = 50) -> DataFrame:
    out = page_texts.groupBy("doc_id").agg(F.count("*").alias("pages"), F.round(F.avg((F.col("text_len") < 50).cast("double")), 4).alias("ocr_ratio"), F.sum("text_len").alias("chars"))
    verdict = F.when(F.col("pages") > cap, "page_cap").when((F.col("ocr_ratio") >= 0.5) & (F.col("chars") < 200 * F.col("pages")), "wrong_tool").otherwise("ok")
    return out.withColumn("verdict", verdict).drop("chars")


@operator("route_documents", ["page_signals"], """SELECT doc_id, use_vision, reason, CASE WHEN mode = 'docx' AND ext <> 'docx' THEN 'blocked' WHEN mode = 'pdf' AND ext <> 'pdf' THEN 'blocked' ELSE 'ok' END AS verdict FROM (
    SELECT doc_id, ext, mode, CASE WHEN ext = 'docx' THEN 'docx' WHEN img THEN 'content_image' WHEN low >= 0.5 THEN 'low_text' WHEN tab >= 0.5 THEN 'tables' ELSE 'text' END AS reason,
      ext <> 'docx' AND (img OR low >= 0.5 OR tab >= 0.5) AS use_vision FROM (
      SELECT doc_id, max(ext) AS ext, max(mode) AS mode, bool_or(has_content_image) AS img, avg(CASE WHEN s THEN CASE WHEN text_len < 50 THEN 1.0 ELSE 0.0 END END) AS low,
        avg(CASE WHEN s THEN CASE WHEN text_len >= 50 AND max_table_rows >= 3 AND max_table_cols >= 2 AND table_coverage >= 0.3 THEN 1.0 ELSE 0.0 END END) AS tab
      FROM (SELECT *, (page - 1) % step = 0 AND (page - 1) // step < 8 AS s FROM (SELECT *, greatest(1, total_pages // least(total_pages, 8)) AS step FROM page_signals)) GROUP BY doc_id))""")
def route_documents(pages: DataFrame, sample: int = 8) -> DataFrame:
    """Fast or vision path per document: images count on every page, text and tables on evenly spaced ones."""
    step = F.greatest(F.lit(1), F.floor(F.col("total_pages") / F.least(F.col("total_pages"), F.lit(sample))))
    sampled = ((F.col("page") - 1) % step == 0) & (F.floor((F.col("page") - 1) / step) < sample)
    low = F.col("text_len") < 50
    table = ~low & (F.col("max_table_rows") >= 3) & (F.col("max_table_cols") >= 2) & (F.col("table_coverage") >= 0.3)
    share = lambda c: F.avg(F.when(sampled, c.cast("double")))
    d = pages.groupBy("doc_id").agg(F.max("ext").alias("ext"), F.max("mode").alias("mode"), F.bool_or("has_content_image").alias("img"), share(low).alias("low"), share(table).alias("tab"))
    reason = F.when(F.col("ext") == "docx", "docx").when(F.col("img"), "content_image").when(F.col("low") >= 0.5, "low_text").when(F.col("tab") >= 0.5, "tables").otherwise("text")
    blocked = ((F.col("mode") == "docx") & (F.col("ext") != "docx")) | ((F.col("mode") == "pdf") & (F.col("ext") != "pdf"))
    return d.select("doc_id", reason.alias("reason"), F.when(blocked, "blocked").otherwise("ok").alias("verdict")).withColumn("use_vision", ~F.col("reason").isin("docx", "text"))


ELEMENT_KINDS = {"heading": "headings", "paragraph": "paragraphs", "table": "tables", "figure": "figures", "list_item": "list_items", "callout": "callouts"}


@operator("element_stats", ["element_json"], "SELECT doc_id, " + ", ".join(f"""CAST(len(regexp_extract_all(response, '"type":"{k}"')) AS BIGINT) AS {v}""" for k, v in ELEMENT_KINDS.items()) + " FROM element_json")
def element_stats(model_text: DataFrame) -> DataFrame:
    """Counts by type of the elements in each document's extracted array."""
    parsed = model_text.select("doc_id", F.from_json("response", "array<struct<type:string,level:int,text:string>>").alias("e"))
    return parsed.select("doc_id", *[_count(kind).alias(name) for kind, name in ELEMENT_KINDS.items()])


def _count(kind: str) -> Column:
    return F.size(F.filter("e", lambda e: e["type"] == kind)).cast("long")
