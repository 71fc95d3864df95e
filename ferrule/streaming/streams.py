"""Structured Streaming versions of the event-driven operators. Watermarks are this library's choice: a day, or the retention span.

Every query reads the given table as a file stream to its end and returns what the stream wrote.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ferrule.operators.ingest import visit_event_ingest
from ferrule.operators.ledger import account_plans
from ferrule.plans.registry import query
from ferrule.sources.shared import shared_dir
from ferrule.sources.views import VIEWS, view


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of files; its zone-less timestamps become timestamps, which watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    df = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return df.select(*[F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.simpleString() == "timestamp_ntz" else F.col(f.name) for f in schema])


def stream_view(spark: SparkSession, sf_dir: str, name: str, source: str) -> DataFrame:
    """A view over one table, as a stream."""
    return spark.sql(VIEWS[name], **{source: stream(spark, sf_dir, source)})


def sink(folder: str):
    """A writer for foreachBatch. Each batch has its own folder and overwrites it, so a batch that runs again after a failure counts once."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    return write


def finish(df: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """Runs a stream to its end and returns its rows: appended ones or, with a key, the newest row of each key (an upsert of updates)."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = df.writeStream.outputMode("update" if key else "append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(sink(folder)).start()
    q.awaitTermination()
    out = spark.read.schema(df.schema.add("batch", "long")).parquet(f"{folder}/out")
    if key:
        newest = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("batch")))
        out = out.withColumn("_n", newest).where("_n = 1").drop("_n")
    return out.drop("batch")


_FIRST_VISITS = r"""SELECT DISTINCT sha256(visitor_id || ':' || 'salt') AS visitor_id_hash, CAST(CAST(timezone('America/Los_Angeles', timezone('UTC', ts)) AS DATE) AS VARCHAR) AS visit_date FROM visits_raw
    WHERE regexp_full_match(visitor_id, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') AND length(path) BETWEEN 1 AND 500 AND engaged_ms BETWEEN 3000 AND 86400000 AND interaction AND NOT regexp_matches(user_agent, 'HeadlessChrome|Playwright|Puppeteer|bot|crawler|spider', 'i')
      AND NOT regexp_matches(string_split(path, '?')[1], '^(/kb)?/admin(/|$)')"""


def first_visits(visits: DataFrame) -> DataFrame:
    """The first visit of each visitor and day; state is dropped a day after it."""
    valid = visit_event_ingest(visits.withColumn("event_id", F.struct("event_id", "ts"))).where("is_valid")
    events = valid.select("visitor_id_hash", "visit_date", F.col("event_id.ts").alias("ts"))
    return events.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["visitor_id_hash", "visit_date"])


@query("stream_visits", _FIRST_VISITS, ("visits_raw",))
def stream_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(first_visits(stream_view(spark, sf_dir, "visits_raw", "events"))).select("visitor_id_hash", "visit_date")


def happenings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, ts) of events and jobs as one stream."""
    events = stream(spark, sf_dir, "events").select(F.lit("events").alias("kind"), "ts")
    return events.unionByName(stream(spark, sf_dir, "orders").select(F.lit("jobs").alias("kind"), F.col("o_orderdate").cast("timestamp").alias("ts")))


_HAPPENED = "h AS (SELECT 'events' AS kind, ts FROM events UNION ALL SELECT 'jobs', CAST(o_orderdate AS TIMESTAMP) FROM orders)"


@query("stream_daily", f"WITH {_HAPPENED} SELECT kind, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS n FROM h GROUP BY 1, 2 UNION ALL SELECT 'visitors', visit_date, count(*) FROM ({_FIRST_VISITS}) GROUP BY 2", ("visits_raw",))
def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and jobs per UTC day in tumbling windows, and visitors per day; a day's state goes when the watermark has passed it."""
    days = happenings(spark, sf_dir).withWatermark("ts", "1 day").groupBy("kind", F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    counted = finish(days.select("kind", F.to_date("window.start").cast("string").alias("date"), "n"), ("kind", "date"))
    visitors = stream_visits(spark, sf_dir).groupBy(F.lit("visitors").alias("kind"), F.col("visit_date").alias("date")).agg(F.count("*").alias("n"))
    return counted.unionByName(visitors)


@query("stream_rolling", """SELECT 'hour' AS span, strftime(time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE * k, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS events FROM events, range(12) r(k) GROUP BY 2
    UNION ALL SELECT 'day', strftime(time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * k, '%Y-%m-%d %H:%M:%S'), count(*) FROM events, range(24) r(k) GROUP BY 2""")
def stream_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the last hour, every five minutes, and of the last 24 hours, every hour."""
    def rolling(span: str, width: str, step: str) -> DataFrame:
        counted = stream(spark, sf_dir, "events").withWatermark("ts", "1 day").groupBy(F.window("ts", width, step)).agg(F.count("*").alias("events"))
        return finish(counted.select(F.lit(span).alias("span"), F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events"), ("start",))

    return rolling("hour", "1 hour", "5 minutes").unionByName(rolling("day", "24 hours", "1 hour"))


LEAST_VISIBLE = 3_000  # milliseconds


def reached(happened: Column) -> Column:
    """(engaged_ms, at) of the event by which a visitor's visible time of a day has reached the threshold with an interaction; null before that."""
    kind = "struct<visible:bigint,since:bigint,touched:boolean,engaged_ms:bigint,at:timestamp>"
    start = F.struct(F.lit(0).alias("visible"), F.lit(None).alias("since"), F.lit(False).alias("touched"), F.lit(None).alias("engaged_ms"), F.lit(None).alias("at")).cast(kind)

    def step(s, e):
        at = F.unix_millis(e["ts"])
        visible, touched = s["visible"] + F.coalesce(at - s["since"], F.lit(0)), s["touched"] | F.coalesce(e["interacted"], F.lit(False))
        now = s["at"].isNull() & touched & (visible >= LEAST_VISIBLE)
        return F.struct(visible.alias("visible"), F.when(e["shown"], at).alias("since"), touched.alias("touched"), F.when(now, visible).otherwise(s["engaged_ms"]).alias("engaged_ms"), F.when(now, e["ts"]).otherwise(s["at"]).alias("at"))

    return F.aggregate(F.array_sort(happened), start, step, lambda s: F.when(s["at"].isNotNull(), F.struct(s["engaged_ms"].alias("engaged_ms"), s["at"].alias("at"))))


def engagement(events: DataFrame) -> DataFrame:
    """When a visitor's visible time of a day reached the threshold, as updates by visitor and date.

    A day's events of a visitor are the state, which goes a day after the day has ended; late ones take their place among them.
    """
    dated = events.withColumn("day", F.date_trunc("day", "ts")).withColumn("date", F.date_format("day", "yyyy-MM-dd")).withWatermark("day", "2 days")
    happened = F.collect_list(F.struct("ts", "event_id", (F.col("state") == "visible").alias("shown"), "interacted"))
    days = dated.groupBy("visitor_id", "date", "day").agg(reached(happened).alias("r")).where("r is not null")
    return days.select("visitor_id", "date", F.col("r.engaged_ms").alias("engaged_ms"), F.date_format("r.at", "yyyy-MM-dd HH:mm:ss").alias("reached_at"))


@query("stream_engagement", """WITH s AS (SELECT visitor_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, ts, event_id, epoch_us(ts) // 1000 AS ms, lag(epoch_us(ts) // 1000) OVER w AS before, lag(state) OVER w AS was, bool_or(interacted) OVER w AS touched FROM visibility_events WINDOW w AS (PARTITION BY visitor_id, CAST(ts AS DATE) ORDER BY ts, event_id)),
    r AS (SELECT *, coalesce(sum(CASE WHEN was = 'visible' THEN ms - before ELSE 0 END) OVER (PARTITION BY visitor_id, date ORDER BY ts, event_id), 0) AS visible FROM s)
    SELECT visitor_id, date, CAST(arg_min(visible, (ts, event_id)) AS BIGINT) AS engaged_ms, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS reached_at FROM r WHERE touched AND visible >= 3000 GROUP BY 1, 2""", ("visibility_events",))
def stream_engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a visitor's visible time of a day reached three seconds with an interaction, once a day, and how long it was then."""
    return finish(engagement(stream_view(spark, sf_dir, "visibility_events", "events")), ("visitor_id", "date"))


@query("stream_subscriptions", """WITH c AS (SELECT customer_id, coalesce(sum(credits), 0) AS credits FROM sub_events GROUP BY 1), n AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY ts DESC, event_id DESC) AS r FROM sub_events WHERE type <> 'credit_pack')
    SELECT c.customer_id, CASE WHEN n.type <> 'deleted' THEN n.plan END AS plan, CASE WHEN n.type <> 'deleted' AND n.plan = 'team' THEN n.seats END AS seats, coalesce(n.type <> 'deleted' AND n.plan = 'team' AND n.status NOT IN ('active', 'trialing'), false) AS restricted, coalesce(n.type = 'deleted', false) AS ended, CAST(c.credits AS BIGINT) AS credits, n.event_id AS last_event
    FROM c LEFT JOIN n ON n.customer_id = c.customer_id AND n.r = 1""", ("sub_events",))
def stream_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's newest plan, seats and restriction (a team whose payment is not in order), and the credits of packs bought so far."""
    events = stream_view(spark, sf_dir, "sub_events", "orders")
    change = F.when(F.col("type") != "credit_pack", F.struct("ts", "event_id"))
    newest = F.max_by(F.struct("type", "event_id", "plan", "seats", "status"), change)
    s = F.col("s")
    state = events.groupBy("customer_id").agg(newest.alias("s"), F.coalesce(F.sum("credits"), F.lit(0)).alias("credits"))
    live, team = s["type"] != "deleted", s["plan"] == "team"
    out = state.select(
        "customer_id", F.when(live, s["plan"]).alias("plan"), F.when(live & team, s["seats"]).alias("seats"), F.coalesce(live & team & ~s["status"].isin("active", "trialing"), F.lit(False)).alias("restricted"),
        F.coalesce(s["type"] == "deleted", F.lit(False)).alias("ended"), "credits", s["event_id"].alias("last_event"))
    return finish(out, ("customer_id",))


def retained(df: DataFrame, day: str, days: int) -> DataFrame:
    """Runs a stream into a store by day. After each batch, days before the horizon, counted from the newest day stored, leave the store.

    Which days are stored is read from the names of their folders alone, never from rows, so a batch costs its own rows and a listing.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy(day).parquet(f"{folder}/out/batch={number}")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        pattern = hadoop(f"{folder}/out/batch=*/{day}=*")
        files = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        stored = {str(s.getPath()): dt.date.fromisoformat(str(s.getPath().getName()).split("=")[1]) for s in files.globStatus(pattern) if "__HIVE" not in s.getPath().getName()}
        for path, held in stored.items():
            if held < max(stored.values()) - dt.timedelta(days=days):
                files.delete(hadoop(path), True)

    q = df.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(df.schema.add("batch", "long")).parquet(f"{folder}/out").drop("batch")


@query("stream_retention", "SELECT o_orderkey AS id, concat('user_', o_custkey) AS user_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders WHERE CAST(o_orderdate AS DATE) >= (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) - 90")
def stream_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of the last 90 days; older ones leave the store."""
    jobs = stream(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("user_"), F.col("o_custkey").cast("string")).alias("user_id"), F.to_date("o_orderdate").alias("day"))
    return retained(jobs, "day", 90).withColumn("day", F.col("day").cast("string"))


LEDGER = "user_id string, seq long, used long, purchased long, remaining long, reset_at string, allowed boolean"


#: Users share this many groups: a group's call costs far more than a user's step in it, and holds this share of the users and of a batch's events.
GROUPS = 2_000


@lru_cache(10_000)
def month_on(at: int, day: int) -> int:
    """The reset, on a day of the month or its last, at 8, of the month after a time; both in seconds."""
    first = pd.Timestamp(at, unit="s").normalize().replace(day=1) + pd.DateOffset(months=1)
    return int(first.replace(day=min(day, first.days_in_month), hour=8).timestamp())


@lru_cache(10_000)
def shown(at: int) -> str:
    return str(pd.Timestamp(at, unit="s"))


def ledger_update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Folds new events, each user's in order, into the balances kept between micro-batches. Without a user_id the key is the user."""
    events = pd.concat(parts)
    if "user_id" not in events:
        events = events.assign(user_id=key[0])
    events = events.sort_values(["user_id", "ts", "seq"])
    held = json.loads(state.get[0]) if state.exists else {}
    ts = events["ts"].astype("datetime64[us]").astype("int64")
    user, out = None, []
    for who, seq, us, kind, amount, plan_limit, day, restricted in zip(events["user_id"], events["seq"], ts, events["kind"], events["amount"], events["plan_limit"], events["day"], events["restricted"], strict=True):
        if who != user:
            if user is not None:
                held[user] = used, bought, due, limit
            user, today, barred = who, int(day), bool(restricted)
            used, bought, due, limit = held.get(who, (0, 0, None, int(plan_limit)))
        if due is None:
            due = month_on(us // 10**6 // 86_400 * 86_400, today)
        amount = int(amount)
        limit = amount if kind == "plan" else limit
        for n in range(2 if kind == "deduct" else 1):
            if us >= due * 10**6:
                used, due = 0, month_on(due, today)
            allowed = not barred and limit - used + bought > 0 if n == 0 else allowed
        if kind == "deduct":
            monthly = min(max(0, limit - used), amount)
            used, bought = used + monthly, max(0, bought - (amount - monthly))
        elif kind == "refund":
            back = min(used, amount)
            used, bought = used - back, bought + amount - back
        elif kind == "purchase":
            bought += amount
        out.append((who, seq, used, bought, max(0, limit - used) + bought, shown(due), allowed))
    held[user] = used, bought, due, limit
    state.update((json.dumps(held),))
    yield pd.DataFrame(out, columns=[x.split(" ")[0] for x in LEDGER.split(", ")])


@query("stream_ledger")
def stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-user credit state over the event stream, from the user's plan and team as they are when a batch runs; the balances of ``credit_ledger``."""
    plans = account_plans(view(spark, sf_dir, "users"), view(spark, sf_dir, "orgs"))
    events = stream_view(spark, sf_dir, "ledger_events", "orders").join(plans, "user_id")
    grouped = events.withColumn("users", F.pmod(F.xxhash64("user_id"), F.lit(GROUPS))).groupBy("users")
    return finish(grouped.applyInPandasWithState(ledger_update, LEDGER, "held string", "append", GroupStateTimeout.NoTimeout))
