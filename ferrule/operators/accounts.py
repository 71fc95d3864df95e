"""Users, teams, credits, subscriptions and refunds: joins, priorities and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ferrule.plans.registry import operator

SEAT_CREDITS, SINGLE_CREDITS, MAX_SEATS = 145, 130, 20


def limit_of(plan: Column, seats: Column) -> Column:
    return F.when(plan == "team", F.greatest(F.coalesce(seats, F.lit(1)), F.lit(1)) * SEAT_CREDITS).otherwise(SINGLE_CREDITS).cast("long")


def next_reset(base: Column, day: Column) -> Column:
    """One month on, on the anniversary day or the month's last, 08:00 UTC."""
    month = F.add_months(F.trunc(base, "month"), 1)
    return F.make_timestamp(F.year(month), F.month(month), F.least(day, F.dayofmonth(F.last_day(month))), F.lit(8), F.lit(0), F.lit(0))


def shown(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def _reset_sql(base: str, day: str) -> str:
    month = f"(date_trunc('month', {base}) + INTERVAL 1 MONTH)"
    return f"({month} + INTERVAL 1 DAY * (least({day}, day(last_day({month}))) - 1) + INTERVAL 8 HOUR)"


@operator("reset_schedule", ["users"], f"""SELECT user_id, strftime(first, '%Y-%m-%d %H:%M:%S') AS first_reset, strftime({_reset_sql('first', 'd')}, '%Y-%m-%d %H:%M:%S') AS next_reset, strftime(date_trunc('month', created_at) + INTERVAL 1 MONTH + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS fallback_reset
    FROM (SELECT id AS user_id, created_at, day(created_at) AS d, {_reset_sql('created_at', 'day(created_at)')} AS first FROM users)""")
def reset_schedule(users: DataFrame) -> DataFrame:
    """A user's first and second reset from the signup day, and the first of the next month as the fallback."""
    day = F.dayofmonth("created_at")
    first = next_reset(F.col("created_at"), day)
    return users.select(F.col("id").alias("user_id"), shown(first).alias("first_reset"), shown(next_reset(first, day)).alias("next_reset"), shown(next_reset(F.col("created_at"), F.lit(1))).alias("fallback_reset"))


@operator("monthly_limit", ["users"], "SELECT id AS user_id, CAST(CASE WHEN plan = 'team' THEN greatest(seats, 1) * 145 ELSE 130 END AS BIGINT) AS monthly_limit FROM users")
def monthly_limit(users: DataFrame) -> DataFrame:
    return users.select(F.col("id").alias("user_id"), limit_of(F.col("plan"), F.col("seats")).alias("monthly_limit"))


@operator("usage_status", ["balances"], """SELECT user_id, CAST(greatest(monthly_limit - used, 0) + purchased AS BIGINT) AS remaining, round(least(100.0, used * 100.0 / monthly_limit), 2) AS pct, used * 1.0 / monthly_limit >= 0.8 AS is_low FROM balances""")
def usage_status(balances: DataFrame) -> DataFrame:
    share = F.col("used") / F.col("monthly_limit")
    return balances.select("user_id", (F.greatest(F.col("monthly_limit") - F.col("used"), F.lit(0)) + F.col("purchased")).cast("long").alias("remaining"), F.round(F.least(F.lit(100.0), share * 100), 2).alias("pct"), (share >= 0.8).alias("is_low"))


@operator("job_submitters", ["jobs", "users"], """SELECT j.id, j.type, j.status, coalesce(nullif(u.email, ''), j.user_id) AS submitted_by FROM (SELECT * FROM jobs ORDER BY created_at DESC, id DESC LIMIT 15) j LEFT JOIN users u ON u.id = j.user_id""")
def job_submitters(jobs: DataFrame, users: DataFrame, n: int = 15) -> DataFrame:
    """The newest n jobs with who sent them in; only those n rows join."""
    recent = jobs.orderBy(F.desc("created_at"), F.desc("id")).limit(n)
    names = users.select(F.col("id").alias("uid"), "email")
    return recent.join(names, F.col("user_id") == F.col("uid"), "left").select("id", "type", "status", F.coalesce(F.nullif("email", F.lit("")), "user_id").alias("submitted_by"))


@operator("team_usage", ["members", "balances", "orgs", "invites"], """SELECT o.org_id, count(b.user_id) AS members, CAST(sum(least(b.used, 145)) AS BIGINT) AS total_used, count(b.user_id) * 145 AS total_limit, max(o.seats) AS seats, max(coalesce(i.pending, 0)) AS pending, bool_or(o.billing_restricted) AS restricted
    FROM orgs o JOIN members m ON m.org_id = o.org_id JOIN balances b ON b.user_id = m.user_id LEFT JOIN (SELECT org_id, count(*) AS pending FROM invites WHERE status = 'pending' GROUP BY org_id) i ON i.org_id = o.org_id WHERE o.plan = 'team' GROUP BY o.org_id""")
def team_usage(members: DataFrame, balances: DataFrame, orgs: DataFrame, invites: DataFrame) -> DataFrame:
    """Usage of each team: members' use of their allotments, seats and open invitations."""
    pending = invites.where("status = 'pending'").groupBy("org_id").agg(F.count("*").alias("pending"))
    used = members.join(balances, "user_id").groupBy("org_id").agg(F.count("*").alias("members"), F.sum(F.least(F.col("used"), F.lit(SEAT_CREDITS))).alias("total_used"))
    teams = orgs.where("plan = 'team'").select("org_id", "seats", F.col("billing_restricted").alias("restricted"))
    return used.join(teams, "org_id").join(pending, "org_id", "left").select("org_id", "members", "total_used", (F.col("members") * SEAT_CREDITS).alias("total_limit"), "seats", F.coalesce("pending", F.lit(0)).alias("pending"), "restricted")


@operator("team_provision", ["users", "members", "orgs"], """SELECT user_id, 'team' AS plan, 1 AS seats, org_id FROM (SELECT m.user_id, m.org_id, row_number() OVER (PARTITION BY m.user_id ORDER BY m.seq, m.org_id) AS r
    FROM members m JOIN orgs o ON o.org_id = m.org_id AND o.plan = 'team' JOIN users u ON u.id = m.user_id AND u.plan IS NULL) WHERE r = 1""")
def team_provision(users: DataFrame, members: DataFrame, orgs: DataFrame) -> DataFrame:
    """Users without a plan who belong to a team get a seat in their first one."""
    open_users = users.where("plan is null").select(F.col("id").alias("user_id"))
    teams = orgs.where("plan = 'team'").select("org_id")
    found = members.join(teams, "org_id", "left_semi").join(open_users, "user_id", "left_semi")
    return found.groupBy("user_id").agg(F.min_by("org_id", F.struct("seq", "org_id")).alias("org_id")).select("user_id", F.lit("team").alias("plan"), F.lit(1).alias("seats"), "org_id")


@operator("credit_gate", ["users", "orgs", "balances"], """SELECT u.id AS user_id, CASE WHEN u.email = 'customer#000000007@example.org' THEN true WHEN u.plan = 'team' AND coalesce(o.billing_restricted, false) THEN false WHEN b.user_id IS NULL THEN true ELSE b.monthly_limit - b.used + b.purchased > 0 END AS allowed,
    CASE WHEN u.email = 'customer#000000007@example.org' THEN NULL WHEN u.plan = 'team' AND coalesce(o.billing_restricted, false) THEN 'billing_restricted' WHEN b.user_id IS NULL OR b.monthly_limit - b.used + b.purchased > 0 THEN NULL ELSE 'out_of_credits' END AS reason
    FROM users u LEFT JOIN orgs o ON o.org_id = u.org_id LEFT JOIN balances b ON b.user_id = u.id""")
def credit_gate(users: DataFrame, orgs: DataFrame, balances: DataFrame, admins: tuple[str, ...] = ("customer#000000007@example.org",)) -> DataFrame:
    """Whether a user may start a job. Admins pass; a restricted team is stopped before its balance counts; failed lookups pass."""
    b = balances.select(F.col("user_id").alias("uid"), (F.col("monthly_limit") - F.col("used") + F.col("purchased")).alias("left"))
    joined = users.select("id", "email", "plan", "org_id").join(orgs.select("org_id", "billing_restricted"), "org_id", "left").join(b, F.col("id") == F.col("uid"), "left")
    admin = F.coalesce(F.col("email").isin(*admins), F.lit(False))
    stopped = F.coalesce((F.col("plan") == "team") & F.col("billing_restricted"), F.lit(False))
    empty = F.coalesce(F.col("left") <= 0, F.lit(False))
    reason = F.when(~admin & stopped, "billing_restricted").when(~admin & empty, "out_of_credits")
    return joined.select(F.col("id").alias("user_id"), reason.isNull().alias("allowed"), reason.alias("reason"))


@operator("refund_match", ["refund_requests", "jobs"], """WITH recent AS (SELECT id, user_id, input_name, created_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS r FROM jobs) WHERE r <= 5 AND status = 'completed'),
    named AS (SELECT user_id, input_name, arg_max(id, (created_at, id)) AS nid FROM recent GROUP BY 1, 2)
    SELECT q.request_id, j.id AS job_id, CASE WHEN j.id IS NULL THEN 'not_found' WHEN j.status = 'refunded' THEN 'already' WHEN j.status <> 'completed' OR coalesce(j.credits_used, 0) = 0 THEN 'ineligible' ELSE 'refund' END AS verdict, CASE WHEN j.status = 'completed' THEN coalesce(j.credits_used, 0) ELSE 0 END AS credits
    FROM refund_requests q LEFT JOIN named n ON n.user_id = q.user_id AND n.input_name = q.input_name AND q.job_id IS NULL LEFT JOIN jobs j ON j.id = coalesce(q.job_id, n.nid) AND j.user_id = q.user_id""")
def refund_match(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """A request's job: by id, else the newest completed one of that name among the user's last five; and what becomes of it."""
    newest = W.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    recent = jobs.withColumn("r", F.row_number().over(newest)).where("r <= 5 and status = 'completed'")
    named = recent.groupBy(F.col("user_id").alias("nu"), F.col("input_name").alias("nn")).agg(F.max_by("id", F.struct("created_at", "id")).alias("nid"))
    wanted = requests.join(named, (F.col("user_id") == F.col("nu")) & (F.col("input_name") == F.col("nn")) & F.col("job_id").isNull(), "left").select("request_id", "user_id", F.coalesce("job_id", "nid").alias("wid"))
    j = jobs.select("id", F.col("user_id").alias("ju"), "status", F.coalesce("credits_used", F.lit(0)).alias("used"))
    found = wanted.join(j, (F.col("wid") == F.col("id")) & (F.col("user_id") == F.col("ju")), "left")
    verdict = F.when(F.col("id").isNull(), "not_found").when(F.col("status") == "refunded", "already").when((F.col("status") != "completed") | (F.col("used") == 0), "ineligible").otherwise("refund")
    return found.select("request_id", F.col("id").alias("job_id"), verdict.alias("verdict"), F.when(F.col("status") == "completed", F.col("used")).otherwise(0).alias("credits"))


@operator("cancel_on_delete", ["deleted_users", "subscriptions"], """SELECT s.sub_id, s.user_id FROM subscriptions s JOIN deleted_users d ON d.user_id = s.user_id WHERE regexp_full_match(d.user_id, 'user_[A-Za-z0-9]+') AND s.status IN ('active', 'trialing', 'past_due') AND NOT (s.plan = 'team' AND s.billing_owner_id IS NOT NULL AND s.billing_owner_id <> s.user_id)""")
def cancel_on_delete(deleted: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Live subscriptions of deleted users, but for teams that someone else pays for."""
    gone = deleted.where(F.col("user_id").rlike("^user_[A-Za-z0-9]+$")).select("user_id").distinct()
    others = (F.col("plan") == "team") & (F.col("billing_owner_id") != F.col("user_id"))
    live = subscriptions.where(F.col("status").isin("active", "trialing", "past_due") & ~F.coalesce(others, F.lit(False)))
    return live.join(gone, "user_id", "left_semi").select("sub_id", "user_id")


@operator("plan_price_match", ["subscriptions", "prices"], "SELECT s.sub_id, p.plan FROM subscriptions s JOIN prices p ON p.price_id = s.price_id")
def plan_price_match(subscriptions: DataFrame, prices: DataFrame) -> DataFrame:
    """Subscriptions at a known price. The price list is a fixed handful, which Spark broadcasts by its size."""
    return subscriptions.select("sub_id", "price_id").join(prices.select("price_id", "plan"), "price_id").select("sub_id", "plan")


@operator("seat_drift", ["orgs", "subscriptions"], """SELECT o.org_id, o.seats AS recorded, s.quantity AS actual, s.status NOT IN ('active', 'trialing') AS restricted, o.seats <> s.quantity AS changed
    FROM orgs o JOIN (SELECT org_id, arg_max(quantity, (ts, sub_id)) AS quantity, arg_max(status, (ts, sub_id)) AS status FROM subscriptions WHERE plan = 'team' GROUP BY org_id) s ON s.org_id = o.org_id
    WHERE o.seats <> s.quantity OR o.billing_restricted <> (s.status NOT IN ('active', 'trialing'))""")
def seat_drift(orgs: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Teams whose seats or restriction differ from their newest subscription."""
    newest = subscriptions.where("plan = 'team'").groupBy("org_id").agg(F.max_by(F.struct("quantity", "status"), F.struct("ts", "sub_id")).alias("s"))
    stopped = ~F.col("s.status").isin("active", "trialing")
    changed = F.col("seats") != F.col("s.quantity")
    return orgs.join(newest, "org_id").where(changed | (F.col("billing_restricted") != stopped)).select("org_id", F.col("seats").alias("recorded"), F.col("s.quantity").alias("actual"), stopped.alias("restricted"), changed.alias("changed"))


@operator("seat_change_check", ["seat_requests", "orgs", "members", "invites"], """SELECT q.request_id, o.seats + q.delta AS new_seats, CASE WHEN q.delta = 0 THEN 'no_change' WHEN o.seats + q.delta > 20 THEN 'over_cap' WHEN o.seats + q.delta < 1 THEN 'under_floor' WHEN o.seats + q.delta < coalesce(m.n, 0) + coalesce(i.n, 0) THEN 'seats_in_use' ELSE 'ok' END AS verdict
    FROM seat_requests q JOIN orgs o ON o.org_id = q.org_id LEFT JOIN (SELECT org_id, count(*) AS n FROM members GROUP BY 1) m ON m.org_id = q.org_id LEFT JOIN (SELECT org_id, count(*) AS n FROM invites WHERE status = 'pending' GROUP BY 1) i ON i.org_id = q.org_id""")
def seat_change_check(requests: DataFrame, orgs: DataFrame, members: DataFrame, invites: DataFrame) -> DataFrame:
    m = members.groupBy("org_id").agg(F.count("*").alias("m"))
    i = invites.where("status = 'pending'").groupBy("org_id").agg(F.count("*").alias("i"))
    held = orgs.select("org_id", "seats").join(m, "org_id", "left").join(i, "org_id", "left")
    joined = requests.join(held, "org_id").withColumn("new_seats", F.col("seats") + F.col("delta"))
    taken = F.coalesce("m", F.lit(0)) + F.coalesce("i", F.lit(0))
    verdict = F.when(F.col("delta") == 0, "no_change").when(F.col("new_seats") > MAX_SEATS, "over_cap").when(F.col("new_seats") < 1, "under_floor").when(F.col("new_seats") < taken, "seats_in_use").otherwise("ok")
    return joined.select("request_id", "new_seats", verdict.alias("verdict"))


@operator("billing_owner", ["orgs", "members", "users"], """SELECT org_id, owner_id, owner_id <> billing_owner_id AS reassigned FROM (SELECT o.org_id, o.billing_owner_id, m.user_id AS owner_id, row_number() OVER (PARTITION BY o.org_id ORDER BY CASE WHEN m.user_id = o.billing_owner_id THEN 0 ELSE 1 END, m.seq) AS r
    FROM orgs o JOIN members m ON m.org_id = o.org_id AND m.role = 'org:admin' JOIN users u ON u.id = m.user_id WHERE m.user_id = o.billing_owner_id OR u.customer_id IS NOT NULL) WHERE r = 1""")
def billing_owner(orgs: DataFrame, members: DataFrame, users: DataFrame) -> DataFrame:
    """The owner if still an admin, else the first admin who has a customer record."""
    admins = members.where("role = 'org:admin'").join(users.select(F.col("id").alias("user_id"), "customer_id"), "user_id")
    kept = F.col("user_id") == F.col("billing_owner_id")
    fit = orgs.select("org_id", "billing_owner_id").join(admins, "org_id").where(kept | F.col("customer_id").isNotNull())
    best = fit.groupBy("org_id", "billing_owner_id").agg(F.min_by("user_id", F.struct(F.when(kept, 0).otherwise(1), "seq")).alias("owner_id"))
    return best.select("org_id", "owner_id", (F.col("owner_id") != F.col("billing_owner_id")).alias("reassigned"))


@operator("posts_by_category", ["posts"], "SELECT slug, category, CAST(published_at AS VARCHAR) AS published, featured AS is_featured FROM posts WHERE category = 'en'")
def posts_by_category(posts: DataFrame, category: str | None = "en") -> DataFrame:
    picked = posts if category is None else posts.where(F.col("category") == category)
    return picked.orderBy(F.desc("published_at"), "slug").select("slug", "category", F.col("published_at").cast("string").alias("published"), F.col("featured").alias("is_featured"))


@operator("related_posts", ["posts"], """WITH top AS (SELECT slug, category, published_at, row_number() OVER (ORDER BY published_at DESC, slug) AS g, row_number() OVER (PARTITION BY category ORDER BY published_at DESC, slug) AS c FROM posts),
    cand AS (SELECT p.slug, t.slug AS related_slug, row_number() OVER (PARTITION BY p.slug ORDER BY CASE WHEN t.category = p.category THEN 0 ELSE 1 END, t.published_at DESC, t.slug) AS rank FROM posts p JOIN top t ON t.slug <> p.slug AND (t.g <= 4 OR (t.c <= 4 AND t.category = p.category)))
    SELECT slug, rank, related_slug FROM cand WHERE rank <= 3""")
def related_posts(posts: DataFrame, limit: int = 3) -> DataFrame:
    """The same category first, then the newest. Only each category's and the whole list's newest can be related, so those join."""
    newest = [F.desc("published_at"), "slug"]
    per = posts.withColumn("c", F.row_number().over(W.partitionBy("category").orderBy(*newest))).where(F.col("c") <= limit + 1)
    overall = posts.orderBy(*newest).limit(limit + 1)
    one = lambda df, own: df.select(F.col("slug").alias("related_slug"), F.col("category").alias("rc"), F.col("published_at").alias("rp"), F.lit(own).alias("own"))
    base = posts.select("slug", "category")
    same = base.join(one(per, 0), (F.col("category") == F.col("rc")) & (F.col("slug") != F.col("related_slug")))
    other = base.join(F.broadcast(one(overall, 1)), (F.col("category") != F.col("rc")))  # limit + 1 rows
    rank = F.row_number().over(W.partitionBy("slug").orderBy("own", F.desc("rp"), "related_slug"))
    return same.unionByName(other).withColumn("rank", rank).where(F.col("rank") <= limit).select("slug", "rank", "related_slug")


