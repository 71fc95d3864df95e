"""Credit balances after every event, for users of any number of events.

Events lie in ranges of bounded size, in order of user and time, so that a user of many events has many ranges and no task has all of them. What a range does to a
balance is a function of what comes in, and functions of ranges compose: resets and limits by running sums and minima, the monthly pool by a
monotone function in few pieces, the purchased pool by a sum and the deepest fall below zero. Only users of several ranges need them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ferrule.operators.accounts import limit_of, shown
from ferrule.plans.registry import operator
from ferrule.sources.shared import written

ROWS = 100_000  # events of a range
EVENT = ["ts", "seq", "kind", "amount"]
RANGE = ["part", "user_id"]


def reset_at(month: Column, day: Column) -> Column:
    """The reset of a month counted from year 0: the anniversary day or the month's last, 08:00 UTC."""
    first = F.make_date(F.floor(month / 12).cast("int"), (F.pmod(month, F.lit(12)) + 1).cast("int"), F.lit(1))
    return F.make_timestamp(F.year(first), F.month(first), F.least(day, F.dayofmonth(F.last_day(first))), F.lit(8), F.lit(0), F.lit(0))


def month_of(at: Column) -> Column:
    return F.year(at) * 12 + F.month(at) - 1


def upto(*order: str):
    return W.partitionBy(*RANGE).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)


def before():
    """The ranges of a user before one."""
    return W.partitionBy("user_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)


def with_resets(events: DataFrame, catch_up: bool) -> DataFrame:
    """Adds resets (how many have passed after an event's reads), first (after the first read), came (before it) and limit.

    A read passes one reset at most if it is due, and a job reads twice, so resets after event i are min(due_i, resets before + reads_i): over a range the
    running sum of reads plus the least of what came in and of every due minus the sum there. Catching up passes all that are due.
    """
    each = W.partitionBy(*RANGE).orderBy(*EVENT)
    day, ts = F.col("day"), F.col("ts").cast("timestamp")
    due = F.greatest(F.lit(0), month_of(F.col("ts")) - month_of(F.col("signup")) - 1 + (ts >= reset_at(month_of(F.col("ts")), day)).cast("int"))
    out = events.withColumn("due", due).withColumn("sum", F.sum(F.when(F.col("kind") == "deduct", 2).otherwise(1)).over(upto(*EVENT)))
    out = out.withColumn("least", F.min(F.col("due") - F.col("sum")).over(upto(*EVENT)))
    out = out.withColumn("planned", F.last(F.when(F.col("kind") == "plan", F.col("amount").cast("long")), ignorenulls=True).over(upto(*EVENT)))
    out = out.withColumn("resets", F.col("due") if catch_up else F.col("sum") + F.least("least", F.col("resets_in")))
    out = out.withColumn("came", F.coalesce(F.lag("resets").over(each), "resets_in"))
    return out.withColumn("first", F.col("due") if catch_up else F.least(F.col("due"), F.col("came") + 1)).withColumn("limit", F.coalesce("planned", "limit_in"))


def resets_carried(events: DataFrame, catch_up: bool) -> DataFrame:
    """part, user_id, resets_in and limit_in of the ranges of users that have several."""
    start = with_resets(events.withColumn("resets_in", F.lit(0).cast("long")).withColumn("limit_in", F.lit(None).cast("long")), catch_up)
    ranges = start.groupBy(*RANGE, "plan_limit").agg(F.max("sum").alias("sum"), F.min("least").alias("least"), F.max("due").alias("due"), F.max_by("planned", F.when(F.col("planned").isNotNull(), F.struct(*EVENT))).alias("planned"))
    ranges = ranges.withColumn("before", F.coalesce(F.sum("sum").over(before()), F.lit(0)))
    came = F.coalesce(F.max("due").over(before()), F.lit(0)) if catch_up else F.col("before") + F.least(F.lit(0), F.coalesce(F.min(F.col("least") - F.col("before")).over(before()), F.lit(0)))
    return ranges.select(*RANGE, came.cast("long").alias("resets_in"), F.coalesce(F.last("planned", ignorenulls=True).over(before()), "plan_limit").alias("limit_in"))


def applied(pieces: list[tuple[int, int, int]], kind: str, amount: int, limit: int, reset: bool) -> list[tuple[int, int, int]]:
    """The monthly pool's function after one more event.

    A piece (x, y, slope) is y + slope * (pool - x) from x on, slope 0 or 1. A deduction makes v into max(v, min(limit, v + amount)), a refund into
    max(0, v - amount), a reset into 0: each keeps slopes and order, so a function has few pieces, a few more for each change of plan.
    """
    if reset:
        pieces = [(0, 0, 0)]
    if kind not in ("deduct", "refund"):
        return pieces
    out: list[tuple[int, int, int]] = []
    for k, (x, y, slope) in enumerate(pieces):
        end = pieces[k + 1][0] if k + 1 < len(pieces) else None
        if not slope:
            out.append((x, max(y, min(limit, y + amount)) if kind == "deduct" else max(0, y - amount), 0))
            continue
        # from a value on, below another (None: no end), the new value there, and the slope behind it
        if kind == "deduct":
            cuts = [(y, limit - amount, y + amount, 1), (max(y, limit - amount), limit, limit, 0), (max(y, limit), None, max(y, limit), 1)]
        else:
            cuts = [(y, amount, 0, 0), (max(y, amount), None, max(y, amount) - amount, 1)]
        out += [(x + at - y, value, inner) for at, high, value, inner in cuts if (high is None or at < high) and (end is None or x + at - y < end)]
    merged: list[tuple[int, int, int]] = []
    for x, y, slope in out:
        if merged and merged[-1][2] == slope and y == merged[-1][1] + slope * (x - merged[-1][0]):
            continue
        merged.append((x, y, slope))
    return merged


def valued(pieces: list[tuple[int, int, int]], pool: int) -> int:
    x, y, slope = next(p for p in reversed(pieces) if p[0] <= pool)
    return y + slope * (pool - x)


def range_function(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    pieces = [(0, 0, 1)]
    rows = rows.sort_values(EVENT)
    for kind, amount, limit, reset in zip(rows["kind"], rows["amount"].tolist(), rows["limit"].tolist(), rows["passed"].tolist(), strict=True):
        pieces = applied(pieces, kind, int(amount or 0), int(limit), reset)
    return pd.DataFrame({"part": [key[0]], "user_id": [key[1]], "pieces": [[x for p in pieces for x in p]]})


def pools_carried(key: tuple, ranges: pd.DataFrame) -> pd.DataFrame:
    """The monthly pool that comes into each range of a user."""
    pool, came = 0, []
    ranges = ranges.sort_values("part")
    for flat in ranges["pieces"]:
        came.append(pool)
        flat = [int(x) for x in flat]
        pool = valued(list(zip(flat[::3], flat[1::3], flat[2::3])), pool)
    return pd.DataFrame({"part": ranges["part"], "user_id": key[0], "used_in": came})


CARRIED = ["part", "user_id", "seq", "limit", "resets", "signup", "day"]
FOLDED = {"used": "long", "purchased": "long", "allowed": "boolean", "change": "long", "sum": "long"}


def with_pools(events: DataFrame) -> DataFrame:
    """CARRIED, and after each event: used, purchased, whether it was allowed, the change of the purchased pool and the sum of changes in the range.

    Events come sorted by range and user, as the windows before leave them, and a loop holds the one balance it is at. (A fold over arrays
    copies what it has gathered at every step.)
    """
    kinds = ", ".join([f"`{c}` {events.schema[c].dataType.simpleString()}" for c in CARRIED] + [f"{c} {t}" for c, t in FOLDED.items()])
    read = ("part", "user_id", "kind", "amount", "limit", "passed", "stepped", "restricted", "used_in", "purchased_in")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, used, bought, total = None, 0, 0, 0
        for batch in batches:
            out = []
            for part, user, kind, amount, limit, passed, stepped, restricted, used_in, purchased_in in zip(*(batch.column(c).to_pylist() for c in read), strict=True):
                if (part, user) != at:
                    at, used, bought, total = (part, user), used_in, purchased_in, 0
                allowed = not restricted and limit - (0 if stepped else used) + bought > 0
                used, amount = (0 if passed else used), int(amount or 0)
                if kind == "deduct":
                    monthly = min(max(0, limit - used), amount)
                    used, change = used + monthly, monthly - amount
                elif kind == "refund":
                    back = min(used, amount)
                    used, change = used - back, amount - back
                else:
                    change = amount if kind == "purchase" else 0
                bought, total = max(0, bought + change), total + change
                out.append((used, bought, allowed, change, total))
            columns = zip(*out, strict=True) if out else [()] * len(FOLDED)
            types = [pa.bool_() if t == "boolean" else pa.int64() for t in FOLDED.values()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in CARRIED), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [*CARRIED, *FOLDED])

    return events.sortWithinPartitions(*RANGE, *EVENT).mapInArrow(run, kinds)


def purchased_carried(folded: DataFrame) -> DataFrame:
    """What comes into each range's purchased pool: over a range it is the sum of changes plus the larger of what came in and of the deepest fall."""
    ranges = folded.groupBy(*RANGE).agg(F.sum("change").alias("sum"), F.max(-F.col("sum")).alias("fell"))
    ranges = ranges.withColumn("before", F.coalesce(F.sum("sum").over(before()), F.lit(0)))
    came = F.col("before") + F.greatest(F.lit(0), F.coalesce(F.max(F.col("fell") - F.col("before")).over(before()), F.lit(0)))
    return ranges.select(*RANGE, came.cast("long").alias("purchased_in"))


def account_plans(users: DataFrame, orgs: DataFrame | None = None) -> DataFrame:
    """user_id, plan_limit, the day of the month that resets fall on, and restricted: whether a team's payment has failed."""
    plans = users.select(F.col("id").alias("user_id"), limit_of(F.col("plan"), F.col("seats")).alias("plan_limit"), F.dayofmonth("created_at").alias("day"), *([F.col("org_id"), F.col("plan")] if orgs is not None else []))
    if orgs is None:
        return plans.withColumn("restricted", F.lit(False))
    held = F.coalesce((F.col("plan") == "team") & F.col("billing_restricted"), F.lit(False))
    return plans.join(orgs.select("org_id", "billing_restricted"), "org_id", "left").select("user_id", "plan_limit", "day", held.alias("restricted"))


@operator("credit_ledger", ["ledger_events", "users", "orgs"])
def credit_ledger(events: DataFrame, users: DataFrame, orgs: DataFrame | None = None, catch_up: bool = False, rows: int = ROWS) -> DataFrame:
    """Each user's balance after each event: jobs, refunds, purchases (of no negative amounts), and plan changes, whose amount is the new monthly limit. Members of
    a team whose payment has failed are allowed nothing. A read moves a passed reset date by one month (catch_up: past the event); a job reads twice.
    """
    plans = account_plans(users, orgs)
    n = max(1, -(-events.count() // rows))
    ranged = written(events.select("user_id", *EVENT).repartitionByRange(n, "user_id", *EVENT).withColumn("part", F.spark_partition_id()))
    of_user = W.partitionBy("user_id")
    heads = ranged.groupBy(*RANGE).agg(F.min("ts").alias("signup")).join(plans, "user_id")
    heads = written(heads.withColumn("signup", F.min("signup").over(of_user)).withColumn("ranges", F.count("*").over(of_user)))
    several = heads.where("ranges > 1").drop("ranges")
    carried = heads.select(*RANGE, F.lit(0).cast("long").alias("resets_in"), F.col("plan_limit").alias("limit_in"), F.lit(0).cast("long").alias("used_in"), F.lit(0).cast("long").alias("purchased_in"))
    flags = {"passed": F.col("resets") > F.col("came"), "stepped": F.col("first") > F.col("came"), "resets": F.col("resets").cast("long")}
    if not several.isEmpty():
        # each step needs what the one before carries: resets and limits, then the monthly pool, then the purchased one
        long_ones, user = ranged.join(several, RANGE), ranged.schema["user_id"].dataType.simpleString()
        one = written(resets_carried(long_ones, catch_up))
        reset = with_resets(long_ones.join(one, RANGE), catch_up).withColumns(flags)
        functions = reset.select(*RANGE, *EVENT, "limit", "passed").groupBy(*RANGE).applyInPandas(range_function, f"part int, user_id {user}, pieces array<long>")
        two = written(one.join(functions.groupBy("user_id").applyInPandas(pools_carried, f"part int, user_id {user}, used_in long"), RANGE))
        started = with_resets(long_ones.join(two.withColumn("purchased_in", F.lit(0).cast("long")), RANGE), catch_up).withColumns(flags)
        three = written(two.join(purchased_carried(with_pools(started)), RANGE))
        carried = carried.join(three.select(*RANGE), RANGE, "left_anti").unionByName(three)
    every = with_resets(ranged.join(heads.drop("ranges").join(carried, RANGE), RANGE), catch_up).withColumns(flags)
    shown_at = shown(reset_at(month_of(F.col("signup")) + 1 + F.col("resets"), F.col("day")))
    left = F.greatest(F.lit(0).cast("long"), F.col("limit") - F.col("used")) + F.col("purchased")
    return with_pools(every).select("user_id", "seq", "used", "purchased", left.alias("remaining"), shown_at.alias("reset_at"), "allowed")
