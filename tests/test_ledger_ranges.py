"""Ledgers over ranges of events against a plain loop."""

import calendar
import datetime as dt
import random

import pytest

from ferrule.operators import ledger

EVENTS = "user_id string, ts timestamp, seq long, kind string, amount long"
USERS = "id string, plan string, seats int, created_at timestamp, org_id long"


def month_on(year, month, day):
    year, month = year + month // 12, month % 12 + 1
    return dt.datetime(year, month, min(day, calendar.monthrange(year, month)[1]), 8)


def loop(events, plan, seats, day, restricted, catch_up):
    """(seq, used, purchased, remaining, reset_at, allowed) after each event of one user."""
    limit, used, bought, out = (max(seats or 1, 1) * 145 if plan == "team" else 130), 0, 0, []
    events = sorted(events)
    reset = month_on(events[0][0].year, events[0][0].month, day)
    for ts, seq, kind, amount in events:
        limit = amount if kind == "plan" else limit
        for n in range(2 if kind == "deduct" and not catch_up else 1):
            if ts >= reset:
                used = 0
                reset = month_on(reset.year, reset.month, day)
                while catch_up and ts >= reset:
                    reset = month_on(reset.year, reset.month, day)
            if n == 0:
                allowed = not restricted and limit - used + bought > 0
        if kind == "deduct":
            monthly = min(max(0, limit - used), amount)
            used, bought = used + monthly, max(0, bought - (amount - monthly))
        elif kind == "refund":
            back = min(used, amount)
            used, bought = used - back, bought + amount - back
        elif kind == "purchase":
            bought += amount
        out.append((seq, used, bought, max(0, limit - used) + bought, reset.strftime("%Y-%m-%d %H:%M:%S"), allowed))
    return out


def made(rnd, n, days):
    start = dt.datetime(2023, 1, rnd.randint(1, 31), rnd.randint(0, 23))
    kinds = ["deduct"] * 12 + ["refund"] * 5 + ["purchase"] + ["plan"] * (rnd.random() < 0.7)
    times = sorted(start + dt.timedelta(minutes=rnd.randrange(days * 1440) // 7 * 7) for _ in range(n))
    return [(t, i if rnd.random() < 0.9 else 5, k := rnd.choice(kinds), rnd.choice([20, 130, 300]) if k == "plan" else rnd.randint(0, 40)) for i, t in enumerate(times)]


@pytest.mark.parametrize("catch_up", [False, True])
def test_ranges_equal_a_loop(spark, catch_up):
    """Users of many ranges, users inside one, long gaps, bursts, changes of plan, ties and repeated rows, members of restricted teams."""
    rnd = random.Random(3 + catch_up)
    users = {f"u{i}": (rnd.choice(["team", "solo"]), rnd.choice([None, 1, 3]), rnd.randint(1, 31), rnd.randrange(3)) for i in range(30)}
    events = {u: made(rnd, rnd.choice([1, 3, 20, 400]), rnd.choice([1, 40, 900])) for u in users}
    events["u0"] = made(rnd, 900, 700)
    events["u1"] = made(rnd, 600, 1)
    events["u2"] += events["u2"][:1]
    rows = [(u, *e) for u, es in events.items() for e in es] + [("nobody", dt.datetime(2024, 1, 1), 1, "deduct", 5)]
    rnd.shuffle(rows)
    u = spark.createDataFrame([(k, p, s, dt.datetime(2022, 1, d), o) for k, (p, s, d, o) in users.items()] + [("idle", "solo", None, dt.datetime(2022, 1, 1), 0)], USERS)
    orgs = spark.createDataFrame([(0, True), (1, False)], "org_id long, billing_restricted boolean")
    want = sorted((k, *r) for k, (p, s, d, o) in users.items() for r in loop(events[k], p, s, d, p == "team" and o == 0, catch_up))
    frame = spark.createDataFrame(rows, EVENTS)
    for size in (50, 10**6):
        got = sorted(tuple(r) for r in ledger.credit_ledger(frame, u, orgs, catch_up=catch_up, rows=size).collect())
        assert got == want


def test_the_pools_functions_compose():
    rnd = random.Random(9)
    for _ in range(300):
        pieces, steps = [(0, 0, 1)], []
        for _ in range(rnd.randint(0, 25)):
            steps.append((rnd.choice(["deduct", "deduct", "refund", "plan"]), rnd.randint(0, 30), rnd.choice([10, 40, 41, 90]), rnd.random() < 0.03))
            pieces = ledger.applied(pieces, *steps[-1])
        for start in range(0, 130, 7):
            pool = start
            for kind, amount, limit, reset in steps:
                pool = 0 if reset else pool
                pool = pool + min(max(0, limit - pool), amount) if kind == "deduct" else pool - min(pool, amount) if kind == "refund" else pool
            assert ledger.valued(pieces, start) == pool
        assert len(pieces) <= 4 + 2 * len({s[2] for s in steps})
