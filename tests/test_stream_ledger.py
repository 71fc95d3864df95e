"""The streamed ledger knows plans and teams as the batch one does."""

import pandas as pd

from ferrule.operators.ledger import credit_ledger
from ferrule.sources.views import view
from ferrule.streaming import streams

SF = "/root/testdata/sf0.001"


def test_stream_gives_the_balances_of_the_batch_ledger(spark):
    want = credit_ledger(*[view(spark, SF, v) for v in ("ledger_events", "users", "orgs")])
    got = streams.stream_ledger(spark, SF).select(*want.columns)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(got) == rows(want)
    assert got.where("not allowed and remaining > 0").count() > 0 and got.where("allowed").count() > 0


class Held:
    """State between micro-batches, as the engine hands it to the function."""

    exists = False

    def update(self, value):
        self.get, self.exists = value, True


def test_plan_and_restriction_follow_the_account_between_batches():
    def batch(seq, kind, amount, limit, restricted):
        return iter([pd.DataFrame({"ts": [pd.Timestamp("2024-01-31") + pd.Timedelta(days=seq)], "seq": [seq], "kind": [kind], "amount": [amount], "plan_limit": [limit], "day": [31], "restricted": [restricted]})])

    state = Held()
    steps = [(0, "deduct", 100, 290, False), (1, "deduct", 150, 290, True), (2, "plan", 580, 290, False), (3, "deduct", 400, 290, False), (60, "deduct", 1, 290, False)]
    out = [next(streams.ledger_update(("u",), batch(*s), state)).iloc[0] for s in steps]
    assert [int(r.used) for r in out] == [100, 250, 250, 580, 1] and [int(r.remaining) for r in out] == [190, 40, 330, 0, 579]
    assert [bool(r.allowed) for r in out] == [True, False, True, True, True]
    assert [r.reset_at for r in out] == ["2024-02-29 08:00:00"] * 4 + ["2024-03-31 08:00:00"]  # the last event is at midnight, before that day's reset


def test_users_of_a_group_keep_their_own_balances():
    events = pd.DataFrame({"user_id": ["b", "a", "b"], "ts": pd.to_datetime(["2024-02-02", "2024-02-01", "2024-02-01"]), "seq": [3, 1, 2], "kind": "deduct", "amount": [5, 7, 6], "plan_limit": [130, 290, 130], "day": 31, "restricted": False})
    state = Held()
    steps = [next(streams.ledger_update((0,), iter([events]), state)), next(streams.ledger_update((0,), iter([events.head(1).assign(seq=4)]), state))]
    assert [(r.user_id, int(r.seq), int(r.used), int(r.remaining)) for df in steps for r in df.itertuples()] == [("a", 1, 7, 283), ("b", 2, 6, 124), ("b", 3, 11, 119), ("b", 4, 16, 114)]
