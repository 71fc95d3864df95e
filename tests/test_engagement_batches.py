"""Events of an earlier batch and late ones count in order of time."""

import datetime as dt

from ferrule.streaming import streams

SCHEMA = "event_id long, visitor_id string, ts timestamp, state string, interacted boolean"


def test_late_events_take_their_place(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 5, 1, 10, 0, 0) + dt.timedelta(seconds=s)
    batches = [[(1, "a", at(0), "visible", False), (4, "a", at(9), "hidden", True), (5, "b", at(0), "visible", True), (6, "b", at(3), "visible", False)],
               [(2, "a", at(1), "hidden", False), (3, "a", at(7), "visible", False), (7, "b", at(5), "hidden", True)]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"n={n}"))
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = sorted(tuple(r) for r in streams.finish(streams.engagement(events), ("visitor_id", "date")).collect())
    assert got == [("a", "2024-05-01", 3000, "2024-05-01 10:00:09"), ("b", "2024-05-01", 3000, "2024-05-01 10:00:03")]
