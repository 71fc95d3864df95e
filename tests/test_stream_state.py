"""State of passed days leaves the streams."""

import datetime as dt
import glob
import os

from pyspark.sql import functions as F

from ferrule.sources.shared import shared_dir
from ferrule.streaming import streams

SF = "/root/testdata/sf0.001"


def test_engagement_keeps_no_passed_days(spark):
    root = shared_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{root}/stream-*"))
    assert streams.stream_engagement(spark, SF).count() > 0
    (folder,) = set(glob.glob(f"{root}/stream-*")) - before
    state = spark.read.format("statestore").load(os.path.join(folder, "state"))
    newest = spark.read.parquet(f"{SF}/events.parquet").agg(F.max(F.to_date("ts"))).first()[0]
    dates = [r.date for r in state.select("key.date").distinct().collect()]
    # the watermark is a day behind the newest event: the day before the newest may be open still, all others are gone
    assert dates and all((newest - dt.date.fromisoformat(d)).days <= 1 for d in dates)
