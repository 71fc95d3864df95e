"""The snapshot holds every table, whole or not at all."""

import pytest

from ferrule.operators import ingest
from ferrule.sources.views import TABLES

SF, DATE = "/root/testdata/sf0.001", "2024-01-31"


def test_snapshot_holds_all_tables(spark, tmp_path):
    got = {r.table: r.rows for r in ingest.snapshot_export(spark, SF, str(tmp_path)).collect()}
    assert got == {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in TABLES}
    assert all(ingest.read_snapshot(spark, str(tmp_path), DATE, t).count() == n for t, n in got.items())


def test_a_run_that_ends_half_way_leaves_no_snapshot(spark, tmp_path):
    half = tmp_path / "half"
    half.mkdir()
    for t in TABLES[:3]:
        (half / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        ingest.snapshot_export(spark, str(half), str(tmp_path / "out"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        ingest.read_snapshot(spark, str(tmp_path / "out"), DATE, TABLES[0])
    ingest.snapshot_export(spark, SF, str(tmp_path / "out"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        ingest.snapshot_export(spark, str(half), str(tmp_path / "out"))
    assert ingest.read_snapshot(spark, str(tmp_path / "out"), DATE, TABLES[-1]).count() > 0
