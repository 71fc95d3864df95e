"""Queries on trees read their nodes once."""

import pytest

from ferrule.operators import layout
from ferrule.plans import registry


@pytest.mark.parametrize("name", ["orphan_table_parts", "cell_nest_repair", "content_container"])
def test_nodes_are_read_once(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_linenumber" not in plan.replace("node_boxes", "")


@pytest.mark.parametrize("name", ["element_bbox", "content_container"])
def test_nodes_move_once_by_document(spark, monkeypatch, name):
    """What is written and shuffled for shallow trees does not grow with the rounds."""
    nodes = spark.createDataFrame([(d, n, n // 2 if n > 1 else None) for d in range(30) for n in range(1, 12)], "doc_id long, node_id long, parent_id long")
    boxes = spark.createDataFrame([(d, n, 1.0, 2.0, 3.0, 4.0) for d in range(30) for n in range(6, 12)], "doc_id long, node_id long, x0 double, y0 double, x1 double, y1 double")
    plans, write = [], layout.written
    monkeypatch.setattr(layout, "written", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df))[1])
    got = getattr(layout, name)(nodes, boxes)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert got.count() == {"element_bbox": 330, "content_container": 30}[name]
    assert len(plans) <= 3 and max(p.count("Exchange ") for p in plans) <= 1
