"""Deep trees, cycles and crowded pages against plain loops."""

import random
import time

from pyspark.sql import functions as F

from ferrule.operators import layout

NODES = "doc_id long, node_id long, parent_id long, seq int, raw_role string, scope string, has_headers boolean"
BOXES = "doc_id long, node_id long, x0 double, y0 double, x1 double, y1 double"


def brute_boxes(nodes, boxes):
    """A box per node: the union of the boxes of every node that climbs to it, itself included; on cycles each once."""
    parents = {(d, n): p for d, n, p in nodes}
    out = {}
    for d, n, *box in boxes:
        at, seen = n, set()
        while at is not None and (d, at) in parents and at not in seen:
            seen.add(at)
            old = out.get((d, at), box)
            out[d, at] = [min(old[0], box[0]), min(old[1], box[1]), max(old[2], box[2]), max(old[3], box[3])]
            at = parents[d, at]
    return out


def test_boxes_of_random_trees_with_cycles(spark):
    rnd = random.Random(2)
    nodes = [(d, n, rnd.choice([None, 99, *range(30)]) if rnd.random() < 0.2 else n - rnd.randint(1, 3) if n > 3 else None) for d in range(8) for n in range(30)]
    boxes = [(d, rnd.randrange(31), *(float(rnd.randrange(100)) for _ in range(4))) for d in range(8) for _ in range(25)]
    frame = spark.createDataFrame([(*r, 0, "P", None, False) for r in nodes], NODES)
    for df in (frame, frame.unionByName(frame)):  # repeated rows count once
        got = {(r.doc_id, r.elem_id): [r.x0, r.y0, r.x1, r.y1] for r in layout.element_bbox(df, spark.createDataFrame(boxes, BOXES)).collect()}
        assert got == brute_boxes(nodes, boxes)


def test_a_path_of_ten_thousand_nodes(spark):
    n = 10_000
    nodes = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.lit(0).alias("seq"), F.lit("P").alias("raw_role"), F.lit(None).cast("string").alias("scope"), F.lit(False).alias("has_headers"))
    boxes = spark.createDataFrame([(1, n - 1, 5.0, 5.0, 9.0, 9.0), (1, n // 2, 0.0, 7.0, 1.0, 20.0)], BOXES)
    rows = layout.element_bbox(nodes, boxes)
    assert rows.count() == n
    assert {tuple(r) for r in rows.where("elem_id in (0, 5000, 5001, 9999)").collect()} == {(1, 0, 0.0, 5.0, 9.0, 20.0), (1, 5000, 0.0, 5.0, 9.0, 20.0), (1, 5001, 5.0, 5.0, 9.0, 9.0), (1, 9999, 5.0, 5.0, 9.0, 9.0)}


def test_containers_beside_cycles(spark):
    nodes = [(1, 1, None), (1, 2, 1), (1, 3, 2), (1, 4, 2), (1, 5, 4), (2, 1, 2), (2, 2, 1), (2, 3, None), (2, 4, 1)]
    boxes = [(1, 3, 0.0, 0.0, 1.0, 1.0), (1, 5, 0.0, 0.0, 1.0, 1.0), (2, 4, 0.0, 0.0, 1.0, 1.0)]
    got = layout.content_container(spark.createDataFrame([(*r, 0, "P", None, False) for r in nodes], NODES), spark.createDataFrame(boxes, BOXES)).collect()
    assert {tuple(r) for r in got} == {(1, 2, 2), (2, 3, 0)}


def loop_order(boxes, overlap=0.35):
    """A page's (elem_id, x0, y0, y1) in order, by the plain loop over rows whose band shrinks."""
    rows, low, high = [], 0.0, 0.0
    for elem, x0, y0, y1 in sorted((b for b in boxes if b[3] is not None), key=lambda b: (-b[3], b[0])):
        shared = min(high, y1) - max(low, y0)
        if rows and shared > 0 and shared >= overlap * max(y1 - y0, 1.0):
            rows[-1].append((x0, elem))
            low, high = max(low, y0), min(high, y1)
        else:
            rows.append([(x0, elem)])
            low, high = y0, y1
    return [e for row in rows for _, e in sorted(row, key=lambda r: r[0])] + sorted(b[0] for b in boxes if b[3] is None)


def test_reading_order_of_a_hundred_thousand_boxes(spark):
    rnd = random.Random(8)
    made = {1: 100_000, 2: 3000, 3: 1, 4: 1024}
    boxes = {p: [(i, float(rnd.randrange(600)), y, (y + rnd.randrange(1, 30)) if rnd.random() > 0.01 else None) for i in range(n) for y in [float(rnd.randrange(10_000_000 if n > 50_000 else 5000))]] for p, n in made.items()}
    frame = spark.createDataFrame([(1, p, i, x, y0, y1) for p, bs in boxes.items() for i, x, y0, y1 in bs], "doc_id long, page int, elem_id int, x0 double, y0 double, y1 double")
    start = time.time()
    got = {}
    for r in layout.reading_order(frame).orderBy("page", "order").collect():
        got.setdefault(r.page, []).append((r.order, r.elem_id))
    assert time.time() - start < 90
    for p, bs in boxes.items():
        assert got[p] == list(enumerate(loop_order(bs)))


ANNOTATIONS = "doc_id long, page int, annot_id long, subtype string, alt string, x1 double, y1 double, x2 double, y2 double"
ITEMS = "doc_id long, page int, seq int, str string, x double, y double, w double, h double"


def test_links_over_grids_equal_all_pairs(spark):
    rnd = random.Random(12)
    links = [(1, p, i, rnd.choice(["Link", "Link", "Widget"]), rnd.choice([None, "alt"]), x, y, x + rnd.choice([0, 5, 80, 900, 40_000]), y + rnd.choice([-9, 0, 12, 300])) for p in range(3) for i in range(40) for x, y in [(rnd.uniform(-50, 600), rnd.uniform(-50, 800))]]
    links += [(1, 0, 90, "Link", "no place", None, None, None, None), (2, 0, 1, "Link", None, 0.0, 0.0, 9.0, 9.0)]
    items = [(1, p, i, f"w{i}", float(rnd.randint(-60, 700)), float(rnd.randint(-60, 900)), float(rnd.randint(0, 40)), float(rnd.randint(1, 12))) for p in range(4) for i in range(250)]
    want = {}
    for d, p, i, kind, alt, x1, y1, x2, y2 in links:
        if kind == "Link":
            seen = sorted((x, n, t) for dd, pp, n, t, x, y, w, h in items if x1 is not None and (dd, pp) == (d, p) and x >= x1 - 3 and x + w <= x2 + 4 and y >= y1 - 3 and y + h <= y2 + 3)
            want[d, p, i] = " ".join(t for _, _, t in seen) if seen else alt or ""
    got = layout.link_text_under_rect(spark.createDataFrame(links, ANNOTATIONS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r.doc_id, r.page, r.annot_id): r.visible_text for r in got} == want and len(got) == len(want)


def test_a_page_of_ten_thousand_links_and_a_hundred_thousand_items(spark):
    """Their product is a billion pairs; by cell a link meets the items about it."""
    place = lambda k, n: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)).cast("double")
    items = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(1).alias("page"), F.col("id").cast("int").alias("seq"), F.lit("w").alias("str"), place(1, 20_000).alias("x"), place(2, 20_000).alias("y"), F.lit(8.0).alias("w"), F.lit(8.0).alias("h"))
    links = spark.range(10_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(1).alias("page"), F.col("id").alias("annot_id"), F.lit("Link").alias("subtype"), F.lit("").alias("alt"), place(3, 20_000).alias("x1"), place(4, 20_000).alias("y1")).withColumns({"x2": F.col("x1") + 120, "y2": F.col("y1") + 60})
    start = time.time()
    assert layout.link_text_under_rect(links, items).count() == 10_000
    assert time.time() - start < 60
