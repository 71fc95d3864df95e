"""Features are computed once, and operators that move fewer or narrower rows give the rows of plain loops."""

import random

from pyspark.sql import functions as F

from ferrule.operators import layout, rules

DOCS = "doc_id long, page_count int, marked boolean, outline_count int, can_copy boolean, can_copy_accessibility boolean, title string, language string, table_parse_error string"
NODES = "doc_id long, node_id long, parent_id long, seq int, raw_role string, scope string, has_headers boolean"


def test_pdf_reports_are_those_of_findings_and_facts(spark, tmp_path):
    docs = spark.createDataFrame([(d, 30, d % 2 == 0, d % 3, True, d % 4 == 0, "untitled" if d % 2 else "A report", None if d % 3 else "en", "bad" if d == 2 else None) for d in range(6)] + [(5, 1, False, 0, False, False, "x", None, None)], DOCS)
    pages = spark.createDataFrame([(d, p, (d * p) % 60, p % 2 == 0) for d in range(5) for p in range(9)], "doc_id long, page int, chars int, has_image boolean")
    annotations = spark.createDataFrame([(d, p, 1, "Link" if p % 2 else "Widget", "here" if d else "") for d in range(4) for p in range(5)], "doc_id long, page int, annot_id int, subtype string, alt string")
    nodes = spark.createDataFrame([(d, n, n // 3 if n else None, n, ["Table", "TR", "TH", "TD", "P"][(n + d) % 5], None, n % 2 == 0) for d in range(5) for n in range(12)], NODES)
    got = rules.pdf_reports(docs, pages, annotations, nodes, str(tmp_path / "a"))
    want = rules.write_reports(rules.rules_pdf(docs, pages, annotations, nodes), rules.pdf_facts(docs, pages, annotations, nodes), str(tmp_path / "b"), rules.pdf_parse_notes(docs, pages))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(got) == rows(want) and len(rows(got)) == 6


def test_a_link_reaches_few_cells(spark):
    """Its rectangle of 288 by 288 points lay in 81 cells of 36 points."""
    link = spark.createDataFrame([(1, 1, 1, "Link", "", 10.0, 10.0, 290.0, 290.0)], "doc_id long, page int, annot_id int, subtype string, alt string, x1 double, y1 double, x2 double, y2 double")
    items = spark.createDataFrame([(1, 1, i, f"w{i}", float(i % 40 * 10), float(i // 40 * 10), 5.0, 5.0) for i in range(1600)], "doc_id long, page int, seq int, str string, x double, y double, w double, h double")
    got = layout.link_text_under_rect(link, items).first().visible_text.split(" ")
    assert sorted(got) == sorted(f"w{i}" for i in range(1600) if 7 <= i % 40 * 10 <= 289 and 7 <= i // 40 * 10 <= 288)
    assert layout.REACH <= 2


def test_table_counters_read_nodes_once_and_equal_a_join(spark, capsys):
    rnd = random.Random(4)
    roles = ["Table", "TR", "TH", "TD", "THead", "P", None]
    made = [(rnd.choice([1, 2, None]), rnd.choice([None, *range(9)]), rnd.choice([None, *range(12)]), 0, rnd.choice(roles), rnd.choice([None, "Row", "Bad"]), rnd.choice([True, False, None])) for _ in range(300)]
    joined = [(c, p) for c in made for p in [p[4] or "" for p in made if None not in (c[0], c[2]) and (p[0], p[1]) == (c[0], c[2])] or [""]]
    names = ("tables", "rows", "th", "td", "nested_cells", "invalid_table_children", "invalid_row_children", "th_without_scope", "invalid_scopes", "valid_scopes", "td_with_headers", "td_without_headers", "stray_rows", "empty_tables")
    want = {}
    for d in (1, 2, None):
        mine = [(c[4], p, c[5], c[6], c[2]) for c, p in joined if c[0] == d]
        n = lambda f: sum(bool(f(*x)) for x in mine)
        cell = ("TH", "TD")
        want[d] = dict(zip(names, (
            n(lambda r, p, s, h, k: r == "Table"), n(lambda r, p, s, h, k: r == "TR"), n(lambda r, p, s, h, k: r == "TH"), n(lambda r, p, s, h, k: r == "TD"), n(lambda r, p, s, h, k: r in cell and p in cell),
            n(lambda r, p, s, h, k: p == "Table" and r and r not in ("TR", "THead", "TBody", "TFoot", "Caption")), n(lambda r, p, s, h, k: p == "TR" and r and r not in cell),
            n(lambda r, p, s, h, k: r == "TH" and s is None), n(lambda r, p, s, h, k: r == "TH" and s == "Bad"), n(lambda r, p, s, h, k: r == "TH" and s == "Row"),
            n(lambda r, p, s, h, k: r == "TD" and h), n(lambda r, p, s, h, k: r == "TD" and h is False), n(lambda r, p, s, h, k: r == "TR" and p not in ("Table", "THead", "TBody", "TFoot")),
            n(lambda r, p, s, h, k: r == "Table") - len({k for r, p, s, h, k in mine if r == "TR" and p == "Table"}))))
    out = layout.table_structure(spark.createDataFrame(made, NODES))
    assert {r.doc_id: {c: r[c] for c in names} for r in out.collect()} == want
    out.explain()
    assert "Join" not in capsys.readouterr().out


def test_blocks_and_images_sort_narrow_rows(spark, capsys):
    rnd = random.Random(9)
    blocks = [(1, p, rnd.choice([None, 0.4, 0.6, 1.2, -0.2, 100.0]), rnd.choice([None, 9.6, 10.4, 29.9, 30.1]), rnd.choice([None, "a", " b  c ", ""])) for p in range(3) for _ in range(80)]
    df = spark.createDataFrame(blocks, "doc_id long, page int, x double, y double, text string")
    once = df.groupBy("doc_id", "page", F.round("x").alias("rx"), F.round("y").alias("ry"), "text").agg(F.min(F.round(F.col("y") / 20) * 20).alias("band"), F.min("x").alias("x"))
    want = once.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("band", "x", "ry", "text"))).alias("b"))
    text = lambda bs: "\n".join(t for t in (" ".join((b.text or "").split()) for b in bs) if t)
    out = layout.block_order(df)
    assert {r.page: r.text for r in out.collect()} == {r.page: text(r.b) for r in want.collect()}
    out.explain()
    assert capsys.readouterr().out.split("Initial Plan")[0].count("Aggregate") == 2  # a partial and a final one
