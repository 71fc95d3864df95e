"""Probes of single rules: titles, markup forms, deep trees, long gaps."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ferrule.operators import html, layout, ledger, rules

FEATURES = dict(n_langs=1, n_headings=1, heading_skips=0, first_level=1, words=9, paragraphs=1, images=0, missing_alt=0, weak_alt=0, links=0, bad_links=0, tables=0, unheaded_tables=0, manual_markers=0)


def test_titles_that_say_nothing(spark):
    weak = ["Document12", "Microsoft Word - draft", "report.docx", "Slide show", "Unspecified", " \tUntitled\n", "", None, "Presentation3", "notes.TXT"]
    titles = [*weak, "Annual report", "Documentary", "Microsoft Word tips"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "doc_id long, title string").withColumns({k: F.lit(v) for k, v in FEATURES.items()})
    got = {r.doc_id: r.status for r in rules.rules_docx(df).where("rule_id = 'docx-title'").collect()}
    assert [got[i] for i in range(len(titles))] == ["warning"] * len(weak) + ["passed"] * 3


def pages(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "page_id long, html string")


def test_markup_forms_give_no_false_findings(spark):
    page = "<html lang='en'><head><title>T</title></head><body><h1><span>Title</span></h1><a href=\"/x\"><b>Annual report 2024</b></a><img alt='A fine picture of a dog'><img alt=\"\"><p>See <b>un</b>usual</p></body></html>"
    got = {r.rule_id: r.status for r in rules.rules_html(pages(spark, page)).collect()}
    assert {k: got[k] for k in ("html-language", "html-alt", "html-links", "html-heading-order", "html-title", "html-h1", "html-fake-heading")} == dict.fromkeys(("html-language", "html-alt", "html-links", "html-heading-order", "html-title", "html-h1", "html-fake-heading"), "passed")
    bad = {r.rule_id: r.status for r in rules.rules_html(pages(spark, "<html><body><img src=x><a href=y><span>Click here</span></a><p><b>Only bold</b></p><h2></h2></body></html>")).collect()}
    assert (bad["html-language"], bad["html-alt"], bad["html-links"], bad["html-fake-heading"], bad["html-heading-order"]) == ("critical", "critical", "warning", "warning", "warning")


def test_elements_reach_to_their_end_tags(spark):
    got = html.elements(pages(spark, "<p>a <b>b</b>c &amp; d</p><ul><li>x<ul><li>y</li></ul></li></ul><img alt='a > b' hidden width=3><p>open <i>i</i><p>next", None, "")).collect()
    assert [(r.tag, r.text) for r in got] == [("p", "a bc & d"), ("b", "b"), ("ul", ""), ("li", "x y"), ("ul", ""), ("li", "y"), ("img", ""), ("p", "open"), ("i", "i"), ("p", "next")]
    assert got[6].attrs == {"alt": "a > b", "hidden": "", "width": "3"}
    blocks = html.html_blocks(pages(spark, "<p>one<br>two <b>bold</b></p><ol><li>n</li></ol><h5>h</h5>")).collect()
    assert [(r.block_type, r.level, r.text) for r in blocks] == [("paragraph", None, "one"), ("paragraph", None, "two bold"), ("numbered", None, "n"), ("heading", 4, "h")]


def test_a_tag_of_very_many_values_is_read(spark):
    page = "<p " + " ".join(f'data-{i}="v"' for i in range(20_000)) + ">text</p>"
    assert [(r.tag, r.text) for r in html.elements(pages(spark, page)).collect()] == [("p", "text")]


NODES = "doc_id long, node_id long, parent_id long, seq int, raw_role string, scope string, has_headers boolean"


def test_deep_tables(spark):
    chain = [(1, 1, None, 0, "Table")] + [(1, i, i - 1, 0, "Sect") for i in range(2, 8)] + [(1, 8, 7, 0, "TR"), (1, 9, 8, 0, "TD"), (2, 1, None, 0, "Sect"), (2, 2, 1, 0, "TR"), (3, 1, 2, 0, "TD"), (3, 2, 1, 0, "TD")]
    df = spark.createDataFrame([(*r, None, False) for r in chain], NODES)
    got = {(r.doc_id, r.node_id, r.issue) for r in layout.orphan_table_parts(df).collect()}
    assert got == {(1, 1, "no_rows"), (2, 2, "no_table"), (3, 1, "no_table"), (3, 2, "no_table")}


def test_cells_in_cells_in_cells(spark):
    rows = [(1, 1, None, 0, "TR"), (1, 2, 1, 0, "TD"), (1, 3, 2, 0, "TD"), (1, 4, 3, 0, "TD"), (1, 5, 1, 1, "TD"), (1, 6, 5, 0, "Span"), (1, 7, 5, 1, "P")]
    got = {r.node_id: (r.new_parent_id, r.new_seq, r.mixed) for r in layout.cell_nest_repair(spark.createDataFrame([(*r, None, False) for r in rows], NODES)).collect()}
    assert got == {2: (1, 1, False), 3: (1, 2, False), 4: (1, 3, False), 5: (1, 4, True)}


def test_boxes_under_an_element_and_the_container(spark):
    rows = [(1, 1, None, 0, "Document"), (1, 2, 1, 0, "Sect"), (1, 3, 2, 0, "P"), (1, 4, 2, 1, "P"), (1, 5, 1, 1, "P"), (1, 6, 2, 2, "P")]
    nodes = spark.createDataFrame([(*r, None, False) for r in rows], NODES)
    boxes = spark.createDataFrame([(1, 3, 0.0, 0.0, 5.0, 5.0), (1, 4, 2.0, 7.0, 9.0, 8.0), (1, 4, 1.0, 6.0, 2.0, 7.0), (1, 5, None, None, None, None)], "doc_id long, node_id long, x0 double, y0 double, x1 double, y1 double")
    got = {r.elem_id: (r.x0, r.y0, r.x1, r.y1) for r in layout.element_bbox(nodes, boxes).collect()}
    assert got == {1: (0, 0, 9, 8), 2: (0, 0, 9, 8), 3: (0, 0, 5, 5), 4: (1, 6, 9, 8)}
    assert [tuple(r) for r in layout.content_container(nodes, boxes).collect()] == [(1, 2, 2)]


@pytest.mark.parametrize("catch_up,reset", [(True, "2026-08-01 08:00:00"), (False, "2024-03-01 08:00:00")])
def test_a_reset_after_thirty_months(spark, catch_up, reset):
    events = spark.createDataFrame([("a", 1, dt.datetime(2024, 1, 1), "deduct", 9), ("a", 2, dt.datetime(2026, 7, 15), "purchase", 0)], "user_id string, seq long, ts timestamp, kind string, amount int")
    users = spark.createDataFrame([("a", "individual", 0, dt.datetime(2024, 1, 1))], "id string, plan string, seats int, created_at timestamp")
    assert {r.seq: r.reset_at for r in ledger.credit_ledger(events, users, catch_up=catch_up).collect()}[2] == reset
