"""Pages of many elements: memory and time grow with the page, and results are those of a stack."""

import random
import re
import time

from pyspark.sql import functions as F

from ferrule.operators import html, rules

PAGES = "page_id long, html string"


def stack_elements(page):
    """(tag, text before references are decoded) by a plain stack per tag name."""
    tags = [(m.start(), m.end(), m[1] == "/", m[2].lower()) for m in re.finditer(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*>", page)]
    pieces = [page[b : tags[k + 1][0] if k + 1 < len(tags) else len(page)] for k, (_, b, _, _) in enumerate(tags)]
    pieces = [("\x01" if tag == "br" else "" if tag in html.INLINE else " ") + x for (_, _, _, tag), x in zip(tags, pieces)]
    open_tags, ends = {}, {}
    for k, (_, _, close, tag) in enumerate(tags):
        if tag in html.VOID:
            continue
        if not close:
            open_tags.setdefault(tag, []).append(k)
        elif open_tags.get(tag):
            ends[open_tags[tag].pop()] = k
    out = []
    for k, (_, _, close, tag) in enumerate(tags):
        if not close:
            end = ends.get(k) if tag not in html.CONTAINERS else None
            out.append((tag, "".join(pieces[k : end if end is not None else k + 1])))
    return out


def test_elements_equal_a_stack(spark):
    rnd = random.Random(4)
    made = []
    for _ in range(80):
        page, open_tags = [], []
        for _ in range(rnd.randint(0, 80)):
            if open_tags and rnd.random() < 0.4:  # any open tag may end, so that tags cross; some never end
                page.append(f"</{open_tags.pop(rnd.randrange(len(open_tags)))}>")
            else:
                tag = rnd.choice(["p", "li", "b", "div", "br", "/br", "ul", "h2", "img"])
                open_tags += [tag] if tag not in ("br", "/br", "img") else []
                page.append(f"<{tag}>")
            page.append(rnd.choice(["", "x", "some text", " "]))
        made.append("".join(page))
    got = {}
    for r in html.elements(spark.createDataFrame(list(enumerate(made)), PAGES)).orderBy("page_id", "seq").collect():
        got.setdefault(r.page_id, []).append((r.tag, r.marked))
    assert [got.get(i, []) for i in range(len(made))] == [stack_elements(m) for m in made]


def test_a_page_of_a_hundred_thousand_elements(spark):
    n = 50_000
    page = "<html lang='en'><head><title>Long</title></head><body><h1>Long</h1>" + "".join(f"<p>Paragraph {i} of <b>many</b> in one long page</p>" for i in range(n)) + "</body></html>"
    assert len(page) > 2_500_000
    pages = spark.createDataFrame([(1, page), (2, "<p>short</p>")], PAGES)
    start = time.time()
    rows = html.elements(pages).groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()
    assert {(r.page_id, r.tag): r.n for r in rows} == {(1, "html"): 1, (1, "head"): 1, (1, "title"): 1, (1, "body"): 1, (1, "h1"): 1, (1, "p"): n, (1, "b"): n, (2, "p"): 1}
    assert {(r.page_id, r.tag): r.chars for r in rows}[1, "p"] == sum(len(f"Paragraph {i} of many in one long page") for i in range(n))
    assert rules.page_scores(pages).count() == 2 and html.html_blocks(pages).where("page_id = 1 and block_type = 'paragraph'").count() == n
    assert time.time() - start < 120


def test_a_tag_of_many_values_with_an_angle_bracket(spark):
    page = "<p " + " ".join(f"data-{i}='a > b'" for i in range(5_000)) + ">text</p><p title='open>rest</p>"
    assert [(r.tag, r.text) for r in html.elements(spark.createDataFrame([(1, page)], PAGES)).collect()] == [("p", "text"), ("p", "rest")]
