"""Wrappers against pages built from known texts: hosts with and without a marked article, repeats of several nodes, copies and lone blocks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ferrule.llm import wrappers
from ferrule.llm.common import Kept

T = "page_id long, url string, html string"


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8))) for _ in range(n))


def page_of(layout, rnd, k):
    """(html, main text) of a random page."""
    title, paras = words(rnd, 4), [words(rnd, rnd.randint(6, 40)) for _ in range(rnd.randint(1, 6))]
    body = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" if i % 2 else f"<p><b>{p}</b>" for i, p in enumerate(paras))
    text = [title, *paras]
    side = "".join(f"<li><a href='/{i}'>{words(rnd, 2)}</a></li>" for i in range(rnd.randint(2, 5)))
    if layout == "article":
        html = f"<nav><ul>{side}</ul></nav><div>{words(rnd, 9)}</div><article>{body}<aside>{words(rnd, 4)}</aside><div class='comments'><p>{words(rnd, 5)}</p></div></article><div>{words(rnd, 7)}</div><footer>f</footer>"
    elif layout == "plain":  # nothing but the wrapper tells the list of links, and the greeting, from the text
        html = f"<div class='x1'><p>Welcome to the site</p></div><table><tr><td><div>{words(rnd, 2)}</div></td></tr></table><div class='text post-{k}'>{body}</div><div class='x2'><p>All rights kept</p></div>"
    elif layout == "flat":
        html = f"<div>Site name</div>{body}<div>All rights kept</div>"
    else:  # groups: a heading and two blocks, over and over
        parts = [(words(rnd, 3), words(rnd, 12), words(rnd, 3)) for _ in range(rnd.randint(1, 4))]
        html = "<div>Site name</div>" + "".join(f"<h2>{a}</h2><p>{b}</p><blockquote>{c}</blockquote>" for a, b, c in parts)
        text = [x for p in parts for x in p]
    return f"<html><head><title>{title}</title></head><body>{html}</body></html>", "\n".join(text)


@pytest.fixture(scope="module")
def site():
    rnd = random.Random(3)
    rows, want = [], {}
    for layout in ("article", "plain", "flat", "groups"):
        for k in range(24):
            html, text = page_of(layout, rnd, k)
            for copy in range(1 + (k == 5)):
                i = len(rows)
                rows.append((i, f"http://{layout}.example/{k}?{copy}", html))
                want[i] = text
    return rows, want


def test_texts_of_known_pages(spark, site, monkeypatch):
    rows, want = site
    df = spark.createDataFrame(rows, T).repartition(5).withColumn("host", F.lit(1)).withColumn("wrapper", F.lit("x"))
    got = {r.page_id: r.text for r in wrappers.main_texts(df, Kept(spark, "t")).collect()}
    assert got == want
    monkeypatch.setattr(wrappers, "BROADCAST_CHARS", 0)
    assert {r.page_id: r.text for r in wrappers.main_texts(df, Kept(spark, "t")).collect()} == want


def test_the_wrapper_decides(site):
    rows, want = site
    bare = wrappers.Template([])
    changed = {url.split(".")[0][7:] for i, url, html in rows if bare.extract(html) != want[i]}
    assert changed == {"article", "plain", "flat", "groups"}


def test_repeats_of_several_nodes():
    one = lambda tag, text: ["e", f"{tag}.", [["t", text, ["p"], 1]]]
    folded = wrappers.fold([one("h2", "a"), one("p", "b"), one("p", "c"), one("h2", "d"), one("p", "e"), one("p", "f"), one("h2", "g"), one("p", "h")])
    assert len(folded) == 1 and folded[0][0] == "+" and [wrappers.key(x) for x in folded[0][1]] == ["h2.", "p."]
    single = wrappers.fold([one("h2", "x"), one("p", "y")])
    assert wrappers.align(folded, single)[0][0] == "+" and len(wrappers.align(single, folded)) == 1
    lacking = wrappers.align([one("nav", "m"), one("p", "x")], [one("nav", "m"), one("aside", "s"), one("p", "y")])
    assert [x[0] for x in lacking] == ["e", "?", "e"] and lacking[0][2][0][1] == "m" and lacking[2][2][0][1] is None


def test_long_and_deep_pages(spark):
    deep = "<body>" + "<div>" * 5000 + "deep text" + "</div>" * 5000 + "</body>"
    long = "<body><article>" + "".join(f"<p>paragraph {i}" for i in range(30_000)) + "</article></body>"
    rows = [(1, "http://d.example/1", deep), (2, "http://l.example/1", long), (3, None, "<p>x"), (None, "http://l.example/2", None), (5, "nonsense", "<article"), (6, "http://e.example", "")]
    got = {r.page_id: r.text for r in wrappers.main_texts(spark.createDataFrame(rows, T), Kept(spark, "t")).collect()}
    assert got == {1: "deep text", 2: "\n".join(f"paragraph {i}" for i in range(30_000)), 3: "x", None: "", 5: "", 6: ""}


def test_the_query_has_the_contract_columns(spark):
    from pathlib import Path

    sf = "/root/testdata/sf0.001"
    out = wrappers.op7_page_text(spark, sf)
    rows = out.collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert Path(sf).exists() and out.columns[:4] == ["page_id", "url", "text", "n_chars"] and len(rows) == len(pages)
    assert all(r.url == pages[r.page_id].url and r.n_chars == len(r.text) and "<" not in r.text for r in rows)
    parts = [p.split("</article>")[0] for r in rows for p in pages[r.page_id].html.split("<article>")[1:]]
    assert len(parts) == len(rows) and json.dumps(parts)
