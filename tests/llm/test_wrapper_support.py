"""Only what pages of different content agree on is a host's boilerplate."""

from ferrule.llm import wrappers
from ferrule.llm.common import Kept


def test_lone_blocks_and_copied_pages_keep_their_text(spark):
    page = lambda *p: "<body><div>Site name</div>" + "".join(p) + "</body>"
    rows = [(1, "http://a.example/1", page("<p>one</p>", "<blockquote>alone</blockquote>")), (2, "http://a.example/2", page("<p>two</p>")), (3, "http://a.example/3", page("<p>three</p>")),
            (4, "http://b.example/1", page("<p>same</p>")), (5, "http://b.example/1?x", page("<p>same</p>")), (6, "http://c.example/1", page()), (7, "http://c.example/2", page("<p>x</p>"))]
    got = {r.page_id: r.text for r in wrappers.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string"), Kept(spark, "t")).collect()}
    assert got == {1: "one\nalone", 2: "two", 3: "three", 4: "Site name\nsame", 5: "Site name\nsame", 6: "Site name", 7: "x"}
