"""What belongs to an article stays: shared headings, telling class names, its header, odd attributes; raw and nested elements go."""

import pytest

from ferrule.llm import wrappers
from ferrule.llm.common import Kept

BARE = wrappers.Template([])


@pytest.mark.parametrize("inside, want", [
    ("<p title=don't>First para</p><p>Second para isn't</p><p>Third</p>", ["First para", "Second para isn't", "Third"]),
    ("<p title=x=\"y>One</p><p>Two \"quoted\"</p>", ["One", 'Two "quoted"']),
    ("<p title='a > b' data-x=\"c > d\">One</p>", ["One"]),
    ("<p title=' class=ad '>One</p><p class=ad>Buy</p>", ["One"]),
    ("<header><h1>Headline</h1><nav>x</nav></header><p>Text</p>", ["Headline", "Text"]),
    ("<div class='article-header'><h1>Headline</h1></div><p>Text</p>", ["Headline", "Text"]),
    ("<h1>H</h1><p class='notice-period'>a</p><div class='related-work'><p>b</p></div><div class='form-group'><p>c</p></div><p id='comments-on-theory'>d</p>", ["H", "a", "b", "c", "d"]),
    ("<p>a</p><div class='big comment-list'>x</div><div id='comments'>x</div><div class='ad-slot-3'>x</div><div class='share_buttons'>x</div><div class='cookie-notice'>x</div>", ["a"]),
    ("<p>a</p><script/>var x = 'leak';</script><p>b</p>", ["a", "b"]),
    ("<p>a</p><svg><svg><text>in</text></svg><text>leak</text></svg><p>b</p>", ["a", "b"]),
    ("<p>a</p><svg/><p>b</p><SCRIPT>if (a</SCRIPT >", ["a", "b"]),
    ("<p>a</p><script>'<script>'</script><p>b</p><template><template>x</template>leak</template>", ["a", "b"]),
    ("<p class>a</p><p class= >b</p><p =x>c</p>", ["a", "b", "c"]),
])
def test_blocks_of_an_article(inside, want):
    page = f"<html><body><nav>menu</nav><header><h1>Site</h1></header><article>{inside}</article><footer>end</footer></body></html>"
    assert BARE.extract(page).split("\n") == want
    assert wrappers.Template(wrappers.page_wrapper(page)).extract(page).split("\n") == want


@pytest.mark.parametrize("around", ["article", "div"])
def test_what_articles_share_stays(spark, around):
    """Eight pages of one host share headings and a closing line; the menu that they share too is no part of the region."""
    body = lambda i: f"<h1>Title {i}</h1><h2>Abstract</h2><p>Paragraph {i} of its own {'words ' * (20 + i)}</p><h2>Recipe</h2><p>Serve hot.</p>"
    page = lambda i: f"<html><body><div class='x'>Site menu</div><{around} class='y'>{body(i)}</{around}><div class='z'>Imprint</div></body></html>"
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", page(i)) for i in range(8)], "page_id long, url string, html string")
    for r in wrappers.main_texts(pages, Kept(spark, "t")).collect():
        assert r.text.split("\n") == [f"Title {r.page_id}", "Abstract", f"Paragraph {r.page_id} of its own {'words ' * (20 + r.page_id)}".strip(), "Recipe", "Serve hot."]


def test_many_quotes_and_tags_take_linear_time():
    assert BARE.extract("<article>" + "<p a=\"" * 20_000 + "</article>") == ""
    assert BARE.extract("<article><p>a</p>" + "<svg>" * 20_000 + "</article>") == "a"
    assert len(BARE.extract("<article>" + "<p title=a'b>x y</p>" * 20_000 + "</article>").split("\n")) == 20_000
