"""Broken, odd and misleadingly marked pages."""

import time

import pytest

from cohortspark.llm.html import Page, extract_pages

BODY = "<h1>A title</h1><p>The first paragraph of the article, long enough to count as one, with some words more.</p><p>The second one, also long enough, so that it counts.</p>"
TEXT = "A title\nThe first paragraph of the article, long enough to count as one, with some words more.\nThe second one, also long enough, so that it counts."
RAW = [
    "<script>for(var i=0;i<n;i++){x()}</script>", "<script>if (a <b) { <!-- y() }</script>", '<script type="application/ld+json">{"a": "x<y"}</script>', "<style>p<q{}</style>",
    "<SCRIPT>a<b</SCRIPT >", "<script>s = '</p><article>'</script>", "<noscript><p>Turn scripts on, please, or this page does not work at all.</p></noscript>", "<!-- <article> -->", "<!--> ", "<!doctype html>", "<?xml version='1.0'?>",
]


@pytest.mark.parametrize("raw", RAW)
def test_tags_are_not_sought_in_scripts_and_comments(raw):
    assert Page(f"<body>{raw}<article>{BODY}</article><footer>foot</footer></body>").extract(None) == TEXT
    assert Page(f"<body><article>{BODY}{raw}</article></body>").extract(None) == TEXT


@pytest.mark.parametrize("wrap", ["div class='related'", "div class='social'", "div class='content with-sidebar'", "section class='share'", "div id='header-fixed'"])
def test_marks_round_everything_say_nothing(wrap):
    assert Page(f"<body><{wrap}>{BODY}</{wrap.split()[0]}></body>").extract(None) == TEXT


def test_marked_prose_inside_the_article_stays():
    extra = "<div class='social-history'><p>A paragraph on social history that is long enough to be prose, as it has a good eighty characters.</p><p>And one more.</p></div>"
    told = "A paragraph on social history that is long enough to be prose, as it has a good eighty characters.\nAnd one more."
    assert Page(f"<body><article>{BODY}{extra}</article></body>").extract(None) == f"{TEXT}\n{told}"
    assert Page(f"<body><article>{BODY}<p>A <span class='comment'>word</span> and a <label>label</label> in a line.</p></article></body>").extract(None) == f"{TEXT}\nA word and a label in a line."


@pytest.mark.parametrize("other", [
    "<div class='share'><a href='x'>Tweet</a> <a href='y'>Post</a></div>", "<div class='ad'>Buy this now, it is cheap.</div>", "<ul class='related-links'><li><a href='x'>More</a></li></ul>", "<nav>Home</nav>",
    "<section class='comments'><p>I read this with great joy and would like to tell you so, dear author, at some length.</p></section>", "<aside>Side</aside>", "<form>Name <input></form>", "<div class='cookie-notice'>We use cookies.</div>",
])
def test_what_is_not_the_article_goes(other):
    assert Page(f"<body><article>{BODY}{other}</article></body>").extract(None) == TEXT


@pytest.mark.parametrize("part", ["<a", '<b x="', "<b x='", "<!", "<!--", "</", "<", "<a b='\"", '<p x="y"', "<a\n", "&", "<p>", "<div><span>"])
def test_broken_pages_take_linear_time(part):
    began = time.time()
    page = Page(f"<body><article>{BODY}</article>" + part * (1_000_000 // len(part)))
    assert page.extract(None).startswith(TEXT[:7])
    assert time.time() - began < 20


def test_cut_off_and_stray_marks():
    assert Page("<p>one <b>two").extract(None) == "one two"
    assert Page("<p>one two <a hre").extract(None) == "one two <a hre"
    assert Page("<p>1 < 2 and 3 <4, a<b <i>so</i></p>").extract(None) == "1 < 2 and 3 <4, a<b so"
    assert Page('<p>x <a href="y>link</a> z</p>').extract(None) == "x link z"
    assert Page("<p>x <a title='a > b'>link</a> z</p>").extract(None) == "x link z"


def test_in_spark(spark):
    rows = [(k, f"http://h{k % 2}.example/x", f"<body>{raw}<article>{BODY}</article></body>") for k, raw in enumerate(RAW)] + [(None, None, None)]
    out = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).toPandas()
    assert set(out.dropna()["text"]) == {TEXT} and (out[out["page_id"].isna()]["n_chars"] == 0).all()
