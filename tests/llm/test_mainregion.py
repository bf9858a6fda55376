"""Main text of pages with known parts, and of every test page against its article."""

import html
import os
import re

import pytest

from spoorline.llm import mainregion as m

SF = "/root/testdata/sf0.001"
PLAIN = m.Weights()


def plain(page):
    """The article of a test page, read in another way."""
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1].replace("<br>", " ")
    blocks = re.split(r"</?(?:p|h1)>", inner)
    lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
    return "\n".join(x for x in lines if x)


CASES = [
    ("", ""),
    ("plain words only", "plain words only"),
    ("<p>a</p><p> b \n c </p>", "a\nb c"),
    ("<body><nav>x y z</nav><div class='content'><p>one two<p>three</div><div class=comments>" + "w " * 50, "one two\nthree"),
    ("<div class=ad>buy<article><h1>T</h1><p>a <b>b</b><br>c &amp; d<aside>" + "z " * 30 + "</aside><p>e</article>", "T\na b c & d\ne"),
    ("<main><p>aa<form>q <input> r</form><article>b</article><section class='comments'><article>" + "y " * 9, "b"),
    ("<title>no</title><style>p{}</style><script>if (a<b) '</p>'</script><p>yes</p>", "yes"),
    ("<p title='a>b'>x</p><!-- <p>no</p> --><p>&lt;y&gt;&nbsp;z</p>", "x\n<y> z"),
    ("<footer>only chrome</footer>", ""),
    ("<article><p>" + "long " * 30000 + "</p></article>", " ".join(["long"] * 30000)),
    ("<article>open <ul><li>one<li>two</ul> end", "open\none\ntwo\nend"),
    ("a < b and c > d", "a < b and c > d"),
    ("<div class='page no-sidebar'><p class=byline>by me</p><p>words</p><div id=siteAlert>x</div></div>", "by me\nwords"),
]


@pytest.mark.parametrize("page, want", CASES)
def test_known_pages(page, want):
    assert m.extract(page, PLAIN) == want


def test_best_stretch_equals_all_stretches():
    import random

    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.choice([-2.0, -1.0, 0.0, 1.0, 3.0]) for _ in range(rng.randrange(12))]
        first, last = m.best_stretch(scores)
        best = max([0.0] + [sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)])
        assert sum(scores[first:last]) == best


def test_unmarked_page_uses_learned_places():
    marked = "<body><div class='teaser'>" + "t " * 20 + "</div><article><p>" + "w " * 20 + "</p></article></body>"
    weights = m.learn(m.observed(marked))
    page = "<body><div class='teaser'>" + "t " * 20 + "</div><div class='text'><p>real words here</p></div></body>"
    assert m.extract(page, weights) == "real words here"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_every_page_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = m.extract_pages(pages, m.fit(pages)).collect()
    assert len(got) == pages.count()
    for row in got:
        assert row["text"] == plain(row["html"]) and row["n_chars"] == len(row["text"])


def test_nulls_and_no_rows(spark):
    pages = spark.createDataFrame([(None, None, "x"), (1, "", "y")], "page_id long, html string, places string")
    got = m.extract_pages(pages, m.fit(pages))
    assert [(r["text"], r["n_chars"]) for r in got.collect()] == [("", 0)] * 2
    none = pages.limit(0)
    assert m.extract_pages(none, m.fit(none)).collect() == []
