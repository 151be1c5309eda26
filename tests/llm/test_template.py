"""Templates and main texts."""

import html
import os
import re
import time

import pytest

from quillstack.llm import template

DATA = "/root/testdata/sf0.01"


def text(page, *known):
    return " ".join(t for t, _ in template.slots(template.parse(page), *known))


def extracted(spark, pages):
    return {r["page_id"]: r["text"] for r in template.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (None, ""),
        ("", ""),
        ("just text &amp; more", "just text & more"),
        ("<article><h1>A &amp;amp; B</h1><p>x<b>y</b>z<br>q</p></article>", "A &amp; B xyz q"),
        ("<article><p>one<p>two<ul><li>a<li>b</ul></article>tail", "one two a b"),
        ("<nav><a href=x>menu</a></nav><article>text</article><footer>&copy;</footer>", "text"),
        ("<article>t<script>var a='<p>no</p>';</script><style>p{}</style><!-- <p>no --> u</article>", "t u"),
        ("<SCRIPT>no</SCRIPT><Main>yes<aside>no</aside></MAIN>no", "yes"),
        ('<article>a<div class="reader-comments"><p>no</p></div><div id=comments>no</div><section class=cookie-notice>no</section>b</article>', "a b"),
        ('<article>a<form>no</form><div role="navigation">no</div><p hidden>no</p><div aria-hidden="true">no</div><p style="display: none">no</p>b</article>', "a b"),
        ("<body class='has-sidebar'><div class='ad-wrap'><article>in</article></div></body>", "in"),
        ('<article><header class="entry-header"><h1>T</h1></header>a<div id="sideBar">no</div><div class="AdBox">no</div><ol class=commentlist><li>no</ol>b<p class="loading adder">c</p></article>', "T a b c"),
        ('<div class="page-header">no</div><p>yes</p><div id="siteFooter2">no</div>', "yes"),
        ("<aside><article>teaser</article></aside><article>real</article>", "real"),
        ("<header>site</header><article><header><h1>Title</h1></header>text</article>", "Title text"),
        ("<article>a &lt;b&gt; &#233; &eacute;&nbsp; c &unknown; &</article>", "a <b> é é c &unknown; &"),
        ("<article>x < y and <3 > z</article>", "x < y and <3 > z"),
        ("<article><p>never closed", "never closed"),
        ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1 2 3"),
        ("<article>a<img alt='>' src=\"x\">b<wbr>c</article>", "abc"),
        ("<p>one</p><ul class=menu><li>no</ul><p>two</p>", "one two"),
    ],
)
def test_main_text(page, expected):
    assert text(page) == expected


def test_long_pages_are_whole():
    words = " ".join(f"w{i}" for i in range(200_000))
    assert text(f"<article><p>{words}</p></article>") == words


def site(k):
    return f"<html><body><div class=top><p>Our Site</p><p>All rights kept</p></div><div class=x><p>story {k} begins</p><p>and ends {k * 7}</p></div><div><p>Contact us</p></div></body></html>"


def test_texts_of_the_template_go(spark):
    pages = [(k, f"http://one.example/{k}", site(k)) for k in range(12)] + [(100, "http://two.example/", site(100)), (101, None, site(101)), (102, None, None), (3, "http://one.example/3", site(3))]
    table = spark.createDataFrame([(h, u, i, "h", 1) for i, u, h in pages], "html string, url string, page_id long, host string, template int")
    found = template.extract(table).collect()
    by_id = {r["page_id"]: r["text"] for r in found}
    assert len(found) == len(pages)
    for k in range(12):
        assert by_id[k] == f"story {k} begins and ends {k * 7}"
    assert by_id[100] == "Our Site All rights kept story 100 begins and ends 700 Contact us"  # the only page of its host
    assert by_id[102] == ""
    assert all(r["n_chars"] == len(r["text"]) for r in found)


def test_occurrence_vectors(spark):
    """Tokens meet in a class exactly if they stand on the same pages as often."""
    pages = [(k, "h", "<div><p>a</p>" + "<ul><li>x</li></ul>" * (k % 3) + "<h2>b</h2></div>") for k in range(9)]
    rows = template.classes(spark.createDataFrame(pages, "id long, host string, html string").select("host", "id", "html")).collect()
    counted, chars = {}, {}
    for k, _, page in pages:
        for e in template.parse(page).elements:
            own = counted.setdefault(e.path, {})
            own[k] = own.get(k, 0) + 1
    exact = {}
    for token, vector in counted.items():
        exact.setdefault(tuple(sorted(vector.items())), set()).add(token)
    found = {}
    for r in rows:
        found.setdefault((r["pages"], r["v1"], r["v2"]), set()).add(r["token"])
        chars[r["token"]] = r["chars"]
        assert r["occurs"] == sum(counted[r["token"]].values())
    assert sorted(map(sorted, exact.values())) == sorted(map(sorted, found.values()))
    assert len(exact) == 2  # the page with its paragraph and heading, its lists
    assert chars[0] == 9 * 2 + 9


def test_straddling_classes_are_no_template():
    import pandas as pd

    rows = [("h", t, 2, v, 0, f * 2, l * 2) for t, v, f, l in [(1, 1, 0, 0), (2, 1, 9, 9), (3, 2, 2, 2), (4, 2, 5, 5), (5, 3, 4, 4), (6, 3, 7, 7)]]
    group = pd.DataFrame(rows, columns=["host", "token", "pages", "v1", "v2", "first", "last"])
    assert template.nested(group) == {1, 2, 3, 4}


def test_no_rows(spark):
    assert template.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_template_decides_inside_articles(spark):
    """Boilerplate under a neutral class goes, though it is inside the article."""
    page = "<article><p>story {0} begins</p><div class=x><p>Read our app</p></div><p>and ends {0}</p></article>"
    pages = [(k, f"http://one.example/{k}", page.format(k)) for k in range(4)]
    assert extracted(spark, pages) == {k: f"story {k} begins and ends {k}" for k in range(4)}
    alone = extracted(spark, pages[:1])  # a page without a template keeps it: the template decides
    assert alone == {0: "story 0 begins Read our app and ends 0"}


def test_the_slot_with_the_text_that_differs_is_the_article(spark):
    """No tag tells where the article is, and class names mislead."""
    page = (
        "<div class=content><p>Welcome to our site, where we have kept the same long greeting on every single page for years and years.</p></div>"
        "<div class='sidebar comments'><div class=notice><h1>Title {0}</h1><p>story {0} begins with <a href=x>word {1}</a> and more</p><ul><li><a href=y>source {1}</a></ul></div>"
        "<div class=share><p>Tell {0} friends</p></div></div>"
        "<div class=main><p>Ad {1}</p></div>"
    )
    pages = [(k, f"http://one.example/{k}", page.format(k, k * k)) for k in range(8)]
    assert extracted(spark, pages) == {k: f"Title {k} story {k} begins with word {k * k} and more source {k * k}" for k in range(8)}
    # the same page without its host: its names are all there is
    assert "story" not in text(pages[0][2])


def test_named_elements_go_on_however_many_pages(spark):
    page = "<div class=x><h1>T {0}</h1><p>a long story with the number {0}</p>{1}</div><p>bottom</p>"
    extra = lambda k: "<div class=comments><p>reader {0}</p></div>".format(k) if k % 2 else "<div class=notice>gone {0}</div>".format(k) if k == 4 else ""
    pages = [(k, "http://one.example/", page.format(k, extra(k))) for k in range(10)]
    assert extracted(spark, pages) == {k: f"T {k} a long story with the number {k}" for k in range(10)}


@pytest.mark.parametrize("tag", ["div class=x", "article"])
@pytest.mark.parametrize("title", ["<h1>T {0}</h1>", ""])
@pytest.mark.parametrize(("times", "on"), [(1, {3}), (1, {3, 7}), (40, {3}), (40, set(range(12))), (400, set(range(12)))])
def test_rare_and_long_asides_go(spark, tag, title, times, on):
    """Comments and adverts on one page of twelve, on all of them, or many times as long as the article; with a heading of their own."""
    page = f"<body><div class=menu-like><p>Home</p></div><{tag}>{title}<p>the story of {{0}} is told here</p>{{1}}<p>and ends {{0}}</p></{tag.split()[0]}></body>"
    aside = lambda k: f"<section class=comments><h2>{k} comments</h2>" + "".join(f"<div class=c><p>reader {k} {n} says</p></div>" for n in range(times)) + f"</section><div class=advert>buy {k}</div>"
    pages = [(k, f"http://one.example/{k}", page.format(k, aside(k) if k in on else "")) for k in range(12)]
    told = lambda k: (f"T {k} " if title else "") + f"the story of {k} is told here and ends {k}"
    assert extracted(spark, pages) == {k: told(k) for k in range(12)}
    assert extracted(spark, pages[:2]) == {k: ("" if "article" in tag else "Home ") + told(k) for k in range(2)}  # too few for a template


def test_comments_beside_the_article_go(spark):
    """Ten times as long, and not inside the article's element."""
    page = "<div class=top><p>Site</p></div><div class=story><h1>T {0}</h1><p>the story of {0}</p></div><div id=comments>{1}</div>"
    pages = [(k, f"http://one.example/{k}", page.format(k, "".join(f"<p>reader {k} {n} writes at length</p>" for n in range(30)))) for k in range(8)]
    assert extracted(spark, pages) == {k: f"T {k} the story of {k}" for k in range(8)}


def test_names_that_mislead(spark):
    """All that differs is in elements named as asides, with a title or without one; and a title that one page alone has in one."""
    board = "<div class=top><p>Town hall</p></div><div class=x>{0}</div>"
    notices = lambda k: "".join(f"<div class=notice><p>decision {k} of {n}</p></div>" for n in range(3))
    pages = [(k, f"http://one.example/{k}", board.format(notices(k))) for k in range(6)]
    assert extracted(spark, pages) == {k: " ".join(f"decision {k} of {n}" for n in range(3)) for k in range(6)}
    page = "<div class=x><div class=banner><h1>T {0}</h1><p>the story of {0}</p></div><div class=share>share {0}</div><p>more of {0}</p></div>"
    pages = [(k, f"http://two.example/{k}", page.format(k)) for k in range(6)]
    assert extracted(spark, pages) == {k: f"T {k} the story of {k} more of {k}" for k in range(6)}
    plain = "<div class=x><h1>T {0}</h1><p>the story of {0}</p></div>"
    pages = [(k, f"http://three.example/{k}", plain.format(k)) for k in range(150)] + [(150, "http://three.example/150", "<div class=x><div class=banner><h1>T 150</h1></div><p>the story of 150</p><div class=share>tell</div></div>")]
    assert extracted(spark, pages)[150] == "T 150 the story of 150"


def test_copies_of_one_page_are_no_template(spark):
    """Pages that differ by their adverts only, and a host of near copies."""
    copy = "<div class=ad>Ad {0}</div><div class=x><h1>Title</h1><p>The very same story, told again and again, at some length.</p></div>"
    pages = [(k, "http://one.example/", copy.format(k)) for k in range(9)]
    found = extracted(spark, pages)
    assert all("The very same story" in t for t in found.values())
    near = [(k, "http://two.example/", f"<article><h1>Title</h1><p>{'The story. ' * 9}</p><p>{k}</p></article>") for k in range(3)]
    assert all(t.startswith("Title The story.") for t in extracted(spark, near).values())


HOSTILE = [
    "<script " * 100_000, "<a " * 100_000, "<b>x</i>" * 100_000, '<a x=">"' * 100_000, "<script>" + "</script " * 100_000, "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000, "<select>" * 50_000,
    "<div>" * 50_000, "<p " + " " * 200_000 + ">x", "<a ='" * 100_000 + ">", "<div class='" + "ad " * 100_000 + "'>x</div>", "<article>x</p></div>" * 40_000, "&#" + "9" * 5000 + "; x",
]


@pytest.mark.parametrize("page", HOSTILE, ids=lambda p: p[:12])
def test_broken_pages_take_linear_time(page):
    began = time.process_time()
    found = template.parse(page)
    template.slots(found)
    template.tokens(found)
    assert time.process_time() - began < 4


def test_deep_pages_have_a_template(spark):
    pages = [(k, "http://one.example/", "<div>" * 3000 + f"story {k}") for k in range(4)]
    assert extracted(spark, pages) == {k: f"story {k}" for k in range(4)}




def test_copies_are_one_page(spark):
    """What only copies of a page share, or two pages, is text, not template."""
    copied = "<div class=x><p>a real text</p></div>"
    pages = [(k, "http://one.example/a", copied) for k in range(6)] + [(k, f"http://one.example/{k}", f"<div class=x><p>other {k}</p></div>") for k in (6, 7, 8)]
    pages += [(20, None, copied), (21, None, copied), (30, "http://two.example/", "<p>same</p><p>one</p>"), (31, "http://two.example/", "<p>same</p><p>two</p>")]
    expected = {k: "a real text" for k in (*range(6), 20, 21)} | {k: f"other {k}" for k in (6, 7, 8)} | {30: "same one", 31: "same two"}
    assert extracted(spark, pages) == expected


@pytest.mark.parametrize("name", ["class='related-work'", "id=related-work", "id=social-history", "class=reply-to-objections"])
def test_sections_of_an_article_stay(name):
    assert text(f"<article>a<section {name}>b</section></article>") == "a b"
    assert text("<p>one</p><ul><li><a href=x>a cited paper</a></li></ul>") == "one a cited paper"


@pytest.mark.parametrize("name", ["share-buttons", "related-posts", "commentlist", "side-bar", "sideBar", "social", "comment-12"])
def test_asides_of_an_article_go(name):
    assert text(f"<article>a<div class='x {name}'>b</div></article>") == "a"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_articles_of_the_test_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    found = {r["page_id"]: r["text"] for r in template.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.DOTALL)[1]
        assert found[r["page_id"]] == " ".join(html.unescape(re.sub("<[^>]*>", " ", article)).split())
