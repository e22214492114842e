import math
import random
import time
from collections import defaultdict

import pytest

from filigree.llm.html_extraction import blocks, extract, host_of, main_text, removed_branches, style_tree

NAV = '<nav><ul><li><a href="/a">A</a></li></ul></nav>'


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""), ("", ""), ("plain   text", "plain text"), ("<p>a &amp; b&nbsp;&#233;<p>c<br>d", "a & b é\n\nc d"),
        (f"<body><header>h</header>{NAV}<article><h1>T</h1><p><b>x<br><p>y</article><footer>f</footer>", "T\n\nx\n\ny"),
        ('<article><p>a</p><div class="ad">buy</div><aside>s</aside><form><p>f</p></form><section id="comments"><p>c</p></section><p>z</p></article>', "a\n\nz"),
        ("<article><p>a<!-- x > y --><script>var t='</p>';</script> b</p><style>p{}</style></article>", "a b"),
        ('<div class="content"><ul><li>one<li>two</ul><table><tr><td>1<td>2</table></div>', "one\n\ntwo\n\n1\n\n2"),
        ("<article><p>un<b>closed <i>tags</article><p>after</p>", "unclosed tags"), ("</div></p><p>stray</p>", "stray"), ("<p title='a > b'>q</p>", "q"), ('<div class="header-title">keep</div>', "keep"),
        ("<article><header><h1>H</h1></header><p>p</p></article>", "H\n\np"),
    ],
)
def test_extract(page, want):
    assert extract(page) == want


def test_style_tree_removes_what_all_pages_say(spark):
    pages = [(i, "http://h.com/x", f"<body><div class='strip'>Same offer on all pages</div><div class='story'><p>Story {i} with {i * 7} words of its own, quite long</p></div></body>") for i in range(12)]
    pages += [(100 + i, "http://other.com", pages[0][2]) for i in range(12)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert [(r.host, r.path) for r in removed_branches(df).collect()] == [("h.com", "body/div.strip")]
    out = {r.page_id: r.text for r in main_text(df).collect()}
    assert out[3] == "Story 3 with 21 words of its own, quite long" and out[105].startswith("Same offer")


def test_rows(spark):
    rows = [(1, None, None, "x"), (2, "bad://[", "<p>a</p>", "y"), (2, "bad://[", "<p>a</p>", "y"), (3, "HTTP://U:p@Host.com:80/a", "<p>" + "b " * 20000 + "</p>", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumnRenamed("text", "host")
    out = main_text(df).collect()
    assert sorted((r.page_id, r.n_chars) for r in out) == [(1, 0), (2, 1), (2, 1), (3, 39999)] and all(r.n_chars == len(r.text) for r in out)
    assert main_text(df.limit(0)).count() == 0
    assert host_of("HTTP://U:p@Host.com:80/a") == "host.com" and host_of(None) == ""


@pytest.mark.parametrize("page", ["<div><p>x</p></div>" * 20000, "<script " * 50000, "<a " * 50000, '<p "' * 50000, "<p title='" * 50000, "<" * 200000, "</div>" * 50000, "<div>x" * 20000, "<b><i>" * 20000 + "</p>" * 20000, "<!--" * 50000, '<div class="menu">' * 20000 + "x", "<script>" * 20000, "&amp" * 50000, "=\"" * 1000 + "<p a=\"" * 30000])
def test_long_and_broken_pages_are_linear(page):
    began = time.process_time()
    blocks(page)
    assert time.process_time() - began < 4


def test_deep_paths_stay_short():
    found = blocks("<article>" + "<div>x" * 3000)
    assert len(found) == 3000 and max(len(p) for p, *_ in found) < 700 and all(i for _, i, _ in found)


@pytest.mark.parametrize("name", ["content no-sidebar", "with-sidebar", "social-sciences", "search-engine-history", "notice-of-intent", "main-content", "header-title", "post-content", "article-body", "commentary", "admission"])
def test_names_that_only_hold_a_word_of_noise(name):
    assert extract(f'<div class="{name}"><p>Real article</p></div><p>x</p>') == "Real article\n\nx"
    assert extract(f'<article><p>a</p><section class="{name}"><p>b</p></section></article>') == "a\n\nb"


@pytest.mark.parametrize("name", ["ad", "site-nav", "left-sidebar", "page_footer", "comment-list", "comments-area", "cookie-banner", "cookie-notice", "share-buttons", "related-posts-widget", "top-menu", "search-form", "col ads"])
def test_names_of_noise(name):
    assert extract(f'<article><p>a long enough text</p><div class="{name}"><p>b</p></div></article>') == "a long enough text"


def test_a_name_never_removes_most_of_a_page():
    assert extract('<div class="widget"><p>the whole of the text is here</p><div class="share">tweet</div></div><div class="ad">buy</div>') == "the whole of the text is here"


def test_several_articles_are_weighed():
    assert extract('<div class="content"><p>main text of the page</p></div><article class="teaser">more</article>') == "main text of the page\n\nmore"
    assert extract("<p>x</p><article>one two three</article><article>four five six</article>") == "one two three\n\nfour five six"


def test_numbered_ids_are_one_node(spark):
    pages = [(i, "http://h.com/x", f"<body><article id='post-{i}'><p>Story {i} with {i * 7} words of its own, quite long</p><div class='note-{i}'>Same words below each story</div></article></body>") for i in range(12)]
    out = [r.text for r in main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).orderBy("page_id").collect()]
    assert out == [f"Story {i} with {i * 7} words of its own, quite long" for i in range(12)]


def test_tree_against_brute_force(spark):
    r = random.Random(5)
    pages = []
    for i in range(60):
        strip = f"<div class='strip'>{r.choice(['Buy now', 'Buy now', 'Buy now', 'Deal'])}</div>" if r.random() < 0.8 else ""
        pages.append((i, f"http://h{i % 3}.com/x", f"<body>{strip}<div class='story'><h2>Head {r.randrange(30)}</h2><p>Body {r.randrange(10**6)} of the page with words</p></div><div class='b{i % 2}'>Tail</div></body>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    want = {}
    for h in range(3):
        texts, on = defaultdict(set), defaultdict(set)
        for i, _, page in pages:
            if i % 3 == h:
                for path, _, text in blocks(page):
                    texts[path, text].add(page)
                    on[path].add(page)
        for path in on:
            cs = [len(v) for (q, _), v in texts.items() if q == path]
            want[f"h{h}.com", path] = (len(on[path]), sum(c * (1 - math.log(c) / max(math.log(len(on[path])), 1e-9)) for c in cs) / sum(cs))
    got = {(x.host, x.path): (x.pages, x.importance) for x in style_tree(df).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_copies_of_an_article_keep_their_heading(spark):
    pages = [(i, "http://h.com/x", f"<body><article><h1>One title</h1><p>Shared start</p><p>Body {i} of the copy</p><div class='x'>Read more offers</div></article></body>") for i in range(20)]
    out = [r.text for r in main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).orderBy("page_id").collect()]
    assert out == [f"One title\n\nShared start\n\nBody {i} of the copy" for i in range(20)]


def test_a_removed_container_keeps_what_differs_below_it(spark):
    pages = [(i, "http://h.com/x", f"<body><div class='story'><span>By Staff</span><p>Unique body {i} of {i * 7} words</p></div></body>") for i in range(12)]
    out = [r.text for r in main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).orderBy("page_id").collect()]
    assert out == [f"Unique body {i} of {i * 7} words" for i in range(12)]


def test_copies_of_an_article_keep_their_classed_lead(spark):
    pages = [(i, "http://h.com/x", f"<body><article><h1 class='t'>One title</h1><p class='lead'>Shared lead</p><p>Long body {i} of the copy with words of its own</p></article></body>") for i in range(20)]
    out = [r.text for r in main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).orderBy("page_id").collect()]
    assert out == [f"One title\n\nShared lead\n\nLong body {i} of the copy with words of its own" for i in range(20)]


@pytest.mark.parametrize("attr", ['aria-hidden="false"', 'title="the hidden room"', "href=/hidden-gems", 'onclick="toggleHidden()"', 'data-role="search"', 'data-id="promo"', "data-x='class=ad'", 'data-hidden'])
def test_only_whole_attribute_names_count(attr):
    assert extract(f"<article><p>a <a {attr}>b</a></p><div {attr}>c</div></article>") == "a b\n\nc"
    assert extract(f"<article {attr}><p>a</p></article>") == "a"


@pytest.mark.parametrize("attr", ["hidden", "HIDDEN=''", "data-x=1 hidden", "role='search'", "a=1 style='display: none'", "class=ad"])
def test_attributes_of_noise(attr):
    assert extract(f"<article><p>a</p><div {attr}>c</div></article>") == "a"


def test_unclassed_blocks_of_all_pages_go(spark):
    pages = [(i, "http://h.com/x", f"<body><div><p>We use cookies</p></div><p>Story {i} with {i * 7} words of its own</p><p>Subscribe now</p></body>") for i in range(12)]
    out = [r.text for r in main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).orderBy("page_id").collect()]
    assert out == [f"Story {i} with {i * 7} words of its own" for i in range(12)]
