"""Extraction of pages whose article is known because the page was made around it."""

import random

import pytest

from tallyforge.llm import html_extract

PROSE = "A sentence of the story that goes on for a while, with a comma, and ends here. "
MENU = "<nav><ul><li><a href=/>Home</a></li><li><a href=/news>News</a></li></ul></nav>"
BODY = f"<p>{PROSE * 3}</p><h2>Part two</h2><p>{PROSE * 2}</p>"
KEPT = [PROSE.strip() + (" " + PROSE.strip()) * 2, "Part two", PROSE.strip() + " " + PROSE.strip()]


def text(html):
    page = html_extract.Page(html)
    return page.text(page.path(page.best())).split("\n\n")


@pytest.mark.parametrize(
    "html, want",
    [
        (f"<div class=wrap>{MENU}<h1>The title</h1><p class=lead>The lead of the story says in a line what it is about.</p><div class=content>{BODY}</div></div>", ["The title", "The lead of the story says in a line what it is about.", *KEPT]),
        (f"<form id=aspnetForm>{MENU}<div id=content>{BODY}</div></form>", KEPT),
        (f"{MENU}<div class='entry category-social'>{BODY}</div>", KEPT),
        (f"{MENU}<div class='post search-result'>{BODY}</div>", KEPT),
        (f"<div class=has-header>{MENU}<div class=text>{BODY}</div></div>", KEPT),
        (f"{MENU}<article><h1>T</h1><p class=notice>Correction: it was not so.</p>{BODY}</article>", ["T", "Correction: it was not so.", *KEPT]),
        (f"{MENU}<article><h1>T</h1><section class=banner-story><p>Told by a witness.</p></section>{BODY}</article>", ["T", "Told by a witness.", *KEPT]),
        (f"<div class=page>{BODY}<div class=cookieBanner>We use cookies on this site to make it better for you.</div></div>", KEPT),
        (f"<div class=page>{BODY}<ul id=commentsList><li>{PROSE * 9}</li></ul></div>", KEPT),
        (f"<div class=page>{BODY}<div hidden><p>{PROSE}</p></div><p style='color:red; display: none'>{PROSE}</p><div aria-hidden=true>{PROSE}</div></div>", KEPT),
        (f"<div class=page>{BODY}<form class=letter><p>Write to us, we will answer all your questions.</p><input></form></div>", KEPT),
        ("<article><h1>Short</h1><p>One line.</p></article><footer><p>A footer that says much more than all of the article does.</p></footer>", ["Short", "One line."]),
    ],
)
def test_layouts(html, want):
    assert text(f"<html><body>{html}</body></html>") == want


#: Parts around an article, written as sites write them.
FURNITURE = [
    MENU, "<header class=site-header><a href=/>The Daily</a></header>", "<div class='cookie-notice'>We use cookies. Accept?</div>", "<aside><h3>Most read</h3><a href=/1>First</a><a href=/2>Second</a></aside>", "<div class=share-buttons><a href=x>Share</a></div>",
    f"<div id=comments><h3>Comments</h3><div class=comment><p>{PROSE}</p></div></div>", "<footer>All rights reserved by us.</footer>", "<div class='sidebar-left'><p>About this site and those who make it, in a line or two.</p></div>", "<form action=/search><input name=q><button>Go</button></form>",
    "<script>var x = '<p>no</p>'</script>", "<div class=newsletterSignup><p>Get our letter each morning in your mail, for free.</p></div>", "<div class=breadcrumbs><a href=/>Home</a> &gt; <a href=/n>News</a></div>", "<div role=navigation><a href=/a>A</a></div>", "<ul class=pagination><li>1</li><li>2</li></ul>",
]
NAMES = ["content", "main-column", "wrap", "story", "post-12", "td_block", "row", "entry has-sidebar", "article-body", "category-cookies", "search-results-page", "is-header-fixed", "no-comments", "col-8"]


@pytest.mark.parametrize("seed", range(60))
def test_generated_pages(seed):
    """A title, a lead and paragraphs in nested boxes, with parts of sites at any place between the boxes, before and behind."""
    r = random.Random(seed)
    pieces = [("h1", "The title of the story")] + [("p", PROSE * r.randint(1, 4)) for _ in range(r.randint(3, 8))]
    if r.random() < 0.5:
        pieces.insert(2, ("h2", "A part"))
    want = [" ".join(t.split()) for _, t in pieces]
    some = lambda: "".join(r.sample(FURNITURE, r.randint(0, 3)))
    # the title and the lead may stand outside of the box that holds the rest
    outside = r.choice([0, 0, 1, 2])
    inner = "".join(f"<{t}>{x}</{t}>" for t, x in pieces[outside:])
    box = f"<{r.choice(['div', 'section'])} class='{r.choice(NAMES)}'>{inner}</div></section>"
    html = "".join(f"<{t}>{x}</{t}>{some() if r.random() < 0.5 else ''}" for t, x in pieces[:outside]) + box
    for _ in range(r.randint(0, 3)):
        html = f"{some()}<div class='{r.choice(NAMES)}'>{html}{some()}</div>"
    assert text(f"<html><head><title>x</title></head><body>{some()}{html}{some()}</body></html>") == want


def test_many_hosts_are_joined_without_a_hot_one(spark, monkeypatch):
    rows = [(k, "http://big.net/x" if k % 3 else f"http://h{k}.net/", f"<body><div class=c{k % 2}>{BODY}</div></body>") for k in range(60)] + [(99, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("page_id", "page_id")
    want = sorted(map(tuple, html_extract.extract(pages).collect()), key=repr)
    monkeypatch.setattr(html_extract, "BROADCAST_HOSTS", 1)
    assert sorted(map(tuple, html_extract.extract(pages).collect()), key=repr) == want and len(want) == 61
