import random
import time

import pytest

from kategora.llm import html_text as ht

ARTICLE = "<article><h1>Head &amp; line</h1><p>One<b>two</b>\n three<br>four<p>five&nbsp;&eacute;</p><ul><li>a<li>b</ul></article>"
TEXT = "Head & line Onetwo three four five é a b"


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("plain", "plain"),
        (ARTICLE, TEXT),
        (f"<html><head><title>x</title><style>p{{}}</style></head><body><nav>n</nav>{ARTICLE}<footer>f</footer></body></html>", TEXT),
        (f'<div class="with-sidebar"><header>h</header>{ARTICLE}<aside>s</aside><div class="sidebar">t</div></div>', TEXT),
        (f"<main><form>f<input></form>{ARTICLE}<section id='comments'><p>c</p></section></main>", TEXT),
        (ARTICLE[:-10] + '<div class="cookie-notice">ok?</div><script>var t="</p>";</script><!-- x --></article>', TEXT),
        ("<article><p>cut &lt;here&gt; <b>and", "cut <here> and"),
        ("<article><p>cut <b", "cut"),
        ("<article><p>cut <!-- in a comment", "cut"),
        ("<article><p>&copy; &#233; &#x1F600; &nosuch; a < b</p></article>", "© é 😀 &nosuch; a < b"),
        ('<article class="post"><div class="x">in</div></article><article class="comment">out</article>', "in"),
        ('<p title="a > b">one</p><table><tr><td>1<td>2</table>', "one 1 2"),
    ],
)
def test_page(page, text):
    assert ht.main_text(page) == text


def pages(spark, rows):
    return spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, text string, host long")


@pytest.mark.parametrize("most", [1_000, 0])
def test_templates(spark, monkeypatch, most):
    """What the pages of a host share is deleted, the same block elsewhere is not; prose of articles stays."""
    monkeypatch.setattr(ht, "HOST_TEMPLATES", most)
    shared = "<div><p>Read us every day</p><a href='/'>home</a></div>"
    rows = [(i, f"http://a.com/{i}", f"<body>{shared}<div><p>story number {i} is told here</p></div></body>") for i in range(8)]
    rows += [(20, "http://b.com/", f"<body>{shared}<p>other</p></body>"), (21, None, None), (None, "odd", "<p>x"), (20, "http://b.com/", f"<body>{shared}<p>other</p></body>")]
    rows += [(30 + i, f"http://c.com/{i}", f"<article>{shared}<p>said by all</p><p>own {i}</p></article>") for i in range(6)]
    found = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in ht.extract(pages(spark, rows)).collect()), key=repr)
    want = [(i, f"story number {i} is told here") for i in range(8)] + [(20, "Read us every day home other")] * 2 + [(21, ""), (None, "x")]
    want += [(30 + i, f"said by all own {i}") for i in range(6)]
    assert found == sorted(((i, t, len(t)) for i, t in want), key=repr)


def test_many_pages_of_a_large_host(spark):
    """Ten different pages share an advert, a small part of the host; ten copies of one page share nothing with others."""
    advert = "<div><p>Buy two and pay one</p></div>"
    rows = [(i, f"http://a.com/{i}", f"<body>{advert if i < 10 else ''}<div><p>story number {i} is told here</p></div></body>") for i in range(200)]
    rows += [(500 + i, f"http://a.com/copy/{i}", "<body><div><p>told once and copied</p></div></body>") for i in range(10)]
    found = {r["page_id"]: r["text"] for r in ht.extract(pages(spark, rows)).collect()}
    assert found == {i: f"story number {i} is told here" for i in range(200)} | {500 + i: "told once and copied" for i in range(10)}


def test_subtrees_are_counted_whatever_they_are(spark):
    """Blocks that lists know too are counted and deleted as templates, against a plain count of the blocks of each page."""
    draw = random.Random(6)
    blocks = ["<nav><a>home</a></nav>", "<footer>about us</footer>", "<div class='sidebar'><p>more</p></div>", "<section>plain box</section>", "<div><p>rare box</p></div>"]
    shares = [1, 0.8, 0.5, 0.4, 0.01]
    rows, has = [], []
    for i in range(150):
        own = [b for b, share in zip(blocks, shares) if draw.random() < share]
        has.append(own)
        rows.append((i, "http://a.com/x", f"<body>{''.join(own)}<article><p>story {i}</p></article></body>"))
    table = pages(spark, rows)
    found = ht.page_templates(table, ht.page_subtrees(table)).collect()
    counts = [sum(b in own for own in has) for b in blocks]
    # The paragraph inside a block is a subtree of its own.
    want = [n for n, b in zip(counts, blocks) for _ in range(1 + b.count("<p>")) if n >= 10]
    assert sorted(r["n_pages"] for r in found) == sorted(want) and len(want) >= 4
    texts = {r["page_id"]: r["text"] for r in ht.extract(table).collect()}
    assert texts == {i: f"story {i}" for i in range(150)}


@pytest.mark.parametrize(
    "page, words",
    [
        ("<div>" * 100_000 + "deep" + "</div>" * 100_000, 1),
        ("<b>" * 50_000 + "deep" + "</i>" * 50_000, 1),
        ("<article>" + "<p>one two</p>\n" * 700_000 + "</article>", 1_400_000),
        ('<a ' * 100_000 + '"', 0),
        ('<p title="never closed>one</p><p>two</p>', 2),
    ],
    ids=["deep", "wrong ends", "10 MB", "cut tags", "open quote"],
)
def test_hard_pages(page, words):
    """Deep, long and broken pages take a time that grows with their length, and lose nothing else."""
    began = time.time()
    ht.candidates(ht.parse(page))
    assert len(ht.main_text(page, frozenset([1])).split()) == words
    assert time.time() - began < 60


def test_empty(spark):
    assert ht.extract(pages(spark, [])).count() == 0
