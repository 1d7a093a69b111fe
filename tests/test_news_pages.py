"""Stored pages, key points and pictures against literal expectations and plain Python."""

import random
import re

from pyspark.sql import functions as F

from rentwire.operators import pages

LONG = "The health system will open a new clinic with forty rooms and a lab in the spring. " * 2
SECOND = "Nurses and physicians will move from the old building, which the county bought for $12 million. " * 2
PAGE = f"""<html><head><meta property="og:image" content="/pictures/clinic.jpg"><title>x</title><script>var p = "<p>{LONG}</p>";</script></head>
<body><nav><a href="https://menu.example.com/">Menu</a><img src="/nav.jpg"><p>{LONG}</p></nav>
<article><h1>Short head</h1><p>{LONG} &amp; more</p><p>Subscribe to our newsletter for all the news of the day, every day of the week.</p>
<blockquote><p>{SECOND}</p> said the mayor.</blockquote><a href="https://out.example.com/a?b=1&amp;c=2">out</a><a href="/inside">in</a></article>
<footer><p>{LONG}</p></footer><p>{LONG} never closed</body></html>"""


def read(spark, *rows):
    kind = "url string, html string, title string"
    return {r.url: r for r in pages.extract(spark.createDataFrame(list(rows), kind), boilerplate=("newsletter",), excluded=("logo", "sprite")).collect()}


def test_pages(spark):
    got = read(spark, ("https://n.example.com/a/b.html", PAGE, "Clinic opens"), ("u2", None, None), ("u3", "", ""), ("u4", "<p>" * 3000 + "<nav><!-- x", "t"))
    one = got["https://n.example.com/a/b.html"]
    assert one.text == f"{LONG}& more\n{SECOND}said the mayor."
    assert one.links == ["https://menu.example.com/", "https://out.example.com/a?b=1&c=2"]
    assert tuple(one.image) == ("https://n.example.com/pictures/clinic.jpg", "Clinic opens", "publisher")
    assert all((got[u].text, got[u].links, got[u].image) == ("", [], None) for u in ("u2", "u3", "u4"))


def test_pictures(spark):
    body = "<body><header><img src='head.jpg' width=900 height=900></header>{}</body>"
    own = "<meta property='og:image' content='https://c.example.com/site-logo.png'><meta name='twitter:image' content='//c.example.com/p.jpg'>"
    cases = {
        "https://n.example.com/a/": own + body.format(""),  # a logo is none; the next of the page's own
        "https://n.example.com/b/x.html": body.format("<img src='one.jpg' width=100 height=80 alt='clinic opens doors'><img data-src='two.jpg' src='data:x' alt='Clinic doors open' width='640px' height=480>"),
        "https://n.example.com/c": body.format("<img src='data:x' srcset='s.jpg 1x, /big.jpg 2x' width=800 height=600>"),
        "https://n.example.com/d": body.format("<img src='sprite.gif'>" * 8 + "<img src='late.jpg'>"),  # too late and too small to be worth 2 points
    }
    got = read(spark, *((u, h, "Clinic opens doors") for u, h in cases.items()))
    images = {u: r.image and tuple(r.image) for u, r in got.items()}
    assert images == {
        "https://n.example.com/a/": ("https://c.example.com/p.jpg", "Clinic opens doors", "publisher"),
        "https://n.example.com/b/x.html": ("https://n.example.com/b/two.jpg", "Clinic doors open", "in-article"),
        "https://n.example.com/c": ("https://n.example.com/big.jpg", "Clinic opens doors", "in-article"),
        "https://n.example.com/d": None,
    }


def test_word_lists_are_parameters(spark):
    df = spark.createDataFrame([("u", f"<p>{LONG}</p><p>{SECOND}</p>", "t")], "url string, html string, title string")
    assert pages.extract(df, boilerplate=("nurses",)).first().text == LONG.strip()
    assert pages.extract(df, most_text=10).first().text == LONG[:10] and pages.extract(df, most_page=20).first().text == ""


def test_redirects(spark):
    df = spark.createDataFrame([(["https://news.google.com/x", "https://www.youtube.com/y", "https://paper.example.com/z"],), (["https://a.google.com/"],), ([],)], "links array<string>")
    assert [r[0] for r in df.select(pages.redirect_target(F.col("links"), ("google.com", "youtube.com"))).collect()] == ["https://paper.example.com/z", None, None]


def test_enriched_articles(spark):
    text = "Hospital nurses strike in Tacoma. " + "x" * 500
    arts = spark.createDataFrame([(1, "a", "Hospital nurses strike", 9, "feed1"), (2, "b", "Hospital nurses strike", 8, "feed2"), (3, "c", "Hospital nurses strike", 7, "feed3"), (4, "d", "Other words entirely", 6, None), (5, "a", "Hospital nurses strike", 1, "feed5")], "seq long, url string, title string, score int, image string")
    read_pages = spark.createDataFrame([("a", text, "page"), ("b", text[:200], None), ("c", text[:100], "page"), ("d", text, "page")], "url string, text string, image string")
    enriched = pages.enrich(arts, read_pages, budget=4)
    got = {r.seq: (r.text_status, len(r.article_text), r.image) for r in enriched.collect()}
    assert got == {1: ("ok", len(text), "page"), 2: ("partial", 200, "feed2"), 3: ("unavailable", 0, "feed3"), 4: ("unavailable", 0, None), 5: ("skipped", 0, "feed5")}
    assert {r.text_status: r.n for r in pages.status_counts(enriched).collect()} == {"ok": 1, "partial": 1, "unavailable": 2, "skipped": 1}


def plain_points(title, text, most=3):
    """The rule in plain Python, without categories."""
    words = lambda s: set(re.sub(r"[^\w\s]", " ", s.lower()).split())
    split = [s.strip(" ") for line in text.split("\n") for s in re.split(r"(?<=[.!?])\s+(?=[A-Z\"'“(])", line)]
    scored = []
    for k, s in enumerate([s for s in split if 40 <= len(s) <= 420][:40]):
        score = [3.5, 2.0, 1.0][k] if k < 3 else 0.0
        score += 2.0 * any(c.isdigit() for c in s) - (s[0] in '"“') + 0.3 * min(4, len(words(title) & words(s)))
        scored.append((-round(score, 6), k, s))
    kept = []
    for x in sorted(scored):
        if len(kept) < most and all(len(words(x[2]) & words(p[2])) <= 0.6 * len(words(x[2]) | words(p[2])) for p in kept):
            kept.append(x)
    return [s if len(s) <= 300 else s[:297].rstrip(" ") + "..." for _, _, s in sorted(kept, key=lambda x: x[1])]


def test_key_points(spark):
    r = random.Random(5)
    stock = "clinic opens tower nurses strike grant lab county rooms doctors plan city council money 12 2024 bridge".split()
    rows = []
    for k in range(60):
        text = "".join(r.choice(("", '"')) + " ".join(r.choice(stock) for _ in range(r.randint(4, 70))).capitalize() + r.choice((". ", "! ", ".\n")) for _ in range(r.randint(0, 60)))
        rows.append((k, " ".join(r.choice(stock) for _ in range(6)), text, "the summary" if k % 2 else " "))
    df = spark.createDataFrame(rows, "seq long, title string, article_text string, summary string")
    got = {x.seq: x.key_points for x in pages.key_points(df).collect()}
    for k, title, text, summary in rows:
        assert got[k] == (plain_points(title, text) or ([summary] if summary.strip() else [])), k


def test_pages_of_one_url(spark):
    long = f"<p>{LONG}</p>"
    rows = [("u", "Clinic", long, 1), ("u", "Nurses", long * 2 + "<img src='https://c.example.com/a.jpg' alt='nurses'>", 2), ("v", None, None, 3), (None, "t", long, 4)]
    got = pages.extract(spark.createDataFrame(rows, "url string, title string, html string, n int"), keep=("n",))
    assert got.columns == ["url", "n", "text", "links", "image"]
    assert {r.n: (r.url, r.text.count("\n") + bool(r.text), r.image and r.image.alt) for r in got.collect()} == {1: ("u", 1, None), 2: ("u", 2, "nurses"), 3: ("v", 0, None), 4: (None, 1, None)}
    arts = spark.createDataFrame([(1, "u", "", 5), (2, "u", "", 4), (9, None, "", 1)], "seq long, url string, title string, score int")
    best = {r.seq: (r.text_status, r.article_text.count("\n")) for r in pages.enrich(arts, got, budget=1).collect()}
    assert best == {1: ("partial", 1), 2: ("skipped", 0), 9: ("skipped", 0)}
    own = {r.seq: (r.text_status, len(r.article_text) > 0) for r in pages.enrich(arts, got.withColumnRenamed("n", "seq"), budget=None, key="seq").collect()}
    assert own == {1: ("partial", True), 2: ("partial", True), 9: ("unavailable", False)}
