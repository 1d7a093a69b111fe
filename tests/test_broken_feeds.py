"""Feeds that don't parse fail alone, whatever is wrong with them; large files are read an item a row."""

from rentwire.sources import feeds

ITEM = "<item><title>a</title><link>x</link></item>"
BODIES = {  # body, whether it parses, items
    "good": (f"<rss><channel>{ITEM}{ITEM}</channel></rss>", True, 2), "mark": (f"﻿<?xml version='1.0'?>\n<rss version='2.0'><channel><title>t</title>{ITEM}</channel></rss>\n<!-- end -->", True, 1),
    "unclosed": ("<rss><channel><item><title>a</title><link>x</channel></rss>", False, 0), "ampersand": ("<rss><channel><item><title>a & b</title></item></channel></rss>", False, 0),
    "entity": ("<rss><channel><item><title>a &eacute; b</title></item></channel></rss>", False, 0), "late": (f"<rss><channel>{ITEM * 50}<item><title>b</ttle></item></channel></rss>", False, 0),
    "cut": ("<rss><channel><item><title>a</title><li", False, 0), "behind": (f"<rss><channel>{ITEM}</channel></rss><b>", False, 0), "twice": (f"<rss><channel>{ITEM}</channel></rss><rss></rss>x", False, 0),
    "page": ("<html><body>no feed</body></html>", True, 0), "empty": ("", False, 0), "blank": (" \n", False, 0), "text": ("no feed", False, 0), "none": (None, False, 0), "no items": ("<rss><channel><title>t</title></channel></rss>", True, 0),
    "atom": ("<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>a</title><link href='x'/></entry></feed>", True, 1), "broken atom": ("<feed><entry><title>a</title></entry>", False, 0),
}


def test_each_feed_fails_alone(spark):
    bodies = spark.createDataFrame([(k, v[0]) for k, v in BODIES.items()], "origin string, body string").repartition(3)
    got = {r.origin: (r.ok, r["items"], r.error) for r in feeds.source_results(bodies).collect()}
    assert got == {k: (ok, n, "" if ok else feeds.MALFORMED) for k, (_, ok, n) in BODIES.items()}
    items = {}
    for r in feeds.parse(bodies).collect():
        items[r.origin] = items.get(r.origin, 0) + 1
    assert items == {k: n for k, (_, _, n) in BODIES.items() if n}


def test_large_files_are_read_an_item_a_row(spark, tmp_path):
    head = "<rss xmlns:media='http://search.yahoo.com/mrss/'><channel><title>t</title>\n"
    rows = [f"<item><title>number {k}</title>\n<link>https://n.example.com/{k}</link><media:content url='https://i.example.com/{k}.jpg'/></item>\n" for k in range(2000)]
    rows[7] = "<item><title>bread & butter</title></item>\n"
    (tmp_path / "big.xml").write_text(head + "".join(rows) + "</channel></rss>")
    got = {r.link: (r.title, r.image_url) for r in feeds.parse_files(spark, str(tmp_path)).collect()}
    assert got == {f"https://n.example.com/{k}": (f"number {k}", f"https://i.example.com/{k}.jpg") for k in range(2000) if k != 7}
    assert [r.damaged for r in feeds.damaged_files(spark, str(tmp_path)).collect()] == [1]
    (tmp_path / "atom").mkdir()
    (tmp_path / "atom" / "a.xml").write_text("<feed><entry><title>a</title><link rel='self' href='s'/><link href='x'/></entry></feed>")
    assert [(r.title, r.link) for r in feeds.parse_files(spark, str(tmp_path / "atom"), atom=True).collect()] == [("a", "x")]
