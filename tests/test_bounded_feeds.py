"""Feeds of bounded size that still hold every item."""

from rentwire.plans import newsroom


def test_feeds_are_bounded(spark, tmp_path):
    spark.range(8000).selectExpr("id as doc_id", "'title ' || id || '\nrest' as text", "'en' as lang", "'s' || id % 3 as source", "1 as n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    feeds = newsroom._feeds(spark, str(tmp_path)).collect()
    assert len(feeds) == 21 and max(r.body.count("<item>") for r in feeds) <= 500
    want = {str(k): len(range(k, 8000, 7)) for k in range(7)}
    assert {r.origin: r.n for r in newsroom.feed_items(spark, str(tmp_path)).collect()} == {k: n for k, n in want.items() if k != "6"}
    assert {r.origin: (r.ok, r["items"]) for r in newsroom.source_results(spark, str(tmp_path)).collect()} == {k: (k != "6", n if k != "6" else 0) for k, n in want.items()}
