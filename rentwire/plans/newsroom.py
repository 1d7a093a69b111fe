"""Registered queries over news items and pages, and over sheets and places, each with its DuckDB form where SQL has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from rentwire.functions import news
from rentwire.operators import headers, items, normalize, pages, places, stories
from rentwire.operators.items import Vocabulary
from rentwire.operators.tables import cut, shared_folder
from rentwire.sources import feeds, quoted, sheets
from rentwire.streaming import scan

from . import brief
from .comps import D, register
from .view import deals, rounded, table

#: The words of the corpus that the queries score.
V = Vocabulary(
    region=(("the", 1), ("la", 1), ("der", 1)), elsewhere=(("thou", 1),),
    categories=(("medical_office", (("of the", 3), ("thin", 1))), ("workforce", (("and", 1), ("und", 1))), ("life_sciences", (("de la", 2),)), ("hospitals", (("die", 2), ("ing", 1)))),
    property_signals=(("in", 1),), noise=(("er", 1),),
)
ORDER = tuple(name for name, _ in V.categories)
_TITLE = "trim(split_part(text, chr(10), 1))"
_ITEMS = f"SELECT doc_id AS seq, {_TITLE} AS title, trim(substr(text, length(split_part(text, chr(10), 1)) + 1)) AS summary, source, 'https://www.' || source || '.example.com/' || doc_id || '#x' AS link, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id % 5000 AS INTEGER)) AS published FROM documents"


def item_table(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    line = F.substring_index("text", "\n", 1)
    when = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") % 5000 * 60)
    link = F.concat(F.lit("https://www."), F.col("source"), F.lit(".example.com/"), F.col("doc_id").cast("string"), F.lit("#x"))
    return d.select(F.col("doc_id").alias("seq"), F.trim(line).alias("title"), F.trim(F.substring("text", F.length(line) + 1, F.length("text"))).alias("summary"), F.col("source").alias("source_name"), link.alias("link"), when.alias("published"), F.lit("documents").alias("origin"))


def kept_items(spark, sf_dir):
    return items.evaluate(item_table(spark, sf_dir), V).filter("drop_reason is null")


def _has(phrase: str) -> str:
    return f"regexp_matches(t, '(?i)(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_]){phrase.replace(' ', '[\\s-]+')}($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])')"


def _hits(*phrases: str) -> str:
    return "list_sort(list_filter([" + ", ".join(f"CASE WHEN {_has(p)}{' AND (' + _has('of the') + ' OR ' + _has('thin') + ')' if p == 'in' else ''} THEN '{p}' END" for p in phrases) + "], lambda x: x IS NOT NULL))"


def _n(phrase: str, weight: int = 1) -> str:
    return f"CASE WHEN {_has(phrase)} THEN {weight} ELSE 0 END"


#: The evaluation of items in SQL, for the words of V.
_EVALUATED = f"""i AS ({_ITEMS}),
p AS (SELECT *, trim(regexp_replace(regexp_replace(summary, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM i),
s AS (SELECT *, CASE WHEN starts_with(plain, substr(title, 1, greatest(20, length(title) // 2))) THEN '' WHEN length(plain) > 400 THEN rtrim(substr(plain, 1, 397)) || '...' ELSE plain END AS short FROM p),
t AS (SELECT *, title || ' ' || short AS t FROM s),
n AS (SELECT *, {_n("the")} + {_n("la")} + {_n("der")} AS region, {_n("of the", 3)} + {_n("thin")} AS m0, {_n("and")} + {_n("und")} AS w, {_n("de la", 2)} AS l, {_n("die", 2)} + {_n("ing")} AS h0, {_n("in")} AS prop, {_has("thou")} AS far, {_has("er")} AS noisy,
  {_hits("the", "la", "der")} AS region_hits, {_hits("of the", "thin", "and", "und", "de la", "die", "ing", "in")} AS topic_hits FROM t),
q AS (SELECT *, CASE WHEN m0 > 0 THEN m0 + prop ELSE 0 END AS m FROM n),
e AS (SELECT *, m + l + h0 AS q, CASE WHEN m + l + h0 = 0 THEN 1 ELSE h0 END AS h FROM q),
evaluated AS (SELECT seq, title, link AS url, source, published, region_hits, topic_hits, region + m + w + l + h AS score,
  CASE WHEN greatest(m, w, l, h) = 0 THEN 'other' WHEN m = greatest(m, w, l, h) THEN 'medical_office' WHEN w = greatest(m, w, l, h) THEN 'workforce' WHEN l = greatest(m, w, l, h) THEN 'life_sciences' ELSE 'hospitals' END AS category,
  CASE WHEN title = '' THEN 'no title' WHEN region < 1 THEN 'not in the region' WHEN far AND region < 2 THEN 'story from elsewhere (thou)' WHEN q = 0 THEN 'not on topic' WHEN noisy AND q <= 3 THEN 'incidental mention (er)' END AS drop_reason FROM e)"""


@register("N6_links", f"WITH i AS ({_ITEMS}) SELECT source || '.example.com' AS domain, count(*) AS n, min('https://www.' || source || '.example.com/' || seq) AS first FROM i GROUP BY source")
def links(spark, sf_dir):
    url = news.unwrap_redirect(F.concat(F.lit("https://www.bing.com/news/apiclick?url="), F.url_encode("link")))
    i = item_table(spark, sf_dir).withColumn("url", url)
    return i.groupBy(news.domain_of(F.col("url")).alias("domain")).agg(F.count("*").alias("n"), F.min(news.url_key(F.col("url"))).alias("first"))


_PHRASES = (("the", 1), ("of the", 3), ("de la", 2), ("die", 2))
_HITS = " + ".join(f"CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9_À-ɏ]){p.replace(' ', '[ \\n\\-]+')}($|[^a-z0-9_À-ɏ])') THEN {w} ELSE 0 END" for p, w in _PHRASES)


@register("N7_phrases", f"SELECT lang, count(*) AS n, sum({_HITS}) AS score FROM documents GROUP BY lang")
def phrases(spark, sf_dir):
    score, _ = news.phrase_hits(F.col("text"), _PHRASES)
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(score).alias("score"))


@register("N8_window", f"WITH i AS ({_ITEMS}) SELECT source AS source_name, count(*) AS n FROM i WHERE published BETWEEN TIMESTAMP '2024-01-01 12:00:00' AND TIMESTAMP '2024-01-02 14:00:00' GROUP BY source")
def window(spark, sf_dir):
    now = F.lit("2024-01-02 12:00:00").cast("timestamp")
    return items.in_window(item_table(spark, sf_dir), now, 24).groupBy("source_name").agg(F.count("*").alias("n"))


@register("N9_evaluated", f"WITH {_EVALUATED} SELECT * EXCLUDE (published) FROM evaluated")
def evaluated(spark, sf_dir):
    return items.evaluate(item_table(spark, sf_dir), V).select("seq", "title", "url", "source", "category", "region_hits", "topic_hits", "score", "drop_reason")


@register("N10_drop_reasons", f"WITH {_EVALUATED} SELECT split_part(drop_reason, ' (', 1) AS reason, count(*) AS n FROM evaluated WHERE drop_reason IS NOT NULL GROUP BY 1")
def drop_reasons(spark, sf_dir):
    return items.drop_counts(items.evaluate(item_table(spark, sf_dir), V))


@register("N11_sources", "SELECT source AS origin, count(*) AS items FROM documents GROUP BY source")
def sources(spark, sf_dir):
    return items.source_counts(item_table(spark, sf_dir).withColumn("origin", F.col("source_name")))


@register("N4_report_rows", f"WITH i AS ({_ITEMS}) SELECT seq, strftime(published, '%Y-%m-%dT%H:%M:%S') AS utc, strftime(published - INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') AS local FROM i")
def report_rows(spark, sf_dir):
    j = feeds.report_rows(item_table(spark, sf_dir).select("seq", "title", "published"))
    parts = F.from_json("json", "seq long, published_utc string, published_local string")
    return j.select(parts.alias("p")).select("p.seq", F.col("p.published_utc").alias("utc"), F.col("p.published_local").alias("local"))


#: Sequence numbers a set of seven feeds.
FEED = 3500


#: What ends the feeds of the kinds 1 to 3: an element that doesn't close, a bare ampersand and an entity that XML hasn't. Kind 4 has an end behind its end.
_BROKEN = ("", "<item><title>open<link>x</link></item>", "<item><title>bread & butter</title></item>", "<item><title>caf&eacute;</title></item>", "</channel></rss>")


def _feeds(spark, sf_dir, kind=None):
    """Seven origins in feeds of bounded size; origin is number|place. Those of 6 are cut off; kind breaks the others too, each by its origin's number modulo 5."""
    i = item_table(spark, sf_dir).select("seq", F.xxhash64("seq").alias("h"), F.regexp_replace("title", "[<>&]", " ").alias("title"), "link", "published", "source_name")
    item = F.concat(F.lit("<item><title>"), "title", F.lit("</title><link>"), "link", F.lit("</link><pubDate>"), F.date_format("published", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate><source url='https://s.example.com'>"), "source_name", F.lit("</source><media:content url='https://i.example.com/a.jpg' medium='image'/></item>"))
    number = F.col("seq") % 7
    made = i.groupBy(F.concat(number.cast("string"), F.lit("|"), F.floor(F.col("seq") / FEED).cast("string")).alias("origin"), number.alias("number")).agg(F.array_join(F.array_sort(F.collect_list(item)), "").alias("items"))  # FEED / 7 items at most
    head, tail = F.lit("<?xml version='1.0'?><rss xmlns:media='http://search.yahoo.com/mrss/'><channel><title>t</title>"), F.lit("</channel></rss>")
    broken = F.element_at(F.array(*map(F.lit, _BROKEN)), F.col("number").cast("int") % 5 + 1) if kind else F.lit("")
    return made.select("origin", F.when(F.col("number") == 6, F.concat(head, F.substring("items", 1, 500))).otherwise(F.concat(head, "items", broken, tail)).alias("body"))


@register("N1_feed_items", f"WITH i AS ({_ITEMS}) SELECT CAST(seq % 7 AS VARCHAR) AS origin, count(*) AS n, min(published) AS first, max(published) AS last, count(DISTINCT source) AS sources, count(*) AS pictures FROM i WHERE seq % 7 <> 6 GROUP BY 1")
def feed_items(spark, sf_dir):
    read = feeds.parse(_feeds(spark, sf_dir))
    return read.groupBy(F.substring_index("origin", "|", 1).alias("origin")).agg(F.count("*").alias("n"), F.min("published").alias("first"), F.max("published").alias("last"), F.count_distinct("source_name").alias("sources"), F.count_if(F.col("image_url") == "https://i.example.com/a.jpg").alias("pictures"))


@register("N3_source_results", "SELECT CAST(doc_id % 7 AS VARCHAR) AS origin, doc_id % 7 <> 6 AS ok, CASE WHEN doc_id % 7 <> 6 THEN count(*) ELSE 0 END AS items FROM documents GROUP BY doc_id % 7")
def source_results(spark, sf_dir):
    each = feeds.source_results(_feeds(spark, sf_dir))
    return each.groupBy(F.substring_index("origin", "|", 1).alias("origin")).agg(F.every("ok").alias("ok"), F.sum("items").alias("items"))


@register("N3_broken_feeds", "SELECT (doc_id % 7) || '|' || (doc_id // 3500) AS origin, doc_id % 7 IN (0, 5) AS ok, CASE WHEN doc_id % 7 IN (0, 5) THEN count(*) ELSE 0 END AS items, CASE WHEN doc_id % 7 IN (0, 5) THEN '' ELSE 'not well-formed' END AS error FROM documents GROUP BY 1, 2, 4, doc_id % 7")
def broken_feeds(spark, sf_dir):
    return feeds.source_results(_feeds(spark, sf_dir, kind="broken"))


@register("N11_source_totals", "SELECT count(*) AS sources, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE NOT ok) AS failed, CAST(sum(CASE WHEN ok THEN n ELSE 0 END) AS BIGINT) AS items, coalesce(list_sort(list(o || ': not well-formed') FILTER (WHERE NOT ok)), []) AS errors FROM (SELECT doc_id % 7 <> 6 AS ok, (doc_id % 7) || '|' || (doc_id // 3500) AS o, count(*) AS n FROM documents GROUP BY 1, 2)")
def source_totals(spark, sf_dir):
    return items.source_totals(feeds.source_results(_feeds(spark, sf_dir)))


@register("N2_atom_entries", f"WITH i AS ({_ITEMS}) SELECT seq, link, published FROM i")
def atom_entries(spark, sf_dir):
    i = item_table(spark, sf_dir)
    body = F.concat(F.lit("<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>a</title><link rel='self' href='x'/><link href='"), "link", F.lit("'/><updated>"), F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z</updated></entry></feed>"))
    return feeds.parse(i.select(F.col("seq").cast("string").alias("origin"), body.alias("body"))).select(F.col("origin").cast("long").alias("seq"), "link", "published")


@register("N5_catalogue", "SELECT lang || ': ' || source AS origin, 'https://' || lang || '.example.com/?q=' || source || '+news' AS url FROM (SELECT DISTINCT lang, source FROM documents)")
def catalogue(spark, sf_dir):
    pairs = table(spark, sf_dir, "documents").agg(F.sort_array(F.collect_set("lang")).alias("l"), F.sort_array(F.collect_set("source")).alias("s")).first()  # two short lists
    made = feeds.catalogue(spark, [f"{s} news" for s in pairs.s], {lang: f"https://{lang}.example.com/?q={{q}}" for lang in pairs.l}, [])
    seen = table(spark, sf_dir, "documents").select(F.concat_ws(": ", "lang", F.concat("source", F.lit(" news"))).alias("origin")).distinct()
    return made.join(seen, "origin", "left_semi").select(F.regexp_replace("origin", " news$", "").alias("origin"), "url")


def _page_table(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", "html", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))


_BARE = r"regexp_replace(html, '<br>(<p>|</article>)', '</p>\1', 'g')"  # a paragraph without an end ends where the next begins, or the article ends
for _tag in ("script", "style", "nav", "footer"):
    _BARE = f"regexp_replace({_BARE}, '<{_tag}[^>]*>.*?</{_tag}>', '', 'gs')"
_SPELLED = "replace(replace(regexp_replace(x, '<[^>]+>', '', 'g'), '&quot;', '\"'), '&amp;', '&')"
#: The texts of _page_table in SQL: of the tags that these pages have, p, li and h1 hold paragraphs.
_TEXTS = rf"""r AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)', 1) AS title, regexp_extract_all({_BARE}, '(?s)<(?:p|li|h1)>(.*?)</(?:p|li|h1)>', 1) AS found FROM pages),
texts AS (SELECT page_id, url, title, array_to_string(list_filter(list_transform(found, lambda x: trim(regexp_replace({_SPELLED}, '\s+', ' ', 'g'))), lambda x: length(x) >= 60), chr(10)) AS text FROM r)"""
_GUARD = r"regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}\p{{M}}_\s]', ' ', 'g'), '\s+', ' ', 'g')"
#: Their status: enough of the headline's longer words begin words of the text's first 2,500 characters.
_STATUSES = f"""{_TEXTS}, w AS (SELECT *, list_distinct(list_filter(string_split(trim({_GUARD.format('title')}), ' '), lambda x: length(x) >= 4)) AS ws, ' ' || trim({_GUARD.format('substr(text, 1, 2500)')}) || ' ' AS head FROM texts),
statuses AS (SELECT *, CASE WHEN length(text) < 120 OR (len(ws) > 0 AND len(list_filter(ws, lambda x: contains(head, ' ' || substr(x, 1, 6)))) < least(len(ws), greatest(2, len(ws) // 3))) THEN 'unavailable' WHEN length(text) < 450 THEN 'partial' ELSE 'ok' END AS status FROM w)"""


@register("N12_pages", f"WITH {_TEXTS} SELECT url, text, 0 AS links FROM texts")
def read_pages(spark, sf_dir):
    return pages.extract(_page_table(spark, sf_dir).select("url", "html")).select("url", "text", F.size("links").alias("links"))


@register("N13_pictures", "SELECT url, CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, '^[a-z]+://[^/]+') || '/p/' || page_id || '.jpg' ELSE 'https://c.example.com/big.jpg' END AS picture, CASE WHEN page_id % 2 = 0 THEN 'publisher' ELSE 'in-article' END AS origin FROM pages")
def pictures(spark, sf_dir):
    """Every other page gets a picture of its own behind a logo; all get a small and a large one in their bodies."""
    p = _page_table(spark, sf_dir)
    own = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<meta property='og:image' content='/logo.png'><meta name='twitter:image' content='/p/"), F.col("page_id").cast("string"), F.lit(".jpg'>"))).otherwise(F.lit(""))
    body = F.lit("<img src='a.jpg' width=90 height=90><img src='https://c.example.com/big.jpg' width=800 height=600>")
    made = p.select("url", "title", F.concat(own, "html", body).alias("html"))
    return pages.extract(made, excluded=("logo",)).select("url", F.col("image.url").alias("picture"), F.col("image.origin").alias("origin"))


@register("N14_redirects", "SELECT url, url AS target FROM pages")
def redirects(spark, sf_dir):
    made = table(spark, sf_dir, "pages").select("url", F.concat(F.lit("<a href='https://news.google.com/x'>a</a><a href='"), "url", F.lit("'>b</a>")).alias("html"))
    return pages.extract(made).select("url", pages.redirect_target(F.col("links"), ("google.com",)).alias("target"))


@register("N15_page_status", f"WITH {_STATUSES} SELECT status, count(*) AS n FROM statuses GROUP BY status")
def page_status(spark, sf_dir):
    p = _page_table(spark, sf_dir)
    read = pages.extract(p.select("url", "html", "title"), keep=("title",))
    return read.groupBy(pages.status(F.col("title"), F.col("text")).alias("status")).agg(F.count("*").alias("n"))


def _articles(spark, sf_dir):
    p = _page_table(spark, sf_dir)
    arts = p.select(F.col("page_id").alias("seq"), "url", "title", F.lit("").alias("summary"), (F.col("page_id") % 10).alias("score"))
    read = pages.extract(p.select("url", "html", F.col("page_id").alias("seq")), keep=("seq",))  # urls repeat
    return pages.enrich(arts, read, budget=None, key="seq")


@register("N16_enriched", f"WITH {_STATUSES} SELECT page_id AS seq, status AS text_status, CASE WHEN status = 'unavailable' THEN 0 ELSE length(text) END AS n_chars FROM statuses")
def enriched(spark, sf_dir):
    return _articles(spark, sf_dir).select("seq", "text_status", F.length("article_text").alias("n_chars"))


@register("N29_fetch_statistics", f"WITH {_STATUSES} SELECT status AS text_status, count(*) AS n FROM statuses GROUP BY status")
def fetch_statistics(spark, sf_dir):
    return pages.status_counts(_articles(spark, sf_dir))


_SPLIT = "regexp_replace(replace(coalesce(text, ''), chr(10), chr(1)), '([.!?])\\s+([A-Z\"''“(])', '\\1' || chr(1) || '\\2', 'g')"


@register("N17_sentences", f"SELECT doc_id, count(s) AS n, coalesce(sum(length(s)), 0) AS chars FROM (SELECT doc_id, CASE WHEN length(trim(s)) BETWEEN 40 AND 420 THEN trim(s) END AS s FROM (SELECT doc_id, unnest(string_split({_SPLIT}, chr(1))) AS s FROM documents)) GROUP BY doc_id")
def sentence_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    s = news.sentences(F.coalesce("text", F.lit("")))
    return d.select("doc_id", F.size(s).cast("long").alias("n"), F.aggregate(s, F.lit(0), lambda a, x: a + F.length(x)).cast("long").alias("chars"))


@register("N18_key_points")
def points(spark, sf_dir):
    i = item_table(spark, sf_dir).withColumn("article_text", F.col("summary"))
    return pages.key_points(i, V.categories).select("seq", "key_points")


_FACT_TEXT = "'It pays $' || CAST(o_orderkey % 900 + 1 AS VARCHAR(9)) || ' million, and $' || CAST(o_custkey % 9 + 1 AS VARCHAR(9)) || ',500,000 more, cuts ' || CAST(o_orderkey % 400 + 2 AS VARCHAR(9)) || ' jobs on ' || CAST(o_custkey % 900 + 100 AS VARCHAR(9)) || ',000 square feet, up ' || CAST(o_orderkey % 90 AS VARCHAR(9)) || '.5%.'"


@register("N19_facts", "SELECT o_orderkey, list_sort(list_distinct([o_orderkey % 900 + 1.0, o_custkey % 9 + 1.5])) AS money, [o_orderkey % 400 + 2] AS headcount, [(o_custkey % 900 + 100) * 1000] AS sqft, [o_orderkey % 90 + 0.5] AS pct FROM orders".replace("+ 1.0", "+ 1.0::DOUBLE").replace("+ 1.5", "+ 1.5::DOUBLE").replace("+ 0.5]", "+ 0.5::DOUBLE]"))
def facts(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", news.facts(F.expr(_FACT_TEXT)).alias("f")).select("o_orderkey", "f.*")


@register("N20_titles", f"WITH i AS ({_ITEMS}) SELECT source AS source_name, count(DISTINCT trim(regexp_replace(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS titles FROM i GROUP BY source")
def titles(spark, sf_dir):
    return item_table(spark, sf_dir).groupBy("source_name").agg(F.count_distinct(news.normalize_title(F.col("title"))).alias("titles"))


def _story_articles(spark, sf_dir):
    return kept_items(spark, sf_dir).select("seq", "title", "summary", "source", "url", "published", "score", "topic_hits", "category")


@register("N21_clusters")
def clusters(spark, sf_dir):
    return stories.cluster(_story_articles(spark, sf_dir)).select("seq", "cluster_id", "role")


@register("N22_primaries")
def primaries(spark, sf_dir):
    a = _story_articles(spark, sf_dir)
    return stories.dedupe(a, stories.cluster(a)).select("seq", "title", "source")


_SPOKEN = "CASE WHEN {0} >= 1000 THEN '$' || rtrim(rtrim(printf('%.3f', {0} / 1000.0), '0'), '.') || 'B' ELSE '$' || {0} || 'M' END"


@register("N23_fact_notes", f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'dollar amount differs: A reports ' || {_SPOKEN.format('n')} || ', B reports ' || {_SPOKEN.format('(2 * n)')} ELSE '' END AS note FROM (SELECT o_orderkey, o_orderkey % 900 + 1 AS n FROM orders)")
def fact_notes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    n = F.col("o_orderkey") % 900 + 1
    a, b = (news.facts(F.concat(F.lit("A sale of $"), x.cast("string"), F.lit(" million"))) for x in (n, F.when(F.col("o_orderkey") % 3 == 0, n * 2).otherwise(n)))
    return o.select("o_orderkey", F.array_join(news.fact_notes(a, b, F.lit("A"), F.lit("B")), "; ").alias("note"))


@register("N24_verdicts")
def verdicts(spark, sf_dir):
    a = _story_articles(spark, sf_dir)
    return stories.verdicts(a, stories.cluster(a))


@register("N25_verdict_counts")
def verdict_counts(spark, sf_dir):
    a = _story_articles(spark, sf_dir)
    return stories.verdict_counts(stories.verdicts(a, stories.cluster(a)))


@register("N26_by_category", f"WITH {_EVALUATED} SELECT category_no, category, CAST(place AS INTEGER) AS place, seq, published FROM (SELECT *, list_position(['medical_office', 'workforce', 'life_sciences', 'hospitals'], category) AS category_no, row_number() OVER (PARTITION BY category ORDER BY published DESC, seq) AS place FROM evaluated WHERE drop_reason IS NULL) WHERE place <= 25 AND category_no > 0")
def by_category(spark, sf_dir):
    return brief.by_category(_story_articles(spark, sf_dir), ORDER).select("category_no", "category", "place", "seq", "published")


@register("N27_leads", f"WITH {_EVALUATED} SELECT category, count(*) AS n, arg_max(seq, (score, published, -seq)) AS lead FROM evaluated WHERE drop_reason IS NULL GROUP BY category")
def leads(spark, sf_dir):
    return brief.leads(_story_articles(spark, sf_dir))


@register("N27_largest_figures", "WITH f AS (SELECT o_orderkey AS seq, greatest(o_orderkey % 900 + 1.0, o_custkey % 9 + 1.5)::DOUBLE AS money, (o_orderkey % 400 + 2)::DOUBLE AS headcount, ((o_custkey % 900 + 100) * 1000)::DOUBLE AS sqft FROM orders), l AS (UNPIVOT f ON money, headcount, sqft INTO NAME kind VALUE value), t AS (SELECT kind, max(value) AS value FROM l GROUP BY kind) SELECT t.kind, t.value, min(l.seq) AS seq FROM t JOIN l ON l.kind = t.kind AND l.value = t.value GROUP BY ALL")
def largest_figures(spark, sf_dir):
    return brief.largest_figures(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.expr(_FACT_TEXT).alias("title"), F.lit("").alias("summary")))


@register("N27_digest")
def digest(spark, sf_dir):
    a = _story_articles(spark, sf_dir)
    clustered = stories.cluster(a)
    return brief.digest(stories.dedupe(a, clustered), stories.verdicts(a, clustered), ORDER)


@register("N10_scan_counts")
def scan_counts(spark, sf_dir):
    evaluated = items.evaluate(item_table(spark, sf_dir), V)
    return items.scan_counts(evaluated, stories.cluster(_story_articles(spark, sf_dir)))


@register("N28_ages", "SELECT o_orderkey, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN CASE WHEN m < 10 THEN ['one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine'][m] ELSE m || '' END || CASE WHEN m = 1 THEN ' minute ago' ELSE ' minutes ago' END WHEN m < 2880 THEN CASE WHEN m // 60 < 10 THEN ['one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine'][m // 60] ELSE (m // 60) || '' END || CASE WHEN m // 60 = 1 THEN ' hour ago' ELSE ' hours ago' END ELSE CASE WHEN m // 1440 < 10 THEN ['one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine'][m // 1440] ELSE (m // 1440) || '' END || CASE WHEN m // 1440 = 1 THEN ' day ago' ELSE ' days ago' END END AS age FROM (SELECT o_orderkey, o_orderkey % 20000 AS m FROM orders)")
def ages(spark, sf_dir):
    now = F.lit("2024-06-01 12:00:00").cast("timestamp")
    at = F.timestamp_seconds(F.unix_timestamp(now) - F.col("o_orderkey") % 20000 * 60)
    return table(spark, sf_dir, "orders").select("o_orderkey", news.relative_age(at, now).alias("age"))


@register("N28_stamps", "SELECT event_id, ['Jan.', 'Feb.', 'March', 'April', 'May', 'June', 'July', 'Aug.', 'Sept.', 'Oct.', 'Nov.', 'Dec.'][month(ts)] || ' ' || day(ts) || ', ' || CASE WHEN hour(ts) % 12 = 0 THEN 12 ELSE hour(ts) % 12 END || CASE WHEN minute(ts) = 0 THEN '' ELSE ':' || lpad(minute(ts) || '', 2, '0') END || CASE WHEN hour(ts) < 12 THEN ' a.m. PT' ELSE ' p.m. PT' END AS stamp FROM events")
def stamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", news.ap_stamp(F.col("ts")).alias("stamp"))


def _scanned(spark, sf_dir, name: str, made, look_back: str = scan.LOOK_BACK):
    """A file stream of the documents' items, each of them twice, run to its end into the shared folder."""
    folder = shared_folder(spark)
    batch = item_table(spark, sf_dir)
    batch.unionByName(batch).write.parquet(f"{folder}/items")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/items").schema).parquet(f"{folder}/items")
    out = made(scan.fresh(stream, V, look_back))
    scan.run_available(out, f"{folder}/{name}", f"{folder}/state")
    return spark.read.schema(out.schema).parquet(f"{folder}/{name}")


@register("N30_incremental_scan", f"WITH {_EVALUATED} SELECT seq, rtrim(split_part(url, '#', 1), '/') AS url_key, category, published FROM evaluated WHERE drop_reason IS NULL")
def incremental_scan(spark, sf_dir):
    """Every item comes twice and is kept once."""
    return _scanned(spark, sf_dir, "kept", lambda kept: kept.select("seq", "url_key", "category", "published"))


@register("N30_hourly", f"WITH {_EVALUATED}, kept AS (SELECT * FROM evaluated WHERE drop_reason IS NULL) SELECT date_trunc('hour', published) AS hour, category, count(*) AS n FROM kept WHERE date_trunc('hour', published) + INTERVAL 1 HOUR <= (SELECT max(published) - INTERVAL 2 HOUR FROM kept) GROUP BY ALL")
def hourly_counts(spark, sf_dir):
    """The hours that the watermark, two hours behind here, has passed at the end."""
    return _scanned(spark, sf_dir, "hourly", scan.hourly, "2 hours")


# Sheets: a messy sheet for each nation, made of customers.
_HEADERS = ("Tenant", "Property Address", "City", "State", "Start Date", "Lease Term (Years)", "Area  Leased", "Base Rent Yearly", "Rate Type", "Notes", "Notes", " ")


def sheet_cells(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    s = F.concat(F.lit("sheet-"), F.col("c_nationkey").cast("string"))
    k = F.col("c_custkey")
    row = F.array("c_name", F.concat(k.cast("string"), F.lit(" Main St, Suite 5")), F.lit("AUSTIN"), F.lit("texas"), F.lit("3/15/2021"), (k % 15 + 1).cast("string"), F.concat((k % 90 + 10).cast("string"), F.lit(",000 SF")), F.concat(F.lit("$"), (k % 40 + 5).cast("string"), F.lit(".50")), F.lit("Annual"), F.col("c_mktsegment"), F.lit(" "), F.lit("x"))
    body = c.select(s.alias("sheet_id"), (k + 10).alias("row_no"), row.alias("cells"))
    sheet = c.select(s.alias("sheet_id")).distinct()
    top = sheet.select("sheet_id", F.lit(0).cast("long").alias("row_no"), F.array(F.lit("Comps"), F.lit("2024")).alias("cells"))
    head = sheet.select("sheet_id", F.lit(3).cast("long").alias("row_no"), F.array(*map(F.lit, _HEADERS)).alias("cells"))
    return sheets.as_cells(body.unionByName(top).unionByName(head))


def _mapped(spark, sf_dir):
    """Cells, header rows, names, scores and the column map; what later steps read more than once is written."""
    cells = cut(sheet_cells(spark, sf_dir))
    heads = cut(sheets.header_rows(cells))
    names = cut(sheets.header_names(cells, heads))
    scored = headers.score(names.select("sheet_id", "header"), headers.field_table(spark))
    return cells, heads, names, scored, headers.assign(scored)


_SHEETS = "(SELECT DISTINCT 'sheet-' || c_nationkey AS sheet_id FROM customer)"


@register("L1_cells", "SELECT CAST(k AS INTEGER) AS col_no, count(*) AS n, CAST(sum(length(v)) AS BIGINT) AS chars FROM (SELECT unnest([c_custkey || '', c_name, 'two' || chr(10) || 'lines, \"quoted\"', NULL, c_mktsegment]) AS v, unnest(range(5)) AS k FROM customer) WHERE v IS NOT NULL GROUP BY 1")
def read_sheets(spark, sf_dir):
    """Customers written as delimited files with quoted line breaks and a blank column, read back as cells."""
    folder = shared_folder(spark)
    c = table(spark, sf_dir, "customer")
    c.select(F.col("c_custkey").cast("string"), "c_name", F.lit('two\nlines, "quoted"').alias("t"), F.lit("").alias("blank"), "c_mktsegment").write.csv(folder, quote='"', escape='"', emptyValue="")
    read = sheets.read_cells(spark, folder)
    return read.groupBy("col_no").agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars"))


@register("L1_split_sheets", "SELECT doc_id, lang, md5(text) AS digest FROM documents WHERE trim(text, ' ' || chr(10) || chr(9)) <> ''")
def split_sheets(spark, sf_dir):
    """Whole texts of documents as quoted cells of sheets, which tasks read by ranges."""
    folder = shared_folder(spark)
    table(spark, sf_dir, "documents").select("doc_id", "lang", "text").write.csv(folder, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    rows = quoted.read_rows(spark, folder).filter("trim(cells[2]) <> ''")
    return rows.select(F.col("cells")[0].cast("long").alias("doc_id"), F.nullif(F.col("cells")[1], F.lit("")).alias("lang"), F.md5(F.col("cells")[2].cast("binary")).alias("digest"))


@register("L2_header_rows", f"SELECT sheet_id, 3 AS row_no FROM {_SHEETS}")
def header_rows(spark, sf_dir):
    return sheets.header_rows(sheet_cells(spark, sf_dir)).select("sheet_id", "row_no")


@register("L3_header_names", f"SELECT sheet_id, unnest(range(12)) AS col_no, unnest(['Tenant', 'Property Address', 'City', 'State', 'Start Date', 'Lease Term (Years)', 'Area Leased', 'Base Rent Yearly', 'Rate Type', 'Notes', 'Notes (2)', 'Column 12']) AS header FROM {_SHEETS}")
def header_names(spark, sf_dir):
    cells = sheet_cells(spark, sf_dir)
    return sheets.header_names(cells, sheets.header_rows(cells)).select("sheet_id", "col_no", "header")


@register("L4_records", "SELECT 'sheet-' || c_nationkey AS sheet_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS source_row, c_name AS tenant, (c_custkey % 90 + 10) || ',000 SF' AS area FROM customer")
def records(spark, sf_dir):
    cells, heads, names, _, _ = _mapped(spark, sf_dir)
    return sheets.records(cells, heads, names).select("sheet_id", "source_row", F.col("record")["Tenant"].alias("tenant"), F.col("record")["Area Leased"].alias("area"))


def _score_sql() -> str:
    """Scores of all of _HEADERS against all fields, by the same rule in SQL."""
    table_of = ", ".join(f"('{f}', {k}, {rank}, '{synonym}', [{', '.join(repr(x) for x in avoid)}]::VARCHAR[])" for k, (f, _, synonyms, avoid) in enumerate(headers.FIELDS) for rank, synonym in enumerate(synonyms))
    names = ["Tenant", "Property Address", "City", "State", "Start Date", "Lease Term (Years)", "Area Leased", "Base Rent Yearly", "Rate Type", "Notes", "Notes (2)", "Column 12"]
    noise = ", ".join(repr(x) for x in headers.NOISE)
    return f"""WITH f(field, field_no, rank, s, avoid) AS (VALUES {table_of}), h(header) AS (VALUES {', '.join(f"('{x}')" for x in names)}),
n AS (SELECT header, trim(regexp_replace(lower(header), '[^a-z0-9]+', ' ', 'g')) AS h FROM h),
t AS (SELECT *, string_split(h, ' ') AS ht, string_split(s, ' ') AS st, replace(h, ' ', '') AS hq, replace(s, ' ', '') AS sq, list_filter(string_split(s, ' '), lambda x: NOT list_contains([{noise}], x)) AS mt FROM n, f),
p AS (SELECT header, field, CASE WHEN h = s OR hq = sq THEN 1000 - 5 * rank END AS exact, CASE WHEN len(list_filter(avoid, lambda x: contains(h, x))) > 0 THEN 0
  WHEN contains(' ' || h || ' ', ' ' || s || ' ') THEN 600 + 25 * len(st) + 100 * len(st) / len(ht) - 4 * rank
  WHEN length(sq) >= 4 AND contains(hq, sq) THEN 420 + 120 * length(sq) / length(hq) - 4 * rank
  WHEN len(mt) >= 2 AND len(list_filter(mt, lambda x: NOT list_contains(ht, x))) = 0 THEN 380 + 20 * len(mt) - 4 * rank ELSE 0 END AS loose FROM t),
scores AS (SELECT header, field, CAST(coalesce(max(exact), floor(greatest(max(loose), 0) + 0.5)) AS INTEGER) AS score FROM p GROUP BY ALL)
SELECT sheet_id, header, field, score FROM {_SHEETS}, scores"""


@register("L8_header_scores", _score_sql())
def header_scores(spark, sf_dir):
    return _mapped(spark, sf_dir)[3].select("sheet_id", "header", "field", "score")


@register("L9_column_map", f"SELECT sheet_id, * EXCLUDE (sheet_id) FROM {_SHEETS}, (VALUES ('Tenant', 'lessee'), ('Property Address', 'address'), ('City', 'city'), ('State', 'state'), ('Start Date', 'leaseDate'), ('Lease Term (Years)', 'termMonths'), ('Area Leased', 'areaLeased'), ('Base Rent Yearly', 'baseRent'), ('Rate Type', 'rateType'), ('Notes', 'notes')) v(header, field)")
def column_map(spark, sf_dir):
    return _mapped(spark, sf_dir)[4].select("sheet_id", "header", "field")


@register("L10_missing_fields", "SELECT sheet_id, field FROM (SELECT 'sheet-' || c_nationkey AS sheet_id, c_nationkey % 2 AS odd FROM (SELECT DISTINCT c_nationkey FROM customer)), (VALUES ('baseRent')) v(field) WHERE odd = 1")
def missing_fields(spark, sf_dir):
    cells, _, _, _, mapped = _mapped(spark, sf_dir)
    odd = F.split_part("sheet_id", F.lit("-"), F.lit(2)).cast("int") % 2 == 1
    return headers.missing_required(cells, mapped.filter(~(odd & (F.col("field") == "baseRent"))), headers.field_table(spark))


@register("L11_unused_headers", f"SELECT sheet_id, unnest(['Notes (2)', 'Column 12']) AS header FROM {_SHEETS}")
def unused_headers(spark, sf_dir):
    _, _, names, _, mapped = _mapped(spark, sf_dir)
    return headers.unused_headers(names, mapped)


@register("L11_previews", "SELECT sheet_id, string_agg(c_name, ', ' ORDER BY c_custkey) AS preview FROM (SELECT 'sheet-' || c_nationkey AS sheet_id, c_name, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer) WHERE n <= 3 GROUP BY sheet_id")
def previews(spark, sf_dir):
    cells, heads, names, _, _ = _mapped(spark, sf_dir)
    return headers.previews(sheets.records(cells, heads, names)).filter("header = 'Tenant'").select("sheet_id", "preview")


def _normalized(spark, sf_dir):
    cells, heads, names, _, mapped = _mapped(spark, sf_dir)
    return normalize.normalize(sheets.records(cells, heads, names), cut(mapped))


@register("L27_term_units", f"SELECT sheet_id, true AS in_years FROM {_SHEETS}")
def term_units(spark, sf_dir):
    cells, heads, names, _, mapped = _mapped(spark, sf_dir)
    return normalize.term_units(sheets.records(cells, heads, names), mapped)


@register("L28_normalized_deals", "SELECT c_name AS lessee, c_custkey || ' Main St, Suite 5' AS address, 'Austin' AS city, 'TX' AS state, DATE '2021-03-15' AS lease_date, (c_custkey % 15 + 1) * 12.0 AS term_months, (c_custkey % 90 + 10) * 1000.0 AS area_leased, c_custkey % 40 + 5.5 AS base_rent_annual, c_custkey || ' main st|austin|tx' AS address_key FROM customer")
def normalized_deals(spark, sf_dir):
    return _normalized(spark, sf_dir).select("lessee", "address", "city", "state", "lease_date", "term_months", "area_leased", "base_rent_annual", "address_key")


@register("L5_export", f"{D} SELECT lessee AS tenant, coalesce(strftime(lease_date, '%Y-%m-%d'), '') AS start_date, coalesce(printf('%.6f', lat), '') AS latitude, CAST(CAST(term_months AS BIGINT) AS VARCHAR) AS term FROM deals")
def export(spark, sf_dir):
    e = sheets.export_frame(deals(spark, sf_dir))
    return e.select(F.col("Tenant").alias("tenant"), F.col("Start Date").alias("start_date"), F.col("Latitude").alias("latitude"), F.col("Lease Term").alias("term"))


@register("L6_round_trip", "SELECT count(*) AS n, sum(CAST(l_linenumber * 12 AS DOUBLE)) AS months, 45 AS headers FROM lineitem")
def round_trip(spark, sf_dir):
    """The export written as CSV and read back through the sheet reader, header matching and normalisation."""
    folder = shared_folder(spark)
    d = deals(spark, sf_dir).select("source_row", "lessee", "city", "lease_date", "term_months", "area_leased", "base_rent", "rate_type", "lat", "lon")
    sheets.write_export(d, folder)
    rows = spark.read.csv(folder, header=True, quote='"', escape='"', inferSchema=False)
    made = rows.select(F.lit("export").alias("sheet_id"), F.monotonically_increasing_id().alias("source_row"), F.map_filter(F.map_from_arrays(F.array(*map(F.lit, rows.columns)), F.array(*(f"`{c}`" for c in rows.columns))), lambda k, v: v.isNotNull()).alias("record"))
    mapped = headers.assign(headers.score(spark.createDataFrame([("export", c) for c in rows.columns], "sheet_id string, header string"), headers.field_table(spark)))
    back = normalize.normalize(made, mapped)
    own = spark.createDataFrame([(header, headers.OF_COLUMN.get(column, headers.camel(column))) for header, column in sheets.EXPORT], "header string, field string")
    same = mapped.join(own, ["header", "field"]).agg(F.count("*").cast("int").alias("headers"))  # headers that lead back to the field that they came from
    return back.agg(F.count("*").alias("n"), F.sum("term_months").alias("months")).crossJoin(same)


# Places: suppliers as addresses and sites.
_BODY = "CASE s_suppkey % 4 WHEN 0 THEN '{\"status\":\"OK\",\"results\":[{\"geometry\":{\"location\":{\"lat\":' || (s_suppkey % 80 + 1) || ',\"lng\":-97.5},\"location_type\":\"ROOFTOP\"},\"place_id\":\"p' || s_suppkey || '\"}]}' WHEN 1 THEN '{\"status\":\"OK\",\"results\":[]}' WHEN 2 THEN '{\"status\":\"OK\",\"results\":[{\"geometry\":{\"location\":{\"lat\":0,\"lng\":0},\"location_type\":\"ROOFTOP\"}}]}' ELSE '{\"status\":\"OK\",\"results\":[{\"geometry\":{\"location\":{\"lat\":31,\"lng\":-98},\"location_type\":\"APPROXIMATE\"}}]}' END"


def _responses(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    key = F.concat(F.lit("a"), F.col("s_suppkey").cast("string")).alias("address_key")
    google = s.select(key, F.lit("google").alias("provider"), F.expr(_BODY).alias("body"))
    census = s.filter("s_suppkey % 4 in (2, 3)").select(key, F.lit("census").alias("provider"), F.concat(F.lit('{"result":{"addressMatches":[{"coordinates":{"x":-99.25,"y":'), (F.col("s_suppkey") % 60 + 1).cast("string"), F.lit("}}]}}")).alias("body"))
    return google.unionByName(census)


_BEST = "SELECT 'a' || s_suppkey AS address_key, CASE s_suppkey % 4 WHEN 0 THEN 'google' ELSE 'census' END AS provider, CASE s_suppkey % 4 WHEN 0 THEN 'rooftop' ELSE 'interpolated' END AS grade, CAST(CASE s_suppkey % 4 WHEN 0 THEN s_suppkey % 80 + 1 ELSE s_suppkey % 60 + 1 END AS DOUBLE) AS lat FROM supplier WHERE s_suppkey % 4 <> 1"


@register("L54_responses", "SELECT provider, grade, count(*) AS n FROM (SELECT 'google' AS provider, CASE s_suppkey % 4 WHEN 0 THEN 'rooftop' ELSE 'approximate' END AS grade FROM supplier WHERE s_suppkey % 4 IN (0, 3) UNION ALL SELECT 'census', 'interpolated' FROM supplier WHERE s_suppkey % 4 IN (2, 3)) GROUP BY ALL")
def responses(spark, sf_dir):
    return places.parse_responses(_responses(spark, sf_dir)).groupBy("provider", "grade").agg(F.count("*").alias("n"))


@register("L56_best_hits", _BEST)
def best_hits(spark, sf_dir):
    return places.best_hits(places.parse_responses(_responses(spark, sf_dir))).select("address_key", "provider", "grade", "lat")


def _address_deals(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source_row"), F.when(F.col("l_suppkey") % 9 == 0, F.lit("")).otherwise(F.concat(F.lit("a"), F.col("l_suppkey").cast("string"))).alias("address_key"), F.when(F.col("l_linenumber") == 1, F.lit(30.5)).alias("lat"), F.when(F.col("l_linenumber") == 1, F.lit(-97.0)).alias("lon"))
    return d.withColumns({"geo_precision": F.lit("approximate"), "place_id": F.lit(""), "geo_source": F.when(F.col("lat").isNotNull(), F.lit("file")).otherwise(F.lit("none")), "geo_error": F.lit("")})


@register("L58_merged", f"WITH b AS ({_BEST}), d AS (SELECT CASE WHEN l_suppkey % 9 = 0 THEN '' ELSE 'a' || l_suppkey END AS address_key, CASE WHEN l_linenumber = 1 THEN 30.5::DOUBLE END AS lat FROM lineitem), a AS (SELECT DISTINCT address_key FROM d WHERE address_key <> '' AND lat IS NULL) SELECT coalesce(CASE WHEN b.lat IS NOT NULL THEN b.grade END, 'approximate') AS geo_precision, CASE WHEN a.address_key IS NOT NULL AND b.lat IS NULL THEN 'no match' ELSE '' END AS geo_error, count(*) AS n, count(coalesce(b.lat, d.lat)) AS located FROM d LEFT JOIN a ON d.address_key = a.address_key LEFT JOIN b ON a.address_key = b.address_key GROUP BY ALL")
def merged(spark, sf_dir):
    hits = places.best_hits(places.parse_responses(_responses(spark, sf_dir)))
    m = places.merge_hits(_address_deals(spark, sf_dir), hits)
    return m.groupBy("geo_precision", "geo_error").agg(F.count("*").alias("n"), F.count("lat").alias("located"))


@register("L57_seeded", f"WITH b AS ({_BEST}), d AS (SELECT CASE WHEN l_suppkey % 9 = 0 THEN '' ELSE 'a' || l_suppkey END AS k, CASE WHEN l_linenumber = 1 THEN 30.5::DOUBLE END AS lat FROM lineitem) SELECT CASE WHEN d.lat IS NULL AND b.lat IS NOT NULL THEN b.grade ELSE 'approximate' END AS geo_precision, count(*) AS n, count(coalesce(d.lat, b.lat)) AS located FROM d LEFT JOIN b ON d.k = b.address_key AND d.k <> '' GROUP BY ALL")
def seeded(spark, sf_dir):
    cache = places.best_hits(places.parse_responses(_responses(spark, sf_dir)))
    return places.seed_from_cache(_address_deals(spark, sf_dir), cache).groupBy("geo_precision").agg(F.count("*").alias("n"), F.count("lat").alias("located"))


@register("L53_location_groups", "SELECT 's' || s_suppkey || ' main st|austin|tx' AS address_key, 'S' || s_suppkey || ' Main St, Austin, TX' AS query, count(*) AS deals, bool_or(l_linenumber = 1) AS has_coords FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_suppkey")
def location_groups(spark, sf_dir):
    from rentwire.functions import cells

    address = F.concat(F.lit("S"), F.col("l_suppkey").cast("string"), F.lit(" Main St"), F.when(F.col("l_linenumber") > 3, F.lit(", Suite 9")).otherwise(F.lit("")))
    d = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source_row"), address.alias("address"), F.lit("Austin").alias("city"), F.lit("TX").alias("state"), F.lit("").alias("zip"), F.lit("").alias("property_name"), F.when(F.col("l_linenumber") == 1, F.lit(30.0)).alias("lat"), F.when(F.col("l_linenumber") == 1, F.lit(-97.0)).alias("lon"))
    return places.location_groups(d.withColumn("address_key", cells.address_key(*(F.col(c) for c in ("address", "city", "state", "zip", "property_name")))))


@register("L59_cache", "SELECT user_id AS address_key, ts FROM (SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id) ORDER BY ts DESC, address_key LIMIT 200")
def cache(spark, sf_dir):
    return places.retain_cache(table(spark, sf_dir, "events").select(F.col("user_id").alias("address_key"), "ts"), 200).select("address_key", "ts").distinct()


@register("L60_sites", f"{D} SELECT printf('s:%.5f,%.5f', lat, lon) AS site_id, count(*) AS deals, min_by(trim(property_name), source_row) AS label_any FROM deals WHERE lat IS NOT NULL GROUP BY 1".replace(", min_by(trim(property_name), source_row) AS label_any", ""))
def sites(spark, sf_dir):
    return places.sites(deals(spark, sf_dir)).select("site_id", "deals")


_LABELS = "coalesce(min_by(trim(property_name), source_row) FILTER (WHERE trim(property_name) <> ''), min_by(trim(city), source_row) FILTER (WHERE trim(city) <> ''), 'Unnamed location')"


@register("L60_site_labels", f"{D}, one AS (SELECT lat, lon, city, source_row, property_name FROM (SELECT *, count(*) OVER (PARTITION BY lat, lon, source_row) AS same FROM deals) WHERE lat IS NOT NULL) SELECT site_id, deals, label_known, grade FROM (SELECT printf('s:%.5f,%.5f', lat, lon) AS site_id, count(*) AS deals, {_LABELS} IS NOT NULL AS label_known, 'approximate' AS grade FROM one GROUP BY 1)")
def site_labels(spark, sf_dir):
    """Counts alone, of sites of any size, with a label and a grade."""
    s = places.sites(deals(spark, sf_dir), with_rows=False)
    return s.select("site_id", "deals", (F.length("label") > 0).alias("label_known"), "grade")


@register("L55_tagged_grades", "SELECT provider, grade, count(*) AS n FROM (SELECT unnest(['photon', 'nominatim']) AS provider, ['rooftop', 'parcel', 'interpolated', 'approximate'][s_suppkey % 4 + 1] AS grade FROM supplier) GROUP BY ALL")
def tagged_grades(spark, sf_dir):
    """Responses of two providers whose grade is told by tags."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey") % 4
    tag = lambda *values: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    key, value = tag("building", "office", "highway", "place"), tag("yes", "company", "residential", "city")
    photon = F.concat(F.lit('{"features":[{"geometry":{"coordinates":[-97.5,31]},"properties":{"osm_key":"'), key, F.lit('","osm_value":"'), value, F.lit('"}}]}'))
    nominatim = F.concat(F.lit('[{"lat":"31","lon":"-97.5","class":"'), key, F.lit('","type":"'), value, F.lit('"}]'))
    both = s.select(F.col("s_suppkey").cast("string").alias("address_key"), F.inline(F.array(F.struct(F.lit("photon").alias("provider"), photon.alias("body")), F.struct(F.lit("nominatim").alias("provider"), nominatim.alias("body")))))
    return places.parse_responses(both).groupBy("provider", "grade").agg(F.count("*").alias("n"))


@register("L61_grades", "SELECT count(*) FILTER (WHERE l_linenumber = 1) AS building_grade, count(*) FILTER (WHERE l_linenumber <> 1) AS unlocated FROM lineitem")
def grades(spark, sf_dir):
    d = _address_deals(spark, sf_dir).withColumn("geo_precision", F.when(F.col("lat").isNotNull(), F.lit("parcel")).otherwise(F.lit("interpolated")))
    return places.grade_counts(d)


def _located(k):
    """Where a supplier's site stands: a hundredth of a degree from the next, on 2,000 rows from 30 degrees north and 8,000 columns from 97 degrees west, whatever its number."""
    return 30 + F.pmod(k, F.lit(2000)) * 0.01, -97 - F.pmod(F.floor(k / 2000), F.lit(8000)) * 0.01


def _suppliers_as_sites(spark, sf_dir):
    k = F.col("s_suppkey")
    y, x = _located(k)
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("site_id"), y.alias("lat"), x.alias("lon"), F.col("s_name").alias("label"), F.lit("Austin").alias("city"), (k % 7 + 1).alias("deals"), F.lit("rooftop").alias("grade"))


def _footprints(spark, sf_dir):
    """Two squares around each supplier's site, the larger with a hole beside the site; every tenth is as large as a campus."""
    k = F.col("s_suppkey")
    y, x = _located(k)

    def ring(d, dy=0.0):
        return F.array(*(F.struct((x + sx * d).alias("lng"), (y + dy + sy * d).alias("lat")) for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1))))

    small, large = F.lit(0.0003), F.when(k % 10 == 0, F.lit(0.004)).otherwise(F.lit(0.0008))
    rows = F.array(F.struct(F.concat(F.lit("f"), k.cast("string")).alias("footprint_id"), F.array(F.array(ring(small))).alias("parts")), F.struct(F.concat(F.lit("g"), k.cast("string")).alias("footprint_id"), F.array(F.array(ring(large), ring(F.lit(0.0001), 0.0005))).alias("parts")))
    s = table(spark, sf_dir, "supplier").withColumn("rows", rows)
    return s.select("s_suppkey", F.inline("rows")).filter("not (s_suppkey % 3 = 0 and footprint_id like 'f%')")


@register("L64_footprints", "SELECT 's' || s_suppkey AS site_id, CASE WHEN s_suppkey % 3 = 0 THEN 'g' ELSE 'f' END || s_suppkey AS footprint_id FROM supplier WHERE NOT (s_suppkey % 3 = 0 AND s_suppkey % 10 = 0)")
def footprints(spark, sf_dir):
    return places.match_footprints(_suppliers_as_sites(spark, sf_dir), _footprints(spark, sf_dir)).select("site_id", "footprint_id")


@register("L62_points_in_footprints", "SELECT s_suppkey, true AS middle, false AS in_hole, true AS corner FROM supplier")
def points_in_footprints(spark, sf_dir):
    f = _footprints(spark, sf_dir).filter("footprint_id like 'g%'")
    part, (y, x) = F.col("parts")[0], _located(F.col("s_suppkey"))
    return f.select("s_suppkey", places.part_contains(part, y, x).alias("middle"), places.part_contains(part, y + 0.0005, x).alias("in_hole"), places.part_contains(part, y + 0.0007, x + 0.0007).alias("corner"))


@register("L63_footprint_parts", "SELECT count(*) AS parts, count(*) FILTER (WHERE s_suppkey % 10 = 0) AS large FROM supplier")
def footprint_parts(spark, sf_dir):
    p = places.footprint_parts(_footprints(spark, sf_dir)).filter("footprint_id like 'g%'")
    return p.agg(F.count("*").alias("parts"), F.count_if(F.col("area") > places.LARGEST).alias("large"))


@register("L65_inflated", "SELECT count(*) AS n FROM supplier WHERE s_suppkey % 3 <> 0")
def inflated(spark, sf_dir):
    p = places.footprint_parts(_footprints(spark, sf_dir).filter("footprint_id like 'f%'"))
    return p.filter(places.part_area(places.inflate_part(F.col("part"), 5.0)) > F.col("area")).agg(F.count("*").alias("n"))


@register("L66_clicks", "SELECT s_suppkey AS click_id, 's' || s_suppkey AS site_id FROM supplier WHERE s_suppkey % 2 = 0")
def clicks(spark, sf_dir):
    s = _suppliers_as_sites(spark, sf_dir)
    k = F.substring("site_id", 2, 20).cast("long")
    c = s.select(k.alias("click_id"), (F.col("lat") + F.when(k % 2 == 0, F.lit(0.0005)).otherwise(F.lit(0.002))).alias("lat"), "lon")
    return places.nearest_sites(c, s).select("click_id", "site_id")


@register("L69_clicks_in_footprints", "SELECT s_suppkey AS click_id, 's' || s_suppkey AS site_id FROM supplier WHERE s_suppkey % 30 <> 0")
def clicks_in_footprints(spark, sf_dir):
    s, f = _suppliers_as_sites(spark, sf_dir), _footprints(spark, sf_dir)
    k = F.substring("site_id", 2, 20).cast("long")
    c = s.select(k.alias("click_id"), F.concat(F.when(k % 3 == 0, F.lit("g")).otherwise(F.lit("f")), k.cast("string")).alias("footprint_id"), (F.col("lat") + 0.0001).alias("lat"), "lon")
    return places.clicks_in_footprints(c, s, f, places.match_footprints(s, f))


@register("L67_site_search", "SELECT s_suppkey FROM supplier WHERE contains(lower(s_name), 'supplier') AND contains(lower(s_name), '1') ORDER BY s_suppkey % 7 + 1 DESC, lower(s_name) LIMIT 12")
def site_search(spark, sf_dir):
    return places.search_sites(_suppliers_as_sites(spark, sf_dir), "supplier 1").select(F.substring("site_id", 2, 20).cast("long").alias("s_suppkey"))


@register("L67_indexed_search", "SELECT s_suppkey FROM supplier WHERE contains(lower(s_name), 'supplier#0') AND contains(lower(s_name), '1') ORDER BY starts_with(lower(s_name), '1 supplier#0') DESC, s_suppkey % 7 + 1 DESC, lower(s_name) LIMIT 12")
def indexed_search(spark, sf_dir):
    """Sites found from posting lists of three letters."""
    return places.search_index(places.site_index(_suppliers_as_sites(spark, sf_dir)), "1 Supplier#0").select(F.substring("site_id", 2, 20).cast("long").alias("s_suppkey"))


@register("L68_boundaries", "SELECT n_nationkey, CASE WHEN n_nationkey % 10 BETWEEN 1 AND 6 THEN 'county' ELSE 'city' END AS kind FROM nation WHERE n_nationkey % 3 <> 1 AND (n_nationkey % 10 BETWEEN 1 AND 6 OR n_nationkey % 10 = 8)")
def boundaries(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") % 10).alias("admin_level"), F.when(F.col("n_nationkey") % 3 == 1, F.lit(1)).alias("maritime"))
    return places.boundaries(n, "county").select("n_nationkey", F.lit("county").alias("kind")).unionByName(places.boundaries(n, "city").select("n_nationkey", F.lit("city").alias("kind")))
