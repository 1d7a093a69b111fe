"""Stored article pages: text, links and pictures, their status, key points, and the join to articles.

Only the reading of markup is Python, in Arrow batches: a page becomes a flat list of marks, and running sums over it say
which text lies in paragraphs and which in page furniture. Every choice (boilerplate, picture, status, key points) is a
column expression over what was read.
"""

from __future__ import annotations

import html as references
import re
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rentwire.functions import news

#: Elements that hold an article's paragraphs, page furniture, and elements whose text is none.
TEXTUAL = frozenset("p li h1 h2 h3 blockquote".split())
FURNITURE = frozenset("nav header footer aside form".split())
#: Other elements that a paragraph or a list entry cannot reach out of.
HOLDERS = frozenset("article section main div ul ol table tbody tr td".split())
SILENT = FURNITURE | frozenset("script style noscript svg figure figcaption button iframe select template".split())
#: Names of a page's own picture, best first.
OWN_PICTURE = (("og:image", "og:image:url", "og:image:secure_url"), ("twitter:image", "twitter:image:src"))
LEAST_PARAGRAPH = 60

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style)\b.*?</(?P=raw)\s*>|<(?P<shut>/?)(?P<tag>[a-z][a-z0-9]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[^<>]*>", re.I | re.S)
_ATTRIBUTE = re.compile(r"([a-z][\w:-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
READ = "url string, paragraphs array<string>, links array<string>, own array<struct<url:string,kind:int>>, pictures array<struct<url:string,alt:string,width:string,height:string,late:boolean>>"


def _with_implied_ends(marks: list[tuple]) -> list[tuple]:
    """The marks with an end for each paragraph or list entry that has none: where the next one begins, or what it stands in ends."""
    out: list[tuple] = []
    open_: list[str] = []  # the textual elements that are open, and what else was opened inside of one

    def end(*tags: str) -> None:
        """Ends the innermost open element if it is one of these."""
        if open_ and open_[-1] in tags:
            out.append((open_.pop(), -1, "", {}))

    for tag, turn, text, attributes in marks:
        if turn > 0 and tag in TEXTUAL:
            end("p")
            if tag == "li":
                end("li")
            open_.append(tag)
        elif turn > 0 and tag in HOLDERS:
            if open_:
                open_.append(tag)
        elif turn < 0 and tag in HOLDERS | TEXTUAL:
            if tag != "p":
                end("p")
            if tag in HOLDERS:
                end("li")
            if open_ and open_[-1] == tag:
                open_.pop()
            elif tag in TEXTUAL:
                tag = ""  # nothing of it is open
        out.append((tag, turn, text, attributes))
    return out


def _depths(turns: list[int]) -> list[int]:
    """How many elements are open behind each mark."""
    return list(accumulate(turns, lambda depth, turn: max(0, depth + turn)))


def read_page(page: str) -> tuple[list[str], list[str], list[dict], list[dict]]:
    """Paragraphs, links, the page's own pictures and those in its body. A paragraph is the text of an outermost textual element; one that nothing ends is none."""
    marks: list[tuple[str, int, str, dict]] = []  # tag, +1 or -1, the text behind it, attributes
    found = list(_MARK.finditer(page))
    for m, after in zip(found, [*(x.start() for x in found[1:]), len(page)]):
        tag = (m["tag"] or "").lower()
        attributes = {k.lower(): references.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(m["attrs"])} if tag in ("a", "img", "meta") and not m["shut"] else {}
        marks.append((tag, -1 if m["shut"] else 1, page[m.end() : after], attributes))
    marks = _with_implied_ends(marks)
    turns = lambda tags: [turn if tag in tags else 0 for tag, turn, _, _ in marks]
    silent, furniture = _depths(turns(SILENT)), _depths(turns(FURNITURE))
    textual = _depths([min(turn, 0) if quiet else turn for turn, quiet in zip(turns(TEXTUAL), silent)])
    begun = list(accumulate((now > 0 and before == 0 for before, now in zip([0, *textual], textual)), int.__add__))
    closed = begun[-1] - (textual[-1] > 0) if marks else 0
    heard = [(n, text) for (_, _, text, _), n, quiet, depth in zip(marks, begun, silent, textual) if depth and not quiet and n <= closed]
    paragraphs = [" ".join(references.unescape("".join(text for _, text in own)).split()) for _, own in groupby(heard, lambda x: x[0])]
    links, own, pictures = [], [], []
    for (tag, _, _, a), depth in zip(marks, furniture):
        if tag == "a" and a.get("href", "").startswith("http"):
            links.append(a["href"])
        elif tag == "meta" and a.get("content", "").strip():
            name = (a.get("property") or a.get("name") or "").lower()
            own += [{"url": a["content"].strip(), "kind": k} for k, names in enumerate(OWN_PICTURE) if name in names]
        elif tag == "img" and a and not depth:
            late = next((a[k] for k in ("data-src", "data-lazy-src", "data-original") if a.get(k)), "")
            src = late or a.get("src", "")
            if (not src or src.startswith("data:")) and a.get("srcset", "").split():
                late = src = a["srcset"].rpartition(",")[2].split()[0]
            if src and not src.startswith("data:"):
                pictures.append({"url": src.strip(), "alt": a.get("alt", "").strip(), "width": a.get("width", ""), "height": a.get("height", ""), "late": bool(late)})
    return paragraphs, links, own, pictures


def read(pages: DataFrame, most_page: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """READ's columns of stored pages (url, html), and their columns ``keep`` as they are. most_page: characters of a page that are read; None reads it whole."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [read_page((x or "")[:most_page]) for x in part.column("html").to_pylist()]
                kinds = (pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.struct([("url", pa.string()), ("kind", pa.int32())])), pa.list_(pa.struct([("url", pa.string()), ("alt", pa.string()), ("width", pa.string()), ("height", pa.string()), ("late", pa.bool_())])))
                made = [part.column("url"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)), *map(part.column, keep)]
                yield pa.RecordBatch.from_arrays(made, ["url", "paragraphs", "links", "own", "pictures", *keep])

    kinds = dict(pages.dtypes)
    return pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), *keep).mapInArrow(run, ", ".join([READ, *(f"`{c}` {kinds[c]}" for c in keep)]))


def _any_of(x: Column, words: tuple[str, ...]) -> Column:
    lowered = F.lower(x)
    return F.exists(F.array(*map(F.lit, words)), lambda w: lowered.contains(w)) if words else F.lit(False)


def body_text(paragraphs: Column, boilerplate: tuple[str, ...] = (), most_text: int | None = None) -> Column:
    """Paragraphs of LEAST_PARAGRAPH characters or more, a line each; none whose first 200 characters hold a phrase of ``boilerplate`` (in lower case). most_text: characters kept; None keeps all."""
    kept = F.filter(paragraphs, lambda p: (F.length(p) >= LEAST_PARAGRAPH) & ~_any_of(F.substring(p, 1, 200), boilerplate))
    text = F.array_join(kept, "\n")
    return text if most_text is None else F.substring(text, 1, most_text)


def _absolute(base: Column, url: Column) -> Column:
    """A link as seen from a page."""
    origin = F.regexp_extract(base, r"^[a-z][a-z0-9+.-]*://[^/?#]+", 0)
    folder = F.regexp_extract(base, r"^[a-z][a-z0-9+.-]*://[^/?#]+(/(?:[^?#]*/)?)?", 0)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    scheme = F.substring_index(base, ":", 1)
    return F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), url).when(url.startswith("//"), F.concat(scheme, F.lit(":"), url)).when(url.startswith("/"), F.concat(origin, url)).otherwise(F.concat(folder, url))


def _pixels(x: Column) -> Column:
    return F.coalesce(F.regexp_extract(x, r"^\s*(\d+)\s*(?:px)?\s*$", 1).try_cast("int"), F.lit(0))


def _thumbnail(url: Column) -> Column:
    """Whether an address says that the picture is a small copy: by the word, or by a size of two or three digits a side before the ending, as in ``x-150x90.jpg``."""
    whole = lambda n: F.length(n).between(2, 3) & n.try_cast("int").isNotNull()
    sized = lambda part: (F.size(F.split(F.substring_index(part, ".", 1), "x")) == 2) & F.forall(F.split(F.substring_index(part, ".", 1), "x"), whole) & part.contains(".")
    return F.lower(url).contains("thumb") | F.exists(F.slice(F.split(F.lower(url), "-"), 2, 1 << 20), sized)


def picture(url: Column, title: Column, own: Column, pictures: Column, excluded: tuple[str, ...] = (), most: int = 25) -> Column:
    """Struct of url, alt, origin: the page's own picture, else the best of the first ``most`` in its body, if it is worth 2 points or more.

    Points: up to 3 for an early place (half a one less for each before), 3 or 2 for 240,000 or 60,000 pixels, 1.5 for each of
    up to three words that its description shares with the headline (by six letters), half a one if it loads late, one less
    for a thumbnail. Pictures with a side under 120, or with a word of ``excluded`` (in lower case) in their address, are none.
    """
    usable = lambda x: ~_any_of(x["url"], excluded)
    published = F.try_element_at(F.array_sort(F.transform(F.filter(own, usable), lambda x, i: F.struct(x["kind"].alias("kind"), i.alias("i"), x["url"].alias("url")))), F.lit(1))
    wanted = F.array_distinct(F.transform(F.filter(news.title_tokens(title), lambda w: F.length(w) >= 4), lambda w: F.substring(w, 1, 6)))

    def points(x: Column, i: Column) -> Column:
        wide, high = _pixels(x["width"]), _pixels(x["height"])
        alt = F.concat(F.lit(" "), news.normalize_title(x["alt"]))
        shared = F.size(F.filter(wanted, lambda w: alt.contains(F.concat(F.lit(" "), w))))
        size = F.when(wide * high >= 240_000, 3.0).when(wide * high >= 60_000, 2.0).otherwise(0.0)
        small = wide.between(1, 119) | high.between(1, 119)
        total = F.greatest(F.lit(0.0), 3 - i / 2) + size + 1.5 * F.least(F.lit(3), shared) + F.when(x["late"], 0.5).otherwise(0.0) - F.when(_thumbnail(x["url"]), 1.0).otherwise(0.0)
        return F.struct(F.when(usable(x) & ~small, total).otherwise(F.lit(-1.0)).alias("points"), (-i).alias("place"), x["url"].alias("url"), x["alt"].alias("alt"))

    best = F.array_max(F.transform(F.slice(pictures, 1, most), points))
    made = lambda at, alt, origin: F.struct(_absolute(url, at).alias("url"), alt.alias("alt"), F.lit(origin).alias("origin"))
    return F.when(published.isNotNull(), made(published["url"], title, "publisher")).when(best["points"] >= 2, made(best["url"], F.when(best["alt"] != "", best["alt"]).otherwise(title), "in-article"))


def extract(pages: DataFrame, boilerplate: tuple[str, ...] = (), excluded: tuple[str, ...] = (), most_page: int | None = None, most_text: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """url, ``keep`` (more columns of the pages), text, links, image of stored pages (url, html and, for the picture's choice, title): a row for each, also where pages share a url. Pages are read whole unless the caller bounds them."""
    titled = "title" in pages.columns
    found = read(pages, most_page, tuple(dict.fromkeys([*keep, *["title"] * titled])))
    title = F.coalesce(F.col("title").cast("string"), F.lit("")) if titled else F.lit("")
    return found.select("url", *keep, body_text(F.col("paragraphs"), boilerplate, most_text).alias("text"), "links", picture(F.col("url"), title, F.col("own"), F.col("pictures"), excluded).alias("image"))


def redirect_target(links: Column, hosts: tuple[str, ...]) -> Column:
    """The first link that leads outside ``hosts`` (those of the service that redirects, with their subdomains)."""
    own = "|".join(re.escape(h) for h in hosts)
    host = lambda u: F.coalesce(F.try_parse_url(u, F.lit("HOST")), F.lit(""))
    return F.try_element_at(F.filter(links, lambda u: (host(u) != "") & ~host(u).rlike(rf"(^|\.)({own})$")), F.lit(1))


def status(title: Column, text: Column) -> Column:
    """ok, partial or unavailable, by length and by whether the page fits the headline."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when((n < 120) | ~news.matches_title(title, text), F.lit("unavailable")).when(n < 450, F.lit("partial")).otherwise(F.lit("ok"))


def enrich(articles: DataFrame, pages: DataFrame, budget: int | None = 40, key: str = "url") -> DataFrame:
    """Articles with article_text, text_status and image; only the ``budget`` best by score are looked up (None: all). The page's picture beats the feed's.

    key: the column by which articles find their pages. Of several pages of a key the one of the longest text counts, then the greatest.
    """
    best = pages.groupBy(F.col(key).alias("_u")).agg(F.max(F.struct(F.length("text").alias("n"), "text", "image")).alias("_p"))
    found = best.select("_u", F.col("_p.text").alias("_text"), F.col("_p.image").alias("_image"))
    asked = F.lit(True).alias("asked")
    wanted = articles.select("*", asked) if budget is None else articles.join(articles.orderBy(F.desc("score"), "seq").limit(budget).select("seq", asked), "seq", "left")
    joined = wanted.join(found, (F.col(key) == F.col("_u")) & F.col("asked"), "left")
    state = F.when(F.col("asked").isNull(), F.lit("skipped")).otherwise(status(F.col("title"), F.col("_text")))
    joined = joined.withColumn("text_status", state)
    text = F.when(F.col("text_status").isin("ok", "partial"), F.col("_text")).otherwise(F.lit(""))
    picture = F.coalesce(F.when(F.col("text_status") != "unavailable", F.col("_image")), F.col("image")) if "image" in articles.columns else F.col("_image")
    return joined.withColumn("article_text", text).withColumn("image", picture).drop("_u", "_text", "_image", "asked")


def status_counts(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("text_status").agg(F.count("*").alias("n"))


def key_points(articles: DataFrame, categories: tuple[tuple[str, tuple[tuple[str, int], ...]], ...] = (), most: int = 3, first: int = 40) -> DataFrame:
    """The articles with key_points: the ``most`` telling of the ``first`` sentences, none too like a better one, in the article's order.

    Points: 3.5, 2 and 1 for the first three places, 2 for a digit, one less for an opening quote, 0.3 for each of up to four
    words of the headline, half a one for each of up to three points that its phrases give it in a category. A text
    without sentences falls back to the summary.
    """
    headline = news.title_tokens(F.col("title"))

    def told(s: Column) -> list[Column]:
        return [0.5 * F.least(F.lit(3), news.phrase_match(s, terms)["s"]) for _, terms in categories]

    def scored(s: Column, i: Column) -> Column:
        own = news.title_tokens(s)
        total = F.when(i == 0, 3.5).when(i == 1, 2.0).when(i == 2, 1.0).otherwise(0.0) + F.when(s.rlike(r"\d"), 2.0).otherwise(0.0) - F.when(s.rlike("^[\"“]"), 1.0).otherwise(0.0)
        total = total + 0.3 * F.least(F.lit(4), F.size(F.array_intersect(headline, own))) + sum(told(s), F.lit(0.0))
        return F.struct((-F.round(total, 6)).alias("order"), i.alias("i"), s.alias("s"), own.alias("words"))

    def pick(picked: Column, x: Column) -> Column:
        like = lambda p: F.size(F.array_intersect(p["words"], x["words"])) > 0.6 * F.greatest(F.lit(1), F.size(F.array_union(p["words"], x["words"])))
        return F.when((F.size(picked) >= most) | F.exists(picked, like), picked).otherwise(F.concat(picked, F.array(x)))

    ranked = F.array_sort(F.transform(F.slice(news.sentences(F.coalesce("article_text", F.lit(""))), 1, first), scored))
    none = F.expr("cast(array() as array<struct<order:double,i:int,s:string,words:array<string>>>)")
    picked = F.aggregate(ranked, none, pick)
    short = lambda s: F.when(F.length(s) <= 300, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, 297)), F.lit("...")))
    points = F.transform(F.array_sort(F.transform(picked, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s")))), lambda x: short(x["s"]))
    fallback = F.when(F.trim("summary") != "", F.array("summary")).otherwise(F.expr("cast(array() as array<string>)")) if "summary" in articles.columns else points
    return articles.withColumn("key_points", points).withColumn("key_points", F.when(F.size("key_points") > 0, F.col("key_points")).otherwise(fallback))


def corroborator_pages(clustered: DataFrame) -> DataFrame:
    """seq of the first corroborator of each story, the one whose page is read besides the primary's."""
    nth = W.partitionBy("cluster_id").orderBy("place")
    return clustered.filter("role = 'corroborator'").withColumn("n", F.row_number().over(nth)).filter("n = 1").select("cluster_id", "seq")
