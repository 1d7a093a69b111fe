"""Feeds: RSS and Atom bodies to items, feeds that do not parse, the source catalogue and report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rentwire.functions import news

_MEDIA = "array<struct<_url:string,_medium:string,_type:string>>"
ITEM = f"title string, link string, guid string, description string, `content:encoded` string, pubDate string, `dc:date` string, source struct<_VALUE:string,_url:string>, `media:content` {_MEDIA}, `media:thumbnail` {_MEDIA}, enclosure {_MEDIA}"
ENTRY = "title string, link array<struct<_href:string,_rel:string>>, summary string, content string, published string, updated string"
RSS, ATOM = (f"{at}array<struct<{', '.join(x.replace(' ', ':', 1) for x in fields.split(', '))}>>" for at, fields in (("channel struct<item:", ITEM), ("entry ", ENTRY)))
RSS += ">"


def _first(*xs: Column) -> Column:
    return F.coalesce(*(F.when(F.trim(x) != "", F.trim(x)) for x in xs), F.lit(""))


def _picture(media: Column) -> Column:
    """The first address that is not of another kind than an image."""
    kind = lambda m: F.lower(F.coalesce(F.when(m["_medium"] != "", m["_medium"]), m["_type"], F.lit("")))
    return F.try_element_at(F.filter(media, lambda m: (m["_url"] != "") & ((kind(m) == "") | kind(m).startswith("image"))), F.lit(1))["_url"]


_OPTIONS = {"attributePrefix": "_", "valueTag": "_VALUE", "ignoreNamespace": "false", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
_OWN = ("origin", "region_implied", "topic_implied")


def _bodies(feeds: DataFrame) -> DataFrame:
    """origin, the implied flags, and what the parser made of each body: rss, atom, and whether it is well-formed."""
    body = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce("body", F.lit("")), "^\ufeff", "")), r"^<\?xml[^>]*\?>", "")
    flags = [F.col(c) if c in feeds.columns else F.lit(False).alias(c) for c in _OWN[1:]]
    read = feeds.select("origin", *flags, body.alias("body"))
    is_atom = F.col("body").rlike("<feed[\\s>]")
    read = read.withColumns({"rss": F.from_xml("body", f"{RSS}, _bad string", _OPTIONS), "atom": F.when(is_atom, F.from_xml("body", f"{ATOM}, _bad string", _OPTIONS))})
    # the parser stops where the root ends, so that what comes behind it is looked at here
    bare = F.regexp_replace("body", r"(?s)<!\[CDATA\[.*?\]\]>|<!--.*?-->|<\?.*?\?>|<!DOCTYPE[^>\[]*(?:\[.*?\])?\s*>", "")
    root = F.regexp_extract(bare, r"^\s*<([^\s<>/!?]+)", 1)
    ends = F.split(bare, F.concat(F.lit(r"</\Q"), root, F.lit(r"\E\s*>")), -1)
    whole = bare.rlike(r"^\s*<[^<>]*/>\s*$") | ((F.size(ends) == 2) & (F.trim(F.regexp_replace(F.element_at(ends, -1), r"\s", "")) == ""))
    well = F.col("rss").isNotNull() & F.col("rss._bad").isNull() & (root != "") & whole
    return read.withColumn("well", F.coalesce(well, F.lit(False))).drop("body")


def _rss_fields(i: Column) -> list[Column]:
    return [
        news.strip_html(i["title"]).alias("title"), _first(i["link"], i["guid"]).alias("link"), _first(i["description"], i["content:encoded"]).alias("summary"),
        news.parse_time(_first(i["pubDate"], i["dc:date"])).alias("published"), _first(i["source"]["_VALUE"]).alias("source_name"), F.coalesce(i["source"]["_url"], F.lit("")).alias("source_url"),
        F.coalesce(_picture(i["media:content"]), _picture(i["enclosure"]), _picture(i["media:thumbnail"]), F.lit("")).alias("image_url"),
    ]


def _atom_fields(i: Column) -> list[Column]:
    alternate = F.try_element_at(F.filter(i["link"], lambda x: (F.coalesce(x["_rel"], F.lit("alternate")) == "alternate") & (x["_href"] != "")), F.lit(1))["_href"]
    any_link = F.try_element_at(F.filter(i["link"], lambda x: x["_href"] != ""), F.lit(1))["_href"]
    return [
        news.strip_html(i["title"]).alias("title"), F.coalesce(alternate, any_link, F.lit("")).alias("link"), _first(i["summary"], i["content"]).alias("summary"),
        news.parse_time(_first(i["published"], i["updated"])).alias("published"), *(F.lit("").alias(c) for c in ("source_name", "source_url", "image_url")),
    ]


def parse(feeds: DataFrame) -> DataFrame:
    """origin, region_implied, topic_implied and the fields of each item of stored feed bodies (origin, body, …).

    A body that is not well-formed, or is neither RSS nor Atom, gives no items; source_results() tells of it.
    """
    read = _bodies(feeds).filter("well")
    rss = read.select(*_OWN, F.explode("rss.channel.item").alias("i")).select(*_OWN, *_rss_fields(F.col("i")))
    return rss.unionByName(read.select(*_OWN, F.explode("atom.entry").alias("i")).select(*_OWN, *_atom_fields(F.col("i"))))


def parse_files(spark: SparkSession, path: str, atom: bool = False) -> DataFrame:
    """``parse`` for feed files of any size: each file is an origin and one task's, which reads it an item a row and never as a whole.

    Items that don't parse, each alone, are left out; ``damaged_files`` tells of them.
    """
    return _items(spark, path, atom).filter("_bad is null").select("origin", *(F.lit(False).alias(c) for c in _OWN[1:]), *(_atom_fields if atom else _rss_fields)(F.struct("*")))


def damaged_files(spark: SparkSession, path: str, atom: bool = False) -> DataFrame:
    """origin, titled (items with a title) and damaged (items that don't parse) of each feed file that has such."""
    counts = _items(spark, path, atom).groupBy("origin").agg(F.count("title").alias("titled"), F.count("_bad").alias("damaged"))
    return counts.filter("damaged > 0")


def _items(spark: SparkSession, path: str, atom: bool) -> DataFrame:
    read = spark.read.format("xml").options(**_OPTIONS, rowTag="entry" if atom else "item").schema(f"{ENTRY if atom else ITEM}, _bad string").load(path)
    return read.withColumn("origin", F.input_file_name())


#: What source_results says of a body that does not parse.
MALFORMED = "not well-formed"


def source_results(feeds: DataFrame) -> DataFrame:
    """origin, ok, items, error: one row a feed body. One that does not parse is one failed source; the rest go on. A well-formed body that is no feed is a source without items."""
    n = lambda x: F.coalesce(F.when(F.size(x) > 0, F.size(x)), F.lit(0))
    items = F.when(F.col("well"), n("rss.channel.item") + n("atom.entry")).otherwise(F.lit(0)).cast("long")
    return _bodies(feeds).select("origin", F.col("well").alias("ok"), items.alias("items"), F.when(F.col("well"), F.lit("")).otherwise(F.lit(MALFORMED)).alias("error"))


def catalogue(spark: SparkSession, searches: list[str], engines: dict[str, str], direct: list[tuple[str, str, bool, bool]]) -> DataFrame:
    """origin, url, region_implied, topic_implied: every search on every engine (a pattern with {q}), and the direct feeds."""
    rows = [(f"{name}: {q}", pattern, q, False, False) for name, pattern in engines.items() for q in searches] + [(name, url, "", region, topic) for name, url, region, topic in direct]
    table = spark.createDataFrame(rows, "origin string, pattern string, q string, region_implied boolean, topic_implied boolean")
    return table.select("origin", F.replace("pattern", F.lit("{q}"), F.url_encode("q")).alias("url"), "region_implied", "topic_implied")


def report_rows(articles: DataFrame, zone: str = "America/Los_Angeles") -> DataFrame:
    """One JSON text a row, with the time in UTC and in ``zone``."""
    rest = [c for c in articles.columns if c != "published"]
    stamp = "yyyy-MM-dd'T'HH:mm:ss"
    times = F.date_format("published", stamp).alias("published_utc"), F.date_format(F.from_utc_timestamp("published", zone), stamp).alias("published_local")
    return articles.select(F.to_json(F.struct(*rest, *times)).alias("json"))
