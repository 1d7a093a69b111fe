"""Places: address groups, geocoder responses, best hits, sites, footprints and clicks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rentwire.functions import cells

from . import cover, shapes, term_index

#: Grades, worst first.
GRADES = ("approximate", "interpolated", "parcel", "rooftop")
MOST_CACHED = 25_000
#: Largest footprint part in square metres, cell of the footprint join in degrees, reach of a click in metres.
LARGEST, REACH = 40_000.0, 90.0
#: Quadtree cells that a part's outline is covered by, about.
FOOTPRINT_CELLS = 16


def grade_rank(x: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, GRADES)), x) - 1, F.lit(0)).cast("int")


def location_groups(deals: DataFrame) -> DataFrame:
    """address_key, query (of the first deal), deals, has_coords. Deals without a key are left out."""
    query = cells.geocode_query(F.col("address"), F.col("city"), F.col("state"), F.col("zip"), F.col("property_name"))
    return deals.filter("address_key <> ''").groupBy("address_key").agg(F.min_by(query, "source_row").alias("query"), F.count("*").alias("deals"), F.bool_or(F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias("has_coords"))


def parse_responses(responses: DataFrame, chain: tuple[str, ...] = ("google", "census", "photon", "nominatim")) -> DataFrame:
    """address_key, provider, position, lat, lon, grade, place_id of stored bodies (address_key, provider, body); (0, 0) and bad coordinates are no hit."""
    b = F.col("body")
    google = F.from_json(b, "status string, results array<struct<geometry:struct<location:struct<lat:double,lng:double>,location_type:string>,place_id:string,partial_match:boolean>>")
    census = F.from_json(b, "result struct<addressMatches:array<struct<coordinates:struct<x:double,y:double>>>>")
    photon = F.from_json(b, "features array<struct<geometry:struct<coordinates:array<double>>,properties:struct<type:string,osm_key:string,osm_value:string>>>")
    nominatim = F.from_json(b, "array<struct<lat:string,lon:string,class:string,type:string>>")
    g, c, p, n = F.try_element_at(google["results"], F.lit(1)), F.try_element_at(census["result"]["addressMatches"], F.lit(1)), F.try_element_at(photon["features"], F.lit(1)), F.try_element_at(nominatim, F.lit(1))
    kind = g["geometry"]["location_type"]
    google_grade = F.when(g["partial_match"], F.lit("approximate")).when(kind == "ROOFTOP", F.lit("rooftop")).when(kind == "RANGE_INTERPOLATED", F.lit("interpolated")).when(kind == "GEOMETRIC_CENTER", F.lit("parcel")).otherwise(F.lit("approximate"))

    def tag_grade(key: Column, value: Column) -> Column:
        return F.when((key == "building") | value.isin("building", "house"), F.lit("rooftop")).when(key.isin("amenity", "office", "shop", "tourism"), F.lit("parcel")).when((key == "highway") | (value == "street"), F.lit("interpolated")).otherwise(F.lit("approximate"))

    def hit(lat: Column, lon: Column, grade: Column, place: Column) -> Column:
        return F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"), grade.alias("grade"), place.alias("place_id"))

    none = F.lit("")
    hits = {
        "google": hit(g["geometry"]["location"]["lat"], g["geometry"]["location"]["lng"], google_grade, F.coalesce(g["place_id"], none)),
        "census": hit(c["coordinates"]["y"], c["coordinates"]["x"], F.lit("interpolated"), none),
        "photon": hit(F.try_element_at(p["geometry"]["coordinates"], F.lit(2)), F.try_element_at(p["geometry"]["coordinates"], F.lit(1)), tag_grade(p["properties"]["osm_key"], F.coalesce(p["properties"]["type"], p["properties"]["osm_value"])), none),
        "nominatim": hit(n["lat"].try_cast("double"), n["lon"].try_cast("double"), tag_grade(n["class"], n["type"]), none),
    }
    chosen = None
    for name in chain:
        own = F.col("provider") == name
        chosen = F.when(own, hits[name]) if chosen is None else chosen.when(own, hits[name])
    position = F.array_position(F.array(*map(F.lit, chain)), F.col("provider")).cast("int")
    read = responses.select("address_key", "provider", position.alias("position"), chosen.alias("hit")).select("address_key", "provider", "position", "hit.*")
    return read.filter(F.abs("lat").between(0, 90) & F.abs("lon").between(0, 180) & ~((F.col("lat") == 0) & (F.col("lon") == 0)) & (F.col("position") > 0))


def best_hits(hits: DataFrame) -> DataFrame:
    """One hit an address: the first of parcel grade or better in chain order, else the earliest of the best grade."""
    order = W.partitionBy("address_key").orderBy(F.desc(F.least(grade_rank(F.col("grade")), F.lit(2))), "position")
    return hits.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def merge_hits(deals: DataFrame, hits: DataFrame, looked_up: DataFrame | None = None, protect_file: bool = False) -> DataFrame:
    """Deals with their address's hit, or an error where it was looked up without one. Blank keys join nothing.

    looked_up: addresses that were asked for; by default those of location groups that lack a coordinate.
    protect_file: leave coordinates that came from the file.
    """
    if looked_up is None:
        looked_up = deals.filter("address_key <> '' and (lat is null or lon is null)").select("address_key").distinct()
    found = looked_up.select("address_key").distinct().join(hits.select("address_key", F.col("lat").alias("h_lat"), F.col("lon").alias("h_lon"), F.col("grade").alias("h_grade"), F.col("place_id").alias("h_place")), "address_key", "left")
    key = F.when(F.col("address_key") != "", F.col("address_key"))
    joined = deals.withColumn("_k", key).join(found.withColumnRenamed("address_key", "_h").withColumn("asked", F.lit(True)), F.col("_k") == F.col("_h"), "left")
    take = F.col("h_lat").isNotNull() & (F.lit(not protect_file) | F.col("lat").isNull() | (F.col("geo_source") != "file"))
    failed = F.coalesce(F.col("asked") & F.col("h_lat").isNull(), F.lit(False))
    out = joined.withColumns({
        "lat": F.when(take, F.col("h_lat")).otherwise(F.col("lat")), "lon": F.when(take, F.col("h_lon")).otherwise(F.col("lon")),
        "geo_precision": F.when(take, F.col("h_grade")).otherwise(F.col("geo_precision")), "place_id": F.when(take, F.col("h_place")).otherwise(F.col("place_id")),
        "geo_source": F.when(take, F.lit("geocoded")).otherwise(F.col("geo_source")), "geo_error": F.when(failed, F.lit("no match")).otherwise(F.col("geo_error")),
    })
    return out.select(*deals.columns)


def seed_from_cache(deals: DataFrame, cache: DataFrame) -> DataFrame:
    """Deals that lack coordinates take them from the cache, an address's last entry; an entry without a grade is approximate."""
    seen = last_entries(cache.filter("address_key <> ''")).select(F.col("address_key").alias("_c"), F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"), F.coalesce("grade", F.lit("approximate")).alias("c_grade"))
    lacks = F.col("lat").isNull() | F.col("lon").isNull()
    joined = deals.withColumn("_k", F.when(lacks & (F.col("address_key") != ""), F.col("address_key"))).join(seen, F.col("_k") == F.col("_c"), "left")
    hit = F.col("c_lat").isNotNull()
    return joined.withColumns({"lat": F.when(hit, F.col("c_lat")).otherwise(F.col("lat")), "lon": F.when(hit, F.col("c_lon")).otherwise(F.col("lon")), "geo_precision": F.when(hit, F.col("c_grade")).otherwise(F.col("geo_precision"))}).select(*deals.columns)


def retain_cache(cache: DataFrame, most: int = MOST_CACHED) -> DataFrame:
    """The last entry of each address, the newest ``most`` of them. Of entries of one time the greatest by its columns stays, so that every run keeps the same."""
    return last_entries(cache).orderBy(F.desc("ts"), "address_key").limit(most)


def last_entries(cache: DataFrame) -> DataFrame:
    """One row an address, that of the last ts (then the greatest by its columns), with map-side reduction."""
    others = [c for c in cache.columns if c not in ("address_key", "ts")]
    order = F.struct(*(["ts"] if "ts" in cache.columns else []), *others)
    kept = cache.groupBy("address_key").agg(F.max(order).alias("_last"))
    return kept.select(*(F.col("address_key") if c == "address_key" else F.col(f"_last.`{c}`").alias(c) for c in cache.columns))


def sites(deals: DataFrame, with_rows: bool = True) -> DataFrame:
    """site_id, lat, lon, label, city, grade, deals, deal_rows: deals of one coordinate (five decimals).

    label: the first property name, else address, else city. deal_rows: source rows newest first, undated last of 1970.
    with_rows=False leaves deal_rows out: counts alone, which stay small however many deals a site has.
    """
    placed = deals.filter("lat is not null and lon is not null")

    def first(column: str) -> Column:
        return F.min_by(F.when(F.trim(column) != "", F.trim(F.col(column))), F.when(F.trim(column) != "", F.col("source_row")))

    have = [c for c in ("property_name", "address", "city") if c in deals.columns]
    grade = F.max(grade_rank(F.col("geo_precision"))) if "geo_precision" in deals.columns else F.lit(0)
    since = F.coalesce(F.datediff("lease_date", F.lit("1970-01-01").cast("date")), F.lit(0))
    rows = F.transform(F.array_sort(F.collect_list(F.struct((-since).alias("s"), F.col("source_row").alias("r")))), lambda x: x["r"])
    key = F.format_string("s:%.5f,%.5f", "lat", "lon")
    out = placed.groupBy(key.alias("site_id")).agg(
        F.min_by("lat", "source_row").alias("lat"), F.min_by("lon", "source_row").alias("lon"), F.coalesce(*(first(c) for c in have), F.lit("Unnamed location")).alias("label"),
        F.coalesce(first("city"), F.lit("")).alias("city"), grade.alias("g"), F.count("*").alias("deals"), *([rows.alias("deal_rows")] if with_rows else []),
    )
    return out.withColumn("grade", F.element_at(F.array(*map(F.lit, GRADES)), F.col("g") + 1)).drop("g")


def grade_counts(deals: DataFrame) -> DataFrame:
    """One row: deals of building grade and without a location."""
    return deals.agg(F.count_if(grade_rank(F.col("geo_precision")) >= 2).alias("building_grade"), F.count_if(F.col("lat").isNull() | F.col("lon").isNull()).alias("unlocated"))


# Footprints: parts are arrays of rings (outer first, then holes), rings arrays of (lng, lat).
def part_contains(part: Column, lat: Column, lng: Column) -> Column:
    return shapes.ring_contains(F.element_at(part, 1), lat, lng, "lat", "lng") & ~in_holes(part, lat, lng)


def in_holes(part: Column, lat: Column, lng: Column) -> Column:
    return F.exists(F.slice(part, F.lit(2), F.size(part)), lambda h: shapes.ring_contains(h, lat, lng, "lat", "lng"))


def part_area(part: Column) -> Column:
    rings = F.transform(part, lambda r: shapes.ring_area(r, "lat", "lng"))
    return F.greatest(F.lit(0.0), F.element_at(rings, 1) - F.aggregate(F.slice(rings, F.lit(2), F.size(rings)), F.lit(0.0), lambda a, x: a + x))


def part_key(part: Column) -> Column:
    v = F.element_at(F.element_at(part, 1), 1)
    return F.format_string("%.6f,%.6f", v["lng"], v["lat"])


def footprint_parts(footprints: DataFrame) -> DataFrame:
    """footprint_id, part_no, part, area, key."""
    out = footprints.select("footprint_id", F.posexplode("parts").alias("part_no", "part")).filter(F.size("part") > 0)
    return out.withColumn("area", part_area(F.col("part"))).withColumn("key", part_key(F.col("part")))


def sites_in_parts(site: DataFrame, parts: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """The columns of ``site`` (lat, lon) and of ``parts`` (those of footprint_parts): a row for each part and site inside it.

    Each outline is covered by cells of a quadtree that are as small as the outline asks for, and sites meet cells by key. So a
    crowded block is many keys: however many sites stand in it, a key holds those of one cell, a fraction of a building.
    """
    told = parts.withColumn("shape_id", F.concat_ws("#", "footprint_id", "part_no", F.md5(F.to_json(F.struct("part"))))).dropDuplicates(["shape_id"])
    ring = F.transform(F.element_at("part", 1), lambda v: F.struct(v["lat"].alias("lat"), v["lng"].alias("lon")))
    drawn = told.select("shape_id", F.lit("polygon").alias("kind"), ring.alias("ring"), F.lit(0.0).alias("radius"))
    around = cover.inside(site, drawn, FOOTPRINT_CELLS, scratch).join(told, "shape_id").drop("shape_id")
    return around.filter(~in_holes(F.col("part"), F.col("lat"), F.col("lon")))


def match_footprints(site: DataFrame, footprints: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """site_id, footprint_id, key, area: the smallest part around each rooftop site, one site a footprint (the one with most deals).

    Parts over LARGEST are dropped before they are covered by cells. scratch: gets the path of the table of cells.
    """
    parts = footprint_parts(footprints).filter((F.col("area") > 0) & (F.col("area") <= LARGEST))
    inside = sites_in_parts(site.filter("grade = 'rooftop'").select("site_id", "lat", "lon", "deals", "label"), parts, scratch)
    smallest = W.partitionBy("site_id").orderBy("area", "footprint_id", "part_no")
    picked = inside.withColumn("_r", F.row_number().over(smallest)).filter("_r = 1")
    one = W.partitionBy("key").orderBy(F.desc("deals"), "label", "site_id")
    return picked.withColumn("_r", F.row_number().over(one)).filter("_r = 1").select("site_id", "footprint_id", "key", "area")


def inflate_ring(ring: Column, metres: float) -> Column:
    """A ring moved outwards from its middle (inwards for negative metres), corner by corner."""
    n = F.size(ring)
    y0 = F.aggregate(ring, F.lit(0.0), lambda a, v: a + v["lat"]) / n
    x0 = F.aggregate(ring, F.lit(0.0), lambda a, v: a + v["lng"]) / n

    def moved(v: Column) -> Column:
        per = 111_320.0
        dy, dx = (v["lat"] - y0) * per, (v["lng"] - x0) * per * F.cos(F.radians(y0))
        far = F.sqrt(dy * dy + dx * dx)
        k = F.when(far > 0, 1 + metres / far).otherwise(F.lit(1.0))
        return F.struct((x0 + (v["lng"] - x0) * k).alias("lng"), (y0 + (v["lat"] - y0) * k).alias("lat"))

    return F.transform(ring, moved)


def inflate_part(part: Column, metres: float) -> Column:
    """The outline grows, holes shrink."""
    return F.concat(F.array(inflate_ring(F.element_at(part, 1), metres)), F.transform(F.slice(part, F.lit(2), F.size(part)), lambda h: inflate_ring(h, -metres)))


def nearest_sites(clicks: DataFrame, site: DataFrame, reach: float = REACH) -> DataFrame:
    """click_id, site_id, metres: the site of the same place id, else the nearest within ``reach``.

    Cells are at least ``reach`` wide in both directions (longitude by the latitude's row), so the nine around a click hold every site in reach.
    """
    step = reach / 110_000.0
    wide = lambda cy: step / F.greatest(F.lit(0.01), F.cos(F.radians((F.abs(cy) + 2) * step)))
    near = clicks.withColumn("cy", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor(F.col("lat") / step) + d)))
    near = near.withColumn("cx", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor(F.col("lon") / wide(F.col("cy"))) + d)))
    at = site.select("site_id", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), F.floor(F.col("lat") / step).alias("cy")).withColumn("cx", F.floor(F.col("s_lon") / wide(F.col("cy"))))
    metres = shapes.haversine(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon"))
    by_distance = near.join(at, ["cy", "cx"]).withColumn("metres", metres).filter(F.col("metres") <= reach).groupBy("click_id").agg(F.min(F.struct("metres", "site_id")).alias("near"))
    named = None
    if "place_id" in site.columns and "place_id" in clicks.columns:
        named = clicks.filter("place_id <> ''").join(site.select("place_id", F.col("site_id").alias("own")), "place_id").groupBy("click_id").agg(F.min("own").alias("own"))
    out = clicks.select("click_id").join(by_distance, "click_id", "left")
    if named is not None:
        out = out.join(named, "click_id", "left")
        return out.select("click_id", F.coalesce("own", "near.site_id").alias("site_id"), F.when(F.col("own").isNull(), F.col("near.metres")).alias("metres")).filter("site_id is not null")
    return out.filter("near is not null").select("click_id", F.col("near.site_id").alias("site_id"), F.col("near.metres").alias("metres"))


def clicks_in_footprints(clicks: DataFrame, site: DataFrame, footprints: DataFrame, stamped: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """click_id, site_id: of the sites inside the clicked footprint (click: footprint_id), the nearest; none inside, the site stamped by match_footprints."""
    parts = footprint_parts(footprints).filter(F.col("area") <= LARGEST)
    inside = sites_in_parts(site.select("site_id", "lat", "lon"), parts, scratch).select("footprint_id", "site_id", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon")).distinct()
    near = clicks.join(inside, "footprint_id").groupBy("click_id").agg(F.min(F.struct(shapes.haversine(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon")).alias("metres"), F.col("site_id"))).alias("near"))
    stamp = stamped.groupBy("footprint_id").agg(F.min("site_id").alias("stamp"))
    return clicks.join(near, "click_id", "left").join(stamp, "footprint_id", "left").select("click_id", F.coalesce("near.site_id", "stamp").alias("site_id")).filter("site_id is not null")


def search_sites(site: DataFrame, query: str, most: int = 12) -> DataFrame:
    """Sites that hold every term; labels that begin with the query first, then by deals, then by label."""
    terms = query.lower().split()
    corpus = F.lower(F.concat_ws(" ", "label", "city"))
    found = F.lit(bool(terms))
    for t in terms:
        found = found & corpus.contains(t)
    begins = F.coalesce(F.lower("label").startswith(query.strip().lower()), F.lit(False))
    return site.filter(found).orderBy(F.desc(begins), F.desc("deals"), F.lower("label"), "site_id").limit(most)


def site_index(site: DataFrame, scratch: list[str] | None = None) -> term_index.Index:
    """Sites ranked by deals and label, and the lists of their labels and cities, for ``search_index``."""
    return term_index.build(site, ("label", "city"), (F.desc("deals"), F.lower("label"), F.col("site_id")), scratch)


def search_index(index: term_index.Index, query: str, most: int = 12) -> DataFrame:
    """As ``search_sites``, from posting lists: of the sites only those found are read."""
    return term_index.top(index, query, most).drop("rank")


def boundaries(segments: DataFrame, kind: str) -> DataFrame:
    """Segments of a county or city boundary, none at sea."""
    level = F.coalesce("admin_level", F.lit(0))
    own = ((level > 0) & (level <= 6)) if kind == "county" else level == 8
    return segments.filter(own & (F.coalesce("maritime", F.lit(0)) != 1))
