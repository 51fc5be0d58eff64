"""Curating places and counting memberships."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewright.functions import geo
from placewright.functions import names as N
from placewright.plans.graph import components

from .joins import linked

# Types that a category keeps, and the club rescue of golf courses.
ALLOW = {
    "museum": ["museum", "art_museum", "history_museum", "art_gallery"],
    "library": ["library"],
    "movie_theater": ["movie_theater"],
    "hospital": ["hospital", "general_hospital", "medical_center"],
    "zoo": ["zoo"],
    "aquarium": ["aquarium"],
    "amusement_park": ["amusement_park", "water_park", "amusement_center"],
    "park": ["park", "city_park", "national_park", "state_park", "dog_park", "garden", "botanical_garden", "nature_preserve"],
    "consulate": ["embassy"],
    "mountain": ["mountain_peak"],
    "stadium": ["stadium", "arena"],
}
GOLF_CLUBS = ["sports_club", "association_or_organization", "country_club"]
GOLF_EXCLUDE = ["driving range", "topgolf", "top golf", "mini golf", "miniature golf", "disc golf", "golf galaxy", "indoor golf"]
# End of the fixed values.
MIN_REVIEWS = 5


def keep_by_type(category: Column, primary_type: Column, name: Column, allow: dict[str, list[str]] = ALLOW) -> Column:
    """P4. Whether a place's type fits its category; categories without a list keep all."""
    low = F.lower(F.coalesce(name, F.lit("")))
    out = reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in GOLF_EXCLUDE])
    club = primary_type.isin(GOLF_CLUBS) & (low.contains("golf") | low.contains("country club"))
    golf = ~out & ((primary_type == "golf_course") | club)
    c = F.when(category == "golf_course", golf)
    for k, types in allow.items():
        c = c.when(category == k, primary_type.isin(types))
    return F.coalesce(c.otherwise(F.lit(True)), F.lit(False))


def enough_reviews(reviews: Column, category: Column, status: Column, name: Column, exempt: list[str], closed_names: list[str], least: int = MIN_REVIEWS) -> Column:
    """P5. Reviews, not closed for good, not on the list of closed names."""
    floor = F.when(category.isin(exempt), 0).otherwise(least) if exempt else F.lit(least)
    listed = name.isin(closed_names) if closed_names else F.lit(False)
    return (F.coalesce(reviews, F.lit(0)) >= floor) & (F.coalesce(status, F.lit("")) != "CLOSED_PERMANENTLY") & ~listed


def curate(pois: DataFrame, nested: DataFrame, keep_list: DataFrame | None = None, listed_category: str = "stadium", exempt: list[str] | None = None, closed_names: list[str] | None = None, allow: dict[str, list[str]] = ALLOW) -> tuple[DataFrame, DataFrame]:
    """P4-P7, A9. (kept, funnel). nested: category, name of parts to take out; keep_list: poi_id, label.

    The funnel counts raw, reviewed, off-type, removed and kept rows of each category in one pass.
    """
    good = enough_reviews(F.col("reviews"), F.col("category"), F.col("status"), F.col("name"), exempt or [], closed_names or [])
    df = pois.withColumns({"_good": good, "_typed": keep_by_type(F.col("category"), F.col("primary_type"), F.col("name"), allow)})
    if keep_list is not None:
        labels = keep_list.select("poi_id", F.col("label").alias("_label")).dropDuplicates(["poi_id"])
        df = df.join(labels, "poi_id", "left")
        mine = F.col("category") == listed_category
        df = df.withColumns({"_typed": F.col("_typed") & (~mine | F.col("_label").isNotNull()), "name": F.when(mine, F.coalesce("_label", "name")).otherwise(F.col("name"))}).drop("_label")
    parts = nested.select("category", "name", F.lit(True).alias("_part")).distinct()
    df = df.join(parts, ["category", "name"], "left").withColumn("_part", F.coalesce("_part", F.lit(False)))
    ok, typed, part = F.col("_good"), F.col("_typed"), F.col("_part")
    funnel = df.groupBy("category").agg(
        F.count("*").alias("raw"), F.count_if(ok).alias("reviewed"), F.count_if(ok & ~typed).alias("off_type"),
        F.count_if(ok & typed & part).alias("removed"), F.count_if(ok & typed & ~part).alias("kept"),
    )
    return df.where(ok & typed & ~part).drop("_good", "_typed", "_part"), funnel


def review_flags(kept: DataFrame, named: DataFrame, nested: DataFrame) -> DataFrame:
    """P8. `kept` with flag and reason, nothing dropped. named: category, name; nested: poi_id, nested_in."""
    a = named.select("category", "name", F.lit(True).alias("_named")).distinct()
    df = kept.join(a, ["category", "name"], "left").join(nested, "poi_id", "left")
    reason = F.when(F.col("nested_in").isNotNull(), F.concat(F.lit("nested near "), F.col("nested_in").cast("string"))).when(F.col("_named"), "possible mis-tag")
    return df.withColumns({"reason": reason, "flag": reason.isNotNull()}).drop("_named", "nested_in")


def open_places(pois: DataFrame) -> DataFrame:
    """P10. Only places closed for good go; unknown and temporarily closed ones stay."""
    return pois.where(F.coalesce("status", F.lit("")) != "CLOSED_PERMANENTLY")


def domain(stations: DataFrame, column: str) -> DataFrame:
    """P13. The distinct values of a column, or of an array's items, in order; nulls aside."""
    many = stations.schema[column].dataType.typeName() == "array"
    values = stations.select((F.explode(column) if many else F.col(column)).alias("value"))
    return values.where("value is not null").distinct().orderBy("value")


def text_search(stations: DataFrame, query: str) -> DataFrame:
    """P14. Stations any of whose fields contains the query, letter case aside; lines are searched without brackets."""
    text = N.searchable(F.col("name"), F.col("aka"), F.col("systems"), N.without_brackets(F.col("lines")), F.col("city"), F.col("county"))
    return stations.where(text.contains(query.lower()))


def poi_filter(pois: DataFrame, shown: DataFrame, query: str = "") -> DataFrame:
    """P15. Places of the categories shown (category, label, colour), name containing the query, with label and colour."""
    return pois.join(shown, "category").where(F.lower("name").contains(query.lower()))


def compact(pois: DataFrame) -> DataFrame:
    """P18, T4. n, lat, lon (6 places), t, r (0 if unknown) for each category, ordered by lower-case name."""
    return pois.select("category", F.col("name").alias("n"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.col("primary_type").alias("t"), F.coalesce("reviews", F.lit(0)).alias("r")).orderBy("category", F.lower("n"), "n")


def deck(cards: DataFrame, size: str) -> DataFrame:
    """P24. Cards whose sizes contain the size."""
    return cards.where(F.array_contains("sizes", size))


def suggest_size(stations: Column, square_miles: Column, by_count: tuple[int, int] = (60, 180), by_area: tuple[float, float] = (50.0, 500.0)) -> Column:
    """P25. 'small', 'medium' or 'large': the larger of what the station count and the area suggest."""
    rank = lambda x, cut: F.when(x.isNull(), 0).when(x >= cut[1], 2).when(x >= cut[0], 1).otherwise(0)
    top = F.greatest(rank(stations, by_count), rank(square_miles, by_area))
    return F.get(F.array(F.lit("small"), F.lit("medium"), F.lit("large")), top)


def memberships(stations: DataFrame) -> DataFrame:
    """A1. For each system the stations it serves (shared ones count in each) and those whose primary system it is."""
    s = stations.withColumn("primary", N.primary_system(F.col("systems")))
    each = s.select(F.explode("systems").alias("system"), "primary")
    return each.groupBy("system").agg(F.count("*").alias("members"), F.count_if(F.col("system") == F.col("primary")).alias("primaries"))


def line_tree(stations: DataFrame, key: str = "station_id") -> DataFrame:
    """A2. Distinct stations by (agency, line) and by agency (line null); stations without a line under '—'."""
    each = stations.select(key, F.explode_outer("lines").alias("line"))
    each = each.select(key, F.coalesce("line", F.lit("—")).alias("line"), F.when(F.col("line").isNull(), "—").otherwise(N.agency_of(F.col("line"))).alias("agency"))
    return each.rollup("agency", "line").agg(F.countDistinct(key).alias("stations")).where("agency is not null")


def stops_per_line(stations: DataFrame) -> DataFrame:
    """A3. Stations of each line, agency first, then most stations."""
    each = stations.select(F.explode("lines").alias("line")).groupBy("line").agg(F.count("*").alias("stops"))
    return each.withColumn("agency", N.agency_of(F.col("line"))).orderBy("agency", F.desc("stops"), "line")


def count_check(own: DataFrame, other: DataFrame, tolerance: int = 2) -> DataFrame:
    """A4. line, own and reference counts, and whether they differ by more than the tolerance."""
    j = own.select("line", F.col("stops").alias("own")).join(other.select("line", F.col("stops").alias("reference")), "line", "left")
    return j.withColumn("off", F.coalesce(F.abs(F.col("own") - F.col("reference")) > tolerance, F.lit(True)))


def length_histogram(stations: DataFrame, column: str = "name_length") -> DataFrame:
    """A5. Count of every length from the least to the greatest, zeros filled in."""
    n = stations.groupBy(F.col(column).alias("length")).agg(F.count("*").alias("n"))
    span = n.agg(F.explode(F.sequence(F.min("length"), F.max("length"))).alias("length"))
    return span.join(n, "length", "left").select("length", F.coalesce("n", F.lit(0)).alias("n"))


def elevation_histogram(stations: DataFrame, step_ft: float = 50.0, bins: int = 10) -> DataFrame:
    """A6. Stations by 50-foot bin; what is higher is in the last bin, below sea level in the first."""
    b = F.greatest(F.lit(0), F.least(F.floor(F.col("elevation") * 3.280839895 / step_ft), F.lit(bins - 1)))
    return stations.where("elevation is not null").groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def category_counts(categories: DataFrame, pois: DataFrame, query: str = "") -> DataFrame:
    """A10. Places of every category, zeros too, optionally only those whose name contains the query."""
    n = pois.where(F.lower("name").contains(query.lower())).groupBy("category").agg(F.count("*").alias("n"))
    return categories.select("category").join(n, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def unique_names(stations: DataFrame) -> DataFrame:
    """A15. Names that occur more than once get the first system in order of name in brackets."""
    n = F.count("*").over(Window.partitionBy("name"))
    shown = F.when(n > 1, F.concat(F.col("name"), F.lit(" ("), F.array_min("systems"), F.lit(")"))).otherwise(F.col("name"))
    return stations.withColumn("shown", shown)


def gap_summary(gaps: DataFrame) -> DataFrame:
    """A16. Gaps by source and category, with totals (null = all)."""
    return gaps.rollup("source", "category").agg(F.count("*").alias("n"))


def keep_summary(places: DataFrame) -> DataFrame:
    """A18. Names kept by county and kind, in order."""
    return places.groupBy("county", "kind").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("name")).alias("names"))


def review_order(places: DataFrame, keys: tuple[str, ...] = ("category",)) -> DataFrame:
    """T2. Adds `place`: 1, 2, ... within each category, most reviews first (unknown ones count as 0), by id on a tie."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.coalesce("reviews", F.lit(0))), "poi_id")
    return places.withColumn("place", F.row_number().over(w).cast("long"))


def peak_list(peaks: DataFrame) -> DataFrame:
    """T5. peaks: name, ele_m. The peaks of P23, highest first and by name, with the label of their height in feet."""
    high = peaks.where(N.peak_class(F.col("ele_m"), F.col("name")) == "peak")
    return high.withColumn("label", geo.format_elevation(F.col("ele_m").try_cast("double"))).orderBy(F.desc(F.col("ele_m").try_cast("double")), "name")


def starred_first(stations: DataFrame, stars: DataFrame, collation: str = "UNICODE") -> DataFrame:
    """T1. Starred stations first, then by name as people sort names: by letter before accent and case. `collation` is any that
    Spark knows; UTF8_BINARY gives the order of bytes. Null names come first, equal ones by id."""
    s = stars.select("station_id", F.lit(True).alias("starred")).distinct()
    return stations.join(s, "station_id", "left").withColumn("starred", F.coalesce("starred", F.lit(False))).orderBy(F.desc("starred"), F.collate("name", collation), "station_id")


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """W4. The first row of each key in the order given."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def dense_ids(rows: DataFrame, order: list[str], prefix: str = "s", width: int = 3) -> DataFrame:
    """W6, T3. Ids s000, s001, ... in the order given. One global order: for small master tables."""
    n = F.row_number().over(Window.orderBy(*order)) - 1
    return rows.withColumn("id", F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0")))


def cluster_stops(stops: DataFrame, meters: float = 150.0, rename: dict[str, str] | None = None) -> DataFrame:
    """E1, E2, A7. stops: stop_id, name, lat, lon, line -> cluster, name, lat, lon, names, lines, members, wide.

    Stops with one name, and stops under `meters` apart, are one station: connected components, whatever the order of
    arrival. `wide` marks clusters that span more than twice the radius. The shown name is a renamed one if there is one,
    else the shortest without '&', the alphabetically first on a tie.
    """
    same = stops.groupBy("name").agg(F.min("stop_id").alias("least")).join(stops.hint("merge"), "name").select(F.col("stop_id").alias("a"), F.col("least").alias("b"))
    roots = components(linked(stops, "stop_id", meters, strict=True, known=same)).withColumnsRenamed({"id": "stop_id", "root": "cluster"})
    plain = F.struct(F.col("name").contains("&").alias("amp"), F.length("name").alias("len"), "name")
    new = F.lit(None).cast("string")
    if rename:
        new = F.create_map(*[F.lit(x) for kv in rename.items() for x in kv])[F.col("name")]
    g = stops.join(roots.hint("merge"), "stop_id").withColumn("_new", new).groupBy("cluster").agg(
        F.coalesce(F.min("_new"), F.min(plain)["name"]).alias("name"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"),
        F.array_sort(F.collect_set("name")).alias("names"), F.array_sort(F.collect_set("line")).alias("lines"), F.count("*").alias("members"),
        (F.max("lat") - F.min("lat")).alias("_h"), (F.max("lon") - F.min("lon")).alias("_w"),
    )
    span = F.sqrt(F.pow(F.col("_h") * 110540.0, 2.0) + F.pow(F.col("_w") * 111320.0 * F.cos(F.radians("lat")), 2.0))
    return g.withColumn("wide", span > 2 * meters).drop("_h", "_w")


def merge_at_anchors(stations: DataFrame, labels: DataFrame) -> DataFrame:
    """E3, A8. stations: id, ord, name, lat, lon, systems, lines, served; labels: id, label.

    At each anchor the first station in order of every (anchor, first system) is merged: mean place, union of systems and
    lines, service if any has it. Later stations of the same system, and those without an anchor, stay as they are.
    """
    df = stations.join(labels.hint("merge"), "id", "left")
    w = Window.partitionBy("label", F.col("systems")[0]).orderBy("ord", "id")
    df = df.withColumn("_first", F.col("label").isNotNull() & (F.row_number().over(w) == 1))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    merged = df.where("_first").groupBy("label").agg(F.min("id").alias("id"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), union("systems"), union("lines"), F.bool_or("served").alias("served"))
    merged = merged.withColumnRenamed("label", "name")
    return merged.unionByName(df.where("not _first").select(*merged.columns))
