"""Readers of landed feeds and writers of results (S1-S15). All take paths that Spark's readers take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placewright.operators.regions import points_in_regions

_POINTS = "array<struct<lat: double, lon: double>>"
#: One permissive schema for nodes, ways and relations.
ELEMENT = f"type string, id long, lat double, lon double, tags map<string,string>, geometry {_POINTS}, members array<struct<type: string, ref: long, role: string, geometry: {_POINTS}>>"
PLACE = "id string, displayName string, name string, primaryType string, types array<string>, address string, rating double, userRatingCount int, businessStatus string, lat double, lon double, source string"


def gtfs_stations(spark: SparkSession, path: str) -> DataFrame:
    """S1. stops.txt: name, lat, lon of the rows with location_type 1."""
    df = spark.read.csv(path, header=True)
    return df.where("location_type = '1'").select(F.col("stop_name").alias("name"), F.col("stop_lat").try_cast("double").alias("lat"), F.col("stop_lon").try_cast("double").alias("lon"))


def service_file(spark: SparkSession, path: str) -> DataFrame:
    """S2. A JSON array of stations with what runs there."""
    schema = "name string, lat double, lon double, wd_served boolean, we_served boolean, wd_gap double, we_gap double, wd_hourly boolean, we_hourly boolean"
    return spark.read.schema(schema).json(path, multiLine=True)


def osm_elements(spark: SparkSession, path: str) -> DataFrame:
    """S3. One row for each element of a dump {"elements": [...]}."""
    return spark.read.schema(f"elements array<struct<{_as_fields(ELEMENT)}>>").json(path, multiLine=True).select(F.inline("elements"))


def _as_fields(schema: str) -> str:
    """Column list -> struct field list."""
    depth, out, part = 0, [], ""
    for ch in schema + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, kind = part.strip().split(" ", 1)
            out.append(f"{name}: {kind}")
            part = ""
        else:
            part += ch
    return ", ".join(out)


def route_stops(elements: DataFrame, roles: str = "stop|platform") -> DataFrame:
    """S3, P22. relation_id, tags, seq, stop_name, lat, lon for node members with such a role and a named node."""
    nodes = elements.where("type = 'node'").select(F.col("id").alias("ref"), F.col("tags")["name"].alias("stop_name"), "lat", "lon").where("stop_name is not null")
    rel = elements.where("type = 'relation'").select(F.col("id").alias("relation_id"), "tags", F.posexplode("members").alias("seq", "m"))
    rel = rel.where((F.col("m.type") == "node") & F.col("m.role").rlike(roles)).select("relation_id", "tags", "seq", F.col("m.ref").alias("ref"))
    return rel.join(nodes, "ref").select("relation_id", "tags", "seq", "stop_name", "lat", "lon")


def fixed_stops(stops: DataFrame, rules: DataFrame) -> DataFrame:
    """P22. rules: ref (null: any), name (lower case), new_name, dropped. Renames and drops stops by name and route."""
    r = rules.select(F.col("ref").alias("_ref"), F.col("name").alias("_name"), "new_name", "dropped")
    on = (F.lower(F.trim("stop_name")) == F.col("_name")) & (F.col("_ref").isNull() | (F.col("_ref") == F.col("ref")))
    j = stops.join(r, on, "left").where(~F.coalesce("dropped", F.lit(False)))
    return j.withColumn("stop_name", F.coalesce("new_name", "stop_name")).drop("_ref", "_name", "new_name", "dropped")


def geojson_regions(spark: SparkSession, path: str, id_property: str = "name") -> DataFrame:
    """S4. A Feature or FeatureCollection of (Multi)Polygons: region_id, rings array<array<struct<lon, lat>>>."""
    raw = spark.read.text(path, wholetext=True)
    geometry = "type string, coordinates string"
    feature = f"struct<type: string, properties: map<string,string>, geometry: struct<{_as_fields(geometry)}>>"
    both = F.from_json("value", f"struct<type: string, features: array<{feature}>, properties: map<string,string>, geometry: struct<{_as_fields(geometry)}>>")
    one = F.struct(F.lit("Feature").alias("type"), both["properties"].alias("properties"), both["geometry"].alias("geometry"))
    feats = raw.select(F.explode(F.when(both["features"].isNotNull(), both["features"]).otherwise(F.array(one))).alias("f"))
    poly = F.from_json(F.col("f.geometry.coordinates"), "array<array<array<double>>>")
    multi = F.flatten(F.from_json(F.col("f.geometry.coordinates"), "array<array<array<array<double>>>>"))
    rings = F.when(F.col("f.geometry.type") == "Polygon", poly).when(F.col("f.geometry.type") == "MultiPolygon", multi)
    pts = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))))
    return feats.select(F.col("f.properties")[id_property].alias("region_id"), pts.alias("rings")).where("rings is not null")


def nested_pois(spark: SparkSession, path: str) -> DataFrame:
    """S5. {"category": {"tentacleRadiusMi", "count", "places": [...]}} -> category, tentacle_miles and the place's fields."""
    kind = f"map<string, struct<tentacleRadiusMi: double, count: int, places: array<struct<{_as_fields(PLACE)}>>>>"
    blocks = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("category", "b"))
    return blocks.select("category", F.col("b.tentacleRadiusMi").alias("tentacle_miles"), F.explode("b.places").alias("p")).select("category", "tentacle_miles", "p.*")


def gazetteer(spark: SparkSession, path: str, box: tuple[float, float, float, float], feature_class: str = "T", codes: tuple[str, ...] = ("PK", "MT"), regions: DataFrame | None = None) -> DataFrame:
    """S6. Tab-separated gazetteer rows of a class and codes inside (south, west, north, east) and, if given, inside a region:
    name, lat, lon."""
    df = spark.read.csv(path, sep="\t", quote="")
    at = lambda i, t: F.col(f"_c{i}").try_cast(t)
    ok = (F.col("_c6") == feature_class) & F.col("_c7").isin(*codes) & at(4, "double").between(box[0], box[2]) & at(5, "double").between(box[1], box[3])
    rows = df.where(ok).select(F.col("_c0").alias("id"), F.col("_c1").alias("name"), at(4, "double").alias("lat"), at(5, "double").alias("lon"))
    if regions is not None:
        rows = rows.join(points_in_regions(rows, regions).select("id").distinct(), "id", "left_semi")
    return rows.select("name", "lat", "lon")


def csv_candidates(spark: SparkSession, path: str, centre: tuple[float, float]) -> DataFrame:
    """S7. A folder of lists name, address, city[, lat, lon]: coordinates default to the region's centre, then the row is
    coarse and looked up by `query`."""
    schema = "name string, address string, city string, lat string, lon string"
    df = spark.read.schema(schema).csv(path, header=True, enforceSchema=True)
    lat, lon = F.col("lat").try_cast("double"), F.col("lon").try_cast("double")
    query = F.concat_ws(", ", F.nullif("name", F.lit("")), F.nullif("address", F.lit("")), F.nullif("city", F.lit("")))
    return df.select("name", query.alias("query"), F.coalesce(lat, F.lit(centre[0])).alias("lat"), F.coalesce(lon, F.lit(centre[1])).alias("lon"), (lat.isNull() | lon.isNull()).alias("coarse"))


def registry(spark: SparkSession, path: str, state: str, counties: list[str]) -> DataFrame:
    """S8. Landed pages {"results": [...]} of a registry: rows of a state and counties, names in title case."""
    kind = "array<struct<facility_name: string, address: string, citytown: string, state: string, countyparish: string>>"
    df = spark.read.schema(f"results {kind}").json(path, multiLine=True).select(F.inline("results"))
    df = df.where((F.col("state") == state) & F.upper("countyparish").isin([c.upper() for c in counties]))
    return df.select(F.initcap("facility_name").alias("name"), F.initcap("address").alias("address"), F.initcap("citytown").alias("city"))


def text_lines(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """S9. key, no, line: the text lines of HTML pages, tags as line ends, blank lines left out."""
    t = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), "<[^>]*>", "\n")
    each = pages.select(key, F.posexplode(F.split(t, "\n")).alias("_no", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    return each.withColumn("no", F.row_number().over(Window.partitionBy(key).orderBy("_no"))).drop("_no")


def three_line_pattern(lines: DataFrame, key: str, word: str = "Accredited") -> DataFrame:
    """S9. name, city where a line ends in a comma, the next is a city and the one after has the word; first
    occurrence of a name only."""
    w = Window.partitionBy(key).orderBy("no")
    df = lines.withColumns({"b": F.lead("line", 1).over(w), "c": F.lead("line", 2).over(w)})
    df = df.where(F.col("line").endswith(",") & F.col("c").contains(word)).select(key, "no", F.regexp_replace("line", r",\s*$", "").alias("name"), F.col("b").alias("city"))
    return df.groupBy("name").agg(F.min_by("city", F.struct(key, "no")).alias("city"))


def sectioned(lines: DataFrame, key: str, heading: Column, subheading: Column, wanted: Column) -> DataFrame:
    """S10, W8. Carries headings and subheadings down; returns the other lines under a wanted subheading (`section`).

    heading, subheading: Boolean Columns over `line`; wanted: a Boolean Column over `section`. A heading ends a section.
    """
    w = Window.partitionBy(key).orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    df = lines.withColumns({"_h": heading, "_s": subheading & ~heading})
    df = df.withColumn("country", F.last(F.when(F.col("_h"), F.col("line")), True).over(w))
    df = df.withColumn("section", F.last(F.when(F.col("_h"), F.lit("")).when(F.col("_s"), F.col("line")), True).over(w))
    return df.where(~F.col("_h") & ~F.col("_s") & F.coalesce(wanted, F.lit(False))).select(key, "no", "country", "section", "line")


def feature_attributes(spark: SparkSession, path: str, kinds: list[str]) -> DataFrame:
    """S11. {"features": [{"attributes": {...}}]}: rows of the TYPEs wanted, trimmed, in title case, '' for null."""
    kind = "array<struct<attributes: struct<TYPE: string, NAME: string, ADDRESS: string, CITY: string>>>"
    df = spark.read.schema(f"features {kind}").json(path, multiLine=True).select(F.inline("features")).select("attributes.*")
    clean = lambda c: F.coalesce(F.initcap(F.trim(c)), F.lit(""))
    return df.where(F.col("TYPE").isin(kinds)).select(clean("NAME").alias("name"), clean("ADDRESS").alias("address"), clean("CITY").alias("city"))


def closed_rings(elements: DataFrame) -> DataFrame:
    """S12. fid, name, rings of ways and relations: rings of four points or more whose ends meet; outer members only."""
    ring = lambda g: F.transform(g, lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    way = F.when(F.col("type") == "way", F.array(F.struct(F.lit("outer").alias("role"), F.col("geometry").alias("geometry"))))
    mem = F.transform("members", lambda m: F.struct(m["role"].alias("role"), m["geometry"].alias("geometry")))
    parts = F.coalesce(way, F.filter(mem, lambda m: m["role"] == "outer"))
    rings = F.filter(F.transform(parts, lambda m: ring(m["geometry"])), lambda g: (F.size(g) >= 4) & (F.element_at(g, 1) == F.element_at(g, -1)))
    df = elements.where("type in ('way', 'relation')").select(F.concat_ws("/", "type", F.col("id").cast("string")).alias("fid"), F.col("tags")["name"].alias("name"), rings.alias("rings"))
    return df.where(F.size("rings") > 0)


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """S13. Parquet, partitioned by e.g. the category."""
    df.write.mode("overwrite").parquet(path, partitionBy=by)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """S14."""
    df.write.mode("overwrite").csv(path, header=True)


def review_payload(kept: DataFrame, kids: DataFrame) -> DataFrame:
    """S15. category, payload: JSON {"groups": [{rep, kids}], "singles": [...]} of each category. kids: rep, kids."""
    j = kept.select("category", "pin", "name").join(kids.withColumnRenamed("rep", "pin"), "pin", "left")
    group = F.when(F.col("kids").isNotNull(), F.struct(F.col("pin").alias("rep"), "name", "kids"))
    single = F.when(F.col("kids").isNull(), F.struct("pin", "name"))
    g = j.groupBy("category").agg(F.sort_array(F.collect_list(group)).alias("groups"), F.sort_array(F.collect_list(single)).alias("singles"))
    return g.select("category", F.to_json(F.struct("groups", "singles")).alias("payload"))
