"""Queries on readers: files in the formats of the feeds are written from the given tables, then read."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.plans.tables import shared_dir
from placewright.sources import fixtures as X
from placewright.sources import readers as S
from placewright.sources.fixtures import SQL_EDGES, SQL_POIS, SQL_STATIONS

from .shapes import _IN

c = F.col
#: Records in one landed file.
FILE_ROWS = 500


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _landed(rows: DataFrame, key: str, value: Column, name: str) -> str:
    """A folder of documents, one for each FILE_ROWS keys: `value` is a Column of text over their groups."""
    path = _path(rows.sparkSession, name)
    docs = rows.groupBy(F.floor(c(key) / FILE_ROWS).alias("file")).agg(value.alias("value"))
    docs.write.partitionBy("file").text(path)
    return path


def _listed(*fields: Column, name: str) -> Column:
    return F.to_json(F.struct(F.collect_list(F.struct(*fields)).alias(name)))


def gtfs_stations(spark: SparkSession, sf: str) -> DataFrame:
    """Stops.txt with stations and platforms."""
    s = X.stations(spark, sf)
    path = _path(spark, "stops")
    s.select("station_id", c("name").alias("stop_name"), c("lat").alias("stop_lat"), c("lon").alias("stop_lon"), (c("station_id") % 3).alias("location_type")).write.csv(path, header=True)
    return S.gtfs_stations(spark, path)


def service_file(spark: SparkSession, sf: str) -> DataFrame:
    """Stations with what runs there on either day."""
    s = X.stations(spark, sf)
    row = F.struct("name", "lat", "lon", c("served_wd").alias("wd_served"), c("headway_wd").alias("wd_gap"), c("hourly_wd").alias("wd_hourly"), c("headway_we").alias("we_gap"))
    got = S.service_file(spark, _landed(s, "station_id", F.to_json(F.collect_list(row)), "service"))
    return got.select("name", "lat", "lon", "wd_served", "wd_gap", "we_gap", "wd_hourly")


def route_stops(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as routes whose lines' parts are the stops; some stops renamed on one route colour or dropped."""
    stop = X.read(spark, sf, "part").select(F.lit("node").alias("type"), c("p_partkey").alias("id"), X.lat(c("p_partkey"), 4409).alias("lat"), X.lon(c("p_partkey"), 6277).alias("lon"), F.when(c("p_partkey") % 10 != 0, F.create_map(F.lit("name"), F.concat(F.lit("Stop "), (c("p_partkey") % 50).cast("string")))).alias("tags"))
    route = X.read(spark, sf, "lineitem").groupBy(c("l_orderkey").alias("id")).agg(F.collect_list(F.struct(F.lit("node").alias("type"), c("l_partkey").alias("ref"), F.when(c("l_linenumber") == 4, "outer").otherwise("stop").alias("role"))).alias("members"))
    route = route.select(F.lit("relation").alias("type"), "id", F.create_map(F.lit("ref"), F.concat(F.lit("R"), (c("id") % 5).cast("string"))).alias("tags"), "members")
    both = stop.unionByName(route, allowMissingColumns=True)
    path = _landed(both, "id", _listed(*[c(x) for x in both.columns], name="elements"), "elements")
    stops = S.route_stops(S.osm_elements(spark, path)).withColumn("ref", c("tags")["ref"])
    rules = spark.createDataFrame([("R1", "stop 7", "Seventh", False), (None, "stop 9", None, True)], "ref string, name string, new_name string, dropped boolean")
    return S.fixed_stops(stops, rules).groupBy("ref", "stop_name").agg(F.count("*").alias("n"), F.countDistinct("relation_id").alias("routes"))


def geojson_regions(spark: SparkSession, sf: str) -> DataFrame:
    """A collection of polygons, every fourth as a polygon of several parts."""
    r = X.regions(spark, sf)
    pts = F.transform("rings", lambda ring: F.transform(ring, lambda p: F.array(p["lon"], p["lat"])))
    many = c("region_id") % 4 == 0
    shape = F.when(many, F.to_json(F.array(pts))).otherwise(F.to_json(pts))
    text = F.format_string('{"type": "Feature", "properties": {"name": "N%d"}, "geometry": {"type": "%s", "coordinates": %s}}', c("region_id"), F.when(many, "MultiPolygon").otherwise("Polygon"), shape)
    all_of = F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join(F.collect_list(text), ", "), F.lit("]}"))
    got = S.geojson_regions(spark, _landed(r, "region_id", all_of, "regions"))
    flat = got.select("region_id", F.size("rings").alias("rings"), F.explode(F.flatten("rings")).alias("p"))
    return flat.groupBy("region_id", "rings").agg(F.count("*").alias("points"), F.min("p.lon").alias("west"), F.max("p.lat").alias("north"))


def nested_pois(spark: SparkSession, sf: str) -> DataFrame:
    """Files of places by category."""
    p = X.pois(spark, sf)
    path = _path(spark, "pois")
    place = F.struct(c("poi_id").cast("string").alias("id"), "name", c("primary_type").alias("primaryType"), c("reviews").alias("userRatingCount"), c("status").alias("businessStatus"), "lat", "lon")
    blocks = p.groupBy(F.floor(c("poi_id") / FILE_ROWS).alias("file"), "category").agg(F.collect_list(place).alias("places"))
    block = F.struct(F.when(c("category") == "park", 1.0).otherwise(15.0).alias("tentacleRadiusMi"), F.size("places").alias("count"), "places")
    blocks.select(F.concat_ws("-", "file", "category").alias("file"), F.to_json(F.create_map("category", block)).alias("value")).write.partitionBy("file").text(path)
    got = S.nested_pois(spark, path)
    return got.select(c("id").cast("long").alias("poi_id"), "category", "tentacle_miles", "name", "primaryType", "userRatingCount", "businessStatus", "lat", "lon")


def gazetteer(spark: SparkSession, sf: str) -> DataFrame:
    """Peaks of a box, from a table of places without a header."""
    return S.gazetteer(spark, _gazetteer_file(spark, sf), (37.4, -122.3, 37.9, -121.8))


def gazetteer_in_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Peaks of a box that lie in a region."""
    return S.gazetteer(spark, _gazetteer_file(spark, sf), (37.4, -122.3, 37.9, -121.8), regions=X.regions(spark, sf))


def _gazetteer_file(spark: SparkSession, sf: str) -> str:
    p = X.pois(spark, sf)
    path = _path(spark, "gazetteer")
    kind = F.when(c("poi_id") % 5 == 0, "PK").when(c("poi_id") % 5 == 1, "MT").otherwise("RDGE")
    blank = [F.lit("x").alias(n) for n in ("asciiname", "alternatenames")]
    p.select("poi_id", "name", *blank, "lat", "lon", F.when(c("poi_id") % 3 == 0, "P").otherwise("T").alias("class"), kind.alias("code")).write.csv(path, sep="\t", quote="")
    return path


def csv_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates, every third without coordinates."""
    s = X.stations(spark, sf)
    path = _path(spark, "candidates")
    at = lambda n: F.when(c("station_id") % 3 != 0, c(n)).alias(n)
    s.select("name", F.concat((c("station_id") * 10).cast("string"), F.lit(" Main St")).alias("address"), "city", at("lat"), at("lon")).write.csv(path, header=True)
    return S.csv_candidates(spark, path, (37.7, -122.2))


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """Facilities of a state and two counties."""
    s = X.stations(spark, sf)
    row = (F.upper("name").alias("facility_name"), F.lit("MAIN STREET").alias("address"), F.lit("DALY CITY").alias("citytown"), F.when(c("station_id") % 4 == 0, "NV").otherwise("CA").alias("state"), F.lower("county").alias("countyparish"))
    return S.registry(spark, _landed(s, "station_id", _listed(*row, name="results"), "registry"), "CA", ["C1", "c3"])


def feature_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Features of two types."""
    s = X.stations(spark, sf)
    kind = F.when(c("station_id") % 4 == 0, "LIBRARY").when(c("station_id") % 4 == 1, "BRANCH").otherwise("OFFICE")
    row = F.struct(kind.alias("TYPE"), F.concat(F.lit(" "), F.upper("name")).alias("NAME"), c("city").alias("CITY")).alias("attributes")
    return S.feature_attributes(spark, _landed(s, "station_id", _listed(row, name="features"), "features"), ["LIBRARY", "BRANCH"])


def closed_rings(spark: SparkSession, sf: str) -> DataFrame:
    """Regions as ways and relations; a way that isn't closed has no ring, an inner member is left out."""
    r = X.regions(spark, sf)
    close = lambda ring: F.concat(ring, F.slice(ring, 1, 1))
    way = r.where("region_id % 2 = 1").select(F.lit("way").alias("type"), c("region_id").alias("id"), F.when(c("region_id") % 5 != 0, close(c("rings")[0])).otherwise(c("rings")[0]).alias("geometry"))
    mem = F.transform("rings", lambda ring, i: F.struct(F.lit("way").alias("type"), i.cast("long").alias("ref"), F.when(i == 0, "outer").otherwise("inner").alias("role"), close(ring).alias("geometry")))
    rel = r.where("region_id % 2 = 0").select(F.lit("relation").alias("type"), c("region_id").alias("id"), mem.alias("members"))
    both = way.unionByName(rel, allowMissingColumns=True)
    got = S.closed_rings(S.osm_elements(spark, _landed(both, "id", _listed(*[c(x) for x in both.columns], name="elements"), "shapes")))
    return got.select("fid", F.size("rings").alias("rings"), F.size(c("rings")[0]).alias("points"))


def partitioned_places(spark: SparkSession, sf: str) -> DataFrame:
    """A table written by category and lists with a header, read again and joined."""
    p = X.pois(spark, sf)
    table, lists = _path(spark, "by-category"), _path(spark, "lists")
    S.write_table(p.select("poi_id", "category", "reviews"), table, ["category"])
    S.write_csv(p.select("poi_id", "name"), lists)
    names = spark.read.csv(lists, header=True, schema="poi_id long, name string")
    return spark.read.parquet(table).where("category = 'park'").join(names, "poi_id").select("poi_id", "name", "reviews")


def review_payload(spark: SparkSession, sf: str) -> DataFrame:
    """Groups and single places in the payload of each category; every ninth part holds its two neighbours."""
    p = X.pois(spark, sf).select(c("poi_id").alias("pin"), "category", "name")
    kids = p.where("pin % 9 = 0").select(c("pin").alias("rep"), F.array(*[F.struct((c("pin") + i).alias("pin"), F.lit(f"kid {i}").alias("name")) for i in (1, 2)]).alias("kids"))
    got = S.review_payload(p.where("pin % 9 not in (1, 2)"), kids)
    v = F.from_json("payload", "groups array<struct<rep: long, kids: array<struct<pin: long>>>>, singles array<struct<pin: long, name: string>>").alias("v")
    return got.select("category", v).select("category", F.size("v.groups").alias("groups"), F.size("v.singles").alias("singles"), F.aggregate("v.groups", F.lit(0).cast("long"), lambda a, g: a + g["kids"][1]["pin"]).alias("last_kids"))


QUERIES = {f.__name__: f for f in (
    gtfs_stations, service_file, route_stops, geojson_regions, nested_pois, gazetteer, gazetteer_in_regions, csv_candidates, registry, feature_attributes, closed_rings, partitioned_places, review_payload,
)}

_TITLE = "upper(left({0}, 1)) || lower(substr({0}, 2))"
ORACLE_SQL = {
    "gtfs_stations": f"WITH {SQL_STATIONS} SELECT name, lat, lon FROM stations WHERE station_id % 3 = 1",
    "service_file": f"WITH {SQL_STATIONS} SELECT name, lat, lon, served_wd AS wd_served, headway_wd AS wd_gap, headway_we AS we_gap, hourly_wd AS wd_hourly FROM stations",
    "route_stops": """WITH m AS (SELECT l_orderkey AS relation_id, 'R' || (l_orderkey % 5) AS ref, 'Stop ' || (l_partkey % 50) AS stop_name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber <> 4 AND l_partkey % 10 <> 0)
 SELECT ref, CASE WHEN ref = 'R1' AND stop_name = 'Stop 7' THEN 'Seventh' ELSE stop_name END AS stop_name, count(*) AS n, count(DISTINCT relation_id) AS routes FROM m WHERE stop_name <> 'Stop 9' GROUP BY ALL""",
    "geojson_regions": f"WITH {SQL_EDGES} SELECT 'N' || region_id AS region_id, count(DISTINCT ring) AS rings, count(*) AS points, min(x1) AS west, max(y1) AS north FROM edges GROUP BY region_id",
    "nested_pois": f"WITH {SQL_POIS} SELECT poi_id, category, CASE WHEN category = 'park' THEN 1e0 ELSE 15e0 END AS tentacle_miles, name, primary_type AS \"primaryType\", reviews AS \"userRatingCount\", status AS \"businessStatus\", lat, lon FROM pois",
    "gazetteer_in_regions": f"""WITH {SQL_POIS}, {SQL_EDGES}, g AS (SELECT poi_id, name, lat, lon FROM pois WHERE poi_id % 3 <> 0 AND poi_id % 5 < 2 AND lat BETWEEN 37.4e0 AND 37.9e0 AND lon BETWEEN -122.3e0 AND -121.8e0),
 i AS (SELECT poi_id, region_id FROM g p, edges GROUP BY p.poi_id, region_id, p.lat, p.lon HAVING {_IN}) SELECT name, lat, lon FROM g SEMI JOIN i USING (poi_id)""",
    "gazetteer": f"WITH {SQL_POIS} SELECT name, lat, lon FROM pois WHERE poi_id % 3 <> 0 AND poi_id % 5 < 2 AND lat BETWEEN 37.4e0 AND 37.9e0 AND lon BETWEEN -122.3e0 AND -121.8e0",
    "csv_candidates": f"WITH {SQL_STATIONS} SELECT name, concat_ws(', ', name, (station_id * 10) || ' Main St', city) AS query, CASE WHEN station_id % 3 <> 0 THEN lat ELSE 37.7e0 END AS lat, CASE WHEN station_id % 3 <> 0 THEN lon ELSE -122.2e0 END AS lon, station_id % 3 = 0 AS coarse FROM stations",
    "registry": f"WITH {SQL_STATIONS} SELECT {_TITLE.format('name')} AS name, 'Main Street' AS address, 'Daly City' AS city FROM stations WHERE station_id % 4 <> 0 AND county IN ('C1', 'C3')",
    "feature_attributes": f"WITH {SQL_STATIONS} SELECT {_TITLE.format('name')} AS name, '' AS address, coalesce({_TITLE.format('city')}, '') AS city FROM stations WHERE station_id % 4 < 2",
    "closed_rings": "SELECT CASE WHEN n_nationkey % 2 = 1 THEN 'way/' ELSE 'relation/' END || n_nationkey AS fid, 1 AS rings, 7 AS points FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey % 5 <> 0",
    "partitioned_places": f"WITH {SQL_POIS} SELECT poi_id, name, reviews FROM pois WHERE category = 'park'",
    "review_payload": f"WITH {SQL_POIS} SELECT category, count(*) FILTER (poi_id % 9 = 0) AS groups, count(*) FILTER (poi_id % 9 > 2) AS singles, (coalesce(sum(poi_id + 2) FILTER (poi_id % 9 = 0), 0))::BIGINT AS last_kids FROM pois WHERE poi_id % 9 NOT IN (1, 2) GROUP BY category",
}
