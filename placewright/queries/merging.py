"""Queries on anchors, corrections, lists and summaries of places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.functions import names as N
from placewright.operators import joins as J
from placewright.operators import lines as L
from placewright.operators import places as P
from placewright.operators import resolve as E
from placewright.sources import fixtures as X
from placewright.sources.fixtures import SQL_POIS, SQL_STATIONS, sql_hav, sql_lat, sql_lon

c = F.col


def _anchors(spark: SparkSession, sf: str) -> DataFrame:
    k = c("s_suppkey")
    return X.read(spark, sf, "supplier").select(F.concat(F.lit("Hub "), (k % 40).cast("string")).alias("label"), k.alias("ord"), X.lat(k, 7127).alias("lat"), X.lon(k, 8243).alias("lon"))


def first_anchor(spark: SparkSession, sf: str) -> DataFrame:
    """The first supplier within 6 km of a station."""
    return J.first_anchor(X.stations(spark, sf).select(c("station_id").alias("id"), "lat", "lon"), _anchors(spark, sf), 6000.0)


def merged_at_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """The first stations of each system at an anchor become one."""
    s = X.stations(spark, sf).select(c("station_id").alias("id"), c("station_id").alias("ord"), "name", "lat", "lon", "systems", "lines", c("served_wd").alias("served"))
    out = P.merge_at_anchors(s, J.first_anchor(s, _anchors(spark, sf), 6000.0))
    return out.select("id", "name", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.array_join(F.array_sort("systems"), ",").alias("systems"), F.array_join(F.array_sort("lines"), ",").alias("lines"), "served")


def patched_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines added by the name of a station, from orders of its customer."""
    o = X.read(spark, sf, "orders")
    p = o.select(F.concat(F.lit("Customer#"), F.lpad(c("o_custkey").cast("string"), 9, "0")).alias("name"), F.array(F.concat(F.lit("X"), (c("o_orderkey") % 4).cast("string"))).alias("lines"))
    out = J.merge_lines_by_name(X.stations(spark, sf), p)
    return out.select("station_id", F.array_join("lines", ",").alias("lines"))


def verified_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as candidates, their lines' parts as hits; every fourth candidate is coarse."""
    k, i = c("l_orderkey"), c("l_partkey")
    hits = X.read(spark, sf, "lineitem").select(k.alias("cand_id"), c("l_linenumber").alias("ord"), i.alias("hit_id"), F.when(i % 3 == 0, "park").when(i % 3 == 1, "museum").otherwise("library").alias("primary_type"), F.lit("x").alias("name"), (X.lat(k, 4409) + (i % 9) * F.lit(0.0006)).alias("lat"), X.lon(k, 6277).alias("lon"))
    k = c("o_orderkey")
    cand = X.read(spark, sf, "orders").select(k.alias("cand_id"), F.get(F.array(*[F.lit(x) for x in ("park", "museum", "library")]), (k % 3).cast("int")).alias("category"), X.lat(k, 4409).alias("lat"), X.lon(k, 6277).alias("lon"), (k % 4 == 0).alias("coarse"))
    return J.verified_hits(cand, hits, c("primary_type") == c("category")).select("cand_id", "category", "hit_id")


def shown_places(spark: SparkSession, sf: str) -> DataFrame:
    """Places of two categories whose names contain a text, with label and colour."""
    shown = spark.createDataFrame([("park", "Parks", "green"), ("zoo", "Zoos", "brown")], "category string, label string, colour string")
    return P.poi_filter(X.pois(spark, sf), shown, "ED").select("poi_id", "label", "colour")


def listed_places(spark: SparkSession, sf: str) -> DataFrame:
    """Zoos only if they are on a list, by the name that it gives them."""
    p = X.pois(spark, sf)
    keep = p.where("poi_id % 2 = 0").select("poi_id", F.when(c("poi_id") % 4 == 0, F.concat(F.lit("Zoo "), c("poi_id").cast("string"))).otherwise(c("name")).alias("label"))
    kept, _ = P.curate(p, p.where("poi_id % 97 = 0").select("category", "name"), keep, "zoo", allow={})
    return kept.select("poi_id", "category", "name")


def reviewed_order(spark: SparkSession, sf: str) -> DataFrame:
    """The place of each kept place in its category, most reviews first."""
    return P.review_order(P.open_places(X.pois(spark, sf))).select("poi_id", "category", "place")


def peak_list(spark: SparkSession, sf: str) -> DataFrame:
    """T5: named peaks of 1500 feet or more, highest first, with the label of their height."""
    k = c("p_partkey")
    p = X.read(spark, sf, "part").select(k.alias("peak_id"), c("p_name").alias("name"), F.when(k % 6 != 0, c("p_size") * 20).alias("ele_m"))
    return P.peak_list(p).select("peak_id", "name", "label")


def gap_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Places not found elsewhere, by source and category, with totals."""
    p = X.pois(spark, sf)
    gaps = p.where("reviews < 20").select(F.when(c("poi_id") % 3 == 0, "atlas").otherwise("list").alias("source"), "category")
    return P.gap_summary(gaps).select(F.coalesce("source", F.lit("*")).alias("source"), F.coalesce("category", F.lit("*")).alias("category"), "n")


def kept_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names kept by county and kind."""
    s = X.stations(spark, sf).where("county is not null").select("county", F.coalesce("city", F.lit("none")).alias("kind"), "name")
    return P.keep_summary(s).select("county", "kind", "n", F.sha2(F.array_join("names", ","), 256).alias("names_sha"))


def line_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Ways of each system and colour, in order."""
    k = c("p_partkey")
    w = X.read(spark, sf, "part").select(F.get(F.array(*[F.lit(s) for s in N.SYSTEM_ORDER]), (k % 5).cast("int")).alias("system"), F.concat(F.lit("C"), F.floor(k / 200).cast("string")).alias("color"), k.alias("way_id"))
    return L.routes(w).select("system", "color", F.array_join("way_ids", ",").alias("way_ids"))


def water_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Waters worth listing, named after parts."""
    k = c("p_partkey")
    of = lambda *x: F.array(*[F.lit(v) for v in x])
    name = F.concat(F.split("p_name", " ")[0], F.lit(" "), F.get(of("Bay", "Lake", "POND", "Reservoir", "Strait", "Lagoon", "Cove Lake", "bay"), (k % 8).cast("int")))
    p = X.read(spark, sf, "part").select(k.alias("water_id"), name.alias("name"), F.when(k % 3 == 0, "bay").otherwise("water").alias("natural"), F.get(of("lake", "lagoon", "reservoir", "basin"), (k % 4).cast("int")).alias("water"))
    return p.select("water_id", "name", N.water_class(c("natural"), c("water"), c("name")).alias("kind")).where("kind is not null")


def renamed_pins(spark: SparkSession, sf: str) -> DataFrame:
    """Every sixth place has a new name, every twelfth a new position as well."""
    p = X.pois(spark, sf).select(c("poi_id").alias("pin"), "category", "name", "lat", "lon")
    k = c("pin")
    to = lambda n: F.when(k % 12 == 0, c(n) + 0.5).alias(f"new_{n}")
    return E.renamed(p, p.where(k % 6 == 0).select("pin", F.concat(F.lit("New "), k.cast("string")).alias("new_name"), to("lat"), to("lon")))


QUERIES = {f.__name__: f for f in (
    first_anchor, merged_at_anchors, patched_lines, verified_hits, shown_places, listed_places, reviewed_order, peak_list, gap_totals, kept_names, line_routes, water_bodies, renamed_pins,
)}

_ANCHOR = f"""{SQL_STATIONS}, anc AS (SELECT 'Hub ' || (s_suppkey % 40) AS label, s_suppkey AS ord, {sql_lat('s_suppkey', 7127)} AS lat, {sql_lon('s_suppkey', 8243)} AS lon FROM supplier),
 lab AS (SELECT station_id AS id, arg_min(label, (ord, label)) AS label FROM stations s JOIN anc a ON abs(s.lat - a.lat) < 0.06 AND {sql_hav('s.lat', 's.lon', 'a.lat', 'a.lon')} <= 6000 GROUP BY station_id)"""
_KIND = "['park', 'museum', 'library'][1 + {0} % 3]"
ORACLE_SQL = {
    "first_anchor": f"WITH {_ANCHOR} SELECT id, label FROM lab",
    "merged_at_anchors": f"""WITH {_ANCHOR}, f AS (SELECT s.*, label, label IS NOT NULL AND row_number() OVER (PARTITION BY label, systems[1] ORDER BY station_id) = 1 AS fst FROM stations s LEFT JOIN lab ON lab.id = s.station_id)
 SELECT min(station_id) AS id, label AS name, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, array_to_string(list_sort(list_distinct(flatten(list(systems)))), ',') AS systems, array_to_string(list_sort(list_distinct(flatten(list(lines)))), ',') AS lines, bool_or(served_wd) AS served FROM f WHERE fst GROUP BY label
 UNION ALL SELECT station_id, name, round(lat, 6), round(lon, 6), array_to_string(list_sort(systems), ','), array_to_string(list_sort(lines), ','), served_wd FROM f WHERE NOT fst""",
    "patched_lines": f"""WITH {SQL_STATIONS}, p AS (SELECT o_custkey AS k, list(DISTINCT 'X' || (o_orderkey % 4)) AS l FROM orders GROUP BY 1)
 SELECT station_id, array_to_string(list_sort(list_distinct(list_concat(lines, coalesce(l, [])))), ',') AS lines FROM stations LEFT JOIN p ON p.k = station_id""",
    "verified_hits": f"""WITH h AS (SELECT l_orderkey AS cand_id, l_linenumber AS ord, l_partkey AS hit_id, ['park', 'museum', 'library'][1 + l_partkey % 3] = {_KIND.format('l_orderkey')} AS ok, l_orderkey % 4 = 0 AS coarse, (l_partkey % 9) * 0.0006e0 * 111000 AS d FROM lineitem SEMI JOIN orders ON o_orderkey = l_orderkey),
 b AS (SELECT * FROM h WHERE CASE WHEN coarse THEN ok ELSE d <= 350 END QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY CASE WHEN coarse THEN 0 ELSE round(d, 3) END, ord, hit_id) = 1) SELECT cand_id, {_KIND.format('cand_id')} AS category, hit_id FROM b WHERE ok""",
    "shown_places": f"WITH {SQL_POIS} SELECT poi_id, CASE category WHEN 'park' THEN 'Parks' ELSE 'Zoos' END AS label, CASE category WHEN 'park' THEN 'green' ELSE 'brown' END AS colour FROM pois WHERE category IN ('park', 'zoo') AND contains(lower(name), 'ed')",
    "listed_places": f"""WITH {SQL_POIS}, l AS (SELECT *, CASE WHEN category = 'zoo' AND poi_id % 4 = 0 THEN 'Zoo ' || poi_id ELSE name END AS shown FROM pois WHERE reviews >= 5 AND coalesce(status, '') <> 'CLOSED_PERMANENTLY' AND (category <> 'zoo' OR poi_id % 2 = 0))
 SELECT poi_id, category, shown AS name FROM l WHERE (category, shown) NOT IN (SELECT (category, name) FROM pois WHERE poi_id % 97 = 0)""",
    "reviewed_order": f"WITH {SQL_POIS} SELECT poi_id, category, row_number() OVER (PARTITION BY category ORDER BY reviews DESC, poi_id) AS place FROM pois WHERE coalesce(status, '') <> 'CLOSED_PERMANENTLY'",
    "peak_list": "SELECT p_partkey AS peak_id, p_name AS name, floor((p_size * 20) * 3.280839895e0 + 0.5)::BIGINT || ' ft' AS label FROM part WHERE p_partkey % 6 <> 0 AND (p_size * 20) * 3.280839895e0 >= 1500",
    "gap_totals": f"WITH {SQL_POIS}, g AS (SELECT CASE WHEN poi_id % 3 = 0 THEN 'atlas' ELSE 'list' END AS source, category FROM pois WHERE reviews < 20) SELECT coalesce(source, '*') AS source, coalesce(category, '*') AS category, count(*) AS n FROM g GROUP BY ROLLUP (source, category)",
    "kept_names": f"WITH {SQL_STATIONS} SELECT county, coalesce(city, 'none') AS kind, count(*) AS n, sha256(string_agg(name, ',' ORDER BY name)) AS names_sha FROM stations WHERE county IS NOT NULL GROUP BY ALL",
    "water_bodies": """WITH w AS (SELECT p_partkey AS water_id, split_part(p_name, ' ', 1) || ' ' || ['Bay', 'Lake', 'POND', 'Reservoir', 'Strait', 'Lagoon', 'Cove Lake', 'bay'][1 + p_partkey % 8] AS name,
  CASE WHEN p_partkey % 3 = 0 THEN 'bay' ELSE ['lake', 'lagoon', 'reservoir', NULL][1 + p_partkey % 4] END AS kind FROM part)
 SELECT * FROM w WHERE kind IS NOT NULL AND name NOT ILIKE '%pond%' AND name NOT ILIKE '%cove%' AND name NOT ILIKE '%dam%' AND (kind IN ('lake', 'lagoon') OR kind = 'bay' AND (name LIKE '%Bay%' OR name LIKE '%Strait%' OR name LIKE '%Lagoon%') OR kind = 'reservoir' AND (name LIKE '%Reservoir%' OR name LIKE '%Lake%'))""",
    "renamed_pins": f"WITH {SQL_POIS} SELECT poi_id AS pin, category, CASE WHEN poi_id % 6 = 0 THEN 'New ' || poi_id ELSE name END AS name, CASE WHEN poi_id % 12 = 0 THEN lat + 0.5e0 ELSE lat END AS lat, CASE WHEN poi_id % 12 = 0 THEN lon + 0.5e0 ELSE lon END AS lon FROM pois",
    "line_routes": "SELECT ['BART', 'Caltrain', 'VTA', 'Muni', 'SFO AirTrain'][1 + p_partkey % 5] AS system, 'C' || (p_partkey // 200) AS color, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS way_ids FROM part GROUP BY ALL",
}
