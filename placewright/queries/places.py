"""Queries on places: distance joins, curation, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.functions import names as N
from placewright.operators import joins as J
from placewright.operators import places as P
from placewright.operators import tentacles as T
from placewright.sources import fixtures as X
from placewright.sources.fixtures import SQL_POIS, SQL_STATIONS, SQL_VERTICES, sql_hav, sql_lat, sql_lon

c = F.col


def _planar(a: str, b: str, d: str, e: str) -> str:
    return f"sqrt(pow(({e} - {b}) * 111320.0e0 * cos(radians(37.7e0)), 2) + pow(({d} - {a}) * 110540.0e0, 2))"


def _km(a: str, b: str, d: str, e: str) -> str:
    return f"sqrt(pow(({d} - {a}) * 111.0e0, 2) + pow(({e} - {b}) * 88.0e0, 2))"


def stops_to_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of stations by stops within 1 700 m (the tables are sparse) of the same system."""
    st = X.stations(spark, sf).select("station_id", "lat", "lon", c("systems")[0].alias("system"), "lines")
    k = c("p_partkey")
    stops = X.read(spark, sf, "part").select(F.get(F.array(*[F.lit(s) for s in N.SYSTEM_ORDER]), (k % 5).cast("int")).alias("system"), F.concat(F.lit("N"), (k % 13).cast("string")).alias("line"), X.lat(k, 4409).alias("lat"), X.lon(k, 6277).alias("lon"))
    return J.lines_of_stations(st, stops, ["BART", "VTA"], 1700.0).select("station_id", F.array_join("lines", ",").alias("lines"))


def nearest_stop(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer station's nearest supplier stop under 5 km."""
    stops = X.line_vertices(spark, sf)
    out = J.nearest_within(X.stations(spark, sf), stops, 5000.0, "station_id", "seq", strict=True, copy="right")
    return out.select("station_id", "seq", F.round("d", 2).alias("d"))


def nearest_poi(spark: SparkSession, sf: str) -> DataFrame:
    """The two nearest places of each category of each supplier stop, without a radius."""
    s = X.line_vertices(spark, sf).select("seq", "lat", "lon").crossJoin(X.pois(spark, sf).select("category").distinct())
    s = s.withColumn("key", F.concat_ws("|", "seq", "category"))
    return J.nearest(s, X.pois(spark, sf), "key", "poi_id", 2, ["category"], 20_000.0).select("key", "poi_id", c("rank").cast("long").alias("rank"), F.round("d", 2).alias("d"))


def _seekers(spark: SparkSession, sf: str) -> DataFrame:
    g = X.read(spark, sf, "events").groupBy("user_id").agg(F.min("event_id").alias("e"))
    cat = F.get(F.array(*[F.lit(x) for x in ("park", "museum", "library", "hospital", "zoo")]), (c("user_id") % 5).cast("int"))
    return g.select(c("user_id").alias("game_id"), cat.alias("category"), X.lat(c("e"), 6151).alias("lat"), X.lon(c("e"), 7537).alias("lon"))


def nearest_poi_match(spark: SparkSession, sf: str) -> DataFrame:
    """Q13, Q14."""
    return J.nearest_match_counts(X.stations(spark, sf), X.pois(spark, sf), _seekers(spark, sf))


def tentacle(spark: SparkSession, sf: str) -> DataFrame:
    """Q15 with a radius of 15 miles."""
    return T.tentacle_counts(X.stations(spark, sf), X.pois(spark, sf), _seekers(spark, sf), 15 * 1609.344)


def _own(spark: SparkSession, sf: str) -> DataFrame:
    p = X.pois(spark, sf)
    return p.select("category", c("poi_id").alias("id"), "name", "lat", "lon", N.match_norm(c("name")).alias("norm"))


def _found(spark: SparkSession, sf: str) -> DataFrame:
    """Places as another feed sees them: every third, moved a little, named by the first word."""
    p = _own(spark, sf).where("id % 3 = 0")
    moved = p.select("category", (c("id") + 1_000_000).alias("id"), F.split("name", " ")[0].alias("name"), (c("lat") + (c("id") % 7) * F.lit(0.002)).alias("lat"), (c("lon") - (c("id") % 5) * F.lit(0.003)).alias("lon"))
    return moved.withColumn("norm", N.match_norm(c("name")))


_SQL_OWN = f"{SQL_POIS}, own AS (SELECT category, poi_id AS id, name, lat, lon, lower(name) AS norm FROM pois), found AS (SELECT category, id + 1000000 AS id, split_part(name, ' ', 1) AS name, lat + (id % 7) * 0.002e0 AS lat, lon - (id % 5) * 0.003e0 AS lon, lower(split_part(name, ' ', 1)) AS norm FROM own WHERE id % 3 = 0)"


def gap_audit_anti(spark: SparkSession, sf: str) -> DataFrame:
    """J8."""
    return J.gap_audit(_found(spark, sf), _own(spark, sf)).select("id", "category")


def new_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """J9."""
    tok = F.split("norm", " ")
    return J.new_candidates(_found(spark, sf).withColumn("tokens", tok), _own(spark, sf).withColumn("tokens", tok)).select("id", "category")


def backfilled(spark: SparkSession, sf: str) -> DataFrame:
    """A second feed of shifted places of the same names, some twice."""
    own = _own(spark, sf).select("category", "id", "name", "lat", "lon")
    k = c("id")
    new = own.where("id % 2 = 0").select("category", F.when(k % 4 == 0, k + 2_000_000).otherwise(k).alias("id"), F.upper("name").alias("name"), (c("lat") + (k % 3) * F.lit(0.0004)).alias("lat"), "lon", k.alias("ord"))
    out = J.backfill(own, new)
    return out.groupBy("category").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def nested_flag(spark: SparkSession, sf: str) -> DataFrame:
    """J13."""
    return J.nested_flags(X.pois(spark, sf), 6000.0)


def baseline_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Parts against a changed earlier version."""
    p = X.pois(spark, sf).select("poi_id", "reviews")
    k = c("poi_id")
    old = p.where(k % 10 != 3).select(F.when(k % 10 == 7, k + 5_000_000).otherwise(k).alias("poi_id"), F.when(k % 4 == 1, c("reviews") + 1).otherwise(c("reviews")).alias("reviews"))
    return J.baseline_diff(p, old, "poi_id", "reviews").groupBy("status").agg(F.count("*").alias("n"))


def enriched_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Unknown statuses filled from a keyed table."""
    p = X.pois(spark, sf).select("poi_id", "status")
    cache = p.where("poi_id % 2 = 0").select("poi_id", F.lit("CHECKED").alias("status"))
    return J.enriched(p, cache, "poi_id", "status").groupBy(F.coalesce("status", F.lit("-")).alias("status")).agg(F.count("*").alias("n"))


def curation_funnel(spark: SparkSession, sf: str) -> DataFrame:
    """P4-P7, A9."""
    p = X.pois(spark, sf)
    allow = {"park": ["STANDARD POLISHED TIN", "SMALL PLATED COPPER"]}
    nested = p.where("poi_id % 97 = 0").select("category", "name")
    _, funnel = P.curate(p, nested, exempt=["library"], allow=allow)
    return funnel


def review_flags(spark: SparkSession, sf: str) -> DataFrame:
    """P8."""
    p = X.pois(spark, sf)
    out = P.review_flags(p, p.where("poi_id % 31 = 0").select("category", "name"), J.nested_flags(p))
    return out.groupBy("category").agg(F.count_if("flag").alias("flagged"), F.count("*").alias("n"))


def membership_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A1."""
    return P.memberships(X.stations(spark, sf))


def line_tree(spark: SparkSession, sf: str) -> DataFrame:
    """A2."""
    return P.line_tree(X.stations(spark, sf)).select("agency", F.coalesce("line", F.lit("*")).alias("line"), "stations")


def stops_per_line(spark: SparkSession, sf: str) -> DataFrame:
    """A3, A4."""
    own = P.stops_per_line(X.stations(spark, sf))
    other = own.where("line <> 'L3'").select("line", (c("stops") + F.when(c("line") == "L5", 9).otherwise(1)).alias("stops"))
    return P.count_check(own, other).select("line", "own", F.coalesce("reference", F.lit(-1)).alias("reference"), "off")


def histograms(spark: SparkSession, sf: str) -> DataFrame:
    """A5, A6."""
    s = X.stations(spark, sf)
    a = P.length_histogram(s.where("name_length <> 12")).select(F.lit("length").alias("what"), c("length").cast("long").alias("bin"), "n")
    return a.unionByName(P.elevation_histogram(s).select(F.lit("elevation").alias("what"), c("bin").cast("long").alias("bin"), "n"))


def domains(spark: SparkSession, sf: str) -> DataFrame:
    """P13."""
    s = X.stations(spark, sf)
    return P.domain(s, "county").withColumn("what", F.lit("county")).unionByName(P.domain(s, "city").withColumn("what", F.lit("city"))).unionByName(P.domain(s, "lines").withColumn("what", F.lit("line")))


def text_search(spark: SparkSession, sf: str) -> DataFrame:
    """P14."""
    s = X.stations(spark, sf).withColumn("aka", F.array(F.concat(F.lit("Stop "), c("station_id").cast("string"))))
    return P.text_search(s, "L5 MACH").select("station_id")


def category_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A10, P15."""
    p = X.pois(spark, sf)
    return P.category_counts(p.select("category").distinct(), p, "ED").withColumn("n", c("n").cast("long"))


def compact_places(spark: SparkSession, sf: str) -> DataFrame:
    """P18."""
    return P.compact(P.open_places(X.pois(spark, sf)))


def unique_names(spark: SparkSession, sf: str) -> DataFrame:
    """Shown names of stations named by their city."""
    s = X.stations(spark, sf).withColumn("name", F.when(c("station_id") % 3 == 0, F.concat(c("name"))).otherwise(F.coalesce("city", c("name"))))
    return P.unique_names(s).select("station_id", "shown")


def ranked_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The first station of each county with its dense id."""
    s = P.starred_first(X.stations(spark, sf).where("county is not null"), X.stations(spark, sf).where("station_id % 8 = 0"))
    first = P.first_per_key(s.withColumn("back", -c("starred").cast("int")), ["county"], ["back", "name", "station_id"])
    return P.dense_ids(first, ["county"]).select("id", "county", "station_id", "starred")


def game_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """P25: sizes suggested by nations' customers and balances."""
    n = X.read(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum(F.abs("c_acctbal")).alias("b"))
    return n.select(c("c_nationkey").cast("long").alias("nation"), P.suggest_size(c("n"), F.round(c("b") / 1000, 0)).alias("size"))


def service_rules(spark: SparkSession, sf: str) -> DataFrame:
    """P1, P2."""
    from placewright.operators import questions as Q

    s = X.stations(spark, sf)
    parts = [("wd", Q.eligible(s)), ("we", Q.eligible(s, "we")), ("served", Q.served(s)), ("hourly", Q.served(s, "wd", True))]
    out = None
    for name, df in parts:
        n = df.agg(F.count("*").alias("n")).withColumn("what", F.lit(name))
        out = n if out is None else out.unionByName(n)
    return out


def clustered_stops(spark: SparkSession, sf: str) -> DataFrame:
    """Stops from parts, 250 m apart at most or of one name, to stations."""
    k = c("p_partkey")
    stops = X.read(spark, sf, "part").select(k.alias("stop_id"), F.concat(F.lit("Stop "), F.floor(k / 3).cast("string"), F.when(k % 4 == 0, " & Main").otherwise("")).alias("name"), X.lat(k, 4409).alias("lat"), X.lon(k, 6277).alias("lon"), F.concat(F.lit("L"), (k % 5).cast("string")).alias("line"))
    out = P.cluster_stops(stops, 250.0)
    return out.select("cluster", "name", F.array_join("lines", ",").alias("lines"), "members", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


_AGENCY = "CASE WHEN line LIKE 'SFO AirTrain%' THEN 'SFO AirTrain' WHEN line LIKE 'Caltrain%' THEN 'Caltrain' WHEN line LIKE 'VTA%' THEN 'VTA' WHEN line LIKE 'Muni%' THEN 'Muni' ELSE 'BART' END"
_SEEK = f"seek AS (SELECT user_id AS game_id, ['park', 'museum', 'library', 'hospital', 'zoo'][1 + user_id % 5] AS category, {sql_lat('e', 6151)} AS lat, {sql_lon('e', 7537)} AS lon FROM (SELECT user_id, min(event_id) AS e FROM events GROUP BY user_id))"
_STOPS = f"stops AS (SELECT ['BART', 'Caltrain', 'VTA', 'Muni', 'SFO AirTrain'][1 + p_partkey % 5] AS system, 'N' || (p_partkey % 13) AS line, {sql_lat('p_partkey', 4409)} AS lat, {sql_lon('p_partkey', 6277)} AS lon FROM part)"
_CLUSTER = f"""st AS (SELECT p_partkey AS id, 'Stop ' || (p_partkey // 3) || CASE WHEN p_partkey % 4 = 0 THEN ' & Main' ELSE '' END AS name, {sql_lat('p_partkey', 4409)} AS lat, {sql_lon('p_partkey', 6277)} AS lon, 'L' || (p_partkey % 5) AS line FROM part),
 e AS (SELECT a.id AS a, b.id AS b FROM st a JOIN st b ON a.id <> b.id AND (a.name = b.name OR (abs(a.lat - b.lat) < 0.01 AND {sql_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} < 250))),
 walk(id, root) AS (SELECT id, id FROM st UNION SELECT e.b, walk.root FROM walk JOIN e ON e.a = walk.id),
 cc AS (SELECT id, min(root) AS cluster FROM walk GROUP BY id)"""

QUERIES = {f.__name__: f for f in (
    stops_to_lines, nearest_stop, nearest_poi, nearest_poi_match, tentacle, gap_audit_anti, new_candidates, backfilled, nested_flag, baseline_diff, enriched_reviews, curation_funnel, review_flags,
    membership_counts, line_tree, stops_per_line, histograms, domains, text_search, category_counts, compact_places, unique_names, ranked_lists, game_sizes, service_rules, clustered_stops,
)}

ORACLE_SQL = {
    "stops_to_lines": f"WITH {SQL_STATIONS}, {_STOPS}, f AS (SELECT station_id, list_sort(list(DISTINCT p.line)) AS l FROM stations s JOIN stops p ON s.systems[1] = p.system AND s.systems[1] IN ('BART', 'VTA') AND abs(s.lat - p.lat) < 0.02 AND {_planar('s.lat', 's.lon', 'p.lat', 'p.lon')} < 1700 GROUP BY station_id) SELECT station_id, array_to_string(list_sort(coalesce(l, lines)), ',') AS lines FROM stations LEFT JOIN f USING (station_id)",
    "nearest_stop": f"WITH {SQL_STATIONS}, {SQL_VERTICES}, p AS (SELECT station_id, seq, {sql_hav('s.lat', 's.lon', 'v.lat', 'v.lon')} AS d FROM stations s, vertices v) SELECT station_id, seq, round(d, 2) AS d FROM p WHERE d < 5000 QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY d, seq) = 1",
    "nearest_poi": f"WITH {SQL_POIS}, {SQL_VERTICES}, p AS (SELECT seq || '|' || category AS key, poi_id, {sql_hav('v.lat', 'v.lon', 'o.lat', 'o.lon')} AS d FROM vertices v, pois o) SELECT key, poi_id, row_number() OVER (PARTITION BY key ORDER BY d, poi_id) AS rank, round(d, 2) AS d FROM p QUALIFY rank <= 2",
    "nearest_poi_match": f"""WITH {SQL_STATIONS}, {SQL_POIS}, {_SEEK}, cats AS (SELECT DISTINCT category FROM seek),
 s AS (SELECT station_id, o.category, poi_id, {sql_hav('s.lat', 's.lon', 'o.lat', 'o.lon')} AS d FROM stations s, pois o WHERE o.category IN (FROM cats) QUALIFY row_number() OVER (PARTITION BY station_id, o.category ORDER BY d, poi_id) = 1),
 q AS (SELECT game_id, o.category, poi_id, {sql_hav('s.lat', 's.lon', 'o.lat', 'o.lon')} AS d FROM seek s JOIN pois o USING (category) QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY d, poi_id) = 1)
 SELECT game_id, count(*) FILTER (s.poi_id = q.poi_id) AS same, count(*) FILTER (s.d < q.d) AS closer, count(*) AS n FROM s JOIN q USING (category) GROUP BY game_id""",
    "tentacle": f"""WITH {SQL_STATIONS}, {SQL_POIS}, {_SEEK}, r AS (SELECT game_id, poi_id, o.lat, o.lon FROM seek s JOIN pois o USING (category) WHERE {sql_hav('s.lat', 's.lon', 'o.lat', 'o.lon')} <= 15 * 1609.344e0),
 b AS (SELECT game_id, station_id, poi_id FROM stations s, r QUALIFY row_number() OVER (PARTITION BY game_id, station_id ORDER BY {sql_hav('s.lat', 's.lon', 'r.lat', 'r.lon')}, poi_id) = 1) SELECT game_id, poi_id, count(*) AS stations FROM b GROUP BY ALL""",
    "gap_audit_anti": f"WITH {_SQL_OWN} SELECT id, category FROM found f WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.category = f.category AND ({_km('f.lat', 'f.lon', 'o.lat', 'o.lon')} < 0.3 OR ({_km('f.lat', 'f.lon', 'o.lat', 'o.lon')} < 1.5 AND (contains(f.norm, o.norm) OR contains(o.norm, f.norm)))))",
    "new_candidates": f"WITH {_SQL_OWN} SELECT id, category FROM found f WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.category = f.category AND (o.norm = f.norm OR ({_km('f.lat', 'f.lon', 'o.lat', 'o.lon')} < 0.4 AND (list_has_all(string_split(o.norm, ' '), string_split(f.norm, ' ')) OR list_has_all(string_split(f.norm, ' '), string_split(o.norm, ' '))))))",
    "backfilled": f"""WITH {_SQL_OWN}, nw AS (SELECT category, CASE WHEN id % 4 = 0 THEN id + 2000000 ELSE id END AS id, lower(name) AS low, lat + (id % 3) * 0.0004e0 AS lat, lon, id AS ord FROM own WHERE id % 2 = 0),
 fr AS (SELECT * FROM nw n WHERE id NOT IN (SELECT id FROM own) AND NOT EXISTS (SELECT 1 FROM own o WHERE o.category = n.category AND o.norm = n.low AND {_km('n.lat', 'n.lon', 'o.lat', 'o.lon')} * 1000 < 60)),
 ad AS (SELECT * FROM fr a WHERE NOT EXISTS (SELECT 1 FROM fr b WHERE b.category = a.category AND b.low = a.low AND b.ord < a.ord AND {_km('a.lat', 'a.lon', 'b.lat', 'b.lon')} * 1000 < 60))
 SELECT category, count(*) AS n, sum(id)::BIGINT AS ids FROM (SELECT category, id FROM own UNION ALL SELECT category, id FROM ad) GROUP BY category""",
    "nested_flag": f"WITH {SQL_POIS} SELECT a.poi_id, min(b.poi_id) AS nested_in FROM pois a JOIN pois b ON a.category = b.category AND a.poi_id <> b.poi_id AND abs(a.lat - b.lat) < 0.1 AND b.reviews >= 3 * greatest(a.reviews, 1) AND {sql_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 6000 GROUP BY a.poi_id",
    "baseline_diff": "WITH n AS (SELECT p_partkey AS k, p_size AS v FROM part), o AS (SELECT CASE WHEN k % 10 = 7 THEN k + 5000000 ELSE k END AS k, CASE WHEN k % 4 = 1 THEN v + 1 ELSE v END AS v FROM n WHERE k % 10 <> 3) SELECT CASE WHEN o.v IS NULL THEN 'new' WHEN n.v IS NULL THEN 'REMOVED' WHEN n.v = o.v THEN 'same' ELSE 'CHANGED' END AS status, count(*) AS n FROM n FULL JOIN o ON n.k = o.k GROUP BY 1",
    "enriched_reviews": f"WITH {SQL_POIS} SELECT coalesce(status, CASE WHEN poi_id % 2 = 0 THEN 'CHECKED' ELSE '-' END) AS status, count(*) AS n FROM pois GROUP BY 1",
    "curation_funnel": f"""WITH {SQL_POIS}, nest AS (SELECT DISTINCT category, name FROM pois WHERE poi_id % 97 = 0),
 f AS (SELECT p.*, reviews >= CASE WHEN category = 'library' THEN 0 ELSE 5 END AND coalesce(status, '') <> 'CLOSED_PERMANENTLY' AS ok, category <> 'park' OR primary_type IN ('STANDARD POLISHED TIN', 'SMALL PLATED COPPER') AS typed, (category, name) IN (SELECT (category, name) FROM nest) AS part FROM pois p)
 SELECT category, count(*) AS raw, count(*) FILTER (ok) AS reviewed, count(*) FILTER (ok AND NOT typed) AS off_type, count(*) FILTER (ok AND typed AND part) AS removed, count(*) FILTER (ok AND typed AND NOT part) AS kept FROM f GROUP BY category""",
    "review_flags": f"""WITH {SQL_POIS}, nest AS (SELECT DISTINCT a.poi_id FROM pois a JOIN pois b ON a.category = b.category AND a.poi_id <> b.poi_id AND abs(a.lat - b.lat) < 0.01 AND b.reviews >= 3 * greatest(a.reviews, 1) AND {sql_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 800),
 nm AS (SELECT DISTINCT category, name FROM pois WHERE poi_id % 31 = 0) SELECT category, count(*) FILTER (poi_id IN (FROM nest) OR (category, name) IN (SELECT (category, name) FROM nm)) AS flagged, count(*) AS n FROM pois GROUP BY category""",
    "membership_counts": f"WITH {SQL_STATIONS}, o AS (SELECT ['BART', 'Caltrain', 'VTA', 'Muni', 'SFO AirTrain'] AS o), e AS (SELECT unnest(systems) AS system, list_filter(o, lambda x: list_contains(systems, x))[1] AS prim FROM stations, o) SELECT system, count(*) AS members, count(*) FILTER (system = prim) AS primaries FROM e GROUP BY system",
    "line_tree": f"WITH {SQL_STATIONS}, e AS (SELECT station_id, unnest(lines) AS line FROM stations), a AS (SELECT *, {_AGENCY} AS agency FROM e) SELECT agency, line, count(DISTINCT station_id) AS stations FROM a GROUP BY ALL UNION ALL SELECT agency, '*', count(DISTINCT station_id) FROM a GROUP BY agency",
    "stops_per_line": f"WITH {SQL_STATIONS}, e AS (SELECT unnest(lines) AS line FROM stations), o AS (SELECT line, count(*) AS own FROM e GROUP BY line) SELECT line, own, CASE WHEN line <> 'L3' THEN own + CASE WHEN line = 'L5' THEN 9 ELSE 1 END ELSE -1 END AS reference, line IN ('L3', 'L5') AS off FROM o",
    "histograms": f"""WITH {SQL_STATIONS}, l AS (SELECT unnest(generate_series(min(name_length), max(name_length))) AS b FROM stations WHERE name_length <> 12)
 SELECT 'length' AS what, b::BIGINT AS bin, (SELECT count(*) FROM stations WHERE name_length = b AND b <> 12) AS n FROM l UNION ALL SELECT 'elevation', greatest(0, least(floor(elevation * 3.280839895e0 / 50), 9))::BIGINT, count(*) FROM stations WHERE elevation IS NOT NULL GROUP BY 2""",
    "domains": f"WITH {SQL_STATIONS} SELECT DISTINCT county AS value, 'county' AS what FROM stations WHERE county IS NOT NULL UNION ALL SELECT DISTINCT city, 'city' FROM stations WHERE city IS NOT NULL UNION ALL SELECT DISTINCT unnest(lines), 'line' FROM stations",
    "text_search": f"WITH {SQL_STATIONS} SELECT station_id FROM stations WHERE contains(lower(name || ' Stop ' || station_id || ' ' || array_to_string(systems, ' ') || ' ' || array_to_string(lines, ' ') || coalesce(' ' || city, '') || coalesce(' ' || county, '')), 'l5 mach')",
    "category_counts": f"WITH {SQL_POIS} SELECT category, count(*) FILTER (contains(lower(name), 'ed')) AS n FROM pois GROUP BY category",
    "compact_places": f"WITH {SQL_POIS} SELECT category, name AS n, round(lat, 6) AS lat, round(lon, 6) AS lon, primary_type AS t, reviews AS r FROM pois WHERE coalesce(status, '') <> 'CLOSED_PERMANENTLY'",
    "unique_names": f"WITH {SQL_STATIONS}, n AS (SELECT station_id, systems, CASE WHEN station_id % 3 = 0 THEN name ELSE coalesce(city, name) END AS name FROM stations) SELECT station_id, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || ' (' || list_min(systems) || ')' ELSE name END AS shown FROM n",
    "ranked_lists": f"WITH {SQL_STATIONS}, f AS (SELECT county, station_id, station_id % 8 = 0 AS starred FROM stations WHERE county IS NOT NULL QUALIFY row_number() OVER (PARTITION BY county ORDER BY starred DESC, name, station_id) = 1) SELECT 's' || lpad((row_number() OVER (ORDER BY county) - 1)::VARCHAR, 3, '0') AS id, county, station_id, starred FROM f",
    "game_sizes": "WITH n AS (SELECT c_nationkey::BIGINT AS nation, count(*) AS n, round(sum(abs(c_acctbal)) / 1000, 0) AS b FROM customer GROUP BY 1) SELECT nation, CASE WHEN n >= 180 OR b >= 500 THEN 'large' WHEN n >= 60 OR b >= 50 THEN 'medium' ELSE 'small' END AS size FROM n",
    "service_rules": f"WITH {SQL_STATIONS} SELECT count(*) AS n, 'wd' AS what FROM stations WHERE headway_wd <= 60 UNION ALL SELECT count(*), 'we' FROM stations WHERE headway_we <= 60 UNION ALL SELECT count(*), 'served' FROM stations WHERE served_wd UNION ALL SELECT count(*), 'hourly' FROM stations WHERE served_wd AND hourly_wd",
    "clustered_stops": f"WITH RECURSIVE {_CLUSTER} SELECT cluster, arg_min(name, (contains(name, '&'), length(name), name)) AS name, array_to_string(list_sort(list(DISTINCT line)), ',') AS lines, count(*) AS members, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM st JOIN cc USING (id) GROUP BY cluster",
}
