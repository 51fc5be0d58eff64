"""Queries on feeds, text, names, logs and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.functions import geo
from placewright.functions import names as N
from placewright.operators import audit as A
from placewright.operators import questions as Q
from placewright.sources import fixtures as X
from placewright.sources import readers as S
from placewright.sources.fixtures import SQL_POIS, SQL_STATIONS
from placewright.streaming import logs

from . import shapes

c = F.col


def html_line_pattern(spark: SparkSession, sf: str) -> DataFrame:
    """Text lines of pages that end in a comma, with the next two lines."""
    lines = S.text_lines(X.read(spark, sf, "pages"), "page_id")
    return S.three_line_pattern(lines, "page_id", "e")


def page_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = S.text_lines(X.read(spark, sf, "pages"), "page_id")
    return lines.groupBy("page_id").agg(F.count("*").alias("lines"), F.max(F.length("line")).alias("longest"))


def section_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Document lines under one-word headings and two-word subheadings."""
    d = X.read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    out = S.sectioned(d, "doc_id", c("line").rlike(r"^\S+$"), c("line").rlike(r"^\S+ \S+$"), F.col("section") != "")
    return out.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("section").alias("sections"), F.min("no").cast("long").alias("first_no"))


def name_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Normal form, words, sub-part and qualifier signs of part names."""
    n = F.concat_ws(" ", c("p_name"), F.get(F.array(*[F.lit(x) for x in ("Park", "& Co. Entrance", "(Main)", "12 Building B", "Library: East")]), (c("p_partkey") % 5).cast("int")))
    p = X.read(spark, sf, "part").select(c("p_partkey").alias("id"), n.alias("n"))
    return p.select("id", N.match_norm(c("n")).alias("norm"), F.array_join(N.distinctive(c("n")), " ").alias("words"), N.is_sub(c("n")).alias("sub"), N.has_qualifier(c("n")).alias("qualified"), N.name_length(F.concat("n", F.lit(" (Muni)"))).cast("long").alias("len"))


def line_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Systems of routes and names of lines from customers."""
    k = c("c_custkey")
    pick = lambda *x: F.get(F.array(*[F.lit(v) for v in x]), (k % len(x)).cast("int"))
    r = X.read(spark, sf, "customer").select(k.alias("id"), pick("SFMTA", "Bay Area Rapid Transit", "Caltrain", "Santa Clara Valley", "x").alias("op"), pick("", "Muni", "AirTrain").alias("net"), pick("N", "", "Red").alias("ref"), pick("Green: North - South", "Local").alias("name"), pick("tram", "cable_car").alias("mode"), pick("", "#FF0000", "#00ff00", None).alias("tag"))
    r = r.withColumn("system", N.route_system(c("op"), c("net"), c("mode")))
    return r.select("id", F.coalesce("system", F.lit("-")).alias("system"), N.line_name(F.coalesce("system", F.lit("X")), c("ref"), c("name")).alias("line"), N.colour(c("tag"), F.lit("#888888"), {"#ff0000": "#d4001a"}).alias("colour"))


def system_labels(spark: SparkSession, sf: str) -> DataFrame:
    """P26, P28."""
    s = X.stations(spark, sf).withColumn("p", N.primary_system(c("systems")))
    named = F.transform("lines", lambda x: F.concat(c("p"), F.lit(" "), x))
    return s.select("station_id", c("p").alias("primary"), (F.size("systems") > 1).alias("several"), N.line_labels(F.concat(named, F.array(c("p"))), c("p")).alias("label"))


def other_names(spark: SparkSession, sf: str) -> DataFrame:
    """F18, F19, F21."""
    k = c("p_partkey")
    aka = F.array(F.concat(c("p_name"), F.lit(" Street")), F.concat(F.upper("p_name"), F.lit(" ST")), F.concat(c("p_name"), F.lit(" Avenue")), c("p_name"))
    p = X.read(spark, sf, "part").select(k.alias("id"), F.array_join(N.alt_names(c("p_name"), aka), "|").alias("others"), N.clean_city(F.concat(c("p_name"), F.when(k % 2 == 0, " city").otherwise(" CDP"))).alias("city"), N.map_link("https://maps.example/search", k.cast("double") / 4, -k.cast("double") / 8, F.when(k % 3 == 0, F.concat(F.lit("a b"), k.cast("string")))).alias("link"))
    return p


def coordinate_texts(spark: SparkSession, sf: str) -> DataFrame:
    """F8: coordinates written in several ways, read again."""
    k = c("s_suppkey")
    la, lo = F.round(X.lat(k), 4).cast("string"), F.round(-X.lon(k), 4).cast("string")
    text = F.get(F.array(F.concat(la, F.lit(", -"), lo), F.concat(la, F.lit("° N, "), lo, F.lit("° W")), F.concat(F.lit("W "), lo, F.lit(" N "), la), F.concat(la, F.lit("\t-"), lo), F.concat(F.lit("about "), la), F.concat(F.lit("N 95 W "), lo)), (k % 6).cast("int"))
    p = X.read(spark, sf, "supplier").select(k.alias("id"), geo.clean_coordinates(text).alias("p"))
    return p.select("id", F.coalesce("p.lat", F.lit(0.0)).alias("lat"), F.coalesce("p.lon", F.lit(0.0)).alias("lon"))


def peaks(spark: SparkSession, sf: str) -> DataFrame:
    """P23, T5."""
    s = X.stations(spark, sf).select(N.peak_class((c("elevation") * 2).cast("string"), c("name")).alias("kind"))
    return s.groupBy(F.coalesce("kind", F.lit("-")).alias("kind")).agg(F.count("*").alias("n"))


def month_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Order months by region of the customer, this half against the other."""
    o = X.read(spark, sf, "orders")
    d = o.groupBy((c("o_custkey") % 40).alias("region")).agg(F.date_format(F.max("o_orderdate"), "M/d/yyyy").alias("date"))
    b = o.where("o_orderkey % 7 <> 0").groupBy((c("o_custkey") % 41).alias("region")).agg(F.date_format(F.max("o_orderdate"), "M/d/yyyy").alias("date"))
    return A.drift(d, b).select("region", "status", F.coalesce("was", F.lit("-")).alias("was"), F.coalesce("is", F.lit("-")).alias("is"))


def _log(spark: SparkSession, sf: str) -> DataFrame:
    e = c("event_id")
    q = F.floor(e / 4) % 50
    action = F.when(e % 4 == 0, "add").when(e % 4 == 1, "toggle").when(e % 12 == 2, "delete").when(e % 4 == 2, "veto").otherwise("toggle")
    return X.read(spark, sf, "events").select(c("user_id").alias("game_id"), q.alias("question_id"), "ts", e.alias("seq"), action.alias("action"))


def log_fold(spark: SparkSession, sf: str) -> DataFrame:
    """X1."""
    return logs.fold_log(_log(spark, sf))


def dataset_checks(spark: SparkSession, sf: str) -> DataFrame:
    """V3, U5."""
    s = X.stations(spark, sf)
    rules = {"has county": c("county").isNotNull(), "in box": c("lat").between(37.0, 38.2), "name length": c("name_length") > 8, "has a line": F.size("lines") > 0}
    out = A.checks(s, rules, ["station_id", "city"])
    lost = A.subset_check(s, s.where("station_id % 2 = 0"), "county").agg(F.count("*").alias("violations")).select(F.lit("counties").alias("name"), "violations")
    return out.unionByName(lost)


def county_probes(spark: SparkSession, sf: str) -> DataFrame:
    """A12."""
    return A.county_probes(X.stations(spark, sf))


def weekend_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that run at weekends."""
    s = X.stations(spark, sf).select("station_id", F.transform("lines", lambda x: F.when(x == "L3", Q.WEEKDAY_ONLY_LINES[0]).otherwise(x)).alias("lines"))
    out = s.withColumn("lines", F.array_except("lines", F.array(*[F.lit(x) for x in Q.WEEKDAY_ONLY_LINES])))
    return out.select("station_id", F.array_join("lines", ",").alias("lines"))


def deck_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as cards with the sizes they are for."""
    from placewright.operators.places import deck

    k = c("p_partkey")
    sizes = F.when(k % 3 == 0, F.array(F.lit("small"), F.lit("medium"))).when(k % 3 == 1, F.array(F.lit("large"))).otherwise(F.array(F.lit("medium"), F.lit("large")))
    cards = X.read(spark, sf, "part").select(k.alias("card"), c("p_brand").alias("kind"), sizes.alias("sizes"))
    return deck(cards, "medium").groupBy("kind").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    html_line_pattern, page_lines, section_fill, name_rules, line_rules, system_labels, other_names, coordinate_texts, peaks, month_labels, log_fold, dataset_checks, county_probes, weekend_lines, deck_cards,
)}

_LINES = r"""l AS (SELECT page_id, unnest(w) AS line, generate_subscripts(w, 1) AS i FROM (SELECT page_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)\s*>', ' ', 'g'), '<[^>]*>', chr(10), 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS w FROM pages)),
 n AS (SELECT page_id, line, i AS no FROM l)"""
ORACLE_SQL = {
    "html_line_pattern": f"WITH {_LINES}, p AS (SELECT *, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c FROM n WINDOW w AS (PARTITION BY page_id ORDER BY no)) SELECT regexp_replace(line, ',\\s*$', '') AS name, arg_min(b, (page_id, no)) AS city FROM p WHERE line LIKE '%,' AND contains(c, 'e') GROUP BY 1",
    "page_lines": f"WITH {_LINES} SELECT page_id, count(*) AS lines, max(length(line)) AS longest FROM l GROUP BY page_id",
    "section_fill": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents),
 m AS (SELECT *, regexp_full_match(line, '\S+') AS h, regexp_full_match(line, '\S+ \S+') AS s FROM l), w AS (SELECT *, last_value(CASE WHEN h THEN '' WHEN s THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY no) AS section FROM m)
 SELECT doc_id, count(*) AS n, count(DISTINCT section) AS sections, min(no)::BIGINT AS first_no FROM w WHERE NOT h AND NOT s AND section <> '' GROUP BY doc_id""",
    "system_labels": f"WITH {SQL_STATIONS}, o AS (SELECT ['BART', 'Caltrain', 'VTA', 'Muni', 'SFO AirTrain'] AS o) SELECT station_id, list_filter(o, lambda x: list_contains(systems, x))[1] AS primary, len(systems) > 1 AS several, array_to_string(lines, ', ') AS label FROM stations, o",
    "coordinate_texts": f"SELECT s_suppkey AS id, CASE WHEN s_suppkey % 6 < 4 THEN round({X.sql_lat('s_suppkey')}, 4) ELSE 0 END AS lat, CASE WHEN s_suppkey % 6 < 4 THEN round({X.sql_lon('s_suppkey')}, 4) ELSE 0 END AS lon FROM supplier",
    "peaks": f"WITH {SQL_STATIONS} SELECT CASE WHEN elevation IS NULL THEN '-' WHEN elevation * 2 * 3.280839895e0 >= 1500 THEN 'peak' ELSE 'minor' END AS kind, count(*) AS n FROM stations GROUP BY 1",
    "month_labels": """WITH a AS (SELECT o_custkey % 40 AS region, strftime(max(o_orderdate), '%b %Y') AS m FROM orders GROUP BY 1), b AS (SELECT o_custkey % 41 AS region, strftime(max(o_orderdate), '%b %Y') AS m FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1)
 SELECT coalesce(a.region, b.region) AS region, CASE WHEN b.m IS NULL THEN 'new' WHEN a.m IS NULL THEN 'REMOVED' WHEN a.m = b.m THEN 'same' ELSE 'CHANGED' END AS status, coalesce(b.m, '-') AS was, coalesce(a.m, '-') AS is FROM a FULL JOIN b ON a.region = b.region""",
    "log_fold": """WITH l AS (SELECT user_id AS g, (event_id // 4) % 50 AS q, ts, event_id AS seq, CASE WHEN event_id % 4 = 0 THEN 'add' WHEN event_id % 4 = 1 THEN 'toggle' WHEN event_id % 12 = 2 THEN 'delete' WHEN event_id % 4 = 2 THEN 'veto' ELSE 'toggle' END AS action FROM events),
 b AS (SELECT g, q, max((ts, seq)) FILTER (action = 'add') AS a, max((ts, seq)) FILTER (action = 'delete') AS d FROM l GROUP BY ALL), k AS (SELECT * FROM b WHERE a IS NOT NULL AND (d IS NULL OR d < a))
 SELECT k.g AS game_id, k.q AS question_id, count(*) FILTER (action = 'toggle' AND (ts, seq) > a) % 2 = 0 AS active, count(*) FILTER (action = 'veto' AND (ts, seq) > a) % 2 = 1 AS vetoed FROM k JOIN l ON l.g = k.g AND l.q = k.q GROUP BY k.g, k.q""",
    "dataset_checks": f"""WITH {SQL_STATIONS} SELECT 'has county' AS name, count(*) FILTER (county IS NULL) AS violations FROM stations UNION ALL SELECT 'in box', count(*) FILTER (NOT lat BETWEEN 37.0 AND 38.2) FROM stations UNION ALL SELECT 'name length', count(*) FILTER (name_length <= 8) FROM stations
 UNION ALL SELECT 'has a line', 0 UNION ALL SELECT 'unique station_id', 0 UNION ALL SELECT 'unique city', count(*) FROM (SELECT city FROM stations GROUP BY city HAVING count(*) > 1) UNION ALL SELECT 'counties', count(DISTINCT county) FILTER (county NOT IN (SELECT county FROM stations WHERE station_id % 2 = 0 AND county IS NOT NULL)) FROM stations""",
    "county_probes": f"WITH {SQL_STATIONS}, m AS (SELECT county, avg(lat) AS a, avg(lon) AS o FROM stations WHERE county IS NOT NULL GROUP BY county) SELECT s.county, arg_min(station_id, (pow(lat - a, 2) + pow(lon - o, 2), station_id)) AS station_id FROM stations s JOIN m USING (county) GROUP BY s.county",
    "weekend_lines": f"WITH {SQL_STATIONS} SELECT station_id, array_to_string(list_filter(lines, lambda x: x <> 'L3'), ',') AS lines FROM stations",
    "deck_cards": "SELECT p_brand AS kind, count(*) AS n FROM part WHERE p_partkey % 3 <> 1 GROUP BY 1",
    "line_rules": """WITH r AS (SELECT c_custkey AS id, ['SFMTA', 'Bay Area Rapid Transit', 'Caltrain', 'Santa Clara Valley', 'x'][1 + c_custkey % 5] AS op, ['', 'Muni', 'AirTrain'][1 + c_custkey % 3] AS net, ['N', '', 'Red'][1 + c_custkey % 3] AS ref, ['Green', 'Local'][1 + c_custkey % 2] AS nm, c_custkey % 2 = 1 AS cable, ['', '#ff0000', '#00ff00', NULL][1 + c_custkey % 4] AS tag FROM customer),
 s AS (SELECT *, CASE WHEN cable THEN NULL WHEN op LIKE 'Bay%' THEN 'BART' WHEN op = 'Caltrain' THEN 'Caltrain' WHEN op LIKE 'Santa%' THEN 'VTA' WHEN op = 'SFMTA' OR net = 'Muni' THEN 'Muni' WHEN net = 'AirTrain' THEN 'SFO AirTrain' END AS system FROM r)
 SELECT id, coalesce(system, '-') AS system, coalesce(system, 'X') || ' ' || CASE WHEN ref <> '' THEN ref ELSE nm END AS line, CASE WHEN coalesce(tag, '') = '' THEN '#888888' WHEN tag = '#ff0000' THEN '#d4001a' ELSE tag END AS colour FROM s""",
    "other_names": "SELECT p_partkey AS id, p_name || ' St|' || p_name || ' Ave' AS others, p_name AS city, 'https://maps.example/search?api=1&query=' || (p_partkey::DOUBLE / 4) || '%2C' || (-p_partkey::DOUBLE / 8) || CASE WHEN p_partkey % 3 = 0 THEN '&query_place_id=a+b' || p_partkey ELSE '' END AS link FROM part",
}

_NAMED = "q AS (SELECT p_partkey AS id, p_name || ' ' || ['Park', '& Co. Entrance', '(Main)', '12 Building B', 'Library: East'][1 + p_partkey % 5] AS name FROM part)"
ORACLE_SQL["name_rules"] = rf"""WITH {_NAMED} SELECT id, trim(regexp_replace(regexp_replace(replace(lower(name), '&', ' and '), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS norm,
 array_to_string({shapes._DIST}, ' ') AS words, {shapes._SUB} AS sub, regexp_matches(name, '[:|]') OR regexp_matches(trim(name), '\([^)]*\)\s*$') AS qualified, length(name) AS len FROM q"""
