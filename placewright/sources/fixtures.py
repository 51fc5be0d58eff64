"""Geography and games derived from the driver tables by integer arithmetic, in Spark and as DuckDB SQL alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: name -> lat, lon of the airports whose distances stations carry.
AIRPORTS = {"SFO": (37.6213, -122.379), "OAK": (37.7126, -122.2197), "SJC": (37.3639, -121.9289)}
KINDS = ("radar", "thermometer", "match-county", "match-city", "match-airport", "match-namelength", "match-line", "measure-airport", "measure-sealevel")


def lat(key: Column, m: int = 7919) -> Column:
    return F.lit(37.2) + F.pmod(key * m, F.lit(10007)) / F.lit(10007.0)


def lon(key: Column, m: int = 104729) -> Column:
    return F.lit(-122.5) + F.pmod(key * m, F.lit(10009)) / F.lit(10009.0)


def sql_lat(key: str, m: int = 7919) -> str:
    return f"(37.2e0 + (({key}) * {m}) % 10007 / 10007.0e0)"


def sql_lon(key: str, m: int = 104729) -> str:
    return f"(-122.5e0 + (({key}) * {m}) % 10009 / 10009.0e0)"


def sql_hav(a: str, b: str, c: str, d: str) -> str:
    """Metres between (a, b) and (c, d) in SQL."""
    return (
        f"(2 * 6371000.0e0 * asin(sqrt(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians(({d}) - ({b})) / 2), 2))))"
    )


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations from customers: id, name, lat, lon, county, city, elevation, name_length, lines, systems, headway, service."""
    k = F.col("c_custkey")
    systems = F.array(*[F.lit(s) for s in ("BART", "Caltrain", "VTA", "Muni", "SFO AirTrain")])
    first, second = F.pmod(k, F.lit(5)).cast("int"), F.pmod(k * 3, F.lit(5)).cast("int")
    return read(spark, sf_dir, "customer").select(
        k.alias("station_id"),
        F.col("c_name").alias("name"),
        lat(k).alias("lat"),
        lon(k).alias("lon"),
        F.when(k % 17 != 0, F.concat(F.lit("C"), (F.col("c_nationkey") % 5).cast("string"))).alias("county"),
        F.when(k % 13 != 0, F.col("c_mktsegment")).alias("city"),
        F.when(k % 19 != 0, F.col("c_acctbal") / 20).alias("elevation"),
        (F.lit(8) + k % 23).cast("int").alias("name_length"),
        F.array_distinct(F.array(F.concat(F.lit("L"), (k % 7).cast("string")), F.concat(F.lit("L"), (k % 11).cast("string")))).alias("lines"),
        F.array_distinct(F.array(F.get(systems, first), F.get(systems, F.when(k % 4 == 0, second).otherwise(first)))).alias("systems"),
        ((k * 37) % 70).cast("double").alias("headway_wd"),
        ((k * 41) % 80).cast("double").alias("headway_we"),
        (k % 9 != 0).alias("served_wd"),
        (k % 5 != 0).alias("hourly_wd"),
    )


SQL_STATIONS = f"""stations AS (SELECT c_custkey AS station_id, c_name AS name, {sql_lat('c_custkey')} AS lat, {sql_lon('c_custkey')} AS lon,
  CASE WHEN c_custkey % 17 <> 0 THEN 'C' || (c_nationkey % 5) END AS county, CASE WHEN c_custkey % 13 <> 0 THEN c_mktsegment END AS city,
  CASE WHEN c_custkey % 19 <> 0 THEN c_acctbal / 20 END AS elevation, (8 + c_custkey % 23)::INT AS name_length,
  CASE WHEN c_custkey % 7 = c_custkey % 11 THEN ['L' || (c_custkey % 7)] ELSE ['L' || (c_custkey % 7), 'L' || (c_custkey % 11)] END AS lines,
  CASE WHEN c_custkey % 4 = 0 AND c_custkey % 5 <> (c_custkey * 3) % 5 THEN [sys[1 + c_custkey % 5], sys[1 + (c_custkey * 3) % 5]] ELSE [sys[1 + c_custkey % 5]] END AS systems,
  ((c_custkey * 37) % 70)::DOUBLE AS headway_wd, ((c_custkey * 41) % 80)::DOUBLE AS headway_we, c_custkey % 9 <> 0 AS served_wd, c_custkey % 5 <> 0 AS hourly_wd
 FROM customer, (SELECT ['BART', 'Caltrain', 'VTA', 'Muni', 'SFO AirTrain'] AS sys))"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions from events, eight games for each user: wide params, one row a question."""
    e = F.col("event_id")
    rows = read(spark, sf_dir, "events")
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), (e % 9).cast("int"))
    yes = e % 2 == 0
    value = (
        F.when(kind == "match-county", F.concat(F.lit("C"), (e % 5).cast("string")))
        .when(kind == "match-city", F.get(F.array(*[F.lit(x) for x in ("BUILDING", "AUTOMOBILE", "MACHINERY")]), (e % 3).cast("int")))
        .when(kind == "match-airport", F.get(F.array(*[F.lit(x) for x in AIRPORTS]), (e % 3).cast("int")))
        .when(kind == "match-namelength", (F.lit(8) + e % 23).cast("string"))
        .when(kind == "match-line", F.concat(F.lit("L"), (e % 11).cast("string")))
        .when(kind == "measure-sealevel", (e % 400).cast("string"))
    )
    answer = (
        F.when(kind == "thermometer", F.when(yes, "hotter").otherwise("colder"))
        .when(kind.startswith("measure"), F.when(yes, "closer").otherwise("further"))
        .otherwise(F.when(yes, "yes").otherwise("no"))
    )
    return rows.select(
        (F.col("user_id") * 8 + e % 8).alias("game_id"),
        e.alias("question_id"),
        kind.alias("kind"),
        F.col("ts").alias("created_at"),
        lat(e, 6151).alias("lat"),
        lon(e, 7537).alias("lon"),
        lat(e, 3571).alias("to_lat"),
        lon(e, 2741).alias("to_lon"),
        (F.lit(5) * (1 + e % 9)).cast("double").alias("radius_miles"),
        F.when(e % 4 == 0, F.get(F.array(F.lit(0.5), F.lit(3.0), F.lit(10.0)), (e % 3).cast("int"))).alias("thermometer_miles"),
        value.alias("value"),
        answer.alias("answer"),
        F.lit(True).alias("eliminates"),
        (e % 10 != 3).alias("active"),
        (e % 14 == 5).alias("vetoed"),
    )


_SQL_KINDS = "[" + ", ".join(f"'{x}'" for x in KINDS) + "]"
SQL_QUESTIONS = f"""questions AS (SELECT *, CASE kind WHEN 'match-county' THEN 'C' || (question_id % 5) WHEN 'match-city' THEN ['BUILDING', 'AUTOMOBILE', 'MACHINERY'][1 + question_id % 3]
   WHEN 'match-airport' THEN ['SFO', 'OAK', 'SJC'][1 + question_id % 3] WHEN 'match-namelength' THEN (8 + question_id % 23)::VARCHAR WHEN 'match-line' THEN 'L' || (question_id % 11)
   WHEN 'measure-sealevel' THEN (question_id % 400)::VARCHAR END AS value,
  CASE WHEN kind = 'thermometer' THEN CASE WHEN question_id % 2 = 0 THEN 'hotter' ELSE 'colder' END WHEN kind LIKE 'measure%' THEN CASE WHEN question_id % 2 = 0 THEN 'closer' ELSE 'further' END
   ELSE CASE WHEN question_id % 2 = 0 THEN 'yes' ELSE 'no' END END AS answer
 FROM (SELECT user_id * 8 + event_id % 8 AS game_id, event_id AS question_id, {_SQL_KINDS}[1 + event_id % 9] AS kind, ts AS created_at, {sql_lat('event_id', 6151)} AS lat, {sql_lon('event_id', 7537)} AS lon,
  {sql_lat('event_id', 3571)} AS to_lat, {sql_lon('event_id', 2741)} AS to_lon, (5 * (1 + event_id % 9))::DOUBLE AS radius_miles,
  CASE WHEN event_id % 4 = 0 THEN [0.5, 3.0, 10.0][1 + event_id % 3]::DOUBLE END AS thermometer_miles, true AS eliminates, event_id % 10 <> 3 AS active, event_id % 14 = 5 AS vetoed FROM events))"""


def pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of interest from parts: category of five, name, reviews, status, place."""
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        k.alias("poi_id"),
        F.get(F.array(*[F.lit(c) for c in ("park", "museum", "library", "hospital", "zoo")]), (k % 5).cast("int")).alias("category"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("primary_type"),
        F.col("p_size").cast("int").alias("reviews"),
        F.when(k % 11 == 0, "CLOSED_PERMANENTLY").when(k % 7 == 0, F.lit(None)).when(k % 13 == 0, "CLOSED_TEMPORARILY").otherwise("OPERATIONAL").alias("status"),
        lat(k, 4409).alias("lat"),
        lon(k, 6277).alias("lon"),
    )


SQL_POIS = f"""pois AS (SELECT p_partkey AS poi_id, ['park', 'museum', 'library', 'hospital', 'zoo'][1 + p_partkey % 5] AS category, p_name AS name, p_type AS primary_type, p_size::INT AS reviews,
  CASE WHEN p_partkey % 11 = 0 THEN 'CLOSED_PERMANENTLY' WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN 'CLOSED_TEMPORARILY' ELSE 'OPERATIONAL' END AS status,
  {sql_lat('p_partkey', 4409)} AS lat, {sql_lon('p_partkey', 6277)} AS lon FROM part)"""


def line_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polylines of twenty suppliers each, so that their number grows with the table: line, seq, lat, lon."""
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(F.floor(k / 20).alias("line"), k.alias("seq"), lat(k, 7127).alias("lat"), lon(k, 8243).alias("lon"))


SQL_VERTICES = f"vertices AS (SELECT s_suppkey // 20 AS line, s_suppkey AS seq, {sql_lat('s_suppkey', 7127)} AS lat, {sql_lon('s_suppkey', 8243)} AS lon FROM supplier)"


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hexagon per nation, with a square hole in every third: region_id, rings array<array<struct<lon, lat>>>."""
    k = F.col("n_nationkey").cast("long")
    clat, clon = lat(k * 40 + 7, 7919), lon(k * 40 + 7, 104729)
    hexagon = F.array(*[F.struct((clon + dx).alias("lon"), (clat + dy).alias("lat")) for dx, dy in HEX])
    hole = F.array(*[F.struct((clon + dx).alias("lon"), (clat + dy).alias("lat")) for dx, dy in HOLE])
    rings = F.when(k % 3 == 0, F.array(hexagon, hole)).otherwise(F.array(hexagon))
    return read(spark, sf_dir, "nation").select(k.alias("region_id"), rings.alias("rings"))


HEX = ((0.12, 0.0), (0.06, 0.1), (-0.06, 0.1), (-0.12, 0.0), (-0.06, -0.1), (0.06, -0.1))
HOLE = ((0.03, 0.03), (-0.03, 0.03), (-0.03, -0.03), (0.03, -0.03))


def _sql_ring(n: str, ring: int, pts: tuple) -> str:
    rows = []
    for i, (dx, dy) in enumerate(pts):
        ex, ey = pts[(i + 1) % len(pts)]
        rows.append(f"SELECT region_id, {ring} AS ring, {i} AS i, clon + ({dx}e0) AS x1, clat + ({dy}e0) AS y1, clon + ({ex}e0) AS x2, clat + ({ey}e0) AS y2 FROM {n}")
    return " UNION ALL ".join(rows)


SQL_EDGES = f"""centres AS (SELECT n_nationkey::BIGINT AS region_id, {sql_lat('n_nationkey::BIGINT * 40 + 7')} AS clat, {sql_lon('n_nationkey::BIGINT * 40 + 7')} AS clon FROM nation),
 holed AS (SELECT * FROM centres WHERE region_id % 3 = 0), edges AS ({_sql_ring('centres', 0, HEX)} UNION ALL {_sql_ring('holed', 1, HOLE)})"""
