"""Queries on polylines, regions and place resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.functions import geo
from placewright.functions import names as N
from placewright.operators import lines as L
from placewright.operators import regions as R
from placewright.operators import resolve as E
from placewright.operators import runs
from placewright.plans.tables import written
from placewright.sources import fixtures as X
from placewright.sources.fixtures import SQL_EDGES, SQL_STATIONS, SQL_VERTICES, sql_hav, sql_lat, sql_lon

c = F.col


def _planar(a: str, b: str, d: str, e: str) -> str:
    return f"sqrt(pow(({e} - {b}) * 111320.0e0 * cos(radians(37.7e0)), 2) + pow(({d} - {a}) * 110540.0e0, 2))"


def line_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """W5, A13, L4."""
    out = L.lengths(L.without_strays(X.line_vertices(spark, sf), 800.0))
    return out.select("line", F.round("length_m", 1).alias("length_m"), "vertices")


def snap_to_line(spark: SparkSession, sf: str) -> DataFrame:
    """Stations to polylines of their system, within 3 km, moved from 300 m on."""
    v = X.line_vertices(spark, sf).withColumn("system", F.get(F.array(*[F.lit(s) for s in N.SYSTEM_ORDER]), (c("line") % 5).cast("int")))
    s = X.stations(spark, sf).select("station_id", c("systems")[0].alias("system"), "lat", "lon")
    out = L.snap_to_lines(s, v, 300.0, 3000.0)
    return out.select("station_id", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), F.round("d", 1).alias("d"), "moved").where("d is not null")


def offset_lines(spark: SparkSession, sf: str) -> DataFrame:
    """L1, L2: three colours side by side; the middle vertex of each."""
    w = L.coords_of(X.line_vertices(spark, sf)).select(c("line").alias("way_id"), "coords", F.array(F.lit("r"), F.lit("y"), F.lit("g")).alias("colors"))
    out = L.interline(w.where(F.size("coords") > 2))
    return out.select("way_id", "color", F.size("coords").cast("long").alias("n"), F.round(c("coords")[1]["lat"], 7).alias("lat"), F.round(c("coords")[1]["lon"], 7).alias("lon"))


def clipped_lines(spark: SparkSession, sf: str) -> DataFrame:
    """L6."""
    return L.clip_at(X.line_vertices(spark, sf), 37.7, -122.0).groupBy("line").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def chain_groups(spark: SparkSession, sf: str) -> DataFrame:
    """L3: ways from parts, in five groups, linked where ends are within 900 m."""
    k = c("p_partkey")
    w = X.read(spark, sf, "part").select(k.alias("way_id"), (k % 5).alias("grp"), X.lat(k, 4409).alias("alat"), X.lon(k, 6277).alias("alon"), X.lat(k, 5981).alias("blat"), X.lon(k, 9001).alias("blon"))
    return L.chains(w, 900.0).groupBy("chain").agg(F.count("*").alias("ways"))


def covered_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Each line with two shorter copies, the second one beside the first only, which goes on every other line."""
    v = X.line_vertices(spark, sf).select(c("line").alias("grp"), "seq", "lat", "lon")
    shift = lambda first, second: F.when(c("grp") % 2 == 0, first).otherwise(second)
    copies = [(0, 20, F.lit(0.0)), (1, 15, shift(0.0005, 0.05)), (2, 10, shift(0.0016, 0.0495))]
    parts = [v.where(c("seq") % 20 < n).select((c("grp") * 3 + k).alias("line"), "grp", "seq", (c("lat") + d).alias("lat"), "lon") for k, n, d in copies]
    return L.covered_chains(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return X.stations(spark, sf).select(c("station_id").alias("id"), "lat", "lon")


def point_in_region(spark: SparkSession, sf: str) -> DataFrame:
    """Stations in hexagons with holes."""
    return R.points_in_regions(_points(spark, sf), X.regions(spark, sf))


def point_in_region_tree(spark: SparkSession, sf: str) -> DataFrame:
    """J6 by the quadtree of the regions: full cells by equality, sides only in partial leaves."""
    return R.points_in_regions(_points(spark, sf), X.regions(spark, sf), tree=True)


def region_clip_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Parks in the first ten regions, other places in all."""
    r = X.regions(spark, sf)
    return R.clip(X.pois(spark, sf), r.where("region_id < 10"), r, ["park"]).groupBy("category").agg(F.count("*").alias("n"))


def region_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """A14, F24."""
    r = X.regions(spark, sf)
    b = R.boxes(r).join(r.select("region_id", geo.polygon_area_m2(c("rings")).alias("m2")), "region_id")
    return b.select("region_id", F.round("w", 6).alias("w"), F.round("e", 6).alias("e"), F.round("s", 6).alias("s"), F.round("n", 6).alias("n"), F.round(c("m2") / 1e6, 3).alias("km2"))


def cover_algebra(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of three groups of regions, their union, difference and intersection."""
    cv = R.cover(X.regions(spark, sf), 0.02)
    a, b = cv.where("region_id % 2 = 0"), cv.where("region_id % 3 = 0")
    parts = [("union", R.union(a, b)), ("difference", R.difference(R.union(a), b)), ("intersection", R.intersection(R.union(a), b))]
    out = None
    for n, df in parts:
        g = df.agg(F.count("*").alias("n"), F.sum("cx").alias("sx"), F.sum("cy").alias("sy")).withColumn("what", F.lit(n))
        out = g if out is None else out.unionByName(g)
    return out


def fill_holes(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of stations, widened; these with holes filled, with small holes filled, with small parts dropped: counts."""
    cells = _points(spark, sf).select(F.floor(c("lon") / 0.02).cast("long").alias("cx"), F.floor(c("lat") / 0.02).cast("long").alias("cy")).where("(cx + cy) % 3 <> 0").distinct()
    wide = written(R.buffer(cells.where("(cx * 7 + cy) % 11 = 0"), 4000.0, 0.02, 37.7), "wide")
    parts = [("cells", cells), ("wide", wide), ("filled", R.fill_holes(wide)), ("small_filled", R.fill_holes(wide, 2)), ("parts", R.filter_parts(wide, 15, res=0.02))]
    out = None
    for n, df in parts:
        g = df.agg(F.count("*").alias("n")).withColumn("what", F.lit(n))
        out = g if out is None else out.unionByName(g)
    return out


def enclosed_holes(spark: SparkSession, sf: str) -> DataFrame:
    """R1, R2, R4, R5 on runs: what regions with a hole enclose, the small holes filled alone, and stations' cells in the holes."""
    r = X.regions(spark, sf)
    cells = written(runs.union(runs.from_edges(R.edges_of(r.where("region_id % 3 = 0")), 0.02)), "runs")
    own = runs.from_cells(_points(spark, sf).select(F.floor(c("lon") / 0.02).cast("long").alias("cx"), F.floor(c("lat") / 0.02).cast("long").alias("cy")))
    h = written(runs.holes(cells), "holes")
    each = {"cells": cells, "holes": h, "filled": runs.fill_holes(cells), "small_filled": runs.fill_holes(cells, 10), "stations": runs.intersection(own, h), "free": runs.difference(h, own), "parts": runs.filter_parts(cells, 60, res=0.02)}
    out = None
    for n, df in each.items():
        w = c("x1") - c("x0") + 1
        g = df.agg(F.coalesce(F.sum(w), F.lit(0)).alias("n"), F.coalesce(F.sum((c("x0") + c("x1")) * w / 2).cast("long"), F.lit(0).cast("long")).alias("sx"), F.coalesce(F.sum(c("cy") * w), F.lit(0)).alias("sy")).withColumn("what", F.lit(n))
        out = g if out is None else out.unionByName(g)
    return out


def gap_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of suppliers below zero balance on each line."""
    v = X.read(spark, sf, "supplier").select(F.floor(c("s_suppkey") / 20).alias("line"), c("s_suppkey").alias("pos"), (c("s_acctbal") > 2000).alias("covered"))
    return R.gap_runs(v)


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of twenty suppliers each, sampled every 2 km: their number grows with the table."""
    k = c("s_suppkey")
    v = X.read(spark, sf, "supplier").select(F.floor(k / 20).alias("line"), k.alias("seq"), X.lat(k, 7127).alias("lat"), X.lon(k, 8243).alias("lon"))
    return L.resampled(v, 2000.0)


def resampled_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Samples along lines."""
    return _samples(spark, sf).select("line", "pos", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def bridge_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Corridors where lines leave the regions and come back within 12 miles, 1.6 miles wide to either side."""
    area = written(R.cover(X.regions(spark, sf), 0.02).select("cx", "cy").distinct(), "area")
    return R.bridges(written(_samples(spark, sf), "samples"), area, 0.02, 2000.0, half_miles=1.6)


def county_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Regions against stripes of longitude."""
    cv = R.cover(X.regions(spark, sf), 0.02).withColumnRenamed("region_id", "place_id")
    stripes = cv.select("cx", "cy").distinct().select(F.floor(c("cx") / 9).cast("string").alias("county"), "cx", "cy")
    return R.largest_overlap(cv, stripes).select("place_id", "county", F.round("share", 6).alias("share"))


def pruned_places(spark: SparkSession, sf: str) -> DataFrame:
    """Isolated loose regions dropped, and what carving them leaves."""
    cv = R.cover(X.regions(spark, sf), 0.02)
    own = cv.groupBy("cx", "cy").agg(F.min("region_id").alias("place_id"))
    kept = R.prune_isolated(own, own.where("place_id % 2 = 0").select("place_id").distinct())
    gone = own.join(kept.select("place_id").distinct(), "place_id", "left_anti")
    left = R.carve(R.union(own.where("place_id < 15")), gone)
    return kept.select("place_id").distinct().withColumn("what", F.lit("kept")).unionByName(left.agg(F.count("*").alias("place_id")).withColumn("what", F.lit("cells")))


def adaptive_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles of under 20 stations."""
    t = R.adaptive_tiles(_points(spark, sf))
    return t.groupBy("level").agg(F.count("*").alias("tiles"), F.sum("n").alias("points"), F.max("n").alias("most"))


def boxes_on_region(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes around the stations that touch a region."""
    t = X.stations(spark, sf).select(c("station_id").alias("tile"), (c("lon") - 0.025).alias("w"), (c("lon") + 0.025).alias("e"), (c("lat") - 0.02).alias("s"), (c("lat") + 0.02).alias("n"))
    return R.boxes_on_region(t, X.regions(spark, sf)).select("tile")


def pins(spark: SparkSession, sf: str) -> DataFrame:
    """Pins from parts: groups of eight around an anchor 0 to 800 m away, with names that share words with it."""
    k = c("p_partkey")
    g, i = F.floor(k / 8), (k % 8).cast("int")
    tail = F.get(F.array(*[F.lit(x) for x in ("", " Park", " Parking Garage", " Dog Park", " Medical Center", " Entrance", " - North", " Hospital Building B")]), i)
    step = F.get(F.array(*[F.lit(x) for x in (0.0, 40.0, 120.0, 250.0, 330.0, 480.0, 650.0, 800.0)]), i)
    word = lambda p: F.concat(F.lit("Zor"), ((g * 7) % 97).cast("string"), F.lit("el "), p)
    name = F.concat(word(F.split("p_name", " ")[0]), tail)
    cat = F.get(F.array(F.lit("park"), F.lit("hospital"), F.lit("museum")), (g % 3).cast("int"))
    return X.read(spark, sf, "part").select(k.alias("pin"), cat.alias("category"), name.alias("name"), (X.lat(g, 4409) + step / 110540.0).alias("lat"), X.lon(g, 6277).alias("lon"), (c("p_size") * F.when(i == 0, 9).otherwise(1)).cast("int").alias("reviews"), F.when(k % 41 == 0, "CLOSED_PERMANENTLY").otherwise("OPERATIONAL").alias("status"))


def _resolved(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = pins(spark, sf)
    pair = lambda i, j: p.where(c("pin") % 8 == i).select("category", c("pin").alias("child"), (c("pin") + (j - i)).alias("parent"), c("pin").alias("ord")).where("child % 5 = 0")
    sep = p.where("pin % 16 = 1").select(c("pin").alias("a"), (c("pin") - 1).alias("b"))
    cov = p.where("pin % 8 in (0, 3, 6)").select("pin", F.floor(c("pin") / 8).alias("fid"), F.lit("Big Park").alias("fname"), F.lit(1e-4).alias("area"), F.lit(1.0e6).alias("m2")).where("fid % 4 = 0")
    return E.resolve_pois(p, cov, pair(6, 0), sep, p.where("pin % 101 = 0").select("pin"))


def resolve_pois_kept(spark: SparkSession, sf: str) -> DataFrame:
    """E14."""
    return _resolved(spark, sf)[0].select("pin", "category")


def resolve_edges(spark: SparkSession, sf: str) -> DataFrame:
    """E4-E13."""
    return _resolved(spark, sf)[1]


def merge_rule_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """E4."""
    return E.merge_pairs(E.described(pins(spark, sf)))


def _separate(p: DataFrame, every: int = 16) -> DataFrame:
    return p.where(f"pin % {every} = 1").select(c("pin").alias("a"), (c("pin") - 1).alias("b"))


def merge_guarded(spark: SparkSession, sf: str) -> DataFrame:
    """E5: groups by the rules, with a separate pair in every other anchor's group."""
    p = written(E.described(pins(spark, sf)), "pins")
    return E.guarded_groups(written(E.merge_pairs(p), "pairs"), p, _separate(p))


def merge_eval(spark: SparkSession, sf: str) -> DataFrame:
    """V1: groups by the rules, half of the separate pairs being guarded, against groups by anchor."""
    p = written(E.described(pins(spark, sf)), "pins")
    auto = written(E.guarded_groups(written(E.merge_pairs(p), "pairs"), p, _separate(p, 32)), "auto")
    return E.evaluate(auto, p.where("not sub").select("pin", F.floor(c("pin") / 8).alias("grp")), _separate(p))


def pair_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """V2: each pin and the next one of its anchor."""
    p = pins(spark, sf)
    d = E.pair_diagnostics(p.where("pin % 8 < 7").select(c("pin").alias("a"), (c("pin") + 1).alias("b")), p)
    return d.select("a", "b", F.round("d", 3).alias("d"), F.array_join("shared", " ").alias("shared"), "sub")


def merged_children(spark: SparkSession, sf: str) -> DataFrame:
    """Pins chained to the one before them, by the first of the chain, most reviewed ones first."""
    p = pins(spark, sf)
    kids = E.children(p.where("pin % 8 > 0").select(c("pin").alias("child"), (c("pin") - 1).alias("parent")), p)
    return kids.select("rep", F.array_join(F.transform("kids", lambda k: F.concat_ws(":", k["pin"], k["name"])), "|").alias("kids"))


def override_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Every pin as a query, by its name, by part of it or with more words around it; some match nothing, some are pinned."""
    p = pins(spark, sf)
    k = c("pin")
    query = F.when(k % 9 == 0, F.concat(F.lit("Nowhere "), k.cast("string"))).when(k % 9 == 1, F.concat(F.lit("Old "), c("name"), F.lit(" West"))).when(k % 9 == 2, F.substring("name", 4, 9)).otherwise(F.upper("name"))
    at = lambda n: F.when(k % 5 == 0, c(n)).alias(n)
    o = p.select(k.alias("ord"), "category", query.alias("query"), at("lat"), at("lon"))
    got, missing = E.resolve_overrides(p, o)
    return got.select("ord", "pin").unionByName(missing.select("ord", F.lit(-1).cast("long").alias("pin")))


def parent_roots(spark: SparkSession, sf: str) -> DataFrame:
    """Chains of parts k -> k // 3."""
    from placewright.plans.graph import roots

    k = c("p_partkey")
    return roots(X.read(spark, sf, "part").select(k.alias("child"), F.floor(k / 3).alias("parent")).where("parent > 0"))


_SYS = "['BART', 'Caltrain', 'VTA', 'Muni', 'SFO AirTrain']"
_SEG = f"{SQL_VERTICES}, seg AS (SELECT *, lead(lat) OVER w AS blat, lead(lon) OVER w AS blon FROM vertices WINDOW w AS (PARTITION BY line ORDER BY seq))"
_IN = "count(*) FILTER (((y1 > p.lat) <> (y2 > p.lat)) AND p.lon < (x2 - x1) * (p.lat - y1) / (y2 - y1) + x1) % 2 = 1"
_COVER = f"""box AS (SELECT region_id, min(x1) AS w, max(x1) AS e, min(y1) AS s, max(y1) AS n FROM edges GROUP BY region_id),
 cells AS (SELECT region_id, cx, unnest(generate_series(floor(s / 0.02)::BIGINT, floor(n / 0.02)::BIGINT)) AS cy FROM (SELECT *, unnest(generate_series(floor(w / 0.02)::BIGINT, floor(e / 0.02)::BIGINT)) AS cx FROM box)),
 cov AS (SELECT p.region_id, cx, cy FROM (SELECT region_id, cx, cy, (cy + 0.5e0) * 0.02e0 AS lat, (cx + 0.5e0) * 0.02e0 AS lon FROM cells) p JOIN edges e ON e.region_id = p.region_id GROUP BY p.region_id, cx, cy, p.lat, p.lon HAVING {_IN})"""
_SNAP = f"""{SQL_STATIONS}, {_SEG}, p AS (SELECT station_id, s.lat, s.lon, g.lat AS alat, g.lon AS alon, blat, blon, 111320.0e0 * cos(radians(s.lat)) AS kx FROM stations s JOIN seg g ON s.systems[1] = {_SYS}[1 + line % 5] WHERE blat IS NOT NULL),
 q AS (SELECT *, (alon - lon) * kx AS ax, (alat - lat) * 110540.0e0 AS ay, (blon - alon) * kx AS dx, (blat - alat) * 110540.0e0 AS dy FROM p),
 t AS (SELECT *, greatest(0, least(1, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) AS t FROM q), h AS (SELECT *, ax + t * dx AS x, ay + t * dy AS y, sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2)) AS d FROM t)"""
_REACH = f"""WITH RECURSIVE w AS (SELECT p_partkey AS id, p_partkey % 5 AS g, {sql_lat('p_partkey', 4409)} AS lat, {sql_lon('p_partkey', 6277)} AS lon FROM part UNION ALL SELECT p_partkey, p_partkey % 5, {sql_lat('p_partkey', 5981)}, {sql_lon('p_partkey', 9001)} FROM part),
 e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM w a JOIN w b ON a.g = b.g AND abs(a.lat - b.lat) < 0.01 AND {_planar('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 900),
 walk(id, root) AS (SELECT id, id FROM w UNION SELECT e.b, walk.root FROM walk JOIN e ON e.a = walk.id) SELECT chain, count(*) AS ways FROM (SELECT id, min(root) AS chain FROM walk GROUP BY id) GROUP BY chain"""

QUERIES = {f.__name__: f for f in (
    line_lengths, snap_to_line, offset_lines, clipped_lines, chain_groups, covered_chains, point_in_region, point_in_region_tree, region_clip_counts, region_boxes, cover_algebra, fill_holes, enclosed_holes, gap_runs, resampled_lines, bridge_cells, county_overlap,
    pruned_places, adaptive_tiles, boxes_on_region, resolve_pois_kept, resolve_edges, merge_rule_pairs, merge_guarded, merge_eval, pair_diagnostics, merged_children, override_matches, parent_roots,
)}

ORACLE_SQL = {
    "fill_holes": f"""WITH RECURSIVE {SQL_STATIONS}, cells AS (SELECT DISTINCT cx, cy FROM (SELECT floor(lon / 0.02e0)::BIGINT AS cx, floor(lat / 0.02e0)::BIGINT AS cy FROM stations) WHERE (cx + cy) % 3 <> 0),
 beside AS (SELECT * FROM (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS v(i, j)), wide AS (SELECT DISTINCT cx + i AS cx, cy + j AS cy FROM cells, range(-3, 4) AS a(i), range(-3, 4) AS b(j)
  WHERE (cx * 7 + cy) % 11 = 0 AND pow(i * 0.02e0 * 111320.0e0 * cos(radians(37.7e0)), 2) + pow(j * 0.02e0 * 110540.0e0, 2) <= 16000000),
 frame AS (SELECT min(cx) - 1 AS x0, max(cx) + 1 AS x1, min(cy) - 1 AS y0, max(cy) + 1 AS y1 FROM wide),
 free AS (SELECT cx, cy, cx IN (x0, x1) OR cy IN (y0, y1) AS edge FROM (SELECT *, unnest(range(y0, y1 + 1)) AS cy FROM (SELECT *, unnest(range(x0, x1 + 1)) AS cx FROM frame)) f ANTI JOIN wide USING (cx, cy)),
 outer_cells AS (SELECT cx, cy FROM free WHERE edge UNION SELECT free.cx, free.cy FROM outer_cells o, beside, free WHERE free.cx = o.cx + i AND free.cy = o.cy + j),
 hole AS (SELECT cx, cy FROM free ANTI JOIN outer_cells USING (cx, cy)),
 both_kinds AS (SELECT 'hole' AS k, * FROM hole UNION ALL SELECT 'wide', * FROM wide),
 reach AS (SELECT k, cx AS ax, cy AS ay, cx, cy FROM both_kinds UNION SELECT r.k, ax, ay, o.cx, o.cy FROM reach r, beside, both_kinds o WHERE o.k = r.k AND o.cx = r.cx + i AND o.cy = r.cy + j),
 size AS (SELECT k, ax, ay, count(*) AS n FROM reach GROUP BY ALL), w AS (SELECT count(*) AS n FROM wide)
 SELECT count(*) AS n, 'cells' AS what FROM cells UNION ALL SELECT n, 'wide' FROM w UNION ALL SELECT n + (SELECT count(*) FROM hole), 'filled' FROM w
 UNION ALL SELECT n + (SELECT count(*) FROM size WHERE k = 'hole' AND n < 2), 'small_filled' FROM w UNION ALL SELECT count(*), 'parts' FROM size WHERE k = 'wide' AND n >= 15""",
    "enclosed_holes": f"""WITH RECURSIVE {SQL_STATIONS}, {SQL_EDGES}, {_COVER}, wide AS (SELECT DISTINCT cx, cy FROM cov WHERE region_id % 3 = 0),
 own AS (SELECT DISTINCT floor(lon / 0.02e0)::BIGINT AS cx, floor(lat / 0.02e0)::BIGINT AS cy FROM stations),
 beside AS (SELECT * FROM (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS v(i, j)), frame AS (SELECT min(cx) - 1 AS x0, max(cx) + 1 AS x1, min(cy) - 1 AS y0, max(cy) + 1 AS y1 FROM wide),
 free AS (SELECT cx, cy, cx IN (x0, x1) OR cy IN (y0, y1) AS edge FROM (SELECT *, unnest(range(y0, y1 + 1)) AS cy FROM (SELECT *, unnest(range(x0, x1 + 1)) AS cx FROM frame)) f ANTI JOIN wide USING (cx, cy)),
 outer_cells AS (SELECT cx, cy FROM free WHERE edge UNION SELECT free.cx, free.cy FROM outer_cells o, beside, free WHERE free.cx = o.cx + i AND free.cy = o.cy + j),
 hole AS (SELECT cx, cy FROM free ANTI JOIN outer_cells USING (cx, cy)),
 both_kinds AS (SELECT 'hole' AS k, * FROM hole UNION ALL SELECT 'wide', * FROM wide),
 reach AS (SELECT k, cx AS ax, cy AS ay, cx, cy FROM both_kinds UNION SELECT r.k, ax, ay, o.cx, o.cy FROM reach r, beside, both_kinds o WHERE o.k = r.k AND o.cx = r.cx + i AND o.cy = r.cy + j),
 size AS (SELECT k, ax AS cx, ay AS cy, count(*) AS n FROM reach GROUP BY ALL),
 e AS (SELECT 'cells' AS what, cx, cy FROM wide UNION ALL SELECT 'holes', cx, cy FROM hole UNION ALL SELECT 'filled', cx, cy FROM both_kinds UNION ALL SELECT 'small_filled', cx, cy FROM wide
  UNION ALL SELECT 'small_filled', cx, cy FROM size WHERE k = 'hole' AND n < 10 UNION ALL SELECT 'stations', cx, cy FROM hole SEMI JOIN own USING (cx, cy) UNION ALL SELECT 'free', cx, cy FROM hole ANTI JOIN own USING (cx, cy)
  UNION ALL SELECT 'parts', cx, cy FROM size WHERE k = 'wide' AND n >= 60)
 SELECT w.what, count(cx) AS n, coalesce(sum(cx), 0)::BIGINT AS sx, coalesce(sum(cy), 0)::BIGINT AS sy FROM (SELECT unnest(['cells', 'holes', 'filled', 'small_filled', 'stations', 'free', 'parts']) AS what) w LEFT JOIN e USING (what) GROUP BY w.what""",
    "line_lengths": f"WITH {_SEG} SELECT line, round(sum({_planar('lat', 'lon', 'blat', 'blon')}), 1) AS length_m, count(*) AS vertices FROM seg GROUP BY line HAVING sum({_planar('lat', 'lon', 'blat', 'blon')}) >= 800",
    "snap_to_line": f"WITH {_SNAP}, b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY d) = 1) SELECT station_id, round(CASE WHEN d > 300 THEN lat + y / 110540.0e0 ELSE lat END, 5) AS lat, round(CASE WHEN d > 300 THEN lon + x / kx ELSE lon END, 5) AS lon, round(d, 1) AS d, d > 300 AS moved FROM b WHERE d <= 3000",
    "offset_lines": f"""WITH {SQL_VERTICES}, n AS (SELECT *, row_number() OVER w AS i, lag(lat) OVER w AS alat, lag(lon) OVER w AS alon, lead(lat) OVER w AS blat, lead(lon) OVER w AS blon, count(*) OVER (PARTITION BY line) AS n FROM vertices WINDOW w AS (PARTITION BY line ORDER BY seq)),
 m AS (SELECT *, 111320.0e0 * cos(radians(lat)) AS mx FROM n WHERE i = 2 AND n > 2), t AS (SELECT *, (blon - alon) * mx AS tx, (blat - alat) * 110540.0e0 AS ty FROM m), k AS (SELECT *, sqrt(tx * tx + ty * ty) AS h FROM t)
 SELECT line AS way_id, color, n, round(lat + tx / h * o / 110540.0e0, 7) AS lat, round(lon - ty / h * o / mx, 7) AS lon FROM k, (VALUES ('r', -16.0e0), ('y', 0.0e0), ('g', 16.0e0)) AS v(color, o)""",
    "clipped_lines": f"WITH {SQL_VERTICES}, k AS (SELECT line, arg_min(seq, ({_planar('lat', 'lon', '37.7e0', '-122.0e0')}, seq)) AS cut FROM vertices GROUP BY line) SELECT line, count(*) AS n, min(seq) AS first_seq FROM vertices JOIN k USING (line) WHERE seq >= cut GROUP BY line",
    "chain_groups": _REACH,
    "point_in_region": f"WITH {SQL_STATIONS}, {SQL_EDGES} SELECT p.station_id AS id, region_id FROM stations p, edges GROUP BY p.station_id, region_id HAVING {_IN}",
    "region_clip_counts": f"WITH {X.SQL_POIS}, {SQL_EDGES}, i AS (SELECT p.poi_id, category, region_id FROM pois p, edges GROUP BY p.poi_id, category, region_id, p.lat, p.lon HAVING {_IN}) SELECT category, count(DISTINCT poi_id) AS n FROM i WHERE category <> 'park' OR region_id < 10 GROUP BY category",
    "region_boxes": f"""WITH {SQL_EDGES}, a AS (SELECT region_id, ring, abs(sum(x1 * y2 - x2 * y1)) / 2 AS a FROM edges GROUP BY ALL), m AS (SELECT region_id, sum(CASE WHEN ring = 0 THEN a ELSE -a END) * 111320.0e0 * cos(radians(37.7e0)) * 110574.0e0 AS m2 FROM a GROUP BY region_id)
 SELECT region_id, round(min(x1), 6) AS w, round(max(x1), 6) AS e, round(min(y1), 6) AS s, round(max(y1), 6) AS n, round(any_value(m2) / 1e6, 3) AS km2 FROM edges JOIN m USING (region_id) GROUP BY region_id""",
    "cover_algebra": f"""WITH {SQL_EDGES}, {_COVER}, a AS (SELECT DISTINCT cx, cy FROM cov WHERE region_id % 2 = 0), b AS (SELECT DISTINCT cx, cy FROM cov WHERE region_id % 3 = 0),
 u AS (SELECT 'union' AS what, * FROM (FROM a UNION FROM b) UNION ALL SELECT 'difference', * FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'intersection', * FROM (FROM a INTERSECT FROM b)) SELECT what, count(*) AS n, sum(cx)::BIGINT AS sx, sum(cy)::BIGINT AS sy FROM u GROUP BY what""",
    "gap_runs": "WITH v AS (SELECT s_suppkey // 20 AS line, s_suppkey AS pos, s_acctbal > 2000 AS covered FROM supplier), g AS (SELECT *, pos - row_number() OVER (PARTITION BY line, covered ORDER BY pos) AS run, lag(covered) OVER w AS b, lead(covered) OVER w AS a FROM v WINDOW w AS (PARTITION BY line ORDER BY pos)) SELECT line, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n, coalesce(bool_or(a), false) AND coalesce(bool_or(b), false) AS closed FROM g WHERE NOT covered GROUP BY line, run",
    "county_overlap": f"WITH {SQL_EDGES}, {_COVER}, o AS (SELECT region_id AS place_id, floor(cx / 9)::BIGINT::VARCHAR AS county, count(*) AS n FROM cov GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY place_id) AS total FROM o) SELECT place_id, county, round(n / total, 6) AS share FROM t QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY n DESC, county DESC) = 1",
    "parent_roots": "WITH RECURSIVE e AS (SELECT p_partkey AS c, p_partkey // 3 AS p FROM part WHERE p_partkey // 3 > 0), w(id, root) AS (SELECT c, p FROM e UNION ALL SELECT w.id, e.p FROM w JOIN e ON e.c = w.root) SELECT id, min(root) AS root FROM w GROUP BY id",
}

_LAST, _FIRST = 20, 9  # the finest level (half a diagonal of at most 25 m) and the coarsest (50 km)
_NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_PINS = f"""n AS (SELECT p_partkey AS pin, p_partkey // 8 AS g, (p_partkey % 8)::INT AS i, p_size, split_part(p_name, ' ', 1) AS w FROM part),
 pins AS (SELECT pin, ['park', 'hospital', 'museum'][1 + g % 3] AS category, 'Zor' || ((g * 7) % 97) || 'el ' || w || ['', ' Park', ' Parking Garage', ' Dog Park', ' Medical Center', ' Entrance', ' - North', ' Hospital Building B'][1 + i] AS name,
  {sql_lat('g', 4409)} + [0.0, 40.0, 120.0, 250.0, 330.0, 480.0, 650.0, 800.0][1 + i] / 110540.0e0 AS lat, {sql_lon('g', 6277)} AS lon, p_size * CASE WHEN i = 0 THEN 9 ELSE 1 END AS reviews FROM n)"""


def _words(text: str, *without: list[str]) -> str:
    """The distinct words of an ASCII text in SQL, in order, less numbers and listed words."""
    out = ", ".join(f"'{w}'" for ws in without for w in ws)
    return rf"list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({text}), '[^\w\s]', ' ', 'g'), '\s+'), lambda x: x <> '' AND x NOT IN ({out}))))"


_HEAD = "regexp_split_to_array(name, '[|(:]')[1]"
_DIST = f"list_filter({_words(_HEAD, N.STOP, N.GENERIC)}, lambda x: NOT regexp_full_match(x, '\\d+'))"
_FULL = f"list_filter({_words('name', N.STOP, N.GENERIC, N.STRUCTURAL)}, lambda x: NOT regexp_full_match(x, '\\d+'))"
_SUB = rf"(regexp_matches(lower(name), '^\s*\d{{2,6}}\s+[a-z]') OR regexp_matches(lower(name), '\bbuilding\s+[a-z0-9]\b') OR regexp_matches(lower(name), '{N.SUB_PARTS}'))"
_SMALL = "(len({a}.toks) > 0 AND len({a}.toks) < len({b}.toks) AND list_has_all({b}.toks, {a}.toks) AND {a}.reviews < 50)"

ORACLE_SQL |= {
    "boxes_on_region": f"""WITH {SQL_EDGES}, {SQL_STATIONS}, t AS (SELECT station_id AS tile, lon - 0.025e0 AS w, lon + 0.025e0 AS e, lat - 0.02e0 AS s, lat + 0.02e0 AS n FROM stations),
 p AS (SELECT tile, w AS lon, s AS lat FROM t UNION ALL SELECT tile, w, n FROM t UNION ALL SELECT tile, e, s FROM t UNION ALL SELECT tile, e, n FROM t UNION ALL SELECT tile, (w + e) / 2, (s + n) / 2 FROM t)
 SELECT tile FROM (SELECT p.tile FROM p, edges GROUP BY p.tile, p.lon, p.lat, region_id HAVING {_IN}) UNION SELECT tile FROM t, edges WHERE x1 BETWEEN w AND e AND y1 BETWEEN s AND n""",
    "adaptive_tiles": f"""WITH {SQL_STATIONS}, f AS (SELECT floor((lon + 180) / 360 * {2**_LAST})::BIGINT AS x, floor((lat + 90) / 180 * {2**_LAST})::BIGINT AS y FROM stations),
 l AS (SELECT z AS level, x >> ({_LAST} - z)::INT AS tx, y >> ({_LAST} - z)::INT AS ty, count(*) AS n FROM f, range({_FIRST}, {_LAST + 1}) r(z) GROUP BY ALL),
 u AS (SELECT c.* FROM l c LEFT JOIN l p ON p.level = c.level - 1 AND p.tx = c.tx >> 1 AND p.ty = c.ty >> 1 WHERE c.level = {_FIRST} OR p.n >= 20)
 SELECT level::INT AS level, count(*) AS tiles, sum(n)::BIGINT AS points, max(n) AS most FROM u WHERE n < 20 OR level = {_LAST} GROUP BY level""",
    "covered_chains": f"""WITH RECURSIVE {SQL_VERTICES}, v AS (SELECT line * 3 AS line, line AS grp, seq, lat, lon FROM vertices
  UNION ALL SELECT line * 3 + 1, line, seq, lat + CASE WHEN line % 2 = 0 THEN 0.0005e0 ELSE 0.05e0 END, lon FROM vertices WHERE seq % 20 < 15
  UNION ALL SELECT line * 3 + 2, line, seq, lat + CASE WHEN line % 2 = 0 THEN 0.0016e0 ELSE 0.0495e0 END, lon FROM vertices WHERE seq % 20 < 10),
 g AS (SELECT *, count(*) OVER (PARTITION BY line) AS n, row_number() OVER (PARTITION BY line ORDER BY seq) - 1 AS i, lead(lat) OVER (PARTITION BY line ORDER BY seq) AS blat, lead(lon) OVER (PARTITION BY line ORDER BY seq) AS blon FROM v),
 z AS (SELECT line, sum({_planar('lat', 'lon', 'blat', 'blon')}) AS m FROM g GROUP BY line HAVING m IS NOT NULL), s AS (SELECT g.*, m FROM g JOIN z USING (line) WHERE n <= 24 OR (i * 24) // n <> CASE WHEN i = 0 THEN -1 ELSE ((i - 1) * 24) // n END),
 t AS (SELECT v.*, m FROM v JOIN z USING (line)), h AS (SELECT DISTINCT s.line, s.seq, t.line AS longer FROM s JOIN t ON s.grp = t.grp AND (t.m > s.m OR (t.m = s.m AND t.line < s.line)) AND {_planar('s.lat', 's.lon', 't.lat', 't.lon')} <= 140),
 o AS (SELECT line, samples, ms, row_number() OVER (ORDER BY m DESC, line) AS k FROM (SELECT line, any_value(m) AS m, count(*) AS samples FROM s GROUP BY line)
  LEFT JOIN (SELECT line, list(longer) AS ms FROM (SELECT line, list(longer) AS longer FROM h GROUP BY line, seq) GROUP BY line) USING (line)),
 r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT i + 1, CASE WHEN len(list_filter(ms, lambda x: list_has_any(x, kept))) >= 0.6 * samples THEN kept ELSE list_append(kept, line) END FROM r JOIN o ON k = i + 1)
 SELECT line, len(list_filter(ms, lambda x: list_has_any(x, kept))) AS hits, samples FROM o, (SELECT kept FROM r ORDER BY i DESC LIMIT 1) WHERE NOT list_contains(kept, line)""",
    "override_matches": f"""WITH {_PINS}, p AS (SELECT *, {_NORM.format('name')} AS norm FROM pins),
 o AS (SELECT pin AS ord, category, CASE pin % 9 WHEN 0 THEN 'Nowhere ' || pin WHEN 1 THEN 'Old ' || name || ' West' WHEN 2 THEN substr(name, 4, 9) ELSE upper(name) END AS query, CASE WHEN pin % 5 = 0 THEN lat END AS lat, CASE WHEN pin % 5 = 0 THEN lon END AS lon FROM pins),
 q AS (SELECT *, {_NORM.format('query')} AS q FROM o),
 m AS (SELECT ord, pin, q.lat, norm <> q AS apart, {sql_hav('p.lat', 'p.lon', 'q.lat', 'q.lon')} AS d, reviews FROM q JOIN p USING (category) WHERE norm = q OR (q <> '' AND (contains(norm, q) OR contains(q, norm)))),
 b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY ord ORDER BY apart, d ASC NULLS LAST, reviews DESC, pin) = 1)
 SELECT o.ord, coalesce(b.pin, -1) AS pin FROM o LEFT JOIN b ON b.ord = o.ord AND (b.lat IS NULL OR d <= 200)""",
    "merge_rule_pairs": f"""WITH {_PINS}, d AS (SELECT *, {_words(_HEAD, N.STOP)} AS toks, CASE WHEN category = 'hospital' THEN {_FULL} ELSE {_DIST} END AS words FROM pins WHERE NOT {_SUB}),
 p AS (SELECT a.pin AS l_pin, b.pin AS r_pin, a.category, len(list_intersect(a.words, b.words)) AS k, a.toks = b.toks AS same, {_SMALL.format(a='a', b='b')} OR {_SMALL.format(a='b', b='a')} AS small, {sql_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS d
  FROM d a JOIN d b ON a.category = b.category AND a.pin < b.pin AND abs(a.lat - b.lat) < 0.02)
 SELECT l_pin, r_pin FROM p WHERE k > 0 AND d <= CASE WHEN category = 'hospital' THEN 700 ELSE 300 END AND (d <= 60 OR same OR (category = 'hospital' AND k >= 2) OR (d <= 300 AND small))""",
}
ORACLE_SQL["point_in_region_tree"] = ORACLE_SQL["point_in_region"]

_PAIRS = ORACLE_SQL["merge_rule_pairs"].removeprefix("WITH ")
_RULES, _CHOSEN = _PAIRS[: _PAIRS.rindex(" SELECT l_pin, r_pin")], _PAIRS[_PAIRS.rindex(" SELECT l_pin, r_pin") :]


def _guarded_sql(every: int) -> str:
    """The pairs one by one, over the list of all pins' groups: state(i, s) and the last one in `groups` (pin, grp)."""
    bad = "len(list_filter(list_zip(list_select(s, x), list_select(s, y)), lambda z: (z[1] = ga AND z[2] = gb) OR (z[1] = gb AND z[2] = ga)))"
    join = "list_transform(s, lambda v: CASE WHEN v = greatest(ga, gb) THEN least(ga, gb) ELSE v END)"
    return f"""WITH RECURSIVE {_RULES}, g AS MATERIALIZED (SELECT l_pin AS a, r_pin AS b, row_number() OVER (ORDER BY l_pin, r_pin) AS ord FROM ({_CHOSEN})),
 apart AS MATERIALIZED (SELECT list(pin + 1) AS x, list(pin) AS y FROM pins WHERE pin % {every} = 1),
 state(i, s) AS (SELECT 0::BIGINT, range(0, (SELECT max(pin) + 1 FROM pins)) UNION ALL SELECT i + 1, CASE WHEN ga = gb OR {bad} > 0 THEN s ELSE {join} END
  FROM (SELECT i, s, s[g.a + 1] AS ga, s[g.b + 1] AS gb FROM state JOIN g ON g.ord = i + 1), apart),
 groups AS (SELECT d.pin, s[d.pin + 1] AS grp FROM d, (SELECT s FROM state ORDER BY i DESC LIMIT 1))"""


ORACLE_SQL["merge_guarded"] = f"{_guarded_sql(16)} SELECT pin, grp FROM groups"
ORACLE_SQL["merge_eval"] = f"""{_guarded_sql(32)}, pr AS (SELECT a.pin AS a, b.pin AS b, a.grp = b.grp AS auto, a.pin // 8 = b.pin // 8 AS want FROM groups a JOIN groups b ON a.pin < b.pin)
 SELECT count(*) FILTER (auto AND want) AS caught, count(*) FILTER (NOT auto AND want) AS missed, count(*) FILTER (auto AND NOT want) AS over_merged, count(*) FILTER (auto AND b % 16 = 1 AND a = b - 1) AS violations FROM pr"""
ORACLE_SQL["pair_diagnostics"] = f"""WITH {_PINS}, x AS (SELECT pin, lat, lon, {_DIST} AS dist, {_SUB} AS sub FROM pins)
 SELECT a.pin AS a, b.pin AS b, round({sql_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 3) AS d, array_to_string(list_sort(list_intersect(a.dist, b.dist)), ' ') AS shared, a.sub OR b.sub AS sub FROM x a JOIN x b ON b.pin = a.pin + 1 AND a.pin % 8 < 7"""
ORACLE_SQL["merged_children"] = f"WITH {_PINS} SELECT pin - pin % 8 AS rep, string_agg(pin || ':' || name, '|' ORDER BY reviews DESC, pin) AS kids FROM pins WHERE pin % 8 > 0 GROUP BY pin - pin % 8"

_SAMPLES = f"""line_vertices AS (SELECT s_suppkey // 20 AS line, s_suppkey AS seq, {sql_lat('s_suppkey', 7127)} AS lat, {sql_lon('s_suppkey', 8243)} AS lon FROM supplier),
 ls AS (SELECT *, lead(lat) OVER w AS blat, lead(lon) OVER w AS blon FROM line_vertices WINDOW w AS (PARTITION BY line ORDER BY seq)), ld AS (SELECT *, {_planar('lat', 'lon', 'blat', 'blon')} AS d FROM ls WHERE blat IS NOT NULL),
 lu AS (SELECT *, sum(d) OVER (PARTITION BY line ORDER BY seq) AS upto FROM ld), lf AS (SELECT *, coalesce(lag(upto) OVER (PARTITION BY line ORDER BY seq), 0) AS since FROM lu),
 lk AS (SELECT *, unnest(generate_series(ceil(since / 2000)::BIGINT, ceil(upto / 2000)::BIGINT - 1)) AS pos FROM lf WHERE d > 0),
 samples AS (SELECT line, pos, lat + (blat - lat) * (pos * 2000.0e0 - since) / d AS lat, lon + (blon - lon) * (pos * 2000.0e0 - since) / d AS lon FROM lk)"""
ORACLE_SQL["resampled_lines"] = f"WITH {_SAMPLES} SELECT line, pos, round(lat, 6) AS lat, round(lon, 6) AS lon FROM samples"
ORACLE_SQL["bridge_cells"] = f"""WITH {SQL_EDGES}, {_COVER}, {_SAMPLES}, area AS (SELECT DISTINCT cx, cy FROM cov), sc AS (SELECT line, pos, floor(lon / 0.02e0)::BIGINT AS cx, floor(lat / 0.02e0)::BIGINT AS cy FROM samples),
 sf AS (SELECT s.*, a.cx IS NOT NULL AS covered FROM sc s LEFT JOIN area a USING (cx, cy)), si AS (SELECT *, pos - row_number() OVER (PARTITION BY line, covered ORDER BY pos) AS run FROM sf),
 gap AS (SELECT line, run, min(pos) AS a, max(pos) AS b, count(*) AS n FROM si WHERE NOT covered GROUP BY ALL), ends AS (SELECT line, min(pos) AS a, max(pos) AS b FROM sf GROUP BY line),
 closed AS (SELECT gap.* FROM gap JOIN ends e USING (line) WHERE gap.a > e.a AND gap.b < e.b AND n * 2000 <= 12 * 1609.344e0),
 path AS (SELECT DISTINCT cx, cy FROM sf JOIN closed k ON sf.line = k.line AND sf.pos BETWEEN k.a AND k.b)
 SELECT DISTINCT cx + i AS cx, cy + j AS cy FROM path, range(-3, 4) AS v(i), range(-3, 4) AS w(j) WHERE pow(i * 0.02e0 * 111320.0e0 * cos(radians(37.7e0)), 2) + pow(j * 0.02e0 * 110540.0e0, 2) <= pow(1.6e0 * 1609.344e0, 2)"""
