import math
import random

from pyspark.sql import functions as F

from placewright.functions import geo, names
from placewright.operators import joins
from placewright.queries import ORACLE_SQL, QUERIES

from .conftest import normal


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_distances_and_labels(spark):
    d = geo.haversine_mi(F.lit(37.7766), F.lit(-122.3946), F.lit(37.3297), F.lit(-121.9024))
    x = F.lit(33.448)
    r = one(spark, d, geo.format_miles(x), geo.format_miles(x, 1), geo.format_miles(x, 5), geo.format_miles(x, 10), geo.format_miles(F.lit(2.3), 0.5), geo.format_distance(F.lit(1.0), "metric"))
    assert 40 < r[0] < 44
    assert tuple(r[1:]) == ("33.45 mi", "33 mi", "35 mi", "30 mi", "2.5 mi", "1.61 km")


def test_circle_and_bisector(spark):
    la, lo = F.lit(37.7), F.lit(-122.2)
    far = F.transform(geo.circle_ring(la, lo, F.lit(10.0), 36), lambda p: geo.haversine_mi(la, lo, p["lat"], p["lon"]))
    line = geo.bisector_polyline(F.lit(37.7), F.lit(-122.45), F.lit(37.8), F.lit(-122.25), F.lit(30.0))
    r = one(spark, far, line)
    assert len(r[0]) == 36 and all(9.5 < x < 10.5 for x in r[0])
    assert len(r[1]) == 65 and abs(r[1][32]["lat"] - 37.75) < 1e-9 and abs(r[1][32]["lon"] + 122.35) < 1e-9


def test_half_plane_is_on_the_side_asked_for(spark):
    pts = geo.bisector_half_plane(F.lit(37.7), F.lit(-122.45), F.lit(37.8), F.lit(-122.25), F.lit(38.0), F.lit(-122.6), F.lit(30.0))
    r = one(spark, pts)[0]
    assert len(r) == 130
    assert sum(p["lat"] for p in r[65:]) / 65 > sum(p["lat"] for p in r[:65]) / 65


def test_coordinate_texts(spark):
    want = {
        "48.8584, 2.2945": (48.8584, 2.2945), "-33.8568 151.2153": (-33.8568, 151.2153), "33.8568 S; 151.2153 E": (-33.8568, 151.2153), "S 33.8568 / E 151.2153": (-33.8568, 151.2153),
        "151.2153°E 33.8568°S": (-33.8568, 151.2153), "12 N, 7": (12.0, 7.0), "at (1.5 , +2)!": (1.5, 2.0), "40.5 - 3.25": (40.5, 3.25),
        "": None, "12.5": None, "hello": None, "91, 10": None, "4 5 6": None, "10 181": None, "5 N 6 N": None, "7 W 8 E": None, None: None,
    }
    df = spark.createDataFrame([(t,) for t in want], "t string").select("t", geo.clean_coordinates(F.col("t")).alias("p"))
    got = {r["t"]: r["p"] and tuple(r["p"]) for r in df.collect()}
    assert got == want


def test_names(spark):
    n = F.lit("UCSF Medical Center: Mission Bay")
    r = one(spark, names.sig_tokens(n), names.distinctive(n), names.distinctive_full(n), names.has_qualifier(n), names.is_sub(F.lit("875 Blake Wilbur Drive")), names.is_sub(F.lit("Oak Park")), names.match_norm(F.lit("A&B  Café + Co.")), names.is_specialty(F.lit("Pediatric Care")), names.name_length(F.lit("Glen Park (BART)")))
    assert r[0] == ["center", "medical", "ucsf"] and r[1] == ["ucsf"] and r[2] == ["mission", "ucsf"]
    assert r[3] and r[4] and not r[5] and r[6] == "a and b café and co" and r[7] and r[8] == 9


def test_within_finds_all_pairs_anywhere(spark):
    """Brute force: mid and high latitudes, the date line, the poles, the equator; small and large radii."""
    r = random.Random(3)
    places = [(37.0, -122.0, 0.02), (75.0, 20.0, 0.03), (-70.0, 179.999, 0.02), (0.0, -180.0, 0.01), (89.99, 0.0, 0.02), (-89.995, 100.0, 0.02)]
    rows = []
    for la, lo, w in places:
        for _ in range(40):
            x = (lo + r.uniform(-w, w) / max(math.cos(math.radians(la)), 1e-3) + 180) % 360 - 180
            rows.append((len(rows), max(-90.0, min(90.0, la + r.uniform(-w, w))), x))
    df = spark.createDataFrame([*rows, (999, None, 1.0)], "id long, lat double, lon double")
    dist = lambda a, b: 2 * geo.EARTH_M * math.asin(math.sqrt(math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2))
    for meters in (500.0, 2_500.0, 400_000.0):
        got = {(x["l_id"], x["r_id"]) for x in joins.within(df, df, meters).collect()}
        assert got == {(a[0], b[0]) for a in rows for b in rows if dist(a, b) <= meters}
        assert joins.within(df, df, meters).count() == len(got)
        assert sorted((x["l_id"], x["r_id"]) for x in joins.within(df, df, meters, copy="right").collect()) == sorted(got)


def test_formats_round_the_double_as_its_sql_does(spark, duck, tmp_path):
    """1039.3 / 20 is written 51.964999999999996, but times 100 it is 5196.5, which SQL rounds up: 171 ft, not 170."""
    duck.sql("SELECT 8698::BIGINT AS c_custkey, 'x' AS c_name, 1 AS c_nationkey, v AS c_acctbal, 'BUILDING' AS c_mktsegment FROM (VALUES (1039.3), (-1039.3), (0.1), (-20.1), (NULL)) t(v)").write_parquet(f"{tmp_path}/customer.parquet")
    got = QUERIES["formats"](spark, str(tmp_path)).toPandas()
    sql = ORACLE_SQL["formats"].replace("FROM customer,", f"FROM '{tmp_path}/customer.parquet',")
    assert normal(got) == normal(duck.sql(sql).df())
