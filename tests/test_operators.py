"""Operators against brute force and the rules they state."""

import math
import random

import pytest
from pyspark.sql import functions as F

from placewright.functions import geo
from placewright.operators import bitmaps as B
from placewright.operators import joins as J
from placewright.operators import lines as L
from placewright.operators import places as P
from placewright.operators import questions as Q
from placewright.operators import regions as R
from placewright.operators import resolve as E
from placewright.operators import runs as U
from placewright.operators import tentacles as T
from placewright.plans.graph import components, roots
from placewright.queries import QUERIES, shapes
from placewright.sources import fixtures as X

from .conftest import SF


def hav(a, b, c, d):
    p = math.radians
    x = math.sin(p(c - a) / 2) ** 2 + math.cos(p(a)) * math.cos(p(c)) * math.sin(p(d - b) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(x))


def points(spark, n, seed, **more):
    r = random.Random(seed)
    rows = [(i, 37.5 + r.random() / 10, -122.3 + r.random() / 10, "ab"[i % 2]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, lat double, lon double, category string")


STATION = "station_id long, name string, lat double, lon double, county string, city string, elevation double, name_length int, lines array<string>"
QUESTION = "game_id long, question_id long, kind string, created_at timestamp, lat double, lon double, to_lat double, to_lon double, radius_miles double, thermometer_miles double, value string, answer string, eliminates boolean, active boolean, vetoed boolean"


def question(kind, answer="yes", value=None, radius=1.0, active=True, vetoed=False, eliminates=True, at=(37.7749, -122.4194), to=(37.33, -121.9), qid=1):
    return (1, qid, kind, None, at[0], at[1], to[0], to[1], radius, None, value, answer, eliminates, active, vetoed)


def test_elimination_cases(spark):
    near = (1, "Test", 37.7749, -122.4194, "San Francisco", "San Francisco", 16.0, 12, ["Muni N"])
    far = (2, "Far", 37.33, -121.9, None, None, None, 8, [])
    st = spark.createDataFrame([near, far], STATION)

    def left(*q):
        return {r["station_id"] for r in Q.eliminate(st, spark.createDataFrame(list(q), QUESTION), X.AIRPORTS).collect()}

    assert left(question("radar")) == {1} and left(question("radar", "no")) == {2} and left(question("radar", None)) == {2}
    assert left(question("thermometer", "hotter")) == {2} and left(question("thermometer", "colder")) == {1}
    assert left(question("match-county", value="San Francisco")) == {1} and left(question("match-county", "no", "San Francisco")) == {2}
    assert left(question("match-namelength", value="12")) == {1} and left(question("match-line", value="Muni N")) == {1}
    assert left(question("measure-sealevel", "closer", "10")) == {2} and left(question("measure-sealevel", "closer", "200")) == {1, 2}
    assert left(question("match-city", value="San Francisco"), question("radar", qid=2, radius=0.0)) == {1}
    many = [question("radar", qid=i) for i in range(1, 9)]
    assert left(*many) == {1} and left(*many, question("match-line", value="x", qid=9)) == set()
    dead = [question("radar", active=False), question("radar", vetoed=True, qid=2), question("photo", qid=3)]
    assert left(*dead) == set()  # no live question: the game isn't listed


def test_yes_and_no_part_the_stations(spark):
    q = X.questions(spark, SF).where("question_id % 7 = 0")
    swap = {"yes": "no", "no": "yes", "hotter": "colder", "colder": "hotter", "closer": "further", "further": "closer"}
    back = q.replace(swap, subset=["answer"])
    a, b = (Q.verdicts(X.stations(spark, SF), x, X.AIRPORTS).withColumnRenamed("ok", n) for x, n in ((q, "a"), (back, "b")))
    both = a.join(b, ["question_id", "station_id"]).where(a["kind"] != "measure-sealevel")
    assert both.where("a = b").count() == 0 and both.count() > 0


@pytest.mark.parametrize(("bits", "group"), [(15, 1024), (4, 7)])
def test_bitmaps_equal_definitions(spark, monkeypatch, bits, group):
    """One bucket, and many small ones that bounds leave out, in many groups."""
    monkeypatch.setattr(B, "BUCKET_BITS", bits)
    monkeypatch.setattr(B, "GROUP", group)
    st, q = X.stations(spark, SF), X.questions(spark, SF)
    want = Q.verdicts(st, q, X.AIRPORTS).groupBy("game_id", "station_id").agg(F.bool_and("ok").alias("ok")).where("ok").select("game_id", "station_id")
    got = Q.eliminate(st, q, X.AIRPORTS)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    killed = Q.verdicts(st, q, X.AIRPORTS).groupBy("game_id", "question_id", "kind").agg(F.count_if(~F.col("ok")).alias("killed"))
    assert sorted(map(tuple, Q.kill_counts(st, q, X.AIRPORTS).collect())) == sorted(map(tuple, killed.collect()))


def test_first_killers_equal_definitions(spark, monkeypatch):
    monkeypatch.setattr(B, "BUCKET_BITS", 5)
    st, q = X.stations(spark, SF), X.questions(spark, SF).where("game_id % 3 = 0")
    want = Q.verdicts(st, q, X.AIRPORTS).where("not ok").groupBy("game_id", "station_id").agg(F.array_sort(F.collect_list("question_id")).alias("k")).collect()
    want = sorted((r["game_id"], r["station_id"], tuple(r["k"])) for r in want)
    got = Q.first_killers(st, q, X.AIRPORTS, every=True).collect()
    assert sorted((r["game_id"], r["station_id"], tuple(r["killers"])) for r in got) == want and all(r["first"] == r["killers"][0] for r in got)
    assert sorted(map(tuple, Q.first_killers(st, q, X.AIRPORTS).collect())) == [(g, s, k[0]) for g, s, k in want]


def test_remaining_counts_read_all_questions_of_a_game(spark, monkeypatch):
    st = X.stations(spark, SF)
    mild = X.questions(spark, SF).withColumn("game_id", F.floor(F.col("game_id") / 8)).where("answer = 'no' and kind in ('radar', 'match-namelength', 'match-line', 'match-city')")
    assert Q.live(mild).groupBy("game_id").count().where(F.col("count") > 6).count() > 0
    want = Q.verdicts(st, mild, X.AIRPORTS).groupBy("game_id", "station_id").agg(F.bool_and("ok").alias("ok")).groupBy("game_id").agg(F.count_if("ok").alias("n"))
    want = sorted(map(tuple, want.collect()))
    assert any(n for _, n in want)
    for most in (Q.ROW_QUESTIONS, 4):
        monkeypatch.setattr(Q, "ROW_QUESTIONS", most)
        assert sorted(map(tuple, Q.remaining_counts(st, mild, X.AIRPORTS).collect())) == want


def test_counts_below_equal_brute_force(spark):
    vals = [("a", 0.5), ("a", 1.0), ("a", 1.0), ("a", 12.0), ("a", None), ("b", -3.0), ("b", 1e6)]
    asks = [(1, "a", 1.0), (2, "a", 1.5), (3, "a", -1.0), (4, "b", 1e7), (5, "b", -3.0), (6, "c", 2.0), (7, "a", None), (8, "a", 12.5)]
    v, q = spark.createDataFrame(vals, "g string, x double"), spark.createDataFrame(asks, "id long, g string, t double")
    want = [(i, sum(1 for h, x in vals if h == g and x is not None and t is not None and x < t)) for i, g, t in asks]
    for width in (0.7, 5.0, 1e9):
        assert sorted(map(tuple, J.counts_below(v, q, "id", ["g"], width).collect())) == want


def test_match_counts_equal_pairs(spark):
    st, pois = X.stations(spark, SF).limit(40), X.pois(spark, SF)
    rows = [(1, "park", 37.5, -122.1), (2, "museum", 37.9, -121.7), (3, "park", 37.5, -122.1)]
    seek = spark.createDataFrame(rows, "game_id long, category string, lat double, lon double")
    want = J.nearest_match(st, pois, seek).groupBy("game_id").agg(F.count_if("same").alias("same"), F.count_if("closer").alias("closer"), F.count("*").alias("n"))
    assert sorted(map(tuple, J.nearest_match_counts(st, pois, seek, 900.0).collect())) == sorted(map(tuple, want.collect()))


def test_rewards_and_groups(spark):
    rows = [question("thermometer", to=(37.782, -122.4194), qid=1), question("thermometer", to=(37.782, -122.4194), qid=2), question("radar", radius=5.0, qid=3)]
    got = {r["question_id"]: (r["group_key"], r["cards"]) for r in Q.ask_history(spark.createDataFrame(rows, QUESTION)).collect()}
    assert got == {1: ("thermometer:0.5", "draw 2, keep 1"), 2: ("thermometer:0.5", "draw 4, keep 2"), 3: ("radar:5", "draw 2, keep 1")}


def test_within_equals_brute_force(spark):
    a, da = points(spark, 150, 1)
    b, db = points(spark, 150, 2)
    got = {(r["l_id"], r["r_id"]) for r in J.within(da, db, 900.0, by=["category"]).collect()}
    assert got == {(x[0], y[0]) for x in a for y in b if x[3] == y[3] and hav(*x[1:3], *y[1:3]) <= 900}


def test_nearest_equals_brute_force(spark):
    a, da = points(spark, 60, 3)
    b, db = points(spark, 40, 4)
    db = db.withColumnRenamed("id", "other")
    got = {(r["id"], r["rank"]): r["other"] for r in J.nearest(da, db, "id", "other", 3, ["category"], 500.0).collect()}
    for x in a:
        near = sorted((hav(*x[1:3], *y[1:3]), y[0]) for y in b if y[3] == x[3])[:3]
        assert [got[x[0], k + 1] for k in range(3)] == [i for _, i in near]


def test_components_and_roots(spark):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(7, 7), (500, 500)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    assert got == {x: find(x) for x in up}
    chain = spark.createDataFrame([(5, 4), (4, 3), (3, 1), (9, 8), (8, 9)], "child long, parent long")
    end = dict(map(tuple, roots(chain, 10).collect()))
    assert end[5] == end[4] == end[3] == 1


def test_polygon_borders(spark):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    hole = [(0.4, 0.4), (0.6, 0.4), (0.6, 0.6), (0.4, 0.6)]
    reg = spark.createDataFrame([(1, [ring, hole])], "region_id long, rings array<array<struct<lon: double, lat: double>>>")
    pts = spark.createDataFrame([(1, 0.2, 0.2), (2, 0.5, 0.5), (3, 0.0, 0.5), (4, 1.0, 1.0), (5, 1.5, 0.5), (6, None, 0.5)], "id long, lat double, lon double")
    for tree in (False, True):
        of = lambda b: {r["id"] for r in R.points_in_regions(pts, reg, b, tree=tree).collect()}
        assert of("covers") == {1, 3, 4} and of("contains") == {1} and 1 in of("evenodd") and not {2, 5, 6} & of("evenodd")


def test_quadtree_equals_rows_of_sides(spark):
    """A star of 3,000 sides, a thin strip over many degrees and a small square, with a third of the points in one place."""
    r = random.Random(8)
    star = [((1 + 0.5 * (i % 2) * r.random()) * math.cos(i / 3000 * 2 * math.pi) - 100, (1 + 0.5 * (i % 2) * r.random()) * math.sin(i / 3000 * 2 * math.pi) + 40) for i in range(3000)]
    strip = [(-110.0, 39.0), (-90.0, 41.0), (-90.0, 41.01), (-110.0, 39.01)]
    square = [(-100.51, 40.49), (-100.5, 40.49), (-100.5, 40.5), (-100.51, 40.5)]
    reg = spark.createDataFrame([(1, [star]), (2, [strip]), (3, [square])], "region_id long, rings array<array<struct<lon: double, lat: double>>>")
    at = [(40.495, -100.505)] * 300 + [(38.4 + 3.2 * r.random(), -101.6 + 3.2 * r.random()) for _ in range(500)] + [(39 + (x + 110) * 0.1 + 0.005, x) for x in (-109.5, -105.0, -90.5)]
    pts = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "id long, lat double, lon double")
    a, b = (sorted(map(tuple, R.points_in_regions(pts, reg, tree=t).collect())) for t in (True, False))
    assert a == b and {x[1] for x in a} == {1, 2, 3} and len(a) > 700
    cells, _ = R.hierarchy(reg)
    met = cells.where("full").groupBy("region_id").agg(F.count("*").alias("n"), F.countDistinct("level").alias("levels")).collect()
    assert next(x["levels"] for x in met if x["region_id"] == 1) > 3


def test_runs_equal_cells(spark):
    """Set operations, widening, parts and holes of random covers, two of them far apart."""
    r = random.Random(3)
    make = lambda: {(r.randrange(14), r.randrange(11)) for _ in range(95)} | {(200_000 + x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)}
    df = lambda s: U.from_cells(spark.createDataFrame(sorted(s), "cx long, cy long"))
    cells = lambda d: {(x["cx"], x["cy"]) for x in U.to_cells(d).collect()}
    a, b = make(), make() - {(200_000, 0)}
    assert cells(U.union(df(a), df(b))) == a | b and cells(U.difference(df(a), df(b))) == a - b and cells(U.intersection(df(a), df(b))) == a & b
    near = lambda c: {(c[0] + i, c[1] + j) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))}
    hx, hy = 0.02 * 111320 * math.cos(math.radians(37.7)), 0.02 * 110540
    wide = {(x + i, y + j) for x, y in a for i in range(-4, 5) for j in range(-4, 5) if (i * hx) ** 2 + (j * hy) ** 2 <= 4000**2}
    assert cells(U.buffer(df(a), 4000, 0.02, 37.7)) == wide

    def grouped(s):
        left, out = set(s), []
        while left:
            part, todo = set(), [left.pop()]
            while todo:
                c = todo.pop()
                part.add(c)
                todo += (n := near(c) & left)
                left -= n
            out.append(frozenset(part))
        return set(out)

    got = {}
    for x in U.to_cells(U.parts(df(a))).collect():
        got.setdefault(x["part"], set()).add((x["cx"], x["cy"]))
    assert {frozenset(p) for p in got.values()} == grouped(a)
    frames = [{(x, y) for x in range(-1, 15) for y in range(-1, 12)}, {(200_000 + x, y) for x in range(-1, 4) for y in range(-1, 4)}]
    enclosed = {c for f in frames for p in grouped(f - a) for c in p if not any(z in p for z in f if z[0] in (-1, 14, 199_999, 200_003) or z[1] in (-1, 11) or (z[0] > 100 and z[1] == 3))}
    assert cells(U.holes(df(a))) == enclosed and (200_001, 1) in enclosed


def test_covers(spark):
    ring = spark.createDataFrame([(x, y) for x in range(7) for y in range(7) if x in (0, 6) or y in (0, 6) or (x, y) == (3, 3)], "cx long, cy long")
    full = R.fill_holes(ring)
    assert full.count() == 49 and R.fill_holes(ring, 5).count() == ring.count()
    assert R.filter_parts(ring, 2).count() == 24
    assert R.buffer(spark.createDataFrame([(0, 0)], "cx long, cy long"), 1.0, 0.01, 37.7).count() == 1


def test_shared_border_reaches_over_a_gap(spark):
    """Two blocks of 4 x 4 cells, one column apart, and one far away: brute force over cells, with and without reach."""
    r = random.Random(5)
    blocks = {1: (0, 0), 2: (5, 1), 3: (40, 40)}
    cells = {(p, x + i, y + j) for p, (x, y) in blocks.items() for i in range(4) for j in range(4) if r.random() < 0.8}
    df = spark.createDataFrame(sorted(cells), "place_id long, cx long, cy long")
    res, lat = 0.001, 37.7
    hx, hy = res * 111320.0 * math.cos(math.radians(lat)), res * 110540.0
    beside = ((1, 0), (-1, 0), (0, 1), (0, -1))
    for size, meters in ((None, 150.0), (res, 190.0)):
        want = {}
        for p in blocks:
            own = {(x, y) for q, x, y in cells if q == p}
            other = {(x, y) for q, x, y in cells if q != p}
            border = [(x, y) for x, y in own if any((x + i, y + j) not in own for i, j in beside)]
            near = [any(((x - a) * hx) ** 2 + ((y - b) * hy) ** 2 <= meters**2 if size else (a - x, b - y) in beside for a, b in other) for x, y in border]
            want[p] = sum(near) / len(near)
        got = {x["place_id"]: x["share"] for x in R.shared_border(df, size, meters, lat).collect()}
        assert got == want and (want[1] > 0) == bool(size) and want[3] == 0
    assert {x["place_id"] for x in R.prune_isolated(df, df.select("place_id").distinct(), res=res, meters=190.0).select("place_id").distinct().collect()} == {1, 2}


def test_gap_runs_close_on_both_ends(spark):
    rows = [("a", i, c) for i, c in enumerate([False, True, False, False, True, False])]
    got = sorted(map(tuple, R.gap_runs(spark.createDataFrame(rows, "line string, pos long, covered boolean")).collect()))
    assert got == [("a", 0, 0, 1, False), ("a", 2, 3, 2, True), ("a", 5, 5, 1, False)]


def test_tiles_hold_all_points_and_respect_the_cap(spark):
    _, df = points(spark, 300, 6)
    t = R.adaptive_tiles(df, 20).toPandas()
    assert t["n"].sum() == 300 and t["n"].max() < 20


def test_offset_and_interline(spark):
    w = spark.createDataFrame([(1, ["r", "y", "g"], [(-122.4, 37.7), (-122.3, 37.7)]), (2, ["b"], [(-122.4, 37.7), (-122.3, 37.7)])], "way_id long, colors array<string>, coords array<struct<lon: double, lat: double>>")
    got = {(r["way_id"], r["color"]): r["coords"] for r in L.interline(w).collect()}
    assert len(got) == 4 and abs(got[1, "y"][0]["lat"] - 37.7) < 1e-12
    assert abs((got[1, "g"][0]["lat"] - got[1, "r"][0]["lat"]) * 110540 - 32) < 1e-6
    assert {r["color"] for r in L.interline(w, False).collect()} == {"r", "b"}


def test_merge_rules_equal_brute_force(spark):
    p = E.described(shapes.pins(spark, SF)).toPandas()
    got = {tuple(r) for r in E.merge_pairs(E.described(shapes.pins(spark, SF))).collect()}
    want = set()
    real = [r for r in p.itertuples() if not r.sub]
    for i, a in enumerate(real):
        for b in real[i + 1 :]:
            if a.category != b.category or not set(a.words) & set(b.words):
                continue
            d = hav(a.lat, a.lon, b.lat, b.lon)
            if d > (700 if a.campus else 300):
                continue
            ta, tb = set(a.toks), set(b.toks)
            rule = d <= 60 or ta == tb or (a.campus and len(set(a.words) & set(b.words)) >= 2)
            rule = rule or (d <= 300 and ((ta and ta < tb and a.reviews < 50) or (tb and tb < ta and b.reviews < 50)))
            if rule:
                want.add(tuple(sorted((a.pin, b.pin))))
    assert got == want and want


def test_separate_pairs_stay_apart(spark):
    rows = [(i, "park", f"Zorel Oak {i}", 37.7 + i * 1e-5, -122.4, 10 * i, "OPERATIONAL") for i in range(1, 5)]
    p = E.described(spark.createDataFrame(rows, "pin long, category string, name string, lat double, lon double, reviews int, status string"))
    pairs = E.merge_pairs(p)
    sep = spark.createDataFrame([(1, 4)], "a long, b long")
    g = {r["pin"]: r["grp"] for r in E.guarded_groups(pairs, p, sep).collect()}
    assert g[1] != g[4] and len(g) == 4
    free = {r["pin"]: r["grp"] for r in E.guarded_groups(pairs, p, sep.where("1 = 0")).collect()}
    assert len(set(free.values())) == 1


def test_merging_in_order_equals_the_sequence(spark):
    """Random graphs, a chain whose decisions wait for one another, and pairs that must stay apart."""
    r = random.Random(12)
    n = 40
    edges = sorted({tuple(sorted(r.sample(range(n), 2))) for _ in range(45)} | {(100 + i, 101 + i) for i in range(6)})
    apart = [tuple(r.sample(range(n), 2)) for _ in range(12)] + [(106, 100)]
    up = {x: x for x in [*range(n), *range(100, 107)]}
    for a, b in edges:
        x, y = sorted((up[a], up[b]))
        if x != y and not any({up[p], up[q]} == {x, y} for p, q in apart):
            up = {k: x if v == y else v for k, v in up.items()}
    df = lambda rows: spark.createDataFrame(rows, "a long, b long")
    got = E.merged_in_order(df(edges), spark.createDataFrame([(x,) for x in up], "pin long"), df(apart))
    assert dict(map(tuple, got.collect())) == up and len(set(up.values())) < n


def test_kept_and_children_are_all_pins(spark):
    pins = shapes.pins(spark, SF)
    kept, edges, funnel = shapes._resolved(spark, SF)
    out = pins.where("status = 'CLOSED_PERMANENTLY' or pin % 101 = 0").count()
    n, e = kept.count(), edges.select("child").distinct().count()
    touched = pins.count() - out - n - e
    assert n > 0 and e > 0 and touched >= 0
    root = roots(edges)
    assert root.join(edges.select(F.col("child").alias("root")), "root").count() == 0


def test_unresolved_overrides_are_listed(spark):
    got = QUERIES["override_matches"](spark, SF).toPandas()
    assert (got[got.ord % 9 == 0]["pin"] == -1).all() and (got[got.ord % 9 != 0]["pin"] > 0).all()


def test_curation_counts_add_up(spark):
    f = QUERIES["curation_funnel"](spark, SF).toPandas()
    assert (f["reviewed"] == f["off_type"] + f["removed"] + f["kept"]).all()


def test_clusters_are_independent_of_order(spark):
    rows = [(1, "A & B", 37.7, -122.4, "N"), (2, "A", 37.7001, -122.4, "J"), (3, "A", 37.9, -122.1, "K"), (4, "Z", 37.0, -122.0, "L")]
    df = spark.createDataFrame(rows, "stop_id long, name string, lat double, lon double, line string")
    got = {r["cluster"]: (r["name"], r["lines"], r["members"], r["wide"]) for r in P.cluster_stops(df).collect()}
    assert got == {1: ("A", ["J", "K", "N"], 3, True), 4: ("Z", ["L"], 1, False)}


def test_backfill_twice_adds_nothing(spark):
    own = spark.createDataFrame([("park", 1, "Oak", 37.7, -122.4)], "category string, id long, name string, lat double, lon double")
    new = spark.createDataFrame([("park", 2, "OAK", 37.70001, -122.4, 1), ("park", 3, "Elm", 37.7, -122.4, 2), ("park", 4, "elm", 37.7, -122.4, 3)], "category string, id long, name string, lat double, lon double, ord long")
    once = J.backfill(own, new)
    assert sorted(r["id"] for r in once.collect()) == [1, 3]
    assert sorted(r["id"] for r in J.backfill(once, new).collect()) == [1, 3]


def test_empty_tables(spark):
    st, q = X.stations(spark, SF).limit(0), X.questions(spark, SF).limit(0)
    assert Q.eliminate(st, q, X.AIRPORTS).count() == 0
    df = spark.createDataFrame([], "id long, lat double, lon double, category string")
    assert J.within(df, df, 100.0).count() == 0 and components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_containing_equals_brute_force(spark):
    texts = ["", "a", "ab", "abc", "xabcx", "bca", "zz abc zz", "zz", "aaaa", "aaa"]
    h = spark.createDataFrame([(g, i, t) for g in "pq" for i, t in enumerate(texts)], "category string, h long, text string")
    parts = h.withColumnRenamed("h", "p").where("category = 'p'")
    want = sorted((i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if b and b in a)
    assert sorted(map(tuple, E.containing(h, parts).collect())) == want


def test_overrides_of_nameless_pins_and_queries(spark):
    pins = spark.createDataFrame([(1, "park", "Oak Park", 5, 0.0, 0.0), (2, "park", "!", 9, 0.0, 0.0), (3, "park", "Old Oak Park West", 7, 0.0, 0.0), (4, "zoo", None, 1, 0.0, 0.0)], "pin long, category string, name string, reviews int, lat double, lon double")
    asks = spark.createDataFrame([(1, "park", "oak park", None, None), (2, "park", "OAK", None, None), (3, "park", "", None, None), (4, "zoo", "oak", None, None), (5, "park", "oak park", 5.0, 5.0)], "ord long, category string, query string, lat double, lon double")
    got, missing = E.resolve_overrides(pins, asks)
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 2), (3, 2)] and sorted(r["ord"] for r in missing.collect()) == [4, 5]


def test_names_sort_as_people_sort_them(spark):
    names = ["Zoo", "apple", "Äpfel", "apple pie", "Apple", "éclair", "Eclair B", None, "zebra"]
    st = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "station_id long, name string")
    stars = spark.createDataFrame([(8,), (8,)], "station_id long")
    order = [r["name"] for r in P.starred_first(st, stars).collect()]
    assert order == ["zebra", None, "Äpfel", "apple", "Apple", "apple pie", "éclair", "Eclair B", "Zoo"]
    assert [r["name"] for r in P.starred_first(st, stars, "UTF8_BINARY").collect()][2:5] == ["Apple", "Eclair B", "Zoo"]


def test_resampled_lines(spark):
    """Equal steps over short and long segments; a line of one vertex and repeated vertices give none of their own."""
    v = [(1, 1, 37.7, -122.0), (1, 2, 37.7005, -122.0), (1, 3, 37.7005, -122.0), (1, 4, 37.703, -122.0), (2, 1, 37.7, -122.0)]
    got = sorted(map(tuple, L.resampled(spark.createDataFrame(v, "line long, seq long, lat double, lon double"), 100.0).collect()))
    assert [(g[0], g[1]) for g in got] == [(1, k) for k in range(4)]
    assert all(abs((lat - 37.7) * 110540 - 100 * k) < 1e-6 and lon == -122.0 for _, k, lat, lon in got)


def test_lines_go_longest_first(spark):
    """Equal to taking the lines of a group one by one: crowded lines, chains of lines that wait for one another, ties."""
    r = random.Random(5)
    rows = []
    for line in range(60):
        n, lat0 = r.randint(2, 40), 37.7 + r.choice([0, 1, 2, 3, 5, 6, 30]) * 0.0009 + r.random() * 0.0003
        rows += [(line, line % 3, k, lat0, -122.0 + 0.001 * k) for k in range(n)]
    got = {x["line"]: (x["hits"], x["samples"]) for x in L.covered_chains(spark.createDataFrame(rows, "line long, grp long, seq long, lat double, lon double")).collect()}
    dist = lambda a, b: math.hypot((b[4] - a[4]) * 111320 * math.cos(math.radians(37.7)), (b[3] - a[3]) * 110540)
    lines = {}
    for x in rows:
        lines.setdefault(x[0], []).append(x)
    length = {k: sum(dist(a, b) for a, b in zip(v, v[1:])) for k, v in lines.items()}
    kept, want = [], {}
    for k in sorted(lines, key=lambda k: (-length[k], k)):
        v = lines[k]
        some = [x for i, x in enumerate(v) if len(v) <= 24 or i * 24 // len(v) != (i - 1) * 24 // len(v)]
        hits = sum(any(dist(x, y) <= 140 for j in kept if j % 3 == k % 3 for y in lines[j]) for x in some)
        if hits >= 0.6 * len(some):
            want[k] = (hits, len(some))
        else:
            kept.append(k)
    assert got == want and len(kept) > 10 and len(want) > 10


def _dense(spark, n, seed, step=0.00002):
    """n places of one category in a square of some 200 m, in random order of place."""
    r = random.Random(seed)
    return spark.createDataFrame([(i, "park", 37.5 + step * r.randrange(100), -122.0 + step * r.randrange(100), r.randrange(1, 51)) for i in range(n)], "poi_id long, category string, lat double, lon double, reviews int")


def _pairs_met(monkeypatch, module):
    """Rows that the distance joins of a module give from now on."""
    met, plain = [], module.within

    def counted(*a, **k):
        out = plain(*a, **k)
        met.append(out.count())
        return out

    monkeypatch.setattr(module, "within", counted)
    return met


def test_distance_joins_are_not_broadcast(spark):
    """the driver held the copied side, nine times its rows, as the planner knows its file only."""
    df = _dense(spark, 50, 1)
    plan = J.within(df, df, 100.0, by=["category"])._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_nested_flags_meet_few_pairs(spark, monkeypatch):
    df = _dense(spark, 900, 2)
    rows = df.collect()
    want = {}
    for a in rows:
        of = [b.poi_id for b in rows if b.poi_id != a.poi_id and b.reviews >= 3 * a.reviews and hav(a.lat, a.lon, b.lat, b.lon) <= 300.0]
        if of:
            want[a.poi_id] = min(of)
    met = _pairs_met(monkeypatch, J)
    assert {r["poi_id"]: r["nested_in"] for r in J.nested_flags(df, 300.0).collect()} == want
    assert sum(met) < 40 * len(rows)


def test_components_of_dense_places_need_few_edges(spark, monkeypatch):
    """the edges are as many as the places, not their pairs; two groups apart stay apart."""
    df = _dense(spark, 400, 3)
    far = df.selectExpr("poi_id + 400", "category", "lat + 0.01", "lon", "reviews")
    e = df.union(far)
    for module, run in ((L, lambda: L.chains(e.selectExpr("poi_id as way_id", "1 as grp", "lat as alat", "lon as alon", "lat as blat", "lon as blon"), 120.0).groupBy("chain")),
                        (P, lambda: P.cluster_stops(e.selectExpr("poi_id as stop_id", "string(poi_id) as name", "lat", "lon", "'L' as line"), 120.0).selectExpr("cluster as chain", "explode(names)").groupBy("chain"))):
        sizes, plain = [], module.components
        monkeypatch.setattr(module, "components", lambda edges, plain=plain, sizes=sizes: sizes.append(edges.count()) or plain(edges))
        assert sorted((r["chain"], r["count"]) for r in run().count().collect()) == [(0, 400), (400, 400)]
        assert sum(sizes) < 4 * 800


def test_left_counts_equal_the_rows_and_shuffle_no_pairs(spark):
    """Counts by words of bits are those of without_manual and endgame; signs, ends of words and empty games too."""
    ids = [-65, -64, -1, 0, 1, 62, 63, 64, 127, 128, 5_000_000_000]
    base = [(g, s) for g in range(6) for s in ids if g != 5 or s == 63]
    manual = [(g, s) for g, s in base if (g == 1 and s < 63) or (g == 2 and s > 0) or g == 5] + [(0, 99)]
    locked = [(3, 127), (4, 77), (2, 63), (9, 1)]
    base, manual, locked = (spark.createDataFrame(x, "game_id long, station_id long") for x in (base, manual, locked))
    left, gone = Q.without_manual(base, base, manual)
    end = Q.endgame(base, left, locked).groupBy("game_id").agg(F.count("*").alias("remaining"), F.min("station_id").alias("least"))
    want = end.join(gone.groupBy("game_id").agg(F.count("*").alias("eliminated")), "game_id", "left")
    got = Q.left_counts(base, manual, locked)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 5
    assert dict(got.dtypes) == dict(want.dtypes)


def test_drawn_words_equal_products():
    """Circles and half planes by blocks of 64: the same bits as a test of every station, whatever the bounds say."""
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(3)
    s = np.concatenate([r.normal(size=(500, 3)), np.array([0.6, 0.0, 0.8]) + r.normal(size=(3000, 3)) * 1e-3])
    s /= np.sqrt((s**2).sum(axis=1))[:, None]
    n = len(s)
    zero = pa.array(np.zeros(n))
    bucket = B.Bucket(pa.table({"station_id": pa.array(range(n)), "sx": s[:, 0], "sy": s[:, 1], "sz": s[:, 2], "airport_m": zero, "elev": zero, "no_elev": pa.array([False] * n)}))
    v = np.concatenate([s[r.integers(n, size=300)], r.normal(size=(100, 3)) * 1e-4, np.zeros((1, 3)), s[:2]])
    c = np.concatenate([np.cos(10.0 ** r.uniform(-6, 0.3, 300)), np.full(101, 5e-324), [2.0, np.nan]])
    want = s[:, 0] * v[:, 0, None] + s[:, 1] * v[:, 1, None] + s[:, 2] * v[:, 2, None] >= c[:, None]
    got = np.array([bucket.unpacked(w)[:n] for w in bucket.drawn(v, c)])
    assert (got == want).all() and want[:300].any() and not want[-3:].any()


def test_components_and_overrides_are_shuffled(spark, capsys):
    """No side of these joins goes whole through the driver."""
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 5)], "a long, b long")
    pins = spark.createDataFrame([(i, "park", "Oak", i % 7, 37.0 + i / 1000, -122.0) for i in range(50)], "pin long, category string, name string, reviews int, lat double, lon double")
    asks = spark.createDataFrame([(1, "park", "oak park", None, None), (2, "park", "OAK", 37.02, -122.0), (3, "park", "oak", 38.0, -122.0)], "ord long, category string, query string, lat double, lon double")
    got, missing = E.resolve_overrides(pins, asks)
    assert sorted(map(tuple, got.collect())) == [(1, 6), (2, 20)] and [r["ord"] for r in missing.collect()] == [3]
    capsys.readouterr()
    for df in (components(edges), got):
        df.explain()
        assert "BroadcastHashJoin" not in capsys.readouterr().out


def test_tentacle_keeps_no_places_beside_stations(spark, monkeypatch):
    """F8: no row holds a game's places, and boxes, groups and buckets of any size give the nearest place, the least id on a tie."""
    rows, st = points(spark, 400, 5)
    places, po = points(spark, 300, 6)
    places += [(900 + i, *places[i][1:]) for i in range(40)]
    po = spark.createDataFrame(places, "poi_id long, lat double, lon double, category string")
    games = [(i, "ab"[i % 2], 37.5 + i / 300, -122.3 + i / 400) for i in range(30)] + [(30, "b", 50.0, 0.0), (31, None, 37.5, -122.3)]
    seekers = spark.createDataFrame(games, "game_id long, category string, lat double, lon double")
    st = st.select(F.col("id").alias("station_id"), "lat", "lon").unionByName(spark.createDataFrame([(999, None, 1.0)], "station_id long, lat double, lon double"))
    want = set()
    for g, cat, la, lo in games:
        near = sorted(p for p in places if p[3] == cat and hav(la, lo, p[1], p[2]) <= 3000)
        if near:
            want |= {(g, r[0], min(near, key=lambda p: (hav(r[1], r[2], p[1], p[2]), p[0]))[0]) for r in rows} | {(g, 999, near[0][0])}
    monkeypatch.setattr(T, "BUCKET_BITS", 7)
    monkeypatch.setattr(T, "LISTED", 3)
    assert "collect_list" not in T.tentacle(st, po, seekers, 3000.0)._jdf.queryExecution().toString()
    got = [tuple(r) for r in T.tentacle(st, po, seekers, 3000.0).select("game_id", "station_id", "poi_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    counts = {(r["game_id"], r["poi_id"]): r["stations"] for r in T.tentacle_counts(st, po, seekers, 3000.0).collect()}
    assert sum(counts.values()) == len(want) and all(n == sum(w[0] == g and w[2] == p for w in want) for (g, p), n in counts.items())


@pytest.mark.parametrize("n, box, pairs", [(1, 12, 200_000), (37, 1, 50), (500, 2, 200)])
def test_boxes_find_the_nearest(monkeypatch, n, box, pairs):
    """F8: boxes within boxes, over the date line too, against all distances."""
    import numpy as np

    monkeypatch.setattr(T, "BOX", box)
    monkeypatch.setattr(T, "PAIRS", pairs)
    r = np.random.default_rng(n)
    lat, lon, plat, plon = r.uniform(-80, 80, n), r.uniform(-180, 180, n), r.uniform(-80, 80, 120), r.uniform(-180, 180, 120)
    want = T._haversine(lat[:, None], lon[:, None], plat[None], plon[None]).argmin(axis=1)
    boxes = T.Boxes(lat, lon)
    assert (boxes.nearest(plat, plon) == want).all()
    assert (boxes.nearest(plat, plon, np.where(r.random(n) < 0.5, want, -1)) == want).all()


def test_lines_of_stations_follow_no_density(spark, monkeypatch):
    """many stops of a line around a station are met a few at a time, with the lines that all of them give."""
    rows, st = points(spark, 60, 7)
    stops = [(("BART", "VTA")[i % 2], f"L{i % 3}" if i % 7 else None, 37.5 + (i * 37 % 101) / 1010, -122.3 + (i * 53 % 103) / 1030) for i in range(2_000)]
    st = st.select(F.col("id").alias("station_id"), F.when(F.col("category") == "a", "BART").otherwise("VTA").alias("system"), "lat", "lon", F.array(F.lit("own")).alias("lines"))
    met = []
    real = J.within
    monkeypatch.setattr(J, "within", lambda *a, **k: met.append(real(*a, **k)) or met[-1])
    got = {r["station_id"]: r["lines"] for r in J.lines_of_stations(st, spark.createDataFrame(stops, "system string, line string, lat double, lon double"), ["BART"], 1700.0).collect()}
    flat = lambda a, b, c, d: math.hypot((d - b) * 111320 * math.cos(math.radians(37.7)), (c - a) * 110540)
    for i, la, lo, cat in rows:
        want = sorted({s[1] for s in stops if s[0] == "BART" and s[1] and flat(la, lo, s[2], s[3]) < 1700}) if cat == "a" else []
        assert got[i] == (want or ["own"])
    every = sum(cat == "a" and s[0] == "BART" and flat(la, lo, s[2], s[3]) < 1700 for _, la, lo, cat in rows for s in stops)
    assert sum(m.count() for m in met) < every / 2


def test_vertices_read_what_a_row_has_once(spark):
    """the cosine and the normal of a row stand outside of what is done at every vertex."""
    args = [F.col(x) for x in ("a", "b", "c", "d")]
    df = spark.createDataFrame([(37.0, -122.0, 37.5, -121.5)], "a double, b double, c double, d double")
    shapes_ = {"line": geo.bisector_polyline(*args, F.lit(10.0)), "half": geo.bisector_half_plane(*args, *args[2:], F.lit(10.0)), "ring": geo.circle_ring(*args[:2], args[2])}
    for name, shape in shapes_.items():
        plan = df.select(shape.alias("x"))._jdf.queryExecution().analyzed().toString()
        inner = plan[plan.rindex("sequence(") if name != "half" else plan.rindex("reverse(") :]
        assert "RADIANS" not in inner.upper() and "SQRT" not in inner.upper(), name
    got = df.select(*[v.alias(k) for k, v in shapes_.items()]).first()
    assert len(got["line"]) == 65 and len(got["half"]) == 130 and len(got["ring"]) == 72
    assert got["half"][:65] == got["line"] and abs(got["line"][32]["lat"] - 37.25) < 1e-12 and abs(max(p["lat"] for p in got["ring"]) - (37 + 37.5 / 69)) < 1e-9


def test_boxes_on_region_hold_no_tiles(spark):
    """neither tiles nor their corners are broadcast to the tasks that read the regions."""
    plan = QUERIES["boxes_on_region"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "_r" in x]


def test_left_stations_are_listed_a_few_at_a_time(spark, monkeypatch):
    """a task never holds the stations of all its games, however many these are; rows are those of one table."""
    import numpy as np
    import pyarrow as pa

    n, zero = 500, pa.array(np.zeros(500))
    bucket = B.Bucket(pa.table({"station_id": pa.array(range(n)), "sx": zero, "sy": zero, "sz": zero, "airport_m": zero, "elev": zero, "no_elev": pa.array([False] * n)}))
    qs = [[dict(zip(B.FIELDS, (B.AIRPORT, 0.0, 0.0, 0.0, -1.0, 0, True)))]] * 40
    games = pa.table({"game_id": pa.array(range(40)), "parts": pa.array([1] * 40), "qs": pa.array(qs)})
    monkeypatch.setattr(Q, "LISTED", 1_200)
    got = list(Q._ids(games, bucket))
    assert max(map(len, got)) == 1_500 and pa.concat_tables(got).num_rows == 40 * n
    assert set(zip(*[pa.concat_tables(got).column(c).to_pylist() for c in ("game_id", "station_id")])) == {(g, s) for g in range(40) for s in range(n)}
    st, q = X.stations(spark, SF), X.questions(spark, SF)
    assert "CoGroup" not in Q.eliminate(st, q, X.AIRPORTS)._jdf.queryExecution().executedPlan().toString()


def test_killers_make_no_row_of_a_game_and_a_bucket(spark, monkeypatch):
    """many buckets and groups; no game is copied to buckets, and what a game has of all of them needs no other shuffle."""
    monkeypatch.setattr(B, "BUCKET_BITS", 4)
    monkeypatch.setattr(B, "GROUP", 50)
    st, q = X.stations(spark, SF), X.questions(spark, SF)
    df = Q.first_killer_counts(st, q, X.AIRPORTS)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    v = Q.verdicts(st, q, X.AIRPORTS).where("not ok").groupBy("game_id", "station_id").agg(F.min("question_id").alias("first"), F.count("*").alias("n"))
    want = v.groupBy("game_id", "first").agg(F.count("*").alias("stations"), F.sum("n").alias("kills"))
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect()))
    assert Q.first_killer_counts(st, q.where("false"), X.AIRPORTS).count() == 0


def test_measures_by_marks_equal_comparisons(monkeypatch):
    """a stored bitmap and the stations up to it, at bounds of every kind."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(B, "MARK", 16)
    x = np.concatenate([np.random.default_rng(3).integers(0, 40, 190).astype(float), [np.nan, np.inf, -np.inf, 7.0]])
    zero, unknown = pa.array(np.zeros(len(x))), np.arange(len(x)) % 9 == 0
    bucket = B.Bucket(pa.table({"station_id": zero, "sx": zero, "sy": zero, "sz": zero, "airport_m": x, "elev": x, "no_elev": unknown}))
    for c in (-np.inf, -1.0, 0.0, 7.0, 7.5, 39.0, 40.0, np.inf, np.nan):
        for yes in (True, False):
            hit = (x >= c) == yes
            for code, want in ((B.AIRPORT, hit), (B.ELEVATION, hit | unknown)):
                assert (bucket.unpacked(bucket.agreeing(code, c, 0, yes))[: len(x)] == want).all(), (c, yes, code)


def test_left_counts_by_class_equal_the_rows(spark, capsys):
    """rules over classes of stations give what the rows of games and stations give; signs, null games and empty games too."""
    st = spark.createDataFrame([(i,) for i in (-7, -1, 0, 2, 5, 6, 9, 12, 40)], "station_id long").selectExpr("station_id", "station_id % 3 as a", "station_id * 7 % 4 as b")
    games = spark.createDataFrame([(i,) for i in (-5, 0, 1, 2, 3, 8, 39, None)], "game_id long")
    locked = spark.createDataFrame([(1, 2), (3, 6), (39, 40), (8, 77)], "game_id long, station_id long")
    base = games.crossJoin(st.select("station_id")).where("(station_id + game_id) % 3 <> 0 and game_id <> 0")
    manual = base.where("(station_id * 7 + game_id) % 4 = 0 or game_id = 2")
    want = Q.left_counts(base, manual, locked)
    got = Q.left_counts_by_class(games, st, F.expr("(a + game_id) % 3 <> 0 and game_id <> 0"), F.expr("(b + game_id) % 4 = 0 or game_id = 2"), locked)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and 2 not in {r["game_id"] for r in got.collect()}
    assert dict(got.dtypes) == dict(want.dtypes)
    capsys.readouterr()
    QUERIES["manual_and_endgame"](spark, SF).explain()
    assert "explode" not in capsys.readouterr().out


def test_snap_makes_no_pairs(spark, monkeypatch):
    """long, short and level segments, points beside cells, at high latitudes and without a place, against all segments; no join makes pairs."""
    r = random.Random(3)
    monkeypatch.setattr(L, "SNAPPED", 40)
    for lat0, span, most in ((37.5, 0.2, 900.0), (-0.05, 0.1, 400.0), (84.9, 0.1, 700.0), (10.0, 20.0, 30_000.0)):
        vs = [(i // 6, ("A", "B")[i // 6 % 2], i, lat0 + span * r.random(), -0.2 + span * r.random()) for i in range(60)]
        vs += [(90, "A", i, lat0 + span / 2, 0.01 * i) for i in range(3)] + [(91, "B", 0, lat0, 0.0), (91, "B", 1, lat0, 0.0), (92, None, 0, lat0, 0.0), (92, None, 1, lat0, 0.1)]
        ps = [(i, ("A", "B", None)[i % 3 if i % 9 == 2 else i % 2], lat0 + span * r.random(), -0.2 + span * r.random()) for i in range(300)] + [(300, "A", None, 0.0), (301, "B", lat0, float("nan"))]
        df = L.snap_to_lines(spark.createDataFrame(ps, "station_id long, system string, lat double, lon double"), spark.createDataFrame(vs, "line long, system string, seq long, lat double, lon double"), most / 4, most)
        got = {x["station_id"]: x for x in df.collect()}
        assert len(got) == len(ps)
        some = 0
        for i, sys, la, lo in ps:
            best = None
            for a, b in zip(vs, vs[1:]):
                if a[0] == b[0] and a[1] == sys and sys and la is not None:
                    kx = 111320 * math.cos(math.radians(la))
                    ax, ay, dx, dy = (a[4] - lo) * kx, (a[3] - la) * 110540, (b[4] - a[4]) * kx, (b[3] - a[3]) * 110540
                    t = max(0, min(1, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) if dx or dy else 0
                    d = math.hypot(ax + t * dx, ay + t * dy)
                    best = min(best, (d, la + (ay + t * dy) / 110540)) if best else (d, la + (ay + t * dy) / 110540)
            if best is None or not best[0] <= most:
                assert got[i]["d"] is None and not got[i]["moved"]
            else:
                some += 1
                assert abs(got[i]["d"] - best[0]) < 1e-6 and got[i]["moved"] == (best[0] > most / 4)
                assert abs(got[i]["lat"] - (best[1] if got[i]["moved"] else la)) < 1e-9
        assert some > 20
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_tentacle_counts_pass_buckets_by(spark, monkeypatch):
    """counts of all buckets come out of one task, inner places are left out for stations outside, and nothing else changes."""
    import numpy as np

    r = np.random.default_rng(4)
    po = [(i, 37.5 + 0.1 * a, -122.3 + 0.1 * b) for i, (a, b) in enumerate(r.random((1500, 2)).tolist())] + [(2000, 37.55, -122.25), (2001, 37.55, -122.25)]
    st = [(i, 37.4 + 0.3 * a, -122.4 + 0.3 * b) for i, (a, b) in enumerate(r.random((700, 2)).tolist())] + [(900, None, 1.0)]
    games = [(i, "a", 37.5 + 0.1 * a, -122.3 + 0.1 * b) for i, (a, b) in enumerate(r.random((12, 2)).tolist())]
    lat, lon = np.array([p[1] for p in po]), np.array([p[2] for p in po])
    hemmed = T._hemmed(lat, lon)
    assert np.isfinite(hemmed).mean() > 0.5
    for i in np.flatnonzero(np.isfinite(hemmed))[:50]:  # as far as it says there is a place in each direction
        near = T._haversine(lat[i], lon[i], lat, lon) <= hemmed[i]
        ways = np.degrees(np.arctan2(lat[near] - lat[i], (lon[near] - lon[i]) * np.cos(np.radians(lat[i]))))[(lat[near] != lat[i]) | (lon[near] != lon[i])]
        assert len(set((ways // 45).astype(int))) == 8
    monkeypatch.setattr(T, "BUCKET_BITS", 7)
    monkeypatch.setattr(T, "COUNTED", 5)
    df = T.tentacle_counts(spark.createDataFrame(st, "station_id long, lat double, lon double"), spark.createDataFrame([(i, "a", a, b) for i, a, b in po], "poi_id long, category string, lat double, lon double"), spark.createDataFrame(games, "game_id long, category string, lat double, lon double"), 3000.0)
    want = {}
    for g, _, la, lo in games:
        reach = np.flatnonzero(T._haversine(la, lo, lat, lon) <= 3000.0)
        for _, a, b in st:
            p = po[reach[0] if a is None else reach[np.argmin(T._haversine(a, b, lat[reach], lon[reach]))]][0]
            want[g, p] = want.get((g, p), 0) + 1
    assert sorted(map(tuple, df.collect())) == sorted((g, p, n) for (g, p), n in want.items())
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("MapInArrow") and "CoGroup" not in plan


def test_counts_below_meet_no_pairs(spark):
    """many asks and values in one bin are sorted together; equal ones aren't under one another, and every ask has its row."""
    v = spark.range(4000).selectExpr("'g' || id % 2 as g", "double(id % 500) / 100 as x").unionByName(spark.createDataFrame([("g0", None)], "g string, x double"))
    q = spark.range(3000).selectExpr("id", "'g' || id % 3 as g", "double(id % 700) / 100 as t")
    df = J.counts_below(v, q, "id", ["g"], 50.0)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1  # of bins
    vals = {}
    for r in v.where("x is not null").collect():
        vals.setdefault(r["g"], []).append(r["x"])
    assert sorted(map(tuple, df.collect())) == [(r["id"], sum(x < r["t"] for x in vals.get(r["g"], []))) for r in q.orderBy("id").collect()]


def test_nearest_one_equals_all_distances(spark, monkeypatch):
    """cells of any width, rows far from all, ties by id, without a place or a category; no window over pairs."""
    rows, left = points(spark, 300, 8)
    places, _ = points(spark, 200, 9)
    places += [(900 + i, *places[i][1:]) for i in range(30)]
    rows += [(1000, 10.0, 20.0, "a"), (1001, 37.5, -122.3, "none"), (1002, None, 1.0, "b"), (1003, 37.5, -122.3, None)]
    kind = "lat double, lon double, category string"
    left, right = spark.createDataFrame(rows, "id long, " + kind), spark.createDataFrame(places, "poi_id long, " + kind)
    want = {}
    for i, la, lo, cat in rows:
        of = [p for p in places if p[3] == cat]
        if of:
            want[i] = min(p[0] for p in of) if la is None else min(of, key=lambda p: (hav(la, lo, p[1], p[2]), p[0]))[0]
    for most in (3, 40, 100_000):
        monkeypatch.setattr(J, "CELL_ROWS", most)
        got = J.nearest_one(left, right, "id", "poi_id", ["category"])
        assert {r["id"]: r["poi_id"] for r in got.collect()} == want and got.count() == len(want)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
