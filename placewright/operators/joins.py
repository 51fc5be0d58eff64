"""Distance joins without a cross product: equal cells first, the exact distance after.

Cells are at least as wide as the radius at their latitude, and columns go around the globe, so all partners of a point lie
in the 3 x 3 cells around its own. One side is copied to these, the other isn't, so that every pair meets once.
Cells of a dense town can be hot: adaptive execution splits such join partitions, as nothing above the join needs a cell's rows together.
Both sides are shuffled, never broadcast: the planner takes the copied side for as large as its file, which is a tenth of what the
driver would have to hold. Joins that keep one partner of a row (`nearest`, `nearest_within`, `first_within`) go in rounds, so that
their pairs follow the rows and not rows times density; `linked` gives what components need without all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewright.functions import geo
from placewright.plans.graph import components
from placewright.plans.passing import passing
from placewright.plans.tables import written

from .tentacles import Boxes

Metric = Callable[[Column, Column, Column, Column], Column]


def _prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.select([F.col(c).alias(p + c) for c in df.columns])


def within(left: DataFrame, right: DataFrame, meters: float, metric: Metric = geo.haversine_m, strict: bool = False, by: list[str] | None = None, copy: str = "left") -> DataFrame:
    """All pairs at most (strict: under) `meters` apart, with equal `by` columns: l_*, r_* and `d`.

    Both sides have lat and lon. Points with a null coordinate have no partner. `copy`: the side that is copied to the cells
    around a point, best the smaller one; the pairs are the same.
    """
    by = by or []
    a, b = _prefixed(left, "l_"), _prefixed(right, "r_")
    cells_a, cells_b = (geo.with_near_cells, geo.with_cell) if copy == "left" else (geo.with_cell, geo.with_near_cells)
    a, b = cells_a(a, "l_lat", "l_lon", meters, "_cell"), cells_b(b, "r_lat", "r_lon", meters, "_cell")
    for k in by:
        a, b = a.withColumn(f"_by_{k}", F.col(f"l_{k}")), b.withColumn(f"_by_{k}", F.col(f"r_{k}"))
    keys = ["_cell", *(f"_by_{k}" for k in by)]
    out = a.join(b.hint("merge"), keys).withColumn("d", metric(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon")))
    return out.where(F.col("d") < meters if strict else F.col("d") <= meters).drop(*keys)


def nearest_within(left: DataFrame, right: DataFrame, meters: float, key: str, other: str, metric: Metric = geo.haversine_m, strict: bool = False, by: list[str] | None = None, copy: str = "left") -> DataFrame:
    """J2, T6. For each left key its nearest right row within `meters`, the least id on a tie: key, other, d.

    The radius starts where a few partners are usual and grows fourfold up to `meters`: what is nearest inside is nearest of all.
    """
    best = F.min(F.struct("d", f"r_{other}")).alias("b")
    radius, found, todo = _start_radius(right, by or [], 1, meters), None, left
    while True:
        last = radius >= meters
        pairs = within(todo, right, min(radius, meters), metric, strict and last, by, copy)
        got = pairs.groupBy(F.col(f"l_{key}").alias(key)).agg(best).select(key, F.col(f"b.r_{other}").alias(other), F.col("b.d").alias("d"))
        if last:
            return got if found is None else _least_of(found.unionByName(got), key, ["d", other])
        got = written(got, "nearest")
        found = got if found is None else found.unionByName(got)
        todo = written(todo.join(got.select(key).hint("merge"), key, "left_anti"), "farther")
        if todo.isEmpty():
            return _least_of(found, key, ["d", other])
        radius *= 4


def _least_of(found: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row of each key. A null key is never taken out of the rows that go on, so it can have one of each round."""
    return found.groupBy(key).agg(F.min(F.struct(*order)).alias("b")).select(key, "b.*").select(found.columns)


def first_within(left: DataFrame, right: DataFrame, meters: float, key: str, order: list[str], ok: Column | None = None, by: list[str] | None = None, metric: Metric = geo.haversine_m) -> DataFrame:
    """For each left key the first right row in `order` that lies within `meters` and passes `ok`, a Column over l_* and r_*:
    key and the columns of `order`.

    Right rows are met in rounds, each up to a fourfold share of them in order; a left row that has one is done, as all that come
    before were met as well. So pairs follow the left rows however dense the right ones are. An order by other than a number is met in one round.
    """
    names = [f"r_{c}" for c in order]
    best = F.min(F.struct(*names)).alias("b")
    found, todo = None, left
    for most in [*_shares(right, by or [], meters, order[0]), None]:
        some = right if most is None else right.where(F.coalesce(F.col(order[0]) <= F.lit(most), F.lit(True)))
        pairs = within(todo, some, meters, metric, by=by)
        got = (pairs if ok is None else pairs.where(ok)).groupBy(F.col(f"l_{key}").alias("_key")).agg(best)
        got = got.select(F.col("_key").alias(f"l_{key}"), *[F.col(f"b.{n}").alias(n) for n in names])
        if most is None:
            found = got if found is None else _least_of(found.unionByName(got), f"l_{key}", names)
            break
        got = written(got, "first")
        found = got if found is None else found.unionByName(got)
        todo = written(todo.join(got.select(F.col(f"l_{key}").alias(key)).hint("merge"), key, "left_anti"), "later")
        if todo.isEmpty():
            found = _least_of(found, f"l_{key}", names)
            break
    return found


#: Right rows in the 3 x 3 cells of a left row that the first round of `first_within` meets, about.
FIRST_MET = 16


def _shares(right: DataFrame, by: list[str], meters: float, order: str) -> list:
    """Bounds of `order` below which a growing share of the right rows lies; none where a row usually has few around it."""
    usual = density(right, by, meters)
    share = FIRST_MET / (9 * usual) if usual else 1.0
    numeric = right.schema[order].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double")
    if share >= 0.5 or not numeric:
        return []
    shares = [share * 4**i for i in range(math.ceil(math.log(1 / share, 4))) if share * 4**i < 0.8]
    return right.select(F.col(order).cast("double").alias("x")).approxQuantile("x", shares, max(share / 8, 1e-5))


def linked(points: DataFrame, key: str, meters: float, metric: Metric = geo.haversine_m, strict: bool = False, by: list[str] | None = None, known: DataFrame | None = None) -> DataFrame:
    """Edges a, b with the components of all pairs of keys that `within` finds, each with itself too, and of the edges `known`.

    Rows of a cell a third as wide as the radius are compared with their least one, and these least ones with one another. That
    joins all rows of a dense place; only where cells around a row still have several components its pairs are looked at.
    """
    by = by or []
    near = lambda d: d < meters if strict else d <= meters
    c = F.col
    p = points.select(c(key).alias("id"), "lat", "lon", *by).where("id is not null and lat is not null and lon is not null")
    p = geo.with_cell(p, "lat", "lon", meters / 3, "_cell")
    least = p.groupBy("_cell", *by).agg(F.min(F.struct("id", "lat", "lon")).alias("m"))
    own = p.join(least.hint("merge"), ["_cell", *by]).where(near(metric(c("lat"), c("lon"), c("m.lat"), c("m.lon")))).select(c("id").alias("a"), c("m.id").alias("b"))
    alone = p.where(near(metric(c("lat"), c("lon"), c("lat"), c("lon")))).select(c("id").alias("a"), c("id").alias("b"))
    heads = least.select("m.*", *by)
    between = within(heads, heads, meters, metric, strict, by).where("l_id < r_id").select(c("l_id").alias("a"), c("r_id").alias("b"))
    edges = own.unionByName(alone).unionByName(between)
    edges = edges if known is None else edges.unionByName(known.select("a", "b"))
    roots = written(components(edges), "linked")
    q = written(p.drop("_cell").join(roots.hint("merge"), "id"), "linked-points")
    mixed = geo.with_near_cells(q, "lat", "lon", meters, "_cell").groupBy("_cell", *by).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    open_ = written(geo.with_cell(q, "lat", "lon", meters, "_cell").join(mixed.select("_cell", *by).hint("merge"), ["_cell", *by], "left_semi").drop("_cell"), "open-points")
    cross = within(open_, open_, meters, metric, strict, by).where("l_root < r_root").select(c("l_root").alias("a"), c("r_root").alias("b")).distinct()
    return roots.select(c("id").alias("a"), c("root").alias("b")).unionByName(cross)


def nearest(left: DataFrame, right: DataFrame, key: str, other: str, k: int = 1, by: list[str] | None = None, start_m: float = 5_000.0, rounds: int = 12) -> DataFrame:
    """J19. The k nearest right rows of each left row, without a radius: key, other, d, rank.

    The radius starts where the right side's usual density lets expect k + 2 partners, at start_m at most, so pairs follow the
    left rows however dense the right ones are. It grows fourfold in rounds: left rows with k partners inside are done, exactly,
    as anything nearer would be inside as well; only the others go on. What is left after the last round, where the radius spans the globe, is
    compared with all rows of its `by` group.
    """
    by = by or []
    # Dealt by key: a row costs far more than its bytes, and where the right side is broadcast the cut below needs no other shuffle.
    todo = left.repartition(3 * left.sparkSession.sparkContext.defaultParallelism, key)
    found, radius = None, _start_radius(right, by, k, start_m)
    w, every = Window.partitionBy("l_" + key).orderBy("d", "r_" + other), Window.partitionBy("l_" + key)
    have = right.select(*by).distinct() if by else None
    if have is not None:
        todo = todo.join(have, by, "left_semi")
    for _ in range(rounds):
        if radius > 800_000:
            break
        # The k first of a key are cut before the shuffle and again after it; only then are they counted.
        firsts = within(todo, right, radius, by=by).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        done = firsts.withColumn("_n", F.count("*").over(every)).where(F.col("_n") >= k)
        done = written(done.select(F.col("l_" + key).alias(key), F.col("r_" + other).alias(other), "d", "rank"), "nearest")
        found = done if found is None else found.unionByName(done)
        todo = written(todo.join(done.where("rank = 1").select(key).hint("merge"), key, "left_anti"), "farther")
        if todo.isEmpty():
            return found
        radius *= 4
    a, b = _prefixed(todo, "l_"), _prefixed(right, "r_")
    on = [F.col(f"l_{c}") == F.col(f"r_{c}") for c in by] or [F.lit(True)]
    rest = a.join(b, on).withColumn("d", geo.haversine_m(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon")))
    rest = rest.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    rest = rest.select(F.col("l_" + key).alias(key), F.col("r_" + other).alias(other), "d", "rank")
    return rest if found is None else found.unionByName(rest)


#: Right rows in a cell of `nearest_one`, about, where these usually lie.
CELL_ROWS = 4_000


def nearest_one(left: DataFrame, right: DataFrame, key: str, other: str, by: list[str]) -> DataFrame:
    """`nearest` for k = 1: key, other, d, a row for each left row.

    Right rows go to the cells around them and are held there while left rows pass by, which boxes within boxes compare with a few of them
    (tentacles.Boxes). So no pair is made, and no row of a left one but the answer. What has no right row in reach goes on to cells four times as wide.
    """
    c, found = F.col, None
    names = [key, *by, "lat", "lon"]
    usual = density(right, by, 5_000.0)
    radius = min(100_000.0, max(5.0, 5_000.0 * math.sqrt(CELL_ROWS / usual))) if usual else 1e9
    known = lambda df: F.abs(c("lat").cast("double") + c("lon").cast("double")) < float("inf")
    todo = left.join(right.select(*by).distinct(), by, "left_semi").select(names)
    kinds = {n: left.schema[n].dataType.simpleString() for n in names} | {other: right.schema[other].dataType.simpleString(), "_lat": "double", "_lon": "double"}

    def run(rows: Iterator[tuple[bool, pa.RecordBatch]]) -> Iterator[pa.Table]:
        held, table = [], None
        for is_held, part in rows:
            if is_held:
                held.append(part)
                continue
            if not held:
                yield pa.Table.from_batches([part]).select(list(kinds))
                continue
            own = {n: part.column(n) for n in part.schema.names}
            table = table or pa.Table.from_batches(held).sort_by(other)
            at = Boxes(*[part.column(n).to_numpy() for n in ("lat", "lon")]).nearest(*[table.column(n).to_numpy() for n in ("_lat", "_lon")])
            yield pa.table(own | dict(zip(table.column_names, table.take(pa.array(at)).columns))).select(list(kinds))

    while radius < 800_000:
        p = geo.with_near_cells(right.where(known(right)).select(c(other), *by, c("lat").cast("double").alias("_lat"), c("lon").cast("double").alias("_lon")), "_lat", "_lon", radius, "_cell")
        q = geo.with_cell(todo.where(known(todo)), "lat", "lon", radius, "_cell").withColumns({n: c(n).cast("double") for n in ("lat", "lon")} | {n: F.lit(None).cast(kinds[n]) for n in (other, "_lat", "_lon")})
        cells = ["_cell", *[f"_by_{n}" for n in by]]
        named = lambda df: df.withColumns({f"_by_{n}": c(n) for n in by})
        met = passing(named(p).drop(*by), named(q), cells, [], None, run, ", ".join(f"{n} {t}" for n, t in (kinds | {"lat": "double", "lon": "double"}).items()))
        met = met.withColumn("d", geo.haversine_m(c("lat"), c("lon"), c("_lat"), c("_lon")))
        met = written(met.unionByName(todo.where(~F.coalesce(known(todo), F.lit(False))), allowMissingColumns=True), "nearest")
        near = F.coalesce(c("d") <= radius, F.lit(False))
        done = met.where(near).select(key, other, "d")
        found = done if found is None else found.unionByName(done)
        todo = met.where(~near).select(names)
        if todo.isEmpty():
            return found
        radius *= 4
    a, b = todo.withColumn("_row", F.monotonically_increasing_id()), _prefixed(right, "r_")
    rest = a.join(b, [c(n) == c(f"r_{n}") for n in by] or [F.lit(True)]).withColumn("d", geo.haversine_m(c("lat"), c("lon"), c("r_lat"), c("r_lon")))
    rest = rest.groupBy("_row", key).agg(F.min(F.struct(c("d").isNull().alias("_no"), "d", f"r_{other}")).alias("b")).select(key, c(f"b.r_{other}").alias(other), "b.d")
    return rest if found is None else found.unionByName(rest)


def density(right: DataFrame, by: list[str], meters: float) -> float | None:
    """Rows in the cell of a row, on average over rows, from counts by cell; one number comes to the driver."""
    x, y = geo.cell(F.col("lat"), F.col("lon"), meters)
    n = right.where("lat is not null and lon is not null").groupBy(*by, x.alias("_x"), y.alias("_y")).agg(F.count("*").cast("double").alias("_n"))
    return n.agg((F.sum(F.col("_n") * F.col("_n")) / F.sum("_n")).alias("m")).first()["m"]


def _start_radius(right: DataFrame, by: list[str], k: int, most: float) -> float:
    """The radius that holds k + 2 rows where a row usually lies."""
    usual = density(right, by, most)
    return max(most / 1024, min(most, most * math.sqrt((k + 2) / (math.pi * usual)))) if usual else most


def lines_of_stations(stations: DataFrame, stops: DataFrame, rebuilt: list[str], meters: float = 170.0) -> DataFrame:
    """J1. stations: station_id, system, lat, lon, lines; stops: system, line, lat, lon. The lines whose stops are under
    `meters` away in the same system; stations of other systems, and those without a stop near, keep their own.

    A station asks each line of its system for its nearest stop, so pairs follow stations x lines and not the stops around.
    """
    asks = stations.where(F.col("system").isin(rebuilt)).select("station_id", "system", "lat", "lon")
    asks = asks.join(stops.select("system", "line").distinct().hint("merge"), "system").withColumn("ask", F.struct("station_id", "line"))
    near = nearest_within(asks, stops.withColumn("stop", F.lit(0)), meters, "ask", "stop", geo.planar_m, strict=True, by=["system", "line"], copy="right")
    got = near.groupBy("ask.station_id").agg(F.collect_set("ask.line").alias("found"))
    return stations.join(got, "station_id", "left").withColumn("lines", F.array_sort(F.coalesce("found", "lines"))).drop("found")


def first_anchor(points: DataFrame, anchors: DataFrame, meters: float = 250.0) -> DataFrame:
    """J4. points: id, lat, lon; anchors: label, ord, lat, lon. The first anchor in order, not the nearest, in reach."""
    return first_within(points, anchors, meters, "id", ["ord", "label"]).select(F.col("l_id").alias("id"), F.col("r_label").alias("label"))


def merge_lines_by_name(stations: DataFrame, patches: DataFrame) -> DataFrame:
    """J5. Adds the lines of `patches` (name, lines) to the stations of that name, sorted."""
    p = patches.groupBy("name").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("_more"))
    both = F.array_sort(F.array_union("lines", F.coalesce("_more", F.array().cast("array<string>"))))
    return stations.join(p, "name", "left").withColumn("lines", both).drop("_more")


def gap_audit(found: DataFrame, own: DataFrame) -> DataFrame:
    """J8. Rows of `found` (id, category, name, norm, lat, lon) that no own place covers: none under 0.3 km, and none
    under 1.5 km where one normalised name contains the other."""
    metric = lambda a, b, c, d: geo.planar_km(a, b, c, d) * 1000.0
    near = within(found, own, 1500.0, metric, strict=True, by=["category"])
    named = F.contains("l_norm", "r_norm") | F.contains("r_norm", "l_norm")
    covered = near.where((F.col("d") < 300.0) | named).select(F.col("l_id").alias("id"))
    return found.join(covered.distinct(), "id", "left_anti")


def new_candidates(found: DataFrame, own: DataFrame) -> DataFrame:
    """J9. Rows of `found` that aren't there yet: no own place of the category with the same normalised name anywhere,
    and none under 0.4 km whose words contain, or are contained in, its words (tokens: array)."""
    left = found.join(own.select("category", "norm").distinct(), ["category", "norm"], "left_anti")
    metric = lambda a, b, c, d: geo.planar_km(a, b, c, d) * 1000.0
    near = within(left, own, 400.0, metric, strict=True, by=["category"])
    sub = (F.size(F.array_except("l_tokens", "r_tokens")) == 0) | (F.size(F.array_except("r_tokens", "l_tokens")) == 0)
    return left.join(near.where(sub).select(F.col("l_id").alias("id")).distinct(), "id", "left_anti")


def verified_hits(candidates: DataFrame, hits: DataFrame, allowed: Column, meters: float = 350.0) -> DataFrame:
    """J10. candidates: cand_id, category, lat, lon, coarse; hits: cand_id, ord, hit_id, primary_type, name, lat, lon.

    A coarse candidate (address only) takes its first hit of an allowed type, any other its nearest hit within `meters`,
    which then must be of an allowed type. allowed: a Column over category, primary_type and name.
    """
    h = hits.withColumnsRenamed({"lat": "hit_lat", "lon": "hit_lon"})
    metric = geo.planar_km(F.col("lat"), F.col("lon"), F.col("hit_lat"), F.col("hit_lon")) * 1000.0
    j = candidates.join(h, "cand_id").withColumns({"d": metric, "ok": F.coalesce(allowed, F.lit(False))})
    j = j.where(F.when(F.col("coarse"), F.col("ok")).otherwise(F.col("d") <= meters))
    first = F.struct(F.when(F.col("coarse"), F.lit(0.0)).otherwise(F.col("d")).alias("d"), "ord", "hit_id", "ok")
    best = j.groupBy("cand_id", "category").agg(F.min(first).alias("b")).where("b.ok")
    return best.select("cand_id", "category", "b.hit_id")


def backfill(own: DataFrame, new: DataFrame, meters: float = 60.0) -> DataFrame:
    """J11. `own` and those rows of `new` whose id isn't known and that have no place of the same lower-case name under
    `meters` away; of new rows in conflict with one another the first (ord) wins. Running it again adds nothing."""
    lower = lambda df: df.withColumn("_low", F.lower("name"))
    fresh = lower(new).join(own.select("category", "id"), ["category", "id"], "left_anti").dropDuplicates(["category", "id"])
    metric = lambda a, b, c, d: geo.planar_m(a, b, c, d, math.degrees(math.acos(88.0 / 111.32)), 111_000.0)
    known = within(fresh, lower(own), meters, metric, strict=True, by=["category", "_low"]).select(F.col("l_id").alias("id"), F.col("l_category").alias("category"))
    fresh = fresh.join(known.distinct(), ["category", "id"], "left_anti")
    again = within(fresh, fresh, meters, metric, strict=True, by=["category", "_low"]).where("r_ord < l_ord")
    again = again.select(F.col("l_id").alias("id"), F.col("l_category").alias("category")).distinct()
    added = fresh.join(again, ["category", "id"], "left_anti").drop("_low", "ord")
    return own.unionByName(added, allowMissingColumns=True)


def enriched(rows: DataFrame, cache: DataFrame, key: str, column: str) -> DataFrame:
    """J12. Fills nulls of `column` from a keyed table; known values stay."""
    c = cache.select(key, F.col(column).alias("_new")).dropDuplicates([key])
    return rows.join(c, key, "left").withColumn(column, F.coalesce(column, "_new")).drop("_new")


def nested_flags(pois: DataFrame, meters: float = 800.0, ratio: int = 3) -> DataFrame:
    """J13. poi_id and the place it may be part of: of its category, within `meters`, with at least `ratio` times its
    reviews; the first by id."""
    seen = pois.select("poi_id", "category", "lat", "lon", F.coalesce("reviews", F.lit(0)).alias("n")).withColumn("need", ratio * F.greatest("n", F.lit(1)))
    # Only those that some place around has the reviews for are looked at, and only places that have them for any.
    most = geo.with_near_cells(seen, "lat", "lon", meters, "_cell").groupBy("_cell", "category").agg(F.max("n").alias("most"))
    small = geo.with_cell(seen, "lat", "lon", meters, "_cell").join(most, ["_cell", "category"]).where("most >= need").drop("_cell", "most")
    ok = (F.col("r_n") >= F.col("l_need")) & (F.col("l_poi_id") != F.col("r_poi_id"))
    got = first_within(small, seen.where(F.col("n") >= ratio), meters, "poi_id", ["poi_id"], ok, ["category"])
    return got.select(F.col("l_poi_id").alias("poi_id"), F.col("r_poi_id").alias("nested_in"))


def baseline_diff(now: DataFrame, before: DataFrame, key: str, value: str) -> DataFrame:
    """J15, V4. key, status (same, CHANGED, new, REMOVED), was, is."""
    j = now.select(key, F.col(value).alias("is")).join(before.select(key, F.col(value).alias("was")), key, "full_outer")
    status = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "REMOVED").when(F.col("is") == F.col("was"), "same").otherwise("CHANGED")
    return j.select(key, status.alias("status"), "was", "is")


def counts_below(values: DataFrame, asks: DataFrame, key: str, by: list[str], width: float) -> DataFrame:
    """How many `values` (by, x) are under the bound `t` of each ask (key, by, t), without meeting them all: key, below.

    Values are counted in bins of `width` and the bins' counts added up in order; inside a bin asks and values are sorted together and a
    running sum gives what is under each ask, so no ask meets a value, however many share a bin. What one task adds up are bins, so range
    over width, or the different values of one bin. Null values and bounds are under nothing and above nothing.
    """
    b = lambda c: F.floor(F.col(c) / width).alias("_bin")
    none = F.lit(None).cast(asks.schema[key].dataType).alias(key)
    x = values.where("x is not null").groupBy(*by, "x").agg(F.count("*").alias("_n"))
    x = x.select(*by, b("x"), "x", F.lit(1).alias("_side"), "_n", none)
    a = asks.where("t is not null").select(*by, b("t"), F.col("t").cast(values.schema["x"].dataType).alias("x"), F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_n"), key)
    rows = x.unionByName(a)
    bins = rows.groupBy(*by, "_bin").agg(F.sum("_n").alias("_n"))
    lower = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*by, "_bin", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_under"))
    own = Window.partitionBy(*by, "_bin").orderBy("x", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_own", F.sum("_n").over(own)).where("_side = 0")
    got = rows.join(bins, [*by, "_bin"], "left").select(key, (F.coalesce("_under", F.lit(0)) + F.col("_own")).cast("long").alias("below"))
    return got.unionByName(asks.where("t is null").select(key, F.lit(0).cast("long").alias("below")))


def nearest_match(stations: DataFrame, pois: DataFrame, seekers: DataFrame) -> DataFrame:
    """Q13, Q14. seekers: game_id, category, lat, lon. For each station of a game whether its nearest place of the
    category is the seeker's, and whether it is nearer to one than the seeker. One row for each game and station; where
    counts do, `nearest_match_counts` needs no such pairs."""
    s, q = _nearest_of(stations, pois, seekers)
    j = s.join(q, "category")
    return j.select("game_id", "station_id", (F.col("s_poi") == F.col("q_poi")).alias("same"), (F.col("s_d") < F.col("q_d")).alias("closer"))


def nearest_match_counts(stations: DataFrame, pois: DataFrame, seekers: DataFrame, width: float = 50.0) -> DataFrame:
    """Q13, Q14. game_id, same, closer, n: the counts of `nearest_match` by game. Stations are counted by nearest place
    and by distance first, so games meet counts, not stations."""
    s, q = _nearest_of(stations, pois, seekers)
    s, q = written(s, "station-places"), written(q, "seeker-places")
    same = s.groupBy("category", F.col("s_poi").alias("q_poi")).agg(F.count("*").alias("same"))
    total = s.groupBy("category").agg(F.count("*").alias("n"))
    closer = counts_below(s.select("category", F.col("s_d").alias("x")), q.select("game_id", "category", F.col("q_d").alias("t")), "game_id", ["category"], width)
    out = q.join(total, "category").join(same, ["category", "q_poi"], "left").join(closer, "game_id")
    return out.select("game_id", F.coalesce("same", F.lit(0)).alias("same"), F.col("below").alias("closer"), "n")


def _nearest_of(stations: DataFrame, pois: DataFrame, seekers: DataFrame) -> tuple[DataFrame, DataFrame]:
    cats = seekers.select("category").distinct()
    s = stations.select("station_id", "lat", "lon").crossJoin(cats).withColumn("key", F.struct("station_id", "category"))
    s = nearest_one(s, pois, "key", "poi_id", ["category"]).select("key.station_id", "key.category", F.col("poi_id").alias("s_poi"), F.col("d").alias("s_d"))
    q = nearest_one(seekers.withColumn("key", F.struct("game_id", "category")), pois, "key", "poi_id", ["category"])
    return s, q.select("key.game_id", "key.category", F.col("poi_id").alias("q_poi"), F.col("d").alias("q_d"))
