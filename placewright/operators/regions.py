"""Regions: exact point tests on rings, and region algebra on cell covers.

A region is rings of struct<lon, lat>; a cover is rows (region_id, cx, cy) of square cells `res` degrees wide. Covers are
exact as sets of cells and within one cell of the true border; `res` is an argument and goes with the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewright.plans.tables import written

from . import runs

#: Degrees of the rows that bring vertices and tiles together.
GRID = 0.05
#: Sides of all regions up to which no tree is built.
FEW_SIDES = 50_000
#: Levels between a region's extent and its leaves, at least.
LEAST_SPLIT = 4
M_PER_LAT = runs.M_PER_LAT


def edges_of(regions: DataFrame) -> DataFrame:
    """region_id, x1, y1, x2, y2 of every ring side; rings may repeat their first point."""
    r = regions.select("region_id", F.posexplode("rings").alias("ring", "pts")).select("region_id", "ring", F.posexplode("pts").alias("i", "p"), F.col("pts").alias("_all"))
    n = F.size("_all")
    nxt = F.get("_all", (F.col("i") + 1) % n)
    e = r.select("region_id", F.col("p.lon").alias("x1"), F.col("p.lat").alias("y1"), nxt["lon"].alias("x2"), nxt["lat"].alias("y2"))
    return e.where("x1 <> x2 or y1 <> y2")


def boxes(regions: DataFrame) -> DataFrame:
    """A14. Bounding box and mean vertex latitude of each region."""
    p = regions.select("region_id", F.explode(F.flatten("rings")).alias("p"))
    return p.groupBy("region_id").agg(F.min("p.lon").alias("w"), F.max("p.lon").alias("e"), F.min("p.lat").alias("s"), F.max("p.lat").alias("n"), F.avg("p.lat").alias("mid"))


def hierarchy(regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, sides): the quadtree cover of each region, and its sides by row of leaves.

    cells: region_id, level, x, y, full. A cell of a level is 360 / 2 ** level degrees wide and high. A leaf that a side runs
    through is partial; a full cell is the largest one without a side that lies inside. Leaves are a 16th of the region's
    extent, or finer for regions of many sides, so that a row of leaves has a few sides. sides: region_id, y (row of leaves at
    the region's own level), x1, y1, x2, y2.
    """
    e = edges_of(regions)
    b = e.groupBy("region_id").agg(F.min(F.least("x1", "x2")).alias("w"), F.max(F.greatest("x1", "x2")).alias("e"), F.min(F.least("y1", "y2")).alias("s"), F.max(F.greatest("y1", "y2")).alias("n"), F.count("*").alias("sides"))
    split = F.greatest(F.lit(LEAST_SPLIT), F.least(F.lit(16), F.ceil(F.log2(F.col("sides") / 8)))).cast("int")
    extent = F.greatest(F.col("e") - F.col("w"), F.col("n") - F.col("s"), F.lit(1e-7))
    b = b.withColumn("leaf", F.least(F.floor(F.log2(360.0 / extent)) + split, F.lit(40)).cast("int")).withColumn("split", split)
    b = b.withColumn("k", F.pow(F.lit(2.0), "leaf") / 360.0)
    at = lambda v, k: F.floor(v * k).cast("long")
    pad = 1e-6 / F.col("k")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    sides = e.join(b.select("region_id", "leaf", "split", "k"), "region_id").withColumn("y", F.explode(F.sequence(at(low - pad, F.col("k")), at(high + pad, F.col("k")))))
    x_at = lambda y: F.when(F.col("y1") == F.col("y2"), F.col("x1")).otherwise(F.col("x1") + (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")))
    inside = lambda y: F.least(F.greatest(y, low), high)
    a, c = x_at(inside(F.col("y") / F.col("k"))), F.when(F.col("y1") == F.col("y2"), F.col("x2")).otherwise(x_at(inside((F.col("y") + 1) / F.col("k"))))
    leaves = sides.select("region_id", "leaf", "split", "y", F.explode(F.sequence(at(F.least(a, c) - pad, F.col("k")), at(F.greatest(a, c) + pad, F.col("k")))).alias("x")).distinct()
    leaves = written(leaves, "leaves")
    up = leaves.select("region_id", "leaf", "x", "y", F.explode(F.sequence(F.lit(0), "split")).alias("up"))
    shift = lambda c: F.expr(f"shiftright({c}, up)")
    partial = up.select("region_id", (F.col("leaf") - F.col("up")).alias("level"), "leaf", shift("x").alias("x"), shift("y").alias("y")).distinct()
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    below = partial.where("level < leaf").select("region_id", (F.col("level") + 1).alias("level"), "leaf", F.col("x") * 2, F.col("y") * 2, corner.alias("o")).toDF("region_id", "level", "leaf", "x", "y", "o")
    below = below.select("region_id", "level", "leaf", (F.col("x") + F.col("o.i")).alias("x"), (F.col("y") + F.col("o.j")).alias("y"))
    # A cell of the topmost level is as large as the region, so it has a side or lies outside.
    free = below.join(partial, ["region_id", "level", "leaf", "x", "y"], "left_anti")
    k = F.pow(F.lit(2.0), F.col("level")) / 360.0
    centres = free.select("region_id", F.struct("level", "x", "y").alias("id"), ((F.col("x") + 0.5) / k).alias("lon"), ((F.col("y") + 0.5) / k).alias("lat"), "leaf")
    centres = centres.withColumn("y", at(F.col("lat"), F.pow(F.lit(2.0), F.col("leaf")) / 360.0))
    sides = sides.select("region_id", "y", "x1", "y1", "x2", "y2")
    full = _tested(centres, sides, "id", "evenodd").select("region_id", "id.level", "id.x", "id.y", F.lit(True).alias("full"))
    cells = leaves.select("region_id", F.col("leaf").alias("level"), "x", "y", F.lit(False).alias("full")).unionByName(full)
    return written(cells, "quadtree"), sides


def _tested(points: DataFrame, sides: DataFrame, key: str, boundary: str) -> DataFrame:
    """(key, region_id) of points (key, region_id, y, lat, lon) inside that region, by the sides in their row of leaves."""
    return _inside(points.join(sides, ["region_id", "y"]), key, boundary)


def _inside(j: DataFrame, key: str, boundary: str) -> DataFrame:
    """(key, region_id) of the points inside. j: points with all sides of a region that span their latitude."""
    spans = (F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))
    crosses = spans & (F.col("lon") < (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    cross = (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) - (F.col("y2") - F.col("y1")) * (F.col("lon") - F.col("x1"))
    on = (F.abs(cross) < 1e-12) & F.col("lat").between(F.least("y1", "y2"), F.greatest("y1", "y2")) & F.col("lon").between(F.least("x1", "x2"), F.greatest("x1", "x2"))
    g = j.groupBy(key, "region_id").agg((F.count_if(crosses) % 2 == 1).alias("inside"), F.bool_or(on).alias("border"))
    keep = {"evenodd": F.col("inside"), "covers": F.col("inside") | F.col("border"), "contains": F.col("inside") & ~F.col("border")}[boundary]
    return g.where(keep).select(key, "region_id")


def points_in_regions(points: DataFrame, regions: DataFrame, boundary: str = "evenodd", key: str = "id", tree: bool | None = None) -> DataFrame:
    """J6. (key, region_id) of points (lat, lon) inside regions, holes out by the even-odd rule. Keys are unique.

    boundary: 'evenodd' as crossings fall, 'covers' with border points in, 'contains' with them out. Points meet the regions'
    quadtree by equality, once for each level in use. In a full cell that is the answer; only points in partial leaves meet
    sides, those of that region in their row of leaves. Building the tree pays where there are many sides; up to FEW_SIDES
    points meet the sides in their row of a fixed grid, shuffled, as the planner would hold the points in every task. tree: True, False force either.
    """
    if not (regions.select(F.sum(F.aggregate("rings", F.lit(0), lambda a, r: a + F.size(r))).alias("n")).first()["n"] or 0) > FEW_SIDES if tree is None else not tree:
        row = lambda y: F.floor(y / GRID).cast("long")
        e = edges_of(regions)
        box = e.groupBy("region_id").agg(F.min(F.least("x1", "x2")).alias("w"), F.max(F.greatest("x1", "x2")).alias("e"))
        e = e.withColumn("_r", F.explode(F.sequence(row(F.least("y1", "y2")), row(F.greatest("y1", "y2"))))).join(box, "region_id")
        p = points.select(key, "lat", "lon").where("lat is not null and lon is not null").withColumn("_r", row(F.col("lat")))
        return _inside(p.join(e.hint("merge"), "_r").where(F.col("lon").between(F.col("w"), F.col("e"))), key, boundary)
    cells, sides = hierarchy(regions)
    levels = sorted(r["level"] for r in cells.select("level").distinct().collect())  # 41 numbers at most
    if not levels:
        return points.select(key).limit(0).crossJoin(regions.select("region_id").limit(0))
    at = lambda v, z: F.floor(F.col(v) * (2.0**z / 360.0)).cast("long")
    places = F.array(*[F.struct(F.lit(z).alias("level"), at("lon", z).alias("x"), at("lat", z).alias("y")) for z in levels])
    p = points.select(key, "lat", "lon").where("lat is not null and lon is not null").withColumn("_p", F.explode(places)).select(key, "lat", "lon", "_p.*")
    met = p.join(cells, ["level", "x", "y"])
    near = met.where("not full").select(key, "region_id", "y", "lat", "lon")
    return met.where("full").select(key, "region_id").unionByName(_tested(near, sides, key, boundary))


def clip(pois: DataFrame, strict: DataFrame, wide: DataFrame, natural: list[str], key: str = "poi_id") -> DataFrame:
    """P11. Places of natural categories must lie in `strict`, all others in `wide` (its buffered form)."""
    a = points_in_regions(pois.where(F.col("category").isin(natural)), strict, "contains", key).select(key)
    b = points_in_regions(pois.where(~F.col("category").isin(natural)), wide, "contains", key).select(key)
    return pois.join(a.unionByName(b).distinct(), key, "left_semi")


def cover(regions: DataFrame, res: float) -> DataFrame:
    """R1. Cells whose centre lies in the region; from runs, see there."""
    return runs.to_cells(runs.from_edges(edges_of(regions), res))


def union(*covers: DataFrame) -> DataFrame:
    """R2."""
    out = covers[0].select("cx", "cy")
    for c in covers[1:]:
        out = out.unionByName(c.select("cx", "cy"))
    return out.distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("cx", "cy").distinct(), ["cx", "cy"], "left_anti")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("cx", "cy").distinct(), ["cx", "cy"], "left_semi")


def buffer(cells: DataFrame, meters: float, res: float, lat: float) -> DataFrame:
    """R3. Cells whose centre is within `meters` of a cell's centre, on the plane at `lat`."""
    return runs.to_cells(runs.buffer(runs.from_cells(cells), meters, res, lat))


def _disc(meters: float, res: float, lat: float) -> list[tuple[int, int]]:
    """Steps in columns and rows to the cells within `meters`."""
    hy, hx = res * M_PER_LAT, res * 111320.0 * math.cos(math.radians(lat))
    ny, nx = int(meters // hy), int(meters // hx)
    return [(i, j) for i in range(-nx, nx + 1) for j in range(-ny, ny + 1) if (i * hx) ** 2 + (j * hy) ** 2 <= meters**2]


def cell_components(cells: DataFrame) -> DataFrame:
    """cx, cy, part: cells that touch by a side are one part."""
    return runs.to_cells(runs.parts(runs.from_cells(cells))).select("cx", "cy", "part")


def holes(cells: DataFrame) -> DataFrame:
    """Cells of the complement that are enclosed: cx, cy, part."""
    return runs.to_cells(runs.holes(runs.from_cells(cells))).select("cx", "cy", "part")


def fill_holes(cells: DataFrame, max_cells: int | None = None) -> DataFrame:
    """R4. With enclosed holes filled; only those of under max_cells, if given."""
    return runs.to_cells(runs.fill_holes(runs.from_cells(cells), max_cells))


def filter_parts(cells: DataFrame, min_cells: int = 0, seeds: DataFrame | None = None, west_of: float | None = None, res: float = 0.01) -> DataFrame:
    """R5. Keeps parts of at least min_cells, with a seed cell (cx, cy), and with a centroid not west of a longitude."""
    return runs.to_cells(runs.filter_parts(runs.from_cells(cells), min_cells, seeds, west_of, res))


def shared_border(places: DataFrame, res: float | None = None, meters: float = 150.0, lat: float = 37.7) -> DataFrame:
    """place_id and the share of its border cells that have another place beside them or, where the cells' size `res` in
    degrees is given, within `meters` from centre to centre on the plane at `lat`. places: place_id, cx, cy."""
    beside = [(1, 0), (-1, 0), (0, 1), (0, -1)]
    far = [o for o in _disc(meters, res, lat) if o != (0, 0) and o not in beside] if res else []
    step = lambda i, j, touch: F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy"), F.lit(touch).alias("touch"))
    steps = F.array(*[step(i, j, True) for i, j in beside], *[step(i, j, False) for i, j in far])
    around = places.select("place_id", F.struct("cx", "cy").alias("own"), F.explode(steps).alias("o")).select("place_id", "own", "o.cx", "o.cy", "o.touch")
    other = places.select(F.col("place_id").alias("other"), "cx", "cy")
    j = around.join(other, ["cx", "cy"], "left").where("other <> place_id or (other is null and touch)")
    cell = j.groupBy("place_id", "own").agg(F.bool_or("touch").alias("border"), F.bool_or(F.col("other").isNotNull()).alias("shared")).where("border")
    return cell.groupBy("place_id").agg((F.count_if("shared") / F.count("*")).alias("share"))


def prune_isolated(places: DataFrame, loose: DataFrame, least: float = 0.02, max_rounds: int = 50, res: float | None = None, meters: float = 150.0, lat: float = 37.7) -> DataFrame:
    """R6. Drops `loose` places (place_id) that share under `least` of their border with kept ones, until none is left
    to drop; all others are immune. res, meters, lat: see `shared_border`."""
    kept = places
    for _ in range(max_rounds):
        bad = written(shared_border(kept, res, meters, lat).where(F.col("share") < least).join(loose, "place_id", "left_semi").select("place_id"), "isolated")
        if bad.isEmpty():
            return kept
        kept = written(kept.join(bad, "place_id", "left_anti"), "kept-places")
    raise RuntimeError("pruning has not settled")


def largest_overlap(places: DataFrame, counties: DataFrame, least: float = 0.1) -> DataFrame:
    """J17. place_id -> the county that covers most of its cells, if that is at least `least` of them."""
    n = places.groupBy("place_id").agg(F.count("*").alias("total"))
    o = places.join(counties, ["cx", "cy"]).groupBy("place_id", "county").agg(F.count("*").alias("n"))
    best = o.groupBy("place_id").agg(F.max_by("county", F.struct("n", "county")).alias("county"), F.max("n").alias("n")).join(n, "place_id")
    return best.where(F.col("n") >= least * F.col("total")).select("place_id", "county", (F.col("n") / F.col("total")).alias("share"))


def carve(area: DataFrame, dropped: DataFrame, least: float = 0.9) -> DataFrame:
    """R7. Takes dropped places out of the area, but for enclaves: those it covers to at least `least`. dropped:
    place_id, cx, cy."""
    flag = dropped.join(area.select("cx", "cy", F.lit(1).alias("_in")).distinct(), ["cx", "cy"], "left")
    out = flag.groupBy("place_id").agg((F.count("_in") / F.count("*")).alias("share")).where(F.col("share") < least)
    return difference(area, dropped.join(out, "place_id", "left_semi"))


def gap_runs(samples: DataFrame) -> DataFrame:
    """W7. samples: line, pos, covered -> runs of uncovered samples between covered ones: line, first_pos, last_pos, n,
    closed (covered on both ends)."""
    w = Window.partitionBy("line").orderBy("pos")
    s = samples.withColumn("_new", (F.coalesce(F.lag("covered").over(w), ~F.col("covered")) != F.col("covered")).cast("int"))
    s = s.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumns({"_b": F.lag("covered").over(w), "_a": F.lead("covered").over(w)})
    g = s.where(~F.col("covered")).groupBy("line", "run").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("n"), F.min_by(F.coalesce("_b", F.lit(False)), "pos").alias("_b"), F.max_by(F.coalesce("_a", F.lit(False)), "pos").alias("_a"))
    return g.select("line", "first_pos", "last_pos", "n", (F.col("_b") & F.col("_a")).alias("closed"))


def bridges(samples: DataFrame, area: DataFrame, res: float, step_m: float, max_miles: float = 12.0, half_miles: float = 0.5, lat: float = 37.7) -> DataFrame:
    """R8. Cells of corridors: sampled lines (line, pos, lat, lon; step_m apart) where they leave the area and come back
    within max_miles, widened by half_miles to either side."""
    c = samples.withColumns({"cx": F.floor(F.col("lon") / res).cast("long"), "cy": F.floor(F.col("lat") / res).cast("long")})
    c = c.join(area.select("cx", "cy", F.lit(True).alias("_in")).distinct(), ["cx", "cy"], "left").withColumn("covered", F.coalesce("_in", F.lit(False)))
    gaps = gap_runs(c.select("line", "pos", "covered")).where(F.col("closed") & (F.col("n") * step_m <= max_miles * 1609.344))
    path = c.join(gaps, "line").where(F.col("pos").between(F.col("first_pos"), F.col("last_pos"))).select("cx", "cy").distinct()
    return buffer(path, half_miles * 1609.344, res, lat)


def play_area(places: DataFrame, counties: DataFrame, eligible: DataFrame, keep: DataFrame, drop: DataFrame, loose: DataFrame, samples: DataFrame, res: float, step_m: float, hole_cells: int | None = None) -> DataFrame:
    """R9. Places of eligible counties, with keep and drop overrides, isolated loose places pruned, corridors added, holes
    filled, dropped places carved out. places: place_id, cx, cy; counties: county, cx, cy; the lists: place_id or county."""
    of = largest_overlap(places, counties)
    base = of.join(eligible, "county", "left_semi").select("place_id").unionByName(keep.select("place_id")).distinct().join(drop, "place_id", "left_anti")
    chosen = written(places.join(base, "place_id", "left_semi"), "chosen-places")
    chosen = prune_isolated(chosen, loose.join(keep, "place_id", "left_anti"), res=res)
    area = union(chosen, bridges(samples, chosen, res, step_m))
    area = written(fill_holes(written(area, "area"), hole_cells), "filled")
    return carve(area, places.join(drop, "place_id", "left_semi"))


def boxes_on_region(tiles: DataFrame, regions: DataFrame) -> DataFrame:
    """J16. Tiles (tile, w, e, s, n) that touch a region: a corner or the centre lies in it, or a vertex of it in them."""
    mid = lambda a, b: (F.col(a) + F.col(b)) / 2
    probes = F.array(*[F.struct(x.alias("lon"), y.alias("lat")) for x, y in ((F.col("w"), F.col("s")), (F.col("w"), F.col("n")), (F.col("e"), F.col("s")), (F.col("e"), F.col("n")), (mid("w", "e"), mid("s", "n")))])
    pts = tiles.select("tile", F.posexplode(probes).alias("i", "p")).select(F.struct("tile", "i").alias("id"), "p.lat", "p.lon")
    a = points_in_regions(pts, regions).select("id.tile")
    row = lambda y: F.floor(y / GRID).cast("long")
    v = regions.select(F.explode(F.flatten("rings")).alias("p")).select(F.col("p.lon").alias("x"), F.col("p.lat").alias("y"), row(F.col("p.lat")).alias("_r"))
    t = tiles.withColumn("_r", F.explode(F.sequence(row(F.col("s")), row(F.col("n")))))
    b = t.join(v.hint("merge"), "_r").where(F.col("x").between(F.col("w"), F.col("e")) & F.col("y").between(F.col("s"), F.col("n"))).select("tile")
    return tiles.join(a.unionByName(b).distinct(), "tile", "left_semi")


def adaptive_tiles(points: DataFrame, cap: int = 20, min_m: float = 25.0, max_m: float = 50_000.0, max_depth: int = 24) -> DataFrame:
    """E15. Quadtree leaves over points (lat, lon): a tile is split while it holds `cap` points or more and its half
    diagonal is over min_m, and in any case while that is over max_m. level, tx, ty, n.

    All levels come from one count at the finest level that is added up level by level; a tile is a leaf if it need not be
    split and its parent had to be.
    """
    # half diagonal of a tile at a level, at the equator: an upper bound for all latitudes
    half = lambda z: 0.5 * ((360 / 2**z * 111320.0) ** 2 + (180 / 2**z * M_PER_LAT) ** 2) ** 0.5
    first = next(z for z in range(64) if half(z) <= max_m)
    last = min(max_depth, next(z for z in range(64) if half(z) <= min_m))
    fine = points.select(F.least(F.floor((F.col("lon") + 180) / 360 * 2**last), F.lit(2**last - 1)).cast("long").alias("x"), F.least(F.floor((F.col("lat") + 90) / 180 * 2**last), F.lit(2**last - 1)).cast("long").alias("y"))
    fine = written(fine.groupBy("x", "y").agg(F.count("*").alias("n")), "fine-cells")
    levels = None
    for z in range(first, last + 1):
        up = last - z
        t = fine.groupBy(F.shiftright("x", up).alias("tx"), F.shiftright("y", up).alias("ty")).agg(F.sum("n").alias("n")).withColumn("level", F.lit(z))
        levels = t if levels is None else levels.unionByName(t)
    levels = written(levels, "levels")
    full = levels.where((F.col("n") >= cap) & (F.col("level") < last)).select((F.col("level") + 1).alias("level"), F.col("tx").alias("px"), F.col("ty").alias("py"))
    child = levels.withColumns({"px": F.shiftright("tx", 1), "py": F.shiftright("ty", 1)})
    under = child.join(full, ["level", "px", "py"], "left_semi").unionByName(child.where(F.col("level") == first))
    return under.where((F.col("n") < cap) | (F.col("level") == last)).select("level", "tx", "ty", "n")
