"""Polylines as vertex rows (line, seq, lat, lon) or as arrays of struct<lon, lat>."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewright.functions import geo
from placewright.plans.graph import components
from placewright.plans.passing import passing
from placewright.plans.tables import written

from .joins import linked, within

SPACING_M = 16.0


def segments(vertices: DataFrame) -> DataFrame:
    """W5. line, seq, alat, alon, blat, blon of consecutive vertices; columns other than these are kept."""
    w = Window.partitionBy("line").orderBy("seq")
    df = vertices.withColumnsRenamed({"lat": "alat", "lon": "alon"})
    return df.withColumns({"blat": F.lead("alat").over(w), "blon": F.lead("alon").over(w)}).where("blat is not null")


def resampled(vertices: DataFrame, step_m: float, at_lat: float = geo.PLANE_LAT) -> DataFrame:
    """R8. line, pos, lat, lon: points every step_m along each line from its first vertex on, pos 0, 1, ... in order.

    vertices: line, seq, lat, lon. The length up to each vertex is a running sum along its line, so a segment gives the
    multiples of step_m between its ends, however many segments one step spans.
    """
    w = Window.partitionBy("line").orderBy("seq")
    c = F.col
    s = vertices.select("line", "seq", "lat", "lon", F.lead("lat").over(w).alias("blat"), F.lead("lon").over(w).alias("blon")).where("blat is not null")
    s = s.withColumn("d", geo.planar_m(c("lat"), c("lon"), c("blat"), c("blon"), at_lat)).where("d > 0").withColumn("upto", F.sum("d").over(w))
    s = s.withColumn("from", F.coalesce(F.lag("upto").over(w), F.lit(0.0)))
    first, last = F.ceil(c("from") / step_m).cast("long"), F.ceil(c("upto") / step_m).cast("long") - 1
    s = s.where(first <= last).withColumn("pos", F.explode(F.sequence(first, last)))
    t = (c("pos") * F.lit(float(step_m)) - c("from")) / c("d")
    return s.select("line", "pos", (c("lat") + (c("blat") - c("lat")) * t).alias("lat"), (c("lon") + (c("blon") - c("lon")) * t).alias("lon"))


def lengths(vertices: DataFrame) -> DataFrame:
    """A13. line, length in planar metres, vertices."""
    s = segments(vertices)
    d = geo.planar_m(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon"))
    return s.groupBy("line").agg(F.sum(d).alias("length_m"), (F.count("*") + 1).alias("vertices"))


def without_strays(vertices: DataFrame, least_m: float = 800.0) -> DataFrame:
    """L4. Lines of at least `least_m`."""
    return vertices.join(lengths(vertices).where(F.col("length_m") >= least_m), "line", "left_semi")


#: Distances of points and segments that are worked out at once.
SNAPPED = 500_000


def snap_to_lines(points: DataFrame, vertices: DataFrame, tolerance: float = 40.0, most: float = 400.0, key: str = "station_id") -> DataFrame:
    """J7. points: key, system, lat, lon; vertices: line, system, seq, lat, lon. The nearest position on a line of the
    point's own system within `most`; the point moves there if it is over `tolerance` away: key, lat, lon, d, moved.

    A segment goes to the cells, twice `most` wide, that it comes within `most` of, so a point looks at those of its own cell only. They
    are held there while its points pass by, and a row is made for a point and its nearest segment, not for each pair.
    """
    known = lambda *names: F.abs(reduce(Column.__add__, [F.col(n).cast("double") for n in names])) < float("inf")
    s = _in_cells(segments(vertices).where(known("alat", "alon", "blat", "blon") & F.col("system").isNotNull()), most)
    p = points.where(known("lat", "lon") & F.col("system").isNotNull()).withColumn("_row", F.floor(F.col("lat") / _height(most)).cast("long"))
    p = p.withColumn("_n", _columns(F.col("_row"), most)).withColumn("_column", _column(F.col("lon"), F.col("_n")))
    cell = ["system", "_row", "_column"]
    ends = ("alat", "alon", "blat", "blon")
    names = (key, "lat", "lon", "line", "seq", *ends)

    def run(rows: Iterator[tuple[bool, pa.RecordBatch]]) -> Iterator[pa.Table]:
        held, table = [], None
        for is_held, part in rows:
            if is_held:
                held.append(part)
                continue
            if not held:
                return  # no segment is near
            table = table or pa.Table.from_batches(held).sort_by([("line", "ascending"), ("seq", "ascending")])
            e = [table.column(c).to_numpy() for c in ends]
            lat, lon = (part.column(c).to_numpy() for c in ("lat", "lon"))
            at = [_nearest_segment(lat[i : i + step], lon[i : i + step], *e) for step in [max(1, SNAPPED // len(table))] for i in range(0, len(lat), step)]
            near = table.take(pa.array(np.concatenate(at)))
            yield pa.table({c: part.column(c) if c in part.schema.names else near.column(c) for c in names})

    kind = {c: df.schema[c].dataType.simpleString() for df, names in ((s, ("line", "seq")), (points, (key,))) for c in names}
    schema = ", ".join(f"{c} {kind.get(c, 'double')}" for c in names)
    near = passing(s.select(*cell, "line", "seq", *ends), p.select(*cell, key, "lat", "lon"), cell, [], None, run, schema)
    hit = geo.on_segment(F.col("lat"), F.col("lon"), *[F.col(c) for c in ends])
    best = near.withColumn("h", hit).groupBy(key).agg(F.min(F.struct(F.col("h.d").alias("d"), "line", "seq", F.col("h.lat").alias("lat"), F.col("h.lon").alias("lon"))).alias("b"))
    df = points.join(best.hint("merge"), key, "left")
    moved = F.coalesce((F.col("b.d") > tolerance) & (F.col("b.d") <= most), F.lit(False))
    pick = lambda c: F.when(moved, F.col(f"b.{c}")).otherwise(F.col(c))
    return df.select(key, pick("lat").alias("lat"), pick("lon").alias("lon"), F.when(F.col("b.d") <= most, F.col("b.d")).alias("d"), moved.alias("moved"))


def _nearest_segment(lat: np.ndarray, lon: np.ndarray, alat: np.ndarray, alon: np.ndarray, blat: np.ndarray, blon: np.ndarray) -> np.ndarray:
    """The number of each point's nearest segment, by geo.on_segment."""
    kx, ky = 111320.0 * np.cos(np.radians(lat))[:, None], 110540.0
    ax, ay = (alon - lon[:, None]) * kx, (alat - lat[:, None]) * ky
    dx, dy = (blon - alon) * kx, (blat - alat) * ky
    l2 = dx * dx + dy * dy
    t = np.clip(-(ax * dx + ay * dy) / np.where(l2 == 0, 1.0, l2), 0, 1)
    ax += t * dx
    ay += t * dy
    return (ax * ax + ay * ay).argmin(axis=1)


def _height(most: float) -> float:
    """Degrees of latitude of a row of cells."""
    return 2 * most / 110540.0


def _columns(row: Column, most: float) -> Column:
    """Columns of a row of cells around the globe, each at least twice `most` wide; one beside the poles."""
    n = F.floor(360.0 * 111320.0 / (2 * most) * F.cos(F.radians(F.greatest(F.abs(row), F.abs(row + 1)) * _height(most))))
    return F.greatest(F.lit(1), n).cast("long")


def _column(lon: Column, n: Column) -> Column:
    return F.when(n > 1, F.floor(lon / 360.0 * n).cast("long")).otherwise(F.lit(0).cast("long"))


def _in_cells(s: DataFrame, most: float) -> DataFrame:
    """Segments in each cell (_row, _column) of which a place may be within `most` of them, by geo.on_segment there. In a row
    of cells it is the part of a segment between the latitudes that are in reach of it which counts."""
    c, high, wide = F.col, _height(most), 1.0001
    reach = wide * most / 110540.0
    low, top = F.least("alat", "blat"), F.greatest("alat", "blat")
    s = s.withColumn("_row", F.explode(F.sequence(F.floor((low - reach) / high).cast("long"), F.floor((top + reach) / high).cast("long"))))
    s = s.withColumn("_n", _columns(c("_row"), most))
    rise = c("blat") - c("alat")
    at = lambda lat: F.when(rise == 0, None).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (lat - c("alat")) / rise)))
    s = s.withColumns({"_t": at(c("_row") * high - reach), "_u": at((c("_row") + 1) * high + reach)})
    lon = lambda t, other: F.coalesce(c("alon") + (c("blon") - c("alon")) * t, c(other))
    s = s.withColumns({"_x": lon(c("_t"), "alon"), "_y": lon(c("_u"), "blon")})
    # Where a row has more than one column these are as wide as `reach` twice, at its latitude furthest from the equator.
    side = F.lit(wide * 180.0) / c("_n")
    ends = [_column(F.least("_x", "_y") - side, c("_n")), _column(F.greatest("_x", "_y") + side, c("_n"))]
    return s.withColumn("_column", F.explode(F.sequence(*ends))).drop("_n", "_t", "_u", "_x", "_y")


def offset_coords(coords: Column, meters: Column) -> Column:
    """L1. A polyline moved by `meters` to the left of its direction, vertex by vertex."""
    n = F.size(coords)

    def move(p: Column, i: Column) -> Column:
        a, b = F.get(coords, F.greatest(i - 1, F.lit(0))), F.get(coords, F.least(i + 1, n - 1))
        mx = 111320.0 * F.cos(F.radians(p["lat"]))
        tx, ty = (b["lon"] - a["lon"]) * mx, (b["lat"] - a["lat"]) * 110540.0
        h = F.sqrt(tx * tx + ty * ty)
        h = F.when(h == 0, F.lit(1.0)).otherwise(h)
        return F.struct((p["lon"] - ty / h * meters / mx).alias("lon"), (p["lat"] + tx / h * meters / 110540.0).alias("lat"))

    return F.when((meters == 0) | (n < 2), coords).otherwise(F.transform(coords, move))


def interline(ways: DataFrame, on: bool = True, spacing: float = SPACING_M) -> DataFrame:
    """L2. ways: way_id, colors, coords. A row per colour, side by side; off: one row in the first colour."""
    if not on:
        return ways.select("way_id", F.get("colors", F.lit(0)).alias("color"), "coords")
    k = F.size("colors")
    each = ways.select("way_id", "coords", k.alias("_k"), F.posexplode("colors").alias("_i", "color"))
    return each.select("way_id", "color", offset_coords(F.col("coords"), (F.col("_i") - (F.col("_k") - 1) / 2) * spacing).alias("coords"))


def coords_of(vertices: DataFrame) -> DataFrame:
    """line, coords: the vertices of each line in order."""
    a = F.array_sort(F.collect_list(F.struct("seq", "lon", "lat")))
    return vertices.groupBy("line").agg(F.transform(a, lambda v: F.struct(v["lon"].alias("lon"), v["lat"].alias("lat"))).alias("coords"))


def chains(ends: DataFrame, meters: float = 25.0) -> DataFrame:
    """L3. ends: way_id, grp (system and colour), alat, alon, blat, blon. Ways of a group whose ends are within `meters`
    are one chain: way_id, chain."""
    e = ends.select("way_id", "grp", F.explode(F.array(F.struct(F.col("alat").alias("lat"), F.col("alon").alias("lon")), F.struct(F.col("blat").alias("lat"), F.col("blon").alias("lon")))).alias("p")).select("way_id", "grp", "p.lat", "p.lon")
    return components(linked(e, "way_id", meters, geo.planar_m, by=["grp"])).withColumnsRenamed({"id": "way_id", "root": "chain"})


def covered_chains(vertices: DataFrame, meters: float = 140.0, samples: int = 24, share: float = 0.6, max_rounds: int = 60) -> DataFrame:
    """J18, L5. vertices: line, grp, seq, lat, lon. Lines that go when those of a group are taken longest first: at least `share` of
    their samples (at most `samples` vertices, evenly spread) lie within `meters` of a vertex of a longer line that stays. line, hits, samples.

    A round decides each line whose samples beside lines that stay are enough already, or would be too few with all the open
    ones; so the longest open line of a group always is decided, and rounds are as many as lines wait for one another.
    """
    n = F.count("*").over(Window.partitionBy("line"))
    i = F.row_number().over(Window.partitionBy("line").orderBy("seq")) - 1
    v = vertices.withColumns({"_n": n, "_i": i})
    take = F.floor((F.col("_i") * samples) / F.col("_n")) != F.floor(((F.col("_i") - 1) * samples) / F.col("_n"))
    s = v.where((F.col("_n") <= samples) | take)
    size = written(lengths(vertices).select("line", "length_m"), "line-lengths")
    s, t = s.join(size, "line"), vertices.join(size, "line")
    near = within(s, t, meters, geo.planar_m, by=["grp"]).where("r_length_m > l_length_m or (r_length_m = l_length_m and r_line < l_line)")
    meets = written(near.select(F.col("l_line").alias("line"), F.col("l_seq").alias("seq"), F.col("r_line").alias("longer")).distinct(), "meets")
    total = written(s.groupBy("line").agg(F.count("*").alias("samples")), "samples")
    # Only lines that meet a longer one can go; all others stay from the start.
    state = total.join(meets.select("line").distinct(), "line", "left_anti").select("line", F.lit(True).alias("stays"))
    total = total.join(meets.select("line").distinct(), "line", "left_semi")
    least = F.lit(share) * F.col("samples")
    first, is_open = state, True
    for _ in range(max_rounds):
        was_open = is_open
        beside = meets.join(state.select(F.col("line").alias("longer"), "stays"), "longer", "left").where("stays is null or stays")
        each = beside.groupBy("line", "seq").agg(F.max(F.coalesce("stays", F.lit(False)).cast("long")).alias("sure"))
        hits = each.groupBy("line").agg(F.sum("sure").alias("hits"), F.count("*").alias("most"))
        now = total.join(hits, "line", "left").withColumns({"hits": F.coalesce("hits", F.lit(0)), "most": F.coalesce("most", F.lit(0))})
        now = written(now.withColumn("stays", F.when(F.col("hits") >= least, False).when(F.col("most") < least, True)), "decided")
        if not was_open:
            return now.where("not stays").select("line", "hits", "samples")
        is_open = not now.where("stays is null").isEmpty()
        state = first.unionByName(now.select("line", "stays"))
    raise RuntimeError(f"lines have not settled after {max_rounds} rounds")


def clip_at(vertices: DataFrame, lat: float, lon: float, keep: str = "after") -> DataFrame:
    """L6. Cuts each line at its vertex nearest to a point and keeps one side, that vertex included."""
    d = geo.planar_m(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon))
    cut = vertices.groupBy("line").agg(F.min(F.struct(d.alias("d"), "seq")).alias("c")).select("line", F.col("c.seq").alias("_cut"))
    side = F.col("seq") >= F.col("_cut") if keep == "after" else F.col("seq") <= F.col("_cut")
    return vertices.join(cut, "line").where(side).drop("_cut")


def routes(ways: DataFrame) -> DataFrame:
    """L7. The way ids of each (system, colour), in order."""
    return ways.groupBy("system", "color").agg(F.sort_array(F.collect_list("way_id")).alias("way_ids"))
