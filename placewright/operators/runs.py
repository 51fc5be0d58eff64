"""Covers as runs of cells in a row: cy, x0, x1, ends included.

A row of a region is a few numbers however wide it is, so set operations, widening, parts and holes work on the ends of runs:
sweeps along a row in a window, and one join-free pass over each pair of rows that touch. No cell is ever made, and the
complement of a cover is the gaps between its runs, whatever the size of the frame around it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewright.plans.graph import components
from placewright.plans.tables import written

M_PER_LAT = 110540.0
#: Where the open ends of the outermost gaps of a row lie.
FAR = 1 << 30


def cell_id(cx: Column, cy: Column) -> Column:
    return F.shiftleft(cx.cast("long") + 1_000_000, 32) + cy.cast("long") + 1_000_000


def merged(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Runs of a row that overlap or touch, as one. by: columns inside whose groups that is done."""
    keys = [*(by or []), "cy"]
    w = Window.partitionBy(*keys).orderBy("x0", "x1")
    before = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = runs.select(*keys, "x0", "x1", F.coalesce(F.col("x0") > before + 1, F.lit(True)).cast("int").alias("_new"))
    new = new.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return new.groupBy(*keys, "_run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_run")


def from_cells(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    return merged(cells.select(*(by or []), "cy", F.col("cx").alias("x0"), F.col("cx").alias("x1")).distinct(), by)


def to_cells(runs: DataFrame) -> DataFrame:
    others = [c for c in runs.columns if c not in ("cy", "x0", "x1")]
    return runs.select(*others, F.explode(F.sequence("x0", "x1")).alias("cx"), "cy")


def from_edges(edges: DataFrame, res: float) -> DataFrame:
    """R1. region_id, cy, x0, x1: the cells whose centre lies in a region, from its sides (region_id, x1, y1, x2, y2).

    Each side cuts the middle lines of the rows that it spans; between the odd and the next even cut a row is inside.
    """
    row = lambda y: F.floor(y / res - 0.5).cast("long")
    e = edges.withColumn("cy", F.explode(F.sequence(row(F.least("y1", "y2")), row(F.greatest("y1", "y2")) + 1))).withColumn("_y", (F.col("cy") + 0.5) * res)
    e = e.where((F.col("y1") > F.col("_y")) != (F.col("y2") > F.col("_y")))
    cut = ((F.col("x2") - F.col("x1")) * (F.col("_y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")).alias("a")
    w = Window.partitionBy("region_id", "cy").orderBy("a")
    cuts = e.select("region_id", "cy", cut).withColumns({"b": F.lead("a").over(w), "_k": F.row_number().over(w)}).where("_k % 2 = 1")

    def first_from(x: Column) -> Column:
        """The first cell whose centre is not left of x."""
        c = F.ceil(x / res - 0.5).cast("long")
        centre = lambda i: (i + 0.5) * F.lit(res)
        return F.when(centre(c - 1) >= x, c - 1).when(centre(c) < x, c + 1).otherwise(c)

    runs = cuts.select("region_id", "cy", first_from(F.col("a")).alias("x0"), (first_from(F.col("b")) - 1).alias("x1")).where("x0 <= x1")
    return merged(runs, ["region_id"])


def overlay(a: DataFrame, b: DataFrame, keep: Callable[[Column, Column], Column]) -> DataFrame:
    """R2. Runs where keep(in a, in b) holds, by a sweep along each row over the ends of both."""
    ends = []
    for runs, da, db in ((a, 1, 0), (b, 0, 1)):
        for x, sign in ((F.col("x0"), 1), (F.col("x1") + 1, -1)):
            ends.append(runs.select("cy", x.alias("x"), F.lit(sign * da).alias("da"), F.lit(sign * db).alias("db")))
    at = ends[0].unionByName(ends[1]).unionByName(ends[2]).unionByName(ends[3]).groupBy("cy", "x").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    w = Window.partitionBy("cy").orderBy("x")
    depth = lambda c: F.sum(c).over(w) > 0
    part = at.select("cy", F.col("x").alias("x0"), (F.lead("x").over(w) - 1).alias("x1"), depth("da").alias("_a"), depth("db").alias("_b"))
    return merged(part.where(keep(F.col("_a"), F.col("_b")) & F.col("x1").isNotNull()).select("cy", "x0", "x1"))


def union(*covers: DataFrame) -> DataFrame:
    out = covers[0].select("cy", "x0", "x1")
    for c in covers[1:]:
        out = out.unionByName(c.select("cy", "x0", "x1"))
    return merged(out)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return overlay(a, b, lambda x, y: x & ~y)


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return overlay(a, b, lambda x, y: x & y)


def buffer(runs: DataFrame, meters: float, res: float, lat: float) -> DataFrame:
    """R3. Cells whose centre is within `meters` of a cell's centre, on the plane at `lat`: a run is copied once for each row
    of the disc, wider by the disc's half width there."""
    hy, hx = res * M_PER_LAT, res * 111320.0 * math.cos(math.radians(lat))
    rows = int(meters // hy)
    reach = {j: max(i for i in range(int(meters // hx) + 1) if (i * hx) ** 2 + (j * hy) ** 2 <= meters**2) for j in range(-rows, rows + 1)}
    steps = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(i).alias("i")) for j, i in reach.items()])
    out = runs.select("cy", "x0", "x1", F.explode(steps).alias("s"))
    return merged(out.select((F.col("cy") + F.col("s.j")).alias("cy"), (F.col("x0") - F.col("s.i")).alias("x0"), (F.col("x1") + F.col("s.i")).alias("x1")))


def parts(runs: DataFrame) -> DataFrame:
    """cy, x0, x1, part: runs that touch by a side of a cell are one part, named by its least cell. runs: as merged gives them.

    In two neighbouring rows a run overlaps another one that begins no later exactly if the last one to begin so does, so
    one window over each pair of rows finds enough links.
    """
    r = written(runs.select("cy", "x0", "x1", cell_id(F.col("x0"), F.col("cy")).alias("a")), "runs")
    pair = lambda upper: r.select((F.col("cy") - upper).alias("row"), F.lit(upper).alias("upper"), "x0", "x1", "a")
    w = Window.partitionBy("row").orderBy("x0", "upper").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda side: F.last(F.when(F.col("upper") == side, F.struct("x1", "a")), ignorenulls=True).over(w)
    both = pair(0).unionByName(pair(1)).withColumns({"_0": last(0), "_1": last(1)}).withColumn("o", F.when(F.col("upper") == 0, F.col("_1")).otherwise(F.col("_0")))
    links = both.where(F.col("o.x1") >= F.col("x0")).select("a", F.col("o.a").alias("b"))
    links = links.unionByName(r.select("a", F.col("a").alias("b")))
    return r.join(components(links).withColumnsRenamed({"id": "a", "root": "part"}), "a").select("cy", "x0", "x1", "part")


def holes(runs: DataFrame) -> DataFrame:
    """R4. The enclosed gaps: cy, x0, x1, part. Gaps of rows that have runs are enough: a row without any is outside, and so
    is a gap beside it, and the two open ends of each row."""
    runs = written(runs.select("cy", "x0", "x1"), "runs")
    w = Window.partitionBy("cy").orderBy("x0")
    gap = runs.select("cy", (F.col("x1") + 1).alias("x0"), (F.lead("x0").over(w) - 1).alias("x1")).where("x0 <= x1").withColumn("out", F.lit(False))
    rows = runs.groupBy("cy").agg(F.min("x0").alias("low"), F.max("x1").alias("high"))
    left = rows.select("cy", F.lit(-FAR).cast("long").alias("x0"), (F.col("low") - 1).alias("x1"), F.lit(True).alias("out"))
    right = rows.select("cy", (F.col("high") + 1).alias("x0"), F.lit(FAR).cast("long").alias("x1"), F.lit(True).alias("out"))
    free = gap.unionByName(left).unionByName(right)
    beside = lambda d: rows.select((F.col("cy") + d).alias("cy"), F.lit(True).alias(f"_{d + 1}"))
    free = free.join(beside(1), "cy", "left").join(beside(-1), "cy", "left").withColumn("out", F.col("out") | F.col("_2").isNull() | F.col("_0").isNull())
    free = written(free.select("cy", "x0", "x1", "out"), "gaps")
    named = parts(free).join(free.select("cy", "x0", "out"), ["cy", "x0"])
    outer = named.where("out").select("part").distinct()
    return named.join(outer, "part", "left_anti").select("cy", "x0", "x1", "part")


def _cells() -> Column:
    return F.sum(F.col("x1") - F.col("x0") + 1)


def fill_holes(runs: DataFrame, max_cells: int | None = None) -> DataFrame:
    """R4. With enclosed holes filled; only those of under max_cells, if given."""
    runs = written(runs.select("cy", "x0", "x1"), "runs")
    h = written(holes(runs), "holes")
    if max_cells is not None:
        h = h.join(h.groupBy("part").agg(_cells().alias("n")).where(F.col("n") < max_cells).select("part"), "part", "left_semi")
    return union(runs, h)


def filter_parts(runs: DataFrame, min_cells: int = 0, seeds: DataFrame | None = None, west_of: float | None = None, res: float = 0.01) -> DataFrame:
    """R5. Keeps parts of at least min_cells, with a seed cell (cx, cy), and with a centroid not west of a longitude."""
    p = written(parts(runs), "parts")
    middle = F.sum((F.col("x0") + F.col("x1") + 1) / 2 * (F.col("x1") - F.col("x0") + 1))
    g = p.groupBy("part").agg(_cells().alias("n"), middle.alias("_m")).where(F.col("n") >= min_cells)
    if west_of is not None:
        g = g.where(F.col("_m") / F.col("n") * res >= west_of)
    if seeds is not None:
        held = p.join(seeds.select("cx", "cy"), "cy").where(F.col("cx").between(F.col("x0"), F.col("x1"))).select("part").distinct()
        g = g.join(held, "part", "left_semi")
    return p.join(g.select("part"), "part", "left_semi").select("cy", "x0", "x1")
