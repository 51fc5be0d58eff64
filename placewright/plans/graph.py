"""Connected components and parent chains as iterated DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """Connected components of an undirected edge table -> (id, root): root is the least id of the component.

    Alternating large-star and small-star steps: each step joins edges with one minimum per node, which is
    pre-aggregated before its shuffle, so a hub with many neighbours isn't collected anywhere. Edges never multiply.
    Joins are shuffled, never broadcast: ids pack so well in files that the planner would hold millions of them in the driver.
    Null ends are ignored; a self edge makes its node a component of its own. Raises if it doesn't settle.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    alone = pairs.where("u = v").select("u").distinct()
    e = pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = written(e, "edges")
    for n_round in range(max_rounds + 1):
        if _stars(e):
            roots = e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
            inside = e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)
            single = alone.select(F.col("u").alias("id")).join(inside.hint("merge"), "id", "left_anti").withColumn("root", F.col("id"))
            return inside.unionByName(single)
        if n_round == max_rounds:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low.hint("merge"), "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))).alias("x"))
            .select("x.u", F.col("x.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        e = written(small, "edges")
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")


def _stars(e: DataFrame) -> bool:
    """Whether each u has one edge and no v is a u: edges to the least id of every component, which no step would change."""
    ends = e.select(F.col("u").alias("k"), F.lit(1).alias("n"), F.lit(0).alias("low")).unionByName(e.select(F.col("v").alias("k"), F.lit(0).alias("n"), F.lit(1).alias("low")))
    return ends.groupBy("k").agg(F.sum("n").alias("n"), F.max("low").alias("low")).where("n > 1 or n > 0 and low > 0").isEmpty()


def roots(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Follow (child, parent) chains to their ends by pointer jumping -> (id, root).

    Where a chain runs into a cycle, the root is the least id on what it reaches when the jumps settle.
    """
    hop = edges.select(F.col("child").alias("id"), F.col("parent").alias("root")).where("id <> root")
    hop = written(hop.dropDuplicates(["id"]), "hops")
    for _ in range(max_rounds):
        far = hop.select(F.col("id").alias("root"), F.col("root").alias("far"))
        joined = hop.join(far.hint("merge"), "root", "left")
        moved = written(joined.select("id", F.coalesce("far", "root").alias("root"), (F.col("far").isNotNull() & (F.col("far") != F.col("root"))).alias("moved")), "hops")
        hop = moved.select("id", "root")
        if not moved.where("moved and id <> root").limit(1).count():
            break
    return hop
