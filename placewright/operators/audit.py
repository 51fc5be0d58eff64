"""Checks over finished tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import baseline_diff


def checks(df: DataFrame, rules: dict[str, Column], unique: list[str]) -> DataFrame:
    """V3. name, violations: rows that break each rule, and keys that aren't unique. One pass for all the rules."""
    rows = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(n) for n, ok in rules.items()])
    broken = rows.select(F.explode(F.create_map(*[x for n in rules for x in (F.lit(n), F.col(n))])).alias("name", "violations"))
    for key in unique:
        more = df.groupBy(key).count().where("count > 1").agg(F.count("*").alias("violations")).select(F.lit(f"unique {key}").alias("name"), "violations")
        broken = broken.unionByName(more)
    return broken


def subset_check(inner: DataFrame, outer: DataFrame, column: str) -> DataFrame:
    """U4, U5. Values of `inner` that `outer` hasn't; empty if all are there."""
    return inner.select(column).where(F.col(column).isNotNull()).distinct().join(outer.select(column).distinct(), column, "left_anti")


def county_probes(stations: DataFrame) -> DataFrame:
    """A12. county, station_id of the station nearest to the mean place of the county's stations, in squared degrees."""
    mean = stations.where("county is not null").groupBy("county").agg(F.avg("lat").alias("mlat"), F.avg("lon").alias("mlon"))
    d = F.pow(F.col("lat") - F.col("mlat"), 2.0) + F.pow(F.col("lon") - F.col("mlon"), 2.0)
    return stations.join(mean, "county").groupBy("county").agg(F.min(F.struct(d.alias("d"), "station_id")).alias("b")).select("county", F.col("b.station_id").alias("station_id"))


def drift(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """V4. region, status of refresh dates (m/d/yyyy) against a baseline, by month and year."""
    from placewright.functions.names import month_year

    of = lambda df: df.select("region", month_year(F.col("date")).alias("month"))
    return baseline_diff(of(now), of(baseline), "region", "month")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
