"""Scores of an investigator: rates with intervals, rankings, grounding, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.columns import wilson


def rates(rows: DataFrame, by: list[str], hit: Column) -> DataFrame:
    """by, n, hits, rate, low, high: one partial aggregate, the interval in closed form on its result."""
    counted = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return counted.select(*by, "n", "hits", F.round(F.col("hits") / F.col("n"), 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def rate_rollup(rows: DataFrame, by: str, hit: Column) -> DataFrame:
    """As rates, for each value of `by` and for all (named all) in one pass."""
    counted = rows.rollup(by).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.grouping(by).alias("g"))
    low, high = wilson(F.col("hits"), F.col("n"))
    name = F.when(F.col("g") == 1, "all").otherwise(F.col(by))
    return counted.select(name.alias(by), "n", "hits", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def rankings(ranked: DataFrame, key: str, gold: str, answers: str) -> DataFrame:
    """key, hit1, hit3, reciprocal, recall5 of an ordered array of answers against an array of right ones."""
    first = F.array_min(F.transform(F.array_distinct(gold), lambda g: F.nullif(F.array_position(answers, g), F.lit(0).cast("long"))))
    top = F.array_distinct(F.slice(answers, 1, 5))
    return ranked.select(
        key,
        F.coalesce((first <= 1).cast("int"), F.lit(0)).alias("hit1"),
        F.coalesce((first <= 3).cast("int"), F.lit(0)).alias("hit3"),
        F.round(F.coalesce(1 / first, F.lit(0.0)), 6).alias("reciprocal"),
        F.round(F.size(F.array_intersect(top, gold)) / F.size(F.array_distinct(gold)), 6).alias("recall5"),
    )


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """what, value, n of every column, counted in one pass over the rows by grouping sets."""
    counted = rows.groupingSets([[F.col(c)] for c in columns], *map(F.col, columns)).agg(F.count("*").alias("n"), *[F.grouping(c).alias(f"without_{c}") for c in columns])
    told = F.coalesce(*[F.when(F.col(f"without_{c}") == 0, F.struct(F.lit(c).alias("what"), F.col(c).cast("string").alias("value"))) for c in columns])
    return counted.select(told.alias("t"), "n").select("t.what", "t.value", "n")


def counts_in_all(rows: DataFrame, by: str, values: list[str], also: str) -> DataFrame:
    """by, also, n for every value of `by`, those without rows included (also null, n 0)."""
    every = rows.sparkSession.createDataFrame([(v,) for v in values], f"{by} string")
    counted = rows.groupBy(by, also).agg(F.count("*").alias("n"))
    return every.join(counted, by, "left").select(by, also, F.coalesce("n", F.lit(0)).alias("n"))


def hash_sample(rows: DataFrame, key: str, k: int, seed: str) -> DataFrame:
    """k rows, those of the smallest digest of seed and key: the same rows on every run, found as a top-k."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(k)


def upsert(kept: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """fresh, and the kept rows whose keys fresh doesn't have."""
    return kept.join(fresh.select(key), key, "left_anti").unionByName(fresh)


#: Classes of values of a group between which the percentile's own class is told apart.
CLASSES = 1024


def totals(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, n, total, mean, p95: nearest-rank percentile, exactly.

    Values are first counted by class, between the group's extremes; only the class that holds the rank is then ranked
    value by value, so no task gets all values of a group.
    """
    name = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by]
    rows = rows.withColumn("g", F.struct(*[F.col(c) for c in by], F.hash(*name).alias("h")) if by else F.struct(F.lit(0).alias("h")))
    ends = rows.groupBy("g").agg(F.count(value).alias("known"), F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"), F.round(F.avg(value), 6).alias("mean"))
    share = F.when(F.col("high") > F.col("low"), F.floor((F.col(value) - F.col("low")) / (F.col("high") - F.col("low")) * (CLASSES - 1))).otherwise(0)
    held = rows.where(F.col(value).isNotNull()).select("g", value).join(ends.select("g", "known", "low", "high"), "g")
    counted = held.groupBy("g", share.alias("class"), value).agg(F.count("*").alias("m"), F.first("known").alias("known"))
    classes = counted.groupBy("g", "class").agg(F.sum("m").alias("m"), F.first("known").alias("known"))
    rank = F.ceil(F.col("known") * 0.95)
    upto = F.sum("m").over(Window.partitionBy("g").orderBy("class").rowsBetween(Window.unboundedPreceding, 0))
    mine = classes.withColumn("upto", upto).where((F.col("upto") >= rank) & (F.col("upto") - F.col("m") < rank)).select("g", "class", (F.col("upto") - F.col("m")).alias("before"))
    place = F.sum("m").over(Window.partitionBy("g").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    p95 = counted.join(mine, ["g", "class"]).withColumn("place", place).where(F.col("place") >= rank).groupBy("g").agg(F.min(value).alias("p95"))
    return ends.join(p95, "g", "left").select(*[F.col(f"g.{c}").alias(c) for c in by], "n", "total", "mean", "p95")
