"""Run histories: failure streaks, the jobs and steps that failed, and what a miner counts and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def red_streaks(runs: DataFrame, keys: list[str], order: list[str], red: Column, green: Column) -> DataFrame:
    """keys, streak_length, first_red, last_red, prev_green, next_green: maximal runs of red without a green between.

    A green's number is how many greens came before it, itself included; the reds after it share that number, so a
    streak's previous green has its number and its next green the following one. Rows that are neither are ignored.
    order ends in a unique column, whose values the result holds. One shuffle by the keys serves window and grouping.
    """
    at = F.struct(*order)
    seen = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    marked = runs.where(red | green).select(*keys, at.alias("at"), red.alias("red"))
    marked = marked.withColumn("greens", F.sum(F.when(F.col("red"), 0).otherwise(1)).over(seen))
    # the number of greens and its reds and its green are one group; the next group's green closes it
    grouped = marked.groupBy(*keys, "greens").agg(
        F.count_if("red").alias("streak_length"),
        F.min(F.when(F.col("red"), F.col("at"))).alias("first"),
        F.max(F.when(F.col("red"), F.col("at"))).alias("last"),
        F.min(F.when(~F.col("red"), F.col("at"))).alias("green"),
    )
    following = F.lead("green").over(Window.partitionBy(*keys).orderBy("greens"))
    name = order[-1]
    return grouped.withColumn("next", following).where("streak_length > 0").select(*keys, "streak_length", *[F.col(f"{c}.{name}").alias(to) for c, to in (("first", "first_red"), ("last", "last_red"), ("green", "prev_green"), ("next", "next_green"))])


def breaking_base(streaks: DataFrame, firsts: DataFrame, keys: list[str]) -> DataFrame:
    """streaks with base and base_kind: the last green, else the key's first run, else none."""
    joined = streaks.join(firsts, keys, "left")
    own_first = F.when(F.col("first_run") != F.col("first_red"), F.col("first_run"))
    kind = F.when(F.col("prev_green").isNotNull(), "last_green").when(own_first.isNotNull(), "first_run").otherwise("none")
    return joined.select(*keys, "first_red", F.coalesce("prev_green", own_first).alias("base"), kind.alias("base_kind"))


def first_failed(steps: DataFrame, job: str, failed: Column, order: list[str], value: str) -> DataFrame:
    """job, first_failed, n_failed, others: a job's failed steps in order, the first and up to twenty that follow.

    Steps are ranked before they are gathered, so that a job's list holds 21 at most; the others are only counted.
    """
    mine = steps.where(failed).select(job, *order, value)
    rank = F.row_number().over(Window.partitionBy(job).orderBy(*order, value))
    few = mine.withColumn("k", rank).where("k <= 21").groupBy(job).agg(F.array_sort(F.collect_list(F.struct("k", value))).alias("all"))
    counted = mine.groupBy(job).agg(F.count("*").alias("n_failed"))
    names = F.transform("all", lambda s: s[value].cast("string"))
    return few.join(counted, job).select(job, F.col("all")[0][value].alias("first_failed"), "n_failed", F.array_join(F.slice(names, 2, 20), ",").alias("others"))


def passed_in(failed: DataFrame, green: DataFrame, on: list[str], success: Column) -> DataFrame:
    """failed with passed: null where green has no such job, else whether any of them succeeded."""
    outcome = green.groupBy(*on).agg(F.bool_or(F.coalesce(success, F.lit(False))).alias("passed"))
    return failed.join(outcome, on, "left")


def capped(rows: DataFrame, by: str, order: list[str], each: int, overall: int) -> DataFrame:
    """The first `each` rows of each group, of those the first `overall`.

    The overall cap is a top-k over survivors; no window over all rows is needed.
    """
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("__rank", rank).where(F.col("__rank") <= each).drop("__rank").orderBy(*order).limit(overall)
