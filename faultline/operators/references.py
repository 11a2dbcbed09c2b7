"""What logs, commits and diagnoses refer to: files, reverted commits, quoted evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions import patterns as P


def file_references(lines: DataFrame, key: str) -> DataFrame:
    """key, rank, path: distinct paths that the lines name, tracebacks before others in a line, first seen first."""
    named = F.concat(*[F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in (P.TRACEBACK_FILE, P.PATH_LINE)])
    found = lines.select(key, "pos", F.posexplode(named).alias("k", "path"))
    firsts = found.groupBy(key, "path").agg(F.min(F.struct("pos", "k")).alias("at"))
    ranked = firsts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "path"))).alias("all"))
    return ranked.select(key, F.posexplode(F.transform("all", lambda x: x["path"])).alias("rank", "path"))


def resolve_paths(named: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """key, path: the repository files that raw paths (key, raw) stand for, each once.

    files: path, distinct. A path is itself if there is such a file; else, below a site folder or if it is relative and
    outside environments, the one file that ends in it. Every file is listed under all of its endings and summed up by
    ending, so both lookups are equi-joins and no path is held against all files.
    """
    parts = F.split("path", "/")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    listed = files.select("path", F.posexplode(endings).alias("cut", "ending"))
    by_ending = listed.groupBy("ending").agg(
        F.max(F.when(F.col("cut") == 0, F.col("path"))).alias("whole"),
        F.count_if(F.col("cut") > 0).alias("n"),
        F.min(F.when(F.col("cut") > 0, F.col("path"))).alias("longer"),
    )
    path = F.regexp_replace(F.regexp_replace(F.translate("raw", "\\", "/"), P.WORKSPACE, ""), r"^\./", "")
    site = F.coalesce(*[F.when(F.contains("path", F.lit(d)), F.regexp_extract("path", f"^.*?{d}(.*)$", 1)) for d in P.SITE_DIRS])
    plain = ~F.col("path").startswith("/") & ~F.arrays_overlap(parts, F.array(*map(F.lit, P.NON_REPO_DIRS)))
    asked = named.select(key, path.alias("path")).distinct().withColumn("tail", F.coalesce(site, F.when(plain, F.col("path"))))
    exact = by_ending.select(F.col("ending").alias("path"), F.col("whole").alias("same")).where("same is not null")
    found = asked.join(exact, "path", "left").join(by_ending.withColumnRenamed("ending", "tail"), "tail", "left")
    one = F.when(F.contains("tail", F.lit("/")) & (F.col("n") == 1), F.col("longer"))
    return found.select(key, F.coalesce("same", "whole", one).alias("path")).where("path is not null").distinct()


def reverts(commits: DataFrame, breaking: DataFrame, key: str) -> DataFrame:
    """key, sha: of each key's commits (key, pos, sha, message) the first that reverts one of its breaking ones (key, broken)."""
    said = commits.select(key, "pos", "sha", F.explode(F.regexp_extract_all("message", F.lit(P.REVERT), F.lit(1))).alias("prefix"))
    return said.join(breaking, key).where(F.startswith("broken", F.col("prefix"))).groupBy(key).agg(F.min_by("sha", "pos").alias("sha"))


def grounding(evidence: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """items, grounded, rate, ungrounded_cases: of quotes (key, quote) those that their own case's text (key, text) holds."""
    held = evidence.join(corpus, key).select(key, F.contains(F.coalesce("text", F.lit("")), F.col("quote")).alias("held"))
    totals = held.agg(F.count("*").alias("items"), F.count_if("held").alias("grounded"), F.countDistinct(F.when(~F.col("held"), F.col(key))).alias("ungrounded_cases"))
    return totals.select("items", "grounded", F.round(F.col("grounded") / F.nullif("items", F.lit(0)), 6).alias("rate"), "ungrounded_cases")
