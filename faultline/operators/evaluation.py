"""Reports on predictions: who is scored, how often they are right or abstain, and why a miss was missed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import patterns as P
from faultline.functions.columns import wilson


def eligibility(fix_status: Column, category: Column, files: Column) -> tuple[Column, Column]:
    """The code files that a fix changed and 'eligible', or null and why a case isn't scored for its files."""
    code = F.filter(F.array_distinct(files), lambda f: ~f.rlike(P.DOC_PATH))
    why = (
        F.when(~F.coalesce(fix_status == "matched", F.lit(False)), F.concat(F.lit("fix_status:"), F.coalesce(fix_status, F.lit("None"))))
        .when(category.isin(*P.NON_CODE_CATEGORIES), F.concat(F.lit("non_code_category:"), category))
        .when(F.coalesce(F.size(code), F.lit(0)) == 0, "fix_changes_only_docs")
        .otherwise("eligible")
    )
    return F.when(why == "eligible", code), why


def with_predictions(cases: DataFrame, predictions: DataFrame, key: str, order: str | list[str] | None = None) -> DataFrame:
    """Cases with their predictions; a case without one, or predictions of several systems, is an error when it is read.

    predictions: key, system and further columns; with `order`, a column or several, the last one of a case by them counts,
    else a case may have only one. The systems are counted beside the join, in one row.
    """
    if order:
        by = [order] if isinstance(order, str) else list(order)
        others = [c for c in predictions.columns if c != key]
        predictions = predictions.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*by)).alias("last")).select(key, "last.*")
    systems = predictions.agg(F.countDistinct("system").alias("systems"))
    joined = cases.join(predictions.withColumn("predicted", F.lit(True)), key, "left").join(F.broadcast(systems))
    checked = F.when(F.col("systems") > 1, F.raise_error(F.lit("predictions come from more than one system"))).when(F.col("predicted").isNull(), F.raise_error(F.concat(F.lit("no prediction for "), F.col(key).cast("string"))))
    return joined.withColumn(key, F.coalesce(checked.cast(dict(cases.dtypes)[key]), F.col(key))).drop("systems", "predicted")


def accuracy_by(rows: DataFrame, status: str, gold: str, guess: str) -> DataFrame:
    """status, n, hits, rate, low, high for each status and for all; a missing guess counts as ERROR, so as wrong."""
    told = F.coalesce(F.col(guess), F.lit("ERROR"))
    counted = rows.rollup(status).agg(F.count("*").alias("n"), F.count_if(F.col(gold).eqNullSafe(told)).alias("hits"), F.grouping(status).alias("g"))
    low, high = wilson(F.col("hits"), F.col("n"))
    name = F.when(F.col("g") == 1, "all").otherwise(F.col(status))
    return counted.select(name.alias("status"), "n", "hits", F.round(F.col("hits") / F.col("n"), 3).alias("rate"), F.round(low, 3).alias("low"), F.round(high, 3).alias("high"))


def abstention(rows: DataFrame, guess: str) -> DataFrame:
    """cases, abstained, rate: guesses UNKNOWN among all cases, those without a guess included; null without cases."""
    counted = rows.agg(F.count("*").alias("cases"), F.count_if(F.col(guess) == "UNKNOWN").alias("abstained"))
    return counted.select("cases", "abstained", F.round(F.col("abstained") / F.nullif("cases", F.lit(0)), 3).alias("rate"))


def summary(scores: DataFrame) -> DataFrame:
    """n, hit1 and hit3 with their rates and intervals, mrr, recall5, of rows of hit1, hit3, reciprocal, recall5."""
    counted = scores.agg(F.count("*").alias("n"), F.sum("hit1").alias("hits1"), F.sum("hit3").alias("hits3"), F.round(F.avg("reciprocal"), 3).alias("mrr"), F.round(F.avg("recall5"), 3).alias("recall5"))
    out = ["n", "mrr", "recall5"]
    for k in (1, 3):
        low, high = wilson(F.col(f"hits{k}"), F.col("n"))
        out += [f"hits{k}", F.round(F.col(f"hits{k}") / F.col("n"), 3).alias(f"rate{k}"), F.round(low, 3).alias(f"low{k}"), F.round(high, 3).alias(f"high{k}")]
    return counted.select(*out)


def bucket(gold: Column, predicted: Column, visible: Column, sent: Column, existing: Column) -> Column:
    """hit, reasoning, name_only, blind or impossible: what an investigator that missed had seen of the right files."""
    top = F.try_element_at(predicted, F.lit(1))
    seen = F.array_intersect(gold, visible)
    return (
        F.when(F.coalesce(F.array_contains(gold, top), F.lit(False)), "hit")
        .when(F.size(F.array_intersect(seen, sent)) > 0, "reasoning")
        .when(F.size(seen) > 0, "name_only")
        .when(F.size(F.array_intersect(gold, existing)) > 0, "blind")
        .otherwise("impossible")
    )


def bucket_counts(rows: DataFrame, column: str) -> DataFrame:
    """bucket, n, share, reachable_share, ceiling of all five buckets, those without rows included."""
    one = rows.agg(F.count("*").alias("total"), *[F.count_if(F.col(column) == b).alias(b) for b in P.BUCKETS])
    told = one.select("total", (F.col("name_only") + F.col("blind")).alias("reachable"), F.col("hit").alias("hits"), F.explode(F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(b).alias("n")) for b in P.BUCKETS])).alias("b"))
    total = F.nullif("total", F.lit(0))
    return told.select("b.bucket", "b.n", F.round(F.col("b.n") / total, 3).alias("share"), F.round(F.col("reachable") / total, 3).alias("reachable_share"), F.round((F.col("hits") + F.col("reachable")) / total, 3).alias("ceiling"))


def comparable(reports: DataFrame) -> DataFrame:
    """reports, counts, comparable: whether all reports (system, scored) were scored on as many cases."""
    return reports.agg(F.count("*").alias("reports"), F.countDistinct("scored").alias("counts")).select("reports", "counts", (F.col("counts") <= 1).alias("comparable"))


def selected(cases: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The cases that are wanted (key); a wanted key that no case has is an error when it is read."""
    found = wanted.distinct().join(cases.withColumn("known", F.lit(True)), key, "left")
    missing = F.when(F.col("known").isNull(), F.raise_error(F.concat(F.lit("unknown case id "), F.col(key).cast("string"))))
    return found.withColumn(key, F.coalesce(missing.cast(dict(cases.dtypes)[key]), F.col(key))).drop("known")


def leaked(cases: DataFrame, seen: str, future: list[str], own: str) -> DataFrame:
    """cases with leaked: the identities of what came later that stand anywhere in the struct `seen`, in order.

    future: columns of identities or of arrays of them. The case's own identity (a column) is never one; a null isn't either.
    """
    every = F.flatten(F.array(*[F.when(F.col(c).isNotNull(), F.col(c) if dict(cases.dtypes)[c].startswith("array") else F.array(c)).otherwise(F.array().cast("array<string>")) for c in future]))
    held = cases.withColumns({"seen_text": F.to_json(seen), "later": F.array_sort(F.array_distinct(F.filter(every, lambda s: s.isNotNull() & ~s.eqNullSafe(F.col(own)))))})
    return held.withColumn("leaked", F.filter("later", lambda s: F.contains("seen_text", s))).drop("seen_text", "later")


def without_leaks(cases: DataFrame, seen: str, future: list[str], own: str, key: str) -> DataFrame:
    """The cases as they are; one that tells what came later is an error when it is read."""
    found = leaked(cases, seen, future, own)
    told = F.when(F.size("leaked") > 0, F.raise_error(F.concat(F.lit("later commits are told in the input of "), F.col(key).cast("string"), F.lit(": "), F.array_join("leaked", ","))))
    return found.withColumn(key, F.coalesce(told.cast(dict(cases.dtypes)[key]), F.col(key))).drop("leaked")
