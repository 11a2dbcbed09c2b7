"""Reviews of labelled cases: the queue, what it shows, and the decisions that are merged into nested labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of a case's labels.
LABELS = "category string, auto_category string, label_status string, label_confidence string, root_cause_text string, fix_text string, reviewer_notes string, audited boolean"
DECISION = "category string, root_cause string, fix_text string, notes string, audit boolean"


def _said(column: str) -> Column:
    return F.nullif(F.trim(F.coalesce(column, F.lit(""))), F.lit(""))


def refuse_unknown(decisions: DataFrame, cases: DataFrame, key: str) -> None:
    """An error that names the first five decisions whose case isn't there; nothing is written before."""
    unknown = [r[0] for r in decisions.join(cases.select(key), key, "left_anti").select(key).distinct().orderBy(key).limit(5).collect()]
    if unknown:
        raise ValueError(f"no such cases: {unknown}")


def apply_reviews(cases: DataFrame, decisions: DataFrame, key: str, status: str) -> DataFrame:
    """cases (key and a struct labels, see LABELS) with the decisions (key, see DECISION; one a case) merged into labels.

    A decision without a category declines: only its notes are taken. Otherwise category, texts (blank: null) and status
    are set, the confidence is high, the first category is kept as auto_category, and a case that was audited once stays
    so. Other fields of labels and cases without a decision stay as they are. Decisions on unknown cases are refused.
    """
    refuse_unknown(decisions, cases, key)
    d = decisions.select(key, F.struct("category", _said("root_cause").alias("root"), _said("fix_text").alias("fix"), _said("notes").alias("notes"), F.coalesce("audit", F.lit(False)).alias("audit")).alias("decision"))
    labels = F.col("labels")
    declined = labels.withField("reviewer_notes", F.col("decision.notes"))
    reviewed = (
        declined.withField("auto_category", F.coalesce("labels.auto_category", "labels.category"))
        .withField("category", F.col("decision.category"))
        .withField("label_status", F.lit(status))
        .withField("label_confidence", F.lit("high"))
        .withField("root_cause_text", F.col("decision.root"))
        .withField("fix_text", F.col("decision.fix"))
        .withField("audited", F.coalesce("labels.audited", F.lit(False)) | F.col("decision.audit"))
    )
    merged = F.when(F.col("decision").isNull(), labels).when(F.col("decision.category").isNull(), declined).otherwise(reviewed)
    return cases.join(d, key, "left").withColumn("labels", merged).drop("decision")


def review_counts(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """applied, declined, unchanged: how many cases a set of decisions changes, and how."""
    counted = decisions.agg(F.count("category").alias("applied"), F.count_if(F.col("category").isNull()).alias("declined"), F.count("*").alias("n"))
    return cases.agg(F.count("*").alias("cases")).join(counted).select("applied", "declined", (F.col("cases") - F.col("n")).alias("unchanged"))


def queue(cases: DataFrame, key: str, audits: int, seed: str) -> DataFrame:
    """key, why: all cases that need a review, and so many to audit of those verified by rule, less those audited before.

    Which ones are audited is settled by a hash of the key and the seed, so the same queue comes out again.
    """
    review = cases.where("labels.label_status = 'needs_review'").select(key, F.lit("review").alias("why"))
    audited = F.coalesce("labels.audited", F.lit(False))
    done = cases.where(audited).count()
    rank = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    candidates = cases.where((F.col("labels.label_status") == "auto_verified") & ~audited)
    return review.unionAll(candidates.orderBy(rank, key).limit(max(0, audits - done)).select(key, F.lit("audit").alias("why")))


def rendered(queued: DataFrame, cases: DataFrame, key: str, text: str, *, blind: bool = False, head: int = 400) -> DataFrame:
    """key, why, shown: what a reviewer sees of each queued case; its category and status only if the review isn't blind."""
    told = F.lit("(hidden)") if blind else F.concat_ws(" ", F.coalesce("labels.category", F.lit("-")), F.concat(F.lit("["), F.coalesce("labels.label_status", F.lit("-")), F.lit("]")))
    shown = F.concat_ws("\n", F.concat(F.lit("case: "), F.col(key).cast("string"), F.lit(" ("), F.col("why"), F.lit(")")), F.concat(F.lit("label: "), told), F.substring(F.coalesce(text, F.lit("")), 1, head))
    return queued.join(cases, key).select(key, "why", shown.alias("shown"))
