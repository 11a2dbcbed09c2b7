"""Rule engines: what a log says, what a fix says, and what both say together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions import patterns as P
from faultline.functions.columns import first_match, reasons, stage
from faultline.functions.factors import may_match


def _matched(lines: DataFrame, text: str, rules) -> DataFrame:
    """lines with line, the stripped text, once for each rule that matches it, with the rule's rank. Only lines that match leave the scan.

    Factors are looked for in the text as it is: Spark would strip it anew for each of them.
    """
    maybe = lines.where(may_match(F.col(text), list(rules))).withColumn("line", F.regexp_replace(text, r"^\s+|\s+$", ""))
    ranks = F.array_compact(F.array(*[F.when(may_match(F.col(text), [p]) & F.col("line").rlike(p), F.lit(k)) for k, p in enumerate(rules)]))
    return maybe.withColumn("rank", F.explode(ranks))


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores, where they come in fewer parts than that: a table of one row group is one task else."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def told(texts: DataFrame, text: str) -> DataFrame:
    """The texts that any rule on lines may match, before they are cut into lines."""
    patterns = [*[r[3] for r in P.CLASSIFY_RULES], *[r[2] for r in P.LOG_RULES], P.FALLBACK_RULE[2]]
    return spread(texts).where(may_match(F.col(text), patterns))


def classify(lines: DataFrame, cases: DataFrame, key: str = "id", pos: str = "pos") -> DataFrame:
    """key, rule, category, confidence, line of every case: the first rule that any line matches, with its first line.

    Rules come before lines: the best row by (rule, line), a partial aggregate before the shuffle. Where no rule matches,
    failing tests decide, then what the step is called, else it is unknown. cases: key, step, job, tests (boolean).
    """
    rules = [r[3] for r in P.CLASSIFY_RULES]
    best = _matched(lines, "text", rules).groupBy(key).agg(F.min(F.struct("rank", pos, "line")).alias("best"))
    pick = lambda k: F.element_at(F.array(*[F.lit(r[k]) for r in P.CLASSIFY_RULES]), F.col("best.rank") + 1)
    hint = first_match(F.concat_ws(" ", F.coalesce("step", F.lit("")), "job"), P.STEP_HINTS, None)
    matched, tests = F.col("best").isNotNull(), F.coalesce("tests", F.lit(False))
    rule = F.when(matched, pick(0)).when(tests, "failing_tests").when(hint.isNotNull(), "step_name_hint").otherwise("no_rule")
    category = F.when(matched, pick(1)).when(tests, "TEST_FAILURE").otherwise(F.coalesce(hint, F.lit("UNKNOWN")))
    confidence = F.when(matched, pick(2)).when(tests, 0.6).when(hint.isNotNull(), 0.3).otherwise(0.1)
    return cases.join(best, key, "left").select(key, rule.alias("rule"), category.alias("category"), confidence.alias("confidence"), F.col("best.line").alias("line"))


def log_signal(lines: DataFrame, cases: DataFrame, key: str = "id", pos: str = "pos") -> DataFrame:
    """key, category, rule of every case: of the categories that its lines match, that of highest precedence.

    A category's rule is that of its first line. Failing tests count as a match of their own. Without any match a hook's
    failure decides, then the stage, else it is unknown. cases: key, step, job, tests (boolean).
    """
    every = (*P.LOG_RULES, P.FALLBACK_RULE)
    matched = _matched(lines, "text", [r[2] for r in every])
    rule, category = (F.element_at(F.array(*[F.lit(r[k]) for r in every]), F.col("rank") + 1) for k in (0, 1))
    told = matched.select(key, pos, "rank", category.alias("category"), rule.alias("rule"), (F.col("rank") == len(P.LOG_RULES)).alias("hook"))
    tests = cases.where("tests").select(key, F.lit(1 << 30).alias(pos), F.lit(-1).alias("rank"), F.lit("TEST_FAILURE").alias("category"), F.lit("pytest_failed_tests").alias("rule"), F.lit(False).alias("hook"))
    first = told.unionByName(tests).groupBy(key, "hook", "category").agg(F.min(F.struct(pos, "rank", "rule")).alias("first"))
    order = F.array_position(F.array(*map(F.lit, P.PRECEDENCE)), F.col("category"))
    best = first.groupBy(key).agg(F.min(F.struct("hook", order.alias("order"), "category", "first")).alias("best"))
    at = stage(F.coalesce("step", F.lit("")), F.coalesce("job", F.lit("")))
    by_stage = F.element_at(F.create_map(*[F.lit(x) for pair in P.STAGE_FALLBACK.items() for x in pair]), at)
    found = cases.join(best, key, "left").select(key, "best", by_stage.alias("by_stage"), at.alias("stage"))
    said = F.coalesce("best.first.rule", F.when(F.col("by_stage").isNotNull(), F.concat(F.lit("stage_fallback:"), F.col("stage"))), F.lit("no_rule_matched"))
    return found.select(key, F.coalesce("best.category", "by_stage", F.lit("UNKNOWN")).alias("category"), said.alias("rule"))


def searched(errors: DataFrame, excerpt: DataFrame, key: str = "id") -> DataFrame:
    """key, pos, text of the lines in the order that rules search them: error lines (key, rank, line), then the excerpt (key, pos, text)."""
    first = errors.select(key, (F.col("rank") - (1 << 30)).cast("int").alias("pos"), F.col("line").alias("text"))
    return first.unionByName(excerpt.select(key, F.col("pos").cast("int").alias("pos"), "text"))


def diagnose(classified: DataFrame, top: DataFrame, key: str = "id", signatures: DataFrame | None = None, changes: DataFrame | None = None) -> DataFrame:
    """key, failure_type, confidence, root_cause: a template over what classify() says and the top suspect (key, path, reasons).

    The root error (key, exception, message), if known, is said in place of the rule's line. Of a suspect that changed
    before the failure the commit's subject (changes: key, path, subject) is told. Without a suspect the confidence is a
    fifth less; a policy check is nobody's file.
    """
    rows = classified.join(top, key, "left")
    for more, on, names in ((signatures, [key], ["exception", "message"]), (changes, [key, "path"], ["subject"])):
        rows = rows.join(more.select(*on, *names), on, "left") if more is not None else rows.select("*", *[F.lit(None).cast("string").alias(c) for c in names])
    words = F.element_at(F.create_map(*[F.lit(x) for pair in P.WHAT_FAILED.items() for x in pair]), F.col("category"))
    root = F.concat(F.lit("("), F.col("exception"), F.lit(": "), F.substring(F.coalesce("message", F.lit("")), 1, 200), F.lit(")"))
    said = F.coalesce(root, F.concat(F.lit("("), F.substring("line", 1, 200), F.lit(")")))
    blamed = F.col("category") != "POLICY_CHECK_FAILURE"
    file = F.when(blamed, F.concat(F.lit("Most suspicious file: "), F.col("path"), F.lit(" ["), F.replace("reasons", F.lit(","), F.lit(", ")), F.lit("].")))
    before = F.when(blamed, F.concat(F.lit("It changed shortly before, in '"), F.substring("subject", 1, 100), F.lit("'.")))
    confidence = F.round(F.when(F.col("path").isNull(), F.col("confidence") * 0.8).otherwise(F.col("confidence")), 3)
    return rows.select(key, F.col("category").alias("failure_type"), confidence.alias("confidence"), F.concat_ws(" ", words, said, file, before).alias("root_cause"))


def evidence_items(classified: DataFrame, lines: DataFrame, top: DataFrame, sections: DataFrame, cases: DataFrame, key: str = "id", pos: str = "pos") -> DataFrame:
    """key, items of every case: at most four pieces of evidence (source, location, excerpt, explanation), in this order.

    The line that the rule matched; the first other line that tells of a failed test; the top suspect's section of the
    diff; the first line that names the top suspect. What isn't there is left out. classified as of classify(); lines:
    key, pos, text of the excerpt; top: key, path; sections: key, section; cases: key, step, job. The lines are shuffled
    once, for the join and the two minima.
    """
    asked = cases.select(key, F.coalesce(F.nullif("step", F.lit("")), F.col("job")).alias("stage")).join(classified.select(key, "rule", "category", "line"), key, "left")
    asked = asked.join(top.select(key, "path"), key, "left").join(sections.select(key, "section"), key, "left")
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    told = lines.select(key, pos, "text").join(asked.select(key, "line", "path"), key)
    failed = F.when(text.startswith("FAILED ") & ~text.eqNullSafe(F.col("line")), F.struct(pos, text.alias("text")))
    naming = F.when(F.contains("text", F.col("path")), F.struct(pos, text.alias("text")))
    firsts = told.groupBy(key).agg(F.min(failed)["text"].alias("failed"), F.min(naming)["text"].alias("naming"))
    rows = asked.join(firsts, key, "left")

    def item(there: str, source: str, location, explanation):
        parts = F.struct(F.lit(source).alias("source"), location.alias("location"), F.substring(there, 1, P.MAX_EXCERPT).alias("excerpt"), explanation.alias("explanation"))
        return F.when(F.col(there) != "", parts)

    step = F.concat(F.lit("failed step: "), F.col("stage"))
    items = F.array_compact(F.array(
        item("line", "ci_log", step, F.concat(F.lit("rule "), F.col("rule"), F.lit(" takes it for "), F.col("category"))),
        item("failed", "ci_log", step, F.lit("the first test that is said to fail")),
        item("section", "git_diff", F.col("path"), F.lit("changed since the last green state")),
        item("naming", "ci_log", step, F.concat(F.lit("the log names "), F.col("path"))),
    ))
    return rows.select(key, items.alias("items"))


def combine(signals: DataFrame) -> DataFrame:
    """signals with category, confidence, status, rule, from log_category, log_rule, fix_category, fix_rule, compatible, overrides, decisive."""
    log = F.coalesce("log_category", F.lit("UNKNOWN"))
    weak = F.coalesce(F.col("log_rule").startswith("stage_fallback") | (F.col("log_rule") == "no_rule_matched"), F.lit(False))
    mixed, agree = F.col("fix_rule") == "fix_mixed_change_kinds", F.col("fix_category").isNotNull() & (log == F.col("fix_category"))
    fits = F.array_contains("compatible", log)
    case = (
        F.when(mixed, "fix_too_mixed_to_verify")
        .when(agree, "signals_agree")
        .when(fits & F.col("overrides"), "fix_refines_log")
        .when(fits & weak, "weak_log_signal")
        .when(fits, "fix_consistent_with_log")
        .otherwise("signals_conflict")
    )
    rule = F.col("rule")
    category = F.when(rule == "fix_refines_log", F.coalesce("fix_category", log)).when((rule == "signals_conflict") & (log == "UNKNOWN"), F.coalesce("fix_category", F.lit("UNKNOWN"))).otherwise(log)
    confidence = (
        F.when(rule == "signals_agree", F.when(weak, "medium").otherwise("high"))
        .when(rule == "fix_refines_log", F.when(F.col("decisive"), "high").otherwise("medium"))
        .when(rule == "fix_consistent_with_log", "medium")
        .otherwise("low")
    )
    status = F.when(rule.isin("signals_agree", "fix_refines_log", "fix_consistent_with_log"), "auto_verified").otherwise("needs_review")
    return signals.withColumn("rule", case).withColumns({"category": category, "confidence": confidence, "status": status})


def score_fix(evidence: DataFrame) -> DataFrame:
    """evidence with status, confidence, reasons.

    has_green, relation, n_commits, n_files, max_commits, job_passed (may be null), docs_only, overlaps, reverts; a
    candidate, if there is one (see fixes.fix_evidence), stays only where the window is looked at.
    """
    near = F.col("relation").isin("ahead", "amend")
    n = F.col("n_commits")
    left = (
        F.when(~F.col("has_green"), "no_success_run_after_streak")
        .when(F.col("relation") == "identical", "green_run_tested_same_commit")
        .when(~F.coalesce(near, F.lit(False)), F.concat(F.lit("relation_"), F.coalesce("relation", F.lit("None"))))
    )
    early = F.when(n == 0, "empty_fix_window").when(F.col("n_files") == 0, "fix_window_changes_no_files").when(n > F.col("max_commits"), "fix_window_too_large")
    base = F.when(n == 1, 0).when(n <= 3, 1).otherwise(2) + F.when(F.coalesce("job_passed", F.lit(False)), 0).otherwise(1)
    level = F.when(F.col("docs_only"), 2).otherwise(base)
    level = F.least(F.when(F.col("reverts"), F.least(level, F.lit(1))).otherwise(level), F.lit(2))
    go = F.col("left").isNull() & F.col("early").isNull()
    confidence = F.when(F.col("left").isin("no_success_run_after_streak", "green_run_tested_same_commit"), None).when(F.col("left").isNotNull(), "low").when(F.col("early") == "fix_window_changes_no_files", None).when(F.col("early").isNotNull(), "low").otherwise(F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), level + 1))
    status = (
        F.when(F.col("left") == "no_success_run_after_streak", "no_green_found")
        .when((F.col("left") == "green_run_tested_same_commit") | (F.col("left").isNull() & (F.col("early") == "fix_window_changes_no_files")), "flaky_rerun")
        .when(~go | (F.col("confidence") == "low"), "ambiguous")
        .otherwise("matched")
    )
    said = reasons(
        (F.col("left"), F.col("left").isNotNull()),
        (F.concat(F.lit("relation_"), F.col("relation")), F.col("left").isNull()),
        (F.concat(F.lit("window_commits_"), n.cast("string")), F.col("left").isNull()),
        (F.col("early"), F.col("left").isNull() & F.col("early").isNotNull()),
        ("failed_job_absent_in_green_run", go & F.col("job_passed").isNull()),
        ("failed_job_not_successful_in_green_run", go & (F.col("job_passed") == F.lit(False))),
        ("fix_touches_only_docs", go & F.col("docs_only")),
        ("fix_overlaps_log_referenced_files", go & F.col("overlaps")),
        ("revert_of_breaking_commit", go & F.col("reverts")),
    )
    if "candidate" in evidence.columns:
        evidence = evidence.withColumn("candidate", F.when(left.isNull() & early.isNull(), F.col("candidate")))
    return evidence.withColumns({"left": left, "early": early}).withColumn("confidence", confidence).withColumns({"status": status, "reasons": said}).drop("left", "early")
