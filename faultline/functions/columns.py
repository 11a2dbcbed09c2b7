"""Column expressions: intervals, ranks, paths and kinds, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions import patterns as P


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval, within 0 and 1; null where n is 0."""
    p, total = hits / F.nullif(n, F.lit(0)), F.nullif(n, F.lit(0)).cast("double")
    scale = 1 + z * z / total
    centre = (p + z * z / (2 * total)) / scale
    half = z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total)) / scale
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - half)), F.when(n > 0, F.least(F.lit(1.0), centre + half))


def first_match(value: Column, table, otherwise: str | None) -> Column:
    """The name of the first (name, pattern) whose pattern the value holds."""
    out = F
    for name, pattern in table:
        out = out.when(value.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit(otherwise))


def stage(step: Column, job: Column) -> Column:
    """Stage by the step's name, else by the job's, else other."""
    return F.coalesce(first_match(F.lower(step), P.STAGES, None), first_match(F.lower(job), P.STAGES, None), F.lit("other"))


def file_kind(path: Column, changed: Column) -> Column:
    """ci, doc, dep, docker, config, test or source, by the path; changed: an array of the lines that changed."""
    versions = F.exists(F.coalesce(changed, F.array().cast("array<string>")), lambda x: x.rlike(P.VERSION))
    return (
        F.when(path.startswith(".github/"), "ci")
        .when(path.rlike(P.DOC_PATH), "doc")
        .when(path.rlike(P.DEPENDENCY_FILE) | (path.rlike(P.MAYBE_DEPENDENCY_FILE) & versions), "dep")
        .when(path.rlike(P.DOCKER_FILE), "docker")
        .when(path.rlike(P.CONFIG_FILE), "config")
        .when(path.rlike(P.TEST_FILE), "test")
        .otherwise("source")
    )


def safe_path(raw: Column) -> tuple[Column, Column]:
    """A path relative to its root and null, or null and what is wrong with it."""
    trimmed = F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\s+|\s+$", "")
    path = F.regexp_replace(F.translate(trimmed, "\\", "/"), "^/+|/+$", "")
    segments = F.split(path, "/")
    problem = (
        F.when(path == "", "empty")
        .when(F.length(path) > 300, "too long")
        .when(trimmed.startswith("/") | trimmed.rlike("^[A-Za-z]:"), "not relative")
        .when(F.arrays_overlap(segments, F.array(F.lit(".."), F.lit(".git"))), "leaves the root")
        .when(F.arrays_overlap(segments, F.array(F.lit(""), F.lit("."))), "empty segment")
    )
    return F.when(problem.isNull(), path), problem


def precedence(categories: Column) -> Column:
    """The first of the categories by precedence, UNKNOWN if there is none."""
    ranks = F.array(*map(F.lit, P.PRECEDENCE))
    found = F.array_min(F.filter(F.transform(categories, lambda c: F.array_position(ranks, c)), lambda k: k > 0))
    return F.coalesce(F.try_element_at(ranks, found.cast("int")), F.lit("UNKNOWN"))


def reasons(*named: tuple[str | Column, Column], between: str = ",") -> Column:
    """The texts whose conditions hold, in order, joined by commas."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(t) if isinstance(t, str) else t) for t, c in named])), between)


def is_sha(value: Column) -> Column:
    return F.coalesce(value.rlike(P.SHA), F.lit(False))


def is_repository(value: Column) -> Column:
    """owner/name: neither is empty, and there is no other slash."""
    return F.coalesce(value.rlike(P.REPOSITORY), F.lit(False))


def has_text_suffix(path: Column) -> Column:
    return F.coalesce(path.rlike(P.TEXT_SUFFIX), F.lit(False))


def sanitized(text: Column) -> Column:
    """The text without tags, and with blanks for control characters other than tabs and line ends."""
    return F.regexp_replace(F.regexp_replace(text, "</?[A-Za-z][^<>]*>", "[tag removed]"), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " ")


def bounded(result: Column, reads_file: Column) -> Column:
    """A tool's result, sanitized, and cut where it is longer than its tool may be; file reads have more room."""
    clean, most = sanitized(result), F.when(reads_file, P.MAX_READ).otherwise(P.MAX_RESULT)
    return F.when(F.length(clean) > most, F.concat(F.substring(clean, F.lit(1), most), F.lit(P.RESULT_CUT))).otherwise(clean)


def packed_paths(evidence: Column) -> Column:
    """Paths whose contents an evidence text carries, each once, in order; null has none."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(evidence, F.lit("")), F.lit(P.PACKED_FILE), F.lit(1))))


def grounding_corpus(log: Column, errors: Column, message: Column, diff: Column, messages: Column, contents: Column) -> Column:
    """All text that an investigator was given, a part a line; absent parts leave no line, empty ones an empty line."""
    return F.concat_ws("\n", log, errors, message, diff, messages, contents)
