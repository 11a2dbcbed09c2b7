"""What a fix says: kinds of changed files, kinds of Python changes, the signal of both, and the evidence of a fix window."""

from __future__ import annotations

import ast
import io
import tokenize
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from faultline.functions import patterns as P
from faultline.functions.columns import file_kind


def fix_kinds(files: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """key, kinds, dep_change, from files (key, path) of a fix and the lines (key, path, line) that it changes.

    Lines are brought to one flag a file before the join; documentation has no kind.
    """
    pinned = changed.where(F.col("line").rlike(P.VERSION)).select(key, "path").distinct().withColumn("pinned", F.lit(True))
    kind = file_kind(F.col("path"), F.when(F.col("pinned"), F.array(F.lit("x>=1"))))
    joined = files.join(pinned, [key, "path"], "left").select(key, kind.alias("kind"), F.coalesce("pinned", F.lit(False)).alias("pinned"))
    return joined.groupBy(key).agg(F.array_remove(F.sort_array(F.collect_set("kind")), "doc").alias("kinds"), F.bool_or("pinned").alias("dep_change"))


def fix_signal(fixes: DataFrame) -> DataFrame:
    """fixes with category, compatible, overrides, decisive, rule, from fix_status, kinds, dep_change and py_kind (may be null)."""
    kinds, only = F.col("kinds"), lambda *k: (F.size("kinds") > 0) & (F.size(F.array_except("kinds", F.array(*map(F.lit, k)))) == 0)
    has = lambda k: F.array_contains(kinds, k)
    code = only("source", "test")
    rule = (
        F.when(F.col("fix_status") == "flaky_rerun", "same_code_passed_later")
        .when(F.size(kinds) == 0, "fix_touches_only_docs")
        .when(only("dep") | (only("dep", "config") & has("dep") & has("config") & F.col("dep_change")), "fix_changes_only_dependencies")
        .when(only("ci"), "fix_changes_only_ci_workflows")
        .when(only("docker", "ci") & has("docker"), "fix_changes_only_docker")
        .when(only("config"), "fix_changes_only_tool_config")
        .when(code & (F.col("py_kind") == "format"), "fix_is_formatting_only")
        .when(code & (F.col("py_kind") == "noqa"), "fix_adds_lint_suppressions_only")
        .when(code & (F.col("py_kind") == "types"), "fix_changes_only_type_annotations")
        .when(code & (F.col("py_kind") == "coverage"), "fix_adds_coverage_pragmas_only")
        .when(only("test"), "fix_changes_only_tests")
        .when(code, "fix_changes_source_code")
        .otherwise("fix_mixed_change_kinds")
    )
    said = F.create_map(*[x for name, (category, fits, overrides, decisive) in P.FIX_RULES.items() for x in (F.lit(name), F.struct(F.lit(category).alias("category"), F.array(*map(F.lit, fits)).cast("array<string>").alias("compatible"), F.lit(overrides).alias("overrides"), F.lit(decisive).alias("decisive")))])
    return fixes.withColumn("rule", rule).withColumn("said", F.element_at(said, F.col("rule"))).select(*fixes.columns, "said.*", "rule")


def strongest(rank: Column) -> Column:
    """The strongest kind of Python change of a group, from its kinds: an aggregate of small numbers, not a list."""
    place = F.array_position(F.array(*map(F.lit, P.PYTHON_KINDS)), rank)
    return F.element_at(F.array(*map(F.lit, P.PYTHON_KINDS)), F.max(place).cast("int"))


def _shape(node, typed: bool):
    """A syntax tree as nested tuples; unless typed, without annotations and what is imported for them alone."""
    if isinstance(node, list):
        return tuple(s for s in (_shape(x, typed) for x in node) if s is not None)
    if not isinstance(node, ast.AST):
        return repr(node)
    skipped: tuple[str, ...] = ()
    if not typed:
        named = getattr(node, "test", None)
        if isinstance(node, ast.ImportFrom) and node.module in P.TYPING_MODULES:
            return None
        if isinstance(node, ast.If) and "TYPE_CHECKING" in (getattr(named, "id", None), getattr(named, "attr", None)):
            return None
        if isinstance(node, ast.AnnAssign):
            return None if node.value is None else _shape(ast.Assign(targets=[node.target], value=node.value), typed)
        skipped = ("returns",) if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) else ("annotation",) if isinstance(node, ast.arg) else ()
    return (type(node).__name__, *((f, _shape(getattr(node, f, None), typed)) for f in node._fields if f not in skipped))


def _remarks(source: str) -> Counter:
    try:
        return Counter(t.string for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type == tokenize.COMMENT)
    except (tokenize.TokenError, SyntaxError):
        return Counter()


def change_kind(old: str | None, new: str | None) -> str:
    """format, noqa, coverage, types or semantic: what one Python file's change amounts to."""
    if old is None or new is None:
        return "semantic"
    try:
        before, after = ast.parse(old), ast.parse(new)
    except (SyntaxError, ValueError):
        return "semantic"
    if _shape(before, True) != _shape(after, True):
        return "types" if _shape(before, False) == _shape(after, False) else "semantic"
    added = " ".join(_remarks(new) - _remarks(old))
    return next((kind for kind, marks in P.REMARK_KINDS if any(m in added for m in marks)), "format")


@F.pandas_udf(ArrayType(StringType()))
def added_remarks(old: pd.Series, new: pd.Series) -> pd.Series:
    """Comments of the new source beyond those of the old one, as often as they exceed them, in order."""
    text = lambda x: x if isinstance(x, str) else ""
    return pd.Series([sorted((_remarks(text(b)) - _remarks(text(a))).elements()) for a, b in zip(old, new, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def python_change_kind(old: pd.Series, new: pd.Series) -> pd.Series:
    """change_kind of each pair of sources; the syntax tree is the one thing here that the JVM can't see."""
    return pd.Series([change_kind(a if isinstance(a, str) else None, b if isinstance(b, str) else None) for a, b in zip(old, new, strict=True)], dtype=object)


def fix_evidence(windows: DataFrame) -> DataFrame:
    """windows with n_commits, n_files, docs_only, overlaps, reverts and the candidate commit.

    commits: an array of sha and message, oldest first; fix_files, log_files, breaking: arrays of texts.
    """
    doc = lambda f: f.startswith("docs/") | F.lower(f).rlike(P.DOC_SUFFIX)
    undone = lambda c: F.exists(F.regexp_extract_all(F.coalesce(c["message"], F.lit("")), F.lit(P.REVERT), F.lit(1)), lambda p: F.exists("breaking", lambda b: F.startswith(b, p)))
    revert = F.try_element_at(F.filter("commits", undone), F.lit(1))["sha"]
    return windows.withColumns(
        {
            "n_commits": F.size("commits"),
            "n_files": F.size("fix_files"),
            "docs_only": F.forall("fix_files", doc),
            "overlaps": F.arrays_overlap("fix_files", "log_files"),
            "reverts": revert.isNotNull(),
            "candidate": F.coalesce(revert, F.when(F.size("commits") == 1, F.col("commits")[0]["sha"])),
        }
    )
