"""Small inline tables of our own making for operators that the driver's tables have no input for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultline.functions import patterns as P

LOGS = {
    1: "2024-03-01T10:00:00.1234567Z ##[group]Run pytest\n2024-03-01T10:00:01.0000000Z collected 3 items\n2024-03-01T10:00:02.0000000Z FAILED tests/test_a.py::test_one - assert 1 == 2\nE       assert 1 == 2\n2024-03-01T10:00:03.5000000Z ##[error]Process completed with exit code 1.\n2024-03-01T10:00:03.6000000Z Post job cleanup.\n",
    2: "2024-03-01T11:00:00Z ##[group]Run ruff check\n2024-03-01T11:00:01Z src/app.py:3:1: F401 unused import\n2024-03-01T11:00:01Z Found 1 error.\n2024-03-01T11:00:02Z ##[error]Process completed with exit code 1.",
    3: "plain line\nTraceback (most recent call last):\n  File \"src/app.py\", line 3, in main\nValueError: bad value\nModuleNotFoundError: No module named 'x'\n\x1b[31mred\x1b[0m text",
    4: "2024-03-01T12:00:00Z Run poetry install\n2024-03-01T12:00:05Z ERROR: No matching distribution found for zzz\n2024-03-01T12:00:06Z ERROR tests/test_b.py\nE   KeyError: 'k'",
    5: "",
    6: "check yaml....................Failed\n  FAILED tests/test_c.py::test_two\n   indented error: here  \n   indented error: here",
    7: "nothing to see",
    8: "fix end of line.....Failed",
}
#: Of each log: the step's name, the job's, and whether tests are known to have failed.
CASES = {1: ("Run pytest", "tests", True), 2: ("Run", "lint", False), 3: (None, "x", False), 4: ("Run poetry install", "y", False), 5: ("Build docs", "z", False), 6: (None, "hooks", False), 7: ("hello", "world", True), 8: ("hooks", "q", False), 9: ("Run mypy", "types", False), 10: ("hello", "world", False)}
PATHS = ["docs/a.md", ".github/workflows/ci.yml", "requirements/dev.txt", "requirements.txt", "pyproject.toml", "Dockerfile", "tox.ini", "tests/test_x.py", "src/app.py", "CHANGES/1.rst", "src/HISTORY.txt", "conftest.py", "doc/x.txt", "a/uv.lock"]
#: Sources before and after a change, and what it is.
PYTHON_CHANGES = [("x=1\n", "x = 1\n"), ("x = 1\n", "x = 1  # noqa\n"), ("x = f()\n", "x = f()  # type: ignore\n"), ("x = 1\n", "x = 1  # pragma: no cover\n"), ("def f(a): return a\n", "from typing import Any\ndef f(a: Any) -> Any: return a\n"), ("x = 1\n", "x: int = 1\n"), ("x = 1\n", "x = 2\n"), (None, "x = 1\n"), ("x = (\n", "x = 1\n")]


def literal(value) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def values(rows, names: str) -> str:
    """A VALUES table in SQL that DuckDB reads."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") AS v({names})"


def table(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def rules_sql(rules, columns: str) -> str:
    return values([(k, *r) for k, r in enumerate(rules)], f"rank, {columns}")


CASE_VALUES = values([(-k, *v[:2], "y" if v[2] else "n") for k, v in CASES.items()], "id, step, job, tests")
LOG_VALUES = values(LOGS.items(), "id, text")
CLASSIFY_VALUES = rules_sql(P.CLASSIFY_RULES, "rule, category, confidence, pattern")
SIGNAL_VALUES = rules_sql(P.LOG_RULES, "rule, category, pattern")
PRECEDENCE_VALUES = values(enumerate(P.PRECEDENCE), "ord, category")
