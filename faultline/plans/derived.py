"""Logs, diffs and cases made of the given tables, by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import patterns as P
from faultline.operators import logs
from faultline.plans.registry import read

ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"

_NL = "chr(10)"
_SRC, _LANG, _TEXT = "coalesce(source, 'none')", "coalesce(lang, 'xx')", "coalesce(text, '')"

# A log of every document: a step that says the text, then what fails in one of ten ways; some lines carry no time.
_FAILS = f"""CASE doc_id % 10
 WHEN 0 THEN concat('FAILED tests/test_', {_SRC}, '.py::test_', {_LANG}, ' - assert ', doc_id, ' == 2', {_NL}, 'E       assert ', doc_id, ' == 2', {_NL})
 WHEN 1 THEN concat('src/', {_SRC}, '.py:3:1: F401 unused import', {_NL}, 'Found 1 error.', {_NL})
 WHEN 2 THEN concat('Traceback (most recent call last):', {_NL}, '  File "/home/runner/work/r/r/src/', {_SRC}, '.py", line 3, in main', {_NL}, 'ValueError: bad value ', doc_id, {_NL})
 WHEN 3 THEN concat(chr(27), '[31mModuleNotFoundError: No module named ', {_LANG}, chr(27), '[0m', {_NL})
 WHEN 4 THEN concat('ERROR: No matching distribution found for ', {_LANG}, {_NL}, 'E   KeyError: ', {_SRC}, {_NL}, 'pkg/', {_LANG}, '.py:7: in f', {_NL})
 WHEN 5 THEN concat('  FAILED tests/test_', {_LANG}, '.py::test_two', {_NL}, 'src/', {_SRC}, '.py:9: AssertionError', {_NL}, 'FAILED tests/test_other.py::test_x', {_NL})
 WHEN 6 THEN concat('check ', {_LANG}, '....................Failed', {_NL})
 WHEN 7 THEN concat('OSError', {_NL}, 'E       assert x in ', {_SRC}, {_NL}, 'app.py:', doc_id, ': note', {_NL})
 WHEN 8 THEN concat('No space left on device', {_NL})
 ELSE '' END"""
LOG = f"""concat('2024-03-01T10:00:00.1234567Z ##[group]Run ', {_SRC}, {_NL}, '2024-03-01T10:00:0', doc_id % 3, 'Z collected ', coalesce(n_chars, 0), ' items', {_NL},
 '2024-03-01T10:00:02Z ', replace({_TEXT}, {_NL}, concat({_NL}, CASE WHEN doc_id % 2 = 0 THEN '2024-03-01T10:00:03.5Z ' ELSE '' END)), {_NL},
 CASE WHEN doc_id % 4 = 1 THEN concat('2024-03-01T10:00:04Z ##[group]Run tests', {_NL}) ELSE '' END, {_FAILS},
 '2024-03-01T10:00:05.5000000Z ##[error]Process completed with exit code 1.', {_NL}, '2024-03-01T10:00:06Z Post job cleanup.', {_NL})"""

# The step that is said to have failed, and when it ran; some steps have no times, or times at which nothing was said.
STEP = f"CASE doc_id % 5 WHEN 0 THEN concat('Run ', {_SRC}) WHEN 1 THEN 'Run tests' WHEN 2 THEN '' WHEN 3 THEN 'Install deps with pip' ELSE concat('Build ', {_LANG}) END"
JOB = f"CASE doc_id % 7 WHEN 0 THEN 'unit tests' WHEN 1 THEN 'lint' WHEN 2 THEN 'docs' WHEN 3 THEN concat('types ', {_LANG}) ELSE {_SRC} END"
_FROM = "CASE doc_id % 6 WHEN 0 THEN '2024-03-01 10:00:00' WHEN 1 THEN '2024-03-01 10:00:02' WHEN 2 THEN '2024-03-01 10:00:04' WHEN 3 THEN '2024-03-01 10:00:03' WHEN 4 THEN '2024-03-02 10:00:00' END"
_TO = "CASE doc_id % 6 WHEN 0 THEN '2024-03-01 10:00:06' WHEN 1 THEN '2024-03-01 10:00:05' WHEN 2 THEN '2024-03-01 10:00:05' WHEN 3 THEN '2024-03-01 10:00:04' WHEN 4 THEN '2024-03-02 10:00:01' END"

# What the SQL of logs begins with: lines with their times, without terminal codes.
BODY = f"""dl AS (SELECT doc_id AS id, string_split_regex({LOG}, '{ENDS}') AS p FROM documents), dp AS (SELECT id, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS p FROM dl),
dr AS (SELECT id, unnest(range(len(p)))::INT AS pos, unnest(p) AS raw FROM dp),
ds AS (SELECT id, pos, CASE WHEN regexp_matches(raw, '{P.LOG_TIME}') THEN strptime(regexp_extract(raw, '{P.LOG_TIME}', 1), '%Y-%m-%dT%H:%M:%S') END AS own,
  regexp_replace(CASE WHEN regexp_matches(raw, '{P.LOG_TIME}') THEN regexp_extract(raw, '{P.LOG_TIME}', 2) ELSE raw END, '{P.TERMINAL}', '', 'g') AS text FROM dr),
body AS (SELECT id, pos, last_value(own IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS ts, text FROM ds)"""
STEPS = f"steps AS (SELECT doc_id AS id, {STEP} AS step_name, {_FROM}::TIMESTAMP AS a, {_TO}::TIMESTAMP AS b FROM documents)"


def log_texts(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").select(F.col("doc_id").alias("id"), F.expr(LOG).alias("text"))


def log_bodies(s: SparkSession, d: str) -> DataFrame:
    """id, pos, ts, text of the lines of all documents' logs."""
    return logs.parse(logs.lines_of(log_texts(s, d), "id", "text"), "id")


def steps(s: SparkSession, d: str) -> DataFrame:
    at = lambda c: F.to_timestamp(F.expr(c)).alias
    return read(s, d, "documents").select(F.col("doc_id").alias("id"), F.expr(STEP).alias("step_name"), at(_FROM)("started_at"), at(_TO)("completed_at"))


# A diff of every document, of three files: the text's lines are added in one, removed from another, which is gone, and
# some of them, with lines that look like heads, in a third.
_ADDED = f"concat('+', replace({_TEXT}, {_NL}, concat({_NL}, '+')))"
_REMOVED = f"concat('-', replace({_TEXT}, {_NL}, concat({_NL}, '-')))"
_FILE = f"concat('src/', {_SRC}, '.py')"
DIFF = f"""concat('diff --git a/', {_FILE}, ' b/', {_FILE}, {_NL}, '--- a/', {_FILE}, {_NL}, '+++ b/', {_FILE}, {_NL}, '@@ -', doc_id, ',2 +', doc_id, ',9 @@ def f():', {_NL}, ' same', {_NL}, {_ADDED}, {_NL},
 'diff --git a/gone.py b/gone.py', {_NL}, '--- a/gone.py', {_NL}, '+++ /dev/null', {_NL}, '@@ -1 +0,0 @@', {_NL}, {_REMOVED}, {_NL},
 CASE WHEN doc_id % 3 > 0 THEN concat('diff --git a/docs/', {_LANG}, '.md b/docs/', {_LANG}, '.md', {_NL}, '--- a/docs/', {_LANG}, '.md', {_NL}, '+++ b/docs/', {_LANG}, '.md', {_NL}, '@@ -1 +1 @@', {_NL}, '---rule', {_NL}, '+', substr({_TEXT}, 1, 40), {_NL}, '@@ -9 +9 @@', {_NL}, '-', doc_id, {_NL}) ELSE '' END)"""
DIFF_LINES = f"""d AS (SELECT doc_id AS id, string_split_regex({DIFF}, '{ENDS}') AS p FROM documents), l AS (SELECT id, len(p) AS n, unnest(range(len(p)))::INT AS pos, unnest(p) AS text FROM d),
c AS (SELECT *, nullif(last_value(CASE WHEN starts_with(text, '+++ b/') THEN substr(text, 7) WHEN starts_with(text, '+++ ') THEN '' END IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING), '') AS path FROM l)"""


def diff_texts(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").select(F.col("doc_id").alias("id"), F.expr(DIFF).alias("text"), F.expr(f"concat('docs/', {_LANG}, '.md')").alias("path"))


# A number that looks random of every event, and its digits in a mixed base.
_H = "(CAST(floor(coalesce(value, 0) * 100) AS BIGINT) * 7919 + event_id * 104729)"


def pick(place: int, *values) -> str:
    """One of the values, by an event's number; place tells the digits of one event apart."""
    said = " ".join(f"WHEN {k} THEN {'NULL' if v is None else repr(v) if isinstance(v, str) else str(v).lower()}" for k, v in enumerate(values))
    return f"(CASE CAST(floor({_H} / {17 ** (place % 5) * (place + 3)}) AS BIGINT) % {len(values)} {said} END)"


def columns(named: dict[str, str]) -> str:
    """A list for SELECT, of expressions by name."""
    return ", ".join(f"{e} AS {n}" for n, e in named.items())


def events_with(s: SparkSession, d: str, named: dict[str, str]) -> DataFrame:
    return read(s, d, "events").selectExpr("event_id AS id", *[f"{e} AS {n}" for n, e in named.items()])
