"""Every query by name, with the SQL that it must agree with where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import columns as C
from faultline.functions import patterns as P
from faultline.operators import history, localize, logs, references, rules, scoring, streaks
from faultline.plans import cases, changes, evaluations, flows  # noqa: F401  they register their queries
from faultline.plans import derived as D
from faultline.plans import inline as I
from faultline.plans.registry import QUERIES, SQL, query, read  # noqa: F401

def log_lines(s: SparkSession) -> DataFrame:
    return logs.lines_of(I.table(s, I.LOGS.items(), "id int, text string"), "id", "text")


def log_bodies(s: SparkSession) -> DataFrame:
    return logs.parse(log_lines(s), "id")


def every_telling_line(s: SparkSession, d: str) -> DataFrame:
    """id, pos, text of the inline logs (negative ids), and of the documents that a rule may match at all."""
    inline = log_bodies(s).select((-F.col("id")).cast("long").alias("id"), "pos", "text")
    return inline.unionAll(logs.lines_of(rules.told(read(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), "text"), "id", "text"))


def every_case(s: SparkSession, d: str) -> DataFrame:
    """id, step, job, tests: what the rules fall back on; a document's step is its source, its job its language."""
    inline = I.table(s, [(-k, *v) for k, v in I.CASES.items()], "id bigint, step string, job string, tests boolean")
    return inline.unionAll(read(s, d, "documents").select("doc_id", "source", "lang", F.lit(False)))


# lines of the inline logs in DuckDB: id, pos, text; and of all texts that the rules see, stripped
_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
LINES = f"""raw AS (SELECT id, string_split(regexp_replace(text, '\\r?\\n$', ''), chr(10)) AS parts FROM {I.LOG_VALUES} WHERE text <> ''),
lines AS (SELECT id, unnest(range(len(parts)))::INT AS pos, unnest(parts) AS text FROM raw),
body AS (SELECT id, pos, regexp_replace(CASE WHEN regexp_matches(text, '{P.LOG_TIME}') THEN regexp_extract(text, '{P.LOG_TIME}', 2) ELSE text END, '{P.TERMINAL}', '', 'g') AS text FROM lines)"""
EVERY = f"""{LINES}, docs AS (SELECT doc_id AS id, string_split_regex(text, '{_ENDS}') AS parts FROM documents),
told AS (SELECT -id AS id, pos, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS line FROM body
  UNION ALL SELECT id, unnest(range(len(parts)))::INT, regexp_replace(unnest(parts), '^\\s+|\\s+$', '', 'g') FROM docs),
every AS (SELECT * FROM {I.CASE_VALUES} UNION ALL SELECT doc_id, source, lang, 'n' FROM documents)"""

RED, GREEN = "event_type = 'error'", "event_type IN ('purchase', 'signup')"

STREAKS = """marked AS (
  SELECT user_id, ts, event_id, event_type = 'error' AS red,
         sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g
  FROM events WHERE event_type IN ('error', 'purchase', 'signup')),
reds AS (SELECT user_id, g, count(*) AS n, arg_min(event_id, (ts, event_id)) AS a, arg_max(event_id, (ts, event_id)) AS b FROM marked WHERE red GROUP BY ALL),
greens AS (SELECT user_id, g, event_id FROM marked WHERE NOT red),
streaks AS (SELECT r.user_id, n AS streak_length, a AS first_red, b AS last_red, p.event_id AS prev_green, x.event_id AS next_green
  FROM reds r LEFT JOIN greens p ON p.user_id = r.user_id AND p.g = r.g LEFT JOIN greens x ON x.user_id = r.user_id AND x.g = r.g + 1)"""


@query(f"WITH {STREAKS} SELECT * FROM streaks")
def red_streaks(s, d):
    return streaks.red_streaks(read(s, d, "events"), ["user_id"], ["ts", "event_id"], F.expr(RED), F.expr(GREEN))


@query(f"""WITH {STREAKS}, firsts AS (SELECT user_id, arg_min(event_id, (ts, event_id)) AS f FROM events GROUP BY 1)
SELECT user_id, first_red, coalesce(prev_green, nullif(f, first_red)) AS base,
       CASE WHEN prev_green IS NOT NULL THEN 'last_green' WHEN f <> first_red THEN 'first_run' ELSE 'none' END AS base_kind
FROM streaks JOIN firsts USING (user_id)""")
def breaking_base(s, d):
    events = read(s, d, "events")
    firsts = events.groupBy("user_id").agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("first_run"))
    return streaks.breaking_base(red_streaks(s, d), firsts, ["user_id"])


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS k FROM lineitem WHERE l_returnflag = 'R')
SELECT l_orderkey, min(l_linenumber) FILTER (k = 1) AS first_failed, count(*) AS n_failed,
       coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY k) FILTER (k BETWEEN 2 AND 21), '') AS others FROM f GROUP BY 1""")
def first_failed_job(s, d):
    return streaks.first_failed(read(s, d, "lineitem"), "l_orderkey", F.col("l_returnflag") == "R", ["l_shipdate"], "l_linenumber")


@query("""SELECT o_orderkey, passed FROM orders LEFT JOIN (SELECT l_orderkey, bool_or(l_linestatus = 'F') AS passed FROM lineitem WHERE l_linenumber = 3 GROUP BY 1) ON o_orderkey = l_orderkey""")
def same_job_passed(s, d):
    green = read(s, d, "lineitem").where("l_linenumber = 3").select(F.col("l_orderkey").alias("o_orderkey"), "l_linestatus")
    return streaks.passed_in(read(s, d, "orders").select("o_orderkey"), green, ["o_orderkey"], F.col("l_linestatus") == "F")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, sum((value > 50)::INT)::BIGINT AS over_50 FROM events GROUP BY 1")
def mining_funnel(s, d):
    return read(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("value") > 50).alias("over_50"))


@query("""WITH r AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
SELECT event_id, user_id FROM r WHERE k <= 3 ORDER BY ts, event_id LIMIT 200""")
def capped_sample(s, d):
    return streaks.capped(read(s, d, "events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"], 3, 200).select("event_id", "user_id")


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def visible_projection(s, d):
    return read(s, d, "documents").select("doc_id", "lang", "source", "n_chars")


@query(f"WITH {D.BODY} SELECT id, pos, ts, text FROM body")
def log_parse(s, d):
    return D.log_bodies(s, d)


_STRIPPED = r"sg AS (SELECT id, pos, regexp_replace(text, '^\s+|\s+$', '', 'g') AS line FROM body)"


@query(f"WITH {D.BODY}, {_STRIPPED} SELECT id, string_agg(name, ',' ORDER BY p) AS tests FROM (SELECT id, regexp_extract(line, '{P.FAILING_TEST}', 1) AS name, min(pos) AS p FROM sg WHERE regexp_matches(line, '{P.FAILING_TEST}') GROUP BY ALL) GROUP BY 1")
def failing_tests(s, d):
    return logs.failing_tests(D.log_bodies(s, d), "id")


@query(f"WITH {D.BODY}, {_STRIPPED} SELECT id, row_number() OVER (PARTITION BY id ORDER BY p)::INT AS rank, substr(line, 1, 500) AS line FROM (SELECT id, line, min(pos) AS p FROM sg WHERE regexp_matches(line, '{P.ERROR_LINE}') GROUP BY ALL) QUALIFY rank <= 50")
def error_lines_distinct(s, d):
    return logs.error_lines(D.log_bodies(s, d), "id")


_SIGNATURES = f"""{_STRIPPED},
sf AS (SELECT id, pos, line, CASE WHEN regexp_matches(line, '{P.ASSERTION}') THEN 'AssertionError' WHEN regexp_matches(line, '{P.EXCEPTION}') THEN regexp_extract(line, '{P.EXCEPTION}', 1) END AS exception,
  substr(CASE WHEN regexp_matches(line, '{P.ASSERTION}') THEN regexp_extract(line, '{P.ASSERTION}', 1) ELSE regexp_extract(line, '{P.EXCEPTION}', 2) END, 1, 300) AS message FROM sg),
signatures AS (SELECT id, exception, message FROM sf WHERE exception IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY CASE WHEN starts_with(line, 'E ') OR regexp_matches(line, '{P.ASSERTION}') THEN 0 ELSE 1 END, pos) = 1)"""


@query(f"WITH {D.BODY}, {_SIGNATURES} SELECT id, exception, message FROM signatures")
def error_signature(s, d):
    return logs.error_signature(D.log_bodies(s, d), "id")


@query(f"""WITH {D.BODY}, {D.STEPS}, j AS (SELECT body.*, step_name, coalesce(ts >= a AND ts < b + INTERVAL 1 SECOND, false) AS inside FROM body JOIN steps ON steps.id = body.id),
k AS (SELECT *, min(pos) FILTER (inside) OVER w AS lo, max(pos) FILTER (inside) OVER w AS hi, max(pos) OVER w AS z FROM j WINDOW w AS (PARTITION BY id)),
m AS (SELECT *, max(ts) FILTER (pos = lo) OVER w AS first_ts, min(pos) FILTER (pos BETWEEN lo AND hi AND step_name <> '' AND starts_with(text, '##[group]' || step_name)) OVER w AS mark FROM k WINDOW w AS (PARTITION BY id)),
o AS (SELECT *, min(pos) FILTER (pos BETWEEN lo AND hi AND ts IS DISTINCT FROM first_ts) OVER w AS other, min(pos) FILTER (pos BETWEEN lo AND hi AND starts_with(text, '##[group]Run ') AND ts IS NOT DISTINCT FROM first_ts) OVER w AS run FROM m WINDOW w AS (PARTITION BY id)),
q AS (SELECT id, pos, text, CASE WHEN lo IS NULL THEN 'tail' WHEN mark IS NOT NULL THEN 'group_marker' ELSE 'timestamp' END AS method,
  CASE WHEN lo IS NULL THEN z - 3 ELSE coalesce(mark, CASE WHEN other IS NULL OR run < other THEN run END, lo) END AS low, CASE WHEN lo IS NULL THEN z ELSE hi END AS high FROM o),
e AS (SELECT *, CASE WHEN method = 'tail' THEN high ELSE coalesce(least(min(pos) FILTER (starts_with(text, '##[error]Process completed with exit code')) OVER w, min(pos - 1) FILTER (pos > low AND starts_with(text, 'Post job cleanup.')) OVER w), high) END AS stop
  FROM q WHERE pos BETWEEN low AND high WINDOW w AS (PARTITION BY id))
SELECT id, pos, text, method FROM e WHERE pos <= stop""")
def step_slice(s, d):
    return logs.step_slice(D.log_bodies(s, d), D.steps(s, d), "id", tail_lines=4)


@query(f"WITH names AS (SELECT doc_id AS id, {D.STEP} AS step, {D.JOB} AS job FROM documents) SELECT id, coalesce(" + ", ".join(f"CASE {' '.join(f'''WHEN regexp_matches(lower({c}), '{p}') THEN '{n}' ''' for n, p in P.STAGES)} END" for c in ("step", "job")) + ", 'other') AS stage FROM names")
def infer_stage(s, d):
    names = read(s, d, "documents").select(F.col("doc_id").alias("id"), F.expr(D.STEP).alias("step"), F.expr(D.JOB).alias("job"))
    return names.select("id", C.stage(F.col("step"), F.col("job")).alias("stage"))


_HINT = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(step, '') || ' ' || job, '{p}') THEN '{c}'" for c, p in P.STEP_HINTS) + " END"
_STAGE = "coalesce(" + ", ".join("CASE " + " ".join(f"WHEN regexp_matches(lower({c}), '{p}') THEN '{n}'" for n, p in P.STAGES) + " END" for c in ("step", "job")) + ", 'other')"


@query(f"""WITH {EVERY}, m AS (SELECT id, rule, category, confidence, line FROM told JOIN {I.CLASSIFY_VALUES} ON line <> '' AND regexp_matches(line, pattern) QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, pos) = 1),
h AS (SELECT *, {_HINT} AS hint FROM every)
SELECT h.id, coalesce(rule, CASE WHEN tests = 'y' THEN 'failing_tests' WHEN hint IS NOT NULL THEN 'step_name_hint' ELSE 'no_rule' END) AS rule,
  coalesce(category, CASE WHEN tests = 'y' THEN 'TEST_FAILURE' ELSE coalesce(hint, 'UNKNOWN') END) AS category,
  coalesce(confidence, CASE WHEN tests = 'y' THEN 0.6 WHEN hint IS NOT NULL THEN 0.3 ELSE 0.1 END)::DOUBLE AS confidence, line FROM h LEFT JOIN m ON h.id = m.id""")
def baseline_classify(s, d):
    return rules.classify(every_telling_line(s, d), every_case(s, d))


@query(f"""WITH {EVERY}, m AS (SELECT id, pos, rank, rule, category FROM told JOIN {I.SIGNAL_VALUES} ON regexp_matches(line, pattern) UNION ALL SELECT id, 1 << 30, -1, 'pytest_failed_tests', 'TEST_FAILURE' FROM every WHERE tests = 'y'),
f AS (SELECT id, category, rule FROM m QUALIFY row_number() OVER (PARTITION BY id, category ORDER BY pos, rank) = 1),
b AS (SELECT id, f.category, rule FROM f JOIN (SELECT * FROM {I.PRECEDENCE_VALUES}) p ON p.category = f.category QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1),
k AS (SELECT DISTINCT id, 'LINT_FAILURE' AS category, 'precommit_hook_failed' AS rule FROM told WHERE regexp_matches(line, '{P.FALLBACK_RULE[2]}')),
g AS (SELECT id, {_STAGE} AS stage FROM every), t AS (SELECT * FROM {I.values(P.STAGE_FALLBACK.items(), 'stage, category')})
SELECT g.id, coalesce(b.category, k.category, t.category, 'UNKNOWN') AS category, coalesce(b.rule, k.rule, 'stage_fallback:' || t.stage, 'no_rule_matched') AS rule
FROM g LEFT JOIN b ON b.id = g.id LEFT JOIN k ON k.id = g.id LEFT JOIN t ON t.stage = g.stage""")
def log_signal(s, d):
    return rules.log_signal(every_telling_line(s, d), every_case(s, d))


_WHAT = I.values(P.WHAT_FAILED.items(), "category, words")
_KINDS = f"""CASE WHEN path LIKE '.github/%' THEN 'ci' WHEN regexp_matches(path, '{P.DOC_PATH}') THEN 'doc'
WHEN regexp_matches(path, '{P.DEPENDENCY_FILE}') OR (regexp_matches(path, '{P.MAYBE_DEPENDENCY_FILE}') AND regexp_matches(coalesce(line, ''), '{P.VERSION}')) THEN 'dep'
WHEN regexp_matches(path, '{P.DOCKER_FILE}') THEN 'docker' WHEN regexp_matches(path, '{P.CONFIG_FILE}') THEN 'config' WHEN regexp_matches(path, '{P.TEST_FILE}') THEN 'test' ELSE 'source' END"""
_NAMED = {"path": f"CASE WHEN event_id % 3 = 0 THEN concat('pkg', user_id, '/', {D.pick(0, *I.PATHS)}) ELSE {D.pick(0, *I.PATHS)} END", "line": D.pick(1, None, "numpy>=2", "x = 1")}


@query(f"SELECT id, path, line, {_KINDS} AS kind FROM (SELECT event_id AS id, {D.columns(_NAMED)} FROM events)")
def file_kind(s, d):
    rows = D.events_with(s, d, _NAMED)
    return rows.select("id", "path", "line", C.file_kind(F.col("path"), F.when(F.col("line").isNotNull(), F.array("line"))).alias("kind"))


@query(f"SELECT page_id, regexp_matches(regexp_extract(url, '^[a-z]+://[^/]+/?(.*)$', 1), '{P.DOC_PATH}') AS is_doc FROM pages")
def doc_path_filter(s, d):
    return read(s, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]+/?(.*)$", 1).rlike(P.DOC_PATH).alias("is_doc"))


_PARTS = D.pick(2, "src/app.py", " /etc/passwd", "a/../b", "C:/x/y", "", "a//b", ".git/config", "./x", "a/b/", "docs/x y.md ", "..a/b", "a/.github/b")
_RAW = {"raw": f"CASE event_id % 7 WHEN 0 THEN replace({_PARTS}, '/', chr(92)) WHEN 1 THEN concat(user_id, '/', {_PARTS}) WHEN 2 THEN concat(repeat('x', CAST(285 + event_id % 23 AS INT)), {_PARTS}) ELSE {_PARTS} END"}


@query(f"""WITH p AS (SELECT id, raw, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS t FROM (SELECT event_id AS id, {D.columns(_RAW)} FROM events)),
q AS (SELECT id, raw, t, regexp_replace(replace(t, '\\', '/'), '^/+|/+$', '', 'g') AS path FROM p),
r AS (SELECT id, raw, path, CASE WHEN path = '' THEN 'empty' WHEN length(path) > 300 THEN 'too long' WHEN t LIKE '/%' OR regexp_matches(t, '^[A-Za-z]:') THEN 'not relative'
  WHEN list_has_any(string_split(path, '/'), ['..', '.git']) THEN 'leaves the root' WHEN list_has_any(string_split(path, '/'), ['', '.']) THEN 'empty segment' END AS problem FROM q)
SELECT id, raw, CASE WHEN problem IS NULL THEN path END AS path, problem FROM r""")
def safe_path(s, d):
    path, problem = C.safe_path(F.col("raw"))
    return D.events_with(s, d, _RAW).select("id", "raw", path.alias("path"), problem.alias("problem"))


_LOG_CATS, _FIX_CATS = ["TEST_FAILURE", "TYPE_ERROR", "UNKNOWN", None], ["TYPE_ERROR", "FLAKY", None]
_SIGNALS = {
    "log_category": D.pick(0, *_LOG_CATS), "log_rule": D.pick(1, "x", "stage_fallback:test", "no_rule_matched", None), "fix_category": D.pick(2, *_FIX_CATS), "fix_rule": D.pick(3, "fix_a", "fix_mixed_change_kinds", "fix_b", "fix_c"),
    "comp": D.pick(4, "TEST_FAILURE,UNKNOWN", "LINT_FAILURE"), "o": D.pick(5, "y", "n"), "dc": D.pick(6, "y", "n"),
}


@query(f"""WITH t AS (SELECT id, coalesce(log_category, 'UNKNOWN') AS log, coalesce(log_rule LIKE 'stage_fallback%' OR log_rule = 'no_rule_matched', false) AS weak, fix_category AS fix, fix_rule,
  list_contains(string_split(comp, ','), coalesce(log_category, 'UNKNOWN')) AS fits, o = 'y' AS overrides, dc = 'y' AS decisive FROM (SELECT event_id AS id, {D.columns(_SIGNALS)} FROM events))
SELECT id,
 CASE WHEN fix_rule = 'fix_mixed_change_kinds' THEN log WHEN log = fix THEN log WHEN fits THEN CASE WHEN overrides THEN coalesce(fix, log) ELSE log END WHEN log <> 'UNKNOWN' THEN log ELSE coalesce(fix, 'UNKNOWN') END AS category,
 CASE WHEN fix_rule = 'fix_mixed_change_kinds' THEN 'low' WHEN log = fix THEN CASE WHEN weak THEN 'medium' ELSE 'high' END WHEN fits AND overrides THEN CASE WHEN decisive THEN 'high' ELSE 'medium' END WHEN fits AND NOT weak THEN 'medium' ELSE 'low' END AS confidence,
 CASE WHEN fix_rule = 'fix_mixed_change_kinds' THEN 'needs_review' WHEN log = fix OR (fits AND (overrides OR NOT weak)) THEN 'auto_verified' ELSE 'needs_review' END AS status,
 CASE WHEN fix_rule = 'fix_mixed_change_kinds' THEN 'fix_too_mixed_to_verify' WHEN log = fix THEN 'signals_agree' WHEN fits AND overrides THEN 'fix_refines_log' WHEN fits AND weak THEN 'weak_log_signal' WHEN fits THEN 'fix_consistent_with_log' ELSE 'signals_conflict' END AS rule FROM t""")
def label_combine(s, d):
    rows = D.events_with(s, d, _SIGNALS)
    rows = rows.select("*", F.split("comp", ",").alias("compatible"), (F.col("o") == "y").alias("overrides"), (F.col("dc") == "y").alias("decisive"))
    return rules.combine(rows).select("id", "category", "confidence", "status", "rule")


_FIXES = {
    "g": D.pick(0, "y", "y", "y", "n"), "relation": D.pick(1, "ahead", "ahead", "amend", "identical", "diverged", None), "n": D.pick(2, 0, 1, 1, 2, 3, 5, 8, 9), "files": D.pick(3, 0, 2, 3, 4), "job": D.pick(4, "y", "n", None),
    "docs": D.pick(5, "y", "n", "n"), "ov": D.pick(6, "y", "n"), "reverts": D.pick(7, "y", "n", "n"),
}


@query(f"""WITH t AS (SELECT * FROM (SELECT event_id AS id, {D.columns(_FIXES)} FROM events)),
u AS (SELECT *, least(2, CASE WHEN reverts = 'y' THEN least(1, l) ELSE l END) AS level FROM (SELECT *, CASE WHEN docs = 'y' THEN 2 ELSE (CASE WHEN n = 1 THEN 0 WHEN n <= 3 THEN 1 ELSE 2 END) + (CASE WHEN job = 'y' THEN 0 ELSE 1 END) END AS l FROM t))
SELECT id, CASE WHEN g = 'n' THEN 'no_green_found' WHEN relation = 'identical' THEN 'flaky_rerun' WHEN coalesce(relation, 'None') NOT IN ('ahead', 'amend') OR n = 0 THEN 'ambiguous' WHEN files = 0 THEN 'flaky_rerun' WHEN n > 8 OR level = 2 THEN 'ambiguous' ELSE 'matched' END AS status,
 CASE WHEN g = 'n' OR relation = 'identical' THEN NULL WHEN coalesce(relation, 'None') NOT IN ('ahead', 'amend') OR n = 0 THEN 'low' WHEN files = 0 THEN NULL WHEN n > 8 THEN 'low' ELSE ['high', 'medium', 'low'][level + 1] END AS confidence,
 CASE WHEN g = 'n' THEN 'no_success_run_after_streak' WHEN relation = 'identical' THEN 'green_run_tested_same_commit' WHEN coalesce(relation, 'None') NOT IN ('ahead', 'amend') THEN 'relation_' || coalesce(relation, 'None')
  ELSE 'relation_' || relation || ',window_commits_' || n || CASE WHEN n = 0 THEN ',empty_fix_window' WHEN files = 0 THEN ',fix_window_changes_no_files' WHEN n > 8 THEN ',fix_window_too_large'
  ELSE CASE WHEN job IS NULL THEN ',failed_job_absent_in_green_run' WHEN job = 'n' THEN ',failed_job_not_successful_in_green_run' ELSE '' END || CASE WHEN docs = 'y' THEN ',fix_touches_only_docs' ELSE '' END || CASE WHEN ov = 'y' THEN ',fix_overlaps_log_referenced_files' ELSE '' END || CASE WHEN reverts = 'y' THEN ',revert_of_breaking_commit' ELSE '' END END END AS reasons FROM u""")
def score_fix(s, d):
    flag = lambda c: F.col(c) == "y"
    rows = D.events_with(s, d, _FIXES).select("id", flag("g").alias("has_green"), "relation", F.col("n").alias("n_commits"), F.col("files").alias("n_files"), flag("job").alias("job_passed"), flag("docs").alias("docs_only"), flag("ov").alias("overlaps"), flag("reverts").alias("reverts"))
    return rules.score_fix(rows.withColumn("max_commits", F.lit(8))).select("id", "status", "confidence", "reasons")


@query(f"""WITH e AS (SELECT user_id, upper(event_type) AS c FROM events), r AS (SELECT * FROM {I.values([(0, 'ERROR'), (1, 'PURCHASE')], 'ord, category')})
SELECT user_id, CASE min(ord) WHEN 0 THEN 'TIMEOUT' WHEN 1 THEN 'FLAKY' ELSE 'UNKNOWN' END AS category FROM e LEFT JOIN r ON c = r.category GROUP BY 1""")
def precedence_pick(s, d):
    kind = F.when(F.col("event_type") == "error", "TIMEOUT").when(F.col("event_type") == "purchase", "FLAKY")
    return read(s, d, "events").groupBy("user_id").agg(C.precedence(F.collect_set(kind)).alias("category"))


_HIT = "quality = 1"
_JOINED = "documents JOIN labels USING (doc_id)"
_WILSON = "round(CASE WHEN n > 0 THEN greatest(0.0, ((hits / n) + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt((hits / n) * (1 - hits / n) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)) END, 6) AS low, round(CASE WHEN n > 0 THEN least(1.0, ((hits / n) + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt((hits / n) * (1 - hits / n) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)) END, 6) AS high"


def labelled(s, d):
    return read(s, d, "documents").select("doc_id", "lang", "source", "n_chars").join(read(s, d, "labels"), "doc_id")


@query(f"SELECT lang, n, hits, round(hits / n, 6) AS rate, {_WILSON} FROM (SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS hits FROM {_JOINED} GROUP BY 1)")
def wilson_interval(s, d):
    return scoring.rates(labelled(s, d), ["lang"], F.expr(_HIT))


@query(f"SELECT lang, n, hits, {_WILSON} FROM (SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, count(*) AS n, count(*) FILTER (quality = 1) AS hits FROM {_JOINED} GROUP BY ROLLUP (lang))")
def accuracy_rollup(s, d):
    return scoring.rate_rollup(labelled(s, d), "lang", F.expr(_HIT))


@query(f"SELECT quality AS gold, (n_chars > 1000)::INT AS predicted, count(*) AS n FROM {_JOINED} GROUP BY ALL")
def confusion_matrix(s, d):
    return labelled(s, d).groupBy(F.col("quality").alias("gold"), (F.col("n_chars") > 1000).cast("int").alias("predicted")).agg(F.count("*").alias("n"))


@query("SELECT 'lang' AS what, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2")
def stats_value_counts(s, d):
    return scoring.value_counts(read(s, d, "documents").select("lang", "source"), ["lang", "source"])


@query(f"SELECT b.lang, toxic, coalesce(n, 0) AS n FROM (VALUES ('de'), ('en'), ('es'), ('fr'), ('it')) AS b(lang) LEFT JOIN (SELECT lang, toxic, count(*) AS n FROM {_JOINED} GROUP BY ALL) c ON b.lang = c.lang")
def category_by_status(s, d):
    return scoring.counts_in_all(labelled(s, d), "lang", ["de", "en", "es", "fr", "it"], "toxic")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def operational_totals(s, d):
    return scoring.totals(read(s, d, "events"), "value", ["event_type"])


@query("SELECT count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, quantile_disc(value, 0.95) AS p95 FROM events")
def latency_p95(s, d):
    return scoring.totals(read(s, d, "events"), "value", [])


@query("SELECT doc_id FROM labels ORDER BY md5('7:' || doc_id), doc_id LIMIT 25")
def audit_queue(s, d):
    return scoring.hash_sample(read(s, d, "labels").select("doc_id"), "doc_id", 25, "7")


@query("SELECT round(avg(CASE WHEN quality = toxic THEN 0.0 ELSE 1.0 END), 6) AS precision, count(*) AS audited FROM labels")
def audit_precision(s, d):
    return read(s, d, "labels").agg(F.round(F.avg((F.col("quality") != F.col("toxic")).cast("double")), 6).alias("precision"), F.count("*").alias("audited"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(s, d):
    return read(s, d, "documents").select("doc_id", "lang").join(read(s, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, 'kept' AS system FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT doc_id, 'fresh' FROM labels WHERE toxic = 1")
def upsert_predictions(s, d):
    kept = read(s, d, "documents").select("doc_id", F.lit("kept").alias("system"))
    return scoring.upsert(kept, read(s, d, "labels").where("toxic = 1").select("doc_id", F.lit("fresh").alias("system")), "doc_id")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'no label' WHEN toxic = 1 THEN 'toxic' WHEN n_chars < 200 THEN 'too short' ELSE 'eligible' END AS why FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def localization_eligibility(s, d):
    labels = read(s, d, "labels").withColumn("known", F.lit(True))
    why = F.when(F.col("known").isNull(), "no label").when(F.col("toxic") == 1, "toxic").when(F.col("n_chars") < 200, "too short").otherwise("eligible")
    return read(s, d, "documents").select("doc_id", "n_chars").join(labels, "doc_id", "left").select("doc_id", why.alias("why"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_props_extract(s, d):
    return read(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT page_id, regexp_replace(regexp_replace(html, '</?[A-Za-z][^<>]*>', '[tag removed]', 'g'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', ' ', 'g') AS text FROM pages")
def sanitize_text(s, d):
    return read(s, d, "pages").select("page_id", C.sanitized(F.col("html")).alias("text"))


@query(f"""WITH l AS (SELECT doc_id, string_split_regex(text, '{_ENDS}') AS p FROM documents), q AS (SELECT doc_id, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS p FROM l),
r AS (SELECT doc_id, len(p) AS n, length(array_to_string(p, chr(10))) AS size, array_to_string(p, chr(10)) AS whole, array_to_string(p[:2], chr(10)) AS head, unnest(p) AS x, unnest(range(1, len(p) + 1)) AS k FROM q),
u AS (SELECT *, sum(CASE WHEN k > 2 THEN length(x) + 1 END) OVER (PARTITION BY doc_id ORDER BY k DESC) AS used FROM r),
t AS (SELECT doc_id, count(*) FILTER (k > 2 AND used <= 500 - length(head) - 64) AS kept, string_agg(x, chr(10) ORDER BY k) FILTER (k > 2 AND used <= 500 - length(head) - 64) AS last, any_value(n) AS n, any_value(size) AS size, any_value(whole) AS whole, any_value(head) AS head FROM u GROUP BY 1)
SELECT q.doc_id, coalesce(size, 0) > 500 AS truncated, CASE WHEN size > 500 THEN head || chr(10) || '... [' || (n - 2 - kept) || ' lines omitted] ...' || chr(10) || coalesce(last, '') ELSE coalesce(whole, '') END AS excerpt FROM q LEFT JOIN t ON t.doc_id = q.doc_id""")
def excerpt_head_tail(s, d):
    return logs.excerpt(read(s, d, "documents"), "doc_id", "text", 500, 2)


# RE2 doesn't look behind: the character before a path is matched in its place
_PATH_LINE = P.PATH_LINE.replace("(?<![\\w/.\\\\-])", "(?:^|[^\\w/.\\\\-])")
_REFERENCES = f"""rf AS (SELECT id, pos, list_concat(regexp_extract_all(text, '{P.TRACEBACK_FILE}', 1), regexp_extract_all(text, '{_PATH_LINE}', 1)) AS ps FROM body WHERE contains(text, '.py')),
ru AS (SELECT id, pos, unnest(range(len(ps))) AS k, unnest(ps) AS path FROM rf), refs AS (SELECT id, (row_number() OVER (PARTITION BY id ORDER BY min((pos, k))) - 1)::INT AS rank, path FROM ru GROUP BY id, path)"""


@query(f"WITH {D.BODY}, {_REFERENCES} SELECT id, rank, path FROM refs")
def file_references(s, d):
    return references.file_references(D.log_bodies(s, d), "id")


_DIRS = "'" + "', '".join(P.NON_REPO_DIRS) + "'"


# files of a tree, and how logs spell them
_TREE = "concat('src/', coalesce(source, 'none'), '/', coalesce(lang, 'xx'), '/m', doc_id % 40, '.py')"
_SPELT = f"""CASE doc_id % 11 WHEN 0 THEN {_TREE} WHEN 1 THEN concat('./', {_TREE}) WHEN 2 THEN concat('/home/runner/work/r/r/', {_TREE}) WHEN 3 THEN concat(coalesce(lang, 'xx'), '/m', doc_id % 40, '.py')
 WHEN 4 THEN replace(concat(coalesce(source, 'none'), '/', coalesce(lang, 'xx'), '/m', doc_id % 40, '.py'), '/', chr(92)) WHEN 5 THEN concat('/x/site-packages/', coalesce(source, 'none'), '/', coalesce(lang, 'xx'), '/m', doc_id % 40, '.py')
 WHEN 6 THEN concat('/usr/lib/', {_TREE}) WHEN 7 THEN concat('.venv/', {_TREE}) WHEN 8 THEN concat('m', doc_id % 40, '.py') WHEN 9 THEN concat('x/dist-packages/', {_TREE}) ELSE concat('D:/a/r/r/', {_TREE}) END"""


@query(f"""WITH f AS (SELECT DISTINCT {_TREE} AS file FROM documents),
c AS (SELECT id, regexp_replace(regexp_replace(replace(raw, '\\', '/'), '{P.WORKSPACE}', ''), '^\\./', '') AS path FROM (SELECT doc_id AS id, {_SPELT} AS raw FROM documents)),
t AS (SELECT id, path, CASE WHEN contains(path, 'site-packages/') THEN regexp_extract(path, '^.*?site-packages/(.*)$', 1) WHEN contains(path, 'dist-packages/') THEN regexp_extract(path, '^.*?dist-packages/(.*)$', 1)
  WHEN NOT starts_with(path, '/') AND NOT list_has_any(string_split(path, '/'), [{_DIRS}]) THEN path END AS tail FROM c),
r AS (SELECT id, coalesce((SELECT file FROM f WHERE file = path), (SELECT file FROM f WHERE file = tail), CASE WHEN contains(tail, '/') AND (SELECT count(*) FROM f WHERE ends_with(file, '/' || tail)) = 1 THEN (SELECT min(file) FROM f WHERE ends_with(file, '/' || tail)) END) AS path FROM t)
SELECT id, path FROM r WHERE path IS NOT NULL""")
def path_suffix_resolve(s, d):
    docs = read(s, d, "documents")
    return references.resolve_paths(docs.select(F.col("doc_id").alias("id"), F.expr(_SPELT).alias("raw")), docs.select(F.expr(_TREE).alias("path")).distinct(), "id")


# a user's events are commits, by md5; some say that they revert the one before, or the one before that, by a prefix
_BEFORE = "md5(CAST(lag(event_id, {0}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS STRING))"
_COMMITS = {
    "id": "user_id", "event_id": "event_id", "event_type": "event_type", "sha": "md5(CAST(event_id AS STRING))", "pos": "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)",
    "last": f"coalesce({_BEFORE.format(1)}, '')", "older": f"coalesce({_BEFORE.format(2)}, '')",
}
_MESSAGE = """CASE event_id % 6 WHEN 0 THEN concat('Revert', chr(10), chr(10), 'This reverts commit ', substr(last, 1, CAST(5 + event_id % 28 AS INT)), '.') WHEN 1 THEN concat('This reverts commit ', older, ' and This reverts commit ', last) WHEN 2 THEN concat('see ', last) ELSE 'tidy' END"""


@query(f"""WITH c AS (SELECT {D.columns(_COMMITS)} FROM events), w AS (SELECT id, pos, sha, unnest(regexp_extract_all({_MESSAGE}, '{P.REVERT}', 1)) AS prefix FROM c), b AS (SELECT id, sha AS broken FROM c WHERE event_type = 'error')
SELECT w.id, arg_min(sha, pos) AS sha FROM w JOIN b ON w.id = b.id AND starts_with(broken, prefix) GROUP BY 1""")
def revert_match(s, d):
    commits = read(s, d, "events").selectExpr(*[f"{e} AS {n}" for n, e in _COMMITS.items()])
    return references.reverts(commits.select("id", "pos", "sha", F.expr(_MESSAGE).alias("message")), commits.where("event_type = 'error'").select("id", F.col("sha").alias("broken")), "id")


_QUOTED = "CASE doc_id % 4 WHEN 0 THEN 'said nowhere at all' WHEN 1 THEN substr(text, 1, 25) WHEN 2 THEN substr(text, 40, 60) ELSE concat('Run ', coalesce(source, 'none')) END"


@query(f"""WITH q AS (SELECT doc_id AS id, {_QUOTED} AS quote, {D.LOG} AS log FROM documents UNION ALL SELECT doc_id, 'exit code 1.', {D.LOG} FROM documents), h AS (SELECT id, contains(log, quote) AS held FROM q)
SELECT count(*) AS items, count(*) FILTER (held) AS grounded, round(count(*) FILTER (held) / count(*), 6) AS rate, count(DISTINCT id) FILTER (NOT held) AS ungrounded_cases FROM h""")
def grounding_summary(s, d):
    docs = read(s, d, "documents")
    quotes = docs.select(F.col("doc_id").alias("id"), F.expr(_QUOTED).alias("quote")).unionAll(docs.select("doc_id", F.lit("exit code 1.")))
    return references.grounding(quotes, D.log_texts(s, d), "id")


# a case of every document: its log, its diff, its step; what the rules search, and what they make of it
_CASE = {"step": D.STEP, "job": D.JOB, "tests": "CASE WHEN doc_id % 9 = 0 THEN 'y' ELSE 'n' END"}
_FOUND = f"""{D.BODY}, {_SIGNATURES}, {_REFERENCES}, {D.DIFF_LINES},
cs AS (SELECT doc_id AS id, {D.columns(_CASE)} FROM documents),
er AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY p) - 100 AS pos, substr(line, 1, 500) AS line FROM (SELECT id, line, min(pos) AS p FROM sg WHERE regexp_matches(line, '{P.ERROR_LINE}') GROUP BY ALL) QUALIFY pos <= -50),
se AS (SELECT id, pos, line FROM er UNION ALL SELECT id, pos, line FROM sg),
mt AS (SELECT id, rule, category, confidence, line FROM se JOIN {I.CLASSIFY_VALUES} ON line <> '' AND regexp_matches(line, pattern) QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, pos) = 1),
hn AS (SELECT *, {_HINT} AS hint FROM cs),
cl AS (SELECT hn.id, step, job, coalesce(rule, CASE WHEN tests = 'y' THEN 'failing_tests' WHEN hint IS NOT NULL THEN 'step_name_hint' ELSE 'no_rule' END) AS rule,
  coalesce(category, CASE WHEN tests = 'y' THEN 'TEST_FAILURE' ELSE coalesce(hint, 'UNKNOWN') END) AS category,
  coalesce(confidence, CASE WHEN tests = 'y' THEN 0.6 WHEN hint IS NOT NULL THEN 0.3 ELSE 0.1 END)::DOUBLE AS confidence, line FROM hn LEFT JOIN mt ON hn.id = mt.id),
lo AS (SELECT id, path, row_number() OVER (PARTITION BY id ORDER BY rank, path) - 1 AS pos FROM refs WHERE NOT regexp_matches(path, '{P.DOC_PATH}')),
ch AS (SELECT id, path, min(pos) AS pos, count(*) AS n FROM c WHERE text[1] IN ('+', '-') AND NOT starts_with(text, '+++ ') AND NOT starts_with(text, '---') AND path IS NOT NULL AND NOT regexp_matches(path, '{P.DOC_PATH}') GROUP BY ALL),
te AS (SELECT DISTINCT id, string_split(regexp_extract(line, '{P.FAILING_TEST}', 1), '::')[1] AS path FROM sg WHERE regexp_matches(line, '{P.FAILING_TEST}')),
ev AS (SELECT id, path, 0 AS src, pos, {P.LOG_POINTS} - {P.LOG_DECAY} * least(pos, 10) AS pts FROM lo UNION ALL SELECT id, path, 1, pos, {P.CHANGE_POINTS} + {P.SIZE_POINTS} * least(n, 50) FROM ch UNION ALL SELECT id, path, 2, 0, {P.TEST_POINTS} FROM te),
mg AS (SELECT id, path, sum(pts) AS pts, min((src, pos)) AS seen, string_agg(['{P.SUSPECT_REASONS[0]}', '{P.SUSPECT_REASONS[1]}', '{P.SUSPECT_REASONS[2]}'][src + 1], ',' ORDER BY src) AS reasons, min(src) AS strong FROM ev GROUP BY 1, 2),
tp AS (SELECT id, path, reasons FROM mg WHERE strong < 2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY pts DESC, seen, path) = 1)"""


def _searched(s, d):
    """Lines of all logs in the order of the search, the lines themselves, and the cases."""
    # many steps read the lines, which are cut and timed once
    lines = history.cut(D.log_bodies(s, d).select("id", "pos", "text"))
    cases = read(s, d, "documents").select(F.col("doc_id").alias("id"), F.expr(_CASE["step"]).alias("step"), F.expr(_CASE["job"]).alias("job"), (F.expr(_CASE["tests"]) == "y").alias("tests"))
    return rules.searched(logs.error_lines(lines, "id"), lines), lines, cases


def _changed(s, d):
    return logs.changed_lines(D.diff_texts(s, d), "id", "text")


def _top_suspects(lines, edits):
    named = references.file_references(lines, "id").select("id", F.col("rank").alias("pos"), "path")
    changed = edits.select("id", "pos", "path", F.col("changed").alias("lines"))
    tests = logs.failing_tests(lines, "id").select("id", F.explode(F.split("tests", ",")).alias("path"))
    return localize.suspects(named, changed, tests, "id", top=1).select("id", "path", "reasons")


_WHAT = I.values(P.WHAT_FAILED.items(), "category, words").replace("AS v(", "AS w(")


@query(f"""WITH {_FOUND} SELECT cl.id, cl.category AS failure_type, round(CASE WHEN t.path IS NULL THEN confidence * 0.8 ELSE confidence END, 3) AS confidence,
 concat_ws(' ', words, CASE WHEN exception IS NOT NULL THEN '(' || exception || ': ' || substr(message, 1, 200) || ')' ELSE '(' || substr(line, 1, 200) || ')' END, CASE WHEN cl.category <> 'POLICY_CHECK_FAILURE' THEN 'Most suspicious file: ' || t.path || ' [' || replace(reasons, ',', ', ') || '].' END,
  CASE WHEN cl.category <> 'POLICY_CHECK_FAILURE' AND contains(reasons, '{P.SUSPECT_REASONS[1]}') THEN 'It changed shortly before, in ' || chr(39) || 'commit of ' || t.path || chr(39) || '.' END) AS root_cause
FROM cl JOIN {_WHAT} ON w.category = cl.category LEFT JOIN tp t ON t.id = cl.id LEFT JOIN signatures g ON g.id = cl.id""")
def baseline_diagnosis(s, d):
    """Every document's case: what failed, the root error, the top suspect of its log, its diff and its tests."""
    order, lines, cases = _searched(s, d)
    edits = history.cut(_changed(s, d))
    changes = edits.select("id", "path", F.concat(F.lit("commit of "), "path").alias("subject"))
    told = rules.diagnose(rules.classify(order, cases), _top_suspects(lines, edits), "id", logs.error_signature(lines, "id"), changes)
    return told.select("id", "failure_type", "confidence", "root_cause")


@query(f"""WITH {_FOUND}, sh AS (SELECT l.id, min(pos) AS a FROM l JOIN tp ON tp.id = l.id WHERE starts_with(text, 'diff --git ') AND ends_with(text, ' b/' || tp.path) GROUP BY 1),
sz AS (SELECT l.id, min(pos) AS z FROM l JOIN sh ON sh.id = l.id AND pos > a WHERE starts_with(text, 'diff --git ') GROUP BY 1),
sn AS (SELECT l.id, string_agg(text, chr(10) ORDER BY pos) AS section FROM l JOIN sh ON sh.id = l.id LEFT JOIN sz ON sz.id = l.id WHERE pos > a AND pos < coalesce(z, n) AND pos <= a + 20 AND NOT (pos = n - 1 AND text = '') GROUP BY 1),
fl AS (SELECT sg.id, arg_min(sg.line, sg.pos) AS failed FROM sg JOIN cl ON cl.id = sg.id WHERE starts_with(sg.line, 'FAILED ') AND sg.line IS DISTINCT FROM cl.line GROUP BY 1),
nm AS (SELECT sg.id, arg_min(sg.line, sg.pos) AS naming FROM sg JOIN tp ON tp.id = sg.id WHERE contains(sg.line, tp.path) GROUP BY 1),
sp AS (SELECT id, 'failed step: ' || coalesce(nullif(step, ''), job) AS step FROM cl)
SELECT cl.id, concat_ws(chr(10), 'ci_log|' || sp.step || '|' || substr(nullif(line, ''), 1, 1000) || '|rule ' || rule || ' takes it for ' || category, 'ci_log|' || sp.step || '|' || substr(failed, 1, 1000) || '|the first test that is said to fail',
 'git_diff|' || path || '|' || substr(nullif(section, ''), 1, 1000) || '|changed since the last green state', 'ci_log|' || sp.step || '|' || substr(naming, 1, 1000) || '|the log names ' || path) AS items
FROM cl JOIN sp ON sp.id = cl.id LEFT JOIN tp ON tp.id = cl.id LEFT JOIN sn ON sn.id = cl.id LEFT JOIN fl ON fl.id = cl.id LEFT JOIN nm ON nm.id = cl.id""")
def baseline_evidence(s, d):
    """The pieces of evidence of every document's case."""
    order, lines, cases = _searched(s, d)
    # the suspects are asked for twice
    top = history.cut(_top_suspects(lines, _changed(s, d)))
    asked = D.diff_texts(s, d).drop("path").join(top.select("id", "path"), "id")
    found = rules.evidence_items(rules.classify(order, cases), lines, top, logs.diff_section(asked, "id", "text", "path"), cases)
    return found.select("id", F.array_join(F.transform("items", lambda x: F.concat_ws("|", x["source"], x["location"], x["excerpt"], x["explanation"])), "\n").alias("items"))
