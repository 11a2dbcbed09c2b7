"""Queries on cases: suspects, fixes, diffs, answers, files of a commit, histories."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Window
from pyspark.sql import functions as F

from faultline.functions import columns as C
from faultline.functions import patterns as P
from faultline.operators import answers, fixes, history, localize, logs, systems, trees
from faultline.plans import derived as D
from faultline.plans import inline as I
from faultline.plans.registry import query, read


@query("""WITH lg AS (SELECT l_orderkey AS k, l_partkey::VARCHAR AS p, min(l_linenumber) AS pos FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
lo AS (SELECT k, p, row_number() OVER (PARTITION BY k ORDER BY pos, p) - 1 AS pos FROM lg),
ch AS (SELECT l_orderkey AS k, l_partkey::VARCHAR AS p, min(l_linenumber) AS pos, sum(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL),
te AS (SELECT DISTINCT l_orderkey AS k, l_partkey::VARCHAR AS p FROM lineitem WHERE l_discount >= 0.08),
e AS (SELECT k, p, 0 AS src, pos, 2000 - 50 * least(pos, 10) AS pts FROM lo UNION ALL SELECT k, p, 1, pos, 1500 + 10 * least(q, 50)::INT FROM ch UNION ALL SELECT k, p, 2, 0, 500 FROM te),
m AS (SELECT k, p, sum(pts) AS pts, min(src * 100000 + pos) AS seen, string_agg(DISTINCT CASE src WHEN 0 THEN 'log_reference' WHEN 1 THEN 'changed_before_failure' END, ',' ORDER BY CASE src WHEN 0 THEN 'log_reference' WHEN 1 THEN 'changed_before_failure' END DESC) AS two, bool_or(src = 2) AS t FROM e GROUP BY 1, 2)
SELECT k AS l_orderkey, row_number() OVER (PARTITION BY k ORDER BY pts DESC, seen, p)::INT AS rank, p AS path, (pts / 1000)::DOUBLE AS score, two || CASE WHEN t THEN ',failing_test_file' ELSE '' END AS reasons
FROM m WHERE seen < 200000 QUALIFY rank <= 10""")
def suspect_ranking(s, d):
    rows = read(s, d, "lineitem").withColumn("path", F.col("l_partkey").cast("string"))
    log = rows.where("l_returnflag = 'R'").select("l_orderkey", F.col("l_linenumber").alias("pos"), "path")
    changed = rows.where("l_linestatus = 'F'").select("l_orderkey", F.col("l_linenumber").alias("pos"), "path", F.col("l_quantity").alias("lines"))
    return localize.suspects(log, changed, rows.where("l_discount >= 0.08").select("l_orderkey", "path"), "l_orderkey")


_SUBSETS = [",".join(k) for n in range(7) for k in combinations(["ci", "config", "dep", "docker", "source", "test"], n)]
_STATES = {"fix_status": D.pick(0, "flaky_rerun", "matched", "matched", "matched"), "kinds": D.pick(1, *_SUBSETS), "dep": D.pick(2, "y", "n"), "py": D.pick(3, None, *P.PYTHON_KINDS)}
_RULE_VALUES = I.values([(r, c, ",".join(f), "y" if o else "n", "y" if x else "n") for r, (c, f, o, x) in P.FIX_RULES.items()], "rule, category, compatible, overrides, decisive")


@query(f"""WITH t AS (SELECT *, CASE WHEN kinds = '' THEN [] ELSE string_split(kinds, ',') END AS k FROM (SELECT event_id AS id, {D.columns(_STATES)} FROM events)),
u AS (SELECT *, CASE WHEN fix_status = 'flaky_rerun' THEN 'same_code_passed_later' WHEN len(k) = 0 THEN 'fix_touches_only_docs' WHEN kinds = 'dep' OR (kinds = 'config,dep' AND dep = 'y') THEN 'fix_changes_only_dependencies'
  WHEN kinds = 'ci' THEN 'fix_changes_only_ci_workflows' WHEN kinds IN ('docker', 'ci,docker') THEN 'fix_changes_only_docker' WHEN kinds = 'config' THEN 'fix_changes_only_tool_config'
  WHEN kinds IN ('source', 'test', 'source,test') THEN CASE py WHEN 'format' THEN 'fix_is_formatting_only' WHEN 'noqa' THEN 'fix_adds_lint_suppressions_only' WHEN 'types' THEN 'fix_changes_only_type_annotations' WHEN 'coverage' THEN 'fix_adds_coverage_pragmas_only'
    ELSE CASE WHEN kinds = 'test' THEN 'fix_changes_only_tests' ELSE 'fix_changes_source_code' END END ELSE 'fix_mixed_change_kinds' END AS rule FROM t)
SELECT id, fix_status, kinds, dep, py, u.rule, category, compatible, overrides = 'y' AS overrides, decisive = 'y' AS decisive FROM u JOIN {_RULE_VALUES.replace('AS v(', 'AS r(')} ON r.rule = u.rule""")
def fix_signal(s, d):
    rows = D.events_with(s, d, _STATES)
    asked = rows.select("id", "fix_status", F.col("kinds").alias("told"), "dep", F.col("py").alias("py_kind"), F.when(F.col("kinds") == "", F.array().cast("array<string>")).otherwise(F.split("kinds", ",")).alias("kinds"), (F.col("dep") == "y").alias("dep_change"))
    found = fixes.fix_signal(asked)
    return found.select("id", "fix_status", F.col("told").alias("kinds"), "dep", F.col("py_kind").alias("py"), "rule", "category", F.array_join("compatible", ",").alias("compatible"), "overrides", "decisive")


@query("""SELECT source, lang, ['format', 'noqa', 'coverage', 'types', 'semantic'][max(CASE WHEN n_chars < 200 THEN 1 WHEN n_chars < 500 THEN 2 WHEN n_chars < 1000 THEN 3 WHEN n_chars < 3000 THEN 4 ELSE 5 END)] AS kind FROM documents GROUP BY ALL""")
def strongest_kind(s, d):
    n = F.col("n_chars")
    kind = F.when(n < 200, "format").when(n < 500, "noqa").when(n < 1000, "coverage").when(n < 3000, "types").otherwise("semantic")
    return read(s, d, "documents").groupBy("source", "lang").agg(fixes.strongest(kind).alias("kind"))


# sources of every document before and after a change, by what the change is
_BEFORE = "concat('x = f(', n_chars, ')', chr(10))"
_CODE = {
    "old": f"CASE WHEN doc_id % 8 = 7 THEN NULL WHEN doc_id % 8 = 6 THEN concat('x = (', chr(10)) ELSE {_BEFORE} END",
    "new": "CASE doc_id % 8 WHEN 0 THEN concat('x=f( ', n_chars, ' )', chr(10)) WHEN 1 THEN concat('x = f(', n_chars, ')  # noqa', chr(10)) WHEN 2 THEN concat('x = f(', n_chars, ')  # pragma: no cover', chr(10)) WHEN 3 THEN concat('x: int = f(', n_chars, ')', chr(10)) WHEN 4 THEN concat('x = f(', n_chars, ', ', doc_id, ')', chr(10)) ELSE concat('x = f(', n_chars, ')', chr(10)) END",
}


@query("SELECT doc_id AS id, CASE doc_id % 8 WHEN 0 THEN 'format' WHEN 1 THEN 'noqa' WHEN 2 THEN 'coverage' WHEN 3 THEN 'types' WHEN 5 THEN 'format' ELSE 'semantic' END AS kind FROM documents")
def python_change_kind(s, d):
    """Every document's change, whose syntax trees tell what it is; SQL knows it by how the change was made."""
    rows = read(s, d, "documents").selectExpr("doc_id AS id", *[f"{e} AS {n}" for n, e in _CODE.items()])
    return rows.select("id", fixes.python_change_kind("old", "new").alias("kind"))


_COUNTED = "text[1] IN ('+', '-') AND NOT starts_with(text, '+++ ') AND path IS NOT NULL"


@query(f"WITH {D.DIFF_LINES} SELECT id, path, count(*) AS changed FROM c WHERE {_COUNTED} AND NOT starts_with(text, '---') GROUP BY ALL")
def diff_changed_lines(s, d):
    return logs.changed_lines(D.diff_texts(s, d), "id", "text").select("id", "path", "changed")


@query(f"WITH {D.DIFF_LINES} SELECT id, pos, path, substr(text, 2) AS line FROM c WHERE {_COUNTED} AND NOT starts_with(text, '--- ')")
def diff_changed_text(s, d):
    return logs.changed_text(D.diff_texts(s, d), "id", "text")


@query(f"WITH {D.DIFF_LINES} SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos)::INT AS rank, path || ' ' || text AS hunk FROM c WHERE starts_with(text, '@@') AND path IS NOT NULL")
def diff_hunks(s, d):
    return logs.hunks(D.diff_texts(s, d), "id", "text")


@query(f"""WITH {D.DIFF_LINES}, w AS (SELECT doc_id AS id, concat('docs/', coalesce(lang, 'xx'), '.md') AS path FROM documents), a AS (SELECT l.id, min(pos) AS a FROM l JOIN w ON w.id = l.id WHERE starts_with(text, 'diff --git ') AND ends_with(text, ' b/' || w.path) GROUP BY 1),
z AS (SELECT l.id, min(pos) AS z FROM l JOIN a ON a.id = l.id AND pos > a WHERE starts_with(text, 'diff --git ') GROUP BY 1),
t AS (SELECT l.id, string_agg(text, chr(10) ORDER BY pos) AS section FROM l LEFT JOIN z ON z.id = l.id JOIN a ON a.id = l.id WHERE pos > a AND pos < coalesce(z, n) AND pos <= a + 20 AND NOT (pos = n - 1 AND text = '') GROUP BY 1) SELECT w.id, coalesce(section, '') AS section FROM w LEFT JOIN t ON t.id = w.id""")
def diff_section(s, d):
    return logs.diff_section(D.diff_texts(s, d), "id", "text", "path")


_YES = lambda c: F.col(c) == "y"
_ROUTES = {"error_kind": D.pick(0, "", "", "timeout", "output", "other")} | {c: D.pick(k, "y", "n") for k, c in enumerate(["proposal", "unknown", "problems", "repeated", "calls_left", "small", "shrunk"], 1)}


@query(f"""SELECT *, CASE WHEN error_kind <> '' THEN CASE WHEN error_kind = 'timeout' AND calls_left = 'y' AND shrunk = 'n' THEN 'shrink' WHEN error_kind = 'output' AND calls_left = 'y' AND repeated = 'n' THEN 'repair' WHEN error_kind = 'output' AND calls_left = 'y' AND shrunk = 'n' THEN 'shrink' WHEN proposal = 'y' THEN 'finalize' ELSE 'end' END
 WHEN proposal = 'n' THEN 'end' WHEN problems = 'y' THEN CASE WHEN repeated = 'y' OR calls_left = 'n' THEN 'finalize' ELSE 'repair' END WHEN unknown = 'y' AND calls_left = 'y' AND small = 'y' AND shrunk = 'n' THEN 'expand' ELSE 'finalize' END AS next FROM (SELECT event_id AS id, {D.columns(_ROUTES)} FROM events)""")
def route_transition(s, d):
    rows = D.events_with(s, d, _ROUTES)
    found = answers.route(rows.select("id", "error_kind", *[_YES(c).alias(c) for c in list(_ROUTES)[1:]]))
    return found.select("id", "error_kind", *[F.when(F.col(c), "y").otherwise("n").alias(c) for c in list(_ROUTES)[1:]], "next")


# an answer to every document, its text being the evidence; it quotes from there, from elsewhere, or nothing
_KNOWN = "a.py"
_ANSWERS = {
    "failure_type": "CASE doc_id % 4 WHEN 0 THEN 'TYPE_ERROR' WHEN 1 THEN 'NOPE' WHEN 2 THEN NULL ELSE 'UNKNOWN' END", "root_cause": "CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'a cause' ELSE 'the system prompt' END",
    "q": "CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN concat('at ', substr(replace(coalesce(text, ''), '|', ' '), 1, 12)) WHEN 2 THEN concat('see a/b.py|', 'nope ', doc_id) WHEN 3 THEN 'nope' ELSE concat('see a|', lang, ' said') END",
    "f": "CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'a.py' WHEN 2 THEN concat('a', chr(92), 'b.py,zz.py') WHEN 3 THEN concat(lang, '.py') ELSE concat(source, '.py,a.py,', 'x', doc_id, '.py') END",
    "conf": "CASE doc_id % 3 WHEN 0 THEN '1.5' WHEN 1 THEN NULL ELSE '0.4' END", "ev": "concat('at ', replace(coalesce(text, ''), '|', ' '), chr(10), lang, ' said', chr(10), 'see a/b.py here ', source, '.py')",
}
_CATS = "'" + "', '".join(P.PRECEDENCE) + "'"
_A = f"""a AS (SELECT id, failure_type, trim(root_cause) AS cause, CASE WHEN q = '' THEN [] ELSE string_split(q, '|') END AS qs, CASE WHEN f = '' THEN [] ELSE string_split(f, ',') END AS fs, conf, ev FROM (SELECT doc_id AS id, {D.columns(_ANSWERS)} FROM documents)),
b AS (SELECT *, list_filter(qs, lambda x: x <> '' AND NOT contains(ev, x)) AS loose, list_filter(fs, lambda x: NOT (x = '{_KNOWN}' OR contains(ev, replace(x, chr(92), '/')))) AS invented FROM a)"""


def _answers(s, d):
    rows = read(s, d, "documents").selectExpr("doc_id AS id", *[f"{e} AS {n}" for n, e in _ANSWERS.items()])
    many = lambda c, sep: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, sep))
    return rows.select("id", "failure_type", "root_cause", many("q", r"\|").alias("quotes"), many("f", ",").alias("files"), F.array(F.lit(_KNOWN)).alias("known"), F.col("ev").alias("evidence"), F.col("conf").cast("double").alias("confidence"))


@query(f"""WITH {_A} SELECT id, concat_ws('; ', CASE WHEN NOT coalesce(failure_type IN ({_CATS}), false) THEN 'unknown category ' || coalesce('''' || failure_type || '''', 'None') END,
 CASE WHEN cause = '' THEN 'no cause is named' END, CASE WHEN contains(cause, 'system prompt') THEN 'the cause repeats the instructions' END,
 CASE WHEN len(qs) = 0 AND failure_type IS DISTINCT FROM 'UNKNOWN' THEN 'no line of the evidence is quoted' WHEN len(loose) > 0 THEN len(loose) || ' of ' || len(qs) || ' quotes not verbatim, first: ''' || loose[1] || '''' END, CASE WHEN len(invented) > 0 THEN 'files that do not appear in the evidence: ' || array_to_string(invented[:3], ' ') END) AS problems FROM b""")
def validate_answer(s, d):
    return answers.problems(_answers(s, d)).select("id", "problems")


@query(f"""WITH {_A} SELECT id, CASE WHEN failure_type IN ({_CATS}) THEN failure_type ELSE 'UNKNOWN' END AS category, CASE WHEN cause = '' THEN 'no root cause given' ELSE cause END AS root, least(1.0, greatest(0.0, coalesce(conf::DOUBLE, 0.5)))::DOUBLE AS confidence,
 array_to_string(list_transform(list_filter(qs, lambda x: contains(ev, trim(x)) OR contains('a nope diff', trim(x))), lambda x: CASE WHEN contains(ev, trim(x)) THEN 'ci_log|failed step: t|' ELSE 'git_diff|changes since abc|' END || trim(x)), ';') AS kept,
 array_to_string(list_transform(list_filter(fs, lambda x: x = '{_KNOWN}' OR contains(ev, replace(x, chr(92), '/'))), lambda x: replace(x, chr(92), '/')), ',') AS affected FROM b""")
def finalize_answer(s, d):
    source = lambda a, b, c: F.struct(F.lit(a).alias("source"), F.lit(b).alias("location"), c.alias("text"))
    rows = _answers(s, d).withColumn("sources", F.array(source("ci_log", "failed step: t", F.col("evidence")), source("git_diff", "changes since abc", F.lit("a nope diff"))))
    return answers.finalize(rows).select("id", "category", "root", F.col("confidence_kept").alias("confidence"), "kept", "affected")


_ROOM = lambda left, share: f"greatest(0, least({left}, greatest(500, (1200 * {share})::INT)))"
_FOLDED = lambda name, body, room: f"CASE WHEN trim({body}) = '' THEN '' WHEN length({body}) > {room} THEN substr({body}, 1, {room}) || chr(10) || '[... {name} truncated ...]' ELSE {body} END"


@query(f"""WITH b AS (SELECT doc_id, coalesce(source, '') || ' ' || coalesce(lang, '') AS b1, coalesce(text, '') AS b2, reverse(coalesce(text, '')) AS b3, {_ROOM('1200', 0.08)}::INT AS r1 FROM documents),
c AS (SELECT *, {_FOLDED('facts', 'b1', 'r1')} AS k1, (1200 - length(k1))::INT AS l1, {_ROOM('l1', 0.28)}::INT AS r2, {_FOLDED('text', 'b2', 'r2')} AS k2, (l1 - length(k2))::INT AS l2, {_ROOM('l2', 0.5)}::INT AS r3, {_FOLDED('again', 'b3', 'r3')} AS k3 FROM b)
SELECT doc_id, concat_ws(chr(10) || chr(10), CASE WHEN k1 <> '' THEN '## facts' || chr(10) || k1 END, CASE WHEN k2 <> '' THEN '## text' || chr(10) || k2 END, CASE WHEN k3 <> '' THEN '## again' || chr(10) || k3 END) AS packed,
 concat_ws(',', CASE WHEN trim(b1) <> '' AND length(b1) > r1 THEN 'facts' END, CASE WHEN trim(b2) <> '' AND length(b2) > r2 THEN 'text' END, CASE WHEN trim(b3) <> '' AND length(b3) > r3 THEN 'again' END) AS cut FROM c""")
def budget_fold(s, d):
    text = F.coalesce("text", F.lit(""))
    told = [("facts", F.concat_ws(" ", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))), 0.08), ("text", text, 0.28), ("again", F.reverse(text), 0.5)]
    sections = F.array(*[F.struct(F.lit(n).alias("name"), b.alias("body"), F.lit(x).alias("share")) for n, b, x in told])
    return answers.budget_fold(read(s, d, "documents").select("doc_id", sections.alias("sections")), 1200).select("doc_id", "packed", "cut")


_FILES = "f AS (SELECT coalesce(source, '') || '/' || coalesce(lang, '') || '/' || doc_id || '.txt' AS path, coalesce(text, '') AS content, (doc_id % 7)::INT AS start FROM documents)"


def _files(s, d):
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return read(s, d, "documents").select(path.alias("path"), F.coalesce("text", F.lit("")).alias("content"), (F.col("doc_id") % 7).cast("int").alias("start"))


@query(f"WITH {_FILES}, m AS (SELECT path FROM f WHERE starts_with(path, 'src0/')) SELECT (SELECT count(*) FROM m) AS total, row_number() OVER (ORDER BY path)::INT AS rank, path FROM m QUALIFY rank <= 60")
def list_files(s, d):
    return trees.list_files(_files(s, d), "src0")


@query(f"WITH {_FILES}, l AS (SELECT path, unnest(string_split(content, chr(10))) AS text, unnest(range(1, len(string_split(content, chr(10))) + 1))::INT AS number FROM f), m AS (SELECT * FROM l WHERE contains(text, 'license') QUALIFY row_number() OVER (PARTITION BY path ORDER BY number) <= 3) SELECT path, number, text FROM m ORDER BY path, number LIMIT 40")
def search_code(s, d):
    return trees.search_code(_files(s, d), "license")


_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


@query(f"""WITH {_FILES}, p AS (SELECT path, start, CASE WHEN q[-1] = '' THEN q[:-2] ELSE q END AS q FROM (SELECT path, start, string_split_regex(content, '{_ENDS}') AS q FROM f)),
w AS (SELECT path, q, len(q)::INT AS total, greatest(1, least(start, greatest(len(q), 1)))::INT AS a FROM p),
r AS (SELECT path, unnest(range(a, least(len(q), a + 200) + 1)) AS k, unnest(q[a:a + 200]) AS x FROM w),
u AS (SELECT path, k, lpad(k::VARCHAR, 5, ' ') || '  ' || x AS row, sum(length(x) + 8) OVER (PARTITION BY path ORDER BY k) AS used, row_number() OVER (PARTITION BY path ORDER BY k) AS i FROM r),
v AS (SELECT path, count(*)::INT AS n, string_agg(row, chr(10) ORDER BY k) AS body FROM u WHERE i = 1 OR used <= 6000 GROUP BY 1)
SELECT w.path, a AS first, (a + coalesce(n, 0) - 1)::INT AS last, total, coalesce(body, '') AS body,
 w.path || ' lines ' || a || '-' || (a + coalesce(n, 0) - 1) || ' of ' || total || CASE WHEN a + coalesce(n, 0) - 1 < total THEN '; ' || (total - (a + coalesce(n, 0) - 1)) || ' more, go on with "start_line": ' || (a + coalesce(n, 0)) ELSE '' END AS head FROM w LEFT JOIN v ON v.path = w.path""")
def read_file_window(s, d):
    return trees.read_window(_files(s, d), "start")


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) AND b.text <> ''")
def leak_check(s, d):
    quotes = read(s, d, "benchmark").select(F.col("item_id").alias("quote_key"), F.col("text").alias("quote"))
    return trees.holders(read(s, d, "documents").select(F.col("doc_id").alias("key"), "text"), quotes).select(F.col("key").alias("doc_id"), F.col("quote_key").alias("item_id"))


@query("SELECT b.item_id, count(d.doc_id) AS texts, count(d.doc_id) > 0 AS grounded FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) AND b.text <> '' GROUP BY 1")
def grounding_contains(s, d):
    held = leak_check(s, d).groupBy("item_id").agg(F.count("*").alias("texts"))
    return read(s, d, "benchmark").select("item_id").distinct().join(held, "item_id", "left").select("item_id", F.coalesce("texts", F.lit(0)).alias("texts"), F.col("texts").isNotNull().alias("grounded"))


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linestatus = 'F' UNION SELECT l_orderkey, l_partkey FROM lineitem WHERE l_discount >= 0.08")
def known_paths_union(s, d):
    rows = read(s, d, "lineitem")
    part = lambda c: rows.where(c).select("l_orderkey", "l_partkey")
    return part("l_returnflag = 'R'").unionByName(part("l_linestatus = 'F'")).unionByName(part("l_discount >= 0.08")).distinct()


@query("WITH m AS (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linestatus = 'F') SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey)::INT AS rank, l_partkey FROM m QUALIFY rank <= 25")
def missing_paths_except(s, d):
    rows = read(s, d, "lineitem")
    left = rows.where("l_returnflag = 'R'").select("l_orderkey", "l_partkey").subtract(rows.where("l_linestatus = 'F'").select("l_orderkey", "l_partkey"))
    return left.withColumn("rank", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey"))).where("rank <= 25").select("l_orderkey", "rank", "l_partkey")


@query("SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def multiset_except_all(s, d):
    rows = read(s, d, "lineitem")
    return rows.where("l_returnflag = 'R'").select("l_partkey").exceptAll(rows.where("l_returnflag = 'A'").select("l_partkey"))


# A history made of the events: of a user's events each is the parent of the next, and a purchase also has the last event
# before it of the user with the number below as a parent, but for every tenth user.
_EDGES = """own AS (SELECT event_id AS sha, user_id AS u, ts, event_type AS kind, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent FROM events),
g AS (SELECT sha, parent FROM own UNION ALL SELECT a.sha, b.sha FROM own a ASOF JOIN own b ON a.u - 1 = b.u AND a.ts > b.ts WHERE a.kind = 'purchase' AND a.u % 10 <> 0)"""
_UP = "up AS (SELECT DISTINCT sha, sha AS ancestor FROM g UNION SELECT up.sha, g.parent FROM up JOIN g ON g.sha = up.ancestor WHERE g.parent IS NOT NULL)"


def _edges(s, d):
    rows = read(s, d, "events").select("event_id", "user_id", "ts", "event_type")
    asks = (F.col("event_type") == "purchase") & (F.col("user_id") % 10 != 0)
    # an event and a question for the user below lie in one order: each gets the event before it
    placed = rows.select("user_id", "ts", F.col("event_id").alias("sha"), F.lit(0).alias("ord")).unionAll(rows.where(asks).select(F.col("user_id") - 1, "ts", "event_id", F.lit(1)))
    before = Window.partitionBy("user_id").orderBy("ts", F.desc("ord"), "sha").rowsBetween(Window.unboundedPreceding, -1)
    parent = F.last(F.when(F.col("ord") == 0, F.struct("sha")), ignorenulls=True).over(before)["sha"]
    return placed.select("sha", parent.alias("parent"), "ord").where("ord = 0 or sha is not null and parent is not null")


@query(f"WITH RECURSIVE {_EDGES}, {_UP} SELECT sha, ancestor FROM up WHERE sha % 50 = 0")
def commit_ancestors(s, d):
    edges = _edges(s, d)
    return history.ancestors(edges, edges.where("sha % 50 = 0").select("sha"))


_PAIRS = "pairs AS (SELECT lag(sha, 3) OVER (PARTITION BY u ORDER BY ts, sha) AS red, sha AS green FROM own UNION ALL SELECT sha - 5, sha FROM own UNION ALL SELECT sha, sha - 7 FROM own)"


def _pairs(s, d):
    rows = read(s, d, "events")
    own = rows.select(F.lag("event_id", 3).over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("red"), F.col("event_id").alias("green"))
    return own.unionAll(rows.select(F.col("event_id") - 5, "event_id")).unionAll(rows.select("event_id", F.col("event_id") - 7))


@query(f"""WITH RECURSIVE {_EDGES}, {_UP}, p AS (SELECT sha, string_agg(DISTINCT parent::VARCHAR, ',' ORDER BY parent::VARCHAR) AS ps FROM g GROUP BY 1), {_PAIRS}
SELECT red, green, CASE WHEN red = green THEN 'identical' WHEN up.sha IS NOT NULL THEN 'ahead' WHEN r.ps = q.ps THEN 'amend' WHEN r.ps IS NULL OR q.ps IS NULL THEN 'unknown' ELSE 'diverged' END AS relation
FROM pairs LEFT JOIN up ON up.sha = green AND up.ancestor = red LEFT JOIN p r ON r.sha = red LEFT JOIN p q ON q.sha = green""")
def commit_relation(s, d):
    return history.relation(_pairs(s, d), _edges(s, d))


@query(f"""WITH RECURSIVE {_EDGES}, {_UP}, b AS (SELECT sha AS head, lag(sha, 4) OVER (PARTITION BY u ORDER BY ts, sha) AS base, kind FROM own)
SELECT base, head, h.ancestor AS sha FROM b JOIN up h ON h.sha = head WHERE kind = 'error' AND base IS NOT NULL AND NOT EXISTS (SELECT 1 FROM up x WHERE x.sha = base AND x.ancestor = h.ancestor)""")
def commits_between(s, d):
    rows = read(s, d, "events")
    base = F.lag("event_id", 4).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pairs = rows.select(F.col("event_id").alias("head"), base.alias("base"), "event_type").where("event_type = 'error' and base is not null")
    return history.commits_between(pairs, _edges(s, d))


@query("WITH r AS (SELECT * FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY) SELECT count(*) AS seen, count(*) FILTER (NOT coalesce(event_type IN ('error', 'purchase') AND props <> '', false)) AS skipped FROM r")
def run_filter(s, d):
    rows = read(s, d, "events")
    last = rows.agg(F.max("ts").alias("last"))
    recent = rows.join(F.broadcast(last)).where(F.col("ts") >= F.col("last") - F.expr("INTERVAL 7 DAYS"))
    return history.watched_runs(recent, F.col("event_type"), F.col("props"), ["error", "purchase"])[1]


_MD5 = "md5(CAST(event_id AS STRING))"
_IDS = {"name": f"CASE event_id % 12 WHEN 0 THEN concat({_MD5}, substr({_MD5}, 1, 8)) WHEN 1 THEN upper(concat({_MD5}, substr({_MD5}, 1, 8))) WHEN 2 THEN {_MD5} WHEN 3 THEN NULL WHEN 4 THEN concat('owner/', event_type) WHEN 5 THEN concat('a/', event_type, '/c') WHEN 6 THEN '../x' WHEN 7 THEN concat('/', event_type) WHEN 8 THEN 'abc' WHEN 9 THEN concat('own.er/na-me_', event_type) WHEN 10 THEN './.' ELSE concat(event_type, '/') END"}


@query(f"SELECT id, name, coalesce(regexp_matches(name, '^[0-9a-f]{{40}}$'), false) AS sha, coalesce(regexp_matches(name, '^[^/]+/[^/]+$'), false) AS repository FROM (SELECT event_id AS id, {D.columns(_IDS)} FROM events)")
def id_checks(s, d):
    return D.events_with(s, d, _IDS).select("id", "name", C.is_sha(F.col("name")).alias("sha"), C.is_repository(F.col("name")).alias("repository"))


_SUFFIXED = {"path": f"concat(event_type, '.d/', {D.pick(0, *I.PATHS, 'bin/run', 'a.py.bak', 'x.JSON', 'y.yaml')})"}


@query(f"SELECT id, path, list_contains(['py', 'pyi', 'toml', 'cfg', 'ini', 'txt', 'yml', 'yaml', 'json'], CASE WHEN contains(path, '.') THEN string_split(path, '.')[-1] ELSE '' END) AS is_text FROM (SELECT event_id AS id, {D.columns(_SUFFIXED)} FROM events)")
def text_suffix(s, d):
    return D.events_with(s, d, _SUFFIXED).select("id", "path", C.has_text_suffix(F.col("path")).alias("is_text"))


@query("SELECT conv_id, turn, last_value(CASE WHEN turn % 3 = 0 THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS role FROM conversations")
def log_forward_fill(s, d):
    known = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return read(s, d, "conversations").select("conv_id", "turn", F.last(F.when(F.col("turn") % 3 == 0, F.col("role")), ignorenulls=True).over(known).alias("role"))


@query("""WITH c AS (SELECT doc_id, coalesce(lang = 'en', false) AS file, regexp_replace(regexp_replace(text, '</?[A-Za-z][^<>]*>', '[tag removed]', 'g'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', ' ', 'g') AS t FROM documents),
b AS (SELECT doc_id, CASE WHEN length(t) > CASE WHEN file THEN 6000 ELSE 2500 END THEN substring(t, 1, CASE WHEN file THEN 6000 ELSE 2500 END) || chr(10) || '[... result truncated ...]' ELSE t END AS t FROM c)
SELECT doc_id, length(t)::INT AS chars, md5(t) AS digest FROM b""")
def bounded_results(s, d):
    bounded = C.bounded(F.col("text"), F.col("lang") == "en")
    return read(s, d, "documents").select("doc_id", bounded.alias("t")).select("doc_id", F.length("t").alias("chars"), F.md5(F.encode("t", "utf-8")).alias("digest"))


_SECTIONS = "concat('## file ', coalesce(source, 'x'), '.py (at the failed commit)', chr(10), coalesce(text, ''), chr(10), '## file ', coalesce(lang, 'x'), '/a b.py (at the failed commit)', chr(10), '## log', chr(10), ' ## file no.py (at the failed commit)', chr(10), '## file ', coalesce(source, 'x'), '.py (at the failed commit)')"


@query(f"WITH e AS (SELECT doc_id, unnest(regexp_extract_all({_SECTIONS}, '(?m)^## file (.+) \\(at the failed commit\\)$', 1)) AS p FROM documents) SELECT doc_id, string_agg(DISTINCT p, ',' ORDER BY p) AS paths FROM e GROUP BY 1")
def packed_paths(s, d):
    return read(s, d, "documents").select("doc_id", F.array_join(C.packed_paths(F.expr(_SECTIONS)), ",").alias("paths"))


@query("""SELECT doc_id, md5(array_to_string(list_concat([text], string_split(text, chr(10))[:3], [''], [CASE WHEN lang = 'en' THEN source END], [source, lang], CASE WHEN n_chars > 500 THEN [text] ELSE [] END), chr(10))) AS digest FROM documents WHERE text IS NOT NULL""")
def grounding_corpus(s, d):
    rows = read(s, d, "documents").where("text IS NOT NULL")
    none = F.array().cast("array<string>")
    corpus = C.grounding_corpus(F.col("text"), F.slice(F.split("text", "\n"), 1, 3), F.lit(""), F.when(F.col("lang") == "en", F.col("source")), F.array("source", "lang"), F.when(F.col("n_chars") > 500, F.array("text")).otherwise(none))
    return rows.select("doc_id", F.md5(F.encode(corpus, "utf-8")).alias("digest"))


# a source of every document before and after a change of its remarks
_REMARKED = {
    "old": "concat('a = 1  # ', lang, chr(10), '# ', source, chr(10), repeat(concat('# ', lang, chr(10)), CAST(doc_id % 3 AS INT)))",
    "new": "concat('a = 1  # ', lang, chr(10), repeat(concat('# ', source, chr(10)), CAST(doc_id % 4 AS INT)), 'b = ', doc_id, '  # n', doc_id % 5, chr(10))",
}


@query(f"WITH v AS (SELECT doc_id AS id, {D.columns(_REMARKED)} FROM documents) SELECT id, unnest(regexp_extract_all(new, '#[^\n]*')) AS remark FROM v EXCEPT ALL SELECT id, unnest(regexp_extract_all(old, '#[^\n]*')) FROM v")
def added_remarks(s, d):
    rows = read(s, d, "documents").selectExpr("doc_id AS id", *[f"{e} AS {n}" for n, e in _REMARKED.items()])
    return rows.select("id", F.explode(fixes.added_remarks("old", "new")).alias("remark"))


def _by_length():
    """A system for the query below: fails on short texts, else tells by the length."""

    def diagnose(case: dict) -> dict:
        if (case["n_chars"] or 0) < 300:
            raise ValueError("too short")
        return {"failure_type": "TEST_FAILURE" if case["n_chars"] > 1000 else "UNKNOWN", "root_cause": case["lang"], "confidence": 0.5, "affected_files": [case["source"]], "tool_calls": 1}

    return diagnose


@query("""SELECT doc_id::VARCHAR AS case_id, 'by_length' AS system, CASE WHEN n_chars >= 300 THEN CASE WHEN n_chars > 1000 THEN 'TEST_FAILURE' ELSE 'UNKNOWN' END END AS failure_type,
CASE WHEN n_chars >= 300 THEN lang END AS root_cause, CASE WHEN coalesce(n_chars, 0) < 300 THEN 'ValueError: too short' END AS error, CASE WHEN n_chars >= 300 THEN 1 ELSE 0 END AS tool_calls FROM documents""")
def system_predictions(s, d):
    visible = read(s, d, "documents").select(F.col("doc_id").cast("string").alias("case_id"), "lang", "source", "n_chars")
    told = systems.predictions(visible, "by_length", _by_length)
    return told.select("case_id", "system", "diagnosis.failure_type", "diagnosis.root_cause", "error", "tool_calls")
