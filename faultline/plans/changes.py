"""Queries on what changed: diffs of two trees of documents, what a failure is compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import diffs, history, streaks
from faultline.plans.cases import _EDGES, _UP, _edges
from faultline.plans.registry import query, read

# Two trees of each source: every document is a file. The new text lacks some lines of the old one and says others twice.
_OLD = "CASE WHEN doc_id % 11 <> 0 THEN coalesce(text, '') END"
_LINES_SPARK = "transform(split(text, '\n'), (x, k) -> CASE WHEN (k + doc_id) % 5 = 0 THEN '' WHEN (k + doc_id) % 7 = 0 THEN concat(x, '\n', x, '\n') ELSE concat(x, '\n') END)"
_LINES_SQL = "list_transform(string_split(text, chr(10)), lambda x, k: CASE WHEN (k - 1 + doc_id) % 5 = 0 THEN '' WHEN (k - 1 + doc_id) % 7 = 0 THEN x || chr(10) || x || chr(10) ELSE x || chr(10) END)"
_NEW = "CASE WHEN doc_id % 13 <> 0 THEN CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') WHEN doc_id % 17 = 0 THEN coalesce({reversed}, '') ELSE coalesce({lines}, '') END END"
_NEW_SPARK = _NEW.format(lines=f"array_join({_LINES_SPARK}, '')", reversed="array_join(reverse(split(text, '\n')), '\n')")
_NEW_SQL = _NEW.format(lines=f"array_to_string({_LINES_SQL}, '')", reversed="array_to_string(list_reverse(string_split(text, chr(10))), chr(10))")
_PATH = "concat('doc/', doc_id, '.txt')"


def tree_diffs(s, d):
    """source, path, status, old, new, diff, added, removed of the files that differ."""
    files = read(s, d, "documents").select("source", F.expr(_PATH).alias("path"), F.expr(_OLD).alias("old"), F.expr(_NEW_SPARK).alias("new"))
    files = files.where("source is not null")
    old, new = (files.where(F.col(c).isNotNull()).select("source", "path", diffs.blob(c).alias("blob"), F.col(c).alias("text")) for c in ("old", "new"))
    changes = diffs.changed_files(old.drop("text"), new.drop("text"), "source")
    return diffs.diffs(diffs.with_texts(changes, old.select("blob", "text").unionAll(new.select("blob", "text"))))


_TREES = f"trees AS (SELECT source, {_PATH} AS path, {_OLD} AS old, {_NEW_SQL} AS new FROM documents WHERE source IS NOT NULL), apart AS (SELECT * FROM trees WHERE old IS DISTINCT FROM new)"
_CUT = "list_concat(list_transform(string_split({0}, chr(10))[:-2], lambda x: x || chr(10)), CASE WHEN {0} = '' OR ends_with({0}, chr(10)) THEN [] ELSE [string_split({0}, chr(10))[-1]] END)"


@query(f"""WITH RECURSIVE {_TREES}, ab AS (SELECT source, path, {_CUT.format("coalesce(old, '')")} AS a, {_CUT.format("coalesce(new, '')")} AS b FROM apart),
lcs AS (SELECT source, path, 0 AS i, list_transform(b, lambda x: 0) AS best FROM ab
  UNION ALL SELECT l.source, l.path, i + 1, [greatest(best[j], coalesce(list_max([CASE WHEN k > 1 THEN best[k - 1] ELSE 0 END + 1 for k in range(1, j + 1) if b[k] = a[i + 1]]), 0)) for j in range(1, len(b) + 1)]
  FROM lcs l JOIN ab ON ab.source = l.source AND ab.path = l.path WHERE i < len(a)),
kept AS (SELECT l.source, l.path, coalesce(best[-1], 0) AS n, len(a) AS n_old, len(b) AS n_new FROM lcs l JOIN ab ON ab.source = l.source AND ab.path = l.path WHERE i = len(a))
SELECT p.source, p.path, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'deleted' ELSE 'modified' END AS status, n_new - n AS added, n_old - n AS removed, md5(coalesce(new, '')) AS digest FROM apart p JOIN kept k ON k.source = p.source AND k.path = p.path""")
def computed_diffs(s, d):
    """Diffs of all files: how many lines a shortest script edits, and the new text made of the old one and the diff."""
    found = tree_diffs(s, d).withColumn("made", diffs.applied("old", "diff"))
    return found.select("source", "path", "status", "added", "removed", F.md5(F.encode("made", "utf-8")).alias("digest"))


@query(f"WITH {_TREES} SELECT source, count(*) AS files, string_agg(path, ',' ORDER BY path) AS paths FROM apart GROUP BY 1")
def changed_paths(s, d):
    """The paths that differ, as the heads of the files' diffs name them in the diff of the whole source, cut nowhere."""
    whole = diffs.commit_diff(tree_diffs(s, d), "source", 1 << 30)
    names = F.regexp_extract_all("diff", F.lit(r"(?m)^diff --git a/\S+ b/(doc/\d+\.txt)$"), F.lit(1))
    return whole.select("source", F.size(names).cast("bigint").alias("files"), F.array_join(names, ",").alias("paths"))


# Streaks of the events of a user and a workflow; some are pull requests against the branch of the decade's third user.
_WINDOWS = """mk AS (SELECT user_id, event_id % 4 AS flow, ts, event_id, event_type = 'error' AS red, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, event_id % 4 ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('error', 'purchase', 'signup')),
st AS (SELECT r.user_id, r.flow, arg_max(r.event_id, (r.ts, r.event_id)) AS red, any_value(p.event_id) AS prev_green FROM mk r LEFT JOIN mk p ON p.user_id = r.user_id AND p.flow = r.flow AND p.n = r.n AND NOT p.red WHERE r.red GROUP BY r.user_id, r.flow, r.n),
tips AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS main FROM events GROUP BY 1),
win AS (SELECT st.*, red % 4 <> 0 AS pr, main FROM st LEFT JOIN tips ON tips.user_id = st.user_id - st.user_id % 10 + 3)"""
_BASES = f"""{_EDGES}, {_UP}, {_WINDOWS},
asked AS (SELECT DISTINCT red, main FROM win WHERE prev_green IS NULL AND pr AND main IS NOT NULL),
common AS (SELECT red, main, a.ancestor AS c FROM asked JOIN up a ON a.sha = red JOIN up b ON b.sha = main AND b.ancestor = a.ancestor),
met AS (SELECT red, main, min(c) AS met FROM common x WHERE NOT EXISTS (SELECT 1 FROM common y JOIN up ON up.sha = y.c AND up.ancestor = x.c WHERE y.red = x.red AND y.main = x.main AND y.c <> x.c) GROUP BY ALL),
tried AS (SELECT w.user_id, flow, w.red, prev_green, CASE WHEN coalesce(prev_green, met) % 5 <> 0 THEN coalesce(prev_green, met) END AS wished, CASE WHEN o.parent % 5 <> 0 THEN o.parent END AS first_parent
  FROM win w LEFT JOIN met ON w.prev_green IS NULL AND w.pr AND met.red = w.red AND met.main = w.main LEFT JOIN own o ON o.sha = w.red),
based AS (SELECT user_id, flow, red, CASE WHEN coalesce(wished, first_parent) <> red THEN coalesce(wished, first_parent) END AS base, CASE WHEN coalesce(wished, first_parent) <> red THEN CASE WHEN wished IS NULL THEN 'first_parent' WHEN prev_green IS NOT NULL THEN 'last_green' ELSE 'pr_merge_base' END END AS base_kind FROM tried)"""


def _based(s, d, edges, index):
    events = read(s, d, "events").select("event_id", "user_id", "ts", "event_type", (F.col("event_id") % 4).alias("flow"))
    found = streaks.red_streaks(events, ["user_id", "flow"], ["ts", "event_id"], F.expr("event_type = 'error'"), F.expr("event_type IN ('purchase', 'signup')"))
    tips = events.groupBy(F.col("user_id").alias("tip_of")).agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("main"))
    windows = found.select("user_id", "flow", F.col("last_red").alias("red"), "prev_green", (F.col("last_red") % 4 != 0).alias("pull_request"))
    windows = windows.join(tips, F.col("user_id") - F.col("user_id") % 10 + 3 == F.col("tip_of"), "left").drop("tip_of")
    return history.window_base(windows, edges, events.where("event_id % 5 <> 0").select(F.col("event_id").alias("sha")), index)


@query(f"WITH RECURSIVE {_BASES} SELECT user_id, flow, red, base, base_kind FROM based")
def window_base(s, d):
    """What every streak of a user's workflow is compared with; of the commits every fifth isn't available."""
    edges = history.cut(_edges(s, d))
    return _based(s, d, edges, history.reach_index(edges)).select("user_id", "flow", "red", "base", "base_kind")


@query(f"""WITH RECURSIVE {_BASES}, pairs AS (SELECT DISTINCT red, base, EXISTS (SELECT 1 FROM up WHERE sha = red AND ancestor = base) AS ahead FROM based WHERE base IS NOT NULL)
SELECT red, base, up.ancestor AS sha FROM pairs JOIN up ON up.sha = red WHERE ahead AND NOT EXISTS (SELECT 1 FROM up x WHERE x.sha = base AND x.ancestor = up.ancestor) UNION ALL SELECT red, base, red FROM pairs WHERE NOT ahead""")
def window_commits(s, d):
    """The commits of every streak that may have broken it."""
    edges = history.cut(_edges(s, d))
    index = history.reach_index(edges)
    return history.window_commits(history.cut(_based(s, d, edges, index)), edges, index)
