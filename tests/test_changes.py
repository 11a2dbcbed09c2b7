"""Diffs against brute force, merge bases on random graphs."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from faultline.operators import diffs, history
from faultline.plans import cases


def longest_common(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, best[j] = best[j], last + 1 if x == y else max(best[j], best[j - 1])
    return best[-1]


@pytest.mark.parametrize("pairs_a_line", [0, 8])
def test_scripts_are_shortest_and_hunks_give_the_new_text(monkeypatch, pairs_a_line):
    monkeypatch.setattr(diffs, "PAIRS_A_LINE", pairs_a_line)
    r = random.Random(pairs_a_line)
    say = lambda: "".join(r.choice(["a", "b", "c", "--- d", "@@ -1 +1 @@", ""]) + r.choice(["\n", "\n", "\n", "", "\r\n"]) for _ in range(r.randrange(24)))
    for _ in range(3000):
        old, new = say(), say()
        a, b = diffs._lines(old), diffs._lines(new)
        text, added, removed = diffs.file_diff("p", old, new)
        common = longest_common(a, b)
        assert (added, removed) == (len(b) - common, len(a) - common)
        assert diffs.patched(old, text) == new


def test_a_diff_reads_as_usual():
    old = "".join(f"{c}\n" for c in "abcdefghijklmnop")
    new = old.replace("c\n", "C\n").replace("p\n", "p")
    assert diffs.file_diff("x y", old, new)[0] == "diff --git a/x y b/x y\n--- a/x y\n+++ b/x y\n@@ -1,6 +1,6 @@\n a\n b\n-c\n+C\n d\n e\n f\n@@ -13,4 +13,4 @@\n m\n n\n o\n-p\n+p\n\\ No newline at end of file\n"
    assert diffs.file_diff("n", None, "x\n")[0] == "diff --git a/n b/n\nnew file mode 100644\n--- /dev/null\n+++ b/n\n@@ -0,0 +1 @@\n+x\n"
    assert diffs.file_diff("n", "x\n", None)[0] == "diff --git a/n b/n\ndeleted file mode 100644\n--- a/n\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n"
    assert diffs.file_diff("n", None, "")[0] == "diff --git a/n b/n\nnew file mode 100644\n"


def test_long_texts_of_moved_lines_take_little_time():
    r = random.Random(1)
    a = [f"line {k}\n" for k in range(50_000)]
    b = r.sample(a, len(a))
    assert len(diffs.kept_lines(a, b)) > 300


def test_trees_without_files_and_whole_diffs(spark):
    none = spark.createDataFrame([], "repo string, path string, blob string")
    some = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2"), ("q", "a", "1")], "repo string, path string, blob string")
    assert sorted((r.repo, r.path, r.status) for r in diffs.changed_files(none, some, "repo").collect()) == [("q", "a", "added"), ("r", "a", "added"), ("r", "b", "added")]
    assert {r.status for r in diffs.changed_files(some, none, "repo").collect()} == {"deleted"} and diffs.changed_files(some, some, "repo").count() == 0
    blobs = spark.createDataFrame([("1", "x\n"), ("2", None)], "blob string, text string")
    found = diffs.diffs(diffs.with_texts(diffs.changed_files(none, some, "repo"), blobs))
    whole = {r.repo: (r.diff, r.truncated) for r in diffs.commit_diff(found, "repo", 1000).collect()}
    one = diffs.file_diff("a", None, "x\n")[0]
    assert whole == {"q": (one, False), "r": (one + diffs.file_diff("b", None, "")[0], False)}
    cut = {r.repo: (r.diff, r.truncated) for r in diffs.commit_diff(found, "repo", len(one)).collect()}
    assert cut == {"q": (one, False), "r": (one, True)}


def graph(seed, n=40):
    r = random.Random(seed)
    parents = {k: r.sample(range(k), min(k, r.choice([0, 1, 1, 1, 2, 2]))) for k in range(n)}
    up = {}
    for k, ps in parents.items():
        up[k] = {k}.union(*(up[p] for p in ps))
    return parents, up


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_bases_on_random_graphs(spark, seed):
    parents, up = graph(seed)
    edges = spark.createDataFrame([(k, p, o) for k, ps in parents.items() for o, p in enumerate(ps or [None])], "sha int, parent int, ord int")
    r = random.Random(seed)
    pairs = {(r.randrange(40), r.randrange(40)) for _ in range(150)}
    want = {}
    for a, b in pairs:
        both = up[a] & up[b]
        best = [c for c in both if not any(c in up[x] for x in both - {c})]
        if best:
            want[a, b] = min(best)
    got = history.merge_bases(spark.createDataFrame(sorted(pairs), "red int, main int"), edges)
    assert {(x.red, x.main): x.base for x in got.collect()} == want


def test_bases_of_windows(spark):
    edges = spark.createDataFrame([(1, None, 0), (2, 1, 0), (3, 2, 0), (4, 2, 0), (5, 4, 0), (6, None, 0)], "sha int, parent int, ord int")
    rows = [("green", 3, 2, True, 5), ("gone", 5, 3, True, 3), ("pull", 5, None, True, 3), ("push", 5, None, False, 3), ("root", 1, None, True, 3), ("apart", 6, None, True, 3), ("self", 3, 3, False, 5)]
    windows = spark.createDataFrame(rows, "name string, red int, prev_green int, pull_request boolean, main int")
    known = spark.createDataFrame([(k,) for k in (1, 2, 4, 5, 6)], "sha int")
    based = history.cut(history.window_base(windows, edges, known))
    assert {x.name: (x.base, x.base_kind) for x in based.collect()} == {"green": (2, "last_green"), "gone": (4, "first_parent"), "pull": (2, "pr_merge_base"), "push": (4, "first_parent"), "root": (None, None), "apart": (None, None), "self": (2, "first_parent")}
    since = history.window_commits(based.where(F.col("name").isin("green", "pull")), edges)
    assert sorted((x.red, x.sha) for x in since.collect()) == [(3, 3), (5, 4), (5, 5)]
    assert history.window_base(windows.limit(0), edges, known).count() == 0


def test_commits_are_amended_if_all_their_parents_are_equal(spark):
    parents = {"m": ["a", "b", "c"], "n": ["c", "b", "a"], "o": ["a", "d", "c"], "p": ["a", "c"], "q": ["c", "a"], "r": ["a,c"], "s": ["a"], "t": ["a", "a"]}
    edges = [(k, p, o) for k, ps in parents.items() for o, p in enumerate(ps)] + [(k, None, 0) for k in "abcd"]
    pairs = [(x, y) for x in [*parents, "a", "gone"] for y in [*parents, "a", "gone"]]
    got = history.relation(spark.createDataFrame(pairs, "red string, green string"), spark.createDataFrame(edges, "sha string, parent string, ord int"))
    want = {}
    for x, y in pairs:
        alike = "amend" if set(parents.get(x, ())) == set(parents.get(y, ())) else "diverged"
        want[x, y] = "identical" if x == y else "ahead" if x in parents.get(y, ()) else "unknown" if {x, y} & {"a", "gone"} else alike
    assert {(x.red, x.green): x.relation for x in got.collect()} == want


def test_edges_of_events_come_of_one_order_and_agree_with_sql(spark, tmp_path):
    kinds = ["purchase", "view", "error"]
    rows = [(None if k % 11 == 0 else k, k * 7 % 200, k % 4 + 10, kinds[k % 3]) for k in range(200)]
    events = spark.createDataFrame(rows, "event_id bigint, at bigint, user_id bigint, event_type string")
    events.select("event_id", F.timestamp_seconds("at").alias("ts"), "user_id", "event_type").write.parquet(str(tmp_path / "events.parquet"))
    edges = cases._edges(spark, str(tmp_path))
    assert edges._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = duckdb.sql(f"WITH events AS (FROM '{tmp_path}/events.parquet/*.parquet'), {cases._EDGES} SELECT sha, parent FROM own WHERE sha IS NOT NULL UNION ALL SELECT sha, parent FROM g WHERE sha IS NOT NULL AND parent IS NOT NULL EXCEPT ALL SELECT sha, parent FROM own WHERE parent IS NOT NULL").fetchall()
    got = [(r.sha, r.parent) for r in edges.where("sha is not null").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_a_cut_leaves_the_session_as_it_was(spark):
    held, seen = spark.conf.get(history._HELD), []
    rows = spark.range(100).select(F.col("id").alias("sha"))
    rows.sparkSession.conf.set(history._HELD, "7b")
    try:
        assert history.cut(rows).count() == 100
        seen.append(spark.conf.get(history._HELD))
    finally:
        spark.conf.set(history._HELD, held)
    assert seen == ["7b"]
