"""Diagnoses, their evidence, the order of the search, and parts of diffs, on small cases."""

import random

from faultline.operators import logs, rules, trees


def test_error_lines_are_searched_first(spark):
    errors = spark.createDataFrame([(1, 1, "ModuleNotFoundError: late"), (1, 2, "x")], "id int, rank int, line string")
    excerpt = spark.createDataFrame([(1, 0, "ImportError: early"), (2, 0, None)], "id int, pos int, text string")
    cases = spark.createDataFrame([(1, "s", "j", False), (2, "", "j", True)], "id int, step string, job string, tests boolean")
    got = {r.id: (r.rule, r.line) for r in rules.classify(rules.searched(errors, excerpt), cases).collect()}
    assert got == {1: ("import", "ModuleNotFoundError: late"), 2: ("failing_tests", None)}


def test_evidence_is_what_is_there_in_order(spark):
    classified = spark.createDataFrame([(1, "r", "TEST_FAILURE", 0.8, "FAILED a"), (2, "no_rule", "UNKNOWN", 0.1, None), (3, "r", "UNKNOWN", 0.1, "x" * 2000)], "id int, rule string, category string, confidence double, line string")
    lines = spark.createDataFrame([(1, 3, " see src/a.py "), (1, 0, " FAILED a"), (1, 2, "FAILED c"), (1, 1, "FAILED b src/a.py"), (2, 0, None)], "id int, pos int, text string")
    top = spark.createDataFrame([(1, "src/a.py", "log_reference")], "id int, path string, reasons string")
    sections = spark.createDataFrame([(1, "@@ -1 +1 @@\n-x"), (2, "")], "id int, section string")
    cases = spark.createDataFrame([(1, "step", "job", True), (2, "", "job", False), (3, None, "job", False), (4, None, None, None)], "id int, step string, job string, tests boolean")
    got = {r.id: [tuple(x) for x in r["items"]] for r in rules.evidence_items(classified, lines, top, sections, cases).collect()}
    assert [x[:3] for x in got[1]] == [("ci_log", "failed step: step", "FAILED a"), ("ci_log", "failed step: step", "FAILED b src/a.py"), ("git_diff", "src/a.py", "@@ -1 +1 @@\n-x"), ("ci_log", "failed step: step", "FAILED b src/a.py")]
    assert got[2] == [] and got[4] == [] and [(x[1], len(x[2])) for x in got[3]] == [("failed step: job", 1000)]
    assert rules.evidence_items(classified, lines.limit(0), top.limit(0), sections.limit(0), cases.limit(0)).count() == 0


def test_a_cause_tells_the_root_error_and_the_change(spark):
    classified = spark.createDataFrame([(1, "r", "TEST_FAILURE", 0.8, "line"), (2, "r", "POLICY_CHECK_FAILURE", 0.8, "line"), (3, "r", "TEST_FAILURE", 0.5, None)], "id int, rule string, category string, confidence double, line string")
    top = spark.createDataFrame([(1, "a.py", "log_reference,changed_before_failure"), (2, "b.py", "log_reference")], "id int, path string, reasons string")
    signatures = spark.createDataFrame([(1, "ValueError", None)], "id int, exception string, message string")
    changes = spark.createDataFrame([(1, "a.py", "tidy"), (1, "b.py", "no"), (2, "b.py", "no")], "id int, path string, subject string")
    got = {r.id: (r.confidence, r.root_cause) for r in rules.diagnose(classified, top, "id", signatures, changes).collect()}
    assert got[1][1].endswith("(ValueError: ) Most suspicious file: a.py [log_reference, changed_before_failure]. It changed shortly before, in 'tidy'.")
    assert got[2][1].endswith("(line)") and got[3][0] == 0.4
    plain = {r.id: r.root_cause for r in rules.diagnose(classified, top).collect()}
    assert plain[1].endswith("(line) Most suspicious file: a.py [log_reference, changed_before_failure].")


def test_heads_and_lines_of_diffs(spark):
    text = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n---rule\n--- old\n+++ new\ndiff --git a/y b/y\n--- a/y\n+++ b/y\n@@ -1 +1 @@\n+z"
    rows = spark.createDataFrame([(1, text, "y"), (2, text, "x"), (3, text, "no"), (4, None, "x"), (5, "", "x")], "id int, text string, path string")
    got = {r.id: r.section for r in logs.diff_section(rows, "id", "text", "path", 4).collect()}
    assert got[1] == "--- a/y\n+++ b/y\n@@ -1 +1 @@\n+z" and got[2].count("\n") == 3 and got[3] == "" and not got[4] and not got[5]
    # a removed line of two dashes looks like a head to the count of lines, but not to their texts
    assert [(r.path, r.changed) for r in logs.changed_lines(rows.where("id = 1"), "id", "text").collect()] == [("y", 1)]
    assert sorted((r.path, r.line) for r in logs.changed_text(rows.where("id = 1"), "id", "text").collect()) == [("x", "--rule"), ("y", "z")]


def test_a_window_names_the_lines_that_it_shows(spark):
    files = spark.createDataFrame([("a", "1\n2\n3\n4\n", 2), ("b", "", 1), ("c", "x" * 50 + "\ny", 1)], "path string, content string, start int")
    got = {r.path: r["head"] for r in trees.read_window(files, "start", most_chars=20, most_lines=5).collect()}
    assert got == {"a": 'a lines 2-3 of 4; 1 more, go on with "start_line": 4', "b": "b lines 1-0 of 0", "c": 'c lines 1-1 of 2; 1 more, go on with "start_line": 2'}


def test_texts_that_hold_quotes(spark):
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abé", k=draw.randint(1, 12)))
    texts = ["", None, " ", "a\n\n b", *["".join(w + draw.choice([" ", "\n", "  ", "\t"]) for w in [word() for _ in range(draw.randint(1, 60))]) for _ in range(60)]]
    texts += [texts[10], texts[11] * 40]
    quotes = ["", None, " ", "  ", "\n", "zz", "a"]
    for text in texts[4:]:
        for _ in range(4):
            at = draw.randrange(len(text))
            quotes.append(text[at : at + draw.choice([1, 3, 6, 9, 15, 30, 100])])
    quotes += [q + "x" for q in quotes[10:40] if q] + quotes[10:14]
    keys = [None, *range(1, len(texts) - 2), 5, 6]
    rows = spark.createDataFrame(list(zip(keys, texts, strict=True)), "key bigint, text string")
    asked = spark.createDataFrame(list(enumerate(quotes)), "quote_key bigint, quote string")
    want = sorted(((k if k is not None else -1, n) for k, t in zip(keys, texts, strict=True) for n, q in enumerate(quotes) if t and q and q in t))
    for small in (trees.SMALL_BYTES, 0):
        got = sorted((r.key if r.key is not None else -1, r.quote_key) for r in trees.holders(rows, asked, small).collect())
        assert got == want
    assert not trees.holders(rows.limit(0), asked).count() and not trees.holders(rows, asked.limit(0)).count()
    assert trees.holders(rows, asked.limit(0)).columns == ["key", "quote_key"]


def test_nearest_vectors_hold_few_similarities_at_once(spark):
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from faultline.operators import localize

    rng = np.random.default_rng(3)
    # coarse vectors: many ties, which go to the smaller id; some labels are null
    x = rng.integers(-1, 2, (9000, 6)).astype(float) + 0.25
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    asked = np.arange(0, 9000, 6)
    batch = pa.record_batch([pa.array(np.arange(9000)), pa.array(list(x)), pa.array([None if k % 7 == 0 else k % 5 for k in range(9000)], pa.int32())], names=["id", "vector", "label"])
    tracemalloc.start()
    (out,) = localize._nearest(SimpleNamespace(value=(asked, unit[asked])), 5, localize.TILE)(iter([batch.slice(0, 5000), batch.slice(0, 0), batch.slice(5000)]))
    assert tracemalloc.get_traced_memory()[1] < 80e6
    tracemalloc.stop()
    near = np.round(unit[asked] @ unit.T, 9)
    near[np.arange(len(asked)), asked] = -np.inf
    want = np.argsort(-near, axis=1, kind="stable")[:, :5].ravel()
    assert out.column("query").to_pylist() == np.repeat(asked, 5).tolist() and out.column("id").to_pylist() == want.tolist()
    assert out.column("label").to_pylist() == [None if k % 7 == 0 else k % 5 for k in want.tolist()]
    rows = spark.createDataFrame([(k, [1.0, float(k)], None if k == 2 else k) for k in range(4)], "id bigint, vector array<double>, label int").repartition(3)
    got = localize.nearest(rows, rows.where("id = 0"), 5).orderBy("rank").collect()
    assert [(r.query, r["rank"], r.id, r.label) for r in got] == [(0, 1, 1, 1), (0, 2, 2, None), (0, 3, 3, 3)]
