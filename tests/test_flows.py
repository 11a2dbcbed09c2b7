"""Pages, replaced tables, upserts of streams, reviews, reachability and investigations on small cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import history, investigate, numbering, reviews
from faultline.sources import pages, tables
from faultline.streaming import sink


def uri(path):
    return f"file://{path}"


def landed(tmp_path, sizes):
    n = 0
    for k, size in enumerate(sizes, 1):
        folder = tmp_path / "list" / f"page={k}"
        folder.mkdir(parents=True)
        (folder / "part-0.txt").write_text(json.dumps({"total_count": sum(sizes), "items": [{"id": n + i, "name": f"é{n + i}"} for i in range(size)]}))
        n += size
    return uri(tmp_path / "list")


@pytest.mark.parametrize(("sizes", "most", "want"), [([3, 3, 2, 3], 10, 8), ([3, 3, 3], 10, 9), ([3, 3, 3], 2, 6), ([3, 0, 3], 10, 3), ([0], 10, 0), ([1, 3], 10, 1)])
def test_a_list_ends_with_its_first_short_page(spark, tmp_path, sizes, most, want):
    got = pages.paginated(spark, landed(tmp_path, sizes), "id bigint, name string", per_page=3, max_pages=most).collect()
    assert sorted((r.id, r.name) for r in got) == [(i, f"é{i}") for i in range(want)]


def test_pages_are_partitions_and_filters_close_them(spark, tmp_path):
    folder = landed(tmp_path, [2] * 9)
    reader = pages.PushingPageReader({"path": folder})
    left = list(reader.pushFilters([pages.GreaterThan(("page",), 3), pages.LessThanOrEqual(("page",), 6), pages.EqualTo(("item",), "x")]))
    assert [type(f).__name__ for f in left] == ["EqualTo"] and [p.number for p in reader.partitions()] == [4, 5, 6]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = pages.paginated(spark, folder, "id bigint", per_page=2).where("page in (2, 5)")
        assert sorted(r.id for r in got.collect()) == [2, 3, 8, 9]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_missing_folder_is_an_empty_list(spark, tmp_path):
    assert pages.paginated(spark, uri(tmp_path / "none"), "id bigint").count() == 0


def test_rows_land_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(k * 7 % 50, f"t{k * 7 % 50}") for k in range(50)], "id bigint, name string").repartition(6)
    pages.land_all(rows, ["id"], uri(tmp_path / "l"), per_page=8)
    got = pages.paginated(spark, uri(tmp_path / "l"), "id bigint, name string", per_page=8).collect()
    assert sorted((r.page, r.id) for r in got) == [(i // 8 + 1, i) for i in range(50)]
    assert sorted((r.place, r.id) for r in numbering.numbered(rows, [F.desc("id")]).collect()) == [(49 - i, i) for i in range(49, -1, -1)]


def test_a_failing_writer_leaves_the_old_table(spark, tmp_path):
    folder = uri(tmp_path / "t")
    with pytest.raises(ValueError, match="no table"):
        tables.load(spark, folder)
    tables.save(spark.range(5), folder, note={"upto": 1})
    old = tables.load(spark, folder)
    with pytest.raises(Exception, match="halfway"):
        tables.save(spark.range(100).select(F.when(F.col("id") == 99, F.raise_error(F.lit("halfway")).cast("bigint")).otherwise(F.col("id")).alias("id")), folder)
    assert tables.load(spark, folder).count() == 5 and tables.current(spark, folder)["note"] == {"upto": 1}
    tables.save(tables.load(spark, folder).select((F.col("id") + 10).alias("id")), folder)  # made of itself
    assert sorted(r.id for r in tables.load(spark, folder).collect()) == [10, 11, 12, 13, 14]
    assert sorted(r.id for r in old.collect()) == [0, 1, 2, 3, 4]  # a reader that began before
    for _ in range(3):
        tables.save(spark.range(0), folder)
    assert tables.load(spark, folder).count() == 0
    assert sum(p.name.startswith("v-") and p.name != "v-" for p in (tmp_path / "t").iterdir()) <= 3


def streamed(spark, tmp_path, write):
    stream = spark.readStream.schema("system string, case_id int, value int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)


def test_a_stream_that_is_killed_and_restarted_leaves_each_row_once(spark, tmp_path):
    for k in range(4):
        rows = [("a", c, k) for c in range(k, k + 3)] + [("b", None, k)]
        spark.createDataFrame(rows, "system string, case_id int, value int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    folder, seen = uri(tmp_path / "out"), []
    save = sink.upserts(folder)

    def dies(batch, number):
        seen.append(number)
        save(batch, number)
        if number == 1 and seen.count(1) == 1:
            raise RuntimeError("killed between the write and the commit")

    with pytest.raises(Exception, match="killed"):
        streamed(spark, tmp_path, dies)
    streamed(spark, tmp_path, dies)
    streamed(spark, tmp_path, dies)
    assert seen == [0, 1, 1, 2, 3]
    keys = ["system", "case_id"]
    got = sorted(map(tuple, sink.latest(spark, folder, keys).collect()), key=repr)
    assert len(got) == 7 and len(set(got)) == 7
    sink.compact(spark, folder, keys)
    assert sorted(map(tuple, sink.latest(spark, folder, keys).collect()), key=repr) == got
    save(spark.createDataFrame([("a", 0, 99)], "system string, case_id int, value int"), 3)  # a replay of what the base holds
    assert sorted(map(tuple, sink.latest(spark, folder, keys).collect()), key=repr) == got
    save(spark.createDataFrame([("a", 0, 7)], "system string, case_id int, value int"), 4)
    assert {(r.case_id, r.value) for r in sink.latest(spark, folder, keys).where("system = 'a'").collect()} >= {(0, 7)}
    sink.compact(spark, folder, keys)
    assert sink.latest(spark, folder, keys).count() == 7


def test_repeated_events_pass_once(spark, tmp_path):
    rows = spark.sql("SELECT timestamp_seconds(1704067200 + id % 10) AS ts, id % 5 AS k FROM range(40)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = sink.once(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", "1 hour", ["k"])
    run = stream.writeStream.format("memory").queryName("unique_events").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(r.k for r in spark.table("unique_events").collect()) == [0, 1, 2, 3, 4]


def labelled(spark):
    old = ("TEST_FAILURE", None, "needs_review", "low", None, "f", "n", False)
    rows = [("a", old, 1), ("b", ("LINT_FAILURE", "TYPE_ERROR", "auto_verified", "high", None, None, None, True), 2), ("c", old, 3)]
    return spark.createDataFrame(rows, f"case_id string, labels struct<{', '.join(c.replace(' ', ':') for c in reviews.LABELS.split(', '))}>, decision int")


def test_reviews_are_merged_into_nested_labels(spark):
    cases = labelled(spark).withColumnRenamed("decision", "other")
    decisions = spark.createDataFrame([("a", None, "x", "y", " why ", True), ("b", "UNKNOWN", "  ", " fix ", None, None)], f"case_id string, {reviews.DECISION}")
    got = {r.case_id: r for r in reviews.apply_reviews(cases, decisions, "case_id", "model_reviewed").collect()}
    assert tuple(got["a"].labels) == ("TEST_FAILURE", None, "needs_review", "low", None, "f", "why", False)
    assert tuple(got["b"].labels) == ("UNKNOWN", "TYPE_ERROR", "model_reviewed", "high", None, "fix", None, True)
    assert tuple(got["c"].labels) == ("TEST_FAILURE", None, "needs_review", "low", None, "f", "n", False) and got["c"].other == 3
    assert tuple(reviews.review_counts(cases, decisions).first()) == (1, 1, 1)
    with pytest.raises(ValueError, match="typo"):
        reviews.apply_reviews(cases, decisions.unionAll(spark.createDataFrame([("typo", "X", None, None, None, None)], decisions.schema)), "case_id", "x")
    assert reviews.apply_reviews(cases, decisions.limit(0), "case_id", "x").count() == 3


def test_the_queue_holds_reviews_and_what_is_left_to_audit(spark):
    rows = [(k, ("X", None, "auto_verified" if k < 20 else "needs_review", "low", None, None, None, k in (0, 1))) for k in range(25)]
    cases = spark.createDataFrame(rows, f"case_id int, labels struct<{', '.join(c.replace(' ', ':') for c in reviews.LABELS.split(', '))}>").withColumn("text", F.lit("body"))
    queue = reviews.queue(cases, "case_id", 6, "s")
    got = queue.collect()
    assert sorted(r.case_id for r in got if r.why == "review") == [20, 21, 22, 23, 24]
    assert sum(r.why == "audit" for r in got) == 4 and not {0, 1} & {r.case_id for r in got}
    assert sorted(map(tuple, got)) == sorted(map(tuple, reviews.queue(cases.repartition(5), "case_id", 6, "s").collect()))
    shown = {r.case_id: r.shown for r in reviews.rendered(queue, cases, "case_id", "text", blind=True).collect()}
    assert shown[20] == "case: 20 (review)\nlabel: (hidden)\nbody"


@pytest.mark.parametrize("seed", [1, 2])
def test_reachability_equals_the_closure(spark, seed):
    draw = random.Random(seed)
    parents = {k: sorted(draw.sample(range(k), min(k, draw.choice([0, 1, 1, 1, 2, 3])))) if k else [] for k in range(60)}
    up = {}
    for k in range(60):
        up[k] = {k}.union(*[up[p] for p in parents[k]])
    rows = [(k, p) for k, ps in parents.items() for p in ps or [None]]
    edges = spark.createDataFrame([*rows, rows[-1], (59, 1000)], "sha int, parent int")
    up[59] = up[59] | {1000}
    up[1000] = {1000}
    pairs = spark.createDataFrame([(a, b) for a in [*range(60), 1000, 5000] for b in [*range(60), 5000]], "red int, green int")
    index = history.reach_index(edges)
    got = {(r.red, r.green): r.ahead for r in history.reaches(pairs, index).collect()}
    assert len(got) == 62 * 61 and all(ahead == (a in up.get(b, ())) for (a, b), ahead in got.items())
    asked = spark.createDataFrame([(a, b) for a in range(0, 60, 7) for b in range(0, 60, 5)] + [(5000, 9)], "base int, head int")
    between = {(r.base, r.head, r.sha) for r in history.commits_between(asked, edges).collect()}
    assert between == {(a, b, s) for a in range(0, 60, 7) for b in range(0, 60, 5) for s in up[b] - up[a]} | {(5000, 9, s) for s in up[9]}


def test_the_index_of_a_line_is_as_long_as_the_line(spark):
    edges = spark.range(2000).select(F.col("id").alias("sha"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    places, hops = history.reach_index(edges)
    assert places.count() == 2000 and hops.count() == 0 and places.where("chain = 0 and place = sha").count() == 2000


def test_the_index_takes_as_many_rounds_as_the_longest_way_has_doublings(spark, monkeypatch):
    cuts, cut = [], history.cut
    monkeypatch.setattr(history, "cut", lambda df: cuts.append(1) or cut(df))
    # a chain of two commits for each k, whose second one merges the second one of the chain before
    rows = [r for k in range(40) for r in [(2 * k, None, 0), (2 * k + 1, 2 * k, 0)] + [(2 * k + 1, 2 * k - 1, 1)] * (k > 0)]
    places, hops = history.reach_index(spark.createDataFrame(rows, "sha int, parent int, ord int"))
    assert sorted(tuple(r) for r in hops.collect()) == [(2 * k, 1, 2 * j, 1) for k in range(40) for j in range(k)]
    assert places.count() == 80 and len(cuts) < 16


def test_ancestors_are_made_once_in_few_steps(spark, monkeypatch):
    cuts, cut = [], history.cut
    monkeypatch.setattr(history, "cut", lambda df: cuts.append(1) or cut(df))
    monkeypatch.setattr(history, "BLOCK", 8, raising=False)
    draw, up = random.Random(7), {}
    parents = {k: [k - 1] * (k not in (0, 41)) + ([draw.randrange(k)] if k % 6 == 5 else []) for k in range(90)}
    for k, ps in parents.items():
        up[k] = {k}.union(*[up[p] for p in ps])
    edges = spark.createDataFrame([(k, p, n) for k, ps in parents.items() for n, p in enumerate(ps or [None])], "sha int, parent int, ord int")
    got = [tuple(r) for r in history.ancestors(edges, spark.createDataFrame([(k,) for k in [*range(0, 90, 9), 9, 500]], "sha int")).collect()]
    assert sorted(got) == sorted([(k, a) for k in range(0, 90, 9) for a in up[k]] + [(500, 500)])
    assert len(cuts) < 40
    assert sorted(tuple(r) for r in history.ancestors(edges.drop("ord")).collect()) == sorted((k, a) for k in up for a in up[k])


def said(failure="TYPE_ERROR", quote="line one", cause="a cause", files=()):
    return (failure, cause, 0.5, list(files), [quote])


def run(spark, script, tool=None):
    """script: of each case its answers (a proposal, or the kind of an error) and its wishes for tools."""
    rows = []
    for case, (answers, wishes) in script.items():
        for kind, turns in (("answer", answers), ("decide", wishes)):
            for turn, x in enumerate(turns, 1):
                bad = isinstance(x, str)
                rows.append((case, kind, turn, "broken" if bad else None, x if bad else "", None if bad or kind == "answer" else (*x, None), None if bad or kind == "decide" else x))
    replies = spark.createDataFrame(rows, f"case_id int, kind string, turn int, {investigate.REPLY}")
    cases = spark.createDataFrame([(c, [("log", "line one\nsee a/b.py", 1.0)], ["a.py"]) for c in script], "case_id int, sections array<struct<name:string,body:string,share:double>>, known array<string>")
    return {r.case_id: r for r in investigate.investigate(cases, investigate.scripted(replies, "case_id"), "case_id", tool).collect()}


def test_investigations_end_as_they_should(spark):
    bad = said(quote="never said")
    got = run(spark, {1: ([said()], []), 2: ([bad, bad, said()], []), 3: ([bad, said(quote="nor this"), said()], []), 4: ([said("UNKNOWN"), said()], []), 5: (["timeout", said("UNKNOWN"), said()], []), 6: (["output", "output", said()], []), 7: (["transport", said()], []), 8: ([bad, "transport"], []), 9: ([], []), 10: (["timeout", "timeout", said()], [])})
    ends = {k: (r.node, r.answer_calls, r.budget, r.shrunk) for k, r in got.items()}
    assert ends[1] == ("finalize", 1, 24000, False)
    assert ends[2] == ("finalize", 2, 24000, False)  # the same complaint twice
    assert ends[3] == ("finalize", 3, 24000, False) and got[3].problems == ""
    assert ends[4] == ("finalize", 2, 40000, False)
    assert ends[5] == ("finalize", 2, 12000, True)  # never grows again
    assert ends[6] == ("finalize", 3, 12000, True)
    assert ends[7] == ("end", 1, 24000, False) and got[7].proposal is None and got[7].problems == "broken"
    assert ends[8] == ("finalize", 2, 24000, False) and got[8].proposal.quotes == ["never said"]
    assert ends[9] == ("end", 1, 24000, False) and got[9].problems == "no reply"
    assert ends[10] == ("end", 2, 12000, True)


def test_tools_are_bounded_and_repeats_end_them(spark):
    read, search, other = ("read_file", "x", None), ("search_code", None, "p"), ("list_files", None, None)
    tool = lambda asked: asked.withColumn("result", F.concat(F.lit("found zz.py by "), F.col("request.name")))
    script = {1: ([said(files=["zz.py"])], [read, search, other, read]), 2: ([said()], [read, read, search]), 3: ([said(files=["zz.py"]), said()], [("diagnose", None, None)]), 4: ([said()], ["timeout"]), 5: ([said()], [search, "transport"])}
    got = run(spark, script, tool)
    assert {k: (r.node, r.decide_calls, len(r.requests), r.answer_calls) for k, r in got.items()} == {1: ("finalize", 3, 3, 1), 2: ("finalize", 2, 2, 1), 3: ("finalize", 1, 0, 2), 4: ("finalize", 1, 0, 1), 5: ("finalize", 2, 1, 1)}
    assert got[1].results == ["found zz.py by read_file", "found zz.py by search_code", "found zz.py by list_files"] and got[1].problems == ""
    assert [r.name for r in run(spark, {1: ([said()], [read])}, investigate.no_tools)[1].requests] == ["read_file"]


def test_outputs_are_told_apart(spark):
    from faultline.sources import outputs

    texts = {'{"k": 1}': "", ' {"k": 1, "z": [1]} ': "", '{"k": 1': "truncated", '{"k": "a': "truncated", '{"a": "}"': "truncated", '{"k": 1} extra': "malformed", '{"k": }': "malformed", "[1, 2]": "not_object", '"x"': "not_object", "3": "not_object", "null": "not_object", "": "empty", "  ": "empty", None: "empty", "hello": "malformed", "[{}": "truncated", "{'k': 1}": "malformed"}
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.text: (r.error_kind, r.parsed) for r in outputs.parsed(df, "text", "k int").collect()}
    assert {t: kind for t, (kind, _) in got.items()} == texts
    assert got['{"k": 1}'][1].k == 1 and all(p is None for k, p in got.values() if k)


def test_what_came_later_must_not_be_told(spark):
    from faultline.operators import evaluation

    rows = [(1, ("see bbb", ["x"]), "aaa", ["bbb", "ccc"], "own"), (2, ("own", ["own"]), "own", [None, "ddd"], "own"), (3, (None, ["ccc1"]), None, ["ccc"], "own"), (4, ("quiet", []), "aaa", None, None)]
    cases = spark.createDataFrame(rows, "id int, input struct<message:string,commits:array<string>>, head string, commits array<string>, sha string")
    assert {r.id: r.leaked for r in evaluation.leaked(cases, "input", ["head", "commits"], "sha").collect()} == {1: ["bbb"], 2: [], 3: ["ccc"], 4: []}
    assert evaluation.without_leaks(cases.where("id in (2, 4)"), "input", ["head", "commits"], "sha", "id").columns == cases.columns
    with pytest.raises(Exception, match="input of 1: bbb"):
        evaluation.without_leaks(cases.where("id = 1"), "input", ["head", "commits"], "sha", "id").collect()


def test_the_last_prediction_of_a_case_counts(spark):
    from faultline.operators import evaluation

    cases = spark.createDataFrame([(1,), (2,)], "id int")
    rows = spark.createDataFrame([(1, "a", "first", 1), (1, "a", "last", 2), (2, "a", "only", 1)], "id int, system string, said string, at int")
    got = evaluation.with_predictions(cases, rows, "id", "at").collect()
    assert sorted((r.id, r.said) for r in got) == [(1, "last"), (2, "only")]


def test_every_match_holds_a_factor(spark):
    from faultline.functions import factors
    from faultline.functions import patterns as P

    examples = {r"^E\s+assert |x?y{3,}z": ["E   assert a", "yyyyz", "xyyyz"], r"\b\d+ failed\b": ["12 failed"], r"(add|missing).{0,40}(CHANGES|news)": ["add to CHANGES", "missing news"], r"a(?:b|cd)*e+f": ["aef", "abcdeeef"], r"[ab]+|c": ["a", "c"], r"(?i)Word": ["wORD"]}
    for pattern, texts in examples.items():
        found = factors.factors(pattern)
        assert found is None or all(any(f in t for f in found) for t in texts), (pattern, found)
    assert factors.factors(r"[ab]+|c") is None and factors.factors(r"(?i)Word") is None
    assert factors.factors(r"\b(SyntaxError|TabError): ") in ({"SyntaxError", "TabError"}, {": "})
    rules = [r[3] for r in P.CLASSIFY_RULES]
    lines = [("2 failed, 1 passed", True), ("all is well", False), ("mypy....Failed", True), (None, False)]
    df = spark.createDataFrame(lines, "t string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", factors.may_match(F.col("t"), rules)).collect())


@pytest.mark.parametrize(("gone", "most", "last"), [(None, 1000, 250), (120, 1000, 119), (200, 1000, 199), (201, 1000, 200), (1, 1000, 0), (None, 130, 130), (None, 100, 100), (120, 7, 7)])
def test_pages_land_in_few_files_and_end_where_one_is_missing(spark, tmp_path, gone, most, last):
    rows = spark.range(500).select((F.col("id") / 2 + 1).cast("int").alias("page"), F.col("id").alias("place"), F.struct(F.concat(F.lit("a\t\n"), "id").alias("name"), "id").alias("item"))
    pages.land(rows.where(F.lit(gone).isNull() | (F.col("page") != gone)), uri(tmp_path / "l"))
    assert len(list((tmp_path / "l").rglob("*.txt"))) == 3
    got = pages.paginated(spark, uri(tmp_path / "l"), "id bigint, name string", per_page=2, max_pages=most).collect()
    assert sorted((r.page, r.id, r.name) for r in got) == [(k // 2 + 1, k, f"a\t\n{k}") for k in range(2 * last)]
