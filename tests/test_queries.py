"""Every query that SQL can express against DuckDB over the same tables, and the streaming form of streaks."""

import datetime
import os
from decimal import Decimal

import duckdb
import pytest

from faultline.plans import catalogue

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (float, Decimal)):
        return None if v != v else round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_agrees_with_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    want = duck.execute(catalogue.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)


def test_streaks_ignore_what_is_neither_and_stay_open(spark):
    from pyspark.sql import functions as F

    from faultline.operators.streaks import red_streaks

    runs = spark.createDataFrame([(1, 4, "ok"), (1, 1, "fail"), (1, 2, "cancelled"), (1, 3, None), (2, 1, "ok"), (2, 2, "fail")], "k int, id int, c string")
    rows = red_streaks(runs, ["k"], ["id"], F.col("c") == "fail", F.col("c") == "ok").orderBy("k").collect()
    assert [tuple(r) for r in rows] == [(1, 1, 1, 1, None, 4), (2, 1, 2, 2, 1, None)]


def test_wilson_bounds(spark):
    from pyspark.sql import functions as F

    from faultline.functions.columns import wilson

    low, high = wilson(F.col("h"), F.col("n"))
    rows = spark.createDataFrame([(5, 10), (0, 10), (0, 0)], "h int, n int").select(F.round(low, 3), F.round(high, 3)).collect()
    assert [tuple(r) for r in rows] == [(0.237, 0.763), (0.0, 0.278), (None, None)]


def test_closed_schema(spark, tmp_path):
    from faultline.sources.records import read_json_lines

    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": "x"}\n\n{"a": 2, "b": null}\n')
    (tmp_path / "b.jsonl").write_text('{"a": 1, "c": 2}\n')
    assert read_json_lines(spark, str(tmp_path / "a.jsonl"), "a int, b string").count() == 2
    with pytest.raises(Exception, match="unknown fields"):
        read_json_lines(spark, str(tmp_path / "b.jsonl"), "a int, b string").collect()


def test_streaming_streaks_equal_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from faultline.streaming.streaks import closed_streaks

    events = spark.read.parquet(f"{DATA}/events.parquet").where("event_type IN ('error', 'purchase', 'signup')").select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("red"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = closed_streaks(stream).writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    batch = catalogue.red_streaks(spark, DATA).where("next_green IS NOT NULL")
    columns = ["user_id", "streak_length", "first_red", "last_red", "prev_green", "next_green"]
    assert sorted(map(tuple, spark.table("closed").select(columns).collect()), key=repr) == sorted(map(tuple, batch.select(columns).collect()), key=repr)


def test_streaks_of_runs_out_of_order_equal_batch(spark, tmp_path):
    import random

    from faultline.streaming.streaks import closed_streaks_out_of_order

    start = datetime.datetime(2024, 1, 1)
    draw = random.Random(5)
    rows = [(draw.randrange(4), start + datetime.timedelta(minutes=k), k, draw.random() < 0.6) for k in range(400)]
    late = sorted(rows, key=lambda r: r[2] + draw.randrange(60))
    end = [(9, start + datetime.timedelta(days=9), 999, False)]
    schema = "user_id bigint, ts timestamp, event_id bigint, red boolean"
    for n, part in enumerate([late[:130], late[130:260], late[260:], end, end]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    run = closed_streaks_out_of_order(stream, "2 hours").writeStream.format("memory").queryName("ordered").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    expected = []
    for user in range(4):
        green, reds = None, []
        for _, _, event, red in (r for r in rows if r[0] == user):
            if red:
                reds.append(event)
                continue
            if reds:
                expected.append((user, len(reds), reds[0], reds[-1], green, event))
            green, reds = event, []
    found = spark.table("ordered").select("user_id", "streak_length", "first_red", "last_red", "prev_green", "next_green").collect()
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


def test_kinds_of_python_changes():
    from faultline.operators.fixes import change_kind
    from faultline.plans.inline import PYTHON_CHANGES

    kinds = ["format", "noqa", "types", "coverage", "types", "types", "semantic", "semantic", "semantic"]
    assert [change_kind(*c) for c in PYTHON_CHANGES] == kinds
    assert change_kind("if TYPE_CHECKING:\n    import a\nx = 1\n", "x = 1\n") == "types"
    assert change_kind("x: int\ny = 1\n", "y = 1\n") == "types"


def test_fix_evidence_finds_reverts_and_candidates(spark):
    from pyspark.sql import functions as F

    from faultline.operators import fixes, rules

    rows = [
        (1, [("c1", "tidy")], ["src/a.py"], ["src/a.py"], ["abcdef1234567"]),
        (2, [("c1", "tidy"), ("c2", "This reverts commit abcdef1.")], ["docs/a.md"], [], ["abcdef1234567"]),
        (3, [("c1", None), ("c2", "x")], ["src/a.py"], [], []),
        (4, [], ["src/a.py"], [], []),
    ]
    df = spark.createDataFrame(rows, "id int, commits array<struct<sha:string,message:string>>, fix_files array<string>, log_files array<string>, breaking array<string>")
    df = df.withColumns({"has_green": F.lit(True), "relation": F.lit("ahead"), "max_commits": F.lit(8), "job_passed": F.lit(True)})
    got = {r.id: (r.status, r.confidence, r.candidate, r.reasons) for r in rules.score_fix(fixes.fix_evidence(df)).collect()}
    assert got[1] == ("matched", "high", "c1", "relation_ahead,window_commits_1,fix_overlaps_log_referenced_files")
    assert got[2] == ("matched", "medium", "c2", "relation_ahead,window_commits_2,fix_touches_only_docs,revert_of_breaking_commit")
    assert got[3] == ("matched", "medium", None, "relation_ahead,window_commits_2")
    assert got[4] == ("ambiguous", "low", None, "relation_ahead,window_commits_0,empty_fix_window")


def test_kinds_of_a_fix(spark):
    from faultline.operators.fixes import fix_kinds

    files = spark.createDataFrame([(1, "pyproject.toml"), (1, "docs/a.md"), (2, "src/a.py"), (2, "tests/test_a.py")], "id int, path string")
    changed = spark.createDataFrame([(1, "pyproject.toml", "numpy>=2"), (2, "src/a.py", "x = 1")], "id int, path string, line string")
    assert {r.id: (r.kinds, r.dep_change) for r in fix_kinds(files, changed, "id").collect()} == {1: (["dep"], True), 2: (["source", "test"], False)}


def test_cases_without_prediction_or_of_two_systems_are_refused(spark):
    from faultline.operators import evaluation

    cases = spark.createDataFrame([(1,), (2,)], "id int")
    one = spark.createDataFrame([(1, "a"), (2, "a")], "id int, system string")
    assert evaluation.with_predictions(cases, one, "id").count() == 2
    for bad in ([(1, "a")], [(1, "a"), (2, "b")]):
        with pytest.raises(Exception, match="prediction"):
            evaluation.with_predictions(cases, spark.createDataFrame(bad, "id int, system string"), "id").collect()
    with pytest.raises(Exception, match="unknown case id"):
        evaluation.selected(cases, spark.createDataFrame([(3,)], "id int"), "id").collect()


def test_records_are_read_and_written(spark, tmp_path):
    from faultline.sources import records

    raw = spark.createDataFrame([(7, 1, None, None, "push", ("o/r",), None, "s", "failure", "t", 0, None)], "id bigint, workflow_id bigint, name string, path string, event string, head_repository struct<full_name:string>, head_branch string, head_sha string, conclusion string, created_at string, run_attempt int, html_url string")
    run = records.runs(raw).first()
    assert (run.run_id, run.workflow_name, run.head_repo, run.head_branch, run.run_attempt) == (7, "", "o/r", "", 1)
    cases = spark.createDataFrame([(1, None), (2, "no_green"), (3, "no_green")], "case_id int, reason string")
    records.write_outcomes(cases, str(tmp_path / "yes"), str(tmp_path / "no"))
    assert spark.read.json(str(tmp_path / "yes")).count() == 1 and spark.read.json(str(tmp_path / "no")).count() == 2
    assert records.funnel(cases).first().report == '{"seen":3,"outcomes":{"accepted":1,"no_green":2}}'
    for k in "ab":
        (tmp_path / k).mkdir()
        (tmp_path / k / "report.json").write_text('{\n "system": "%s",\n "cases": 3\n}' % k)
    got = records.read_reports(spark, f"{tmp_path}/[ab]/report.json", "system string, cases int")
    assert sorted((r.path.split("/")[-2], r.system, r.cases) for r in got.collect()) == [("a", "a", 3), ("b", "b", 3)]
    assert records.read_predictions(spark, str(tmp_path / "yes")).columns[0] == "case_id"


@pytest.mark.parametrize("name", ["baseline_diagnosis", "baseline_evidence"])
def test_lines_of_logs_are_made_once(spark, name):
    plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    # the last line of every log, as it is made
    assert "Post job cleanup" not in plan


def test_ids_of_every_shape_are_checked_as_the_miner_does(spark):
    def repository(name):
        owner, _, repo = name.partition("/")
        return bool(owner and repo and "/" not in repo)

    rows = catalogue.QUERIES["id_checks"](spark, DATA).collect()
    names = {r.name for r in rows}
    assert {None, "abc", "./.", "../x"} <= names and any(n and n.startswith("own.er/na-me_") for n in names)
    assert all(r.repository == (r.name is not None and repository(r.name)) for r in rows)
    assert {r.sha for r in rows} == {r.repository for r in rows} == {True, False}
