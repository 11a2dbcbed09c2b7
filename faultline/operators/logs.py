"""Step logs and diffs: lines, slices, excerpts, and what they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import patterns as P


def lines_of(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos (from 0), text: the lines of a text without a byte-order mark; a last empty line isn't one."""
    clean = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "^\ufeff", "")
    cut = texts.select(key, F.split(clean, P.LINE_END).alias("parts"))
    kept = F.when(F.element_at("parts", -1) == "", F.slice("parts", 1, F.size("parts") - 1)).otherwise(F.col("parts"))
    return cut.select(key, F.posexplode(kept).alias("pos", "text"))


def parse(lines: DataFrame, key: str) -> DataFrame:
    """key, pos, ts, text: the time before a line, else that of the line before; terminal codes go from the text."""
    stamped = F.col("text").rlike(P.LOG_TIME)
    own = F.when(stamped, F.to_timestamp(F.regexp_extract("text", P.LOG_TIME, 1), "yyyy-MM-dd'T'HH:mm:ss"))
    body = F.when(stamped, F.regexp_extract("text", P.LOG_TIME, 2)).otherwise(F.col("text"))
    known = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    parsed = lines.select(key, "pos", own.alias("own"), F.regexp_replace(body, P.TERMINAL, "").alias("text"))
    return parsed.select(key, "pos", F.last("own", ignorenulls=True).over(known).alias("ts"), "text")


def step_slice(parsed: DataFrame, steps: DataFrame, key: str, tail_lines: int = 400) -> DataFrame:
    """key, pos, text, method of the lines of each key's step (step_name, started_at, completed_at, one row a key).

    Bounds are minima of positions, so they are partial aggregates; one join brings them back to the lines.
    """
    joined = parsed.join(steps, key)
    inside = F.coalesce((F.col("ts") >= F.col("started_at")) & (F.col("ts") < F.col("completed_at") + F.expr("INTERVAL 1 SECOND")), F.lit(False))
    bounds = joined.groupBy(key).agg(F.min(F.when(inside, F.col("pos"))).alias("a"), F.max(F.when(inside, F.col("pos"))).alias("b"), F.max("pos").alias("z"))
    joined = joined.join(bounds, key)
    between = F.col("pos").between(F.col("a"), F.col("b"))
    start_of = Window.partitionBy(key)
    first_ts = F.max(F.when(F.col("pos") == F.col("a"), F.col("ts"))).over(start_of)
    mark = F.min(F.when(between & (F.col("step_name") != "") & F.startswith("text", F.concat(F.lit("##[group]"), F.col("step_name"))), F.col("pos"))).over(start_of)
    joined = joined.withColumns({"first_ts": first_ts, "mark": mark})
    other = F.min(F.when(between & ~F.col("ts").eqNullSafe(F.col("first_ts")), F.col("pos"))).over(start_of)
    run = F.min(F.when(between & F.col("text").startswith("##[group]Run ") & F.col("ts").eqNullSafe(F.col("first_ts")), F.col("pos"))).over(start_of)
    joined = joined.withColumns({"other": other, "run": run})
    run_ok = F.when(F.col("other").isNull() | (F.col("run") < F.col("other")), F.col("run"))
    method = F.when(F.col("a").isNull(), "tail").when(F.col("mark").isNotNull(), "group_marker").otherwise("timestamp")
    low = F.when(F.col("a").isNull(), F.col("z") - tail_lines + 1).otherwise(F.coalesce("mark", run_ok, "a"))
    high = F.when(F.col("a").isNull(), F.col("z")).otherwise(F.col("b"))
    cut = joined.withColumns({"low": low, "high": high, "method": method}).where(F.col("pos").between(F.col("low"), F.col("high")))
    ended = F.min(F.when(F.col("text").startswith("##[error]Process completed with exit code"), F.col("pos"))).over(start_of)
    after = F.min(F.when((F.col("pos") > F.col("low")) & F.col("text").startswith("Post job cleanup."), F.col("pos") - 1)).over(start_of)
    end = F.when(F.col("method") == "tail", F.col("high")).otherwise(F.coalesce(F.least(ended, after), F.col("high")))
    return cut.withColumn("end", end).where(F.col("pos") <= F.col("end")).select(key, "pos", "text", "method")


def excerpt(texts: DataFrame, key: str, text: str, most: int, head: int) -> DataFrame:
    """key, excerpt, truncated: all lines, or the first `head` and as many of the last as the budget of characters holds.

    A fold over the array of one row's lines, from the last; rows stay where they are.
    """
    lines = F.split(F.coalesce(F.col(text), F.lit("")), P.LINE_END)
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    cut = texts.select(key, lines.alias("lines")).withColumn("whole", F.array_join("lines", "\n"))
    cut = cut.withColumns({"n": F.size("lines"), "first": F.array_join(F.slice("lines", 1, head), "\n"), "rest": F.reverse(F.slice("lines", head + 1, F.greatest(F.size("lines"), F.lit(1))))})
    room = f"{most} - length(first) - 64"
    fits = f"aggregate(rest, struct(0 AS used, 0 AS n, true AS open), (s, x) -> CASE WHEN s.open AND s.used + length(x) + 1 <= {room} THEN struct(s.used + length(x) + 1 AS used, s.n + 1 AS n, true AS open) ELSE struct(s.used AS used, s.n AS n, false AS open) END).n"
    long = F.length("whole") > most
    cut = cut.withColumn("kept", F.when(long, F.expr(fits)))
    last = F.array_join(F.reverse(F.slice("rest", F.lit(1), F.col("kept"))), "\n")
    short = F.concat("first", F.lit("\n... ["), (F.col("n") - head - F.col("kept")).cast("string"), F.lit(" lines omitted] ...\n"), last)
    return cut.select(key, F.when(long, short).otherwise(F.col("whole")).alias("excerpt"), long.alias("truncated"))


def stripped(lines: DataFrame) -> DataFrame:
    return lines.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))


def error_lines(lines: DataFrame, key: str, most: int = 50) -> DataFrame:
    """key, rank, line: distinct stripped lines that report an error, by first place, each cut to 500 characters."""
    found = stripped(lines).where(F.col("text").rlike(P.ERROR_LINE)).groupBy(key, "text").agg(F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most).select(key, "rank", F.substring("text", 1, 500).alias("line"))


def failing_tests(lines: DataFrame, key: str) -> DataFrame:
    """key, tests: names of failing tests, first seen first, joined by commas."""
    name = F.regexp_extract("text", P.FAILING_TEST, 1)
    found = stripped(lines).where(F.col("text").rlike(P.FAILING_TEST)).groupBy(key, name.alias("name")).agg(F.min("pos").alias("pos"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"])
    return found.groupBy(key).agg(F.array_join(ordered, ",").alias("tests"))


def error_signature(lines: DataFrame, key: str) -> DataFrame:
    """key, exception, message of the root error: the first pytest line, else the first exception anywhere."""
    line = lines.withColumn("line", F.regexp_replace("text", r"^\s+|\s+$", ""))
    kind = F.when(F.col("line").rlike(P.ASSERTION), "AssertionError").when(F.col("line").rlike(P.EXCEPTION), F.regexp_extract("line", P.EXCEPTION, 1))
    message = F.when(F.col("line").rlike(P.ASSERTION), F.regexp_extract("line", P.ASSERTION, 1)).otherwise(F.regexp_extract("line", P.EXCEPTION, 2))
    found = line.select(key, "pos", "line", kind.alias("exception"), F.substring(message, 1, 300).alias("message")).where("exception is not null")
    weaker = F.when(F.col("line").startswith("E ") | F.col("line").rlike(P.ASSERTION), 0).otherwise(1)
    best = found.groupBy(key).agg(F.min(F.struct(weaker.alias("weaker"), "pos", "exception", "message")).alias("best"))
    return best.select(key, F.col("best.exception").alias("exception"), F.col("best.message").alias("message"))


def _headed() -> Column:
    """The path that a line of a diff is the head of, empty for that of no file."""
    return F.when(F.col("text").startswith("+++ b/"), F.substring(F.col("text"), 7, 4096)).when(F.col("text").startswith("+++ "), "")


def _current(head, key: str) -> Column:
    return F.last(head, ignorenulls=True).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))


def diff_lines(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, path, text of the lines of unified diffs; path is that of the file they belong to, null outside of any."""
    rows = lines_of(diffs, key, text)
    return rows.withColumn("path", F.nullif(_current(_headed(), key), F.lit(""))).select(key, "pos", "path", "text")


def changed_text(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, path, line: the lines that a diff adds or removes, without their signs."""
    counted = F.substring("text", 1, 1).isin("+", "-") & ~F.col("text").startswith("+++ ") & ~F.col("text").startswith("--- ")
    rows = diff_lines(diffs, key, text).where(counted & F.col("path").isNotNull())
    return rows.select(key, "pos", "path", F.substring(F.col("text"), 2, 1 << 30).alias("line"))


def changed_lines(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """key, path, changed, pos: lines added or removed in each file of a unified diff, and where the first is; a line that begins with three minus signs is taken for a head."""
    counted = F.substring("text", 1, 1).isin("+", "-") & ~F.col("text").startswith("+++ ") & ~F.col("text").startswith("---")
    # texts of lines stay where they are: their heads and places alone are shuffled
    marked = lines_of(diffs, key, text).select(key, "pos", _headed().alias("head"), counted.alias("counted")).where("counted or head is not null")
    rows = marked.withColumn("path", _current("head", key)).where("counted and path <> ''")
    return rows.groupBy(key, "path").agg(F.count("*").alias("changed"), F.min("pos").alias("pos"))


def hunks(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """key, rank, hunk: headers of hunks with their paths, in order."""
    rows = diff_lines(diffs, key, text).where(F.col("text").startswith("@@") & F.col("path").isNotNull())
    rank = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    return rows.select(key, rank.alias("rank"), F.concat_ws(" ", "path", "text").alias("hunk"))


def diff_section(diffs: DataFrame, key: str, text: str, path: str, most: int = 20) -> DataFrame:
    """key, section: the first lines of a path's (a column's) part of a diff; empty if it has none."""
    heads = lambda x: x.startswith("diff --git ")
    # the lines are a column of their own: inside of a lambda the text would be split anew for every line
    cut = diffs.select(key, F.col(path).alias("path"), F.split(F.col(text), P.LINE_END).alias("lines"))
    mine = F.transform("lines", lambda x, k: F.when(heads(x) & F.endswith(x, F.concat(F.lit(" b/"), F.col("path"))), k + 1))
    cut = cut.withColumn("start", F.array_min(mine))
    cut = cut.select(key, "start", F.slice("lines", F.coalesce(F.col("start") + 1, F.lit(1)), F.lit(most)).alias("follow"))
    stop = F.array_min(F.transform("follow", lambda x, k: F.when(heads(x), k + 1)))
    last = F.when(F.try_element_at("follow", F.lit(-1)) == "", F.size("follow") - 1).otherwise(F.size("follow"))
    section = F.slice("follow", F.lit(1), F.coalesce(stop - 1, last))
    return cut.select(key, F.when(F.col("start").isNull(), "").otherwise(F.array_join(section, "\n")).alias("section"))
