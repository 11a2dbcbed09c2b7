"""Queries on what moves in steps: pages, reviews, streams into tables, investigations."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from faultline.functions import patterns as P
from faultline.operators import evaluation, history, investigate, reviews
from faultline.plans.registry import query, read
from faultline.sources import outputs, pages
from faultline.streaming import sink


def shared(s: SparkSession, name: str) -> str:
    """A new folder where all executors can read."""
    base = s.conf.get("spark.checkpoint.dir", None) or history.shared_folder(s)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT ((row_number() OVER (ORDER BY doc_id) - 1) // 100 + 1)::INT AS page, doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents")
def paginated_scan(s, d):
    """All documents, landed as pages of 100 and read back through the data source."""
    folder = shared(s, "pages")
    pages.land_all(read(s, d, "documents").select("doc_id", "text", "lang", "source", "n_chars"), ["doc_id"], folder)
    got = pages.paginated(s, folder, "doc_id bigint, text string, lang string, source string, n_chars bigint", max_pages=1 << 30)
    return got.select("page", "doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("""WITH p AS (SELECT (l_orderkey // 50 + 1)::INT AS page, l_orderkey, l_linenumber, l_partkey FROM lineitem), n AS (SELECT page, count(*) AS n FROM p GROUP BY 1),
full_ AS (SELECT i AS page, coalesce(n, 0) AS n FROM range(1, 11) AS r(i) LEFT JOIN n ON n.page = i), e AS (SELECT coalesce(min(page), 10) AS last FROM full_ WHERE n < 170)
SELECT page, l_orderkey, l_linenumber, l_partkey FROM p, e WHERE page <= last""")
def paginated_short(s, d):
    """Order lines in pages of 50 orders: pages hold what they happen to, the first with fewer than 170 lines is the last, ten at most."""
    folder = shared(s, "pages")
    item = F.struct("l_orderkey", "l_linenumber", "l_partkey")
    rows = read(s, d, "lineitem").select((F.floor(F.col("l_orderkey") / 50) + 1).cast("int").alias("page"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("place"), item.alias("item"))
    pages.land(rows, folder, "lines")
    return pages.paginated(s, folder, "l_orderkey bigint, l_linenumber int, l_partkey bigint", item_key="lines", per_page=170)


def _review_cases(s, d):
    known = read(s, d, "labels").select("doc_id", "quality", "toxic")
    status = F.when(F.col("quality").isNull(), "needs_review").when(F.col("quality") == 1, "auto_verified").otherwise("needs_review")
    labels = F.struct(
        F.col("lang").alias("category"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("auto_category"), status.alias("label_status"), F.lit("low").alias("label_confidence"),
        F.lit(None).cast("string").alias("root_cause_text"), F.lit("old fix").alias("fix_text"), F.lit("old notes").alias("reviewer_notes"), (F.col("doc_id") % 11 == 0).alias("audited"),
    )
    return read(s, d, "documents").join(known, "doc_id", "left").select("doc_id", "text", labels.alias("labels"))


def _decisions(s, d):
    category = F.when(F.col("toxic") == 1, "TYPE_ERROR").when(F.col("quality") == 1, "LINT_FAILURE")
    root = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("  cause "), F.col("doc_id").cast("string"), F.lit(" "))).otherwise("  ")
    return read(s, d, "labels").select("doc_id", category.alias("category"), root.alias("root_cause"), F.when(F.col("doc_id") % 4 == 0, "new fix").alias("fix_text"), F.when(F.col("doc_id") % 3 == 0, " note ").otherwise("").alias("notes"), (F.col("doc_id") % 5 == 0).alias("audit"))


_CASES = """c AS (SELECT d.doc_id, d.text, lang AS category, CASE WHEN d.doc_id % 3 = 0 THEN source END AS auto_category, CASE WHEN quality = 1 THEN 'auto_verified' ELSE 'needs_review' END AS label_status, d.doc_id % 11 = 0 AS audited FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
r AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'TYPE_ERROR' WHEN quality = 1 THEN 'LINT_FAILURE' END AS category, CASE WHEN doc_id % 2 = 0 THEN 'cause ' || doc_id END AS root, CASE WHEN doc_id % 4 = 0 THEN 'new fix' END AS fix, CASE WHEN doc_id % 3 = 0 THEN 'note' END AS notes, doc_id % 5 = 0 AS audit FROM labels)"""


@query(f"""WITH {_CASES} SELECT c.doc_id, CASE WHEN r.category IS NULL THEN c.category ELSE r.category END AS category, CASE WHEN r.category IS NULL THEN c.auto_category ELSE coalesce(c.auto_category, c.category) END AS auto_category,
CASE WHEN r.category IS NULL THEN c.label_status ELSE 'human_verified' END AS label_status, CASE WHEN r.category IS NULL THEN 'low' ELSE 'high' END AS label_confidence, CASE WHEN r.category IS NOT NULL THEN r.root END AS root_cause_text,
CASE WHEN r.category IS NULL THEN 'old fix' ELSE r.fix END AS fix_text, CASE WHEN r.doc_id IS NULL THEN 'old notes' ELSE r.notes END AS reviewer_notes, CASE WHEN r.category IS NULL THEN c.audited ELSE c.audited OR r.audit END AS audited
FROM c LEFT JOIN r ON r.doc_id = c.doc_id""")
def apply_reviews_merge(s, d):
    """Decisions made of the labels, merged into the nested labels of all documents."""
    return reviews.apply_reviews(_review_cases(s, d), _decisions(s, d), "doc_id", "human_verified").select("doc_id", "labels.*")


@query(f"WITH {_CASES} SELECT (SELECT count(category) FROM r) AS applied, (SELECT count(*) - count(category) FROM r) AS declined, (SELECT count(*) FROM c) - (SELECT count(*) FROM r) AS unchanged")
def review_counts(s, d):
    return reviews.review_counts(_review_cases(s, d), _decisions(s, d))


@query(f"""WITH {_CASES}, q AS (SELECT doc_id, 'review' AS why FROM c WHERE label_status = 'needs_review' UNION ALL (SELECT doc_id, 'audit' FROM c WHERE label_status = 'auto_verified' AND NOT audited ORDER BY md5('3:' || doc_id), doc_id LIMIT (SELECT greatest(0, 200 - count(*) FILTER (audited)) FROM c)))
SELECT q.doc_id, why, 'case: ' || q.doc_id || ' (' || why || ')' || chr(10) || 'label: ' || coalesce(category, '-') || ' [' || label_status || ']' || chr(10) || substr(coalesce(text, ''), 1, 400) AS shown FROM q JOIN c ON c.doc_id = q.doc_id""")
def review_queue(s, d):
    """The queue of documents to review and to audit, as a reviewer sees it."""
    cases = _review_cases(s, d)
    return reviews.rendered(reviews.queue(cases, "doc_id", 200, "3"), cases, "doc_id", "text")


@query("SELECT user_id, event_type, ts, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def streamed_upsert(s, d):
    """The last event of each user and type: events streamed in micro-batches into a table of upserts, each batch saved twice."""
    rows = read(s, d, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    came, table, state = (shared(s, n) for n in ("came", "upserts", "state"))
    rows.repartitionByRange(4, "ts").write.parquet(came)
    keys, save = ["user_id", "event_type"], sink.upserts(table)

    def twice(batch, number):
        save(batch, number)
        save(batch, number)

    stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(came)
    run = stream.writeStream.foreachBatch(twice).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    sink.compact(s, table, keys, ["ts", "event_id"])
    return sink.latest(s, table, keys, ["ts", "event_id"]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# A script for every document: what its answers and its wishes for tools are, by its number and the turn.
def _replies(s, d):
    docs = read(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    turns = docs.withColumn("turn", F.explode(F.array(*map(F.lit, range(1, 4)))))
    mix = F.pmod(F.col("doc_id") * 7 + F.col("turn") * 3, F.lit(20))
    kind = F.when(mix < 3, "timeout").when(mix < 6, "output").when(mix == 6, "transport").otherwise("")
    failure = F.when(mix < 10, "UNKNOWN").when(mix < 12, "NOPE").when(mix < 14, F.lit(None)).otherwise("TYPE_ERROR")
    quote = F.when(F.col("doc_id") % 3 == 0, F.substring("text", 1, 30)).when(F.col("doc_id") % 3 == 1, F.substring("text", -30, 30)).otherwise("not said anywhere")
    quotes = F.when(mix == 15, F.array().cast("array<string>")).otherwise(F.array(F.trim(quote)))
    cause = F.when(mix == 16, "  ").when(mix == 17, "as the system prompt says").otherwise("a cause")
    proposal = F.when(kind == "", F.struct(failure.alias("failure_type"), cause.alias("root_cause"), F.lit(0.5).alias("confidence"), F.array(F.when(mix == 18, "zz.py").otherwise("a.py")).alias("files"), quotes.alias("quotes")))
    none = F.lit(None).cast(investigate.REQUEST)
    answered = turns.select("doc_id", F.lit("answer").alias("kind"), "turn", F.when(kind != "", F.concat(kind, F.lit(" failed"))).alias("error"), kind.alias("error_kind"), none.alias("action"), proposal.cast(investigate.PROPOSAL).alias("proposal"))
    wish = F.pmod(F.col("doc_id") * 5 + F.when(F.col("doc_id") % 4 == 0, 1).otherwise(F.col("turn")), F.lit(9))
    name = F.when(wish < 3, "read_file").when(wish < 5, "search_code").when(wish == 5, "list_files").when(wish == 6, "diagnose")
    action = F.struct(name.alias("name"), F.when(wish < 3, F.concat(F.lit("f"), wish.cast("string"))).alias("path"), F.when((wish >= 3) & (wish < 5), "needle").alias("pattern"), F.lit(None).cast("int").alias("start_line"))
    failed = wish == 7
    decided = turns.select("doc_id", F.lit("decide").alias("kind"), "turn", F.when(failed, "decide failed").alias("error"), F.when(failed, "transport").otherwise("").alias("error_kind"), F.when(~failed, action).alias("action"), F.lit(None).cast(investigate.PROPOSAL).alias("proposal"))
    return answered.unionAll(decided)


_CATS = "'" + "', '".join(P.PRECEDENCE) + "'"
_SCRIPT = """docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
script AS (SELECT doc_id, text, turn, (((doc_id * 7 + turn * 3) % 20) + 20) % 20 AS m, (((doc_id * 5 + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE turn END) % 9) + 9) % 9 AS w FROM docs, range(1, 4) AS r(turn)),
wishes AS (SELECT doc_id, turn, w, CASE WHEN w < 6 THEN CASE WHEN w < 3 THEN 'read_file f' || w WHEN w < 5 THEN 'search_code needle' ELSE 'list_files' END END AS wish FROM script),
replies AS (SELECT doc_id, turn, CASE WHEN m < 3 THEN 'timeout' WHEN m < 6 THEN 'output' WHEN m = 6 THEN 'transport' ELSE '' END AS kind,
  CASE WHEN m < 10 THEN 'UNKNOWN' WHEN m < 12 THEN 'NOPE' WHEN m < 14 THEN NULL ELSE 'TYPE_ERROR' END AS failure, CASE WHEN m = 15 THEN NULL ELSE trim(CASE doc_id % 3 WHEN 0 THEN substr(text, 1, 30) WHEN 1 THEN substr(text, -30, 30) ELSE 'not said anywhere' END, ' ') END AS quote,
  CASE WHEN m = 16 THEN '' WHEN m = 17 THEN 'as the system prompt says' ELSE 'a cause' END AS cause, CASE WHEN m = 18 THEN 'zz.py' ELSE 'a.py' END AS file FROM script)"""


def _packed(budget: str) -> str:
    """Evidence of one section that has the whole budget, and the results of tools."""
    return f"(CASE WHEN trim(text) = '' THEN '' ELSE '## text' || chr(10) || CASE WHEN length(text) > {budget} THEN substr(text, 1, {budget}) || chr(10) || '[... text truncated ...]' ELSE text END END)"


@query(f"""WITH RECURSIVE {_SCRIPT},
gather AS (SELECT doc_id, 1 AS turn, []::VARCHAR[] AS asked, 'decide' AS node, 0 AS calls FROM docs
  UNION ALL SELECT g.doc_id, g.turn + 1, CASE WHEN wish IS NULL THEN asked ELSE list_append(asked, wish) END, CASE WHEN wish IS NULL OR list_contains(asked, wish) OR len(asked) + 1 >= 3 THEN 'propose' ELSE 'decide' END, calls + 1
  FROM gather g JOIN wishes w ON w.doc_id = g.doc_id AND w.turn = g.turn WHERE node = 'decide'),
begun AS (SELECT d.doc_id, text, len(asked) AS tools, calls AS decides FROM gather g JOIN docs d ON d.doc_id = g.doc_id WHERE node = 'propose'),
st AS (SELECT doc_id, 0 AS calls, 24000 AS budget, false AS shrunk, '' AS problems, NULL::VARCHAR AS failure, false AS held, 'propose' AS node FROM begun
  UNION ALL SELECT doc_id, calls, CASE next WHEN 'expand' THEN 40000 WHEN 'shrink' THEN 12000 ELSE budget END, shrunk OR next = 'shrink', told, failure, held, CASE WHEN next IN ('expand', 'shrink') THEN 'propose' ELSE next END
  FROM (SELECT *, CASE WHEN kind <> '' THEN CASE WHEN kind = 'timeout' AND calls < 3 AND NOT shrunk THEN 'shrink' WHEN kind = 'output' AND calls < 3 AND told <> problems THEN 'repair' WHEN kind = 'output' AND calls < 3 AND NOT shrunk THEN 'shrink' WHEN held THEN 'finalize' ELSE 'end' END
      WHEN told <> '' THEN CASE WHEN told <> problems AND calls < 3 THEN 'repair' ELSE 'finalize' END WHEN failure = 'UNKNOWN' AND calls < 3 AND budget < 40000 AND NOT shrunk THEN 'expand' ELSE 'finalize' END AS next
    FROM (SELECT *, CASE WHEN kind = 'output' THEN 'output' WHEN kind <> '' THEN kind || ' failed' ELSE concat_ws('; ', CASE WHEN NOT coalesce(failure IN ({_CATS}), false) THEN 'type ' || coalesce(failure, 'None') END, CASE WHEN cause = '' THEN 'cause' END, CASE WHEN contains(cause, 'system prompt') THEN 'repeats' END,
          CASE WHEN quote IS NULL AND failure IS DISTINCT FROM 'UNKNOWN' THEN 'empty' WHEN quote <> '' AND NOT contains(evidence, quote) THEN 'none ' || quote END, CASE WHEN file = 'zz.py' AND NOT contains(replace(evidence, chr(92), '/'), 'zz.py') THEN 'files' END) END AS told
      FROM (SELECT s.doc_id, s.calls + 1 AS calls, s.budget, s.shrunk, s.problems, r.kind, r.cause, r.quote, r.file, CASE WHEN r.kind = '' THEN r.failure ELSE s.failure END AS failure, s.held OR r.kind = '' AS held,
          {_packed('s.budget')} || CASE WHEN b.tools > 0 THEN chr(10) || chr(10) || 'result ' || b.tools ELSE '' END AS evidence
        FROM st s JOIN begun b ON b.doc_id = s.doc_id JOIN replies r ON r.doc_id = s.doc_id AND r.turn = s.calls + 1 WHERE s.node NOT IN ('finalize', 'end')))))
SELECT st.doc_id, node, st.calls AS answer_calls, decides::INT AS decide_calls, tools::INT AS tools, budget, shrunk, CASE WHEN held THEN failure END AS failure_type, problems <> '' AS has_problems
FROM st JOIN begun b ON b.doc_id = st.doc_id WHERE node IN ('finalize', 'end')""")
def investigation(s, d):
    """Every document as a case, with scripted answers and tools: how its investigation ends."""
    docs = read(s, d, "documents")
    sections = F.array(F.struct(F.lit("text").alias("name"), F.coalesce("text", F.lit("")).alias("body"), F.lit(1.0).alias("share")))
    cases = docs.select("doc_id", sections.alias("sections"), F.array(F.lit("a.py")).alias("known"))
    tool = lambda asked: asked.withColumn("result", F.concat_ws(" ", F.lit("nothing found by"), F.col("request.name")))
    last = investigate.investigate(cases, investigate.scripted(_replies(s, d), "doc_id"), "doc_id", tool)
    return last.select("doc_id", "node", "answer_calls", "decide_calls", F.size("requests").alias("tools"), "budget", "shrunk", F.col("proposal.failure_type").alias("failure_type"), (F.col("problems") != "").alias("has_problems"))


_CUTS = ["props", "substr(props, 1, length(props) - 1)", "substr(props, 1, cast(length(props) / 2 AS int))", "concat(props, ' x')", "concat('[', props, ']')", "'\"a {text\"'", "replace(props, '\"', '')", "''", "concat(' ', props, ' ')", "substr(props, 2)"]


@query(f"""WITH c AS (SELECT event_id, unnest(range({len(_CUTS)}))::INT AS cut, unnest([{", ".join(_CUTS).replace("cast(length(props) / 2 AS int)", "length(props) // 2")}]) AS text FROM events),
t AS (SELECT *, trim(coalesce(text, ''), ' ') AS said, regexp_replace(trim(coalesce(text, ''), ' '), '{outputs.STRING}', '', 'g') AS outside FROM c)
SELECT event_id, cut, CASE WHEN said = '' THEN 'empty' WHEN json_valid(said) AND said[1] = '{{' THEN '' WHEN json_valid(said) THEN 'not_object'
 WHEN contains(outside, '"') OR len(regexp_extract_all(outside, '{outputs.OPENS}')) > len(regexp_extract_all(outside, '{outputs.CLOSES}')) THEN 'truncated' ELSE 'malformed' END AS error_kind,
 CASE WHEN json_valid(said) AND said[1] = '{{' THEN json_extract_string(said, '$.k')::BIGINT END AS k FROM t""")
def output_kinds(s, d):
    """Every event's properties as a model's output, whole and cut or spoilt in nine ways: what it holds or why it doesn't."""
    cuts = F.posexplode(F.array(*map(F.expr, _CUTS))).alias("cut", "text")
    rows = outputs.parsed(read(s, d, "events").select("event_id", cuts), "text", "k bigint")
    return rows.select("event_id", "cut", "error_kind", "parsed.k")


@query("""WITH e AS (SELECT event_id, md5(event_id::VARCHAR) AS sha, md5(lead(event_id) OVER w::VARCHAR) AS head, md5(lead(event_id, 2) OVER w::VARCHAR) AS later, md5(lag(event_id) OVER w::VARCHAR) AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT *, CASE WHEN event_id % 13 = 0 THEN sha ELSE head END AS green, CASE WHEN event_id % 7 = 0 THEN 'reverts ' || coalesce(head, '') WHEN event_id % 7 = 1 THEN 'see ' || sha ELSE 'tidy' END AS message, CASE WHEN event_id % 11 = 0 THEN [before, later] ELSE [before] END AS window_ FROM e),
f AS (SELECT *, list_sort(list_distinct(list_filter([green, later, head], lambda x: x IS NOT NULL AND x <> sha))) AS future FROM c)
SELECT event_id, array_to_string(list_filter(future, lambda x: contains(message, x) OR list_contains(window_, x)), ',') AS leaked FROM f""")
def record_leaks(s, d):
    """Cases made of the events, each with a nested input: which later events' hashes it tells."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    sha = lambda c: F.md5(c.cast("string").cast("binary"))
    e = F.col("event_id")
    rows = read(s, d, "events").select("event_id", sha(e).alias("sha"), sha(F.lead("event_id").over(w)).alias("head"), sha(F.lead("event_id", 2).over(w)).alias("later"), sha(F.lag("event_id").over(w)).alias("before"))
    green = F.when(e % 13 == 0, F.col("sha")).otherwise(F.col("head"))
    message = F.when(e % 7 == 0, F.concat(F.lit("reverts "), F.coalesce("head", F.lit("")))).when(e % 7 == 1, F.concat(F.lit("see "), F.col("sha"))).otherwise("tidy")
    window = F.when(e % 11 == 0, F.array("before", "later")).otherwise(F.array("before"))
    seen = F.struct(F.struct("sha", message.alias("message")).alias("failed_commit"), F.struct(window.alias("commits")).alias("breaking_window"))
    cases = rows.select("event_id", "sha", green.alias("green"), F.array("later", "head").alias("commits"), seen.alias("input"))
    return evaluation.leaked(cases, "input", ["green", "commits"], "sha").select("event_id", F.array_join("leaked", ",").alias("leaked"))
