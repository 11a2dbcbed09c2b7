"""Queries on evaluations: nearest labels, rates by status, who is scored, and why."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions import patterns as P
from faultline.operators import evaluation, localize, scoring
from faultline.plans import derived as D
from faultline.plans import inline as I
from faultline.plans.registry import query, read

# of every fiftieth vector, the five nearest of all others by cosine
_NEAR = """q AS (SELECT vec_id, embedding, label FROM embeddings WHERE vec_id % 50 = 0),
n AS (SELECT q.vec_id, q.label AS gold, e.label, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS sim, row_number() OVER (PARTITION BY q.vec_id ORDER BY sim DESC, e.vec_id) AS rank FROM q JOIN embeddings e ON e.vec_id <> q.vec_id QUALIFY rank <= 5),
s AS (SELECT vec_id, min(rank) FILTER (label = gold) AS first FROM n GROUP BY 1)"""


def _scored(s, d):
    rows = read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    near = localize.nearest(rows, rows.where("id % 50 = 0"), 5)
    answers = near.groupBy(F.col("query").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "label"))).alias("ranked"))
    gold = rows.where("id % 50 = 0").select(F.col("id").alias("vec_id"), F.array("label").alias("gold"))
    return answers.join(gold, "vec_id").select("vec_id", "gold", F.transform("ranked", lambda x: x["label"]).alias("answers"))


@query(f"WITH {_NEAR} SELECT vec_id, (coalesce(first, 9) <= 1)::INT AS hit1, (coalesce(first, 9) <= 3)::INT AS hit3, round(coalesce(1 / first, 0), 6) AS reciprocal, (first IS NOT NULL)::INT::DOUBLE AS recall5 FROM s")
def localization_scores(s, d):
    return scoring.rankings(_scored(s, d), "vec_id", "gold", "answers")


_BOUND = lambda h, sign, of: f"round({of}((({h} / n) + 3.8416 / (2 * n)) / (1 + 3.8416 / n) {sign} 1.96 * sqrt(({h} / n) * (1 - {h} / n) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n), {'0' if of == 'greatest' else '1'}.0), 3)"
_RATE = lambda k: f"hits{k}, round(hits{k} / n, 3) AS rate{k}, {_BOUND(f'hits{k}', '-', 'greatest')} AS low{k}, {_BOUND(f'hits{k}', '+', 'least')} AS high{k}"


@query(f"""WITH {_NEAR}, t AS (SELECT count(*) AS n, count(*) FILTER (first = 1) AS hits1, count(*) FILTER (first <= 3) AS hits3, round(avg(coalesce(1 / first, 0)), 3) AS mrr, round(avg((first IS NOT NULL)::INT), 3) AS recall5 FROM s)
SELECT n, mrr, recall5, {_RATE(1)}, {_RATE(3)} FROM t""")
def localization_summary(s, d):
    return evaluation.summary(localization_scores(s, d))


@query(f"""WITH {_NEAR}, b AS (SELECT CASE WHEN first = 1 THEN 'hit' WHEN first <= 3 THEN 'reasoning' WHEN first <= 5 THEN 'name_only' WHEN (SELECT count(*) FROM embeddings e JOIN q ON q.vec_id = s.vec_id WHERE e.label = q.label AND e.vec_id <> q.vec_id) > 0 THEN 'blind' ELSE 'impossible' END AS bucket FROM s),
t AS (SELECT count(*) AS total, count(*) FILTER (bucket IN ('name_only', 'blind')) AS reach, count(*) FILTER (bucket = 'hit') AS hits FROM b)
SELECT v.bucket, coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) / total, 3) AS share, round(reach / total, 3) AS reachable_share, round((hits + reach) / total, 3) AS ceiling FROM {I.values([(b,) for b in P.BUCKETS], 'bucket')} LEFT JOIN (SELECT bucket, count(*) AS n FROM b GROUP BY 1) c ON c.bucket = v.bucket, t""")
def headroom_buckets(s, d):
    labels = read(s, d, "embeddings").groupBy(F.array("label").alias("gold")).agg(F.count("*").alias("with_label"))
    rows = _scored(s, d).join(labels, "gold")
    first = lambda k: F.slice("answers", 1, k)
    there = F.when(F.col("with_label") > 1, F.col("gold")).otherwise(F.array().cast("array<int>"))
    return evaluation.bucket_counts(rows.withColumn("bucket", evaluation.bucket(F.col("gold"), F.col("answers"), first(5), first(3), there)), "bucket")


_MISSES = {"g": "concat(event_type, ',b')", "p": D.pick(0, "view", "click", "error", "c", ""), "v": D.pick(1, "view", "error,purchase", "b", "c", ""), "c": D.pick(2, "view", "error,b", "c", ""), "e": D.pick(3, "b", "error", "")}


@query(f"""WITH t AS (SELECT id, string_split(g, ',') AS g, string_split(p, ',') AS p, string_split(v, ',') AS v, string_split(c, ',') AS c, string_split(e, ',') AS e FROM (SELECT event_id AS id, {D.columns(_MISSES)} FROM events))
SELECT id, CASE WHEN list_contains(g, p[1]) THEN 'hit' WHEN len(list_intersect(list_intersect(g, v), c)) > 0 THEN 'reasoning' WHEN len(list_intersect(g, v)) > 0 THEN 'name_only' WHEN len(list_intersect(g, e)) > 0 THEN 'blind' ELSE 'impossible' END AS bucket FROM t""")
def headroom_classify(s, d):
    return D.events_with(s, d, _MISSES).select("id", evaluation.bucket(*[F.split(c, ",") for c in "gpvce"]).alias("bucket"))


_FIXED = {"status": D.pick(0, "matched", "matched", "matched", "ambiguous", None), "category": D.pick(1, "TYPE_ERROR", "TEST_FAILURE", *P.NON_CODE_CATEGORIES), "files": "CASE user_id % 3 WHEN 0 THEN concat('src/', event_type, '.py,docs/x.md') WHEN 1 THEN 'docs/x.md,README.md' ELSE concat('src/b.py,src/', event_type, '.py,src/b.py') END"}
_NON_CODE = "'" + "', '".join(P.NON_CODE_CATEGORIES) + "'"


@query(f"""WITH t AS (SELECT id, status, category, list_distinct(list_filter(string_split(files, ','), lambda f: NOT regexp_matches(f, '{P.DOC_PATH}'))) AS code FROM (SELECT event_id AS id, {D.columns(_FIXED)} FROM events)),
u AS (SELECT *, CASE WHEN status IS DISTINCT FROM 'matched' THEN 'fix_status:' || coalesce(status, 'None') WHEN category IN ({_NON_CODE}) THEN 'non_code_category:' || category WHEN len(code) = 0 THEN 'fix_changes_only_docs' ELSE 'eligible' END AS why FROM t)
SELECT id, why, CASE WHEN why = 'eligible' THEN array_to_string(list_sort(code), ',') END AS files FROM u""")
def gold_fix_files(s, d):
    files, why = evaluation.eligibility(F.col("status"), F.col("category"), F.split("files", ","))
    return D.events_with(s, d, _FIXED).select("id", why.alias("why"), F.array_join(F.sort_array(files), ",").alias("files"))


@query(f"SELECT why, count(*) AS n FROM (SELECT CASE WHEN status IS DISTINCT FROM 'matched' THEN 'fix_status:' || coalesce(status, 'None') WHEN category IN ({_NON_CODE}) THEN 'non_code_category:' || category WHEN regexp_matches(files, 'src') THEN 'eligible' ELSE 'fix_changes_only_docs' END AS why FROM (SELECT event_id AS id, {D.columns(_FIXED)} FROM events)) WHERE why <> 'eligible' GROUP BY 1")
def exclusion_reasons(s, d):
    return gold_fix_files(s, d).where("why <> 'eligible'").groupBy("why").agg(F.count("*").alias("n"))


# a document's label is its right answer; the guess goes by its length, toxic ones have none
_GUESS = "SELECT d.doc_id, lang, CASE quality WHEN 1 THEN 'TEST_FAILURE' ELSE 'UNKNOWN' END AS gold, CASE WHEN toxic = 1 THEN NULL WHEN n_chars > 300 THEN 'TEST_FAILURE' ELSE 'UNKNOWN' END AS guess FROM documents d JOIN labels l ON l.doc_id = d.doc_id"


def _guesses(s, d):
    rows = read(s, d, "documents").select("doc_id", "lang", "n_chars").join(read(s, d, "labels"), "doc_id")
    guess = F.when(F.col("toxic") == 1, F.lit(None)).when(F.col("n_chars") > 300, "TEST_FAILURE").otherwise("UNKNOWN")
    return rows.select("doc_id", "lang", F.when(F.col("quality") == 1, "TEST_FAILURE").otherwise("UNKNOWN").alias("gold"), guess.alias("guess"))


@query(f"WITH g AS ({_GUESS}), t AS (SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS status, count(*) AS n, count(*) FILTER (gold = coalesce(guess, 'ERROR')) AS hits FROM g GROUP BY ROLLUP (lang)) SELECT status, n, hits, round(hits / n, 3) AS rate, {_BOUND('hits', '-', 'greatest')} AS low, {_BOUND('hits', '+', 'least')} AS high FROM t")
def accuracy_by_status(s, d):
    return evaluation.accuracy_by(_guesses(s, d), "lang", "gold", "guess")


@query(f"WITH g AS ({_GUESS}) SELECT count(*) AS cases, count(*) FILTER (guess = 'UNKNOWN') AS abstained, round(count(*) FILTER (guess = 'UNKNOWN') / count(*), 3) AS rate FROM g")
def abstention_rate(s, d):
    return evaluation.abstention(_guesses(s, d), "guess")


@query("SELECT lang, source, count(*) AS n, grouping(lang, source)::INT AS level FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source))")
def stats_grouping_sets(s, d):
    docs = read(s, d, "documents")
    return docs.groupingSets([[docs.lang], [docs.source], [docs.lang, docs.source]], docs.lang, docs.source).agg(F.count("*").alias("n"), F.grouping_id("lang", "source").cast("int").alias("level"))


@query("SELECT l.doc_id, quality, 'one' AS system, lang FROM labels l JOIN documents d ON d.doc_id = l.doc_id")
def scored_predictions(s, d):
    predictions = read(s, d, "documents").select("doc_id", F.lit("one").alias("system"), "lang")
    return evaluation.with_predictions(read(s, d, "labels").select("doc_id", "quality"), predictions, "doc_id")


@query("SELECT d.doc_id, lang FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def select_cases(s, d):
    return evaluation.selected(read(s, d, "documents").select("doc_id", "lang"), read(s, d, "labels").where("toxic = 1").select("doc_id"), "doc_id")


@query("SELECT 'unlabelled' AS what, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'unknown', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def unknown_ids(s, d):
    docs, labels = (read(s, d, t).select("doc_id") for t in ("documents", "labels"))
    return docs.join(labels, "doc_id", "left_anti").select(F.lit("unlabelled").alias("what"), "doc_id").unionAll(labels.join(docs, "doc_id", "left_anti").select(F.lit("unknown"), "doc_id"))


@query("SELECT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def audit_overlap(s, d):
    return read(s, d, "labels").select("doc_id").join(read(s, d, "documents").where("lang = 'en'").select("doc_id"), "doc_id", "left_semi")


@query("SELECT count(*) AS reports, count(DISTINCT n) AS counts, count(DISTINCT n) <= 1 AS comparable FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def comparable_reports(s, d):
    return evaluation.comparable(read(s, d, "documents").groupBy(F.col("source").alias("system")).agg(F.count("*").alias("scored")))
