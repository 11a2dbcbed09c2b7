"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash of their ids and queue up; a document's virtual finish time is the
number of words its source has sent when it ends, divided by the source's target. Documents leave in the order of
these times until the budget is used up. A source whose target exceeds its size queues its documents a second time.
Running sums go in two steps, over hash buckets and inside each, so no source is ever sorted in one task. Texts are
read once, for their sizes, and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import Scratch, aliased

WEIGHTS = (5, 2, 1)
SHARE, REPEATS = 1.5, 2
#: Words, as the size of a document counts them.
WORD = r"[^\x20\x09-\x0D]+"
#: Bins of virtual time that are counted at once; entries that are put in order in one task, at most.
BINS, AT_ONCE = 4096, 100_000
#: The order in which entries leave.
ORDER = ("end", "k", "rank", "tag", "doc_id", "size")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """sizes (source, source_size) with rank, weight and target.

    The level at which targets, weight times level, stop at their caps: sources fill up in the order of cap by weight;
    the first one that its share of what is left doesn't fill gives the level. There is one row per source here, so
    the windows over all of them are small.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", w.cast("double"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    everywhere = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped = ranked.withColumn("cap", (F.col("source_size") * repeats).cast("double"))
    level = (F.lit(share) * F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    leveled = capped.withColumn("level", level).withColumn("place", F.row_number().over(fill))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))
    final = leveled.withColumn("final", F.min(fits).over(everywhere)["level"])
    return final.select("source", "source_size", "rank", F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap"))).alias("target"))


def _size(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def _tag(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))


def _cut(entries: DataFrame, budget: float):
    """The end before which all entries leave, and the last entry that leaves at it or later; (None, None) if all leave.

    Entries are counted in bins of their ends, then those of the bin in which the budget runs out in finer bins, until
    they are few: only these are put in order. Entries that agree in all (repeated rows) are one.
    """
    part, sent, lo = entries, 0, 0.0
    found = part.agg(F.max("end").alias("hi"), F.count("*").alias("rows"), F.sum("size").alias("words")).first()
    hi, rows = found.hi, found.rows
    if not rows or found.words <= budget:
        return None, None
    while rows > AT_ONCE and lo < hi:
        place = F.least(F.floor((F.col("end") - lo) / (hi - lo) * BINS), F.lit(BINS))
        bins = part.groupBy(place.alias("bin")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"), F.min("end").alias("lo"), F.max("end").alias("hi"))
        # as many rows as there are bins
        for one in bins.orderBy("bin").collect():
            if sent + one.words > budget:
                break
            sent += one.words
        lo, hi, rows = one.lo, one.hi, one.rows
        part = entries.where(F.col("end").between(lo, hi))
    few = part.groupBy(*ORDER).agg(F.sum("size").alias("words"))
    inside = few.withColumn("upto", F.sum("words").over(Window.orderBy(*ORDER)) + sent)
    return lo, inside.where(F.col("upto") <= budget).orderBy(*[F.desc(c) for c in ORDER]).select(*ORDER).first()


def _queues(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, weights: tuple, share: float, repeats: int, scratch: Scratch) -> tuple[DataFrame, list[Column]]:
    """A row per document in the queue of its source, and of each round through the queue the condition that it leaves."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _size(text_col).alias("size"), _tag(id_col, seed).alias("tag"))
    sized = scratch.keep(sized, "sized")
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats)
    plan = scratch.keep(plan, "plan")
    budget = plan.agg(F.sum("target")).first()[0] or 0.0
    # a row for each source: joined as a broadcast only if Spark finds it small when it runs
    joined = sized.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("bucket", F.substring("tag", 1, 3))
    sums = joined.groupBy("rank", "bucket").agg(F.sum("size").alias("b"))
    earlier = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("rank", "bucket", F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("sent"))
    queue = Window.partitionBy("rank", "bucket").orderBy("tag", "doc_id", "size")
    queued = joined.join(sums, ["rank", "bucket"]).withColumn("sent", F.col("sent") + F.sum("size").over(queue))
    for k in range(repeats):
        end = (F.col("sent") + k * F.col("source_size")) / F.col("target")
        queued = queued.withColumn(f"end{k}", F.when((F.col("size") > 0) & (F.col("target") > (k * F.col("source_size"))), end))
    queued = scratch.keep(queued.select("doc_id", "source", "size", "source_size", "target", "rank", "tag", *[f"end{k}" for k in range(repeats)]), "queued")

    def place(k: int) -> Column:
        return F.struct(F.col(f"end{k}").alias("end"), F.lit(k).alias("k"), "rank", "tag", F.coalesce("doc_id", F.lit(None)).alias("doc_id"), "size")

    entries = queued.select(F.explode(F.array(*[place(k) for k in range(repeats)])).alias("e")).select("e.*").where("end is not null")
    before, last = _cut(entries, budget)

    def leaves(k: int) -> Column:
        end = F.col(f"end{k}")
        if before is None:
            return end.isNotNull()
        early = end < before
        if last is None:
            return early
        marks = [(end, last["end"]), (F.lit(k), last["k"]), (F.col("rank"), last["rank"]), (F.col("tag"), last["tag"]), (F.col("doc_id"), last["doc_id"]), (F.col("size"), last["size"])]
        upto = F.lit(True)
        for mine, its in reversed(marks):
            upto = upto if its is None else (mine < F.lit(its)) | ((mine == F.lit(its)) & upto)
        return early | upto

    return queued, [F.coalesce(leaves(k), F.lit(False)) for k in range(repeats)]


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words that the mix takes, repeats counted) of each document.

    Null and empty texts have size 0 and are never taken; a null source is a source of its own, the last. Rows that
    repeat (same id, source and size) leave together or not at all, so that reruns agree whatever the row order. An
    empty table gives no rows. Other columns are left out.
    """
    queued, leave = _queues(docs, id_col, text_col, source_col, seed, weights, share, repeats, Scratch(docs.sparkSession, "mix"))
    taken = sum((F.when(one, F.col("size")).otherwise(F.lit(0)) for one in leave), F.lit(0))
    return queued.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "tag")


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """The documents that the mix takes, with their columns, and taken: their words in it, repeats counted.

    What leaves of a queue is its beginning, so that a source's last document that leaves, one for each round, tells
    which of its rows leave, and the documents themselves are not shuffled. A column taken of the documents' own is left
    out.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    queued, leave = _queues(docs, id_col, text_col, source_col, seed, weights, share, repeats, scratch)
    at = F.struct("tag", F.coalesce("doc_id", F.lit(None)).alias("doc_id"), "size")
    lasts = queued.groupBy(F.col("source").alias("__source")).agg(*[F.max(F.when(one, at)).alias(f"__last{k}") for k, one in enumerate(leave)])
    lasts = scratch.hint(scratch.keep(lasts, "lasts"), "lasts")
    inner, back = aliased(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "taken"]), {id_col, text_col, source_col})
    sized = inner.withColumn("__size", _size(text_col)).where("__size > 0")
    here = F.struct(_tag(id_col, seed).alias("tag"), F.coalesce(F.col(id_col), F.lit(None)).alias("doc_id"), F.col("__size").alias("size"))
    taken = sum((F.when(here <= F.col(f"__last{k}"), F.col("__size")).otherwise(F.lit(0)) for k in range(repeats)), F.lit(0)).cast("long")
    rows = sized.join(lasts, F.col(source_col).eqNullSafe(F.col("__source"))).withColumn("__taken", taken).where("__taken > 0")
    return rows.select(*back, F.col("__taken").alias("taken"))


def op8(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':7') AS tag
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         (sum(size) * 2)::DOUBLE AS cap
  FROM sized GROUP BY source),
levels AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY cap / weight, rank) AS place
  FROM sources),
plan AS (
  SELECT source, source_size, rank, least(cap, (SELECT min_by(level, place) FROM levels WHERE level * weight <= cap) * weight) AS target FROM levels),
queued AS (
  SELECT doc_id, size, tag, source_size, rank, target,
         sum(size) OVER (PARTITION BY p.rank ORDER BY tag, doc_id, size)::BIGINT AS sent
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
entries AS (
  SELECT *, k, (sent + k * source_size) / target AS ends FROM queued, (VALUES (0), (1)) AS v(k)
  WHERE size > 0 AND target > k * source_size),
left_ AS (
  SELECT doc_id, tag, rank, size, CASE WHEN sum(size) OVER (ORDER BY ends, k, rank, tag, doc_id, size) <= (SELECT sum(target) FROM plan) THEN size ELSE 0 END AS t
  FROM entries)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(sum(t), 0)::BIGINT AS taken
FROM queued q LEFT JOIN left_ l ON q.doc_id = l.doc_id AND q.rank = l.rank
GROUP BY q.doc_id, q.size, q.source_size, q.target
"""
