"""Which files a failure points at: three weighted sources merged by path, and the nearest of a set of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import patterns as P

#: Query vectors that one pass over the rows takes along; queries, and rows, whose similarities are held at once.
BLOCK, TILE = 4096, 1024


def suspects(log: DataFrame, changed: DataFrame, tests: DataFrame, key: str, top: int = P.MAX_SUSPECTS) -> DataFrame:
    """key, rank, path, score, reasons of the `top` most suspicious paths of each key.

    log: key, pos, path that the log names, the earlier the more it weighs. changed: key, pos, path, lines. tests: key,
    path of failing tests, which only add to paths that one of the others names. Documentation is left out. Scores are
    summed as whole thousandths, so ties are ties; they go to what was seen first, the log before the change.
    """
    named = log.where(~F.col("path").rlike(P.DOC_PATH)).groupBy(key, "path").agg(F.min("pos").alias("pos"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("pos", "path")) - 1
    named = named.select(key, "path", F.lit(0).alias("source"), place.alias("pos"), (P.LOG_POINTS - P.LOG_DECAY * F.least(place, F.lit(10))).alias("points"))
    edits = changed.where(~F.col("path").rlike(P.DOC_PATH)).groupBy(key, "path").agg(F.min("pos").alias("pos"), F.sum("lines").alias("lines"))
    size = F.least(F.coalesce("lines", F.lit(0)), F.lit(50)).cast("int") * P.SIZE_POINTS
    edits = edits.select(key, "path", F.lit(1).alias("source"), F.col("pos").cast("int").alias("pos"), (P.CHANGE_POINTS + size).alias("points"))
    failing = tests.select(key, F.split("path", "::")[0].alias("path")).distinct().select(key, "path", F.lit(2).alias("source"), F.lit(0).alias("pos"), F.lit(P.TEST_POINTS).alias("points"))
    every = named.unionByName(edits).unionByName(failing)
    merged = every.groupBy(key, "path").agg(F.sum("points").alias("points"), F.min(F.struct("source", "pos")).alias("first"), F.sort_array(F.collect_set("source")).alias("sources"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("points"), "first", "path"))
    ranked = merged.where("first.source < 2").withColumn("rank", rank).where(F.col("rank") <= top)
    why = F.transform("sources", lambda k: F.element_at(F.array(*map(F.lit, P.SUSPECT_REASONS)), k + 1))
    return ranked.select(key, "rank", "path", (F.col("points") / 1000).alias("score"), F.array_join(why, ",").alias("reasons"))


def _best(ids: np.ndarray, value: np.ndarray, mine: np.ndarray, label: np.ndarray, held: tuple, k: int) -> None:
    """Puts the k best of what is held of each query (similarity, id, label; empty places at -inf) and of these rows into their places.

    Equal similarities go to the smaller id. Rows below a query's k-th similarity are left out before anything is sorted.
    """
    floor = held[0][:, -1]
    if len(mine) > k:
        floor = np.maximum(floor, np.partition(value, -k, axis=1)[:, -k])
    query, row = np.nonzero((value >= floor[:, None]) & np.isfinite(value))
    line = np.concatenate([np.repeat(np.arange(len(ids)), k), query])
    every = [np.concatenate([h.ravel(), x]) for h, x in zip(held, (value[query, row], mine[row], label[row]), strict=True)]
    order = np.lexsort((every[1], -every[0], line))
    line = line[order]
    # a query has k places at least among the rows, those that are empty come last
    first = order[np.arange(len(line)) - np.searchsorted(line, np.arange(len(ids)))[line] < k]
    for h, x in zip(held, every, strict=True):
        h[:] = x[first].reshape(h.shape)


def _nearest(block_of, k: int, tile: int):
    """Rows of query, similarity, id, label: the k nearest of a task's rows to each query. At most tile rows meet tile queries at once."""

    def run(batches):
        ids, vectors = block_of.value
        held = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k))
        for batch in batches:
            for lo in range(0, batch.num_rows, tile):
                part = batch.slice(lo, tile)
                mine, label = part.column("id").to_numpy(), part.column("label").cast(pa.float64()).to_numpy(zero_copy_only=False)
                x = np.array(part.column("vector").to_pylist(), np.float64)
                x /= np.maximum(1e-300, np.linalg.norm(x, axis=1, keepdims=True))
                for q in range(0, len(ids), tile):
                    at = slice(q, q + tile)
                    near = np.where(ids[at, None] == mine, -np.inf, np.round(vectors[at] @ x.T, 9))
                    _best(ids[at], near, mine, label, tuple(h[at] for h in held), k)
        query, place = np.nonzero(np.isfinite(held[0]))
        value, near_id, label = (h[query, place] for h in held)
        yield pa.record_batch([pa.array(ids[query]), pa.array(value), pa.array(near_id), pa.array(label, mask=np.isnan(label)).cast(pa.int32())], names=["query", "similarity", "id", "label"])

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """query, rank, id, label, similarity: of each query (id, vector) the k nearest of all rows (id, vector, label) but itself.

    Exact: a pass over the rows for each block of queries keeps the k best of each task, the last ranking those of all.
    """
    spark, parts = rows.sparkSession, max(1, -(-queries.count() // block))
    found = None
    for part in range(parts):
        held = queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).select("id", "vector").toArrow()
        vectors = np.array(held.column("vector").to_pylist(), np.float64).reshape(held.num_rows, -1)
        vectors /= np.maximum(1e-300, np.linalg.norm(vectors, axis=1, keepdims=True))
        mine = rows.select("id", "vector", "label").mapInArrow(_nearest(spark.sparkContext.broadcast((held.column("id").to_numpy(), vectors)), k, TILE), "query bigint, similarity double, id bigint, label int")
        found = mine if found is None else found.unionAll(mine)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "id", "label", "similarity")
