"""Vector code compression: product quantisation in whole numbers, the nearest entry found behind segment-mean lower bounds.

A vector of whole numbers is cut into PARTS equal parts, each with a codebook of at most ENTRIES entries. For a part x and
an entry c, cut into equal blocks, the sum over blocks of size * (mean x - mean c)^2 + (|x - mean x| - |c - mean c|)^2 is
never more than their squared distance. It is taken over one block first, then over two, four and so on: an entry goes
once its bound exceeds the exact distance of the entry with the least first bound, ties never. The entries that are left
get exact whole-number distances.

A round is one pass over the vectors with the codebooks broadcast (ENTRIES vectors, whatever the table); tasks return sums
and counts of each entry, a row for each, which are added up exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import Scratch
from faultline.llm.projections import finite

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components are held within these bounds, so that distances of vectors of up to 64 components are exact longs.
MOST = 1 << 27
#: Rows that are compared at once.
ROWS = 4096


def shapes(x: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Block size, block means and norms of what is left of the blocks, from one block on to more and smaller ones."""
    out, n = [], x.shape[-1]
    blocks = 1
    while n % blocks == 0 and (blocks == 1 or n // blocks > 1):
        cut = x.reshape(*x.shape[:-1], blocks, n // blocks).astype(np.float64)
        mean = cut.mean(axis=-1)
        out.append((n // blocks, mean, np.sqrt(((cut - mean[..., None]) ** 2).sum(axis=-1))))
        blocks *= 2
    return out


def bound(size: int, mean, rest, entry_mean, entry_rest) -> np.ndarray:
    """No more than the squared distance: the margin covers the rounding of means and norms."""
    terms = size * (mean - entry_mean) ** 2 + (rest - entry_rest) ** 2
    return terms.sum(axis=-1) * (1 - 1e-9) - 1e-3


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of the nearest entry (ties: the lower one), its squared distance, and how many exact distances that took."""
    n, levels, entries = len(x), shapes(x), shapes(book)
    (size, mean, rest), (_, entry_mean, entry_rest) = levels[0], entries[0]
    low = bound(size, mean[:, None], rest[:, None], entry_mean[None], entry_rest[None])
    first = low.argmin(axis=1)
    most = ((x - book[first]) ** 2).sum(axis=1)
    row, entry = np.nonzero(low <= most[:, None])
    for (size, mean, rest), (_, entry_mean, entry_rest) in zip(levels[1:], entries[1:], strict=True):
        left = bound(size, mean[row], rest[row], entry_mean[entry], entry_rest[entry]) <= most[row]
        row, entry = row[left], entry[left]
    found = np.full((n, len(book)), np.iinfo(np.int64).max)
    found[row, entry] = ((x[row] - book[entry]) ** 2).sum(axis=1)
    best = found.argmin(axis=1)
    return best, found[np.arange(n), best], len(row)


def _vectors(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """The batch's vectors, all of length d: rows by components."""
    column = batch.column("x")
    return column.flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, d)


def _sums(books: np.ndarray):
    parts, entries, width = books.shape

    def run(batches):
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = _vectors(batch, parts * width)
            for lo in range(0, len(x), ROWS):
                for p in range(parts):
                    mine = x[lo : lo + ROWS, p * width : (p + 1) * width]
                    best, _, _ = nearest(mine, books[p])
                    np.add.at(total[p], best, mine)
                    count[p] += np.bincount(best, minlength=entries)
        p, e = np.nonzero(count)
        lists = pa.ListArray.from_arrays(np.arange(0, len(p) * width + 1, width, dtype=np.int32), pa.array(total[p, e].ravel()))
        yield pa.record_batch([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), lists], names=["part", "entry", "n", "total"])

    return run


def _codes(books: np.ndarray):
    parts, _, width = books.shape

    def run(batches):
        for batch in batches:
            x = _vectors(batch, parts * width)
            code, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for lo in range(0, len(x), ROWS):
                for p in range(parts):
                    best, far, _ = nearest(x[lo : lo + ROWS, p * width : (p + 1) * width], books[p])
                    code[lo : lo + ROWS, p] = best
                    error[lo : lo + ROWS] += far
            text = code.tobytes().hex()
            codes = [text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)]
            yield pa.record_batch([batch.column("id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    return run


def whole_vectors(rows: DataFrame, vector: str, scale: int = SCALE) -> DataFrame:
    """rows with a vector of finite components, and it in whole numbers as x."""
    x = F.transform(vector, lambda v: F.greatest(F.least(F.floor(v.cast("double") * scale), F.lit(MOST)), F.lit(-MOST)).cast("int"))
    return rows.where(finite(vector)).withColumn("x", x)


def train(kept: DataFrame, first: list[list[int]], parts: int = PARTS, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks, parts by entries by components, after so many rounds over x of kept, from these first vectors on."""
    start = np.array(first, np.int64)
    books = start.reshape(len(start), parts, -1).transpose(1, 0, 2).copy()
    width = books.shape[2]
    for _ in range(rounds):
        found = kept.select("x").mapInArrow(_sums(books), "part int, entry int, n bigint, total array<bigint>")
        # at most parts * entries rows of a codebook's width come back, whatever the table
        sums = [F.sum(F.col("total")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)]
        for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():
            books[r.part, r.entry] = [int(r[f"s{k}"]) // r.n for k in range(width)]
    return books


def compress(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """id, label, code, error of every vector that is kept, and the codebooks.

    Vectors that are null, empty or hold null or non-finite components are dropped, and so are those whose length isn't
    that of the kept vector with the smallest id, or can't be cut into equal parts. Components beyond MOST (32,768 before
    scaling) are held there. Among rows of equal ids the smaller vector comes first; null ids are the last. Rows that
    repeat count each. With fewer vectors than entries the codebooks are smaller; an empty table has none.
    """
    scratch = Scratch(rows.sparkSession, "codes")
    named = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    kept = scratch.keep(whole_vectors(named, "vector").where(F.size("x") % parts == 0).select("id", "x", "label"), "whole")
    order = [F.asc_nulls_last("id"), F.asc("x")]
    top = kept.orderBy(*order).select(F.size("x").alias("d")).first()
    if top is None:
        return kept.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    kept = kept.where(F.size("x") == top.d)
    first = [list(r.x) for r in kept.orderBy(*order).select("x").limit(entries).collect()]
    books = train(kept, first, parts, rounds)
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    return kept.mapInArrow(_codes(books), f"id {kinds['id']}, label {kinds['label']}, code string, error bigint"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op12(vectors: DataFrame) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256. An empty table gives no rows."""
    scratch = Scratch(vectors.sparkSession, "coded")
    coded, books = compress(vectors)
    coded = scratch.keep(coded, "coded")
    # a row for each label; the vectors of a frequent label are summed up before they are dealt out by it
    labels = scratch.keep(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    sums = scratch.hint(labels.withColumnRenamed("label", "l"), "labels")
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("l")))
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds one after the other, by plain distances to every entry."""
    ctes = ["""kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """cut AS MATERIALIZED (
  SELECT vec_id, label, part, x[part * (len(x) // 8) + 1 : (part + 1) * (len(x) // 8)] AS p FROM kept, range(8) AS r(part))""",
        """book0 AS MATERIALIZED (
  SELECT part, k AS entry, p AS c FROM cut JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept) USING (vec_id) WHERE k < 16)"""]
    distance = "list_sum(list_transform(list_zip(p, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for k in range(ROUNDS + 1):
        ctes.append(f"""near{k} AS MATERIALIZED (
  SELECT vec_id, label, part, p, min(struct_pack(d := {distance}, e := entry)) AS best
  FROM cut JOIN book{k} USING (part) GROUP BY vec_id, label, part, p)""")
        if k < ROUNDS:
            ctes.append(f"""sum{k} AS (
  SELECT part, entry, i, s, n FROM (
    SELECT part, best.e AS entry, i, sum(p[i])::BIGINT AS s, count(*) AS n FROM near{k}, range(1, 4096) AS r(i) WHERE i <= len(p) GROUP BY ALL))""")
            ctes.append(f"""book{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN (
    SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM sum{k} GROUP BY part, entry) m ON b.part = m.part AND b.entry = m.entry)""")
    return f"""
WITH {", ".join(ctes)},
coded AS (SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM near{ROUNDS} GROUP BY vec_id, label),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, book
"""


OP12_SQL = _sql()
