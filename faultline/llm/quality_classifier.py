"""Quality by the votes of nearest neighbours in a latent-semantic space.

Terms of a text are its words, the shapes of its tokens (runs of small letters, capitals, digits and signs), the lengths
of its words, and how many words and lines repeat. A bounded sample of labelled texts is weighted by inverse document
frequency and decomposed; its vectors, with their labels, travel to all tasks. Every text is folded into the same space
and held against all of the sample's vectors, block by block; the nearest vote with their similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import ALNUM, INK, LOWER, Words, chunks, id_mod, in_batches, prefix_hash, span_hash
from faultline.llm.quality_rules import duplicate_lines

#: Labelled texts that the space is built from and that vote, at most: it bounds what travels and what the driver holds.
SAMPLE = 4000
WORD_TERMS, SHAPE_TERMS, LENGTHS = 4096, 2048, 24
TERMS = WORD_TERMS + SHAPE_TERMS + LENGTHS + 2
DIMENSIONS, NEIGHBOURS = 48, 15
THRESHOLD = 0.7

_SHAPE = LOWER.copy()
_SHAPE[97:123] = _SHAPE[0x80:] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("0")


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and number of occurrences, by row and term."""
    w, t = Words(LOWER[data], offsets, ALNUM), Words(data, offsets, INK)
    shaped = _SHAPE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = shaped[1:] != shaped[:-1]
    keep[t.start] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    shape = span_hash(prefix_hash(shaped[keep]), kept[t.start], kept[t.end])
    again = np.zeros(len(t.hash), bool)
    again[1:] = (t.hash[1:] == t.hash[:-1]) & (t.row[1:] == t.row[:-1])
    row = [w.row, t.row, w.row, t.row[again]]
    term = [
        (w.hash % np.uint64(WORD_TERMS)).astype(np.int64),
        WORD_TERMS + (shape % np.uint64(SHAPE_TERMS)).astype(np.int64),
        WORD_TERMS + SHAPE_TERMS + np.minimum(w.end - w.start, LENGTHS) - 1,
        np.full(int(again.sum()), TERMS - 2),
    ]
    key, n = np.unique(np.concatenate(row) * TERMS + np.concatenate(term), return_counts=True)
    lines = duplicate_lines(data, offsets, t)
    key = np.concatenate([key, np.flatnonzero(lines) * TERMS + TERMS - 1])
    n = np.concatenate([n, 20 * lines[lines > 0]])
    order = np.argsort(key, kind="stable")
    return key[order] // TERMS, key[order] % TERMS, n[order]


class Space:
    """The sample's directions and vectors, and their labels."""

    def __init__(self, texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dimensions: int):
        n = len(texts)
        seen = np.bincount(np.concatenate([t for t, _ in texts]) if n else np.zeros(0, np.int64), minlength=TERMS)
        self.idf = np.log((1 + n) / (1 + seen)).astype(np.float32) + 1
        a = np.zeros((n, TERMS), np.float32)
        for k, (t, count) in enumerate(texts):
            a[k, t] = np.sqrt(count) * self.idf[t]
        a /= np.maximum(1e-9, np.linalg.norm(a, axis=1, keepdims=True))
        k = min(dimensions + 16, n, TERMS)
        found = np.random.default_rng(5).standard_normal((TERMS, k)).astype(np.float32)
        for _ in range(4):  # subspace iteration towards the leading right singular vectors
            found, _ = np.linalg.qr(a.T @ (a @ found)) if n else (found, None)
        _, _, v = np.linalg.svd(a @ found, full_matrices=False) if n else (None, None, np.eye(k))
        self.directions = np.ascontiguousarray((found @ v.T)[:, :dimensions].astype(np.float32))
        self.vectors = unit(a @ self.directions).T.copy()
        self.labels = labels.astype(np.float32)

    def fold(self, row, term, count, rows: int) -> np.ndarray:
        out = np.zeros((rows, self.directions.shape[1]), np.float32)
        if len(row):
            value = np.sqrt(count).astype(np.float32) * self.idf[term]
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            out[row[first]] = np.add.reduceat(value[:, None] * self.directions[term], first, axis=0)
        return unit(out)

    def vote(self, vectors: np.ndarray, neighbours: int) -> np.ndarray:
        """The similarity-weighted mean label of the nearest vectors; of a text unlike all of them, the mean label."""
        n = len(self.labels)
        if not n:
            return np.full(len(vectors), 0.5)
        near = vectors @ self.vectors
        k = min(neighbours, n)
        best = np.argpartition(near, n - k, axis=1)[:, n - k :]
        weight = np.maximum(0, np.take_along_axis(near, best, axis=1)).astype(np.float64)
        total = weight.sum(1)
        voted = (weight * self.labels[best]).sum(1) / np.where(total > 0, total, 1)
        return np.clip(np.where(total > 0, voted, self.labels.mean()), 0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))


def _terms(batches):
    for batch in batches:
        for lo, hi, data, offsets in chunks(batch.column("text")):
            row, term, n = terms(data, offsets)
            cut = np.searchsorted(row, np.arange(hi - lo + 1))
            pairs = [(term[a:b].astype(np.int32).tobytes(), n[a:b].astype(np.int64).tobytes()) for a, b in zip(cut, cut[1:], strict=False)]
            yield pa.record_batch([batch.column("label").slice(lo, hi - lo), pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], names=["label", "terms", "counts"])


def _score(space_of, neighbours: int):
    def run(batches):
        space = space_of.value
        for batch in batches:
            scores = [np.zeros(0)]
            for lo, hi, data, offsets in chunks(batch.column("text")):
                vectors = space.fold(*terms(data, offsets), hi - lo)
                scores += [space.vote(vectors[k : k + 256], neighbours) for k in range(0, hi - lo, 256)]
            yield pa.record_batch([batch.column("id"), pa.array(np.concatenate(scores))], names=["id", "score"])

    return run


def sample_labels(labels: DataFrame, id_col: str, label_col: str, learn, most: int) -> DataFrame:
    """id, label of the labelled rows to learn from: the `most` of smallest hash, or all."""
    rows = labels.where(learn & F.col(label_col).isNotNull()).select(F.col(id_col).alias("sampled"), F.col(label_col).cast("double").alias("label"))
    return rows.orderBy(F.xxhash64("sampled", F.lit(11)), "sampled", "label").limit(most)


def classify_quality(docs: DataFrame, labels: DataFrame, *, learn, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS) -> DataFrame:
    """id and score, 0 to 1, of each row: how likely its label is 1.

    learn: a condition on the rows of labels; only those teach, at most `sample` of them. Null and empty texts have no
    terms and get the sample's mean label; without labelled texts all get 0.5. Rows that repeat get equal scores; ids
    may be null. Other columns are left out. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    taught = rows.join(F.broadcast(sample_labels(labels, id_col, label_col, learn, sample)), F.col("id") == F.col("sampled"))
    # of texts that share an id one teaches, so that no more come back than were sampled
    taught = taught.groupBy("sampled", "label").agg(F.min("text").alias("text"))
    found = taught.transform(in_batches).mapInArrow(_terms, "label double, terms binary, counts binary").toArrow().to_pylist()
    found = sorted(found, key=lambda r: (r["terms"], r["counts"], r["label"]))
    texts = [(np.frombuffer(r["terms"], np.int32), np.frombuffer(r["counts"], np.int64)) for r in found]
    space = spark.sparkContext.broadcast(Space(texts, np.array([r["label"] for r in found]), dimensions))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.transform(in_batches).mapInArrow(_score(space, neighbours), f"id {kind}, score double").withColumnRenamed("id", id_col)


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted; labels of the held-out quarter are never looked at."""
    held = id_mod("doc_id", 4) == 2
    scored = classify_quality(docs, labels, learn=~held)
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
