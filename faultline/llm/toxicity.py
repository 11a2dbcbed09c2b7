"""Toxicity by a logistic classifier whose scores counterfactual identity terms leave alone.

Features of a text are its words and their first four and five bytes, present or not. A bounded sample of labelled texts
teaches a logistic regression over the features that tell the labels apart best. Every labelled text that names an
identity group is also taken with the group swapped for others of its kind; what the swap changes in the score is
squared and added to the loss, so that the weights of group names give way to those of what is said about them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import ALNUM, LOWER, Words, chunks, id_mod, in_batches, mix, prefix_hash, span_hash
from faultline.llm.quality_classifier import sample_labels

#: Labelled texts that teach, at most; bins of hashed features; features that get a weight, at most.
SAMPLE, BINS, CHOSEN = 10_000, 1 << 20, 2048
#: Log odds between the labels below which a feature isn't looked at.
LEAST_ODDS = 0.7
THRESHOLD = 0.7
#: Weight of the squares of the weights and of the score changes under swaps; steps of the descent.
RIDGE, COUNTERFACTUAL, STEPS = 2e-4, 1.0, 300

#: Terms of one kind; a swap stays within a kind.
IDENTITIES = (
    ("women", "men", "girls", "boys", "mujeres", "hombres", "femmes", "hommes", "frauen"),
    ("woman", "man", "girl", "boy", "mujer", "hombre", "femme", "homme", "frau"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("gay", "lesbian", "bisexual", "straight", "transgender", "queer", "heterosexual"),
    ("immigrants", "refugees", "foreigners", "natives", "migrants", "citizens"),
    ("mexicans", "americans", "germans", "french", "spaniards", "chinese", "indians", "russians", "turks", "poles"),
    ("disabled", "blind", "deaf", "elderly", "young", "old", "poor", "rich"),
)


def _bins(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Bins of the words, then of their beginnings; -1 where a word has none."""
    out = [span_hash(prefix, start, end)]
    for k, size in enumerate((4, 5)):
        h = mix(span_hash(prefix, start, np.minimum(end, start + size)) + np.uint64(k + 1))
        out.append(np.where(end - start > size, h, np.uint64(2**64 - 1)))
    return [np.where(h == np.uint64(2**64 - 1), -1, (h >> np.uint64(44)).astype(np.int64)) for h in out]


def features(data: np.ndarray, offsets: np.ndarray, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and bin of the distinct features of each row, by row; of the chosen bins only, if given as a mask."""
    w = Words(LOWER[data], offsets, ALNUM)
    keys = []
    for b in _bins(w.prefix, w.start, w.end):
        use = b >= 0
        if chosen is not None:
            use &= chosen[b]
        keys.append(w.row[use] * BINS + b[use])
    key = np.unique(np.concatenate(keys))
    return key // BINS, key % BINS


def word_bins(word: str) -> list[int]:
    data = np.frombuffer(word.encode(), np.uint8)
    return [int(b[0]) for b in _bins(prefix_hash(data), np.array([0]), np.array([len(data)])) if b[0] >= 0]


def swaps(texts: list[np.ndarray], identities: tuple = IDENTITIES) -> list[tuple[int, list[int], list[int]]]:
    """Text, features that go and features that come, for each identity term of a text and each other of its kind."""
    kinds = [[word_bins(term) for term in kind] for kind in identities]
    named = np.zeros(BINS, bool)
    named[[mine[0] for kind in kinds for mine in kind]] = True
    out = []
    for k, present in enumerate(texts):
        if not named[present].any():
            continue
        has = set(present.tolist())
        for kind in kinds:
            for mine in kind:
                if mine[0] in has:
                    gone = [b for b in mine if b in has]
                    out += [(k, gone, [b for b in theirs if b not in has]) for theirs in kind if theirs is not mine]
    return out


class Classifier:
    def __init__(self, texts: list[np.ndarray], labels: np.ndarray, identities: tuple = IDENTITIES, counterfactual: float = COUNTERFACTUAL):
        n, pos = len(texts), float(labels.sum())
        self.chosen, self.weights, self.bias = np.zeros(BINS, bool), np.zeros(BINS, np.float32), 0.0
        self.prior = pos / n if n else 0.5
        if not 0 < pos < n:
            self.bias = float(np.log((pos + 0.5) / (n - pos + 0.5)))
            return
        flat, row = np.concatenate(texts), np.repeat(np.arange(n), [len(t) for t in texts])
        with_pos = np.bincount(flat[labels[row] == 1], minlength=BINS).astype(float)
        with_neg = np.bincount(flat, minlength=BINS) - with_pos
        a, b = (with_pos + 0.5) / (pos + 1), (with_neg + 0.5) / (n - pos + 1)
        odds = np.abs(np.log(a / b))
        tells = odds * np.sqrt(np.maximum(a, b)) * ((with_pos + with_neg >= 2) & (odds >= LEAST_ODDS))
        moved = swaps(texts, identities)
        top = np.argsort(-tells, kind="stable")[:CHOSEN]
        used = np.union1d(top[tells[top] > 0], np.array(sorted({b for _, g, m in moved for b in [*g, *m]}), np.int64)).astype(np.int64)
        self.chosen[used] = True
        at = np.zeros(BINS, np.int64)
        at[used] = np.arange(len(used))
        keep = self.chosen[flat]
        col, row = at[flat[keep]], row[keep]
        # a feature counts as much as it is surprising: weights are learnt for values scaled by the log odds
        scale = np.maximum(0.05, odds[used])
        value = scale[col]
        d_row = np.array([k for k, (_, g, m) in enumerate(moved) for _ in range(len(g) + len(m))], np.int64)
        d_col = at[np.array([b for _, g, m in moved for b in [*g, *m]], np.int64)]
        d_value = np.array([s for _, g, m in moved for s in [1.0] * len(g) + [-1.0] * len(m)]) * scale[d_col] if moved else np.zeros(0)
        w, bias = np.zeros(len(used)), np.log(self.prior / (1 - self.prior))
        first, second = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
        for step in range(1, STEPS + 1):
            z = np.bincount(row, weights=value * w[col], minlength=n) + bias
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / n
            g = np.bincount(col, weights=value * error[row], minlength=len(used)) + 2 * RIDGE * w
            if moved:
                change = np.bincount(d_row, weights=d_value * w[d_col], minlength=len(moved))
                g += 2 * counterfactual / len(moved) * np.bincount(d_col, weights=d_value * change[d_row], minlength=len(used))
            g = np.append(g, error.sum())
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            move = 0.05 * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            w, bias = w - move[:-1], bias - move[-1]
        self.weights[used], self.bias = (w * scale).astype(np.float32), float(bias)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, b = features(data, offsets, self.chosen)
        z = np.bincount(row, weights=self.weights[b], minlength=len(offsets) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _present(batches):
    for batch in batches:
        for lo, hi, data, offsets in chunks(batch.column("text")):
            row, b = features(data, offsets)
            cut = np.searchsorted(row, np.arange(hi - lo + 1))
            yield pa.record_batch([batch.column("label").slice(lo, hi - lo), pa.array([b[x:y].astype(np.int32).tobytes() for x, y in zip(cut, cut[1:], strict=False)], pa.binary())], names=["label", "bins"])


def _score(model_of):
    def run(batches):
        model = model_of.value
        for batch in batches:
            scores = [model.score(data, offsets) for _, _, data, offsets in chunks(batch.column("text"))]
            yield pa.record_batch([batch.column("id"), pa.array(np.concatenate([np.zeros(0), *scores]))], names=["id", "score"])

    return run


def classify_toxicity(docs: DataFrame, labels: DataFrame, *, learn, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, identities: tuple = IDENTITIES, counterfactual: float = COUNTERFACTUAL) -> DataFrame:
    """id and score, 0 to 1, of each row: how likely its label is 1.

    learn: a condition on the rows of labels; only those teach, at most `sample` of them. A text of more words weighs
    no more than another. Null and empty texts have no features and get the score of the bias alone; where all labels
    agree, or there are none, all texts get the smoothed share of label 1. Rows that repeat get equal scores; ids may
    be null. Other columns are left out. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    taught = rows.join(F.broadcast(sample_labels(labels, id_col, label_col, learn, sample)), F.col("id") == F.col("sampled"))
    # of texts that share an id one teaches, so that no more come back than were sampled
    taught = taught.groupBy("sampled", "label").agg(F.min("text").alias("text"))
    found = sorted(taught.transform(in_batches).mapInArrow(_present, "label double, bins binary").toArrow().to_pylist(), key=lambda r: (r["bins"], r["label"]))
    model = Classifier([np.frombuffer(r["bins"], np.int32) for r in found], np.array([r["label"] for r in found]), identities, counterfactual)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.transform(in_batches).mapInArrow(_score(spark.sparkContext.broadcast(model)), f"id {kind}, score double").withColumnRenamed("id", id_col)


def op6(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted; labels of the held-out third are never looked at."""
    held = id_mod("doc_id", 3) == 1
    scored = classify_toxicity(docs, labels, learn=~held)
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
