"""Near-duplicate documents by ProbMinHash.

A document is its distinct shingles of five words, weighted 1 + ln(occurrences). Every shingle sends out arrivals, a
Poisson process whose rate is its weight and whose course is its own hash's; an arrival falls on one of the registers,
and a register keeps the shingle that arrived first. Two documents agree on a register with a probability that is their
probability Jaccard similarity; where a document repeats shingles, it has a second set of registers, with all weights
one, which agree as often as its Jaccard similarity says, so a pair meets by either. A shingle stops as soon as its time is past that of the latest register. Registers are
banded into buckets, bucket mates are linked as in linking.py, and a link is verified on the shingles themselves.
Documents of the same words are collapsed before that, whatever their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import INK, LOWER, Scratch, Words, aliased, chunks, in_batches, mix, powers
from faultline.llm.linking import link

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 5
#: Registers: the first ones make the bands; PLANES bits of each, cut to words of 64, are the sketch of a document.
REGISTERS, PLANES = 256, 4
#: Registers in whose bits two sketches may differ: of similarity 0.8 they differ in 48 on average, 6 more or less; of
#: 0.6 in 96. A pair of 0.8 is missed once in some 70,000 times.
FAR = 74
_DRAWN = np.uint64((1 << 24) - 1)


def shingles(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and occurrences of each row's distinct shingles, by row; a row of fewer words has one, of all of them."""
    at, h = w.windows(size)
    row = w.row[at]
    n = np.diff(w.first)
    for r in np.flatnonzero((n > 0) & (n < size)):
        total = np.uint64(0)
        for x in w.hash[w.first[r] : w.first[r + 1]].tolist():
            total = np.uint64((int(total) * 0x9E3779B97F4A7C15 + x + 1) & (2**64 - 1))
        row, h = np.append(row, r), np.append(h, mix(np.array([total]))[0])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return row[first], h[first], np.diff(np.append(first, len(h)))


def signatures(row: np.ndarray, h: np.ndarray, weight: np.ndarray, rows: int, m: int) -> np.ndarray:
    """Of each row and register, 24 bits of the shingle that arrived first. Rows without shingles have all ones."""
    registers = np.full(rows * m, np.uint64(2**64 - 1))
    time, drawn, step = np.zeros(len(h)), 0, 1
    alive = np.arange(len(h))
    while len(alive):
        k = max(1, min(step, 500_000 // len(alive)))
        draw = (np.arange(drawn, drawn + k, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
        u = mix(h[alive][:, None] ^ draw)
        gap = -np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[alive][:, None]
        arrival = time[alive][:, None] + np.cumsum(gap, axis=1)
        register = ((u & np.uint64(2047)) * np.uint64(m) >> np.uint64(11)).astype(np.int64)
        place = row[alive][:, None] * m + register
        packed = (arrival.view(np.uint64) & ~_DRAWN) | (h[alive] & _DRAWN)[:, None]
        np.minimum.at(registers, place.ravel(), packed.ravel())
        time[alive], drawn, step = arrival[:, -1], drawn + k, min(2 * step, 256)
        latest = registers.reshape(rows, m).max(axis=1)
        alive = alive[(time[alive].view(np.uint64) & ~_DRAWN) <= latest[row[alive]]]
    return (registers & _DRAWN).reshape(rows, m)


def content(w: Words) -> np.ndarray:
    """A hash of each row's sequence of words."""
    n = np.diff(w.first)
    out = np.zeros(w.rows, np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        place = np.arange(len(w.hash)) - w.first[w.row]
        out[full] = np.add.reduceat(w.hash * powers(len(w.hash))[place], w.first[:-1][full])
    return mix(out ^ n.astype(np.uint64))


def _sign(size: int, bands: int, rows_of_band: int):
    m = max(REGISTERS, -(-bands * rows_of_band // 64) * 64)

    def run(batches):
        for batch in batches:
            parts = []
            for _, _, data, offsets in chunks(batch.column("text")):
                w = Words(LOWER[data], offsets, INK)
                row, h, n = shingles(w, size)
                sig = signatures(row, h, 1 + np.log(n), w.rows, m)
                # without a repeated shingle both sets are the same
                often = np.unique(row[n > 1])
                mine = np.flatnonzero(np.isin(row, often))
                plain = signatures(np.searchsorted(often, row[mine]), h[mine], np.ones(len(mine)), len(often), m) if len(often) else sig[:0]
                both = np.concatenate([sig, plain])
                key = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(1), (len(both), bands)).copy()
                for k in range(rows_of_band):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + both[:, k : bands * rows_of_band : rows_of_band])
                bits = np.concatenate([np.packbits((both >> np.uint64(p) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64) for p in range(PLANES)], axis=1)
                # a row's own come first, its second set, if any, after them
                order = np.argsort(np.concatenate([np.arange(w.rows), often]), kind="stable")
                sets = np.ones(w.rows, np.int64)
                sets[often] = 2
                parts.append((content(w).view(np.int64), np.bincount(row, minlength=w.rows), sets, key.view(np.int64)[order], bits[order]))
            if parts:
                node, n, sets, key, bits = (np.concatenate(x) for x in zip(*parts, strict=True))
                ends = np.append(0, np.cumsum(sets))
                lists = [pa.ListArray.from_arrays((ends * key.shape[1]).astype(np.int32), key.ravel()), pa.array([bits[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary())]
                yield pa.record_batch([batch.column("id"), batch.column("said"), pa.array(node), pa.array(n), *lists], names=["id", "said", "node", "n_shingles", "bands", "bits"])

    return run


def _sets(size: int):
    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column("text")):
                w = Words(LOWER[data], offsets, INK)
                row, h, n = shingles(w, size)
                cut = np.searchsorted(row, np.arange(w.rows + 1))
                often = [n[a:b] for a, b in zip(cut, cut[1:], strict=False)]
                sets = [h[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]
                asked = [batch.column(c).slice(lo, hi - lo) for c in ("node", "bits")]
                yield pa.record_batch([*asked, pa.array(sets, pa.binary()), pa.array([x.astype(np.uint32).tobytes() if (x > 1).any() else b"" for x in often], pa.binary())], names=["node", "bits", "set", "often"])

    return run


class Shingled:
    """Tests pairs of documents: by their sketches, then by their shingles."""

    def __init__(self, table: pa.Table, least: float, far: int):
        self.least, self.far = least, far
        sets, often = ([np.frombuffer(x, t) for x in table.column(c).to_pylist()] for c, t in (("set", np.uint64), ("often", np.uint32)))
        self.sets, self.size = sets, np.array([len(x) for x in sets])
        self.repeats = np.array([len(x) > 0 for x in often], bool)
        self.weights = [1 + np.log(x) if len(x) else np.ones(n) for x, n in zip(often, self.size.tolist(), strict=True)]
        bits = [np.frombuffer(x, np.uint64) for x in table.column("bits").to_pylist()]
        words = min((len(x) for x in bits), default=PLANES)
        #: By plane: the sketch of the weighted set, and of the plain one, which is the same where no shingle repeats.
        self.first = np.array([x[:words] for x in bits], np.uint64).reshape(len(bits), PLANES, -1)
        self.second = np.array([x[-words:] for x in bits], np.uint64).reshape(len(bits), PLANES, -1)

    def _apart(self, of: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        differs = of[a, 0] ^ of[b, 0]
        for p in range(1, PLANES):
            differs |= of[a, p] ^ of[b, p]
        return np.bitwise_count(differs).sum(1, dtype=np.int64)

    def maybe(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = self._apart(self.first, a, b) <= self.far
        rest = np.flatnonzero(~out & (self.repeats[a] | self.repeats[b]))
        out[rest] = self._apart(self.second, a[rest], b[rest]) <= self.far
        return out

    def linked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        used, index = np.unique(np.concatenate([a, b]), return_inverse=True)
        common = self._common(used, index[: len(a)], index[len(a) :]) if len(a) > 4 * len(used) else np.array([len(np.intersect1d(self.sets[x], self.sets[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
        out = common >= self.least * (self.size[a] + self.size[b] - common)
        for k in np.flatnonzero(~out & (common > 0) & (self.repeats[a] | self.repeats[b])).tolist():
            x, y = a[k], b[k]
            out[k] = weighted_similarity(self.sets[x], self.weights[x], self.sets[y], self.weights[y]) >= self.least
        return out

    def _common(self, used: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Shingles that pairs of the used rows have in common: counted in bit sets of those that several rows have."""
        row = np.repeat(np.arange(len(used)), self.size[used])
        _, shingle, n = np.unique(np.concatenate([self.sets[k] for k in used]), return_inverse=True, return_counts=True)
        shared = n[shingle] > 1
        number = np.cumsum(n > 1) - 1
        row, shingle = row[shared], number[shingle[shared]]
        out = np.zeros(len(a), np.int64)
        for lo in range(0, int(shingle.max(initial=-1)) + 1, 1 << 13):
            part = (shingle >= lo) & (shingle < lo + (1 << 13))
            has = np.zeros((len(used), 1 << 13), bool)
            has[row[part], shingle[part] - lo] = True
            bits = np.packbits(has, axis=1).view(np.uint64)
            for k in range(0, len(a), 1 << 15):
                out[k : k + (1 << 15)] += np.bitwise_count(bits[a[k : k + (1 << 15)]] & bits[b[k : k + (1 << 15)]]).sum(1, dtype=np.int64)
        return out


def weighted_similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Probability Jaccard similarity of two sets of sorted hashes with weights."""
    common, at, bt = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    ratio = wb[bt] / wa[at]
    order = np.argsort(ratio, kind="stable")
    ratio, va, vb = ratio[order], wa[at][order], wb[bt][order]
    only_a, only_b = wa.sum() - va.sum(), wb.sum() - vb.sum()
    # of an element of ratio r: the weights in a of the elements of at most that ratio, those in b of the others over r
    upto, beyond = np.cumsum(va), vb.sum() - np.cumsum(vb)
    last = np.searchsorted(ratio, ratio, side="right") - 1
    return float((va / (only_a + upto[last] + (only_b + beyond[last]) / ratio)).sum())


def _classes(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, size: int, least: float, bands: int, rows: int, far: int) -> DataFrame:
    """id, said (a hash of the text), node (a hash of its words) and root, the class, of each row."""
    rows_in = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("said"), F.col(text_col).alias("text"))
    kind = rows_in.schema["id"].dataType.simpleString()
    signed = rows_in.transform(in_batches).mapInArrow(_sign(size, bands, rows), f"id {kind}, said bigint, node bigint, n_shingles bigint, bands array<bigint>, bits binary")
    signed = scratch.keep(signed, "signed")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "said")).alias("first")
    nodes = signed.where("n_shingles > 0").groupBy("node").agg(first, F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    nodes = scratch.keep(nodes.select("node", "first.id", "first.said", "n_shingles", "bands", "bits"), "nodes")

    def payload(wanted: DataFrame, name: str) -> DataFrame:
        asked = scratch.keep(wanted.join(nodes, "node").select("node", F.col("id").alias("asked_id"), F.col("said").alias("asked_said"), "bits"), f"{name}-asked")
        same = F.col("id").eqNullSafe(F.col("asked_id")) & (F.col("said") == F.col("asked_said"))
        texts = rows_in.join(scratch.hint(asked, f"{name}-asked"), same).select("node", "bits", "text")
        return texts.transform(in_batches).mapInArrow(_sets(size), "node bigint, bits binary, set binary, often binary")

    keys = nodes.select("node", (8 * F.col("n_shingles")).alias("size"), F.col("bands").alias("keys"))
    roots = link(keys, payload, lambda table: Shingled(table, least, far), scratch)
    return signed.select("id", "said", "node").join(roots, "node", "left").select("id", "said", "node", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, far: int = FAR) -> DataFrame:
    """id, node, class_id, class_size of each row: the smallest id of its class (null only if all are) and its rows.

    Two texts are linked if the Jaccard or the probability Jaccard similarity of their shingles is `least` or more; a
    class is a connected component of links. Words are lower-cased (A-Z) runs without white space; a text of fewer
    than `size` words is one shingle. Texts of the same words, so also all texts without words (null, empty), are one
    class. Rows that repeat share a class; ids may repeat or be null. An empty table gives no rows; columns other than
    id and text are left out. node is a 64-bit hash of the words.
    """
    scratch = Scratch(docs.sparkSession, "near")
    rooted = scratch.keep(_classes(docs, scratch, id_col, text_col, size, least, bands, rows, far), "rooted")
    classes = rooted.groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size")).where("class_size > 1")
    classes = scratch.hint(scratch.keep(classes, "classes"), "classes")
    size = F.coalesce("class_size", F.lit(1).cast("long"))
    return rooted.join(classes, "root", "left").select(F.col("id").alias(id_col), "node", F.when(size == 1, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), size.alias("class_size"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, far: int = FAR) -> DataFrame:
    """The row of the smallest id of each class of near duplicates, with its columns; of rows of equal id and text, one.

    The smallest id may stand at several texts of its class; then the one with the smallest hash stays. Rows without an
    id stay only where their class has no other. Texts meet no shuffle unless the rows that go are many.
    """
    scratch = Scratch(docs.sparkSession, "one")
    inner, back = aliased(docs, {id_col, text_col})
    found = scratch.keep(_classes(inner, scratch, id_col, text_col, size, least, bands, rows, far).groupBy("root", "id", "said").agg(F.count("*").alias("n")), "found")
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "said")).alias("best")
    # a class of one row stays as it is
    best = scratch.keep(found.groupBy("root").agg(best, F.sum("n").alias("rows")).where("rows > 1").drop("rows"), "best")
    marked = found.join(scratch.hint(best, "best"), "root")
    stays = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("said") == F.col("best.said"))
    marked = scratch.keep(marked.select(F.col("id").alias("__id"), F.col("said").alias("__said"), stays.alias("stays"), "n").where("not stays or n > 1"), "marked")
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__said"))
    left = inner.join(scratch.hint(marked.where("not stays").select("__id", "__said"), "marked"), same, "left_anti")
    repeated = marked.where("stays").select("__id", "__said")
    if repeated.isEmpty():
        return left.select(*back)
    once = left.join(scratch.hint(repeated, "marked"), same).dropDuplicates(["__id", "__said"]).select(*inner.columns)
    return left.join(scratch.hint(repeated, "marked"), same, "left_anti").unionByName(once).select(*back)


def op5(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id, class_size."""
    return near_duplicates(docs).select("doc_id", "class_id", "class_size")
