"""Language-model scores by context-tree weighting, beside a unigram base.

The text that is scored is the token stream: lower-cased words, a blank between two, a line end after the last. A byte
is eight binary decisions; a decision's contexts are the bytes before it, none to DEPTH of them, with the bits already
known. Training counts the zeros and ones of every context. From the deepest contexts up, a context's weighted
probability is the mean of its own Krichevsky-Trofimov estimate of what followed it and the product of its children's;
that gives every context the weight with which it answers itself. A prediction mixes the estimates along the path by
these weights; a context never seen leaves the answer to the one above.

Counting is one pass over the texts and a shuffle of distinct byte strings and words. No context is left out: the tree is
dealt out by the last two bytes of a context, so that a task holds whole subtrees of two bytes and more; the products of
its uppermost contexts are summed up by their last byte, and what is above, 65,536 contexts at most, is the driver's. With
it, the tasks then give each distinct byte string its probability. These travel to the texts, sorted, in parts of PART
strings, a pass over the texts for each. Word counts are exact: at most HEAD of the most frequent words travel as hashes,
all other words are counted by a join.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import INK, LOWER, Scratch, Words, chunks, id_mod, in_batches, prefix_hash, span_hash

#: Bytes of the deepest contexts, 2 to 7.
DEPTH = 5
#: Byte strings of one part, 12 bytes each, and frequent words, at most.
PART, HEAD = 1 << 24, 1 << 20
#: Distinct words or byte strings that a task holds before it passes them on.
HELD = 300_000
_CACHE = 1 << 20


def stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token streams of a chunk's rows, and their offsets."""
    ends = offsets[1:] + np.arange(len(offsets) - 1)
    out = np.insert(LOWER[data], offsets[1:], 10)
    ink = INK[out]
    gap = np.zeros(len(out), bool)
    gap[1:] = ~ink[1:] & ink[:-1]
    out[gap] = 32
    keep = ink | gap
    kept = np.concatenate([[0], np.cumsum(keep)])
    empty = kept[ends + 1] == kept[np.concatenate([[0], ends[:-1] + 1])]
    keep[ends[empty]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    new = np.concatenate([[0], kept[ends + 1]])
    out = out[keep]
    out[new[1:] - 1] = 10
    return out, new


def grams(data: np.ndarray, offsets: np.ndarray, depth: int) -> np.ndarray:
    """Of each byte of the streams, the bytes before it and itself as one number; line ends stand before a stream."""
    n = len(data)
    place = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    code = np.zeros(n, np.uint64)
    for j in range(depth, -1, -1):
        byte = np.full(n, 10, np.uint8)
        byte[j:] = data[: max(0, n - j)]
        code = code << np.uint64(8) | np.where(place >= j, byte, 10).astype(np.uint64)
    return code


def _counts(depth: int):
    """Rows of kind, word, code, n: words with their hashes (0), byte strings (1), documents (2).

    n counts texts with the flag learn alone; of the others the byte strings are wanted, the words aren't.
    """

    def run(batches):
        words: Counter = Counter()
        codes, docs = [], 0

        def flush_words():
            out = pa.record_batch([pa.array([0] * len(words), pa.int32()), pa.array(list(words), pa.binary()), pa.array(_hashes(list(words))), pa.array(list(words.values()), pa.int64())], names=["kind", "word", "code", "n"])
            words.clear()
            return out

        def merge():
            keys = np.concatenate([k for k, _ in codes])
            distinct, inverse = np.unique(keys, return_inverse=True)
            n = np.bincount(inverse, weights=np.concatenate([n for _, n in codes]), minlength=len(distinct)).astype(np.int64)
            codes[:] = [(distinct, n)]

        def flush_codes():
            merge()
            distinct, n = codes[0]
            codes.clear()
            m = len(distinct)
            return pa.record_batch([pa.array(np.ones(m, np.int32)), pa.nulls(m, pa.binary()), pa.array(distinct.view(np.int64)), pa.array(n)], names=["kind", "word", "code", "n"])

        for batch in batches:
            learn = batch.column("learn").to_numpy(zero_copy_only=False).astype(bool)
            docs += int(learn.sum())
            for lo, hi, data, offsets in chunks(batch.column("text")):
                data, offsets = stream(data, offsets)
                taught = np.repeat(learn[lo:hi], np.diff(offsets))
                words.update(data[taught].tobytes().split())
                if len(words) > HELD:
                    yield flush_words()
                found, inverse = np.unique(grams(data, offsets, depth), return_inverse=True)
                codes.append((found, np.bincount(inverse, weights=taught, minlength=len(found)).astype(np.int64)))
                if sum(len(k) for k, _ in codes) > 4 * HELD:
                    merge()
                    if len(codes[0][0]) > 2 * HELD:
                        yield flush_codes()
        if words:
            yield flush_words()
        if codes:
            yield flush_codes()
        if docs:
            yield pa.record_batch([pa.array([2], pa.int32()), pa.nulls(1, pa.binary()), pa.array([0], pa.int64()), pa.array([docs], pa.int64())], names=["kind", "word", "code", "n"])

    return run


def _hashes(words: list[bytes]) -> np.ndarray:
    out = []
    for lo in range(0, len(words), 20_000):
        part = words[lo : lo + 20_000]
        end = np.cumsum([len(w) for w in part])
        out.append(span_hash(prefix_hash(np.frombuffer(b"".join(part), np.uint8)), np.concatenate([[0], end[:-1]]), end))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def log_gamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros(len(x))
    for j in range(8):
        shift += np.log(x + j)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def nodes(codes: np.ndarray, depth: int, k: int) -> np.ndarray:
    """The context of this depth of bit k of each byte string, as a number of bytes before and bits known."""
    context = (codes >> np.uint64(8)) & np.uint64((1 << (8 * depth)) - 1)
    known = np.uint64(1 << k) | (codes & np.uint64(255)) >> np.uint64(8 - k)
    return context << np.uint64(8) | known


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - np.log(np.pi)


def weigh(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the weighted probability of contexts with children, and the weight of their own estimates."""
    weighted = np.logaddexp(own, below) - np.log(2)
    return weighted, np.exp(own - np.log(2) - weighted)


class Subtree:
    """The contexts of two bytes and more that end alike, of all byte strings with these two bytes before the last one."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, depth: int):
        self.codes, self.depth = codes, depth
        bits = np.stack([(codes >> np.uint64(7 - k)) & np.uint64(1) for k in range(8)]).astype(bool)
        self.bits, count = bits, np.broadcast_to(n.astype(np.float64), bits.shape).ravel()
        self.at, self.one, self.weight, self.seen, below = {}, {}, {}, {}, None
        for d in range(depth, 1, -1):
            number, first, at = np.unique(np.concatenate([nodes(codes, d, k) for k in range(8)]), return_index=True, return_inverse=True)
            zeros, ones = (np.bincount(at, weights=np.where(bits.ravel() == b, count, 0), minlength=len(number)) for b in (0, 1))
            own = estimate(zeros, ones)
            weighted, weight = (own, np.ones(len(own))) if below is None else weigh(own, np.bincount(at[below[0]], weights=below[1], minlength=len(number)))
            self.at[d], self.one[d], self.weight[d], self.seen[d] = at.reshape(8, -1), (ones + 0.5) / (zeros + ones + 1), weight, zeros + ones > 0
            below = first, weighted
            if d == 2:
                #: Of the uppermost contexts: the last byte with the known bits, log of the weighted probability, counts.
                self.top = (number & np.uint64(0xFFFF)).astype(np.int64), weighted, zeros, ones

    def log10(self, top: Top) -> np.ndarray:
        """Of each byte string, the log10 probability of its last byte after the others."""
        one, seen = np.full(self.bits.shape, 0.5), np.zeros(self.bits.shape, bool)
        steps = [(self.one[d][self.at[d]], self.weight[d][self.at[d]], self.seen[d][self.at[d]]) for d in range(self.depth, 1, -1)]
        for d in (1, 0):
            node = np.stack([nodes(self.codes, d, k) for k in range(8)]).astype(np.int64)
            steps.append((top.one[d][node], top.weight[d][node], top.seen[d][node]))
        for own, w, here in steps:
            one = np.where(here, np.where(seen, w * own + (1 - w) * one, own), one)
            seen |= here
        return np.log10(np.where(self.bits, one, 1 - one)).sum(0)


class Top:
    """The contexts of one byte and of none."""

    def __init__(self, node: np.ndarray, below: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        """Of each context of one byte: its number, the sum of its children's log probabilities, its counts."""
        self.one, self.weight, self.seen = [np.full(1 << s, 0.5) for s in (8, 16)], [np.ones(1 << s) for s in (8, 16)], [np.zeros(1 << s, bool) for s in (8, 16)]
        for d in (1, 0):
            weighted, self.weight[d][node] = weigh(estimate(zeros, ones), below)
            self.one[d][node], self.seen[d][node] = (ones + 0.5) / (zeros + ones + 1), zeros + ones > 0
            if d:
                node, at = np.unique(node & 255, return_inverse=True)
                below, zeros, ones = (np.bincount(at, weights=x, minlength=len(node)).astype(np.float64) for x in (weighted, zeros, ones))


def _subtrees(depth: int, then):
    """What `then` makes of each subtree, from rows of code and n that come in the order of their last bytes."""

    def run(batches):
        held, rows, width = [], 0, 0

        def made(table: pa.Table):
            codes = table.column("code").to_numpy().view(np.uint64)
            n = table.column("n").to_numpy()
            end = codes >> np.uint64(8) & np.uint64(0xFFFF)
            cut = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1], [True]]))
            for lo, hi in zip(cut, cut[1:], strict=False):
                yield then(Subtree(codes[lo:hi], n[lo:hi], depth))

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows > 2 * width:
                table = pa.Table.from_batches(held).combine_chunks()
                end = table.column("code").to_numpy() >> 8 & 0xFFFF
                last = int(np.flatnonzero(end == end[-1])[0])
                yield from made(table.slice(0, last)) if last else ()
                table = table.slice(last)
                held, rows, width = table.to_batches(), table.num_rows, table.num_rows
        if held:
            yield from made(pa.Table.from_batches(held).combine_chunks())

    return run


def _tops(tree: Subtree) -> pa.RecordBatch:
    return pa.record_batch(list(map(pa.array, tree.top)), names=["node", "below", "zeros", "ones"])


def _answers(top_of):
    def then(tree: Subtree) -> pa.RecordBatch:
        return pa.record_batch([pa.array(tree.codes.view(np.int64)), pa.array(tree.log10(top_of.value).astype(np.float32))], names=["code", "log10"])

    return then


class Part:
    """log10 probabilities by byte string, those last asked for in a table of fixed size."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        order = np.argsort(codes.view(np.uint64))
        self.codes, self.values = codes.view(np.uint64)[order], values[order]
        self.keys, self.cached = None, None

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """0 for strings of another part."""
        if self.keys is None:
            self.keys, self.cached = np.full(_CACHE, 1 << 63, np.uint64), np.zeros(_CACHE, np.float32)
        at = (codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)
        out = self.cached[at]
        miss = np.flatnonzero(self.keys[at] != codes)
        if len(miss) and len(self.codes):
            distinct, inverse = np.unique(codes[miss], return_inverse=True)
            place = np.minimum(np.searchsorted(self.codes, distinct), len(self.codes) - 1)
            found = np.where(self.codes[place] == distinct, self.values[place], np.float32(0))
            out[miss] = found[inverse]
            self.keys[at[miss]], self.cached[at[miss]] = codes[miss], out[miss]
        return out


class Head:
    """Frequent words by hash, with their log10 base probability."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, n: int, v: int):
        order = np.argsort(codes.view(np.uint64))
        self.codes, self.counts = codes.view(np.uint64)[order], counts[order]
        self.divisor = n + 0.5 * (v + 1)
        self.known = np.zeros(1 << 24, bool)
        self.known[self.codes >> np.uint64(40)] = True

    def score(self, counts):
        return np.log10((counts + 0.5) / self.divisor)


def _more(part_of, depth: int, names: list[str]):
    """The rows, with what the byte strings of one part add to their scores."""

    def run(batches):
        part = part_of.value
        for batch in batches:
            score = batch.column("score").to_numpy().copy()
            for lo, hi, data, offsets in chunks(batch.column("text")):
                data, offsets = stream(data, offsets)
                score[lo:hi] += np.add.reduceat(part(grams(data, offsets, depth)).astype(np.float64), offsets[:-1])
            yield pa.record_batch([*(batch.column(c) for c in names), batch.column("text"), pa.array(score)], names=[*names, "text", "score"])

    return run


def _score(part_of, depth: int, head_of, names: list[str]):
    """The carried columns, the score with what the last part adds, and what the base needs."""

    def run(batches):
        part, head = part_of.value, head_of.value
        for batch in batches:
            parts, before = [], batch.column("score").to_numpy()
            for lo, hi, data, offsets in chunks(batch.column("text")):
                n = hi - lo
                data, offsets = stream(data, offsets)
                score = before[lo:hi] + np.add.reduceat(part(grams(data, offsets, depth)).astype(np.float64), offsets[:-1])
                w = Words(data, offsets, INK)
                n_words = np.diff(w.first)
                maybe = np.flatnonzero(head.known[w.hash >> np.uint64(40)])
                at = np.minimum(np.searchsorted(head.codes, w.hash[maybe]), max(0, len(head.codes) - 1))
                hit = head.codes[at] == w.hash[maybe] if len(head.codes) else np.zeros(0, bool)
                found = maybe[hit]
                base = np.bincount(w.row[found], weights=head.score(head.counts[at[hit]]), minlength=n).astype(np.float64)
                known = np.bincount(w.row[found], minlength=n)
                rare = np.ones(len(w.hash), bool)
                rare[found] = False
                rare = np.flatnonzero(rare)
                cut = np.searchsorted(w.row[rare], np.arange(n + 1))
                tails = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array([w.word(k) for k in rare], pa.binary()))
                parts.append(pa.record_batch([pa.array(n_words), pa.array(known), pa.array(base), pa.array(score), pa.array(np.diff(offsets)), tails], names=_SCORED))
            made = pa.Table.from_batches(parts).combine_chunks().to_batches() if parts else []
            if made:
                yield pa.record_batch([*(batch.column(c) for c in names), *made[0].columns], names=[*names, *_SCORED])

    return run


_SCORED = ["words", "known", "base", "score", "n_bytes", "rare"]


def _frequent(words: DataFrame, head: int) -> tuple[int, int]:
    """Distinct words, and the least count of the frequent ones, of which there are `head` at most.

    Words are told apart by their counts as far as 1,024, by powers of two beyond.
    """
    n = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("n"))).cast("long"))
    distinct, held, least = 0, 0, None
    for r in words.groupBy(n.alias("from")).agg(F.count("*").alias("words")).orderBy(F.desc("from")).collect():
        distinct, held = distinct + r["words"], held + r["words"]
        if held <= head:
            least = r["from"]
    return distinct, 1 << 62 if least is None else least


def score_texts(docs: DataFrame, learn: Column, *, text_col: str = "text", carry: list[str], depth: int = DEPTH, head: int = HEAD, part: int = PART) -> DataFrame:
    """The carried columns, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte of each row of docs.

    learn: which of the rows teach (null: not). Null and empty texts have one token, the end, and a stream of one byte.
    Rows that repeat get equal scores. Without training texts every token is unknown and every bit has probability one
    half. Carried columns are renamed while they travel, so their names may be anything.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    texts = docs.select(F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    counted = texts.transform(in_batches).mapInArrow(_counts(depth), "kind int, word binary, code bigint, n bigint")
    counted = scratch.keep(counted.groupBy("kind", "word", "code").agg(F.sum("n").alias("n")), "counts")
    words = counted.where("kind = 0")
    n_docs = counted.where("kind = 2").agg(F.sum("n")).first()[0] or 0
    distinct, least = _frequent(words, head)
    total = (words.agg(F.sum("n")).first()[0] or 0) + n_docs
    frequent = words.where(F.col("n") >= least).select("code", "n").toArrow()
    head_of = Head(frequent.column("code").to_numpy(), frequent.column("n").to_numpy(), total, distinct + (n_docs > 0))
    del frequent
    end_bytes = F.shiftrightunsigned("code", 8).bitwiseAND(F.lit(0xFFFF))
    dealt = counted.where("kind = 1").select("code", "n").repartition(end_bytes).sortWithinPartitions(end_bytes)
    tops = dealt.mapInArrow(_subtrees(depth, _tops), "node bigint, below double, zeros double, ones double")
    tops = tops.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("below", "zeros", "ones")]).orderBy("node").toArrow()
    top = spark.sparkContext.broadcast(Top(*(tops.column(c).to_numpy() for c in ("node", "below", "zeros", "ones"))))
    answers = scratch.keep(dealt.mapInArrow(_subtrees(depth, _answers(top)), "code bigint, log10 float"), "answers")
    names = [f"c{k}" for k in range(len(carry))]
    fields = "".join(f"{k} {docs.schema[c].dataType.simpleString()}, " for c, k in zip(carry, names, strict=True))
    now = docs.select(*[F.col(c).alias(k) for c, k in zip(carry, names, strict=True)], F.col(text_col).alias("text"), F.lit(0.0).alias("score"))
    parts = max(1, -(-answers.count() // part))
    for k in range(parts):
        mine = answers.where(F.pmod(F.xxhash64("code"), F.lit(parts)) == k).toArrow()
        part_of = spark.sparkContext.broadcast(Part(mine.column("code").to_numpy(), mine.column("log10").to_numpy()))
        del mine
        if k < parts - 1:
            now = scratch.keep(now.transform(in_batches).mapInArrow(_more(part_of, depth, names), f"{fields}text string, score double"), f"part-{k}")
            scratch.drop(f"part-{k - 1}")
    scored = now.transform(in_batches).mapInArrow(_score(part_of, depth, spark.sparkContext.broadcast(head_of), names), f"{fields}words bigint, known bigint, base double, score double, n_bytes bigint, rare array<binary>")
    scored = scratch.keep(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    divisor = float(head_of.divisor)
    count = F.coalesce("n", F.lit(0))
    rest = scored.select("row", F.explode("rare").alias("word")).join(words.where(F.col("n") < least).select("word", "n"), "word", "left")
    rest = rest.groupBy("row").agg(F.sum(F.log10((count + 0.5) / F.lit(divisor))).alias("rest"), F.count_if(count > 0).alias("rest_known"))
    out = scored.drop("rare").join(rest, "row", "left")
    end = float(head_of.score(n_docs))
    base = F.col("base") + F.coalesce("rest", F.lit(0.0)) + F.lit(end)
    return out.select(
        *[F.col(k).alias(c) for c, k in zip(carry, names, strict=True)],
        (F.col("words") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("rest_known", F.lit(0)) + F.lit(int(n_docs > 0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
        "n_bytes",
        (-F.col("score") / F.lit(float(np.log10(2))) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op10(docs: DataFrame) -> DataFrame:
    """One row per document; those whose id's crc32 leaves 1 modulo 5 are held out."""
    held = id_mod("doc_id", 5) == 1
    return score_texts(docs.select("doc_id", held.alias("held_out"), "text"), ~F.col("held_out"), carry=["doc_id", "held_out"])
