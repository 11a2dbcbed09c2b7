"""Benchmark decontamination by suffix arrays over shards of the training texts.

Each task cuts its documents into shards of whole texts and builds, for each shard, the array of those word suffixes
that can match at all: a suffix counts if its first word begins some benchmark window and if enough benchmark words
follow without a gap. That leaves out only suffixes which no window equals, so the search is exact. Every benchmark
suffix, cut to its window, is then found in the sorted array by binary search; the range it spans gives all of its
occurrences, which are never paired with the places of the window: windows know the set of their items. Occurrences
are then extended: a binary search among the items' suffixes, in order, finds the one that goes on longest. Nothing
is shuffled. The benchmark travels in blocks of bounded size; a larger benchmark takes more passes, not more memory.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import ALNUM, LOWER, Scratch, Words, aliased, chunks, in_batches, mix, powers

WINDOW = 13
#: Bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 8 << 20

MATCH = pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("words", pa.int64())])
MATCH_DDL = "array<struct<item_id:string,item_word:bigint,doc_word:bigint,words:bigint>>"
#: What earlier blocks have found in a text.
FOUND = pa.struct([("spans", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), ("items", pa.list_(pa.string())), ("matches", pa.list_(MATCH))])
FOUND_DDL = f"struct<spans:array<struct<from:bigint,to:bigint>>,items:array<string>,matches:{MATCH_DDL}>"


class Block:
    """Vocabulary, windows and suffixes of some benchmark items."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        data = [LOWER[np.frombuffer((t or "").encode(), np.uint8)] for _, t in items]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
        w = Words(np.concatenate(data) if data else np.zeros(0, np.uint8), offsets, ALNUM)
        self.hashes, first, ids = np.unique(w.hash, return_index=True, return_inverse=True)
        self.data, self.start, self.size = w.data, w.start[first], (w.end - w.start)[first]
        self.known = np.zeros(1 << 20, bool)
        self.known[self.hashes >> np.uint64(44)] = True
        self.word = ids.astype(np.int64) + 1
        self.items, by_size = [i for i, _ in items], defaultdict(list)
        self.row, self.first = w.row, w.first
        self.least = np.full(len(self.hashes) + 1, 1 << 40, np.int64)
        for r in range(w.rows):
            lo, hi = int(w.first[r]), int(w.first[r + 1])
            if hi > lo:
                size = min(window, hi - lo)
                by_size[size].append(np.arange(lo, hi - size + 1))
                np.minimum.at(self.least, self.word[lo : hi - size + 1], size)
        #: By size: the distinct windows as byte strings, sorted, and of each the number of its set of items.
        self.windows, pairs = {}, []
        for size, places in sorted(by_size.items()):
            p = np.concatenate(places)
            distinct, inverse = np.unique(as_keys(self.word[p[:, None] + np.arange(size)]), return_inverse=True)
            self.windows[size] = distinct, len(pairs)
            mine = np.unique(np.stack([inverse, self.row[p]]), axis=1)
            cut = np.searchsorted(mine[0], np.arange(len(distinct) + 1))
            pairs += [mine[1, a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        #: Windows of the same items share a set; sets are lists of items, one after the other.
        sets, self.set_of = np.unique(np.array(pairs, object), return_inverse=True) if pairs else (np.zeros(0, object), np.zeros(0, np.int64))
        self.set_items = [np.frombuffer(x, np.int32) for x in sets]
        self.depth = max(by_size, default=1)
        #: Words from here to the end of the item; the suffixes in the order of their words, a suffix before what it begins.
        self.left = self.first[self.row + 1] - np.arange(len(self.row))
        self.order = _suffixes(self.word, self.left)
        self.prefix = _running(self.word)

    def ids(self, w: Words) -> np.ndarray:
        out = np.zeros(len(w.hash), np.int64)
        if len(self.hashes):
            maybe = np.flatnonzero(self.known[w.hash >> np.uint64(44)])
            at = np.minimum(np.searchsorted(self.hashes, w.hash[maybe]), len(self.hashes) - 1)
            same = self.hashes[at] == w.hash[maybe]
            out[maybe[same]] = at[same] + 1
        return out

    def spelled(self, w: Words, at: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Of words of equal hashes, whether they are equal letter by letter."""
        size, start, there = (w.end - w.start)[at], w.start[at], self.start[ids - 1]
        equal = size == self.size[ids - 1]
        for n in np.unique(size[equal]).tolist():
            mine = np.flatnonzero(equal & (size == n))
            for lo in range(0, len(mine), 1 + (1 << 22) // n):
                some = mine[lo : lo + 1 + (1 << 22) // n]
                equal[some] = (w.data[start[some][:, None] + np.arange(n)] == self.data[there[some][:, None] + np.arange(n)]).all(axis=1)
        return equal


def as_keys(ids: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort like them."""
    rows = np.ascontiguousarray(ids.astype(">u4"))
    return rows.view(f"S{4 * rows.shape[1]}").ravel()


def _running(ids: np.ndarray) -> np.ndarray:
    out = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(mix(ids.astype(np.uint64)) * powers(len(ids))[: len(ids)], out=out[1:])
    return out


def _suffixes(ids: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The places in the order of what follows them, `left` words of each: ranks by one word, two, four and so on."""
    n, rank, step = len(ids), ids.astype(np.int64), 1
    while n:
        ahead = np.arange(n) + step
        second = np.where(step < left, rank[np.minimum(ahead, n - 1)] + 1, 0)
        order = np.lexsort((second, rank))
        new = np.concatenate([[0], np.cumsum((rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1]))])
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2
        if new[-1] == n - 1 or step >= left.max():
            return order
    return np.zeros(0, np.int64)


def search(w: Words, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window that occurs at a place of the shard: the place, its size, its set of items; and the shard's word numbers."""
    ids = block.ids(w)
    n, none = len(ids), np.zeros(0, np.int64)
    if not n or not block.windows:
        return none, none, none, ids
    run = _runs(ids, w)
    at = np.flatnonzero((ids > 0) & (run >= block.least[ids]))
    found = [(none, none, none)]
    if len(at):
        array = as_keys(np.where(np.arange(block.depth) < run[at][:, None], ids[np.minimum(at[:, None] + np.arange(block.depth), n - 1)], 0))
        order = np.argsort(array, kind="stable")
        array, at = array[order], at[order]
        letters = array.view(np.uint8).reshape(len(array), -1) if len(array) else np.zeros((0, 4 * block.depth), np.uint8)
        for size, (distinct, number) in block.windows.items():
            cut = np.ascontiguousarray(letters[:, : 4 * size]).view(f"S{4 * size}").ravel()
            lo, hi = np.searchsorted(cut, distinct, "left"), np.searchsorted(cut, distinct, "right")
            k = np.flatnonzero(hi > lo)
            times = hi[k] - lo[k]
            rows = np.repeat(lo[k] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            found.append((at[rows], np.full(len(rows), size), np.repeat(block.set_of[number + k], times)))
    here, size, items = (np.concatenate(x) for x in zip(*found, strict=True))
    # words of hit windows are compared letter by letter before they count
    hit = np.flatnonzero(_covered(here, size, n))
    wrong = np.zeros(n + 1, np.int64)
    wrong[hit + 1] = ~block.spelled(w, hit, ids[hit])
    if wrong.any():
        ids[np.flatnonzero(wrong[1:])] = 0
        wrong = np.cumsum(wrong)
        right = wrong[here + size] == wrong[here]
        here, size, items = here[right], size[right], items[right]
    return here, size, items, ids


def _runs(ids: np.ndarray, w: Words) -> np.ndarray:
    """Known words from each place on, to the end of the text at most."""
    stop = np.minimum.accumulate(np.where(ids == 0, np.arange(len(ids)), len(ids))[::-1])[::-1]
    return np.minimum(stop, w.first[w.row + 1]) - np.arange(len(ids))


def _covered(here: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, here, 1)
    np.add.at(steps, here + size, -1)
    return np.cumsum(steps)[:-1] > 0


def longest(here: np.ndarray, ids: np.ndarray, w: Words, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Of each place of the shard the most words that follow it as they do in an item, and a place in the items where they do.

    The best of all suffixes of the items stands beside the place's own suffix in their order, so a binary search finds it.
    """
    run, mine = _runs(ids, w)[here], _running(ids)
    base = powers(len(mine) + len(block.prefix))
    m = len(block.order)

    def common(there: np.ndarray) -> np.ndarray:
        most, got = np.minimum(run, block.left[there]), np.zeros(len(here), np.int64)
        step = 1 << int(max(1, most.max(initial=1))).bit_length() - 1
        while step:
            to = got + step
            fits = np.flatnonzero(to <= most)
            a, b, k = here[fits], there[fits], to[fits]
            # sums of powers from different places are brought to the same one
            left = (mine[a + k] - mine[a]) * base[b]
            right = (block.prefix[b + k] - block.prefix[b]) * base[a]
            same = fits[left == right]
            got[same] = to[same]
            step >>= 1
        return got

    lo, hi = np.zeros(len(here), np.int64), np.full(len(here), m, np.int64)
    while (lo < hi).any():
        mid = (lo + hi) // 2
        there = block.order[np.minimum(mid, m - 1)]
        k = common(there)
        a = np.where(k < run, ids[np.minimum(here + k, len(ids) - 1)], 0)
        b = np.where(k < block.left[there], block.word[np.minimum(there + k, m - 1)], 0)
        less = (b < a) & (lo < hi)
        lo, hi = np.where(less, mid + 1, lo), np.where(less | (lo >= hi), hi, mid)
    sides = [block.order[np.clip(lo - 1, 0, m - 1)], block.order[np.clip(lo, 0, m - 1)]]
    each = [common(s) for s in sides]
    second = each[1] > each[0]
    return np.where(second, each[1], each[0]), np.where(second, sides[1], sides[0])


def _found(w: Words, block: Block) -> list[dict]:
    """Of each text with hits: its row, spans of hit words, numbers of items, and longest matches that no other one holds."""
    here, size, sets, ids = search(w, block)
    if not len(here):
        return []
    out, rows = [], w.row[here]
    hit = _covered(here, size, len(ids))
    edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
    # texts that follow each other are cut apart
    starts = np.flatnonzero((edge[:-1] == 1) | (hit & np.isin(np.arange(len(hit)), w.first)))
    stops = np.append(starts[1:], len(hit))
    ends = np.minimum(stops, np.append(np.flatnonzero(edge == -1), len(hit))[np.searchsorted(np.flatnonzero(edge == -1), starts, side="right")])
    begun = np.unique(here)
    words, there = longest(begun, ids, w, block)
    inner = np.zeros(len(begun), bool)
    inner[1:] = (np.diff(begun) == 1) & (w.row[begun[1:]] == w.row[begun[:-1]]) & (words[:-1] > words[1:])
    begun, words, there = begun[~inner], words[~inner], there[~inner]
    of_set = np.unique(np.stack([rows, sets]), axis=1)
    for r in np.unique(rows).tolist():
        first, mine = int(w.first[r]), of_set[1, of_set[0] == r]
        spans, own = w.row[starts] == r, w.row[begun] == r
        items = np.unique(np.concatenate([block.set_items[k] for k in mine.tolist()]))
        matches = [{"item_id": block.items[int(block.row[t])], "item_word": int(t - block.first[block.row[t]]), "doc_word": int(h - first), "words": int(k)} for h, k, t in zip(begun[own], words[own], there[own], strict=True)]
        out.append({"row": r, "spans": [{"from": int(a - first), "to": int(b - first)} for a, b in zip(starts[spans], ends[spans], strict=True)], "items": [block.items[k] for k in items.tolist()], "matches": matches})
    return out


def _pass(block_of, window: int, names: list[str], id_col: str, text_col: str, last: bool):
    def run(batches):
        block = block_of.value
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            held = [x or {"spans": [], "items": [], "matches": []} for x in batch.column("__found").to_pylist()]
            for lo, _, data, offsets in chunks(batch.column(text_col)):
                w = Words(LOWER[data], offsets, ALNUM)
                n_words[lo : lo + w.rows] = np.diff(w.first)
                for f in _found(w, block):
                    held[lo + f["row"]] = {k: held[lo + f["row"]][k] + f[k] for k in ("spans", "items", "matches")}
            columns = [batch.column(c) for c in names]
            if last:
                yield pa.record_batch([*columns, pa.array(n_words), *_verdict(n_words, held), pa.array([x["matches"] for x in held], pa.list_(MATCH))], names=[*names, "n_words", "n_hit", "n_items", "items", "contaminated", "longest", "matches"])
            else:
                yield pa.record_batch([*columns, batch.column(text_col), pa.array(held, FOUND)], names=[*names, text_col, "__found"])

    return run


def _verdict(n_words, held):
    hits, n_items, items, most = [], [], [], []
    for n, found in zip(n_words, held, strict=True):
        steps = np.zeros(int(n) + 1 if found["spans"] else 0, np.int64)
        for s in found["spans"]:
            steps[s["from"]] += 1
            steps[s["to"]] -= 1
        hits.append(int((np.cumsum(steps) > 0).sum()))
        named = sorted(set(found["items"]))
        n_items.append(len(named))
        items.append(named)
        most.append(max((m["words"] for m in found["matches"]), default=0))
    contaminated = [h > 0 and 20 * h >= n for h, n in zip(hits, n_words.tolist(), strict=True)]
    return pa.array(hits, pa.int64()), pa.array(n_items, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(contaminated), pa.array(most, pa.int64())


def match_benchmark(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without its text, and n_words, n_hit, n_items, items (sorted as strings), contaminated, longest, matches.

    matches: each place of a text from which a window goes on longest, unless the match from the word before holds it: how
    many words are the same in an item, and which item and place that is; where several go on as long, one of them.

    A window is `window` consecutive words of an item, or all words of a shorter item. A word of a document is hit if
    it lies in an occurrence of a window. A document is contaminated if a twentieth of its words is hit. Null or empty
    texts have no words and no hits; items without words have no windows; a null item_id counts as an empty string;
    rows that repeat are judged one by one; other columns pass through whatever their names, as long as these aren't
    among the new ones. An empty benchmark or an empty table of documents gives rows without hits or no rows.
    """
    spark = docs.sparkSession
    new = {"n_words", "n_hit", "n_items", "items", "contaminated", "longest", "matches"}
    names = [c for c in docs.columns if c != text_col and c not in new and c != "__found"]
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(item_text_col), F.lit("")).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    scratch = Scratch(spark, "benchmark")
    out = docs.select(*names, text_col, F.lit(None).cast(FOUND_DDL).alias("__found"))
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        block = spark.sparkContext.broadcast(Block([(r[0], r[1]) for r in part.orderBy("i", "t").collect()], window))
        last = b == blocks - 1
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema]
        fields += ["n_words bigint, n_hit bigint, n_items bigint, items array<string>, contaminated boolean, longest bigint", f"matches {MATCH_DDL}"] if last else [f"`{text_col}` string", f"__found {FOUND_DDL}"]
        out = out.transform(in_batches).mapInArrow(_pass(block, window, names, text_col, text_col, last), ", ".join(fields))
        if not last:
            # each block has a stage of its own: an executor holds one at a time
            out = scratch.keep(out, f"pass-{b}")
            scratch.drop(f"pass-{b - 1}")
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that aren't contaminated, with their columns; see match_benchmark for the rule.

    Documents are joined to their verdicts by nothing: the verdict is made in the same pass that carries the text.
    """
    text = options.get("text_col", "text")
    inner, back = aliased(docs, {text})
    kept = match_benchmark(inner.withColumn("carried_text", F.col(text)), benchmark, **options).where("not contaminated")
    return kept.withColumnRenamed("carried_text", text).select(*back)


def op2(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the longest match in words."""
    found = match_benchmark(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated", "longest")
