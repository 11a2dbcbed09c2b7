"""Quality rules by distribution divergence.

A document's histogram of character classes, and that of its common words, are compared with the reference of its
language (what all documents of that language hold together) by Jensen-Shannon distance. Texts too short for a
histogram to mean much pass. Two base rules (too few words, too many repeated word windows) come first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import ALNUM, INK, LOWER, Words, aliased, chunks, in_batches, mix, prefix_hash, span_hash

#: Character classes by the first byte of a character: small and capital ASCII letters, digits, blanks, punctuation of
#: prose, other signs, other letters. Continuation bytes have none.
CLASSES = 7
CLASS = np.full(256, 5, np.uint8)
CLASS[97:123], CLASS[65:91], CLASS[48:58] = 0, 1, 2
CLASS[[9, 10, 11, 12, 13, 32]] = 3
CLASS[[ord(c) for c in ".,;:'\"?!-()"]] = 4
CLASS[0xC0:] = 6
CLASS[0x80:0xC0] = CLASSES

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

COMMON_WORDS = 64
MAX_LANGUAGES = 4096
#: Limits a + b / sqrt(n) of the two distances, as a sample of n characters or words strays from its source by about
#: 1 / sqrt(n), and the least n from which a distance is looked at.
CLASS_LIMIT, CLASS_MIN_CHARS = (0.15, 2.6), 60
WORD_LIMIT, WORD_MIN_WORDS = (0.08, 4.4), 60
REPEAT_WINDOW = 8


def _lang(batch: pa.RecordBatch) -> list:
    return batch.column("__lang").to_pylist()


def _count(batches):
    """Rows of language, kind (0 class, 1 word, 2 words in all), what is counted, and its number."""
    for batch in batches:
        langs = _lang(batch)
        for lo, hi, data, offsets in chunks(batch.column("text")):
            names = sorted({x for x in langs[lo:hi] if x is not None}) + [None]
            code = np.array([names.index(x) for x in langs[lo:hi]], np.int64)
            w = Words(LOWER[data], offsets, ALNUM)
            out: list[list] = [[], [], [], []]
            by_class = np.zeros((len(names), CLASSES + 1), np.int64)
            np.add.at(by_class, code, class_counts(data, offsets))
            totals = np.bincount(code[w.row], minlength=len(names))
            for k, name in enumerate(names):
                if (code == k).any():
                    out[0] += [name] * (CLASSES + 1)
                    out[1] += [0] * CLASSES + [2]
                    out[2] += [*map(str, range(CLASSES)), ""]
                    out[3] += [*by_class[k, :CLASSES].tolist(), int(totals[k])]
            word_code = code[w.row].astype(np.uint64)
            _, first, n = np.unique(mix(w.hash + word_code), return_index=True, return_counts=True)
            out[0] += [names[c] for c in code[w.row[first]]]
            out[1] += [1] * len(first)
            out[2] += [w.word(k).decode("utf-8", "replace") for k in first]
            out[3] += n.tolist()
            yield pa.record_batch([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64())], names=["lang", "kind", "what", "n"])


def class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return np.bincount(row * (CLASSES + 1) + CLASS[data], minlength=(len(offsets) - 1) * (CLASSES + 1)).reshape(-1, CLASSES + 1)


def _known_languages(docs: DataFrame, lang_col: str, most: int) -> DataFrame:
    """docs with __lang: its language, or a pool name for those beyond the most frequent ones."""
    if lang_col not in docs.columns:
        return docs.withColumn("__lang", F.lit(None).cast("string"))
    langs = docs.groupBy(F.col(lang_col).cast("string").alias("l")).count().orderBy(F.desc("count"), "l").limit(most + 1).collect()
    if len(langs) <= most:
        return docs.withColumn("__lang", F.col(lang_col).cast("string"))
    top = [r[0] for r in langs[:most] if r[0] is not None]
    return docs.withColumn("__lang", F.when(F.col(lang_col).cast("string").isin(top), F.col(lang_col).cast("string")))


def language_references(docs: DataFrame, lang_col: str = "lang", common_words: int = COMMON_WORDS) -> DataFrame:
    """By language: its character classes (kind 0), most common words (1) and number of words (2), over all documents.

    docs must have __lang (see judge). Words are counted where they are, partly summed before the shuffle, and only
    the first few of each task and language move on to the ranking.
    """
    counted = docs.select("__lang", "text").transform(in_batches).mapInArrow(_count, "lang string, kind int, what string, n bigint")
    sums = counted.groupBy("lang", "kind", "what").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "what"))
    return sums.withColumn("rank", rank).where(F.col("rank") <= common_words)


class References:
    def __init__(self, rows, common_words: int):
        self.langs = sorted({r["lang"] for r in rows if r["lang"] is not None}) + [None]
        n = len(self.langs)
        at = {x: k for k, x in enumerate(self.langs)}
        self.classes, self.words, total = np.zeros((n, CLASSES)), np.zeros((n, common_words + 1)), np.zeros(n)
        self.at, keys, bins = at, [], []
        used = dict.fromkeys(range(n), 0)
        for r in sorted(rows, key=lambda r: (r["kind"], r["rank"])):
            k = at[r["lang"]]
            if r["kind"] == 0:
                self.classes[k, int(r["what"])] = r["n"]
            elif r["kind"] == 2:
                total[k] = r["n"]
            else:
                data = np.frombuffer(r["what"].encode(), np.uint8)
                h = span_hash(prefix_hash(data), np.array([0]), np.array([len(data)]))
                keys.append(mix(h + np.uint64(k))[0])
                bins.append(used[k])
                self.words[k, used[k]] = r["n"]
                used[k] += 1
        self.words[:, -1] = np.maximum(0, total - self.words.sum(1))
        self.classes /= np.maximum(1, self.classes.sum(1, keepdims=True))
        self.words /= np.maximum(1, self.words.sum(1, keepdims=True))
        order = np.argsort(np.array(keys, np.uint64))
        self.keys, self.bins = np.array(keys, np.uint64)[order], np.array(bins, np.int64)[order]
        self.known = np.zeros(1 << 18, bool)
        self.known[self.keys >> np.uint64(46)] = True


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The distance (root of the divergence, base 2) of each row of p, scaled to sum 1, to the same row of q."""
    p = p / np.maximum(1e-300, p.sum(1, keepdims=True))
    m = (p + q) / 2

    def kl(a):
        return np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0).sum(1)

    return np.sqrt(np.clip((kl(p) + kl(q)) / 2, 0, 1))


def repeated_words(w: Words, size: int) -> np.ndarray:
    """Of each row, the words in windows of so many words that occur twice or more in the row."""
    at, h = w.windows(size)
    covered = np.zeros(len(w.hash) + 1, np.int64)
    if len(at):
        key = mix(h + w.row[at].astype(np.uint64))
        order = np.argsort(key, kind="stable")
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = key[order][1:] == key[order][:-1]
        again = at[order[same[1:] | same[:-1]]]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + size, -1)
    inside = np.cumsum(covered[:-1]) > 0
    return np.bincount(w.row[inside], minlength=w.rows)


def duplicate_lines(data: np.ndarray, offsets: np.ndarray, w: Words) -> np.ndarray:
    """Of each row, the lines with a word that equal an earlier line."""
    if not len(data):
        return np.zeros(w.rows, np.int64)
    breaks = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    start = start[start < len(data)]
    # a break at a row's end also starts that row's last, empty line, which has no word
    end = np.append(start[1:], len(data))
    row = np.searchsorted(offsets, start, side="right") - 1
    words = np.searchsorted(w.start, end) - np.searchsorted(w.start, start)
    stop = end - ((data[np.maximum(end, 1) - 1] == 10) & (end > start))
    full = words > 0
    key = mix(span_hash(w.prefix, start[full], stop[full]) + row[full].astype(np.uint64))
    _, first = np.unique(key, return_index=True)
    return np.bincount(row[full], minlength=w.rows) - np.bincount(row[full][first], minlength=w.rows)


def _judge(references, names: list[str], limits: tuple):
    (class_a, class_b), class_min, (word_a, word_b), word_min = limits

    def run(batches):
        ref = references.value
        for batch in batches:
            lang = np.array([ref.at.get(x, len(ref.langs) - 1) for x in _lang(batch)], np.int64)
            parts = []
            for lo, hi, data, offsets in chunks(batch.column("text")):
                k, n = lang[lo:hi], hi - lo
                w = Words(data, offsets, INK)
                n_words = np.diff(w.first)
                lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                chars = np.bincount(w.row, weights=lead[w.end] - lead[w.start], minlength=n).astype(np.int64)
                by_class = class_counts(data, offsets)[:, :CLASSES]
                marks = np.concatenate([[0], np.cumsum(SYMBOL[data])])
                symbols = marks[offsets[1:]] - marks[offsets[:-1]]
                repeats = repeated_words(w, REPEAT_WINDOW)
                plain = Words(LOWER[data], offsets, ALNUM)
                key = mix(plain.hash + k[plain.row].astype(np.uint64))
                maybe = np.flatnonzero(ref.known[key >> np.uint64(46)])
                at = np.minimum(np.searchsorted(ref.keys, key[maybe]), max(0, len(ref.keys) - 1))
                hit = ref.keys[at] == key[maybe] if len(ref.keys) else np.zeros(0, bool)
                width = ref.words.shape[1]
                histogram = np.bincount(plain.row[maybe[hit]] * width + ref.bins[at[hit]], minlength=n * width).reshape(n, width)
                n_plain = np.diff(plain.first)
                histogram[:, -1] = n_plain - histogram[:, :-1].sum(1)
                far_class = np.where(by_class.sum(1) > 0, jensen_shannon(by_class, ref.classes[k]), 0.0)
                far_words = np.where(n_plain > 0, jensen_shannon(histogram, ref.words[k]), 0.0)
                failed = (n_words < 20) | (100 * repeats > 30 * n_words)
                n_class = by_class.sum(1)
                odd = (n_class >= class_min) & (far_class > class_a + class_b / np.sqrt(np.maximum(1, n_class)))
                odd |= (n_plain >= word_min) & (far_words > word_a + word_b / np.sqrt(np.maximum(1, n_plain)))
                parts.append((n_words, chars, symbols.astype(np.int64), duplicate_lines(data, offsets, w), repeats, failed, ~failed & ~odd, far_class, far_words))
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, t) for t in (*["i8"] * 5, bool, bool, "f8", "f8")]
            yield pa.record_batch([*(batch.column(c) for c in names), *map(pa.array, columns)], names=[*names, *NEW])

    return run


NEW = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"]
NEW_DDL = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, class_distance double, word_distance double"


def judge(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", carry: list[str] | None = None, common_words: int = COMMON_WORDS, limits: tuple = (CLASS_LIMIT, CLASS_MIN_CHARS, WORD_LIMIT, WORD_MIN_WORDS), max_languages: int = MAX_LANGUAGES) -> DataFrame:
    """The carried columns (all but the text, if None) and NEW.

    References hold max_languages languages of 71 numbers each at most, which bounds the broadcast; documents of
    rarer languages, and those of none, share one reference. Null and empty texts have no words, so they fail the
    base rules. Equal rows get equal verdicts. Carried columns named like a new one are left out.
    """
    spark = docs.sparkSession
    names = [c for c in (docs.columns if carry is None else carry) if c not in NEW and c != text_col and c != "__lang"]
    known = _known_languages(docs, lang_col, max_languages)
    plain = known.select("__lang", F.col(text_col).alias("text"))
    rows = language_references(plain, common_words=common_words).collect()
    references = spark.sparkContext.broadcast(References(rows, common_words))
    inner = known.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(names)], "__lang", F.col(text_col).alias("text"))
    fields = ", ".join(f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(names))
    judged = inner.transform(in_batches).mapInArrow(_judge(references, [f"c{k}" for k in range(len(names))], limits), f"{fields}, {NEW_DDL}" if names else NEW_DDL)
    return judged.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], *NEW)


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents that judge() keeps, with their columns, text included, whatever their names."""
    text, lang = options.get("text_col", "text"), options.get("lang_col", "lang")
    inner, back = aliased(docs, {text, lang})
    # the text is carried beside the one that is judged, as judge() returns what it carries alone
    kept = judge(inner.withColumn("carried_text", F.col(text)), carry=[*[c for c in inner.columns if c != text], "carried_text"], **options).where("kept")
    return kept.withColumnRenamed("carried_text", text).select(*back)


def op4(docs: DataFrame) -> DataFrame:
    """One row per document, as the contract names them, and the two distances."""
    return judge(docs.select("doc_id", "text", "lang"), carry=["doc_id"])
