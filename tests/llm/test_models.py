"""Quality votes, toxicity scores and divergence verdicts against plain Python over whole small tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from faultline.llm import quality_classifier, quality_rules, toxicity

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return (t or "").translate({k: k + 32 for k in range(65, 91)})


def crc(i):
    return zlib.crc32(b"" if i is None else str(i).encode())


@pytest.fixture(scope="module")
def table(spark):
    return lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")


def kind_of(c):
    if "a" <= c <= "z":
        return 0
    if "A" <= c <= "Z":
        return 1
    if "0" <= c <= "9":
        return 2
    if c in " \t\n\x0b\x0c\r":
        return 3
    if c in ".,;:'\"?!-()":
        return 4
    return 6 if ord(c) > 127 else 5


def divergence(p, q):
    """Jensen-Shannon distance of two counters."""
    a, b, total = sum(p.values()), sum(q.values()), 0.0
    for k in {*p, *q}:
        x, y = p[k] / a, q[k] / b
        m = (x + y) / 2
        total += (x * math.log2(x / m) if x else 0) / 2 + (y * math.log2(y / m) if y else 0) / 2
    return math.sqrt(min(1, max(0, total)))


def test_divergence_verdicts_equal_brute_force(spark, table):
    odd = [(900_001, "zz " * 5 + " ".join(f"#{k}$" for k in range(200)), "en"), (900_002, None, "xx"), (900_003, "", None), (900_004, " ".join(f"w{k}" for k in range(90)), None)]
    df = table("documents").select("doc_id", "text", "lang").unionAll(spark.createDataFrame(odd, "doc_id bigint, text string, lang string"))
    rows = df.collect()
    classes, words = {}, {}
    for r in rows:
        classes.setdefault(r.lang, Counter()).update(map(kind_of, r.text or ""))
        words.setdefault(r.lang, Counter()).update(WORD.findall(low(r.text)))
    common = {lang: {w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[:64]} for lang, c in words.items()}
    fold = lambda counts, known: Counter({w: n for w, n in counts.items() if w in known}) + Counter({None: sum(n for w, n in counts.items() if w not in known)})
    asked, verdicts = {r.doc_id: r for r in rows}, Counter()
    for r in quality_rules.op4(df).collect():
        own = asked[r.doc_id]
        mine, said = Counter(map(kind_of, own.text or "")), Counter(WORD.findall(low(own.text)))
        far_class = divergence(mine, classes[own.lang]) if mine else 0.0
        far_words = divergence(fold(said, common[own.lang]), fold(words[own.lang], common[own.lang])) if said else 0.0
        assert math.isclose(r.class_distance, far_class, abs_tol=1e-6) and math.isclose(r.word_distance, far_words, abs_tol=1e-6)
        n, m = sum(mine.values()), sum(said.values())
        far = (n >= 60 and far_class > 0.15 + 2.6 / math.sqrt(n)) or (m >= 60 and far_words > 0.08 + 4.4 / math.sqrt(m))
        assert r.kept == (not r.base_failed and not far)
        verdicts[r.base_failed, r.kept] += 1
    assert verdicts.total() == len(rows) and all(verdicts[v] for v in ((True, False), (False, False), (False, True)))


def one(fn, t):
    data = np.frombuffer((t or "").encode(), np.uint8)
    return [x.tolist() for x in fn(data, np.array([0, len(data)]))]


def test_quality_votes_equal_brute_force(spark, table):
    docs, labels = table("documents"), table("labels")
    rows = docs.select("doc_id", "text").collect()
    told = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and crc(r.doc_id) % 4 != 2}
    features = {r.doc_id: one(quality_classifier.terms, r.text)[1:] for r in rows}
    taught = sorted((np.array(t, np.int32).tobytes(), np.array(n, np.int64).tobytes(), float(told[i])) for i, (t, n) in features.items() if i in told)
    space = quality_classifier.Space([(np.frombuffer(t, np.int32), np.frombuffer(n, np.int64)) for t, n, _ in taught], np.array([y for *_, y in taught]), quality_classifier.DIMENSIONS)
    basis = space.directions.astype(float)
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-3)

    def place(t, n):
        v = sum((math.sqrt(c) * float(space.idf[k]) * basis[k] for k, c in zip(t, n, strict=True)), np.zeros(basis.shape[1]))
        return v / max(1e-9, math.sqrt(v @ v))

    known = [(place(np.frombuffer(t, np.int32), np.frombuffer(n, np.int64)), y) for t, n, y in taught]
    checked = 0
    for r in quality_classifier.op3(docs, labels).collect():
        near = sorted(((float(place(*features[r.doc_id]) @ v), y) for v, y in known), reverse=True)
        k = quality_classifier.NEIGHBOURS
        assert r.held_out == (crc(r.doc_id) % 4 == 2) and r.predicted == (r.score >= 0.7)
        if len(near) > k and near[k - 1][0] - near[k][0] < 1e-5:
            continue  # which of equally near texts vote is open
        votes = [(max(0.0, s), y) for s, y in near[:k]]
        total = sum(s for s, _ in votes)
        want = sum(s * y for s, y in votes) / total if total > 0 else sum(y for _, y in known) / len(known)
        assert abs(r.score - want) < 1e-3
        checked += 1
    assert checked > len(rows) / 2


def bins_of(t):
    return {b for w in set(WORD.findall(low(t))) for b in toxicity.word_bins(w)}


def loss(model, texts, labels, moved, counterfactual):
    """The loss that the descent lowers, from its definition: log loss, ridge on scaled weights, squared changes under swaps."""
    n, pos = len(texts), sum(labels)
    total = 0.0
    for t, y in zip(texts, labels, strict=True):
        z = model.bias + sum(float(model.weights[b]) for b in t)
        total += math.log1p(math.exp(-z)) if y else math.log1p(math.exp(z))
    with_pos, with_neg = (Counter(b for t, y in zip(texts, labels, strict=True) if y == side for b in t) for side in (1, 0))
    ridge = 0.0
    for b in np.flatnonzero(model.weights):
        odds = abs(math.log((with_pos[b] + 0.5) / (pos + 1) / ((with_neg[b] + 0.5) / (n - pos + 1))))
        ridge += (float(model.weights[b]) / max(0.05, odds)) ** 2
    changes = [sum(float(model.weights[b]) for b in gone) - sum(float(model.weights[b]) for b in come) for _, gone, come in moved]
    swapped = sum(c * c for c in changes) / len(changes)
    return total / n + toxicity.RIDGE * ridge + counterfactual * swapped, swapped


def test_toxicity_scores_and_loss_equal_their_definition(spark, table):
    rng = random.Random(3)
    said = []
    for k in range(240):
        bad = k % 3 == 0
        w = rng.sample(["alba", "brin", "corvo", "delt", "ember", "fjord", "gild", "humus", "isle", "jute"], 5)
        w += (["Moron"] if bad else []) + (["muslims"] if rng.random() < (0.7 if bad else 0.1) else [])
        rng.shuffle(w)
        said.append((k, " ".join(w), int(bad)))
    said += [(1000, "", 0), (1001, None, 0), (1002, "ember muslims", None), (1003, "ember christians", None)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in said], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in said if y is not None], "doc_id bigint, toxic int")
    taught = sorted((np.array(sorted(bins_of(t)), np.int32).tobytes(), float(y)) for i, t, y in said if y is not None and crc(i) % 3 != 1)
    texts, marks = [np.frombuffer(b, np.int32) for b, _ in taught], np.array([y for _, y in taught])
    fair, plain = (toxicity.Classifier(texts, marks, counterfactual=c) for c in (toxicity.COUNTERFACTUAL, 0.0))
    scores = {r.doc_id: r.score for r in toxicity.op6(docs, labels).collect()}
    assert len(scores) == len(said)
    for i, t, _ in said:
        z = fair.bias + sum(float(fair.weights[b]) for b in bins_of(t))
        assert math.isclose(scores[i], 1 / (1 + math.exp(-z)), abs_tol=1e-5)
    # every named text, with each other term of the kind in place of its own
    moved = toxicity.swaps(texts)
    terms = next(k for k in toxicity.IDENTITIES if "muslims" in k)
    named = sum(set(toxicity.word_bins("muslims")[:1]) <= set(t.tolist()) for t in texts)
    assert len(moved) == named * (len(terms) - 1) and named
    (full, swapped), (other, unheld) = (loss(m, texts, marks.tolist(), moved, toxicity.COUNTERFACTUAL) for m in (fair, plain))
    assert full < other and swapped < unheld / 4
    # with the penalty a neutral mention moves the score less than without
    shift = {m: abs(sum(float(m.weights[b]) for b in bins_of("muslims")) - sum(float(m.weights[b]) for b in bins_of("christians"))) for m in (fair, plain)}
    assert shift[fair] < shift[plain] / 2 and scores[1002] < 0.5
    again = toxicity.op6(table("documents"), table("labels")).collect()
    assert len(again) == table("documents").count() and all(r.held_out == (crc(r.doc_id) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in again)


@pytest.mark.parametrize("texts", [["", ""], [None, None], ["", None, ""]])
def test_tasks_of_empty_texts_only(spark, texts):
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string").coalesce(1)
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1)], "doc_id bigint, quality int, toxic int")
    assert {(r.n_words, r.base_failed, r.kept) for r in quality_rules.op4(docs).collect()} == {(0, True, False)}
    assert quality_classifier.op3(docs, labels).count() == toxicity.op6(docs, labels).count() == len(texts)
    from faultline.llm import decontaminate, lines, lm, minhash, mixing

    benchmark = spark.createDataFrame([("a", ""), (None, None)], "item_id string, text string")
    assert {(r.n_words, r.contaminated) for r in decontaminate.op2(docs, benchmark).collect()} == {(0, False)}
    for op in (minhash.op5, lines.op7, mixing.op8, lm.op10):
        assert op(docs).count() == len(texts)
