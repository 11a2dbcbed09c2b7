"""The corpus operators against brute force, round trips and held-out labels, on small tables of our own and sf0.001."""

import hashlib
import math
import os
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultline.llm import chat, common, decontaminate, lines, linking, lm, minhash, mixing, quality_classifier, quality_rules, toxicity, warc

DATA = "/root/testdata/sf0.001"
EDGES = [(None, None), (1, ""), (2, "  \n\t "), (3, None), (4, "one two"), (4, "one two"), (5, "\x00 #*$ é")]


def text(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def low(t):
    return (t or "").translate({k: k + 32 for k in range(65, 91)})


def ink(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def docs(spark):
    base = [text(k, 60) for k in range(12)]
    near = [b.split() for b in base]
    rows = [(k, b) for k, b in enumerate(base)]
    rows += [(100 + k, " ".join([*w[:30], "changed", *w[31:]])) for k, w in enumerate(near[:6])]  # similarity about 0.84
    rows += [(200 + k, " ".join(w[:30] + text(50 + k, 30).split())) for k, w in enumerate(near[6:9])]  # far below 0.8
    rows += [(300, base[0]), (301, base[0].upper()), *EDGES]
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", "x") for i, t in rows], "doc_id bigint, text string, lang string, source string, n_words string")


@pytest.fixture(scope="module")
def driver(spark):
    return lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")


def shingle_sets(rows):
    out = []
    for _, t in rows:
        w = ink(low(t))
        out.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


def test_near_duplicates_equal_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets, parent = shingle_sets(rows), list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] | sets[b])
            if not both or len(sets[a] & sets[b]) / both >= 0.8:
                old, new = parent[a], parent[b]
                parent = [new if p == old else p for p in parent]
    classes = Counter()
    for k, _ in enumerate(rows):
        ids = [rows[j][0] for j, p in enumerate(parent) if p == parent[k] and rows[j][0] is not None]
        classes[(rows[k][0], min(ids, default=None), parent.count(parent[k]))] += 1
    got = minhash.op5(docs)
    assert Counter(map(tuple, got.collect())) == classes


def test_near_duplicates_with_a_repeated_passage(spark):
    rows = []
    for k in range(20):
        base = text(2000 + k, 104)
        rows += [(k, base), (100 + k, f"{base} " + " ".join([text(3000 + k, 20)] * 10))]
    sets = shingle_sets(rows)
    assert all(len(a & b) / len(a | b) >= 0.8 for a, b in zip(sets[::2], sets[1::2], strict=True))
    got = minhash.op5(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {tuple(r) for r in got.collect()} == {(i, i % 100, 2) for i, _ in rows}


def test_keep_one_keeps_a_row_of_each_class(docs):
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == Counter([*range(12), 200, 201, 202, 1, 4, 5])


def test_repeated_lines_go_but_for_the_first(spark):
    a, b = text(1, 20), text(2, 20)
    w = a.split()
    almost = " ".join([*w[:10], w[10] + "s", *w[11:]])
    rows = [(3, f"{a}\nshort line\n{b}"), (1, f"{b}\nshort line"), (2, f"{text(3, 20)}\n{a}!\n{a}"), (None, a), (7, None), (8, ""), (9, almost)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, line int")
    got = {r.doc_id: r for r in lines.dedup_lines(df).collect()}
    assert got[1].text == f"{b}\nshort line" and got[3].text == "short line"
    assert got[2].text == f"{text(3, 20)}\n{a}!" and got[2].n_lines_removed == 1
    assert got[None].emptied and got[7].text is None and got[8].text == "" and not got[8].emptied
    assert got[9].text == ""
    assert set(lines.drop_repeats(df).columns) == set(df.columns)


def test_short_lines_are_collapsed(spark):
    rows = [(1, "released under the mit license\none\n--"), (2, f"Released under the MIT license.\n{text(5, 12)}\n--"), (3, "one\nreleased under the mit licence\n\n"), (4, "One!")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.text, r.n_lines_removed, r.emptied) for r in lines.op7(df).collect()}
    assert got == {1: (rows[0][1], 0, False), 2: (f"{text(5, 12)}\n--", 1, False), 3: ("released under the mit licence\n\n", 1, False), 4: ("", 1, True)}
    assert {r.doc_id for r in lines.drop_repeats(df).collect()} == {1, 2, 3}


def test_near_lines_equal_brute_force(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            left, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
        return row[-1]

    rng, all_lines = random.Random(8), []
    for k in range(40):
        w = text(1000 + k, (8, 9, 10, 15, 20, 40, 100, 300)[k % 8]).split()
        all_lines.append(w)
        for share in (0.1, 0.2, 0.25):
            v = list(w)
            for _ in range(int(share * len(w) + 1e-9)):
                at = rng.randrange(len(v))
                v[at : at + 1] = rng.choice(([], [text(rng.random(), 1), v[at]], [text(rng.random(), 1)], ["the"]))
            if len(v) >= 8:
                all_lines.append(v)
    group = list(range(len(all_lines)))
    for a, x in enumerate(all_lines):
        for b, y in enumerate(all_lines[:a]):
            most = max(len(x), len(y)) // 5
            if abs(len(x) - len(y)) <= most and distance(x, y) <= most:
                group = [group[b] if g == group[a] else g for g in group]
    firsts = {group.index(g) for g in group}
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(all_lines)], "doc_id bigint, text string")
    assert {r.doc_id for r in lines.op7(df).where("n_lines_removed = 0").collect()} == firsts and len(firsts) < 80


def test_long_lines_meet_though_all_their_rare_words_differ(spark):
    common = text(70, 80).split()
    rows, want = [], {}
    for k, n in enumerate((35, 40, 60, 100, 200)):
        most = n // 5
        base = random.Random(k).choices(common, k=n)
        for j, (edits, near) in enumerate([(0, True), (most, True), (most, False)]):
            line = list(base)
            # every rare word is another one, at places that part the pairs of words as much as edits can
            for at in range(most):
                line[5 * at + 2] = f"rare{k}x{j if at < edits else 0}x{at}"
            if not near:
                line[0] = line[1] = "other"
            rows.append((3 * k + j, " ".join(line)))
            want[3 * k + j] = j == 1
    rows += [(100 + k, " ".join(random.Random(50 + k).choices(common, k=60))) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    gone = {r.doc_id for r in lines.op7(df).where("n_lines_removed > 0").collect()}
    assert gone == {k for k, near in want.items() if near}


def test_decontamination_equals_brute_force(spark):
    passage, short = text(9, 30), "just four words here"
    items = [("i1", passage), ("i2", short), ("i3", ""), (None, text(10, 20)), ("i1b", passage)]
    rows = [(1, f"{text(1, 40)} {passage} {text(2, 5)}"), (2, text(3, 500) + " " + " ".join(passage.split()[:13])), (3, f"x {short.upper()} y"), (4, " ".join(passage.split()[:12])), (5, None), (6, "")]
    d = spark.createDataFrame([(*r, "k") for r in rows], "doc_id bigint, text string, n_hit string")
    b = spark.createDataFrame(items, "item_id string, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in decontaminate.op2(d, b).collect():
        w = word.findall(low(dict(rows)[r.doc_id]))
        hit, found = set(), set()
        for i, t in items:
            x = word.findall(low(t))
            size = min(13, len(x))
            for k in range(len(x) - size + 1 if x else 0):
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == x[k : k + size]:
                        hit |= set(range(p, p + size))
                        found.add(i or "")
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w))
    assert {r.doc_id for r in decontaminate.decontaminate(d, b).collect()} == {2, 4, 5, 6}


def test_quality_rules_equal_brute_force(docs, driver):
    for df in (docs, driver("documents")):
        rows = {(r.doc_id, r.text) for r in df.collect()}
        got = quality_rules.judge(df.select("doc_id", "text", "lang").withColumn("same", df["text"]), carry=["doc_id", "same"]).collect()
        assert len(got) == df.count()
        for r in got:
            assert (r.doc_id, r.same) in rows
            w, seen, dup = ink(r.same), set(), 0
            for line in (r.same or "").split("\n"):
                if ink(line):
                    dup += line in seen
                    seen.add(line)
            windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
            repeated = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.same or "")), dup, len(repeated))
            assert r.base_failed == (len(w) < 20 or 100 * len(repeated) > 30 * len(w)) and not (r.base_failed and r.kept)


@pytest.mark.parametrize(("module", "label", "least"), [(quality_classifier, "quality", 0.9), (toxicity, "toxic", 0.85)])
def test_classifiers_hold_out(spark, module, label, least):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    op = module.op3 if label == "quality" else module.op6
    rows = op(d, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r[label] for r in rows) / len(rows) >= least
    assert all(0 <= r.score <= 1 for r in rows)


def test_classifiers_survive_odd_tables(spark, docs):
    labels = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 1, 0), (2, 1, 0), (9, 0, 1)], "doc_id bigint, quality int, toxic int")
    for op in (quality_classifier.op3, toxicity.op6):
        assert op(docs, labels).count() == docs.count()
        assert op(docs.limit(0), labels.limit(0)).count() == 0


def test_swaps_lower_the_weight_of_groups():
    import numpy as np

    rng = random.Random(4)
    filler = [text(k, 1) for k in range(40)]
    said = []
    for k in range(200):
        bad = k % 2
        w = rng.sample(filler, 6) + (["idiot"] if bad else []) + (["women"] if bad and rng.random() < 0.8 else [])
        said.append((" ".join(w), bad))

    def learn(weight):
        data = [np.frombuffer(t.encode(), np.uint8) for t, _ in said]
        found = [toxicity.features(x, np.array([0, len(x)]))[1].astype(np.int32) for x in data]
        return toxicity.Classifier(found, np.array([float(y) for _, y in said]), counterfactual=weight)

    neutral = np.frombuffer(b"women", np.uint8)
    with_swaps, without = (learn(w).score(neutral, np.array([0, 5]))[0] for w in (5.0, 0.0))
    assert with_swaps < without


def test_lines_compared_together_have_the_distances_of_the_table():
    draw = random.Random(5)
    said = [[draw.randrange(12) for _ in range(draw.choice([1, 2, 9, 30, 63, 64, 65, 80]))] for _ in range(60)]
    said += [x[:k] + [99] + x[k + 1 :] for x in said for k in (0, 7)]
    test = lines.Worded(pa.table({"words": pa.array([np.array(x, np.uint32).tobytes() for x in said], pa.binary())}), 0.4)
    a, b = np.triu_indices(len(said), 1)

    def edits(x, y):
        row = list(range(len(y) + 1))
        for k, p in enumerate(x, 1):
            before, row = row, [k]
            for j, q in enumerate(y, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (p != q)))
        return row[-1]

    some = np.random.default_rng(1).choice(len(a), 1500, replace=False)
    got = test.linked(a[some], b[some])
    want = [edits(said[x], said[y]) <= int(max(len(said[x]), len(said[y])) * 0.6 + 1e-9) for x, y in zip(a[some], b[some], strict=True)]
    assert got.tolist() == want and 0 < sum(want) < len(want)
    short = [k for k in range(len(said)) if len(said[k]) <= lines.LANES]
    x, y = np.array(short[:-1]), np.array(short[1:])
    assert test._distances(x, y).tolist() == [edits(said[p], said[q]) for p, q in zip(x, y, strict=True)]


def test_words_of_all_lines_are_counted(spark, monkeypatch):
    seen, begin = [], lines.Rarity.__init__
    monkeypatch.setattr(lines.Rarity, "__init__", lambda self, counts: seen.append(int(counts.sum())) or begin(self, counts))
    rows = [(k, text(900 + k, 10 + k)) for k in range(40)] + EDGES
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    lines.op7(df)
    lines.drop_repeats(df)
    assert seen == [sum(len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))) for _, t in rows)] * 2


def test_mixing_keeps_its_bounds(docs, driver):
    for df in (docs, driver("documents")):
        rows = mixing.op8(df).collect()
        again = mixing.op8(df.repartition(3)).collect()
        assert sorted(rows, key=repr) == sorted(again, key=repr) and len(rows) == df.count()
        assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    total, taken = Counter(), Counter()
    for r in mixing.mix_sources(driver("documents")).collect():
        total[r.source] = r.target
        taken[r.source] += r.taken
    largest = max(len(ink(r.text)) for r in driver("documents").collect())
    assert all(abs(taken[s] - total[s]) <= 2 * largest for s in total)


def test_the_cut_of_a_mix_is_found_in_finer_bins(docs, driver, monkeypatch):
    tables = [docs, docs.unionAll(docs), driver("documents")]
    key = lambda r: repr(tuple(r))
    whole = [sorted(mixing.op8(df).collect(), key=key) for df in tables]
    monkeypatch.setattr(mixing, "AT_ONCE", 1)
    monkeypatch.setattr(mixing, "BINS", 3)
    for df, want in zip(tables, whole, strict=True):
        assert sorted(mixing.op8(df).collect(), key=key) == want
        # documents are taken as the table of decisions says, without meeting it
        left = sorted((repr(r.doc_id), r.taken) for r in mixing.mixed_documents(df).collect())
        assert left == sorted((repr(r.doc_id), r.taken) for r in want if r.taken)
        plan = mixing.mixed_documents(df)._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=broadcast" in plan


def test_archives_round_trip(spark, tmp_path):
    big = "<html>" + text(5, 300)
    rows = [(1, "http://a/ü", big), (5, None, big), (5, "http://b", "tiny"), (None, "u", None), (3, "http://c", text(6, 200)), (2, "x", big)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    folder = f"file://{tmp_path}/warc"
    written = warc.write_archives(pages, folder)
    assert written.agg({"records": "sum"}).first()[0] == len(rows)
    # what a lost attempt has left isn't read
    first = written.first().file
    (tmp_path / "warc" / f"part-999999-{first}").write_bytes((tmp_path / "warc" / first).read_bytes())
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes, r.payload_digest, (r.payload or b"").decode()) for r in warc.read_archives(spark, folder, written).collect())
    want = []
    for i, _, h in rows:
        h = h or ""
        revisit = h == big and i != 5
        want.append((i or 0, "revisit" if revisit else "response", 5 if revisit else 0, len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), "" if revisit else h))
    assert got == sorted(want)


def test_language_model_base_equals_brute_force(spark, docs, driver):
    for df in (docs.where("doc_id IS NOT NULL"), driver("documents")):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
        counts = Counter(t for i, x in rows if not held[i] for t in [*ink(low(x)), None])
        n, v = sum(counts.values()), len(counts)
        want = Counter()
        for i, x in rows:
            tokens = [*ink(low(x)), None]
            want[(i, held[i], len(tokens), sum(counts[t] > 0 for t in tokens), n, round(sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens), 6))] += 1
        got = lm.op10(df).collect()
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def weighted_tree(taught, scored, depth):
    """log10 probabilities of byte streams by a context tree of dictionaries, bit by bit."""
    counts = {}

    def steps(data):
        padded = b"\n" * depth + data
        for k, byte in enumerate(data):
            for bit in range(8):
                known = (1 << bit) | byte >> (8 - bit)
                yield padded[k : k + depth], known, byte >> (7 - bit) & 1

    for data in taught:
        for before, known, bit in steps(data):
            for d in range(depth + 1):
                counts.setdefault((before[depth - d :], known), [0, 0])[bit] += 1
    own = {k: math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi) for k, (z, o) in counts.items()}
    below, weight = Counter(), {}
    for key in sorted(own, key=lambda k: -len(k[0])):
        weighted, weight[key] = own[key], 1.0
        if len(key[0]) < depth:
            top = max(own[key], below[key])
            weighted = top + math.log(math.exp(own[key] - top) + math.exp(below[key] - top)) - math.log(2)
            weight[key] = math.exp(own[key] - math.log(2) - weighted)
        if key[0]:
            below[(key[0][1:], key[1])] += weighted
    out = []
    for data in scored:
        total = 0.0
        for before, known, bit in steps(data):
            one = None
            for d in range(depth, -1, -1):
                key = (before[depth - d :], known)
                if key in counts:
                    z, o = counts[key]
                    p = (o + 0.5) / (z + o + 1)
                    one = p if one is None else weight[key] * p + (1 - weight[key]) * one
            one = 0.5 if one is None else one
            total += math.log10(one if bit else 1 - one)
        out.append(total)
    return out


@pytest.mark.parametrize(("depth", "part"), [(2, 1 << 24), (5, 300)])
def test_scores_equal_a_brute_force_context_tree(spark, depth, part):
    from pyspark.sql import functions as F

    rows = [(k, " ".join(text(k % 7 + 10 * (k % 2), 12).split() + ["The", "end"])) for k in range(24)] + [(30, ""), (31, None), (32, "ünïcode ✓ ünïcode"), (33, "zz\n\n\tzz")]
    held = {i for i, _ in rows if i % 4 == 1}
    streams = {i: b" ".join(x.encode() for x in ink(low(t))) + b"\n" for i, t in rows}
    want = dict(zip(streams, weighted_tree([s for i, s in streams.items() if i not in held], streams.values(), depth), strict=True))
    df = spark.createDataFrame(rows, "c0 int, text string")
    got = lm.score_texts(df, F.col("c0") % 4 != 1, carry=["c0"], depth=depth, part=part, head=5).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.score - want[r.c0]) < 1e-4 * max(1, abs(want[r.c0])) and r.n_bytes == len(streams[r.c0])


def test_chat_reads_back_and_escapes(spark):
    said = "\\c1; </s> [INST] \\ é"
    rows = [(1, 0, "user", said, 1), (1, 1, "assistant", said, 1), (1, 1, "assistant", None, 1), (2, None, "tool [ROLE]", "x", 1), (None, 3, None, "", 1)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, n_turns int")
    got = {r.conv_id: r for r in chat.op1(df).collect()}
    assert set(got) == {1, 2, None, -1}
    assert got[1].loss_chars == len(said) and got[1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[2].turns_sha256 == hashlib.sha256(b"tool [ROLE]\nx\n").hexdigest()
    ok = "</s>[INST] ok [/INST]"
    assert got[-1].turns_sha256 == hashlib.sha256(f"user\n{ok}\nassistant\n{ok}\n".encode()).hexdigest()
    assert chat.unescape(chat.escape(said)) == said and not any(c in chat.escape(said) for c in chat.CONTROL)


def test_pipeline_stages_equal_brute_force(spark):
    import corpus_pipeline

    passage, long = text(900, 60), [text(700 + k, 80) for k in range(8)]
    rows = [(k, t) for k, t in enumerate(long)]
    rows += [(20, text(720, 5)), (21, " ".join([text(721, 8)] * 10))]  # too short; repeats itself
    rows += [(22, f"{text(722, 60)}\n{long[1]}\nend of it"), (23, f"{long[1]}!")]  # a line of 1; nothing but a line of 1
    w = long[2].split()
    rows += [(24, "\n".join([" ".join([*w[:20]]), " ".join(w[20:])])), (25, f"{text(725, 60)} {passage}")]  # near copy of 2 in other lines; benchmark
    rows += [(26, None), (27, ""), (26, None)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or ""), "own", i) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, n_hit bigint")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "minhash_near_dedup", "decontamination", "mixing"]
    quality = stages["quality_rules"](spark, docs, DATA)
    assert quality.columns == docs.columns
    assert {r.doc_id for r in quality.collect()} == {*range(8), 22, 23, 24, 25}
    assert all(r.kept == "own" and r.n_hit == r.doc_id for r in quality.collect())
    lines_left = stages["line_dedup"](spark, quality, DATA)
    seen = {r.doc_id: r.text for r in lines_left.collect()}
    assert set(seen) == {*range(8), 22, 24, 25} and seen[22] == f"{text(722, 60)}\nend of it" and lines_left.columns == docs.columns
    near = stages["minhash_near_dedup"](spark, lines_left, DATA)
    assert {r.doc_id for r in near.collect()} == {*range(8), 22, 25} and near.columns == docs.columns
    benchmark = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    clean = decontaminate.decontaminate(near, benchmark)
    assert {r.doc_id for r in clean.collect()} == {*range(8), 22} and clean.columns == docs.columns
    assert all(r.kept == "own" and r.n_hit == r.doc_id for r in clean.collect())
    mixed = stages["mixing"](spark, clean, DATA)
    want = {r.doc_id: r.taken for r in mixing.op8(clean).collect() if r.taken}
    assert {r.doc_id: r.taken for r in mixed.collect()} == want and mixed.columns == [*docs.columns, "taken"]


def test_pipeline_runs(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, DATA)
    assert "taken" in out.columns and 0 < out.count() <= spark.read.parquet(f"{DATA}/documents.parquet").count()


@pytest.mark.parametrize("op", [minhash.op5, lines.op7, quality_rules.op4, mixing.op8, lm.op10, minhash.keep_one, lines.drop_repeats, quality_rules.keep_good, mixing.mixed_documents])
def test_empty_tables(docs, op):
    assert op(docs.limit(0)).count() == 0


def test_other_empty_tables(spark, docs):
    benchmark = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.op2(docs.limit(0), benchmark).count() == 0 and decontaminate.decontaminate(docs.limit(0), benchmark).count() == 0
    assert decontaminate.op2(docs, benchmark).where("n_hit = 0 and n_items = 0").count() == docs.count()
    assert warc.op9(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    own = chat.op1(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))
    assert [r.conv_id for r in own.collect()] == [-1]


@pytest.mark.parametrize("stage", [minhash.keep_one, mixing.mixed_documents, lines.drop_repeats, quality_rules.keep_good])
def test_columns_of_clashing_names_come_through(spark, docs, stage):
    clashing = ["__id", "__said", "__source", "__size", "__taken", "__lang", "root", "node", "stays", "carried_3", "size", "id"]
    more = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in clashing])
    got = stage(more)
    assert [c for c in got.columns if c != "taken"] == more.columns
    rows = got.collect()
    assert rows and all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in rows for c in clashing)


def test_a_large_archive_is_read_in_time_that_follows_its_size():
    records = [text(k, 40).encode() * (1 + k % 7) for k in range(4000)]
    archive = struct.pack("<II", warc.SKIPPABLE, 0) + b"".join(warc.pack(records, b""))
    began = time.process_time()
    assert list(warc.unpack(archive)) == records
    assert time.process_time() - began < 2
    with pytest.raises(ValueError, match="within a record"):
        list(warc.unpack(archive[:-3]))


def test_no_import_from_outside():
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(f"{top}/faultline"):
        if not folder.endswith("/llm"):
            for name in (n for n in names if n.endswith(".py")):
                assert "faultline.llm" not in open(f"{folder}/{name}").read()


def test_decontamination_of_repeated_words_stays_small(spark):
    n = 200_000
    d = spark.createDataFrame([(1, "word " * n), (2, f"{text(1, 30)} " + "word " * 12), (3, "word " * 13)], "doc_id bigint, text string")
    b = spark.createDataFrame([(f"i{k:02d}", "Word " * n if k == 0 else f"{text(k, 5)} " + "word " * 20) for k in range(30)], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.op2(d, b).collect()}
    assert (got[1].n_hit, got[1].n_items, got[1].longest) == (n, 30, n)
    assert (got[2].n_hit, got[2].n_items) == (0, 0) and (got[3].n_hit, got[3].n_items, got[3].longest) == (13, 30, 13)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_longest_matches_equal_brute_force(spark, block_bytes):
    rng = random.Random(3)
    vocabulary = ["aa", "b", "cc", "Dd"]
    items = {f"i{k}": " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 20, 40]))) for k in range(12)}
    docs = {k: " ".join(rng.choice(vocabulary) if rng.random() < 0.9 else "other" for _ in range(rng.randint(0, 80))) + " " + rng.choice([*items.values(), ""]) for k in range(30)}
    got = decontaminate.match_benchmark(spark.createDataFrame([*docs.items()], "doc_id bigint, text string"), spark.createDataFrame([*items.items()], "item_id string, text string"), window=5, block_bytes=block_bytes)
    for r in got.collect():
        w, most, hit, named = low(docs[r.doc_id]).split(), 0, set(), set()
        for name, t in items.items():
            x = low(t).split()
            size = min(5, len(x))
            for a in range(len(x) - size + 1):
                for p in range(len(w) - size + 1):
                    k = 0
                    while p + k < len(w) and a + k < len(x) and w[p + k] == x[a + k]:
                        k += 1
                    if k >= size:
                        hit |= set(range(p, p + size))
                        named.add(name)
                        most = max(most, k)
        assert (r.n_hit, set(r["items"]), r.longest) == (len(hit), named, most)
        for m in r.matches:
            x = low(items[m["item_id"]]).split()
            assert w[m["doc_word"] : m["doc_word"] + m["words"]] == x[m["item_word"] : m["item_word"] + m["words"]]


@pytest.mark.parametrize("packed", [True, False])
def test_keys_that_items_share_are_found_in_packed_pieces(spark, packed):
    draw = random.Random(3)
    keys = {node: [draw.randrange(400) for _ in range(5)] + [1000] * (node % 3 == 0) + [node + 5000] * 2 for node in range(-150, 150)}
    rows = [(node, 40 + node % 7, ks) for node, ks in keys.items()] * 2 + [(7, 47 - 7, keys[7])] * 200
    draw.shuffle(rows)
    held = {k: {node for node, ks in keys.items() if k in ks} for ks in keys.values() for k in ks}
    want = {int(linking.mix(np.array([k], np.uint64)).view(np.int64)[0]): nodes for k, nodes in held.items() if len(nodes) > 1}
    given = [(node, size, np.array(ks, "<i8").tobytes() if packed else ks) for node, size, ks in rows]
    table = spark.createDataFrame(given, f"node bigint, size bigint, keys {'binary' if packed else 'array<bigint>'}").repartition(3)
    shared, counted = linking.shared_buckets(table, common.Scratch(spark, "keys"), dealt=700, often=9)
    got = [(r.key, r.node) for r in shared.collect()]
    assert len(got) == len(set(got)) and set(got) == {(k, node) for k, nodes in want.items() for node in nodes}
    assert all(abs(r["size"] - 40 - r.node % 7) <= 1 for r in shared.collect())
    assert sorted((r.key, r.n) for r in counted.collect()) == sorted((k, len(nodes)) for k, nodes in want.items())
