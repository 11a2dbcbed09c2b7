"""Near vectors, vector codes and the prefix trie against brute force, on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from faultline.llm import codes, projections, queries, trie

NAN, INF = float("nan"), float("inf")


def vectors(seed=3, groups=12, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = rng.standard_normal(dim)
        for _ in range(rng.integers(1, 30)):
            noise = rng.standard_normal(dim)
            rows.append((base / np.linalg.norm(base) + rng.uniform(0, 0.45) * noise / np.linalg.norm(noise)) * rng.uniform(0.5, 2))
    rows = [(k, np.float32(v).tolist()) for k, v in enumerate(rows)]
    rows += [(1000 + k, rows[k][1]) for k in range(5)] + [(1000, rows[0][1]), (1001, [2 * x for x in rows[1][1]])]
    odd = [None, [], [0.0] * dim, [NAN] * dim, [INF] + [1.0] * (dim - 1), [None] * dim, [1.0, None] + [1.0] * (dim - 2), [1.0, 2.0], [2.0, 4.1], [-0.0] + [1.0] * (dim - 1), [0.0] + [1.0] * (dim - 1)]
    rows += [(2000 + k, v) for k, v in enumerate(odd)] + [(None, rows[2][1]), (None, None), (None, [5.0, -1.0, 3.0])]
    random.Random(seed).shuffle(rows)
    return rows


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, "x", "y", k % 3 or None) for k, (i, v) in enumerate(rows)], f"vec_id bigint, embedding array<{kind}>, node string, root string, label int")


def linked(rows):
    unit = [None if v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v) else np.array(v) / np.linalg.norm(v) for _, v in rows]
    n = len(rows)
    links = [{j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95} for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(links[i]), low, rows[i][0] == low))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("kind", "width", "block"), [("float", 256, 4096), ("double", 8, 4), ("float", 4, 3)])
def test_near_vectors_equal_brute_force(spark, kind, width, block):
    rows = vectors()
    got = projections.near_vectors(table(spark, rows, kind), width=width, block=block, passes=24)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == linked(rows)


def test_windows_reach_over_the_borders_of_partitions(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [1.0, 1e-4 * float(x), *(1e-4 * rng.standard_normal(3)).tolist()]) for k, x in enumerate(rng.standard_normal(300))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        got = projections.near_vectors(table(spark, rows, "double"), width=16, passes=1).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.n_links, r.component_id) for r in got} == {(299, 0)}


def test_the_passes_miss_as_much_at_every_size():
    assert projections.passes_of(10, 256, 0.95) == 4
    for n in (10**5, 10**7, 10**10):
        p = (1 - math.acos(0.95) / math.pi) ** math.log2(n / 256)
        assert (1 - p) ** projections.passes_of(n, 256, 0.95) <= 0.005


def coded(rows, dim):
    rows = [(i, v, label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v) and len(v) == dim]
    whole = [[max(-codes.MOST, min(codes.MOST, math.floor(4096 * float(x)))) for x in v] for _, v, _ in rows]
    width = dim // 8
    first = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, whole[k]))[:16]
    books = [[whole[k][p * width : (p + 1) * width] for k in first] for p in range(8)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for r in range(7):
        near = [[best(x[p * width : (p + 1) * width], books[p]) for p in range(8)] for x in whole]
        for p in range(8 if r < 6 else 0):
            for e in range(len(first)):
                mine = [x[p * width : (p + 1) * width] for x, n in zip(whole, near) if n[p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    errors = [sum(d for d, _ in n) for n in near]
    by = defaultdict(int)
    for (_, _, label), e in zip(rows, errors):
        by[label] += e
    sha = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in n), d, by[label], sha) for (i, _, label), n, d in zip(rows, near, errors)), key=repr)


@pytest.mark.parametrize("n", [120, 7])
def test_codes_equal_brute_force(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(k), np.float32(rng.standard_normal(24) * rng.choice([0.05, 1, 40])).tolist(), int(k % 4) or None) for k in rng.permutation(n)]
    rows += [(n + k, rows[0][1], 9) for k in range(3)] + [(0, rows[1][1], 1), (None, rows[2][1], 2)]
    rows += [(500, None, 1), (501, [], 1), (502, [NAN] * 24, 1), (503, [1.0] * 23 + [None], 1), (504, [1.0] * 16, 1), (505, [-INF] * 24, 1), (506, [1.0] * 3, 1), (507, [1e30, -1e30] * 12, None)]
    df = spark.createDataFrame([(*r, "own", 1.5) for r in rows], "vec_id bigint, embedding array<float>, label int, code string, x double")
    got = codes.op12(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == coded(rows, 24)


def test_bounds_never_drop_the_nearest_entry():
    rng = np.random.default_rng(8)
    for width, spread in ((1, 50), (6, 3), (8, 4000), (8, 1 << 26), (12, 900)):
        x, book = rng.integers(-spread, spread, (3000, width)), rng.integers(-spread, spread, (16, width))
        book[5] = book[2]
        x[:100] = book[2]
        best, far, tried = codes.nearest(x, book)
        every = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        assert (best == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all()
        assert width == 1 or tried < every.size


def trie_of(rows):
    own = defaultdict(list)
    for c, turn, role, said in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", said or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    nodes, ends = defaultdict(set), defaultdict(list)
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        seq = tuple(own.get(base, [])[:h] + mine[h:])
        for d in range(len(seq) + 1):
            nodes[seq[:d]].add(c)
        ends[seq].append(c)
    n_children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in nodes:
        if p:
            n_children[p[:-1]] += 1
    for p, c in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += n_children[p] == 0
            saved[p[:d]] += (len(c) - 1) * words
    return sorted(((min(c), len(p), min(nodes[p[:-1]]) if p else None, len(c), n_children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, c in nodes.items()), key=repr)


def conversations():
    rng = random.Random(4)
    rows = []
    for c in [*range(90), 100, 105, 107, 200, 1001, -3, -25]:
        for t in range(rng.choice([0, 1, 2, 3, 5, 9])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "a  b\n", "", None, "c"])))
    rows += [(300, t, "user", "common start") for t in range(60)] + [(301, t, "user", "common start") for t in range(40)]
    rows += [(c, t, "user", f"hot {t}") for c in range(400, 480) for t in range(3)]
    rows += [(7, None, "user", "first"), (7, None, None, None), (8, 1, "user", "twice"), (8, 1, "user", "twice"), (None, 1, "user", "nobody"), (9, 2, "a", "ab"), (9, 2, "ab", "b")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [4096, 3])
def test_trie_equals_brute_force(spark, block):
    rows = conversations()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, depth string, part int").repartition(7)
    got = trie.prefix_trie(df, block=block)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == trie_of(rows)


def test_lists_of_ids_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 2)
    rows = [(c, 0, "user", "same") for c in range(0, 2000, 20)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert sorted(map(tuple, trie.prefix_trie(df).collect()), key=repr) == trie_of(rows)


def test_sums_of_a_long_conversation(spark):
    """One conversation holds most turns: its rows and its path are dealt over several tasks."""
    rows = [(5, t, "user", f"w{t} x") for t in range(3000)] + [(6, t, "user", "y") for t in range(5)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    got = trie.prefix_trie(df, block=256).collect()
    assert sorted((r.depth, r.n_leaves) for r in got if r.conv_id == 5 and r.n_convs == 1) == [(d, 1) for d in range(1, 1 + sum(r.conv_id == 5 and r.n_convs == 1 for r in got))]
    assert len(got) == len(trie_of([r for r in rows if r[0] == 6])) + max(r.depth for r in got)


@pytest.mark.parametrize("op", [projections.op11, codes.op12, trie.op13])
def test_empty_tables(spark, op):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int, conv_id bigint, turn bigint, role string, text string")
    assert op(df).count() == 0
    nulls = spark.createDataFrame([(None,) * 7] * 2, df.schema)
    assert op(nulls).count() == (2 if op is projections.op11 else 0)


@pytest.mark.parametrize("name", ["op11_embedding_near_dedup", "op12_vector_codes", "op13_prefix_trie"])
def test_queries_agree_with_sql(spark, name):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = [tuple(r[c] for c in columns) for r in queries.queries()[name](spark, data).collect()]
    assert sorted(got, key=repr) == sorted(want.fetchall(), key=repr)
