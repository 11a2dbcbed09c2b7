"""Prefix trie of conversations, its subtree sums by heavy-path decomposition.

A node is a sequence of turns, known by its depth and 128 bits of hash: the xor of a hash of each turn with its place, so
that running sums over any parts of a conversation make it. Places and hashes of turns are running sums over a range
order; a conversation that is dealt over several tasks is put together by the sums of its pieces, so its length is no
matter.

The child with most members is the heavy one; from the root, or from a light child, down through heavy children runs a
path. Nodes find the head of their path by doubling pointers. A light child has at most half of its parent's members,
so a path down the trie changes heavy paths a logarithmic number of times. In rounds, every path adds its total to the
node that its head hangs from; when nothing is left to add, the suffix sums along each path are the subtree sums. A path
is cut into blocks of BLOCK nodes, which are summed one by one and put together by their sums.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Conversations of one block of ids share a start of up to HEADS - 1 turns, by the id's hash.
SHARED, HEADS = 20, 4
#: Nodes of a path, and ids of a list, that are taken together.
BLOCK = 4096


def _runs(keys: list[str], sums: dict[str, str]):
    """Adds, to rows in order, running values over the rows of equal keys of a task: counts or xors; and the task as part.

    sums: name of each new column, and the column that it runs over: 1 is added where that is empty.
    """
    import numpy as np
    from pyspark import TaskContext

    def run(batches):
        last, state = None, {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(k).to_pylist() for k in keys]
            rows = list(zip(*columns, strict=True))
            new = np.array([rows[0] != last] + [rows[i] != rows[i - 1] for i in range(1, n)])
            begin = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            out = []
            for name, over in sums.items():
                value = batch.column(over).to_numpy() if over else np.ones(n, np.int64)
                add = np.bitwise_xor if over else np.add
                running = add.accumulate(value)
                before = np.where(begin > 0, running[np.maximum(begin - 1, 0)], 0)
                running = np.where(begin > 0, running ^ before if over else running - before, running)
                # rows before the first new key go on from the batch before
                carried = begin < 0
                running[carried] = add(running[carried], state.get(name, 0))
                state[name] = int(running[-1])
                out.append(pa.array(running, pa.int64()))
            last = rows[-1]
            part = pa.array(np.full(n, TaskContext.get().partitionId(), np.int32))
            yield pa.record_batch([*batch.columns, *out, part], names=[*batch.schema.names, *sums, "part"])

    return run


def _running(rows: DataFrame, keys: list[str], order: list, sums: dict[str, str], scratch: Scratch, name: str) -> DataFrame:
    """rows and their running values over the rows of equal keys, in this order, however many rows a key has."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    dealt = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    ran = scratch.keep(dealt.mapInArrow(_runs(keys, sums), f"{fields}, {', '.join(f'{s} bigint' for s in sums)}, part int"), name)
    # of each key, a row for each task that it was dealt to
    whole = [F.bit_xor(over).alias(s) if over else F.count("*").alias(s) for s, over in sums.items()]
    pieces = ran.groupBy(*keys, "part").agg(*whole)
    spread = pieces.groupBy(*keys).agg(F.count("*").alias("parts")).where("parts > 1").drop("parts")
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.bit_xor(s).over(earlier) if over else F.sum(s).over(earlier), F.lit(0).cast("long")).alias(f"{s}_before") for s, over in sums.items()]
    before = scratch.keep(pieces.join(spread, keys).select(*keys, "part", *before), f"{name}-before")
    ran = ran.join(scratch.hint(before, f"{name}-before"), [*keys, "part"], "left")
    for s, over in sums.items():
        b = F.coalesce(f"{s}_before", F.lit(0).cast("long"))
        ran = ran.withColumn(s, F.col(s).bitwiseXOR(b) if over else F.col(s) + b)
    return ran.drop("part", *[f"{s}_before" for s in sums])


def rebuilt(turns: DataFrame, scratch: Scratch, *, shared: int = SHARED, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """conv, depth, t1, t2, words of the turns of every rebuilt conversation (conv, turn, role, text); and conv, turns.

    Turns of a conversation are ordered by turn (null first), role and text. t1 and t2 are hashes of depth, role and text.
    """
    placed = _running(turns, ["conv"], [F.asc_nulls_first("turn"), "role", "text"], {"place": ""}, scratch, "placed")
    placed = scratch.keep(placed.select("conv", "place", "role", "text"), "places")
    counts = placed.groupBy("conv").agg(F.max("place").alias("n"))
    # of the conversation that a start comes from: its own id, and how many of its turns there are
    base = F.col("conv") - F.col("conv") % shared
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    convs = scratch.keep(counts.select("conv", "n", base.alias("base"), h.alias("h")), "convs")
    bases = convs.where("conv = base").select("base", F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0).cast("long"))))
    convs = scratch.keep(convs.select("conv", "base", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("turns")), "shape")
    starts = placed.where((F.col("place") < heads) & (F.col("conv") % shared == 0)).withColumnRenamed("conv", "base")
    taken = convs.where("m > 0").join(starts, "base").where("place <= m").select("conv", F.col("place").alias("depth"), "role", "text")
    own = placed.join(scratch.hint(convs.select("conv", "h", "m"), "shape"), "conv").where("place > h").select("conv", (F.col("place") - F.col("h") + F.col("m")).alias("depth"), "role", "text")
    both = taken.unionAll(own)
    hashes = [F.xxhash64(F.lit(k), "depth", F.length("role"), "role", "text").alias(f"t{k}") for k in (1, 2)]
    return both.select("conv", "depth", *hashes, F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")), convs.select("conv", "turns")


def _joined_ids(batches):
    """key and first id of pieces of at most BLOCK ids, written out with commas, from rows in the order of key and id."""
    for batch in batches:
        nodes, ids = ([batch.column(c).to_pylist() for c in ("k1", "k2")], batch.column("conv").to_pylist())
        keys, out, at = list(zip(*nodes, strict=True)), [], 0
        for k in range(1, len(ids) + 1):
            if k == len(ids) or keys[k] != keys[at] or k - at == BLOCK:
                out.append((*keys[at], ids[at], ",".join(map(str, ids[at:k]))))
                at = k
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string())], names=["k1", "k2", "first", "ids"])


def _digests(batches):
    """SHA-256 of each key's pieces, one after the other."""
    key, sha = None, None
    for batch in batches:
        out = []
        for k1, k2, ids in zip(*[batch.column(c).to_pylist() for c in ("k1", "k2", "ids")], strict=True):
            if (k1, k2) != key:
                if sha is not None:
                    out.append((*key, sha.hexdigest()))
                key, sha = (k1, k2), hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield _three(out)
    if sha is not None:
        yield _three([(*key, sha.hexdigest())])


def _three(rows):
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["k1", "k2", "ends_sha256"])


def heads_of(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """k1, k2, h1, h2: of each node (k1, k2, p1, p2, heavy) the head of its path, by doubling the way that a pointer reaches."""
    at = nodes.select("k1", "k2", F.when(F.col("heavy"), F.col("p1")).otherwise(F.col("k1")).alias("h1"), F.when(F.col("heavy"), F.col("p2")).otherwise(F.col("k2")).alias("h2"), F.col("heavy").alias("open"))
    k, state = 0, scratch.keep(at, "heads-0")
    while not state.where("open").isEmpty():
        k += 1
        to = state.select(F.col("k1").alias("h1"), F.col("k2").alias("h2"), F.col("h1").alias("n1"), F.col("h2").alias("n2"), F.col("open").alias("further"))
        moved = state.where("open").join(to, ["h1", "h2"], "left")
        moved = moved.select("k1", "k2", F.coalesce("n1", "h1").alias("h1"), F.coalesce("n2", "h2").alias("h2"), F.coalesce("further", F.lit(False)).alias("open"))
        state = scratch.keep(state.where("not open").unionAll(moved), f"heads-{k}")
        scratch.drop(f"heads-{k - 1}")
    return state.drop("open")


def subtree_sums(nodes: DataFrame, values: list[str], scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """k1, k2 and the sum of each value over each node's subtree. nodes: k1, k2, p1, p2 (the parent; null: root), depth, members, values."""
    rivals = nodes.where("p1 is not null").groupBy("p1", "p2").agg(F.max(F.struct("members", "k1", "k2")).alias("best"))
    rivals = rivals.select(F.col("best.k1").alias("k1"), F.col("best.k2").alias("k2"), F.lit(True).alias("heavy"))
    marked = scratch.keep(nodes.join(rivals, ["k1", "k2"], "left").withColumn("heavy", F.coalesce("heavy", F.lit(False))), "marked")
    heads = scratch.keep(heads_of(marked, scratch), "heads")
    now = scratch.keep(marked.join(heads, ["k1", "k2"]), "on-paths")
    # of each path: its head, the node that this hangs from and that node's path
    hangs = now.where("not heavy and p1 is not null").select("k1", "k2", "p1", "p2")
    hangs = hangs.join(heads.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("h1").alias("up1"), F.col("h2").alias("up2")), ["p1", "p2"])
    hangs = scratch.keep(hangs.select(F.col("k1").alias("h1"), F.col("k2").alias("h2"), "p1", "p2", "up1", "up2"), "hangs")
    totals = scratch.keep(now.groupBy("h1", "h2").agg(*[F.sum(v).alias(v) for v in values]), "totals-0")
    given, k = None, 0
    while True:
        onward = scratch.keep(totals.join(hangs, ["h1", "h2"]), f"given-{k}")
        if onward.isEmpty():
            break
        mine = onward.select("p1", "p2", *values)
        given = mine if given is None else given.unionAll(mine)
        k += 1
        totals = scratch.keep(onward.groupBy("up1", "up2").agg(*[F.sum(v).alias(v) for v in values]).withColumnsRenamed({"up1": "h1", "up2": "h2"}), f"totals-{k}")
        scratch.drop(f"totals-{k - 1}")
    if given is not None:
        added = given.groupBy("p1", "p2").agg(*[F.sum(v).alias(f"more_{v}") for v in values]).withColumnsRenamed({"p1": "k1", "p2": "k2"})
        now = now.join(added, ["k1", "k2"], "left").withColumns({v: F.col(v) + F.coalesce(f"more_{v}", F.lit(0).cast("long")) for v in values})
    now = scratch.keep(now.select("k1", "k2", "h1", "h2", "depth", F.floor(F.col("depth") / block).alias("block"), *values), "given")
    below = Window.partitionBy("h1", "h2").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = now.groupBy("h1", "h2", "block").agg(*[F.sum(v).alias(f"b_{v}") for v in values])
    blocks = blocks.select("h1", "h2", "block", *[F.sum(f"b_{v}").over(below).alias(f"b_{v}") for v in values]).where(f"b_{values[0]} is not null")
    along = Window.partitionBy("h1", "h2", "block").orderBy(F.desc("depth"))
    summed = now.select("k1", "k2", "h1", "h2", "block", *[F.sum(v).over(along).alias(v) for v in values]).join(blocks, ["h1", "h2", "block"], "left")
    return summed.select("k1", "k2", *[(F.col(v) + F.coalesce(f"b_{v}", F.lit(0).cast("long"))).alias(v) for v in values])


def prefix_trie(rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts count as empty; rows without an id are left out. Turns of equal number are ordered by role and
    text; rows that repeat are turns of their own. A conversation that comes out without turns is a member of the root.
    An empty table has no conversations, so no root either, and gives no rows. Other columns are left out.
    """
    scratch = Scratch(rows.sparkSession, "trie")
    turns = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))])
    turns, convs = rebuilt(turns, scratch)
    turns = _running(turns, ["conv"], ["depth"], {"k1": "t1", "k2": "t2"}, scratch, "keys")
    turns = scratch.keep(turns.join(convs, "conv").select("conv", "depth", "words", "k1", "k2", F.col("k1").bitwiseXOR(F.col("t1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("t2")).alias("p2"), (F.col("depth") == F.col("turns")).alias("ends")), "turns")
    zero = F.lit(0).cast("long")
    root = convs.select("conv", zero.alias("depth"), zero.alias("words"), zero.alias("k1"), zero.alias("k2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), (F.col("turns") == 0).alias("ends"))
    members = turns.unionAll(root)
    nodes = members.groupBy("k1", "k2").agg(F.min("depth").alias("depth"), F.min("conv").alias("conv"), F.count("*").alias("members"), F.min("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    nodes = scratch.keep(nodes, "nodes")
    # ids of those that end at a node are in order over all tasks, so a list of any length is written in pieces
    ends = members.where("ends").select("k1", "k2", "conv").repartitionByRange("k1", "k2", "conv").sortWithinPartitions("k1", "k2", "conv")
    ends = ends.mapInArrow(_joined_ids, "k1 bigint, k2 bigint, first bigint, ids string").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first")
    ends = scratch.keep(ends.mapInArrow(_digests, "k1 bigint, k2 bigint, ends_sha256 string"), "ends")
    children = scratch.keep(nodes.where("p1 is not null").groupBy("p1", "p2").agg(F.count("*").alias("n_children")).withColumnsRenamed({"p1": "k1", "p2": "k2"}), "children")
    nodes = nodes.join(scratch.hint(children, "children"), ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = scratch.keep(nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("members") - 1) * F.col("words")}), "tree")
    sums = subtree_sums(nodes.drop("conv", "words", "n_children"), ["n_leaves", "saved_tokens"], scratch, block)
    # a parent's own row is wanted by each of its children
    parents = scratch.keep(children.select("k1", "k2").join(nodes.select("k1", "k2", F.col("conv").alias("parent_conv_id")), ["k1", "k2"]), "parents")
    out = nodes.select("k1", "k2", "p1", "p2", "conv", "depth", "members", "n_children").join(sums, ["k1", "k2"]).join(scratch.hint(ends, "ends"), ["k1", "k2"], "left")
    out = out.join(scratch.hint(parents.withColumnsRenamed({"k1": "p1", "k2": "p2"}), "parents"), ["p1", "p2"], "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("members").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def op13(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations."""
    return prefix_trie(conversations)


OP13_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k,
         {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT c, list(x ORDER BY k) AS own,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
             lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda y, i: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) % 4 AS h
  FROM t GROUP BY c),
rebuilt AS (
  SELECT a.c, list_concat(coalesce(b.own[1:a.h], []), coalesce(a.own[a.h + 1:], [])) AS s FROM c a LEFT JOIN c b ON b.c = a.c - a.c % 20),
m AS (SELECT c, s[1:d] AS p, d, len(s) = d AS ends FROM (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM rebuilt)),
n AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends) AS e,
         CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d].t, '[^\x20\x09-\x0D]+')) END AS words
  FROM m GROUP BY p, d),
k AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON n.p = k.p),
s AS (
  SELECT a.p, sum((b.n_children = 0)::INT)::BIGINT AS n_leaves, sum((b.n_convs - 1) * b.words)::BIGINT AS saved_tokens
  FROM (SELECT p, d, n_convs, words, n_children, unnest(range(d + 1)) AS up FROM f) b JOIN f a ON a.d = b.up AND a.p = b.p[1:b.up] GROUP BY a.p)
SELECT f.conv_id::BIGINT AS conv_id, f.d::BIGINT AS depth, u.conv_id::BIGINT AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children,
       n_leaves, saved_tokens, sha256(coalesce(f.e, '')) AS ends_sha256
FROM f JOIN s ON s.p = f.p LEFT JOIN f u ON f.d > 0 AND u.p = f.p[1:f.d - 1]
"""
