"""Near-duplicate vectors by sorted projection passes.

Equal vectors are one node with a weight. In each pass the nodes are ordered lexicographically by random hashes, the
signs of 63 projections on random directions written one after the other, and each is compared with the next WIDTH nodes
of that order, over the borders of partitions, too. Two vectors meet in a pass if their hashes agree as far as it takes
to tell WIDTH nodes from the rest; the number of passes follows from the nodes, so that a pair at the limit escapes all
of them as rarely at every size. Verified pairs of all passes are united into components.

A window has no room for all partners of a vector in a dense group. So links are then counted within the components,
whose members are compared exactly: a component of a block in one task, a larger one as pairs of blocks. Of a larger
one those members need no comparison with each other that lie within half of the limit's angle around its mean: any two
of them are linked. No pair becomes a row; tasks return sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import Scratch
from faultline.llm.linking import _by_group, components

LEAST = 0.95
#: Nodes that a node is compared with in a pass.
WIDTH = 256
#: Signs in a hash, and the share of pairs at the limit that may escape all passes.
BITS, MISSED = 63, 0.005
#: Vectors from which the cuts of the projections are taken (their medians), at most.
SAMPLE = 2000
#: Members of a block in which links are counted.
BLOCK = 4096
SEED = 11


def finite(vector: str) -> Column:
    """Whether the vector has components, all of them finite."""
    every = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(math.inf)))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & every, F.lit(False))


def passes_of(n: int, width: int, least: float, missed: float = MISSED) -> int:
    """So many passes that a pair of this similarity escapes all of them with this probability, if the hashes part the nodes evenly."""
    agrees = (1 - math.acos(least) / math.pi) ** max(1.0, math.log2(max(2, n) / width))
    return max(4, math.ceil(math.log(missed) / math.log(1 - agrees)))


def unit_rows(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, row numbers and unit vectors of the rows of each length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(offsets)
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        x = values[offsets[rows][:, None] + np.arange(d)]
        x = x / np.abs(x).max(axis=1, keepdims=True)
        yield d, rows, x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@lru_cache(maxsize=4)
def directions(d: int, passes: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, d]).standard_normal((d, passes * BITS))


def _hashes(cuts: dict[int, np.ndarray], passes: int, seed: int):
    def run(batches):
        for batch in batches:
            keys = np.zeros((batch.num_rows, passes), np.int64)
            sizes = np.zeros(batch.num_rows, np.int32)
            for d, rows, x in unit_rows(batch.column("vector")):
                sizes[rows] = d
                for lo in range(0, len(rows), 1024):
                    some = rows[lo : lo + 1024]
                    bits = np.zeros((len(some), passes, BITS + 1), bool)
                    bits[:, :, 1:] = (x[lo : lo + 1024] @ directions(d, passes, seed) > cuts.get(d, 0.0)).reshape(len(some), passes, BITS)
                    keys[some] = np.packbits(bits, axis=2).view(">i8")[:, :, 0]
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, passes, dtype=np.int32), pa.array(keys.ravel()))
            yield pa.record_batch([batch.column("node"), batch.column("vector"), pa.array(sizes), lists], names=["node", "vector", "d", "keys"])

    return run


def _classes(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number of each one's class, of n that these pairs link."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label != label[label]).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def _near(x: np.ndarray, width: int, least: float, old: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows at most width apart and linked, of which the second isn't among the first, old ones."""
    found = []
    for lo in range(0, len(x), width):
        hi = min(len(x), lo + 2 * width)
        if hi > old:
            i, j = np.nonzero(x[lo : lo + width] @ x[lo:hi].T >= least)
            right = (j > i) & (j - i <= width) & (lo + j >= old)
            found.append((lo + i[right], lo + j[right]))
    return tuple(np.concatenate(p) for p in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


#: Rows of a pass: links, as a and b; and what lies near the borders of a partition: node a, its place there, its vector.
PASS_DDL = "a bigint, b bigint, part int, place bigint, vector array<{kind}>"


def _stars(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    label = _classes(a, b, len(nodes))
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[moved]], nodes[moved]


def _windows(width: int, least: float, kind: pa.DataType):
    names = ["a", "b", "part", "place", "vector"]

    def links(a, b):
        n = len(a)
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(kind))], names=names)

    def edge(rows: pa.Table, first: int):
        n = rows.num_rows
        vectors = rows.column("vector").combine_chunks()
        return pa.record_batch([rows.column("node").combine_chunks(), pa.nulls(n, pa.int64()), pa.array(np.full(n, TaskContext.get().partitionId(), np.int32)), pa.array(np.arange(first, first + n)), vectors], names=names)

    def run(batches):
        last, read = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            if read < width:
                yield edge(new.slice(0, width - read), read)
            table = new if last is None else pa.concat_tables([last, new])
            old, read = table.num_rows - new.num_rows, read + new.num_rows
            nodes = table.column("node").to_numpy()
            for _, rows, x in unit_rows(table.column("vector")):
                a, b = _near(x, width, least, int(np.searchsorted(rows, old)))
                if len(a):
                    yield links(*_stars(nodes[rows], a, b))
            last = table.slice(max(0, table.num_rows - width)).combine_chunks()
        if last is not None and read > width:
            begin = max(width, read - width)
            yield edge(last.slice(last.num_rows - (read - begin)), begin)

    return run


def _thinned(borders: list[int], width: int) -> np.ndarray:
    """Some of the borders: each of the others is less than width behind one of them."""
    out: list[int] = []
    for b in borders:
        if not out or b >= out[-1] + width:
            out.append(b)
    return np.array(out, np.int64)


def _to_borders(starts: dict[int, int], borders: np.ndarray, width: int):
    """Rows of which a window may reach over one of the borders or those close behind it, with it as their group: few times each."""

    def run(batches):
        for batch in batches:
            place = np.array([starts[p] for p in batch.column("part").to_pylist()], np.int64) + batch.column("place").to_numpy()
            lo, hi = np.searchsorted(borders, place - 2 * width, "right"), np.searchsorted(borders, place + width, "right")
            rows = np.repeat(np.arange(len(place)), hi - lo)
            group = borders[np.arange(len(rows)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
            taken = batch.take(pa.array(rows))
            yield pa.record_batch([pa.array(group, pa.int64()), pa.array(place[rows], pa.int64()), taken.column("a"), taken.column("vector")], names=["group", "place", "node", "vector"])

    return run


def _over_borders(borders: np.ndarray, width: int, least: float):
    def then(table: pa.Table, _) -> pa.RecordBatch:
        group, place, nodes = (table.column(c).to_numpy() for c in ("group", "place", "node"))
        found = []
        for _, rows, x in unit_rows(table.column("vector")):
            cut = np.flatnonzero(np.concatenate([[True], group[rows][1:] != group[rows][:-1], [True]]))
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                at = place[rows[lo:hi]]
                part = np.searchsorted(borders, at, "right")
                i, j = np.nonzero(x[lo:hi] @ x[lo:hi].T >= least)
                over = (part[i] < part[j]) & (at[j] - at[i] <= width)
                if over.any():
                    found.append(_stars(nodes[rows[lo:hi]], i[over], j[over]))
        a, b = (np.concatenate(p) for p in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return then


def _one_pass(keyed: DataFrame, k: int, scratch: Scratch, width: int, least: float) -> DataFrame:
    """a, b of links between nodes that are at most width apart in the order of hash k; in a task, a few for each class."""
    kind = keyed.schema["vector"].dataType.elementType
    ordered = keyed.select("d", F.col("keys")[k].alias("key"), "node", "vector").repartitionByRange("d", "key", "node").sortWithinPartitions("d", "key", "node")
    seen = scratch.keep(ordered.select("node", "vector").mapInArrow(_windows(width, least, pa.float32() if kind.simpleString() == "float" else pa.float64()), PASS_DDL.format(kind=kind.simpleString())), f"pass-{k}")
    links = seen.where("b is not null").select("a", "b")
    sizes = {r.part: r.n for r in seen.where("part is not null").groupBy("part").agg((F.max("place") + 1).alias("n")).collect()}
    if len(sizes) < 2:
        return links
    starts, at = {}, 0
    for part in sorted(sizes):
        starts[part], at = at, at + sizes[part]
    borders = sorted(starts.values())[1:]
    near = seen.where("part is not null").select("a", "part", "place", "vector").mapInArrow(_to_borders(starts, _thinned(borders, width), width), f"group bigint, place bigint, node bigint, vector array<{kind.simpleString()}>")
    over = near.repartition("group").sortWithinPartitions("group", "place").mapInArrow(_by_group(_over_borders(np.array(borders, np.int64), width, least), None), "a bigint, b bigint")
    return links.unionAll(scratch.keep(over, f"over-{k}"))


def _means(batches):
    """Sums of the unit vectors of each component, of a batch each."""
    for batch in batches:
        roots = batch.column("root").to_numpy()
        out = []
        for d, rows, x in unit_rows(batch.column("vector")):
            which, label = np.unique(roots[rows], return_inverse=True)
            total = np.zeros((len(which), d))
            np.add.at(total, label, x)
            out.append((np.repeat(which, d), np.tile(np.arange(d), len(which)), total.ravel()))
        root, pos, total = (np.concatenate(p) for p in zip(*out, strict=True))
        yield pa.record_batch([pa.array(root), pa.array(pos, pa.int32()), pa.array(total)], names=["root", "pos", "total"])


def _core(least: float):
    """Whether a member lies within half of the limit's angle around its component's mean, with a margin for rounding."""
    limit = math.cos(math.acos(least) / 2) + 1e-9

    def run(batches):
        for batch in batches:
            core = np.zeros(batch.num_rows, bool)
            mean = batch.column("mean").to_numpy(zero_copy_only=False)
            for _, rows, x in unit_rows(batch.column("vector")):
                m = np.stack(mean[rows])
                size = np.sqrt((m * m).sum(axis=1))
                core[rows] = (x * m).sum(axis=1) >= limit * np.where(size > 0, size, np.inf)
            yield pa.record_batch([batch.column(c) for c in ("node", "vector", "n", "root")] + [pa.array(core)], names=["node", "vector", "n", "root", "core"])

    return run


def _counts(least: float):
    def then(table: pa.Table, _) -> pa.RecordBatch:
        group, root, side, nodes, n = (table.column(c).to_numpy() for c in ("group", "root", "side", "node", "n"))
        links = np.zeros(len(nodes), np.int64)
        for _, rows, x in unit_rows(table.column("vector")):
            g, r = group[rows], root[rows]
            cut = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (r[1:] != r[:-1]), [True]]))
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                mine, weight = side[rows[lo:hi]], n[rows[lo:hi]]
                for at in range(lo, hi, 512):
                    to = min(hi, at + 512)
                    near = x[at:to] @ x[lo:hi].T >= least
                    near &= (mine[at - lo : to - lo, None] == 0) | (mine[at - lo : to - lo, None] != mine)
                    near[np.arange(to - at), np.arange(at - lo, to - lo)] = False
                    links[rows[at:to]] += near @ weight
        return pa.record_batch([pa.array(nodes), pa.array(links)], names=["node", "links"])

    return then


def _links_within(members: DataFrame, scratch: Scratch, least: float, block: int) -> DataFrame:
    """node, links: the weight of the other nodes that each member (node, vector, n, root) is linked to in its component."""
    kind = members.schema["vector"].dataType.simpleString()
    sizes = scratch.keep(members.groupBy("root").agg(F.count("*").alias("size")), "sizes")
    large = sizes.where(F.col("size") > block)
    small = members.join(scratch.hint(sizes.where(F.col("size") <= block), "sizes"), "root")
    groups = small.select(F.xxhash64("root").alias("group"), "root", F.lit(0).alias("side"), "node", "n", "vector")
    sure = None
    if not large.isEmpty():
        inside = scratch.keep(members.join(scratch.hint(large, "sizes"), "root").select("node", "vector", "n", "root"), "inside")
        means = inside.select("root", "vector").mapInArrow(_means, "root bigint, pos int, total double").groupBy("root", "pos").agg(F.sum("total").alias("total"))
        means = scratch.keep(means.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "total"))), lambda x: x["total"]).alias("mean")), "means")
        parted = scratch.keep(inside.join(scratch.hint(means, "means"), "root").mapInArrow(_core(least), f"node bigint, vector {kind}, n bigint, root bigint, core boolean"), "parted")
        shape = parted.groupBy("root").agg(*[F.coalesce(F.sum(F.when(F.col("core") == c, F.lit(1))), F.lit(0)).alias(name) for c, name in ((True, "n_core"), (False, "n_rest"))], F.coalesce(F.sum(F.when(F.col("core"), F.col("n"))), F.lit(0)).alias("weight"))
        shape = scratch.keep(shape.select("root", F.ceil(F.col("n_core") / block).cast("int").alias("cores"), F.ceil(F.col("n_rest") / block).cast("int").alias("rests"), "weight"), "shape")
        shaped = parted.join(scratch.hint(shape, "shape"), "root")
        sure = shaped.where("core").select("node", (F.col("weight") - F.col("n")).alias("links"))
        rest = shaped.where("not core").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("rests")).cast("int"))
        met = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)))
        side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
        columns = ["root", "side", "node", "n", "vector"]
        among = met.select(F.xxhash64("root", F.lit(0), F.least("mine", "other"), F.greatest("mine", "other")).alias("group"), *columns[:1], side.alias("side"), *columns[2:])
        out = rest.where("cores > 0").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cores") - 1)))
        out = out.select(F.xxhash64("root", F.lit(1), "mine", "other").alias("group"), *columns[:1], F.lit(1).alias("side"), *columns[2:])
        core = shaped.where("core and rests > 0").withColumn("other", F.pmod(F.xxhash64("node"), F.col("cores")).cast("int")).withColumn("mine", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)))
        core = core.select(F.xxhash64("root", F.lit(1), "mine", "other").alias("group"), *columns[:1], F.lit(2).alias("side"), *columns[2:])
        groups = groups.unionAll(among).unionAll(out).unionAll(core)
    # groups of equal hashes, but different roots, stay apart
    found = groups.repartition("group").sortWithinPartitions("group", "root").mapInArrow(_by_group(_counts(least), None), "node bigint, links bigint")
    return (found if sure is None else found.unionAll(sure)).groupBy("node").agg(F.sum("links").alias("links"))


def near_vectors(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST, width: int = WIDTH, block: int = BLOCK, passes: int | None = None, seed: int = SEED) -> DataFrame:
    """id, n_links, component_id, kept of every row.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do vectors of
    different lengths. n_links counts the other rows that a row is linked to directly, rows of equal vectors included, so
    ids and rows may repeat. component_id is the smallest id of the component; null ids count only where there is no
    other. kept: whether that is the row's own id (null for null). An empty table gives no rows; other columns are left
    out. passes: so many in place of those that the number of different vectors asks for.
    """
    scratch = Scratch(rows.sparkSession, "vectors")
    rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    good = finite("vector") & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    nodes = rows.where(good).groupBy("vector").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    # numbers are written once, so every reader sees the same
    nodes = scratch.keep(nodes.select(F.monotonically_increasing_id().alias("node"), "vector", "n", "least"), "nodes")
    n, spans = nodes.agg(F.count("*"), F.collect_set(F.size("vector"))).first()
    passes = passes or passes_of(n, width, least)
    cuts: dict[int, np.ndarray] = {}
    sample = nodes.select("vector").orderBy(F.xxhash64("vector")).limit(max(16, min(SAMPLE, (SAMPLE << 10) // max([1, *spans])))).toArrow()
    for d, _, x in unit_rows(sample.column("vector")) if sample.num_rows else ():
        cuts[d] = np.median(x @ directions(d, passes, seed), axis=0)
    kind = nodes.schema["vector"].dataType.simpleString()
    keyed = scratch.keep(nodes.select("node", "vector").mapInArrow(_hashes(cuts, passes, seed), f"node bigint, vector {kind}, d int, keys array<bigint>"), "keyed")
    links = None
    for k in range(passes if n else 0):
        found = _one_pass(keyed, k, scratch, width, least)
        links = found if links is None else links.unionAll(found)
    alone = rows.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if links is None:
        return _named(alone, id_col)
    roots = scratch.keep(components(links, scratch, "stars"), "roots")
    ends = roots.select("root").distinct().select(F.col("root").alias("node"), "root")
    members = scratch.keep(nodes.join(roots.unionAll(ends), "node"), "members")
    scratch.drop("pass-*")
    scratch.drop("over-*")
    scratch.drop("keyed")
    counted = scratch.keep(_links_within(members.select("node", "vector", "n", "root"), scratch, least, block), "counted")
    classes = scratch.keep(members.groupBy("root").agg(F.min("least").alias("component")), "classes")
    linked = scratch.keep(members.select("node", "root").join(scratch.hint(classes, "classes"), "root").join(scratch.hint(counted, "counted"), "node").select("node", "component", "links"), "linked")
    known = nodes.join(scratch.hint(linked, "linked"), "node", "left").select("vector", F.coalesce("component", "least").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    found = rows.where(good).join(known, "vector").select("id", "n_links", "component_id")
    return _named(found.unionAll(alone), id_col)


def _named(found: DataFrame, id_col: str) -> DataFrame:
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    return found.select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"))


def op11(vectors: DataFrame) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    return near_vectors(vectors)


OP11_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reached AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON r.other = l.a),
lowest AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN lowest USING (vec_id)
"""
