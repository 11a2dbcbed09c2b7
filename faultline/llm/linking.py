"""Linking items that share buckets into classes, without listing the pairs of a bucket.

The keys of the items' buckets are dealt to pieces of all keys, packed in arrays, and sorted there: buckets of one item
go. A key that is very frequent where it comes from is known to be shared, so its items go past the pieces, and no piece
gets all of them. Of buckets with the same members one stays. Their items then meet in tasks of bounded size that hold what is needed to verify a link. A task keeps the classes
that it has found so far, verifies only pairs of different classes, and returns a row for each class that another one
takes in: fewer than it has items, whatever the pairs. First each item goes to the largest of its buckets alone; that
finds most classes. Buckets whose items are all of one class are finished by that. Those that are left come whole in the
last round, one of more than a block as pairs of blocks, so every pair of a bucket that isn't of one class yet has been
held together once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import Scratch, in_batches, mix

#: Items and payload bytes of a block, about; a task holds two blocks at once.
BLOCK, BLOCK_BYTES = 4096, 16 << 20
#: Rounds in which each item goes to one block: the first one of all items, further ones only of buckets of several blocks.
ROUNDS = 3
#: Rows that a task gathers before it looks at them, and pairs that it looks at together.
GATHERED, PAIRS = 1 << 15, 1 << 18
#: Groups of so many items at most are taken together with others of their size.
LITTLE = 64
#: Pieces into which keys are dealt, by 10 bits; keys that are gathered before that, about; and the items of a key among
#: these beyond which it is known to be shared.
PIECE_BITS, DEALT, OFTEN = 10, 1 << 16, 128


class Comparer(Protocol):
    """Made from the rows of a task: tests of pairs of them, given as two arrays of row numbers."""

    def maybe(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A cheap test that all linked pairs pass."""

    def linked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pairs are linked."""


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, root of every node but the roots: the smallest node of its connected component.

    edges: a, b (longs, not null). Large and small stars in turn: each node is moved to the smallest node next to it,
    until nothing changes, which takes a number of rounds that grows with the logarithm of the nodes.
    """
    now = scratch.keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-0")
    state, k = None, 0
    while True:
        found = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if found == state or not found[0]:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        state, k = found, k + 1
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        turned = large.join(low, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        now = scratch.keep(turned.unionAll(low.select("m", "b")).distinct(), f"{name}-{k}")


def _pairs(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows of each group, about PAIRS at a time."""
    for size in np.unique(sizes[(sizes > 1) & (sizes <= LITTLE)]).tolist():
        i, j = np.triu_indices(size, 1)
        at, step = starts[sizes == size], max(1, PAIRS // len(i))
        for lo in range(0, len(at), step):
            yield (at[lo : lo + step, None] + i).ravel(), (at[lo : lo + step, None] + j).ravel()
    for start, size in zip(starts[sizes > LITTLE].tolist(), sizes[sizes > LITTLE].tolist(), strict=True):
        step = max(1, PAIRS // size)
        for lo in range(0, size, step):
            i, j = np.nonzero(np.arange(lo, min(size, lo + step))[:, None] < np.arange(size))
            yield start + lo + i, start + j


def _mergers(table: pa.Table, make: Callable[[pa.Table], Comparer]) -> tuple[np.ndarray, np.ndarray]:
    """The smallest root and another one of classes that merge, from rows of group (in order), side, root and a payload."""
    group, root, side = (table.column(c).to_numpy() for c in ("group", "root", "side"))
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    test = make(table)
    #: A label stands for the rows of one root in one group; above it is a label of the same class, or itself.
    _, first, label = np.unique(mix(mix(group.view(np.uint64)) + root.view(np.uint64)), return_index=True, return_inverse=True)
    above = np.arange(len(first))

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for a, b in _pairs(starts, np.diff(np.append(starts, len(group)))):
        now, k = above[label], 1
        apart = (now[a] != now[b]) & ((side[a] == 0) | (side[a] != side[b]))
        a, b = a[apart], b[apart]
        near = test.maybe(a, b)
        a, b = a[near], b[near]
        while len(a):
            # the first few pairs of each class; what they merge spares the others
            order = np.argsort(now[b], kind="stable")
            a, b = a[order], b[order]
            new = np.concatenate([[True], now[b][1:] != now[b][:-1]])
            place = np.arange(len(a)) - np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
            tried = place < k
            good = test.linked(a[tried], b[tried])
            for x, y in zip(label[a[tried][good]].tolist(), label[b[tried][good]].tolist(), strict=True):
                p, q = top(x), top(y)
                above[max(p, q)] = min(p, q)
            while (above != above[above]).any():
                above = above[above]
            now, k = above[label], 2 * k
            left = ~tried & (now[a] != now[b])
            a, b = a[left], b[left]
    mine, low = root[first], np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(low, above, mine)
    moved = low[above] != mine
    return low[above][moved], mine[moved]


def _partners(table: pa.Table, make: Callable[[pa.Table], Comparer]) -> pa.RecordBatch:
    """key and node of the rows that may be linked to another row of their group."""
    group, side = (table.column(c).to_numpy() for c in ("group", "side"))
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    test, found = make(table), np.zeros(len(group), bool)
    for a, b in _pairs(starts, np.diff(np.append(starts, len(group)))):
        meet = ((side[a] == 0) | (side[a] != side[b])) & ~(found[a] & found[b])
        a, b = a[meet], b[meet]
        near = test.maybe(a, b)
        found[a[near]] = found[b[near]] = True
    return table.select(["key", "node"]).filter(pa.array(found)).combine_chunks().to_batches()[0] if found.any() else pa.RecordBatch.from_pylist([], schema=table.select(["key", "node"]).schema)


def _mergers_of(table: pa.Table, make: Callable[[pa.Table], Comparer]) -> pa.RecordBatch:
    return pa.record_batch(list(map(pa.array, _mergers(table, make))), names=["a", "b"])


def _by_group(then: Callable, make: Callable[[pa.Table], Comparer]):
    """then(rows, make) of some whole groups at a time, of rows in the order of their groups."""

    def run(batches):
        held, rows, size = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= GATHERED or size >= BLOCK_BYTES:
                table = pa.Table.from_batches(held).combine_chunks()
                group = table.column("group").to_numpy()
                last = int(np.searchsorted(group, group[-1]))
                if last:
                    yield then(table.slice(0, last).combine_chunks(), make)
                    table = table.slice(last).combine_chunks()
                # what is held counts anew from the next batch on: a group is never cut
                held, rows, size = table.to_batches(), 0, 0
        if held:
            yield then(pa.Table.from_batches(held).combine_chunks(), make)

    return run


def _distinct(key: np.ndarray, node: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each pair of key and node once, in the order of the keys, its size; and where the rows of each key begin, and end."""
    order = np.argsort(key)
    key, node, size = key[order], node[order], size[order]
    same = key[1:] == key[:-1]
    some = np.flatnonzero(np.append(same, False) | np.insert(same, 0, False))
    if len(some):
        order = some[np.lexsort((node[some], key[some]))]
        node[some], size[some] = node[order], size[order]
        kept = np.ones(len(key), bool)
        kept[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node, size = key[kept], node[kept], size[kept]
    return key, node, size, np.append(np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]])), len(key))


def _packed(piece: np.ndarray, key: np.ndarray, node: np.ndarray, size: np.ndarray, often: bool) -> pa.RecordBatch:
    """A row for each piece, of rows in the order of pieces."""
    first = np.flatnonzero(np.concatenate([np.ones(min(len(piece), 1), bool), piece[1:] != piece[:-1]]))
    ends = np.append(first, len(piece)).astype(np.int32)
    arrays = [pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends * x.itemsize), pa.py_buffer(np.ascontiguousarray(x))]) for x in (key, node, size)]
    return pa.record_batch([pa.array(piece[first].astype(np.int32)), pa.array(np.full(len(first), often)), *arrays], names=["piece", "often", "keys", "nodes", "sizes"])


def _dealt(dealt: int, often: int):
    """Rows of piece, often, keys, nodes, sizes of rows of node, size, keys (64-bit numbers). Sizes are kept to some 0.4 %.

    The items of a key that is frequent among those gathered are told apart, and dealt by item; in its piece stands
    one row of size 0, which is no item.
    """
    shift = np.uint64(64 - PIECE_BITS)

    def pieces(held):
        key, node, size, cuts = _distinct(*map(np.concatenate, zip(*held, strict=True)))
        n = np.diff(cuts)
        many = np.repeat(n > often, n)
        if many.any():
            at = np.flatnonzero(many)
            at = at[np.argsort(mix(node[at].view(np.uint64)) >> shift, kind="stable")]
            yield _packed(mix(node[at].view(np.uint64)) >> shift, key[at], node[at], size[at], True)
            size = np.where(many, np.uint16(0), size)
            many[cuts[:-1]] = False
            key, node, size = key[~many], node[~many], size[~many]
        yield _packed(key >> shift, key, node, size, False)

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            packed = batch.column("keys")
            ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
            if pa.types.is_list(packed.type):
                keys = packed.values.to_numpy().view(np.uint64)
            else:
                keys, ends = np.frombuffer(packed.buffers()[2] or b"", np.uint64), ends // 8
            count = np.diff(ends)
            size = (np.maximum(batch.column("size").to_numpy(), 1).astype(np.float32).view(np.uint32) >> np.uint32(16)).astype(np.uint16)
            held.append((mix(keys[ends[0] : ends[-1]]), np.repeat(batch.column("node").to_numpy(), count), np.repeat(size, count)))
            rows += len(held[-1][0])
            if rows >= dealt:
                yield from pieces(held)
                held, rows = [], 0
        if rows:
            yield from pieces(held)

    return run


def _met(batches):
    """Rows of key, node, size, often, and in one row of a key that isn't often n, bytes and who: the keys that items share.

    Rows come in the order of pieces. A key that is often anywhere is so here, too; its rows may come again elsewhere.
    """
    names = ["key", "node", "size", "often", "n", "bytes", "who"]

    def bytes_of(size):
        return (size.astype(np.uint32) << np.uint32(16)).view(np.float32).astype(np.int64)

    def rows(key, node, size, often, first=None, sums=(0, 0, 0)):
        none = np.ones(len(key), bool)
        if first is not None:
            none[first] = False
        spread = [np.zeros(len(key), np.int64) for _ in sums]
        for x, of in zip(spread, sums, strict=True):
            x[~none] = of
        return pa.record_batch([pa.array(key.view(np.int64)), pa.array(node), pa.array(bytes_of(size)), pa.array(np.full(len(key), often)), *[pa.array(x, mask=none) for x in spread]], names=names)

    def found(held):
        key, node, size = map(np.concatenate, zip(*held, strict=True))
        marked = np.unique(key[size == 0])
        key, node, size, cuts = _distinct(key[size > 0], node[size > 0], size[size > 0])
        if not len(key):
            return
        n, first = np.diff(cuts), cuts[:-1]
        often = np.isin(key[first], marked)
        if often.any():
            at = np.repeat(often, n)
            yield rows(key[at], node[at], size[at], True)
        plain = ~often & (n > 1)
        if plain.any():
            at, n = np.repeat(plain, n), n[plain]
            key, node, size = key[at], node[at], size[at]
            first = np.cumsum(n) - n
            sums = n, np.add.reduceat(bytes_of(size), first), np.bitwise_xor.reduceat(mix(node.view(np.uint64)), first).view(np.int64)
            yield rows(key, node, size, False, first, sums)

    held, now = [], None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("piece", "often", "keys", "nodes", "sizes")]
        for piece, often, *packed in zip(*columns, strict=True):
            if held and piece != now:
                yield from found(held)
                held = []
            now = piece
            arrays = [np.frombuffer(x, t) for x, t in zip(packed, (np.uint64, np.int64, np.uint16), strict=True)]
            if often:
                yield rows(*arrays, True)
            else:
                held.append(arrays)
    if held:
        yield from found(held)


def shared_buckets(rows: DataFrame, scratch: Scratch, *, dealt: int = DEALT, often: int = OFTEN) -> tuple[DataFrame, DataFrame]:
    """key, node, size of the keys that two different nodes have, each pair once; and key, n, bytes, who of these keys.

    rows: node, size, keys. Keys come out scrambled; who tells sets of nodes apart.
    """
    sent = rows.select("node", F.col("size").cast("long").alias("size"), "keys").mapInArrow(_dealt(dealt, often), "piece int, often boolean, keys binary, nodes binary, sizes binary")
    sent = sent.transform(in_batches).repartition("piece").sortWithinPartitions("piece")
    met = scratch.keep(sent.mapInArrow(_met, "key bigint, node bigint, size bigint, often boolean, n bigint, bytes bigint, who bigint"), "met")
    many = met.where("often").groupBy("key", "node").agg(F.max("size").alias("size"))
    counted = many.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.bit_xor(F.xxhash64("node")).alias("who"))
    return met.where("not often").select("key", "node", "size").unionAll(many), met.where("n is not null").select("key", "n", "bytes", "who").unionAll(counted)


def link(rows: DataFrame, payload: Callable[[DataFrame, str], DataFrame], make: Callable[[pa.Table], Comparer], scratch: Scratch, *, sketches: Callable[[], DataFrame] | None = None, sieve: Callable[[pa.Table], Comparer] | None = None, block: int = BLOCK, block_bytes: int = BLOCK_BYTES, rounds: int = ROUNDS) -> DataFrame:
    """node, root of the linked items, but for the roots themselves: the smallest node of each class.

    rows: node, size (longs) and keys (64-bit numbers, as an array or packed; rows may repeat): an item, the bytes of its
    payload, and its buckets. payload(nodes,
    name): node and what the comparer needs, of these nodes, maybe more than once. make: the comparer of a table of such rows. With sketches
    (which gives node and columns of few bytes; called when the keys are dealt) and sieve, a comparer of them, only items that may be linked to a bucket mate get
    their payload.
    """
    shared, counted = shared_buckets(rows, scratch)

    def cut(shared: DataFrame, name: str, counted: DataFrame | None = None) -> DataFrame:
        """key, node, size, n, root: one bucket of those with the same members, n its items and blocks its parts."""
        if counted is None:
            counted = shared.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.bit_xor(F.xxhash64("node")).alias("who"))
        blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / block_bytes)).cast("int")
        members = counted.where("n > 1").groupBy("n", "who").agg(F.min("key").alias("key"), F.max("bytes").alias("bytes")).select("key", "n", blocks.alias("blocks"))
        members = scratch.keep(members, f"{name}-members")
        return scratch.keep(shared.join(scratch.hint(members, f"{name}-members"), "key").select("key", "node", "size", "n", "blocks", F.col("node").alias("root")), name)

    now = cut(shared, "now-0", counted)
    scratch.drop("met")
    scratch.settle()
    if sieve is not None:
        # both sides grow with the items, so they are shuffled whatever their size
        full = sketches().join(_all_blocks(now), "node").repartition("group").sortWithinPartitions("group")
        near = scratch.keep(full.mapInArrow(_by_group(_partners, sieve), "key bigint, node bigint").distinct(), "sieved")
        now = cut(now.select("key", "node", "size").join(scratch.hint(near, "sieved"), ["key", "node"]), "now-sieved")
        scratch.drop("now-0")
        scratch.settle()
    held = scratch.keep(payload(now.select("node").distinct(), "payload"), "payload")
    roots, last, k = None, False, 0
    while not last:
        if k:
            now = _mixed(now, roots, scratch, k)
            scratch.drop(f"now-{k - 1}")
        if now.isEmpty():
            break
        last = k == rounds or (k > 0 and now.where("blocks > 1").isEmpty())
        if last:
            groups = _all_blocks(now)
        else:
            groups = _one_block(now if k == 0 else now.where("blocks > 1"), k)
        groups = scratch.keep(groups, f"groups-{k}")
        full = held.join(scratch.hint(groups, f"groups-{k}"), "node").repartition("group").sortWithinPartitions("group")
        found = scratch.keep(full.mapInArrow(_by_group(_mergers_of, make), "a bigint, b bigint"), f"links-{k}")
        scratch.drop(f"groups-{k}")
        if k == 0:
            # no item is in two groups: what a task has found are the classes
            roots = scratch.keep(found.select(F.col("b").alias("node"), F.col("a").alias("root")), "roots-0")
        else:
            moved = scratch.keep(components(found, scratch, f"stars-{k}"), f"moved-{k}")
            scratch.drop(f"stars-{k}-*")
            to = scratch.hint(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), f"moved-{k}")
            roots = roots.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root")).unionAll(moved)
            roots = scratch.keep(roots, f"roots-{k}")
        k += 1
    scratch.drop("payload")
    return now.select("node", "root").where("false") if roots is None else roots


def _mixed(now: DataFrame, roots: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """The buckets that hold items of several classes, with each item's class."""
    rooted = now.select("key", "node", "n", "blocks").join(scratch.hint(roots, f"roots-{k - 1}"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    ends = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    ends = scratch.keep(ends, f"mixed-{k}")
    return scratch.keep(rooted.join(scratch.hint(ends, f"mixed-{k}"), "key"), f"now-{k}")


def _one_block(now: DataFrame, k: int) -> DataFrame:
    """Each item once: in one block, another in each round, of the largest of its buckets."""
    best = now.groupBy("node").agg(F.max_by(F.struct("key", "blocks", "root"), F.struct("n", "key")).alias("b")).select("node", "b.*")
    block = F.pmod(F.xxhash64("node", F.lit(k)), F.col("blocks"))
    return best.select("node", "root", F.xxhash64("key", block).alias("group"), F.lit(0).alias("side"))


def _all_blocks(now: DataFrame) -> DataFrame:
    """Each pair of blocks of a bucket as a group, in which only items of different blocks meet; and each block alone."""
    mine = now.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    return met.select("key", "node", "root", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("group"), side.alias("side"))
