"""SimHash near-duplicates by a Gray-order hierarchical index.

A fingerprint has 64 bits: each is set when it is set in over half the XXH64 values (seed
42) of the text's 3-word shingles, repeats included. Two fingerprints link at ``distance``
or fewer differing bits; documents of one fingerprint are one vertex.

The index. Equal fingerprints are first folded into one row. All distinct ones are sorted by
Gray rank and cut into runs: a range shuffle deals them to upper nodes, and a node's rows are
packed into groups of ``GROUP``. Each group and node factors out the bits that all its
fingerprints share (mask and pattern). A group is sent to every node whose shared bits differ
from its own in at most ``distance`` places; there are ``MOST_NODES`` nodes at most, so the
table of their masks is small whatever the input. A node's task builds a tree over its Gray
order, whose nodes hold the masks and patterns of shorter runs, and walks it against the tree of
each group it was sent, from the roots down: a pair of tree nodes adds the differences in the
bits that both share and the pair above them did not, and is dropped with all below it when the
sum passes ``distance``. Pairs of leaves that stay compare their fingerprints. Each pair of
nodes is one task's work only, either's by turns, so that nodes have equal work. Of the links found a
spanning forest is kept for each node and group: no component changes.

Defined cases: a null, empty or blank text has fingerprint zero, which links like any other.
Texts of fewer words than a shingle have one shingle, the whole sequence; texts of any length
are read whole, some shingles at a time. Rows repeating a doc_id are vertices that share an
id; rows of null doc_id come last in a component. Ties (equal fingerprints) are one vertex.
Empty tables give no rows. Columns other than doc_id and text are ignored by ``near_duplicates``
and kept by ``deduplicated``, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, over_texts, parts, written
from .components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Rows of a leaf, children of a tree node, rows of a packed group, rows of an upper node, and upper nodes at most.
LEAF, FAN, GROUP, NODE_ROWS, MOST_NODES = 32, 4, 2048, 4096, 4096


def fingerprint(text: str | None, width: int = 3, seed: int = 42, run: int = 200_000) -> int:
    """The fingerprint of one text; ``run`` shingles at a time bound the memory."""
    words = WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not words:
        return 0
    ones, n = np.zeros(64, np.int64), 0
    h = xxhash.xxh64_intdigest
    for start in range(0, max(1, len(words) - width + 1), run):
        own = words[start : start + run + width - 1]
        each = (b" ".join(x) for x in zip(*(islice(own, i, None) for i in range(width)))) if len(own) >= width else [b" ".join(own)]
        values = np.array([h(x, seed) for x in each], "<u8")
        ones += _set_bits(values)
        n += len(values)
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * ones > n)))


def _set_bits(values: np.ndarray) -> np.ndarray:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(values), 8192):
        ones += np.unpackbits(values[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return ones


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns ``keep``, fp (the 64 bits as a long) of every row."""
    return over_texts(docs, lambda texts: {"fp": np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)}, "fp long", *keep)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each value in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def gray_order(fp: Column) -> Column:
    """A signed long that orders fingerprints as their unsigned Gray ranks do."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


class GrayTree:
    """Levels of nodes over fingerprints in Gray order, roots first: the mask of the bits that a node's run shares, and their pattern."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        starts = np.arange(0, len(fps), LEAF)
        both, either = np.bitwise_and.reduceat(fps, starts), np.bitwise_or.reduceat(fps, starts)
        levels = [(both | ~either, both)]
        while len(both) > 1:
            starts = np.arange(0, len(both), FAN)
            both, either = np.bitwise_and.reduceat(both, starts), np.bitwise_or.reduceat(either, starts)
            levels.append((both | ~either, both))
        self.levels = levels[::-1]
        fill = -len(fps) % LEAF
        self.leaves = np.concatenate([fps, np.full(fill, fps[-1])]).reshape(-1, LEAF)

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``nodes``, child) of all their children on the level below."""
        kids = nodes[:, None] * FAN + np.arange(FAN)
        at, side = np.nonzero(kids < len(self.levels[level + 1][0]))
        return at, kids[at, side]


def tree_links(x: GrayTree, y: GrayTree, distance: int, chunk: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in x, places in y) of linked fingerprints, some at a time; of a tree and itself each pair once."""
    a = b = np.zeros(1, np.int64)
    la = lb = 0
    known, differ = np.zeros(1, np.uint64), np.zeros(1, np.uint8)  # bits compared so far, and differences in them
    while True:
        (mask_x, own_x), (mask_y, own_y) = x.levels[la], y.levels[lb]
        shared = mask_x[a] & mask_y[b]
        differ = differ + np.bitwise_count((own_x[a] ^ own_y[b]) & shared & ~known)
        ok = differ <= distance
        a, b, known, differ = a[ok], b[ok], shared[ok], differ[ok]
        down_x, down_y = la + 1 < len(x.levels), lb + 1 < len(y.levels)
        if not (down_x or down_y):
            break
        if down_x:
            at, a = x.children(la, a)
            b, known, differ, la = b[at], known[at], differ[at], la + 1
        if down_y:
            at, b = y.children(lb, b)
            a, known, differ, lb = a[at], known[at], differ[at], lb + 1
        if x is y:
            ok = a <= b
            a, b, known, differ = a[ok], b[ok], known[ok], differ[ok]
    for k in range(0, len(a), chunk):
        i, j = a[k : k + chunk], b[k : k + chunk]
        rest = ~known[k : k + chunk, None, None]
        apart = (x.leaves[i][:, :, None] ^ y.leaves[j][:, None, :]) & rest
        left = (distance - differ[k : k + chunk])[:, None, None]
        at, p, q = np.nonzero(np.bitwise_count(apart) <= left)
        p, q = i[at] * LEAF + p, j[at] * LEAF + q
        ok = (p < q) & (q < len(y.fps)) if x is y else (p < len(x.fps)) & (q < len(y.fps))
        if ok.any():
            yield p[ok], q[ok]


def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of i and j, pair by pair, all at once; ``root`` stays flat, each set under its least member."""
    while len(i):
        a, b = root[i], root[j]
        ok = a != b
        i, j, a, b = i[ok], j[ok], a[ok], b[ok]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root[:] = up


class GrayNode:
    """One upper node: its fingerprints' tree, and what is linked below it."""

    def __init__(self, fps: np.ndarray, distance: int):
        self.tree, self.distance, self.root = GrayTree(fps), distance, np.arange(len(fps))
        for i, j in tree_links(self.tree, self.tree, distance):
            unite(self.root, i, j)

    def meet(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links between the node and another's group: each of the group's linked rows with one of the node's."""
        n = len(self.root)
        root = np.concatenate([self.root, np.arange(n, n + len(fps))])
        for i, j in tree_links(self.tree, GrayTree(fps), self.distance):
            unite(root, i, j + n)
        self.root = root[:n]
        at = np.flatnonzero(root[n:] < n)
        return fps[at], self.tree.fps[root[n:][at]]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Links among the node's own fingerprints."""
        at = np.flatnonzero(self.root != np.arange(len(self.root)))
        return self.tree.fps[at], self.tree.fps[self.root[at]]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's fingerprints, in Gray order, as packed groups: node, seq, both (bits set in all), either, fps."""
    node, seq, left = TaskContext.get().partitionId(), 0, np.zeros(0, np.int64)

    def packed(rows: np.ndarray) -> pa.RecordBatch:
        cuts = [rows[k : k + GROUP] for k in range(0, len(rows), GROUP)]
        own = [np.full(len(cuts), node, np.int32), np.arange(seq, seq + len(cuts)), np.array([np.bitwise_and.reduce(c) for c in cuts]), np.array([np.bitwise_or.reduce(c) for c in cuts])]
        return pa.RecordBatch.from_arrays([*map(pa.array, own), pa.array([c.tobytes() for c in cuts], pa.binary())], names=["node", "seq", "both", "either", "fps"])

    for batch in batches:
        left = np.concatenate([left, batch.column(0).to_numpy()])
        if whole := len(left) // GROUP * GROUP:
            yield packed(left[:whole])
            seq, left = seq + whole // GROUP, left[whole:]
    if len(left):
        yield packed(left)


def _sent(batches: Iterator[pa.RecordBatch], nodes: tuple[np.ndarray, np.ndarray, np.ndarray], distance: int) -> Iterator[pa.RecordBatch]:
    """Each group to its own node (side 0) and to the others that may link to it (side 1)."""
    ids, mask, own = nodes
    for batch in batches:
        home, both, either = (batch.column(k).to_numpy() for k in (0, 2, 3))
        shared = both | ~either
        for r in range(batch.num_rows):
            to = ids[np.bitwise_count((own ^ both[r]) & mask & shared[r]) <= distance]
            # Of two nodes the lower is the one visited where their sum is even, the higher where it is odd.
            to = to[(to == home[r]) | (((to + home[r]) % 2 == 0) == (to < home[r]))]
            if len(to):
                rows = batch.take(pa.array(np.full(len(to), r)))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array((to != home[r]).astype(np.int32)), rows.column(0), rows.column(1), rows.column(4)], names=["node", "side", "home", "seq", "fps"])


def _solved(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node, its own groups first: the links of each node, and of it and the groups sent to it."""
    at, own, node = None, [], None

    def out(links: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)) for v in links], names=["a", "b"])

    def built() -> GrayNode | None:
        return node if node is not None or not own else GrayNode(np.concatenate(own), distance)

    for batch in batches:
        for n, side, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4)):
            if n != at:
                if (node := built()) is not None:
                    yield out(node.links())
                at, own, node = n, [], None
            fps = np.frombuffer(packed.as_buffer(), np.uint64)
            if side == 0:
                own.append(fps)
            else:
                node = built()
                yield out(node.meet(fps))
    if (node := built()) is not None:
        yield out(node.links())


def links(fps: DataFrame, distance: int = 3, node_rows: int = NODE_ROWS) -> DataFrame:
    """(a, b): links among the distinct longs of column fp that connect all that are linked."""
    spark = fps.sparkSession
    count = max(1, min(MOST_NODES, -(-fps.count() // node_rows)))
    rank = fresh(fps, "_rank")[0]
    ordered = fps.select("fp", gray_order(F.col("fp")).alias(rank)).repartitionByRange(count, rank).sortWithinPartitions(rank).select("fp")
    groups = written(ordered.mapInArrow(_groups, "node int, seq long, both long, either long, fps binary"), "gray-groups")
    rows = groups.groupBy("node").agg(F.expr("bit_and(both)").alias("both"), F.expr("bit_or(either)").alias("either")).collect()  # MOST_NODES rows at most
    both, either = (np.array([r[k] for r in rows], np.int64) for k in ("both", "either"))
    nodes = np.array([r["node"] for r in rows], np.int64), both | ~either, both
    sent = groups.mapInArrow(lambda it: _sent(it, nodes, distance), "node int, side int, home int, seq long, fps binary")
    dealt = sent.repartition(min(count, 4 * parts(spark)), "node").sortWithinPartitions("node", "side", "home", "seq")
    return dealt.mapInArrow(lambda it: _solved(it, distance), "a long, b long")


def rooted(base: DataFrame, least: Column, distance: int) -> DataFrame:
    """fp, least, root: the least of each distinct fingerprint's rows, and its component."""
    # Copies fold here, before any shuffle of whole groups: one row a fingerprint and task.
    nodes = written(base.groupBy("fp").agg(least.alias("least")), "gray-distinct")
    groups = written(components(links(nodes.select("fp"), distance)), "gray-components")
    return nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, distance: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id of its component)."""
    base = written(fingerprints(docs), "fingerprints")
    joined = rooted(base, F.min("doc_id"), distance)
    roots = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of = joined.join(roots, "root").select("fp", "component_id")
    return base.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, distance: int = 3) -> DataFrame:
    """The documents with one row of each component: that of the least doc_id, null last.

    Of a component's rows that repeat this doc_id one stays, chosen by hashes of its text and
    of the row. What stays is decided on ids and hashes; texts meet the decision in a semi-join,
    which Spark makes without a shuffle of texts while the decision is small.
    """
    key, many, row = fresh(docs, "_key", "_many", "_row")
    own = F.xxhash64(F.col("doc_id").cast("long"), "text")
    base = written(fingerprints(docs.select("doc_id", "text", own.alias("key")), "key"), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    chosen = rooted(base, first, distance).groupBy("root").agg(F.min("least").alias("r")).select(F.col("r.key").alias("key")).distinct()
    again = base.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", F.lit(True).alias(many))
    chosen = written(chosen.join(again, "key", "left").select(F.col("key").alias(key), F.coalesce(many, F.lit(False)).alias(many)), "chosen")
    keyed = docs.withColumn(key, own)
    once = keyed.join(chosen.filter(~F.col(many)).select(key), key, "left_semi").select(*docs.columns)
    if not chosen.filter(F.col(many)).head(1):
        return once
    hashed = [f.name for f in docs.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]  # those have no hash
    rest = keyed.join(chosen.filter(F.col(many)).select(key), key, "left_semi")
    one = rest.groupBy(key).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*hashed)).alias(row))
    return once.unionByName(one.select(f"{row}.*"))
