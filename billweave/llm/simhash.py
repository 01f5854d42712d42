"""SimHash near-dedup with a vantage-point tree over the distinct fingerprints.

1. Each text's 64-bit fingerprint is taken in one pass; equal fingerprints are one node from there on, so groups
   of copies never meet in a task as rows.
2. The upper levels of a vantage-point tree deal the nodes into shards: at each level a node goes to the inner or
   outer side of a vantage point by its Hamming distance. A node within ``radius`` of the border is also sent
   across it as a query, which the triangle inequality proves to be enough to lose no pair. A shard of over ``BLOCK``
   placements is searched as pairs of blocks of it, each a task of its own.
3. In each shard the tree goes on over its own nodes, pruning branches by the same bound, down to small leaves
   compared exactly. A shard returns a spanning forest of the links it found, not the links: at most one row a node.
4. Connected components over those edges, by min-label propagation with pointer jumping, cut by checkpoints.

Upper vantage points are seeded pseudo-random words, so all tasks and retries agree on them without seeing data;
the number of levels follows the number of distinct fingerprints.

Defined results: a null text is empty and gets fingerprint zero, linked like any other; repeated rows stay repeated;
a null id is passed through and never names a component unless all ids of the component are null; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, map_rows, text_of

RADIUS = 3
SHINGLE = 3
#: Nodes a shard should own, and pairs below which a branch is compared exactly.
SHARD, LEAF_PAIRS = 4096, 1 << 17
#: Placements in a block of a shard, and linked pairs held before they are folded into the forest.
BLOCK, HELD = 200_000, 1 << 20
_SEED = 20240229


def fingerprint(text: str, k: int = SHINGLE) -> int:
    """Signed 64-bit SimHash: a bit is set if set in over half of the shingles' XXH64 (seed 42)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    n = max(1, len(words) - k + 1)
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts, ends[min(k, len(words)) - 1 :])), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` of every row."""
    key = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col)), lambda: lambda c: [c[0], [fingerprint(t, k) for t in c[1]]], f"doc_id {key}, fp long")


def _vantage(level: int, branch: np.ndarray) -> np.ndarray:
    """The vantage point of each branch of a level: a mixed 64-bit word (the finaliser of splitmix64)."""
    x = (branch.astype(np.uint64) + np.uint64(_SEED + (level << 40))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def deal(fps: np.ndarray, levels: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, owned) of each placement: every row is owned by one shard and is a query in the shards it may link to.

    A pair split at a level is found once, in the outer side, where the inner one arrives as a query, or the other way round;
    which way is a bit of the vantage point, so that queries don't gather in one shard.
    """
    row, shard, own = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
    border = 31  # inner: distance 31 or less; the median of random words is 32
    for level in range(levels):
        point = _vantage(level, shard)
        d, inwards = np.bitwise_count(fps[row] ^ point).astype(np.int64), (point >> np.uint64(63)).astype(bool)
        inner, outer = d <= border, d > border
        # owned rows keep their side, and those of one side at the border query the other; queries go wherever the bound lets a partner be
        to_in = np.where(own, inner, d <= border + radius)
        to_out = np.where(own, outer, d > border - radius)
        out = own & inner & (d > border - radius) & ~inwards
        back = own & outer & (d <= border + radius) & inwards
        row, shard, own = (
            np.concatenate([row[to_in], row[to_out], row[out], row[back]]),
            np.concatenate([2 * shard[to_in], 2 * shard[to_out] + 1, 2 * shard[out] + 1, 2 * shard[back]]),
            np.concatenate([own[to_in], own[to_out], np.zeros(int(out.sum() + back.sum()), bool)]),
        )
    return row, shard, own


class Linked:
    """Linked pairs of ``n`` nodes as they are found: a forest, and the pairs not folded into it yet."""

    def __init__(self, n: int):
        self.label, self.pairs, self.held = np.arange(n), [], 0

    def append(self, pair: tuple[np.ndarray, np.ndarray]) -> None:
        self.pairs.append(pair)
        self.held += len(pair[0])
        if self.held > HELD:
            self.fold()

    def fold(self) -> np.ndarray:
        """The smallest node reachable from each."""
        known = np.flatnonzero(self.label != np.arange(len(self.label)))
        a, b = (np.concatenate([x, *(p[k] for p in self.pairs)]) for k, x in enumerate((known, self.label[known])))
        self.label, self.pairs, self.held = forest(len(self.label), a, b), [], 0
        return self.label


def _exact(h: np.ndarray, q: np.ndarray, fps: np.ndarray, radius: int, out: Linked) -> None:
    """Linked (query, owner) index pairs by comparing all, in blocks of bounded size."""
    step = max(1, (1 << 20) // max(1, len(h)))
    for i in range(0, len(q), step):
        part = q[i : i + step]
        a, b = np.nonzero(np.bitwise_count(fps[part][:, None] ^ fps[h][None, :]) <= radius)
        if len(a):
            out.append((part[a], h[b]))


def _search(h: np.ndarray, q: np.ndarray, fps: np.ndarray, radius: int, out: Linked, level: int) -> None:
    """Vantage-point tree over owners ``h``; pairs among them and with the queries ``q``."""
    if not len(h) or (len(h) < 2 and not len(q)):
        return
    if len(h) * (len(q) + len(h)) <= LEAF_PAIRS or level > 40:
        _exact(h, np.concatenate([h, q]), fps, radius, out)
        return
    point = fps[h[(level * 7919) % len(h)]]
    dh = np.bitwise_count(fps[h] ^ point).astype(np.int64)
    border = int(np.median(dh))
    if (dh <= border).all():
        border = int(dh.max()) - 1
    if border < dh.min():  # all at one distance: another point, and in the end the exact comparison, must tell them apart
        _search(h, q, fps, radius, out, level + 1)
        return
    dq = np.bitwise_count(fps[q] ^ point).astype(np.int64)
    cross = h[(dh <= border) & (dh > border - radius)]
    _search(h[dh <= border], q[dq <= border + radius], fps, radius, out, level + 1)
    _search(h[dh > border], np.concatenate([q[dq > border - radius], cross]), fps, radius, out, level + 1)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of ``n`` nodes over the edges."""
    label = np.arange(n)
    while True:
        low, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def shard_links(fps: np.ndarray, own: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, fingerprint) that connect all of a shard's linked nodes as its links do.

    They depend on the nodes alone, not on their order, which differs between runs of a task.
    """
    order = np.argsort(fps)
    fps, own = fps[order], own[order]
    out = Linked(len(fps))
    _search(np.flatnonzero(own), np.flatnonzero(~own), fps, radius, out, 0)
    label = out.fold()
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return fps[linked], fps[label[linked]]


def links(nodes: DataFrame, radius: int = RADIUS, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Edges ``u, v`` (signed fingerprints) whose components are those of all pairs of distinct ``fp`` within ``radius``."""
    n = nodes.count()
    levels = max(0, int(np.ceil(np.log2(max(1, n) / shard))))

    def place(batches):
        for pdf in batches:
            fps = pdf["fp"].to_numpy(np.int64).view(np.uint64)
            row, at, own = deal(fps, levels, radius)
            yield pd.DataFrame({"shard": at, "own": own, "fp": fps[row].view(np.int64)})

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = shard_links(pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["own"].to_numpy(bool), radius)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    placed = nodes.select("fp").mapInPandas(place, "shard long, own boolean, fp long")
    parts = placed.groupBy("shard").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).where("parts > 1")
    # a row of a large shard meets each of its blocks: once with its own, once in a task for the two
    dealt = placed.join(parts, "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = F.col("shard"), F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b")
    return dealt.select(*cell, "own", "fp").groupBy("shard", "a", "b").applyInPandas(search, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node with an edge: the smallest node of its component.

    Min-label propagation over both directions with pointer jumping; rounds grow with the logarithm of the
    longest path. Both aggregations combine before their shuffle; the joins can be split where a node is hot. The two
    directions come from one run over the edges: a second one may find other edges for the same components.
    """
    ways = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("way")
    both = cut(edges.where("u <> v").select(ways).select("way.u", "way.v").distinct())
    label = cut(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        heard = both.join(label, both.v == label.node).groupBy(F.col("u").alias("node")).agg(F.min("root").alias("heard"))
        lower = label.join(heard, "node").select("node", F.least("root", "heard").alias("to"), F.col("root").alias("was"))
        jump = label.select(F.col("node").alias("to"), F.col("root").alias("beyond"))
        new = cut(lower.join(jump, "to", "left").select("node", F.least("to", F.coalesce("beyond", "to")).alias("root"), "was"))
        if new.where("root <> was").isEmpty():
            return new.select("node", "root")
        label = new.select("node", "root")


def _grouped(docs: DataFrame, id_col: str, text_col: str, radius: int, k: int) -> DataFrame:
    """``doc_id, fp, root, component_id`` of every row; the root is a fingerprint of the group."""
    fps = cut(fingerprints(docs, id_col, text_col, k))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    edges = links(nodes, radius)
    found = components(edges)
    named = nodes.join(found, nodes.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = cut(named)
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(named.join(names, "root").select("fp", "root", "component_id"), "fp", "left").select("doc_id", "fp", "root", "component_id")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, k: int = SHINGLE) -> DataFrame:
    """``doc_id, fp, component_id`` of every row."""
    return _grouped(docs, id_col, text_col, radius, k).select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, k: int = SHINGLE) -> DataFrame:
    """The documents with one row of each group: that of its smallest id (of equal rows, or equal ids, one).

    Rows with a null id stay only where their whole group has none: then one of them.
    """
    g = cut(_grouped(docs, id_col, text_col, radius, k))
    same = g.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count("*").alias("n"))
    keep_id = free_name(docs, "keep")
    keep = cut(same.withColumnRenamed("doc_id", keep_id))

    def kept(ids: DataFrame) -> DataFrame:
        return docs.join(ids, F.col(id_col) == F.col(keep_id), "left_semi")

    out, repeated = kept(keep.where("n = 1")), keep.where("n > 1")
    if not repeated.isEmpty():
        out = out.unionByName(kept(repeated).dropDuplicates([id_col]))
    nameless = g.where("component_id is null")
    if not nameless.isEmpty():  # rows are found by their fingerprint again
        fp = free_name(docs, "fp")
        pick = nameless.groupBy("root").agg(F.min("fp").alias(keep_id)).select(keep_id)
        rows = docs.where(F.col(id_col).isNull()).withColumn(fp, _fingerprint_column(k)(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
        out = out.unionByName(rows.join(pick, F.col(fp) == F.col(keep_id), "left_semi").dropDuplicates([fp]).drop(fp))
    return out


def _fingerprint_column(k: int):
    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t, k) for t in texts.to_pylist()], pa.int64())

    return of
