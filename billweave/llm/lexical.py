"""Ranked lexical search by dense blocked matrix products.

1. Items (the queries) are taken in groups of about ``GROUP`` terms together; a group's terms are its vocabulary.
2. One pass over the texts gives each document's number of terms and, of the vocabulary, which terms it holds how often, written
   once. From these Spark counts the documents, all terms, and the documents that hold each term.
3. In a second pass over those counts, each task takes documents in blocks. A tile of items over a slice of their vocabulary is a
   dense matrix of weights times occurrences; a tile of documents over the slice is one of impacts. BLAS multiplies them in float64:
   slices are cut so that no row of weights times the greatest impact, a million, reaches 2^53, so that all partial sums are exact,
   and slices are added up as 64-bit integers.
4. Each task keeps an item's ``k`` best documents over its blocks, equal scores by ascending id, and Spark ranks those of all tasks.

Every document is scored against every item: the items are the stated query set, in blocks. What tasks send on is ``k`` rows an item.

Defined results: null or empty texts and items have no terms; a document without a term in common with an item isn't in its
result; equal documents are ranked one by one; null ids come after all others of the same score; repeated items get a ranking each;
empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, shared_dir, slices, split_words, text_of

BEST = 10
#: Terms of items handled together, repeats included; items and documents in a tile, columns in a slice, documents in a block.
GROUP, ITEMS, DOCS, COLUMNS, BLOCK = 200_000, 256, 1024, 2048, 8192
#: No impact is above this, and no sum of float64 products may reach 2^53.
IMPACT, EXACT = 1_000_000, 1 << 53
# What separates terms (fixed values): ASCII but for letters and digits.
_LETTERS = {c: c for c in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100))} | {c: c + 32 for c in range(0x41, 0x5B)}
_TABLE = bytes(_LETTERS.get(c, 0x20) for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def occurrences(texts: list[bytes], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each text, texts of hits, their vocabulary terms, occurrences); hits are in order of texts and terms."""
    which, written, sizes = split_words([t.translate(_TABLE) for t in texts])
    known = np.fromiter((vocabulary.get(w.rstrip(b" "), -1) for w in written), np.int64, len(written))
    term = known[which] if len(which) else np.empty(0, np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)
    hit = term >= 0
    pairs, n = np.unique(text[hit] * max(1, len(vocabulary)) + term[hit], return_counts=True)
    return sizes, pairs // max(1, len(vocabulary)), pairs % max(1, len(vocabulary)), n


def counted(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, term array<int>, tf array<long>`` of every document, as a table in the shared folder."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in by_bytes(b, "text")):
            sizes, text, term, n = occurrences([t.encode("utf-8", "surrogatepass") for t in part["text"].to_pylist()], vocabulary)
            ends = pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(c, kind)) for c, kind in ((term, pa.int32()), (n, pa.int64()))]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "term", "tf"])

    path = f"{shared_dir(spark)}/lexical-{uuid.uuid4().hex}"
    docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col)).mapInArrow(run, "doc_id long, n long, term array<int>, tf array<long>").write.parquet(path)
    return spark.read.parquet(path)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(n: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What an occurrence count is worth in a document of ``n`` terms; all division rounds down."""
    if len(n) and 75 * int(n.max()) * n_docs >= 1 << 63:
        n = n.astype(object)
    m = (100 - 75 + 75 * n * n_docs // n_terms).astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def tiles(items: list[Counter], weights: list[int]) -> list[tuple[int, int, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]]:
    """Tiles of items: (first, number, slices); a slice is (vocabulary terms of its columns, and rows, columns and values of its entries).

    A term so heavy in an item that its product alone could reach 2^53 gets several columns, each with a part of its weight.
    """
    most, out = EXACT // IMPACT // 2, []
    for first in range(0, len(items), ITEMS):
        some = items[first : first + ITEMS]
        entries: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for row, counts in enumerate(some):
            for term, count in counts.items():
                whole = count * weights[term]
                for part in range(0, whole, most):
                    entries.setdefault((term, part // most), []).append((row, min(most, whole - part)))
        cuts, now, sums = [], [], [0] * len(some)
        for column in sorted(entries):
            if len(now) == COLUMNS or any(sums[row] + value > 2 * most - 1 for row, value in entries[column]):
                cuts.append(now)
                now, sums = [], [0] * len(some)
            now.append(column)
            for row, value in entries[column]:
                sums[row] += value
        cuts.append(now)
        parts = []
        for columns in (c for c in cuts if c):
            flat = np.array([(row, k, value) for k, c in enumerate(columns) for row, value in entries[c]], np.int64)
            parts.append((np.array([term for term, _ in columns]), flat[:, 0], flat[:, 1], flat[:, 2]))
        out.append((first, len(some), parts))
    return out


def block_scores(n_items: int, parts: list, n_docs: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int) -> np.ndarray:
    """Scores of a tile of items in a block of documents, from the block's hits in order of documents."""
    scores = np.zeros((n_items, n_docs), np.int64)
    for own, row, column, value in parts:
        heavy = np.zeros((n_items, len(own)))
        heavy[row, column] = value
        for part in range(int(np.max(np.unique(own, return_counts=True)[1]))):  # a term's first column, its second, and so on
            nth = np.flatnonzero(np.arange(len(own)) - np.searchsorted(own, own) == part)
            place = np.full(n_terms, -1)
            place[own[nth]] = nth
            at = place[term]
            here = at >= 0
            doc_, at_, impact_ = doc[here], at[here], impact[here]
            edges = np.searchsorted(doc_, np.arange(0, n_docs + DOCS, DOCS))
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                if a < b:
                    begin, end = k * DOCS, min(n_docs, (k + 1) * DOCS)
                    dense = np.zeros((end - begin, len(own)))
                    dense[doc_[a:b] - begin, at_[a:b]] = impact_[a:b]
                    scores[:, begin:end] += (heavy @ dense.T).astype(np.int64)
    return scores


class Best:
    """The ``k`` best documents of each item so far: by score, then id, null last."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.rows = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))] * n_items

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        held = self.rows[item]
        least = max(1, int(held[0][-1])) if len(held[0]) == self.k else 1
        at = np.flatnonzero(scores >= least)
        if not len(at):
            return
        if len(at) > self.k:  # equal scores at the limit all stay until ids decide
            at = at[scores[at] >= np.partition(scores[at], len(at) - self.k)[len(at) - self.k]]
        s, i, x = (np.concatenate(p) for p in zip(held, (scores[at], ids[at], null[at])))
        order = np.lexsort((i, x, -s))[: self.k]
        self.rows[item] = s[order], i[order], x[order]


def search(docs: DataFrame, items: DataFrame, k: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", group: int = GROUP) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``k`` best documents of each item."""
    spark = docs.sparkSession
    kind = items.schema[item_col].dataType.simpleString()
    asked = items.select(F.col(item_col).alias("item_id"), text_of(query_col))
    size = asked.agg(F.sum(F.char_length("text"))).first()[0] or 0
    groups = 1 + int(size) // (6 * group)  # a term and what follows it takes some six characters
    found = None
    for g in range(groups):
        some = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).collect()
        vocabulary: dict[bytes, int] = {}
        counts = [Counter(vocabulary.setdefault(t, len(vocabulary)) for t in terms(r["text"])) for r in some]
        if vocabulary:
            best = _best(docs, counts, vocabulary, k, id_col, text_col)
            names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(some)], f"item int, item_id {kind}")
            rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
            ranked = best.withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # at most a group's items
            found = ranked if found is None else found.unionAll(ranked)
    return found if found is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")


def _best(docs: DataFrame, items: list[Counter], vocabulary: dict[bytes, int], k: int, id_col: str, text_col: str) -> DataFrame:
    """``item, doc_id, score``: the best of every task, for each item's place in ``items``."""
    known = counted(docs, vocabulary, id_col, text_col)
    n_docs, n_terms = known.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
    held = dict(known.select(F.explode("term").alias("term")).groupBy("term").count().collect())  # at most a group's vocabulary
    plan = tiles(items, [weight(n_docs, held.get(t, 0)) for t in range(len(vocabulary))])
    size, n_items = len(vocabulary), len(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(n_items, k)
        for part in (p for b in batches for p in slices(b, BLOCK)):
            n, tf, term = (c.to_numpy(zero_copy_only=False) for c in (part["n"], part["tf"].flatten(), part["term"].flatten()))
            doc = np.repeat(np.arange(part.num_rows), part["term"].value_lengths().to_numpy(zero_copy_only=False))
            impact = impacts(n[doc], tf, n_docs, n_terms) if len(doc) else tf
            ids, null = part["doc_id"].fill_null(0).to_numpy(), part["doc_id"].is_null().to_numpy(zero_copy_only=False)
            for first, count, parts in plan:
                scores = block_scores(count, parts, part.num_rows, doc, term, impact, size)
                for i in range(count):
                    best.add(first + i, scores[i], ids, null)
        for i, (s, ids, null) in enumerate(best.rows):
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), i), pa.int32()), pa.array(ids, pa.int64(), mask=null), pa.array(s, pa.int64())], ["item", "doc_id", "score"])

    return known.mapInArrow(run, "item int, doc_id long, score long")
