"""Benchmark decontamination by SimHash windows, multi-index Hamming blocks and exact verification.

A document leaks an item if some window of exactly the item's number of words has a weighted-shingle similarity of
``similarity`` or more with it: shingles of five words, counted, each weighted by its number of different words, the
sum of the lesser counts over the sum of the greater. A document of fewer words than the item is one window, all of it.

1. Places. A window that shares no shingle with an item has similarity zero with it, so only places around a shingle of
   the benchmark get windows, of the lengths of items that have the shingle; the test is a bit table and a binary search
   over whole batches of texts.
2. Windows. At those places every window of those lengths gets its weighted 64-bit SimHash, from running sums.
3. Blocks. A fingerprint is four blocks of 16 bits. If two differ in at most ``RADIUS`` = 19 bits, some block differs in
   at most 4, so there is a value within 2 bits of both their blocks: an index that lists each item under all values within
   2 bits of each of its blocks, and is asked for all values within 2 bits of a window's, finds every item within the
   radius. At similarity 0.8 the expected distance is 9.7 bits with a standard deviation of 2.9.
4. Verification. Candidates are compared exactly.

The benchmark is read in blocks of about ``ITEMS`` items (some 10 KB of index each), so what a worker holds is bounded
whatever its size.

Defined results: null or empty texts and items without a word match nothing; an item of fewer than five words has one
shingle, all of it; of equal best windows the first is reported; repeated rows report each on its own; empty tables
give no rows; extra columns are ignored. Words are what stands between ASCII white space, in lower case and without
punctuation at either end (words of punctuation only stay as they are).
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, map_rows, split_words, text_of

SHINGLE, SIMILARITY = 5, 0.8
#: Blocks, and the bits that an item's and a window's block values are varied by.
BLOCKS, VARIED = 4, 2
RADIUS = BLOCKS * (2 * VARIED + 1) - 1
ITEMS = 5000
REMEMBER = 500_000
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_P = [np.uint64(pow(0x9E3779B97F4A7C15, SHINGLE - 1 - i, 1 << 64)) for i in range(SHINGLE)]
_FLIPS = np.array([sum(1 << b for b in bits) for r in range(VARIED + 1) for bits in combinations(range(16), r)], np.uint64)
_BITS = np.arange(64, dtype=np.uint64)


def word_hash(word: bytes) -> int:
    low = word.lower() if word.isascii() else word.decode().lower().encode()
    return xxhash.xxh64_intdigest(low.strip(_PUNCTUATION) or low)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, weights) of the shingles of a sequence of word hashes; of a shorter one, its only shingle."""
    k = min(SHINGLE, len(words))
    if not k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(words, k)
    h = np.zeros(len(rows), np.uint64)
    for i in range(k):
        h += rows[:, i] * _P[i]
    ordered = np.sort(rows, axis=1)
    return mix(h), 1 + (ordered[:, 1:] != ordered[:, :-1]).sum(axis=1)


def simhash_of(sums: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of 64 signed sums."""
    return ((sums > 0).astype(np.uint64) << _BITS).sum(axis=1, dtype=np.uint64)


def signed(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each shingle its weight, signed by each of its hash's bits."""
    return np.where(hashes[:, None] >> _BITS & np.uint64(1), weights[:, None], -weights[:, None])


def similarity_of(a: Counter, b: Counter, weight: dict) -> float:
    """Weighted Jaccard similarity of two shingle counts."""
    both = {*a, *b}
    return sum(min(a[s], b[s]) * weight[s] for s in both) / max(1, sum(max(a[s], b[s]) * weight[s] for s in both))


class Index:
    """Items' shingles, and their fingerprints under all block values within the block radius, by window length."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items, self.lengths, near = [], defaultdict(list), []
        for item_id, text in items:
            words = np.array([word_hash(w) for w in (text or "").encode().split()], np.uint64)
            if not len(words):
                continue
            h, w = shingles(words)
            fp = simhash_of(signed(h, w).sum(axis=0, keepdims=True))[0]
            self.lengths[len(words)].append(len(self.items))
            self.items.append((item_id, len(words), Counter(h.tolist()), dict(zip(h.tolist(), w.tolist())), fp))
        self.fps = np.array([x[4] for x in self.items], np.uint64)
        for i, (_, n, _, _, fp) in enumerate(self.items):
            for b in range(BLOCKS):
                values = (fp >> np.uint64(16 * b) & np.uint64(0xFFFF)) ^ _FLIPS
                near.append((self._key(n, b, values), np.full(len(values), i)))
        keys = np.concatenate([x[0] for x in near]) if near else np.empty(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], np.concatenate([x[1] for x in near])[order] if near else np.empty(0, int)
        pairs = np.array([(s, x[1]) for x in self.items for s in x[2]], np.uint64).reshape(-1, 2)
        pairs = np.unique(pairs, axis=0)  # shingles in order, each with the lengths of items that have it
        self.known, self.first = np.unique(pairs[:, 0], return_index=True)
        self.first, self.length = np.append(self.first, len(pairs)), pairs[:, 1].astype(np.int64)
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.known >> np.uint64(44)).astype(np.int64)] = True
        self.shorter = sorted({x[1] for x in self.items if x[1] < SHINGLE})

    @staticmethod
    def _key(n: int, block: int, values: np.ndarray) -> np.ndarray:
        return np.uint64(n << 18 | block << 16) | values

    def has(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes that are some item's shingle, and of the shingle among the known."""
        maybe = np.flatnonzero(self.table[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.searchsorted(self.known, hashes[maybe])
        at[at == len(self.known)] = 0
        same = self.known[at] == hashes[maybe] if len(self.known) else np.zeros(len(maybe), bool)
        return maybe[same], at[same]

    def near(self, n: int, fps: np.ndarray) -> set[tuple[int, int]]:
        """(window, item) of all items of ``n`` words within the radius of each fingerprint."""
        found = set()
        for b in range(BLOCKS):
            keys = self._key(n, b, (fps >> np.uint64(16 * b) & np.uint64(0xFFFF))[:, None] ^ _FLIPS).reshape(-1)
            low, high = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, "right")
            hit = np.flatnonzero(high > low)
            many = (high - low)[hit]
            window = np.repeat(hit // len(_FLIPS), many)
            item = self.at[np.repeat(low[hit] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            close = np.bitwise_count(fps[window] ^ self.fps[item]) <= RADIUS
            found.update(zip(window[close].tolist(), item[close].tolist()))
        return found

    def leaks(self, words: np.ndarray, places: np.ndarray, shingle: np.ndarray, similarity: float) -> list[tuple[int, float, int]]:
        """(item_id, best similarity, first word of its window) of a document, from its known shingles and their places in order."""
        best: dict[int, tuple[float, int]] = {}
        longest = max(self.lengths)
        at = np.flatnonzero(np.diff(places) > longest) + 1
        for group, known in zip(np.split(places, at), np.split(shingle, at)):
            begin, end = max(0, int(group[0]) - longest), min(len(words), int(group[-1]) + longest + SHINGLE)
            h, w = shingles(words[begin:end])
            running = np.vstack([np.zeros((1, 64), np.int64), np.cumsum(signed(h, w), axis=0)])
            for n in sorted({n for s in set(known.tolist()) for n in self.length[self.first[s] : self.first[s + 1]].tolist()}):
                k = max(1, n - SHINGLE + 1)
                if n >= len(words):  # the whole document
                    own, fps = [shingles(words)], simhash_of(signed(*shingles(words)).sum(axis=0, keepdims=True))
                elif n < SHINGLE:
                    own = [shingles(words[begin + i : begin + i + n]) for i in range(end - begin - n + 1)]
                    fps = simhash_of(np.vstack([signed(a, c).sum(axis=0, keepdims=True) for a, c in own]))
                else:
                    own, fps = None, simhash_of(running[k:] - running[:-k])
                for i, item in self.near(n, fps):
                    a, c = own[i] if own else (h[i : i + k], w[i : i + k])
                    got = similarity_of(Counter(a.tolist()), self.items[item][2], dict(zip(a.tolist(), c.tolist())) | self.items[item][3])
                    start = 0 if n >= len(words) else begin + i
                    if got >= similarity and (item not in best or (-got, start) < (-best[item][0], best[item][1])):
                        best[item] = (got, start)
        return [(self.items[i][0], s, start) for i, (s, start) in sorted(best.items(), key=lambda x: self.items[x[0]][0])]

    def scan(self, words: np.ndarray, lengths: np.ndarray, similarity: float) -> list[list[tuple[int, float, int]]]:
        """The leaks of each document of a batch: its words one after the other, and how many each has."""
        out: list[list] = [[] for _ in lengths]
        if not self.items or not len(words):
            return out
        first = np.cumsum(lengths) - lengths
        hits: dict[int, set] = defaultdict(set)
        for k in sorted({SHINGLE, *self.shorter}):
            if len(words) < k:
                continue
            h = np.zeros(len(words) - k + 1, np.uint64)
            for i in range(k):
                h += words[i : len(words) - k + 1 + i] * _P[i]
            at, shingle = self.has(mix(h))
            doc = np.searchsorted(first, at, "right") - 1
            inside = at + k <= first[doc] + lengths[doc]  # not across a document's end
            for d, p, s in zip(doc[inside].tolist(), (at - first[doc])[inside].tolist(), shingle[inside].tolist()):
                hits[d].add((p, s))
        for d, found in hits.items():
            places, shingle = np.array(sorted(found)).T
            out[d] = self.leaks(words[first[d] : first[d] + lengths[d]], places, shingle, similarity)
        return out


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of about ``ITEMS`` items each, dealt by a hash."""
    bench = benchmark.select("item_id", "text")
    parts = max(1, -(-bench.count() // ITEMS))
    for part in range(parts):
        mine = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text")
        yield [tuple(r) for r in mine.collect()]


def scanner(items: list[tuple[int, str]], similarity: float):
    """For a task: texts to the leaks of each."""
    index, memo = held(("decontaminate", tuple(items)), lambda: (Index(items), {}))

    def scan(texts: list[str]) -> list[list[tuple[int, float, int]]]:
        which, distinct, lengths = split_words([t.encode() for t in texts])
        if len(memo) > REMEMBER:
            memo.clear()
        memo.update((w, word_hash(w.rstrip())) for w in distinct if w not in memo)
        hashes = np.fromiter(map(memo.__getitem__, distinct), np.uint64, len(distinct))
        return index.scan(hashes[which], lengths, similarity)

    return scan


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, item_id, similarity, start_word``: one row per row of ``docs`` and item it leaks."""
    key, item = docs.schema[id_col].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col))
    found = None
    for items in item_blocks(benchmark):

        def make(items=items):
            scan = scanner(items, similarity)
            return lambda c: [*zip(*[(i, *leak) for i, found in zip(c[0], scan(c[1])) for leak in found])] or [[]] * 4

        some = map_rows(rows, make, f"doc_id {key}, item_id {item}, similarity double, start_word long")
        found = some if found is None else found.union(some)
    return found


def leaks_one_of(items: list[tuple[int, str]], similarity: float):
    """A function of a text column: whether it leaks one of the items."""

    @F.arrow_udf("boolean")
    def leaking(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scan = scanner(items, similarity)
        for texts in batches:
            yield pa.array([bool(x) for i in range(0, len(texts), 2000) for x in scan(texts.slice(i, 2000).to_pylist())], pa.bool_())

    return leaking


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that leak no item."""
    for items in item_blocks(benchmark):
        docs = docs.where(~leaks_one_of(items, similarity)(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return docs
