"""Language-model scoring: an interpolated modified Kneser-Ney n-gram model of any order from two on, counted in Spark.

Training tokens are a text's words and one end, after one start. All counts are combined in their map task before they are dealt
out by hash, so that a frequent word is one row of a task however often it occurs:

1. words: sorted hash arrays with counts, one file per range of the hash; a word's id is its place in them;
2. n-grams of the model's order: sorted hash arrays with counts. A pair's key is its two ids times an odd multiplier, so that the ids
   can be had from it; longer n-grams have their ids in a file beside it;
3. from the files of one length those of the next shorter, down to pairs: an n-gram's count there is how many different words it
   follows. One that begins with the start follows none, and keeps how often it occurs, by a pass over the texts' beginnings;
4. from the files of each length above two, for every context: how many followers it has once, twice, and three times or more, and
   the sum of their counts, as sorted hash arrays;
5. from the pair files the same for every id, and how many different words it follows: dense arrays, one file per range of ids.

Workers map those files into memory and look whole batches up by binary search. Only file names, the three sums and
the numbers of items with count one to four come to the driver.

Files lie in the shared folder under a name of their own for every attempt; only those that finished tasks return are
read. Where that folder is not a mountable path, a worker reads a file once into memory instead of mapping it. A file's
counts have four bytes each, or eight where one of them needs it. Words, and n-grams of three words and more, are told apart by
their 64-bit hash alone; different words are less than 2^32 - 1; more are an error.

Defined results: a null text is empty (one token, the end); a null id counts as the empty text for the fold; repeated
rows count as often as they occur; with nothing to learn from, every token has probability one over the vocabulary
plus one; extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, held, map_rows, shared_uri, split_words, text_of

#: UTF-8 bytes of text for which there is one file of each kind.
FILE_BYTES = 8_000_000
#: Words of the longest n-gram.
ORDER = 2
#: Folds by the check sum of the id; this one is held out.
FOLDS, HELD_OUT = 5, 1
#: Items a task holds before it combines and passes them on, and words a worker remembers.
HOLD, REMEMBER = 3_000_000, 400_000

_ODD = 0x9E3779B97F4A7C15
_MIX, _UNMIX = np.uint64(_ODD), np.uint64(pow(_ODD, -1, 1 << 64))
_END = np.uint64(xxhash.xxh64_intdigest(b" "))  # no word has a space
_START = np.uint64(0xFFFFFFFF)  # as an id: the place before the first token
_UNKNOWN = -1


def words_of(texts: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The words of texts in lower case: (number of each in turn, the different ones, how many each text has)."""
    which, written, n_words = split_words([t.encode() for t in texts])
    number: dict[bytes, int] = {}
    lower = np.array([number.setdefault(w.rstrip().lower(), len(number)) for w in written], np.int64)
    return lower[which] if len(which) else which, list(number), n_words


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def _save(base: str, name: str, **arrays: np.ndarray) -> str:
    """Arrays one after the other in a file of its own; their names and lengths are the reader's business."""
    fs, path = pafs.FileSystem.from_uri(base)
    fs.create_dir(path, recursive=True)
    path = f"{path}/{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(path) as out:
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes())
    return path.rpartition("/")[2]


def _map(base: str, name: str) -> np.ndarray:
    """A file's bytes, mapped where it is a local path of the worker."""
    fs, path = pafs.FileSystem.from_uri(f"{base}/{name}")
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), np.uint8)


def combine(keys: np.ndarray, counts: np.ndarray, grams: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Sorted distinct keys, the sums of their counts (or rows of counts), and their n-grams."""
    if not len(keys):
        return keys, counts, grams
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first, axis=0), None if grams is None else grams[order[first]]


def _dealt(keys: np.ndarray, counts: np.ndarray, grams: np.ndarray | None, bits: int, kind: str = "<u4") -> pd.DataFrame:
    """Sorted keys (or the n-grams that they are made of) as one row per range of their top bits."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(keys) else np.empty(0, int)
    ends = np.append(first[1:], len(keys))
    counts, sent = narrow(counts, kind), keys if grams is None else grams
    return pd.DataFrame(
        {
            "bucket": bucket[first],
            "keys": [sent[a:b].tobytes() for a, b in zip(first, ends)],
            "counts": [counts[a:b].tobytes() for a, b in zip(first, ends)],
        }
    )


def narrow(counts: np.ndarray, kind: str) -> np.ndarray:
    """The counts as a type that must hold them."""
    if len(counts) and int(counts.max()) > np.iinfo(kind).max:
        raise OverflowError(f"a count of {int(counts.max())} doesn't fit {kind}")
    return counts.astype(kind)


def wide_enough(counts: np.ndarray) -> np.ndarray:
    return counts.astype("<u4" if not len(counts) or int(counts.max()) < 1 << 32 else "<u8")


def counts_in(data: np.ndarray, n: int, rows: int = 1) -> np.ndarray:
    """The ``n`` by ``rows`` counts that fill a part of a file."""
    return data.view("<u4" if len(data) == 4 * n * rows else "<u8")


_DEALT = "bucket long, keys binary, counts binary"
_FILE = "bucket long, name string, n long, total long, ones array<long>"
_GRAMS = f"{_FILE}, grams string"


def _ones(counts: np.ndarray) -> list[int]:
    """How many counts are one, two, three and four."""
    return np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=5)[1:5].tolist()


def _keep(base: str, kind: str, length: int = 1):
    """Reducer: the combined keys and counts of one range, as a file; n-grams of over two words in a second one."""

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, grams = np.frombuffer(b"".join(pdf["keys"]), np.uint64 if length < 3 else np.uint32), None
        if length > 2:
            grams = keys.reshape(-1, length)
            keys = gram_keys(grams)
        counts = np.frombuffer(b"".join(pdf["counts"]), "<u4").astype(np.uint64)
        keys, counts, grams = combine(keys, counts, grams)
        out = {"bucket": [pdf["bucket"].iloc[0]], "name": [_save(base, kind, keys=keys, counts=wide_enough(counts))], "n": [len(keys)]}
        out |= {"total": [int(counts.sum())], "ones": [_ones(counts)]}
        if length > 2:
            out["grams"] = [_save(base, f"{kind}-ids", grams=grams)]
        return pd.DataFrame(out)

    return reduce


def _keep_contexts(base: str, kind: str):
    """Reducer: contexts of one range with the rows of counts that their followers have, as a file."""

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = np.frombuffer(b"".join(pdf["keys"]), np.uint64), np.frombuffer(b"".join(pdf["counts"]), "<u8").reshape(-1, 4)
        keys, counts, _ = combine(keys, counts)
        name = _save(base, kind, keys=keys, counts=wide_enough(counts))
        return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "name": [name], "n": [len(keys)], "total": [int(counts[:, 3].sum())], "ones": [[0, 0, 0, 0]]})

    return reduce


class Files:
    """Where a kind's files are: by range of the key's top bits."""

    def __init__(self, base: str, bits: int, rows: list):
        self.base, self.bits = base, bits
        self.names, self.sizes = [None] * (1 << bits), np.zeros(1 << bits, np.int64)
        for r in rows:
            self.names[r["bucket"]], self.sizes[r["bucket"]] = r["name"], r["n"]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.n = int(self.sizes.sum())
        self.total = sum(r["total"] for r in rows)
        self.ones = np.sum([r["ones"] for r in rows], axis=0).tolist() if rows else [0, 0, 0, 0]


class Lookup:
    """A worker's view of a kind's files, with so many counts for each key."""

    def __init__(self, files: Files, width: int = 1):
        self.files, self.width, self.open = files, width, {}

    def _arrays(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        if b not in self.open:
            data, n = _map(self.files.base, self.files.names[b]), int(self.files.sizes[b])
            counts = counts_in(data[8 * n :], n, self.width)
            self.open[b] = data[: 8 * n].view(np.uint64), counts if self.width == 1 else counts.reshape(n, self.width)
        return self.open[b]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place or -1, count or 0) of sorted distinct keys; of several counts, a row."""
        place, count = np.full(len(keys), _UNKNOWN, np.int64), np.zeros((len(keys), self.width)[: 1 + (self.width > 1)], np.int64)
        tops = keys >> np.uint64(64 - self.files.bits) if self.files.bits else np.zeros(len(keys), np.uint64)
        edges = np.searchsorted(tops, np.arange((1 << self.files.bits) + 1, dtype=np.uint64))
        for b in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
            if self.files.names[b] is None:
                continue
            part = slice(edges[b], edges[b + 1])
            have, counts = self._arrays(b)
            at = np.searchsorted(have, keys[part])
            at[at == len(have)] = 0
            hit = have[at] == keys[part]
            place[part] = np.where(hit, at + self.files.starts[b], _UNKNOWN)
            count[part] = np.where(hit if self.width == 1 else hit[:, None], counts[at], 0)
        return place, count


class Words:
    """Ids and counts of words, remembered by the worker up to a bound."""

    def __init__(self, files: Files):
        if files.n >= int(_START):
            raise OverflowError(f"{files.n} different words; ids have 32 bits")
        self.look = Lookup(files)
        self._forget()
        place, count = self.look.find(np.array([_END]))
        self.end, self.end_count = int(place[0]), int(count[0])

    def _forget(self) -> None:
        self.known, self.places, self.counts = {}, np.empty(0, np.int64), np.empty(0, np.int64)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, counts, lengths): each text's tokens one after the other, its end included."""
        which, distinct, n_words = words_of(texts)
        if len(self.known) > REMEMBER:
            self._forget()
        known = self.known
        new = [w for w in distinct if w not in known]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))
        order = np.argsort(hashes)
        place, count = np.empty(len(new), np.int64), np.empty(len(new), np.int64)
        place[order], count[order] = self.look.find(hashes[order])
        known.update(zip(new, range(len(known), len(known) + len(new))))
        self.places, self.counts = np.concatenate([self.places, place]), np.concatenate([self.counts, count])
        at = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))
        lengths = n_words + 1
        ids, counts = np.full(int(lengths.sum()), self.end, np.int64), np.full(int(lengths.sum()), self.end_count, np.int64)
        inner = np.ones(len(ids), bool)
        inner[np.cumsum(lengths) - 1] = False
        if len(which):
            ids[inner], counts[inner] = self.places[at][which], self.counts[at][which]
        return ids, counts, lengths


def previous(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The id before each token; the start before each text's first."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.cumsum(lengths) - lengths] = int(_START)
    return before


def pair_keys(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return (before.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64)) * _MIX


def windows(ids: np.ndarray, lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``ids``, n-grams) of all windows of ``length`` tokens of each text with its start before it, by their last token.

    Unknown words stay negative.
    """
    place = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    last = np.flatnonzero(place >= length - 2)
    grams = np.empty((len(last), length), np.int64)
    for back in range(length):
        grams[:, length - 1 - back] = ids[last - back]
    grams[place[last] == length - 2, 0] = int(_START)
    return last, grams


def gram_keys(grams: np.ndarray) -> np.ndarray:
    """The keys of rows of ids; that of a context is the key of its words."""
    keys = pair_keys(grams[:, 0], grams[:, 1])
    for at in range(2, grams.shape[1]):
        keys = _mixed(_mixed(keys) + grams[:, at].astype(np.uint64) * _MIX)
    return keys


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Gather:
    """Keys with counts of a task, held until there are ``HOLD`` of them; n-grams of over two words instead of keys."""

    def __init__(self, bits: int, length: int = 1):
        self.bits, self.length, self.keys, self.counts, self.held = bits, length, [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys), self.counts.append(counts)
        self.held += len(keys)

    def take(self) -> pd.DataFrame:
        """What is held, combined and dealt; then nothing is held."""
        keys, counts = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (self.keys, self.counts))
        grams = keys.reshape(-1, self.length) if self.length > 2 else None
        got = combine(keys if grams is None else gram_keys(grams), counts, grams)
        self.keys, self.counts, self.held = [], [], 0
        return _dealt(*got, self.bits)


def distinct_grams(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a ``Gather`` takes of n-grams: keys of pairs or n-grams themselves, each once, with counts."""
    keys, first, counts = np.unique(gram_keys(grams), return_index=True, return_counts=True)
    return keys if grams.shape[1] == 2 else grams[first].astype(np.uint32), counts


class Model:
    """What scoring needs: file names and a few sums. Small, and sent with each task."""

    def __init__(self, words: Files, pairs: Files, stats: dict[int, str], step: int, seen: list[int], n_docs: int, longer: list[tuple[Files, Files]]):
        self.words, self.pairs, self.stats, self.step, self.seen, self.n_docs = words, pairs, stats, step, seen, n_docs
        self.longer = longer  # n-grams and contexts of three words, four and so on
        self.key = f"{words.base}"
        self.pair_off, self.word_off = discounts(pairs.ones), discounts(seen)
        self.longer_off = [discounts(grams.ones) for grams, _ in longer]


def discounts(ones: list[int]) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more, from how many items have count one to four."""
    n1, n2, n3, n4 = (float(x) for x in ones)
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    raw = [0.0, 1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([min(max(d, 0.05 if k else 0.0), k) for k, d in enumerate(raw)])


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> Model:
    """Count the model of n-grams of up to ``order`` words (two at least) over all rows of ``docs``."""
    if order < 2:
        raise ValueError(f"order {order}: pairs are the least")
    base = f"{shared_uri(docs.sparkSession)}/kneser-ney-{uuid.uuid4().hex}"
    texts = docs.select(text_of(text_col))
    n_docs, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    bits = max(0, math.ceil(math.log2(max(1, size / FILE_BYTES))))

    def count_words(batches):
        got = Gather(bits)
        for pdf in batches:
            counts, n = Counter(), len(pdf)
            for i in range(0, n, 1000):
                which, distinct, _ = words_of(pdf["text"].iloc[i : i + 1000].tolist())
                counts.update(dict(zip(distinct, np.bincount(which, minlength=len(distinct)).tolist())))
                if len(counts) > 300_000:
                    got.add(*_hashed(counts))
                    counts = Counter()
            got.add(*_hashed(counts))
            got.add(np.array([_END]), np.array([n]))
            if got.held >= HOLD:
                yield got.take()
        yield got.take()

    word_rows = cut(texts.mapInPandas(count_words, _DEALT).groupBy("bucket").applyInPandas(_keep(base, "words"), _FILE)).collect()
    words = Files(base, bits, word_rows)

    def count_grams(batches):
        got, vocabulary = Gather(bits, order), Words(words)
        for pdf in batches:
            for i in range(0, len(pdf), 1000):
                ids, _, lengths = vocabulary.ids(pdf["text"].iloc[i : i + 1000].tolist())
                got.add(*distinct_grams(windows(ids, lengths, order)[1]))
                if got.held >= HOLD:
                    yield got.take()
        yield got.take()

    def keep_grams(rows: DataFrame, length: int) -> DataFrame:
        kept = rows.groupBy("bucket").applyInPandas(_keep(base, f"grams-{length}", length), _FILE if length == 2 else _GRAMS)
        return cut(kept)

    def spread(files: DataFrame, *more: str) -> DataFrame:
        return files.select("name", "n", *more).repartition(max(1, 1 << bits), "name")

    files, longer = keep_grams(texts.mapInPandas(count_grams, _DEALT), order), []
    for length in range(order - 1, 1, -1):  # from n-grams of one word more
        contexts = cut(spread(files, "grams").mapInPandas(_contexts(base, length + 1, bits), _DEALT).groupBy("bucket").applyInPandas(_keep_contexts(base, f"contexts-{length}"), _FILE))
        longer.insert(0, (Files(base, bits, files.select(*_COLUMNS).collect()), Files(base, bits, contexts.collect())))
        shorter = spread(files, "grams").mapInPandas(_shorter(base, length, bits), _DEALT)
        files = keep_grams(shorter.union(texts.mapInPandas(_beginnings(words, length, bits), _DEALT)), length)
    pair_files = files
    pairs = Files(base, bits, pair_files.collect())
    step = max(1, -(-words.n // (1 << bits)))  # ids of one range; the start has a range of its own at the end
    width = 4 if order == 2 else 5  # pairs' own counts sum to the word's; of longer models, the sum is counted

    def partial_stats(batches):
        for pdf in batches:
            for name, n in zip(pdf["name"], pdf["n"]):
                data = _map(base, name)
                pair = data[: 8 * n].view(np.uint64) * _UNMIX
                counts = counts_in(data[8 * n :], n)
                before, after = pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF)
                # as a follower: one more word it follows; as a context: one more follower with count 1, 2, or 3 and more
                parts = [np.unique(after << np.uint64(3), return_counts=True)]
                parts.append(np.unique(before << np.uint64(3) | np.minimum(counts, 3).astype(np.uint64), return_counts=True))
                if width == 5:
                    parts.append(combine(before << np.uint64(3) | np.uint64(4), counts.astype(np.int64))[:2])
                for keys, times in parts:
                    ids_of = (keys >> np.uint64(3)).astype(np.int64)
                    where = np.where(ids_of == int(_START), 1 << bits, ids_of // step)
                    first = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
                    for a, b in zip(first, np.append(first[1:], len(keys))):
                        yield pd.DataFrame({"bucket": [where[a]], "keys": [keys[a:b].tobytes()], "counts": [narrow(times[a:b], "<u4").tobytes()]})

    def keep_stats(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        keys = np.frombuffer(b"".join(pdf["keys"]), np.uint64)
        rows = (keys >> np.uint64(3)).astype(np.int64) - bucket * step if bucket < 1 << bits else np.zeros(len(keys), np.int64)
        dense = np.zeros((width, step if bucket < 1 << bits else 1), np.int64)
        np.add.at(dense, ((keys & np.uint64(7)).astype(np.int64), rows), np.frombuffer(b"".join(pdf["counts"]), "<u4").astype(np.int64))
        name = _save(base, "stats", dense=wide_enough(dense))
        return pd.DataFrame({"bucket": [bucket], "name": [name], "n": [dense.shape[1]], "total": [int(dense[0].sum())], "ones": [_ones(dense[0])]})

    stat_rows = cut(spread(pair_files).mapInPandas(partial_stats, _DEALT).groupBy("bucket").applyInPandas(keep_stats, _FILE)).collect()
    seen = np.sum([r["ones"] for r in stat_rows], axis=0).tolist() if stat_rows else [0, 0, 0, 0]
    return Model(words, pairs, {r["bucket"]: r["name"] for r in stat_rows}, step, seen, n_docs, longer)


_COLUMNS = ("bucket", "name", "n", "total", "ones")


def _grams_of(base: str, pdf: pd.DataFrame, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-grams, counts) of each file."""
    for name, n, grams in zip(pdf["name"], pdf["n"], pdf["grams"]):
        yield _map(base, grams).view(np.uint32).reshape(n, length), counts_in(_map(base, name)[8 * n :], n)


def _contexts(base: str, length: int, bits: int):
    """Map: of each context of n-grams of ``length`` words, its followers with count 1, 2, and 3 and more, and their counts' sum."""

    def run(batches):
        for pdf in batches:
            for grams, counts in _grams_of(base, pdf, length):
                rows = np.zeros((len(counts), 4), np.int64)
                rows[np.arange(len(counts)), np.minimum(counts, 3).astype(np.int64) - 1] = 1
                rows[:, 3] = counts
                yield _dealt(*combine(gram_keys(grams[:, :-1]), rows), bits, "<u8")

    return run


def _shorter(base: str, length: int, bits: int):
    """Map: n-grams of ``length`` words, once for each different word before them."""

    def run(batches):
        for pdf in batches:
            for grams, _ in _grams_of(base, pdf, length + 1):
                got = Gather(bits, length)
                got.add(*distinct_grams(grams[:, 1:]))
                yield got.take()

    return run


def _beginnings(words: Files, length: int, bits: int):
    """Map: n-grams of ``length`` words that begin with the start, as often as they occur."""

    def run(batches):
        got, vocabulary = Gather(bits, length), Words(words)
        for pdf in batches:
            for i in range(0, len(pdf), 1000):
                # no more of a text than its first words is needed; an end after them is beyond the window
                first = [b" ".join(t.encode().split(None, length - 1)[: length - 1]).decode() for t in pdf["text"].iloc[i : i + 1000]]
                ids, _, lengths = vocabulary.ids(first)
                last, grams = windows(ids, lengths, length)
                got.add(*distinct_grams(grams[grams[:, 0] == int(_START)]))
                if got.held >= HOLD:
                    yield got.take()
        yield got.take()

    return run


def _hashed(counts: Counter) -> tuple[np.ndarray, np.ndarray]:
    n = len(counts)
    return np.fromiter(map(xxhash.xxh64_intdigest, counts), np.uint64, n), np.fromiter(counts.values(), np.int64, n)


def interpolated(c: np.ndarray, n: np.ndarray, total: np.ndarray, off: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities by counts after a context whose followers' counts have a sum, and ``lower`` of what discounts leave; unseen
    contexts (sum zero) leave all."""
    some = total > 0
    denominator = np.where(some, total, 1.0)
    rest = np.where(some, (off[1] * n[0] + off[2] * n[1] + off[3] * n[2]) / denominator, 1.0)
    return np.where(some, np.maximum(c - off[np.minimum(c, 3)], 0) / denominator, 0.0) + rest * lower


class Scorer:
    """A worker's mapped model."""

    def __init__(self, model: Model):
        self.m, self.words, self.pairs, self.open = model, Words(model.words), Lookup(model.pairs), {}
        self.longer = [(Lookup(grams), Lookup(contexts, 4), off) for (grams, contexts), off in zip(model.longer, model.longer_off)]
        self.rows = 5 if model.longer else 4
        self.distinct = model.pairs.n  # all pairs: the sum of the numbers of words that each word follows
        n = model.seen
        at_least_3 = max(0, self._followed() - n[0] - n[1])
        off = model.word_off
        self.floor = (off[1] * n[0] + off[2] * n[1] + off[3] * at_least_3) / self.distinct / (model.words.n + 1) if self.distinct else 1.0 / (model.words.n + 1)

    def _followed(self) -> int:
        """Words that follow some word: all of the vocabulary."""
        return self.m.words.n

    def stats(self, ids: np.ndarray) -> np.ndarray:
        """Rows (words followed; followers with count 1, 2, 3 and more; of longer models their counts' sum) of ids; unknown ones have zeros."""
        out = np.zeros((self.rows, len(ids)), np.int64)
        last = 1 << self.m.words.bits
        where = np.where(ids == int(_START), last, ids // self.m.step)
        where[ids == _UNKNOWN] = -1
        for b in np.unique(where).tolist():
            if b >= 0 and b in self.m.stats:
                if b not in self.open:
                    self.open[b] = counts_in(_map(self.m.words.base, self.m.stats[b]), self.m.step if b < last else 1, self.rows).reshape(self.rows, -1)
                mine = np.flatnonzero(where == b)
                out[:, mine] = self.open[b][:, ids[mine] - b * self.m.step if b < last else 0 * ids[mine]]
        return out

    def log10(self, ids: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 p(token | tokens before) of each token."""
        before = previous(ids, lengths)
        total = np.empty(len(ids))
        total[1:] = counts[:-1]
        total[np.cumsum(lengths) - lengths] = self.m.n_docs
        both = (before >= 0) & (ids >= 0)
        keys, back = np.unique(pair_keys(before[both], ids[both]), return_inverse=True)
        c = np.zeros(len(ids), np.int64)
        c[both] = self.pairs.find(keys)[1][back]
        each, back = np.unique(ids, return_inverse=True)
        follows = self.stats(each)[0][back]
        unigram = np.full(len(ids), self.floor)
        if self.distinct:
            unigram += np.maximum(follows - self.m.word_off[np.minimum(follows, 3)], 0) / self.distinct
        each, back = np.unique(before, return_inverse=True)
        n = self.stats(each)[1:][:, back]
        p = interpolated(c, n, n[3] if self.longer else np.where(before >= 0, total, 0), self.m.pair_off, unigram)
        for length, (grams, contexts, off) in enumerate(self.longer, 3):
            last, rows = windows(ids, lengths, length)
            known = (rows[:, :-1] >= 0).all(axis=1)
            last, rows = last[known], rows[known]
            each, back = np.unique(gram_keys(rows[:, :-1]), return_inverse=True)
            n = contexts.find(each)[1].T[:, back]
            c = np.zeros(len(last), np.int64)
            both = (rows[:, -1] >= 0) & (n[3] > 0)
            each, back = np.unique(gram_keys(rows[both]), return_inverse=True)
            c[both] = grams.find(each)[1][back]
            p[last] = interpolated(c, n, n[3], off, p[last])
        return np.log10(p)

    def score(self, texts: list[str]) -> list[list]:
        """Columns n_tokens, n_known, base_score, score."""
        ids, counts, lengths = self.words.ids(texts)
        n, v = self.m.words.total, self.m.words.n
        base = np.log10((counts + 0.5) / (n + 0.5 * (v + 1)))
        first = np.cumsum(lengths) - lengths
        sums = (np.add.reduceat(x, first).tolist() for x in ((counts > 0).astype(np.int64), base, self.log10(ids, counts, lengths)))
        return [lengths.tolist(), *sums]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` (log10 probabilities of the whole text) of every row.

    Perplexity is ``10 ** (-score / n_tokens)``.
    """

    def make():
        scorer = held(("kneser-ney", model.key), lambda: Scorer(model))
        return lambda c: [c[0], *scorer.score(c[1])] if c[0] else [[] for _ in range(5)]

    key = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col))
    return map_rows(rows, make, f"doc_id {key}, n_tokens long, n_known long, base_score double, score double")
