"""Quality classifier by co-training two views of a document.

The text view sees words, word beginnings, content shape and line layout; the metadata view sees language, source and the
stated size. Both are sparse logistic regressions over the features whose association with the label is significant.
In each round a view labels those unlabelled documents of which it is sure, by its calibrated probability, and hands
them to the other view as training rows. At the end both views are calibrated on labelled rows that neither was fitted
on, a logistic combination of the calibrated views is fitted there too, and every document is scored.

A document is bad if its quality label is 0 or its toxic label is 1.

The unlabelled pool is every document without a label. Its candidate features are written once, in the shared folder;
each round goes over all of them, labels them by the views of the round before, and adds up in Spark how often each
candidate stands in rows given each label, and the gradients of the new fit. The driver gets one vector per view.

Only the rows that name the candidates are bounded: about ``LABELLED`` labelled ones, which the fit uses too, and about
``UNLABELLED`` others, both taken by a hash of the id and one row of each id. They come to the driver as feature numbers.
Scoring runs over all documents and whole texts.

Defined results: a null text is empty and scored by its metadata; null metadata is a value of its own; label rows with a
null are not used, and of several for one id the worst counts; with no labels of either kind every document has
probability zero and is kept; repeated rows are scored alike; extra columns stay.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from copy import copy
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, held, map_rows, slices, split_words, text_of

#: Bounds of the labelled sample, of the rows that name candidates with it, and of a view's candidates.
LABELLED, UNLABELLED, CANDIDATES = 8_000, 3_000, 1 << 16
#: Steps of a round's fit, each with the gradient over the whole pool; all its rows weigh no more than the labelled ones.
STEPS_EACH, GIVEN = 10, 0.5
ROUNDS, SURE_BAD, SURE_GOOD = 3, 0.97, 0.97
THRESHOLD = 0.5
#: Features up to which a row is taken in full.
USUAL = 300
#: Shares at which content shape has a feature; such features are numbered from PLAIN and count in full.
STEPS = (0.01, 0.03, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9)
PLAIN, SHAPE_VALUE = 1 << 30, 2.0
REMEMBER = 300_000
_EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LAST = (1 << 20) - 1
_digest, _LOW = xxhash.xxh32_intdigest, 0x3FFFFFFF
_SYMBOLS, _UPPER = b"#*$%&|<>~^{}\\", bytes(range(0x41, 0x5B))


def feature(name: str | bytes) -> int:
    return _digest(name) & _LOW


def word_features(word: bytes) -> tuple[int, ...]:
    """Of a lower-case word: itself and its beginnings."""
    w = word.strip(_EDGES) or word
    if w.isascii():
        four, five, n = w[:4], w[:5], len(w)
    else:
        text = w.decode("utf-8", "replace")
        four, five, n = text[:4].encode(), text[:5].encode(), len(text)
    own = _digest(b"w " + w) & _LOW  # as ``feature`` does
    if n > 5:
        return own, _digest(b"p4 " + four) & _LOW, _digest(b"p5 " + five) & _LOW
    return (own, _digest(b"p4 " + four) & _LOW) if n > 4 else (own,)


def level(x: float) -> int:
    """A coarse logarithmic bucket of a ratio or size."""
    return -99 if x <= 0 else round(2 * math.log2(x))


def _count(content: bytes, kinds: bytes) -> int:
    return len(content) - len(content.translate(None, kinds))


def shape(text: str, content: bytes, n: int, distinct: int, same: int) -> list[int]:
    """Features of content shape: the steps it passes, and line layout; characters beyond ASCII count as their bytes."""
    n, lines = max(1, n), text.count("\n") + 1
    size = max(1, len(content) - _count(content, b" \t\n\r\x0b\x0c"))
    shares = {
        "distinct": distinct / n,
        "symbols": _count(content, _SYMBOLS) / n,
        "upper": _count(content, _UPPER) / size,
        "marks": _count(content, b"!?") / n,
        "digits": _count(content, b"0123456789") / size,
        "bars": _count(content, b"|") / n,
        "same": same / n,
    }
    out = [step for name, share in shares.items() for step in _STEP[name][: bisect_left(STEPS, share)]]
    plain = (f"distinct {round(10 * distinct / n)} {min(8, level(n) // 2)}", f"lines {level(lines)}", f"line {level(len(text) / lines)}", f"bytes {round(20 * len(content) / max(1, len(text)))}")
    return out + [PLAIN + feature(x) for x in plain]


_STEP = {name: [PLAIN + feature(f"{name} over {step}") for step in STEPS] for name in ("distinct", "symbols", "upper", "marks", "digits", "bars", "same")}


def stated(lang, source, n_chars) -> tuple[int, ...]:
    """Features of the metadata view."""
    size = "none" if n_chars is None else level(n_chars)
    half = "none" if n_chars is None else level(n_chars) // 2
    names = (f"lang {lang}", f"source {source}", f"size {size}", f"half {half}", f"lang {lang} source {source}", f"lang {lang} half {half}", f"source {source} half {half}")
    return tuple(map(feature, names))


class Rows:
    """Sparse rows: feature numbers one row after the other."""

    def __init__(self, f: np.ndarray, sizes: np.ndarray):
        self.f, self.sizes, self.n = f.astype(np.int32, copy=False), sizes, len(sizes)
        self.row = np.repeat(np.arange(self.n), sizes)

    def places(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the rows' features stand among the known ones, and how many known ones each row has."""
        at, hit = looked_up(known, self.f)
        return at[hit], np.bincount(self.row[hit], minlength=self.n)

    def logits(self, view: View) -> np.ndarray:
        return np.bincount(self.row, view.weights(self.f), self.n) * usual(self.sizes) + view.b  # metadata has no shape

    def each(self) -> list[np.ndarray]:
        ends = np.cumsum(self.sizes).tolist()
        return [self.f[a:b] for a, b in zip([0, *ends], ends)]


class Texts:
    """Texts as they are read: each different word's features once (``f``, ``sizes`` of them a word), which words stand in each of
    ``n`` texts (``doc``, ``word``, by text), and the features of the texts' shapes. What is asked of a feature is asked once a word."""

    def __init__(self, n: int, f: np.ndarray, sizes: np.ndarray, doc: np.ndarray, word: np.ndarray, shapes: np.ndarray, more: np.ndarray):
        self.n, self.f, self.word_sizes, self.doc, self.word, self.shapes, self.more = n, f, sizes, doc, word, shapes, more
        self.sizes = np.bincount(doc, sizes[word], n).astype(np.int64) + more

    def _by_text(self, f: np.ndarray, sizes: np.ndarray, shapes: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values a text and how many it has: those of its words, then those of its shape."""
        n = sizes[self.word]
        ends = np.cumsum(n)
        first = np.cumsum(sizes) - sizes
        words = f[np.repeat(first[self.word] - (ends - n), n) + np.arange(ends[-1])] if len(n) else f[:0]
        have = np.bincount(self.doc, n, self.n).astype(np.int64)
        out = np.empty(len(words) + len(shapes), f.dtype)
        out[np.arange(len(words)) + np.repeat(np.cumsum(more) - more, have)] = words
        out[np.arange(len(shapes)) + np.repeat(np.cumsum(have), more)] = shapes
        return out, have + more

    def rows(self) -> Rows:
        return Rows(*self._by_text(self.f, self.word_sizes, self.shapes, self.more))

    def places(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``rows().places(known)``."""
        (at, hit), (shape_at, shape_hit) = looked_up(known, self.f), looked_up(known, self.shapes)
        word, doc = np.repeat(np.arange(len(self.word_sizes)), self.word_sizes), np.repeat(np.arange(self.n), self.more)
        sizes, more = np.bincount(word[hit], minlength=len(self.word_sizes)), np.bincount(doc[shape_hit], minlength=self.n)
        return self._by_text(at[hit], sizes, shape_at[shape_hit], more)

    def logits(self, view: View) -> np.ndarray:
        of_word = np.bincount(np.repeat(np.arange(len(self.word_sizes)), self.word_sizes), view.weights(self.f), len(self.word_sizes))
        of_shape = np.bincount(np.repeat(np.arange(self.n), self.more), view.weights(self.shapes), self.n)
        return np.bincount(self.doc, of_word[self.word], self.n) * usual(self.sizes) + SHAPE_VALUE * of_shape + view.b


class Reader:
    """Rows to features; remembers the words it has met, up to a bound."""

    def __init__(self):
        self.memo: dict[bytes, tuple[int, ...]] = {}
        self.about: dict[tuple, tuple[int, ...]] = {}

    def text(self, texts: list[str]) -> Rows:
        return self.read(texts).rows()

    def read(self, texts: list[str]) -> Texts:
        """Of each text its different words, in lower case, with their beginnings, and its shape."""
        content, seen, number = [t.encode("utf-8", "replace") for t in texts], self.memo, {}
        which, written, n_words = split_words(content)
        lower = np.array([number.setdefault(w.rstrip().lower(), len(number)) for w in written], np.int64)
        if len(seen) > REMEMBER:
            seen.clear()
        seen.update((w, word_features(w)) for w in number if w not in seen)
        own = [seen[w] for w in number]
        sizes = np.array([len(x) for x in own], np.int64)
        flat = np.fromiter(chain.from_iterable(own), np.int32, int(sizes.sum()))
        doc, word = np.repeat(np.arange(len(texts)), n_words), lower[which] if len(which) else which
        pairs = np.sort(doc * max(1, len(number)) + word)
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
        in_doc, of_word = pairs // max(1, len(number)), pairs % max(1, len(number))
        distinct = np.bincount(in_doc, minlength=len(texts))
        same = np.bincount(doc[1:][(word[1:] == word[:-1]) & (doc[1:] == doc[:-1])], minlength=len(texts))
        shapes = list(map(shape, texts, content, n_words.tolist(), distinct.tolist(), same.tolist()))
        more = np.array([len(x) for x in shapes], np.int64)
        return Texts(len(texts), flat, sizes, in_doc, of_word, np.fromiter(chain.from_iterable(shapes), np.int32, int(more.sum())), more)

    def meta(self, *columns: list) -> Rows:
        if len(self.about) > REMEMBER:
            self.about.clear()
        found = []
        for key in zip(*columns):
            if key not in self.about:
                self.about[key] = stated(*key)
            found.append(self.about[key])
        return Rows(np.fromiter(chain.from_iterable(found), np.int32), np.array([len(x) for x in found], np.int64))


def significant(n: np.ndarray, n1: np.ndarray, total: float, bad: float) -> np.ndarray:
    """Places of the features to keep: of ``total`` rows ``n`` have it, ``bad`` rows are bad, and ``n1`` both."""
    p = bad / total
    with np.errstate(divide="ignore", invalid="ignore"):
        def part(a, e):
            return np.where(a > 0, a * np.log(a / e), 0)

        g2 = 2 * (part(n1, n * p) + part(n - n1, n * (1 - p)) + part(bad - n1, (total - n) * p) + part(total - bad - n + n1, (total - n) * (1 - p)))
    return np.flatnonzero((n >= 5) & (g2 > 12))


class View:
    """Logistic regression over significant features."""

    def __init__(self):
        self.features, self.w, self.b = np.empty(0, np.int64), np.empty(0), 0.0

    def weights(self, f: np.ndarray) -> np.ndarray:
        """Of each feature its weight, or zero."""
        at, hit = looked_up(self.features, f)
        return np.where(hit, self.w[at], 0.0) if len(self.w) else np.zeros(len(f))


def platt(z: np.ndarray, y: np.ndarray, steps: int = 100) -> np.ndarray:
    """Coefficients (last: intercept) of a logistic regression of ``y`` on the few columns of ``z``, by Newton's method on columns of
    one scale; a step is halved until the loss falls, so that large logits don't throw it off."""
    scale = np.maximum(np.abs(z).mean(axis=0), 1e-9)
    x = np.column_stack([z / scale, np.ones(len(y))])
    soft = (y * (y.sum() + 1) + (1 - y) * 1) / np.where(y > 0, y.sum() + 2, (1 - y).sum() + 2)  # smoothed targets

    def loss(c: np.ndarray) -> float:
        t = x @ c
        return float(np.sum(np.logaddexp(0, t) - soft * t) + 5e-4 * (c @ c))

    c = np.zeros(x.shape[1])
    now = loss(c)
    for _ in range(steps):
        p = sigmoid(x @ c)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(c))
        step, size = np.linalg.solve(h, x.T @ (soft - p) - 1e-3 * c), 1.0
        while size > 1e-6 and loss(c + size * step) > now:
            size /= 2
        new = loss(c + size * step)
        if now - new < 1e-9 * (1 + now):
            break
        c, now = c + size * step, new
    c[:-1] /= scale
    return c


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Both views, their calibration and the combination."""

    def __init__(self, text: View, meta: View, calibration: list[np.ndarray], combination: np.ndarray):
        self.views, self.calibration, self.combination = (text, meta), calibration, combination

    def probability(self, text: Texts, meta: Rows) -> np.ndarray:
        z = [np.column_stack([x.logits(v), np.ones(x.n)]) @ c for v, x, c in zip(self.views, (text, meta), self.calibration)]
        return sigmoid(np.column_stack([*z, np.ones(text.n)]) @ self.combination)


def frequent(rows: list[np.ndarray], least: int = 5) -> np.ndarray:
    """The commonest features of at least so many rows, in order: no rarer one can be significant."""
    found, counts = np.unique(np.concatenate([np.unique(r) for r in rows]), return_counts=True) if rows else (np.empty(0, np.int32), np.empty(0, int))
    common = np.flatnonzero(counts >= least)
    return found[np.sort(common[np.argsort(-counts[common], kind="stable")][:CANDIDATES])]


def looked_up(known: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each feature stands among the known ones in order, and whether it does."""
    at, hit = np.zeros(len(f), np.int64), np.zeros(len(f), bool)
    if len(known):
        some = slice(None)
        if len(f) > len(known):  # most are unknown, which the last bits tell without a search
            last = np.zeros(_LAST + 1, bool)
            last[known & _LAST] = True
            some = np.flatnonzero(last[f & _LAST])
        found = np.searchsorted(known, f[some])
        found[found == len(known)] = 0
        at[some], hit[some] = found, known[found] == f[some]
    return at, hit


def usual(sizes: np.ndarray) -> np.ndarray:
    """What a row's features count: less in long rows, so that many faint words don't outweigh a few plain ones."""
    return np.sqrt(np.minimum(1.0, USUAL / np.maximum(1, sizes)))


class Part:
    """Rows of one view as places of candidates, in each row those of words first; sums go over runs of equal value."""

    def __init__(self, known: np.ndarray, at: np.ndarray, lengths: np.ndarray, sizes: np.ndarray):
        self.k, self.at, self.value = len(known), at, np.column_stack([usual(sizes), np.full(len(lengths), SHAPE_VALUE)])
        shapes = np.flatnonzero(at >= np.searchsorted(known, PLAIN))
        more = np.bincount(np.searchsorted(np.cumsum(lengths), shapes, "right"), minlength=len(lengths))
        self._divide(np.column_stack([lengths - more, more]).reshape(-1))

    def _divide(self, runs: np.ndarray) -> None:
        self.n, self.runs, self.full = len(runs) // 2, runs, np.flatnonzero(runs)
        self.starts = (np.cumsum(runs) - runs)[self.full]

    def only(self, rows: np.ndarray) -> Part:
        """Some of its rows."""
        out, both = copy(self), np.repeat(rows, 2)
        out.at, out.value = self.at[np.repeat(both, self.runs)], self.value[rows]
        out._divide(self.runs[both])
        return out

    def logits(self, w: np.ndarray) -> np.ndarray:
        """Of weights with the intercept last."""
        sums = np.zeros(2 * self.n)
        if len(self.full):
            sums[self.full] = np.add.reduceat(w[self.at], self.starts)
        return (sums.reshape(-1, 2) * self.value).sum(axis=1) + w[-1]

    def gradient(self, r: np.ndarray) -> np.ndarray:
        return self._added(r[:, None] * self.value, r)

    def counts(self, r: np.ndarray) -> np.ndarray:
        """How often each candidate stands in the rows, weighted; last, the sum of the weights."""
        return self._added(np.column_stack([r, r]), r)

    def _added(self, each: np.ndarray, r: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(self.at, np.repeat(each.reshape(-1), self.runs), self.k), r.sum())


def given(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(1 where a view is sure, its label) by its probabilities."""
    bad = (p >= SURE_BAD).astype(float)
    return bad + (p <= 1 - SURE_GOOD), bad


class Pool:
    """All unlabelled documents as candidates' places, with sums over them by view."""

    def __init__(self, docs: DataFrame, labels: DataFrame, known: list[np.ndarray]):
        self.known = known

        def make():
            read = held("cotrain", Reader)

            def work(c):
                out = [c[0]]
                rows = read.read(c[4]), read.meta(*c[1:4])
                for v in (0, 1):
                    at, n = rows[v].places(known[v])
                    data, ends = at.astype(np.uint16).tobytes(), (2 * np.cumsum(n)).tolist()
                    out.append([data[a:b] for a, b in zip([0, *ends], ends)])
                return out + [x.sizes.tolist() for x in rows]

            return work

        key = docs.schema["doc_id"].dataType.simpleString()
        rows = map_rows(docs.select("doc_id", *_about(), text_of("text")), make, f"doc_id {key}, text binary, meta binary, text_size int, meta_size int")
        # features, not texts, are shuffled, and at every size
        free = rows.join(labels.select("doc_id").hint("merge"), "doc_id", "left_anti")
        self.blocks = cut(free.drop("doc_id").mapInArrow(_packed, "n int, text binary, text_n binary, text_size binary, meta binary, meta_n binary, meta_size binary"))

    def count(self) -> int:
        return self.blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def sums(self, views: list[np.ndarray], calibration: list[np.ndarray], new: list[np.ndarray] | None = None, keep: list[np.ndarray] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """By view, over all rows to which the other view gives a label: counts of the rows and of the bad ones with each
        candidate; or, of the ``new`` weights, the gradient by the candidates that are kept, and zeros."""
        known = self.known
        starts = np.cumsum([0, *(len(k) + 1 for k in known)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, starts[-1]))
            for block in (part for whole in batches for part in slices(whole, 1)):
                cells = [c[0].as_py() for c in block.columns[1:]]
                x = [Part(known[v], np.frombuffer(cells[3 * v], np.uint16).astype(np.int64), *(np.frombuffer(c, np.int32) for c in cells[3 * v + 1 : 3 * v + 3])) for v in (0, 1)]
                for v in (0, 1):
                    z = x[1 - v].logits(views[1 - v])
                    sure, bad = given(sigmoid(z * calibration[1 - v][0] + calibration[1 - v][1]))
                    own, mine, rows = total[:, starts[v] : starts[v + 1]], x[v], sure > 0
                    if 2 * rows.sum() < mine.n:
                        mine, sure, bad = mine.only(rows), sure[rows], bad[rows]
                    if new is None:
                        own += [mine.counts(sure), mine.counts(bad)]
                    else:
                        own[0] += mine.gradient(sure * (sigmoid(mine.logits(new[v])) - bad))
            if new is not None:
                total[0] *= np.concatenate([np.append(k, True) for k in keep])
            at = np.flatnonzero(total.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[0, at]), pa.array(total[1, at])], ["at", "a", "b"])

        got = self.blocks.mapInArrow(run, "at int, a double, b double").groupBy("at").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()
        total = np.zeros((2, starts[-1]))
        total[:, got["at"].to_numpy()] = [got["a"].to_numpy(), got["b"].to_numpy()]
        return [tuple(total[:, starts[v] : starts[v + 1]]) for v in (0, 1)]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, meta: places as bytes; text_size, meta_size) in blocks of up to 2,000, each a row of few large cells, so that the
    many passes over them have little to do for a document."""
    for batch in (part for whole in batches for part in slices(whole, 2000)):
        out = [pa.array([batch.num_rows], pa.int32())]
        for v in (0, 1):
            cells = batch.column(v).to_pylist()
            out += [pa.array([x], pa.binary()) for x in (b"".join(cells), np.array([len(c) // 2 for c in cells], np.int32).tobytes(), batch.column(2 + v).to_numpy().astype(np.int32).tobytes())]
        yield pa.RecordBatch.from_arrays(out, ["n", "text", "text_n", "text_size", "meta", "meta_n", "meta_size"])


def cotrain(text: list, meta: list, y: np.ndarray, pool: Pool, rounds: int = ROUNDS) -> Model:
    """Fit on labelled rows and the pool."""
    known = pool.known
    sizes = [np.array([len(x) for x in rows]) for rows in (text, meta)]
    at = [[Rows(x, np.array([len(x)])).places(k)[0] for x in rows] for k, rows in zip(known, (text, meta))]
    held_out = np.arange(len(y)) % 4 == 3

    def part(v: int, which: np.ndarray) -> Part:
        mine = [at[v][i] for i in np.flatnonzero(which)]
        return Part(known[v], np.concatenate(mine), np.array([len(x) for x in mine]), sizes[v][which])

    own, calibrating = [part(v, ~held_out) for v in (0, 1)], [part(v, held_out) for v in (0, 1)]
    mine, theirs = y[~held_out], y[held_out]

    def calibrated(w):
        return [platt(calibrating[v].logits(w[v])[:, None], theirs) for v in (0, 1)]

    def descend(w, keep, steps, rate, given_weight=(0, 0), outer=lambda w: ((0, 0), (0, 0)), l2=1.0):
        """Adam on both views at once; weights that are not kept stay zero."""
        w = [np.where(np.append(k, True), x, 0.0) for k, x in zip(keep, w)]
        m, q = ([np.zeros_like(x) for x in w] for _ in range(2))
        for t in range(1, steps + 1):
            far = outer(w)
            for v in (0, 1):
                g = own[v].gradient(sigmoid(own[v].logits(w[v])) - mine) + given_weight[v] * far[v][0]
                g[:-1] = np.where(keep[v], g[:-1] + l2 * w[v][:-1], 0)
                m[v], q[v] = 0.9 * m[v] + 0.1 * g, 0.99 * q[v] + 0.01 * g * g
                w[v] = w[v] - rate(t) * (m[v] / (1 - 0.9**t)) / (np.sqrt(q[v] / (1 - 0.99**t)) + 1e-9)
        return w

    def kept(n, n1):  # counts with the sum over rows last
        out = np.zeros(len(n) - 1, bool)
        out[significant(n[:-1], n1[:-1], n[-1], n1[-1])] = True
        return out

    counts = [(own[v].counts(np.ones(len(mine))), own[v].counts(mine)) for v in (0, 1)]
    base = float(np.log((mine.mean() + 1e-6) / (1 - mine.mean() + 1e-6)))
    keep = [kept(*c) for c in counts]
    w = descend([np.append(np.zeros(len(k)), base) for k in known], keep, 150, lambda t: 0.1)
    calibration = calibrated(w)
    for _ in range(rounds):
        before, by = w, calibration
        more = pool.sums(before, by)
        weight = [min(GIVEN, len(mine) / max(1.0, more[v][0][-1])) for v in (0, 1)]
        keep = [kept(*(c + weight[v] * x for c, x in zip(counts[v], more[v]))) for v in (0, 1)]
        w = descend(before, keep, STEPS_EACH, lambda t: 0.1 * (1 - (t - 1) / STEPS_EACH), weight, lambda new: pool.sums(before, by, new, keep))
        calibration = calibrated(w)
    views = []
    for v in (0, 1):
        view = View()
        view.features, view.w, view.b = known[v][keep[v]], w[v][:-1][keep[v]], float(w[v][-1])
        views.append(view)
    z = np.column_stack([calibrating[v].logits(w[v]) * calibration[v][0] + calibration[v][1] for v in (0, 1)])
    return Model(*views, calibration, platt(z, theirs))


def _about() -> list[Column]:
    return [F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long")]


def _features(docs: DataFrame, keep: list[str]) -> pa.Table:
    """``keep`` columns (ids first) and the features of both views, of one row of each id."""

    def make():
        read = held("cotrain", Reader)
        return lambda c: [*c[:-4], read.text(c[-1]).each(), read.meta(*c[-4:-1]).each()]

    kinds = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keep)
    rows = map_rows(docs.select(*keep, *_about(), text_of("text")), make, f"{kinds}, text_features array<int>, meta_features array<int>")
    one = rows.groupBy(*keep).agg(F.min(F.struct("text_features", "meta_features")).alias("f"))
    return one.select(*keep, "f.*").toArrow().combine_chunks().sort_by(keep[0])


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED) -> Model | None:
    """Co-train on a bounded sample of labelled documents and all unlabelled ones; None if a class has fewer than ten labels."""
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20))
    worst = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    n = worst.count()
    part = worst.where(place < int((1 << 20) * min(1.0, labelled / max(1, n))))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad")
    columns = docs.select("doc_id", "text", "lang", "source", "n_chars")
    got = _features(columns.join(F.broadcast(part.select("doc_id", bad)), "doc_id"), ["doc_id", "bad"])
    y = got["bad"].to_numpy().astype(float)
    if min(y.sum(), (1 - y).sum()) < 10:
        return None
    some = columns.where("doc_id is not null").where(place < int((1 << 20) * min(1.0, unlabelled / max(1, columns.count()))))
    other = _features(some.join(worst.select("doc_id"), "doc_id", "left_anti"), ["doc_id"])
    text, meta = _rows(got, "text_features"), _rows(got, "meta_features")
    known = [frequent([*text, *_rows(other, "text_features")]), frequent([*meta, *_rows(other, "meta_features")])]
    del other
    return cotrain(text, meta, y, Pool(docs, worst, known))


def _rows(table: pa.Table, name: str) -> list[np.ndarray]:
    """A column of lists as arrays, without copies."""
    out = []
    for chunk in table[name].chunks:
        flat, ends = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        out += [flat[a:b] for a, b in zip(ends, ends[1:])]
    return out


def bad_probability(model: Model | None, text: Column, lang: Column, source: Column, n_chars: Column) -> Column:
    """The model's probability that a document is bad."""
    if model is None:
        return F.lit(0.0)

    @F.arrow_udf("double")
    def score(texts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        read = held("cotrain", Reader)
        for columns in texts:
            done = []
            for i in range(0, len(columns[0]), 1000):
                t, *about = (c.slice(i, 1000).to_pylist() for c in columns)
                done.append(model.probability(read.read(t), read.meta(*about)))
            yield pa.array(np.concatenate(done) if done else [], pa.float64())

    return score(F.coalesce(text.cast("string"), F.lit("")), lang.cast("string"), source.cast("string"), n_chars.cast("long"))


def scored(docs: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """The documents with the combined probability of being bad in a column of that name."""
    model = fit(docs, labels)
    return docs.withColumn(name, bad_probability(model, F.col("text"), F.col("lang"), F.col("source"), F.col("n_chars")))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, bad_probability, kept`` of every row."""
    name = free_name(docs, "bad")
    return scored(docs, labels, name).select("doc_id", F.col(name).alias("bad_probability"), (F.col(name) < threshold).alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier doesn't reject."""
    name = free_name(docs, "bad")
    return scored(docs, labels, name).where(F.col(name) < threshold).drop(name)
