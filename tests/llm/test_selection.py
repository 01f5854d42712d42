"""Source mixes, whitening and ranked search against plain versions, on awkward rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import IDS, NAMES, TEXTS, prose

from billweave.llm import lexical, mixing, queries, whiten
from billweave.llm.common import table

SF = "/root/testdata/sf0.001"


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes):
    """By the words of the rule: share by weight, stop at twice the size, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full, each = set(), 0.0
    while True:
        free = [s for s in names if s not in full]
        if not free:
            break
        each = (1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in free)
        above = {s for s in free if each * weight[s] > 2 * sizes[s]}
        if not above:
            break
        full |= above
    return {s: min(each * weight[s], 2.0 * sizes[s]) for s in names}


def number(text):
    return (int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)


def plain_mix(rows):
    """(id, size, source size, target, taken) of rows (id, text, source), a class at a time."""
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += n_words(text)
    aims, out = plain_targets(sizes), []
    for source, total in sizes.items():
        often = aims[source] / total if total else 0.0
        copies, part = math.floor(often), often - math.floor(often)
        classes = defaultdict(list)
        for i, text, s in rows:
            if s == source:
                n = n_words(text)
                key = "/".join(["mix", *([] if i is None else [str(i)]), hashlib.md5((text or "").encode()).hexdigest()])
                classes[math.floor(math.log(n) * 23) if n else -1].append((number(key), i, n))
        taken, wanted, rest = 0.0, 0.0, total
        for kind in sorted(classes, reverse=True):
            some = sorted(classes[kind], key=lambda r: r[0])
            words, pick = sum(r[2] for r in some), 0
            rest -= words
            if words:
                mean = words / len(some)
                wanted += part * words
                pick = int((wanted - taken) / mean + number(f"mix/{'' if source is None else 's' + source}/{kind}"))
                pick = min(max(pick, math.ceil((total * part - taken - rest) / mean - 1e-9)), math.floor((total * part - taken) / mean + 1e-9))
                pick = min(max(pick, 0), len(some))
                taken += pick * mean
            out += [(i, n, total, aims[source], (copies + (k < pick)) * n) for k, (_, i, n) in enumerate(some)]
    return out


@pytest.fixture(scope="module")
def sourced(spark):
    names = ["a", "é", None, "", "Z"]
    rows = [(i, t, "en", names[k % 5], 0, *["x"] * 4, 1, "x", "x") for k, (i, t) in enumerate(zip(IDS, TEXTS))]
    rows += [(100 + k, prose(20 + k % 37, k), "en", names[k * k % 5], 0, *["x"] * 4, 1, "x", "x") for k in range(300)]
    rows += [(7, "one text of many rows", "en", "Z", 0, *["x"] * 4, 1, "x", "x")] * 50  # more than any other document
    return spark.createDataFrame(rows, NAMES).repartition(5), [(r[0], r[1], r[3]) for r in rows]


def test_mix(sourced):
    docs, rows = sourced
    got = mixing.plan(docs).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    want = sorted(plain_mix(rows), key=repr)
    assert sorted(((r[0], *r[2:]) for r in got), key=repr) == [tuple(w) for w in want]
    for source, aim in plain_targets(Counter({s: sum(n_words(t) for _, t, x in rows if x == s) for s in {r[2] for r in rows}})).items():
        assert abs(sum(r["taken"] for r in got if r["source"] == source) - aim) <= 0.01 * aim + 3
    assert mixing.plan(docs.limit(0)).count() == 0


def test_mix_in_small_parts(sourced, monkeypatch):
    """Other partitions, tables of limits that are too large to broadcast, and several documents a bin, give the same."""
    docs, rows = sourced
    docs = docs.repartition(2)
    monkeypatch.setattr("billweave.llm.common.SMALL", 0)
    monkeypatch.setattr(mixing, "BINS", 2)
    got = mixing.plan(docs).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, plain_mix(rows)), key=repr)


def test_mixed_documents(sourced):
    docs, rows = sourced
    often = Counter()
    for r in mixing.plan(docs).collect():
        often[r["doc_id"], r["digest"]] += r["copies"]
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert Counter((r["doc_id"], hashlib.md5((r["text"] or "").encode()).hexdigest()) for r in out.select("doc_id", "text").collect()) == +often


def test_unequal_odds(spark):
    """Just so many documents as wanted are taken, in proportion to what they are preferred by."""
    docs = spark.createDataFrame([(i, "five words in each text", "s" if i < 300 else "t", (0.5, 1.0, 1.5)[i % 3]) for i in range(600)], "doc_id long, text string, source string, wish double")
    got = mixing.plan(docs, weights=(1, 3), share=1.0, prefer=F.col("wish")).where("source = 's'").collect()
    taken = [sum(r["copies"] for r in got if r["doc_id"] % 3 == k) for k in range(3)]
    assert sum(taken) == 150 and got[0]["target"] == 750.0 and all(abs(n - want) < 15 for n, want in zip(taken, (25, 50, 75)))


def plain_whitened(rows, k=4):
    kept = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    sizes = Counter(len(x) for x in {tuple(x) for _, x in kept})
    d = max(sizes, key=lambda s: (sizes[s], s), default=0)
    kept = [(i, x) for i, x in kept if len(x) == d]
    unique = sorted({tuple(x) for _, x in kept})
    n, sums = len(unique), [sum(c) for c in zip(*unique)]
    a = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in unique])
    v = a.T @ a / n
    e, u = np.linalg.eigh(v)
    order = [j for j in range(d - 1, -1, -1) if e[j] > 1e-10 * np.trace(v)][:k]
    out = []
    for i, x in kept:
        off = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        y = np.array([(n * c - s) / n for c, s in zip(x, sums)]) @ u[:, order] / np.sqrt(e[order])
        out += [(i, j + 1, n, off if off < 1 << 63 else None, abs(y[j]), e[order[j]] / np.trace(v)) for j in range(len(order))]
    return out


def assert_whitened(spark, rows, schema="vec_id long, embedding array<float>, n long, x string, component string"):
    d = spark.createDataFrame([(i, v, 1, "x", "x") for i, v in rows], schema).repartition(3)
    got = whiten.transform(d, whiten.fit(d)).collect()
    key = lambda r: (repr(r[0]), r[1], r[3] or 0, round(abs(r[4]), 4))
    stored = [(r["vec_id"], r["embedding"]) for r in d.select("vec_id", "embedding").collect()]
    want = plain_whitened(stored)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert tuple(g)[:4] == w[:4] and abs(g["whitened"]) == pytest.approx(w[4], abs=1e-6) and g["explained"] == pytest.approx(w[5], rel=1e-6) and g["identity_error"] < 1e-4
    return got


def test_whitening(spark):
    r = np.random.default_rng(5)
    rows = [(k, (r.normal(size=9) * np.arange(1, 10)).tolist()) for k in range(200)]
    rows += [(900, None), (901, []), (902, [1.0, None] * 4 + [1.0]), (903, [float("nan")] * 9), (904, [float("inf")] * 9), (905, [1.0] * 5), (906, [-0.0] * 9), (None, [0.5] * 9)]
    rows += [(5, rows[5][1])] * 60 + [(7000, rows[6][1])]
    got = assert_whitened(spark, rows)
    signs = defaultdict(set)
    for g in got:
        if g["vec_id"] == 5:
            signs[g["component"]].add(g["whitened"])
    assert all(len(s) == 1 for s in signs.values()) and {g["n"] for g in got} == {202}
    assert_whitened(spark, [(k, [float(k), 2.0 * k, 0.0]) for k in range(9)])  # rank one
    for few in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3, [(1, None)]):
        d = spark.createDataFrame(few, "vec_id long, embedding array<float>")
        assert whiten.transform(d, whiten.fit(d)).count() == 0


def test_whitening_of_large_numbers(spark):
    """Sums of squares stay exact where machine integers would overflow."""
    r = np.random.default_rng(6)
    for scale in (1e6, 1e12):
        assert_whitened(spark, [(k, (r.normal(size=4) * scale).tolist()) for k in range(50)], "vec_id long, embedding array<double>, n long, x string, component string")


def test_square_sums():
    r = np.random.default_rng(7)
    c = r.integers(-(1 << 41), 1 << 41, (5000, 3))
    assert whiten.square_sums(c) == [sum(int(v) ** 2 for v in column) for column in c.T]
    assert whiten.square_sums(c.astype(object)) == whiten.square_sums(c)


def test_contract_of_whitening(spark):
    got = queries.op12_whitened_embeddings(spark, SF).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, SF, "embeddings").collect()]
    want = {(w[0], w[1]): w for w in plain_whitened(rows)}
    assert len(got) == len(want) == 4 * len(rows)
    for g in got:
        w = want[g["vec_id"], g["component"]]
        assert (g["n"], g["deviation"]) == w[2:4] and abs(g["whitened"]) == pytest.approx(w[4], abs=1e-7) and g["explained"] == pytest.approx(w[5], rel=1e-7)


def plain_search(docs, items, k=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts = [(i, Counter(words(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df, out = Counter(w for _, c in counts for w in c), []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 100 - 75 + 75 * sum(c.values()) * n_docs // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if t in c)
            if score:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return out


ITEMS_ = [(1, prose(30, 2)), (1, prose(30, 2)), (2, "The, the; THE river été 日本 nowhere"), (3, None), (4, "  ,;"), (None, "stone x1 lamp"), (5, "the " * 500), (6, prose(400, 9)), (7, "absent entirely")]


@pytest.mark.parametrize("small", [False, True])
def test_search(spark, monkeypatch, small):
    if small:
        for name, value in (("ITEMS", 2), ("DOCS", 3), ("COLUMNS", 4), ("BLOCK", 7), ("EXACT", 1 << 33), ("GROUP", 100)):
            monkeypatch.setattr(lexical, name, value)
    rows = [*zip(IDS, TEXTS), *[(50 + k, prose(40, k % 3)) for k in range(25)], *[(50, prose(40, 0))] * 3]
    docs = spark.createDataFrame([(i, t, *["x"] * 3) for i, t in rows], "doc_id long, text string, term string, tf string, N string").repartition(4)
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS_], "item_id long, text string, score string")
    got = lexical.search(docs, items, group=lexical.GROUP).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_search(rows, ITEMS_), key=repr)


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs, items).count() == 1


def test_contract_of_search(spark):
    docs, items = (table(spark, SF, n).collect() for n in ("documents", "benchmark"))
    got = queries.op13_lexical_search(spark, SF).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_search([(r["doc_id"], r["text"]) for r in docs], [(r["item_id"], r["text"]) for r in items]), key=repr)
