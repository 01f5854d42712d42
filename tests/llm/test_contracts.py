"""The registered queries themselves on a whole small table, against plain versions of what they must return."""

import hashlib
import zlib
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_operators import plain_base, plain_components, plain_fingerprint, plain_leaks, plain_scores

from billweave.llm import byte_bpe, queries
from billweave.llm.common import table
from billweave.llm.units import load

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").collect()}


def rows_of(spark, name):
    found = queries.QUERIES[name](spark, SF).collect()
    return {r["doc_id"]: r for r in found}, len(found)


def test_op1(spark, texts):
    got, n = rows_of(spark, "op1_byte_bpe")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert n == len(texts) == len(got)
    for i, t in texts.items():
        ids = enc.encode_ordinary(t)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_op2_and_op9(spark, texts):
    counts, n = rows_of(spark, "op2_token_counts")
    files, m = rows_of(spark, "op9_token_file")
    assert n == m == len(texts)
    tok, start = load(public_tokenizers.path("byte_bpe_50k.json")), 0
    for i in sorted(texts):
        ids = tok.encode(texts[i], add_special_tokens=False).ids
        assert (counts[i]["n_bytes"], counts[i]["n_tokens"], counts[i]["over_limit"]) == (len(texts[i].encode()), len(ids), len(ids) > 512)
        assert (files[i]["start"], files[i]["n_tokens"], files[i]["ids_crc32"]) == (start, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes()))
        start += len(ids) + 1


def test_op3(spark, texts):
    got, n = rows_of(spark, "op3_secret_scan")
    assert n == len(texts)
    for i, t in texts.items():
        base = plain_base(t)
        kinds = [k for _, _, k in base]
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [kinds.count(k) for k in ("assign", "access", "hex")]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
        spans = [s for s in got[i]["spans"].split(",") if s]
        assert [s for s in spans if not s.startswith("guess")] == [f"{k}:{a}:{b}" for a, b, k in base] and spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), ("assign", "access", "hex", "guess").index(s.split(":")[0])))


def test_op4(spark, texts):
    bench = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    short = [(i, t) for i, t in texts.items() if len(t) < 500][:60]
    got = queries.QUERIES["op4_decontaminate"](spark, SF).collect()
    of = {i for i, _ in short}
    assert sorted(((r[0], r[1], round(r[2], 9), r[3]) for r in got if r[0] in of), key=repr) == plain_leaks(short, bench)


def test_op5(spark, texts):
    got, n = rows_of(spark, "op5_simhash_dedup")
    ids = sorted(texts)
    fps = [plain_fingerprint(texts[i]) for i in ids]
    label = plain_components([(a, b) for a in range(len(ids)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3], len(ids))
    least = {}
    for i, x in zip(ids, label):
        least.setdefault(x, i)
    assert n == len(ids) and all((got[i]["fingerprint"], got[i]["component_id"]) == (f"{f:016x}", least[x]) for i, f, x in zip(ids, fps, label))


def test_op6(spark, texts):
    got, n = rows_of(spark, "op6_cotrained_quality")
    labels = table(spark, SF, "labels").collect()
    good = {r["doc_id"] for r in labels if r["quality"] == 1 and r["toxic"] == 0}
    assert n == len(texts) and all(r["kept"] == (r["bad_probability"] < 0.5) for r in got.values())
    assert sum(got[i]["kept"] for i in good) >= 0.9 * len(good)


class PlainArticle(HTMLParser):
    """The text of a page's article, by the standard parser; blocks are what stands between tags of blocks."""

    def __init__(self):
        super().__init__()
        self.inside, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.parts.append(" " if tag in ("p", "h1", "br", "article") else "")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.parts.append(" ")

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_op8(spark, sf):
    """Whole texts of all pages: here the article is all that isn't around it, and nothing of it goes."""
    got = {(r["page_id"], r["url"]): r for r in queries.QUERIES["op8_main_text"](spark, sf).collect()}
    pages = table(spark, sf, "pages").collect()
    assert len(got) == len(pages)
    for r in pages:
        plain = PlainArticle()
        plain.feed(r["html"] or "")
        plain.close()
        text = " ".join("".join(plain.parts).split())
        assert got[r["page_id"], r["url"]]["text"] == text and got[r["page_id"], r["url"]]["n_chars"] == len(text)


def test_op10(spark, texts):
    got, n = rows_of(spark, "op10_lm_score")
    fold = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    want, _, unigram = plain_scores([t for i, t in texts.items() if not fold[i]], list(texts.items()))
    assert n == len(texts)
    for i, tokens, known, base, score in want:
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold[i], tokens, known, sum(unigram.values()))
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)
