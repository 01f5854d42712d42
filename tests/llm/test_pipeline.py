"""The pipeline on small tables, stage by stage against plain versions of each decision."""

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from billweave.llm import byte_bpe, decontaminate, secrets, simhash
from billweave.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(autouse=True)
def nothing_stays_cached(spark):
    """Stages are cached here to be looked at in turn."""
    yield
    spark.catalog.clearCache()


def test_stages(spark):
    docs = table(spark, SF, "documents").withColumn("row", F.lit("x"))
    bench = [(r["item_id"], decontaminate.word_hash, r["text"]) for r in table(spark, SF, "benchmark").collect()]
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stage(spark, docs, SF).cache()
        after = {r["doc_id"]: r for r in docs.collect()}
        held[name] = after
        assert set(after) <= set(before) and len(after) == docs.count()
        if name == "quality classifier":
            bad = {r["doc_id"] for r in table(spark, SF, "labels").where("quality = 0 or toxic = 1").collect()}
            good = {r["doc_id"] for r in table(spark, SF, "labels").where("quality = 1 and toxic = 0").collect()}
            assert len(bad & set(after)) <= 0.35 * len(bad) and len(good & set(after)) >= 0.99 * len(good)
        if name == "near duplicates":
            fps = {i: simhash.fingerprint(r["text"]) % (1 << 64) for i, r in before.items()}
            close = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3
            assert not any(close(a, b) for a in after for b in after if a < b)
            assert all(any(close(a, b) for b in before if b != a) for a in set(before) - set(after))
        if name == "benchmark decontamination":
            flat = lambda t: " ".join(t.lower().split())
            assert set(before) - set(after) == {i for i, r in before.items() if any(flat(b) in flat(r["text"]) for _, _, b in bench)}
        if name == "secret scan":
            assert set(after) == set(before)
            guesser = secrets.Guesser(secrets.dictionary(spark.createDataFrame([(r["text"],) for r in before.values()], "text string")))
            for i, r in after.items():
                assert r["text"] == secrets.redact(before[i]["text"], secrets.find_spans(before[i]["text"], guesser=guesser)) and r["n_chars"] == len(r["text"])
        if name == "byte-level BPE":
            enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
            assert set(after) == set(before) and all(r["decodes"] and r["ids"] == enc.encode_ordinary(before[i]["text"]) for i, r in after.items())


def test_awkward_rows(spark):
    """Nulls, empty texts, repeated rows and clashing names go through every stage; so do empty tables."""
    small = "/root/testdata/sf0.001"
    docs = table(spark, small, "documents")
    rows = [(None, None, None, None, None), (9001, "", "en", "s", 0), (9002, None, None, "s", None), (9003, "password = 'xK9#mQ2$vL7p' and more", "en", "s", None), (9003, "password = 'xK9#mQ2$vL7p' and more", "en", "s", None), (None, "one row without an id", None, None, 3)]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    for name in ("bad", "keep", "KEEP_", "fp", "row", "gone"):
        docs = docs.withColumn(name, F.lit(name))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), small).count() == 0
        after = stage(spark, docs, small).cache()
        ids = [r["doc_id"] for r in after.select("doc_id").collect()]
        if name == "byte-level BPE":
            assert after.columns == ["doc_id", "n_tokens", "ids", "decodes"] and after.where("not decodes").count() == 0
            continue
        assert after.columns == docs.columns
        if name == "quality classifier":
            continue  # what it rejects is its own affair; the others get every row
        if name == "near duplicates":
            assert ids.count(9003) == 1 and len(set(ids) & {9001, 9002}) == 1 and ids.count(None) == 1  # the null text has a group with an id
        if name == "secret scan":
            (r,) = after.where("doc_id = 9003").collect()
            assert r["text"] == "password = '[SECRET]' and more" and r["n_chars"] == len(r["text"])
        docs = after


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
