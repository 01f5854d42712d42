"""The registered queries of the training-data operators: thin digests over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, cotrain, decontaminate, html_text, kneser_ney, ledger, lexical, mixing, pfor, secrets, simhash, token_counts, whiten
from .common import table

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
BPE_JSON = "byte_bpe_50k.json"
TOKEN_LIMIT = 512
END_ID = 2


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_JSON))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger.apply_policy(ledger.ledger(table(spark, sf_dir, "documents")), "v1")
    base_failed = F.col("failed_bits").bitwiseAND(F.lit(ledger.mask_of("base"))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), "kept", "n_lines", "failed_bits")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = pfor.write(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_JSON), END_ID)
    return pfor.read(files)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = kneser_ney.held_out("doc_id")
    model = kneser_ney.train(docs.where(~held_out))
    return kneser_ney.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.words.total).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' sizes, their sources' targets and the words the mix takes of each."""
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's first four whitened components."""
    rows = table(spark, sf_dir, "embeddings")
    return whiten.transform(rows, whiten.fit(rows))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP7_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
tokens AS (
    SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i
    FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM docs)
),
per_word AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM tokens GROUP BY doc_id),
windows AS (
    SELECT doc_id, i, word AS a, lead(word, 1) OVER w AS b, lead(word, 2) OVER w AS c
    FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY i)
),
twice AS (
    SELECT doc_id, i FROM windows WHERE c IS NOT NULL
    QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1
),
repeated AS (
    SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS offsets(k) GROUP BY doc_id
),
lines AS (
    SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
),
measured AS (
    SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
           coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
           coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM docs d LEFT JOIN per_word USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)
),
judged AS (
    SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words OR word_chars > 12 * n_words THEN 16 ELSE 0 END)::BIGINT AS failed_bits
    FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed_bits & 3 <> 0 AS base_failed, failed_bits & 15 = 0 AS kept, n_lines, failed_bits
FROM judged
"""

_RANDOM = "((('0x' || substr({}, 1, 13))::BIGINT + 0.5) / 4503599627370496)"
OP11_SQL = rf"""
WITH RECURSIVE docs AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           {_RANDOM.format("md5(concat_ws('/', 'mix', doc_id::VARCHAR, md5(coalesce(text, ''))))")} AS u
    FROM documents),
sized AS (SELECT *, CASE WHEN size = 0 THEN -1 ELSE floor(ln(greatest(size, 1)) * 23) END::INTEGER AS class FROM docs),
sources AS (
    SELECT source, s, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
    FROM (SELECT source, sum(size)::BIGINT AS s FROM docs GROUP BY source)),
levels AS (  -- the amount of one weight, if the sources that fill up before this one are full
    SELECT *, (1.5::DOUBLE * sum(s) OVER () - coalesce(2 * sum(s) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS each
    FROM sources WINDOW before AS (ORDER BY s::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aims AS (SELECT source, s, least((SELECT each FROM levels WHERE each * w <= 2 * s ORDER BY s::DOUBLE / w, source NULLS LAST LIMIT 1) * w, (2 * s)::DOUBLE) AS target FROM sources),
often AS (SELECT source, s, target, CASE WHEN s > 0 THEN target / s ELSE 0 END AS r FROM aims),
classes AS (
    SELECT d.source, class, count(*) AS n, sum(size)::BIGINT AS words, any_value(r) - floor(any_value(r)) AS part, row_number() OVER (PARTITION BY d.source ORDER BY class DESC) AS k,
           (sum(sum(size)) OVER (PARTITION BY d.source))::BIGINT AS own, (coalesce(sum(sum(size)) OVER (PARTITION BY d.source ORDER BY class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest
    FROM sized d JOIN often o ON d.source IS NOT DISTINCT FROM o.source GROUP BY d.source, class),
drawn AS (SELECT *, {_RANDOM.format("md5('mix/' || CASE WHEN source IS NULL THEN '' ELSE 's' || source END || '/' || class)")} AS draw FROM classes),
folded AS (
    SELECT source, 0::BIGINT AS k, NULL::INTEGER AS class, 0::BIGINT AS n, 0::BIGINT AS pick, 0::DOUBLE AS wanted, 0::DOUBLE AS taken FROM aims
    UNION ALL
    SELECT source, k, class, n, pick, wanted, taken + pick * (words / n) FROM (
        SELECT c.source, c.k, c.class, c.n, c.words, f.taken, f.wanted + c.part * c.words AS wanted,
               CASE WHEN c.words = 0 THEN 0 ELSE least(greatest(least(greatest(trunc((f.wanted + c.part * c.words - f.taken) / (c.words / c.n) + c.draw), ceil((c.own * c.part - f.taken - c.rest) / (c.words / c.n) - 1e-9::DOUBLE)),
                   floor((c.own * c.part - f.taken) / (c.words / c.n) + 1e-9::DOUBLE)), 0), c.n) END::BIGINT AS pick
        FROM folded f JOIN drawn c ON f.source IS NOT DISTINCT FROM c.source AND c.k = f.k + 1)),
ranked AS (
    SELECT d.*, f.pick, row_number() OVER (PARTITION BY d.source, d.class ORDER BY CASE WHEN f.pick > 0 AND f.pick < f.n THEN (u / (1 - u)) / ((f.pick / f.n) / (1 - f.pick / f.n)) ELSE u END) AS place
    FROM sized d JOIN folded f ON d.source IS NOT DISTINCT FROM f.source AND d.class = f.class)
SELECT doc_id, size, o.s AS source_size, o.target, ((floor(o.r) + CASE WHEN place <= pick THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM ranked d JOIN often o ON d.source IS NOT DISTINCT FROM o.source
"""

OP13_SQL = r"""
WITH parts AS (
    SELECT doc_id, row_no, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT doc_id, text, row_number() OVER () AS row_no FROM documents)),
asked AS (
    SELECT item_id, item_no, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT item_id, text, row_number() OVER () AS item_no FROM benchmark)),
sizes AS (SELECT row_no, count(*) AS n FROM parts GROUP BY row_no),
whole AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM sizes),
tfs AS (SELECT row_no, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM parts WHERE term IN (SELECT term FROM asked) GROUP BY row_no, term),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, whole GROUP BY term),
impacts AS (SELECT row_no, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * big_n) // big_l)) AS impact FROM tfs JOIN sizes USING (row_no), whole),
scores AS (
    SELECT item_no, any_value(item_id) AS item_id, row_no, any_value(doc_id) AS doc_id, sum(w * impact)::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY item_no, row_no HAVING sum(w * impact) > 0)
SELECT item_id, (row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score FROM scores
QUALIFY row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id NULLS LAST) <= 10
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe,
        op2_token_counts,
        op3_secret_scan,
        op4_decontaminate,
        op5_simhash_dedup,
        op6_cotrained_quality,
        op7_quality_rules,
        op8_main_text,
        op9_token_file,
        op10_lm_score,
        op11_source_mix,
        op12_whitened_embeddings,
        op13_lexical_search,
    )
}
ORACLES = {"op7_quality_rules": OP7_SQL, "op11_source_mix": OP11_SQL, "op13_lexical_search": OP13_SQL}
