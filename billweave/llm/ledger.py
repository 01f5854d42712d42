"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one failure bit per rule.
A policy is a named, versioned mask over those bits, so applying another policy, or asking what a rule
contributes, reads only the ledger: no text is touched again.

Defined results: a null text is empty (all measures 0, fails ``few_words``); repeated rows are measured each
on its own; an empty table gives an empty ledger; extra columns are ignored; a null id is passed through.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, text_of

#: Characters counted as symbols (fixed by contract).
SYMBOLS = "#*$%&|<>"
#: A rule's bit is its place in this list.
RULES = ("few_words", "repeated_windows", "symbol_ratio", "duplicate_lines", "word_length")
#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbol_ratio", "duplicate_lines"),
    "v2": RULES,
}
MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"

_LINE_WITH_WORD = re.compile(r"[^\x20\x09-\x0D]")


def mask_of(policy: str) -> int:
    return sum(1 << RULES.index(r) for r in POLICIES[policy])


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in some 3-word window found at least twice in the text."""
    first: dict[tuple, int] = {}
    covered = bytearray(len(words))
    for i, window in enumerate(zip(words, words[1:], words[2:])):
        j = first.setdefault(window, i)
        if j != i:
            covered[i : i + 3] = b"\1\1\1"
            covered[j : j + 3] = b"\1\1\1"
    return sum(covered)


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    words = text.encode("utf-8", "surrogatepass").split()  # bytes.split() cuts at exactly \x20 \x09-\x0D
    lines = [x for x in text.split("\n") if _LINE_WITH_WORD.search(x)]
    blanks = sum(map(text.count, " \t\n\x0b\x0c\r"))
    return (len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(words))


def failure_bits() -> Column:
    """All rules over the measures, as bits of one long."""
    failed = {
        "few_words": F.col("n_words") < 50,
        "repeated_windows": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "symbol_ratio": 10 * F.col("n_symbols") > F.col("n_words"),
        "duplicate_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 12 * F.col("n_words")),
    }
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(failed[rule], F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the measures and ``failed_bits`` of every document; each text is read once."""

    def make():
        def work(columns):
            ids, texts = columns
            return [ids, *zip(*map(measure, texts))] if texts else [[] for _ in range(7)]

        return work

    key = docs.schema[id_col].dataType.simpleString()
    rows = map_rows(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col)), make, f"doc_id {key}, {MEASURES}")
    return rows.withColumn("failed_bits", failure_bits())


def apply_policy(ledger_rows: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with ``kept`` under a policy."""
    return ledger_rows.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(mask_of(policy))) == 0)


def ablation(ledger_rows: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: documents that fail it, and documents that it alone rejects.

    The ledger is first counted by bit pattern (at most 2 to the number of rules), with map-side combining.
    """
    mask = mask_of(policy)
    patterns = ledger_rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit")) for r in POLICIES[policy]])).alias("r")
    return (
        patterns.select("bits", "n", rules)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
            F.bit_or("bits").alias("seen_bits"),
        )
        .withColumn("policy", F.lit(policy))
    )
