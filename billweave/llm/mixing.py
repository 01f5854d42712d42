"""Mixing sources to target weights by Pareto order sampling.

1. A document's size is its number of words. Sources in order of code points, null last, weigh ``weights`` in turn and share
   ``share`` times all sizes; a target stops at ``most`` times its source's size, and the excess is shared again by weight until
   none is above (Newton's steps on the amount of one weight; only three sums a step reach the driver).
2. A source's target over its size is how often it is wanted. Its whole part is certain: so many copies of every document. For the
   rest the source's documents are dealt to classes of nearly equal size (``STEPS`` to a factor of e), and each class gets a fixed
   number of documents. Going down the classes, numbers are rounded at random around what is still wanted, so that the words taken
   follow the target and each class gets its share on average; but a class takes no more than is left of the target, and no less than
   what smaller documents can't make up for.
3. In a class documents are ranked by random odds over inclusion odds, ``u / (1 - u) : p / (1 - p)``, and the least are taken, as
   many as the class's number (Pareto order sampling). ``p`` is in proportion to ``prefer``, equal by default.

The rank to stop at is found by counting: how many documents are in each of ``BINS`` bins of the ranking variable, then at each
value in the bin that holds the limit, then among equal documents by partition and row. So a class of any size is cut exactly
without being sorted, and nothing but counts leaves the tasks. Random numbers are hashes of a seed, the id and the text, so reruns
agree whatever the partitions.

Defined results: a null or empty text has size 0 and takes nothing; a null source is one of its own, the last; null ids are allowed;
rows of one id and one text are documents of their own, told apart by their place only; where ``prefer`` is null or not above zero a
document comes last in its class; an empty table gives an empty result; extra columns are ignored by ``plan`` and kept by ``mixed``.
"""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, join_small, text_of

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Size classes to a factor of e, and bins of the ranking variable.
STEPS, BINS = 23, 1024
WORD = r"[^\x20\x09-\x0D]+"
_SOURCE, _CLASS = ["src", "nul"], ["src", "nul", "class"]


def uniform(digest: Column) -> Column:
    """A number above 0 and below 1 from the first 13 hexadecimal digits."""
    return (F.conv(F.substr(digest, F.lit(1), F.lit(13)), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, prefer: Column | None, seed: str) -> DataFrame:
    """``doc_id, src, nul, size, class, u, odds, row`` of every row, written once: later steps don't read texts."""
    draw = uniform(F.md5(F.concat_ws("/", F.lit(seed), F.col("doc_id").cast("string"), F.md5("text"))))
    source = F.col(source_col).cast("string")
    wish = F.lit(1.0) if prefer is None else F.coalesce(F.greatest(prefer.cast("double"), F.lit(0.0)), F.lit(0.0))
    d = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col), F.coalesce(source, F.lit("")).alias("src"), source.isNull().alias("nul"), wish.alias("prefer"))
    size = F.regexp_count("text", F.lit(WORD)).cast("long")
    d = d.select("doc_id", "src", "nul", "prefer", size.alias("size"), draw.alias("u"), F.md5("text").alias("digest"), F.monotonically_increasing_id().alias("row"))
    return cut(d.withColumn("class", F.when(F.col("size") == 0, -1).otherwise(F.floor(F.ln("size") * STEPS)).cast("int")))


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``src, nul, source_size, target`` of sources with their sizes."""
    by_name = [F.col("nul"), F.col("src")]
    ranged = cut(sources.repartitionByRange(*by_name).withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    ahead = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))  # one row a partition
    place = F.col("ahead") + F.row_number().over(Window.partitionBy("part").orderBy(*by_name)) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    d = cut(ranged.join(ahead, "part").select(*_SOURCE, "source_size", weight.cast("long").alias("weight")))

    total, left = (int(x or 0) for x in d.agg(F.sum("source_size"), F.sum("weight")).first())
    full, each = 0, 0.0
    while left:
        each = (share * total - full) / left
        above = F.lit(each) * F.col("weight") > most * F.col("source_size")
        now = d.agg(F.sum(F.when(above, most * F.col("source_size"))), F.sum(F.when(~above, F.col("weight")))).first()
        now = tuple(int(x or 0) for x in now)
        if now == (full, left):
            break
        full, left = now
    return d.select(*_SOURCE, "source_size", F.least(F.lit(each) * F.col("weight"), (most * F.col("source_size")).cast("double")).alias("target"))


def _numbers(rows: pd.DataFrame, seed: str) -> pd.DataFrame:
    """How many documents each class of one source gives beyond the whole copies; ``rows`` has a row a class."""
    rows = rows.sort_values("class", ascending=False)
    taken, wanted, rest, out = 0.0, 0.0, int(rows["words"].sum()), []
    aim = rest * rows["part"].iloc[0]
    for src, nul, kind, n, words, part in zip(*(rows[c] for c in ("src", "nul", "class", "n", "words", "part"))):
        mean = words / n
        wanted += part * words
        draw = (int(hashlib.md5(f"{seed}/{'' if nul else 's'}{src}/{kind}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        rest -= words
        least, most = ((aim - taken - rest) / mean, (aim - taken) / mean) if words else (0, 0)
        pick = int((wanted - taken) / mean + draw) if words else 0
        pick = min(max(pick, math.ceil(least - 1e-9)), math.floor(most + 1e-9))  # smaller documents must be enough for what is left
        pick = min(max(pick, 0), n)
        taken += pick * mean
        out.append(pick)
    return rows[_CLASS].assign(n=rows["n"], pick=out, copies=rows["copies"], prefer_sum=rows["prefer_sum"])


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, prefer: Column | None = None, seed: str = "mix") -> DataFrame:
    """Each row's ``doc_id, source, size, source_size, target, copies, taken, digest`` (of the text)."""
    rows = measured(docs, id_col, text_col, source_col, prefer, seed)
    classes = cut(rows.groupBy(*_CLASS).agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.sum("prefer").alias("prefer_sum")))
    aims = targets(classes.groupBy(*_SOURCE).agg(F.sum("words").alias("source_size")), weights, share, most)
    often = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(often)
    d = classes.join(aims, _SOURCE).withColumn("copies", whole.cast("int")).withColumn("part", often - whole)
    kinds = "src string, nul boolean, class int, n long, pick long, copies int, prefer_sum double"
    picks = cut(d.groupBy(*_SOURCE).applyInPandas(lambda rows: _numbers(rows, seed), kinds))

    odds = lambda p: p / (1 - p)
    share_of = F.least(F.when(F.col("prefer_sum") > 0, F.col("pick") * F.col("prefer") / F.col("prefer_sum")).otherwise(0.0), F.lit(1 - 2.0**-40))
    ratio = odds(F.col("u")) / odds(F.greatest(share_of, F.lit(2.0**-400)))
    ranked = join_small(rows, picks, _CLASS, "row").withColumn("v", ratio / (1 + ratio)).withColumn("bin", F.floor(F.col("v") * BINS)).withColumn("at", F.shiftright("row", 33))

    key = ["bin", "v", "at", "row"]
    limit = cut(picks.where("pick > 0 and pick < n").select(*_CLASS, F.col("pick").alias("k")))
    for i, name in enumerate(key):
        same = join_small(ranked.select(*_CLASS, *key[: i + 1], *(["row"] if i < 3 else [])), limit, [*_CLASS, *key[:i]], "row")
        counts = same.groupBy(*_CLASS, *key[: i + 1], "k").agg(F.count("*").alias("m"))
        upto = F.sum("m").over(Window.partitionBy(*_CLASS).orderBy(name))
        here = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("m") < F.col("k")))
        limit = cut(here.select(*_CLASS, *key[: i + 1], (F.col("k") - F.col("upto") + F.col("m")).alias("k")))
    last = limit.select(*_CLASS, F.struct(*key).alias("last"))
    d = join_small(join_small(ranked, last, _CLASS, "row", "left"), aims, _SOURCE, "row")
    more = (F.col("pick") == F.col("n")) | F.coalesce(F.struct(*key) <= F.col("last"), F.lit(False))
    copies = F.col("copies") + (more & (F.col("pick") > 0)).cast("int")
    return d.select("doc_id", F.when(~F.col("nul"), F.col("src")).alias("source"), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), "digest")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kind) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as ``plan`` takes it, zero times or more. Of rows with one id and one text
    the first stands for all."""
    often = plan(docs, id_col, text_col, **kind).groupBy("doc_id", "digest").agg(F.sum("copies").alias("copies")).where("copies > 0")
    names = [free_name(docs, c) for c in ("own_id", "own_digest", "times", "copy")]
    often = often.select(F.col("doc_id").alias(names[0]), F.col("digest").alias(names[1]), F.col("copies").alias(names[2]))
    key = docs.withColumn(names[1] + "_", F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    one = key.dropDuplicates([id_col, names[1] + "_"])
    d = one.join(often, F.col(id_col).eqNullSafe(F.col(names[0])) & (F.col(names[1] + "_") == F.col(names[1])))
    return d.withColumn(names[3], F.explode(F.sequence(F.lit(1), F.col(names[2]).cast("int")))).select(*docs.columns)
