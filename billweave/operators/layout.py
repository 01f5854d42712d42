"""Words with page coordinates to lines and cells.

Everything is keyed by document and page, so one hash partitioning on them serves the whole chain: words that come dealt by ``doc_id``
are not moved again, and documents or invoices are smaller to deal than the words made of them. What is found on lines takes a page's
lines as an array of its row (``gathered``), and so needs no second pass over them; a step adds a column to such a page (``with_steps``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_noise, let

#: A wider gap than this many average characters starts a new cell.
CELL_GAP = 1.8
PAGE = ("doc_id", "page")


#: A step's name, and its value from a page: anything that gives a column by its name.
Steps = tuple[tuple[str, Callable], ...]


def with_steps(pages: DataFrame, steps: Steps, *wanted: str) -> DataFrame:
    """``doc_id, page`` and the ``wanted`` columns after steps. A page's columns are bound together, as one that a step's lambdas name
    by itself would be worked out again for every element."""
    d = pages.select(*PAGE, F.struct(*(c for c in pages.columns if c not in PAGE)).alias("p"))
    for name, value in steps:
        d = d.withColumn("p", let(F.col("p"), lambda p: p.withField(name, value(p))))  # noqa: B023
    return d.withColumn("p", let(F.col("p"), lambda p: F.struct(*(p[c].alias(c) for c in wanted)))).select(*PAGE, "p.*")


def over_runs(items: Column, begins: Callable[[Column], Column], value: Callable[[Column, Column], Column]) -> Column:
    """``value(elements, number)`` of each run of an array: one starts at the first element, and wherever ``begins(element)``."""

    def each(w: Column, starts: Column) -> Column:
        return F.transform(starts, lambda a, k: let(F.slice(w, a + 1, F.coalesce(F.get(starts, k + 1), F.size(w)) - a), lambda r: value(r, k)))

    places = lambda w: F.filter(F.transform(w, lambda x, i: F.when((i == 0) | begins(x), i)), lambda i: i.isNotNull())
    return let(items, lambda w: let(places(w), lambda starts: each(w, starts)))


def without_noise(words: DataFrame) -> DataFrame:
    return words.where(~F.coalesce(is_noise(F.col("text"), F.col("confidence")), F.lit(False)))


def mean_confidence(confidence: Column) -> Column:
    """Average of the known confidences (not negative), 0 if none is known."""
    return F.coalesce(F.avg(F.when(confidence >= 0, confidence)), F.lit(0.0))


def page_confidence(words: DataFrame, *more: str) -> DataFrame:
    """Each page's share of confidence; with ``more`` columns, that of each of a page's recognitions."""
    return words.groupBy(*PAGE, *more).agg((mean_confidence(F.col("confidence")) / 100).alias("confidence"))


def full_text(words: DataFrame) -> DataFrame:
    """Each page's text by the recogniser's own line numbers."""
    line = words.groupBy(*PAGE, "block_num", "par_num", "line_num").agg(F.sort_array(F.collect_list(F.struct("left", "word_ord", "text"))).alias("w"))
    line = line.select(*PAGE, F.struct("block_num", "par_num", "line_num", F.array_join(F.col("w.text"), " ").alias("text")).alias("line"))
    page = line.groupBy(*PAGE).agg(F.sort_array(F.collect_list("line")).alias("lines"))
    return page.select(*PAGE, F.array_join(F.col("lines.text"), "\n").alias("full_text"))


def upper_median(values: Column) -> Column:
    """Of a sorted array the element in the middle, the later of two; null of an empty one."""
    return F.try_element_at(values, F.floor(F.size(values) / 2).cast("int") + 1)


def line_clusters(words: DataFrame) -> DataFrame:
    """The words with ``line`` (from 0, top to bottom of the page).

    Words are visited from top to bottom; one joins the current line if its centre is within the tolerance of that
    line's running mean, else it opens the next. A centre further than the tolerance below the one before it is beyond the mean
    too, so it always opens a line: the page falls into stretches without such a gap, mostly a line each. A stretch no higher than the
    tolerance is a line, as its mean lies within; in others a fold keeps the sum and number of the current line and the places where
    lines start.
    """
    word = F.struct(((2 * F.col("top") + F.col("height")) / 2).alias("y"), "word_ord", "text", "confidence", "left", "top", "width", "height")
    pages = words.groupBy(*PAGE).agg(F.sort_array(F.collect_list(word)).alias("w"))
    heights = F.sort_array(F.filter(F.col("w.height"), lambda h: h > 0))
    pages = pages.withColumn("tolerance", F.greatest(F.lit(4.0), F.coalesce(upper_median(heights), F.lit(20)) * 0.6))
    placed = pages.select(*PAGE, "tolerance", F.posexplode("w").alias("at", "w"))
    page = Window.partitionBy(*PAGE).orderBy("at")
    gap = F.coalesce(F.col("w.y") - F.lag("w.y").over(page) > F.col("tolerance"), F.lit(False))
    placed = placed.withColumn("gap", gap.cast("int")).withColumn("stretch", F.sum("gap").over(page.rowsBetween(Window.unboundedPreceding, 0)))
    stretches = placed.groupBy(*PAGE, "stretch", "tolerance").agg(F.sort_array(F.collect_list(F.struct("at", "w"))).alias("w"))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("starts"))

    def step(state, x):
        y = x["w"]["y"]
        joins = (state["n"] > 0) & (F.abs(y - state["s"] / F.greatest(state["n"], F.lit(1))) <= F.col("tolerance"))
        return F.struct(
            F.when(joins, state["s"] + y).otherwise(y).alias("s"), F.when(joins, state["n"] + 1).otherwise(F.lit(1)).alias("n"), (state["i"] + 1).alias("i"),
            F.when(joins, state["starts"]).otherwise(F.concat(state["starts"], F.array(state["i"]))).alias("starts"),
        )

    flat = F.element_at("w", -1)["w"]["y"] - F.element_at("w", 1)["w"]["y"] <= F.col("tolerance")
    folded = stretches.withColumn("starts", F.when(flat, F.array(F.lit(0))).otherwise(F.aggregate("w", start, step, lambda s: s["starts"])))
    placed = folded.select(*PAGE, "stretch", "starts", F.posexplode("w").alias("i", "x"))
    placed = placed.select(*PAGE, "stretch", F.size(F.filter("starts", lambda k: k <= F.col("i"))).alias("part"), "x.w.*")
    tops = placed.withColumn("line_top", F.min("top").over(Window.partitionBy(*PAGE, "stretch", "part")))
    return tops.withColumn("line", F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("line_top", "stretch", "part")) - 1).drop("stretch", "part", "line_top")


def word_cells(placed: DataFrame) -> DataFrame:
    """Words of lines with ``pos`` (in the line) and ``cell`` (from 0): a gap wider than the line's average character allows starts one."""
    line = Window.partitionBy(*PAGE, "line")
    ordered = line.orderBy("left", "y", "word_ord")
    chars = F.greatest(F.lit(1.0), F.avg(F.col("width") / F.greatest(F.length("text"), F.lit(1))).over(line))
    gap = F.col("left") - F.lag(F.col("left") + F.col("width")).over(ordered)
    flagged = placed.withColumn("new", F.when(gap > CELL_GAP * chars, 1).otherwise(0)).withColumn("pos", F.row_number().over(ordered))
    return flagged.withColumn("cell", F.sum("new").over(line.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("new")


def cells(celled: DataFrame) -> DataFrame:
    """One row per cell, with its text, box and confidence."""
    words = F.sort_array(F.collect_list(F.struct("pos", "text")))
    grouped = celled.groupBy(*PAGE, "line", "cell").agg(
        F.array_join(words["text"], " ").alias("text"),
        F.min("left").alias("left"),
        F.max(F.col("left") + F.col("width")).alias("right"),
        mean_confidence(F.col("confidence")).alias("confidence"),
    )
    return grouped.withColumn("center_x", (F.col("left") + F.col("right")) / 2)


def lines(words: DataFrame) -> DataFrame:
    """One row per printed line: ``doc_id, page, line, text, cells`` with the cells from left to right."""
    cell = F.struct("cell", "text", "left", "right", "center_x", "confidence")
    grouped = cells(word_cells(line_clusters(without_noise(words)))).groupBy(*PAGE, "line").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    return grouped.withColumn("text", F.array_join(F.col("cells.text"), " "))


def gathered(lines: DataFrame) -> DataFrame:
    """Rows of lines as pages: ``doc_id, page, lines``."""
    return lines.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("line", "text", "cells"))).alias("lines"))
