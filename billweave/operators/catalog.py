"""The relational store as DataFrames: history, files, latest states, ordered children."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut


def history(documents: DataFrame, bills: DataFrame, scenarios: DataFrame, limit: int = 50, offset: int = 0, after: tuple | None = None) -> DataFrame:
    """The latest documents with their bill's total and number of scenarios.

    The page is found first, and only its bills' scenarios are counted. ``after`` is the (uploaded_at, document_id) of the last row of
    the page before: the rows that follow it are then found without passing over those before, as ``offset`` has to.
    """
    if after is not None:
        at, last = F.lit(after[0]), F.lit(after[1])
        documents = documents.where((F.col("uploaded_at") < at) | ((F.col("uploaded_at") == at) & (F.col("document_id") > last)))
    recent = documents.orderBy(F.desc("uploaded_at"), "document_id").offset(offset).limit(limit)
    page = cut(recent.join(bills.select("document_id", "bill_id", "grand_total"), "document_id", "left"))
    counts = scenarios.join(page.select("bill_id"), "bill_id", "left_semi").groupBy("bill_id").agg(F.count("*").alias("scenario_count"))
    d = page.join(counts, "bill_id", "left")
    return d.select("document_id", "uploaded_at", "grand_total", F.coalesce("scenario_count", F.lit(0)).alias("scenario_count"))


def first_seen(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """``key, seen``: the different values of each key, in the order of their first appearance.

    A value is reduced to its first place before a key's values meet.
    """
    firsts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(F.struct(*order)).alias("at"))
    return firsts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", value))).alias("s")).select(key, F.col("s")[value].alias("seen"))


def document_files(files: DataFrame, scenarios: DataFrame, bills: DataFrame) -> DataFrame:
    """Generated files with the document they belong to."""
    return files.join(scenarios.select("scenario_id", "bill_id"), "scenario_id").join(bills.select("bill_id", "document_id"), "bill_id")


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of each key that is last by ``order``, as one aggregation: rows combine before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    last = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("r")
    return rows.groupBy(key).agg(last).select(key, *[F.col("r")[c].alias(c) for c in rest])


def children(parents: DataFrame, rows: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """Parents with their child rows as an ordered array, empty where there are none."""
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("children"))
    d = parents.join(grouped, key, "left")
    return d.withColumn("children", F.coalesce("children", F.filter(F.array(F.struct(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in (order, *columns)])), lambda x: F.lit(False))))


def listed(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows with ``place``, 1 for the first of their key, by ``order``; the last columns of it are to tell rows of one time apart."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def run_states(events: DataFrame, key: str = "document_id") -> DataFrame:
    """A document's latest run status and the highest number of attempts, from its log of run events."""
    return events.groupBy(key).agg(F.max_by("status", F.struct("at", "event_id")).alias("status"), F.max("attempts").alias("attempts_used"), F.count("*").alias("n_events"))


def upgraded(table: DataFrame, new_columns: dict[str, str]) -> DataFrame:
    """A table with columns it doesn't have yet, null throughout."""
    return table.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in new_columns.items() if name not in table.columns])


def moved(items: DataFrame, key: str, serial: str, up: DataFrame) -> DataFrame:
    """Items with one of each bill (``up``: key, serial) exchanged with the one before it."""
    w = Window.partitionBy(key).orderBy(serial)
    target = up.select(key, F.col(serial).alias("__up"))
    d = items.withColumn("__before", F.lag(serial).over(w)).withColumn("__after", F.lead(serial).over(w)).join(target, key, "left")
    new = F.when((F.col(serial) == F.col("__up")) & F.col("__before").isNotNull(), F.col("__before")).when(F.col("__after") == F.col("__up"), F.col("__after")).otherwise(F.col(serial))
    return d.withColumn("new_serial", new).drop("__up", "__before", "__after")
