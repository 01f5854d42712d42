"""What-if scenarios of confirmed bills: baseline and two marked-up estimates, each labelled, and their render rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money, text
from ..schema import BASELINE_NOTE, DISCLAIMER, WIDE

LABELS = {"baseline": "Scenario A — Source / Baseline", "simulation_b": "Scenario B — Internal Estimate", "simulation_c": "Scenario C — Internal Estimate"}


def config(spark, markup_b: str, markup_c: str, rounding_mode: str) -> DataFrame:
    """Three rows: scenario type, label, markup, rounding mode and the notice that every result carries."""
    rows = [("baseline", "0", "none"), ("simulation_b", markup_b, rounding_mode), ("simulation_c", markup_c, rounding_mode)]
    plain = spark.createDataFrame([(k, LABELS[k], m, r, BASELINE_NOTE if k == "baseline" else DISCLAIMER) for k, m, r in rows], "scenario_type string, label string, markup string, rounding_mode string, disclaimer string")
    return plain.select("scenario_type", "label", F.col("markup").cast("decimal(6,2)").alias("markup_percent"), "rounding_mode", "disclaimer")


def items(bill_items: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Bill items (``rate``: with tax) priced under each scenario; the three rows of ``scenarios`` go to every task."""
    allowed = scenarios.where("markup_percent >= 0")
    return priced(bill_items.crossJoin(F.broadcast(allowed)))


def priced(scenario_items: DataFrame) -> DataFrame:
    """Items with ``rate`` and ``markup_percent`` at the marked-up rate."""
    d = scenario_items.withColumn("adjusted_rate", money.marked_up(F.col("rate"), F.col("markup_percent")))
    d = d.withColumn("line_amount", money.line_amount(F.col("quantity"), F.col("adjusted_rate"))).withColumn("tax_amount", money.tax_amount(F.col("line_amount"), F.col("gst_rate")))
    return d.withColumn("total_amount", (F.col("line_amount") + F.col("tax_amount")).cast(WIDE))


def labelled(scenarios: DataFrame) -> DataFrame:
    """Scenarios with the label and notice of their type."""
    label = F.when(F.col("scenario_type") == "baseline", LABELS["baseline"]).when(F.col("scenario_type") == "simulation_b", LABELS["simulation_b"]).otherwise(LABELS["simulation_c"])
    return scenarios.withColumn("label", label).withColumn("disclaimer", F.when(F.col("scenario_type") == "baseline", BASELINE_NOTE).otherwise(DISCLAIMER))


def totals(scenario_items: DataFrame, key: str = "bill_id") -> DataFrame:
    """One row per bill and scenario; only the grand total is rounded by the scenario's mode."""
    by = [key, "scenario_type", "label", "markup_percent", "rounding_mode", "disclaimer"]
    d = scenario_items.groupBy(*by).agg(F.sum("line_amount").cast(WIDE).alias("subtotal"), F.sum("tax_amount").cast(WIDE).alias("tax_total"))
    return d.withColumn("grand_total", money.round_to_nearest(F.col("subtotal") + F.col("tax_total"), F.col("rounding_mode")))


def output_name(scenario_type, label):
    """The output file of a scenario."""
    low = F.lower(label)
    return (
        F.when(scenario_type == "baseline", "baseline.pdf")
        .when(F.contains(low, F.lit("scenario b")), "scenario-b.pdf")
        .when(F.contains(low, F.lit("scenario c")), "scenario-c.pdf")
        .otherwise(F.concat(text.file_name(label), F.lit(".pdf")))
    )


def text_height(text_column, width: int = 40, line_height: int = 12, padding: int = 8):
    """The height of a table row whose text is broken to lines of ``width`` characters; one line at least."""
    lines = F.greatest(F.lit(1), F.ceil(F.coalesce(F.char_length(text_column), F.lit(0)) / width).cast("int"))
    return (lines * line_height + padding).cast("int")


def paged(rows: DataFrame, by: list[str], place: str, height: str, capacity: int, pitch: str | None = None) -> DataFrame:
    """Rows with ``page_no``: each group's rows in order of ``place``, each page filled before the next is begun.

    A row that doesn't fit in what is left of a page begins the next one, and a row higher than a page has one of its own. Rows stand
    below each other by their height, or by ``pitch``, where a row needs its height but the next begins at a fixed distance. The fold
    carries the height used and the places where pages begin.
    """
    rest, down = [c for c in rows.columns if c not in by], pitch or height
    whole = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(place, F.col(height).cast("long").alias("need"), F.col(down).cast("long").alias("down"), F.struct(*rest).alias("row")))).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("begins"))

    def step(state, x):
        new = (F.size(state["begins"]) == 0) | (state["used"] + x["need"] > capacity)
        used = F.when(new, F.lit(0)).otherwise(state["used"]) + x["down"]
        return F.struct(used.cast("long").alias("used"), F.when(new, F.concat(state["begins"], F.array(x[place].cast("long")))).otherwise(state["begins"]).alias("begins"))

    d = whole.withColumn("begins", F.aggregate("rows", start, step, lambda s: s["begins"])).select(*by, "begins", F.explode("rows").alias("x"))
    page = F.size(F.filter("begins", lambda b: b <= F.col(f"x.{place}")))
    return d.withColumn("page_no", page).select(*by, *[F.col("x.row")[c].alias(c) for c in rest], "page_no")


def render_rows(scenario_items: DataFrame, height=None, capacity: int = 20, key: str = "bill_id") -> DataFrame:
    """What a renderer draws: numbered rows with their page, display texts, totals and the scenario's notice on each.

    Pages hold rows of ``height`` up to ``capacity`` together; by default 20 rows. The totals are sums over the rows' own partition.
    """
    whole = Window.partitionBy(key, "scenario_type")
    place = F.row_number().over(whole.orderBy("serial_no", "total_amount", "adjusted_rate", "description"))
    total = money.round_to_nearest(F.sum("line_amount").over(whole).cast(WIDE) + F.sum("tax_amount").over(whole).cast(WIDE), F.col("rounding_mode"))
    d = scenario_items.withColumn("row_no", place).withColumn("grand_total", total).withColumn("height", F.lit(1) if height is None else height).select(
        key, "scenario_type", "row_no", "height", "description", text.money_text(F.col("adjusted_rate")).alias("rate_text"), text.money_text(F.col("total_amount")).alias("total_text"),
        text.money_text(F.col("grand_total")).alias("grand_total_text"), output_name(F.col("scenario_type"), F.col("label")).alias("filename"), "disclaimer",
    )
    return paged(d, [key, "scenario_type"], "row_no", "height", capacity).drop("height")
