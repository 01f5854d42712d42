"""Bills: extraction from words, line and bill totals, validation, edits, confirmation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money, text
from ..sources.uploads import best_words, digital_words
from ..schema import WIDE
from . import fields, layout, tables
from .shared import stored

TOLERANCE, EXTRACTION_TOLERANCE = "1.00", "2.00"

# Messages that users read (fixed values).
QUANTITY_REQUIRED = "Quantity required"
RATE_INVALID = "Rate must be a valid non-negative monetary value."
GST_RANGE = "GST rate must be between 0 and 100."
MARKUP_INVALID = "Markup must be a non-negative percentage."


def with_amounts(items: DataFrame, quantity: str = "quantity", rate: str = "rate", gst: str = "gst_rate") -> DataFrame:
    """Items with ``line_amount, tax_amount, total_amount``; the tax is on the rounded amount."""
    d = items.withColumn("line_amount", money.line_amount(F.col(quantity), F.col(rate)))
    d = d.withColumn("tax_amount", money.tax_amount(F.col("line_amount"), F.col(gst)))
    return d.withColumn("total_amount", (F.col("line_amount") + F.col("tax_amount")).cast(WIDE))


def totals(bills: DataFrame, items: DataFrame, key: str = "bill_id", adjustment: Column | None = None) -> DataFrame:
    """``key, subtotal, tax_total, grand_total`` of every bill; 0.00 for a bill without items."""
    sums = items.groupBy(key).agg(F.sum("line_amount").alias("s"), F.sum("tax_amount").alias("t"))
    zero = F.lit(0).cast(WIDE)
    d = bills.join(sums, key, "left").withColumn("subtotal", F.coalesce("s", zero).cast(WIDE)).withColumn("tax_total", F.coalesce("t", zero).cast(WIDE))
    extra = zero if adjustment is None else F.coalesce(adjustment, zero)
    return d.select(key, "subtotal", "tax_total", (F.col("subtotal") + F.col("tax_total") + extra).cast(WIDE).alias("grand_total"))


def reconciles(printed: Column, calculated: Column, tolerance: str = TOLERANCE) -> Column:
    """No printed total, or one within the tolerance."""
    return F.coalesce(F.abs(printed - calculated) <= money.dec(tolerance, 14, 2), F.lit(True))


def item_errors(quantity: Column, rate: Column, gst: Column) -> Column:
    """Structs (field, message) of what is wrong with an item; empty if nothing is."""
    found = F.array(
        F.when(quantity.isNull() | (quantity < 0), F.struct(F.lit("quantity").alias("field"), F.lit(QUANTITY_REQUIRED).alias("message"))),
        F.when(rate.isNull() | (rate < 0), F.struct(F.lit("rate").alias("field"), F.lit(RATE_INVALID).alias("message"))),
        F.when((gst < 0) | (gst > 100), F.struct(F.lit("gst_rate").alias("field"), F.lit(GST_RANGE).alias("message"))),
    )
    return F.filter(found, lambda e: e.isNotNull())


def markup_error(markup: Column) -> Column:
    return F.when(markup.isNull() | (markup < 0), F.lit(MARKUP_INVALID))


def with_edit_defaults(items: DataFrame) -> DataFrame:
    """An edited item's line is priced with quantity 1 if it has none or less than nothing, and tax 0 if it has none."""
    q = F.when(F.coalesce(F.col("quantity"), F.lit(0)) <= 0, F.lit(1)).otherwise(F.col("quantity")).cast("decimal(12,3)")
    line = money.line_amount(q, F.col("rate"))
    tax = money.tax_amount(line, F.coalesce("gst_rate", F.lit(0)))
    return items.withColumns({"line_amount": line, "tax_amount": tax, "total_amount": (line + tax).cast(WIDE)})


def needs_review(n_items: Column, doubtful: Column, printed: Column, calculated: Column, tolerance: str = EXTRACTION_TOLERANCE) -> Column:
    """A bill without items, with a doubtful one, or far from its printed total."""
    return (n_items == 0) | F.coalesce(doubtful, F.lit(False)) | ~reconciles(printed, calculated, tolerance)


def next_serial(bills: DataFrame, items: DataFrame, key: str = "bill_id") -> DataFrame:
    top = items.groupBy(key).agg(F.max("serial_no").alias("m"))
    return bills.join(top, key, "left").select(key, (F.coalesce("m", F.lit(0)) + 1).alias("next_serial"))


def reordered(items: DataFrame, order: DataFrame, key: str = "bill_id") -> DataFrame:
    """Items with ``serial_no`` from ``order(key, item_ids)``: the 1-based place, the last one of an id named twice.

    Bills whose order doesn't name just their items keep their numbers; ``reordered`` tells which is which.
    """
    named = order.select(key, F.posexplode("item_ids").alias("place", "id")).groupBy(key, "id").agg((F.max("place") + 1).alias("place"))
    have = items.groupBy(key).agg(F.collect_set("id").alias("have"))
    same = order.join(have, key).select(key, ((F.size(F.array_except("have", "item_ids")) == 0) & (F.size(F.array_except("item_ids", "have")) == 0)).alias("ok"))
    d = items.join(same, key, "left").join(named, [key, "id"], "left")
    ok = F.coalesce(F.col("ok"), F.lit(False))
    return d.withColumn("serial_no", F.when(ok, F.col("place")).otherwise(F.col("serial_no"))).withColumn("reordered", ok).drop("ok", "place")


def confirmable(bills: DataFrame, items: DataFrame, key: str = "bill_id") -> DataFrame:
    """``key, n_items, n_bad, code, message``: 200 where a bill can be confirmed, 400 where it has no items or a bad one."""
    bad = F.size(item_errors(F.col("quantity"), F.col("rate"), F.lit(0))) > 0
    counts = items.groupBy(key).agg(F.count("*").alias("n_items"), F.sum(bad.cast("long")).alias("n_bad"))
    d = bills.select(key).join(counts, key, "left").na.fill(0, ["n_items", "n_bad"])
    empty, wrong = F.col("n_items") == 0, F.col("n_bad") > 0
    message = F.when(empty, "A bill needs at least one item.").when(wrong, "Some items need a quantity and a rate.")
    return d.withColumn("code", F.when(empty | wrong, 400).otherwise(200)).withColumn("message", message)


def edit_errors(edits: DataFrame, bills: DataFrame, key: str = "bill_id") -> DataFrame:
    """Edits with ``code``: 404 for an unknown bill, 409 for a confirmed one, else null."""
    d = edits.join(bills.select(key, "confirmed"), key, "left")
    return d.withColumn("code", F.when(F.col("confirmed").isNull(), 404).when(F.col("confirmed"), 409)).drop("confirmed")


def numbered(items: DataFrame) -> DataFrame:
    """Candidate items of a document with the number of items on earlier pages added to every serial number."""
    pages = items.groupBy(*layout.PAGE).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = pages.select(*layout.PAGE, before.alias("offset"))
    return items.join(offsets, list(layout.PAGE)).withColumn("serial_no", F.col("serial_no") + F.col("offset")).drop("offset")


def _with_sums(pages: DataFrame) -> DataFrame:
    """Pages with the ``sums`` of their items: ``n_items, subtotal, tax_total, doubtful``."""
    zero = F.lit(0).cast("decimal(28,2)")
    add = lambda items, value: F.aggregate(items, zero, lambda s, i: (s + F.coalesce(value(i), zero)).cast("decimal(28,2)"))
    line = lambda i: money.line_amount(_one(), _rate(i))
    sums = F.struct(
        F.size("items").cast("bigint").alias("n_items"), add("items", line).alias("subtotal"), add("items", lambda i: money.tax_amount(line(i), _no_tax())).alias("tax_total"), F.exists("items", lambda i: F.coalesce(_doubtful(i), F.lit(False))).alias("doubtful")
    )
    return pages.withColumn("sums", sums)


def _one() -> Column:
    """The quantity with which a bill's items are stored."""
    return F.lit(1).cast("decimal(12,3)")


def _no_tax() -> Column:
    return F.lit(0).cast("decimal(5,2)")


def _rate(item: Column | DataFrame) -> Column:
    return F.coalesce(item["source_rate"], item["taxable_rate"], F.lit(0).cast("decimal(24,12)"))


def _doubtful(item: Column | DataFrame) -> Column:
    return item["ambiguous"] | (item["confidence"] < 0.75) | (item["source_rate"].isNull() & item["taxable_rate"].isNull())


def read_pages(words: DataFrame) -> DataFrame:
    """``doc_id, page, items, total, fields`` of pages of words: what is on them, each page for itself."""
    first = layout.full_text(layout.without_noise(words.where("page = 0"))).select("doc_id", "full_text")
    pages = layout.gathered(layout.lines(words)).join(first, "doc_id", "left").withColumn("first", F.col("page") == 0)
    total = ("total", lambda p: fields.page_total(p["lines"]))
    head = tuple((name, lambda p, value=value: F.when(p["first"], value(p))) for name, value in fields.FIELDS)
    return layout.with_steps(pages, (*tables.ITEMS, total, *head), "items", "total", "fields")


def extract(documents: DataFrame, digital: DataFrame, recognised: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(bills, bill items) of documents (``doc_id``) from words of digital pages, or else from recognised ones.

    Digital pages of a document count if they have eight words or more together. Recognised words count only for documents whose
    digital pages yield no item, and of several recognitions of a page (``attempt``) the surest; a total found on digital pages stays.
    Pages count in order, items through all of them. What digital pages have on them is computed once, in the shared folder, if there
    are recognised ones. No words are moved that come dealt by ``doc_id``.
    """
    pages, any_scan = read_pages(digital_words(digital)).withColumn("scanned", F.lit(False)), None
    if recognised is not None:
        pages = stored(pages)
        done = pages.where(F.size("items") > 0).select("doc_id").distinct()
        rest = recognised.join(done, "doc_id", "left_anti")
        pages = pages.unionByName(read_pages(best_words(rest) if "attempt" in rest.columns else rest).withColumn("scanned", F.lit(True)))
        any_scan = rest.select("doc_id").distinct().withColumn("any_scan", F.lit(True))

    before = F.sum(F.size("items")).over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    one = pages.where(F.size("items") > 0).withColumn("offset", F.coalesce(before, F.lit(0))).select("doc_id", "page", "offset", F.inline("items"))
    one = one.withColumn("serial_no", F.col("serial_no") + F.col("offset"))
    one = one.withColumn("rate", _rate(one)).withColumn("quantity", _one()).withColumn("gst_rate", _no_tax())
    cleaned = F.coalesce(F.nullif(text.clean_description(F.col("description"), F.col("serial_no")), F.lit("")), F.lit("(unspecified)"))
    priced = with_amounts(one.withColumn("description", cleaned))
    items = priced.select(
        F.col("doc_id").alias("bill_id"),
        F.sha2(F.concat_ws("/", "doc_id", "page", "item"), 256).alias("id"),
        F.col("serial_no").cast("int").alias("serial_no"),
        "description",
        "gst_rate",
        "quantity",
        F.round("rate", 2).try_cast("decimal(14,2)").alias("source_rate"),
        F.round(F.coalesce("taxable_rate", "rate"), 2).try_cast("decimal(14,2)").alias("taxable_rate"),
        *(F.col(c).try_cast("decimal(14,2)").alias(c) for c in ("line_amount", "tax_amount", "total_amount")),
        F.round("confidence", 4).cast("decimal(5,4)").alias("confidence"),
        F.lit(False).alias("user_verified"),
    )

    own = _with_sums(pages)
    shown = lambda scanned: F.min(F.when((F.col("scanned") == scanned) & F.col("total").isNotNull(), F.struct("page", "total")))["total"]
    heads = [F.max(F.when((F.col("scanned") == s) & (F.col("page") == 0), F.struct("scanned", "fields")))["fields"].alias(name) for s, name in ((False, "digital_fields"), (True, "scanned_fields"))]
    sums = [F.sum("sums.n_items").alias("n_items"), F.sum("sums.subtotal").alias("s"), F.sum("sums.tax_total").alias("t"), F.bool_or("sums.doubtful").alias("doubtful")]
    found = own.groupBy("doc_id").agg(*sums, shown(False).alias("a"), shown(True).alias("b"), *heads)
    found = found.withColumn("any_scan", F.lit(False)) if any_scan is None else found.join(any_scan, "doc_id", "left")
    found = found.withColumn("fields", F.when(F.col("any_scan"), F.col("scanned_fields")).otherwise(F.col("digital_fields")))
    d = documents.select("doc_id").join(found, "doc_id", "left").na.fill(0, ["n_items"])
    zero = F.lit(0).cast(WIDE)
    d = d.withColumn("subtotal", F.coalesce(F.col("s").cast(WIDE), zero)).withColumn("tax_total", F.coalesce(F.col("t").cast(WIDE), zero))
    d = d.withColumn("grand_total", (F.col("subtotal") + F.col("tax_total")).cast(WIDE)).withColumn("document_total", F.coalesce("a", "b"))
    review = needs_review(F.col("n_items"), F.col("doubtful"), F.col("document_total"), F.col("grand_total"))
    head = ("vendor_name", "vendor_address", "vendor_gstin", "vendor_phone", "vendor_email", "invoice_number", "invoice_date", "buyer_name")
    bills = d.select(
        F.col("doc_id").alias("bill_id"), *(F.col(f"fields.{c}").alias(c) for c in head),
        F.lit("INR").alias("currency"), "subtotal", "tax_total", "grand_total", "document_total", "n_items",
        F.when(review, "needs_review").otherwise("completed").alias("extraction_status"), F.lit(False).alias("confirmed"),
    )
    return bills, items
