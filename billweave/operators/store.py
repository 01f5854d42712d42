"""Changes of the bill store, each as new versions of its tables: item edits, confirmation, scenario batches, runs, cascades.

An operation takes tables and requests, and returns the tables as they are afterwards with one result row per request; what is
refused changes nothing. Item edits and orders of a bill are made one after the other, by ``seq``; a scenario batch has at most one
request for a bill. ``edit_stored``, ``append`` and ``storage.Stored`` write changes so that a repeated batch has no further effect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money
from ..schema import ROUNDING_MODES, WIDE
from . import bills as bill_ops
from . import scenarios as scenario_ops
from .shared import stored
from .storage import Stored, written_once

# Messages that users read (fixed values).
CONFIRMED = "Confirmed bills cannot be edited."
NO_BILL, NO_ITEM = "Bill not found.", "Item not found."
NOT_CONFIRMED = "Bill must be confirmed before generating scenarios."
WRONG_ORDER = "item_ids_in_order must include every item exactly once."


def _no(code: int, message: Column | str) -> Column:
    return F.struct(F.lit(code).alias("code"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def _judged(requests: DataFrame, *rules: tuple[Column, Column]) -> DataFrame:
    """Requests with ``code`` and ``message`` of the first rule that holds, 200 and null if none does."""
    found = F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), no) for test, no in rules], _no(200, F.lit(None).cast("string")))
    return requests.withColumn("no", found).withColumn("code", F.col("no.code")).withColumn("message", F.col("no.message")).drop("no")


def new_item_id(bill_id: Column | str, seq: Column | str) -> Column:
    """The id of the item that an edit adds, known before it is made, so that later edits can name it."""
    return F.sha2(F.concat_ws("/", bill_id, seq, F.lit("added")), 256)


def judged_edits(bills: DataFrame, items: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits(bill_id, seq, op, item_id, description, rate)`` with ``code`` and ``message``, each judged after those before it.

    ``op`` is add, update or delete, and ``seq`` orders a bill's edits. An item is there from the edit that adds it, if that one is
    accepted, to the first that deletes it, so each item's edits are judged by themselves; a later one of it is 404.
    """
    known = bills.select("bill_id", F.col("confirmed").alias("shut"))
    op, seq = F.col("op"), F.col("seq")
    add = op == "add"
    bad_rate = F.when(add, F.coalesce(F.col("rate") < 0, F.lit(True))).otherwise(F.coalesce((op == "update") & (F.col("rate") < 0), F.lit(False)))
    asked = edits.join(known, "bill_id", "left").withColumn("bad_rate", bad_rate)
    born = asked.where(add & ~F.col("shut") & ~F.col("bad_rate")).select("bill_id", new_item_id("bill_id", "seq").alias("item_id"), F.col("seq").alias("born"))
    there = items.select("bill_id", F.col("id").alias("item_id"), F.lit(None).cast(born.schema["born"].dataType).alias("born")).unionByName(born).withColumn("found", F.lit(True))
    d = asked.join(there, ["bill_id", "item_id"], "left")
    alive = F.coalesce(F.col("found") & (F.col("born").isNull() | (F.col("born") < seq)), F.lit(False))
    gone = F.min(F.when(alive & (op == "delete"), seq)).over(Window.partitionBy("bill_id", "item_id"))
    d = d.withColumn("alive", alive).withColumn("gone", gone).withColumn("alive", F.col("alive") & F.coalesce(seq <= F.col("gone"), F.lit(True)))
    rules = (F.col("shut").isNull(), _no(404, NO_BILL)), (F.col("shut"), _no(409, CONFIRMED)), (~add & ~F.col("alive"), _no(404, NO_ITEM)), (F.col("bad_rate"), _no(400, bill_ops.RATE_INVALID))
    return _judged(d, *rules).select(*edits.columns, "code", "message")


def _new_serials(items: DataFrame, done: DataFrame) -> DataFrame:
    """``bill_id, seq, serial_no`` of every added item: one more than the highest number its bill has at that moment.

    Only this needs a bill's edits one after the other: a fold over its additions and deletions, with the numbers of its items.
    """
    steps = done.where("op <> 'update'").groupBy("bill_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", (F.col("op") == "add").alias("add"), F.coalesce("item_id", new_item_id("bill_id", "seq")).alias("id")))).alias("steps"), F.bool_or(F.col("op") == "add").alias("adds")
    )
    steps = steps.where("adds")
    have = items.join(steps.select("bill_id"), "bill_id", "left_semi").groupBy("bill_id").agg(F.collect_list(F.struct("id", F.col("serial_no").cast("int").alias("no"))).alias("have"))
    d = steps.join(have, "bill_id", "left")
    kind = "array<struct<id:string,no:int>>"
    start = F.struct(F.coalesce("have", F.array().cast(kind)).cast(kind).alias("have"), F.array().cast("array<struct<seq:bigint,no:int>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        no = F.coalesce(F.array_max(F.transform(state["have"], lambda i: i["no"])), F.lit(0)) + 1
        more = F.struct(
            F.concat(state["have"], F.array(F.struct(x["id"].alias("id"), no.alias("no")))).alias("have"), F.concat(state["out"], F.array(F.struct(x["seq"].cast("bigint").alias("seq"), no.alias("no")))).alias("out")
        )
        less = F.struct(F.filter(state["have"], lambda i: i["id"] != x["id"]).alias("have"), state["out"].alias("out"))
        return F.when(x["add"], more).otherwise(less)

    return d.select("bill_id", F.explode(F.aggregate("steps", start, step, lambda s: s["out"])).alias("o")).select("bill_id", "o.seq", F.col("o.no").alias("serial_no"))


def items_after(items: DataFrame, done: DataFrame) -> DataFrame:
    """The items after accepted edits.

    An added item is one piece without tax; an updated one keeps what no edit of it changes, and its amounts are worked out again.
    """
    kind = {f.name: f.dataType for f in items.schema}
    add = F.col("op") == "add"
    rate = F.col("rate").cast(kind["source_rate"])
    values = {
        "id": new_item_id("bill_id", "seq"), "bill_id": F.col("bill_id"), "serial_no": F.col("serial_no"), "description": F.col("description"), "gst_rate": F.lit(0), "quantity": F.lit(1), "source_rate": rate, "taxable_rate": rate,
        "line_amount": money.line_amount(F.lit(1), rate), "tax_amount": F.lit(0), "total_amount": money.line_amount(F.lit(1), rate), "confidence": F.lit(1), "user_verified": F.lit(True),
    }
    added = done.where(add).join(_new_serials(items, done), ["bill_id", "seq"])
    d = items.unionByName(added.select(*[values.get(c, F.lit(None)).cast(kind[c]).alias(c) for c in items.columns]))

    last = lambda name: F.max_by(name, F.when(F.col(name).isNotNull(), F.col("seq"))).alias(f"new_{name}")
    change = done.where(~add).groupBy("bill_id", F.col("item_id").alias("id")).agg(F.bool_or(F.col("op") == "delete").alias("gone"), last("description"), last("rate"))
    d = d.join(change, ["bill_id", "id"], "left").where("gone is null or not gone").withColumn("edited", F.col("gone").isNotNull())
    d = d.withColumn("description", F.coalesce("new_description", "description"))
    for name in ("source_rate", "taxable_rate"):
        d = d.withColumn(name, F.coalesce(F.col("new_rate").cast(kind[name]), name))
    quantity, gst = F.when(F.col("quantity") > 0, F.col("quantity")).otherwise(1), F.coalesce("gst_rate", F.lit(0))
    line = money.line_amount(quantity, F.col("source_rate"))
    tax = money.tax_amount(line, gst)
    for name, value in (("line_amount", line), ("tax_amount", tax), ("total_amount", line + tax), ("user_verified", F.lit(True))):
        d = d.withColumn(name, F.when(F.col("edited"), value).otherwise(F.col(name)).cast(kind[name]))
    return d.select(*items.columns)


def repriced(bills: DataFrame, items: DataFrame, touched: DataFrame) -> DataFrame:
    """Bills with the totals of those in ``touched(bill_id)`` worked out again."""
    priced = items.join(touched, "bill_id", "left_semi").select("bill_id", money.line_amount(F.col("quantity"), F.col("source_rate")).alias("line_amount"), F.coalesce("gst_rate", F.lit(0)).alias("g"))
    totals = bill_ops.totals(touched, priced.withColumn("tax_amount", money.tax_amount(F.col("line_amount"), F.col("g"))))
    fresh = totals.select("bill_id", *[F.col(c).alias(f"new_{c}") for c in ("subtotal", "tax_total", "grand_total")])
    d = bills.join(fresh, "bill_id", "left")
    for name in ("subtotal", "tax_total", "grand_total"):
        d = d.withColumn(name, F.coalesce(f"new_{name}", name).cast(bills.schema[name].dataType))
    return d.select(*bills.columns)


def edit_items(bills: DataFrame, items: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bills, items, results) after ``edits(bill_id, seq, op, item_id, description, rate)``, each bill's in order of ``seq``.

    The results are computed once, in the shared folder. The totals of every bill with an accepted edit are worked out again.
    """
    judged = stored(judged_edits(bills, items, edits))
    done = judged.where("code = 200")
    after = items_after(items, done)
    return repriced(bills, after, done.select("bill_id").distinct()), after, judged


def _stored_results(results: DataFrame, log: str, batch: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, accepted ones, their bills) of a batch of requests: what was written when it was first judged."""
    kept = written_once(results, f"{log}/batch={batch}")
    done = kept.where("code = 200")
    return kept, done, done.select("bill_id").distinct()


def edit_stored(bills: Stored, items: Stored, log: str, edits: DataFrame, batch: str) -> DataFrame:
    """Make edits in the stored tables; their results. A batch that is made again, or again after it failed halfway, changes nothing twice.

    The results are written first, as the folder ``log/batch=...``, and are what a repetition goes by. Each bucket of a table takes a
    batch once, so buckets that already have it are left alone; then the totals are those of the stored items.
    """
    spark = edits.sparkSession
    results, done, touched = _stored_results(judged_edits(bills.read(spark), items.read(spark), edits), log, batch)
    items.replace(touched, items_after(items.read(spark), done).join(touched, "bill_id", "left_semi"), batch)
    bills.replace(touched, repriced(bills.read(spark), items.read(spark), touched).join(touched, "bill_id", "left_semi"), batch)
    return results


def reorder_stored(bills: Stored, items: Stored, log: str, requests: DataFrame, batch: str) -> DataFrame:
    """``reorder`` in the stored tables, as ``edit_stored``."""
    spark = requests.sparkSession
    results, done, touched = _stored_results(judged_orders(bills.read(spark), items.read(spark), requests), log, batch)
    items.replace(touched, items_in_order(items.read(spark), done).join(touched, "bill_id", "left_semi"), batch)
    return results


def move_stored(bills: Stored, items: Stored, log: str, moves: DataFrame, batch: str) -> DataFrame:
    """``move_items`` in the stored tables, as ``edit_stored``."""
    spark = moves.sparkSession
    results, done, touched = _stored_results(judged_moves(bills.read(spark), items.read(spark), moves), log, batch)
    items.replace(touched, items_moved(items.read(spark), done).join(touched, "bill_id", "left_semi"), batch)
    return results


def confirm_stored(bills: Stored, items: Stored, log: str, requests: DataFrame, batch: str) -> DataFrame:
    """``confirm`` in the stored tables, as ``edit_stored``."""
    spark = requests.sparkSession
    results, done, touched = _stored_results(judged_confirmations(bills.read(spark), items.read(spark), requests), log, batch)
    bills.replace(touched, bills_confirmed(bills.read(spark), done).join(touched, "bill_id", "left_semi"), batch)
    return results


def judged_orders(bills: DataFrame, items: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests(bill_id, seq, item_ids)`` with ``code`` and ``message``.

    Refused are orders of unknown bills (404), of confirmed ones (409), and those that don't name just the bill's items (400).
    """
    have = items.groupBy("bill_id").agg(F.collect_set("id").alias("have"))
    asked = requests.join(bills.select("bill_id", F.col("confirmed").alias("shut")), "bill_id", "left").join(have, "bill_id", "left")
    own, named = (F.coalesce(F.col(c), F.array().cast(have.schema["have"].dataType)) for c in ("have", "item_ids"))
    other = (F.size(F.array_except(own, named)) > 0) | (F.size(F.array_except(named, own)) > 0)
    return _judged(asked, (F.col("shut").isNull(), _no(404, NO_BILL)), (F.col("shut"), _no(409, CONFIRMED)), (other, _no(400, WRONG_ORDER))).select(*requests.columns, "code", "message")


def items_in_order(items: DataFrame, done: DataFrame) -> DataFrame:
    """The items as the last accepted order of their bill numbers them."""
    last = done.groupBy("bill_id").agg(F.max_by("item_ids", "seq").alias("item_ids"))
    return bill_ops.reordered(items, last).drop("reordered").select(*items.columns)


def reorder(bills: DataFrame, items: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, results) after ``requests(bill_id, seq, item_ids)``."""
    judged = stored(judged_orders(bills, items, requests))
    return items_in_order(items, judged.where("code = 200")), judged


def judged_moves(bills: DataFrame, items: DataFrame, moves: DataFrame) -> DataFrame:
    """``moves(bill_id, seq, item_id, direction)`` with ``code`` and ``message``."""
    here = items.select("bill_id", F.col("id").alias("item_id"), F.lit(True).alias("found"))
    asked = moves.join(bills.select("bill_id", F.col("confirmed").alias("shut")), "bill_id", "left").join(here, ["bill_id", "item_id"], "left")
    rules = (F.col("shut").isNull(), _no(404, NO_BILL)), (F.col("shut"), _no(409, CONFIRMED)), (F.col("found").isNull(), _no(404, NO_ITEM))
    return _judged(asked, *rules).select(*moves.columns, "code", "message")


def items_moved(items: DataFrame, done: DataFrame) -> DataFrame:
    """The items after accepted moves: a fold over the list of a bill's items, which are then numbered from 1."""
    steps = done.groupBy("bill_id").agg(F.array_sort(F.collect_list(F.struct("seq", "item_id", "direction"))).alias("steps"))
    lists = items.join(steps.select("bill_id"), "bill_id", "left_semi").groupBy("bill_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("serial_no", "id"))), lambda x: x["id"]).alias("ids"))

    def step(ids: Column, x: Column) -> Column:
        at = F.array_position(ids, x["item_id"])
        to = at + x["direction"]
        swapped = F.transform(ids, lambda v, k: F.when(k == at - 1, F.get(ids, (to - 1).cast("int"))).when(k == to - 1, F.get(ids, (at - 1).cast("int"))).otherwise(v))
        return F.when((to >= 1) & (to <= F.size(ids)), swapped).otherwise(ids)

    order = steps.join(lists, "bill_id").select("bill_id", F.aggregate("steps", F.col("ids"), step).alias("item_ids"))
    return bill_ops.reordered(items, order).drop("reordered").select(*items.columns)


def move_items(bills: DataFrame, items: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, results) after ``moves(bill_id, seq, item_id, direction)``: each exchanges an item with the next (1) or the one before (-1).

    A bill's moves follow each other; at either end of the list a move is accepted and changes nothing.
    """
    judged = stored(judged_moves(bills, items, moves))
    return items_moved(items, judged.where("code = 200")), judged


def judged_confirmations(bills: DataFrame, items: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests(bill_id)``, one for each bill, with ``code`` and ``message``."""
    asked = requests.select("bill_id").distinct()
    state = bill_ops.confirmable(bills.join(asked, "bill_id", "left_semi"), items.withColumnRenamed("source_rate", "rate") if "rate" not in items.columns else items)
    return asked.join(state.select("bill_id", "code", "message"), "bill_id", "left").select("bill_id", F.coalesce("code", F.lit(404)).alias("code"), F.when(F.col("code").isNull(), NO_BILL).otherwise(F.col("message")).alias("message"))


def bills_confirmed(bills: DataFrame, done: DataFrame) -> DataFrame:
    d = bills.join(done.select("bill_id", F.lit(True).alias("now")), "bill_id", "left")
    d = d.withColumn("confirmed", F.coalesce("now", "confirmed")).withColumn("extraction_status", F.when(F.col("now"), "completed").otherwise(F.col("extraction_status")))
    return d.select(*bills.columns)


def confirm(bills: DataFrame, items: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bills, results) after ``requests(bill_id)``: a bill whose items all have a quantity and a rate is confirmed and completed."""
    results = judged_confirmations(bills, items, requests)
    return bills_confirmed(bills, results.where("code = 200")), results


def scenario_batch(bills: DataFrame, items: DataFrame, requests: DataFrame, batch: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scenarios, scenario items, results) of ``requests(bill_id, markup_b, markup_c, rounding_mode)``, as rows to append.

    Only confirmed bills get scenarios. A batch is a snapshot: later edits of a bill leave it as it is, and another batch stands
    beside it. ``items`` have ``rate``, ``quantity`` and ``gst_rate``.
    """
    known = bills.select("bill_id", F.col("confirmed").alias("shut"))
    wrong = [F.col(c).isNull() | (F.col(c) < 0) for c in ("markup_b", "markup_c")]
    judged = _judged(
        requests.join(known, "bill_id", "left"), (F.col("shut").isNull(), _no(404, NO_BILL)), (~F.col("shut"), _no(409, NOT_CONFIRMED)),
        (~F.coalesce(F.col("rounding_mode").isin(*ROUNDING_MODES), F.lit(False)), _no(400, F.concat(F.lit("Invalid rounding mode '"), F.coalesce("rounding_mode", F.lit("")), F.lit("'.")))),
        (wrong[0] | wrong[1], _no(400, bill_ops.MARKUP_INVALID)),
    ).drop("shut")
    three = F.array(*[F.struct(F.lit(k).alias("scenario_type"), markup.cast("decimal(6,2)").alias("markup_percent"), mode.alias("rounding_mode"))
        for k, markup, mode in (("baseline", F.lit(0), F.lit("none")), ("simulation_b", F.col("markup_b"), F.col("rounding_mode")), ("simulation_c", F.col("markup_c"), F.col("rounding_mode")))])
    wanted = judged.where("code = 200").select("bill_id", F.explode(three).alias("s")).select("bill_id", "s.*")
    wanted = wanted.withColumn("scenario_id", F.sha2(F.concat_ws("/", F.lit(batch), "bill_id", "scenario_type"), 256)).withColumn("batch", F.lit(batch))
    rows = scenario_ops.priced(items.join(wanted, "bill_id"))
    sums = rows.groupBy("scenario_id").agg(F.sum("line_amount").alias("s"), F.sum("tax_amount").alias("t"))
    zero = F.lit(0).cast(WIDE)
    d = wanted.join(sums, "scenario_id", "left").withColumn("subtotal", F.coalesce("s", zero).cast(WIDE)).withColumn("tax_total", F.coalesce("t", zero).cast(WIDE)).drop("s", "t")
    d = d.withColumn("grand_total", money.round_to_nearest(F.col("subtotal") + F.col("tax_total"), F.col("rounding_mode")))
    return scenario_ops.labelled(d), rows, judged


def append(rows: DataFrame, path: str) -> None:
    """Add a batch to an append-only table: a folder of Parquet files, one subfolder a batch. Added again it replaces itself."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


#: Where the rows of each table hang: on which table's rows, and by which column. Parents come first.
PARENTS = {
    "documents": (None, "document_id"), "bills": ("documents", "document_id"), "runs": ("documents", "document_id"), "items": ("bills", "bill_id"), "scenarios": ("bills", "bill_id"),
    "scenario_items": ("scenarios", "scenario_id"), "files": ("scenarios", "scenario_id"),
}
_OWN = {"bills": "bill_id", "scenarios": "scenario_id"}


def delete_documents(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The store's tables without the documents of ``gone(document_id)`` and all that hangs on them: bills and their items,
    scenarios with their items and files, and runs. Tables that aren't given, and what hangs on them, are left out."""
    dropped, left = {None: gone.select("document_id").distinct()}, {}
    dropped["documents"] = dropped[None]
    for name, (parent, key) in PARENTS.items():
        if name in tables and parent in dropped:
            left[name] = tables[name].join(dropped[parent], key, "left_anti")
            if name in _OWN:
                dropped[name] = tables[name].join(dropped[parent], key, "left_semi").select(_OWN[name])
    return left


def delete_stored(tables: dict[str, Stored], log: str, gone: DataFrame, batch: str) -> None:
    """``delete_documents`` in stored tables, each with a key of its own.

    Which rows go is written for every table before the first one changes, as a bill's items can't be told any more when the bill is
    gone; a repetition goes by what was written.
    """
    spark = gone.sparkSession
    dropped = {None: written_once(gone.select("document_id").distinct(), f"{log}/batch={batch}/documents")}
    dropped["documents"] = dropped[None]
    keys = {}
    for name, (parent, key) in PARENTS.items():
        if name in tables and parent in dropped:
            own = sorted({tables[name].key, *([_OWN[name]] if name in _OWN else [])})
            mine = tables[name].read(spark).join(dropped[parent], key, "left_semi").select(*own).distinct()
            keys[name] = written_once(mine, f"{log}/batch={batch}/{name}-rows")
            if name in _OWN:
                dropped[name] = keys[name].select(_OWN[name]).distinct()
    for name, rows in keys.items():
        tables[name].replace(rows.select(tables[name].key), tables[name].read(spark).limit(0), batch)


def finish_runs(documents: DataFrame, runs: DataFrame, bills: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, runs, bills) after ``outcomes(document_id, error, attempts_used)``: a failed run keeps its message, its document
    is failed and its bill is rolled back; others are processed and completed. Documents without an outcome go on as they are."""
    got = outcomes.select("document_id", F.col("error").alias("why"), F.col("attempts_used").alias("used"), F.lit(True).alias("over"))
    failed = F.col("why").isNotNull()
    d = documents.join(got, "document_id", "left").withColumn("status", F.when(F.col("over"), F.when(failed, "failed").otherwise("processed")).otherwise(F.col("status")))
    r = runs.join(got, "document_id", "left").withColumn("status", F.when(F.col("over"), F.when(failed, "failed").otherwise("completed")).otherwise(F.col("status")))
    r = r.withColumn("error_message", F.coalesce("why", "error_message")).withColumn("attempts_used", F.coalesce("used", "attempts_used"))
    rolled_back = outcomes.where("error is not null").select("document_id")
    return d.select(*documents.columns), r.select(*runs.columns), bills.join(rolled_back, "document_id", "left_anti")
