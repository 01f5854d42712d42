"""Queries of the store's changes: item edits, confirmation, scenario batches, runs and cascades, over all orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import bills as bill_ops
from ..operators import store
from ..operators.shared import cut, shared_path
from ..operators.storage import Stored
from ..sources import uploads
from .inputs import ITEMS_SQL, bills, items, table

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _bills(spark, sf_dir):
    """Orders as bills with their totals not worked out yet; finished ones are confirmed."""
    zero = [F.lit(0).cast("decimal(18,2)").alias(c) for c in ("subtotal", "tax_total", "grand_total")]
    return bills(spark, sf_dir).select("bill_id", "document_id", (F.col("o_orderstatus") == "F").alias("confirmed"), F.lit("needs_review").alias("extraction_status"), *zero, "printed_total")


def _items(spark, sf_dir):
    """One item for each line number of an order."""
    one = items(spark, sf_dir).groupBy("bill_id", "serial_no").agg(F.min("rate").alias("source_rate"), F.min("quantity").alias("quantity"), F.min("gst_rate").alias("gst_rate"))
    priced = bill_ops.with_amounts(one, rate="source_rate")
    return priced.select(
        "bill_id", F.concat_ws("/", "bill_id", "serial_no").alias("id"), "serial_no", F.lit("Paper").alias("description"), "gst_rate", "quantity", "source_rate", F.col("source_rate").alias("taxable_rate"),
        "line_amount", "tax_amount", "total_amount", F.lit(False).alias("user_verified"),
    )


def _edits(spark, sf_dir):
    """For every bill an added item (sometimes at less than nothing), a new rate for item 1, its removal, or an edit of an unknown item."""
    k, o = F.col("bill_id") % 4, F.col("bill_id")
    item = F.when(k == 0, None).otherwise(F.concat_ws("/", o, F.when(k == 3, 999).otherwise(1)))
    op = F.when(k == 0, "add").when(k == 2, "delete").otherwise("update")
    rate = F.when(o % 8 == 4, F.lit(-1)).when(k < 2, F.col("printed_total"))
    return bills(spark, sf_dir).select("bill_id", F.lit(1).alias("seq"), op.alias("op"), item.alias("item_id"), F.when(k == 0, "Added").alias("description"), rate.cast("decimal(14,2)").alias("rate"))


_EDITS = f"""WITH {ITEMS_SQL}, one AS (SELECT bill_id, serial_no, min(rate) AS rate, min(quantity) AS quantity, min(gst_rate) AS gst_rate FROM items GROUP BY ALL),
edits AS (
    SELECT o_orderkey AS bill_id, CASE o_orderkey % 4 WHEN 0 THEN 'add' WHEN 2 THEN 'delete' ELSE 'update' END AS op, CASE o_orderkey % 4 WHEN 3 THEN 999 WHEN 0 THEN NULL ELSE 1 END AS serial_no,
           CASE WHEN o_orderkey % 8 = 4 THEN -1 WHEN o_orderkey % 4 < 2 THEN o_totalprice END::DECIMAL(14,2) AS rate, o_orderstatus FROM orders),
judged AS (
    SELECT e.*, CASE WHEN o_orderstatus = 'F' THEN 409 WHEN op <> 'add' AND o.bill_id IS NULL THEN 404 WHEN op = 'add' AND e.rate < 0 THEN 400 ELSE 200 END AS code
    FROM edits e LEFT JOIN one o ON o.bill_id = e.bill_id AND o.serial_no = e.serial_no),
after AS (
    SELECT o.bill_id, o.serial_no, CASE WHEN j.op = 'update' THEN j.rate ELSE o.rate END AS rate, o.quantity, o.gst_rate, j.op IS NOT NULL AS edited, o.bill_id || '/' || o.serial_no AS id
    FROM one o LEFT JOIN (SELECT * FROM judged WHERE code = 200) j ON j.bill_id = o.bill_id AND j.serial_no = o.serial_no WHERE j.op IS NULL OR j.op <> 'delete'
    UNION ALL SELECT bill_id, coalesce((SELECT max(serial_no) FROM one WHERE one.bill_id = judged.bill_id), 0) + 1, rate, 1, 0, true, sha256(bill_id || '/1/added') FROM judged WHERE code = 200 AND op = 'add'),
lines AS (SELECT *, round(quantity * rate, 2)::DECIMAL(18,2) AS line_amount FROM after),
priced AS (SELECT *, round(line_amount * gst_rate * CAST(0.01 AS DECIMAL(2,2)), 2)::DECIMAL(18,2) AS tax_amount FROM lines)"""


@query(
    f"""{_EDITS} SELECT bill_id, op, code, CASE code WHEN 409 THEN 'Confirmed bills cannot be edited.' WHEN 404 THEN 'Item not found.' WHEN 400 THEN 'Rate must be a valid non-negative monetary value.' END AS message FROM judged
        UNION ALL SELECT -bill_id, op, 404, 'Bill not found.' FROM judged WHERE bill_id > 0"""
)
def edit_results(spark, sf_dir):
    """What becomes of an edit of every bill, and of as many unknown ones."""
    edits = _edits(spark, sf_dir)
    both = edits.union(edits.where("bill_id > 0").withColumn("bill_id", -F.col("bill_id")))
    return store.edit_items(_bills(spark, sf_dir), _items(spark, sf_dir), both)[2].select("bill_id", "op", "code", "message")


@query(
    f"""{_EDITS} SELECT b.o_orderkey AS bill_id, CASE WHEN any_value(j.code) = 200 THEN coalesce(sum(line_amount), 0) ELSE 0 END::DECIMAL(18,2) AS subtotal,
        CASE WHEN any_value(j.code) = 200 THEN coalesce(sum(tax_amount), 0) ELSE 0 END::DECIMAL(18,2) AS tax_total, CASE WHEN any_value(j.code) = 200 THEN coalesce(sum(line_amount) + sum(tax_amount), 0) ELSE 0 END::DECIMAL(18,2) AS grand_total
        FROM orders b JOIN judged j ON j.bill_id = b.o_orderkey LEFT JOIN priced p ON p.bill_id = b.o_orderkey GROUP BY b.o_orderkey"""
)
def edited_bills(spark, sf_dir):
    """Totals after the edits; bills whose edit is refused keep what they had."""
    return store.edit_items(_bills(spark, sf_dir), _items(spark, sf_dir), _edits(spark, sf_dir))[0].select("bill_id", "subtotal", "tax_total", "grand_total")


@query(f"{_EDITS} SELECT bill_id, id, serial_no::INTEGER AS serial_no, rate AS source_rate, (line_amount + tax_amount)::DECIMAL(18,2) AS total_amount, edited AS user_verified FROM priced")
def edited_items(spark, sf_dir):
    return store.edit_items(_bills(spark, sf_dir), _items(spark, sf_dir), _edits(spark, sf_dir))[1].select("bill_id", "id", "serial_no", "source_rate", "total_amount", "user_verified")


@query(
    f"""WITH {ITEMS_SQL}, counts AS (SELECT bill_id, count(*) AS n, count(*) FILTER (bill_id % 3 = 0 AND serial_no = 7) AS bad FROM items GROUP BY bill_id),
        asked AS (SELECT o_orderkey AS bill_id, o_orderkey % 5 <> 0 AND n IS NOT NULL AND bad = 0 AS ok, o_orderstatus FROM orders LEFT JOIN counts ON bill_id = o_orderkey)
        SELECT bill_id, o_orderstatus = 'F' OR ok AS confirmed, CASE WHEN ok THEN 'completed' ELSE 'needs_review' END AS extraction_status FROM asked"""
)
def confirm_bills(spark, sf_dir):
    """Four of five bills are to be confirmed; item 7 of every third has no quantity."""
    d = items(spark, sf_dir).withColumn("quantity", F.when((F.col("bill_id") % 3 != 0) | (F.col("serial_no") != 7), F.col("quantity")))
    b = _bills(spark, sf_dir)
    return store.confirm(b, d, b.where("bill_id % 5 <> 0").select("bill_id"))[0].select("bill_id", "confirmed", "extraction_status")


_BATCH = f"""WITH {ITEMS_SQL}, asked AS (
    SELECT o_orderkey AS bill_id, CASE WHEN o_orderkey % 11 = 0 THEN -1 ELSE 10 END::DECIMAL(6,2) AS markup_b, CASE WHEN o_orderkey % 7 = 0 THEN 'bogus' ELSE 'nearest_10' END AS mode, o_orderstatus FROM orders),
judged AS (SELECT *, CASE WHEN o_orderstatus <> 'F' THEN 409 WHEN mode = 'bogus' THEN 400 WHEN markup_b < 0 THEN 400 ELSE 200 END AS code FROM asked),
wanted AS (
    SELECT bill_id, kind, CASE kind WHEN 'baseline' THEN 0 WHEN 'simulation_b' THEN markup_b ELSE 25 END::DECIMAL(6,2) AS markup_percent, CASE kind WHEN 'baseline' THEN 'none' ELSE mode END AS rounding_mode
    FROM judged, (VALUES ('baseline'), ('simulation_b'), ('simulation_c')) AS kinds(kind) WHERE code = 200),
adjusted AS (SELECT w.bill_id, kind, serial_no, quantity, gst_rate, round(rate * (1 + markup_percent * CAST(0.01 AS DECIMAL(2,2))), 2)::DECIMAL(18,2) AS adjusted_rate FROM wanted w JOIN items i ON i.bill_id = w.bill_id),
lines AS (SELECT *, round(quantity * adjusted_rate, 2)::DECIMAL(18,2) AS line_amount FROM adjusted),
priced AS (SELECT *, round(line_amount * gst_rate * CAST(0.01 AS DECIMAL(2,2)), 2)::DECIMAL(18,2) AS tax_amount FROM lines),
sums AS (SELECT bill_id, kind, sum(line_amount) AS s, sum(tax_amount) AS t, count(*) AS n FROM priced GROUP BY ALL)"""


def _asked(spark, sf_dir):
    o = F.col("bill_id")
    return bills(spark, sf_dir).select(
        "bill_id", F.when(o % 11 == 0, -1).otherwise(10).alias("markup_b"), F.lit(25).alias("markup_c"), F.when(o % 7 == 0, "bogus").otherwise("nearest_10").alias("rounding_mode")
    )


def _batch(spark, sf_dir):
    return store.scenario_batch(_bills(spark, sf_dir), items(spark, sf_dir), _asked(spark, sf_dir), "first")


@query(
    f"""{_BATCH} SELECT w.bill_id, sha256('first/' || w.bill_id || '/' || w.kind) AS scenario_id, w.kind AS scenario_type, w.markup_percent, coalesce(s, 0)::DECIMAL(18,2) AS subtotal, coalesce(t, 0)::DECIMAL(18,2) AS tax_total,
        CASE w.rounding_mode WHEN 'none' THEN coalesce(s + t, 0) ELSE round(coalesce(s + t, 0)::DECIMAL(18,2) * CAST(0.1 AS DECIMAL(2,1)), 0) * 10 END::DECIMAL(18,2) AS grand_total,
        CASE w.kind WHEN 'baseline' THEN 'Baseline from the uploaded document' ELSE 'SIMULATED / INTERNAL ESTIMATE — NOT A VENDOR QUOTATION' END AS disclaimer
        FROM wanted w LEFT JOIN sums ON sums.bill_id = w.bill_id AND sums.kind = w.kind"""
)
def scenario_batch(spark, sf_dir):
    """Snapshots of all bills that may have them: confirmed ones with a known rounding mode and no negative markup."""
    return _batch(spark, sf_dir)[0].select("bill_id", "scenario_id", "scenario_type", "markup_percent", "subtotal", "tax_total", "grand_total", "disclaimer")


@query(
    f"""{_BATCH} SELECT code, CASE WHEN code = 409 THEN 'Bill must be confirmed before generating scenarios.' WHEN mode = 'bogus' AND code = 400 THEN 'Invalid rounding mode ''bogus''.'
        WHEN code = 400 THEN 'Markup must be a non-negative percentage.' END AS message, count(*) AS n FROM judged GROUP BY ALL"""
)
def scenario_refusals(spark, sf_dir):
    return _batch(spark, sf_dir)[2].groupBy("code", "message").agg(F.count("*").alias("n"))


_SEQUENCE = """WITH RECURSIVE one AS (
    SELECT l_orderkey AS bill_id, l_linenumber AS no, min(CAST(l_extendedprice AS DECIMAL(14,2))) AS rate, min(CAST(l_quantity AS DECIMAL(12,3))) AS quantity, min(CAST(l_tax * 100 AS DECIMAL(5,2))) AS gst FROM lineitem GROUP BY ALL),
held AS (
    SELECT o_orderkey AS bill_id, o_orderstatus = 'F' AS shut, CAST(o_totalprice AS DECIMAL(14,2)) AS p,
           coalesce(list({'id': o_orderkey || '/' || no, 'no': no::INTEGER, 'what': 'Paper', 'rate': rate, 'quantity': quantity, 'gst': gst, 'edited': false}) FILTER (no IS NOT NULL), []) AS items
    FROM orders LEFT JOIN one ON bill_id = o_orderkey GROUP BY ALL),
named AS (SELECT *, bill_id AS o, sha256(bill_id || '/2/added') AS second, sha256(bill_id || '/6/added') AS sixth FROM held),
edits AS (
    SELECT o AS bill_id, 1 AS seq, 'update' AS op, o || '/1' AS item_id, CASE WHEN o % 3 = 0 THEN 'First' END AS what, CASE WHEN o % 3 <> 0 THEN p END AS rate FROM named
    UNION ALL SELECT o, 2, 'add', NULL, 'Added', p FROM named
    UNION ALL SELECT o, 3, 'update', second, NULL, 12.5 FROM named
    UNION ALL SELECT o, 4, 'delete', o || '/2', NULL, NULL FROM named
    UNION ALL SELECT o, 5, 'update', o || '/2', 'Gone', 1 FROM named
    UNION ALL SELECT o, 6, 'add', NULL, 'Again', 3 FROM named
    UNION ALL SELECT o, 7, 'delete', CASE o % 4 WHEN 0 THEN second WHEN 1 THEN sixth ELSE 'nothing' END, NULL, NULL FROM named
    UNION ALL SELECT o, 8, 'add', NULL, 'Late', CASE WHEN o % 5 = 0 THEN -1 ELSE 7 END FROM named
    UNION ALL SELECT o, 9, 'update', o || '/1', 'Bad', -2 FROM named),
steps AS (
    SELECT bill_id, 0 AS seq, shut, items, 200 AS code FROM held
    UNION ALL
    SELECT bill_id, seq, shut, CASE WHEN code <> 200 THEN items
            WHEN op = 'add' THEN list_append(items, {'id': sha256(bill_id || '/' || seq || '/added'), 'no': coalesce(list_max(list_transform(items, lambda x: x.no)), 0) + 1, 'what': what, 'rate': rate::DECIMAL(14,2), 'quantity': 1::DECIMAL(12,3), 'gst': 0::DECIMAL(5,2), 'edited': true})
            WHEN op = 'delete' THEN list_filter(items, lambda x: x.id <> item_id)
            ELSE list_transform(items, lambda x: CASE WHEN x.id = item_id THEN {'id': x.id, 'no': x.no, 'what': coalesce(what, x.what), 'rate': coalesce(rate::DECIMAL(14,2), x.rate), 'quantity': x.quantity, 'gst': x.gst, 'edited': true} ELSE x END) END, code
    FROM (SELECT s.bill_id, e.seq, s.shut, s.items, e.op, e.item_id, e.what, e.rate,
                 CASE WHEN s.shut THEN 409 WHEN e.op <> 'add' AND NOT list_contains(list_transform(s.items, lambda x: x.id), e.item_id) THEN 404 WHEN e.rate < 0 THEN 400 ELSE 200 END AS code
          FROM steps s JOIN edits e ON e.bill_id = s.bill_id AND e.seq = s.seq + 1)),
final AS (SELECT bill_id, unnest(items) AS i FROM steps WHERE seq = 9)"""
_LINES = """lines AS (SELECT bill_id, i.id AS id, i.no AS serial_no, i.what AS description, i.rate AS source_rate, i.edited AS user_verified, i.gst AS gst, round(i.quantity * i.rate, 2)::DECIMAL(18,2) AS line_amount FROM final),
taxed AS (SELECT *, round(line_amount * gst * CAST(0.01 AS DECIMAL(2,2)), 2)::DECIMAL(18,2) AS tax_amount FROM lines)"""


def _sequence(spark, sf_dir):
    """Nine edits of every bill in order: items that are added, changed, deleted and asked for again, with refusals between."""
    o, p = F.col("bill_id"), F.col("printed_total")
    old, new = (lambda n: F.concat_ws("/", o, F.lit(n))), (lambda n: store.new_item_id(o, F.lit(n)))
    one = lambda seq, op, item=None, what=None, rate=None: F.struct(F.lit(seq).alias("seq"), F.lit(op).alias("op"), (F.lit(None) if item is None else item).cast("string").alias("item_id"),
        (F.lit(what) if not hasattr(what, "cast") else what).cast("string").alias("description"), (F.lit(rate) if not hasattr(rate, "cast") else rate).cast("decimal(14,2)").alias("rate"))
    edits = F.array(
        one(1, "update", old(1), F.when(o % 3 == 0, "First"), F.when(o % 3 != 0, p)), one(2, "add", None, "Added", p), one(3, "update", new(2), None, 12.5), one(4, "delete", old(2)), one(5, "update", old(2), "Gone", 1),
        one(6, "add", None, "Again", 3), one(7, "delete", F.when(o % 4 == 0, new(2)).when(o % 4 == 1, new(6)).otherwise("nothing")), one(8, "add", None, "Late", F.when(o % 5 == 0, -1).otherwise(7)), one(9, "update", old(1), "Bad", -2),
    )
    return bills(spark, sf_dir).repartition("bill_id").select("bill_id", F.explode(edits).alias("e")).select("bill_id", "e.*")  # dealt before there are nine of each


@query(
    f"""{_SEQUENCE} SELECT bill_id, seq, code, CASE code WHEN 409 THEN 'Confirmed bills cannot be edited.' WHEN 404 THEN 'Item not found.' WHEN 400 THEN 'Rate must be a valid non-negative monetary value.' END AS message FROM steps WHERE seq > 0"""
)
def edit_sequence_results(spark, sf_dir):
    """What becomes of several edits of a bill, each after those before it."""
    return store.judged_edits(_bills(spark, sf_dir), _items(spark, sf_dir), _sequence(spark, sf_dir)).select("bill_id", "seq", "code", "message")


@query(f"{_SEQUENCE}, {_LINES} SELECT bill_id, id, serial_no, description, source_rate, (line_amount + tax_amount)::DECIMAL(18,2) AS total_amount, user_verified FROM taxed")
def edit_sequences(spark, sf_dir):
    """The items after several edits of every bill, made one after the other."""
    return store.edit_items(_bills(spark, sf_dir), _items(spark, sf_dir), _sequence(spark, sf_dir))[1].select("bill_id", "id", "serial_no", "description", "source_rate", "total_amount", "user_verified")


def _stored(spark, sf_dir, base):
    held = Stored(f"{base}/bills", "bill_id", 16), Stored(f"{base}/items", "bill_id", 16)
    for one, rows in zip(held, (_bills(spark, sf_dir), _items(spark, sf_dir))):
        one.write(rows)
    return held


@query(
    f"""{_SEQUENCE}, {_LINES}, sums AS (SELECT bill_id, sum(line_amount) AS s, sum(tax_amount) AS t, count(*) AS n FROM taxed GROUP BY bill_id)
        SELECT h.bill_id, CASE WHEN shut THEN 0 ELSE coalesce(s, 0) END::DECIMAL(18,2) AS subtotal, CASE WHEN shut THEN 0 ELSE coalesce(s + t, 0) END::DECIMAL(18,2) AS grand_total, coalesce(n, 0)::BIGINT AS n_items FROM held h LEFT JOIN sums USING (bill_id)"""
)
def edits_replayed(spark, sf_dir):
    """Stored bills and items after the same batch of edits was made two times: as after once."""
    base = shared_path(spark, "edits")
    held_bills, held_items = _stored(spark, sf_dir, base)
    for _ in range(2):
        store.edit_stored(held_bills, held_items, f"{base}/log", _sequence(spark, sf_dir), "monday")
    counts = held_items.read(spark).groupBy("bill_id").agg(F.count("*").alias("n_items"))
    return held_bills.read(spark).join(counts, "bill_id", "left").na.fill(0, ["n_items"]).select("bill_id", "subtotal", "grand_total", "n_items")


@query(
    """WITH one AS (SELECT l_orderkey AS bill_id, l_linenumber AS no, min(CAST(l_extendedprice AS DECIMAL(14,2))) AS source_rate FROM lineitem GROUP BY ALL)
        SELECT bill_id, no::INTEGER AS serial_no, source_rate FROM one WHERE bill_id IN (SELECT max(o_orderkey) FROM orders GROUP BY o_orderpriority)"""
)
def bill_look_up(spark, sf_dir):
    """The items of five bills, looked up by key in the stored table."""
    asked = [r["k"] for r in table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.max("o_orderkey").alias("k")).collect()]
    return _stored(spark, sf_dir, shared_path(spark, "looked-up"))[1].rows_of(spark, *asked).select("bill_id", F.col("serial_no").cast("int").alias("serial_no"), "source_rate")


@query(
    f"""{_BATCH}, kept AS (SELECT bill_id, any_value(n) AS n FROM wanted LEFT JOIN sums USING (bill_id, kind) GROUP BY bill_id)
        SELECT batch, count(*) * 3 AS n_scenarios, (sum(coalesce(n, 0)) * 3)::BIGINT AS n_items FROM kept, (VALUES ('first'), ('second')) AS batches(batch) WHERE batch = 'first' OR bill_id % 2 = 0 GROUP BY batch"""
)
def batch_replay(spark, sf_dir):
    """Scenario batches in the append-only tables; the first was written two times, with another between."""
    base = shared_path(spark, "batches")
    for batch in ("first", "second", "first"):
        asked = _asked(spark, sf_dir).where("bill_id % 2 = 0") if batch == "second" else _asked(spark, sf_dir)
        made = store.scenario_batch(_bills(spark, sf_dir), items(spark, sf_dir), asked, batch)
        for name, rows in zip(("scenarios", "items"), made):
            store.append(rows, f"{base}/{name}")
    n, m = (spark.read.parquet(f"{base}/{name}").groupBy("batch").agg(F.count("*").alias(f"n_{name}")) for name in ("scenarios", "items"))
    return n.join(m, "batch")


_ORDERS_SQL = """WITH one AS (SELECT l_orderkey AS bill_id, l_linenumber AS no FROM lineitem GROUP BY ALL), sizes AS (SELECT o_orderkey AS bill_id, o_orderstatus = 'F' AS shut, count(no) AS n FROM orders LEFT JOIN one ON bill_id = o_orderkey GROUP BY ALL)"""


def _orders(spark, sf_dir):
    """Three orders of every bill: its items turned round, one item too many in every third, and the first item alone; one of an unknown bill."""
    turned = _items(spark, sf_dir).groupBy("bill_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("serial_no", "id")), False), lambda x: x["id"]).alias("item_ids"))
    d = _bills(spark, sf_dir).select("bill_id").join(turned, "bill_id", "left").withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>")))
    more = F.when(F.col("bill_id") % 3 == 0, F.concat("item_ids", F.array(F.lit("none such")))).otherwise(F.concat("item_ids", F.slice("item_ids", 1, 1)))
    three = F.array(*[F.struct(F.lit(i).alias("seq"), ids.alias("item_ids")) for i, ids in ((1, F.col("item_ids")), (2, more), (3, F.slice("item_ids", 1, 1)))])
    known = d.select("bill_id", F.explode(three).alias("r")).select("bill_id", "r.*")
    return known.union(d.where("bill_id > 0").select(-F.col("bill_id"), F.lit(1), "item_ids"))


@query(
    f"""{_ORDERS_SQL}, asked AS (SELECT bill_id, seq, CASE WHEN shut THEN 409 WHEN seq = 2 AND bill_id % 3 = 0 OR seq = 3 AND n > 1 THEN 400 ELSE 200 END AS code FROM sizes, (VALUES (1), (2), (3)) AS three(seq)
            UNION ALL SELECT -bill_id, 1, 404 FROM sizes WHERE bill_id > 0)
        SELECT bill_id, seq, code, CASE code WHEN 404 THEN 'Bill not found.' WHEN 409 THEN 'Confirmed bills cannot be edited.' WHEN 400 THEN 'item_ids_in_order must include every item exactly once.' END AS message FROM asked"""
)
def reorder_results(spark, sf_dir):
    """What becomes of each order."""
    return store.reorder(_bills(spark, sf_dir), _items(spark, sf_dir), _orders(spark, sf_dir))[1].select("bill_id", "seq", "code", "message")


@query(
    f"""{_ORDERS_SQL} SELECT bill_id, bill_id || '/' || no AS id, CASE WHEN shut THEN no
            WHEN bill_id % 3 = 0 OR n = 1 AND bill_id % 3 = 0 THEN row_number() OVER (PARTITION BY bill_id ORDER BY no DESC)
            WHEN n = 1 THEN 1
            WHEN no = max(no) OVER (PARTITION BY bill_id) THEN n + 1 ELSE row_number() OVER (PARTITION BY bill_id ORDER BY no DESC) END::INTEGER AS serial_no
        FROM one JOIN sizes USING (bill_id)"""
)
def reordered_items(spark, sf_dir):
    """Items after the last accepted order of their bill; an id named twice has its last place."""
    return store.reorder(_bills(spark, sf_dir), _items(spark, sf_dir), _orders(spark, sf_dir))[0].select("bill_id", "id", F.col("serial_no").cast("int").alias("serial_no"))


_MOVES = f"""WITH RECURSIVE one AS (SELECT l_orderkey AS bill_id, l_linenumber AS no FROM lineitem GROUP BY ALL),
lists AS (SELECT o_orderkey AS bill_id, o_orderstatus = 'F' AS shut, coalesce(list(o_orderkey || '/' || no ORDER BY no) FILTER (no IS NOT NULL), []) AS ids FROM orders LEFT JOIN one ON bill_id = o_orderkey GROUP BY ALL),
asked AS (
    SELECT bill_id, 1 AS seq, bill_id || '/1' AS item_id, 1 AS d FROM lists UNION ALL SELECT bill_id, 2, bill_id || '/1', 1 FROM lists UNION ALL SELECT bill_id, 3, bill_id || '/' || greatest(len(ids), 1), -1 FROM lists
    UNION ALL SELECT bill_id, 4, 'nothing', 1 FROM lists UNION ALL SELECT bill_id, 5, bill_id || '/2', -1 FROM lists),
judged AS (SELECT a.*, CASE WHEN shut THEN 409 WHEN NOT list_contains(ids, item_id) THEN 404 ELSE 200 END AS code FROM asked a JOIN lists USING (bill_id)),
steps AS (
    SELECT bill_id, 0 AS seq, ids FROM lists
    UNION ALL SELECT s.bill_id, j.seq, CASE WHEN code = 200 AND list_position(ids, item_id) + d BETWEEN 1 AND len(ids)
            THEN list_transform(ids, lambda x, i: CASE WHEN i = list_position(ids, item_id) THEN ids[list_position(ids, item_id) + d] WHEN i = list_position(ids, item_id) + d THEN item_id ELSE x END) ELSE ids END
        FROM steps s JOIN judged j ON j.bill_id = s.bill_id AND j.seq = s.seq + 1)"""


def _moves(spark, sf_dir):
    """Five moves of every bill: its first item down two times, the last one up, an unknown one, and the second one up."""
    o = F.col("bill_id")
    last = _items(spark, sf_dir).groupBy("bill_id").agg(F.count("*").alias("n"))
    one = lambda seq, no, to: F.struct(F.lit(seq).alias("seq"), no.alias("item_id"), F.lit(to).alias("direction"))
    item = lambda no: F.concat_ws("/", o, no)
    five = F.array(one(1, item(F.lit(1)), 1), one(2, item(F.lit(1)), 1), one(3, item(F.coalesce("n", F.lit(1))), -1), one(4, F.lit("nothing"), 1), one(5, item(F.lit(2)), -1))
    return _bills(spark, sf_dir).select("bill_id").join(last, "bill_id", "left").select("bill_id", F.explode(five).alias("m")).select("bill_id", "m.*")


@query(f"{_MOVES} SELECT bill_id, seq, code FROM judged")
def move_results(spark, sf_dir):
    """What becomes of each move."""
    return store.move_items(_bills(spark, sf_dir), _items(spark, sf_dir), _moves(spark, sf_dir))[1].select("bill_id", "seq", "code")


@query(
    f"""{_MOVES} SELECT bill_id, id, CASE WHEN bill_id IN (SELECT bill_id FROM judged WHERE code = 200) THEN place ELSE split_part(id, '/', 2)::BIGINT END::INTEGER AS serial_no
        FROM (SELECT bill_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS place FROM steps WHERE seq = 5)"""
)
def moved_items(spark, sf_dir):
    """The items' numbers after several moves of a bill's items; bills without an accepted move keep theirs, gaps and all."""
    return store.move_items(_bills(spark, sf_dir), _items(spark, sf_dir), _moves(spark, sf_dir))[0].select("bill_id", "id", F.col("serial_no").cast("int").alias("serial_no"))


@query(
    f"""{_MOVES} SELECT bill_id, id, CASE WHEN bill_id IN (SELECT bill_id FROM judged WHERE code = 200) THEN place ELSE split_part(id, '/', 2)::BIGINT END::INTEGER AS serial_no, NOT shut AND len(ids) > 0 AS confirmed
        FROM (SELECT s.bill_id, unnest(s.ids) AS id, generate_subscripts(s.ids, 1) AS place, l.ids, shut FROM steps s JOIN lists l ON l.bill_id = s.bill_id WHERE seq = 5)"""
)
def moves_replayed(spark, sf_dir):
    """Stored items after a batch of moves and then one of confirmations, each made two times; ``confirmed`` tells of the latter."""
    base = shared_path(spark, "moves")
    held_bills, held_items = _stored(spark, sf_dir, base)
    asked = held_bills.read(spark).where("not confirmed")
    for _ in range(2):
        store.move_stored(held_bills, held_items, f"{base}/moves", _moves(spark, sf_dir), "monday")
    asked = cut(asked.select("bill_id"))
    for _ in range(2):
        store.confirm_stored(held_bills, held_items, f"{base}/confirmations", asked, "tuesday")
    now = held_bills.read(spark).select("bill_id", (F.col("extraction_status") == "completed").alias("confirmed"))
    return held_items.read(spark).select("bill_id", "id", F.col("serial_no").cast("int").alias("serial_no")).join(now, "bill_id")


_GONE = "(SELECT c_custkey FROM customer WHERE c_acctbal < 0)"


@query(
    f"""WITH left_bills AS (SELECT o_orderkey FROM orders WHERE o_custkey NOT IN {_GONE}), lost AS (SELECT o_orderkey FROM orders WHERE o_custkey IN {_GONE})
        SELECT 'documents' AS kind, count(*) AS n FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'bills', count(*) FROM left_bills UNION ALL SELECT 'scenarios', count(*) FROM left_bills
        UNION ALL SELECT kind, count(*) FROM lineitem, (VALUES ('items'), ('scenario_items'), ('files')) AS kinds(kind) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM lost) GROUP BY kind
        UNION ALL SELECT 'runs', count(*) FROM events WHERE user_id NOT IN {_GONE}"""
)
def delete_documents(spark, sf_dir):
    """Rows left in each table when documents go, with all that hangs on them."""
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "document_id")
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scenario_id"))
    tables = {
        "documents": customers, "bills": bills(spark, sf_dir), "items": items(spark, sf_dir), "scenarios": bills(spark, sf_dir).select("bill_id", F.col("bill_id").alias("scenario_id")),
        "scenario_items": line, "files": line, "runs": table(spark, sf_dir, "events").withColumnRenamed("user_id", "document_id"),
    }
    left = store.delete_documents(tables, customers.where("c_acctbal < 0").select("document_id"))
    counts = [d.agg(F.lit(kind).alias("kind"), F.count("*").alias("n")) for kind, d in left.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out


@query(
    f"""WITH left_bills AS (SELECT o_orderkey FROM orders WHERE o_custkey NOT IN {_GONE}), one AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
        SELECT 'documents' AS kind, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'bills', count(*), sum(o_orderkey)::BIGINT FROM left_bills
        UNION ALL SELECT 'items', count(*), sum(l_orderkey)::BIGINT FROM one WHERE l_orderkey IN (FROM left_bills) UNION ALL SELECT 'runs', count(*), sum(user_id)::BIGINT FROM events WHERE user_id NOT IN {_GONE}"""
)
def cascade_replayed(spark, sf_dir):
    """Stored tables after documents went, with all that hangs on them, two times."""
    base, customers = shared_path(spark, "cascade"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), "c_acctbal")
    held_bills, held_items = _stored(spark, sf_dir, base)
    held = {"documents": Stored(f"{base}/documents", "document_id", 8), "bills": held_bills, "items": held_items, "runs": Stored(f"{base}/runs", "document_id", 8)}
    held["documents"].write(customers)
    held["runs"].write(table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), "event_id"))
    for _ in range(2):
        store.delete_stored(held, f"{base}/log", customers.where("c_acctbal < 0"), "monday")
    out = None
    for kind, one in held.items():
        n = one.read(spark).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum(one.key).cast("long").alias("keys"))
        out = n if out is None else out.union(n)
    return out


@query(
    """SELECT c_custkey AS document_id, CASE WHEN c_acctbal < 0 THEN 'failed' WHEN c_acctbal < 5000 THEN 'processed' ELSE 'processing' END AS status,
        CASE WHEN c_acctbal < 0 THEN 'failed' WHEN c_acctbal < 5000 THEN 'completed' ELSE 'running' END AS run_status, CASE WHEN c_acctbal < 0 THEN 'no text on any page' END AS error_message,
        CASE WHEN c_acctbal < 5000 THEN 2 ELSE 1 END AS attempts_used, CASE WHEN c_acctbal < 0 THEN 0 ELSE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) END AS n_bills FROM customer"""
)
def finished_runs(spark, sf_dir):
    """Documents after their runs: some failed, with their bills rolled back, some done, some still going."""
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "document_id")
    runs = c.select("document_id", F.lit("running").alias("status"), F.lit(None).cast("string").alias("error_message"), F.lit(1).alias("attempts_used"))
    outcomes = c.where("c_acctbal < 5000").select("document_id", F.when(F.col("c_acctbal") < 0, "no text on any page").alias("error"), F.lit(2).alias("attempts_used"))
    d, r, b = store.finish_runs(c.select("document_id", F.lit("processing").alias("status")), runs, bills(spark, sf_dir), outcomes)
    counts = b.groupBy("document_id").agg(F.count("*").alias("n_bills"))
    return d.join(r.withColumnRenamed("status", "run_status"), "document_id").join(counts, "document_id", "left").na.fill(0, ["n_bills"])


@query("SELECT o_orderkey AS bill_id, coalesce(strftime(CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END, '%d %b %Y'), '-') AS shown, '/files/uploads/' || o_orderkey || '.pdf' AS preview_url FROM orders")
def document_display(spark, sf_dir):
    """Dates as they are shown, and where a document's stored file can be seen."""
    d = table(spark, sf_dir, "orders").withColumn("at", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")))
    return d.select(F.col("o_orderkey").alias("bill_id"), text.date_text(F.col("at")).alias("shown"), uploads.preview_url(F.concat(F.col("o_orderkey").cast("string"), F.lit(".pdf"))).alias("preview_url"))
