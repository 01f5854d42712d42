"""Queries of the decimal and relational operators, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import money, text
from ..operators import bills as bill_ops
from ..operators import catalog, scenarios, store
from ..operators.shared import shared_path
from ..operators.storage import Stored
from ..sources import uploads, versions
from ..streaming import ingest
from .inputs import BILLS_SQL, ITEMS_SQL, PRICED_SQL, bills, items, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_PRICED = f"WITH {ITEMS_SQL}, {PRICED_SQL}"


@query(f"{_PRICED} SELECT bill_id, serial_no, line_amount, tax_amount, total_amount FROM priced")
def line_calc(spark, sf_dir):
    return bill_ops.with_amounts(items(spark, sf_dir)).select("bill_id", "serial_no", "line_amount", "tax_amount", "total_amount")


_TOTALS = f"""{_PRICED}, {BILLS_SQL}, totals AS (
    SELECT b.bill_id, any_value(printed_total) AS printed_total, coalesce(sum(line_amount), 0)::DECIMAL(18,2) AS subtotal, coalesce(sum(tax_amount), 0)::DECIMAL(18,2) AS tax_total,
           coalesce(sum(line_amount) + sum(tax_amount), 0)::DECIMAL(18,2) AS grand_total, count(line_amount) AS n_items
    FROM bills b LEFT JOIN priced p ON p.bill_id = b.bill_id GROUP BY b.bill_id)"""


@query(f"{_TOTALS} SELECT bill_id, subtotal, tax_total, grand_total FROM totals")
def bill_totals(spark, sf_dir):
    return bill_ops.totals(bills(spark, sf_dir), bill_ops.with_amounts(items(spark, sf_dir)))


@query(f"{_TOTALS} SELECT bill_id, subtotal, tax_total, (grand_total + 5)::DECIMAL(18,2) AS grand_total FROM totals WHERE n_items = 0")
def bill_totals_empty(spark, sf_dir):
    """Bills without items, with an adjustment of 5.00."""
    empty = bills(spark, sf_dir).join(items(spark, sf_dir).select("bill_id"), "bill_id", "left_anti")
    return bill_ops.totals(empty, bill_ops.with_amounts(items(spark, sf_dir)), adjustment=F.lit(5).cast("decimal(18,2)"))


_CONFIG = """config(scenario_type, label, markup_percent, rounding_mode, disclaimer) AS (VALUES
    ('baseline', 'Scenario A — Source / Baseline', CAST(0 AS DECIMAL(6,2)), 'none', 'Baseline from the uploaded document'),
    ('simulation_b', 'Scenario B — Internal Estimate', CAST(12.5 AS DECIMAL(6,2)), 'nearest_5', 'SIMULATED / INTERNAL ESTIMATE — NOT A VENDOR QUOTATION'),
    ('simulation_c', 'Scenario C — Internal Estimate', CAST(20 AS DECIMAL(6,2)), 'nearest_5', 'SIMULATED / INTERNAL ESTIMATE — NOT A VENDOR QUOTATION'))"""
_SCENARIO_ITEMS = f"""WITH {ITEMS_SQL}, {_CONFIG}, adjusted AS (
    SELECT *, round(rate * (1 + markup_percent * CAST(0.01 AS DECIMAL(2,2))), 2)::DECIMAL(18,2) AS adjusted_rate FROM items, config),
scenario_items AS (
    SELECT *, (line_amount + tax_amount)::DECIMAL(18,2) AS total_amount FROM (
        SELECT *, round(line_amount * gst_rate * CAST(0.01 AS DECIMAL(2,2)), 2)::DECIMAL(18,2) AS tax_amount FROM (
            SELECT *, round(quantity * adjusted_rate, 2)::DECIMAL(18,2) AS line_amount FROM adjusted)))"""
_SCENARIO_TOTALS = f"""{_SCENARIO_ITEMS}, scenario_sums AS (
    SELECT bill_id, scenario_type, label, markup_percent, rounding_mode, disclaimer, sum(line_amount)::DECIMAL(18,2) AS subtotal, sum(tax_amount)::DECIMAL(18,2) AS tax_total
    FROM scenario_items GROUP BY ALL),
scenario_totals AS (
    SELECT *, (CASE rounding_mode WHEN 'none' THEN subtotal + tax_total ELSE round((subtotal + tax_total)::DECIMAL(18,2) * CAST(0.2 AS DECIMAL(2,1)), 0) * 5 END)::DECIMAL(18,2) AS grand_total
    FROM scenario_sums)"""


def _scenario_items(spark, sf_dir):
    return scenarios.items(items(spark, sf_dir), scenarios.config(spark, "12.5", "20", "nearest_5"))


@query(f"{_SCENARIO_ITEMS} SELECT bill_id, serial_no, scenario_type, markup_percent, rate AS baseline_rate, adjusted_rate, line_amount, tax_amount, total_amount, disclaimer FROM scenario_items")
def scenario_items(spark, sf_dir):
    return _scenario_items(spark, sf_dir).select(
        "bill_id", "serial_no", "scenario_type", "markup_percent", F.col("rate").alias("baseline_rate"), "adjusted_rate", "line_amount", "tax_amount", "total_amount", "disclaimer"
    )


@query(f"{_SCENARIO_TOTALS} SELECT * FROM scenario_totals")
def scenario_totals(spark, sf_dir):
    return scenarios.totals(_scenario_items(spark, sf_dir))


@query(
    f"""{_TOTALS} SELECT bill_id, mode, (CASE mode WHEN 'none' THEN grand_total
        WHEN 'nearest_1' THEN round(grand_total * CAST(1 AS DECIMAL(2,1)), 0) WHEN 'nearest_5' THEN round(grand_total * CAST(0.2 AS DECIMAL(2,1)), 0) * 5
        ELSE round(grand_total * CAST(0.1 AS DECIMAL(2,1)), 0) * 10 END)::DECIMAL(18,2) AS rounded
        FROM totals, (VALUES ('none'), ('nearest_1'), ('nearest_5'), ('nearest_10')) AS modes(mode)"""
)
def scenario_rounding_modes(spark, sf_dir):
    """Every bill's total under each rounding mode."""
    modes = F.explode(F.array(*map(F.lit, ("none", "nearest_1", "nearest_5", "nearest_10")))).alias("mode")
    d = bill_totals(spark, sf_dir).select("bill_id", "grand_total", modes)
    return d.select("bill_id", "mode", money.round_to_nearest(F.col("grand_total"), F.col("mode")).alias("rounded"))


@query(
    f"""{_SCENARIO_TOTALS} SELECT a.bill_id, a.grand_total AS baseline, b.grand_total AS estimate_b, c.grand_total AS estimate_c, (b.grand_total - a.grand_total)::DECIMAL(18,2) AS more_b
        FROM scenario_totals a JOIN scenario_totals b ON b.bill_id = a.bill_id AND b.scenario_type = 'simulation_b' JOIN scenario_totals c ON c.bill_id = a.bill_id AND c.scenario_type = 'simulation_c'
        WHERE a.scenario_type = 'baseline'"""
)
def scenario_compare(spark, sf_dir):
    """The three totals of a bill side by side: one more aggregation on the same key, no join."""
    d = scenario_totals(spark, sf_dir)
    total = lambda kind: F.max(F.when(F.col("scenario_type") == kind, F.col("grand_total")))
    d = d.groupBy("bill_id").agg(total("baseline").alias("baseline"), total("simulation_b").alias("estimate_b"), total("simulation_c").alias("estimate_c"))
    return d.withColumn("more_b", (F.col("estimate_b") - F.col("baseline")).cast("decimal(18,2)"))


@query(
    f"""{_SCENARIO_ITEMS}, sums AS (SELECT bill_id, scenario_type, any_value(rounding_mode) AS mode, (sum(line_amount) + sum(tax_amount))::DECIMAL(18,2) AS g FROM scenario_items GROUP BY bill_id, scenario_type),
        ranked AS (SELECT i.*, row_number() OVER (PARTITION BY bill_id, scenario_type ORDER BY serial_no, total_amount, adjusted_rate, part_id::VARCHAR) AS row_no FROM scenario_items i)
        SELECT scenario_type, disclaimer, CASE scenario_type WHEN 'baseline' THEN 'baseline.pdf' WHEN 'simulation_b' THEN 'scenario-b.pdf' ELSE 'scenario-c.pdf' END AS filename,
               ((row_no - 1) // 3 + 1)::INTEGER AS page_no, count(*) AS n_rows, max('Rs. ' || format('{{:,.2f}}', total_amount::DOUBLE)) AS last_text
        FROM ranked GROUP BY ALL"""
)
def render_rows(spark, sf_dir):
    """Rows a renderer would draw, three a page, summed up by page."""
    d = _scenario_items(spark, sf_dir).withColumn("description", F.col("part_id").cast("string"))
    rows = scenarios.render_rows(d, capacity=3)
    return rows.groupBy("scenario_type", "disclaimer", "filename", "page_no").agg(F.count("*").alias("n_rows"), F.max("total_text").alias("last_text"))


_HEIGHT, _PAGE, _PITCH = (30, 12, 8), 60, 26
_PAGED = """WITH RECURSIVE named AS (
        SELECT l_orderkey AS bill_id, l_linenumber AS serial_no, p_name || repeat(' x', (l_partkey % 140)::INTEGER) AS description, CAST(l_extendedprice AS DECIMAL(14,2)) AS rate, l_quantity, l_tax FROM lineitem JOIN part ON p_partkey = l_partkey),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY bill_id ORDER BY serial_no, rate, l_quantity, l_tax, description) AS row_no, greatest(1, (length(description) + 29) // 30) * 12 + 8 AS height FROM named),
    pages AS (
        SELECT bill_id, row_no, {down} AS used, 1 AS page_no FROM numbered WHERE row_no = 1
        UNION ALL SELECT n.bill_id, n.row_no, CASE WHEN used + height > 60 THEN 0 ELSE used END + {down}, CASE WHEN used + height > 60 THEN page_no + 1 ELSE page_no END
        FROM pages p JOIN numbered n ON n.bill_id = p.bill_id AND n.row_no = p.row_no + 1)
    SELECT bill_id, page_no::INTEGER AS page_no, count(*) AS n_rows, sum(length(description))::BIGINT AS n_chars, min(row_no)::BIGINT AS first_row FROM pages JOIN numbered USING (bill_id, row_no) GROUP BY ALL"""


def _paged(spark, sf_dir, pitch=None):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), "p_name")
    name = F.concat("p_name", F.expr("repeat(' x', cast(part_id % 140 as int))"))
    order = F.row_number().over(Window.partitionBy("bill_id").orderBy("serial_no", "rate", "quantity", "gst_rate", "description"))
    d = items(spark, sf_dir).join(parts, "part_id").withColumn("description", name).withColumn("row_no", order).withColumn("pitch", F.lit(_PITCH))
    d = d.select("bill_id", "row_no", "description", "pitch", scenarios.text_height(F.col("description"), *_HEIGHT).alias("height"))
    rows = scenarios.paged(d, ["bill_id"], "row_no", "height", _PAGE, pitch)
    return rows.groupBy("bill_id", "page_no").agg(F.count("*").alias("n_rows"), F.sum(F.char_length("description")).alias("n_chars"), F.min("row_no").cast("long").alias("first_row"))


@query(_PAGED.format(down="height"))
def paged_rows(spark, sf_dir):
    """Items with descriptions of one line to ten, on pages that hold three lines of single ones; some are higher than a page."""
    return _paged(spark, sf_dir)


@query(_PAGED.format(down="26"))
def pitched_rows(spark, sf_dir):
    """The same at a fixed distance: a description that doesn't fit above the foot begins a page, but takes one row of it."""
    return _paged(spark, sf_dir, "pitch")


@query(
    """SELECT l_orderkey AS bill_id, l_linenumber AS id, l_shipdate AS created_at, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey)::INTEGER AS place, l_partkey AS part_id FROM lineitem"""
)
def scenario_lists(spark, sf_dir):
    """Each bill's scenarios in the order in which they were made."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bill_id"), F.col("l_linenumber").alias("id"), F.col("l_shipdate").alias("created_at"), F.col("l_partkey").alias("part_id"), "l_suppkey")
    return catalog.listed(d, "bill_id", "created_at", "id", "part_id", "l_suppkey").drop("l_suppkey")


_EDITED = f"WITH {ITEMS_SQL}, edited AS (SELECT bill_id, serial_no, CASE WHEN serial_no = 7 THEN NULL ELSE quantity - 3 END AS quantity, rate - 2000 AS rate, gst_rate * 15 AS gst_rate FROM items)"


def _edited(spark, sf_dir):
    """Items with values a careless edit might leave: missing and negative quantities, negative rates, rates of tax above 100."""
    d = items(spark, sf_dir)
    return d.select("bill_id", "serial_no", F.when(F.col("serial_no") != 7, F.col("quantity") - 3).alias("quantity"), (F.col("rate") - 2000).alias("rate"), (F.col("gst_rate") * 15).alias("gst_rate"))


@query(
    f"""{_EDITED}, errors AS (
        SELECT 'quantity' AS field, 'Quantity required' AS message FROM edited WHERE quantity IS NULL OR quantity < 0
        UNION ALL SELECT 'rate', 'Rate must be a valid non-negative monetary value.' FROM edited WHERE rate IS NULL OR rate < 0
        UNION ALL SELECT 'gst_rate', 'GST rate must be between 0 and 100.' FROM edited WHERE gst_rate > 100 OR gst_rate < 0)
        SELECT field, message, count(*) AS n FROM errors GROUP BY ALL"""
)
def validate_items(spark, sf_dir):
    errors = _edited(spark, sf_dir).select(F.explode(bill_ops.item_errors(F.col("quantity"), F.col("rate"), F.col("gst_rate"))).alias("e"))
    return errors.groupBy(F.col("e.field").alias("field"), F.col("e.message").alias("message")).agg(F.count("*").alias("n"))


@query(
    f"""{_EDITED}, {BILLS_SQL}, counts AS (
        SELECT b.bill_id, count(e.bill_id) AS n_items, count(*) FILTER (e.bill_id IS NOT NULL AND (e.quantity IS NULL OR e.quantity < 0 OR e.rate < 0)) AS n_bad
        FROM bills b LEFT JOIN edited e ON e.bill_id = b.bill_id GROUP BY b.bill_id)
        SELECT bill_id, n_items, n_bad, 400 AS code, CASE WHEN n_items = 0 THEN 'A bill needs at least one item.' ELSE 'Some items need a quantity and a rate.' END AS message
        FROM counts WHERE n_items = 0 OR n_bad > 0"""
)
def unconfirmable_bills(spark, sf_dir):
    return bill_ops.confirmable(bills(spark, sf_dir), _edited(spark, sf_dir)).where("code = 400")


@query(
    f"""{_EDITED} SELECT bill_id, serial_no, line_amount, round(line_amount * g * CAST(0.01 AS DECIMAL(2,2)), 2)::DECIMAL(18,2) AS tax_amount FROM (
        SELECT bill_id, serial_no, round(CASE WHEN coalesce(quantity, 0) <= 0 THEN 1 ELSE quantity END::DECIMAL(12,3) * rate, 2)::DECIMAL(18,2) AS line_amount, coalesce(gst_rate, 0)::DECIMAL(5,2) AS g FROM edited)"""
)
def edit_defaults(spark, sf_dir):
    return bill_ops.with_edit_defaults(_edited(spark, sf_dir)).select("bill_id", "serial_no", "line_amount", "tax_amount")


@query(f"{_TOTALS} SELECT bill_id, printed_total, grand_total, abs(printed_total - grand_total) <= 1.00 AS reconciled FROM totals")
def reconcile_totals(spark, sf_dir):
    d = bill_totals(spark, sf_dir).join(bills(spark, sf_dir).select("bill_id", "printed_total"), "bill_id")
    return d.select("bill_id", "printed_total", "grand_total", bill_ops.reconciles(F.col("printed_total"), F.col("grand_total")).alias("reconciled"))


@query(
    f"""{_PRICED}, {BILLS_SQL} SELECT b.bill_id, count(p.bill_id) AS n_items,
        count(p.bill_id) = 0 OR coalesce(bool_or(1 - confidence_gap < 0.925), false) OR coalesce(abs(any_value(printed_total) - sum(line_amount) - sum(tax_amount)) > 2000000, false) AS needs_review
        FROM bills b LEFT JOIN priced p ON p.bill_id = b.bill_id GROUP BY b.bill_id"""
)
def review_flags(spark, sf_dir):
    """Bills without items, with an unsure item, or far from their printed total."""
    d = bill_ops.with_amounts(items(spark, sf_dir)).groupBy("bill_id").agg(F.count("*").alias("n_items"), F.bool_or(1 - F.col("confidence_gap") < 0.925).alias("unsure"), (F.sum("line_amount") + F.sum("tax_amount")).alias("g"))
    d = bills(spark, sf_dir).join(d, "bill_id", "left").na.fill(0, ["n_items"])
    review = bill_ops.needs_review(F.col("n_items"), F.col("unsure"), F.col("printed_total"), F.col("g"), "2000000.00")
    return d.select("bill_id", "n_items", review.alias("needs_review"))


@query(
    """SELECT CASE WHEN s >= 0.90 THEN 'high' WHEN s >= 0.75 THEN 'medium' ELSE 'low' END AS tier, coalesce(round(s, 4) < 0.75, true) AS low_confidence, count(*) AS n
        FROM (SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(1 - l_discount * 4 AS DECIMAL(5,4)) END AS s FROM lineitem) GROUP BY ALL"""
)
def confidence_tiers(spark, sf_dir):
    share = F.when(F.col("l_linenumber") != 7, (1 - F.col("l_discount") * 4).cast("decimal(5,4)"))
    d = table(spark, sf_dir, "lineitem").select(share.alias("s"))
    return d.groupBy(text.confidence_tier(F.col("s")).alias("tier"), text.low_confidence(F.round("s", 4)).alias("low_confidence")).agg(F.count("*").alias("n"))


@query(
    """WITH counts AS (SELECT l_orderkey AS bill_id, count(*) AS n FROM lineitem GROUP BY 1)
        SELECT o_orderkey AS document_id, o_orderdate AS uploaded_at, o_totalprice AS grand_total, coalesce(n, 0) AS scenario_count
        FROM orders LEFT JOIN counts ON bill_id = o_orderkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 10"""
)
def document_history(spark, sf_dir):
    """A page of the history: the limit is the feature."""
    return catalog.history(*_history(spark, sf_dir), 50, 10)


def _history(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    documents = orders.select(F.col("o_orderkey").alias("document_id"), F.col("o_orderdate").alias("uploaded_at"))
    bill_rows = orders.select(F.col("o_orderkey").alias("document_id"), F.col("o_orderkey").alias("bill_id"), F.col("o_totalprice").alias("grand_total"))
    return documents, bill_rows, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bill_id"))


@query(
    """WITH counts AS (SELECT l_orderkey AS bill_id, count(*) AS n FROM lineitem GROUP BY 1)
        SELECT o_orderkey AS document_id, o_orderdate AS uploaded_at, o_totalprice AS grand_total, coalesce(n, 0) AS scenario_count
        FROM orders LEFT JOIN counts ON bill_id = o_orderkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 40 OFFSET 80"""
)
def history_pages(spark, sf_dir):
    """The third page of forty, each found from the last row of the one before."""
    parts, after = _history(spark, sf_dir), None
    for _ in range(3):
        page = catalog.history(*parts, 40, after=after)
        last = page.orderBy("uploaded_at", F.desc("document_id")).first()
        after = (last["uploaded_at"], last["document_id"])
    return page


@query(
    """SELECT c_custkey AS document_id, count(*) AS n_files, max(l_shipdate) AS last_generated
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY c_custkey"""
)
def document_files(spark, sf_dir):
    files = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scenario_id"), F.col("l_shipdate").alias("generated_at"))
    scenario_rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scenario_id"), F.col("o_custkey").alias("bill_id"))
    bill_rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("bill_id"), F.col("c_custkey").alias("document_id"))
    return catalog.document_files(files, scenario_rows, bill_rows).groupBy("document_id").agg(F.count("*").alias("n_files"), F.max("generated_at").alias("last_generated"))


@query(
    """SELECT scenario_id, generated_at, serial_no, part_id FROM (
        SELECT l_orderkey AS scenario_id, l_shipdate AS generated_at, l_linenumber AS serial_no, l_partkey AS part_id,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC) AS rn FROM lineitem) WHERE rn = 1"""
)
def file_latest(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scenario_id"), F.col("l_shipdate").alias("generated_at"), F.col("l_linenumber").alias("serial_no"), F.col("l_partkey").alias("part_id"))
    return catalog.latest(d, "scenario_id", "generated_at", "serial_no", "part_id")


_KEPT = "SELECT c_custkey FROM customer WHERE c_acctbal < 0"


@query(
    f"""SELECT 'documents' AS kind, count(*) AS n FROM customer WHERE c_custkey NOT IN ({_KEPT})
        UNION ALL SELECT 'bills', count(*) FROM orders WHERE o_custkey NOT IN ({_KEPT})
        UNION ALL SELECT 'items', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN ({_KEPT}))"""
)
def delete_cascade(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "document_id")
    left = store.delete_documents({"documents": customers, "bills": bills(spark, sf_dir), "items": items(spark, sf_dir)}, customers.where("c_acctbal < 0").select("document_id"))
    counts = [d.agg(F.lit(kind).alias("kind"), F.count("*").alias("n")) for kind, d in left.items()]
    return counts[0].union(counts[1]).union(counts[2])


@query(f"WITH {ITEMS_SQL} SELECT o_orderkey AS bill_id, coalesce(max(serial_no), 0) + 1 AS next_serial FROM orders LEFT JOIN items ON bill_id = o_orderkey GROUP BY 1")
def next_serial(spark, sf_dir):
    return bill_ops.next_serial(bills(spark, sf_dir), items(spark, sf_dir))


@query(
    """WITH one AS (SELECT DISTINCT l_orderkey AS bill_id, l_linenumber AS id FROM lineitem),
        sizes AS (SELECT bill_id, max(id) AS top FROM one GROUP BY bill_id)
        SELECT bill_id, id, CASE WHEN bill_id % 3 = 0 THEN id ELSE row_number() OVER (PARTITION BY bill_id ORDER BY id DESC) END::INTEGER AS serial_no, bill_id % 3 <> 0 AS reordered FROM one JOIN sizes USING (bill_id)"""
)
def reorder_items(spark, sf_dir):
    """Items turned round; every third bill's order names one item too many, and is refused."""
    one = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bill_id"), F.col("l_linenumber").alias("id")).distinct().withColumn("serial_no", F.col("id"))
    turned = one.groupBy("bill_id").agg(F.sort_array(F.collect_list("id"), False).alias("item_ids"))
    wrong = F.when(F.col("bill_id") % 3 == 0, F.concat("item_ids", F.array(F.lit(99)))).otherwise(F.col("item_ids"))
    return bill_ops.reordered(one, turned.withColumn("item_ids", wrong)).select("bill_id", "id", "serial_no", "reordered")


@query(
    f"""WITH {ITEMS_SQL}, pages AS (SELECT bill_id AS doc_id, serial_no % 3 AS page, count(*) AS n FROM items GROUP BY ALL),
        offsets AS (SELECT doc_id, page, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM pages)
        SELECT doc_id, page, serial_no + o AS serial_no, part_id FROM (SELECT bill_id AS doc_id, serial_no % 3 AS page, serial_no, part_id FROM items) JOIN offsets USING (doc_id, page)"""
)
def page_serials(spark, sf_dir):
    d = items(spark, sf_dir).select(F.col("bill_id").alias("doc_id"), (F.col("serial_no") % 3).alias("page"), "serial_no", "part_id")
    return bill_ops.numbered(d)


@query(
    """WITH one AS (SELECT DISTINCT l_orderkey AS bill_id, l_linenumber AS serial_no FROM lineitem), up AS (SELECT bill_id, max(serial_no) AS u FROM one GROUP BY bill_id),
        near AS (SELECT bill_id, serial_no, lag(serial_no) OVER w AS b, lead(serial_no) OVER w AS a FROM one WINDOW w AS (PARTITION BY bill_id ORDER BY serial_no))
        SELECT bill_id, serial_no, CASE WHEN serial_no = u AND b IS NOT NULL THEN b WHEN a = u THEN a ELSE serial_no END AS new_serial FROM near JOIN up USING (bill_id)"""
)
def move_up(spark, sf_dir):
    one = items(spark, sf_dir).select("bill_id", "serial_no").distinct()
    return catalog.moved(one, "bill_id", "serial_no", one.groupBy("bill_id").agg(F.max("serial_no").alias("serial_no")))


@query(
    """SELECT o_orderkey AS bill_id, count(l_orderkey)::INTEGER AS n_children, coalesce(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey), '') AS parts
        FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"""
)
def bill_children(spark, sf_dir):
    d = catalog.children(bills(spark, sf_dir), items(spark, sf_dir), "bill_id", "serial_no", "part_id")
    return d.select("bill_id", F.size("children").alias("n_children"), F.array_join(F.transform("children", lambda c: c["part_id"].cast("string")), ",").alias("parts"))


@query(
    """WITH last AS (SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
        SELECT e.user_id AS document_id, count(*) AS n_events, max(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 1)) AS attempts_used, any_value(last.event_type) AS status
        FROM events e JOIN last USING (user_id) GROUP BY e.user_id"""
)
def run_lifecycle(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    attempts = F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(1))
    return catalog.run_states(e.select(F.col("user_id").alias("document_id"), F.col("event_type").alias("status"), F.col("ts").alias("at"), "event_id", attempts.alias("attempts")))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, octet_length(encode(coalesce(text, '')))::BIGINT AS file_size FROM documents")
def content_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", uploads.content_hash(F.col("text")).alias("content_hash"), F.octet_length("text").cast("long").alias("file_size"))


_UPLOADS = """files AS (SELECT page_id, 'scan ' || page_id || (CASE page_id % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.png' WHEN 3 THEN '.exe' ELSE '' END) AS name,
    CASE page_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'text/html' ELSE 'image/png' END AS mime, length(html) * CASE WHEN page_id % 7 = 0 THEN 0 WHEN page_id % 11 = 0 THEN 10000 ELSE 1 END AS size FROM pages)"""


@query(
    f"""WITH {_UPLOADS}, kinds AS (SELECT *, lower(regexp_extract(name, '(\\.[^./]*)$', 1)) AS ext FROM files)
        SELECT page_id, CASE WHEN ext NOT IN ('.pdf', '.jpg', '.jpeg', '.png') THEN 'Unsupported file type ''' || ext || '''. Allowed: .pdf, .jpg, .jpeg, .png'
            WHEN mime NOT IN ('application/pdf', 'image/jpeg', 'image/png') THEN 'Unsupported content type ''' || mime || '''.'
            WHEN size <= 0 THEN 'Uploaded file is empty.' WHEN size > 20971520 THEN 'File exceeds maximum size of 20 MB.' END AS error FROM kinds"""
)
def upload_checks(spark, sf_dir):
    p, k = table(spark, sf_dir, "pages"), F.col("page_id") % 5
    ext = F.when(k == 0, ".PDF").when(k == 1, ".jpeg").when(k == 2, ".png").when(k == 3, ".exe").otherwise("")
    mime = F.when(k == 0, "application/pdf").when(k == 1, "image/jpeg").when(k == 2, "text/html").otherwise("image/png")
    factor = F.when(F.col("page_id") % 7 == 0, 0).when(F.col("page_id") % 11 == 0, 10000).otherwise(1)
    d = p.select("page_id", F.concat(F.lit("scan "), F.col("page_id").cast("string"), ext).alias("name"), mime.alias("mime"), (F.char_length("html") * factor).alias("size"))
    return d.select("page_id", uploads.upload_error(F.col("name"), F.col("mime"), F.col("size")).alias("error"))


@query("SELECT page_id, url FROM pages WHERE contains(lower(url), 'utm')")
def filename_search(spark, sf_dir):
    return uploads.named_like(table(spark, sf_dir, "pages"), "url", " UTM ").select("page_id", "url")


@query("SELECT l_partkey AS part_id, min(l_orderkey) AS first_bill, count(DISTINCT l_orderkey) AS n_bills FROM lineitem GROUP BY 1")
def first_seen(spark, sf_dir):
    seen = catalog.first_seen(items(spark, sf_dir), "part_id", "bill_id", "bill_id")
    return seen.select("part_id", F.element_at("seen", 1).alias("first_bill"), F.size("seen").cast("long").alias("n_bills"))


@query(
    """WITH firsts AS (SELECT user_id, event_type, min((ts, event_id)) AS came FROM events WHERE event_type IS NOT NULL GROUP BY ALL)
        SELECT user_id, string_agg(event_type, ' > ' ORDER BY came, event_type) AS seen, count(*)::INTEGER AS n FROM firsts GROUP BY user_id"""
)
def first_seen_kinds(spark, sf_dir):
    """The kinds of event of every user, as they first came."""
    seen = catalog.first_seen(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id")
    return seen.select("user_id", F.array_join("seen", " > ").alias("seen"), F.size("seen").alias("n"))


@query(
    """WITH files AS (
        SELECT doc_id, lpad(doc_id::VARCHAR, 12, '0') AS id, sha256(coalesce(text, '')) AS h, octet_length(encode(coalesce(text, ''))) AS size, doc_id % 3 = 0 AS there, (doc_id * 7919) % 1009 AS came FROM documents),
    checked AS (SELECT *, CASE WHEN size = 0 THEN 'Uploaded file is empty.' WHEN doc_id % 50 = 1 THEN 'Unsupported file type ''.exe''. Allowed: .pdf, .jpg, .jpeg, .png' END AS error FROM files WHERE NOT there),
    known AS (SELECT h, min(id) AS known_id FROM files WHERE there GROUP BY h),
    judged AS (
        SELECT c.*, known_id, first_value(id) OVER (PARTITION BY h, error IS NULL ORDER BY came, id) AS first_id FROM checked c LEFT JOIN known USING (h))
    SELECT doc_id, error, CASE WHEN error IS NOT NULL THEN 'failed' WHEN known_id IS NOT NULL OR first_id <> id THEN 'duplicate' ELSE 'stored' END AS outcome,
        CASE WHEN error IS NULL THEN coalesce(known_id, CASE WHEN first_id <> id THEN first_id END) END AS duplicate_of,
        CASE WHEN error IS NULL AND known_id IS NULL AND first_id = id THEN id || '.pdf' END AS stored_filename FROM judged"""
)
def upload_ingest(spark, sf_dir):
    """Texts as files, a third of them stored before: what is stored, what has the bytes of another, and what is refused."""
    k = F.col("doc_id")
    content = F.coalesce("text", F.lit("")).cast("binary")
    name = F.concat(F.lit("scan "), k.cast("string"), F.when(k % 50 == 1, ".exe").otherwise(".pdf"))
    files = table(spark, sf_dir, "documents").select(
        k, F.lpad(k.cast("string"), 12, "0").alias("id"), name.alias("original_filename"), F.lit("application/pdf").alias("mime_type"), uploads.content_hash(content).alias("file_hash"), F.octet_length(content).alias("file_size"),
        (k * 7919 % 1009).alias("uploaded_at"),
    )
    files = files.withColumn("error", uploads.upload_error(F.col("original_filename"), F.col("mime_type"), F.col("file_size")))
    there = k % 3 == 0
    return uploads.ingested(files.where(~there), files.where(there)).select("doc_id", "error", "outcome", "duplicate_of", "stored_filename")


@query(
    """SELECT o_orderkey AS bill_id, CAST(o_totalprice AS DECIMAL(14,2)) AS grand_total, CASE WHEN o_orderkey % 3 = 0 THEN 'INR' WHEN o_orderkey % 3 = 1 THEN CASE WHEN o_orderstatus = 'O' THEN NULL ELSE 'INR' END ELSE o_orderstatus END AS currency,
        CASE WHEN o_orderkey % 3 = 2 THEN o_orderpriority END AS priority, (1 + o_orderkey % 3)::INTEGER AS version FROM orders"""
)
def mixed_versions(spark, sf_dir):
    """Bills in files of three versions: the second has a currency, the third also a priority and decimal totals."""
    base, d = shared_path(spark, "versions"), table(spark, sf_dir, "orders")
    own = {
        1: [F.col("o_orderkey").cast("int").alias("bill_id"), F.col("o_totalprice").alias("grand_total")],
        2: [F.col("o_orderkey").cast("int").alias("bill_id"), F.col("o_totalprice").alias("grand_total"), F.when(F.col("o_orderstatus") != "O", "INR").alias("currency")],
        3: [F.col("o_orderkey").alias("bill_id"), F.col("o_totalprice").cast("decimal(14,2)").alias("grand_total"), F.col("o_orderstatus").alias("currency"), F.col("o_orderpriority").alias("priority"), F.lit(1).alias("unread")],
    }
    for version, columns in own.items():
        d.where(F.col("o_orderkey") % 3 == version - 1).select(*columns).write.parquet(f"{base}/version={version}")
    return versions.read_versions(spark, base, [versions.Column("bill_id", "long"), versions.Column("grand_total", "decimal(14,2)"), versions.Column("currency", "string", "INR"), versions.Column("priority", "string")])


@query(
    """WITH last AS (SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
        SELECT e.user_id AS document_id, count(*) AS n_events, max((e.event_id % 4)::INTEGER) AS attempts_used, any_value(last.event_type) AS status FROM events e JOIN last USING (user_id) GROUP BY e.user_id"""
)
def live_runs(spark, sf_dir):
    """The stored run states after a stream of all events, which come in three pieces, out of order."""
    base, e = shared_path(spark, "runs"), table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("document_id"), F.col("event_type").alias("status"), F.col("ts").alias("at"), "event_id", (F.col("event_id") % 4).cast("int").alias("attempts"))
    held = Stored(f"{base}/states", "document_id", 8)
    held.write(catalog.run_states(rows.limit(0)))
    for piece in range(3):
        rows.where(F.col("event_id") % 3 == piece).write.mode("append").parquet(f"{base}/log")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/log")
        ingest.keep_states(ingest.live_states(stream), held, f"{base}/checkpoint").awaitTermination()
    return held.read(spark).select("document_id", "n_events", "attempts_used", "status")


@query("SELECT date_trunc('hour', ts) AS start, event_type AS status, count(*) AS n FROM events GROUP BY ALL")
def run_windows(spark, sf_dir):
    """Events by hour and kind, kept by a stream over two pieces."""
    base, e = shared_path(spark, "windows"), table(spark, sf_dir, "events")
    rows = e.select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("status"), "event_id")
    for piece in range(2):
        rows.where(F.col("event_id") % 2 == piece).write.mode("append").parquet(f"{base}/log")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/log")
        ingest.keep_counts(ingest.run_counts(stream), f"{base}/counts", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/counts").select(F.col("start").cast("timestamp_ntz").alias("start"), "status", "n")


@query(f"WITH {BILLS_SQL} SELECT bill_id, CASE WHEN o_orderstatus = 'F' THEN '409' END AS code FROM bills UNION ALL SELECT -bill_id, '404' FROM bills WHERE bill_id <> 0")
def edit_guards(spark, sf_dir):
    """Edits of every bill and of as many unknown ones; finished orders count as confirmed."""
    b = bills(spark, sf_dir).withColumn("confirmed", F.col("o_orderstatus") == "F")
    edits = b.select("bill_id").union(b.where("bill_id <> 0").select(-F.col("bill_id")))
    return bill_ops.edit_errors(edits, b).select("bill_id", F.col("code").cast("string").alias("code"))
