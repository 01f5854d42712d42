"""The relational store, extraction end to end, uploads as a stream, and the shape of plans."""

import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from billweave.operators import bills, catalog, layout, scenarios, storage, store
from billweave.schema import WORDS
from billweave.sources import uploads, versions
from billweave.streaming import ingest
from test_tables import header_words, table_words

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def invoice(doc):
    """A three-item invoice with its header above the table; only rates without tax are printed."""
    head = header_words([[(0, "Harbour Paper Works")], [(0, "4 Quay Lane, Kochi - 682001")], [(0, "GSTIN: 32PQRST5678K1Z9")], [(0, "Invoice No: HPW/25/0417")], [(0, "Date: 14/03/2025")], [(0, "Bill To: Lighthouse School")]], doc)
    body = table_words(
        [
            ["S.No", "Description", "HSN/SAC", "Qty", "Unit", "Rate", "GST%", "Amount"],
            ["1", "Drawing Sheet Pack", "4811", "1", "RIM", "150.00", "18", "150.00"],
            ["2", "Wax Crayon Set", "9609", "4", "PCS", "25.00", "12", "100.00"],
            ["3", "Paper Punch No. 3", "8472", "2", "PCS", "60.00", "18", "120.00"],
            ["", "Grand Total", "", "", "", "", "", "430.60"],
        ],
        doc,
    )
    return head + [(d, p, n + 100, t, c, x, y + 400, w, h, ln + 50, b, par) for d, p, n, t, c, x, y, w, h, ln, b, par in body]


def test_extraction(spark):
    """A digital document, a scanned one, and one without any item."""
    digital, scanned = spark.createDataFrame(invoice("a"), WORDS), spark.createDataFrame(invoice("b") + header_words([[(0, "nothing")]], "c"), WORDS)
    found, items = bills.extract(spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "doc_id string"), digital, scanned)
    got = {r["bill_id"]: r for r in found.collect()}
    for doc in "ab":
        b = got[doc]
        assert (b["vendor_name"], b["vendor_gstin"], b["invoice_number"], str(b["invoice_date"]), b["buyer_name"]) == ("Harbour Paper Works", "32PQRST5678K1Z9", "HPW/25/0417", "2025-03-14", "Lighthouse School")
        assert (b["subtotal"], b["grand_total"], b["n_items"], b["extraction_status"]) == (Decimal("275.80"), Decimal("275.80"), 3, "needs_review") and b["document_total"] == Decimal("430.60")
    assert got["d"]["n_items"] == 0 and got["d"]["extraction_status"] == "needs_review" and got["d"]["vendor_name"] is None
    rows = {(r["bill_id"], r["serial_no"]): r for r in items.collect()}
    assert [(rows["a", k]["description"], rows["a", k]["source_rate"]) for k in (1, 2, 3)] == [("Drawing Sheet Pack", Decimal("177.00")), ("Wax Crayon Set", Decimal("28.00")), ("Paper Punch No. 3", Decimal("70.80"))]


def test_serials_of_later_pages_are_offset(spark):
    items = spark.createDataFrame([("a", 0, 1), ("a", 0, 2), ("a", 1, 16), ("b", 1, 1)], "doc_id string, page int, serial_no long")
    assert sorted(map(tuple, bills.numbered(items).select("doc_id", "serial_no").collect())) == [("a", 1), ("a", 2), ("a", 18), ("b", 1)]


def test_guards_and_reorder(spark):
    b = spark.createDataFrame([(1, True), (2, False)], "bill_id int, confirmed boolean")
    assert {r["bill_id"]: r["code"] for r in bills.edit_errors(spark.createDataFrame([(1,), (2,), (3,)], "bill_id int"), b).collect()} == {1: 409, 2: None, 3: 404}
    items = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "bill_id int, id string, serial_no int")
    order = spark.createDataFrame([(1, ["b", "a", "b"]), (2, ["c", "x"])], "bill_id int, item_ids array<string>")
    assert {r["id"]: (r["serial_no"], r["reordered"]) for r in bills.reordered(items, order).collect()} == {"a": (2, True), "b": (3, True), "c": (1, False)}


def test_cascade_and_upgrade(spark):
    documents, bill_rows = spark.createDataFrame([(1,), (2,)], "document_id int"), spark.createDataFrame([(10, 1), (20, 2)], "bill_id int, document_id int")
    items = spark.createDataFrame([(10, "x"), (20, "y")], "bill_id int, id string")
    kept = [*store.delete_documents({"documents": documents, "bills": bill_rows, "items": items}, spark.createDataFrame([(1,)], "document_id int")).values()]
    assert [[tuple(r) for r in d.collect()] for d in kept] == [[(2,)], [(2, 20)] if kept[1].columns[0] == "document_id" else [(20, 2)], [(20, "y")]]
    assert catalog.upgraded(items, {"unit": "string", "id": "int"}).dtypes == [("bill_id", "int"), ("id", "string"), ("unit", "string")]


def test_uploads_batch_and_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.pdf").write_bytes(b"%PDF")
    (src / "b.txt").write_bytes(b"text")
    assert {r["original_filename"]: r["status"] for r in uploads.read_uploads(spark, f"file://{src}").collect()} == {"a.pdf": "uploaded", "b.txt": "failed"}
    for name in ("first", "second"):
        if name == "second":
            (src / "c.png").write_bytes(b"png")
        ingest.write_uploads(ingest.upload_stream(spark, f"file://{src}"), f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
    assert sorted(r["original_filename"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a.pdf", "b.txt", "c.png"]


def test_best_attempt_and_digital_words(spark):
    got = uploads.best_attempt(spark.createDataFrame([("a", 0, 1, 0.5), ("a", 0, 2, 0.5), ("a", 1, 1, 0.2), ("a", 1, 2, 0.9)], "doc_id string, page int, attempt int, confidence double"))
    assert {r["page"]: (r["attempt"], r["attempts_used"]) for r in got.collect()} == {0: (1, 2), 1: (2, 2)}
    words = spark.createDataFrame(header_words([[(0, "a b c d e f g h")]], "x") + header_words([[(0, "a b")]], "y"), WORDS)
    assert {r["doc_id"] for r in uploads.digital_words(words).collect()} == {"x"}


def test_plans_stay_in_the_jvm(spark):
    """No Python worker, no cartesian product; the only unkeyed join is with the three scenario rows, which are broadcast."""
    for name in ("scenario_totals", "bill_totals", "document_history", "rate_resolution", "candidate_items", "header_fields"):
        text = plan(entry.queries()[name](spark, SF))
        assert "Python" not in text and "CartesianProduct" not in text and "ArrowEval" not in text
    assert "PushedFilters: [IsNotNull(l_orderkey)" in plan(entry.queries()["bill_totals"](spark, SF))


def test_nothing_stays_cached(spark):
    """Lines are cut in the shared folder; no query leaves a cached table behind, and clustering folds within stretches only."""
    before = set(spark.sparkContext._jsc.getPersistentRDDs())
    entry.queries()["invoice_items"](spark, SF).count()
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= before
    assert "stretch" in plan(layout.line_clusters(spark.createDataFrame(invoice("a"), WORDS)))


def priced_items(spark, rows):
    kind = "bill_id long, id string, serial_no int, description string, gst_rate string, quantity string, source_rate string"
    d = spark.createDataFrame(rows, kind).selectExpr("bill_id", "id", "serial_no", "description", "cast(gst_rate as decimal(5,2)) gst_rate", "cast(quantity as decimal(12,3)) quantity", "cast(source_rate as decimal(14,2)) source_rate")
    zero = [f"cast(0 as decimal(14,2)) {c}" for c in ("line_amount", "tax_amount", "total_amount")]
    return d.selectExpr("*", "source_rate taxable_rate", *zero, "false user_verified")


def some_bills(spark, n):
    return spark.createDataFrame([(i, i % 5 == 4) for i in range(n)], "bill_id long, confirmed boolean").selectExpr("*", *[f"cast(0 as decimal(14,2)) {c}" for c in ("subtotal", "tax_total", "grand_total")])


EDITS = "bill_id long, seq int, op string, item_id string, description string, rate int"


def test_edits_of_one_bill_follow_each_other(spark):
    """An item added by one edit can be changed and deleted by later ones; a number is free again when the last item goes."""
    items = priced_items(spark, [(1, "a", 1, "Pen", "18", "2", "10.00"), (1, "b", 7, "Ink", "0", None, "5.00")])
    added = {s: spark.range(1).select(store.new_item_id(F.lit(1), F.lit(s))).first()[0] for s in (2, 5, 9)}
    edits = [
        (1, 1, "delete", "b", None, None), (1, 2, "add", None, "Nib", 3), (1, 3, "update", added[2], "Nibs", None), (1, 4, "delete", added[2], None, None), (1, 5, "add", None, "Cap", 4),
        (1, 6, "update", added[9], "early", 1), (1, 7, "update", "a", None, 20), (1, 8, "update", "a", "Pens", -1), (1, 9, "add", None, "Clip", 6), (1, 10, "delete", "b", None, None), (2, 1, "add", None, "x", 1),
    ]
    bills_, after, results = store.edit_items(some_bills(spark, 2), items, spark.createDataFrame(edits, EDITS).repartition(3))
    assert {(r["bill_id"], r["seq"]): r["code"] for r in results.collect()} == {(1, 1): 200, (1, 2): 200, (1, 3): 200, (1, 4): 200, (1, 5): 200, (1, 6): 404, (1, 7): 200, (1, 8): 400, (1, 9): 200, (1, 10): 404, (2, 1): 404}
    assert sorted((r["serial_no"], r["id"], r["description"], r["total_amount"], r["user_verified"]) for r in after.collect()) == [
        (1, "a", "Pen", Decimal("47.20"), True), (2, added[5], "Cap", Decimal("4.00"), True), (3, added[9], "Clip", Decimal("6.00"), True)
    ]
    assert {r["bill_id"]: r["grand_total"] for r in bills_.collect()} == {0: Decimal("0.00"), 1: Decimal("57.20")}


def test_stored_edits_can_be_repeated(spark, tmp_path, monkeypatch):
    """After a failure between the two tables, and after a success, the same batch leaves what one success leaves."""
    held = [storage.Stored(f"{tmp_path}/{name}", "bill_id", 4) for name in ("bills", "items")]
    held[0].write(some_bills(spark, 40))
    held[1].write(priced_items(spark, [(i, f"{i}/a", 1, "Pen", "18", "2", "10.00") for i in range(40)]))
    asked = [(i, 1, "add", None, "Nib", 3) for i in range(40)] + [(i, 2, "delete", f"{i}/a", None, None) for i in range(0, 40, 2)]
    edits = spark.createDataFrame(asked, EDITS)
    monkeypatch.setattr(store, "repriced", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.edit_stored(*held, f"{tmp_path}/log", edits, "monday")
    monkeypatch.undo()
    want = {i: Decimal("0.00") if i % 5 == 4 else Decimal("3.00") if i % 2 == 0 else Decimal("26.60") for i in range(40)}
    for _ in range(2):
        results = store.edit_stored(*held, f"{tmp_path}/log", edits, "monday")
        assert {(r["seq"], r["code"]) for r in results.where("bill_id % 5 < 4").collect()} == {(1, 200), (2, 200)}
        assert {r["bill_id"]: r["grand_total"] for r in held[0].read(spark).collect()} == want
        assert held[1].read(spark).count() == sum(1 if i % 5 == 4 or i % 2 == 0 else 2 for i in range(40))
    store.edit_stored(*held, f"{tmp_path}/log", edits.where("op = 'add'").withColumn("seq", F.lit(3)), "tuesday")
    assert held[1].read(spark).count() == sum(1 if i % 5 == 4 else 2 if i % 2 == 0 else 3 for i in range(40))


def test_stored_tables_empty_and_fill(spark, tmp_path):
    held = storage.Stored(f"{tmp_path}/t", "k", 3)
    rows = spark.range(10).selectExpr("id as k", "cast(id as string) as v")
    held.write(rows.limit(0))
    assert held.read(spark).count() == held.rows_of(spark, 1).count() == held.rows_of(spark).count() == 0
    held.replace(rows, rows, "fill")
    assert {r["k"] for r in held.read(spark).collect()} == set(range(10)) and [tuple(r) for r in held.rows_of(spark, 7, 99).collect()] == [(7, "7")]
    held.replace(rows, rows.limit(0), "drop")
    assert held.read(spark).count() == 0
    held.replace(rows, rows, "drop")  # taken before: no effect
    assert held.read(spark).count() == 0


def test_look_ups_read_one_bucket(spark, tmp_path):
    """A look-up by key lists one folder of the table, pushes its key to the scan, and reads the row groups that may hold it only."""
    spark.conf.set("parquet.block.size", 20_000)
    try:
        held = storage.Stored(f"{tmp_path}/t", "k", 8)
        held.write(spark.range(40_000).selectExpr("id as k", "sha2(cast(id as string), 256) as v").withColumn("k", F.col("k") * 3))
    finally:
        spark.conf.unset("parquet.block.size")
    got = held.rows_of(spark, 30_000)
    text_of = plan(got)
    assert "PartitionFilters" in text_of and "In(k, [30000])" in text_of or "EqualTo(k,30000)" in text_of
    (scan,) = scan_metrics(got)
    assert got.count() == scan["numPartitions"] == 1 and scan["numOutputRows"] < 40_000 / 8 / 2  # of the bucket's rows not even half are read


def scan_metrics(df):
    """What the scans of a query read."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if "Scan" in node.nodeName():
            found.append({name: node.metrics().apply(name).value() for name in ("numPartitions", "numOutputRows")})
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_history_counts_only_its_page(spark):
    documents = spark.createDataFrame([(i, i // 3) for i in range(60)], "document_id int, uploaded_at int")
    bill_rows = spark.createDataFrame([(i, 100 + i, 1.0) for i in range(60)], "document_id int, bill_id int, grand_total double")
    made = spark.createDataFrame([(100 + i,) for i in range(60) for _ in range(i % 4)], "bill_id int")
    seen, after = [], None
    while page := sorted(catalog.history(documents, bill_rows, made, 7, after=after).collect(), key=lambda r: (-r["uploaded_at"], r["document_id"])):
        seen += [(r["document_id"], r["scenario_count"]) for r in page]
        after = (page[-1]["uploaded_at"], page[-1]["document_id"])
    assert seen == [(i, i % 4) for i in sorted(range(60), key=lambda i: (-(i // 3), i))]
    text_of = plan(catalog.history(documents, bill_rows, made, 7)).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert text_of.index("Aggregate") < text_of.index("LeftSemi")  # the aggregation stands above, after the reduction


def test_pages_are_filled(spark):
    rows = spark.createDataFrame([("a", i, h) for i, h in enumerate((3, 4, 3, 1, 20, 1, 9, 1))] + [("b", 0, 50)], "k string, i int, h int")
    got = {(r["k"], r["i"]): r["page_no"] for r in scenarios.paged(rows, ["k"], "i", "h", 10).collect()}
    assert got == {**{("a", i): p for i, p in enumerate((1, 1, 1, 2, 3, 4, 4, 5))}, ("b", 0): 1}
    assert scenarios.paged(rows.limit(0), ["k"], "i", "h", 10).count() == 0


def test_the_same_bytes_are_stored_once(spark, tmp_path):
    """As a stream over two micro-batches, and as a batch beside what is stored."""
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.pdf").write_bytes(b"%PDF one")
    out, log = f"{tmp_path}/out", f"{tmp_path}/log"
    for name in ("b.pdf", "c.pdf"):
        ingest.write_uploads(ingest.new_uploads(ingest.upload_stream(spark, f"file://{src}")), out, log).awaitTermination()
        (src / name).write_bytes(b"%PDF one")
    (src / "d.pdf").write_bytes(b"%PDF two")
    ingest.write_uploads(ingest.new_uploads(ingest.upload_stream(spark, f"file://{src}")), out, log).awaitTermination()
    got = spark.read.parquet(out)
    assert sorted(r["original_filename"] for r in got.collect()) == ["a.pdf", "d.pdf"] and all(r["stored_filename"] == r["id"] + ".pdf" for r in got.collect())
    again = uploads.ingested(uploads.read_uploads(spark, f"file://{src}"), got.where("original_filename = 'a.pdf'"))
    first = got.where("original_filename = 'a.pdf'").first()["id"]
    assert {r["original_filename"]: (r["outcome"], r["duplicate_of"]) for r in again.collect()} == {"a.pdf": ("duplicate", first), "b.pdf": ("duplicate", first), "c.pdf": ("duplicate", first), "d.pdf": ("stored", None)}


def test_too_large_files_are_rows_without_bytes(spark, tmp_path, monkeypatch):
    (tmp_path / "a.pdf").write_bytes(b"%PDF" * 10)
    (tmp_path / "b.pdf").write_bytes(b"%PDF" * 1000)
    monkeypatch.setattr(uploads, "MAX_BYTES", 1000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")  # reading a longer one would be an error
    try:
        got = {r["original_filename"]: r for r in uploads.read_uploads(spark, f"file://{tmp_path}").collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got["a.pdf"]["status"] == "uploaded" and got["b.pdf"]["status"] == "failed" and got["b.pdf"]["file_hash"] is None and "maximum size" in got["b.pdf"]["error"]


def test_versions_without_files(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert versions.read_versions(spark, f"{tmp_path}/none", [versions.Column("a", "int")]).count() == 0


def test_batches_are_appended(spark, tmp_path):
    b = spark.createDataFrame([(1, True), (2, False)], "bill_id int, confirmed boolean")
    items = spark.createDataFrame([(1, "10.00", "2", "5"), (2, "1.00", "1", "0")], "bill_id int, rate string, quantity string, gst_rate string").selectExpr("bill_id", "cast(rate as decimal(14,2)) rate", "cast(quantity as decimal(12,3)) quantity", "cast(gst_rate as decimal(5,2)) gst_rate")
    asked = spark.createDataFrame([(1, 10, 20, "none"), (2, 10, 20, "none"), (3, 10, 20, "none")], "bill_id int, markup_b int, markup_c int, rounding_mode string")
    for batch in ("one", "two"):
        scenarios_, rows, results = store.scenario_batch(b, items, asked, batch)
        assert {r["bill_id"]: r["code"] for r in results.collect()} == {1: 200, 2: 409, 3: 404}
        for _ in range(2):  # added again, a batch replaces itself
            store.append(scenarios_, f"{tmp_path}/scenarios")
    got = spark.read.parquet(f"{tmp_path}/scenarios").collect()
    assert len(got) == 6 and len({r["scenario_id"] for r in got}) == 6 and all(r["disclaimer"] for r in got)
    assert sorted(r["grand_total"] for r in got if r["batch"] == "one") == [Decimal("21.00"), Decimal("23.10"), Decimal("25.20")]


def test_entry(spark):
    assert entry.entry(spark).where("disclaimer is null").count() == 0 and entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert scenarios.LABELS.keys() == {"baseline", "simulation_b", "simulation_c"}


def test_moves_follow_each_other(spark):
    items = priced_items(spark, [(1, c, n, "x", "0", "1", "1.00") for c, n in (("a", 2), ("b", 5), ("c", 9))])
    moves = spark.createDataFrame([(1, 1, "a", 1), (1, 2, "a", 1), (1, 3, "a", 1), (1, 4, "b", -1), (1, 5, "z", 1), (4, 1, "a", 1), (9, 1, "a", 1)], "bill_id long, seq int, item_id string, direction int")
    after, results = store.move_items(some_bills(spark, 5), items, moves.repartition(3))
    assert {(r["bill_id"], r["seq"]): r["code"] for r in results.collect()} == {(1, 1): 200, (1, 2): 200, (1, 3): 200, (1, 4): 200, (1, 5): 404, (4, 1): 409, (9, 1): 404}
    assert {r["id"]: r["serial_no"] for r in after.collect()} == {"b": 1, "c": 2, "a": 3}


def test_a_cascade_goes_on_after_a_failure(spark, tmp_path, monkeypatch):
    """Bills are gone and the items still there: the repetition knows whose they were."""
    held = {"documents": storage.Stored(f"{tmp_path}/d", "document_id", 3), "bills": storage.Stored(f"{tmp_path}/b", "bill_id", 3), "items": storage.Stored(f"{tmp_path}/i", "bill_id", 3)}
    held["documents"].write(spark.range(6).selectExpr("id document_id"))
    held["bills"].write(spark.range(12).selectExpr("id bill_id", "id % 6 document_id"))
    held["items"].write(spark.range(24).selectExpr("id", "id % 12 bill_id"))
    gone, replace = spark.range(2).selectExpr("id document_id"), storage.Stored.replace
    monkeypatch.setattr(storage.Stored, "replace", lambda self, *a: replace(self, *a) if self.path[-1] != "i" else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.delete_stored(held, f"{tmp_path}/log", gone, "monday")
    monkeypatch.undo()
    for _ in range(2):
        store.delete_stored(held, f"{tmp_path}/log", gone, "monday")
        assert [held[k].read(spark).count() for k in ("documents", "bills", "items")] == [4, 8, 16]


def test_sure_pages_are_not_tried_again(spark):
    rows = [("a", 0, 1, 0.8), ("a", 0, 2, 0.9), ("b", 0, 1, 0.4), ("b", 0, 2, 0.3), ("c", 0, 1, 0.4), ("c", 0, 2, 0.76), ("c", 0, 3, 0.99)]
    got = uploads.best_attempt(spark.createDataFrame(rows, "doc_id string, page int, attempt int, confidence double")).collect()
    assert {r["doc_id"]: (r["attempt"], r["attempts_used"]) for r in got} == {"a": (1, 1), "b": (1, 2), "c": (2, 2)}


def exchanges(df):
    text_of = df._jdf.queryExecution().executedPlan().toString()
    return text_of.count("Exchange hashpartitioning"), "ExistingRDD" in text_of


def test_words_are_not_moved(spark):
    """Documents and orders are dealt once, before words are made of them, and nothing that has words is written to the shared folder."""
    for name, most in (("word_cells", 1), ("line_text", 1), ("line_clusters", 1), ("candidate_items", 1), ("header_fields", 2), ("extract_bills", 5), ("invoice_headers", 2), ("invoice_items", 2), ("invoice_totals", 2), ("off_line_words", 2)):
        n, kept = exchanges(entry.queries()[name](spark, SF))
        assert n <= most and not kept, name


def test_a_stretch_higher_than_the_tolerance_is_folded_and_others_are_lines(spark):
    tops = [0, 3, 6, 40, 50, 60, 70, 120]
    words = spark.createDataFrame([("d", 0, i, f"w{i}", 90.0, 50 * i, t, 40, 20, 1, 1, 1) for i, t in enumerate(tops)], WORDS)
    assert [r["line"] for r in layout.line_clusters(words).orderBy("word_ord").collect()] == [0, 0, 0, 1, 1, 2, 2, 3]


def test_edits_and_changes_leave_no_checkpoint(spark, tmp_path):
    """Judged edits are compressed files in the shared folder, and a change of a stored table leaves none of its own there."""
    held, rows = storage.Stored(f"{tmp_path}/t", "k", 3), spark.range(10).selectExpr("id as k", "cast(id as string) as v")
    held.write(rows)
    held.replace(rows.where("k < 5"), rows.where("k < 3"), "one")
    assert {r["k"] for r in held.read(spark).collect()} == {0, 1, 2, 5, 6, 7, 8, 9}
    there = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert not [n for n in os.listdir(there) if n.startswith(("touched", "rows"))]
    items = priced_items(spark, [(1, "a", 1, "Pen", "18", "2", "10.00")])
    results = store.edit_items(some_bills(spark, 2), items, spark.createDataFrame([(1, 1, "add", None, "Nib", 3)], EDITS))[2]
    assert not exchanges(results)[1] and [r["code"] for r in results.collect()] == [200]
