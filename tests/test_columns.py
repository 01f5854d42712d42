"""Decimal and text columns on golden values, and against independent Python models."""

from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from billweave.functions import money, text
from billweave.operators import bills, scenarios
from billweave.schema import DISCLAIMER
from billweave.sources import uploads


def values(spark, column, inputs, schema="x string"):
    """A column over inputs, in their order."""
    rows = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(inputs)], f"i int, {schema}")
    return [r[0] for r in rows.select(column.alias("v"), "i").orderBy("i").collect()]


def test_money(spark):
    inputs = ["10.005", "10.004", "240", "-0.125", "116.525"]
    assert values(spark, money.to_money(F.col("x").cast("decimal(20,6)")), inputs) == [Decimal(v) for v in ("10.01", "10.00", "240.00", "-0.13", "116.53")]
    assert values(spark, money.to_money(F.col("x")), [0.1 + 0.2], "x double") == [Decimal("0.30")]


def test_nearest(spark):
    cases = [("87.49", "none", "87.49"), ("87.49", "nearest_1", "87.00"), ("87.50", "nearest_1", "88.00"), ("62.4", "nearest_5", "60.00"), ("62.5", "nearest_5", "65.00"), ("314.99", "nearest_10", "310.00"), ("315", "nearest_10", "320.00")]
    got = values(spark, money.round_to_nearest(F.col("x").cast("decimal(18,2)"), F.col("m")), [c[:2] for c in cases], "x string, m string")
    assert got == [Decimal(c[2]) for c in cases]
    with pytest.raises(Exception, match="unknown rounding mode"):
        values(spark, money.round_to_nearest(F.col("x").cast("decimal(18,2)"), F.lit("bogus")), ["1"])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 10**6), st.integers(0, 10**7), st.integers(0, 9999)), min_size=1, max_size=60))
def test_lines_like_decimal(spark, rows):
    d = spark.createDataFrame([(i, Decimal(q) / 1000, Decimal(r) / 100, Decimal(g) / 100) for i, (q, r, g) in enumerate(rows)], "i int, quantity decimal(12,3), rate decimal(14,2), gst_rate decimal(5,2)")
    cent = lambda v: v.quantize(Decimal("0.01"), ROUND_HALF_UP)
    for got, (q, r, g) in zip(bills.with_amounts(d).orderBy("i").collect(), rows):
        line = cent(Decimal(q) / 1000 * Decimal(r) / 100)
        tax = cent(line * Decimal(g) / 10000)
        assert (got["line_amount"], got["tax_amount"], got["total_amount"]) == (line, tax, line + tax)


def test_loose_numbers(spark):
    cases = {"1O7.5O": "107.50", "63 . 20": "63.20", "₹3,45,678": "345678", "9 NOS.": "9", "B5 Pad": "5", "(as agreed)": None, "": None, "Rs. 18.25": "18.25", "-7": "-7"}
    got = values(spark, text.parse_decimal(F.col("x")), list(cases))
    assert got == [None if v is None else Decimal(v) for v in cases.values()]
    assert values(spark, text.parse_int(F.col("x")), ["7.9", "-7.9", "x"]) == [7, -7, None]


def test_descriptions(spark):
    cases = [
        ("3. Copper Kettle No. 7", 3, "Copper Kettle No. 7"), ("12) Lathe Tool LT-9", 12, "Lathe Tool LT-9"), ("5 - B2 Card Board 300 MM", 5, "B2 Card Board 300 MM"), ("6 Wide Ribbon 12 MM", 6, "Wide Ribbon 12 MM"),
        ("3 Foot Door Rail", 1, "3 Foot Door Rail"), ("90 MM Drill Bit", 2, "90 MM Drill Bit"), (" ", 1, ""), ("Chalk S/-", 0, "Chalk 5/-"),
    ]
    assert values(spark, text.clean_description(F.col("x"), F.col("n")), [c[:2] for c in cases], "x string, n int") == [c[2] for c in cases]


def test_headings(spark):
    cases = {"Product Price": "description", "Cost Price": "rate", "Total (incl. taxes)": "rate_incl", "VAT": "gst", "!": None, "SAC Code": "hsn", "Sr": "serial", "Quantity": "qty", "UOM": "unit", "Gross": "amount", "abc": None}
    assert values(spark, text.header_type(text.phrase(F.col("x"))), list(cases)) == list(cases.values())


def test_dates_and_fields(spark):
    cases = {"9-Nov-24": "2024-11-09", "Dated 17-Feb-25": "2025-02-17", "Date: 17/02/2025": "2025-02-17", "03/15/2025": "2025-03-15", "30/02/2025 9 Nov 2024": "2024-11-09", "30/02/2025": None, "soon": None}
    assert [v and str(v) for v in values(spark, text.date_in(F.col("x")), list(cases))] == list(cases.values())
    assert values(spark, text.gstin(F.col("x")), ["GSTIN: 33QWLPM8642R1Z2", "GSTIN-19bzdtr3150h1zc", "x"]) == ["33QWLPM8642R1Z2", "19BZDTR3150H1ZC", None]
    assert values(spark, text.phone(F.col("x")), ["Mob: +91 8876054321", "1234567890"]) == ["8876054321", None]
    assert values(spark, text.invoice_number(F.col("x")), ["Bill No: QX/19/0042", "Ref # -73-"]) == ["QX/19/0042", "73"]


def test_units_names_and_display(spark):
    assert values(spark, text.normalize_unit(F.col("x")), ["pcs.", "Kgs", "Bundle", "12", None]) == ["PCS", "KG", "BUNDLE", None, None]
    assert values(spark, text.file_name(F.col("x")), [" a b/c?.pdf", "??"]) == ["a_bc.pdf", "file"]
    assert values(spark, text.lakh_text(F.col("x").cast("decimal(18,2)")), ["7654321", "-888.5", "200000"]) == ["76,54,321.00", "-888.50", "2,00,000.00"]


def test_tiers_noise_and_uploads(spark):
    assert values(spark, text.confidence_tier(F.col("x")), [0.9, 0.75, 0.7499], "x double") == ["high", "medium", "low"]
    assert values(spark, text.low_confidence(F.round("x", 4)), [0.74996, 0.7, None], "x double") == [False, True, True]
    assert values(spark, text.is_noise(F.col("x"), F.col("c")), [("|", 99.0), ("--", 10.0), ("--", 30.0), ("a-", 10.0), ("--", -1.0)], "x string, c double") == [True, True, False, False, False]
    got = values(spark, uploads.upload_error(F.col("x"), F.col("m"), F.col("n")), [("a.PDF", "application/pdf", 5), ("a.exe", "application/pdf", 5), ("a.png", None, 5), ("a.png", "image/png", 0), ("a.png", "image/png", 10**9)], "x string, m string, n long")
    assert got[0] is None and [g.split()[0] for g in got[1:]] == ["Unsupported", "Unsupported", "Uploaded", "File"]


def test_scenarios(spark):
    item = spark.createDataFrame([(1, 1, Decimal("1.000"), Decimal("310.00"), Decimal("12.00"))], "bill_id int, serial_no int, quantity decimal(12,3), rate decimal(14,2), gst_rate decimal(5,2)")
    got = {r["scenario_type"]: r for r in scenarios.totals(scenarios.items(item, scenarios.config(spark, "10", "20", "nearest_10"))).collect()}
    assert [(got[k]["subtotal"], got[k]["tax_total"], got[k]["grand_total"]) for k in ("baseline", "simulation_b", "simulation_c")] == [
        (Decimal("310.00"), Decimal("37.20"), Decimal("347.20")), (Decimal("341.00"), Decimal("40.92"), Decimal("380.00")), (Decimal("372.00"), Decimal("44.64"), Decimal("420.00")),
    ]
    assert got["simulation_b"]["disclaimer"] == got["simulation_c"]["disclaimer"] == DISCLAIMER
    assert "simulation_b" not in {r["scenario_type"] for r in scenarios.items(item, scenarios.config(spark, "-5", "20", "none")).collect()}
    assert values(spark, bills.markup_error(F.col("x")), [-5.0, 0.0], "x double") == [bills.MARKUP_INVALID, None]
