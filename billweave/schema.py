"""Table schemas, enumerations and fixed labels."""

from pyspark.sql import types as T

MONEY, QUANTITY, PERCENT, MARKUP, SHARE = (T.DecimalType(14, 2), T.DecimalType(12, 3), T.DecimalType(5, 2), T.DecimalType(6, 2), T.DecimalType(5, 4))
#: Amounts in flight: sums of many lines need more digits than a stored amount.
WIDE = "decimal(18,2)"

DOCUMENT_STATUS = ("uploaded", "processing", "processed", "failed", "archived")
EXTRACTION_STATUS = ("pending", "needs_review", "completed", "failed")
RUN_STATUS = ("running", "completed", "failed")
SCENARIO_TYPES = ("baseline", "simulation_b", "simulation_c")
ROUNDING_MODES = ("none", "nearest_1", "nearest_5", "nearest_10")
COLUMN_TYPES = ("serial", "description", "hsn", "gst", "qty", "unit", "rate", "rate_incl", "amount")
NUMERIC_COLUMNS = ("gst", "qty", "rate", "rate_incl", "amount")

DISCLAIMER = "SIMULATED / INTERNAL ESTIMATE — NOT A VENDOR QUOTATION"
BASELINE_NOTE = "Baseline from the uploaded document"


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], len(f) < 3) for f in fields])


_S, _I, _B, _TS, _D = T.StringType(), T.IntegerType(), T.BooleanType(), T.TimestampNTZType(), T.DoubleType()

WORDS = _struct(
    ("doc_id", _S, "key"), ("page", _I, "key"), ("word_ord", _I, "key"), ("text", _S), ("confidence", _D), ("left", _I), ("top", _I), ("width", _I), ("height", _I),
    ("line_num", _I), ("block_num", _I), ("par_num", _I),
)
DOCUMENTS = _struct(
    ("id", _S, "key"), ("original_filename", _S), ("stored_filename", _S), ("mime_type", _S), ("file_size", T.LongType()), ("file_hash", _S), ("uploaded_at", _TS), ("status", _S)
)
BILLS = _struct(
    ("id", _S, "key"), ("document_id", _S), ("vendor_name", _S), ("vendor_address", _S), ("vendor_gstin", _S), ("vendor_phone", _S), ("vendor_email", _S), ("invoice_number", _S),
    ("invoice_date", T.DateType()), ("buyer_name", _S), ("buyer_address", _S), ("currency", _S), ("subtotal", MONEY), ("tax_total", MONEY), ("grand_total", MONEY),
    ("extraction_status", _S), ("confirmed", _B), ("created_at", _TS), ("updated_at", _TS),
)
BILL_ITEMS = _struct(
    ("id", _S, "key"), ("bill_id", _S), ("serial_no", _I), ("description", _S), ("hsn_sac", _S), ("gst_rate", PERCENT), ("quantity", QUANTITY), ("unit", _S), ("source_rate", MONEY),
    ("taxable_rate", MONEY), ("line_amount", MONEY), ("tax_amount", MONEY), ("total_amount", MONEY), ("confidence", SHARE), ("user_verified", _B),
)
SCENARIOS = _struct(
    ("id", _S, "key"), ("bill_id", _S), ("scenario_type", _S), ("label", _S), ("markup_percent", MARKUP), ("rounding_mode", _S), ("subtotal", MONEY), ("tax_total", MONEY),
    ("grand_total", MONEY), ("disclaimer", _S, "required"), ("created_at", _TS),
)
SCENARIO_ITEMS = _struct(
    ("id", _S, "key"), ("scenario_id", _S), ("source_item_id", _S), ("serial_no", _I), ("description", _S), ("quantity", QUANTITY), ("unit", _S), ("baseline_rate", MONEY),
    ("markup_percent", MARKUP), ("adjusted_rate", MONEY), ("line_amount", MONEY), ("tax_amount", MONEY), ("total_amount", MONEY),
)
PROCESSING_RUNS = _struct(
    ("id", _S, "key"), ("document_id", _S), ("processor", _S), ("processor_version", _S), ("status", _S), ("started_at", _TS), ("completed_at", _TS), ("error_message", _S), ("attempts_used", _I)
)
GENERATED_FILES = _struct(("id", _S, "key"), ("scenario_id", _S), ("file_type", _S), ("filename", _S), ("storage_path", _S), ("file_hash", _S), ("generated_at", _TS))
