"""Queries of the text and layout operators over documents, parts and line items, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import money, text
from ..operators import fields, layout, tables
from ..operators import bills as bill_ops
from .inputs import CHAR, WORDS_SQL, table, words

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _bare_sql(x: str) -> str:
    return f"regexp_replace(trim(regexp_replace({x}, {_quoted(text.CURRENCY)}, '', 'g')), {_quoted(text.SPLIT_DECIMAL)}, '\\1.\\2', 'g')"


def _fixed_sql(x: str) -> str:
    bare = _bare_sql(f"trim({x})")
    n, d = f"length(regexp_replace({bare}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))", f"length(regexp_replace({bare}, '[^\\p{{Nd}}]', '', 'g'))"
    return f"CASE WHEN trim({x}) = '' THEN {x} WHEN {n} > 0 AND {d} * 100 >= {n} * 35 THEN translate({bare}, '{text.DIGIT_LIKE}', '{text.DIGITS}') ELSE {bare} END"


def _number_sql(x: str) -> str:
    plain, mended = f"regexp_extract({_bare_sql(x)}, '{text.NUMBER}')", f"regexp_extract({_fixed_sql(x)}, '{text.NUMBER}')"
    return f"TRY_CAST(nullif(replace(CASE WHEN length({mended}) > length({plain}) THEN {mended} ELSE {plain} END, ',', ''), '') AS DECIMAL(24,6))"


_CELLS = """noisy AS (SELECT l_orderkey AS bill_id, l_linenumber AS serial_no, CASE l_orderkey % 6
    WHEN 0 THEN 'Rs. ' || format('{:,.2f}', l_extendedprice) WHEN 1 THEN replace(CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS VARCHAR), '0', 'O') WHEN 2 THEN replace(CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS VARCHAR), '.', ' . ')
    WHEN 3 THEN CAST(l_quantity::INTEGER AS VARCHAR) || ' PCS.' WHEN 4 THEN l_returnflag || '4 Paper' ELSE '(in words)' END AS cell FROM lineitem)"""


def _noisy_cells(spark, sf_dir):
    """Prices and quantities as a recogniser might have read them."""
    d, k = table(spark, sf_dir, "lineitem"), F.col("l_orderkey") % 6
    price = F.col("l_extendedprice").cast("decimal(14,2)").cast("string")
    cell = (
        F.when(k == 0, F.concat(F.lit("Rs. "), F.format_number("l_extendedprice", 2)))
        .when(k == 1, F.replace(price, F.lit("0"), F.lit("O")))
        .when(k == 2, F.replace(price, F.lit("."), F.lit(" . ")))
        .when(k == 3, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" PCS.")))
        .when(k == 4, F.concat("l_returnflag", F.lit("4 Paper")))
        .otherwise("(in words)")
    )
    return d.select(F.col("l_orderkey").alias("bill_id"), F.col("l_linenumber").alias("serial_no"), cell.alias("cell"))


@query(f"WITH {_CELLS} SELECT bill_id, serial_no, {_number_sql('cell')} AS value FROM noisy")
def parse_numbers(spark, sf_dir):
    return _noisy_cells(spark, sf_dir).select("bill_id", "serial_no", text.parse_decimal(F.col("cell")).alias("value"))


@query(f"WITH {_CELLS} SELECT cell, {_fixed_sql('cell')} AS fixed, trunc({_number_sql('cell')})::BIGINT::VARCHAR AS whole, count(*) AS n FROM noisy GROUP BY ALL")
def fix_ocr_digits(spark, sf_dir):
    d = _noisy_cells(spark, sf_dir).groupBy("cell").agg(F.count("*").alias("n"))
    return d.select("cell", text.fix_digits(F.col("cell")).alias("fixed"), text.parse_int(F.col("cell")).cast("string").alias("whole"), "n")


_UNIT_CASES = " ".join(f"WHEN u IN ({', '.join(_quoted(n) for n in names)}) THEN '{unit}'" for unit, names in text.UNITS.items())


@query(
    f"""SELECT raw, CASE WHEN u = '' THEN NULL {_UNIT_CASES} ELSE left(u, 20) END AS unit FROM (
        SELECT raw, upper(regexp_replace(raw, '[^A-Za-z]', '', 'g')) AS u FROM (
            SELECT DISTINCT CASE p_size % 5 WHEN 0 THEN 'Pcs.' WHEN 1 THEN 'kgs' WHEN 2 THEN p_type WHEN 3 THEN p_size || ' Boxes' ELSE '12' END AS raw FROM part))"""
)
def normalize_units(spark, sf_dir):
    k = F.col("p_size") % 5
    raw = F.when(k == 0, "Pcs.").when(k == 1, "kgs").when(k == 2, F.col("p_type")).when(k == 3, F.concat(F.col("p_size").cast("string"), F.lit(" Boxes"))).otherwise("12")
    return table(spark, sf_dir, "part").select(raw.alias("raw")).distinct().select("raw", text.normalize_unit(F.col("raw")).alias("unit"))


def _cleaned_sql(x: str, serial: str) -> str:
    lead = _quoted(text.LEADING_NOISE)
    out = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), {lead}, ''), {_quoted(text.NOISY_SERIAL)}, ''), {_quoted(text.MARKED_SERIAL)}, '')"
    for front in ("^[a-zA-Z]{1,3}\\s+", "^"):
        out = f"CASE WHEN {serial} > 0 THEN regexp_replace({out}, '{front}' || {serial} || '\\s+', '') ELSE {out} END"
    out = f"regexp_replace({out}, {lead}, '')"
    out = f"regexp_replace(regexp_replace({out}, '[''`]?S\\s*\\/\\-', '5/-', 'g'), '(?i)\\bFldid\\s*Pen\\b', 'Fluid Pen', 'g')"
    return f"regexp_replace({out}, '^\\s+|\\s+$', '', 'g')"


@query(
    f"""SELECT part_id, {_cleaned_sql('raw', 'serial')} AS cleaned FROM (
        SELECT p_partkey AS part_id, p_size AS serial, CASE p_partkey % 6 WHEN 0 THEN p_size || '. ' WHEN 1 THEN '| i ' || p_size || ') ' WHEN 2 THEN p_size || ' ' WHEN 3 THEN 'ie ' || p_size || ' ' WHEN 4 THEN '2 - ' ELSE '' END
            || p_name || CASE WHEN p_partkey % 4 = 0 THEN ' S/-' ELSE '' END AS raw FROM part)"""
)
def clean_descriptions(spark, sf_dir):
    k, size = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    front = F.when(k == 0, F.concat(size, F.lit(". "))).when(k == 1, F.concat(F.lit("| i "), size, F.lit(") "))).when(k == 2, F.concat(size, F.lit(" ")))
    front = front.when(k == 3, F.concat(F.lit("ie "), size, F.lit(" "))).when(k == 4, "2 - ").otherwise("")
    raw = F.concat(front, F.col("p_name"), F.when(F.col("p_partkey") % 4 == 0, " S/-").otherwise(""))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), text.clean_description(raw, F.col("p_size")).alias("cleaned"))


@query("SELECT page_id, coalesce(nullif(replace(trim(regexp_replace(url, '[^\\p{L}\\p{N}\\-_. ]', '', 'g')), ' ', '_'), ''), 'file') AS filename FROM pages")
def sanitize_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.file_name(F.col("url")).alias("filename"))


@query(
    """SELECT c_custkey, 'Rs. ' || format('{:,.2f}', c_acctbal) AS shown,
        CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || CASE WHEN abs(c_acctbal) * 1000 >= 100000 THEN (abs(c_acctbal) * 1000)::BIGINT // 100000 || ',' || lpad((((abs(c_acctbal) * 1000)::BIGINT // 1000) % 100)::VARCHAR, 2, '0')
            WHEN (abs(c_acctbal) * 1000)::BIGINT >= 1000 THEN ((abs(c_acctbal) * 1000)::BIGINT // 1000)::VARCHAR END || ',' || lpad(((abs(c_acctbal) * 1000)::BIGINT % 1000)::VARCHAR, 3, '0') || '.00' AS grouped
        FROM (SELECT c_custkey, CASE WHEN abs(c_acctbal) < 1 THEN c_acctbal + 1000 ELSE c_acctbal END AS c_acctbal FROM customer)"""
)
def money_display(spark, sf_dir):
    """Account balances, and a thousand times as much with digits grouped by lakh."""
    balance = F.when(F.abs("c_acctbal") < 1, F.col("c_acctbal") + 1000).otherwise(F.col("c_acctbal"))  # the SQL can't print less
    d = table(spark, sf_dir, "customer").select("c_custkey", balance.alias("c_acctbal"))
    return d.select("c_custkey", text.money_text(F.col("c_acctbal")).alias("shown"), text.lakh_text(F.round(F.col("c_acctbal").cast("decimal(14,2)") * 1000, 0)).alias("grouped"))


@query(
    f"""SELECT doc_id, nullif(regexp_extract(coalesce(text, ''), {_quoted(text.EMAIL)}), '') AS email, nullif(regexp_extract(coalesce(text, ''), {_quoted(text.PHONE)}, 2), '') AS phone,
        nullif(regexp_extract(upper(coalesce(text, '')), {_quoted(text.GSTIN)}), '') AS gstin,
        regexp_replace(nullif(regexp_extract(coalesce(text, ''), {_quoted(text.INVOICE_NUMBER)}, 1), ''), '^[ :\\-]+|[ :\\-]+$', '', 'g') AS invoice_no FROM documents"""
)
def extract_fields(spark, sf_dir):
    t = F.coalesce(F.col("text"), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", text.email(t).alias("email"), text.phone(t).alias("phone"), text.gstin(t).alias("gstin"), text.invoice_number(t).alias("invoice_no"))


@query(
    f"""WITH shown AS (SELECT o_orderkey AS bill_id, CASE o_orderkey % 4 WHEN 0 THEN 'Date: ' || strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN 'on ' || strftime(o_orderdate, '%m-%d-%y') WHEN 2 THEN 'Dated ' || strftime(o_orderdate, '%d-%b-%Y') ELSE '31/02/2026 2 May 2026' END AS s FROM orders),
        parts AS (SELECT bill_id, s, TRY_CAST(nullif(regexp_extract(s, {_quoted(text.DATE)}, 1), '') AS INTEGER) AS a, TRY_CAST(nullif(regexp_extract(s, {_quoted(text.DATE)}, 2), '') AS INTEGER) AS b, TRY_CAST(nullif(regexp_extract(s, {_quoted(text.DATE)}, 3), '') AS INTEGER) AS y,
            regexp_extract(s, {_quoted(text.DATE_MONTH)}, 1) || '/' || regexp_extract(s, {_quoted(text.DATE_MONTH)}, 2)[:3] || '/' || regexp_extract(s, {_quoted(text.DATE_MONTH)}, 3) AS named FROM shown),
        full_year AS (SELECT *, CASE WHEN y < 100 THEN y + 2000 ELSE y END AS yy FROM parts)
        SELECT bill_id, coalesce(try_strptime(a || '/' || b || '/' || yy, '%d/%m/%Y'), try_strptime(b || '/' || a || '/' || yy, '%d/%m/%Y'), try_strptime(named, '%d/%b/%Y'))::DATE::VARCHAR AS invoice_date FROM full_year"""
)
def extract_dates(spark, sf_dir):
    """Order dates as bills print them: day first, month first with a short year, with the month's name, or impossible."""
    k, at = F.col("o_orderkey") % 4, F.col("o_orderdate")
    shown = (
        F.when(k == 0, F.concat(F.lit("Date: "), F.date_format(at, "dd/MM/yyyy")))
        .when(k == 1, F.concat(F.lit("on "), F.date_format(at, "MM-dd-yy")))
        .when(k == 2, F.concat(F.lit("Dated "), F.date_format(at, "dd-MMM-yyyy")))
        .otherwise("31/02/2026 2 May 2026")
    )
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bill_id"), text.date_in(shown).cast("string").alias("invoice_date"))


def _heading_sql(kind: str, parts: tuple, whole: tuple) -> str:
    tests = [f"contains(norm, '{p}')" for p in parts] + ([f"norm IN ({', '.join(map(_quoted, whole))})"] if whole else [])
    return f"WHEN {' OR '.join(tests)} THEN '{kind}'"


_TYPE_SQL = f"CASE WHEN norm = '' THEN NULL {' '.join(_heading_sql(*h) for h in text.HEADINGS)} END"


@query(
    f"""WITH {WORDS_SQL}, phrases AS (SELECT text, regexp_replace(lower(text), '[^a-z0-9%]', '', 'g') AS norm, count(*) AS n FROM words GROUP BY text)
        SELECT col_type, count(*) AS n_texts, sum(n)::BIGINT AS n_words, min(norm) AS first_text FROM (SELECT *, {_TYPE_SQL} AS col_type FROM phrases) GROUP BY col_type"""
)
def classify_headers(spark, sf_dir):
    """What the words of all documents would name as table headings."""
    d = words(spark, sf_dir).groupBy("text").agg(F.count("*").alias("n")).withColumn("norm", text.phrase(F.col("text")))
    d = d.withColumn("col_type", text.header_type(F.col("norm")))
    return d.groupBy("col_type").agg(F.count("*").alias("n_texts"), F.sum("n").alias("n_words"), F.min("norm").alias("first_text"))


@query(
    f"""WITH {WORDS_SQL}, typed AS (SELECT doc_id, line, {_TYPE_SQL} AS col_type FROM (SELECT doc_id, line, regexp_replace(lower(text), '[^a-z0-9%]', '', 'g') AS norm FROM words)),
        scores AS (SELECT doc_id, line, count(DISTINCT col_type) AS score FROM typed GROUP BY ALL)
        SELECT doc_id, score, line AS header_line FROM scores WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line) = 1"""
)
def header_score(spark, sf_dir):
    """Each document's line with the most column types, the first of equals; where the words stand doesn't matter to the number."""
    typed = words(spark, sf_dir).withColumn("type", text.header_type(text.phrase(F.col("text")))).where("type is not null")
    lines = typed.groupBy("doc_id", "line_num").agg(F.collect_list(F.struct(F.lit(0.0).alias("x"), "type")).alias("info"))
    scores = lines.select("doc_id", "line_num", F.size(tables.named_columns(F.col("info"))).cast("long").alias("score"))
    best = scores.groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("line_num")).alias("up"))).alias("b"))
    return best.select("doc_id", F.col("b.score").alias("score"), (-F.col("b.up")).alias("header_line"))


@query(
    f"""WITH {WORDS_SQL}, columns(pos, col_type, x) AS (VALUES (1, 'serial', 60.0), (2, 'description', 700.0), (3, 'qty', 2000.0), (4, 'rate', 3000.0), (5, 'amount', 4000.0)),
        near AS (SELECT doc_id, line, i, text, col_type FROM words, columns QUALIFY row_number() OVER (PARTITION BY doc_id, line, i ORDER BY abs(words.x + width / 2.0 - columns.x), pos) = 1),
        named AS (SELECT doc_id, CASE WHEN col_type = 'serial' AND regexp_matches(text, '\\p{{L}}') THEN 'description' ELSE col_type END AS col_type FROM near)
        SELECT doc_id, col_type, count(*) AS n FROM named GROUP BY ALL"""
)
def nearest_column(spark, sf_dir):
    """Words by the nearest of five fixed columns; lettered ones of the serial column are descriptions."""
    fixed = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(x).alias("x")) for t, x in (("serial", 60.0), ("description", 700.0), ("qty", 2000.0), ("rate", 3000.0), ("amount", 4000.0))])
    cell = F.array(F.struct("text", "confidence", (F.col("left") + F.col("width") / 2).alias("center_x")))
    d = words(spark, sf_dir).select("doc_id", tables.assigned(cell, fixed)[0]["type"].alias("col_type"))
    return d.groupBy("doc_id", "col_type").agg(F.count("*").alias("n"))


_STOP_SQL = f"(regexp_matches(line_text, {_quoted(text.STOP)}) OR " + " OR ".join(f"contains(regexp_replace(lower(line_text), '[^a-z]', '', 'g'), '{w}')" for w in text.STOP_SQUASHED) + ")"


@query(f"WITH {WORDS_SQL}, stops AS (SELECT doc_id, (min(line) FILTER ({_STOP_SQL}))::VARCHAR AS stop_line, count(*) AS n_lines FROM text_lines WHERE line_text <> '' GROUP BY doc_id) SELECT doc_id, stop_line, n_lines FROM stops")
def stop_rows(spark, sf_dir):
    """The first line of each document at which a table would end."""
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "t")).where("t <> ''")
    return t.groupBy("doc_id").agg(F.min(F.when(text.is_stop(F.col("t")), F.col("line"))).cast("string").alias("stop_line"), F.count("*").alias("n_lines"))


@query(
    """WITH o AS (SELECT l_orderkey AS bill_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row, l_returnflag = 'R' AS numeric, l_partkey FROM lineitem),
        g AS (SELECT *, sum(CASE WHEN numeric OR row = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY bill_id ORDER BY row ROWS UNBOUNDED PRECEDING) AS item FROM o)
        SELECT bill_id, item::BIGINT AS item, string_agg(l_partkey::VARCHAR, ' ' ORDER BY row) AS description FROM g GROUP BY ALL"""
)
def continuation_merge(spark, sf_dir):
    """Rows without a number join the item before them; the first row of a bill always starts one."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    d = table(spark, sf_dir, "lineitem").withColumn("line", F.row_number().over(w))
    # a line of each bill: a name in the first column, and in some a quantity in the second
    page, name = [F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page")], F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    cell = lambda t, x: F.struct(t.alias("text"), F.lit(90.0).alias("confidence"), F.lit(x).alias("center_x"))
    more = F.when(F.col("l_returnflag") == "R", F.array(cell(F.lit("1"), 900.0))).otherwise(F.array().cast("array<struct<text:string,confidence:double,center_x:double>>"))
    lines = d.select(*page, "line", name.alias("text"), F.concat(F.array(cell(name, 100.0)), more).alias("cells"))
    column = lambda t, x: F.struct(F.lit(t).alias("type"), F.lit(x).alias("x"))
    header = d.select(*page).distinct().select("doc_id", "page", F.lit(0).alias("header_line"), F.array(column("description", 100.0), column("qty", 900.0)).alias("columns"))
    rows = tables.headed_rows(lines, header)
    return rows.select(F.col("doc_id").alias("bill_id"), "item", F.replace("description", F.lit("P"), F.lit("")).alias("description"))


_RATE_INPUT = """printed AS (SELECT l_orderkey AS bill_id, l_linenumber AS serial_no, l_quantity::INTEGER AS q, (l_extendedprice * 100)::BIGINT AS cents, (l_tax * 100)::INTEGER AS g, l_orderkey % 5 AS k FROM lineitem)"""


@query(
    f"""WITH {_RATE_INPUT}, half AS (SELECT *,
        (CASE k WHEN 1 THEN (2 * cents * (100 + g) + 100) // 200 WHEN 3 THEN (2 * cents + q) // (2 * q) ELSE cents END)::BIGINT AS source_cents,
        (CASE k WHEN 2 THEN (2 * cents * 100 + 100 + g) // (2 * (100 + g)) WHEN 3 THEN (2 * cents + q) // (2 * q) WHEN 0 THEN cents - 100 ELSE cents END)::BIGINT AS taxable_cents FROM printed)
        SELECT bill_id, serial_no, (source_cents::HUGEINT * CAST(0.01 AS DECIMAL(3,2)))::DECIMAL(14,2) AS source_rate, (taxable_cents::HUGEINT * CAST(0.01 AS DECIMAL(3,2)))::DECIMAL(14,2) AS taxable_rate, k IN (1, 2, 3) AS ambiguous FROM half"""
)
def rate_resolution(spark, sf_dir):
    """Rates with and without tax from what a bill may print: both, one of them, or only an amount."""
    d, k = table(spark, sf_dir, "lineitem"), F.col("l_orderkey") % 5
    price = F.col("l_extendedprice").cast("decimal(24,6)")
    d = d.select(
        F.col("l_orderkey").alias("bill_id"),
        F.col("l_linenumber").alias("serial_no"),
        F.when(k == 0, price - 1).when(k == 1, price).alias("excl"),
        F.when((k == 0) | (k == 2), price).alias("incl"),
        F.when(k > 2, price).alias("amount"),
        F.when(k == 3, F.col("l_quantity").cast("decimal(24,6)")).alias("quantity"),
        F.when(k < 3, (F.col("l_tax") * 100).cast("decimal(24,6)")).alias("gst_rate"),
    )
    two = lambda c: F.round(c, 2).cast("decimal(14,2)").alias(c)
    return tables.resolved_rates(d).select("bill_id", "serial_no", two("source_rate"), two("taxable_rate"), "ambiguous")


@query(f"WITH {WORDS_SQL} SELECT doc_id, count(*) AS n_words, count(*) FILTER (NOT regexp_matches(text, {_quoted(text.NOISE)}) AND (i % 9 <> 0 OR regexp_matches(text, '[A-Za-z0-9]'))) AS n_kept FROM words GROUP BY doc_id")
def noise_words(spark, sf_dir):
    """Words left when border marks go, and every ninth word is unsure."""
    d = words(spark, sf_dir).withColumn("confidence", F.when(F.col("word_ord") % 100_000 % 9 == 0, 10.0).otherwise(92.0))
    return d.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.sum((~text.is_noise(F.col("text"), F.col("confidence"))).cast("long")).alias("n_kept"))


_ISLANDS = f"""{WORDS_SQL}, gaps AS (SELECT *, x - lag(x + width) OVER (PARTITION BY doc_id, line ORDER BY x) AS gap FROM words),
    islands AS (SELECT *, sum(CASE WHEN gap > 1.8 * {CHAR} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, line ORDER BY x ROWS UNBOUNDED PRECEDING) AS cell FROM gaps)"""


@query(f"WITH {_ISLANDS} SELECT doc_id, line::INTEGER AS line, cell::INTEGER AS cell, string_agg(text, ' ' ORDER BY x) AS text, min(x)::INTEGER AS \"left\", max(x + width)::INTEGER AS \"right\" FROM islands GROUP BY ALL")
def word_cells(spark, sf_dir):
    """Cells of all lines, lines as the text has them."""
    d = words(spark, sf_dir, dealt=True).withColumn("line", F.col("line_num")).withColumn("y", F.col("top").cast("double"))
    return layout.cells(layout.word_cells(d)).select("doc_id", "line", "cell", "text", "left", "right")


@query(f"WITH {WORDS_SQL}, one AS (SELECT doc_id, line, string_agg(text, ' ' ORDER BY i) AS t FROM words GROUP BY ALL) SELECT doc_id, string_agg(t, chr(10) ORDER BY line) AS full_text FROM one GROUP BY doc_id")
def line_text(spark, sf_dir):
    return layout.full_text(words(spark, sf_dir, dealt=True)).select("doc_id", "full_text")


@query(f"WITH {WORDS_SQL}, ranked AS (SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS line, width FROM words) SELECT doc_id, line::INTEGER AS line, count(*) AS n_words, sum(width)::BIGINT AS ink FROM ranked GROUP BY ALL")
def line_clusters(spark, sf_dir):
    """Words clustered to lines by height alone; on this pitch that must give the text's own lines."""
    return layout.line_clusters(words(spark, sf_dir, dealt=True)).groupBy("doc_id", "line").agg(F.count("*").alias("n_words"), F.sum("width").alias("ink"))


@query(
    f"""WITH {WORDS_SQL}, heights AS (SELECT doc_id, list_sort(list(length(text))) AS h FROM words GROUP BY doc_id)
        SELECT doc_id, h[len(h) // 2 + 1]::INTEGER AS upper_median FROM heights"""
)
def upper_median(spark, sf_dir):
    h = F.array_sort(F.collect_list(F.length("text")))
    return words(spark, sf_dir).groupBy("doc_id").agg(layout.upper_median(h).alias("upper_median"))


@query()
def candidate_items(spark, sf_dir):
    """Item rows that the table parser finds in all documents."""
    return tables.candidate_items(layout.lines(words(spark, sf_dir, dealt=True)))


_MARGIN = "'^[ :.\\-]+|[ :.\\-]+$', '', 'g'"


def _phone_sql(x: str) -> str:
    return f"(regexp_matches({x}, {_quoted(text.PHONE)}) AND length(regexp_replace(replace({x}, regexp_extract({x}, {_quoted(text.PHONE)}), ''), {_MARGIN})) < 10)"


def _is_sql(x: str, *patterns: str) -> str:
    return "(" + " OR ".join(f"coalesce(regexp_matches({x}, {_quoted(p)}), false)" for p in patterns) + f" OR coalesce(regexp_matches(upper({x}), {_quoted(text.GSTIN)}), false) OR coalesce({_phone_sql(x)}, false))"


def _name_sql(x: str) -> str:
    return f"CASE WHEN length({x}) >= 3 AND NOT {_is_sql(x, text.NOT_ADDRESS, text.DATE)} THEN {x} END"


def _part_sql(pattern: str, group: int) -> str:
    return f"nullif(regexp_extract(t, {_quoted(pattern)}, {group}), '')"


def _day_sql(year: str, month: str, day: str) -> str:
    return f"TRY_CAST(lpad((CASE WHEN {year} < 100 THEN {year} + 2000 ELSE {year} END)::VARCHAR, 4, '0') || '-' || lpad({month}::VARCHAR, 2, '0') || '-' || lpad({day}::VARCHAR, 2, '0') AS DATE)"


@query(
    f"""WITH {WORDS_SQL}, kept AS (SELECT * FROM words WHERE NOT regexp_matches(text, {_quoted(text.NOISE)})),
    gaps AS (SELECT *, x - lag(x + width) OVER (PARTITION BY doc_id, line ORDER BY x) AS gap FROM kept),
    islands AS (SELECT *, sum(CASE WHEN gap > 1.8 * {CHAR} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, line ORDER BY x ROWS UNBOUNDED PRECEDING) AS cell_no FROM gaps),
    printed AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS line, string_agg(text, ' ' ORDER BY x) AS t, string_agg(text, ' ' ORDER BY x) FILTER (cell_no = 0) AS cell FROM islands GROUP BY doc_id, line),
    named AS (SELECT *, min(CASE WHEN line < 8 AND length(cell) >= 3 AND NOT {_is_sql("cell", text.BOILERPLATE, text.DATE, text.EMAIL)} THEN line END) OVER (PARTITION BY doc_id) AS name_line FROM printed),
    vendors AS (SELECT *, max(CASE WHEN line = name_line THEN cell END) OVER (PARTITION BY doc_id) AS vendor FROM named),
    begun AS (SELECT *, min(CASE WHEN cell = vendor THEN line END) OVER (PARTITION BY doc_id) + 1 AS begins FROM vendors),
    ended AS (SELECT *, line BETWEEN begins AND begins + 2 AS inside, min(CASE WHEN line BETWEEN begins AND begins + 2 AND (cell = '' OR {_is_sql("cell", text.NOT_ADDRESS, text.EMAIL)}) THEN line END) OVER (PARTITION BY doc_id) AS ends FROM begun),
    labelled AS (
        SELECT *, regexp_matches(t, {_quoted(text.BUYER_LABEL)}) AS for_buyer, regexp_replace(regexp_replace(t, {_quoted("(?s)^.*?" + text.BUYER_LABEL)}, ''), {_MARGIN}) AS own, lead(cell) OVER w AS ahead, lead(cell, 2) OVER w AS ahead2,
            {_part_sql(text.DATE, 1)}::INTEGER AS a, {_part_sql(text.DATE, 2)}::INTEGER AS b, {_part_sql(text.DATE, 3)}::INTEGER AS y, {_part_sql(text.DATE_MONTH, 1)}::INTEGER AS d,
            nullif(list_position({list(text.MONTHS)}, lower(left({_part_sql(text.DATE_MONTH, 2)}, 3))), 0) AS m, {_part_sql(text.DATE_MONTH, 3)}::INTEGER AS y2
        FROM ended WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
    dated AS (SELECT *, coalesce({_day_sql("y", "b", "a")}, {_day_sql("y", "a", "b")}, {_day_sql("y2", "m", "d")}) AS day, coalesce({_name_sql("own")}, {_name_sql("ahead")}, {_name_sql("ahead2")}) AS buyer FROM labelled),
    whole AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY line) AS t FROM printed GROUP BY doc_id),
    found AS (
        SELECT doc_id, any_value(vendor) AS vendor_name, nullif(string_agg(cell, ', ' ORDER BY line) FILTER (inside AND (ends IS NULL OR line < ends)), '') AS vendor_address,
            coalesce(arg_min(day, line) FILTER (regexp_matches(t, {_quoted(text.DATE_LABEL)})), arg_min(day, line))::VARCHAR AS invoice_date, (list(buyer ORDER BY line) FILTER (for_buyer))[1] AS buyer_name FROM dated GROUP BY doc_id)
    SELECT found.*, nullif(regexp_extract(upper(t), {_quoted(text.GSTIN)}), '') AS vendor_gstin, {_part_sql(text.PHONE, 2)} AS vendor_phone, {_part_sql(text.EMAIL, 0)} AS vendor_email,
        regexp_replace({_part_sql(text.INVOICE_NUMBER, 1)}, '^[ :\\-]+|[ :\\-]+$', '', 'g') AS invoice_number FROM found JOIN whole USING (doc_id)"""
)
def header_fields(spark, sf_dir):
    """What the rules of a bill's head find on every document, taken as a printed page."""
    w = words(spark, sf_dir, dealt=True)
    return fields.header_fields(layout.lines(w), layout.without_noise(w)).withColumn("invoice_date", F.col("invoice_date").cast("string"))


@query()
def extract_bills(spark, sf_dir):
    """The whole extraction over all documents, their words taken as digital."""
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"))
    return bill_ops.extract(documents, words(spark, sf_dir, dealt=True))[0]
