"""Registered queries over whole statements as a bank prints them: runs of text at places of a page,
in each of the twelve layouts, read back to the ledger they were printed from. Ten customers make a
statement; every fifth one lists its newest rows first. Rows of some keys wrap, some with the mark of
their balance on the second line; a page break repeats the header and may part a row from its rest."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.details import statement_details
from ..functions.text import MONEY
from ..operators.columns import build_grid, column_edges, with_band
from ..operators.detection import detect_layout
from ..operators.grid import cluster_rows, tasks_for
from ..operators.layouts import FIELDS, SHIPPED, layout_fingerprint, layout_table, learned_layouts
from ..operators.parse import all_formats, parse_statements, statement_meta, with_columns, with_header
from ..sources.pages import ALL_SCANNED, SOME_SCANNED, first_page_text, page_text, scan_errors, statement_text
from ..sources.shared import Stages
from .layouts import BANKS, CODES, pick, quoted, statement_items
from .statements import BASE, double, read

# What is printed above each column, by layout, in the order of its fields.
LABELS = (
    {"date": "Date", "value_date": "Value Dt", "narration": "Narration", "ref_no": "Chq./Ref.No.", "debit": "Withdrawal Amt.", "credit": "Deposit Amt.", "balance": "Closing Balance"},
    {"date": "Txn Date", "value_date": "Value Date", "narration": "Description", "ref_no": "Ref No", "debit": "Debit", "credit": "Credit", "balance": "Balance"},
    {"date": "Transaction Date", "value_date": "Value Date", "narration": "Transaction Remarks", "ref_no": "Cheque Number", "debit": "Withdrawal Amount", "credit": "Deposit Amount", "balance": "Balance"},
    {"date": "Tran Date", "narration": "Particulars", "ref_no": "Chq No", "debit": "Debit", "credit": "Credit", "balance": "Balance"},
    {"date": "Date", "narration": "Narration", "ref_no": "Chq/Ref No", "amount": "Withdrawal(Dr)/Deposit(Cr)", "balance": "Balance"},
    {"date": "Txn Date", "narration": "Particulars", "ref_no": "Instrument ID", "amount": "Amount", "flag": "Type", "balance": "Balance"},
    {"date": "Tran Date", "narration": "Narration", "ref_no": "Chq / Ref No", "debit": "Debit", "credit": "Credit", "balance": "Balance"},
    {"date": "Txn Date", "value_date": "Value Date", "narration": "Description", "ref_no": "Cheque No", "debit": "Debit", "credit": "Credit", "balance": "Balance"},
    {"date": "Date", "narration": "Remarks", "ref_no": "Tran Id", "debit": "Withdrawals", "credit": "Deposits", "balance": "Balance"},
    {"date": "Transaction Date", "value_date": "Value Date", "narration": "Particulars", "ref_no": "Cheque No", "debit": "Debit", "credit": "Credit", "balance": "Balance"},
    {"date": "Date", "narration": "Transaction Details", "debit": "Debits", "credit": "Credits", "balance": "Balance"},
    {"date": "Date", "narration": "Particulars", "ref_no": "Chq No/Ref No", "debit": "Withdrawal", "credit": "Deposit", "balance": "Balance"},
)
# Where a field is printed: left and right end, and whether at the right one.
PLACE = {"date": (40.0, 100.0, False), "value_date": (125.0, 185.0, False), "narration": (200.0, 330.0, False), "ref_no": (350.0, 420.0, False), "debit": (440.0, 520.0, True), "credit": (540.0, 620.0, True), "amount": (440.0, 560.0, True), "flag": (590.0, 610.0, False), "balance": (640.0, 760.0, True)}
GLYPH, SIZE, TOP, LEADING, PAGE_ROWS = 4.4, 8.0, 120.0, 24.0, 30
FORMATS = tuple(dict.fromkeys(x.formats for x in SHIPPED))


def posted(spark, sf_dir) -> DataFrame:
    """The rows of all statements as they were posted: odd orders are paid, even ones received."""
    price = F.col("o_totalprice").cast(MONEY)
    rows = read(spark, sf_dir, "orders").select(F.expr("o_custkey div 10").alias("statement_id"), F.col("o_orderkey").alias("order_key"), F.col("o_orderdate").cast("date").alias("txn_date"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 2 == 1, price).alias("debit"), F.when(F.col("o_orderkey") % 2 == 0, price).alias("credit"))
    return rows.withColumn("opening", (F.col("statement_id") % 1000 + F.lit("0.25").cast(MONEY)).cast(MONEY))


def ledger(spark, sf_dir) -> DataFrame:
    """The rows that the statements print."""
    order = Window.partitionBy("statement_id").orderBy("txn_date", "order_key")
    moved = F.sum(F.coalesce("credit", F.lit(0)) - F.coalesce("debit", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    n = F.count("*").over(Window.partitionBy("statement_id"))
    return posted(spark, sf_dir).withColumn("balance", (F.col("opening") + moved).cast(MONEY)).withColumn("serial", F.row_number().over(order)).withColumn("n", n)


def by_layout(texts: list) -> Column:
    """The text of the statement's layout; null where that is none. Layouts of one text share a case."""
    own = {}
    for i, t in enumerate(texts):
        if t is not None:
            own.setdefault(t if isinstance(t, str) else id(t), (t, []))[1].append(i)
    place = F.col("statement_id") % len(SHIPPED)
    return F.coalesce(*[F.when(place.isin(places), t) for t, places in own.values()], F.lit(None).cast("string"))


def runs(texts: dict[str, Column], y: Column, page: Column) -> list[Column]:
    """What is printed in a row, a run a field; runs without a text are none."""
    return [run_of(page, PLACE[f][1] if PLACE[f][2] else PLACE[f][0], y, i, t, PLACE[f][2]) for i, (f, t) in enumerate(texts.items())]


def run_of(page: Column, end: float, y: Column, seq: int, text: Column, at_right: bool = False) -> Column:
    return F.struct(page.cast("bigint").alias("page"), F.lit(end).alias("end"), F.lit(at_right).alias("at_right"), y.cast("double").alias("y"), F.lit(seq).alias("seq"), text.alias("text"))


def printed(rows: DataFrame, made: list[Column]) -> DataFrame:
    """Texts are made before and places after the rows are taken apart: all in one step would be code that Java does not compile."""
    width = F.length("text") * GLYPH
    x = F.when(F.col("at_right"), F.col("end") - width).otherwise(F.col("end"))
    return rows.select("statement_id", F.inline(F.array(*made))).where("text is not null").select("statement_id", "page", x.alias("x"), "y", width.alias("width"), F.lit(SIZE).alias("height"), F.lit(SIZE).alias("font_size"), "seq", "text")


def printed_items(spark, sf_dir) -> DataFrame:
    """(statement_id, page, x, y, width, height, font_size, seq, text)."""
    money = lambda c: F.format_number(F.abs(c).cast("double"), 2)
    marked = lambda c: F.concat(money(c), F.when(c < 0, " Dr").otherwise(""))
    rows = ledger(spark, sf_dir)
    place = F.when(F.col("statement_id") % 5 == 0, F.col("n") + 1 - F.col("serial")).otherwise(F.col("serial"))
    rows = rows.withColumn("page", F.floor(place / PAGE_ROWS)).withColumn("slot", place % PAGE_ROWS)
    key = F.lpad(F.col("order_key").cast("string"), 9, "0")
    only = lambda f, t: by_layout([t if f in x else None for x in LABELS])
    day = {f: F.date_format("txn_date", f) for f in {x.formats[0]: None for x in SHIPPED}}
    days = by_layout([day[x.formats[0]] for x in SHIPPED])
    price, marks = money(F.coalesce("debit", "credit")), F.when(F.col("debit").isNotNull(), "(Dr)").otherwise("(Cr)")
    signed = F.concat(price, marks)
    apart = (F.col("order_key") % 7 == 0) & (F.col("balance") < 0)
    line = {"date": days, "value_date": only("value_date", days), "narration": F.concat(F.lit("order "), key, F.when(F.col("debit").isNotNull(), " out").otherwise(" in")), "ref_no": only("ref_no", F.concat(F.lit("R"), key)), "debit": only("debit", money(F.col("debit"))), "credit": only("credit", money(F.col("credit"))),
            "amount": by_layout([(signed if x.style == "signed-single" else price) if "amount" in f else None for x, f in zip(SHIPPED, LABELS, strict=True)]), "flag": only("flag", F.when(F.col("debit").isNotNull(), "DR").otherwise("CR")), "balance": F.when(apart, money(F.col("balance"))).otherwise(marked(F.col("balance")))}
    y = F.col("slot") * LEADING + TOP
    over = F.when(F.col("slot") == PAGE_ROWS - 1, 1).otherwise(0)
    rest = {"narration": F.when(F.col("order_key") % 5 == 0, F.concat(F.lit("of "), "status")), "balance": F.when(apart, F.lit("DR"))}
    texts = rows.select("statement_id", F.col("page").alias("_p"), y.alias("_y"), (F.col("page") + over).alias("_q"), F.when(over == 1, F.lit(TOP - 9)).otherwise(y + 11).alias("_z"), *(t.alias(f) for f, t in line.items()), *(t.alias(f"{f}_rest") for f, t in rest.items()))
    out = printed(texts, runs({f: F.col(f) for f in line}, F.col("_y"), F.col("_p")) + runs({f: F.col(f"{f}_rest") for f in rest}, F.col("_z"), F.col("_q")))

    sums = posted(spark, sf_dir).groupBy("statement_id").agg(F.count("*").alias("n"), F.min("opening").alias("opening"), F.min("txn_date").alias("since"), F.max("txn_date").alias("until"))
    pages = sums.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") + 1) / PAGE_ROWS))).alias("page"))
    pages = pages.select("statement_id", "page", *(by_layout([x.get(f) for x in LABELS]).alias(f) for f in FIELDS))
    labels = printed(pages, runs({f: F.col(f) for f in FIELDS}, F.lit(TOP - 20), F.col("page")))
    s = F.col("statement_id")
    code = F.concat(pick(CODES, (s % 12).cast("int")), F.lpad((s % 1000000).cast("string"), 6, "0"))
    period = F.concat(F.lit("Statement of account from "), F.date_format("since", "dd/MM/yyyy"), F.lit(" to "), F.date_format("until", "dd/MM/yyyy"))
    cover = (pick(BANKS, (s % 12).cast("int")), F.concat(F.lit("IFSC "), code), F.concat(F.lit("Account No: "), F.lpad((s * 7919 + 123456).cast("string"), 12, "0")), period)
    item = lambda page, i, y, t: run_of(page, 40.0, y, i, t)
    end = F.concat(F.lit("Total: "), F.col("n").cast("string"), F.lit(" transactions"))
    foot = item(F.floor((F.col("n") + 1) / PAGE_ROWS), 200, ((F.col("n") + 1) % PAGE_ROWS) * LEADING + TOP, end)
    forward = runs({"narration": F.lit("OPENING BALANCE B/F"), "balance": money(F.col("opening"))}, F.lit(TOP), F.lit(0))
    once = printed(sums, [*forward, *(item(F.lit(0), 100 + i, F.lit(20.0 + 15 * i), t) for i, t in enumerate(cover)), foot])
    return out.unionByName(labels).unionByName(once)


def texts_of(items: DataFrame) -> DataFrame:
    return statement_text(page_text(items))


def layouts_of(spark, texts: DataFrame) -> DataFrame:
    found = detect_layout(texts, "first_page_text").where("layout_id is not null").select("statement_id", "layout_id")
    return found.join(F.broadcast(layout_table(spark)), "layout_id")


def read_once(spark, sf_dir, stages: Stages, texts=first_page_text) -> tuple[DataFrame, DataFrame]:
    """(grid, texts) of the printed statements; the runs of text, the grid and the texts are written once. `texts` makes
    them of the items: those of the first pages, which layouts are known by, or texts_of() with the whole texts."""
    items = stages.write(printed_items(spark, sf_dir), "items")
    return stages.write(build_grid(items, formats=all_formats(FORMATS), stages=stages), "grid"), stages.write(texts(items), "texts")


def parsed(spark, sf_dir) -> DataFrame:
    grid, texts = read_once(spark, sf_dir, Stages(spark))
    return parse_statements(grid, layouts_of(spark, texts), FORMATS)


def parsed_statements(spark, sf_dir):
    rows = parsed(spark, sf_dir)
    return rows.select("statement_id", F.col("serial").cast("long").alias("serial"), "txn_date", "value_date", "narration", F.size(F.coalesce("narration_lines", F.array())).cast("long").alias("n_lines"), "ref_no", *double("debit", "credit", "balance", "opening"), "confidence", F.size("issues").cast("long").alias("n_issues"), "reversed", "opening_inferred")


def statement_facts(spark, sf_dir):
    """What each statement is about, from its text and its parse."""
    stages = Stages(spark)
    grid, texts = read_once(spark, sf_dir, stages, texts_of)
    layouts = stages.write(layouts_of(spark, texts), "layouts")
    details = texts.select("statement_id", statement_details(F.col("text")).alias("d")).select("statement_id", "d.*")
    meta = statement_meta(stages.write(parse_statements(grid, layouts, FORMATS), "rows"), layouts, details)
    return meta.select("statement_id", "bank_name", "template_id", *double("opening", "closing"), "account_masked", "period_from", "period_to", F.col("stated_count").cast("long").alias("stated_count"), F.size("notices").cast("long").alias("n_notices"))


def header_binding(spark, sf_dir):
    """The header row and the column of each field."""
    grid, texts = read_once(spark, sf_dir, Stages(spark))
    rows = grid.join(layouts_of(spark, texts), "statement_id")
    bound = with_columns(with_header(rows)).where("row_seq = header_seq")
    return bound.select("statement_id", F.col("header_seq").cast("long").alias("header_seq"), *[F.col(f"at.{f}").cast("long").alias(f"{f}_at") for f in FIELDS])


def layout_fingerprints(spark, sf_dir):
    grid, texts = read_once(spark, sf_dir, Stages(spark))
    return layout_fingerprint(grid, texts.select("statement_id", F.col("first_page_text").alias("text")))


def learned_store(spark, prints: DataFrame) -> DataFrame:
    """The header labels of every bank but each third, under the fingerprint of the bank's first statement."""
    kept = [(i, x.bank, list(x.formats), x.style, LABELS[i]) for i, x in enumerate(SHIPPED) if i % 3]
    store = spark.createDataFrame(kept, "place int, bank string, formats array<string>, style string, columns map<string,string>")
    first = prints.groupBy((F.col("statement_id") % len(SHIPPED)).cast("int").alias("place")).agg(F.min_by("fingerprint", "statement_id").alias("key"))
    return store.join(first, "place")


def learned_parse(spark, sf_dir):
    """Statements parsed by layouts that are looked up by fingerprint in a store of header labels."""
    stages = Stages(spark)
    grid, texts = read_once(spark, sf_dir, stages)
    prints = stages.write(layout_fingerprint(grid, texts.select("statement_id", F.col("first_page_text").alias("text"))), "prints")
    layouts = prints.join(learned_layouts(learned_store(spark, prints)), F.col("fingerprint") == F.col("key")).drop("fingerprint", "key")
    rows = parse_statements(grid, layouts, FORMATS)
    return rows.groupBy("statement_id").agg(F.count("*").alias("n_rows"), F.sum("debit").cast("double").alias("total_debit"), F.sum("credit").cast("double").alias("total_credit"), F.max_by("balance", "serial").cast("double").alias("closing"))


def grid_edges(spark, sf_dir):
    """Left edges of the columns of each statement, over all its pages."""
    pages = ["statement_id", "page"]
    tasks = tasks_for(spark, 4 * read(spark, sf_dir, "orders").count())
    placed = with_band(cluster_rows(statement_items(spark, sf_dir, tasks), pages, tasks=tasks), [*pages, "row_no"])
    edges = column_edges(placed, "statement_id", pages, tasks=tasks)
    return edges.select("statement_id", F.array_join(F.transform("edges", lambda e: F.round(e).cast("int").cast("string")), ",").alias("edges"))


def page_texts(spark, sf_dir):
    return page_text(statement_items(spark, sf_dir)).select("statement_id", "page", F.md5("text").alias("text_md5"))


def scan_check(spark, sf_dir):
    """Pages with images of a scan's, a logo's and an unknown size; short pages with the first are scans."""
    items = statement_items(spark, sf_dir)
    pages = items.select("statement_id", "page").distinct()
    s = F.col("statement_id")
    side = lambda scan: F.when(s % 7 == 0, F.lit(None).cast("int")).when(s % 3 == 0, scan).otherwise(120)
    images = pages.where("statement_id % 3 <> 1").select("statement_id", "page", side(600).alias("width"), side(850).alias("height"))
    out = scan_errors(pages, items, images)
    return out.select("statement_id", F.array_join(F.transform("scanned_pages", lambda p: p.cast("string")), ",").alias("scanned"), "error_code", F.length("error_message").cast("long").alias("message_length"))


QUERIES = {f.__name__: f for f in (parsed_statements, statement_facts, header_binding, layout_fingerprints, learned_parse, grid_edges, page_texts, scan_check)}

_has = lambda f: "statement_id % 12 IN (" + ", ".join(str(i) for i, x in enumerate(LABELS) if f in x) + ")"
PRINTED = """b AS (SELECT o_custkey // 10 AS statement_id, o_orderkey AS order_key, CAST(o_orderdate AS DATE) AS txn_date, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS a, o_orderkey % 2 = 1 AS paid, CAST(o_custkey // 10 % 1000 + 0.25 AS DECIMAL(18,2)) AS opening FROM orders),
l AS (SELECT *, row_number() OVER w AS serial, opening + sum(CASE WHEN paid THEN -a ELSE a END) OVER w AS balance FROM b WINDOW w AS (PARTITION BY statement_id ORDER BY txn_date, order_key ROWS UNBOUNDED PRECEDING))"""
_signature = lambda x: ":".join((str(len(x)), "|".join(sorted({" ".join(re.findall("[a-z]+", v.lower())) for v in x.values()}))))
_bound = ", ".join("(" + ", ".join([str(i), *[str(list(x).index(f)) if f in x else "NULL" for f in FIELDS]]) + ")" for i, x in enumerate(LABELS))
ORACLE = {
    "parsed_statements": f"""WITH {PRINTED}, n AS (SELECT statement_id, min(txn_date) < max(txn_date) AS moves FROM l GROUP BY 1)
SELECT statement_id, serial, txn_date, CASE WHEN {_has('value_date')} THEN txn_date END AS value_date, 'order ' || lpad(CAST(order_key AS VARCHAR), 9, '0') || CASE WHEN paid THEN ' out' ELSE ' in' END || CASE WHEN order_key % 5 = 0 THEN ' of ' || status ELSE '' END AS narration,
 CASE WHEN order_key % 5 = 0 THEN 2 ELSE 1 END AS n_lines, CASE WHEN {_has('ref_no')} THEN 'R' || lpad(CAST(order_key AS VARCHAR), 9, '0') END AS ref_no, CAST(CASE WHEN paid THEN a END AS DOUBLE) AS debit, CAST(CASE WHEN NOT paid THEN a END AS DOUBLE) AS credit,
 CAST(balance AS DOUBLE) AS balance, CAST(opening AS DOUBLE) AS opening, 'high' AS confidence, CAST(0 AS BIGINT) AS n_issues, statement_id % 5 = 0 AND moves AS reversed, false AS opening_inferred FROM l JOIN n USING (statement_id)""",
    "statement_facts": f"""WITH {PRINTED} SELECT statement_id, {quoted(BANKS)}[statement_id % 12 + 1] AS bank_name, {quoted([x.id for x in SHIPPED])}[statement_id % 12 + 1] AS template_id, CAST(min(opening) AS DOUBLE) AS opening, CAST(arg_max(balance, serial) AS DOUBLE) AS closing,
 'XXXXXXXX' || right(lpad(CAST(statement_id * 7919 + 123456 AS VARCHAR), 12, '0'), 4) AS account_masked, min(txn_date) AS period_from, max(txn_date) AS period_to, count(*) AS stated_count, CAST(statement_id % 5 = 0 AND min(txn_date) < max(txn_date) AS BIGINT) AS n_notices FROM l GROUP BY statement_id""",
    "header_binding": f"""WITH p(k, {', '.join(f'{f}_at' for f in FIELDS)}) AS (VALUES {_bound}), s AS (SELECT DISTINCT o_custkey // 10 AS statement_id FROM orders)
SELECT statement_id, CAST(4 AS BIGINT) AS header_seq, {', '.join(f'CAST({f}_at AS BIGINT) AS {f}_at' for f in FIELDS)} FROM s JOIN p ON statement_id % 12 = k""",
    "layout_fingerprints": f"""WITH s AS (SELECT DISTINCT o_custkey // 10 AS statement_id FROM orders)
SELECT statement_id, left(sha256(left({quoted(CODES)}[statement_id % 12 + 1], 4) || ':' || {quoted([_signature(x) for x in LABELS])}[statement_id % 12 + 1]), 32) AS fingerprint FROM s""",
    "learned_parse": f"""WITH {PRINTED} SELECT statement_id, count(*) AS n_rows, CAST(sum(CASE WHEN paid THEN a END) AS DOUBLE) AS total_debit, CAST(sum(CASE WHEN NOT paid THEN a END) AS DOUBLE) AS total_credit, CAST(arg_max(balance, serial) AS DOUBLE) AS closing
FROM l WHERE statement_id % 12 % 3 <> 0 GROUP BY statement_id""",
    "page_texts": f"""WITH {BASE} SELECT statement_id, (serial - 1) // 40 AS page, md5(string_agg(strftime(txn_date, '%d/%m/%Y') || CASE WHEN debit IS NULL THEN ' Paid|in' ELSE ' Drawn' END || ' order ' || order_key || ' ' || regexp_replace(regexp_replace(CAST(coalesce(debit, credit) AS VARCHAR), '0+$', ''), '\\.$', ''), chr(10) ORDER BY serial)) AS text_md5 FROM l GROUP BY ALL""",
    "scan_check": f"""WITH n AS (SELECT o_custkey AS i, count(*) AS n, (count(*) - 1) // 40 AS last FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
c AS (SELECT *, n - 40 * last < 5 AND (i % 3 = 0 OR i % 3 = 2 AND i % 7 = 0) AS bad FROM n)
SELECT i AS statement_id, CASE WHEN bad THEN CAST(last AS VARCHAR) ELSE '' END AS scanned, CASE WHEN bad THEN 'SCANNED_PDF_UNSUPPORTED' END AS error_code, CASE WHEN bad THEN CASE WHEN last = 0 THEN {len(ALL_SCANNED)} ELSE length('Page ' || last || ' ' || '{SOME_SCANNED}') END END AS message_length FROM c""",
    "grid_edges": """SELECT o_custkey AS statement_id, CASE WHEN count(*) = 1 THEN '40' WHEN count(*) < 5 THEN '40,118,154,298' ELSE '40,90,150,195' END AS edges FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
}
