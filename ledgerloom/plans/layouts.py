"""Registered queries: pages, grids, banks and the choice of a parse, derived from orders, customers and suppliers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.cells import cell_amount, cell_date, row_kind, signed_balance
from ..functions.text import MONEY, import_line, plain_amount
from ..operators.audit import audit_rows, report
from ..operators.detection import LAYOUTS, available_banks, choose_parse, detect_layout
from ..operators.grid import grid_cells, grid_markdown
from .statements import AUDIT, BASE, read, statements

BANKS = [bank for _, bank, _ in LAYOUTS]
# What the pages made here print: a code of each layout's bank, and phrases of some headers.
CODES = ("HDFC0", "SBIN0", "ICIC0", "UTIB0", "KKBK0", "PUNB0", "BARB0", "CNRB0", "UBIN0", "IDFB0", "IDIB0", "INDB0")
PHRASES = ("Withdrawal Amt", "Tran Date", "Particulars", "Chq / Ref No", "Transaction  Remarks")
EDGES, PAGE_ROWS = (40.0, 120.0, 300.0), 40


def pick(names, at):
    return F.element_at(F.array(*map(F.lit, names)), at + 1)


def template_detection(spark, sf_dir):
    k = F.col("c_custkey")
    bank = F.when(k % 4 == 1, F.upper(pick(BANKS, (k % 12).cast("int")))).when(k % 4 == 2, "").otherwise(pick(BANKS, (k % 12).cast("int")))
    code = F.concat(pick(CODES, F.when(k % 3 == 0, (k + 5) % 12).otherwise(k % 12).cast("int")), F.lpad((k % 1000000).cast("string"), 6, "0"))
    text = F.concat(bank, F.lit("\nStatement of "), F.col("c_name"), F.lit("\nIFSC "), code, F.lit(" "), pick(PHRASES, (k % 5).cast("int")))
    hint = F.when(k % 17 == 0, pick([i for i, _, _ in LAYOUTS], ((k + 1) % 12).cast("int")))
    return detect_layout(read(spark, sf_dir, "customer").select("c_custkey", text.alias("page"), hint.alias("hint")), "page", "hint").select("c_custkey", "layout_id", "confidence")


def banks_on_offer(spark, sf_dir):
    k = F.col("s_suppkey")
    name = F.when(k % 7 == 0, F.upper(pick(BANKS, (k % 12).cast("int")))).when(k % 2 == 0, F.concat(F.lit("  Bank of "), F.col("n_name"))).otherwise(F.concat(F.lit("BANK of "), F.col("n_name"), F.lit(" ")))
    learned = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return available_banks(learned.select(F.col("s_suppkey").alias("key"), name.alias("bank"), (k % 100).alias("learned_at")))


def fallback_chain(spark, sf_dir):
    """Tiers of a statement by its id; a parse reconciles if the statement does, but tier 3 of every fifth."""
    proof = report(audit_rows(statements(spark, sf_dir))).select("statement_id", (F.col("n_errors") == 0).alias("good"))
    s = F.col("statement_id")
    tiers = F.filter(F.array(F.when(s % 7 == 0, 1), F.when(s % 3 != 0, 2), F.when(s % 2 == 0, 3), F.when(s % 11 == 0, 4)), lambda t: t.isNotNull())
    tried = proof.select("statement_id", "good", F.explode(tiers).alias("tier"))
    return choose_parse(tried.select("statement_id", F.col("tier").cast("long").alias("tier"), (F.col("good") & ((F.col("tier") != 3) | (s % 5 != 0))).alias("ok"), (s % 4 != 0).alias("may_ask")), "may_ask", proof.select("statement_id", (s % 4 != 0).alias("may_ask")))


def statement_items(spark, sf_dir, tasks=None):
    """Runs of text as a page of a statement would print them: a day, a remark of two runs, an amount;
    the baselines of a row are up to 1.2 apart. `tasks` is that of statements()."""
    rows = statements(spark, sf_dir, tasks)
    place = F.col("serial") - 1
    y = (place % PAGE_ROWS) * 12.0 + 30
    amount = plain_amount(F.coalesce("debit", "credit"))
    runs = [(40.0, 0.0, 50.0, F.date_format("txn_date", "dd/MM/yyyy")), (120.0, 0.6, 30.0, F.when(F.col("debit").isNull(), "Paid|in").otherwise("Drawn")), (155.0, -0.6, 40.0, F.concat(F.lit("order "), F.col("order_key").cast("string"))), (299.0, 0.3, 50.0, amount)]
    items = F.array(*[F.struct(F.lit(x).alias("x"), (y + dy).alias("y"), F.lit(w).alias("width"), F.lit(8.0).alias("height"), F.lit(8.0).alias("font_size"), F.lit(i).alias("seq"), t.alias("text")) for i, (x, dy, w, t) in enumerate(runs)])
    return rows.select("statement_id", F.floor(place / PAGE_ROWS).alias("page"), F.inline(items))


def statement_grid(spark, sf_dir):
    edges = F.array(*map(F.lit, EDGES))
    return grid_cells(statement_items(spark, sf_dir), ["statement_id", "page"], edges, len(EDGES))


def grid_rows(spark, sf_dir):
    return statement_grid(spark, sf_dir).select("statement_id", "page", F.col("row_no").cast("long").alias("row_no"), F.round("y", 3).alias("y"), *[F.col("cells")[i].alias(f"cell_{i}") for i in range(len(EDGES))])


def grid_tables(spark, sf_dir):
    """The sample of a grid that a mapping is inferred from: its first 45 rows, over all pages."""
    return grid_markdown(statement_grid(spark, sf_dir), "statement_id", len(EDGES), 45, order=("page", "row_no"))


def ledger_import(spark, sf_dir):
    rows = statements(spark, sf_dir)
    remark = F.concat(F.lit('order "'), F.col("order_key").cast("string"), F.lit('"\nof '), F.col("statement_id").cast("string"))
    party = F.when(F.col("order_key") % 3 == 0, F.concat(F.lit(" P"), F.col("statement_id").cast("string"))).when(F.col("order_key") % 3 == 1, " ")
    return rows.select("order_key", import_line(F.lit("HDFC "), F.col("txn_date"), F.col("debit"), F.col("credit"), remark, party).alias("line"))


def statement_summary(spark, sf_dir):
    """The workbook's summary sheet, one row per label."""
    out = report(audit_rows(statements(spark, sf_dir)))
    money = [F.struct(F.lit(label).alias("label"), F.col(name).cast(MONEY).cast("string").alias("value")) for label, name in (("Opening balance", "opening"), ("Closing balance", "closing"), ("Total debits", "total_debit"), ("Total credits", "total_credit"))]
    count = F.struct(F.lit("Transactions").alias("label"), F.col("n_rows").cast("string").alias("value"))
    sound = F.struct(F.lit("Reconciles").alias("label"), F.when(F.abs("footer_delta") <= 0.01, "Yes").otherwise("No — review before use").alias("value"))
    return out.select("statement_id", F.inline(F.array(*money, count, sound)))


def cell_readers(spark, sf_dir):
    """Cells with a neighbour's text run into them."""
    form, price = F.col("o_orderkey") % 4, F.format_number(F.col("o_totalprice").cast(MONEY).cast("double"), 2)
    shown = F.when(form == 0, F.concat(price, F.lit(" MUM"))).when(form == 1, F.concat(price, F.lit(" Dr"))).when(form == 2, F.concat(F.lit("MUM "), price, F.lit(" CREDIT"))).otherwise(F.concat(F.lit("Ref "), price, F.lit("\u00a0 Dr.")))
    day = F.concat(F.lit("Ref 88 "), F.date_format("o_orderdate", "dd MMM yyyy"), F.lit(" x"))
    out = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), cell_date(day).alias("txn_date"), cell_amount(shown).alias("a"))
    return out.select("order_key", "txn_date", signed_balance(F.col("a")).cast("double").alias("amount"), F.col("a.marker").alias("marker"))


def row_kinds(spark, sf_dir):
    """Rows of a grid of five columns, one per order, of every kind."""
    day, price = F.date_format("o_orderdate", "dd/MM/yyyy"), F.format_number(F.col("o_totalprice").cast(MONEY).cast("double"), 2)
    forms = [(day, "Paid", price, "", price), ("", "to clerk", "", "", ""), ("10:42 PM", "", "", "", ""), ("Date", "Narration", "Debit", "Credit", "Balance"), ("10:42", "", "", "", " Dr. "), ("", "", " ", "", None), ("Page 3 of 9", "x", "", "", ""), ("", "", "", "12345678901234567890123", "")]
    made = F.coalesce(*[F.when(F.col("o_orderkey") % 8 == i, F.array(*[c if isinstance(c, Column) else F.lit(c).cast("string") for c in cells])) for i, cells in enumerate(forms)])
    header = F.array(*map(F.lit, ("date ", "NARRATION", "Debit", "Credit", "Balance")))
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), made.alias("cells"))
    return rows.select("order_key", row_kind(F.col("cells"), 0, [2, 3, 4], [1], header).alias("kind"))


QUERIES = {f.__name__: f for f in (template_detection, banks_on_offer, fallback_chain, grid_rows, grid_tables, ledger_import, statement_summary, cell_readers, row_kinds)}


def quoted(names) -> str:
    return "[" + ", ".join("'" + n + "'" for n in names) + "]"


_markers = ", ".join(f"({place}, '{i}', '{p}', CAST({w} AS DECIMAL(4,2)))" for place, (i, _, ms) in enumerate(LAYOUTS) for p, w in ms)
_amount = "regexp_replace(regexp_replace(CAST({0} AS VARCHAR), '0+$', ''), '\\.$', '')"
_cells = f"""g AS (SELECT statement_id, (serial - 1) // {PAGE_ROWS} AS page, (serial - 1) % {PAGE_ROWS} AS row_no, strftime(txn_date, '%d/%m/%Y') AS cell_0,
 CASE WHEN debit IS NULL THEN 'Paid|in' ELSE 'Drawn' END || ' order ' || order_key AS cell_1, {_amount.format('coalesce(debit, credit)')} AS cell_2 FROM l)"""
ORACLE = {
    "cell_readers": """SELECT o_orderkey AS order_key, CAST(o_orderdate AS DATE) AS txn_date, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) * CASE WHEN o_orderkey % 2 = 1 THEN -1 ELSE 1 END AS amount,
 CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 2 THEN 'Cr' ELSE 'Dr' END AS marker FROM orders""",
    "row_kinds": "SELECT o_orderkey AS order_key, ['T', 'C', 'S', 'H', 'C', 'B', 'S', 'T'][o_orderkey % 8 + 1] AS kind FROM orders",
    "template_detection": f"""WITH m(place, layout_id, pattern, weight) AS (VALUES {_markers}),
p AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN upper({quoted(BANKS)}[c_custkey % 12 + 1]) WHEN c_custkey % 4 = 2 THEN '' ELSE {quoted(BANKS)}[c_custkey % 12 + 1] END || chr(10) || 'Statement of ' || c_name || chr(10) || 'IFSC '
 || {quoted(CODES)}[CASE WHEN c_custkey % 3 = 0 THEN (c_custkey + 5) % 12 ELSE c_custkey % 12 END + 1] || lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0') || ' ' || {quoted(PHRASES)}[c_custkey % 5 + 1] AS page,
 CASE WHEN c_custkey % 17 = 0 THEN {quoted([i for i, _, _ in LAYOUTS])}[(c_custkey + 1) % 12 + 1] END AS hint FROM customer),
s AS (SELECT c_custkey, hint, place, layout_id, least(1, sum(CASE WHEN regexp_matches(page, pattern) THEN weight ELSE 0 END)) AS score FROM p, m GROUP BY ALL),
r AS (SELECT *, CASE WHEN hint = layout_id THEN greatest(score, 0.7) ELSE score END AS points, row_number() OVER (PARTITION BY c_custkey ORDER BY coalesce(hint = layout_id, false) DESC, score DESC, place) AS nr FROM s)
SELECT c_custkey, CASE WHEN points >= 0.7 THEN layout_id END AS layout_id, CAST(CASE WHEN points >= 0.7 THEN points END AS DOUBLE) AS confidence FROM r WHERE nr = 1""",
    "banks_on_offer": f"""WITH k(id, bank) AS (VALUES {", ".join(f"('{i}', '{b}')" for i, b, _ in LAYOUTS)}),
n AS (SELECT s_suppkey AS key, s_suppkey % 100 AS learned_at, CASE WHEN s_suppkey % 7 = 0 THEN upper({quoted(BANKS)}[s_suppkey % 12 + 1]) WHEN s_suppkey % 2 = 0 THEN '  Bank of ' || n_name ELSE 'BANK of ' || n_name || ' ' END AS bank FROM supplier JOIN nation ON s_nationkey = n_nationkey),
f AS (SELECT *, lower(trim(bank)) AS norm, row_number() OVER (PARTITION BY lower(trim(bank)) ORDER BY learned_at DESC, key DESC) AS nr FROM n)
SELECT id, bank, lower(bank) AS norm FROM k UNION ALL SELECT 'learned:' || key, bank, norm FROM f WHERE nr = 1 AND norm NOT IN (SELECT lower(bank) FROM k)""",
    "fallback_chain": f"""WITH {BASE}, {AUDIT.format('l')}, g AS (SELECT statement_id AS i, NOT bool_or(wrong) AS good FROM s GROUP BY 1),
c AS (SELECT i, good, i % 4 <> 0 AS ask, CASE WHEN i % 7 = 0 AND good THEN 1 WHEN i % 3 <> 0 AND (good OR i % 4 = 0) THEN 2 WHEN i % 2 = 0 AND good AND i % 5 <> 0 THEN 3 WHEN i % 11 = 0 AND i % 4 <> 0 THEN 4 END AS tier FROM g)
SELECT i AS statement_id, CAST(tier AS BIGINT) AS tier, coalesce(tier IN (1, 3), false) AS used, i % 2 = 0 AND NOT (good AND i % 5 <> 0) AND coalesce(tier >= 3, true) AS evicted,
 CASE WHEN tier IS NULL THEN CASE WHEN ask THEN 'LLM_UNAVAILABLE' WHEN i % 3 <> 0 THEN 'PARSE_FAILED' ELSE 'UNSUPPORTED_LAYOUT' END END AS error_code FROM c""",
    "grid_rows": f"WITH {BASE}, {_cells} SELECT statement_id, page, row_no, CAST(row_no * 12 + 30.15 AS DOUBLE) AS y, cell_0, cell_1, cell_2 FROM g",
    "grid_tables": f"""WITH {BASE}, {_cells} SELECT statement_id, '| col0 | col1 | col2 |' || chr(10) || '| --- | --- | --- |' || chr(10)
 || string_agg('| ' || cell_0 || ' | ' || replace(cell_1, '|', '\\|') || ' | ' || cell_2 || ' |', chr(10) ORDER BY page, row_no) AS markdown FROM g WHERE page * {PAGE_ROWS} + row_no < 45 GROUP BY statement_id""",
    "ledger_import": f"""WITH {BASE} SELECT order_key, '"HDFC","' || CASE WHEN order_key % 3 = 0 THEN 'P' || statement_id ELSE 'SUSP' END || '","' || strftime(txn_date, '%d-%m-%Y') || '","' || coalesce({_amount.format('debit')}, '') || '","' || coalesce({_amount.format('credit')}, '')
 || '","order ""' || order_key || '""' || chr(10) || 'of ' || statement_id || '"' AS line FROM l""",
    "statement_summary": f"""WITH {BASE}, r AS (SELECT statement_id, min(opening) AS o, CAST(arg_max(balance, serial) AS DECIMAL(18,2)) AS c, CAST(sum(coalesce(debit, 0)) AS DECIMAL(18,2)) AS d, CAST(sum(coalesce(credit, 0)) AS DECIMAL(18,2)) AS e, count(*) AS n FROM l GROUP BY 1)
SELECT statement_id, 'Opening balance' AS label, CAST(o AS VARCHAR) AS value FROM r UNION ALL SELECT statement_id, 'Closing balance', CAST(c AS VARCHAR) FROM r UNION ALL SELECT statement_id, 'Total debits', CAST(d AS VARCHAR) FROM r
UNION ALL SELECT statement_id, 'Total credits', CAST(e AS VARCHAR) FROM r UNION ALL SELECT statement_id, 'Transactions', CAST(n AS VARCHAR) FROM r UNION ALL SELECT statement_id, 'Reconciles', CASE WHEN abs(o + e - d - c) <= 0.01 THEN 'Yes' ELSE 'No — review before use' END FROM r""",
}
