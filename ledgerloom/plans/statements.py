"""Registered queries: the ledger operators over statements derived from orders and customers. One
statement is one customer's orders; each order at a multiple of 97 shows a balance that is 100 off."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import MONEY, csv_cell, format_inr, mask_account, plain_amount, read_amount, read_date
from ..operators.audit import audit_rows, report
from ..operators.ledger import apply_edits, balances, merge_wrapped, movement_flag, movement_separate, movement_signed, reorder_newest_first
from ..streaming.limiter import limit_hits


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def statements(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """The rows of all statements, dealt to `tasks` tasks, if given."""
    orders, customers = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    price = F.col("o_totalprice").cast(MONEY)
    rows = orders.join(customers.select("c_custkey", F.col("c_acctbal").cast(MONEY).alias("opening")), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(F.col("c_custkey").alias("statement_id"), "opening", F.col("o_orderkey").alias("order_key"), F.col("o_orderdate").cast("date").alias("txn_date"), F.when(F.col("o_orderstatus") != "F", price).alias("debit"), F.when(F.col("o_orderstatus") == "F", price).alias("credit"))
    rows = rows.repartition(tasks, "statement_id") if tasks else rows
    order = Window.partitionBy("statement_id").orderBy("txn_date", "order_key")
    so_far = F.sum(F.coalesce("credit", F.lit(0)) - F.coalesce("debit", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("serial", F.row_number().over(order)).withColumn("balance", (F.col("opening") + so_far + F.when(F.col("order_key") % 97 == 0, 100).otherwise(0)).cast(MONEY))


def double(*names: str) -> list:
    return [F.col(n).cast("double").alias(n) for n in names]


def running_balance_audit(spark, sf_dir):
    out = audit_rows(statements(spark, sf_dir))
    return out.select("statement_id", F.col("serial").cast("long").alias("serial"), *double("balance", "expected", "delta"), "status")


def validation_report(spark, sf_dir):
    """Every tenth statement states one row more than it has."""
    s = F.col("statement_id")
    stated = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("statement_id")).agg(F.count("*").alias("n")).select(s, (F.col("n") + F.when(s % 10 == 0, 1).otherwise(0)).alias("stated_count"))
    out = report(audit_rows(statements(spark, sf_dir)), stated)
    return out.select("statement_id", "n_rows", *double("total_debit", "total_credit", "closing", "footer_delta"), "n_errors", "n_warnings", "offending", "complete", "ok")


def date_monotonicity(spark, sf_dir):
    order = Window.partitionBy("statement_id").orderBy(F.col("order_key") % 89, "order_key")
    rows = statements(spark, sf_dir).withColumn("serial", F.row_number().over(order))
    return audit_rows(rows).select("statement_id", F.col("serial").cast("long").alias("serial"), "date_warning")


def opening_and_closing(spark, sf_dir):
    return balances(statements(spark, sf_dir)).select("statement_id", *double("opening", "closing"))


def newest_first_reorder(spark, sf_dir):
    rows = statements(spark, sf_dir)
    n = F.count("*").over(Window.partitionBy("statement_id"))
    given = rows.withColumn("serial", F.when(F.col("statement_id") % 2 == 0, n + 1 - F.col("serial")).otherwise(F.col("serial")))
    return reorder_newest_first(given).select("statement_id", "order_key", F.col("serial").cast("long").alias("serial"), "reversed")


def movements(spark, sf_dir):
    rows = statements(spark, sf_dir)
    amount, debit = F.coalesce("debit", "credit"), F.col("debit").isNotNull()
    text = F.format_number(amount.cast("double"), 2)
    separate = movement_separate(F.when(debit, text).otherwise("0.00"), F.when(debit, "-").otherwise(text))
    signed = movement_signed(F.concat(F.when(debit, "(").otherwise(""), text, F.when(debit, ")").otherwise(" CR")))
    flagged = movement_flag(F.concat(F.lit("Rs. "), text), F.when(F.col("order_key") % 11 == 0, "").when(debit, "Dr.").otherwise("CREDIT"))
    out = rows.select("order_key", separate.alias("s"), signed.alias("g"), flagged.alias("f"))
    return out.select("order_key", *[F.col(f"{s}.{c}").cast("double").alias(f"{n}_{c}") for s, n in (("s", "separate"), ("g", "signed"), ("f", "flag")) for c in ("debit", "credit")], F.col("f.issue").isNotNull().alias("flag_issue"))


AMOUNT_FORMS = ("{0}", "₹ {0}", "{0} Dr", "({0})", "{0}-", "INR{0}Cr.", "{0} (DR)")


def parse_amount_roundtrip(spark, sf_dir):
    value = F.col("o_totalprice").cast(MONEY)
    text, form = F.format_number(value.cast("double"), 2), F.col("o_orderkey") % len(AMOUNT_FORMS)
    shown = F.coalesce(*[F.when(form == i, F.concat(*[x for p in (F.lit(t.split("{0}")[0]), text, F.lit(t.split("{0}")[1])) for x in [p]])) for i, t in enumerate(AMOUNT_FORMS)])
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), read_amount(shown).cast("double").alias("amount"))


DATE_FORMS = ("dd/MM/yyyy", "dd-MM-yyyy", "d.M.yyyy", "dd MMM yyyy", "dd-MMM-yyyy", "MMM dd, yyyy", "yyyy-MM-dd", "dd/MM/yy")


def parse_date_roundtrip(spark, sf_dir):
    day, form = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % len(DATE_FORMS)
    shown = F.coalesce(*[F.when(form == i, F.date_format(day, f)) for i, f in enumerate(DATE_FORMS)])
    shown = F.when(F.col("o_orderkey") % 3 == 0, F.concat(shown, F.lit(" 10:42:07 PM"))).otherwise(shown)
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), read_date(shown).alias("txn_date"))


def exports(spark, sf_dir):
    rows = statements(spark, sf_dir)
    line = F.concat_ws(",", F.col("serial").cast("string"), F.date_format("txn_date", "dd/MM/yyyy"), csv_cell(F.coalesce(F.col("debit").cast("string"), F.lit(""))), csv_cell(F.coalesce(F.col("credit").cast("string"), F.lit(""))), csv_cell(F.col("balance").cast("string")))
    return rows.select("order_key", format_inr(F.col("balance")).alias("inr"), plain_amount(F.col("balance")).alias("plain"), mask_account(F.concat(F.lit("ACCT"), F.lpad(F.col("statement_id").cast("string"), 9, "0"))).alias("account"), line.alias("csv_line"))


def wrapped_merge(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("statement_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("row_seq", "text"))
    kind = F.when(F.col("row_seq") % 5 == 0, "T").when(F.col("row_seq") % 5 == 3, "H").otherwise("C")
    out = merge_wrapped(lines.withColumn("kind", kind))
    return out.select("statement_id", F.col("row_seq").cast("long").alias("row_seq"), "kind", F.col("n_lines").cast("long").alias("n_lines"), F.md5("text").alias("text_md5"))


def edited_ledger(spark, sf_dir):
    rows = statements(spark, sf_dir)
    edits = rows.where("order_key % 13 = 0").select("statement_id", "serial", F.when(F.col("order_key") % 2 == 0, "debit").otherwise("credit").alias("field"), F.when(F.col("order_key") % 5 == 0, "oops").otherwise("1,234.50").alias("value"))
    return apply_edits(rows, edits).select("order_key", *double("debit", "credit"), "edited")


def problems_first(spark, sf_dir):
    rank = Window.partitionBy("statement_id").orderBy(F.when(F.col("status") == "error", 0).when(F.col("status") == "warning", 1).otherwise(2), "serial")
    return audit_rows(statements(spark, sf_dir)).select("statement_id", "order_key", F.row_number().over(rank).cast("long").alias("place"))


def rate_limit(spark, sf_dir):
    return limit_hits(read(spark, sf_dir, "events"), "user_id", "ts", "event_id", 2, 86400.0).select("event_id", F.col("key").alias("user_id"), "allowed")


QUERIES = {f.__name__: f for f in (running_balance_audit, validation_report, date_monotonicity, opening_and_closing, newest_first_reorder, movements, parse_amount_roundtrip, parse_date_roundtrip, exports, wrapped_merge, edited_ledger, problems_first, rate_limit)}

BASE = """b AS (SELECT c_custkey AS statement_id, CAST(c_acctbal AS DECIMAL(18,2)) AS opening, o_orderkey AS order_key, CAST(o_orderdate AS DATE) AS txn_date,
 CASE WHEN o_orderstatus <> 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS debit, CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS credit
 FROM orders JOIN customer ON o_custkey = c_custkey),
l AS (SELECT *, row_number() OVER w AS serial, opening + sum(coalesce(credit, 0) - coalesce(debit, 0)) OVER w + CASE WHEN order_key % 97 = 0 THEN 100 ELSE 0 END AS balance
 FROM b WINDOW w AS (PARTITION BY statement_id ORDER BY txn_date, order_key ROWS UNBOUNDED PRECEDING))"""
AUDIT = """a AS (SELECT *, coalesce(lag(balance) OVER w, opening) + coalesce(credit, 0) - coalesce(debit, 0) AS expected, coalesce(txn_date < lag(txn_date) OVER w, false) AS late FROM {0} WINDOW w AS (PARTITION BY statement_id ORDER BY serial)),
s AS (SELECT *, balance - expected AS delta, abs(balance - expected) > 0.01 AS wrong FROM a)"""

LIMIT_SQL = """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, ts AS opened, 1 AS hits FROM e WHERE n = 1
 UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN e.ts >= r.opened + INTERVAL 1 DAY THEN e.ts ELSE r.opened END, CASE WHEN e.ts >= r.opened + INTERVAL 1 DAY THEN 1 ELSE r.hits + 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT event_id, user_id, hits <= 2 AS allowed FROM r"""

ORACLE = {
    "running_balance_audit": f"""WITH {BASE}, {AUDIT.format('l')}
SELECT statement_id, serial, CAST(balance AS DOUBLE) AS balance, CAST(expected AS DOUBLE) AS expected, CAST(delta AS DOUBLE) AS delta, CASE WHEN wrong THEN 'error' WHEN late THEN 'warning' ELSE 'ok' END AS status FROM s""",
    "validation_report": f"""WITH {BASE}, {AUDIT.format('l')},
r AS (SELECT statement_id, count(*) AS n_rows, sum(coalesce(debit, 0)) AS td, sum(coalesce(credit, 0)) AS tc, min(opening) AS opening, arg_max(balance, serial) AS closing, count(*) FILTER (wrong) AS n_errors, count(*) FILTER (late) AS n_warnings,
 coalesce(string_agg(CASE WHEN wrong THEN CAST(serial AS VARCHAR) END, ',' ORDER BY serial), '') AS offending FROM s GROUP BY statement_id),
t AS (SELECT o_custkey AS statement_id, count(*) + CASE WHEN o_custkey % 10 = 0 THEN 1 ELSE 0 END AS stated FROM orders GROUP BY o_custkey)
SELECT statement_id, n_rows, CAST(td AS DOUBLE) AS total_debit, CAST(tc AS DOUBLE) AS total_credit, CAST(closing AS DOUBLE) AS closing, CAST(opening + tc - td - closing AS DOUBLE) AS footer_delta, n_errors, n_warnings, offending, stated = n_rows AS complete,
 n_errors = 0 AND n_warnings = 0 AND abs(opening + tc - td - closing) <= 0.01 AND stated = n_rows AS ok FROM r JOIN t USING (statement_id)""",
    "date_monotonicity": f"""WITH {BASE}, p AS (SELECT statement_id, txn_date, row_number() OVER (PARTITION BY statement_id ORDER BY order_key % 89, order_key) AS serial FROM l)
SELECT statement_id, serial, coalesce(txn_date < lag(txn_date) OVER (PARTITION BY statement_id ORDER BY serial), false) AS date_warning FROM p""",
    "opening_and_closing": f"""WITH {BASE} SELECT statement_id, CAST(arg_min(balance + coalesce(debit, 0) - coalesce(credit, 0), serial) AS DOUBLE) AS opening, CAST(arg_max(balance, serial) AS DOUBLE) AS closing FROM l GROUP BY statement_id""",
    "newest_first_reorder": f"""WITH {BASE}, n AS (SELECT statement_id, min(txn_date) < max(txn_date) AS moves, count(*) AS n FROM l GROUP BY 1)
SELECT statement_id, order_key, CASE WHEN statement_id % 2 = 0 AND NOT moves THEN n + 1 - serial ELSE serial END AS serial, statement_id % 2 = 0 AND moves AS reversed FROM l JOIN n USING (statement_id)""",
    "movements": f"""WITH {BASE} SELECT order_key, CAST(debit AS DOUBLE) AS separate_debit, CAST(credit AS DOUBLE) AS separate_credit, CAST(debit AS DOUBLE) AS signed_debit, CAST(credit AS DOUBLE) AS signed_credit,
 CASE WHEN order_key % 11 <> 0 THEN CAST(debit AS DOUBLE) END AS flag_debit, CASE WHEN order_key % 11 = 0 THEN CAST(coalesce(debit, credit) AS DOUBLE) ELSE CAST(credit AS DOUBLE) END AS flag_credit, order_key % 11 = 0 AS flag_issue FROM l""",
    "parse_amount_roundtrip": "SELECT o_orderkey AS order_key, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) * CASE WHEN o_orderkey % 7 IN (2, 3, 4, 6) THEN -1 ELSE 1 END AS amount FROM orders",
    "parse_date_roundtrip": "SELECT o_orderkey AS order_key, CAST(o_orderdate AS DATE) AS txn_date FROM orders",
    "exports": f"""WITH {BASE}, t AS (SELECT *, CAST(abs(CAST(balance AS DECIMAL(18,2))) AS VARCHAR) AS d FROM l), u AS (SELECT *, split_part(d, '.', 1) AS w, split_part(d, '.', 2) AS f FROM t)
SELECT order_key, CASE WHEN balance < 0 THEN '-' ELSE '' END || '₹' || CASE WHEN length(w) > 3 THEN reverse(rtrim(regexp_replace(reverse(left(w, length(w) - 3)), '(\\d\\d)', '\\1,', 'g'), ',')) || ',' || right(w, 3) ELSE w END || '.' || f AS inr,
 regexp_replace(regexp_replace(d, '0+$', ''), '\\.$', '') AS plain, repeat('X', 9) || right(lpad(CAST(statement_id AS VARCHAR), 9, '0'), 4) AS account,
 serial || ',' || strftime(txn_date, '%d/%m/%Y') || ',' || coalesce(CAST(debit AS VARCHAR), '') || ',' || coalesce(CAST(credit AS VARCHAR), '') || ',' || CASE WHEN balance < 0 THEN '''' ELSE '' END || CAST(CAST(balance AS DECIMAL(18,2)) AS VARCHAR) AS csv_line FROM u""",
    "wrapped_merge": """WITH x AS (SELECT doc_id AS statement_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
r AS (SELECT statement_id, unnest(parts) AS text, unnest(range(len(parts))) AS row_seq FROM x),
k AS (SELECT statement_id, row_seq - CASE WHEN row_seq % 5 = 3 THEN 0 ELSE row_seq % 5 END AS first_row, row_seq, text FROM r)
SELECT statement_id, first_row AS row_seq, CASE WHEN first_row % 5 = 3 THEN 'H' ELSE 'T' END AS kind, count(*) AS n_lines, md5(coalesce(string_agg(CASE WHEN text <> '' THEN text END, ' ' ORDER BY row_seq), '')) AS text_md5 FROM k GROUP BY statement_id, first_row""",
    "edited_ledger": f"""WITH {BASE}, e AS (SELECT *, order_key % 13 = 0 AND order_key % 5 <> 0 AS edited, order_key % 2 = 0 AS to_debit FROM l)
SELECT order_key, CASE WHEN NOT edited THEN CAST(debit AS DOUBLE) WHEN to_debit THEN 1234.5 END AS debit, CASE WHEN NOT edited THEN CAST(credit AS DOUBLE) WHEN NOT to_debit THEN 1234.5 END AS credit, edited FROM e""",
    "rate_limit": LIMIT_SQL,
    "problems_first": f"""WITH {BASE}, {AUDIT.format('l')} SELECT statement_id, order_key, row_number() OVER (PARTITION BY statement_id ORDER BY CASE WHEN wrong THEN 0 WHEN late THEN 1 ELSE 2 END, serial) AS place FROM s""",
}
