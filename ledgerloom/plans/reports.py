"""Registered queries: check rows and messages, export formats, edits of several fields, the conversion
of all statements over their candidate layouts, the store of layouts, names and keys, a limiter stream."""

from __future__ import annotations

import io
import re
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.details import clamp, client_key, file_name
from ..functions.names import register_names
from ..functions.text import MONEY
from ..operators.audit import audit_rows, checks, first_offenders, report, row_messages
from ..operators.convert import convert
from ..operators.layouts import inferred_layouts, mapping_error, newest_layouts, storable, upsert
from ..operators.ledger import apply_edits
from ..operators.store import LayoutStore
from ..sinks.exports import accounting_import, export_errors, export_files, general_csv, result_lines, workbook_summary
from ..sinks.files import FORMAT
from ..sources.pages import upload_error
from ..sources.runs import normalise_runs
from ..sources.shared import Stages, shared_dir
from ..streaming.state import limit_stream
from .layouts import BANKS, pick, quoted
from .statements import AUDIT, BASE, LIMIT_SQL, double, read, statements


def stated_counts(spark, sf_dir) -> DataFrame:
    """A count that each statement states: every tenth one too many, every fourth none."""
    s = F.col("o_custkey")
    counts = read(spark, sf_dir, "orders").groupBy(s.alias("statement_id")).agg(F.count("*").alias("n"))
    s = F.col("statement_id")
    return counts.select(s, F.when(s % 4 != 0, F.col("n") + F.when(s % 10 == 0, 1).otherwise(0)).alias("stated_count"))


def reported(spark, sf_dir) -> DataFrame:
    """Every ninth statement has no opening balance."""
    rows = statements(spark, sf_dir).withColumn("opening", F.when(F.col("statement_id") % 9 != 0, F.col("opening")))
    return report(audit_rows(rows), stated_counts(spark, sf_dir))


def check_rows(spark, sf_dir):
    out = checks(reported(spark, sf_dir))
    return out.select("statement_id", F.col("check_no").cast("long").alias("check_no"), "id", "label", "status", "detail", F.array_join(F.transform("offending_rows", lambda r: r.cast("string")), ",").alias("offending"))


def report_measures(spark, sf_dir):
    out = reported(spark, sf_dir).withColumn("f", first_offenders(F.col("error_rows")))
    return out.select("statement_id", "n_rows", *double("total_debit", "total_credit", "opening", "closing", "computed_closing"), "n_errors", "n_warnings", F.size("f.named").cast("long").alias("n_named"), F.col("f.more").cast("long").alias("n_more"), "ok")


def scrambled(spark, sf_dir) -> DataFrame:
    order = Window.partitionBy("statement_id").orderBy(F.col("order_key") % 89, "order_key")
    return statements(spark, sf_dir).withColumn("serial", F.row_number().over(order))


def messages(spark, sf_dir):
    """Statuses and messages of rows out of order."""
    out = audit_rows(scrambled(spark, sf_dir)).withColumn("m", row_messages())
    return out.select("statement_id", F.col("serial").cast("long").alias("serial"), "status", F.array_join("m", " / ").alias("messages"))


def transactions(spark, sf_dir) -> DataFrame:
    """The statements' rows with all fields of a transaction."""
    k = F.col("order_key")
    key = k.cast("string")
    text = F.when(k % 4 == 0, F.concat(F.lit("=order "), key)).when(k % 4 == 1, F.concat(F.lit('order "'), key, F.lit('", paid'))).otherwise(F.concat(F.lit("order "), key))
    lines = F.when(k % 3 == 0, F.array(text, F.concat(F.lit("of "), F.col("statement_id").cast("string"))))
    rows = statements(spark, sf_dir)
    return rows.select("statement_id", "serial", "order_key", "txn_date", F.when(k % 2 == 0, F.col("txn_date")).alias("value_date"), text.alias("narration"), lines.alias("narration_lines"), F.when(k % 5 != 0, F.concat(F.lit("R"), key)).alias("ref_no"), "debit", "credit", "balance",
                       F.when(k % 6 == 0, "low").otherwise("high").alias("confidence"), F.when(k % 6 == 0, F.array(F.lit("No Dr/Cr flag found for this row; recorded as a credit."), F.lit("odd"))).otherwise(F.array().cast("array<string>")).alias("issues"), "opening")


def csv_file(spark, sf_dir):
    return general_csv(transactions(spark, sf_dir)).select("statement_id", F.col("line_no").cast("long").alias("line_no"), "line")


def import_file(spark, sf_dir):
    return accounting_import(transactions(spark, sf_dir), {"bankCode": " AXISBB ", "partyCode": ""}).select("statement_id", F.col("line_no").cast("long").alias("line_no"), "line")


def facts(spark, sf_dir) -> DataFrame:
    s = F.col("statement_id")
    rows = transactions(spark, sf_dir)
    meta = rows.groupBy("statement_id").agg(F.min("opening").alias("opening"), F.min("txn_date").alias("period_from"), F.when(s % 3 != 0, F.max("txn_date")).alias("period_to"))
    return meta.select("statement_id", pick(BANKS, (s % 12).cast("int")).alias("bank_name"), F.lit("t-1").alias("template_id"), F.when(s % 2 == 0, F.concat(F.lit("XX"), s.cast("string"))).alias("account_masked"), "period_from", "period_to", (s % 7 + 1).alias("page_count"), F.when(s % 5 == 0, "llm").otherwise("template").alias("parsed_by"), "opening")


def workbook_labels(spark, sf_dir):
    out = workbook_summary(transactions(spark, sf_dir), facts(spark, sf_dir))
    return out.select("statement_id", F.col("line_no").cast("long").alias("line_no"), "label", "value")


def export_names(spark, sf_dir):
    return facts(spark, sf_dir).select("statement_id", file_name(F.concat(F.col("bank_name"), F.lit(" / é*")), F.col("period_from"), F.col("period_to"), "csv").alias("file_name"))


def export_checks(spark, sf_dir):
    """Statements with a row without a day cannot be exported."""
    rows = transactions(spark, sf_dir)
    rows = rows.withColumn("txn_date", F.when(F.col("order_key") % 101 != 0, F.col("txn_date")))
    return export_errors(rows).select("statement_id", "n_rows", "ok")


def json_results(spark, sf_dir):
    rows = transactions(spark, sf_dir).select("statement_id", "serial", "txn_date", "debit", "credit")
    return result_lines(rows, facts(spark, sf_dir).select("statement_id", "bank_name", "period_to"))


def edited_fields(spark, sf_dir):
    """Several edits of one row: a side and then the other, a narration, a day that cannot be read, blanks."""
    rows = transactions(spark, sf_dir)
    k, key = F.col("order_key"), ["statement_id", "serial"]
    edit = lambda at, field, value, when: F.when(when, F.struct(F.lit(at).alias("at"), F.lit(field).alias("field"), F.lit(value).alias("value")))
    made = F.array(edit(1, "debit", "10", k % 3 == 0), edit(2, "credit", " (1,234.50) ", k % 6 == 0), edit(3, "narration", " mended ", k % 4 == 0), edit(4, "date", "31/02/2024", k % 5 == 0), edit(5, "date", "2 Jan 2024", k % 10 == 0), edit(6, "value_date", "", k % 4 == 2), edit(7, "ref_no", "", k % 7 == 0), edit(8, "balance", "", k % 8 == 0), edit(9, "balance", "5 Dr", k % 9 == 0))
    edits = rows.select(*key, F.inline(F.filter(made, lambda e: e.isNotNull())))
    out = apply_edits(rows, edits, "at")
    return out.select("order_key", "txn_date", "value_date", "narration", F.size(F.coalesce("narration_lines", F.array())).cast("long").alias("n_lines"), "ref_no", *double("debit", "credit", "balance"), "confidence", F.array_join("issues", ";").alias("issues"), "edited")


def conversion(spark, sf_dir):
    """All statements over their candidates by id; some have none, some candidates give no rows."""
    proof = report(audit_rows(statements(spark, sf_dir))).select("statement_id", (F.col("n_errors") == 0).alias("good"))
    s = F.col("statement_id")
    tiers = F.filter(F.array(F.when(s % 7 == 0, 1), F.when(s % 3 != 0, 2), F.when(s % 2 == 0, 3), F.when(s % 11 == 0, 4)), lambda t: t.isNotNull())
    tried = proof.select("statement_id", "good", F.explode(tiers).alias("tier"))
    parsed = ((F.col("tier") != 2) | (s % 13 != 0)) & ((F.col("tier") != 4) | (s % 33 != 0))
    tried = tried.select("statement_id", F.col("tier").cast("long").alias("tier"), F.lit("X").alias("bank"), parsed.alias("parsed"), (F.col("good") & ((F.col("tier") != 3) | (s % 5 != 0))).alias("ok"))
    out = convert(proof.select("statement_id", (s % 4 != 0).alias("may_ask")), tried, "may_ask")
    return out.select("statement_id", "tier", "used", "evicted", "stored", "error_code", F.size("notices").cast("long").alias("n_notices"))


def layout_store(spark, sf_dir):
    """Layouts of suppliers after new ones replace those of their keys and others go."""
    s = F.col("s_suppkey")
    rows = read(spark, sf_dir, "supplier").select(s.cast("string").alias("key"), F.col("s_name").alias("bank"), (s % 50).alias("learned_at"), s.alias("_s"))
    stored = rows.where("_s % 3 <> 0").drop("_s")
    changed = rows.where("_s % 4 = 0").select("key", F.concat("bank", F.lit("+")).alias("bank"), F.lit(99).cast("long").alias("learned_at"))
    return upsert(stored, changed, rows.where("_s % 5 = 0 and _s % 4 <> 0").select("key"))


def newest_stored(spark, sf_dir):
    s = F.col("s_suppkey")
    return newest_layouts(read(spark, sf_dir, "supplier").select(s.cast("string").alias("key"), F.col("s_name").alias("bank"), (s % 50).alias("learned_at")), 100)


def inferred_mappings(spark, sf_dir):
    """Mappings of customers' layouts: what is wrong with them, and the labels that may be stored."""
    c = F.col("c_custkey")
    style = pick(("separate-dr-cr", "signed-single", "amount-plus-flag"), (c % 3).cast("int"))
    place = lambda name, when, at: F.struct(F.lit(name).alias("key"), F.when(when, F.lit(at)).alias("value"))
    places = F.map_from_entries(F.array(place("date", F.lit(True), 0), place("narration", F.lit(True), 1), place("debit", c % 4 == 0, 2), place("amount", c % 5 != 0, 3), place("flag", c % 2 == 0, 4), place("balance", F.lit(True), 5)))
    rows = read(spark, sf_dir, "customer").select(c.alias("statement_id"), c.cast("string").alias("fingerprint"), F.lit("B").alias("bank"), F.array(F.lit("dd/MM/yyyy")).alias("formats"), style.alias("style"), places.alias("places"))
    heads = rows.select("statement_id", F.array(F.lit("Date"), F.when(F.col("statement_id") % 6 != 0, " Text ").otherwise(" "), F.lit("Out"), F.lit("Sum"), F.lit(""), F.lit("Balance")).alias("cells"))
    labels = storable(rows, heads).select("key", F.array_join(F.transform(F.array_sort(F.map_entries("columns")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("labels"))
    return rows.select("statement_id", "fingerprint", mapping_error(F.col("style"), F.col("places")).alias("error_code")).join(labels, F.col("fingerprint") == F.col("key"), "left").select("statement_id", "error_code", "labels")


def client_keys(spark, sf_dir):
    e = F.col("event_id")
    hop = F.concat(F.lit("10.0."), (F.col("user_id") % 256).cast("string"))
    forwarded = F.when(e % 3 == 0, F.concat(F.lit(" "), hop, F.lit(" , proxy"))).when(e % 3 == 1, "")
    score = F.when(e % 4 == 0, float("nan")).when(e % 4 == 1, float("inf")).otherwise(F.col("value") / 50.0 - 0.5)
    return read(spark, sf_dir, "events").select("event_id", client_key(forwarded, F.when(e % 2 == 0, hop)).alias("client"), clamp(score).alias("score"))


def upload_checks(spark, sf_dir):
    """Documents as uploads: every third begins like a PDF; their sizes are those of files 20,000 times as large."""
    d = read(spark, sf_dir, "documents")
    content = F.concat(F.when(F.col("doc_id") % 3 == 0, "%PDF-").otherwise(""), F.coalesce("text", F.lit(""))).cast("binary")
    return d.select("doc_id", upload_error(content, F.octet_length(content).cast("long") * 20_000).alias("error_code"))


def rate_limit_stream(spark, sf_dir):
    """The limiter over the events as a stream: two hits a day and user, in one batch of all files."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*.parquet")
    found = limit_stream(events, "user_id", "ts", "event_id", 2, 86400.0)
    found.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{base}/rows").select("event_id", F.col("key").cast("long").alias("user_id"), "allowed")


def exported_files(spark, sf_dir):
    """Files of all formats, written by the `statement-files` source and read back: of the texts a digest, of
    workbooks the rows of both sheets and the last balance. Rows and facts are written once for all formats; files are
    listed and read by tasks, a folder each."""
    stages = Stages(spark)
    base, rows, meta = stages.base, stages.write(transactions(spark, sf_dir), "rows"), stages.write(facts(spark, sf_dir), "facts")
    for name, options in (("csv", {}), ("ledger-csv", {"bankCode": " AXISBB "}), ("xlsx", {})):
        export_files(rows, f"{base}/{name}", name, options, meta)
    read_back = lambda name: spark.read.format(FORMAT).load(f"{base}/{name}/part-*").select(F.regexp_extract("file_name", r"^(\d+) ", 1).cast("long").alias("statement_id"), "content")
    texts = [read_back(n).select("statement_id", F.md5("content").alias(f"{c}_md5"), F.length("content").cast("long").alias(f"{c}_bytes")) for n, c in (("csv", "csv"), ("ledger-csv", "import"))]
    books = read_back("xlsx").mapInArrow(sheet_figures, "statement_id long, sheet_rows long, summary_rows long, last_balance double")
    return texts[0].join(texts[1], "statement_id").join(books, "statement_id")


def sheet_figures(batches):
    """(statement_id, content) of workbooks to the rows of their sheets and the balance of the last transaction."""
    for b in batches:
        out = []
        for key, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                first, second = (z.read(f"xl/worksheets/sheet{i}.xml").decode() for i in (1, 2))
            at = first.count("<row ")
            out.append((key, at, second.count("<row "), float(re.search(rf'<c r="H{at}"[^>]*><v>([^<]*)</v>', first)[1])))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["statement_id", "sheet_rows", "summary_rows", "last_balance"]) if out else pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3 + [pa.array([], pa.float64())], names=["statement_id", "sheet_rows", "summary_rows", "last_balance"])


def raw_runs(spark, sf_dir):
    """Runs as a renderer gives them, of all orders, normalised: with and without heights, turned, blank, and short ones."""
    k = F.col("order_key")
    rows = statements(spark, sf_dir).select("statement_id", k, "serial")
    numbers = F.array(F.lit(0.0), F.when(k % 5 == 0, 3.0).otherwise(0.0), F.lit(0.0), F.when(k % 7 == 0, 0.0).when(k % 3 == 0, -8.0).otherwise(4.0), k.cast("double"), F.when(k % 11 != 0, F.col("serial").cast("double")))
    raw = rows.select("statement_id", F.lit(1).cast("long").alias("page"), F.lit(842.0).alias("page_height"), k.alias("seq"), F.when(k % 13 == 0, F.lit(" \u00a0")).when(k % 17 != 0, F.concat(F.lit("run "), k.cast("string"))).alias("text"),
                      F.when(k % 19 == 0, F.slice(numbers, 1, 4)).otherwise(numbers).alias("transform"), F.when(k % 2 == 0, 30.0).alias("width"), F.when(k % 4 != 0, (k % 3 - 1).cast("double") * 9).alias("height"))
    return normalise_runs(raw).select("statement_id", F.col("seq").alias("order_key"), "x", "y", "width", "height", "font_size", "text")


def sql_names(spark, sf_dir):
    """The expressions called by name from SQL, over texts made of orders."""
    register_names(spark)
    read(spark, sf_dir, "orders").createOrReplaceTempView("ledger_orders")
    return spark.sql("""
WITH t AS (SELECT o_orderkey AS order_key, CAST(o_totalprice AS DECIMAL(18,2)) AS price, CAST(o_orderdate AS DATE) AS day FROM ledger_orders),
x AS (SELECT order_key, price, concat(CASE WHEN order_key % 3 = 0 THEN '(' ELSE '' END, format_number(price, 2), CASE WHEN order_key % 3 = 0 THEN ')' WHEN order_key % 3 = 1 THEN ' Dr.' ELSE '' END) AS amount, CASE WHEN order_key % 4 = 0 THEN 'no day' ELSE date_format(day, 'd MMM yyyy') END AS day FROM t)
SELECT order_key, CAST(ledger_amount(amount) AS DOUBLE) AS amount, CAST(ledger_magnitude(amount) AS DOUBLE) AS magnitude, ledger_marker(amount) AS marker, ledger_date(day) AS day,
 ledger_flag(CASE WHEN order_key % 2 = 0 THEN ' C.R. ' ELSE 'Debit' END) AS flag, ledger_mask(concat(' ', CAST(order_key * 1000003 AS STRING))) AS masked, ledger_rupees(CASE WHEN order_key % 5 = 0 THEN -price ELSE price END) AS rupees FROM x""")


def stored_layouts(spark, sf_dir):
    """Layouts of suppliers in a bucketed store after two batches of changes: puts and uses, then puts, deletes
    and uses of a key, in the order of `at`."""
    s = F.col("s_suppkey")
    rows = read(spark, sf_dir, "supplier").select(s.cast("string").alias("key"), s.alias("_s"), F.col("s_name").alias("bank"))
    more = lambda: (F.array(F.lit("dd/MM/yyyy")).alias("formats"), F.lit("separate-dr-cr").alias("style"), F.create_map(F.lit("date"), F.lit("Date")).alias("columns"))
    day = lambda n: F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("_s") % 50) * 60 + n).alias("learned_at")
    op = lambda name, uses, at: F.struct(F.lit(name).alias("op"), F.lit(uses).cast("long").alias("uses"), F.lit(at).alias("at"))
    first = rows.select("key", "bank", *more(), day(0), F.inline(F.array(op("put", 1, 1), op("use", 2, 2))))
    k = F.col("_s")
    second = rows.select("key", F.concat("bank", F.lit("+")).alias("bank"), *more(), day(7), F.inline(F.when(k % 5 == 0, F.array(op("put", 1, 1), op("delete", 0, 2))).when(k % 4 == 0, F.array(op("delete", 0, 1), op("put", 1, 2), op("use", 3, 3))).when(k % 3 == 0, F.array(op("use", 4, 1), op("use", 1, 2)))).alias("op", "uses", "at"))
    store = LayoutStore(spark, f"{Stages(spark).base}/store", 16)
    store.apply(first)
    store.apply(second)
    return store.rows().select("key", "bank", F.unix_timestamp("learned_at").alias("learned_at"), "times_used")


def placed_mappings(spark, sf_dir):
    """Mappings by column number of customers, as layouts: the fields that have a column."""
    c = F.col("c_custkey")
    places = F.map_from_entries(F.array(*[F.struct(F.lit(f).alias("key"), F.when(F.lit(not n) | (c % (n or 1) != 0), i).alias("value")) for i, (f, n) in enumerate((("date", 0), ("narration", 0), ("debit", 2), ("credit", 3), ("balance", 5)))]))
    mappings = read(spark, sf_dir, "customer").select(F.md5(c.cast("string")).alias("fingerprint"), F.col("c_name").alias("bank"), F.array(F.lit("dd/MM/yyyy")).alias("formats"), F.lit("separate-dr-cr").alias("style"), places.alias("places"))
    return inferred_layouts(mappings).select("layout_id", "bank", F.array_join(F.array_sort(F.map_keys("places")), ",").alias("fields"), F.aggregate(F.map_values("places"), F.lit(0), lambda a, v: a + v).cast("long").alias("sum_of_columns"))


QUERIES = {f.__name__: f for f in (check_rows, report_measures, messages, csv_file, import_file, workbook_labels, export_names, export_checks, json_results, edited_fields, conversion, layout_store, newest_stored, inferred_mappings, client_keys, upload_checks, rate_limit_stream, exported_files, raw_runs, sql_names, stored_layouts, placed_mappings)}


def inr(e: str) -> str:
    d = f"CAST(abs(CAST({e} AS DECIMAL(18,2))) AS VARCHAR)"
    w = f"split_part({d}, '.', 1)"
    return f"(CASE WHEN {e} < 0 THEN '-' ELSE '' END || '₹' || CASE WHEN length({w}) > 3 THEN reverse(rtrim(regexp_replace(reverse(left({w}, length({w}) - 3)), '(\\d\\d)', '\\1,', 'g'), ',')) || ',' || right({w}, 3) ELSE {w} END || '.' || split_part({d}, '.', 2))"


def esc(t: str) -> str:
    g = f"(CASE WHEN regexp_matches({t}, '^[=+@\\t\\r-]') THEN '''' ELSE '' END || {t})"
    return f"CASE WHEN regexp_matches({g}, '[\",\\r\\n]') THEN '\"' || replace({g}, '\"', '\"\"') || '\"' ELSE {g} END"


_plain = "coalesce(regexp_replace(regexp_replace(CAST({0} AS VARCHAR), '0+$', ''), '\\.$', ''), '')"
MEASURED = f"""{BASE}, o AS (SELECT * REPLACE (CASE WHEN statement_id % 9 <> 0 THEN opening END AS opening) FROM l), {AUDIT.format('o')},
t AS (SELECT o_custkey AS statement_id, CASE WHEN o_custkey % 4 <> 0 THEN count(*) + CASE WHEN o_custkey % 10 = 0 THEN 1 ELSE 0 END END AS stated FROM orders GROUP BY o_custkey),
r AS (SELECT statement_id, count(*) AS n, CAST(sum(coalesce(debit, 0)) AS DECIMAL(18,2)) AS td, CAST(sum(coalesce(credit, 0)) AS DECIMAL(18,2)) AS tc, min(opening) AS opening, CAST(arg_max(balance, serial) AS DECIMAL(18,2)) AS closing, count(*) FILTER (wrong) AS n_errors, count(*) FILTER (late) AS n_late,
 coalesce(string_agg(CASE WHEN wrong THEN CAST(serial AS VARCHAR) END, ',' ORDER BY serial), '') AS offending FROM s GROUP BY statement_id),
m AS (SELECT *, opening + tc - td AS computed, opening + tc - td - closing AS delta FROM r JOIN t USING (statement_id))"""
TXN = f"""{BASE}, x AS (SELECT *, CASE order_key % 4 WHEN 0 THEN '=order ' || order_key WHEN 1 THEN 'order "' || order_key || '", paid' ELSE 'order ' || order_key END AS narration, CAST(balance AS DECIMAL(18,2)) AS bal FROM l)"""
ORACLE = {
    "check_rows": f"""WITH {MEASURED}
SELECT statement_id, CAST(1 AS BIGINT) AS check_no, 'running-balance' AS id, 'Running balance' AS label, CASE WHEN n_errors > 0 THEN 'fail' ELSE 'pass' END AS status,
 CASE WHEN n_errors > 0 THEN n_errors || ' row(s) do not follow from the previous balance.' WHEN opening IS NOT NULL THEN 'All ' || n || ' rows reconcile against the opening balance of ' || {inr('opening')} || '.' ELSE 'Every row follows from the one before it. The opening balance was unknown, so row 1 was not checked.' END AS detail, offending FROM m
UNION ALL SELECT statement_id, 2, 'footer-reconciliation', 'Statement totals', CASE WHEN opening IS NULL THEN 'skipped' WHEN abs(delta) <= 0.01 THEN 'pass' ELSE 'fail' END,
 CASE WHEN opening IS NULL THEN 'The statement did not state both an opening and a closing balance.' WHEN abs(delta) <= 0.01 THEN {inr('opening')} || ' + ' || {inr('tc')} || ' credits − ' || {inr('td')} || ' debits = ' || {inr('closing')} || '.'
 ELSE 'Totals are off by ' || {inr('delta')} || ': opening ' || {inr('opening')} || ' plus ' || {inr('tc')} || ' credits minus ' || {inr('td')} || ' debits gives ' || {inr('computed')} || ', but the closing balance is ' || {inr('closing')} || '.' END, '' FROM m
UNION ALL SELECT statement_id, 3, 'date-monotonicity', 'Date order', 'pass', 'Dates run forward through the statement.', '' FROM m
UNION ALL SELECT statement_id, 4, 'completeness', 'Transaction count', CASE WHEN stated IS NULL THEN 'skipped' WHEN stated = n THEN 'pass' ELSE 'fail' END,
 CASE WHEN stated IS NULL THEN 'The statement did not print a transaction count to compare against.' WHEN stated = n THEN 'Found all ' || stated || ' transactions the statement says it contains.' ELSE 'The statement states ' || stated || ' transactions but ' || n || ' were extracted.' END, '' FROM m""",
    "report_measures": f"""WITH {MEASURED} SELECT statement_id, n AS n_rows, CAST(td AS DOUBLE) AS total_debit, CAST(tc AS DOUBLE) AS total_credit, CAST(opening AS DOUBLE) AS opening, CAST(closing AS DOUBLE) AS closing, CAST(computed AS DOUBLE) AS computed_closing, n_errors, CAST(0 AS BIGINT) AS n_warnings,
 least(n_errors, 12) AS n_named, greatest(n_errors - 12, 0) AS n_more, n_errors = 0 AND coalesce(abs(delta) <= 0.01, true) AND (stated IS NULL OR stated = n) AS ok FROM m""",
    "messages": f"""WITH {BASE}, p AS (SELECT * REPLACE (row_number() OVER (PARTITION BY statement_id ORDER BY order_key % 89, order_key) AS serial) FROM l), {AUDIT.format('p')}, q AS (SELECT *, lag(txn_date) OVER (PARTITION BY statement_id ORDER BY serial) AS before FROM s)
SELECT statement_id, serial, CASE WHEN wrong THEN 'error' WHEN late THEN 'warning' ELSE 'ok' END AS status, concat_ws(' / ', CASE WHEN wrong THEN 'Running balance breaks here: expected ' || {inr('expected')} || ' but the statement shows ' || {inr('balance')} || ' (off by ' || {inr('delta')} || ').' END,
 CASE WHEN late THEN 'Date ' || txn_date || ' is earlier than ' || before || ' on the previous row, which usually means rows were merged incorrectly.' END) AS messages FROM q""",
    "csv_file": f"""WITH {TXN} SELECT DISTINCT statement_id, CAST(0 AS BIGINT) AS line_no, 'Serial,Date,Value Date,Narration,Ref No.,Debit,Credit,Balance,Confidence,Issues' AS line FROM x
UNION ALL SELECT statement_id, serial, serial || ',' || strftime(txn_date, '%d/%m/%Y') || ',' || CASE WHEN order_key % 2 = 0 THEN strftime(txn_date, '%d/%m/%Y') ELSE '' END || ',' || {esc('narration')} || ',' || CASE WHEN order_key % 5 <> 0 THEN 'R' || order_key ELSE '' END || ',' || coalesce(CAST(debit AS VARCHAR), '') || ',' || coalesce(CAST(credit AS VARCHAR), '') || ',' || {esc('CAST(bal AS VARCHAR)')}
 || ',' || CASE WHEN order_key % 6 = 0 THEN 'low,No Dr/Cr flag found for this row; recorded as a credit.; odd' ELSE 'high,' END FROM x""",
    "import_file": f"""WITH {TXN} SELECT DISTINCT statement_id, CAST(0 AS BIGINT) AS line_no, '"bk_cd","prt_cd","tr_date","amtp","amtr","rem"' AS line FROM x
UNION ALL SELECT statement_id, serial, '"AXISBB","SUSP","' || strftime(txn_date, '%d-%m-%Y') || '","' || {_plain.format('debit')} || '","' || {_plain.format('credit')} || '","' || replace(narration, '"', '""') || CASE WHEN order_key % 3 = 0 THEN chr(10) || 'of ' || statement_id ELSE '' END || '"' FROM x""",
    "workbook_labels": f"""WITH {BASE}, r AS (SELECT statement_id AS s, count(*) AS n, CAST(sum(coalesce(debit, 0)) AS DECIMAL(18,2)) AS d, CAST(sum(coalesce(credit, 0)) AS DECIMAL(18,2)) AS c, min(opening) AS o, CAST(arg_max(balance, serial) AS DECIMAL(18,2)) AS z, min(txn_date) AS f, max(txn_date) AS u FROM l GROUP BY 1),
v AS (SELECT s, unnest([{{'line_no': 0, 'label': 'Statement summary', 'value': ''}}, {{'line_no': 1, 'label': NULL, 'value': NULL}}, {{'line_no': 2, 'label': 'Bank', 'value': {quoted(BANKS)}[s % 12 + 1]}}, {{'line_no': 3, 'label': 'Account number', 'value': CASE WHEN s % 2 = 0 THEN 'XX' || s ELSE 'not stated' END}},
 {{'line_no': 4, 'label': 'Statement period', 'value': CASE WHEN s % 3 <> 0 THEN f || ' to ' || u ELSE 'not stated' END}}, {{'line_no': 5, 'label': 'Pages', 'value': CAST(s % 7 + 1 AS VARCHAR)}}, {{'line_no': 6, 'label': 'Parsed by', 'value': CASE WHEN s % 5 = 0 THEN 'AI-assisted column mapping' ELSE 'Template (t-1)' END}},
 {{'line_no': 7, 'label': '', 'value': NULL}}, {{'line_no': 8, 'label': 'Transactions', 'value': CAST(n AS VARCHAR)}}, {{'line_no': 9, 'label': 'Opening balance', 'value': CAST(o AS VARCHAR)}}, {{'line_no': 10, 'label': 'Total debits', 'value': CAST(d AS VARCHAR)}}, {{'line_no': 11, 'label': 'Total credits', 'value': CAST(c AS VARCHAR)}},
 {{'line_no': 12, 'label': 'Closing balance', 'value': CAST(z AS VARCHAR)}}, {{'line_no': 13, 'label': 'Opening + credits − debits', 'value': CAST(CAST(o + c - d AS DECIMAL(18,2)) AS VARCHAR)}}, {{'line_no': 14, 'label': 'Reconciles', 'value': CASE WHEN abs(o + c - d - z) <= 0.01 THEN 'Yes' ELSE 'No — review before use' END}}]) AS e FROM r)
SELECT s AS statement_id, CAST(e.line_no AS BIGINT) AS line_no, e.label AS label, e.value AS value FROM v""",
    "export_names": f"""WITH r AS (SELECT o_custkey AS s, CAST(min(o_orderdate) AS DATE) AS f, CAST(max(o_orderdate) AS DATE) AS u FROM orders GROUP BY 1) SELECT s AS statement_id, {quoted(BANKS)}[s % 12 + 1] || '   statement' || CASE WHEN s % 3 <> 0 THEN ' ' || f || ' to ' || u ELSE '' END || '.csv' AS file_name FROM r""",
    "export_checks": "SELECT o_custkey AS statement_id, count(*) AS n_rows, bool_and(o_orderkey % 101 <> 0) AS ok FROM orders GROUP BY 1",
    "json_results": f"""WITH {BASE}, r AS (SELECT statement_id AS s, max(txn_date) AS u, string_agg('{{"serial":' || serial || ',"txn_date":"' || txn_date || '"' || CASE WHEN debit IS NOT NULL THEN ',"debit":' || debit ELSE '' END || CASE WHEN credit IS NOT NULL THEN ',"credit":' || credit ELSE '' END || '}}', ',' ORDER BY serial) AS t FROM l GROUP BY 1)
SELECT s AS statement_id, '{{"type":"result","ok":true,"transactions":[' || t || '],"meta":{{"statement_id":' || s || ',"bank_name":"' || {quoted(BANKS)}[s % 12 + 1] || '"' || CASE WHEN s % 3 <> 0 THEN ',"period_to":"' || u || '"' ELSE '' END || '}}}}' AS line FROM r""",
    "edited_fields": f"""WITH {TXN} SELECT order_key, CASE WHEN order_key % 10 = 0 THEN DATE '2024-01-02' ELSE txn_date END AS txn_date, CASE WHEN order_key % 4 = 0 THEN txn_date END AS value_date, CASE WHEN order_key % 4 = 0 THEN 'mended' ELSE narration END AS narration,
 CASE WHEN order_key % 4 = 0 THEN 1 WHEN order_key % 3 = 0 THEN 2 ELSE 0 END AS n_lines, CASE WHEN order_key % 5 <> 0 AND order_key % 7 <> 0 THEN 'R' || order_key END AS ref_no,
 CASE WHEN order_key % 6 = 0 THEN NULL WHEN order_key % 3 = 0 THEN 10.0 ELSE CAST(debit AS DOUBLE) END AS debit, CASE WHEN order_key % 6 = 0 THEN 1234.5 WHEN order_key % 3 = 0 THEN NULL ELSE CAST(credit AS DOUBLE) END AS credit, CASE WHEN order_key % 9 = 0 THEN -5.0 ELSE CAST(bal AS DOUBLE) END AS balance,
 'high' AS confidence, CASE WHEN order_key % 6 = 0 THEN 'odd' ELSE '' END AS issues, order_key % 3 = 0 OR order_key % 4 IN (0, 2) OR order_key % 10 = 0 OR order_key % 7 = 0 AS edited FROM x""",
    "conversion": f"""WITH {BASE}, {AUDIT.format('l')}, g AS (SELECT statement_id AS i, NOT bool_or(wrong) AS good, i % 4 <> 0 AS ask FROM s GROUP BY 1),
c AS (SELECT *, CASE WHEN i % 7 = 0 AND good THEN 1 WHEN i % 3 <> 0 AND i % 13 <> 0 AND (good OR NOT ask) THEN 2 WHEN i % 2 = 0 AND good AND i % 5 <> 0 THEN 3 WHEN i % 11 = 0 AND i % 33 <> 0 AND ask THEN 4 END AS tier FROM g)
SELECT i AS statement_id, CAST(tier AS BIGINT) AS tier, coalesce(tier IN (1, 3), false) AS used, i % 2 = 0 AND NOT (good AND i % 5 <> 0) AND coalesce(tier >= 3, true) AS evicted, coalesce(tier = 4, false) AND good AS stored,
 CASE WHEN tier IS NULL THEN CASE WHEN ask THEN CASE WHEN i % 11 = 0 THEN 'NO_TRANSACTIONS_FOUND' ELSE 'LLM_UNAVAILABLE' END WHEN i % 3 <> 0 THEN 'PARSE_FAILED' ELSE 'UNSUPPORTED_LAYOUT' END END AS error_code,
 CAST(coalesce(tier IN (1, 3), false) AS BIGINT) + CAST(i % 3 <> 0 AND coalesce(tier > 2, true) AS BIGINT) + CAST(i % 2 = 0 AND coalesce(tier > 3, true) AS BIGINT) + CASE WHEN tier = 4 THEN 1 + CAST(good AS BIGINT) ELSE 0 END AS n_notices FROM c""",
    "layout_store": "SELECT CAST(s_suppkey AS VARCHAR) AS key, s_name || CASE WHEN s_suppkey % 4 = 0 THEN '+' ELSE '' END AS bank, CASE WHEN s_suppkey % 4 = 0 THEN 99 ELSE s_suppkey % 50 END AS learned_at FROM supplier WHERE s_suppkey % 4 = 0 OR (s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0)",
    "newest_stored": "SELECT CAST(s_suppkey AS VARCHAR) AS key, s_name AS bank, s_suppkey % 50 AS learned_at FROM supplier ORDER BY learned_at DESC, key LIMIT 100",
    "inferred_mappings": """SELECT c_custkey AS statement_id, CASE WHEN CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 4 <> 0 ELSE c_custkey % 5 = 0 END OR (c_custkey % 3 = 2 AND c_custkey % 2 <> 0) THEN 'UNSUPPORTED_LAYOUT' END AS error_code,
 CASE WHEN c_custkey % 6 <> 0 THEN concat_ws(',', CASE WHEN c_custkey % 5 <> 0 THEN 'amount=Sum' END, 'balance=Balance', 'date=Date', CASE WHEN c_custkey % 4 = 0 THEN 'debit=Out' END, 'narration=Text') END AS labels FROM customer""",
    "client_keys": """SELECT event_id, CASE WHEN event_id % 3 = 0 OR event_id % 2 = 0 THEN '10.0.' || user_id % 256 ELSE 'unknown' END AS client, CASE WHEN event_id % 4 < 2 THEN 0.0 ELSE greatest(0.0, least(1.0, value / 50.0 - 0.5)) END AS score FROM events""",
    "upload_checks": """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '%PDF-' ELSE '' END || coalesce(text, '') AS c FROM documents)
SELECT doc_id, CASE WHEN strlen(c) * 20000 > 20 * 1024 * 1024 THEN 'FILE_TOO_LARGE' WHEN NOT (starts_with(c, '%PDF') AND strlen(c) > 4) THEN 'NOT_A_PDF' END AS error_code FROM d""",
    "rate_limit_stream": LIMIT_SQL,
}
_csv_lines, _import_lines = ORACLE["csv_file"], ORACLE["import_file"]
ORACLE |= {
    "exported_files": f"""WITH a AS (SELECT statement_id, string_agg(line || chr(13) || chr(10), '' ORDER BY line_no) AS c FROM ({_csv_lines}) GROUP BY 1), b AS (SELECT statement_id, string_agg(line || chr(10), '' ORDER BY line_no) AS c FROM ({_import_lines}) GROUP BY 1),
 z AS (WITH {BASE} SELECT statement_id, count(*) + 1 AS sheet_rows, CAST(15 AS BIGINT) AS summary_rows, CAST(arg_max(balance, serial) AS DOUBLE) AS last_balance FROM l GROUP BY 1)
SELECT statement_id, md5(a.c) AS csv_md5, strlen(a.c) AS csv_bytes, md5(b.c) AS import_md5, strlen(b.c) AS import_bytes, sheet_rows, summary_rows, last_balance FROM a JOIN b USING (statement_id) JOIN z USING (statement_id)""",
    "raw_runs": f"""WITH {BASE}, r AS (SELECT statement_id, order_key AS k, serial, CASE WHEN order_key % 5 = 0 THEN 3.0 ELSE 0 END AS b, CASE WHEN order_key % 7 = 0 THEN 0.0 WHEN order_key % 3 = 0 THEN -8.0 ELSE 4.0 END AS d, CASE WHEN order_key % 4 <> 0 THEN (order_key % 3 - 1) * 9.0 END AS h FROM l WHERE order_key % 13 <> 0 AND order_key % 17 <> 0 AND order_key % 19 <> 0),
f AS (SELECT *, CASE WHEN b <> 0 OR d <> 0 THEN sqrt(CAST(b * b + d * d AS DOUBLE)) ELSE 10.0 END AS size FROM r)
SELECT statement_id, k AS order_key, CAST(k AS DOUBLE) AS x, CAST(842 - CASE WHEN k % 11 = 0 THEN 0 ELSE serial END AS DOUBLE) AS y, CAST(CASE WHEN k % 2 = 0 THEN 30 ELSE 0 END AS DOUBLE) AS width, CAST(CASE WHEN h > 0 THEN h ELSE size END AS DOUBLE) AS height, size AS font_size, 'run ' || k AS text FROM f""",
    "sql_names": f"""SELECT o_orderkey AS order_key, CASE WHEN o_orderkey % 3 = 2 THEN p ELSE -p END AS amount, p AS magnitude, CASE WHEN o_orderkey % 3 = 1 THEN 'Dr' END AS marker, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) END AS day, CASE WHEN o_orderkey % 2 = 0 THEN 'Cr' ELSE 'Dr' END AS flag,
 CASE WHEN length(m) <= 4 THEN m ELSE repeat('X', least(length(m) - 4, 12)) || right(m, 4) END AS masked, {inr("CASE WHEN o_orderkey % 5 = 0 THEN -p ELSE p END")} AS rupees FROM (SELECT *, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS p, CAST(o_orderkey * 1000003 AS VARCHAR) AS m FROM orders)""",
    "stored_layouts": """SELECT CAST(s_suppkey AS VARCHAR) AS key, s_name || CASE WHEN s_suppkey % 4 = 0 THEN '+' ELSE '' END AS bank, 1700000000 + s_suppkey % 50 * 60 + CASE WHEN s_suppkey % 4 = 0 THEN 7 ELSE 0 END AS learned_at, CAST(CASE WHEN s_suppkey % 4 = 0 THEN 4 WHEN s_suppkey % 3 = 0 THEN 8 ELSE 3 END AS BIGINT) AS times_used FROM supplier WHERE s_suppkey % 5 <> 0""",
    "placed_mappings": """WITH m AS (SELECT c_custkey AS c, c_name, list_filter([CASE WHEN c_custkey % 5 <> 0 THEN 'balance' END, CASE WHEN c_custkey % 3 <> 0 THEN 'credit' END, 'date', CASE WHEN c_custkey % 2 <> 0 THEN 'debit' END, 'narration'], lambda f: f IS NOT NULL) AS f FROM customer)
SELECT 'llm-inferred-' || left(md5(CAST(c AS VARCHAR)), 8) AS layout_id, c_name AS bank, array_to_string(f, ',') AS fields, CAST(1 + CASE WHEN c % 2 <> 0 THEN 2 ELSE 0 END + CASE WHEN c % 3 <> 0 THEN 3 ELSE 0 END + CASE WHEN c % 5 <> 0 THEN 4 ELSE 0 END AS BIGINT) AS sum_of_columns FROM m""",
}
