"""Columns of a grid against plain bins, rows to transactions, checks, edits, exports and streams."""

import io
import math
import random
import zipfile
from collections import defaultdict
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.audit import audit_rows, checks, first_offenders, report, row_messages
from ledgerloom.operators.columns import build_grid, column_edges, coverage, nearest_space, split_run, with_band
from ledgerloom.operators.convert import convert
from ledgerloom.operators.detection import detect_layout
from ledgerloom.operators.grid import ITEMS_OF_TASK, cluster_rows, tasks_for
from ledgerloom.operators.layouts import SEPARATE, Layout, layout_table
from ledgerloom.operators.ledger import apply_edits
from ledgerloom.operators.parse import merge_rows, parse_statements, statement_meta
from ledgerloom.plans.printed import grid_edges, header_binding
from ledgerloom.sinks.exports import EXPORTERS, export_files, find_exporter, option_errors, workbook_summary
from ledgerloom.sinks.workbook import workbooks
from ledgerloom.sources.pages import is_pdf, scan_errors, upload_error
from ledgerloom.streaming.state import Progress, audit_stream, limit_stream, read_results, revalidate_stream

ITEMS = "statement_id long, page long, x double, y double, width double, height double, font_size double, seq long, text string"


def plain_edges(rows):
    """The ladder over dense bins. rows: lists of (x, width, text), in reading order."""
    def profile(some, width):
        low = min(x for r in some for x, _, _ in r)
        high = max(x + max(w, 1) for r in some for x, w, _ in r)
        bins = [0] * (int(-(-(high - low) // width)) + 1)
        for r in some:
            for b in {b for x, w, _ in r for b in range(int((x - low) // width), min(len(bins), int(-(-(x + max(w, 1) - low) // width))))}:
                bins[b] += 1
        return low, bins

    def quiet(bins, leak, least):
        """(start, end) of stretches of low bins that are inside."""
        since = None
        for b, n in enumerate(bins):
            if n <= leak:
                since = b if since is None else since
            else:
                if since and b - since >= least:
                    yield since, b
                since = None

    def near(values):
        out = []
        for v in sorted(set(values)):
            if not out or v - out[-1] > 8:
                out.append(v)
        return out

    band = [r for r in rows if any("/" in t for _, _, t in r) and any("." in t for _, _, t in r)]
    if len(band) >= 5:
        low, bins = profile(band, 1)
        edges = [low, *(low + s for s, _ in quiet(bins, max(1, int(len(band) * 0.2)), 3))]
        if len(edges) >= 3:
            return edges
    wide, cover = [r for r in rows if len(r) >= 3], []
    if wide:
        low, bins = profile(wide, 3)
        places, b = [], 1
        while b < len(bins):
            if bins[b] <= bins[b - 1]:
                b += 1
                continue
            start, flat = b, 0
            while b + 1 < len(bins) and (bins[b + 1] > bins[b] or (bins[b + 1] == bins[b] and flat < 2)):
                flat = 0 if bins[b + 1] > bins[b] else flat + 1
                b += 1
            if bins[b] - bins[start - 1] >= max(2, max(bins) * 0.15):
                places.append(start)
            b += 1
        places += [e for _, e in quiet(bins, max(1, int(len(wide) * 0.08)), 2)]
        cover = near([low, *(low + 3 * p for p in places)])
        if len(cover) >= 3:
            return cover
    found = defaultdict(list)
    for r in rows:
        for x, _, _ in r:
            found[int((x / 3 + 0.5) // 1)].append(x)
    peaks = [(len(found[b]) + len(found.get(b - 1, ())) + len(found.get(b + 1, ())), sum(found[b]) / len(found[b])) for b in found]
    taken = []
    for weight, x in sorted(peaks, key=lambda p: -p[0]):
        if weight >= max(3, -(-len(rows) * 10 // 100)) and all(abs(x - t) >= 6 for t in taken):
            taken.append(x)
    return sorted(taken) if len(taken) > len(cover) else cover


def test_edges_against_plain_bins(spark):
    rnd, items, want = random.Random(4), [], {}
    for s in range(40):
        columns = sorted(rnd.sample(range(20, 500, rnd.choice((15, 40))), rnd.randint(2, 6)))
        rows = []
        for n in range(rnd.randint(1, 14)):
            line = []
            for c in columns:
                if rnd.random() < 0.8:
                    x = c + rnd.choice((0, 0, 0, rnd.randint(0, 8)))
                    line.append((float(x), float(rnd.randint(3, 35)), "x"))
            if rnd.random() < 0.6 and len(line) >= 2:
                line[0], line[-1] = (*line[0][:2], "01/04/2024"), (*line[-1][:2], "5.00")
            if line:
                rows.append(sorted(line))
        if not rows:
            continue
        want[s] = plain_edges(rows)
        items += [(s, n // 6, x, 20.0 * n, w, 8.0, 8.0, i, t) for n, r in enumerate(rows) for i, (x, w, t) in enumerate(r)]
    df = spark.createDataFrame(items, ITEMS)
    pages = ["statement_id", "page"]
    got = {r.statement_id: r.edges for r in column_edges(with_band(cluster_rows(df, pages), [*pages, "row_no"]), "statement_id", pages).collect()}
    assert {s: [round(e, 6) for e in v] for s, v in got.items()} == {s: [round(e, 6) for e in v] for s, v in want.items()}


def test_runs_are_split_at_spaces(spark):
    kind = "r struct<x:double,seq:long,width:double,font_size:double,text:string>"
    runs = [((100.0, 0, 100.0, 8.0, "PAY RENT R123456789X"),), ((100.0, 0, 100.0, 8.0, "ABCDEFGHIJKLMNOPQRST"),), ((100.0, 0, 60.0, 8.0, "A B C"),)]
    out = spark.createDataFrame(runs, kind).select(split_run(F.col("r"), F.array(*map(F.lit, (20.0, 98.0, 150.0)))).alias("p")).collect()
    assert [[(p.col, p.run.text, p.run.x) for p in r.p] for r in out] == [[(1, "PAY RENT", 98.0), (2, "R123456789X", 150.0)], [(1, "ABCDEFGHIJKLMNOPQRST", 100.0)], [(1, "A B C", 100.0)]]
    at = spark.range(1).select(nearest_space(F.lit("ab cd ef"), F.lit(4)).alias("a"), nearest_space(F.lit("abcdefgh"), F.lit(4)).alias("b"), nearest_space(F.lit(" a"), F.lit(0)).alias("c")).head()
    assert tuple(at) == (5, None, None)


HEADER = ["Date", "Narration", "Ref", "Debit", "Credit", "Balance"]
OWN = Layout("own", "Own Bank", ("dd-MM-yyyy",), SEPARATE, {"date": "^date", "narration": "narration", "ref_no": "^ref", "debit": "debit", "credit": "credit", "balance": "balance"})


def parse(spark, rows, layout=OWN, given=None):
    grid = spark.createDataFrame([(1, i, c, [float(k) for k in range(6)]) for i, c in enumerate(rows)], "statement_id long, row_seq int, cells array<string>, edges array<double>")
    layouts = layout_table(spark, (layout,)).withColumn("statement_id", F.lit(1).cast("long"))
    if given is not None:
        layouts = layouts.withColumn("given_seq", F.lit(given))
    return parse_statements(grid, layouts, (layout.formats,)), layouts


def test_rows_to_transactions(spark):
    rows = [["Own Bank", "", "", "", "", ""], HEADER, ["", "OPENING BALANCE B/F", "", "", "", "100.00"], ["01-04-2025", "CASH DEPOSIT", "", "0.00", "5,000.00", "5,100.00"], ["", "KUMAR-RENT", "R9", "", "", ""], ["14:06", "APRIL 2024", "", "", "", "DR"], HEADER, ["", "MORE", "", "", "", ""],
            ["02-04-2025", "ZERO ROW", "", "0.00", "0.00", "1,000.00"], ["03-04-2025", "BOTH", "X", "100.00", "200.00", "INR 3,013.96 DR"], ["", "", "", "", "", ""], ["Page 2", "of 3", "", "", "", ""], ["", "lost", "", "", "", ""], ["04-04-2025", "", "", "", "7.00", "8.00 MUM"], ["05-04-2025", "no balance", "", "1", "", ""]]
    out, layouts = parse(spark, rows)
    got = [(r.serial, str(r.txn_date), r.narration, r.narration_lines, r.ref_no, r.debit, r.credit, float(r.balance), r.confidence, r.issues) for r in out.orderBy("serial").collect()]
    both = "Both the debit and credit columns held a value; the debit was used."
    assert got == [
        (1, "2025-04-01", "CASH DEPOSIT KUMAR-RENT APRIL 2024 MORE", ["CASH DEPOSIT", "KUMAR-RENT", "APRIL 2024", "MORE"], "R9", None, Decimal("5000.00"), -5100.0, "high", []),
        (2, "2025-04-03", "BOTH", ["BOTH"], "X", Decimal("100.00"), None, -3013.96, "low", [both]),
        (3, "2025-04-04", "(no narration)", None, None, None, Decimal("7.00"), 8.0, "medium", [])]
    assert {(float(r.opening), r.opening_inferred, r.reversed) for r in out.collect()} == {(100.0, False, False)}
    meta = statement_meta(out, layouts, spark.createDataFrame([], "statement_id long, stated_count int")).head()
    assert (meta.bank_name, meta.template_id, float(meta.closing), meta.notices) == ("Own Bank", "own", 8.0, [])


def test_newest_first_and_numbered_columns(spark):
    rows = [["a", "b", "c", "d", "e", "f"], ["03-04-2025", "three", "", "", "30", "660"], ["02-04-2025", "two", "", "", "20", "630"], ["01-04-2025", "one", "", "", "10", "610"]]
    numbered = Layout("n", "N", ("dd-MM-yyyy",), SEPARATE, {"date": 0, "narration": 1, "debit": 3, "credit": 4, "balance": 5})
    out, layouts = parse(spark, rows, numbered, given=0)
    got = [(r.serial, r.narration, float(r.opening), r.opening_inferred, r.reversed) for r in out.orderBy("serial").collect()]
    assert got == [(1, "one", 600.0, True, True), (2, "two", 600.0, True, True), (3, "three", 600.0, True, True)]
    assert len(statement_meta(out, layouts, spark.createDataFrame([], "statement_id long")).head().notices) == 2
    assert parse(spark, [["x"] * 6, ["01-04-2025", "one", "", "", "10", "610"]])[0].count() == 0
    assert parse(spark, [HEADER])[0].count() == 0


def test_wrapped_rows_before_any_transaction_stand_alone(spark):
    at = F.struct(F.lit(0).alias("date"), F.lit(1).alias("narration"), F.lit(None).cast("int").alias("ref_no"), *(F.lit(None).cast("int").alias(c) for c in ("debit", "credit", "amount")), F.lit(2).alias("balance"))
    rows = [(1, 0, "C", ["", "a", ""]), (1, 1, "B", ["", "", ""]), (1, 2, "T", ["d", "b", "5"]), (1, 3, "B", ["", "", ""]), (1, 4, "C", ["", "c", "Dr"]), (1, 5, "C", ["", "", "Cr"])]
    got = [(r.row_seq, r.cells) for r in merge_rows(spark.createDataFrame(rows, "statement_id long, row_seq int, kind string, cells array<string>").withColumn("at", at)).orderBy("row_seq").collect()]
    assert got == [(0, ["", "a", ""]), (1, ["", "", ""]), (2, ["d", "b c", "5 Dr"])]


def txn(spark, rows):
    return spark.createDataFrame([(1, i, date(2024, 4, d), *(x if x is None else Decimal(str(x)) for x in (debit, credit, balance, opening))) for i, (d, debit, credit, balance, opening) in enumerate(rows, 1)], "statement_id long, serial int, txn_date date, debit decimal(18,2), credit decimal(18,2), balance decimal(18,2), opening decimal(18,2)")


BASE = [(1, None, 25000, 125000, 100000), (2, 12000, None, 113000, 100000), (3, 4500, None, 108500, 100000)]


@pytest.mark.parametrize(("change", "status", "offending", "ok"), [
    ({}, ["pass", "pass", "pass", "pass"], [], True),
    ({0: (1, 25000, None, 125000, 100000)}, ["fail", "fail", "pass", "pass"], [1], False),
    ({1: (2, 12000, None, 131000, 100000)}, ["fail", "pass", "pass", "pass"], [2, 3], False),
    ({1: (2, 12000, None, 113000.01, 100000), 2: (3, 4500, None, 108500.01, 100000)}, ["pass", "pass", "pass", "pass"], [], True),
    ({2: (3, 4500, None, 108500.02, 100000)}, ["fail", "fail", "pass", "pass"], [3], False),
    ({1: (1, 12000, None, 113000, 100000), 0: (2, None, 25000, 125000, 100000)}, ["pass", "pass", "fail", "pass"], [], False),
    ({i: (*BASE[i][:4], None) for i in range(3)}, ["pass", "skipped", "pass", "pass"], [], True)])
def test_checks(spark, change, status, offending, ok):
    rows = audit_rows(txn(spark, [change.get(i, r) for i, r in enumerate(BASE)]))
    out = report(rows, spark.createDataFrame([(1, 3)], "statement_id long, stated_count long"))
    got = checks(out).orderBy("check_no").collect()
    assert [r.status for r in got] == status and got[0].offending_rows == offending and out.head().ok is ok
    assert checks(report(rows)).where("check_no = 4").head().status == "skipped"
    assert [r.serial for r in rows.where(F.size(row_messages()) > 0).orderBy("serial").collect()] == sorted({*offending, *got[2].offending_rows})


def test_first_offenders(spark):
    row = spark.range(1).select(first_offenders(F.sequence(F.lit(1), F.lit(15))).alias("f")).head().f
    assert (row.named, row.more) == (list(range(1, 13)), 3)


def test_edits_keep_one_row(spark):
    rows = txn(spark, BASE).withColumn("issues", F.array(F.lit("No Dr/Cr flag found for this row; recorded as a credit."), F.lit("odd"))).withColumn("confidence", F.lit("low"))
    edits = spark.createDataFrame([(1, 1, "debit", "5", 1), (1, 1, "credit", "6", 2), (1, 1, "narration", "x", 3), (1, 2, "date", "", 1), (1, 2, "balance", "zz", 2), (1, 3, "debit", " ", 1), (9, 9, "debit", "1", 1)], "statement_id long, serial int, field string, value string, at int")
    got = [(r.serial, r.debit, r.credit, r.issues, r.confidence, r.edited) for r in apply_edits(rows, edits, "at").orderBy("serial").collect()]
    both = ["No Dr/Cr flag found for this row; recorded as a credit.", "odd"]
    assert got == [(1, None, Decimal("6.00"), ["odd"], "high", True), (2, Decimal("12000.00"), None, both, "low", False), (3, None, None, ["odd"], "low", True)]


def full(spark):
    rows = [(1, 2, date(2024, 4, 2), None, '=SUM("a")', ["=SUM", '"a"'], None, Decimal("1.50"), None, Decimal("-12.00"), "low", ["a", "b"]), (1, 1, date(2024, 4, 1), date(2024, 4, 1), "x", None, "R1", None, Decimal("18.00"), Decimal("5.00"), "high", [])]
    return spark.createDataFrame(rows, "statement_id long, serial int, txn_date date, value_date date, narration string, narration_lines array<string>, ref_no string, debit decimal(18,2), credit decimal(18,2), balance decimal(18,2), confidence string, issues array<string>")


def test_files(spark, tmp_path):
    rows = full(spark)
    export_files(rows, str(tmp_path / "csv"), "csv")
    export_files(rows, str(tmp_path / "import"), "ledger-csv", {"bankCode": "B"})
    read = lambda name: next((tmp_path / name).glob("part-*/1 *.csv")).read_bytes().decode()
    assert read("csv") == "Serial,Date,Value Date,Narration,Ref No.,Debit,Credit,Balance,Confidence,Issues\r\n1,01/04/2024,01/04/2024,x,R1,,18.00,5.00,high,\r\n" + "2,02/04/2024,,\"'=SUM(\"\"a\"\")\",,1.50,,'-12.00,low,a; b\r\n"
    assert read("import") == '"bk_cd","prt_cd","tr_date","amtp","amtr","rem"\n"B","SUSP","01-04-2024","","18","x"\n"B","SUSP","02-04-2024","1.5","","=SUM\n""a"""\n'
    assert option_errors("ledger-csv") == 'The "Accounting import (.csv)" format needs a bank code.' and option_errors("odd") == 'Unknown export format "odd".' and option_errors("csv") is None
    assert find_exporter("csv") is EXPORTERS[0] and find_exporter("x") is None
    with pytest.raises(ValueError, match="shape"):
        export_files(rows.withColumn("txn_date", F.lit(None).cast("date")), str(tmp_path / "no"), "csv")


def test_workbook(spark):
    rows = full(spark)
    meta = spark.createDataFrame([(1, "B & Co", "t", None, None, None, 2, "template", Decimal("-11.50"))], "statement_id long, bank_name string, template_id string, account_masked string, period_from date, period_to date, page_count int, parsed_by string, opening decimal(18,2)")
    content = workbooks(rows, workbook_summary(rows, meta)).head().content
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        first, second = (z.read(f"xl/worksheets/sheet{i}.xml").decode() for i in (1, 2))
        assert "xl/styles.xml" in z.namelist()
    assert first.count("<row ") == 3 and "=SUM(" in first and "<v>45383</v>" in first and second.count("<row ") == 15 and "B &amp; Co" in second and "No — review before use" in second


def test_uploads_and_scans(spark):
    files = spark.createDataFrame([(b"%PDF-1.7", 8), (b"%PDF", 4), (b"PK..xx", 6), (b"%PDF-1", 30_000_000), (None, 0)], "c binary, n long")
    assert [r.e for r in files.select(upload_error(F.col("c"), F.col("n")).alias("e")).collect()] == [None, "NOT_A_PDF", "NOT_A_PDF", "FILE_TOO_LARGE", "NOT_A_PDF"]
    assert files.where(is_pdf(F.col("c"))).count() == 2
    pages = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 1)], "statement_id long, page long")
    items = spark.createDataFrame([(1, 1)] * 20 + [(1, 2)] * 3, "statement_id long, page long")
    images = spark.createDataFrame([(1, 2, 600, 800), (1, 1, 900, 900), (2, 1, 120, 120), (3, 1, None, None)], "statement_id long, page long, width int, height int")
    got = {r.statement_id: (r.scanned_pages, r.error_code, r.error_message) for r in scan_errors(pages, items, images).collect()}
    assert got[1] == ([2], "SCANNED_PDF_UNSUPPORTED", "Page 2 contain no selectable text (scanned image). Refusing to emit partial output.") and got[2] == ([], None, None) and got[3][0] == [1] and got[3][2].startswith("This PDF")


def test_conversion_of_statements_without_candidates(spark):
    statements = spark.createDataFrame([(1, False), (2, True), (3, True), (4, None)], "statement_id long, ask boolean")
    tried = spark.createDataFrame([(3, 2, "B", False, False), (3, 4, "B", True, True), (4, 2, "B", False, True)], "statement_id long, tier long, bank string, parsed boolean, ok boolean")
    got = {r.statement_id: (r.tier, r.stored, r.error_code, len(r.notices)) for r in convert(statements, tried, "ask").collect()}
    assert got == {1: (None, False, "UNSUPPORTED_LAYOUT", 0), 2: (None, False, "LLM_UNAVAILABLE", 0), 3: (4, True, None, 3), 4: (None, False, "PARSE_FAILED", 1)}


def stream(spark, tmp_path, make, batches, schema):
    """Runs a stream of one file a batch and gives its rows."""
    source = tmp_path / "in"
    seen = Progress(lambda *_: None)
    spark.streams.addListener(seen)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        given = spark.readStream.schema(schema).parquet(str(source))
        out = make(given)
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    spark.streams.removeListener(seen)
    return spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()


def test_limiter_stream(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, "a" if i % 3 else "b", start + timedelta(seconds=7 * i)) for i in range(40)]
    got = {r.event_id: r.allowed for r in stream(spark, tmp_path, lambda d: limit_stream(d, "key", "ts", "event_id", 2, 60.0), [rows[:15], rows[15:40]], "event_id long, key string, ts timestamp")}
    want, state = {}, {}
    for i, k, t in rows:
        opened, n = state.get(k, (None, 0))
        if opened is None or (t - opened).total_seconds() >= 60:
            opened, n = t, 0
        state[k] = (opened, n + 1)
        want[i] = n + 1 <= 2
    assert got == want


def test_audit_stream(spark, tmp_path):
    rows = [(1, 1, Decimal("100"), None, Decimal("5"), Decimal("105")), (1, 2, Decimal("100"), Decimal("5"), None, Decimal("100")), (2, 1, None, None, Decimal("5"), Decimal("9")), (1, 3, Decimal("100"), Decimal("1"), None, Decimal("98")), (2, 2, None, Decimal("1"), None, Decimal("8"))]
    got = {(r.statement_id, r.serial): (r.expected and float(r.expected), r.balance_error) for r in stream(spark, tmp_path, audit_stream, [rows[:3], rows[3:]], "statement_id long, serial long, opening decimal(18,2), debit decimal(18,2), credit decimal(18,2), balance decimal(18,2)")}
    assert got == {(1, 1): (105.0, False), (1, 2): (100.0, False), (2, 1): (None, False), (1, 3): (99.0, True), (2, 2): (8.0, False)}


def test_grid_of_statements_without_columns(spark):
    items = spark.createDataFrame([(1, 1, 10.0, 5.0, 8.0, 8.0, 8.0, 0, "Hello"), (1, 1, 60.0, 5.0, 8.0, 8.0, 8.0, 1, "there"), (1, 2, 10.0, 5.0, 8.0, 8.0, 8.0, 0, None)], ITEMS)
    got = [(r.row_seq, r.page, r.cells) for r in build_grid(items).orderBy("row_seq").collect()]
    assert [g[:2] for g in got] == [(0, 1), (1, 2)] and " ".join(got[0][2]).split() == ["Hello", "there"]
    assert build_grid(items.where("false")).count() == 0


def test_coverage_counts_rows_with_ink(spark):
    """Against a count bin by bin; runs of a row overlap, touch, repeat and have no width."""
    pick = random.Random(7)
    items = [(k, 1, round(pick.uniform(20, 300), 1), 24.0 * i, pick.choice((None, 0.0, 30.0, round(pick.uniform(1, 90), 1))), 8.0, 8.0, seq, "Jan 28 1995 1.00" if pick.random() < 0.3 else t)
             for k in (1, 2) for i in range(30) for seq, t in enumerate(("28/01/1995", "x", "1,234.56", "y", "z")[: pick.randint(1, 5)])]
    row = ["statement_id", "page", "row_no"]
    placed = with_band(cluster_rows(spark.createDataFrame(items, ITEMS), row[:2]), row)
    want = {}
    for shape, size, kept in (("band", 1.0, lambda r: r.band), ("coverage", 3.0, lambda r: r.runs >= 3)):
        for k in (1, 2):
            rows = [r for r in placed.collect() if r.statement_id == k and kept(r)]
            right = lambda r: r.x + max(r.width or 1.0, 1.0)
            least, n_bins = min(r.x for r in rows), math.ceil((max(map(right, rows)) - min(r.x for r in rows)) / size) + 1
            inked = {(r.row_no, b) for r in rows for b in range(math.floor((r.x - least) / size), min(n_bins, math.ceil((right(r) - least) / size)))}
            want[k, shape] = (least, len({r.row_no for r in rows}), [sum((n, b) in inked for n in {r.row_no for r in rows}) for b in range(n_bins)])
    got = {}
    for r in coverage(placed, "statement_id").collect():
        got[r.statement_id, r.shape] = (r.least_x, r.n_rows, [s.n for s in r.segments for _ in range(s.size)])
    assert got == want


def test_tasks_of_a_grid_grow_with_its_items(spark):
    cores = spark.sparkContext.defaultParallelism
    assert (tasks_for(spark, 0), tasks_for(spark, 3 * cores * ITEMS_OF_TASK), tasks_for(spark, cores * ITEMS_OF_TASK + 1)) == (cores, 3 * cores, cores + 1)
    items = spark.range(500).selectExpr("id % 50 statement_id", "1 page", "1d x", "cast(id div 50 as double) * 24 y", "9d width", "8d height", "8d font_size", "id seq", "'a' text")
    dealt = cluster_rows(items, ["statement_id", "page"], tasks=7)
    assert dealt.rdd.getNumPartitions() == 7 and sorted(map(tuple, dealt.collect())) == sorted(map(tuple, cluster_rows(items, ["statement_id", "page"]).collect()))


def test_rows_of_a_grid_are_sorted_and_dealt_as_told(spark):
    """grid_edges: no task's share is left to the compressed size of its items."""
    plan = grid_edges(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 3


def test_columns_of_rows_with_a_layouts_own_dates(spark):
    """Few wide balances: the coverage takes their column for two, the rows with a day and an amount do not."""
    items = []
    for i in range(40):
        balance = "1,234,567.89 Dr" if i == 0 else "234,567.89 Dr." if i < 3 else "34,567.89 Dr"
        for seq, (x, t) in enumerate(((40.0, "Jan 28 1995"), (200.0, "order 000000001 in"), (520.0 if i % 2 else 620.0, "11,234.56"), (760.0, balance))):
            w = len(t) * 4.4
            items.append((1, 1, x - w if seq > 1 else x, 24.0 * i, w, 8.0, 8.0, seq, t))
    got = build_grid(spark.createDataFrame(items, ITEMS), formats=("MMM dd yyyy",)).collect()
    assert len(got) == 40 and all(len(r.cells) == 5 and "Dr" in r.cells[4] and r.cells[3 - r.row_seq % 2] == "11,234.56" for r in got)


def test_printed_statement_with_few_wide_balances(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.1/orders.parquet").where("o_custkey div 10 = 382").write.parquet(str(tmp_path / "orders.parquet"))
    assert [(r.header_seq, r.date_at, r.narration_at, r.debit_at, r.credit_at, r.balance_at) for r in header_binding(spark, str(tmp_path)).collect()] == [(4, 0, 1, 2, 3, 4)]


def test_reports_follow_edits(spark, tmp_path):
    rows = txn(spark, [(1, None, 5, 105, 100), (2, 7, None, 99, 100)])
    schema = "statement_id long, serial int, field string, value string"
    spark.createDataFrame([(1, 2, "debit", "6")], schema).coalesce(1).write.parquet(str(tmp_path / "edits"))
    revalidate_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "edits")), rows, str(tmp_path / "reports"), str(tmp_path / "state")).awaitTermination()
    assert [(r.statement_id, r.n_errors, r.ok, r.batch) for r in spark.read.parquet(str(tmp_path / "reports")).collect()] == [(1, 0, True, 0)]


def test_result_lines_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"type": "result", "ok": true}\nbroken\n')
    query = read_results(spark, str(tmp_path / "in"), "type string, ok boolean").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(str((r.type, r.ok)) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["('result', True)", "(None, None)"]


def test_layouts_of_ones_own(spark):
    pages = spark.createDataFrame([("my bank",), ("axis bank UTIB0000789",)], "t string")
    own = (("mine", "My Bank", lambda text: F.when(text.contains("my"), float("inf")).otherwise(0.9)), ("axis", "Axis", ((r"(?i)axis\s+bank", 1.0),)))
    assert [(r.layout_id, r.confidence) for r in detect_layout(pages, "t", layouts=own).collect()] == [(None, None), ("axis", 1.0)]
