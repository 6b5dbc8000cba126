"""The whole conversion, the store of layouts, files by the data source, raw runs and SQL names."""

import io
import json
import re
import zipfile
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import DataFrameReader
from pyspark.sql import functions as F

from ledgerloom.functions.names import register_names
from ledgerloom.functions.text import read_amount, read_date
from ledgerloom.operators.columns import build_grid
from ledgerloom.operators.convert import LEARNED_HINT, MESSAGES, NO_FLAGS, NO_MOVES, convert_statements
from ledgerloom.operators.layouts import layout_fingerprint
from ledgerloom.operators.ledger import movement_flag, movement_separate, movement_signed
from ledgerloom.operators.store import LayoutStore
from ledgerloom.plans.printed import texts_of
from ledgerloom.plans.reports import exported_files
from ledgerloom.sinks.exports import BAD_SHAPE, export_errors, export_files, option_errors
from ledgerloom.sinks.files import FORMAT, register
from ledgerloom.sinks.workbook import workbook
from ledgerloom.sources import runs
from tests.test_statements import full
from tests.test_streams import GIVEN, MAPPINGS, STORE, statement

LABELS = {"date": "Tran Date", "narration": "Particulars", "debit": "Debit", "credit": "Credit", "balance": "Balance"}
PLACES = {"date": 0, "narration": 1, "debit": 2, "credit": 3, "balance": 4}


@pytest.fixture(scope="module")
def printed(spark):
    """Ten copies of one statement, under a bank that no shipped layout knows but for the first, and their fingerprints."""
    one = statement(spark)
    own = F.when(F.col("statement_id") > 1, F.when(F.col("text") == "Axis Bank", "Some Bank").when(F.col("text") == "IFSC UTIB0000123", "no code").otherwise(F.col("text"))).otherwise(F.col("text"))
    items = one.drop("statement_id").crossJoin(spark.range(1, 11).withColumnRenamed("id", "statement_id")).withColumn("text", own).cache()
    prints = {r.statement_id: r.fingerprint for r in layout_fingerprint(build_grid(items), texts_of(items).select("statement_id", F.col("first_page_text").alias("text"))).collect()}
    return items, prints


def test_each_way_through_the_chain(spark, printed):
    items, prints = printed
    assert prints[1] != prints[2] == prints[10]
    header = build_grid(items).where("statement_id = 2 and cells[0] = 'Tran Date'").head().row_seq
    given = spark.createDataFrame([(1, None, False, None, None), (2, None, False, None, None), (3, None, True, None, None), (4, None, True, None, None), (5, None, True, None, None), (6, None, True, None, None), (7, None, True, None, None),
                                   (8, LEARNED_HINT + "mine", None, None, None), (9, LEARNED_HINT + "none", False, None, None), (10, None, True, "RATE_LIMITED", "wait"), (77, None, False, None, None)], GIVEN)
    store = spark.createDataFrame([("mine", "My Bank", ["dd-MM-yyyy"], "separate-dr-cr", LABELS), (prints[2], "Stale Bank", ["dd-MM-yyyy"], "separate-dr-cr", {**LABELS, "balance": "Gone"})], STORE)
    place = lambda **more: {**PLACES, **more}
    mappings = spark.createDataFrame([(3, "Mapped", ["dd-MM-yyyy"], "separate-dr-cr", PLACES, header), (4, "Lacking", ["dd-MM-yyyy"], "separate-dr-cr", place(debit=None, credit=None), header), (5, "Flagless", ["dd-MM-yyyy"], "amount-plus-flag", place(amount=2), header), (6, "Below", ["dd-MM-yyyy"], "separate-dr-cr", PLACES, 999), (1, "unasked", ["dd-MM-yyyy"], "separate-dr-cr", PLACES, header)], MAPPINGS)
    made = convert_statements(given, items, store, mappings)
    got = {r.statement_id: r for r in made.results.collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 77]
    assert {i: (r.tier, r.error_code, r.error_message) for i, r in got.items()} == {
        1: (2, None, None), 2: (None, "UNSUPPORTED_LAYOUT", MESSAGES["UNSUPPORTED_LAYOUT"]), 3: (4, None, None), 4: (None, "UNSUPPORTED_LAYOUT", NO_MOVES), 5: (None, "UNSUPPORTED_LAYOUT", NO_FLAGS),
        6: (None, "NO_TRANSACTIONS_FOUND", MESSAGES["NO_TRANSACTIONS_FOUND"]), 7: (None, "LLM_UNAVAILABLE", MESSAGES["LLM_UNAVAILABLE"]), 8: (1, None, None), 9: (None, "UNSUPPORTED_LAYOUT", MESSAGES["UNSUPPORTED_LAYOUT"]), 10: (None, "RATE_LIMITED", "wait"), 77: (None, "UNSUPPORTED_LAYOUT", MESSAGES["UNSUPPORTED_LAYOUT"])}
    assert got[1].parsed_by == "template" and got[3].parsed_by == "llm" and got[3].reconciles and got[3].stored and not got[1].stored
    assert [i for i, r in got.items() if r.evicted] and {i for i, r in got.items() if r.evicted} == {2, 3, 4, 5, 6, 7, 9} and {i for i, r in got.items() if r.used} == {8}
    assert got[8].notices == ["Opening balance inferred from the first transaction; the statement did not print a brought-forward line.", 'Parsed using the "My Bank" layout you selected — no AI was used.']
    assert [n[:24] for n in got[3].notices] == ["The stored Stale Bank la", "Opening balance inferred", "No built-in template mat", 'This layout has been sav']
    assert got[1].closing == Decimal("100.00") and got[1].opening == Decimal("100.00") and got[1].n_rows == 6
    rows = {r.statement_id: r["count"] for r in made.transactions.groupBy("statement_id").count().collect()}
    assert rows == {1: 6, 3: 6, 8: 6}
    changes = {(r.op, r.key): (r.uses, r.bank, r.columns) for r in made.changes.collect()}
    assert changes == {("use", "mine"): (1, None, None), ("delete", prints[2]): (0, None, None), ("put", prints[2]): (1, "Mapped", LABELS)}


def test_conversion_of_nothing(spark, printed):
    none = [spark.createDataFrame([], s) for s in (GIVEN, STORE, MAPPINGS)]
    made = convert_statements(none[0], printed[0], none[1], none[2])
    assert made.results.count() == made.transactions.count() == made.changes.count() == 0


CHANGES = "op string, key string, uses long, at int, bank string, formats array<string>, style string, columns map<string,string>, learned_at timestamp"


def test_store_after_batches(spark, tmp_path):
    store = LayoutStore(spark, str(tmp_path / "store"), 4)
    put = lambda key, at, bank, day: ("put", key, 1, at, bank, ["dd/MM/yyyy"], "separate-dr-cr", {"date": "Date"}, datetime(2024, 1, day))
    other = lambda op, key, at, uses=1: (op, key, uses, at, None, None, None, None, None)
    apply = lambda *rows: store.apply(spark.createDataFrame(rows, CHANGES))
    read = lambda: {r.key: (r.bank, r.times_used) for r in store.rows().collect()}
    assert read() == {}
    apply(*[put(f"k{i}", 1, f"B{i}", 1 + i) for i in range(9)], other("use", "k0", 2, 5), other("use", "absent", 1))
    assert read() == {f"k{i}": (f"B{i}", 6 if i == 0 else 1) for i in range(9)}
    apply(other("delete", "k1", 1), put("k1", 2, "new", 20), other("use", "k1", 3, 2), put("k2", 1, "x", 9), other("delete", "k2", 2), other("use", "k2", 3), other("use", "k3", 1), other("use", "k3", 2), (None, None, None, None, None, None, None, None, None))
    want = {f"k{i}": (f"B{i}", 1) for i in range(4, 9)} | {"k0": ("B0", 6), "k1": ("new", 3), "k3": ("B3", 3)}
    assert read() == want
    apply()
    apply(*[other("delete", f"k{i}", 1) for i in range(9) if i != 4])
    assert read() == {"k4": ("B4", 1)}
    apply(put("k2", 1, "again", 3))
    assert read() == {"k4": ("B4", 1), "k2": ("again", 1)} and [r.key for r in store.list(1).collect()] == ["k4"]
    assert [r.bank for r in store.get(spark.createDataFrame([("k2",), ("k9",), ("k2",)], "key string")).collect()] == ["again"]


def test_only_the_buckets_of_a_batch_are_rewritten(spark, tmp_path):
    store = LayoutStore(spark, str(tmp_path / "store"), 8)
    rows = [("put", f"k{i}", 1, 1, "B", ["dd/MM/yyyy"], "separate-dr-cr", {"date": "Date"}, datetime(2024, 1, 1)) for i in range(40)]
    store.apply(spark.createDataFrame(rows, CHANGES))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("part-*")}
    store.apply(spark.createDataFrame([("use", "k1", 1, 1, None, None, None, None, None)], CHANGES))
    kept = [p for p in before if p.exists()]
    assert len({p.parent for p in before} - {p.parent for p in kept}) == 1


META = "statement_id long, bank_name string, template_id string, account_masked string, period_from date, period_to date, page_count int, parsed_by string, opening decimal(18,2)"


def test_three_formats_are_written_and_replaced(spark, tmp_path):
    rows = full(spark)
    meta = spark.createDataFrame([(1, "B/Co", "t", None, None, None, 2, "template", Decimal("-11.50"))], META)
    for name, options in (("csv", {}), ("ledger-csv", {"bankCode": "B"}), ("xlsx", {})):
        for _ in range(2):
            export_files(rows, str(tmp_path / name), name, options, meta, "overwrite")
        found = [p for p in (tmp_path / name).rglob("*") if p.is_file() and p.name != "_SUCCESS" and not p.name.endswith(".crc")]
        assert [p.name for p in found] == [f"1 BCo statement.{name.split('-')[-1]}"] and not list((tmp_path / name).glob("_job-*"))
    with zipfile.ZipFile(next((tmp_path / "xlsx").rglob("*.xlsx"))) as z:
        assert "xl/worksheets/sheet2.xml" in z.namelist()
    export_files(rows, str(tmp_path / "csv"), "csv", {}, meta)
    assert len(list((tmp_path / "csv").rglob("*.csv"))) == 2


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    register(spark)
    rows = spark.range(0, 40, 1, 4).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("file_name"), F.when(F.col("id") == 39, F.raise_error(F.lit("odd")).cast("binary")).otherwise(F.encode(F.lit("x"), "UTF-8")).alias("content"))
    with pytest.raises(Exception, match="odd"):
        rows.write.format(FORMAT).mode("append").save(str(tmp_path / "out"))
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file()]
    apart = spark.createDataFrame([("a", b"1"), ("b", b"2"), ("a", b"3")], "file_name string, content binary").coalesce(1)
    with pytest.raises(Exception, match="stand together"):
        apart.write.format(FORMAT).mode("append").save(str(tmp_path / "apart"))
    assert not [p for p in (tmp_path / "apart").rglob("*") if p.is_file()]


def test_requests_are_checked_in_order(spark):
    assert option_errors("x" * 33) == BAD_SHAPE and option_errors("") == BAD_SHAPE and option_errors("odd", {"bankCode": "y" * 33}) == BAD_SHAPE
    assert option_errors("xlsx") is None and option_errors("ledger-csv", {"bankCode": " "}).endswith("needs a bank code.")
    got = {r.statement_id: (r.n_rows, r.ok) for r in export_errors(full(spark), spark.createDataFrame([(1,), (5,)], "statement_id long")).collect()}
    assert got == {1: (2, True), 5: (0, False)}


def test_workbook_without_control_characters():
    content = workbook([[("a\x00b\x0b\ud800c\td", 0)]], [[("x", 0)]])
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        assert ">abc\td<" in z.read("xl/worksheets/sheet1.xml").decode()


def test_raw_runs_from_files(spark, tmp_path):
    items = [{"str": "a", "transform": [1, 0, 0, 12, 5, 700], "width": 9, "height": 11}, {"str": " "}, {"str": "b", "transform": [1, 2]}, {"str": "c", "transform": [0, 3, 0, -4, None, 1], "height": -1}, {"str": "d", "transform": [0, 0, 0, 0, 7, 0], "height": 0}, {"transform": [1, 0, 0, 9, 1, 1]}]
    for i in (1, 2):
        Path(tmp_path / f"{i}.json").write_text(json.dumps({"statement_id": i, "pages": [{"page": 1, "height": 800, "items": items}, {"page": 2, "height": 100, "items": []}]}))
    runs.register(spark)
    raw = spark.read.format("raw-runs").load(str(tmp_path))
    assert raw.count() == 12
    got = [(r.text, r.x, r.y, r.width, r.height, r.font_size, r.seq) for r in runs.normalise_runs(raw).where("statement_id = 2").orderBy("seq").collect()]
    assert got == [("a", 5.0, 100.0, 9.0, 11.0, 12.0, 0), ("c", 0.0, 799.0, 0.0, 5.0, 5.0, 3), ("d", 7.0, 800.0, 0.0, 10.0, 10.0, 4)]
    (tmp_path / "3.json").write_text("{")
    with pytest.raises(Exception, match="3.json"):
        spark.read.format("raw-runs").load(str(tmp_path)).count()


def test_sql_names_are_the_expressions(spark):
    register_names(spark)
    texts = ["1,23,456.78 Cr", "(500)", "-5-", "Rs. 12", "12 Apr 2024", "31/02/2024", "01-02-70", "2024-05-06 10:30 am", None, "", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    df.createOrReplaceTempView("named_texts")
    got = spark.sql("SELECT t, ledger_amount(t) AS a, ledger_date(t) AS d FROM named_texts").collect()
    want = df.select("t", read_amount(F.col("t")).alias("a"), read_date(F.col("t")).alias("d")).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and sum(r.a is not None for r in got) == 3
    one = spark.sql("SELECT ledger_rupees(-1234567.5), ledger_rupees(12), ledger_flag('D.R.'), ledger_mask(' 123456789 '), ledger_mask('12')").head()
    assert tuple(one) == ("-₹12,34,567.50", "₹12.00", "Dr", "XXXXX6789", "12")
    plan = spark.sql("SELECT ledger_amount(t) FROM named_texts")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Udf", plan)


def test_digits_too_many_for_an_amount_are_none(spark):
    long = "12345678901234567890"
    df = spark.createDataFrame([(long, "5.00"), (long, None)], "d string, c string")
    got = df.select(movement_separate(F.col("d"), F.col("c")).alias("m"), movement_signed(F.col("d")).alias("s"), movement_flag(F.col("d"), F.lit("Dr")).alias("f")).collect()
    assert got[0].m.credit == Decimal("5.00") and got[0].m.debit is None and got[0].m.issue is None and got[1].m is None
    assert got[0].s is None and got[0].f is None


def test_grids_with_other_tuning(spark):
    items = statement(spark)
    size = lambda **k: build_grid(items, **k).selectExpr("size(edges) AS n", "y").collect()
    assert {r.n for r in size()} == {5}
    assert {r.n for r in size(gap=200.0, support=2.0)} != set() and len(size(row_part=40.0)) < len(size())


def test_exported_files_are_listed_by_folder(spark, monkeypatch):
    """A pattern of files would be looked up file by file on the driver."""
    paths, load = [], DataFrameReader.load
    monkeypatch.setattr(DataFrameReader, "load", lambda self, path=None, *a, **k: paths.append(path) or load(self, path, *a, **k))
    made = exported_files(spark, "/root/testdata/sf0.001")
    assert len(paths) == 3 and all(p.endswith("/part-*") for p in paths) and "csv_md5" in made.columns
