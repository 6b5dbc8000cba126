"""Steps that many statements share: done once, and not where they cannot find anything."""

import os
from array import array

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.text import read_amount, read_date, squeeze
from ledgerloom.operators import convert
from ledgerloom.operators.columns import build_grid
from ledgerloom.operators.detection import LAYOUTS, needle
from ledgerloom.plans import conversion, printed
from ledgerloom.sinks import files
from ledgerloom.sinks.files import FORMAT, FileWriter, Written, name_hash, register
from ledgerloom.sources.pages import first_page_text, page_text, statement_text
from ledgerloom.sources.shared import Stages

SF = "/root/testdata/sf0.001"
ITEMS = "statement_id long, page int, x double, y double, width double, height double, font_size double, seq int, text string"


def test_readers_of_blanks(spark):
    rows = [(1, "12\u200bJan\u200b2024"), (2, "x \u0085"), (3, "\ufeff 31/02/2024 "), (4, " 12 Jan 2024 (x) 10:42"), (5, "see 01/02/2024")]
    df = spark.createDataFrame(rows, "i int, t string")
    got = {r.i: (str(r.d), r.s) for r in df.select("i", read_date(F.col("t")).alias("d"), squeeze(F.col("t")).alias("s")).collect()}
    assert got[1] == ("2024-01-12", "12\u200bJan\u200b2024")
    assert got[2] == ("None", "x \u0085")
    assert got[3] == ("None", "31/02/2024") and got[4][0] == "2024-01-12" and got[5][0] == "None"
    amounts = spark.createDataFrame([("1,234.50",), ("(1,234.50)",), ("7 dr.",), ("-7 CR",), ("(7",), ("-7-",)], "t string")
    assert [None if v is None else float(v) for (v,) in amounts.select(read_amount(F.col("t"))).collect()] == [1234.5, -1234.5, -7.0, 7.0, None, None]


def test_needles():
    assert [needle(p) for p in (r"(?i)hdfc\s+bank", r"\bHDFC0\d{6}\b", r"(?i)chq\.?\s*no", r"ab?c", "ab{0,2}c", "a|b", r"\d+")] == ["hdfc", "hdfc0", "chq", "a", "a", None, None]
    assert all(needle(p) for _, _, marks in LAYOUTS for p, _ in marks if "|" not in p)


def test_grid_in_stages(spark):
    items = [(s, 0, x, 30.0 + 12 * r, 40.0, 8.0, 8.0, i, t) for s in (1, 2) for r in range(6) for i, (x, t) in enumerate(((40.0, f"0{r + 1}/01/2024"), (120.0, f"to {s}  x"), (299.0, f"{r}.50")))]
    df = spark.createDataFrame(items, ITEMS)
    written = []
    stages = Stages(spark, lambda name, rows: written.append((name, rows)))
    whole = sorted(map(str, build_grid(df).collect()))
    assert sorted(map(str, build_grid(df, stages=stages).collect())) == whole and len(whole) == 12
    assert written == [("placed", 36)]
    stages.drop()


def test_text_of_first_pages(spark):
    items = [(s, p, 40.0 + 60 * i, 30.0 + 12 * r, 40.0, 8.0, 8.0, i, f"{s}/{p}/{r}/{i}") for s, pages in ((1, (0, 1)), (2, (3, 7))) for p in pages for r in (0, 1) for i in (0, 1)]
    df = spark.createDataFrame(items, ITEMS)
    got = {r.statement_id: r.first_page_text for r in first_page_text(df).collect()}
    assert got == {r.statement_id: r.first_page_text for r in statement_text(page_text(df)).collect()} and got[2] == "2/3/0/0 2/3/0/1\n2/3/1/0 2/3/1/1"


def test_patterns_in_the_header_row_only(spark):
    plan = printed.header_binding(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_like" not in plan and "RLIKE lambda" not in plan
    assert not [line for line in plan.split("\n") if line.lstrip(" :+-").startswith("Filter") and "regexp_instr" in line]


def test_one_grid_for_a_conversion(spark, monkeypatch):
    def again(*args, **kw):
        pytest.fail("the grid is made again")

    monkeypatch.setattr(convert, "build_grid", again)
    assert conversion.printed_conversion(spark, SF).results.count() == spark.read.parquet(f"{SF}/orders.parquet").select(F.expr("o_custkey div 10")).distinct().count()


def test_files_are_read_by_folder(spark, tmp_path):
    register(spark)
    rows = spark.range(2500).select(F.format_string("%d a.txt", "id").alias("file_name"), F.encode(F.concat(F.lit("line "), F.col("id").cast("string")), "UTF-8").alias("content"))
    rows.repartition(3, "file_name").sortWithinPartitions("file_name").write.format(FORMAT).mode("append").save(str(tmp_path / "out"))
    read = spark.read.format(FORMAT).load(str(tmp_path / "out"))
    assert read.exceptAll(rows).count() == rows.exceptAll(read).count() == 0
    folders = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-")]
    assert read.rdd.getNumPartitions() == len(folders) <= 3


def test_names_come_to_the_driver_as_hashes(tmp_path, monkeypatch):
    writer = FileWriter(str(tmp_path / "out"), False)
    for folder, names in (("a", ["1 x", "2 x"]), ("b", ["3 x", "2 x"]), ("c", ["4 x"])):
        os.makedirs(f"{writer.staging}/{folder}")
        for n in names:
            open(f"{writer.staging}/{folder}/{n}", "w").close()
    made = {f: Written(f, array("Q", map(name_hash, names)).tobytes()) for f, names in (("a", ["1 x", "2 x"]), ("b", ["3 x", "2 x"]), ("c", ["4 x"]))}
    assert all(len(m.hashes) <= 16 for m in made.values())
    assert writer.twice([made["a"], made["c"]]) is None and writer.twice([]) is None
    assert writer.twice(list(made.values())) == "2 x"
    assert writer.twice([Written("c", array("Q", [name_hash("4 x")] * 2).tobytes())]) == "4 x"
    monkeypatch.setattr(files, "name_hash", lambda name: 7)  # two names of one hash are no name that comes twice
    assert writer.twice([Written("a", array("Q", [7, 7]).tobytes()), Written("c", array("Q", [7]).tobytes())]) is None
