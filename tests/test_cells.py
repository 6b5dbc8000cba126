import datetime

from pyspark.sql import functions as F

from ledgerloom.functions.cells import carries_forward, cell_amount, cell_date, cell_flag, confidence, is_amount_like, row_kind


def test_readers(spark):
    cells = ["5,000.00 Dr", "MUM 12.50 credit", "x", "", None, "0 Dr", "-3 -4", "01 Apr 2024 02/04/2024", "debit"]
    out = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i long, c string").select("i", cell_amount(F.col("c")).alias("a"), cell_date(F.col("c")).alias("d"), cell_flag(F.col("c")).alias("f")).orderBy("i").collect()
    assert [r.a and (float(r.a.magnitude), r.a.marker, r.a.negative) for r in out] == [(5000.0, "Dr", True), (12.5, "Cr", False), None, None, None, (0.0, "Dr", False), (3.0, None, True), (1.0, None, False), None]
    assert [r.d for r in out] == [None] * 7 + [datetime.date(2024, 4, 1), None]
    assert [r.f for r in out] == ["Dr", "Cr", None, None, None, "Dr", None, None, "Dr"]


def test_shapes_and_confidence(spark):
    none = F.array().cast("array<string>")
    row = spark.range(1).select(is_amount_like(F.lit("12345678901234567890123")), is_amount_like(F.lit("n/a")), carries_forward(F.lit(" Balance  B/F today")), carries_forward(F.lit("my b/f")),
                                confidence(F.lit("a"), F.lit(True), none), confidence(F.lit(""), F.lit(True), none), confidence(F.lit("a"), F.lit(True), F.array(F.lit("odd")))).head()
    assert tuple(row) == (True, False, True, False, "high", "medium", "low")


def test_kinds_without_header(spark):
    rows = [["Date", "Narration", "Debit"], ["", "more", None], ["", "", "(cr)"], ["", "", "Debit"], [], ["1/1/2024", "", ""]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, cells array<string>")
    got = df.select("i", row_kind(F.col("cells"), 0, [2], [1], F.lit(None).cast("array<string>")).alias("k")).orderBy("i").collect()
    assert [r.k for r in got] == ["S", "C", "C", "S", "B", "T"]
