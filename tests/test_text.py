from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.functions.details import clamp, client_key, statement_details
from ledgerloom.functions.text import format_inr, mask_account, plain_amount, read_amount, read_amount_parts, read_date, read_flag

AMOUNTS = [
    ("1,23,456.78", "123456.78"), ("12,34,56,789.00", "123456789"), ("9,99,999.99", "999999.99"), ("1,234,567.89", "1234567.89"), ("1,234.00", "1234"), ("123456.78", "123456.78"), ("0.00", "0"), ("5", "5"),
    ("1,234.00 Cr", "1234"), ("1,234.00 Dr", "-1234"), ("1,234.00Cr", "1234"), ("1,234.00 CR", "1234"), ("1,234.00 dr.", "-1234"), ("5,000.00(Dr)", "-5000"), ("5,000.00(Cr)", "5000"), ("12,34,567.89(Dr)", "-1234567.89"), ("Cr 500.00", "500"), ("Dr 500.00", "-500"),
    ("(1,234.00)", "-1234"), ("(1,23,456.78)", "-123456.78"), ("-1,234.00", "-1234"), ("1,234.00-", "-1234"), ("−1,234.00", "-1234"), ("–1,234.00", "-1234"), ("—1,234.00", "-1234"), ("-0.00", "0"),
    ("1,23,456.78 ", "123456.78"), (" 1,234.00", "1234"), ("  1,234.00  ", "1234"), ("1,234.00 Cr", "1234"), ("1,23 ,456.78", "123456.78"), ("₹1,234.00", "1234"), ("Rs. 1,234.00", "1234"), ("INR 1,234.00", "1234"),
    ("", None), ("  ", None), ("-", None), ("--", None), (".", None), ("NIL", None), ("N/A", None), ("na", None), (None, None), ("01/04/2024", None), ("abc", None), ("12.34.56", None), ("1e5", None), ("DR", None), ("(CR)", None),
    ("-5-", None), ("R.S. 500", "500"), ("Dr 500 Cr", "-500"), ("(Cr)500Dr", "-500"), ("(500)(Cr)", "500"), ("((cr)500)", None), ("Rs.-5", "-5"), ("-+5", "-5"), ("INR Cr 500", None), ("(12", None), ("500 600", "500600"), ("﹣5", None),
]
DATES = [
    ("01/04/2024", date(2024, 4, 1)), ("31/12/2023", date(2023, 12, 31)), ("1/4/2024", date(2024, 4, 1)), ("01-04-2024", date(2024, 4, 1)), ("01.04.2024", date(2024, 4, 1)), ("01/04/24", date(2024, 4, 1)), ("01/04/99", date(1999, 4, 1)), ("01-04-05", date(2005, 4, 1)), ("2024-04-01", date(2024, 4, 1)),
    ("01 Apr 2024", date(2024, 4, 1)), ("01-Apr-2024", date(2024, 4, 1)), ("01/Apr/2024", date(2024, 4, 1)), ("1 APR 2024", date(2024, 4, 1)), ("01 April 2024", date(2024, 4, 1)), ("01-Sep-2024", date(2024, 9, 1)), ("01-Sept-2024", date(2024, 9, 1)), ("01-Apr-24", date(2024, 4, 1)),
    ("01/04/2024 14:32", date(2024, 4, 1)), ("01/04/2024 02:15:44 PM", date(2024, 4, 1)), ("01-Apr-2024 (Mon)", date(2024, 4, 1)), ("01 Apr 2024", date(2024, 4, 1)), ("03/04/2024", date(2024, 4, 3)), ("Apr 5, 2024", date(2024, 4, 5)),
    ("31/02/2024", None), ("32/01/2024", None), ("01/13/2024", None), ("00/04/2024", None), ("2024/01/05", None), ("", None), ("  ", None), ("1,234.00", None), ("123456", None), ("UPI/123/ABC", None), ("Apr", None), ("-", None), (None, None),
]


def test_amounts(spark):
    rows = spark.createDataFrame(AMOUNTS, "t string, want string").select("t", "want", read_amount(F.col("t")).alias("got")).collect()
    assert [(r.t, r.got) for r in rows] == [(t, None if w is None else Decimal(w).quantize(Decimal("0.01"))) for t, w in AMOUNTS]


def test_parts_of_an_amount(spark):
    texts = [("12,34,56.78 Dr",), ("(5)",), ("12345678901234567890123",)]
    got = [r.a for r in spark.createDataFrame(texts, "t string").select(read_amount_parts(F.col("t")).alias("a")).collect()]
    assert [(a.magnitude, a.marker, a.negative) for a in got] == [(Decimal("123456.78"), "Dr", True), (Decimal("5.00"), None, True), (None, None, False)]


def test_dates(spark):
    rows = spark.createDataFrame(DATES, "t string, want date").select("t", read_date(F.col("t")).alias("got")).collect()
    assert [(r.t, r.got) for r in rows] == DATES


def test_template_format_comes_first(spark):
    df = spark.createDataFrame([("03/04/2024",)], "t string")
    assert df.select(read_date(F.col("t"), ("MM/dd/yyyy",))).head()[0] == date(2024, 3, 4)


def test_labels(spark):
    row = spark.range(1).select(format_inr(F.lit(-1234567.5)).alias("a"), plain_amount(F.lit(-12.50)).alias("b"), mask_account(F.lit("  123456789 ")).alias("c"), read_flag(F.lit(" Cr. ")).alias("d"), format_inr(F.lit(999)).alias("e"), mask_account(F.lit(" 123 ")).alias("f")).head()
    assert tuple(row) == ("-₹12,34,567.50", "12.5", "XXXXX6789", "Cr", "₹999.00", "123")


def test_details(spark):
    texts = ["Account Number: 00123456789\nPeriod: 01/04/2024 to 30-Jun-2024\nTotal: 34 transactions", "A/C No 12XX34\n1 Apr 2024 – 2 Apr 2024", "Statement from 31/02/2024 to 01/03/2024", None]
    got = [tuple(r.d) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(statement_details(F.col("t")).alias("d")).collect()]
    assert got == [("XXXXXXX6789", date(2024, 4, 1), date(2024, 6, 30), 34), ("XX" + "XX34", date(2024, 4, 1), date(2024, 4, 2), None), (None, None, None, None), (None, None, None, None)]


def test_keys_and_scores(spark):
    df = spark.createDataFrame([(" 1.2.3.4 , x", "9"), ("", "9"), (None, None)], "f string, r string")
    assert [r.k for r in df.select(client_key(F.col("f"), F.col("r")).alias("k")).collect()] == ["1.2.3.4", "9", "unknown"]
    scores = spark.createDataFrame([(x,) for x in (-1.0, 0.5, 2.0, float("nan"), float("-inf"), None)], "s double")
    assert [r.s for r in scores.select(clamp(F.col("s")).alias("s")).collect()] == [0.0, 0.5, 1.0, 0.0, 0.0, 0.0]
