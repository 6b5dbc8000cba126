"""The expressions under SQL names: temporary functions of a session whose bodies are inlined into the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import MONEY, SPACE, amount_sql, date_sql, flag_sql, quoted

_clean = f"regexp_replace(t, {quoted(f'^{SPACE}+|{SPACE}+$')}, '')"
_whole = "substring_index(CAST(abs(v) AS STRING), '.', 1)"
_lakhs = f"concat(regexp_replace(left({_whole}, length({_whole}) - 3), {quoted(chr(92) + 'd(?=(?:' + chr(92) + 'd' + chr(92) + 'd)+$)')}, '$0,'), ',', right({_whole}, 3))"
#: Name, parameter, type and body of each function.
FUNCTIONS = (
    ("ledger_amount", "t STRING", MONEY, f"({amount_sql()}).value"),
    ("ledger_magnitude", "t STRING", MONEY, f"({amount_sql()}).magnitude"),
    ("ledger_marker", "t STRING", "STRING", f"({amount_sql()}).marker"),
    ("ledger_date", "t STRING", "DATE", date_sql()),
    ("ledger_flag", "t STRING", "STRING", flag_sql()),
    ("ledger_mask", "t STRING", "STRING", f"CASE WHEN length({_clean}) <= 4 THEN {_clean} ELSE concat(repeat('X', least(length({_clean}) - 4, 12)), right({_clean}, 4)) END"),
    ("ledger_rupees", f"v {MONEY}", "STRING", f"concat(CASE WHEN v < 0 THEN '-' ELSE '' END, '₹', CASE WHEN length({_whole}) > 3 THEN {_lakhs} ELSE {_whole} END, '.', substring_index(CAST(abs(v) AS STRING), '.', -1))"),
)


def register_names(spark: SparkSession, prefix: str = "") -> list[str]:
    """Creates the functions in a session, anew if they exist, and returns their names."""
    for name, parameter, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameter}) RETURNS {kind} RETURN {body}")
    return [prefix + f[0] for f in FUNCTIONS]
