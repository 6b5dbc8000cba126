"""What the cover of a statement tells, and small labels. Column expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, mask_account, read_date, squeeze

# Patterns of account number, period and stated count, in the order they are tried.
DAY = r"([0-9]{1,2}[/\-. ][A-Za-z0-9]{2,9}[/\-. ][0-9]{2,4})"
ACCOUNT = (r"account\s*(?:no|number|#)\s*[:.\-]?\s*([0-9Xx*]{6,20})", r"a/c\s*(?:no|number)?\s*[:.\-]?\s*([0-9Xx*]{6,20})")
PERIOD = (
    rf"(?:period|statement)\s*(?:of\s*account\s*)?(?:from|for the period)?\s*[:\-]?\s*{DAY}\s*(?:to|-|–|through)\s*{DAY}",
    rf"{DAY}\s*(?:to|–)\s*{DAY}",
)
STATED = r"total\s*[:\-]?\s*(\d{1,6})\s*transactions?"


def found(text: Column, pattern: str, group: int) -> Column:
    """A group of the first match; null where there is none."""
    return F.nullif(F.regexp_extract(text, "(?i)" + pattern.replace(r"\s", SPACE), group), F.lit(""))


def statement_details(text: Column) -> Column:
    """struct(account_masked, period_from, period_to, stated_count); a period needs both its days."""
    account = F.coalesce(*[mask_account(found(text, p, 1)) for p in ACCOUNT])
    spans = [F.struct(read_date(found(text, p, 1)).alias("from"), read_date(found(text, p, 2)).alias("to")) for p in PERIOD]
    both = [s["from"].isNotNull() & s["to"].isNotNull() for s in spans]
    period = lambda end: F.coalesce(*[F.when(b, s[end]) for b, s in zip(both, spans, strict=True)])
    return F.struct(account.alias("account_masked"), period("from").alias("period_from"), period("to").alias("period_to"), found(text, STATED, 1).cast("int").alias("stated_count"))


def client_key(forwarded: Column, real_ip: Column) -> Column:
    """The first hop of the forwarded addresses, else the real address, else `unknown`."""
    first = F.when(F.coalesce(forwarded, F.lit("")) != "", squeeze(F.split(forwarded, ",", -1)[0]))
    return F.coalesce(first, real_ip, F.lit("unknown"))


def clamp(score: Column) -> Column:
    """A confidence within 0 and 1; 0 where it is no finite number."""
    s = score.cast("double")
    return F.when(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)))


def file_name(bank: Column, period_from: Column, period_to: Column, extension: str) -> Column:
    """`<bank> statement <from> to <to>.<ext>` without characters that file systems may refuse."""
    period = F.when(period_from.isNotNull() & period_to.isNotNull(), F.concat(F.lit(" "), period_from.cast("string"), F.lit(" to "), period_to.cast("string"))).otherwise("")
    safe = squeeze(F.regexp_replace(F.concat(F.coalesce(bank, F.lit("")), F.lit(" statement"), period), r"[^A-Za-z0-9_\-. ]+", ""))
    return F.concat(F.coalesce(F.nullif(safe, F.lit("")), F.lit("bank-statement")), F.lit(f".{extension}"))
