"""Strict readers and writers of amounts, dates and labels, as Column expressions. What is not
certainly an amount or a date is null, never a guess."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, dashes, currency marks and date formats of statements.
SPACE = "[\\s\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
SPACES_IN_AMOUNT = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACES = SPACES_IN_AMOUNT.replace("\u200b", "")  # the characters of SPACE
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212"
CURRENCY = "(?:₹|rs\\.?|inr|r\\.s\\.)"
DEFAULT_FORMATS = (
    "dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "dd/MM/yy", "dd-MM-yy", "dd.MM.yy", "dd-MMM-yyyy", "dd MMM yyyy",
    "dd/MMM/yyyy", "dd-MMM-yy", "dd MMM yy", "dd MMMM yyyy", "yyyy-MM-dd", "MMM dd, yyyy",
)
MONTHS = {m: i for i, names in enumerate((("january", "jan"), ("february", "feb"), ("march", "mar"), ("april", "apr"), ("may",), ("june", "jun"), ("july", "jul"), ("august", "aug"), ("september", "sep", "sept"), ("october", "oct"), ("november", "nov"), ("december", "dec")), 1) for m in names}
MONEY = "decimal(18,2)"

#: An amount without spaces: marks in brackets around all; brackets that mean a negative number; marks;
#: currency; a sign on either side; digits in groups of two or three, or without groups.
MARK = "((?:cr|dr)\\.?)?"
DIGITS = "(?:\\d{1,3}(?:,\\d{2,3})*(?:\\.\\d+)?|\\d+(?:\\.\\d+)?)"
AMOUNT = f"(?i)^(?:\\((cr|dr)\\))?(\\()?{MARK}{CURRENCY}?(-)?\\+?(\\d{{1,3}}(?:,\\d{{2,3}})*(?:\\.\\d+)?|\\d+(?:\\.\\d+)?)(-)?{MARK}(\\))?(?:\\((cr|dr)\\))?$"
#: Digits alone; and the texts of AMOUNT whose brackets are two or none and whose sign is one at most.
PLAIN_AMOUNT = f"^{DIGITS}\\z"
_BODY = f"(?:(?:cr|dr)\\.?)?{CURRENCY}?(?:-\\+?{DIGITS}|\\+?{DIGITS}-?)(?:(?:cr|dr)\\.?)?"
AMOUNT_LIKE = f"(?i)^(?:\\((?:cr|dr)\\))?(?:\\({_BODY}\\)|{_BODY})(?:\\((?:cr|dr)\\))?$"


def squeeze(text: Column) -> Column:
    """Without white space at its ends, of any script."""
    return F.btrim(text, F.lit(SPACES))


def once(value: Column, use) -> Column:
    """use(value) with `value` computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def quoted(text: str) -> str:
    """A string literal of SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def applied(text: Column, sql: str) -> Column:
    """SQL of a value `t`, applied to a Column: a reader's whole tree is parsed at once, not built call by call."""
    return F.call_function("transform", F.array(text), F.expr(f"t -> {sql}"))[0]


@cache
def amount_sql() -> str:
    """SQL from a text `t` to struct(value, magnitude, marker, negative). One pattern takes the text apart;
    its groups are: mark, bracket, mark, minus, digits, minus, mark, bracket, mark. Digits alone are read as they
    are; a mark and a number are read once, however often they are used."""
    groups = f"CASE WHEN f RLIKE {quoted(AMOUNT)} THEN split(regexp_replace(f, {quoted(AMOUNT)}, {quoted(';'.join(f'${i}' for i in range(1, 10)))}), ';', -1) END"
    number = lambda text: f"try_cast(replace({text}, ',', '') AS {MONEY})"
    made = lambda value, magnitude, marker, below: f"named_struct('value', {value}, 'magnitude', {magnitude}, 'marker', {marker}, 'negative', {below})"
    mark = "translate(left(coalesce(nullif(p[2], ''), nullif(p[6], ''), nullif(p[0], ''), nullif(p[8], '')), 1), 'cd', 'CD')"
    negative = "CASE k WHEN 'D' THEN true WHEN 'C' THEN false ELSE p[1] <> '' OR p[3] <> '' OR p[5] <> '' END"
    read = f"transform(array({mark}), k -> named_struct('n', {number('p[4]')}, 'k', CASE k WHEN 'C' THEN 'Cr' WHEN 'D' THEN 'Dr' END, 'b', {negative}))[0]"
    signed = made(f"CAST(CASE WHEN r.b AND r.n <> 0 THEN -r.n ELSE r.n END AS {MONEY})", "r.n", "r.k", "r.b")
    apart = f"transform(array({groups}), p -> CASE WHEN (p[1] = '') = (p[7] = '') AND (p[3] = '' OR p[5] = '') THEN transform(array({read}), r -> {signed})[0] END)[0]"
    plain = f"transform(array({number('f')}), n -> {made('n', 'n', 'CAST(NULL AS STRING)', 'false')})[0]"
    return f"CASE WHEN t RLIKE '[0-9]' THEN transform(array({flat_sql('t')}), f -> CASE WHEN f RLIKE {quoted(PLAIN_AMOUNT)} THEN {plain} ELSE {apart} END)[0] END"


def flat_sql(text: str) -> str:
    return f"translate({text}, {quoted(DASHES + SPACES_IN_AMOUNT)}, {quoted('-' * len(DASHES))})"


def read_amount_parts(text: Column) -> Column:
    """struct(value, magnitude, marker, negative); null where the text is no amount. A text that is no
    amount costs one look for a digit or one match."""
    return applied(text, amount_sql())


def has_amount_shape(text: Column) -> Column:
    """Whether read_amount_parts() gives something; null is no amount."""
    flat = F.translate(text, DASHES + SPACES_IN_AMOUNT, "-" * len(DASHES))
    return F.coalesce(F.rlike(text, F.lit("[0-9]")) & F.rlike(flat, F.lit(AMOUNT_LIKE)), F.lit(False))


def read_amount(text: Column) -> Column:
    return read_amount_parts(text)["value"]


@cache
def flag_sql() -> str:
    """SQL from a text `t` to Dr or Cr."""
    low = f"lower(regexp_replace(t, {quoted(SPACE + '|' + chr(92) + '.')}, ''))"
    return f"CASE WHEN {low} IN ('cr', 'c', 'credit') THEN 'Cr' WHEN {low} IN ('dr', 'd', 'debit', 'db') THEN 'Dr' END"


def read_flag(text: Column) -> Column:
    return applied(text, flag_sql())


def date_pattern(layout: str) -> tuple[str, list[str]]:
    """(pattern without anchors, kinds of its groups) of a date format."""
    kinds, out = [], ""
    for part in re.findall(r"yyyy|yy|MMMM|MMM|MM|dd|\s+|.", layout):
        if part in ("yyyy", "yy", "MMMM", "MMM", "MM", "dd"):
            kinds.append(part)
            out += {"yyyy": r"(\d{4})", "yy": r"(\d{2})", "MM": r"(\d{1,2})", "dd": r"(\d{1,2})"}.get(part, "([a-z]{3,9})")
        else:
            out += r"\s+" if part.isspace() else re.escape(part)
    return out, kinds


def date_shape(formats: tuple[str, ...]) -> str:
    """A pattern of all texts that read_date may take for a day, without anchors: a cheap test for the rest."""
    ways = dict.fromkeys(date_pattern(f)[0].replace("(", "(?:").replace(r"\s", SPACE) for f in (*formats, *DEFAULT_FORMATS))
    return f"(?i)(?:{'|'.join(ways)})"


#: A text that cleaning leaves as it is.
PLAIN_DATE = r"^[0-9A-Za-z](?:[-0-9A-Za-z/., ]*[0-9A-Za-z])?\z"


@cache
def date_sql(formats: tuple[str, ...] = ()) -> str:
    """SQL from a text `t` to the first day that a format gives. Cleaning takes nothing from the front but
    blanks, so only a text that begins with a date's shape is read."""
    clean = f"regexp_replace(t, {quoted(SPACE + '|' + chr(92) + 'u200B')}, ' ')"
    clean = "regexp_replace({}, {}, '')".format(clean, quoted(r"(?i)\s+\d{1,2}:\d{2}(?::\d{2})?(?:\s*[ap]m)?$"))
    clean = "regexp_replace({}, {}, '')".format(clean, quoted(r"\s*\([^)]*\)\s*$"))
    clean = f"CASE WHEN t RLIKE {quoted(PLAIN_DATE)} THEN t ELSE btrim({clean}, {quoted(SPACES)}) END"
    months = "map(" + ", ".join(f"'{m}', '{i}'" for m, i in MONTHS.items()) + ")"
    days = []
    for layout in dict.fromkeys((*formats, *DEFAULT_FORMATS)):
        pattern, kinds = date_pattern(layout)
        pattern = quoted(f"(?i)^{pattern}$")
        at = {k: i for i, k in enumerate(kinds, 1)}
        year, name = at.get("yyyy", at.get("yy")), at.get("MMM", at.get("MMMM"))
        if name is None:
            text = f"regexp_replace(c, {pattern}, '${year}-${at['MM']}-${at['dd']}')"
        else:
            parts = f"split(regexp_replace(c, {pattern}, '${year};${name};${at['dd']}'), ';')"
            text = f"transform(array({parts}), p -> concat(p[0], '-', element_at({months}, lower(p[1])), '-', p[2]))[0]"
        if "yyyy" not in at:
            text = f"transform(array({text}), y -> concat(CASE WHEN y >= '70' THEN '19' ELSE '20' END, y))[0]"
        days.append(f"CASE WHEN c RLIKE {pattern} THEN transform(array(try_cast({text} AS DATE)), d -> CASE WHEN year(d) BETWEEN 1900 AND 2999 THEN d END)[0] END")
    begins = f"(?i)^(?:{SPACE}|\\u200B)*(?:{date_shape(formats).removeprefix('(?i)').replace(SPACE, f'(?:{SPACE}|{chr(92)}u200B)')})"
    return f"CASE WHEN t RLIKE {quoted(begins)} THEN transform(array({clean}), c -> coalesce({', '.join(days)}))[0] END"


def read_date(text: Column, formats: tuple[str, ...] = ()) -> Column:
    """The first format that gives a real day of 1900 to 2999; times and remarks at the end are dropped."""
    return applied(text, date_sql(tuple(formats)))


def format_inr(value: Column) -> Column:
    """Rupees with lakh grouping and two decimals."""
    digits = F.abs(value.cast(MONEY)).cast("string")
    whole, cents = F.substring_index(digits, ".", 1), F.substring_index(digits, ".", -1)
    rest = F.when(F.length(whole) > 3, F.concat(F.regexp_replace(whole.substr(F.lit(1), F.length(whole) - 3), r"(\d)(?=(?:\d\d)+$)", "$1,"), F.lit(","), F.right(whole, F.lit(3)))).otherwise(whole)
    return F.concat(F.when(value < 0, "-").otherwise(""), F.lit("₹"), rest, F.lit("."), cents)


def plain_amount(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.abs(value.cast(MONEY)).cast("string"), "0+$", ""), r"\.$", "")


def mask_account(text: Column) -> Column:
    text = squeeze(text)
    n = F.length(text)
    return F.when(n <= 4, text).otherwise(F.concat(F.repeat(F.lit("X"), F.least(n - 4, F.lit(12))), F.right(text, F.lit(4))))


def csv_cell(text: Column, guard: bool = True) -> Column:
    """A cell as text: formula characters guarded, quoted where needed."""
    safe = F.when(text.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), text)).otherwise(text) if guard else text
    return F.when(safe.rlike("[\",\\r\\n]"), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def import_line(bank: Column, day: Column, debit: Column, credit: Column, remark: Column, party: Column | None = None) -> Column:
    """A line of the ledger-import format: bank, party, day, paid, received, remark, each quoted."""
    code = F.coalesce(F.nullif(F.trim(party), F.lit("")), F.lit("SUSP")) if party is not None else F.lit("SUSP")
    cells = (F.trim(bank), code, F.date_format(day, "dd-MM-yyyy"), plain_amount(debit), plain_amount(credit), remark)
    return F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in cells])
