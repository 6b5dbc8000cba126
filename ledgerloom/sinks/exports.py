"""Export formats over transactions of many statements. A format makes lines (statement_id, line_no,
line) or whole contents; export_files() writes them, a file a statement."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.details import file_name
from ..functions.text import MONEY, csv_cell, import_line
from .files import FORMAT, register
from .workbook import workbooks

# Columns of the formats, export limits, labels.
CSV_COLUMNS = ("Serial", "Date", "Value Date", "Narration", "Ref No.", "Debit", "Credit", "Balance", "Confidence", "Issues")
IMPORT_COLUMNS = ("bk_cd", "prt_cd", "tr_date", "amtp", "amtr", "rem")
MOST_ROWS, LONGEST_OPTION = 20_000, 32
REVIEW = "No — review before use"


def general_csv(rows: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """(statement_id, line_no, line) of the general CSV: a header, then one line per transaction."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    money = lambda c: text(F.col(c).cast(MONEY))
    day = lambda c: F.coalesce(F.date_format(c, "dd/MM/yyyy"), F.lit(""))
    cells = (text(F.col("serial")), day("txn_date"), day("value_date"), text(F.col("narration")), text(F.col("ref_no")), money("debit"), money("credit"), money("balance"), text(F.col("confidence")), F.array_join("issues", "; "))
    return with_header(rows.select("statement_id", F.col("serial").cast("int").alias("line_no"), F.concat_ws(",", *map(csv_cell, cells)).alias("line")), ",".join(CSV_COLUMNS))


def accounting_import(rows: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """(statement_id, line_no, line) of the accounting import: every field quoted, the remark is the
    narration with the lines it was printed in."""
    options = options or {}
    remark = F.when(F.size(F.coalesce("narration_lines", F.array())) > 0, F.array_join("narration_lines", "\n")).otherwise(F.col("narration"))
    line = import_line(F.lit(options.get("bankCode", "")), F.col("txn_date"), F.col("debit"), F.col("credit"), remark, F.lit(options.get("partyCode", "")))
    return with_header(rows.select("statement_id", F.col("serial").cast("int").alias("line_no"), line.alias("line")), ",".join(f'"{c}"' for c in IMPORT_COLUMNS))


def with_header(lines: DataFrame, header: str) -> DataFrame:
    heads = lines.select("statement_id").distinct().select("statement_id", F.lit(0).alias("line_no"), F.lit(header).alias("line"))
    return heads.unionByName(lines)


def workbook_summary(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """(statement_id, line_no, label, value): the summary sheet, title and blank line first. `meta` has
    bank_name, template_id, account_masked, period_from, period_to, page_count, parsed_by, opening."""
    sums = rows.groupBy("statement_id").agg(F.count("*").alias("n"), F.sum(F.coalesce("debit", F.lit(0))).cast(MONEY).alias("d"), F.sum(F.coalesce("credit", F.lit(0))).cast(MONEY).alias("c"), F.max_by("balance", "serial").cast(MONEY).alias("closing"))
    j = meta.join(sums, "statement_id").withColumn("computed", (F.col("opening") + F.col("c") - F.col("d")).cast(MONEY))
    sound = F.coalesce(F.abs(F.col("computed") - F.col("closing")) <= 0.01, F.lit(False))
    period = F.when(F.col("period_from").isNotNull() & F.col("period_to").isNotNull(), F.concat(F.col("period_from").cast("string"), F.lit(" to "), F.col("period_to").cast("string"))).otherwise("not stated")
    by = F.when(F.col("parsed_by") == "template", F.concat(F.lit("Template ("), F.col("template_id"), F.lit(")"))).otherwise("AI-assisted column mapping")
    lines = (("Statement summary", F.lit("")), (None, None), ("Bank", F.col("bank_name")), ("Account number", F.coalesce("account_masked", F.lit("not stated"))), ("Statement period", period), ("Pages", F.col("page_count")), ("Parsed by", by), ("", None),
             ("Transactions", F.col("n")), ("Opening balance", F.col("opening").cast(MONEY)), ("Total debits", F.col("d")), ("Total credits", F.col("c")), ("Closing balance", F.col("closing")), ("Opening + credits − debits", F.col("computed")), ("Reconciles", F.when(sound, "Yes").otherwise(REVIEW)))
    none = F.lit(None).cast("string")
    made = F.array(*[F.struct(F.lit(i).alias("line_no"), F.lit(label).cast("string").alias("label"), (none if v is None else v.cast("string")).alias("value")) for i, (label, v) in enumerate(lines)])
    return j.select("statement_id", F.inline(made))


@dataclass(frozen=True)
class Exporter:
    """What a format needs: contents(rows, meta, options) as (statement_id, part, content): a file's bytes, in one
    row or in parts; and the options it cannot go without."""

    id: str
    label: str
    content_type: str
    extension: str
    contents: Callable[[DataFrame, DataFrame, dict[str, str]], DataFrame]
    requires: tuple[str, ...] = ()


def as_lines(lines: Callable[[DataFrame, dict[str, str]], DataFrame], line_end: str) -> Callable[[DataFrame, DataFrame, dict[str, str]], DataFrame]:
    """The contents of a text format: a part a line."""
    return lambda rows, meta, options: lines(rows, options).select("statement_id", F.col("line_no").alias("part"), F.encode(F.concat("line", F.lit(line_end)), "UTF-8").alias("content"))


def as_workbook(rows: DataFrame, meta: DataFrame, options: dict[str, str]) -> DataFrame:
    return workbooks(rows, workbook_summary(rows, meta)).select("statement_id", F.lit(0).alias("part"), "content")


EXPORTERS = (
    Exporter("csv", "CSV (.csv)", "text/csv; charset=utf-8", "csv", as_lines(general_csv, "\r\n")),
    Exporter("ledger-csv", "Accounting import (.csv)", "text/csv; charset=utf-8", "csv", as_lines(accounting_import, "\n"), ("bankCode",)),
    Exporter("xlsx", "Excel (.xlsx)", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xlsx", as_workbook),
)

# Why an export is refused, in the order of the checks.
BAD_SHAPE = "The transactions being exported did not match the expected shape."
UNKNOWN_FORMAT = 'Unknown export format "{}".'
NEEDS = 'The "{}" format needs a {}.'


def find_exporter(name: str) -> Exporter | None:
    return next((e for e in EXPORTERS if e.id == name), None)


def option_errors(name: str, options: dict[str, str] | None = None) -> str | None:
    """Why a format cannot be written with these options; null if it can. The shape of the request comes
    first, then the format, then what it needs."""
    options = options or {}
    if not 0 < len(name) <= LONGEST_OPTION or any(len(v) > LONGEST_OPTION for v in options.values()):
        return BAD_SHAPE
    exporter = find_exporter(name)
    if exporter is None:
        return UNKNOWN_FORMAT.format(name)
    for needed in exporter.requires:
        if not options.get(needed, "").strip():
            return NEEDS.format(exporter.label, "bank code" if needed == "bankCode" else needed)
    return None


def export_errors(rows: DataFrame, statements: DataFrame | None = None) -> DataFrame:
    """(statement_id, n_rows, ok): whether each statement's rows can be exported: 1 to 20,000 rows, a
    serial of 0 or more, a day, a balance and a known confidence in each. With `statements`
    (statement_id), those without rows have a row as well, and cannot."""
    sound = (F.col("serial") >= 0) & F.col("txn_date").isNotNull() & F.col("balance").isNotNull() & F.col("narration").isNotNull() & F.col("confidence").isin("high", "medium", "low")
    out = rows.groupBy("statement_id").agg(F.count("*").alias("n_rows"), F.bool_and(F.coalesce(sound, F.lit(False))).alias("_s"))
    if statements is not None:
        out = statements.select("statement_id").distinct().join(out, "statement_id", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0).cast("long")))
    return out.select("statement_id", "n_rows", (F.coalesce("_s", F.lit(False)) & (F.col("n_rows") <= MOST_ROWS)).alias("ok"))


def file_names(meta: DataFrame, extension: str) -> DataFrame:
    return meta.select("statement_id", file_name(F.col("bank_name"), F.col("period_from"), F.col("period_to"), extension).alias("file_name"))


def export_files(rows: DataFrame, path: str, name: str, options: dict[str, str] | None = None, meta: DataFrame | None = None, mode: str = "append") -> None:
    """Writes a file a statement by the `statement-files` source, named `<statement_id> <bank> statement <period>.<ext>`.
    Format, options and rows are checked first; a statement that does not pass stops the export. `meta` has a row a
    statement with bank_name, period_from, period_to, and what workbook_summary() needs; without it names have
    no bank, and workbooks cannot be made. A statement's parts meet in one sorted task; the export limit bounds them."""
    options = options or {}
    if why := option_errors(name, options):
        raise ValueError(why)
    if not export_errors(rows, meta).where("not ok").isEmpty():
        raise ValueError(BAD_SHAPE)
    exporter = find_exporter(name)
    if meta is None:
        if name == "xlsx":
            raise ValueError("a workbook needs what is known of its statement: meta")
        day = F.lit(None).cast("date")
        meta = rows.select("statement_id").distinct().select("statement_id", F.lit("").alias("bank_name"), day.alias("period_from"), day.alias("period_to"))
    names = meta.select("statement_id", F.concat(F.regexp_replace(F.col("statement_id").cast("string"), r"[^A-Za-z0-9_\-]", "_"), F.lit(" "), file_name(F.col("bank_name"), F.col("period_from"), F.col("period_to"), exporter.extension)).alias("file_name"))
    register(rows.sparkSession)
    parts = exporter.contents(rows, meta, options).join(names, "statement_id")
    dealt = parts.repartition("file_name").sortWithinPartitions("file_name", "part").select("file_name", "content")
    dealt.write.format(FORMAT).mode(mode).save(path)


def result_lines(rows: DataFrame, meta: DataFrame, notices: str = "notices") -> DataFrame:
    """(statement_id, line): one JSON text per statement, its transactions in order."""
    own = [c for c in rows.columns if c != "statement_id"]
    listed = rows.groupBy("statement_id").agg(F.array_sort(F.collect_list(F.struct("serial", *[c for c in own if c != "serial"]))).alias("transactions"))
    j = meta.join(listed, "statement_id")
    body = F.struct(F.lit("result").alias("type"), F.lit(True).alias("ok"), "transactions", F.struct(*[c for c in meta.columns if c != notices]).alias("meta"), *([notices] if notices in meta.columns else []))
    return j.select("statement_id", F.to_json(body).alias("line"))
