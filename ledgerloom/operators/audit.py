"""Audit of ledgers against their own running balances. One exchange by statement_id serves all windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import MONEY, format_inr

TOLERANCE = 0.01


def moved() -> Column:
    return F.coalesce("credit", F.lit(0)) - F.coalesce("debit", F.lit(0))


def audit_rows(rows: DataFrame) -> DataFrame:
    """Adds expected, delta, balance_error, date_before and date_warning; an error is never lowered to a warning.
    The expected balance follows from the balance printed before, so one bad row stays local."""
    order = Window.partitionBy("statement_id").orderBy("serial")
    before = F.coalesce(F.lag("balance").over(order), F.col("opening"))
    out = rows.withColumn("expected", before + moved()).withColumn("delta", F.col("balance") - F.col("expected"))
    out = out.withColumn("balance_error", F.coalesce(F.abs("delta") > TOLERANCE, F.lit(False)))
    out = out.withColumn("date_before", F.lag("txn_date").over(order)).withColumn("date_warning", F.coalesce(F.col("txn_date") < F.col("date_before"), F.lit(False)))
    return out.withColumn("status", F.when(F.col("balance_error"), "error").when(F.col("date_warning"), "warning").otherwise("ok"))


def row_messages() -> Column:
    """Messages of an audited row, in the order of the checks."""
    broken = F.concat(F.lit("Running balance breaks here: expected "), format_inr(F.col("expected")), F.lit(" but the statement shows "), format_inr(F.col("balance")), F.lit(" (off by "), format_inr(F.col("delta")), F.lit(")."))
    late = F.concat(F.lit("Date "), F.col("txn_date").cast("string"), F.lit(" is earlier than "), F.col("date_before").cast("string"), F.lit(" on the previous row, which usually means rows were merged incorrectly."))
    return F.filter(F.array(F.when(F.col("balance_error"), broken), F.when(F.col("date_warning"), late)), lambda m: m.isNotNull())


def report(audited: DataFrame, stated: DataFrame | None = None) -> DataFrame:
    """One row per statement: eight measures, `complete`, and `ok` where no check fails. A check that
    lacks what it needs (an opening balance, a stated count) is skipped and fails nothing. `stated`
    has (statement_id, stated_count)."""
    out = audited.groupBy("statement_id").agg(
        F.count("*").alias("n_rows"), F.sum(F.coalesce("debit", F.lit(0))).alias("total_debit"), F.sum(F.coalesce("credit", F.lit(0))).alias("total_credit"),
        F.min("opening").alias("opening"), F.max_by("balance", "serial").alias("closing"), F.count_if("balance_error").alias("n_errors"), F.count_if(F.col("date_warning") & ~F.col("balance_error")).alias("n_warnings"), F.count_if("date_warning").alias("n_late"),
        F.array_sort(F.collect_list(F.when(F.col("balance_error"), F.col("serial")))).alias("error_rows"), F.array_sort(F.collect_list(F.when(F.col("date_warning"), F.col("serial")))).alias("late_rows"))
    out = out.withColumn("offending", F.array_join(F.transform("error_rows", lambda s: s.cast("string")), ","))
    out = out.withColumn("computed_closing", F.col("opening") + F.col("total_credit") - F.col("total_debit")).withColumn("footer_delta", F.col("computed_closing") - F.col("closing"))
    out = out.join(stated, "statement_id", "left") if stated is not None else out.withColumn("stated_count", F.lit(None).cast("long"))
    out = out.withColumn("complete", F.col("stated_count").isNull() | (F.col("stated_count") == F.col("n_rows")))
    return out.withColumn("ok", (F.col("n_errors") == 0) & (F.col("n_late") == 0) & F.coalesce(F.abs("footer_delta") <= TOLERANCE, F.lit(True)) & F.col("complete"))


def checks(reports: DataFrame) -> DataFrame:
    """(statement_id, check_no, id, label, status, detail, offending_rows): the four checks of a report."""
    n, errors, late = (F.col(c) for c in ("n_rows", "n_errors", "n_late"))
    known = F.col("opening").isNotNull()
    rows = F.array().cast("array<int>")
    inr = lambda c: format_inr(F.col(c).cast(MONEY))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    def check(no: int, name: str, label: str, status: Column, detail: Column, offending: Column) -> Column:
        return F.struct(F.lit(no).alias("check_no"), F.lit(name).alias("id"), F.lit(label).alias("label"), status.alias("status"), detail.alias("detail"), offending.cast("array<int>").alias("offending_rows"))

    running = F.when(errors > 0, text(errors, " row(s) do not follow from the previous balance.")).when(known, text("All ", n, " rows reconcile against the opening balance of ", inr("opening"), ".")).otherwise("Every row follows from the one before it. The opening balance was unknown, so row 1 was not checked.")
    sums = F.abs("footer_delta") <= TOLERANCE
    footer = (F.when(~known, "The statement did not state both an opening and a closing balance.")
              .when(sums, text(inr("opening"), " + ", inr("total_credit"), " credits − ", inr("total_debit"), " debits = ", inr("closing"), "."))
              .otherwise(text("Totals are off by ", inr("footer_delta"), ": opening ", inr("opening"), " plus ", inr("total_credit"), " credits minus ", inr("total_debit"), " debits gives ", inr("computed_closing"), ", but the closing balance is ", inr("closing"), ".")))
    order = F.when(late > 0, text(late, " row(s) are dated earlier than the row above them.")).otherwise("Dates run forward through the statement.")
    stated = F.col("stated_count")
    count = (F.when(stated.isNull(), "The statement did not print a transaction count to compare against.").when(stated == n, text("Found all ", stated, " transactions the statement says it contains."))
             .otherwise(text("The statement states ", stated, " transactions but ", n, " were extracted.")))
    all_checks = F.array(
        check(1, "running-balance", "Running balance", F.when(errors > 0, "fail").otherwise("pass"), running, F.col("error_rows")),
        check(2, "footer-reconciliation", "Statement totals", F.when(~known, "skipped").when(sums, "pass").otherwise("fail"), footer, rows),
        check(3, "date-monotonicity", "Date order", F.when(late > 0, "fail").otherwise("pass"), order, F.col("late_rows")),
        check(4, "completeness", "Transaction count", F.when(stated.isNull(), "skipped").when(stated == n, "pass").otherwise("fail"), count, rows))
    return reports.select("statement_id", F.inline(all_checks))


# Fixed value: offending rows that a summary names.
NAMED_ROWS = 12


def first_offenders(rows: Column) -> Column:
    """struct(named, more): the first twelve offending rows and how many more there are."""
    return F.struct(F.slice(rows, 1, NAMED_ROWS).alias("named"), F.greatest(F.size(rows) - NAMED_ROWS, F.lit(0)).alias("more"))
