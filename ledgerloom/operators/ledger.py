"""Ledgers: movements, order, opening and closing balances, wrapped lines, edits. All frames are keyed
by statement_id and ordered by explicit numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import cell_amount, cell_flag
from ..functions.text import MONEY, once, read_amount, read_date, squeeze

# Issue texts of the output contract.
BOTH_SIDES = "Both the debit and credit columns held a value; the debit was used."
NO_SIGN = "Amount carried no Dr/Cr marker or sign; recorded as a credit."
NO_FLAG = "No Dr/Cr flag found for this row; recorded as a credit."
MOVEMENT = "struct<debit:decimal(18,2),credit:decimal(18,2),issue:string>"


def movement(debit: Column, credit: Column, issue: Column) -> Column:
    return F.struct(debit.cast(MONEY).alias("debit"), credit.cast(MONEY).alias("credit"), issue.cast("string").alias("issue"))


def movement_separate(debit_cell: Column, credit_cell: Column) -> Column:
    """Of a cell of each side: a zero yields to the other side, two zeros or no amount give null. Digits
    too many for an amount, such as a reference number's, are none."""

    def read(m: Column) -> Column:
        d, c, none = m["d"]["magnitude"], m["c"]["magnitude"], F.lit(None)
        has_d, has_c = d.isNotNull(), c.isNotNull()
        both = has_d & has_c
        return (F.when(both & (d == 0) & (c == 0), F.lit(None).cast(MOVEMENT)).when(both & (d == 0), movement(none, c, none)).when(both & (c == 0), movement(d, none, none))
                .when(both, movement(d, none, F.lit(BOTH_SIDES))).when(has_d, movement(d, none, none)).when(has_c, movement(none, c, none)))

    return once(F.struct(cell_amount(debit_cell).alias("d"), cell_amount(credit_cell).alias("c")), read)


def movement_signed(cell: Column) -> Column:
    def read(a: Column) -> Column:
        none = F.lit(None)
        held = a["magnitude"].isNotNull()
        return F.when(held & a["negative"], movement(a["magnitude"], none, none)).when(held, movement(none, a["magnitude"], F.when(a["marker"].isNull(), F.lit(NO_SIGN))))

    return once(cell_amount(cell), read)


def movement_flag(cell: Column, flag_cell: Column) -> Column:
    def read(m: Column) -> Column:
        a, none = m["a"], F.lit(None)
        flag = F.coalesce(m["f"], a["marker"])
        return F.when(a["magnitude"].isNull(), F.lit(None).cast(MOVEMENT)).when(flag == "Dr", movement(a["magnitude"], none, none)).otherwise(movement(none, a["magnitude"], F.when(flag.isNull(), F.lit(NO_FLAG))))

    return once(F.struct(cell_amount(cell).alias("a"), cell_flag(flag_cell).alias("f")), read)


def reorder_newest_first(rows: DataFrame) -> DataFrame:
    """Renumbers a statement from the end if its dates fall at least once and never rise."""
    own = Window.partitionBy("statement_id")
    step = F.lag("txn_date").over(own.orderBy("serial"))
    marked = rows.withColumn("_falls", (F.col("txn_date") < step).cast("int")).withColumn("_rises", (F.col("txn_date") > step).cast("int"))
    turned = (F.coalesce(F.sum("_falls").over(own), F.lit(0)) > 0) & (F.coalesce(F.sum("_rises").over(own), F.lit(0)) == 0)
    marked = marked.withColumn("reversed", turned).withColumn("serial", F.when(F.col("reversed"), F.count("*").over(own) + 1 - F.col("serial")).otherwise(F.col("serial")))
    return marked.drop("_falls", "_rises")


def balances(rows: DataFrame) -> DataFrame:
    """Opening as inferred from the first row, and closing, of each statement."""
    first = F.col("balance") + F.coalesce("debit", F.lit(0)) - F.coalesce("credit", F.lit(0))
    return rows.groupBy("statement_id").agg(F.min_by(first, "serial").alias("opening"), F.max_by("balance", "serial").alias("closing"))


def merge_wrapped(rows: DataFrame) -> DataFrame:
    """Rows (statement_id, row_seq, kind T/C/H/S, text): continuations C join the last transaction T,
    unless a structural row S stands between; repeated headers H do not break the chain."""
    order = Window.partitionBy("statement_id").orderBy("row_seq").rowsBetween(Window.unboundedPreceding, 0)
    anchor = F.last(F.when(F.col("kind") == "T", F.col("row_seq")).when(F.col("kind") == "S", F.lit(-1)), ignorenulls=True).over(order)
    held = rows.withColumn("_at", F.when((F.col("kind") == "C") & (anchor >= 0), anchor).otherwise(F.col("row_seq")))
    parts = held.groupBy("statement_id", "_at").agg(F.array_sort(F.collect_list(F.struct("row_seq", "text"))).alias("_p"), F.min_by("kind", "row_seq").alias("kind"))
    return parts.select("statement_id", F.col("_at").alias("row_seq"), "kind", F.array_join(F.filter(F.col("_p.text"), lambda t: t != ""), " ").alias("text"), F.size("_p").alias("n_lines"))


EDITABLE = ("date", "value_date", "narration", "ref_no", "debit", "credit", "balance")
# Fixed value: issues that an edit of a side settles.
SETTLED = "(?i)marker|flag|both the debit"


def edit_allowed(field: Column, value: Column) -> Column:
    """Whether an edit can be taken: a day or an amount that can be read; a blank only where the field may
    be empty."""
    text = squeeze(F.coalesce(value, F.lit("")))
    days, sums = field.isin("date", "value_date"), field.isin("debit", "credit", "balance")
    return (F.when(text == "", ~field.isin("date", "balance")).when(days, read_date(text).isNotNull()).when(sums, read_amount(text).isNotNull()).otherwise(field.isin("narration", "ref_no")))


def apply_edits(rows: DataFrame, edits: DataFrame, order: str | None = None) -> DataFrame:
    """Edits (statement_id, serial, field, value) of transactions; rows without edits stay as they are, and
    every row stays one row. Of several edits of a field, and of the two sides, the last in column
    `order` counts (without it, the larger text). An edit that cannot be read is ignored. A side set
    clears the other, makes the confidence high and settles the issues about sides; a blank clears an
    optional field; a narration replaces the printed lines. Columns that `rows` lacks are passed over."""
    place = F.col(order) if order else F.lit(0)
    good = edits.where(edit_allowed(F.col("field"), F.col("value"))).select("statement_id", "serial", "field", squeeze(F.coalesce("value", F.lit(""))).alias("_v"), F.struct(place.alias("o"), "value").alias("_o"))

    def last(*fields: str) -> Column:
        return F.max_by(F.when(F.col("field").isin(*fields), F.struct("field", "_v")), F.when(F.col("field").isin(*fields), F.col("_o")))

    own = {f: last(f).alias(f"_{f}") for f in EDITABLE}
    side = F.max_by(F.struct("field", "_v"), F.when(F.col("field").isin("debit", "credit") & (F.col("_v") != ""), F.col("_o"))).alias("_side")
    folded = good.groupBy("statement_id", "serial").agg(*own.values(), side)
    j = rows.join(folded, ["statement_id", "serial"], "left")
    given = lambda f: F.col(f"_{f}").isNotNull()
    text = lambda f: F.col(f"_{f}._v")
    set_side, amount, none = F.col("_side").isNotNull(), F.abs(read_amount(F.col("_side._v"))), F.lit(None).cast(MONEY)
    new = {}
    for f, other in (("debit", "credit"), ("credit", "debit")):
        emptied = given(f) & (text(f) == "")
        new[f] = F.when(set_side, F.when(F.col("_side.field") == f, amount).otherwise(none)).when(emptied, none).otherwise(F.col(f))
    new["txn_date"] = F.when(given("date"), read_date(text("date"))).otherwise(F.col("txn_date")) if "txn_date" in rows.columns else None
    new["value_date"] = F.when(given("value_date"), read_date(text("value_date"))).otherwise(F.col("value_date")) if "value_date" in rows.columns else None
    new["balance"] = F.when(given("balance"), read_amount(text("balance"))).otherwise(F.col("balance")) if "balance" in rows.columns else None
    touched = F.coalesce(set_side | given("debit") | given("credit"), F.lit(False))
    for c, value in (("narration", F.when(given("narration"), text("narration")).otherwise(F.col("narration")) if "narration" in rows.columns else None),
                     ("narration_lines", F.when(given("narration"), F.array(text("narration"))).otherwise(F.col("narration_lines")) if "narration_lines" in rows.columns else None),
                     ("ref_no", F.when(given("ref_no"), F.nullif(text("ref_no"), F.lit(""))).otherwise(F.col("ref_no")) if "ref_no" in rows.columns else None),
                     ("confidence", F.when(set_side, "high").otherwise(F.col("confidence")) if "confidence" in rows.columns else None),
                     ("issues", F.when(touched, F.filter("issues", lambda i: ~i.rlike(SETTLED))).otherwise(F.col("issues")) if "issues" in rows.columns else None)):
        new[c] = value
    edited = touched
    for f in EDITABLE:
        edited = edited | given(f)
    out = [new[c].alias(c) if new.get(c) is not None else F.col(c) for c in rows.columns]
    return j.select(*out, F.coalesce(edited, F.lit(False)).alias("edited"))
