"""From the grid of a statement to its transactions: the header row, the columns of a layout, wrapped
rows folded, cells read. All statements and layouts go through one plan; frames are keyed by statement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import BARE_MARK, BARE_TIME, cell_amount, cell_date, confidence, is_amount_like, signed_balance
from ..functions.text import DEFAULT_FORMATS, MONEY, once, read_amount_parts, read_date, squeeze
from .layouts import FIELDS, FLAGGED, NEEDED, SEPARATE, SIGNED
from .ledger import movement_flag, movement_separate, movement_signed, reorder_newest_first

# Notices and the narration of a row without one.
NO_NARRATION = "(no narration)"
REVERSED = "This statement lists transactions newest-first; they have been reordered oldest-first so the running balance and totals read top-to-bottom."
INFERRED = "Opening balance inferred from the first transaction; the statement did not print a brought-forward line."


def blank(cell: Column) -> Column:
    return squeeze(F.coalesce(cell, F.lit("")))


def all_formats(known: tuple[tuple[str, ...], ...]) -> tuple[str, ...]:
    """Each date format of the lists once."""
    return tuple(dict.fromkeys(f for x in known for f in x))


def by_formats(cell: Column, formats: Column, known: tuple[tuple[str, ...], ...], reader) -> Column:
    """reader(cell, formats) for the list of date formats in a column, one of those in `known`. Lists of
    default formats alone read as the defaults do, as no text fits two of these in different ways."""
    odd = [f for f in known if not set(f) <= set(DEFAULT_FORMATS)]
    out = reader(cell, ())
    for f in odd:
        out = F.when(formats == F.array(*map(F.lit, f)), reader(cell, f)).otherwise(out)
    return out


def fits(text: Column, pattern: Column) -> Column:
    """Whether a pattern that is data fits somewhere in the text. Unlike regexp_like, this compiles a pattern
    anew only where it changes."""
    return F.regexp_instr(text, pattern) > 0


def with_header(rows: DataFrame, key: str = "statement_id") -> DataFrame:
    """Adds header_seq and header to rows (key, row_seq, cells, columns): the first row in which most of
    the layout's patterns fit a cell, two at least; -1 and null where none is. A header_seq that the
    layout brings itself (`given_seq`) stands."""
    patterns = F.map_values("columns")
    score = once(F.transform("cells", blank), lambda cs: F.size(F.filter(patterns, lambda p: F.exists(cs, lambda c: (c != "") & fits(c, p)))))
    whole = Window.partitionBy(key)
    best = F.max(F.struct(score.alias("score"), (-F.col("row_seq")).alias("at"), "cells")).over(whole)
    out = rows.withColumn("_b", best)
    found = F.col("_b.score") > 1
    out = out.withColumn("header_seq", F.when(found, -F.col("_b.at")).otherwise(F.lit(-1))).withColumn("header", F.when(found, F.col("_b.cells")))
    if "given_seq" in rows.columns:
        own = F.max(F.when(F.col("row_seq") == F.col("given_seq"), F.col("cells"))).over(whole)
        out = out.withColumn("header", F.when(F.col("given_seq").isNotNull(), own).otherwise(F.col("header"))).withColumn("header_seq", F.coalesce("given_seq", "header_seq"))
    return out.drop("_b")


def with_columns(rows: DataFrame, key: str = "statement_id") -> DataFrame:
    """Adds `at` to rows with header, columns, places and edges: field to column, by the number that the
    layout gives or the first header cell that fits. Rows of statements without date, narration or
    balance go, and a reference column that is the narration's is none. Patterns are tried in the header row
    only, and what they find is every row's of its statement."""
    def place(name: str) -> Column:
        number = F.try_element_at("places", F.lit(name))
        pattern = F.try_element_at("columns", F.lit(name))
        found = F.get(F.filter(F.transform("header", lambda c, i: F.when((blank(c) != "") & fits(blank(c), pattern), i)), lambda i: i.isNotNull()), F.lit(0))
        return F.when(number.isNotNull(), F.when((number >= 0) & (number < F.size("edges")), number)).when(pattern.isNotNull(), found)

    # As a difference: a filter on row_seq = header_seq would otherwise have the patterns tried in every row.
    own = F.col("header").isNull() | (F.col("row_seq") - F.col("header_seq") == 0)
    found = F.when(own, F.struct(*[place(f).cast("int").alias(f) for f in FIELDS]))
    out = rows.withColumn("at", F.max(found).over(Window.partitionBy(key))).where(" and ".join(f"at.{f} is not null" for f in NEEDED))
    return out.withColumn("at", F.col("at").withField("ref_no", F.when(~F.col("at.ref_no").eqNullSafe(F.col("at.narration")), F.col("at.ref_no"))))


def kind_of(cells: Column, at: Column, header: Column, dated: Column) -> Column:
    """T, B, C, H or S of a row below the header, with the columns as data."""
    amounts = F.filter(F.array(at["debit"], at["credit"], at["amount"], at["balance"]), lambda i: i.isNotNull())
    texts = F.filter(F.array(at["narration"], at["ref_no"]), lambda i: i.isNotNull())
    priced = F.exists(amounts, lambda i: F.coalesce(is_amount_like(F.get(cells, i)), F.lit(False)))
    clean = F.transform(cells, blank)
    mark = F.transform(clean, lambda c, i: F.when(c == "", 0).when(F.array_contains(texts, i) | (F.array_contains(amounts, i) & c.rlike(BARE_MARK)), 1).when(c.rlike(BARE_TIME), 0).otherwise(2))
    same = F.forall(F.zip_with(clean, F.transform(header, blank), lambda a, b: F.lower(F.coalesce(a, F.lit(""))) == F.lower(F.coalesce(b, F.lit("")))), lambda s: s)
    filled = F.size(F.filter(clean, lambda c: c != ""))
    return (F.when(dated | priced, "T").when(filled == 0, "B").when(F.array_contains(mark, 1) & ~F.array_contains(mark, 2), "C")
            .when(F.coalesce(same, F.lit(False)) & (filled >= 2), "H").otherwise("S"))


def with_marker(cell: Column, mark: Column) -> Column:
    """The cell with a debit or credit mark after it, if it holds an amount without one."""
    own = blank(cell)
    return F.when(once(read_amount_parts(own), lambda a: a.isNotNull() & a["marker"].isNull()), F.concat(own, F.lit(" "), blank(mark))).otherwise(cell)


def merge_rows(rows: DataFrame, key: str = "statement_id") -> DataFrame:
    """Rows (key, row_seq, kind, cells, at, ...) with each wrapped row C folded into the transaction T
    above it, unless a row S stands between; blank rows after a transaction go. Text columns take the
    text, amount columns a bare mark. `lines` has the cells of each printed line, null where one."""
    upto = Window.partitionBy(key).orderBy("row_seq").rowsBetween(Window.unboundedPreceding, 0)
    anchor = F.last(F.when(F.col("kind") == "T", F.col("row_seq")).when(F.col("kind") == "S", F.lit(-1)), ignorenulls=True).over(upto)
    held = rows.withColumn("_a", anchor).where("not (kind = 'B' and coalesce(_a, -1) >= 0)")
    held = held.withColumn("_at", F.when((F.col("kind") == "C") & (F.col("_a") >= 0), F.col("_a")).otherwise(F.col("row_seq")))
    own = [c for c in rows.columns if c not in (key, "row_seq", "cells")]
    g = held.groupBy(key, "_at").agg(F.array_sort(F.collect_list(F.struct("row_seq", "cells"))).alias("_l"), F.min_by(F.struct(*own), "row_seq").alias("_o")).select(key, "_at", "_l", "_o.*")
    lines = F.transform("_l", lambda r: r["cells"])

    def fold(cells: Column, more: Column) -> Column:
        def cell(c: Column, i: Column) -> Column:
            extra = blank(F.get(more, i))
            text = (i == F.col("at.narration")) | F.coalesce(i == F.col("at.ref_no"), F.lit(False))
            amount = F.coalesce(F.array_contains(F.array(*[F.coalesce(F.col(f"at.{f}"), F.lit(-1)) for f in ("debit", "credit", "amount", "balance")]), i), F.lit(False))
            return (F.when(~text & amount & extra.rlike(BARE_MARK), with_marker(c, extra))
                    .when(text & (extra != ""), F.when(F.coalesce(c, F.lit("")) == "", extra).otherwise(F.concat(c, F.lit(" "), extra))).otherwise(c))

        return F.transform(cells, cell)

    cells = F.aggregate(F.slice(lines, 2, F.greatest(F.size("_l") - 1, F.lit(0))), lines[0], fold)
    kept = F.when(F.size("_l") > 1, F.transform(lines, lambda r: F.transform(r, blank)))
    return g.select(key, F.col("_at").alias("row_seq"), *own, cells.alias("cells"), kept.alias("lines"))


def parse_statements(grid: DataFrame, layouts: DataFrame, known_formats: tuple[tuple[str, ...], ...], key: str = "statement_id") -> DataFrame:
    """Transactions of grids (key, row_seq, cells, edges) by layouts (key and the columns of a layout
    table; one a statement): key, serial, txn_date, value_date, narration, narration_lines, ref_no,
    debit, credit, balance, confidence, issues, reversed, opening, opening_inferred. `known_formats`
    are the lists of date formats that the layouts have. Statements whose columns are not found or
    that have no transaction give no rows. After one exchange by statement all steps stay in place."""
    own = ["given_seq"] if "given_seq" in layouts.columns else []
    rows = grid.select(key, "row_seq", "cells", "edges").join(layouts.select(key, "formats", "style", "columns", "places", "forward", *own), key)
    body = with_columns(with_header(rows, key), key).where("row_seq > header_seq").select(key, "row_seq", "cells", "header", "at", "formats", "style", "forward")
    formats = F.col("formats")
    dated = by_formats(F.get("cells", F.col("at.date")), formats, known_formats, read_date).isNotNull()
    merged = merge_rows(body.withColumn("kind", kind_of(F.col("cells"), F.col("at"), F.col("header"), dated)).drop("header"), key)

    cell = lambda f: F.get(F.col("cells"), F.col(f"at.{f}"))
    style = F.col("style")
    moved = F.when(style == SEPARATE, movement_separate(cell("debit"), cell("credit"))).when(style == SIGNED, movement_signed(cell("amount"))).when(style == FLAGGED, movement_flag(cell("amount"), cell("flag")))
    lines = F.filter(F.transform(F.coalesce("lines", F.array("cells")), lambda r: blank(F.get(r, F.col("at.narration")))), lambda t: t != "")
    read = merged.select(
        key, "row_seq", fits(blank(cell("narration")), F.col("forward")).alias("_f"), blank(cell("narration")).alias("_n"), signed_balance_of(cell("balance")).alias("balance"),
        by_formats(cell("date"), formats, known_formats, cell_date).alias("txn_date"), by_formats(cell("value_date"), formats, known_formats, cell_date).alias("value_date"),
        F.nullif(blank(cell("ref_no")), F.lit("")).alias("ref_no"), F.when(F.size(lines) > 0, lines).alias("narration_lines"), moved.alias("_m"))
    whole = Window.partitionBy(key)
    carried = F.min(F.when(F.col("_f") & F.col("balance").isNotNull(), F.struct("row_seq", "balance"))).over(whole)["balance"]
    issues = F.filter(F.array("_m.issue"), lambda i: i.isNotNull())
    rows = read.withColumn("_c", carried).where("not _f and txn_date is not null and balance is not null and _m is not null")
    rows = rows.select(key, F.row_number().over(whole.orderBy("row_seq")).alias("serial"), "txn_date", "value_date", F.coalesce(F.nullif("_n", F.lit("")), F.lit(NO_NARRATION)).alias("narration"), "narration_lines", "ref_no", F.col("_m.debit").alias("debit"), F.col("_m.credit").alias("credit"), "balance", confidence(F.col("_n"), F.lit(True), issues).alias("confidence"), issues.alias("issues"), "_c")
    rows = reorder_newest_first(rows)
    implied = F.min_by(F.col("balance") + F.coalesce("debit", F.lit(0)) - F.coalesce("credit", F.lit(0)), "serial").over(whole)
    return rows.withColumn("opening", F.coalesce("_c", implied).cast(MONEY)).withColumn("opening_inferred", F.col("_c").isNull()).drop("_c")


def signed_balance_of(cell: Column) -> Column:
    return once(cell_amount(cell), lambda a: F.when(a.isNotNull(), signed_balance(a))).cast(MONEY)


def statement_meta(rows: DataFrame, layouts: DataFrame, details: DataFrame, key: str = "statement_id") -> DataFrame:
    """One row per parsed statement: bank, layout, opening and closing balance, details and notices.
    `details` has a row per statement with what its cover tells."""
    ends = rows.groupBy(key).agg(F.min("opening").alias("opening"), F.max_by("balance", "serial").alias("closing"), F.bool_or("reversed").alias("_r"), F.bool_or("opening_inferred").alias("_i"))
    j = ends.join(layouts.select(key, F.col("bank").alias("bank_name"), F.col("layout_id").alias("template_id")), key).join(details, key, "left")
    notices = F.filter(F.array(F.when(F.col("_r"), F.lit(REVERSED)), F.when(F.col("_i"), F.lit(INFERRED))), lambda n: n.isNotNull())
    return j.withColumn("notices", notices).drop("_r", "_i")
