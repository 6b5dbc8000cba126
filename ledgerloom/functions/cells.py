"""Readers of cells that may hold more than their value (a neighbour's text run into them), and the
kinds of rows below a header. Column expressions throughout."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, amount_sql, applied, date_shape, date_sql, flag_sql, has_amount_shape, quoted, read_date, squeeze

# Rows that carry a balance forward, a time alone, a debit or credit mark alone.
FORWARD = r"(?i)^(?:opening\s+balance|balance\s+(?:b/f|brought\s+forward)|b/f)"
BARE_TIME = r"^\d{1,2}:\d{2}(?::\d{2})?(?:\s*[AaPp][Mm])?$"
BARE_MARK = r"(?i)^\(?(?:dr|cr)\.?\)?$"
LONGEST_DATE = 4


TOKENS = f"filter(split(coalesce(t, ''), {quoted(SPACE + '+')}), x -> x <> '')"


def first_sql(values: str) -> str:
    return f"get(filter({values}, x -> x IS NOT NULL), 0)"


@cache
def cell_flag_sql() -> str:
    return f"coalesce({flag_sql()}, {first_sql(f'transform({TOKENS}, t -> {flag_sql()})')})"


def cell_flag(cell: Column) -> Column:
    return applied(cell, cell_flag_sql())


@cache
def cell_amount_sql() -> str:
    made = lambda magnitude, marker, below: f"named_struct('magnitude', {magnitude}, 'marker', {marker}, 'negative', {below})"
    mark = f"coalesce(q.marker, {first_sql(f'transform(ts, t -> {flag_sql()})')})"
    below = "CASE WHEN k = 'Dr' THEN true WHEN k = 'Cr' THEN false ELSE q.negative AND q.magnitude <> 0 END"
    part = f"CASE WHEN q IS NOT NULL THEN transform(array({mark}), k -> {made('q.magnitude', 'k', below)})[0] END"
    parts = f"transform(array({TOKENS}), ts -> transform(array({first_sql(f'transform(ts, t -> {amount_sql()})')}), q -> {part})[0])[0]"
    whole = made("w.magnitude", "w.marker", "w.negative AND w.magnitude <> 0")
    return f"CASE WHEN t RLIKE '[0-9]' THEN transform(array({amount_sql()}), w -> CASE WHEN w IS NOT NULL THEN {whole} ELSE {parts} END)[0] END"


def cell_amount(cell: Column) -> Column:
    """struct(magnitude, marker, negative) of the whole cell, else of its first token that is an
    amount, whose marker may be another token; null where there is none."""
    return applied(cell, cell_amount_sql())


def signed_balance(amount: Column) -> Column:
    return F.when(amount["negative"], -amount["magnitude"]).otherwise(amount["magnitude"])


@cache
def cell_date_sql(formats: tuple[str, ...] = ()) -> str:
    shape = quoted(date_shape(formats))
    runs = [f"CASE WHEN size(ts) >= {n} THEN transform(sequence(1, greatest(size(ts) - {n - 1}, 1)), i -> array_join(slice(ts, i, {n}), ' ')) ELSE CAST(array() AS ARRAY<STRING>) END" for n in range(LONGEST_DATE, 0, -1)]
    found = first_sql(f"transform(filter(concat({', '.join(runs)}), x -> x RLIKE {shape}), t -> {date_sql(formats)})")
    return f"CASE WHEN t RLIKE {shape} THEN coalesce({date_sql(formats)}, transform(array({TOKENS}), ts -> {found})[0]) END"


def cell_date(cell: Column, formats: tuple[str, ...] = ()) -> Column:
    """The whole cell's date, else that of the longest run of tokens, the first of equal length. A run
    is only read if it has a date's shape; a cell without such a shape is not taken apart."""
    return applied(cell, cell_date_sql(tuple(formats)))


def is_amount_like(cell: Column) -> Column:
    """Whether a cell has the shape of an amount, even one too large to hold."""
    return has_amount_shape(cell)


def carries_forward(narration: Column) -> Column:
    return squeeze(narration).rlike(FORWARD)


def confidence(narration: Column, moved: Column, issues: Column) -> Column:
    return F.when(F.size(issues) > 0, "low").when((F.coalesce(narration, F.lit("")) == "") | ~moved, "medium").otherwise("high")


def row_kind(cells: Column, date_at: int, amounts: list[int], texts: list[int], header: Column, formats: tuple[str, ...] = ()) -> Column:
    """T: has a date or an amount. B: blank. C: continues the row above: nothing but text in text
    columns, bare marks in amount columns and, beside these, a time. H: the header again. S: all else."""
    clean = F.transform(cells, lambda c: squeeze(F.coalesce(c, F.lit(""))))
    dated = read_date(F.get(cells, F.lit(date_at)), formats).isNotNull()
    priced = F.exists(F.array(*[F.coalesce(is_amount_like(F.get(cells, F.lit(a))), F.lit(False)) for a in amounts]), lambda x: x)

    def fits(cell: Column, at: Column) -> Column:
        mine = at.isin(texts) | (at.isin(amounts) & cell.rlike(BARE_MARK))
        return F.when(cell == "", 0).when(mine, 1).when(cell.rlike(BARE_TIME), 0).otherwise(2)

    found = F.transform(clean, fits)
    same = F.zip_with(clean, header, lambda a, b: F.lower(F.coalesce(a, F.lit(""))) == F.lower(squeeze(F.coalesce(b, F.lit("")))))
    filled = F.size(F.filter(clean, lambda c: c != ""))
    return (F.when(dated | priced, "T").when(filled == 0, "B").when(F.array_contains(found, 1) & ~F.array_contains(found, 2), "C")
            .when(F.coalesce(F.forall(same, lambda s: s), F.lit(False)) & (filled >= 2), "H").otherwise("S"))
