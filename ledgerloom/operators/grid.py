"""Positioned text runs to rows and cells of a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, once, squeeze

# Row tolerance as a part of the median height, its least value, the height where none
# is known, the slack at a column's edge, and the gap, in parts of the font size, that makes a space.
ROW_PART, ROW_LEAST, HEIGHT, EDGE_SLACK, GAP_PART = 0.4, 1.0, 10.0, 2.5, 0.25
# Items that one task should sort at once.
ITEMS_OF_TASK = 400_000


def tasks_for(spark: SparkSession, n_items: int) -> int:
    """How many tasks share n_items, so that none's memory grows with the input. Left to itself, adaptive
    execution makes tasks of equal compressed size, and items compress to a small part of what sorts hold."""
    return max(spark.sparkContext.defaultParallelism, -(-n_items // ITEMS_OF_TASK))


def anchored_rows(items: DataFrame, page: list[str], tolerance: Column, tasks: int | None = None) -> DataFrame:
    """Adds row_no (from 0, by y): a row takes what lies within the tolerance (an aggregate of a page) of
    its first item. Only a page's distinct y's meet in one value, not its items. Pages are dealt to
    `tasks` tasks, if given (tasks_for())."""
    if tasks:
        items = items.repartition(tasks, *page)

    def anchor(kept: Column, y: Column) -> Column:
        return F.when((F.size(kept) == 0) | (y - F.element_at(kept, -1) > F.col("_tol")), F.concat(kept, F.array(y))).otherwise(kept)

    pages = items.groupBy(page).agg(tolerance.alias("_tol"), F.array_sort(F.collect_set(F.col("y").cast("double"))).alias("_ys"))
    pages = pages.withColumn("_anchors", F.aggregate("_ys", F.array().cast("array<double>"), anchor)).drop("_ys", "_tol")
    return items.join(pages, page).withColumn("row_no", F.size(F.filter("_anchors", lambda a: a <= F.col("y"))) - 1).drop("_anchors")


def cluster_rows(items: DataFrame, page: list[str], part: float = ROW_PART, tasks: int | None = None) -> DataFrame:
    """Adds row_no to items (page columns, x, y, height), with a tolerance from the page's median height."""
    median = F.coalesce(F.nullif(F.median("height"), F.lit(0.0)), F.lit(HEIGHT))
    return anchored_rows(items, page, F.greatest(F.lit(ROW_LEAST), F.lit(part) * median), tasks)


def column_of(x: Column, edges: Column) -> Column:
    """The last column whose left edge x reaches, 0 at least."""
    return F.greatest(F.size(F.filter(edges, lambda e: x + EDGE_SLACK >= e)) - 1, F.lit(0))


def join_runs(runs: Column) -> Column:
    """Text of a cell from its runs (x, seq, width, font_size, text)."""
    start = F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("right"), F.lit(None).cast("double").alias("font"))

    def add(a: Column, r: Column) -> Column:
        apart = a["right"].isNotNull() & (r["x"] - a["right"] > GAP_PART * a["font"]) & ~a["text"].rlike(r"\s$") & ~r["text"].rlike(r"^\s")
        return F.struct(F.concat(a["text"], F.when(apart, " ").otherwise(""), r["text"]).alias("text"), (r["x"] + r["width"]).cast("double").alias("right"), r["font_size"].cast("double").alias("font"))

    def tidy(text: Column) -> Column:
        """Texts of visible ASCII alone have no white space to look for."""
        return F.when(text.rlike("[^!-~]"), squeeze(F.regexp_replace(text, f"{SPACE}+", " "))).otherwise(text)

    return once(runs, lambda rs: F.when(F.size(rs) == 0, "").when(F.size(rs) == 1, tidy(F.get(rs, F.lit(0))["text"])).otherwise(F.aggregate(F.array_sort(rs), start, add, lambda a: tidy(a["text"]))))


def grid_cells(items: DataFrame, page: list[str], edges: Column, n_columns: int) -> DataFrame:
    """(page columns, row_no, y, cells) of items (x, y, width, height, font_size, seq, text)."""
    placed = cluster_rows(items, page).withColumn("_col", column_of(F.col("x"), edges))
    run = F.struct(F.col("x").cast("double").alias("x"), "seq", F.col("width").cast("double").alias("width"), F.col("font_size").cast("double").alias("font_size"), "text")
    cells = [F.coalesce(join_runs(F.collect_list(F.when(F.col("_col") == c, run))), F.lit("")) for c in range(n_columns)]
    return placed.groupBy(*page, "row_no").agg(F.median("y").alias("y"), F.array(*cells).alias("cells"))


def markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))


def grid_markdown(rows: DataFrame, key: str, n_columns: int, most: int = 60, order: tuple[str, ...] = ("row_no",)) -> DataFrame:
    """(key, markdown): the first `most` rows of each grid (key, order, cells) as a table. With order
    ("page", "row_no") a grid spans all pages of its key."""
    head = "| " + " | ".join(f"col{i}" for i in range(n_columns)) + " |\n| " + " | ".join(["---"] * n_columns) + " |"
    numbered = rows.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_place") <= most)
    lines = numbered.select(key, F.struct("_place", markdown_row(F.col("cells")).alias("line")).alias("r"))
    body = lines.groupBy(key).agg(F.array_sort(F.collect_list("r")).alias("rs"))
    return body.select(key, F.concat_ws("\n", F.lit(head), F.col("rs.line")).alias("markdown"))
