"""Where the columns of a statement begin, from the ink of its rows. A statement's coverage is held as
runs of equal count (start, length, count), never as bins, and all folds run over these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import is_amount_like
from ..functions.text import read_date
from ..sources.shared import Stages
from .grid import ROW_PART, cluster_rows, column_of, join_runs

# Fixed values of column detection. Band: rows with a date and an amount; the least number of such
# rows, width of a bin, least gap, part of the rows that may have ink in a gap. Coverage: width of a
# bin, runs of a row, part of the highest count that is a rise, bins of equal count within a climb,
# part of the rows in a gap, narrowest gap, edges that are one. Left edges: part of the rows, at least
# so many. Split of a run: least overhang, as a part of its width. Bins at most.
BAND_ROWS, BAND_BIN, BAND_GAP, BAND_LEAK = 5, 1.0, 3.0, 0.2
BIN, TABLE_RUNS, RISE, PLATEAU, GUTTER_LEAK, COLUMN_GAP, SAME_EDGE = 3.0, 3, 0.15, 2, 0.08, 6.0, 8.0
SUPPORT, LEAST_SUPPORT = 0.1, 3
OVERHANG, OVERHANG_PART = 12.0, 0.06
MOST_BINS = 100_000
FEWEST = 3


def with_band(items: DataFrame, row: list[str], formats: tuple[str, ...] = ()) -> DataFrame:
    """Adds band (the row holds a date and an amount), runs (the row's number of items), lead (whether the
    item is its row's first), reach and end (how far the ink of the row's items before it, and of all of
    them, goes). Dates are those of `formats` and of the default formats. One sort serves all."""
    order = Window.partitionBy(*row).orderBy("x", "seq")
    own = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dated = F.bool_or(F.coalesce(read_date(F.col("text"), formats).isNotNull(), F.lit(False))).over(own)
    priced = F.bool_or(F.coalesce(is_amount_like(F.col("text")), F.lit(False))).over(own)
    right = (F.col("x") + F.greatest("width", F.lit(1.0))).cast("double")
    ink = {"reach": F.max(right).over(order.rowsBetween(Window.unboundedPreceding, -1)), "end": F.max(right).over(own)}
    return items.withColumns({"_d": dated, "_a": priced, "runs": F.count("*").over(own), "lead": F.row_number().over(order) == 1, **ink}).withColumn("band", F.col("_d") & F.col("_a")).drop("_d", "_a")


BAND, COVER = "band", "coverage"


def coverage(items: DataFrame, key: str, tasks: int | None = None) -> DataFrame:
    """(key, shape, least_x, n_rows, segments) for the shapes `band` (rows of the band, bins of 1) and
    `coverage` (rows of three runs or more, bins of 3): over bins from the leftmost ink, the number of
    rows with ink, as runs (at, size, n). Statements of more than MOST_BINS bins are left out. Rows meet
    as counts of their breaks: where ink ends (null before the first) and where the next item begins
    (null after the last). Statements are dealt to `tasks` tasks, if given."""
    breaks = F.array(F.when(F.col("x").isNotNull(), F.struct(F.col("reach").alias("until"), F.col("x").cast("double").alias("since"))), F.when(F.col("lead") & F.col("end").isNotNull(), F.struct(F.col("end").alias("until"), F.lit(None).cast("double").alias("since"))))
    table = F.col("runs") >= TABLE_RUNS
    broken = items.where(F.col("band") | table).select(key, "band", table.alias("table"), F.inline(F.filter(breaks, lambda b: b.isNotNull())))
    broken = broken.groupBy(key, "band", "table", "until", "since").agg(F.count("*").alias("n"))
    broken = broken.repartition(tasks, key) if tasks else broken
    shapes = F.filter(F.array(F.when(F.col("band"), F.struct(F.lit(BAND).alias("shape"), F.lit(BAND_BIN).alias("bin"))), F.when(F.col("table"), F.struct(F.lit(COVER).alias("shape"), F.lit(BIN).alias("bin")))), lambda s: s.isNotNull())
    whole = Window.partitionBy(key, "shape")
    inked = broken.select(key, "until", "since", "n", F.inline(shapes)).withColumn("least_x", F.min("since").over(whole)).withColumn("_most", F.max("until").over(whole))
    inked = inked.withColumn("_bins", F.ceil((F.col("_most") - F.col("least_x")) / F.col("bin")) + 1).where((F.col("_bins") <= MOST_BINS) & (F.col("_most") > F.col("least_x")))
    inked = inked.select(key, "shape", "least_x", "_bins", "n", F.floor((F.col("since") - F.col("least_x")) / F.col("bin")).alias("low"), F.when(F.col("until").isNotNull(), F.least(F.col("_bins"), F.ceil((F.col("until") - F.col("least_x")) / F.col("bin")))).alias("high"))
    step = lambda at, n: F.struct(at.cast("bigint").alias("at"), n.alias("step"))
    n, first, last = F.col("n"), F.col("high").isNull(), F.col("low").isNull()
    apart = first | last | (F.col("low") > F.col("high"))
    made = F.array(F.when(first, step(F.lit(-1), n)), F.when(apart & ~last, step(F.col("low"), n)), F.when(apart & ~first, step(F.col("high"), -n)))
    steps = inked.select(key, "shape", "least_x", "_bins", F.inline(F.filter(made, lambda m: m.isNotNull())))
    # The row of bin -1 counts the rows, so one aggregation gives both.
    steps = steps.groupBy(key, "shape", "least_x", "_bins", "at").agg(F.sum("step").alias("step")).where("step <> 0")
    lists = steps.groupBy(key, "shape", "least_x", "_bins").agg(F.max(F.when(F.col("at") < 0, F.col("step"))).alias("n_rows"), F.array_sort(F.collect_list(F.when(F.col("at") >= 0, F.struct("at", "step")))).alias("c"))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.array().cast("array<struct<at:bigint,n:bigint>>").alias("out"))
    added = F.aggregate("c", start, lambda a, c: F.struct((a["n"] + c["step"]).alias("n"), F.concat(a["out"], F.array(F.struct(c["at"].alias("at"), (a["n"] + c["step"]).alias("n")))).alias("out")), lambda a: a["out"])
    lists = lists.withColumn("c", added)
    after = F.concat(F.slice(F.transform("c", lambda c: c["at"]), 2, F.size("c")), F.array("_bins"))
    return lists.withColumn("_e", after).select(key, "shape", "least_x", "n_rows", F.zip_with("c", "_e", lambda c, e: F.struct(c["at"].alias("at"), (e - c["at"]).alias("size"), c["n"].alias("n"))).alias("segments"))


def gutters(segments: Column, leak: Column, least: int, resume: bool) -> Column:
    """Bins where a gutter begins, or where ink resumes after it: stretches of `least` bins or more, not
    at the left end and with ink after them, where `leak` rows have ink at most."""
    none = F.array().cast("array<bigint>")
    start = F.struct(F.lit(-1).cast("bigint").alias("since"), none.alias("out"))

    def step(a: Column, s: Column) -> Column:
        wide = (a["since"] > 0) & (s["at"] - a["since"] >= least)
        low = F.struct(F.when(a["since"] < 0, s["at"]).otherwise(a["since"]).alias("since"), a["out"].alias("out"))
        ink = F.struct(F.lit(-1).cast("bigint").alias("since"), F.when(wide, F.concat(a["out"], F.array(s["at"] if resume else a["since"]))).otherwise(a["out"]).alias("out"))
        return F.when(s["n"] <= leak, low).otherwise(ink)

    return F.aggregate(segments, start, step, lambda a: a["out"])


def climbs(segments: Column) -> Column:
    """Maximal climbs (at, rise) of the count: each next run is higher, and all but the last are short."""
    none = F.array().cast("array<struct<at:bigint,rise:bigint>>")
    first = F.struct(F.lit(None).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("floor"), none.alias("out"))

    def ended(a: Column) -> Column:
        return F.when(a["at"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(a["at"].alias("at"), (a["n"] - a["floor"]).alias("rise")))))

    def step(a: Column, s: Column) -> Column:
        rises = a["n"].isNotNull() & (s["n"] > a["n"])
        goes_on = rises & a["at"].isNotNull() & (a["size"] <= PLATEAU + 1)
        at = F.when(goes_on, a["at"]).when(rises, s["at"])
        return F.struct(s["n"].alias("n"), s["size"].alias("size"), at.alias("at"), F.when(goes_on, a["floor"]).when(rises, a["n"]).otherwise(F.lit(0)).alias("floor"), F.when(goes_on, a["out"]).otherwise(ended(a)).alias("out"))

    return F.aggregate(segments, first, step, ended)


def merge_nearby(values: Column, within: float = SAME_EDGE) -> Column:
    """Ascending distinct values; one that is within reach of the last kept goes."""
    def keep(out: Column, v: Column) -> Column:
        return F.when((F.size(out) == 0) | (v - F.element_at(out, -1) > within), F.concat(out, F.array(v))).otherwise(out)

    return F.aggregate(F.array_sort(F.array_distinct(values)), F.array().cast("array<double>"), keep)


def edges_of_band() -> Column:
    """Edges from the gutters of rows with a date and an amount, each where its gutter begins; none from
    fewer than five such rows."""
    leak = F.greatest(F.lit(1), F.floor(F.col("n_rows") * BAND_LEAK))
    found = gutters(F.col("segments"), leak, max(1, round(BAND_GAP / BAND_BIN)), False)
    return F.when(F.col("n_rows") >= BAND_ROWS, F.concat(F.array("least_x"), F.transform(found, lambda b: F.col("least_x") + b * BAND_BIN)))


def edges_of_coverage(gap: float = COLUMN_GAP) -> Column:
    """Edges from climbs of the coverage and from where ink resumes after a gutter."""
    top = F.array_max(F.transform("segments", lambda s: s["n"]))
    steep = F.filter(climbs(F.col("segments")), lambda c: c["rise"] >= F.greatest(F.lit(2.0), top * RISE))
    leak = F.greatest(F.lit(1), F.floor(F.col("n_rows") * GUTTER_LEAK))
    bins = F.concat(F.transform(steep, lambda c: c["at"]), gutters(F.col("segments"), leak, max(1, int(gap / BIN + 0.5)), True))
    return merge_nearby(F.concat(F.array("least_x"), F.transform(bins, lambda b: F.col("least_x") + b * BIN)))


def greedy_peaks(peaks: Column, apart: float) -> Column:
    """Places x of peaks (place in the order of choice first), the strongest first; one nearer than
    `apart` to one taken goes. Ascending."""
    def take(out: Column, p: Column) -> Column:
        return F.when(F.exists(out, lambda x: F.abs(x - p["x"]) < apart), out).otherwise(F.concat(out, F.array(p["x"])))

    return F.array_sort(F.aggregate(F.array_sort(peaks), F.array().cast("array<double>"), take))


def edges_of_left(items: DataFrame, key: str, page: list[str], apart: float = COLUMN_GAP, support: float = SUPPORT) -> DataFrame:
    """(key, left_edges): peaks of the histogram of left edges, each bin with its two neighbours."""
    seen = F.min(F.struct(*[c for c in page if c != key], "row_no", "x", "seq")).alias("seen")
    bins = items.groupBy(key, F.floor(F.col("x") / BIN + 0.5).alias("bin")).agg(F.count("*").alias("n"), F.avg("x").alias("x"), seen, F.count_if("lead").alias("leads"))
    whole = Window.partitionBy(key)
    bins = bins.withColumn("weight", F.sum("n").over(whole.orderBy("bin").rangeBetween(-1, 1))).withColumn("n_rows", F.sum("leads").over(whole))
    strong = F.col("weight") >= F.greatest(F.lit(LEAST_SUPPORT), F.ceil(F.col("n_rows") * support))
    peaks = F.collect_list(F.when(strong, F.struct((-F.col("weight")).alias("order"), "seen", "x")))
    return bins.groupBy(key).agg(greedy_peaks(peaks, apart).alias("left_edges"))


def column_edges(items: DataFrame, key: str, page: list[str], gap: float = COLUMN_GAP, support: float = SUPPORT, tasks: int | None = None) -> DataFrame:
    """(key, edges) of every statement with items (page columns, row_no, seq, x, width, and what
    with_band() adds): those of the band if three or more, else of the coverage if three or more, else
    the more of coverage and left edges, the coverage's of equally many. `tasks` is that of coverage()."""
    none = F.array().cast("array<double>")
    shapes = coverage(items, key, tasks).withColumn("e", F.when(F.col("shape") == BAND, edges_of_band()).otherwise(edges_of_coverage(gap)))
    found = shapes.groupBy(key).agg(*(F.max(F.when(F.col("shape") == s, F.col("e"))).alias(s) for s in (BAND, COVER)))
    out = edges_of_left(items, key, page, gap, support).join(found, key, "left")
    band, cover, left = (F.coalesce(c, none) for c in (BAND, COVER, "left_edges"))
    return out.select(key, F.when(F.size(band) >= FEWEST, band).when(F.size(cover) >= FEWEST, cover).when(F.size(left) > F.size(cover), left).otherwise(cover).alias("edges"))


def nearest_space(text: Column, target: Column) -> Column:
    """Place (from 0) of the white space nearest to `target`, inside the text and near enough, the left
    one of two; else null."""
    n = F.length(text)
    reach = F.greatest(F.lit(4), F.floor(n * 0.25 + 0.5))
    inside = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    spaces = F.filter(inside, lambda i: F.substring(text, i + 1, F.lit(1)).rlike(r"^[\s ]$"))
    ranked = F.transform(spaces, lambda i: F.struct(F.abs(i - target).alias("d"), i.alias("i")))
    return F.array_min(F.filter(ranked, lambda r: r["d"] <= reach))["i"]


def split_run(run: Column, edges: Column) -> Column:
    """Pieces (column, run) of a run (x, seq, width, font_size, text) that reaches over edges: cut at the
    space nearest to each edge that it overhangs by enough. A piece begins at its column's edge."""
    first = column_of(run["x"], edges)
    right = run["x"] + run["width"]
    n = F.length(run["text"])
    kept = F.array().cast("array<struct<cut:bigint,col:int>>")
    later = F.when(first + 1 < F.size(edges), F.sequence(first + 1, F.size(edges) - 1)).otherwise(F.array().cast("array<int>"))

    def cut(out: Column, c: Column) -> Column:
        edge = F.get(edges, c)
        over = right - edge
        far = (over > 0) & (over >= OVERHANG) & (over >= run["width"] * OVERHANG_PART)
        at = F.when(far, nearest_space(run["text"], F.floor((edge - run["x"]) / run["width"] * n + 0.5)))
        last = F.coalesce(F.try_element_at(out, F.lit(-1))["cut"], F.lit(0))
        return F.when(at.isNotNull() & (at > last), F.concat(out, F.array(F.struct(at.cast("bigint").alias("cut"), c.alias("col"))))).otherwise(out)

    cuts = F.aggregate(later, kept, cut)
    whole = F.array(F.struct(first.alias("col"), run.alias("run")))

    def pieces(cs: Column) -> Column:
        starts = F.concat(F.array(F.struct(F.lit(0).cast("bigint").alias("cut"), first.alias("col"))), cs)
        ends = F.concat(F.transform(cs, lambda c: c["cut"]), F.array(n.cast("bigint")))
        made = F.zip_with(starts, ends, lambda s, e: F.struct(s["col"].alias("col"), F.struct(F.get(edges, s["col"]).alias("x"), run["seq"].alias("seq"), ((e - s["cut"]) / n * run["width"]).alias("width"), run["font_size"].alias("font_size"), F.trim(F.substring(run["text"], (s["cut"] + 1).cast("int"), (e - s["cut"]).cast("int"))).alias("text")).alias("run")))
        made = F.filter(made, lambda p: p["run"]["text"] != "")
        return F.when((F.size(cs) > 0) & (F.size(made) > 0), made).otherwise(whole)

    reaches = (run["width"] > 0) & (n >= 2) & (right > F.coalesce(F.get(edges, first + 1), right))
    return F.when(reaches, F.transform(F.array(cuts), pieces)[0]).otherwise(whole)


def build_grid(items: DataFrame, key: str = "statement_id", page: str = "page", gap: float = COLUMN_GAP, support: float = SUPPORT, row_part: float = ROW_PART, formats: tuple[str, ...] = (), tasks: int | None = None, stages: Stages | None = None) -> DataFrame:
    """(key, row_seq from 0, page, y, cells, edges) of items (key, page, x, y, width, height, font_size,
    seq, text): rows by baseline, columns by the ink of all pages of a statement, cells by the columns.
    Only rows with a date and an amount have runs split. Without edges a row is one cell. `formats` are date
    formats beside the default ones that statements may have: without theirs, columns come from the coverage,
    which can take a right-aligned column with few wide amounts for two. `tasks` is that of cluster_rows(). With
    `stages` the placed items, which edges and cells read three times, are written once."""
    pages = [key, page]
    row = [*pages, "row_no"]
    placed = with_band(cluster_rows(items, pages, row_part, tasks), row, formats)
    placed = stages.write(placed.select(*row, "x", "y", "seq", "width", "font_size", "text", "band", "runs", "lead", "reach", "end"), "placed") if stages else placed
    edges = column_edges(placed, key, pages, gap, support, tasks)
    run = F.struct(F.col("x").cast("double").alias("x"), F.col("seq").cast("bigint").alias("seq"), F.col("width").cast("double").alias("width"), F.col("font_size").cast("double").alias("font_size"), "text")
    placed = placed.join(edges, key).select(*row, "edges", "y", "band", run.alias("_r"))
    whole = F.array(F.struct(column_of(F.col("_r.x"), F.col("edges")).alias("col"), F.col("_r").alias("run")))
    spread = placed.withColumn("_p", F.when(F.col("band"), split_run(F.col("_r"), F.col("edges"))).otherwise(whole))
    rows = spread.groupBy(*row).agg(F.median("y").alias("y"), F.first("edges").alias("edges"), F.flatten(F.collect_list("_p")).alias("_p"))
    cells = F.transform(F.sequence(F.lit(0), F.greatest(F.size("edges") - 1, F.lit(0))), lambda c: join_runs(F.transform(F.filter("_p", lambda p: p["col"] == c), lambda p: p["run"])))
    all_text = F.array(F.trim(F.array_join(F.transform(F.array_sort(F.transform("_p", lambda p: F.struct(p["run"]["x"].alias("x"), p["run"]["seq"].alias("seq"), p["run"]["text"].alias("text")))), lambda r: r["text"]), " ")))
    rows = rows.select(*row, "y", "edges", F.when(F.size("edges") > 0, cells).otherwise(all_text).alias("cells"))
    return rows.withColumn("row_seq", F.row_number().over(Window.partitionBy(key).orderBy(page, "row_no")) - 1).select(key, "row_seq", page, "y", "cells", "edges")
