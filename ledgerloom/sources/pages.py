"""Uploads and pages: which files may be read, which pages are scans, and a page's text in reading
order. Frames have one row per file, page, image or run of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.grid import anchored_rows

# Bytes of an upload at most; runs of text below which a page may be a scan, pixels of
# images from which it is one; the distance of baselines that begins a line.
MOST_BYTES = 20 * 1024 * 1024
SPARSE_RUNS, SCAN_PIXELS, LINE = 20, 100_000, 2.0
ALL_SCANNED = "This PDF contains scanned images rather than selectable text. Download the digital statement from your bank instead — OCR is not supported."
SOME_SCANNED = "contain no selectable text (scanned image). Refusing to emit partial output."


def is_pdf(content: Column) -> Column:
    """By the bytes, never by the name."""
    return F.coalesce((F.length(content) > 4) & (F.substring(content, 1, 4) == F.lit(b"%PDF")), F.lit(False))


def upload_error(content: Column, size: Column) -> Column:
    return F.when(size > MOST_BYTES, "FILE_TOO_LARGE").when(~is_pdf(content), "NOT_A_PDF")


def scan_errors(pages: DataFrame, items: DataFrame, images: DataFrame, key: str = "statement_id") -> DataFrame:
    """(key, scanned_pages, error_code, error_message) of every statement with pages (key, page), runs of
    text (key, page) and images (key, page, width, height). A page of few runs is a scan if its images
    have pixels enough, or if they could not be read (a null size)."""
    own = [key, "page"]
    runs = items.groupBy(*own).agg(F.count("*").alias("_runs"))
    pixels = images.groupBy(*own).agg(F.sum(F.coalesce(F.col("width").cast("long") * F.col("height"), F.lit(SCAN_PIXELS))).alias("_pixels"))
    j = pages.select(*own).join(runs, own, "left").join(pixels, own, "left")
    scan = (F.coalesce("_runs", F.lit(0)) < SPARSE_RUNS) & (F.coalesce("_pixels", F.lit(0)) >= SCAN_PIXELS)
    out = j.groupBy(key).agg(F.count("*").alias("_n"), F.array_sort(F.collect_list(F.when(scan, F.col("page")))).alias("scanned_pages"))
    bad = F.size("scanned_pages")
    named = F.concat(F.when(bad > 1, "Pages ").otherwise("Page "), F.array_join(F.transform("scanned_pages", lambda p: p.cast("string")), ", "), F.lit(f" {SOME_SCANNED}"))
    return out.select(key, "scanned_pages", F.when(bad > 0, "SCANNED_PDF_UNSUPPORTED").alias("error_code"), F.when(bad == F.col("_n"), ALL_SCANNED).when(bad > 0, named).alias("error_message"))


def page_text(items: DataFrame, key: str = "statement_id") -> DataFrame:
    """(key, page, text): runs (key, page, x, y, seq, text) line by line, blanks between runs. A line takes
    what lies within 2 of its first run."""
    own = [key, "page"]
    placed = anchored_rows(items, own, F.lit(LINE))
    lines = placed.groupBy(*own, "row_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "seq", F.coalesce("text", F.lit("")).alias("text")))), lambda r: r["text"]), " ").alias("_t"))
    return lines.groupBy(*own).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "_t"))), lambda r: r["_t"]), "\n").alias("text"))


def first_page_text(items: DataFrame, key: str = "statement_id") -> DataFrame:
    """(key, first_page_text): what statement_text() gives, for those who need no other page's text."""
    first = items.groupBy(key).agg(F.min("page").alias("page"))
    return page_text(items.join(first, [key, "page"], "left_semi"), key).select(key, F.col("text").alias("first_page_text"))


def statement_text(pages: DataFrame, key: str = "statement_id") -> DataFrame:
    """(key, first_page_text, text) of page texts (key, page, text)."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n")
    return pages.groupBy(key).agg(F.min_by("text", "page").alias("first_page_text"), whole.alias("text"))
