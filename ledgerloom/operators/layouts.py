"""How each shipped layout prints its table, learned layouts as rows of a table, and the fingerprint
by which a layout is known again."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import FORWARD, is_amount_like
from ..functions.text import read_date, squeeze
from .detection import LAYOUTS, ascii_bounds

FIELDS = ("date", "value_date", "narration", "ref_no", "debit", "credit", "amount", "flag", "balance")
NEEDED = ("date", "narration", "balance")
SEPARATE, SIGNED, FLAGGED = "separate-dr-cr", "signed-single", "amount-plus-flag"


@dataclass(frozen=True)
class Layout:
    """columns: a field's pattern of its header label, or its column number."""

    id: str
    bank: str
    formats: tuple[str, ...]
    style: str
    columns: dict[str, str | int] = field(hash=False)
    forward: str = FORWARD


# Date formats, amount style and header patterns of the shipped layouts, in registry order.
SHIPPED_COLUMNS = (
    ("hdfc-savings-v1", ("dd/MM/yy", "dd/MM/yyyy"), SEPARATE, {"date": "^date", "value_date": r"value\s*dt", "narration": "narration", "ref_no": "chq.*ref.*no", "debit": "withdrawal", "credit": "deposit", "balance": r"closing\s*balance"}),
    ("sbi-savings-v1", ("dd MMM yyyy", "dd-MMM-yyyy", "dd/MM/yyyy"), SEPARATE, {"date": r"txn\s*date", "value_date": r"value\s*date", "narration": "description", "ref_no": r"ref\s*no", "debit": "debit", "credit": "credit", "balance": "balance"}),
    ("icici-savings-v1", ("dd/MM/yyyy", "dd-MM-yyyy"), SEPARATE, {"date": r"transaction\s*date", "value_date": r"value\s*date", "narration": r"transaction\s*remarks", "ref_no": r"cheque\s*number", "debit": r"withdrawal\s*amount", "credit": r"deposit\s*amount", "balance": "^balance"}),
    ("axis-savings-v1", ("dd-MM-yyyy", "dd/MM/yyyy"), SEPARATE, {"date": r"tran\s*date", "narration": "particulars", "ref_no": r"chq\s*no", "debit": "debit", "credit": "credit", "balance": "balance"}),
    ("kotak-savings-v1", ("dd-MM-yyyy", "dd/MM/yyyy"), SIGNED, {"date": "^date", "narration": "narration", "ref_no": r"chq\s*/\s*ref\s*no", "amount": "withdrawal", "balance": "balance"}),
    ("pnb-savings-v1", ("dd-MM-yyyy", "dd/MM/yyyy"), FLAGGED, {"date": r"txn\s*date", "narration": "particulars", "ref_no": r"instrument\s*id", "amount": "amount", "flag": "type", "balance": "balance"}),
    ("bob-savings-v1", ("dd-MM-yyyy", "dd/MM/yyyy"), SEPARATE, {"date": r"tran\s*date", "narration": "narration", "ref_no": r"chq\s*/\s*ref\s*no", "debit": "debit", "credit": "credit", "balance": "balance"}),
    ("canara-savings-v1", ("dd-MMM-yy", "dd-MM-yyyy", "dd/MM/yyyy"), SEPARATE, {"date": r"^(?:txn\s*date|trans)$", "value_date": r"^(?:value\s*date|value)$", "narration": "description", "ref_no": r"cheque\s*no|ref\s*/\s*chq", "debit": "debit|withdraw", "credit": "credit|deposit", "balance": "balance"}),
    ("union-savings-v1", ("dd-MM-yyyy", "dd/MM/yyyy"), SEPARATE, {"date": "^date", "narration": "remarks|description|particulars", "ref_no": r"tran\s*id|cheque\s*/\s*ref\s*no", "debit": "withdrawal", "credit": "deposit", "balance": "balance"}),
    ("idfc-first-savings-v1", ("dd-MMM-yyyy", "dd-MM-yyyy", "dd/MM/yyyy"), SEPARATE, {"date": r"transaction\s*date", "value_date": r"value\s*date", "narration": "particulars", "ref_no": r"cheque\s*no", "debit": "debit", "credit": "credit", "balance": "balance"}),
    ("indian-bank-v1", ("MMM dd yyyy", "dd-MM-yyyy", "dd/MM/yyyy"), SEPARATE, {"date": "^date$", "narration": r"transaction\s*details", "debit": "^debits?$", "credit": "^credits?$", "balance": "^balance$"}),
    ("indusind-bank-v1", ("dd MMM yyyy", "dd-MM-yyyy"), SEPARATE, {"date": "^date$", "narration": "particulars", "ref_no": r"chq\s*no\s*/\s*ref\s*no", "debit": "withdrawal", "credit": "deposit", "balance": "^balance$"}),
)
BANK_OF = {i: bank for i, bank, _ in LAYOUTS}
SHIPPED = tuple(Layout(i, BANK_OF[i], formats, style, columns) for i, formats, style, columns in SHIPPED_COLUMNS)
LAYOUT_FIELDS = "layout_id string, bank string, formats array<string>, style string, columns map<string,string>, places map<string,int>, forward string"


def layout_table(spark: SparkSession, layouts: tuple[Layout, ...] = SHIPPED) -> DataFrame:
    """One row per layout; `columns` has patterns of header labels, `places` column numbers."""
    rows = [(x.id, x.bank, list(x.formats), x.style, {k: f"(?i){v}" for k, v in x.columns.items() if isinstance(v, str)}, {k: v for k, v in x.columns.items() if isinstance(v, int)}, x.forward) for x in layouts]
    return spark.createDataFrame(rows, LAYOUT_FIELDS)


def label_pattern(label: Column) -> Column:
    """A pattern of exactly this header label, but for case and white space around it."""
    return F.concat(F.lit("(?i)^"), F.regexp_replace(squeeze(label), r"([.*+?^$\{}()|\[\]\\])", r"\\$1"), F.lit("$"))


def learned_layouts(stored: DataFrame) -> DataFrame:
    """Layout rows of stored ones (key, bank, formats, style, columns: field to header label)."""
    patterns = F.transform_values(F.map_filter("columns", lambda k, v: F.coalesce(v, F.lit("")) != ""), lambda k, v: label_pattern(v))
    return stored.select("key", F.concat(F.lit("learned-"), F.left("key", F.lit(8))).alias("layout_id"), "bank", "formats", "style", patterns.alias("columns"), F.create_map().cast("map<string,int>").alias("places"), F.lit(FORWARD).alias("forward"))


def inferred_layouts(mappings: DataFrame) -> DataFrame:
    """Layout rows of inferred mappings (fingerprint, bank, formats, style, places: field to column; and
    statement_id, if they have it)."""
    own = ["statement_id"] if "statement_id" in mappings.columns else []
    return mappings.select(*own, "fingerprint", F.concat(F.lit("llm-inferred-"), F.left("fingerprint", F.lit(8))).alias("layout_id"), "bank", "formats", "style", F.create_map().cast("map<string,string>").alias("columns"), F.map_filter("places", lambda k, v: v.isNotNull()).alias("places"), F.lit(FORWARD).alias("forward"))


def mapping_error(style: Column, places: Column) -> Column:
    """UNSUPPORTED_LAYOUT where a mapping lacks a column of movements, or of flags that its style needs."""
    return F.when(mapping_lacks(style, places).isNotNull(), "UNSUPPORTED_LAYOUT")


def mapping_lacks(style: Column, places: Column) -> Column:
    """What a mapping lacks: `moves` for a column of movements, `flags` for that of flags; null if it is usable."""
    has = lambda k: F.try_element_at(places, F.lit(k)).isNotNull()
    moves = F.when(style == SEPARATE, has("debit") | has("credit")).otherwise(has("amount"))
    return F.when(~moves, "moves").when((style == FLAGGED) & ~has("flag"), "flags")


def storable(mappings: DataFrame, headers: DataFrame, key: str = "statement_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Stored layouts (key, bank, formats, style, columns) of mappings (statement, fingerprint, bank,
    formats, style, places) and their header rows (statement, cells); none where a needed label is blank.
    Columns of the mappings in `keep` are kept."""
    j = mappings.join(headers, key)
    labels = F.map_filter(F.transform_values("places", lambda k, v: F.nullif(squeeze(F.get(F.col("cells"), v)), F.lit(""))), lambda k, v: v.isNotNull())
    out = j.select(*keep, F.col("fingerprint").alias("key"), "bank", "formats", "style", labels.alias("columns"))
    return out.where(" and ".join(f"try_element_at(columns, '{n}') is not null" for n in NEEDED))


def upsert(stored: DataFrame, changed: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """The store (key, ...) after changed rows replace those of their keys and deleted keys go. The
    caller writes it to a new place: a Spark table cannot be read and overwritten at once."""
    gone = changed.select("key") if deleted is None else changed.select("key").unionByName(deleted.select("key"))
    return stored.join(gone, "key", "left_anti").unionByName(changed)


def newest_layouts(stored: DataFrame, most: int = 100) -> DataFrame:
    return stored.orderBy(F.desc("learned_at"), "key").limit(most)


# Words of column headings.
HEADER_WORDS = (
    "amount", "balance", "branch", "cheque", "chq", "closing", "cr", "credit", "credits", "date", "debit", "debits", "deposit", "deposits",
    "description", "details", "dr", "id", "instrument", "narration", "no", "number", "particulars", "ref", "reference", "remarks", "running",
    "serial", "sl", "sr", "tran", "transaction", "txn", "type", "utr", "value", "withdrawal", "withdrawals",
)
HEADING_CELLS, HEADING_LENGTH = 3, 32


def heading_words(cells: Column) -> Column:
    """Normal forms of a row's headings; none for rows of fewer than three cells or with a date or amount."""
    filled = F.filter(F.transform(cells, squeeze), lambda c: c != "")
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z]+"), lambda w: w != "")
    values = F.exists(filled, lambda c: read_date(c).isNotNull() | F.coalesce(is_amount_like(c), F.lit(False)))
    named = F.filter(filled, lambda c: (F.length(c) <= HEADING_LENGTH) & F.exists(words(c), lambda w: w.isin(*HEADER_WORDS)))
    return F.when((F.size(filled) >= HEADING_CELLS) & ~values, F.transform(named, lambda c: F.array_join(words(c), " "))).otherwise(F.array().cast("array<string>"))


def layout_fingerprint(grid: DataFrame, texts: DataFrame, key: str = "statement_id") -> DataFrame:
    """(key, fingerprint) of grids (key, row_seq, cells, edges) and page texts (key, text): the bank's code,
    the number of columns and the distinct headings."""
    heads = grid.select(key, F.size("edges").alias("n"), heading_words(F.col("cells")).alias("w")).groupBy(key).agg(F.max("n").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("w")))).alias("w"))
    code = F.nullif(F.regexp_extract(F.coalesce("text", F.lit("")), ascii_bounds(r"\b([A-Z]{4})0[A-Z0-9]{6}\b"), 1), F.lit(""))
    j = heads.join(texts.select(key, code.alias("code")), key, "left")
    return j.select(key, F.left(F.sha2(F.concat_ws(":", F.coalesce("code", F.lit("unknown")), F.col("n").cast("string"), F.array_join("w", "|")), 256), F.lit(32)).alias("fingerprint"))
