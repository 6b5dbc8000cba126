"""Registered queries of the whole conversion, over the printed statements of `printed`. By their ids some
state a wrong count, pick a learned layout or a wrong bank, were refused on upload, or may not ask a model; of those that
may, some mappings lack a column or point below the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.columns import build_grid
from ..operators.convert import LEARNED_HINT, MESSAGES, NO_MOVES, Conversion, convert_statements
from ..operators.layouts import FIELDS, SHIPPED, layout_fingerprint
from ..operators.parse import all_formats
from ..sources.shared import Stages
from .printed import FORMATS, LABELS, PRINTED, learned_store, printed_items, texts_of
from .statements import double

#: A layout whose narration no other bank's table has.
WRONG = "indian-bank-v1"
BELOW = 99_999


def printed_conversion(spark, sf_dir) -> Conversion:
    s = F.col("statement_id")
    stages = Stages(spark)
    text = F.when((s % 11 == 0) & F.col("text").startswith("Total: "), F.lit("Total: 99999 transactions")).otherwise(F.col("text"))
    items = stages.write(printed_items(spark, sf_dir).withColumn("text", text), "printed")
    grid = stages.write(build_grid(items, formats=all_formats(FORMATS), stages=stages), "all-grids")
    texts = stages.write(texts_of(items), "all-texts")
    prints = stages.write(layout_fingerprint(grid, texts.select("statement_id", F.col("first_page_text").alias("text"))), "all-prints")
    store = stages.write(learned_store(spark, prints), "store")
    place = (s % len(SHIPPED)).cast("int")
    hinted = prints.select("statement_id", place.alias("place")).join(F.broadcast(store.select("place", "key")), "place", "left")
    hint = F.when(s % 13 == 0, F.concat(F.lit(LEARNED_HINT), F.coalesce("key", F.lit("none")))).when(s % 7 == 0, WRONG)
    refused = s % 17 == 0
    statements = hinted.select("statement_id", hint.alias("hint"), (s % 4 != 0).alias("consent"), F.when(refused, "PASSWORD_REQUIRED").alias("error_code"), F.when(refused, "locked").alias("error_message"))
    made = [(i, f"{x.bank} (learned)", list(x.formats[:1]), x.style, {f: list(LABELS[i]).index(f) if f in LABELS[i] else None for f in FIELDS}) for i, x in enumerate(SHIPPED)]
    answers = spark.createDataFrame(made, "place int, bank string, formats array<string>, style string, places map<string,int>")
    lacks = F.map_filter("places", lambda k, v: ~k.isin("debit", "credit", "amount"))
    mappings = prints.where(s % 2 == 1).select("statement_id", place.alias("place")).join(F.broadcast(answers), "place").select("statement_id", "bank", "formats", "style", F.when(s % 5 == 0, lacks).otherwise(F.col("places")).alias("places"), F.when(s % 9 == 0, BELOW).otherwise(4).alias("header_seq"))
    return convert_statements(statements, items, store.drop("place"), mappings, stages, (grid, texts))


def converted_statements(spark, sf_dir) -> DataFrame:
    """One row for each statement given, converted or not, with figures of its transactions."""
    made = printed_conversion(spark, sf_dir)
    rows = made.transactions.groupBy("statement_id").agg(F.max("serial").cast("long").alias("last_serial"), F.min("txn_date").alias("since"), F.count("ref_no").alias("n_refs"))
    r = made.results.join(rows, "statement_id", "left")
    return r.select("statement_id", "ok", F.col("tier").cast("long").alias("tier"), "parsed_by", "error_code", "bank_name", "n_rows", *double("total_debit", "total_credit", "closing"), F.coalesce("reconciles", F.lit(False)).alias("reconciles"), "used", "evicted", "stored", F.size("notices").cast("long").alias("n_notices"), F.get("notices", F.lit(0)).alias("first_notice"), F.length("error_message").cast("long").alias("message_length"), "last_serial", "since", "n_refs")


QUERIES = {f.__name__: f for f in (converted_statements,)}

_in = lambda places: "s % 12 IN (" + ", ".join(map(str, places)) + ")"
_banks = "[" + ", ".join(f"'{x.bank}'" for x in SHIPPED) + "][s % 12 + 1]"
_kept = _in([i for i in range(12) if i % 3])
CASES = f"""{PRINTED}, t AS (SELECT statement_id AS s, count(*) AS n, CAST(sum(CASE WHEN paid THEN a ELSE 0 END) AS DOUBLE) AS debits, CAST(sum(CASE WHEN NOT paid THEN a ELSE 0 END) AS DOUBLE) AS credits, CAST(arg_max(balance, serial) AS DOUBLE) AS closing, min(txn_date) AS since, max(txn_date) AS until FROM l GROUP BY 1),
c AS (SELECT *, s % 17 = 0 AS refused, s % 11 = 0 AS odd, s % 4 <> 0 AS consent, {_kept} AS kept, {_kept} AND s % 13 = 0 AS picked, s % 7 = 0 AND s % 13 <> 0 AND s % 12 <> 10 AS wrong, s % 2 = 1 AS asked, s % 5 = 0 AND {_in(range(12))} AS lacks, s % 9 = 0 AS below, {_in([i for i, x in enumerate(LABELS) if 'ref_no' in x])} AS refs,
 CASE WHEN s % 5 = 0 AND since < until THEN 1 ELSE 0 END AS own FROM t),
d AS (SELECT *, CASE WHEN refused THEN NULL WHEN picked AND NOT odd THEN 1 WHEN NOT wrong AND (NOT odd OR NOT consent) THEN 2 WHEN kept AND NOT odd THEN 3 WHEN consent AND asked AND NOT lacks AND NOT below THEN 4 END AS tier FROM c),
e AS (SELECT *, NOT refused AND (tier IS NULL OR tier = 4) AND kept AS evicted, tier = 4 AND NOT odd AS stored FROM d)"""
ORACLE = {
    "converted_statements": f"""WITH {CASES} SELECT s AS statement_id, tier IS NOT NULL AS ok, CAST(tier AS BIGINT) AS tier, CASE WHEN tier = 4 THEN 'llm' WHEN tier IS NOT NULL THEN 'template' END AS parsed_by,
 CASE WHEN refused THEN 'PASSWORD_REQUIRED' WHEN tier IS NOT NULL THEN NULL WHEN NOT consent THEN 'PARSE_FAILED' WHEN NOT asked THEN 'LLM_UNAVAILABLE' WHEN lacks THEN 'UNSUPPORTED_LAYOUT' ELSE 'NO_TRANSACTIONS_FOUND' END AS error_code,
 CASE WHEN tier = 4 THEN {_banks} || ' (learned)' WHEN tier IS NOT NULL THEN {_banks} END AS bank_name, CASE WHEN tier IS NOT NULL THEN n END AS n_rows, CASE WHEN tier IS NOT NULL THEN debits END AS total_debit, CASE WHEN tier IS NOT NULL THEN credits END AS total_credit, CASE WHEN tier IS NOT NULL THEN closing END AS closing,
 tier IS NOT NULL AND NOT odd AS reconciles, coalesce(tier IN (1, 3), false) AS used, evicted, coalesce(stored, false) AS stored,
 CAST(CASE WHEN refused THEN 0 WHEN tier = 1 THEN own + 1 WHEN tier = 2 THEN own WHEN tier = 3 THEN own + 2 WHEN tier = 4 THEN 1 + CAST(kept AS INT) + own + 1 + CAST(stored AS INT) ELSE 1 + CAST(kept AS INT) END AS BIGINT) AS n_notices,
 CASE WHEN refused THEN NULL WHEN tier IN (1, 2) AND own = 1 THEN 'This statement lists transactions newest-first; they have been reordered oldest-first so the running balance and totals read top-to-bottom.' WHEN tier = 1 THEN 'Parsed using the "' || {_banks} || '" layout you selected — no AI was used.' WHEN tier = 2 THEN NULL
  WHEN wrong THEN 'The Indian Bank template matched the cover page but not the table layout.' ELSE 'The ' || {_banks} || ' template parsed this statement but the running balance did not reconcile, so the column mapping was re-checked.' END AS first_notice,
 CASE WHEN refused THEN 6 WHEN tier IS NOT NULL THEN NULL WHEN NOT consent THEN {len(MESSAGES['PARSE_FAILED'])} WHEN NOT asked THEN {len(MESSAGES['LLM_UNAVAILABLE'])} WHEN lacks THEN {len(NO_MOVES)} ELSE {len(MESSAGES['NO_TRANSACTIONS_FOUND'])} END AS message_length,
 CASE WHEN tier IS NOT NULL THEN n END AS last_serial, CASE WHEN tier IS NOT NULL THEN since END AS since, CASE WHEN tier IS NOT NULL THEN CASE WHEN refs THEN n ELSE 0 END END AS n_refs FROM e""",
}
