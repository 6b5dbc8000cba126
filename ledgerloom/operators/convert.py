"""The fallback chain as one set-at-a-time conversion: every statement is parsed by each of its
candidate layouts once, audited, and the first acceptable tier is taken."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.details import statement_details
from ..sources.pages import page_text, statement_text
from ..sources.shared import Stages
from .audit import audit_rows, report
from .columns import build_grid
from .detection import choose_parse, detect_layout
from .layouts import SHIPPED, inferred_layouts, layout_fingerprint, layout_table, learned_layouts, mapping_lacks, storable
from .parse import all_formats, parse_statements, statement_meta

HINTED, SHIPPED_TIER, LEARNED, INFERRED = 1, 2, 3, 4
LEARNED_HINT = "learned:"

# Error messages of the output contract, by code; of a mapping, by what it lacks.
NO_MOVES = "The inferred column mapping did not identify where the transaction amounts are."
NO_FLAGS = "The layout was reported as having a separate Dr/Cr flag column, but no such column was identified."
MESSAGES = {
    "PARSE_FAILED": "This statement matched a known bank but its table layout could not be read. Enable AI-assisted mapping to try again.",
    "UNSUPPORTED_LAYOUT": "No built-in template recognised this statement. Enable AI-assisted mapping to try again, or pick your bank from the dropdown.",
    "LLM_UNAVAILABLE": "AI-assisted mapping could not be completed. Please try again, or pick your bank from the dropdown.",
    "NO_TRANSACTIONS_FOUND": "The column mapping was inferred but no transaction rows could be read from it.",
}


def code_of(missing: Column, allowed: Column, detected: Column, asked: Column) -> Column:
    """Error code of a statement without a parse: no model may be asked, no mapping came back, or the
    mapping gave no transaction."""
    return F.when(missing & ~allowed, F.when(detected, "PARSE_FAILED").otherwise("UNSUPPORTED_LAYOUT")).when(missing & allowed, F.when(asked, "NO_TRANSACTIONS_FOUND").otherwise("LLM_UNAVAILABLE"))


# Notices of the tiers, before and after the bank's name.
SAID = {
    "hinted": ('Parsed using the "', '" layout you selected — no AI was used.'),
    "unsound": ("The ", " template parsed this statement but the running balance did not reconcile, so the column mapping was re-checked."),
    "unread": ("The ", " template matched the cover page but not the table layout."),
    "learned": ('Parsed using the "', '" layout this app learned from an earlier statement — no AI was used.'),
    "stale": ("The stored ", " layout no longer matches this statement, so the column mapping was inferred again."),
    "inferred": ("No built-in template matched, so the column mapping was inferred with AI and then parsed deterministically. Detected layout: ", "."),
    "saved": ('This layout has been saved as "', '", so statements like it will be converted without AI from now on.'),
}


def tier_notices(taken: Column, tried: Column) -> Column:
    """Notices across the tiers, in their order; those of the parse taken come before its tier's own. `tried`
    is an array of (tier, bank, parsed, ok, notices, storable) of every candidate; `taken` the tier taken."""
    def say(c: Column) -> Column:
        text = lambda name: F.array(F.concat(F.lit(SAID[name][0]), c["bank"], F.lit(SAID[name][1])))
        own = taken.isNotNull() & (c["tier"] == taken)
        passed = taken.isNull() | (c["tier"] < taken)
        none = F.array().cast("array<string>")
        tier = (F.when(own & (c["tier"] == HINTED), text("hinted")).when(passed & (c["tier"] == SHIPPED_TIER) & c["parsed"], text("unsound")).when(passed & (c["tier"] == SHIPPED_TIER), text("unread"))
                .when(own & (c["tier"] == LEARNED), text("learned")).when(passed & (c["tier"] == LEARNED), text("stale")).when(own & (c["tier"] == INFERRED), text("inferred")).otherwise(none))
        saved = F.when(own & (c["tier"] == INFERRED) & c["ok"] & c["storable"], text("saved")).otherwise(none)
        parse = F.when(own, F.coalesce(c["notices"], none)).otherwise(none)
        return F.concat(parse, tier, saved)

    return F.flatten(F.transform(F.array_sort(tried), say))


def convert(statements: DataFrame, candidates: DataFrame, model_allowed: str) -> DataFrame:
    """One row per statement of `statements` (statement_id, `model_allowed`), also those without any
    candidate: tier, used, evicted, stored, error_code, notices. Candidates: (statement_id, tier, bank,
    parsed, ok); parsed means that rows were read, ok that they also reconcile. They may have `notices` of
    the parse, `storable` (whether an inferred layout has all the labels it needs to be kept; true without it)
    and `refused` (a mapping without the columns it needs, which is not parsed)."""
    false, has = F.lit(False), candidates.columns
    flat = candidates.select(
        "statement_id", "tier", "bank", F.coalesce("parsed", false).alias("parsed"), (F.coalesce("ok", false) & F.coalesce("parsed", false)).alias("ok"),
        (F.col("notices") if "notices" in has else F.lit(None).cast("array<string>")).alias("notices"), (F.coalesce("storable", false) if "storable" in has else F.lit(True)).alias("storable"), (F.coalesce("refused", false) if "refused" in has else false).alias("refused"))
    asked = flat.join(statements.select("statement_id", F.coalesce(model_allowed, false).alias("_allowed")), "statement_id")
    chosen = choose_parse(asked.where("parsed"), "_allowed").select("statement_id", "tier", "used")
    tried = flat.groupBy("statement_id").agg(F.collect_list(F.struct("tier", "bank", "parsed", "ok", "notices", "storable")).alias("_t"), F.bool_or(F.col("tier") == SHIPPED_TIER).alias("_d"), F.bool_or(F.col("tier") == INFERRED).alias("_m"), F.bool_or("refused").alias("_r"))
    j = statements.select("statement_id", F.coalesce(model_allowed, false).alias("_allowed")).join(chosen, "statement_id", "left").join(tried, "statement_id", "left")
    t = F.coalesce("_t", F.array().cast(tried.schema["_t"].dataType))
    reached = F.col("tier").isNull() | (F.col("tier") >= LEARNED)
    bad = F.exists(t, lambda c: (c["tier"] == LEARNED) & ~c["ok"])
    stored = F.coalesce(F.col("tier") == INFERRED, false) & F.exists(t, lambda c: (c["tier"] == INFERRED) & c["ok"] & c["storable"])
    code = code_of(F.col("tier").isNull(), F.col("_allowed"), F.coalesce("_d", false), F.coalesce("_m", false))
    code = F.when((code == "NO_TRANSACTIONS_FOUND") & F.coalesce("_r", false), "UNSUPPORTED_LAYOUT").otherwise(code)
    return j.select("statement_id", "tier", F.coalesce("used", false).alias("used"), (bad & reached).alias("evicted"), stored.alias("stored"), code.alias("error_code"), tier_notices(F.col("tier"), t).alias("notices"))


@dataclass(frozen=True)
class Conversion:
    """results: a row for each statement given; transactions, of those converted; changes of the store of layouts:
    (op, key, ...), of which put replaces or adds a layout, use counts uses of one, delete drops one."""

    results: DataFrame
    transactions: DataFrame
    changes: DataFrame


def format_lists(*tables: DataFrame, most: int = 500) -> tuple[tuple[str, ...], ...]:
    """The distinct lists of date formats that layouts have. Each becomes a part of the plan, so a store
    with more than `most` is an error; banks print a few."""
    out = dict.fromkeys(x.formats for x in SHIPPED)
    for table in tables:
        found = table.select("formats").where("formats is not null").distinct().limit(most + 1).collect()
        out |= dict.fromkeys(tuple(r.formats) for r in found)
    if len(out) > most:
        raise ValueError(f"more than {most} lists of date formats")
    return tuple(out)


class Chain:
    """One run of the fallback chain; each tier parses the statements that no tier before has taken."""

    def __init__(self, open_: DataFrame, grid: DataFrame, details: DataFrame, formats, stages: Stages):
        self.open, self.grid, self.details, self.formats, self.stages = open_, grid, details, formats, stages
        self.tried: list[DataFrame] = []
        self.rows: list[DataFrame] = []
        self.metas: list[DataFrame] = []
        self.looked: dict[int, DataFrame] = {}

    def attempt(self, tier: int, layouts: DataFrame) -> None:
        """Parses open statements by `layouts` (statement_id, a layout's columns, storable, refused; one a statement), audits
        them, and closes those that are taken."""
        stages = self.stages
        layouts = stages.write(layouts, f"layouts-{tier}")
        if tier != SHIPPED_TIER and layouts.isEmpty():  # that of shipped layouts gives the results their columns
            return
        self.looked[tier] = layouts
        usable = layouts.where("not refused").drop("refused", "storable")
        rows = stages.write(parse_statements(self.grid, usable, self.formats), f"rows-{tier}")
        stated = self.details.select("statement_id", "stated_count")
        proof = report(audit_rows(rows), stated).select("statement_id", "n_rows", "total_debit", "total_credit", "n_errors", "n_warnings", "ok")
        meta = stages.write(statement_meta(rows, usable, self.details).join(proof, "statement_id").withColumn("tier", F.lit(tier)), f"meta-{tier}")
        found = layouts.select("statement_id", F.col("bank").alias("bank"), "storable", "refused").join(meta.select("statement_id", "ok", "notices"), "statement_id", "left")
        found = found.join(self.open.select("statement_id", "consent"), "statement_id")
        parsed, ok = F.col("notices").isNotNull(), F.coalesce("ok", F.lit(False))
        taken = parsed & {HINTED: ok, SHIPPED_TIER: ok | ~F.col("consent"), LEARNED: ok, INFERRED: F.lit(True)}[tier]
        tried = stages.write(found.select("statement_id", F.lit(tier).alias("tier"), "bank", parsed.alias("parsed"), ok.alias("ok"), "notices", "storable", "refused", taken.alias("taken")), f"tried-{tier}")
        self.tried.append(tried)
        self.rows.append(rows.withColumn("tier", F.lit(tier)))
        self.metas.append(meta)
        self.open = stages.write(self.open.join(tried.where("taken"), "statement_id", "left_anti"), f"open-{tier}")


def all_of(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def convert_statements(statements: DataFrame, items: DataFrame, store: DataFrame, mappings: DataFrame, stages: Stages | None = None, made: tuple[DataFrame, DataFrame] | None = None) -> Conversion:
    """Converts all statements by the fallback chain: a learned layout that the user picked, a shipped layout,
    a learned layout found by the fingerprint, an inferred mapping. A tier is tried for those statements
    only that none before has taken; each tier's tables are written once.

    statements: statement_id (distinct), hint (a shipped layout's id, `learned:` and a key, or null), consent
    (to ask a model), error_code and error_message of what earlier steps refused (uploads, passwords, scans,
    limits), which stay as they are. items: positioned runs. store: key, bank, formats, style, columns.
    mappings: statement_id, bank, formats, style, places, header_seq: what a model answered, for those it was asked about.

    Every statement has one result row: ok, tier, parsed_by, error_code, error_message, notices, used, evicted, stored, and
    what statement_meta() and report() tell of its parse. A statement without items is not recognised by
    itself. Rows of statements that are not given are ignored; empty tables give empty results. `made` is (grid, texts) of
    the items, of build_grid() and statement_text(), if a caller has them already: they are not made again."""
    stages = stages or Stages(statements.sparkSession)
    spark, key = statements.sparkSession, "statement_id"
    given = stages.write(statements.select(key, "hint", F.coalesce("consent", F.lit(False)).alias("consent"), "error_code", "error_message"), "statements")
    fit = given.where("error_code is null").drop("error_code", "error_message")
    formats = format_lists(store, mappings)
    if made is None:
        items = stages.write(items.join(fit.select(key), key, "left_semi"), "items")
        grid = stages.write(build_grid(items, formats=all_formats(formats), stages=stages), "grid")
        texts = stages.write(statement_text(page_text(items)), "texts")
    else:
        grid, texts = (t.join(fit.select(key), key, "left_semi") for t in made)
    details = stages.write(texts.select(key, statement_details(F.col("text")).alias("d")).select(key, "d.*"), "details")
    prints = stages.write(layout_fingerprint(grid, texts.select(key, F.col("first_page_text").alias("text"))), "prints")
    chain = Chain(fit, grid, details, formats, stages)
    yes, no = F.lit(True), F.lit(False)
    kept = learned_layouts(store).select("key", F.struct("layout_id", "bank", "formats", "style", "columns", "places", "forward").alias("_l"))

    picked = chain.open.where(F.col("hint").startswith(LEARNED_HINT)).select(key, F.expr(f"substring(hint, {len(LEARNED_HINT) + 1})").alias("key"))
    chain.attempt(HINTED, picked.join(kept, "key").select(key, "key", "_l.*", yes.alias("storable"), no.alias("refused")))
    pages = chain.open.join(texts.select(key, "first_page_text"), key, "left")
    found = detect_layout(pages, "first_page_text", "hint").where("layout_id is not null").select(key, "layout_id")
    chain.attempt(SHIPPED_TIER, found.join(F.broadcast(layout_table(spark)), "layout_id").withColumn("storable", yes).withColumn("refused", no))
    known = chain.open.select(key).join(prints, key).withColumnRenamed("fingerprint", "key")
    chain.attempt(LEARNED, known.join(kept, "key").select(key, "key", "_l.*", yes.alias("storable"), no.alias("refused")))

    asked = mappings.join(chain.open.where("consent").select(key), key, "left_semi").join(prints, key)
    headers = grid.join(asked.select(key, F.col("header_seq").alias("row_seq")), [key, "row_seq"]).select(key, "cells")
    labels = stages.write(storable(asked, headers, keep=(key,)), "labels")
    inferred = inferred_layouts(asked).drop("fingerprint")
    more = asked.select(key, F.col("header_seq").alias("given_seq"), mapping_lacks(F.col("style"), F.col("places")).alias("problem"))
    chain.attempt(INFERRED, inferred.join(more, key).join(labels.select(key, yes.alias("storable")), key, "left").select(*inferred.columns, "given_seq", F.coalesce("storable", no).alias("storable"), F.col("problem").isNotNull().alias("refused")))

    tried = all_of([t.drop("taken") for t in chain.tried])
    decided = stages.write(convert(fit, tried, "consent"), "decided")
    refused = asked.select(key, F.when(mapping_lacks(F.col("style"), F.col("places")) == "moves", NO_MOVES).when(mapping_lacks(F.col("style"), F.col("places")) == "flags", NO_FLAGS).alias("_why"))
    said = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    results = given.join(decided.withColumnRenamed("error_code", "_code"), key, "left").join(refused, key, "left")
    message = F.coalesce("error_message", F.when((F.col("_code") == "UNSUPPORTED_LAYOUT") & F.col("consent"), F.col("_why")), F.try_element_at(said, F.col("_code")))
    results = results.select(key, "tier", F.coalesce("error_code", "_code").alias("error_code"), message.alias("error_message"), *(F.coalesce(c, no).alias(c) for c in ("used", "evicted", "stored")), F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))
    results = results.withColumn("ok", F.col("error_code").isNull()).withColumn("parsed_by", F.when(F.col("tier") == INFERRED, "llm").when(F.col("tier").isNotNull(), "template"))
    facts = all_of(chain.metas).withColumnRenamed("ok", "reconciles").drop("notices")
    results = stages.write(results.join(facts, [key, "tier"], "left"), "results")
    rows = all_of(chain.rows).join(results.select(key, "tier"), [key, "tier"]).drop("tier")
    return Conversion(results, rows, store_changes(results, chain, store, labels))


def store_changes(results: DataFrame, chain: Chain, store: DataFrame, labels: DataFrame) -> DataFrame:
    """(op, key, uses, bank, formats, style, columns): at most one put and one delete or use of a key. Of several
    statements that prove one mapping, the smallest statement_id's is put; a layout that fails for
    any statement is deleted, as it would be by the one that comes last."""
    spark, key = results.sparkSession, "statement_id"
    layout = ("bank", "formats", "style", "columns")
    none = [F.lit(None).cast(store.schema[c].dataType).alias(c) for c in layout]
    out = spark.createDataFrame([], "op string, key string, uses long").select("*", *none)
    looked = [t for t in (chain_layouts(chain, HINTED), chain_layouts(chain, LEARNED)) if t is not None]
    if looked:
        by_key = all_of(looked).join(results.select(key, F.col("tier").alias("_taken"), "used", "evicted"), key)
        uses = by_key.where("used and tier = _taken").groupBy("key").agg(F.count("*").alias("uses"))
        gone = by_key.where(f"evicted and tier = {LEARNED}").groupBy("key").agg(F.lit(0).cast("long").alias("uses"))
        out = out.unionByName(gone.select(F.lit("delete").alias("op"), "key", "uses", *none)).unionByName(uses.join(gone.select("key"), "key", "left_anti").select(F.lit("use").alias("op"), "key", "uses", *none))
    proved = labels.join(results.where("stored").select(key), key)
    put = proved.groupBy("key").agg(F.min_by(F.struct(*layout), key).alias("_l"), F.count("*").alias("uses"))
    return out.unionByName(put.select(F.lit("put").alias("op"), "key", "uses", "_l.*"))


def chain_layouts(chain: Chain, tier: int) -> DataFrame | None:
    """(statement_id, key, tier) of the learned layouts that a tier tried."""
    looked = chain.looked.get(tier)
    return None if looked is None else looked.select("statement_id", "key", F.lit(tier).alias("tier"))
