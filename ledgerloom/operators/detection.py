"""Which bank's layout a page has, the banks on offer, and the choice between parses of one statement."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.details import clamp
from ..functions.text import squeeze

# Id, bank and detection markers (pattern, weight) of the shipped layouts, in registry order.
LAYOUTS = (
    ("hdfc-savings-v1", "HDFC Bank", ((r"(?i)hdfc\s+bank", 0.6), (r"\bHDFC0\d{6}\b", 0.4), (r"(?i)chq\.?\s*/\s*ref\.?\s*no", 0.25), (r"(?i)withdrawal\s+amt", 0.2))),
    ("sbi-savings-v1", "State Bank of India", ((r"(?i)state\s+bank\s+of\s+india", 0.6), (r"\bSBIN0\d{6}\b", 0.4), (r"(?i)ref\s*no\.?\s*/\s*cheque\s*no", 0.25))),
    ("icici-savings-v1", "ICICI Bank", ((r"(?i)icici\s+bank", 0.6), (r"\bICIC0\d{6}\b", 0.4), (r"(?i)transaction\s+remarks", 0.3))),
    ("axis-savings-v1", "Axis Bank", ((r"(?i)axis\s+bank", 0.6), (r"\bUTIB0\d{6}\b", 0.4), (r"(?i)tran\s*date", 0.25), (r"(?i)init\.?\s*br", 0.2))),
    ("kotak-savings-v1", "Kotak Mahindra Bank", ((r"(?i)kotak\s+mahindra", 0.6), (r"\bKKBK0\d{6}\b", 0.4), (r"(?i)withdrawal\(dr\)\s*/\s*deposit\(cr\)", 0.35))),
    ("pnb-savings-v1", "Punjab National Bank", ((r"(?i)punjab\s+national\s+bank", 0.6), (r"\bPUNB0\d{6}\b", 0.4), (r"(?i)instrument\s*id", 0.3))),
    ("bob-savings-v1", "Bank of Baroda", ((r"(?i)bank\s+of\s+baroda", 0.65), (r"\bBARB0\w{6}\b", 0.35), (r"(?i)statement\s+of\s+transactions", 0.2))),
    ("canara-savings-v1", "Canara Bank", ((r"(?i)canara\s+bank", 0.65), (r"\bCNRB0\d{6}\b", 0.35), (r"(?i)cheque\s*no|ref\s*/\s*chq", 0.15))),
    ("union-savings-v1", "Union Bank of India", ((r"(?i)union\s+bank\s+of\s+india", 0.65), (r"\bUBIN0\d{6}\b", 0.35), (r"(?i)withdrawals", 0.15))),
    ("idfc-first-savings-v1", "IDFC FIRST Bank", ((r"(?i)idfc\s+first\s+bank", 0.65), (r"\bIDFB0\d{6}\b", 0.35), (r"(?i)particulars", 0.1))),
    ("indian-bank-v1", "Indian Bank", ((r"\bIDIB0[A-Z0-9]{6}\b", 0.75), (r"(?i)indian\s+bank", 0.2), (r"(?i)transaction\s+details", 0.1))),
    ("indusind-bank-v1", "IndusInd Bank", ((r"\bINDB0\d{6}\b", 0.75), (r"(?i)indusind", 0.2), (r"(?i)chq\s*no\s*/\s*ref\s*no", 0.1))),
)
CERTAIN = 0.7


def ascii_bounds(pattern: str) -> str:
    """The pattern with word bounds that know ASCII letters only, as Java's do not."""
    word = "A-Za-z0-9_"
    return pattern.replace(r"\b", f"(?:(?<=[{word}])(?![{word}])|(?<![{word}])(?=[{word}]))")


def needle(pattern: str) -> str | None:
    """Letters and digits, in lower case, that every text which the pattern fits must have: those it begins with."""
    found = None if "|" in pattern else re.match(r"(?:\(\?i\))?(?:\\b)?([A-Za-z0-9]+)", pattern)
    letters = found and (found[1][:-1] if pattern[found.end():found.end() + 1] in ("?", "*", "{") else found[1])
    return letters.lower() if letters else None


def detect_layout(pages: DataFrame, text: str, hint: str | None = None, layouts: tuple = LAYOUTS) -> DataFrame:
    """Adds layout_id and confidence: the best score of 0.7 or more, the first layout of equals, else
    null. A hint in column `hint` that names a layout wins at any score, at 0.7 or more. All layouts
    are scored in one projection of the scan: no join, no shuffle. A page is searched for a marker's pattern only
    if it has the pattern's first letters. A layout (id, bank, markers) of one's
    own may have, in place of markers, a function from the text Column to a score Column."""
    page = F.coalesce(F.col(text), F.lit(""))
    pages = pages.withColumn("_low", F.lower(page))
    scored = []
    for place, (name, _, markers) in enumerate(layouts):
        points: Column = clamp(markers(page)).cast("decimal(4,2)") if callable(markers) else F.lit(0).cast("decimal(4,2)")
        for pattern, weight in () if callable(markers) else markers:
            first = needle(pattern)
            fits = page.rlike(ascii_bounds(pattern))
            points = points + F.when(F.contains("_low", F.lit(first)) & fits if first else fits, F.lit(str(weight)).cast("decimal(4,2)")).otherwise(F.lit(0))
        scored.append(F.struct(F.least(points, F.lit(1)).cast("decimal(4,2)").alias("score"), F.lit(-place).alias("place"), F.lit(name).alias("name")))
    out = pages.withColumn("_all", F.array(*scored)).withColumn("_best", F.array_max("_all"))
    sure = F.col("_best.score") >= CERTAIN
    name, score = F.when(sure, F.col("_best.name")), F.when(sure, F.col("_best.score"))
    if hint:
        hinted = F.filter("_all", lambda s: s["name"] == F.col(hint))
        own = F.get(hinted, F.lit(0))
        name = F.coalesce(own["name"], name)
        score = F.when(own.isNotNull(), F.greatest(own["score"], F.lit(CERTAIN).cast("decimal(4,2)"))).otherwise(score)
    return out.withColumn("layout_id", name).withColumn("confidence", score.cast("double")).drop("_all", "_best", "_low")


def bank_key(name: Column) -> Column:
    return F.lower(squeeze(name))


def available_banks(learned: DataFrame) -> DataFrame:
    """(id, bank, norm) of the shipped layouts and of those learned (key, bank, learned_at) whose name
    no shipped one has; of learned layouts of one name the newest stays, the larger key of equals."""
    spark = learned.sparkSession
    shipped = spark.createDataFrame([(i, b) for i, b, _ in LAYOUTS], "id string, bank string").withColumn("norm", bank_key(F.col("bank")))
    newest = learned.withColumn("norm", bank_key(F.col("bank"))).groupBy("norm").agg(F.max(F.struct("learned_at", "key", "bank")).alias("s"))
    fresh = newest.where(~F.col("norm").isin([b.lower() for _, b, _ in LAYOUTS]))
    return shipped.unionByName(fresh.select(F.concat(F.lit("learned:"), F.col("s.key").cast("string")).alias("id"), F.col("s.bank").alias("bank"), "norm"))


def choose_parse(candidates: DataFrame, model_allowed: str, statements: DataFrame | None = None) -> DataFrame:
    """One row per statement of candidates (statement_id, tier, ok, `model_allowed`): the tier taken,
    whether its learned layout counts one more use, whether the learned layout of tier 3 is evicted,
    and an error code where no tier is taken. Tiers: 1 learned by hint, 2 shipped, 3 learned by
    fingerprint, 4 inferred. Tiers 1 and 3 need a parse that reconciles; tier 2 also stands
    without that if no model may be asked; tier 4 is only reached if one may. One aggregation. With
    `statements` (statement_id, `model_allowed`), those without any candidate have a row as well."""
    if statements is not None:
        tier = candidates.schema["tier"].dataType
        candidates = candidates.unionByName(statements.select("statement_id", F.lit(None).cast(tier).alias("tier"), F.lit(False).alias("ok"), model_allowed))
    allowed = F.coalesce(F.col(model_allowed), F.lit(False))
    good = F.coalesce("ok", F.lit(False))
    taken = F.when(F.col("tier") == 2, good | ~allowed).when(F.col("tier") == 4, allowed).otherwise(good)
    out = candidates.groupBy("statement_id").agg(
        F.min(F.when(taken, F.col("tier"))).alias("tier"), F.max(allowed).alias("_allowed"), F.coalesce(F.max(F.col("tier") == 2), F.lit(False)).alias("_shipped"),
        F.coalesce(F.max((F.col("tier") == 3) & ~good), F.lit(False)).alias("_bad"))
    error = F.when(F.col("tier").isNull(), F.when(F.col("_allowed"), "LLM_UNAVAILABLE").when(F.col("_shipped"), "PARSE_FAILED").otherwise("UNSUPPORTED_LAYOUT"))
    reached = F.col("tier").isNull() | (F.col("tier") >= 3)
    return out.select("statement_id", "tier", F.coalesce(F.col("tier").isin(1, 3), F.lit(False)).alias("used"), (F.col("_bad") & reached).alias("evicted"), error.alias("error_code"))
