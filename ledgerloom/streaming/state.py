"""Streams with state a key: the limiter and the running-balance audit over rows as they arrive; edits that
add up; conversions with lines of progress. State is one small row a key and expires with its window."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.audit import audit_rows, report
from ..operators.convert import convert_statements
from ..operators.ledger import apply_edits
from ..sinks.exports import result_lines
from ..sources.shared import Stages

# Limits of the entry points (hits, seconds).
LIMITS = {"convert": (12, 60.0), "export": (30, 60.0), "banks": (60, 60.0)}


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Limiter(StatefulProcessor):
    """The open window of a key, and a timer that clears it once it cannot be asked for again."""

    def __init__(self, limit: int, span: int):
        self.limit, self.span = limit, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "opened long, hits long, timer long")

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "event_id"], kind="stable")
        micros = lambda c: pdf[c].astype("datetime64[us]").astype("int64")
        opened, hits, timer = self.window.get() if self.window.exists() else (None, 0, None)
        allowed, left, resets, late = [], [], [], []
        for t in micros("ts").tolist():
            if opened is None or t >= opened + self.span:
                opened, hits = t, 0
            hits += 1
            allowed.append(hits <= self.limit)
            left.append(max(0, self.limit - hits))
            resets.append(opened + self.span)
            late.append(t < opened)
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = (int(micros("arrived").max()) + self.span) // 1000 + 1
        self.handle.registerTimer(timer)
        self.window.update((opened, hits, timer))
        yield pd.DataFrame({"event_id": pdf["event_id"], "key": key[0], "allowed": allowed, "remaining": left, "resets": pd.to_datetime(resets, unit="us"), "late": late})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.window.clear()
        return iter(())

    def close(self) -> None:
        pass


def limit_stream(events: DataFrame, key: str, ts: str, event_id: str, limit: int, window_s: float, arrived: str | None = None) -> DataFrame:
    """(event_id, key, allowed, remaining, resets, late) for each event of a stream, one row each, however late. A
    key's window begins at its first hit and ends window_s later; hits of a batch count in the order of
    their times, so the arrival within a batch does not matter. A hit older than the window that is open
    when it arrives counts in that window, as a limiter counts arrivals, and is marked late.

    The clock of the state is the arrival, not the event, so no hit falls behind the watermark: it is the column
    `arrived`, which must not run backwards, or the time of the batch. The state of a key is gone window_s
    after its last arrival. Needs the RocksDB state store, which is set for queries of the session that start after this."""
    events.sparkSession.conf.set(STATE_STORE, ROCKS)
    came = F.col(arrived).cast("timestamp") if arrived else F.current_timestamp()
    rows = events.select(F.col(event_id).alias("event_id"), F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias("key"), F.col(ts).cast("timestamp").alias("ts"), came.alias("arrived")).withWatermark("arrived", "0 seconds")
    kind = rows.schema["event_id"].dataType.simpleString()
    out = f"event_id {kind}, key string, allowed boolean, remaining long, resets timestamp, late boolean"
    return rows.groupBy("key").transformWithStateInPandas(Limiter(limit, int(window_s * 1e6)), out, "append", "eventTime")


def audit_stream(rows: DataFrame) -> DataFrame:
    """(statement_id, serial, expected, delta, balance_error) for each row (statement_id, serial, opening,
    debit, credit, balance) of a stream: the running-balance check against the row before, whose balance
    is the state. Rows of a statement arrive in order of serial, batch by batch."""
    cents = lambda c: F.round(F.col(c).cast("decimal(18,2)") * 100).cast("long").alias(c)
    flat = rows.select("statement_id", F.col("serial").cast("long").alias("serial"), *(cents(c) for c in ("opening", "debit", "credit", "balance")))
    kind = flat.schema["statement_id"].dataType.simpleString()

    def step(own, frames, state: GroupState):
        pdf = pd.concat(list(frames), ignore_index=True).sort_values("serial", kind="stable")
        before = state.get[0] if state.exists else None
        expected, delta = [], []
        for opening, debit, credit, balance in pdf[["opening", "debit", "credit", "balance"]].astype("Int64").itertuples(index=False):
            start = before if before is not None else (None if opening is pd.NA else int(opening))
            moved = (0 if credit is pd.NA else int(credit)) - (0 if debit is pd.NA else int(debit))
            expected.append(None if start is None else start + moved)
            delta.append(None if start is None or balance is pd.NA else int(balance) - start - moved)
            before = before if balance is pd.NA else int(balance)
        state.update((before,))
        yield pd.DataFrame({"statement_id": own[0], "serial": pdf["serial"], "expected": pd.array(expected, "Int64"), "delta": pd.array(delta, "Int64")})

    found = flat.groupBy("statement_id").applyInPandasWithState(step, f"statement_id {kind}, serial long, expected long, delta long", "before long", "append", GroupStateTimeout.NoTimeout)
    money = lambda c: (F.col(c).cast("decimal(18,2)") / 100).cast("decimal(18,2)").alias(c)
    return found.select("statement_id", "serial", money("expected"), money("delta"), F.coalesce(F.abs("delta") > 1, F.lit(False)).alias("balance_error"))


EDITS = "statement_id {0}, serial int, field string, value string, at long"


def revalidate_stream(edits: DataFrame, rows: DataFrame, path: str, checkpoint: str, stated: DataFrame | None = None):
    """Starts a query that, for each batch of edits (statement_id, serial, field, value and, if several of a batch may
    meet, at: their order), reports anew on the statements it touches, with all edits of this and earlier
    batches. A batch's edits and reports are folders of `path` under its number, written by overwrite: a batch that is
    run again changes nothing. edits_so_far() and latest_reports() read them."""
    spark = rows.sparkSession
    kind = rows.schema["statement_id"].dataType.simpleString()

    def run(batch: DataFrame, number: int) -> None:
        order = F.col("at").cast("long") if "at" in batch.columns else F.lit(0).cast("long")
        own = batch.select("statement_id", F.col("serial").cast("int").alias("serial"), "field", "value", order.alias("at"))
        own.write.mode("overwrite").parquet(f"{path}/_edits/batch={number}")
        mine = spark.read.schema(EDITS.format(kind)).parquet(f"{path}/_edits/batch={number}").select("statement_id").distinct()
        known = edits_so_far(spark, path, kind, number).join(mine, "statement_id", "left_semi")
        touched = rows.join(mine, "statement_id", "left_semi")
        found = report(audit_rows(apply_edits(touched, known.withColumn("_order", F.struct("batch", "at")), "_order")), stated)
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return edits.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def edits_so_far(spark: SparkSession, path: str, kind: str = "long", upto: int | None = None) -> DataFrame:
    """All edits of batches up to a number, with their batch."""
    found = spark.read.schema(EDITS.format(kind) + ", batch long").option("basePath", f"{path}/_edits").parquet(f"{path}/_edits")
    return found if upto is None else found.where(F.col("batch") <= upto)


def latest_reports(spark: SparkSession, path: str) -> DataFrame:
    """The last report of each statement."""
    found = spark.read.option("basePath", path).parquet(path)
    last = Window.partitionBy("statement_id").orderBy(F.desc("batch"))
    return found.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def read_results(spark: SparkSession, path: str, schema: str, files_a_batch: int = 1000) -> DataFrame:
    """A stream of NDJSON result lines as they land in a folder; lines that do not parse have null fields."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(path)


# Stages of a conversion, in order, and the tables with which each ends.
STAGES = (("extracting", ("items",)), ("reconstructing", ("grid", "texts")), ("parsing", ("meta-1", "meta-2", "meta-3")), ("inferring", ("meta-4",)), ("validating", ("results",)))


def conversion_lines(spark: SparkSession, statements: DataFrame, items: DataFrame, store: DataFrame, mappings: DataFrame, path: str, on_progress=None) -> None:
    """Converts a batch and writes its lines to `path`: progress/ has (stage, rows) of the five stages in
    order, results/ a JSON line a statement: its transactions, or the code and message of its error.
    on_progress(stage, rows) is called as each stage ends. All are written by overwrite."""
    seen: dict[str, int] = {}
    done: list[tuple[str, int]] = []

    def on_table(name: str, rows: int) -> None:
        seen[name] = rows

    def say(stage: str, tables: tuple[str, ...]) -> None:
        done.append((stage, sum(seen.get(t, 0) for t in tables)))
        if on_progress:
            on_progress(*done[-1])

    made = convert_statements(statements, items, store, mappings, Stages(spark, on_table))
    for stage, tables in STAGES:
        say(stage, tables)
    r = made.results
    facts = r.where("ok").select("statement_id", "bank_name", "template_id", "parsed_by", "opening", "closing", "account_masked", "period_from", "period_to", "reconciles", "notices")
    lines = result_lines(made.transactions.drop("opening", "opening_inferred", "reversed"), facts)
    failed = r.where("not ok").select("statement_id", F.to_json(F.struct(F.lit("result").alias("type"), F.lit(False).alias("ok"), F.col("error_code").alias("code"), F.col("error_message").alias("message"))).alias("line"))
    lines.unionByName(failed).write.mode("overwrite").parquet(f"{path}/results")
    progress = [(i, s, n, f'{{"type":"progress","progress":{{"stage":"{s}","rows":{n}}}}}') for i, (s, n) in enumerate(done)]
    spark.createDataFrame(progress, "place int, stage string, rows long, line string").coalesce(1).write.mode("overwrite").parquet(f"{path}/progress")


def convert_stream(statements: DataFrame, items: DataFrame, store: DataFrame, mappings: DataFrame, path: str, checkpoint: str, on_progress=None):
    """Starts a query that converts the statements of each batch and writes their lines under path/batch=<n>;
    a batch that is run again replaces its own. on_progress(batch, stage, rows) is called as stages end."""
    spark = items.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        told = (lambda stage, rows: on_progress(number, stage, rows)) if on_progress else None
        conversion_lines(spark, batch, items, store, mappings, f"{path}/batch={number}", told)

    return statements.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Calls on_progress(stage, rows so far) as the batches of a query end."""

    def __init__(self, on_progress):
        self.on_progress, self.rows = on_progress, 0

    def onQueryStarted(self, event):
        self.on_progress("started", 0)

    def onQueryProgress(self, event):
        self.rows += event.progress.numInputRows
        self.on_progress("running", self.rows)

    def onQueryTerminated(self, event):
        self.on_progress("ended", self.rows)
