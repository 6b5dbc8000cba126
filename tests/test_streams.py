"""Streams: late hits, expiry of state, edits of several batches, replays, lines of a conversion."""

import json
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.streaming.state import STAGES, convert_stream, conversion_lines, latest_reports, limit_stream, revalidate_stream

HITS = "event_id long, key string, ts timestamp, arrived timestamp"
START = datetime(2024, 1, 1)


def answers(spark, tmp_path, batches, limit=2, span=60.0):
    """The answers to hits (id, key, second of the event, second of the arrival), a file a batch."""
    source, out = tmp_path / "in", None
    for rows in batches:
        given = [(i, k, START + timedelta(seconds=t), START + timedelta(seconds=a)) for i, k, t, a in rows]
        spark.createDataFrame(given, HITS).coalesce(1).write.mode("append").parquet(str(source))
        out = limit_stream(spark.readStream.schema(HITS).parquet(str(source)), "key", "ts", "event_id", limit, span, "arrived")
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    return {r.event_id: r for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()}


def test_every_hit_has_an_answer_and_late_ones_are_marked(spark, tmp_path):
    got = answers(spark, tmp_path, [[(1, "a", 7200, 0), (2, "b", 0, 0)], [(3, "a", 60, 10), (4, "a", 7210, 10), (5, "b", 30, 10)]])
    assert {i: (r.allowed, r.late) for i, r in got.items()} == {1: (True, False), 2: (True, False), 3: (True, True), 4: (False, False), 5: (True, False)}


def test_shuffled_arrival_within_a_batch_is_as_in_order(spark, tmp_path):
    rows = [(i, "ab"[i % 2], 7 * i, 300) for i in range(40)]
    got = answers(spark, tmp_path, [rows[::-1]])
    state, want = {}, {}
    for i, k, t, _ in rows:
        opened, n = state.get(k, (None, 0))
        if opened is None or t - opened >= 60:
            opened, n = t, 0
        state[k] = (opened, n + 1)
        want[i] = n + 1 <= 2
    assert {i: r.allowed for i, r in got.items()} == want and not any(r.late for r in got.values())


def test_state_is_gone_after_its_window(spark, tmp_path):
    # The hit at second 10 comes when the key's state has expired by the arrivals of others.
    got = answers(spark, tmp_path, [[(1, "a", 0, 0), (2, "a", 1, 0)], [(3, "z", 500, 500)], [(4, "z", 900, 900)], [(5, "a", 10, 901)]])
    assert got[5].allowed and got[5].remaining == 1
    kept = answers(spark, tmp_path / "b", [[(1, "a", 0, 0), (2, "a", 1, 0)], [(5, "a", 10, 20)]])
    assert not kept[5].allowed


def ledger(spark):
    rows = [(1, 1, None, Decimal(5), Decimal(105)), (1, 2, Decimal(7), None, Decimal(99)), (1, 3, Decimal(1), None, Decimal(97)), (2, 1, None, Decimal(5), Decimal(105))]
    return spark.createDataFrame(rows, "statement_id long, serial int, debit decimal(18,2), credit decimal(18,2), balance decimal(18,2)").withColumn("opening", F.lit(100).cast("decimal(18,2)")).withColumn("txn_date", F.lit("2024-01-01").cast("date"))


def test_edits_of_two_batches_add_up_and_a_replay_changes_nothing(spark, tmp_path):
    schema = "statement_id long, serial int, field string, value string"
    path, given = str(tmp_path / "reports"), str(tmp_path / "edits")

    def send(edits, checkpoint):
        if edits:
            spark.createDataFrame(edits, schema).coalesce(1).write.mode("append").parquet(given)
        revalidate_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(given), ledger(spark), path, str(tmp_path / checkpoint)).awaitTermination()

    send([(1, 2, "debit", "6")], "one")
    assert [(r.statement_id, r.n_errors) for r in latest_reports(spark, path).collect()] == [(1, 1)]
    send([(1, 3, "debit", "2")], "one")
    assert [(r.statement_id, r.n_errors, r.ok) for r in latest_reports(spark, path).collect()] == [(1, 0, True)]
    before = spark.read.parquet(path).count()
    send([], "two")  # all batches anew, under the same numbers
    assert spark.read.parquet(path).count() == before and [(r.n_errors, r.ok) for r in latest_reports(spark, path).collect()] == [(0, True)]


def statement(spark):
    """One statement of three rows, as runs of text, and what is known of it."""
    lines = [(20, [(40, "Axis Bank")]), (35, [(40, "IFSC UTIB0000123")]), (100, [(40, "Tran Date"), (125, "Particulars"), (350, "Debit"), (450, "Credit"), (600, "Balance")])]
    for i, (paid, got, left) in enumerate([("", "50.00", "150.00"), ("20.00", "", "130.00"), ("30.00", "", "100.00"), ("", "1.00", "101.00"), ("", "1.00", "102.00"), ("2.00", "", "100.00")]):
        lines.append((124 + 24 * i, [(40, f"0{i + 1}-04-2024"), (125, f"row {i + 1}"), (350, paid), (450, got), (600, left)]))
    items = [(1, 0, float(x), float(y), 4.4 * len(t), 8.0, 8.0, i, t) for y, row in lines for i, (x, t) in enumerate(row) if t]
    return spark.createDataFrame(items, "statement_id long, page long, x double, y double, width double, height double, font_size double, seq int, text string")


GIVEN = "statement_id long, hint string, consent boolean, error_code string, error_message string"
STORE = "key string, bank string, formats array<string>, style string, columns map<string,string>"
MAPPINGS = "statement_id long, bank string, formats array<string>, style string, places map<string,int>, header_seq int"


def test_a_stream_of_conversions_writes_progress_results_and_errors(spark, tmp_path):
    given, told = str(tmp_path / "in"), []
    spark.createDataFrame([(1, None, False, None, None), (2, None, False, "NOT_A_PDF", "That file is empty."), (3, None, True, None, None)], GIVEN).coalesce(1).write.parquet(given)
    convert_stream(spark.readStream.schema(GIVEN).parquet(given), statement(spark), spark.createDataFrame([], STORE), spark.createDataFrame([], MAPPINGS), str(tmp_path / "out"), str(tmp_path / "state"), lambda batch, stage, rows: told.append((batch, stage, rows))).awaitTermination()
    assert [t[:2] for t in told] == [(0, s) for s, _ in STAGES] and told[-1] == (0, "validating", 3)
    lines = [json.loads(r.line) for r in spark.read.parquet(str(tmp_path / "out/batch=0/progress")).orderBy("place").collect()]
    assert [x["progress"]["stage"] for x in lines] == ["extracting", "reconstructing", "parsing", "inferring", "validating"]
    out = {r.statement_id: json.loads(r.line) for r in spark.read.parquet(str(tmp_path / "out/batch=0/results")).collect()}
    assert out[1]["ok"] and len(out[1]["transactions"]) == 6 and out[1]["meta"]["bank_name"] == "Axis Bank" and out[1]["meta"]["reconciles"]
    assert (out[2]["ok"], out[2]["code"], out[2]["message"]) == (False, "NOT_A_PDF", "That file is empty.") and out[3]["code"] == "LLM_UNAVAILABLE"


def test_a_batch_of_nothing_has_its_five_stages(spark, tmp_path):
    none = spark.createDataFrame([], GIVEN)
    conversion_lines(spark, none, statement(spark), spark.createDataFrame([], STORE), spark.createDataFrame([], MAPPINGS), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/progress")).count() == 5 and spark.read.parquet(str(tmp_path / "out/results")).count() == 0
