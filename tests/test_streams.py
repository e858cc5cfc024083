"""Streams against their batch forms, and states that go when a stream ends or falls silent."""

import random
import uuid

import pytest

from lorekeep.operators import messages as M
from lorekeep.streaming import routes, spans


def run(spark, tmp_path, rows, schema, stream, batches=3):
    """Rows dealt to batches in order, through a stream; what it appends, and the rows of state left."""
    folder = str(tmp_path / uuid.uuid4().hex)
    step = -(-len(rows) // batches)
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i : i + step], schema).coalesce(1).write.mode("append").parquet(folder)
    import glob, os

    for n, f in enumerate(sorted(glob.glob(f"{folder}/*.parquet"), key=os.path.getmtime)):
        os.utime(f, (1_000_000 + n, 1_000_000 + n))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    name = f"t{uuid.uuid4().hex}"
    q = stream(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    kept = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    return spark.table(name).collect(), kept


def test_routes(spark, tmp_path):
    rng = random.Random(5)
    rows = sorted((t, s) for s in range(12) for t in rng.sample(range(2000), 25))
    rows = [(s, t, rng.choice(["UNCLEAR"] * 6 + ["A", "B"])) for t, s in rows]
    rows += [(50, 0, "UNCLEAR"), (50, 99, "A"), (50, 101, "B"), (51, 99, "UNCLEAR"), (51, 101, "A"), (51, 199, "B"), (52, 5, "A")]
    schema = "stream_id long, at_ms long, route string"
    got, kept = run(spark, tmp_path, rows, schema, lambda s: routes.routes(s, "UNCLEAR"))
    batch = M.provisional_routes(spark.createDataFrame(rows, schema), "UNCLEAR").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch)) and kept == 15
    assert {r.stream_id: (r.route, r.at_ms) for r in batch if r.stream_id >= 50} == {50: ("B", 101), 51: ("B", 199), 52: ("A", 5)}


def test_states_go_at_the_end(spark, tmp_path):
    rows = [(1, 0, "a <thi", False), (2, 0, "b <think>x", False), (3, 0, "c", False), (1, 1, "", True), (2, 1, "y</think>z<", True)]
    got, kept = run(spark, tmp_path, rows, "stream_id long, seq long, piece string, done boolean", spans.strip_stream, batches=2)
    shown = {}
    for r in sorted(got, key=lambda r: (r.stream_id, r.seq)):
        shown[r.stream_id] = shown.get(r.stream_id, "") + r.shown
    assert shown == {1: "a <thi", 2: "b z<", 3: "c"} and kept == 1


def test_idle_streams_expire(spark, tmp_path):
    """By event time: a stream that falls silent shows what it held back, and its state goes."""
    import datetime

    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    rows = [(1, 0, "a<thi", at(0)), (2, 0, "b<t", at(20)), (2, 1, "c", at(40))]
    got, kept = run(spark, tmp_path, rows, "stream_id long, seq long, piece string, seen timestamp", lambda s: spans.strip_stream(s, clock="seen"))
    assert sorted((r.stream_id, r.shown) for r in got) == [(1, "<thi"), (1, "a"), (2, "<tc"), (2, "b")] and kept == 1


@pytest.mark.parametrize("size", [1, 3, 1000])
@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a<tool_call>{}</tool_call>b", "ab"),
        ("a<tool_call>" + "x" * 2030 + "</tool_call>b", "ab"),
        ("a<tool_call>never closed", "a"),
        ("a<tool_cal", "a<tool_cal"),
        ("<tool_call>a</tool_call><tool_call>b</tool_call>", ""),
    ],
)
def test_held_back(text, want, size):
    buffer, mode, out = "", spans.SCAN, ""
    for i in range(0, len(text), size):
        buffer, mode, shown = spans.step(buffer, mode, text[i : i + size], spans.TOOL, spans.CAP)
        out += shown
    assert out + spans.rest(buffer, mode) == want


def test_a_body_over_the_cap_is_shown():
    """From then on everything is, tags too; what was held never exceeds the cap by more than a piece."""
    buffer, mode, out = "", spans.SCAN, ""
    for piece in ["ok <tool_call>", *["é" * 10] * 150, "</tool_call> <tool_call>"]:
        buffer, mode, shown = spans.step(buffer, mode, piece, spans.TOOL, spans.CAP)
        assert len(buffer.encode()) <= spans.CAP
        out += shown
    assert mode == spans.LIVE and out == "ok " + "é" * 1500 + "</tool_call> <tool_call>"
