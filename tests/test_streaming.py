import time

import pytest
from pyspark.sql import functions as F

from chatloom.operators import chat
from chatloom.operators.records import to_messages
from chatloom.operators.render import render_training_text
from chatloom.session import shared_path
from chatloom.streaming.chat import stream_chat
from chatloom.streaming.ingest import drain, stream_messages, stream_training_text

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def shown(role, text):
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


END = "<|im_start|>assistant\n"


@pytest.fixture
def chat_stream(spark, tmp_path):
    """Run batches of events one after the other through one stream."""
    source, state, out = (str(tmp_path / n) for n in ("in", "state", "out"))

    def push(*events):
        spark.createDataFrame(list(events), SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        rows = drain(stream_chat(stream), out, state).collect()
        return {(r["conv_id"], r["turn"]): (r["prompt"], r["late"]) for r in rows}

    return push


def test_history_is_kept_between_batches(chat_stream):
    chat_stream((1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "system", "s"))
    rows = chat_stream((1, 2, "user", "c"), (2, 1, "user", "d"))
    assert rows[1, 0] == (shown("user", "a") + END, False)
    assert rows[1, 2] == (shown("user", "a") + shown("assistant", "b") + shown("user", "c") + END, False)
    assert rows[2, 1] == (shown("system", "s") + shown("user", "d") + END, False)


def test_clear_system_and_late(chat_stream):
    chat_stream((1, 0, "system", "s"), (1, 1, "user", "a"), (1, 5, "system", "t"))
    rows = chat_stream((1, 3, "user", "late"), (1, 6, "user", "b"), (1, 7, "clear", None), (1, 8, "user", "c"))
    assert rows[1, 3] == (None, True)
    assert rows[1, 6] == (shown("system", "t") + shown("user", "a") + shown("user", "b") + END, False)
    assert rows[1, 8] == (shown("user", "c") + END, False)


def test_idle_sessions_are_forgotten(spark, tmp_path):
    source, state, out = (str(tmp_path / n) for n in ("in", "state", "out"))

    def push(idle_ms, *events):
        spark.createDataFrame(list(events), SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        return {(r["conv_id"], r["turn"]): (r["prompt"], r["late"]) for r in drain(stream_chat(stream, idle_ms=idle_ms), out, state).collect()}

    push(1, (1, 5, "user", "a"), (2, 5, "user", "x"))
    time.sleep(0.1)
    push(3_600_000, (3, 0, "user", "other"))  # a batch in which the timers of both sessions fire
    push(3_600_000, (1, 2, "user", "b"), (2, 6, "clear", None))
    rows = push(3_600_000, (1, 3, "assistant", None), (1, 4, "user", "c"), (3, 1, "user", "more"))
    assert rows[1, 2] == (shown("user", "b") + END, False)  # neither late nor with the history of turn 5
    assert rows[1, 4] == (shown("user", "b") + shown("assistant", "") + shown("user", "c") + END, False)
    assert rows[3, 1] == (shown("user", "other") + shown("user", "more") + END, False)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c}/{t}") for c in range(5) for t in range(200)]
    turns = spark.createDataFrame(rows, SCHEMA)
    turns.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    streamed = drain(stream_chat(stream), str(tmp_path / "out"))
    batch = {(r["conv_id"], r["turn"]): r["prompt"] for r in chat.turn_prompts(turns, block_turns=32).collect()}
    assert {(r["conv_id"], r["turn"]): r["prompt"] for r in streamed.collect()} == batch


def test_new_files_are_rendered_once(spark, write, tmp_path):
    path = write("in/a.jsonl", '{"question":"1","answer":"x"}\n\n').rsplit("/", 1)[0]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        return sorted(r["text"] for r in drain(stream_training_text(spark, path, "jsonl"), out, state).collect())

    assert run() == [shown("user", "1") + shown("assistant", "x")]
    write("in/b.jsonl", '{"question":"2"}\n')
    assert run() == [shown("user", "1") + shown("assistant", "x"), shown("user", "2") + shown("assistant", "")]


def test_bad_line_does_not_stop_the_stream(spark, write):
    path = write("in/a.jsonl", '{"question":"1"}\n{bad\n').rsplit("/", 1)[0]
    rows = drain(stream_messages(spark, path, "jsonl"), shared_path(spark, "t")).collect()
    assert sorted(r["messages"] is None for r in rows) == [False, True]


def test_batch_and_stream_share_the_projection(spark, write):
    text = "".join(f'{{"instruction":"i{i}","output":" o "}}\n' for i in range(30))
    path = write("in/a.jsonl", text).rsplit("/", 1)[0]
    streamed = drain(stream_training_text(spark, path, "alpaca"), shared_path(spark, "t"))
    lines = spark.read.text(path).where(F.col("value") != "")
    batch = render_training_text(to_messages(lines, "alpaca"))
    assert sorted(r["text"] for r in streamed.collect()) == sorted(r["text"] for r in batch.collect())


def test_array_files_that_do_not_parse_give_a_row(spark, write, tmp_path):
    import os

    from chatloom.streaming.ingest import stream_array_messages

    folder = os.path.dirname(write("in/a.json", '[{"instruction": "a", "output": "b"}]'))
    write("in/b.json", "[broken")
    write("in/c.json", '{"instruction": "a", "output": "b"}')
    frame = stream_array_messages(spark, folder, "alpaca")
    query = frame.writeStream.format("memory").queryName("bad_arrays").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.table("bad_arrays").collect()
    assert len(rows) == 3 and sum(r.messages is None for r in rows) == 2
