"""Ordered folds: hot and null keys, rows without a place, plans without collected lists."""

import pytest

from chatloom.operators import chat
from chatloom.operators.folds import ordered_fold

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def shown(role, text):
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def numbered():
    class Numbered:  # a local class travels with its tasks
        def __init__(self):
            self.n = 0

        def take(self, _, text):
            self.n += 1
            yield self.n, text

        def end(self):
            yield -self.n, None

    return Numbered


def test_rows_in_order_and_ends(spark):
    rows = [(k, i, f"{k}-{i}") for k in (None, 1, 2) for i in (3, 1, 2)]
    found = ordered_fold(spark.createDataFrame(rows, "k long, i long, t string"), ["k"], ["i"], numbered(), "n bigint, t string").collect()
    for k in (None, 1, 2):
        assert [(r.n, r.t) for r in found if r.k == k] == [(1, f"{k}-1"), (2, f"{k}-2"), (3, f"{k}-3"), (-3, None)]
    assert ordered_fold(spark.createDataFrame([], "k long, i long, t string"), ["k"], ["i"], numbered(), "n bigint, t string").count() == 0


def test_no_collected_lists_in_plans(spark, capsys):
    turns = spark.createDataFrame([(1, 0, "user", "a")], SCHEMA)
    for frame in (chat.fold_text(turns), chat.fold_text(turns, block_turns=2), chat.fold_messages(turns), chat.turn_prompts(turns)):
        frame.explain()
    assert "collect_list" not in capsys.readouterr().out


@pytest.mark.parametrize("block", [2, 7, 1000])
def test_hot_conversation_beside_odd_ones(spark, block):
    rows = [(0, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(60)]
    rows += [(None, 1, "user", "n"), (None, 0, "system", None), (5, -3, "user", "early"), (5, 4, "other", "dropped"), (5, 5, "user", "b")]
    turns = spark.createDataFrame(rows, SCHEMA)
    prompts = {(r.conv_id, r.turn): r.prompt for r in chat.turn_prompts(turns, block_turns=block).collect()}
    end = "<|im_start|>assistant\n"
    for last in range(0, 60, 2):
        assert prompts[0, last] == "".join(shown(role, text) for _, _, role, text in rows[: last + 1]) + end
    assert prompts[None, 1] == shown("system", "") + shown("user", "n") + end
    assert prompts[5, 5] == shown("user", "early") + shown("user", "b") + end and len(prompts) == 33
    folded = {r.conv_id: (r.n_messages, r.n_dropped, r.text) for r in chat.fold_text(turns, block_turns=block).collect()}
    assert folded == {r.conv_id: (r.n_messages, r.n_dropped, r.text) for r in chat.fold_text(turns).collect()}
    assert folded[5] == (3, 1, shown("user", "early") + shown("user", "b")) and folded[0][0] == 60
