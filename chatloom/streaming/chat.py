"""Chat sessions as a stream of events (conversation, turn, role, text).

Roles user and assistant append a turn, system replaces the system prompt and
clear empties the history, the system prompt included. Every user turn gives a prompt.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.render import CHATML, ChatTemplate

EVENT_SCHEMA = "conv_id bigint, turn bigint, role string, text string"
OUTPUT_SCHEMA = "conv_id bigint, turn bigint, prompt string, late boolean"
# prompts carry the whole history, so few are held at a time
OUTPUT_ROWS = 64
_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ChatSessions(StatefulProcessor):
    """A session's state: its turns as a list that every turn appends one element to, its system prompt and last turn.

    With ``idle_ms`` a timer is set anew whenever a session has events; when it fires the session is forgotten.
    """

    def __init__(self, template: ChatTemplate, idle_ms: int | None):
        self.template, self.idle_ms, self.roles = template, idle_ms, dict(template.roles)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "text string")
        self.head = handle.getValueState("head", "system string, last_turn bigint")

    def close(self) -> None:
        pass

    def shown(self, role: str, text: str | None) -> str:
        prefix, suffix = self.roles.get(role, ("", ""))
        return f"{prefix}{'' if pd.isna(text) else text}{suffix}" if role in self.roles else ""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        system, last = self.head.get() if self.head.exists() else (None, None)
        system = None if pd.isna(system) else system
        template, columns, out = self.template, ["conv_id", "turn", "prompt", "late"], []
        whole, new = None, []  # the history as one text, read only if a prompt needs it; turns not in the state yet
        bound = last
        # a batch's events of one session; files per trigger bound them
        events = pd.concat(list(rows)).sort_values("turn", kind="stable")
        for turn, role, text in zip(events["turn"], events["role"], events["text"], strict=True):
            turn, role = int(turn), template.default_role if pd.isna(role) else role
            if bound is not None and turn <= bound:
                out.append((key[0], turn, None, True))
                continue
            last = turn
            if role == "clear":
                self.turns.clear()
                system, whole, new = None, "", []
            elif role == "system":
                system = "" if pd.isna(text) else text
            else:
                new.append(self.shown(role, text))
                if role == "user":
                    if whole is None:
                        whole = "".join(t[0] for t in self.turns.get())
                    self.turns.appendList([(t,) for t in new])
                    whole, new = whole + "".join(new), []
                    head = self.shown("system", system) if system is not None else ""
                    out.append((key[0], turn, template.start + head + whole + template.generation, False))
            if len(out) >= OUTPUT_ROWS:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if new:
            self.turns.appendList([(t,) for t in new])
        self.head.update((system, last))
        if self.idle_ms is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.turns.clear()
        self.head.clear()
        yield pd.DataFrame([], columns=["conv_id", "turn", "prompt", "late"])


def stream_chat(events: DataFrame, template: ChatTemplate = CHATML, idle_ms: int | None = None) -> DataFrame:
    """``conv_id, turn, prompt, late``: one row per user turn, with the history held as state.

    Events of a batch are put in turn order; limit the files per trigger to bound a batch. An event not later than the last one
    handled earlier cannot change the history any more: it comes out with ``late`` set and no prompt. A session without
    events for ``idle_ms`` of processing time is forgotten and starts anew; None keeps all sessions. State lives in RocksDB, which
    is set for the session here.
    """
    events.sparkSession.conf.set(_STATE_STORE, _ROCKSDB)
    mode = "None" if idle_ms is None else "ProcessingTime"
    return events.groupBy("conv_id").transformWithStateInPandas(ChatSessions(template, idle_ms), OUTPUT_SCHEMA, "Append", mode)
