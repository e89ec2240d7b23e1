"""Implicit feedback by event-time timers: what an agent was given and nobody corrected for a day counts as accepted.

Two streams in one: routed items, and explicit verdicts on items. An item sets a
timer; a verdict before it takes the item's place. When the watermark passes
the timer, the item is accepted, once: its state then says that it is consumed,
so neither a repeated item nor a late verdict makes another event.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "item_id string, agent_id string, verdict string, source string, text_head string, at timestamp"
#: An item's agent, the head of its text, and whether its event is out.
STATE = T.StructType([T.StructField("agent_id", T.StringType()), T.StructField("text_head", T.StringType()), T.StructField("consumed", T.BooleanType())])


class ImplicitAccepts(StatefulProcessor):
    def __init__(self, hours: float, keep_days: float, least_chars: int) -> None:
        self.wait_ms, self.keep_ms, self.least = int(hours * 3_600_000), int(keep_days * 86_400_000), least_chars

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", STATE)

    def _said(self, key: tuple, agent: str | None, verdict: str, source: str, head: str | None, at: object) -> pd.DataFrame:
        return pd.DataFrame({"item_id": [key[0]], "agent_id": [agent], "verdict": [verdict], "source": [source], "text_head": [head], "at": [pd.Timestamp(at)]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at", "verdict"], na_position="first")
        agent, head, consumed = self.item.get() if self.item.exists() else (None, None, False)
        for r in batch.itertuples():
            if isinstance(r.verdict, str):
                if not consumed:
                    consumed = True
                    self._wait(None)
                    yield self._said(key, r.agent_id if isinstance(r.agent_id, str) else agent, r.verdict, "explicit", head if head is not None else r.text_head, r.at)
                continue
            if consumed or agent is not None:
                continue  # the item has come before
            agent, head = r.agent_id, r.text_head
            if isinstance(head, str) and len(head) >= self.least:
                self._wait(int(pd.Timestamp(r.at).timestamp() * 1000) + self.wait_ms)
        self.item.update((agent, head, consumed))
        if consumed and not list(self.handle.listTimers()):
            self.handle.registerTimer(int(pd.Timestamp(batch["at"].max()).timestamp() * 1000) + self.keep_ms)

    def _wait(self, until: int | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if until is not None:
            self.handle.registerTimer(until)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        agent, head, consumed = self.item.get()
        if consumed:  # kept long enough to know repeats by
            self.item.clear()
            return
        at = expiredTimerInfo.getExpiryTimeInMs()
        self.item.update((agent, head, True))
        self.handle.registerTimer(at + self.keep_ms)
        yield self._said(key, agent, "accept", "implicit", head, pd.Timestamp(at, unit="ms"))

    def close(self) -> None:
        pass


def feedback_events(routed: DataFrame, verdicts: DataFrame, hours: float = 24, late: str = "1 hour", keep_days: float = 30, least_chars: int = 12, head_chars: int = 1000) -> DataFrame:
    """item_id, agent_id, verdict, source (explicit or implicit), text_head, at: one event for each item, ever.

    routed: item_id, agent_id, subject, preview, at (analysed items that an
    agent was chosen for); verdicts: item_id, agent_id, verdict, at. Items with
    less text than least_chars teach nothing and are not waited for.
    """
    head = F.substring(F.concat_ws("\n", F.nullif("subject", F.lit("")), "preview"), 1, head_chars)
    none = F.lit(None).cast("string")
    items = routed.where("agent_id is not null").select("item_id", "agent_id", none.alias("verdict"), head.alias("text_head"), F.col("at").cast("timestamp").alias("at"))
    said = verdicts.select("item_id", "agent_id", "verdict", none.alias("text_head"), F.col("at").cast("timestamp").alias("at"))
    both = items.unionByName(said).withWatermark("at", late)
    return both.groupBy("item_id").transformWithStateInPandas(ImplicitAccepts(hours, keep_days, least_chars), OUT, "Append", "EventTime")
