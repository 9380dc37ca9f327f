"""Per-domain circuit breaker over a stream of calls: closed, open, half-open.

The verdict on a call depends on all calls of its domain before it, so this is keyed state, one value per domain.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from contentspark.operators.policies import BREAKER_FAILURE_RATE, BREAKER_MIN_CALLS, BREAKER_WINDOW

OUTPUT = "domain string, ts timestamp, call_id long, permitted boolean, state string"
STATE = "state string, outcomes array<boolean>, opened_ms long"


@dataclass(frozen=True)
class BreakerRules:
    window: int = BREAKER_WINDOW
    min_calls: int = BREAKER_MIN_CALLS
    failure_rate: float = BREAKER_FAILURE_RATE
    open_ms: int = 10_000
    half_open_calls: int = 10


def next_state(
    rules: BreakerRules, state: str, outcomes: list[bool], opened_ms: int, now_ms: int, failed: bool,
) -> tuple[bool, str, list[bool], int]:
    """``(permitted, state, outcomes, opened_ms)`` after one call."""
    if state == "open":
        if now_ms < opened_ms + rules.open_ms:
            return False, state, outcomes, opened_ms
        state, outcomes = "half_open", []
    size, least = (rules.half_open_calls,) * 2 if state == "half_open" else (rules.window, rules.min_calls)
    outcomes = [*outcomes, failed][-size:]
    if len(outcomes) >= least:
        if sum(outcomes) / len(outcomes) >= rules.failure_rate:
            return True, "open", [], now_ms
        if state == "half_open":
            return True, "closed", [], 0
    return True, state, outcomes, opened_ms


class BreakerProcessor(StatefulProcessor):
    def __init__(self, rules: BreakerRules) -> None:
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("breaker", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self.value.get()
        state, outcomes, opened = (stored[0], list(stored[1]), stored[2]) if stored else ("closed", [], 0)
        verdicts = []
        calls = pd.concat(list(rows)).sort_values(["ts", "call_id"])
        for ts, call_id, failed in zip(calls["ts"], calls["call_id"], calls["failed"]):
            permitted, state, outcomes, opened = next_state(
                self.rules, state, outcomes, opened, int(ts.timestamp() * 1000), bool(failed))
            verdicts.append((key[0], ts, call_id, permitted, state))
        self.value.update((state, outcomes, opened))
        yield pd.DataFrame(verdicts, columns=["domain", "ts", "call_id", "permitted", "state"])

    def close(self) -> None:
        pass


def breaker_stream(calls: DataFrame, rules: BreakerRules = BreakerRules()) -> DataFrame:
    """Verdict on every call of ``calls(domain, ts timestamp, call_id, failed)``.

    Calls of a domain are taken in time order within a micro-batch; the source's rate limit bounds what one
    domain adds to a task at a time. Needs the RocksDB state store.
    """
    return calls.groupBy("domain").transformWithStateInPandas(
        statefulProcessor=BreakerProcessor(rules), outputStructType=OUTPUT, outputMode="append",
        timeMode="None",
    )
