"""What a reader saw of a stream of states: each is shown for its dwell, a newer one of its kind replaces it at once, an error comes first, a backlog is dropped."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

DWELL_MS, MOST_LAG_MS = 700, 2500


def shown_states(events: list[tuple[int, str, str]], dwell: int = DWELL_MS, most_lag: int = MOST_LAG_MS) -> list[tuple[int, str]]:
    """(time, kind) of every change on screen for (time, kind, tone) events in order; what is queued in the end is shown too."""
    out: list[tuple[int, str]] = []
    queue: list[str] = []

    def until(now: float) -> None:
        nonlocal queue
        while queue and out[-1][0] + dwell <= now:
            at = out[-1][0] + dwell
            if (len(queue) - 1) * dwell > most_lag:
                queue = queue[-1:]
            out.append((at, queue.pop(0)))

    for at, kind, tone in events:
        until(at)
        if not out or kind == out[-1][1]:
            out.append((at, kind))
        elif tone == "error":
            queue = []
            out.append((at, kind))
        elif (queue[-1] if queue else out[-1][1]) != kind:
            queue.append(kind)
    until(float("inf"))
    return out


def readable_sequence(states: DataFrame) -> DataFrame:
    """stream_id, n, at_ms, kind. states: stream_id, at_ms, kind, tone; one stream is one group, as each state depends on what is on screen."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at_ms", "kind"])
        got = shown_states(list(zip(rows.at_ms, rows.kind, rows.tone, strict=True)))
        return pd.DataFrame({"stream_id": [rows.stream_id.iloc[0]] * len(got), "n": range(len(got)), "at_ms": [int(a) for a, _ in got], "kind": [k for _, k in got]})

    return states.groupBy("stream_id").applyInPandas(run, "stream_id long, n int, at_ms long, kind string")
