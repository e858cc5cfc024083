"""The provisional route of replies as they stream: the first clear one among the prefixes that are looked at."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

from lorekeep.streaming.expiry import renew, timed

#: Least time between two looks (fixed value).
EVERY_MS = 100


def routes(prefixes: DataFrame, unclear: str, every_ms: int = EVERY_MS, clock: str | None = None, idle_ms: int = 600_000, late: str = "1 minute") -> DataFrame:
    """prefixes: a streaming DataFrame (stream_id, at_ms, route and, if there is one, done), in order within each stream and batch by at_ms. Appends (stream_id, route, at_ms), once a stream.

    A look is due when `every_ms` have gone by since the last one, and at once at first. After a clear route a stream is inert; its state, two numbers, goes with the last prefix (`done`) or, with a clock (a timestamp column), when it was idle for `idle_ms`."""
    ends = "done" in prefixes.columns
    prefixes, timeout = timed(prefixes, clock, late)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, shown = state.get if state.exists else (None, False)
        out, over, frames = [], False, list(batches)
        for at, route, done in sorted((int(a), r, bool(d)) for b in frames for a, r, d in zip(b.at_ms, b.route, b.done if ends else [False] * len(b), strict=True)):
            over = over or done
            if not shown and (last is None or at - last >= every_ms):
                last, shown = at, route != unclear
                if shown:
                    out.append((int(key[0]), route, at))
        if over:
            if state.exists:
                state.remove()
        else:
            state.update((last, shown))
            renew(state, frames, clock, idle_ms)
        yield pd.DataFrame(out, columns=["stream_id", "route", "at_ms"])

    return prefixes.groupBy("stream_id").applyInPandasWithState(run, "stream_id long, route string, at_ms long", "last long, shown boolean", "append", timeout)
