"""The token-rate watch as a stateful stream: one small state per stream id, notices as they arise."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

from lorekeep.operators.tokens import Watch
from lorekeep.streaming.expiry import renew, timed

OUT = "stream_id long, at_ms long, token_id long, throttled boolean, baseline double, recent double"
STATE = "turn long, last_at long, seen int, base_ms long, recent array<long>, slow int, throttled boolean"


def step(state: tuple, at: int, w: Watch) -> tuple[tuple, tuple | None]:
    """State after a token, and (throttled, baseline, recent) if there is something to say."""
    last, seen, base_ms, recent, slow, throttled = state
    gap = None if last is None else max(0, at - last)
    if gap is None or gap > w.max_gap_ms:
        return (at, seen, base_ms, recent, slow, throttled), None
    seen += 1
    if seen <= w.skip + w.baseline:
        return (at, seen, base_ms + (gap if seen > w.skip else 0), recent, slow, throttled), None
    recent = [*recent, gap][-w.window :]
    said = None
    if len(recent) == w.window:
        base, now = 1000.0 * w.baseline / max(1, base_ms), 1000.0 * w.window / max(1, sum(recent))
        slow = slow + 1 if now <= base * w.collapse else 0
        if slow >= w.sustained and not throttled:
            throttled, said = True, (True, base, now)
        elif not slow and throttled and now >= base * w.recover:
            throttled, said = False, (False, base, now)
    return (at, seen, base_ms, recent, slow, throttled), said


def notices(tokens: DataFrame, w: Watch = Watch(), clock: str | None = None, idle_ms: int = 600_000, late: str = "1 minute") -> DataFrame:
    """tokens: a streaming DataFrame (stream_id, at_ms, token_id and, if there is one, turn), in order within each stream and batch by (at_ms, token_id).

    With a clock, a timestamp column, a stream idle for `idle_ms` is forgotten. A new turn clears the clock, nothing else. A token that comes in a later batch than its successor counts as a gap of 0; the batch form would sort it."""
    with_turns = "turn" in tokens.columns
    tokens, timeout = timed(tokens, clock, late)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        frames = list(batches)
        turn, *now = state.get if state.exists else (None, None, 0, 0, [], 0, False)
        now = (*now[:3], list(now[3]), *now[4:])
        out = []
        for at, token, new in sorted((int(a), int(t), int(n)) for b in frames for a, t, n in zip(b.at_ms, b.token_id, b.turn if with_turns else [0] * len(b), strict=True)):
            if new != turn:
                turn, now = new, (None, *now[1:])
            now, said = step(now, at, w)
            if said:
                out.append((int(key[0]), at, token, *said))
        state.update((turn, *now))
        renew(state, frames, clock, idle_ms)
        yield pd.DataFrame(out, columns=["stream_id", "at_ms", "token_id", "throttled", "baseline", "recent"])

    return tokens.groupBy("stream_id").applyInPandasWithState(run, OUT, STATE, "append", timeout)
