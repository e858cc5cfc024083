"""When the state of a stream that never says it is done goes: by event time, so that a finished input ends and a replay gives the same rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def timed(df: DataFrame, clock: str | None, late: str) -> tuple[DataFrame, str]:
    """The input and its kind of timeout: with a clock, a timestamp column, watermarked by how late its rows may be."""
    return (df.withWatermark(clock, late), GroupStateTimeout.EventTimeTimeout) if clock else (df, GroupStateTimeout.NoTimeout)


def renew(state: GroupState, frames: list[pd.DataFrame], clock: str | None, idle_ms: int) -> None:
    """The state may go `idle_ms` after the last row seen."""
    if clock:
        last = max((int(f[clock].max().timestamp() * 1000) for f in frames if len(f)), default=0)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_ms)
