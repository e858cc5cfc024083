"""Text between two tags taken out of a stream of pieces: reasoning (<think>) and tool calls (<tool_call>). What may be the start of a tag is held back until it is known."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from lorekeep.streaming.expiry import renew, timed

THINK, TOOL = ("<think>", "</think>"), ("<tool_call>", "</tool_call>")


def held_back(text: str, tag: str) -> int:
    """Length of the longest end of text that a tag starts with."""
    return next((n for n in range(min(len(text), len(tag) - 1), 0, -1) if tag.startswith(text[-n:])), 0)


#: Bytes of a tool call's body that a stream holds back before it gives up and shows it (fixed value).
CAP = 2048
SCAN, INSIDE, LIVE = 0, 1, 2


def step(buffer: str, mode: int, piece: str, tags: tuple[str, str], cap: int | None = None) -> tuple[str, int, str]:
    """(buffer, mode, text to show) after one more piece. Without a cap, what is inside is dropped as it comes; with one it is kept until its tag closes, and a body beyond the cap is shown after all, and everything after it."""
    if mode == LIVE:
        return "", LIVE, piece
    buffer, shown = buffer + piece, []
    while True:
        tag = tags[mode]
        at = buffer.find(tag)
        if at >= 0:
            if mode == SCAN:
                shown.append(buffer[:at])
            buffer, mode = buffer[at + len(tag) :], SCAN if mode == INSIDE else INSIDE
            continue
        if mode == SCAN:
            keep = held_back(buffer, tag)
            shown.append(buffer[: len(buffer) - keep])
            return buffer[len(buffer) - keep :], SCAN, "".join(shown)
        if cap is None:
            return buffer[len(buffer) - held_back(buffer, tag) :], INSIDE, "".join(shown)
        if len(buffer.encode("utf-8", "surrogatepass")) > cap:
            return "", LIVE, "".join([*shown, buffer])
        return buffer, INSIDE, "".join(shown)


def rest(buffer: str, mode: int) -> str:
    """What a stream still shows at its end: what could have become a tag, but no open span."""
    return buffer if mode == SCAN else ""


def strip_stream(pieces: DataFrame, tags: tuple[str, str] = THINK, cap: int | None = None, clock: str | None = None, idle_ms: int = 600_000, late: str = "1 minute") -> DataFrame:
    """pieces: a streaming DataFrame (stream_id, seq, piece and, if there is one, done), in order within each stream and batch by seq. Appends (stream_id, seq, shown) for each piece that lets text out.

    A stream's state goes with its last piece (`done`) or, with a clock (a timestamp column), when it was idle for `idle_ms`; either shows what was still held back. Its size is that of a tag, or of the cap."""
    ends = "done" in pieces.columns
    pieces, timeout = timed(pieces, clock, late)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, mode, last = state.get if state.exists else ("", SCAN, -1)
        out, over, frames = [], state.hasTimedOut, []
        if not over:
            frames = list(batches)
            for seq, piece, done in sorted((int(s), p or "", bool(d)) for b in frames for s, p, d in zip(b.seq, b.piece, b.done if ends else [False] * len(b), strict=True)):
                buffer, mode, shown = step(buffer, mode, piece, tags, cap)
                last, over = seq, over or done
                if shown:
                    out.append((int(key[0]), seq, shown))
        if over:
            if held := rest(buffer, mode):
                out.append((int(key[0]), last, held))
            if state.exists:
                state.remove()
        else:
            state.update((buffer, mode, last))
            renew(state, frames, clock, idle_ms)
        yield pd.DataFrame(out, columns=["stream_id", "seq", "shown"])

    return pieces.groupBy("stream_id").applyInPandasWithState(run, "stream_id long, seq long, shown string", "buffer string, mode int, last long", "append", timeout)


def strip_whole(text: Column, tags: tuple[str, str] = THINK) -> tuple[Column, Column]:
    """The same over whole texts: what is shown in the end, and whether the last tag never closes."""
    rest = F.regexp_replace(text, rf"(?s){tags[0]}.*?(?:{tags[1]}|\z)", "")
    return rest, F.regexp_like(text, F.lit(rf"(?s){tags[0]}(?!.*{tags[1]})"))


def joined(pieces: DataFrame) -> DataFrame:
    """stream_id, text of finished streams. A reply is one value."""
    return pieces.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda x: x["piece"]), "").alias("text"))
