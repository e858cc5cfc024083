"""Token-rate watch: sustained collapse of a stream's rate, with hysteresis. Batch form; the streaming form is in lorekeep.streaming."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Watch:
    max_gap_ms: int = 4000
    skip: int = 2
    baseline: int = 24
    window: int = 16
    collapse: float = 0.6
    recover: float = 0.85
    sustained: int = 32


def rates(tokens: DataFrame, w: Watch = Watch()) -> DataFrame:
    """stream_id, at_ms, token_id, baseline, recent for each gap after the baseline with a full window. Longer gaps than max_gap_ms are stalls and don't
    count, but the clock goes on; the order within a stream is (at_ms, token_id). With a column `turn`, the time between the last token of one turn and the first of the next is no gap."""
    order = Window.partitionBy("stream_id").orderBy("at_ms", "token_id")
    turn = F.col("turn") if "turn" in tokens.columns else F.lit(0)
    g = tokens.select("stream_id", "at_ms", "token_id", turn.alias("turn"))
    g = g.withColumn("gap", F.when(F.col("turn").eqNullSafe(F.lag("turn").over(order)), F.col("at_ms") - F.lag("at_ms").over(order)))
    g = g.where(F.col("gap") <= w.max_gap_ms).withColumn("rn", F.row_number().over(order))
    first = (F.col("rn") > w.skip) & (F.col("rn") <= w.skip + w.baseline)
    whole = Window.partitionBy("stream_id")
    g = g.withColumn("base_ms", F.sum(F.when(first, F.col("gap"))).over(whole)).where(F.col("rn") > w.skip + w.baseline)
    g = g.withColumn("recent_ms", F.sum("gap").over(order.rowsBetween(1 - w.window, 0))).where(F.col("rn") >= w.skip + w.baseline + w.window)
    rate = lambda n, ms: F.lit(1000.0 * n) / F.greatest(F.lit(1), F.col(ms))
    return g.select("stream_id", "at_ms", "token_id", rate(w.baseline, "base_ms").alias("baseline"), rate(w.window, "recent_ms").alias("recent"))


def notices(tokens: DataFrame, w: Watch = Watch()) -> DataFrame:
    """stream_id, at_ms, token_id, throttled, baseline, recent: a row when a collapse has become sustained, and when it has recovered."""
    order = Window.partitionBy("stream_id").orderBy("at_ms", "token_id")
    r = rates(tokens, w).withColumn("slow", F.col("recent") <= F.col("baseline") * w.collapse)
    r = r.withColumn("island", F.sum(F.when(F.col("slow"), 0).otherwise(1)).over(order)).withColumn("run", F.sum(F.col("slow").cast("int")).over(Window.partitionBy("stream_id", "island").orderBy("at_ms", "token_id")))
    say = F.when(F.col("slow") & (F.col("run") >= w.sustained), True).when(~F.col("slow") & (F.col("recent") >= F.col("baseline") * w.recover), False)
    said = r.withColumn("throttled", say).where("throttled is not null").withColumn("before", F.coalesce(F.lag("throttled").over(order), F.lit(False)))
    return said.where("throttled <> before").select("stream_id", "at_ms", "token_id", "throttled", F.round("baseline", 6).alias("baseline"), F.round("recent", 6).alias("recent"))
