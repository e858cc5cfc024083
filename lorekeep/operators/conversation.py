"""Conversation analytics: windows over the turns of a conversation, always with the turn as order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as T

REPLY_RESERVE, SAFETY = 512, 128


def by_turn() -> Window:
    return Window.partitionBy("conv_id").orderBy("turn")


def last_user(messages: DataFrame) -> DataFrame:
    """Assistant turns with the last user text before each."""
    before = by_turn().rowsBetween(Window.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(before)
    return messages.withColumn("asked", asked).where("role = 'assistant'").select("conv_id", "turn", "asked")


def context_suffix(messages: DataFrame, n_ctx: int = 4096, system: str = "", greeting: str = "") -> DataFrame:
    """The longest run of latest messages that fits the window beside the preamble and the reply; the last message always stays."""
    est = lambda s: -(-len(s) * 2 // 7) + 4
    budget = n_ctx - REPLY_RESERVE - SAFETY - est(system) - est(greeting)
    latest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    m = messages.select("conv_id", "turn", T.est_tokens(F.col("text")).alias("tokens"))
    m = m.withColumn("used", F.sum("tokens").over(latest.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rn", F.row_number().over(latest))
    return m.where((F.col("used") <= budget) | (F.col("rn") == 1)).select("conv_id", "turn", "tokens", "used")


def export_text(messages: DataFrame) -> DataFrame:
    """One document per conversation: role headings and texts in order. A conversation becomes one value, as its export is one file."""
    label = F.create_map(*[F.lit(x) for x in ("user", "You", "assistant", "Assistant", "system", "System")])
    part = F.concat(F.coalesce(F.try_element_at(label, F.col("role")), F.lit("Other")), F.lit(":\n"), F.coalesce("text", F.lit("")))
    rows = messages.select("conv_id", F.struct("turn", part.alias("part")).alias("x"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["part"]), "\n\n").alias("document"))


def lookup_scope(messages: DataFrame, is_lookup) -> DataFrame:
    """Turns with `in_history`: false for the assistant turn right after a lookup query."""
    asked = (F.col("role") == "user") & is_lookup
    after = F.coalesce(F.lag(asked).over(by_turn()), F.lit(False))
    return messages.select("conv_id", "turn", "role", (~((F.col("role") == "assistant") & after)).alias("in_history"))


def search(messages: DataFrame, term: str) -> DataFrame:
    """Conversations in which a message has the term: newest turn first, then id."""
    has = messages.where(F.array_contains(T.terms(F.col("text")), term)).select("conv_id").distinct()
    stats = messages.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count("*").alias("n_messages"))
    return stats.join(has, "conv_id", "left_semi")


def sessions(messages: DataFrame, key) -> DataFrame:
    """Runs of turns with the same key: a new run starts where it changes."""
    m = messages.withColumn("_key", key)
    new = (~F.col("_key").eqNullSafe(F.lag("_key").over(by_turn())) | (F.row_number().over(by_turn()) == 1)).cast("long")
    return m.withColumn("_new", new).withColumn("session", F.sum("_new").over(by_turn())).groupBy("conv_id", "session").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n_turns"))


def export_markdown(messages: DataFrame) -> DataFrame:
    """conv_id, document: date headings where the date changes, bold role labels, texts, and the sources of a message as numbered footnotes at the end. messages: conv_id, turn, date, role, text, source (null: none)."""
    w = by_turn()
    cited = F.count("source").over(w.rowsBetween(Window.unboundedPreceding, 0))
    m = messages.withColumn("_n", cited).withColumn("_new", ~F.col("date").eqNullSafe(F.lag("date").over(w)) | (F.row_number().over(w) == 1))
    label = F.create_map(*[F.lit(x) for x in ("user", "You", "assistant", "Assistant", "system", "System")])
    body = F.concat(F.when(F.col("_new"), F.concat(F.lit("## "), "date", F.lit("\n\n"))).otherwise(""), F.lit("**"), F.coalesce(F.try_element_at(label, F.col("role")), F.lit("Other")), F.lit("**: "), F.coalesce("text", F.lit("")), F.when(F.col("source").isNotNull(), F.concat(F.lit("[^"), F.col("_n").cast("string"), F.lit("]"))).otherwise(""))
    note = F.when(F.col("source").isNotNull(), F.concat(F.lit("[^"), F.col("_n").cast("string"), F.lit("]: "), "source"))
    rows = m.select("conv_id", F.struct("turn", body.alias("body"), note.alias("note")).alias("x")).groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    notes = F.array_compact(F.transform("x", lambda x: x["note"]))
    return rows.select("conv_id", F.concat_ws("\n\n", F.array_join(F.transform("x", lambda x: x["body"]), "\n\n"), F.nullif(F.array_join(notes, "\n"), F.lit(""))).alias("document"))


def export_json(messages: DataFrame) -> DataFrame:
    """conv_id, document: the messages of a conversation as one JSON array of role and text."""
    rows = messages.select("conv_id", F.struct("turn", F.struct("role", F.coalesce("text", F.lit("")).alias("text")).alias("m")).alias("x"))
    return rows.groupBy("conv_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["m"])).alias("document"))
