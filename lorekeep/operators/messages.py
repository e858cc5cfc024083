"""The conversation store as folds over a log: the state of messages and chats is the last event that counts for each key.

Maxima of structs stand for "last write wins": partial results meet before the shuffle, so a chat with any number of events needs no task of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_order(messages: DataFrame, chat: str, created: str, key: str) -> DataFrame:
    """position of each message in its chat: by time, then id."""
    return messages.withColumn("position", F.row_number().over(Window.partitionBy(chat).orderBy(created, key)))


def append_state(events: DataFrame) -> DataFrame:
    """chat_id, message_id, role, text, partial, created_at of every message after a log of events (seq, chat_id, at, kind, role, text).

    checkpoint writes the chat's one unfinished reply, finish replaces its text and closes it under the id and time it began with, discard drops it, append adds a message.
    A run of checkpoints up to the finish or discard that ends it is one reply; its id is that of its first event."""
    w = Window.partitionBy("chat_id").orderBy("seq")
    ends = F.coalesce(F.lag(F.col("kind").isin("finish", "discard")).over(w), F.lit(False)).cast("long")
    own = events.where("kind <> 'append'").withColumn("_reply", F.sum(ends).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    reply = own.groupBy("chat_id", "_reply").agg(
        F.min("seq").alias("message_id"), F.min_by("at", "seq").alias("created_at"), F.max_by("text", F.when(F.col("kind") != "discard", F.col("seq"))).alias("text"),
        F.bool_or(F.col("kind") == "discard").alias("_gone"), F.bool_or(F.col("kind") == "finish").alias("_done"),
    )
    reply = reply.where("not _gone").select("chat_id", "message_id", F.lit("assistant").alias("role"), "text", (~F.col("_done")).alias("partial"), "created_at")
    plain = events.where("kind = 'append'").select("chat_id", F.col("seq").alias("message_id"), "role", "text", F.lit(False).alias("partial"), F.col("at").alias("created_at"))
    return plain.unionByName(reply)


def last_values(events: DataFrame, keys: list[str], attributes: list[str], order: str) -> DataFrame:
    """The last non-null value of each attribute for each key."""
    return events.groupBy(*keys).agg(*[F.max_by(a, F.when(F.col(a).isNotNull(), F.col(order))).alias(a) for a in attributes])


def chat_states(events: DataFrame) -> DataFrame:
    """chat_id, title, pinned, archived, folder_id of chats that were not deleted. events: seq, chat_id, kind, value.

    A title set by a person stays; automatic ones count only until then."""
    last = lambda kind: F.max_by("value", F.when(F.col("kind") == kind, F.col("seq")))
    g = events.groupBy("chat_id").agg(last("rename").alias("own"), last("auto").alias("auto"), last("pin").alias("pinned"), last("archive").alias("archived"), last("move").alias("folder_id"), F.bool_or(F.col("kind") == "delete").alias("gone"))
    return g.where("not gone").select("chat_id", F.coalesce("own", "auto", F.lit("New chat")).alias("title"), F.coalesce(F.col("pinned") == "1", F.lit(False)).alias("pinned"), F.coalesce(F.col("archived") == "1", F.lit(False)).alias("archived"), "folder_id")


def filed(chats: DataFrame, folders: DataFrame) -> DataFrame:
    """chats with folder_id null where the folder is gone."""
    known = folders.select("folder_id").distinct().withColumn("_known", F.lit(True))
    return chats.join(known, "folder_id", "left").withColumn("folder_id", F.when(F.col("_known"), F.col("folder_id"))).drop("_known")


def confirm_routes(messages: DataFrame, confirmations: DataFrame, routes: list[str]) -> DataFrame:
    """message_id, route, problem: the last confirmation of each message, or why it is refused. messages: message_id, role, verdict_kind (null: none); confirmations: message_id, route, seq."""
    last = confirmations.groupBy("message_id").agg(F.max_by("route", F.when(F.col("route").isin(routes), F.col("seq"))).alias("route"), F.bool_or(~F.coalesce(F.col("route").isin(routes), F.lit(False))).alias("odd"))
    m = last.join(messages.select("message_id", "role", "verdict_kind", F.lit(True).alias("known")), "message_id", "left")
    problem = F.when(F.col("known").isNull(), "no message").when(F.col("role") != "assistant", "not a reply").when(F.col("verdict_kind").isNull(), "no verdict").when(F.col("verdict_kind") == "lookup", "no route").when(F.col("route").isNull(), "unknown route")
    return m.select("message_id", F.when(problem.isNull(), F.col("route")).alias("route"), problem.alias("problem"))


def overridden(model_route: Column, confirmed: Column) -> Column:
    """Whether a person confirmed another route than the model's."""
    return F.coalesce(confirmed != model_route, F.lit(False)) | (confirmed.isNotNull() & model_route.isNull())


def attach_verdicts(messages: DataFrame, verdicts: DataFrame) -> DataFrame:
    """message_id, verdict, content, refused: verdicts by order of seq; the detectors of a message's first verdict are the only ones that may replace it. Display text of the last accepted one replaces the content.

    messages: message_id, role, content; verdicts: message_id, seq, detectors, verdict, display."""
    v = verdicts.join(messages.where("role = 'assistant'").select("message_id", "content"), "message_id")
    first = v.groupBy("message_id").agg(F.min_by(F.struct("detectors"), "seq").alias("_first"))
    v = v.join(first, "message_id").withColumn("_ok", F.col("detectors").eqNullSafe(F.col("_first.detectors")))
    at = F.when(F.col("_ok"), F.col("seq"))
    shown = F.max_by("display", F.when(F.col("_ok") & F.col("display").isNotNull(), F.col("seq")))
    return v.groupBy("message_id").agg(F.max_by("verdict", at).alias("verdict"), F.coalesce(shown, F.first("content")).alias("content"), F.count_if(~F.col("_ok")).alias("refused"))


WITHHELD = "This reply was not checked and is not shown."


def replay(role: Column, content: Column, supervised: Column, kind: Column, display: Column) -> tuple[Column, Column]:
    """Text to show of a stored message and whether it is withheld: a supervised reply without a verdict is, and a lookup reply without display text."""
    lookup_reply = F.coalesce(kind == "lookup", F.lit(False)) & (role != "user")
    withheld = F.when(lookup_reply, display.isNull()).when(kind.isNotNull(), False).otherwise(supervised & (role == "assistant"))
    return F.when(withheld, F.lit(WITHHELD)).when(lookup_reply, display).otherwise(content), withheld


STAMPS = ["prompt_fingerprint", "model_sha", "adapter_sha", "catalogue_sha", "app_build"]


def stamp(verdicts: DataFrame) -> DataFrame:
    """Verdicts with every provenance column present; '' where nothing is pinned."""
    have = {c: F.coalesce(F.col(c), F.lit("")) if c in verdicts.columns else F.lit("") for c in STAMPS}
    return verdicts.withColumns(have)


def receipt(changes: list[tuple[Column, str]]) -> Column:
    """Ordered lines for the changes made to a reply; each is (a count, text with {} for it), left out at 0."""
    lines = [F.when(n > 0, F.concat(F.lit(text.split("{}")[0]), n.cast("string"), F.lit(text.split("{}")[1])) if "{}" in text else F.lit(text)) for n, text in changes]
    return F.array_compact(F.array(*lines))


def receipt_label(n: Column) -> Column:
    return F.when(n == 0, "Reply shown unchanged").when(n == 1, "1 change to the reply").otherwise(F.concat(n.cast("string"), F.lit(" changes to the reply")))


def audit_lines(messages: DataFrame) -> DataFrame:
    """chat_id, message_id, line: one JSON line for each guarded reply with the user's text before it. messages: chat_id, message_id, role, text, route, confirmed."""
    before = Window.partitionBy("chat_id").orderBy("message_id").rowsBetween(Window.unboundedPreceding, -1)
    m = messages.withColumn("asked", F.last(F.when(F.col("role") == "user", F.sha2("text", 256)), ignorenulls=True).over(before))
    m = m.where("role = 'assistant' and route is not null")
    line = F.to_json(F.struct(F.col("message_id").alias("id"), F.col("asked").alias("asked_sha"), F.col("route"), F.col("confirmed"), overridden(F.col("route"), F.col("confirmed")).alias("overridden")))
    return m.select("chat_id", "message_id", line.alias("line"))


def provisional_routes(prefixes: DataFrame, unclear: str, every_ms: int = 100) -> DataFrame:
    """stream_id, route, at_ms: the first route other than `unclear` among the prefixes that are looked at: the first one, and each that comes `every_ms` or more after the last look. The batch form of streaming.routes.

    A reply's prefixes are one value: their times and routes, not their texts."""
    g = prefixes.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct(F.col("at_ms").cast("long").alias("at_ms"), "route"))).alias("_p"))
    none = F.struct(F.lit(None).cast("long").alias("last"), F.lit(None).cast("string").alias("route"))
    look = lambda s, x: s["last"].isNull() | (x["at_ms"] - s["last"] >= every_ms)
    found = F.aggregate("_p", none, lambda s, x: F.when(s["route"].isNull() & look(s, x), F.struct(x["at_ms"].alias("last"), F.when(x["route"] != unclear, x["route"]).alias("route"))).otherwise(s))
    return g.select("stream_id", found.alias("_f")).where("_f.route is not null").select("stream_id", "_f.route", F.col("_f.last").alias("at_ms"))


def sources_from_prompt(prompt: Column, heads: Column) -> Column:
    """Start of each source's text in a prompt, found one after the other; if one head is missing, none counts (nulls). heads: array of strings, in order."""
    found = F.aggregate(
        heads,
        F.struct(F.lit(1).alias("from"), F.array().cast("array<int>").alias("starts")),
        lambda s, h: F.struct(
            F.when((s["from"] > 0) & (F.position(h, prompt, s["from"]) > 0), F.position(h, prompt, s["from"]) + F.char_length(h)).otherwise(0).alias("from"),
            F.concat(s["starts"], F.array(F.when((s["from"] > 0) & (F.position(h, prompt, s["from"]) > 0), F.position(h, prompt, s["from"]) + F.char_length(h)).otherwise(0))).alias("starts"),
        ),
    )
    return F.when(found["from"] > 0, found["starts"])


def pin_check(sha: Column, version: Column, pinned_sha: Column, pinned_version: Column) -> Column:
    """Whether the pack that answered is the pinned one; anything missing on either side is a mismatch."""
    return F.coalesce((F.nullif(sha, F.lit("")) == F.nullif(pinned_sha, F.lit(""))) & (F.nullif(version, F.lit("")) == F.nullif(pinned_version, F.lit(""))), F.lit(False))


def citation_row(title: Column, section: Column, url: Column, locator: Column, retrieved: Column) -> tuple[Column, Column]:
    """Heading of a citation (title and section), and its link and date on a second line; only an https address is a link."""
    https = lambda c: F.when(F.regexp_like(F.trim(c), F.lit(r"(?i)^https://[^/\s?#]+")), F.trim(c))
    head = F.concat_ws(" · ", F.coalesce(title, F.lit("")), F.nullif(section, F.lit("")))
    at = F.when(F.coalesce(retrieved, F.lit("")) != "", F.concat(F.lit("as at "), retrieved))
    return head, F.concat_ws(" · ", F.coalesce(https(url), https(locator)), at)


def wire_messages(system: Column, greeting: Column, turns: Column, supervised: Column, note: str = "") -> Column:
    """What goes to the model: the prompt, for unsupervised entries a greeting, and of each turn role and content alone. turns: array of structs with role and content."""
    one = lambda role, text: F.struct(role.alias("role"), text.alias("content"))
    sent = F.transform(turns, lambda t: one(t["role"], t["content"]))
    own = F.array(one(F.lit("system"), system))
    other = F.array(one(F.lit("system"), F.concat(system, F.lit(note))), one(F.lit("assistant"), greeting))
    return F.concat(F.when(supervised, own).otherwise(other), sent)


def lookup_turn(crisis: Column, pinned: Column, outcome: Column, fits: Column) -> Column:
    """The step a lookup takes, the first that applies: crisis first, then the pack's identity, the outcome, the budget, then the guard."""
    return F.when(crisis, "crisis").when(~pinned, "wrong_pack").when(outcome == "did_you_mean", "offer").when(outcome != "found", "refuse").when(~fits, "over_budget").otherwise("guard")
