"""Queries over the conversation store and their SQL. Conversations stand for chats; events for the log of writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.operators import messages as M
from lorekeep.session import table

ROUTES = ["EMERGENCY", "CLINICIAN", "SELF_CARE"]
KINDS = {"view": "append", "click": "checkpoint", "purchase": "finish", "error": "discard"}


def _turns(s, d):
    return table(s, d, "conversations").select(F.col("conv_id").alias("chat_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), "turn", "role", "text")


_TURNS = "SELECT conv_id AS chat_id, conv_id * 1000 + turn AS message_id, turn, role, text FROM conversations"


def _log(s, d):
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("event_type")), F.lit("checkpoint"))
    return table(s, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("chat_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), kind.alias("kind"), F.lit("user").alias("role"), "props", F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("text"))


_KIND = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " ELSE 'checkpoint' END"
_LOG = f"SELECT event_id AS seq, user_id AS chat_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at_, {_KIND} AS kind, 'v' || event_id AS text FROM events"


def _chat_events(s, d):
    k = F.col("event_id")
    kind = F.when(k % 97 == 0, "delete").when(k % 7 == 0, "rename").when(k % 7 == 1, "auto").when(k % 7 == 2, "pin").when(k % 7 == 3, "archive").when(k % 7 == 4, "move").otherwise("auto")
    value = F.when(kind.isin("pin", "archive"), (F.floor(k / 7) % 2).cast("string")).when(kind == "move", F.concat(F.lit("f"), (k % 10).cast("string"))).otherwise(F.concat(F.lit("t"), k.cast("string")))
    return table(s, d, "events").select(k.alias("seq"), F.floor(k / 20).alias("chat_id"), kind.alias("kind"), value.alias("value"))


_EV = """SELECT event_id AS seq, event_id // 20 AS chat_id, kind, CASE WHEN kind IN ('pin', 'archive') THEN ((event_id // 7) % 2)::VARCHAR WHEN kind = 'move' THEN 'f' || event_id % 10 ELSE 't' || event_id END AS value
FROM (SELECT *, CASE WHEN event_id % 97 = 0 THEN 'delete' ELSE CASE event_id % 7 WHEN 0 THEN 'rename' WHEN 2 THEN 'pin' WHEN 3 THEN 'archive' WHEN 4 THEN 'move' ELSE 'auto' END END AS kind FROM events)"""
_CHATS = f"""SELECT chat_id, coalesce(arg_max(value, seq) FILTER (kind = 'rename'), arg_max(value, seq) FILTER (kind = 'auto'), 'New chat') AS title, coalesce(arg_max(value, seq) FILTER (kind = 'pin') = '1', false) AS pinned,
coalesce(arg_max(value, seq) FILTER (kind = 'archive') = '1', false) AS archived, arg_max(value, seq) FILTER (kind = 'move') AS folder_id FROM ({_EV}) GROUP BY chat_id HAVING NOT bool_or(kind = 'delete')"""


def _folders(s, d):
    return s.range(10).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("folder_id")).where("folder_id <> 'f3'")


def _verdict_kind():
    m = F.col("message_id")
    return F.when(m % 5 == 0, None).when(m % 5 == 1, "lookup").otherwise("triage")


def _confirm(s, d):
    t = _turns(s, d)
    m = F.col("message_id")
    asked = t.where("message_id % 7 <> 3").select((m + F.when(m % 11 == 0, 500_000_000).otherwise(0)).alias("message_id"), F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit("CLINICIAN").alias("route")), F.struct(F.lit(2).alias("seq"), F.when(m % 2 == 0, "SELF_CARE").otherwise("elsewhere").alias("route")))).alias("c")).select("message_id", "c.seq", "c.route")
    return M.confirm_routes(t.select("message_id", "role", _verdict_kind().alias("verdict_kind")), asked, ROUTES)


def _attach(s, d):
    m = F.col("message_id")
    v = _turns(s, d).select("message_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("seq"))
    v = v.select("message_id", "seq", F.when((m % 4 == 0) & (F.col("seq") == 2), "b").when(m % 9 == 0, None).otherwise("a").alias("detectors"), F.concat(F.lit("v"), F.col("seq").cast("string")).alias("verdict"), F.when((F.col("seq") < 3) & (m % 3 == 0), F.concat(F.lit("shown "), F.col("seq").cast("string"))).alias("display"))
    return M.attach_verdicts(_turns(s, d).select("message_id", "role", F.col("text").alias("content")), v)


def _replay(s, d):
    m = F.col("message_id")
    text, withheld = M.replay(F.col("role"), F.col("text"), m % 2 == 0, _verdict_kind(), F.when(m % 10 == 1, "shown"))
    return _turns(s, d).select("message_id", F.sha2(text, 256).alias("text_sha"), withheld.alias("withheld"))


def _stamp(s, d):
    t = _turns(s, d).select("message_id", F.when(F.col("message_id") % 3 == 0, F.substring(F.sha2("text", 256), 1, 12)).alias("prompt_fingerprint"), F.col("role").alias("model_sha"))
    return M.stamp(t)


def _receipt(s, d):
    m = F.col("message_id")
    rows = M.receipt([(m % 3, "{} sentences with a dose withheld"), (F.when(m % 4 == 0, 1).otherwise(0), "Time frame withheld"), (m % 2, "{} repeated signposts removed")])
    t = _turns(s, d).select("message_id", rows.alias("r"))
    return t.select("message_id", F.array_join("r", "|").alias("rows"), M.receipt_label(F.size("r")).alias("label"))


def _audit(s, d):
    m = F.col("message_id")
    t = _turns(s, d).withColumn("route", F.when(m % 4 == 3, "CLINICIAN").when(m % 4 == 1, "SELF_CARE")).withColumn("confirmed", F.when(m % 3 == 0, "CLINICIAN"))
    return M.audit_lines(t)


def _override(s, d):
    m = F.col("message_id")
    return _turns(s, d).select("message_id", M.overridden(F.when(m % 4 == 1, "SELF_CARE").when(m % 4 == 3, "CLINICIAN"), F.when(m % 3 == 0, "CLINICIAN")).alias("overridden"))


def _provisional(s, d):
    e = table(s, d, "events").select(F.floor(F.col("event_id") / 10).alias("stream_id"), ((F.col("event_id") % 10) * 37 + F.col("user_id") % 5).alias("at_ms"), F.when(F.col("event_type") == "view", "CLINICIAN").when(F.col("event_type") == "error", "EMERGENCY").otherwise("UNCLEAR").alias("route"))
    return M.provisional_routes(e, "UNCLEAR")


def _prompt_sources(s, d):
    """The heads are the first words of a turn's sentences; every fifth turn asks for one that isn't there."""
    t = table(s, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("p"))
    heads = F.transform(F.regexp_extract_all("p", F.lit(r"([A-Za-z]+ [a-z]+)[^.]*\."), F.lit(1)), lambda x: x)
    h = F.when(F.col("turn") % 5 == 4, F.concat(F.slice(heads, 1, 1), F.array(F.lit("no such head")))).otherwise(F.slice(heads, 1, 3))
    return t.withColumn("h", h).select("conv_id", "turn", F.array_join(M.sources_from_prompt(F.col("p"), F.col("h")).cast("array<string>"), ",").alias("starts"))


def _pins(s, d):
    m = F.col("message_id")
    sha = F.when(m % 6 == 0, "").when(m % 6 == 1, None).when(m % 6 == 2, "y").otherwise("x")
    return _turns(s, d).select("message_id", M.pin_check(sha, F.lit("1"), F.when(m % 6 == 0, "").otherwise("x"), F.when(m % 5 == 0, "2").otherwise("1")).alias("matches"))


def _citation(s, d):
    k = F.col("page_id")
    head, tail = M.citation_row(F.substring("url", 1, 20), F.when(k % 2 == 0, "A > B").otherwise(""), F.when(k % 3 == 0, F.replace("url", F.lit("http:"), F.lit("https:"))).otherwise(F.col("url")), F.when(k % 4 == 0, F.lit("https://a.example/x")), F.when(k % 5 == 0, "2024-05-01"))
    return table(s, d, "pages").select("page_id", head.alias("head"), tail.alias("tail"))


def _wire(s, d):
    t = table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.substring(F.coalesce("text", F.lit("")), 1, 5).alias("content")))).alias("t"))
    w = M.wire_messages(F.lit("S"), F.lit("G"), F.col("t"), F.col("conv_id") % 2 == 0, "!")
    return t.select("conv_id", F.array_join(F.transform(w, lambda x: F.concat(x["role"], F.lit("="), x["content"])), ";").alias("wire"))


def _lookup_turn(s, d):
    m = F.col("message_id")
    return _turns(s, d).select("message_id", M.lookup_turn(m % 13 == 0, m % 7 != 0, F.when(m % 5 == 0, "not_found").when(m % 5 == 1, "did_you_mean").otherwise("found"), F.length(F.coalesce("text", F.lit(""))) < 400).alias("step"))


QUERIES = {
    "sort_messages": lambda s, d: M.in_order(table(s, d, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id").select("user_id", "event_id", "position"),
    "conv_append": lambda s, d: M.append_state(_log(s, d)),
    "st_checkpoint_partial": lambda s, d: M.append_state(_log(s, d).where("kind <> 'append'")).where("partial").select("chat_id", "message_id", "text"),
    "conv_chat_mutations": lambda s, d: M.chat_states(_chat_events(s, d)),
    "conv_folders": lambda s, d: M.filed(M.chat_states(_chat_events(s, d)), _folders(s, d)).select("chat_id", "folder_id"),
    "conv_confirm_route": _confirm,
    "conv_attach_guard": lambda s, d: _attach(s, d).withColumn("content", F.sha2("content", 256)),
    "conv_replay": _replay,
    "conv_persist_stamp": _stamp,
    "audit_receipt": _receipt,
    "sink_triage_log": _audit,
    "join_route_override": _override,
    "st_provisional_route": _provisional,
    "rag_sources_from_prompt": _prompt_sources,
    "rag_pin_check": _pins,
    "rag_citation_row": _citation,
    "rag_messages": _wire,
    "lookup_turn": _lookup_turn,
}

_VK = "CASE message_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'lookup' ELSE 'triage' END"
_STATE = f"""WITH l AS ({_LOG}), o AS (SELECT *, sum(e) OVER (PARTITION BY chat_id ORDER BY seq) AS r FROM (SELECT *, coalesce(lag(kind IN ('finish', 'discard')) OVER (PARTITION BY chat_id ORDER BY seq), false)::INT AS e FROM l WHERE kind <> 'append')),
g AS (SELECT chat_id, min(seq) AS message_id, 'assistant' AS role, arg_max(text, seq) FILTER (kind <> 'discard') AS text, NOT bool_or(kind = 'finish') AS partial, arg_min(at_, seq) AS created_at FROM o GROUP BY chat_id, r HAVING NOT bool_or(kind = 'discard'))"""
ORACLE_SQL = {
    "sort_messages": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS position FROM events",
    "conv_append": _STATE + " SELECT * FROM g UNION ALL SELECT chat_id, seq, 'user', text, false, at_ FROM l WHERE kind = 'append'",
    "st_checkpoint_partial": _STATE + " SELECT chat_id, message_id, text FROM g WHERE partial",
    "conv_chat_mutations": _CHATS,
    "conv_folders": f"SELECT chat_id, CASE WHEN folder_id <> 'f3' THEN folder_id END AS folder_id FROM ({_CHATS})",
    "conv_confirm_route": f"""WITH t AS ({_TURNS}), a AS (SELECT message_id + CASE WHEN message_id % 11 = 0 THEN 500000000 ELSE 0 END AS message_id, message_id % 2 = 0 AS own FROM t WHERE message_id % 7 <> 3),
p AS (SELECT a.message_id, CASE WHEN own THEN 'SELF_CARE' ELSE 'CLINICIAN' END AS r, CASE WHEN t.message_id IS NULL THEN 'no message' WHEN role <> 'assistant' THEN 'not a reply' WHEN a.message_id % 5 = 0 THEN 'no verdict' WHEN a.message_id % 5 = 1 THEN 'no route' END AS problem FROM a LEFT JOIN t USING (message_id))
SELECT message_id, CASE WHEN problem IS NULL THEN r END AS route, problem FROM p""",
    "conv_attach_guard": f"""SELECT message_id, 'v3' AS verdict, sha256(CASE WHEN message_id % 3 = 0 THEN CASE WHEN message_id % 4 = 0 THEN 'shown 1' ELSE 'shown 2' END ELSE text END) AS content, CASE WHEN message_id % 4 = 0 THEN 1 ELSE 0 END::BIGINT AS refused FROM ({_TURNS}) WHERE role = 'assistant'""",
    "conv_replay": f"""SELECT message_id, sha256(CASE WHEN w THEN '{M.WITHHELD}' WHEN k = 'lookup' AND role <> 'user' THEN 'shown' ELSE text END) AS text_sha, w AS withheld FROM (
SELECT *, CASE WHEN k = 'lookup' AND role <> 'user' THEN message_id % 10 <> 1 WHEN k IS NOT NULL THEN false ELSE message_id % 2 = 0 AND role = 'assistant' END AS w FROM (SELECT *, {_VK} AS k FROM ({_TURNS})))""",
    "conv_persist_stamp": f"SELECT message_id, CASE WHEN message_id % 3 = 0 THEN coalesce(substr(sha256(text), 1, 12), '') ELSE '' END AS prompt_fingerprint, coalesce(role, '') AS model_sha, '' AS adapter_sha, '' AS catalogue_sha, '' AS app_build FROM ({_TURNS})",
    "audit_receipt": f"""SELECT message_id, array_to_string(l, '|') AS rows, CASE len(l) WHEN 0 THEN 'Reply shown unchanged' WHEN 1 THEN '1 change to the reply' ELSE len(l) || ' changes to the reply' END AS label FROM (
SELECT message_id, list_filter([CASE WHEN message_id % 3 > 0 THEN message_id % 3 || ' sentences with a dose withheld' END, CASE WHEN message_id % 4 = 0 THEN 'Time frame withheld' END, CASE WHEN message_id % 2 > 0 THEN message_id % 2 || ' repeated signposts removed' END], lambda x: x IS NOT NULL) AS l FROM ({_TURNS}))""",
    "sink_triage_log": f"""WITH t AS (SELECT *, CASE message_id % 4 WHEN 3 THEN 'CLINICIAN' WHEN 1 THEN 'SELF_CARE' END AS route, message_id % 3 = 0 AS c, last_value(CASE WHEN role = 'user' THEN sha256(text) END IGNORE NULLS) OVER (PARTITION BY chat_id ORDER BY message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM ({_TURNS}))
SELECT chat_id, message_id, '{{"id":' || message_id || CASE WHEN q IS NULL THEN '' ELSE ',"asked_sha":"' || q || '"' END || ',"route":"' || route || '"' || CASE WHEN c THEN ',"confirmed":"CLINICIAN"' ELSE '' END || ',"overridden":' || CASE WHEN c AND route <> 'CLINICIAN' THEN 'true' ELSE 'false' END || '}}' AS line FROM t WHERE role = 'assistant' AND route IS NOT NULL""",
    "join_route_override": f"SELECT message_id, message_id % 3 = 0 AND message_id % 4 <> 3 AS overridden FROM ({_TURNS})",
    "st_provisional_route": """WITH RECURSIVE e AS (SELECT event_id // 10 AS stream_id, event_id % 10 * 37 + user_id % 5 AS at_ms, CASE event_type WHEN 'view' THEN 'CLINICIAN' WHEN 'error' THEN 'EMERGENCY' ELSE 'UNCLEAR' END AS route FROM events),
n AS (SELECT a.stream_id, a.at_ms, min(b.at_ms) AS next FROM e a LEFT JOIN e b ON b.stream_id = a.stream_id AND b.at_ms >= a.at_ms + 100 GROUP BY ALL),
l AS (SELECT stream_id, min(at_ms) AS at_ms FROM e GROUP BY stream_id UNION ALL SELECT l.stream_id, next FROM l JOIN n USING (stream_id, at_ms) WHERE next IS NOT NULL)
SELECT stream_id, route, at_ms FROM l JOIN e USING (stream_id, at_ms) WHERE route <> 'UNCLEAR' QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY at_ms) = 1""",
    "rag_pin_check": f"SELECT message_id, message_id % 6 >= 3 AND message_id % 5 <> 0 AS matches FROM ({_TURNS})",
    "rag_citation_row": """SELECT page_id, substr(url, 1, 20) || CASE WHEN page_id % 2 = 0 THEN ' · A > B' ELSE '' END AS head,
concat_ws(' · ', coalesce(CASE WHEN regexp_matches(u, '(?i)^https://[^/\\s?#]+') THEN u END, CASE WHEN page_id % 4 = 0 THEN 'https://a.example/x' END), CASE WHEN page_id % 5 = 0 THEN 'as at 2024-05-01' END) AS tail FROM (SELECT *, trim(CASE WHEN page_id % 3 = 0 THEN replace(url, 'http:', 'https:') ELSE url END) AS u FROM pages)""",
    "rag_messages": """SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'system=S' ELSE 'system=S!;assistant=G' END || ';' || string_agg(role || '=' || substr(coalesce(text, ''), 1, 5), ';' ORDER BY turn) AS wire FROM conversations GROUP BY conv_id""",
    "lookup_turn": f"""SELECT message_id, CASE WHEN message_id % 13 = 0 THEN 'crisis' WHEN message_id % 7 = 0 THEN 'wrong_pack' WHEN message_id % 5 = 1 THEN 'offer' WHEN message_id % 5 = 0 THEN 'refuse' WHEN length(coalesce(text, '')) >= 400 THEN 'over_budget' ELSE 'guard' END AS step FROM ({_TURNS})""",
}
