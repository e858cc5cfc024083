"""Chat formatting: tool calls linked to their results, put in a topological order, validated and written as canonical JSON.

Input: one row per message (conv_id, turn, role, content, tool_calls, tool_call_id) and a registry of tool parameters. Only DataFrame
functions are used:

1. Linking. Calls and results are each reduced to the first of their (conversation, id), before any join, and joined by that key. The key
   holds the call's id, so a conversation of any length is spread over all tasks.
2. Order. A call comes after its place in the conversation and after the results it waits for (`after`). A log that is already in order
   needs no more than one look at its dependencies; calls of conversations with a dependency that points forward are moved behind it round by round
   (place, then depth among calls at one place). Whatever waits for itself is marked `cyclic`.
3. Validation. Arguments are parsed as VARIANT and compared with the registry: missing, unknown and wrongly typed parameters.
4. JSON. A VARIANT object keeps its keys sorted, numbers without superfluous zeros and no white space: the canonical text.

One row per message with content, per call and per result. Nulls: a null conv_id or id links with nothing (`no_id`); null content gives no row for a
message that has calls and an empty string otherwise; null roles are written as "unknown"; null arguments are malformed. Repeated rows: a call or
result that is not at the first place of its id is a `duplicate`; rows that repeat a place are results of their own, and all count as first.
Ties of place are broken by kind (message, call, result). Empty input gives no rows. Extra columns are ignored."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, shared_dir, table

CALLS = "array<struct<id:string,name:string,arguments:string,after:array<string>>>"
#: Parameter types of the registry and the VARIANT types they admit (fixed values).
TYPES = {"string": "STRING", "integer": r"BIGINT|DECIMAL\(\d+,0\)", "number": "BIGINT|DECIMAL|DOUBLE", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY", "null": "VOID"}
RANK = {"message": 0, "call": 1, "result": 2}


def canonical(**fields: Column) -> Column:
    return F.to_json(F.to_variant_object(F.struct(*[c.alias(k) for k, c in fields.items()])))


def registry(tools: DataFrame) -> DataFrame:
    """name, params (map of parameter to type and required). Repeated parameters: the least type, required if any says so."""
    one = tools.where("name is not null and param is not null").groupBy("name", "param").agg(F.min("type").alias("type"), F.max(F.coalesce("required", F.lit(False))).alias("required"))
    return one.groupBy(F.col("name").alias("tool")).agg(F.map_from_entries(F.collect_list(F.struct("param", F.struct("type", "required")))).alias("params"))


def schema_errors(given: Column, params: Column) -> Column:
    """Sorted messages about the arguments (map of name to VARIANT) against a tool's parameters."""
    admits = F.create_map(*[x for k, v in TYPES.items() for x in (F.lit(k), F.lit(f"^({v})"))])
    wanted, entries = F.map_entries(params), F.map_entries(given)
    missing = F.transform(F.filter(wanted, lambda e: e["value"]["required"] & ~F.map_contains_key(given, e["key"])), lambda e: F.concat(F.lit("missing "), e["key"]))
    unknown = F.transform(F.filter(entries, lambda e: ~F.map_contains_key(params, e["key"])), lambda e: F.concat(F.lit("unknown "), e["key"]))
    typed = F.filter(entries, lambda e: F.coalesce(~F.regexp_like(F.schema_of_variant(e["value"]), F.element_at(admits, F.element_at(params, e["key"])["type"])), F.lit(False)))
    return F.array_sort(F.concat(missing, unknown, F.transform(typed, lambda e: F.concat(F.lit("type "), e["key"]))))


def ordered(units: DataFrame, edges: DataFrame) -> DataFrame:
    """conv_id, id, at (turn, part, depth), cyclic for every first call.

    units: conv_id, id, turn, part, result_turn; edges: conv_id, id, dep, one row each, both ends known. Calls of conversations in order keep their place. In the others, each round
    places the calls whose dependencies are all placed: as many rounds as the longest chain of calls has steps. What no round can place waits for itself, or for such a call: one look settles
    circles of any size. They are `cyclic` and keep their own place."""
    own = F.struct("turn", "part", F.lit(0).cast("long").alias("depth"))

    def done(at: Column, result_turn: Column) -> Column:
        answer = F.struct(result_turn.alias("turn"), F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("depth"))
        return F.when(result_turn.isNull(), at).otherwise(F.greatest(at, answer))

    state = units.select("conv_id", "id", own.alias("own"), "result_turn")
    ends = edges.join(state.select("conv_id", F.col("id").alias("dep"), done(F.col("own"), F.col("result_turn")).alias("free")).hint("shuffle_hash"), ["conv_id", "dep"])
    forward = ends.join(state.select("conv_id", "id", "own").hint("shuffle_hash"), ["conv_id", "id"]).where("free >= own").select("conv_id").distinct()
    forward = cut(forward, "forward")
    if forward.isEmpty():
        return state.select("conv_id", "id", F.col("own").alias("at"), F.lit(False).alias("cyclic"))
    links = cut(edges.join(forward, "conv_id", "left_semi"), "waits")
    counts = links.groupBy("conv_id", "id").agg(F.count("*").alias("deps"))
    live = state.join(forward, "conv_id", "left_semi").join(counts, ["conv_id", "id"], "left")
    live = cut(live.select("*", F.lit(None).cast("struct<turn:long,part:long,depth:long>").alias("free"), F.lit(0).cast("long").alias("met"), F.coalesce("deps", F.lit(0)).alias("open")), "order")
    waiting = live.where("open > 0")
    placed = live.where("open = 0").select("conv_id", "id", F.col("own").alias("at"), "result_turn")
    path, last = f"{shared_dir(state.sparkSession)}/placed-{uuid.uuid4().hex}", live
    while True:
        # rows of all rounds go to one table, so that a plan doesn't grow with the rounds, and a round's table goes when the next is written
        placed.select("conv_id", "id", "at", F.lit(False).alias("cyclic")).write.mode("append").parquet(path)
        freed = links.join(placed.select("conv_id", F.col("id").alias("dep"), done(F.col("at"), F.col("result_turn")).alias("now")), ["conv_id", "dep"]).groupBy("conv_id", "id").agg(F.max("now").alias("now"), F.count("*").alias("more"))
        new = waiting.join(freed, ["conv_id", "id"], "left")
        new = new.withColumn("free", F.greatest("free", "now")).withColumn("met", F.col("met") + F.coalesce("more", F.lit(0))).drop("now", "more")
        new = cut(new, "order")
        discard(last)
        last = new
        after = F.struct(F.col("free.turn").alias("turn"), F.col("free.part").alias("part"), (F.col("free.depth") + 1).alias("depth"))
        placed = new.where("met = open").select("conv_id", "id", F.greatest("own", after).alias("at"), "result_turn")
        waiting = new.where("met < open")
        if placed.isEmpty():
            break
    waiting.select("conv_id", "id", F.col("own").alias("at"), F.lit(True).alias("cyclic")).write.mode("append").parquet(path)
    inside = state.join(forward, "conv_id", "left_anti").select("conv_id", "id", F.col("own").alias("at"), F.lit(False).alias("cyclic"))
    return inside.unionByName(state.sparkSession.read.schema(inside.schema).parquet(path))


def format_chats(messages: DataFrame, tools: DataFrame) -> DataFrame:
    """conv_id, turn, part, kind, call_id, status, errors, order_turn, order_part, order_depth, order_kind, json.

    Sorted by conv_id and the four order columns (then turn, part), the rows of a conversation stand in topological order. Status of a call: no_id,
    duplicate, malformed, unknown_tool, invalid, cyclic, unanswered or ok; of a result: no_id, orphan, duplicate, early (before its call) or ok; of a
    message: ok."""
    m = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.col("content").cast("string").alias("content"), F.col("tool_calls").cast(CALLS).alias("tool_calls"), F.col("tool_call_id").cast("string").alias("tool_call_id"))
    zero = F.lit(0).cast("long")
    plain = m.where((F.col("role") != "tool") & (F.col("content").isNotNull() | (F.coalesce(F.size("tool_calls"), F.lit(0)) <= 0)))
    plain = plain.select("conv_id", "turn", zero.alias("part"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit("ok").alias("status"), F.lit("").alias("errors"), F.struct("turn", zero.alias("part"), zero.alias("depth")).alias("at"), canonical(content=F.coalesce("content", F.lit("")), role=F.col("role")).alias("json"))

    # calls and results of a message as rows of one table: one pass, one aggregation by identifier
    unit = F.struct(F.lit("call").alias("kind"), F.lit(None).cast("long").alias("part"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), F.lit(None).cast("array<string>").alias("after"))
    asked = F.transform("tool_calls", lambda x, i: F.struct(F.lit("call").alias("kind"), (i + 1).cast("long").alias("part"), x["id"].alias("id"), x["name"].alias("name"), x["arguments"].alias("arguments"), x["after"].alias("after")))
    reply = F.array(F.struct(F.lit("result").alias("kind"), zero.alias("part"), F.col("tool_call_id").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), F.lit(None).cast("array<string>").alias("after")))
    none = F.filter(F.array(unit), lambda x: F.lit(False))
    units = m.select("conv_id", "turn", "content", F.explode(F.concat(F.coalesce(asked, none), F.when(F.col("role") == "tool", reply).otherwise(none))).alias("u")).select("conv_id", "turn", "content", "u.*")
    known = "conv_id is not null and id is not null"
    is_call = F.col("kind") == "call"
    by_id = units.where(known).groupBy("conv_id", "id").agg(F.min(F.when(is_call, F.struct("turn", "part"))).alias("first"), F.min(F.when(~is_call, F.col("turn"))).alias("result_turn"), F.bool_or(~is_call).alias("answered"))
    by_id = cut(by_id.where("first is not null").select("conv_id", "id", F.col("first.turn").alias("turn"), F.col("first.part").alias("part"), "result_turn", "answered"), "units")
    edges = units.where(known).where(is_call).select("conv_id", "id", F.explode("after").alias("dep")).where("dep is not null").distinct()
    edges = cut(edges.join(by_id.select("conv_id", F.col("id").alias("dep")).hint("shuffle_hash"), ["conv_id", "dep"], "left_semi"), "edges")
    place = ordered(by_id, edges).join(by_id.select("conv_id", "id", F.col("turn").alias("first_turn"), F.col("part").alias("first_part"), "result_turn", "answered").hint("shuffle_hash"), ["conv_id", "id"])
    place = cut(place, "linked")

    # the link itself: a hash join by (conversation, identifier); the registry is a small table of tools
    c = units.join(place.hint("shuffle_hash"), ["conv_id", "id"], "left").join(registry(tools), is_call & (F.col("name") == F.col("tool")), "left")
    c = c.withColumn("parsed", F.try_parse_json("arguments")).withColumn("given", F.expr("try_cast(parsed as map<string,variant>)"))
    c = c.withColumn("given", F.when(F.schema_of_variant("parsed").startswith("OBJECT"), F.col("given")))
    c = c.withColumn("found", F.when(is_call, F.coalesce(schema_errors(F.col("given"), F.col("params")), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))
    later = (F.col("turn") != F.col("first_turn")) | (F.col("part") != F.col("first_part"))
    call_status = (
        F.when(F.col("conv_id").isNull() | F.col("id").isNull(), "no_id").when(later, "duplicate").when(F.col("given").isNull(), "malformed").when(F.col("params").isNull(), "unknown_tool")
        .when(F.size("found") > 0, "invalid").when(F.col("cyclic"), "cyclic").when(~F.col("answered"), "unanswered").otherwise("ok")
    )
    result_status = (
        F.when(F.col("conv_id").isNull() | F.col("id").isNull(), "no_id").when(F.col("at").isNull(), "orphan")
        .when(F.col("turn") != F.col("result_turn"), "duplicate").when(F.col("turn") < F.col("first_turn"), "early").otherwise("ok")
    )
    here = F.struct("turn", "part", zero.alias("depth"))
    at = F.when(F.col("at").isNull() | (is_call & later), here).when(is_call, F.col("at")).otherwise(F.greatest(here, "at"))
    call_text = canonical(arguments=F.coalesce("parsed", F.to_variant_object(F.struct(F.col("arguments").alias("malformed")))), id=F.col("id"), name=F.col("name"))
    result_text = canonical(content=F.coalesce("content", F.lit("")), role=F.lit("tool"), tool_call_id=F.col("id"))
    c = c.select("conv_id", "turn", "part", "kind", F.col("id").alias("call_id"), F.when(is_call, call_status).otherwise(result_status).alias("status"), F.array_join("found", "; ").alias("errors"), at.alias("at"), F.when(is_call, call_text).otherwise(result_text).alias("json"))
    out = plain.unionByName(c)
    kind = F.create_map(*[x for k, v in RANK.items() for x in (F.lit(k), F.lit(v))])
    return out.select("conv_id", "turn", "part", "kind", "call_id", "status", "errors", F.col("at.turn").alias("order_turn"), F.col("at.part").alias("order_part"), F.col("at.depth").alias("order_depth"), kind[F.col("kind")].alias("order_kind"), "json")


def exchanges(conversations: DataFrame) -> DataFrame:
    """The messages of a table of plain turns (conv_id, turn, role, text), which knows no tools: each assistant turn is read as a call of the tool `reply`
    with the user's turn before it as request, and its text as that call's result.

    A reply waits for the one two turns earlier; at turns 1, 7, 13 ... for the one two turns later instead, and turn 3 of every 17th conversation for turn 1, a circle. The logs have
    the faults of real ones: broken arguments (conversations 3 mod 11), an unregistered tool (5 mod 13), a wrong type (6 mod 19), results of no call (2 mod 7), repeated
    results one turn later (1 mod 5), calls never answered (8 mod 23)."""
    c = conversations.select("conv_id", "turn", "role", "text")
    k, t = F.col("conv_id"), F.col("turn")
    asked = c.where("role = 'user'").groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.min("text").alias("request"))
    name = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    none = F.lit(None)
    said = c.where("role <> 'assistant' or role is null").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("content"), none.cast(CALLS).alias("tool_calls"), none.cast("string").alias("tool_call_id"))
    reply = c.where("role = 'assistant'")
    whole = F.to_json(F.struct(F.when(k % 19 != 6, t.cast("string")).otherwise("x").alias("turn"), F.col("request")))
    arguments = F.when(k % 11 == 3, F.lit('{"turn":')).otherwise(F.when(k % 19 == 6, whole).otherwise(F.to_json(F.struct(F.col("turn"), F.col("request")))))
    after = F.when((k % 17 == 4) & (t == 3), F.array(name(t - 2))).when(t % 6 == 1, F.array(name(t + 2))).when(t >= 3, F.array(name(t - 2))).otherwise(F.array().cast("array<string>"))
    call = F.array(F.struct(name(t).alias("id"), F.when(k % 13 == 5, "other").otherwise("reply").alias("name"), arguments.alias("arguments"), after.alias("after")))
    called = reply.join(asked, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", none.cast("string").alias("content"), call.cast(CALLS).alias("tool_calls"), none.cast("string").alias("tool_call_id"))
    results = F.array(
        F.when(k % 23 != 8, F.struct(t.alias("turn"), name(t).alias("id"))), F.when((k % 5 == 1) & (k % 23 != 8), F.struct((t + 1).alias("turn"), name(t).alias("id"))), F.when(k % 7 == 2, F.struct(t.alias("turn"), F.concat(F.lit("x-"), name(t)).alias("id")))
    )
    answered = reply.select("conv_id", "text", F.explode(F.array_compact(results)).alias("r")).select("conv_id", F.col("r.turn").alias("turn"), F.lit("tool").alias("role"), F.col("text").alias("content"), none.cast(CALLS).alias("tool_calls"), F.col("r.id").alias("tool_call_id"))
    return said.unionByName(called).unionByName(answered)


def reply_tool(spark: SparkSession) -> DataFrame:
    return spark.sql("select * from values ('reply', 'turn', 'integer', true), ('reply', 'request', 'string', true) as t(name, param, type, required)")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(exchanges(table(spark, sf_dir, "conversations")), reply_tool(spark))


SQL = r"""
WITH RECURSIVE c AS (SELECT conv_id AS k, turn AS t, coalesce(role, 'unknown') AS role, text FROM conversations),
asked AS (SELECT k, t + 1 AS t, min(text) AS request FROM c WHERE role = 'user' GROUP BY ALL),
calls AS (SELECT c.k, c.t, 'c' || c.k || '-' || c.t AS id, request, text, CASE WHEN k % 17 = 4 AND t = 3 THEN t - 2 WHEN t % 6 = 1 THEN t + 2 WHEN t >= 3 THEN t - 2 END AS dep FROM c LEFT JOIN asked USING (k, t) WHERE role = 'assistant'),
u AS (SELECT a.*, b.t AS d, CASE WHEN a.k % 23 <> 8 THEN 1 END AS answered FROM calls a LEFT JOIN calls b ON b.k = a.k AND b.t = a.dep),
w AS (SELECT k, t, answered, t AS ot, 1::BIGINT AS op, 0::BIGINT AS od FROM u WHERE d IS NULL
  UNION ALL SELECT u.k, u.t, u.answered, CASE WHEN f THEN w.ot ELSE u.t END, CASE WHEN f THEN w.op ELSE 1 END, CASE WHEN f THEN w.od + 1 ELSE 0 END FROM (SELECT *, 0 AS z FROM u) u JOIN w ON w.k = u.k AND w.t = u.d, LATERAL (SELECT (w.ot, w.op, w.od + 1) > (u.t, 1, 0) AS f)),
pl AS (SELECT u.*, coalesce(ot, u.t) AS ot, coalesce(op, 1) AS op, coalesce(od, 0) AS od, w.k IS NULL AS cyclic FROM u LEFT JOIN w ON w.k = u.k AND w.t = u.t),
rs AS (SELECT *, t AS rt, id AS rid, 'ok' AS st FROM pl WHERE k % 23 <> 8 UNION ALL SELECT *, t + 1, id, 'duplicate' FROM pl WHERE k % 5 = 1 AND k % 23 <> 8 UNION ALL SELECT *, t, 'x-' || id, 'orphan' FROM pl WHERE k % 7 = 2),
r AS (SELECT k, t, 0::BIGINT AS part, 'message' AS kind, NULL::VARCHAR AS call_id, 'ok' AS status, '' AS errors, t AS ot, 0::BIGINT AS op, 0::BIGINT AS od, 0::INTEGER AS order_kind, json_object('content', coalesce(text, ''), 'role', role)::VARCHAR AS json FROM c WHERE role <> 'assistant'
UNION ALL SELECT k, t, 1, 'call', id,
  CASE WHEN k % 11 = 3 THEN 'malformed' WHEN k % 13 = 5 THEN 'unknown_tool' WHEN k % 19 = 6 OR request IS NULL THEN 'invalid' WHEN cyclic THEN 'cyclic' WHEN answered IS NULL THEN 'unanswered' ELSE 'ok' END,
  CASE WHEN k % 11 = 3 OR k % 13 = 5 THEN '' ELSE concat_ws('; ', CASE WHEN request IS NULL THEN 'missing request' END, CASE WHEN k % 19 = 6 THEN 'type turn' END) END, ot, op, od, 1,
  json_object('arguments', CASE WHEN k % 11 = 3 THEN json_object('malformed', '{"turn":') WHEN k % 19 = 6 THEN CASE WHEN request IS NULL THEN json_object('turn', 'x') ELSE json_object('request', request, 'turn', 'x') END
    WHEN request IS NULL THEN json_object('turn', t) ELSE json_object('request', request, 'turn', t) END, 'id', id, 'name', CASE WHEN k % 13 = 5 THEN 'other' ELSE 'reply' END)::VARCHAR FROM pl
UNION ALL SELECT k, rt, 0, 'result', rid, st, '', CASE WHEN g THEN ot ELSE rt END, CASE WHEN g THEN op ELSE 0 END, CASE WHEN g THEN od ELSE 0 END, 2, json_object('content', coalesce(text, ''), 'role', 'tool', 'tool_call_id', rid)::VARCHAR FROM (SELECT *, st <> 'orphan' AND (ot, op, od) > (rt, 0, 0) AS g FROM rs))
SELECT k AS conv_id, t AS turn, part, kind, call_id, status, errors, ot AS order_turn, op AS order_part, od AS order_depth, order_kind, json FROM r
"""
