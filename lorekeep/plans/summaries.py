"""Queries for the summaries, window rules and set checks, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import summaries as S
from lorekeep.session import table

#: Families of words for the score query; a caller brings its own.
FAMILIES = {"articles": ["the", "der", "le"], "links": ["and", "und", "et"], "places": ["in", "on", "en"]}
EDGE = r"[^\p{L}\p{N}_]"
LEXICON = {k: [rf"(?i)(?:^|{EDGE}){w}(?:{EDGE}|$)" for w in v] for k, v in FAMILIES.items()}


def _family_scores(s, d):
    docs = table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    title = F.substring_index("t", "\n", 1)
    return S.family_scores(docs, "doc_id", title, F.substring(F.col("t"), F.length(title) + 1, F.length("t")), LEXICON)


def _one(word: str) -> str:
    p = f"'(?:^|{EDGE}){word}(?:{EDGE}|$)', 'i'"
    return f"CASE WHEN regexp_matches(title, {p}) THEN 2 WHEN regexp_matches(lede, {p}) THEN 1 ELSE 0 END"


FAMILY_SQL = (
    "WITH p AS (SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) AS title, substr(coalesce(text, ''), length(split_part(coalesce(text, ''), chr(10), 1)) + 1) AS lede FROM documents), f AS ("
    + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS family, ({' + '.join(map(_one, v))})::INTEGER AS score FROM p" for k, v in FAMILIES.items())
    + ") SELECT * FROM f WHERE score >= 2"
)


def _split_counts(s, d):
    rows = table(s, d, "labels").select(T.hash_split("seed", F.col("doc_id").cast("string")).alias("split"), (F.col("doc_id") % 100).alias("cluster"), "toxic")
    return S.split_counts(rows, "split", "cluster", F.col("toxic") == 1)


def _turns(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", "role", "text")


def _hits(s, d):
    rows = table(s, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("query"), "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return S.best_of_sections(rows, "query", ["l_suppkey", "l_linenumber"], [-F.col("l_extendedprice")], ["l_orderkey", "l_linenumber", "l_suppkey"], 20)


def _disjoint(s, d):
    """Whether the two halves of an item's words share none."""
    w = F.split(F.coalesce("text", F.lit("")), " ")
    half = F.floor(F.size(w) / 2).cast("int")
    return table(s, d, "benchmark").select("item_id", (~F.arrays_overlap(F.slice(w, F.lit(1), half), F.slice(w, half + 1, F.size(w)))).alias("disjoint"))


def _variants(s, d):
    return table(s, d, "part").select("p_partkey", F.array_join(S.variants([F.col("p_name"), F.lower("p_name"), F.col("p_type"), F.lower("p_type")]), "|").alias("variants"))


QUERIES = {
    "agg_section_counts": lambda s, d: S.section_counts(table(s, d, "documents"), "source", "n_chars"),
    "agg_pack_counts": lambda s, d: S.pack_counts(table(s, d, "orders").withColumnRenamed("o_orderkey", "doc"), table(s, d, "lineitem").withColumnRenamed("l_orderkey", "doc"), "o_orderpriority", "doc"),
    "agg_core_counts": lambda s, d: S.core_names(table(s, d, "part"), "p_name", F.col("p_size") <= 25),
    "agg_split_counts": _split_counts,
    "agg_cluster_attrs": lambda s, d: S.cluster_attributes(table(s, d, "part"), "p_brand", "p_type", "p_size").withColumn("names", F.array_join("names", "|")),
    "agg_family_scores": _family_scores,
    "agg_guard_summary": lambda s, d: S.guard_summary(_turns(s, d), "role", F.col("text").rlike("[0-9]"), F.length("text") > 100, F.length("text") < 40),
    "agg_max_core": lambda s, d: S.max_reading(table(s, d, "events").select("event_type", F.regexp_extract("props", r": *([^}]*)", 1).alias("r")), "event_type", "r"),
    "agg_doc_context": lambda s, d: S.titles_in_order(_turns(s, d), "conv_id", "role", "turn").withColumn("titles", F.array_join("titles", "|")),
    "win_date_heading": lambda s, d: S.date_headings(table(s, d, "events"), "user_id", "ts", "event_id"),
    "win_dedupe_first": _hits,
    "win_section_order": lambda s, d: S.section_order(table(s, d, "lineitem"), "l_suppkey", "l_returnflag", "l_orderkey"),
    "win_overlap_neighbours": lambda s, d: S.clear_of_neighbours(_turns(s, d), "conv_id", "turn", F.col("text").rlike("[0-9]")).drop("text"),
    "win_lead_in": lambda s, d: S.lead_ins(_turns(s, d), "conv_id", "turn", F.col("role") == "user", F.col("role") == "assistant").drop("text"),
    "win_running_condition": lambda s, d: S.running_condition(_turns(s, d), "conv_id", "turn", F.contains("text", F.lit("?"))).drop("text"),
    "sort_chats": lambda s, d: S.in_list_order(table(s, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal", (F.col("c_mktsegment") == "BUILDING").alias("pinned")), "c_nationkey", [F.desc("pinned"), F.desc("c_acctbal"), F.desc("c_custkey")]),
    "set_cover_check": lambda s, d: S.cover_gaps(table(s, d, "customer").select(F.col("c_custkey").alias("k")), table(s, d, "orders").select((F.col("o_custkey") * 2).alias("k")), "k"),
    "set_carry_forward": lambda s, d: S.carry_forward(table(s, d, "part").where("p_size <= 25"), table(s, d, "part").where("p_size > 25"), "p_name"),
    "set_keep_sweep": lambda s, d: S.sweep(table(s, d, "customer").select(F.col("c_custkey").alias("k"), "c_name"), table(s, d, "orders").select((F.col("o_custkey") * 2).alias("k")), "k"),
    "set_variants": _variants,
    "set_expect_disjoint": _disjoint,
}

ORACLE_SQL = {
    "agg_section_counts": "SELECT source, count(*) AS entries, count(*) FILTER (n_chars > 0) AS pages, coalesce(sum(n_chars), 0)::BIGINT AS bytes FROM documents GROUP BY source",
    "agg_pack_counts": "SELECT o_orderpriority, count(DISTINCT o_orderkey) AS docs, count(l_orderkey) AS chunks FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    "agg_core_counts": "SELECT p_name, count(*) AS n_pages, bool_or(p_size > 25) AS unscoped FROM part GROUP BY 1 HAVING bool_or(p_size > 25) OR count(*) >= 2",
    "agg_split_counts": """WITH u AS (SELECT *, ('0x' || substr(sha256('seed' || chr(0) || doc_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 AS u FROM labels)
SELECT CASE WHEN u < 0.7 THEN 'rows' WHEN u < 0.85 THEN 'probe' ELSE 'calibration' END AS split, count(DISTINCT doc_id % 100) AS clusters, count(*) AS entries, count(*) FILTER (toxic = 1) AS held_out FROM u GROUP BY 1""",
    "agg_cluster_attrs": """WITH b AS (SELECT p_brand, p_type, max(p_size) AS s FROM part GROUP BY ALL)
SELECT p_brand, string_agg(p_type, '|' ORDER BY p_type) AS names, max(s) AS score, first(p_type ORDER BY s DESC, p_type) AS hint FROM b GROUP BY 1""",
    "agg_family_scores": FAMILY_SQL,
    "agg_guard_summary": """WITH r AS (SELECT role, text, regexp_matches(text, '[0-9]') AS f FROM conversations)
SELECT role, count(*) AS total, count(*) FILTER (f) AS refused, count(*) FILTER (NOT f AND length(text) > 100) AS changed, count(*) FILTER (NOT f AND length(text) < 40) AS hidden FROM r GROUP BY 1""",
    "agg_max_core": "SELECT event_type, coalesce(max(TRY_CAST(regexp_extract(props, ': *([^}]*)', 1) AS BIGINT)), 0) AS reading FROM events GROUP BY 1",
    "agg_doc_context": "WITH f AS (SELECT conv_id, role, min(turn) AS o FROM conversations WHERE length(role) > 0 GROUP BY ALL) SELECT conv_id, string_agg(role, '|' ORDER BY o, role) AS titles FROM f GROUP BY 1",
    "win_date_heading": "SELECT user_id, ts::DATE::VARCHAR AS heading, first(event_id ORDER BY ts, event_id) AS at_message, count(*) AS messages FROM events GROUP BY 1, 2",
    "win_dedupe_first": """WITH h AS (SELECT l_returnflag || l_linestatus AS query, * FROM lineitem),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query, l_suppkey, l_linenumber ORDER BY l_extendedprice DESC, l_orderkey) = 1)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey)::INTEGER AS rank, l_orderkey, l_linenumber, l_suppkey FROM b QUALIFY rank <= 20""",
    "win_section_order": """WITH f AS (SELECT l_suppkey, l_returnflag, min(l_orderkey) AS first_chunk FROM lineitem GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY first_chunk, l_returnflag)::INTEGER AS section_rank FROM f""",
    "win_overlap_neighbours": """WITH f AS (SELECT *, coalesce(regexp_matches(text, '[0-9]'), false) AS f FROM conversations)
SELECT conv_id, turn, role, NOT (f OR coalesce(lag(f) OVER w, false) OR coalesce(lead(f) OVER w, false)) AS eligible FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "win_lead_in": """WITH i AS (SELECT *, max(CASE WHEN role <> 'assistant' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stop FROM conversations)
SELECT i.conv_id, i.turn, i.role, CASE WHEN i.role = 'assistant' AND s.role = 'user' THEN stop END AS lead_in FROM i LEFT JOIN conversations s ON s.conv_id = i.conv_id AND s.turn = stop""",
    "win_running_condition": "SELECT conv_id, turn, role, bool_or(coalesce(contains(text, '?'), false)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS under_condition FROM conversations",
    "sort_chats": """SELECT c_nationkey, c_custkey, c_acctbal, c_mktsegment = 'BUILDING' AS pinned,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment = 'BUILDING' DESC, c_acctbal DESC, c_custkey DESC)::INTEGER AS position FROM customer""",
    "set_cover_check": """SELECT coalesce(c_custkey, o_custkey) AS k, CASE WHEN o_custkey IS NULL THEN 'left' ELSE 'right' END AS only_in
FROM (SELECT DISTINCT c_custkey FROM customer) FULL JOIN (SELECT DISTINCT o_custkey * 2 AS o_custkey FROM orders) ON c_custkey = o_custkey WHERE c_custkey IS NULL OR o_custkey IS NULL""",
    "set_carry_forward": "SELECT p_name, count(*) FILTER (p_size <= 25) AS carried, count(*) FILTER (p_size > 25) AS new, count(*) > 1 AS conflict FROM part GROUP BY 1",
    "set_keep_sweep": "SELECT c_custkey AS k, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey * 2 FROM orders WHERE o_custkey IS NOT NULL)",
    "set_variants": "WITH n AS (SELECT p_partkey, [p_name, lower(p_name), p_type, lower(p_type)] AS l FROM part) SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: length(x) > 0 AND list_position(l, x) = i), '|') AS variants FROM n",
    "set_expect_disjoint": "WITH w AS (SELECT item_id, str_split(coalesce(text, ''), ' ') AS w FROM benchmark) SELECT item_id, NOT list_has_any(w[1:len(w) // 2], w[len(w) // 2 + 1:]) AS disjoint FROM w",
}
