"""The package's queries over the given tables and their SQL.

The tables hold no packs, titles or token streams; each query says which rows stand for them. Queries without SQL: close spellings (no
engine here has the restricted edit distance) and page blocks (an HTML parser)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import stem
from lorekeep.functions import text as T
from lorekeep.functions import vectors as V
from lorekeep.operators import analytics, conversation, lookup, retrieval, tokens
from lorekeep.operators.textindex import TextIndex
from lorekeep.plans import entities, functions, messages, packs, replies, selection, summaries
from lorekeep.plans import sources as documents
from lorekeep.session import spread, table
from lorekeep.sources import text as sources

WATCH = tokens.Watch(baseline=8, window=4, sustained=3)


def _sql_norm(x: str) -> str:
    out = f"translate(lower({x}), '{T.FOLD_FROM}', '{T.FOLD_TO}')"
    for one, two in T.FOLD_TWO.items():
        out = f"replace({out}, '{one}', '{two}')"
    bare = rf"regexp_replace({out}, '[''’‘ʼ]s([^\p{{L}}\p{{N}}]|$)', '\1', 'g')"
    return rf"trim(regexp_replace({bare}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def _sql_terms(x: str) -> str:
    out = f"translate(lower({x}), '{T.FOLD_FROM}', '{T.FOLD_TO}')"
    for one, two in T.FOLD_TWO.items():
        out = f"replace({out}, '{one}', '{two}')"
    return rf"regexp_extract_all({out}, '[\p{{L}}\p{{N}}]+')"


# --- text -------------------------------------------------------------------------------------------------------------------


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of documents as titles."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("title"))
    return d.select("doc_id", T.normalise_title(F.col("title")).alias("normalised"), T.slugify(F.col("title")).alias("slug"))


TITLES_SQL = f"WITH d AS (SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) AS t FROM documents) SELECT doc_id, {_sql_norm('t')} AS normalised, replace({_sql_norm('t')}, ' ', '-') AS slug FROM d"


def text_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    return d.select("doc_id", F.round(T.extraction_quality(text), 9).alias("quality"), T.est_tokens(F.col("text")).alias("tokens"), T.fingerprint(F.col("text")).alias("fingerprint"), T.hash_split("seed", F.col("doc_id").cast("string")).alias("split"))


TEXT_FACTS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
h AS (SELECT *, ('0x' || substr(sha256('seed' || chr(0) || doc_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 AS u FROM d)
SELECT doc_id, CASE WHEN length(t) > 0 THEN round((length(t) - len(regexp_extract_all(t, '[\x00-\x08\x0E-\x1F\x7F-\x84\x{86}-\x{9F}\x{FFFD}]'))) / length(t), 9) ELSE 1.0 END AS quality,
  (ceil(length(t) / 3.5) + 4)::BIGINT AS tokens, substr(sha256(t), 1, 12) AS fingerprint, CASE WHEN u < 0.7 THEN 'rows' WHEN u < 0.85 THEN 'probe' ELSE 'calibration' END AS split FROM h
"""


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences at line ends close a paragraph."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(".\n"), F.lit(".\n\n")).alias("text"))
    return sources.paragraphs(d)


PARAGRAPHS_SQL = r"""
WITH d AS (SELECT doc_id, string_split(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS line FROM d),
y AS (SELECT *, trim(regexp_replace(line, '\s+', ' ', 'g')) = '' AS blank FROM x),
z AS (SELECT *, sum(blank::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM y)
SELECT doc_id, min(pos)::INTEGER AS first_line, max(pos)::INTEGER AS last_line, string_agg(line, chr(10) ORDER BY pos) AS text FROM z WHERE NOT blank GROUP BY doc_id, island
"""


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.html_blocks(table(spark, sf_dir, "pages"))


# --- retrieval --------------------------------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every 100th vector is a query; all are chunks in packs by label."""
    e = table(spark, sf_dir, "embeddings")
    q = retrieval.quantized(e.where("vec_id % 100 = 0").select("vec_id", "embedding"), "vec_id", "query_id")
    v = retrieval.quantized(e.select("vec_id", "embedding", F.col("label").cast("string").alias("pack_id")), "vec_id", "chunk_id")
    return q, v


_QUANT = """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS d FROM embeddings),
n AS (SELECT *, sqrt(list_sum(list_transform(d, lambda x: x * x))) AS n FROM e),
z AS (SELECT vec_id, label, n, list_transform(d, lambda x: greatest(-127, least(127, round((CASE WHEN n = 0 THEN 0 ELSE x / n END) * 127)))::INTEGER) AS v FROM n)"""


def quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = retrieval.quantized(table(spark, sf_dir, "embeddings"), "vec_id", "vec_id")
    return e.select("vec_id", F.array_join(F.col("q").cast("array<string>"), ",").alias("q"), V.dot_int8(F.col("q"), F.col("q")).cast("long").alias("norm"))


QUANTIZE_SQL = _QUANT + " SELECT vec_id, array_to_string(v, ',') AS q, list_sum(list_transform(v, lambda x: x * x))::BIGINT AS norm FROM z"


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, v = _vectors(spark, sf_dir)
    return retrieval.dense_topk(q, v).select("query_id", "pack_id", "chunk_id", F.col("distance").cast("long").alias("distance"), F.round(F.col("dense_cosine").cast("double"), 6).alias("dense_cosine"), "rank")


_DENSE = (
    _QUANT
    + """,
p AS (SELECT q.vec_id AS query_id, c.label::VARCHAR AS pack_id, c.vec_id AS chunk_id, list_sum(list_transform(list_zip(c.v, q.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS distance,
  greatest(-1.0, least(1.0, list_sum(list_transform(list_zip(c.v, q.v), lambda x: x[1] * x[2])) / 16129.0))::FLOAT::DOUBLE AS cos FROM z q, z c WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, pack_id ORDER BY distance, chunk_id)::INTEGER AS rank FROM p),
top AS (SELECT * FROM r WHERE rank <= 20)"""
)
DENSE_SQL = _DENSE + " SELECT query_id, pack_id, chunk_id, distance, round(cos, 6) AS dense_cosine, rank FROM top"


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, v = _vectors(spark, sf_dir)
    return retrieval.pack_gate(retrieval.dense_topk(q, v))


_GATES = (
    _DENSE
    + """,
o AS (SELECT *, count(*) OVER (PARTITION BY query_id, pack_id) AS n, row_number() OVER (PARTITION BY query_id, pack_id ORDER BY cos DESC, chunk_id) AS rn FROM {src}),
g AS (SELECT query_id, pack_id, max(n) AS n, max(cos) AS top1, max(CASE WHEN rn = least(10, n) THEN cos END) AS at10 FROM o GROUP BY ALL)"""
)
GATES_SQL = _GATES.replace("{src}", "top") + " SELECT query_id, pack_id, n, round(top1, 6) AS top1, round(at10, 6) AS at10, top1 >= 0.3 AND (n = 1 OR top1 - at10 >= 0.1) AS passed FROM g"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct terms of five letters or more of each benchmark item."""
    t = F.array_distinct(F.filter(T.terms(F.coalesce("text", F.lit(""))), lambda w: F.char_length(w) >= 5))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), t.alias("terms"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("pack_id"), F.col("doc_id").alias("chunk_id"), "text")


_INDEXES: dict[tuple[str, str], TextIndex] = {}


def _index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The index over the documents in packs by source, built by the first query of a session that asks and opened by the others."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = TextIndex.build(spread(_chunks(spark, sf_dir)))
    return _INDEXES[key]


def bm25_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).search(_asked(spark, sf_dir), retrieval.LANE_K)


def bm25_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).search(_asked(spark, sf_dir), retrieval.LANE_K, all_terms=False)


_BM25 = f"""
asked0 AS (SELECT item_id AS query_id, unnest(ts) AS word FROM (SELECT item_id, {_sql_terms('text')} AS ts FROM benchmark)),
c AS (SELECT source AS pack_id, doc_id AS chunk_id, {_sql_terms('text')} AS ts FROM documents),
words AS (SELECT pack_id, chunk_id, len(ts) AS len, unnest(ts) AS word FROM c),
vocabulary AS (SELECT word FROM words UNION SELECT word FROM asked0),
{stem.stems_sql('stems', 'vocabulary')},
asked1 AS (SELECT DISTINCT query_id, w AS term FROM asked0 JOIN stems USING (word) WHERE length(word) >= 5),
asked AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n_terms FROM asked1),
st AS (SELECT pack_id, count(*) AS n, avg(len(ts)) AS avgdl FROM c WHERE ts IS NOT NULL GROUP BY pack_id),
po AS (SELECT pack_id, chunk_id, len, w AS term, count(*) AS tf FROM words JOIN stems USING (word) GROUP BY ALL),
dfs AS (SELECT pack_id, term, count(*) AS df FROM po GROUP BY ALL),
sc AS (SELECT query_id, po.pack_id, chunk_id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))), 6) AS score, count(*) AS n_hit, max(n_terms) AS n_terms
  FROM asked JOIN po USING (term) JOIN dfs ON dfs.pack_id = po.pack_id AND dfs.term = po.term JOIN st ON st.pack_id = po.pack_id GROUP BY ALL),
"""
_RANKED = "SELECT query_id, pack_id, chunk_id, score, row_number() OVER (PARTITION BY query_id, pack_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM sc"
BM25_ALL_SQL = f"WITH {_BM25} lx AS ({_RANKED} WHERE n_hit = n_terms) SELECT * FROM lx WHERE rank <= 20"
BM25_ANY_SQL = f"WITH {_BM25} lx AS ({_RANKED}) SELECT * FROM lx WHERE rank <= 20"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval: chunks are documents in packs by source, with the vector of the same id if there is one; the query k has the terms of
    benchmark item k and the vector 100 k."""
    e = table(spark, sf_dir, "embeddings")
    asked = _asked(spark, sf_dir)
    q = retrieval.quantized(e.where("vec_id % 100 = 0").select((F.col("vec_id") / 100).cast("long").alias("query_id"), "embedding"), "query_id", "query_id").join(asked.select("query_id"), "query_id", "left_semi")
    chunks = _chunks(spark, sf_dir)
    v = retrieval.quantized(e.select("vec_id", "embedding"), "vec_id", "chunk_id").join(chunks.select("chunk_id", "pack_id"), "chunk_id")
    dense = retrieval.dense_topk(q, v)
    lexical = _index(spark, sf_dir).search(asked.join(q.select("query_id"), "query_id", "left_semi"), retrieval.LANE_K)
    both = retrieval.fuse(dense, lexical, v, q)
    sections = chunks.select("chunk_id", F.col("chunk_id").alias("doc_id"), F.lit("").alias("section_path"))
    return retrieval.assemble(q, both, retrieval.pack_gate(both, margin=0.05), sections)


FLAGSHIP_SQL = (
    _QUANT
    + f""", {_BM25}
qs AS (SELECT vec_id // 100 AS query_id, v FROM z WHERE vec_id % 100 = 0 AND vec_id // 100 IN (SELECT item_id FROM benchmark)),
vs AS (SELECT vec_id AS chunk_id, v, pack_id FROM z JOIN c ON vec_id = chunk_id),
dl AS (SELECT query_id, pack_id, chunk_id, row_number() OVER (PARTITION BY query_id, pack_id ORDER BY list_sum(list_transform(list_zip(vs.v, qs.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), chunk_id) AS rank FROM qs, vs),
lx AS ({_RANKED} WHERE n_hit = n_terms AND query_id IN (SELECT query_id FROM qs)),
fu AS (SELECT query_id, pack_id, chunk_id, round(sum(1 / (60.0 + rank)), 12) AS f FROM (SELECT * FROM dl WHERE rank <= 20 UNION ALL SELECT query_id, pack_id, chunk_id, rank FROM lx WHERE rank <= 20) GROUP BY ALL),
ca AS (SELECT fu.*, coalesce(greatest(-1.0, least(1.0, list_sum(list_transform(list_zip(vs.v, qs.v), lambda x: x[1] * x[2])) / 16129.0))::FLOAT, 0)::DOUBLE AS cos FROM fu JOIN qs USING (query_id) LEFT JOIN (SELECT chunk_id, v FROM vs) vs USING (chunk_id)),
o AS (SELECT *, count(*) OVER (PARTITION BY query_id, pack_id) AS n, row_number() OVER (PARTITION BY query_id, pack_id ORDER BY cos DESC, chunk_id) AS rn FROM ca),
g AS (SELECT query_id, pack_id, max(n) AS n, max(cos) AS top1, max(CASE WHEN rn = least(10, n) THEN cos END) AS at10 FROM o GROUP BY ALL),
li AS (SELECT ca.*, row_number() OVER (PARTITION BY query_id, pack_id ORDER BY f DESC, chunk_id) AS rank FROM ca JOIN g USING (query_id, pack_id) WHERE g.top1 >= 0.3 AND (g.n = 1 OR g.top1 - g.at10 >= 0.05)),
fi AS (SELECT query_id, pack_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, pack_id, chunk_id)::INTEGER AS n FROM li)
SELECT query_id, CASE WHEN fi.chunk_id IS NULL THEN 'no_evidence' ELSE 'grounded' END AS status, fi.n, fi.pack_id, fi.chunk_id FROM qs LEFT JOIN (SELECT * FROM fi WHERE n <= 3) fi USING (query_id)
"""
)


# --- lookup -----------------------------------------------------------------------------------------------------------------


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as titled pages with a variant each."""
    p = spread(table(spark, sf_dir, "part"))
    key = F.col("p_partkey").cast("string")
    return p.select(F.col("p_partkey").alias("doc_id"), F.concat_ws(" ", "p_name", key).alias("title"), F.lit(None).cast("string").alias("slug"), F.array(F.concat_ws(" ", "p_brand", "p_type", key)).alias("variants"))


def lookup_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact titles in other spelling, variants, names that many titles contain, and nonsense."""
    p = table(spark, sf_dir, "part").where("p_partkey % 100 = 0")
    key = F.col("p_partkey").cast("string")
    asked = [F.upper(F.concat_ws("-", "p_name", key)), F.concat_ws("  ", "p_brand", "p_type", key), F.col("p_name"), F.concat(F.lit("zq"), F.repeat(key, 9))]
    return lookup.lookup(p.select(F.explode(F.array(*asked)).alias("query")), _parts(spark, sf_dir))


LOOKUP_SQL = f"""
WITH pk AS (SELECT p_partkey AS doc_id, p_name || ' ' || p_partkey AS title, 0 AS tier, {_sql_norm("p_name || ' ' || p_partkey")} AS key FROM part
  UNION ALL SELECT p_partkey, p_name || ' ' || p_partkey, 2, {_sql_norm("p_brand || ' ' || p_type || ' ' || p_partkey")} FROM part),
q AS (SELECT DISTINCT query, {_sql_norm('query')} AS q FROM (SELECT unnest([upper(p_name || '-' || p_partkey), p_brand || '  ' || p_type || '  ' || p_partkey, p_name, 'zq' || repeat(p_partkey::VARCHAR, 9)]) AS query FROM part WHERE p_partkey % 100 = 0)),
ex AS (SELECT query, 'exact' AS how, doc_id, title, 0 AS r1, 0 AS r2 FROM q JOIN pk ON q = key),
co AS (SELECT query, 'contained' AS how, doc_id, title, min(tier) AS r1, length(title) AS r2 FROM q JOIN pk ON contains(' ' || key || ' ', ' ' || q || ' ') WHERE query NOT IN (SELECT query FROM ex) GROUP BY ALL),
al AS (SELECT *, count(*) OVER (PARTITION BY query) AS pages, row_number() OVER (PARTITION BY query ORDER BY r1, r2, {_sql_norm('title')}, doc_id) AS rn FROM (SELECT * FROM ex UNION ALL SELECT * FROM co)),
o AS (SELECT query, how, max(pages) AS pages, arg_min(doc_id, rn) AS doc_id, string_agg(title, '|' ORDER BY rn) FILTER (rn <= 5) AS titles FROM al GROUP BY ALL)
SELECT query, CASE WHEN pages IS NULL THEN 'not_found' WHEN pages = 1 THEN 'found' ELSE 'did_you_mean' END AS outcome, how, CASE WHEN pages = 1 THEN doc_id END AS doc_id, titles FROM q LEFT JOIN o USING (query)
"""


def lookup_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with two neighbouring letters swapped."""
    p = table(spark, sf_dir, "part").where("p_partkey % 100 = 0")
    name = F.concat(F.substring("p_name", 2, 1), F.substring("p_name", 1, 1), F.substring("p_name", 3, 99))
    return lookup.lookup(p.select(F.concat_ws(" ", name, F.col("p_partkey").cast("string")).alias("query")), _parts(spark, sf_dir))


# --- conversations ----------------------------------------------------------------------------------------------------------


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def last_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.last_user(_said(spark, sf_dir))


LAST_USER_SQL = """
SELECT conv_id, turn, asked FROM (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked FROM conversations) WHERE role = 'assistant'
"""


def context_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.context_suffix(_said(spark, sf_dir), n_ctx=1024)


CONTEXT_SQL = """
SELECT conv_id, turn, tokens, used FROM (SELECT conv_id, turn, tokens, sum(tokens) OVER w::BIGINT AS used, row_number() OVER w AS rn FROM (SELECT *, (ceil(length(coalesce(text, '')) / 3.5) + 4)::BIGINT AS tokens FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC))
WHERE used <= 1024 - 512 - 128 - 8 OR rn = 1
""".replace("sum(tokens) OVER w::BIGINT", "(sum(tokens) OVER w)::BIGINT")


def chat_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.export_text(_said(spark, sf_dir))


EXPORT_SQL = """
SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'You' WHEN 'assistant' THEN 'Assistant' WHEN 'system' THEN 'System' ELSE 'Other' END || ':' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS document FROM conversations GROUP BY conv_id
"""


def lookup_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.lookup_scope(_said(spark, sf_dir), F.char_length("text") < 60)


SCOPE_SQL = """
SELECT conv_id, turn, role, NOT (role = 'assistant' AND coalesce(lag(role = 'user' AND length(text) < 60) OVER (PARTITION BY conv_id ORDER BY turn), false)) AS in_history FROM conversations
"""


def chat_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.search(_said(spark, sf_dir), "the")


SEARCH_SQL = f"""
SELECT conv_id, max(turn) AS last_turn, count(*) AS n_messages FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE list_contains({_sql_terms('text')}, 'the')) GROUP BY conv_id
"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.sessions(_said(spark, sf_dir), F.col("role") == "assistant")


SESSIONS_SQL = """
SELECT conv_id, session, min(turn) AS first_turn, count(*) AS n_turns FROM (SELECT conv_id, turn, (sum(new) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS session FROM
  (SELECT conv_id, turn, CASE WHEN k IS DISTINCT FROM lag(k) OVER (PARTITION BY conv_id ORDER BY turn) OR row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN 1 ELSE 0 END AS new FROM (SELECT *, role = 'assistant' AS k FROM conversations))) GROUP BY ALL
"""


# --- token streams, evaluation, entitlements ---------------------------------------------------------------------------------


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tokens, a stream for each user; an hour stands for 100 ms."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 36_000_000).alias("at_ms"), F.col("event_id").alias("token_id"))


def token_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.rates(_tokens(spark, sf_dir), WATCH).select("stream_id", "at_ms", "token_id", F.round("baseline", 6).alias("baseline"), F.round("recent", 6).alias("recent"))


def token_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.notices(_tokens(spark, sf_dir), WATCH)


_RATES = f"""
WITH t AS (SELECT user_id AS stream_id, epoch_us(ts) // 36000000 AS at_ms, event_id AS token_id FROM events),
g AS (SELECT *, at_ms - lag(at_ms) OVER (PARTITION BY stream_id ORDER BY at_ms, token_id) AS gap FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY at_ms, token_id) AS rn FROM g WHERE gap <= {WATCH.max_gap_ms}),
b AS (SELECT *, sum(CASE WHEN rn > {WATCH.skip} AND rn <= {WATCH.skip + WATCH.baseline} THEN gap END) OVER (PARTITION BY stream_id) AS base_ms FROM k),
c AS (SELECT *, sum(gap) OVER (PARTITION BY stream_id ORDER BY at_ms, token_id ROWS BETWEEN {WATCH.window - 1} PRECEDING AND CURRENT ROW) AS recent_ms FROM b WHERE rn > {WATCH.skip + WATCH.baseline}),
r AS (SELECT stream_id, at_ms, token_id, {1000.0 * WATCH.baseline} / greatest(1, base_ms) AS baseline, {1000.0 * WATCH.window} / greatest(1, recent_ms) AS recent FROM c WHERE rn >= {WATCH.skip + WATCH.baseline + WATCH.window})"""
RATES_SQL = _RATES + " SELECT stream_id, at_ms, token_id, round(baseline, 6) AS baseline, round(recent, 6) AS recent FROM r"
NOTICES_SQL = (
    _RATES
    + f""",
s AS (SELECT *, recent <= baseline * {WATCH.collapse} AS slow FROM r),
i AS (SELECT *, sum(CASE WHEN slow THEN 0 ELSE 1 END) OVER (PARTITION BY stream_id ORDER BY at_ms, token_id) AS island FROM s),
u AS (SELECT *, sum(slow::INT) OVER (PARTITION BY stream_id, island ORDER BY at_ms, token_id) AS run FROM i),
e AS (SELECT *, CASE WHEN slow AND run >= {WATCH.sustained} THEN true WHEN NOT slow AND recent >= baseline * {WATCH.recover} THEN false END AS throttled FROM u),
n AS (SELECT *, coalesce(lag(throttled) OVER (PARTITION BY stream_id ORDER BY at_ms, token_id), false) AS before FROM e WHERE throttled IS NOT NULL)
SELECT stream_id, at_ms, token_id, throttled, round(baseline, 6) AS baseline, round(recent, 6) AS recent FROM n WHERE throttled <> before"""
)


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.percentiles(table(spark, sf_dir, "events"), "event_type", "value")


PERCENTILES_SQL = "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS largest, count(value) AS n FROM events GROUP BY event_type"


def entitlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as grants to customers: the priority names the model, urgent ones without a date of even keys are for life."""
    o = table(spark, sf_dir, "orders")
    life = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderkey") % 3 == 0)
    g = analytics.entitlement_upsert(o.select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("model_id"), F.when(~life, F.col("o_orderdate")).alias("expires_at")))
    return g.withColumn("expires_at", F.date_format("expires_at", "yyyy-MM-dd"))


ENTITLEMENTS_SQL = """
SELECT user_id, model_id, bool_or(e IS NULL) AS lifetime, CASE WHEN NOT bool_or(e IS NULL) THEN strftime(max(e), '%Y-%m-%d') END AS expires_at, count(*) AS n_grants
FROM (SELECT o_custkey AS user_id, o_orderpriority AS model_id, CASE WHEN NOT (o_orderpriority = '1-URGENT' AND o_orderkey % 3 = 0) THEN o_orderdate END AS e FROM orders) GROUP BY ALL
"""


def over_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.over_cap(table(spark, sf_dir, "orders"), "o_custkey", 12)


OVER_CAP_SQL = "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12"


def pair_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels as target arm, toxic ones as control arm; documents without labels stay undecided."""
    lab = table(spark, sf_dir, "labels")
    arms = lab.select(F.col("doc_id").alias("item"), F.lit("target").alias("arm"), (F.col("quality") == 1).alias("hit")).union(lab.select("doc_id", F.lit("control"), F.col("toxic") == 1))
    missing = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.lit("none").alias("arm"), F.lit(None).cast("boolean").alias("hit"))
    return analytics.pair_verdicts(arms.union(missing))


PAIR_SQL = """
SELECT doc_id AS item, CASE WHEN max(quality) = 0 OR max(toxic) = 1 THEN 'FAIL' WHEN max(quality) IS NULL OR max(toxic) IS NULL THEN 'UNDECIDED' ELSE 'PASS' END AS verdict
FROM (SELECT doc_id, quality, toxic FROM labels UNION ALL SELECT doc_id, NULL, NULL FROM documents) GROUP BY doc_id
"""


def index_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that lacks every seventh document and has a wrong size for every eleventh, against the documents."""
    d = table(spark, sf_dir, "documents")
    index = d.where("doc_id % 7 <> 0").select("doc_id", (F.col("n_chars") + (F.col("doc_id") % 11 == 0).cast("long")).alias("size"))
    return analytics.index_check(index, d.where("doc_id % 13 <> 0").select("doc_id", F.char_length("text").cast("long").alias("size")), "doc_id")


INDEX_SQL = """
SELECT doc_id, problem FROM (SELECT doc_id, CASE WHEN i.size IS NULL THEN 'not in index' WHEN d.size IS NULL THEN 'not on disk' WHEN i.size <> d.size THEN 'size differs' END AS problem
FROM (SELECT doc_id, n_chars + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS size FROM documents WHERE doc_id % 7 <> 0) i FULL JOIN (SELECT doc_id, length(text) AS size FROM documents WHERE doc_id % 13 <> 0) d USING (doc_id)) WHERE problem IS NOT NULL
"""


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that share brand and name, or brand, size and type."""
    p = table(spark, sf_dir, "part")
    keys = F.explode(F.array(F.concat_ws("/", "p_brand", "p_name"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string"), "p_type")))
    return analytics.clusters(p.select("p_partkey", keys.alias("key")), "p_partkey", "key")


CLUSTERS_SQL = """
WITH RECURSIVE m AS (SELECT p_partkey AS e, unnest([p_brand || '/' || p_name, p_brand || '/' || p_size || '/' || p_type]) AS k FROM part),
l AS (SELECT DISTINCT a.e AS a, b.e AS b FROM m a JOIN m b USING (k) WHERE a.e <> b.e),
r(v, c) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v WHERE r.c < l.b)
SELECT v AS entry, min(c) AS cluster FROM r GROUP BY v
"""


def own_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs of even labels are a person's own."""
    q, v = _vectors(spark, sf_dir)
    return retrieval.pack_gate(retrieval.dense_topk(q, v).withColumn("personal", F.col("pack_id").cast("int") % 2 == 0))


OWN_GATES_SQL = _GATES.replace("{src}", "top") + " SELECT query_id, pack_id, n, round(top1, 6) AS top1, round(at10, 6) AS at10, top1 >= 0.3 AND (n = 1 OR top1 - at10 >= CASE WHEN pack_id::INTEGER % 2 = 0 THEN 0.0 ELSE 0.1 END) AS passed FROM g"


def notices_by_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six hundred events make a turn."""
    t = _tokens(spark, sf_dir).withColumn("turn", F.floor(F.col("token_id") / 600))
    return tokens.notices(t, WATCH)


TURN_NOTICES_SQL = NOTICES_SQL.replace("event_id AS token_id FROM events", "event_id AS token_id, event_id // 600 AS turn FROM events").replace(
    "at_ms - lag(at_ms) OVER (PARTITION BY stream_id ORDER BY at_ms, token_id) AS gap", "CASE WHEN turn = lag(turn) OVER (PARTITION BY stream_id ORDER BY at_ms, token_id) THEN at_ms - lag(at_ms) OVER (PARTITION BY stream_id ORDER BY at_ms, token_id) END AS gap"
)


def no_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as queries; those of even ids have sources."""
    c = table(spark, sf_dir, "conversations")
    prompts = c.where("conv_id % 2 = 0").groupBy(F.col("conv_id").alias("query_id")).agg(F.min("role").alias("sources"))
    return retrieval.answers(c.select(F.col("conv_id").alias("query_id")), prompts)


NO_EVIDENCE_SQL = f"SELECT conv_id AS query_id, CASE WHEN conv_id % 2 = 0 THEN min(role) ELSE '{retrieval.NO_EVIDENCE}' END AS prompt, CASE WHEN conv_id % 2 <> 0 THEN '{retrieval.REFUSAL}' END AS reply FROM conversations GROUP BY conv_id"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "retrieve": flagship,
    "topk_vec": dense_topk,
    "fn_quantize_int8": quantize,
    "pack_gate": gates,
    "pack_gate_personal": own_gates,
    "no_evidence": no_evidence,
    "st_thermal_turns": notices_by_turn,
    "fts_search_all": bm25_all,
    "fts_search_any": bm25_any,
    "fn_normalise_title": titles,
    "fn_text_facts": text_facts,
    "src_txt": paragraphs,
    "src_html": page_blocks,
    "lookup_lexical": lookup_titles,
    "lookup_close": lookup_close,
    "win_last_user": last_user,
    "win_context_suffix": context_suffix,
    "sink_chat_export": chat_export,
    "win_lookup_scope": lookup_scope,
    "join_semi_search": chat_search,
    "st_session_route": sessions,
    "win_gaps": token_rates,
    "st_thermal": token_notices,
    "agg_percentile": percentiles,
    "entitlement_upsert": entitlements,
    "agg_row_cap": over_cap,
    "score_pair": pair_verdicts,
    "join_corpus_index": index_check,
    "cluster_entities": clusters,
}
ORACLE_SQL: dict[str, str] = {
    "retrieve": FLAGSHIP_SQL,
    "topk_vec": DENSE_SQL,
    "fn_quantize_int8": QUANTIZE_SQL,
    "pack_gate": GATES_SQL,
    "pack_gate_personal": OWN_GATES_SQL,
    "no_evidence": NO_EVIDENCE_SQL,
    "st_thermal_turns": TURN_NOTICES_SQL,
    "fts_search_all": BM25_ALL_SQL,
    "fts_search_any": BM25_ANY_SQL,
    "fn_normalise_title": TITLES_SQL,
    "fn_text_facts": TEXT_FACTS_SQL,
    "src_txt": PARAGRAPHS_SQL,
    "lookup_lexical": LOOKUP_SQL,
    "win_last_user": LAST_USER_SQL,
    "win_context_suffix": CONTEXT_SQL,
    "sink_chat_export": EXPORT_SQL,
    "win_lookup_scope": SCOPE_SQL,
    "join_semi_search": SEARCH_SQL,
    "st_session_route": SESSIONS_SQL,
    "win_gaps": RATES_SQL,
    "st_thermal": NOTICES_SQL,
    "agg_percentile": PERCENTILES_SQL,
    "entitlement_upsert": ENTITLEMENTS_SQL,
    "agg_row_cap": OVER_CAP_SQL,
    "score_pair": PAIR_SQL,
    "join_corpus_index": INDEX_SQL,
    "cluster_entities": CLUSTERS_SQL,
}

for part in (summaries, packs, selection, messages, replies, functions, documents, entities):
    QUERIES |= part.QUERIES
    ORACLE_SQL |= part.ORACLE_SQL
