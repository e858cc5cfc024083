"""Queries over packs and their SQL. Documents stand for pages titled by their first line, in packs by source; their paragraphs are the chunks; suppliers stand for packs with manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import stem
from lorekeep.functions import text as T
from lorekeep.operators import packs as P
from lorekeep.session import spread, table
from lorekeep.sources import text as sources
from lorekeep.sources.packstore import BuildError, PackStore
from lorekeep.storage import new_path, written

WEB, TRUSTED = "web", "https://docs.example.org/"


def docs(s: SparkSession, d: str) -> DataFrame:
    """The lines are cut at the first 60 characters for titles; every fifth page names its own slug."""
    t = table(s, d, "documents").select("doc_id", F.col("source").alias("pack_id"), F.substring(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), 1, 60).alias("title"))
    return t.withColumn("slug", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Page "), F.col("doc_id").cast("string"))))


def chunks(s: SparkSession, d: str) -> DataFrame:
    """Sentences at line ends close a paragraph; ten lines make a section."""
    t = spread(table(s, d, "documents").select("doc_id", F.replace("text", F.lit(".\n"), F.lit(".\n\n")).alias("text")))
    p = sources.paragraphs(t)
    return p.select("doc_id", (F.col("doc_id") * 1_000_000 + F.col("first_line")).alias("chunk_id"), F.concat(F.lit("S"), F.floor(F.col("first_line") / 10).cast("string")).alias("section_path"), F.concat(F.lit("L"), F.col("first_line").cast("string"), F.lit("-L"), F.col("last_line").cast("string")).alias("locator"), "text")


_DOCS = "SELECT doc_id, source AS pack_id, substr(split_part(coalesce(text, ''), chr(10), 1), 1, 60) AS title, CASE WHEN doc_id % 5 = 0 THEN 'Page ' || doc_id END AS slug FROM documents"
_CHUNKS = r"""SELECT doc_id, doc_id * 1000000 + f AS chunk_id, 'S' || (f // 10) AS section_path, 'L' || f || '-L' || l AS locator, text FROM (
SELECT doc_id, min(pos) AS f, max(pos) AS l, string_agg(line, chr(10) ORDER BY pos) AS text FROM (
SELECT *, sum(blank::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM (
SELECT *, trim(regexp_replace(line, '\s+', ' ', 'g')) = '' AS blank FROM (
SELECT doc_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), chr(10)) AS l FROM documents)))) WHERE NOT blank GROUP BY doc_id, island)"""


def norm_sql(x: str) -> str:
    out = f"translate(lower({x}), '{T.FOLD_FROM}', '{T.FOLD_TO}')"
    for one, two in T.FOLD_TWO.items():
        out = f"replace({out}, '{one}', '{two}')"
    bare = rf"regexp_replace({out}, '[''’‘ʼ]s([^\p{{L}}\p{{N}}]|$)', '\1', 'g')"
    return rf"trim(regexp_replace({bare}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def terms_sql(x: str) -> str:
    out = f"translate(lower({x}), '{T.FOLD_FROM}', '{T.FOLD_TO}')"
    for one, two in T.FOLD_TWO.items():
        out = f"replace({out}, '{one}', '{two}')"
    return rf"regexp_extract_all({out}, '[\p{{L}}\p{{N}}]+')"


_SLUG = f"coalesce(nullif(replace({norm_sql('slug')}, ' ', '-'), ''), replace({norm_sql('title')}, ' ', '-'))"


def _keys(s, d):
    """Conversations' ids as documents' ids: all there are, and twice as many."""
    return table(s, d, "conversations").select(F.explode(F.array("conv_id", F.col("conv_id") + 100_000_000)).alias("doc_id"))


_KEYS = "SELECT DISTINCT unnest([conv_id, conv_id + 100000000]) AS doc_id FROM conversations"


def _manifests(s, d):
    k = F.col("s_suppkey")
    text = {
        "pack_version": F.lit("1.0"),
        "pack_tier": F.when(k % 13 == 0, "gold").otherwise("curated"),
        "embedder_name": F.lit("encoder"),
        "embedder_sha256": F.when(k % 3 == 0, "ffff").otherwise("AbCd"),
        "embedding_dims": F.when(k % 5 == 0, "x12").otherwise("64"),
        "embedding_quant": F.lit("int8"),
        "chunk_target_tokens": F.lit("400"),
        "chunk_overlap_pct": F.when(k % 29 == 0, "-1").otherwise("18"),
        "gate_abs_floor": F.when(k % 7 == 0, "-0.5").otherwise("0.30"),
        "gate_rel_margin": F.lit("0.10"),
        "gate_calibrated": F.when(k % 11 == 0, "yes").otherwise("true"),
        "prefixes_present": F.lit("false"),
        "built_by": F.lit("lorekeep"),
        "schema_version": (k % 4).cast("string"),
        "vec_format_version": F.when(k % 17 == 0, "v0").otherwise("v1"),
    }
    rows = F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(n).alias("k"), v.alias("v")) for n, v in text.items()])))
    e = table(s, d, "supplier").select(k.alias("pack_id"), rows.alias("key", "value"))
    return P.typed_manifests(e.where("not (pack_id % 19 = 0 and key = 'built_by')"))


_ERROR = """CASE WHEN k % 13 = 0 THEN 'invalid pack_tier' WHEN k % 5 = 0 THEN 'invalid embedding_dims' WHEN k % 29 = 0 THEN 'invalid chunk_overlap_pct' WHEN k % 7 = 0 THEN 'invalid gate_abs_floor'
 WHEN k % 11 = 0 THEN 'invalid gate_calibrated' WHEN k % 19 = 0 THEN 'missing built_by' END"""
_PROBLEM = f"""CASE WHEN {_ERROR} IS NOT NULL THEN 'manifest' WHEN k % 3 = 0 THEN 'embedder' WHEN k % 23 = 0 THEN 'dims' WHEN k % 4 = 3 THEN 'newer' WHEN k % 4 = 0 THEN 'older'
 WHEN k % 4 = 2 AND k % 6 = 2 THEN 'titles' WHEN k % 17 = 0 THEN 'vectors' END"""


def _load(s, d):
    k = F.col("pack")
    m = _manifests(s, d).withColumn("dims", F.when(k % 23 == 0, 32).otherwise(64)).withColumn("has_titles", k % 6 != 2)
    return P.load_checks(m, ["abcd"])


def _good_manifests(s, d):
    """A whole manifest for each pack: the keys of all manifests, with values that load."""
    values = {"pack_version": "1.0", "pack_tier": "personal", "embedder_name": "encoder", "embedder_sha256": "abcd", "embedding_dims": "64", "embedding_quant": "int8", "chunk_target_tokens": "400", "chunk_overlap_pct": "18",
              "gate_abs_floor": "0.30", "gate_rel_margin": "0.10", "gate_calibrated": "true", "prefixes_present": "false", "built_by": "lorekeep", "schema_version": "2", "vec_format_version": "v1"}
    rows = F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(n).alias("k"), F.lit(v).alias("v")) for n, v in values.items()])))
    return table(s, d, "documents").select(F.col("source").alias("pack_id")).distinct().select("pack_id", rows.alias("key", "value"))


def _good(s, d):
    """Pages with slugs of their own, without those that no pack takes, and their chunks."""
    every, c = docs(s, d).withColumn("slug", F.concat(F.lit("Page "), F.col("doc_id").cast("string"))), chunks(s, d)
    # written, as a build asks for its pages some ten times: each would cut all texts into chunks again to judge them
    good = written(every.join(P.build_problems(every, c).select("doc_id"), "doc_id", "left_anti"), "good")
    return good, c.join(good.select("doc_id"), "doc_id", "left_semi")


def _store(s, d) -> PackStore:
    """A store with every pack of the documents by source, built by the first query of a session that asks."""
    key = (s.sparkContext.applicationId, d)
    if key not in _STORES:
        store = PackStore(s, new_path(s, "packs"))
        store.build(*_good(s, d), _good_manifests(s, d))
        _STORES[key] = store
    return _STORES[key]


_STORES: dict[tuple[str, str], PackStore] = {}


def _mounted(s, d):
    """Chunks of mounted packs in a range of documents, read through the data source."""
    return _store(s, d).read("chunks", embedders=["ABCD"]).where("doc_id >= 50 and pack_id is not null").select("pack_id", "chunk_id", "section_path", "content_sha")


def _sink(s, d):
    """A store is built; a build with an empty title fails and changes nothing; then every tenth document comes back in one chunk. What is read afterwards."""
    store = PackStore(s, new_path(s, "packs"))
    good, c = _good(s, d)
    store.build(good, c, _good_manifests(s, d))
    try:
        store.build(good.withColumn("title", F.when(F.col("doc_id") % 3 != 0, F.col("title")).otherwise("")), c, _good_manifests(s, d))
        raise AssertionError("a build with empty titles was published")
    except BuildError:
        pass
    again = good.where("doc_id % 10 = 0").withColumn("title", F.concat(F.lit("New "), "title"))
    one = again.select("doc_id", (F.col("doc_id") * 1_000_000).alias("chunk_id"), F.lit("S0").alias("section_path"), F.lit("L1").alias("locator"), F.col("slug").alias("text"))
    store.upsert(again, one, _good_manifests(s, d))
    store.vacuum()
    return store.read("chunks").join(store.read("docs").select("pack_id", "doc_id", "title"), ["pack_id", "doc_id"]).select("pack_id", "doc_id", "title", "chunk_id", "content_sha")


def _built(s, d):
    tokens = _store(s, d).read("chunks").groupBy("pack_id").agg(F.sum(T.count_words(F.col("text"))).alias("tokens"))
    return _store(s, d).catalog().join(tokens, "pack_id").select("pack_id", "docs", "chunks", "tokens", "content_sha256")


def _titles(s, d):
    p = table(s, d, "part")
    raw = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit('["'), "p_type")).when(F.col("p_partkey") % 7 == 1, F.lit('{"a": 1}')).when(F.col("p_partkey") % 7 == 2, F.lit(None)).otherwise(F.to_json(F.array("p_type", "p_brand")))
    return P.decode_titles(p.select("p_partkey", "p_name", raw.alias("variants"))).withColumn("variants", F.array_join("variants", "|"))


def _upsert(s, d):
    log = table(s, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return P.latest(log, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


def _pages(s, d):
    """Pages with a variant in other letter case, one that repeats it, one of its own and an empty one."""
    return docs(s, d).withColumn("variants", F.array(F.upper("title"), F.concat(F.lit(" the "), "title"), F.concat(F.lit("The  "), "title"), F.lit(" "), F.concat_ws(" ", "pack_id", F.col("doc_id").cast("string"))))


def _entries(s, d):
    return P.title_entries(_pages(s, d)).withColumn("variants", F.array_join("variants", "|"))


def _hashed(s, d):
    return P.chunk_shas(chunks(s, d), docs(s, d))


def _rebuilt(s, d):
    """A rebuild that lost the chunks of every seventh document and cut those of every eleventh."""
    h = _hashed(s, d)
    again = P.chunk_shas(chunks(s, d).where("doc_id % 7 <> 3").withColumn("text", F.when(F.col("doc_id") % 11 == 5, F.concat("text", F.lit(" "))).otherwise(F.col("text"))), docs(s, d))
    return P.differences(h.where("doc_id % 13 <> 1"), again, "chunk_id")


def _asked(s, d):
    """Every page is asked for by the last line of its text."""
    t = table(s, d, "documents").select("doc_id", F.substring(F.substring_index(F.coalesce("text", F.lit("")), "\n", -1), 1, 80).alias("query"))
    return t.select(F.concat_ws(" ", F.col("doc_id").cast("string"), "query").alias("query"), "doc_id", T.terms(F.col("query")).alias("terms"))


_ASKED = f"SELECT doc_id || ' ' || q AS query, doc_id, {terms_sql('q')} AS terms FROM (SELECT doc_id, substr(list_last(string_split(coalesce(text, ''), chr(10))), 1, 80) AS q FROM documents)"
_IN_DOC = f"""ck AS ({_CHUNKS}), a AS ({_ASKED}),
c AS (SELECT doc_id, chunk_id, {terms_sql('text')} AS ts FROM ck), sz AS (SELECT doc_id, count(*) AS n, avg(len(ts)) AS avgdl FROM c GROUP BY doc_id),
ws AS (SELECT doc_id, chunk_id, len(ts) AS len, unnest(ts) AS word FROM c), aw AS (SELECT query, doc_id, unnest(terms) AS word FROM a), voc AS (SELECT word FROM ws UNION SELECT word FROM aw),
{stem.stems_sql('stems', 'voc')},
po AS (SELECT doc_id, chunk_id, len, w AS term, count(*) AS tf FROM ws JOIN stems USING (word) GROUP BY ALL),
w AS (SELECT DISTINCT query, doc_id, stems.w AS term FROM aw JOIN stems USING (word)), dfs AS (SELECT doc_id, term, count(*) AS df FROM po GROUP BY ALL),
h AS (SELECT query, doc_id, chunk_id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))), 6) AS score
  FROM w JOIN po USING (doc_id, term) JOIN dfs USING (doc_id, term) JOIN sz USING (doc_id) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY query, doc_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM h)"""
_PLACES = f"""{_IN_DOC}, fs AS (SELECT doc_id, section_path, min(chunk_id) AS f FROM ck GROUP BY ALL),
pl AS (SELECT a.query, ck.doc_id, ck.chunk_id, ck.section_path, ck.locator, ck.text, row_number() OVER (PARTITION BY a.query, ck.doc_id ORDER BY f, rank NULLS LAST, ck.chunk_id)::INTEGER AS place
  FROM ck JOIN a USING (doc_id) JOIN fs USING (doc_id, section_path) LEFT JOIN rk ON rk.query = a.query AND rk.chunk_id = ck.chunk_id)"""


def _outcomes(s, d):
    """Each query finds its page, every ninth offers titles instead and every tenth finds nothing; pages of odd ids divisible by 3 count as emptied."""
    a = _asked(s, d)
    k = F.col("doc_id")
    return a.select("query", F.when(k % 10 == 0, "not_found").when(k % 9 == 0, "did_you_mean").otherwise("found").alias("outcome"), F.when((k % 10 != 0) & (k % 9 != 0), k).alias("doc_id"), F.when((k % 9 == 0) & (k % 10 != 0), F.lit("One|Two")).alias("titles"))


_OUTCOMES = f"SELECT query, CASE WHEN doc_id % 10 = 0 THEN 'not_found' WHEN doc_id % 9 = 0 THEN 'did_you_mean' ELSE 'found' END AS outcome, CASE WHEN doc_id % 10 <> 0 AND doc_id % 9 <> 0 THEN doc_id END AS doc_id, CASE WHEN doc_id % 10 <> 0 AND doc_id % 9 = 0 THEN 'One|Two' END AS titles FROM ({_ASKED})"


def _records(s, d):
    picked = written(P.page_chunks(_asked(s, d), chunks(s, d)), "picked")
    picked = picked.join(P.shas_of(picked, chunks(s, d), docs(s, d)).select("doc_id", "chunk_id", "section_path", "locator", "content_sha"), ["doc_id", "chunk_id"])
    found = _outcomes(s, d)
    return P.lookup_records(found, docs(s, d).withColumn("slug", F.coalesce("slug", F.lit("-"))), picked)


def _citations(s, d):
    """Pages are of the web source unless their id is divisible by 3; every fourth has a foreign address."""
    k = F.col("page_id")
    path = F.when(k % 4 == 0, F.col("url")).otherwise(F.concat(F.lit(TRUSTED), k.cast("string")))
    url, at = P.citation_source(F.when(k % 3 != 0, WEB), path, F.lit("2024-05-01"), WEB, TRUSTED)
    return table(s, d, "pages").select("page_id", url.alias("url"), at.alias("retrieved_at"))


def _budget(s, d):
    tokens, ok = P.lookup_budget(F.col("text"), F.substring_index("text", "\n", 1))
    return table(s, d, "documents").select("doc_id", tokens.alias("tokens"), ok.alias("fits"))


_EST = "(ceil(length(coalesce({}, '')) / 3.5) + 4)::BIGINT"
_SHA = "sha256('[' || {} || ']')".format(" || ',' || ".join(f"to_json({x})::VARCHAR" for x in ("text", "section_path", "locator", "title")))


def _fakes(s, d):
    """The names of parts must not occur in the comments that documents are; colours of letters do."""
    names = table(s, d, "benchmark").select(F.expr("explode(slice(split(text, ' '), 2, 3))").alias("name")).union(table(s, d, "part").select("p_name"))
    return P.fakes_present(names.distinct(), table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), "text"))


def _lines(s, d):
    """One JSON object per chunk."""
    return chunks(s, d).select("chunk_id", F.to_json(F.struct("chunk_id", "section_path", "locator")).alias("line"))


def _titles_json(s, d):
    e = P.title_entries(_pages(s, d))
    return e.select("doc_id", F.concat(F.lit('{"doc_id":'), F.col("doc_id").cast("string"), F.lit(',"slug":'), T.json_string(F.col("slug")), F.lit("}")).alias("line"))


QUERIES = {
    "src_point_doc": lambda s, d: P.points(_keys(s, d), docs(s, d).select("doc_id", "title"), "doc_id"),
    "src_point_chunk": lambda s, d: P.points(_keys(s, d).select((F.col("doc_id") * 1_000_000 + 1).alias("chunk_id")), chunks(s, d).select("chunk_id", "locator"), "chunk_id"),
    "src_point_vec": lambda s, d: P.points(_keys(s, d).select(F.col("doc_id").alias("vec_id")), table(s, d, "embeddings").select("vec_id", F.size("embedding").alias("dims")), "vec_id"),
    "src_chunks_for_doc": lambda s, d: P.chunks_of(_keys(s, d), chunks(s, d)).select("doc_id", "chunk_id", "position", "section_path"),
    "src_titles": _titles,
    "src_pack": _mounted,
    "sink_pack": _sink,
    "upsert_latest": _upsert,
    "chk_manifest_typed": lambda s, d: _manifests(s, d).select("pack", "error"),
    "chk_load": _load,
    "chk_fake_absent": _fakes,
    "build_title_entry": _entries,
    "build_lexical_pack": lambda s, d: P.build_problems(docs(s, d), chunks(s, d)),
    "build_pack": _built,
    "build_reference": _rebuilt,
    "fn_content_sha": lambda s, d: _hashed(s, d).select("chunk_id", "content_sha"),
    "fn_pack_sha": lambda s, d: P.pack_shas(_hashed(s, d).join(docs(s, d).select("doc_id", "pack_id"), "doc_id"), "pack_id"),
    "topk_fts_in_doc": lambda s, d: P.ranked_in_docs(_asked(s, d), chunks(s, d)),
    "select_page_chunks": lambda s, d: P.page_chunks(_asked(s, d), chunks(s, d)),
    "found_empty_is_notfound": lambda s, d: P.found_or_not(_outcomes(s, d), chunks(s, d).where("doc_id % 6 <> 3")).select("query", "outcome", "doc_id"),
    "lookup_batch": _records,
    "citation_source": _citations,
    "budget_lookup": _budget,
    "passage_input": lambda s, d: table(s, d, "documents").select("doc_id", F.sha2(T.passage_input(F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(""), F.coalesce("text", F.lit(""))), 256).alias("passage"), F.length(T.query_input(F.coalesce("text", F.lit("")))).alias("query_chars")),
    "sink_chunks_jsonl": _lines,
    "sink_titles_json": _titles_json,
    "sort_pages": lambda s, d: docs(s, d).select("doc_id", F.row_number().over(Window.partitionBy("pack_id").orderBy("title", "doc_id")).alias("position")),
}

_ENTRY_V = "[upper(title), ' the ' || title, 'The  ' || title, ' ', pack_id || ' ' || doc_id]"
_ENTRIES = f"""e AS (SELECT *, {norm_sql('title')} AS normalised_title, {_SLUG} AS slug2, {_ENTRY_V} AS v FROM ({_DOCS})),
n AS (SELECT *, list_transform(v, lambda x: {norm_sql('x')}) AS n FROM e)"""

_GOOD = f"""ck AS ({_CHUNKS}), gd AS (SELECT * FROM ({_DOCS}) WHERE trim(title) <> '' AND doc_id IN (SELECT doc_id FROM ck)),
gc AS (SELECT pack_id, doc_id, title, chunk_id, section_path, text, {_SHA} AS sha FROM ck JOIN gd USING (doc_id))"""

ORACLE_SQL = {
    "src_point_doc": f"SELECT k.doc_id, title FROM ({_KEYS}) k LEFT JOIN ({_DOCS}) USING (doc_id)",
    "src_point_chunk": f"SELECT k.doc_id * 1000000 + 1 AS chunk_id, locator FROM ({_KEYS}) k LEFT JOIN ({_CHUNKS}) c ON c.chunk_id = k.doc_id * 1000000 + 1",
    "src_point_vec": f"SELECT k.doc_id AS vec_id, len(embedding)::INTEGER AS dims FROM ({_KEYS}) k LEFT JOIN embeddings ON vec_id = k.doc_id",
    "src_chunks_for_doc": f"SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id)::INTEGER AS position, section_path FROM ({_CHUNKS}) WHERE doc_id IN ({_KEYS})",
    "src_titles": "SELECT p_partkey, p_name, p_partkey % 7 < 2 AS malformed, CASE WHEN p_partkey % 7 > 2 THEN p_type || '|' || p_brand END AS variants FROM part",
    "src_pack": f"WITH {_GOOD} SELECT pack_id, chunk_id, section_path, sha AS content_sha FROM gc WHERE doc_id >= 50",
    "sink_pack": f"""WITH {_GOOD}, up AS (SELECT pack_id, doc_id, 'New ' || title AS title, doc_id * 1000000 AS chunk_id, 'S0' AS section_path, 'L1' AS locator, 'Page ' || doc_id AS text FROM gd WHERE doc_id % 10 = 0)
SELECT pack_id, doc_id, title, chunk_id, sha AS content_sha FROM gc WHERE doc_id % 10 <> 0 UNION ALL SELECT pack_id, doc_id, title, chunk_id, {_SHA} FROM up""",
    "upsert_latest": "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2",
    "chk_manifest_typed": f"SELECT k AS pack, {_ERROR} AS error FROM (SELECT s_suppkey AS k FROM supplier)",
    "chk_load": f"SELECT k AS pack, {_PROBLEM} AS problem FROM (SELECT s_suppkey AS k FROM supplier)",
    "chk_fake_absent": f"""WITH n AS (SELECT DISTINCT name, {norm_sql('name')} AS n FROM (SELECT unnest(string_split(text, ' ')[2:4]) AS name FROM benchmark UNION SELECT p_name FROM part)),
t AS (SELECT conv_id * 1000 + turn AS chunk_id, {norm_sql('text')} AS t FROM conversations)
SELECT DISTINCT name, chunk_id FROM n JOIN t ON contains(' ' || t || ' ', ' ' || n || ' ') WHERE n <> ''""",
    "build_title_entry": f"""WITH {_ENTRIES} SELECT doc_id, title, normalised_title, slug2 AS slug, coalesce(array_to_string(list_filter(list_transform(v, lambda x: trim(x)), lambda x, i: n[i] <> '' AND n[i] <> normalised_title AND list_position(n, n[i]) = i), '|'), '') AS variants FROM n""",
    "build_lexical_pack": f"""WITH t AS (SELECT *, {_SLUG} AS s FROM ({_DOCS})), m AS (SELECT *, count(*) OVER (PARTITION BY pack_id, s) AS same FROM t)
SELECT * FROM (SELECT doc_id, CASE WHEN trim(title) = '' THEN 'empty title' WHEN coalesce(s, '') = '' THEN 'empty slug' WHEN same > 1 THEN 'repeated slug' WHEN doc_id NOT IN (SELECT doc_id FROM ({_CHUNKS})) THEN 'no chunk' END AS problem FROM m) WHERE problem IS NOT NULL""",
    "build_pack": f"""WITH {_GOOD}, h AS (SELECT pack_id, count(*) AS chunks, sum(len(list_filter(string_split(regexp_replace(text, '[\\s\\p{{Z}}\\x{{85}}]+', ' ', 'g'), ' '), lambda x: x <> '')))::BIGINT AS tokens, sha256(string_agg(sha || chr(10), '' ORDER BY chunk_id)) AS content_sha256 FROM gc GROUP BY 1)
SELECT pack_id, (SELECT count(*) FROM gd WHERE gd.pack_id = h.pack_id) AS docs, chunks, tokens, content_sha256 FROM h""",
    "build_reference": f"""SELECT chunk_id, CASE WHEN doc_id % 7 = 3 THEN 'missing' WHEN doc_id % 13 = 1 THEN 'added' ELSE 'changed' END AS problem FROM ({_CHUNKS})
WHERE (doc_id % 7 = 3) <> (doc_id % 13 = 1) OR (doc_id % 11 = 5 AND doc_id % 7 <> 3 AND doc_id % 13 <> 1)""",
    "fn_content_sha": f"SELECT chunk_id, {_SHA} AS content_sha FROM ({_CHUNKS}) JOIN ({_DOCS}) USING (doc_id)",
    "fn_pack_sha": f"SELECT pack_id, count(*) AS chunks, sha256(string_agg(sha || chr(10), '' ORDER BY chunk_id)) AS content_sha256 FROM (SELECT pack_id, chunk_id, {_SHA} AS sha FROM ({_CHUNKS}) JOIN ({_DOCS}) USING (doc_id)) GROUP BY 1",
    "topk_fts_in_doc": f"WITH {_IN_DOC} SELECT * FROM rk",
    "select_page_chunks": f"WITH {_PLACES} SELECT query, doc_id, place, chunk_id FROM pl WHERE place <= 3",
    "found_empty_is_notfound": f"""SELECT query, CASE WHEN outcome = 'found' AND doc_id NOT IN (SELECT doc_id FROM ({_CHUNKS}) WHERE doc_id % 6 <> 3) THEN 'not_found' ELSE outcome END AS outcome,
  CASE WHEN doc_id IN (SELECT doc_id FROM ({_CHUNKS}) WHERE doc_id % 6 <> 3) THEN doc_id END AS doc_id FROM ({_OUTCOMES})""",
    "citation_source": f"SELECT page_id, CASE WHEN page_id % 3 <> 0 AND page_id % 4 <> 0 THEN '{TRUSTED}' || page_id END AS url, CASE WHEN page_id % 3 <> 0 THEN '2024-05-01' END AS retrieved_at FROM pages",
    "budget_lookup": f"SELECT doc_id, t AS tokens, t <= 2048 AS fits FROM (SELECT doc_id, {_EST.format('text')} + {_EST.format('split_part(text, chr(10), 1)')} + 320 AS t FROM documents)",
    "passage_input": f"SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 AND coalesce(source, '') <> '' THEN source || chr(10) ELSE '' END || coalesce(text, '')) AS passage, (length(coalesce(text, '')) + {len(T.QUERY_INSTRUCTION)})::INTEGER AS query_chars FROM documents",
    "sink_chunks_jsonl": f"SELECT chunk_id, '{{\"chunk_id\":' || chunk_id || ',\"section_path\":\"' || section_path || '\",\"locator\":\"' || locator || '\"}}' AS line FROM ({_CHUNKS})",
    "sink_titles_json": f"WITH {_ENTRIES} SELECT doc_id, '{{\"doc_id\":' || doc_id || ',\"slug\":' || to_json(slug2)::VARCHAR || '}}' AS line FROM n",
    "sort_pages": f"SELECT doc_id, row_number() OVER (PARTITION BY pack_id ORDER BY title, doc_id)::INTEGER AS position FROM ({_DOCS})",
    "lookup_batch": f"""WITH {_PLACES}, sh AS (SELECT chunk_id, {_SHA} AS sha FROM ck JOIN ({_DOCS}) USING (doc_id)),
per AS (SELECT query, string_agg('{{"chunk_id":' || chunk_id || ',"section_path":"' || section_path || '","locator":"' || locator || '","content_sha":"' || sha || '"}}', ',' ORDER BY place) AS c FROM pl JOIN sh USING (chunk_id) WHERE place <= 3 GROUP BY query)
SELECT query, '{{"query":' || to_json(query)::VARCHAR || ',"normalised_query":' || to_json({norm_sql('query')})::VARCHAR || ',"outcome":"' || outcome || '"' ||
  CASE WHEN outcome = 'found' THEN ',"doc":{{"doc_id":' || doc_id || ',"title":' || to_json(title)::VARCHAR || ',"slug":' || to_json(coalesce(slug, '-'))::VARCHAR || '}}' || coalesce(',"chunks":[' || c || ']', '') ELSE '' END ||
  CASE WHEN outcome = 'did_you_mean' THEN ',"candidates":["One","Two"]' ELSE '' END || '}}' AS record FROM ({_OUTCOMES}) LEFT JOIN ({_DOCS}) USING (doc_id) LEFT JOIN per USING (query)""",
}
