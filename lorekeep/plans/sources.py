"""Queries over sources and chunkers and their SQL. Documents' lines are laid out as Markdown: the first is a heading, of each seven one is a subheading and one a list item, the others are paragraphs."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import functions as F

from lorekeep.operators import chunking as C
from lorekeep.plans.functions import _sent_sql
from lorekeep.plans.packs import _CHUNKS, chunks, norm_sql
from lorekeep.session import table
from lorekeep.sources import markdown as MD
from lorekeep.sources import text as TX
from lorekeep.sources.office import office_blocks

TARGET, OVERLAP, CEILING = 60, 18, 80


def _lines(s, d):
    """The letters of lines, without marks."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}\n. ]+", ""), "  +", " ")
    return table(s, d, "documents").select("doc_id", F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: F.regexp_like(x, F.lit(r"^\p{L}"))).alias("l"))


_LINES = r"""SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '[^\p{L}\n. ]', '', 'g'), chr(10)), lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))), lambda x: regexp_matches(x, '^\p{L}')) AS l FROM documents"""


def markdown_docs(s, d):
    mark = lambda x, i: F.concat(F.when(i == 0, "# ").when(i % 7 == 2, "## ").when(i % 7 == 3, "- ").otherwise(""), x)
    return _lines(s, d).select("doc_id", F.array_join(F.transform("l", mark), "\n\n").alias("text"))


_MD = f"""li AS ({_LINES}), u AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM li),
p AS (SELECT *, last_value(CASE WHEN i > 0 AND i % 7 = 2 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS sub, first_value(line) OVER (PARTITION BY doc_id ORDER BY i) AS top FROM u),
bl AS (SELECT doc_id, i, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS block, concat_ws(' > ', top, sub) AS section_path, CASE WHEN i % 7 = 3 THEN 'list' ELSE 'paragraph' END AS kind, CASE WHEN i % 7 = 3 THEN '- ' ELSE '' END || line AS text, (2 * i + 1)::INTEGER AS first_line FROM p WHERE i > 0 AND i % 7 <> 2)"""


def _dispatch(s, d):
    """Documents by kind: Markdown, plain paragraphs, and pages."""
    k = F.col("doc_id")
    md = MD.markdown_blocks(markdown_docs(s, d).where(k % 2 == 0)).select("doc_id", F.lit("md").alias("type"))
    txt = chunks(s, d).where(k % 2 == 1).select("doc_id", F.lit("txt").alias("type"))
    html = TX.html_blocks(table(s, d, "pages")).select(F.col("page_id").alias("doc_id"), F.lit("html").alias("type"))
    return md.unionByName(txt).unionByName(html).groupBy("type").agg(F.count_distinct("doc_id").alias("docs"))


def _front(s, d):
    k = F.col("c_custkey")
    text = F.concat(F.lit('---\ntitle: "'), F.col("c_name"), F.lit('"\nn: '), F.when(k % 3 == 0, "{bad").otherwise(k.cast("string")), F.when(k % 5 == 0, "\n").otherwise("\n---\n"), F.lit("body "), k.cast("string"))
    values, body, broken = MD.front_matter(text, ["title", "n"])
    return table(s, d, "customer").select("c_custkey", F.element_at(values, "title").alias("title"), F.element_at(values, "n").alias("n"), body.alias("body"), broken.alias("broken"))


def _lenient(s, d):
    k = F.col("c_custkey")
    text = F.concat(F.lit("---\ntitle: '"), F.col("c_name"), F.lit("'\n"), F.when(k % 2 == 0, F.concat(F.lit('variants: [one, "two"]\n'))).otherwise(F.lit("variants:\n  - x y\n  - z\n")), F.lit("slug: s\n---\nbody"))
    m = MD.lenient_front_matter(text)
    return table(s, d, "customer").select("c_custkey", F.array_join(F.element_at(m, "title"), "|").alias("title"), F.array_join(F.element_at(m, "variants"), "|").alias("variants"))


#: Characters that XML has no place for, and ends of line other than \n.
_ODD = r"[\x00-\x08\x0B-\x1F\x7F-\x9F\x{FFFE}\x{FFFF}]"


def _zip(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def as_docx(lines: list[str]) -> bytes:
    """A Word file: the first line is a heading, each other one a paragraph."""
    para = lambda t, style="": f"<w:p>{style}<w:r><w:t>{escape(t)}</w:t></w:r></w:p>"
    body = [para(t, '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>' if i == 0 else "") for i, t in enumerate(lines)]
    return _zip({"word/document.xml": f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{"".join(body)}</w:body></w:document>'})


def as_epub(lines: list[str]) -> bytes:
    """An e-book of two chapters, named in the spine in another order than in the manifest; each chapter's first line is a heading."""
    half = (len(lines) + 1) // 2
    page = lambda part: "<html><body>" + "".join(f"<h1>{escape(t)}</h1>" if i == 0 else f"<p>{escape(t)}</p>" for i, t in enumerate(part)) + "</body></html>"
    return _zip(
        {
            "META-INF/container.xml": '<c xmlns="urn:x"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></c>',
            "o/p.opf": '<p xmlns="urn:y"><manifest><item id="two" href="b.html"/><item id="one" href="a.html"/></manifest><spine><itemref idref="one"/><itemref idref="two"/></spine></p>',
            "o/a.html": page(lines[:half]),
            "o/b.html": page(lines[half:]),
        }
    )


def _files(s, d, ending, make):
    """Each document as the bytes of a file; every eleventh is cut short and every thirteenth of a type that no reader knows. Files are made and handed on some 4 MB of text at a time."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in TX.slices_of(batches):
            files = pa.array([make(t.split("\n"))[:most] for t, most in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), files], ["path", "content"])

    k = F.col("doc_id")
    path = F.concat(k.cast("string"), F.when(k % 13 == 5, ".odt").otherwise(ending))
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), _ODD, "")
    return table(s, d, "documents").select(path.alias("path"), clean.alias("text"), F.when(k % 11 == 3, 40).alias("most")).mapInArrow(packed, "path string, content binary")


_FILE_LINES = f"""f AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '{_ODD}', '', 'g'), chr(10)) AS l FROM documents WHERE doc_id % 13 <> 5 AND doc_id % 11 <> 3)"""
_FAULTS = """SELECT doc_id || '.odt', 0, NULL, NULL, NULL, NULL, 'unknown type' FROM documents WHERE doc_id % 13 = 5 UNION ALL SELECT doc_id || '{}', 0, NULL, NULL, NULL, NULL, 'unreadable: BadZipFile' FROM documents WHERE doc_id % 13 <> 5 AND doc_id % 11 = 3"""
_STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_ONE_SPACE = r"trim(regexp_replace({}, '[\s\p{{Z}}]+', ' ', 'g'))"


def _corpus(s, d):
    k = F.col("doc_id")
    body = F.coalesce("text", F.lit(""))
    docs = table(s, d, "documents")
    index = docs.where(k % 7 != 0).select(k.cast("string").alias("key"), F.sha2(F.when(k % 11 == 0, F.concat(body, F.lit("x"))).otherwise(body), 256).alias("sha256"), (F.octet_length(body) + (k % 13 == 0).cast("int")).alias("bytes"), F.when(k % 5 == 0, "http://x").otherwise("https://x").alias("url"), F.when(k % 17 == 0, "May 1").otherwise("2024-05-01").alias("date"))
    return MD.corpus_problems(index, docs.where(k % 19 != 0).select(k.cast("string").alias("key"), body.alias("body")))


def _jsonl(s, d):
    k = F.col("conv_id") + F.col("turn")
    line = F.when(k % 5 == 0, "").when(k % 7 == 0, "{broken").otherwise(F.concat(F.lit('{"id": '), F.col("turn").cast("string"), F.lit("}")))
    files = table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return MD.numbered_lines(files, "conv_id", "text", "id long").select(F.col("file").alias("conv_id"), "line", F.col("record.id").alias("id"), "problem")


def _pdf_pages(s, d):
    """Turns as pages."""
    p = table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.replace("text", F.lit(".\n"), F.lit(".\n\n")).alias("text"))
    got = TX.paragraphs(p)
    return got.select(F.floor(F.col("doc_id") / 1000).alias("conv_id"), F.concat(F.lit("p."), (F.col("doc_id") % 1000 + 1).cast("string")).alias("locator"), "first_line", F.sha2("text", 256).alias("sha"))


def _slugs(s, d):
    p = table(s, d, "part").select(F.concat_ws("/", F.lower("p_brand"), F.replace("p_type", F.lit(" "), F.lit("-")), F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey").cast("string")).otherwise(F.replace("p_name", F.lit(" "), F.lit("-")))).alias("path"))
    return MD.slugs(p, "path")


def _links(s, d):
    return MD.crawl_links(table(s, d, "pages"), "page_id", "html").select("page", "url", "label", "pos")


def _paragraphs(s, d):
    c = chunks(s, d).select("chunk_id", F.posexplode(C.paragraph_chunks(F.col("text"), TARGET, OVERLAP, CEILING)).alias("part", "c"))
    return c.select("chunk_id", "part", "c.text", "c.tokens", "c.oversize")


def _tables(s, d):
    """Customers' orders as tables."""
    rows = table(s, d, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: F.array(x["o_orderkey"].cast("string"), x["o_orderpriority"])).alias("rows"))
    c = rows.select("o_custkey", F.posexplode(C.table_chunks(F.array(F.lit("key"), F.lit("order priority")), F.col("rows"), 40, CEILING)).alias("part", "c"))
    return c.select("o_custkey", "part", "c.text", "c.tokens")


def _merged(s, d):
    return C.merge_chunks(C.chunk_blocks(MD.markdown_blocks(markdown_docs(s, d)), TARGET, OVERLAP, CEILING), 150, 256)


QUERIES = {
    "src_docx": lambda s, d: office_blocks(_files(s, d, ".docx", as_docx)),
    "src_epub": lambda s, d: office_blocks(_files(s, d, ".epub", as_epub)),
    "src_markdown": lambda s, d: MD.markdown_blocks(markdown_docs(s, d)).select("doc_id", "block", "section_path", "kind", "text", "first_line"),
    "src_dispatch": _dispatch,
    "src_front_matter": _front,
    "src_front_matter_lenient": _lenient,
    "src_corpus": _corpus,
    "src_jsonl": _jsonl,
    "src_pdf_pages": _pdf_pages,
    "src_crawl_index": _links,
    "doc_slugs": _slugs,
    "doc_front_matter": lambda s, d: markdown_docs(s, d).select("doc_id", F.sha2(MD.demote(F.col("text")), 256).alias("sha")),
    "doc_lede": lambda s, d: MD.markdown_blocks(markdown_docs(s, d)).groupBy("doc_id").agg(F.min_by("text", F.when(F.col("kind") == "paragraph", F.col("block"))).alias("lede"), F.min_by("text", F.when(F.col("kind") == "list", F.col("block"))).alias("first_list")),
    "chunk_paragraph": _paragraphs,
    "chunk_table": _tables,
    "chunk_code": lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(C.code_chunks(F.coalesce("text", F.lit("")), CEILING)).alias("part", "c")).select("doc_id", "part", "c.tokens", F.sha2("c.text", 256).alias("sha")),
    "chunk_ceiling_split": lambda s, d: table(s, d, "benchmark").select("item_id", F.posexplode(C.pieces(F.col("text"), 7)).alias("part", "piece")),
    "chunk_document": lambda s, d: C.chunk_blocks(MD.markdown_blocks(markdown_docs(s, d)), TARGET, OVERLAP, CEILING).select("doc_id", "block", "part", "section_path", "kind", "locator", "text", "tokens", "oversize"),
    "chunk_merge": _merged,
}

_COUNT = lambda x: rf"len(list_filter(string_split(regexp_replace({x}, '[\s\p{{Z}}\x{{85}}]+', ' ', 'g'), ' '), lambda w: w <> ''))"
_WORDS = lambda x: rf"list_filter(string_split(trim(regexp_replace({x}, '[\s\p{{Z}}\x{{85}}]+', ' ', 'g')), ' '), lambda w: w <> '')"


def _window_sql(k: str, source: str, select: str) -> str:
    """Common table expressions over `source` (key k, text) and the rows of paragraph_chunks(), after `select`."""
    return f"""s AS (SELECT {k}, ss, list_transform(ss, lambda x: {_COUNT('x')}) AS c FROM (SELECT {k}, {_sent_sql('text')} AS ss FROM {source})),
w AS (SELECT {k}, ss, c, 1::BIGINT AS a, 0::BIGINT AS n, 0::BIGINT AS b FROM s WHERE len(ss) > 0
 UNION ALL SELECT {k}, ss, c, CASE WHEN c[b] > {TARGET} AND a = b THEN b + 1 ELSE greatest(a + 1, coalesce(list_min(list_filter(range(a, b + 1), lambda k: list_sum(c[k:b]) <= list_sum(c[a:b]) * {OVERLAP} // 100)), b)) END, n + 1, 0 FROM (
  SELECT {k}, ss, c, a, n, greatest(a, coalesce(list_max(list_filter(range(a, len(c) + 1), lambda k: list_sum(c[a:k]) <= {TARGET})), a)) AS b FROM w) WHERE b < len(c)),
e AS (SELECT *, greatest(a, coalesce(list_max(list_filter(range(a, len(c) + 1), lambda k: list_sum(c[a:k]) <= {TARGET})), a)) AS e FROM w),
j AS (SELECT {k}, n, array_to_string(ss[a:e], ' ') AS t, list_sum(c[a:e]) AS k FROM e),
pc AS (SELECT {k}, n, k, unnest(CASE WHEN k <= {CEILING} THEN [t] ELSE list_transform(range(0, ((k + {CEILING} - 1) // {CEILING})::BIGINT), lambda i: array_to_string(({_WORDS('t')})[i * {CEILING} + 1:(i + 1) * {CEILING}], ' ')) END) AS text, unnest(range(0, CASE WHEN k <= {CEILING} THEN 1 ELSE ((k + {CEILING} - 1) // {CEILING})::BIGINT END)) AS q FROM j)
{select}{_COUNT('text')}::INTEGER AS tokens, k > {TARGET} AS oversize"""


ORACLE_SQL = {
    "src_docx": f"""WITH {_FILE_LINES}, x AS (SELECT doc_id, l[1] AS top, unnest(range(2, len(l) + 1)) AS i, unnest(l[2:]) AS line FROM f), y AS (SELECT *, {_STRIP.format('line')} AS t FROM x)
SELECT doc_id || '.docx' AS path, row_number() OVER (PARTITION BY doc_id ORDER BY i)::INTEGER AS n, {_STRIP.format('top')} AS section_path, 'paragraph' AS kind, t AS text, '¶' || i AS locator, NULL AS problem FROM y WHERE t <> '' UNION ALL {_FAULTS.format('.docx')}""",
    "src_epub": f"""WITH {_FILE_LINES}, h AS (SELECT doc_id, l, (len(l) + 1) // 2 AS half FROM f), c AS (SELECT doc_id, 1 AS chapter, l[1:half] AS l FROM h UNION ALL SELECT doc_id, 2, l[half + 1:] FROM h),
x AS (SELECT doc_id, chapter, {_ONE_SPACE.format('l[1]')} AS top, unnest(range(2, len(l) + 1)) AS i, unnest(l[2:]) AS line FROM c), y AS (SELECT *, {_ONE_SPACE.format('line')} AS t FROM x)
SELECT doc_id || '.epub' AS path, row_number() OVER (PARTITION BY doc_id ORDER BY chapter, i)::INTEGER AS n, ['one', 'two'][chapter] || CASE WHEN top <> '' THEN ' > ' || top ELSE '' END AS section_path, 'p' AS kind, t AS text,
  ['a', 'b'][chapter] || '.html#b' || row_number() OVER (PARTITION BY doc_id, chapter ORDER BY i) AS locator, NULL AS problem FROM y WHERE t <> '' UNION ALL {_FAULTS.format('.epub')}""",
    "src_markdown": f"WITH {_MD} SELECT doc_id, block, section_path, kind, text, first_line FROM bl",
    "src_dispatch": f"""WITH {_MD} SELECT 'md' AS type, count(DISTINCT doc_id) AS docs FROM bl WHERE doc_id % 2 = 0 UNION ALL SELECT 'txt', count(DISTINCT doc_id) FROM ({_CHUNKS}) WHERE doc_id % 2 = 1 UNION ALL SELECT 'html', count(*) FROM pages WHERE html IS NOT NULL""",
    "src_front_matter": """SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN '"' || c_name || '"' END AS title, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 3 <> 0 THEN c_custkey::VARCHAR END AS n,
CASE WHEN c_custkey % 5 = 0 THEN '---' || chr(10) || 'title: "' || c_name || '"' || chr(10) || 'n: ' || CASE WHEN c_custkey % 3 = 0 THEN '{bad' ELSE c_custkey::VARCHAR END || chr(10) ELSE '' END || 'body ' || c_custkey AS body, c_custkey % 5 = 0 AS broken FROM customer""",
    "src_front_matter_lenient": "SELECT c_custkey, c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN 'one|two' ELSE 'x y|z' END AS variants FROM customer",
    "src_corpus": """WITH d AS (SELECT doc_id AS k, doc_id::VARCHAR AS key, doc_id % 7 <> 0 AS i, doc_id % 19 <> 0 AS p FROM documents)
SELECT key, 'not in index' AS problem FROM d WHERE NOT i AND p UNION ALL SELECT key, 'not on disk' FROM d WHERE i AND NOT p UNION ALL SELECT key, 'hash' FROM d WHERE i AND p AND k % 11 = 0 UNION ALL SELECT key, 'length' FROM d WHERE i AND p AND k % 13 = 0
UNION ALL SELECT key, 'date' FROM d WHERE i AND k % 17 = 0 UNION ALL SELECT key, 'address' FROM d WHERE i AND k % 5 = 0""",
    "src_jsonl": """WITH n AS (SELECT conv_id, turn, conv_id + turn AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS line FROM conversations)
SELECT conv_id, line::INTEGER AS line, CASE WHEN k % 7 <> 0 THEN turn END AS id, CASE WHEN k % 7 = 0 THEN 'line ' || line || ': no JSON' END AS problem FROM n WHERE k % 5 <> 0""",
    "src_pdf_pages": r"""SELECT conv_id, 'p.' || (turn + 1) AS locator, f::INTEGER AS first_line, sha256(text) AS sha FROM (SELECT conv_id, turn, min(pos) AS f, string_agg(line, chr(10) ORDER BY pos) AS text FROM (
SELECT *, sum(blank::INT) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS island FROM (SELECT *, trim(regexp_replace(line, '\s+', ' ', 'g')) = '' AS blank FROM (
SELECT conv_id, turn, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS line FROM (SELECT conv_id, turn, string_split(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), chr(10)) AS l FROM conversations)))) WHERE NOT blank GROUP BY conv_id, turn, island)""",
    "src_crawl_index": r"""WITH a AS (SELECT page_id, regexp_extract_all(html, '(?s)(<a\s[^>]*href="[^"]*"[^>]*>.*?</a>)') AS l FROM pages), u AS (SELECT page_id, unnest(range(len(l)))::INTEGER AS pos, unnest(l) AS x FROM a),
p AS (SELECT page_id AS page, pos, regexp_extract(x, 'href="([^"#]*)', 1) AS url, trim(regexp_replace(regexp_replace(x, '(?s)<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS label FROM u)
SELECT page, url, regexp_replace(label, ',\s+see\s+.+$', '') AS label, pos FROM p QUALIFY row_number() OVER (PARTITION BY page, url ORDER BY pos) = 1""",
    "doc_slugs": """WITH p AS (SELECT DISTINCT lower(p_brand) || '/' || replace(p_type, ' ', '-') || '/' || CASE WHEN p_partkey % 3 = 0 THEN p_partkey::VARCHAR ELSE replace(p_name, ' ', '-') END AS path FROM part), l AS (SELECT path, list_last(string_split(path, '/')) AS k FROM p)
SELECT path, CASE WHEN count(*) OVER (PARTITION BY k) > 1 THEN replace(path, '/', '--') ELSE k END AS slug FROM l""",
    "doc_front_matter": f"SELECT doc_id, sha256(array_to_string(list_transform(l, lambda x, i: CASE WHEN i = 1 THEN '## ' WHEN (i - 1) % 7 = 2 THEN '### ' WHEN (i - 1) % 7 = 3 THEN '- ' ELSE '' END || x), chr(10) || chr(10))) AS sha FROM ({_LINES})",
    "doc_lede": f"WITH {_MD} SELECT doc_id, arg_min(text, block) FILTER (kind = 'paragraph') AS lede, arg_min(text, block) FILTER (kind = 'list') AS first_list FROM bl GROUP BY doc_id",
    "chunk_paragraph": "WITH RECURSIVE ck AS (" + _CHUNKS + "), " + _window_sql("chunk_id", "ck", "SELECT chunk_id, (row_number() OVER (PARTITION BY chunk_id ORDER BY n, q) - 1)::INTEGER AS part, text, ") + " FROM pc",
    "chunk_table": """WITH RECURSIVE r AS (SELECT o_custkey, list('key: ' || o_orderkey || ' | order priority: ' || o_orderpriority ORDER BY o_orderkey) AS l, list(5 + len(string_split(o_orderpriority, ' ')) ORDER BY o_orderkey) AS c FROM orders GROUP BY 1),
g AS (SELECT o_custkey, l, c, 1::BIGINT AS a, 0 AS n FROM r UNION ALL SELECT o_custkey, l, c, e + 1, n + 1 FROM (SELECT *, greatest(a, coalesce(list_max(list_filter(range(a, len(c) + 1), lambda k: 4 + list_sum(c[a:k]) <= 40)), a)) AS e FROM g) WHERE e < len(c)),
f AS (SELECT *, greatest(a, coalesce(list_max(list_filter(range(a, len(c) + 1), lambda k: 4 + list_sum(c[a:k]) <= 40)), a)) AS e FROM g)
SELECT o_custkey, n::INTEGER AS part, 'key | order priority' || chr(10) || array_to_string(l[a:e], chr(10)) AS text, (4 + list_sum(c[a:e]))::INTEGER AS tokens FROM f""",
    "chunk_code": f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(0, greatest(1, (len(w) + {CEILING} - 1) // {CEILING})))::INTEGER AS part, t, w FROM w)
SELECT doc_id, part, CASE WHEN len(w) <= {CEILING} THEN len(w) ELSE len(w[part * {CEILING} + 1:(part + 1) * {CEILING}]) END::INTEGER AS tokens, sha256(CASE WHEN len(w) <= {CEILING} THEN t ELSE array_to_string(w[part * {CEILING} + 1:(part + 1) * {CEILING}], ' ') END) AS sha FROM p""",
    "chunk_ceiling_split": f"""WITH w AS (SELECT item_id, text AS t, {_WORDS('text')} AS w FROM benchmark), p AS (SELECT item_id, unnest(range(0, greatest(1, (len(w) + 6) // 7)))::INTEGER AS part, t, w FROM w)
SELECT item_id, part, CASE WHEN len(w) <= 7 THEN t ELSE array_to_string(w[part * 7 + 1:(part + 1) * 7], ' ') END AS piece FROM p""",
    "chunk_document": f"WITH RECURSIVE {_MD}" + ", " + _window_sql("doc_id, block, section_path, kind, first_line", "bl", "SELECT doc_id, block, (row_number() OVER (PARTITION BY doc_id, block ORDER BY n, q) - 1)::INTEGER AS part, section_path, kind, 'L' || first_line AS locator, text, ") + " FROM pc",
}
