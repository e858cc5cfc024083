"""Markdown, front matter, page texts and file indexes as rows.

A document's text is one row in and its blocks are rows out; only the block structure is read in Python, on Arrow batches cut by size."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.sources.text import slices_of

_FENCE = re.compile(r"^ {0,3}(```+|~~~+)")
_ITEM = re.compile(r"^\s*(?:[-*+]|[0-9]{1,9}[.)])\s+(.*)$")
_RULE = re.compile(r"^\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?$")
BLOCK = "doc_id long, block int, section_path string, kind string, text string, header array<string>, rows array<array<string>>, first_line int, last_line int"


def plain(text: str) -> str:
    """Inline marks dropped: emphasis, code ticks, links and images keep their words."""
    if "[" in text:
        text = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", text)
    if not ("*" in text or "`" in text or "__" in text):
        return text.strip()
    return re.sub(r"(\*\*|__|`)(.+?)\1|(?<![\w*])\*([^*]+)\*(?![\w*])", lambda m: m[2] or m[3], text).strip()


def heading(line: str) -> tuple[int, str] | None:
    """(level, text) of a heading: one to six marks after three spaces at most; marks that close the line after a space are dropped. No pattern, as one would try each space of a long line as the last."""
    if "#" not in line[:4]:
        return None
    bare = line.lstrip(" ")
    rest = bare.lstrip("#")
    level = len(bare) - len(rest)
    if len(line) - len(bare) > 3 or not 1 <= level <= 6 or rest[:1] not in ("", " ", "\t"):
        return None
    text = rest.strip(" \t")
    open_end = text.rstrip("#")
    return level, open_end.rstrip(" \t") if open_end[-1:] in (" ", "\t") else text


def fence(line: str) -> re.Match | None:
    """Most lines lack the mark where it must stand; the pattern is tried on the others alone. So too below."""
    return _FENCE.match(line) if "`" in line[:4] or "~" in line[:4] else None


def item(line: str) -> re.Match | None:
    return _ITEM.match(line) if line.lstrip()[:1] in "-*+0123456789" else None


def cells(line: str) -> list[str]:
    return [plain(c) for c in line.strip().strip("|").split("|")]


def blocks(text: str | None) -> Iterator[tuple]:
    """(section path, kind, text, header, rows, first line, last line) of each block: paragraph, list, code or table. Headings only make the path."""
    lines, path, i = (text or "").split("\n"), [], 0
    ends = lambda k: k >= len(lines) or not lines[k].strip() or heading(lines[k]) or fence(lines[k])
    while i < len(lines):
        start, line = i, lines[i]
        if not line.strip():
            i += 1
            continue
        where = " > ".join(path)
        if m := heading(line):
            path = [*path[: m[0] - 1], plain(m[1])]
            i += 1
        elif m := fence(line):
            i += 1
            while i < len(lines) and not lines[i].strip().startswith(m[1]):
                i += 1
            yield where, "code", "\n".join(lines[start + 1 : i]), None, None, start + 1, min(i + 1, len(lines))
            i += 1
        elif "|" in line and i + 1 < len(lines) and "-" in lines[i + 1] and _RULE.match(lines[i + 1].strip()):
            i += 2
            while not ends(i) and "|" in lines[i]:
                i += 1
            yield where, "table", "", cells(line), [cells(x) for x in lines[start + 2 : i]], start + 1, i
        elif item(line):
            items: list[str] = []
            while i < len(lines) and (not ends(i) or (not lines[i].strip() and i + 1 < len(lines) and item(lines[i + 1]))):
                if m := item(lines[i]):
                    items.append(plain(m[1]))
                elif lines[i].strip():
                    items[-1] += " " + plain(lines[i])
                i += 1
            yield where, "list", "\n".join("- " + x for x in items), None, None, start + 1, i
        else:
            while not ends(i) and not (i > start and item(lines[i])):
                i += 1
            yield where, "paragraph", " ".join(plain(x) for x in lines[start:i]), None, None, start + 1, i


def markdown_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, block, section_path, kind, text, header, rows, first_line, last_line. Null and empty texts have no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices_of(batches):
            rows = [(key, n, *b) for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for n, b in enumerate(blocks(text))]
            cols = list(zip(*rows, strict=True)) or [()] * 9
            types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.list_(pa.string())), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "block", "section_path", "kind", "text", "header", "rows", "first_line", "last_line"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, BLOCK)


def locator(first: Column, last: Column) -> Column:
    return F.when(first == last, F.concat(F.lit("L"), first.cast("string"))).otherwise(F.concat(F.lit("L"), first.cast("string"), F.lit("-L"), last.cast("string")))


def front_matter(text: Column, keys: list[str]) -> tuple[Column, Column, Column]:
    """(map of the keys that have a JSON value, the body, whether the fence is broken). Values are JSON, one a line between --- fences."""
    head = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    body = F.when(head != "", F.regexp_replace(text, r"(?s)\A---\n.*?\n---(?:\n|\z)", "")).otherwise(text)
    values = F.create_map(*[x for k in keys for x in (F.lit(k), F.nullif(F.regexp_extract(head, rf"(?m)^{k}: (.*)$", 1), F.lit("")))])
    good = F.map_filter(values, lambda _, v: v.isNotNull() & F.try_parse_json(v).isNotNull())
    return good, body, F.startswith(text, F.lit("---\n")) & (head == "")


def lenient_front_matter(text: Column) -> Column:
    """Map of key to array of values: `key: value`, `key: [a, b]` or `- value` lines below a key, quotes dropped."""
    head = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    entries = F.regexp_extract_all(F.regexp_replace(head, r"\n\s*-\s+", "\x1e"), F.lit(r"(?m)^([A-Za-z_]+:.*)$"), F.lit(1))
    bare = lambda v: F.regexp_replace(F.trim(v), r"""^["']|["']$""", "")
    raw = lambda e: F.regexp_replace(F.regexp_replace(e, r"^[A-Za-z_]+:\s*", ""), r"^\[|\]$", "")
    parts = lambda e: F.filter(F.transform(F.when(F.contains(e, F.lit("\x1e")), F.split(raw(e), "\x1e")).when(F.regexp_like(e, F.lit(r":\s*\[")), F.split(raw(e), ",")).otherwise(F.array(raw(e))), bare), lambda v: v != "")
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(F.regexp_extract(e, r"^([A-Za-z_]+):", 1).alias("key"), parts(e).alias("value"))))


def corpus_problems(index: DataFrame, pages: DataFrame) -> DataFrame:
    """key, problem of an index (key, sha256, bytes, url, date) against the pages on disk (key, body): missing on either side, wrong hash, length, date or address."""
    both = index.join(pages, "key", "full_outer")
    body = F.col("body")
    problems = F.array_compact(F.array(
        F.when(F.col("sha256").isNull(), "not in index"), F.when(body.isNull(), "not on disk"), F.when(F.sha2(body, 256) != F.col("sha256"), "hash"),
        F.when(F.octet_length(body) != F.col("bytes"), "length"), F.when(~F.regexp_like("date", F.lit(r"^\d{4}-\d{2}-\d{2}$")), "date"), F.when(~F.startswith(F.col("url"), F.lit("https://")), "address"),
    ))
    return both.select("key", F.explode(problems).alias("problem"))


def slugs(pages: DataFrame, path: str) -> DataFrame:
    """path, slug: the last part of a path, or the whole path joined by -- where that part is not the path's alone."""
    p = pages.select(path).distinct().withColumn("_last", F.substring_index(path, "/", -1))
    same = p.groupBy("_last").agg(F.count("*").alias("_n"))
    return p.join(same, "_last").select(path, F.when(F.col("_n") > 1, F.replace(F.col(path), F.lit("/"), F.lit("--"))).otherwise(F.col("_last")).alias("slug"))


def demote(text: Column) -> Column:
    """Headings one level down, the sixth stays."""
    return F.regexp_replace(text, r"(?m)^(#{1,5}) ", "#$1 ")


def crawl_links(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """page, url, label, see, pos: the links of a page, the first of each address; "X, see Y" is another name of Y."""
    found = F.regexp_extract_all(html_col, F.lit(r'(?s)(<a\s[^>]*href="[^"]*"[^>]*>.*?</a>)'), F.lit(1))
    links = pages.select(F.col(id_col).alias("page"), F.posexplode(found).alias("pos", "a"))
    links = links.select("page", "pos", F.regexp_extract("a", r'href="([^"#]*)', 1).alias("url"), F.trim(F.regexp_replace(F.regexp_replace("a", r"(?s)<[^>]*>", ""), r"\s+", " ")).alias("label"))
    first = links.groupBy("page", "url").agg(F.min(F.struct("pos", "label")).alias("m"))
    see = F.nullif(F.regexp_extract("m.label", r"^.*?,\s+see\s+(.+)$", 1), F.lit(""))
    return first.select("page", "url", F.regexp_replace("m.label", r",\s+see\s+.+$", "").alias("label"), see.alias("see"), "m.pos")


def numbered_lines(files: DataFrame, name: str, text: str, schema: str) -> DataFrame:
    """JSON lines of whole files: file, line (from 1), record, problem. Blank lines are skipped and still counted."""
    lines = files.select(F.col(name).alias("file"), F.posexplode(F.split(text, "\n")).alias("pos", "raw")).where(F.trim("raw") != "")
    record = F.from_json("raw", schema)
    broken = F.try_parse_json("raw").isNull()
    return lines.select("file", (F.col("pos") + 1).alias("line"), F.when(~broken, record).alias("record"), F.when(broken, F.concat(F.lit("line "), (F.col("pos") + 1).cast("string"), F.lit(": no JSON"))).alias("problem"))
