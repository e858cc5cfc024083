"""Blocks of .docx and .epub files read with spark.read.format("binaryFile"): a file is one row in, its blocks are rows out. A file that cannot be read gives one row with its problem."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

from lorekeep.sources.text import Blocks

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SCHEMA = "path string, n int, section_path string, kind string, text string, locator string, problem string"


def docx_blocks(content: bytes) -> list[tuple[str, str, str, str]]:
    """(section path, kind, text, locator) of paragraphs and tables; the styles Heading1 to Heading9 make the path, locators count paragraphs (¶1 is the first)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out, path, n = [], [], 0
    said = lambda p: "".join(("\t" if e.tag == f"{_W}tab" else e.text or "") for e in p.iter() if e.tag in (f"{_W}t", f"{_W}tab")).strip()
    for e in body if body is not None else ():
        where = " > ".join(path)
        if e.tag == f"{_W}p":
            n += 1
            style = e.find(f"{_W}pPr/{_W}pStyle")
            level = re.fullmatch(r"Heading([1-9])", style.get(f"{_W}val", "") if style is not None else "")
            text = said(e)
            if level and text:
                path = [*path[: int(level[1]) - 1], text]
            elif text:
                out.append((where, "paragraph", text, f"¶{n}"))
        elif e.tag == f"{_W}tbl":
            first, rows = n + 1, []
            for row in e.iter(f"{_W}tr"):
                cells = list(row.iter(f"{_W}p"))
                n += len(cells)
                rows.append("\t".join(said(c) for c in cells))
            if any(r.strip() for r in rows):
                out.append((where, "table", "\n".join(rows), f"¶{first}"))
    return out


def epub_blocks(content: bytes) -> list[tuple[str, str, str, str]]:
    """Blocks of the chapters in the order of the spine; a chapter's id leads its paths, its address its locators."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("META-INF/container.xml"))
        package = next(e.get("full-path") for e in root.iter() if e.tag.endswith("}rootfile"))
        opf = ElementTree.fromstring(z.read(package))
        items = {e.get("id"): e.get("href") for e in opf.iter() if e.tag.endswith("}item")}
        out = []
        for ref in (e.get("idref") for e in opf.iter() if e.tag.endswith("}itemref")):
            if ref not in items:
                continue
            parser = Blocks()
            parser.feed(z.read(posixpath.normpath(posixpath.join(posixpath.dirname(package), items[ref]))).decode("utf-8", "replace"))
            parser.close()
            parser.flush()
            out += [(" > ".join(filter(None, (ref, where))), kind, text, f"{items[ref]}#{place.lstrip('#')}") for where, kind, text, place in parser.out]
    return out


READERS = {"docx": docx_blocks, "epub": epub_blocks}


def office_blocks(files: DataFrame) -> DataFrame:
    """path, n, section_path, kind, text, locator, problem. files: path, content; the ending of the path tells the type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one file at a time
                path, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                read = READERS.get((path or "").rsplit(".", 1)[-1].lower())
                try:
                    rows = [(path, n, *b, None) for n, b in enumerate(read(content or b""), 1)] if read else [(path, 0, None, None, None, None, "unknown type")]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, StopIteration) as e:
                    rows = [(path, 0, None, None, None, None, f"unreadable: {type(e).__name__}")]
                cols = list(zip(*rows, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), *[pa.string()] * 5), strict=True)], ["path", "n", "section_path", "kind", "text", "locator", "problem"])

    return files.select("path", "content").mapInArrow(run, SCHEMA)
