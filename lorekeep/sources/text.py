"""Sources of text: paragraphs with line locators, JSON lines, blocks and tables of web pages with locators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, first_line, last_line, text: blocks between blank lines; locators are 1-based lines.

    A paragraph starts at a line with text after none, and ends at one before none: both are found in the array of a document's own lines, so texts are never shuffled."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.split(text_col, "\n").alias("_lines"))
    d = d.withColumn("_full", F.transform("_lines", lambda x: F.regexp_like(x, F.lit(r"[^\s]"))))
    at = lambda i: F.coalesce(F.get("_full", i), F.lit(False))
    borders = lambda step: F.filter(F.transform("_full", lambda x, i: F.when(x & ~at(i + step), i)), lambda i: i.isNotNull())
    d = d.withColumn("_first", borders(-1)).withColumn("_last", borders(1))
    d = d.select("doc_id", "_lines", F.explode(F.arrays_zip("_first", "_last")).alias("_p"))
    first, last = F.col("_p._first"), F.col("_p._last")
    return d.select("doc_id", (first + 1).alias("first_line"), (last + 1).alias("last_line"), F.array_join(F.slice("_lines", first + 1, last - first + 1), "\n").alias("text"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file or folder with `_corrupt_record` for lines that don't parse; blank lines are skipped."""
    return spark.read.schema(f"{schema}, _corrupt_record string").json(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with rows of new in place of those with the same keys; new's keys are unique."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def slices_of(batches: Iterable[pa.RecordBatch], column: int = 1, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the texts of a part have about `limit` bytes, which bounds what a task holds."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start = 0
        while start < batch.num_rows:
            stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


class Blocks(HTMLParser):
    """Headings, paragraphs, list items, tables and other text of a page as (path, kind, text, locator). The locator is the id of the nearest heading, else the block's number."""

    HEADINGS = {f"h{i}": i for i in range(1, 7)}
    BLOCKS = {"p", "li", "blockquote", "pre", "div", "section", "article", "main", "ul", "ol", "table", "nav", "footer", "header"}
    HIDDEN = ("script", "style", "head")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str, str, str]] = []
        self.path: list[tuple[int, str]] = []
        self.kind, self.text, self.hidden, self.anchor, self.next_anchor = "text", [], 0, "", ""
        self.table: list[list[str]] | None = None

    def emit(self, kind: str, text: str) -> None:
        self.out.append((" > ".join(t for _, t in self.path), kind, text, f"#{self.anchor}" if self.anchor else f"b{len(self.out) + 1}"))

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if self.table is not None:
            if text and self.table and self.table[-1]:
                self.table[-1][-1] = f"{self.table[-1][-1]} {text}".strip()
        elif text and self.kind in self.HEADINGS:
            level = self.HEADINGS[self.kind]
            self.path = [p for p in self.path if p[0] < level] + [(level, text)]
            self.anchor = self.next_anchor
        elif text:
            self.emit(self.kind, text)

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag == "table" and self.table is None:
            self.flush()
            self.table = []
        elif self.table is not None:
            if tag == "tr":
                self.flush()
                self.table.append([])
            elif tag in ("td", "th"):
                self.flush()
                self.table = self.table or [[]]
                self.table[-1].append("")
        elif tag in self.HEADINGS or tag in self.BLOCKS:
            self.flush()
            self.kind = tag if tag in self.HEADINGS or tag in ("p", "li", "blockquote", "pre") else "text"
            self.next_anchor = dict(attrs).get("id") or "" if tag in self.HEADINGS else self.next_anchor

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif self.table is not None:
            if tag in ("td", "th", "tr", "table"):
                self.flush()
            if tag == "table":
                rows, self.table = [r for r in self.table if any(r)], None
                if rows:
                    head = rows[0]
                    lines = [" | ".join(f"{h}: {v}" for h, v in zip(head, r, strict=False)) for r in rows[1:]]
                    self.emit("table", "\n".join([" | ".join(head), *lines]))
        elif tag in self.HEADINGS or tag in self.BLOCKS:
            self.flush()
            self.kind = "text"

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, n, section_path, kind, text, locator: blocks of each page in order. A null page has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices_of(batches):
            rows = []
            for key, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                parser = Blocks()
                parser.feed(page or "")
                parser.close()
                parser.flush()
                rows += [(key, i, *b) for i, b in enumerate(parser.out, 1)]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["page_id", "n", "section_path", "kind", "text", "locator"])

    return pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, n int, section_path string, kind string, text string, locator string")
