"""Chunks of documents: windows of whole sentences with an overlap, tables by rows under their header, code whole, and small neighbours merged.

Sentences, counts and texts are JVM expressions; only where a window ends depends on the windows before it, and that one number run is found on Arrow batches. Tokens are words by
white space or pieces of a vocabulary; the count of a joined text is the sum of its parts, and what frames it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lorekeep.functions import language as L
from lorekeep.functions import text as T
from lorekeep.sources.markdown import locator

TARGET, OVERLAP, CEILING, MERGE_TARGET, MERGE_MAX = 400, 18, 512, 150, 256
SPANS = ArrayType(StructType([StructField("a", IntegerType()), StructField("b", IntegerType())]))
DRAFTS = "array<struct<text: string, tokens: int, oversize: boolean>>"


def window_spans(counts: np.ndarray, target: int, overlap: int) -> list[tuple[int, int]]:
    """Windows [a, b) over sentences of the given sizes: as many as fit the target, at least one; the next one starts at the longest run of last sentences that has at most overlap % of the window's tokens (whole per cents, rounded down), and later than this one did."""
    total = np.concatenate(([0], np.cumsum(counts)))
    out, a, n = [], 0, len(counts)
    while a < n:
        if counts[a] > target:
            out.append((a, a + 1))
            a += 1
            continue
        b = int(np.searchsorted(total, total[a] + target, "right")) - 1
        out.append((a, b))
        if b >= n:
            break
        budget = int(total[b] - total[a]) * overlap // 100
        # the last sentence is always repeated; more only as far as they fit
        back = min(b - 1, int(np.searchsorted(total, total[b] - budget, "left")))
        a = max(back, a + 1)
    return out


def row_spans(counts: list[int], header: int, target: int) -> list[tuple[int, int]]:
    """Groups [a, b) of table rows that fit the target under their header; at least one row each."""
    out, a, used = [], 0, header
    for i, c in enumerate(counts):
        if i > a and used + c > target:
            out.append((a, i))
            a, used = i, header
        used += c
    return [*out, (a, len(counts))] if len(counts) else out


def merge_spans(kinds: list[str], blocks: list[int], counts: list[int], intro: list[bool], target: int, most: int) -> list[tuple[int, int]]:
    """Runs [a, b) of a section's drafts that become one chunk: tables and code alone, windows of one block never together, a list with the paragraph that introduces it up to `most`, others up to the target."""
    out: list[tuple[int, int]] = []
    a = 0
    for i, kind in enumerate(kinds):
        size = sum(counts[a : i + 1])
        if i == a:
            continue
        if kind in ("table", "code") or kinds[i - 1] in ("table", "code") or blocks[i - 1] == blocks[i]:
            out.append((a, i))
            a = i
        elif kind == "list" and kinds[i - 1] == "paragraph" and intro[i - 1]:
            if size > most:
                if i - 1 > a:
                    out.append((a, i - 1))
                a = i - 1
                if counts[i - 1] + counts[i] > most:
                    out.append((a, i))
                    a = i
        elif size > target:
            out.append((a, i))
            a = i
    return [*out, (a, len(kinds))] if kinds else out


def _spans(rows: list[list[tuple[int, int]]]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows], dtype=np.int64))).astype(np.int32)
    ends = np.array([s for r in rows for s in r], np.int32).reshape(-1, 2)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"]))


def _joined(texts: pa.Array, spans: list[list[tuple[int, int]] | None], by: str) -> pa.Array:
    return pa.array([None if r is None else [by.join(t for t in x[a:b] if t is not None) for a, b in r] for x, r in zip(texts.to_pylist(), spans, strict=True)], pa.list_(pa.string()))


def windows(taken: Column, target: int = TARGET, overlap: int = OVERLAP) -> Column:
    """The texts of window_spans() over what a counter's taken() gives, null without sentences. They are joined where the spans are found: an expression would take the text apart again for each window."""

    @F.arrow_udf(ArrayType(StringType()))
    def find(t: pa.Array) -> pa.Array:
        counts, sentences = (pc.struct_field(t, i) for i in (0, 1))
        spans = [None if not x else [(0, len(x))] if sum(x) <= target else window_spans(np.array(x, np.int64), target, overlap) for x in counts.to_pylist()]
        return _joined(sentences, spans, " ")

    return find(taken)


def row_groups(lines: Column, counts: Column, header: Column, target: int = TARGET) -> Column:
    """The texts of row_spans(), without their header."""

    @F.arrow_udf(ArrayType(StringType()))
    def find(s: pa.Array, c: pa.Array, h: pa.Array) -> pa.Array:
        return _joined(s, [row_spans(x or [], n or 0, target) for x, n in zip(c.to_pylist(), h.to_pylist(), strict=True)], "\n")

    return find(lines, counts, header)


def once(value: Column, use) -> Column:
    """use(value), with value worked out once. An expression named inside a function over an array is worked out again for each element; a function's own argument is not."""
    return F.get(F.transform(F.array(value), use), 0)


def words_of(text: Column) -> Column:
    return F.filter(F.split(T.collapse_ws(text), " "), lambda w: w != "")


def runs(text: Column, words: Column, ceiling: int) -> Column:
    """(text, tokens): a text as it is, or its words in runs of `ceiling` if it has more."""
    run = lambda i: once(F.slice(words, i * ceiling + 1, F.lit(ceiling)), lambda ws: F.struct(F.array_join(ws, " ").alias("text"), F.size(ws).alias("tokens")))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(words) / ceiling).cast("int") - 1)), run)
    return F.when(F.size(words) <= ceiling, F.array(F.struct(text.alias("text"), F.size(words).alias("tokens")))).otherwise(cut)


def pieces(text: Column, ceiling: int = CEILING) -> Column:
    """The texts of runs()."""
    return F.transform(once(words_of(text), lambda ws: runs(text, ws, ceiling)), lambda p: p["text"])


class Words:
    """The counter that needs no vocabulary: words by white space, in the JVM. Others have the same members (see functions.wordpiece)."""

    extra = 0

    def counts(self, texts: Column) -> Column:
        return F.transform(texts, lambda x: T.count_words(x))

    def taken(self, text: Column, target: int) -> Column:
        """(counts, sentences) of a text for windows(); none if it is one window and its sentences give it back as it is: then nothing in it need be taken apart. A word and its space take two characters, so most texts needn't be counted for that.

        None are empty arrays: for null ones Spark's Arrow writer goes over the batch again with each row."""
        fits = ((F.length(text) <= 2 * target) | (T.count_words(text) <= target)) & L.even(text)
        nothing = F.struct(F.array().cast("array<int>").alias("counts"), F.array().cast("array<string>").alias("sentences"))
        return F.when(fits, nothing).otherwise(once(L.split_sentences(text), lambda s: F.struct(self.counts(s).alias("counts"), s.alias("sentences"))))

    def whole(self, text: Column) -> Column:
        """The draft of a text that is one window; of a blank one none."""
        return F.when(~L.blank(text), F.array(F.struct(F.trim(text).alias("text"), T.count_words(text).alias("tokens"), F.lit(False).alias("oversize"))))

    def sized(self, texts: Column, ceiling: int, counted: bool) -> Column:
        """For each text of an array, its tokens (of no meaning unless counted) and what it is cut into: (tokens, pieces of (text, tokens))."""
        return F.transform(texts, lambda t: once(words_of(t), lambda ws: F.struct(F.size(ws).alias("tokens"), runs(t, ws, ceiling).alias("pieces"))))


WORDS = Words()


def drafts(joined: Column, ceiling: int, counter: Words, most: int | None = None) -> Column:
    """(text, tokens, oversize) of texts that are cut where they pass the ceiling; oversize if one has more than `most`."""
    large = lambda x: x["tokens"] + counter.extra > most if most is not None else F.lit(False)
    each = lambda x: F.transform(x["pieces"], lambda p: F.struct(p["text"].alias("text"), p["tokens"].alias("tokens"), large(x).alias("oversize")))
    return F.flatten(F.transform(counter.sized(joined, ceiling, most is not None), each))


def paragraph_chunks(text: Column, target: int = TARGET, overlap: int = OVERLAP, ceiling: int = CEILING, counter: Words = WORDS) -> Column:
    """Array of (text, tokens, oversize): windows of sentences; a sentence over the target is one chunk, over the ceiling several."""
    most = min(target, ceiling)
    joined = windows(counter.taken(text, most - counter.extra), most - counter.extra, overlap)
    return F.coalesce(drafts(joined, ceiling, counter, most), counter.whole(text), F.array().cast(DRAFTS))


def table_chunks(header: Column, rows: Column, target: int = TARGET, ceiling: int = CEILING, counter: Words = WORDS) -> Column:
    """Array of (text, tokens, oversize): rows as "name: value | ..." under the header line, which every chunk repeats."""
    lines = F.transform(rows, lambda r: F.array_join(F.transform(F.slice(r, F.lit(1), F.least(F.size(header), F.size(r))), lambda v, i: F.concat(F.get(header, i), F.lit(": "), v)), " | "))
    head = F.array_join(header, " | ")
    groups = row_groups(lines, counter.counts(lines), F.get(counter.counts(F.array(head)), 0), target - counter.extra)
    joined = F.transform(groups, lambda g: F.concat(head, F.lit("\n"), g))
    return drafts(joined, ceiling, counter)


def code_chunks(text: Column, ceiling: int = CEILING, counter: Words = WORDS) -> Column:
    return drafts(F.array(text), ceiling, counter)


def chunk_blocks(blocks: DataFrame, target: int = TARGET, overlap: int = OVERLAP, ceiling: int = CEILING, counter: Words = WORDS) -> DataFrame:
    """doc_id, block, part, section_path, kind, locator, text, tokens, oversize: the drafts of each block of markdown_blocks(). Blocks are cut one by one: no shuffle, and no chunk crosses a section."""
    prose = F.when(F.col("kind").isin("code", "table"), "").otherwise(F.col("text"))
    some = F.when(F.col("kind") == "code", code_chunks(F.col("text"), ceiling, counter)).when(F.col("kind") != "table", paragraph_chunks(prose, target, overlap, ceiling, counter))
    every = F.coalesce(some, table_chunks(F.coalesce("header", F.array().cast("array<string>")), F.coalesce("rows", F.array().cast("array<array<string>>")), target, ceiling, counter))
    b = blocks.select("doc_id", "block", "section_path", "kind", "first_line", "last_line", F.posexplode(every).alias("part", "c"))
    return b.select("doc_id", "block", "part", "section_path", "kind", "first_line", "last_line", locator(F.col("first_line"), F.col("last_line")).alias("locator"), "c.text", "c.tokens", "c.oversize")


def merge_chunks(drafts: DataFrame, target: int = MERGE_TARGET, most: int = MERGE_MAX) -> DataFrame:
    """doc_id, section_path, place, locator, text, tokens, oversize: drafts of chunk_blocks() with small neighbours of a section joined by a blank line. One document's section is one group."""

    @F.arrow_udf(SPANS)
    def find(kinds: pa.Array, blocks: pa.Array, counts: pa.Array, intro: pa.Array) -> pa.Array:
        rows = zip(kinds.to_pylist(), blocks.to_pylist(), counts.to_pylist(), intro.to_pylist(), strict=True)
        return _spans([merge_spans(*r, target, most) for r in rows])

    d = F.struct("block", "part", "kind", "first_line", "last_line", "locator", "text", "tokens", "oversize")
    g = drafts.groupBy("doc_id", "section_path").agg(F.array_sort(F.collect_list(d)).alias("d"))
    spans = find(F.transform("d", lambda x: x["kind"]), F.transform("d", lambda x: x["block"]), F.transform("d", lambda x: x["tokens"]), F.transform("d", lambda x: F.regexp_like(x["text"], F.lit(r":\s*$"))))
    g = g.select("doc_id", "section_path", F.posexplode(F.transform(spans, lambda w: F.slice("d", w["a"] + 1, w["b"] - w["a"]))).alias("place", "r"))
    return g.select(
        "doc_id", "section_path", "place", locator(F.get("r", 0)["first_line"], F.element_at("r", -1)["last_line"]).alias("locator"), F.array_join(F.transform("r", lambda x: x["text"]), "\n\n").alias("text"),
        F.aggregate("r", F.lit(0), lambda s, x: s + x["tokens"]).alias("tokens"), F.exists("r", lambda x: x["oversize"]).alias("oversize"),
    )
