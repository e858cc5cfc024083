"""Substring dedup with prefix-partitioned suffix trees.

Which suffixes. A window of `window` words is told by its anchor, the word in it where the hash of the next ANCHOR words is least: equal windows have
it at the same place. So the suffixes that start at anchors, about one word in six, are enough, if each carries the words to its left that
windows around its anchor reach. That ships three words a window, not a window's length, and real words, not digests.

Groups. Suffixes are dealt by variable-length prefixes: by the first word where at most `budget` suffixes share it (by bins of its hash), else by the first two, then by ANCHOR
words; each level counts only what the ones before left open. Small bins share a group, so a group fits in memory.

Subtrees. A group's suffixes are sorted word by word, on exact words; the lengths of the common prefixes of neighbours make the tree: a node of depth d is a maximal run of suffixes with
at least d common words. The words to the left, read backwards, make a second tree. Suffixes that meet in a node of the one at depth d and of the other at depth
window - d hold the same window: these are the deep internal nodes, each keeps the smallest id of its documents, and windows in
other documents are repeats. Neighbouring repeats join to maximal repeated spans.

A prefix that is too large at full length (a passage in a large share of all documents) is not gathered: its windows are compared by 64-bit digests,
the smallest id of each is aggregated before and after a shuffle and joined back (odds of a wrong match: windows there squared / 2^65). The prefix table has a size set by
the input's, not by its content: up to some 10^12 words groups keep to the budget; beyond, `bins` and `budget` must grow with memory.

Null texts have no words; texts shorter than the window lose none. Rows with a null id are neither compared nor cut. Repeated
rows (same id, same text) are no repeats of each other, as neither id is smaller."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_text, mix64, slices, word_table

ANCHOR = 3
#: Characters hashed together, and bytes of suffixes that a task holds before it writes them out by group.
SLICE, FLUSH = 1 << 20, 48 << 20
_C = np.uint64(0xD6E8FEB86659FD93)
_SALT = np.uint64(0xA0761D6478BD642F)


class Suffixes(NamedTuple):
    """Anchored suffixes of some documents: document, word position of the anchor, words to the left, windows (one more than words that follow the first), digests of the prefix at each level, and the first
    and last word of the context in `data`."""

    doc: np.ndarray
    pos: np.ndarray
    left: np.ndarray
    windows: np.ndarray
    digests: list[np.ndarray]
    first: np.ndarray
    last: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    node: np.ndarray  # digests of all windows, by the place of their first word


def rolling(h: np.ndarray, size: int) -> np.ndarray:
    """Digest of each run of `size` words."""
    n = max(len(h) - size + 1, 0)
    p = np.zeros(n, np.uint64)
    for k in range(size):
        p = p * _C + h[k : k + n]
    return mix64(p)


def suffixes(ids: list, texts: list, window: int, with_nodes: bool = False) -> Suffixes:
    data, starts, ends, h, counts = word_table([t if k is not None else None for k, t in zip(ids, texts, strict=True)])
    k = min(ANCHOR, window)
    doc_of = np.repeat(np.arange(len(ids)), counts)
    base = np.concatenate(([0], np.cumsum(counts)))[:-1]
    keys = np.array([-1 if i is None else i for i in ids], np.int64)
    n = max(len(h) - window + 1, 0)
    if n:
        grams = mix64(rolling(h, k) ^ _SALT)
        at = np.lib.stride_tricks.sliding_window_view(grams, window - k + 1).argmin(axis=1)[:n] + np.arange(n)
        inside = np.arange(n) + window <= (base + counts)[doc_of[:n]]
        p = np.flatnonzero(inside)
        head = np.flatnonzero(np.concatenate(([True], at[p][1:] != at[p][:-1]))) if len(p) else np.zeros(0, int)  # windows of one anchor follow each other
        first, anchor = p[head], at[p][head]
        windows = np.diff(np.append(head, len(p)))
    else:
        first = anchor = windows = np.zeros(0, np.int64)
    digests = [rolling(h, size)[anchor] if len(anchor) else np.zeros(0, np.uint64) for size in range(1, k + 1)]
    d = doc_of[anchor] if len(anchor) else np.zeros(0, np.int64)
    return Suffixes(keys[d], anchor - base[d] if len(d) else anchor, anchor - first, windows, digests, first, first + windows + window - 2, starts, ends, data, rolling(h, window) if with_nodes else np.zeros(0, np.uint64))


def pack_groups(counts: np.ndarray, budget: int, last: int) -> np.ndarray:
    """The group of each bin, numbered from `last`, bins in order filling groups up to the budget; -1 for a bin that alone exceeds it."""
    out = np.full(len(counts), -1, np.int32)
    size = budget
    last -= 1
    for b in np.flatnonzero((counts > 0) & (counts <= budget)):
        if size + counts[b] > budget:
            size, last = 0, last + 1
        size += counts[b]
        out[b] = last
    return out


def assign(digests: list[np.ndarray], groups: np.ndarray, bins: int) -> np.ndarray:
    """The group of each suffix: of the first level whose bin has one, -1 where none has."""
    out = np.full(len(digests[0]), -1, np.int32)
    for level in range(len(groups)):
        open_ = np.flatnonzero(out == -1)
        if not len(open_):
            break
        out[open_] = groups[level][digests[level][open_] & np.uint64(bins - 1)]
    return out


def pack(doc: np.ndarray, pos: np.ndarray) -> bytes:
    """(document, position) pairs, sorted, as compressed byte planes of their differences."""
    d = np.diff(doc, prepend=np.int64(0))
    p = np.where(d == 0, np.diff(pos, prepend=np.int64(0)), pos)
    planes = np.concatenate([d, p]).astype("<i8").view(np.uint8).reshape(2, len(doc), 8)
    return zlib.compress(np.ascontiguousarray(planes.transpose(0, 2, 1)).tobytes(), 1)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zlib.decompress(blob), np.uint8)
    n = len(raw) // 16
    d, p = np.ascontiguousarray(raw.reshape(2, 8, n).transpose(0, 2, 1)).view("<i8").reshape(2, n)
    doc, first, run = np.cumsum(d), d != 0, np.cumsum(p)
    if n:
        first = first.copy()
        first[0] = True
        at = np.flatnonzero(first)
        run = run - np.repeat(run[at] - p[at], np.diff(np.append(at, n)))
    return doc, run


def by_bucket(doc: np.ndarray, pos: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    b = (mix64(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    b, doc, pos = b[order], doc[order], pos[order]
    for part in np.split(np.arange(len(b)), np.flatnonzero(np.diff(b)) + 1):
        if len(part):
            yield int(b[part[0]]), pack(doc[part], pos[part])


def input_bytes(df: DataFrame) -> int:
    """Bytes of all texts, counted: a planner's estimate knows nothing of rows made in memory, and multiplies joins."""
    return int(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def contexts(s: Suffixes, order: np.ndarray) -> bytes:
    """The words of the suffixes' contexts, one context after the other, as they stand in the texts (white space between words is any)."""
    a, b = s.starts[s.first[order]], s.ends[s.last[order]] + 1  # each text is followed by white space
    sizes = b - a
    at = np.repeat(a - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(int(sizes.sum()))
    return s.data[at].tobytes()


def lcp_sorted(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in lexicographic order, and for each the number of leading words it has in common with the row before."""
    order = np.lexsort(words.T[::-1])
    w = words[order]
    same = w[1:] == w[:-1]
    common = np.where(same.all(axis=1), words.shape[1], same.argmin(axis=1)) if len(w) > 1 else np.zeros(0, np.int64)
    return order, np.concatenate(([0], common))[: len(w)]


class Tree:
    """The suffix tree of the rows of a matrix of words (-1 beyond a row's end), cut at the matrix' width: sorted rows and common prefixes."""

    def __init__(self, words: np.ndarray) -> None:
        self.order, self.common = lcp_sorted(words)

    def nodes(self, depth: int) -> np.ndarray:
        """For each row the number of its node at a depth: a maximal run of sorted rows with at least `depth` common words."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.common < depth) if depth else 0
        return out


def deep_repeats(doc: np.ndarray, pos: np.ndarray, left: np.ndarray, windows: np.ndarray, words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, position) of windows whose words also start in a document with a smaller id, among the suffixes of whole prefixes.

    words: numbers of the words of all contexts, one after the other; equal words have equal numbers."""
    sizes = windows + window - 1
    base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    reach = window - min(ANCHOR, window)  # at most that many words stand to the left

    def matrix(width: int, at: np.ndarray, step: int, room: np.ndarray) -> np.ndarray:
        cols = np.arange(width)
        idx = at[:, None] + step * cols[None, :]
        return np.where(cols[None, :] < room[:, None], words[np.clip(idx, 0, len(words) - 1)], -1).astype(np.int32)

    right = Tree(matrix(window, base + left, 1, sizes - left))
    back = Tree(matrix(reach, base + left - 1, -1, left)) if reach else None
    out_doc, out_pos = [], []
    for a in range(reach + 1):
        # windows that start a words before the anchor: the suffix tree at depth window - a, the backward tree at depth a
        has = np.flatnonzero((left >= a) & (left - a < windows))
        if len(has) < 2:
            continue
        node = right.nodes(window - a)[has]
        if a:
            node = node * (len(doc) + 1) + back.nodes(a)[has]
        order = np.argsort(node, kind="stable")
        run = np.flatnonzero(np.concatenate(([True], node[order][1:] != node[order][:-1])))
        size = np.diff(np.append(run, len(order)))
        own = doc[has][order]
        later = own > np.repeat(np.minimum.reduceat(own, run), size)
        at = has[order][later]
        out_doc.append(doc[at])
        out_pos.append(pos[at] - a)
    d, p = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_doc, out_pos))
    order = np.lexsort((p, d))
    return d[order], p[order]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, budget: int = 1 << 17, bins: int | None = None, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with with_text, the kept text and the removed spans of words.

    A word is removed if a window over it also starts in a document with a smaller id. budget: suffixes of a group."""
    base = id_text(docs, id_col, text_col)
    levels = min(ANCHOR, window)
    size = input_bytes(base)
    # about 4 bins to a group of a level; the table is at most 2^20 bins a level
    bins = bins or 1 << int(np.clip(math.ceil(math.log2(max(size, 1) / 36 / budget * 4)), 12, 20))
    buckets = max(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // (16 << 20) + 1)
    groups = np.full((0, bins), -1, np.int32)
    context = base.sparkSession.sparkContext
    for level in range(levels):
        above = context.broadcast(groups)

        def count(batches: Iterator[pa.RecordBatch], level: int = level, above=above) -> Iterator[pa.RecordBatch]:
            total = np.zeros(bins, np.int64)
            for ids, texts in slices(batches, SLICE):
                s = suffixes(ids, texts, window)
                if len(s.doc):
                    d = s.digests[level][assign(s.digests, above.value, bins) == -1]
                    total += np.bincount((d & np.uint64(bins - 1)).astype(np.int64), minlength=bins)
            b = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), pa.array(total[b])], ["bin", "n"])

        counted = base.mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()  # `bins` rows at most
        counts = np.zeros(bins, np.int64)
        counts[counted.bin] = counted.n
        groups = np.vstack([groups, pack_groups(counts, budget, int(groups.max(initial=-1)) + 1)])
        if not (counts > budget).any():
            break
    hot = bool((counts > budget).any())
    shared = context.broadcast(groups)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            group, doc, pos, left, windows, size = (np.concatenate(x) for x in list(zip(*held, strict=True))[:6])
            text = b"".join(h[6] for h in held)
            at = np.concatenate(([0], np.cumsum(size)))
            held.clear()
            order = np.lexsort((pos, doc, group))
            rows = []
            for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
                words = b"".join([text[at[i] : at[i + 1]] for i in part])
                spans = np.stack([left[part], windows[part]]).astype(np.uint8 if window < 200 else np.uint32)
                rows.append((int(group[part[0]]), pack(doc[part], pos[part]), spans.tobytes(), pa.compress(words, "zstd", asbytes=True), len(words)))
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64()), strict=True)], ["grp", "at", "spans", "words", "size"])

        for ids, texts in slices(batches, SLICE):
            s = suffixes(ids, texts, window)
            order = np.flatnonzero(assign(s.digests, shared.value, bins) >= 0) if len(s.doc) else np.zeros(0, int)
            if not len(order):
                continue
            group = assign(s.digests, shared.value, bins)[order]
            size = s.ends[s.last[order]] + 1 - s.starts[s.first[order]]
            held.append((group, s.doc[order], s.pos[order], s.left[order], s.windows[order], size, contexts(s, order)))
            if sum(len(h[6]) for h in held) >= FLUSH:
                yield flush()
        if held:
            yield flush()

    def subtree(table: pa.Table) -> pa.Table:
        at = [unpack(x) for x in table.column("at").to_pylist()]
        doc, pos = (np.concatenate([p[i] for p in at]) for i in (0, 1))
        kind = np.uint8 if window < 200 else np.uint32
        spans = np.concatenate([np.frombuffer(x, kind).reshape(2, -1) for x in table.column("spans").to_pylist()], axis=1).astype(np.int64)
        raw = zip(table.column("words").to_pylist(), table.column("size").to_pylist(), strict=True)
        words = [w for x, n in raw for w in pa.decompress(x, n, "zstd", asbytes=True).split()]
        codes = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int32)
        del words
        found = list(by_bucket(*deep_repeats(doc, pos, spans[0], spans[1], codes, window), buckets))
        return pa.table([pa.array([b for b, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["bucket", "at"])

    repeats = base.mapInArrow(deal, "grp int, at binary, spans binary, words binary, size long").groupBy("grp").applyInArrow(subtree, "bucket int, at binary")
    if hot:
        repeats = repeats.union(hot_repeats(base, shared, window, bins, buckets))

    keys = base.where("doc_id is not null").withColumn("bucket", bucket_of("doc_id", buckets))
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept", "removed_spans"] * with_text

    def rebuild(left: pa.Table, right: pa.Table) -> pa.Table:
        return rows_of(left, [unpack(x) for x in right.column("at").to_pylist()])

    def without_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from rows_of(pa.Table.from_batches([batch]), []).to_batches()

    def rows_of(left: pa.Table, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
        doc, pos = (np.concatenate([np.zeros(0, np.int64), *[p[i] for p in parts]]) for i in (0, 1))
        order = np.argsort(doc, kind="stable")
        doc, pos = doc[order], pos[order]
        out: list[list] = [[] for _ in names]
        for key, text in zip(left.column("doc_id").to_pylist(), left.column("text").to_pylist(), strict=True):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            mark = np.zeros(len(words) + 1, np.int64)
            if key is not None:
                own = pos[np.searchsorted(doc, key, "left") : np.searchsorted(doc, key, "right")]
                own = own[own + window <= len(words)]
                np.add.at(mark, own, 1)
                np.subtract.at(mark, own + window, 1)
            gone = np.cumsum(mark[:-1]) > 0
            kept = b" ".join(words[i] for i in np.flatnonzero(~gone)) if gone.any() else b" ".join(words)
            row = [key, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()]
            if with_text:
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))).reshape(-1, 2)
                row += [kept.decode("utf-8", "surrogatepass"), [{"start": int(a), "end": int(b)} for a, b in edge]]
            for col, x in zip(out, row, strict=True):
                col.append(x)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
        return pa.table([pa.array(c, t) for c, t in zip(out, types, strict=False)], names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string, removed_spans array<struct<start:int,end:int>>" * with_text
    # rows without an id are neither compared nor cut: they stay where they are
    return keys.groupBy("bucket").cogroup(repeats.groupBy("bucket")).applyInArrow(rebuild, schema).union(base.where("doc_id is null").mapInArrow(without_id, schema))


def bucket_of(id_col: str, buckets: int):
    """The bucket of by_bucket(), as rows of Arrow batches; null ids go to bucket 0."""

    @F.arrow_udf("int")
    def bucket(ids: pa.Array) -> pa.Array:
        keys = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.array((mix64(keys.view(np.uint64)) % np.uint64(buckets)).astype(np.int32))

    return bucket(F.col(id_col))


def hot_repeats(base: DataFrame, shared, window: int, bins: int, buckets: int) -> DataFrame:
    """Repeats among windows whose anchor's prefix is too large to gather: (node, positions) rows by task, the least id by node, joined back."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches, SLICE):
            s = suffixes(ids, texts, window, with_nodes=True)
            open_ = np.flatnonzero(assign(s.digests, shared.value, bins) == -1) if len(s.doc) else np.zeros(0, int)
            n = s.windows[open_]
            step = np.arange(int(n.sum())) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n) if len(n) else np.zeros(0, np.int64)
            doc, pos, node = np.repeat(s.doc[open_], n), np.repeat(s.pos[open_] - s.left[open_], n) + step, s.node[np.repeat(s.first[open_], n) + step]
            order = np.lexsort((pos, doc, node))
            cuts = np.flatnonzero(np.diff(node[order])) + 1
            spans = [order[a:b] for a, b in zip([0, *cuts], [*cuts, len(order)], strict=True) if b > a]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(node[x[0]].view(np.int64)) for x in spans], pa.int64()), pa.array([int(doc[x[0]]) for x in spans], pa.int64()), pa.array([pack(doc[x], pos[x]) for x in spans], pa.binary())],
                ["node", "least", "at"],
            )

    rows = cut(base.mapInArrow(collect, "node long, least long, at binary"), "hot")
    least = rows.groupBy("node").agg(F.min("least").alias("first"))

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for first, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc, pos = unpack(blob)
                out += by_bucket(doc[doc > first], pos[doc > first], buckets)
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["bucket", "at"])

    return rows.join(least, "node").select("first", "at").mapInArrow(later, "bucket int, at binary")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return remove_repeats(table(spark, sf_dir, "documents"))


SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS p, w FROM w),
y AS (SELECT doc_id, p, doc_id > min(doc_id) OVER (PARTITION BY array_to_string(w[p:p + 12], ' ')) AS later FROM x),
z AS (SELECT doc_id, list(DISTINCT p + k) AS gone FROM y, (SELECT unnest(range(13)) AS k) WHERE later GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' ')) AS kept_sha256 FROM w LEFT JOIN z USING (doc_id)
"""
