"""Conversation prefix trie: every shared beginning of conversations as a node with its members, leaves and the words that sharing saves.

1. A turn is the first 128 bits of the SHA-256 of its role and text, with its number of words; texts go no further than their own row. A conversation is the row of its turns in order.
2. Equal conversations become one path with their number, least id and the digest of their ids: slices of ids, dealt by ranges of (path, id), are joined in order, so copies of any number are a few rows.
3. Paths are dealt by the digest of their first turn. A group with more turns than `limit` is dealt again: the turns that all its paths share make a chain of nodes at once (the common prefix of its least and its greatest
   path), and the rest is dealt by the turn after it, until every group fits. `limit` is an even share of all turns, never more than a task's memory allows.
4. Groups that fit are packed into buckets; applyInPandas builds their pointer tries with dictionaries and sums leaves and saved words in an iterative postorder. The chains of divided groups take the sums of
   their children, last division first.

A conversation is one row of 20 bytes a turn; that its ids meet in one digest is part of the result's definition (its bytes pass through a task as a stream).

Null roles and texts are empty; rows without conv_id belong to no conversation and are left out. Null turns come first; rows that repeat a turn's number go by the digest of role and text, repeated rows count as turns of their own.
An empty table has no conversations and no nodes, not even the root. Extra columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, cut, table
from .resample import CRC_SQL, crc_sql

#: Turns of one group: at most so many in a task's memory, and at least so many before a group is worth dividing.
MOST, LEAST = 1 << 18, 1 << 8
#: Bytes of ids that are one row while a digest of ids is prepared.
SLICE = 1 << 20
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, path: each conversation's turns (digest, words) in order."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    t = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("d"), F.regexp_count(text, F.lit(WORD)).alias("w")).alias("t")).where("conv_id is not null")
    return t.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda x: F.struct(x["d"].alias("d"), x["w"].alias("w"))).alias("path"))


def rebuilt(paths: DataFrame, period: int = 20, heads: int = 4) -> DataFrame:
    """conv_id, path after the exchange of beginnings: the first h turns are those of conversation c - c % period, h being crc32(c) % heads.

    Only the few head turns travel, to the ids that may ask for them; conversations stay where they are."""
    c, last = F.col("conv_id"), F.lit(period - 1).cast("long")
    base = paths.where(c % period == 0).select(c.alias("base"), F.slice("path", 1, heads - 1).alias("head"))
    asked = base.select("head", "base", F.explode(F.sequence(F.when(F.col("base") > 0, F.col("base")).otherwise(F.col("base") - last), F.when(F.col("base") < 0, F.col("base")).otherwise(F.col("base") + last))).alias("conv_id"))
    h = (F.crc32(c.cast("string").cast("binary")) % heads).cast("int")
    both = paths.join(asked.where(c - c % period == F.col("base")).select("conv_id", "head"), "conv_id", "left")
    none = F.filter("path", lambda x: F.lit(False))
    start = F.when(h > 0, F.slice(F.coalesce("head", none), F.lit(1), F.greatest(h, F.lit(1)))).otherwise(none)
    return both.select("conv_id", F.concat(start, F.slice("path", h + 1, F.greatest(F.size("path"), F.lit(1)))).alias("path"))


def _runs(t: pa.Table) -> Iterator[tuple[int, int]]:
    """Rows of equal keys in a table sorted by `key`."""
    keys = t.column("key").to_pylist()
    start = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[start]:
            yield start, i
            start = i


SLICED = "key binary, first long, n long, ids string, path array<struct<d:binary,w:int>>"


def slice_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id, path) as one row for each run of a key: its least id, number, ids as text, and path."""
    schema = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        schema = schema or pa.schema([("key", pa.binary()), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.string()), ("path", batch.schema.field("path").type)])
        spans = [(s, e) for start, stop in _runs(t) for s, e in ((i, min(i + SLICE // 20, stop)) for i in range(start, stop, SLICE // 20))]
        ids, at = t.column("conv_id").to_pylist(), pa.array([s for s, _ in spans], pa.int64())
        firsts = t.take(at)
        columns = [firsts.column("key"), pa.array([ids[s] for s, _ in spans], pa.int64()), pa.array([e - s for s, e in spans], pa.int64()), pa.array([",".join(map(str, ids[s:e])) for s, e in spans], pa.string()), firsts.column("path")]
        yield from pa.Table.from_arrays(columns, schema=schema).to_batches()


def join_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices sorted by (key, first) as one row for each key: path, n, conv_id (the least), ends (hash of all ids). A digest goes on from batch to batch."""
    held, total, hashed = None, 0, None
    for batch in batches:
        out: list[tuple] = []
        for i, (key, first, n, ids) in enumerate(zip(*(batch.column(k).to_pylist() for k in ("key", "first", "n", "ids")), strict=True)):
            if held and held[0] == key:
                hashed.update(b"," + ids.encode())
                total += n
                continue
            if held:
                out.append((held[1], total, held[2], hashed.hexdigest()))
            held, total, hashed = (key, batch.column("path").slice(i, 1), first), n, hashlib.sha256(ids.encode())
        if out:
            yield _paths(out)
    if held:
        yield _paths([(held[1], total, held[2], hashed.hexdigest())])


def _paths(rows: list[tuple]) -> pa.RecordBatch:
    path = pa.concat_arrays([r[0] for r in rows])
    return pa.RecordBatch.from_arrays([path, *(pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.string())))], ["path", "n", "conv_id", "ends"])


def distinct_paths(conversations: DataFrame) -> DataFrame:
    """path, n, conv_id, ends: equal conversations as one row."""
    key = F.unhex(F.sha2(F.array_join(F.transform("path", lambda x: F.hex(x["d"])), ""), 256))
    keyed = cut(conversations.select(key.alias("key"), "conv_id", "path"), "paths")
    sliced = keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(slice_ids, SLICED)
    return cut(sliced.repartition("key").sortWithinPartitions("key", "first").mapInArrow(join_slices, "path array<struct<d:binary,w:int>>, n long, conv_id long, ends string"), "distinct")


def build_tries(rows: pd.DataFrame) -> pd.DataFrame:
    """All nodes of the tries of one bucket; `top` marks the first node of a group, which knows its parent from its rows.

    A node is a place in lists; its children are found in one dictionary by (node, digest of the turn)."""
    child: dict[tuple, int] = {}
    parent, depth, words, n, least, ends, top, kids = [], [], [], [], [], [], [], []
    tops: dict[bytes, int] = {}

    def node(up: int, d: int, w: int, mark: tuple | None) -> int:
        for column, x in ((parent, up), (depth, d), (words, w), (n, 0), (least, None), (ends, NO_ENDS), (top, mark), (kids, [])):
            column.append(x)
        if up >= 0:
            kids[up].append(len(parent) - 1)
        return len(parent) - 1

    for group, up_group, up_conv, start, digests, lengths, count, conv, digest in zip(*(rows[k] for k in ("group", "up_group", "up_conv", "depth", "d", "w", "n", "conv_id", "ends")), strict=True):
        at = tops.get(group)
        if at is None:
            at = tops[group] = node(-1, start, int(lengths[start - 1]), (up_group, up_conv))
        for i in range(start - 1, len(digests)):
            if i >= start:
                step = (at, digests[i])
                if step not in child:
                    child[step] = node(at, i + 1, int(lengths[i]), None)
                at = child[step]
            n[at] += count
            least[at] = conv if least[at] is None else min(least[at], conv)
        ends[at] = digest
    leaves, saved = [0] * len(parent), [0] * len(parent)
    for root in tops.values():  # postorder with a stack of its own: depth is bounded by memory alone
        stack = [(root, False)]
        while stack:
            at, seen = stack.pop()
            if not seen and kids[at]:
                stack.append((at, True))
                stack += [(k, False) for k in kids[at]]
                continue
            leaves[at] = sum(leaves[k] for k in kids[at]) or 1
            saved[at] = sum(saved[k] for k in kids[at]) + (n[at] - 1) * words[at]
    return pd.DataFrame(
        {
            "conv_id": least, "depth": depth, "parent_conv_id": [top[i][1] if top[i] else least[p] for i, p in enumerate(parent)], "n_convs": n, "n_children": [len(k) for k in kids],
            "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends, "up_group": [t[0] if t else None for t in top],
        }
    )


def common(low: Column, high: Column) -> Column:
    """Turns that the least and the greatest path of a group share, hence all of its paths."""
    same = F.zip_with(low, high, lambda a, b: F.coalesce(a["d"] == b["d"], F.lit(False)))
    return F.coalesce(F.array_position(same, False).cast("long") - 1, F.lit(0).cast("long")) + F.when(F.array_position(same, False) == 0, F.size(same).cast("long") + 1).otherwise(0)


def chain_nodes(chains: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The nodes of divided groups' common turns, a chain at a time: only the last has more than one child or can end conversations."""
    for rows in chains:
        for r in rows.itertuples():
            w = np.array([x["w"] for x in r.chain], np.int64)
            size, kids = len(w), 0 if pd.isna(r.n_children) else int(r.n_children)
            leaves, below = (int(r.n_leaves), int(r.below)) if kids else (1, 0)
            yield pd.DataFrame(
                {
                    "conv_id": r.least, "depth": np.arange(r.depth, r.depth + size), "parent_conv_id": [r.up_conv] + [r.least] * (size - 1), "n_convs": r.n, "n_children": [1] * (size - 1) + [kids],
                    "n_leaves": leaves, "saved_tokens": below + (r.n - 1) * np.cumsum(w[::-1])[::-1], "ends_sha256": [NO_ENDS] * (size - 1) + [r.stop or NO_ENDS],
                }
            )


def prefix_trie(conversations: DataFrame, limit: int | None = None) -> DataFrame:
    """The nodes of the trie over conversations (conv_id, path); see turns() and rebuilt()."""
    paths = distinct_paths(conversations)
    whole = paths.agg(F.sum(F.size("path").cast("long")).alias("turns"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.max(F.when(F.size("path") == 0, F.col("ends"))).alias("ends")).first()
    spark = conversations.sparkSession
    if whole["n"] is None:
        return spark.createDataFrame([], NODE)
    share = int(spark.conf.get("spark.sql.shuffle.partitions"))
    limit = limit or min(MOST, max(LEAST, whole["turns"] // (4 * share)))

    def dealt(rows: DataFrame, at: Column, up_group: Column, up_conv: Column) -> DataFrame:
        """Rows whose path goes on after `at` turns, grouped by the next one."""
        group = F.substring(F.unhex(F.sha2(F.concat(up_group, F.element_at("path", (at + 1).cast("int"))["d"]), 256)), 1, 16)
        return rows.where(F.size("path") > at).select(group.alias("group"), up_group.alias("up_group"), up_conv.alias("up_conv"), (at + 1).alias("depth"), "path", "n", "conv_id", "ends")

    live = cut(dealt(paths, F.lit(0).cast("long"), F.lit(b""), F.lit(whole["conv_id"])), "deal")
    divided, fit = [], []
    while True:
        sizes = live.groupBy("group").agg(F.sum(F.size("path") - F.col("depth") + 1).alias("entries"))
        large = cut(sizes.where(F.col("entries") > limit), "large")
        if large.isEmpty():
            fit.append(live)
            break
        fit.append(live.join(large, "group", "left_anti"))
        rows = live.join(large, "group")
        # the chain of a divided group: one row with the turns that all its paths share
        ends = rows.groupBy("group").agg(F.min("path").alias("low"), F.max("path").alias("high"), F.sum("n").alias("n"), F.min("conv_id").alias("least"), F.first("up_group").alias("up_group"), F.first("up_conv").alias("up_conv"), F.first("depth").alias("depth"))
        chains = cut(ends.withColumn("at", common(F.col("low"), F.col("high"))).select("group", "up_group", "up_conv", "depth", "at", "n", "least", F.slice("low", F.col("depth").cast("int"), (F.col("at") - F.col("depth") + 1).cast("int")).alias("chain")), "chains")
        rows = live.join(chains.select("group", "at", "least"), "group")
        stops = rows.where(F.size("path") == F.col("at")).select("group", F.col("ends").alias("stop"))
        divided.append(chains.join(stops, "group", "left"))
        live = cut(dealt(rows, F.col("at"), F.col("group"), F.col("least")), "deal")

    small = fit[0]
    for more in fit[1:]:
        small = small.unionByName(more)
    bucket = F.pmod(F.xxhash64("group"), F.lit(max(1, whole["turns"] // limit)))
    small = small.select(bucket.alias("bucket"), "group", "up_group", "up_conv", "depth", "n", "conv_id", "ends", F.transform("path", lambda x: x["d"]).alias("d"), F.transform("path", lambda x: x["w"]).alias("w"))
    built = cut(small.groupBy("bucket").applyInPandas(build_tries, f"{NODE}, up_group binary"), "nodes")

    nodes = [built.drop("up_group")]
    tops = built.where("up_group is not null").select("up_group", "n_leaves", "saved_tokens")
    for chains in reversed(divided):
        sums = tops.groupBy(F.col("up_group").alias("group")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        chains = cut(chains.join(sums, "group", "left").select("*", F.aggregate("chain", F.lit(0).cast("long"), lambda s, x: s + x["w"]).alias("words")), "sums")
        nodes.append(chains.mapInPandas(chain_nodes, NODE))
        tops = tops.unionByName(chains.select("up_group", F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), (F.coalesce("below", F.lit(0)) + (F.col("n") - 1) * F.col("words")).alias("saved_tokens")))
    root = tops.where(F.length("up_group") == 0).agg(F.count("*").alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    nodes.append(root.select(F.lit(whole["conv_id"]).alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(whole["n"]).alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.lit(whole["ends"] or NO_ENDS).alias("ends_sha256")))
    out = nodes[0]
    for more in nodes[1:]:
        out = out.unionByName(more.select([F.col(f.name).cast(f.dataType) for f in nodes[0].schema]))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(turns(table(spark, sf_dir, "conversations"))))


SQL = f"""
WITH RECURSIVE {CRC_SQL.strip()},
o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32)) AS k FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, c - c % 20 AS base, {crc_sql("hex(c::VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT c FROM o), crc_table),
r AS (SELECT h.c, o.k, role, text FROM h JOIN o ON o.c = h.base AND o.k <= h.h UNION ALL SELECT h.c, o.k + 1000000000, role, text FROM h JOIN o ON o.c = h.c AND o.k > h.h),
q AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY k) AS d, sha256(length(role) || ':' || role || text) AS x, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w FROM r),
p AS (SELECT c, 0::BIGINT AS d, '' AS key, 0::BIGINT AS w FROM h UNION ALL SELECT p.c, q.d, sha256(p.key || q.x), q.w FROM p JOIN q ON q.c = p.c AND q.d = p.d + 1),
l AS (SELECT c, max(d) AS size FROM p GROUP BY c),
n AS (SELECT key, min(c) AS conv_id, any_value(d) AS depth, any_value(w) AS w, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = size), '')) AS ends_sha256 FROM p JOIN l USING (c) GROUP BY key),
u AS (SELECT n.key, parent.key AS up FROM n LEFT JOIN p AS parent ON parent.c = n.conv_id AND parent.d = n.depth - 1),
kids AS (SELECT up AS key, count(*) AS n_children FROM u WHERE up IS NOT NULL GROUP BY up),
a AS (SELECT p.key, sum((n.n_convs - 1) * n.w)::BIGINT AS saved_tokens, count(*) FILTER (WHERE kids.key IS NULL) AS n_leaves FROM n LEFT JOIN kids ON kids.key = n.key JOIN p ON p.c = n.conv_id AND p.d <= n.depth GROUP BY p.key)
SELECT n.conv_id, n.depth, parent.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n JOIN u ON u.key = n.key LEFT JOIN n AS parent ON parent.key = u.up LEFT JOIN kids ON kids.key = n.key JOIN a ON a.key = n.key
"""
