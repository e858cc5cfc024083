"""A stored inverted index over packs of chunks: stemmed terms, BM25 weights worked out once, postings in blocks ordered by weight, and top k by upper bounds.

A BM25 weight is how rare the stem is in its pack, the same for all chunks, times how much of it the chunk has, which needs no other chunk. The second factor is what postings hold, so they are ordered
and dealt once, before anybody knows how many chunks hold a stem; the first one stands in the list's row. An index is a folder of four tables:

- `lists`: one row for each (pack, stem): how many chunks hold it, its rarity (idf), the largest weight without it.
- `blocks`: at most BLOCK postings of one (pack, stem) a row, heaviest first, with their largest weight; weights without idf. Written in ranges of (pack, stem, weight), so that a search for few stems skips the files and row groups of the others, and no
  list, however long, is one task's.
- `chunks`: each chunk's stems and weights without idf, for the exact score of a candidate.
- `packs`: chunks and mean length.

A search joins these tables with the query's stems. It never reads texts, and most matches never become rows: see search() and products()."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lorekeep.functions import stem as S
from lorekeep.functions import text as T
from lorekeep.storage import discard, new_path, remove, written

K1, B = 1.2, 0.75
#: Postings of a block, hence the largest k whose bound is known from one block.
BLOCK = 128
#: Scores are rounded to six places, so bounds leave more than that.
SLACK = 1e-5
#: Postings, chunks and queries of a block of products(), and terms added up in one step of it. Queries whose lists hold more than DENSE postings for each chunk of the index are answered by it.
POSTINGS, CHUNKS, QUERIES, STEP, DENSE = 1 << 20, 1 << 13, 256, 1 << 21, 1.0


def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pack_id, stem, g, chunk_id), sorted, as one row for every BLOCK of them or less; the last block of a batch goes on in the next."""
    held: pa.Table | None = None

    def out(t: pa.Table, starts: np.ndarray, end: int) -> pa.RecordBatch:
        offsets = pa.array(np.append(starts, end).astype(np.int32))
        pack, stem, g, chunk = (t.column(i).combine_chunks() for i in range(4))
        first = pa.array(starts)
        return pa.RecordBatch.from_arrays([pack.take(first), stem.take(first), g.take(first), pa.ListArray.from_arrays(offsets, chunk.slice(0, end)), pa.ListArray.from_arrays(offsets, g.slice(0, end))], ["pack_id", "stem", "top", "chunk_ids", "weights"])

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
        keys = [t.column(i).combine_chunks().dictionary_encode("encode").indices.to_numpy() for i in (0, 1)]
        new = np.append(True, (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]))
        at = np.arange(len(new))
        starts = np.flatnonzero((at - np.maximum.accumulate(np.where(new, at, 0))) % BLOCK == 0)
        if len(starts) > 1:
            yield out(t, starts[:-1], int(starts[-1]))
        held = t.slice(int(starts[-1]))
    if held is not None:
        yield out(held, np.zeros(1, np.int64), held.num_rows)


def _products(chunks: pa.Table, queries: pa.Table, k: int, schema: pa.Schema) -> pa.Table:
    """Of a block of chunks (pack_id, chunk_id, stems, weights) and one of queries (query_id, stems), with which stand their stems' idf (pack_id, stems, idf): the k best of every query and pack, ties by id."""
    chunks = chunks.take(pc.sort_indices(chunks["chunk_id"]))
    idfs, queries = queries.filter(pc.is_valid(queries["pack_id"])), queries.filter(pc.is_null(queries["pack_id"]))
    own, weights, asked = (x.combine_chunks() for x in (chunks["stems"], chunks["weights"], queries["stems"]))
    at, of = own.offsets.to_numpy(), asked.offsets.to_numpy()
    stems = asked.values.slice(of[0], of[-1] - of[0]).dictionary_encode()
    by_stem = np.argsort(stems.indices.to_numpy(), kind="stable")  # queries by stem: those of stem c stand from start[c] on
    start = np.concatenate([[0], np.cumsum(np.bincount(stems.indices.to_numpy(), minlength=len(stems.dictionary)))])
    whose = np.repeat(np.arange(queries.num_rows), np.diff(of))[by_stem]
    code = pc.index_in(own.values.slice(at[0], at[-1] - at[0]), value_set=stems.dictionary)
    hit = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
    code, row = code.take(pa.array(hit)).to_numpy(), np.repeat(np.arange(chunks.num_rows), np.diff(at))[hit]
    packs = chunks["pack_id"].combine_chunks().dictionary_encode()
    group = packs.indices.to_numpy()
    key = group[row] * len(stems.dictionary) + code
    known = pc.index_in(idfs["pack_id"], value_set=packs.dictionary).combine_chunks(), pc.index_in(pc.list_flatten(idfs["stems"]), value_set=stems.dictionary).combine_chunks()
    here = np.flatnonzero(pc.and_(known[0].is_valid(), known[1].is_valid()).to_numpy(zero_copy_only=False))
    where = known[0].take(pa.array(here)).to_numpy() * len(stems.dictionary) + known[1].take(pa.array(here)).to_numpy()
    order = np.argsort(where)
    idf = idfs["idf"].to_numpy()[here][order]
    each = weights.flatten().take(pa.array(hit)).to_numpy() * (idf[np.searchsorted(where[order], key)] if len(key) else 1.0)
    n = start[code + 1] - start[code]
    scores = np.zeros((chunks.num_rows, queries.num_rows))
    ends = np.concatenate([[0], np.cumsum(n)])
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + STEP, "right")) - 1)
        m = n[a:b]
        query = whose[np.arange(ends[b] - ends[a]) + np.repeat(start[code[a:b]] - (ends[a:b] - ends[a]), m)]
        first, last = row[a], row[b - 1] + 1
        cell = (np.repeat(row[a:b], m) - first) * queries.num_rows + query
        scores[first:last] += np.bincount(cell, np.repeat(each[a:b], m), (last - first) * queries.num_rows).reshape(-1, queries.num_rows)
        a = b
    out = []
    for g in np.unique(group):
        own = np.flatnonzero(group == g)
        s = np.round(scores[own], 6)
        top = np.argsort(-s, axis=0, kind="stable")[:k]
        rank, query = np.nonzero(np.take_along_axis(scores[own], top, 0) > 0)
        out.append((own[top[rank, query]], query, s[top[rank, query], query]))
    at, query, score = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 3
    return pa.Table.from_arrays([queries["query_id"].take(pa.array(query)), chunks["pack_id"].take(pa.array(at)), chunks["chunk_id"].take(pa.array(at)), pa.array(score, pa.float64())], schema=schema)


def rarity(n: Column, df: Column) -> Column:
    return F.greatest(F.lit(1e-6), F.log((n - df + 0.5) / (df + 0.5)))


def share(tf: Column, length: Column, avgdl: Column) -> Column:
    """A BM25 weight without its idf."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avgdl))


class TextIndex:
    """An index in a folder; build() makes one of chunks (pack_id, chunk_id, text), TextIndex(spark, path) opens it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.lists, self.blocks, self.chunks, self.packs = (spark.read.parquet(f"{path}/{name}") for name in ("lists", "blocks", "chunks", "packs"))

    @classmethod
    def build(cls, chunks: DataFrame, path: str | None = None) -> TextIndex:
        """Null texts are no chunks. Texts are taken apart once, and stems counted and weighed in their chunk's row; what is shuffled are postings, once, to their block."""
        spark, path = chunks.sparkSession, path or new_path(chunks, "index")
        # a text's length is the sum of its counts: to ask for the size of its words would take it apart again
        t = chunks.where("text is not null").select(F.col("pack_id").cast("string").alias("pack_id"), F.col("chunk_id").cast("long").alias("chunk_id"), S.stem_counts(T.terms(F.col("text"))).alias("held"))
        held = written(t.select("pack_id", "chunk_id", F.aggregate("held", F.lit(0), lambda n, h: n + h["tf"]).alias("len"), "held"), "counts")
        held.groupBy("pack_id").agg(F.count("*").alias("n"), F.avg("len").alias("avgdl")).write.parquet(f"{path}/packs")
        packs = spark.read.parquet(f"{path}/packs")
        g = lambda tf: share(tf, F.col("len"), F.col("avgdl"))
        postings = []
        some = held.groupBy("pack_id", "chunk_id").agg(F.count("*").alias("same")).where("same > 1")
        if some.isEmpty():
            own = held.where(F.size("held") > 0).join(packs, "pack_id").select("pack_id", "chunk_id", F.col("held.stem").alias("stems"), F.transform("held.tf", g).alias("weights"))
            own.write.parquet(f"{path}/chunks")
            p = spark.read.parquet(f"{path}/chunks").select("pack_id", "chunk_id", F.explode(F.arrays_zip("stems", "weights")).alias("p")).select("pack_id", F.col("p.stems").alias("stem"), F.col("p.weights").alias("g"), "chunk_id")
        else:  # rows of one chunk id and length are one chunk; those of other lengths add their weights to its own
            each = held.select("pack_id", "chunk_id", "len", F.explode("held").alias("h")).groupBy("pack_id", "chunk_id", "len", F.col("h.stem").alias("stem")).agg(F.sum("h.tf").alias("tf"))
            p = written(each.join(packs, "pack_id").select("pack_id", "stem", g(F.col("tf")).alias("g"), "chunk_id"), "postings")
            postings.append(p)
            by_stem = p.groupBy("pack_id", "chunk_id", "stem").agg(F.sum("g").alias("g"))
            by_chunk = by_stem.groupBy("pack_id", "chunk_id").agg(F.collect_list(F.struct("stem", "g")).alias("own"))
            by_chunk.select("pack_id", "chunk_id", F.col("own.stem").alias("stems"), F.col("own.g").alias("weights")).write.parquet(f"{path}/chunks")
        order = ["pack_id", "stem", F.desc("g"), "chunk_id"]
        blocks = p.select("pack_id", "stem", "g", "chunk_id").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(to_blocks, "pack_id string, stem string, top double, chunk_ids array<long>, weights array<double>")
        blocks.write.parquet(f"{path}/blocks")
        # the ranges of the table serve the grouping too: one shuffle, of a row a block
        sizes = spark.read.parquet(f"{path}/blocks").select("pack_id", "stem", F.size("chunk_ids").alias("size"), "top").repartitionByRange("stem", "pack_id")
        lists = sizes.groupBy("pack_id", "stem").agg(F.sum("size").alias("df"), F.max("top").alias("peak")).sortWithinPartitions("stem", "pack_id")
        lists.join(packs, "pack_id").select("pack_id", "stem", "df", rarity(F.col("n"), F.col("df")).alias("idf"), "peak").write.parquet(f"{path}/lists")
        discard(held, *postings)
        return cls(spark, path)

    def drop(self) -> None:
        remove(self.spark, self.path)

    def _scored(self, candidates: DataFrame, asked: DataFrame, lists: DataFrame, all_terms: bool) -> DataFrame:
        """query_id, pack_id, chunk_id, score: candidates with their exact score, from the chunk's own row and the idf of the query's stems in its pack."""
        idf = lists.groupBy("query_id", "pack_id").agg(F.map_from_entries(F.collect_list(F.struct("stem", "idf"))).alias("idf"))
        c = candidates.join(self.chunks, ["pack_id", "chunk_id"]).join(asked.select("query_id", F.col("stems").alias("asked")), "query_id").join(idf, ["query_id", "pack_id"])
        if all_terms:
            c = c.where(F.forall("asked", lambda s: F.array_contains("stems", s)))
        weight = lambda s: F.element_at("idf", s) * F.get("weights", (F.array_position("stems", s) - 1).cast("int"))
        score = F.aggregate("asked", F.lit(0.0), lambda x, s: x + F.coalesce(weight(s), F.lit(0.0)))
        return c.select("query_id", "pack_id", "chunk_id", F.round(score, 6).alias("score"))

    def _best(self, scored: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("query_id", "pack_id").orderBy(F.desc("score"), "chunk_id")
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def _wanted(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(query_id, stems, n) and its lists (query_id, pack_id, stem, n, df, idf, peak, top). Queries: query_id, terms; terms with one stem count once."""
        each = queries.select("query_id", F.explode("terms").alias("term")).where("term is not null")
        each = each.join(S.stems(each), "term").select("query_id", "stem").distinct()
        asked = written(each.groupBy("query_id").agg(F.array_sort(F.collect_list("stem")).alias("stems")).withColumn("n", F.size("stems")), "asked")
        lists = asked.select("query_id", "n", F.explode("stems").alias("stem")).join(self.lists.withColumn("top", F.col("idf") * F.col("peak")), "stem")
        return asked, written(lists, "wanted")

    def candidates(self, lists: DataFrame, k: int, all_terms: bool, asked: DataFrame) -> DataFrame:
        """query_id, pack_id, chunk_id of all chunks that can be among a pack's k best for a query.

        All terms: the chunks of the query's rarest stem. Any term: first a floor, the k-th best exact score among chunks of each list's heaviest block. Then stems in the order of their largest weight: as long as these
        add up to less than the floor, they can bring in no chunk by themselves. Of the other stems, only blocks whose largest weight, with the largest of all other stems, reaches the floor are read, and a chunk stays if what is
        known of it, with the largest of what is not, reaches it."""
        keys = ["query_id", "pack_id"]
        group = Window.partitionBy(*keys)
        if all_terms:
            full = lists.withColumn("held", F.count("*").over(group)).where("held = n")
            rarest = full.groupBy(*keys).agg(F.min_by("stem", F.struct("df", "stem")).alias("stem"))
            return rarest.join(self.blocks, ["pack_id", "stem"]).select(*keys, F.explode("chunk_ids").alias("chunk_id"))
        first = lists.select(*keys, "stem", "idf", "peak").join(self.blocks, ["pack_id", "stem"]).where("top = peak")
        kth = first.groupBy(*keys).agg(F.max(F.col("idf") * F.coalesce(F.get("weights", F.lit(k - 1)), F.lit(0.0))).alias("kth"))
        seeds = first.select(*keys, "idf", F.explode(F.arrays_zip("chunk_ids", "weights")).alias("p")).groupBy(*keys, F.col("p.chunk_ids").alias("chunk_id")).agg(F.sum(F.col("idf") * F.col("p.weights")).alias("score"))
        seeds = self._best(self._scored(self._best(seeds, 2 * k).select(*keys, "chunk_id"), asked, lists, False), k)
        floors = seeds.where(F.col("rank") == k).select(*keys, F.col("score").alias("floor"))
        b = lists.join(floors, keys, "left").join(kth, keys, "left").withColumn("floor", F.greatest(F.lit(0.0), "floor", "kth") - SLACK)
        b = b.withColumn("all", F.sum("top").over(group)).withColumn("upto", F.sum("top").over(group.orderBy("top", "stem").rowsBetween(Window.unboundedPreceding, 0)))
        b = b.where("upto >= floor").select(*keys, "stem", "idf", F.col("top").alias("most"), "all", "floor")
        read = b.join(self.blocks, ["pack_id", "stem"]).where("idf * top + all - most >= floor")
        rows = read.select(*keys, "all", "floor", "most", "idf", F.explode(F.arrays_zip("chunk_ids", "weights")).alias("p"))
        seen = rows.groupBy(*keys, F.col("p.chunk_ids").alias("chunk_id")).agg(F.sum(F.col("most") - F.col("idf") * F.col("p.weights")).alias("less"), F.max("all").alias("all"), F.max("floor").alias("floor"))
        return seen.where(F.col("all") - F.col("less") >= F.col("floor")).select(*keys, "chunk_id")

    def products(self, asked: DataFrame, lists: DataFrame, k: int) -> DataFrame:
        """query_id, pack_id, chunk_id, score: what search() ranks, from all chunks, each read once for a block of queries. As many blocks of chunks as their postings and number ask for and of queries as theirs does; each pair of blocks is one
        sparse product in one task, and gives k rows a query and pack."""
        size = self.lists.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0], self.packs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], asked.count()
        nv, nq = max(1, -(-size[0] // POSTINGS), -(-size[1] // CHUNKS)), max(1, -(-size[2] // QUERIES))
        left = self.chunks.where("pack_id is not null").select("pack_id", "chunk_id", "stems", "weights", F.pmod(F.xxhash64("chunk_id"), F.lit(nv)).cast("int").alias("vb"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"))
        kind = asked.schema["query_id"].dataType
        block = F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int").alias("qb")
        own = asked.select("query_id", "stems", F.lit(None).cast("string").alias("pack_id"), F.lit(None).cast("double").alias("idf"), block)
        idf = lists.select(block, "stem", "pack_id", "idf").distinct().select(F.lit(None).cast(kind).alias("query_id"), F.array("stem").alias("stems"), "pack_id", "idf", "qb")
        right = own.unionByName(idf).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(nv - 1))))
        schema = pa.schema([("query_id", to_arrow_type(kind)), ("pack_id", pa.string()), ("chunk_id", pa.int64()), ("score", pa.float64())])
        empty = pa.table({name: pa.array([], t) for name, t in zip(schema.names, schema.types, strict=True)})
        return left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInArrow(lambda c, q: _products(c, q, k, schema) if c.num_rows and q.num_rows else empty, f"query_id {kind.simpleString()}, pack_id string, chunk_id long, score double")

    def search(self, queries: DataFrame, k: int, all_terms: bool = True) -> DataFrame:
        """query_id, pack_id, chunk_id, score, rank: every pack's k best chunks of each query (query_id, terms), ties by id.

        Queries for any term that all together match little are answered from blocks of postings; else most chunks would be candidates of some query, and all chunks are read once for all queries."""
        asked, lists = self._wanted(queries)
        if not all_terms:
            matched, n = lists.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0], self.packs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            if matched > DENSE * n:
                return self._best(self.products(asked, lists, k), k)
        return self._best(self._scored(self.candidates(lists, k, all_terms, asked), asked, lists, all_terms), k)
