"""Hybrid retrieval over batches of queries and packs: dense and lexical lanes, a gate for each pack, rank fusion, de-duplication, top n."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import vectors as V

RRF_K, LANE_K, FLOOR, MARGIN = 60, 20, 0.30, 0.10


def quantized(df: DataFrame, id_col: str, out: str) -> DataFrame:
    return df.select(F.col(id_col).alias(out), V.quantize_int8(V.l2_normalize(F.col("embedding"))).alias("q"), *[c for c in df.columns if c not in (id_col, "embedding", "q", out)])


#: Rows of a block of queries and of vectors in one task; queries of one matrix product.
QUERY_BLOCK, VECTOR_BLOCK, STEP = 4096, 1 << 16, 256


def _nearest(vectors: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """query_id, pack_id, chunk_id, distance, dot: of one block of each side, the k nearest of every query and pack."""
    out: list[tuple[np.ndarray, ...]] = []
    packs, pack = np.unique(np.array(vectors["pack_id"].to_pylist(), object).astype(str), return_inverse=True) if vectors.num_rows else ([], None)
    sizes = [np.array([len(x or []) for x in t["q"].to_pylist()]) for t in (vectors, queries)]
    for width in np.intersect1d(*sizes):  # vectors of different widths don't compare
        if not width:
            continue
        vi, qi = (np.flatnonzero(n == width) for n in sizes)
        v, q = (np.array(t["q"].take(at).combine_chunks().flatten(), float).reshape(-1, width) for t, at in ((vectors, vi), (queries, qi)))
        ids, vn = vectors["chunk_id"].to_numpy()[vi], (v * v).sum(axis=1)
        groups = [np.flatnonzero(pack[vi] == g) for g in range(len(packs))]
        for at in range(0, len(qi), STEP):
            dots = q[at : at + STEP] @ v.T
            for row, i in zip(dots, qi[at : at + STEP], strict=True):
                qn = float((np.array(queries["q"][int(i)].as_py(), float) ** 2).sum())
                distance = vn + qn - 2 * row
                for g, own in enumerate(groups):
                    if not len(own):
                        continue
                    d = distance[own]
                    near = own[d <= np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1]]
                    near = near[np.lexsort((ids[near], distance[near]))][:k]
                    out.append((np.full(len(near), int(i)), np.full(len(near), g), ids[near], distance[near], row[near]))
    i, g, chunk, distance, dot = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 5
    names = queries["query_id"].to_numpy()[i] if len(i) else np.zeros(0, np.int64)
    return pa.table([pa.array(names, pa.int64()), pa.array([packs[x] for x in g], pa.string()), pa.array(chunk, pa.int64()), pa.array(distance.astype(np.int64)), pa.array(dot.astype(np.int64))], ["query_id", "pack_id", "chunk_id", "distance", "dot"])


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = LANE_K) -> DataFrame:
    """query_id, pack_id, chunk_id, distance, dense_cosine, rank: the k nearest of every pack by squared L2 of int8 vectors, ties by id.

    queries: query_id, q; vectors: chunk_id, pack_id (text), q. All rows are compared with the query set, block by block: as many blocks of each side as its size asks for, each pair of them one
    matrix product in one task. Neither side is broadcast, and a pair of blocks gives k rows a query and pack, not one for each pair of rows."""
    nv, nq = (max(1, -(-df.count() // size)) for df, size in ((vectors, VECTOR_BLOCK), (queries, QUERY_BLOCK)))
    left = vectors.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("pack_id").cast("string").alias("pack_id"), "q", F.pmod(F.xxhash64("chunk_id"), F.lit(nv)).cast("int").alias("vb"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"))
    right = queries.select(F.col("query_id").cast("long").alias("query_id"), "q", F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nv - 1))).alias("vb"))
    pairs = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInArrow(lambda a, b: _nearest(a, b, k), "query_id long, pack_id string, chunk_id long, distance long, dot long")
    order = Window.partitionBy("query_id", "pack_id").orderBy("distance", "chunk_id")
    top = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select("query_id", "pack_id", "chunk_id", "distance", V.cosine_int8(F.col("dot")).alias("dense_cosine"), "rank")


def rrf(lanes: DataFrame, keys: list[str], k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) over the lanes of each key."""
    return lanes.groupBy(*keys).agg(F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank"))), 12).alias("fused_score"))


#: What a person's own packs are held to, and what is said where nothing passed.
PERSONAL_FLOOR, PERSONAL_MARGIN = 0.30, 0.0
NO_EVIDENCE, REFUSAL = "NO_EVIDENCE", "The packs hold nothing on this. Ask about something they cover, or add a pack."


def answers(queries: DataFrame, prompts: DataFrame) -> DataFrame:
    """query_id, prompt, reply: the grounded prompt of each query, or the marker and the fixed refusal for one without sources. prompts: query_id, sources."""
    q = queries.select("query_id").distinct().join(prompts, "query_id", "left")
    none = F.coalesce(F.col("sources"), F.lit("")) == ""
    return q.select("query_id", F.when(none, NO_EVIDENCE).otherwise(F.col("sources")).alias("prompt"), F.when(none, REFUSAL).alias("reply"))


def pack_gate(candidates: DataFrame, floor: float = FLOOR, margin: float = MARGIN) -> DataFrame:
    """query_id, pack_id, n, top1, at10, passed. No candidates: no row. A cosine that is not a number fails the pack, before any comparison.
    A lone candidate needs the floor alone; otherwise the best must lead the one at rank min(10, n) by the margin. Bounds are inclusive. With a column `personal`, packs that have it true are held to PERSONAL_FLOOR and PERSONAL_MARGIN."""
    own = F.coalesce(F.col("personal"), F.lit(False)) if "personal" in candidates.columns else F.lit(False)
    candidates = candidates.withColumn("_floor", F.when(own, PERSONAL_FLOOR).otherwise(floor)).withColumn("_margin", F.when(own, PERSONAL_MARGIN).otherwise(margin))
    w = Window.partitionBy("query_id", "pack_id")
    c = candidates.withColumn("cos", F.col("dense_cosine").cast("double")).withColumn("n", F.count("*").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("cos"), "chunk_id")))
    g = c.groupBy("query_id", "pack_id").agg(F.max("n").alias("n"), F.max("cos").alias("top1"), F.max(F.when(F.col("rn") == F.least(F.lit(10), "n"), F.col("cos"))).alias("at10"), F.bool_or(F.isnan("cos") | F.col("cos").isNull()).alias("odd"), F.max("_floor").alias("_floor"), F.max("_margin").alias("_margin"))
    ok = ~F.col("odd") & (F.col("top1") >= F.col("_floor")) & ((F.col("n") == 1) | (F.col("top1") - F.col("at10") >= F.col("_margin")))
    return g.select("query_id", "pack_id", "n", F.round("top1", 6).alias("top1"), F.round("at10", 6).alias("at10"), ok.alias("passed"))


def fuse(dense: DataFrame, lexical: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Candidates of both lanes with fused score and exact cosine (0 without a vector)."""
    keys = ["query_id", "pack_id", "chunk_id"]
    fused = rrf(dense.select(*keys, "rank").unionByName(lexical.select(*keys, "rank")), keys)
    v = vectors.select("chunk_id", F.col("q").alias("vq"))
    q = queries.select("query_id", F.col("q").alias("qq"))
    return fused.join(v, "chunk_id", "left").join(q, "query_id", "left").select(*keys, "fused_score", V.cosine_int8(V.dot_int8(F.col("vq"), F.col("qq"))).alias("dense_cosine"))


def assemble(queries: DataFrame, candidates: DataFrame, gates: DataFrame, sections: DataFrame, n: int = 3) -> DataFrame:
    """query_id, status, n, pack_id, chunk_id: packs that failed their gate are out before fusion; the rest are ordered by rank in their pack, one
    chunk for each (pack, document, section), then cut to n. A query without a passing pack has one row, no_evidence.

    sections: chunk_id, doc_id, section_path."""
    live = candidates.join(gates.where("passed").select("query_id", "pack_id"), ["query_id", "pack_id"], "left_semi")
    ranked = live.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "pack_id").orderBy(F.desc("fused_score"), "chunk_id")))
    ranked = ranked.join(sections, "chunk_id")
    first = ranked.withColumn("rn", F.row_number().over(Window.partitionBy("query_id", "pack_id", "doc_id", "section_path").orderBy("rank"))).where("rn = 1")
    top = first.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "pack_id", "chunk_id"))).where(F.col("n") <= n)
    return queries.select("query_id").join(top.select("query_id", "n", "pack_id", "chunk_id"), "query_id", "left").select("query_id", F.when(F.col("chunk_id").isNull(), "no_evidence").otherwise("grounded").alias("status"), "n", "pack_id", "chunk_id")


def render_sources(cited: DataFrame) -> DataFrame:
    """One prompt per query: "[n] (title, section, locator): text" lines in order, empty parts left out; built by concatenation, so braces in texts mean nothing.

    cited: query_id, n, title, section_path, locator, text; at most the n of assemble() rows a query."""
    source = F.concat_ws(", ", *[F.nullif(F.col(c), F.lit("")) for c in ("title", "section_path", "locator")])
    line = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] ("), source, F.lit("): "), F.col("text"))
    return cited.select("query_id", F.struct("n", line.alias("line")).alias("x")).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("sources"))
