"""Target-distribution importance resampling: documents drawn by how much likelier their words are in a target corpus.

1. Features are runs of 1 to `n` words, hashed into `buckets` bins by CRC-32. Each task adds up one array of bins; the bins of both corpora are summed as rows, so the
   driver holds two arrays of `buckets` numbers, whatever the size of the corpora.
2. A bin's gain is its log ratio in whole thousandths. A document's weight is the floored mean of its features' gains: lookups in the array of gains. Gumbel noise, a
   function of seed and id alone, makes the largest scores a draw without replacement.
3. Scores are whole numbers, so the exact histogram has no more rows than a score has values (the gains lie in a range of logarithms: some 100,000). Its suffix sums give each
   score the number of rows before it, and the score at which the draw ends. Only rows at or above that score are numbered, inside their score, by id.

One row per input row. Null or empty texts have no features: weight 0, and no place in the draw, as all texts of fewer than `min_words` words. A null id has no noise: its score and rank are null and it doesn't count
in the share to draw. Repeated rows count as often as they occur; equal rows take consecutive ranks. Ties of score and id go by features, then weight. An empty corpus or target is allowed; no documents
give no rows. Extra columns are ignored."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, id_text, parts, table

BUCKETS = 10_000
#: A-Z become a-z, other bytes that are not of a word become spaces: digits, letters and all bytes from 0x80 on are of a word.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Distinct features whose bins a task remembers.
REMEMBER = 200_000


class Bins(dict):
    """Feature to bin, worked out when first asked for."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        out = self[feature] = zlib.crc32(feature) % self.buckets
        return out


def features(text: pa.Scalar | str | None, n: int) -> tuple[list[bytes], int]:
    """All runs of 1 to n words of a whole text, and its number of words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    out = list(words)
    for k in range(2, n + 1):
        out += map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))
    return out, len(words)


def bin_counts(texts: DataFrame, n: int, buckets: int) -> np.ndarray:
    """How often each bin occurs in a table with a text column. One array a task, then one row a bin: `buckets` rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, bins = np.zeros(buckets, np.int64), Bins(buckets)
        for batch in parts(batches, 0):
            for text in batch.column(0).to_pylist():
                found, _ = features(text, n)
                total += np.bincount(np.fromiter(map(bins.__getitem__, found), np.int64, len(found)), minlength=buckets)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["bin", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        out[r["bin"]] = r["n"]
    return out


def gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bin's smoothed shares, rounded down."""
    buckets, s, t = len(docs), float(docs.sum()), float(target.sum())
    return np.array([math.floor(1000.0 * math.log((b + 1.0) * (s + buckets) / ((a + 1.0) * (t + buckets)))) for a, b in zip(docs.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, n: int) -> DataFrame:
    """doc_id, n_words, n_features, weight of rows (doc_id, text)."""
    buckets = len(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(buckets)
        for batch in parts(batches):
            n_words, n_features, weight = [], [], []
            for text in batch.column(1).to_pylist():
                found, words = features(text, n)
                total = int(gain[np.fromiter(map(bins.__getitem__, found), np.int64, len(found))].sum())
                n_words.append(words)
                n_features.append(len(found))
                weight.append(total // len(found) if found else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, seed: int = 2024, n: int = 1, buckets: int = BUCKETS, min_words: int = 20) -> DataFrame:
    """doc_id, n_features, weight, score, rank; rank is 1, 2, 3 ... in the order of the draw and null for documents not drawn."""
    d = id_text(docs)
    gain = gains(bin_counts(d, n, buckets), bin_counts(target.select(F.col("text")), n, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = cut(weigh(d, gain, n).withColumn("score", F.col("weight") + noise), "scores")

    able = scored.where((F.col("n_words") >= min_words) & F.col("score").isNotNull())
    histogram = sorted(((r["score"], r["n"]) for r in able.groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    draw = sum(n for _, n in histogram) * percent // 100
    before, offsets = 0, []
    for value, rows in histogram:
        if before >= draw:
            break
        offsets.append((value, before))
        before += rows
    cutoff = offsets[-1][0] if offsets else None
    if cutoff is None:
        return scored.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))

    # equal rows are one row with a count while they are numbered, so an id that repeats a million times is one row of its score
    above = (F.col("n_words") >= min_words) & F.coalesce(F.col("score") >= cutoff, F.lit(False))
    starts = docs.sparkSession.createDataFrame(offsets, "score long, before long")
    alike = scored.where(above).groupBy("score", "doc_id", "n_features", "weight").agg(F.count("*").alias("copies"))
    order = Window.partitionBy("score").orderBy("doc_id", "n_features", "weight")
    places = alike.join(F.broadcast(starts), "score").withColumn("at", F.row_number().over(order)).withColumn("last", F.col("before") + F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = places.select("doc_id", "n_features", "weight", "score", F.explode(F.sequence(F.col("last") - F.col("copies") + 1, "last")).alias("rank"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    return ranked.unionByName(scored.where(~above).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 of a word's bytes in SQL: a table of 256 entries by its rule, then one step a byte.
CRC_SQL = """
crc_bits AS (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM (SELECT unnest(range(256)) AS i)),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM crc_bits)"""


def crc_sql(hex_text: str) -> str:
    """SQL for the CRC-32 of the bytes that a text of hex digits names, with crc_table in scope as t."""
    pairs = f"list_transform(range(0, (length({hex_text}) // 2)::BIGINT), lambda j: ('0x' || substr({hex_text}, (2 * j + 1)::BIGINT, 2))::BIGINT)"
    return f"xor(list_reduce({pairs}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


SQL = f"""
WITH {CRC_SQL.strip()},
d AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
v AS (SELECT w, hex(w) AS x FROM (SELECT w FROM d UNION SELECT w FROM b)),
k AS (SELECT w, {crc_sql("x")} % {BUCKETS} AS bin FROM v, crc_table),
s AS (SELECT bin, count(*) AS s FROM d JOIN k USING (w) GROUP BY bin), t AS (SELECT bin, count(*) AS t FROM b JOIN k USING (w) GROUP BY bin),
z AS (SELECT (SELECT count(*) FROM d) AS s_all, (SELECT count(*) FROM b) AS t_all),
g AS (SELECT bin, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + {BUCKETS}) / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + {BUCKETS}))))::BIGINT AS gain FROM (SELECT DISTINCT bin FROM k) LEFT JOIN s USING (bin) LEFT JOIN t USING (bin), z),
m AS (SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM d JOIN k USING (w) JOIN g USING (bin) GROUP BY doc_id),
r AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM documents LEFT JOIN m USING (doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS able FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank FROM o
"""
