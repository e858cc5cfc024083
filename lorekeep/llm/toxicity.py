"""Counterfactual-regularised toxicity classifier.

A logistic model over the presence of hashed words and word pairs. Learning also takes, for each labelled text with identity terms, copies in
which every term is swapped for another one of its group, and penalises the squared change of the logit, so that the
mention of a group by itself cannot raise a score. Pairs of neighbouring words are features only beside identity terms, which
is where a swap would otherwise leave a trace.

The model is fitted on at most `max_rows` labelled rows (a documented bound, chosen by a hash of the id) and is of fixed size; only
hashed features travel to the driver. Scores cover every whole text. Null and empty texts have no features and get the score of the
intercept; ids that are null count as not held out and are not learned from; labels that are null are left out; repeated label rows weigh
as often as they stand there. Without any labelled row of either label all scores are 0.5 or the base rate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, id_text, parts, slices

BITS = 18
SIZE = 1 << BITS
PUNCTUATION = ".,;:!?\"'()[]{}*#%&$|<>_-"

#: Identity terms by group (fixed values); a term may be swapped for any other of its group.
IDENTITY = {
    "gender": "woman women man men girl boy girls boys female male femme homme frau mann mujer hombre".split(),
    "orientation": "gay lesbian straight bisexual transgender queer homosexual heterosexual".split(),
    "religion": "muslim christian jewish hindu buddhist atheist catholic protestant".split(),
    "origin": "black white asian african european american mexican chinese indian arab".split(),
    "age": "old young elderly teenage".split(),
    "ability": "disabled deaf blind autistic".split(),
}
GROUP = {t: g for g, terms in IDENTITY.items() for t in terms}


def bucket(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature.encode("utf-8", "surrogatepass")) & (SIZE - 1)


class Words(dict):
    """Word as it stands -> normalised word; kept between texts, emptied when large."""

    def __missing__(self, word: str) -> str:
        if len(self) > 500_000:
            self.clear()
        self[word] = out = word.lower().strip(PUNCTUATION)
        return out


class Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = out = bucket(word)
        return out


_WORDS, _BUCKETS = Words(), Buckets()


def words_of(text: str | None) -> list[str]:
    return [w for w in map(_WORDS.__getitem__, (text or "").split()) if w]


def hashed(words: list[str], present: set[str] | None = None) -> set[int]:
    """Hashed features of a text; present: the set of its words."""
    present = present if present is not None else set(words)
    out = set(map(_BUCKETS.__getitem__, present))
    if not GROUP.keys().isdisjoint(present):
        for i, w in enumerate(words):
            if w in GROUP:
                out.update(bucket(f"{a} {b}") for a, b in ((words[i - 1] if i else "", w), (w, words[i + 1] if i + 1 < len(words) else "")))
    return out


def swapped(words: list[str], turn: int) -> list[str] | None:
    """The text with each identity term replaced by the turn-th next of its group; None without terms."""
    if GROUP.keys().isdisjoint(words):
        return None
    return [IDENTITY[g][(IDENTITY[g].index(w) + turn) % len(IDENTITY[g])] if (g := GROUP.get(w)) else w for w in words]


class Sparse:
    """Rows of feature ids with values, as flat arrays."""

    def __init__(self, rows: list, values: list | None = None):
        self.n = len(rows)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.col = np.concatenate([np.asarray(r, np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
        self.val = np.concatenate([np.asarray(v, float) for v in values]) if values else np.ones(len(self.col))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col] * self.val, self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, g[self.row] * self.val, SIZE)


def fit(rows: list, labels: np.ndarray, changes: list[tuple[list, list]], ridge: float = 2e-4, counterfactual: float = 1.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights and intercept: mean log loss + ridge/2 |w|^2 + counterfactual/2 x mean squared logit change of the swaps, by Adam."""
    w, b = np.zeros(SIZE), 0.0
    if not rows:
        return w, b
    rate = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    b = float(np.log(rate / (1 - rate)))
    x = Sparse(rows)
    d = Sparse([c for c, _ in changes], [v for _, v in changes]) if changes else None
    scale = evidence(x, labels)
    x.val *= scale[x.col]
    if d is not None:
        d.val *= scale[d.col]
    seen = np.flatnonzero(scale)
    m, v = np.zeros(SIZE), np.zeros(SIZE)
    mb = vb = 0.0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w) + b, -30, 30)))
        g = x.back((p - labels) / x.n) + ridge * w
        if d is not None and d.n:
            g += counterfactual * d.back(d.dot(w) / d.n)
        gb = float((p - labels).mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate_t = 0.05 * (1 - t / (steps + 1)) + 1e-3
        w[seen] -= rate_t * (m[seen] / (1 - 0.9**t)) / (np.sqrt(v[seen] / (1 - 0.99**t)) + 1e-6)
        b -= rate_t * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    return w * scale, b


def evidence(x: Sparse, labels: np.ndarray) -> np.ndarray:
    """A scale of each feature: its absolute smoothed log odds between the labels, shrunk where few texts have it."""
    pos = np.bincount(x.col, labels[x.row], SIZE)
    all_ = np.bincount(x.col, minlength=SIZE).astype(float)
    odds = np.log((pos + 0.5) / (labels.sum() + 1)) - np.log((all_ - pos + 0.5) / ((1 - labels).sum() + 1))
    return np.abs(odds) * all_ / (all_ + 10) * (all_ >= 3)


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn, max_rows: int) -> DataFrame:
    """At most max_rows (doc_id, text, y) rows, one an id, that the condition `learn` on doc_id admits, those with the least hash of the id. Repeated ids: the least label, the least text.

    The ids are broadcast: max_rows bounds their number, and no text that isn't in the sample is shuffled."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & learn(F.col("doc_id")))
    y = y.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64(F.col("doc_id")), "doc_id").limit(max_rows)
    return id_text(docs).join(F.broadcast(y), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


def train(docs: DataFrame, labels: DataFrame, label: str, learn, max_rows: int = 12_000, swaps: int = 2) -> tuple[np.ndarray, float]:
    """Fits on the hashed features of a bounded sample of labelled rows."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            ys, own, gone, come = part.column(2).to_pylist(), [], [], []
            for text in part.column(1).to_pylist():
                words = words_of(text)
                f = hashed(words)
                own.append(sorted(f))
                others = [hashed(s) for k in range(1, swaps + 1) if (s := swapped(words, k))]
                gone.append([sorted(f - o) for o in others])
                come.append([sorted(o - f) for o in others])
            kind = pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(own, pa.list_(pa.int32())), pa.array(gone, kind), pa.array(come, kind)], ["y", "own", "gone", "come"])

    sample = labelled(docs, labels, label, learn, max_rows).select("doc_id", "text", "y")
    table = sample.mapInArrow(features, "y int, own array<int>, gone array<array<int>>, come array<array<int>>").toArrow()
    rows, y = table["own"].to_pylist(), np.array(table["y"].to_pylist(), float)
    order = sorted(range(len(rows)), key=lambda i: (rows[i], y[i]))  # the same model however the rows arrive
    rows, y = [rows[i] for i in order], y[order] if len(order) else y
    gone, come = table["gone"].to_pylist(), table["come"].to_pylist()
    changes = [(g + c, [-1.0] * len(g) + [1.0] * len(c)) for i in order for g, c in zip(gone[i], come[i], strict=True) if g or c]
    return fit(rows, y, changes)


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row, over the whole text."""
    spark = docs.sparkSession
    w, b = model
    shared = spark.sparkContext.broadcast((w.astype(np.float32), float(b)))  # 2^18 floats: a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        for ids, texts in slices(batches):
            feats = [hashed(words, set(words)) for words in map(words_of, texts)]
            n = np.array([len(f) for f in feats])
            flat = np.fromiter((i for f in feats for i in f), np.int64, int(n.sum()))
            z = np.bincount(np.repeat(np.arange(len(feats)), n), w[flat].astype(float), len(feats)) + b if len(flat) else np.full(len(feats), b)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(p, pa.float64())], ["doc_id", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> DataFrame:
    """doc_id, held_out, score, predicted per document; learns only where crc32(doc_id) mod 5 is not 0."""
    model = train(docs, labels, "toxic", lambda k: crc_bucket(k, 5) != 0, max_rows)
    out = score(docs, model)
    held = F.coalesce(crc_bucket(F.col("doc_id"), 5) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.round("score", 6).alias("score"), (F.round("score", 6) >= 0.5).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
