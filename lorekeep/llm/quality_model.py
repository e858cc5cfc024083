"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted cyclically, one feature at a time, and summed into one lookup table a feature; then the pairs of features
that explain most of the remaining gradient get a two-dimensional table each, boosted in the same way. A score is the
sigmoid of the sum of looked-up values: bin every feature, add.

The model is fitted on at most `max_rows` labelled rows (a documented bound, chosen by a hash of the id); only the features travel to the
driver. Scores cover every whole text. Null and empty texts have all features 0; null ids count as not held out and are not learned
from; null labels are left out. Without labelled rows every score is 0.5."""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, id_text, parts, slices
from .quality_rules import STOP_WORDS
from .toxicity import labelled

FEATURES = (
    "log_words",
    "mean_chars",
    "symbol_share",
    "bar_share",
    "exclaim_share",
    "digit_share",
    "upper_share",
    "stop_share",
    "distinct_share",
    "top_word_share",
    "dup_line_share",
    "words_a_line",
    "stop_end_share",
    "comma_share",
    "long_word_share",
    "markup_share",
)
_STOP = frozenset(w.encode() for w in STOP_WORDS)
_SYMBOLS = b"#*$%&<>~^="
_DELETE_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"


def features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = len(raw)
    count = Counter(raw.lower().split())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    left = lambda chars: size - len(raw.translate(None, chars))
    chars = sum(map(len, words))
    return [
        float(np.log1p(n)),
        chars / n,
        left(_SYMBOLS) / size,
        raw.count(b"|") / n,
        raw.count(b"!") / n,
        left(_DIGITS) / size,
        left(_DELETE_UPPER) / size,
        sum(count[w] for w in _STOP if w in count) / n,
        len(count) / n,
        max(count.values()) / n,
        (len(lines) - len(set(lines))) / len(lines),
        min(n / len(lines), 500.0),
        (raw.count(b".\n") + raw.count(b". ") + raw.endswith(b".")) / n,
        raw.count(b",") / n,
        sum(len(w) > 14 for w in words) / n,
        (raw.count(b"http") + raw.count(b"www.") + raw.count(b"@")) / n,
    ]


@dataclass
class Gam:
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    base: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            z += table[np.searchsorted(self.edges[j], x[:, j], "right")]
        for a, b, table in self.pairs:
            z += table[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return z


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """A shallow tree over ordered bins, best gain first; returns the value of each bin."""
    cg, ch = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in itertools.pairwise(cuts):
            if b - a > 1:
                i = np.arange(a + 1, b)
                gl, hl, gr, hr = cg[i] - cg[a], ch[i] - ch[a], cg[b] - cg[i], ch[b] - ch[i]
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
                gain[(hl < 1e-9) | (hr < 1e-9)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], int(i[k]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in itertools.pairwise(cuts):
        out[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, pair_bins: int = 8, rounds: int = 120, pairs: int = 6, rate: float = 0.1, ridge: float = 1.0) -> Gam:
    k = x.shape[1] if x.ndim == 2 else len(FEATURES)
    if not len(y):
        return Gam([np.zeros(0)] * k, [np.zeros(1)] * k, [np.zeros(0)] * k, [], 0.0)
    edges = [_edges(x[:, j], bins) for j in range(k)]
    coarse = [_edges(x[:, j], pair_bins) for j in range(k)]
    at = [np.searchsorted(edges[j], x[:, j], "right") for j in range(k)]
    low = [np.searchsorted(coarse[j], x[:, j], "right") for j in range(k)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(p / (1 - p)))
    z = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for j in range(k):
            g, h = slopes()
            step = rate * _tree(np.bincount(at[j], g, len(tables[j])), np.bincount(at[j], h, len(tables[j])), 4, ridge)
            tables[j] += step
            z += step[at[j]]
    # pairs: the gain of a full two-way table over what is left
    g, h = slopes()
    shape = lambda a, b: (len(coarse[a]) + 1, len(coarse[b]) + 1)

    def cells(a: int, b: int) -> np.ndarray:
        return low[a] * shape(a, b)[1] + low[b]

    gains = []
    for a, b in itertools.combinations(range(k), 2):
        size = int(np.prod(shape(a, b)))
        gains.append((float((np.bincount(cells(a, b), g, size) ** 2 / (np.bincount(cells(a, b), h, size) + 5 * ridge)).sum()), a, b))
    found = [(a, b, np.zeros(shape(a, b))) for _, a, b in sorted(gains, reverse=True)[:pairs]]
    for _ in range(rounds // 3):
        for a, b, table in found:
            g, h = slopes()
            c, (rows, cols) = cells(a, b), table.shape
            gg, hh = (np.bincount(c, v, rows * cols).reshape(rows, cols) for v in (g, h))
            # a two-way tree: split the first feature in two where it pays most, then the second within each half
            cut = max(range(1, rows), key=lambda i: gg[:i].sum() ** 2 / (hh[:i].sum() + ridge) + gg[i:].sum() ** 2 / (hh[i:].sum() + ridge), default=rows)
            step = np.zeros_like(table)
            for part in (slice(0, cut), slice(cut, rows)):
                step[part] = rate * _tree(gg[part].sum(0), hh[part].sum(0), 2, 5 * ridge)
            table += step
            z += step.ravel()[c]
    return Gam(edges, tables, coarse, found, base)


def train(docs: DataFrame, labels: DataFrame, learn, max_rows: int = 20_000) -> Gam:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            x = [features(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    sample = labelled(docs, labels, "quality", learn, max_rows).select("doc_id", "text", "y")
    got = sample.mapInArrow(run, "doc_id long, y int, x array<double>").toArrow()
    rows = sorted(zip(got["doc_id"].to_pylist(), got["y"].to_pylist(), got["x"].to_pylist(), strict=True))  # the same model however rows arrive
    x = np.array([r[2] for r in rows]) if rows else np.zeros((0, len(FEATURES)))
    return fit(x, np.array([r[1] for r in rows], float))


def score(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            z = shared.value.logit(np.array([features(t) for t in texts]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(1 / (1 + np.exp(-z)), pa.float64())], ["doc_id", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted per document; learns only where crc32(doc_id) mod 4 is not 2."""
    model = train(docs, labels, lambda k: crc_bucket(k, 4) != 2, max_rows)
    held = F.coalesce(crc_bucket(F.col("doc_id"), 4) == 2, F.lit(False))
    s = F.round("score", 6)
    return score(docs, model).select("doc_id", held.alias("held_out"), s.alias("score"), (s >= 0.7).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
