"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition `[^\x20\x09-\x0D]+`; bytes.split() uses the same six characters.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local session gets a temporary one and a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lorekeep-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: df written as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if _SCRATCH:
        _SCRATCH[-1].append(out)
    return out


_SCRATCH: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """The tables that cut() writes inside the block, for discard() when what was made of them is itself a table."""
    _SCRATCH.append([])
    try:
        yield _SCRATCH[-1]
    finally:
        _SCRATCH.pop()


def discard(*tables: DataFrame) -> None:
    """Deletes tables of cut() that nothing later reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def whole_keys(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Sorted batches as tables that end where the first `keys` columns change, so that no group is cut."""
    held: list[pa.RecordBatch] = []

    def row(batch: pa.RecordBatch, i: int) -> tuple:
        return tuple(batch.column(k)[i].as_py() for k in range(keys))

    for batch in batches:
        if not batch.num_rows:
            continue
        last = row(batch, batch.num_rows - 1)
        lo, hi = 0, batch.num_rows - 1
        while lo < hi:  # first row of the last key
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if row(batch, mid) == last else (mid + 1, hi)
        if lo == 0 and (not held or row(held[-1], 0) == last):
            held.append(batch)
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, lo)])
        held = [batch.slice(lo)]
    if held:
        yield pa.Table.from_batches(held)


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so that extra columns of any name cannot clash."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def crc_bucket(id_col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(mod)


#: Characters that a task looks at together: hashing them takes some 50 bytes for each.
RUN = 1 << 20


def runs(texts: pa.Array, limit: int = RUN) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of rows with about `limit` characters, which bounds what a task holds."""
    if not pa.types.is_string(texts.type) or not len(texts):
        yield 0, len(texts)
        return
    ends = np.cumsum(np.diff(np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)))
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield start, stop
        start = stop


def parts(batches: Iterable[pa.RecordBatch], column: int = 1) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into runs() of the texts in a column."""
    for batch in batches:
        for start, stop in runs(batch.column(column)):
            yield batch.slice(start, stop - start)


def slices(batches: Iterable[pa.RecordBatch], limit: int = RUN) -> Iterator[tuple[list, list]]:
    """Ids and texts of Arrow batches, cut into runs()."""
    for batch in batches:
        for start, stop in runs(batch.column(1), limit):
            part = batch.slice(start, stop - start)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over a uint64 array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS = np.ones(1, np.uint64)
_MUL = 0x9E3779B97F4A7C15


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        step = np.full(max(n, 2 * len(_POWERS)), _MUL, np.uint64)
        step[0] = 1
        _POWERS = np.multiply.accumulate(step)
    return _POWERS[:n]


_INVERSE = pow(_MUL, -1, 1 << 64)
_IPOWERS = np.ones(1, np.uint64)


def ipowers(n: int) -> np.ndarray:
    global _IPOWERS
    if len(_IPOWERS) < n:
        step = np.full(max(n, 2 * len(_IPOWERS)), _INVERSE, np.uint64)
        step[0] = 1
        _IPOWERS = np.multiply.accumulate(step)
    return _IPOWERS[:n]


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_table(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, hashes, counts): all words of the texts in order as places in their joined bytes, with 64-bit hashes, and the number of words of each text.

    Words are the maximal runs of bytes other than the six white-space characters; null has none. With lower, A-Z are
    folded. A word's hash depends on its bytes and its length only."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    if lower:
        up = (data >= 65) & (data <= 90)
        data = data + (up * np.uint8(32)).astype(np.uint8)
    space = _IS_SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    ends = np.flatnonzero(space & ~np.concatenate(([True], space[:-1])))
    bounds = np.cumsum([len(r) + 1 for r in raw])
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, bounds, "left"))))
    if not len(starts):
        return data, starts, ends, np.zeros(0, np.uint64), counts
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), dtype=np.uint64)))
    h = (total[ends] - total[starts]) * ipowers(len(data))[starts]
    return data, starts, ends, mix64(h ^ ((ends - starts).astype(np.uint64) << np.uint64(48))), counts


def word_hashes(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of word_table()."""
    _, _, _, h, counts = word_table(texts, lower)
    return h, counts
