"""Near-duplicate detection with an LSH forest.

Equal shingle sets are one class from the start; only the smallest id of a class enters the forest. Each class gets MinHash values, cut
into `TREES` paths of `DEPTH` values; each tree is a sorted order of the paths. Classes that share the first `START` values of a path form
a region. Only regions with two members or more are gathered, with one byte of each of the 120 values for an estimate.

In a region, rows that stand next to each other in the sorted order, those with the longest common prefixes, are united first if their estimate
is likely; what that leaves apart is compared at the region's own depth with all other rows. So the depth adapts: a region of copies is
solved by its neighbours, a mixed one goes up to the first `START` values. Out come no pairs but a spanning forest of the likely ones, fewer rows than members.

The components of these forests are groups: every pair that is likely in some region lies in one group. A group's texts are gathered
once and its components found exactly, on full sets. A group (or a region) too large for one task is dealt to blocks: each block alone, each with the
next, and then the blocks of everything outside its largest component with all blocks, so all pairs of different components meet; no pair is given up.

At a similarity of 0.8, a pair shares 3 values of at least one of 20 paths with probability 1 - 6e-7, and its estimate reaches `LIKELY` with probability
1 - 1e-7. More similar pairs are lost far more rarely. No size of a region, group or class changes these odds.

Null texts and texts without words have an empty set: linked with nothing, their own component. Rows with a null id are linked with nothing
and kept; their component is null. Rows that repeat an id are judged each by its own text; two of them that are both the smallest of their class are one node.
Shingles stand for their 64-bit digests, equal sets for 128-bit ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import RUN, cut, id_text, mix64, slices, whole_keys, word_hashes
from .components import components, roots_of

TREES, DEPTH, START = 20, 6, 3
HASHES = TREES * DEPTH
#: Regions up to this size compare all pairs at once, many regions together.
SMALL = 32
#: Rows of one task's region; rows and shingles of one task's group. What is larger is dealt to blocks that all meet.
REGION_ROWS, GROUP_ROWS, GROUP_SHINGLES = 1 << 15, 1 << 15, 1 << 21
#: Agreeing values of 120 from which a pair is likely: at a similarity of 0.8 it is 96 on average, with a deviation of 4.4.
LIKELY = 72
#: At most this many classes are so large that their rows are not shuffled to find their class.
HOT_CLASSES = 2048

_rng = np.random.default_rng(20240607)
_A = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_C = np.uint64(0x9FB21C651E98DF25)


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct digests of each text's shingles; about RUN characters are hashed together."""
    out: list[np.ndarray] = []
    start = held = 0
    for i, text in enumerate(texts, 1):
        held += len(text or "")
        if held >= RUN or i == len(texts):
            out += _shingle_sets(texts[start:i], size)
            start, held = i, 0
    return out


def _shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    h, counts = word_hashes(texts, lower=True)
    out, at = [], 0
    if len(h):
        rolled = h.copy()
        for k in range(1, size):
            rolled[:-k] = mix64(rolled[:-k] * _C + h[k:]) if k < len(h) else rolled[:-k]
    for n in counts:
        if n >= size:
            out.append(np.unique(rolled[at : at + n - size + 1]))
        elif n:
            x = np.array([n], np.uint64)
            for w in h[at : at + n]:
                x = mix64(x * _C + w)
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def signature(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
    best = None
    for i in range(0, len(x), 2048):  # long texts in runs
        part = (x[None, i : i + 2048] * _A[:, None] + _B[:, None]).min(axis=1)
        best = part if best is None else np.minimum(best, part)
    return best


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            sets = shingle_sets(texts, size)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([signature(s).astype(">u4").tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "n_shingles", "digest", "sig"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, sig binary")


def entries(reps: DataFrame) -> DataFrame:
    """A row for each class and tree: key of the region, id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _values(batch.column(1)).reshape(batch.num_rows, TREES, DEPTH).astype(np.uint64)
            key = np.broadcast_to(mix64(np.arange(1, TREES + 1, dtype=np.uint64)), sig.shape[:2])
            for k in range(START):
                key = mix64(key * _C + sig[:, :, k])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).reshape(-1)), pa.array(np.repeat(batch.column(0).to_numpy(), TREES)), pa.array(np.tile(np.arange(TREES, dtype=np.int8), batch.num_rows))], ["key", "id", "tree"])

    return reps.select("id", "sig").mapInArrow(run, "key long, id long, tree byte")


def _values(sigs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sigs.to_pylist()), ">u4").reshape(-1, HASHES)


def _fits(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


class Parts:
    """Labels of rows that links unite; the largest part is known throughout."""

    def __init__(self, label: np.ndarray) -> None:
        _, self.label = np.unique(label, return_inverse=True)
        self.size = np.bincount(self.label)
        self.done = np.zeros(len(label), bool)

    def unite(self, i: int, others: np.ndarray) -> None:
        gone = np.unique(self.label[others])
        gone = gone[gone != self.label[i]]
        if len(gone):
            self.label[np.isin(self.label, gone)] = self.label[i]
            self.size[self.label[i]] += self.size[gone].sum()
            self.size[gone] = 0

    def open_rows(self, among: np.ndarray | None = None) -> Iterator[int]:
        """Rows to be compared with all of other parts, until any two parts have one whose rows all were. Rows of the largest part wait: once all others are done, nothing is left for them."""
        waiting = np.arange(len(self.label)) if among is None else among
        while len(waiting):
            later = []
            for i in waiting:
                if self.label[i] == self.size.argmax():
                    later.append(i)
                else:
                    yield i
                    self.done[i] = True
            waiting = np.array(later, np.int64)
            if not len(waiting) or (self.label[waiting] == self.size.argmax()).all():
                return


def region_forest(key: np.ndarray, ids: np.ndarray, n: np.ndarray, low: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, root) for the rows of whole regions, sorted by key and path: a spanning forest of the likely pairs of each region."""
    m = len(ids)
    region = np.cumsum(np.concatenate(([True], key[1:] != key[:-1]))) - 1
    counts = np.bincount(region)
    own = counts[region]
    likely = lambda i, j: _fits(n[i], n[j], percent) & ((low[i] == low[j]).sum(axis=1) >= LIKELY)
    out_i, out_j = [], []
    rows = np.flatnonzero(own <= SMALL)
    for k in range(1, SMALL):
        i = rows[rows + k < m]
        i = i[region[i] == region[i + k]]
        if not len(i):
            break
        for at in range(0, len(i), 1 << 16):
            part = i[at : at + (1 << 16)]
            part = part[likely(part, part + k)]
            out_i.append(part)
            out_j.append(part + k)
    starts = np.concatenate(([0], np.cumsum(counts)))
    for r in np.flatnonzero(counts > SMALL):
        at = np.arange(starts[r], starts[r + 1])
        near = at[:-1][likely(at[:-1], at[1:])]  # neighbours in the sorted order
        label = roots_of(near - starts[r], near + 1 - starts[r], len(at))
        order = np.argsort(n[at], kind="stable")  # partners of fitting size are one run
        size = n[at][order]
        parts = Parts(label[order])
        columns = np.ascontiguousarray(low[at][order].T)
        for i in parts.open_rows():
            a, b = np.searchsorted(100 * size, percent * size[i], "left"), np.searchsorted(percent * size, 100 * size[i], "right")
            other = a + np.flatnonzero(parts.label[a:b] != parts.label[i])
            if not len(other):
                continue
            block = columns[:, a:b] if 2 * len(other) > b - a else columns[:, other]
            agree = np.add.reduce((block == columns[:, i : i + 1]).view(np.uint8), axis=0, dtype=np.uint8)
            parts.unite(i, (np.arange(a, b) if 2 * len(other) > b - a else other)[agree >= LIKELY])
        _, first = np.unique(parts.label, return_index=True)
        lead = np.zeros(len(parts.size), np.int64)
        lead[parts.label[first]] = first
        out_i.append(at[order])
        out_j.append(at[order][lead[parts.label]])
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_i, out_j))
    root = roots_of(i, j, m)
    at = np.flatnonzero(root != np.arange(m))
    return ids[at], ids[root[at]]


def likely_links(reps: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of ids whose components hold every likely pair of every region."""
    forest = entries(reps)
    shared = forest.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    members = cut(forest.join(shared.hint("merge"), "key"), "members")
    few = reps.join(members.select("id").distinct().hint("merge"), "id", "left_semi")
    blocks = F.ceil(F.col("m") / REGION_ROWS).cast("int")
    mine = F.pmod(F.xxhash64("id"), blocks).cast("int")
    dealt = members.withColumn("meets", F.when(F.col("m") > REGION_ROWS, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.lit(0)))).withColumn("meets", F.explode("meets"))
    dealt = dealt.select("key", "tree", "id", F.least("meets", F.when(F.col("m") > REGION_ROWS, mine).otherwise(0)).alias("x"), F.greatest("meets", F.when(F.col("m") > REGION_ROWS, mine).otherwise(0)).alias("y"))

    def run_low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = (_values(batch.column(2)) & 0xFF).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in low], pa.binary()), batch.column(2)], ["id", "n", "low", "sig"])

    few = few.select("id", "n", "sig").mapInArrow(run_low, "id long, n int, low binary, sig binary")
    rows = dealt.join(few.hint("merge"), "id").select("key", "x", "y", F.substring("sig", F.col("tree") * (4 * DEPTH) + 1, F.lit(4 * DEPTH)).alias("path"), "id", "n", "low")
    rows = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "path", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_keys(batches, 3):
            key, x, y, _, ids, n, low = (table.column(k).combine_chunks() for k in range(7))
            key = mix64(mix64(key.to_numpy().view(np.uint64)) + (x.to_numpy().astype(np.uint64) << np.uint64(32)) + y.to_numpy().astype(np.uint64))
            low = np.frombuffer(b"".join(low.to_pylist()), np.uint8).reshape(-1, HASHES)
            a, b = region_forest(key, ids.to_numpy(), n.to_numpy().astype(np.int64), low, percent)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def block_links(ids: np.ndarray, comp: np.ndarray, own: np.ndarray, n: np.ndarray, flat: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (id, root) that unite all rows of one block, or of two blocks (own: of the first), as far as full sets link them; comp: what is known before.

    n: sizes of the sets, flat: the sets one after the other. Rows of one id are one node."""
    _, code = np.unique(flat, return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(n)))
    sets = [code[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
    mark = np.zeros(len(flat) + 1, np.int8)
    parts = Parts(comp)
    two = not own.all()
    first = own if not two or 2 * own.sum() <= len(own) else ~own
    if two:
        todo = iter(np.flatnonzero(first))
    else:
        todo = parts.open_rows()
    for i in todo:
        other = (parts.label != parts.label[i]) & _fits(n, n[i], percent)
        if two:
            other &= ~first
        other = np.flatnonzero(other)
        if not len(other):
            continue
        mark[sets[i]] = 1
        if 4 * n[other].sum() > starts[-1]:
            inter = np.add.reduceat(mark[code], starts[:-1], dtype=np.int64)[other]
        else:
            inter = np.add.reduceat(mark[np.concatenate([sets[j] for j in other])], np.concatenate(([0], np.cumsum(n[other])[:-1])), dtype=np.int64)
        mark[sets[i]] = 0
        parts.unite(i, other[100 * inter >= percent * (n[other] + n[i] - inter)])
    order = np.lexsort((ids, parts.label))
    head = np.concatenate(([True], parts.label[order][1:] != parts.label[order][:-1]))
    root = ids[order][np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    at = ids[order] != root
    return ids[order][at], root[at]


def group_links(docs: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) found on full sets in each (grp, x, y); rows: grp, x, y, own, id, comp, one for each group or pair of blocks a document goes to."""
    # merge joins here and above: the same plan at every size, none that is cheap as long as a side happens to fit a broadcast
    texts = docs.join(rows.select(F.col("id").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    dealt = rows.hint("merge").join(texts.withColumnRenamed("doc_id", "id"), "id").select("grp", "x", "y", "own", "id", "comp", "text")
    dealt = dealt.repartition("grp", "x", "y").sortWithinPartitions("grp", "x", "y", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_keys(batches, 3):
            grp, x, y, own, ids, comp = (table.column(k).to_numpy() for k in range(6))
            cuts = np.flatnonzero((grp[1:] != grp[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            out_a, out_b = [], []
            for a, b in zip([0, *cuts], [*cuts, len(grp)], strict=True):
                sets = shingle_sets(table.column(6).slice(a, b - a).to_pylist(), size)
                some = np.array([len(s) > 0 for s in sets])  # an id may also have an empty text
                sets = [s for s in sets if len(s)]
                if len(sets) < 2:
                    continue
                found = block_links(ids[a:b][some], comp[a:b][some], own[a:b][some], np.array([len(s) for s in sets]), np.concatenate(sets), percent)
                out_a.append(found[0])
                out_b.append(found[1])
            out = [np.concatenate(o) if o else np.zeros(0, np.int64) for o in (out_a, out_b)]
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def exact_components(docs: DataFrame, reps: DataFrame, groups: DataFrame, size: int, percent: int, max_rows: int = GROUP_ROWS, max_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """(node, component) of the linked ids. groups: node, component of the likely links."""
    rows = groups.select(F.col("component").alias("grp"), F.col("node").alias("id")).join(reps.select("id", "n"), "id")
    blocks = lambda m, w: F.greatest(F.ceil(m / max_rows), F.ceil(w / max_shingles), F.lit(1)).cast("int")
    sizes = rows.groupBy("grp").agg(F.count("*").alias("m"), F.sum("n").alias("w")).select("grp", blocks(F.col("m"), F.col("w")).alias("blocks"))
    rows = cut(rows.join(sizes, "grp"), "groups")
    deal = lambda k: F.pmod(F.xxhash64("id"), k).cast("int")
    whole = rows.where("blocks = 1").select("grp", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(True).alias("own"), "id", F.col("id").alias("comp"))
    large = rows.where("blocks > 1")
    ring = large.withColumn("block", deal(F.col("blocks"))).withColumn("x", F.explode(F.array("block", F.pmod(F.col("block") - 1 + F.col("blocks"), "blocks"))))
    # a block with the next one, all pairs of the two
    ring = ring.select("grp", "x", F.pmod(F.col("x") + 1, "blocks").alias("y"), F.lit(True).alias("own"), "id", F.col("id").alias("comp")).distinct()
    links = cut(group_links(docs, whole.union(ring), size, percent), "confirmed")
    if large.isEmpty():
        # each group gave its components as stars
        return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b").distinct())
    found = cut(components(links), "components")
    rows = large.select("grp", "id").join(found.select(F.col("node").alias("id"), "component"), "id", "left").join(reps.select("id", "n"), "id").select("grp", "id", "n", F.coalesce("component", "id").alias("comp"))
    per = rows.groupBy("grp", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    plan = per.groupBy("grp").agg(F.max(F.struct("m", "w", "comp")).alias("top"), F.sum("m").alias("m"), F.sum("w").alias("w"), F.count("*").alias("comps")).where("comps > 1")
    plan = plan.select("grp", F.col("top.comp").alias("top"), blocks(F.col("top.m"), F.col("top.w")).alias("main"), blocks(F.col("m") - F.col("top.m"), F.col("w") - F.col("top.w")).alias("rest"))
    rows = cut(rows.join(plan, "grp"), "rest")
    in_main = F.col("comp") == F.col("top")
    rows = rows.withColumn("block", F.when(in_main, F.col("rest") + deal(F.col("main"))).otherwise(deal(F.col("rest"))))
    rows = rows.withColumn("meets", F.explode(F.sequence(F.lit(0), F.when(in_main, F.col("rest") - 1).otherwise(F.col("rest") + F.col("main") - 1))))
    rows = rows.select("grp", F.least("block", "meets").alias("x"), F.greatest("block", "meets").alias("y"), (F.col("block") <= F.col("meets")).alias("own"), "id", "comp")
    more = group_links(docs, rows, size, percent)
    return cut(components(links.union(more).union(found.select("node", "component").where("node <> component"))), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, max_rows: int = GROUP_ROWS, max_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents linked, directly or through others, by a similarity of percent/100 or more.

    max_rows, max_shingles: what one task holds of a group, in memory; the result doesn't depend on them."""
    base = id_text(docs, id_col, text_col)
    sketch = cut(sketches(base, size), "sketches")
    filled = sketch.where("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "sig")).alias("least"), F.count("*").alias("rows"))
    classes = cut(classes.select(F.col("least.doc_id").alias("id"), F.col("least.n_shingles").cast("int").alias("n"), F.col("least.sig").alias("sig"), "digest", "rows"), "classes")
    likely = cut(likely_links(classes, percent), "likely")
    groups = cut(components(likely), "components")
    found = exact_components(base, classes, groups, size, percent, max_rows, max_shingles)
    # class -> component: the smallest id of all classes of a component, as each class is named by its smallest id
    own = classes.select("digest", "rows", F.col("id").alias("node")).join(found, "node", "left").select("digest", "rows", F.coalesce("component", "node").alias("component_id"))
    # rows of the largest classes stay where they are: at most HOT_CLASSES classes can have so many
    many = max(1024, filled.count() // HOT_CLASSES)
    hot = F.broadcast(own.where(F.col("rows") > many).select("digest", "component_id"))
    filled = filled.select("doc_id", "n_shingles", "digest")
    empty = sketch.where("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = filled.join(hot, "digest").unionByName(filled.join(hot, "digest", "left_anti").join(own.where(F.col("rows") <= many).select("digest", "component_id").hint("merge"), "digest"))
    out = out.select("doc_id", "n_shingles", "component_id").union(empty)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents"), size=2)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n_shingles, s FROM s),
x AS (SELECT doc_id, n_shingles, unnest(s) AS g FROM n),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n_shingles AS na, b.n_shingles AS nb, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id
  AND 100 * least(a.n_shingles, b.n_shingles) >= 80 * greatest(a.n_shingles, b.n_shingles) GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * i >= 80 * (na + nb - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(v, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v WHERE r.c < e.b),
c AS (SELECT v, min(c) AS component_id FROM r GROUP BY v)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c ON v = doc_id
"""
