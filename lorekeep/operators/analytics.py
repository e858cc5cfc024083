"""Evaluation, entitlements, clusters and integrity checks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.storage import discard, shared_dir, written


def percentiles(df: DataFrame, group: str, value: str) -> DataFrame:
    """Nearest-rank p50 and p95, and the largest.

    Values are counted, dealt by range of (group, value) and written to the shared folder; each file's totals by group, a small table, say where its running
    counts start. No task holds a group: one of any size is spread over the ranges."""
    spark = df.sparkSession
    counts = df.select(F.col(group).alias("g"), F.col(value).alias("v")).groupBy("g", "v").agg(F.count("v").alias("c"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    path = f"{shared_dir(df)}/percentiles-{uuid.uuid4().hex}"
    counts.repartitionByRange(parts, "g", "v").withColumn("part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.schema("g " + counts.schema["g"].dataType.simpleString() + ", v " + counts.schema["v"].dataType.simpleString() + ", c long, part int").parquet(path)
    totals = dealt.groupBy("g", "part").agg(F.sum("c").alias("here"), F.max("v").alias("largest"))
    sizes = totals.groupBy("g").agg(F.sum("here").alias("n"), F.max("largest").alias("largest"))
    before = totals.select("g", "part", (F.sum("here").over(Window.partitionBy("g").orderBy("part")) - F.col("here")).alias("before"))
    starts = before.join(sizes, before["g"].eqNullSafe(sizes["g"])).select(before["g"].alias("g2"), F.col("part").alias("part2"), "before", "n")
    placed = dealt.where("c > 0").join(starts, dealt["g"].eqNullSafe(F.col("g2")) & (F.col("part") == F.col("part2"))).select("g", "part", "v", "c", "before", "n")
    run = placed.withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("g", "part").orderBy("v")))
    at = lambda p: F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * F.lit(p)), F.col("v")))
    ranks = run.groupBy("g").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))
    return sizes.join(ranks.withColumnRenamed("g", "g2"), sizes["g"].eqNullSafe(F.col("g2")), "left").select(F.col("g").alias(group), "p50", "p95", "largest", "n")


def entitlement_upsert(events: DataFrame) -> DataFrame:
    """One row per (user, model) from grants in any order: a lifetime grant dominates, else the latest end. events: user_id, model_id, expires_at (null: for life)."""
    g = events.groupBy("user_id", "model_id").agg(F.bool_or(F.col("expires_at").isNull()).alias("lifetime"), F.max("expires_at").alias("latest"), F.count("*").alias("n_grants"))
    return g.select("user_id", "model_id", "lifetime", F.when(~F.col("lifetime"), F.col("latest")).alias("expires_at"), "n_grants")


def over_cap(rows: DataFrame, user: str, cap: int) -> DataFrame:
    return rows.groupBy(user).agg(F.count("*").alias("n")).where(F.col("n") >= cap)


def pair_verdicts(arms: DataFrame) -> DataFrame:
    """Per item PASS, FAIL or UNDECIDED from a target and a control arm (item, arm, hit); FAIL over UNDECIDED over PASS. A missing arm or value is undecided."""
    g = arms.groupBy("item").agg(F.max(F.when(F.col("arm") == "target", F.col("hit").cast("int"))).alias("target"), F.max(F.when(F.col("arm") == "control", F.col("hit").cast("int"))).alias("control"))
    verdict = F.when((F.col("target") == 0) | (F.col("control") == 1), "FAIL").when(F.col("target").isNull() | F.col("control").isNull(), "UNDECIDED").otherwise("PASS")
    return g.select("item", verdict.alias("verdict"))


def index_check(index: DataFrame, disk: DataFrame, key: str) -> DataFrame:
    """Rows that stand on one side alone or differ in size: key, problem."""
    both = index.select(F.col(key), F.col("size").alias("index_size")).join(disk.select(F.col(key), F.col("size").alias("disk_size")), key, "full_outer")
    problem = F.when(F.col("index_size").isNull(), "not in index").when(F.col("disk_size").isNull(), "not on disk").when(F.col("index_size") != F.col("disk_size"), "size differs")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of one task, a run at a time, as links of every node to the smallest one it reaches among them: the same clusters, fewer steps between."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        up: dict = {}

        def root(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for batch in held:
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
        pairs = [(x, root(x)) for x in list(up)]
        kind = held[0].schema.field(0).type
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs if p[0] != p[1]], kind) for k in (0, 1)], ["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= CONTRACT:
            yield stars(held)
            held = []
    if held:
        yield stars(held)


#: Links that one step of contracted() holds.
CONTRACT = 1 << 18


def clusters(members: DataFrame, entry: str, key: str, rounds: int = 100) -> DataFrame:
    """entry, cluster (its smallest entry): entries that share a key, directly or through others.

    A key gives one link for each of its entries, to the key's smallest, however many there are. Tasks contract their own links; then every node passes its smallest neighbour on to its larger neighbours, and after
    that to its smaller ones, until all links end at a smallest entry. Rounds grow with the logarithm of the longest chain. Each round's table is removed when the next is written."""
    m = members.select(F.col(entry).alias("e"), F.col(key).alias("k")).where("e is not null and k is not null").distinct()
    kind = m.schema["e"].dataType.simpleString()
    low = m.groupBy("k").agg(F.min("e").alias("b"))
    links = m.join(low, "k").select(F.col("e").alias("a"), "b").where("a <> b")

    def settle(df: DataFrame) -> DataFrame:
        return written(df.distinct().mapInArrow(contracted, f"a {kind}, b {kind}").distinct(), "links")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    links = settle(links)
    seen = mark(links)
    for _ in range(rounds):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        new = settle(large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b"))
        discard(links)
        links, now = new, mark(new)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("clusters did not settle")
    return m.select("e").distinct().join(links, F.col("e") == F.col("a"), "left").select(F.col("e").alias("entry"), F.coalesce("b", "e").alias("cluster"))


#: Pieces that the titles of a class are dealt in when pairs are made, so that no two classes' pairs are one task's; entries of a class that one row holds at most.
PIECES, RUN = 16, 1024


def _in_runs(df: DataFrame, key: str, entry: str, out: str) -> DataFrame:
    """key, piece, out: entries of a class dealt by their hash, as arrays of RUN at most. One shuffle: numbers and runs are found where the pieces are."""
    keys = [key, "piece"]
    dealt = df.select(key, entry, F.pmod(F.xxhash64(entry), F.lit(PIECES)).cast("int").alias("piece")).repartition(8 * df.sparkSession.sparkContext.defaultParallelism, *keys)
    placed = dealt.withColumn("run", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(entry)) - 1) / RUN))
    return placed.groupBy(*keys, "run").agg(F.collect_list(entry).alias(out)).drop("run")


def _phrase_classes(names: DataFrame, titles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries in classes of equal names and of equal titles, each named by its smallest entry: (other, n), (entry, t), and the pairs (n, t) where a title of t holds a name of n as whole words.

    Names meet runs of a title's words of the same number of words by equality, so nothing but what holds is ever compared, however common its words."""

    def classes(df: DataFrame, column: str, key: str) -> tuple[DataFrame, DataFrame]:
        own = df.where(f"entry is not null and {column} <> ''").groupBy("entry").agg(F.array_sort(F.collect_set(column)).alias("_same"))
        low = own.groupBy("_same").agg(F.min("entry").alias(key))
        return written(own.join(low, "_same").select("entry", key), "members"), written(low, "classes")

    n_members, n_classes = classes(names, "name", "n")
    t_members, t_classes = classes(titles, "title", "t")
    n = n_classes.select("n", F.explode("_same").alias("run")).withColumn("words", F.size(F.split("run", " ")))
    t = t_classes.select("t", F.explode("_same").alias("w")).withColumn("w", F.split("w", " ")).join(F.broadcast(n.select("words").distinct()), F.col("words") <= F.size("w"))
    runs = t.select("t", "words", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("words") + 1), lambda i: F.array_join(F.slice("w", i, F.col("words")), " ")))).alias("run"))
    return n_members.withColumnRenamed("entry", "other"), t_members, written(runs.join(n, ["run", "words"]).select("n", "t").distinct(), "pairs")


def phrase_pairs(names: DataFrame, titles: DataFrame) -> DataFrame:
    """entry, other: entries whose title holds another entry's name as whole words. names: entry, name; titles: entry, title; both normalised.

    Classes of equal names and titles are compared once and then expanded: no pair is made twice. Pairs themselves can be as many as the product of two classes; where only links matter, see phrase_links().
    What is shuffled are arrays of a class's entries, names' once for each piece of the titles; pairs are made from two arrays at a time and are never held."""
    n, t, pairs = _phrase_classes(names, titles)
    tasks = 8 * names.sparkSession.sparkContext.defaultParallelism
    left = _in_runs(pairs.join(t, "t"), "n", "entry", "entries")
    right = _in_runs(n.join(pairs.select("n").distinct(), "n", "left_semi"), "n", "other", "others").select("n", "others", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))).alias("piece")).repartition(tasks, "n", "piece")
    return left.join(right.hint("merge"), ["n", "piece"]).select("entries", F.explode("others").alias("other")).select(F.explode("entries").alias("entry"), "other").where("entry <> other")


def phrase_links(names: DataFrame, titles: DataFrame) -> DataFrame:
    """entry, other: links that join the same entries as phrase_pairs(), directly or through others: each class that has a match to its smallest entry, and the smallest entries of matching classes. As many as entries and pairs of classes."""
    n, t, pairs = _phrase_classes(names, titles)
    star = lambda m, k, e: m.join(pairs.select(k).distinct(), k, "left_semi").select(F.col(e).alias("entry"), F.col(k).alias("other"))
    return star(n, "n", "other").unionByName(star(t, "t", "entry")).unionByName(pairs.select(F.col("t").alias("entry"), F.col("n").alias("other"))).where("entry <> other")


def cluster_splits(members: DataFrame, entries: DataFrame, pairs: DataFrame, seed: str, held_out: DataFrame, fakes: DataFrame | None = None) -> DataFrame:
    """entry, cluster, split, held_out: clusters by shared keys and by titles that hold a name; a whole cluster goes to one split, and is held out if any of its entries is.

    members: entry, key; entries: entry; pairs: entry, other (see phrase_links, which has fewer than phrase_pairs); held_out: entry; fakes: name, chunk_id of invented names that texts hold, which is an error."""
    from lorekeep.functions import text as T

    if fakes is not None and (found := fakes.orderBy("name", "chunk_id").first()):
        raise ValueError(f"an invented name is in the texts: {found['name']!r} in {found['chunk_id']}")

    own = entries.select("entry", F.concat(F.lit("e"), F.col("entry").cast("string")).alias("key"))
    link = pairs.select(F.col("entry"), F.concat(F.lit("e"), F.col("other").cast("string")).alias("key"))
    every = members.select("entry", F.concat(F.lit("k"), F.col("key")).alias("key")).unionByName(own).unionByName(link)
    c = clusters(every, "entry", "key")
    out = c.join(held_out.select("entry").distinct().withColumn("_h", F.lit(True)), "entry", "left")
    g = out.groupBy("cluster").agg(F.coalesce(F.bool_or("_h"), F.lit(False)).alias("held_out"))
    return c.join(g, "cluster").select("entry", "cluster", T.hash_split(seed, F.col("cluster").cast("string")).alias("split"), "held_out")


def cap_violations(new: DataFrame, existing: DataFrame, user: str, key: str, source: str, cap: int, counted: list[str]) -> DataFrame:
    """Rows of new that a cap refuses: of counted sources, for a key the user has not yet, while the user holds `cap` rows of counted sources or more."""
    held = existing.where(F.col(source).isin(counted)).groupBy(user).agg(F.count("*").alias("_n"))
    fresh = new.where(F.col(source).isin(counted)).join(existing.select(user, key).distinct(), [user, key], "left_anti")
    return fresh.join(held.where(F.col("_n") >= cap).select(user), user, "left_semi").select(user, key)


UNCLEAR = "UNCLEAR"


def score_pairs(pairs: DataFrame) -> DataFrame:
    """item, outcome, clauses: both arms by one measure. pairs: item, target, control (values, null: no transcript), target_expect, control_expect (arrays that share nothing).

    FAIL over UNDECIDED over PASS; a missing or unclear arm is undecided, and never hides the other arm's failure. Overlapping expectations are `invalid`."""

    def arm(name: str):
        v, want = F.col(name), F.col(f"{name}_expect")
        return F.when(v.isNull(), "missing").when(v == UNCLEAR, "unclear").when(F.array_contains(want, v), "as-expected").otherwise("wrong")

    p = pairs.withColumn("_t", arm("target")).withColumn("_c", arm("control"))
    has = lambda *x: F.col("_t").isin(*x) | F.col("_c").isin(*x)
    outcome = F.when(F.arrays_overlap("target_expect", "control_expect"), "invalid").when(has("wrong"), "FAIL").when(has("missing", "unclear"), "UNDECIDED").otherwise("PASS")
    return p.select("item", outcome.alias("outcome"), F.concat_ws("|", F.concat(F.lit("target-"), "_t"), F.concat(F.lit("control-"), "_c")).alias("clauses"))
