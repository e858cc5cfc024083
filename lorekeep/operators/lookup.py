"""Lexical title lookup: exact title, slug, variant; then a title that contains the query; then a close spelling; else not found.

One batch of queries meets one table of titles. Each tier looks only at queries that the tiers before left open. Equality is a hash join on the
normalised key; containment joins on the query's rarest word instead of comparing all pairs; close spellings join on deletion
neighbourhoods. An ambiguous match is offered, never picked; a lone page scoped to a population that the query does not name is offered too."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from lorekeep.functions import text as T
from lorekeep.operators.analytics import written
from lorekeep.session import dealt, spread

OFFERED = 5


def keys(titles: DataFrame) -> DataFrame:
    """doc_id, title, tier (0 title, 1 slug, 2 variant), key (normalised), scope (its population or null). titles: doc_id, title, slug, variants."""
    one = lambda tier, raw: F.struct(F.lit(tier).alias("tier"), raw.alias("raw"))
    variants = F.coalesce(F.transform("variants", lambda v: one(2, v)), F.array().cast("array<struct<tier:int,raw:string>>"))
    base = titles.select("doc_id", "title", F.explode(F.concat(F.array(one(0, F.col("title")), one(1, F.coalesce("slug", "title"))), variants)).alias("k"))
    return base.select("doc_id", "title", "k.tier", T.normalise_title(F.col("k.raw")).alias("key"), T.population_tail(F.col("k.raw")).alias("scope")).where("key <> ''")


def outcome(hits: DataFrame, how: str) -> DataFrame:
    """One row per query from hits (query, doc_id, title, rank columns, offer): found for one page that need not be offered, else did_you_mean.

    Pages are counted, and the first of each title found, before a shuffle as well as after; the first titles are ranked in parts of a query's hits, then over all parts, so a query with
    any number of hits needs no task of its own."""
    counts = hits.groupBy("query").agg(F.count("*").alias("pages"), F.max("offer").alias("offer"))
    place = F.struct("r1", "r2", "r3", "doc_id")
    titles = hits.groupBy("query", "title").agg(F.min(place).alias("place")).withColumn("part", F.pmod(F.xxhash64("title"), F.lit(32)))
    for keys in (["query", "part"], ["query"]):
        titles = titles.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("place"))).where(F.col("rn") <= OFFERED)
    first = titles.groupBy("query").agg(F.min_by("place.doc_id", "place").alias("doc_id"), F.transform(F.array_sort(F.collect_list(F.struct("rn", "title"))), lambda x: x["title"]).alias("titles"))
    g = first.join(dealt(counts), "query")
    found = (F.col("pages") == 1) & ~F.col("offer")
    return g.select("query", F.when(found, "found").otherwise("did_you_mean").alias("outcome"), F.lit(how).alias("how"), F.when(found, F.col("doc_id")).alias("doc_id"), F.array_join("titles", "|").alias("titles"))


def exact(queries: DataFrame, k: DataFrame) -> DataFrame:
    hits = queries.join(dealt(k.select("doc_id", "title", "tier", "key").distinct()), F.col("q") == F.col("key"))
    least = hits.withColumn("first", F.min("tier").over(Window.partitionBy("query"))).where("tier = first").select("query", "doc_id", "title", "q").distinct()
    ranked = least.withColumn("r1", F.lit(0)).withColumn("r2", F.lit(0)).withColumn("r3", T.normalise_title(F.col("title"))).withColumn("offer", F.lit(False))
    return outcome(ranked, "exact")


def contained(queries: DataFrame, k: DataFrame) -> DataFrame:
    words = k.select("doc_id", "title", "tier", "key", "scope", F.explode(F.array_distinct(F.split("key", " "))).alias("word"))
    count = words.groupBy("word").agg(F.count("*").alias("n"))
    asked = queries.where(T.names_something(F.col("q"))).select("query", "q", F.explode(F.array_distinct(F.split("q", " "))).alias("word"))
    rare = asked.join(dealt(count), "word").groupBy("query", "q").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    hits = rare.join(dealt(words), "word").where(T.contains_words(F.col("key"), F.col("q")))
    hits = hits.withColumn("free", F.col("scope").isNull() | F.coalesce(T.contains_words(F.col("q"), F.col("scope")), F.lit(False)))
    pages = hits.groupBy("query", "doc_id", "title").agg(F.min("tier").alias("r1"), (~F.bool_or("free")).alias("offer"))
    pages = pages.withColumn("r2", F.char_length("title")).withColumn("r3", T.normalise_title(F.col("title")))
    return outcome(pages, "contained")


def osa(a: str, b: str) -> int:
    """Optimal string alignment: insertions, deletions, substitutions and swaps of neighbours cost 1, and no part is edited twice."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


@F.arrow_udf(IntegerType())
def osa_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else osa(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int32())


def deletions(df: DataFrame, text: str, most: str) -> DataFrame:
    """df with `near`: the text and what is left of it after up to `most` (0 to 2) deletions. Two texts within d edits share one."""

    def cut(t):
        return F.transform(F.sequence(F.lit(1), F.char_length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.char_length(t))))

    one = F.when((F.col(most) >= 1) & (F.char_length(text) > 0), cut(F.col(text))).otherwise(F.array().cast("array<string>"))
    d = df.withColumn("_one", one)
    two = F.when(F.col(most) >= 2, F.flatten(F.transform("_one", lambda t: F.when(F.char_length(t) > 0, cut(t)).otherwise(F.array().cast("array<string>"))))).otherwise(F.array().cast("array<string>"))
    return d.withColumn("near", F.explode(F.array_distinct(F.concat(F.array(text), "_one", two)))).drop("_one")


#: From this length on keys meet by what is left without two of their parts; shorter ones by what deletions leave.
LONG, PARTS = 15, 8


def _left(text: Column, n: Column, i: Column, j: Column, between: Column, after: Column) -> Column:
    """Hash of a text without parts i < j of a key of length n: what stands before i, between them, shifted by `between`, and after j, shifted by `after`."""
    start = lambda x: F.floor(x * n / PARTS).cast("int")
    return F.xxhash64(n, i, j, F.substring(text, F.lit(1), start(i)), F.substring(text, start(i + 1) + between + 1, start(j) - start(i + 1)), F.substring(text, start(j + 1) + after + 1, n - start(j + 1)))


def segments(df: DataFrame, text: str) -> DataFrame:
    """df with sig: the text cut into PARTS, without two of them, in every way."""
    ways = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(PARTS) for j in range(i + 1, PARTS)])
    return df.select("*", F.explode(F.transform(ways, lambda w: _left(F.col(text), F.char_length(text), w["i"], w["j"], F.lit(0), F.lit(0)))).alias("sig"))


def probes(df: DataFrame, text: str) -> DataFrame:
    """df with sig: what this text has in common with every key of length LONG or more that is within two edits of it.

    Two edits inside parts of the key touch two of them at most, and shift what follows by what they add or take. A swap across a cut touches two parts by itself: it is undone first, at every place, and the one edit that is then left
    touches one part, or two that are neighbours."""
    w = lambda i, j, s, d: F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(s).alias("s"), F.lit(d).alias("d"))
    both = F.array(*[w(i, j, s, d) for i in range(PARTS) for j in range(i + 1, PARTS) for s in range(-2, 3) for d in range(-2, 3) if abs(s) + abs(d - s) <= 2])
    one = F.array(*[w(i, i + 1, 0, d) for i in range(PARTS - 1) for d in (-1, 0, 1)])
    t = F.col(text)
    undone = df.select("*", F.explode(F.when(F.char_length(t) > 1, F.sequence(F.lit(1), F.char_length(t) - 1)).otherwise(F.array().cast("array<int>"))).alias("_p"))
    undone = undone.select(*df.columns, F.concat(F.substring(t, F.lit(1), F.col("_p") - 1), F.substring(t, F.col("_p") + 1, F.lit(1)), F.substring(t, F.col("_p"), F.lit(1)), F.substring(t, F.col("_p") + 2, F.char_length(t))).alias("_t"), F.explode(one).alias("_w"))
    d = df.select("*", t.alias("_t"), F.explode(both).alias("_w")).unionByName(undone).withColumn("_n", F.char_length("_t") - F.col("_w.d")).where(F.col("_n") >= LONG)
    size = lambda x: F.floor((x + 1) * F.col("_n") / PARTS) - F.floor(x * F.col("_n") / PARTS)
    d = d.where((size(F.col("_w.i")) + F.col("_w.s") >= 0) & (size(F.col("_w.j")) + F.col("_w.d") - F.col("_w.s") >= 0))
    return d.select(*df.columns, _left(F.col("_t"), F.col("_n"), F.col("_w.i"), F.col("_w.j"), F.col("_w.s"), F.col("_w.d")).alias("sig")).distinct()


def close(queries: DataFrame, k: DataFrame) -> DataFrame:
    q = queries.withColumn("budget", T.max_edits(F.char_length("q"))).where("budget > 0")
    # lengths of a pair differ by its edits at most: a key or query without a partner of such a length stays out. Each table has a row for a length at most.
    n, size = F.char_length("q"), F.char_length("key")
    asked = q.select(F.explode(F.sequence(n - F.col("budget"), n + F.col("budget"))).alias("n")).distinct()
    known = k.select(size.alias("n")).distinct().select("n", F.explode(F.sequence(F.lit(-2), F.lit(2))).alias("d")).groupBy((F.col("n") + F.col("d")).alias("n")).agg(F.min(F.abs("d")).alias("least"))
    few = k.select("key").join(F.broadcast(asked), size == F.col("n"), "left_semi").distinct()
    q = q.join(F.broadcast(known), (n == F.col("n")) & (F.col("least") <= F.col("budget")), "left_semi")
    short = deletions(q.where(F.char_length("q") <= LONG + 1), "q", "budget").join(dealt(deletions(few.where(F.char_length("key") < LONG).withColumn("most", F.lit(2)), "key", "most")), "near")
    long = probes(q, "q").join(dealt(segments(few.where(F.char_length("key") >= LONG), "key")), "sig")
    pairs = short.select("query", "q", "budget", "key").unionByName(long.select("query", "q", "budget", "key")).distinct()
    # a swap is two edits to the built-in distance: what is beyond twice the budget there is beyond it here
    near = pairs.where((F.abs(F.char_length("key") - F.char_length("q")) <= F.col("budget")) & (F.levenshtein("q", "key") <= 2 * F.col("budget")))
    near = near.withColumn("d", osa_distance("q", "key")).where("d <= budget")
    pages = near.join(dealt(k.select("doc_id", "title", "key").distinct()), "key").groupBy("query", "doc_id", "title").agg(F.min("d").alias("r1"))
    pages = pages.withColumn("r2", F.lit(0)).withColumn("r3", T.normalise_title(F.col("title"))).withColumn("offer", F.lit(True))
    return outcome(pages, "close")


def lookup(queries: DataFrame, titles: DataFrame) -> DataFrame:
    """query, outcome (found, did_you_mean, not_found), how, doc_id, titles (joined by |). queries: query (repeats are answered once).

    The keys and the answers of each tier are written once; a tier reads only the queries that are left."""
    k = written(keys(titles), "keys")
    q = written(queries.select("query").distinct().withColumn("q", T.normalise_title(F.col("query"))), "queries")
    done = written(exact(q.where("q <> ''"), k), "exact")
    inside = written(contained(q.where("q <> ''").join(dealt(done), "query", "left_anti"), k), "contained")
    left = spread(written(q.where("q <> ''").join(dealt(done.select("query").union(inside.select("query"))), "query", "left_anti"), "left"))
    out = done.unionByName(inside).unionByName(close(left, k))
    return q.select("query").join(dealt(out), "query", "left").select("query", F.coalesce("outcome", F.lit("not_found")).alias("outcome"), "how", "doc_id", "titles")
