"""Close spellings of long titles: none within two edits is lost, and titles that share most of their words are not all compared."""

import random

from pyspark.sql import functions as F

from lorekeep.operators import lookup as L


def edited(r, t):
    for _ in range(r.choice([1, 2])):
        p = r.randrange(len(t) - 1)
        t = r.choice([t[:p] + t[p + 1 :], t[:p] + r.choice("abz1") + t[p:], t[:p] + r.choice("abz1") + t[p + 1 :], t[:p] + t[p + 1] + t[p] + t[p + 2 :], t[:p] + t[p + 1] + t[p] + t[p + 2 :]])
    return t


def test_every_pair_within_two_edits_meets(spark):
    r = random.Random(8)
    keys = ["".join(r.choices("abcdefgh123", k=n)) for n in range(15, 40) for _ in range(6)]
    pairs = [(edited(r, k), k) for k in keys for _ in range(12)]
    pairs = [(q, k) for q, k in pairs if L.osa(q, k) <= 2]
    d = spark.createDataFrame(pairs, "q string, key string").distinct().repartition(8).cache()
    met = L.probes(d.select("q").distinct(), "q").join(L.segments(d.select("key").distinct(), "key"), "sig").select("q", "key").distinct()
    assert d.join(met, ["q", "key"], "left_anti").collect() == []


def test_common_words_alone_do_not_meet(spark):
    keys = spark.range(3000).select(F.concat(F.lit("large ring "), (F.col("id") * 7919 + 1_000_000).cast("string")).alias("key"))
    q = keys.where("hash(key) % 50 = 0").select(F.concat(F.lit("alrge"), F.substring("key", 6, 99)).alias("q"))
    met = L.probes(q, "q").join(L.segments(keys, "key"), "sig").select("q", "key").distinct().count()
    assert met < q.count() * 3000 / 50


def test_only_tables_of_lengths_are_broadcast(spark):
    """However small the files that titles and queries come from: what they become on the way can be hundreds of times as much, and would pass through the driver."""
    titles = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("large green ring "), (F.col("id") * 7919 + 1_000_000).cast("string")).alias("title"), F.lit(None).cast("string").alias("slug"), F.array(F.concat(F.lit("ring "), F.col("id").cast("string"))).alias("variants"))
    queries = titles.where("doc_id % 10 = 0").select(F.concat(F.lit("alrge"), F.substring("title", 6, 99)).alias("query"))
    out = L.lookup(queries, titles)
    assert {r.outcome for r in out.collect()} == {"did_you_mean"} and out.where("how = 'close'").count() == 30
    k, q = L.keys(titles), queries.withColumn("q", L.T.normalise_title(F.col("query")))
    sent = {}
    for name, df in (("exact", L.exact(q, k)), ("contained", L.contained(q, k)), ("close", L.close(q, k)), ("lookup", out)):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        sent[name] = plan.count("BroadcastHashJoin") + plan.count("BroadcastNestedLoopJoin")
    assert sent["exact"] == sent["contained"] == 0
    assert sent["close"] == sent["lookup"]  # the two lengths of close(), once for each of its branches
