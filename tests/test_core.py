"""Edge cases of the package's own operators; whole queries are compared with DuckDB in test_oracle.py."""

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.functions import vectors as V
from lorekeep.operators import analytics, conversation, lookup, retrieval, tokens
from lorekeep.streaming import thermal


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("given", "want"),
    [("Crohn's disease", "crohn disease"), ("Co-codamol / Élan", "co codamol elan"), ("Straße", "strasse"), ("it'sy", "it sy"), ("!!!", ""), ("mother’s", "mother"), (None, None)],
)
def test_normalise_title(spark, given, want):
    assert one(spark, T.normalise_title, given) == want


@pytest.mark.parametrize(("given", "want"), [("Anxiety in children", "children"), ("Paracetamol for adults", "adults"), ("Asthma", None), ("Advice for carers for adults", None), ("Asthma (in children)", None)])
def test_population_tail(spark, given, want):
    assert one(spark, T.population_tail, given) == want


def test_citations(spark):
    row = spark.createDataFrame([("see [1], [2, 3] and [4a]",)], "t string").select(*T.citations_in(F.col("t"))).first()
    assert list(row) == [[1, 2, 3], True]


@pytest.mark.parametrize(("a", "b", "d"), [("", "", 0), ("ab", "ba", 1), ("asthma", "ashtma", 1), ("ca", "abc", 3), ("é", "e", 1), ("abcd", "", 4)])
def test_osa(a, b, d):
    assert lookup.osa(a, b) == d


def test_vectors(spark):
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>").select(V.quantize_int8(V.l2_normalize(F.col("v"))).alias("q"))
    assert [list(r.q) for r in v.collect()] == [[76, 102], [0, 0]]
    mixed = spark.createDataFrame([([1, 2], [3, 4]), ([1], [1, 2])], "a array<tinyint>, b array<tinyint>").select(V.dot_int8(F.col("a"), F.col("b")).alias("d"))
    assert [r.d for r in mixed.collect()] == [11, None]


def gate(spark, cosines):
    c = spark.createDataFrame([(1, "p", i, x) for i, x in enumerate(cosines)], "query_id long, pack_id string, chunk_id long, dense_cosine float")
    r = retrieval.pack_gate(c, 0.25, 0.25).first()
    return r and r.passed


@pytest.mark.parametrize(
    ("cosines", "want"),
    [([], None), ([0.25], True), ([0.2], False), ([0.5, 0.25], True), ([0.5, 0.3], False), ([0.5] * 9 + [0.25], True), ([0.5] * 10 + [0.1], False), ([0.9, float("nan")], False)],
)
def test_gate(spark, cosines, want):
    assert gate(spark, cosines) is want


def test_rrf_ties(spark):
    lanes = spark.createDataFrame([(1, 7, 1), (1, 7, 2), (1, 8, 1)], "q long, c long, rank int")
    got = {r.c: r.fused_score for r in retrieval.rrf(lanes, ["q", "c"]).collect()}
    assert got[7] == pytest.approx(1 / 61 + 1 / 62) and got[8] == pytest.approx(1 / 61)


def test_assemble_gates_before_fusion(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    c = spark.createDataFrame([(1, "bad", 1, 0.9, 0.9), (1, "ok", 2, 0.5, 0.5), (1, "ok", 3, 0.4, 0.4)], "query_id long, pack_id string, chunk_id long, fused_score double, dense_cosine float")
    g = spark.createDataFrame([(1, "bad", False), (1, "ok", True)], "query_id long, pack_id string, passed boolean")
    s = spark.createDataFrame([(1, 1, ""), (2, 9, "a"), (3, 9, "a")], "chunk_id long, doc_id long, section_path string")
    got = sorted((r.query_id, r.status, r.chunk_id) for r in retrieval.assemble(q, c, g, s).collect())
    assert got == [(1, "grounded", 2), (2, "no_evidence", None)]


def test_render_is_single_pass(spark):
    c = spark.createDataFrame([(1, 2, "T", "", "L1", "b {n}"), (1, 1, "T", "S", "", "a {text}")], "query_id long, n int, title string, section_path string, locator string, text string")
    assert retrieval.render_sources(c).first().sources == "[1] (T, S): a {text}\n[2] (T, L1): b {n}"


def test_lookup_outcomes(spark):
    t = spark.createDataFrame([(1, "Asthma", None, ["wheeze"]), (2, "Anxiety disorders in children", None, None), (3, "Cold", None, ["flu"]), (4, "Flu jab", None, ["flu"])], "doc_id long, title string, slug string, variants array<string>")
    q = spark.createDataFrame([(x,) for x in ("ASTHMA", "asthma", "wheeze", "anxiety disorders", "anxiety disorders in children", "flu", "ashtma", "the", "zz", "", "nonsense word")], "query string")
    got = {r.query: (r.outcome, r.doc_id, r.titles) for r in lookup.lookup(q, t).collect()}
    assert got["ASTHMA"][:2] == got["asthma"][:2] == got["wheeze"][:2] == ("found", 1)
    assert got["anxiety disorders"] == ("did_you_mean", None, "Anxiety disorders in children")
    assert got["anxiety disorders in children"][:2] == ("found", 2)
    assert got["flu"] == ("did_you_mean", None, "Cold|Flu jab")
    assert got["ashtma"] == ("did_you_mean", None, "Asthma")
    assert all(got[x][0] == "not_found" for x in ("the", "zz", "", "nonsense word"))


def test_context_keeps_the_last(spark):
    m = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "x" * 9000)], "conv_id long, turn long, role string, text string")
    assert [r.turn for r in conversation.context_suffix(m, 1024).collect()] == [1]


def test_entitlements(spark):
    e = spark.createDataFrame([(1, "m", "2024-01-01"), (1, "m", "2023-01-01"), (2, "m", None), (2, "m", "2030-01-01")], "user_id long, model_id string, expires_at string")
    got = {r.user_id: (r.lifetime, r.expires_at) for r in analytics.entitlement_upsert(e).collect()}
    assert got == {1: (False, "2024-01-01"), 2: (True, None)}


def test_thermal_batch_equals_stream_step(spark):
    w = tokens.Watch(baseline=4, window=3, sustained=3)
    gaps = [5, 5] + [10] * 4 + [10] * 3 + [40] * 9 + [9000] + [10] * 6 + [40] * 8
    at, rows = 0, [(1, 0, 0)]
    for i, g in enumerate(gaps, 1):
        at += g
        rows.append((1, at, i))
    state, said = (None, 0, 0, [], 0, False), []
    for _, t, i in rows:
        state, s = thermal.step(state, t, w)
        said += [(t, i, s[0])] if s else []
    batch = tokens.notices(spark.createDataFrame(rows, "stream_id long, at_ms long, token_id long"), w)
    assert [(r.at_ms, r.token_id, r.throttled) for r in batch.orderBy("at_ms", "token_id").collect()] == said
    assert [x[2] for x in said] == [True, False, True]


def test_thermal_stream(spark, tmp_path):
    w = tokens.Watch(baseline=2, window=2, sustained=2)
    rows, at = [], 0
    for i, g in enumerate([0, 5, 5, 10, 10, 10, 10, 90, 90, 90, 90]):
        at += g
        rows.append((3, at, i))
    spark.createDataFrame(rows, "stream_id long, at_ms long, token_id long").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("stream_id long, at_ms long, token_id long").parquet(str(tmp_path / "in"))
    q = thermal.notices(s, w).writeStream.format("memory").queryName("thermal").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert [r.throttled for r in spark.table("thermal").collect()] == [True]


def test_clusters(spark):
    m = spark.createDataFrame([(i, f"k{i}") for i in range(9)] + [(i + 1, f"k{i}") for i in range(5)] + [(20, "z"), (None, "k0")], "e long, k string")
    got = {r.entry: r.cluster for r in analytics.clusters(m, "e", "k").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 6, 7: 7, 8: 8, 20: 20}


def test_percentiles_spread(spark):
    """One group with all-distinct values, one null group, nulls and a group without values: as percentile_disc, and no such buffer in the plan."""
    rows = [("a", float(i * 7919 % 5003)) for i in range(5003)] + [("b", 1.0), ("b", 2.0), ("b", None), (None, 3.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(3)
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY x)")
    want = df.groupBy("k").agg(rank(0.5).alias("p50"), rank(0.95).alias("p95"), F.max("x").alias("largest"), F.count("x").alias("n"))
    got = analytics.percentiles(df, "k", "x")
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert "percentile" not in got._jdf.queryExecution().optimizedPlan().toString().replace("percentiles-", "").lower()
