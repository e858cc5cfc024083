"""Packs on disk: publishing, failing, upserts, mounting and pruning."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import packs as P
from lorekeep.sources.packstore import BuildError, PackReader, PackStore, hive
from lorekeep.storage import folder, new_path

VALUES = {"pack_version": "1", "pack_tier": "personal", "embedder_name": "e", "embedder_sha256": "AbCd", "embedding_dims": "8", "embedding_quant": "int8", "chunk_target_tokens": "400", "chunk_overlap_pct": "18", "gate_abs_floor": "0.3",
          "gate_rel_margin": "0.1", "gate_calibrated": "true", "prefixes_present": "false", "built_by": "t", "schema_version": "2", "vec_format_version": "v1"}


def manifests(spark, packs, **other):
    return spark.createDataFrame([(p, k, v) for p in packs for k, v in (VALUES | other).items()], "pack_id string, key string, value string")


def rows(spark, packs, n=4, word="text"):
    docs = [(p, 100 * i + j, f"Title {j}", None) for i, p in enumerate(packs) for j in range(n)]
    chunks = [(d, d * 10 + c, "A > B", f"L{c}", f"{word} {d} {c}") for _, d, _, _ in docs for c in range(3)]
    return spark.createDataFrame(docs, "pack_id string, doc_id long, title string, slug string"), spark.createDataFrame(chunks, "doc_id long, chunk_id long, section_path string, locator string, text string").repartition(3)


def sha(text, section, locator, title):
    return hashlib.sha256(("[" + ",".join(json.dumps(x) for x in (text, section, locator, title)) + "]").encode()).hexdigest()


def fresh(spark):
    s = PackStore(spark, new_path(spark, "packs-test"))
    d, c = rows(spark, ["a", "b/c d"])
    s.build(d, c, manifests(spark, ["a", "b/c d"]))
    return s


@pytest.fixture(scope="module")
def store(spark):
    """For tests that change nothing, among them builds that fail."""
    return fresh(spark)


@pytest.fixture(scope="module")
def before(store):
    return state(store)


def state(store):
    return sorted(map(tuple, store.read("chunks").select("pack_id", "doc_id", "chunk_id", "text").collect())), sorted(map(tuple, store.catalog().select("pack_id", "docs", "chunks", "content_sha256").collect()))


def builds(store):
    fs, root = folder(f"{store.path}/builds")
    return len(fs.get_file_info(__import__("pyarrow").fs.FileSelector(root)))


def test_build_and_mount(spark, store):
    got, catalog = state(store)
    assert got == sorted((p, d, d * 10 + c, f"text {d} {c}") for i, p in enumerate(["a", "b/c d"]) for d in range(100 * i, 100 * i + 4) for c in range(3))
    lines = "".join(sha(f"text {d} {c}", "A > B", f"L{c}", f"Title {d}") + "\n" for d in range(4) for c in range(3))
    assert catalog[0] == ("a", 4, 12, hashlib.sha256(lines.encode()).hexdigest())
    assert {r.title for r in store.read("docs").where("pack_id = 'b/c d'").collect()} == {f"Title {j}" for j in range(4)}
    assert store.read("chunks").where("pack_id in ('a', 'x') and doc_id >= 2 and chunk_id < 31").count() == 4
    assert PackStore(spark, new_path(spark, "packs-test")).read("docs").isEmpty()


@pytest.mark.parametrize(
    ("change", "message"),
    [
        (lambda d, c, m: (d.withColumn("title", F.lit(" ")), c, m), "empty title"),
        (lambda d, c, m: (d.withColumn("slug", F.lit("same")), c, m), "repeated slug"),
        (lambda d, c, m: (d, c.where("doc_id <> 2"), m), "no chunk"),
        (lambda d, c, m: (d.withColumn("pack_id", F.lit(None).cast("string")), c, m), "no pack"),
        (lambda d, c, m: (d, c, m.where("pack_id <> 'a'")), "no manifest"),
        (lambda d, c, m: (d, c, m.where("key <> 'built_by'")), "manifest"),
        (lambda d, c, m: (d, c, m.withColumn("value", F.when(F.col("key") == "schema_version", "9").otherwise(F.col("value")))), "newer"),
    ],
)
def test_failing_builds_change_nothing(spark, store, before, change, message):
    with pytest.raises(BuildError, match=message):
        store.build(*change(*rows(spark, ["a"], word="other"), manifests(spark, ["a"])))
    assert state(store) == before and builds(store) == 1


def test_a_build_that_breaks_while_writing(spark, store, before):
    d, c = rows(spark, ["a"], word="other")
    with pytest.raises(Exception, match="broken"):
        store.build(d, c.withColumn("text", F.when(F.col("chunk_id") == 21, F.raise_error(F.lit("broken"))).otherwise(F.col("text"))), manifests(spark, ["a"]))
    assert state(store) == before and builds(store) == 1


def test_rows_that_differ_when_read_back(spark, store, before, monkeypatch):
    real, calls = P.chunk_shas, []

    def shas(chunks, docs):
        calls.append(1)
        return real(chunks.withColumn("text", F.concat("text", F.lit("?"))) if len(calls) == 2 else chunks, docs)

    monkeypatch.setattr(P, "chunk_shas", shas)
    with pytest.raises(BuildError, match="read back"):
        store.build(*rows(spark, ["a"]), manifests(spark, ["a"]))
    assert state(store) == before and builds(store) == 1


def test_upsert_and_vacuum(spark):
    store = fresh(spark)
    d = spark.createDataFrame([("a", 2, "New", None), ("a", 50, "More", None)], "pack_id string, doc_id long, title string, slug string")
    c = spark.createDataFrame([(2, 999, "", "L1", "new two"), (50, 500, "", "L1", "fifty")], "doc_id long, chunk_id long, section_path string, locator string, text string")
    store.upsert(d, c, manifests(spark, ["a"]))
    got, catalog = state(store)
    assert [r[:2] for r in catalog] == [("a", 5), ("b/c d", 4)] and [r for r in got if r[1] in (2, 50)] == [("a", 2, 999, "new two"), ("a", 50, 500, "fifty")] and len(got) == 23
    assert store.vacuum() == 0  # the first build still holds the other pack
    store.build(*rows(spark, ["a", "b/c d"]), manifests(spark, ["a", "b/c d"]))
    assert store.vacuum() == 2 and len(state(store)[0]) == 24


def test_refused_packs(spark):
    store = fresh(spark)
    store.build(*rows(spark, ["b/c d"]), manifests(spark, ["b/c d"], embedder_sha256="ffff"))
    assert store.read("docs", embedders=["ABCD"]).where("pack_id = 'a'").count() == 4
    assert store.read("docs", embedders=["abcd"], skip=True).count() == 4
    with pytest.raises(Exception, match="does not load"):
        store.read("docs", embedders=["abcd"]).count()


def test_pruning(store):
    """Only files of the packs asked for are planned, and only row groups that can hold the ids are read."""
    assert store.read("chunks").where("pack_id = 'a'").rdd.getNumPartitions() < store.read("chunks").rdd.getNumPartitions()
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    r = PackReader({"path": store.path})
    ranged = GreaterThan(("doc_id",), 103)
    assert list(r.pushFilters([In(("pack_id",), ("a", "b/c d")), EqualTo(("pack_id",), "b/c d"), ranged])) == [ranged]
    files = r.partitions()
    assert {f.pack_id for f in files} == {"b/c d"} and [b for f in files for b in r.read(f)] == []
    assert hive("b/c d") == "b%2Fc d"
