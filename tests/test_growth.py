"""What a query shuffles grows with what it has to move, not with every word of its texts."""

import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from lorekeep.functions import language, stem
from lorekeep.functions import text as T
from lorekeep.operators import chunking, lookup, packs, replies, selection
from lorekeep.operators.textindex import TextIndex
from lorekeep.plans import packs as pack_plans
from lorekeep.plans import sources as documents
from lorekeep.sources import markdown


def moved(spark, job) -> int:
    """Records that a job's shuffles write."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: [x for s in [store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)] for x in map(s.apply, range(s.size()))]
    last = max([x.stageId() for x in stages()], default=-1)
    job()
    return sum(x.shuffleWriteRecords() for x in stages() if x.stageId() > last)


def words(n, seed=1):
    r = random.Random(seed)
    ends = ["", "s", "ies", "sses", "ed", "eed", "ing", "ying", "ational", "ization", "biliti", "logi", "ness", "ement", "sion", "ll", "e", "y", "ousli", "icate"]
    return ["".join(r.choice("aeioubdlstyz") for _ in range(r.randint(1, 5))) + r.choice(ends) for _ in range(n)]


def test_stems_in_a_row_are_those_of_the_steps(spark):
    every = sorted(set(words(4000)) | {"y", "yes", "ays", "ayed", "ies", "ied", "hoping", "hopping", "äußerungen", "x" * 65})
    want = {r.term: r.stem for r in stem.stems(spark.createDataFrame([(w,) for w in every], "term string")).collect()}
    assert {w: stem.porter(w) for w in every} == want
    fold = lambda w: w[:2].replace("y", "i")
    assert all(fold(w) == fold(s) or (len(s) == 1 and fold(w)[0] == fold(s)) for w, s in want.items())
    lists = [every[:7], [], None, every[7:] * 2]
    rows = spark.createDataFrame(list(enumerate(lists)), "i int, ws array<string>").coalesce(1).select("i", stem.stem_each(F.col("ws")).alias("s"), stem.stem_counts(F.col("ws")).alias("n")).collect()
    for r in rows:
        own = [want[w] for w in lists[r.i] or []]
        assert r.s == own and {x.stem: x.tf for x in r.n} == {s: own.count(s) for s in own}


def test_words_that_nobody_asks_for_are_not_shuffled(spark):
    text = " ".join(w for w in words(3000) if w[0] != "q") + " quakes"
    chunks = spark.createDataFrame([(d, d * 10 + i, text) for d in range(4) for i in range(3)], "doc_id long, chunk_id long, text string")
    asked = spark.createDataFrame([(f"q{d}", d, ["quake"]) for d in range(4)], "query string, doc_id long, terms array<string>")
    rows = []
    assert moved(spark, lambda: rows.extend(packs.ranked_in_docs(asked, chunks).collect())) < 200
    assert sorted((r.doc_id, r.chunk_id, r["rank"]) for r in rows) == [(d, d * 10 + i, i + 1) for d in range(4) for i in range(3)]


def test_an_index_shuffles_postings_not_words(spark):
    chunks = spark.createDataFrame([("p", i, " ".join(words(50, 2) * 40)) for i in range(8)], "pack_id string, chunk_id long, text string").repartition(4)
    built = []
    n = moved(spark, lambda: built.append(TextIndex.build(chunks)))
    postings = 8 * len({stem.porter(w) for w in words(50, 2)})
    assert built[0].lists.agg(F.sum("df")).first()[0] == postings and n < 6 * postings
    built[0].drop()


def test_chunks_given_twice_count_once(spark):
    two = spark.createDataFrame([("p", 1, "cats purr"), ("p", 1, "cats bark"), ("p", 2, "dogs bark")], "pack_id string, chunk_id long, text string")
    index = TextIndex.build(two)
    assert {r.stem: r.df for r in index.lists.collect()} == {"cat": 1, "purr": 1, "bark": 2, "dog": 1}
    index.drop()


def test_files_are_packed_a_part_of_a_batch_at_a_time(spark, tmp_path):
    spark.range(0, 60, 1, 1).selectExpr("id AS doc_id", "repeat('x', 1000000) AS text").write.parquet(f"{tmp_path}/documents.parquet")

    files = documents._files(spark, str(tmp_path), ".epub", documents.as_epub)
    assert files.count() == 60 and [len(r.content) for r in files.where("path = '3.epub'").collect()] == [40]
    # a function of a column would make the files of a whole batch before it hands on the first
    plan = files._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan


def test_tiers_of_an_entry_are_not_rows(spark):
    tiers = [{"tier": f"t{i:02}", "sha": f" S{i % 40} ", "kind": "text", "base": "b" if i < 45 else "c"} for i in range(50)] + [{"tier": None, "sha": "s7", "kind": "text", "base": "b"}]
    kind = "entry long, tiers array<struct<tier:string,sha:string,kind:string,base:string>>"
    entries = spark.createDataFrame([(e, tiers) for e in range(100)] + [(0, [{"tier": "a", "sha": "s1", "kind": "text", "base": "b"}]), (100, None)], kind)
    wanted = spark.createDataFrame([(e, "S1", "text", "b") for e in range(101)] + [(1, "s41", "text", "b"), (2, "s1", "text", "x"), (3, "s6", "text", "c"), (4, None, "text", "b"), (1, "S1", "text", "b")], "entry long, sha string, kind string, base string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = []
    try:
        assert moved(spark, lambda: rows.extend(selection.catalogue_variants(entries, wanted).collect())) < 500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = {(r.entry, r.sha): (r.tier, r.problem) for r in rows if r.entry in (0, 1, 2, 3, 4, 100)}
    assert len(rows) == 105 and got[0, "S1"] == ("a", None) and got[1, "S1"] == ("t01", None) and got[1, "s41"] == (None, "unpinned")
    assert [r.problem for r in rows if r.entry == 2 and r.sha == "s1"] == ["conflict"] and got[3, "s6"] == ("t46", None) and got[4, None] == (None, "unpinned") and got[100, "S1"] == (None, "unpinned")


def test_close_spellings_meet_keys_of_near_lengths_alone(spark):
    keys = spark.createDataFrame([(i, f"page {i:015d}", 0, f"page {i:015d}") for i in range(500)] + [(500, "swapped letters here", 0, "swapped letters here"), (501, "ant", 0, "ant"), (502, "abbey", 0, "abbey")], "doc_id long, title string, tier int, key string")
    asked = spark.createDataFrame([("a", "zq" + "7" * 40), ("b", "swapepd letters heer"), ("c", "act"), ("d", "abbye"), ("e", "zebra")], "query string, q string")
    rows = []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # one query is far longer than any key, the other far shorter than nearly all: their 500 pages must not be taken apart
        assert moved(spark, lambda: lookup.close(asked.where("query in ('a', 'c')"), keys).collect()) < 2000
        rows = lookup.close(asked, keys).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r["query"]: r.titles for r in rows} == {"b": "swapped letters here", "c": "ant", "d": "abbey"}


def test_long_texts_are_taken_apart_once(spark):
    """Work for a text grows with its length: taken apart for each window again, these would take minutes."""
    n = 12_000
    d = spark.createDataFrame([("One two three. " * n,)], "t string")
    start = time.monotonic()
    par = d.select(F.explode(chunking.paragraph_chunks(F.col("t"), 30, 0, 40)).alias("c")).agg(F.count("*"), F.sum("c.tokens"), F.count_if("c.oversize")).first()
    code = d.select(F.explode(chunking.code_chunks(F.col("t"), 10)).alias("c")).agg(F.count("*"), F.sum("c.tokens"), F.max("c.tokens")).first()
    rows = F.transform(F.split("t", r"\. ?"), lambda x: F.array(x))
    table = d.select(F.explode(chunking.table_chunks(F.array(F.lit("h")), rows, 9, 40)).alias("c")).agg(F.count("*"), F.max("c.tokens")).first()
    assert time.monotonic() - start < 40
    assert tuple(code) == (n * 3 // 10, n * 3, 10) and par[2] == 0 and par[1] >= n * 3 and table[0] >= n // 2 and table[1] <= 9


def test_texts_of_one_window_are_not_taken_apart(spark):
    """What fits goes past Python, and never as null lists: Spark's writer goes over a batch again for each of those. What the whole text's draft says is what its sentences would have."""
    rng = random.Random(3)
    bits = ["a", "bb", "Dr.", "e.g.", "U.S.", "x.", "y!", "z?", " ", " ", " ", "  ", "\n", "\t", "\u00a0", "\u2003", "\x85", "\ufdd0", "\ufdd1", "日本。"]
    texts = ["One two. Three", " a. b. ", "a.  b", "a.\nb", "a b c. d e f", None, "", " ", "\n", "\ufdd1"] + ["".join(rng.choices(bits, k=rng.randint(1, 12))) for _ in range(1500)]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    sentences = language.split_sentences(F.col("t"))
    rows = d.select("t", chunking.WORDS.taken(F.col("t"), 5).alias("p"), chunking.paragraph_chunks(F.col("t"), 5, 0, 40).alias("c"), sentences.alias("s"), chunking.WORDS.counts(sentences).alias("n")).orderBy("i").collect()
    assert [len(r.p.sentences) for r in rows[:10]] == [0, 0, 2, 2, 2, 0, 0, 0, 0, 0] and all(len(r.p.counts) == len(r.p.sentences) for r in rows)
    for r in rows:
        spans = chunking.window_spans(np.array(r.n, np.int64), 5, 0)
        assert [(x.text, x.tokens, x.oversize) for x in r.c] == [(" ".join(r.s[a:b]), sum(r.n[a:b]), sum(r.n[a:b]) > 5) for a, b in spans]


def test_a_line_of_spaces_is_read_once():
    """Each of these was tried from every space with every other as its end: minutes."""
    gap = " " * 20_000
    start = time.monotonic()
    got = [tuple(b)[:3] for b in markdown.blocks(f"# a{gap}b\n## c{gap}##{gap}\nx | y\n-{gap}z\n")]
    assert time.monotonic() - start < 5
    assert got == [(f"a{gap}b > c", "paragraph", "x | y"), (f"a{gap}b > c", "list", "- z")]
    old = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#*)?[ \t]*$")
    rng = random.Random(1)
    for _ in range(20_000):
        line = "".join(rng.choices("### \t ax", k=rng.randint(0, 10)))
        m = old.match(line)
        assert markdown.heading(line) == (m and (len(m[1]), m[2] or ""))


def test_pages_of_a_build_are_judged_once(spark):
    good, _ = pack_plans._good(spark, "/root/testdata/sf0.001")
    assert good.count() > 0 and "Generate" not in good._jdf.queryExecution().optimizedPlan().toString()


def test_a_guard_reads_its_reply_once(spark):
    d = spark.createDataFrame([("See your GP today. The helpline is open. Rest. A helpline can listen.", "hi")], "t string, p string").select(replies.apply_guard(F.col("t"), F.col("p")).alias("v"))
    # the pattern of one direction stands in its test and in what it takes out, and nowhere else
    assert d._jdf.queryExecution().optimizedPlan().toString().count("keep the area clean") <= 2
    v = d.first().v
    assert (v.route, v.text, v.signposts) == ("CLINICIAN", "See your GP. The helpline is open. Rest.", 1)
