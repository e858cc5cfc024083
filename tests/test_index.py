"""The stored text index, the stemmer, clusters of chains and paragraphs, against brute force."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import stem
from lorekeep.operators import analytics as A
from lorekeep.operators import textindex
from lorekeep.operators.textindex import TextIndex
from lorekeep.sources import text as TX

#: Word pairs published with the algorithm (fixed values).
PAIRS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size
hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit
conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope
callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv
allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt
homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll
generalizations gener oscillators oscil yes ye yellow yellow by by is is""".split()


def test_stems(spark):
    d = spark.createDataFrame([(w,) for w in [*PAIRS[::2], "été", "x" * 70, "abc123"]], "term string")
    got = {r.term: r.stem for r in stem.stems(d).collect()}
    assert got == dict(zip(PAIRS[::2], PAIRS[1::2], strict=True)) | {"été": "été", "x" * 70: "x" * 70, "abc123": "abc123"}


def corpus():
    """Texts with words as frequent as in a language, a common word in all, and packs of very different size."""
    rng = random.Random(4)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}q" for i in range(300)]
    odds = [1 / (i + 1) for i in range(300)]
    rows = [("ab"[i % 7 == 0], i, "common " * rng.choice([1, 9]) + " ".join(rng.choices(vocab, odds, k=rng.choice([3, 30, 90])))) for i in range(1500)]
    return [*rows, ("a", 5000, None), ("a", 5001, ""), ("c", 5002, "lonely common")], vocab


@pytest.fixture(scope="module")
def built(spark):
    rows, _ = corpus()
    return TextIndex.build(spark.createDataFrame(rows, "pack_id string, chunk_id long, text string").repartition(5))


def brute(rows, queries, k, every):
    packs = collections.defaultdict(dict)
    for p, c, t in rows:
        if t is not None:
            packs[p][c] = collections.Counter(t.split())
    out = []
    for p, chunks in packs.items():
        avg = sum(sum(x.values()) for x in chunks.values()) / len(chunks)
        df = collections.Counter(w for x in chunks.values() for w in x)
        for q, terms in queries:
            hits = []
            for c, x in chunks.items():
                found = [w for w in set(terms) if x[w]]
                if found and (not every or len(found) == len(set(terms))):
                    hits.append((-round(sum(max(1e-6, math.log((len(chunks) - df[w] + 0.5) / (df[w] + 0.5))) * x[w] * 2.2 / (x[w] + 1.2 * (0.25 + 0.75 * sum(x.values()) / avg)) for w in found), 6), c))
            out += [(q, p, c, -s, r + 1) for r, (s, c) in enumerate(sorted(hits)[:k])]
    return sorted(out)


@pytest.mark.parametrize("every", [True, False])
@pytest.mark.parametrize("k", [1, 20, 50])
def test_search(spark, built, every, k):
    rows, vocab = corpus()
    rng = random.Random(k)
    queries = [(i, ["common"] * (i % 2) + rng.choices(vocab[:40] if i % 3 else vocab, k=rng.choice([1, 2, 5]))) for i in range(12)] + [(90, ["nothing"]), (91, ["lonely"]), (92, [])]
    got = [tuple(r) for r in built.search(spark.createDataFrame(queries, "query_id long, terms array<string>"), k, every).collect()]
    want = brute(rows, queries, k, every)
    assert [(q, p, c, r) for q, p, c, _, r in sorted(got)] == [(q, p, c, r) for q, p, c, _, r in want]
    assert [s for *_, s, _ in sorted(got)] == pytest.approx([s for *_, s, _ in want], abs=2e-6)


def test_search_scores_few(spark, built):
    """With a common and a rare word, the chunks that get a score are far fewer than those that match."""
    rows, vocab = corpus()
    queries = [(i, ["common", vocab[200 + i]]) for i in range(5)]
    asked, lists = built._wanted(spark.createDataFrame(queries, "query_id long, terms array<string>"))
    matches = sum(any(w in (t or "").split() for w in terms) for _, terms in queries for _, _, t in rows)
    assert built.candidates(lists, 5, False, asked).count() < matches / 10


@pytest.mark.parametrize("few", [True, False])
def test_search_any_both_ways(spark, built, few, monkeypatch):
    """Blocks of postings and products over all chunks give the same; products in several blocks of chunks and of queries and in small steps."""
    rows, vocab = corpus()
    for name, value in {"DENSE": 1e9 if few else 0.0, "CHUNKS": 400, "QUERIES": 5, "STEP": 50}.items():
        monkeypatch.setattr(textindex, name, value)
    rng = random.Random(9)
    queries = [(i, ["common"] + rng.choices(vocab[:60], k=6)) for i in range(12)] + [(90, ["nothing"]), (91, ["lonely"])]
    found = built.search(spark.createDataFrame(queries, "query_id long, terms array<string>"), 7, False)
    assert ("FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()) != few
    assert [(q, p, c, r) for q, p, c, _, r in sorted(map(tuple, found.collect()))] == [(q, p, c, r) for q, p, c, _, r in brute(rows, queries, 7, False)]


def test_blocks_and_reopening(spark, built):
    assert built.blocks.where(F.size("chunk_ids") > 128).isEmpty() and built.blocks.where("stem = 'common'").count() > 10
    again = TextIndex(spark, built.path)
    q = spark.createDataFrame([(1, ["lonely"])], "query_id long, terms array<string>")
    assert [r.chunk_id for r in again.search(q, 3).collect()] == [5002]
    other = TextIndex.build(spark.createDataFrame([], "pack_id string, chunk_id long, text string"))
    assert other.search(q, 3).isEmpty() and other.search(q, 3, all_terms=False).isEmpty()
    other.drop()


@pytest.mark.parametrize("every", [True, False])
def test_rows_of_one_chunk_id(spark, every):
    """Rows of one chunk and length are one chunk; a row of another length is one more, and its weights count for the chunk, too."""
    rows = [("a", 1, "x x y"), ("a", 1, "x z z"), ("a", 2, "x"), ("a", 3, "y z w v"), ("a", 4, "w"), ("a", 5, "v v"), ("a", 6, "u t"), ("a", 7, "u")]
    asked = spark.createDataFrame([(1, ["x", "y"]), (2, ["z"])], "query_id long, terms array<string>")
    idf = lambda df: max(1e-6, math.log((8 - df + 0.5) / (df + 0.5)))
    g = lambda tf, n: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / (17 / 8)))
    same = TextIndex.build(spark.createDataFrame(rows, "pack_id string, chunk_id long, text string").repartition(3))
    got = {(r.query_id, r.chunk_id): r.score for r in same.search(asked, 5, every).collect()}
    want = {(1, 1): idf(2) * g(3, 3) + idf(2) * g(1, 3), (1, 2): idf(2) * g(1, 1), (1, 3): idf(2) * g(1, 4), (2, 1): idf(2) * g(2, 3), (2, 3): idf(2) * g(1, 4)}
    assert got == pytest.approx({k: v for k, v in want.items() if not every or k not in ((1, 2), (1, 3))}, abs=2e-6)
    other = TextIndex.build(spark.createDataFrame([*rows, ("a", 2, "x y q q")], "pack_id string, chunk_id long, text string").repartition(3))
    n, avg = 9, 21 / 9
    score = {r.chunk_id: r.score for r in other.search(spark.createDataFrame([(1, ["q"])], "query_id long, terms array<string>"), 5, every).collect()}
    assert score == pytest.approx({2: math.log((n - 1 + 0.5) / 1.5) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 4 / avg))}, abs=2e-6)


def test_postings_are_dealt_once(spark):
    """A posting is shuffled to its block alone; how rare its stem is, its list says."""
    from tests.test_growth import moved, words

    n = len({stem.porter(w) for w in words(300, 2)})
    chunks = spark.createDataFrame([(p, i, " ".join(words(300, 2))) for p in "ab" for i in range(20)], "pack_id string, chunk_id long, text string").repartition(4)
    built = []
    assert 40 * n <= moved(spark, lambda: built.append(TextIndex.build(chunks))) < 1.3 * 40 * n
    assert built[0].lists.count() == 2 * n and built[0].lists.where("df <> 20 or idf <> 1e-6").isEmpty()


def test_clusters_of_a_chain(spark):
    n = 10_000
    order = list(range(n))
    random.Random(2).shuffle(order)
    links = [(order[i + j], f"k{i}") for i in range(n - 1) for j in (0, 1)] + [(n + 5, "own"), (None, "k0"), (n + 6, None)]
    got = {r.entry: r.cluster for r in A.clusters(spark.createDataFrame(links, "e long, k string").repartition(16), "e", "k").collect()}
    assert got == {i: 0 for i in range(n)} | {n + 5: n + 5}


def test_clusters_without_contraction(spark, monkeypatch):
    """Rounds alone settle a chain and stars too, also of names."""
    monkeypatch.setattr(A, "contracted", lambda batches: batches)
    links = [(f"n{i + j:03}", f"k{i}") for i in range(150) for j in (0, 1)] + [(f"s{i}", "hub") for i in range(50)]
    got = {r.entry: r.cluster for r in A.clusters(spark.createDataFrame(links, "e string, k string"), "e", "k").collect()}
    assert got == {f"n{i:03}": "n000" for i in range(151)} | {f"s{i}": "s0" for i in range(50)}


def phrases():
    """Many entries of few names and titles, some entries with two names, some of no name, and names whose words are common but not side by side."""
    rng = random.Random(6)
    words = ["old", "red", "hot", "ring", "bolt", "5", "6"]
    names = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 3])))) for i in range(60)] + [(3, "red ring"), (4, ""), (70, "ring red"), (71, "gone")]
    return names, [(i, " ".join(rng.choices(words[:5] if i % 2 else words, k=rng.choice([2, 4])))) for i in range(65)] + [(5, "red ring red"), (6, "")]


def test_phrase_pairs_and_links(spark):
    names, titles = phrases()
    want = {(e, o) for o, n in names for e, t in titles if n and e != o and f" {n} " in f" {t} "}
    frames = spark.createDataFrame(names, "entry long, name string"), spark.createDataFrame(titles, "entry long, title string")
    got = [tuple(r) for r in A.phrase_pairs(*frames).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    every = spark.range(80).select(F.col("id").alias("entry"))
    none = spark.createDataFrame([], "entry long, key string")
    split = lambda pairs: {r.entry: r.cluster for r in A.cluster_splits(none, every, pairs, "s", every.limit(0)).collect()}
    assert split(A.phrase_links(*frames)) == split(spark.createDataFrame(list(want), "entry long, other long"))


def test_phrase_links_grow_with_entries(spark):
    """A name that a thousand entries bear and a thousand titles hold gives some thousand links, not a million."""
    e = spark.range(1000)
    assert A.phrase_links(e.selectExpr("id as entry", "'ring' as name"), e.selectExpr("id as entry", "'large ring' as title")).count() < 2100


def test_phrase_pairs_shuffle_arrays(spark, monkeypatch):
    """A name that two thousand entries bear is not dealt entry by entry to each piece of the titles that hold it; runs of any length give the same pairs."""
    from tests.test_growth import moved

    e = spark.range(2000)
    names, titles = e.selectExpr("id as entry", "'ring' as name"), e.selectExpr("id as entry", "'large ring' as title")
    assert moved(spark, lambda: A.phrase_pairs(names, titles).write.format("noop").mode("overwrite").save()) < 20_000
    monkeypatch.setattr(A, "RUN", 7)
    few = A.phrase_pairs(names.where("entry < 200"), titles.where("entry < 300"))
    assert few.count() == few.distinct().count() == 200 * 300 - 200


def test_fake_names_are_an_error(spark):
    e = spark.createDataFrame([(1, "a"), (2, "a")], "entry long, key string")
    empty = spark.createDataFrame([], "entry long, other long")
    fakes = spark.createDataFrame([("madeupitis", 2)], "name string, chunk_id long")
    with pytest.raises(ValueError, match="madeupitis"):
        A.cluster_splits(e, e.select("entry"), empty, "s", e.select("entry").limit(0), fakes)
    assert {r.cluster for r in A.cluster_splits(e, e.select("entry"), empty, "s", e.select("entry").limit(0), fakes.limit(0)).collect()} == {1}


def test_paragraphs_stay_in_their_rows(spark):
    texts = ["a\nb\n\n \nc", "", None, "\n\n", "one", "\n x\n\ty\n", "p\r\n\r\nq"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df = TX.paragraphs(d)
    want = [(0, 1, 2, "a\nb"), (0, 5, 5, "c"), (4, 1, 1, "one"), (5, 2, 3, " x\n\ty"), (6, 1, 1, "p\r"), (6, 3, 3, "q")]
    assert sorted(map(tuple, df.collect())) == want
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
