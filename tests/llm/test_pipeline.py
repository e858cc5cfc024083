"""The pipeline's stages against plain rules on the smallest tables."""

import corpus_pipeline
from lorekeep.llm import bpe, quality_rules, secrets
from lorekeep.llm.common import cut, table

from .test_operators import DATA, groups, least_edits, words


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    seen = [cut(docs, "test")]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(cut(stage(spark, seen[-1], DATA), "test"))
    start, good, single, clean, safe, ids = seen
    assert all(x.columns == docs.columns for x in seen[:-1])
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}

    kept = {r.doc_id for r in quality_rules.apply_rules(docs).where("kept").collect()}
    assert set(rows(good)) == kept
    want = {i for i, (_, c) in groups(list(rows(good).items()), 5).items() if i == c}
    assert set(rows(single)) == want and len(want) < len(kept)

    fold = lambda t: [w.lower() for w in words(t)]
    items = [fold(r.text) for r in table(spark, DATA, "benchmark").collect()]
    left, before = rows(clean), rows(single)
    for i, t in before.items():
        text = fold(t)
        exact = any(" " + " ".join(x) + " " in " " + " ".join(text) + " " for x in items if x)
        assert not (exact and i in left)
        if i not in left:
            assert any(least_edits(x, text) <= len(x) * 20 // 100 for x in items if x)

    assert set(rows(safe)) == set(left)
    for r in safe.collect():
        assert r.n_chars == len(r.text) or r.text == left[r.doc_id]
        assert not any(s for s in secrets.scan([r.text])[0] if secrets.RULES[s[1]].base)
    tok = bpe.tokenizer(bpe.default_path())
    texts = rows(safe)
    assert {r.doc_id: r.n_tokens for r in ids.collect()} == {i: len(b) // 4 for i, (b, _) in zip(texts, tok.encode_batch(list(texts.values())), strict=True)}


def test_null_ids(spark):
    """A clean document without an id goes through all stages; one that the rules reject goes."""
    docs = table(spark, DATA, "documents")
    clean = quality_rules.apply_rules(docs, keep_row=True).where("kept").orderBy("doc_id").limit(1).select("_row.*").first()
    rows = [tuple(clean), (None, *clean[1:]), (None, "short", *clean[2:])]
    kept = cut(spark.createDataFrame(rows, docs.schema), "test")
    for _, stage in corpus_pipeline.STAGES:
        kept = cut(stage(spark, kept, DATA), "test")
    assert sorted((r.doc_id for r in kept.collect()), key=lambda i: i is None) == [clean.doc_id, None]


def test_extra_columns_and_empty_table(spark):
    """Columns named like those the operators make pass through all stages that return documents; an empty table gives none."""
    from pyspark.sql import functions as F

    docs = table(spark, DATA, "documents").orderBy("doc_id").limit(30)
    extra = {c: F.lit(7) for c in ("id", "n", "kept", "grp", "x", "digest", "component_id", "contaminated", "spans", "bucket")}
    kept = cut(docs.withColumns(extra), "test")
    columns = kept.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = cut(stage(spark, kept, DATA), "test")
        assert kept.columns == columns and kept.where("grp <> 7").count() == 0
    plain = cut(docs, "test")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain = cut(stage(spark, plain, DATA), "test")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in plain.collect())
    none = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        none = cut(stage(spark, none, DATA), "test")
    assert none.count() == 0
