"""Packs as tables with a pack column: point reads, titles, upserts, manifests and their checks, builds, and the chunks of a page.

docs: pack_id, doc_id, title, ...; chunks: doc_id, chunk_id, section_path, locator, text. Point reads take a batch of keys."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import stem as S
from lorekeep.functions import text as T
from lorekeep.storage import written

OLDEST, NEWEST, VECTOR_FORMAT = 1, 2, "v1"
#: Keys that every manifest has, with their type (fixed values).
MANIFEST = {
    "pack_id": "text",
    "pack_version": "text",
    "pack_tier": "tier",
    "embedder_name": "text",
    "embedder_sha256": "text",
    "embedding_dims": "count",
    "embedding_quant": "text",
    "chunk_target_tokens": "count",
    "chunk_overlap_pct": "count",
    "gate_abs_floor": "threshold",
    "gate_rel_margin": "threshold",
    "gate_calibrated": "flag",
    "prefixes_present": "flag",
    "built_by": "text",
    "schema_version": "number",
    "vec_format_version": "text",
}


def points(asked: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The row of each key asked for, nulls where there is none. Repeated keys are answered once."""
    return asked.select(key).distinct().join(rows, key, "left")


def chunks_of(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks of each document asked for, numbered in the order of their ids."""
    few = chunks.join(asked.select("doc_id").distinct(), "doc_id", "left_semi")
    return few.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_id")))


def decode_titles(titles: DataFrame) -> DataFrame:
    """Titles with their variants read from a JSON array of strings; `malformed` marks rows whose JSON is anything else."""
    got = F.from_json("variants", "array<string>")
    bad = F.col("variants").isNotNull() & (got.isNull() | ~F.startswith(F.ltrim("variants"), F.lit("[")))
    return titles.withColumn("malformed", bad).withColumn("variants", F.when(bad, None).otherwise(got))


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row written for each key. `order` must settle ties; partial maxima meet after the map side, so a hot key needs no task."""
    rest = [c for c in log.columns if c not in keys]
    top = log.groupBy(*keys).agg(F.max(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *rest)).alias("_r"))
    return top.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def typed_manifests(entries: DataFrame) -> DataFrame:
    """One row per pack with the keys of a manifest as columns and `error`: the first missing or malformed key, in the order of the keys, else null."""
    wide = entries.groupBy("pack_id").pivot("key", list(MANIFEST)[1:]).agg(F.max("value")).withColumnRenamed("pack_id", "pack")
    wide = wide.withColumn("pack_id", F.col("pack").cast("string"))
    whole = lambda c: F.regexp_like(c, F.lit(r"^[0-9]+$")) & c.try_cast("long").between(0, 4294967295)
    number = lambda c: c.try_cast("double")
    good = {
        "text": lambda c: F.lit(True),
        "tier": lambda c: c.isin("curated", "personal"),
        "count": lambda c: F.coalesce(whole(c), F.lit(False)),
        "threshold": lambda c: F.coalesce((number(c) >= 0) & (number(c) < float("inf")) & ~F.isnan(number(c)), F.lit(False)),
        "flag": lambda c: c.isin("true", "false"),
        "number": lambda c: c.try_cast("long").isNotNull(),
    }
    rules = [F.when(F.col(k).isNull(), f"missing {k}").when(~good[t](F.col(k)), f"invalid {k}") for k, t in MANIFEST.items()]
    return wide.withColumn("error", F.coalesce(*rules))


def load_checks(manifests: DataFrame, embedders: list[str], need_embedder: bool = True) -> DataFrame:
    """pack, problem: what keeps a typed manifest from loading, the first in a fixed order, null if nothing. Columns beside the manifest's: dims, has_titles."""
    schema = F.col("schema_version").try_cast("long")
    rules = [F.when(F.col("error").isNotNull(), "manifest")]
    if need_embedder:
        rules.append(F.when(~F.lower("embedder_sha256").isin([e.lower() for e in embedders]), "embedder"))
    rules += [
        F.when(F.col("embedding_dims").try_cast("long") != F.col("dims"), "dims"),
        F.when(schema > NEWEST, "newer").when(schema < OLDEST, "older").when((schema >= 2) & ~F.col("has_titles"), "titles"),
        F.when(F.col("vec_format_version") != VECTOR_FORMAT, "vectors"),
    ]
    return manifests.select("pack", F.coalesce(*rules).alias("problem"))


def title_entries(pages: DataFrame) -> DataFrame:
    """doc_id, title, normalised_title, slug, variants: the slug given or made from the title; variants trimmed, without those equal by normalised form to an earlier one or the title."""
    own = T.normalise_title(F.col("title"))
    slug = F.coalesce(F.nullif(T.slugify(F.col("slug")), F.lit("")), T.slugify(F.col("title")))
    named = F.transform(F.coalesce("variants", F.array().cast("array<string>")), lambda v: F.struct(T.normalise_title(v).alias("n"), F.trim(v).alias("v")))
    p = pages.select("doc_id", "title", own.alias("normalised_title"), slug.alias("slug"), named.alias("_v"))
    p = p.withColumn("_n", F.transform("_v", lambda x: x["n"]))
    kept = F.filter("_v", lambda x, i: (x["n"] != "") & (x["n"] != F.col("normalised_title")) & (F.array_position("_n", x["n"]) == i + 1))
    return p.withColumn("variants", F.transform(kept, lambda x: x["v"])).drop("_v", "_n")


def build_problems(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, problem of what a pack must not hold: an empty title, a slug that is empty or taken in its pack, a page without a chunk."""
    t = pages.withColumn("_slug", F.coalesce(F.nullif(T.slugify(F.col("slug")), F.lit("")), T.slugify(F.col("title"))))
    own = [*["pack_id"] * ("pack_id" in pages.columns), "_slug"]
    taken = t.groupBy(*own).agg(F.count("*").alias("_same"))
    some = chunks.select("doc_id").distinct().withColumn("_some", F.lit(True))
    t = t.join(taken, own, "left").join(some, "doc_id", "left")
    empty = F.trim(F.coalesce("title", F.lit(""))) == ""
    problem = F.when(empty, "empty title").when(F.coalesce("_slug", F.lit("")) == "", "empty slug").when(F.col("_same") > 1, "repeated slug").when(F.col("_some").isNull(), "no chunk")
    return t.select("doc_id", problem.alias("problem")).where("problem is not null")


def chunk_shas(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """chunks with the title of their document and content_sha."""
    c = chunks.join(docs.select("doc_id", "title"), "doc_id")
    return c.withColumn("content_sha", T.content_sha(F.col("text"), F.col("section_path"), F.col("locator"), F.col("title")))


def pack_shas(hashed: DataFrame, pack: str, order: str = "chunk_id") -> DataFrame:
    """pack, chunks, content_sha256: one digest over the shas of a pack's chunks in order, a line each.

    The digest is sequential by definition: a pack's shas, 65 bytes a chunk, pass through one task, sorted and as a stream."""
    kind = hashed.schema[pack].dataType
    names = hashed.select(F.col(pack).cast("string").alias("pack"), F.col(order).alias("at"), "content_sha")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, sha = None, 0, None
        for batch in batches:
            done = []
            for name, line in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if sha is None or name != now:
                    if sha is not None:
                        done.append((now, n, sha.hexdigest()))
                    now, n, sha = name, 0, hashlib.sha256()
                sha.update(f"{line}\n".encode())
                n += 1
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(("pack", "chunks", "content_sha256"), r, strict=True)) for r in done], schema)
        if sha is not None:
            yield pa.RecordBatch.from_pylist([{"pack": now, "chunks": n, "content_sha256": sha.hexdigest()}], schema)

    schema = pa.schema([("pack", pa.string()), ("chunks", pa.int64()), ("content_sha256", pa.string())])
    out = names.repartition("pack").sortWithinPartitions("pack", "at").mapInArrow(digest, "pack string, chunks long, content_sha256 string")
    return out.select(F.col("pack").cast(kind).alias(pack), "chunks", "content_sha256")


def differences(built: DataFrame, rebuilt: DataFrame, key: str) -> DataFrame:
    """key, problem: rows that a rebuild lacks, adds or changes; equal builds give no row. Both: key, content_sha."""
    both = built.select(key, F.col("content_sha").alias("_a")).join(rebuilt.select(key, F.col("content_sha").alias("_b")), key, "full_outer")
    problem = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "added").when(F.col("_a") != F.col("_b"), "changed")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def fakes_present(names: DataFrame, chunks: DataFrame) -> DataFrame:
    """name, chunk_id where a name that must not occur does, as whole words. names: name.

    Words and chunk ids alone are exploded and joined with the names' first words; a text joins back once for each name that it may hold."""
    n = names.select("name").distinct().select("name", T.normalise_title(F.col("name")).alias("_n")).where("_n <> ''").withColumn("_w", F.split_part("_n", F.lit(" "), F.lit(1)))
    c = chunks.select("chunk_id", T.normalise_title(F.col("text")).alias("_t"))
    maybe = c.select("chunk_id", F.explode(F.array_distinct(F.split("_t", " "))).alias("_w")).join(n, "_w").select("chunk_id", "name", "_n").distinct()
    return maybe.join(c, "chunk_id").where(T.contains_words(F.col("_t"), F.col("_n"))).select("name", "chunk_id").distinct()


def scored_in_docs(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """query, doc_id, chunk_id, score: the chunks of the query's own document with a stem of any of its terms. asked: query, doc_id, terms.

    BM25 with the statistics of the documents asked for, each by itself. Texts meet the stems asked of their document and are shuffled once, by document; a word becomes a row only if its first letters are those of such a stem, and all
    that follows keeps that partitioning."""
    each = asked.select("query", "doc_id", F.explode(F.array_distinct(S.stem_each(F.col("terms")))).alias("term"))
    wanted = each.groupBy("doc_id", "query").agg(F.collect_set("term").alias("wanted"))
    stems = each.groupBy("doc_id").agg(F.collect_set("term").alias("stems")).withColumn("heads", F.array_distinct(F.transform("stems", S.head)))
    c = chunks.select("doc_id", "chunk_id", "text").join(stems, "doc_id").withColumn("ts", T.terms(F.col("text")))
    c = c.select("doc_id", "chunk_id", "stems", F.size("ts").alias("len"), F.filter("ts", lambda w: S.may_have(w, F.col("heads"))).alias("maybe"))
    c = c.select("doc_id", "chunk_id", "len", F.filter(S.stem_each(F.col("maybe")), lambda t: F.array_contains("stems", t)).alias("hits"))
    whole = Window.partitionBy("doc_id")
    c = c.withColumns({"n": F.count("*").over(whole), "avgdl": F.avg("len").over(whole)})
    p = c.select("doc_id", "chunk_id", "len", "n", "avgdl", F.explode("hits").alias("term")).groupBy("doc_id", "chunk_id", "len", "term").agg(F.count("*").alias("tf"), F.first("n").alias("n"), F.first("avgdl").alias("avgdl"))
    p = p.withColumn("df", F.count("*").over(Window.partitionBy("doc_id", "term")))
    idf = F.greatest(F.lit(1e-6), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    s = p.select("doc_id", "chunk_id", "term", (idf * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("len") / F.col("avgdl")))).alias("s"))
    held = s.groupBy("doc_id", "chunk_id").agg(F.collect_list(F.struct("term", "s")).alias("held"))
    hits = held.join(wanted, "doc_id").withColumn("held", F.filter("held", lambda x: F.array_contains("wanted", x["term"]))).where(F.size("held") > 0)
    return hits.select("query", "doc_id", "chunk_id", F.round(F.aggregate("held", F.lit(0.0), lambda x, y: x + y["s"]), 6).alias("score"))


def ranked_in_docs(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """query, doc_id, chunk_id, score, rank: what scored_in_docs() gives, best first, ties by id, without a limit."""
    return scored_in_docs(asked, chunks).withColumn("rank", F.row_number().over(Window.partitionBy("query", "doc_id").orderBy(F.desc("score"), "chunk_id")))


def page_chunks(asked: DataFrame, chunks: DataFrame, k: int = 3) -> DataFrame:
    """query, doc_id, place, chunk_id: the first k chunks of the page found, sections in order of appearance, in a section those that match the query first, by rank."""
    scores = scored_in_docs(asked, chunks)
    first = chunks.select("doc_id", "chunk_id", F.min("chunk_id").over(Window.partitionBy("doc_id", "section_path")).alias("_first"))
    own = first.join(asked.select("query", "doc_id"), "doc_id").join(scores, ["query", "doc_id", "chunk_id"], "left")
    order = Window.partitionBy("query", "doc_id").orderBy("_first", F.desc_nulls_last("score"), "chunk_id")
    return own.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query", "doc_id", "place", "chunk_id")


def shas_of(picked: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """chunk_shas() of the chunks picked (doc_id, chunk_id) alone: texts are shuffled once, by document, and only those picked are hashed."""
    ids = picked.groupBy("doc_id").agg(F.collect_set("chunk_id").alias("_ids"))
    return chunk_shas(chunks.join(ids, "doc_id").where(F.array_contains("_ids", F.col("chunk_id"))).drop("_ids"), docs)


def found_or_not(outcomes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Outcomes of a lookup; a page found without a chunk is not found after all."""
    some = chunks.select("doc_id").distinct().withColumn("_some", F.lit(True))
    empty = (F.col("outcome") == "found") & F.col("_some").isNull()
    o = outcomes.join(some, "doc_id", "left").withColumn("_empty", empty)
    return o.withColumns({"outcome": F.when(F.col("_empty"), "not_found").otherwise(F.col("outcome")), "doc_id": F.when(~F.col("_empty"), F.col("doc_id"))}).drop("_some", "_empty")


def citation_source(source_type: Column, path: Column, retrieved: Column, web_type: str, prefix: str) -> tuple[Column, Column]:
    """URL and date to show with a page: only for pages of the trusted web source, the URL only under its prefix; a private path never shows."""
    web = F.coalesce(source_type == web_type, F.lit(False))
    return F.when(web & F.startswith(path, F.lit(prefix)), path), F.when(web, retrieved)


def lookup_budget(system: Column, query: Column, reply_tokens: int = 320, n_ctx: int = 2048) -> tuple[Column, Column]:
    """Estimated tokens of prompt, query and reply, and whether they fit the window."""
    tokens = T.est_tokens(system) + T.est_tokens(query) + reply_tokens
    return tokens, tokens <= n_ctx


def lookup_records(outcomes: DataFrame, docs: DataFrame, picked: DataFrame) -> DataFrame:
    """query, record: each answer as JSON. outcomes: query, outcome, doc_id, titles; docs: doc_id, title, slug; picked: query, place, chunk_id, section_path, locator, content_sha, at most k a query."""
    chunk = F.struct("place", F.struct("chunk_id", "section_path", "locator", "content_sha").alias("c"))
    per = picked.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(chunk)), lambda x: x["c"]).alias("chunks"))
    rows = outcomes.join(docs.select("doc_id", "title", "slug"), "doc_id", "left").join(per, "query", "left")
    found = F.col("outcome") == "found"
    record = F.struct(
        "query",
        T.normalise_title(F.col("query")).alias("normalised_query"),
        "outcome",
        F.when(found, F.struct("doc_id", "title", "slug")).alias("doc"),
        F.when(found, F.col("chunks")).alias("chunks"),
        F.when(F.col("outcome") == "did_you_mean", F.split("titles", r"\|")).alias("candidates"),
    )
    return rows.select("query", F.to_json(record).alias("record"))
