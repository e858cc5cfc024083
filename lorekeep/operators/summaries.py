"""Summaries, window rules and set checks over catalogues, chunks and conversations.

Where a rule reads like a window over one large group (first row of a date, best row of a section, sections in order of appearance), it is a
grouped minimum instead: partial results are combined before the shuffle, so a group of any size needs no task of its own."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lorekeep.operators.analytics import shared_dir


def section_counts(entries: DataFrame, section: str, size: str) -> DataFrame:
    """Entries, those with content, and the size of each section. A null size counts as 0."""
    return entries.groupBy(section).agg(F.count("*").alias("entries"), F.count_if(F.col(size) > 0).alias("pages"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))


def pack_counts(docs: DataFrame, chunks: DataFrame, pack: str, doc: str) -> DataFrame:
    """Documents and chunks of each pack. Chunks are counted by document before they meet the documents."""
    per_doc = chunks.groupBy(doc).agg(F.count("*").alias("n"))
    return docs.select(pack, doc).join(per_doc, doc, "left").groupBy(pack).agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))


def core_names(pages: DataFrame, core: str, scoped: Column) -> DataFrame:
    """Core names that stand: one page without a population, or two pages or more."""
    counted = pages.groupBy(core).agg(F.count("*").alias("n_pages"), F.bool_or(~F.coalesce(scoped, F.lit(False))).alias("unscoped"))
    return counted.where("unscoped or n_pages >= 2")


def split_counts(entries: DataFrame, split: str, cluster: str, held_out: Column) -> DataFrame:
    """Clusters, entries and held-out entries of each split."""
    return entries.groupBy(split).agg(F.count_distinct(cluster).alias("clusters"), F.count("*").alias("entries"), F.count_if(held_out).alias("held_out"))


def cluster_attributes(entries: DataFrame, cluster: str, name: str, score: str) -> DataFrame:
    """Sorted distinct names, highest score and the name that has it (ties: the smaller name)."""
    best = entries.groupBy(cluster, name).agg(F.max(score).alias("_s"))
    return best.groupBy(cluster).agg(F.array_sort(F.collect_list(name)).alias("names"), F.max("_s").alias("score"), F.min(F.struct(-F.col("_s"), F.col(name).alias("n")))["n"].alias("hint"))


def family_scores(pages: DataFrame, key: str, title: Column, lede: Column, lexicon: dict[str, list[str]], least: int = 2) -> DataFrame:
    """Families whose score reaches `least`: a pattern counts 2 in the title, else 1 in the lede. The lexicon becomes one projection: no join."""

    def score(patterns: list[str]) -> Column:
        return sum((F.when(title.rlike(p), 2).when(lede.rlike(p), 1).otherwise(0) for p in patterns), F.lit(0))

    scores = F.array(*[F.struct(F.lit(k).alias("family"), score(v).alias("score")) for k, v in lexicon.items()])
    return pages.select(key, F.explode(scores).alias("s")).select(key, "s.family", "s.score").where(F.col("score") >= least)


def guard_summary(replies: DataFrame, suite: str, refused: Column, changed: Column, hidden: Column) -> DataFrame:
    """Counts of replies; refused ones count in no other figure."""
    open_ = ~F.coalesce(refused, F.lit(False))
    return replies.groupBy(suite).agg(F.count("*").alias("total"), F.count_if(refused).alias("refused"), F.count_if(open_ & changed).alias("changed"), F.count_if(open_ & hidden).alias("hidden"))


def max_reading(readings: DataFrame, by: str, reading: str) -> DataFrame:
    """The largest reading that is a whole number, 0 without one."""
    return readings.groupBy(by).agg(F.coalesce(F.max(F.col(reading).try_cast("long")), F.lit(0)).alias("reading"))


def titles_in_order(rows: DataFrame, group: str, title: str, order: str) -> DataFrame:
    """Distinct non-empty titles of a group in the order of their first row."""
    first = rows.where(F.length(title) > 0).groupBy(group, title).agg(F.min(order).alias("_o"))
    return first.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", title))), lambda x: x[title]).alias("titles"))


def date_headings(messages: DataFrame, group: str, at: str, key: str) -> DataFrame:
    """One heading per group and date, at the date's first message (ties: the smaller key)."""
    date = F.to_date(at).cast("string").alias("heading")
    return messages.groupBy(group, date).agg(F.min(F.struct(at, key))[key].alias("at_message"), F.count("*").alias("messages"))


def best_of_sections(hits: DataFrame, query: str, section: list[str], order: list[Column], keep: list[str], n: int) -> DataFrame:
    """The first n of each query after only the best row of each section is left. `keep` must settle ties of `order`."""
    rank = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    best = hits.groupBy(query, *section).agg(F.min(F.struct(*rank, *keep)).alias("_b"))
    w = Window.partitionBy(query).orderBy(*[f"_b._o{i}" for i in range(len(order))], *[f"_b.{k}" for k in keep])
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(query, "rank", *[F.col(f"_b.{k}").alias(k) for k in keep])


def section_order(chunks: DataFrame, doc: str, section: str, key: str) -> DataFrame:
    """Sections of a document numbered by their first chunk."""
    first = chunks.groupBy(doc, section).agg(F.min(key).alias("first_chunk"))
    return first.withColumn("section_rank", F.row_number().over(Window.partitionBy(doc).orderBy("first_chunk", section)))


def clear_of_neighbours(rows: DataFrame, group: str, order: str, flagged: Column) -> DataFrame:
    """eligible: neither the row nor the one before or after it in its group is flagged. A null flag counts as false."""
    w = Window.partitionBy(group).orderBy(order)
    f = F.coalesce(flagged, F.lit(False))
    near = lambda c: F.coalesce(c.over(w), F.lit(False))
    return rows.withColumn("_f", f).withColumn("eligible", ~(F.col("_f") | near(F.lag("_f")) | near(F.lead("_f")))).drop("_f")


def lead_ins(lines: DataFrame, group: str, order: str, lead: Column, item: Column) -> DataFrame:
    """lead_in: for an item, the position of the lead-in line that only items separate it from, else null."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    stop = F.last(F.when(~item, F.struct(F.col(order).alias("o"), lead.alias("l"))), ignorenulls=True).over(w)
    return lines.withColumn("_stop", stop).withColumn("lead_in", F.when(item & F.col("_stop.l"), F.col("_stop.o"))).drop("_stop")


def running_condition(clauses: DataFrame, group: str, order: str, condition: Column) -> DataFrame:
    """under_condition: this clause or one before it in its group states a condition."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return clauses.withColumn("under_condition", F.bool_or(F.coalesce(condition, F.lit(False))).over(w))


def in_list_order(chats: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """position of each chat in its list; `order` must settle ties.

    Rows are dealt by range of (group, order) and written to the shared folder, so a list of any length is spread over tasks; a small table of how many rows of a list each range holds says
    where its positions start."""
    spark = chats.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    path = f"{shared_dir(chats)}/list-order-{uuid.uuid4().hex}"
    chats.repartitionByRange(parts, F.asc(group), *order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.schema(StructType([*chats.schema.fields, StructField("_part", IntegerType())])).parquet(path)
    totals = dealt.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.count("*").alias("_n"))
    starts = totals.select("_g", "_p", (F.sum("_n").over(Window.partitionBy("_g").orderBy("_p")) - F.col("_n")).alias("_before"))
    here = dealt.withColumn("_at", F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)))
    placed = here.join(starts, here[group].eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return placed.select(*chats.columns, (F.col("_at") + F.col("_before")).cast("int").alias("position"))


def cover_gaps(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, and which side that is; a null key is a key like others."""
    both = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    return both.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r")).where("l <> r").select(key, F.when(F.col("l") == 1, "left").otherwise("right").alias("only_in"))


def carry_forward(carried: DataFrame, new: DataFrame, path: str) -> DataFrame:
    """Carried and new entries together; `conflict` marks a path given more than once."""
    every = carried.select(path, F.lit(1).alias("c")).unionByName(new.select(path, F.lit(0).alias("c")))
    return every.groupBy(path).agg(F.sum("c").alias("carried"), F.count_if(F.col("c") == 0).alias("new"), (F.count("*") > 1).alias("conflict"))


def sweep(files: DataFrame, keep: DataFrame, path: str) -> DataFrame:
    """Files that the keep list does not name; a file without a path stays."""
    return files.where(F.col(path).isNotNull()).join(keep.select(path).where(F.col(path).isNotNull()).distinct(), path, "left_anti")


def variants(names: list[Column]) -> Column:
    """Non-empty names without repeats, in the given order."""
    return F.array_distinct(F.filter(F.array(*names), lambda x: F.length(x) > 0))
