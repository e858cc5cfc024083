"""Replies that must quote their sources, in order: each sentence is judged by itself, then the quotes that stay must run through the sources as their sentences do.

Sentences of replies and of sources are rows; a reply's sentences meet those of the sources they cite by an equality join on the normalised text. What is left is one reply's alignment, in the order of its sentences: a quote goes on
where the quotes before it may have ended. A sentence can stand at several places, so the places that are still possible are carried along."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from lorekeep.functions import doses as D
from lorekeep.operators import replies as R
from lorekeep.storage import written

#: Why a sentence is withheld, in the order in which the reasons are looked for; the last four depend on the sentences before.
REASONS = ["citation malformed", "citation out of range", "overdose section", "overdose sentence", "unreadable", "dose uncited", "dose not in source", "route uncited", "not a quote", "lead-in", "order", "context"]
OVERDOSE = r"\boverdos|\btoo (?:much|many)\b|\bmore than (?:the|your) (?:dose|prescribed)"
ROUTE = "|".join(p for k, p in R.DIRECTIONS.items() if k != "scope")
CITED = re.compile(r"\[([^\]\n]*)\]")
NUMBERS = re.compile(r"\s*\d+\s*(?:,\s*\d+\s*)*")
STOP = re.compile(r"(?<=[.!?])((?:\s*\[[^\]\n]*\])*)\s+|\n+")


def split(text: str | None) -> list[str]:
    """Sentences up to a stop before white space or an end of line; citations right after a stop belong to the sentence before it."""
    out, start = [], 0
    for m in STOP.finditer(text or ""):
        out.append((text or "")[start : m.start() + len(m[1] or "")].strip())
        start = m.end()
    return [s for s in [*out, (text or "")[start:].strip()] if s]


def read_reply(text: str | None) -> list[dict]:
    out = []
    for s in split(text):
        lists = CITED.findall(s)
        bad = any(re.search(r"\d", x) and not NUMBERS.fullmatch(x) for x in lists)
        cites = sorted({int(n) for x in lists if NUMBERS.fullmatch(x) for n in x.split(",")})
        normal = D.normalise(s)
        dose = D.bears_dose(normal)
        out.append({"text": s, "normalised": normal, "cites": cites, "malformed": bad, "overdose": bool(re.search(OVERDOSE, normal)), "unreadable": D.unreadable(normal), "dose": dose, "route": not dose and bool(re.search(ROUTE, normal))})
    return out


def read_source(text: str | None) -> list[dict]:
    """Sentences with the one that leads in, the last before that ends with a colon, for items of a list after it; those on overdoses can't be quoted."""
    out: list[dict] = []
    lead = None
    for i, s in enumerate(split(text)):
        item = re.match(r"[-*•]\s+|\d+[.)]\s+", s)
        lead = lead if item else None
        normal = D.normalise(s[item.end() :] if item else s)
        out.append({"normalised": normal, "eligible": bool(normal) and not re.search(OVERDOSE, normal), "lead_in": lead})
        if s.endswith(":"):
            lead = i
    return out


REPLY = ArrayType(StructType([StructField("text", StringType()), StructField("normalised", StringType()), StructField("cites", ArrayType(IntegerType())), *(StructField(n, BooleanType()) for n in ("malformed", "overdose", "unreadable", "dose", "route"))]))
SOURCE = ArrayType(StructType([StructField("normalised", StringType()), StructField("eligible", BooleanType()), StructField("lead_in", IntegerType())]))


def _reader(f, kind, arrow):
    @F.arrow_udf(kind)
    def each(a: pa.Array) -> pa.Array:
        return pa.array([f(t) for t in a.to_pylist()], arrow)

    return each


_flags = [(n, pa.bool_()) for n in ("malformed", "overdose", "unreadable", "dose", "route")]
reply_sentences = _reader(read_reply, REPLY, pa.list_(pa.struct([("text", pa.string()), ("normalised", pa.string()), ("cites", pa.list_(pa.int32())), *_flags])))
source_sentences = _reader(read_source, SOURCE, pa.list_(pa.struct([("normalised", pa.string()), ("eligible", pa.bool_()), ("lead_in", pa.int32())])))


def align(rows: list[dict], spots: list[dict]) -> list[str | None]:
    """Reasons of one reply's sentences in order, given what each says by itself, and the places where any of them can stand: source n, sentence i, page, size of the source in sentences, lead_in or -1.

    A place goes on from its own sentence, the one before it, or the last one of the chunk before on the page, so ends of quotes are looked up, not compared: time grows with the places, not with their pairs."""
    places: dict[tuple, list[dict]] = {}
    for p in spots:
        places.setdefault((p["n"], p["normalised"]), []).append(p)
    must = [r["dose"] or r["route"] or len(r["cites"]) > 0 for r in rows]
    reasons = [r["reason"] for r in rows]
    extractive = any(m and r is None for m, r in zip(must, reasons, strict=True))
    ends: set[tuple] | None = None  # (source, sentence) where the quotes so far may have ended
    last: dict[int, list[tuple]] = {}  # those that are the last sentence of their source, by page
    clean = True
    for i, row in enumerate(rows):
        if reasons[i] is None and extractive:
            own = [p for n in row["cites"] for p in places.get((n, row["normalised"]), [])]
            near = lambda p: ends is not None and not ends.isdisjoint(((p["n"], p["i"]), (p["n"], p["i"] - 1)))  # noqa: B023, E731
            goes_on = lambda p: ends is None or near(p) or (p["i"] == 0 and p["page"] - 1 in last and any(e[0] != p["n"] for e in last[p["page"] - 1]))  # noqa: B023, E731
            then = [p for p in own if goes_on(p) and (p["lead_in"] < 0 or near(p))]
            if not own:
                reasons[i] = "not a quote"
            elif not then:
                reasons[i] = "lead-in" if all(p["lead_in"] >= 0 for p in own) else "order"
            elif must[i] and not clean:
                reasons[i] = "context"
            else:
                ends, last = {(p["n"], p["i"]) for p in then}, {}
                for p in then:
                    if p["i"] == p["size"] - 1:
                        last.setdefault(p["page"], []).append((p["n"], p["i"]))
        clean = clean and reasons[i] is None
    return reasons


@F.arrow_udf(ArrayType(StringType()))
def aligned(rows: pa.Array, spots: pa.Array) -> pa.Array:
    return pa.array([align(r.as_py(), p.as_py() or []) for r, p in zip(rows, spots, strict=True)], pa.list_(pa.string()))


def judge_quotes(replies: DataFrame, sources: DataFrame) -> DataFrame:
    """reply_id, k, text, cites, reason (null: the sentence stays). replies: reply_id, text; sources: reply_id, n (from 1), page (its place among the page's chunks), section_path, text."""
    s = written(replies.select("reply_id", F.posexplode(reply_sentences(F.col("text"))).alias("k", "s")).select("reply_id", "k", "s.*"), "sentences")
    src = sources.select("reply_id", "n", F.col("page").cast("long").alias("page"), F.coalesce(F.regexp_like(F.lower("section_path"), F.lit(OVERDOSE)), F.lit(False)).alias("section"), source_sentences(F.col("text")).alias("l"))
    src = written(src, "sources")
    cited = s.select("reply_id", "k", "normalised", F.explode("cites").alias("n"))
    lines = src.select("reply_id", "n", "page", F.size("l").alias("size"), F.posexplode("l").alias("i", "x")).where("x.eligible").select("reply_id", "n", "page", "size", "i", "x.normalised", F.coalesce("x.lead_in", F.lit(-1)).alias("lead_in"))
    at = ["reply_id", "n", "normalised"]
    spots = lines.join(cited.select(at).distinct(), at, "left_semi")
    known = cited.join(src.select("reply_id", "n", "section"), ["reply_id", "n"], "left").join(spots.select(at).distinct().withColumn("quoted", F.lit(True)), at, "left")
    known = known.groupBy("reply_id", "k").agg(F.bool_or(F.col("section").isNull()).alias("beyond"), F.bool_or("section").alias("section"), F.bool_or("quoted").alias("quoted"))
    j = s.join(known, ["reply_id", "k"], "left")
    none, bare = F.col("quoted").isNull(), F.size("cites") == 0
    reason = (
        F.when(F.col("malformed"), REASONS[0]).when(F.coalesce("beyond", F.lit(False)), REASONS[1]).when(F.coalesce("section", F.lit(False)), REASONS[2]).when(F.col("overdose"), REASONS[3]).when(F.col("unreadable"), REASONS[4])
        .when(F.col("dose") & bare, REASONS[5]).when(F.col("dose") & none, REASONS[6]).when(F.col("route") & none, REASONS[7])
    )
    whole = j.groupBy("reply_id").agg(F.array_sort(F.collect_list(F.struct("k", "text", "cites", "normalised", "dose", "route", reason.alias("reason")))).alias("s"))
    where = spots.groupBy("reply_id").agg(F.collect_list(F.struct("normalised", "n", "i", "page", "size", "lead_in")).alias("p"))
    said = F.transform("s", lambda x: F.struct(x["normalised"].alias("normalised"), x["cites"].alias("cites"), x["dose"].alias("dose"), x["route"].alias("route"), x["reason"].alias("reason")))
    out = whole.join(where, "reply_id", "left").select("reply_id", "s", aligned(said, F.col("p")).alias("r"))
    return out.select("reply_id", F.explode(F.arrays_zip("s", "r")).alias("x")).select("reply_id", "x.s.k", "x.s.text", "x.s.cites", F.col("x.r").alias("reason"))


def verdicts(judged: DataFrame) -> DataFrame:
    """reply_id, outcome (grounded, or no_evidence where nothing kept cites), kept, withheld, citations."""
    kept = F.col("reason").isNull()
    g = judged.groupBy("reply_id").agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("withheld"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(kept, F.col("cites")))))).alias("citations"))
    return g.select("reply_id", F.when(F.size("citations") > 0, "grounded").otherwise("no_evidence").alias("outcome"), "kept", "withheld", "citations")
