"""Scores of transcription and probe runs: records joined to their items, character error rates, verdicts, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import formulas as FM
from lorekeep.functions import language as L

ACCEPT, REVIEW, OPERATOR = 0.90, 0.70, 0.97
#: Pairs whose exchange changes what a formula says, each way (fixed values).
SIGNS = [("+", "-"), ("-", "+"), ("<", ">"), (">", "<"), ("=", "-"), ("-", "=")]
LOOK_ALIKES = [("0", "o"), ("o", "0"), ("1", "l"), ("l", "1"), ("5", "s"), ("s", "5")]
WEIGHT = 5


def items_records(items: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chosen, problems): for each item the record of the last repeat of the run; problems name items with a repeat missing or given twice. items: item; records: item, rep, ..."""
    last = records.agg(F.max("rep").alias("last_rep"))
    per = records.groupBy("item", "rep").agg(F.count("*").alias("n"))
    reps = records.select("rep").distinct()
    wanted = items.select("item").distinct().crossJoin(F.broadcast(reps))  # the repeats of a run are a handful
    problems = wanted.join(per, ["item", "rep"], "left").where("n is null or n > 1").select("item", "rep", F.when(F.col("n").isNull(), "missing").otherwise("duplicate").alias("problem"))
    chosen = records.join(F.broadcast(last), F.col("rep") == F.col("last_rep")).drop("last_rep")
    return items.join(chosen, "item", "left"), problems


def score_items(rows: DataFrame) -> DataFrame:
    """item, exact, cer, weighted, verdict_ok: rows: item, expected (null: should be refused), got, verdict.

    A refused item is right if the verdict is refuse. Others count as right for accept or review; substitutions of signs and look-alikes weigh five times."""
    a, b = FM.normalise_latex(F.col("expected")), FM.normalise_latex(F.col("got"))
    r = rows.withColumn("_a", a).withColumn("_b", b).withColumn("_al", L.aligned("_a", "_b"))
    refusal = F.col("expected").isNull()
    refused = F.coalesce(F.col("verdict") == "refuse", F.lit(False))
    heavy = F.array(*[F.lit(x + y) for x, y in SIGNS + LOOK_ALIKES])
    n = F.size(F.filter(F.col("_al.substituted"), lambda p: F.array_contains(heavy, p)))
    cer = F.when(F.char_length("_a") == 0, F.when(F.char_length("_b") == 0, 0.0).otherwise(1.0)).otherwise(F.col("_al.distance") / F.char_length("_a"))
    return r.select(
        "item", F.when(refusal, refused).otherwise(F.col("_a") == F.col("_b")).alias("exact"), F.round(F.when(refusal, F.when(refused, 0.0).otherwise(1.0)).otherwise(cer), 6).alias("cer"),
        F.when(refusal, 0).otherwise(n * (WEIGHT - 1) + F.col("_al.distance")).cast("int").alias("weighted"), F.when(refusal, refused).otherwise(F.coalesce(F.col("verdict").isin("accept", "review"), F.lit(False))).alias("verdict_ok"), refusal.alias("refusal"),
    )


def score_run(scored: DataFrame, run: str, least_exact: float = 0.9) -> DataFrame:
    """run, total, exact, refusals_ok, mean_cer, passed."""
    g = scored.groupBy(run).agg(F.count("*").alias("total"), F.count_if("exact").alias("exact"), F.count_if(F.col("refusal") & F.col("verdict_ok")).alias("refusals_ok"), F.count_if("refusal").alias("_refusals"), F.round(F.avg("cer"), 6).alias("mean_cer"))
    return g.withColumn("passed", (F.col("exact") >= F.ceil(F.col("total") * F.lit(least_exact))) & (F.col("refusals_ok") == F.col("_refusals"))).drop("_refusals")


def pair_summary(pairs: DataFrame, by: str) -> DataFrame:
    """Passed, failed, undecided and awaiting pairs; pairs: outcome, question (null: none)."""
    is_ = lambda v: F.count_if(F.col("outcome") == v)
    return pairs.groupBy(by).agg(is_("PASS").alias("passed"), is_("FAIL").alias("failed"), is_("UNDECIDED").alias("undecided"), F.count_if(F.col("question").isNotNull()).alias("awaiting"), F.count("*").alias("total"))


def probe_verdicts(probes: DataFrame, stack: str, names: list[str]) -> DataFrame:
    """stack, passed, failed, undecided: of the named probes; one without any record is undecided. probes: stack, probe, outcome."""
    worst = probes.where(F.col("probe").isin(names)).groupBy(stack, "probe").agg(F.bool_or(F.col("outcome") == "FAIL").alias("f"), F.bool_and(F.col("outcome") == "PASS").alias("p"))
    g = worst.groupBy(stack).agg(F.count_if("p").alias("passed"), F.count_if("f").alias("failed"))
    return g.withColumn("undecided", F.lit(len(names)) - F.col("passed") - F.col("failed"))


def confidences(tokens: DataFrame, by: list[str]) -> DataFrame:
    """by, confidence (exp of the mean log probability), least_operator (least probability of an operator token): log probabilities above 0, infinite or not a number are untracked; nothing tracked is 0. tokens: piece, logprob."""
    lp = F.when((F.col("logprob") <= 0) & (F.col("logprob") > float("-inf")), F.col("logprob"))
    op = F.regexp_like("piece", F.lit(r"[-+=<>*/^]"))
    return tokens.groupBy(*by).agg(F.round(F.coalesce(F.exp(F.avg(lp)), F.lit(0.0)), 6).alias("confidence"), F.round(F.min(F.when(op, F.exp(lp))), 6).alias("least_operator"))


def assess(blocks: DataFrame, by: str) -> DataFrame:
    """by, verdict, warnings (sorted): blocks: kind, confidence, least_operator, valid, truncated. No formula or one below 0.70 is refused; any warning turns accept into review."""
    latex = F.col("kind") == "latex"
    g = blocks.groupBy(by).agg(
        F.count_if(latex).alias("n"), F.bool_or(latex & (F.col("confidence") < REVIEW)).alias("low"), F.bool_or(latex & (F.col("confidence") < ACCEPT)).alias("unsure"),
        F.bool_or(F.coalesce(latex & (F.col("least_operator") < OPERATOR), F.lit(False))).alias("operator"), F.bool_or(~F.col("valid")).alias("invalid"), F.bool_or("truncated").alias("cut"),
    )
    warnings = F.array_sort(F.array_compact(F.array(F.when(F.col("n") == 0, "no formula"), F.when(F.col("invalid"), "invalid"), F.when(F.col("unsure"), "low confidence"), F.when(F.col("operator"), "operator"), F.when(F.col("cut"), "truncated"))))
    verdict = F.when((F.col("n") == 0) | F.col("low"), "refuse").when(F.size(warnings) > 0, "review").otherwise("accept")
    return g.select(by, verdict.alias("verdict"), F.array_join(warnings, "|").alias("warnings"))


def survives(verdict: Column, weighted: Column) -> Column:
    """Whether an error that changes the meaning passed as accepted."""
    return (verdict == "accept") & (weighted > 0)
