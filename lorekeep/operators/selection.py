"""Rules that choose: tiers, entitlements and their periods, catalogue variants, overrides of supervised entries, run modes. Columns in, columns out; sets of rows only where a rule compares rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIER_RANK = {"low": 0, "mid": 1, "high": 2}
FAST_CORE_KHZ, COOLDOWN_SECONDS, GRACE_DAYS = 2_750_000, 30 * 86_400, 30
OCR_WARN, OCR_REFUSE = 150, 500


def desktop_tier(ram_gb: Column, vram_gb: Column, own_silicon: Column) -> Column:
    return F.when(own_silicon | (vram_gb >= 8), "high").when(ram_gb >= 16, "mid").otherwise("low")


def mobile_tier(ram_gb: Column, i8mm: Column, core_khz: Column) -> Column:
    return F.when((ram_gb >= 8) & (i8mm | (core_khz >= FAST_CORE_KHZ)), "mid").otherwise("low")


def below_tier(have: Column, need: Column) -> Column:
    """Whether a device is below the tier asked for; an unknown tier on either side never blocks."""
    rank = F.create_map(*[F.lit(x) for kv in TIER_RANK.items() for x in kv])
    return F.coalesce(F.try_element_at(rank, have) < F.try_element_at(rank, need), F.lit(False))


def ocr_budget(image_pages: Column) -> Column:
    return F.when(image_pages == 0, "none").when(image_pages <= OCR_WARN, "ok").when(image_pages <= OCR_REFUSE, "warn").otherwise("refuse")


def throttle_seconds(failures: Column, last_failed: Column, now: Column) -> Column:
    """Seconds left to wait: from the fifth failure on 2, 4, 8 ... up to 30, less what has passed."""
    required = F.when(failures < 5, 0).when(failures >= 9, 30).otherwise(F.least(F.pow(F.lit(2.0), failures - 4), F.lit(30.0))).cast("long")
    return F.greatest(F.lit(0), required - F.greatest(F.lit(0), now - last_failed)).cast("long")


def grace_expired(last_online: Column, now: Column) -> Column:
    return now - last_online > GRACE_DAYS * 86_400


def active(entitlements: DataFrame, now: str) -> DataFrame:
    """Rows without an end, or with one still to come."""
    return entitlements.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp")))


def entitlement_states(entitlements: DataFrame, now: str) -> DataFrame:
    """user_id, model_id, state, period: the latest period still running, else perpetual, else none; an end that is no time counts for nothing. expires_at is text."""
    end = F.try_to_timestamp("expires_at")
    live = F.max(F.when(end > F.lit(now).cast("timestamp"), F.struct(end.alias("at"), F.col("expires_at").alias("text"))))
    g = entitlements.groupBy("user_id", "model_id").agg(live.alias("live"), F.bool_or(F.col("expires_at").isNull()).alias("perpetual"))
    state = F.when(F.col("live").isNotNull(), "period").when(F.col("perpetual"), "perpetual").otherwise("none")
    return g.select("user_id", "model_id", state.alias("state"), F.col("live.text").alias("period"))


def switch_allowed(committed: Column, state: Column, period: Column, used_period: Column, switched_at: Column, now: Column) -> Column:
    """ok, used (this period's change is spent) or cooldown. Free before the first use and where no period is known."""
    used = (state == "period") & period.eqNullSafe(used_period)
    cooling = (state == "perpetual") & F.coalesce(now < switched_at + COOLDOWN_SECONDS, F.lit(False))
    return F.when(~committed, "ok").when(used, "used").when(cooling, "cooldown").otherwise("ok")


def queue_grants(grants: DataFrame, pending: DataFrame, entitled: DataFrame, key: list[str]) -> DataFrame:
    """Grants that neither wait already nor are held."""
    return grants.join(pending.select(*key).distinct(), key, "left_anti").join(entitled.select(*key).distinct(), key, "left_anti")


def merge_pending(server: DataFrame, local: DataFrame, pending: DataFrame) -> DataFrame:
    """The server's entitlements, and those of this device that still wait for it: pending of the same user and model, and of a model the server does not list. All: user_id, model_id."""
    key = ["user_id", "model_id"]
    waiting = local.select(*key).distinct().join(pending.select(*key).distinct(), key, "left_semi").join(server.select(*key).distinct(), key, "left_anti")
    return server.select(*key).distinct().withColumn("origin", F.lit("server")).unionByName(waiting.withColumn("origin", F.lit("pending")))


def sampling(supervised: Column, pinned: Column, default: Column) -> Column:
    """An entry's own setting counts only if it is supervised and the setting is a number."""
    return F.when(F.coalesce(supervised, F.lit(False)) & pinned.isNotNull() & ~F.isnan(pinned), pinned).otherwise(default)


def crisis_rule(supervised: Column, rule: Column, keep: Column, routes: list[str], default_keep: list[str]) -> tuple[Column, Column]:
    """replace with the routes to keep, or nulls (append). Unknown rules fall back to append, unknown or empty route lists to the default."""
    on = F.coalesce(supervised & (rule == "replace"), F.lit(False))
    known = F.array(*map(F.lit, routes))
    valid = F.coalesce((F.size(keep) > 0) & F.forall(keep, lambda r: F.coalesce(F.array_contains(known, r), F.lit(False))), F.lit(False))
    return F.when(on, "replace"), F.when(on, F.when(valid, keep).otherwise(F.array(*map(F.lit, default_keep))))


def catalogue_variants(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """entry, sha, tier, problem: the variant of an entry whose pinned hash is asked for. entries: entry, kind, base, tiers (array of struct tier, sha, kind, base); wanted: entry, sha, kind, base.

    A hash pinned in several tiers goes to the one that agrees on kind and base; none at all is `unpinned`, no agreement `conflict`."""
    clean = lambda c: F.lower(F.trim(c))
    own = F.filter("tiers", lambda t: (clean(t["sha"]) == clean(F.col("sha"))) & t["tier"].isNotNull())
    agree = F.array_min(F.transform(F.filter(own, lambda t: (t["kind"] == F.col("kind")) & (t["base"] == F.col("base"))), lambda t: t["tier"]))
    # both sides are divided by entry alone, and so are the answers: tiers never become rows
    each = wanted.select("entry", "sha", "kind", "base").join(entries.select("entry", "tiers"), "entry", "left").select("entry", "sha", "kind", "base", agree.alias("_tier"), F.coalesce(F.size(own), F.lit(0)).alias("_m"))
    hit = each.groupBy("entry", "sha", "kind", "base").agg(F.min("_tier").alias("tier"), F.sum(F.greatest("_m", F.lit(0))).alias("_n"))
    problem = F.when(F.col("_n") == 0, "unpinned").when(F.col("tier").isNull(), "conflict")
    return hit.select("entry", "sha", "tier", problem.alias("problem"))


def catalogue_problems(new: DataFrame, old: DataFrame, low: int, high: int) -> DataFrame:
    """entry, problem: repeated entries, versions out of bounds or lower than before, artefacts without a full hash or a size. Both: entry, version, sha, size."""
    counts = new.groupBy("entry").agg(F.count("*").alias("_n"), F.min("version").alias("_low"), F.max("version").alias("version"), F.bool_or(~F.coalesce(F.regexp_like("sha", F.lit("^[0-9a-f]{64}$")), F.lit(False))).alias("_bad_sha"), F.bool_or(~F.coalesce(F.col("size") > 0, F.lit(False))).alias("_bad_size"))
    before = old.groupBy("entry").agg(F.max("version").alias("_old"))
    c = counts.join(before, "entry", "left")
    problems = F.array_compact(F.array(
        F.when(F.col("_n") > 1, "repeated"), F.when((F.col("_low") < low) | (F.col("version") > high), "version out of bounds"), F.when(F.col("version") < F.col("_old"), "downgrade"),
        F.when(F.col("_bad_sha"), "hash"), F.when(F.col("_bad_size"), "size"),
    ))
    return c.select("entry", F.explode(problems).alias("problem"))


def run_mode(prompts: Column, scored: Column, prompt_sha: Column, pinned_sha: Column, seed: Column) -> Column:
    """Why a scored run may not count, the first reason in order, else null: more than one system prompt, none, one that differs from the pinned, no fixed seed."""
    return F.when(~scored, None).when(prompts > 1, "several prompts").when(prompts == 0, "no prompt").when(~prompt_sha.eqNullSafe(pinned_sha), "other prompt").when(seed.isNull(), "no seed")


def image_confirm(verdict: Column, blocks: Column) -> tuple[Column, Column]:
    """The mode a transcription is shown in, and whether it can be used as it stands. blocks: kind, content, flagged, edited.

    Accept with flagged maths is reviewed; without any maths it is refused; an unknown verdict is reviewed. In review it can be used once some maths was edited and none is flagged."""
    maths = lambda b: (b["kind"] == "latex") & (F.trim(b["content"]) != "")
    flagged = F.exists(blocks, lambda b: (b["kind"] == "latex") & b["flagged"])
    some = F.exists(blocks, maths)
    known = F.when(verdict.isin("accept", "review", "refuse"), verdict).otherwise("review")
    mode = F.when(~some, "refuse").when((known == "accept") & flagged, "review").otherwise(known)
    usable = F.when(mode == "accept", some).when(mode == "review", F.exists(blocks, lambda b: maths(b) & b["edited"]) & ~flagged).otherwise(False)
    return mode, usable


def dataset_plan(modes: DataFrame, domains: DataFrame, total: int, seed: str) -> DataFrame:
    """position, mode, domain, task: `total` tasks shared out by mode weight, evenly over domains, in an order fixed by the seed. modes: mode, weight; domains: domain. A plan is as small as its total."""
    n = domains.agg(F.count("*").alias("_n"))
    per = modes.crossJoin(F.broadcast(domains)).crossJoin(F.broadcast(n)).withColumn("_k", F.floor(F.col("weight") * total / F.col("_n")).cast("int"))
    tasks = per.where("_k > 0").select("mode", "domain", F.explode(F.sequence(F.lit(1), "_k")).alias("task"))
    order = F.sha2(F.concat_ws("|", F.lit(seed), "mode", "domain", F.col("task").cast("string")), 256)
    return tasks.select("mode", "domain", "task", order.alias("order_key"))
