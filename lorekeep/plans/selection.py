"""Queries over the choosing rules and their SQL. Customers stand for devices and users, orders for grants, suppliers and parts for catalogue entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.operators import selection as S
from lorekeep.session import table

NOW, NOW_S = "1996-01-01 00:00:00", 820_454_400
ROUTES = ["EMERGENCY", "CLINICIAN", "SELF_CARE"]


def key():
    return F.col("c_custkey")


def _devices(s, d):
    ram, vram, silicon = key() % 24, key() % 11, key() % 10 == 3
    c = table(s, d, "customer").select("c_custkey", S.desktop_tier(ram, vram, silicon).alias("desktop"), S.mobile_tier(ram, key() % 4 == 0, 2_000_000 + key() % 9 * 100_000).alias("mobile"))
    return c.withColumn("blocked", S.below_tier(F.col("mobile"), F.when(key() % 3 == 0, "high").when(key() % 3 == 1, "mid").otherwise("ultra")))


def _grants(s, d):
    """Every eleventh order is for life, every thirteenth has an end that is no date."""
    k = F.col("o_orderkey")
    end = F.when(k % 11 == 0, None).when(k % 13 == 0, "soon").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 00:00:00")))
    return table(s, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("model_id"), end.alias("expires_at"), "o_orderkey")


_GRANTS = "SELECT o_custkey AS user_id, o_orderpriority AS model_id, o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' END AS expires_at FROM orders"


def _states(s, d):
    return S.entitlement_states(_grants(s, d), NOW)


_STATES = f"""SELECT user_id, model_id, CASE WHEN p IS NOT NULL THEN 'period' WHEN l THEN 'perpetual' ELSE 'none' END AS state, p AS period FROM (
SELECT user_id, model_id, max(CASE WHEN TRY_CAST(expires_at AS TIMESTAMP) > TIMESTAMP '{NOW}' THEN expires_at END) AS p, bool_or(expires_at IS NULL) AS l FROM ({_GRANTS}) GROUP BY ALL)"""


def _switches(s, d):
    st, u = _states(s, d), F.col("user_id")
    used = F.when(u % 2 == 0, F.col("period"))
    return st.select("user_id", "model_id", S.switch_allowed(u % 5 != 0, F.col("state"), F.col("period"), used, F.when(u % 3 != 0, NOW_S - u * 86_400), F.lit(NOW_S)).alias("verdict"))


def _active(s, d):
    g = _grants(s, d)
    return S.active(g.withColumn("expires_at", F.try_to_timestamp("expires_at")), NOW).select("o_orderkey")


def _pair(s, d, mod, rest):
    return table(s, d, "orders").where(F.col("o_orderkey") % mod == rest).select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("model_id"))


def _sql_pair(mod, rest):
    return f"SELECT DISTINCT o_custkey AS user_id, o_orderpriority AS model_id FROM orders WHERE o_orderkey % {mod} = {rest}"


def _entries(s, d):
    t = lambda name, sha, base: F.struct(F.lit(name).alias("tier"), sha.alias("sha"), F.lit("text").alias("kind"), base.alias("base"))
    sha = F.concat(F.lit("ab"), F.col("p_size").cast("string"))
    return table(s, d, "part").select(F.col("p_partkey").alias("entry"), F.array(t("high", F.upper(sha), F.col("p_brand")), t("low", F.concat(F.lit(" "), sha), F.lit("Brand#11"))).alias("tiers"))


def _wanted(s, d):
    k = F.col("p_partkey")
    return table(s, d, "part").select(k.alias("entry"), F.when(k % 5 == 0, "zz").otherwise(F.concat(F.lit("AB"), F.col("p_size").cast("string"))).alias("sha"), F.lit("text").alias("kind"), F.when(k % 3 == 0, F.col("p_brand")).when(k % 3 == 1, "Brand#11").otherwise("other").alias("base"))


def _catalogue(s, d):
    p = table(s, d, "lineitem")
    k = F.col("l_orderkey")
    new = p.where("l_linenumber <= 2 and l_orderkey % 4 = 0").select(k.alias("entry"), (F.col("l_partkey") % 12).alias("version"), F.when(k % 8 == 0, F.sha2(k.cast("string"), 256)).otherwise("short").alias("sha"), F.when(k % 12 != 0, F.col("l_quantity")).alias("size"))
    old = p.where("l_linenumber = 3").select(k.alias("entry"), (F.col("l_partkey") % 12).alias("version"))
    return S.catalogue_problems(new, old, 1, 10)


def _crisis(s, d):
    rule, keep = S.crisis_rule(key() % 5 != 0, F.when(key() % 2 == 0, "replace").when(key() % 3 == 0, "append").otherwise("other"), F.when(key() % 7 == 0, F.array(F.lit("EMERGENCY"), F.lit("nowhere"))).when(key() % 7 == 1, F.array().cast("array<string>")).when(key() % 7 == 2, None).otherwise(F.array(F.lit("EMERGENCY"), F.lit("CLINICIAN"))), ROUTES, ["EMERGENCY"])
    return table(s, d, "customer").select("c_custkey", rule.alias("rule"), F.array_join(keep, "|").alias("keep"), S.sampling(key() % 5 != 0, F.when(key() % 3 == 0, F.col("c_acctbal")).when(key() % 3 == 1, F.lit(float("nan"))), F.lit(0.5)).alias("temperature"))


def _modes(s, d):
    """Conversations as runs: user turns' first words as prompts."""
    t = table(s, d, "conversations")
    g = t.groupBy("conv_id").agg(F.count_distinct(F.when(F.col("role") == "system", F.col("text"))).alias("prompts"), F.max(F.when(F.col("role") == "system", F.sha2("text", 256))).alias("sha"))
    c = F.col("conv_id")
    return g.select("conv_id", S.run_mode(F.col("prompts") + F.when(c % 4 == 0, 2).when(c % 4 == 1, 0).otherwise(1), c % 7 != 0, F.col("sha"), F.when(c % 3 == 0, "x"), F.when(c % 5 != 0, c)).alias("problem"))


def _images(s, d):
    b = lambda kind, text, flag, edit: F.struct(F.lit(kind).alias("kind"), text.alias("content"), flag.alias("flagged"), edit.alias("edited"))
    blocks = F.array(b("text", F.lit("x"), key() % 2 == 0, F.lit(True)), b("latex", F.when(key() % 5 == 0, " ").otherwise("y"), key() % 3 == 0, key() % 4 == 0))
    mode, usable = S.image_confirm(F.when(key() % 4 == 1, "accept").when(key() % 4 == 2, "refuse").when(key() % 4 == 3, "odd").otherwise("review"), blocks)
    return table(s, d, "customer").select("c_custkey", mode.alias("mode"), usable.alias("usable"))


def _plan(s, d):
    modes = table(s, d, "nation").where("n_nationkey < 4").select(F.col("n_name").alias("mode"), ((F.col("n_nationkey") + 1) / 10.0).alias("weight"))
    return S.dataset_plan(modes, table(s, d, "region").select(F.col("r_name").alias("domain")), 400, "seed")


QUERIES = {
    "hardware_tier": lambda s, d: _devices(s, d).select("c_custkey", "desktop", "mobile"),
    "sel_min_tier": lambda s, d: _devices(s, d).select("c_custkey", "blocked"),
    "src_pdf_budget": lambda s, d: table(s, d, "customer").select("c_custkey", S.ocr_budget(key() % 700).alias("budget")),
    "st_offline_throttle": lambda s, d: table(s, d, "customer").select("c_custkey", S.throttle_seconds(key() % 14, NOW_S - key() % 40, F.lit(NOW_S)).alias("wait")),
    "sel_grace": lambda s, d: table(s, d, "orders").select("o_orderkey", S.grace_expired(F.unix_seconds(F.col("o_orderdate").cast("timestamp")), F.lit(NOW_S)).alias("expired")),
    "entitlement_active": _active,
    "sel_entitlement_state": _states,
    "tier_switch_allowed": _switches,
    "sel_pending": lambda s, d: S.queue_grants(_pair(s, d, 3, 0).distinct(), _pair(s, d, 7, 1), _pair(s, d, 5, 2), ["user_id", "model_id"]),
    "join_pending": lambda s, d: S.merge_pending(_pair(s, d, 3, 0), _pair(s, d, 2, 1), _pair(s, d, 5, 2)),
    "sel_crisis_rule": _crisis,
    "sel_catalog_variant": lambda s, d: S.catalogue_variants(_entries(s, d), _wanted(s, d)),
    "catalog_checks": _catalogue,
    "sel_gate_mode": _modes,
    "sel_image_confirm": _images,
    "dataset_mix": _plan,
}

_C = "FROM (SELECT c_custkey AS k, * FROM customer)"
_DESK = "CASE WHEN k % 10 = 3 OR k % 11 >= 8 THEN 'high' WHEN k % 24 >= 16 THEN 'mid' ELSE 'low' END"
_MOB = "CASE WHEN k % 24 >= 8 AND (k % 4 = 0 OR 2000000 + k % 9 * 100000 >= 2750000) THEN 'mid' ELSE 'low' END"
ORACLE_SQL = {
    "hardware_tier": f"SELECT c_custkey, {_DESK} AS desktop, {_MOB} AS mobile {_C}",
    "sel_min_tier": f"SELECT c_custkey, k % 3 = 0 OR (k % 3 = 1 AND {_MOB} = 'low') AS blocked {_C}",
    "src_pdf_budget": f"SELECT c_custkey, CASE WHEN k % 700 = 0 THEN 'none' WHEN k % 700 <= 150 THEN 'ok' WHEN k % 700 <= 500 THEN 'warn' ELSE 'refuse' END AS budget {_C}",
    "st_offline_throttle": f"SELECT c_custkey, greatest(0, CASE WHEN k % 14 < 5 THEN 0 ELSE least(2 ** (k % 14 - 4), 30) END::BIGINT - k % 40)::BIGINT AS wait {_C}",
    "sel_grace": f"SELECT o_orderkey, {NOW_S} - epoch(o_orderdate) > {30 * 86400} AS expired FROM orders",
    "entitlement_active": f"SELECT o_orderkey FROM ({_GRANTS}) WHERE TRY_CAST(expires_at AS TIMESTAMP) IS NULL OR TRY_CAST(expires_at AS TIMESTAMP) > TIMESTAMP '{NOW}'",
    "sel_entitlement_state": _STATES,
    "tier_switch_allowed": f"""SELECT user_id, model_id, CASE WHEN user_id % 5 = 0 THEN 'ok' WHEN state = 'period' AND user_id % 2 = 0 THEN 'used' WHEN state = 'perpetual' AND user_id % 3 <> 0 AND user_id < 30 THEN 'cooldown' ELSE 'ok' END AS verdict FROM ({_STATES})""",
    "sel_pending": f"SELECT * FROM ({_sql_pair(3, 0)}) EXCEPT ({_sql_pair(7, 1)} UNION {_sql_pair(5, 2)})",
    "join_pending": f"SELECT *, 'server' AS origin FROM ({_sql_pair(3, 0)}) UNION ALL SELECT *, 'pending' FROM (({_sql_pair(2, 1)} INTERSECT {_sql_pair(5, 2)}) EXCEPT {_sql_pair(3, 0)})",
    "sel_crisis_rule": f"""SELECT c_custkey, CASE WHEN k % 5 <> 0 AND k % 2 = 0 THEN 'replace' END AS rule, CASE WHEN k % 5 <> 0 AND k % 2 = 0 THEN CASE WHEN k % 7 < 3 THEN 'EMERGENCY' ELSE 'EMERGENCY|CLINICIAN' END END AS keep,
  CASE WHEN k % 5 <> 0 AND k % 3 = 0 THEN c_acctbal ELSE 0.5 END AS temperature {_C}""",
    "sel_catalog_variant": """SELECT entry, sha, CASE WHEN entry % 5 = 0 THEN NULL WHEN base = p_brand THEN 'high' WHEN base = 'Brand#11' THEN 'low' END AS tier,
  CASE WHEN entry % 5 = 0 THEN 'unpinned' WHEN base = p_brand OR base = 'Brand#11' THEN NULL ELSE 'conflict' END AS problem
FROM (SELECT p_partkey AS entry, p_brand, CASE WHEN p_partkey % 5 = 0 THEN 'zz' ELSE 'AB' || p_size END AS sha, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN 'Brand#11' ELSE 'other' END AS base FROM part)""",
    "catalog_checks": """WITH n AS (SELECT l_orderkey AS entry, count(*) AS n, min(l_partkey % 12) AS lo, max(l_partkey % 12) AS hi FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey % 4 = 0 GROUP BY 1),
o AS (SELECT l_orderkey AS entry, max(l_partkey % 12) AS old FROM lineitem WHERE l_linenumber = 3 GROUP BY 1), j AS (SELECT * FROM n LEFT JOIN o USING (entry))
SELECT entry, 'repeated' AS problem FROM j WHERE n > 1 UNION ALL SELECT entry, 'version out of bounds' FROM j WHERE lo < 1 OR hi > 10 UNION ALL SELECT entry, 'downgrade' FROM j WHERE hi < old
UNION ALL SELECT entry, 'hash' FROM j WHERE entry % 8 <> 0 UNION ALL SELECT entry, 'size' FROM j WHERE entry % 12 = 0""",
    "sel_gate_mode": """WITH g AS (SELECT conv_id AS c, count(DISTINCT CASE WHEN role = 'system' THEN text END) + CASE conv_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS p, max(CASE WHEN role = 'system' THEN sha256(text) END) AS sha FROM conversations GROUP BY conv_id)
SELECT c AS conv_id, CASE WHEN c % 7 = 0 THEN NULL WHEN p > 1 THEN 'several prompts' WHEN p = 0 THEN 'no prompt' WHEN sha IS DISTINCT FROM CASE WHEN c % 3 = 0 THEN 'x' END THEN 'other prompt' WHEN c % 5 = 0 THEN 'no seed' END AS problem FROM g""",
    "sel_image_confirm": f"""SELECT c_custkey, m AS mode, CASE m WHEN 'accept' THEN true WHEN 'review' THEN k % 4 = 0 AND k % 3 <> 0 ELSE false END AS usable FROM (SELECT *, CASE WHEN k % 5 = 0 THEN 'refuse' WHEN k % 4 = 1 THEN CASE WHEN k % 3 = 0 THEN 'review' ELSE 'accept' END WHEN k % 4 = 2 THEN 'refuse' ELSE 'review' END AS m {_C})""",
    "dataset_mix": """SELECT mode, domain, task, sha256('seed|' || mode || '|' || domain || '|' || task) AS order_key FROM (
SELECT mode, domain, unnest(range(1, floor(w * 400 / 5)::INT + 1))::INTEGER AS task FROM (SELECT n_name AS mode, (n_nationkey + 1) / 10.0 AS w FROM nation WHERE n_nationkey < 4), (SELECT r_name AS domain FROM region))""",
}
