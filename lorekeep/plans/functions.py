"""Queries over the text functions and scores and their SQL. Where the tables hold no such text, a column says what is put around theirs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.functions import doses as D
from lorekeep.functions import formulas as FM
from lorekeep.functions import language as L
from lorekeep.functions import text as T
from lorekeep.functions.calc import calc
from lorekeep.functions.toolcalls import tool_calls
from lorekeep.functions.wordpiece import CONTROL, WordPieces
from lorekeep.operators import scoring as S
from lorekeep.plans import replies as RP
from lorekeep.plans.packs import norm_sql
from lorekeep.session import table

FORMS = ["tablets", "cream", "gel", "oral spray"]


def _key(name):
    return F.col(name)


def _part_names(s, d):
    k = F.col("p_partkey")
    group = F.element_at(F.array(*map(F.lit, T.POPULATIONS)), (k % len(T.POPULATIONS) + 1).cast("int"))
    form = F.element_at(F.array(*map(F.lit, FORMS)), (k % len(FORMS) + 1).cast("int"))
    tail = F.when(k % 5 == 0, F.concat(F.lit(" in "), group)).when(k % 5 == 1, F.concat(F.lit(" for "), group, F.lit(" and others"))).when(k % 5 == 2, F.concat(F.lit(" ("), group, F.lit(")"))).when(k % 5 == 3, F.concat(F.lit(" "), form, F.lit(" "), form)).otherwise(F.lit(" (open"))
    return table(s, d, "part").select("p_partkey", F.concat("p_name", tail).alias("name"))


_POP = "[" + ", ".join(f"'{x}'" for x in T.POPULATIONS) + "]"
_FORM = "[" + ", ".join(f"'{x}'" for x in FORMS) + "]"
_NAMES = f"""SELECT p_partkey, p_name || CASE p_partkey % 5 WHEN 0 THEN ' in ' || g WHEN 1 THEN ' for ' || g || ' and others' WHEN 2 THEN ' (' || g || ')' WHEN 3 THEN ' ' || f || ' ' || f ELSE ' (open' END AS name
FROM (SELECT *, {_POP}[(p_partkey % {len(T.POPULATIONS)} + 1)::INTEGER] AS g, {_FORM}[(p_partkey % {len(FORMS)} + 1)::INTEGER] AS f FROM part)"""
_BARE = r"trim(regexp_replace(regexp_replace(name, '\([^)]*\)', ' ', 'g'), '[\s\p{Z}\x{85}]+', ' ', 'g'))"
_GROUPS = "|".join(T.POPULATIONS)


def _titles(s, d):
    t = table(s, d, "documents").select("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, 80).alias("t"))
    k, odd = T.plain_key(F.col("t"))
    return t.select("doc_id", k.alias("key"), odd.alias("odd"))


_FOLDED = f"translate(lower(t), '{T.FOLD_FROM}', '{T.FOLD_TO}')"
for _one, _two in T.FOLD_TWO.items():
    _FOLDED = f"replace({_FOLDED}, '{_one}', '{_two}')"


def _thinking(s, d):
    """Turns with reasoning before, none, nothing else, and a tag that never closes."""
    k = F.col("turn")
    t = F.substring(F.coalesce("text", F.lit("")), 1, 30)
    text = F.when(k % 4 == 0, F.concat(F.lit("<think> a b </think> "), t)).when(k % 4 == 1, t).when(k % 4 == 2, F.lit("<think>only</think>")).otherwise(F.concat(t, F.lit("<THINK>open")))
    inner, rest, state = T.split_reasoning(text)
    return table(s, d, "conversations").select("conv_id", "turn", inner.alias("reasoning"), rest.alias("reply"), state.alias("state"))


def _calls(s, d):
    """Turns as arguments of calls: two in fences, a bare one after prose with braces, one with `parameters`, a truncated one, a fence without JSON before a bare call, an object without a name before one with."""
    said = F.to_json(F.struct(F.col("text").alias("said")))
    body = lambda name, key: F.concat(F.lit('{"name": "' + name + f'", "{key}": '), said, F.lit("}"))
    l = F.lit  # noqa: E741
    forms = [
        F.concat(l("<tool_call> "), body("a", "arguments"), l(" </tool_call>x<tool_call>"), body("b", "arguments"), l("</tool_call>")), F.concat(l('Say {this "} first: {x} '), body("c", "arguments"), l(" then }")), F.concat(l("```json\n"), body("d", "parameters"), l("\n```")),
        F.substr(body("e", "arguments"), l(1), F.length(body("e", "arguments")) - 1), F.concat(l("<tool_call>no json</tool_call> "), body("f", "arguments")), F.concat(said, l(' {"name": 7} '), l('{"name": "g"}')), F.concat(l("<tool_call>"), body("h", "arguments"), l("<tool_call>")), F.col("text"),
    ]
    text = F.element_at(F.array(*forms), (F.col("turn") % 8 + 1).cast("int"))
    return table(s, d, "conversations").select("conv_id", "turn", F.explode(tool_calls(text)).alias("c")).select("conv_id", "turn", "c.id", "c.name", "c.arguments")


def _clean(s, d):
    k = F.col("c_custkey")
    raw = F.concat(F.when(k % 4 == 0, ".").when(k % 4 == 1, "a/").otherwise(""), F.col("c_name"), F.when(k % 3 == 0, " ").otherwise(""), F.when(k % 7 == 0, ".x").otherwise(""))
    return table(s, d, "customer").select("c_custkey", T.clean_segment(raw).alias("segment"), T.clean_pack_id(raw).alias("pack_id"), T.clean_email(F.concat(F.lit(" "), raw, F.lit("@X.org "))).alias("email"))


_RAW = "CASE c_custkey % 4 WHEN 0 THEN '.' WHEN 1 THEN 'a/' ELSE '' END || c_name || CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE '' END || CASE WHEN c_custkey % 7 = 0 THEN '.x' ELSE '' END"


def _doses(s, d):
    """Amounts written in words and figures with their units, marks and shares, and names without any."""
    k = F.col("c_custkey")
    n = (k % 1000).cast("int")
    names = [w for w, (kind, _) in D.WORDS.items() if kind in ("unit", "teen")]
    tens = [w for w, (kind, _) in D.WORDS.items() if kind == "tens"]
    word = lambda pool, i: F.element_at(F.array(*map(F.lit, pool)), i.cast("int"))
    h, r = F.floor(n / 100), n % 100
    below = F.when(r < 20, word(names, r + 1)).otherwise(F.concat(word(tens, F.greatest(F.floor(r / 10) - 1, F.lit(1))), F.when(r % 10 > 0, F.concat(F.lit("-"), word(names, r % 10 + 1))).otherwise("")))
    words = F.when(h == 0, below).otherwise(F.concat(word(names, h + 1), F.lit(" hundred"), F.when(r > 0, F.concat(F.lit(" and "), below)).otherwise("")))
    fig = n.cast("string")
    forms = [F.concat(F.lit("Take "), words, F.lit(" milligrams [1].")), F.concat(F.lit("**"), fig, F.lit("** tablets, twice daily")), F.concat(fig, F.lit(" and a half tabs of it")), F.concat(fig, F.lit(",000 ML")), F.concat(F.lit("Rest, "), F.col("c_name")), F.concat(F.lit("half a tablet – "), words)]
    text = F.element_at(F.array(*forms), (k % 6 + 1).cast("int"))
    return table(s, d, "customer").select("c_custkey", D.read_doses(text).alias("r"))


_DOSED = """SELECT c_custkey, CASE f WHEN 0 THEN 'take ' || n || 'mg' WHEN 1 THEN n || 'tablets, 2 times daily' WHEN 2 THEN n || ' 1/2tablets of it' WHEN 3 THEN n || '000ml' WHEN 4 THEN 'rest, ' || lower(c_name) ELSE '1/2tablets - ' || n END AS normalised,
CASE f WHEN 0 THEN n || 'mg' WHEN 1 THEN n || 'tablets' WHEN 2 THEN '1/2tablets' WHEN 3 THEN n || '000ml' WHEN 4 THEN '' ELSE '1/2tablets' END AS doses, true AS bears_dose, false AS unreadable FROM (SELECT *, c_custkey % 1000 AS n, c_custkey % 6 AS f FROM customer)"""


FORMULAS = [r"\left( x^{2} + 1 \right)", r"\dfrac{a}{b} \cdot c", r"\alpha b \leq 3", r"x - y = 0", r"\frac{a}{b} \times c", r"5 + 1"]
_FPOOL = "[" + ", ".join("'" + x + "'" for x in FORMULAS) + "]"


def _pick(pool, n):
    return F.element_at(F.array(*map(F.lit, pool)), (n % len(pool) + 1).cast("int"))


#: Nested, cut short or oddly spelled formulas with their canonical and shown forms.
NESTED = [
    (r"\sqrt{\frac{a^{2}}{b_{12}}}", r"\sqrt{\frac{a^2}{b_{12}}}", r"\sqrt{\frac{a^2}{b_{12}}}"), (r"{{x}} + {y^{{2}}}", "x+y^2", "x + y^2"), (r"\frac{1}{\frac{2}{\frac{3}{x", r"\frac{1}{\frac{2}{\frac{3}{x}}}", r"\frac{1}{\frac{2}{\frac{3}{x}}}"),
    (r"S o l v e : \begin{array} {l} x \neq 2 \end{arr", r"x\ne2", r"x \ne 2"), (r"<loc_3>\tfrac12 } \cdot \alpha b", r"\frac{1}{2}\times\alphab", r"\frac{1}{2} \times \alpha b"),
]


def _latex(s, d):
    k = F.col("c_custkey")
    text = F.when(k % 2 == 0, _pick(FORMULAS, F.floor(k / 2))).otherwise(_pick([n for n, *_ in NESTED], F.floor(k / 2)))
    return table(s, d, "customer").select("c_custkey", FM.normalise_latex(text).alias("normalised"), F.when(k % 2 == 1, FM.show_latex(text)).alias("shown"))


def _latex_sql(x: str) -> str:
    """Canonical form of formulas without nesting."""
    t = x
    for pattern, plain in [(r"\\(left|right)\b", ""), (r"\\dfrac", r"\\frac"), (r"\\cdot\b", r"\\times"), (r"\\leq\b", r"\\le"), (r"([_^])\{([A-Za-z0-9])\}", r"\1\2"), (r"\s+", "")]:
        t = f"regexp_replace({t}, '{pattern}', '{plain}', 'g')"
    return t


def _doctags(s, d):
    k = F.col("c_custkey")
    text = F.concat(F.lit("<text><loc_1><loc_22>"), F.col("c_name"), F.lit("</text><formula><loc_3>"), _pick(FORMULAS, k), F.lit("</formula>"), F.when(k % 3 == 0, r"<text>see \pi here</text>").otherwise(""))
    t = table(s, d, "customer").select("c_custkey", F.posexplode(FM.doctags(text)).alias("pos", "b"))
    return t.select("c_custkey", "pos", "b.kind", "b.content")


def _calc(s, d):
    """Forms of arithmetic over each customer's numbers and balance: sums, powers, signs, calls, halves, degrees, leading zeros, and what has no value."""
    k = F.col("c_custkey")
    x, y, z = (k % 9).cast("string"), (k % 4).cast("string"), F.format_string("%.2f", "c_acctbal")
    forms = [(x, " + ", y, " * 2"), ("-2^", y), (x, " / ", y), ("sqrt(", x, " * ", x, ") - (1 - 3)"), (x, " +* 2"), ("  ",), ("round(", z, ") + round(-", y, ".5)"), ("abs(", z, ") * 00", x), (x, " deg * 180 / pi"), (x, ",000"), (x, "e3"), ("2**", y), ("0x1", x), (x, "_000"), (x, " # note"), ("ln(", y, ")"),
             ("cosine(", y, ")"), (z, " - -", z), ("2^-", y, "^2"), ("(" * 12, x, ")" * 12), ("(" * 32, x, ")" * 32), (x, "^", y, "^2")]
    text = F.element_at(F.array(*[F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in f]) for f in forms]), (k % len(forms) + 1).cast("int"))
    return table(s, d, "customer").select("c_custkey", calc(text).alias("r")).select("c_custkey", F.round("r.value", 9).alias("value"), "r.error")


def _align(s, d):
    return table(s, d, "part").select("p_partkey", L.aligned("p_type", F.concat("p_brand", F.substring("p_type", 3, 9))).alias("a")).select("p_partkey", "a.distance", (F.size("a.substituted") <= F.col("a.distance")).alias("fits"))


def _tokens(s, d):
    k = F.col("event_id")
    lp = F.when(k % 11 == 0, 0.5).when(k % 13 == 0, None).otherwise(-F.col("value") / 1000)
    return table(s, d, "events").select("user_id", F.when(k % 5 == 0, "+").otherwise("x").alias("piece"), lp.alias("logprob"))


def _assess(s, d):
    k = F.col("event_id")
    b = table(s, d, "events").select(F.floor(k / 3).alias("image"), F.when(k % 4 == 0, "text").otherwise("latex").alias("kind"), (1 - F.col("value") / 2000).alias("confidence"), F.when(k % 5 == 0, 0.9).otherwise(0.99).alias("least_operator"), (k % 17 != 0).alias("valid"), (k % 19 == 0).alias("truncated"))
    return S.assess(b, "image")


def _items(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("item"), F.when(F.col("c_custkey") % 7 != 0, _pick(FORMULAS, F.col("c_custkey"))).alias("expected"))


def _records(s, d):
    """Three repeats; every 20th item lacks the second, every 30th has the first twice."""
    k = F.col("c_custkey")
    verdict = F.when(k % 7 == 0, F.when(k % 2 == 0, "refuse").otherwise("accept")).when(k % 11 == 0, "refuse").when(k % 3 == 0, "review").otherwise("accept")
    r = table(s, d, "customer").select(k.alias("item"), F.explode(F.concat(F.sequence(F.lit(0), F.lit(2)), F.when(k % 30 == 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")))).alias("rep"), verdict.alias("verdict"))
    return r.where("not (item % 20 = 0 and rep = 1)").withColumn("got", F.when(F.col("item") % 4 == 0, F.replace(_pick(FORMULAS, F.col("item")), F.lit("+"), F.lit("-"))).otherwise(_pick(FORMULAS, F.col("item"))))


def _scored(s, d):
    return S.score_items(S.items_records(_items(s, d), _records(s, d))[0])


def _pairs(s, d):
    k = F.col("c_custkey")
    p = table(s, d, "customer").select("c_nationkey", F.when(k % 3 == 0, "PASS").when(k % 3 == 1, "FAIL").otherwise("UNDECIDED").alias("outcome"), F.when(k % 5 == 0, "?").alias("question"))
    return S.pair_summary(p, "c_nationkey")


PROBES = ["fakes", "sums", "concession", "medical"]


def _probes(s, d):
    k = F.col("c_custkey")
    p = table(s, d, "customer").where("c_custkey % 9 < 6").select("c_nationkey", _pick(PROBES + ["other"], k).alias("probe"), F.when(k % 8 == 0, "FAIL").when(k % 8 == 1, "UNDECIDED").otherwise("PASS").alias("outcome"))
    return S.probe_verdicts(p, "c_nationkey", PROBES)


def _replies(s, d, **cols):
    return RP.replies(s, d).select("reply_id", *[c.alias(k) for k, c in cols.items()])


def _citations(s, d):
    numbers, bad = T.citations_in(F.concat("text", F.when(F.col("reply_id") % 3 == 0, " [see 4]").otherwise(" [12,3]")))
    return _replies(s, d, cited=F.array_join(numbers.cast("array<string>"), ","), malformed=bad)


def _sentences(column):
    return lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(L.split_sentences(F.concat(F.lit("Dr. No saw fig. 3 of the U.S. plan, e.g. this. "), F.coalesce("text", F.lit(""))))).alias("pos", "sentence"))


def _guard_sentences(s, d):
    t = F.concat(F.lit("# Head\n- one item. two\n2. second item\nwrapped\nline no. 5 ends. "), F.col("text"))
    return _replies(s, d, x=L.split_lines_and_sentences(t)).select("reply_id", F.posexplode("x").alias("pos", "sentence"))


def _vocabulary(s, d) -> list[str]:
    """A vocabulary of the benchmark's letters: what words start with, up to three letters, and what goes on inside them, up to two. It has some 19,000 pieces at most, whatever the table's size."""
    w = table(s, d, "benchmark").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)))).alias("w")).distinct()
    starts = F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda k: F.substr("w", F.lit(1), k))
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.length("w"))), lambda i: F.transform(F.array(F.lit(1), F.lit(2)), lambda k: F.concat(F.lit("##"), F.substr("w", i, k)))))
    found = w.select(F.explode(F.array_union(starts, inside)).alias("p")).where("p <> '##'").distinct().collect()
    return [*CONTROL, *sorted(r["p"] for r in found)]


QUERIES = {
    "fn_population_tail": lambda s, d: _part_names(s, d).select("p_partkey", T.population_tail(F.col("name")).alias("scope")),
    "fn_strip_parens": lambda s, d: _part_names(s, d).select("p_partkey", T.strip_parens(F.col("name")).alias("bare"), F.array_join(T.parens(F.col("name")), "|").alias("inside")),
    "fn_core_name": lambda s, d: _part_names(s, d).select("p_partkey", T.core_name(F.col("name"), FORMS).alias("core")),
    "fn_py_norm": _titles,
    "fn_collapse_ws": lambda s, d: table(s, d, "documents").select("doc_id", F.sha2(T.collapse_ws(F.coalesce("text", F.lit(""))), 256).alias("sha")),
    "fn_safe_query": lambda s, d: table(s, d, "benchmark").select("item_id", T.safe_query(F.concat(F.lit('the "quoted"  '), "text")).alias("query")),
    "fn_split_reasoning": _thinking,
    "fn_tool_calls": _calls,
    "fn_sanitize": _clean,
    "fn_count_words": lambda s, d: table(s, d, "documents").select("doc_id", T.count_words(F.col("text")).alias("tokens")),
    "fn_wordpiece_count": lambda s, d: table(s, d, "documents").select("doc_id", WordPieces(_vocabulary(s, d)).count(F.coalesce("text", F.lit(""))).alias("tokens")),
    "fn_citations_in": _citations,
    "fn_normalise_dose": lambda s, d: _doses(s, d).select("c_custkey", "r.normalised"),
    "fn_dose_tokens": lambda s, d: _doses(s, d).select("c_custkey", F.array_join("r.tokens", "|").alias("doses"), "r.bears_dose", "r.unreadable"),
    "fn_dose_texts": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", D.read_doses(F.col("text")).alias("r")).select("conv_id", "turn", F.sha2("r.normalised", 256).alias("sha"), F.size("r.tokens").alias("tokens"), "r.bears_dose", "r.unreadable"),
    "fn_latex_normalise": _latex,
    "fn_doctags": _doctags,
    "fn_calc": _calc,
    "fn_levenshtein_align": _align,
    "fn_confidence": lambda s, d: S.confidences(_tokens(s, d), ["user_id"]),
    "fn_split_sentences": _sentences("text"),
    "fn_split_sentences_guard": _guard_sentences,
    "assess_transcription": _assess,
    "join_items_records": lambda s, d: S.items_records(_items(s, d), _records(s, d))[1],
    "score_item": lambda s, d: _scored(s, d).select("item", "exact", "cer", "verdict_ok"),
    "score_item_weights": lambda s, d: _scored(s, d).select("item", "weighted"),
    "agg_score_run": lambda s, d: S.score_run(_scored(s, d).withColumn("run", F.col("item") % 6), "run"),
    "agg_pair_summary": _pairs,
    "agg_probe_verdict": _probes,
}

_CUT = "chr(64977)"


def _sent_sql(x: str) -> str:
    kept = rf"regexp_replace({x}, '(?i)(^|[^\p{{L}}\p{{N}}])({'|'.join(L.ABBREVIATIONS)})\.', '\1\2' || chr(64976), 'g')"
    kept = rf"regexp_replace({kept}, '(^|[^\p{{L}}\p{{N}}.])((?:[\p{{L}}\p{{N}}]\.)+[\p{{L}}\p{{N}}])\.', '\1\2' || chr(64976), 'g')"
    cut = rf"string_split(regexp_replace({kept}, '([.?!])\s+', '\1' || {_CUT}, 'g'), {_CUT})"
    return f"list_filter(list_transform({cut}, lambda s: trim(replace(s, chr(64976), '.'))), lambda s: s <> '')"


_F = f"{_FPOOL}[(c_custkey % {len(FORMULAS)} + 1)::INTEGER]"
_IT = f"""it AS (SELECT c_custkey AS item, CASE WHEN c_custkey % 7 <> 0 THEN {_latex_sql(_F)} END AS e, {_latex_sql(f"CASE WHEN c_custkey % 4 = 0 THEN replace({_F}, '+', '-') ELSE {_F} END")} AS g,
CASE WHEN c_custkey % 7 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'refuse' ELSE 'accept' END WHEN c_custkey % 11 = 0 THEN 'refuse' WHEN c_custkey % 3 = 0 THEN 'review' ELSE 'accept' END AS v FROM customer),
sc AS (SELECT item, CASE WHEN e IS NULL THEN v = 'refuse' ELSE e = g END AS exact, round(CASE WHEN e IS NULL THEN CASE WHEN v = 'refuse' THEN 0.0 ELSE 1.0 END ELSE levenshtein(e, g) / length(e) END, 6)::DOUBLE AS cer, CASE WHEN e IS NULL THEN v = 'refuse' ELSE v <> 'refuse' END AS verdict_ok, e IS NULL AS refusal FROM it)"""
ORACLE_SQL = {
    "fn_population_tail": f"""SELECT p_partkey, coalesce(nullif(regexp_extract(n, ' (?:in|during) ({_GROUPS})$', 1), ''), nullif(regexp_extract(n, '^.*? for ({_GROUPS})(?: |$)', 1), '')) AS scope FROM (SELECT p_partkey, {norm_sql(_BARE)} AS n FROM ({_NAMES}))""",
    "fn_strip_parens": rf"SELECT p_partkey, {_BARE} AS bare, array_to_string(list_transform(regexp_extract_all(name, '\(([^)]*)\)', 1), lambda x: trim(x)), '|') AS inside FROM ({_NAMES})",
    "fn_core_name": f"SELECT p_partkey, regexp_replace(regexp_replace({norm_sql(_BARE)}, '(?: (?:{'|'.join(FORMS)}))+$', ''), ' (?:in|during|for) (?:{_GROUPS})$', '') AS core FROM ({_NAMES})",
    "fn_py_norm": rf"SELECT doc_id, trim(regexp_replace(c, '[^a-z0-9]+', ' ', 'g')) AS key, regexp_matches(regexp_replace(c, '[\x00-\x7F]', '', 'g'), '[\p{{L}}\p{{N}}]') AS odd FROM (SELECT doc_id, regexp_replace({_FOLDED}, '[''’‘ʼ]', '', 'g') AS c FROM (SELECT doc_id, substr(coalesce(text, ''), 1, 80) AS t FROM documents))",
    "fn_collapse_ws": r"SELECT doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '[\s\p{Z}\x{85}\x0B]+', ' ', 'g'))) AS sha FROM documents",
    "fn_safe_query": r"""SELECT item_id, array_to_string(list_transform(list_filter(string_split(trim(regexp_replace('the "quoted"  ' || text, '[\s\p{Z}\x{85}]+', ' ', 'g')), ' '), lambda w: w <> ''), lambda w: '"' || replace(w, '"', '""') || '"'), ' ') AS query FROM benchmark""",
    "fn_split_reasoning": """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'a b' WHEN 1 THEN '' WHEN 2 THEN 'only' ELSE 'open' END AS reasoning, CASE WHEN turn % 4 = 2 THEN '' ELSE trim(t) END AS reply,
CASE turn % 4 WHEN 3 THEN 'truncated' WHEN 2 THEN 'thinking_only' ELSE CASE WHEN trim(t) <> '' THEN 'ok' WHEN turn % 4 = 0 THEN 'thinking_only' ELSE 'empty' END END AS state FROM (SELECT *, substr(coalesce(text, ''), 1, 30) AS t FROM conversations)""",
    "fn_tool_calls": """WITH t AS (SELECT conv_id, turn, turn % 8 AS f, '{"said":' || to_json(text)::VARCHAR || '}' AS said FROM conversations)
SELECT conv_id, turn, 'call_' || i AS id, name, CASE WHEN name = 'g' THEN '{}' ELSE said END AS arguments FROM t JOIN (VALUES (0, 0, 'a'), (0, 1, 'b'), (2, 0, 'd'), (4, 0, 'f'), (5, 0, 'g'), (6, 0, 'h')) n(f, i, name) USING (f)""",
    "fn_sanitize": f"SELECT c_custkey, CASE WHEN regexp_full_match(r, '[A-Za-z0-9_-]+') THEN r END AS segment, CASE WHEN regexp_full_match(r, '[A-Za-z0-9_-][A-Za-z0-9._-]{{0,127}}') THEN r END AS pack_id, lower(trim(' ' || r || '@X.org ')) AS email FROM (SELECT *, {_RAW} AS r FROM customer)",
    "fn_count_words": r"SELECT doc_id, len(list_filter(string_split(regexp_replace(coalesce(text, ''), '[\s\p{Z}\x{85}\x0B]+', ' ', 'g'), ' '), lambda w: w <> ''))::INTEGER AS tokens FROM documents",
    "fn_wordpiece_count": r"""WITH RECURSIVE bw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark),
st AS (SELECT DISTINCT substr(w, 1, k) AS p FROM bw, (SELECT unnest([1, 2, 3]) AS k) WHERE k <= length(w)), ct AS (SELECT DISTINCT substr(w, i, k) AS p FROM (SELECT w, unnest(range(2, length(w) + 1)) AS i FROM bw), (SELECT unnest([1, 2]) AS k) WHERE i + k - 1 <= length(w)),
dw AS (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[!-/:-@\[-`{-~]|\p{P}|[^\s\p{Z}!-/:-@\[-`{-~\p{P}]+')) AS w FROM documents),
m AS (SELECT DISTINCT w, 1::BIGINT AS pos, 0 AS n FROM dw
  UNION ALL SELECT w, pos + k, n + 1 FROM (SELECT w, pos, n, CASE WHEN pos = 1 THEN CASE WHEN length(w) >= 3 AND substr(w, 1, 3) IN (SELECT p FROM st) THEN 3 WHEN length(w) >= 2 AND substr(w, 1, 2) IN (SELECT p FROM st) THEN 2 WHEN substr(w, 1, 1) IN (SELECT p FROM st) THEN 1 END
    WHEN pos < length(w) AND substr(w, pos, 2) IN (SELECT p FROM ct) THEN 2 WHEN substr(w, pos, 1) IN (SELECT p FROM ct) THEN 1 END AS k FROM m WHERE pos <= length(w)) WHERE k IS NOT NULL),
c AS (SELECT w, coalesce(max(n) FILTER (WHERE pos > length(w)), 1) AS n FROM m GROUP BY w)
SELECT doc_id, (coalesce(sum(n), 0) + 2)::INTEGER AS tokens FROM documents LEFT JOIN dw USING (doc_id) LEFT JOIN c USING (w) GROUP BY doc_id""",
    "fn_citations_in": rf"""WITH b AS (SELECT reply_id, regexp_extract_all(text || CASE WHEN reply_id % 3 = 0 THEN ' [see 4]' ELSE ' [12,3]' END, '\[([^\]\n]*)\]', 1) AS l FROM ({RP._REPLIES}))
SELECT reply_id, array_to_string(list_transform(flatten(list_transform(list_filter(l, lambda x: regexp_matches(x, '^\s*\d+\s*(,\s*\d+\s*)*$')), lambda x: string_split(x, ','))), lambda x: trim(x)), ',') AS cited, len(list_filter(l, lambda x: regexp_matches(x, '\d') AND NOT regexp_matches(x, '^\s*\d+\s*(,\s*\d+\s*)*$'))) > 0 AS malformed FROM b""",
    "fn_normalise_dose": f"SELECT c_custkey, normalised FROM ({_DOSED})",
    "fn_dose_tokens": f"SELECT c_custkey, doses, bears_dose, unreadable FROM ({_DOSED})",
    "fn_latex_normalise": f"""WITH n(i, normalised, shown) AS (VALUES {", ".join(f"({i}, '{a}', '{b}')" for i, (_, a, b) in enumerate(NESTED))})
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN {_latex_sql(f"{_FPOOL}[(c_custkey // 2 % {len(FORMULAS)} + 1)::INTEGER]")} ELSE n.normalised END AS normalised, CASE WHEN c_custkey % 2 = 1 THEN n.shown END AS shown FROM customer JOIN n ON n.i = c_custkey // 2 % {len(NESTED)}""",
    "fn_doctags": rf"SELECT c_custkey, 0 AS pos, 'text' AS kind, trim(c_name) AS content FROM customer UNION ALL SELECT c_custkey, 1, 'latex', trim({_F}) FROM customer UNION ALL SELECT c_custkey, 2, 'latex', 'see \pi here' FROM customer WHERE c_custkey % 3 = 0",
    "fn_calc": """SELECT c_custkey, round(CASE f WHEN 0 THEN x + y * 2 WHEN 1 THEN -(2 ** y) WHEN 2 THEN CASE WHEN y > 0 THEN x / y END WHEN 3 THEN x + 2 WHEN 6 THEN round(z) - (y + 1) WHEN 7 THEN abs(z) * x WHEN 8 THEN x WHEN 15 THEN CASE WHEN y > 0 THEN ln(y) END WHEN 17 THEN z + z
  WHEN 18 THEN 2 ** -(y ** 2) WHEN 19 THEN x WHEN 21 THEN x ** (y ** 2) END::DOUBLE, 9) AS value,
  CASE WHEN f = 2 AND y = 0 THEN 'division' WHEN f = 5 THEN 'empty' WHEN f = 9 THEN 'thousands' WHEN f = 15 AND y = 0 THEN 'domain' WHEN f = 16 THEN 'name' WHEN f = 20 THEN 'depth' WHEN f = 17 AND z < 0 THEN NULL WHEN f IN (4, 10, 11, 12, 13, 14) THEN 'syntax' END AS error
FROM (SELECT c_custkey, c_custkey % 22 AS f, (c_custkey % 9)::DOUBLE AS x, (c_custkey % 4)::DOUBLE AS y, printf('%.2f', c_acctbal)::DOUBLE AS z FROM customer)""",
    "fn_levenshtein_align": "SELECT p_partkey, levenshtein(p_type, p_brand || substr(p_type, 3, 9))::INTEGER AS distance, true AS fits FROM part",
    "fn_confidence": """SELECT user_id, round(coalesce(exp(avg(lp)), 0), 6) AS confidence, round(min(CASE WHEN event_id % 5 = 0 THEN exp(lp) END), 6) AS least_operator FROM (SELECT *, CASE WHEN event_id % 11 <> 0 AND event_id % 13 <> 0 AND value >= 0 THEN -value / 1000 END AS lp FROM events) GROUP BY user_id""",
    "fn_split_sentences": f"SELECT doc_id, unnest(range(len(l)))::INTEGER AS pos, unnest(l) AS sentence FROM (SELECT doc_id, {_sent_sql("'Dr. No saw fig. 3 of the U.S. plan, e.g. this. ' || coalesce(text, '')")} AS l FROM documents)",
    "assess_transcription": """WITH b AS (SELECT event_id // 3 AS image, event_id % 4 <> 0 AS latex, 1 - value / 2000 AS c, CASE WHEN event_id % 5 = 0 THEN 0.9 ELSE 0.99 END AS o, event_id % 17 = 0 AS bad, event_id % 19 = 0 AS cut FROM events),
g AS (SELECT image, count(*) FILTER (latex) AS n, bool_or(latex AND c < 0.7) AS low, bool_or(latex AND c < 0.9) AS unsure, bool_or(latex AND o < 0.97) AS op, bool_or(bad) AS bad, bool_or(cut) AS cut FROM b GROUP BY image),
w AS (SELECT *, concat_ws('|', CASE WHEN bad THEN 'invalid' END, CASE WHEN unsure THEN 'low confidence' END, CASE WHEN n = 0 THEN 'no formula' END, CASE WHEN op THEN 'operator' END, CASE WHEN cut THEN 'truncated' END) AS warnings FROM g)
SELECT image, CASE WHEN n = 0 OR low THEN 'refuse' WHEN warnings <> '' THEN 'review' ELSE 'accept' END AS verdict, warnings FROM w""",
    "join_items_records": "SELECT c_custkey AS item, 1 AS rep, 'missing' AS problem FROM customer WHERE c_custkey % 20 = 0 UNION ALL SELECT c_custkey, 0, 'duplicate' FROM customer WHERE c_custkey % 30 = 0",
    "score_item": f"WITH {_IT} SELECT item, exact, cer, verdict_ok FROM sc",
    "agg_score_run": f"WITH {_IT} SELECT item % 6 AS run, count(*) AS total, count(*) FILTER (exact) AS exact, count(*) FILTER (refusal AND verdict_ok) AS refusals_ok, round(avg(cer), 6) AS mean_cer, count(*) FILTER (exact) >= ceil(count(*) * 0.9) AND count(*) FILTER (refusal AND verdict_ok) = count(*) FILTER (refusal) AS passed FROM sc GROUP BY 1",
    "agg_pair_summary": "SELECT c_nationkey, count(*) FILTER (c_custkey % 3 = 0) AS passed, count(*) FILTER (c_custkey % 3 = 1) AS failed, count(*) FILTER (c_custkey % 3 = 2) AS undecided, count(*) FILTER (c_custkey % 5 = 0) AS awaiting, count(*) AS total FROM customer GROUP BY 1",
    "agg_probe_verdict": """WITH p AS (SELECT c_nationkey, c_custkey % 5 AS probe, bool_or(c_custkey % 8 = 0) AS f, bool_and(c_custkey % 8 > 1) AS p FROM customer WHERE c_custkey % 9 < 6 AND c_custkey % 5 < 4 GROUP BY ALL)
SELECT c_nationkey, count(*) FILTER (p) AS passed, count(*) FILTER (f) AS failed, 4 - count(*) FILTER (p) - count(*) FILTER (f) AS undecided FROM p GROUP BY 1""",
}
