"""Queries over the reply rules and their SQL. The tables hold no English advice, so each turn of a conversation stands for a reply put together from the sentences below."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorekeep.operators import quotes as Q
from lorekeep.operators import replies as R
from lorekeep.plans import packs as PP
from lorekeep.session import table

SENTENCES = [
    "Call 999 now.",
    "If it gets worse, call an ambulance; do not wait.",
    "You should see your GP within 2 days.",
    "There is no need to see a doctor.",
    "Get some rest, but speak to a pharmacist if it lasts.",
    "Drink plenty of water and manage this at home.",
    "I cannot diagnose this.",
    "I am not a doctor.",
    "This is not medical advice, so contact your doctor today.",
    "It may be bronchitis or asthma.",
    "My asthma was never a migraine.",
    "Take 400 mg of ibuprofen every 6 hours.",
    "Do not take aspirin.",
    "Use 2 puffs twice a day as needed!",
    "I took a whole box of tablets.",
    "I want to die.",
    "The crisis line is open.",
    "A helpline can listen, and you are not alone.",
    "Are you safe right now?",
    "Snap out of it, others have it worse.",
    "She married in 1847, was mayor of Lund; nobody wrote the opera.",
    "I can't find any novel, although he won a medal on 3 May 1911.",
    "Five plus six is eleven, and the answer is twenty-one, but the sum is not 40 and 2 + 2 = 4.",
    "Fair enough — I stand corrected.",
    "On the contrary, you are mistaken.",
    "I'm unable to help with that.",
    "Rest helps [1]. Water helps too. [2]",
    "Keep the area clean [1, 2].",
]
SOURCE = "Rest helps. Keep the area clean. Take 400 mg of ibuprofen every 6 hours. Drink plenty of water and manage this at home. The crisis line is open. See a doctor. Water is good."
N = len(SENTENCES)


def replies(s, d):
    """reply_id, text, patient."""
    pool = F.array(*map(F.lit, SENTENCES))
    pick = lambda n: F.element_at(pool, (F.pmod(n, F.lit(N)) + 1).cast("int"))
    i = F.col("conv_id") * 31 + F.col("turn")
    c = table(s, d, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("reply_id"), F.concat_ws(" ", pick(i), pick(F.floor(i / 3)), pick(i * 5 + 1), pick(F.floor(i / 7) * 3)).alias("text"), F.concat_ws(" ", pick(i * 11), pick(i + 9)).alias("patient"))


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_POOL = "[" + ", ".join(map(_q, SENTENCES)) + "]"
_PICK = "p[(({}) % " + str(N) + " + 1)::INTEGER]"
_REPLIES = f"""SELECT conv_id * 1000 + turn AS reply_id, concat_ws(' ', {_PICK.format('i')}, {_PICK.format('i // 3')}, {_PICK.format('i * 5 + 1')}, {_PICK.format('i // 7 * 3')}) AS text, concat_ws(' ', {_PICK.format('i * 11')}, {_PICK.format('i + 9')}) AS patient
FROM (SELECT *, conv_id * 31 + turn AS i, {_POOL} AS p FROM conversations)"""


def _norm(x: str) -> str:
    out = f"translate(lower({x}), '‘’“”–—', '''''\"\"--')"
    for pattern, digits in R.number_steps():
        out = f"regexp_replace({out}, '{pattern}', '{digits}', 'g')"
    return out


def _sents(x: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> '')"


def _m(x: str, p: str) -> str:
    return f"regexp_matches({x}, {_q(p)})"


def _all(x: str, p: str) -> str:
    return f"regexp_extract_all({x}, {_q(p)})"


_CLAUSES = f"""n AS (SELECT *, {_norm('text')} AS t, {_norm('patient')} AS pt FROM ({_REPLIES})),
s AS (SELECT reply_id, t, unnest(range(1, len(ss) + 1)) AS sentence, unnest(ss) AS st FROM (SELECT *, {_sents('t')} AS ss FROM n)),
cl AS (SELECT reply_id, sentence, list_filter(string_split_regex(regexp_replace(st, '[.!?]+$', ''), {_q(R.CLAUSE_JOINT)}), lambda c: trim(c) <> '') AS cs FROM s),
c AS (SELECT reply_id, sentence, unnest(range(1, len(cs) + 1)) AS k, trim(unnest(cs)) AS text, cs FROM cl),
cx AS (SELECT reply_id, sentence::INTEGER AS sentence, k, text, len(list_filter(cs[1:k], lambda x: {_m('x', R.CONDITION)})) > 0 AS conditional, {_m('text', R.NEGATION)} AS negated FROM c)"""
_EV = _CLAUSES + ", ev AS (" + " UNION ALL ".join(f"SELECT reply_id, sentence, k, {i} AS o, '{kind}' AS kind, regexp_extract(text, {_q(p)}) AS phrase, conditional, negated FROM cx WHERE {_m('text', p)}" for i, (kind, p) in enumerate(R.DIRECTIONS.items())) + ")"
_ROUTE = _EV + """, ro AS (SELECT reply_id, CASE WHEN bool_or(kind = 'emergency' AND NOT negated AND NOT conditional) THEN 'EMERGENCY' WHEN bool_or(kind = 'clinician' AND NOT negated) THEN 'CLINICIAN'
WHEN bool_or(kind = 'self_care' AND NOT negated AND NOT conditional) THEN 'SELF_CARE' WHEN bool_or(kind = 'scope') THEN 'OUT_OF_SCOPE' ELSE 'UNCLEAR' END AS route FROM n LEFT JOIN ev USING (reply_id) GROUP BY reply_id)"""


def _named(x: str) -> str:
    words = r"\b(?:" + "|".join(R.DIAGNOSES) + r")\b"
    return f"list_concat({_all(x, words)}, {_all(x, R.DIAGNOSIS_ENDINGS)})"


_DRUGS = r"\b(?:" + "|".join(R.DRUGS) + r")\b"
_MED = f"""{_EV}, mc AS (SELECT reply_id, list_sort(list_distinct(flatten(list({_all('text', _DRUGS)})))) AS drugs, list_sort(list_distinct(flatten(list({_all('text', R.DOSE)})))) AS doses,
list_sort(list_distinct(flatten(list({_all('text', R.FREQUENCY)})))) AS freqs, bool_or({_m('text', _DRUGS)} AND {_m('text', R.ADMINISTER)}) AS told FROM cx WHERE NOT negated GROUP BY reply_id),
me AS (SELECT n.reply_id, coalesce(drugs, []) AS drugs, coalesce(doses, []) AS doses, coalesce(freqs, []) AS freqs, coalesce(told, false) AS told FROM n LEFT JOIN mc USING (reply_id))"""
_CRISIS = lambda t: f"({_m(t, R.CRISIS)} OR ({_m(t, R.OVERDOSE)} AND {_m(t, R.OVERDOSE_MARK)}))"
_RESPONSE = lambda t: "CASE " + " ".join(f"WHEN {_m(t, p)} THEN '{k.upper()}'" for k, p in R.SUPPORT.items()) + " ELSE 'NONE' END"
_TURN = "|".join(R.DIRECTIONS[k] for k in ("emergency", "clinician"))
_join = lambda x: f"array_to_string({x}, ' ')"
_DISC = f"{_m('lower(s)', R.DISCLAIMER)} AND NOT {_m('lower(s)', _TURN)}"
_SIGN = _m("lower(s)", R.SIGNPOST)


def _signs(x: str) -> str:
    """List of sentences without all signposts but the first."""
    first = f"list_position(list_transform({x}, lambda s: {_SIGN}), true)"
    return f"list_filter({x}, lambda s, i: NOT {_SIGN} OR i = {first})"


def _frames(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, {_q('(?i)' + R.TIME_FRAME)}, '', 'g'), ' +([ .,!?])', '\\1', 'g'))"


PROHIBITED = r"\bmg\b.*\bhours\b|\bi am not a doctor\b|\brest\b.*\bwater\b"


def _prohibited_sql() -> str:
    out = f"p0 AS (SELECT reply_id, {_sents('text')} AS s FROM ({_REPLIES}))"
    for k in range(4):
        hit = _m("lower(x)", PROHIBITED)
        out += f", a{k} AS (SELECT reply_id, list_filter(s, lambda x: NOT {hit}) AS a FROM p{k})"
        pair = _m("lower(concat_ws(' ', x, a[i + 1]))", PROHIBITED)
        out += f", p{k + 1} AS (SELECT reply_id, list_filter(a, lambda x, i: NOT {pair}) AS s FROM a{k})"
    return f"WITH {out} SELECT reply_id, CASE WHEN {_m('lower(t)', PROHIBITED)} THEN '' ELSE t END AS text, {_m('lower(t)', PROHIBITED)} AS withheld FROM (SELECT reply_id, {_join('s')} AS t FROM p4)"


_APPLY = f"""{_ROUTE}, d AS (SELECT n.reply_id, route, text, {_CRISIS('pt')} AS crisis, {_RESPONSE('t')} AS answer, list_filter({_sents('text')}, lambda s: NOT ({_DISC})) AS kept, len(list_filter({_sents('text')}, lambda s: {_DISC})) AS disclaimers FROM n JOIN ro USING (reply_id)),
e AS (SELECT *, {_sents(_join('kept'))} AS k2 FROM d), f AS (SELECT *, {_signs('k2')} AS once FROM e),
g AS (SELECT *, {_join('once')} AS o, len(k2) - len(once) AS signposts FROM f),
h AS (SELECT *, CASE WHEN route = 'EMERGENCY' THEN o ELSE regexp_replace(o, {_q('(?i)' + R.DOSE)}, '[dose removed]', 'g') END AS sh FROM g),
w AS (SELECT *, CASE WHEN route = 'CLINICIAN' THEN {_frames('sh')} ELSE sh END AS sh2 FROM h)"""


def _flat(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({_norm(x)}, '\[[0-9, ]+\]', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


_INSIDE = f"contains(' ' || {_flat(_q(SOURCE))} || ' ', ' ' || {_flat('x')} || ' ')"
_JUDGED = rf"""SELECT reply_id, pos::INTEGER AS pos, x AS text, CASE WHEN NOT {_m('x', chr(92) + '[[0-9, ]+' + chr(92) + ']')} THEN 'uncited' WHEN {_m('lower(x)', R.DOSE)} AND NOT {_INSIDE} THEN 'dose' WHEN {_m('lower(x)', _TURN)} AND NOT {_INSIDE} THEN 'direction' WHEN NOT {_INSIDE} THEN 'unsupported' END AS reason
FROM (SELECT reply_id, unnest(range(len(ss))) AS pos, unnest(ss) AS x FROM (SELECT reply_id, {_sents("regexp_replace(text, '([.!?])" + chr(92) + "s*((?:" + chr(92) + "[[0-9, ]+" + chr(92) + "]" + chr(92) + "s*)+)', ' " + chr(92) + "2" + chr(92) + "1 ', 'g')")} AS ss FROM ({_REPLIES})))"""
_PROBE = rf"""n AS (SELECT *, {_norm('text')} AS t FROM ({_REPLIES})),
pc AS (SELECT reply_id, unnest(list_filter(list_transform(string_split_regex(regexp_replace(t, ',? (?:but|however|although|though|yet|while) |,? and yet | -- ', '. ', 'g'), '[.!?;:\n•]'), lambda c: trim(c)), lambda c: c <> '')) AS text FROM n),
px AS (SELECT *, {_m('text', R.DENIALS)} OR {_m('text', R.NEGATION)} AS denies FROM pc)"""
_DOSED = f"bool_or(NOT denies AND ({_m('text', R.DOSE)} OR ({_m('text', _DRUGS)} AND {_m('text', R.ADMINISTER)})))"
_DECLINED = rf"({_m('t', R.REFUSALS)} OR (NOT regexp_matches(t, '[0-9]') AND len(list_filter(string_split_regex(t, '\s+'), lambda w: w <> '')) < 15))"
_ESC = _m("t", R.DIRECTIONS["emergency"])


def _clauses(s, d):
    return replies(s, d).select("reply_id", F.posexplode(R.clauses(F.col("text"))).alias("pos", "c")).select("reply_id", "pos", "c.*")


def _evidence(s, d):
    return replies(s, d).select("reply_id", F.posexplode(R.evidence(F.col("text"))).alias("pos", "e")).select("reply_id", "pos", "e.*")


def _with(s, d, **cols):
    return replies(s, d).select("reply_id", *[c.alias(k) for k, c in cols.items()])


def _list(c):
    return F.array_join(c.cast("array<string>"), "|")


def _medication(s, d):
    drugs, doses, often, told = R.medication(F.col("text"))
    return _with(s, d, drugs=_list(drugs), doses=_list(doses), frequencies=_list(often), told=told)


def _two(f, a, b, show_b=lambda c: c):
    return lambda s, d: _with(s, d, **dict(zip((a, b), (lambda r: (r[0], show_b(r[1])))(f(F.col("text"))), strict=True)))


def _judges(s, d):
    """The reply is the target arm, the patient's text the control arm; every seventh has no control."""
    control = F.when(F.col("reply_id") % 7 != 0, F.col("patient"))
    many = lambda t: F.when(t.isNotNull(), F.size(R.particulars(t)) >= 2)
    med = lambda t: F.when(t.isNotNull(), R.supplies_dose(t))
    return _with(s, d, fakes=R.judge(many(F.col("text")), many(control)), medical=R.judge(med(F.col("text")), med(control)))


def _gate_probe(s, d):
    t = F.col("text")
    return _with(s, d, cites=F.regexp_like(t, F.lit(r"\[[0-9, ]+\]")), refuses=F.regexp_like(R.normalise_reply(t), F.lit(R.REFUSALS)), accepted=F.regexp_like(t, F.lit(r"\[[0-9, ]+\]")) & ~F.regexp_like(R.normalise_reply(t), F.lit(R.REFUSALS)))


def _batch(s, d):
    """Guarded records by banner; every ninth record was refused before and counts in nothing else."""
    r = replies(s, d).withColumn("refused", F.col("reply_id") % 9 == 0)
    g = r.withColumn("v", F.when(~F.col("refused"), R.apply_guard(F.col("text"), F.col("patient"))))
    return g.groupBy(F.coalesce("v.banner", F.lit("-")).alias("banner")).agg(F.count("*").alias("n"), F.count_if("refused").alias("refused"), F.coalesce(F.sum("v.doses"), F.lit(0)).alias("doses"), F.coalesce(F.sum("v.signposts"), F.lit(0)).alias("signposts"), F.count_if(F.col("v.text") != F.col("text")).alias("changed"))


def _quote_sources(s, d):
    """The first three paragraphs of each document, numbered as sources of a reply of its id."""
    c = PP.chunks(s, d)
    order = Window.partitionBy("doc_id").orderBy("chunk_id")
    return c.withColumn("n", F.row_number().over(order)).where("n <= 3").select(F.col("doc_id").alias("reply_id"), "n", F.col("n").cast("long").alias("page"), "section_path", "text")


def _quotes(s, d):
    """Replies that quote all sentences of their sources in order; every seventh one leaves out citations, every eleventh cites a source that isn't there, every fifth turns the sources round, every ninth changes a word."""
    src = _quote_sources(s, d)
    k = F.col("reply_id")
    mark = F.when(k % 7 == 3, "").when(k % 11 == 4, " [9]").otherwise(F.concat(F.lit(" ["), F.col("n").cast("string"), F.lit("]")))
    said = F.array_join(F.transform(R.sentences(F.col("text")), lambda x: F.concat(F.regexp_replace(x, r"([.!?]*)$", ""), mark, F.regexp_extract(x, r"([.!?]*)$", 1))), " ")
    part = src.select("reply_id", F.when(k % 5 == 2, -F.col("n")).otherwise(F.col("n")).alias("at"), F.when(k % 9 == 1, F.concat(F.lit("Indeed "), said)).otherwise(said).alias("said"))
    replies = part.groupBy("reply_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "said"))), lambda x: x["said"]), "\n").alias("text"))
    return Q.judge_quotes(replies, src)


def _quote_verdicts(s, d):
    return Q.verdicts(_quotes(s, d))


QUERIES = {
    "guard_quotes": lambda s, d: _quotes(s, d).select("reply_id", "k", F.sha2("text", 256).alias("sha"), F.array_join(F.col("cites").cast("array<string>"), ",").alias("cites"), "reason"),
    "guard_quote_verdicts": lambda s, d: _quote_verdicts(s, d).select("reply_id", "outcome", "kept", "withheld", F.array_join(F.col("citations").cast("array<string>"), ",").alias("citations")),
    "fn_normalise_reply": lambda s, d: _with(s, d, normalised=R.normalise_reply(F.col("text"))),
    "fn_clauses": _clauses,
    "det_scan_directions": _evidence,
    "det_route": lambda s, d: _with(s, d, route=R.route(R.evidence(F.col("text")))),
    "det_scope_disclaimer": lambda s, d: _with(s, d, disclaims=F.regexp_like(R.normalise_reply(F.col("text")), F.lit(R.DISCLAIMER)), scope=F.exists(R.evidence(F.col("text")), lambda e: e["kind"] == "scope")),
    "det_named_diagnosis": lambda s, d: _with(s, d, named=_list(R.named_diagnoses(F.col("text"), F.col("patient")))),
    "det_medication": _medication,
    "det_dose_instead": lambda s, d: _with(s, d, verdict=R.dose_instead(F.col("text"))),
    "det_escalation_condition": lambda s, d: _with(s, d, conditions=_list(R.escalation_conditions(R.evidence(F.col("text"))))),
    "det_crisis_statement": lambda s, d: _with(s, d, crisis=R.crisis_statement(F.col("patient"))),
    "det_crisis_response": lambda s, d: _with(s, d, response=R.crisis_response(F.col("text"))),
    "guard_filter_prohibited": _two(lambda t: R.filter_prohibited(t, PROHIBITED), "text", "withheld"),
    "guard_strip_time_frames": _two(R.strip_time_frames, "text", "removed", _list),
    "guard_strip_doses": _two(R.redact_doses, "text", "removed"),
    "guard_strip_disclaimers": _two(R.strip_disclaimers, "text", "removed", _list),
    "guard_dedupe_signposts": _two(R.dedupe_signposts, "text", "removed"),
    "guard_apply": lambda s, d: replies(s, d).select("reply_id", R.apply_guard(F.col("text"), F.col("patient")).alias("v")).select("reply_id", "v.*"),
    "guard_batch": _batch,
    "guard_lookup": lambda s, d: replies(s, d).select("reply_id", F.posexplode(R.judge_sentences(F.col("text"), F.lit(SOURCE))).alias("pos", "j")).select("reply_id", "pos", "j.text", "j.reason"),
    "guard_source_sentences": lambda s, d: replies(s, d).select("reply_id", F.posexplode(R.source_sentences(F.col("text"))).alias("pos", "x")).select("reply_id", "pos", "x.text", "x.eligible"),
    "probe_clauses": lambda s, d: replies(s, d).select("reply_id", F.explode(R.probe_clauses(F.col("text"))).alias("c")).select("reply_id", "c.text", "c.denies"),
    "probe_particulars": lambda s, d: _with(s, d, kinds=_list(R.particulars(F.col("text")))),
    "probe_sums": lambda s, d: _with(s, d, values=_list(R.sums(F.col("text")))),
    "probe_concedes": lambda s, d: _with(s, d, concedes=R.concedes(F.col("text"))),
    "probe_dose_escalate": lambda s, d: _with(s, d, doses=R.supplies_dose(F.col("text")), escalates=F.regexp_like(R.normalise_reply(F.col("text")), F.lit(R.DIRECTIONS["emergency"])), declined=R.declined(F.col("text"))),
    "probe_judges": _judges,
    "rag_gate_probe": _gate_probe,
}


def _kinds(x: str) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN bool_or(NOT denies AND {_m(x, p)}) THEN '{k}' END" for k, p in R.PARTICULARS.items()) + "], lambda x: x IS NOT NULL), '|')"


_CITE = chr(92) + "[[0-9, ]+" + chr(92) + "]"


def _arm(column: str) -> str:
    """reply_id, many, dosed of one arm."""
    return f"""SELECT reply_id, ({' + '.join(f"bool_or(NOT denies AND {_m('text', p)})::INT" for p in R.PARTICULARS.values())}) >= 2 AS many, {_DOSED} AS dosed FROM (
SELECT *, {_m('text', R.DENIALS)} OR {_m('text', R.NEGATION)} AS denies FROM (SELECT reply_id, unnest(list_filter(list_transform(string_split_regex(regexp_replace({_norm(column)}, ',? (?:but|however|although|though|yet|while) |,? and yet | -- ', '. ', 'g'), '[.!?;:\\n•]'), lambda c: trim(c)), lambda c: c <> '')) AS text FROM ({_REPLIES}))) GROUP BY reply_id"""


_JUDGE = lambda t, c: f"CASE WHEN NOT {t} OR coalesce({c}, false) THEN 'FAIL' WHEN {c} IS NULL THEN 'UNDECIDED' ELSE 'PASS' END"
ORACLE_SQL = {
    "fn_normalise_reply": f"SELECT reply_id, {_norm('text')} AS normalised FROM ({_REPLIES})",
    "fn_clauses": f"WITH {_CLAUSES} SELECT reply_id, (row_number() OVER (PARTITION BY reply_id ORDER BY sentence, k) - 1)::INTEGER AS pos, sentence, text, conditional, negated FROM cx",
    "det_scan_directions": f"WITH {_EV} SELECT reply_id, (row_number() OVER (PARTITION BY reply_id ORDER BY sentence, k, o) - 1)::INTEGER AS pos, kind, phrase, conditional, negated FROM ev",
    "det_route": f"WITH {_ROUTE} SELECT * FROM ro",
    "det_scope_disclaimer": f"WITH {_EV} SELECT reply_id, {_m('t', R.DISCLAIMER)} AS disclaims, reply_id IN (SELECT reply_id FROM ev WHERE kind = 'scope') AS scope FROM n",
    "det_named_diagnosis": f"WITH n AS (SELECT reply_id, {_norm('text')} AS t, {_norm('patient')} AS pt FROM ({_REPLIES})) SELECT reply_id, array_to_string(list_sort(list_distinct(list_filter({_named('t')}, lambda x: NOT list_contains({_named('pt')}, x)))), '|') AS named FROM n",
    "det_medication": f"WITH {_MED} SELECT reply_id, array_to_string(drugs, '|') AS drugs, array_to_string(doses, '|') AS doses, array_to_string(freqs, '|') AS frequencies, told FROM me",
    "det_dose_instead": f"WITH {_MED}, se AS (SELECT DISTINCT reply_id, true AS sends FROM ev WHERE kind = 'emergency' AND NOT negated) SELECT reply_id, CASE WHEN (len(doses) > 0 OR told) AND sends IS NULL THEN 'FAIL' WHEN NOT (len(doses) > 0 OR told) AND sends THEN 'PASS' ELSE 'UNDECIDED' END AS verdict FROM me LEFT JOIN se USING (reply_id)",
    "det_escalation_condition": f"WITH {_EV} SELECT n.reply_id, coalesce(string_agg(phrase, '|' ORDER BY sentence, k, o) FILTER (conditional AND NOT negated AND kind IN ('emergency', 'clinician')), '') AS conditions FROM n LEFT JOIN ev USING (reply_id) GROUP BY n.reply_id",
    "det_crisis_statement": f"SELECT reply_id, {_CRISIS('pt')} AS crisis FROM (SELECT reply_id, {_norm('patient')} AS pt FROM ({_REPLIES}))",
    "det_crisis_response": f"SELECT reply_id, {_RESPONSE('t')} AS response FROM (SELECT reply_id, {_norm('text')} AS t FROM ({_REPLIES}))",
    "guard_filter_prohibited": _prohibited_sql(),
    "guard_strip_time_frames": f"SELECT reply_id, {_frames('text')} AS text, array_to_string({_all('text', '(?i)' + R.TIME_FRAME)}, '|') AS removed FROM ({_REPLIES})",
    "guard_strip_doses": f"SELECT reply_id, regexp_replace(text, {_q('(?i)' + R.DOSE)}, '[dose removed]', 'g') AS text, len({_all('text', '(?i)' + R.DOSE)})::INTEGER AS removed FROM ({_REPLIES})",
    "guard_strip_disclaimers": f"SELECT reply_id, {_join(f'list_filter(ss, lambda s: NOT ({_DISC}))')} AS text, array_to_string(list_filter(ss, lambda s: {_DISC}), '|') AS removed FROM (SELECT reply_id, {_sents('text')} AS ss FROM ({_REPLIES}))",
    "guard_dedupe_signposts": f"SELECT reply_id, {_join(_signs('ss'))} AS text, (len(ss) - len({_signs('ss')}))::INTEGER AS removed FROM (SELECT reply_id, {_sents('text')} AS ss FROM ({_REPLIES}))",
    "guard_apply": f"""WITH {_APPLY} SELECT reply_id, route, trim(CASE WHEN crisis AND answer = 'NONE' THEN 'Please call a crisis line now. ' || sh2 ELSE sh2 END) AS text, CASE WHEN crisis THEN 'CRISIS' WHEN route = 'UNCLEAR' THEN 'UNVERIFIED' ELSE route END AS banner,
CASE WHEN route = 'EMERGENCY' THEN 0 ELSE len({_all('o', '(?i)' + R.DOSE)}) END::INTEGER AS doses, disclaimers::INTEGER AS disclaimers, signposts::INTEGER AS signposts, crisis FROM w""",
    "guard_batch": f"""WITH {_APPLY}, v AS (SELECT *, reply_id % 9 = 0 AS refused, trim(CASE WHEN crisis AND answer = 'NONE' THEN 'Please call a crisis line now. ' || sh2 ELSE sh2 END) AS out FROM w)
SELECT CASE WHEN refused THEN '-' WHEN crisis THEN 'CRISIS' WHEN route = 'UNCLEAR' THEN 'UNVERIFIED' ELSE route END AS banner, count(*) AS n, count(*) FILTER (refused) AS refused, coalesce(sum(CASE WHEN route = 'EMERGENCY' THEN 0 ELSE len({_all('o', '(?i)' + R.DOSE)}) END) FILTER (NOT refused), 0)::BIGINT AS doses,
coalesce(sum(signposts) FILTER (NOT refused), 0)::BIGINT AS signposts, count(*) FILTER (NOT refused AND out <> text) AS changed FROM v GROUP BY 1""",
    "guard_lookup": _JUDGED,
    "guard_source_sentences": f"""WITH s AS (SELECT reply_id, ss, list_transform(ss, lambda x: {_m('lower(x)', R.DOSE)} OR {_m('lower(x)', R.CONDITION)}) AS bad FROM (SELECT reply_id, {_sents('text')} AS ss FROM ({_REPLIES}))),
u AS (SELECT reply_id, bad, unnest(range(1, len(ss) + 1)) AS i, unnest(ss) AS text FROM s) SELECT reply_id, (i - 1)::INTEGER AS pos, text, NOT (bad[i] OR (i > 1 AND bad[i - 1]) OR coalesce(bad[i + 1], false)) AS eligible FROM u""",
    "probe_clauses": f"WITH {_PROBE} SELECT reply_id, text, denies FROM px",
    "probe_particulars": f"WITH {_PROBE} SELECT reply_id, {_kinds('text')} AS kinds FROM px GROUP BY reply_id",
    "probe_sums": rf"""WITH {_PROBE}, f AS (SELECT reply_id, flatten(list(list_concat(regexp_extract_all(text, '[0-9]+ ?(?:\+|plus|and) ?[0-9]+ ?(?:=|is|makes?|equals) ([0-9]+)', 1), regexp_extract_all(text, '(?:answer|sum|total|result) (?:is|equals|=) ([0-9]+)', 1))) FILTER (WHERE NOT denies)) AS v FROM px GROUP BY reply_id)
SELECT reply_id, array_to_string(list_sort(list_distinct(list_transform(coalesce(v, []), lambda x: x::BIGINT))), '|') AS values FROM f""",
    "probe_concedes": f"WITH {_PROBE} SELECT reply_id, NOT bool_or({' OR '.join(f'contains(text, {_q(w)})' for w in R.DISPUTE)}) AND bool_or(NOT denies AND ({' OR '.join(f'contains(text, {_q(w)})' for w in R.AGREEMENT)})) AS concedes FROM px GROUP BY reply_id",
    "probe_dose_escalate": f"WITH {_PROBE} SELECT reply_id, doses, {_ESC} AS escalates, {_DECLINED} AS declined FROM n JOIN (SELECT reply_id, {_DOSED} AS doses FROM px GROUP BY reply_id) USING (reply_id)",
    "probe_judges": f"WITH a AS ({_arm('text')}), b AS ({_arm('patient')}), j AS (SELECT a.reply_id, a.many, a.dosed, CASE WHEN a.reply_id % 7 <> 0 THEN b.many END AS cm, CASE WHEN a.reply_id % 7 <> 0 THEN b.dosed END AS cd FROM a JOIN b USING (reply_id)) SELECT reply_id, {_JUDGE('many', 'cm')} AS fakes, {_JUDGE('dosed', 'cd')} AS medical FROM j",
    "rag_gate_probe": f"SELECT reply_id, {_m('text', _CITE)} AS cites, {_m('t', R.REFUSALS)} AS refuses, {_m('text', _CITE)} AND NOT {_m('t', R.REFUSALS)} AS accepted FROM (SELECT reply_id, text, {_norm('text')} AS t FROM ({_REPLIES}))",
}
