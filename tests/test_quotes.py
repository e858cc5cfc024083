"""Ordered quotes: every reason, places that can be several, lists with their lead-in."""

import pytest

from lorekeep.operators import quotes as Q

SOURCES = [(1, 10, "Use", "Rest well. Take 400 mg of it twice a day. Drink water. Rest well."), (2, 11, "Use > More", "Keep warm. Do this:\n- take one tablet\n- sleep\nSee your doctor."), (3, 30, "Overdose", "Take 5 mg."), (4, 40, "Care", "If you take too much, call 999.")]

CASES = {
    "all quotes in order": ("Rest well. [1] Take 400 mg of it twice a day [1]. Drink water [1].", [None, None, None]),
    "goes on in the next chunk": ("Drink water [1]. Rest well [1]. Keep warm [2].", [None, None, None]),
    "the second place of a repeated sentence": ("Rest well [1]. Keep warm [2].", [None, None]),
    "plain talk without quotes": ("This is a remark. And more of it.", [None, None]),
    "malformed": ("Rest well [1-2].", ["citation malformed"]),
    "out of range": ("Rest well [9].", ["citation out of range"]),
    "overdose section": ("Take 5 mg [3].", ["overdose section"]),
    "overdose sentence": ("If you take too much, call 999 [4].", ["overdose sentence"]),
    "unreadable": ("Rest wеll [1].", ["unreadable"]),
    "dose uncited": ("Take 400 mg of it twice a day.", ["dose uncited"]),
    "dose changed": ("Take 500 mg of it twice a day [1].", ["dose not in source"]),
    "route uncited": ("You should see your doctor.", ["route uncited"]),
    "route quoted": ("See your doctor [2].", [None]),
    "not a quote": ("Rest well [1]. Rest very well [1].", [None, "not a quote"]),
    "talk beside quotes": ("Rest well [1]. That helps.", [None, "not a quote"]),
    "order": ("Drink water [1]. Take 400 mg of it twice a day [1].", [None, "order"]),
    "gap": ("Rest well [1]. Drink water [1].", [None, "order"]),
    "lead-in missing": ("take one tablet [2].", ["lead-in"]),
    "lead-in given": ("Do this: [2]\ntake one tablet [2].\nsleep [2].", [None, None, None]),
    "context": ("Take 500 mg of it twice a day [1]. Rest well [1].", ["dose not in source", "context"]),
    "empty": ("", []),
}


def test_every_case(spark):
    names = list(CASES)
    replies = spark.createDataFrame([(i, CASES[n][0]) for i, n in enumerate(names)] + [(99, None)], "reply_id long, text string").repartition(3)
    sources = spark.createDataFrame([(i, *s) for i in range(len(names)) for s in SOURCES], "reply_id long, n int, page int, section_path string, text string")
    judged = Q.judge_quotes(replies, sources)
    got = {}
    for r in judged.orderBy("reply_id", "k").collect():
        got.setdefault(names[r.reply_id], []).append(r.reason)
    assert {n: got.get(n, []) for n in names} == {n: want for n, (_, want) in CASES.items()}
    assert {r for w in (w for _, w in CASES.values()) for r in w if r} == set(Q.REASONS)
    v = {names[r.reply_id]: (r.outcome, r.kept, r.withheld, r.citations) for r in Q.verdicts(judged).collect()}
    assert v["goes on in the next chunk"] == ("grounded", 3, 0, [1, 2]) and v["order"] == ("grounded", 1, 1, [1]) and v["plain talk without quotes"] == ("no_evidence", 2, 0, [])


@pytest.mark.parametrize(("text", "want"), [("a. b! [1] c? [1] [2]\nd", ["a.", "b! [1]", "c? [1] [2]", "d"]), (" \n", []), ("e.g. this", ["e.g.", "this"]), (None, [])])
def test_split(text, want):
    assert Q.split(text) == want


def test_texts_are_read_once_and_replies_need_no_frames(spark):
    """A sentence said often and found often gives places once for each of the source's sentences, and texts are read by no more than one step after the reading."""
    n = 300
    replies = spark.createDataFrame([(1, "Rest well [1]. " * n), (2, "Gone [1].")], "reply_id long, text string")
    judged = Q.judge_quotes(replies, spark.createDataFrame([(1, 1, 1, "", "Rest well. " * n)], "reply_id long, n int, page int, section_path string, text string"))
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "FlatMapGroupsInPandas" not in plan
    assert [(r.reply_id, r.k, r.reason) for r in judged.orderBy("reply_id", "k").collect()] == [(1, i, None) for i in range(n)] + [(2, 0, "citation out of range")]
