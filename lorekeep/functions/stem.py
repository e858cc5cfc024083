"""The Porter stemmer as SQL steps over a column `w`: the same text runs on Spark and, with another name for the regular-expression test, on other engines.

A step is one CASE over the word's ending. `c` and `v` below are consonants and vowels; the measure of a stem is the number of vowel-consonant runs in it. Suffixes and what they become are
fixed values of the published algorithm, with its two later departures (bli, logi)."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
MORE_THAN_0, MORE_THAN_1, IS_1 = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}{_V}{_C}", f"^({_C})?{_V}{_C}({_V})?$"
HAS_VOWEL, SHORT = f"^({_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$"
#: Suffixes by what they become, longer before shorter endings of them (fixed values).
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "ement ment ance ence able ible ant ent ism ate iti ous ive ize al er ic ou".split()


def _less(n: int) -> str:
    return f"left(w, length(w) - {n})"


def _has(what: str, x: str) -> str:
    return f"regexp_like({x}, '{what}')"


def _suffixes(table: dict[str, str], measure: str) -> str:
    cases = [f"WHEN right(w, {len(s)}) = '{s}' THEN CASE WHEN {_has(measure, _less(len(s)))} THEN {_less(len(s))} || '{to}' ELSE w END" for s, to in table.items()]
    return f"CASE {' '.join(cases)} ELSE w END"


def steps() -> list[str]:
    """Expressions over `w`, each over the result of the one before. Words of one or two characters stay as they are; a leading y counts as a consonant."""
    last = "right(w, 1)"
    base = _less(1)  # in the step after an ending came off, which a # marks
    base_last, base_before = "substr(w, length(w) - 1, 1)", "substr(w, length(w) - 2, 1)"
    end = [f"WHEN right(w, {len(s)}) = '{s}' THEN CASE WHEN {_has(MORE_THAN_1, _less(len(s)))} THEN {_less(len(s))} ELSE w END" for s in STEP_4]
    out = [
        "CASE WHEN left(w, 1) = 'y' THEN 'Y' || substr(w, 2) ELSE w END",
        f"CASE WHEN right(w, 4) = 'sses' OR right(w, 3) = 'ies' THEN {_less(2)} WHEN right(w, 1) = 's' AND right(w, 2) <> 'ss' THEN {_less(1)} ELSE w END",
        f"CASE WHEN right(w, 3) = 'eed' THEN CASE WHEN {_has(MORE_THAN_0, _less(3))} THEN {_less(1)} ELSE w END WHEN right(w, 2) = 'ed' AND {_has(HAS_VOWEL, _less(2))} THEN {_less(2)} || '#' "
        f"WHEN right(w, 3) = 'ing' AND {_has(HAS_VOWEL, _less(3))} THEN {_less(3)} || '#' ELSE w END",
        f"CASE WHEN {last} <> '#' THEN w WHEN right({base}, 2) IN ('at', 'bl', 'iz') THEN {base} || 'e' WHEN {base_last} = {base_before} AND {_has('[^aeiouylsz]', base_last)} THEN {_less(2)} WHEN {_has(SHORT, base)} THEN {base} || 'e' ELSE {base} END",
        f"CASE WHEN right(w, 1) = 'y' AND {_has(HAS_VOWEL, _less(1))} THEN {_less(1)} || 'i' ELSE w END",
        _suffixes(STEP_2, MORE_THAN_0),
        _suffixes(STEP_3, MORE_THAN_0),
        f"CASE {' '.join(end)} WHEN right(w, 3) = 'ion' AND substr(w, length(w) - 3, 1) IN ('s', 't') AND {_has(MORE_THAN_1, _less(3))} THEN {_less(3)} ELSE w END",
        f"CASE WHEN right(w, 1) = 'e' AND ({_has(MORE_THAN_1, base)} OR ({_has(IS_1, base)} AND NOT {_has(SHORT, base)})) THEN {base} ELSE w END",
        f"CASE WHEN right(w, 2) = 'll' AND {_has(MORE_THAN_1, 'w')} THEN {base} ELSE w END",
        "CASE WHEN left(w, 1) = 'Y' THEN 'y' || substr(w, 2) ELSE w END",
    ]
    return [f"CASE WHEN length(word) < 3 OR length(word) > 64 THEN w ELSE {x} END" for x in out]


def stems(terms: DataFrame, term: str = "term", stem: str = "stem") -> DataFrame:
    """(term, stem), one row for each distinct term."""
    out = terms.select(F.col(term).alias("word")).distinct().withColumn("w", F.col("word"))
    for step in steps():
        out = out.withColumn("w", F.expr(step))
    return out.select(F.col("word").alias(term), F.col("w").alias(stem))


_RE = {x: re.compile(x) for x in (MORE_THAN_0, MORE_THAN_1, IS_1, HAS_VOWEL, SHORT)}
#: Endings of a step, to tell by one look that a word has none.
_ENDS = [(table, tuple(table)) for table in (STEP_2, STEP_3)], (*STEP_4, "sion", "tion")


@lru_cache(1 << 17)
def porter(word: str) -> str:
    """The steps above for one word: arrays of words are stemmed in their row, where a join with a table of stems would make a row of each word."""
    has = lambda what, x: _RE[what].search(x) is not None
    if not 3 <= len(word) <= 64:
        return word
    w = "Y" + word[1:] if word[0] == "y" else word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
    if w.endswith("eed"):
        w = w[:-1] if has(MORE_THAN_0, w[:-3]) else w
    elif cut and has(HAS_VOWEL, w[:-cut]):
        w = w[:-cut]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w[-2:-1] == w[-1] and w[-1] not in "aeiouylsz":
            w = w[:-1]
        elif has(SHORT, w):
            w += "e"
    if w.endswith("y") and has(HAS_VOWEL, w[:-1]):
        w = w[:-1] + "i"
    for table, ends in _ENDS[0]:
        if w.endswith(ends):
            end = next(s for s in table if w.endswith(s))
            if has(MORE_THAN_0, w[: -len(end)]):
                w = w[: -len(end)] + table[end]
    if w.endswith(_ENDS[1]):
        end = next((s for s in STEP_4 if w.endswith(s)), "ion")
        if has(MORE_THAN_1, w[: -len(end)]):
            w = w[: -len(end)]
    if w.endswith("e") and (has(MORE_THAN_1, w[:-1]) or (has(IS_1, w[:-1]) and not has(SHORT, w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and has(MORE_THAN_1, w):
        w = w[:-1]
    return "y" + w[1:] if w[:1] == "Y" else w


def stem_each(words: Column) -> Column:
    """The stems of an array of words, in order; null is no word at all."""

    @F.arrow_udf("array<string>")
    def stem(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().dictionary_encode()
        out = pa.array([None if w is None else porter(w) for w in flat.dictionary.to_pylist()], pa.string()).take(flat.indices)
        return pa.ListArray.from_arrays(pc.subtract(lists.offsets, lists.offsets[0]), out)

    return stem(F.coalesce(words, F.array().cast("array<string>")))


#: Words of a part of a batch in stem_counts().
PART = 1 << 20


def stem_counts(words: Column) -> Column:
    """Array of (stem, tf): how often each stem is in an array of words; null is no word at all."""

    def part(lists: pa.ListArray) -> pa.Array:
        flat = lists.flatten().dictionary_encode()
        stems = pa.array([porter(w) for w in flat.dictionary.to_pylist()], pa.string()).dictionary_encode()
        n = max(1, len(stems.dictionary))
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        keys, tf = np.unique(row * n + stems.indices.to_numpy()[flat.indices.to_numpy()], return_counts=True)
        each = pa.StructArray.from_arrays([stems.dictionary.take(pa.array(keys % n)), pa.array(tf, pa.int32())], ["stem", "tf"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(keys, np.arange(len(lists) + 1) * n), pa.int32()), each)

    @F.arrow_udf("array<struct<stem:string,tf:int>>")
    def count(lists: pa.Array) -> pa.Array:
        at, out, a = lists.offsets.to_numpy(), [], 0
        while a < len(lists):
            b = max(a + 1, int(np.searchsorted(at, at[a] + PART, "right")) - 1)
            out.append(part(lists.slice(a, b - a)))
            a = b
        return pa.concat_arrays(out) if out else part(lists)

    return count(F.coalesce(words, F.array().cast("array<string>")))


def head(word: Column) -> Column:
    """The first two letters, y as i: a word and its stem have the same, unless the stem is one letter. No step touches the first letter; the second one may turn from y to i, and what other suffixes leave has two letters or more."""
    return F.translate(F.substring(word, 1, 2), "y", "i")


def may_have(word: Column, heads: Column) -> Column:
    """Whether a word may have a stem with one of the heads (an array), by its first letters alone."""
    return F.array_contains(heads, head(word)) | F.array_contains(heads, F.substring(head(word), 1, 1))


def stems_sql(name: str, source: str) -> str:
    """Common table expressions that end in `name` (word, w): the stem of each `word` of the relation `source`."""
    parts = [f"{name}_0 AS (SELECT DISTINCT word, word AS w FROM {source})"]
    for i, step in enumerate(steps()):
        parts.append(f"{name}_{i + 1} AS (SELECT word, {step.replace('regexp_like', 'regexp_matches')} AS w FROM {name}_{i})")
    return ",\n".join([*parts, f"{name} AS (SELECT * FROM {name}_{len(steps())})"])
