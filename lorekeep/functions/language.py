"""Sentences and alignments. JVM expressions but for a small helper on Arrow batches (alignment)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Words whose full stop ends no sentence (fixed values).
ABBREVIATIONS = "mr mrs ms dr prof fig figs eq no vol ch sec pp al vs cf eg ie etc st jr sr".split()
#: Stand for a full stop that ends nothing, and a place to cut while a text is worked on: noncharacters, which no text holds.
_KEPT, _CUT = "\ufdd0", "\ufdd1"


def split_sentences(text: Column) -> Column:
    """Sentences end at . ? ! before white space or the end, but not at the stop of an abbreviation or of initials like U.S. or e.g."""
    t = F.coalesce(text, F.lit(""))
    kept = F.regexp_replace(t, rf"(?i)(^|[^\p{{L}}\p{{N}}])({'|'.join(ABBREVIATIONS)})\.", f"$1$2{_KEPT}")
    kept = F.regexp_replace(kept, r"(^|[^\p{L}\p{N}.])((?:[\p{L}\p{N}]\.)+[\p{L}\p{N}])\.", f"$1$2{_KEPT}")
    cut = F.split(F.regexp_replace(kept, r"([.?!])\s+", f"$1{_CUT}"), _CUT)
    return F.filter(F.transform(cut, lambda s: F.trim(F.replace(s, F.lit(_KEPT), F.lit(".")))), lambda s: s != "")


def even(text: Column) -> Column:
    """Whether the sentences of a text, joined by a space, are the text as it is but for spaces at its ends: no end of a sentence is followed by other white space than one space. Null is even."""
    t = F.coalesce(text, F.lit(""))
    return ~(F.regexp_like(t, F.lit(r"[.?!](?:\s\s|[^\S ])")) | F.contains(t, F.lit(_KEPT)) | F.contains(t, F.lit(_CUT)))


def blank(text: Column) -> Column:
    """Whether a text has no sentences."""
    return F.trim(F.coalesce(text, F.lit("")), F.lit(f" {_CUT}")) == ""


def split_lines_and_sentences(text: Column) -> Column:
    """Sentences of a reply: list items and headings are their own, citations after a stop belong to the sentence before, "no. 5" is no end."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])\s*((?:\[[0-9, ]+\]\s*)+)", " $2$1 ")
    t = F.regexp_replace(t, r"(?i)\b(no)\. ?([0-9])", f"$1{_KEPT} $2")
    lines = F.filter(F.split(F.regexp_replace(t, r"\n[ \t]*(?=[-*#]|[0-9]+[.)] )", "\n\n"), r"\n\s*\n"), lambda x: F.trim(x) != "")
    one = lambda x: F.split(F.regexp_replace(F.regexp_replace(F.trim(x), r"^(?:[-*#]+|[0-9]+[.)])\s+", ""), r"([.?!])\s+", f"$1{_CUT}"), _CUT)
    return F.filter(F.transform(F.flatten(F.transform(lines, one)), lambda s: F.trim(F.regexp_replace(F.replace(s, F.lit(_KEPT), F.lit(".")), r"\s+", " "))), lambda s: s != "")


def align(a: str, b: str) -> tuple[int, list[str]]:
    """Least number of edits from a to b, and the pairs that one such alignment substitutes, from the left."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y)))
        rows.append(row)
    i, j, pairs = len(a), len(b), []
    while i and j:
        same = a[i - 1] == b[j - 1]
        if rows[i][j] == rows[i - 1][j - 1] + (not same):
            if not same:
                pairs.append(a[i - 1] + b[j - 1])
            i, j = i - 1, j - 1
        elif rows[i][j] == rows[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
    return rows[-1][-1], pairs[::-1]


@F.arrow_udf(StructType([StructField("distance", IntegerType()), StructField("substituted", ArrayType(StringType()))]))
def aligned(a: pa.Array, b: pa.Array) -> pa.Array:
    got = [align(x or "", y or "") for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array([d for d, _ in got], pa.int32()), pa.array([p for _, p in got], pa.list_(pa.string()))], ["distance", "substituted"])
