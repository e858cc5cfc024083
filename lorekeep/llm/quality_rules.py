"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Words are runs of characters other than the six ASCII white-space characters. All counts are over whole texts. A null or
empty text has no words and so fails the base rule; its ratios are 0. Repeated rows give repeated result rows.

Windows are compared by a 64-bit hash within one text: two differing windows of a text of n words meet with a chance of n^2 / 2^65. Measures are
computed in steps, each a projection over the columns of the one before, so none is evaluated twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD

#: (measure, lowest, highest) of the verdict after the base rule; None: no bound. A document is kept if every measure is inside.
THRESHOLDS: list[tuple[str, float | None, float | None]] = [
    ("mean_word_chars", 2.0, 14.0),
    ("symbol_ratio", None, 0.25),
    ("stop_words", 2, None),
    ("dup_line_ratio", None, 0.5),
    ("upper_word_ratio", None, 0.6),
    ("list_line_ratio", None, 0.9),
]

#: Frequent function words of the corpus languages (fixed values).
STOP_WORDS = "the of and to in a is that it for de la le les et des en un une der die das und ist den el los las que y".split()


def counts(text: Column) -> dict[str, Column]:
    """Counts over the text and an array column of its words named _words."""
    text = F.coalesce(text, F.lit(""))
    words = F.transform(F.array_distinct("_words"), lambda w: F.lower(w))
    return {
        "word_chars": F.length(F.translate(text, SPACE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "stop_words": F.size(F.array_intersect(words, F.array(*map(F.lit, STOP_WORDS)))),
        "_upper": F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])[A-Z][A-Z!?.,]+(?![^\x20\x09-\x0D])")),
        "_lines": F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0),
    }


def line_counts() -> dict[str, Column]:
    n = F.size("_lines").cast("long")
    return {"_n_lines": n, "n_dup_lines": n - F.size(F.array_distinct("_lines")).cast("long"), "_lists": F.size(F.filter("_lines", lambda x: x.rlike(r"^\s*[-*•]\s")))}


def ratios() -> dict[str, Column]:
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "mean_word_chars": part("word_chars", "n_words"),
        "symbol_ratio": part("n_symbols", "word_chars"),
        "dup_line_ratio": part("n_dup_lines", "_n_lines"),
        "upper_word_ratio": part("_upper", "n_words"),
        "list_line_ratio": part("_lists", "_n_lines"),
    }


def windows() -> Column:
    """The 3-word windows of _words as (64-bit hash, position), sorted: equal windows are neighbours."""
    w = lambda i: F.get("_words", i)
    every = F.sort_array(F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.struct(F.xxhash64(w(i), w(i + 1), w(i + 2)).alias("w"), i.alias("p"))))
    return F.when(F.size("_words") < 3, F.array().cast("array<struct<w:bigint,p:int>>")).otherwise(every)


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds: list | None = None, keep_row: bool = False) -> DataFrame:
    """doc_id, the measures, base_failed and kept, one row per input row; with keep_row also the row itself, as struct _row."""
    row = [F.struct("*").alias("_row")] * keep_row
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *row)
    carry = ["doc_id", *["_row"] * keep_row]
    d = base.withColumn("_words", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({WORD})"), F.lit(1)))
    d = d.select(*carry, F.size("_words").cast("long").alias("n_words"), *[c.alias(k) for k, c in counts(F.col("text")).items()], windows().alias("_win"))
    at = lambda i: F.get("_win", i)["w"]
    rep = F.filter(F.col("_win"), lambda x, i: F.coalesce(at(i - 1) == x["w"], F.lit(False)) | F.coalesce(at(i + 1) == x["w"], F.lit(False)))
    d = d.select(*carry, "n_words", "word_chars", "n_symbols", "stop_words", "_upper", *[c.alias(k) for k, c in line_counts().items()], F.sort_array(F.transform(rep, lambda x: x["p"])).alias("_pos"))
    # each repeated window, in order, adds 3 words less its overlap with the one before
    covered = F.aggregate(F.transform("_pos", lambda p, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get("_pos", i - 1)))), F.lit(0), lambda s, x: s + x)
    d = d.select(*carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", *[c.alias(k) for k, c in ratios().items()], "stop_words", covered.cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    verdict = F.lit(True)
    for name, low, high in THRESHOLDS if thresholds is None else thresholds:
        verdict = verdict & (F.col(name) >= low if low is not None else F.lit(True)) & (F.col(name) <= high if high is not None else F.lit(True))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    d = d.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict)
    names = [*first, *[k for k in d.columns if k not in first]]
    # a caller's filter stops above a projection that numbers rows; below it, the planner would write all measures out once more for each mention
    return d.withColumn("_n", F.monotonically_increasing_id()).where("_n >= 0").select(names)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return apply_rules(table(spark, sf_dir, "documents"))


def _sql_threshold() -> str:
    out = []
    for name, low, high in THRESHOLDS:
        out += [f"{name} >= {low}"] * (low is not None) + [f"{name} <= {high}"] * (high is not None)
    return " AND ".join(out)


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM d),
y AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p], w[p + 1], w[p + 2]) AS n FROM x),
z AS (SELECT doc_id, count(DISTINCT p + k) AS n_repeat_words FROM y, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(str_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS f FROM d),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
  (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(f) - len(list_distinct(f)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(f) AS lines,
  len(list_intersect(list_transform(w, lambda x: lower(x)), {STOP_WORDS!r}))::INTEGER AS stop_words,
  len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z][A-Z!?.,]+$'))) AS uppers,
  len(list_filter(f, lambda x: regexp_matches(x, '^\\s*[-*•]\\s'))) AS lists
  FROM d JOIN l USING (doc_id) LEFT JOIN z USING (doc_id)),
r AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END AS mean_word_chars, CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0.0 END AS symbol_ratio,
  CASE WHEN lines > 0 THEN n_dup_lines / lines ELSE 0.0 END AS dup_line_ratio, CASE WHEN n_words > 0 THEN uppers / n_words ELSE 0.0 END AS upper_word_ratio,
  CASE WHEN lines > 0 THEN lists / lines ELSE 0.0 END AS list_line_ratio, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_sql_threshold()} AS kept,
  mean_word_chars, symbol_ratio, stop_words, dup_line_ratio, upper_word_ratio, list_line_ratio FROM r
"""
