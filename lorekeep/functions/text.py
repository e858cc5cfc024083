"""Text functions as Column expressions: everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks by the letter they fold to, then those that fold to two (fixed values).
FOLD_ONE = {
    "a": "àáâãäåāăą",
    "c": "çćčĉċ",
    "d": "ďđð",
    "e": "èéêëēĕėęě",
    "g": "ĝğġģ",
    "h": "ĥħ",
    "i": "ìíîïīĭįıĩ",
    "j": "ĵ",
    "k": "ķ",
    "l": "ĺļľŀł",
    "n": "ñńņň",
    "o": "òóôõöøōŏő",
    "r": "ŕŗř",
    "s": "śŝşš",
    "t": "ţťŧ",
    "u": "ùúûüũūŭůűų",
    "w": "ŵ",
    "y": "ýÿŷ",
    "z": "źżž",
}
FOLD_FROM = "".join(FOLD_ONE.values())
FOLD_TO = "".join(k * len(v) for k, v in FOLD_ONE.items())
FOLD_TWO = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}
#: Population words that scope a title, and words that alone make no containment query (fixed values).
POPULATIONS = ["children", "adults", "babies", "pregnancy", "older people", "men", "women", "teenagers", "young people"]
QUERY_STOP_WORDS = (
    "a about after an and are as at be before by can do during for from how i if in is it its me my not of on or that the this to we what when who why with you your"
).split()
WHITE = r"[\s\p{Z}\x{85}]+"


def collapse_ws(text: Column) -> Column:
    """Runs of Unicode white space become one space; none at either end."""
    return F.trim(F.regexp_replace(text, WHITE, " "))


def folded(text: Column) -> Column:
    out = F.translate(F.lower(text), FOLD_FROM, FOLD_TO)
    for one, two in FOLD_TWO.items():
        out = F.replace(out, F.lit(one), F.lit(two))
    return out


def normalise_title(text: Column) -> Column:
    """Lower case, Latin diacritics folded, possessives dropped, everything but letters and digits to single spaces. Null stays null."""
    bare = F.regexp_replace(folded(text), r"['’‘ʼ]s(?![\p{L}\p{N}])", "")
    return F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "))


def slugify(text: Column) -> Column:
    return F.replace(normalise_title(text), F.lit(" "), F.lit("-"))


def strip_parens(text: Column) -> Column:
    """Without (…) groups; an unmatched bracket stays."""
    return collapse_ws(F.regexp_replace(text, r"\([^)]*\)", " "))


def population_tail(text: Column) -> Column:
    """The population a title is scoped to ("… in|during <group>", or "for <group> …"), else null."""
    n = normalise_title(strip_parens(text))
    groups = "|".join(POPULATIONS)
    ends = F.regexp_extract(n, rf" (?:in|during) ({groups})$", 1)
    tail = F.regexp_extract(n, rf"^.*? for ({groups})(?: |$)", 1)
    first_for = F.when(F.regexp_like(n, F.lit(rf"^(?:(?! for ).)*? for (?:{groups})(?: |$)")), tail)
    return F.coalesce(F.nullif(ends, F.lit("")), F.nullif(first_for, F.lit("")))


def contains_words(key: Column, query: Column) -> Column:
    return F.contains(F.concat(F.lit(" "), key, F.lit(" ")), F.concat(F.lit(" "), query, F.lit(" ")))


def names_something(query: Column) -> Column:
    """Whether a normalised query may run as a containment query: three letters or more, not stop words alone."""
    return (F.char_length(query) >= 3) & F.exists(F.split(query, " "), lambda w: ~w.isin(QUERY_STOP_WORDS))


def max_edits(length: Column) -> Column:
    return F.when(length <= 2, 0).when(length <= 5, 1).otherwise(2)


def extraction_quality(text: Column) -> Column:
    """Share of characters that are neither U+FFFD nor control characters other than white space; 1 for an empty text."""
    n = F.char_length(text)
    bad = F.regexp_count(text, F.lit(r"[\x00-\x08\x0E-\x1F\x7F-\x84\x86-\x9F\x{FFFD}]"))
    return F.when(n > 0, (n - bad) / n).otherwise(F.lit(1.0))


def est_tokens(text: Column) -> Column:
    """A cautious estimate: one token for 3.5 characters, and 4 for the role."""
    return (F.ceil(F.char_length(F.coalesce(text, F.lit(""))) / 3.5) + 4).cast("long")


def fingerprint(text: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 12)


def hash_split(seed: str, key: Column) -> Column:
    """rows (.70), probe (.15) or calibration (.15) by the first 64 bits of sha256(seed, NUL, key)."""
    digest = F.sha2(F.concat(F.lit(seed), F.decode(F.lit(b"\x00"), "UTF-8"), key), 256)
    share = F.conv(F.substring(digest, 1, 16), 16, 10).cast("double") / F.lit(18446744073709551616.0)
    return F.when(share < 0.70, "rows").when(share < 0.85, "probe").otherwise("calibration")


def terms(text: Column) -> Column:
    """Index terms: folded runs of letters and digits."""
    return F.regexp_extract_all(folded(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def citations_in(text: Column) -> tuple[Column, Column]:
    """Numbers cited as [n] or [n, m], in order, and whether a bracket with a digit is no such list."""
    lists = F.regexp_extract_all(text, F.lit(r"\[([^\]\n]*)\]"), F.lit(1))
    good = F.filter(lists, lambda x: F.regexp_like(x, F.lit(r"^\s*\d+\s*(,\s*\d+\s*)*$")))
    numbers = F.transform(F.flatten(F.transform(good, lambda x: F.split(x, ","))), lambda x: F.trim(x).cast("int"))
    bad = F.exists(lists, lambda x: F.regexp_like(x, F.lit(r"\d")) & ~F.regexp_like(x, F.lit(r"^\s*\d+\s*(,\s*\d+\s*)*$")))
    return numbers, bad


def parens(text: Column) -> Column:
    """Contents of (…) groups, trimmed, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\(([^)]*)\)"), F.lit(1)), lambda x: F.trim(x))


def plain_key(text: Column) -> tuple[Column, Column]:
    """A stricter key (ASCII letters and digits, apostrophes closed up, the rest to single spaces), and whether a letter or digit could not be folded."""
    closed = F.regexp_replace(folded(text), "['’‘ʼ]", "")
    odd = F.regexp_like(closed, F.lit(r"[[^\x00-\x7F]&&[\p{L}\p{N}]]"))
    return F.trim(F.regexp_replace(closed, "[^a-z0-9]+", " ")), odd


def core_name(text: Column, forms: list[str]) -> Column:
    """The normalised name without trailing form words, as often as they repeat, and without the population it is scoped to."""
    n = normalise_title(strip_parens(text))
    bare = F.regexp_replace(n, rf"(?: (?:{'|'.join(sorted(forms, key=lambda f: (-len(f), f)))}))+$", "")
    return F.regexp_replace(bare, rf" (?:in|during|for) (?:{'|'.join(POPULATIONS)})$", "")


def safe_query(text: Column) -> Column:
    """Words of a query as quoted terms, so that none acts as an operator; quotes in them are doubled."""
    words = F.filter(F.split(collapse_ws(text), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), F.replace(w, F.lit('"'), F.lit('""')), F.lit('"'))), " ")


#: Escapes of a JSON string; other controls below U+0020 become \u00xx (fixed values).
JSON_ESCAPES = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def json_string(text: Column) -> Column:
    out = text
    for raw, escaped in JSON_ESCAPES.items():
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    rest = out
    for c in range(32):
        if chr(c) not in JSON_ESCAPES:
            rest = F.replace(rest, F.lit(chr(c)), F.lit(f"\\u{c:04x}"))
    return F.concat(F.lit('"'), F.when(F.regexp_like(out, F.lit(r"[\x00-\x1F]")), rest).otherwise(out), F.lit('"'))


def content_sha(*fields: Column) -> Column:
    """sha256 of the fields as a compact JSON array."""
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *[json_string(f) for f in fields]), F.lit("]")), 256)


def split_reasoning(text: Column) -> tuple[Column, Column, Column]:
    """The reasoning between <think> tags, the rest, and the state: ok, thinking_only, empty or truncated (a tag that never closes)."""
    t = F.coalesce(text, F.lit(""))
    inner = F.array_join(F.transform(F.regexp_extract_all(t, F.lit(r"(?is)<think>(.*?)(?:</think>|$)"), F.lit(1)), lambda x: F.trim(x)), "\n")
    cut = F.regexp_like(t, F.lit(r"(?is)<think>(?!.*</think>)"))
    rest = F.trim(F.regexp_replace(t, r"(?is)<think>.*?(?:</think>|$)", " "))
    state = F.when(cut, "truncated").when(rest != "", "ok").when(inner != "", "thinking_only").otherwise("empty")
    return inner, rest, state


def clean_segment(text: Column) -> Column:
    """An account's folder name: the id itself if it is made of ASCII letters, digits, _ and - alone, else null."""
    return F.when(F.regexp_like(text, F.lit("^[A-Za-z0-9_-]+$")), text)


def clean_pack_id(text: Column) -> Column:
    """A pack id that is a file name and never a path: 1 to 128 of ASCII letters, digits, . _ -, no leading point; else null."""
    return F.when(F.regexp_like(text, F.lit("^[A-Za-z0-9_-][A-Za-z0-9._-]{0,127}$")), text)


def clean_email(text: Column) -> Column:
    return F.lower(F.trim(text))


def count_words(text: Column) -> Column:
    """Tokens by white space."""
    return F.size(F.filter(F.split(collapse_ws(F.coalesce(text, F.lit(""))), " "), lambda w: w != ""))


QUERY_INSTRUCTION = "Represent this sentence for searching relevant passages: "  # fixed value: what embeddings of queries were made with


def query_input(text: Column) -> Column:
    return F.concat(F.lit(QUERY_INSTRUCTION), text)


def passage_input(prefix: Column, text: Column) -> Column:
    return F.when(F.coalesce(prefix, F.lit("")) == "", text).otherwise(F.concat(prefix, F.lit("\n"), text))
