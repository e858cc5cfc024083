"""Doses in one written form: how a thing is written changes, never what is said.

A text is cleaned of marks (citations, emphasis, invisible characters), then read token by token: number words are gathered into numbers by a table of what may follow what, roman numerals and fractions become figures, units take their
short name and stand against their figure."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

#: Units by the name they are written as, with their spellings as patterns (fixed values).
UNITS = {
    "mcg": "micrograms?|microgrammes?|mcgs?|µg|μg|ug", "ng": "nanograms?|nanogrammes?|ng", "mg": "milligrams?|milligrammes?|mgs?", "mcl": "microlit(?:re|er)s?|µl|μl|ul", "ml": "millilit(?:re|er)s?|mls?", "litres": "lit(?:re|er)s?",
    "cc": "cc", "mmol": "millimoles?|mmols?", "iu": "international units?|iu", "units": "units?", "g": "grams?|grammes?|gms?|g", "%": "per ?cent|%",
    "tablets": "tablets?|tabs?", "caplets": "caplets?", "capsules": "capsules?|caps?", "pills": "pills?", "sachets": "sachets?", "drops": "drops?", "puffs": "puffs?", "sprays": "sprays?", "patches": "patch(?:es)?",
    "suppositories": "suppositor(?:y|ies)", "pessaries": "pessar(?:y|ies)", "lozenges": "lozenges?", "pastilles": "pastilles?", "ampoules": "ampoules?|ampules?", "vials": "vials?", "injections": "injections?", "doses": "doses?",
    "teaspoons": "teaspoon(?:ful)?s?|tsps?", "tablespoons": "tablespoon(?:ful)?s?|tbsps?", "spoonfuls": "spoon(?:ful)?s?",
}
#: Number words by kind and value, words that stand for figures, and shares (fixed values).
WORDS = {
    **{w: ("unit" if n < 10 else "teen", n) for n, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())},
    **{w: ("tens", 10 * n) for n, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}, "hundred": ("hundred", 100), "thousand": ("thousand", 1000),
}
FIGURES, SHARES = {"dozen": "12", "twice": "2 times", "thrice": "3 times"}, {"half": "1/2", "quarter": "1/4"}
#: What may stand before a number word in the same number; hundred and thousand may follow anything.
AFTER = {"unit": {"tens", "hundred", "thousand"}, "teen": {"hundred", "thousand"}, "tens": {"hundred", "thousand"}}
ROMAN = re.compile(r"M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})")
ROMAN_VALUES = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
#: Capitals that are lengths and small letters that are a word or lengths, no numerals (fixed values).
NOT_ROMAN, NOT_LOWER = {"CM", "MM"}, {"cm", "mm", "mix"}
CANON = "|".join(map(re.escape, sorted(UNITS, key=len, reverse=True)))
ANY_UNIT = re.compile("|".join(UNITS.values()), re.I)
SPELLED = re.compile("(?<![a-z])(?:" + "|".join(f"(?P<u{i}>{p})" for i, p in enumerate(UNITS.values())) + ")(?![a-z])")
TOKENS = re.compile(rf"\d+(?:[./]\d+)?(?:{CANON})(?![a-z0-9])")
#: Marks and typography, in the order in which they go (fixed values).
MARKS = [(r"\[\s*\d+(?:\s*,\s*\d+)*\s*\]", ""), (r"(?i)\[\s*(?:[a-z]|[*†‡])\s*\]", ""), (r"\*\*(\S(?:[^*]*?\S)?)\*\*", r"\1"), (r"__(\S(?:[^_]*?\S)?)__", r"\1"), (r"(?<![A-Za-z0-9])\*(\S(?:[^*]*?\S)?)\*(?![A-Za-z0-9])", r"\1"), (r"(?<![A-Za-z0-9])_(\S(?:[^_]*?\S)?)_(?![A-Za-z0-9])", r"\1"), (r"`([^`]+)`", r"\1")]
PLAIN = {**dict.fromkeys("‐‑‒–—−", "-"), **dict.fromkeys("‘’‚‛", "'"), **dict.fromkeys("“”„‟", '"'), "⁄": "/", "×": "x", "°": " degrees "}
PLAIN_TABLE, NUMBER_WORD = str.maketrans(PLAIN), re.compile(rf"(?<![a-z])(?:{'|'.join(WORDS)})(?![a-z])")
#: Characters that don't show, and decimal digits other than 0 to 9.
INVISIBLE = re.compile("[" + "".join(re.escape(c) for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cf") + "͏ᅟᅠ឴឵\uFE00-\uFE0F]")
OTHER_DIGITS = re.compile(r"[^\D0-9]")
EDGE = " \t\n.,;:!?'\"()-•*#`"


def roman(m: re.Match) -> str:
    word = m[0]
    if not ROMAN.fullmatch(word) or word in NOT_ROMAN or ANY_UNIT.fullmatch(word):
        return word
    values = [ROMAN_VALUES[c] for c in word]
    return str(sum(-v if v < n else v for v, n in zip(values, [*values[1:], 0], strict=True)))


def figures(text: str) -> str:
    """Runs of number words as figures. A word that can't go on with the number before it starts another one, behind what stood between; `and` joins only after hundred and thousand."""
    if not NUMBER_WORD.search(text):
        return text
    out: list[str] = []
    now: list[tuple[str, int]] = []  # the words of the number that is open
    gap = ""  # what stands behind it, until the next word tells whether it belongs inside

    def value() -> str:
        total = part = 0
        for kind, n in now:
            if kind == "thousand":
                total, part = total + max(part, 1) * n, 0
            else:
                part = max(part, 1) * n if kind == "hundred" else part + n
        return str(total + part)

    def close() -> None:
        nonlocal gap
        if now:
            out.append(value())
            now.clear()
        out.append(gap)
        gap = ""

    for token in re.findall(r"[a-z]+|[^a-z]+", text):
        kind = WORDS.get(token)
        if kind is None:
            joins = now and re.fullmatch(r"[ \t]*-[ \t]*|[ \t]+", gap + token) or (now and token == "and" and now[-1][0] in ("hundred", "thousand") and re.fullmatch(r"[ \t]+", gap)) or (now and re.fullmatch(r"[ \t]+and", gap) and re.fullmatch(r"[ \t]+", token))
            if joins:
                gap += token
            else:
                gap += token
                close()
            continue
        apart = out and not now and re.search(r"[0-9_]$", out[-1])  # letters right behind a figure are no word of their own
        if apart:
            out.append(token)
            continue
        if now and kind[0] in AFTER and now[-1][0] not in AFTER[kind[0]]:
            gap = "-" if "-" in gap else " "
            close()
        gap = ""
        now.append(kind)
    close()
    return "".join(out)


def normalise(text: str | None) -> str:
    s = text or ""
    for pattern, plain in MARKS:
        s = re.sub(pattern, plain, s)
    plain = s.isascii()
    s = s if plain else INVISIBLE.sub("", s)
    s = re.sub(r"\b[IVXLCDM]{2,}\b", roman, s)
    if not plain:
        s = unicodedata.normalize("NFKC", re.sub(r"(\d)(?=[¼-¾⅐-⅟↉])", r"\1 ", s))
        s = OTHER_DIGITS.sub(lambda m: str(unicodedata.decimal(m[0])), s)
    s = s.lower()
    s = s if plain else s.translate(PLAIN_TABLE)
    s = re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", s)
    s = re.sub(r"(?<!\d)\.(?=\d)", "0.", s)
    s = figures(s)
    for word, figure in FIGURES.items():
        if word not in s:
            continue
        s = re.sub(rf"\b{word}\b", figure, s)
    for word, share in SHARES.items():  # "2 and a half", "three quarters", then the share alone with the words around it
        if word not in s:
            continue
        s = re.sub(rf"\b(\d+)[ \t]+and[ \t]+(?:an?[ \t]+|1[ \t]+)?{word}\b", rf"\1 {share}", s)
    s = re.sub(r"\b(\d+)[ \t]+quarters\b", r"\1/4", s) if "quarters" in s else s
    for word, share in SHARES.items():
        if word not in s:
            continue
        s = re.sub(rf"\b(?:an?[ \t]+|1[ \t]+)?{word}\b(?:[ \t]+of\b)?(?:[ \t]+an?\b)?", share, s)
    s = re.sub(r"\b(\d+(?: \d+)?/\d+)[ \t]+of[ \t]+(?:an?|the)\b", r"\1", s) if "/" in s else s
    names = list(UNITS)
    s = SPELLED.sub(lambda m: names[int(m.lastgroup[1:])], s)
    s = re.sub(rf"(\d)[ \t]*-?[ \t]*({CANON})(?![a-z])", r"\1\2", s)
    return re.sub(r"\s+", " ", s).strip(EDGE)


def dose_tokens(normalised: str) -> list[str]:
    """Figures with a unit, as written in a normalised text."""
    return [m[0] for m in TOKENS.finditer(normalised)]


def bears_dose(normalised: str) -> bool:
    """A figure, the name of a unit, or a small roman numeral of two letters or more."""
    small = any(ROMAN.fullmatch(w.upper()) and w not in NOT_LOWER for w in re.findall(r"\b[ivxlcdm]{2,}\b", normalised))
    return small or re.search(rf"\d|(?<![a-z0-9.])(?:{CANON})(?![a-z0-9.])", normalised) is not None


def unreadable(normalised: str) -> bool:
    """Anything but printable ASCII, Latin letters, some signs, and Greek letters of drug names as words of their own."""
    if not re.search(r"[^ -~]", normalised):
        return False
    rest = re.sub(r"(?<![^\W\d_])[αβγδκμ]+(?![^\W\d_])", "", normalised)
    return any(not (" " <= c <= "~" or c in "£€≥≤®©ªº" or unicodedata.name(c, "").startswith("LATIN ")) for c in set(rest))


READ = StructType([StructField("normalised", StringType()), StructField("tokens", ArrayType(StringType())), StructField("bears_dose", BooleanType()), StructField("unreadable", BooleanType())])


@F.arrow_udf(READ)
def read_doses(texts: pa.Array) -> pa.Array:
    """normalised, tokens, bears_dose, unreadable of each text."""
    n = [normalise(t) for t in texts.to_pylist()]
    return pa.StructArray.from_arrays([pa.array(n, pa.string()), pa.array([dose_tokens(x) for x in n], pa.list_(pa.string())), pa.array([bears_dose(x) for x in n]), pa.array([unreadable(x) for x in n])], ["normalised", "tokens", "bears_dose", "unreadable"])
