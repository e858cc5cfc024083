"""Formulas and tagged transcriptions, read with a stack: braces and tags nest to any depth, and what a transcription cuts short closes at its end."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Commands with one and with two arguments, whose braces stay (fixed values).
ONE, TWO = frozenset("sqrt text mathrm overline hat vec bar".split()), frozenset("frac binom".split())
#: What is written before a formula is read, in order: places, frames and sizes go, names become the plainer one (fixed values).
PLAIN = [
    (r"<loc_\d+>", " "), (r"\\begin\{array\}\s*\{[^}]*\}", " "), (r"\\end(?:\s*\{[^}]*\}?)?", " "), (r"\\(?:left|right|displaystyle)\b", " "), (r"\\[,;!]", " "), (r"\\[dt]frac", r"\\frac"), (r"\\text\s*\{[^}]*\}", " "), (r"\\colon", ":"),
    (r"\A\s*[A-Za-z\s]*:\s*", ""), (r"(?m)^[A-Za-z\s]*:\s*$", ""), (r"\n", " "), (r"\\cdot(?![A-Za-z])", r"\\times"), (r"\\leq(?![A-Za-z])", r"\\le"), (r"\\geq(?![A-Za-z])", r"\\ge"), (r"\\frac(\d)(\d)", r"\\frac{\1}{\2}"), (r"\\neq(?![A-Za-z])", r"\\ne"),
]
TOKEN = re.compile(r"\\(?:[A-Za-z]+|\\|[^\n])|\\|\S", re.S)
#: Signs that stand between spaces when a formula is shown.
BETWEEN = frozenset(["=", "<", ">", "+", "\\times", "\\le", "\\ge", "\\ne", "\\div", "\\pm", "\\approx"])


def tokens(text: str | None) -> list[str]:
    """The canonical tokens of a formula: grouping braces gone, those of arguments kept, but not around one character after ^ or _."""
    t = text or ""
    for pattern, plain in PLAIN:
        t = re.sub(pattern, plain, t)
    frames: list[list] = [[[], 0]]  # (tokens so far, arguments that the last command still expects)

    def close() -> None:
        inner, _ = frames.pop()
        out, want = frames[-1]
        if not want:
            out += inner
            return
        one = out and out[-1] in ("^", "_") and len("".join(inner)) == 1
        out += inner if one else ["{", *inner, "}"]
        frames[-1][1] -= 1

    for m in TOKEN.finditer(t):
        token = m[0]
        if token == "{":
            frames.append([[], 0])
        elif token == "}":
            if len(frames) > 1:
                close()
        else:
            out, want = frames[-1]
            name = token[1:]
            if token in ("^", "_") or (token[0] == "\\" and name in ONE):
                frames[-1][1] = 1
            elif token[0] == "\\" and name in TWO:
                frames[-1][1] = 2
            else:
                frames[-1][1] = want - 1 if want and len(token) == 1 and out and out[-1] in ("^", "_") else 0
            out.append(token)
    while len(frames) > 1:
        close()
    return frames[0][0]


def canonical(text: str | None) -> str:
    """The form that two spellings of one formula share; it has no white space."""
    return "".join("".join(tokens(text)).split())


def display(text: str | None) -> str:
    """The canonical tokens as a reader wants them: signs between spaces, a space where a command's name would run into a letter."""
    out = ""
    for t in tokens(text):
        if t in BETWEEN:
            out = f"{out.rstrip()} {t} "
        else:
            out += (" " if re.search(r"\\[A-Za-z]+$", out) and t[0].isalnum() else "") + t
    return out.strip()


def _udf(f):
    @F.arrow_udf(StringType())
    def each(a: pa.Array) -> pa.Array:
        return pa.array([f(x) for x in a.to_pylist()], pa.string())

    return each


normalise_latex, show_latex = _udf(canonical), _udf(display)

END = "</doctag>"
TAG = re.compile(r"<(/?)([a-z_]+?)(?:_(\d+))?>")
LATEX_TAGS = frozenset(["formula", "equation"])
#: A head that is words and no relation, then a colon: a label before a formula.
LABEL = re.compile(r"\A([A-Za-z ,]*?[A-Za-z ,])\s*(?::|\\colon\b)(.*)\Z", re.S)
TEXT_LABEL = re.compile(r"\A\\text\s*\{([^}]*)\}\s*(?::|\\colon\b)(.*)\Z", re.S)


def holds_word(head: str) -> bool:
    """A word of three letters or more with a lower-case one; letters apart from each other ("S o l v e") make one word."""
    joined = re.sub(r"(?<![A-Za-z])((?:[A-Za-z] )+[A-Za-z])(?![A-Za-z])", lambda m: m[1].replace(" ", ""), head)
    return any(len(w) >= 3 and any(c.islower() for c in w) for w in re.findall(r"[A-Za-z]+", joined))


def doctag_blocks(text: str | None) -> list[tuple[str, str, int, int]]:
    """(kind, content, start, end) of the elements of a transcription: one ends with its line, at a place mark and at an end tag; after the document's end nothing counts. Elements in formula tags and those with a backslash command
    are latex, others text; a label before a formula is a text of its own. Places count characters of the input."""
    raw = text or ""
    raw = raw[: raw.find(END)] if END in raw else raw
    out: list[tuple[str, str, int, int]] = []
    open_tags: list[str] = []

    def emit(held: list[tuple[str, int]], formula: bool) -> None:
        chars = "".join(c for c, _ in held)
        at = [p for _, p in held]

        def block(kind: str, a: int, b: int) -> None:
            while a < b and chars[a].isspace():
                a += 1
            while b > a and chars[b - 1].isspace():
                b -= 1
            if b > a:
                out.append((kind, chars[a:b], at[a], at[b - 1] + 1))

        maths = formula or re.search(r"\\[A-Za-z]", chars) is not None
        lead = len(chars) - len(chars.lstrip())
        m = TEXT_LABEL.match(chars[lead:]) or LABEL.match(chars[lead:]) if maths else None
        if m and m[2].strip() and (m.re is TEXT_LABEL or holds_word(m[1])):
            block("text", lead + m.start(1), lead + m.end(1))
            block("latex", lead + m.start(2), lead + m.end(2))
        else:
            block("latex" if maths else "text", 0, len(chars))

    base = 0
    for row in raw.split("\n"):
        held: list[tuple[str, int]] = []
        formula = any(t in LATEX_TAGS for t in open_tags)
        i = 0
        while i < len(row):
            m = TAG.match(row, i)
            if not m:
                held.append((row[i], base + i))
                i += 1
                continue
            if m[3] is not None or m[1]:
                emit(held, formula)
                held = []
                if m[1] and m[2] in open_tags:
                    del open_tags[len(open_tags) - 1 - open_tags[::-1].index(m[2]) :]
            else:
                open_tags.append(m[2])
            formula = any(t in LATEX_TAGS for t in open_tags)
            i = m.end()
        emit(held, formula)
        base += len(row) + 1
    return out


@F.arrow_udf(ArrayType(StructType([StructField("kind", StringType()), StructField("content", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])))
def doctags(texts: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("content", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    return pa.array([[dict(zip(("kind", "content", "start", "end"), b, strict=True)) for b in doctag_blocks(t)] for t in texts.to_pylist()], kind)
