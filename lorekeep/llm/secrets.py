"""Secret scan over a trigram inverted index.

Each rule's pattern is parsed, and a Boolean query over trigrams is derived from it: a run of a concatenation that can only be one of a few strings must
hold the trigrams of one of them, an alternation one of its branches, a repeated part what one copy must hold; optional and open parts ask for
nothing. Per batch of documents the postings of the trigrams in use are built with one pass over the bytes; intersecting and
uniting them gives each rule's candidates, which are then verified with the pattern itself. A rule without mandatory
trigrams scans every document. Candidate sets are supersets, so results equal a full scan.

Nulls count as empty texts; an empty text has no spans and the digest of the empty string. Repeated rows give repeated results."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, runs, slices


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    min_chars: int = 0  # of the group below
    group: int = 0
    base: bool = False
    verify: str | None = None  # a pattern whose matches are those of `pattern` with min_chars, where that is faster


def any_case(word: str) -> str:
    """Explicit classes: the pattern flag for case would also admit non-ASCII letters."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(any_case, ("password", "passwd", "secret", "token")), any_case("api") + "_?" + any_case("key")])

#: After a private key's BEGIN line: up to the next END line with no other BEGIN between, or else the header and base64 lines that follow (also with "\\n" written out).
_BREAK = r"(?:\r?\n|\\r\\n|\\n)"
_KEY_REST = rf"(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z ]*PRIVATE KEY-----|(?:[\x20\t]*{_BREAK}[\x20\t>]*(?:(?:Proc-Type|DEK-Info|Comment|Version|Charset|Hash|MessageID):[^\r\n]*|[A-Za-z0-9+/]{{16,}}={{0,2}}|[A-Za-z0-9+/]{{1,15}}={{0,2}}(?=[\x20\t]*(?:{_BREAK}|$))|(?=[\x20\t]*{_BREAK})))*)"

RULES = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, 0, True),
    # maximal runs of one class: a run that is too short is dropped, so asking for the length at once is the same
    Rule("hex", r"[0-9a-f]+", 24, 0, True, r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----" + _KEY_REST),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)

#: Bounds of the expansion: strings that a run may stand for, characters of a class, length of a run.
STRINGS, CLASS, LENGTH = 64, 8, 48
#: Letters that other characters match too when a pattern ignores case beyond ASCII.
_WIDE = frozenset("iksIKS")


def trigrams(literal: str) -> list[int]:
    b = literal.encode("utf-8", "surrogatepass")
    return [b[i] << 16 | b[i + 1] << 8 | b[i + 2] for i in range(len(b) - 2)]


def both(parts: list) -> tuple | int | None:
    """AND of queries; None asks for nothing."""
    some = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not some else some[0] if len(some) == 1 else ("and", *some)


def either(parts: list) -> tuple | int | None:
    """OR of queries; one that asks for nothing makes all of it ask for nothing."""
    some = list(dict.fromkeys(parts))
    return None if not some or None in some else some[0] if len(some) == 1 else ("or", *some)


def strings_query(strings: frozenset[str]) -> tuple | int | None:
    return either([both(trigrams(x)) for x in sorted(strings)])


def fold(text: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in text)


def _item(op, arg, flags: int) -> tuple[frozenset[str] | None, tuple | int | None]:
    """(strings, query) of one part of a parsed pattern: all folded strings it can be, or None, and what a text with a match must hold."""
    name = str(op)
    if name in ("AT", "ASSERT", "ASSERT_NOT"):
        return frozenset([""]), None
    if name == "LITERAL":
        c = chr(arg)
        if flags & re.IGNORECASE and not flags & re.ASCII and (c in _WIDE or not c.isascii()):
            return None, None
        if not c.isascii() and flags & re.IGNORECASE:
            return None, None
        return frozenset([fold(c)]), None
    if name == "IN":
        chars: set[str] = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                chars.add(chr(value))
            elif str(kind) == "RANGE" and value[1] - value[0] < 4 * CLASS:
                chars |= {chr(c) for c in range(value[0], value[1] + 1)}
            else:
                return None, None
        wide = flags & re.IGNORECASE and any(c in _WIDE or not c.isascii() for c in chars)
        folded = frozenset(map(fold, chars))
        return (None, None) if wide or len(folded) > CLASS else (folded, None)
    if name == "SUBPATTERN":
        _, add, remove, inner = arg
        return _concat(inner, (flags | add) & ~remove)
    if name == "ATOMIC_GROUP":
        return _concat(arg, flags)
    if name == "BRANCH":
        found = [_concat(x, flags) for x in arg[1]]
        if all(strings is not None for strings, _ in found):
            union = frozenset().union(*(strings for strings, _ in found))
            if len(union) <= STRINGS:
                return union, None
        return None, either([query if strings is None else strings_query(strings) for strings, query in found])
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, inner = arg
        strings, query = _concat(inner, flags)
        if high == 1 and low == 0:
            return (None, None) if strings is None else (strings | {""}, None)
        if low == 0:
            return None, None
        if strings is None:
            return None, query
        least = frozenset([""])
        for _ in range(min(low, LENGTH)):
            grown = frozenset(a + b for a in least for b in strings)
            if len(grown) > STRINGS or max(map(len, grown)) > LENGTH:
                return None, strings_query(least)
            least = grown
        return (least, None) if low == high and low <= LENGTH else (None, strings_query(least))
    return None, None


def _concat(items, flags: int) -> tuple[frozenset[str] | None, tuple | int | None]:
    """Runs of parts with known strings are multiplied out; where one ends, what it has so far must hold."""
    run, asked, whole = frozenset([""]), [], True
    for op, arg in items:
        strings, query = _item(op, arg, flags)
        grown = None if strings is None else frozenset(a + b for a in run for b in strings)
        if grown is not None and len(grown) <= STRINGS and max(map(len, grown)) <= LENGTH:
            run = grown
            continue
        whole = False
        asked.append(strings_query(run))
        asked.append(query)
        run = strings if strings is not None else frozenset([""])
    if whole:
        return run, None
    return None, both([*asked, strings_query(run)])


@functools.lru_cache(maxsize=256)
def trigram_query(pattern: str) -> tuple | int | None:
    """The query derived from a pattern: a trigram, ("and", ...), ("or", ...), or None if every text must be scanned."""
    parsed = re._parser.parse(pattern)
    strings, query = _concat(parsed, parsed.state.flags)
    return query if strings is None else strings_query(strings)


def asked_trigrams(query: tuple | int | None) -> set[int]:
    if query is None:
        return set()
    return {query} if isinstance(query, int) else set().union(*map(asked_trigrams, query[1:]))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def postings(texts: list[str], wanted: np.ndarray) -> dict[int, np.ndarray]:
    """For each wanted trigram, the indexes of the texts that contain it, ascending."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = _FOLD[np.frombuffer(b"\0\0".join(raw) + b"\0\0", np.uint8)]
    ends = np.cumsum([len(r) + 2 for r in raw])
    code = data[:-2].astype(np.uint32) << 16 | data[1:-1].astype(np.uint32) << 8 | data[2:]
    first = np.zeros(1 << 16, bool)
    first[wanted >> 8] = True
    at = np.flatnonzero(first[code >> 8])
    at = at[np.isin(code[at], wanted)]
    doc, gram = np.searchsorted(ends, at, "right"), code[at]
    return {int(g): np.unique(doc[gram == g]) for g in wanted}


def candidates(query: tuple | int | None, index: dict[int, np.ndarray], n: int) -> np.ndarray:
    """Texts that may match, ascending: postings intersected and united as the query says."""
    if query is None:
        return np.arange(n)
    if isinstance(query, int):
        return index[query]
    parts = [candidates(q, index, n) for q in query[1:]]
    if query[0] == "and":
        return functools.reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), parts)
    return functools.reduce(np.union1d, parts)


def scan(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, rule index, end), sorted."""
    texts = [t or "" for t in texts]
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = np.array(sorted(set().union(*map(asked_trigrams, queries))), np.uint32)
    index = postings(texts, wanted)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        pattern = re.compile(rule.verify or rule.pattern)
        for i in candidates(query, index, len(texts)):
            out[i] += [(m.start(), k, m.end()) for m in pattern.finditer(texts[i]) if m.end(rule.group) - m.start(rule.group) >= rule.min_chars]
    for spans in out:
        spans.sort()
    return out


def joined(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...] = RULES) -> str:
    """The text with each span, overlapping ones united, replaced by [secret:<kind of the first>]."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, k, b in spans:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([a, k, b])
    for a, k, b in merged:
        out += [text[at:a], f"[secret:{rules[k].kind}]"]
        at = b
    return "".join([*out, text[at:]])


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, with_redacted: bool = False) -> DataFrame:
    """doc_id, counts by base kind, digest of the base spans, all spans, and with with_redacted the redacted text (null stays null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"] + ["redacted"] * with_redacted
        for ids, texts in slices(batches):
            found = scan(texts, rules)
            base = [[s for s in spans if rules[s[1]].base] for spans in found]
            count = [[sum(rules[s[1]].kind == kind for s in b) for b in base] for kind in ("assign", "access", "hex")]
            cols = [pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in count)]
            cols += [pa.array([hashlib.sha256(joined(b, rules).encode()).hexdigest() for b in base], pa.string()), pa.array([joined(s, rules) for s in found], pa.string())]
            if with_redacted:
                cols.append(pa.array([t if t is None or not s else redact(t, s, rules) for t, s in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names)

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA + ", redacted string" * with_redacted)


def redact_secrets(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the same columns, secrets in the texts replaced as in redact(); chars_col, where there is one, follows the changed texts."""
    text_at = docs.columns.index(text_col)
    chars_at = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start, stop in runs(whole.column(text_at)):
                batch = whole.slice(start, stop - start)
                texts = batch.column(text_at).to_pylist()
                new = [redact(t, s, rules) if s else t for t, s in zip(texts, scan(texts, rules), strict=True)]
                cols = list(batch.columns)
                cols[text_at] = pa.array(new, pa.string())
                if chars_at is not None:
                    old = batch.column(chars_at)
                    cols[chars_at] = pa.array([n if t is u else len(u) for n, t, u in zip(old.to_pylist(), texts, new, strict=True)], old.type)
                yield pa.RecordBatch.from_arrays(cols, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return scan_secrets(table(spark, sf_dir, "documents"))
