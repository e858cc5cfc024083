"""WordPiece counts: how many pieces of a given vocabulary a text has.

The vocabulary is a parameter: tokens as such files list them, with `##` before those that go on inside a word. It is read into a trie whose nodes have failure links, so the greedy longest match of a word looks at
each character once: where no child fits, the link names the pieces that the part read so far has at least, and the node to go on from.

Words are taken apart as uncased models do: marks dropped, lower case, control characters out, punctuation and ideographs each a word of their own. A word that the vocabulary can't cover is one unknown piece; a
control token written out in a text is one piece. Characters are classed by the Unicode tables at hand; other implementations may know some newer marks and signs differently."""

from __future__ import annotations

import re
import unicodedata
from collections import deque

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lorekeep.functions.language import split_sentences

#: Control tokens of such vocabularies; the last two frame every text (fixed values).
UNKNOWN, FRAME = "[UNK]", ["[CLS]", "[SEP]"]
CONTROL = ["[PAD]", UNKNOWN, "[MASK]", *FRAME]
#: Ideographs that are words by themselves (fixed values).
IDEOGRAPHS = [(0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F)]
#: Words whose counts a task remembers.
REMEMBER = 500_000
SIZED = ArrayType(StructType([StructField("tokens", IntegerType()), StructField("pieces", ArrayType(StructType([StructField("text", StringType()), StructField("tokens", IntegerType())])))]))


def alone(c: str) -> bool:
    """Whether a character is a word of its own."""
    o = ord(c)
    if o < 128:
        return 33 <= o <= 47 or 58 <= o <= 64 or 91 <= o <= 96 or 123 <= o <= 126
    return unicodedata.category(c)[0] == "P" or any(a <= o <= b for a, b in IDEOGRAPHS)


def plain(c: str) -> str:
    """What a character becomes before words are cut: nothing, a space, itself between spaces, or its lower-case letters."""
    if c in "\t\n\r" or unicodedata.category(c) == "Zs":
        return " "
    if ord(c) in (0, 0xFFFD) or unicodedata.category(c) in ("Cc", "Cf", "Co", "Cs"):
        return ""
    bare = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn").lower()
    return f" {bare} " if alone(c) else "".join(f" {x} " if alone(x) else x for x in bare)


class Plain(dict):
    """plain() for str.translate(), each character worked out once."""

    def __missing__(self, code: int) -> str:
        out = self[code] = plain(chr(code))
        return out


class Trie:
    """The vocabulary with failure links. `child` maps (node, character) to a node; node 0 starts a word, node 1 goes on inside one."""

    def __init__(self, vocabulary: list[str]):
        self.child: dict[tuple[int, str], int] = {}
        self.whole = [False, False]
        parent: list[tuple[int, str]] = [(0, ""), (0, "")]
        for token in vocabulary:
            at, text = (1, token[2:]) if token.startswith("##") and len(token) > 2 else (0, token)
            for c in text:
                if (at, c) not in self.child:
                    self.child[at, c] = len(parent)
                    parent.append((at, c))
                    self.whole.append(False)
                at = self.child[at, c]
            self.whole[at] = self.whole[at] or at > 1
        kids: dict[int, list[int]] = {}
        for v in range(2, len(parent)):
            kids.setdefault(parent[v][0], []).append(v)
        #: where to go on when no child fits, -1 for nowhere, and how many pieces that settles
        self.link, self.pieces = [-1] * len(parent), [0] * len(parent)
        todo = deque(kids.get(0, []) + kids.get(1, []))
        while todo:
            v = todo.popleft()
            todo.extend(kids.get(v, []))
            if self.whole[v]:
                self.link[v], self.pieces[v] = 1, 1
                continue
            up, c = parent[v]
            at, n = self.link[up], self.pieces[up]
            while at >= 0 and (at, c) not in self.child:
                n += self.pieces[at]
                at = self.link[at]
            if at >= 0:
                self.link[v], self.pieces[v] = self.child[at, c], n

    def count(self, word: str) -> int:
        """Pieces of one word; 1 where it can't be covered."""
        at, n = 0, 0
        for c in word:
            while (at, c) not in self.child:
                if self.link[at] < 0:
                    return 1
                n += self.pieces[at]
                at = self.link[at]
            at = self.child[at, c]
        while at != 1:
            if self.link[at] < 0:
                return 1
            n += self.pieces[at]
            at = self.link[at]
        return n


class Counts(dict):
    """Pieces of words, each worked out once."""

    def __init__(self, vocabulary: list[str]):
        self.trie, self.plain = Trie(vocabulary), Plain()
        self.control = re.compile("|".join(map(re.escape, CONTROL)))

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        out = self[word] = self.trie.count(word)
        return out

    def of(self, text: str | None) -> int:
        if not text:
            return 0
        control = len(self.control.findall(text)) if "[" in text else 0
        for part in self.control.split(text) if control else (text,):
            control += sum(map(self.__getitem__, part.translate(self.plain).split()))
        return control

    def pieces(self, text: str, most: int) -> list[tuple[str, int]]:
        """A text with at most `most` pieces as it is; else its words in runs that fit, and a word that doesn't fit in runs of its characters."""
        total = self.of(text)
        if total <= most:
            return [(text, total)]
        out: list[tuple[str, int]] = []
        held: list[str] = []
        size = 0
        for word in text.split():
            n = self.of(word)
            if held and size + n > most:
                out.append((" ".join(held), size))
                held, size = [], 0
            if n <= most:
                held.append(word)
                size += n
                continue
            start = 0
            while start < len(word):  # the longest run that fits, at least one character: a doubled step, then halves
                stop, step = start + 1, 1
                while stop + step <= len(word) and self.of(word[start : stop + step]) <= most:
                    stop += step
                    step *= 2
                while step:
                    if stop + step <= len(word) and self.of(word[start : stop + step]) <= most:
                        stop += step
                    step //= 2
                out.append((word[start:stop], self.of(word[start:stop])))
                start = stop
        if held:
            out.append((" ".join(held), size))
        return out


_KNOWN: dict[int, Counts] = {}


def known(vocabulary: list[str]) -> Counts:
    """The counts of a vocabulary, built once by worker."""
    key = hash(tuple(vocabulary))
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = Counts(vocabulary)
    return _KNOWN[key]


class WordPieces:
    """A counter for the chunkers; `extra` pieces frame every text. The vocabulary, as large as a model's and no larger, travels with the function."""

    def __init__(self, vocabulary: list[str], extra: int = len(FRAME)):
        if UNKNOWN not in vocabulary:
            raise ValueError(f"the vocabulary lacks {UNKNOWN}")
        self.vocabulary, self.extra = vocabulary, extra

    def counts(self, texts: Column) -> Column:
        """Pieces of each text of an array, without its frame."""
        vocabulary = self.vocabulary

        @F.arrow_udf(ArrayType(IntegerType()))
        def count(a: pa.Array) -> pa.Array:
            of = known(vocabulary).of
            return pa.array([None if x is None else [of(t) for t in x] for x in a.to_pylist()], pa.list_(pa.int32()))

        return count(texts)

    def taken(self, text: Column, target: int) -> Column:
        """(counts, sentences) of a text, for windows(): every text is taken apart, as its pieces aren't known before."""
        s = split_sentences(text)
        return F.struct(self.counts(s).alias("counts"), s.alias("sentences"))

    def whole(self, text: Column) -> Column:
        """No text is left whole by taken()."""
        return F.lit(None)

    def count(self, text: Column) -> Column:
        """Pieces of a text with its frame, null for null."""
        return F.when(text.isNotNull(), F.get(self.counts(F.array(text)), 0) + self.extra)

    def sized(self, texts: Column, ceiling: int, counted: bool) -> Column:
        """For each text of an array, its pieces without its frame (0 unless counted) and what it is cut into so that no part with its frame has more than `ceiling` pieces: (tokens, pieces of (text, tokens))."""
        vocabulary, extra = self.vocabulary, self.extra

        @F.arrow_udf(SIZED)
        def cut(a: pa.Array) -> pa.Array:
            c = known(vocabulary)
            kind = pa.list_(pa.struct([("tokens", pa.int32()), ("pieces", pa.list_(pa.struct([("text", pa.string()), ("tokens", pa.int32())])))]))
            one = lambda y: {"tokens": c.of(y) if counted else 0, "pieces": [{"text": t, "tokens": n + extra} for t, n in c.pieces(y or "", max(1, ceiling - extra))]}
            return pa.array([None if x is None else [one(y) for y in x] for x in a.to_pylist()], kind)

        return cut(texts)
