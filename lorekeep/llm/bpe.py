"""BPE encoding and decoding by a pair occurrence index.

Within a task, texts are normalised and cut at white space, and only pieces not met before are encoded. Their pre-tokens are laid
out as one linked list of symbols; an index maps each rank to all positions where its pair stands. Active ranks are taken
in ascending order from a heap, all their positions are merged, and the lists of the pairs that arise are updated.

A null text counts as empty: no ids, an empty decoded text. Repeated rows give repeated results. The vocabulary file's path is a
parameter; executors open it themselves, so it must lie at the same path on each (it is part of the image)."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, slices

#: Pieces kept from earlier texts by a Python worker; then the memory starts anew.
KEEP = 400_000


#: Characters that have had one class, one lower case and one place in canonical order since old versions of Unicode, as inclusive ranges (fixed values). Texts and pieces of others are normalised and cut by the
#: library's own components, whose Unicode version counts, not this interpreter's.
STEADY = "\x00-\u0377\u0384-\u038a\u038c\u038e-\u03a1\u03a3-\u052f\u0531-\u0556\u0561-\u0587\u0591-\u05c7\u05d0-\u05ea\u0621-\u06ff\u0901-\u0939\u093c-\u094d\u0e01-\u0e3a\u1e00-\u1eff\u2000-\u2064\u2070\u2074-\u208e\u20a0-\u20bf\u2100-\u218b\u2190-\u23ff\u2460-\u27ff\u3000-\u303f\u3041-\u3096\u3099-\u30ff\u4e00-\u9fcc\uac00-\ud7a3\ufb00-\ufb06\uff01-\uffbe\ufffd\U0001f300-\U0001f64f\U0001f680-\U0001f6c5"
ODD = re.compile(f"[^{STEADY}]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(other)) for b in range(256)]


class WordBpe:
    """A tokenizer file of kind BPE with word ends, lower case and byte-level symbols."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.rank: dict[int, int] = {}
        self.merges: list[tuple[int, int, int]] = []
        made: dict[int, int] = {}
        for r, (a, b) in enumerate(model["merges"]):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if max(made.get(x, -1), made.get(y, -1)) >= r or z in made:
                raise ValueError("a merge stands before its parts: ranks cannot be applied in ascending order")
            made[z] = r
            self.rank[x << 20 | y] = r
            self.merges.append((x, y, z))
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + self.end] for s in symbols]
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        self.pattern = regex.compile(pattern)
        self.normalizer, self.split = Tokenizer.from_file(path).normalizer, pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.space = regex.compile(r"[\x09-\x0D\x20\x85\xA0  -     　]+")
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.ids: dict[str, bytes] = {}
        self.shown: dict[str, str] = {}

    def merge(self, tokens: list[str]) -> list[list[int]]:
        """The ids of each pre-token."""
        sym: list[int] = []
        starts: list[int] = []
        inner, last, rank = self.inner, self.last, self.rank
        where: dict[int, list[int]] = {}
        nxt: list[int] = []
        prv: list[int] = []
        for t in tokens:
            raw = t.encode("utf-8", "surrogatepass")
            at, n = len(sym), len(raw)
            starts.append(at)
            own = [inner[b] for b in raw]
            own[-1] = last[raw[-1]]
            sym += own
            nxt += range(at + 1, at + n)
            nxt.append(-1)
            prv.append(-1)
            prv += range(at, at + n - 1)
            for i in range(n - 1):
                r = rank.get(own[i] << 20 | own[i + 1])
                if r is not None:
                    if r in where:
                        where[r].append(at + i)
                    else:
                        where[r] = [at + i]
        active = list(where)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            a, b, new = self.merges[r]
            positions = where.pop(r)
            positions.sort()
            for p in positions:
                if sym[p] != a or (q := nxt[p]) < 0 or sym[q] != b:
                    continue  # the pair has gone since
                sym[p], sym[q] = new, -1
                after, before = nxt[q], prv[p]
                nxt[p] = after
                if after >= 0:
                    prv[after] = p
                    s = rank.get(new << 20 | sym[after])
                    if s is not None:
                        if s in where:
                            where[s].append(p)
                        else:
                            where[s] = [p]
                            heapq.heappush(active, s)
                if before >= 0:
                    s = rank.get(sym[before] << 20 | new)
                    if s is not None:
                        if s in where:
                            where[s].append(before)
                        else:
                            where[s] = [before]
                            heapq.heappush(active, s)
        ends = [*starts[1:], len(sym)][: len(starts)]
        return [[x for x in sym[a:b] if x >= 0] for a, b in zip(starts, ends, strict=True)]

    def learn(self, pieces: set[str]) -> None:
        """Puts pieces (texts without white space) into the memory."""
        split = {p: self.pattern.findall(p) if p.isascii() or not ODD.search(p) else [t for t, _ in self.split.pre_tokenize_str(p)] for p in pieces}
        tokens = list({t for own in split.values() for t in own})
        ids = dict(zip(tokens, self.merge(tokens), strict=True))
        names = self.names
        for p, own in split.items():
            flat = [i for t in own for i in ids[t]]
            self.ids[p] = np.array(flat, "<u4").tobytes()
            self.shown[p] = " ".join([names[i] for i in flat])

    def pieces(self, text: str) -> list[str]:
        if not text.isascii():
            if ODD.search(text):
                return [x for x in self.normalizer.normalize_str(text).split(" ") if x]
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python's split() only
            return [x for x in self.space.split(text) if x]
        return text.split()

    def parts(self, text: str) -> list[str | int]:
        """Pieces, and the ids of special tokens that stand in the text."""
        if self.cut is None or "<|" not in text:
            return self.pieces(text)
        out: list[str | int] = []
        for i, x in enumerate(self.cut.split(text)):
            out += [self.special[x]] if i % 2 else self.pieces(x)
        return out

    def encode_batch(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """For each text its ids, little-endian unsigned 32-bit, and the decoded text."""
        split = [self.parts(t or "") for t in texts]
        if len(self.ids) > KEEP:
            self.ids.clear()
            self.shown.clear()
        new = set().union(*split).difference(self.ids)
        for i in [x for x in new if isinstance(x, int)]:
            self.ids[i], self.shown[i] = np.array([i], "<u4").tobytes(), self.names[i]  # type: ignore[index]
            new.discard(i)
        self.learn(new)
        ids, shown = self.ids.__getitem__, self.shown.__getitem__
        # pieces without a token (none with this pattern) would give empty strings and are left out
        return [(b"".join(map(ids, own)), " ".join(filter(None, map(shown, own)))) for own in split]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.names[i] for i in ids)


_LOADED: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded text; with_ids adds ids (array of int), with_text adds decoded."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids + ["decoded"] * with_text
        bpe = tokenizer(path)
        for keys, texts in slices(batches, 2 << 20):
            done = bpe.encode_batch(texts)
            cols = [pa.array(keys, pa.int64()), pa.array([len(x) // 4 for x, _ in done], pa.int64())]
            cols += [pa.array([hashlib.sha256(x).hexdigest() for x, _ in done]), pa.array([hashlib.sha256(s.encode()).hexdigest() for _, s in done])]
            if with_ids:
                ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x, _ in done]))).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(x for x, _ in done), "<u4").astype(np.int32))))
            if with_text:
                cols.append(pa.array([s for _, s in done], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text
    return id_text(docs, id_col, text_col).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return encode_decode(table(spark, sf_dir, "documents"))
