"""BPE against the tokenizers library on every code point below U+30000 and samples above, and on marks in every order."""

import random

import numpy as np
import pytest

from lorekeep.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    path = bpe.default_path()
    lib = tokenizers.Tokenizer.from_file(path)
    lib.no_truncation()
    return bpe.WordBpe(path), lib


def same(both, texts):
    own, lib = both
    want = lib.encode_batch(texts, add_special_tokens=False)
    for start in range(0, len(texts), 20000):
        for t, (ids, shown), w in zip(texts[start:], own.encode_batch(texts[start : start + 20000]), want[start:]):
            assert np.frombuffer(ids, "<u4").tolist() == w.ids, ascii(t)
            assert shown == lib.decode(w.ids, skip_special_tokens=False), ascii(t)


def test_every_code_point(both):
    """Alone between letters, digits and signs: class, lower case and white space."""
    chars = [chr(o) for o in range(0x110000) if not 0xD800 <= o < 0xE000]
    joined = ["".join(f"a{c}b .{c}. " for c in chars[i : i + 8]) for i in range(0, 0x30000, 8)] + [f"a{c}b .{c}." for c in map(chr, range(0xE0000, 0xE0200))] + [f"a{c}b" for c in map(chr, range(0x30000, 0x110000, 97))]
    same(both, joined)


def test_marks_in_every_order(both):
    rng = random.Random(12)
    marks = [chr(o) for o in [*range(0x300, 0x370), *range(0x591, 0x5C0), *range(0x64B, 0x660), *range(0x6D6, 0x6EE), 0x7FD, 0x898, 0x8D3, 0xC3C, 0x1715, 0x1ABF, 0x1ACD, *range(0x1DF5, 0x1E00), 0x20F0, 0x302A, 0x3099, 0x309A, 0xA82C, 0x10D24, 0x1E4EF]]
    bases = "aeΣσİIıßŒA가ㄱか가中"
    same(both, ["".join(rng.choice(bases) + "".join(rng.choices(marks, k=rng.randint(0, 4))) for _ in range(6)) for _ in range(20000)])
    steady = ["".join(chr(rng.choice([*range(0x20, 0x377), *range(0x3A3, 0x52F), *range(0x1E00, 0x1F00), *range(0x1100, 0x1113), *range(0xAC00, 0xAC20)])) for _ in range(12)) for _ in range(20000)]
    same(both, steady)
