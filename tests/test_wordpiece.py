"""WordPiece counts against the tokenizers library, and the chunkers with them as counter."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lorekeep.functions.wordpiece import CONTROL, Counts, WordPieces
from lorekeep.operators import chunking as C

tokenizers = pytest.importorskip("tokenizers")


def vocabulary(rng):
    letters = "abcdefghij"
    some = {"".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(800)}
    return [*CONTROL, *sorted({("##" if rng.random() < 0.5 else "") + w for w in some} | {c for c in letters[:7]} | {f"##{c}" for c in letters[:7]} | {"é", "ß", "##ß", "日", "!", "#", "##"})]


def library(vocab):
    from tokenizers import models, normalizers, pre_tokenizers

    t = tokenizers.Tokenizer(models.WordPiece({v: i for i, v in enumerate(vocab)}, unk_token="[UNK]", max_input_chars_per_word=10**9))
    t.normalizer, t.pre_tokenizer = normalizers.BertNormalizer(lowercase=True, strip_accents=True), pre_tokenizers.BertPreTokenizer()
    return t


def test_counts():
    rng = random.Random(6)
    vocab = vocabulary(rng)
    lib, own = library(vocab), Counts(vocab)
    alphabet = "abcdefghijABC éÉßŒ日本!#-.\t\n\x00​　́¿«ı"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(4000)] + ["abc" * 100, "", "##", "a##b", " a­b"]
    texts += ["".join(c for c in map(chr, rng.choices([*range(32, 0x600), *range(0x3040, 0x3100), *range(0x4E00, 0x4F00)], k=10)) if unicodedata.category(c) != "Cs") for _ in range(2000)]
    assert [own.of(t) for t in texts] == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    assert own.of("abc" * 20000) > 10_000  # each character is looked at once
    assert own.of("a [CLS] b[SEP]") == own.of("a") + own.of("b") + 2 and own.of(None) == 0


def test_pieces():
    rng = random.Random(7)
    own = Counts(vocabulary(rng))
    for text in ["ab cd ef " * 9, "abcdefg" * 30, "a " + "zz" * 50 + " b", "x", ""]:
        cut = own.pieces(text, 5)
        assert all(n == own.of(p) and n <= 5 for p, n in cut) or own.of(text) <= 5
        assert "".join("".join(p.split()) for p, _ in cut) == "".join(text.split())
        for (p, _), (q, _) in zip(cut, cut[1:]):  # greedy: nothing of the next piece would have fitted
            assert own.of(p + q[0]) > 5 or own.of(f"{p} {q.split()[0]}") > 5


def test_chunks(spark):
    rng = random.Random(8)
    counter, own = WordPieces(vocabulary(rng)), Counts(vocabulary(random.Random(8)))
    text = " ".join(f"{' '.join(''.join(rng.choices('abcdefg', k=4)) for _ in range(rng.choice([3, 8, 60])))}." for _ in range(30))
    d = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    rows = d.select("doc_id", F.explode(C.paragraph_chunks(F.col("text"), 60, 18, 80, counter)).alias("c")).select("doc_id", "c.*").collect()
    assert rows and all(r.tokens == own.of(r.text) + 2 <= 80 for r in rows) and any(r.oversize for r in rows)
    assert all(r.tokens <= 60 for r in rows if not r.oversize)
    assert [r.n for r in d.select(counter.count(F.col("text")).alias("n")).collect()] == [own.of(text) + 2, 2, None]
    with pytest.raises(ValueError, match="UNK"):
        WordPieces(["a"])
