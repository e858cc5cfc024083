"""Operators for training data against brute force, on small fixtures with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import bpe, chat_format, decontaminate, license_scan, near_dedup, quality_model, quality_rules, secrets, substring_dedup, toxicity
from lorekeep.llm import queries as registered
from lorekeep.llm.components import components

DATA = "/root/testdata/sf0.001"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return SPLIT.findall(t or "")


def fixture():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)] + ["Été", "ßa", "THE", "the"]
    texts = [" ".join(rng.choices(vocab, k=rng.choice([1, 2, 5, 40, 120]))) for _ in range(40)]
    shared = " ".join(rng.choices(vocab, k=30))
    texts += [f"{texts[i]}\n{shared} {texts[i + 1]}" for i in range(6)] + [shared, shared, None, "", " \n\t", "a\xa0b", "x " * 3000, shared.upper()]
    near = " ".join(rng.choices(vocab, k=200)).split()
    for k in range(5):
        copy = list(near)
        copy[10 * k] = "changed"
        texts.append(" ".join(copy))
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def rows():
    return fixture()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Columns that operators use inside have namesakes here."""
    return spark.createDataFrame([(i, t, "k", i, "s") for i, t in rows], "doc_id long, text string, bucket string, n long, id string").repartition(3)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.mark.parametrize("budget", [1 << 17, 4])
def test_substring_dedup(rows, docs, budget):
    first = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), i)
    got = by_id(substring_dedup.remove_repeats(docs, budget=budget, with_text=True))
    for i, t in rows:
        w = words(t)
        gone = {p + k for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < i for k in range(13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept, got[i].kept_sha256) == (len(w), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest())
    assert any(r.n_removed for r in got.values())


def shingles(t, size):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def groups(rows, size):
    sets = {i: shingles(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("size", [2, 5])
def test_near_dedup(rows, docs, size):
    got = by_id(near_dedup.near_duplicates(docs, size=size))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == groups(rows, size)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def edited(base, sites, word):
    """The words of base with those at the sites replaced."""
    out = list(base)
    for k in sites:
        out[k] = f"{word}{k}"
    return " ".join(out)


def test_near_dedup_star(spark):
    """Thousands of copies linked to the base text alone, not to each other."""
    rng = random.Random(11)
    base = [f"b{k}" for k in range(300)]
    texts = [edited(base, [10 * k + 5 for k in rng.sample(range(29), 5)], f"e{i}x") for i in range(3000)]
    rows = [(i + 7, t) for i, t in enumerate(texts)] + [(5000, " ".join(base))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {i: 7 for i, _ in rows}


def test_near_dedup_bridge(spark):
    """Two groups of close copies; only one pair, neither of them central, links a member of one to a member of the other."""
    base = [f"b2x{k}" for k in range(300)]
    sites = [10 * k + 5 for k in range(8)]
    other = edited(base, sites, "o").split()
    texts = [edited(base, [299], f"p{i}x") for i in range(120)] + [edited(other, [299], f"q{i}x") for i in range(120)]
    texts += [edited(base, sites[:1], "o"), edited(base, sites[:7], "o")]
    rows = list(enumerate(texts))
    want = groups(rows, 5)
    assert {c for _, c in want.values()} == {0} and len({c for _, c in groups(rows[:-1], 5).values()}) == 2
    got = by_id(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def least_edits(item, text):
    """Fewest edits between the item and any run of the text's words."""
    code = {w: k for k, w in enumerate({*item, *text})}
    t, at = np.array([code[w] for w in text], int), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, int)
    for i, x in enumerate(item, 1):
        new = np.concatenate(([i], np.minimum(row[1:] + 1, row[:-1] + (t != code[x]))))
        row = np.minimum.accumulate(new - at) + at
    return row.min()


def test_decontamination(spark):
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([6, 13, 30, 50])))) for i in range(12)] + [(50, None), (51, ""), (52, "v1")]
    texts = []
    for k in range(60):
        part = (items[k % 12][1]).split()
        for _ in range(k % 7):
            at = rng.randrange(len(part))
            part[at : at + 1] = rng.choice([[], ["edited"], [part[at], "added"]])
            part = part or ["x"]
        texts.append(" ".join(rng.choices(vocab, k=40) + [p.upper() for p in part] + rng.choices(vocab, k=20)))
    texts += [None, "", "v1", "v2 " * 4000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string")
    fold = lambda t: [w.lower() for w in words(t)]
    want = {i: sorted(k for k, t in items if words(t) and least_edits(fold(t), fold(x)) <= len(words(t)) * 20 // 100) for i, x in enumerate(texts)}
    assert {r.doc_id: list(r.item_ids) for r in decontaminate.find_leaks(d, it).collect()} == want
    assert {r.doc_id: list(r.item_ids) for r in decontaminate.find_leaks(d, it, block_chars=300).collect()} == want


def test_bpe(spark, rows, docs):
    from tokenizers import Tokenizer

    odd = ["don't I'LL", "日本語 ١٢3", "<|endoftext|>a <|startoftext|>", "ΑΣ Σ", "İx ǅ", "a\x1cb c　", "é", "🙂🙂", "!!?? 12345", "�", "z" * 3000]
    texts = [t for _, t in rows] + odd
    t = Tokenizer.from_file(bpe.default_path())
    t.no_padding(), t.no_truncation()
    got = by_id(bpe.encode_decode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_ids=True, with_text=True))
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert list(got[i].ids) == ids and got[i].decoded == t.decode(ids, skip_special_tokens=False), repr(text)


def test_secrets(spark):
    a, h = "A" * 30, "0123456789abcdef" * 2
    texts = [f'password = "{a}" x', "PASSWD: short", f"API_key={a} apikey: {a}", "AKIA" + "B" * 16, "AKIAB", f"é {h} {h[:23]}", None, "", f"token = {h}", "-----BEGIN RSA PRIVATE KEY-----", f"secretsecret:{a}"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(secrets.scan_secrets(d, with_redacted=True))
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for i, t in enumerate(texts):
        spans = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(t or "") if len(m[2]) >= 6]
        spans += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 20]
        spans += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", t or "") if len(m[0]) >= 24]
        assert got[i].base_sha256 == hashlib.sha256(",".join(x for *_, x in sorted(spans)).encode()).hexdigest()
        assert got[i].n_assign + got[i].n_access + got[i].n_hex == len(spans)
    assert got[0].redacted == "[secret:assign]\" x" and "private_key" in got[9].spans and got[6].redacted is None


def test_private_key_body():
    head, end, body = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "\n".join(["MIIE" + "Ab+/" * 15] * 3 + ["Zm9v=="])
    texts = [f"a {head}\n{body}\n{end} b", f"a {head}\nProc-Type: 4,ENCRYPTED\n\n{body}\nplain words follow", f"{head} {body} {head}\n{body}\n{end} z", f"{head}\\n{'Ab+/' * 15}\\n{end}\"", head]
    got = [secrets.redact(t, s) for t, s in zip(texts, secrets.scan(texts), strict=True)]
    assert got[:2] == ["a [secret:private_key] b", "a [secret:private_key]\nplain words follow"] and got[3:] == ['[secret:private_key]"', "[secret:private_key]"]
    assert got[2].endswith("[secret:private_key] z") and got[2].count("[secret") == 2


def test_quality_rules(rows, docs):
    got = by_id(quality_rules.apply_rules(docs))
    for i, t in rows:
        w = words(t)
        win = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        rep = {p + k for p, x in enumerate(win) if win.count(x) > 1 for k in range(3)} if len(win) < 2900 else set(range(len(w)))
        lines = [x for x in (t or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(rep))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_chat_links(spark):
    m = [
        (1, 0, "user", "hi", None, None),
        (1, 1, "assistant", None, [("a", "f", '{"y":2.0,"x":1}', ["b"]), ("b", "f", '{"x":"s"}', None), ("b", "f", '{"x":1}', None)], None),
        (1, 2, "tool", "ra", None, "a"),
        (1, 3, "tool", "rb", None, "b"),
        (1, 4, "tool", "rb again", None, "b"),
        (1, 5, "tool", "none", None, "zz"),
        (2, 0, "assistant", "c", [("p", "f", '{"x":1}', ["q"]), ("q", "f", '{"x":1}', ["p"]), (None, "f", "{}", None), ("m", "f", "oops", None), ("u", "g", "{}", None)], None),
        (None, 0, None, None, None, None),
    ]
    d = spark.createDataFrame(m, "conv_id long, turn long, role string, content string, tool_calls " + chat_format.CALLS + ", tool_call_id string").withColumn("id", F.lit("clash"))
    tools = spark.createDataFrame([("f", "x", "integer", True), ("f", "y", "number", False)], "name string, param string, type string, required boolean")
    got = chat_format.format_chats(d, tools).collect()
    status = {(r.conv_id, r.turn, r.part, r.kind): (r.status, r.errors) for r in got}
    assert status[1, 1, 1, "call"] == ("ok", "") and status[1, 1, 2, "call"] == ("invalid", "type x") and status[1, 1, 3, "call"][0] == "duplicate"
    assert [status[1, t, 0, "result"][0] for t in (2, 3, 4, 5)] == ["ok", "ok", "duplicate", "orphan"]
    assert [status[2, 0, k, "call"][0] for k in (1, 2, 3, 4, 5)] == ["cyclic", "cyclic", "no_id", "malformed", "unknown_tool"]
    order = [r.call_id + r.kind[0] for r in sorted((r for r in got if r.conv_id == 1 and r.call_id in ("a", "b") and r.status != "duplicate"), key=lambda r: (r.order_turn, r.order_part, r.order_depth, r.order_kind))]
    assert order == ["bc", "br", "ac", "ar"]  # a waits for the result of b
    assert next(r.json for r in got if r.call_id == "a" and r.kind == "call") == '{"arguments":{"x":1,"y":2},"id":"a","name":"f"}'


def test_licenses(spark):
    f = [(1, "/* Licensed under the Apache License,\n * Version 2.0. */\ncode", "p/a/x.c"), (2, "Released under the MIT License.", "p/LICENSE"), (3, "nothing here", "p/b/c/y.c"), (4, None, "p/z"), (5, "", None), (6, "licensed by nobody", "q/r.c"), (7, "This work is licensed under the GNU General Public License, version 3.", "p/b/COPYING"), (3, "nothing here", "p/b/c/y.c")]
    got = {r.doc_id: (r.own_license, r.license, r.license_from) for r in license_scan.scan_licenses(spark.createDataFrame(f, "doc_id long, text string, path string")).collect()}
    assert got == {1: ("Apache-2.0", "Apache-2.0", "own"), 2: ("MIT", "MIT", "own"), 3: (None, "GPL-3.0", "p/b"), 4: (None, "MIT", "p"), 5: (None, None, None), 6: (None, None, None), 7: ("GPL-3.0", "GPL-3.0", "own")}


def accuracy(spark, got, label, threshold):
    lab = {r.doc_id: r[label] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [(r.score, lab[r.doc_id]) for r in got if r.held_out and r.doc_id in lab]
    assert len(rows) > 30
    return sum((s >= threshold) == bool(y) for s, y in rows) / len(rows)


def test_classifiers(spark):
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    tox = toxicity.toxicity(read("documents"), read("labels")).collect()
    assert accuracy(spark, tox, "toxic", 0.5) > 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in tox)
    good = quality_model.quality(read("documents"), read("labels")).collect()
    assert accuracy(spark, good, "quality", 0.7) > 0.85


def test_counterfactual_penalty():
    rows = [[1, 2], [1, 3], [4, 2], [4, 3]] * 5
    y = np.array([1, 1, 0, 1] * 5, float)
    swap = [([1, 4], [-1.0, 1.0])] * 20
    free, tied = toxicity.fit(rows, y, swap, counterfactual=0.0)[0], toxicity.fit(rows, y, swap, counterfactual=100.0)[0]
    assert abs(tied[4] - tied[1]) < 0.2 * abs(free[4] - free[1])


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(None, "a b"), (2, None), (2, None)], "doc_id long, text string")
    for out in (toxicity.toxicity(d, lab), substring_dedup.remove_repeats(d), decontaminate.find_leaks(d, items), bpe.encode_decode(d), near_dedup.near_duplicates(d), secrets.scan_secrets(d), secrets.redact_secrets(d), quality_model.quality(d, lab), quality_rules.apply_rules(d)):
        assert out.count() == 0
    for out in (toxicity.toxicity(some, lab), substring_dedup.remove_repeats(some), decontaminate.find_leaks(some, items), bpe.encode_decode(some), near_dedup.near_duplicates(some), secrets.scan_secrets(some), quality_model.quality(some, lab), quality_rules.apply_rules(some)):
        assert out.count() == 3


@pytest.mark.parametrize("name", [n for n in registered.ORACLE_SQL if n != "op2_substring_dedup"])
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = registered.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    norm = lambda r: repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r))
    assert sorted(map(norm, df.select(cols).collect())) == sorted(map(norm, con.sql(f"select {', '.join(cols)} from ({registered.ORACLE_SQL[name]})").fetchall()))
