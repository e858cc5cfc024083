"""The methods themselves against brute force: links in dense groups, suffix trees, derived trigram queries, order of calls, scores by hand."""

import itertools
import math
import random
import re

import numpy as np
import pytest

from lorekeep.llm import bpe, chat_format, decontaminate, license_scan, near_dedup, quality_model, secrets, substring_dedup, toxicity
from lorekeep.llm.components import components, roots_of

from .test_operators import by_id, edited, groups, words


def dense_groups(seed, size, bridges):
    """Two groups of texts close to one base each, a few texts half way between."""
    rng = random.Random(seed)
    base = [f"a{k}" for k in range(200)]
    far = edited(base, range(0, 200, 20), "f").split()
    texts = [edited(b, rng.sample(range(200), 3), f"{name}{i}x") for name, b in (("p", base), ("q", far)) for i in range(size)]
    texts += [edited(base, range(0, 20 * k, 20), "f") for k in bridges]
    rng.shuffle(texts)
    return list(enumerate(texts))


def exact_components(rows, size):
    vocabulary: dict = {}
    sets = [{vocabulary.setdefault(tuple(w[i : i + size]), len(vocabulary)) for i in range(len(w) - size + 1)} for w in (t.split() for _, t in rows)]
    m = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, s in enumerate(sets):
        m[i, list(s)] = 1
    both, n = m @ m.T, m.sum(axis=1)
    i, j = np.nonzero(np.triu(100 * both >= 80 * (n[:, None] + n[None, :] - both), 1))
    return roots_of(i, j, len(rows)), np.stack([i, j], axis=1)


@pytest.mark.parametrize("seed,bridges,limits", [(1, (5,), {}), (2, (4, 6), {}), (3, (), {}), (4, (5,), {"max_rows": 300}), (5, (4, 6), {"max_shingles": 30_000})])
def test_dense_groups(spark, seed, bridges, limits):
    """Equal to exact similarity of all pairs, in one block and dealt to several."""
    rows = dense_groups(seed, 800, bridges)
    want, _ = exact_components(rows, 2)
    got = by_id(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), size=2, **limits))
    assert [got[i].component_id for i, _ in rows] == want.tolist()


def test_region_recall():
    """Share of true links that lie in one likely component; over all seeds none is lost."""
    lost = total = 0
    for seed in range(6):
        rows = dense_groups(seed, 150, (4, 6))
        _, links = exact_components(rows, 2)
        sets = near_dedup.shingle_sets([t for _, t in rows], 2)
        sig = np.stack([near_dedup.signature(s) for s in sets])
        paths = sig.reshape(len(rows), near_dedup.TREES, near_dedup.DEPTH)[:, :, : near_dedup.START]
        low, n = (sig & 0xFF).astype(np.uint8), np.array([len(s) for s in sets])
        a, b = [], []
        for tree in range(near_dedup.TREES):
            _, key = np.unique(paths[:, tree], axis=0, return_inverse=True)
            order = np.argsort(key, kind="stable")
            x, y = near_dedup.region_forest(key[order], order, n[order], low[order], 80)
            a.append(x)
            b.append(y)
        root = roots_of(np.concatenate(a), np.concatenate(b), len(rows))
        lost += int((root[links[:, 0]] != root[links[:, 1]]).sum())
        total += len(links)
    assert total > 100_000 and lost == 0


def test_repeated_ids_with_two_texts(spark):
    """Rows of one id are judged each by its own text; the id's rows meet where both are the smallest of their class."""
    one, two = "a b c d e f g h", "p q r s t u v w"
    rows = [(1, one), (1, two), (2, one), (3, two), (3, two), (None, one)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect())
    assert got == [(False, 1, 1, True), (False, 1, 1, True), (False, 2, 1, False), (False, 3, 1, False), (False, 3, 1, False), (True, 0, 0, True)]


def test_components_of_chains(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 300) if i % 50 != 49] + [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)]
    rng.shuffle(links)
    root = roots_of(np.array([a for a, _ in links]), np.array([b for _, b in links]), 500)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert got == {int(i): int(root[i]) for a, b in links if a != b for i in (a, b)}


@pytest.mark.parametrize("window", [1, 2, 3, 5, 13])
def test_suffix_trees(window):
    """Deep nodes of the anchored suffixes are the repeated windows of a brute force; neighbours join to its maximal repeated spans."""
    rng = random.Random(window)
    for _ in range(12):
        vocabulary = [f"w{i}" for i in range(rng.choice([2, 5, 40]))]
        shared = [rng.choices(vocabulary, k=rng.randint(5, 40)) for _ in range(3)]
        texts = [rng.choice([" ", "\n", " \t "]).join(itertools.chain(*[rng.choice(shared) if rng.random() < 0.6 else rng.choices(vocabulary, k=rng.randint(0, 30)) for _ in range(rng.randint(0, 5))])) for _ in range(12)]
        first, want = {}, set()
        for i, t in enumerate(texts):
            w = t.split()
            for p in range(len(w) - window + 1):
                if first.setdefault(tuple(w[p : p + window]), i) < i:
                    want.add((i, p))
        s = substring_dedup.suffixes(list(range(12)), texts, window)
        found = substring_dedup.contexts(s, np.arange(len(s.doc))).split() if len(s.doc) else []
        codes = np.unique(np.array(found), return_inverse=True)[1] if found else np.zeros(0, np.int64)
        d, p = substring_dedup.deep_repeats(s.doc, s.pos, s.left, s.windows, codes, window)
        assert sorted(zip(d.tolist(), p.tolist(), strict=True)) == sorted(want)


def test_maximal_repeats_of_a_tree():
    """Nodes of a tree of plain suffixes: for each depth, runs of suffixes with that many common words."""
    text = list("abracadabra")
    m = np.array([[ord(text[i + k]) if i + k < len(text) else -1 for k in range(len(text))] for i in range(len(text))])
    tree = substring_dedup.Tree(m)
    repeats = {"".join(text[at[0] : at[0] + d]) for d in range(1, 6) for node in np.unique(tree.nodes(d)) if len(at := np.flatnonzero(tree.nodes(d) == node)) > 1 if at.max() + d <= len(text)}
    assert repeats == {"a", "b", "r", "ab", "br", "ra", "abr", "bra", "abra"}


@pytest.mark.parametrize("bins", [None, 4])
def test_hot_prefixes(spark, bins):
    """A passage in most documents, and bins that hold too much at every level: windows by digest, same result."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(30)]
    texts = [" ".join(rng.choices([f"v{i}" for i in range(50)], k=20) + (passage if i % 3 else []) + rng.choices([f"v{i}" for i in range(50)], k=9)) for i in range(90)]
    first, want = {}, {}
    for i, t in enumerate(texts):
        w = t.split()
        gone = {p + k for p in range(len(w) - 12) if first.setdefault(tuple(w[p : p + 13]), i) < i for k in range(13)}
        want[i] = len(gone)
    rows = [*enumerate(texts), (None, texts[1])]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), budget=20, bins=bins).collect()
    assert {r.doc_id: r.n_removed for r in got} == want | {None: 0}


ATOMS = ["ab", "key", "x?", "[abc]", "(?:foo|bar)", "(?:to|token|)", "q{2}", "z{2,4}", "\\d", ".", "[^a]", "w+", "(?:hi)*", "(se)(cr)et", "(?i:AbC)", "\\bend", "é", "[a-z]", "(?:a|b|c)(?:d|e)"]


def sample(pattern, rng):
    """A string that the parts of a pattern admit."""
    pick = {"x?": ["", "x"], "[abc]": list("abc"), "(?:foo|bar)": ["foo", "bar"], "(?:to|token|)": ["to", "token", ""], "q{2}": ["qq"], "z{2,4}": ["zz", "zzzz"], "\\d": ["7"], ".": ["-", "k"], "[^a]": ["b", " "], "w+": ["w", "www"], "(?:hi)*": ["", "hihi"], "(se)(cr)et": ["secret"], "(?i:AbC)": ["ABC", "abc"], "\\bend": ["end"], "[a-z]": ["m"], "(?:a|b|c)(?:d|e)": ["ad", "ce"]}
    return "".join(rng.choice(pick.get(a, [a])) for a in pattern)


def test_queries_are_supersets():
    """Candidates of a derived query hold every text that the pattern matches, for generated patterns, also under flags."""
    rng = random.Random(7)
    full = 0
    for _ in range(400):
        parts = rng.choices(ATOMS, k=rng.randint(1, 6))
        pattern = rng.choice(["", "", "(?i)"]) + "".join(parts)
        texts = [rng.choice(["", "lead ", "ſK"]) + sample(rng.choice([parts, rng.choices(ATOMS, k=3)]), rng) + rng.choice(["", " tail"]) for _ in range(30)]
        texts += [t.upper() for t in texts[:5]]
        query = secrets.trigram_query(pattern)
        full += query is None
        grams = np.array(sorted(secrets.asked_trigrams(query)), np.uint32)
        found = set(secrets.candidates(query, secrets.postings(texts, grams), len(texts)).tolist())
        assert found >= {i for i, t in enumerate(texts) if re.search(pattern, t)}, pattern
    assert full < 330
    assert secrets.trigram_query("[0-9a-f]+") is None and secrets.trigram_query("AKIA[A-Z0-9]+") is not None
    abc, bcd, xyz = (secrets.trigram_query(t) for t in ("abc", "bcd", "xyz"))
    assert secrets.trigram_query("abcd|xyz") == ("or", ("and", abc, bcd), xyz)


def test_rules_by_pattern_alone():
    """A caller's rule needs no literals, and one of a known name is its own."""
    mine = (secrets.Rule("hex", r"0x[0-9a-f]{4,}"), secrets.Rule("pin", r"(?i)pin code: [0-9]{4}"))
    assert secrets.scan(["PIN CODE: 1234 0xabcdef", "deadbeef" * 5], mine) == [[(0, 1, 14), (15, 0, 23)], []]


def chat(spark, calls, results=()):
    rows = [(1, t, "assistant", None, [(c, "f", "{}", after) for c, after in group], None) for t, group in calls] + [(1, t, "tool", "r", None, c) for t, c in results]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, content string, tool_calls " + chat_format.CALLS + ", tool_call_id string")
    tools = spark.createDataFrame([], "name string, param string, type string, required boolean")
    return chat_format.format_chats(d, tools).where("kind = 'call'").collect()


def test_forward_waits(spark):
    """A call moves behind all that it waits for, also over several steps and to a result that comes late."""
    got = {r.call_id: (r.order_turn, r.order_part, r.order_depth) for r in chat(spark, [(0, [("a", ["c"]), ("b", ["a"])]), (1, [("c", ["d"])]), (2, [("d", None)]), (3, [("e", ["a", "d"])])], [(5, "d")])}
    assert got["d"] == (2, 1, 0) and got["c"] == (5, 0, 1) and got["a"] == (5, 0, 2) and got["b"] == (5, 0, 3) and got["e"] == (5, 0, 3)


def test_long_chain(spark):
    """Every call waits for the next one: as many rounds as the chain has steps, one table of placed calls."""
    n = 14
    got = {r.call_id: (r.order_turn, r.order_part, r.order_depth) for r in chat(spark, [(0, [(f"c{i}", [f"c{i + 1}"] if i + 1 < n else None) for i in range(n)])])}
    assert got == {f"c{i}": (0, n, n - 1 - i) for i in range(n)}


def test_circles(spark):
    """Calls in a circle of any size, and what waits for them, keep their place."""
    n = 12
    got = chat(spark, [(0, [(f"c{i}", [f"c{(i + 1) % n}"]) for i in range(n)] + [("after", ["c0"]), ("free", None)])])
    assert {r.call_id for r in got if r.order_depth == 0} == {r.call_id for r in got} and len(got) == n + 2


def score_by_hand(text, w, b):
    tokens = [x for x in ((t or "").lower().strip(toxicity.PUNCTUATION) for t in (text or "").split()) if x]
    f = {toxicity.bucket(x) for x in tokens}
    for i, x in enumerate(tokens):
        if any(x in terms for terms in toxicity.IDENTITY.values()):
            f |= {toxicity.bucket(f"{tokens[i - 1] if i else ''} {x}"), toxicity.bucket(f"{x} {tokens[i + 1] if i + 1 < len(tokens) else ''}")}
    return 1 / (1 + math.exp(-(sum(w[i] for i in sorted(f)) + b)))


ODD = ["You, woman!", "old MEN and young men", "", None, "x " * 4000, "plain words", "plain words", "*#* ,"]


def test_toxicity_scores_by_hand(spark):
    rng = np.random.default_rng(3)
    w = rng.normal(0, 0.02, toxicity.SIZE)
    d = spark.createDataFrame([(i, t, "k") for i, t in enumerate(ODD)], "doc_id long, text string, score string")
    got = {r.doc_id: r.score for r in toxicity.score(d, (w, -0.3)).collect()}
    assert all(abs(got[i] - score_by_hand(t, w.astype(np.float32), -0.3)) < 1e-5 for i, t in enumerate(ODD))


def test_swaps_change_less_with_the_penalty(spark):
    """End to end: the score of a neutral sentence moves less when its identity term is swapped, and labels of held-out rows stay unread."""
    bad, good = "you are a stupid hateful {}", "a {} went to the market with friends"
    rows, k = [], 0
    for i in range(300):
        term = ["muslim", "christian", "jewish", "hindu"][0 if i % 2 == 0 and i % 10 < 8 else i % 4]
        rows.append((k, (bad if i % 2 == 0 else good).format(term), int(i % 2 == 0)))
        k += 1
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    changes = {}
    for swaps in (0, 2):
        w, b = toxicity.train(docs, labels, "toxic", lambda c: c >= 0, swaps=swaps)
        scores = [score_by_hand(good.format(t), w, b) for t in ("muslim", "christian", "jewish", "hindu")]
        changes[swaps] = max(scores) - min(scores)
    assert changes[2] < changes[0]


def test_quality_scores_by_hand(spark):
    """Sum of one bin of each table, found by counting edges, against the vectorised form."""
    rng = np.random.default_rng(5)
    x = rng.random((200, len(quality_model.FEATURES)))
    model = quality_model.fit(x, (x[:, 0] + x[:, 1] > 1).astype(float), rounds=8)
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)], "doc_id long, text string, y int")
    got = {r.doc_id: r.score for r in quality_model.score(d, model).collect()}
    for i, t in enumerate(ODD):
        f = quality_model.features(t)
        at = lambda edges, v: sum(v >= e for e in edges)
        z = model.base + sum(table[at(e, v)] for table, e, v in zip(model.tables, model.edges, f, strict=True)) + sum(table[at(model.coarse[a], f[a])][at(model.coarse[b], f[b])] for a, b, table in model.pairs)
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-9


def test_sample_is_bounded(spark):
    """An id that repeats without end gives one row; ids and labels that repeat give the least."""
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.labelled(docs, labels, "toxic", lambda c: c >= 0, 10).collect()
    assert sorted((r.doc_id, r.text or "", r.y) for r in got) == [(1, "text 0", 0), (2, "", 1)]


def test_repeated_rows_and_clashing_columns(spark):
    """Repeated rows give repeated results; columns named like an operator's own don't matter; items without an id or words match nothing."""
    text = "Licensed under the Apache License, Version 2.0. \npassword = abcdefgh1 " + "filler " * 3000
    rows = [(1, text, "a/b.c", "x", 1), (1, text, "a/b.c", "x", 1), (None, None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, path string, score string, turn int").selectExpr("*", "1 as n_assign", "'q' as item_ids", "'z' as license")
    items = spark.createDataFrame([(None, "filler filler filler filler"), (7, None), (8, " ")], "item_id long, text string").selectExpr("*", "1 as doc_id")
    found = [r for r in secrets.scan_secrets(d).collect() if r.doc_id == 1]
    assert len(found) == 2 and all(r.n_assign == 1 for r in found)
    assert [r.own_license for r in license_scan.scan_licenses(d).collect() if r.doc_id == 1] == ["Apache-2.0"] * 2
    assert [r.contaminated for r in decontaminate.find_leaks(d, items).collect()].count(True) == 0
    assert len({r.ids_sha256 for r in bpe.encode_decode(d).collect() if r.doc_id == 1}) == 1


@pytest.mark.parametrize("length,edits", [(10, 2), (20, 4), (40, 8), (80, 16)])
def test_decontamination_recall(spark, length, edits):
    """Items with as many edits as are allowed (a fifth of their words), each in a text of its own: at least 0.9 are found at any length."""
    rng = random.Random(length)
    vocabulary = [f"v{i}" for i in range(500)]
    items = [(i, " ".join(rng.choices(vocabulary, k=length))) for i in range(40)]
    texts = []
    for i, t in items:
        w = t.split()
        for at in rng.sample(range(length), edits):
            w[at] = f"e{at}"
        texts.append((i, " ".join(rng.choices(vocabulary, k=30) + w + rng.choices(vocabulary, k=30))))
    got = by_id(decontaminate.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert sum(i in got[i].item_ids for i, _ in items) >= 36


MIT_FILE = """MIT License

Copyright (c) 2021 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
GPL_HEADER = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
 */
int main() {}"""
GPL_FILE = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc.
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works.
"""
APACHE_FILE = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document.
"""


def test_real_licence_files(spark):
    rest = " ".join(f"further clause {i} of the text" for i in range(200))
    files = [(1, MIT_FILE, "m/LICENSE"), (2, "code", "m/src/a.c"), (3, GPL_FILE + rest, "g/COPYING"), (4, GPL_HEADER, "n/x.c"), (5, APACHE_FILE + rest, "a/LICENSE.txt"), (6, None, "a/b/c")]
    bsd = license_scan._BSD_START + "\n\n" + license_scan._BSD_THIRD + "\n\n" + license_scan._BSD_END
    files += [(7, "Copyright (c) 2019, B\n\n" + bsd, "b/LICENSE"), (8, "Copyright (c) 2019, B\n\n" + bsd.replace(license_scan._BSD_THIRD, ""), "b2/LICENSE")]
    got = {r.doc_id: r.license for r in license_scan.scan_licenses(spark.createDataFrame(files, "doc_id long, text string, path string")).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "GPL-3.0", 4: "GPL-3.0", 5: "Apache-2.0", 6: "Apache-2.0", 7: "BSD-3-Clause", 8: "BSD-2-Clause"}


def test_licences_of_any_shape(spark):
    """One line, comment runs with code right after them, indented blocks, deep in a page-long paragraph."""
    code = "\n".join(f"x{i} = call({i}, 'value')" for i in range(40))
    mit, gpl = " ".join(MIT_FILE.split()), " ".join(w for w in GPL_HEADER.replace("int main() {}", "").split() if w not in ("/*", "*", "*/"))
    marked = lambda text, mark: "\n".join(f"{mark} {' '.join(text.split()[i : i + 9])}" for i in range(0, len(text.split()), 9))
    bsd = license_scan._BSD_START + license_scan._BSD_THIRD + license_scan._BSD_END
    words = bsd.split()
    indented = "\n".join(" " * 280 + " ".join(words[i : i + 12]) for i in range(0, len(words), 12))
    prose = " ".join(f"plain prose number {i} goes on" for i in range(400))
    unlicense = license_scan._UNLICENSE
    texts = [mit, gpl, marked(gpl, "#") + "\n" + code, marked(mit, "//") + "\n" + code, indented, f"{prose} {mit} {prose}", f"{prose} {gpl} {prose}", unlicense, f"{prose} {unlicense} {prose}", code, prose, "license " * 400, mit * 3]
    files = [(i, t, f"d{i}/f.txt") for i, t in enumerate(texts)]
    got = {r.doc_id: r.own_license for r in license_scan.scan_licenses(spark.createDataFrame(files, "doc_id long, text string, path string")).collect()}
    want = ["MIT", "GPL-3.0", "GPL-3.0", "MIT", "BSD-3-Clause", "MIT", "GPL-3.0", "Unlicense", "Unlicense", None, None, None, "MIT"]
    assert got == dict(enumerate(want))
    assert len(indented) > 4000


def test_words_are_the_contract_s():
    assert [len(words(t)) for t in ("a\xa0b", "a\x0bb", " ", None)] == [1, 2, 0, 0] and groups([(0, "A b"), (1, "a B"), (2, "")], 2) == {0: (1, 0), 1: (1, 0), 2: (0, 2)}
