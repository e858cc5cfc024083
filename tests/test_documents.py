"""Parsers, chunkers, streams and folds against small cases by hand."""

import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.functions import language as L
from lorekeep.functions.calc import calculate, shown
from lorekeep.functions import text as T
from lorekeep.operators import chunking as C
from lorekeep.operators import display, packs
from lorekeep.sources import markdown as MD
from lorekeep.sources import office
from lorekeep.sources import text as TX
from lorekeep.streaming import spans

MARKDOWN = """intro *with* `marks` and [a link](http://x)
over two lines

# One

- first
- second
  goes on
1. third

## Two

| a | b |
|---|:-:|
| 1 | **2** |
| 3 |

```py
# no heading
x = 1
```
# Three
end"""


def test_markdown(spark):
    got = [tuple(b) for b in MD.blocks(MARKDOWN)]
    assert got == [
        ("", "paragraph", "intro with marks and a link over two lines", None, None, 1, 2),
        ("One", "list", "- first\n- second goes on\n- third", None, None, 6, 9),
        ("One > Two", "table", "", ["a", "b"], [["1", "2"], ["3"]], 13, 16),
        ("One > Two", "code", "# no heading\nx = 1", None, None, 18, 21),
        ("Three", "paragraph", "end", None, None, 23, 23),
    ]
    d = spark.createDataFrame([(1, MARKDOWN, 9), (2, None, 9), (3, "", 9)], "doc_id long, text string, block int")
    assert MD.markdown_blocks(d).count() == 5
    chunks = C.chunk_blocks(MD.markdown_blocks(d)).collect()
    assert [(r.kind, r.tokens) for r in chunks] == [("paragraph", 9), ("list", 8), ("table", 10), ("code", 6), ("paragraph", 1)] and chunks[2].text == "a | b\na: 1 | b: 2\na: 3" and chunks[2].locator == "L13-L16"


def test_the_query_cuts_long_blocks(spark, tmp_path):
    import duckdb

    from lorekeep.plans import sources

    long = " ".join(f"{chr(97 + i % 26) * 3} second third of it. Next one has six words." for i in range(12))
    lines = ["Top", long, "Sub", long.replace(".", ""), "short line"]
    spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, "Top\nshort line")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"select doc_id, block, part, section_path, kind, locator, text, tokens, oversize from ({sources.ORACLE_SQL['chunk_document']}) order by 1, 2, 3").fetchall()
    got = sources.QUERIES["chunk_document"](spark, str(tmp_path)).orderBy("doc_id", "block", "part").collect()
    assert [tuple(r) for r in got] == want
    assert [(r[0], r[1], r[2]) for r in want if r[2]] == [(1, 0, 1), (1, 0, 2), (1, 1, 1)] and [r[-1] for r in want].count(True) == 2


def test_sentences(spark):
    text = "Dr. Who met A. Smith. It was 5. See fig. 2, e.g. here! Is it? U.S. law"
    d = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    got = [r.s for r in d.select(L.split_sentences(F.col("t")).alias("s")).collect()]
    assert got == [["Dr. Who met A.", "Smith.", "It was 5.", "See fig. 2, e.g. here!", "Is it?", "U.S. law"], [], []]


def slow_windows(counts, target, overlap):
    out, i = [], 0
    while i < len(counts):
        if counts[i] > target:
            out.append((i, i + 1))
            i += 1
            continue
        j = i
        while j + 1 < len(counts) and sum(counts[i : j + 2]) <= target:
            j += 1
        out.append((i, j + 1))
        if j + 1 >= len(counts):
            break
        budget, k = sum(counts[i : j + 1]) * overlap // 100, j
        while k != i and sum(counts[k - 1 : j + 1]) <= budget:
            k -= 1
        i = max(k, i + 1)
    return out


def test_windows():
    rng = random.Random(4)
    for _ in range(500):
        counts = [rng.randint(1, 30) for _ in range(rng.randint(0, 25))]
        target, overlap = rng.randint(5, 60), rng.choice([0, 18, 50, 90])
        assert C.window_spans(np.array(counts, np.int64), target, overlap) == slow_windows(counts, target, overlap)


@pytest.mark.parametrize(
    "drafts,want",
    [
        ([("paragraph", 0, 60, False), ("paragraph", 1, 60, False), ("paragraph", 2, 60, False)], [(0, 2), (2, 3)]),
        ([("paragraph", 0, 100, False), ("paragraph", 1, 20, True), ("list", 2, 90, False)], [(0, 3)]),
        ([("paragraph", 0, 110, False), ("paragraph", 1, 30, True), ("list", 2, 200, False)], [(0, 1), (1, 3)]),
        ([("paragraph", 1, 100, True), ("list", 2, 200, False)], [(0, 1), (1, 2)]),
        ([("paragraph", 0, 10, False), ("table", 1, 10, False), ("code", 2, 10, False), ("paragraph", 3, 10, False)], [(0, 1), (1, 2), (2, 3), (3, 4)]),
        ([("paragraph", 0, 40, False), ("paragraph", 0, 40, False), ("paragraph", 1, 40, False)], [(0, 1), (1, 3)]),
        ([], []),
    ],
)
def test_merge(drafts, want):
    """Small neighbours join; a list goes with its intro up to the larger bound; tables, code and windows of one block stay apart."""
    kinds, blocks, counts, intro = (list(x) for x in zip(*drafts, strict=True)) if drafts else ([],) * 4
    assert C.merge_spans(kinds, blocks, counts, intro, 150, 256) == want


def test_display():
    """Same kind refreshes at once, others wait for the dwell, an error comes first, an old backlog is dropped."""
    assert display.shown_states([(0, "a", ""), (100, "a", ""), (150, "b", ""), (160, "c", "")]) == [(0, "a"), (100, "a"), (800, "b"), (1500, "c")]
    assert display.shown_states([(0, "a", ""), (10, "b", ""), (20, "x", "error"), (30, "c", "")]) == [(0, "a"), (20, "x"), (720, "c")]
    many = [(0, "a", "")] + [(i, f"k{i}", "") for i in range(1, 9)]
    assert display.shown_states(many) == [(0, "a"), (700, "k8")]


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_spans_by_piece(size):
    """However a text is cut, the pieces shown are the text without what the tags enclose; an open start of a tag is held back."""
    for text, want in [("a<think>b</think>c", "ac"), ("<think>x", ""), ("1 < 2 <thin", "1 < 2 "), ("a</think>b", "a</think>b"), ("<think>a</thi</think>z<think></think>", "z")]:
        buffer, inside, shown = "", False, ""
        for i in range(0, len(text), size):
            buffer, inside, more = spans.step(buffer, inside, text[i : i + size], spans.THINK)
            shown += more
        assert shown == want


def test_spans_stream(spark, tmp_path):
    d = spark.createDataFrame([(1, i, p) for i, p in enumerate(["he<th", "ink>no", "</thin", "k>llo"])] + [(2, 0, "x<y")], "stream_id long, seq long, piece string")
    d.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = spans.strip_stream(s).writeStream.format("memory").queryName("spans").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    got = {}
    for r in spark.table("spans").orderBy("stream_id", "seq").collect():
        got[r.stream_id] = got.get(r.stream_id, "") + r.shown
    assert got == {1: "hello", 2: "x<y"}


def packed(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office_files(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda text, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'
    docx = packed({"word/document.xml": f"<w:document {w}><w:body>{p('One', 'Heading1')}{p('text')}{p('')}<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>{p('Two', 'Heading2')}{p('more')}</w:body></w:document>"})
    epub = packed(
        {
            "META-INF/container.xml": '<c xmlns="urn:x"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></c>',
            "o/p.opf": '<p xmlns="urn:y"><manifest><item id="c2" href="b.html"/><item id="c1" href="a.html"/></manifest><spine><itemref idref="c1"/><itemref idref="c2"/><itemref idref="zz"/></spine></p>',
            "o/a.html": "<html><head><title>t</title></head><body><h1 id='k'>H</h1><p>first</p></body></html>",
            "o/b.html": "<p>second</p>",
        }
    )
    files = spark.createDataFrame([("x/a.docx", bytearray(docx)), ("b.EPUB", bytearray(epub)), ("bad.docx", bytearray(b"no zip")), ("c.odt", bytearray(b""))], "path string, content binary")
    got = [(r.path, r.section_path, r.kind, r.text, r.locator, r.problem) for r in office.office_blocks(files).orderBy("path", "n").collect()]
    assert got == [
        ("b.EPUB", "c1 > H", "p", "first", "a.html#k", None),
        ("b.EPUB", "c2", "p", "second", "b.html#b1", None),
        ("bad.docx", None, None, None, None, "unreadable: BadZipFile"),
        ("c.odt", None, None, None, None, "unknown type"),
        ("x/a.docx", "One", "paragraph", "text", "¶2", None),
        ("x/a.docx", "One", "table", "a\tb", "¶4", None),
        ("x/a.docx", "One > Two", "paragraph", "more", "¶7", None),
    ]


def test_html_tables_and_locators(spark):
    html = "<body><script>x</script><h2 id='s'>Head</h2><p>a  b</p><table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>2 <b>3</b></td></tr></table>loose<h3>Sub</h3><li>item</li></body>"
    got = [(r.section_path, r.kind, r.text, r.locator) for r in TX.html_blocks(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("n").collect()]
    assert got == [("Head", "p", "a b", "#s"), ("Head", "table", "k | v\nk: 1 | v: 2 3", "#s"), ("Head", "text", "loose", "#s"), ("Head > Sub", "li", "item", "b4")]


@pytest.mark.parametrize("text,want", [("2 + 3 * 4", 14.0), ("2 ^ 3 ^ 2", 512.0), ("-2^2", -4.0), ("sqrt(16) - abs(-1)", 3.0), ("1/0", "division"), ("", "empty"), ("2 +", "syntax"), ("__import__('os')", "syntax"), ("sqrt(-1)", "domain"), ("9^999", "overflow"), ("1" * 600, "long"), ("(" * 40 + "1" + ")" * 40, "depth"), ("(" * 31 + "1" + ")" * 31, 1.0), ("-" * 40 + "1", "depth"),
    ("round(2.5)", 3.0), ("round(0.5) + round(-0.5)", 0.0), ("round(0.49999999999999994)", 0.0), ("90 deg", 1.5707963267948966), ("2 * (40 + 5) deg", 1.5707963267948966), ("deg 3", "syntax"), ("3 deg deg", "syntax"), ("007", 7.0), ("2**3", "syntax"), ("0x10", "syntax"), ("1_000", "syntax"), ("1e3", "syntax"), ("1 # c", "syntax"),
    ("1,000", "thousands"), ("+1", "syntax"), ("2*-3 + 1", -5.0), ("2^-3^2", 2.0**-9), ("--2", 2.0), ("foo(1)", "name"), ("sin", "name"), ("sin 3", "name"), ("ln(0)", "domain"), ("(-8)^0.5", "domain"), ("0^-1", "overflow"), ("1..2", "syntax"), (".5 + 5.", 5.5), ("()", "syntax"), ("(1", "syntax"), ("1)", "syntax"), ("1 2", "syntax"), ("sqrt(abs(-16))", 4.0), ("10-2-3", 5.0), ("e^0", 1.0), (None, "empty"), ("sqrt()", "syntax"), ("2 pi", "syntax")])
def test_calculate(text, want):
    value, error = calculate(text)
    assert (value if error is None else error) == want


def test_display():
    assert [shown(x) for x in (0.1 + 0.2, -0.0, 1e21, 123456789012345.0, 1 / 3, 2.50, -7.0)] == ["0.3", "0", "1000000000000000000000", "123456789012000", "0.333333333333", "2.5", "-7"]


def test_json_strings(spark):
    import json

    odd = ['a"b\\c', "\x00\x1f\x0b\x08\f\n\r\t", "é/日本", ""]
    d = spark.createDataFrame([(x,) for x in odd], "t string")
    assert [r.j for r in d.select(T.json_string(F.col("t")).alias("j")).collect()] == [json.dumps(x, ensure_ascii=False) for x in odd]


def test_page_chunks(spark):
    """Sections in order of appearance, in a section those that match the query first."""
    chunks = spark.createDataFrame([(1, 10, "A", "none here"), (1, 11, "B", "word"), (1, 12, "A", "the word word"), (1, 13, "B", "else")], "doc_id long, chunk_id long, section_path string, text string")
    asked = spark.createDataFrame([("q", 1, ["word"]), ("none", 1, ["zzz"])], "query string, doc_id long, terms array<string>")
    got = {}
    for r in packs.page_chunks(asked, chunks).orderBy("query", "place").collect():
        got.setdefault(r.query, []).append(r.chunk_id)
    assert got == {"q": [12, 10, 11], "none": [10, 12, 11]}


def test_close_titles(spark):
    """Close spellings of short and long keys are those of a brute force over all pairs."""
    from lorekeep.operators import lookup

    rng = random.Random(8)
    word = lambda n: "".join(rng.choices("abcde", k=n))
    keys = sorted({word(n) for n in [*range(3, 32)] * 8})

    def edit(x):
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(x))
            x = rng.choice([x[:i] + x[i + 1 :], x[:i] + "z" + x[i:], x[:i] + "y" + x[i + 1 :], x[:i] + x[i + 1 : i + 2] + x[i] + x[i + 2 :]]) or "q"
        return x

    asked = sorted({edit(k) for k in keys} - set(keys))
    titles = spark.createDataFrame([(i, k, None, None) for i, k in enumerate(keys)], "doc_id long, title string, slug string, variants array<string>")
    q = spark.createDataFrame([(x, x) for x in asked], "query string, q string")
    got = {r["query"]: r.titles for r in lookup.close(q, lookup.keys(titles)).collect()}
    want = {}
    for x in asked:
        budget = 0 if len(x) <= 2 else 1 if len(x) <= 5 else 2
        near = sorted((d, k) for k in keys if abs(len(k) - len(x)) <= budget and (d := lookup.osa(x, k)) <= budget)
        if budget and near:
            want[x] = "|".join(k for _, k in near[:5])
    assert got == want and len(want) > 100
    assert any(len(x) > 20 for x in want) and any(len(x) < 8 for x in want)


def test_list_positions(spark):
    """Positions over ranges are those of one window, with a list that fills several ranges, nulls and descending order."""
    from lorekeep.operators.summaries import in_list_order

    rng = random.Random(1)
    rows = [(None if i % 50 == 0 else i % 3 % 2, rng.random() < 0.5, rng.choice([None, 1, 2, 3]), i) for i in range(400)]
    order = [F.desc("pinned"), F.desc("at"), F.desc("id")]
    got = in_list_order(spark.createDataFrame(rows, "list int, pinned boolean, at int, id int"), "list", order).collect()
    want = {}
    for r in sorted(rows, key=lambda r: (r[1], -1 if r[2] is None else r[2], r[3]), reverse=True):
        want.setdefault(r[0], []).append(r[3])
    assert {(r.list, r.id): r.position for r in got} == {(g, i): p for g, ids in want.items() for p, i in enumerate(ids, 1)}


def test_prompt_sources(spark):
    """Heads are found one after the other; if one is missing, none counts."""
    from lorekeep.operators import messages

    rows = [("x [1] a [1] b [2] c", ["[1]", "[1]", "[2]"]), ("x [2] a [1]", ["[1]", "[2]"]), ("x", []), ("[1][1]", ["[1]", "[1]"])]
    d = spark.createDataFrame(rows, "p string, h array<string>")
    got = [r.s for r in d.select(messages.sources_from_prompt(F.col("p"), F.col("h")).alias("s")).collect()]
    assert got == [[6, 12, 18], None, [], [4, 7]]


def test_reply_sentences(spark):
    text = "# Head\n- one. two\n2) second item\nwrapped line no. 5 ends. Cited. [1, 2] Next one"
    d = spark.createDataFrame([(text,), (None,)], "t string")
    got = [r.s for r in d.select(L.split_lines_and_sentences(F.col("t")).alias("s")).collect()]
    assert got == [["Head", "one.", "two", "second item wrapped line no. 5 ends.", "Cited [1, 2] .", "Next one"], []]


def test_score_weights(spark):
    """A swapped sign or look-alike weighs five, other edits one, a refused item nothing."""
    from lorekeep.operators import scoring

    rows = [(1, "a+b", "a-b", "accept"), (2, "abc", "axc", "review"), (3, "a+1", "a-l", "accept"), (4, None, "x", "refuse"), (5, None, "x", "accept"), (6, "ab", None, None)]
    got = {r.item: (r.weighted, r.cer, r.exact, r.verdict_ok) for r in scoring.score_items(spark.createDataFrame(rows, "item int, expected string, got string, verdict string")).collect()}
    assert got == {1: (5, 0.333333, False, True), 2: (1, 0.333333, False, True), 3: (10, 0.666667, False, True), 4: (0, 0.0, True, True), 5: (0, 1.0, False, False), 6: (2, 1.0, False, False)}
