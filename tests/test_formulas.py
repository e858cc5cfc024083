"""Formulas and tagged transcriptions of any nesting."""

import pytest

from lorekeep.functions import formulas as FM
from lorekeep.plans.functions import NESTED


@pytest.mark.parametrize(
    ("text", "want"),
    [
        *[(n, c) for n, c, _ in NESTED],
        (r"x^{2}", "x^2"), (r"x^{10}", "x^{10}"), (r"x^{{2}}", "x^2"), (r"x^\alpha{b}", r"x^\alphab"), (r"\mathrm{d}x", r"\mathrm{d}x"), (r"\frac{a}{b}{c}", r"\frac{a}{b}c"), (r"\frac a b", r"\fracab"), (r"\left\{ a \right\}", r"\{a\}"),
        (r"a \\ b", r"a\\b"), (r"}}a{{", "a"), ("Solve for x : x = 1", "x=1"), (r"\text{cost} = 5", "=5"), ("", ""), (None, ""), (r"a\cdotb", r"a\cdotb"), (r"x_{i}^{2}", "x_i^2"), ("\\", "\\"),
    ],
)
def test_canonical(text, want):
    assert FM.canonical(text) == want
    assert FM.canonical(want) == want or text in (r"\frac a b", r"x^\alpha{b}")


def test_any_depth():
    n = 50_000
    assert FM.canonical("{" * n + "x" + "}" * n) == "x" and FM.canonical(r"\sqrt{" * 500 + "x") == r"\sqrt{" * 500 + "x" + "}" * 500


def test_display():
    assert [FM.display(n) for n, *_ in NESTED] == [s for *_, s in NESTED]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("<text><loc_1>a b</text><formula>x^2</formula>", [("text", "a b"), ("latex", "x^2")]),
        ("<formula><loc_1><text>in <loc_9>two</text></formula> after", [("latex", "in"), ("latex", "two"), ("text", "after")]),
        ("one\ntwo \\pi<loc_2>three", [("text", "one"), ("latex", "two \\pi"), ("text", "three")]),
        ("<formula>Solve for x : x = 2</formula>", [("text", "Solve for x"), ("latex", "x = 2")]),
        ("<formula>S o l v e \\colon y</formula>", [("text", "S o l v e"), ("latex", "y")]),
        ("<formula>a : b = 2 : 3</formula><formula>AB : BC = 2</formula>", [("latex", "a : b = 2 : 3"), ("latex", "AB : BC = 2")]),
        ("<formula>\\text{cost} = 5</formula><formula>\\text{cost}: 5</formula>", [("latex", "\\text{cost} = 5"), ("text", "cost"), ("latex", "5")]),
        ("<formula>open\nnext line</doctag>gone", [("latex", "open"), ("latex", "next line")]),
        ("a < b <unknown>c</unknown>", [("text", "a < b c")]),
        (" \n\n", []),
        (None, []),
    ],
)
def test_doctags(text, want):
    got = FM.doctag_blocks(text)
    assert [b[:2] for b in got] == want
    for _, content, start, end in got:
        assert text[start:end].startswith(content[0]) and text[start:end].endswith(content[-1])
