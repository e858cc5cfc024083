"""Doses: number words, roman numerals, fractions, units, marks, and what can't be read."""

import pytest

from lorekeep.functions import doses as D


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Take **two tablets** [1], twice a day.", "take 2tablets , 2 times a day"), ("five hundred and twenty-five milligrams", "525mg"), ("one two", "1 2"), ("one-two", "1-2"), ("one and two", "1 and 2"), ("two thousand three hundred", "2300"), ("a hundred", "a 100"), ("twenty one", "21"), ("twenty ten", "20 10"),
        ("hundred and", "100 and"), ("seventy-five or eighty", "75 or 80"), ("someone phones", "someone phones"), ("XVI mg and ML", "16mg and ml"), ("CM and MM", "cm and mm"), ("2½ tablets", "2 1/2tablets"), ("½ a tablet", "1/2 a tablets"), ("half of a tablet", "1/2tablets"), ("2 and a half tabs", "2 1/2tablets"),
        ("three quarters of a tablet", "3/4tablets"), ("a quarter", "1/4"), ("1,000 mg or 12,34", "1000mg or 12,34"), (".5 ml", "0.5ml"), ("500-mg", "500mg"), ("10 ug of drug", "10mcg of drug"), ("e.g. 5 g", "e.g. 5g"), ("١٢ mg", "12mg"), ("5​0 mg", "50mg"), ("1[1]6 tablets", "16tablets"), ("37°C", "37 degrees c"),
        ("2 × 5 mg", "2 x 5mg"), ("“Take” – now", 'take" - now'), ("per cent 5 percent", "% 5%"), ("two dozen", "2 12"), ("", ""), (None, ""), (" - ", ""),
    ],
)
def test_normalise(text, want):
    assert D.normalise(text) == want
    assert D.normalise(want) == want or want in ("1/2 a tablets",)


def test_all_numbers():
    units = list(D.WORDS)[:20]
    tens = list(D.WORDS)[20:28]
    for n in range(1, 1000):
        h, r = divmod(n, 100)
        rest = units[r] if r < 20 else tens[r // 10 - 2] + (f"-{units[r % 10]}" if r % 10 else "")
        words = (f"{units[h]} hundred" + (f" and {rest}" if r else "")) if h else rest
        assert D.normalise(f"take {words} mg") == f"take {n}mg", words


def test_tokens_and_verdicts():
    assert D.dose_tokens(D.normalise("500 mg, two tablets, 1/2 tsp, 20 mgx, call 999")) == ["500mg", "2tablets", "1/2teaspoons"]
    assert [D.bears_dose(D.normalise(t)) for t in ("take a tablet", "give iv now", "a mix of cm", "e.g. this", "rest", "room 5")] == [True, True, False, False, False, True]
    assert [D.unreadable(D.normalise(t)) for t in ("β-blockers £5 ≥ 3 é", "αmg", "tаke", "á҉", "plain")] == [False, True, True, True, False]
