"""Tool calls: a brute-force reading of all objects, quotes, escapes and truncation."""

import json
import random

import pytest

from lorekeep.functions.toolcalls import find_calls


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('<tool_call>{"name": "a", "arguments": {"y": 1, "x": "é"}}</tool_call>', [("a", '{"x":"é","y":1}')]),
        ('<tool_call>\n{"name":"a"}\n</tool_call> and <tool_call>bad</tool_call><tool_call>{"name":"b","parameters":"raw"}</tool_call>', [("a", "{}"), ("b", "raw")]),
        ('<tool_call>bad</tool_call> {"name":"c","arguments":[1]}', [("c", "[1]")]),
        ('text {"a": "}", "b": "\\"{"} then {"name": "d", "arguments": {"s": "} \\\\"}} {"name": "e"}', [("d", '{"s":"} \\\\"}')]),
        ('{"name": "f", "arguments": {"x": 1}', []),
        ('{"x": {"name": "inner"}} {"name": "g"}', [("g", "{}")]),
        ('{"name": 5} {"name": null} {"name": "h", "arguments": null}', [("h", "null")]),
        ('<tool_call>{"name": "i"}', [("i", "{}")]),
        ('{ unclosed "quote } {"name": "j"}', []),
        ('{"name": "k", "arguments": NaN} {"name": "l"}', [("l", "{}")]),
        ("{" * 2000 + "}" * 2000, []),
        ("", []),
        (None, []),
    ],
)
def test_find_calls(text, want):
    assert find_calls(text) == want


def test_against_all_spans():
    """The first span that is valid JSON and starts outside every earlier balanced object is the one found."""
    rng = random.Random(9)
    parts = ['{"name": "n1", "arguments": {"q": "a}b{"}}', '{"other": "\\"}"}', '{"name": "n2"}', " prose ", '{"name": 1}', "{}", '{"name": "n3", "parameters": {"z": [1, {"y": "\\\\"}]}}']
    for _ in range(500):
        text = "".join(rng.choices(parts, k=5))
        want, at = [], 0
        while not want and (start := text.find("{", at)) >= 0:
            for end in range(start + 1, len(text) + 1):
                try:
                    value = json.loads(text[start:end])
                    break
                except ValueError:
                    continue
            at = end
            if isinstance(value.get("name"), str):
                want = [value["name"]]
        assert [n for n, _ in find_calls(text)] == want
