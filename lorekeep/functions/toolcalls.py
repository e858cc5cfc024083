"""Tool calls that a model writes: in <tool_call> fences, or as the first balanced JSON object with a name anywhere in the text."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

FENCE = ("<tool_call>", "</tool_call>")
#: Inside an object only strings, as a whole with their escapes, and braces matter.
INSIDE = re.compile(r'"(?:[^"\\]|\\.)*(?:"|$)|[{}]', re.S)


def closing(text: str, start: int) -> int | None:
    """The place after the brace that closes the one at `start`; None where the text ends before. Braces in strings don't count."""
    depth = 0
    for m in INSIDE.finditer(text, start):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if not depth and m[0] == "}":
            return m.end()
    return None


def constant(name: str):
    raise ValueError(name)


def as_call(raw: str) -> tuple[str, str] | None:
    """Name and arguments of a JSON object that calls; arguments as they are if a string, else as compact JSON with sorted keys, {} if there are none."""
    try:
        value = json.loads(raw, parse_constant=constant)
    except (ValueError, RecursionError):
        return None
    if not isinstance(value, dict) or not isinstance(value.get("name"), str):
        return None
    given = value["arguments"] if "arguments" in value else value.get("parameters", {})
    return value["name"], given if isinstance(given, str) else json.dumps(given, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def find_calls(text: str | None) -> list[tuple[str, str]]:
    """(name, arguments) of all fenced calls; without any, of the first bare object that is a call. An open fence or object ends the search."""
    text, out, at = text or "", [], 0
    while (start := text.find(FENCE[0], at)) >= 0 and (end := text.find(FENCE[1], start + len(FENCE[0]))) >= 0:
        call = as_call(text[start + len(FENCE[0]) : end].strip())
        out += [call] if call else []
        at = end + len(FENCE[1])
    if out:
        return out
    at = 0
    while (start := text.find("{", at)) >= 0 and (at := closing(text, start) or -1) > 0:
        if call := as_call(text[start:at]):
            return [call]
    return []


@F.arrow_udf(ArrayType(StructType([StructField("id", StringType()), StructField("name", StringType()), StructField("arguments", StringType())])))
def tool_calls(texts: pa.Array) -> pa.Array:
    """Array of (id, name, arguments) for each text; ids number the calls of a text."""
    kind = pa.list_(pa.struct([("id", pa.string()), ("name", pa.string()), ("arguments", pa.string())]))
    return pa.array([[{"id": f"call_{i}", "name": n, "arguments": a} for i, (n, a) in enumerate(find_calls(t))] for t in texts.to_pylist()], kind)
