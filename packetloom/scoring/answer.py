"""The final answer in a text, and the schema it has to fit."""

from __future__ import annotations

import json
import re


def fenced(text: str) -> list[str]:
    """Contents of closed ```json blocks."""
    out, block = [], None
    for line in text.split("\n"):
        mark = line.strip()
        if block is None:
            if re.fullmatch(r"```json\s*", mark, re.I):
                block = []
        elif re.fullmatch(r"```\s*", mark):
            out.append("\n".join(block))
            block = None
        else:
            block.append(line)
    return out


def final_answer(text: str) -> dict:
    """{status: ok, value, several} of the last block that parses, or {status: format_error, reason}."""
    blocks = fenced(text)
    for b in reversed(blocks):
        try:
            return {"status": "ok", "value": json.loads(b), "several": len(blocks) > 1}
        except ValueError:
            continue
    return {"status": "format_error", "reason": "json_parse_failed" if blocks else "no_fenced_json_block"}


#: Keywords that a schema may use.
KEYWORDS = set("$schema $defs $ref type properties required additionalProperties items minItems maxItems uniqueItems enum minimum maximum x-kind x-match x-element-key".split())


def _is(kind: str, v) -> bool:
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    return {"object": isinstance(v, dict), "array": isinstance(v, list), "string": isinstance(v, str), "boolean": isinstance(v, bool), "null": v is None, "number": number, "integer": number and float(v).is_integer()}.get(kind, False)


def _target(root: dict, ref: str) -> dict | None:
    return (root.get("$defs") or {}).get(ref.removeprefix("#/$defs/")) if str(ref).startswith("#/$defs/") else None


def schema_faults(schema: dict) -> list[str]:
    """Keywords that the validator doesn't know, and references that lead nowhere."""
    out = []

    def walk(node, at):
        if not isinstance(node, dict):
            return
        out.extend(f"{at}: unsupported keyword \"{k}\"" for k in node if k not in KEYWORDS)
        if "$ref" in node:
            if _target(schema, node["$ref"]) is None:
                out.append(f"{at}.$ref: only #/$defs/<name> is supported")
            return
        for group in ("properties", "$defs"):
            for name, sub in (node.get(group) or {}).items():
                walk(sub, f"{at}.{group}.{name}")
        walk(node.get("items"), f"{at}.items")

    walk(schema, "answer_schema")
    return out


def faults(schema: dict, value) -> list[str]:
    """What keeps value from fitting schema."""
    out = []

    def visit(s, v, at):
        if s is None:
            return
        if "$ref" in s:
            target = _target(schema, s["$ref"])
            return visit(target, v, at) if target else out.append(f"{at}: no target for {s['$ref']}")
        if "enum" in s:
            if not any(type(e) is type(v) and e == v for e in s["enum"]):
                out.append(f"{at}: {v!r} is not one of {s['enum']}")
            return
        kinds = s.get("type")
        if kinds and not any(_is(k, v) for k in (kinds if isinstance(kinds, list) else [kinds])):
            return out.append(f"{at}: expected {kinds}, got {type(v).__name__}")
        if isinstance(v, dict):
            out.extend(f"{at}: missing \"{k}\"" for k in s.get("required") or [] if k not in v)
            known = s.get("properties") or {}
            for k, sub in known.items():
                if k in v:
                    visit(sub, v[k], f"{at}.{k}")
            if s.get("additionalProperties") is False and (known or s.get("required")):
                out.extend(f"{at}: extra \"{k}\"" for k in v if k not in known)
        if isinstance(v, list) and "items" in s:
            if len(v) < s.get("minItems", 0):
                out.append(f"{at}: fewer than {s['minItems']} items")
            if len(v) > s.get("maxItems", len(v)):
                out.append(f"{at}: more than {s['maxItems']} items")
            if s.get("uniqueItems") and len({json.dumps(x) for x in v}) < len(v):
                out.append(f"{at}: repeated items")
            for i, x in enumerate(v):
                visit(s["items"], x, f"{at}[{i}]")
        if _is("number", v):
            if "minimum" in s and v < s["minimum"]:
                out.append(f"{at}: {v} < {s['minimum']}")
            if "maximum" in s and v > s["maximum"]:
                out.append(f"{at}: {v} > {s['maximum']}")

    visit(schema, value, "$")
    return out
