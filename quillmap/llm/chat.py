"""Chat formatting with linked tool calls.

Turns are read into messages, calls and results. A call carries an identifier, a
tool's name and JSON arguments; a result carries the identifier it answers. Calls
and results meet in a hash join on conversation and identifier. A call depends on
every call of its conversation whose identifier its arguments refer to with
``{"$result": "<identifier>"}``; levels are counted up from calls without
dependencies, round by round over all conversations at once, and what a cycle
holds back is marked. Arguments are validated against the tool's schema and
everything is written as canonical JSON: sorted keys, no spaces, no escapes that
JSON doesn't ask for.

A row comes out for each message, call and result, in a key order that sorts a
conversation (level, turn, place in the turn), so no task has to hold a
conversation, however long.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quillmap.llm.shared import cut

CALL, RESULT = ("<tool_call>", "</tool_call>"), ("<tool_result>", "</tool_result>")

#: Tools of the production query: JSON Schemas of their arguments.
SCHEMAS = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1}}, "required": ["query"], "additionalProperties": False},
    "fetch": {"type": "object", "properties": {"url": {"type": "string"}}, "required": ["url"]},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
}


def canonical(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def is_kind(value: object, kind: str) -> bool:
    if kind in ("integer", "number"):
        plain = isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)
        return plain and (kind == "number" or float(value).is_integer())
    return isinstance(value, _KINDS[kind])


def violations(value: object, schema: dict, at: str = "$") -> list[str]:
    """Where a value breaks a schema: type, enum, required, properties,
    additionalProperties, items, minimum, maximum. A reference to another call's
    result may stand for any value."""
    if isinstance(value, dict) and set(value) == {"$result"}:
        return []
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(is_kind(value, k) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not in enum")
    if is_kind(value, "number"):
        found += [f"{at}: below minimum"] * (value < schema.get("minimum", value)) + [f"{at}: above maximum"] * (value > schema.get("maximum", value))
    if isinstance(value, dict):
        own = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in own:
                found += violations(value[k], own[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                found.append(f"{at}.{k}: not allowed")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            found += violations(x, schema["items"], f"{at}[{i}]")
    return found


def references(value: object) -> set[str]:
    """Identifiers that a value refers to."""
    if isinstance(value, dict):
        if set(value) == {"$result"} and isinstance(value["$result"], str):
            return {value["$result"]}
        return set().union(*map(references, value.values()))
    return set().union(*map(references, value)) if isinstance(value, list) else set()


def segments(text: str | None) -> Iterator[tuple[str, str]]:
    """(kind, content) pieces of a turn: text, call, result; markup without an end is text."""
    text, at = text or "", 0
    while True:
        hits = [(k, kind, marks) for kind, marks in (("call", CALL), ("result", RESULT)) if (k := text.find(marks[0], at)) >= 0]
        hits = [h for h in hits if text.find(h[2][1], h[0]) >= 0]
        if not hits:
            break
        k, kind, (begin, end) = min(hits)
        if text[at:k].strip():
            yield "text", text[at:k]
        stop = text.find(end, k)
        yield kind, text[k + len(begin) : stop]
        at = stop + len(end)
    if text[at:].strip() or at == 0:
        yield "text", text[at:]


def _constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def _finite(digits: str) -> float:
    value = float(digits)
    return value if math.isfinite(value) else _constant(digits)


def _text(x: str) -> str:
    """Surrogates that stand alone become escapes, as UTF-8 has no place for them."""
    return x.encode("utf-8", "backslashreplace").decode()


def parse(kind: str, content: str, schemas: dict) -> tuple[str | None, str | None, str, list[str], list[str]]:
    """Identifier, tool, canonical JSON, references, errors of a call or result.

    What is no JSON, nested too deep, has a number that no double holds or no text as identifier is kept as it stands, under
    ``raw``; a name that is no text is an error. Never raises.
    """
    raw = canonical({"raw": _text(content)})
    try:
        got = json.loads(content, parse_constant=_constant, parse_float=_finite)
        if not isinstance(got, dict) or not isinstance(got.get("id"), str):
            return None, None, raw, [], ["no identifier"]
        if kind == "result":
            return _text(got["id"]), None, _text(canonical({"content": got.get("content"), "id": got["id"]})), [], []
        name, arguments = got.get("name"), got.get("arguments", {})
        known = isinstance(name, str) and name in schemas
        errors = violations(arguments, schemas[name]) if known else [f"unknown tool {name}" if isinstance(name, str) else "no name"]
        body, refs = canonical({"arguments": arguments, "id": got["id"], "name": name}), sorted(references(arguments))
    except (ValueError, RecursionError) as e:
        return None, None, raw, [], [_text(f"no JSON: {e}"[:200])]
    return _text(got["id"]), _text(name) if isinstance(name, str) else None, _text(body), [_text(r) for r in refs], [_text(e) for e in errors]


PIECE = "conv_id long, turn long, part int, role string, kind string, call_id string, tool string, body string, refs array<string>, errors array<string>"


def pieces(turns: DataFrame, schemas: dict) -> DataFrame:
    """A row for each message, call and result of ``turns``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for conv, turn, role, text in pdf.itertuples(index=False):
                for part, (kind, content) in enumerate(segments(text)):
                    if kind == "text":
                        body = canonical({"content": content, "role": role})
                        out.append((conv, turn, part, role, "message", None, None, body, [], []))
                    else:
                        out.append((conv, turn, part, role, kind, *parse(kind, content, schemas)))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in PIECE.split(", ")])

    # ids go as text: pandas would make a column of longs with nulls one of doubles
    texts = turns.select(*[F.col(c).cast("string").alias(c) for c in ("conv_id", "turn", "role", "text")])
    found = texts.mapInPandas(run, PIECE.replace(" long", " string"))
    return found.withColumns({c: F.col(c).cast("long") for c in ("conv_id", "turn")})


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls (conv_id, call_id, refs) that no cycle holds back.

    A reference to an unknown call, or a call's to itself, is no dependency.
    """
    known = calls.select("conv_id", "call_id").distinct()
    edges = calls.select("conv_id", "call_id", F.explode("refs").alias("needs")).where("needs != call_id").distinct()
    edges = cut(edges.join(known.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"], "left_semi"))
    done = cut(known.join(edges, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)))
    # every round adds a call or is the last
    for level in count(1):
        met = edges.join(done.select("conv_id", F.col("call_id").alias("needs"), "level"), ["conv_id", "needs"], "left")
        ready = met.groupBy("conv_id", "call_id").agg(F.max("level").alias("high"), F.count("*").alias("n"), F.count("level").alias("met"))
        new = cut(ready.where((F.col("n") == F.col("met")) & (F.col("high") == level - 1)).select("conv_id", "call_id", F.lit(level).alias("level")))
        if not new.limit(1).count():
            return done
        done = cut(done.union(new))


def format_chats(turns: DataFrame, schemas: dict | None = None) -> DataFrame:
    """The messages, calls and results of ``turns`` (conv_id, turn, role, text).

    Returns conv_id, turn, part (place in the turn), role, kind (message, call or
    result), call_id, tool, level, status, errors (where a call breaks its schema, or why
    it can't be read), json. Level is 0 for messages and calls
    without dependencies, and a result has its call's; sorting by (level, turn,
    part) puts every call after those it needs. Status is ``ok`` for a message, an
    answered valid call and a result that answers one; ``invalid`` for what breaks
    its schema or is no JSON with an identifier; ``duplicate`` for calls that share
    an identifier with an earlier one of the conversation; ``unanswered``;
    ``orphan`` for a result without a call; ``cycle``, with a null level, for calls
    that wait for each other and their results. A null or empty text is a message
    with empty content; markup without an end is text. A null conversation is
    one of its own: identifiers in it link with nothing. Repeated rows are kept;
    other columns are ignored. An empty table gives an empty table.
    """
    found = cut(pieces(turns, SCHEMAS if schemas is None else schemas))
    calls = found.where("kind = 'call' and call_id is not null and conv_id is not null").select("conv_id", "call_id", "turn", "part", "refs", "errors")
    columns = ["conv_id", "turn", "part", "role", "kind", "call_id", "tool", "level", "status", "errors", F.col("body").alias("json")]
    if not calls.limit(1).count():
        status = F.when(F.col("kind") == "message", "ok").when(F.size("errors") > 0, "invalid").otherwise(F.when(F.col("kind") == "result", "orphan").otherwise("unanswered"))
        return found.withColumns({"level": F.lit(0), "status": status}).select(*columns)
    first = calls.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "part", "refs", "errors")).alias("first"))
    first = cut(first.select("conv_id", "call_id", "first.*"))
    depth = levels(first)
    answers = found.where("kind = 'result'").groupBy("conv_id", "call_id").agg(F.lit(True).alias("answered"))
    info = first.join(depth, ["conv_id", "call_id"], "left").join(answers, ["conv_id", "call_id"], "left")
    info = cut(info.select("conv_id", "call_id", F.struct("turn", "part").alias("first"), F.col("level").alias("call_level"), "answered"))
    linked = found.where("kind != 'message'").join(info, ["conv_id", "call_id"], "left")
    is_call = F.col("kind") == "call"
    status = (
        F.when(F.size("errors") > 0, "invalid")
        .when(is_call & F.col("conv_id").isNull(), "unanswered")
        .when(is_call & (F.struct("turn", "part") != F.col("first")), "duplicate")
        .when(F.col("first").isNull(), "orphan")
        .when(F.col("call_level").isNull(), "cycle")
        .when(is_call & F.col("answered").isNull(), "unanswered")
        .otherwise("ok")
    )
    level = F.when(F.col("first").isNull(), 0).otherwise(F.col("call_level"))
    linked = linked.withColumns({"status": status, "level": level}).select(*columns)
    return linked.union(found.where("kind = 'message'").withColumns({"level": F.lit(0), "status": F.lit("ok")}).select(*columns))
