"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

A message is a row (conversation, turn, role, text). Its text holds calls if it is a JSON object with a list `tool_calls` of
objects with `id`, `name` and `arguments` (an object, or a string of JSON); a message of role `tool` is a result if its text is
a JSON object with `tool_call_id`. Any other text is plain content.

Calls and results are joined on (conversation, identifier); where an identifier recurs, its nth call goes with its nth result.
Results depend on their calls and on nothing else, so the dependency graph has two levels and sorting by
(order_turn, order_rank, turn) is a topological order: order_turn is the later of a message's own turn and its call's, and
order_rank is 1 for a linked result. Messages keep a row of their own, so a conversation of any size is never gathered.

Arguments are checked against the tools' JSON schemas (type, enum, const, required, properties, additionalProperties, items,
minimum, maximum, minLength, maxLength, minItems, maxItems, pattern). Schemas are checked before the job starts: an unknown type,
a pattern that is no regular expression or a value of a wrong kind is an error of the caller. Canonical JSON has sorted keys, no
white space, plain UTF-8 and no NaN.

Defined results: null text is null content; null conversation, turn or role stay null, and messages without a conversation are
never linked; equal rows are one message to the links and each get its annotation; calls without a result and results without a
call are counted as orphans; an empty table gives no rows. What cannot be written as canonical JSON (numbers beyond a double,
lone surrogates, nesting deeper than the JSON library goes, also inside arguments that are a string) and malformed calls are plain
content. Turns that tie are ranked by the hash of the message, then by place in it. Very long texts are read whole. Extra columns,
also of clashing names, are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnweave.llm.common import materialize, quoted, slices

TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def parse_json(text: str) -> object:
    return json.loads(text, parse_constant=_refuse)


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _is(value: object, kind: str) -> bool:
    if kind == "integer":
        return not isinstance(value, bool) and (isinstance(value, int) or isinstance(value, float) and value.is_integer())
    if kind == "number":
        return isinstance(value, int | float) and not isinstance(value, bool)
    return isinstance(value, TYPES[kind])


def _same(a: object, b: object) -> bool:
    """Equal as JSON: true is not 1."""
    return canonical(a) == canonical(b) or (_is(a, "number") and _is(b, "number") and a == b)


def checked(schema: object, path: str = "$") -> object:
    """The schema, or a ValueError that names what is wrong with it."""
    if schema is None or isinstance(schema, bool):
        return schema
    if not isinstance(schema, dict):
        raise ValueError(f"{path}: a schema is an object, true or false")
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if not isinstance(kinds, list) or not all(isinstance(k, str) and (k in TYPES or k in ("integer", "number")) for k in kinds):
        raise ValueError(f"{path}: unknown type")
    for word, kind in (("enum", list), ("required", list), ("properties", dict), ("pattern", str)):
        if word in schema and not isinstance(schema[word], kind):
            raise ValueError(f"{path}: {word} is of the wrong kind")
    for word in ("minimum", "maximum", "minLength", "maxLength", "minItems", "maxItems"):
        if word in schema and not _is(schema[word], "number"):
            raise ValueError(f"{path}: {word} is no number")
    if not all(isinstance(k, str) for k in schema.get("required", [])):
        raise ValueError(f"{path}: required has names only")
    try:
        re.compile(schema.get("pattern", ""))
        canonical(schema).encode()
    except (re.error, TypeError, ValueError, RecursionError) as e:
        raise ValueError(f"{path}: {e}") from e
    for name, own in schema.get("properties", {}).items():
        checked(own, f"{path}.{name}")
    for word in ("items", "additionalProperties"):
        checked(schema.get(word), f"{path}.{word}")
    return schema


def errors_of(value: object, schema: object, path: str = "$") -> list[str]:
    """What a value has against a schema, in document order."""
    if schema is True or schema is None:
        return []
    if schema is False:
        return [f"{path}: not allowed"]
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{path}: not of type {' or '.join(kinds)}"]
    found = []
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]):
        found.append(f"{path}: not in enum")
    if "const" in schema and not _same(value, schema["const"]):
        found.append(f"{path}: not the constant")
    if _is(value, "number"):
        found += [f"{path}: {word} {schema[word]}" for word, wrong in (("minimum", lambda b: value < b), ("maximum", lambda b: value > b)) if word in schema and wrong(schema[word])]
    for kind, least, most in ((str, "minLength", "maxLength"), (list, "minItems", "maxItems")):
        if isinstance(value, kind):
            found += [f"{path}: {word} {schema[word]}" for word, wrong in ((least, lambda b: len(value) < b), (most, lambda b: len(value) > b)) if word in schema and wrong(schema[word])]
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        found.append(f"{path}: pattern")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            found += errors_of(x, schema["items"], f"{path}[{i}]")
    if isinstance(value, dict):
        properties = schema.get("properties", {})
        found += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in properties:
                found += errors_of(value[k], properties[k], f"{path}.{k}")
            elif "additionalProperties" in schema:
                found += errors_of(value[k], schema["additionalProperties"], f"{path}.{k}")
    return found


def read_message(role: str | None, text: str | None) -> tuple[object, list[dict], str | None]:
    """(content, calls, identifier of the call that this answers)."""
    if text is None or not text.lstrip().startswith("{"):
        return text, [], None
    try:
        got = parse_json(text)
        _writable(got)
    except (ValueError, RecursionError):
        return text, [], None
    if role == "tool" and isinstance(got.get("tool_call_id"), str):
        return got.get("content"), [], got["tool_call_id"]
    if isinstance(got.get("tool_calls"), list) and role != "tool":
        try:
            return got.get("content"), [_call(c) for c in got["tool_calls"]], None
        except (ValueError, KeyError, TypeError, RecursionError):
            return text, [], None
    return text, [], None


def _writable(value: object) -> None:
    """An error where value, a few levels down in a message, could not be written."""
    canonical([[[[[[[[value]]]]]]]]).encode()


def _call(c: dict) -> dict:
    arguments = parse_json(c["arguments"]) if isinstance(c["arguments"], str) else c["arguments"]
    if not isinstance(c["id"], str) or not isinstance(c["name"], str):
        raise TypeError("id and name are strings")
    _writable(arguments)
    return {"id": c["id"], "name": c["name"], "arguments": arguments}


MESSAGE = "conv long, turn long, role string, text string"


def _linked(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls: mid, index, result_turn), (results: mid, call_turn, call_name): identifiers' nth call and nth result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4 << 20):
            out = {k: [] for k in ("mid", "conv", "turn", "index", "id", "name")}
            for mid, conv, turn, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                _, calls, answered = read_message(role, text)
                rows = [(i, c["id"], c["name"]) for i, c in enumerate(calls)] + ([(-1, answered, None)] if answered is not None else [])
                for index, name, tool in rows:
                    for k, v in zip(out, (mid, conv, turn, index, name, tool), strict=True):
                        out[k].append(v)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    parts = materialize(messages.select("mid", "conv", "turn", "role", "text").mapInArrow(run, "mid string, conv long, turn long, index int, id string, name string").where("conv IS NOT NULL").distinct(), "calls")
    ranked = _numbered(parts.withColumn("answer", F.col("index") < 0), ["conv", "id", "answer"], ["turn", "mid", "index"])
    calls, results = ranked.where("index >= 0"), ranked.where("index < 0")
    key = ["conv", "id", "nth"]
    linked = calls.select(*key, "mid", "index", F.col("turn").alias("call_turn"), "name").join(results.select(*key, F.col("mid").alias("result_mid"), F.col("turn").alias("result_turn")), key)
    linked = materialize(linked, "links")
    return linked.select("mid", "index", "result_turn"), linked.select(F.col("result_mid").alias("mid"), "call_turn", F.col("name").alias("call_name"))


def _numbered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """nth: row number within keys by order, without a task that holds a key: ranges of (keys, order) are numbered and then
    shifted by the rows that earlier ranges have of the key."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(n, *keys, *order).withColumn("part", F.spark_partition_id()), "ranges")
    own = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("part", *keys).orderBy(*order)))
    counts = dealt.groupBy("part", *keys).agg(F.count("*").alias("n"))  # a key has a row a range
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("before > 0")
    return own.join(before.select("part", *keys, "before"), ["part", *keys], "left").withColumn("nth", F.col("nth") + F.coalesce("before", F.lit(0))).drop("part", "before")


def formatted(messages: DataFrame, schemas: dict[str, object] | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: (conv, turn, role, order_turn, order_rank, n_calls, n_linked, n_orphans, n_invalid, message).

    schemas: a JSON schema of the arguments by tool name; a tool without one accepts anything.
    """
    for name, schema in (schemas or {}).items():
        checked(schema, name)
    own = messages.select(quoted(conv_col).cast("long").alias("conv"), quoted(turn_col).cast("long").alias("turn"), quoted(role_col).cast("string").alias("role"), quoted(text_col).cast("string").alias("text"))
    some = F.coalesce(F.col("text").rlike(r"^\s*\{") & F.col("text").contains('"tool_call'), F.lit(False))
    tools = own.where(some).withColumn("mid", F.sha2(F.to_json(F.struct("conv", "turn", "role", "text")), 256))
    calls, results = _linked(tools)
    of_calls = calls.groupBy("mid").agg(F.map_from_entries(F.collect_list(F.struct("index", "result_turn"))).alias("answers"))  # of one message
    joined = tools.join(of_calls, "mid", "left").join(results, "mid", "left").select("conv", "turn", "role", "text", "answers", "call_turn", "call_name")
    plain = own.where(~some).select("*", F.lit(None).cast("map<int,long>").alias("answers"), F.lit(None).cast("long").alias("call_turn"), F.lit(None).cast("string").alias("call_name"))
    known = json.dumps(schemas or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = json.loads(known)
        for b in slices(batches, "text", 4 << 20):
            rows = [_row(tools, *x) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=OUT.replace(" long", "").replace(" string", "").replace(" int", "").split(", "))

    return plain.unionByName(joined).mapInArrow(run, OUT)


OUT = "conv long, turn long, role string, order_turn long, order_rank int, n_calls long, n_linked long, n_orphans long, n_invalid long, message string"


def _row(tools: dict, conv: int | None, turn: int | None, role: str | None, text: str | None, answers: list | dict | None, call_turn: int | None, call_name: str | None) -> tuple:
    content, calls, answered = read_message(role, text)
    answers, linked = dict(answers or {}), call_name is not None
    message: dict = {"role": role, "content": content}
    invalid = 0
    if calls:
        for i, c in enumerate(calls):
            found = errors_of(c["arguments"], tools.get(c["name"]))
            invalid += bool(found)
            c |= {"errors": found, "result_turn": answers.get(i), "linked": i in answers}
        message["tool_calls"] = calls
    if answered is not None:
        message |= {"tool_call_id": answered, "tool_name": call_name, "call_turn": call_turn}
    n_linked = sum(c["linked"] for c in calls) + linked
    return (conv, turn, role, turn if not linked or turn is None or call_turn is None else max(turn, call_turn), int(linked), len(calls), n_linked, len(calls) + (answered is not None) - n_linked, invalid, canonical(message))
