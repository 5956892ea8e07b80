import json
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.oracle import same
from turnweave.llm import op4_chat as op
from turnweave.llm import queries

SCHEMAS = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": ["number", "null"]}}, "additionalProperties": False}}


def call(*calls, content=None):
    return json.dumps({"content": content, "tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def result(i, content="ok"):
    return json.dumps({"tool_call_id": i, "content": content})


def plainly(role, text):
    """(calls as (id, name, arguments), answered id) of the fixtures' messages, read by the JSON library alone."""
    try:
        got = json.loads(text)
    except (TypeError, ValueError):
        return [], None
    if not isinstance(got, dict):
        return [], None
    if role == "tool":
        return [], got.get("tool_call_id")
    own = got.get("tool_calls")
    if not isinstance(own, list) or any(not isinstance(c["id"], str) for c in own):
        return [], None
    return [(c["id"], c["name"], json.loads(c["arguments"]) if isinstance(c["arguments"], str) else c["arguments"]) for c in own], None


def is_wrong(arguments):
    """What SCHEMAS says of add, in Python."""
    return not (set(arguments) <= {"a", "b"} and type(arguments.get("a")) is int and arguments["a"] >= 0)


def brute(rows):
    """By reading: nth call of an identifier in a conversation with its nth result, over different rows."""
    calls, results = [], []
    for conv, turn, role, text in set(rows):
        own, answered = plainly(role, text)
        if conv is None:
            continue
        calls += [((conv, c[0]), turn, text, role, i) for i, c in enumerate(own)]
        if answered is not None:
            results.append(((conv, answered), turn, text, role, -1))
    links_c, links_r = {}, {}
    for key in {c[0] for c in calls}:
        a = [c for c in calls if c[0] == key]
        b = [r for r in results if r[0] == key]
        assert len(a) == 1 or len({x[1] for x in a}) == len(a)  # fixtures have no ties between different turns
        for x, y in zip(sorted(a, key=lambda c: c[1]), sorted(b, key=lambda c: c[1]), strict=False):
            links_c[(key[0], x[1], x[3], x[2], x[4])] = y[1]
            links_r[(key[0], y[1], y[3], y[2])] = x[1]
    out = []
    for conv, turn, role, text in rows:
        own, answered = plainly(role, text)
        linked = [links_c.get((conv, turn, role, text, i)) for i in range(len(own))]
        from_turn = links_r.get((conv, turn, role, text)) if answered is not None else None
        n = sum(x is not None for x in linked) + (from_turn is not None)
        out.append((conv, turn, role, max(turn, from_turn) if from_turn is not None else turn, int(from_turn is not None), len(own), n, len(own) + (answered is not None) - n, sum(is_wrong(c[2]) for c in own)))
    return sorted(out, key=str)


def test_links_match_brute_force(spark):
    r = random.Random(3)
    rows = [(1, 0, "user", "hi"), (1, 2, "assistant", call(("x", "add", {"a": 1}), ("y", "add", '{"a": -1}'))), (1, 1, "tool", result("x")), (1, 3, "tool", result("y")), (1, 4, "tool", result("zz")), (2, 0, None, None), (None, 0, "tool", result("x")), (2, None, "user", "  {not json"), (2, 5, "assistant", '{"tool_calls": [{"id": 1}]}'), (2, 6, "user", '{"tool_calls": NaN}'), (9, 0, "user", "long " * 100_000), (9, 0, "user", "twice"), (9, 0, "user", "twice")]
    for conv in range(10, 40):
        turns = list(range(12))
        r.shuffle(turns)
        for t in turns:
            k = f"c{r.randrange(4)}"
            rows.append((conv, t, "assistant", call((k, "add", {"a": r.choice([1, -1, "x"])}))) if r.random() < 0.5 else (conv, t, "tool", result(k, t)))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("mid", F.lit("clash")).withColumn("a.b", F.lit(1))
    got = op.formatted(df, SCHEMAS).collect()
    assert sorted((tuple(x)[:9] for x in got), key=str) == brute(rows)
    for x in got:
        assert x.message == op.canonical(json.loads(x.message))
        assert x.order_rank == 0 or x.order_turn >= json.loads(x.message)["call_turn"]
    assert op.formatted(df.limit(0)).collect() == []


def test_plain_messages_are_canonical(spark):
    text = 'é "q" \\ \n\t\u0001 </b> 🙂'
    got = op.formatted(spark.createDataFrame([(1, 0, "user", text)], "conv_id long, turn long, role string, text string")).first()
    assert got.message == '{"content":' + json.dumps(text, ensure_ascii=False) + ',"role":"user"}'


@pytest.mark.parametrize(
    "value, schema, n",
    [({}, {"required": ["a", "b"]}, 2), (1.0, {"type": "integer"}, 0), (True, {"type": "integer"}, 1), (1, {"enum": [True]}, 1), ([1, "x"], {"items": {"type": "number"}}, 1), ({"z": 1}, {"additionalProperties": False}, 1), ("ab", {"pattern": "^b", "maxLength": 1}, 2), (5, {"minimum": 6, "maximum": 4}, 2), ([], {"minItems": 1}, 1), (None, {"type": ["null", "string"]}, 0), (3, {"const": 3.0}, 0), (3, False, 1)],
)
def test_schema_errors(value, schema, n):
    assert len(op.errors_of(value, schema)) == n


def nested(n):
    return "[" * n + "]" * n


BAD = [
    call(("x", "add", '{"a": 1e999}')),
    '{"tool_calls": [{"id": "x", "name": "add", "arguments": {"a": 1e999}}]}',
    call(("x", "add", nested(200_000))),
    '{"tool_calls": [{"id": "x", "name": "add", "arguments": %s}]}' % nested(200_000),
    call(("x", "add", '{"a": "\\ud800"}')),
    '{"tool_calls": [{"id": "x", "name": "add", "arguments": {"a": "\\ud800"}}]}',
    call(("x", "add", "1" * 10_000)),
    call(("x", "add", "not json")),
    '{"tool_calls": [7]}',
    '{"tool_calls": [{"id": "x"}]}',
    '{"tool_calls": {"id": "x"}}',
    '{"tool_call": ',
]


def test_no_row_is_fatal(spark):
    rows = [(1, i, "assistant", t) for i, t in enumerate(BAD)] + [(1, 50, "tool", '{"tool_call_id": "x", "content": 1e999}'), (1, 51, "tool", '{"tool_call_id": 5}')]
    got = {x.turn: x for x in op.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), SCHEMAS).collect()}
    for _, turn, role, text in rows:
        assert (got[turn].n_calls, got[turn].n_orphans, got[turn].n_invalid) == (0, 0, 0), text[:80]
        assert json.loads(got[turn].message) == {"role": role, "content": text}


@pytest.mark.parametrize("depth", [10, 900, 3000, 9990, 9999])
def test_deep_arguments_are_read_or_plain(depth):
    text = call(("x", "add", nested(depth)))
    content, calls, _ = op.read_message("assistant", text)
    assert content == text if not calls else op.canonical({"a": {"b": calls}})


@pytest.mark.parametrize("schema", [{"type": "strnig"}, {"type": 5}, {"pattern": "("}, {"properties": []}, {"minimum": "1"}, {"required": [1]}, {"items": {"type": "x"}}, {"properties": {"a": {"pattern": "["}}}, [], {"enum": [float("nan")]}])
def test_bad_schemas_are_refused_before_the_job(spark, schema):
    df = spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    with pytest.raises(ValueError):
        op.formatted(df, {"t": schema})


def test_derived_calls_match_sql(spark):
    same(spark, queries.chat_tool_links_derived, queries.CHAT_SQL, "/root/testdata/sf0.01")


def test_a_hot_identifier_is_numbered_in_ranges(spark):
    rows = [(1, i, "assistant" if i % 2 else "tool", call(("x", "add", {"a": i})) if i % 2 else result("x", i)) for i in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    got = [tuple(x)[:9] for x in op.formatted(df, SCHEMAS).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_every_stage_of_the_query_shows_in_its_result(spark):
    same(spark, queries.op4_chat_tool_links, queries.OP4_SQL, "/root/testdata/sf0.01")
    got = queries.op4_chat_tool_links(spark, "/root/testdata/sf0.01").agg(*[F.sum(c).alias(c) for c in ("order_rank", "n_linked", "n_orphans", "n_invalid")]).first()
    assert all(n > 0 for n in got)


def test_exchanges_keep_odd_messages(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 2, "user", None), (1, None, "assistant", "b"), (None, 3, "user", 'q "x"\n'), (2, 0, None, "c"), (2, 1, "assistant", "")]
    got = op.formatted(queries.tool_exchanges(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")), queries.TELL).collect()
    assert sorted(((x.conv, x.turn, json.loads(x.message)["content"]) for x in got), key=str) == sorted(((c, t, x) for c, t, _, x in rows), key=str)
    assert sum(x.n_linked for x in got) == 2 and sum(x.n_calls for x in got) == 2
