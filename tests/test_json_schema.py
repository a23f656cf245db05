"""Schemas against a validator in plain Python."""

import json
import random
import re

import pytest
from pyspark.sql import types as T

from inkproof.operators.json_schema import KINDS, Schema, SchemaError, check_schema, record_type, strict_form
from inkproof.operators.record import DEFAULT_RECORD
from inkproof.operators.requests import extraction_requests, strict_schema


def is_type(value, kind):
    if kind == "null":
        return value is None
    if kind == "boolean":
        return isinstance(value, bool)
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool)
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, {"string": str, "object": dict, "array": list}[kind])


def plain(schema, value, whole, path=""):
    """Set of (kind, path)."""
    if schema is True:
        return set()
    if schema is False:
        return {("wrong_types", path)}
    if "$ref" in schema:
        at = whole
        for part in schema["$ref"].split("/")[1:]:
            at = at[part]
        return plain(at, value, whole, path)
    if "allOf" in schema:
        return set().union(*(plain(s, value, whole, path) for s in schema["allOf"]))
    for word in ("anyOf", "oneOf"):
        if word in schema:
            branches = schema[word]
            some = [s for s in branches if s != {"type": "null"}]
            if len(branches) == 2 and len(some) == 1:
                return set() if value is None else plain(some[0], value, whole, path)
            tried = [plain(s, value, whole, path) for s in branches]
            clean = tried.count(set())
            if clean == 1 or clean and word == "anyOf":
                return set()
            near = [t for t in tried if not t & {("wrong_types", path), ("no_branch", path)}]
            return near[0] if not clean and len(near) == 1 else {("no_branch", path)}
    kind = schema.get("type")
    if kind and not is_type(value, kind):
        return {("wrong_types", path)}
    allowed = schema.get("enum", [schema["const"]] if "const" in schema else None)
    if allowed is not None and not any(type(a) is type(value) and a == value for a in allowed):
        return {("wrong_values", path)}
    out = set()
    if kind in ("number", "integer"):
        if value < schema.get("minimum", value) or value >= schema.get("exclusiveMaximum", value + 1):
            out.add(("wrong_values", path))
    if kind == "string":
        if len(value) > schema.get("maxLength", len(value)) or not re.search(schema.get("pattern", ""), value):
            out.add(("wrong_values", path))
    if kind == "object":
        prefix = f"{path}." if path else ""
        out |= {("missing_keys", prefix + k) for k in schema.get("required", []) if k not in value}
        for k, v in value.items():
            if k in schema.get("properties", {}):
                out |= plain(schema["properties"][k], v, whole, prefix + k)
            elif schema.get("additionalProperties", True) is False:
                out.add(("extra_keys", prefix + k))
            else:
                out |= plain(schema.get("additionalProperties", True), v, whole, prefix + k)
    if kind == "array":
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            out.add(("wrong_values", path))
        for v in value:
            out |= plain(schema.get("items", True), v, whole, path + "[]")
    return out


def random_schema(rng, names, depth):
    roll = rng.random()
    if names and roll < 0.25:
        return {"$ref": f"#/$defs/{rng.choice(names)}"}
    if depth > 0 and roll < 0.45:
        return {rng.choice(["anyOf", "anyOf", "oneOf"]): [random_schema(rng, names, depth - 1) for _ in range(rng.randint(1, 3))] + [{"type": "null"}] * rng.randint(0, 1)}
    if depth > 0 and roll < 0.75:
        keys = rng.sample("abc", rng.randint(0, 3))
        more = rng.choice([False, True, {"type": "integer"}])
        return {"type": "object", "properties": {k: random_schema(rng, names, depth - 1) for k in keys}, "required": rng.sample(keys, rng.randint(0, len(keys))), "additionalProperties": more}
    if depth > 0 and roll < 0.85:
        return {"type": "array", "items": random_schema(rng, names, depth - 1), "maxItems": 2}
    return rng.choice([{"type": "string", "maxLength": 1}, {"type": "integer", "minimum": 1}, {"type": "number"}, {"enum": ["x", 1, None]}, {"const": "y"}, {"type": "boolean"}, {"type": "null"}, {"type": "string", "pattern": "^x"}])


def random_value(rng, depth):
    roll = rng.random()
    if depth > 0 and roll < 0.5:
        return {k: random_value(rng, depth - 1) for k in rng.sample("abcd", rng.randint(0, 3))}
    if depth > 0 and roll < 0.65:
        return [random_value(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return rng.choice(["x", "y", "xx", "", 0, 1, 2, 1.5, True, None])


def fitting(rng, schema, whole, depth=0):
    """A value that mostly fits."""
    if not isinstance(schema, dict) or rng.random() < 0.05 or depth > 9:
        return random_value(rng, 1)
    if "$ref" in schema:
        return fitting(rng, whole["$defs"][schema["$ref"].split("/")[-1]], whole, depth + 1)
    for word in ("anyOf", "oneOf", "allOf"):
        if word in schema:
            return fitting(rng, rng.choice(schema[word]), whole, depth + 1)
    if schema.get("type") == "object":
        return {k: fitting(rng, s, whole, depth + 1) for k, s in schema["properties"].items() if k in schema["required"] or rng.random() < 0.7}
    if schema.get("type") == "array":
        return [fitting(rng, schema["items"], whole, depth + 1) for _ in range(rng.randint(0, 2))]
    return random_value(rng, 0)


def checked(spark, schema, values):
    rows = [(n, json.dumps(v)) for n, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "doc_id long, body string")
    return {r.doc_id: {(k, p) for k in KINDS for p in r[k]} for r in check_schema(frame, schema).collect() if r.well_formed}


def agree(spark, schema, values):
    got = checked(spark, schema, values)
    for n, value in enumerate(values):
        assert got[n] == plain(schema, value, schema), (schema, value)


def test_random_schemas(spark):
    rng = random.Random(12)
    tried = recursive = 0
    while tried < 8 or recursive < 3:
        names = ["P", "Q"][: rng.randint(0, 2)]
        schema = {**random_schema(rng, names, 3), "$defs": {n: random_schema(rng, names, 2) for n in names}}
        try:
            stops = Schema(schema).stops
        except SchemaError:
            continue
        if stops and recursive >= 3 or not stops and tried >= 8:
            continue
        tried, recursive = tried + (not stops), recursive + bool(stops)
        agree(spark, schema, [fitting(rng, schema, schema) for _ in range(60)] + [random_value(rng, 3) for _ in range(30)])


TREE = {
    "$ref": "#/$defs/Sum",
    "$defs": {
        "Sum": {"anyOf": [{"type": "number"}, {"$ref": "#/$defs/Pair"}, {"$ref": "#/$defs/Neg"}]},
        "Pair": {"type": "object", "properties": {"left": {"$ref": "#/$defs/Sum"}, "right": {"$ref": "#/$defs/Sum"}}, "required": ["left", "right"], "additionalProperties": False},
        "Neg": {"type": "object", "properties": {"of": {"$ref": "#/$defs/Sum"}, "note": {"anyOf": [{"type": "string"}, {"type": "null"}]}}, "required": ["of"], "additionalProperties": False},
    },
}


def test_recursive_unions(spark):
    deep = 1
    for n in range(16):
        deep = {"left": deep, "right": n} if n % 2 else {"of": deep}
    broken = 1
    for n in range(8):
        broken = {"left": broken if n != 3 else {"of": "x"}, "right": n}
    values = [3, "x", {"left": 1}, {"left": 1, "right": {"of": {"of": 2, "note": None}}}, {"of": 1, "extra": 2}, {"left": 1, "right": "x"}, deep, broken, None, [], {}]
    agree(spark, TREE, values)


def test_recursion_without_open_unions_stores_nothing(spark, monkeypatch):
    from inkproof.operators import json_schema

    def none(*_):
        raise AssertionError("a level was stored")

    monkeypatch.setattr(json_schema, "shared_folder", none)
    deep = '{"n":' * 300 + '"x"' + "}" * 300
    rows = [(1, deep), (1, deep), (None, '{"n":{"n":1,"m":[{"n":"y"},2]}}'), (2, None), (3, "{"), (4, '{"m":[]}')]
    schema = {
        "type": "object", "properties": {"n": {"anyOf": [{"type": "number"}, {"$ref": "#"}]}, "m": {"type": "array", "items": {"$ref": "#"}}},
        "required": ["n"], "additionalProperties": False,
    }
    checked = check_schema(spark.createDataFrame(rows, "doc_id int, body string"), schema).collect()
    told = sorted((r.doc_id or 0, r.well_formed, r.missing_keys, r.wrong_types, r.no_branch) for r in checked)
    at = ".".join("n" * 300)
    assert told == [
        (0, True, [], ["n.m[]"], ["n.m[].n"]), (1, True, [], [], [at]), (1, True, [], [], [at]),
        (2, False, [], [], []), (3, False, [], [], []), (4, True, ["n"], [], []),
    ]


def test_bodies_that_are_no_json(spark):
    frame = spark.createDataFrame([(1, "{"), (2, None), (3, "1"), (3, "1"), (4, "")], "doc_id long, body string")
    for schema in (TREE, {"type": "integer"}):
        rows = sorted((r.doc_id, r.well_formed, r.conforms) for r in check_schema(frame, schema).collect())
        assert rows == [(1, False, False), (2, False, False), (3, True, True), (3, True, True), (4, False, False)]
        assert check_schema(frame.limit(0), schema).count() == 0


def test_types_round_trip():
    long = T.StructType([T.StructField("title", T.StringType()), T.StructField("parties", T.ArrayType(T.StringType(), False), False), T.StructField("value", T.DoubleType()), T.StructField("pages", T.LongType(), False), T.StructField("signed", T.BooleanType())])
    for kind in (DEFAULT_RECORD, long, T.StructType([T.StructField("inner", T.ArrayType(long)), T.StructField("one", DEFAULT_RECORD)])):
        assert record_type(strict_schema(kind)) == kind
        assert strict_form(strict_schema(kind)) == json.loads(strict_schema(kind))


def test_types_of_other_schemas():
    kind = record_type(
        {
            "type": "object",
            "properties": {
                "tree": TREE["$defs"]["Sum"],
                "word": {"enum": ["a", "b"]},
                "map": {"type": "object", "additionalProperties": {"type": "integer"}},
                "again": {"$ref": "#/$defs/Node"},
                "free": True,
            },
            "required": ["word", "map", "again"],
            "$defs": {**TREE["$defs"], "Node": {"type": "object", "properties": {"next": {"anyOf": [{"$ref": "#/$defs/Node"}, {"type": "null"}]}, "n": {"type": "integer"}}, "required": ["next", "n"]}},
        }
    )
    node = T.StructType([T.StructField("next", T.VariantType()), T.StructField("n", T.LongType(), False)])
    assert kind == T.StructType(
        [
            T.StructField("tree", T.VariantType()),
            T.StructField("word", T.StringType(), False),
            T.StructField("map", T.MapType(T.StringType(), T.LongType(), False), False),
            T.StructField("again", node, False),
            T.StructField("free", T.VariantType()),
        ]
    )


def test_strict_form_reaches_everything():
    loose = {"properties": {"properties": {"type": "object", "properties": {"x": {"type": "string"}}}, "u": {"anyOf": [{"$ref": "#/$defs/P"}]}}, "$defs": {"P": {"type": "object", "properties": {"y": {"type": "integer"}}, "required": []}}}
    strict = strict_form(loose)
    assert strict["required"] == ["properties", "u"] and strict["additionalProperties"] is False
    assert strict["properties"]["properties"]["required"] == ["x"]
    assert strict["$defs"]["P"] == {"type": "object", "properties": {"y": {"type": "integer"}}, "required": ["y"], "additionalProperties": False}
    assert "required" not in loose


@pytest.mark.parametrize(
    "bad",
    [
        {"type": "string", "contentEncoding": "x"},
        {"$ref": "http://elsewhere"},
        {"$ref": "#/$defs/no"},
        {"anyOf": []},
        {"type": "date"},
        {"$ref": "#/$defs/A", "$defs": {"A": {"$ref": "#/$defs/B"}, "B": {"$ref": "#/$defs/A"}}},
        {"$ref": "#/$defs/A", "$defs": {"A": {"anyOf": [{"type": "string"}, {"anyOf": [{"$ref": "#/$defs/A"}, {"type": "null"}]}]}}},
        {"enum": [{}]},
        [],
    ],
)
def test_schemas_that_cannot_be_read(bad):
    with pytest.raises(SchemaError):
        Schema(bad)


def test_large_schemas_are_cut_at_their_references(spark):
    defs = {f"D{n}": {"type": "object", "properties": {k: {"$ref": f"#/$defs/D{n + 1}"} for k in "ab"}, "additionalProperties": False} for n in range(9)}
    defs["D9"] = {"type": "integer"}
    schema = {"$ref": "#/$defs/D0", "$defs": defs}
    value = 1
    for n in range(9):
        value = {"a": value} if n else {"a": 1, "b": "x"}
    assert Schema(schema).stops
    agree(spark, schema, [value, {"a": {"c": 1}}])


def test_requests_carry_the_strict_form(spark):
    from workload.catalog import RECEIPT_SCHEMA

    names = ["mode", "ocr_text", "image_uri", "file_uri", "filename", "instructions"]
    docs = spark.createDataFrame([(1, "text", "t", None, None, None, None)], "doc_id long, " + ", ".join(f"{n} string" for n in names))
    (row,) = extraction_requests(docs, model="m", schema=RECEIPT_SCHEMA).collect()
    assert json.loads(row.schema_json) == strict_form(RECEIPT_SCHEMA)
    assert json.loads(row.payload)["text"]["format"]["schema"] == strict_form(RECEIPT_SCHEMA)
