"""Compiled JSON Schemas against a plain recursive validator."""

import json
import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from quillon.operators import schemas


def kinds(x):
    if isinstance(x, bool):
        return {"boolean"}
    if isinstance(x, (int, float)):
        return {"number"} | ({"integer"} if float(x).is_integer() else set())
    return {{str: "string", list: "array", dict: "object", type(None): "null"}[type(x)]}


def equal(a, b):
    return kinds(a) == kinds(b) and a == b


def plain(schema, x, root, path=""):
    """(path, rule) of everything in x that breaks the schema."""
    if isinstance(schema, bool):
        return [] if schema else [(path, "false")]
    out, k = [], kinds(x)
    ok = lambda s: not plain(s, x, root, path)
    for key, v in schema.items():
        bad = False
        if key == "$ref":
            target = root
            for name in v[1:].split("/")[1:]:
                target = target[name]
            out += plain(target, x, root, path)
        elif key == "type":
            bad = not k & set(v if isinstance(v, list) else [v])
        elif key == "enum":
            bad = not any(equal(x, y) for y in v)
        elif key == "const":
            bad = not equal(x, v)
        elif key == "required" and "object" in k:
            out += [(path, key) for name in v if name not in x]
        elif key == "properties" and "object" in k:
            for name, sub in v.items():
                if name in x:
                    out += plain(sub, x[name], root, f"{path}/{name.replace('~', '~0').replace('/', '~1')}")
        elif key == "additionalProperties" and "object" in k:
            rest = set(x) - set(schema.get("properties", {}))
            if v is False:
                bad = bool(rest)
            else:
                for name in rest:
                    out += plain(v, x[name], root, f"{path}/{name.replace('~', '~0').replace('/', '~1')}")
        elif key == "items" and "array" in k:
            for i, y in enumerate(x):
                out += plain(v, y, root, f"{path}/{i}")
        elif key == "allOf":
            for s in v:
                out += plain(s, x, root, path)
        elif key == "if":
            then = schema.get("then" if ok(v) else "else", True)
            out += plain(then, x, root, path)
        else:
            n = "number" in k
            tests = {
                "pattern": lambda: "string" in k and not re.search(v, x), "minLength": lambda: "string" in k and len(x) < v, "maxLength": lambda: "string" in k and len(x) > v,
                "minimum": lambda: n and x < v, "maximum": lambda: n and x > v, "exclusiveMinimum": lambda: n and x <= v, "exclusiveMaximum": lambda: n and x >= v, "multipleOf": lambda: n and x % v != 0,
                "minItems": lambda: "array" in k and len(x) < v, "maxItems": lambda: "array" in k and len(x) > v, "contains": lambda: "array" in k and not any(not plain(v, y, root) for y in x),
                "uniqueItems": lambda: "array" in k and v and any(equal(a, b) for i, a in enumerate(x) for b in x[:i]),
                "anyOf": lambda: not any(map(ok, v)), "oneOf": lambda: sum(map(ok, v)) != 1, "not": lambda: ok(v), "format": lambda: v == "date" and "string" in k and not is_date(x),
            }
            bad = key in tests and tests[key]()
        if bad:
            out.append((path, key))
    return out


def is_date(x):
    try:
        return bool(re.fullmatch("[0-9]{4}-[0-9]{2}-[0-9]{2}", x)) and bool(date.fromisoformat(x))
    except ValueError:
        return False


LABEL = {
    "type": "object", "additionalProperties": False, "required": ["value", "status", "evidence"],
    "properties": {"value": {"enum": ["a", "b", 1, 2.5, True, None]}, "status": {"$ref": "#/$defs/status"}, "evidence": {"$ref": "#/$defs/evidence"}, "number": {"type": ["number", "null"], "exclusiveMinimum": 0, "maximum": 10}},
    "allOf": [
        {"if": {"properties": {"status": {"const": "explicit"}}, "required": ["status"]}, "then": {"properties": {"evidence": {"minItems": 1}, "value": {"not": {"const": None}}}}, "else": {"properties": {"value": {"type": "null"}}}},
        {"anyOf": [{"required": ["number"]}, {"properties": {"evidence": {"maxItems": 2}}}]},
    ],
}
SCHEMA = {
    "$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "required": ["id", "first"], "additionalProperties": {"type": ["integer", "string"]},
    "properties": {"id": {"type": "string", "pattern": "^[A-Za-z][a-z0-9._-]{2,7}$"}, "first": {"$ref": "#/$defs/label"}, "list": {"type": "array", "uniqueItems": True, "items": {"$ref": "#/$defs/label"}, "contains": {"required": ["number"]}}, "day": {"type": "string", "format": "date"}, "n": {"type": "integer", "multipleOf": 3}, "one": {"oneOf": [{"type": "string"}, {"minimum": 3}, {"const": 5}]}, "o/~": {"const": {"x": [1]}}},
    "$defs": {"label": LABEL, "status": {"enum": ["explicit", "not_stated"]}, "evidence": {"type": "array", "uniqueItems": True, "items": {"type": "string", "minLength": 1, "maxLength": 5}}},
}


def some(r, depth=0):
    return r.choice([None, True, False, 0, 1, 1.0, 3, 5, 2.5, -4, 11, "a", "b", "explicit", "", "lang und breit", "2024-02-30", [], ["a", "a"], [1, 1.0], {}, {"x": [1]}, {"value": "a"}])


def label(r):
    out = {"value": r.choice(["a", "b", None, 1, "z"]), "status": r.choice(["explicit", "not_stated", "other"]), "evidence": r.choice([[], ["é"], ["a", "b"], ["a", "a"], ["toolong", ""], ["a", "b", "c"], "x"]), "number": r.choice([0, 1, 10, 10.5, None, "1"]), "more": 1}
    return {k: v for k, v in out.items() if r.random() < (0.05 if k == "more" else 0.5 if k == "number" else 0.93)}


def test_issues_equal_a_plain_validator(spark):
    r = random.Random(6)
    docs = []
    for i in range(1500):
        d = {"id": r.choice(["abc", "A.b-c_1", "1ab", "ab", "toolong99", "äbc"]), "first": label(r) if r.random() < 0.9 else some(r), "list": [label(r) for _ in range(r.randrange(4))], "day": r.choice(["2024-02-29", "2023-02-29", "24-1-1", "2024-01-01T00"]), "n": r.choice([3, 6.0, 4, 4.5, "3"]), "one": some(r), "o/~": r.choice([{"x": [1]}, {"x": [2]}]), f"extra{i % 3}": some(r), "a/b~c": some(r)}
        docs.append({k: v for k, v in d.items() if r.random() < 0.8} if r.random() < 0.97 else some(r))
    docs += [{"id": "abc", "first": {"value": v, "status": s, "evidence": e}, "n": 3 * i} for i in range(5) for v, s, e in (("a", "explicit", ["x"]), (None, "not_stated", []), (1.0, "explicit", ["é", "y"]))]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(-1, None), (-2, "{"), (-3, "")], "key int, text string")
    got = {}
    for x in schemas.schema_issues(df, "key", "text", SCHEMA).collect():
        got.setdefault(x.key, []).append((x.path, x.rule))
    assert {k: got.pop(k) for k in (-1, -2, -3)} == {k: [("", "json")] for k in (-1, -2, -3)}
    for i, d in enumerate(docs):
        assert sorted(got.get(i, [])) == sorted(plain(SCHEMA, d, SCHEMA)), d
    good = {x.key for x in df.where(schemas.valid_documents(df, "text", SCHEMA)).collect()}
    assert good == {i for i in range(len(docs)) if i not in got} and 0 < len(good) < len(docs)


@pytest.mark.parametrize("schema, told", [({"patternProperties": {}}, "not supported"), ({"properties": {"a": {"dependentRequired": {}}}}, "not supported"), ({"$ref": "#/$defs/a", "$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}}, "contains itself"), ({"$ref": "other.json"}, "within the schema"), ({"$ref": "#/$defs/x"}, "no #"), ({"type": "text"}, "unknown type"), (3, "not a schema"), ({"properties": {"it's": {"type": "null"}}}, "quotes")])
def test_what_cannot_be_checked_is_refused(spark, schema, told):
    with pytest.raises(schemas.SchemaError, match=told):
        schemas.check_schema(schema)


def test_any_document_passes_an_empty_schema(spark):
    df = spark.createDataFrame([(1, "3"), (2, "null")], "key int, text string")
    for s in ({}, True, {"title": "x", "format": "uri"}):
        assert schemas.schema_issues(df, "key", "text", s).count() == 0
    assert [tuple(r) for r in schemas.schema_issues(df, "key", "text", False).orderBy("key").collect()] == [(1, "", "false"), (2, "", "false")]
    assert schemas.schema_issues(df.limit(0), "key", "text", SCHEMA).select(F.col("path")).count() == 0
