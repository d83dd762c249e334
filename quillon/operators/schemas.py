"""JSON Schema compiled to Column expressions over parsed JSON (VARIANT): issue rows for any number of documents.

A schema is walked once on the driver; what it demands becomes one expression
that gives the array of (path, rule) a document breaks, inside the JVM.  Paths
are JSON pointers; rules are the keywords.  Like the usual validators, `$ref`,
`allOf`, `if`/`then`/`else`, `properties` and `items` report what is wrong
inside them, while `anyOf`, `oneOf`, `not` and `contains` are one issue each.

Supported: type, enum, const, pattern, format (date; other formats are notes, as
in the specification), lengths, bounds, required, properties,
additionalProperties, items, contains, minItems, maxItems, uniqueItems, allOf,
anyOf, oneOf, not, if/then/else, local $ref.  Other keywords that constrain, and
schemas that contain themselves, are refused rather than passed over.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOTES = frozenset("$schema $id $comment $defs title description default examples deprecated readOnly writeOnly format".split())
KNOWN = NOTES | frozenset(
    "$ref type enum const pattern minLength maxLength minimum maximum exclusiveMinimum exclusiveMaximum multipleOf required properties additionalProperties "
    "items contains minItems maxItems uniqueItems allOf anyOf oneOf not if then else".split()
)
_ISSUES = "array<struct<path:string,rule:string>>"
_BOUNDS = {"minimum": lambda x, n: x < n, "maximum": lambda x, n: x > n, "exclusiveMinimum": lambda x, n: x <= n, "exclusiveMaximum": lambda x, n: x >= n}


class SchemaError(ValueError):
    pass


class _Value:
    """A place in a document: a VARIANT column and a path below it, so that nested places are read from the root in one step.

    parts: what has been read of places so far, as columns of their own by name;
    None inside arrays, whose elements have no columns.
    """

    def __init__(self, root: Column, steps: tuple[str, ...] = (), at: Column | None = None, parts: dict[str, Column] | None = None):
        self.root, self.steps, self.parts = root, steps, parts
        self.at = F.lit("") if at is None else at  # pointer to the root
        if any(c in s for s in steps for c in "'\\`"):
            raise SchemaError(f"a name with quotes or backslashes can't be read: {steps}")
        self.path = "$" + "".join(f"['{s}']" for s in steps)

    def child(self, name: str) -> _Value:
        return _Value(self.root, (*self.steps, name), self.at, self.parts)

    def _read(self, what: str, made: Column) -> Column:
        if self.parts is None:
            return made
        name = f"{what} of {self.path}"
        self.parts.setdefault(name, made)
        return F.col(f"`{name}`")

    def value(self) -> Column:
        return self.root if not self.steps else F.variant_get(self.root, self.path, "variant")

    def cast(self, kind: str) -> Column:
        return self._read(kind, F.try_variant_get(self.root, self.path, kind))

    def kind(self) -> Column:
        return self._read("kind", F.schema_of_variant(self.value()))

    def absent(self) -> Column:
        return self.kind().isNull()

    def pointer(self) -> Column:
        own = "".join("/" + s.replace("~", "~0").replace("/", "~1") for s in self.steps)
        return F.concat(self.at, F.lit(own)) if own else self.at

    def is_a(self, kind: str) -> Column:
        k = self.kind()
        number = k.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")
        if kind == "integer":
            return number & (self.cast("double") == F.floor(self.cast("double")))
        tests = {"object": k.startswith("OBJECT"), "array": k.startswith("ARRAY"), "string": k == "STRING", "boolean": k == "BOOLEAN", "null": k == "VOID", "number": number}
        if kind not in tests:
            raise SchemaError(f"unknown type {kind}")
        return tests[kind]

    def equals(self, constant) -> Column:
        if constant is None:
            return self.is_a("null")
        if isinstance(constant, bool):
            return self.is_a("boolean") & (self.cast("boolean") == constant)
        if isinstance(constant, (int, float)):
            return self.is_a("number") & (self.cast("double") == float(constant))
        if isinstance(constant, str):
            return self.is_a("string") & (self.cast("string") == constant)
        return F.to_json(self.value()) == F.to_json(F.parse_json(F.lit(json.dumps(constant))))


def _one(fails: Column, path: Column, rule: str) -> Column:
    return F.when(F.coalesce(fails, F.lit(False)), F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule"))))


def _identity(x: Column) -> Column:
    """A text that two items share if they are equal: 1 and 1.0 are."""
    v = _Value(x)
    return F.when(v.is_a("number"), F.concat(F.lit("n"), v.cast("double").cast("string"))).otherwise(F.to_json(x))


class _Compiler:
    def __init__(self, schema: dict):
        self.schema, self.open = schema, []

    def all(self, parts: list[Column]) -> Column:
        """Issues of all parts; a part that has none is null or empty."""
        none = F.lit(None).cast(_ISSUES)
        if not parts:
            return F.array().cast(_ISSUES)
        return F.flatten(F.filter(F.array(*parts, none), lambda x: x.isNotNull()))

    def valid(self, schema, v: _Value) -> Column:
        return F.size(self.issues(schema, v)) == 0

    def target(self, ref: str) -> dict:
        if not ref.startswith("#"):
            raise SchemaError(f"only references within the schema are followed: {ref}")
        out = self.schema
        for name in ref[1:].split("/")[1:]:
            name = name.replace("~1", "/").replace("~0", "~")
            if not isinstance(out, dict) or name not in out:
                raise SchemaError(f"no {ref}")
            out = out[name]
        return out

    def issues(self, schema, v: _Value) -> Column:
        return self.all(self.parts(schema, v))

    def parts(self, schema, v: _Value) -> list[Column]:
        path = v.pointer()
        if schema is True:
            return []
        if schema is False:
            return [_one(F.lit(True), path, "false")]
        if not isinstance(schema, dict):
            raise SchemaError(f"not a schema: {schema!r}")
        if unknown := set(schema) - KNOWN:
            raise SchemaError(f"not supported: {sorted(unknown)}")
        out: list[Column] = []
        fails = lambda test, rule: out.append(_one(test, path, rule))
        if "$ref" in schema:
            if schema["$ref"] in self.open:
                raise SchemaError(f"{schema['$ref']} contains itself")
            self.open.append(schema["$ref"])
            out += self.parts(self.target(schema["$ref"]), v)
            self.open.pop()
        if "type" in schema:
            kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
            fails(~reduce(or_, [v.is_a(k) for k in kinds]), "type")
        if "const" in schema:
            fails(~v.equals(schema["const"]), "const")
        if "enum" in schema:
            texts = [x for x in schema["enum"] if isinstance(x, str)]
            tests = [v.is_a("string") & v.cast("string").isin(texts)] if texts else []
            fails(~reduce(or_, [*tests, *[v.equals(x) for x in schema["enum"] if not isinstance(x, str)]]), "enum")
        text, size = v.cast("string"), F.length(v.cast("string"))
        string = v.is_a("string")
        if "minLength" in schema:
            fails(string & (size < schema["minLength"]), "minLength")
        if "maxLength" in schema:
            fails(string & (size > schema["maxLength"]), "maxLength")
        if "pattern" in schema:
            fails(string & ~text.rlike(schema["pattern"]), "pattern")
        if schema.get("format") == "date":
            fails(string & ~(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & text.try_cast("date").isNotNull()), "format")
        number, x = v.is_a("number"), v.cast("double")
        for key, beyond in _BOUNDS.items():
            if key in schema:
                fails(number & beyond(x, float(schema[key])), key)
        if "multipleOf" in schema:
            fails(number & (x / float(schema["multipleOf"]) != F.floor(x / float(schema["multipleOf"]))), "multipleOf")
        self._objects(schema, v, out)
        self._arrays(schema, v, out)
        for sub in schema.get("allOf", []):
            out += self.parts(sub, v)
        if "anyOf" in schema:
            fails(~reduce(or_, [self.valid(s, v) for s in schema["anyOf"]]), "anyOf")
        if "oneOf" in schema:
            fails(reduce(lambda a, b: a + b, [self.valid(s, v).cast("int") for s in schema["oneOf"]]) != 1, "oneOf")
        if "not" in schema:
            fails(self.valid(schema["not"], v), "not")
        if "if" in schema and ("then" in schema or "else" in schema):
            none = F.lit(None).cast(_ISSUES)
            then, other = (self.issues(schema[k], v) if k in schema else none for k in ("then", "else"))
            out.append(F.when(self.valid(schema["if"], v), then).otherwise(other))
        return out

    def _objects(self, schema: dict, v: _Value, out: list[Column]) -> None:
        is_object, path = v.is_a("object"), v.pointer()
        for name in schema.get("required", []):
            out.append(_one(is_object & v.child(name).absent(), path, "required"))
        for name, sub in schema.get("properties", {}).items():
            parts = self.parts(sub, v.child(name))
            if parts:
                out.append(F.when(is_object & ~v.child(name).absent(), self.all(parts)))
        more = schema.get("additionalProperties", True)
        if more is not True:
            known = list(schema.get("properties", {}))
            own = v.cast("map<string,variant>")
            rest = F.filter(F.map_keys(own), lambda k: ~k.isin(known)) if known else F.map_keys(own)
            if more is False:
                out.append(_one(is_object & (F.size(rest) > 0), path, "additionalProperties"))
            else:
                escaped = lambda k: F.concat(path, F.lit("/"), F.replace(F.replace(k, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))
                out.append(F.when(is_object, F.flatten(F.transform(rest, lambda k: self.issues(more, _Value(F.element_at(own, k), at=escaped(k)))))))

    def _arrays(self, schema: dict, v: _Value, out: list[Column]) -> None:
        is_array, items, path = v.is_a("array"), v.cast("array<variant>"), v.pointer()
        if "items" in schema and schema["items"] is not True:
            at = lambda i: F.concat(path, F.lit("/"), i.cast("string"))
            out.append(F.when(is_array, F.flatten(F.transform(items, lambda x, i: self.issues(schema["items"], _Value(x, at=at(i)))))))
        if "contains" in schema:
            out.append(_one(is_array & ~F.exists(items, lambda x: self.valid(schema["contains"], _Value(x))), path, "contains"))
        if "minItems" in schema:
            out.append(_one(is_array & (F.size(items) < schema["minItems"]), path, "minItems"))
        if "maxItems" in schema:
            out.append(_one(is_array & (F.size(items) > schema["maxItems"]), path, "maxItems"))
        if schema.get("uniqueItems"):
            out.append(_one(is_array & (F.size(F.array_distinct(F.transform(items, _identity))) < F.size(items)), path, "uniqueItems"))


def check_schema(schema) -> None:
    """Raises SchemaError if the schema can't be compiled; needs a session, as columns do."""
    issues_of(F.col("document"), schema)


def issues_of(document: Column, schema: dict) -> Column:
    """array<struct<path, rule>> of what a VARIANT column breaks."""
    return _Compiler(schema).issues(schema, _Value(document))


def broken(rows: DataFrame, keep: list[str], document: str, schema: dict) -> DataFrame:
    """keep..., issues (array<struct<path, rule>>) of the VARIANT column `document`, null for a null document.

    Each place of the documents that the schema speaks of is read once into a
    column of its own, whose names can't be a caller's; the demands are made of
    these columns, which keeps the expression small however large the schema is.
    """
    parts: dict[str, Column] = {}
    found = _Compiler(schema).issues(schema, _Value(F.col(document), parts=parts))
    rows = rows.select(*keep, document, *[c.alias(n) for n, c in parts.items()])
    return rows.select(*keep, F.when(F.col(document).isNotNull(), found).alias("issues"))


def schema_issues(df: DataFrame, key: str, text: str, schema: dict) -> DataFrame:
    """key, path, rule: one row for each demand of the schema that the JSON text of a row breaks.

    A text that isn't JSON (or is null) has the one rule `json`.  Only rows with
    issues leave the scan, and no row meets another: there is no shuffle.
    """
    rows = df.select(F.col(f"`{key}`").alias("key"), F.try_parse_json(F.col(f"`{text}`")).alias("document"))
    unread = F.array(F.struct(F.lit("").alias("path"), F.lit("json").alias("rule")))
    return broken(rows, ["key"], "document", schema).select("key", F.inline(F.coalesce("issues", unread)))


def valid_documents(df: DataFrame, text: str, schema: dict) -> Column:
    """Whether the JSON text of a row obeys the schema."""
    document = F.try_parse_json(F.col(text))
    return F.when(document.isNull(), F.lit(False)).otherwise(F.size(issues_of(document, schema)) == 0)

