"""Submissions of annotations as JSON records: the annotation schema, and one audit of everything a submission must hold.

A record's parts are read straight from its parsed JSON, so a broken record gives
issues instead of an error.  Records meet the corpus in one join by task; the
other rules are expressions on the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text
from quillon.operators import audits, evaluation, schemas
from quillon.operators.audits import issues, repeated, row_issues, together
from quillon.operators.extract import FIELDS

# The names under which a field's parts stand in a record.
VALUE_NAMES = {"domain": "value", "latency": "class", "privacy": "data_class", "reliability": "tier", "accuracy": "tier", "energy_priority": "value", "divisibility": "value"}
NUMBER_NAMES = {"latency": "max_ms", "reliability": "min_success_probability", "accuracy": "min_score"}
NUMBER_LIMITS = {"latency": {"exclusiveMinimum": 0, "maximum": evaluation.LONGEST_MS}, "reliability": {"minimum": 0, "maximum": 1}, "accuracy": {"minimum": 0, "maximum": 1}}
#: Protocols whose labels must be consistent in their numbers.
NUMERIC_PROTOCOLS = ("1.1.0", "1.2.0", "1.3.0")


def _when(status: list[str], then: dict, evidence: dict) -> dict:
    return {"if": {"properties": {"status": {"enum": status}}}, "then": {"properties": {**then, "evidence": evidence}}}


def _label_schema(field: str) -> dict:
    some, none, null = {"minItems": 1}, {"maxItems": 0}, {"type": "null"}
    if field == "execution_policy":
        own = {t: {"enum": list(evaluation.PERMISSIONS)} for t in evaluation.TARGETS}
        known = {"enum": ["allowed", "forbidden"]}
        statuses, unknown = [*evaluation.STATUSES, "partial"], {t: {"const": "unknown"} for t in evaluation.TARGETS}
        rules = [
            _when(["explicit"], {t: known for t in evaluation.TARGETS}, some),
            {"if": {"properties": {"status": {"const": "partial"}}}, "then": {"properties": {"evidence": some}, "anyOf": [{"properties": {t: known}} for t in evaluation.TARGETS]}},
            _when(["ambiguous"], unknown, some),
            _when(["not_stated"], unknown, none),
        ]
    else:
        value, number = VALUE_NAMES[field], NUMBER_NAMES.get(field)
        own = {value: {"enum": [*evaluation.VALUES[field], None]}}
        if number:
            own[number] = {"type": ["number", "null"], **NUMBER_LIMITS[field]}
        if field == "accuracy":
            own["metric"] = {"type": ["string", "null"], "minLength": 1, "maxLength": evaluation.LONGEST_METRIC}
        statuses, nulls = list(evaluation.STATUSES), {name: null for name in own}
        rules = [_when(["explicit"], {value: {"type": "string"}}, some), _when(["ambiguous"], nulls, some), _when(["not_stated"], nulls, none)]
    names = [*own, "status", "evidence", "confidence"]
    shared = {"status": {"enum": statuses}, "evidence": {"$ref": "#/$defs/evidence"}, "confidence": {"$ref": "#/$defs/share"}}
    return {"type": "object", "additionalProperties": False, "required": names, "properties": {**own, **shared}, "allOf": rules}


def annotation_schema() -> dict:
    """The JSON Schema of an annotation: a label for every field, made from the vocabularies of `evaluation`."""
    labels = {f: _label_schema(f) for f in FIELDS}
    own = {
        "schema_version": {"const": "1.0.0"}, "task_id": {"type": "string", "pattern": evaluation.TASK_ID}, "language": {"enum": ["tr", "en"]}, **labels,
        "abstained_fields": {"type": "array", "uniqueItems": True, "items": {"enum": list(FIELDS)}}, "overall_confidence": {"$ref": "#/$defs/share"},
    }
    evidence = {"type": "array", "uniqueItems": True, "items": {"type": "string", "minLength": 1, "maxLength": evaluation.LONGEST_EVIDENCE}}
    return {"type": "object", "additionalProperties": False, "required": list(own), "properties": own, "$defs": {"share": {"type": "number", "minimum": 0, "maximum": 1}, "evidence": evidence}}


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _labels(rows: DataFrame) -> DataFrame:
    """task_id, visible, protocol and, a row a field, what `audits.numeric_issues` takes."""
    a = F.col("annotation")

    def one(f: str) -> Column:
        at = f"$.{f}"
        value = _get(a, f"{at}.{VALUE_NAMES[f]}") if f in VALUE_NAMES else F.lit(None).cast("string")
        number = _get(a, f"{at}.{NUMBER_NAMES[f]}", "double") if f in NUMBER_NAMES else F.lit(None).cast("double")
        metric = _get(a, f"{at}.metric") if f == "accuracy" else F.lit(None).cast("string")
        targets = [(_get(a, f"{at}.{t}") if f == "execution_policy" else F.lit(None).cast("string")).alias(t) for t in evaluation.TARGETS]
        evidence = F.coalesce(_get(a, f"{at}.evidence", "array<string>"), F.array().cast("array<string>"))
        return F.struct(F.lit(f).alias("field"), _get(a, f"{at}.status").alias("status"), value.alias("value"), number.alias("number"), metric.alias("metric"), _get(a, f"{at}.confidence", "double").alias("confidence"), evidence.alias("evidence"), *targets)

    return rows.select("task_id", "visible", "protocol", F.inline(F.array(*map(one, FIELDS))))


def audit_records(records: DataFrame, tasks: DataFrame, annotator: str, wrapper: dict, annotation: dict | None = None, protocol: str | None = None) -> DataFrame:
    """Issues (rule, key, detail) of a submission. records: number, text (JSON); tasks: task_id, language, task_text, user_policy_text.

    Keys are task ids (record numbers where a record names none).  Rules of form
    are `record_schema` and `annotation_schema`, with the place and the keyword as
    detail; the rest compares a record with its task and with itself.
    """
    semantic = annotation_schema() if annotation is None else annotation
    doc = F.try_parse_json("text")
    parsed = records.select(F.col("number").cast("string").alias("number"), "text", doc.alias("doc"))
    parsed = parsed.select("number", "text", "doc", F.variant_get("doc", "$.annotation", "variant").alias("annotation"), _get(F.col("doc"), "$.task_id").alias("task_id"))
    source = tasks.select(F.col("task_id").alias("known_id"), F.col("language").alias("own_language"), text.visible_text(F.col("task_text"), F.col("user_policy_text")).alias("visible"), audits.task_sha256(*(F.col(c) for c in ("task_id", "language", "task_text", "user_policy_text"))).alias("own_sha"))
    j = parsed.join(source, F.col("task_id") == F.col("known_id"), "left").withColumn("protocol", _get(F.col("doc"), "$.protocol_version"))
    j = j.withColumn("key", F.coalesce("task_id", F.concat(F.lit("record "), F.col("number"))))
    told, known = F.col("task_id").isNotNull(), F.col("known_id").isNotNull()
    labelled = j.where(known & F.schema_of_variant("annotation").startswith("OBJECT"))
    labels = _labels(labelled)
    held = labelled.select("task_id", F.array_sort(F.array_compact(F.array(*[F.when(_get(F.col("annotation"), f"$.{f}.status").isin(*evaluation.HELD), F.lit(f)) for f in FIELDS]))).alias("held"), F.array_sort(F.coalesce(_get(F.col("annotation"), "$.abstained_fields", "array<string>"), F.array().cast("array<string>"))).alias("said"))
    form = lambda rows, document, schema, rule: issues(schemas.broken(rows, ["key"], document, schema).select("key", F.inline("issues")), rule, F.col("key"), F.concat_ws(" ", "path", "rule"))
    rules = [
        ("unknown_task", told & ~known),
        ("wrong_annotator", known & ~_get(F.col("doc"), "$.annotator_id").eqNullSafe(F.lit(annotator))),
        ("wrong_protocol", known & ~F.col("protocol").eqNullSafe(F.lit(protocol)) if protocol else F.lit(False)),
        ("stale_hash", known & ~_get(F.col("doc"), "$.task_content_sha256").eqNullSafe(F.col("own_sha"))),
        ("task_ids_disagree", known & F.schema_of_variant("annotation").startswith("OBJECT") & ~_get(F.col("annotation"), "$.task_id").eqNullSafe(F.col("task_id"))),
        ("language_disagrees", known & F.schema_of_variant("annotation").startswith("OBJECT") & ~_get(F.col("annotation"), "$.language").eqNullSafe(F.col("own_language"))),
        ("not_json", F.col("doc").isNull()),
    ]
    return together([
        row_issues(j, "key", rules),
        form(j.where("doc is not null"), "doc", wrapper, "record_schema"),
        form(labelled, "annotation", semantic, "annotation_schema"),
        audits.ungrounded_evidence(labels, "visible"),
        issues(held.where("held <> said"), "abstained_fields_differ", F.col("task_id")),
        audits.numeric_issues(labels.where(F.col("protocol").isin(*NUMERIC_PROTOCOLS))),
        repeated(parsed, "task_repeated", F.col("task_id")),
        issues(source.join(parsed.select(F.col("task_id").alias("known_id")), "known_id", "left_anti"), "task_not_covered", F.col("known_id")),
    ])
