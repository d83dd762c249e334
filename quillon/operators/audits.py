"""Audits: each returns issue rows (rule, key, detail)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import casting, identity, text
from quillon.operators import schemas

ISSUE = ("rule", "key", "detail")
PACKET_KEYS = ("packet_version", "protocol_version", "annotator_id", "presentation_order", "task_id", "language", "task_text", "user_policy_text", "task_content_sha256")
# What a pilot corpus must hold, and the frozen vocabularies.
DOMAINS = ("agriculture", "consumer", "healthcare", "industrial", "other", "public_safety", "smart_city", "transportation")
PHENOMENA = ("ambiguity", "explicit_accuracy", "explicit_divisibility", "explicit_energy", "explicit_execution_policy", "explicit_latency", "explicit_privacy", "explicit_reliability", "missing_information", "negation", "numeric_threshold")
PROVENANCE = ("derived", "generated", "human_labeled", "matched", "measured", "observed", "simulated")
TRANSITIONS = {
    "catalogued": ("license_pending", "access_pending", "downloaded", "rejected"),
    "license_pending": ("catalogued", "access_pending", "downloaded", "rejected"),
    "access_pending": ("catalogued", "downloaded", "rejected"),
    "downloaded": ("checksum_verified", "rejected"),
    "checksum_verified": ("schema_validated", "rejected"),
    "schema_validated": ("rejected",),
    "rejected": (),
}


def issues(df: DataFrame, rule: str, key: Column, detail: Column | str = "") -> DataFrame:
    d = detail if isinstance(detail, Column) else F.lit(detail)
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), d.cast("string").alias("detail"))


def together(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def row_issues(df: DataFrame, key: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """One issue per row and broken rule, all rules in one pass. A null condition breaks nothing."""
    hits = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))
    return df.select(F.col(key).cast("string").alias("key"), F.explode(hits).alias("rule")).select("rule", "key", F.lit("").alias("detail"))


def repeated(df: DataFrame, rule: str, value: Column) -> DataFrame:
    """An issue for each value that occurs more than once, with its number as detail."""
    n = df.groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 and v is not null")
    return issues(n, rule, F.col("v"), F.col("n"))


def sensitive_flags(c: Column) -> list[Column]:
    return [F.coalesce(c.rlike(p), F.lit(False)).alias(f"has_{name}") for name, p in text.SENSITIVE.items()]


def audit_corpus(tasks: DataFrame, expected: int | None = None, schema: dict | None = None, record: str = "record", key: Callable[[Column], Column] = text.text_key, sensitive: Mapping[str, str] = text.SENSITIVE) -> DataFrame:
    """tasks: task_id, task_text, user_policy_text, scenario_domain, semantic_phenomena (array); with a JSON Schema also record, the JSON text of the task.

    Texts of one key count as equal; sensitive are the forbidden patterns by name.
    """
    both = F.concat("task_text", F.lit("\n"), F.coalesce("user_policy_text", F.lit("")))
    t = tasks.withColumn("_both", both)
    parts = [
        row_issues(t, "task_id", [(f"forbidden_{name}", F.col("_both").rlike(p)) for name, p in sensitive.items()] + [("missing_text", F.coalesce(F.trim("task_text") == "", F.lit(True)))]),
        repeated(t, "task_id_not_unique", F.col("task_id")),
        repeated(t, "text_not_unique", key(F.col("_both"))),
    ]
    if expected is not None:
        n = t.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected)
        parts.append(issues(n, "unexpected_count", F.lit(expected), F.col("n")))
    if schema is not None:
        parts.append(issues(schemas.schema_issues(tasks, "task_id", record, schema), "task_schema", F.col("key"), F.concat_ws(" ", "path", "rule")))
    spark = tasks.sparkSession
    need = spark.createDataFrame([(d,) for d in DOMAINS], "d string")
    have = t.groupBy(F.col("scenario_domain").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    parts.append(issues(need.join(have, "d", "left").where("coalesce(n, 0) < 2"), "domain_underrepresented", F.col("d"), F.coalesce("n", F.lit(0))))
    seen = t.select(F.explode("semantic_phenomena").alias("p")).distinct()
    parts.append(issues(spark.createDataFrame([(p,) for p in PHENOMENA], "p string").join(seen, "p", "left_anti"), "phenomenon_missing", F.col("p")))
    return together(parts)


def frequencies(df: DataFrame, column: str, many: bool = False) -> DataFrame:
    """value, n; with many, of each element of an array column."""
    c = F.explode(column) if many else F.col(column)
    return df.select(c.alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def task_sha256(task_id: Column, language: Column, task_text: Column, policy: Column) -> Column:
    """The content hash covers id, language, text and policy, nothing else."""
    return identity.content_sha256({"task_id": task_id, "language": language, "task_text": task_text, "user_policy_text": policy})


def blind_packet(tasks: DataFrame, annotator: str, seed: str, packet_version: str = "1.0.0", protocol_version: str = "1.1.0") -> DataFrame:
    """Only the allowed columns leave, in a seeded order of their own for each annotator."""
    from quillon.operators.splits import presentation_order

    t = tasks.select("task_id", "language", "task_text", "user_policy_text")
    t = t.withColumns({"packet_version": F.lit(packet_version), "protocol_version": F.lit(protocol_version), "annotator_id": F.lit(annotator), "task_content_sha256": task_sha256(*(F.col(c) for c in ("task_id", "language", "task_text", "user_policy_text")))})
    return presentation_order(t, "task_id", f"{seed}:{annotator}").select(*PACKET_KEYS)


def audit_packet(packet: DataFrame, tasks: DataFrame, annotator: str, packet_version: str = "1.0.0") -> DataFrame:
    extra, missing = sorted(set(packet.columns) - set(PACKET_KEYS)), sorted(set(PACKET_KEYS) - set(packet.columns))
    one = packet.sparkSession.range(1)
    parts = [issues(one, "extra_column", F.lit(c)) for c in extra] + [issues(one, "missing_column", F.lit(c)) for c in missing]
    if not missing:
        src = tasks.select(F.col("task_id"), F.col("task_text").alias("_text"), F.col("user_policy_text").alias("_policy"), task_sha256(*(F.col(c) for c in ("task_id", "language", "task_text", "user_policy_text"))).alias("_sha"))
        j = packet.join(src, "task_id", "left")
        known = F.col("_sha").isNotNull()
        parts += [
            row_issues(j, "task_id", [("wrong_annotator", F.col("annotator_id") != annotator), ("wrong_version", F.col("packet_version") != packet_version), ("unknown_task", ~known), ("changed_text", known & ~(F.col("task_text").eqNullSafe(F.col("_text")) & F.col("user_policy_text").eqNullSafe(F.col("_policy")))), ("stale_hash", known & ~F.col("task_content_sha256").eqNullSafe(F.col("_sha")))]),
            repeated(packet, "task_repeated", F.col("task_id")),
            issues(tasks.join(packet.select("task_id"), "task_id", "left_anti"), "task_not_covered", F.col("task_id")),
            issues(packet.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("presentation_order").alias("d"), F.min("presentation_order").alias("a"), F.max("presentation_order").alias("b")).where("n > 0 and (n <> d or a <> 1 or b <> n)"), "order_not_contiguous", F.lit("packet")),
        ]
    return together(parts)


def ungrounded_evidence(labels: DataFrame, visible: str) -> DataFrame:
    """labels: task_id, field, evidence (array), and the visible text: an issue per snippet that isn't an exact substring."""
    e = labels.select("task_id", "field", F.col(visible).alias("_v"), F.explode("evidence").alias("snippet"))
    return issues(e.where(~F.col("_v").contains(F.col("snippet"))), "evidence_not_in_text", F.concat_ws(".", "task_id", "field"), F.col("snippet"))


def abstention_issues(annotations: DataFrame, labels: DataFrame) -> DataFrame:
    """annotations: task_id, abstained_fields; labels: task_id, field, status."""
    held = labels.groupBy("task_id").agg(F.array_sort(F.collect_set(F.when(F.col("status").isin("not_stated", "ambiguous"), F.col("field")))).alias("_e"))
    j = annotations.join(held, "task_id", "left")
    same = F.array_sort(F.array_distinct("abstained_fields")).eqNullSafe(F.coalesce("_e", F.array().cast("array<string>")))
    return issues(j.where(~same), "abstained_fields_differ", F.col("task_id"))


def numeric_issues(labels: DataFrame) -> DataFrame:
    """Consistency of numbers and evidence. labels: task_id, field, status, value, number, metric, confidence, evidence (array), device, edge, cloud."""
    joined = F.array_join("evidence", "\n")
    stated = {
        "latency": F.transform(F.regexp_extract_all(joined, F.lit(text.LATENCY), F.lit(0)), text.stated_latency_ms),
        "reliability": F.transform(F.regexp_extract_all(joined, F.lit(f"(?:{text.PERCENT_BEFORE})|(?:{text.PERCENT_AFTER})"), F.lit(0)), text.stated_share),
    }
    unit = F.transform(F.regexp_extract_all(joined, F.lit(r"(?:^|[^0-9.,%])(0[.,][0-9]+|1[.,]0+)(?![0-9]*\s*%)"), F.lit(1)), text.number)
    stated["accuracy"] = F.concat(stated["reliability"], unit)
    number = F.col("number")
    rules = [("confidence_not_allowed", ~F.coalesce(F.col("confidence").isin(0.5, 0.7, 0.9), F.lit(False)))]
    for f, values in stated.items():
        here = (F.col("field") == f) & (F.col("status") == "explicit")
        some = F.size(values) > 0
        rules += [
            (f"{f}_number_missing", here & some & number.isNull()),
            (f"{f}_number_without_evidence", here & ~some & number.isNotNull()),
            (f"{f}_number_disagrees", here & some & number.isNotNull() & ~F.exists(values, lambda x: F.abs(x - number) <= 1e-9)),
        ]
    low = F.lower(F.coalesce("metric", F.lit("")))
    explicit = F.col("status") == "explicit"
    rules += [
        ("latency_class_disagrees", (F.col("field") == "latency") & explicit & number.isNotNull() & ~F.col("value").eqNullSafe(casting.latency_class(number))),
        ("accuracy_metric_missing", (F.col("field") == "accuracy") & explicit & joined.rlike(r"(?i)\bF1\b") & (low != "f1")),
        ("accuracy_metric_not_in_evidence", (F.col("field") == "accuracy") & explicit & F.col("metric").isNotNull() & ~F.lower(joined).contains(low)),
        ("partial_without_unknown", (F.col("field") == "execution_policy") & (F.col("status") == "partial") & ~F.array_contains(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in ("device", "edge", "cloud")]), "unknown")),
    ]
    keyed = labels.withColumn("_key", F.concat_ws(".", "task_id", "field"))
    return row_issues(keyed, "_key", rules)


def audit_submission(submission: DataFrame, tasks: DataFrame, annotator: str) -> DataFrame:
    """submission: annotator_id, task_id, task_content_sha256, protocol_version, language."""
    src = tasks.select("task_id", F.col("language").alias("_lang"), task_sha256(*(F.col(c) for c in ("task_id", "language", "task_text", "user_policy_text"))).alias("_sha"))
    j = submission.join(src, "task_id", "left")
    known = F.col("_sha").isNotNull()
    versions = submission.agg(F.count_distinct("protocol_version").alias("n")).where("n > 1")
    return together([
        row_issues(j, "task_id", [("unknown_task", ~known), ("stale_hash", known & ~F.col("task_content_sha256").eqNullSafe(F.col("_sha"))), ("wrong_language", known & ~F.col("language").eqNullSafe(F.col("_lang"))), ("wrong_annotator", F.col("annotator_id") != annotator)]),
        repeated(submission, "task_repeated", F.col("task_id")),
        issues(tasks.join(submission.select("task_id"), "task_id", "left_anti"), "task_not_covered", F.col("task_id")),
        issues(versions, "several_protocol_versions", F.lit("submission"), F.col("n")),
    ])


def release_gate(tasks: DataFrame, status: str = "human_text_review") -> DataFrame:
    """One row: n, approved, is_ready (all approved, and there are some)."""
    return tasks.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(status) == "approved").alias("approved")).withColumn("is_ready", (F.col("n") > 0) & (F.col("n") == F.col("approved")))


def overlap(left: DataFrame, right: DataFrame, left_text: str, right_text: str) -> DataFrame:
    """Rows of left whose text (see text.text_key) is also in right."""
    keys = right.select(F.sha2(text.text_key(F.col(right_text)).cast("binary"), 256).alias("_k")).distinct()
    return left.join(keys, F.sha2(text.text_key(F.col(left_text)).cast("binary"), 256) == F.col("_k"), "left_semi")


def audit_calibration(items: DataFrame, corpus: DataFrame, fields: Sequence[str]) -> DataFrame:
    """items: item_id, task_text, field. Repeated texts, texts of the corpus, fields without an item."""
    need = items.sparkSession.createDataFrame([(f,) for f in fields], "field string")
    return together([repeated(items, "text_repeated", text.text_key(F.col("task_text"))), issues(overlap(items, corpus, "task_text", "task_text"), "text_in_corpus", F.col("item_id")), issues(need.join(items, "field", "left_anti"), "field_not_covered", F.col("field"))])


def same_orders(packets: DataFrame) -> DataFrame:
    """Packets (packet_id, presentation_order, task_id) that present the tasks in one order."""
    per = packets.groupBy("packet_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("presentation_order", "task_id"))), lambda x: x["task_id"]), "\n").cast("binary"), 256).alias("o"))
    return issues(per.groupBy("o").agg(F.count(F.lit(1)).alias("n"), F.min("packet_id").alias("p")).where("n > 1"), "same_order", F.col("p"), F.col("n"))


def illegal_transitions(changes: DataFrame) -> DataFrame:
    """changes: id, old, new."""
    legal = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    return issues(changes.where(~F.coalesce(F.array_contains(legal[F.col("old")], F.col("new")), F.lit(False))), "illegal_transition", F.col("id"), F.concat_ws(" to ", "old", "new"))


def analysis_ready(status: Column, licence: Column, checksums: Column) -> Column:
    """A source may be analysed: schema checked, licence checked, and checksums (array) not empty and all verified."""
    return (status == "schema_validated") & (licence == "verified") & (F.size(checksums) > 0) & F.forall(checksums, lambda x: x == "verified")


def audit_sources(sources: DataFrame) -> DataFrame:
    """sources: id, version_kind, immutable_version (boolean), dataset_status, license_status, checksums, artifact_ids, column_names (arrays), provenance (array)."""
    all_verified = F.forall("checksums", lambda x: x == "verified")
    claims = F.col("dataset_status").isin("checksum_verified", "schema_validated")
    return together([
        repeated(sources, "source_id_not_unique", F.col("id")),
        row_issues(sources, "id", [
            ("artifact_id_not_unique", F.size("artifact_ids") != F.size(F.array_distinct("artifact_ids"))),
            ("column_name_not_unique", F.size("column_names") != F.size(F.array_distinct("column_names"))),
            ("mutable_called_immutable", F.col("immutable_version") & (F.col("version_kind") == "mutable_ref")),
            ("checksum_claim_without_evidence", claims & ~all_verified),
            ("license_inconsistent", (F.col("dataset_status") == "license_pending") & (F.col("license_status") == "verified")),
            ("validated_but_incomplete", (F.col("dataset_status") == "schema_validated") & ~analysis_ready(F.col("dataset_status"), F.col("license_status"), F.col("checksums"))),
            ("unknown_provenance", F.size(F.array_except("provenance", F.array(*map(F.lit, PROVENANCE)))) > 0),
        ]),
    ])


def audit_benchmarks(benchmarks: DataFrame, sources: DataFrame) -> DataFrame:
    """benchmarks: id, kind, source_ids, field_provenance (arrays)."""
    named = benchmarks.select("id", F.explode("source_ids").alias("s"))
    has = lambda *v: F.arrays_overlap("field_provenance", F.array(*map(F.lit, v)))
    synthetic, hybrid = F.col("kind") == "synthetic", F.col("kind") == "trace_driven_hybrid"
    constructed = F.size(F.array_except("field_provenance", F.array(F.lit("generated"), F.lit("simulated")))) == 0
    kinds = benchmarks.agg(F.array_sort(F.collect_set("kind")).alias("k")).where(F.col("k") != F.array(F.lit("synthetic"), F.lit("trace_driven_hybrid")))
    return together([
        repeated(benchmarks, "benchmark_id_not_unique", F.col("id")),
        issues(kinds, "kinds_incomplete", F.lit("manifest"), F.array_join("k", ",")),
        issues(named.join(sources.select(F.col("id").alias("s")), "s", "left_anti"), "unknown_source", F.col("id"), F.col("s")),
        row_issues(benchmarks, "id", [("synthetic_with_sources", synthetic & ((F.size("source_ids") > 0) | ~constructed)), ("hybrid_without_layers", hybrid & ~((F.size("source_ids") > 0) & has("observed", "measured") & has("matched", "generated", "simulated")))]),
    ])


MANIFEST = (
    "provenance_vocabulary array<string>, sources array<struct<id:string,version_kind:string,immutable_version:boolean,dataset_status:string,license:struct<verification_status:string>,"
    "artifacts:array<struct<artifact_id:string,checksum:struct<verification:string>>>,columns:array<struct<name:string,provenance:string>>>>, benchmarks array<struct<id:string,kind:string,source_ids:array<string>,field_provenance:array<string>>>"
)


def manifest_issues(manifests: DataFrame, schema: dict) -> DataFrame:
    """Issues of manifests given as JSON texts. manifests: name, text. Form comes first: only manifests that obey the schema are read for what they mean.

    Ids are told by manifest, so several may be audited at once.
    """
    form = issues(schemas.schema_issues(manifests, "name", "text", schema), "manifest_schema", F.col("key"), F.concat_ws(" ", "path", "rule"))
    m = manifests.where(schemas.valid_documents(manifests, "text", schema)).select("name", F.from_json("text", MANIFEST).alias("m"))
    own = lambda c: F.concat_ws(":", "name", c)
    s = m.select("name", F.explode("m.sources").alias("s"))
    sources = s.select(
        own("s.id").alias("id"), "s.version_kind", "s.immutable_version", "s.dataset_status", F.col("s.license.verification_status").alias("license_status"),
        F.transform("s.artifacts", lambda a: a["checksum"]["verification"]).alias("checksums"), F.transform("s.artifacts", lambda a: a["artifact_id"]).alias("artifact_ids"),
        F.transform("s.columns", lambda c: c["name"]).alias("column_names"), F.array_compact(F.transform("s.columns", lambda c: c["provenance"])).alias("provenance"),
    )
    b = m.select("name", F.explode("m.benchmarks").alias("b"))
    benchmarks = b.select("name", own("b.id").alias("id"), "b.kind", F.transform("b.source_ids", lambda x: F.concat_ws(":", "name", x)).alias("source_ids"), "b.field_provenance")
    frozen = F.array(*map(F.lit, sorted(PROVENANCE)))
    vocabulary = m.where(~F.array_sort(F.array_distinct("m.provenance_vocabulary")).eqNullSafe(frozen))
    kinds = m.select("name", F.array_sort(F.array_distinct(F.transform("m.benchmarks", lambda x: x["kind"]))).alias("k")).where(~F.col("k").eqNullSafe(F.array(F.lit("synthetic"), F.lit("trace_driven_hybrid"))))
    return together([
        form,
        issues(vocabulary, "vocabulary_not_frozen", F.col("name")),
        audit_sources(sources),
        audit_benchmarks(benchmarks.drop("name"), sources).where("rule <> 'kinds_incomplete'"),
        issues(kinds, "kinds_incomplete", F.col("name"), F.array_join("k", ",")),
    ])


def state_issues(states: DataFrame) -> DataFrame:
    """states: episode_id, devices, servers, links (arrays of structs with device_id, server_id, target_id)."""
    def twice(c: str, field: str) -> Column:
        ids = F.transform(c, lambda x: x[field])
        return F.size(ids) != F.size(F.array_distinct(ids))

    unlinked = F.size(F.array_except(F.transform("servers", lambda x: x["server_id"]), F.transform("links", lambda x: x["target_id"]))) > 0
    return row_issues(states, "episode_id", [("no_device", F.size("devices") < 1), ("device_id_not_unique", twice("devices", "device_id")), ("server_id_not_unique", twice("servers", "server_id")), ("link_id_not_unique", twice("links", "target_id")), ("server_without_link", unlinked)])


def value_issues(df: DataFrame, key: str, nonnegative: Sequence[str] = (), positive: Sequence[str] = (), probability: Sequence[str] = (), named: Sequence[str] = ()) -> DataFrame:
    """Finite, non-negative, positive, probability and non-empty gates."""
    rules = []
    for c in {*nonnegative, *positive, *probability}:
        rules.append((f"{c}_not_finite", ~casting.is_finite(F.col(c).cast("double"))))
    rules += [(f"{c}_negative", F.col(c) < 0) for c in nonnegative] + [(f"{c}_not_positive", F.col(c) <= 0) for c in positive]
    rules += [(f"{c}_not_probability", ~F.col(c).between(0, 1)) for c in probability] + [(f"{c}_empty", casting.is_empty(F.col(c))) for c in named]
    return row_issues(df, key, sorted(rules, key=lambda r: r[0]))
