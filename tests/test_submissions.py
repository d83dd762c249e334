"""Whole submissions, manifests and corpora with planted faults; the annotation schema against the rules written as columns."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import agreement, audits, evaluation, extract, schemas, submissions
from quillon.functions import text

TASKS = [(f"task_{i}", "tr", f"Sonuç {100 + i} ms içinde gelmelidir. Hasta izleme.", None) for i in range(8)]
WRAPPER = {"type": "object", "required": ["annotator_id", "task_id", "annotation"], "properties": {"annotator_id": {"type": "string"}, "task_id": {"type": "string"}, "annotation": {"type": "object"}}}


def label(status="not_stated", evidence=(), confidence=0.9, **own):
    return {**own, "status": status, "evidence": list(evidence), "confidence": confidence}


def annotation(task, i):
    out = {"schema_version": "1.0.0", "task_id": task, "language": "tr", "domain": label("explicit", ["Hasta izleme"], value="healthcare"), "latency": label("explicit", [f"Sonuç {100 + i} ms"], **{"class": "real_time", "max_ms": 100 + i})}
    out |= {"privacy": label(data_class=None), "execution_policy": label(device="unknown", edge="unknown", cloud="unknown"), "reliability": label(tier=None, min_success_probability=None), "accuracy": label(tier=None, min_score=None, metric=None), "energy_priority": label(value=None), "divisibility": label(value=None)}
    return out | {"abstained_fields": [f for f in extract.FIELDS if out[f]["status"] == "not_stated"], "overall_confidence": 0.9}


def sha(task):
    keys = ("language", "task_id", "task_text", "user_policy_text")
    d = dict(zip(("task_id", "language", "task_text", "user_policy_text"), task))
    return hashlib.sha256(json.dumps({k: d[k] for k in keys}, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@pytest.fixture(scope="module")
def tasks(spark):
    return spark.createDataFrame(TASKS, "task_id string, language string, task_text string, user_policy_text string")


def audited(spark, tasks, records):
    df = spark.createDataFrame([(i, r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) for i, r in enumerate(records, 1)], "number int, text string")
    return sorted((r.rule, r.key, r.detail) for r in submissions.audit_records(df, tasks, "A", WRAPPER, protocol="1.1.0").collect())


def records():
    return [{"annotator_id": "A", "task_id": t[0], "protocol_version": "1.1.0", "task_content_sha256": sha(t), "annotation": annotation(t[0], i)} for i, t in enumerate(TASKS)]


def test_a_clean_submission_has_no_issues(spark, tasks):
    assert audited(spark, tasks, records()) == []


def test_every_fault_is_told(spark, tasks):
    r = records()
    r[0]["annotator_id"] = "B"
    r[1]["task_content_sha256"] = "0"
    r[2]["annotation"]["task_id"] = "task_1"
    r[2]["annotation"]["language"] = "en"
    r[3]["annotation"]["latency"]["max_ms"] = 999
    r[4]["annotation"]["privacy"]["status"] = "explicit"
    r[5]["annotation"]["domain"]["evidence"] = ["nowhere"]
    r[6]["annotation"] = 5
    del r[7]
    r += [dict(r[0], annotator_id="A"), {"task_id": "other", "annotator_id": "A", "annotation": {}}, "{", {"annotator_id": "A"}]
    got = {(a, b) for a, b, _ in audited(spark, tasks, r)}
    assert got == {
        ("wrong_annotator", "task_0"), ("stale_hash", "task_1"), ("task_ids_disagree", "task_2"), ("language_disagrees", "task_2"), ("latency_number_disagrees", "task_3.latency"), ("latency_class_disagrees", "task_3.latency"),
        ("abstained_fields_differ", "task_4"), ("annotation_schema", "task_4"), ("evidence_not_in_text", "task_5.domain"), ("record_schema", "task_6"), ("task_not_covered", "task_7"), ("task_repeated", "task_0"),
        ("unknown_task", "other"), ("not_json", "record 10"), ("record_schema", "record 11"),
    }


def test_the_annotation_schema_says_what_the_rules_say(spark):
    """Random labels, judged by the compiled schema and by `evaluation.label_valid`."""
    r, rows = random.Random(9), []
    for i in range(600):
        f = r.choice(extract.FIELDS)
        wide = {"status": r.choice(["explicit", "not_stated", "ambiguous", "partial"]), "value": None, "device": None, "edge": None, "cloud": None, "metric": None, "number": None, "evidence": r.choice([[], ["a"], ["a", "b"], ["a", "a"], [""]]), "confidence": r.choice([0.0, 0.5, 1.0, 1.5])}
        if f == "execution_policy":
            wide |= {t: r.choice(["allowed", "forbidden", "unknown", "unknown"]) for t in evaluation.TARGETS}
            own = {t: wide[t] for t in evaluation.TARGETS}
        else:
            wide["value"] = r.choice([None, evaluation.VALUES[f][0], "nothing"])
            own = {submissions.VALUE_NAMES[f]: wide["value"]}
            if f in submissions.NUMBER_NAMES:
                wide["number"] = r.choice([None, None, 0.0, 0.5, 1.0, 7e6])
                own[submissions.NUMBER_NAMES[f]] = wide["number"]
            if f == "accuracy":
                wide["metric"] = r.choice([None, None, "F1", "x" * 81])
                own["metric"] = wide["metric"]
        rows.append((i, f, json.dumps(own | {k: wide[k] for k in ("status", "evidence", "confidence")}), wide))
    df = spark.createDataFrame(rows, "i int, f string, text string, l struct<status:string,value:string,device:string,edge:string,cloud:string,metric:string,number:double,evidence:array<string>,confidence:double>")
    root = submissions.annotation_schema()
    some = 0
    for f in extract.FIELDS:
        schema = {**root["properties"][f], "$defs": root["$defs"]}
        own = df.where(F.col("f") == f)
        got = own.select("text", schemas.valid_documents(own, "text", schema).alias("a"), evaluation.label_valid(F.col("l"), f).alias("b")).collect()
        assert [x for x in got if x.a != x.b] == []
        some += sum(x.a for x in got)
    assert some > 20


def test_corpus_records_against_a_schema(spark):
    t = spark.createDataFrame([(f"t{i}", f"text {i}", None, d, list(audits.PHENOMENA), json.dumps({"n": i})) for i, d in enumerate(audits.DOMAINS * 2)], "task_id string, task_text string, user_policy_text string, scenario_domain string, semantic_phenomena array<string>, record string")
    assert audits.audit_corpus(t, 16).count() == 0
    assert [tuple(r) for r in audits.audit_corpus(t, 16, {"properties": {"n": {"maximum": 14}}}).collect()] == [("task_schema", "t15", "/n maximum")]


def test_manifests(spark):
    source = {"id": "s", "version_kind": "commit", "immutable_version": True, "dataset_status": "schema_validated", "license": {"verification_status": "verified"}, "artifacts": [{"artifact_id": "a", "checksum": {"verification": "verified"}}], "columns": [{"name": "c"}]}
    good = {"provenance_vocabulary": list(audits.PROVENANCE), "sources": [source], "benchmarks": [{"id": "b", "kind": "synthetic", "source_ids": [], "field_provenance": ["generated"]}, {"id": "h", "kind": "trace_driven_hybrid", "source_ids": ["s"], "field_provenance": ["observed", "matched"]}]}
    schema = {"type": "object", "required": ["sources"], "properties": {"sources": {"type": "array", "minItems": 1}}}
    broken = json.loads(json.dumps(good))
    broken["provenance_vocabulary"] = ["observed"]
    broken["sources"].append(dict(source, version_kind="mutable_ref", artifacts=[]))
    broken["benchmarks"] = [dict(good["benchmarks"][1], source_ids=["t"])]
    df = spark.createDataFrame([("good", json.dumps(good)), ("broken", json.dumps(broken)), ("form", "{}"), ("text", "x")], "name string, text string")
    got = {(r.rule, r.key) for r in audits.manifest_issues(df, schema).collect()}
    assert got == {("manifest_schema", "form"), ("manifest_schema", "text"), ("vocabulary_not_frozen", "broken"), ("source_id_not_unique", "broken:s"), ("mutable_called_immutable", "broken:s"), ("validated_but_incomplete", "broken:s"), ("unknown_source", "broken:h"), ("kinds_incomplete", "broken")}


# --- alignment of several raters, phrases, fields -----------------------------


def test_raters_meet_by_key(spark):
    of = lambda rows: spark.createDataFrame(rows, "k int, n int, rater string")
    a, b, c = [(i, i, "x") for i in range(6)], [(i, i * 2, "y") for i in range(5)], [(i, 7, "z") for i in (0, 1, 2, 2, 3, 9)]
    told = agreement.aligned_all({"a": of(a), "b": of(b), "c": of(c)}, "k")
    assert told._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {(r.k, r.rater, r.rule, r.n) for r in agreement.alignment_issues(told, "k").collect()}
    assert got == {(2, "c", "repeated", 2), (4, "c", "missing", 0), (5, "b", "missing", 0), (5, "c", "missing", 0), (9, "a", "missing", 0), (9, "b", "missing", 0)}
    whole = {r.k: (r.a.n, r.b.n, r.c.n, r.a.rater) for r in agreement.fully_aligned(told, strict=False).collect()}
    assert whole == {i: (i, i * 2, 7, "x") for i in (0, 1, 3)}
    with pytest.raises(ValueError, match="aren't rated once"):
        agreement.fully_aligned(told)
    with pytest.raises(ValueError, match="aren't rated once"):
        agreement.fully_aligned(agreement.aligned_all({"a": of(a).limit(0), "b": of(b).limit(0)}, "k"))
    with pytest.raises(ValueError):
        agreement.aligned_all({"a": of(a)}, "k")
    r = agreement.diagnose_third(of(a[:4]), of(b[:4]), of([(0, 0, ""), (1, 1, ""), (2, 4, ""), (3, 9, "")]), "k", "n").first()
    assert (r.n, r.n_agree, r.third_with_both, r.third_with_left, r.third_with_right, r.third_with_neither) == (4, 1, 1, 1, 1, 1)


def test_phrases_are_found_wherever_they_stand(spark):
    phrases = ["aa", "a", "aab", "é", "xyz", "😀b"]
    texts = ["aaab", "", None, "éaé😀baa", "xy", "xyzxyz"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for r in extract.phrase_spans(df, "t", phrases).collect():
        t = r.t or ""
        want = {(p, i, i + len(x)) for p, x in enumerate(phrases) for i in range(len(t)) if t.startswith(x, i)}
        assert {tuple(s) for s in r.spans} == want and len(r.spans) == len(want)
    got = {(r.k, r.field): (r.label, r.status, len(r.evidence)) for r in extract.phrase_labels(df, "k", "t", [("aa", "f", "1"), ("aab", "f", "2"), ("é", "g", "e")]).collect()}
    assert got == {(0, "f"): (None, "ambiguous", 3), (3, "f"): ("1", "explicit", 1), (3, "g"): ("e", "explicit", 2)}
    assert all(r.spans == [] for r in extract.phrase_spans(df, "t", []).collect())
    for bad in (["a", "a"], [""]):
        with pytest.raises(ValueError):
            extract.phrase_spans(df, "t", bad)


def test_commas(spark):
    tests = ["a, b, c tarafından işlenir. d, e", "a, b", "none", "", ",x", "işlenir."]

    def plain(t, tail=" tarafından işlenir."):
        return t.split(tail, maxsplit=1)[0].rsplit(", ", maxsplit=1)[-1] if tail in t else t.split(",", maxsplit=1)[0]

    got = {r.t: r.d for r in spark.createDataFrame([(t,) for t in tests], "t string").select("t", text.domain_evidence(F.col("t"), " tarafından işlenir.").alias("d")).collect()}
    assert got == {t: plain(t) for t in tests}


def test_several_fields_share_their_vectors(spark):
    rows = [(i, ("apple pie recipe" if i % 2 else "engine oil change") + (" tomorrow morning" if i % 4 < 2 else " never again"), "food" if i % 2 else "car", "yes" if i % 4 < 2 else "no", "same", None if i < 30 else "late") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, words string, topic string, when string, one string, part string")
    predict = extract.fit_fields(df.where("id >= 8"), "id", "words", ["topic", "when", "one", "part"], max_iter=30)
    out = predict(df.where("id < 8"), truth=True)
    got = {(r.id, r.field): (r.label, r.truth) for r in out.collect()}
    assert len(got) == 32 and all(a == b for (i, f), (a, b) in got.items() if f != "part")
    assert all(r.confidence == 1.0 for r in out.where("field in ('one', 'part')").collect())
    scores = {r.field: (r.n, r.exact_accuracy, r.macro_f1) for r in extract.field_scores(out).collect()}
    assert scores == {f: (8, 1.0, 1.0) for f in ("topic", "when", "one")}
    assert predict(df.limit(1)).columns == ["id", "field", "label", "confidence"]
