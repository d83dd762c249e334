import math

import pytest
from pyspark.sql import functions as F

from quillon.functions import text
from quillon.operators import audits, extract, sim

DEVICE = sim.Device(2e9, 1e-28, 2.0, 1.0, 0.5, 0.99, 0.80, 100.0)
EDGE = sim.Server("edge_0", "edge", 4e9, 0.98, 0.90, 10e6, 10e6, 0.97, free_s=4.0)
CLOUD = sim.Server("cloud", "cloud", 10e9, 0.999, 0.99, 20e6, 20e6, 0.995, backhaul_bps=100e6, propagation_s=0.02, backhaul_success=0.999)
SCHEMA = "episode_id int, step long, arrival_s double, input_bits double, output_bits double, cycles double, tier string, target string, allowed array<string>, max_latency_s double, min_success double, min_accuracy double, failed_targets array<string>, failed_links array<string>"


def task(episode, tier, target, step=0, arrival=0.0, allowed=("device", "edge", "cloud"), limit=None, p=None, failed=(), links=(), cycles=4e9):
    return (episode, step, arrival, 20e6, 10e6, cycles, tier, target, list(allowed), limit, p, None, list(failed), list(links))


def run(spark, tasks, device=DEVICE, servers=(EDGE, CLOUD), **physics):
    out = sim.replay(spark.createDataFrame(tasks, SCHEMA), device, list(servers), sim.Physics(**physics)).collect()
    return {(r.episode_id, r.step): r for r in out}


def test_hand_computed_steps(spark):
    out = run(spark, [task(1, "device", "local"), task(2, "edge", "edge_0"), task(3, "cloud", "cloud"), task(4, "edge", "edge_0", limit=5.0), task(5, "edge", "cloud"), task(6, "cloud", "cloud", allowed=("device",)), task(7, "edge", "edge_0", failed=["edge_0"]), task(8, "edge", "edge_0", p=0.95)], latency_ref_s=2.0, energy_ref_j=2.0)
    local, edge, cloud = out[1, 0], out[2, 0], out[3, 0]
    assert (local.latency_s, local.energy_j, local.battery_j) == pytest.approx((2.0, 1.6, 98.4)) and local.reward == pytest.approx(-1.8)
    assert (edge.latency_s, edge.energy_j, edge.wait_s) == pytest.approx((6.0, 6.5, 2.0))
    assert cloud.latency_s == pytest.approx(2.24) and cloud.wait_s == 0
    assert cloud.success_probability == pytest.approx(0.999 * 0.995**2 * 0.999**2)
    assert out[4, 0].deadline_missed and not out[4, 0].success and out[4, 0].completed
    assert out[5, 0].failure_reason == out[6, 0].failure_reason == "invalid_action" and out[6, 0].hard_violated
    assert out[7, 0].failure_reason == "target_failure" and not out[7, 0].hard_violated
    assert out[8, 0].reliability_violated


def test_failures(spark):
    out = run(spark, [task(1, "edge", "edge_0", links=["edge_0"], p=0.9)], detection_s=0.1)[1, 0]
    assert out.failure_reason == "link_failure" and out.energy_j == pytest.approx(0.2) and out.latency_s == 0.1
    assert out.success_probability == pytest.approx(0.98 * 0.97**2) and not out.reliability_violated
    from dataclasses import replace

    poor = run(spark, [task(1, "device", "local")], device=replace(DEVICE, battery_j=0.25))[1, 0]
    assert (poor.failure_reason, poor.energy_j, poor.battery_j) == ("battery_depleted", 0.25, 0.0)
    down = run(spark, [task(1, "edge", "edge_0")], servers=(replace(EDGE, available=False), CLOUD), mask_unavailable=False)[1, 0]
    assert down.failure_reason == "target_unavailable" and down.hard_violated
    loose = run(spark, [task(1, "edge", "edge_0", allowed=("device",))], mask_semantic=False)[1, 0]
    assert loose.completed and loose.hard_violated and not loose.success


def test_queue_of_an_episode(spark):
    out = run(spark, [task(1, "device", "local", step=k, arrival=k * 0.5) for k in range(4)])
    assert [out[1, k].wait_s for k in range(4)] == pytest.approx([0.0, 1.5, 3.0, 4.5])
    jobs = spark.createDataFrame([("q", k, k * 0.5, 2.0) for k in range(4)], "queue string, id int, arrival double, service double")
    assert [r.wait_s for r in sim.fcfs(jobs, "queue", "arrival", "service", "id").orderBy("id").collect()] == pytest.approx([0.0, 1.5, 3.0, 4.5])


def test_streaming_queue_equals_the_batch_form(spark):
    from quillon.plans.streams import run_available
    from quillon.streaming.replay import fcfs_stream

    jobs = spark.createDataFrame([(f"q{k % 3}", k, float(k // 2), float(1 + k % 4)) for k in range(60)], "queue string, job_id long, arrival_s double, service_s double")
    live = {r.job_id: r.end_s for r in run_available(spark, jobs, fcfs_stream).collect()}
    assert live == {r.job_id: r.end_s for r in sim.fcfs(jobs, "queue", "arrival_s", "service_s", "job_id").collect()}


def test_channel(spark):
    out = sim.link_budget(spark.createDataFrame([(0.5,), (1.0,), (10.0,), (100.0,)], "m double"), "m").orderBy("m").collect()
    assert out[0].path_loss_db is None
    assert out[1].path_loss_db == pytest.approx(20 * math.log10(4 * math.pi * 3.5e9 / 299792458), abs=1e-9) and out[2].path_loss_db - out[1].path_loss_db == pytest.approx(30.0)
    assert out[1].uplink_bps > out[2].uplink_bps > out[3].uplink_bps


def test_rules(spark):
    rows = [
        (1, "Tek parça çalışmalı, bağımsız parça olamaz. Yüksek doğruluk istenir; birinci öncelik pil.", None),
        (2, "Anında yanıt, dört saniye de olur.", "Yalnız bulutta çalışsın ama bulut kullanılamaz."),
        (3, "F1 skoru en az 0,92 olmalı; 2,5 saniye. Enerji tüketimi dengelenmelidir. Kurum dışına çıkmasın.", None),
        (4, "Yüksek güvenilirlik, hassas veri, 40 ms; yakın edge sunucusunda, bulut kullanılamaz; bağımsız parçaları var", None),
    ]
    out = {r.id: r for r in extract.rule_labels(spark.createDataFrame(rows, "id int, task_text string, policy string"), "task_text", "policy").collect()}
    assert (out[1].divisibility.status, out[1].accuracy.value, out[1].energy_priority.value) == ("ambiguous", "high", "high")
    assert out[2].latency.status == "ambiguous" and out[2].execution_policy.status == "ambiguous"
    assert (out[3].accuracy.metric, out[3].accuracy.number, out[3].latency.number, out[3].latency.value, out[3].energy_priority.value, out[3].privacy.value) == ("F1", 0.92, 2500.0, "relaxed", "balanced", "internal")
    assert (out[4].latency.value, out[4].reliability.value, out[4].privacy.value, out[4].execution_policy.status, out[4].divisibility.value) == ("hard_real_time", "high", "sensitive", "partial", "divisible")
    full = extract.assembled(extract.rule_labels(spark.createDataFrame(rows[:1], "id int, task_text string, policy string")), "task_text").first()
    assert full.abstained_fields == ["latency", "privacy", "execution_policy", "reliability", "divisibility"] and full.latency.evidence == []


def test_ngrams(spark):
    df = spark.createDataFrame([("ab, C",)], "t string")
    got = {r.term: r.tf for r in extract._term_counts(df.withColumn("k", F.lit(1)), "k", extract.word_ngrams(F.col("t"))).collect()}
    assert got == {" ab": 1, "ab,": 1, "b, ": 1, " ab,": 1, "ab, ": 1, " ab, ": 1, " c ": 1}  # a mark belongs to its word


def test_linear_head(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(i, "a" if i % 2 else "b", Vectors.dense([1.0 if i % 2 else -1.0, 0.1 * (i % 5)])) for i in range(40)]
    df = spark.createDataFrame(rows, ["id", "label", "features"])
    out = extract.fit_linear_head(df, "label")(df)
    assert out.where("prediction = label").count() == 40
    assert extract.fit_linear_head(df.where("label = 'a'"), "label")(df).first().confidence == 1.0


def rules_of(df):
    return {(r.rule, r.key) for r in df.collect()}


def test_packets_and_submissions(spark):
    tasks = spark.createDataFrame([(f"t{i}", "tr", f"text {i}", None) for i in range(5)], "task_id string, language string, task_text string, user_policy_text string")
    packet = audits.blind_packet(tasks, "A", "seed")
    assert rules_of(audits.audit_packet(packet, tasks, "A")) == set()
    wrong = packet.where("task_id <> 't1'").withColumn("task_text", F.when(F.col("task_id") == "t2", "other").otherwise(F.col("task_text"))).withColumn("annotator_id", F.when(F.col("task_id") == "t3", "B").otherwise(F.col("annotator_id")))
    found = rules_of(audits.audit_packet(wrong, tasks, "A"))
    assert {("task_not_covered", "t1"), ("changed_text", "t2"), ("wrong_annotator", "t3")} <= found
    assert rules_of(audits.audit_packet(packet.withColumn("x", F.lit(1)), tasks, "A")) == {("extra_column", "x")}
    sub = packet.select("annotator_id", "task_id", "task_content_sha256", "protocol_version", "language")
    assert rules_of(audits.audit_submission(sub, tasks, "A")) == set()
    assert ("stale_hash", "t0") in rules_of(audits.audit_submission(sub.withColumn("task_content_sha256", F.when(F.col("task_id") == "t0", "0").otherwise(F.col("task_content_sha256"))), tasks, "A"))


def test_numeric_consistency(spark):
    schema = "task_id string, field string, status string, value string, number double, metric string, confidence double, evidence array<string>, device string, edge string, cloud string"
    rows = [
        ("a", "latency", "explicit", "interactive", 500.0, None, 0.9, ["en geç 500 ms"], None, None, None), ("b", "latency", "explicit", "relaxed", 500.0, None, 0.9, ["0,5 saniye"], None, None, None),
        ("c", "latency", "explicit", "relaxed", None, None, 0.8, ["2 saniye"], None, None, None), ("d", "reliability", "explicit", "high", 0.99, None, 0.7, ["%99"], None, None, None),
        ("e", "reliability", "explicit", "high", 0.9, None, 0.7, ["%99"], None, None, None), ("f", "execution_policy", "partial", None, None, None, 0.5, [], "allowed", "allowed", "forbidden"),
        ("g", "accuracy", "explicit", "high", 0.92, "F1", 0.5, ["F1 en az 0,92"], None, None, None), ("h", "accuracy", "explicit", "high", 0.92, None, 0.5, ["F1 en az 0,92"], None, None, None),
    ]
    assert rules_of(audits.numeric_issues(spark.createDataFrame(rows, schema))) == {("latency_class_disagrees", "b.latency"), ("latency_number_missing", "c.latency"), ("confidence_not_allowed", "c.latency"), ("reliability_number_disagrees", "e.reliability"), ("partial_without_unknown", "f.execution_policy"), ("accuracy_metric_missing", "h.accuracy")}


def test_manifest(spark):
    schema = "id string, version_kind string, immutable_version boolean, dataset_status string, license_status string, checksums array<string>, artifact_ids array<string>, column_names array<string>, provenance array<string>"
    rows = [("ok", "commit", True, "schema_validated", "verified", ["verified"], ["a"], ["x"], ["observed"]), ("m", "mutable_ref", True, "catalogued", "pending", [], ["a", "a"], ["x"], ["guessed"]), ("c", "commit", True, "checksum_verified", "pending", ["pending"], ["a"], ["x"], [])]
    s = spark.createDataFrame(rows, schema)
    assert rules_of(audits.audit_sources(s)) == {("mutable_called_immutable", "m"), ("artifact_id_not_unique", "m"), ("unknown_provenance", "m"), ("checksum_claim_without_evidence", "c")}
    b = spark.createDataFrame([("s", "synthetic", [], ["generated"]), ("h", "trace_driven_hybrid", ["ok", "zz"], ["observed", "matched"])], "id string, kind string, source_ids array<string>, field_provenance array<string>")
    assert rules_of(audits.audit_benchmarks(b, s)) == {("unknown_source", "h")}
    assert rules_of(audits.illegal_transitions(spark.createDataFrame([("a", "downloaded", "checksum_verified"), ("b", "rejected", "downloaded")], "id string, old string, new string"))) == {("illegal_transition", "b")}


def test_evidence_and_abstention(spark):
    l = spark.createDataFrame([("t", "f", "explicit", ["seen", "not there"], "seen text"), ("t", "g", "ambiguous", [], "seen text")], "task_id string, field string, status string, evidence array<string>, v string")
    assert [(r.key, r.detail) for r in audits.ungrounded_evidence(l, "v").collect()] == [("t.f", "not there")]
    for held, n in ((["g"], 0), (["f"], 1), ([], 1)):
        a = spark.createDataFrame([("t", held)], "task_id string, abstained_fields array<string>")
        assert audits.abstention_issues(a, l).count() == n


def test_text_key_is_compatible_and_folded(spark):
    rows = [("Ｆｕｌｌ  width",), ("full width",), ("STRASSE",), ("straße",), ("ﬁne",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(text.text_key(F.col("t"))).collect()]
    assert got == ["full width", "full width", "strasse", "strasse", "fine", None]


def test_ngrams_keep_marks_inside_words(spark):
    df = spark.createDataFrame([(1, "a,b  É a,b")], "id int, t string")
    got = {r.term: r.tf for r in extract._term_counts(df, "id", extract.word_ngrams(F.col("t"))).collect()}
    assert got == {" a,": 2, "a,b": 2, ",b ": 2, " a,b": 2, "a,b ": 2, " a,b ": 2, " e ": 1}


def test_a_fitted_vocabulary_is_applied_to_other_rows(spark):
    train = spark.createDataFrame([(1, "red red blue"), (2, "red green"), (3, "blue green")], "id int, t string")
    words = F.split("t", " ")
    v = extract.fit_tfidf(train, "id", words, 2)
    assert {r.term: r.term_id for r in v.collect()} == {"blue": 0, "green": 1, "red": 2}
    other = spark.createDataFrame([(9, "red new"), (10, "new")], "id int, t string")
    got = extract.apply_tfidf(other, "id", words, v).collect()
    assert [(r.id, [(c.term, round(c.weight, 6)) for c in r.cells]) for r in got] == [(9, [("red", 1.0)])]


def test_text_classifier_learns_marked_texts(spark):
    rows = [(i, f"gut {'freundlich' if i % 2 else 'schlecht'} wort{i % 5}", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, t string, y int")
    predict = extract.fit_text_classifier(df.where("id < 40"), "id", "t", "y", max_iter=20)
    out = predict(df.where("id >= 40").unionByName(spark.createDataFrame([(99, "", 0)], df.schema))).collect()
    assert len(out) == 21 and all(str(r.y) == r.prediction for r in out if r.id != 99)


def test_vocabulary_from_words_equals_that_from_all_terms(spark):
    rows = [(i % 37 if i % 9 else None, f"Straße ÉCOLE w{i % 7} w{i % 7} abc{i % 5}xyz einmal{i if i % 4 else 0} i̇ \u000b ok" if i % 11 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, t string")
    for terms in (extract.word_ngrams(F.col("t")), F.filter(F.split("t", " "), lambda x: x != "")):
        for min_df, most in ((1, 40), (2, 25), (2, 5000)):
            v = extract.fit_tfidf(df, "id", terms, min_df, most)
            want = extract._fit_tfidf_of_all(df, "id", terms, min_df, most)
            shown = lambda x: sorted((r.term, r.term_id, round(r.idf, 9)) for r in x.collect())
            assert shown(v) == shown(want)
            got = {(r.id, c.term, c.term_id, round(c.weight, 9)) for r in extract.apply_tfidf(df, "id", terms, v, most).collect() for c in r.cells}
            plain = {(r.id, c.term, c.term_id, round(c.weight, 9)) for r in extract.apply_tfidf(df, "id", terms, v, extract.BROADCAST_TERMS + 1).collect() for c in r.cells}
            assert got == plain and got


def test_tfidf_spreads_no_terms_of_rows(spark):
    df = spark.createDataFrame([(1, "one two"), (2, "two three")], "id int, t string")
    words = F.split("t", " ")
    plan = extract.apply_tfidf(df, "id", words, extract.fit_tfidf(df, "id", words))._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Exchange" not in plan


def test_python_gets_small_batches(spark):
    for use in (lambda d: text.text_key(F.col("t")), lambda d: extract.phrase_spans(d, "t", ["a"])):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        use(spark.createDataFrame([("a",)], "t string"))
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000
    got = extract.phrase_spans(spark.createDataFrame([("aXa😀aa",), (None,), ("",), ("b",)], "t string").coalesce(1), "t", ["a", "aa"]).collect()
    assert [[tuple(s) for s in r.spans] for r in got] == [[(0, 0, 1), (0, 2, 3), (0, 4, 5), (1, 4, 6), (0, 5, 6)], [], [], []]
