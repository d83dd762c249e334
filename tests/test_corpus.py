import pytest
from pyspark.sql import functions as F

from quillon.functions import text
from quillon.operators import audits, corpus, extract


def blueprint(n=15):
    return {"domains": {d: {"data": f"{d} data", "contexts": [[f"s{i}", f"o{i}"] for i in range(n)]} for d in audits.DOMAINS}, "templates": ["{subject} does {operation} on {data}", "On {data}: {operation} by {subject}"]}


def test_blueprint(spark):
    rows = corpus.expand_blueprint(spark, blueprint()).collect()
    assert len(rows) == 240 == len({r.task_id for r in rows}) == len({r.task_text for r in rows})
    assert rows and {r.variant for r in rows} == {0, 1} and len({r.scenario_family_id for r in rows}) == 120
    with pytest.raises(ValueError):
        corpus.expand_blueprint(spark, blueprint(14))
    tasks = corpus.expand_blueprint(spark, blueprint()).withColumn("split", F.when(F.col("task_id") == "task_001", "a").otherwise("b"))
    assert [r.key for r in corpus.family_leaks(tasks, "scenario_family_id", "split").collect()] == ["family_001"]


def test_form_gates(spark):
    tasks = spark.createDataFrame([(f"t{i}", "tr", f"text {i}", None) for i in range(3)], "task_id string, language string, task_text string, user_policy_text string")
    p = audits.blind_packet(tasks, "A", "s")
    assert corpus.form_issues(p, "A", "0" * 64).count() == 0
    answers = spark.createDataFrame([("t0", "latency"), ("t9", "latency"), ("t1", "mood")], "task_id string, field string")
    assert {(r.rule, r.key) for r in corpus.form_issues(p, "A", "xyz", answers).collect()} == {("packet_hash_malformed", "xyz"), ("response_to_unknown_task", "t9"), ("unknown_field", "t1")}
    assert {r.rule for r in corpus.form_issues(p.where("presentation_order > 1"), "A", "0" * 64).collect()} == {"order_not_contiguous"}


def test_flat_forms(spark):
    df = extract.assembled(extract.rule_labels(spark.createDataFrame([("40 ms yeter",)], "task_text string")), "task_text")
    r = df.select(corpus.form_value(F.col("latency")).alias("f"), corpus.decision_summary(F.lit("latency"), F.col("latency")).alias("s")).first()
    assert tuple(r.f) == ("explicit", "hard_real_time", "40.0", "", "0.80", "40 ms yeter")
    assert r.s == "field=latency, status=explicit, value=hard_real_time, number=40.0"
    page = corpus.form_page([{"t": "</script>"}], "<x><!--DATA--></x>")
    assert "</script>" not in page
    with pytest.raises(ValueError):
        corpus.form_page([], "none")


def test_streams_and_folding(spark):
    a, b = corpus.numpy_stream(7, "tasks"), corpus.numpy_stream(7, "links")
    assert a.random() != b.random() and corpus.numpy_stream(7, "tasks").random() == corpus.numpy_stream(7, "tasks").random()
    words = ["İstanbul IŞIK ığüşöç", "Straße Ångström", "ÉCOLE"]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    rows = df.select(corpus.folded_exactly(F.col("t")).alias("a"), text.folded(F.col("t")).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] == ["istanbul isik igusoc", "strasse angstrom", "ecole"]


def test_scenarios(spark):
    df = spark.createDataFrame([(1, [1], [1], [1], ["a"]), (2, [], [1], [1, 2], ["a", "a"])], "episode_id int, tasks array<int>, events array<int>, actions array<int>, labels array<string>")
    assert {(r.rule, r.key) for r in corpus.scenario_issues(df).collect()} == {("no_task", "2"), ("tasks_and_events_differ", "2"), ("action_label_not_unique", "2")}
