import pytest
from pyspark.sql import functions as F

from quillon.operators import evaluation as ev
from quillon.operators import extract

LABEL = "struct<status:string,value:string,device:string,edge:string,cloud:string,metric:string,number:double,evidence:array<string>,confidence:double>"


def label(status="not_stated", value=None, targets=None, metric=None, number=None, evidence=None, confidence=0.9):
    evidence = evidence if evidence is not None else ([] if status == "not_stated" else ["words"])
    return (status, value, *(targets or (None, None, None)), metric, number, evidence, confidence)


def silent(field):
    return label(targets=("unknown",) * 3 if field == "execution_policy" else None)


def annotation(key, **fields):
    told = {f: fields.get(f, silent(f)) for f in extract.FIELDS}
    return (key, *told.values(), [f for f, v in told.items() if v[0] in ev.HELD], 0.9, "words of the task")


def frame(spark, rows):
    return spark.createDataFrame(rows, "task_id string, " + ", ".join(f"{f} {LABEL}" for f in extract.FIELDS) + ", abstained_fields array<string>, overall_confidence double, shown string")


@pytest.mark.parametrize(
    "field, given, valid",
    [
        ("domain", label("explicit", "consumer"), True),
        ("domain", label("explicit", "unheard_of"), False),
        ("domain", label("explicit", None), False),
        ("domain", label("explicit", "consumer", evidence=[]), False),
        ("domain", label("not_stated", "consumer"), False),
        ("domain", label("not_stated", evidence=["x"]), False),
        ("domain", label("ambiguous"), True),
        ("domain", label("ambiguous", evidence=[]), False),
        ("domain", label("partial", evidence=["x"]), False),
        ("domain", label("explicit", "consumer", evidence=["x", "x"]), False),
        ("domain", label("explicit", "consumer", evidence=["x" * 501]), False),
        ("domain", label("explicit", "consumer", confidence=1.5), False),
        ("domain", label(None), False),
        ("latency", label("explicit", "relaxed", number=3600000.0), True),
        ("latency", label("explicit", "relaxed", number=0.0), False),
        ("latency", label("not_stated", number=5.0), False),
        ("reliability", label("explicit", "high", number=1.01), False),
        ("accuracy", label("explicit", "high", metric="F1", number=0.9), True),
        ("accuracy", label("explicit", "high", metric=""), False),
        ("execution_policy", label("explicit", targets=("allowed", "forbidden", "allowed")), True),
        ("execution_policy", label("explicit", targets=("allowed", "unknown", "allowed")), False),
        ("execution_policy", label("partial", targets=("unknown", "unknown", "forbidden")), True),
        ("execution_policy", label("partial", targets=("unknown",) * 3), False),
        ("execution_policy", label("ambiguous", targets=("unknown", "allowed", "unknown")), False),
    ],
)
def test_schema(spark, field, given, valid):
    df = frame(spark, [annotation("task", **{field: given})])
    assert df.select(ev.label_valid(F.col(field), field)).first()[0] is valid


def test_schema_of_a_whole_annotation(spark):
    df = frame(spark, [annotation("task-1"), annotation("x"), annotation(None)])
    ok = ev.annotation_valid(F.col("task_id"), {f: F.col(f) for f in extract.FIELDS}, F.col("abstained_fields"), F.col("overall_confidence"))
    assert [r[0] for r in df.select(ok).collect()] == [True, False, False]


def test_critical_requirements(spark):
    hard, soft = label("explicit", "hard_real_time", number=10.0), label("explicit", "interactive", number=10.0)
    secret = label("explicit", "restricted")
    truth = frame(spark, [annotation("task-1", latency=hard, privacy=secret), annotation("task-2", latency=hard), annotation("task-3", latency=soft)])
    told = frame(spark, [annotation("task-1", latency=hard), annotation("task-2", latency=soft), annotation("task-3", latency=hard)])
    x = ev.evaluate(truth, told, "task_id", "shown").first()
    assert (x.n, x.schema_validity, x.latency_critical, x.latency_precision, x.latency_recall, x.latency_f1) == (3, 1.0, 2, 0.5, 0.5, 0.5)
    assert (x.privacy_critical, x.privacy_precision, x.privacy_recall, x.privacy_f1) == (1, 0.0, 0.0, 0.0)
    assert x.exact_record == 0.0 and x.exact_field == pytest.approx(21 / 24, abs=1e-6) and x.grounding_rate == 1.0
    assert ev.evaluate(told.where("task_id = 'task-2'"), told.where("task_id = 'task-2'"), "task_id", "shown").first().privacy_f1 is None


def test_numbers_within_a_billionth_are_the_same_to_a_model_but_not_to_raters(spark):
    a, b = (frame(spark, [annotation("task-1", latency=label("explicit", "relaxed", number=x))]) for x in (5000.0, 5000.0 + 5e-10))
    assert ev.evaluate(a, b, "task_id", "shown").first().exact_record == 1.0
    assert ev.pairwise_agreement(a, b, "task_id").where("measure = 'exact_record'").first().agreement == 0.0


def test_sides_must_cover_each_other(spark):
    a = frame(spark, [annotation("task-1"), annotation("task-2")])
    for b in (a.where("task_id = 'task-1'"), a.union(a)):
        with pytest.raises(ValueError):
            ev.evaluate(a, b, "task_id", "shown")
    with pytest.raises(ValueError):
        ev.evaluate(a.limit(0), a.limit(0), "task_id", "shown")


def test_raters(spark):
    def rows(values):
        return frame(spark, [annotation(f"task-{i}", latency=label("explicit", v, number=1.0)) for i, v in enumerate(values)])

    order = ev.VALUES["latency"]
    got = {(r.field, r.measure): r for r in ev.pairwise_agreement(rows(order[:3]), rows(order[:3][::-1]), "task_id").collect()}
    assert got["latency", "value"].kappa == -1.0 and got["latency", "value"].n == 3  # quadratic
    assert got["latency", "status"].agreement == 1.0 and got["latency", "status"].kappa is None
    assert ("domain", "value") not in got and got["domain", "exact"].agreement == 1.0
    assert got["execution_policy", "jaccard"].agreement == 1.0 and got["execution_policy", "cloud"].n == 3
    assert got["all", "exact_field"].agreement == pytest.approx(22 / 24, abs=1e-6) and got["all", "exact_record"].agreement == pytest.approx(1 / 3, abs=1e-6)
    with pytest.raises(Exception, match="outside the ordinal scale"):
        ev.pairwise_agreement(rows(["sometimes"]), rows(["relaxed"]), "task_id").collect()


def test_constant_profile(spark):
    seen = frame(spark, [annotation("a-1", domain=label("explicit", "consumer")), annotation("a-2", domain=label("explicit", "agriculture")), annotation("a-3", domain=label("explicit", "consumer"))])
    out = ev.predict_constant(spark.createDataFrame([("b-1", " a task "), ("b-2", None)], "task_id string, task_text string"), ev.fit_constant(seen, "task_id"), "task_text").orderBy("task_id").first()
    assert (out.domain.status, out.domain.value, out.domain.evidence) == ("explicit", "consumer", ["a task"]) and out.domain.confidence == pytest.approx(2 / 3, abs=1e-6)
    assert "latency" in out.abstained_fields and "domain" not in out.abstained_fields and out.execution_policy.cloud == "unknown"
    with pytest.raises(ValueError):
        ev.predict_constant(seen, ev.fit_constant(seen, "task_id").where("field <> 'domain'"), "shown")
