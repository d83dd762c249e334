"""Reports on annotations in wide form: a key and one struct of a common shape per field of `extract.FIELDS`.

The struct holds status, value, device, edge, cloud, metric and number; of
predictions also evidence (array) and confidence.  `extract.rule_labels` and
`extract.assembled` give this form.  Both sides are joined once on their key and
everything that belongs to a record is a column of the joined row, so a report
is a few combined aggregates over that join, whatever the number of records.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import casting
from quillon.operators import agreement, metrics
from quillon.operators.extract import FIELDS

# What a field may say, in order where the levels are ordered; who may run a task; how a field stands.
VALUES = {
    "domain": ("healthcare", "industrial", "transportation", "public_safety", "smart_city", "agriculture", "consumer", "other"),
    "latency": ("relaxed", "interactive", "real_time", "hard_real_time"),
    "privacy": ("public", "internal", "sensitive", "restricted"),
    "reliability": ("best_effort", "standard", "high", "mission_critical"),
    "accuracy": ("relaxed", "standard", "high", "critical"),
    "energy_priority": ("low", "balanced", "high"),
    "divisibility": ("divisible", "indivisible"),
}
ORDERED = ("latency", "reliability", "accuracy", "energy_priority")
TARGETS = ("device", "edge", "cloud")
PERMISSIONS = ("allowed", "forbidden", "unknown")
STATUSES = ("explicit", "not_stated", "ambiguous")
HELD = ("not_stated", "ambiguous")
LONGEST_MS, LONGEST_EVIDENCE, LONGEST_METRIC = 3_600_000, 500, 80
TASK_ID = "^[A-Za-z0-9][A-Za-z0-9._-]{2,127}$"
#: Fields whose loss is critical, and the values that make it so.
CRITICAL = {"privacy": ("sensitive", "restricted"), "latency": ("real_time", "hard_real_time")}

_PARTS = {"execution_policy": TARGETS, "accuracy": ("value", "metric")}


def categorical(c: Column, field: str) -> Column:
    """The status and the categorical values of a field as JSON: what models learn and F1 compares."""
    return F.to_json(F.array(c["status"], *[c[p] for p in _PARTS.get(field, ("value",))]))


def strict(c: Column, field: str) -> Column:
    """A struct of the status, the categorical values and the stated number: what two raters must share."""
    return F.struct(c["status"].alias("status"), *[c[p].alias(p) for p in _PARTS.get(field, ("value",))], c["number"].cast("double").alias("number"))


def same_label(a: Column, b: Column, field: str) -> Column:
    """Whether two labels say the same, numbers within 1e-9; null agrees with null."""
    parts = [casting.same_value(a[p], b[p], numeric=False) for p in ("status", *_PARTS.get(field, ("value",)))]
    return reduce(and_, parts) & casting.same_value(a["number"].cast("double"), b["number"].cast("double"), numeric=True)


def label_valid(c: Column, field: str) -> Column:
    """Whether a predicted label obeys the annotation schema: its values, and what its status asks of values and evidence."""
    status, evidence, number, metric = c["status"], c["evidence"], c["number"], c["metric"]
    values = [c[t] for t in TARGETS] if field == "execution_policy" else [c["value"]]
    held, explicit = status.isin(*HELD), status == "explicit"
    some = F.size(evidence) > 0
    rules = [
        status.isin(*STATUSES, *(["partial"] if field == "execution_policy" else [])),
        c["confidence"].between(0.0, 1.0),
        F.size(F.array_distinct(evidence)) == F.size(evidence),
        F.forall(evidence, lambda x: F.length(x).between(1, LONGEST_EVIDENCE)),
        F.when(explicit | (status == "ambiguous"), some).when(status == "not_stated", ~some).otherwise(True),
    ]
    if field == "execution_policy":
        known = [v.isin("allowed", "forbidden") for v in values]
        rules += [v.isin(*PERMISSIONS) for v in values]
        rules.append(F.when(explicit, reduce(and_, known)).when(status == "partial", some & reduce(or_, known)).otherwise(reduce(and_, [v == "unknown" for v in values])))
    else:
        rules.append(F.when(explicit, values[0].isin(*VALUES[field])).otherwise(values[0].isNull()))
    limits = {"latency": (number > 0) & (number <= LONGEST_MS), "reliability": number.between(0.0, 1.0), "accuracy": number.between(0.0, 1.0)}
    rules.append(number.isNull() | (~held & limits[field]) if field in limits else number.isNull())
    rules.append(metric.isNull() | (~held & F.length(metric).between(1, LONGEST_METRIC)) if field == "accuracy" else metric.isNull())
    return reduce(and_, [F.coalesce(r, F.lit(False)) for r in rules])


def annotation_valid(key: Column, labels: dict[str, Column], held: Column, confidence: Column) -> Column:
    """Whether a whole annotation obeys the schema: its id, labels, abstained fields and overall confidence."""
    rules = [key.cast("string").rlike(TASK_ID), confidence.between(0.0, 1.0), F.size(F.array_distinct(held)) == F.size(held), F.forall(held, lambda x: x.isin(*FIELDS))]
    return reduce(and_, [F.coalesce(r, F.lit(False)) for r in rules] + [label_valid(labels[f], f) for f in FIELDS])


def _pairs(left: DataFrame, right: DataFrame, key: str, same=same_label) -> DataFrame:
    """key, l, r and `same`, an array of one boolean a field; raises unless both sides have the same keys, each once."""
    both = agreement.aligned(left, right, key)
    return both.withColumn("same", F.array(*[same(F.col("l")[f], F.col("r")[f], f) for f in FIELDS]))


def _share(c: Column) -> Column:
    return F.round(F.avg(c.cast("double")), 6)


def _counted(pairs: DataFrame, **columns) -> DataFrame:
    """field, same, the columns told by functions of (l, r, field), and k, how many labels of all records are so: one shuffle of counts, whose size the vocabularies bound."""
    l, r = F.col("l"), F.col("r")
    rows = pairs.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col("same")[i].alias("same"), *[make(l[f], r[f], f).alias(n) for n, make in columns.items()]) for i, f in enumerate(FIELDS)])))
    return rows.groupBy("field", "same", *columns).agg(F.count(F.lit(1)).alias("k"))


def _agreeing(c: Column | str) -> Column:
    return F.round(F.sum(F.when(F.col(c) if isinstance(c, str) else c, F.col("k")).otherwise(0)) / F.sum("k"), 6)


def _signatures(pairs: DataFrame) -> DataFrame:
    return _counted(pairs, truth=lambda l, r, f: categorical(l, f), predicted=lambda l, r, f: categorical(r, f))


def evaluate_fields(references: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Per field: n, exact_accuracy, macro_f1 over categorical signatures, n_truth (different signatures of the references)."""
    told = _signatures(_pairs(references, predictions, key))
    exact = told.groupBy("field").agg(F.sum("k").alias("n"), _agreeing("same").alias("exact_accuracy"))
    labels = metrics.label_counts(told, "truth", "predicted", "field", weight="k")
    score = metrics.f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return exact.join(labels.groupBy("field").agg(F.round(F.avg(score), 6).alias("macro_f1"), F.count_if(F.col("tp") + F.col("fn") > 0).alias("n_truth")), "field")


def evaluate(references: DataFrame, predictions: DataFrame, key: str, shown: str, milliseconds: str | None = None) -> DataFrame:
    """One row: how predictions meet the references.

    predictions also carry abstained_fields, overall_confidence, the visible text
    `shown`, and if told a duration. Scores of a class that no reference holds are
    null; without evidence the grounding rate is 1. Empty sides raise.
    """
    pairs = _pairs(references, predictions, key)
    if pairs.isEmpty():
        raise ValueError("nothing to evaluate")
    l, r = F.col("l"), F.col("r")
    valid = annotation_valid(F.col(key), {f: r[f] for f in FIELDS}, r["abstained_fields"], r["overall_confidence"])
    phrases = F.concat(*[F.coalesce(r[f]["evidence"], F.array().cast("array<string>")) for f in FIELDS])
    grounded = F.size(F.filter(phrases, lambda x: r[shown].contains(x)))

    def critical(side: Column, field: str) -> Column:
        return F.coalesce((side[field]["status"] == "explicit") & side[field]["value"].isin(*CRITICAL[field]), F.lit(False))

    scores = [s.alias(f"{f}_{n}") for f in CRITICAL for s, n in zip(metrics.binary_scores(critical(l, f), critical(r, f)), ("critical", "precision", "recall", "f1"))]
    held = [(F.coalesce(l[f]["status"].isin(*HELD), F.lit(False)), F.coalesce(r[f]["status"].isin(*HELD), F.lit(False))) for f in FIELDS]
    both, truly, said = (F.sum(sum((c.cast("long") for c in cells), F.lit(0))) for cells in ([a & b for a, b in held], [a for a, _ in held], [b for _, b in held]))
    some = truly > 0
    abstained = [
        F.round(F.avg(sum(((a == b).cast("double") for a, b in held), F.lit(0.0)) / len(FIELDS)), 6).alias("abstention_accuracy"),
        truly.alias("abstention_positives"),
        F.when(some, F.round(F.coalesce(both / F.nullif(said, F.lit(0)), F.lit(0.0)), 6)).alias("abstention_precision"),
        F.when(some, F.round(both / F.nullif(truly, F.lit(0)), 6)).alias("abstention_recall"),
        F.when(some, F.round(2 * both / F.nullif(truly + said, F.lit(0)), 6)).alias("abstention_f1"),
    ]
    times = [] if milliseconds is None else [F.round(F.avg(r[milliseconds]), 6).alias("mean_ms"), F.round(F.median(r[milliseconds]), 6).alias("median_ms"), F.round(F.percentile(r[milliseconds], F.lit(0.95)), 6).alias("p95_ms"), F.round(F.sum(r[milliseconds]), 6).alias("total_ms")]
    records = pairs.agg(
        F.count(F.lit(1)).alias("n"),
        _share(valid).alias("schema_validity"),
        _share(F.forall("same", lambda x: x)).alias("exact_record"),
        F.coalesce(F.round(F.sum(grounded) / F.nullif(F.sum(F.size(phrases)), F.lit(0)), 6), F.lit(1.0)).alias("grounding_rate"),
        _share(F.size(F.filter("same", lambda x: x)) / len(FIELDS)).alias("exact_field"),
        *scores,
        *abstained,
        *times,
    )
    told = _signatures(pairs)
    labels = metrics.label_counts(told, "truth", "predicted", "field", weight="k")
    each = labels.groupBy("field").agg(F.avg(metrics.f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("f"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    f1 = each.agg(F.round(metrics.f1(F.sum("tp"), F.sum("fp"), F.sum("fn")), 6).alias("micro_f1"), F.round(F.avg("f"), 6).alias("macro_f1_across_fields"))
    cells = pairs.select(F.inline(F.array(*[F.struct(F.col("same")[i].alias("same"), r[f]["confidence"].cast("double").alias("confidence")) for i, f in enumerate(FIELDS)])))
    sure = metrics.calibration(cells, "confidence", "same").select("brier", "ece")
    return records.crossJoin(f1).crossJoin(sure)  # one row each


def pairwise_agreement(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How two raters agree: field, measure, n, agreement, kappa (6 decimals).

    Measures of a field: exact (labels that say the same), status (Cohen), value
    (where both call it explicit; quadratic on ordered levels, else Cohen), of
    the execution policy each target (Cohen) and the mean Jaccard of allowed
    targets; of field "all": exact_field and exact_record. A measure without
    rows has no row; a value outside its scale raises.
    """
    pairs = _pairs(left, right, key, same=lambda a, b, f: strict(a, f).eqNullSafe(strict(b, f)))
    parts = ("status", "value", *TARGETS)
    told = _counted(pairs, **{f"{side}_{p}": (lambda l, r, f, p=p, side=side: (l if side == "l" else r)[p]) for p in parts for side in "lr"})
    none = F.lit(None).cast("double")
    policy, explicit = F.col("field") == "execution_policy", (F.col("l_status") == "explicit") & (F.col("r_status") == "explicit")
    # each row of counts as a pair of labels of every measure it belongs to
    as_pair = lambda p: F.struct(F.lit(p).alias("measure"), F.col(f"l_{p}").alias("a"), F.col(f"r_{p}").alias("b"))
    named = told.select("field", "k", F.inline(F.array_compact(F.array(as_pair("status"), F.when(explicit & ~policy, as_pair("value")), *[F.when(policy, as_pair(t)) for t in TARGETS]))))
    kappas = agreement.cohen_kappa(named, "a", "b", "field", "measure", weight="k").withColumnRenamed("observed", "agreement")
    place = F.create_map(*[x for f in ORDERED for i, v in enumerate(VALUES[f]) for x in (F.lit(f"{f}:{v}"), F.lit(str(i)))])
    ranks = told.where(explicit & F.col("field").isin(*ORDERED)).select("field", "k", *[place[F.concat_ws(":", "field", f"{side}_value")].alias(side) for side in "lr"])
    levels = [str(i) for i in range(max(len(VALUES[f]) for f in ORDERED))]
    qwk = agreement.quadratic_kappa(ranks, "l", "r", levels, "field", weight="k").select("field", F.lit("value").alias("measure"), "qwk")
    quadratic = (F.col("measure") == "value") & F.col("field").isin(*ORDERED)
    kappas = kappas.join(qwk, ["field", "measure"], "left").select("field", "measure", "n", "agreement", F.when(quadratic, F.col("qwk")).otherwise(F.col("kappa")).alias("kappa"))
    # shares: of equal labels by field and over all, and the overlap of allowed targets
    allowed = [F.array_compact(F.array(*[F.when(F.col(f"{side}_{t}") == "allowed", t) for t in TARGETS])) for side in "lr"]
    shared = lambda field, measure, value: F.struct(field.alias("field"), F.lit(measure).alias("measure"), value.cast("double").alias("v"))
    shares = told.select("k", F.inline(F.array_compact(F.array(shared(F.col("field"), "exact", F.col("same")), shared(F.lit("all"), "exact_field", F.col("same")), F.when(policy, shared(F.col("field"), "jaccard", agreement.jaccard(*allowed)))))))
    shares = shares.groupBy("field", "measure").agg(F.sum("k").alias("n"), F.round(F.sum(F.col("k") * F.col("v")) / F.sum("k"), 6).alias("agreement"))
    whole = pairs.agg(F.count(F.lit(1)).alias("n"), _share(F.forall("same", lambda x: x)).alias("agreement")).where("n > 0").select(F.lit("all").alias("field"), F.lit("exact_record").alias("measure"), "n", "agreement")
    return shares.unionByName(whole).withColumn("kappa", none).unionByName(kappas)


def fit_constant(annotations: DataFrame, key: str) -> DataFrame:
    """field, signature, confidence: the most frequent categorical signature of each field (the smallest of equals)."""
    long = annotations.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), categorical(F.col(f), f).alias("signature")) for f in FIELDS])))
    return metrics.majority(long, "signature", "field").select("field", F.col("label").alias("signature"), "confidence")


def predict_constant(df: DataFrame, model: DataFrame, text_col: str) -> DataFrame:
    """df with a struct column per field that says what the model (8 rows, one a field) found most frequent, as `extract.assembled` gives it: a stated label has the text's first characters as evidence."""
    from quillon.functions import text

    told = {r.field: r for r in model.collect()}  # one row a field
    if set(told) != set(FIELDS):
        raise ValueError("the model doesn't tell every field")
    out = {}
    for f in FIELDS:
        parts = ("status", *_PARTS.get(f, ("value",)))
        said = F.from_json(F.lit(told[f].signature), "array<string>")
        values = {p: said[i] for i, p in enumerate(parts)}
        none = F.lit(None).cast("string")
        evidence = F.when(values["status"] == "not_stated", F.array().cast("array<string>")).otherwise(F.array(text.evidence(F.col(text_col))))
        out[f] = F.struct(*[values.get(p, none).alias(p) for p in ("status", "value", *TARGETS, "metric")], F.lit(None).cast("double").alias("number"), evidence.alias("evidence"), F.lit(float(told[f].confidence)).alias("confidence"))
    held = [F.when(F.col(f)["status"].isin(*HELD), F.lit(f)) for f in FIELDS]
    return df.withColumns(out).withColumns({"abstained_fields": F.array_compact(F.array(*held)), "overall_confidence": sum((F.col(f)["confidence"] for f in FIELDS), F.lit(0.0)) / len(FIELDS)})
