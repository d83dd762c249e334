"""Corpora of labelled tasks: expanding a blueprint, form gates, flat forms, scenario gates, named random streams."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import identity, text
from quillon.operators import ordered
from quillon.operators.audits import DOMAINS, PACKET_KEYS, issues, repeated, row_issues, together
from quillon.operators.extract import FIELDS

LABEL_TARGETS = ("device", "edge", "cloud")


def load_json_object(path: str | Path) -> dict:
    """A JSON file whose root is an object."""
    value = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(value, dict):
        raise ValueError(f"{path}: the root isn't an object")
    return value


def expand_blueprint(spark: SparkSession, blueprint: dict, n_contexts: int = 15, variants: int = 2) -> DataFrame:
    """Tasks of a blueprint: every domain has n_contexts (subject, operation) contexts, each told in `variants` ways.

    blueprint: {"domains": {domain: {"data": text, "contexts": [[subject, operation], ...]}},
    "templates": [text, ...] with {subject}, {operation} and {data}, one a variant}.
    Domains are numbered in sorted order, so ids never depend on the file's.
    """
    domains, templates = blueprint["domains"], blueprint["templates"]
    if set(domains) != set(DOMAINS):
        raise ValueError("the blueprint must hold exactly the frozen domains")
    if len(templates) != variants or any(len(d["contexts"]) != n_contexts or any(len(c) != 2 for c in d["contexts"]) for d in domains.values()):
        raise ValueError("contexts or templates are incomplete")
    rows = [(i, name, domains[name]["data"], [{"subject": s, "operation": o} for s, o in domains[name]["contexts"]]) for i, name in enumerate(sorted(domains))]
    d = spark.createDataFrame(rows, "d int, scenario_domain string, data string, contexts array<struct<subject:string,operation:string>>")
    d = d.select("d", "scenario_domain", "data", F.posexplode("contexts").alias("p", "c"))
    d = d.select("*", F.posexplode(F.array(*map(F.lit, templates))).alias("variant", "template"))
    family = F.col("d") * n_contexts + F.col("p") + 1
    number = (family - 1) * variants + F.col("variant") + 1
    told = F.col("template")
    for name, c in (("subject", F.col("c.subject")), ("operation", F.col("c.operation")), ("data", F.col("data"))):
        told = F.replace(told, F.lit("{" + name + "}"), c)
    return d.select(
        F.format_string("task_%03d", number).alias("task_id"), told.alias("task_text"), "scenario_domain", "variant",
        F.format_string("family_%03d", family).alias("scenario_family_id"), F.format_string("template_%03d", F.col("p") + 1).alias("template_family_id"),
    )


def family_leaks(tasks: DataFrame, family: str, split: str) -> DataFrame:
    """Families with tasks in more than one part."""
    n = tasks.groupBy(family).agg(F.count_distinct(split).alias("n")).where("n > 1")
    return issues(n, "family_in_two_parts", F.col(family), F.col("n"))


def form_issues(packet: DataFrame, annotator: str, packet_sha256: str, responses: DataFrame | None = None) -> DataFrame:
    """Gates of a form: exact columns, one rater, one packet and protocol version, contiguous order, known tasks and fields. responses: task_id, field."""
    one = packet.sparkSession.range(1)
    odd = sorted(set(packet.columns) ^ set(PACKET_KEYS))
    parts = [issues(one, "columns_differ", F.lit(c)) for c in odd]
    if not (len(packet_sha256) == 64 and set(packet_sha256) <= set("0123456789abcdef")):
        parts.append(issues(one, "packet_hash_malformed", F.lit(packet_sha256)))
    if not odd:
        n = packet.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("packet_version").alias("v"), F.count_distinct("protocol_version").alias("p"), F.count_distinct("presentation_order").alias("o"), F.min("presentation_order").alias("lo"), F.max("presentation_order").alias("hi"))
        parts += [
            row_issues(packet, "task_id", [("wrong_annotator", F.col("annotator_id") != annotator)]),
            repeated(packet, "task_repeated", F.col("task_id")),
            row_issues(n.withColumn("k", F.lit("packet")), "k", [("packet_empty", F.col("n") == 0), ("several_packet_versions", F.col("v") > 1), ("several_protocol_versions", F.col("p") > 1), ("order_not_contiguous", (F.col("n") > 0) & ((F.col("o") != F.col("n")) | (F.col("lo") != 1) | (F.col("hi") != F.col("n"))))]),
        ]
        if responses is not None:
            parts.append(issues(responses.join(packet.select("task_id"), "task_id", "left_anti"), "response_to_unknown_task", F.col("task_id")))
            parts.append(row_issues(responses, "task_id", [("unknown_field", ~F.col("field").isin(*FIELDS))]))
    return together(parts)


def form_value(label: Column) -> Column:
    """A label struct as flat text for a form: null as empty, confidence with two decimals, evidence by lines."""
    empty = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.struct(label["status"].alias("status"), empty(label["value"]).alias("value"), empty(label["number"]).alias("number"), empty(label["metric"]).alias("metric"), F.format_string("%.2f", label["confidence"].cast("double")).alias("confidence"), F.array_join(label["evidence"], "\n").alias("evidence"))


def decision_summary(field: Column, label: Column) -> Column:
    """One line: field, status, value, number, metric if there is one, targets if there are."""
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    targets = F.when(label["device"].isNotNull(), F.concat_ws(", ", *[F.concat(F.lit(f"{t}="), shown(label[t])) for t in LABEL_TARGETS]))
    return F.concat_ws(", ", F.concat(F.lit("field="), field), F.concat(F.lit("status="), label["status"]), F.concat(F.lit("value="), shown(label["value"])), F.concat(F.lit("number="), shown(label["number"])), F.when(label["metric"].isNotNull(), F.concat(F.lit("metric="), label["metric"])), targets)


def form_page(rows: list[dict], template: str, marker: str = "<!--DATA-->") -> str:
    """A page with the rows as embedded JSON in place of the one marker; '<' is escaped, so no text can end the script."""
    if template.count(marker) != 1:
        raise ValueError("the template needs the marker once")
    return template.replace(marker, json.dumps(rows, ensure_ascii=False, sort_keys=True).replace("<", "\\u003c"))


def escaped(c: Column) -> Column:
    return text.escaped_html(c)


def json_scalar(c: Column, kind: str) -> Column:
    """An engine value as JSON text: times in ISO form with a space, booleans as 0/1, numbers that aren't finite as null."""
    if kind == "float":
        return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c.cast("string")).otherwise("null")
    if kind == "boolean":
        return F.coalesce(c.cast("int").cast("string"), F.lit("null"))
    if kind == "integer":
        return F.coalesce(c.cast("string"), F.lit("null"))
    return identity.json_string(c.cast("string"))


def scenario_issues(scenarios: DataFrame) -> DataFrame:
    """scenarios: episode_id, tasks, events, actions (arrays), labels (array of action labels)."""
    return row_issues(scenarios, "episode_id", [("no_task", F.size("tasks") < 1), ("tasks_and_events_differ", F.size("tasks") != F.size("events")), ("no_action", F.size("actions") < 1), ("action_label_not_unique", F.size("labels") != F.size(F.array_distinct("labels")))])


def previous_action(outcomes: DataFrame, episode: str, order: str, action: str) -> DataFrame:
    """outcomes with previous_action: the action before it in its episode, whatever the episode's size."""
    return ordered.previous(outcomes, episode, order, action, "previous_action")


def best_class(probabilities: Column, labels: Column) -> Column:
    """The label of the largest probability, the first of equals."""
    return F.element_at(labels, F.array_position(probabilities, F.array_max(probabilities)).cast("int"))


def stream_words(name: str) -> list[int]:
    """Four words of a stream's name: the first 16 bytes of its SHA-256, little-endian."""
    if not name:
        raise ValueError("a stream needs a name")
    return [int.from_bytes(hashlib.sha256(name.encode()).digest()[i : i + 4], "little") for i in range(0, 16, 4)]


def numpy_stream(root_seed: int, name: str):
    """A NumPy generator of a named stream: adding or reordering streams never changes another."""
    import numpy as np

    if root_seed < 0:
        raise ValueError("the seed must not be negative")
    return np.random.default_rng(np.random.SeedSequence([root_seed, *stream_words(name)]))


def folded_exactly(c: Column) -> Column:
    """Case folding, dotless i as i, NFKD without combining marks, by Python's Unicode tables (an Arrow UDF; `text.folded` covers Latin letters inside the JVM)."""
    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            flat = unicodedata.normalize("NFKD", t.casefold().replace("ı", "i"))
            return "".join(x for x in flat if not unicodedata.combining(x))

        return s.map(one)

    return fold(c)
