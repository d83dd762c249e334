"""Deterministic replay of offloading decisions: channel, masks, one step, an ordered fold per episode.

A step is a set of Column expressions over the state and the task; a replay folds
it over the ordered tasks of an episode with `aggregate`, so episodes run in
parallel inside the JVM.  An episode's tasks are one array: episodes are bounded
by contract (MAX_EPISODE), and a longer one raises.

Columns of a task row: episode_id, step, arrival_s, input_bits, output_bits,
cycles, tier (device/edge/cloud), target (server id), allowed (array of tiers),
max_latency_s, min_success, min_accuracy (null: none), failed_targets,
failed_links (arrays).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import ordered

MAX_EPISODE = 100_000
LIGHT_M_PER_S = 299_792_458.0
NOISE_DBM_PER_HZ = -174.0


@dataclass(frozen=True)
class Radio:
    carrier_hz: float = 3.5e9
    bandwidth_hz: float = 20e6
    exponent: float = 3.0
    reference_m: float = 1.0
    noise_figure_db: float = 7.0
    uplink_dbm: float = 23.0
    downlink_dbm: float = 30.0
    shadowing_db: float = 0.0
    success: float = 1.0


@dataclass(frozen=True)
class Device:
    cpu_hz: float
    kappa: float
    tx_w: float
    rx_w: float
    idle_w: float
    success: float
    accuracy: float
    battery_j: float
    free_s: float = 0.0


@dataclass(frozen=True)
class Server:
    server_id: str
    tier: str
    cpu_hz: float
    success: float
    accuracy: float
    up_bps: float
    down_bps: float
    link_success: float
    free_s: float = 0.0
    available: bool = True
    backhaul_bps: float | None = None
    propagation_s: float = 0.0
    backhaul_success: float = 1.0

    def __post_init__(self) -> None:
        if self.tier == "cloud" and not self.backhaul_bps:
            raise ValueError("a cloud server needs a backhaul")


@dataclass(frozen=True)
class Physics:
    latency_ref_s: float = 1.0
    energy_ref_j: float = 1.0
    detection_s: float = 0.0
    mask_semantic: bool = True
    mask_unavailable: bool = True
    #: latency, energy, deadline, soft constraint, failure, hard constraint
    weights: tuple[float, ...] = field(default=(1.0, 1.0, 5.0, 5.0, 10.0, 20.0))


def path_loss_db(distance_m: Column, radio: Radio = Radio()) -> Column:
    """Log-distance loss with free-space loss at the reference distance; nearer than that is null."""
    reference = 20.0 * math.log10(4.0 * math.pi * radio.carrier_hz * radio.reference_m / LIGHT_M_PER_S)
    return F.when(distance_m >= radio.reference_m, reference + 10.0 * radio.exponent * F.log10(distance_m / radio.reference_m) + radio.shadowing_db)


def snr_db(tx_dbm: float, loss_db: Column, radio: Radio = Radio()) -> Column:
    return tx_dbm - loss_db - (NOISE_DBM_PER_HZ + 10.0 * math.log10(radio.bandwidth_hz) + radio.noise_figure_db)


def shannon_bps(snr: Column, radio: Radio = Radio()) -> Column:
    return radio.bandwidth_hz * F.log2(1.0 + F.pow(F.lit(10.0), snr / 10.0))


def link_budget(df: DataFrame, distance_m: str, radio: Radio = Radio()) -> DataFrame:
    """df with path_loss_db, snr_db, uplink_bps, downlink_bps, link_success."""
    out = df.withColumn("path_loss_db", path_loss_db(F.col(distance_m), radio)).withColumn("snr_db", snr_db(radio.uplink_dbm, F.col("path_loss_db"), radio))
    return out.withColumns({"uplink_bps": shannon_bps(F.col("snr_db"), radio), "downlink_bps": shannon_bps(snr_db(radio.downlink_dbm, F.col("path_loss_db"), radio), radio), "link_success": F.lit(radio.success)})


def action_mask(tasks: DataFrame, servers: list[Server], physics: Physics = Physics()) -> DataFrame:
    """tasks × actions: action_tier, action_target, is_available, from what is known before the decision. The actions are a fixed list inside the row."""
    actions = F.array(F.struct(F.lit("device").alias("action_tier"), F.lit("local").alias("action_target"), F.lit(True).alias("up")), *[F.struct(F.lit(s.tier).alias("action_tier"), F.lit(s.server_id).alias("action_target"), F.lit(s.available).alias("up")) for s in servers])
    out = tasks.select("*", F.inline(actions))
    ok = F.array_contains("allowed", F.col("action_tier")) if physics.mask_semantic else F.lit(True)
    return out.withColumn("is_available", ok & (F.col("up") if physics.mask_unavailable else F.lit(True))).drop("up")


def _per_server(servers: list[Server], target: Column, value) -> Column:
    c = F.lit(None).cast("double")
    for s in servers:
        c = F.when(target == s.server_id, F.lit(value(s)).cast("double")).otherwise(c)
    return c


def step(state: Column, t: Column, device: Device, servers: list[Server], physics: Physics) -> Column:
    """The next state: struct<now, battery, device_free, free map, out array>. One task; failures in their order of precedence."""
    now, battery, free = t["arrival_s"], state["battery"], state["free"]
    local = t["tier"] == "device"
    get = lambda value: _per_server(servers, t["target"], value)
    exists = F.lit(False)
    for s in servers:
        exists = exists | ((t["target"] == s.server_id) & (t["tier"] == s.tier))
    structure = F.when(local, t["target"] == "local").otherwise(exists)
    allowed = F.array_contains(t["allowed"], t["tier"])
    up = F.coalesce(get(lambda s: float(s.available)) == 1.0, F.lit(False)) | local
    cloud = t["tier"] == "cloud"
    p = F.when(local, device.success).otherwise(get(lambda s: s.success) * F.pow(get(lambda s: s.link_success), F.lit(2.0)) * F.when(cloud, F.pow(get(lambda s: s.backhaul_success), F.lit(2.0))).otherwise(1.0))
    accuracy = F.when(local, device.accuracy).otherwise(get(lambda s: s.accuracy))
    upload = F.when(local, 0.0).otherwise(t["input_bits"] / get(lambda s: s.up_bps))
    download = F.when(local, 0.0).otherwise(t["output_bits"] / get(lambda s: s.down_bps))
    bh_up = F.when(cloud, t["input_bits"] / get(lambda s: s.backhaul_bps)).otherwise(0.0)
    bh_down = F.when(cloud, t["output_bits"] / get(lambda s: s.backhaul_bps)).otherwise(0.0)
    way = F.when(local, 0.0).otherwise(get(lambda s: s.propagation_s))
    around = F.when(cloud, 2.0 * way).otherwise(0.0)
    arrival = now + upload + bh_up + way
    begin = F.greatest(arrival, F.when(local, state["device_free"]).otherwise(F.element_at(free, t["target"])))
    wait = begin - arrival
    compute = t["cycles"] / F.when(local, device.cpu_hz).otherwise(get(lambda s: s.cpu_hz))
    latency = upload + bh_up + wait + compute + bh_down + around + download
    energy = F.when(local, device.kappa * t["cycles"] * device.cpu_hz**2 + device.idle_w * wait).otherwise(device.tx_w * upload + device.idle_w * (bh_up + wait + compute + bh_down + around) + device.rx_w * download)
    masked = (~allowed) if physics.mask_semantic else F.lit(False)
    reason = (
        F.when(~structure | masked, "invalid_action")
        .when(~up, "target_unavailable")
        .when(F.array_contains(t["failed_targets"], t["target"]), "target_failure")
        .when(~local & F.array_contains(t["failed_links"], t["target"]), "link_failure")
        .when(energy > battery, "battery_depleted")
        .otherwise("none")
    )
    inner = F.struct(reason.alias("reason"), energy.alias("energy"), latency.alias("latency"), begin.alias("begin"), wait.alias("wait"), compute.alias("compute"), p.alias("p"), accuracy.alias("accuracy"), (~allowed).alias("disallowed"), upload.alias("upload"), download.alias("download"))
    return inner


def outcome(t: Column, s: Column, battery: Column, device: Device, physics: Physics) -> Column:
    """struct of the outcome of a task from the inner values s of `step`."""
    reason = s["reason"]
    done = reason == "none"
    invalid = reason == "invalid_action"
    energy = F.when(done, s["energy"]).when(reason == "battery_depleted", battery).when(reason == "link_failure", F.least(battery, F.lit(device.tx_w * physics.detection_s))).otherwise(0.0)
    latency = F.when(done, s["latency"]).otherwise(physics.detection_s)
    p, accuracy = F.when(invalid, 0.0).otherwise(s["p"]), F.when(invalid, 0.0).otherwise(s["accuracy"])
    hard = invalid | (reason == "target_unavailable") | s["disallowed"]
    deadline = F.coalesce(latency > t["max_latency_s"], F.lit(False))
    unreliable = F.coalesce(p < t["min_success"], F.lit(False))
    inexact = F.coalesce(accuracy < t["min_accuracy"], F.lit(False))
    w = physics.weights
    num = lambda c: c.cast("double")
    reward = -(w[0] * latency / physics.latency_ref_s + w[1] * energy / physics.energy_ref_j + w[2] * num(deadline) + w[3] * (num(unreliable) + num(inexact)) + w[4] * num(~done) + w[5] * num(hard))
    return F.struct(
        t["step"].alias("step"), reason.alias("failure_reason"), done.alias("completed"), (done & ~deadline & ~unreliable & ~inexact & ~hard).alias("success"),
        latency.alias("latency_s"), energy.alias("energy_j"), F.when(done, s["wait"]).otherwise(0.0).alias("wait_s"), p.alias("success_probability"), accuracy.alias("accuracy"),
        deadline.alias("deadline_missed"), unreliable.alias("reliability_violated"), inexact.alias("accuracy_violated"), hard.alias("hard_violated"), reward.alias("reward"), (battery - energy).alias("battery_j"),
    )


def replay(tasks: DataFrame, device: Device, servers: list[Server], physics: Physics = Physics()) -> DataFrame:
    """episode_id and the outcome of each task, tasks taken in (arrival_s, step) order."""
    names = [c for c in tasks.columns if c != "episode_id"]
    ordered = F.array_sort(F.collect_list(F.struct("arrival_s", "step", *[c for c in names if c not in ("arrival_s", "step")])))
    episodes = tasks.groupBy("episode_id").agg(ordered.alias("tasks"))
    episodes = episodes.withColumn("tasks", F.when(F.size("tasks") <= MAX_EPISODE, F.col("tasks")).otherwise(F.raise_error(F.lit("an episode is longer than its contract"))))
    free0 = F.map_from_arrays(F.array(*[F.lit(s.server_id) for s in servers]).cast("array<string>"), F.array(*[F.lit(float(s.free_s)) for s in servers]).cast("array<double>"))
    first = F.struct(F.lit(float(device.battery_j)).alias("battery"), F.lit(float(device.free_s)).alias("device_free"), free0.alias("free"), F.array().cast(_OUT).alias("out"))

    def merge(state: Column, t: Column) -> Column:
        # evaluated once per task: the inner values become a one-element array that the next lambda reads
        inner = F.array(step(state, t, device, servers, physics))
        after = F.transform(inner, lambda s: F.struct(s.alias("s"), outcome(t, s, state["battery"], device, physics).alias("o")))
        advanced = F.transform(after, lambda x: F.struct(
            x["o"]["battery_j"].alias("battery"),
            F.when((t["tier"] == "device") & x["o"]["completed"], x["s"]["begin"] + x["s"]["compute"]).otherwise(state["device_free"]).alias("device_free"),
            F.when((t["tier"] != "device") & x["o"]["completed"], F.transform_values(state["free"], lambda k, v: F.when(k == t["target"], x["s"]["begin"] + x["s"]["compute"]).otherwise(v))).otherwise(state["free"]).alias("free"),
            F.concat(state["out"], F.array(x["o"])).alias("out"),
        ))
        return F.element_at(advanced, 1)

    return episodes.select("episode_id", F.inline(F.aggregate("tasks", first, merge, lambda s: s["out"])))


_OUT = "array<struct<step:bigint,failure_reason:string,completed:boolean,success:boolean,latency_s:double,energy_j:double,wait_s:double,success_probability:double,accuracy:double,deadline_missed:boolean,reliability_violated:boolean,accuracy_violated:boolean,hard_violated:boolean,reward:double,battery_j:double>>"


def episode_totals(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n_tasks"), F.sum("reward").alias("total_reward"), F.count_if("success").alias("n_success"))


def fcfs(jobs: DataFrame, queue: str, arrival: str, service: str, order: str) -> DataFrame:
    """jobs with begin_s, wait_s, end_s of a first-come-first-served queue in closed form.

    end(i) = S(i) + max over j <= i of (arrival(j) - S(j - 1)) with S the running
    service time: two running windows per queue, no loop.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(queue).orderBy(arrival, order).rowsBetween(Window.unboundedPreceding, 0)
    out = jobs.withColumn("_s", F.sum(service).over(w))
    out = out.withColumn("_m", F.max(F.col(arrival) - (F.col("_s") - F.col(service))).over(w))
    end = F.col("_s") + F.col("_m")
    return out.withColumns({"end_s": end, "begin_s": end - F.col(service), "wait_s": end - F.col(service) - F.col(arrival)}).drop("_s", "_m")


def timeline_issues(events: DataFrame, episode: str = "episode_id") -> DataFrame:
    """events: episode, step, arrival_s, next_interarrival_s: arrivals that aren't the first plus the running gaps (1e-9 relative or absolute). An episode may hold any share of the rows."""
    from pyspark.sql import Window

    from quillon.operators.audits import issues

    rows, carried = ordered.along_key(events, F.col(episode), F.col("step"), at=F.col("arrival_s"), gap=F.col("next_interarrival_s"))
    w = Window.partitionBy("part", "o0").orderBy("o1")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    e = ordered.with_carried(rows, carried)
    begin = F.when(F.col("n_before").isNull(), F.first("at").over(w.rowsBetween(Window.unboundedPreceding, 0))).otherwise(F.col("first_at"))
    gaps = F.coalesce("sum_gap", F.lit(0.0)) + F.coalesce(F.sum("gap").over(before), F.lit(0.0))
    e = e.withColumn("due", begin + gaps)
    far = F.abs(F.col("at") - F.col("due")) > F.greatest(1e-9 * F.greatest(F.abs("at"), F.abs("due")), F.lit(1e-9))
    return issues(e.where(far), "arrival_off_timeline", F.concat_ws(":", "o0", "o1"), F.col("at"))


def uniform(seed: int, stream: str, *keys: Column) -> Column:
    """A named random stream of our own: uniform [0, 1) from a hash of seed, stream and keys, the same in any order of rows."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(stream), *keys), 11) / float(1 << 53)
