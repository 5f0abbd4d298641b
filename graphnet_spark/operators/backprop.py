"""Backward passes over a network for many records, and the accumulator sums that they leave.

Neurons are walked level by level, from the outputs down: each level takes what the levels above ask of it, splits its error
over its links, and asks its sources in turn. Every step is a join with the broadcast graph and an aggregate by record and
neuron; levels are written, so that none is worked out twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.activations import ACTIVATIONS, ALIASES, any_error_sql, any_inverse_sql, by_code, safe_sql
from ..plans.storage import stored
from .accumulate import BIAS_SUMS, WEIGHT_SUMS, bias_deltas, summed, weight_deltas
from .distribution import PLANK, split_in_place
from .forward import traced
from .network import Network

#: Kinds of neurons whose targets are left to the caller.
SPECIAL = ("IF", "MAXIMUM", "MINIMUM")
#: What becomes of a neuron that is asked for something.
SAME, DEFERRED, CHANGED = "no change", "special", "standard"


def bounds(code: str, side: str) -> Column:
    return F.expr(by_code(code, lambda n: f"CAST({getattr(ACTIVATIONS[ALIASES[n]], side)} AS DOUBLE)"))


def graph(net: Network, level: list[int], spark) -> tuple[DataFrame, DataFrame]:
    """The neurons of a level (idx, code, bias, n links), and the links into them with what is known of their sources."""
    code = lambda i: 0 if i < net.inputs or net.neurons[i - net.inputs].constant else ALIASES[net.neurons[i - net.inputs].squash]
    inner = lambda i: i >= net.inputs and not net.neurons[i - net.inputs].constant
    here = set(level)
    links = [(k, a, b, float(w), a >= b, code(a), inner(a)) for k, (a, b, w, _) in enumerate(net.edges) if b in here]
    nodes = [(i, code(i), float(net.neurons[i - net.inputs].bias)) for i in level if inner(i)]
    return (
        spark.createDataFrame(nodes, "idx int, code int, bias double"),
        spark.createDataFrame(links, "ord int, from_idx int, idx int, weight double, blocked boolean, from_code int, inner boolean"),
    )


def propagate(net: Network, records: DataFrame, key: str, inputs: str, targets: str, plank: float = 1e-7, normalise: bool = True) -> tuple[DataFrame, DataFrame]:
    """One backward pass for every record: the sums, and the outcomes (key, idx, target, status).

    sums has kind (edge or neuron), id and the seven sums; of neurons the first three are count, total and adjusted bias.
    A neuron is asked for its value plus the sum of the changes, divided by the root of their number if there are several
    and normalise is set, within its range. Changes below plank pass nothing on; IF, MAXIMUM and MINIMUM are left to the
    caller. The error is split over the links by activation and safe zone of their sources, or by activation alone where no
    link is safe; links from nodes that are not evaluated before (and self-loops) get none. A weight within plank of 0 counts
    as plank, so that its source can be asked at all; a source beyond its safe zone is not asked.
    """
    spark, p = records.sparkSession, f"{plank!r}D"
    values = stored(traced(net, records, key, inputs).select(F.col(key), "idx", "value", "hint"))
    first = net.size - net.outputs
    wanted = records.select(key, F.posexplode(F.slice(F.col(targets).cast("array<double>"), 1, net.outputs)).alias("pos", "t")).select(key, (F.col("pos") + first).alias("idx"), "t")
    asked = values.join(wanted, [key, "idx"]).select(key, "idx", (F.col("t") - F.col("value")).alias("delta"))
    changes, outcomes = [], []
    for level in reversed(net.levels()):
        nodes, links = graph(net, level, spark)
        total = F.sum("delta") / (F.sqrt(F.count(F.lit(1))) if normalise else F.lit(1.0))
        here = asked.join(F.broadcast(nodes), "idx").groupBy(key, "idx").agg(total.alias("total"), F.first("code").alias("code"), F.first("bias").alias("bias"))
        here = here.join(values, [key, "idx"])
        names = {net.neurons[i - net.inputs].squash for i in level}
        target = F.greatest(bounds("code", "low"), F.least(bounds("code", "high"), F.col("value") + F.col("total")))
        special = F.col("code").isin(*(ALIASES[n] for n in SPECIAL))
        here = here.withColumn("target", target)
        here = here.withColumn("status", F.when(F.abs(F.col("target") - F.col("value")) < plank, SAME).when(special, DEFERRED).otherwise(CHANGED))
        here = here.withColumn("error", F.expr(by_code("code", lambda n: any_error_sql(n, "value", "target", "hint"), names)))
        here = stored(here)
        outcomes.append(here.select(key, "idx", "target", "status"))
        live = here.filter(F.col("status") == CHANGED)
        source = values.select(F.col(key), F.col("idx").alias("from_idx"), F.col("value").alias("_act"), F.col("hint").alias("_hint"))
        rows = live.select(key, "idx", "error").join(F.broadcast(links), "idx").join(source, [key, "from_idx"])
        rows = rows.withColumns({"activation": F.when(F.col("blocked"), 0.0).otherwise(F.col("_act")), "weight": F.when(F.col("blocked"), 0.0).otherwise(F.col("weight")), "from_hint": F.when(F.col("inner"), F.col("_hint")).otherwise(0.0)})
        changes.append(stored(split(rows, key, plank)))
        links_ = changes[-1]
        effective = F.when(F.abs("weight") > plank, F.col("weight")).otherwise(F.when(F.col("weight") < 0, -plank).otherwise(plank))
        goal = F.greatest(bounds("from_code", "low"), F.least(bounds("from_code", "high"), F.col("goal") / effective))
        up = links_.filter(F.col("inner") & ~F.col("blocked") & (F.abs("share") > plank) & (F.col("safe") > 0)).select(key, F.col("from_idx").alias("idx"), (goal - F.col("activation")).alias("delta"))
        asked = asked.unionByName(up)
        usable = F.when(~F.col("blocked") & (F.abs("activation") > plank), F.col("activation") * F.col("weight"))
        pulled = links_.groupBy(key, "idx").agg(F.sum(usable).alias("pulled"))
        moved = live.join(pulled, [key, "idx"], "left").withColumn("improved", F.col("bias") + F.coalesce("pulled", F.lit(0.0)))
        moved = moved.withColumn("goal", F.expr(by_code("code", lambda n: any_inverse_sql(n, "target", "hint"), names)))
        neuron = summed(moved.select("idx", *bias_deltas("goal", "improved", "bias")), ["idx"], BIAS_SUMS)
        filler = [F.lit(0.0).alias(n) for n in WEIGHT_SUMS[3:]]
        outcomes[-1] = (outcomes[-1], neuron.select(F.lit("neuron").alias("kind"), F.col("idx").alias("id"), *(F.col(a).alias(b) for a, b in zip(BIAS_SUMS, WEIGHT_SUMS, strict=False)), *filler))
    sums, status = None, None
    for (state, neuron), links_ in zip(outcomes, changes, strict=True):
        items = links_.filter(f"NOT blocked AND abs(activation) > {p}").select("ord", *weight_deltas("weight", "goal", "activation", plank))
        both = neuron.unionByName(summed(items, ["ord"], WEIGHT_SUMS).select(F.lit("edge").alias("kind"), F.col("ord").alias("id"), *WEIGHT_SUMS))
        sums, status = (both, state) if sums is None else (sums.unionByName(both), status.unionByName(state))
    return sums, status


def split(rows: DataFrame, key: str, plank: float) -> DataFrame:
    """rows (links of neurons with error, activation, weight, from_code, from_hint, blocked) with safe, share and goal."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key, "idx")
    rows = rows.withColumn("per_link", F.col("error") / F.count(F.lit(1)).over(w))
    factor = F.expr(by_code("from_code", lambda n: safe_sql(n, "from_hint", "per_link", "weight")))
    rows = rows.withColumn("safe_zone", F.when(F.col("blocked"), 0.0).when(F.col("error") == 0, 1.0).otherwise(factor))
    some = F.max(F.col("safe_zone") > plank).over(w)
    rows = rows.withColumn("safe", F.when(some, F.col("safe_zone")).otherwise(1.0))
    out = split_in_place(rows, [key, "idx"], PLANK).withColumn("share", F.when(F.col("error") == 0, 0.0).otherwise(F.col("share")))
    return out.withColumns({"safe": F.col("safe_zone"), "goal": F.col("weight") * F.col("activation") + F.col("share")}).drop("safe_zone", "_act", "_hint")


def backward(net: Network, records: DataFrame, key: str, inputs: str, targets: str, plank: float = 1e-7) -> DataFrame:
    """kind, id and the sums over all records."""
    return propagate(net, records, key, inputs, targets, plank)[0]
