"""Splitting a neuron's error over its inbound links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.activations import finite

PLANK = 1e-12
#: Links of a task, about: they are sorted there, which takes memory in proportion.
LINKS = 1_000_000


def dealt(links: DataFrame, neuron: str | list[str]) -> DataFrame:
    """links by neuron over as many partitions as their number asks for; where Spark's own are enough, as they are."""
    parts = -(-links.count() // LINKS)
    keys = [neuron] if isinstance(neuron, str) else neuron
    return links.repartition(parts, *keys) if parts > int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")) else links


def elastic_split(links: DataFrame, neuron: str | list[str], plank: float = PLANK) -> DataFrame:
    """links (neuron, ord, activation, safe, weight, error) with share.

    Shares follow activation squared times the safe factor; without any, weight squared; without that, they are equal.
    What rounding leaves goes to the link of the highest score, the first among equals.
    """
    return split_in_place(dealt(links, neuron), neuron, plank)


def split_in_place(links: DataFrame, neuron: str | list[str], plank: float = PLANK) -> DataFrame:
    """The same without counting the links first."""
    ok = lambda c: F.expr(finite(c))
    score = F.when(ok("activation") & ok("safe"), F.col("activation") * F.col("activation") * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("safe")))).otherwise(0.0)
    heavy = F.when(ok("weight"), F.col("weight") * F.col("weight")).otherwise(0.0)
    w = W.partitionBy(neuron)
    d = links.withColumns({"_s": score, "_h": heavy})
    d = d.withColumns({"_ds": F.sum("_s").over(w), "_dh": F.sum("_h").over(w), "_n": F.count(F.lit(1)).over(w)})
    by = F.when(F.col("_ds") > plank, F.col("_s")).when(F.col("_dh") > plank, F.col("_h")).otherwise(1.0)
    of = F.when(F.col("_ds") > plank, F.col("_ds")).when(F.col("_dh") > plank, F.col("_dh")).otherwise(F.col("_n").cast("double"))
    d = d.withColumns({"_by": by, "_share": F.when(ok("error"), F.col("error") * by / of).otherwise(0.0)})
    d = d.withColumns({"_left": F.col("error") - F.sum("_share").over(w), "_best": F.row_number().over(w.orderBy(F.col("_by").desc(), "ord"))})
    share = F.col("_share") + F.when((F.col("_best") == 1) & (F.abs("_left") > plank) & ok("error"), F.col("_left")).otherwise(0.0)
    return d.select(*links.columns, share.alias("share"))


def fused_split(links: DataFrame, neuron: str | list[str], error: Column, safe: Column, plank: float = PLANK) -> DataFrame:
    """links (neuron, ord, activation, weight) with error, safe and share: error and saturation first, then the split.

    An error of 0 has factors 1 and shares 0.
    """
    d = dealt(links, neuron).withColumn("error", error).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(neuron)))
    d = d.withColumn("per_link", F.col("error") / F.col("_n")).withColumn("safe", F.when(F.col("error") == 0, 1.0).otherwise(safe)).drop("_n")
    return split_in_place(d, neuron, plank).withColumn("share", F.when(F.col("error") == 0, 0.0).otherwise(F.col("share"))).drop("per_link")
