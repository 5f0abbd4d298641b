"""Diagrams and topology documents of networks, as ordered text rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dot_lines(neurons: DataFrame, synapses: DataFrame, inputs: int) -> DataFrame:
    """part, place and line of a DOT diagram: head, nodes in order, edges in order, tail."""
    spark = neurons.sparkSession
    head = spark.createDataFrame([(0, 0, "digraph {"), (0, 1, "  rankdir=LR;"), (3, 0, "}")], "part INT, place INT, line STRING")
    given = spark.range(inputs).select(F.lit(1).alias("part"), F.col("id").cast("int").alias("place"), F.format_string('  n%d [label="%d input"];', "id", "id").alias("line"))
    nodes = neurons.select(F.lit(1).alias("part"), F.col("idx").alias("place"), F.format_string('  n%d [label="%d %s %s %.6f"];', "idx", "idx", "kind", "squash", "bias").alias("line"))
    edges = synapses.select(F.lit(2).alias("part"), F.col("ord").alias("place"), F.format_string('  n%d -> n%d [label="%.6f"];', "from_idx", "to_idx", "weight").alias("line"))
    return head.unionByName(given).unionByName(nodes).unionByName(edges)


def topology_json(neurons: DataFrame, synapses: DataFrame, inputs: int, outputs: int, pretty: bool = False) -> DataFrame:
    """One row with the topology as JSON: counts, nodes and edges in order."""
    n = neurons.agg(F.sort_array(F.collect_list(F.struct("idx", "kind", "squash", "bias"))).alias("nodes"))
    e = synapses.agg(F.sort_array(F.collect_list(F.struct("ord", "from_idx", "to_idx", "weight", "role"))).alias("edges"))
    doc = F.struct(F.lit(inputs).alias("num_inputs"), F.lit(outputs).alias("num_outputs"), "nodes", "edges")
    return n.join(e).select(F.to_json(doc, {"pretty": "true"} if pretty else {}).alias("json"))
