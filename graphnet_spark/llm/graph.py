"""Connected components of links between rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(links: DataFrame) -> DataFrame:
    """node and label (the smallest node of its component) for every node of links (a, b).

    Each round takes the smallest label among the neighbours and then the label's own label, so a label travels twice as far in
    each round. Rounds are written to the shared folder, and both sides of each join are read from there, so that the rows of
    a hub or of a large component are split among tasks; minima are combined before they are shuffled.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(both.filter("a <> b").distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("low"))
        new = stored(labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "low").alias("step")), "steps")
        if not new.filter("step <> label").limit(1).count():
            discard(edges, new)
            return labels
        of = new.select(F.col("node").alias("_node"), F.col("step").alias("_step"))
        after = stored(new.join(of, F.col("step") == F.col("_node")).select("node", F.least("step", "_step").alias("label")), "labels")
        discard(labels, new)
        labels = after


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after more links (a, b): only the links between components, as far as they are known, are worked on."""
    of = lambda name: F.coalesce(f"_{name}.label", name)
    side = lambda name: labels.alias(f"_{name}")
    on = lambda name: F.col(name) == F.col(f"_{name}.node")
    between = links.join(side("a"), on("a"), "left").join(side("b"), on("b"), "left").select(of("a").alias("a"), of("b").alias("b")).filter("a <> b")
    tops = components(between)
    known = labels.unionByName(tops.select("node", F.col("node").alias("label")).join(labels.select("node"), "node", "left_anti"))
    top = tops.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    out = stored(known.join(top, F.col("label") == F.col("_node"), "left").select("node", F.coalesce("_label", "label").alias("label")), "labels")
    discard(tops, labels)
    return out
