"""Checks and analyses of graph topologies, for many graphs at once.

edges: topology_id, pos, from_idx, to_idx (and role); nodes: topology_id, idx, constant, squash, bias; shapes: topology_id, n, ni
(inputs) and no (outputs). Results are (code, index) per topology; 0 is valid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.storage import discard, shared_path, stored

#: Codes of order checks and of structural checks.
SELF, BACKWARD, FROM_ORDER, TO_ORDER, DUPLICATE, UNEQUAL = 1, 2, 3, 4, 5, 6
INTO_INPUT, CONSTANT_FED, HIDDEN_UNFED, HIDDEN_UNUSED, BAD_BIAS, IF_FEW, IF_NO_CONDITION, IF_NO_POSITIVE, IF_NO_NEGATIVE, MALFORMED = range(1, 11)


def validate_order(edges: DataFrame) -> DataFrame:
    """topology_id, code and pos of the first edge that breaks the order from, to, forward only."""
    w = W.partitionBy("topology_id").orderBy("pos")
    before_from, before_to = F.lag("from_idx").over(w), F.lag("to_idx").over(w)
    same = before_from == F.col("from_idx")
    code = (
        F.when(F.col("from_idx") == F.col("to_idx"), SELF)
        .when(F.col("from_idx") > F.col("to_idx"), BACKWARD)
        .when(F.col("from_idx") < before_from, FROM_ORDER)
        .when(same & (F.col("to_idx") < before_to), TO_ORDER)
        .when(same & (F.col("to_idx") == before_to), DUPLICATE)
    )
    firsts = edges.withColumn("code", code).groupBy("topology_id").agg(F.min(F.when(F.col("code").isNotNull(), F.struct("pos", "code"))).alias("m"))
    return firsts.select("topology_id", F.coalesce("m.code", F.lit(0)).alias("code"), F.coalesce(F.col("m.pos"), F.lit(0)).alias("pos"))


def validate_lists(lists: DataFrame) -> DataFrame:
    """The same for rows (topology_id, from_list, to_list), place by place within a row, so that nothing is shuffled.

    Lists of unequal length, and null ones, have code 6 at 0; empty lists and those in order have code 0.
    """
    a, b = "from_list", "to_list"
    rule = (
        f"CASE WHEN {a}[i] = {b}[i] THEN {SELF} WHEN {a}[i] > {b}[i] THEN {BACKWARD} WHEN i = 0 THEN 0 WHEN {a}[i] < {a}[i - 1] THEN {FROM_ORDER} "
        f"WHEN {a}[i] > {a}[i - 1] THEN 0 WHEN {b}[i] < {b}[i - 1] THEN {TO_ORDER} WHEN {b}[i] = {b}[i - 1] THEN {DUPLICATE} ELSE 0 END"
    )
    codes = f"transform(slice(sequence(0, size({a})), 1, size({a})), i -> {rule})"
    first = f"element_at(transform(array({codes}), c -> named_struct('code', coalesce(get(filter(c, x -> x > 0), 0), 0), 'pos', greatest(array_position(transform(c, x -> x > 0), true) - 1, 0))), 1)"
    unequal = f"{a} IS NULL OR {b} IS NULL OR size({a}) <> size({b})"
    return lists.select("topology_id", F.expr(f"CASE WHEN {unequal} THEN named_struct('code', {UNEQUAL}, 'pos', 0L) ELSE {first} END").alias("m")).select("topology_id", "m.code", "m.pos")


def free_slots(nodes: DataFrame, shapes: DataFrame, edges: DataFrame) -> DataFrame:
    """topology_id, from_idx, to_idx of every forward pair into a neuron that is not constant and has no edge yet.

    Pairs are made by a range of sources per target, graph by graph, so no pair is made that the result could not hold.
    """
    targets = nodes.join(shapes, "topology_id").filter((F.col("idx") >= F.col("ni")) & ~F.col("constant") & (F.col("idx") > 0))
    pairs = targets.select("topology_id", F.explode(F.sequence(F.lit(0), F.col("idx") - 1)).alias("from_idx"), F.col("idx").alias("to_idx"))
    return pairs.join(edges.select("topology_id", "from_idx", "to_idx"), ["topology_id", "from_idx", "to_idx"], "left_anti")


def validate_structure(nodes: DataFrame, edges: DataFrame, shapes: DataFrame) -> DataFrame:
    """topology_id, code and idx of the first structural fault: edges into inputs first, then neurons in ascending order."""
    into = edges.join(shapes, "topology_id").filter("to_idx < ni").groupBy("topology_id").agg(F.min(F.struct("pos", "to_idx")).alias("e"))
    fed = edges.groupBy("topology_id", F.col("to_idx").alias("idx")).agg(F.count(F.lit(1)).alias("fed"), *(F.max((F.col("role").isin(*roles)).cast("int")).alias(name) for name, roles in (("cond", (1,)), ("pos_", (3, 0)), ("neg_", (2,)))))
    used = edges.groupBy("topology_id", F.col("from_idx").alias("idx")).agg(F.count(F.lit(1)).alias("used"))
    d = nodes.join(shapes, "topology_id").filter("idx >= ni").join(fed, ["topology_id", "idx"], "left").join(used, ["topology_id", "idx"], "left").fillna(0, ["fed", "used", "cond", "pos_", "neg_"])
    odd = F.isnan("bias") | (F.abs("bias") > 1.7976931348623157e308)
    hidden, if_ = F.col("idx") < F.col("n") - F.col("no"), F.col("squash") == "IF"
    code = (
        F.when(F.col("constant"), F.when(F.col("fed") > 0, CONSTANT_FED))
        .when(odd, BAD_BIAS)
        .when(hidden & (F.col("fed") == 0), HIDDEN_UNFED)
        .when(hidden & (F.col("used") == 0), HIDDEN_UNUSED)
        .when(if_ & (F.col("fed") < 3), IF_FEW)
        .when(if_ & (F.col("cond") == 0), IF_NO_CONDITION)
        .when(if_ & (F.col("pos_") == 0), IF_NO_POSITIVE)
        .when(if_ & (F.col("neg_") == 0), IF_NO_NEGATIVE)
    )
    worst = d.withColumn("code", code).filter("code IS NOT NULL").groupBy("topology_id").agg(F.min(F.struct("idx", "code")).alias("m"))
    out = shapes.join(into, "topology_id", "left").join(worst, "topology_id", "left")
    bad = (F.col("ni") > F.col("n")) | (F.col("no") > F.col("n")) | (F.col("ni") + F.col("no") > F.col("n"))
    return out.select(
        "topology_id",
        F.when(bad, MALFORMED).when(F.col("e").isNotNull(), INTO_INPUT).otherwise(F.coalesce("m.code", F.lit(0))).alias("code"),
        F.when(bad, 0).when(F.col("e").isNotNull(), F.col("e.to_idx")).otherwise(F.coalesce("m.idx", F.lit(0))).alias("idx"),
    )


def reverse_order(edges: DataFrame, shapes: DataFrame) -> DataFrame:
    """topology_id, place and idx: neurons so that each comes after all that it feeds, cycle members last in ascending order.

    First come those that feed nothing, ascending; then, as in a queue, each follows the last of those that it feeds, in the order of edges
    where several follow the same. A round places all neurons, of all graphs, whose targets have places: one for each level.
    """
    key = ["topology_id"]
    every = shapes.select("topology_id", F.explode(F.sequence(F.col("ni"), F.col("n") - 1)).alias("idx"), "n", "ni").filter("idx >= ni AND idx < n").select("topology_id", "idx")
    own = edges.filter("from_idx <> to_idx").groupBy("topology_id", F.col("from_idx").alias("idx"), F.col("to_idx").alias("to")).agg(F.max("pos").alias("pos"))
    own = stored(own.join(every, [*key, "idx"]).join(every.withColumnRenamed("idx", "to"), [*key, "to"]), "order-edges")
    rank = lambda *order: F.row_number().over(W.partitionBy("topology_id").orderBy(*order))
    placed = stored(every.join(own, [*key, "idx"], "left_anti").withColumn("place", rank("idx") - 1), "order")
    while True:
        waiting = own.join(placed.select("topology_id", "idx"), [*key, "idx"], "left_anti")
        last = waiting.join(placed.select("topology_id", F.col("idx").alias("to"), F.col("place").alias("after")), [*key, "to"], "left")
        ready = last.groupBy("topology_id", "idx").agg(F.bool_and(F.col("after").isNotNull()).alias("ready"), F.max(F.struct("after", "pos")).alias("after")).filter("ready")
        used = placed.groupBy("topology_id").agg(F.count(F.lit(1)).cast("int").alias("used"))
        new = ready.join(used, key, "left").select("topology_id", "idx", (F.coalesce("used", F.lit(0)) + rank("after") - 1).alias("place"))
        new = stored(new, "order-new")
        if not new.limit(1).count():
            discard(new)
            break
        both = stored(placed.unionByName(new), "order")
        discard(placed, new)
        placed = both
    used = placed.groupBy("topology_id").agg(F.count(F.lit(1)).cast("int").alias("used"))
    rest = every.join(placed.select("topology_id", "idx"), [*key, "idx"], "left_anti").join(used, key, "left").select("topology_id", "idx", (F.coalesce("used", F.lit(0)) + rank("idx") - 1).alias("place"))
    return placed.unionByName(rest).select("topology_id", F.col("place").cast("int").alias("place"), F.col("idx").cast("int").alias("idx"))


def levels(edges: DataFrame, shapes: DataFrame) -> DataFrame:
    """topology_id, idx and level: the longest way over forward edges from an input, or from a neuron that nothing feeds.

    Inputs are level 0 and left out. A round for each level moves neurons of all graphs.
    """
    from .population import neuron_levels

    neurons = shapes.select(F.col("topology_id").alias("net_id"), F.explode(F.sequence(F.col("ni"), F.col("n") - 1)).alias("idx"), "n", "ni").filter("idx >= ni AND idx < n").select("net_id", "idx", F.lit("hidden").alias("kind"))
    found = neuron_levels(neurons, edges.select(F.col("topology_id").alias("net_id"), "from_idx", "to_idx"))
    return found.select(F.col("net_id").alias("topology_id"), F.col("idx").cast("long").alias("idx"), F.col("level").cast("long").alias("level"))


def cycles(edges: DataFrame, shapes: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """topology_id and cyclic: whether neurons (not inputs) form a cycle; a self-loop is one.

    All graphs at once, in rounds. A graph whose nodes all have edges in and out has a cycle. Of the others, a round trims nodes
    from both ends and takes out nodes with so few edges that joining those before to those after makes no more of them (one
    edge on a side, or two on both), no two neighbours at a time; that keeps cycles and halves chains, so a chain needs
    rounds as the logarithm of its length. Dense deep graphs need a round for every two of their layers. rounds, if given, gets the edges left.
    """
    spark, key = shapes.sparkSession, ["topology_id"]
    inner = edges.join(shapes, "topology_id").filter("from_idx >= ni AND to_idx >= ni AND to_idx < n")
    e = stored(inner.select("topology_id", F.col("from_idx").alias("u"), F.col("to_idx").alias("v")).distinct(), "cycle-edges")
    found, turn = shared_path(spark, "cyclic"), 0
    spark.createDataFrame([], shapes.select("topology_id").schema).write.parquet(found)
    while n := e.count():
        if rounds is not None:
            rounds.append(n)
        ends = e.select("topology_id", F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("v").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
        degree = ends.groupBy("topology_id", "x.node").agg(F.sum("x.i").alias("i"), F.sum("x.o").alias("o"))
        rank = F.struct(F.xxhash64("topology_id", "node", F.lit(turn)), "node")
        nodes = stored(degree.select("topology_id", "node", ((F.col("i") == 0) | (F.col("o") == 0)).alias("end"), F.when(F.col("i") * F.col("o") <= F.col("i") + F.col("o"), rank).alias("rank")), "cycle-nodes")
        closed = nodes.groupBy("topology_id").agg(F.max("end").alias("end")).filter("NOT end").select("topology_id")
        closed.unionByName(e.filter("u = v").select("topology_id")).distinct().write.mode("append").parquet(found)
        open_ = e.join(spark.read.parquet(found), key, "left_anti")
        side = lambda at: nodes.select("topology_id", F.col("node").alias(at), F.col("end").alias(f"end_{at}"), F.col("rank").alias(f"rank_{at}"))
        kept = stored(open_.join(side("u"), [*key, "u"]).join(side("v"), [*key, "v"]).filter("NOT end_u AND NOT end_v"), "cycle-kept")
        lower = F.when(F.col("rank_u") < F.col("rank_v"), F.col("u")).otherwise(F.col("v"))
        beaten = kept.filter("rank_u IS NOT NULL AND rank_v IS NOT NULL").select("topology_id", lower.alias("node")).distinct()
        taken = stored(nodes.filter("rank IS NOT NULL AND NOT end").join(beaten, [*key, "node"], "left_anti").select("topology_id", "node"), "cycle-taken")
        as_ = lambda at: taken.withColumnRenamed("node", at)
        rest = kept.select("topology_id", "u", "v").join(as_("u"), [*key, "u"], "left_anti").join(as_("v"), [*key, "v"], "left_anti")
        before = kept.select("topology_id", "u", F.col("v").alias("node")).join(taken, [*key, "node"])
        after = kept.select("topology_id", F.col("u").alias("node"), "v")
        bridged = before.join(after, [*key, "node"]).select("topology_id", "u", "v")
        shorter = stored(rest.select("topology_id", "u", "v").unionByName(bridged).distinct(), "cycle-edges")
        discard(e, nodes, kept, taken)
        e, turn = shorter, turn + 1
    discard(e)
    return shapes.join(spark.read.parquet(found).distinct().withColumn("c", F.lit(1)), "topology_id", "left").select("topology_id", F.coalesce("c", F.lit(0)).alias("cyclic"))
