"""Many networks over many records, in one job: graphs are rows, and evaluation is one expression over them.

A graph's row holds its levels, each an array of neurons with their inbound links as parallel arrays, worked out from the
tables of neurons and synapses by grouping; no driver-side network takes part. Records meet their graph by a join on its id;
all of a record's levels are then evaluated within its row, so there is one shuffle, however deep the graphs are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.activations import ALIASES, CODES, by_code, forward_sql, limit_sql
from ..plans.storage import discard, stored
from .network import CONDITION, NEGATIVE

#: Levels of a graph at most; a graph with more is an error.
MAX_LEVELS = 65_536


def neuron_levels(neurons: DataFrame, synapses: DataFrame) -> DataFrame:
    """net_id, idx and level: the longest way over forward edges from an input, or 1 where nothing feeds a neuron.

    A round moves every neuron beyond what feeds it, for all graphs at once, until none moves: as many rounds as the deepest has levels.
    """
    neurons = neurons.select("net_id", "idx", (F.col("kind") == "constant").alias("constant"))
    links = synapses.filter("from_idx < to_idx").select("net_id", "from_idx", F.col("to_idx").alias("idx")).distinct().join(neurons.filter("NOT constant").select("net_id", "idx"), ["net_id", "idx"])
    inner = stored(links.join(neurons.select("net_id", F.col("idx").alias("from_idx")), ["net_id", "from_idx"]), "inner")
    at, moved = stored(neurons.select("net_id", "idx", F.lit(1).alias("level")), "levels"), 1
    for _ in range(MAX_LEVELS):
        if not moved:
            break
        after = inner.join(at.withColumnRenamed("idx", "from_idx"), ["net_id", "from_idx"]).groupBy("net_id", "idx").agg((F.max("level") + 1).alias("_next"))
        new = at.join(after, ["net_id", "idx"], "left").select("net_id", "idx", F.greatest("level", F.coalesce("_next", F.lit(0))).alias("level"), (F.coalesce("_next", F.lit(0)) > F.col("level")).alias("_moved"))
        new = stored(new, "levels")
        moved = new.filter("_moved").limit(1).count()
        discard(at)
        at = new
    discard(inner)
    return at.select("net_id", "idx", "level")


def graph_rows(neurons: DataFrame, synapses: DataFrame, shapes: DataFrame) -> DataFrame:
    """net_id, ni, no and levels of every graph of shapes (net_id, ni, no).

    neurons: net_id, idx, kind, bias, squash; synapses: net_id, ord, from_idx, to_idx, weight, role. Values are numbered in the order in
    which they are worked out, inputs first, and links are by these numbers; links that read what comes later count as 0.
    """
    codes = F.create_map(*(F.lit(x) for name, k in ALIASES.items() for x in (name, k)))
    level = neuron_levels(neurons, synapses)
    from pyspark.sql import Window as W

    known = neurons.join(level, ["net_id", "idx"]).join(shapes.select("net_id", "ni"), "net_id")
    known = known.withColumn("place", F.col("ni") + F.row_number().over(W.partitionBy("net_id").orderBy("level", "idx")) - 1)
    known = stored(known.select("net_id", "idx", "level", "place", "bias", (F.col("kind") == "constant").alias("constant"), F.coalesce(codes[F.col("squash")], F.lit(0)).alias("code")), "places")
    source = known.select("net_id", F.col("idx").alias("from_idx"), "place")
    links = synapses.join(source, ["net_id", "from_idx"], "left").withColumn("ok", F.col("from_idx") < F.col("to_idx"))
    link = F.struct("ord", F.when(F.col("ok"), F.coalesce("place", "from_idx")).otherwise(0).cast("int").alias("src"), F.when(F.col("ok"), F.col("weight")).otherwise(0.0).alias("w"), F.col("role").cast("int").alias("role"))
    into = links.groupBy("net_id", F.col("to_idx").alias("idx")).agg(F.array_sort(F.collect_list(link)).alias("links"))
    none = F.array().cast("array<struct<ord:int,src:int,w:double,role:int>>")
    full = known.join(into, ["net_id", "idx"], "left").withColumn("links", F.when(F.col("constant"), none).otherwise(F.coalesce("links", none)))
    pick = lambda name: F.transform("links", lambda x: x[name])
    neuron = F.struct("place", "bias", F.when(F.col("constant"), -1).otherwise(F.col("code")).alias("code"), pick("src").alias("src"), pick("w").alias("w"), pick("role").alias("role"), "idx")
    layers = full.groupBy("net_id", "level").agg(F.array_sort(F.collect_list(neuron)).alias("own"))
    rows = layers.groupBy("net_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "own"))), lambda x: x["own"]).alias("levels"))
    empty = F.array().cast("array<array<struct<place:int,bias:double,code:int,src:array<int>,w:array<double>,role:array<int>,idx:int>>>")
    return shapes.join(rows, "net_id", "left").select("net_id", "ni", "no", F.coalesce("levels", empty).alias("levels"))


def _sum(xs: str) -> str:
    return f"aggregate({xs}, 0D, (a, b) -> a + b)"


def neuron_value(n: str, values: str) -> str:
    """The value of a neuron n of a level over the values so far."""
    v = f"transform({n}.src, (s, i) -> {n}.w[i] * {values}[s])"
    some = lambda test: _sum(f"transform(v, (x, i) -> CASE WHEN {test} THEN x ELSE 0D END)")
    raw = {
        "MINIMUM": f"coalesce(array_min(v), 0D) + {n}.bias",
        "MAXIMUM": f"coalesce(array_max(v), 0D) + {n}.bias",
        "IF": f"CASE WHEN {some(f'{n}.role[i] = {CONDITION}')} > 0D THEN {some(f'{n}.role[i] NOT IN ({CONDITION}, {NEGATIVE})')} ELSE {some(f'{n}.role[i] = {NEGATIVE}')} END + {n}.bias",
        "HYPOT": f"sqrt({_sum('transform(v, x -> x * x)')}) + {n}.bias",
        "HYPOTv2": f"sqrt({_sum(f'transform(v, x -> (x + {n}.bias) * (x + {n}.bias))')})",
        "MEAN": f"CASE WHEN size(v) = 0 THEN 0D ELSE {_sum('v')} / size(v) END + {n}.bias",
    }
    special = " ".join(f"WHEN {CODES[name]} THEN {e}" for name, e in raw.items())
    before = f"element_at(transform(array({v}), v -> CASE {n}.code WHEN -1 THEN {n}.bias {special} ELSE {n}.bias + {_sum('v')} END), 1)"
    plain = {name for name in CODES if name not in raw}
    after = f"CASE WHEN {n}.code IN ({', '.join(str(CODES[name]) for name in raw)}, -1) THEN x ELSE {by_code(f'{n}.code', lambda name: forward_sql(name, 'x'), plain)} END"
    limited = by_code(f"greatest({n}.code, 0)", lambda name: limit_sql(name, "y"))
    return f"element_at(transform(transform(array({before}), x -> {after}), y -> {limited}), 1)"


def scored(records: DataFrame, graphs: DataFrame, inputs: str, output: str = "outputs", salts: int = 16) -> DataFrame:
    """records (net_id and more) with an array of their graph's outputs; records of no graph are left out.

    Records are dealt by graph and a hash, and each graph goes to as many places, so that one graph's many records go to many tasks.
    Missing inputs are 0, those beyond a graph's are left out.
    """
    level = f"concat(vals, transform(l, n -> {neuron_value('n', 'vals')}))"
    first = f"transform(sequence(1, ni), i -> coalesce(CAST(try_element_at({inputs}, i) AS DOUBLE), 0D))"
    vals = f"aggregate(levels, CASE WHEN ni = 0 THEN CAST(array() AS ARRAY<DOUBLE>) ELSE {first} END, (vals, l) -> {level})"
    last = "transform(array_sort(filter(flatten(levels), n -> n.idx >= ni + size(flatten(levels)) - no), (p, q) -> p.idx - q.idx), n -> vals[n.place])"
    dealt = records.withColumn("_salt", F.pmod(F.xxhash64(*(c for c in records.columns if c != inputs)), F.lit(salts)).cast("int"))
    copies = graphs.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = dealt.join(copies, ["net_id", "_salt"])
    out = F.expr(f"element_at(transform(array({vals}), vals -> {last}), 1)")
    return met.select(*records.columns, out.alias(output))
