"""Approximate nearest neighbours by NN-descent: a neighbour graph from neighbours of neighbours, and greedy search on it.

Nearness is the inner product. Vectors that are equal are one node, and nodes get one more coordinate that makes all norms
equal, so that the neighbours of a node are near in angle as well. The first graph comes from runs of vectors in the order
of random sign codes. Each round samples the graph's edges in both directions, brings the vectors of a node's list
together by two joins, compares pairs of which one is new, and keeps the nearest few of each node. Rounds work on one
byte per coordinate; what a search returns is scored on the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, give_back, stored, table

#: Neighbours of a node; share of edges that a round samples; orders of sign codes, their bits, and vectors compared in a run.
NEIGHBOURS, SAMPLE, ORDERS, BITS, RUN = 40, 0.5, 8, 32, 1024
#: Tasks at most that compare runs; each reads its rows batch by batch.
TASKS = 20_000
#: Rounds at most, and the share of new edges below which they end.
ROUNDS, FEW = 12, 0.03
#: Nodes that a search keeps, and its rounds at most.
BEAM, STEPS = 128, 20
TOP, EVERY = 20, 20


def usable(rows: DataFrame) -> DataFrame:
    """id and v of rows that take part: v of finite components, not all 0, of the length that most rows have (of equals, the longest).

    Of rows that share an id, the one with the smallest vector stays.
    """
    v = F.col("v").cast("array<float>")
    good = F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) <= 3.4028234663852886e38)) & F.exists("v", lambda x: x != 0)
    kept = rows.select(F.col("id").cast("long").alias("id"), v.alias("v")).filter(good)
    length = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    return kept.filter(F.size("v") == (length["d"] if length else 0)).groupBy("id").agg(F.min("v").alias("v"))


def packed(v: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """One row of bytes for each vector: 4 for the further coordinate, 4 for the scale, and one for each coordinate."""
    scale = np.abs(v).max(1, keepdims=True).astype("<f4") / np.float32(127)
    small = np.rint(v / scale).astype(np.int8)
    return np.concatenate([extra.astype("<f4").reshape(-1, 1).view(np.uint8), scale.view(np.uint8), small.view(np.uint8)], 1)


def opened(raw: np.ndarray) -> np.ndarray:
    """The coordinates of packed rows, the further one last."""
    head = np.ascontiguousarray(raw[:, :8]).view("<f4")
    return np.concatenate([raw[:, 8:].view(np.int8) * head[:, 1:2], head[:, :1]], 1)


def matrix(column: pa.Array) -> np.ndarray:
    """The values of a binary column, all of one length, as rows of bytes."""
    raw = b"".join(x.as_py() for x in column)
    return np.frombuffer(raw, np.uint8).reshape(len(column), -1)


def binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    return pa.array([r.tobytes() for r in rows], pa.binary())


def nodes(vectors: DataFrame) -> DataFrame:
    """node and p, the packed vector, of rows (node, v): the further coordinate makes all squared norms the largest one."""
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    most = vectors.agg(F.max(norm)).head()[0] or 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                extra = np.sqrt(np.maximum(0, most - (v.astype(float) ** 2).sum(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), binary(packed(v, extra))], names=["node", "p"])

    return vectors.select("node", "v").mapInArrow(run, "node long, p binary")


def of_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that rows of one first column, which follow one another, stay together."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1])) if (np.diff(keys) >= 0).all() else 0
        if cut or (rest and rest[-1].column(0)[-1].as_py() != keys[0]):
            whole = pa.Table.from_batches([*rest, batch.slice(0, cut)]).combine_chunks().to_batches()
            yield from (b for b in whole if b.num_rows)
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield from pa.Table.from_batches(rest).combine_chunks().to_batches()


def edges_of(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2].astype(np.float32))], names=["node", "other", "score"])


EDGES = "node long, other long, score float"


def kept_edges(found: DataFrame, neighbours: int) -> DataFrame:
    """The nearest few of each node; of repeated edges one, which is fresh only if all are."""
    one = found.repartition("node").groupBy("node", "other").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))
    place = F.row_number().over(W.partitionBy("node").orderBy(F.desc("score"), "other"))
    return one.withColumn("_place", place).filter(F.col("_place") <= neighbours).drop("_place")


def first_edges(points: DataFrame, neighbours: int, orders: int = ORDERS, run_length: int = RUN, seed: int = 7) -> DataFrame:
    """Edges between vectors that are near in one of several orders of random sign codes."""
    each = -(-neighbours // 2)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = matrix(batch.column(1))
                planes = np.random.default_rng(seed).standard_normal((raw.shape[1] - 7, orders * BITS)).astype(np.float32)
                signs = (opened(raw) @ planes > 0).reshape(-1, orders, BITS) @ (1 << np.arange(BITS, dtype=np.int64)[::-1])
                for k in range(orders):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(raw), k, np.int32)), pa.array(signs[:, k]), *batch.columns], names=["at", "code", "node", "p"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ids = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            cuts = sorted({*range(0, len(at), run_length), *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)})
            for a, b in zip(cuts, cuts[1:], strict=False):
                x, who, k = opened(matrix(batch.column(3).slice(a, b - a))), ids[a:b], min(each, b - a - 1)
                if k > 0:
                    score = x @ x.T
                    np.fill_diagonal(score, -np.inf)
                    top = np.argpartition(-score, k - 1, axis=1)[:, :k]
                    yield edges_of([(np.repeat(who, k), who[top].ravel(), np.take_along_axis(score, top, 1).ravel())])
        give_back()

    dealt = points.select("node", "p").mapInArrow(codes, "at int, code long, node long, p binary")
    tasks = min(TASKS, max(1, points.count() * orders // (16 * run_length)))  # a task has many runs, and few are cut short
    ordered = dealt.repartitionByRange(tasks, "at", "code", "node").sortWithinPartitions("at", "code", "node")
    return kept_edges(ordered.mapInArrow(runs, EDGES).withColumn("fresh", F.lit(True)), neighbours)


def picked(turn: int, share: float) -> Column:
    """Whether a round samples an edge: a function of the edge and the round alone, so both readers agree."""
    return F.pmod(F.xxhash64("node", "other", F.lit(turn)), F.lit(1_000_000)) < int(share * 1_000_000)


def neighbours_of_neighbours(edges: DataFrame, points: DataFrame, neighbours: int, share: float, turn: int) -> DataFrame:
    """Pairs in the sampled lists of a node, one of them new there, that are nearer than what one of them has.

    A node's list holds its own sampled edges and as many sampled edges to it at most, new ones first: this is NN-descent's
    sample, which bounds the work of nodes that many others are near to.
    """
    own = edges.filter(picked(turn, share)).select("node", "other", "fresh")
    back = own.select(F.col("other").alias("node"), F.col("node").alias("other"), "fresh")
    order = W.partitionBy("node").orderBy(F.desc("fresh"), F.xxhash64("node", "other", F.lit(turn)))
    back = back.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= int(2 * share * neighbours)).drop("_place")
    worst = edges.groupBy("node").agg(F.when(F.count(F.lit(1)) >= neighbours, F.min("score")).otherwise(float("-inf")).alias("worst"))
    known = points.join(worst, "node").withColumnRenamed("node", "other")
    lists = own.unionByName(back).join(known, "other").select("node", "other", "fresh", "worst", "p")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in of_keys(batches):
            keys, other = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fresh, least, x = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(), opened(matrix(batch.column(4)))
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            out, held = [], 0
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
                f, who = fresh[a:b], other[a:b]
                if not f.any():
                    continue
                score = x[a:b] @ x[a:b].T
                i, j = np.nonzero((score > least[a:b, None]) & (f[:, None] | f) & (who[:, None] != who))
                if len(i):
                    out.append((who[i], who[j], score[i, j]))
                    held += len(i)
                if held > 200_000:
                    yield edges_of(out)
                    out, held = [], 0
            if out:
                yield edges_of(out)
        give_back()

    return lists.repartition("node").sortWithinPartitions("node").mapInArrow(pairs, EDGES)


def graph(points: DataFrame, neighbours: int = NEIGHBOURS, share: float = SAMPLE, rounds: int = ROUNDS, few: float = FEW, **first) -> DataFrame:
    """node, other, score and fresh of the neighbour graph of points (node, p), which must be stored."""
    edges = stored(first_edges(points, neighbours, **first), "edges")
    for turn in range(rounds):
        found = neighbours_of_neighbours(edges, points, neighbours, share, turn).withColumn("fresh", F.lit(True))
        old = edges.withColumn("fresh", F.col("fresh") & ~picked(turn, share))
        better = stored(kept_edges(old.unionByName(found), neighbours), "edges")
        discard(edges)
        edges = better
        new, total = edges.agg(F.count_if("fresh"), F.count(F.lit(1))).head()
        if new <= few * total:
            break
    return edges


def adjacency(edges: DataFrame, points: DataFrame) -> DataFrame:
    """node with the ids and the packed vectors of its neighbours, one after another."""
    rows = edges.select("node", "other").join(points.withColumnRenamed("node", "other"), "other").select("node", "other", "p")

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in of_keys(batches):
            keys, other, raw = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2))
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            cuts = list(zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True))
            columns = [pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (other, raw)]
            yield pa.RecordBatch.from_arrays([pa.array(keys[starts]), *columns], names=["node", "others", "near"])

    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(lists, "node long, others binary, near binary")


def searched(queries: DataFrame, near: DataFrame, beam: int = BEAM, steps: int = STEPS) -> DataFrame:
    """query and node of the nodes that greedy search keeps for queries (query, q, a packed vector; node, where it starts).

    All nodes of a query's beam whose neighbours were not looked at yet are opened together, until there are none.
    """
    vectors = stored(queries.select("query", "q"), "queries")
    kept = stored(queries.select("query", "node", F.lit(float("inf")).cast("float").alias("score"), F.lit(False).alias("opened"), F.lit(float("-inf")).cast("float").alias("least")), "beam")

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for query, least, q, others, close in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                who = np.frombuffer(others, np.int64)
                x = opened(np.frombuffer(close, np.uint8).reshape(len(who), -1))[:, :-1]
                score = x @ opened(np.frombuffer(q, np.uint8).reshape(1, -1))[0, :-1]
                good = np.flatnonzero(score > least)
                out.append((np.full(len(good), query), who[good], score[good]))
            if out:
                yield edges_of(out).rename_columns(["query", "node", "score"])

    for _ in range(steps):
        open_now = kept.filter("NOT opened").select("query", "node", "least")
        found = open_now.join(near, "node").join(vectors, "query").select("query", "least", "q", "others", "near").mapInArrow(scores, "query long, node long, score float")
        all_ = kept.select("query", "node", "score", F.lit(True).alias("opened")).unionByName(found.withColumn("opened", F.lit(False)))
        one = all_.repartition("query").groupBy("query", "node").agg(F.max("score").alias("score"), F.max("opened").alias("opened"))
        ordered = W.partitionBy("query").orderBy(F.desc("score"), "node")
        best = one.withColumn("_place", F.row_number().over(ordered)).filter(F.col("_place") <= beam)
        full = F.count(F.lit(1)).over(W.partitionBy("query")) >= beam
        least = F.when(full, F.min("score").over(W.partitionBy("query"))).otherwise(F.lit(float("-inf")).cast("float"))
        after = stored(best.withColumn("least", least).drop("_place"), "beam")
        discard(kept)
        kept = after
        if not kept.filter("NOT opened").head(1):
            break
    discard(vectors)
    return kept.select("query", "node")


def inner(a: str, b: str) -> Column:
    """The inner product in double precision, from the first coordinate to the last."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(rows: DataFrame, is_query: Callable[[Column], Column], top: int = TOP, neighbours: int = NEIGHBOURS, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id and score: of each query's row the nearest others found, among all rows (id, v) that take part.

    Of equal vectors, the top + 1 smallest ids can be in an answer, and only they are looked at.
    """
    known = stored(usable(rows), "vectors")
    classes = stored(known.groupBy("v").agg(F.min("id").alias("node")), "classes")
    member = stored(known.join(classes, "v").select("node", "id"), "members")
    points = stored(nodes(classes), "points")
    edges = graph(points, neighbours)
    near = stored(adjacency(edges, points), "near")
    discard(edges)
    asked = member.filter(is_query(F.col("id"))).select(F.col("id").alias("query"), "node")
    found = searched(asked.join(points, "node").select("query", F.col("p").alias("q"), "node"), near, beam)
    discard(near, points)
    first = W.partitionBy("node").orderBy("id")
    few = member.withColumn("_place", F.row_number().over(first)).filter(F.col("_place") <= top + 1).drop("_place")
    own = asked.join(classes, "node").select("query", F.col("v").alias("q"))
    scored = found.join(own, "query").join(classes, "node").select("query", "node", inner("q", "v").alias("score"))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))
    answers = scored.join(few, "node").filter(F.col("id") != F.col("query")).withColumn("rank", rank).filter(F.col("rank") <= top)
    return answers.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def op11_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every row whose vec_id is divisible by 20.

    Rows with a null id, and vectors that are null, empty, zero, hold a null or non-finite component or differ in length from most,
    take no part. Of rows that share a vec_id one takes part, that with the smallest vector. Equal vectors score equally and
    go by vec_id. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return nearest(rows, lambda c: c % EVERY == 0)


ORACLE: dict[str, str] = {}
