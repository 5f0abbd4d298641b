"""Mixing sources to target weights.

Sizes are summed per source; each source's target is its weighted share of all words, at most `most` times its own
size, what is over being shared among the others by weight. The repetition rate is target / size: every document is
emitted floor(rate) times, and once more where a draw seeded by its hash falls below the fraction. Several seeds are
tried at once in the same aggregation and each source takes the one whose words come nearest to its target; a draw
under any one seed is a Bernoulli draw with the fraction as its probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, stored, table

#: Repetition limit, seeds tried per source, and the salts that a source's rows are spread over in joins.
MOST, SEEDS, SALTS = 3, 16, 32


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: Column) -> Column:
    """A number in [0, 1) from bits 1 to 40 of an md5 of the document, turned by a golden step for each seed."""
    return (draw_bits(doc_id) + seed * F.lit(679891637639)) % F.lit(1 << 40) / F.lit(float(1 << 40))


def draw_bits(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("-"))), 1, 10), 16, 10).cast("long")


def source_targets(sized: DataFrame, most: int = MOST) -> DataFrame:
    """source, source_size, weight and target, one row per source. sized has source and size.

    Sources by code point, null last, weigh 1, 2, 3 in turn. With the sources in order of most * size / weight, the
    capped ones are a prefix of that order, so the share of the others follows from running sums. This table has one row
    a source, not one a document.
    """
    every = W.partitionBy(F.lit(0))
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("weight", ((F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("long"))
    s = s.withColumn("room", F.lit(most) * F.col("source_size") / F.col("weight"))
    before = every.orderBy("room", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("left", F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    s = s.withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # the first source in this order whose room is not below the share of what is left sets the level
    s = s.withColumn("level", F.min(F.when(F.col("room") >= F.col("left") / F.col("open"), F.struct("room", F.col("left") / F.col("open")))).over(every)["col2"])
    target = F.when(F.col("room") <= F.col("level"), (most * F.col("source_size")).cast("double")).otherwise(F.col("level") * F.col("weight"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, size: Column | None = None, most: int = MOST, seeds: int = SEEDS) -> DataFrame:
    """Each row of docs with size, source_size, target and copies, the number of times that the mix takes it."""
    extra = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    sized = docs.select(*extra, (words(F.col("text")) if size is None else size).alias("size"))
    small = stored(sized.select("doc_id", "source", "size"), "mix-sizes")
    targets = stored(source_targets(small, most), "mix-targets")
    rated = with_source(small, targets)
    base, part = F.floor("rate"), F.col("rate") - F.floor("rate")
    taken = [F.sum(F.when(draw(F.col("doc_id"), F.lit(k)) < part, F.col("size")).otherwise(0)).alias(f"extra{k}") for k in range(seeds)]
    tried = rated.withColumn("rate", rate()).groupBy("source", "source_size", "target").agg(F.max(base * F.col("source_size")).alias("whole"), *taken)
    gaps = F.array(*(F.struct(F.abs(F.col("whole") + F.col(f"extra{k}") - F.col("target")).alias("gap"), F.lit(k).alias("seed")) for k in range(seeds)))
    chosen = stored(tried.select("source", "source_size", "target", F.array_min(gaps)["seed"].alias("seed")), "mix-seeds")
    out = with_source(sized, chosen).withColumn("rate", rate())
    copies = base + F.when(draw(F.col("doc_id"), F.col("seed")) < part, 1).otherwise(0)
    return out.select(*extra, "size", "source_size", "target", copies.cast("int").alias("copies"))


def rate() -> Column:
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))


def with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Joins rows to one row per source. Both sides are salted, so that a hot source's rows are spread."""
    right = sources.withColumnRenamed("source", "_source").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return left.join(right, F.col("source").eqNullSafe(F.col("_source")) & (left["_salt"] == right["_salt"])).drop(left["_salt"]).drop(right["_salt"]).drop("_source")


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row as often as copies says."""
    return mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).drop("_copy", "copies", "size", "source_size", "target")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document.

    A null text has size 0, null sources form one source, and a source of size 0 has target 0. Rows with equal doc_id
    share their draw, so repeated rows are taken equally often. An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mix(docs.select("doc_id", "source", words(F.col("text")).alias("n")), F.col("n"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = {
    "op3_source_mix": f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
s1 AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM s0),
s2 AS (SELECT *, (3 * source_size)::DOUBLE / weight::DOUBLE AS room FROM s1),
s3 AS (SELECT *, ((sum(source_size) OVER ()) - 3 * coalesce(sum(source_size) OVER w, 0))::DOUBLE AS rest,
              ((sum(weight) OVER ()) - coalesce(sum(weight) OVER w, 0))::DOUBLE AS opened
       FROM s2 WINDOW w AS (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT arg_min(rest / opened, (room, rest / opened)) AS level FROM s3 WHERE room >= rest / opened),
t AS (SELECT source, source_size, CASE WHEN room <= level THEN (3 * source_size)::DOUBLE ELSE level * weight END AS target FROM s3, lv),
r AS (SELECT d.doc_id, d.source, size, source_size, target,
             CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0::DOUBLE END AS rate,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '-')), 1, 10))::BIGINT AS bits
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT unnest(range(0, {SEEDS})) AS seed),
tried AS (SELECT r.source, seed, max(abs(floor(rate) * source_size + 0)) AS whole, any_value(target) AS target,
                 sum(CASE WHEN ((bits + seed * 679891637639) % 1099511627776)::DOUBLE / 1099511627776::DOUBLE < rate - floor(rate) THEN size ELSE 0 END) AS extra
          FROM r, k GROUP BY 1, 2),
best AS (SELECT source, arg_min(seed, (abs(whole + extra - target), seed)) AS seed FROM tried GROUP BY 1)
SELECT r.doc_id, size, source_size, target,
       (size * (floor(rate)::BIGINT + CASE WHEN ((bits + seed * 679891637639) % 1099511627776)::DOUBLE / 1099511627776::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r JOIN best ON r.source IS NOT DISTINCT FROM best.source"""
}
