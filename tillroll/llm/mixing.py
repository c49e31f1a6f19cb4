"""Mixing sources to target weights.

Sizes are aggregated by source; target sizes follow from weights and a cap on
repetition; each document is then emitted floor(rate) times plus one more copy
with probability equal to the fraction, decided by a hash of its id, so a rerun
draws the same copies.  Native DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.llm.common import table
from tillroll.session import write_table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEAT = 2.0
SEED = "mix"


def n_words(text: str = "text") -> Column:
    """Runs of ``[^\\x20\\x09-\\x0D]`` in a text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE,
                   max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(source, size) -> one row per source: source, source_size, weight, target.

    The sources are taken in code-point order (null last) and weighted in turn.
    ``share`` of all sizes is dealt out by weight; a source stops at
    ``max_repeat`` times its size, and what it leaves is dealt to the others by
    weight until none is above.  Every round moves four numbers to the driver.
    """
    total = sizes.groupBy("source").agg(F.sum("size").cast("double").alias("source_size"))
    # rank without a single sorted partition: position in a range partition plus the sizes of those before
    ranged = write_table(
        total.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    parts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("c"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    place = F.pmod(F.col("start") + within, F.lit(len(weights))).cast("int")
    ranked = write_table(
        ranged.join(starts, "part").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place + 1).cast("double"))
        .select("source", "source_size", "weight", (F.col("source_size") * max_repeat).alias("most")), "weights")
    goal = share * (ranked.agg(F.sum("source_size")).first()[0] or 0.0)
    full, capped, level = F.lit(False), -1, 0.0
    while True:
        n, taken, open_weight = ranked.agg(F.count_if(full), F.sum(F.when(full, F.col("most")).otherwise(0.0)),
                                           F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if n == capped or not open_weight:
            break
        capped, rest = n, goal - taken
        level = F.col("weight") * F.lit(rest) / F.lit(open_weight)
        full = full | (level > F.col("most"))
    target = F.when(full, F.col("most")).otherwise(level) if capped >= 0 else F.col("most")
    return ranked.select("source", F.col("source_size").cast("long").alias("source_size"), "weight",
                         F.least(target, "most").alias("target"))


def copies(rate: Column, doc_id: str = "doc_id", seed: str = SEED) -> Column:
    """floor(rate), and one more with the fraction's probability by a 52-bit hash of the id."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
                                     .cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    return (F.floor(rate) + F.when(drawn < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def plan_mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """``docs`` plus mx_size, mx_source_size, mx_target and mx_copies (how often the mix takes the row).

    Needs doc_id, text and source.  Null text has size 0; a null source is a
    source of its own, the last one; sources of size 0 have target 0 and are not
    taken; rows that share a doc_id share its draw; an empty table stays empty.
    """
    here = docs.withColumn("mx_size", n_words())
    targets = source_targets(here.select("source", F.col("mx_size").alias("size")), weights, share, max_repeat)
    targets = targets.select(F.col("source").alias("__mx_source"), F.col("source_size").alias("mx_source_size"),
                             F.col("target").alias("mx_target"))
    rate = F.when(F.col("mx_source_size") > 0, F.col("mx_target") / F.col("mx_source_size")).otherwise(0.0)
    return (here.join(targets, F.col("source").eqNullSafe(F.col("__mx_source")))
            .drop("__mx_source").withColumn("mx_copies", copies(rate)))


def mix_sources(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as planned, with the columns of ``docs``."""
    planned = plan_mix(docs, **settings).where("mx_copies > 0")
    return planned.withColumn("__mx_copy", F.explode(F.sequence(F.lit(1).cast("long"), "mx_copies"))).select(*docs.columns)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return plan_mix(docs).select(
        "doc_id", F.col("mx_size").alias("size"), F.col("mx_source_size").alias("source_size"),
        F.col("mx_target").alias("target"), (F.col("mx_size") * F.col("mx_copies")).alias("taken"))


_SIZES = r"""
d AS (SELECT doc_id, source,
             CASE WHEN text IS NULL THEN 0
                  ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 2.0 * source_size AS most,
             [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM s),
-- in order of most/weight, a source is full as long as the level of the rest lies above it
o AS (SELECT *, coalesce(sum(most) OVER p, 0) AS taken, sum(weight) OVER q AS open_weight FROM w
      WINDOW p AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
             q AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT *, weight * (1.5 * (SELECT sum(source_size) FROM s) - taken) / open_weight > most AS is_full FROM o),
l AS (SELECT coalesce(sum(most) FILTER (is_full), 0) AS taken, sum(weight) FILTER (NOT is_full) AS open_weight FROM f),
t AS (SELECT source, source_size::BIGINT AS source_size,
             CASE WHEN is_full THEN most
                  ELSE least(weight * (1.5 * (SELECT sum(source_size) FROM s) - l.taken) / l.open_weight, most) END AS target
      FROM f, l)
"""

ORACLE = f"""
WITH {_SIZES}
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE
                                        / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM (SELECT d.doc_id, d.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
"""
