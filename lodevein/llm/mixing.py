"""Mix sources to target weights by hash-threshold histograms.

Every document has a 48-bit hash of its id.  A source whose target is ``e + f`` times its size takes each
document ``e`` times, and once more those whose hash lies under a threshold chosen so that the extra words
come to the rest of the target.  The threshold is found from histograms: words are summed by source and
the first 12 bits of the hash, the bucket that the budget ends in is found by a running sum, and only that
bucket is summed again by the next 12 bits, four times in all.  No document is ever sorted.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own, last in order; a
null id hashes as the empty string; rows with one id share a hash and are taken together; an empty table gives
an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodevein.llm.common import settle, word_count

#: Weights of the sources in order, repeating; most times that a document may be taken.
WEIGHTS = (5, 2, 1)
MOST = 3

LEVELS, BITS = 4, 12


def hash48(doc_id: Column) -> Column:
    """The first 48 bits of the md5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, LEVELS * BITS // 4), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row for each source: source, source_size, target.

    Targets share all words by weight; none exceeds ``most`` times its source.  What a capped source leaves
    is shared by the others again, which is water-filling: with sources in the order of cap by weight, the
    capped ones are a prefix, and the level is what is left over the weights left.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # The windows below see a row for each source, never a row for each document.
    ranked = sums.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    filled = ranked.withColumns(
        {
            "left": F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "weights_left": F.sum("weight").over(after),
        }
    ).withColumn("level", F.col("left").cast("double") / F.col("weights_left").cast("double"))
    # The first source in this order that its share would not overfill sets the level of all that follow.
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    filled = filled.withColumn("level", F.first(fits, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return filled.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: the words that the mix takes of every row."""
    sized = settle(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), hash48(F.col("doc_id")).alias("h")))
    sources = source_targets(sized, weights, most)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("long")
    sources = settle(sources.withColumn("epochs", whole).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")))
    # State of the search: the hashes under `low` are taken for certain and sum to `sum_low`.
    state = sources.select("source", "budget", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("sum_low"))
    for level in range(1, LEVELS + 1):
        shift = (LEVELS - level) * BITS
        here = (F.shiftright("h", shift + BITS) == F.shiftright("low", shift + BITS)) if level > 1 else F.lit(True)
        inside = sized.alias("d").join(state.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & here)
        histogram = inside.groupBy(F.col("s.source").alias("source"), F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.first("budget").alias("budget"), F.first("sum_low").alias("sum_low"))
        run = F.col("sum_low") + F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
        marked = histogram.withColumn("upto", run).filter(F.col("upto") > F.col("budget"))
        # The first bucket that goes over the budget; where none does, all hashes are taken.
        step = marked.groupBy("source").agg(F.min_by(F.struct("bucket", "words", "upto"), "bucket").alias("m"))
        state = settle(
            step.join(sources, step["source"].eqNullSafe(sources["source"])).select(
                step["source"], "budget", F.shiftleft("m.bucket", shift).alias("low"), (F.col("m.upto") - F.col("m.words")).alias("sum_low"), F.col("m.words").alias("at_low")
            )
        )
    # The hash at the boundary is taken if that comes nearer to the budget.
    nearer = F.col("sum_low") + F.col("at_low") - F.col("budget") < F.col("budget") - F.col("sum_low")
    ends = state.select(F.col("source").alias("src"), F.when(nearer, F.col("low") + 1).otherwise(F.col("low")).alias("end"))
    plan = settle(sources.join(ends, sources["source"].eqNullSafe(ends["src"]), "left").select(F.col("source").alias("src"), "source_size", "target", "epochs", F.coalesce("end", F.shiftleft(F.lit(1).cast("long"), LEVELS * BITS)).alias("end")))
    extra = (F.col("h") < F.col("end")).cast("long")
    return sized.join(plan, sized["source"].eqNullSafe(plan["src"])).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.least(F.col("epochs") + extra, F.lit(most))).alias("taken")
    )


#: The same mix by sorting, for DuckDB; {docs} is the relation of documents.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h
  FROM {docs}
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM sums
), weighed AS (
  SELECT *, [5, 2, 1][((rnk - 1) % 3 + 1)::INT]::BIGINT AS weight, 3 * source_size AS cap FROM ranked
), filled AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed
), levelled AS (
  SELECT *, first_value(CASE WHEN level * weight <= cap THEN level END IGNORE NULLS) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lv FROM filled
), targets AS (
  SELECT source, source_size, CASE WHEN lv IS NULL THEN cap::DOUBLE ELSE least(lv * weight, cap::DOUBLE) END AS target FROM levelled
), planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS epochs FROM targets
), runs AS (
  SELECT s.*, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS budget,
         sum(size) OVER (PARTITION BY s.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY s.source, h) AS own
  FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, source, size, source_size, target,
       (size * least(epochs + CASE WHEN upto <= budget OR (upto - own <= budget AND upto - budget < budget - (upto - own)) THEN 1 ELSE 0 END, 3))::BIGINT AS taken
FROM runs
"""
