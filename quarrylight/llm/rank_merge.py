"""One ranking from several scores on different scales.

Robust rank aggregation: within a query every score becomes a normalised rank,
so no score prevails through its range. The sorted ranks of an item are held
against the order statistics of independent uniform ranks; the smallest beta
probability, corrected for having been chosen among several, is the item's
significance, and items are ranked by it.

The ranks of a group are computed from counts: distinct values with their
number, an order-preserving bucket of the value, sums over buckets, sums
within a bucket. So one query that holds a third of all rows is spread over as
many tasks as it has buckets.

Defined cases: a missing or NaN score is the lowest and ties with the other
missing ones; tied values share their worst rank; repeated rows count once, of
unequal ones each score's best; candidates of unknown queries are ignored; a
query with fewer candidates than top_k returns them all; ties in significance
are broken by the mean rank, then generation_id and path.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.runtime import cut

#: Buckets per power of two of a score's magnitude.
BUCKETS_PER_OCTAVE = 32
#: Decimals to which significances are compared.
DECIMALS = 12


def _bucket(value: Column) -> Column:
    """A number that never falls as the value rises."""
    size = F.floor((F.log2(F.abs(value)) + 1100) * BUCKETS_PER_OCTAVE).cast("long")
    return F.when(value.isNull(), F.lit(-(1 << 40))).when(value == 0, 0).when(value > 0, size).otherwise(-size)


def normalised_ranks(rows: DataFrame, group: list[str], score: str, rank: str) -> DataFrame:
    """Add ``rank``: the share of the group's rows that score at least as high, in (0, 1]."""
    marked = rows.withColumn("_bucket", _bucket(F.col(score)))
    counts = marked.groupBy(*group, "_bucket", score).agg(F.count("*").alias("_n"))
    per_bucket = counts.groupBy(*group, "_bucket").agg(F.sum("_n").alias("_b"))
    above = Window.partitionBy(*group).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.withColumn("_above", F.coalesce(F.sum("_b").over(above), F.lit(0))).withColumn(
        "_all", F.sum("_b").over(Window.partitionBy(*group))
    )
    inside = Window.partitionBy(*group, "_bucket").orderBy(F.desc_nulls_last(score)).rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        counts.withColumn("_in", F.sum("_n").over(inside))
        .join(per_bucket, [*group, "_bucket"])
        .select(
            *[F.col(c).alias(f"_of_{c}") for c in group],
            F.col("_bucket").alias("_in_bucket"),
            F.col(score).alias("_value"),
            ((F.col("_above") + F.col("_in")) / F.col("_all")).alias(rank),
        )
    )
    same = F.col("_bucket") == F.col("_in_bucket")
    for c in group:
        same &= F.col(c) == F.col(f"_of_{c}")
    valued = marked.where(F.col(score).isNotNull()).join(ranked, same & (F.col(score) == F.col("_value"))).select(*rows.columns, rank)
    # All rows score at least as high as a missing value, so it needs no look-up; half of all rows may have none.
    return valued.unionByName(rows.where(F.col(score).isNull()).withColumn(rank, F.lit(1.0)))


def significance(ranks: list[Column]) -> Column:
    """Corrected minimum over the beta probabilities of normalised ranks, given in rising order."""
    n = len(ranks)
    tails = []
    for k in range(1, n + 1):
        r = ranks[k - 1]
        tails.append(sum((F.lit(float(comb(n, j))) * F.pow(r, F.lit(j)) * F.pow(1 - r, F.lit(n - j)) for j in range(k, n + 1)), F.lit(0.0)))
    return F.least(F.lit(1.0), F.lit(float(n)) * F.least(*tails))


def aggregate_ranks(candidates: DataFrame, group: str, key: list[str], scores: list[str]) -> DataFrame:
    """Group, key, ``significance`` (small: high on all scores together) and ``mean_rank``.

    All scores are ranked in one pass, as rows (group, number of the candidate,
    kind of score, value); keys wait in the written candidates.
    """
    held = cut(candidates.withColumn("_id", F.monotonically_increasing_id()))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("value")) for i, c in enumerate(scores)]))
    long = held.select(group, "_id", each.alias("_s")).select(group, "_id", "_s.kind", "_s.value")
    ranked = normalised_ranks(long, [group, "kind"], "value", "_rank")
    merged = ranked.groupBy("_id").agg(*[F.max(F.when(F.col("kind") == i, F.col("_rank"))).alias(f"_r{i}") for i in range(len(scores))])
    ranks = F.array_sort(F.array(*[F.col(f"_r{i}") for i in range(len(scores))]))
    columns = [F.col("_ranks")[i] for i in range(len(scores))]
    found = merged.select("_id", ranks.alias("_ranks")).select(
        "_id", F.round(significance(columns), DECIMALS).alias("significance"), F.round(sum(columns[1:], columns[0]) / len(scores), DECIMALS).alias("mean_rank")
    )
    return held.select("_id", group, *key).join(found, "_id").drop("_id")


def candidates_of(entries: DataFrame, hits: DataFrame) -> DataFrame:
    """Each candidate once, with its four scores; the hit score is that of its best hit."""
    key = ["query_id", "generation_id", "path"]
    clean = lambda c: F.max(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")))
    own = entries.groupBy(*key).agg(*[clean(c).alias(c) for c in ("score", "centrality", "focus_score")])
    best = hits.groupBy(*key).agg(clean("score").alias("hit_score"))
    return own.join(best, key, "left")


def top_candidates(entries: DataFrame, hits: DataFrame, queries: DataFrame) -> DataFrame:
    """The top_k candidates of each query with their significance and place."""
    asked = queries.groupBy("query_id").agg(F.max("top_k").alias("top_k"))
    most = asked.agg(F.max("top_k")).first()[0] or 0
    ranked = aggregate_ranks(
        candidates_of(entries, hits), "query_id", ["generation_id", "path"], ["score", "centrality", "focus_score", "hit_score"]
    )
    order = Window.partitionBy("query_id").orderBy("significance", "mean_rank", "generation_id", "path")
    # The fixed bound lets Spark cut each group before the shuffle.
    best = ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.lit(int(most)))
    return best.join(asked, "query_id").where("place <= top_k").drop("top_k")
