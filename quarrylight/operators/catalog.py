"""Versioned tables: latest rows, retention, keyed rewrites, counts, pages, joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.runtime import unused


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; groups are cut before the shuffle."""
    place = unused(df, "_nth")
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) == 1).drop(place)


def active_generations(generations: DataFrame) -> DataFrame:
    """The active generation of each repository; of several the latest."""
    return generations.where("state = 'active'").groupBy("repository_id").agg(F.max("generation_id").alias("generation_id"))


def retained_generations(generations: DataFrame, inactive: int = 1) -> DataFrame:
    """The active generation of each repository and its latest complete ones."""
    done = generations.where("state = 'complete'")
    place, order = unused(done, "_n"), Window.partitionBy("repository_id").orderBy(F.desc("generation_id"))
    kept = done.withColumn(place, F.row_number().over(order)).where(F.col(place) <= inactive).drop(place)
    return generations.where("state = 'active'").unionByName(kept)


def upsert(store: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of both with one per key; an incoming row replaces the stored one."""
    fresh = first_per(incoming, keys, order)
    return store.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def upsert_with_reset(store: DataFrame, incoming: DataFrame, keys: list[str], content: str, order: list[Column]) -> DataFrame:
    """Upsert that says, per row, whether its content changed and so must be embedded again."""
    fresh = first_per(incoming, keys, order)
    old = store.select(*keys, F.col(content).alias("_old"), F.lit(True).alias("_known"))
    both = fresh.join(old, keys, "full_outer")
    kept = store.join(fresh.select(*keys), keys, "left_anti").withColumn("changed", F.lit(False))
    news = both.join(fresh.select(*keys), keys, "left_semi").select(*fresh.columns, (F.col("_known").isNull() | ~F.col(content).eqNullSafe(F.col("_old"))).alias("changed"))
    return kept.unionByName(news)


def delete_where(store: DataFrame, selection: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without those selected; an empty selection deletes nothing."""
    return store.join(selection.select(*keys).distinct(), keys, "left_anti")


def cascade(selection: DataFrame, children: dict[str, tuple[DataFrame, str, str]]) -> dict[str, DataFrame]:
    """Child tables without the rows of the selected parents: name -> (table, its column, parent column)."""
    return {
        name: table.join(selection.select(F.col(parent).alias(column)).distinct(), column, "left_anti") for name, (table, column, parent) in children.items()
    }


def merge_lists(a: Column, b: Column) -> Column:
    """Union of two lists in order of first appearance."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(a, empty), F.coalesce(b, empty)))


def enqueue(active: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The wanted rows that no active row has yet, once each."""
    return wanted.dropDuplicates(keys).join(active.select(*keys).distinct(), keys, "left_anti")


def duplicates_by_content(docs: DataFrame) -> DataFrame:
    """doc_id of the preferred copy of each text: not failed, then newest; with the copies' number."""
    keyed = docs.where(F.col("text").isNotNull()).withColumn("checksum", F.sha2("text", 256))
    best = F.min_by("doc_id", F.struct((F.coalesce("status", F.lit("")) == "failed").cast("int"), -F.unix_micros("updated_at"), "doc_id"))
    return keyed.groupBy("checksum").agg(best.alias("doc_id"), F.count("*").alias("copies"))


def status_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: Column, limit: int = 12) -> DataFrame:
    return df.groupBy(value.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def keyset_page(df: DataFrame, keys: list[str], after: tuple, size: int) -> DataFrame:
    """The ``size`` rows whose key follows ``after``."""
    bound = F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, after)])
    return df.where(F.struct(*keys) > bound).orderBy(*keys).limit(size)


def last_rows(df: DataFrame, key: str, order: str, tie: str, n: int) -> DataFrame:
    """The last ``n`` rows of each key with their place in time."""
    place = Window.partitionBy(key).orderBy(F.desc(order), F.desc(tie))
    return df.withColumn("back", F.row_number().over(place)).where(F.col("back") <= n)


def generation_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of every table per generation."""
    parts = [t.groupBy("generation_id").agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "generation_id", "rows") for n, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def rehydrate(hits: DataFrame, chunks: DataFrame, active: DataFrame) -> DataFrame:
    """Hits against the authoritative rows: accepted, or the reason of rejection.

    Reasons: stale (another generation), missing (no such row), accepted.
    """
    known = chunks.select(F.col("id").alias("item_id"), "generation_id", F.lit(True).alias("known")).distinct()
    rows = hits.join(known, ["item_id", "generation_id"], "left").join(active.select("generation_id", F.lit(True).alias("live")), "generation_id", "left")
    return rows.withColumn("reason", F.when(F.col("live").isNull(), "stale").when(F.col("known").isNull(), "missing").otherwise("accepted"))


def fingerprint(files: DataFrame) -> DataFrame:
    """One digest per generation over its paths and content hashes, whatever the row order.

    The rows are hashed in parallel and combined by addition of their 64-bit
    halves, so no generation is gathered in one place.
    """
    row = F.sha2(F.concat_ws("\x00", "path", "content_hash", F.coalesce("git_status", F.lit(""))), 256)
    part = lambda a: F.conv(F.substring(row, a, 15), 16, 10).cast("decimal(38,0)")
    sums = files.select("generation_id", "path", "content_hash", "git_status").distinct().groupBy("generation_id").agg(F.sum(part(1)).alias("a"), F.sum(part(16)).alias("b"), F.count("*").alias("n"))
    return sums.select("generation_id", F.sha2(F.concat_ws(":", F.col("a").cast("string"), F.col("b").cast("string"), F.col("n").cast("string")), 256).alias("fingerprint"))
