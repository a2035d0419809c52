"""Session helpers shared by all operators: reading, spreading, cutting lineage."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver was started.

    Executors on this machine find it in its folder; on a cluster they are sent
    an archive of it.
    """
    sc = spark.sparkContext
    home = str(Path(__file__).resolve().parents[1])
    paths = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
    if home not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([home, *filter(None, paths)])
    if not sc.master.startswith("local") and not getattr(sc, "_quarrylight_sent", False):
        folder = tempfile.mkdtemp()
        sc.addPyFile(shutil.make_archive(f"{folder}/quarrylight", "zip", home, "quarrylight"))
        sc._quarrylight_sent = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    The session's ``spark.checkpoint.dir`` wins. Only where it is unset, as in
    local tests, is a folder of this machine used.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        folder = Path(tempfile.mkdtemp(prefix="quarrylight-")).as_uri()
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage.

    The written blocks survive the loss of any executor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    while name in df.columns:
        name += "_"
    return name


def parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


#: Estimated bytes of a plan's output that one task of a Python stage takes.
BYTES_PER_TASK = 64 << 20
_WIDE = ("Aggregate", "Join", "Window", "Distinct", "Sort ", "Repartition", "Deduplicate")


def partitions_for(df: DataFrame, factor: int = 3) -> int:
    """Partitions that keep all cores busy and hold a bounded part of the plan's estimated size."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    # Estimates multiply over joins; one that no input can have says nothing.
    tasks = size // BYTES_PER_TASK if size < 1 << 50 else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(parallelism(df.sparkSession) * factor, tasks)


def spread(df: DataFrame, factor: int = 3) -> DataFrame:
    """Give a Python stage enough partitions.

    A scan that already yields one split per core is left alone; a smaller one
    (few row groups), or the few coalesced partitions of an aggregation, are
    redistributed.
    """
    want = partitions_for(df, factor)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if not any(w in plan for w in _WIDE) and df.rdd.getNumPartitions() >= parallelism(df.sparkSession):
        return df
    return df.repartition(want)


#: A value in fewer rows than this is never hot; of the more usual ones at most so many are.
HOT_ROWS, HOT_KEYS = 10_000, 1_000
#: Tasks over which a hot value is spread.
COPIES = 16


def hot_keys(rows: DataFrame, key: str) -> list[int]:
    """Hashes of the most usual values of ``key``, HOT_KEYS of them at most.

    Any other value holds less than a HOT_KEYS-th of the rows, or less than HOT_ROWS.
    """
    many = rows.where(F.col(key).isNotNull()).groupBy(F.xxhash64(key).alias("hash")).agg(F.count("*").alias("n"))
    return [r["hash"] for r in many.orderBy(F.desc("n"), "hash").limit(HOT_KEYS).collect() if r["n"] >= HOT_ROWS]


def _copy(key: Column, salt: tuple[str, ...], hot: list[int]) -> Column:
    return F.when(F.xxhash64(key).isin(hot), F.pmod(F.xxhash64(*salt), F.lit(COPIES))).otherwise(F.lit(0))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str, hot: list[int], salt: tuple[str, ...]) -> DataFrame:
    """An equi join in which the left rows of a hot first key, told apart by ``salt``, are spread over COPIES tasks.

    The right side has few rows per key; those of hot keys are repeated.
    """
    if not hot:
        return left.join(right, keys, how)
    place = unused(left, unused(right, "_copy"))
    every = F.when(F.xxhash64(keys[0]).isin(hot), F.sequence(F.lit(0), F.lit(COPIES - 1)).cast("array<bigint>")).otherwise(F.array(F.lit(0).cast("long")))
    return left.withColumn(place, _copy(F.col(keys[0]), salt, hot).cast("long")).join(right.withColumn(place, F.explode(every)), [*keys, place], how).drop(place)


def distinct_texts(df: DataFrame, text: str, *others: str, salt: tuple[str, ...], hot: list[int], more: dict[str, Column] | None = None) -> DataFrame:
    """The distinct texts of ``df`` (others, text) with ``text_key``, their SHA-256.

    Copies are dropped before the shuffle as far as they lie together; a text
    whose key is ``hot`` is spread over COPIES tasks and may come once from
    each, so results are to be made distinct by their key. ``more`` are
    aggregates over the copies.
    """
    rows = df.where(F.col(text).isNotNull()).select("*", F.col(text).alias("_text"))
    if hot:
        rows = rows.withColumn("_copy", _copy(F.sha2("_text", 256), salt, hot))
    each = rows.groupBy(*others, F.col("_text").alias("text"), *(["_copy"] if hot else []))
    whole = each.agg(*[c.alias(n) for n, c in more.items()]) if more else each.agg(F.lit(1).alias("_one")).drop("_one")
    return whole.drop("_copy").withColumn("text_key", F.sha2("text", 256))
