"""Dense vectors: similarity, exact search in blocks, hash embeddings, quantized codes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.runtime import spread

#: Query vectors scored against the table at once; bounds what every executor holds.
BLOCK = 2_000
#: Lloyd-Max centroids of a standard normal for 1, 2 and 3 bits.
CENTROIDS = {
    1: (-0.79788, 0.79788),
    2: (-1.5101, -0.4528, 0.4528, 1.5101),
    3: (-2.1519, -1.3439, -0.7560, -0.2451, 0.2451, 0.7560, 1.3439, 2.1519),
}
ROTATION_SEED, PROJECTION_SEED, BITS = 42, 1337, 4


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(v: Column, dimensions: int | None = None) -> Column:
    """Unit vector over the first ``dimensions`` components; zero stays zero."""
    head = F.slice(v, 1, dimensions) if dimensions else v
    size = norm(head)
    return F.transform(head, lambda x: x.cast("double") / F.when(size == 0, 1.0).otherwise(size))


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the common prefix; 0 if either is empty or zero."""
    n = F.least(F.size(a), F.size(b))
    left, right = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    dot = F.aggregate(F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = norm(left) * norm(right)
    return F.when((n <= 0) | (size == 0), F.lit(0.0)).otherwise(dot / size)


def _unit(matrix: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, size, out=np.zeros_like(matrix), where=size > 0)


def search(vectors: DataFrame, queries: DataFrame, k: int, *, key: str = "vec_id", value: str = "embedding", block: int = BLOCK) -> DataFrame:
    """The ``k`` nearest rows by cosine of each query row, exactly.

    The stated queries go over the table in blocks; each batch of the table
    keeps its own k best per query, so only k rows per query and batch are
    shuffled. Ties are broken by key.
    """
    rows = queries.where(F.col(value).isNotNull()).select(F.col(key).alias("query_id"), value).orderBy("query_id")
    table = spread(vectors.where(F.col(value).isNotNull()).select(key, value))
    ids, data, out = [], [], None

    def flush() -> None:
        nonlocal out, ids, data
        if not ids:
            return
        shared = vectors.sparkSession.sparkContext.broadcast((np.array(ids), _unit(np.array(data, dtype=np.float64))))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, q = shared.value
            for batch in batches:
                if not len(batch):
                    continue
                keys = batch[key].to_numpy()
                scores = np.round(q @ _unit(np.stack(batch[value].to_numpy()).astype(np.float64)).T, 9)
                take = min(k, len(keys))
                order = np.lexsort((np.broadcast_to(keys, scores.shape), -scores), axis=1)[:, :take]
                yield pd.DataFrame(
                    {"query_id": np.repeat(names, take), key: keys[order].ravel(), "score": np.take_along_axis(scores, order, 1).ravel()}
                )

        part = table.mapInPandas(run, f"query_id long, `{key}` long, score double")
        out = part if out is None else out.unionByName(part)
        ids, data = [], []

    for row in rows.toLocalIterator():
        ids.append(row[0])
        data.append(row[1])
        if len(ids) >= block:
            flush()
    flush()
    if out is None:
        return vectors.sparkSession.createDataFrame([], f"query_id long, `{key}` long, score double, rank int")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return out.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def hash_embedding(docs: DataFrame, dimensions: int = 64, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sparse form of a deterministic embedding: key, index, value, of unit length.

    Index and sign of a word come from the first two bytes of its SHA-256, so at
    most 256 indices occur.
    """
    words = F.filter(F.split(F.lower(F.trim(F.coalesce(F.col(text), F.lit("")))), r"\s+"), lambda w: w != "")
    each = spread(docs.select(key, text)).select(key, F.explode(words).alias("w"))
    digest = F.sha2("w", 256)
    index = F.conv(F.substring(digest, 1, 2), 16, 10).cast("int") % dimensions
    sign = F.when(F.conv(F.substring(digest, 3, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    parts = each.select(key, index.alias("index"), sign.alias("s")).groupBy(key, "index").agg(F.sum("s").alias("s"))
    size = parts.groupBy(key).agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("size"))
    return parts.join(size, key).where("size > 0").select(key, "index", (F.col("s") / F.col("size")).alias("value"))


# ---- quantized codes -------------------------------------------------------


@lru_cache(maxsize=8)
def rotation(dimensions: int, seed: int = ROTATION_SEED) -> np.ndarray:
    """Random orthogonal matrix; signs are fixed, so equal seeds give equal matrices."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimensions, dimensions)))
    return q * np.where(np.diagonal(r) >= 0, 1.0, -1.0)


@lru_cache(maxsize=8)
def projection(dimensions: int, seed: int = PROJECTION_SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dimensions, dimensions)) / np.sqrt(dimensions)


def pack(codes: np.ndarray, bits: int) -> np.ndarray:
    """Rows of small integers as bytes, least significant bit first."""
    spread_out = (codes[:, :, None] >> np.arange(bits)) & 1
    return np.packbits(spread_out.reshape(len(codes), -1).astype(np.uint8), axis=1, bitorder="little")


def unpack(data: np.ndarray, length: int, bits: int) -> np.ndarray:
    flat = np.unpackbits(data, axis=1, bitorder="little")[:, : length * bits]
    return (flat.reshape(len(data), length, bits) << np.arange(bits)).sum(axis=2)


def encode(matrix: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of ``bits - 1`` bits per rotated component, one sign bit per projected residual, norms."""
    d = matrix.shape[1]
    size = np.linalg.norm(matrix, axis=1)
    turned = _unit(matrix.astype(np.float64)) @ rotation(d).T
    levels = np.array(CENTROIDS[max(1, min(3, bits - 1))])
    codes = np.abs(turned[:, :, None] * np.sqrt(d) - levels).argmin(axis=2)
    rest = turned - levels[codes] / np.sqrt(d)
    signs = np.packbits(rest @ projection(d).T >= 0, axis=1)
    return pack(codes, max(1, bits - 1)), signs, np.linalg.norm(rest, axis=1), size


def estimate(queries: np.ndarray, codes: np.ndarray, signs: np.ndarray, rest: np.ndarray, size: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Unbiased inner products of queries with coded vectors."""
    d = queries.shape[1]
    q_size = np.linalg.norm(queries, axis=1)
    turned = _unit(queries.astype(np.float64)) @ rotation(d).T
    levels = np.array(CENTROIDS[max(1, min(3, bits - 1))])
    known = levels[unpack(codes, d, max(1, bits - 1))] / np.sqrt(d)
    sign = np.unpackbits(signs, axis=1)[:, :d] * 2.0 - 1.0
    inner = turned @ known.T + np.sqrt(np.pi / (2 * d)) * rest * ((turned @ projection(d).T) @ sign.T)
    return q_size[:, None] * size * inner


def decode(codes: np.ndarray, signs: np.ndarray, rest: np.ndarray, size: np.ndarray, dimensions: int, bits: int = BITS) -> np.ndarray:
    """Approximate vectors, for diagnosis."""
    levels = np.array(CENTROIDS[max(1, min(3, bits - 1))])
    known = levels[unpack(codes, dimensions, max(1, bits - 1))] / np.sqrt(dimensions)
    sign = np.unpackbits(signs, axis=1)[:, :dimensions] * 2.0 - 1.0
    turned = known + np.sqrt(np.pi / (2 * dimensions)) * rest[:, None] * (sign @ projection(dimensions))
    return size[:, None] * (turned @ rotation(dimensions))


def quantized(vectors: DataFrame, *, key: str = "vec_id", value: str = "embedding", bits: int = BITS) -> DataFrame:
    """key, codes binary, signs binary, rest double, size double."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                codes, signs, rest, size = encode(np.stack(batch[value].to_numpy()).astype(np.float64), bits)
                yield pd.DataFrame({key: batch[key], "codes": [c.tobytes() for c in codes], "signs": [s.tobytes() for s in signs], "rest": rest, "size": size})

    held = vectors.where(F.col(value).isNotNull()).select(key, value)
    return spread(held).mapInPandas(run, f"`{key}` long, codes binary, signs binary, rest double, size double")


def search_quantized(
    coded: DataFrame, queries: DataFrame, k: int, *, exact: DataFrame | None = None, candidates: int = 0, key: str = "vec_id", value: str = "embedding", bits: int = BITS, block: int = BLOCK
) -> DataFrame:
    """Approximate search over codes; the queries go in blocks as in ``search``.

    With ``exact`` (key, value: the vectors that were coded) the best
    ``candidates`` by code, four times ``k`` unless given, are scored again by
    the cosine of the vectors before they are cut to ``k``.
    """
    again = exact is not None
    take_first = max(k, candidates or 4 * k) if again else k
    rows = queries.where(F.col(value).isNotNull()).select(F.col(key).alias("query_id"), value).orderBy("query_id")
    ids, data, out = [], [], None

    def flush() -> None:
        nonlocal out, ids, data
        if not ids:
            return
        shared = coded.sparkSession.sparkContext.broadcast((np.array(ids), np.array(data, dtype=np.float64)))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, q = shared.value
            for batch in batches:
                if not len(batch):
                    continue
                as_rows = lambda c: np.stack([np.frombuffer(x, dtype=np.uint8) for x in batch[c]])
                scores = estimate(q, as_rows("codes"), as_rows("signs"), batch["rest"].to_numpy(), batch["size"].to_numpy(), bits)
                if again:
                    size = np.linalg.norm(q, axis=1)[:, None] * batch["size"].to_numpy()
                    scores = np.divide(scores, size, out=np.zeros_like(scores), where=size > 0)
                keys = batch[key].to_numpy()
                take = min(take_first, len(keys))
                order = np.lexsort((np.broadcast_to(keys, scores.shape), -scores), axis=1)[:, :take]
                yield pd.DataFrame({"query_id": np.repeat(names, take), key: keys[order].ravel(), "score": np.take_along_axis(scores, order, 1).ravel()})

        part = coded.mapInPandas(run, f"query_id long, `{key}` long, score double")
        out = part if out is None else out.unionByName(part)
        ids, data = [], []

    for row in rows.toLocalIterator():
        ids.append(row[0])
        data.append(row[1])
        if len(ids) >= block:
            flush()
    flush()
    if out is None:
        return coded.sparkSession.createDataFrame([], f"query_id long, `{key}` long, score double, rank int")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    found = out.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= take_first)
    if not again:
        return found
    asked = rows.select("query_id", F.col(value).alias("_asked")).dropDuplicates(["query_id"])
    held = exact.where(F.col(value).isNotNull()).select(key, F.col(value).alias("_held")).dropDuplicates([key])
    scored = found.select("query_id", key).distinct().join(held, key).join(asked, "query_id").select("query_id", key, F.round(cosine(F.col("_asked"), F.col("_held")), 9).alias("score"))
    return scored.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def check_schema(vectors: DataFrame, dimensions: int, value: str = "embedding") -> DataFrame:
    """Rows whose vector is missing or has another size."""
    return vectors.where(F.col(value).isNull() | (F.size(value) != dimensions))
