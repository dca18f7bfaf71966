"""Exact nearest neighbours and checks on vector columns.

Queries meet the rows block by block: a block of `BLOCK` query vectors, a bound in rows and so in bytes, is sent to the
tasks, which keep each batch's k best rows of every query; the best of these are ranked by a window. No pair table is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
METRICS = ("l2", "cosine", "euclidean")


def squared_l2(a: Column, b: Column) -> Column:
    parts = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """(queries, rows) in double precision; the cosine distance to a zero vector is 1."""
    if metric == "cosine":
        norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
        return 1 - np.divide(q @ x.T, norms, out=np.zeros(norms.shape), where=norms > 0)
    d = np.empty((len(q), len(x)))
    for i, v in enumerate(q):  # differences, not products: equal vectors are exactly 0 apart
        d[i] = ((x - v) ** 2).sum(1)
    return np.sqrt(d) if metric == "euclidean" else d


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), np.float64).reshape(len(vectors), -1)


def nearest(rows: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id_col: str = "vec_id", vector_col: str = "embedding", skip_self: bool = False) -> DataFrame:
    """(query_id, id, distance, rank): each query's k nearest rows; ties go to the smaller id.

    Null vectors take no part. All vectors must have one length (`dimension_offenders` finds others)."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    spark = rows.sparkSession
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"query_id {kind}, id {kind}, distance double"
    base = rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    parts, block = None, []

    def of(block: list) -> DataFrame:
        ids = [r[0] for r in block]
        shared = spark.sparkContext.broadcast((np.array(ids), np.array([r[1] for r in block], np.float64)))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qid, q = shared.value
            for pdf in batches:
                if not len(pdf):
                    continue
                own = pdf.id.to_numpy()
                d = distances(q, _matrix(pdf.v), metric)
                if skip_self:
                    d[qid[:, None] == own[None, :]] = np.inf
                # all that are as near as the k-th, in order; the window below takes the k of least id among equals
                kth = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
                i, j = np.nonzero((d <= kth[:, None]) & np.isfinite(d))
                if own.dtype != object and len(i) > k * len(d):
                    order = np.lexsort((own[j], d[i, j], i))
                    i, j = i[order], j[order]
                    place = np.arange(len(i)) - np.searchsorted(i, i, "left")
                    i, j = i[place < k], j[place < k]
                yield pd.DataFrame({"query_id": qid[i], "id": own[j], "distance": d[i, j]})

        return base.mapInPandas(scan, schema)

    for r in queries.where(F.col(vector_col).isNotNull()).select(id_col, vector_col).toLocalIterator():
        block.append(r)
        if len(block) == BLOCK:
            parts = of(block) if parts is None else parts.unionByName(of(block))
            block = []
    if block:
        parts = of(block) if parts is None else parts.unionByName(of(block))
    if parts is None:
        return spark.createDataFrame([], schema + ", rank int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return parts.withColumn("rank", rank).where(f"rank <= {k}")


def core_distances(graph: DataFrame, k: int) -> DataFrame:
    """(id, core): the distance to the k-th neighbour, the row itself not counted."""
    return graph.where(f"rank <= {k}").groupBy(F.col("query_id").alias("id")).agg(F.max("distance").alias("core"))


def mutual_reachability(graph: DataFrame, cores: DataFrame) -> DataFrame:
    """(a, b, weight) of the neighbour graph, a < b: the greatest of both core distances and the distance."""
    e = graph.select(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b"), "distance").distinct()
    e = e.join(cores.select(F.col("id").alias("a"), F.col("core").alias("core_a")), "a").join(cores.select(F.col("id").alias("b"), F.col("core").alias("core_b")), "b")
    return e.groupBy("a", "b").agg(F.min(F.greatest("distance", "core_a", "core_b")).alias("weight"))


def dimension_offenders(rows: DataFrame, id_col: str, vector_col: str, expected: int | None = None) -> DataFrame:
    """(id, dimension) of the vectors whose length is not `expected`, or not the most frequent one (the smaller on ties)."""
    sized = rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.size(vector_col).alias("dimension"))
    if expected is None:
        first = sized.groupBy("dimension").count().orderBy(F.desc("count"), "dimension").first()
        if first is None:
            return sized
        expected = first["dimension"]
    return sized.where(F.col("dimension") != expected)
