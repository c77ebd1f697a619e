"""An inverted-file index over vectors: cells around k-means centres, and searches that look into the nearest cells only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import vector as V
from marlstone.operators._lineage import cut

#: The centres are fitted on about this many vectors, those of the smallest hashes of their ids; every vector is indexed.
FITTED = 16_384
#: Cells at most, so that the centres are a small broadcast.
MOST_CELLS = 4096


def _units(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    size = V.norm(v)
    return vectors.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.when(size > 0, x / size).otherwise(0.0)).alias("v"))


def fit_cells(vectors: DataFrame, id_col: str, vec_col: str, cells: int | None = None, fitted: int = FITTED) -> KMeansModel | None:
    """Centres of about the square root of the number of vectors, or `cells`; None if there is no vector."""
    units = _units(vectors, id_col, vec_col)
    n = units.count()
    if not n:
        return None
    k = cells or max(1, min(MOST_CELLS, round(n**0.5)))
    chosen = units.filter(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 30)) < int(min(1.0, fitted / n) * (1 << 30))).limit(2 * fitted)
    rows = cut(chosen.select("id", array_to_vector("v").alias("features")).repartition(1).sortWithinPartitions("id"), "fitted")
    if rows.isEmpty():
        rows = units.limit(1).select("id", array_to_vector("v").alias("features"))
    return KMeans(k=max(2, k), seed=7, maxIter=8, initMode="random").fit(rows)


def probes_for(vectors: DataFrame, id_col: str, vec_col: str, model: KMeansModel, k: int, recall: float = 0.95, tried: int = 4096) -> int:
    """Cells a search has to look into to find this share of the k nearest, by a sample of about `tried` vectors among themselves.

    Neighbours in a sample are farther than among all vectors, so all of them need fewer cells rather than more."""
    units = _units(vectors, id_col, vec_col)
    share = min(1.0, tried / max(1, units.count()))
    rows = units.filter(F.pmod(F.xxhash64("id", F.lit("try")), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * tried).select("id", "v").toArrow()
    centres = np.array(model.clusterCenters())
    if len(rows) < 2:
        return len(centres)
    x = np.array(rows["v"].to_pylist())
    order = np.argsort((centres**2).sum(1)[None, :] - 2 * x @ centres.T, axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # of each centre in a vector's order
    asked = x[np.argsort(rows["id"].to_numpy(), kind="stable")][:512]
    mine = np.argsort(rows["id"].to_numpy(), kind="stable")[:512]
    score = asked @ x.T
    score[np.arange(len(asked)), mine] = -np.inf
    near = np.argsort(-score, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    depth = np.sort(place[mine[:, None], order[near, 0]].ravel())
    return int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))))]) + 1


def index(vectors: DataFrame, id_col: str, vec_col: str, model: KMeansModel, block: int = 16_384) -> DataFrame:
    """id, v (of length one), cell and block of every vector: a cell of many vectors is dealt into blocks of about `block`."""
    placed = cut(model.transform(_units(vectors, id_col, vec_col).withColumn("features", array_to_vector("v"))).select("id", "v", F.col("prediction").alias("cell")), "cells")
    blocks = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))  # a row a cell, MOST_CELLS at most
    return placed.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), "blocks").cast("int"))


def search(queries: DataFrame, indexed: DataFrame, model: KMeansModel, id_col: str, vec_col: str, k: int, probes: int, block: int = 2048) -> DataFrame:
    """query, id, score and rank of the k vectors of the greatest cosine among those of the `probes` cells nearest to each query, the query itself left out.

    A query meets each block of a cell in a task of its own, `block` queries at a time; of each it keeps k hits, and these are
    ranked again. Ties are by id. Null queries find nothing."""
    centres = np.array(model.clusterCenters())
    nearest = min(probes, len(centres))

    def probe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vs in batches:
            x = np.array(vs.to_pylist())
            far = (centres**2).sum(1)[None, :] - 2 * x @ centres.T
            yield pa.array(np.argsort(far, axis=1, kind="stable")[:, :nearest].astype(np.int32).tolist(), pa.list_(pa.int32()))

    cells = indexed.select("cell", "block").groupBy("cell", "block").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    q = _units(queries, id_col, vec_col).withColumn("cell", F.explode(F.arrow_udf(probe, "array<int>")("v")))
    crowd = q.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("strips"))
    q = q.join(F.broadcast(crowd), "cell").withColumn("strip", F.pmod(F.xxhash64("id", F.lit("strip")), "strips").cast("int"))
    asked = q.join(cells, "cell").select("cell", "block", "strip", "id", "v")
    held = indexed.join(F.broadcast(crowd), "cell").withColumn("strip", F.explode(F.sequence(F.lit(0), (F.col("strips") - 1).cast("int")))).select(*(F.col(c).alias(c) for c in ("cell", "block", "strip", "id", "v")))
    table = lambda rows: np.array(rows["v"].to_pylist())

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        mine, ids = left["id"].to_numpy(), right["id"].to_numpy()
        if not len(mine) or not len(ids):
            return pa.table({"query": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        y, found = table(right), []
        for at in range(0, len(mine), 256):
            score = np.round(table(left.slice(at, 256)) @ y.T, 9)
            score[mine[at : at + 256, None] == ids[None, :]] = -np.inf
            for i, s in enumerate(score, at):
                hits = np.lexsort((ids, -s))[: min(k, int((s > -np.inf).sum()))]
                found.append((np.full(len(hits), mine[i]), ids[hits], s[hits]))
        return pa.table({n: np.concatenate([f[c] for f in found]) for c, n in enumerate(("query", "id", "score"))})

    key = ["cell", "block", "strip"]
    few = asked.groupBy(*key).cogroup(held.toDF(*held.columns).groupBy(*key)).applyInArrow(best, "query bigint, id bigint, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return few.withColumn("rank", place).filter(F.col("rank") <= k)
