"""Nearest vectors by inner product: probed lists, scanned a block of rotated dimensions at a time.

Index: spherical k-means on a bounded sample (``SAMPLE`` vectors) gives the lists; every vector goes into the list of its
nearest centroid. Lists are cut into blocks of about ``BLOCK`` vectors, so a list that holds a third of all vectors still is
many tasks. A query visits the lists of its nearest centroids. How many is measured on the sample: so many that they hold a share of
``RECALL`` of the nearest neighbours which vectors of the sample have among the others of it. These are farther away than the
nearest of the whole table, so the measure errs on the safe side. Vectors in clusters need few lists, however large the table;
vectors without any structure need most. (``probes`` may give a share of the lists instead.)

Scan: vectors are turned by a random rotation and laid out in column blocks. After each column block a hypothesis test
compares a pair's partial product with what a pair as good as the query's threshold would show by now (mean and
deviation under a random rotation): clearly worse pairs are abandoned. Their remaining dimensions are never read. The
threshold starts as the query's k-th best product among those vectors of the sample (at most a FLOOR_SHARE-th of the table)
that lie in its lists, and rises during the scan. The sample gives centroids and starting thresholds only: every row of
the result comes from the scan, and so many candidates lie above a starting threshold that k are left.
Products of the survivors are taken in double precision on the original vectors.

Cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor do
rows without an id; rows that share an id are one item, as near as its nearest vector; equal products go by smaller id;
with fewer than ``k`` candidates all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tickerloom.llm.work import stage

SAMPLE = 8192
BLOCK = 4096
COLUMNS = 16
#: Share of near neighbours that the visited lists are to hold, and vectors of the sample that are asked for theirs.
RECALL, ASKED = 0.97, 512
#: Deviations below the expected partial product at which a pair is abandoned.
DEVIATIONS = 2.75
#: Starting thresholds come from one vector of so many at most.
FLOOR_SHARE = 8
#: Queries that meet one block of vectors in one task at most (about).
QUERY_SLICE = 4096
_SEED = 20240607


def usable(vector: str, dims: int | None = None) -> Column:
    """Not null, no null or non-finite component, not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dims if dims else F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; equal rows give equal numbers wherever they stand."""
    return (a.astype(np.float64) * b.astype(np.float64)).sum(axis=1)


@dataclass(frozen=True)
class Index:
    """Centroids, the rotation, and the sample for the thresholds with its ids and lists."""

    centroids: np.ndarray
    rotation: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray
    lists: np.ndarray

    @staticmethod
    def fitted(ids: np.ndarray, vectors: np.ndarray, lists: int, floors: int, rounds: int = 10) -> Index:
        rng = np.random.default_rng(_SEED)
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        centroids = unit[rng.choice(len(unit), lists, replace=False)]
        for _ in range(rounds):
            own = (unit @ centroids.T).argmax(axis=1)
            sums = np.zeros_like(centroids)
            np.add.at(sums, own, unit)
            empty = np.linalg.norm(sums, axis=1) == 0
            sums[empty] = unit[rng.choice(len(unit), int(empty.sum()))]
            centroids = sums / np.linalg.norm(sums, axis=1, keepdims=True)
        rotation = np.linalg.qr(rng.standard_normal((vectors.shape[1],) * 2))[0]
        few = vectors[:floors]
        return Index(centroids, rotation, ids[:floors], few, (few @ centroids.T).argmax(axis=1))

    def lists_of(self, vectors: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` nearest lists of each vector, the nearest first."""
        near = vectors @ self.centroids.T
        return np.argsort(-near, axis=1, kind="stable")[:, :probes]


def visits_for(index: Index, ids: np.ndarray, vectors: np.ndarray, k: int) -> int:
    """How many of its nearest lists a vector of the sample must visit for RECALL of its k nearest others there."""
    own = index.lists_of(vectors, 1)[:, 0]
    few = vectors[:ASKED]
    near = few @ vectors.T
    near[ids[: len(few), None] == ids[None, :]] = -np.inf
    k = min(k, len(ids) - 1)
    if k < 1:
        return len(index.centroids)
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    order = index.lists_of(few, len(index.centroids))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
    needed = np.sort(np.take_along_axis(place, own[best], axis=1).ravel()) + 1
    return int(needed[math.ceil(RECALL * len(needed)) - 1])


@dataclass(frozen=True)
class Scan:
    """A block of vectors, turned and cut into column blocks."""

    ids: np.ndarray
    vectors: np.ndarray
    turned: list[np.ndarray]
    norms: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray, columns: int) -> Scan:
        turned = vectors @ rotation
        parts = [np.ascontiguousarray(turned[:, i : i + columns]) for i in range(0, turned.shape[1], columns)]
        return Scan(ids, vectors, parts, np.linalg.norm(vectors, axis=1))

    def survivors(self, queries: Scan, floors: np.ndarray, deviations: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) pairs that no test abandoned."""
        dims = self.vectors.shape[1]
        seen = self.turned[0].shape[1]
        partial = queries.turned[0] @ self.turned[0].T
        scale = queries.norms[:, None] * self.norms[None, :]

        def spread(seen: int) -> float:
            return deviations * math.sqrt(seen * (1 - seen / dims)) / dims

        keep = partial >= floors[:, None] * (seen / dims) - scale * spread(seen)
        q, v = np.nonzero(keep)
        partial = partial[q, v]
        for mine, theirs in zip(queries.turned[1:], self.turned[1:], strict=True):
            partial = partial + np.einsum("ij,ij->i", mine[q], theirs[v])
            seen += theirs.shape[1]
            slack = queries.norms[q] * self.norms[v] * (spread(seen) + 1e-9)
            keep = partial >= floors[q] * (seen / dims) - slack
            q, v, partial = q[keep], v[keep], partial[keep]
        return q, v


def scanned(block: Scan, queries: Scan, floors: np.ndarray, k: int, deviations: float, chunk: int = 512) -> pd.DataFrame:
    """The best pairs of a block: at most k for each query, none below the query's floor."""
    floors, found = floors.copy(), []
    for at in range(0, len(block.ids), chunk):
        part = slice(at, at + chunk)
        few = Scan(block.ids[part], block.vectors[part], [t[part] for t in block.turned], block.norms[part])
        q, v = few.survivors(queries, floors, deviations)
        other = queries.ids[q] != few.ids[v]
        q, v = q[other], v[other]
        scores = exact_products(queries.vectors[q], few.vectors[v])
        good = scores >= floors[q]
        own = pd.DataFrame({"q": q[good], "vec_id": few.ids[v[good]], "score": scores[good]})
        every = pd.concat([*found, own]).sort_values(["q", "score", "vec_id"], ascending=[True, False, True])
        every = every.drop_duplicates(["q", "vec_id"])  # rows that share an id are one item
        every = every[every.groupby("q").cumcount() < k]
        found = [every]
        # A full list of k raises the floor to its last entry.
        last = every.groupby("q")["score"].agg(["size", "min"])
        last = last[last["size"] == k]
        floors[last.index] = np.maximum(floors[last.index], last["min"])
    out = pd.concat(found) if found else pd.DataFrame({"q": [], "vec_id": [], "score": []})
    return pd.DataFrame({"query_id": queries.ids[out["q"].astype(int)], "vec_id": out["vec_id"], "score": out["score"]})


def _sample(rows: DataFrame, count: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` vectors, those with the least hash of their id."""
    bound = min(1.0, (most + 6 * math.isqrt(most)) / count) * 2.0**64 - 2.0**63
    frame = rows.withColumn("_hash", F.xxhash64("id")).filter(F.col("_hash") <= bound).toPandas()
    frame = frame.sort_values(["_hash", "id"]).drop_duplicates("id").head(most)
    return frame["id"].to_numpy(np.int64), np.stack(frame["vector"]).astype(np.float64)


def nearest(
    rows: DataFrame, queries: Column, k: int = 20, row_id: str = "vec_id", vector: str = "embedding",
    probes: float | None = None, deviations: float = DEVIATIONS, block: int = BLOCK, sample: int = SAMPLE,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that meets ``queries`` its k nearest other rows."""
    spark = rows.sparkSession
    result = "query_id bigint, vec_id bigint, score double"
    sizes = rows.filter(usable(vector)).groupBy(F.size(vector).alias("dims")).count()
    widest = sizes.orderBy(F.desc("count"), F.desc("dims")).first()
    if widest is None:
        empty = spark.createDataFrame([], result)
        return empty.select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    fit = usable(vector, widest.dims) & F.col(row_id).isNotNull()
    able = rows.filter(fit).select(F.col(row_id).cast("bigint").alias("id"), F.col(vector).alias("vector"),
                                   F.coalesce(queries, F.lit(False)).alias("asks"))
    ids, vectors = _sample(able.select("id", "vector"), widest["count"], sample)
    lists = max(1, min(len(ids) // 8, math.isqrt(widest["count"]) // 2))
    index = Index.fitted(ids, vectors, lists, widest["count"] // FLOOR_SHARE)
    visits = visits_for(index, ids, vectors, k) if probes is None else max(1, math.ceil(lists * probes))
    shared = spark.sparkContext.broadcast(index)

    def listed(frames):
        for frame in frames:
            own = np.stack(frame["vector"]).astype(np.float64) if len(frame) else np.zeros((0, widest.dims))
            yield frame.assign(list=shared.value.lists_of(own, 1)[:, 0].astype(np.int32))

    placed, _ = stage(able.mapInPandas(listed, f"id bigint, vector {able.schema['vector'].dataType.simpleString()}, "
                                               "asks boolean, list int"), "listed-vectors")
    held = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}
    asked = placed.filter("asks").count()
    slices = max(1, math.ceil(asked / QUERY_SLICE))
    blocks = [max(1, math.ceil(held.get(i, 0) / block)) for i in range(lists)]
    cuts = F.element_at(F.array(*map(F.lit, blocks)), F.col("list") + 1)
    kind = placed.schema["vector"].dataType.simpleString()

    def asking(frames):
        """Each query with its floor and the blocks it visits."""
        index = shared.value
        for frame in frames:
            for at in range(0, len(frame), 256):
                few = frame.iloc[at : at + 256]
                own = np.stack(few["vector"]).astype(np.float64)
                near = own @ index.vectors.T
                out = []
                for i, (query, visited) in enumerate(zip(few["id"], index.lists_of(own, visits), strict=True)):
                    # only vectors that the scan meets: a floor must not hide what it cannot give
                    other = np.flatnonzero((index.ids != query) & np.isin(index.lists, visited))
                    # a margin keeps ties at the edge, whose plain products may differ in the last digits
                    floor = np.partition(near[i, other], -k)[-k] - 1e-9 if len(other) >= k else -np.inf
                    out.append({
                        "id": query, "vector": few["vector"].iloc[i], "floor": floor,
                        "at": [{"list": int(x), "block": b} for x in visited for b in range(blocks[x])],
                    })
                yield pd.DataFrame(out, columns=["id", "vector", "floor", "at"])

    asks, _ = stage(placed.filter("asks").mapInPandas(
        asking, f"id bigint, vector {kind}, floor double, at array<struct<list: int, block: int>>"), "queries")
    slice_of = F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("slice")
    left = placed.select("list", F.pmod(F.xxhash64("id"), cuts).cast("int").alias("block"),
                         F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "id", "vector")
    right = asks.select(F.explode("at").alias("at"), slice_of, "id", "vector", "floor").select(
        "at.list", "at.block", "slice", "id", "vector", "floor")
    meet = ["list", "block", "slice"]

    def scan(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        index = shared.value
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        turned = [Scan.of(f["id"].to_numpy(np.int64), np.stack(f["vector"]).astype(np.float64), index.rotation, COLUMNS)
                  for f in (mine, theirs)]
        return scanned(*turned, theirs["floor"].to_numpy(np.float64), k, deviations)

    met = left.groupBy(*meet).cogroup(right.groupBy(*meet)).applyInPandas(scan, result)
    every = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
