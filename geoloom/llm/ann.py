"""Approximate nearest neighbours by cosine: inverted lists searched by adaptive dimension scans.

The index is fitted on a bounded sample (FIT_ROWS rows by a hash of the id): centroids, a random rotation, and the
number of lists to probe so that the sample's own neighbours are found with RECALL. Every row is indexed: lists are
packed in chunks of about CHUNK vectors, hot lists in many, and queries in chunks a list, so no task holds a whole
list. In a chunk, rotated vectors are scanned by blocks of dimensions; from its partial distance a candidate is
given up when a hypothesis test says it can't beat the query's threshold: the distance of its `top`-th id in the
sample, or of its `top`-th id found in the chunk so far. What survives is scored exactly on the original vectors in double precision, and so are the query's nearest ids
in the sample, which are candidates too: each query gets `top` rows. If the sample has fewer ids, all lists are probed.

Vectors that are null, zero, of another length than most, or hold a null or non-finite component take no part, nor
do rows with a null id. Rows that share an id count once (the nearest of them). Equal scores go to the smaller id.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

FIT_ROWS, FIT_QUERIES, ROUNDS = 20_000, 256, 8
RECALL = 0.97
CHUNK, QUERIES = 4096, 256
#: Rows of a chunk after whose scan a query's threshold is tightened by what has been found.
STRETCH = 1024
BLOCK = 16
#: Width of the hypothesis test: larger gives up later.
EPSILON = 2.1


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Index:
    """Centroids, rotation and probes of a fitted sample, and the sample itself for thresholds."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rows: int, top: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        dims = vectors.shape[1]
        self.rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.sample = _unit(self.vectors).astype(np.float32)
        self.distinct, self.starts = np.unique(self.ids, return_index=True)
        lists = int(min(max(1, math.isqrt(rows)), max(1, len(ids) // 8)))
        centroids = self.sample[rng.choice(len(ids), lists, replace=False)]
        for _ in range(ROUNDS):
            own = self._nearest(self.sample, centroids)
            sums = np.zeros((lists, dims))
            np.add.at(sums, own, self.sample)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            centroids = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centroids).astype(np.float32)
        self.centroids = centroids
        self.probes = self._calibrated(top, rng)

    @staticmethod
    def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        return np.concatenate([(x[i : i + 4096] @ centroids.T).argmax(axis=1) for i in range(0, len(x), 4096)])

    def _calibrated(self, top: int, rng) -> int:
        """Probes after which RECALL of the sample's true neighbours have been met."""
        own = self._nearest(self.sample, self.centroids)
        asked = rng.choice(len(self.ids), min(FIT_QUERIES, len(self.ids)), replace=False)
        ranks = []
        for q in asked:
            near = self.sample @ self.sample[q]
            near[self.ids == self.ids[q]] = -2
            best = np.argsort(-near, kind="stable")
            best = best[np.sort(np.unique(self.ids[best], return_index=True)[1])[:top]]
            order = np.argsort(np.argsort(-(self.centroids @ self.sample[q]), kind="stable"), kind="stable")
            ranks += order[own[best[near[best] > -2]]].tolist()
        if not ranks:
            return len(self.centroids)
        return int(min(len(self.centroids), np.quantile(ranks, RECALL, method="higher") + 1))

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        return self._nearest(_unit(vectors).astype(np.float32), self.centroids)

    def asked(self, ids: np.ndarray, vectors: np.ndarray, top: int) -> tuple[list, np.ndarray, list, list]:
        """For each query the lists to probe, a squared distance within which top ids lie, and the sample's nearest ids and their scores."""
        unit = _unit(vectors).astype(np.float32)
        n = len(self.centroids)
        lists = np.argsort(-(unit @ self.centroids.T), axis=1, kind="stable")
        near = np.maximum.reduceat(unit @ self.sample.T, self.starts, axis=1)  # of each distinct id
        near[self.distinct[None, :] == ids[:, None]] = -2
        k = min(top, near.shape[1])
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        kth = np.take_along_axis(near, best, axis=1).min(axis=1)
        enough = (kth > -2) & (k >= top)
        bound = np.where(enough, 2 - 2 * kth.astype(np.float64) + 1e-5, 4.1)
        ends, norms, found, scores = np.r_[self.starts[1:], len(self.ids)], np.sqrt((vectors * vectors).sum(axis=1)), [], []
        for q, row in enumerate(best):
            row = row[near[q, row] > -2]
            found.append(self.distinct[row].tolist())
            own = [self.vectors[self.starts[i] : ends[i]] for i in row]
            scores.append([float(((x * vectors[q]).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * norms[q])).max()) for x in own])
        return [x[: min(self.probes, n) if e else n].tolist() for x, e in zip(lists, enough)], bound, found, scores


def scan(query: np.ndarray, turned: np.ndarray, columns: np.ndarray, bound: float) -> np.ndarray:
    """Rows of the chunk that survive the adaptive scan; columns is (dims, rows) of rotated unit vectors."""
    dims = len(turned)
    alive, partial = np.arange(columns.shape[1]), np.zeros(columns.shape[1])
    for at in range(0, dims, BLOCK):
        part = columns[at : at + BLOCK]
        gap = (part if len(alive) == part.shape[1] else part[:, alive]) - turned[at : at + BLOCK, None]
        partial += np.einsum("ij,ij->j", gap, gap)
        seen = min(at + BLOCK, dims)
        slack = (1 + EPSILON / math.sqrt(seen)) ** 2 if seen < dims else 1.0
        keep = partial * (dims / seen) <= bound * slack + 1e-6
        if not keep.all():
            alive, partial = alive[keep], partial[keep]
        if not len(alive):
            break
    return alive


def search_chunk(queries, bounds, query_ids, vectors, ids, rotation, top: int):
    """(query id, candidate id, cosine) of the best `top` distinct ids of a chunk for each query."""
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    columns = np.ascontiguousarray(((vectors / norms[:, None]) @ rotation).T)
    asked = np.sqrt((queries * queries).sum(axis=1))
    turned = (queries / asked[:, None]) @ rotation
    for q in range(len(queries)):
        bound, best = bounds[q], {}
        for at in range(0, len(ids), STRETCH):
            alive = at + scan(queries[q], turned[q], columns[:, at : at + STRETCH], bound)
            alive = alive[ids[alive] != query_ids[q]]
            if not len(alive):
                continue
            score = (vectors[alive] * queries[q]).sum(axis=1) / (norms[alive] * asked[q])
            for i, x in zip(ids[alive].tolist(), score.tolist()):
                best[i] = max(x, best.get(i, -2.0))
            ranked = sorted(best.items(), key=lambda r: (-r[1], r[0]))[:top]
            best = dict(ranked)
            if len(ranked) == top:  # ids that are left out can't come back: their rows so far are worse than all of these
                bound = min(bound, 2 - 2 * ranked[-1][1] + 1e-9)
        for i, x in sorted(best.items(), key=lambda r: (-r[1], r[0])):
            yield int(query_ids[q]), int(i), float(x)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v (array of doubles) of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    sane = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.filter(sane)
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    return rows.filter(F.size("v") == (most[0] if most else 0))


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def nearest(
    vectors: DataFrame, queries, id_col: str = "vec_id", vec_col: str = "embedding", top: int = 5
) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` nearest rows found for each row whose id makes queries(id) true."""
    spark = vectors.sparkSession
    rows = cut(usable(vectors.select(F.col(id_col).alias(id_col), vec_col), id_col, vec_col))
    total = rows.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / (1 << 30)
    sample = rows.filter(place < min(1.0, FIT_ROWS / total)).orderBy("id").collect() if total > FIT_ROWS else rows.orderBy("id").collect()
    sample = sample or rows.limit(1).collect()
    index = spark.sparkContext.broadcast(
        Index(np.array([r[0] for r in sample]), np.array([r[1] for r in sample]), total, top)
    )

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            if len(batch):
                own = index.value.assign(_matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], ["id", "v", "list"])

    indexed = cut(rows.mapInArrow(assign, "id long, v array<double>, list int"))
    sizes = indexed.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).alias("n_chunks"))  # a row for each list, FIT_ROWS / 8 at most
    chunks = (
        indexed.join(F.broadcast(sizes), "list")
        .groupBy("list", F.pmod(F.xxhash64("id"), F.col("n_chunks")).alias("chunk"))
        .agg(F.collect_list(F.struct("id", "v")).alias("rows"))
    )

    def probe(batches):
        import pyarrow as pa

        for batch in batches:
            if not len(batch):
                continue
            lists, bound, near, scores = index.value.asked(batch.column("id").to_numpy(), _matrix(batch.column("v")), top)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lists, pa.list_(pa.int32())), pa.array(bound, pa.float64()),
                 pa.array(near, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))],
                ["id", "v", "lists", "bound", "near", "scores"],
            )

    wanted = rows.filter(queries(F.col("id")))
    kinds = "id long, v array<double>, lists array<int>, bound double, near array<long>, scores array<double>"
    asked = cut(wanted.mapInArrow(probe, kinds))
    by_list = asked.select("id", F.explode("lists").alias("list")).groupBy("list").agg(F.ceil(F.count("*") / QUERIES).alias("n_parts"))
    packed = (
        asked.select("id", "v", "bound", F.explode("lists").alias("list"))
        .join(F.broadcast(by_list), "list")  # a row for each list
        .groupBy("list", F.pmod(F.xxhash64("id"), F.col("n_parts")).alias("part"))
        .agg(F.collect_list(F.struct("id", "v", "bound")).alias("asked"))
    )
    pairs = chunks.join(packed, "list").select("rows", "asked")

    def search(batches):
        import pyarrow as pa

        rotation = index.value.rotation
        for batch in batches:
            found = []
            for cand, ask in zip(batch.column("rows"), batch.column("asked")):
                c, q = cand.values, ask.values
                found += search_chunk(
                    _matrix(q.field("v")), np.asarray(q.field("bound")), np.asarray(q.field("id")),
                    _matrix(c.field("v")), np.asarray(c.field("id")), rotation, top,
                )
            a, b, s = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"]
            )

    found = pairs.mapInArrow(search, "query_id long, vec_id long, score double")
    sampled = asked.select(F.col("id").alias("query_id"), F.explode(F.arrays_zip("near", "scores")).alias("x"))
    found = found.unionByName(sampled.select("query_id", F.col("x.near").alias("vec_id"), F.col("x.scores").alias("score")))
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return once.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").filter(F.col("rank") <= top)
