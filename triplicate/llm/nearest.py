"""Approximate nearest neighbours by learned partitions.

On a bounded sample a neighbour graph is cut into balanced parts, and a small classifier learns in which parts a
vector's neighbours lie. Every row is indexed under its most probable part; a query searches its several most probable parts and
ranks what it finds by exact distance.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triplicate.llm.common import map_batches, materialize, prepare, table
from triplicate.llm.vectors import first_rows, matrix, most_alike, smallest, squared, vectors

#: Rows to learn from at most, drawn by a hash of vec_id.
SAMPLE = 8_000
PARTS, PROBES = 16, 13
#: Neighbours of a vector in the graph.
DEGREE = 30
#: Rows of a part, and queries, that one task compares; a row is copied once for each ``QUERIES`` queries of its part.
BLOCK, QUERIES = 16_384, 8_192


def neighbour_graph(x: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Each row's nearest other rows, by brute force over the sample."""
    degree = min(degree, len(x) - 1)
    out = np.zeros((len(x), max(degree, 0)), np.int64)
    for a in range(0, len(x), 1024):
        d = squared(x[a : a + 1024], x)
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out[a : a + 1024] = np.argpartition(d, degree - 1, axis=1)[:, :degree] if degree > 0 else 0
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 0.1, rounds: int = 8) -> np.ndarray:
    """A part for each row: few edges of the graph across parts, no part larger than its share by more than ``slack``.

    Starts from repeated halving along the direction of most spread; then rows move, largest gain first, to the
    part of most of their neighbours while there is room.
    """
    label = np.zeros(len(x), np.int64)
    count = 1
    while count < parts:
        for p in range(count):
            rows = np.flatnonzero(label == p)
            if len(rows) > 1:
                centred = x[rows] - x[rows].mean(0)
                axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
                order = rows[np.argsort(centred @ axis, kind="stable")]
                label[order[len(order) // 2 :]] = p + count
        count *= 2
    room = math.ceil(len(x) / count * (1 + slack))
    for _ in range(rounds):
        votes = np.zeros((len(x), count), np.int32)
        for column in graph.T:
            votes[np.arange(len(x)), label[column]] += 1
            np.add.at(votes, (column, label), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), label]
        sizes = np.bincount(label, minlength=count)
        moved = 0
        for i in np.argsort(-gain, kind="stable").tolist():
            if gain[i] <= 0:
                break
            if sizes[best[i]] < room:
                sizes[label[i]] -= 1
                sizes[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if not moved:
            break
    return label


@dataclass
class Router:
    """One hidden layer between a vector and the probabilities of parts."""

    mean: np.ndarray
    scale: float
    hidden: tuple[np.ndarray, np.ndarray]
    out: tuple[np.ndarray, np.ndarray]

    def rank(self, x: np.ndarray) -> np.ndarray:
        """Parts from the most probable to the least."""
        h = np.maximum((x - self.mean) / self.scale @ self.hidden[0] + self.hidden[1], 0)
        return np.argsort(-(h @ self.out[0] + self.out[1]), axis=1, kind="stable")


def learn(x: np.ndarray, target: np.ndarray, width: int = 128, epochs: int = 40, rate: float = 3e-3) -> Router:
    """Fit the router by Adam on the cross-entropy with the parts of each row's neighbours, from a fixed seed."""
    parts = target.shape[1]
    rng = np.random.default_rng(0)
    mean, scale = x.mean(0), float(x.std()) or 1.0
    z = (x - mean) / scale
    p = [rng.normal(0, 1 / math.sqrt(z.shape[1]), (z.shape[1], width)), np.zeros(width), rng.normal(0, 1 / math.sqrt(width), (width, parts)), np.zeros(parts)]
    first, second, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for a in range(0, len(z), 512):
            rows = order[a : a + 512]
            h = np.maximum(z[rows] @ p[0] + p[1], 0)
            s = h @ p[2] + p[3]
            s = np.exp(s - s.max(1, keepdims=True))
            s /= s.sum(1, keepdims=True)
            s = (s - target[rows]) / len(rows)
            back = s @ p[2].T * (h > 0)
            grads = [z[rows].T @ back, back.sum(0), h.T @ s, s.sum(0)]
            t += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = p[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return Router(mean, scale, (p[0], p[1]), (p[2], p[3]))


def train(rows: DataFrame, width: int, sample: int = SAMPLE, parts: int = PARTS) -> Router:
    """The router of a table of vectors; it has no more parts than a quarter of the distinct vectors drawn."""
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    x = np.unique(matrix(drawn["embedding"], width), axis=0) if len(drawn) else np.zeros((1, width))
    while parts > max(1, len(x) // 4):
        parts //= 2
    graph = neighbour_graph(x)
    label = balanced_parts(x, graph, parts)
    target = np.zeros((len(x), parts))
    if graph.shape[1]:
        np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1 / graph.shape[1])
    return learn(x, target)


def _routed(router: Router, probes: int, width: int):
    def make():
        def step(batch: pa.RecordBatch) -> dict:
            with np.errstate(over="ignore", invalid="ignore"):  # overflowing vectors still get some part
                ranked = router.rank(matrix(batch.column("embedding").to_pandas(), width))[:, :probes]
            return {"vec_id": batch.column("vec_id"), "embedding": batch.column("embedding"), "parts": list(ranked.astype(np.int32))}

        return step

    return make


_FOUND = "query_id long, vec_id long, score double"


def _nearest(k: int, width: int):
    """The ``k`` nearest rows of a block for each query, one for each vec_id."""

    def compare(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(queries) and len(rows):
            x, ids = matrix(rows["embedding"], width), rows["vec_id"].to_numpy()
            keep = first_rows(ids, x)
            x, ids = x[keep], ids[keep]
            wanted = k * most_alike(ids)
            for a in range(0, len(queries), 64):
                part = queries.iloc[a : a + 64]
                q, qid = matrix(part["query"], width), part["query_id"].to_numpy()
                d = squared(q, x)
                own = qid[:, None] == ids[None]
                d[own] = np.inf
                with np.errstate(over="ignore", invalid="ignore"):
                    slack = np.nan_to_num(1e-9 * ((q * q).sum(1).max() + (x * x).sum(1).max()))
                    for i, near in enumerate(smallest(d, wanted, slack)):
                        near = near[~own[i, near]]
                        exact = np.sqrt(((x[near] - q[i]) ** 2).sum(1))
                        order = np.lexsort((ids[near], exact))
                        _, once = np.unique(ids[near[order]], return_index=True)
                        best = order[np.sort(once)[:k]]
                        out.append((np.full(len(best), qid[i]), ids[near[best]], exact[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    return compare


def search(embeddings: DataFrame, every: int = 100, k: int = 10, parts: int = PARTS, probes: int = PROBES, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest found by Euclidean distance, ties to smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``. Vectors that are null, zero or hold null or
    non-finite components take no part; nor does a query meet rows of its own vec_id. Where there are fewer
    candidates in the parts it searches a query gets them all. Rows that share a vec_id are one query, and one
    candidate, with the smallest of their distances. Distances that overflow are infinite and come last. Shorter vectors
    are compared as if they ended in zeros; an empty table gives no rows. Parts are dealt out in blocks of ``BLOCK`` rows
    by a hash, so a part that holds very many rows, copies of one vector say, takes more tasks, not longer ones; what is
    broadcast is the number of blocks of each part.
    """
    spark = embeddings.sparkSession
    prepare(spark)
    rows = materialize(vectors(embeddings, zero=False))
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 1
    router = train(rows, width, sample, parts)
    schema = "vec_id long, embedding array<double>, parts array<int>"
    indexed = map_batches(rows, _routed(router, 1, width), schema).select("vec_id", "embedding", F.col("parts")[0].alias("part"))
    indexed = materialize(indexed)
    blocks = indexed.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    indexed = indexed.join(F.broadcast(blocks), "part").withColumn("block", F.pmod(F.xxhash64("vec_id", F.hash("embedding")), "blocks").cast("int"))
    queries = map_batches(rows.where(F.col("vec_id") % every == 0), _routed(router, probes, width), schema)
    groups = max(1, math.ceil(queries.count() / QUERIES))
    queries = queries.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")).withColumn("part", F.explode("parts"))
    queries = queries.join(F.broadcast(blocks), "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    indexed = indexed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    keys = ["part", "block", "chunk"]
    found = (
        queries.select(*keys, F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
        .groupBy(*keys)
        .cogroup(indexed.select(*keys, "vec_id", "embedding").groupBy(*keys))
        .applyInPandas(_nearest(k, width), _FOUND)
    )
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    return search(table(spark, sf_dir, "embeddings"))
