"""Exact largest inner products, with vectors by descending length and bounds from rotated partial sums."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triplicate.llm.common import map_batches, materialize, prepare, table
from triplicate.llm.vectors import first_rows, matrix, most_alike, vectors

#: Rows and queries that one task compares; a row is copied once for each ``QUERIES`` queries that may want it.
BLOCK, QUERIES = 16_384, 8_192
#: Bands of length; a band goes by its largest.
BANDS = 64
#: Rows, the longest of all, whose products give each query its first threshold.
HEAD = 2_048
_FOUND = "query_id long, vec_id long, score long"


#: From this size on products of two integers are no longer exact in doubles; scores end at the ends of a long.
_EXACT = 2.0**52
_ENDS = np.iinfo(np.int64)


def _spread(width: int, unit: float):
    def make():
        def step(batch: pa.RecordBatch) -> dict:
            x = matrix(batch.column("embedding").to_pandas(), width) / unit
            gram = x.T @ x
            return {"row": np.arange(len(gram), dtype=np.int32), "gram": list(gram)}

        return step

    return make


def rotation(rows: DataFrame, width: int, unit: float) -> np.ndarray:
    """Orthonormal directions by descending sum of squares over all rows: the right singular vectors of the table.

    Each batch gives its Gram matrix, summed in Spark; what comes to the driver is one matrix of the vectors' width.
    Components are divided by ``unit``, the longest length, so that sums stay finite.
    """
    parts = map_batches(rows, _spread(width, unit), "row int, gram array<double>").select("row", F.posexplode("gram").alias("column", "value"))
    cells = parts.groupBy("row", "column").agg(F.sum("value").alias("value")).collect()
    gram = np.zeros((width, width))
    for c in cells:
        gram[c["row"], c["column"]] = c["value"]
    return np.linalg.eigh(gram)[1][:, ::-1]


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Products of integers that doubles hold but whose sums they may not: by Python's integers, cut to a long's range."""
    as_ints = lambda rows: [[int(v) for v in row] for row in rows.tolist()]
    columns = as_ints(x)
    found = [[sum(a * b for a, b in zip(row, column, strict=True)) for column in columns] for row in as_ints(q)]
    return np.array([[min(max(v, _ENDS.min), _ENDS.max) for v in row] for row in found], np.int64).reshape(len(q), len(x))


class Pruned:
    """Rows compared with queries by descending length, with each query's ``k`` best so far.

    For the first ``h`` rotated components the product is summed; what the others can add is bounded by the product
    of both residual lengths. A row whose bound stays below the k-th best score of a query is dropped for it, and
    once the longest row left times a query's length stays below, so are all. Scores of what is left are exact.
    """

    def __init__(self, queries: np.ndarray, ids: np.ndarray, least: np.ndarray, turn: np.ndarray, k: int) -> None:
        self.q, self.ids, self.turn, self.k = queries, ids, turn, k
        self.length = np.linalg.norm(queries, axis=1)
        self.least = least.astype(np.float64)  # scores below it can't be among a query's best
        self.rotated = queries @ turn
        self.steps = sorted({max(1, turn.shape[1] // 8), max(1, turn.shape[1] // 2)})
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, vec_id), best first

    def put(self, x: np.ndarray, ids: np.ndarray) -> None:
        longest = float(np.linalg.norm(x, axis=1).max())
        # Thresholds lie within a long's range, so what may lie above it counts as lying at its end.
        alive = np.flatnonzero(self.length * longest * (1 + 1e-9) + 1e-6 >= self.least)
        if not len(alive):
            return
        r = x @ self.turn
        q = self.rotated[alive]
        open_ = np.ones((len(alive), len(x)), bool)
        for h in self.steps:
            rest = np.linalg.norm(q[:, h:], axis=1)[:, None] * np.linalg.norm(r[:, h:], axis=1)[None]
            bound = q[:, :h] @ r[:, :h].T + rest
            open_ &= ~(bound + 1e-9 * (self.length[alive][:, None] * longest) + 1e-3 < self.least[alive][:, None])
            if not open_.any():
                return
        columns = np.flatnonzero(open_.any(0))
        small = self.length[alive].max() * longest < _EXACT
        scores = (self.q[alive] @ x[columns].T).astype(np.int64) if small else _exact(self.q[alive], x[columns])
        wanted = self.k * most_alike(ids[columns])
        for i, a in enumerate(alive.tolist()):
            these = np.flatnonzero(open_[i, columns] & (ids[columns] != self.ids[a]) & (scores[i] >= self.least[a]))
            if len(these):
                s, v = scores[i, these], ids[columns[these]]
                order = np.lexsort((v, ~s))[:wanted]
                best: dict[int, int] = {}
                for score, vec in sorted([*self.best[a], *zip((-n for n in s[order].tolist()), v[order].tolist(), strict=True)]):
                    best.setdefault(vec, score)
                merged = [(score, vec) for vec, score in best.items()][: self.k]
                self.best[a] = merged
                if len(merged) == self.k:
                    self.least[a] = max(self.least[a], -merged[-1][0])

    def found(self) -> pd.DataFrame:
        rows = [(i, v, -s) for i, best in zip(self.ids.tolist(), self.best, strict=True) for s, v in best]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")


def _compare(turn: np.ndarray, k: int):
    def compare(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "vec_id", "score")})
        queries = queries.sort_values("query_id", ignore_index=True)
        rows = rows.sort_values(["length", "vec_id"], ascending=[False, True], ignore_index=True)
        x, ids = matrix(rows["embedding"], len(turn)), rows["vec_id"].to_numpy()
        keep = first_rows(ids, x)
        x, ids = x[keep], ids[keep]
        out = []
        for b in range(0, len(queries), 1024):
            part = queries.iloc[b : b + 1024]
            work = Pruned(matrix(part["query"], len(turn)), part["query_id"].to_numpy(), part["least"].fillna(-np.inf).to_numpy(), turn, k)
            for a in range(0, len(x), 1024):
                work.put(x[a : a + 1024], ids[a : a + 1024])
            out.append(work.found())
        return pd.concat(out, ignore_index=True)

    return compare


def _best(found: DataFrame, k: int) -> DataFrame:
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(embeddings: DataFrame, every: int = 100, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` largest inner products of floor(scale * x), ties to smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``; a query doesn't meet rows of its own vec_id. Vectors
    that are null or hold null or non-finite components take no part; a vector of zeros does. Queries with fewer
    candidates get them all. Rows that share a vec_id are one query, and one candidate, with the largest of their
    products. Scores beyond a long's range are its ends; shorter vectors end in zeros; an empty table gives no rows.
    Rows are dealt by bands of length, and within a band by hash, into blocks of at most about ``BLOCK``. The products
    with the longest rows come first and give all queries their thresholds. Queries are grouped by how long a row must be
    to reach theirs, and a block goes to the groups for which its band is long enough. What tasks carry along is a
    matrix of the vectors' width.
    """
    spark = embeddings.sparkSession
    prepare(spark)
    unit = F.lit(float(scale))
    whole_number = lambda x: F.when(F.abs(unit * x) < _EXACT, F.floor(unit * x).cast("double")).otherwise(unit * x)
    whole = vectors(embeddings, zero=True).select("vec_id", F.transform("embedding", whole_number).alias("embedding"))
    most = F.aggregate("embedding", F.lit(1.0), lambda acc, x: F.greatest(acc, F.abs(x)))
    length = F.element_at(F.transform(F.array(most), lambda m: m * F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + (x / m) * (x / m)))), 1)
    rows = materialize(whole.withColumn("length", length))
    seen = rows.agg(F.max(F.size("embedding")), F.max("length")).first()
    if seen[0] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    turn = rotation(rows, seen[0], max(1.0, seen[1]))
    edges = sorted(set(rows.approxQuantile("length", [b / BANDS for b in range(1, BANDS)], 0.005)))
    band = F.lit(0)
    for e in edges:
        band = band + (F.col("length") > e).cast("int")
    rows = rows.withColumn("band", band)
    # A row for each of at most BANDS bands: its longest row, where its blocks begin among all blocks, and how many it has.
    bands = {r["band"]: r for r in rows.groupBy("band").agg(F.count("*").alias("n"), F.max("length").alias("longest")).collect()}
    blocks = {b: math.ceil(r["n"] / BLOCK) for b, r in bands.items()}
    begins, places = {}, 0
    for b in sorted(bands):
        begins[b], places = places, places + blocks[b]

    def by_band(values: dict[int, int], band: str) -> Column:
        return F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), F.col(band))

    within = F.pmod(F.xxhash64("vec_id", F.hash("embedding")), by_band(blocks, "band"))
    dealt = rows.withColumn("place", (by_band(begins, "band") + within).cast("int"))
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), "length")

    # First thresholds, from the longest rows: k-th best scores of a part of the candidates.
    groups = max(1, math.ceil(queries.count() / QUERIES))
    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("chunk")
    head = rows.orderBy(F.desc("length"), "vec_id").limit(HEAD).select("vec_id", "embedding", "length", every_group)
    first = (
        queries.withColumns({"least": F.lit(None).cast("double"), "chunk": F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")})
        .groupBy("chunk")
        .cogroup(head.groupBy("chunk"))
        .applyInPandas(_compare(turn, k), _FOUND)
    )
    least = _best(first, k).where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("least"))
    # The shortest band with a row that may reach a query's threshold; it and all longer ones are searched for it.
    shortest = F
    for b in sorted(bands):
        shortest = shortest.when(F.col("least").isNull() | (F.col("length") * bands[b]["longest"] * (1 + 1e-9) + 1 >= F.col("least")), b)
    asked = materialize(queries.join(least, "query_id", "left").withColumn("shortest", shortest.otherwise(max(bands))))
    # Groups of queries for each such band, at most BANDS rows: how many, and which numbers they have.
    of_band = {r["shortest"]: math.ceil(r["n"] / QUERIES) for r in asked.groupBy("shortest").agg(F.count("*").alias("n")).collect()}
    begun, so_far, chunks = {}, {}, 0
    for b in sorted(bands):
        begun[b], chunks = chunks, chunks + of_band.get(b, 0)
        so_far[b] = chunks
    if not chunks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    group = F.pmod(F.xxhash64("query_id"), by_band({b: of_band.get(b) or 1 for b in bands}, "shortest"))
    wanted = F.explode(F.sequence(by_band(begins, "shortest"), F.lit(places - 1))).alias("place")
    asked = asked.select("query_id", "query", "least", (by_band(begun, "shortest") + group).cast("int").alias("chunk"), wanted)
    asking = F.sequence(F.lit(0), by_band(so_far, "band") - 1)
    copied = dealt.where(by_band(so_far, "band") > 0).select("place", F.explode(asking).alias("chunk"), "vec_id", "embedding", "length")
    keys = ["place", "chunk"]
    found = asked.groupBy(*keys).cogroup(copied.groupBy(*keys)).applyInPandas(_compare(turn, k), _FOUND)
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest integer inner products of every hundredth vector."""
    return search(table(spark, sf_dir, "embeddings"))
