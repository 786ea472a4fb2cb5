"""Exact top-k search by a Voronoi kNN join under the integer inner product."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm._shared import table

#: Pivots: the square root of the number of vectors, at most so many. They and their bounds are all that is broadcast.
MOST_PIVOTS = 256
#: Queries of a group and vectors of a block that meet in one task.
GROUP, BLOCK = 2048, 8192
#: Added to bounds, relative to the lengths multiplied: float errors are far below it.
SLACK = 1e-9


def quantized(column: str, scale: int = 256) -> F.Column:
    """floor(scale * x) of each component, x as double; null if the vector or a component is null or not finite."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(column, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where no sum can pass 2**53, else in integers of any size."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T if top < 2**62 else a.astype(object) @ b.T.astype(object)


def top_k_search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "vector", most_pivots: int = MOST_PIVOTS, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """query_id, rank, id, score: for each query the k vectors with the largest inner product, ties to the smaller id.

    vectors and queries have an id and an array<long>; a query's own id is no candidate for it.

    1. Pivots are vectors drawn by a hash. Each query belongs to its nearest pivot's cell. Vectors are not grouped: each is
       tested with its own length, a bound no looser than a cell's summary gives.
    2. A cell's queries are within radius R of pivot p, so a vector x scores between p.x - |x|R and p.x + |x|R with any
       of them. The k-th largest lower bound over all vectors is a score that each of the cell's queries reaches.
       Each task sums up its vectors as the k largest lower bounds of each cell.
    3. Cells are joined to groups of about `group` queries. A vector is sent to a group only if its upper bound for
       one of the group's cells reaches that cell's score; so vectors are replicated once for each group at most.
    4. A group's vectors are dealt into blocks, met by all of the group's queries; each block gives its k best, and
       these are ranked. No task holds more than about a block and a group, whatever the data's shape.

    Null ids or vectors take no part. Vectors of fewer components than the longest count as if zeros followed. Repeated
    query ids are one query, with the least vector; repeated candidates are each a candidate. Scores are 64-bit. An
    empty table gives no rows, and other columns don't matter.
    """
    spark = vectors.sparkSession
    data = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter("id is not null and v is not null")
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter("id is not null and v is not null")
    schema = "query_id long, rank int, vec_id long, score long"
    size = F.size("v")
    both = data.select(size.alias("n"), F.lit(1).alias("d")).union(asked.select(size, F.lit(0)))
    count, least, dim = both.agg(F.sum("d"), F.min("n"), F.max("n")).first()
    if not count:
        return spark.createDataFrame([], schema)
    dim = max(1, dim)
    if least < dim:
        data, asked = (x.select("id", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - size)).alias("v")) for x in (data, asked))
    asked = asked.groupBy("id").agg(F.min("v").alias("v"))
    n_pivots = min(most_pivots, math.isqrt(count - 1) + 1)
    pivots = np.array([r["v"] for r in data.orderBy(F.xxhash64("id", F.lit("pivots")), "id", "v").select("v").limit(n_pivots).collect()], np.float64)
    squares = (pivots**2).sum(axis=1)

    def cell_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1)).astype(np.float64)
                d2 = squares - 2 * (x @ pivots.T)
                near = d2.argmin(axis=1)
                far = np.sqrt(((x - pivots[near]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array(far)], ["id", "v", "cell", "far"])

    asked = table(asked.mapInArrow(cell_of, "id long, v array<long>, cell int, far double"), "queries")
    cells = asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).orderBy("cell").collect()  # at most n_pivots
    if not cells:
        return spark.createDataFrame([], schema)
    used = np.array([c["cell"] for c in cells])
    radius = np.array([c["radius"] for c in cells])
    centre = pivots[used]
    reach = np.sqrt(squares[used])

    def lower_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((0, len(used)), -np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0)).astype(np.float64)
            length = np.sqrt((x**2).sum(axis=1))[:, None]
            low = x @ centre.T - length * (radius + SLACK * (1 + radius + reach))
            best = np.concatenate([best, low])
            if len(best) > k:
                best = -np.partition(-best, k - 1, axis=0)[:k]
        if len(best):
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(len(used), dtype=np.int32), len(best))), pa.array(best.ravel())], ["cell", "low"])

    # of vectors that no query owns: so a query's own is never one of the k
    others = data.join(asked.select("id"), "id", "left_anti").select("v")
    found = others.mapInArrow(lower_bounds, "cell int, low double")
    order = Window.partitionBy("cell").orderBy(F.desc("low"))
    least = {r["cell"]: r["low"] for r in found.withColumn("n", F.row_number().over(order)).filter(F.col("n") == k).collect()}
    floor = np.array([least.get(i, -np.inf) for i in range(len(used))])

    # groups: cells in the order of a walk from pivot to nearest pivot, cut where the queries fill a group
    walk, rest = [0], set(range(1, len(used)))
    while rest:
        nxt = min(rest, key=lambda j: (((centre[walk[-1]] - centre[j]) ** 2).sum(), j))
        walk.append(nxt)
        rest.remove(nxt)
    group_of, at, filled = np.zeros(len(used), np.int32), 0, 0
    for c in walk:
        if filled and filled + cells[c]["n"] > group:
            at, filled = at + 1, 0
        group_of[c] = at
        filled += cells[c]["n"]
    groups = at + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1)).astype(np.float64)
            length = np.sqrt((x**2).sum(axis=1))[:, None]
            needed = x @ centre.T + length * (radius + SLACK * (1 + radius + reach)) >= floor
            for g in range(groups):
                rows = pa.array(np.flatnonzero(needed[:, group_of == g].any(axis=1)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), g, np.int32)), batch.column(0).take(rows), batch.column(1).take(rows)], ["g", "id", "v"])

    dealt = table(data.mapInArrow(deal, "g int, id long, v array<long>"), "dealt")
    blocks = {r["g"]: -(-r["count"] // block) for r in dealt.groupBy("g").count().collect()}  # a row for each group
    by_group = F.create_map(*[F.lit(x) for g in range(groups) for x in (g, blocks.get(g, 0))])
    by_cell = F.create_map(*[F.lit(x) for i, c in enumerate(used) for x in (int(c), int(group_of[i]))])
    parts = F.element_at(by_group, F.col("g"))
    left = dealt.select("g", F.pmod(F.xxhash64("id", "v"), parts).cast("int").alias("b"), F.lit(False).alias("asks"), "id", "v")
    right = asked.select(F.element_at(by_cell, F.col("cell")).alias("g"), "id", "v").filter(parts > 0)
    # a cell may have more queries than a group: then they are cut, too
    cut = {r["g"]: -(-r["count"] // (2 * group)) for r in right.groupBy("g").count().collect()}
    by_cut = F.create_map(*[F.lit(x) for g in range(groups) for x in (g, cut.get(g, 1))])
    cuts = F.element_at(by_cut, F.col("g"))
    left = left.withColumn("q", F.explode(F.sequence(F.lit(0), cuts - 1)))
    right = right.select("g", F.explode(F.sequence(F.lit(0), parts - 1)).alias("b"), F.lit(True).alias("asks"), "id", "v", F.pmod(F.xxhash64("id"), cuts).cast("int").alias("q"))
    met = left.unionByName(right).repartition("g", "b", "q").sortWithinPartitions("g", "b", "q", F.desc("asks"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["query_id", "vec_id", "score"]
        key, q_ids, q_vec, held = None, [], [], []

        def best() -> pa.RecordBatch:
            ids, vec = np.concatenate(q_ids), np.concatenate(q_vec)
            out: list[list[np.ndarray]] = [[], [], []]
            c_ids, c_vec = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(c_ids, kind="stable")  # so the smaller id comes first among equal scores
            c_ids, c_vec = c_ids[order], c_vec[order]
            for i in range(0, len(ids), 256):
                score = _products(vec[i : i + 256], c_vec)
                own = c_ids[None, :] == ids[i : i + 256, None]
                for r in range(len(score)):
                    free = np.flatnonzero(~own[r])
                    s = score[r][free]
                    if len(s) > k:
                        edge = np.partition(s, len(s) - k)[len(s) - k]
                        some = np.flatnonzero(s >= edge)
                        some = some[np.argsort(-s[some], kind="stable")][:k]
                    else:
                        some = np.argsort(-s, kind="stable")
                    out[0].append(np.full(len(some), ids[i + r]))
                    out[1].append(c_ids[free[some]])
                    out[2].append(s[some].astype(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            g, b, q, asks = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("g", "b", "q", "asks"))
            ids = batch.column(batch.schema.get_field_index("id")).to_numpy(zero_copy_only=False)
            vec = _matrix(batch.column(batch.schema.get_field_index("v")))
            edges = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (b[1:] != b[:-1]) | (q[1:] != q[:-1]) | (asks[1:] != asks[:-1])])
            for i, j in zip(edges, np.r_[edges[1:], len(g)]):
                if key != (g[i], b[i], q[i]):
                    if q_ids and held:
                        yield best()
                    key, q_ids, q_vec, held = (g[i], b[i], q[i]), [], [], []
                if asks[i]:
                    q_ids.append(ids[i:j]), q_vec.append(vec[i:j])
                else:
                    held.append((ids[i:j], vec[i:j]))
        if q_ids and held:
            yield best()

    near = met.mapInArrow(solve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op1(spark, sf_dir: str) -> DataFrame:
    """top_k_search over all embeddings, as integers, for those whose id is divisible by 50. Odd rows: see quantized and top_k_search."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", quantized("embedding").alias("vector"))
    return top_k_search(rows, rows.filter("vec_id % 50 = 0"), 5)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         coalesce(CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT), 0) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
