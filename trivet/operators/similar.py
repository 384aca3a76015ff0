"""The most similar vectors of a pool, of any size, exactly."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERY_ROWS, POOL_ROWS = 1_024, 8_192  # of a block; their products are 64 MB


def _usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Ids and unit vectors; vectors that are null, zero, or hold what is no number take no part."""
    v = F.col(vector_col).cast("array<double>")
    rows = rows.select(F.col(id_col).alias("id"), v.alias("v"))
    rows = rows.filter(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).filter("norm > 0 AND norm < double('Infinity')")
    return rows.select("id", F.transform("v", lambda x: x / F.col("norm")).alias("v"))


def most_similar(queries: DataFrame, pool: DataFrame, k: int = 2, query_id: str = "id", pool_id: str = "example_id", vector_col: str = "vector") -> DataFrame:
    """``id, examples array<struct<example_id, score>>``: the ``k`` vectors of the pool with the largest cosine, ties to the smaller id,
    for every query; queries without a usable vector have none. All vectors are of one length.

    Queries are a stated set; they and the pool are dealt into blocks of a bounded number of rows, each pair of blocks is one
    product, which leaves the ``k`` best of each query, and those lists are merged. Nothing is broadcast. Rows move as often as the other side has blocks.
    """
    q, p = _usable(queries, query_id, vector_col), _usable(pool, pool_id, vector_col)
    sides = max(1, math.ceil(q.count() / QUERY_ROWS)), max(1, math.ceil(p.count() / POOL_ROWS))
    place = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select("id", "v", place(sides[0]).alias("qb"), every(sides[1]).alias("pb"))
    right = p.select("id", "v", every(sides[0]).alias("qb"), place(sides[1]).alias("pb"))
    kinds = q.schema["id"].dataType.simpleString(), p.schema["id"].dataType.simpleString()

    def matrix(t: pa.Table) -> np.ndarray:
        flat = t.column("v").combine_chunks().flatten().to_numpy()
        return flat.reshape(t.num_rows, -1)

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        entry = pa.struct([("s", pa.float64()), ("example_id", b.schema.field("id").type)])
        names, out = b.column("id").to_pylist(), []
        if a.num_rows and b.num_rows:
            order = np.array(sorted(range(len(names)), key=lambda i: (names[i] is None, names[i])))
            rank = np.argsort(order)  # places by id
            for row in matrix(a) @ matrix(b).T:
                limit = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
                near = np.flatnonzero(row >= limit)
                near = near[np.lexsort((rank[near], -row[near]))][:k]
                out.append([{"s": -float(row[i]), "example_id": names[i]} for i in near])
        else:
            out = [[]] * a.num_rows
        return pa.table({"id": a.column("id"), "best": pa.array(out, pa.list_(entry))})

    blocks = left.groupBy("qb", "pb").cogroup(right.groupBy("qb", "pb")).applyInArrow(best, f"id {kinds[0]}, best array<struct<s:double,example_id:{kinds[1]}>>")
    merged = blocks.groupBy("id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"))  # k for each block of the pool
    listed = merged.select("id", F.transform("best", lambda x: F.struct(x["example_id"].alias("example_id"), (-x["s"]).alias("score"))).alias("examples"))
    none = F.array().cast(f"array<struct<example_id:{kinds[1]},score:double>>")
    asked = queries.select(F.col(query_id).alias("id")).distinct().alias("a")
    return asked.join(listed.alias("l"), F.col("a.id").eqNullSafe(F.col("l.id")), "left").select("a.id", F.coalesce("l.examples", none).alias("examples"))
