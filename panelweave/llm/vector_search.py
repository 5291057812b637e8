"""Exact top-k inner products with a vector-approximation file.

Every dimension is cut into 2**bits cells. The scan reads cell numbers only:
a query's inner product with a vector lies between sums over the corners of
the vector's cells. Vectors whose upper bound reaches the kth best lower bound
are candidates. Exact vectors are then read in batches, in the order of upper
bounds; only queries whose kth score may still be beaten by a bound left read
the next batch, which is larger.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from panelweave.plans.storage import durable

VECTOR = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("dim", T.IntegerType()), T.StructField("x", T.ArrayType(T.LongType()))])


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(vec_id, dim, x): floor(scale * component), of vectors that are not null and have only finite components."""
    c = F.col(vector_col)
    sound = c.isNotNull() & F.col(id_col).isNotNull() & F.forall(c, lambda v: F.coalesce(~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")), F.lit(False)))
    return vectors.filter(sound).select(F.col(id_col).cast("long").alias("vec_id"), F.size(c).alias("dim"), F.transform(c, lambda v: F.floor(v.cast("double") * scale)).alias("x"))


def _cells(bounds: dict, dim: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Least value and cell width per dimension."""
    low, high = bounds[dim]
    return low.astype(float), (high - low + 1) / float(1 << bits)


def _quantise(batches, bounds, bits):
    for batch in batches:
        ids, dims = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        codes = [None] * batch.num_rows
        for dim in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == dim)
            x = batch.column(2).take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), dim)
            low, width = _cells(bounds, dim, bits)
            cell = np.clip(np.floor((x - low) / width), 0, (1 << bits) - 1).astype(np.uint8)
            for k, row in zip(rows.tolist(), cell):
                codes[k] = row.tobytes()
        yield pa.RecordBatch.from_arrays([ids, batch.column(1), batch.column(3), pa.array(codes, pa.binary())], names=["vec_id", "dim", "row", "cells"])


def _scan(key, queries: pd.DataFrame, cells: pd.DataFrame, bounds, bits, k) -> pd.DataFrame:
    """Candidates of a block of queries in a block of cells, by rows: upper and lower bounds."""
    out = {"query": [], "vec": [], "upper": [], "lower": []}
    if len(queries) and len(cells):
        dim = int(key[0])
        low, width = _cells(bounds, dim, bits)
        code = np.frombuffer(b"".join(cells.cells), np.uint8).reshape(len(cells), dim).astype(float)
        floor, ceil = np.ceil(low + code * width - 1e-9), np.floor(low + (code + 1) * width + 1e-9)
        ids, rows = cells.vec_id.to_numpy(), cells.row.to_numpy()
        for at in range(0, len(queries), 64):
            part = queries.iloc[at : at + 64]
            q = np.array(part.x.tolist(), float).reshape(len(part), dim)
            plus, minus = np.maximum(q, 0), np.minimum(q, 0)
            upper, lower = plus @ ceil.T + minus @ floor.T, plus @ floor.T + minus @ ceil.T
            other = ids[None, :] != part.vec_id.to_numpy()[:, None]
            lower = np.where(other, lower, -np.inf)
            kth = np.partition(lower, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(part), -np.inf)
            row, col = np.nonzero(other & (upper >= kth[:, None]))
            out["query"].append(part.row.to_numpy()[row])
            out["vec"].append(rows[col])
            out["upper"].append(upper[row, col])
            out["lower"].append(lower[row, col])
    return pd.DataFrame({c: np.concatenate(v) if v else np.empty(0, float if c in ("upper", "lower") else int) for c, v in out.items()})


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0).cast("long"), lambda acc, v: acc + v)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, bits: int = 6, block: int = 8192, query_block: int = 1024, batch: int = 16) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query, ties to smaller vec_id.

    Both tables have the columns of integer_vectors(); a query's own vec_id is
    no candidate. Vectors are compared within their dimension only. Of equal
    vectors the k + 1 with the smallest ids represent all: more cannot be in a
    result. Rows that repeat an id and vector count once; rows of one id with
    different vectors are queries, and candidates, each (a query's rows are then
    k for each of its vectors, and an id can be ranked twice). A query has fewer
    than k rows if there are fewer candidates; empty tables give no rows.

    Queries meet vectors in blocks. bits is 8 at most. The first batch has
    ``batch`` candidates of each query, each later one four times as many as
    that before. A score beyond 64 bits raises an arithmetic error.
    """
    vectors, queries = vectors.distinct(), queries.distinct()
    # ranks within equal vectors are limited before the shuffle, so a common vector does not gather
    same = Window.partitionBy("dim", "x").orderBy("vec_id")
    kept = durable(vectors.withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= k + 1).drop("nth").withColumn("row", F.monotonically_increasing_id()), "vectors")
    queries = durable(queries.withColumn("row", F.monotonically_increasing_id()), "queries")
    ends = kept.select("dim", F.posexplode("x").alias("at", "v")).groupBy("dim", "at").agg(F.min("v").alias("low"), F.max("v").alias("high")).toPandas().sort_values(["dim", "at"])
    bounds = {int(d): (g.low.to_numpy(), g.high.to_numpy()) for d, g in ends.groupby("dim")}  # two numbers a dimension
    bounds[0] = (np.empty(0, int), np.empty(0, int))
    cells = durable(kept.mapInArrow(partial(_quantise, bounds=bounds, bits=bits), "vec_id long, dim int, row long, cells binary"), "cells")

    def blocks(df: DataFrame, size: int) -> tuple[DataFrame, int]:
        n = max(1, -(-df.count() // size))
        return df.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")), n

    left, nl = blocks(queries, query_block)
    right, nr = blocks(cells, block)
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(nr - 1)))).select("dim", F.col("part").alias("qb"), F.col("other").alias("vb"), "row", "vec_id", "x")
    right = right.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(nl - 1)))).select("dim", F.col("other").alias("qb"), F.col("part").alias("vb"), "row", "vec_id", "cells")
    scan = lambda key, q, v: _scan(key, q, v, bounds, bits, k)
    found = durable(left.groupBy("dim", "qb", "vb").cogroup(right.groupBy("dim", "qb", "vb")).applyInPandas(scan, "query long, vec long, upper double, lower double"), "candidates")
    # row numbers under a limit are cut within tasks first, so a query's candidates never gather in one
    best = Window.partitionBy("query").orderBy(F.col("lower").desc(), "vec")
    kth = found.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k).groupBy("query").agg(F.when(F.count("*") == k, F.min("lower")).alias("kth"))
    left = durable(found.join(kth, "query").filter(F.col("kth").isNull() | (F.col("upper") >= F.col("kth"))).select("query", "vec", "upper"), "bounds")
    asked = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), "dim", F.col("x").alias("q"))
    exact = kept.select(F.col("row").alias("vec"), "vec_id", "dim", "x")
    in_order = Window.partitionBy("query").orderBy(F.col("upper").desc(), "vec")
    by_score = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    scored = None
    while True:
        now = left.withColumn("nth", F.row_number().over(in_order)).filter(F.col("nth") <= batch)
        read = now.join(exact, "vec").join(asked, ["query", "dim"])
        read = read.select("query", "query_id", "vec_id", _dot(F.col("q"), F.col("x")).alias("score"))
        # only the k best so far matter; a query's last bound read tells what is left of it
        ranked = read if scored is None else read.unionByName(scored)
        scored = durable(ranked.withColumn("nth", F.row_number().over(by_score)).filter(F.col("nth") <= k).drop("nth"), "scores")
        last = now.filter(F.col("nth") == batch).select("query", F.col("upper").alias("last"), F.col("vec").alias("last_vec"))
        least = scored.groupBy("query").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
        unread = (F.col("upper") < F.col("last")) | ((F.col("upper") == F.col("last")) & (F.col("vec") > F.col("last_vec")))
        left = left.join(last.join(least, "query", "left"), "query").filter(unread & (F.col("kth").isNull() | (F.col("upper") >= F.col("kth"))))
        left = durable(left.select("query", "vec", "upper"), "bounds")
        if left.isEmpty():
            break
        batch *= 4
    return scored.select("query_id", F.row_number().over(by_score).alias("rank"), "vec_id", "score")
