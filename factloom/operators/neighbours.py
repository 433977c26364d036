"""The nearest vectors of a stated set of queries, exactly, block by block.

Each block of vectors meets each part of the queries once, as matrices. Products
of whole blocks screen what can be among a query's first k; what is left is
measured in the order in which ``functions.vectors`` adds, so that a cosine is
the same double. The work grows with queries times vectors, as an exact search
does; a task holds a block and a part of the queries.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import vectors as v
from factloom.operators import identity

#: Vectors of a block and queries of a part, about; pairs that are measured at once; queries of a product.
BLOCK, PART, PAIRS, STRIPE = 1 << 14, 1 << 13, 1 << 15, 128
#: How much a score may fall short of the k-th best of a block and still be as good when rounded to 6 digits.
MARGIN = 2e-6


def _sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row the sum of products, added from the first to the last."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _matrix(rows: pa.Table, name: str, size: int) -> np.ndarray:
    return np.asarray(rows.column(name).combine_chunks().flatten()).reshape(-1, size).astype(np.float64)


def _best(k: int, weight: float, size: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a block of vectors and a part of the queries: query_id, vec_id, cosine, bonus of what can be among the first k."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([asked.schema.field("query_id"), rows.schema.field("vec_id"), ("cosine", pa.float64()), ("bonus", pa.float64())])
        if not rows.num_rows or not asked.num_rows:
            return schema.empty_table()
        rows = rows.combine_chunks().sort_by("vec_id")  # equal scores come by id
        asked = asked.combine_chunks()
        x, q = _matrix(rows, "embedding", size), _matrix(asked, "query", size)
        ids, query_ids, bonus = rows.column("vec_id").to_numpy(), asked.column("query_id").to_numpy(), rows.column("bonus").to_numpy()
        long, query_long = np.sqrt(_sums(x, x)), np.sqrt(_sums(q, q))
        at_query, at_row, cosines = [], [], []
        for start in range(0, len(q), STRIPE):
            stripe = slice(start, start + STRIPE)
            score = weight * np.clip(q[stripe] @ x.T / (query_long[stripe][:, None] * long + 1e-10), 0, 1) + bonus
            score[query_ids[stripe][:, None] == ids] = -np.inf
            least = np.partition(score, -k, axis=1)[:, -k][:, None] if k < len(x) else -np.inf
            i, j = np.nonzero((score >= least - MARGIN) & (score > -np.inf))
            i += start
            exact = np.concatenate([_sums(q[i[s : s + PAIRS]], x[j[s : s + PAIRS]]) for s in range(0, len(i), PAIRS)] or [np.zeros(0)])
            exact = np.maximum(0.0, np.minimum(1.0, exact / (query_long[i] * long[j] + 1e-10)))
            # of equal scores the first k by id are enough
            order = np.lexsort((j, -(weight * exact + bonus[j]), i))
            i, j, exact = i[order], j[order], exact[order]
            value = weight * exact + bonus[j]
            new = np.append(True, (i[1:] != i[:-1]) | (value[1:] != value[:-1]))[: len(i)]
            place = np.arange(len(i)) - np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))
            at_query.append(i[place < k])
            at_row.append(j[place < k])
            cosines.append(exact[place < k])
        i, j = np.concatenate(at_query), np.concatenate(at_row)
        return pa.Table.from_arrays([asked.column("query_id").take(pa.array(i)), rows.column("vec_id").take(pa.array(j)), pa.array(np.concatenate(cosines)), pa.array(bonus[j])], schema=schema)

    return run


def top_by_cosine(queries: DataFrame, vectors: DataFrame, k: int, weight: float = 1.0, bonus: Column | None = None, blocks: int = 64) -> DataFrame:
    """query_id, vec_id, sim, place: the k vectors(vec_id, embedding) of each of
    queries(query_id, query) with the largest weight * cosine + bonus, rounded to 6 digits, then by id.

    A vector isn't its own neighbour. ``bonus`` is a number that a vector has
    besides. Vectors that are null, hold a null or no finite number, or aren't
    as long as the queries are scored as ``functions.vectors.cosine`` does, pair
    by pair. There are at least ``blocks`` blocks, and more for more vectors.
    """
    more = F.lit(0.0) if bonus is None else bonus.cast("double")
    lengths = queries.select(F.size("query").alias("n")).where("n > 0").agg(F.min("n")).first()
    size = lengths[0] or 0
    plain = lambda c: F.coalesce((F.size(c) == size) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    rows = vectors.where("vec_id IS NOT NULL").select("vec_id", "embedding", more.alias("bonus"), plain("embedding").alias("_plain"))
    asked = queries.where("query_id IS NOT NULL").select("query_id", "query", plain("query").alias("_plain"))
    many, odd = rows.agg(F.count("*"), F.count_if(~F.col("_plain") | F.col("bonus").isNull() | F.isnan("bonus"))).first()
    n_asked, odd_asked = asked.agg(F.count("*"), F.count_if(~F.col("_plain"))).first()
    n, parts = max(blocks, -(-many // BLOCK)), max(1, -(-n_asked // PART))
    good = F.col("_plain") & F.col("bonus").isNotNull() & ~F.isnan("bonus")
    dealt = rows.where(good).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).drop("_plain")
    every = asked.where("_plain").withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).drop("_plain")
    schema = T.StructType([queries.schema["query_id"], vectors.schema["vec_id"], T.StructField("cosine", T.DoubleType()), T.StructField("bonus", T.DoubleType())])
    # a block and a part, without their keys
    run = _best(k, weight, size)
    found = dealt.groupBy("block", "part").cogroup(every.groupBy("block", "part")).applyInArrow(run, schema)
    score = lambda cosine: F.round(F.lit(float(weight)) * cosine + F.col("bonus") if bonus is not None else F.lit(float(weight)) * cosine, 6)
    found = found.withColumn("sim", score(F.col("cosine"))).select("query_id", "vec_id", "sim")
    if odd or odd_asked:
        by_pair = score(v.cosine(F.col("query"), F.col("embedding")))
        rest = identity.top_neighbours(asked.drop("_plain"), rows.where(~good).drop("_plain"), by_pair, k, blocks).drop("place")
        found = found.union(rest).union(identity.top_neighbours(asked.where("NOT _plain").drop("_plain"), rows.where(good).drop("_plain"), by_pair, k, blocks).drop("place"))
    order = W.partitionBy("query_id").orderBy(F.desc("sim"), F.asc("vec_id"))
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query_id", "vec_id", "sim", "place")
