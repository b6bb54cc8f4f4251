"""Exact nearest neighbours by distance, with optional conditions on metadata."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _best_of_task(asked: list[tuple], size: int, k: int, id_type: pa.DataType) -> Callable:
    """(query, id, distance) of each query's k nearest in a task: a matrix of squared distances a
    slice of vectors, exact ones for what comes near the k-th."""
    matrix = np.array([q[1] for q in asked], np.float64).reshape(len(asked), size)
    norms = np.einsum("ij,ij->i", matrix, matrix)
    only = None if asked[0][2] is None else np.array([q[2] for q in asked])
    own: dict = {}
    for n, q in enumerate(asked):
        own.setdefault(q[0], []).append(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[float, object]]] = [[] for _ in asked]
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, x = part.column("_id").to_pylist(), part.column("_v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
                square = np.einsum("ij,ij->i", x, x)[:, None] + norms[None, :] - 2 * (x @ matrix.T)
                if only is not None:
                    square[np.array(part.column("_f").to_pylist())[:, None] != only[None, :]] = np.inf
                for row, i in enumerate(ids):
                    if i in own:
                        square[row, own[i]] = np.inf
                for n in range(len(asked)):
                    column = square[:, n]
                    slack = 1e-9 * (1 + norms[n])
                    bound = held[n][-1][0] ** 2 + slack if len(held[n]) == k else np.inf
                    near = np.flatnonzero(column <= bound) if np.isfinite(bound) else np.flatnonzero(np.isfinite(column))
                    if len(near) > k:
                        near = near[column[near] <= np.partition(column[near], k - 1)[k - 1] + 2 * slack]
                    for row in near:
                        d = x[row] - matrix[n]
                        held[n].append((float(np.sqrt(np.sum(d * d))), ids[row]))
                    held[n] = sorted(held[n], key=lambda e: (e[0], e[1] is None, e[1]))[:k]
        flat = [(n, i, d) for n, found in enumerate(held) for d, i in found]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], pa.int32()), pa.array([f[1] for f in flat], id_type), pa.array([f[2] for f in flat], pa.float64())], names=["q", "_id", "distance"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", filter_col: str | None = None, block: int = 4096) -> DataFrame:
    """(query_id, id, distance, rank): a stated set of queries against all rows.

    Queries go to the tasks in blocks of about ``block``, vectors never move: a task compares its slices
    with a block as matrices and passes on the k nearest of each query. With ``filter_col``
    only rows that agree with the query in it count. A row is never its own neighbour;
    vectors that are null, of another length than the query or hold a null or non-finite component have none; of
    equal distances the smaller id comes first.
    """
    spark = vectors.sparkSession
    fine = lambda c: F.coalesce(F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    cast = lambda df: df.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"), *([F.col(filter_col).alias("_f")] if filter_col else [])).filter(fine(F.col("_v")) & (F.size("_v") > 0))
    every, asked = cast(vectors), cast(queries)
    if filter_col:
        every, asked = every.filter("_f IS NOT NULL"), asked.filter("_f IS NOT NULL")
    id_type = every.schema["_id"].dataType.simpleString()
    arrow_id = every.select("_id").limit(0).toArrow().schema.field("_id").type
    best = Window.partitionBy("query_id").orderBy("_distance", F.asc_nulls_last("_id"))
    out = None
    for size, n in [(r[0], r[1]) for r in asked.groupBy(F.size("_v")).count().collect()]:
        blocks = -(-n // block)
        for b in range(blocks):
            mine = asked.filter((F.size("_v") == size) & (F.pmod(F.xxhash64("_id"), F.lit(blocks)) == b)).collect()
            if not mine:
                continue
            rows = [(r._id, list(r._v), r._f if filter_col else None) for r in mine]
            names = spark.createDataFrame([(q, r[0]) for q, r in enumerate(rows)], f"q int, query_id {id_type}")
            found = every.filter(F.size("_v") == size).mapInArrow(_best_of_task(rows, size, k, arrow_id), f"q int, _id {id_type}, distance double")
            one = found.join(F.broadcast(names), "q").select("query_id", "_id", F.col("distance").alias("_distance"))
            out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], f"query_id {id_type}, {id_col} {id_type}, distance double, rank int")
    ranked = out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("_id").alias(id_col), F.round("_distance", 4).alias("distance"), "rank")


def from_other_sources(vectors: DataFrame, queries: DataFrame, source_col: str, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest of each query without those of its own source, which are known already;
    ranks stay as they were. Rows without a source are of no one's."""
    found = nearest(vectors, queries, k, id_col, vector_col)
    source = vectors.select(F.col(id_col), F.col(source_col).alias("_s")).distinct()
    asked = queries.select(F.col(id_col).alias("query_id"), F.col(source_col).alias("_q")).distinct()
    both = found.join(asked, "query_id", "left").join(source, id_col, "left")
    return both.filter(~F.coalesce(F.col("_s") == F.col("_q"), F.lit(False))).select("query_id", id_col, "distance", "rank")


#: What past corrections each agent looks for; fixed values.
FOCUS = {
    "search": "page classification errors, wrong page type, reclassify page, lighting plan misidentified",
    "schedule": "schedule extraction errors, missing fixture type, wrong fixture code, extra fixture, VLM misread",
    "count": "fixture count correction, overcounting, undercounting, short code ambiguity, vision counting",
    "keynote": "keynote count correction, keynote missed, keynote false positive, geometric detection",
    "qa": "QA confidence issue, validation failure, count mismatch, low confidence score",
}


def focus_text(agent: F.Column) -> F.Column:
    """The text whose neighbours an agent asks for; "" for an unknown agent."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for e in FOCUS.items() for x in e]), agent), F.lit(""))
