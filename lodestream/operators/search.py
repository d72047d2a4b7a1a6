"""Vector and word search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Query vectors of one block; each block is one pass over the vectors with its queries sent to the tasks.
BLOCK = 10_000
#: Vectors that a task multiplies with the block at once; bounds the matrix of scores.
ROWS_AT_ONCE = 2_000
#: Scores are rounded to four places, so that a vector this far below the k-th can still tie with it.
_ROUNDING = 1e-4


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are whole vectors, their unit vectors); null, empty and zero vectors have no direction."""
    rows = [v if v is not None and v.values is not None and len(v.values) and not v.values.null_count else None for v in column]
    size = max((len(v.values) for v in rows if v is not None), default=0)
    at = np.array([i for i, v in enumerate(rows) if v is not None and len(v.values) == size], np.int64)
    m = np.array([rows[i].values.to_numpy(zero_copy_only=False) for i in at], np.float64).reshape(len(at), size)
    norms = np.linalg.norm(m, axis=1) if len(at) else np.zeros(0)
    whole = np.isfinite(norms) & (norms > 0)
    return at[whole], m[whole] / norms[whole, None]


def top_k(vectors_df: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int, least: float, block: int = BLOCK) -> DataFrame:
    """query_id, id, score: the k most similar vectors of each query with at least the least cosine; ties by id.

    ``queries`` (query_id, query_vector) is a stated set that is met in blocks of at most ``block`` vectors. A task
    multiplies its vectors with the block by one matrix product after the other and keeps what can be among the k best
    of its own, so that what is shuffled is some k rows for each query and task. Exact: no index, no candidate is left
    out. Null, empty and zero vectors, and those of another length, are similar to none.
    """
    n_blocks = max(1, -(-queries.count() // block))
    rows = vectors_df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("_v"))
    id_type = rows.schema["id"].dataType.simpleString()
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    out = None
    for i in range(n_blocks):
        some = queries if n_blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == i)
        asked = some.select(F.monotonically_increasing_id().alias("_q"), "query_id", F.col("query_vector").cast("array<double>").alias("v")).toArrow()
        kept, matrix = _matrix(asked.column("v").combine_chunks())
        shipped = vectors_df.sparkSession.sparkContext.broadcast(matrix)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            q = shipped.value
            ids: list[pa.Array] = []
            best_q, best_row, best_score, n = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0
            for whole in batches:
                for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                    batch = whole.slice(start, ROWS_AT_ONCE)
                    at, m = _matrix(batch.column(1))
                    if not len(at) or not len(q) or m.shape[1] != q.shape[1]:
                        continue
                    scores = q @ m.T
                    edge = np.full(len(q), least - _ROUNDING)
                    if len(at) > k:
                        edge = np.maximum(edge, np.partition(scores, len(at) - k, axis=1)[:, len(at) - k] - _ROUNDING)
                    qi, vi = np.nonzero(scores >= edge[:, None])
                    taken, back = np.unique(vi, return_inverse=True)
                    ids.append(batch.column(0).take(pa.array(at[taken])))
                    best_q, best_row, best_score = np.concatenate([best_q, qi]), np.concatenate([best_row, back + n]), np.concatenate([best_score, scores[qi, vi]])
                    n += len(taken)
                    if len(best_q) > 4 * k * max(1, len(q)):
                        keep = _best(best_q, best_score, k)
                        best_q, best_row, best_score = best_q[keep], best_row[keep], best_score[keep]
                        used, best_row = np.unique(best_row, return_inverse=True)
                        ids, n = [pa.concat_arrays(ids).take(pa.array(used))], len(used)
            if len(best_q):
                keep = _best(best_q, best_score, k)
                yield pa.RecordBatch.from_arrays([pa.array(best_q[keep]), pa.concat_arrays(ids).take(pa.array(best_row[keep])), pa.array(best_score[keep])], names=["_q", "id", "score"])

        names = some.sparkSession.createDataFrame(pa.table({"_q": pa.array(np.arange(len(kept)), pa.int64()), "query_id": asked.column("query_id").combine_chunks().take(pa.array(kept))}))
        hits = rows.mapInArrow(run, f"_q long, id {id_type}, score double").join(F.broadcast(names), "_q").select("query_id", "id", F.round("score", 4).alias("score"))
        best = hits.filter(F.col("score") >= least).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")
        out = best if out is None else out.unionByName(best)
    return out


def _best(query: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the scores that are, but for rounding, among the k best of their query."""
    order = np.lexsort((-score, query))
    q, s = query[order], score[order]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    size = np.diff(np.r_[start, len(q)])
    edge = np.repeat(s[start + np.minimum(size, k) - 1], size)
    return order[s >= edge - _ROUNDING]


def best_of_queries(hits: DataFrame) -> DataFrame:
    """id, score, query_id: each hit at its best query."""
    return hits.groupBy("id").agg(F.max("score").alias("score"), F.min_by("query_id", F.struct(-F.col("score"), F.col("query_id"))).alias("query_id"))


def inverted_index(documents: DataFrame, id_col: str, words) -> DataFrame:
    """term, id, tf of every document's words."""
    return documents.select(F.col(id_col).alias("id"), F.explode(words).alias("term")).filter(F.col("term") != "").groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))
