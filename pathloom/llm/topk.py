"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

A vector component is a term and its value the posting's weight.  Candidates
are packed into blocks; a block is inverted into one posting list per term.
Query rows keep their non-zero terms only and are packed into blocks of a fixed
number.  For each pair of blocks, each query term scatters its weighted posting
list into the query's dense score array; then a partition selection takes the
best k of the block.  A task carries the best k of each query over all its
candidate blocks, so what is shuffled is k rows per query and task, and a last
merge by query gives the result.

The query set grows with the input, so its blocks are broadcast only after a
check of their size; beyond it Spark pairs the blocks by a shuffled product of
block numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.common import keep, ship

#: Query blocks up to this many bytes are broadcast.
BROADCAST_BYTES = 64 << 20
#: No partial sum of int64 products may reach this.
_SAFE = 1 << 62

_BLOCK = "kind int, ids binary, n int, dims int, words binary"


def usable(column: Column) -> Column:
    """Neither null nor holding a null, NaN or infinite component."""
    good = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return column.isNotNull() & F.coalesce(good, F.lit(False))


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, exact: int64, or Python integers where some pass 62 bits."""
    if values.dtype == np.int64:
        return values * scale if int(np.abs(values).max(initial=0)) * scale < _SAFE and values.min(initial=0) > -_SAFE else values.astype(object) * scale
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    if np.abs(scaled).max(initial=0) < _SAFE:
        return scaled.astype(np.int64)
    # a double of 2^53 or more is an integer; below, the product with the scale is in range
    exact = [int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale) for x in values.reshape(-1).tolist()]
    return np.array([*exact, None], object)[:-1].reshape(values.shape)


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores of all queries (rows) against all candidates, term at a time.

    Exact: where products could pass 62 bits the sums are Python integers.
    """
    dims = min(queries.shape[1], candidates.shape[1])
    most = int(abs(queries).max(initial=0)) * int(abs(candidates).max(initial=0)) * max(dims, 1)
    kind = np.int64 if most < _SAFE else object
    scores = np.zeros((len(queries), len(candidates)), kind)
    for term in range(dims):
        users = np.flatnonzero(queries[:, term])
        posting = np.flatnonzero(candidates[:, term])
        if not len(users) or not len(posting):
            continue
        weights, values = queries[users, term].astype(kind), candidates[posting, term].astype(kind)
        if len(users) == len(queries) and len(posting) == len(candidates):
            scores += weights[:, None] * values[None, :]
        else:
            scores[np.ix_(users, posting)] += weights[:, None] * values[None, :]
    return scores


def select_best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by (score descending, id ascending)."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        rows = np.flatnonzero(scores >= kth)  # with all that tie for the last place
    else:
        rows = np.arange(len(scores))
    return rows[np.lexsort((ids[rows], -scores[rows]))[:k]]


def _pack(size: int, kept: type):
    """Rows (kind, id, vector) of a partition, packed per kind into blocks of at most ``size`` rows."""

    def block(kind: int, ids: list, vectors: list) -> pa.RecordBatch:
        dims = max(map(len, vectors))
        matrix = np.zeros((len(vectors), dims), kept)
        for row, v in zip(matrix, vectors, strict=True):
            row[: len(v)] = v
        cells = [kind, np.array(ids, np.int64).tobytes(), len(ids), dims, matrix.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, (pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["kind", "ids", "n", "dims", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for b in batches:
            for kind, i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_numpy(zero_copy_only=False), strict=True):
                ids, vectors = held.setdefault(kind, ([], []))
                ids.append(i)
                vectors.append(v)
                if len(ids) == size:
                    yield block(kind, *held.pop(kind))
        for kind, (ids, vectors) in held.items():
            yield block(kind, ids, vectors)

    return run


_COMPLEMENT = str.maketrans("0123456789", "9876543210")


def ordered(score: int) -> tuple[int, int, str]:
    """(nearest long, and for scores beyond it, number of digits and digits): in the order of these, scores keep theirs."""
    limit = (1 << 63) - 1
    if -limit - 1 <= score <= limit:
        return score, 0, ""
    digits = str(abs(score))
    return (limit, len(digits), digits) if score > 0 else (-limit - 1, -len(digits), digits.translate(_COMPLEMENT))


def _best_of_blocks(k: int, scale: int, kept: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for q_ids, q_n, q_dims, q_words, c_ids, c_n, c_dims, c_words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                qs, cs = np.frombuffer(q_ids, np.int64), np.frombuffer(c_ids, np.int64)
                scores = accumulate(integers(np.frombuffer(q_words, kept).reshape(q_n, q_dims), scale), integers(np.frombuffer(c_words, kept).reshape(c_n, c_dims), scale))
                for q, row in zip(qs, scores, strict=True):
                    others = cs != q
                    row, ids = (row, cs) if others.all() else (row[others], cs[others])
                    at = select_best(row, ids, k)
                    row, ids = row[at], ids[at]
                    if int(q) in best:
                        row, ids = np.concatenate([best[int(q)][0], row]), np.concatenate([best[int(q)][1], ids])
                        at = select_best(row, ids, k)
                        row, ids = row[at], ids[at]
                    best[int(q)] = row, ids
        out = [(q, int(i), *ordered(int(s))) for q, (scores, ids) in best.items() for s, i in zip(scores, ids, strict=True)]
        kinds = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate(kinds)], names=["query_id", "vec_id", "score", "size", "digits"])

    return run


def exact_topk(queries: DataFrame, candidates: DataFrame, k: int = 10, scale: int = 1, block: int = 4096, query_block: int = 512) -> DataFrame:
    """The k best candidates of each query: query_id, rank (from 1), vec_id, score.

    Both frames hold (vec_id long, vector), the vectors of whole numbers or of
    finite ones; a score is the inner product of floor(scale * x) of the
    components, without rounding.  A candidate with the query's own id is left
    out; ties go to the smaller id.  Vectors of unequal
    length are compared on the components that both have.  A query without any
    candidate has no rows.  Rows with a null id or vector take no part.  Ids
    are keys: of rows with the same id, queries are answered once and
    candidates count once each row.  Scores beyond 64 bits are returned as the
    nearest long.
    """
    spark = candidates.sparkSession
    ship(spark)
    kinds = {dict(df.dtypes)["vector"] for df in (queries, candidates)}
    whole = kinds <= {f"array<{t}>" for t in ("tinyint", "smallint", "int", "bigint")}
    kept, cast = (np.int64, "array<long>") if whole else (np.float64, "array<double>")

    def blocks(df: DataFrame, kind: int, size: int) -> DataFrame:
        rows = df.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).select(F.lit(kind).alias("kind"), F.col("vec_id").cast("long"), F.col("vector").cast(cast))
        return rows.mapInArrow(_pack(size, kept), _BLOCK)

    # a shuffle of the (few) queries by id packs them into few full blocks and drops repeated ids
    few = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    left = keep(blocks(few.repartition(8), 0, query_block)).select(*[F.col(c).alias(f"q_{c}") for c in ("ids", "n", "dims", "words")])
    right = blocks(candidates, 1, block).select("ids", "n", "dims", "words")
    weight = left.agg(F.coalesce(F.sum(F.length("q_words") + F.length("q_ids")), F.lit(0))).first()[0]
    pairs = right.crossJoin(F.broadcast(left)) if weight <= BROADCAST_BYTES else keep(right).crossJoin(left)
    best = pairs.select("q_ids", "q_n", "q_dims", "q_words", "ids", "n", "dims", "words").mapInArrow(_best_of_blocks(k, scale, kept), "query_id long, vec_id long, score long, size long, digits string")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("size").desc(), F.col("digits").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
