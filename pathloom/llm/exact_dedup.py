"""Exact dedup with a heavy-hitter split.

1. Every text is reduced to a digest row (id, SHA-256 of the normalised text,
   length); only these rows travel from here on.
2. Misra-Gries: each partition keeps at most ``counters`` digests with lower
   bounds of their counts.  The merged summaries name every digest that holds
   more than ``2 / (counters + 1)`` of all rows.  As the bounds of one partition
   add up to no more than its rows, at most ``counters + 1`` digests pass the
   threshold, whatever the size of the input.
3. One pass verifies them: exact count and winner of each, by map-side partial
   aggregation.  The verified winners are broadcast (at most ``counters + 1``
   rows) and resolve their rows where they are, without a shuffle.
4. The remaining digests have small groups; they are aggregated and joined by
   ordinary shuffles on the digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import BLANKS, keep, ship, text_of


def misra_gries(values: Iterator[pa.Array], counters: int) -> dict:
    """At most ``counters`` values with lower bounds of their counts; each bound is short by at most n / (counters + 1)."""
    kept: dict = {}
    for array in values:
        counts = array.value_counts()
        for value, n in zip(counts.field("values").to_pylist(), counts.field("counts").to_pylist(), strict=True):
            kept[value] = kept.get(value, 0) + n
        if len(kept) > counters:
            cut = sorted(kept.values(), reverse=True)[counters]
            kept = {value: n - cut for value, n in kept.items() if n > cut}
    return kept


def _summaries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = misra_gries((b.column(0) for b in batches), counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], names=["digest", "bound"])

    return run


def heavy_digests(rows: DataFrame, counters: int) -> DataFrame:
    """Digests that may hold more than 2 / (counters + 1) of the rows: all that do, and at most ``counters + 1``."""
    ship(rows.sparkSession)
    bounds = rows.select("digest").mapInArrow(_summaries(counters), "digest string, bound long")
    total = rows.agg(F.count(F.lit(1)).alias("n"))
    return (
        bounds.groupBy("digest")
        .agg(F.sum("bound").alias("bound"))
        .join(F.broadcast(total), (F.col("bound") * (counters + 1) > F.col("n")))
        .select("digest")
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Texts are equal when identical after deletion of ASCII white space.  Of
    equal texts the longest original (in code points) stays, then the smallest
    id.  A null text counts as empty, so null, empty and blank texts form one
    group.  A null id sorts after all others.  Rows repeated with the same id
    are separate rows of the group and all of the winner's rows are ``kept``.
    Other columns of the input are not looked at.  An empty table gives an
    empty result.
    """
    text = text_of(text_col)
    rows = keep(
        df.select(
            F.col(id_col).alias("doc_id"),
            F.sha2(F.regexp_replace(text, f"[{BLANKS}]+", "").cast("binary"), 256).alias("digest"),
            F.char_length(text).cast("long").alias("n_chars"),
        )
    )
    order = F.struct((-F.col("n_chars")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"))
    size = F.count(F.lit(1))
    heavy = F.broadcast(heavy_digests(rows, counters))
    winners = keep(rows.join(heavy, "digest", "left_semi").groupBy("digest").agg(size.alias("group_size"), F.min(order).alias("first")))
    light = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    # groups are combined where they lie and kept, so that a task can hold a part of the rows of a group just below the threshold
    groups = keep(light.groupBy("digest").agg(size.alias("group_size"), F.min(order).alias("first")))
    light = light.join(groups, "digest")
    both = rows.join(F.broadcast(winners), "digest").select(*light.columns).union(light)
    return both.select(
        "doc_id",
        F.col("first.c").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("first.c")).alias("kept"),
        F.col("digest").alias("text_sha256"),
        "n_chars",
    )


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       h AS text_sha256
FROM t
WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
