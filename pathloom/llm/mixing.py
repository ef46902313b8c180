"""Mixing sources to target weights as a time-varying curriculum.

Every source has a share of all words (its *target*) and a schedule: how its
share is spread over training time 0..1.  The schedule is a piecewise linear
density; its integral is the source's cumulative demand, and the inverse of
that integral assigns to the n-th word of a source the moment at which the mix
asks for it.  Each document gets a position for each pass in which it is used,
and a range sort by position gives the training order.

Everything is DataFrame operations.  The prefix sums inside a source need no
task that sees a whole source: documents are spread over ``cells`` by the
leading digits of a hash, cells are summed first (map-side partial sums), their
offsets come from a window over cells, and the running sum inside a cell sorts
only that cell.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.common import WORD, keep, text_of

#: (time, density) knots from 0 to 1 for each weight class: early, even, late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))


def inverse_demand(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the integral of the density through ``knots`` reaches ``share`` (0..1) of its total."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    total = sum(areas)
    if total <= 0 or knots[0][0] != 0 or knots[-1][0] != 1 or any(g < 0 for _, g in knots):
        raise ValueError("a schedule runs from time 0 to 1 with densities of at least 0, not all 0")
    want, out = share * F.lit(total), F.lit(1.0)
    for (u0, g0), (u1, g1), area in reversed(list(zip(knots, knots[1:], areas, strict=False))):
        before = sum(areas[: [k[0] for k in knots].index(u0)])
        slope, rest = (g1 - g0) / (u1 - u0), want - F.lit(before)
        # (root of slope/2 * d^2 + g0 * d = rest), in the form that stays exact when the slope is small
        root = F.sqrt(F.greatest(F.lit(g0 * g0) + F.lit(2 * slope) * rest, F.lit(0.0)))
        step = F.when(F.lit(g0) + root > 0, 2 * rest / (F.lit(g0) + root)).otherwise(F.lit(0.0))
        out = F.when(want <= F.lit(before + area), F.lit(u0) + F.least(step, F.lit(u1 - u0))).otherwise(out)
    return out


def sizes(df: DataFrame, id_col: str, text_col: str, source_col: str, key_col: str) -> DataFrame:
    """doc_id, source, size (words) and the key that fixes the order inside a source."""
    key = F.md5(F.coalesce(F.col(key_col).cast("string"), F.lit("")).cast("binary"))
    return df.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
        key.alias("key"),
    )


def targets(cells: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """One row per source: source, source_size, weight_class, target (double), take (long: the whole words of it).

    Sources by code point, null last, weigh ``weights`` in turn.  A target above
    ``cap`` times the source's size stops there and the excess goes to the
    others by weight.  Sorted by size over weight, the sources that stop are a
    prefix, and the first that doesn't shows what a unit of weight gets; so the
    rounds of redistribution become running sums over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.lit(len(weights))
    cycle = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    rows = cells.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = rows.withColumn("weight_class", ((F.row_number().over(by_name) - 1) % n).cast("int"))
    rows = rows.withColumn("w", F.element_at(cycle, F.col("weight_class") + 1)).withColumn("most", F.col("source_size") * cap)
    filling = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    rows = rows.withColumns(
        {
            "n": F.row_number().over(filling),
            "left": F.sum("source_size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            - F.coalesce(F.sum("most").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "weight_left": F.sum("w").over(filling.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    rows = rows.withColumn("full", F.col("most") * F.col("weight_left") <= F.col("left") * F.col("w"))
    first = F.min(F.when(~F.col("full"), F.struct("n", "left", "weight_left"))).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("first", first).withColumn("full", F.col("first").isNull() | (F.col("n") < F.col("first.n")))
    part = F.col("first.left") * F.col("w")
    return rows.select(
        "source",
        "source_size",
        "weight_class",
        F.when(F.col("full"), F.col("most").cast("double")).otherwise(part.cast("double") / F.col("first.weight_left")).alias("target"),
        F.when(F.col("full"), F.col("most")).otherwise(F.floor(F.expr("first.left * w div first.weight_left"))).cast("long").alias("take"),
    )


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (1, 2, 3),
    cap: int = 3,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    cell_rows: int = 50_000,
    key_col: str | None = None,
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken, uses.

    ``uses`` lists the passes in which the document takes part: pass number,
    words taken in it, and position (0..1) in training time.  A source is read
    in the order of a hash of the id (or of ``key_col``), again and again until its target is
    reached; the document at the end of the last pass gives the words that are
    still wanted, so a source's words are its target rounded down.  ``taken``
    is the sum of the words over the passes.

    A null text has size 0, as has an empty or blank one; documents of size 0
    take part in no pass.  The null source is a source of its own and sorts
    last.  Rows with a repeated id are separate documents next to each other in
    the order.  Other columns of the input are not looked at.  An empty table
    gives an empty result.  Reruns give the same rows.
    """
    rows = keep(sizes(df, id_col, text_col, source_col, key_col or id_col))
    # as many cells a source as leave some ``cell_rows`` in each even if all rows are of one; the result does not depend on them
    digits = max(3, math.ceil(math.log(max(1, rows.count() / cell_rows), 16)))
    rows = rows.withColumn("cell", F.substring("key", 1, digits))
    cells = rows.groupBy("source", "cell").agg(F.sum("size").alias("size"))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    goal = targets(cells, weights, cap)
    starts = cells.select("source", "cell", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("cell_start"))
    starts = starts.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    starts = starts.withColumnsRenamed({"source": "s", "cell": "c"})
    inside = Window.partitionBy("source", "cell").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c")))
    at = F.col("cell_start") + F.col("start")
    passes = F.sequence(F.lit(0), F.lit(cap - 1))

    def use(p: Column) -> Column:
        begin = p * F.col("source_size") + at
        share = F.when(F.col("take") > 0, begin / F.col("take")).otherwise(F.lit(0.0))
        when = F.lit(0.0)
        for k, knots in enumerate(schedules):
            when = F.when(F.col("weight_class") == k, inverse_demand(share, knots)).otherwise(when)
        words = F.greatest(F.least(F.col("take") - begin, F.col("size")), F.lit(0))
        return F.struct(p.cast("int").alias("pass"), words.cast("long").alias("words"), when.alias("position"))

    rows = rows.withColumn("uses", F.filter(F.transform(passes, use), lambda x: x["words"] > 0))
    taken = F.aggregate("uses", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "uses")


def in_training_order(mixed: DataFrame) -> DataFrame:
    """The documents of :func:`mix`, range-sorted by the position of their first use; unused ones last."""
    first = F.coalesce(F.array_min(F.transform("uses", lambda x: x["position"])), F.lit(2.0))
    return mixed.withColumn("position", first).repartitionByRange(F.col("position"), F.col("doc_id")).sortWithinPartitions("position", "doc_id")


def schedule(mixed: DataFrame) -> DataFrame:
    """One row per use, in training order: position, doc_id, source, pass, words."""
    uses = mixed.select("doc_id", "source", F.explode("uses").alias("u"))
    uses = uses.select("u.position", "doc_id", "source", "u.pass", "u.words")
    return uses.repartitionByRange("position", "doc_id", "pass").sortWithinPartitions("position", "doc_id", "pass")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS BIGINT) AS w FROM d GROUP BY source),
f AS (SELECT *, 3 * source_size AS most,
        row_number() OVER (ORDER BY 3 * source_size / w, source NULLS LAST) AS n,
        CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
        CAST(sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weight_rest
      FROM s),
o AS (SELECT min(n) AS n FROM f WHERE most * weight_rest > rest * w),
g AS (SELECT f.*, p.n AS open_n, p.rest AS open_rest, p.weight_rest AS open_weight FROM f LEFT JOIN f p ON p.n = (SELECT n FROM o)),
t AS (SELECT source, source_size, w,
        CASE WHEN open_n IS NULL OR n < open_n THEN CAST(most AS DOUBLE) ELSE CAST(open_rest * w AS DOUBLE) / open_weight END AS target,
        CASE WHEN open_n IS NULL OR n < open_n THEN most ELSE (open_rest * w) // open_weight END AS take
      FROM g),
a AS (SELECT doc_id, source, size, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_at FROM d)
SELECT doc_id, size, source_size, target,
       CAST(greatest(least(take - start_at, size), 0) + greatest(least(take - source_size - start_at, size), 0) + greatest(least(take - 2 * source_size - start_at, size), 0) AS BIGINT) AS taken,
       CASE WHEN size > 0 THEN CAST(take > start_at AS INT) + CAST(take > source_size + start_at AS INT) + CAST(take > 2 * source_size + start_at AS INT) ELSE 0 END AS passes,
       CASE WHEN size > 0 AND take > start_at THEN round(least(2 * (start_at / take) / (g + sqrt(g * g + 2 * slope * (start_at / take))), 1.0), 6) END AS position
FROM a JOIN t ON a.source IS NOT DISTINCT FROM t.source JOIN (VALUES (1, 1.5::DOUBLE, -1.0::DOUBLE), (2, 1.0, 0.0), (3, 0.5, 1.0)) k(w, g, slope) USING (w)
"""
