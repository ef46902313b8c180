"""Building the document graph as tables: upserts, links between chunks, entities and mentions.

A node or edge table is a DataFrame with a key; "last write wins" and "first
write wins" take an explicit sequence column, as rows have no order of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_last(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """For each key the row with the greatest ``order``; map-side combined."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def upsert_first(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """For each key the row with the least ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def merge_into(existing: DataFrame, incoming: DataFrame, keys: list[str], overwrite: bool) -> DataFrame:
    """``existing`` with ``incoming`` (unique keys) merged: incoming rows replace those of equal key, or give way to them."""
    keep_, add = (incoming, existing) if overwrite else (existing, incoming)
    return keep_.unionByName(add.join(keep_.select(*keys), keys, "left_anti").select(*keep_.columns))


def new_rows(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The incoming keys that do not exist yet, each once."""
    return incoming.select(*keys).distinct().join(existing.select(*keys), keys, "left_anti")


def contains_edges(chunks: DataFrame) -> DataFrame:
    return chunks.select("filename", "chunk_id").distinct()


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once or hold a null, with their number of rows."""
    bad = F.lit(False)
    for k in keys:
        bad = bad | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | bad)


def next_chunks(chunks: DataFrame, strict: bool = True) -> DataFrame:
    """(src, dst) of chunks that follow each other in a document and method; ``strict`` asks for consecutive indices."""
    by = Window.partitionBy("filename", "method").orderBy("chunk_index", "chunk_id")
    linked = chunks.select("chunk_index", F.col("chunk_id").alias("src"), F.lead("chunk_id").over(by).alias("dst"), F.lead("chunk_index").over(by).alias("after"))
    linked = linked.where(F.col("dst").isNotNull())
    return (linked.where(F.col("after") == F.col("chunk_index") + 1) if strict else linked).select("src", "dst")


def entities_of(mentions: DataFrame) -> DataFrame:
    """Entity nodes (label, key, ...) of mention candidates; properties are those of the first mention by (chunk_id, pos)."""
    known = mentions.where(F.col("label").isNotNull() & F.col("key").isNotNull() & (F.col("key") != ""))
    return upsert_first(known.drop("text"), ["label", "key"], F.struct("chunk_id", "pos")).drop("chunk_id", "pos")


def mention_edges(mentions: DataFrame, chunks: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Distinct (chunk_id, label, key) whose chunk exists; with ``entities``, whose entity exists too."""
    found = mentions.select("chunk_id", "label", "key").distinct().join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return found if entities is None else found.join(entities.select("label", "key"), ["label", "key"], "left_semi").select("chunk_id", "label", "key")
