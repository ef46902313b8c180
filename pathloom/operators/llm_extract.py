"""Entities and relationships from JSON that a language model wrote about each chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.text import capitalize, strip
from pathloom.operators.graph import upsert_first

SCHEMA = "entities array<struct<label:string,name:string,year:string,quarter_id:string>>, relationships array<struct<type:string,from_entity_name:string,to_entity_name:string>>"
LABELS = ("Company", "Segment", "Location", "Metric", "Quarter", "Person")
RELATIONS = ("WORKS_FOR", "CEO_OF", "LOCATED_IN", "PARTNERS_WITH", "ACQUIRED", "REPORTS_METRIC", "OPERATES_SEGMENT")


def prompt(text: Column) -> Column:
    """What a generator is asked for a chunk."""
    ask = (
        "Read the passage and name its entities and how they relate. Answer with one JSON object and nothing else, with the lists "
        f'"entities" (label: one of {", ".join(LABELS)}; name; year and quarter_id for a Quarter) and "relationships" '
        f"(type: one of {', '.join(RELATIONS)}; from_entity_name; to_entity_name).\n\nPassage:\n"
    )
    return F.concat(F.lit(ask), text)


def parse(df: DataFrame, json_col: str = "json") -> DataFrame:
    """Adds ``parsed``: the object without its code fence; null unless it is an object with both lists."""
    bare = strip(F.regexp_replace(F.regexp_replace(strip(F.col(json_col)), r"^```(?:json)?", ""), r"```$", ""))
    parsed = F.from_json(bare, SCHEMA)
    return df.withColumn("parsed", F.when(parsed["entities"].isNotNull() & parsed["relationships"].isNotNull(), parsed))


def entities(parsed: DataFrame) -> DataFrame:
    """Valid entities: (chunk_id, pos, label, name, key, year, quarter_id, original_name); of a name in a chunk the last stays."""
    rows = parsed.select("chunk_id", F.posexplode("parsed.entities").alias("pos", "e"))
    rows = rows.select("chunk_id", "pos", capitalize(strip(F.col("e.label"))).alias("label"), strip(F.col("e.name")).alias("name"), F.expr("try_cast(e.year AS int)").alias("year"), F.upper("e.quarter_id").alias("quarter_id"))
    rows = rows.where((F.col("label") != "") & (F.col("name") != ""))
    quarter = F.col("label") == "Quarter"
    rows = rows.where(~quarter | (F.col("year").isNotNull() & F.coalesce(F.col("quarter_id").rlike("^Q[1-4]$"), F.lit(False))))
    key = F.when(quarter, F.concat_ws("-", "year", "quarter_id")).otherwise(F.col("name"))
    out = rows.select(
        "chunk_id", "pos", "label", "name", key.alias("key"), F.when(quarter, F.col("year")).alias("year"), F.when(quarter, F.col("quarter_id")).alias("quarter_id"), F.when(quarter & (F.col("name") != key), F.col("name")).alias("original_name")
    )
    last = Window.partitionBy("chunk_id", "name").orderBy(F.col("pos").desc())
    return out.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")


def relationships(parsed: DataFrame, valid: DataFrame) -> DataFrame:
    """(chunk_id, pos, from_label, from_key, type, to_label, to_key) of relations between valid entities of the same chunk."""
    rows = parsed.select("chunk_id", F.posexplode("parsed.relationships").alias("pos", "r"))
    kind = F.upper(F.replace(strip(F.col("r.type")), F.lit(" "), F.lit("_")))
    rows = rows.select("chunk_id", "pos", kind.alias("type"), strip(F.col("r.from_entity_name")).alias("a"), strip(F.col("r.to_entity_name")).alias("b")).where("type <> '' AND a <> '' AND b <> ''")
    side = lambda n, p: valid.select("chunk_id", F.col("name").alias(n), F.col("label").alias(f"{p}_label"), F.col("key").alias(f"{p}_key"))
    return rows.join(side("a", "from"), ["chunk_id", "a"]).join(side("b", "to"), ["chunk_id", "b"]).select("chunk_id", "pos", "from_label", "from_key", "type", "to_label", "to_key")


def relation_edges(relations: DataFrame) -> DataFrame:
    """One edge for each pair of ends and type, with the chunk that named it first."""
    rows = relations.withColumnRenamed("chunk_id", "source_chunk_id")
    return upsert_first(rows, ["from_label", "from_key", "type", "to_label", "to_key"], F.struct("source_chunk_id", "pos")).drop("pos")
