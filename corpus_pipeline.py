"""A corpus pipeline over ``documents``: five stages, each a whole pass over what the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run`
writes it as Parquet in the shared folder and rereads it as the next one's
``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from pathloom.llm.common import fold, keep, release, table
from pathloom.llm.encoding import public_vocabulary

#: Row numbers up to this many (16 bytes each, with their positions) are broadcast; beyond it rows are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number of their own: a repeated or null doc_id must not join with another row's decision.

    Rows of Parquet files are known by file and place in it, the same in every
    scan, whatever the splits, so nothing is copied.  Other tables are written
    down with their numbers first.
    """
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    except AnalysisException:
        return keep(docs.withColumn("__row", F.monotonically_increasing_id()))
    names = keep(placed.select("__file").distinct().withColumn("__n", F.row_number().over(Window.orderBy("__file"))))  # one row a file
    return placed.join(F.broadcast(names), "__file").withColumn("__row", F.col("__n").cast("long") * (1 << 36) + F.col("__at")).select(*docs.columns, "__row")


def _few(df: DataFrame) -> DataFrame:
    """A kept table to join rows with, broadcast if it is small enough."""
    df = keep(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a toxicity score of 0.5 or more; learns from labelled rows of the training folds."""
    rows = _numbered(docs)
    marks = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs.select("doc_id", "text"), marks, fold("doc_id", 5) != 0)
    rejected = toxicity.score(rows.select(F.col("__row").alias("doc_id"), "text"), model).where(F.col("predicted") == 1).select(F.col("doc_id").alias("__row"))
    return rows.join(_few(rejected), "__row", "left_anti").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space one row stays: the longest, then the one with the smallest doc_id."""
    rows = _numbered(docs)
    named = rows.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row").alias("id"), "text")
    dropped = exact_dedup.exact_dedup(named, id_col="id").where(~F.col("kept")).select("doc_id.__row")
    return rows.join(_few(dropped), "__row", "left_anti").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity of 0.8 or more) one row stays."""
    rows = _numbered(docs)
    dropped = near_dedup.near_dedup(rows, id_col="__row").where(~F.col("kept")).select(F.col("doc_id").alias("__row"))
    return rows.join(_few(dropped), "__row", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that sources reach their target weights, in the order of the curriculum.

    Texts stay whole: a pass of which half or more of the words are wanted
    counts, the last one of a source included, so a source comes within half a
    document of its target.  No document is used more than three times; one
    whose passes all lie beyond its source's target is left out.  Texts without
    words cost nothing and stay once.
    """
    rows = _numbered(docs)
    mixed = mixing.mix(rows, id_col="__row", key_col="doc_id")
    uses = mixed.select(F.col("doc_id").alias("__row"), F.explode(F.when(F.col("size") == 0, F.array(F.lit(2.0))).otherwise(F.transform(F.filter("uses", lambda u: 2 * u["words"] >= F.col("size")), lambda u: u["position"]))).alias("__position"))
    ordered = rows.join(_few(uses), "__row").repartitionByRange("__position", "__row").sortWithinPartitions("__position", "__row")
    return ordered.select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in windows of 4096: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    return packing.pack(docs, public_vocabulary("word_bpe_49k.json"), window=4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Nearest-neighbour votes, signatures and tokenizers have no SQL form; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir))
        if before is not None:
            release(before)
        before = docs
    return docs
