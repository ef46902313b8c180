"""Token ids of a corpus written as Simple-8b shards in document order, and read back.

The documents are range-partitioned and sorted by id, so each task writes a
contiguous range as shards of about ``shard_ids`` ids.  The shards are the cells
of a Parquet table (one shard a row): Spark's committer makes each task's output
appear once and whole on any store that Spark can write, and a lost executor's
range is simply written again.  :func:`export` copies shards to files.

Where a document starts in the whole corpus is a two-level prefix sum: the
tasks' totals (one row a task) are summed and broadcast, and each shard knows
its own start within its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm import simple8b
from pathloom.llm.common import keep, ship, text_of
from pathloom.llm.encoding import encoder

SHARDS = "part int, seq int, start long, n_ids long, n_docs long, shard binary"
_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("shard", pa.binary())])


def _writer(path: str, end_id: int, shard_ids: int, block: int, special_as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all, end = encoder(path, special_as_text=special_as_text).encode_all, int(end_id).to_bytes(4, "little")
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        keys: list = []
        texts: list[bytes] = []
        held = 0

        def shard() -> pa.RecordBatch:
            nonlocal seq, start, held
            ids = np.frombuffer(b"".join(texts), "<u4")
            data = simple8b.write_shard(keys, np.array([len(t) // 4 for t in texts]), ids, block)
            row = [part, seq, start, len(ids), len(keys), data]
            seq, start, held = seq + 1, start + len(ids), 0
            keys.clear()
            texts.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _ARROW.types, strict=True)], schema=_ARROW)

        for b in batches:
            for key, ids in zip(b.column(0).to_pylist(), encode_all(b.column(1)), strict=True):
                keys.append(key)
                texts.append(ids + end)
                held += len(texts[-1]) // 4
                if held >= shard_ids:
                    yield shard()
        if keys:
            yield shard()

    return run


def write_token_files(df: DataFrame, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = 1 << 18, block: int = 128, special_as_text: bool = False) -> DataFrame:
    """Encode every whole text, append ``end_id``, and write all ids in ascending id order; returns the table of shards.

    A null text counts as empty and gives the end id alone.  Null ids sort
    first; rows with the same id follow each other in the order of a hash of
    their texts, so many of them are no hot range.
    A text longer than a shard is one shard of its own size.
    Strings of special tokens in a text become those tokens, as the library does
    by itself, or with ``special_as_text`` remain ordinary text.  Other columns of
    the input are not looked at.  An empty table gives no shards.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text")).repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark").drop("mark")
    return keep(rows.mapInArrow(_writer(vocabulary, end_id, shard_ids, block, special_as_text), SHARDS))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for offset, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            keys, ends, ids = simple8b.read_shard(data.as_py())
            plain = ids.astype("<u4").tobytes()
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()),
                    pa.array(starts + offset, pa.int64()),
                    pa.array(ends - starts, pa.int64()),
                    pa.array([plain[4 * a : 4 * e] for a, e in zip(starts, ends, strict=True)], pa.binary()),
                ],
                names=["doc_id", "start", "n_tokens", "ids"],
            )


def read_token_files(shards: DataFrame) -> DataFrame:
    """One row per document of the shards: doc_id, start, n_tokens, ids (little-endian uint32)."""
    ship(shards.sparkSession)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("part", before.alias("offset"))  # one row for each task that wrote
    rows = shards.join(F.broadcast(offsets), "part").select((F.col("offset") + F.col("start")).alias("offset"), "shard")
    return rows.mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids binary")


def export(shards: DataFrame, folder: str) -> None:
    """Write each shard as a file ``part-seq.s8b`` of a folder that every worker can write to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for b in batches:
            for part, seq, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with store.open_output_stream(f"{base}/{part:06d}-{seq:06d}.s8b") as out:
                    out.write(data)
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int32())], names=["n"])

    ship(shards.sparkSession)
    shards.select("part", "seq", "shard").mapInArrow(run, "n int").count()
