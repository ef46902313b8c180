"""Packing token streams into fixed windows: concatenate and cut.

Pass 1 encodes each partition and notes, for each document, where it starts in
its partition; the partition totals (one row each) are prefix-summed into
global offsets.  Pass 2 adds them up, so each document knows its place in the
one long stream of all ids, and cuts it at the multiples of the window.  Only
the last window can be short, so padding is less than one window for the whole
corpus.  No step needs a task that sees more than its own partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.common import keep, ship, text_of
from pathloom.llm.encoding import encoder

_ENCODED = "part int, doc_id long, start long, n_tokens long, ids binary"
_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _encode(path: str, end_id: int, special_as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path, special_as_text=special_as_text).encode, int(end_id).to_bytes(4, "little")
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            ids = [np.frombuffer(encode(t.as_py()) + end, "<u4") for t in b.column(1)]
            sizes = np.array([len(x) for x in ids], np.int64)
            starts = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            # two bytes an id where they do
            small = [(x.astype("<u2") if x.max() < 1 << 16 else x).tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part, np.int32)), b.column(0), pa.array(starts), pa.array(sizes), pa.array(small, pa.binary())],
                names=["part", "doc_id", "start", "n_tokens", "ids"],
            )

    return run


def cut(start: int, length: int, window: int) -> list[tuple[int, int, int, int]]:
    """Pieces (start in the document, length, sequence, offset in it) of a document at ``start`` of the stream."""
    pieces, done = [], 0
    while done < length:
        sequence, offset = divmod(start + done, window)
        n = min(length - done, window - offset)
        pieces.append((done, n, sequence, offset))
        done += n
    return pieces


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, start, n, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                plain = np.frombuffer(ids, "<u2").astype("<u4").tobytes() if len(ids) == 2 * n else ids
                for first, length, sequence, offset in cut(start, n, window):
                    row = (doc, first, length, plain[4 * first : 4 * (first + length)], n, sequence, offset)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(df: DataFrame, vocabulary: str, window: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    Documents follow each other in the order of the input's partitions.
    Strings of special tokens in a text become those tokens, as the library does
    by itself, or with ``special_as_text`` remain ordinary text.  A null
    text counts as empty and is its end id alone.  Null and repeated ids are
    carried along; each row is a document of its own.  A document longer than
    the window becomes several pieces; nothing is dropped.  Other columns of
    the input are not looked at.  An empty table gives no pieces.
    """
    if window < 1:
        raise ValueError("the window must hold at least one id")
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    encoded = keep(rows.mapInArrow(_encode(vocabulary, end_id, special_as_text), _ENCODED))
    totals = encoded.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("part", before.alias("offset"))  # one row a partition
    placed = encoded.join(F.broadcast(offsets), "part").select("doc_id", (F.col("offset") + F.col("start")).alias("start"), "n_tokens", "ids")
    return placed.mapInArrow(_cut(window), _PIECES)
