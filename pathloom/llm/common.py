"""Helpers shared by the corpus operators: scratch tables, folds, Python workers' path."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters of the text contracts, as a regex class body.
BLANKS = r"\x20\x09-\x0D"
#: One word.
WORD = rf"[^{BLANKS}]+"
_own: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder of this process serves a local
    master; on a cluster, whose executors could not see it, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="pathloom-"))
            atexit.register(shutil.rmtree, _own[0], True)
        folder = f"file://{_own[0]}"
    return folder.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: whatever is built on the result survives the loss of
    any executor without computing ``df`` again, and column pruning still
    reaches the files.  The table is deleted when the application ends, or
    earlier by :func:`release`.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`keep` that nothing still to be computed reads."""
    for df in tables:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(df._kept_at)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def tidy() -> None:
    """Give memory that a task no longer needs back to the system: workers stay for the next job."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # (another C library)
        ctypes.CDLL(None).malloc_trim(0)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: they get its folder in their PYTHONPATH."""
    top = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    parts = [p for p in (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if top not in parts:
        env["PYTHONPATH"] = os.pathsep.join([top, *parts])
    # texts are long: smaller batches than Spark's default hold less at a time on both sides; a session's own choice stays
    if spark.conf.get(_ARROW_ROWS) == "10000":
        spark.conf.set(_ARROW_ROWS, "1000")
    env.setdefault("OMP_NUM_THREADS", "1")
    env.setdefault("OPENBLAS_NUM_THREADS", "1")
    env.setdefault("TOKENIZERS_PARALLELISM", "false")


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def text_of(column: str) -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
