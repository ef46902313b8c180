"""What sessions need to run this package's Python functions on workers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: they get its folder in their PYTHONPATH."""
    top = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    parts = [p for p in (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if top not in parts:
        env["PYTHONPATH"] = os.pathsep.join([top, *parts])
