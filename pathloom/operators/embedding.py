"""Pluggable embedders; the default hashes words to signed features, the same in any engine."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.metrics import l2_normalize
from pathloom.functions.text import let, words

QUERY_PREFIX = "Represent this question for searching passages: "


@dataclass(frozen=True)
class HashingEmbedder:
    """Unit vectors of ``dim`` word counts: an md5 digit names the place, another the sign.  Blank text gives the zero vector."""

    dim: int = 64

    def embed(self, text: Column) -> Column:
        place = lambda w: F.conv(F.substring(F.md5(F.lower(w).cast("binary")), 1, 6), 16, 10).cast("int") % self.dim
        sign = lambda w: F.when(F.conv(F.substring(F.md5(F.lower(w).cast("binary")), 7, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
        pairs = F.transform(words(text), lambda w: F.struct(place(w).alias("p"), sign(w).alias("s")))
        total = lambda p, i: F.aggregate(p, F.lit(0.0), lambda a, x: a + F.when(x["p"] == i, x["s"]).otherwise(0.0))
        sums = let(pairs, lambda p: F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), lambda i: total(p, i)))
        return F.transform(let(sums, l2_normalize), lambda x: x.cast("float"))



@dataclass(frozen=True)
class BatchEmbedder:
    """Vectors from a model: ``encode`` maps a list of texts to as many vectors of ``dim`` numbers.

    ``encode`` runs in Python workers on Arrow batches, ``batch`` texts at a
    time, and is made there by ``load`` once a worker, so a model travels as a
    recipe.  Blank text gives the zero vector without asking the model; vectors
    of another dimension are an error.  ``unit`` scales vectors to length 1.
    """

    load: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]]
    dim: int
    batch: int = 32
    unit: bool = True

    def embed(self, text: Column) -> Column:
        load, dim, batch, unit = self.load, self.dim, self.batch, self.unit

        @F.pandas_udf("array<float>")
        def vectors(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode = load()
            for texts in series:
                out = np.zeros((len(texts), dim), np.float32)
                asked = [i for i, t in enumerate(texts) if t and t.strip()]
                for k in range(0, len(asked), batch):
                    part = asked[k : k + batch]
                    found = np.asarray(encode([texts.iloc[i] for i in part]), np.float32)
                    if found.shape != (len(part), dim):
                        raise ValueError(f"the embedder gave {found.shape} for {len(part)} texts of {dim} dimensions")
                    norms = np.linalg.norm(found, axis=1, keepdims=True)
                    out[part] = np.divide(found, norms, out=found, where=norms > 0) if unit else found
                yield pd.Series(list(out))

        return vectors(text)


def embed(df: DataFrame, text_col: str = "text", embedder: HashingEmbedder | BatchEmbedder = HashingEmbedder(), name: str = "default", prefix: str = "") -> DataFrame:  # noqa: B008
    """Adds embedding and embedding_model; ``prefix`` goes before each text that has words."""
    text = F.col(text_col)
    return df.withColumns({"embedding": embedder.embed(F.concat(F.lit(prefix), text) if prefix else text), "embedding_model": F.lit(name)})


def dimension_errors(df: DataFrame, dim: int) -> DataFrame:
    """Rows whose vector has another dimension, or none."""
    return df.where(F.col("embedding").isNull() | (F.size("embedding") != dim))
