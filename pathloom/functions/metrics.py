"""Scores of a generated answer against the true one, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from pathloom.functions.text import let, normalize, words


def exact_match(generated: Column, truth: Column) -> Column:
    both = F.struct(normalize(generated).alias("a"), normalize(truth).alias("b"))
    return let(both, lambda x: F.when((x["a"] == x["b"]) & (x["a"] != ""), 1.0).otherwise(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    times = lambda arr, w: F.size(F.filter(arr, lambda x: x == w))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, w: s + F.least(times(a, w), times(b, w)))


def f_measure(common: Column, generated: Column, truth: Column) -> Column:
    """Harmonic mean of common/generated and common/truth; 0 without anything in common."""
    p, r = common / F.nullif(generated, F.lit(0)), common / F.nullif(truth, F.lit(0))
    return F.coalesce(F.when(common > 0, 2 * p * r / (p + r)), F.lit(0.0))


def _f_of(a: Column, b: Column, common: Callable[[Column, Column], Column]) -> Column:
    both = F.struct(a.alias("a"), b.alias("b"))
    counts = lambda x: F.struct(common(x["a"], x["b"]).alias("c"), F.size(x["a"]).alias("a"), F.size(x["b"]).alias("b"))
    return let(both, lambda x: let(counts(x), lambda n: f_measure(n["c"], n["a"], n["b"])))


def token_f1(generated: Column, truth: Column) -> Column:
    return _f_of(words(normalize(generated)), words(normalize(truth)), overlap)


def rouge_tokens(c: Column) -> Column:
    """Runs of a-z and 0-9 of the text in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))


def rouge_n(generated: Column, truth: Column, n: int, stem: Callable[[Column], Column] | None = None) -> Column:
    """F-measure of common n-grams; ``stem`` maps the array of a text's tokens, such as :func:`pathloom.functions.stemming.porter`."""
    grams = lambda c: let(rouge_tokens(c) if stem is None else stem(rouge_tokens(c)), lambda t: ngrams(t, n))
    return _f_of(grams(generated), grams(truth), overlap)


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, a row of the table as the bits of one integer."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        hit = row & places.get(y, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@F.pandas_udf(IntegerType())
def _lcs(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([lcs_length(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int32")


def rouge_l(generated: Column, truth: Column, stem: Callable[[Column], Column] | None = None) -> Column:
    a, b = (rouge_tokens(c) if stem is None else stem(rouge_tokens(c)) for c in (generated, truth))
    return f_measure(_lcs(a, b), F.size(a), F.size(b))


def bleu_tokens(c: Column) -> Column:
    """Runs of letters and digits, and each other visible character by itself."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[A-Za-z0-9\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]"), F.lit(0))


def bleu4(generated: Column, truth: Column) -> Column:
    """Sentence BLEU up to 4-grams with brevity penalty.

    A numerator of 0 is replaced by 1 / (2^i * 5 / ln(length)), where i counts
    these replacements; without a common word the score is 0.
    """
    both = F.struct(bleu_tokens(generated).alias("h"), bleu_tokens(truth).alias("r"))

    def grams(x: Column) -> Column:
        """Sizes, and for each n the common n-grams and the number of them in the answer."""
        each = [let(F.struct(ngrams(x["h"], n).alias("a"), ngrams(x["r"], n).alias("b")), lambda g: F.struct(overlap(g["a"], g["b"]).alias("hit"), F.greatest(F.size(g["a"]), F.lit(1)).alias("total"))) for n in range(1, 5)]
        return F.struct(F.size(x["h"]).alias("h"), F.size(x["r"]).alias("r"), F.array(*each).alias("each"))

    def value(c: Column) -> Column:
        logs, zeros = F.lit(0.0), F.lit(0)
        for n in range(1, 5):
            hit, total = c["each"][n - 1]["hit"], c["each"][n - 1]["total"]
            bare = (hit == 0) & (c["h"] > 1)
            zeros = zeros + F.when(bare, 1).otherwise(0)
            smooth = 1.0 / (F.pow(F.lit(2.0), zeros) * F.lit(5.0) / F.log(c["h"].cast("double")))
            logs = logs + F.log(F.when(bare, smooth).otherwise(hit.cast("double")) / total) / 4
        penalty = F.when(c["h"] > c["r"], 1.0).otherwise(F.exp(1 - c["r"] / F.nullif(c["h"], F.lit(0))))
        real = (c["h"] > 0) & (c["r"] > 0) & (c["each"][0]["hit"] > 0)
        return F.when(real, F.coalesce(penalty * F.exp(logs), F.lit(0.0))).otherwise(0.0)

    return let(both, lambda x: let(grams(x), value))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine within [-1, 1]; 0 where a vector is missing or zero."""
    both = F.struct(dot(a, b).alias("ab"), (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))).alias("norm"))
    return let(both, lambda x: F.coalesce(F.when(x["norm"] > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x["ab"] / x["norm"]))), F.lit(0.0)))


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    scale = F.coalesce(F.nullif(F.sqrt(dot(v, v)), F.lit(0.0)), F.lit(1.0))
    return let(F.struct(v.alias("v"), scale.alias("s")), lambda x: F.transform(x["v"], lambda e: e.cast("double") / x["s"]))
