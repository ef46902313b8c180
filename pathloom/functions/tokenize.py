"""Pluggable tokenizers: how many tokens a text has, and its token list, as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom.functions.text import word_count, words


@dataclass(frozen=True)
class WhitespaceTokenizer:
    """Words between blanks; ``n_special`` is added to the count of any text that has words."""

    n_special: int = 0

    def tokens(self, c: Column | str) -> Column:
        return words(c)

    def join(self, tokens: Column) -> Column:
        return F.array_join(tokens, " ")

    def count(self, c: Column | str) -> Column:
        n = word_count(c)
        return F.when(n > 0, n + self.n_special).otherwise(F.lit(0)) if self.n_special else n
