"""Answers and their evaluation: prompts, generators, metric rows, and averages per chunking method."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import metrics as M
from pathloom.functions.text import word_count, words
from pathloom.operators.chunking import sentences

# What is answered and noted where no context was found.
NO_PATH = ("Insufficient context found via graph path retrieval.", "No context retrieved via Path RAG")
NO_NAIVE = ("No context found.", "No context retrieved")
METRICS = ("exact_match", "f1", "rouge1", "rouge2", "rouge_l", "semantic_sim", "bleu")


def prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Use only these excerpts to answer.\n\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\nAnswer briefly:"))


def extractive_answer(context: Column, question: Column) -> Column:
    """The context's sentence that shares most distinct words with the question, the first of those; null without any sentence."""
    asked = F.array_distinct(words(F.lower(question)))
    scored = F.transform(sentences(context), lambda s, i: F.struct(F.size(F.array_intersect(F.array_distinct(words(F.lower(s))), asked)).alias("n"), (-i).alias("i"), s.alias("s")))
    return F.array_max(scored)["s"]


def answer(df: DataFrame, retrieval: str = "path") -> DataFrame:
    """Adds prompt, generated, error and the token counts; without context the fixed answer and error of the retrieval."""
    text, error = NO_PATH if retrieval == "path" else NO_NAIVE
    empty = F.col("context") == ""
    df = df.withColumn("prompt", F.when(~empty, prompt(F.col("context"), F.col("question"))))
    df = df.withColumn("generated", F.when(empty, F.lit(text)).otherwise(extractive_answer(F.col("context"), F.col("question"))))
    df = df.withColumn("error", F.when(empty, F.lit(error)))
    return df.withColumns({"context_tokens": word_count("context"), "prompt_tokens": word_count("prompt"), "completion_tokens": F.when(~empty, word_count("generated")).otherwise(0)})


def score(df: DataFrame, generated: str = "generated", truth: str = "truth", error: str = "error", vectors: tuple[str, str] | None = None, stem: Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds the seven metrics, ROUGE of stems if ``stem`` is given; 0 where there is an error or no answer."""
    g, t = F.col(generated), F.col(truth)
    ok = F.col(error).isNull() & (F.coalesce(g, F.lit("")) != "")
    sim = M.cosine(F.col(vectors[0]), F.col(vectors[1])) if vectors else F.lit(0.0)
    values = (M.exact_match(g, t), M.token_f1(g, t), M.rouge_n(g, t, 1, stem), M.rouge_n(g, t, 2, stem), M.rouge_l(g, t, stem), sim, M.bleu4(g, t))
    return df.withColumns({name: F.when(ok, v).otherwise(0.0) for name, v in zip(METRICS, values, strict=True)})


def grid(questions: DataFrame, methods: list[str]) -> DataFrame:
    """Every question under every method; the methods are a short list of parameters."""
    return questions.withColumn("method", F.explode(F.array(*map(F.lit, methods))))


def averages(rows: DataFrame, by: str = "method") -> DataFrame:
    """Per method: number of rows and errors, averages of the metrics (nulls skipped) and of context tokens of at least 0."""
    means = [F.avg(m).alias(f"avg_{m}") for m in METRICS if m in rows.columns]
    tokens = F.coalesce(F.avg(F.when(F.col("context_tokens") >= 0, F.col("context_tokens"))), F.lit(0.0)).alias("avg_context_tokens")
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("n_errors"), *means, tokens)


def outer_failures(rows: DataFrame, failed: DataFrame) -> DataFrame:
    """Rows whose evaluation itself failed keep their key and error only; ``failed`` is (qid, method, failure)."""
    joined = rows.join(failed, ["qid", "method"], "left")
    keep = ("qid", "method")
    columns = [F.col(c) if c in keep else (F.coalesce("failure", c) if c == "error" else F.when(F.col("failure").isNull(), F.col(c))).alias(c) for c in rows.columns]
    return joined.select(*columns)
