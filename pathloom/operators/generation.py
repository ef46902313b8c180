"""Answers and extractions from a language model behind HTTP, asked row by row from Python workers.

A generator is a function over a prompt column that returns a struct
(text, error, prompt_tokens, completion_tokens, duration_ms).  A request that
fails after its retries gives a row with an error; it never fails the job unless
``on_error`` asks for that.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.text import word_count
from pathloom.operators.evaluation import NO_NAIVE, NO_PATH, prompt

REPLY = "text string, error string, prompt_tokens long, completion_tokens long, duration_ms double"


def completion_request(model: str, temperature: float, max_tokens: int) -> Callable[[str], dict]:
    """The body of a request for a plain completion."""
    return lambda prompt: {"model": model, "prompt": prompt, "stream": False, "options": {"temperature": temperature, "num_predict": max_tokens}}


def completion_reply(reply: dict) -> dict:
    """Text, token counts and the server's own duration (nanoseconds), where it tells them."""
    ns = reply.get("total_duration")
    return {"text": reply.get("response"), "prompt_tokens": reply.get("prompt_eval_count"), "completion_tokens": reply.get("eval_count"), "duration_ms": None if ns is None else ns / 1e6}


@dataclass(frozen=True)
class HttpGenerator:
    """Posts JSON to ``url``; ``request`` makes the body of a prompt and ``reply`` reads the answer's fields."""

    url: str
    model: str = ""
    temperature: float = 0.05
    max_tokens: int = 600
    timeout: float = 240.0
    retries: int = 2
    pause: float = 1.0
    headers: dict[str, str] = field(default_factory=dict)
    request: Callable[[str], dict] | None = None
    reply: Callable[[dict], dict] = completion_reply

    def ask(self, prompt: str) -> dict:
        """One prompt; the duration is the server's own, or else the time that passed."""
        body = (self.request or completion_request(self.model, self.temperature, self.max_tokens))(prompt)
        began, error = time.monotonic(), None
        for turn in range(self.retries + 1):
            if turn:
                time.sleep(self.pause * 2 ** (turn - 1))
            try:
                call = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json", **self.headers})
                with urllib.request.urlopen(call, timeout=self.timeout) as answer:
                    found = self.reply(json.loads(answer.read()))
                if not isinstance(found.get("text"), str):
                    raise ValueError("the reply holds no text")
                took = (time.monotonic() - began) * 1000
                return found | {"text": found["text"].strip(), "error": None, "duration_ms": took if found.get("duration_ms") is None else found["duration_ms"]}
            except urllib.error.HTTPError as e:
                error = f"HTTP {e.code}"
                if e.code < 500 and e.code not in (408, 429):
                    break
            except (OSError, ValueError) as e:
                error = f"{type(e).__name__}: {e}"
        return {"text": None, "error": error, "prompt_tokens": None, "completion_tokens": None, "duration_ms": (time.monotonic() - began) * 1000}

    def __call__(self, prompts: Column, on_error: str = "row") -> Column:
        """The reply to each prompt; a null prompt is not sent and has none.  ``on_error`` is "row", or "raise" to fail the job."""
        if on_error not in ("row", "raise"):
            raise ValueError('on_error is "row" or "raise"')
        ask = self.ask

        @F.pandas_udf(REPLY)
        def replies(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            names = [c.split()[0] for c in REPLY.split(", ")]
            for texts in batches:
                found = [ask(t) if t is not None else dict.fromkeys(names) for t in texts]
                if on_error == "raise" and (bad := [r["error"] for r in found if r["error"]]):
                    raise RuntimeError(bad[0])
                yield pd.DataFrame({n: pd.Series([r.get(n) for r in found], dtype="object" if n in ("text", "error") else "float64" if n == "duration_ms" else "Int64") for n in names})

        return replies(prompts)


def answer_with(generator: Callable[[Column], Column]) -> Callable[[DataFrame, str], DataFrame]:
    """As :func:`pathloom.operators.evaluation.answer`, with a generator; adds duration_ms."""

    def answer(df: DataFrame, retrieval: str = "path") -> DataFrame:
        text, error = NO_PATH if retrieval == "path" else NO_NAIVE
        empty = F.col("context") == ""
        df = df.withColumn("prompt", F.when(~empty, prompt(F.col("context"), F.col("question"))))
        df = df.withColumn("_reply", generator(F.col("prompt")))
        return df.withColumns(
            {
                "generated": F.when(empty, F.lit(text)).otherwise(F.col("_reply.text")),
                "error": F.when(empty, F.lit(error)).otherwise(F.col("_reply.error")),
                "context_tokens": word_count("context"),
                "prompt_tokens": F.coalesce("_reply.prompt_tokens", word_count("prompt").cast("long")),
                "completion_tokens": F.when(empty, F.lit(0)).otherwise(F.coalesce("_reply.completion_tokens", word_count("_reply.text").cast("long"))),
                "duration_ms": F.col("_reply.duration_ms"),
            }
        ).drop("_reply")

    return answer
