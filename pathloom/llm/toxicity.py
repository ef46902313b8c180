"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine.

Fit (all of bounded size, see :class:`Settings`):

* A sample of at most ``max_labelled`` labelled documents, in the order of a
  hash of their ids, tells how much each word speaks for the label: its
  relevance is the lower end of Wilson's interval (``z``) for the share of toxic
  documents among those with the word, above the overall share and scaled to
  0..1.
* The first ``max_examples`` of them are the examples.  Every word of theirs is
  a term of the vector space; its weight in a text is (1 + log tf) * idf *
  (1 + ``evidence`` * relevance), with document frequencies over all documents.
* All examples go into a block-max inverted index.
* Leave-one-out votes of the examples calibrate the score (Platt's logistic).

Score: the ``k`` nearest examples vote with weight 1 / (distance + ``soft``);
the vote, drawn to the prior by ``prior_weight``, is calibrated.  Only texts
without any word of any example have no neighbours; they get the prior.

The search is exact: rare terms are summed by their posting lists; a block's
upper bound is its best such sum plus, over the frequent terms of the query,
weight times the block's maximum.  The block with the highest bound is scored in
full first, then all whose bound reaches the k-th best so far.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import keep, release, ship, text_of, tidy

_WORDS = re.compile(r"[^\W\d_]+")


def text_terms(text: str) -> list[str]:
    """The terms of a text, repeats included: its runs of letters in lower case."""
    return _WORDS.findall(text.lower())


@dataclass(frozen=True)
class Settings:
    """The bounds of what is fitted and sent to each worker, and the parameters of the vote."""

    max_labelled: int = 20_000
    max_examples: int = 4096
    z: float = 2.0
    evidence: float = 10.0
    k: int = 25
    soft: float = 0.05
    prior_weight: float = 1.0
    block: int = 256


#: A term in more than this share of the examples has a dense row, at most so many of them (20 MB at the defaults).
_FREQUENT, _DENSE = 0.05, 1024
#: Texts that are searched at a time.
_BATCH = 64


class BlockMaxIndex:
    """Vectors of examples by term, in blocks of consecutive examples; of frequent terms also each block's maximum.

    A vector is (terms, weights), two arrays; weights are at least 0.  Rare
    terms are posting lists, frequent ones rows over all examples.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int):
        self.n, self.block = len(vectors), block
        self.blocks = max(1, -(-self.n // block))
        term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in vectors)])
        owner = np.repeat(np.arange(self.n), [len(t) for t, _ in vectors])
        weight = np.concatenate([np.zeros(0), *(w for _, w in vectors)])
        order = np.lexsort((owner, term))
        self.ids, self.weights = owner[order].astype(np.int32), weight[order]
        self.starts = np.searchsorted(term[order], np.arange(terms + 1)).astype(np.int64)
        sizes = np.diff(self.starts)
        frequent = np.flatnonzero(sizes > _FREQUENT * self.n)
        frequent = frequent[np.argsort(-sizes[frequent], kind="stable")[:_DENSE]]
        self.row = np.full(terms, -1, np.int32)
        self.row[frequent] = np.arange(len(frequent))
        self._rows: tuple[np.ndarray, np.ndarray] | None = None

    def __getstate__(self):
        return self.__dict__ | {"_rows": None}

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """Dense rows (term, block, place) of the frequent terms and their block maxima; made once a process."""
        if self._rows is None:
            frequent = np.flatnonzero(self.row >= 0)
            dense = np.zeros((len(frequent), self.blocks * self.block))
            for t in frequent:
                a, e = self.starts[t], self.starts[t + 1]
                dense[self.row[t], self.ids[a:e]] = self.weights[a:e]
            dense = dense.reshape(len(frequent), self.blocks, self.block)
            self._rows = np.ascontiguousarray(dense.transpose(1, 0, 2)), dense.max(axis=2, initial=0.0)
        return self._rows

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (examples, cosines) of the k best with a cosine above 0, best first; ties go to the earlier example."""
        dense, peaks = self.rows()
        q, span = len(queries), self.blocks * self.block
        scores, asked = np.zeros((q, self.blocks, self.block)), np.zeros((q, len(peaks)))
        for n, (terms, weights) in enumerate(queries):
            row = self.row[terms]
            often = row >= 0
            asked[n, row[often]] = weights[often]
            terms, weights = terms[~often], weights[~often]
            first = self.starts[terms]
            sizes = self.starts[terms + 1] - first
            at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
            at += np.arange(len(at))
            scores[n] = np.bincount(self.ids[at], self.weights[at] * np.repeat(weights, sizes), span).reshape(self.blocks, self.block)
        # rare terms are summed; a block's bound adds the most that its frequent terms can
        bounds = scores.max(axis=2) + asked @ peaks
        done = np.zeros(bounds.shape, bool)

        def add(need: np.ndarray) -> None:
            for b in np.flatnonzero(need.any(axis=0)):
                which = np.flatnonzero(need[:, b])
                scores[which, b] += asked[which] @ dense[b]
            done[need] = True

        top = bounds.argmax(axis=1)
        add(np.arange(self.blocks)[None, :] == top[:, None])
        best = np.partition(scores[np.arange(q), top], self.block - k, axis=1)[:, self.block - k] if self.block >= k else np.zeros(q)
        # (a bound may differ from the sum it bounds in the last places)
        add((bounds > 0) & (bounds >= best[:, None] - 1e-9) & ~done)
        scores[~done] = 0.0
        found = []
        for line in np.round(scores.reshape(q, span), 12):  # what the order of summation changes is no difference
            hit = np.flatnonzero(line > 0)
            if len(hit) > k:
                hit = hit[line[hit] >= np.partition(line[hit], len(hit) - k)[len(hit) - k]]
            hit = hit[np.lexsort((hit, -line[hit]))[:k]]
            found.append((hit, np.minimum(line[hit], 1.0)))
        return found


class Model:
    def __init__(self, terms: list[str], boost: np.ndarray, idf: np.ndarray, examples: list[tuple[object, int, Counter]], settings: Settings):
        """``boost``: factor of each term for its relevance; ``examples``: (id, label, counts by term)."""
        self.settings, self.terms = settings, {t: n for n, t in enumerate(terms)}
        self.boosted = idf * boost
        # blocks of alike examples have tight bounds: by their most frequent word (a language's), whether relevant words rule them, and length
        def alike(e):
            at, weights = self.vector(e[2])
            return (max(sorted(e[2]), key=e[2].get, default=""), bool((weights[boost[at] > 1] ** 2).sum() > 0.5), len(at))

        examples = sorted(examples, key=alike)
        self.names = [e[0] for e in examples]
        self.labels = np.array([e[1] for e in examples], np.float64)
        vectors = [self.vector(e[2]) for e in examples]
        self.index = BlockMaxIndex(vectors, len(terms), settings.block)
        self.prior = (self.labels.sum() + 0.5) / (len(examples) + 2)
        self.slope, self.shift = 1.0, 0.0
        self._calibrate(vectors)
        self._seen: dict[bytes, tuple[float, list]] = {}

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of a unit vector."""
        at = np.fromiter(map(self.terms.get, counts, repeat(-1)), np.int64, len(counts))
        known = at >= 0
        at = at[known]
        if not len(at):
            return at, np.zeros(0)
        raw = (1 + np.log(np.fromiter(counts.values(), np.float64, len(known))[known])) * self.boosted[at]
        return at, raw / math.sqrt(raw @ raw)

    def _vote(self, ids: np.ndarray, cosines: np.ndarray) -> float:
        weights = 1 / (1 - cosines + self.settings.soft)
        m = self.settings.prior_weight
        share = (float(weights @ self.labels[ids]) + m * self.prior) / (float(weights.sum()) + m)
        return math.log(share / (1 - share))

    def _calibrate(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        y = self.labels
        if len(y) < 20 or y.min() == y.max():
            return
        votes = []
        for start in range(0, len(vectors), _BATCH):
            for n, (ids, cosines) in enumerate(self.index.nearest(vectors[start : start + _BATCH], self.settings.k + 1), start):
                rest = np.flatnonzero(ids != n)[: self.settings.k]
                votes.append(self._vote(ids[rest], cosines[rest]))
        # Platt's targets keep a separable sample finite
        up, down = y.sum(), len(y) - y.sum()
        goal = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
        x, a, b = np.array(votes), 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            g, w = p - goal, p * (1 - p) + 1e-9
            hessian = np.array([[w @ (x * x) + 1e-3, w @ x], [w @ x, w.sum() + 1e-3]])
            step = np.linalg.solve(hessian, np.array([g @ x + 1e-3 * (a - 1), g.sum() + 1e-3 * b]))
            a, b = a - step[0], b - step[1]
            if abs(step).max() < 1e-9:
                break
        if a > 0:
            self.slope, self.shift = float(a), float(b)

    def scores(self, texts: list[str]) -> list[tuple[float, list[tuple[object, float, int]]]]:
        """For each text (calibrated score, the three nearest examples as (id, cosine, label)); equal texts are searched once."""
        keys = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts]
        if len(self._seen) > 5_000:
            self._seen.clear()
        fresh = {k: t for k, t in zip(keys, texts, strict=True) if k not in self._seen}
        vectors = [self.vector(Counter(text_terms(t))) for t in fresh.values()]
        for key, (ids, cosines) in zip(fresh, self.index.nearest(vectors, self.settings.k) if vectors else [], strict=True):
            z = self.slope * self._vote(ids, cosines) + self.shift
            near = [(self.names[i], float(c), int(self.labels[i])) for i, c in zip(ids[:3], cosines[:3], strict=True)]
            self._seen[key] = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) if len(ids) else float(self.prior)), near
        return [self._seen[k] for k in keys]


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts = [Counter(text_terms(t)) for t in b.column(3).to_pylist()]
        terms = pa.array([list(c) for c in counts], pa.list_(pa.string()))
        numbers = pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([*b.columns[:3], terms, numbers], names=["doc_id", "label", "example", "terms", "counts"])


def _frequencies(shared):
    """Of each term, in how many texts it occurs; under -1, the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, n = shared.value, 0
        found = np.zeros(len(terms), np.int64)
        for b in batches:
            for t in b.column(0):
                words = set(text_terms(t.as_py()))
                hit = np.fromiter(map(terms.get, words, repeat(-1)), np.int64, len(words))
                found[hit[hit >= 0]] += 1
                n += 1
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array([*held.tolist(), -1], pa.int32()), pa.array([*found[held].tolist(), n], pa.int64())], names=["term", "n"])
        tidy()

    return run


def fit(docs: DataFrame, labels: DataFrame, learn: Column, settings: Settings = Settings()) -> Model:  # noqa: B008
    """``docs``: (doc_id, text); ``labels``: (doc_id, label 0/1); ``learn``: which rows of ``labels`` may be learned from.

    A label that is neither 0 nor 1 is no label.  An id with several labels
    counts as toxic if any says so; of several texts with one id the first in
    order is learned from.  Labels without a document are unused.  Without any
    usable label the score is 0.25 throughout.
    """
    spark = docs.sparkSession
    ship(spark)
    usable = labels.where(learn & F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    first = usable.orderBy(F.xxhash64("doc_id"), "doc_id")
    examples = first.limit(settings.max_examples).withColumn("example", F.lit(True))
    chosen = first.limit(settings.max_labelled).join(examples.select("doc_id", "example"), "doc_id", "left")
    sample = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(  # one text an id, so that the bounds hold
        F.first("label").alias("label"), F.coalesce(F.first("example"), F.lit(False)).alias("example"), F.min(text_of("text")).alias("text")
    )
    kind = dict(docs.dtypes)["doc_id"]
    held = keep(sample.mapInArrow(_presence, f"doc_id {kind}, label int, example boolean, terms array<string>, counts array<int>"))
    share = held.agg(F.coalesce(F.avg("label"), F.lit(0.0)).alias("p")).first().p
    n, a, z2 = F.col("n"), F.col("a"), settings.z**2
    p = a / n
    low = (p + z2 / (2 * n) - settings.z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    found = held.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("a"))
    found = found.select("term", ((low - share) / max(1 - share, 1e-9)).alias("relevance")).where(F.col("relevance") > 0)
    relevance = {r.term: r.relevance for r in found.toLocalIterator()}  # terms of at most max_labelled texts
    rows = held.where("example").select("doc_id", "label", "terms", "counts").toArrow().to_pylist()  # at most max_examples texts
    release(held)
    rows.sort(key=lambda r: (r["doc_id"], r["terms"], r["counts"]))
    rows = [(r["doc_id"], r["label"], Counter(dict(zip(r["terms"], r["counts"], strict=True)))) for r in rows]
    terms = sorted(set().union(*(r[2] for r in rows)))
    df, total = np.zeros(len(terms)), 0
    if terms:
        shared = spark.sparkContext.broadcast({t: i for i, t in enumerate(terms)})
        counts = docs.select(text_of("text").alias("text")).mapInArrow(_frequencies(shared), "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
        counts = counts.toArrow()  # one row a term
        at, seen = counts.column("term").to_numpy(), counts.column("n").to_numpy()
        df[at[at >= 0]], total = seen[at >= 0], int(seen[at < 0].sum())
        shared.unpersist()
    idf = np.log((1 + total) / (1 + df)) + 1
    boost = 1 + settings.evidence * np.array([relevance.get(t, 0.0) for t in terms])
    return Model(terms, boost, idf, rows, settings)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, ...) named ``doc_id``: doc_id, score, predicted, evidence.

    One row per input row.  A null text counts as empty and, like every text
    without a word of any example, gets the share of toxic examples.  Ids are carried along and play no part.  The evidence lists the
    nearest examples: id, cosine, label.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the model's settings
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = [x for start in range(0, b.num_rows, _BATCH) for x in m.scores(b.column(1).slice(start, _BATCH).to_pylist())]
            scores = [s for s, _ in found]
            near = [[{"doc_id": i, "cosine": c, "label": y} for i, c, y in e] for _, e in found]
            what = pa.list_(pa.struct([("doc_id", b.schema.field(0).type), ("cosine", pa.float64()), ("label", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(near, what)], names=["doc_id", "score", "evidence"])
        m._seen.clear()
        tidy()

    found = docs.select("doc_id", text_of("text").alias("text")).mapInArrow(run, f"doc_id {kind}, score double, evidence array<struct<doc_id:{kind},cosine:double,label:int>>")
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """Fit on the labelled rows that ``learn`` (a condition on doc_id) admits, and score every row of ``docs``.

    See :func:`fit` for labels and :func:`score` for the result; columns other
    than the named ones are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
    return score(rows, fit(rows, marks, learn, settings))
