"""Language-model scores of whole texts: a gated recurrent model beside an add-one unigram base.

1. Words of the training rows are counted (combined in each partition, then
   summed by word); the counts cover all of them and stay a table.
2. The ``words`` most frequent (the end of a text among them) are the model's
   output vocabulary, in classes of ``width``.  All others fall into tail
   classes by their spelling (:func:`tail_class`); within a tail class a word
   has the add-one probability of its count, with one place for the unseen.
3. Each text is encoded once: ids for the model, and sums over its words'
   counts.  The ``known`` most frequent words (a bound on what is broadcast) are
   counted where they are; the counts of the rest come by a join.
4. The model (:mod:`pathloom.llm.gru`) is trained in ``rounds``: trainers go
   through their part of the training rows and their weights are averaged.
   In all rounds together each run of ``run`` ids of each text is learned from
   once; a round takes every ``rounds``-th run of a text, from a start by its
   row, so copies of a text differ in it.  A trainer gets about ``per_trainer``
   ids a round.
5. Every whole text is scored, the state carried across its windows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm import gru
from pathloom.llm.common import keep, release, ship, text_of

#: Stands for the end of a text in the counts; no word is empty.
END = ""


@dataclass(frozen=True)
class Settings:
    words: int = 2048
    width: int = 64
    hidden: int = 16
    known: int = 1 << 18
    rounds: int = 4
    run: int = 128
    per_trainer: int = 500_000
    rate: float = 0.1

    @property
    def shape(self) -> gru.Shape:
        return gru.Shape(self.words, self.width, TAILS, self.hidden)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII blanks, A-Z in lower case, of all texts in one array, and how many each text has; ends are not among them."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, ends = parts.flatten(), parts.offsets.to_numpy()
    filled = pc.binary_length(words).to_numpy() > 0  # blanks at either end of a text leave an empty part
    if not filled.all():
        words, ends = words.filter(pa.array(filled)), np.concatenate([[0], np.cumsum(filled)])[ends - ends[0]]
    return words, np.diff(ends).astype(np.int64)


def _in_chunks(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[tuple[list[pa.RecordBatch], list[pa.Array], list[np.ndarray]]]:
    """Batches with their :func:`split_words`, as many together as first hold ``limit`` words: tables of words are built once for them."""
    held: list[tuple] = []
    n = 0
    for b in batches:
        held.append((b, *split_words(b.column(column))))
        n += len(held[-1][1])
        if n >= limit:
            yield tuple(map(list, zip(*held, strict=True)))
            held, n = [], 0
    if held:
        yield tuple(map(list, zip(*held, strict=True)))


#: Groups of first letters x plain or other last character x up to 8 characters or more.
_HEADS = 8
TAILS = 4 * _HEADS


def tail_class(word: str) -> int:
    """A function of the spelling alone."""
    head = xxhash.xxh32_intdigest(word[:2].encode("utf-8", "surrogatepass")) % _HEADS
    return 4 * head + 2 * (not word[-1].isalpha()) + (len(word) > 8)


def tail_classes(words: pa.Array) -> np.ndarray:
    """:func:`tail_class` of each word, from the few different beginnings and last characters."""

    def each(column: pa.Array, of) -> np.ndarray:
        found = column.dictionary_encode()
        return np.array([of(x) for x in found.dictionary.to_pylist()], np.int64)[found.indices.to_numpy()]

    head = each(pc.utf8_slice_codeunits(words, 0, 2), lambda x: xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass")) % _HEADS)
    odd = each(pc.utf8_slice_codeunits(words, -1), lambda x: not x.isalpha())
    return 4 * head + 2 * odd + (pc.utf8_length(words).to_numpy() > 8)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts = 0
    for held, words, _ in _in_chunks((b.select([0]) for b in batches), 0, 4_000_000):
        texts += sum(b.num_rows for b in held)
        found = pc.value_counts(pa.chunked_array(words, words[0].type))
        yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], names=["word", "c"])
    if texts:
        yield pa.RecordBatch.from_arrays([pa.array([END], pa.string()), pa.array([texts], pa.int64())], names=["word", "c"])


def _tail_sums(top: frozenset):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, kinds = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
        known = pa.array(sorted(top), pa.string())
        for b in batches:
            b = b.filter(pc.invert(pc.is_in(b.column(0), value_set=known)))
            k = tail_classes(b.column(0))
            np.add.at(sums, k, b.column(1).to_numpy())
            kinds += np.bincount(k, minlength=TAILS)
        yield pa.RecordBatch.from_arrays([pa.array(range(TAILS), pa.int32()), pa.array(sums), pa.array(kinds)], names=["k", "n", "kinds"])

    return run


class Vocabulary:
    """The most frequent words with their counts, most frequent first, and what is known of all others as sums."""

    def __init__(self, words: list[str], counts: list[int], total: int, distinct: int, tail_n: list[int], tail_kinds: list[int], settings: Settings):
        self.words, self.counts, self.settings = words, np.array(counts, np.int64), settings
        self.total, self.distinct = total, distinct
        self.tail_n, self.tail_kinds = np.array(tail_n), np.array(tail_kinds)

    def prepare(self) -> None:
        """Lookup tables, built once a process."""
        if hasattr(self, "known"):
            return
        s = self.settings
        self.known = pa.array(self.words, pa.string())
        n = len(self.words)
        rest = -np.log10(self.tail_n + self.tail_kinds + 1.0)
        kinds = tail_classes(self.known[s.words :])  # the end is before these
        logs = np.log10(self.counts + 1.0)
        self.log_count = np.append(logs, 0.0)  # the last place: a word that is not among these
        ids = np.arange(n + 1)
        ids[s.words : n] = s.words + kinds
        self.ids = ids.astype(np.uint16)
        share = np.zeros(n + 1)
        share[s.words : n] = logs[s.words :] + rest[kinds]
        self.share = share
        self.rest = rest
        #: The place of the end, which has the first where there is a row to learn from.
        self.end = 0 if n else n

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "log_count", "ids", "share", "rest", "end")}


_ENCODED = "doc_id {kind}, learn boolean, n_tokens long, n_known long, base double, tail double, ids binary, rare array<string>"


def _encode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        v.prepare()
        n, words_limit = len(v.words), v.settings.words
        each = math.log10(v.total + v.distinct + 1)
        for held, found, sizes in _in_chunks(batches, 2, 2_000_000):
            places = pc.index_in(pa.chunked_array(found, found[0].type), value_set=v.known).fill_null(n).to_numpy()
            parts = np.split(places, np.cumsum([len(x) for x in found])[:-1])
            for b, words, size, place in zip(held, found, sizes, parts, strict=True):
                if not b.num_rows:
                    continue
                n_tokens = size + 1
                ends = np.cumsum(n_tokens) - 1
                starts = ends - size
                inside = np.ones(len(words) + len(size), bool)
                inside[ends] = False
                at = np.full(len(inside), v.end)
                at[inside] = place
                ids, share = v.ids[at], v.share[at]
                unseen = inside & (at == n)
                rare = words.filter(pa.array(place == n))
                kinds = tail_classes(rare)
                ids[unseen], share[unseen] = words_limit + kinds, v.rest[kinds]
                if v.end == n:  # no row to learn from: the end is unseen, in the first tail class
                    ids[ends], share[ends] = words_limit, v.rest[0]
                sums = [np.add.reduceat(x, starts) for x in ((at < n).astype(np.int64), v.log_count[at], share, unseen.astype(np.int32))]
                bounds = np.concatenate([[0], 2 * np.cumsum(n_tokens)])
                data = ids.astype("<u2").tobytes()
                columns = [
                    b.column(0),
                    b.column(1),
                    pa.array(n_tokens),
                    pa.array(sums[0]),
                    pa.array(sums[1] - n_tokens * each),
                    pa.array(sums[2]),
                    pa.array([data[i:j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sums[3])]), pa.int32()), rare.cast(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "learn", "n_tokens", "n_known", "base", "tail", "ids", "rare"])

    return run


def _train(shared, settings: Settings, turn: int):
    """One row a trainer: ids learned from, weights and sums of squares times that number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = settings.shape
        weights, squares = shared.value
        trainer = gru.Trainer(shape, gru.unpack(shape, weights), gru.unpack(shape, squares), settings.rate)
        held: list[np.ndarray] = []
        firsts: list[int] = []
        learned = waiting = 0

        def learn() -> None:
            nonlocal learned, waiting
            if held:
                trainer.train(held, np.array(firsts, np.uint16))
            learned += waiting
            waiting = 0
            held.clear()
            firsts.clear()

        for b in batches:
            for data, row in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                start = (row + turn) % settings.rounds
                parts, before = gru.runs_of(shape, np.frombuffer(data.as_py(), "<u2"), settings.run, settings.rounds, start)
                held += parts
                firsts += before
                waiting += sum(map(len, parts))
                if waiting >= 250_000:
                    learn()
        learn()
        if learned:
            scale = float(learned)
            rows = [(gru.pack(trainer.p) * scale).astype("<f4").tobytes(), (gru.pack(trainer.seen) * scale).astype("<f4").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([learned], pa.int64()), pa.array(rows[:1], pa.binary()), pa.array(rows[1:], pa.binary())], names=["n", "weights", "squares"])

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the rows, one at a time."""
    n, sums = 0, None
    for b in batches:
        for k, *parts in zip(*b.columns, strict=True):
            parts = [np.frombuffer(x.as_buffer(), "<f4").astype(np.float64) for x in parts]
            sums = parts if sums is None else [a + x for a, x in zip(sums, parts, strict=True)]
            n += k.as_py()
    if sums is not None:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *(pa.array([x.astype("<f4").tobytes()], pa.binary()) for x in sums)], names=["n", "weights", "squares"])


def _score(shared, settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = settings.shape
        params = gru.unpack(shape, shared.value)
        for b in batches:
            texts = [np.frombuffer(x.as_buffer(), "<u2") for x in b.column(b.num_columns - 1)]
            logs = gru.log_likelihoods(shape, params, texts) / math.log(10)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(logs)], names=[*b.schema.names[:-1], "lm"])

    return run


def count_words(docs: DataFrame, learn: Column) -> DataFrame:
    """(word, c) over the rows to learn from; the end of a text is the word ``END``."""
    ship(docs.sparkSession)
    rows = docs.where(learn).select(text_of("text").alias("text"))
    return rows.mapInArrow(_count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, settings: Settings) -> Vocabulary:
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    best = counts.orderBy(F.col("c").desc(), "word").limit(settings.known).toArrow()  # at most ``known`` rows
    words, frequencies = best.column("word").to_pylist(), best.column("c").to_pylist()
    if END in words:  # the end always has a place in the model's vocabulary
        at = words.index(END)
        words.insert(0, words.pop(at))
        frequencies.insert(0, frequencies.pop(at))
    sums = counts.mapInArrow(_tail_sums(frozenset(words[: settings.words])), "k int, n long, kinds long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds"))
    tails = {r.k: (r.n, r.kinds) for r in sums.collect()}  # one row a tail class
    tails = [tails.get(k, (0, 0)) for k in range(TAILS)]
    return Vocabulary(words, frequencies, total.n, total.v, [n for n, _ in tails], [k for _, k in tails], settings)


def train(encoded: DataFrame, v: Vocabulary, settings: Settings) -> np.ndarray:
    """The weights after all rounds; what comes to the driver is the average of a round."""
    spark, shape = encoded.sparkSession, settings.shape
    start = gru.bounded(gru.initial(shape, v.counts[: settings.words], v.tail_n))
    weights, squares = gru.pack(start), np.full(sum(a.size for a in start.values()), 1e-4, np.float32)
    rows = encoded.where("learn").select("ids", "row")
    ids = encoded.where("learn").agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    trainers = max(1, -(-ids // (settings.rounds * settings.per_trainer)))
    for turn in range(settings.rounds):
        shared = spark.sparkContext.broadcast((weights, squares))
        found = rows.coalesce(trainers).mapInArrow(_train(shared, settings, turn), "n long, weights binary, squares binary")
        merged = kept = keep(found)
        fan = math.isqrt(trainers)
        while fan > 1:  # each task sums about as many rows as the next step has tasks
            merged = merged.repartition(fan).mapInArrow(_sum, "n long, weights binary, squares binary")
            fan = math.isqrt(fan)
        total = merged.repartition(1).mapInArrow(_sum, "n long, weights binary, squares binary").collect()  # one row
        release(kept)
        shared.unpersist()
        if total:
            weights, squares = (np.frombuffer(x, "<f4") / np.float32(total[0].n) for x in (total[0].weights, total[0].squares))
    return weights.astype(np.float32)


def lm_score(df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """One row per input row: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``learn`` is a condition on ``doc_id`` that says which rows are learned
    from.  Scores are log10 probabilities of the whole text, its end included.
    A null text counts as empty and is its end alone.  Null and repeated ids are
    carried along; each row is a text of its own.  Other columns of the input
    are not looked at.  Without rows to learn from all words are unseen and the
    model is uniform within its classes.  An empty table gives an empty result.
    """
    spark = df.sparkSession
    ship(spark)
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    counts = keep(count_words(docs, learn))
    v = vocabulary(counts, settings)
    shared = spark.sparkContext.broadcast(v)  # at most ``known`` words
    rows = docs.select("doc_id", F.coalesce(learn, F.lit(False)).alias("learn"), text_of("text").alias("text"))
    encoded = keep(rows.mapInArrow(_encode(shared), _ENCODED.format(kind=kind)).withColumn("row", F.monotonically_increasing_id()))
    # counts of the words beyond the broadcast ones
    rare = encoded.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("n"))
    c = F.coalesce(F.col("c"), F.lit(0))
    more = rare.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("n") * F.log10(c + 1.0)).alias("rare_log"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    weights = spark.sparkContext.broadcast(train(encoded, v, settings))
    columns = ["row", "doc_id", "n_tokens", "n_known", "base", "tail"]
    scored = encoded.select(*columns, "ids").mapInArrow(_score(weights, settings), f"row long, doc_id {kind}, n_tokens long, n_known long, base double, tail double, lm double")
    joined = scored.join(more, "row", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return joined.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + rare_log).alias("base_score"),
        (F.col("lm") + F.col("tail") + rare_log).alias("score"),
    )


#: The columns of the score that SQL can express; used by the tests.
BASE_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS row, doc_id, doc_id IS NOT NULL AND {learn} AS learn,
         list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), '') AS words FROM documents),
t AS (SELECT row, learn, unnest(words) AS word FROM w),
c AS (SELECT word, count(*) AS c FROM t WHERE learn GROUP BY word),
n AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c),
s AS (SELECT t.row, count(*) AS n_tokens, count(c.c) AS n_known, sum(log10((coalesce(c.c, 0) + 1) / (n.n + n.v + 1))) AS base_score
      FROM t LEFT JOIN c USING (word), n GROUP BY t.row)
SELECT w.doc_id, s.n_tokens, s.n_known, CAST(n.n AS BIGINT) AS train_tokens, s.base_score FROM w JOIN s USING (row), n
"""
