"""The engine's facade: ingest, enrich, store, retrieve, ask, evaluate."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import text as T
from pathloom.functions.tokenize import WhitespaceTokenizer
from pathloom.operators import chunking, embedding, entities, evaluation, graph, llm_extract, retrieval
from pathloom.sources import files


@dataclass(frozen=True)
class Config:
    methods: tuple[str, ...] = chunking.METHODS
    k: int = retrieval.TOP_K
    anchors: int = retrieval.ANCHORS
    over_fetch: int = retrieval.OVER_FETCH
    tokenizer: WhitespaceTokenizer = field(default_factory=WhitespaceTokenizer)
    embedder: embedding.HashingEmbedder | embedding.BatchEmbedder = field(default_factory=embedding.HashingEmbedder)
    #: Goes before each question that is embedded; models trained for it want :data:`embedding.QUERY_PREFIX`.
    query_prefix: str = ""
    recognizer: entities.PatternRecognizer = field(default_factory=entities.PatternRecognizer)
    answer: Callable[[DataFrame, str], DataFrame] = evaluation.answer


class Engine:
    """Tables are DataFrames; nothing runs before a result is asked for, or :meth:`store` writes them."""

    def __init__(self, spark: SparkSession, config: Config = Config()):  # noqa: B008
        self.spark, self.config, self.tables = spark, config, {}

    def ingest(self, docs: DataFrame) -> dict[str, DataFrame]:
        """``docs``: (path, text).  Makes documents, chunks (with vectors) and their links.

        Of several files with one name the last path counts.  What was ingested
        before stays; documents of the same name replace theirs, chunks and all.
        """
        named = docs.withColumn("filename", T.base_filename("path"))
        named = graph.upsert_last(named.select("filename", "path", "text"), ["filename"], F.col("path"))
        symbol = T.ticker("filename")
        documents = named.select("filename", T.company(symbol).alias("company_name"), symbol.alias("ticker_symbol"), F.lit(T.REPORT_TYPE).alias("report_type"), T.fiscal_quarter("filename").alias("fiscal_quarter_year"))
        chunks = chunking.chunk_all(named.select("filename", "text"), self.config.methods, tokenizer=self.config.tokenizer)
        chunks = embedding.embed(chunks, embedder=self.config.embedder)
        if "chunks" in self.tables:
            gone = documents.select("filename")
            chunks = self.tables["chunks"].join(gone, "filename", "left_anti").unionByName(chunks)
            documents = graph.merge_into(self.tables["documents"], documents, ["filename"], overwrite=True)
        self.tables |= {"documents": documents, "chunks": chunks, "next_chunk": graph.next_chunks(chunks)}
        return self.tables

    def enrich(self) -> dict[str, DataFrame]:
        found = entities.extract(self.tables["chunks"].select("chunk_id", "text"), self.config.recognizer)
        self.tables["entities"] = graph.entities_of(found)
        self.tables["mentions"] = graph.mention_edges(found, self.tables["chunks"])
        return self.tables

    def enrich_with(self, generator: Callable[[Column], Column], folder: str) -> dict[str, DataFrame]:
        """Entities, mentions and relations from a language model's JSON about each chunk; one request a chunk.

        The replies are written to ``folder`` before they are used, so no request
        is sent twice.  A chunk whose request failed, or whose reply is no such
        object, adds nothing and is listed in the table ``failures``
        (chunk_id, error); all others count.
        """
        chunks = self.tables["chunks"].select("chunk_id", "text")
        chunks.select("chunk_id", generator(llm_extract.prompt(F.col("text"))).alias("reply")).write.mode("overwrite").parquet(folder)
        replies = self.spark.read.parquet(folder)
        parsed = llm_extract.parse(replies.select("chunk_id", F.col("reply.text").alias("json"), F.col("reply.error").alias("error")))
        found = llm_extract.entities(parsed)
        self.tables["entities"] = graph.entities_of(found.withColumn("text", F.col("name")))
        self.tables["mentions"] = graph.mention_edges(found, self.tables["chunks"], self.tables["entities"])
        self.tables["relations"] = llm_extract.relation_edges(llm_extract.relationships(parsed, found))
        self.tables["failures"] = parsed.where(F.col("parsed").isNull()).select("chunk_id", F.coalesce("error", F.lit("no such JSON object")).alias("error"))
        return self.tables

    def store(self, folder: str) -> dict[str, DataFrame]:
        """Write all tables and go on with the written ones, so that chunks and vectors are computed once."""
        files.write_graph(self.tables, folder)
        self.tables = files.read_graph(self.spark, folder, tuple(self.tables))
        return self.tables

    def search(self, questions: DataFrame) -> DataFrame:
        """The nearest chunks of all methods of questions (qid, question)."""
        asked = embedding.embed(questions, "question", self.config.embedder, prefix=self.config.query_prefix).withColumnRenamed("embedding", "vector")
        return retrieval.topk(asked, self.tables["chunks"], self.config.over_fetch)

    def retrieve(self, questions: DataFrame, method: str, how: str = "path", hits: DataFrame | None = None) -> DataFrame:
        """(qid, context, n_hits, filenames, is_table_flags) of questions (qid, question); ``hits`` of :meth:`search` serve all methods."""
        chunks = self.tables["chunks"]
        hits = self.search(questions) if hits is None else hits
        if how == "naive":
            return retrieval.contexts(questions, retrieval.filtered(hits, chunks, method, self.config.k), retrieval.naive_block())
        found = retrieval.anchors(hits, chunks, method, self.config.anchors)
        paths = retrieval.expand(found, chunks, self.tables["next_chunk"], self.tables["mentions"])
        return retrieval.contexts(questions, retrieval.rank_paths(paths, self.config.k), retrieval.path_block())

    def ask(self, question: str, method: str, how: str = "path") -> DataFrame:
        asked = self.spark.createDataFrame([(0, question)], "qid long, question string")
        return self.config.answer(self.retrieve(asked, method, how).join(asked, "qid"), how)

    def evaluate(self, questions: DataFrame, how: str = "path", timed: bool = False) -> DataFrame:
        """``questions``: (qid, question, truth).  One scored row per question and method.

        The vector search runs once for all methods.  ``timed`` runs each method
        at once and adds retrieval_s and total_s, seconds per question: the time
        of a method's batch (and the search) over the number of questions, to
        four decimals, plus the generator's own time where it tells it.
        """
        began = time.monotonic()
        hits = self.search(questions).persist(StorageLevel.MEMORY_AND_DISK)
        n = max(1, hits.select("qid").distinct().count()) if timed else 1
        searched = time.monotonic() - began
        rows = None
        for method in self.config.methods:
            began = time.monotonic()
            context = self.retrieve(questions, method, how, hits)
            if timed:
                context = context.persist(StorageLevel.MEMORY_AND_DISK)
                context.count()
            retrieved = searched + time.monotonic() - began
            found = self.config.answer(context.join(questions, "qid"), how).withColumn("method", F.lit(method))
            if timed:
                found = found.persist(StorageLevel.MEMORY_AND_DISK)
                found.count()
                total = searched + time.monotonic() - began
                found = found.withColumns({"retrieval_s": F.lit(round(retrieved / n, 4)), "total_s": F.lit(round(total / n, 4))})
            rows = found if rows is None else rows.unionByName(found)
        e = self.config.embedder
        return evaluation.score(rows.withColumns({"_g": e.embed(F.col("generated")), "_t": e.embed(F.col("truth"))}), vectors=("_g", "_t")).drop("_g", "_t")
