"""Derived views that give the engine's queries realistic inputs from the star-schema and text tables.

Each view is one SQL text that Spark and DuckDB read alike, over tables or views
of the same names; only the order of a string_agg is put as Spark wants it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from pathloom.runtime import ship

_SEPARATOR = "CASE doc_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN '_' ELSE '' END"
_SYMBOL = "CASE doc_id % 6 WHEN 0 THEN 'AAPL' WHEN 1 THEN 'amzn' WHEN 2 THEN 'INTC' WHEN 3 THEN 'MSFT' WHEN 4 THEN 'NVDA' ELSE 'ZZZZ' END"

FILE_NAMES = f"""
SELECT doc_id, '/data/' || source || '/' || CAST(2020 + doc_id % 5 AS STRING) || {_SEPARATOR} || 'Q' || CAST(1 + doc_id % 4 AS STRING)
       || CASE WHEN doc_id % 7 = 6 THEN '_' ELSE ' ' END || {_SYMBOL} || '.pdf' AS path
FROM documents"""

_METHOD = "CASE n % 3 WHEN 0 THEN 'fixed_256' WHEN 1 THEN 'sentence_aware_256' ELSE 'hybrid_modified_256' END"
#: In every third document one number is left out half way, so links have gaps to meet.
_INDEX = "CAST(floor((n % 30) / 3) AS BIGINT) + CASE WHEN n % 90 >= 45 AND n % 90 < 60 THEN 1 ELSE 0 END"
#: Chunk n has document n and embedding n; the shorter of the two tables starts again.
VECTOR_CHUNKS = f"""
SELECT 'doc' || CAST(CAST(floor(n / 30) AS BIGINT) AS STRING) || '_' || {_METHOD} || '_' || CAST({_INDEX} AS STRING) AS chunk_id,
       'doc' || CAST(CAST(floor(n / 30) AS BIGINT) AS STRING) AS filename, {_METHOD} AS method, CAST({_INDEX} AS INT) AS chunk_index,
       n % 7 = 0 AS is_table, text, embedding, n
FROM (SELECT coalesce(vec_id, doc_id) AS n FROM embeddings FULL JOIN documents ON vec_id = doc_id) i
CROSS JOIN (SELECT count(*) AS n_docs FROM documents) d CROSS JOIN (SELECT count(*) AS n_vecs FROM embeddings) v
JOIN documents ON doc_id = n % n_docs JOIN embeddings ON vec_id = n % n_vecs"""

QUESTIONS = """
SELECT item_id AS qid, text AS question, embedding AS vector
FROM benchmark CROSS JOIN (SELECT count(*) AS n_vecs FROM embeddings) v JOIN embeddings ON vec_id = item_id % n_vecs"""

_MONEY = "CAST(CAST({} AS DECIMAL(18,2)) AS STRING)"
FILINGS = f"""
WITH picked AS (
  SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, l_discount, l_extendedprice,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS n,
         max(l_extendedprice) OVER (PARTITION BY l_suppkey) AS top FROM lineitem),
lines AS (
  SELECT l_suppkey, max(top) AS top,
         string_agg(CAST(CAST(l_quantity AS INT) AS STRING) || ' ' || CAST(n AS STRING) || ' ' || CAST(CAST(round(l_discount * 100) AS INT) AS STRING) || ' ' || {_MONEY.format('l_extendedprice')}, chr(10) ORDER BY n) AS body
  FROM picked GROUP BY l_suppkey)
SELECT s_suppkey AS filing_id, 'filing' || CAST(s_suppkey AS STRING) AS chunk_id, s_name, n_name, r_name,
       'In Q' || CAST(1 + s_suppkey % 4 AS STRING) || ' ' || CAST(1995 + s_suppkey % 5 AS STRING) || ', ' || s_name || ' reported net sales of $' || {_MONEY.format('top')}
         || ' in ' || r_name || '. Operations in ' || n_name || ' were flat.' AS body1,
       body AS body2,
       'Risks grew in ' || n_name || '; prices rose: costs of $' || CAST(s_suppkey % 90 + 10 AS STRING) || ' a unit; demand for ' ||
         CASE s_suppkey % 5 WHEN 0 THEN 'Azure Services' WHEN 1 THEN 'Office 365' WHEN 2 THEN 'Windows 11' WHEN 3 THEN 'Data Centre' ELSE 'gadgets' END || ' fell.' AS body3
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN lines ON l_suppkey = s_suppkey"""

FILING_TEXTS = """
SELECT filing_id, chunk_id, 'Item 1. Business Overview' || chr(10) || chr(10) || body1 || chr(10) || chr(10) || 'Item 2. Results of Operations' || chr(10) || chr(10) || body2
       || chr(10) || chr(10) || 'Risk Factors' || chr(10) || chr(10) || body3 AS text FROM filings"""

LLM_JSON = """
SELECT 'filing' || CAST(s_suppkey AS STRING) AS chunk_id,
       CASE s_suppkey % 10 WHEN 3 THEN 'I could not find any.' WHEN 5 THEN '```json' || chr(10) || j || chr(10) || '```' ELSE j END AS json
FROM (SELECT s_suppkey, '{"entities":[{"label":"company","name":"' || s_name || '"},{"label":"Location","name":" ' || n_name || ' "},{"label":"QUARTER","name":"the quarter","year":' || CAST(1995 + s_suppkey % 5 AS STRING)
        || ',"quarter_id":"q' || CASE WHEN s_suppkey % 10 = 7 THEN '5' ELSE CAST(1 + s_suppkey % 4 AS STRING) END || '"}],"relationships":[{"type":"located in","from_entity_name":"' || s_name || '","to_entity_name":"'
        || CASE WHEN s_suppkey % 10 = 9 THEN 'Nowhere' ELSE n_name END || '"}]}' AS j
      FROM supplier JOIN nation ON s_nationkey = n_nationkey) x"""

ANSWERS = """
SELECT conv_id, turn, truth, CASE WHEN conv_id % 5 = 0 THEN '"' || truth || '"!!' ELSE reply END AS generated,
       CASE WHEN conv_id % 7 = 0 THEN 'timeout' END AS error,
       CASE conv_id % 3 WHEN 0 THEN 'fixed_256' WHEN 1 THEN 'sentence_aware_256' ELSE 'hybrid_modified_256' END AS method, conv_id * 100 + turn AS qid
FROM (SELECT conv_id, turn, role, text AS truth, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations) c
WHERE role = 'user' AND reply IS NOT NULL"""

CHUNK_MENTIONS = """
SELECT chunk_id, 'Location' AS label, n_name AS key FROM vector_chunks JOIN nation ON n_nationkey = n % 25 WHERE n % 4 = 0
UNION ALL SELECT chunk_id, 'Company' AS label, 'C' || CAST(n % 5 AS STRING) AS key FROM vector_chunks WHERE n % 2 = 0"""

#: In an order in which each uses only those before it.
VIEWS = {"file_names": FILE_NAMES, "vector_chunks": VECTOR_CHUNKS, "questions": QUESTIONS, "filings": FILINGS, "filing_texts": FILING_TEXTS, "llm_json": LLM_JSON, "answers": ANSWERS, "chunk_mentions": CHUNK_MENTIONS}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def with_views(*names: str) -> str:
    """The head of a DuckDB query that uses these views."""
    needs = {"filing_texts": "filings", "chunk_mentions": "vector_chunks"}
    wanted = [v for v in VIEWS if v in names or v in [needs.get(n) for n in names]]
    return "WITH " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in wanted) + " "


def spread(df: DataFrame) -> DataFrame:
    """A table whose files give fewer partitions than there are cores, dealt out to all of them; a larger one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or a derived view as a DataFrame, bound to the tables of ``sf_dir``."""
    ship(spark)
    if name in TABLES:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return spread(table) if name == "documents" else table
    used = [other for other in (*TABLES, *VIEWS) if other != name and re.search(rf"\b(FROM|JOIN) {other}\b", VIEWS[name])]
    for other in used:  # under names that no caller's view has
        view(spark, sf_dir, other).createOrReplaceTempView(f"__pathloom_{other}")
    sql = re.sub(rf"\b(FROM|JOIN) ({'|'.join(used)})\b", r"\1 __pathloom_\2", VIEWS[name])
    return spark.sql(re.sub(r", chr\(10\) ORDER BY (\w+)\)", r", chr(10)) WITHIN GROUP (ORDER BY \1)", sql))
