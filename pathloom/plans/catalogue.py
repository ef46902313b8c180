"""The registered queries of the document-graph engine, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import metrics as M
from pathloom.functions import text as T
from pathloom.operators import chunking, embedding, entities, evaluation, graph, llm_extract, retrieval
from pathloom.plans.fixtures import view, with_views
from pathloom.sources.files import page

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _rounded(x: Column, places: int = 6) -> Column:
    """As round() of DuckDB: what is rounded to zero keeps its sign, which Spark's own drops."""
    near = F.round(x, places)
    return F.when(near == 0, x * F.lit(0.0)).otherwise(near)


def _plain(df: DataFrame) -> DataFrame:
    """Integers as long and doubles to six places, so both engines give the same values."""
    kinds = {"int": lambda c: F.col(c).cast("long"), "smallint": lambda c: F.col(c).cast("long"), "double": lambda c: _rounded(F.col(c))}
    return df.select(*[kinds[t](c).alias(c) if t in kinds else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: _plain(f(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# --- SQL fragments --------------------------------------------------------------------------------

_W = r"[\x09-\x0D ]"


def s_words(t: str) -> str:
    return rf"regexp_extract_all(coalesce({t}, ''), '[^\x09-\x0D ]+')"


def s_count(t: str) -> str:
    return f"CAST(len({s_words(t)}) AS BIGINT)"


def s_strip(t: str) -> str:
    return f"regexp_replace({t}, '^{_W}+|{_W}+$', '', 'g')"


def s_squeeze(t: str) -> str:
    return f"trim(regexp_replace({t}, '{_W}+', ' ', 'g'))"


def s_numbers(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, '{pattern}'))"


def s_table(t: str) -> str:
    lines = f"string_split({s_strip(t)}, chr(10))"
    return f"(len({lines}) >= 3 AND len(list_filter({lines}, lambda x: {s_numbers('x', T.NUMBER)} > 2)) > 0.5 * len({lines}))"


def s_table_dense(t: str) -> str:
    lines = f"string_split({s_strip(t)}, chr(10))"
    share = f"len(list_filter({lines}, lambda x: {s_numbers('x', T.PERCENT_NUMBER)} > 2)) > 0.4 * len({lines})"
    return f"(len({lines}) >= 3 AND ({share} OR {s_numbers(s_strip(t), T.PERCENT_NUMBER)} > {s_count(t)} / 5))"


def s_normal(t: str) -> str:
    punctuation = T.PUNCTUATION.replace("'", "''").replace('\\"', '"')
    return s_squeeze(f"regexp_replace(lower(coalesce({t}, '')), '{punctuation}', '', 'g')")


def s_sentences(t: str) -> str:
    marked = rf"regexp_replace(coalesce({t}, ''), '([.!?]){_W}+', '\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {s_strip('s')}), lambda s: s <> '')"


def s_fixed(t: str, size: int) -> str:
    step, w = chunking.window_step(size), s_words(t)
    ks = f"range(0, 1 + greatest(0, CAST(ceil((len({w}) - {size}) / {step}) AS BIGINT)))"
    return f"list_transform({ks}, lambda k: array_to_string(({w})[k * {step} + 1 : k * {step} + {size}], ' '))"


def s_overlap(a: str, b: str) -> str:
    times = lambda c: f"len(list_filter({c}, lambda y: y = w))"
    return f"coalesce(list_sum(list_transform(list_distinct({a}), lambda w: least({times(a)}, {times(b)}))), 0)"


def s_f(common: str, a: str, b: str) -> str:
    return f"round(CASE WHEN {common} > 0 THEN 2 * (({common} / {a}) * ({common} / {b})) / ({common} / {a} + {common} / {b}) ELSE 0.0 END, 6)"


def s_ngrams(t: str, n: int) -> str:
    return f"list_transform(range(1, greatest(1, len({t}) - {n - 2})), lambda i: array_to_string({t}[i : i + {n - 1}], ' '))"


# --- documents ------------------------------------------------------------------------------------


@query("doc_nonempty", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars FROM documents WHERE length(text) > 0")
def _(spark, sf):
    return view(spark, sf, "documents").where(F.length("text") > 0).select("doc_id", F.char_length("text").alias("n_chars"))


@query("doc_base_filename", with_views("file_names") + "SELECT doc_id, regexp_extract(path, '([^/]+)$', 1) AS filename FROM file_names")
def _(spark, sf):
    return view(spark, sf, "file_names").select("doc_id", T.base_filename("path").alias("filename"))


_TICKER = "CASE " + " ".join(rf"WHEN regexp_matches(filename, '(?i)\b{t}\b') THEN '{t}'" for t in T.COMPANIES) + " ELSE 'Unknown' END"
_COMPANY = "CASE ticker_symbol " + " ".join(f"WHEN '{t}' THEN '{c}'" for t, c in T.COMPANIES.items()) + " ELSE 'Unknown' END"


@query(
    "doc_metadata",
    with_views("file_names")
    + rf""", n AS (SELECT doc_id, regexp_extract(path, '([^/]+)$', 1) AS filename FROM file_names), t AS (SELECT *, {_TICKER} AS ticker_symbol FROM n)
SELECT doc_id, filename, ticker_symbol, {_COMPANY} AS company_name, '10-Q' AS report_type,
       CASE WHEN regexp_matches(filename, '(?i)(\d{{4}})[ _]?Q([1-3])') THEN 'Q' || regexp_extract(filename, '(?i)(\d{{4}})[ _]?Q([1-3])', 2) || ' ' || regexp_extract(filename, '(?i)(\d{{4}})[ _]?Q([1-3])', 1) ELSE 'Unknown' END AS fiscal_quarter_year FROM t""",
)
def _(spark, sf):
    names = view(spark, sf, "file_names").select("doc_id", T.base_filename("path").alias("filename")).withColumn("ticker_symbol", T.ticker("filename"))
    return names.withColumns({"company_name": T.company("ticker_symbol"), "report_type": F.lit(T.REPORT_TYPE), "fiscal_quarter_year": T.fiscal_quarter("filename")})


_PARTS = "(SELECT filing_id, 'doc' AS part, text FROM filing_texts UNION ALL SELECT filing_id, 'results', 'Item 2. Results of Operations' || chr(10) || chr(10) || body2 FROM filings UNION ALL SELECT filing_id, 'lines', body2 FROM filings)"


def _parts(spark, sf):
    f = view(spark, sf, "filings")
    doc = view(spark, sf, "filing_texts").select("filing_id", F.lit("doc").alias("part"), "text")
    results = f.select("filing_id", F.lit("results").alias("part"), F.concat(F.lit("Item 2. Results of Operations\n\n"), "body2").alias("text"))
    return doc.union(results).union(f.select("filing_id", F.lit("lines").alias("part"), F.col("body2").alias("text")))


@query("table_flag_simple", with_views("filing_texts") + f"SELECT filing_id, part, {s_table('text')} AS is_table FROM {_PARTS} p")
def _(spark, sf):
    return _parts(spark, sf).select("filing_id", "part", T.is_table("text").alias("is_table"))


@query("table_flag_hybrid", with_views("filing_texts") + f"SELECT filing_id, part, {s_table_dense('text')} AS is_table FROM {_PARTS} p")
def _(spark, sf):
    return _parts(spark, sf).select("filing_id", "part", T.is_table_dense("text").alias("is_table"))


@query("token_count", f"SELECT doc_id, {s_count('text')} AS n_tokens FROM documents")
def _(spark, sf):
    return view(spark, sf, "documents").select("doc_id", T.word_count("text").alias("n_tokens"))


@query("whitespace_squeeze", f"SELECT doc_id, md5({s_squeeze('text')}) AS squeezed_md5, {s_squeeze('text')} = '' AS blank FROM documents")
def _(spark, sf):
    return view(spark, sf, "documents").select("doc_id", F.md5(T.squeeze("text").cast("binary")).alias("squeezed_md5"), (T.squeeze("text") == "").alias("blank"))


# --- chunkers -------------------------------------------------------------------------------------


def _chunks(spark, sf, method):
    docs = view(spark, sf, "documents").select(F.concat(F.lit("doc"), "doc_id").alias("filename"), "text")
    return chunking.chunk(docs, method)


def _digest(df):
    return df.select("filename", "chunk_index", "token_count", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _fixed_sql(size: int) -> str:
    rows = f"SELECT 'doc' || CAST(doc_id AS STRING) AS filename, unnest({s_fixed('text', size)}) AS t, generate_subscripts({s_fixed('text', size)}, 1) - 1 AS chunk_index FROM documents WHERE length(text) > 0"
    return f"SELECT filename, chunk_index, {s_count('t')} AS token_count, md5(t) AS text_md5 FROM ({rows}) r WHERE t <> ''"


def _sentence_sql(size: int) -> str:
    pieces = "[s]"
    for n, mark in enumerate((";", ":", "—", ". ", "? ", "! ")):
        cut = f"list_filter(list_transform(string_split(p{n}, '{mark}'), lambda q{n}: {s_strip(f'q{n}')}), lambda q{n}: q{n} <> '')"
        pieces = f"flatten(list_transform({pieces}, lambda p{n}: CASE WHEN {s_count(f'p{n}')} > {size} THEN {cut} ELSE [p{n}] END))"
    pieces = f"flatten(list_transform({pieces}, lambda z: CASE WHEN {s_count('z')} > {size} THEN {s_fixed('z', size)} ELSE [z] END))"
    return f"""
WITH RECURSIVE s AS (SELECT doc_id, unnest({s_sentences('text')}) AS s, generate_subscripts({s_sentences('text')}, 1) AS i FROM documents WHERE length(text) > 0),
p AS (SELECT doc_id, i, {s_count('s')} > {size} AS solo, CASE WHEN {s_count('s')} > {size} THEN {pieces} ELSE [s] END AS pieces FROM s),
q AS (SELECT doc_id, i, solo, unnest(pieces) AS t, generate_subscripts(pieces, 1) AS j FROM p),
u AS MATERIALIZED (SELECT doc_id, solo, t, {s_count('t')} AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS i FROM q),
r AS (SELECT doc_id, i, n, solo, 0 AS g FROM u WHERE i = 1
      UNION ALL
      SELECT u.doc_id, u.i, CASE WHEN r.solo OR u.solo OR r.n + u.n > {size} THEN u.n ELSE r.n + u.n END, u.solo, r.g + CASE WHEN r.solo OR u.solo OR r.n + u.n > {size} THEN 1 ELSE 0 END
      FROM r JOIN u ON u.doc_id = r.doc_id AND u.i = r.i + 1),
c AS (SELECT r.doc_id, r.g, string_agg(u.t, ' ' ORDER BY u.i) AS t FROM r JOIN u ON u.doc_id = r.doc_id AND u.i = r.i GROUP BY r.doc_id, r.g)
SELECT 'doc' || CAST(doc_id AS STRING) AS filename, CAST(g AS BIGINT) AS chunk_index, {s_count('t')} AS token_count, md5(t) AS text_md5 FROM c"""


for _size in chunking.SIZES:
    query(f"chunk_fixed_{_size}", _fixed_sql(_size))(lambda spark, sf, m=f"fixed_{_size}": _digest(_chunks(spark, sf, m)))
    query(f"chunk_sentence_{_size}", _sentence_sql(_size))(lambda spark, sf, m=f"sentence_aware_{_size}": _digest(_chunks(spark, sf, m)))


def _hybrid(spark, sf, size, least=None):
    rows = view(spark, sf, "filing_texts").select("chunk_id", F.posexplode(chunking.hybrid(F.col("text"), size, least)).alias("chunk_index", "c"))
    return rows.select("chunk_id", "chunk_index", "c.text", "c.heading", "c.is_table")


def s_windows(t: str, most: int) -> str:
    return f"(CASE WHEN {s_count(t)} > {most} THEN {s_fixed(t, most)} ELSE [{t}] END)"


def s_packed_paragraphs(rows: str, keys: str, least: int, most: int) -> str:
    """CTEs p1 to p3 over ``rows`` (keys, text): p3 has the chunks of each text's paragraphs as the list ``chunks``."""
    unit = "struct_pack(n := {n}, a := {a}, i := {i}, out := {out})"
    none = "CAST([] AS STRUCT(a BIGINT, e BIGINT)[])"
    zero, after = "CAST(0 AS BIGINT)", "acc.i + 1"
    paras = rf"list_filter(list_transform(string_split(regexp_replace(text, '\n[\x09-\x0D ]*\n', chr(2), 'g'), chr(2)), lambda p: {s_strip('p')}), lambda p: p <> '')"
    close = "CASE WHEN acc.a > 0 THEN list_append(acc.out, struct_pack(a := acc.a, e := acc.i)) ELSE acc.out END"
    step = f"""CASE WHEN u.n > {most} THEN {unit.format(n=zero, a=zero, i=after, out=f"list_append({close}, struct_pack(a := acc.i, e := acc.i + 1))")}
      WHEN acc.n + u.n <= {most} AND (u.n >= {least} OR acc.n > 0) THEN {unit.format(n='acc.n + u.n', a='CASE WHEN acc.a > 0 THEN acc.a ELSE acc.i END', i=after, out='acc.out')}
      WHEN acc.n + u.n <= {most} THEN {unit.format(n='acc.n', a='acc.a', i=after, out='acc.out')}
      WHEN u.n >= {least} THEN {unit.format(n='u.n', a='acc.i', i=after, out=close)}
      ELSE {unit.format(n=zero, a=zero, i=after, out=close)} END"""
    units = f"list_transform(paras, lambda p: {unit.format(n=s_count('p'), a=zero, i=zero, out=none)})"
    return f"""p1 AS (SELECT {keys}, {paras} AS paras FROM {rows}),
p2 AS (SELECT {keys}, paras, list_reduce({units}, lambda acc, u: {step}, {unit.format(n=zero, a=zero, i='CAST(1 AS BIGINT)', out=none)}) AS acc FROM p1),
p3 AS (SELECT {keys}, list_filter(flatten(list_transform(list_transform({close}, lambda z: array_to_string(paras[z.a : z.e - 1], chr(10) || chr(10))), lambda t: {s_windows('t', most)})), lambda t: {s_count('t')} >= {least}) AS chunks FROM p2)"""


_IS_HEADING = rf"""(regexp_matches(line, '{chunking.HEADING.replace("'", "''")}') AND (regexp_matches(line, '(?i)^(item|note|part)[ \t]') OR NOT regexp_matches(line, '[.!?;,:][ \t]*$')))"""


def _hybrid_sql(most: int, least: int) -> str:
    windows = f"list_filter(list_transform({s_fixed('body', most)}, lambda t, i: struct_pack(first := i = 1, t := t)), lambda w: {s_count('w.t')} >= {least})"
    return (
        with_views("filing_texts")
        + f""", l AS (SELECT chunk_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM filing_texts),
g AS (SELECT chunk_id, line, i, {_IS_HEADING} AS heads, CAST(sum(CASE WHEN {_IS_HEADING} THEN 1 ELSE 0 END) OVER (PARTITION BY chunk_id ORDER BY i) AS BIGINT) AS s FROM l),
s AS (SELECT chunk_id, s, {s_strip('max(CASE WHEN heads THEN line END)')} AS heading, {s_strip("coalesce(string_agg(CASE WHEN NOT heads THEN line END, chr(10) ORDER BY i), '')")} AS body FROM g GROUP BY chunk_id, s),
k AS (SELECT chunk_id, max(s) AS n FROM s GROUP BY chunk_id),
plain AS (SELECT chunk_id, CAST(0 AS BIGINT) AS s, text FROM filing_texts JOIN k USING (chunk_id) WHERE n = 0
          UNION ALL SELECT chunk_id, s, body AS text FROM s JOIN k USING (chunk_id) WHERE n > 0 AND heading IS NULL AND {s_count('body')} >= {least}),
{s_packed_paragraphs('plain', 'chunk_id, s', least, most)},
h AS (SELECT chunk_id, s, heading, body, CASE WHEN body <> '' THEN heading || chr(10) || body ELSE heading END AS whole FROM s WHERE heading IS NOT NULL),
c AS (SELECT chunk_id, s, unnest(chunks) AS text, generate_subscripts(chunks, 1) AS j, CAST(NULL AS STRING) AS heading, NULL AS tested FROM p3
      UNION ALL SELECT chunk_id, s, whole, 1, heading, NULL FROM h WHERE {s_count('whole')} BETWEEN {least} AND {most}
      UNION ALL SELECT chunk_id, s, CASE WHEN w.first THEN heading || chr(10) || chr(10) || w.t ELSE w.t END, j, heading, w.t
                FROM (SELECT chunk_id, s, heading, unnest({windows}) AS w, generate_subscripts({windows}, 1) AS j FROM h WHERE {s_count('whole')} > {most}) x)
SELECT chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY s, j) - 1 AS chunk_index, text, heading, {s_table_dense('coalesce(tested, text)')} AS is_table FROM c"""
    )


for _size, _least in ((24, 5), (256, None), (512, None), (1024, None)):
    query(f"chunk_hybrid_{_size}", _hybrid_sql(_size, int(_size * chunking.OVERLAP) if _least is None else _least))(lambda spark, sf, n=_size, k=_least: _hybrid(spark, sf, n, k))


@query("para_pack_256", f"WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), {s_packed_paragraphs('d', 'doc_id', 25, 256)} SELECT doc_id, generate_subscripts(chunks, 1) - 1 AS chunk_index, md5(unnest(chunks)) AS text_md5 FROM p3")
def _(spark, sf):
    rows = view(spark, sf, "documents").select("doc_id", F.posexplode(chunking.paragraphs(F.col("text"), 25, 256)).alias("chunk_index", "c"))
    return rows.select("doc_id", "chunk_index", F.md5(F.col("c.text").cast("binary")).alias("text_md5"))


@query(
    "section_headings",
    with_views("filing_texts")
    + rf""", l AS (SELECT filing_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM filing_texts)
SELECT filing_id, line AS heading, row_number() OVER (PARTITION BY filing_id ORDER BY i) AS n FROM l
WHERE regexp_matches(line, '{chunking.HEADING.replace("'", "''")}') AND (regexp_matches(line, '(?i)^(item|note|part)[ \t]') OR NOT regexp_matches(line, '[.!?;,:][ \t]*$'))""",
)
def _(spark, sf):
    found = F.filter(chunking.sections(F.col("text")), lambda s: s["heading"].isNotNull())
    return view(spark, sf, "filing_texts").select("filing_id", F.posexplode(found).alias("n", "s")).select("filing_id", F.col("s.heading").alias("heading"), (F.col("n") + 1).alias("n"))


_STATS = " UNION ALL ".join(f"SELECT '{m}' AS method, * FROM ({sql}) x{n}" for n, (m, sql) in enumerate([(f"fixed_{s}", _fixed_sql(s)) for s in chunking.SIZES]))


@query("chunk_stats_by_method", f"SELECT method, count(*) AS n_chunks, CAST(sum(token_count) AS BIGINT) AS n_tokens, max(token_count) AS longest FROM ({_STATS}) a GROUP BY method")
def _(spark, sf):
    docs = view(spark, sf, "documents").select(F.concat(F.lit("doc"), "doc_id").alias("filename"), "text")
    rows = chunking.chunk_all(docs, tuple(f"fixed_{s}" for s in chunking.SIZES))
    return rows.groupBy("method").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("token_count").alias("n_tokens"), F.max("token_count").alias("longest"))


@query("chunk_rows", _fixed_sql(256).replace("SELECT filename,", f"SELECT filename || '_fixed_256_' || CAST(chunk_index AS STRING) AS chunk_id, {s_table('t')} AS is_table, CAST(NULL AS STRING) AS heading, filename,", 1))
def _(spark, sf):
    return _chunks(spark, sf, "fixed_256").select("chunk_id", "filename", "chunk_index", "token_count", "is_table", "heading", F.md5(F.col("text").cast("binary")).alias("text_md5"))


# --- graph ----------------------------------------------------------------------------------------


@query("upsert_document_last_wins", "SELECT user_id, arg_max(event_type, event_id) AS event_type, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY user_id")
def _(spark, sf):
    return graph.upsert_last(view(spark, sf, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], F.col("event_id")).drop("event_id")


@query("upsert_first_wins", "SELECT user_id, arg_min(event_type, event_id) AS event_type, round(arg_min(value, event_id), 6) AS value FROM events GROUP BY user_id")
def _(spark, sf):
    return graph.upsert_first(view(spark, sf, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], F.col("event_id")).drop("event_id")


@query(
    "upsert_chunk_merge",
    "WITH o AS (SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events WHERE event_id % 2 = 0 GROUP BY user_id), n AS (SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events WHERE event_id % 3 = 0 GROUP BY user_id) "
    "SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.event_type, o.event_type) AS event_type FROM o FULL JOIN n ON o.user_id = n.user_id",
)
def _(spark, sf):
    rows = view(spark, sf, "events").select("user_id", "event_id", "event_type")
    old, new = (graph.upsert_last(rows.where(F.col("event_id") % n == 0), ["user_id"], F.col("event_id")).drop("event_id") for n in (2, 3))
    return graph.merge_into(old, new, ["user_id"], overwrite=True)


@query("contains_edges", with_views("vector_chunks") + "SELECT DISTINCT filename, chunk_id FROM vector_chunks")
def _(spark, sf):
    return graph.contains_edges(view(spark, sf, "vector_chunks"))


@query("unique_key_violations", with_views("vector_chunks") + "SELECT filename, CAST(chunk_index AS BIGINT) AS chunk_index, count(*) AS n FROM vector_chunks GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf):
    return graph.unique_violations(view(spark, sf, "vector_chunks"), ["filename", "chunk_index"])


_LEAD = "SELECT chunk_index, chunk_id AS src, lead(chunk_id) OVER w AS dst, lead(chunk_index) OVER w AS after FROM vector_chunks WINDOW w AS (PARTITION BY filename, method ORDER BY chunk_index, chunk_id)"


@query("next_chunk_strict", with_views("vector_chunks") + f"SELECT src, dst FROM ({_LEAD}) x WHERE after = chunk_index + 1")
def _(spark, sf):
    return graph.next_chunks(view(spark, sf, "vector_chunks"))


@query("next_chunk_loose", with_views("vector_chunks") + f"SELECT src, dst FROM ({_LEAD}) x WHERE dst IS NOT NULL")
def _(spark, sf):
    return graph.next_chunks(view(spark, sf, "vector_chunks"), strict=False)


@query("new_edge_count", with_views("vector_chunks") + f"SELECT count(*) AS n_new FROM ({_LEAD}) x WHERE dst IS NOT NULL AND after <> chunk_index + 1")
def _(spark, sf):
    chunks = view(spark, sf, "vector_chunks")
    return graph.new_rows(graph.next_chunks(chunks), graph.next_chunks(chunks, strict=False), ["src", "dst"]).agg(F.count(F.lit(1)).alias("n_new"))


# --- entities -------------------------------------------------------------------------------------

_PATTERNS = dict(entities.PatternRecognizer().patterns)
_Q = r"\b(Q[1-4])[ \t\n\r\f-]*(\d{4})\b"
_QUARTERS = f"SELECT DISTINCT chunk_id, unnest(list_transform(list_zip(regexp_extract_all(text, '{_Q}', 1), regexp_extract_all(text, '{_Q}', 2)), lambda p: p[2] || '-' || p[1])) AS key FROM filing_texts"
_HITS = lambda kind: f"SELECT chunk_id, s, unnest(regexp_extract_all(s, '{_PATTERNS[kind]}')) AS t FROM (SELECT chunk_id, unnest({s_sentences('text')}) AS s FROM filing_texts) z"
_ALIAS = "CASE t " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in entities.SEGMENT_ALIASES.items()) + " ELSE t END"
_SEGMENTS = ", ".join(f"'{s}'" for s in entities.SEGMENTS)
_KEYWORDS = "[" + ", ".join(f"'{k}'" for k in sorted(entities.METRIC_KEYWORDS, key=lambda k: (-len(k), k))) + "]"
_KEYWORD = f"list_filter({_KEYWORDS}, lambda k: contains(lower(s), k))[1]"
_MENTION_SQL = {
    "Quarter": f"SELECT chunk_id, 'Quarter' AS label, key, CAST(NULL AS STRING) AS v FROM ({_QUARTERS}) a",
    "Company": f"SELECT DISTINCT chunk_id, 'Company' AS label, t AS key, CAST(NULL AS STRING) AS v FROM ({_HITS('ORG')}) b",
    "Segment": f"SELECT DISTINCT chunk_id, 'Segment' AS label, {_ALIAS} AS key, CAST(NULL AS STRING) AS v FROM ({_HITS('PRODUCT')}) c WHERE {_ALIAS} IN ({_SEGMENTS})",
    "Metric": f"SELECT chunk_id, 'Metric' AS label, coalesce(upper(left({_KEYWORD}, 1)) || {_KEYWORD}[2:], 'Financial Value (' || t || ')') AS key, min(t) AS v FROM ({_HITS('MONEY')}) d GROUP BY ALL",
    "Location": f"SELECT DISTINCT chunk_id, 'Location' AS label, t AS key, CAST(NULL AS STRING) AS v FROM ({_HITS('GPE')}) e",
}
_ALL_MENTIONS = "(" + " UNION ALL ".join(_MENTION_SQL.values()) + ")"
_FT = with_views("filing_texts")


def _found(spark, sf):
    return entities.extract(view(spark, sf, "filing_texts").select("chunk_id", "text"))


@query("quarter_mentions", _FT + f"SELECT chunk_id, key, substr(key, 6) AS quarter_id, CAST(left(key, 4) AS BIGINT) AS year FROM ({_QUARTERS}) q")
def _(spark, sf):
    return entities.quarter_mentions(view(spark, sf, "filing_texts").select("chunk_id", "text"))


for _label in ("Company", "Segment", "Metric", "Location"):
    query(f"{_label.lower()}_mentions", _FT + f"SELECT chunk_id, key FROM ({_MENTION_SQL[_label]}) m")(lambda spark, sf, k=_label: _found(spark, sf).where(F.col("label") == k).select("chunk_id", "key"))


@query("chunk_entity_dedupe", _FT + f"SELECT chunk_id, label, key, v AS original_value_text FROM {_ALL_MENTIONS} m")
def _(spark, sf):
    return _found(spark, sf).drop("pos")


@query("entity_first_write_wins", _FT + f"SELECT label, key, arg_min(v, chunk_id) AS original_value_text FROM {_ALL_MENTIONS} m GROUP BY label, key")
def _(spark, sf):
    return graph.entities_of(_found(spark, sf))


@query("mention_edges", _FT + f"SELECT chunk_id, label, key FROM {_ALL_MENTIONS} m")
def _(spark, sf):
    found = _found(spark, sf)
    return graph.mention_edges(found, view(spark, sf, "filing_texts"), graph.entities_of(found))


@query("entity_mention_counts", _FT + f"SELECT label, key, count(*) AS n FROM {_ALL_MENTIONS} m GROUP BY label, key")
def _(spark, sf):
    return graph.mention_edges(_found(spark, sf), view(spark, sf, "filing_texts")).groupBy("label", "key").agg(F.count(F.lit(1)).alias("n"))


_LLM = (
    with_views("llm_json")
    + rf""", b AS (SELECT chunk_id, {s_strip(f"regexp_replace(regexp_replace({s_strip('json')}, '^```(json)?', ''), '```$', '')")} AS j FROM llm_json),
g AS (SELECT chunk_id, CAST(j AS JSON) AS j FROM b WHERE json_valid(j) AND json_type(j, '$.entities') = 'ARRAY' AND json_type(j, '$.relationships') = 'ARRAY'),
e0 AS (SELECT chunk_id, unnest(CAST(json_extract(j, '$.entities') AS JSON[])) AS e, generate_subscripts(CAST(json_extract(j, '$.entities') AS JSON[]), 1) AS pos FROM g),
e1 AS (SELECT chunk_id, pos, {s_strip("e->>'label'")} AS l, {s_strip("e->>'name'")} AS name, try_cast(e->>'year' AS BIGINT) AS y, upper(e->>'quarter_id') AS q FROM e0),
e2 AS (SELECT chunk_id, pos, upper(left(l, 1)) || lower(substr(l, 2)) AS label, name, y, q FROM e1 WHERE l <> '' AND name <> ''),
ent AS (SELECT chunk_id, label, name, CASE WHEN label = 'Quarter' THEN CAST(y AS STRING) || '-' || q ELSE name END AS key, CASE WHEN label = 'Quarter' THEN y END AS year, CASE WHEN label = 'Quarter' THEN q END AS quarter_id
        FROM e2 WHERE label <> 'Quarter' OR (y IS NOT NULL AND regexp_matches(q, '^Q[1-4]$')) QUALIFY row_number() OVER (PARTITION BY chunk_id, name ORDER BY pos DESC) = 1),
r0 AS (SELECT chunk_id, unnest(CAST(json_extract(j, '$.relationships') AS JSON[])) AS r FROM g),
r1 AS (SELECT chunk_id, upper(replace({s_strip("r->>'type'")}, ' ', '_')) AS type, {s_strip("r->>'from_entity_name'")} AS a, {s_strip("r->>'to_entity_name'")} AS b FROM r0),
rel AS (SELECT r1.chunk_id, f.label AS from_label, f.key AS from_key, r1.type, t.label AS to_label, t.key AS to_key FROM r1 JOIN ent f ON f.chunk_id = r1.chunk_id AND f.name = a JOIN ent t ON t.chunk_id = r1.chunk_id AND t.name = b WHERE r1.type <> '') """
)


def _parsed(spark, sf):
    return llm_extract.parse(view(spark, sf, "llm_json"))


@query("llm_entities", _LLM + "SELECT chunk_id, label, name, key FROM ent")
def _(spark, sf):
    return llm_extract.entities(_parsed(spark, sf)).select("chunk_id", "label", "name", "key")


@query("llm_quarters", _LLM + "SELECT chunk_id, key, year, quarter_id, name AS original_name FROM ent WHERE label = 'Quarter'")
def _(spark, sf):
    return llm_extract.entities(_parsed(spark, sf)).where("label = 'Quarter'").select("chunk_id", "key", "year", "quarter_id", "original_name")


@query("llm_relationships", _LLM + "SELECT * FROM rel")
def _(spark, sf):
    parsed = _parsed(spark, sf)
    return llm_extract.relationships(parsed, llm_extract.entities(parsed)).drop("pos")


@query("entity_rel_edges", _LLM + "SELECT from_label, from_key, type, to_label, to_key, min(chunk_id) AS source_chunk_id FROM rel GROUP BY ALL")
def _(spark, sf):
    parsed = _parsed(spark, sf)
    return llm_extract.relation_edges(llm_extract.relationships(parsed, llm_extract.entities(parsed)))


@query("llm_mention_edges", _LLM + "SELECT DISTINCT chunk_id, label, key FROM ent")
def _(spark, sf):
    found = llm_extract.entities(_parsed(spark, sf))
    return graph.mention_edges(found, view(spark, sf, "llm_json"))


# --- retrieval ------------------------------------------------------------------------------------

_SCORED = "scored AS (SELECT qid, chunk_id, filename, method, is_table, text, greatest(-1, least(1, list_cosine_similarity(CAST(vector AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS cosine FROM questions, vector_chunks)"
_TOP = _SCORED + ", top50 AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, chunk_id) <= 50)"
_RV = with_views("vector_chunks", "questions", "chunk_mentions") + ", " + _TOP + " "
_RANK = "row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, chunk_id)"
_BEST = lambda k: f", best AS (SELECT *, {_RANK} AS rank FROM top50 WHERE method = 'fixed_256' QUALIFY {_RANK} <= {k})"
_TOP_COLUMNS = ("qid", "chunk_id", "rank", "cosine", "score")


def _asked(spark, sf):
    return view(spark, sf, "questions"), view(spark, sf, "vector_chunks")


_TOP_SQL = _RV + f"SELECT qid, chunk_id, {_RANK} AS rank, round(cosine, 6) AS cosine, round((1 + cosine) / 2, 6) AS score FROM top50"


@query("vector_topk", _TOP_SQL)
def _(spark, sf):
    return retrieval.topk_plain(*_asked(spark, sf)).select(*_TOP_COLUMNS)


@query("vector_topk_arrow", _TOP_SQL)
def _(spark, sf):
    return retrieval.topk(*_asked(spark, sf)).select(*_TOP_COLUMNS)


@query("prefilter_topk", _RV + "SELECT qid, method, chunk_id, row_number() OVER (PARTITION BY qid, method ORDER BY cosine DESC, chunk_id) AS rank, round(cosine, 6) AS cosine FROM scored QUALIFY rank <= 5")
def _(spark, sf):
    return retrieval.topk_plain(*_asked(spark, sf), k=5, partition="method").select("qid", "method", "chunk_id", "rank", "cosine")


def _best(spark, sf, k):
    questions, chunks = _asked(spark, sf)
    return retrieval.filtered(retrieval.topk(questions, chunks), chunks, "fixed_256", k)


for _name, _k in (("naive_topk_filtered", 5), ("path_anchors", 10)):
    query(_name, _RV + _BEST(_k) + " SELECT qid, chunk_id, filename, rank, round(cosine, 6) AS cosine FROM best")(lambda spark, sf, k=_k: _best(spark, sf, k).select("qid", "chunk_id", "filename", "rank", "cosine"))

_PATHS = (
    _BEST(10)
    + f""", links AS (SELECT src, dst FROM ({_LEAD}) x WHERE after = chunk_index + 1), named AS (SELECT chunk_id, list_sort(list(DISTINCT label || ':' || key)) AS mentions FROM chunk_mentions GROUP BY chunk_id),
paths AS (SELECT b.*, p.src AS prev_id, pc.text AS prev_text, n.dst AS next_id, nc.text AS next_text, coalesce(named.mentions, []) AS mentions
          FROM best b LEFT JOIN links p ON p.dst = b.chunk_id LEFT JOIN vector_chunks pc ON pc.chunk_id = p.src LEFT JOIN links n ON n.src = b.chunk_id LEFT JOIN vector_chunks nc ON nc.chunk_id = n.dst LEFT JOIN named ON named.chunk_id = b.chunk_id),
ranked AS (SELECT * REPLACE (row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, chunk_id, prev_id NULLS FIRST, next_id NULLS FIRST) AS rank) FROM paths),
first5 AS (SELECT * FROM ranked WHERE rank <= 5) """
)


def _paths(spark, sf, questions=None):
    every, chunks = _asked(spark, sf)
    questions = every if questions is None else questions
    found = retrieval.anchors(retrieval.topk(questions, chunks), chunks, "fixed_256")
    return retrieval.expand(found, chunks, graph.next_chunks(chunks), view(spark, sf, "chunk_mentions"))


@query("path_expand", _RV + _PATHS + "SELECT qid, chunk_id, prev_id, next_id, array_to_string(mentions, ';') AS mentions FROM paths")
def _(spark, sf):
    return _paths(spark, sf).select("qid", "chunk_id", "prev_id", "next_id", F.array_join("mentions", ";").alias("mentions"))


@query("path_rank", _RV + _PATHS + "SELECT qid, rank, chunk_id, round(cosine, 6) AS cosine FROM first5")
def _(spark, sf):
    return retrieval.rank_paths(_paths(spark, sf)).select("qid", "rank", "chunk_id", "cosine")


_PATH_BLOCK = """'Source ' || rank || ' (Retrieved from: ' || filename || '):' || chr(10) || CASE WHEN is_table THEN '- Chunk Type: Table' ELSE '- Chunk Type: Text' END
  || CASE WHEN prev_text <> '' THEN chr(10) || '- Preceding Text Snippet: ...' || right(prev_text, 150) ELSE '' END || chr(10) || '- Main Content: ' || text
  || CASE WHEN next_text <> '' THEN chr(10) || '- Following Text Snippet: ' || left(next_text, 150) || '...' ELSE '' END
  || CASE WHEN len(mentions) > 0 THEN chr(10) || '- Mentions: ' || array_to_string(mentions, '; ') ELSE '' END"""
_NAIVE_BLOCK = "'Source ' || rank || ':' || chr(10) || '- Filename: ' || filename || chr(10) || '- Is Table: ' || CASE WHEN is_table THEN 'True' ELSE 'False' END || chr(10) || '- Content: ' || text"


def _context_sql(block: str, rows: str) -> str:
    gap = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
    return f"""SELECT q.qid, md5(coalesce(array_to_string(list({block} ORDER BY rank) FILTER (WHERE chunk_id IS NOT NULL), {gap}), '')) AS context_md5, count(chunk_id) AS n_hits,
       '[' || coalesce(string_agg('"' || filename || '"', ',' ORDER BY rank), '') || ']' AS filenames, '[' || coalesce(string_agg(CAST(is_table AS STRING), ',' ORDER BY rank), '') || ']' AS is_table_flags
FROM questions q LEFT JOIN {rows} r ON r.qid = q.qid GROUP BY q.qid"""


def _context_digest(df):
    return df.withColumn("context_md5", F.md5(F.col("context").cast("binary"))).drop("context")


@query("path_context", _RV + _PATHS + _context_sql(_PATH_BLOCK, "first5"))
def _(spark, sf):
    return _context_digest(retrieval.contexts(view(spark, sf, "questions"), retrieval.rank_paths(_paths(spark, sf)), retrieval.path_block()))


@query("naive_context", _RV + _BEST(5) + _context_sql(_NAIVE_BLOCK, "best"))
def _(spark, sf):
    return _context_digest(retrieval.contexts(view(spark, sf, "questions"), _best(spark, sf, 5), retrieval.naive_block()))


@query("plain_context", _RV + _BEST(5) + _context_sql("text", "(SELECT * FROM best WHERE text <> '')"))
def _(spark, sf):
    return _context_digest(retrieval.contexts(view(spark, sf, "questions"), _best(spark, sf, 5).where("text <> ''"), retrieval.plain_block()))


@query("no_hit_questions", with_views("vector_chunks", "questions") + "SELECT qid, 'No context found.' AS generated, 'No context retrieved' AS error FROM questions")
def _(spark, sf):
    questions, chunks = _asked(spark, sf)
    none = retrieval.filtered(retrieval.topk(questions, chunks), chunks, "no_such_method", 5)
    found = retrieval.contexts(questions, none, retrieval.naive_block()).join(questions.select("qid", "question"), "qid")
    return evaluation.answer(found, "naive").select("qid", "generated", "error")


@query("no_context_answer", "SELECT item_id AS qid, 'Insufficient context found via graph path retrieval.' AS generated, 'No context retrieved via Path RAG' AS error FROM benchmark")
def _(spark, sf):
    rows = view(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"), F.lit("").alias("context"))
    return evaluation.answer(rows).select("qid", "generated", "error")


_PROMPT = "'Use only these excerpts to answer.' || chr(10) || chr(10) || truth || chr(10) || chr(10) || 'Question: ' || generated || chr(10) || 'Answer briefly:'"


@query("prompt_assembly", with_views("answers") + f"SELECT qid, md5({_PROMPT}) AS prompt_md5 FROM answers WHERE generated IS NOT NULL")
def _(spark, sf):
    return view(spark, sf, "answers").select("qid", F.md5(evaluation.prompt(F.col("truth"), F.col("generated")).cast("binary")).alias("prompt_md5"))


_ASKED_WORDS = f"list_distinct({s_words('lower(question)')})"
_SENTENCE_SCORE = f"len(list_intersect(list_distinct({s_words('lower(s)')}), {_ASKED_WORDS}))"


@query(
    "extractive_answer",
    f"WITH b AS (SELECT conv_id * 100 + turn AS qid, text AS context, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS question FROM conversations), s AS (SELECT qid, question, unnest({s_sentences('context')}) AS s, generate_subscripts({s_sentences('context')}, 1) AS i FROM b WHERE question IS NOT NULL) "
    f"SELECT qid, md5(arg_min(s, i)) AS answer_md5 FROM (SELECT qid, s, i FROM s QUALIFY rank() OVER (PARTITION BY qid ORDER BY {_SENTENCE_SCORE} DESC) = 1) x GROUP BY qid",
)
def _(spark, sf):
    from pyspark.sql import Window

    rows = view(spark, sf, "conversations").withColumn("question", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("question IS NOT NULL")
    rows = rows.select((F.col("conv_id") * 100 + F.col("turn")).alias("qid"), evaluation.extractive_answer(F.col("text"), F.col("question")).alias("a"))
    return rows.where("a IS NOT NULL").select("qid", F.md5(F.col("a").cast("binary")).alias("answer_md5"))


@query("paged_scan", with_views("vector_chunks") + "SELECT chunk_id FROM vector_chunks ORDER BY chunk_id LIMIT 100 OFFSET 50")
def _(spark, sf):
    return page(view(spark, sf, "vector_chunks").select("chunk_id"), ["chunk_id"], 50, 100)


@query("l2_normalize", "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT vec_id, list_transform(v, lambda x: round(x / sqrt(list_dot_product(v, v)), 6)) AS unit FROM e")
def _(spark, sf):
    return view(spark, sf, "embeddings").select("vec_id", F.transform(M.l2_normalize(F.col("embedding")), lambda x: _rounded(x)).alias("unit"))


@query(
    "cosine_pairs",
    "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)
def _(spark, sf):
    e = view(spark, sf, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(other, "vec_id").select("vec_id", M.cosine(F.col("embedding"), F.col("b")).alias("cosine"))


_PLACE = "CAST('0x' || substr(md5(lower(w)), 1, 6) AS BIGINT) % 64"
_SIGN = "CASE WHEN CAST('0x' || substr(md5(lower(w)), 7, 1) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END"


@query(
    "hash_embedding",
    f"WITH w AS (SELECT item_id, unnest({s_words('text')}) AS w FROM benchmark), p AS (SELECT item_id, {_PLACE} AS place, sum({_SIGN}) AS s FROM w GROUP BY 1, 2), n AS (SELECT *, s / sqrt(sum(s * s) OVER (PARTITION BY item_id)) AS x FROM p) "
    "SELECT item_id, place, round(x, 4) AS x FROM n WHERE s <> 0",
)
def _(spark, sf):
    rows = embedding.embed(view(spark, sf, "benchmark"))
    return rows.select("item_id", F.posexplode("embedding").alias("place", "x")).where("x <> 0").select("item_id", "place", F.round(F.col("x").cast("double"), 4).alias("x"))


# --- evaluation -----------------------------------------------------------------------------------

_R = lambda c: f"regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')"
_B = lambda c: r"regexp_extract_all(coalesce(" + c + r", ''), '[A-Za-z0-9\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]')"
_EM = f"CASE WHEN {s_normal('generated')} = {s_normal('truth')} AND {s_normal('generated')} <> '' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
_TOKENS = (
    f"tok AS (SELECT qid, method, error, generated, {_EM} AS em, {s_words(s_normal('generated'))} AS a, {s_words(s_normal('truth'))} AS b, {_R('generated')} AS ra, {_R('truth')} AS rb, {_B('generated')} AS ha, {_B('truth')} AS hb FROM answers), "
    f"grams AS (SELECT *, {s_ngrams('ra', 2)} AS ra2, {s_ngrams('rb', 2)} AS rb2, " + ", ".join(f"{s_ngrams('ha', n)} AS ha{n}, {s_ngrams('hb', n)} AS hb{n}" for n in (1, 2, 3, 4)) + " FROM tok), "
    f"common AS (SELECT *, {s_overlap('a', 'b')} AS c0, {s_overlap('ra', 'rb')} AS c1, {s_overlap('ra2', 'rb2')} AS c2, " + ", ".join(f"{s_overlap(f'ha{n}', f'hb{n}')} AS h{n}" for n in (1, 2, 3, 4)) + " FROM grams) "
)
_LOGS = []
for _n in range(1, 5):
    _zeros = " + ".join(f"CASE WHEN h{m} = 0 AND len(ha) > 1 THEN 1 ELSE 0 END" for m in range(1, _n + 1))
    _LOGS.append(f"ln(CASE WHEN h{_n} = 0 AND len(ha) > 1 THEN 1.0 / (pow(2.0, {_zeros}) * 5.0 / ln(len(ha))) ELSE CAST(h{_n} AS DOUBLE) END / greatest(len(ha{_n}), 1)) / 4")
_BLEU = f"round(CASE WHEN len(hb) > 0 AND h1 > 0 AND (len(ha) > 1 OR (h2 > 0 AND h3 > 0 AND h4 > 0)) THEN CASE WHEN len(ha) > len(hb) THEN 1.0 ELSE exp(1 - len(hb) / len(ha)) END * exp({' + '.join(_LOGS)}) ELSE 0.0 END, 6)"
_VALUES = {"exact_match": "em", "f1": s_f("c0", "len(a)", "len(b)"), "rouge1": s_f("c1", "len(ra)", "len(rb)"), "rouge2": s_f("c2", "len(ra2)", "len(rb2)"), "bleu": _BLEU}
_AV = with_views("answers") + ", " + _TOKENS


@query("normalize_text", f"SELECT conv_id, turn, md5({s_normal('text')}) AS normal_md5 FROM conversations")
def _(spark, sf):
    return view(spark, sf, "conversations").select("conv_id", "turn", F.md5(T.normalize("text").cast("binary")).alias("normal_md5"))


_COLUMNS = {
    "exact_match": lambda g, t: M.exact_match(g, t),
    "token_f1": lambda g, t: M.token_f1(g, t),
    "rouge1": lambda g, t: M.rouge_n(g, t, 1),
    "rouge2": lambda g, t: M.rouge_n(g, t, 2),
    "bleu4": lambda g, t: M.bleu4(g, t),
}
for _name, _make in _COLUMNS.items():
    _value = _VALUES[{"token_f1": "f1", "bleu4": "bleu"}.get(_name, _name)]
    query(_name, _AV + f"SELECT qid, {_value} AS {_name} FROM common")(lambda spark, sf, n=_name, f=_make: view(spark, sf, "answers").select("qid", f(F.col("generated"), F.col("truth")).alias(n)))

#: A row of the table of common subsequences from the one before; a place takes the best of all up to it.
_LCS_ROW = "list_transform(range(1, len(h) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(p[k], coalesce(p[k - 1], 0) + h[k]))))"
_LCS = f"coalesce(list_reduce(list_transform(ra, lambda x: list_transform(rb, lambda y: CASE WHEN x = y THEN 1 ELSE 0 END)), lambda p, h: {_LCS_ROW}, list_transform(rb, lambda y: 0))[-1], 0)"


@query("rouge_l", with_views("answers") + f", t AS (SELECT qid, {_R('generated')} AS ra, {_R('truth')} AS rb FROM answers), m AS (SELECT *, CASE WHEN len(ra) = 0 OR len(rb) = 0 THEN 0 ELSE {_LCS} END AS c FROM t) SELECT qid, {s_f('c', 'len(ra)', 'len(rb)')} AS rouge_l FROM m")
def _(spark, sf):
    return view(spark, sf, "answers").select("qid", M.rouge_l(F.col("generated"), F.col("truth")).alias("rouge_l"))


@query(
    "semantic_sim",
    with_views("questions")
    + "SELECT q.qid, CAST(v.vec_id AS STRING) AS chunk_id, round(list_cosine_similarity(CAST(q.vector AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS semantic_sim FROM questions q JOIN embeddings v ON v.vec_id % (SELECT count(*) FROM questions) = q.qid",
)
def _(spark, sf):
    e = view(spark, sf, "embeddings")
    q = view(spark, sf, "questions").select("qid", "vector")
    asked = e.crossJoin(F.broadcast(q.agg(F.count(F.lit(1)).alias("n_questions"))))
    return asked.join(q, F.col("vec_id") % F.col("n_questions") == F.col("qid")).select("qid", F.col("vec_id").cast("string").alias("chunk_id"), M.cosine(F.col("vector"), F.col("embedding")).alias("semantic_sim"))


_OK = "error IS NULL AND coalesce(generated, '') <> ''"
_SCORED_SQL = "SELECT qid, method, error, " + ", ".join(f"CASE WHEN {_OK} THEN {v} ELSE 0.0 END AS {k}" for k, v in _VALUES.items()) + f", {s_count('generated')} - 20 AS context_tokens FROM common"


def _scored(spark, sf):
    rows = evaluation.score(view(spark, sf, "answers").withColumn("context_tokens", T.word_count("generated") - 20))
    return rows.select("qid", "method", "error", *_VALUES, "context_tokens")


@query("eval_rows", _AV + _SCORED_SQL)
def _(spark, sf):
    return _scored(spark, sf)


@query(
    "eval_method_averages",
    _AV + f", s AS ({_SCORED_SQL}) SELECT method, count(*) AS n, count(error) AS n_errors, " + ", ".join(f"round(avg({k}), 4) AS avg_{k}" for k in _VALUES) + ", round(coalesce(avg(CASE WHEN context_tokens >= 0 THEN context_tokens END), 0), 6) AS avg_context_tokens FROM s GROUP BY method",
)
def _(spark, sf):
    rows = evaluation.averages(_scored(spark, sf))
    return rows.select("method", "n", "n_errors", *[F.round(f"avg_{k}", 4).alias(f"avg_{k}") for k in _VALUES], "avg_context_tokens")


@query("eval_error_counts", with_views("answers") + "SELECT method, count(error) AS n_errors FROM answers GROUP BY method")
def _(spark, sf):
    return view(spark, sf, "answers").groupBy("method").agg(F.count("error").alias("n_errors"))


@query("eval_grid", "SELECT item_id AS qid, method FROM benchmark, (VALUES " + ", ".join(f"('{m}')" for m in chunking.METHODS) + ") m(method)")
def _(spark, sf):
    return evaluation.grid(view(spark, sf, "benchmark").select(F.col("item_id").alias("qid")), list(chunking.METHODS))


@query(
    "eval_outer_failures",
    _AV + f", s AS ({_SCORED_SQL}) SELECT qid, method, CASE WHEN qid % 5 = 0 THEN 'failed' ELSE error END AS error, " + ", ".join(f"CASE WHEN qid % 5 = 0 THEN NULL ELSE {k} END AS {k}" for k in _VALUES) + ", CASE WHEN qid % 5 = 0 THEN NULL ELSE context_tokens END AS context_tokens FROM s",
)
def _(spark, sf):
    rows = _scored(spark, sf)
    failed = view(spark, sf, "answers").where("qid % 5 = 0").select("qid", "method", F.lit("failed").alias("failure")).distinct()
    return evaluation.outer_failures(rows, failed)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks linked in their documents, searched for each question, expanded along the graph and written out as contexts.

    A smoke run over the first 20 questions; the registered queries ask all.
    """
    questions = view(spark, sf_dir, "questions").where("qid < 20")
    return retrieval.contexts(questions, retrieval.rank_paths(_paths(spark, sf_dir, questions)), retrieval.path_block())
