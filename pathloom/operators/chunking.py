"""Chunkers: one text becomes an array of (text, heading, is_table), as Column expressions.

Three families: fixed windows of tokens, whole sentences packed up to a limit,
and sections or paragraphs.  All stay in the JVM; the folds carry only counts
and start positions, never texts.  Every chunker counts and cuts by the tokenizer
it is given.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.text import WS, is_table, is_table_dense, let, strip
from pathloom.functions.tokenize import WhitespaceTokenizer

SIZES = (256, 512, 1024)
#: Share of a fixed window that the next one repeats, and of the size that a section chunk must reach.
OVERLAP = 0.1
METHODS = tuple(f"{family}_{size}" for family in ("fixed", "sentence_aware", "hybrid_modified") for size in SIZES)
WHITESPACE = WhitespaceTokenizer()
_MARK = "\x01"
_CHUNK = "array<struct<text:string,heading:string,is_table:boolean>>"


def window_step(size: int, overlap: int | None = None) -> int:
    """How far a window moves; an overlap of the size or more is cut to size - 1, and a window always moves."""
    overlap = int(size * OVERLAP) if overlap is None else overlap
    return max(1, size - (max(0, size - 1) if overlap >= size else overlap))


def fixed_texts(text: Column, size: int, overlap: int | None = None, tokenizer: WhitespaceTokenizer = WHITESPACE) -> Column:
    """Array of windows of ``size`` tokens; the last one is the first that reaches the end."""
    step = window_step(size, overlap)

    def cut(tokens: Column) -> Column:
        last = F.ceil((F.size(tokens) - size) / step).cast("int")
        starts = F.when(F.size(tokens) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(last, F.lit(0))))
        return F.transform(starts, lambda k: tokenizer.join(F.slice(tokens, k * step + 1, F.lit(size))))

    return let(tokenizer.tokens(text), cut)


def plain(texts: Column) -> Column:
    """Chunks without heading: stripped, with the table test."""
    return F.transform(texts, lambda t: F.struct(strip(t).alias("text"), F.lit(None).cast("string").alias("heading"), is_table(t).alias("is_table")))


def fixed(text: Column, size: int, tokenizer: WhitespaceTokenizer = WHITESPACE) -> Column:
    return plain(fixed_texts(text, size, tokenizer=tokenizer))


def sentences(text: Column) -> Column:
    """Cut after . ! ? and white space; stripped, without empty ones."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), rf"([.!?]){WS}+", f"$1{_MARK}")
    return F.filter(F.transform(F.split(marked, _MARK), strip), lambda s: s != "")


def split_long(sentence: Column, limit: int, tokenizer: WhitespaceTokenizer = WHITESPACE) -> Column:
    """A sentence of too many words in pieces: at ever weaker marks, each only where a piece is still too long, then by fixed windows."""

    def cut_at(mark: str) -> Callable[[Column], Column]:
        # of one argument: a second one, even with a default, gets the place in the array
        return lambda p: F.when(tokenizer.count(p) > limit, F.filter(F.transform(F.split(p, mark), strip), lambda x: x != "")).otherwise(F.array(p))

    pieces = F.array(sentence)
    for mark in (";", ":", "—", r"\. ", r"\? ", "! "):
        pieces = F.flatten(F.transform(pieces, cut_at(mark)))
    return F.flatten(F.transform(pieces, lambda p: F.when(tokenizer.count(p) > limit, fixed_texts(p, limit, tokenizer=tokenizer)).otherwise(F.array(p))))


def sentence_units(text: Column, limit: int, tokenizer: WhitespaceTokenizer = WHITESPACE, split: Callable[[Column], Column] = sentences) -> Column:
    """Array of (text, n, solo): sentences, and the pieces of long ones, which stand alone."""
    unit = lambda t, solo: F.struct(t.alias("text"), tokenizer.count(t).alias("n"), F.lit(solo).alias("solo"))
    return F.flatten(F.transform(split(text), lambda s: F.when(tokenizer.count(s) > limit, F.transform(split_long(s, limit, tokenizer), lambda p: unit(p, True))).otherwise(F.array(unit(s, False)))))


def packed(units: Column, limit: int) -> Column:
    """Texts of consecutive units joined by a blank, each as long as the limit allows."""
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("solo"), F.array().cast("array<int>").alias("starts"), F.lit(1).alias("i"))

    def step(acc: Column, u: Column) -> Column:
        cut = acc["solo"] | u["solo"] | (acc["n"] + u["n"] > limit)
        return F.struct(
            F.when(cut, u["n"]).otherwise(acc["n"] + u["n"]).alias("n"),
            u["solo"].alias("solo"),
            F.when(cut, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"]).alias("starts"),
            (acc["i"] + 1).alias("i"),
        )

    def join(u: Column) -> Column:
        ends = lambda starts: F.concat(F.slice(starts, 2, 1 << 30), F.array(F.size(u) + 1))
        text = lambda a, e: F.array_join(F.slice(u["text"], a, e - a), " ")
        return let(F.aggregate(u, start, step, lambda acc: acc["starts"]), lambda starts: F.zip_with(starts, ends(starts), text))

    return let(units, join)


def sentence_aware(text: Column, size: int, tokenizer: WhitespaceTokenizer = WHITESPACE, split: Callable[[Column], Column] = sentences) -> Column:
    """Sentences, as ``split`` finds them, packed up to ``size`` tokens; pieces of longer sentences are chunks by themselves."""
    none = F.array().cast("array<string>")
    return plain(let(sentence_units(text, size, tokenizer, split), lambda units: F.when(F.size(units) > 0, packed(units, size)).otherwise(none)))


#: A line that opens a section: Item or Note with a number, Part with a roman one, or a short line in title case or capitals without a final mark.
HEADING = r"^(?:(?i:item|note)[ \t]+[0-9]+[A-Za-z]?\b.*|(?i:part)[ \t]+[IVXivx]+\b.*|[A-Z][A-Za-z&'-]*(?:[ \t]+(?:[A-Z][A-Za-z&'-]*|of|and|the|in|to|for|on)){1,9})$"
_NUMBERED_ENDS = r"[.!?;,:][ \t]*$"


def is_heading(line: Column) -> Column:
    return line.rlike(HEADING) & (line.rlike(r"(?i)^(item|note|part)[ \t]") | ~line.rlike(_NUMBERED_ENDS))


def sections(text: Column) -> Column:
    """Array of (heading, body): lines up to the first heading (heading null), then each heading with what follows it."""

    def cut(lines: Column) -> Column:
        def section(a: Column, e: Column) -> Column:
            body = strip(F.array_join(F.slice(lines, a + 1, F.greatest(e - a - 1, F.lit(0))), "\n"))
            return F.struct(F.when(a > 0, strip(F.element_at(lines, F.greatest(a, F.lit(1))))).alias("heading"), body.alias("body"))

        found = F.filter(F.transform(lines, lambda x, i: F.when(is_heading(x), i + 1)), lambda i: i.isNotNull())
        return let(found, lambda at: F.zip_with(F.concat(F.array(F.lit(0)), at), F.concat(at, F.array(F.size(lines) + 1)), section))

    return let(F.split(F.coalesce(text, F.lit("")), "\n"), cut)


def _chunk(text: Column, heading: Column, table: Column) -> Column:
    return F.struct(text.alias("text"), heading.cast("string").alias("heading"), table.alias("is_table"))


def paragraphs(text: Column, least: int, most: int, tokenizer: WhitespaceTokenizer = WHITESPACE) -> Column:
    """Chunks of consecutive paragraphs with at most ``most`` words in sum and at least ``least`` together.

    A paragraph that is too long is cut into windows; a short one joins a chunk
    that has begun and fits, else it is lost and the next chunk begins anew.
    """
    paras = F.filter(F.transform(F.split(text, r"\n[\x09-\x0D ]*\n"), strip), lambda p: p != "")
    units = F.transform(paras, lambda p: F.struct(p.alias("text"), tokenizer.count(p).alias("n")))
    span = "struct<a:int,e:int>"
    empty = F.array().cast(f"array<{span}>")
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("a"), empty.alias("out"), F.lit(1).alias("i"))

    def close(acc: Column) -> Column:
        """Closed spans with the open one; a span (a, e) is the paragraphs a to e - 1."""
        return F.when(acc["a"] > 0, F.concat(acc["out"], F.array(F.struct(acc["a"].alias("a"), acc["i"].alias("e"))))).otherwise(acc["out"])

    def step(acc: Column, u: Column) -> Column:
        alone = F.array(F.struct(acc["i"].alias("a"), (acc["i"] + 1).alias("e")))
        long, fits, enough = u["n"] > most, acc["n"] + u["n"] <= most, u["n"] >= least
        state = lambda n, a, out: F.struct(n.alias("n"), a.alias("a"), out.alias("out"), (acc["i"] + 1).alias("i"))
        zero = F.lit(0)
        return (
            F.when(long, state(zero, zero, F.concat(close(acc), alone)))
            .when(fits & (enough | (acc["n"] > 0)), state(acc["n"] + u["n"], F.when(acc["a"] > 0, acc["a"]).otherwise(acc["i"]), acc["out"]))
            .when(fits, state(acc["n"], acc["a"], acc["out"]))
            .when(enough, state(u["n"], acc["i"], close(acc)))
            .otherwise(state(zero, zero, close(acc)))
        )

    join = lambda u: F.transform(F.aggregate(u, start, step, close), lambda s: F.array_join(F.slice(u["text"], s["a"], s["e"] - s["a"]), "\n\n"))
    texts = let(units, join)
    cut = F.flatten(F.transform(texts, lambda t: F.when(tokenizer.count(t) > most, fixed_texts(t, most, tokenizer=tokenizer)).otherwise(F.array(t))))
    return F.transform(F.filter(cut, lambda t: tokenizer.count(t) >= least), lambda t: _chunk(t, F.lit(None), is_table_dense(t)))


def hybrid(text: Column, most: int, least: int | None = None, tokenizer: WhitespaceTokenizer = WHITESPACE) -> Column:
    """Sections whole where they fit, in windows where they are too long, and paragraphs where there is no heading."""
    least = int(most * OVERLAP) if least is None else least
    if least >= most:
        raise ValueError("the least size must lie below the largest")

    def of(s: Column) -> Column:
        heading, body = s["heading"], s["body"]
        whole = F.concat_ws("\n", heading, F.nullif(body, F.lit("")))
        windows = F.filter(F.transform(fixed_texts(body, most, tokenizer=tokenizer), lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda w: tokenizer.count(w["t"]) >= least)
        cut = F.transform(windows, lambda w: _chunk(F.when(w["i"] == 0, F.concat(heading, F.lit("\n\n"), w["t"])).otherwise(w["t"]), heading, is_table_dense(w["t"])))
        loose = F.when(tokenizer.count(body) >= least, paragraphs(body, least, most, tokenizer)).otherwise(F.array().cast(_CHUNK))
        one = F.array(_chunk(whole, heading, is_table_dense(whole)))
        return F.when(heading.isNull(), loose).when(tokenizer.count(whole) > most, cut).when(tokenizer.count(whole) >= least, one).otherwise(F.array().cast(_CHUNK))

    whole_text = paragraphs(F.coalesce(text, F.lit("")), least, most, tokenizer)
    return let(sections(text), lambda found: F.when(F.size(found) == 1, whole_text).otherwise(F.flatten(F.transform(found, of))))


def chunker(method: str):
    family, _, size = method.rpartition("_")
    return {"fixed": fixed, "sentence_aware": sentence_aware, "hybrid_modified": hybrid}[family], int(size)


def chunk(docs: DataFrame, method: str, name_col: str = "filename", text_col: str = "text", tokenizer: WhitespaceTokenizer = WHITESPACE) -> DataFrame:
    """One row a chunk: filename, method, chunk_index, chunk_id, text, heading, is_table, token_count.

    ``chunk_index`` is the place before blank chunks are dropped, so it may have
    gaps.  Empty and null texts give no rows.
    """
    make, size = chunker(method)
    made = fixed_texts(F.col(text_col), size, tokenizer=tokenizer) if make is fixed else make(F.col(text_col), size, tokenizer=tokenizer)
    found = docs.where(F.length(text_col) > 0).select(F.col(name_col).alias("filename"), F.posexplode(made).alias("chunk_index", "c"))
    # windows are plain texts, whose heading and table test come after the explode, so a query that asks for neither pays for neither
    text, heading, table = (F.col("c"), F.lit(None).cast("string"), is_table(F.col("c"))) if make is fixed else (F.col("c.text"), F.col("c.heading"), F.col("c.is_table"))
    rows = found.select(
        "filename", F.lit(method).alias("method"), "chunk_index", F.concat_ws("_", "filename", F.lit(method), "chunk_index").alias("chunk_id"), strip(text).alias("text"), heading.alias("heading"), table.alias("is_table")
    )
    return rows.where(F.col("text") != "").withColumn("token_count", tokenizer.count("text"))


def chunk_all(docs: DataFrame, methods: tuple[str, ...] = METHODS, name_col: str = "filename", text_col: str = "text", tokenizer: WhitespaceTokenizer = WHITESPACE) -> DataFrame:
    """The chunks of all methods, one below the other."""
    return reduce(DataFrame.unionByName, [chunk(docs, m, name_col, text_col, tokenizer) for m in methods])
