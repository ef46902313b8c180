"""Personal data: exact base patterns plus bootstrapped contextual extraction, in DataFrame operations only.

Base: four patterns (e-mail, IP, card, phone), matched leftmost and without
overlap for each kind, with validity tests.  Bootstrapping: tokens that look
like identifiers are taken from all texts with the words around them.  Seeds
are those that a base pattern recognises, and as a fifth kind, *secret*, long
strings of letters and digits assigned to a word such as ``token`` or ``key``.
Lexical contexts (word before with its sign, word after, both) are the patterns
of a bipartite graph whose other side are the distinct token values.  In each
iteration

* a pattern's confidence for a kind is the summed score of its distinct values
  over their number plus ``smoothing``, if at least ``support`` of them are
  seeds or score ``confidence`` or more (values discovered on the way support
  patterns as seeds do);
* an unknown value's score for a kind is the highest confidence among its
  patterns.

Occurrences in patterns of at least ``confidence`` are added, if they have the
kind's bare shape.  A pattern with fewer than ``support`` distinct values can
never get there and is left out from the start.

The regular expressions are possessive and anchored at the start of a run of
their characters, so that they match what the plain forms match in linear time
and without recursion, whatever the text.  Positions come from the lengths of
the pieces between matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import keep, release, text_of

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: Equal to the plain forms of the contract, see the module's docstring.
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A run without blanks that holds a digit or an @.
_TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
_LOCAL_NUMBER = r"\([0-9]{2,5}\)[\x20.-]?[0-9]{2,4}[\x20.-]?[0-9]{3,5}"
_ANY = f"{BASE['email']}|{BASE['phone']}|{BASE['ip']}|[0-9](?:[\\x20-]?[0-9]){{9,}}+|{_LOCAL_NUMBER}|{_TOKEN}"
#: What an added value must look like.
_SHAPES = {
    "email": r"^[^@]*[A-Za-z][^@]*@[^@]*[A-Za-z][^@]*$",
    "ip": r"^(?:[0-9]{1,3}[^0-9A-Za-z]+){3}[0-9]{1,3}$|^[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}$",
    "card": r"^(?:[0-9][^0-9A-Za-z]?){13,19}$",
    "phone": r"^[(+]?(?:[0-9][^0-9A-Za-z]{0,2}){7,15}$",
    "secret": r"^(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9_+/=.-]{16,}$",
}
#: All kinds, in the order in which spans that start together are listed.
ALL_KINDS = (*KINDS, "secret")
#: What a secret is assigned to, as a context before it reads (see :func:`_context`).
_CREDENTIAL = "^(?:[a-z0-9_]*_)?(?:token|key|apikey|secret|password|passwd|pwd|credentials?)[=:]+$"
#: A character that no text uses; should one hold it, another stands in for it, of the same length and as foreign to every pattern.
_MARK, _STAND_IN = "﷐", "�"
_CHUNK = 256


def pieces(text: Column, pattern: str) -> Column:
    """The text cut at the matches: between, match, between, ..."""
    return F.split(F.regexp_replace(F.replace(text, F.lit(_MARK), F.lit(_STAND_IN)), F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)


def running(sizes: str) -> str:
    """SQL: for each entry of the column ``sizes`` the sum of those before it.

    In chunks, and sums of chunks, as each step of a fold copies the array it
    has built.
    """
    chunks = f"transform(sequence(0, (size({sizes}) - 1) div {_CHUNK}), c -> slice({sizes}, c * {_CHUNK} + 1, {_CHUNK}))"
    fold = "aggregate({what}, array({start}), (acc, x) -> concat(acc, array(element_at(acc, -1) + x)), acc -> slice(acc, 1, size(acc) - 1))"
    sums = f"transform({chunks}, ch -> aggregate(ch, 0L, (a, x) -> a + x))"
    inner = fold.format(what="ch", start="o")
    return f"flatten(zip_with({fold.format(what=sums, start='0L')}, {chunks}, (o, ch) -> {inner}))"


def valid(kind: str, value: Column) -> Column:
    """The tests that a match of a base pattern must pass."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        number = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\."), lambda x: F.coalesce((F.length(number(x)) <= 3) & (number(x).try_cast("int") <= 255), F.lit(False)))
    if kind == "card":
        places = F.filter(F.transform(F.split(F.reverse(digits), ""), lambda d: d.try_cast("int")), lambda d: d.isNotNull())
        doubled = F.transform(places, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
        luhn = F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0
        return F.when(n.between(14, 19), luhn).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _cut(df: DataFrame, name: str, pattern: str, gate: str, contexts: bool = False) -> DataFrame:
    """Adds ``name``: array of (start, end, value) of the matches, and with ``contexts`` those (before, after); texts without a character of ``gate`` are not searched."""
    found = F.when(F.col("text").rlike(gate), pieces(F.col("text"), pattern)).otherwise(F.array(F.lit("")))
    df = df.withColumn("_p", found).withColumn("_n", F.transform("_p", lambda p: F.char_length(p).cast("long")))
    df = df.withColumn("_s", F.when(F.size("_n") > 1, F.expr(running("_n"))).otherwise(F.expr("array(0L)")))
    odd = lambda a: F.filter(a, lambda x, i: i % 2 == 1)
    even = lambda a: F.filter(a, lambda x, i: i % 2 == 0)
    parts = [odd(F.col("_s")).alias("start"), odd(F.col("_n")).alias("length"), odd(F.col("_p")).alias("value")]
    if contexts:
        between = even(F.col("_p"))
        parts += [F.transform(between, lambda p: _context(p, before=True)).alias("before"), F.transform(F.slice(between, F.lit(2), F.greatest(F.size("_p"), F.lit(1))), lambda p: _context(p, before=False)).alias("after")]
    spans = F.transform(
        F.filter(F.arrays_zip(*parts), lambda z: z["value"].isNotNull()),
        lambda z: F.struct(z["start"].alias("start"), (z["start"] + z["length"]).alias("end"), z["value"].alias("value"), *([z["before"].alias("before"), z["after"].alias("after")] if contexts else [])),
    )
    return df.withColumn(name, spans).drop("_p", "_n", "_s")


def base_spans(df: DataFrame) -> DataFrame:
    """Adds ``base`` to (…, text): the valid base spans as (start, kind number, end), sorted."""
    parts = []

    def checked(number: int, kind: str) -> Column:
        hits = F.filter(f"_{kind}", lambda s: valid(kind, s["value"]))
        return F.transform(hits, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end")))

    for number, kind in enumerate(KINDS):
        df = _cut(df, f"_{kind}", BASE[kind], {"email": "@", "phone": r"\+[0-9]"}.get(kind, "[0-9]"))
        parts.append(checked(number, kind))
    return df.withColumn("base", F.array_sort(F.concat(*parts))).drop(*[f"_{kind}" for kind in KINDS])


_NEAR = 64


def _context(piece: Column, before: bool) -> Column:
    """The last (or first) word of the text before (or after) a token, in lower case with the = and : between; empty where there is none.

    The nearest ``_NEAR`` characters are searched first, and all of the text
    where they do not hold the whole word.
    """
    word, rest = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
    pattern = f"(?<!{word}){word}++{rest}*+$" if before else f"^{rest}*+{word}++"
    found = F.regexp_extract(F.right(piece, F.lit(_NEAR)) if before else F.left(piece, F.lit(_NEAR)), pattern, 0)
    short = (F.char_length(piece) > _NEAR) & ((found == "") | (F.char_length(found) == _NEAR))
    return F.lower(F.regexp_replace(F.when(short, F.regexp_extract(piece, pattern, 0)).otherwise(found), r"[^\p{L}\p{N}_=:]+", ""))


def occurrences(df: DataFrame) -> DataFrame:
    """Adds ``seen`` to (…, text): identifier-like tokens as (start, end, value, kind number or null, patterns)."""
    df = _cut(df, "_any", _ANY, "[0-9@]", contexts=True)

    def look(s: Column) -> Column:
        value = F.regexp_replace(s["value"], "^[^A-Za-z0-9+(]+|[^A-Za-z0-9)]+$", "")
        lead = F.char_length(F.regexp_extract(s["value"], "^[^A-Za-z0-9+(]+", 0))
        left, right = s["before"], s["after"]
        known = [F.when(value.rlike(f"^(?:{BASE[k]})$") & valid(k, value), F.lit(n)) for n, k in enumerate(KINDS)]
        kind = F.coalesce(*known, F.when(left.rlike(_CREDENTIAL) & value.rlike(_SHAPES["secret"]), F.lit(len(KINDS))))
        patterns = F.array(
            F.when(left != "", F.concat(F.lit("<"), left)),
            F.when(right != "", F.concat(F.lit(">"), right)),
            F.when((left != "") & (right != ""), F.concat(F.lit("="), left, F.lit(" "), right)),
        )
        start = s["start"] + lead
        return F.struct(start.alias("start"), (start + F.char_length(value)).alias("end"), F.lower(value).alias("value"), kind.alias("kind"), F.array_compact(patterns).alias("patterns"))

    return df.withColumn("seen", F.filter(F.transform("_any", look), lambda s: s["value"] != "")).drop("_any")


def bootstrap(seen: DataFrame, iterations: int, confidence: float, support: int, smoothing: float) -> DataFrame:
    """(row, start, kind, end) of the occurrences that high-confidence patterns discover.

    ``seen``: (row, start, end, value, kind, patterns, clear); only ``clear``
    ones that no base pattern recognises are returned.
    """
    numbers = range(len(ALL_KINDS))
    edges = keep(seen.select(F.explode("patterns").alias("pattern"), "value", "kind").groupBy("pattern", "value").agg(F.max("kind").alias("kind")))
    patterns = keep(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support))
    seeds = keep(edges.where(F.col("kind").isNotNull()).groupBy("value").agg(F.max("kind").alias("kind")))  # a seed is one in all its contexts
    graph = keep(edges.drop("kind").join(patterns, "pattern").join(seeds, "value", "left"))
    release(edges, patterns, seeds)
    best, trusts = None, []
    for _ in range(iterations + 1):
        scored = graph if best is None else graph.join(best, "value", "left")
        scores = [F.when(F.col("kind").isNotNull(), (F.col("kind") == k).cast("double")).otherwise(F.lit(0.0) if best is None else F.coalesce(f"v{k}", F.lit(0.0))) for k in numbers]
        trust = scored.groupBy("pattern").agg(
            *[F.when(F.count(F.when(s >= confidence, 1)) >= support, F.sum(s) / (F.first("n") + smoothing)).otherwise(F.lit(0.0)).alias(f"c{k}") for k, s in enumerate(scores)]
        )
        trust = keep(trust.where(F.greatest(*[f"c{k}" for k in numbers]) > 0))
        trusts.append(trust)
        if len(trusts) <= iterations:
            best = graph.where(F.col("kind").isNull()).join(trust, "pattern").groupBy("value").agg(*[F.max(f"c{k}").alias(f"v{k}") for k in numbers])
            best = keep(best)
    release(graph, *trusts[:-1])
    sure = trust.where(F.greatest(*[f"c{k}" for k in numbers]) >= confidence)
    sure = sure.select(F.col("pattern"), F.array_position(F.array(*[f"c{k}" for k in numbers]), F.greatest(*[f"c{k}" for k in numbers])).cast("int").alias("k"))
    fits = F.lit(False)
    for k, kind in enumerate(ALL_KINDS):
        fits = F.when(F.col("k") == k + 1, F.col("value").rlike(_SHAPES[kind])).otherwise(fits)
    unknown = seen.where(F.col("clear") & (F.col("kind").isNull() | (F.col("kind") == len(KINDS)))).select("row", "start", "end", "value", F.explode("patterns").alias("pattern"))
    return unknown.join(sure, "pattern").where(fits).groupBy("row", "start", "end").agg((F.min("k") - 1).cast("int").alias("kind")).select("row", "start", "kind", "end")


def _text(spans: Column) -> Column:
    names = F.array(*map(F.lit, ALL_KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", iterations: int = 3, confidence: float = 0.8, support: int = 5, smoothing: float = 1.0) -> DataFrame:
    """One row per input row: doc_id, base and spans, arrays of (start, kind number, end) in code points, end exclusive.

    ``spans`` holds ``base`` and what the bootstrapping adds, of the four kinds
    or the kind ``secret`` (number 4); nothing added overlaps a base span.  A null text counts as empty and has none.  Null and
    repeated ids are carried along; each row is a document of its own.  Other
    columns of the input are not looked at.  An empty table gives an empty
    result.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_of(text_col).alias("text"))
    found = keep(occurrences(base_spans(docs)).drop("text"))
    seen = found.where(F.size("seen") > 0).select("row", "base", F.explode("seen").alias("s"))
    clear = ~F.exists("base", lambda b: (b["start"] < F.col("s.end")) & (F.col("s.start") < b["end"]))
    seen = seen.withColumn("clear", clear).where(F.col("clear") | F.col("s.kind").isNotNull()).select("row", "s.*", "clear")
    added = bootstrap(seen, iterations, confidence, support, smoothing).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("added"))
    all_ = found.join(added, "row", "left")
    return all_.select("doc_id", "base", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added"))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, the SHA-256 of the base spans' text and the text of all spans."""
    def count(n: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long").alias(f"n_{KINDS[n]}")

    counts = [count(n) for n in range(len(KINDS))]
    return found.select("doc_id", *counts, F.sha2(_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), _text(F.col("spans")).alias("spans"))
