"""Entities of chunks: a pluggable recogniser finds candidates, and prioritised rules turn them into nodes.

The default recogniser works with regular expressions over the text, in the
JVM.  Candidates are (chunk_id, pos, text, kind, sentence) with the kinds ORG,
PRODUCT, MONEY, DATE and GPE.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.text import capitalize
from pathloom.operators.chunking import sentences

QUARTER = r"\b(Q[1-4])[ \t\n\r\f-]*(\d{4})\b"

# Names that count as companies whatever their kind.
KNOWN_COMPANIES = ("INTC", "MSFT", "NVDA", "AAPL", "AMZN", "Intel", "Microsoft", "NVIDIA", "Apple", "Amazon")
# Words that make an amount of money a metric.
METRIC_KEYWORDS = (
    "revenue", "net sales", "sales", "gross margin", "net income", "income", "profit", "loss",
    "operating income", "operating expenses", "expenses", "r&d", "research and development",
    "selling, general and administrative", "sg&a", "cash flow", "tax rate", "earnings per share", "eps",
    "inventory", "debt", "assets", "liabilities", "equity", "liquidity", "stock", "shares",
    "buyback", "repurchase", "dividends",
)
# What marks an amount of money.
CURRENCIES = ("$", "€", "£", "¥", "USD", "EUR", "GBP", "JPY")
# Product segments and other spellings of some.
SEGMENTS = (
    "iPhone", "Mac", "iPad", "Watch", "Services", "App Store",
    "Azure", "Windows", "Surface", "Xbox", "LinkedIn", "Server", "Microsoft Cloud",
    "AWS", "Amazon Web Services", "Online stores", "Physical stores", "Third-party seller services", "Subscription services", "Advertising services",
    "Data Center", "Gaming", "Professional Visualization", "Automotive",
    "Client Computing Group", "CCG", "Data Center and AI", "DCAI", "Network and Edge", "NEX", "Mobileye", "Intel Foundry Services", "IFS",
    "Cloud",
)
SEGMENT_ALIASES = {
    "Amazon Web Services": "AWS", "Azure Services": "Azure", "Data Centre": "Data Center", "Cloud Services": "Cloud",
    "iPhone 14": "iPhone", "iPhone 15": "iPhone", "Windows 11": "Windows", "Office 365": "Office Commercial",
}


def _hits(rank: int, kind: str, pattern: str) -> Column:
    found = F.regexp_extract_all("sentence", F.lit(pattern), F.lit(0))
    return F.transform(found, lambda t, i: F.struct(F.lit(rank).alias("rank"), i.alias("i"), t.alias("text"), F.lit(kind).alias("kind")))


@dataclass(frozen=True)
class PatternRecognizer:
    """One regular expression for each kind; the candidates of a sentence come in the order of the kinds."""

    patterns: tuple[tuple[str, str], ...] = (
        ("ORG", r"\b[A-Z][A-Za-z]+#\d+|\b(?:INTC|MSFT|NVDA|AAPL|AMZN|Intel|Microsoft|NVIDIA|Apple|Amazon)\b"),
        ("PRODUCT", r"\b(?:iPhone(?: 1[45])?|iPad|Azure(?: Services)?|Windows(?: 11)?|Xbox|LinkedIn|AWS|Amazon Web Services|Office 365|Data Cent(?:er|re)|Cloud(?: Services)?)\b"),
        ("MONEY", r"(?:[$€£¥]|\b(?:USD|EUR|GBP|JPY) )\d[\d,]*(?:\.\d+)?"),
        ("DATE", r"\bQ[1-4][ \t-]*\d{4}\b"),
        ("GPE", r"\bNATION_\d+\b"),
    )

    def candidates(self, chunks: DataFrame) -> DataFrame:
        rows = chunks.where(F.col("chunk_id").isNotNull() & (F.length("text") > 0))
        found = rows.select("chunk_id", F.posexplode(sentences(F.col("text"))).alias("sentence_pos", "sentence"))
        hits = F.flatten(F.array(*[_hits(n, kind, pattern) for n, (kind, pattern) in enumerate(self.patterns)]))
        return found.select("chunk_id", "sentence_pos", "sentence", F.explode(hits).alias("h")).select(
            "chunk_id", (F.col("sentence_pos") * 1_000_000 + F.col("h.rank") * 100_000 + F.col("h.i")).cast("long").alias("pos"), "h.text", "h.kind", "sentence"
        )


def quarter_mentions(chunks: DataFrame) -> DataFrame:
    """(chunk_id, year, quarter_id, key) of the quarters named in each chunk, each once."""
    rows = chunks.where(F.col("chunk_id").isNotNull() & (F.length("text") > 0))
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(QUARTER), F.lit(1)).alias("q"), F.regexp_extract_all("text", F.lit(QUARTER), F.lit(2)).alias("y"))
    found = rows.select("chunk_id", F.explode(F.array_distinct(pairs)).alias("p"))
    return found.select("chunk_id", F.col("p.y").cast("int").alias("year"), F.col("p.q").alias("quarter_id"), F.concat_ws("-", "p.y", "p.q").alias("key"))


def _lookup(text: Column, names: tuple[str, ...]) -> Column:
    """The spelling in ``names`` of a text, whatever its case; null where there is none."""
    pairs = [F.lit(x) for n in names for x in (n.lower(), n)]
    return F.try_element_at(F.create_map(*pairs), F.lower(text))


def metric_name(sentence: Column, text: Column) -> Column:
    """The longest keyword of the sentence (then by alphabet), else the amount by itself if it names a currency, else null."""
    ordered = F.array(*[F.lit(k) for k in sorted(METRIC_KEYWORDS, key=lambda k: (-len(k), k))])
    keyword = F.try_element_at(F.filter(ordered, lambda k: F.instr(F.lower(sentence), k) > 0), F.lit(1))
    money = F.lit(False)
    for c in CURRENCIES:
        money = money | F.contains(text, F.lit(c))
    return F.coalesce(capitalize(keyword), F.when(money, F.concat(F.lit("Financial Value ("), text, F.lit(")"))))


def classify(candidates: DataFrame) -> DataFrame:
    """Mention candidates as (chunk_id, pos, label, key, original_value_text): the first rule that takes a candidate decides.

    Rules: company, segment (a product that is no known segment is dropped),
    metric, quarter of a date, location.  Empty texts and bare quarters go.
    """
    text = F.col("text")
    exact = text.isin(*KNOWN_COMPANIES)
    alias = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in SEGMENT_ALIASES.items() for x in p]), text), text)
    segment = text.isin(*SEGMENTS, *SEGMENT_ALIASES)
    quarter = F.concat_ws("-", F.nullif(F.regexp_extract(text, QUARTER, 2), F.lit("")), F.nullif(F.regexp_extract(text, QUARTER, 1), F.lit("")))
    kind = F.col("kind")
    node = (
        F.when((kind == "ORG") | exact, F.struct(F.lit("Company").alias("label"), F.coalesce(_lookup(text, KNOWN_COMPANIES), text).alias("key")))
        .when((kind == "PRODUCT") | segment, F.struct(F.lit("Segment").alias("label"), F.when(alias.isin(*SEGMENTS), alias).alias("key")))
        .when(kind == "MONEY", F.struct(F.lit("Metric").alias("label"), metric_name(F.col("sentence"), text).alias("key")))
        .when(kind == "DATE", F.struct(F.lit("Quarter").alias("label"), F.nullif(quarter, F.lit("")).alias("key")))
        .when(kind == "GPE", F.struct(F.lit("Location").alias("label"), text.alias("key")))
    )
    real = (text != "") & ~F.lower(text).isin("q1", "q2", "q3", "q4")
    value = F.when(F.col("node.label") == "Metric", text).alias("original_value_text")
    return candidates.where(real).withColumn("node", node).where(F.col("node.key").isNotNull()).select("chunk_id", "pos", "node.label", "node.key", value)


def dedupe(mentions: DataFrame) -> DataFrame:
    """Of the mentions of a key in a chunk, whatever their labels, the first."""
    by = Window.partitionBy("chunk_id", "key").orderBy("pos")
    return mentions.withColumn("n", F.row_number().over(by)).where("n = 1").drop("n")


def extract(chunks: DataFrame, recognizer: PatternRecognizer = PatternRecognizer()) -> DataFrame:  # noqa: B008
    """Mentions (chunk_id, pos, label, key, original_value_text): quarters of the text first, then the recogniser's."""
    quarters = quarter_mentions(chunks).select("chunk_id", F.lit(-1).cast("long").alias("pos"), F.lit("Quarter").alias("label"), "key", F.lit(None).cast("string").alias("original_value_text"))
    return dedupe(quarters.unionByName(classify(recognizer.candidates(chunks))))
