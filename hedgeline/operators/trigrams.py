"""Search by trigrams: an inverted table that gives the few rows which may hold a text, and the same test on them that a full scan would make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.buckets import BucketedTable

POSTINGS = "gram string, id bigint"
#: Columns that searches look into.
SEARCHED = ("title", "event_title", "ticker")
GRAM = 3
#: Grams of a search that are looked up; the test that follows makes up for the others.
LOOKED_UP = 6


def posting_table(spark: SparkSession, root: str, buckets: int = 64) -> BucketedTable:
    """Which rows hold a gram. A gram's rows lie in one bucket, side by side."""
    return BucketedTable(spark, root, POSTINGS, ("gram", "id"), ("gram",), buckets)


def grams_of(text: Column) -> Column:
    """All stretches of three characters of a text, lower-cased; null and shorter texts have none."""
    low = F.lower(text)
    places = F.when(F.length(low) >= GRAM, F.sequence(F.lit(1), F.length(low) - GRAM + 1))
    return F.coalesce(F.array_distinct(F.transform(places, lambda i: F.substring(low, i, F.lit(GRAM)))), F.array().cast("array<string>"))


def postings(markets: DataFrame) -> DataFrame:
    """gram and id for every row and searched column."""
    return markets.select(F.col("id").cast("bigint").alias("id"), F.explode(F.array_distinct(F.concat(*(grams_of(F.col(c)) for c in SEARCHED)))).alias("gram")).select("gram", "id")


def pieces(pattern: str) -> list[str]:
    """What any text that is like the pattern holds literally: the stretches between wildcards, of which a backslash makes signs."""
    out, held, signs = [], "", iter(pattern)
    for sign in signs:
        if sign in "%_":
            out, held = [*out, held], ""
        else:
            held += next(signs, "\\") if sign == "\\" else sign
    return [p for p in (*out, held) if p]


def sought(texts: list[str]) -> list[str]:
    """Grams that every hit holds, spread over the texts."""
    found = [t[i : i + GRAM] for t in texts for i in range(len(t) - GRAM + 1)]
    distinct = list(dict.fromkeys(found))
    return distinct if len(distinct) <= LOOKED_UP else [distinct[i * len(distinct) // LOOKED_UP] for i in range(LOOKED_UP)]


def narrowed(markets: DataFrame, table: BucketedTable, texts: list[str]) -> DataFrame:
    """The rows that may hold all texts, given in lower case; all rows where no text has three characters."""
    grams = sought(texts)
    if not grams:
        return markets
    buckets = sorted({r["b"] for r in table.spark.createDataFrame([(g,) for g in grams], "gram string").select(table.bucket_of().alias("b")).collect()})
    hits = table.read(buckets, keyed=F.col("gram").isin(grams)).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
    return markets.join(hits.select("id"), "id", "left_semi")


def like(markets: DataFrame, table: BucketedTable, pattern: str) -> DataFrame:
    """Where listing.matching would search all rows, those that it has to look at. % and _ are wildcards."""
    low = table.spark.range(1).select(F.lower(F.lit(pattern)).alias("p")).first()["p"]  # as ilike does it
    return narrowed(markets, table, pieces(low))


def holding(markets: DataFrame, table: BucketedTable, text: str) -> DataFrame:
    """The same for a text without wildcards, as listing.typeahead takes it."""
    return narrowed(markets, table, [text.strip().lower()])
