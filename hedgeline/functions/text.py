"""Lexical similarity of market titles, as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stop words, date patterns and event classes that results must agree with.
STOP_WORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was", "be", "been", "will", "this", "that", "these", "those", "it", "its"]
DATE_PATTERNS = [r"\d{4}", r"\d{1,2}/\d{1,2}/\d{2,4}", r"(?i)(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*", r"(?i)q[1-4]", r"(?i)(?:winter|spring|summer|fall|autumn)"]
EVENT_TYPES = {
    "politics": ["election", "vote", "president", "senator", "congress", "parliament"],
    "sports": ["nba", "nfl", "mlb", "nhl", "soccer", "football", "basketball", "championship", "playoff"],
    "economics": ["gdp", "inflation", "fed", "interest rate", "stock", "market", "economy"],
    "entertainment": ["movie", "oscar", "emmy", "grammy", "box office", "album"],
    "weather": ["weather", "temperature", "hurricane", "storm", "climate"],
    "crypto": ["bitcoin", "crypto", "ethereum", "blockchain"],
}

_BEFORE, _AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"  # word edges that, unlike \b, are ASCII in every JVM


def whole_word(pattern: str) -> str:
    flag = "(?i)" if pattern.startswith("(?i)") else ""
    return f"{flag}{_BEFORE}(?:{pattern.removeprefix('(?i)')}){_AFTER}"


def normalize(text: Column) -> Column:
    """Lower case; what is neither word character, space nor hyphen becomes a space; runs of spaces become one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\w\s-]", " "), r"\s+", " "))


def _hits(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower)


def words(text: Column) -> Column:
    """Words of the normalised text longer than two characters: what it puts spaces between are runs of word characters and hyphens."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\w-]{3,}"), F.lit(0))


def tokens(text: Column) -> Column:
    """Distinct words but stop words, then date expressions, digit runs and capitalised words of the raw text.

    Patterns share a pass where none can take what another would find: names of dates are whole words, so at most one text
    stands in a place; runs of digits and capitalised words have no character in common. A year is a run of digits as well.
    """
    year, slashed, *names = DATE_PATTERNS
    dates = F.when(F.contains(text, F.lit("/")), _hits(text, whole_word(slashed))).otherwise(F.array().cast("array<string>"))
    named = whole_word("(?i)(?=[jfmasondqw])(?:" + "|".join(p.removeprefix("(?i)") for p in names) + ")")
    kept = F.array_except(words(text), F.array(*map(F.lit, STOP_WORDS)))
    return F.array_distinct(F.concat(kept, dates, _hits(text, named), _hits(text, r"\d+|[A-Z][a-z]+")))


def document_frequency(rows: DataFrame, column: str, times: str | None = None) -> DataFrame:
    """token and df, the number of rows whose text in the column has it. times: a column that says how many rows a row stands for."""
    found = rows.select(F.explode(tokens(F.col(column))).alias("token"), *([times] if times else []))
    return found.groupBy("token").agg((F.sum(times) if times else F.count("*")).alias("df"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def weighted_jaccard(pairs: DataFrame, frequencies: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """keys and score: Jaccard of the token sets in columns a and b, each token with the weight ln(1 + 1/df); 0 if either is empty.

    frequencies: token, df; a token that isn't there counts as found once. Joined token by token, as the frequencies
    of a large corpus are no map to carry along.
    """
    sides = [pairs.select(*keys, F.explode_outer(c).alias("token"), F.lit(c).alias("_side")) for c in (a, b)]
    met = sides[0].union(sides[1]).groupBy(*keys, "token").agg(F.count_distinct("_side").alias("_sides")).join(frequencies, "token", "left")
    weight = F.when(F.col("token").isNotNull(), F.log1p(1 / F.coalesce("df", F.lit(1))))
    total, empty = F.sum(weight), F.max(F.col("token").isNull())
    return met.groupBy(*keys).agg(F.when(empty, 0.0).otherwise(F.sum(F.when(F.col("_sides") == 2, weight).otherwise(0.0)) / total).alias("score"))


def phrases(text: Column, n: int = 2) -> Column:
    """Runs of n words of the normalised text, stop words among them; none if there are fewer."""

    def runs(found: Column) -> Column:
        shifted = [F.slice(found, k + 1, F.size(found) - (n - 1)) for k in range(n)]
        joined = reduce(lambda x, y: F.zip_with(x, y, lambda u, v: F.concat(u, F.lit(" "), v)), shifted)
        return F.when(F.size(found) >= n, joined).otherwise(F.array().cast("array<string>"))

    return F.element_at(F.transform(F.array(words(text)), runs), 1)  # bound once: an expression inside a function of elements is made anew for each


def counted(found: Column) -> Column:
    """value and n, how often it stands there, of each different element of an array without nulls."""

    def runs(ordered: Column) -> Column:
        starts = F.filter(F.transform(ordered, lambda x, i: F.when((i == 0) | (x != F.get(ordered, i - 1)), i)), lambda i: i.isNotNull())
        lengths = lambda at: F.transform(at, lambda i, k: F.struct(F.get(ordered, i).alias("value"), (F.coalesce(F.get(at, k + 1), F.size(ordered)) - i).cast("bigint").alias("n")))
        return F.get(F.transform(F.array(starts), lengths), F.lit(0))

    return F.get(F.transform(F.array(F.sort_array(found)), runs), F.lit(0))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length; 0 if either is empty."""
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def event_type(text: Column) -> Column:
    """The first class with one of its words in the text, else general."""
    lower = F.lower(text)
    classes = [(name, lower.rlike(whole_word("|".join(found)))) for name, found in EVENT_TYPES.items()]
    name, hit = classes[0]
    return reduce(lambda so_far, x: so_far.when(x[1], x[0]), classes[1:], F.when(hit, name)).otherwise("general")


def compare(a: Column, b: Column) -> Column:
    """Half Jaccard of the tokens, 0.3 edit similarity of the normalised texts, 0.2 for the same event type."""
    token, string = jaccard(tokens(a), tokens(b)), edit_similarity(normalize(a), normalize(b))
    same = event_type(a) == event_type(b)
    return F.struct(token.alias("token_similarity"), string.alias("string_similarity"), event_type(a).alias("event_type_a"), event_type(b).alias("event_type_b"), same.alias("same_event_type"), (token * 0.5 + string * 0.3 + F.when(same, 0.2).otherwise(0.0)).alias("overall"))
