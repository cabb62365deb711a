"""Market-like tables derived from the test tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pairing

#: The clock of all queries.
AS_OF = "TIMESTAMP '2024-01-15 00:00:00'"

MARKETS = """
SELECT m.*, CAST(mid_c AS DOUBLE) / 100 AS price,
       CASE WHEN mid_c - half_c > 0 THEN CAST(mid_c - half_c AS DOUBLE) / 100 END AS yes_bid,
       CASE WHEN id % 17 <> 0 AND mid_c + half_c < 100 THEN CAST(mid_c + half_c AS DOUBLE) / 100 END AS yes_ask,
       CASE WHEN id % 17 <> 0 AND 100 - mid_c + half_c < 100 THEN CAST(100 - mid_c + half_c AS DOUBLE) / 100 END AS no_ask
FROM (
  SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS venue,
         concat(CASE WHEN p_partkey % 2 = 0 THEN 'A-' ELSE 'B-' END, CAST(p_partkey AS VARCHAR(20))) AS ticker,
         concat(p_name, ' ', p_brand) AS title,
         CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END AS event_title,
         CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE 'Yes' END AS label,
         CAST((p_partkey * 37 + p_size * 11) % 99 + 1 AS INT) AS mid_c, CAST(p_size % 25 AS INT) AS half_c,
         CAST(CASE WHEN p_partkey % 13 = 0 THEN 0 ELSE (p_partkey * 7919) % 100003 END AS DOUBLE) AS volume,
         CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(DATE '2024-01-05' + CAST(p_partkey % 60 AS INT) AS TIMESTAMP) END AS close_time,
         CAST(CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 29 END AS DOUBLE) AS liquidity,
         CAST(CASE WHEN p_partkey % 2 = 1 THEN p_partkey % 31 END AS DOUBLE) AS book_depth,
         CAST(CASE WHEN p_partkey % 2 = 1 THEN CASE WHEN p_partkey % 39 = 0 THEN 5 ELSE 0 END END AS DOUBLE) AS open_interest
  FROM {part}) m"""

TICKS = """
SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, concat('T-', CAST(user_id AS VARCHAR(20))) AS ticker,
       CAST(CAST(floor(value) AS BIGINT) % 10 AS DOUBLE) / 10 AS price FROM {events}"""

#: Titles stand in for vector candidates: every market of a with every one of b that has the same title.
PAIRS = """
SELECT a.id AS a_id, b.id AS b_id, a.ticker AS a_ticker, b.ticker AS b_ticker,
       CASE WHEN (a.id + b.id) % 3 = 0 THEN 'inverted' ELSE 'same' END AS direction
FROM ({markets}) a JOIN ({markets}) b ON a.venue = 'a' AND b.venue = 'b' AND a.title = b.title"""

VOTES = """
SELECT CAST(vec_id % 6 AS INT) AS a_idx, label AS b_idx,
       CASE WHEN (vec_id + label) % 4 = 0 THEN 'inverted' ELSE 'same' END AS direction,
       CAST((vec_id * 7) % 11 % 3 AS INT) AS agent_ord,
       CASE WHEN (vec_id * 13) % 9 = 0 THEN 'high' ELSE 'exact' END AS similarity,
       CAST(60 + (vec_id * 13) % 20 * 2 AS DOUBLE) / 100 AS confidence, vec_id AS seq
FROM {embeddings}"""


class Tables:
    """The test tables, and the fixtures over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def markets(self) -> DataFrame:
        return self.spark.sql(MARKETS, part=self.table("part"))

    def venue(self, name: str) -> DataFrame:
        return self.markets().where(f"venue = '{name}'")

    def ticks(self) -> DataFrame:
        return self.spark.sql(TICKS, events=self.table("events"))

    def pairs(self, a: DataFrame | None = None, b: DataFrame | None = None) -> DataFrame:
        """The rows of PAIRS. a, b: the sides with what else each pair is to carry of them."""
        return self.directed(pairing.met(*self._sides(a, b), "title").drop("title"))

    def _sides(self, a: DataFrame | None, b: DataFrame | None) -> list[DataFrame]:
        sides = {name: self.venue(name).select("id", "ticker", "title") if side is None else side for name, side in (("a", a), ("b", b))}
        return [side.withColumnsRenamed({"id": f"{name}_id", "ticker": f"{name}_ticker"}) for name, side in sides.items()]

    def grid(self) -> pairing.Grid:
        """A grid for all pairs."""
        return pairing.grid_of(self.venue("a"), self.venue("b"), "title")

    def celled(self, grid: pairing.Grid, a: DataFrame | None = None, b: DataFrame | None = None) -> DataFrame:
        """The rows of pairs(), each with its cell."""
        return self.directed(pairing.in_cells(*self._sides(a, b), "title", grid=grid).drop("title"))

    def paired(self, venue: str) -> DataFrame:
        """The markets of a venue that stand in a pair, each once, without making the pairs."""
        other = self.venue("b" if venue == "a" else "a")
        return self.venue(venue).join(other.select("title").distinct(), "title", "left_semi")

    @staticmethod
    def directed(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("direction", F.when((F.col("a_id") + F.col("b_id")) % 3 == 0, "inverted").otherwise("same"))

    def votes(self) -> DataFrame:
        return self.spark.sql(VOTES, embeddings=self.table("embeddings"))


def oracle(sql: str) -> str:
    """SQL over `markets`, `ticks`, `pairs` and `votes` as SQL over the test tables."""
    bare = {"part": "part", "events": "events", "embeddings": "embeddings"}
    fixtures = {"markets": MARKETS.format(**bare), "ticks": TICKS.format(**bare), "pairs": PAIRS.replace("({markets})", "markets"), "votes": VOTES.format(**bare)}
    body = sql.strip()
    first = ", ".join(f"{name} AS ({text})" for name, text in fixtures.items())
    return f"WITH {first}, {body.removeprefix('WITH ')}" if body.startswith("WITH ") else f"WITH {first} {body}"
