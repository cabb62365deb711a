"""Pairs of rows with equal keys, dealt by the number of pairs and not by the bytes of the two sides."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of either side that meet at a time, and the pairs meant for a task.
BLOCK_ROWS, TASK_PAIRS = 1_024, 2_000_000
#: The column that says in which cell of a grid a pair lies, and the pairs meant for one.
CELL, CELL_PAIRS = "_cell", 6_000_000
#: Spark joins rows where they lie by a part of the join's keys only without this setting; it is turned off for the session, as a query is planned after it was returned.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def met(a: DataFrame, b: DataFrame, *key: str) -> DataFrame:
    """Each row of a with each row of b of the same key. Columns but the key's have different names.

    The sides are small beside their pairs, so partitions by their bytes would leave all pairs to a few tasks, and a key
    with many rows to one. The rows of a key are cut into blocks on both sides, each block of a meets each of b, and there are as
    many tasks as the number of pairs asks for.
    """
    rows = {"a": a, "b": b}
    counts = {name: side.groupBy(*key).agg(F.count("*").alias(f"_n_{name}")) for name, side in rows.items()}
    sizes = counts["a"].join(counts["b"], list(key))
    total = sizes.agg(F.sum(F.col("_n_a").cast("double") * F.col("_n_b"))).first()[0] or 0
    tasks = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(-(-total // TASK_PAIRS)))
    blocks = sizes.select(*key, *(F.ceil(F.col(f"_n_{name}") / BLOCK_ROWS).cast("int").alias(f"_of_{name}") for name in rows))
    dealt = {}
    for name, other in (("a", "b"), ("b", "a")):
        own = F.pmod(F.xxhash64(*(c for c in rows[name].columns if c not in key)), F.col(f"_of_{name}")).cast("int").alias(f"_{name}")
        every = F.explode(F.sequence(F.lit(0), F.col(f"_of_{other}") - 1)).alias(f"_{other}")
        dealt[name] = rows[name].join(blocks, list(key)).select(*rows[name].columns, own, every).repartition(tasks, *key, "_a", "_b")
    return dealt["a"].join(dealt["b"].hint("merge"), [*key, "_a", "_b"]).drop("_a", "_b")


@dataclass(frozen=True)
class Grid:
    """Where a pair lies, whatever is known of it: hashes of its tickers say in which row (of `a`) and column (of `b`).

    So candidates, verdicts and both sides' markets can lie together in a task, and no join of them moves a pair. `numbers`
    of the cells are such that each is hashed to a partition of its own. Lists of a side's rows with one key are cut into
    `lists` parts where a key has very many.
    """

    a: int
    b: int
    numbers: tuple[int, ...]
    lists: tuple[int, int] = (1, 1)

    @classmethod
    def of(cls, spark: SparkSession, a: int, b: int, lists: tuple[int, int] = (1, 1)) -> Grid:
        cells, found, tried = a * b, {}, 0
        while len(found) < cells:
            tried, start = tried + 16 * cells, tried
            hashed = spark.range(start, tried, 1, 1).select(F.col("id").cast("int").alias("n")).groupBy(F.pmod(F.hash("n"), F.lit(cells)).alias("p")).agg(F.min("n").alias("n"))
            found = {r["p"]: r["n"] for r in hashed.collect()} | found
        return cls(a, b, tuple(n for _, n in sorted(found.items())), lists)

    @property
    def cells(self) -> int:
        return self.a * self.b

    def cell(self) -> Column:
        return self._number(self._place("a"), self._place("b"))

    def _number(self, row: Column, column: Column) -> Column:
        numbers = F.split(F.lit(",".join(map(str, self.numbers))), ",").cast("array<int>")  # one literal, however many cells there are
        return F.element_at(numbers, (row * self.b + column + 1).cast("int"))

    def row_of(self, number: int) -> int:
        return self.numbers.index(number) // self.b

    def _place(self, name: str) -> Column:
        return F.pmod(F.xxhash64(f"{name}_ticker"), F.lit(self.a if name == "a" else self.b))

    def dealt(self, side: DataFrame, name: str) -> DataFrame:
        """The rows of a side (with {name}_ticker), each in every cell that may hold a pair of it."""
        side.sparkSession.conf.set(ALL_KEYS, "false")
        return self._copied(side.withColumn("_place", self._place(name)), name)

    def _copied(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows with a _place on their own side, in all cells of it."""
        crossed = F.explode(F.sequence(F.lit(0), F.lit((self.b if name == "a" else self.a) - 1))).alias("_crossed")
        places = (F.col("_place"), F.col("_crossed"))
        return rows.select("*", crossed).withColumn(CELL, self._number(*(places if name == "a" else places[::-1]))).drop("_place", "_crossed").repartition(self.cells, CELL)


def grid_of(a: DataFrame, b: DataFrame, *key: str) -> Grid:
    """A grid for the pairs of equal keys, with about CELL_PAIRS in a cell, and as many cells as shuffles have partitions, or Spark would shuffle anew."""
    sizes = a.groupBy(*key).agg(F.count("*").alias("_n_a")).join(b.groupBy(*key).agg(F.count("*").alias("_n_b")), list(key))
    total, *most = sizes.agg(F.sum(F.col("_n_a").cast("double") * F.col("_n_b")), F.max("_n_a"), F.max("_n_b")).first()
    side = math.ceil(math.sqrt(max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), (total or 0) / CELL_PAIRS)))
    return Grid.of(a.sparkSession, side, side, tuple(-(-(n or 1) // (side * BLOCK_ROWS)) for n in most))


def in_cells(a: DataFrame, b: DataFrame, *key: str, grid: Grid) -> DataFrame:
    """As met(), with the cell of each pair, and the pairs of a cell in one task. The sides have a_ticker and b_ticker.

    Rows of one key and place go as a list, so that what is copied to each cell is small beside its pairs.
    """
    a.sparkSession.conf.set(ALL_KEYS, "false")
    lists = {}
    for name, side, parts in (("a", a, grid.lists[0]), ("b", b, grid.lists[1])):
        part = F.pmod(F.xxhash64(f"{name}_ticker", F.lit(1)), F.lit(parts)).alias("_part")
        listed = side.withColumn("_row", F.struct(*(c for c in side.columns if c not in key))).groupBy(*key, grid._place(name).alias("_place"), part)
        lists[name] = grid._copied(listed.agg(F.collect_list("_row").alias(f"_{name}")).drop("_part"), name)
    both = lists["a"].join(lists["b"].hint("merge"), [*key, CELL])
    return both.select(CELL, *key, F.explode("_a").alias("_a"), "_b").select(CELL, *key, "_a", F.explode("_b").alias("_b")).select(CELL, *key, "_a.*", "_b.*")


def together(left: DataFrame, right: DataFrame, *key: str, how: str = "inner") -> DataFrame:
    """A join by key, cell by cell where both sides have cells; then the right side is hashed, and nothing is sorted or moved."""
    if CELL in left.columns and CELL in right.columns:
        return left.join(right.hint("shuffle_hash"), [CELL, *key], how)
    return left.join(right.drop(CELL), list(key), how)
