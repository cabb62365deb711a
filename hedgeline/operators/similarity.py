"""Candidate pairs by cosine of title embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions.parse import blank_to_null
from ..functions.text import tokens
from ..sources.landing import scratch_folder

#: Rows of a block, of either side, that a task multiplies at a time.
BLOCK_ROWS = 2_000
#: Pivots, and the vectors of b that they are chosen from.
PIVOTS, SAMPLE = 64, 4_096
PLACED = "id bigint, size int, pivot int, near double, norm double, vector binary"


def text_a(title: Column, ticker: Column, label: Column) -> Column:
    """The title, or the ticker, with the outcome behind it unless that is yes."""
    name, outcome = F.coalesce(blank_to_null(title), ticker), blank_to_null(label)
    return F.when(outcome.isNotNull() & (F.lower(outcome) != "yes"), F.concat(name, F.lit(" ("), outcome, F.lit(")"))).otherwise(name)


def text_b(event_title: Column, title: Column, ticker: Column, label: Column) -> Column:
    return F.concat_ws(" - ", blank_to_null(event_title), F.coalesce(blank_to_null(title), ticker), blank_to_null(label))


class Embedder(Protocol):
    """Unit vectors of texts; made once per Python worker."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


def embed(texts: DataFrame, column: str, make: Callable[[], Embedder], known: DataFrame | None = None) -> DataFrame:
    """Each distinct text once, with its vector; texts in known (column, vector) aren't embedded again."""
    distinct = texts.select(column).where(F.col(column).isNotNull()).distinct()
    todo = distinct.join(known, column, "left_anti") if known is not None else distinct

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            yield frame.assign(vector=[v.astype(np.float32).tolist() for v in model(frame[column].tolist())] if len(frame) else [])

    out = todo.mapInPandas(run, f"{column} string, vector array<float>")
    return out.unionByName(known.join(distinct, column, "left_semi")) if known is not None else out


def hashed_vectors(text: Column, size: int = 64) -> Column:
    """A stand-in for a language model: counts of hashed tokens, normalised. Not comparable with a trained model's vectors."""
    found = F.transform(tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(size)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(found, lambda x: x == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(counts, lambda x: x / norm)).otherwise(counts)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double; 0 for vectors of different lengths."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(0.0)


class Pivots:
    """Points of one length around which vectors are gathered, and how far each group reaches."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.squares = (points * points).sum(axis=1)
        self.reach, self.longest, self.rows = np.zeros(len(points)), np.zeros(len(points)), np.zeros(len(points), np.int64)

    @classmethod
    def chosen(cls, sample: np.ndarray, most: int) -> Pivots:
        """Points far from each other: the next is always the one farthest from those so far."""
        found, far = [0], ((sample - sample[0]) ** 2).sum(axis=1)
        while len(found) < min(most, len(sample)) and far.max() > 0:
            found.append(int(far.argmax()))
            far = np.minimum(far, ((sample - sample[found[-1]]) ** 2).sum(axis=1))
        return cls(sample[found])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the nearest pivot and its distance."""
        squares = (x * x).sum(axis=1)[:, None] - 2 * x @ self.points.T + self.squares
        best = squares.argmin(axis=1)
        return best, np.sqrt(((x - self.points[best]) ** 2).sum(axis=1))

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """No product of a row with a vector of a group is larger: x y = x p + x (y - p), and both x (y - p) and x y are bounded by their lengths."""
        lengths = np.sqrt((x * x).sum(axis=1))[:, None]
        found = np.minimum(x @ self.points.T + lengths * self.reach, lengths * self.longest)
        return np.where(self.rows > 0, found + 1e-9 * (1 + np.abs(found)), -np.inf)


def matrix(raw, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype=np.float64).reshape(-1, size)


def gathered(rows: DataFrame, pivots: dict[int, Pivots]) -> DataFrame:
    """id, size, pivot (the nearest), near (how near) and vector as bytes; vectors of a length without pivots have the pivot 0."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for size, part in frame.groupby(frame["vector"].map(len)):
                x = np.array(part["vector"].tolist(), dtype=np.float64)
                pivot, near = pivots[size].nearest(x) if size in pivots else (np.zeros(len(x), int), np.zeros(len(x)))
                yield pd.DataFrame({"id": part["id"], "size": size, "pivot": pivot, "near": near, "norm": np.sqrt((x * x).sum(axis=1)), "vector": [v.tobytes() for v in x]})

    usable = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    picked = rows.select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<double>").alias("vector")).where((F.size("vector") > 0) & usable)
    return picked.mapInPandas(run, PLACED)


def best_of(one: pd.DataFrame, two: pd.DataFrame, k: int, min_score: float, digits: int | None) -> pd.DataFrame:
    """The k best of a block of b for each row of a block of a, without sorting what can't be among them. floor, if one has it: a score that k rows of b reach already."""
    empty = pd.DataFrame({"a_id": [], "b_id": [], "score": []}).astype({"a_id": "int64", "b_id": "int64"})
    if not len(one) or not len(two):
        return empty
    size, slack = int(two["size"].iloc[0]), 0.0 if digits is None else 10.0**-digits
    scores = matrix(one["vector"], size) @ matrix(two["vector"], size).T
    least = np.fmax(one["floor"].to_numpy(np.float64), min_score) if "floor" in one else np.full(len(one), min_score)
    may = scores >= (least - slack)[:, None]
    if len(two) > k and np.count_nonzero(may) > 64 * k * len(one):
        edge = np.partition(np.where(may, scores, -np.inf), len(two) - k, axis=1)[:, len(two) - k]
        may &= scores >= (edge - slack)[:, None]
    i, j = np.nonzero(may)
    score, b_id = scores[i, j], two["id"].to_numpy()[j]
    score = score.round(digits) if digits is not None else score
    order = np.lexsort((b_id, -score, i))
    i, b_id, score = i[order], b_id[order], score[order]
    kept = (np.arange(len(i)) - np.searchsorted(i, i) < k) & (score >= min_score)
    return pd.DataFrame({"a_id": one["id"].to_numpy()[i[kept]], "b_id": b_id[kept], "score": score[kept]})


class TopK:
    """For each row of a the k rows of b with the largest inner product, without looking at groups of b that can't hold one.

    b is gathered around pivots, and of each group it is known how far it
    reaches from its pivot and how long its longest vector is. A row of a first
    visits a block of the group whose pivot it is nearest to; the k-th score there
    is a floor, and then it visits only groups whose bound reaches the floor.
    Groups are cut into blocks by id, and so are the visitors of a block, so a task
    multiplies at most BLOCK_ROWS by BLOCK_ROWS whatever the size of a group.
    Pivots come from a bounded sample of b; what depends on it is how much is
    skipped, not the result. visits: which blocks each row went to.
    """

    def __init__(self, a: DataFrame, b: DataFrame, k: int, min_score: float, digits: int | None = None, pivots: int = PIVOTS):
        spark = a.sparkSession
        self.k, self.min_score, self.digits = k, min_score, digits
        self.spark, self.folder = spark, scratch_folder(spark, "topk")
        sample = b.where(F.size("vector") > 0).orderBy(F.xxhash64("id")).limit(SAMPLE).select(F.col("vector").cast("array<double>").alias("v")).where(F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))).collect()  # a bounded sample
        by_size: dict[int, list] = {}
        for row in sample:
            by_size.setdefault(len(row["v"]), []).append(row["v"])
        self.pivots = {size: Pivots.chosen(np.array(rows), max(1, min(pivots, len(rows) // 64))) for size, rows in by_size.items()}
        self.b = self._keep(gathered(b, self.pivots), "b")
        for r in self.b.groupBy("size", "pivot").agg(F.max("near").alias("reach"), F.max("norm").alias("longest"), F.count("*").alias("n")).collect():  # a row for each pivot
            if r["size"] in self.pivots:
                of = self.pivots[r["size"]]
                of.reach[r["pivot"]], of.longest[r["pivot"]], of.rows[r["pivot"]] = r["reach"], r["longest"], r["n"]
        counts = self.b.groupBy("size", "pivot").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
        self.blocks = self._keep(counts, "blocks")  # a row for each pivot and length
        self.a = self._keep(gathered(a, self.pivots), "a")

    def _keep(self, rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{name}")

    def _met(self, visits: DataFrame, name: str) -> DataFrame:
        """a_id, b_id, score of the k best of each visit (id, size, pivot, block, floor)."""
        key = ["size", "pivot", "block"]
        visits = self._keep(visits, f"visits-{name}")
        crowds = visits.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"))
        block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        right = self.b.join(self.blocks, ["size", "pivot"]).withColumn("block", block).join(crowds, key).select("id", "vector", *key, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        left = visits.join(crowds, key).withColumn("part", F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts")).cast("int")).join(self.a.select("id", "vector"), "id").select("id", "vector", "floor", *key, "part")
        best = partial(best_of, k=self.k, min_score=self.min_score, digits=self.digits)
        return left.groupBy(*key, "part").cogroup(right.groupBy(*key, "part")).applyInPandas(lambda one, two: best(one, two), "a_id bigint, b_id bigint, score double")

    def found(self) -> DataFrame:
        """a_id, b_id, score, place: ties go to the smaller b_id."""
        first_block = F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int")
        near = self.a.join(self.blocks, ["size", "pivot"]).select("id", "size", "pivot", first_block.alias("block"))
        seeds = self._keep(self._met(near.withColumn("floor", F.lit(None).cast("double")), "first"), "seeds")
        floors = seeds.groupBy("a_id").agg(F.when(F.count("*") >= self.k, F.min("score")).alias("floor"))
        rows = self.a.join(near.select("id", "block"), "id", "left").join(floors, F.col("id") == F.col("a_id"), "left")
        rows = rows.select("id", "size", "pivot", "vector", F.coalesce("block", F.lit(-1)).alias("seen"), "floor")
        pivots, least, slack = self.pivots, self.min_score, 0.0 if self.digits is None else 10.0**-self.digits

        def reached(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for size, part in frame.groupby("size"):
                    if size in pivots:
                        may = pivots[size].bounds(matrix(part["vector"], size)) >= np.fmax(part["floor"].to_numpy(), least)[:, None] - slack
                    else:
                        may = np.ones((len(part), 1), dtype=bool)
                    i, group = np.nonzero(may)
                    own = group == part["pivot"].to_numpy()[i]
                    yield pd.DataFrame({"id": part["id"].to_numpy()[i], "size": size, "pivot": group, "seen": np.where(own, part["seen"].to_numpy()[i], -1), "floor": part["floor"].to_numpy()[i]})

        again = rows.mapInPandas(reached, "id bigint, size int, pivot int, seen int, floor double").join(self.blocks, ["size", "pivot"])
        again = again.select("id", "size", "pivot", "seen", "floor", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).where("block <> seen").drop("seen")
        every = seeds.unionByName(self._keep(self._met(again, "then"), "rest"))  # written, as whoever numbers the result reads it more than once
        place = F.row_number().over(W.partitionBy("a_id").orderBy(F.desc("score"), "b_id"))
        return every.withColumn("place", place).where(F.col("place") <= self.k)

    def compared(self) -> int:
        """How many pairs were multiplied: of all visits the rows of their blocks."""
        blocks = self.b.join(self.blocks, ["size", "pivot"]).groupBy("size", "pivot", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")).agg(F.count("*").alias("n"))
        visits = [self.spark.read.parquet(f"{self.folder}/visits-{name}") for name in ("first", "then")]
        return visits[0].unionByName(visits[1]).join(blocks, ["size", "pivot", "block"]).agg(F.sum("n")).first()[0] or 0


def top_candidates(a: DataFrame, b: DataFrame, k: int = DEFAULTS.match.per_market, min_score: float = DEFAULTS.match.min_similarity, digits: int | None = None) -> DataFrame:
    """For each row of a (id, vector) the k rows of b with the largest inner product of at least min_score: a_id, b_id, score, place.

    Ties go to the smaller b_id. Vectors of different lengths don't meet; null and empty vectors and those with
    components that are null or not finite take no part. digits: round scores first.
    """
    return TopK(a, b, k, min_score, digits).found()
