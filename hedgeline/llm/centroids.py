"""Centroid clustering on an integer lattice, with float32 screening and exact decisions.

Vectors become integers, floor(scale * component). A round multiplies blocks
of them by the centroids in single precision, which is fast and inexact. The
error of such a product of n terms is at most gamma * |x| * |c|, where gamma =
(n + 2) u / (1 - (n + 2) u) and u = 2**-24; the 2 are the roundings of both
factors. So every squared distance lies in a known interval. Centroids whose
interval begins above the smallest upper end can't be nearest; where one is
left it is the nearest, where several are left their distances are computed in
whole numbers and the smallest number wins ties.

New centroids follow from sums that every task adds up in whole numbers. What
reaches the driver is one row for each centroid and component, whatever the
number of vectors. The vectors are written once, as lattice points.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Components below it are held as int32, and squared distances of up to 64 of them fit into a long. Points with larger ones are computed with Python's integers.
NARROW = 1 << 27
#: Sums travel in digits of so many bits, so that no total is too large for a long.
DIGIT = 40
LONGEST = (1 << 63) - 1
POINTS = "vec_id bigint, point binary"


@dataclass(frozen=True)
class Settings:
    clusters: int = 8
    size: int = 64
    scale: int = 1024
    rounds: int = 10
    seed: str = "3"


def kept(rows: DataFrame, settings: Settings) -> DataFrame:
    """vec_id and embedding of the vectors that take part: of the wanted size, no component null or non-finite."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    picked = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.cast("array<double>").alias("embedding"))
    return picked.where((F.size(x) == settings.size) & finite)


def whole(x: float, scale: int) -> int:
    """floor(scale * x) of any finite x."""
    y = scale * x
    return math.floor(y) if math.isfinite(y) else int(x) * scale


def lattice(rows: DataFrame, settings: Settings) -> DataFrame:
    """vec_id and point: int32 components, or the doubles themselves where a component would be NARROW or more."""
    size, scale = settings.size, settings.scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            with np.errstate(over="ignore"):
                q = np.floor(x * scale)
            narrow = (np.abs(q) < NARROW).all(axis=1)
            small = np.where(narrow[:, None], q, 0).astype(np.int32)
            points = [small[i].tobytes() if narrow[i] else x[i].tobytes() for i in range(len(x))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(points, pa.binary())], names=["vec_id", "point"])

    return rows.mapInArrow(run, POINTS)


class Centroids:
    """Whole-numbered centroids, and which of them is nearest to each point."""

    def __init__(self, at: list[tuple[int, ...]], settings: Settings):
        self.at, self.settings = at, settings
        self.narrow = all(abs(v) < NARROW for c in at for v in c)
        if self.narrow:
            self.exact = np.array(at, dtype=np.int64).reshape(len(at), settings.size)
            self.single = self.exact.astype(np.float32)
            self.squares = (self.exact * self.exact).sum(axis=1).astype(np.float64)
            n = (settings.size + 2) * 2.0**-24
            self.gamma = n / (1 - n) * (1 + 2.0**-20)

    def shortlist(self, points: np.ndarray) -> np.ndarray:
        """Which centroids may be nearest to each point (int64 components), by intervals around |c|**2 - 2 x c."""
        products = (points.astype(np.float32) @ self.single.T).astype(np.float64)
        lengths = np.sqrt((points.astype(np.float64) ** 2).sum(axis=1))
        rounding = 2.0**-48 * (self.squares + 2 * np.abs(products))  # of the double arithmetic here
        slack = 2 * self.gamma * lengths[:, None] * np.sqrt(self.squares) + rounding
        middle = self.squares - 2 * products
        return ~(middle - slack > (middle + slack).min(axis=1, keepdims=True))

    def screened(self, points: np.ndarray) -> np.ndarray:
        may = self.shortlist(points)
        best = may.argmax(axis=1)
        open_ = np.flatnonzero(may.sum(axis=1) > 1)
        row, centroid = np.nonzero(may[open_])
        far = ((points[open_[row]] - self.exact[centroid]) ** 2).sum(axis=1)
        order = np.lexsort((centroid, far, row))
        first = np.unique(row[order], return_index=True)[1]
        best[open_] = centroid[order][first]
        return best

    def nearest(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, list]:
        """Of each point its centroid, its squared distance (the largest long if it is larger) and its components."""
        size, scale = self.settings.size, self.settings.scale
        best, far, parts = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64), []
        small = np.array([self.narrow and len(r) == 4 * size for r in raw], dtype=bool)
        if small.any():
            points = np.frombuffer(b"".join(r for r, s in zip(raw, small, strict=True) if s), dtype=np.int32).reshape(-1, size).astype(np.int64)
            best[small] = self.screened(points)
            far[small] = ((points - self.exact[best[small]]) ** 2).sum(axis=1)
            parts.append((best[small], points))
        for i in np.flatnonzero(~small):
            q = np.frombuffer(raw[i], np.int32).tolist() if len(raw[i]) == 4 * size else [whole(v, scale) for v in np.frombuffer(raw[i], np.float64).tolist()]
            d, best[i] = min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(self.at))
            far[i] = min(d, LONGEST)
            parts.append((best[i : i + 1], np.array([q], dtype=object)))
        return best, far, parts


def digits(total: int) -> Iterator[tuple[int, int]]:
    """A whole number by digits of DIGIT bits, the last of which holds the sign."""
    place = 0
    while not -(1 << DIGIT) <= total < 1 << DIGIT:
        yield place, total & ((1 << DIGIT) - 1)
        total, place = total >> DIGIT, place + 1
    yield place, total


def moved(points: DataFrame, centroids: Centroids) -> list[tuple[int, ...]]:
    """The floor of the mean of each centroid's points; a centroid without points stays."""
    size = centroids.settings.size

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list[int]] = {}
        for batch in batches:
            for best, rows in centroids.nearest(batch.column("point").to_pylist())[2]:
                for j in np.unique(best).tolist():
                    mine = rows[best == j]
                    own = totals.setdefault(j, [0] * (size + 1))
                    for i, v in enumerate([*mine.sum(axis=0).tolist(), len(mine)]):
                        own[i] += v
        out = [(j, i, place, v) for j, own in totals.items() for i, total in enumerate(own) for place, v in digits(total)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["cluster", "component", "place", "total"])

    found = points.mapInArrow(sums, "cluster int, component int, place int, total bigint").groupBy("cluster", "component", "place").agg(F.sum("total").alias("total"))
    totals: dict[int, list[int]] = {}
    for r in found.collect():  # as many rows as there are centroids, components and digits
        totals.setdefault(r["cluster"], [0] * (size + 1))[r["component"]] += r["total"] << (DIGIT * r["place"])
    return [tuple(v // totals[j][-1] for v in totals[j][:-1]) if j in totals else old for j, old in enumerate(centroids.at)]


def first_centroids(rows: DataFrame, settings: Settings) -> list[tuple[int, ...]]:
    """The vectors with the smallest sha256 of seed:vec_id; of equal ones the smaller vector first, those without a vec_id last."""
    name = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.col("vec_id").cast("string")), 256)
    found = rows.orderBy(name.asc_nulls_last(), "embedding").limit(settings.clusters).collect()
    return [tuple(whole(x, settings.scale) for x in r["embedding"]) for r in found]


@dataclass(frozen=True)
class Clustering:
    """members: vec_id, cluster, distance. centroids by number, and the rounds that moved one."""

    members: DataFrame
    centroids: list[tuple[int, ...]]
    rounds: int


def cluster(rows: DataFrame, scratch: Scratch, settings: Settings = Settings()) -> Clustering:
    """Cluster vec_id and embedding; other columns take no part.

    Vectors that are null, of another size, or that hold a null or non-finite
    component are left out; zero vectors and those without a vec_id take part.
    Repeated rows are vectors of their own. With fewer vectors than clusters
    there are as many centroids as vectors, and without any there are no rows.
    Distances are squared and exact up to a long, above which the largest long
    is given; decisions are exact at any size. Rounds end early where no
    centroid moves, as all later ones would be alike.
    """
    used = kept(rows, settings)
    at = first_centroids(used, settings)
    points, done = scratch.keep(lattice(used, settings), "points"), 0
    for _ in range(settings.rounds if at else 0):
        new = moved(points, Centroids(at, settings))
        if new == at:
            break
        at, done = new, done + 1
    last = Centroids(at, settings)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, far, _ = last.nearest(batch.column("point").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best, pa.int32()), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])

    members = scratch.keep(points.mapInArrow(assign, "vec_id bigint, cluster int, distance bigint"), "members")
    return Clustering(members, at, done)


def digests(found: Clustering) -> DataFrame:
    """members with cluster_inertia, inertia (the largest long if they are larger) and centroid_sha256, of which there is one for each centroid."""
    sums = {r["cluster"]: int(r["s"]) for r in found.members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row for each centroid
    long = lambda v: min(v, LONGEST)
    rows = [(j, long(s), long(sum(sums.values())), hashlib.sha256(",".join(map(str, found.centroids[j])).encode()).hexdigest()) for j, s in sorted(sums.items())]
    known = found.members.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.members.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
