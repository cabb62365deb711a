"""Nearest neighbours by multiprobe p-stable hashing, with exact reranking.

Vectors are put on a sphere: divided by the largest norm and given one more
component that makes the norm one. Then the largest inner product is the least
Euclidean distance, which is what Gaussian (2-stable) projections preserve. A
table cuts each of a few projections into four slots; a bucket is a tuple of
slots, and there are as many projections as leave about `rows` vectors to a
bucket. Slots end at quantiles of a bounded sample, so that buckets hold about as many
vectors each, and the order of success is nearly that of success per vector looked at.

For a neighbour of similarity rho, a projection given the query's own, t, is
normal around rho*t with variance 1 - rho*rho. That gives every bucket, however
perturbed, an estimated probability to hold the neighbour. A query generates
its buckets in the order of that probability and visits them until they reach
its share of `success` in each table. rho is a low quantile of the similarity to the
k-th nearest of all vectors, estimated on the sample.

There are at most 4**MOST_PROJECTIONS buckets in a table, and their sizes are broadcast. Buckets are laid into shards of at most
shard_rows vectors; a larger bucket spans several. A shard's vectors are held
while the queries that visit it stream by, and candidates are ranked by their
exact inner products. Candidates of all tables are merged in the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, partial
from math import erf, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, parallelism
from .vectors import clean, matrix

SLOT_BITS, MOST_PROJECTIONS = 2, 9
#: Neighbours that a task holds at most before it gives them out.
FOUND_ROWS = 1_000_000
SLOTS = 1 << SLOT_BITS
_erf = np.vectorize(erf, otypes=[float])


@dataclass(frozen=True)
class Index:
    """success: of all tables together; rows: vectors that a bucket is meant for; fit_rows: vectors in the sample that slots and rho are fitted on."""

    tables: int = 6
    success: float = 0.91
    rows: int = 3
    fit_rows: int = 4_000
    shard_rows: int = 8_192
    seed: int = 11

    def projections(self, n: int) -> int:
        return int(np.clip(round(log(max(n, 1) / self.rows, SLOTS)), 1, MOST_PROJECTIONS))


class Tables:
    """Projections and slots, fitted on a sample of n vectors, for searches of the k nearest."""

    def __init__(self, index: Index, sample: np.ndarray, n: int, top: float, k: int):
        self.index, self.top, self.projections = index, top, index.projections(n)
        size, columns = sample.shape[1] + 1, index.tables * self.projections
        rng = np.random.default_rng(index.seed)
        blocks = [np.linalg.qr(rng.normal(size=(size, size)))[0] * np.sqrt(size) for _ in range(-(-columns // size))]  # orthogonal within a block
        self.a = np.ascontiguousarray(np.hstack(blocks)[:, :columns].reshape(size, index.tables, self.projections).transpose(1, 0, 2))
        self.edges = np.quantile(self.lifted(sample) @ self.a, np.arange(1, SLOTS) / SLOTS, axis=1).transpose(1, 2, 0)  # tables, projections, SLOTS - 1
        self.rho = self._fitted_rho(sample, n, k)

    def _fitted_rho(self, sample: np.ndarray, n: int, k: int) -> float:
        """A low quantile of the similarity to the k-th nearest of n, which is the nearest of the sample or one further."""
        if len(sample) < 2:
            return 0.5
        probe = sample[:: max(1, len(sample) // 200)]
        s = probe / np.linalg.norm(probe, axis=1, keepdims=True) @ self.lifted(sample)[:, :-1].T
        s[s > 1 - 1e-6] = -1.0  # itself and its copies, but for float error
        place = min(len(sample) - 1, max(1, round(k * len(sample) / n)))
        return float(np.clip(np.quantile(-np.partition(-s, place - 1, axis=1)[:, place - 1], 0.2), 0.1, 0.95))

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x / self.top
        return np.hstack([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(axis=1, keepdims=True)))])

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """Tables by vectors."""
        slot = ((self.lifted(x) @ self.a)[..., None] >= self.edges[:, None]).sum(axis=3)
        return (slot << SLOT_BITS * np.arange(self.projections)).sum(axis=2)

    def slot_success(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities of a neighbour's slot: tables, queries, projections, slots."""
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        t = (np.hstack([unit, np.zeros((len(x), 1))]) @ self.a)[..., None]
        below = 0.5 * (1 + _erf((self.edges[:, None] - self.rho * t) / np.sqrt(2 * max(1e-6, 1 - self.rho * self.rho))))
        ends = np.concatenate([np.zeros((*below.shape[:3], 1)), below, np.ones((*below.shape[:3], 1))], axis=3)
        return np.log(np.maximum(np.diff(ends, axis=3), 1e-12))

    def likeliest(self, log_p: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Up to `most` buckets of one table for each query, in the order of success, and the success up to each. log_p: queries, projections, slots.

        A bucket among the `most` likeliest has its first slots among the
        `most` likeliest choices of first slots, so that others can be left
        out projection by projection.
        """
        bucket, total = np.zeros((len(log_p), 1), dtype=np.int64), np.zeros((len(log_p), 1))
        for i in range(self.projections):
            total = (total[:, :, None] + log_p[:, i, None, :]).reshape(len(log_p), -1)
            bucket = (bucket[:, :, None] | np.arange(SLOTS) << SLOT_BITS * i).reshape(len(log_p), -1)
            if total.shape[1] > most:
                best = np.argpartition(-total, most - 1, axis=1)[:, :most]
                total, bucket = np.take_along_axis(total, best, axis=1), np.take_along_axis(bucket, best, axis=1)
        order = np.argsort(-total, axis=1)
        return np.take_along_axis(bucket, order, axis=1), np.cumsum(np.exp(np.take_along_axis(total, order, axis=1)), axis=1)

    def probes_of_each(self, log_p: np.ndarray, most: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Queries in groups: which they are, their buckets, and how many of them each needs. Only queries that `most` buckets don't suffice for are tried again with more."""
        need, todo = 1 - (1 - self.index.success) ** (1 / self.index.tables), np.arange(len(log_p))
        while len(todo):
            bucket, reached = self.likeliest(log_p[todo], most)
            done = (reached[:, -1] >= need) | (most >= SLOTS**self.projections)
            yield todo[done], bucket[done], (reached[done] < need).sum(axis=1) + 1
            todo, most = todo[~done], most * 4

    def probes(self, log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of one table, as many for each query as the one that needs most of them asks for, and how many each needs."""
        most = max(bucket.shape[1] for who, bucket, _ in self.probes_of_each(log_p) if len(who))
        (_, bucket, n), = self.probes_of_each(log_p, most)
        return bucket, n


def laid_out(table: np.ndarray, bucket: np.ndarray, count: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The first shard of each bucket and how many it spans; buckets are sorted by table and bucket."""
    first, parts, shard, room, of = np.zeros(len(count), dtype=np.int64), np.ones(len(count), dtype=np.int64), -1, 0, -1
    for i, (t, n) in enumerate(zip(table, count, strict=True)):
        if n > rows:
            parts[i] = -(-n // rows)
            first[i], shard, room = shard + 1, shard + parts[i], 0
        else:
            if n > room or t != of:
                shard, room = shard + 1, rows
            first[i], room = shard, room - n
        of = t
    return first, parts


@dataclass
class Layout:
    tables: Tables
    table: np.ndarray
    bucket: np.ndarray
    count: np.ndarray
    first: np.ndarray
    parts: np.ndarray

    @cached_property
    def places(self) -> np.ndarray:
        """Of each table's buckets the number among all, -1 if it is empty; made where it is used."""
        found = np.full((self.tables.index.tables, SLOTS**self.tables.projections), -1, dtype=np.int32)
        found[self.table, self.bucket] = np.arange(len(self.bucket))
        return found

    @cached_property
    def numbers(self) -> np.ndarray:
        """Of each bucket the number in its shard, where each has a row or more."""
        return (np.arange(len(self.first)) - np.searchsorted(self.first, self.first)).astype("<u2")

    def place(self, table: int, bucket: np.ndarray) -> np.ndarray:
        """The number of a bucket among all, -1 if it is empty."""
        return self.places[table][bucket]

    def within(self, place: np.ndarray) -> np.ndarray:
        return self.numbers[place]


ROWS = "shard bigint, query boolean, id bigint, vector binary, buckets binary"


def narrow(x: np.ndarray) -> list[bytes]:
    """Vectors as bytes, in single precision where that is exact."""
    small = x.astype(np.float32)
    return [a.tobytes() if same else b.tobytes() for a, b, same in zip(small, x, (small == x).all(axis=1), strict=True)]


def widened(vectors: list[bytes], size: int) -> np.ndarray:
    out, small = np.empty((len(vectors), size)), np.array([len(v) == 4 * size for v in vectors], dtype=bool)
    out[small] = np.frombuffer(b"".join(v for v, s in zip(vectors, small, strict=True) if s), dtype=np.float32).reshape(-1, size)
    out[~small] = np.frombuffer(b"".join(v for v, s in zip(vectors, small, strict=True) if not s)).reshape(-1, size)
    return out


def indexed(frames: Iterator[pd.DataFrame], layout) -> Iterator[pd.DataFrame]:
    """Each vector once for each table, in the shard of its bucket."""
    at = layout.value
    for frame in frames:
        if len(frame):
            x = matrix(frame["vector"].tolist())
            vectors = narrow(x)
            for table, bucket in enumerate(at.tables.buckets(x)):
                place = at.place(table, bucket)
                part = (frame["vec_id"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % at.parts[place]
                yield pd.DataFrame({"shard": at.first[place] + part, "query": False, "id": frame["vec_id"], "vector": vectors, "buckets": [p.tobytes() for p in at.within(place)]})


def probed(frames: Iterator[pd.DataFrame], layout, enough: int) -> Iterator[pd.DataFrame]:
    """Each query once for each shard that it visits, with the buckets it visits there; in each table they hold `enough` vectors if there are so many."""
    at, most = layout.value, 1024
    for frame in frames:
        for i in range(0, len(frame), 128):
            part = frame.iloc[i : i + 128]
            x = matrix(part["vector"].tolist())
            vectors, ids, rows = narrow(x), part["vec_id"].to_numpy(), []
            for table, log_p in enumerate(at.tables.slot_success(x)):
                tried = [(k, *of) for who, buckets, n in at.tables.probes_of_each(log_p, most) for k, *of in zip(who, buckets, n, strict=True)]
                most *= 4 if 2 * sum(len(buckets) > most for _, buckets, _ in tried) > len(tried) else 1  # where to begin next time
                for k, buckets, n in tried:
                    vec_id, place = ids[k], at.place(table, buckets)
                    held = np.cumsum(np.where(place >= 0, at.count[place], 0))
                    place = place[: max(n, np.searchsorted(held, enough) + 1)]
                    if held[-1] < enough:  # few generated buckets are in use: visit all there are
                        place = np.arange(*np.searchsorted(at.table, [table, table + 1]))
                    chosen = np.sort(place[place >= 0])
                    heads = np.flatnonzero(np.diff(at.first[chosen], prepend=-1))
                    for a, b in zip(heads, [*heads[1:], len(chosen)], strict=True):
                        packed = at.within(chosen[a:b]).tobytes()
                        rows += [(int(at.first[chosen[a]]) + p, True, vec_id, vectors[k], packed) for p in range(int(at.parts[chosen[a:b]].max()))]
            yield pd.DataFrame(rows, columns=["shard", "query", "id", "vector", "buckets"])


def floor_of(scores: np.ndarray, k: int) -> np.ndarray:
    """Of each row a score that k of its columns reach, hardly below the k-th: columns are dealt to groups, and the k-th of the groups' best is taken."""
    groups = min(scores.shape[1], 16 * k)
    deep = scores.shape[1] // groups
    best = scores[:, : groups * deep].reshape(len(scores), deep, groups).max(axis=1)
    return np.partition(best, groups - k, axis=1)[:, groups - k]


def ranked(ids: np.ndarray, x: np.ndarray, bucket: np.ndarray, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest of a shard's vec_ids for each query, each by its best row among the buckets that the query visits."""
    q, query_ids = widened(queries["vector"].tolist(), x.shape[1]), queries["id"].to_numpy()
    rough, small = x.astype(np.float32), q.astype(np.float32)
    scores = np.full((len(q), len(x)), -np.inf, dtype=np.float32)
    visits = [np.frombuffer(b, dtype="<u2") for b in queries["buckets"]]
    who, what = np.repeat(np.arange(len(q)), [len(v) for v in visits]), np.concatenate(visits).astype(np.int64)
    order = np.argsort(what, kind="stable")
    who, what = who[order], what[order]
    heads = np.flatnonzero(np.diff(what, prepend=-1))
    starts, stops = np.searchsorted(bucket, what[heads]), np.searchsorted(bucket, what[heads], side="right")
    for a, b, start, stop in zip(heads, [*heads[1:], len(what)], starts, stops, strict=True):
        if stop > start:
            scores[who[a:b], start:stop] = small[who[a:b]] @ rough[start:stop].T
    one, which = np.unique(ids, return_inverse=True)
    own = np.minimum(np.searchsorted(one, query_ids), len(one) - 1)
    for i in np.flatnonzero(one[own] == query_ids):
        scores[i, which == own[i]] = -np.inf
    best = scores
    if len(one) < len(ids):
        by_id = np.argsort(which, kind="stable")
        best = np.maximum.reduceat(scores[:, by_id], np.flatnonzero(np.diff(which[by_id], prepend=-1)), axis=1)
    edge = floor_of(best, min(k, len(one)))
    slack = 2e-7 * (len(x[0]) + 2) * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()  # more than a product in single precision can be off
    row, column = divmod(np.flatnonzero(scores >= np.maximum(edge - slack, np.finfo(np.float32).min).astype(np.float32)[:, None]), len(x))  # -inf: not visited
    exact = (q[row] * x[column]).sum(axis=1)  # summed alike for every pair, so equal vectors tie
    order = np.lexsort((-exact, which[column], row))
    pair = row[order] * len(one) + which[column[order]]
    order = order[np.diff(pair, prepend=-1) != 0]  # the best row of each vec_id
    order = order[np.lexsort((ids[column[order]], -exact[order], row[order]))]
    row, column, exact = row[order], column[order], exact[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    kept = rank < k
    return pd.DataFrame({"query_id": query_ids[row[kept]], "vec_id": ids[column[kept]], "score": exact[kept]})


def merged(found: list[pd.DataFrame], k: int) -> pd.DataFrame:
    """The k nearest of each query among what several shards gave."""
    rows = pd.concat(found)
    query, vec_id, score = (rows[c].to_numpy() for c in ("query_id", "vec_id", "score"))
    order = np.lexsort((-score, vec_id, query))
    query, vec_id, score = query[order], vec_id[order], score[order]
    best = np.ones(len(order), dtype=bool)
    best[1:] = (query[1:] != query[:-1]) | (vec_id[1:] != vec_id[:-1])
    query, vec_id, score = query[best], vec_id[best], score[best]
    order = np.lexsort((vec_id, -score, query))
    query, vec_id, score = query[order], vec_id[order], score[order]
    kept = np.arange(len(query)) - np.searchsorted(query, query) < k
    return pd.DataFrame({"query_id": query[kept], "vec_id": vec_id[kept], "score": score[kept]})


def searched(frames: Iterator[pd.DataFrame], k: int, size: int, most: int = FOUND_ROWS) -> Iterator[pd.DataFrame]:
    """From a stream sorted by shard, vectors before queries; what shards of one task give is merged while it is no more than `most` rows."""
    held, shard, ready, found, n = [], None, None, [], 0
    for frame in frames:
        for one, rows in frame.groupby("shard", sort=False):
            if one != shard:
                held, shard, ready = [], one, None
            vectors = rows[~rows["query"]]
            if len(vectors):
                held.append(vectors)
            queries = rows[rows["query"]]
            if len(queries) and held:
                if ready is None:
                    all_ = pd.concat(held)
                    bucket = np.frombuffer(b"".join(all_["buckets"]), dtype="<u2")
                    order = np.argsort(bucket, kind="stable")
                    ready, held = (all_["id"].to_numpy()[order], widened(all_["vector"].tolist(), size)[order], bucket[order]), held[:1]
                for i in range(0, len(queries), 1024):
                    found.append(ranked(*ready, queries.iloc[i : i + 1024], k))
                    n += len(found[-1])
                if n > most:
                    found = [merged(found, k)]
                    if (n := len(found[0])) > most / 2:
                        yield found.pop()
                        n = 0
    if found:
        yield merged(found, k)


def nearest(rows: DataFrame, scratch: Scratch, k: int = 20, every: int = 20, index: Index = Index()) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: up to k nearest rows for each row whose vec_id is divisible by `every`.

    rows: vec_id, embedding. Nearness is the inner product in double precision,
    ties go to the smaller vec_id. Vectors that are null, zero or hold null or
    non-finite components take no part, nor do rows without a vec_id or of another
    length than most. Rows repeated under one vec_id are one candidate, with
    the best of its scores, and a row is no candidate for its own vec_id. An empty table gives no
    rows; other columns are ignored.

    A query visits buckets that hold at least twice k rows in each table, if there are so many, so fewer
    than k are found only where most of those rows share their vec_ids with others.
    """
    spark = rows.sparkSession
    # Equal rows score alike, so one of them will do.
    vectors = scratch.keep(clean(rows, "vec_id").groupBy("vec_id", "vector").agg(F.count("*").alias("copies")), "vectors")
    length = F.octet_length("vector")
    most = vectors.groupBy(length.alias("bytes")).agg(F.sum("copies").alias("rows")).orderBy(F.desc("rows"), "bytes").first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if most is None:
        return spark.createDataFrame([], schema)
    vectors = vectors.where(length == most["bytes"]).select("vec_id", "vector")
    norms = vectors.mapInPandas(lambda frames: (pd.DataFrame({"norm": np.linalg.norm(matrix(f["vector"].tolist()), axis=1)}) for f in frames if len(f)), "norm double")
    top = norms.agg(F.max("norm")).first()[0]
    sample = matrix([bytes(r["vector"]) for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(index.fit_rows).collect()])  # at most fit_rows
    tables = Tables(index, sample, vectors.count(), top, k)

    def counted(frames):
        for frame in frames:
            if len(frame):
                for table, bucket in enumerate(tables.buckets(matrix(frame["vector"].tolist()))):
                    found, n = np.unique(bucket, return_counts=True)
                    yield pd.DataFrame({"table": table, "bucket": found, "n": n})

    sizes = vectors.mapInPandas(counted, "table int, bucket bigint, n bigint").groupBy("table", "bucket").agg(F.sum("n").alias("n")).orderBy("table", "bucket").toPandas()  # at most tables * SLOTS**MOST_PROJECTIONS
    table, bucket, count = (sizes[c].to_numpy() for c in ("table", "bucket", "n"))
    layout = spark.sparkContext.broadcast(Layout(tables, table, bucket, count, *laid_out(table, bucket, count, index.shard_rows)))
    all_rows = vectors.mapInPandas(partial(indexed, layout=layout), ROWS)
    queries = vectors.where(F.pmod("vec_id", F.lit(every)) == 0).repartition(parallelism(spark)).mapInPandas(partial(probed, layout=layout, enough=2 * k), ROWS)
    stream = all_rows.union(queries).repartition("shard").sortWithinPartitions("shard", "query")
    found = stream.mapInPandas(partial(searched, k=k, size=most["bytes"] // 8), "query_id bigint, vec_id bigint, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
