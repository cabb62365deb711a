"""Embedding near-dedup by dual traversal of cover trees, exact at a cosine threshold.

Unit vectors have a cosine of at least c where they are at most `bound` =
sqrt(2 - 2c) apart. The top level of the tree is a set of pivots for each
label, centres of a net over a bounded sample, those with the most vectors
around them first. A vector belongs to its nearest pivot, there either to the
core, the ball of half the bound, or to the rest, the cell outside of it. The
covering radius of each cell is measured over all its vectors.

Cells meet by the triangle bounds. All vectors of a core link with each other.
A vector that is further from a cell's centre than the cell's covering radius
and the bound has no link there and isn't sent; one so near that the radius
keeps all within the bound links with all, which a count says. Only others visit the cell.

There, residents and visitors each have a cover tree: a node's children are
centres over half its covering radius apart, and every vector is within that
half of its child. Levels go on until a node holds one vector (or vectors
equal but for rounding). The trees are walked together: a pair of
nodes is dropped if the covering radii show that no pair below is close
enough, taken whole if they show that all are, and split otherwise. Children of one
node whose distances to its centre differ too much aren't even looked at.

Vectors that are equal but for their length are merged first, with a count. A
cell over CELL_ROWS vectors is dealt out in parts, and its visitors too. A
pair of parts gives counts of links and a spanning forest of them, never the
links themselves, so a group of n near copies gives n rows and not n squared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import components, forest
from .vectors import clean, matrix, units, usable

THRESHOLD = 0.93
#: Vectors in the sample that pivots come from, vectors a pivot is meant for, sampled vectors that make a core worth a pivot, and the most vectors that a part of a cell and of its visitors has.
PIVOT_SAMPLE, PIVOT_ROWS, DENSE, CELL_ROWS, VISITORS = 8_192, 1_500, 3, 2_048, 4_096
#: Covering radius of a node that isn't split, rows of a matrix of distances made at once, and how far a bound must be exceeded (distances are exact to about 1e-8).
LEAST, BLOCK, SLACK = 1e-6, 256, 1e-7
KEY = ["label", "size", "cell"]


def _apart(products: np.ndarray) -> np.ndarray:
    """Distances of unit vectors from their products."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * products))


def net(x: np.ndarray, radius: float) -> np.ndarray:
    """The number of the ball that takes each row: balls are around the first row that no ball before has taken."""
    ball, least, k = np.full(len(x), -1), 1 - radius * radius / 2, 0
    left, at, free = np.arange(len(x)), 0, np.ones(len(x), dtype=bool)
    while True:
        while at < len(left) and not free[at]:
            at += 1
        if at == len(left):
            return ball
        near = free & (x @ x[at] >= least)
        near[at] = True
        ball[left[near]] = k
        k, free = k + 1, free & ~near
        if len(left) > 256 and 2 * np.count_nonzero(free) < len(left):
            left, x, at, free = left[free], x[free], 0, np.ones(np.count_nonzero(free), dtype=bool)


class CoverTree:
    """Nodes in the order of their levels: each has the rows start..stop of `x`, the first of which is its centre, a covering radius, its centre's distance from its parent's, and the children first..last.

    order: the rows as given, in the order of x.
    """

    def __init__(self, x: np.ndarray):
        order, start, stop, radius, away, level = np.arange(len(x)), [0], [len(x)], [], [0.0], [0]
        first, last, at = [], [], 0
        while at < len(start):
            rows = order[start[at] : stop[at]]
            apart = _apart(x[rows] @ x[rows[0]])
            reach = float(apart.max()) if len(rows) > 1 else 0.0
            radius.append(reach)
            first.append(len(start))
            if reach > LEAST:
                ball = net(x[rows], reach / 2)
                by_ball = np.argsort(ball, kind="stable")
                order[start[at] : stop[at]] = rows[by_ball]
                heads = np.flatnonzero(np.diff(ball[by_ball], prepend=-1))
                start += (start[at] + heads).tolist()
                stop += (start[at] + np.append(heads[1:], len(rows))).tolist()
                away += apart[by_ball[heads]].tolist()
                level += [level[at] + 1] * len(heads)
            last.append(len(start))
            at += 1
        self.order, self.x = order, x[order]
        self.start, self.stop, self.first, self.last, self.level = (np.array(v) for v in (start, stop, first, last, level))
        self.radius, self.away = np.array(radius), np.array(away)

    def children(self, node: int) -> np.ndarray:
        """The node itself where it has none."""
        return np.arange(self.first[node], self.last[node]) if self.last[node] > self.first[node] else np.array([node])

    def centres(self, nodes: np.ndarray) -> np.ndarray:
        return self.x[self.start[nodes]]


class Walk:
    """A dual traversal of a and b, or of a with itself (b is None).

    of_a, of_b: links of each row, weighted by copies; u, v: a spanning forest
    of the links, rows of b after those of a. compared: products of two vectors made by the walk.
    """

    def __init__(self, a: CoverTree, b: CoverTree | None, weight_a: np.ndarray, weight_b: np.ndarray, threshold: float):
        self.same = b is None
        self.a, self.b = a, a if self.same else b
        self.threshold, self.bound, self.compared = threshold, float(np.sqrt(2 - 2 * threshold)), 0
        self.shift = 0 if self.same else len(a.x)
        self.sum_a, self.sum_b = (np.concatenate([[0], np.cumsum(w)]) for w in (weight_a, weight_b))
        self.of_a, self.of_b = np.zeros(len(self.a.x), dtype=np.int64), np.zeros(len(self.b.x), dtype=np.int64)
        self.more_a, self.more_b = np.zeros(len(self.a.x) + 1, dtype=np.int64), np.zeros(len(self.b.x) + 1, dtype=np.int64)
        self.tied_a, self.tied_b = np.zeros(len(self.a.start), dtype=bool), np.zeros(len(self.b.start), dtype=bool)
        self.left, self.right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        self.stack: list[tuple[int, int]] = []
        if self.same:
            self._within(0)
        else:
            self._between(np.array([0]), np.array([0]))
        while self.stack:
            p, q = self.stack.pop()
            if self.same and p == q:
                self._inside(p)
            else:
                self._split(p, q)
        self.of_a += np.cumsum(self.more_a[:-1])
        self.of_b += np.cumsum(self.more_b[:-1])
        for tree, tied, shift in ((self.a, self.tied_a, 0), (self.b, self.tied_b, self.shift)):
            for node in np.flatnonzero(tied & (tree.stop - tree.start > 1)):
                self._link(np.arange(tree.start[node] + 1, tree.stop[node]) + shift, np.full(tree.stop[node] - tree.start[node] - 1, tree.start[node] + shift))
        self.u, self.v = forest(np.concatenate(self.left), np.concatenate(self.right))

    def _link(self, u: np.ndarray, v: np.ndarray) -> None:
        self.left.append(u)
        self.right.append(v)

    def _within(self, node: int) -> None:
        """A node with itself: all its rows link if two radii are within the bound."""
        a = self.a
        if 2 * a.radius[node] < self.bound - SLACK:
            rows = slice(a.start[node], a.stop[node])
            self.of_a[rows] += self.sum_a[a.stop[node]] - self.sum_a[a.start[node]] - np.diff(self.sum_a)[rows]
            self.tied_a[node] = True
        else:
            self.stack.append((node, node))

    def _inside(self, node: int) -> None:
        """All pairs of a node's children, of which those whose distances to its centre differ too much are passed over."""
        nodes = self.a.children(node)
        nodes = nodes[np.argsort(self.a.away[nodes], kind="stable")]
        away, wide = self.a.away[nodes], self.a.radius[nodes].max()
        for child in nodes:
            self._within(int(child))
        for i in range(0, len(nodes), BLOCK):
            rows = nodes[i : i + BLOCK]
            reach = away[min(i + BLOCK, len(nodes)) - 1] + self.a.radius[rows].max() + wide + self.bound + SLACK
            columns = nodes[i : np.searchsorted(away, reach, side="right")]
            self._between(rows, columns, np.arange(len(columns)) > np.arange(len(rows))[:, None])

    def _split(self, p: int, q: int) -> None:
        """The children of one node with those of another, without children that are too far from the other's centre."""
        rows, columns = self.a.children(p), self.b.children(q)
        if len(rows) == len(columns) == 1:  # two nodes of many vectors that are equal but for rounding
            x, y = slice(self.a.start[p], self.a.stop[p]), slice(self.b.start[q], self.b.stop[q])
            near = self.a.x[x] @ self.b.x[y].T >= self.threshold
            self.compared += near.size
            self.of_a[x] += near @ np.diff(self.sum_b)[y]
            self.of_b[y] += near.T @ np.diff(self.sum_a)[x]
            i, j = np.nonzero(near)
            self._link(*forest(i + self.a.start[p], j + self.b.start[q] + self.shift))
            return
        if len(columns) > 1 and len(rows) > 1:
            self.compared += len(rows) + len(columns)
            to_q = _apart(self.a.centres(rows) @ self.b.x[self.b.start[q]])
            to_p = _apart(self.b.centres(columns) @ self.a.x[self.a.start[p]])
            rows = rows[to_q <= self.a.radius[rows] + self.b.radius[q] + self.bound + SLACK]
            columns = columns[to_p <= self.b.radius[columns] + self.a.radius[p] + self.bound + SLACK]
        for i in range(0, len(rows), BLOCK):
            self._between(rows[i : i + BLOCK], columns)

    def _between(self, rows: np.ndarray, columns: np.ndarray, which: np.ndarray | bool = True) -> None:
        """Nodes of a with nodes of b: dropped, taken whole or left to be split."""
        if not len(rows) or not len(columns):
            return
        products = self.a.centres(rows) @ self.b.centres(columns).T
        self.compared += products.size if which is True else int(np.count_nonzero(which))
        apart, reach = _apart(products), self.a.radius[rows][:, None] + self.b.radius[columns]
        single = (self.a.stop[rows] - self.a.start[rows] == 1)[:, None] & (self.b.stop[columns] - self.b.start[columns] == 1)
        whole = np.where(single, products >= self.threshold, apart + reach < self.bound - SLACK) & which
        open_ = ~single & ~whole & (apart <= reach + self.bound + SLACK) & which
        if whole.any():
            for tree, nodes, hits, weight, more, tied in (
                (self.a, rows, whole, (self.sum_b[self.b.stop[columns]] - self.sum_b[self.b.start[columns]]), self.more_a, self.tied_a),
                (self.b, columns, whole.T, (self.sum_a[self.a.stop[rows]] - self.sum_a[self.a.start[rows]]), self.more_b, self.tied_b),
            ):
                n = hits @ weight
                more[tree.start[nodes]] += n
                more[tree.stop[nodes]] -= n
                tied[nodes[hits.any(axis=1)]] = True
            i, j = np.nonzero(whole)
            self._link(*forest(self.a.start[rows[i]], self.b.start[columns[j]] + self.shift))
        self.stack += [(int(rows[i]), int(columns[j])) for i, j in zip(*np.nonzero(open_), strict=True)]


def matched(pair: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Counts (b null) and links (n null) of a pair of parts: rows with side 0 and, unless the part is paired with itself, side 1."""
    same = bool(pair["same"].iloc[0])
    first, second = pair[pair["side"] == 0], pair[pair["side"] == 1]
    if not len(first) or not (same or len(second)):
        return pd.DataFrame({"a": [], "b": [], "n": []})
    a = CoverTree(matrix(first["vector"].tolist()))
    ids_a, weight_a = first["id"].to_numpy()[a.order], first["copies"].to_numpy()[a.order]
    if same:
        walk, nodes = Walk(a, None, weight_a, weight_a, threshold), ids_a
        counts = pd.DataFrame({"a": ids_a, "n": walk.of_a + walk.of_b})
    else:
        b = CoverTree(matrix(second["vector"].tolist()))
        ids_b, weight_b = second["id"].to_numpy()[b.order], second["copies"].to_numpy()[b.order]
        walk, nodes = Walk(a, b, weight_a, weight_b, threshold), np.concatenate([ids_a, ids_b])
        counts = pd.DataFrame({"a": nodes, "n": np.concatenate([walk.of_a, walk.of_b])})
    links = pd.DataFrame({"a": nodes[walk.u], "b": nodes[walk.v]})
    return pd.concat([counts[counts["n"] > 0], links]).reindex(columns=["a", "b", "n"]).astype("Int64")


def by_shape(frame: pd.DataFrame) -> Iterator[tuple[tuple[int, int], pd.DataFrame]]:
    """Rows of one label and one length of vector at a time."""
    for (label, size), rows in frame.groupby(["label", frame["vector"].str.len() // 8], sort=False):
        yield (int(label), int(size)), rows


def placed(frames: Iterator[pd.DataFrame], pivots, core: float) -> Iterator[pd.DataFrame]:
    """Unit vectors with their cell (twice the nearest pivot of the label, one more outside of its core) and the distance to the pivot."""
    for frame in frames:
        for (label, size), rows in by_shape(frame):
            x = units(rows["vector"].tolist())
            cell, away = np.full(len(x), -1), np.full(len(x), 2.0)
            if (centres := pivots.value.get((label, size))) is not None:
                products = x @ centres.T
                nearest = products.argmax(axis=1)
                away = _apart(products[np.arange(len(x)), nearest])
                cell = 2 * nearest + (away > core)
            yield pd.DataFrame({"vec_id": rows["vec_id"].to_numpy(), "label": label, "size": size, "vector": [v.tobytes() for v in x], "cell": cell, "away": away})


def pivots_of(sample: list[tuple[tuple[int, int], bytes]], counts: dict[tuple[int, int], int], core: float) -> dict[tuple[int, int], np.ndarray]:
    """For each label and length the centres of a net over its part of the sample: all that take DENSE of it or more, and one for PIVOT_ROWS vectors."""
    of_key: dict[tuple[int, int], list[bytes]] = {}
    for key, vector in sample:
        of_key.setdefault(key, []).append(vector)
    found = {}
    for key, vectors in of_key.items():
        x = units(vectors)
        ball, first, mass = np.unique(net(x, core), return_index=True, return_counts=True)
        order = np.lexsort((ball, -mass))
        n = max(np.count_nonzero(mass >= DENSE), -(-counts.get(key, 0) // PIVOT_ROWS), 1)
        found[key] = x[first[order[:n]]]
    return found


@dataclass
class Cells:
    """The cells of one label and length, those outside of cores first, with centre, covering radius, rows with copies, and smallest id."""

    cell: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    total: np.ndarray
    first: np.ndarray

    def reached(self, x: np.ndarray, cell: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """Which later cells each vector has to visit, and which are so near that it links with all of them."""
        place = np.argsort(self.cell)[np.searchsorted(np.sort(self.cell), cell)]
        apart = _apart(x @ self.centre.T)
        later = np.arange(len(self.cell)) > place[:, None]
        whole = later & (apart + self.radius < bound - SLACK)
        return later & ~whole & (apart <= self.radius + bound + SLACK), whole


def _of_label(frames: Iterator[pd.DataFrame], cells, bound: float) -> Iterator[tuple[tuple[int, int], Cells, pd.DataFrame, np.ndarray, np.ndarray]]:
    for frame in frames:
        for key, rows in by_shape(frame):
            if (known := cells.value.get(key)) is not None:
                for i in range(0, len(rows), BLOCK):
                    some = rows.iloc[i : i + BLOCK]
                    yield key, known, some, *known.reached(matrix(some["vector"].tolist()), some["cell"].to_numpy(), bound)


def survey(frames: Iterator[pd.DataFrame], cells, bound: float) -> Iterator[pd.DataFrame]:
    """For each cell how many visit it and how many rows link with all of it (id null); for each vector and cell that it links with as a whole, the count and a link."""
    for (label, size), known, some, visits, whole in _of_label(frames, cells, bound):
        copies = some["copies"].to_numpy()
        hit = np.flatnonzero(visits.any(axis=0) | whole.any(axis=0))
        yield pd.DataFrame({"label": label, "size": size, "cell": known.cell[hit], "visitors": visits.sum(axis=0)[hit], "copies": (copies @ whole)[hit], "a": pd.array([None] * len(hit), dtype="Int64"), "b": 0, "n": 0})
        row, at = np.nonzero(whole)
        yield pd.DataFrame({"label": label, "size": size, "cell": known.cell[at], "visitors": 0, "copies": 0, "a": pd.array(some["id"].to_numpy()[row], dtype="Int64"), "b": known.first[at], "n": known.total[at]})


def visiting(frames: Iterator[pd.DataFrame], cells, bound: float) -> Iterator[pd.DataFrame]:
    """Each vector once for each cell that it visits."""
    for (label, size), known, some, visits, _ in _of_label(frames, cells, bound):
        row, at = np.nonzero(visits)
        for i in range(0, len(row), 4096):
            rows = some.iloc[row[i : i + 4096]]
            yield pd.DataFrame({"label": label, "size": size, "cell": known.cell[at[i : i + 4096]], "id": rows["id"].to_numpy(), "copies": rows["copies"].to_numpy(), "vector": rows["vector"].to_numpy()})


def _known_cells(rows: list, pivots: dict) -> dict[tuple[int, int], Cells]:
    of_key: dict[tuple[int, int], list] = {}
    for r in rows:
        of_key.setdefault((r["label"], r["size"]), []).append((r["cell"] % 2 == 0, r["cell"], r["radius"], r["total"], r["first"]))
    out = {}
    for key, found in of_key.items():
        found.sort()
        _, cell, radius, total, first = (np.array(v) for v in zip(*found, strict=True))
        out[key] = Cells(cell, pivots[key][cell // 2], radius, total, first)
    return out


def near_duplicates(rows: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: vec_id, n_links, component_id and kept.

    rows: vec_id, embedding, label. Two rows link if their labels are equal and
    not null and their vectors have the same length and a cosine of at least
    threshold in double precision. Vectors that are null, zero or hold null or non-finite components
    link with nothing: n_links is 0 and the component is the vector itself.
    Rows repeated under one vec_id are vectors of their own that link with each
    other and each give a row. Rows without a vec_id link with nothing and have
    no component. An empty table gives no rows; other columns are ignored.

    To the driver go the sample, its labels' counts and the cells around its
    vectors (two each at most); the pivots and those cells are broadcast.
    """
    spark = rows.sparkSession
    bound = float(np.sqrt(2 - 2 * threshold))
    core = bound / 2 - SLACK
    vectors = scratch.keep(clean(rows, "vec_id", "label"), "vectors")
    size = (F.octet_length("vector") / 8).cast("int").alias("size")
    sample = [((r["label"], r["size"]), bytes(r["vector"])) for r in vectors.select("*", size).orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).collect()]  # at most PIVOT_SAMPLE
    labels = spark.createDataFrame(sorted({key for key, _ in sample}), "label bigint, size int")
    counts = vectors.select("label", size).join(F.broadcast(labels), ["label", "size"]).groupBy("label", "size").count()
    pivots = pivots_of(sample, {(r["label"], r["size"]): r["count"] for r in counts.collect()}, core)  # at most PIVOT_SAMPLE
    known_pivots = spark.sparkContext.broadcast(pivots)
    at = vectors.mapInPandas(partial(placed, pivots=known_pivots, core=core), "vec_id bigint, label bigint, size int, vector binary, cell int, away double")
    at = scratch.keep(at, "placed")
    scratch.drop("vectors")

    merged = scratch.keep(at.groupBy(*KEY, "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.max("away").alias("away")), "merged")
    cells = merged.groupBy(*KEY).agg(F.count("*").alias("n"), F.sum("copies").alias("total"), F.max("away").alias("radius"), F.min("id").alias("first"))
    cells = scratch.keep(cells.withColumn("solid", (F.col("cell") >= 0) & (F.col("cell") % 2 == 0)), "cells")
    known = spark.sparkContext.broadcast(_known_cells(cells.where("cell >= 0").collect(), pivots))  # two for each pivot at most
    surveyed = merged.where("cell >= 0").mapInPandas(partial(survey, cells=known, bound=bound), "label bigint, size int, cell int, visitors bigint, copies bigint, a bigint, b bigint, n bigint")
    surveyed = scratch.keep(surveyed, "surveyed")
    visited = surveyed.where("a IS NULL").groupBy(*KEY).agg(F.sum("visitors").alias("visitors"), F.sum("copies").alias("whole"))
    parts = lambda n, most: F.ceil(F.coalesce(n, F.lit(0)) / most).cast("int")
    cells = cells.join(visited, KEY, "left").select(*KEY, "total", "first", "solid", F.coalesce("whole", F.lit(0)).alias("whole"), parts(F.col("n"), CELL_ROWS).alias("parts"), parts(F.col("visitors"), VISITORS).alias("visits"))
    cells = scratch.keep(cells, "counted")

    part = lambda n: F.pmod(F.xxhash64("id"), n).cast("int").alias("part")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    seat = lambda guest, i, j, side, same: F.struct(F.lit(guest).alias("guest"), i.alias("i"), j.alias("j"), side.alias("side"), same.alias("same"))
    homes = merged.select(*KEY, "id", "copies", "vector").join(cells.select(*KEY, "solid", "parts", "visits"), KEY).withColumn("part", part(F.col("parts")))
    mine = F.col("part")
    own = F.when(F.col("solid"), F.lit(0)).otherwise(F.col("parts"))  # a core needs no look at its own pairs
    seats = F.concat(
        F.transform(upto(own), lambda k: seat(False, F.least(mine, k), F.greatest(mine, k), F.when(k < mine, 1).otherwise(0), k == mine)),
        F.transform(upto(F.col("visits")), lambda k: seat(True, mine, k, F.lit(0), F.lit(False))),
    )
    guests = merged.where("cell >= 0").mapInPandas(partial(visiting, cells=known, bound=bound), "label bigint, size int, cell int, id bigint, copies bigint, vector binary")
    guests = guests.join(cells.select(*KEY, "parts", "visits"), KEY).withColumn("part", part(F.col("visits")))
    guest_seats = F.transform(upto(F.col("parts")), lambda k: seat(True, k, mine, F.lit(1), F.lit(False)))
    dealt = [side.select(*KEY, F.explode(places).alias("seat"), "id", "copies", "vector").select(*KEY, "seat.*", "id", "copies", "vector") for side, places in ((homes, seats), (guests, guest_seats))]
    found = dealt[0].union(dealt[1]).groupBy(*KEY, "guest", "i", "j").applyInPandas(partial(matched, threshold=threshold), "a bigint, b bigint, n bigint")
    found = scratch.keep(found, "found")

    whole = surveyed.where("a IS NOT NULL")
    tied = merged.join(cells.where("solid OR whole > 0").select(*KEY, "first"), KEY).where(F.col("id") != F.col("first"))  # by each other or by what links with all
    links = found.where("b IS NOT NULL").select("a", "b").union(whole.select("a", "b")).union(tied.select(F.col("id").alias("a"), F.col("first").alias("b")))
    roots = components(links, scratch)
    counted = found.where("n IS NOT NULL").select("a", "n").union(whole.select("a", "n")).groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    classes = merged.select(*KEY, "vector", "id", "copies").join(cells.select(*KEY, "total", "solid", "whole"), KEY).join(counted, "id", "left").join(roots, F.col("id") == F.col("node"), "left")
    inner = F.when(F.col("solid"), F.col("total")).otherwise(F.col("copies")) - 1
    classes = classes.select(*KEY, "vector", (F.coalesce("n", F.lit(0)) + F.col("whole") + inner).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    members = at.join(classes, [*KEY, "vector"]).select("vec_id", "n_links", "component_id")
    # The others are found by the same rule, not by an anti-join, so that repeated vec_ids keep their rows.
    takes_part = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding").cast("array<double>"))
    alone = rows.where(~takes_part).select(F.col("vec_id").cast("bigint").alias("vec_id"))
    alone = alone.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return members.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
