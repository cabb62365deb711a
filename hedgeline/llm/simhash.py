"""SimHash near-dedup: fingerprints that differ in a few bits, found by vantage-point trees.

Two 64-bit fingerprints at most r bits apart are at most r // 3 apart in one of
three blocks of bits. Hamming distance over a block is a metric of its own, and
its balls are small against the spread of distances, while on all 64 bits
nearly every ball of radius r would cross every boundary. So there is one
vantage-point tree for each block. A node splits fingerprints at the middle
distance from its vantage point. A fingerprint lives in the one leaf that it
falls into, and by the triangle bound it visits every other leaf that its ball
reaches. Leaves are the shards: residents are compared with visitors over all
64 bits, exactly, tile by tile, and a shard gives a spanning forest of the
links it found. Equal fingerprints are merged first.

The trees are made on the driver from a bounded sample of fingerprints; how
well it stands for the rest decides how even the shards are, not which links
are found. A shard with more than RESIDENTS or VISITORS (many near copies) is dealt out
as a grid of parts of that size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_rows, text_of
from .components import components, forest

WORDS, RADIUS, SEED = 4, 4, 42
BLOCKS = tuple(np.uint64(sum(1 << i for i in range(start, stop))) for start, stop in ((0, 22), (22, 43), (43, 64)))
#: Fingerprints in the sample that trees are made from; 8 bytes each.
SAMPLE = 65_536
#: Fingerprints that a leaf is meant to hold, the most levels, and the residents and visitors of a part of a shard.
LEAF, LEVELS, RESIDENTS, VISITORS = 2_000, 14, 8_192, 65_536


def fingerprint(text: str, words: int = WORDS) -> int:
    """The bits set in over half of the shingles' XXH64, as an unsigned number.

    A-Z are lower-cased; words lie between ASCII white space. Fewer words than a
    shingle has are one shingle; no words give 0. Repeated shingles count as often as they stand there.
    """
    import xxhash

    found = text.encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = [0, *ends[:-1].tolist()]
    last = (ends[min(words, len(found)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, last, strict=False)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprinted(frames: Iterator[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        bits = np.array([fingerprint(text, words) for text in frame["text"]], dtype=np.uint64)
        yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "bits": bits.view(np.int64)})


class Tree:
    """A vantage-point tree over one block: node i has the children 2i+1 (near) and 2i+2 (far)."""

    def __init__(self, sample: np.ndarray, block: np.uint64, levels: int, rng: np.random.Generator):
        self.block, self.levels = block, levels
        inner = (1 << levels) - 1
        self.vantage, self.middle = np.zeros(inner, dtype=np.uint64), np.zeros(inner, dtype=np.int64)
        parts = {0: sample & block}
        for node in range(inner):
            part = parts.pop(node)
            if len(part):
                tried = rng.choice(part, min(len(part), 8))
                distances = np.bitwise_count(tried[:, None] ^ part[None, :]).astype(np.int64)
                middles = np.median(distances, axis=1).astype(np.int64)
                even = np.abs((distances <= middles[:, None]).mean(axis=1) - 0.5)
                best = int(even.argmin())
                self.vantage[node], self.middle[node] = tried[best], middles[best]
                near = distances[best] <= middles[best]
                parts[2 * node + 1], parts[2 * node + 2] = part[near], part[~near]
            else:
                parts[2 * node + 1] = parts[2 * node + 2] = part

    def leaves(self, bits: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each leaf that a ball reaches: the place in bits, the leaf, and whether the fingerprint itself lives there."""
        who, node, home = np.arange(len(bits)), np.zeros(len(bits), dtype=np.int64), np.ones(len(bits), dtype=bool)
        for _ in range(self.levels):
            distance = np.bitwise_count((bits[who] ^ self.vantage[node]) & self.block).astype(np.int64)
            middle = self.middle[node]
            near, far = distance - radius <= middle, distance + radius > middle
            home_near, home_far = home & (distance <= middle), home & (distance > middle)
            who = np.concatenate([who[near], who[far]])
            node = np.concatenate([2 * node[near] + 1, 2 * node[far] + 2])
            home = np.concatenate([home_near[near], home_far[far]])
        return who, node - ((1 << self.levels) - 1), home


def plant(sample: np.ndarray, levels: int) -> list[Tree]:
    rng = np.random.default_rng(SEED)
    return [Tree(sample, block, levels, rng) for block in BLOCKS]


def routed(frames: Iterator[pd.DataFrame], trees, radius: int) -> Iterator[pd.DataFrame]:
    """shard, bits, home for each fingerprint and leaf."""
    for frame in frames:
        bits = frame["bits"].to_numpy().view(np.uint64)
        for i in range(0, len(bits), 2048):
            part = bits[i : i + 2048]
            for k, tree in enumerate(trees.value):
                who, leaf, home = tree.leaves(part, radius // len(BLOCKS))
                yield pd.DataFrame({"shard": leaf << 2 | k, "bits": part[who].view(np.int64), "home": home})


def dealt(frames: Iterator[pd.DataFrame], parts) -> Iterator[pd.DataFrame]:
    """Deal the rows of large shards out over a grid: residents to one row of it, visitors to one column."""
    shards, across, down = parts.value
    for frame in frames:
        shard, bits, home = (frame[c].to_numpy() for c in ("shard", "bits", "home"))
        if not len(shards):
            yield frame.assign(part=0)
            continue
        place = np.minimum(np.searchsorted(shards, shard), len(shards) - 1)
        large = shards[place] == shard
        high, wide = np.where(large, across[place], 1), np.where(large, down[place], 1)
        spread = (bits.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
        for own in (True, False):  # every row is a visitor; a resident also lives in each column of its row
            rows = np.flatnonzero(home if own else large | ~home)
            times = wide[rows] if own else high[rows]
            again = np.repeat(rows, times)
            k = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
            part = spread[again] % high[again] * wide[again] + k if own else k * wide[again] + spread[again] % wide[again]
            yield pd.DataFrame({"shard": shard[again], "bits": bits[again], "home": own, "part": part})


def linked(shard: pd.DataFrame, radius: int) -> pd.DataFrame:
    """A spanning forest of the links between residents and visitors (who include the residents)."""
    bits = shard["bits"].to_numpy().view(np.uint64)
    residents, visitors = np.unique(bits[shard["home"].to_numpy()]), np.unique(bits)
    a, b = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.uint64)]
    for i in range(0, len(residents), 64):
        tile = residents[i : i + 64]
        after = visitors[np.searchsorted(visitors, tile[0]) :] if len(residents) == len(visitors) else visitors
        near = np.bitwise_count(tile[:, None] ^ after[None, :]) <= radius
        x, y = np.nonzero(near)
        apart = tile[x] != after[y]
        if apart.any():
            u, v = forest(tile[x[apart]], after[y[apart]])
            a.append(u)
            b.append(v)
    u, v = forest(np.concatenate(a), np.concatenate(b))
    return pd.DataFrame({"a": u.view(np.int64), "b": v.view(np.int64)})


def links_between(bits: DataFrame, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """a, b: links that join the same distinct fingerprints (column bits, long) as all pairs at most radius bits apart."""
    spark, n = bits.sparkSession, bits.count()
    sample = bits.orderBy(F.xxhash64("bits")).limit(SAMPLE).toPandas()["bits"].to_numpy().view(np.uint64)  # at most SAMPLE
    levels = int(np.clip(np.ceil(np.log2(max(1, n / LEAF))), 0, LEVELS))
    trees = spark.sparkContext.broadcast(plant(sample, levels))  # 3 trees of at most 2**LEVELS nodes
    rows = scratch.keep(map_rows(bits, partial(routed, trees=trees, radius=radius), "shard bigint, bits bigint, home boolean"), "shards")
    sizes = rows.groupBy("shard").agg(F.count_if("home").alias("own"), F.count("*").alias("all")).where((F.col("own") > RESIDENTS) | (F.col("all") > VISITORS)).orderBy("shard").toPandas()  # at most 3 * 2**LEVELS leaves
    split = [sizes["shard"].to_numpy(), *(np.maximum(1, -(-sizes[c].to_numpy() // most)) for c, most in (("own", RESIDENTS), ("all", VISITORS)))]
    grid = spark.sparkContext.broadcast(split)
    parts = map_rows(rows, partial(dealt, parts=grid), "shard bigint, bits bigint, home boolean, part bigint")
    return parts.groupBy("shard", "part").applyInPandas(partial(linked, radius=radius), "a bigint, b bigint")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    return text_of(docs).mapInPandas(partial(fingerprinted, words=words), "doc_id bigint, bits bigint")


def near_duplicates(docs: DataFrame, scratch: Scratch, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """Per row of docs: doc_id, bits (the fingerprint as a long) and component_id, the smallest doc_id reachable by links.

    A null or empty text, or one of white space, has the fingerprint 0, which
    links like any other. Rows repeated under one doc_id each give a row. A row
    without a doc_id links like any other and gets the component's smallest
    doc_id, null if none has one. An empty table gives no rows; other columns are ignored.
    """
    prints = scratch.keep(fingerprints(docs, words), "prints")
    first = prints.groupBy("bits").agg(F.min("doc_id").alias("first"))
    distinct = scratch.keep(first, "distinct")
    found = components(links_between(distinct.select("bits"), scratch, radius), scratch)
    member = distinct.join(found, F.col("bits") == F.col("node"), "left").select("bits", "first", F.coalesce("component", "bits").alias("component"))
    smallest = member.groupBy("component").agg(F.min("first").alias("component_id"))
    reached = member.join(smallest, "component").select("bits", "component_id")
    return prints.join(reached, "bits").select("doc_id", "bits", "component_id")
