"""Exact-substring dedup by bucket-pointer refinement of suffixes.

To know whether the 100 bytes from a place have stood earlier, suffixes have to
be sorted to a depth of 100 bytes only. They are put into buckets by their
first q bytes, and a bucket is refined by the buckets that its suffixes have at later
offsets. Across tasks a bucket's identifier is a hash of its bytes, so that
every task names the bucket at any offset of a text without asking others.

Not every suffix has to be sorted. Of the q-grams in any 100 bytes the one
with the smallest hash (the leftmost of equals) is picked, and only suffixes
at picked places, the anchors, are dealt out, about one in 35. Equal stretches
pick equal places, so a bucket with one anchor is done.

Refinement of the buckets with more:
1. By the identifier of the whole context that 100-byte strings around the
   anchor can reach. Of anchors with equal contexts all but the first are
   repeats with every string around them; the first stands for the class.
2. Classes of one bucket are split by the bucket of the suffix q bytes later,
   for strings that reach further right, or q bytes before, for those
   that reach further left. Each string belongs to one side and holds those bytes.
3. What is left together is refined suffix by suffix in one task. Numbers stand for the
   buckets at depth q. A pass sorts each open bucket by the numbers of the suffixes
   `depth so far` later, and its refined numbers are what the next pass sorts by: the
   depth goes from q to 2q, and from there to 100. Suffixes alone in a bucket drop out.

Step 3 compares bytes, so equal numbers are equal strings. The first
of equals stays, the others are repeats. Where steps meet equal identifiers without
bytes at hand, in step 1 and for single strings, two independent 64-bit ones have to agree.

A common passage gives buckets as large as the number of documents that hold
it. So anchors with equal contexts are merged in the task that reads them
before anything is shuffled; buckets are read as sorted streams of which only
one class is held; and a group of step 3 that is over GROUP_ROWS goes through
a further grouping by single strings, which Spark aggregates before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_rows, text_of, unused

#: Rows that a group of the last refinement may have before it is grouped by single strings.
GROUP_ROWS = 20_000
#: Rows that are compared at once, if no group is larger, and texts that are taken at once.
AT_ONCE, TEXTS = 4_000, 64
#: Anchors and bytes that a task holds before it merges equal contexts, and that it hashes at once.
HELD_ANCHORS, HELD_BYTES = 250_000, 1 << 18
#: Low bits of a key that hold a place, so that the leftmost of equal hashes is the least; no text has more bytes.
PLACE_BITS = np.uint64(31)
MARK, CLASS, SINGLE = 1, 2, 3


@dataclass(frozen=True)
class Depth:
    """length: of the strings looked for, in bytes; q: of the first buckets."""

    length: int = 100
    q: int = 32

    @property
    def reach(self) -> int:
        """How far before an anchor a string may begin."""
        return self.length - self.q

    @property
    def half(self) -> int:
        """Strings that begin at most so far before an anchor count as reaching right."""
        return self.reach // 2


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    steps = np.full((2, n), np.uint64(1))
    steps[0, 1:], steps[1, 1:] = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
    up, down = np.cumprod(steps, axis=1, dtype=np.uint64)
    return up, down


#: Base of the powers and value of each byte, for two independent identifiers.
_KINDS = tuple((base, _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(byte))) for base, byte in ((0x9E3779B97F4A7C15, 0xA0761D6478BD642F), (0xC2B2AE3D27D4EB4F, 0xE7037ED1A0B428DB)))


class Identifiers:
    """Names any stretch of a text by a hash of its bytes, from prefix sums."""

    def __init__(self, raw: np.ndarray, kind: int = 0):
        size, (base, byte) = 1 << max(18, int(len(raw)).bit_length()), _KINDS[kind]
        self.up, down = _powers(size, base)
        self.sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(byte[raw] * down[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[stop] - self.sums[start]) * self.up[start])

    def grams(self, q: int) -> np.ndarray:
        n = max(0, len(self.sums) - q)
        return _mixed((self.sums[q : q + n] - self.sums[:n]) * self.up[:n])


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of each stretch of the given width."""
    have = 1
    while 2 * have <= width:
        keys, have = np.minimum(keys[:-have], keys[have:]), 2 * have
    return np.minimum(keys[: len(keys) - (width - have)], keys[width - have :])


def anchors(texts: list[bytes], depth: Depth) -> tuple[np.ndarray, ...]:
    """For each anchor: its text's place in the list, its own place, where its context begins and ends, its bucket and its context's identifier."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    none = np.zeros(0, dtype=np.int64)
    if len(raw) < depth.length:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    ends = np.cumsum(lengths)
    ids = Identifiers(raw)
    grams = ids.grams(depth.q)
    low = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
    least = _least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), depth.reach + 1)
    owner = np.repeat(np.arange(len(texts)), lengths)[: len(least)]
    whole = np.arange(len(least)) + depth.length <= ends[owner]
    picked = (least[whole] & low).astype(np.int64)
    at = np.unique(picked[np.flatnonzero(np.diff(picked, prepend=-1))])
    owner = np.repeat(np.arange(len(texts)), lengths)[at]
    first = ends[owner] - lengths[owner]
    start, stop = np.maximum(first, at - depth.reach), np.minimum(ends[owner], at + depth.length)
    context = _mixed(Identifiers(raw, 1).of(start, stop) ^ ((at - start) * 1_000_003 + (stop - at)).astype(np.uint64))
    return owner, at - first, start - first, stop - first, grams[at], context


ANCHORS = "bucket bigint, context bigint, doc_id bigint, place int, start int, stop int, kind int"


def _merged(held: list[tuple]) -> pd.DataFrame:
    """Keep the first anchor of each context; the others are repeats already."""
    doc, place, start, stop, bucket, context = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((place, doc, context, bucket))
    doc, place, start, stop, bucket, context = (x[order] for x in (doc, place, start, stop, bucket, context))
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (context[1:] != context[:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
    same = (doc == doc[lead]) & (place == place[lead])
    repeat = ~new & ~same
    frame = pd.DataFrame({"bucket": bucket.view(np.int64), "context": context.view(np.int64), "doc_id": doc, "place": place.astype(np.int32), "start": start.astype(np.int32), "stop": stop.astype(np.int32), "kind": np.where(repeat, MARK, CLASS).astype(np.int32)})
    return pd.concat([frame[new], joined_spans(frame[repeat])])


def joined_spans(marks: pd.DataFrame) -> pd.DataFrame:
    """Join overlapping spans of a document."""
    marks = marks.sort_values(["doc_id", "start"], kind="stable")
    doc, start, stop = (marks[c].to_numpy() for c in ("doc_id", "start", "stop"))
    if not len(doc):
        return marks
    # Contexts are of bounded length, so that the end so far is the last one's unless a document begins.
    furthest = pd.Series(stop).groupby(doc, sort=False).cummax().to_numpy()
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > furthest[:-1])
    heads = np.flatnonzero(new)
    out = marks.iloc[heads].copy()
    out["stop"] = np.maximum.reduceat(stop, heads)
    return out


def read_anchors(frames: Iterator[pd.DataFrame], depth: Depth) -> Iterator[pd.DataFrame]:
    """The anchors of each text, with equal contexts merged."""
    held, count = [], 0
    for frame in frames:
        texts, ids, size = [], [], 0
        rows = list(zip(frame["doc_id"], frame["text"], strict=True))
        for k, (doc_id, text) in enumerate(rows):
            texts.append(text.encode())
            ids.append(doc_id)
            size += len(texts[-1])
            if size >= HELD_BYTES or k == len(rows) - 1:
                owner, *rest = anchors(texts, depth)
                held.append((np.array(ids, dtype=np.int64)[owner], *rest))
                count += len(owner)
                texts, ids, size = [], [], 0
            if count >= HELD_ANCHORS:
                yield _merged(held)
                held, count = [], 0
    if held:
        yield _merged(held)


def classes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From a stream sorted by bucket, context, document and place: repeats, and the classes of buckets that have several."""
    lead, several = None, False  # the first anchor of the last class, and whether its bucket has had another
    for frame in frames:
        marks = frame[frame["kind"] == MARK]
        frame = frame[frame["kind"] == CLASS]
        yield marks.drop(columns=["context"])
        if not len(frame):
            continue
        carried = lead is not None
        if carried:
            frame = pd.concat([lead, frame])
        bucket, context = frame["bucket"].to_numpy(), frame["context"].to_numpy()
        doc, place = frame["doc_id"].to_numpy(), frame["place"].to_numpy()
        turn = np.ones(len(frame), dtype=bool)
        turn[1:] = bucket[1:] != bucket[:-1]
        new = turn.copy()
        new[1:] |= context[1:] != context[:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(frame)), 0))
        number = np.cumsum(turn) - 1
        count = np.bincount(number, new)
        if carried and several:
            count[0] += 1
        kept = new & (count[number] > 1)
        if carried and several:
            kept[0] = False  # given out before
        repeat = ~new & ~((doc == doc[first]) & (place == place[first]))
        out = frame.assign(kind=np.where(repeat, MARK, CLASS).astype(np.int32))[kept | repeat]
        yield out.drop(columns=["context"])
        lead, several = frame.iloc[[first[-1]]], bool(count[-1] > 1)


FOUND = "bucket bigint, doc_id bigint, place int, start int, stop int, kind int"


def sides(frames: Iterator[pd.DataFrame], depth: Depth) -> Iterator[pd.DataFrame]:
    """The context of each class's anchor, once for each side, under the refined bucket. Rows: doc_id, text, places, buckets."""
    after, before = min(depth.q, depth.reach - depth.half), min(depth.q, depth.half + 1)  # the suffix's q bytes, if all strings of a side hold so many
    for frame in frames:
        for i in range(0, len(frame), TEXTS):
            rows = []
            for doc_id, text, places, buckets in frame.iloc[i : i + TEXTS][["doc_id", "text", "places", "buckets"]].itertuples(index=False):
                raw = text.encode()
                ids = Identifiers(np.frombuffer(raw, dtype=np.uint8))
                at, bucket = np.asarray(places, dtype=np.int64), np.asarray(buckets, dtype=np.int64).view(np.uint64)
                right, left = at + depth.q + after <= len(raw), (at >= before) & (at + depth.q <= len(raw))
                name = _mixed(bucket[right] ^ ids.of(at[right] + depth.q, at[right] + depth.q + after))
                rows += [(k, doc_id, p, max(0, p - depth.half), raw[max(0, p - depth.half) : p + depth.length]) for k, p in zip(name.view(np.int64).tolist(), at[right].tolist(), strict=True)]
                name = _mixed(bucket[left] + ids.of(at[left] - before, at[left]))
                rows += [(k, doc_id, p, max(0, p - depth.reach), raw[max(0, p - depth.reach) : p - before + depth.length]) for k, p in zip(name.view(np.int64).tolist(), at[left].tolist(), strict=True)]
            yield pd.DataFrame(rows, columns=["bucket", "doc_id", "place", "start", "context"]).astype({"bucket": "int64", "doc_id": "int64", "place": "int32", "start": "int32"})


SIDES = "bucket bigint, doc_id bigint, place int, start int, context binary"


def _grams(raw: np.ndarray, q: int) -> np.ndarray:
    """The number of the bucket of each q-gram, by its bytes; -1 where it has one suffix only."""
    n = len(raw) - q + 1
    if n <= 0:
        return np.full(len(raw), -1)
    words = np.ndarray(len(raw), dtype="<u8", buffer=np.concatenate([raw, np.zeros(8, dtype=np.uint8)]), strides=(1,))  # the 8 bytes from each place
    name = words[:n] & np.uint64((1 << 8 * q) - 1) if q < 8 else Identifiers(raw).grams(q)
    order = np.argsort(name, kind="stable")
    new = np.ones(n, dtype=bool)
    new[1:] = name[order[1:]] != name[order[:-1]]
    later = np.flatnonzero(~new)
    if q >= 8 and any((words[order[later] + k] != words[order[later - 1] + k]).any() for k in [*range(0, q - 8, 8), q - 8]):  # one identifier for two strings
        every = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, q)).view(f"V{q}").ravel()
        order = np.argsort(every, kind="stable")
        new[1:] = every[order[1:]] != every[order[:-1]]
    return _numbers(order, new, len(raw))


def _numbers(order: np.ndarray, new: np.ndarray, n: int) -> np.ndarray:
    """Numbers of n places from sorted ones and where each bucket begins."""
    bucket = np.cumsum(new) - 1
    out = np.full(n, -1)
    out[order] = np.where(np.bincount(bucket, minlength=1)[bucket] > 1, bucket, -1)
    return out


def passes(raw: np.ndarray, ends: np.ndarray, depth: Depth) -> Iterator[tuple[int, np.ndarray]]:
    """The depth reached and each place's bucket number, after each pass; ends: where the stretch of a place ends. -1: alone, or too near the end."""
    reached, number = depth.q, _grams(raw, depth.q)
    number[np.arange(len(raw)) + reached > ends] = -1
    yield reached, number
    while reached < depth.length:
        step = min(reached, depth.length - reached)
        place = np.flatnonzero(number >= 0)
        place = place[place + reached + step <= ends[place]]
        place = place[number[place + step] >= 0]
        key = number[place] * (len(raw) + 1) + number[place + step]
        order = np.argsort(key, kind="stable")
        new = np.ones(len(place), dtype=bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        reached, number = reached + step, _numbers(place[order], new, len(raw))
        yield reached, number


def _joined(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The contexts as one stretch of bytes, and where each begins and ends."""
    contexts = rows["context"].tolist()
    ends = np.cumsum([len(c) for c in contexts], dtype=np.int64)
    return np.frombuffer(b"".join(contexts), dtype=np.uint8), np.concatenate([[0], ends[:-1]]), ends


def _repeats(rows: pd.DataFrame, depth: Depth) -> pd.DataFrame:
    """Spans of strings in the contexts that an earlier row has too."""
    raw, begins, ends = _joined(rows)
    for _, number in passes(raw, np.repeat(ends, ends - begins), depth):
        pass
    place = np.flatnonzero(number >= 0)
    row, name = np.searchsorted(ends, place, side="right"), number[place]
    doc, start = rows["doc_id"].to_numpy()[row], rows["start"].to_numpy().astype(np.int64)[row] + place - begins[row]
    order = np.lexsort((start, doc, name))
    doc, start, name = doc[order], start[order], name[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = name[1:] != name[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
    repeat = ~((doc == doc[first]) & (start == start[first]))
    return joined_spans(pd.DataFrame({"doc_id": doc[repeat], "start": start[repeat], "stop": start[repeat] + depth.length}))


def refined(frames: Iterator[pd.DataFrame], depth: Depth) -> Iterator[pd.DataFrame]:
    """From a stream sorted by refined bucket: spans of repeats; the single strings of buckets that are too large to hold."""

    def done(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        bucket = rows["bucket"].to_numpy()
        several = pd.Series(bucket).duplicated(keep=False).to_numpy()
        if several.any():
            yield _repeats(rows[several], depth).assign(kind=MARK, name=0, other=0)

    def single(rows: pd.DataFrame) -> pd.DataFrame:
        raw, begins, ends = _joined(rows)
        counts = np.maximum(0, ends - begins - depth.length + 1)
        row = np.repeat(np.arange(len(rows)), counts)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        begin, start = begins[row] + offset, rows["start"].to_numpy().astype(np.int64)[row] + offset
        name, other = (Identifiers(raw, kind).of(begin, begin + depth.length).view(np.int64) for kind in (0, 1))
        return pd.DataFrame({"doc_id": rows["doc_id"].to_numpy()[row], "start": start, "stop": start + depth.length, "kind": SINGLE, "name": name, "other": other})

    held, size, large = [], 0, None
    for frame in frames:
        if large is not None:
            more = frame["bucket"] == large
            if more.any():
                yield single(frame[more])
            frame = frame[~more]
        if not len(frame):
            continue
        large = None
        held.append(frame)
        size += len(frame)
        if size >= AT_ONCE:
            rows = pd.concat(held)
            last = rows["bucket"].iloc[-1]
            open_ = rows["bucket"] == last
            yield from done(rows[~open_])
            held, size = [rows[open_]], int(open_.sum())
            if size >= GROUP_ROWS:
                yield single(held[0])
                held, size, large = [], 0, last
    if held:
        yield from done(pd.concat(held))


SPANS = "doc_id bigint, start bigint, stop bigint, kind int, name bigint, other bigint"


def repeated_spans(docs: DataFrame, scratch: Scratch, depth: Depth = Depth()) -> DataFrame:
    """doc_id, start, stop: the bytes of a document that strings with an earlier occurrence cover; spans may overlap."""
    texts = text_of(docs).where(F.col("doc_id").isNotNull())
    long = texts.where(F.octet_length("text") >= depth.length)
    met = long.mapInPandas(lambda frames: read_anchors(frames, depth), ANCHORS).repartition("bucket").sortWithinPartitions("bucket", "context", "doc_id", "place")
    found = scratch.keep(map_rows(met, classes, FOUND), "classes")
    of_document = found.where(F.col("kind") == CLASS).groupBy("doc_id").agg(F.collect_list(F.struct("place", "bucket")).alias("found"))
    of_document = of_document.select("doc_id", F.col("found.place").alias("places"), F.col("found.bucket").alias("buckets"))
    contexts = texts.join(of_document, "doc_id").mapInPandas(lambda frames: sides(frames, depth), SIDES)
    sorted_ = contexts.repartition("bucket").sortWithinPartitions("bucket")
    spans = scratch.keep(map_rows(sorted_, lambda frames: refined(frames, depth), SPANS, AT_ONCE), "spans")
    singles = spans.where(F.col("kind") == SINGLE).select("name", "other", "doc_id", "start", "stop")
    first = singles.groupBy("name", "other").agg(F.min(F.struct("doc_id", "start")).alias("first"))
    later = singles.join(first, ["name", "other"]).where(F.col("first") != F.struct("doc_id", "start"))
    marks = [found.where(F.col("kind") == MARK), spans.where(F.col("kind") == MARK), later]
    columns = [F.col("doc_id"), F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop")]
    return marks[0].select(columns).union(marks[1].select(columns)).union(marks[2].select(columns))


def kept_parts(raw: bytes, starts, stops) -> tuple[bytes, int, int]:
    """The bytes outside the spans, how many are inside, and the number of maximal runs inside."""
    if starts is None or not len(starts):
        return raw, 0, 0
    edges = np.zeros(len(raw) + 1, dtype=np.int32)
    np.add.at(edges, np.minimum(starts, len(raw)), 1)
    np.add.at(edges, np.minimum(stops, len(raw)), -1)
    gone = np.cumsum(edges[:-1]) > 0
    runs = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
    return np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def with_spans(docs: DataFrame, scratch: Scratch, depth: Depth = Depth()) -> tuple[DataFrame, str, str]:
    """Every row of docs with two arrays, where to begin and to stop removing, null if nothing; and the names of these columns, which no other has."""
    owner, starts, stops = unused(docs, "spans_of", "starts", "stops")
    spans = repeated_spans(docs, scratch, depth).groupBy(F.col("doc_id").alias(owner)).agg(F.collect_list(F.struct("start", "stop")).alias("s"))
    spans = spans.select(owner, F.col("s.start").alias(starts), F.col("s.stop").alias(stops))
    return docs.join(spans, F.col("doc_id") == F.col(owner), "left").drop(owner), starts, stops


def dedup_digests(docs: DataFrame, scratch: Scratch, depth: Depth = Depth()) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans and kept_sha256.

    Texts count as UTF-8, a null text as empty. Removed is every byte that is
    covered by a string of depth.length bytes which also starts earlier: in a
    smaller doc_id, or before in the same document. Texts shorter than that
    lose nothing. Rows repeated under one doc_id are one document: neither is
    earlier. Rows without a doc_id have no order, so they lose nothing and
    are not looked up. An empty table gives no rows; other columns are ignored.
    """

    def digest(frames):
        for frame in frames:
            out = []
            for doc_id, text, starts, stops in frame[["doc_id", "text", "starts", "stops"]].itertuples(index=False):
                raw = text.encode()
                kept, removed, spans = kept_parts(raw, starts, stops)
                out.append((doc_id, len(raw), removed, spans, hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"doc_id": "Int64"})

    rows, *_ = with_spans(text_of(docs), scratch, depth)
    return rows.mapInPandas(digest, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def without_repeats(docs: DataFrame, scratch: Scratch, depth: Depth = Depth()) -> DataFrame:
    """Every row of docs with all its columns and the text that is left; a character that loses a byte goes whole."""

    @F.pandas_udf("string")
    def left(texts: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.Series:
        return pd.Series([kept_parts(t.encode(), a, b)[0].decode(errors="ignore") for t, a, b in zip(texts, starts, stops, strict=True)])

    rows, starts, stops = with_spans(docs.withColumn("text", F.coalesce("text", F.lit(""))), scratch, depth)
    return rows.withColumn("text", F.when(F.col(starts).isNull(), F.col("text")).otherwise(left("text", starts, stops))).drop(starts, stops)
