"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches, those with the largest doc_ids first. A batch's
line hashes are merge-anti-joined with the runs: hashes that no run has are
new, and this batch has the document that may keep them; of the others only
the count grows. The batch is then added as a sorted run of its own. As soon
as a level holds `fan_in` runs they are compacted into one of the next level,
so that there are never more than fan_in * log(batches) runs to merge with.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, parallelism, text_of, unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCUMENTS, BATCHES, MOST_BATCHES, BATCH_DOCUMENTS, FAN_IN = 20, 3, 4, 16, 1_000_000, 2
HASH = ("h1", "h2")


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends and with A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def key_hash(key: Column) -> tuple[Column, Column]:
    """128 bits in two independent halves."""
    return F.xxhash64(key), F.xxhash64(F.lit("second half"), key)


class Runs:
    """The levels of runs; a run has h1, h2, n (documents) and top (largest doc_id, where the run saw the hash first)."""

    def __init__(self, scratch: Scratch, fan_in: int = FAN_IN):
        self.scratch, self.fan_in = scratch, fan_in
        self.levels: list[list[tuple[str, DataFrame]]] = []
        self.written = 0

    def all(self) -> list[DataFrame]:
        return [run for level in self.levels for _, run in level]

    def _write(self, rows: DataFrame, level: int) -> None:
        self.written += 1
        name = f"run{self.written}-level{level}"
        run = self.scratch.keep_bucketed(rows, name, *HASH)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, run))

    def compact(self, level: int) -> None:
        runs, self.levels[level] = self.levels[level], []
        merged = reduce(DataFrame.union, [run for _, run in runs]).groupBy(*HASH).agg(F.sum("n").alias("n"), F.max("top").alias("top"))
        self._write(merged, level + 1)
        for name, _ in runs:
            self.scratch.drop(name)
        if len(self.levels[level + 1]) >= self.fan_in:
            self.compact(level + 1)

    def unseen(self, own: DataFrame) -> DataFrame:
        """The rows of own whose hash no run has. Runs and own are bucketed alike, so each is read in its buckets and merged."""
        return reduce(lambda left, run: left.join(run.select(*HASH).hint("merge"), [*HASH], "left_anti"), self.all(), own)

    def add(self, lines: DataFrame) -> None:
        """lines: doc_id, h1, h2 of documents none of whose doc_ids is in an earlier batch or larger than one there."""
        own, batch = lines.groupBy(*HASH).agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("top")), f"batch{self.written}"
        if self.all():
            own = self.scratch.keep_bucketed(own, batch, *HASH)
            fresh = self.unseen(own)
            known = own.join(fresh.select(*HASH).hint("merge"), [*HASH], "left_anti").withColumn("top", F.lit(None).cast("bigint"))
            self._write(fresh.union(known), 0)
            self.scratch.drop(batch)
        else:
            self._write(own, 0)
        if len(self.levels[0]) >= self.fan_in:
            self.compact(0)

    def merged(self) -> DataFrame:
        return reduce(DataFrame.union, self.all()).groupBy(*HASH).agg(F.sum("n").alias("n"), F.max("top").alias("top"))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, h1, h2 for every line long enough to count."""
    keys = text_of(docs).where(F.col("doc_id").isNotNull()).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.octet_length("line") >= min_chars)
    keys = keys.select("doc_id", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    h1, h2 = key_hash(F.col("key"))
    return keys.select("doc_id", h1.alias("h1"), h2.alias("h2"))


def batches_of(documents: int, least: int = BATCHES) -> int:
    """Batches of one size while they are few; then they grow with the corpus, as every batch reads the runs of all before it."""
    return max(least, min(MOST_BATCHES, -(-documents // BATCH_DOCUMENTS)))


def dropped_lines(docs: DataFrame, scratch: Scratch, batches: int = BATCHES, fan_in: int = FAN_IN, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """doc_id and drop, an array of the hashes of lines that the document loses; documents that lose nothing are absent."""
    batches = batches_of(docs.count(), batches)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], max(1000, 20 * batches)).alias("q")).first()["q"] or []
    place = reduce(lambda so_far, q: so_far + (F.col("doc_id") <= q).cast("int"), sorted(set(cuts)), F.lit(0))  # 0: the largest doc_ids
    lines = scratch.keep(line_hashes(docs, min_chars).withColumn("batch", place), "lines", "batch")
    runs = Runs(scratch, fan_in)
    for batch in range(len(set(cuts)) + 1):
        runs.add(lines.where(F.col("batch") == batch).drop("batch"))
    # written, so that the join's sides are plain shuffles and Spark may split a line that very many documents have
    repeated = scratch.keep(runs.merged().where(F.col("n") >= min_documents).select(*HASH, "top"), "repeated")
    lost = lines.join(repeated, [*HASH]).where(F.col("doc_id") != F.col("top"))
    return lost.groupBy("doc_id").agg(F.collect_set(F.struct(*HASH)).alias("drop"))


def dedup_lines(docs: DataFrame, scratch: Scratch, batches: int = BATCHES, fan_in: int = FAN_IN, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Every row of docs with all its columns, text without the lines it loses, and n_lines and n_dropped.

    Lines are split at line feeds; a null or empty text is one empty line and
    becomes or stays the empty text. A line counts if its key (line_key) has min_chars code
    points; where it is in min_documents documents or more, all lose it but the
    one with the largest doc_id, which keeps every line it has of it. Rows
    repeated under one doc_id are one document and are treated alike. Rows
    without a doc_id keep everything and aren't counted. An empty table gives
    no rows. Columns named like those made here (n_lines, n_dropped) are replaced.
    """
    rows = docs.drop("n_lines", "n_dropped").withColumn("text", F.coalesce("text", F.lit("")))
    owner, lost, left = unused(rows, "lost_in", "lost", "left")
    drop = dropped_lines(docs, scratch, batches, fan_in, min_chars, min_documents).select(F.col("doc_id").alias(owner), F.col("drop").alias(lost))
    joined = rows.join(drop, F.col("doc_id") == F.col(owner), "left")
    lines = F.split("text", "\n")

    def stays(line: Column) -> Column:
        key = line_key(line)
        h1, h2 = key_hash(key)
        return (F.length(key) < min_chars) | ~F.array_contains(F.col(lost), F.struct(h1.alias("h1"), h2.alias("h2")))

    out = joined.withColumn("n_lines", F.size(lines).cast("bigint")).withColumn(left, F.when(F.col(lost).isNotNull(), F.filter(lines, stays)))
    out = out.withColumn("n_dropped", F.when(F.col(left).isNull(), 0).otherwise(F.col("n_lines") - F.size(left)).cast("bigint"))
    return out.withColumn("text", F.coalesce(F.array_join(left, "\n"), "text")).drop(owner, lost, left)
