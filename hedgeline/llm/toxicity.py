"""Toxicity by logistic regression over hashed word n-grams and skip-grams, fitted by FTRL-proximal.

A word is a stretch without white space, lower-cased and freed of signs at its
ends. Features of a document are the hashes, each counted once, of its words,
of their first four and five letters (inflections of one stem meet there), of
pairs of neighbours and of pairs with one or two words between. FTRL-proximal
keeps a learning rate for each coordinate and sets weights to exactly zero
below the L1 bound, so the weights that are left are few and are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of

#: Words kept per Python worker, about 150 MB.
KNOWN_WORDS = 500_000
STEMS = (4, 5)
#: Distances between the two words of a pair: 1 is a bigram, the others are skip-grams.
GAPS = (1, 2, 3)


@dataclass(frozen=True)
class Settings:
    """bits: of a hashed feature, and so a bound on the broadcast (2**bits weights); train_rows: bound on the labelled rows that are learnt from."""

    bits: int = 20
    train_rows: int = 10_000
    epochs: int = 2
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 1.0
    seed: int = 17


class Words:
    """Hashes of words and of their stems, by the number that a word has got."""

    def __init__(self):
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.hashes = np.zeros((0, 1 + len(STEMS)), dtype=np.uint64)

    def learn(self, words: set[str]) -> None:
        import xxhash

        if len(self.number) > KNOWN_WORDS:
            self._clear()
        if new := list(words.difference(self.number)):
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            bare = [w.strip(SIGNS) or w for w in new]
            rows = [[xxhash.xxh64_intdigest(w), *(xxhash.xxh64_intdigest(w[:n], seed=n) for n in STEMS)] for w in bare]
            self.hashes = np.concatenate([self.hashes, np.array(rows, dtype=np.uint64)])


SIGNS = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum())
_words = Words()
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


def features(texts: list[str], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each family of features: the text's place in the list, and the hashed feature; with repeats."""
    split = [text.lower().split() for text in texts]
    _words.learn(set().union(*split))
    lengths = np.array([len(s) for s in split])
    numbers = np.fromiter((n for s in split for n in map(_words.number.__getitem__, s)), dtype=np.int64, count=int(lengths.sum()))
    owner = np.repeat(np.arange(len(texts)), lengths)
    hashes, shift = _words.hashes[numbers], np.uint64(64 - bits)
    for column in range(hashes.shape[1]):
        yield owner, (hashes[:, column] >> shift).astype(np.int64)
    own = hashes[:, 0]
    for k, gap in enumerate(GAPS):
        if len(own) > gap:
            same = owner[gap:] == owner[:-gap]
            yield owner[gap:][same], ((own[:-gap] * _MIX[k] + own[gap:] * _MIX[k + 1]) >> shift).astype(np.int64)[same]


def fit(frames: Iterator[pd.DataFrame], settings: Settings) -> Iterator[pd.DataFrame]:
    """FTRL-proximal over the labelled rows, in their order; yields the weights that aren't zero (feature -1: the bias)."""
    s, samples = settings, []
    for frame in frames:
        for i in range(0, len(frame), 64):
            part = frame.iloc[i : i + 64]
            owner, feature = map(np.concatenate, zip(*features(part["text"].tolist(), s.bits), strict=True))
            pairs = np.unique(owner << s.bits | feature)
            ends = np.searchsorted(pairs >> s.bits, np.arange(len(part) + 1))
            samples += [((pairs[a:b] & ((1 << s.bits) - 1)).astype(np.int32), float(y)) for a, b, y in zip(ends, ends[1:], part["toxic"], strict=False)]
    size = (1 << s.bits) + 1  # the last is the bias
    z, n = np.zeros(size), np.zeros(size)

    def weights(at):
        pull = np.where(at == size - 1, 0.0, s.l1)
        return np.where(np.abs(z[at]) <= pull, 0.0, -(z[at] - np.sign(z[at]) * pull) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2))

    for _ in range(s.epochs):
        for feature, y in samples:
            at = np.append(feature, size - 1)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha * w
            n[at] += g * g
    w = weights(np.arange(size))
    kept = np.flatnonzero(w)
    yield pd.DataFrame({"feature": np.where(kept == size - 1, -1, kept), "weight": w[kept]})


def scored(frames: Iterator[pd.DataFrame], model, bits: int) -> Iterator[pd.DataFrame]:
    """Add a score to each row of a frame with a text."""
    table, bias = model.value
    for frame in frames:
        for i in range(0, len(frame), 64):
            part = frame.iloc[i : i + 64]
            if table is None:
                score = np.zeros(len(part))
            else:
                hits = [owner[there] << bits | feature[there] for owner, feature in features(part["text"].tolist(), bits) if len(there := np.flatnonzero(table[feature]))]
                pairs = np.unique(np.concatenate(hits)) if hits else np.zeros(0, dtype=np.int64)
                total = bias + np.bincount(pairs >> bits, table[pairs & ((1 << bits) - 1)], len(part))
                score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield part.drop(columns=["text"]).assign(score=score)


def held_out(doc_id):
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, settings: Settings):
    """The weights as a table by feature (None if there is nothing to learn from) and the bias.

    The rows learnt from are the first settings.train_rows by a hash of doc_id
    among labelled rows that aren't held out, so the fit's cost is bounded.
    """
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    turn = F.xxhash64("doc_id", F.lit(settings.seed))
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("turn", turn).orderBy("turn", "doc_id").limit(settings.train_rows)
    rows = text_of(docs).join(F.broadcast(chosen), "doc_id")  # at most train_rows ids
    task = rows.repartition(1).sortWithinPartitions("turn", "doc_id").select("text", "toxic")
    found = task.mapInPandas(partial(fit, settings=settings), "feature bigint, weight double").toPandas()  # at most 2**bits + 1 rows
    if found.empty:
        return None, 0.0
    table, bias = np.zeros(1 << settings.bits, dtype=np.float32), found["feature"] < 0
    table[found.loc[~bias, "feature"].to_numpy()] = found.loc[~bias, "weight"]
    return table, float(found.loc[bias, "weight"].sum())


def score_documents(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per row of docs: doc_id, held_out, score (0 to 1) and predicted (score of 0.5 or more).

    A null text counts as empty and gets the score of the bias alone. Rows are
    scored one by one: repeated rows get equal scores, null doc_ids are allowed
    and count as not held out. Without any label to learn from every score is
    0. Only texts enter a score; other columns are ignored.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs, labels, settings))  # at most 2**bits weights
    rows = text_of(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    out = rows.mapInPandas(partial(scored, model=model, bits=settings.bits), "doc_id bigint, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def scored_rows(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The same scores as a column score beside all columns of docs, which pass through untouched."""
    import pyarrow as pa

    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, settings))
    rows = docs.drop("score")

    def run(batches):
        for batch in batches:
            texts = pd.DataFrame({"text": [text or "" for text in batch.column("text").to_pylist()]})
            scores = [part["score"].to_numpy() for part in scored(iter([texts]), model, settings.bits)]
            column = pa.array(np.concatenate(scores) if scores else np.zeros(0), type=pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "score"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))
