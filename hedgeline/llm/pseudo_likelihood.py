"""LM scoring by masked pseudo-likelihood: every word is predicted from the words on both sides.

The network's ids are fixed in number: the most frequent words of the whole corpus
have ids of their own, all others share hashed ids. The network adds up an
embedding for each of the words at two places before and two behind, takes
tanh, and predicts first the class of the masked word and then its place in the class, so a
prediction costs two small softmaxes. Which of the words behind a shared id it
is has the probability n / (all + 1) by the counts of the whole corpus, and
1 / (all + 1) is left for words that never occurred; so every word has a
probability of its own, however many there are. A document's score is the sum of
log p(word | both sides) over its words.

Training is by Adagrad in numpy. It starts from the frequencies of the whole corpus,
goes over a bounded sample of parts in one task in small steps, as networks that have learnt
nothing yet can't be averaged well, and then over the windows of all parts in `rounds`
rounds: in each, every task goes on from the same network with its share, and the networks and their
Adagrad sums are averaged by the number of windows they saw, in two steps.

Texts are cut into words once, in parts of bounded size that are written with
the hashes of their different words. The counts of all words stay a Spark
table; those of a part's words are joined to it by part and word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_of

OFFSETS = (-2, -1, 1, 2)
#: Bound on output weights: with width + 1 inputs of at most 1, sums stay below 88.
LARGEST = 5.0
#: A part ends with the text that reaches so many words.
PART_WORDS = 1 << 20
#: doc_id, absent (it has none) and n_words by text; place: for each word in turn its place in `word`, the hashes of the different words.
PARTS = "part bigint, doc_id binary, absent binary, n_words binary, place binary, word binary"
SCORES = "doc_id bigint, n_words bigint, log_p double"


@dataclass(frozen=True)
class Shape:
    """classes * members ids, of which the last `shared` are hashed; id 0 stands beyond the ends of a text."""

    classes: int = 48
    members: int = 64
    shared: int = 512
    width: int = 16
    batch: int = 16384
    rounds: int = 4
    #: Words of the first, single task, and its batch.
    first_words: int = 2_000_000
    first_batch: int = 1024
    rate: float = 1.0
    seed: int = 5
    #: Most tasks that train side by side; each sends one network.
    shards: int = 4096

    @property
    def size(self) -> int:
        return self.classes * self.members


class Network:
    """e: embeddings by offset and id; c: class weights; m: member weights by class. The last input of c and m is a bias."""

    def __init__(self, shape: Shape, flat: np.ndarray | None = None):
        s = shape
        self.shape = s
        self.sizes = [(len(OFFSETS), s.size, s.width), (s.width + 1, s.classes), (s.classes, s.width + 1, s.members)]
        ends = np.cumsum([int(np.prod(x)) for x in self.sizes])
        if flat is None:
            flat = np.random.default_rng(s.seed).normal(0, 0.1, ends[-1]).astype(np.float32)
        self.flat = flat.copy()
        self.e, self.c, self.m = (part.reshape(x) for part, x in zip(np.split(self.flat, ends[:-1]), self.sizes, strict=True))

    def start(self, counts: np.ndarray) -> None:
        """Biases that give each id the probability of its count, if nothing else speaks."""
        p = (counts + 0.5).reshape(self.shape.classes, self.shape.members)
        of_class, of_member = np.log(p.sum(axis=1)), np.log(p)
        self.c[-1] = of_class - of_class.mean()
        self.m[:, -1] = of_member - of_member.mean(axis=1, keepdims=True)
        self.bound()

    def hidden(self, ids: np.ndarray) -> np.ndarray:
        """For a sequence of ids: activations at each place that has all its neighbours."""
        n, reach = len(ids) - 4, 2
        total = self.e[0][ids[:n]]
        for k, offset in enumerate(OFFSETS[1:], 1):
            total += self.e[k][ids[reach + offset : reach + offset + n]]
        out = np.ones((n, self.shape.width + 1), dtype=np.float32)
        np.tanh(total, out=out[:, :-1])
        return out

    def bound(self) -> None:
        """Keep output weights so small that no sum of theirs can overflow exp in single precision."""
        np.clip(self.c, -LARGEST, LARGEST, out=self.c)
        np.clip(self.m, -LARGEST, LARGEST, out=self.m)

    def by_class(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The masked ids in the order of their class: order, class, place in the class, and where each class begins."""
        group, member = np.divmod(ids[2:-2], self.shape.members)
        order = np.argsort(group.astype(np.int16), kind="stable")
        group = group[order]
        return order, group, member[order], np.searchsorted(group, np.arange(self.shape.classes + 1))

    def log_p(self, ids: np.ndarray) -> np.ndarray:
        """log p of each id but the two at either end, given its neighbours."""
        order, group, member, ends = self.by_class(ids)
        h = self.hidden(ids)[order]
        n, ones = len(h), np.ones(max(self.shape.classes, self.shape.members), dtype=np.float32)
        e = np.exp(h @ self.c)
        p = e[np.arange(n), group] / (e @ ones[: self.shape.classes])
        for g in np.flatnonzero(np.diff(ends)):
            rows = slice(ends[g], ends[g + 1])
            e = np.exp(h[rows] @ self.m[g])
            p[rows] *= e[np.arange(len(e)), member[rows]] / (e @ ones[: self.shape.members])
        out = np.empty(n)
        out[order] = np.log(np.maximum(p, 1e-30))
        return out


class Trainer:
    """state: a network's numbers and then its Adagrad sums, one for each embedding and each output weight."""

    def __init__(self, shape: Shape, state: np.ndarray | None = None):
        self.net = Network(shape)
        sizes = [self.net.e.shape[:2], self.net.c.shape, self.net.m.shape]
        self.sums = np.full(sum(int(np.prod(x)) for x in sizes), 1e-2, np.float32)
        if state is not None:
            self.net, self.sums = Network(shape, state[: len(self.net.flat)]), state[len(self.net.flat) :].copy()
        ends = np.cumsum([int(np.prod(x)) for x in sizes])
        self.seen = [part.reshape(x) for part, x in zip(np.split(self.sums, ends[:-1]), sizes, strict=True)]

    def state(self) -> np.ndarray:
        return np.concatenate([self.net.flat, self.sums])

    def train(self, ids: np.ndarray, batch: int, which: int = 0, rounds: int = 1) -> int:
        """Of the batches of a sequence every one that is `which` modulo rounds; returns how many words it saw."""
        seen = 0
        for k in range(which * batch, len(ids) - 4, rounds * batch):
            some = ids[k : k + batch + 4]
            if n := int(np.count_nonzero(words := some[2:-2] > 0)):
                self.step(some, words.astype(np.float32))
                seen += n
        return seen

    def _dense(self, which: int, at, weights: np.ndarray, gradient: np.ndarray) -> None:
        self.seen[which][at] += gradient * gradient
        weights[at] -= self.net.shape.rate * gradient / np.sqrt(self.seen[which][at])

    @staticmethod
    def _error(h: np.ndarray, weights: np.ndarray, target: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """Gradient of the scaled loss by the inputs of a softmax."""
        d = np.exp(h @ weights)
        d *= (scale / (d @ np.ones(d.shape[1], dtype=np.float32)))[:, None]
        d[np.arange(len(d)), target] -= scale
        return d

    def step(self, ids: np.ndarray, weight: np.ndarray) -> None:
        """One batch; weight is 0 at places that aren't words."""
        net = self.net
        order, group, member, ends = net.by_class(ids)
        h = net.hidden(ids)[order]
        n, scale = len(h), (weight / max(1, weight.sum())).astype(np.float32)[order]
        d = self._error(h, net.c, group, scale)
        sorted_back = d @ net.c[:-1].T
        self._dense(1, slice(None), net.c, h.T @ d)
        for g in np.flatnonzero(np.diff(ends)):
            rows = slice(ends[g], ends[g + 1])
            d = self._error(h[rows], net.m[g], member[rows], scale[rows])
            sorted_back[rows] += d @ net.m[g][:-1].T
            self._dense(2, g, net.m, h[rows].T @ d)
        sorted_back *= 1 - h[:, :-1] ** 2
        back = np.empty_like(sorted_back)
        back[order] = sorted_back
        net.bound()
        by_id = np.argsort(ids.astype(np.int16), kind="stable")
        for k, offset in enumerate(OFFSETS):
            place = by_id - (2 + offset)  # of the masked word whose neighbour at this offset stands there
            place = place[(place >= 0) & (place < n)]
            word = ids[place + 2 + offset]
            heads = np.flatnonzero(np.diff(word, prepend=-1))
            g = np.add.reduceat(back[place], heads, axis=0)
            word = word[heads]
            self.seen[0][k, word] += (g * g).mean(axis=1)
            net.e[k, word] -= self.net.shape.rate * g / np.sqrt(self.seen[0][k, word])[:, None]


def words(text: str) -> list[str]:
    return text.lower().split()


def _digest(word: str) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's texts as parts."""
    context = TaskContext.get()
    part = context.partitionId() << 32 if context else 0
    doc_ids, absent, counts, places, known, size = [], [], [], [], defaultdict(), 0

    def packed() -> pd.DataFrame:
        word = np.fromiter(map(_digest, known), dtype=np.int64, count=len(known))
        columns = {"doc_id": np.concatenate(doc_ids), "absent": np.concatenate(absent), "n_words": np.array(counts, dtype=np.int64), "place": np.concatenate(places), "word": word}
        return pd.DataFrame({"part": [part]} | {k: [v.tobytes()] for k, v in columns.items()})

    known.default_factory = known.__len__
    for frame in frames:
        for i in range(0, len(frame), 64):
            rows, flat = frame.iloc[i : i + 64], []
            for text in rows["text"]:
                found = words(text)
                counts.append(len(found))
                flat += found
            missing = rows["doc_id"].isna()
            doc_ids.append(rows["doc_id"].fillna(0).to_numpy(np.int64))
            absent.append(missing.to_numpy(bool))
            places.append(np.fromiter(map(known.__getitem__, flat), dtype=np.int32, count=len(flat)))
            size += len(flat)
            if size >= PART_WORDS:
                yield packed()
                part, size = part + 1, 0
                for held in (doc_ids, absent, counts, places, known):
                    held.clear()
    if counts:
        yield packed()


def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hashes of each part's words and how often they stand there."""
    for frame in frames:
        for part in map(Part, frame.itertuples()):
            yield pd.DataFrame({"word": part.word, "n": np.bincount(part.place, minlength=len(part.word))})


class Part:
    def __init__(self, row):
        self.doc_id, self.n_words, self.word = (np.frombuffer(x, dtype=np.int64) for x in (row.doc_id, row.n_words, row.word))
        self.absent, self.place = np.frombuffer(row.absent, dtype=bool), np.frombuffer(row.place, dtype=np.int32)
        self.text = np.repeat(np.arange(len(self.n_words)), self.n_words)
        #: Of each word in ids().
        self.at = np.arange(len(self.place)) + 2 * (self.text + 1)

    def ids(self, of_word: np.ndarray) -> np.ndarray:
        """All ids with two of beyond before and behind each text."""
        out = np.zeros(len(self.place) + 2 * len(self.n_words) + 2, dtype=np.int64)
        out[self.at] = of_word[self.place]
        return out

    def scores(self, by_word: np.ndarray) -> pd.DataFrame:
        """by_word: log p of each word in turn."""
        total = np.bincount(self.text, weights=by_word, minlength=len(self.n_words))
        return pd.DataFrame({"doc_id": pd.arrays.IntegerArray(self.doc_id.copy(), self.absent.copy()), "n_words": self.n_words, "log_p": total})


class Ids:
    """Ids of hashes of words; own: those of frequent words."""

    def __init__(self, own: dict[int, int], shape: Shape):
        self.shape = shape
        self.hashes = np.array(sorted(own), dtype=np.int64)
        self.own = np.array([own[h] for h in sorted(own)], dtype=np.int64)

    def of(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's id, and whether others share it."""
        ids, shared = self.shape.size - 1 - word % self.shape.shared, np.ones(len(word), dtype=bool)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, word), len(self.hashes) - 1)
            shared = self.hashes[at] != word
            ids = np.where(shared, ids, self.own[at])
        return ids, shared


def first_trained(frames: Iterator[pd.DataFrame], shape: Shape, vocabulary, start) -> Iterator[pd.DataFrame]:
    """The network of the single task that begins."""
    ids_of, trainer = Ids(vocabulary.value, shape), Trainer(shape, np.frombuffer(start.value, dtype=np.float32))
    for frame in frames:
        for part in map(Part, frame.itertuples()):
            trainer.train(part.ids(ids_of.of(part.word)[0]), shape.first_batch)
    yield pd.DataFrame({"network": [trainer.state().tobytes()], "seen": [1]})


def trained(frames: Iterator[pd.DataFrame], shape: Shape, vocabulary, start, which: int) -> Iterator[pd.DataFrame]:
    """What a task makes of the network in one round."""
    ids_of, trainer, seen = Ids(vocabulary.value, shape), Trainer(shape, np.frombuffer(start.value, dtype=np.float32)), 0
    for frame in frames:
        for part in map(Part, frame.itertuples()):
            seen += trainer.train(part.ids(ids_of.of(part.word)[0]), shape.batch, which, shape.rounds)
    if seen:
        yield pd.DataFrame({"network": [trainer.state().tobytes()], "seen": [seen]})


def averaged(networks: pd.DataFrame) -> pd.DataFrame:
    total, seen = None, 0
    for flat, n in zip(networks["network"], networks["seen"], strict=True):
        part = np.frombuffer(flat, dtype=np.float32).astype(np.float64) * n
        total, seen = part if total is None else total + part, seen + n
    return pd.DataFrame({"network": [(total / seen).astype(np.float32).tobytes()], "seen": [seen]})


def network_of(state, shape: Shape) -> Network:
    return Trainer(shape, np.frombuffer(state.value, dtype=np.float32) if state.value else None).net


def by_id(part: Part, network: Network, of_word: np.ndarray) -> np.ndarray:
    """log p of the id of each word of a part."""
    ids, batch = part.ids(of_word), network.shape.batch
    log_p = [network.log_p(ids[k : k + batch + 4]) for k in range(0, len(ids) - 4, batch)]
    return np.concatenate(log_p or [np.zeros(0)]).astype(np.float64)[part.at - 2]


def scored(frames: Iterator[pd.DataFrame], shape: Shape, vocabulary, flat) -> Iterator[pd.DataFrame]:
    """Scores by the network alone, which doesn't tell apart the words that share an id."""
    ids_of, network = Ids(vocabulary.value, shape), network_of(flat, shape)
    for frame in cut(frames):
        for part in map(Part, frame.itertuples()):
            yield part.scores(by_id(part, network, ids_of.of(part.word)[0]))


def sharing(frames: Iterator[pd.DataFrame], shape: Shape, vocabulary) -> Iterator[pd.DataFrame]:
    """The words of each part that share an id, with their places among its words."""
    ids_of = Ids(vocabulary.value, shape)
    for frame in frames:
        for row in frame.itertuples():
            word = np.frombuffer(row.word, dtype=np.int64)
            place = np.flatnonzero(ids_of.of(word)[1])
            yield pd.DataFrame({"part": np.full(len(place), row.part), "place": place.astype(np.int32), "word": word[place]})


def within(word: np.ndarray, n: np.ndarray, held: np.ndarray) -> np.ndarray:
    """log p of words among those that share their id; n: their counts, 0 if unseen; held: the sum of counts by shared id."""
    return np.log(np.maximum(n, 1)) - np.log(held[word % len(held)] + 1.0)


def scored_part(parts: pd.DataFrame, counts: pd.DataFrame, shape: Shape, vocabulary, flat, held) -> pd.DataFrame:
    """Scores of one part from the network and from the counts of its words that share an id; words without a count stand once in all texts."""
    ids_of, network, out = Ids(vocabulary.value, shape), network_of(flat, shape), []
    for part in map(Part, parts.itertuples()):
        (of_word, shared), n = ids_of.of(part.word), np.ones(len(part.word))
        n[counts["place"].to_numpy()] = counts["n"].to_numpy()
        inside = np.zeros(len(part.word))
        inside[shared] = within(part.word[shared], n[shared], held.value)
        out.append(part.scores(by_id(part, network, of_word) + inside[part.place]))
    return pd.concat(out)


def parts_of(docs: DataFrame) -> DataFrame:
    return text_of(docs).mapInPandas(cut, PARTS)


def counts_of(parts: DataFrame) -> DataFrame:
    """How often each word, by its hash, stands in all texts."""
    return parts.mapInPandas(counted, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, shape: Shape) -> tuple[dict[int, int], np.ndarray]:
    """Ids of the most frequent words by their hash, and the count of every id."""
    most = counts.orderBy(F.desc("n"), "word").limit(shape.size - shape.shared - 1).collect()  # at most shape.size
    own, by_id = {row["word"]: i for i, row in enumerate(most, 1)}, np.zeros(shape.size)
    by_id[1 : len(most) + 1] = [row["n"] for row in most]
    names = counts.sparkSession.createDataFrame([(word,) for word in own], "word bigint")
    rest = counts.join(F.broadcast(names), "word", "left_anti").groupBy(F.pmod("word", F.lit(shape.shared)).alias("at")).agg(F.sum("n").alias("n"))
    for row in rest.collect():  # at most shape.shared
        by_id[shape.size - 1 - row["at"]] = row["n"]
    return own, by_id


def held_by_id(by_id: np.ndarray, shape: Shape) -> np.ndarray:
    """The sum of the counts of the words that share an id, by hash modulo shape.shared."""
    return by_id[shape.size - shape.shared :][::-1].astype(np.int64)


def train(parts: DataFrame, vocabulary, by_id: np.ndarray, shape: Shape = Shape()) -> bytes:
    """The state of the trained network."""
    context = parts.sparkSession.sparkContext
    start = Trainer(shape)
    start.net.start(by_id)
    state, schema = start.state().tobytes(), "network binary, seen bigint"
    sizes = parts.select("part", (F.octet_length("place") / 4).alias("n")).orderBy(F.xxhash64("part")).limit(1000).collect()  # of the first 1000 parts
    ends = np.cumsum([row["n"] for row in sizes])
    chosen = [row["part"] for row in sizes[: np.searchsorted(ends, shape.first_words) + 1]]
    if chosen:
        some = parts.where(F.col("part").isin(chosen)).repartition(1).sortWithinPartitions("part")  # first_words and one part at most
        state = bytes(some.mapInPandas(partial(first_trained, shape=shape, vocabulary=vocabulary, start=context.broadcast(state)), schema).first()["network"])
    for which in range(shape.rounds):
        f = partial(trained, shape=shape, vocabulary=vocabulary, start=context.broadcast(state), which=which)
        networks = parts.coalesce(shape.shards).mapInPandas(f, schema)
        some = networks.groupBy(F.pmod(F.xxhash64("network"), F.lit(64)).alias("group")).applyInPandas(averaged, schema)
        one = some.groupBy(F.lit("all").alias("group")).applyInPandas(averaged, schema).collect()  # one network
        state = bytes(one[0]["network"]) if one else state
    return state


def score_documents(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """Per row of docs: doc_id, n_words, log_p (the sum over its words) and mean_log_p (null without words).

    Words are lower-cased and lie between white space. A null or empty text has
    no words and a sum of 0. Rows are scored one by one: repeated rows get
    equal scores and count as often as they stand there in training; null
    doc_ids are allowed. An empty table gives no rows; other columns are ignored.
    """
    context, scratch = docs.sparkSession.sparkContext, Scratch(docs.sparkSession, "lm-scoring")
    parts = scratch.keep(parts_of(docs), "parts")
    counts = scratch.keep(counts_of(parts), "counts")
    own, by_id = most_frequent(counts, shape)
    vocabulary = context.broadcast(own)  # at most shape.size ids
    held = context.broadcast(held_by_id(by_id, shape))  # of fixed size
    network = context.broadcast(train(parts, vocabulary, by_id, shape))  # of fixed size
    some = parts.mapInPandas(partial(sharing, shape=shape, vocabulary=vocabulary), "part bigint, place int, word bigint")
    known = scratch.keep(some.join(counts.where("n > 1"), "word").select("part", "place", "n"), "known")
    f = partial(scored_part, shape=shape, vocabulary=vocabulary, flat=network, held=held)
    out = parts.groupBy("part").cogroup(known.groupBy("part")).applyInPandas(f, SCORES)
    return out.withColumn("mean_log_p", F.when(F.col("n_words") > 0, F.col("log_p") / F.col("n_words")))
