"""Toxicity, LM scoring and chat formatting: held-out accuracy, ordering and exact round trips."""

from __future__ import annotations

import math
import random
import zlib
from functools import partial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hedgeline.llm import chat, pseudo_likelihood, queries, toxicity
from hedgeline.llm.common import Scratch, table

from ..compare import of_duckdb, of_spark

LARGER, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def test_toxicity_on_rows_never_learnt_from(spark):
    scores = queries.op1_toxicity(spark, LARGER)
    rows = scores.join(table(spark, LARGER, "labels").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    toxic, clean = [r["score"] for r in rows if r["toxic"] == 1], [r["score"] for r in rows if r["toxic"] == 0]
    assert len(toxic) > 5 and len(clean) > 20
    auc = sum((t > c) + (t == c) / 2 for t in toxic for c in clean) / (len(toxic) * len(clean))
    assert auc > 0.95
    assert sum(r["predicted"] == r["toxic"] for r in rows) / len(rows) > 0.93


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(i, "you vile awful thing" if i % 2 else "a pleasant calm morning", "x") for i in range(200)] + [(300, None, "x"), (301, "", "x"), (None, "vile awful", "x"), (302, "word " * 50_000, "x")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(0, None), (None, 1)], "doc_id bigint, toxic int")
    out = toxicity.score_documents(docs, labels)
    rows = out.collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == 204 and all(0 <= r["score"] <= 1 for r in rows)
    assert by_id[300]["score"] == by_id[301]["score"]
    assert by_id[None]["predicted"] == 1 and not by_id[None]["held_out"]
    assert all(by_id[i]["predicted"] == i % 2 for i in range(200))
    assert {r["score"] for r in toxicity.score_documents(docs, labels.where("doc_id < 0")).collect()} == {0.0}
    assert toxicity.score_documents(docs.where("doc_id < 0"), labels).count() == 0
    passed = toxicity.scored_rows(docs.drop("score").withColumn("held_out", F.lit("kept")), labels)
    assert passed.columns == ["doc_id", "text", "held_out", "score"] and passed.where("held_out = 'kept'").count() == 204


def test_toxicity_never_learns_from_held_out_rows(spark):
    """Labels of held-out rows may say anything: the scores stay."""
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    spoilt = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first, second = ({r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, x).collect()} for x in (labels, spoilt))
    assert first == second


def test_pseudo_likelihood_tells_order_from_disorder(spark):
    """Trained on the texts as they are, it finds the same words in random order less likely."""
    docs, context, shape = table(spark, LARGER, "documents").select("doc_id", "text"), spark.sparkContext, pseudo_likelihood.Shape()
    parts = Scratch(spark, "t").keep(pseudo_likelihood.parts_of(docs), "parts")
    own, by_id = pseudo_likelihood.most_frequent(pseudo_likelihood.counts_of(parts), shape)
    vocabulary = context.broadcast(own)
    network = context.broadcast(pseudo_likelihood.train(parts, vocabulary, by_id, shape))
    mixed = docs.withColumn("text", F.array_join(F.shuffle(F.split("text", r"\s+"), seed=F.lit(3)), " "))
    scored = partial(pseudo_likelihood.scored, shape=shape, vocabulary=vocabulary, flat=network)
    sums = []
    for rows in (docs, mixed):
        frame = pseudo_likelihood.text_of(rows).mapInPandas(scored, "doc_id bigint, n_words bigint, log_p double").toPandas().set_index("doc_id")
        sums.append(frame[frame["n_words"] >= 30].sort_index()["log_p"])
    own, other = sums
    assert own.sum() > other.sum()
    assert (own > other).mean() > 0.75


def test_log_p_is_a_softmax_over_all_ids():
    """p of every id at one place, by plain numpy: class by class, then members; they add up to one."""
    shape = pseudo_likelihood.Shape(classes=3, members=4, shared=2, width=5)
    rng = np.random.default_rng(6)
    network = pseudo_likelihood.Network(shape, rng.normal(0, 0.8, len(pseudo_likelihood.Network(shape).flat)).astype(np.float32))
    ids = rng.integers(0, shape.size, 30)
    for place in (2, 11, 27):
        h = np.append(np.tanh(sum(network.e[k, ids[place + offset]] for k, offset in enumerate(pseudo_likelihood.OFFSETS))), 1.0)
        of_class = np.exp(h @ network.c) / np.exp(h @ network.c).sum()
        p = np.array([of_class[g] * np.exp(h @ network.m[g]) / np.exp(h @ network.m[g]).sum() for g in range(shape.classes)]).ravel()
        assert p.sum() == pytest.approx(1)
        for other in range(shape.size):
            given = ids.copy()
            given[place] = other
            assert network.log_p(given)[place - 2] == pytest.approx(np.log(p[other]), abs=1e-4)


class Held:
    def __init__(self, value):
        self.value = value


def parts_and_counts(texts: list[str], shape):
    frame = pd.DataFrame({"doc_id": pd.array(range(len(texts)), dtype="Int64"), "text": texts})
    rows = pd.concat(list(pseudo_likelihood.cut(iter([frame]))))
    parts = [pseudo_likelihood.Part(r) for r in rows.itertuples()]
    words = np.concatenate([p.word[p.place] for p in parts])
    return rows, parts, words


@pytest.mark.parametrize("tasks", [8, 64])
def test_networks_of_many_tasks_beat_counts_of_words_and_of_pairs(tasks):
    """Mean log p of the ids of documents that none has seen, whether 8 or 64 tasks train side by side."""
    import pyarrow.parquet as pq

    shape = pseudo_likelihood.Shape()
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.1/documents.parquet")["text"].to_pylist()]
    learnt, unseen = [t for i, t in enumerate(texts) if i % 4], [t for i, t in enumerate(texts) if i % 4 == 0]
    _, _, words = parts_and_counts(learnt, shape)
    word, n = np.unique(words, return_counts=True)
    frequent = word[np.lexsort((word, -n))][: shape.size - shape.shared - 1]
    ids_of = pseudo_likelihood.Ids({int(w): i for i, w in enumerate(frequent, 1)}, shape)
    by_id = np.bincount(ids_of.of(word)[0], weights=n, minlength=shape.size)
    vocabulary = Held({int(w): i for i, w in enumerate(frequent, 1)})

    start = pseudo_likelihood.Trainer(shape)
    start.net.start(by_id)
    dealt = [parts_and_counts(learnt[k::tasks], shape)[0] for k in range(tasks)]
    first = list(pseudo_likelihood.first_trained(iter(dealt[: max(1, tasks // 2)]), shape, vocabulary, Held(start.state().tobytes())))
    state = first[0]["network"].iloc[0]
    for which in range(shape.rounds):
        networks = [next(pseudo_likelihood.trained(iter([rows]), shape, vocabulary, Held(state), which), None) for rows in dealt]
        state = pseudo_likelihood.averaged(pd.concat([x for x in networks if x is not None]))["network"].iloc[0]
    network = pseudo_likelihood.network_of(Held(state), shape)

    streams = lambda parts: [p.ids(ids_of.of(p.word)[0]) for p in parts]
    own = streams(parts_and_counts(learnt, shape)[1])
    frequency = (by_id + 0.5) / (by_id + 0.5).sum()
    pairs, before = np.unique(np.concatenate([x[:-1] * shape.size + x[1:] for x in own]), return_counts=True), np.bincount(np.concatenate([x[:-1] for x in own]), minlength=shape.size)
    by_network, by_word, by_pair, words = 0.0, 0.0, 0.0, 0
    for part in parts_and_counts(unseen, shape)[1]:
        by_network += pseudo_likelihood.by_id(part, network, ids_of.of(part.word)[0]).sum()
        (x,) = streams([part])
        a, b = x[:-1][x[1:] > 0], x[1:][x[1:] > 0]
        at = np.minimum(np.searchsorted(pairs[0], a * shape.size + b), len(pairs[0]) - 1)
        n = np.where(pairs[0][at] == a * shape.size + b, pairs[1][at], 0)
        by_word += np.log(frequency[b]).sum()
        by_pair += np.log((n + 500 * frequency[b]) / (before[a] + 500)).sum()
        words += len(b)
    print(f"{tasks} tasks: {by_network / words:.3f}, pairs {by_pair / words:.3f}, words {by_word / words:.3f}")
    assert by_network > by_pair > by_word


def test_pseudo_likelihood_edges(spark):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "one"), (5, "a b a b a b a b"), (5, "a b a b a b a b"), (None, "a b"), (6, "w " * 60_000)]
    out = pseudo_likelihood.score_documents(spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, log_p int")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r["n_words"] == 0) == (r["doc_id"] in (1, 2, 3)) == (r["mean_log_p"] is None)
        assert r["log_p"] <= 0
    assert len({r["log_p"] for r in out if r["doc_id"] == 5}) == 1
    assert pseudo_likelihood.score_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert pseudo_likelihood.score_documents(spark.createDataFrame([(1, None)], "doc_id bigint, text string")).count() == 1


def test_a_score_is_the_sum_over_the_words():
    """Scoring a text alone or among others gives the same."""
    shape = pseudo_likelihood.Shape()
    texts = ["alpha beta gamma delta", "", "beta beta", "gamma alpha beta " * 4000]
    together = pd.concat(list(pseudo_likelihood.scored(iter([pd.DataFrame({"doc_id": range(4), "text": texts})]), shape, Held({}), Held(b""))))
    for i, text in enumerate(texts):
        alone = pd.concat(list(pseudo_likelihood.scored(iter([pd.DataFrame({"doc_id": [i], "text": [text]})]), shape, Held({}), Held(b""))))
        assert np.isclose(alone["log_p"].iloc[0], together["log_p"].iloc[i], rtol=1e-5)
        assert together["n_words"].iloc[i] == len(text.split())


def test_words_that_share_an_id_are_told_apart(spark):
    """Two words have ids of their own; of the others, in equal places, each is as likely as the whole corpus says."""
    shape = pseudo_likelihood.Shape(classes=2, members=2, shared=1)
    rows = [(i, "top mid " * 50) for i in range(4)] + [(10 + i, "often") for i in range(30)] + [(50, "rare"), (51, "lone"), (52, "twin"), (53, "twin")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    out = {r["doc_id"]: r["log_p"] for r in pseudo_likelihood.score_documents(docs, shape).collect()}
    assert len(out) == len(rows)
    assert out[51] == pytest.approx(out[50]) and out[53] == pytest.approx(out[52])
    assert out[52] - out[50] == pytest.approx(math.log(2), abs=1e-5)
    assert out[10] - out[50] == pytest.approx(math.log(30), abs=1e-5)


def test_words_that_share_an_id_have_a_distribution():
    word, n = np.array([-8, -4, 0, 4, 5]), np.array([3, 1, 2, 0, 7])
    held = np.array([6, 7, 0, 0])
    p = np.exp(pseudo_likelihood.within(word, n, held))
    assert p[:4] == pytest.approx([3 / 7, 1 / 7, 2 / 7, 1 / 7]) and p[:4].sum() == pytest.approx(1)
    assert p[4] == pytest.approx(7 / 8)


def test_chat_query_equals_its_sql(spark):
    assert of_spark(queries.op9_chat_formatting(spark, SMALL)) == of_duckdb(queries.ORACLES["op9_chat_formatting"], SMALL)


def conversations() -> list[tuple]:
    rng = random.Random(5)
    parts = ["<turn assistant>", "</turn>", "\n", "\\", "<", ">", "hello", "é", "\\<", "### Assistant:", " "]
    text = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
    rows = [(c, t, rng.choice(["user", "assistant", "sys>\\tem", "assistant"]), text()) for c in range(40) for t in range(rng.randint(1, 7))]
    return rows + [(100, 0, None, None), (100, 0, "assistant", None), (101, 1, "user", "tie"), (101, 1, "assistant", "tie"), (101, 1, "assistant", "tie"), (102, 0, "assistant", "long " * 30_000), (103, None, "user", "no turn")]


def test_chat_examples_read_back(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn int, role string, text string, example int").repartition(3)
    examples = chat.expand(df).collect()
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        turns = [(role, text) for _, _, role, text in turns]
        mine = sorted((e for e in examples if e["conv_id"] == conv), key=lambda e: e["example"])
        ends = [i for i, (role, _) in enumerate(turns, 1) if role == "assistant" or i == len(turns)]
        assert len(mine) == len(ends)
        for e, end in zip(mine, ends, strict=True):
            assert chat.read_turns(e["formatted"]) == turns[:end]
            reply = chat.unescape(e["formatted"][e["loss_start"] : e["loss_stop"]])
            assert reply == (turns[end - 1][1] if turns[end - 1][0] == "assistant" else "")


def test_chat_edges(spark):
    schema = "conv_id bigint, turn int, role string, text string"
    assert chat.digests(chat.expand(spark.createDataFrame([], schema))).count() == 0
    out = {r["conv_id"]: r for r in chat.digests(chat.expand(spark.createDataFrame([(None, 0, "user", "a"), (1, 0, "user", "b")], schema))).collect()}
    assert out.keys() == {None, 1} and out[1]["loss_chars"] == 0 and out[None]["n_turns"] == 1


@pytest.mark.parametrize("role", ["user", "a>b", "\\", "\\>"])
def test_roles_with_marks(spark, role):
    df = spark.createDataFrame([(1, 0, role, "x"), (1, 1, "assistant", "\\### Assistant: </turn> ok")], "conv_id bigint, turn int, role string, text string")
    (example,) = chat.expand(df).collect()
    assert chat.read_turns(example["formatted"]) == [(role, "x"), ("assistant", "\\### Assistant: </turn> ok")]
