"""Each stage of the pipeline against plain Python on what the stage before gave."""

from __future__ import annotations

import corpus_pipeline
from hedgeline.llm import packing, toxicity
from hedgeline.llm.common import Scratch, table

from . import brute
from .test_texts import check_ids, check_packing

SMALL = "/root/testdata/sf0.001"


def texts(df) -> dict:
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages(spark):
    scratch, docs = Scratch(spark, "t"), table(spark, SMALL, "documents")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, table(spark, SMALL, "labels")).collect()}
    given = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, made = texts(given), stage(spark, given, SMALL)
        assert made.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        given = scratch.keep(made, name)
        assert given.where("n_chars <> length(text)").count() == 0
        after = texts(given)
        if name == "toxicity":
            assert after == {i: t for i, t in before.items() if scores[i] < 0.5}
        elif name == "line_dedup":
            assert after == {i: kept for i, (_, _, kept) in brute.line_dedup(before).items()}
        elif name == "simhash_near_dedup":
            assert after == {i: before[i] for i, (_, component) in brute.near_duplicates(before).items() if i == component}
        else:
            assert after == {i: kept.decode(errors="ignore") for i, (_, _, kept) in brute.suffix_dedup(before).items()}
    direct = corpus_pipeline.STAGES[-1][1](spark, given, SMALL).collect()
    lengths = check_ids(direct, texts(given))
    whole = corpus_pipeline.run(spark, SMALL).collect()
    assert check_packing(direct, lengths, packing.CAPACITY) == check_packing(whole, lengths, packing.CAPACITY)


def test_stages_with_odd_rows(spark):
    """Nulls, empty texts, repeated rows and clashing columns go through every stage."""
    rows = [(1, None, None, None, None, 1), (2, "", "en", "s", 0, 2), (3, "plain words here", "en", "s", 16, 3), (3, "plain words here", "en", "s", 16, 3), (None, "no id at all", "en", "s", 12, 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score int")
    scratch = Scratch(spark, "t")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, SMALL), name)
    assert {r["doc_id"] for r in docs.collect()} >= {3, None}
    nothing = docs.where("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SMALL).count() == 0
