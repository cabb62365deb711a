"""What the operators leave in the shared folder."""

from __future__ import annotations

from pathlib import Path

import pytest

import corpus_pipeline
from hedgeline.llm import queries
from hedgeline.llm.common import released

SMALL = "/root/testdata/sf0.001"


def left(spark) -> set[str]:
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    return {p.name for p in folder.iterdir()} if folder.exists() else set()


@pytest.mark.parametrize("name", ["op2_suffix_dedup", "op3_best_fit_packing", "op5_line_dedup", "op6_multiprobe_neighbours", "op7_simhash_near_dedup", "op8_cover_tree_near_dedup", "op10_pseudo_likelihood"])
def test_nothing_is_left_of_a_query(spark, name):
    before = left(spark)
    with released():
        assert queries.QUERIES[name](spark, SMALL).count() > 0
    assert left(spark) == before


def test_the_pipeline_leaves_what_its_last_stage_reads(spark):
    before = left(spark)
    with released():
        out = corpus_pipeline.run(spark, SMALL)
        mine = {name.rsplit("-", 1)[0] for name in left(spark) - before}
        assert mine == {"pipeline", "pipeline-packing"}
        assert out.count() > 0
    assert left(spark) == before
