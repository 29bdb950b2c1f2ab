"""Every stage on odd tables, and the pipeline against the operators one by one."""

import numpy as np
import pytest
from helpers import CLASHES, DOC, docs_of, odd_rows, prose, words

import corpus_pipeline
from dnslake.llm import pieces

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_odd_rows(spark, name, stage):
    docs = docs_of(spark, odd_rows())
    got = stage(spark, docs, SF)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert got.columns == docs.columns
    assert all([r[c] for c in CLASHES] == CLASHES for r in got.collect())
    assert stage(spark, spark.createDataFrame([], DOC), SF).count() == 0


def test_pipeline_rows(spark):
    source = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert 0.5 * len(source) < len(got) < len(source) and len({r.doc_id for r in got}) == len(got)
    with open(pieces.MODEL, "rb") as f:
        model = pieces.Model(f.read())
    ids = np.concatenate([np.array(r.pieces, np.int64) for r in got])
    offs = np.concatenate([[0], np.cumsum([len(r.pieces) for r in got])])
    assert model.decode(ids, offs) == [r.text for r in got]
    assert all(r.text == source[r.doc_id].text or "<secret>" in r.text for r in got)
    assert all(r.n_chars == len(r.text) for r in got)
    # No two that stay share four fifths of their shingles, and no benchmark item is mostly there.
    sets = [(lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)})(words(r.text)) for r in got]
    for i, a in enumerate(sets):
        for b in sets[i + 1:]:
            assert not a or len(a & b) < 0.8 * len(a | b)


def test_prose_helper_is_stable():
    assert prose(1, 3) == prose(1, 3)
