"""Each stage of the pipeline on its own input."""

import re

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_operators import _brute_components, _brute_contamination


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    stages, kept = dict(corpus_pipeline.STAGES), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data).cache()
        if name != "BPE encoding and decoding":
            assert out.columns == list(corpus_pipeline.COLUMNS) and not out.where(F.col("n_chars") != F.length("text")).count()
        kept[name] = ({r.doc_id: r.text for r in docs.collect()}, out.collect())
        docs = out
    assert list(stages) == ["quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination", "BPE encoding and decoding"]

    before, after = kept["quality classifier"]
    junk = lambda t: len(re.findall(r"[#$%&*!]{2,}", t)) > 0.4 * len(t.split())
    assert not [r.doc_id for r in after if junk(r.text)] and len(after) > 0.7 * len(before)
    before, after = kept["MinHash near-dedup"]
    expected = {i for i, (_, c) in _brute_components(list(before.items()), 5).items() if i == c}
    assert {r.doc_id for r in after} == expected and all(before[r.doc_id] == r.text for r in after)
    before, after = kept["benchmark decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {r[0] for r in _brute_contamination(list(before.items()), items, 10) if r[-1]}
    assert all(before[r.doc_id] == r.text for r in after if r.doc_id not in dirty) and set(before) - {r.doc_id for r in after} <= dirty
    assert not any(r[-1] for r in _brute_contamination([(r.doc_id, r.text) for r in after], items, 10))
    before, after = kept["BPE encoding and decoding"]
    assert len(after) == len(before) and all(r.exact and r.n_tokens == len(r.token_ids) for r in after)
