"""The corpus pipeline, stage by stage against plain versions of the same step."""

import os
from collections import Counter

import brute
import pytest

import __spark_entry__ as registered
import corpus_pipeline

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def kept_text(docs):
    """docs: (doc_id, text). doc_id -> text without repeated windows, or None where nothing is left."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        of_text, gone = brute.words(text), set()
        for i in range(len(of_text) - 19):
            key = tuple(of_text[i : i + 20])
            if key in seen:
                gone.update(range(i, i + 20))
            seen.add(key)
        kept = " ".join(w for i, w in enumerate(of_text) if i not in gone)
        out[doc_id] = text if not gone else kept or None
    return out


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / name))
        result = spark.read.parquet(str(tmp_path / name))
        if name != "pieces":
            assert result.columns == docs.columns
        seen[name] = result.collect()
        docs = result
    good = [(r["doc_id"], r["text"]) for r in seen["quality"]]
    parts = brute.component_rows(good)
    single = {(d, t) for d, t in good if parts[d][1] == d}
    assert {(r["doc_id"], r["text"]) for r in seen["near_copies"]} == single
    want = {d: t for d, t in kept_text(single).items() if t is not None}
    assert {r["doc_id"]: r["text"] for r in seen["repeated_passages"]} == want
    taken, _ = brute.mix_rows([(r["doc_id"], r["text"], r["source"]) for r in seen["repeated_passages"]])
    times = Counter(r["doc_id"] for r in seen["source_weights"])
    assert {d: times[d] * len(brute.words(want[d])) for d in want} == {d: taken[d] for d in want}
    assert Counter(r["doc_id"] for r in seen["pieces"]) == times
    assert all(r["round_trip"] for r in seen["pieces"])


def test_registration():
    names = registered.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {k.split("_")[0] + "_" for k in names}
    assert names["pipeline"] is corpus_pipeline.run
    assert len(corpus_pipeline.STAGES) == 5
