"""The pipeline's stages, each on its own input, against plain Python."""

import corpus_pipeline
from tidemark.llm import nearcopies
from tidemark.llm.common import read, stored

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, DATA, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, DATA), name)
        if name != "encoding":
            assert out.columns == docs.columns
        if name in ("toxicity", "language"):
            assert 0.5 * docs.count() < out.count() <= docs.count()
        if name == "near_copies":
            texts = {r["doc_id"]: set(nearcopies.shingle_hashes(r["text"], 5).tolist()) for r in docs.collect()}
            parent = {d: d for d in texts}

            def root(d, parent=parent):
                while parent[d] != d:
                    d = parent[d]
                return d

            ids = sorted(texts)
            for i, a in enumerate(ids):
                for b in ids[:i]:
                    if texts[a] == texts[b] or len(texts[a] & texts[b]) / len(texts[a] | texts[b]) >= 0.8:
                        parent[max(root(a), root(b))] = min(root(a), root(b))
            assert {r["doc_id"] for r in out.collect()} == {d for d in ids if root(d) == d}
        if name == "mixing":
            before = {r["doc_id"] for r in docs.collect()}
            assert {r["doc_id"] for r in out.collect()} <= before
        if name == "encoding":
            assert out.count() == docs.count() and out.where("not round_trip").count() == 0
            assert out.where("size(ids) = 0 and text <> ''").count() == 0
        docs = out
    assert corpus_pipeline.run(spark, DATA).count() == docs.count()
