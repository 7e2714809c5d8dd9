"""The pipeline's stages, each against a plain version, on small tables with every edge case."""

from collections import Counter

import corpus_pipeline
from lociq.llm import quality
from tests.llm.fixtures import empty, frame
from tests.llm.test_dedup import brute_components


def test_stages(spark):
    docs = frame(spark, 60).drop("kept").withColumnRenamed("n_tokens", "n_chars").withColumnRenamed("__fp", "extra")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "exact_dedup", "near_dedup", "packing"]
    q = corpus_pipeline.quality(spark, docs, "")
    assert q.columns == docs.columns
    verdict = Counter((r["doc_id"], r["text"]) for r in quality.quality_rules(docs).filter("kept").collect())
    rows = q.collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == verdict
    assert all(len((r["text"] or "").split()) >= 10 for r in rows)

    e = corpus_pipeline.exact(spark, q, "")
    assert e.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in e.collect()]
    best = {}
    for r in rows:
        k = r["text"].encode().lower()
        best[k] = max(best.get(k, -1), -1 if r["doc_id"] is None else r["doc_id"])
    assert sorted((t.encode().lower(), -1 if i is None else i) for i, t in kept) == sorted(best.items())

    n = corpus_pipeline.near(spark, e, "")
    assert n.columns == docs.columns
    _, comp = brute_components(kept)
    assert n.count() == len(set(comp))

    p = corpus_pipeline.packing(spark, n, "")
    assert p.filter("piece = 0").count() == n.count()


def test_empty_table_goes_through(spark):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert 0 < out.select("doc_id").distinct().count() < 200


def test_runs_do_not_disturb_each_other(spark, sf):
    """Two runs, and stages of one input called between them: results stay readable, nothing but them is left."""
    import glob

    from lociq.session import scratch_root

    before = set(glob.glob(f"{scratch_root(spark)}/lociq/*"))
    first = corpus_pipeline.run(spark, sf)
    corpus_pipeline.quality(spark, empty(spark).drop("kept"), sf)
    second = corpus_pipeline.run(spark, sf)
    assert first.count() == second.count() > 0
    left = {p.rsplit("/", 1)[-1].split("-")[0] for p in set(glob.glob(f"{scratch_root(spark)}/lociq/*")) - before}
    assert left <= {"packing", "figures"}
