"""The pipeline against a brute-force version of its deduplicating and encoding stages, over the smallest tables."""

import collections

import corpus_pipeline
from tests.llm.test_dedup import _components
from tracemill.llm import bpe, mixing, quality, simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = ([r.asDict() for r in before.collect()], [r.asDict() for r in docs.collect()])
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert list(seen) == ["quality_rules", "exact_dedup", "simhash_near_dedup", "pareto_mixing", "bpe"]

    ids = lambda rows: sorted(r["doc_id"] for r in rows)
    before, after = seen["quality_rules"]
    kept = quality.judge(spark.createDataFrame(before)).where("kept").select("doc_id").collect()
    assert ids(after) == sorted(r["doc_id"] for r in kept) and 0 < len(after) < len(before)

    before, after = seen["exact_dedup"]
    last = {}
    for r in before:
        last[r["text"] or ""] = max(last.get(r["text"] or "", -1), r["doc_id"])
    assert ids(after) == sorted(last.values())

    before, after = seen["simhash_near_dedup"]
    before = sorted(before, key=lambda r: r["doc_id"])
    root = _components([simhash.fingerprint(r["text"] or "") for r in before])
    assert ids(after) == sorted(before[k]["doc_id"] for k in set(root))

    before, after = seen["pareto_mixing"]
    copies = {r["doc_id"]: r["copies"] for r in mixing.sample(spark.createDataFrame(before)).collect()}
    assert collections.Counter(ids(after)) == collections.Counter({d: c for d, c in copies.items() if c})

    before, after = seen["bpe"]
    e = bpe.Encoder(bpe.tokenizer_path(), len)
    want = sorted((r["doc_id"], sum(chunks)) for r, chunks in zip(before, e.texts([r["text"] for r in before]), strict=True))
    assert sorted((r["doc_id"], r["n_tokens"]) for r in after) == want
