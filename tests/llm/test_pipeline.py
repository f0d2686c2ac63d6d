"""The pipeline's stages, each against what its predecessor kept."""

import base64

import corpus_pipeline
import public_tokenizers
import tiktoken
from test_operators import _classes

from quillspark.llm.common import saved


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start, columns = docs.count(), docs.columns
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = saved(stage(spark, docs, sf), f"test-{k}")
        kept[name] = docs
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "minhash near-dedup":
            want = {i for i, _, _, ok in _classes([(r.doc_id, r.text) for r in before.collect()], 80) if ok}
            assert {r.doc_id for r in docs.collect()} == want
        if name in ("personal data", "mixing sources", "byte-level bpe"):
            assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted(r.doc_id for r in before.select("doc_id").collect())
    assert 0.5 * start < docs.count() < start
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r.doc_id: r.text for r in kept["mixing sources"].collect()}
    assert all(list(r.ids) == enc.encode_ordinary(text[r.doc_id] or "") for r in docs.collect())
