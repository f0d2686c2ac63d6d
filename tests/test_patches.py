"""Patches of a long text, and phrases next to letters of other alphabets."""

import time

from quillspark.operators import spans


def test_many_patches_of_one_text(spark):
    text = "of the é𝒳 " * 60_000
    docs = spark.createDataFrame([(1, text), (2, None), (3, "no"), (4, "")], "doc_id long, text string")
    found = spans.literal_spans(docs, ["of the", "the"])
    p = found.select("doc_id", "start", "end", "channel", "frame_id").selectExpr("doc_id", "start", "end", "channel AS rule", "'<' || frame_id || '>' AS replacement")
    resolved = spans.resolve(p.where("start < 200000"))
    start = time.perf_counter()
    got = dict(map(tuple, spans.apply_patches(docs, resolved).collect()))
    assert got[1] == "<of the> é𝒳 " * 20_000 + "of the é𝒳 " * 40_000
    assert (got[2], got[3], got[4]) == (None, "no", "")
    assert time.perf_counter() - start < 60


def test_bounds_of_phrases(spark):
    texts = ["the", "éthe", "theß the", "'the", "THE 𝒳the", "_the1", "ofthe the."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.end) for r in spans.literal_spans(docs, ["the"]).collect())
    assert got == [(0, 0, 3), (2, 5, 8), (4, 0, 3), (5, 1, 4), (6, 6, 9)]
